"""Loudness, interval, detection and level statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp
from .order import exact_quantiles, smoothed, written  # noqa: F401 (smoothing is found here too)


def quiet_runs(frames: DataFrame, item: str, threshold_db: float, frame_ms: int, min_ms: int) -> DataFrame:
    """Runs of consecutive frames below a level that last long enough (gaps and islands)."""
    quiet = frames.filter(F.col("level_db") < threshold_db)
    island = F.col("frame") - F.row_number().over(Window.partitionBy(item).orderBy("frame"))
    runs = quiet.withColumn("__i", island).groupBy(item, "__i").agg(F.min("frame").alias("a"), F.count("*").alias("n"))
    return runs.filter(F.col("n") * frame_ms >= min_ms).select(item, (F.col("a") * frame_ms).alias("from_ms"), ((F.col("a") + F.col("n")) * frame_ms).alias("to_ms"))


def level_summary(frames: DataFrame, runs: DataFrame, item: str, frame_ms: int) -> DataFrame:
    """Silence share (three places), peak and power-mean level of each item."""
    levels = frames.groupBy(item).agg(F.count("*").alias("n"), F.max("level_db").alias("peak_db"), (10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("level_db") / 10)))).alias("mean_db"))
    silent = runs.groupBy(item).agg(F.sum(F.col("to_ms") - F.col("from_ms")).alias("silent_ms"))
    share = F.round(F.least(F.lit(1.0), F.coalesce("silent_ms", F.lit(0)) / (F.col("n") * frame_ms)), 3)
    return levels.join(silent, item, "left").select(item, share.alias("silence_share"), "peak_db", "mean_db")


def audio_flags(m: DataFrame, silence_limit: float = 0.30, clip_peak_db: float = -0.5, low_mean_db: float = -34.0) -> DataFrame:
    """Quality flags with their note."""
    peak, mean, share = F.col("peak_db"), F.col("mean_db"), F.col("silence_share")
    flags = F.array_compact(F.array(
        F.when(share > silence_limit, F.concat(F.format_string("%.0f", share * 100), F.lit("% silence"))), F.when(peak >= clip_peak_db, F.format_string("clipped peaks (%.1f dBFS)", peak)),
        F.when(mean < low_mean_db, F.format_string("very quiet (%.1f dB mean)", mean)), F.when((peak - mean < 6.0) & (mean < -20.0), F.lit("speech barely above noise floor")),
    ))
    out = m.withColumn("flags", flags)
    return out.withColumns({"ok": F.size("flags") == 0, "note": F.when(F.size("flags") == 0, "audio ok").otherwise(F.array_join("flags", "; "))})


def _complement(spans: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """The gaps between spans a..b of a group within low..high, and the tail."""
    w = Window.partitionBy(*keys).orderBy("a", "b")
    cursor = F.greatest(F.col(low), F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col(low)))
    gaps = spans.select(*keys, cursor.alias("from_ms"), F.col("a").alias("to_ms")).filter("to_ms > from_ms")
    tails = spans.groupBy(*keys).agg(F.greatest(F.max(low), F.max("b")).alias("from_ms"), F.max(high).alias("to_ms")).filter("to_ms > from_ms")
    return gaps.unionByName(tails)


def keep_ranges(items: DataFrame, cuts: DataFrame, keys: list[str], least_ms: int = 50) -> DataFrame:
    """Trim and cuts -> the ranges kept. items: keys, duration_ms, trim_from, trim_to; cuts: keys, a, b. Slivers of
    least_ms or less are no cuts; where cuts leave nothing, all is kept; a trim under 0.2 s is none."""
    t0, t1 = F.greatest(F.lit(0), F.coalesce("trim_from", F.lit(0))), F.least("duration_ms", F.coalesce("trim_to", "duration_ms"))
    ok = t1 - t0 >= 200
    x = items.select(*keys, F.when(ok, t0).otherwise(0).cast("long").alias("t0"), F.when(ok, t1).otherwise(F.col("duration_ms")).cast("long").alias("t1"))
    real = cuts.join(x, keys).withColumns({"a": F.greatest("t0", "a"), "b": F.least("t1", "b")}).filter(F.col("b") - F.col("a") > least_ms)
    kept = _complement(real.select(*keys, "a", "b", "t0", "t1"), keys, "t0", "t1")
    whole = x.join(kept.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("t0").alias("from_ms"), F.col("t1").alias("to_ms"))
    return kept.unionByName(whole)


def silence_keeps(items: DataFrame, silences: DataFrame, key: str, pad_ms: int = 250, min_ms: int = 250, per_minute: float = 4.0, least_share: float = 0.75) -> DataFrame:
    """Ranges kept when silences are cut with a pad on either side. Too many cuts a minute, or too little kept, means
    that speech would be cut: then all is kept. items: key, duration_ms; silences: key, from_ms, to_ms."""
    s = silences.join(items, key).select(key, "duration_ms", F.greatest(F.lit(0), "from_ms").alias("s"), F.least("duration_ms", "to_ms").alias("e"))
    w = Window.partitionBy(key).orderBy("s", "e")
    cursor = F.greatest(F.lit(0).cast("long"), F.coalesce(F.max(F.col("e") - pad_ms).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    mid = s.select(key, cursor.alias("from_ms"), F.least(F.col("s") + pad_ms, "duration_ms").alias("to_ms"))
    tail = s.groupBy(key).agg(F.greatest(F.lit(0).cast("long"), F.max(F.col("e") - pad_ms)).alias("from_ms"), F.max("duration_ms").alias("to_ms"))
    parts = mid.unionByName(tail).filter(F.col("to_ms") - F.col("from_ms") > min_ms)
    sums = parts.groupBy(key).agg((F.count("*") - 1).alias("cuts"), F.sum(F.col("to_ms") - F.col("from_ms")).alias("kept"))
    good = sums.join(items, key).filter((F.col("cuts") <= F.greatest(F.lit(1.0), F.col("duration_ms") / 60_000 * per_minute)) & (F.col("kept") >= F.col("duration_ms") * least_share)).select(key)
    whole = items.join(good, key, "left_anti").select(key, F.lit(0).cast("long").alias("from_ms"), F.col("duration_ms").alias("to_ms"))
    return parts.join(good, key, "left_semi").unionByName(whole)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def level_profile(pixels: DataFrame, item: str) -> DataFrame:
    """Exact percentiles, mean and population deviation of luma, channel means, and the colour cast of what is brighter
    than the 80th percentile (red minus blue). Percentiles are narrowed down by counts, so an item may have any number of
    pixels."""
    y = pixels.withColumn("y", F.round(luma(F.col("r"), F.col("g"), F.col("b")), 6))
    quantiles = written(exact_quantiles(y, item, "y", [0.01, 0.8, 0.99]).select(item, F.col("q")[0].alias("black"), F.col("q")[1].alias("p80"), F.col("q")[2].alias("white")))
    bright = F.col("y") > F.col("p80")
    one = y.join(quantiles, item).groupBy(item, "black", "p80", "white").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("contrast"), *[F.avg(c).alias(f"mean_{c}") for c in "rgb"], (F.avg(F.when(bright, F.col("r"))) - F.avg(F.when(bright, F.col("b")))).alias("cast"))
    return one.select(item, "black", "p80", "white", "mean", "contrast", "mean_r", "mean_g", "mean_b", F.coalesce("cast", F.lit(0.0)).alias("cast"))


def within(m: dict[str, tuple[float, float]]) -> Column:
    """Whether all measures lie in their ranges."""
    out = F.lit(True)
    for name, (low, high) in m.items():
        out = out & F.col(name).between(low, high)
    return out


def frame_boxes(boxes: DataFrame) -> DataFrame:
    """Per clip and frame: span and midpoint of all boxes, the tallest one's centre, eye line and height, boxes."""
    return boxes.groupBy("clip", "t").agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"), F.max_by(F.struct((F.col("x") + F.col("w") / 2).alias("cx"), "h", (F.col("y") + F.col("h") * 0.42).alias("eye")), F.struct("h", "x", "w", "y")).alias("big"), F.count("*").alias("n")).select("clip", "t", "left", "right", (F.col("right") - F.col("left")).alias("span"), ((F.col("left") + F.col("right")) / 2).alias("mid"), F.col("big.cx").alias("cx"), F.col("big.eye").alias("eye"), F.col("big.h").alias("big_h"), "n")


def track_decision(frames: DataFrame, width: float, height: float, crop_share: float) -> DataFrame:
    """Whether all faces fit the crop on average, and the crop's share of the frame's height: 5.5 times the mean share that
    the tallest face has of it (0.02 at least), within 0.34 and 1."""
    mean, face = F.avg("span") / width, F.greatest(F.lit(0.02), F.avg("big_h") / height)
    return frames.groupBy("clip").agg((mean < crop_share * 0.9).alias("both_fit"), clamp(face * 5.5, 0.34, 1.0).alias("crop"))


def centred(frames: DataFrame, width: float, crop_share: float) -> DataFrame:
    """Frames with the place to centre on: the midpoint where all faces of the clip fit the crop, else the tallest face."""
    fit = F.avg("span").over(Window.partitionBy("clip")) / width < crop_share * 0.9
    return frames.withColumn("centre", F.when(fit, F.col("mid")).otherwise(F.col("cx")))


# What a good voice recording measures.
SEPARATION, TILT, CREST = 52.0, (0.28, 0.52), 14.0


def voice_treatment(separation: Column, tilt: Column, crest: Column) -> dict[str, Column]:
    """Measurements -> how much to denoise, lift, de-ess and warm, and whether to compress."""
    short = SEPARATION - separation
    low, high = TILT
    return {
        "denoise": F.when(short > 2, clamp(short / 22.0, 0.0, 0.85)).otherwise(0.0),
        "presence": F.when(tilt < low, clamp((low - tilt) * 22.0, 0.0, 4.0)).when(tilt > high, 0.0).otherwise(1.0),
        "deess": F.when(tilt < low, 0.0).when(tilt > high, clamp((tilt - high) * 2.0, 0.0, 0.6)).otherwise(0.25),
        "warmth": F.when(tilt < 0.45, -3.0).otherwise(-1.5), "compress": crest > CREST,
    }


def voice_measures(peak_db: Column, rms_db: Column, floor_db: Column, high_db: Column, low_db: Column) -> dict[str, Column]:
    """Separation, crest and the high band's share of both bands' amplitude, from levels in dB; 0.4 where a band has none."""
    amp = lambda db: F.pow(F.lit(10.0), db / 20)
    share = amp(high_db) / F.greatest(amp(low_db) + amp(high_db), F.lit(1e-9))
    return {"separation": peak_db - floor_db, "crest": peak_db - rms_db, "tilt": F.coalesce(share, F.lit(0.4))}


def log_measurements(log: Column, duration_s: Column) -> dict[str, Column]:
    """From a tool's log: the sum of silences, the last peak, the last block of JSON that holds a loudness, and the
    silences as pairs of start and end within 0..duration. A start may be negative; one without an end lasts to the end."""
    numbers = lambda pattern: F.transform(F.regexp_extract_all(log, F.lit(pattern), F.lit(1)), lambda x: x.cast("double"))
    block = F.try_element_at(F.regexp_extract_all(log, F.lit(r"(\{[^{}]*input_i[^{}]*\})"), F.lit(1)), F.lit(-1))
    starts, ends = numbers(r"silence_start:\s*(-?[0-9.]+)"), numbers(r"silence_end:\s*([0-9.]+)")
    pairs = F.transform(starts, lambda a, i: F.struct(F.greatest(F.lit(0.0), a).alias("a"), F.least(duration_s, F.coalesce(F.get(ends, i), duration_s)).alias("b")))
    return {
        "silent_s": F.aggregate(numbers(r"silence_duration: ([0-9.]+)"), F.lit(0.0), lambda a, x: a + x), "peak_db": F.try_element_at(numbers(r"max_volume: (-?[0-9.]+) dB"), F.lit(-1)),
        "lufs": F.get_json_object(block, "$.input_i").try_cast("double"), "pairs": pairs,
    }


def described(parts: list[tuple[Column, Column]]) -> Column:
    """What holds, in words, with commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(cond, text) for cond, text in parts])), ", ")
