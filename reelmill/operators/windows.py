"""Candidate windows of recordings, words inside clips, and greedy overlap suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, has_any
from .order import written


def enumerate_windows(segments: DataFrame, key: str, start_ok: Column, end_ok: Column, min_ms: int, max_ms: int, stride: int = 1) -> DataFrame:
    """Every pair of a starting and an ending segment of one recording whose span lies in the band. start_ok and end_ok
    are conditions on segments. Ends must rise with seg.

    The join is on the recording and a time bucket of max_ms: a window's end lies in its start's bucket or the
    next, so a very long recording is dealt out over many tasks."""
    wide = F.lit(max_ms).cast("long")
    bucket = lambda c: F.floor(F.col(c) / wide)
    a = segments.filter(start_ok & (F.col("seg") % stride == 0)).select(key, F.col("seg").alias("seg_from"), "start_ms", F.explode(F.array(*[bucket("start_ms") + i for i in range(2)])).alias("__b"))
    b = segments.filter(end_ok).select(key, F.col("seg").alias("seg_to"), "end_ms", bucket("end_ms").alias("__b"))
    span = F.col("end_ms") - F.col("start_ms")
    return a.join(b, [key, "__b"]).filter((F.col("seg_to") >= F.col("seg_from")) & span.between(min_ms, max_ms)).select(key, "seg_from", "seg_to", "start_ms", "end_ms")


def spoken(segments: DataFrame, key: str) -> DataFrame:
    """Segments without blank ones, numbered anew."""
    some = segments.filter(collapsed(F.col("text")) != "")
    return some.withColumn("seg", (F.row_number().over(Window.partitionBy(key).orderBy("seg")) - 1).cast("long"))


SEGS = 1 << 24  #: segments that a recording may have


def with_text(windows: DataFrame, segments: DataFrame, key: str, max_ms: int) -> DataFrame:
    """Windows of at most max_ms with their joined text, since cues may cross a segment's edge. Segments are numbered one
    after another by their start, as spoken() does; several may begin at once, and then their numbers order them. A window
    collects the texts of the segments from its first one on that begin within max_ms, not those of the recording.
    Segments are dealt out by buckets of 20 max_ms, each with the beginning of the next, so a long recording is many
    tasks'. Windows are dealt out with them as rows in the same order, so each text is shuffled once, not once for every
    segment that it follows; a window and its first segment begin at the same time
    (windows without start_ms get it from there)."""
    wide = F.lit(20 * max_ms).cast("long")
    own = F.floor(F.col("start_ms") / wide)
    both = F.when(F.col("start_ms") - own * wide <= max_ms, F.array(own, own - 1)).otherwise(F.array(own))
    place = lambda seg: F.col("start_ms") * SEGS + F.col(seg)
    text = F.struct("seg", "text")
    dealt = segments.select(key, place("seg").alias("__place"), F.explode(both).alias("__b"), text.alias("__text"))
    placed = windows if "start_ms" in windows.columns else windows.join(segments.select(key, F.col("seg").alias("seg_from"), "start_ms"), [key, "seg_from"])
    asked = placed.select(key, place("seg_from").alias("__place"), own.alias("__b"), F.struct(*[c for c in windows.columns if c != key]).alias("__w"))
    ahead = F.collect_list("__text").over(Window.partitionBy(key, "__b").orderBy("__place").rangeBetween(0, max_ms * SEGS + SEGS - 1))
    told = asked.unionByName(dealt, allowMissingColumns=True).withColumn("__texts", ahead).where(F.col("__w").isNotNull())
    size = (F.col("__w.seg_to") - F.col("__w.seg_from") + 1).cast("int")
    mine = told.where(F.try_element_at("__texts", F.lit(1))["seg"] == F.col("__w.seg_from"))
    return mine.select(key, "__w.*", F.array_join(F.slice("__texts.text", F.lit(1), size), " ").alias("text"))


def flagged(windows: DataFrame, aha: Sequence[str], recital: Sequence[str]) -> DataFrame:
    """Cue flags; a recital counts as an aha."""
    return windows.withColumn("has_recital", has_any(F.col("text"), recital)).withColumn("has_aha", has_any(F.col("text"), aha) | F.col("has_recital"))


def in_islands(windows: DataFrame, key: str, grain_ms: int = 10_000) -> DataFrame:
    """windows with the number island: two windows of a recording that overlap have the same. A recording is cut at those
    multiples of grain_ms that no window crosses; what is counted along a recording is a row for each grain that any
    window touches."""
    grain = lambda c: F.floor(c / F.lit(grain_ms).cast("long"))
    first, last = grain(F.col("start_ms")), grain(F.greatest(F.col("start_ms"), F.col("end_ms") - 1))
    touched = windows.select(key, first.alias("__f"), F.explode(F.sequence(first, last)).alias("__g"))
    grains = touched.groupBy(key, "__g").agg(F.max((F.col("__g") > F.col("__f")).cast("int")).alias("crossed"))
    island = F.sum(1 - F.col("crossed")).over(Window.partitionBy(key).orderBy("__g").rowsBetween(Window.unboundedPreceding, 0))
    return windows.withColumn("__g", first).join(grains.select(key, "__g", island.alias("island")), [key, "__g"]).drop("__g")


def suppress_overlaps(windows: DataFrame, key: str, ratio: float = 0.85, cap: int = 320) -> DataFrame:
    """Greedy by priority (recital, aha, start, end): a window goes if it overlaps a kept one by more than ratio of the
    shorter span; at most cap are kept a recording. Windows of different islands cannot clash, so each island is folded by
    itself, in the JVM; what a recording keeps is then cut by priority, which is where one fold over it would have stopped."""
    kind = "array<struct<not_recital:boolean,not_aha:boolean,start_ms:bigint,end_ms:bigint,seg_from:bigint,seg_to:bigint>>"
    row = F.struct((~F.col("has_recital")).alias("not_recital"), (~F.col("has_aha")).alias("not_aha"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.col("seg_from").cast("long").alias("seg_from"), F.col("seg_to").cast("long").alias("seg_to"))

    def clash(k: Column, c: Column) -> Column:
        common = F.least(c["end_ms"], k["end_ms"]) - F.greatest(c["start_ms"], k["start_ms"])
        return common > F.lit(ratio) * F.least(c["end_ms"] - c["start_ms"], k["end_ms"] - k["start_ms"])

    def step(kept: Column, c: Column) -> Column:
        return F.when((F.size(kept) >= cap) | F.exists(kept, lambda k: clash(k, c)), kept).otherwise(F.concat(kept, F.array(c)))

    # narrow rows, written as they are read twice
    narrow = written(windows.select(key, "seg_from", "seg_to", "start_ms", "end_ms", "has_recital", "has_aha"))
    folded = in_islands(narrow, key).groupBy(key, "island").agg(F.aggregate(F.array_sort(F.collect_list(row)), F.array().cast(kind), step).alias("kept"))
    out = folded.select(key, F.explode("kept").alias("k"))
    out = out.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("k"))).where(F.col("__n") <= cap)
    return out.select(key, "k.seg_from", "k.seg_to", "k.start_ms", "k.end_ms", (~F.col("k.not_recital")).alias("has_recital"), (~F.col("k.not_aha")).alias("has_aha"))


def numbered(windows: DataFrame, key: str) -> DataFrame:
    """cid c000, c001, ... in time order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("start_ms", "end_ms")) - 1
    return windows.withColumn("cid", F.format_string("c%03d", place))


def words_in_clips(words: DataFrame, clips: DataFrame, key: str) -> DataFrame:
    """Words that touch a clip, ends included, rebased to its start; a start before the clip is 0. Joined on the
    recording and minute buckets, so that long recordings are dealt out."""
    minute = 60_000
    w = words.select(key, "pos", "w", F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"), F.explode(F.sequence(F.floor(F.col("start_ms") / minute), F.floor(F.col("end_ms") / minute))).alias("__m"))
    c = clips.withColumn("__m", F.explode(F.sequence(F.floor(F.col("start_ms") / minute), F.floor(F.col("end_ms") / minute))))
    hit = w.join(c, [key, "__m"]).filter((F.col("w_end") >= F.col("start_ms")) & (F.col("w_start") <= F.col("end_ms")))
    # a pair that shares two minutes counts in the first
    first = F.greatest(F.floor(F.col("w_start") / minute), F.floor(F.col("start_ms") / minute))
    keep = [c for c in clips.columns if c != key]
    return hit.filter(F.col("__m") == first).select(key, *keep, "pos", "w", F.greatest(F.lit(0).cast("long"), F.col("w_start") - F.col("start_ms")).alias("rel_start_ms"), (F.col("w_end") - F.col("start_ms")).alias("rel_end_ms"))


def words_by_clip(words: DataFrame, clips: DataFrame, key: str, max_ms: int) -> DataFrame:
    """words_in_clips() as one row a clip, for clips of at most max_ms (a longer one fails the job): words holds pos, w,
    rel_start_ms, rel_end_ms in order of pos. Clips that no word touches are left out.

    Words and clips are dealt out by buckets of 20 max_ms of a recording, with the beginning of the next one's words, so a
    word is shuffled once, not once for every clip that it lies in. Within, they are gathered by blocks of max_ms; a clip
    takes words of its own block, and of the next those that begin there."""
    wide = F.lit(max_ms).cast("long")
    block = lambda c: F.floor(c / wide)
    b = F.col("__b")
    touched = F.sequence(block(F.col("start_ms")), block(F.col("end_ms")))
    # times as a word's length and what its place does not tell: next to nothing once compressed, if words are alike
    size = F.col("end_ms") - F.col("start_ms")
    dealt = words.select(key, size.alias("__size"), (F.col("start_ms") - F.coalesce("pos", F.lit(0)) * size).alias("__skew"), "pos", "w", F.explode(touched).alias("__b"))
    buckets = F.when(F.pmod(b, F.lit(20)) == 0, F.array(F.floor(b / 20), F.floor(b / 20) - 1)).otherwise(F.array(F.floor(b / 20)))
    dealt = dealt.select(key, F.explode(buckets).alias("__bucket"), "__b", "__size", "__skew", "pos", "w")
    fits = F.when(F.col("end_ms") - F.col("start_ms") > max_ms, F.raise_error(F.lit(f"a clip is longer than {max_ms} ms")).cast("long")).otherwise(block(F.col("start_ms")))
    asked = clips.select(key, fits.alias("__b"), F.struct(*[c for c in clips.columns if c != key]).alias("__c")).withColumn("__bucket", F.floor(b / 20))
    both = dealt.unionByName(asked, allowMissingColumns=True).repartition(key, "__bucket")
    start = F.col("__skew") + F.coalesce("pos", F.lit(0)) * F.col("__size")
    word = F.when(F.col("__c").isNull(), F.struct("pos", "w", start.alias("start_ms"), (start + F.col("__size")).alias("end_ms")))
    blocks = both.groupBy(key, "__bucket", "__b").agg(F.collect_list(word).alias("__words"), F.collect_list("__c").alias("__clips"))
    following = Window.partitionBy(key, "__bucket").orderBy("__b")
    after = F.when(F.lead("__b").over(following) == b + 1, F.lead("__words").over(following))
    blocks = blocks.withColumn("__after", after).where(F.size("__clips") > 0)
    blocks = blocks.withColumn("__words", F.concat("__words", F.filter(F.coalesce("__after", F.array()), lambda x: block(x["start_ms"]) == b + 1)))
    start, end = F.col("__c.start_ms"), F.col("__c.end_ms")
    inside = lambda x: (x["end_ms"] >= start) & (x["start_ms"] <= end)
    each = blocks.select(key, "__words", F.explode("__clips").alias("__c")).where(F.exists("__words", inside))
    mine = F.sort_array(F.filter("__words", inside))
    rebased = F.transform(mine, lambda x: F.struct(x["pos"].alias("pos"), x["w"].alias("w"), F.greatest(F.lit(0).cast("long"), x["start_ms"] - start).alias("rel_start_ms"), (x["end_ms"] - start).alias("rel_end_ms")))
    return each.select(key, "__c.*", rebased.alias("words"))
