"""Posting slots, interleaving, the calendar and its warnings, and clip state from review events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slot_grid(channels: DataFrame, times: list[str], weekdays: list[int], cap: int, gap_hours: float, days_ahead: int, start: str = "start", now: str = "now") -> DataFrame:
    """Slots of each channel: its times on allowed weekdays (0 Monday) for days_ahead+1 days from start, later than now,
    at most cap a day, and at least gap_hours after the last slot that was given. channels: channel, start, now."""
    seconds = sorted(int(h) * 3600 + int(m or 0) * 60 for h, _, m in (t.partition(":") for t in times))
    day0 = F.datediff(F.to_date(F.col(start)), F.lit("1970-01-01").cast("date")).cast("long")
    x = channels.select("channel", day0.alias("d0"), F.unix_timestamp(F.col(now).cast("timestamp")).alias("n"))
    days = F.filter(F.transform(F.sequence(F.lit(0), F.lit(days_ahead)), lambda i: F.col("d0") + i), lambda dd: ((dd + 3) % 7).isin(*weekdays))
    every = F.flatten(F.transform(days, lambda dd: F.array(*[dd * 86400 + s for s in seconds])))
    gap = int(gap_hours * 3600)

    def step(out: Column, t: Column) -> Column:
        used = F.size(F.filter(out, lambda o: F.floor(o / 86400) == F.floor(t / 86400)))
        ok = (used < cap) & (t > F.col("n")) & ((F.size(out) == 0) | (t - F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0).cast("long")) >= gap))
        return F.when(ok, F.concat(out, F.array(t))).otherwise(out)

    slots = F.aggregate(every, F.array().cast("array<bigint>"), step)
    return x.select("channel", F.explode(slots).alias("s")).select("channel", F.timestamp_seconds("s").cast("timestamp_ntz").alias("at"))


def interleaved(clips: DataFrame, channel: str, source: list[str], order: list[str]) -> DataFrame:
    """Sources take turns, each in its own order: place in the channel's queue."""
    turn = F.row_number().over(Window.partitionBy(channel, *source).orderBy(*order))
    return clips.withColumn("turn", turn).withColumn("place", F.row_number().over(Window.partitionBy(channel).orderBy("turn", *source)).cast("long")).drop("turn")


def placed(clips: DataFrame, slots: DataFrame, channel: str, source: list[str], order: list[str]) -> DataFrame:
    """Pinned clips keep their time; the others take the open slots in turn. scheduled_at is null where none is left."""
    x = clips.withColumn("__pinned", F.col("pinned_at").isNotNull())
    turn = F.row_number().over(Window.partitionBy(channel, "__pinned", *source).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(channel, "__pinned").orderBy("__turn", *source)).cast("long")
    x = x.withColumn("__turn", turn).withColumn("place", F.when(~F.col("__pinned"), place)).drop("__turn", "__pinned")
    taken = clips.filter("pinned_at is not null").select(channel, F.col("pinned_at").alias("at")).distinct()
    open_ = slots.join(taken, [channel, "at"], "left_anti").withColumn("place", F.row_number().over(Window.partitionBy(channel).orderBy("at")).cast("long"))
    return x.join(open_, [channel, "place"], "left").withColumn("scheduled_at", F.coalesce("pinned_at", "at")).drop("place", "at")


def calendar(slots: DataFrame, done: DataFrame, channel: str, ids: list[str], order: list[str]) -> DataFrame:
    """Every slot with its clip, if any; of two on one slot the later in order shows."""
    last = done.filter("scheduled_at is not null").groupBy(channel, F.col("scheduled_at").alias("at")).agg(F.max_by(F.struct(*ids), F.struct(*order)).alias("c"))
    return slots.join(last, [channel, "at"], "left").select(channel, "at", *[F.col(f"c.{i}").alias(i) for i in ids])


def adjacent_warnings(done: DataFrame, channel: str, source: str, order: list[str]) -> DataFrame:
    """Clips whose predecessor in the schedule has the same source."""
    w = Window.partitionBy(channel).orderBy("scheduled_at", *order)
    return done.filter("scheduled_at is not null").withColumn("before", F.lag(source).over(w)).filter(F.col("before") == F.col(source)).drop("before")


def queue_health(done: DataFrame, channel: str, per_day: int, slot_times: int) -> DataFrame:
    n = F.count("scheduled_at")
    note = F.lit(f"{per_day} a day allowed, {slot_times} slot times set" if per_day > slot_times else "")
    return done.groupBy(channel).agg(n.alias("queued"), (F.count("*") - n).alias("beyond_window"), F.round(n / max(per_day, 1), 1).alias("days_of_runway")).withColumn("note", note)


def calendar_days(cal: DataFrame, channel: str, label: Column) -> DataFrame:
    """Clips a day, the first three, and how many more."""
    got = cal.groupBy(channel, F.to_date("at").alias("day")).agg(F.count("*").alias("slots"), F.array_sort(F.collect_list(F.struct("at", label.alias("l")))).alias("x"))
    full = F.filter("x", lambda x: x["l"].isNotNull())
    return got.select(channel, "day", "slots", F.size(full).cast("long").alias("clips"), F.array_join(F.transform(F.slice(full, 1, 3), lambda x: x["l"]), ",").alias("first"), F.greatest(F.lit(0), F.size(full) - 3).cast("long").alias("more"))


def clip_state(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Review events -> current state. events: key, ts, decision, reason, note, pin, pinned (a pin event), posted.
    approved_at is the first approval after the last other decision; a null pin clears it; a reason stays only with a
    rejection."""
    decided = F.col("decision").isNotNull()
    reset = F.max(F.when(decided & (F.col("decision") != "approved"), F.col(ts))).over(Window.partitionBy(key))
    x = events.withColumn("__reset", reset)
    last = lambda c, when: F.max_by(c, F.when(when, F.col(ts)))
    return x.groupBy(key).agg(
        last("decision", decided).alias("decision"), last("reason", decided).alias("reason"), last("note", decided).alias("note"),
        F.min(F.when((F.col("decision") == "approved") & (F.col("__reset").isNull() | (F.col(ts) > F.col("__reset"))), F.col(ts))).alias("approved_at"),
        last("pin", F.col("pinned")).alias("pin"), F.coalesce(last("posted", F.col("posted").isNotNull()), F.lit(False)).alias("posted"),
    ).withColumns({"reason": F.when(F.col("decision") == "rejected", F.col("reason")), "note": F.when(F.col("decision") == "rejected", F.substring("note", 1, 500))})


def deck(clips: DataFrame, key: list[str], topic: Column, start_ms: Column, seed: int = 11) -> DataFrame:
    """Undecided clips in an order that keeps topic and five-minute stretch apart: each pair of them takes turns, by a
    hash of the clip and the seed, so the order is the same however the rows are partitioned."""
    bucket = F.floor(start_ms / 300_000)
    x = clips.withColumns({"topic": topic, "stretch": bucket, "h": F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))})
    turn = F.row_number().over(Window.partitionBy("channel", "topic", "stretch").orderBy("h", *key))
    x = x.withColumn("turn", turn)
    return x.withColumn("place", F.row_number().over(Window.partitionBy("channel").orderBy("turn", "topic", "stretch")).cast("long")).drop("turn", "h")
