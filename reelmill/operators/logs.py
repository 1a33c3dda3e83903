"""Call usage, uploads, files, retention, publishing and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import age_hours


def usage_rollup(calls: DataFrame, by: str = "job") -> DataFrame:
    """Successful calls: count, cost, tokens in (with those that a cache took or gave) and out; failed attempts beside them."""
    ok = F.col("ok")
    total = lambda c: F.sum(F.when(ok, F.coalesce(c, F.lit(0))).otherwise(0))
    return calls.groupBy(by).agg(F.count_if(ok).alias("calls"), total(F.col("cost_usd")).alias("cost_usd"), (total(F.col("tok_in")) + total(F.col("cache_create")) + total(F.col("cache_read"))).alias("tok_in"), total(F.col("tok_out")).alias("tok_out"), F.count_if(~ok).alias("failed"))


def call_reliability(calls: DataFrame, by: str = "label", wall: str | None = None) -> DataFrame:
    """Calls, failures, most attempts and, under its own name, the sum of the column wall."""
    out = [F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.max("attempt").alias("most_attempts")]
    return calls.groupBy(by).agg(*out, *([F.sum(wall).alias(wall)] if wall else []))


def retry_chains(calls: DataFrame, keys: list[str], order: list[str], wall: str = "wall_ms") -> DataFrame:
    """Attempts of one call as chains: keys, chain (from 0), attempts, ok, last_error (of the last failure), given_up, and
    the sum of the column wall. A first attempt, or what follows a success, begins one. calls: keys, order, attempt, ok,
    error, wall; a null ok is a failure."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ok = F.coalesce("ok", F.lit(False))
    begins = (F.col("attempt") == 1) | F.coalesce(F.lag(ok).over(w), F.lit(True))
    x = calls.withColumn("chain", (F.sum(F.coalesce(begins, F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    done = F.max(ok)
    return x.groupBy(*keys, "chain").agg(F.count("*").alias("attempts"), done.alias("ok"), F.max_by(F.when(~ok, F.col("error")), F.when(~ok, F.struct(*order))).alias("last_error"), (~done).alias("given_up"), F.sum(wall).alias(wall))


def abandoned_uploads(uploads: DataFrame, received: DataFrame, now: Column, hours: float = 48) -> DataFrame:
    """Uploads older than some hours that are not complete. uploads: upload_id, created_at, total_chunks; received:
    upload_id, idx. One without a time of creation is left alone."""
    old = uploads.filter(F.col("created_at").isNotNull() & (age_hours(now, F.col("created_at")) > hours))
    have = received.groupBy("upload_id").agg(F.count_distinct("idx").alias("received"))
    out = old.join(have, "upload_id", "left").withColumn("received", F.coalesce("received", F.lit(0)))
    return out.filter(F.col("received") < F.col("total_chunks")).select("upload_id", "created_at", "received", "total_chunks")


def missing_chunks(uploads: DataFrame, received: DataFrame) -> DataFrame:
    """Chunks of each upload that have not come, of which there may be all. uploads: upload_id, total_chunks; received:
    upload_id, idx."""
    wanted = uploads.groupBy("upload_id").agg(F.max("total_chunks").alias("n")).filter("n > 0").select("upload_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx"))
    return wanted.join(received.select("upload_id", "idx"), ["upload_id", "idx"], "left_anti")


def storage_usage(files: DataFrame) -> DataFrame:
    return files.groupBy("area").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), (F.sum("length") / 1e9).alias("gb"))


def retention_report(files: DataFrame, approved: DataFrame, now: Column, source_hours: float, group_hours: float, is_source: Column) -> DataFrame:
    """What a sweep would free: sources over their age, and areas (groups) all of whose files are over theirs and none
    approved. approved: name. Nothing is deleted."""
    aged = files.withColumn("age_h", age_hours(now, F.col("mtime")))
    sources = aged.filter(is_source & (F.col("age_h") > source_hours)).select(F.lit("source").alias("kind"), F.col("name"), "length")
    rest = aged.filter(~is_source)
    held = rest.join(approved.select("name").distinct(), "name", "left_semi").select("area").distinct()
    groups = rest.groupBy("area").agg(F.min("age_h").alias("age_h"), F.sum("length").alias("length")).filter(F.col("age_h") > group_hours).join(held, "area", "left_anti")
    return sources.unionByName(groups.select(F.lit("group").alias("kind"), F.col("area").alias("name"), "length"))


def with_transcript(uploads: DataFrame, names: DataFrame, suffix: str) -> DataFrame:
    """Whether a file whose name begins with the upload's stem and ends in suffix exists. Each such name stands for all its
    beginnings, of which a file name has few, so that the join is on equal keys."""
    size = F.length("name") - len(suffix)
    have = names.filter(F.col("name").endswith(suffix) & (size > 0)).select(F.explode(F.transform(F.sequence(F.lit(1), size), lambda n: F.substring(F.col("name"), F.lit(1), n))).alias("__stem")).distinct().withColumn("has_transcript", F.lit(True))
    return uploads.withColumn("__stem", F.regexp_replace("name", r"\.[^.]*$", "")).join(have, "__stem", "left").drop("__stem").withColumn("has_transcript", F.coalesce("has_transcript", F.lit(False)))


def publish_fault(path: Column, size: Column, duration_s: Column, max_mb: float = 100, min_s: float = 3, max_s: float = 900) -> Column:
    """The first reason why a clip can't be published, or null: none rendered, its file gone, too large, a source upload
    rather than a clip, too short or long."""
    mb = size / 1_048_576
    has = duration_s.isNotNull() & (duration_s != 0)
    return F.coalesce(F.when(F.coalesce(path, F.lit("")) == "", "no file"), F.when(size.isNull(), "missing"), F.when(mb > max_mb, "too large"), F.when(path.rlike(r"(^|[/\\\\])uploads[/\\\\]"), "source upload"), F.when(has & (duration_s < min_s), "too short"), F.when(has & (duration_s > max_s), "too long"))


def file_fault(name: Column, size: Column, width: Column, height: Column, duration_s: Column, max_s: float = 90) -> Column:
    """The first reason why a file can't be an outro, or null."""
    return F.coalesce(F.when(~F.lower(name).rlike(r"\.(mp4|mov|mkv|m4v|webm|avi)$"), "suffix"), F.when(F.coalesce(size, F.lit(0)) <= 0, "empty"), F.when(duration_s > max_s, "too long"), F.when((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0), "dimensions"))


def scope_eta(clips: DataFrame, key: str, duration_s: Column, speed: float = 1.80) -> DataFrame:
    """Clips in each scope and minutes to render all; a missing or zero duration counts as 60 s. Durations are summed as
    decimals, since sums of doubles depend on their order and minutes that end in a half are rounded to even ones."""
    total = F.sum(F.coalesce(F.nullif(duration_s, F.lit(0)), F.lit(60)).cast("decimal(28,6)")).cast("double")
    return clips.groupBy(key).agg(F.count("*").alias("all"), F.count_if(F.col("decision") != "rejected").alias("keeping"), F.count_if(F.col("decision") == "approved").alias("approved"), F.greatest(F.lit(1.0), F.bround(total / speed / 60)).cast("long").alias("eta_minutes"))


def relook_plan(eta: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """scope_eta() rows with the recording's source file, and whether there still is one, so that nothing is encoded twice.
    sources: key, source."""
    one = sources.groupBy(key).agg(F.min("source").alias("source"))
    return eta.join(one, key, "left").withColumn("lossless", F.col("source").isNotNull())


def review_tallies(clips: DataFrame, key: str, states: list[str]) -> DataFrame:
    return clips.groupBy(key).pivot("decision", states).agg(F.count(F.lit(1))).na.fill(0)


def latest_with_clips(recordings: DataFrame, clips: DataFrame, by: str, first: int = 12) -> DataFrame:
    """The newest recording of a group that has clips, and a line for each of its first clips. recordings: by, id,
    created_at; clips: id, rank, line."""
    have = recordings.join(clips.select("id").distinct(), "id", "left_semi").groupBy(by).agg(F.max(F.struct("created_at", "id")).alias("r")).select(by, F.col("r.id").alias("id"))
    return have.join(clips.filter(F.col("rank") <= first), "id").groupBy(by, "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("summary"))


def oldest_queued(recordings: DataFrame, by: str) -> DataFrame:
    return recordings.filter("status = 'queued'").groupBy(by).agg(F.min(F.struct("created_at", "id")).alias("r")).select(by, F.col("r.id").alias("id"))


def newest_first(rows: DataFrame, by: str, ts: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ts))).cast("long")).filter(F.col("back") <= n)
