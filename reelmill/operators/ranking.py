"""Scoring replies, floors, diversified selection, shortlists and captions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


class Scorer(Protocol):
    """Gives candidates a score: any function from candidates to replies."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...


def reply_scorer(replies: DataFrame, keys: list[str]) -> Scorer:
    """Scores from a table of replies; of several for a candidate, the last of the last batch wins."""
    return lambda candidates: candidates.join(last_replies(replies, keys), keys)


def rule_scorer(aha: float = 30, recital: float = 25, complete: float = 15) -> Scorer:
    """A score from the cue flags alone."""

    def score(candidates: DataFrame) -> DataFrame:
        total = F.lit(40) + F.when(F.col("has_aha"), aha).otherwise(0) + F.when(F.col("has_recital"), recital).otherwise(0)
        return candidates.withColumn("score", F.least(F.lit(100), total + complete).cast("long"))

    return score


def python_scorer(schema: str, task: Callable) -> Scorer:
    """A caller's own scorer over batches of rows."""
    return lambda candidates: candidates.mapInPandas(task, schema)


def arrow_scorer(score: Callable[[pa.RecordBatch], pa.Array], kind: str = "double", name: str = "score") -> Scorer:
    """A caller's scorer over Arrow batches: candidates with its column and an error column. What it returns must have a
    value a row and be of the declared kind, else the job fails, as the scorer is wrong. If it raises, the batch is
    halved until what raises is a row, which gets no score but the error's text; rows that raise are cheaper if they lie together."""

    def scorer(candidates: DataFrame) -> DataFrame:
        schema = T.StructType([*candidates.drop(name, "error").schema.fields, T.StructField(name, T._parse_datatype_string(kind)), T.StructField("error", T.StringType())])
        wanted = to_arrow_type(schema[name].dataType)

        def checked(part: pa.RecordBatch) -> pa.Array:
            out = score(part)
            if not isinstance(out, pa.Array) or len(out) != part.num_rows or out.type != wanted:
                raise TypeError(f"the scorer must return {part.num_rows} values of {wanted}, not {type(out).__name__} of {getattr(out, 'type', None)}, {len(out)} long")
            return out

        def scored(part: pa.RecordBatch) -> list[tuple[pa.Array, pa.Array]]:
            try:
                return [(checked(part), pa.nulls(part.num_rows, pa.string()))]
            except TypeError:
                raise
            except Exception as e:  # noqa: BLE001 - any failure of the caller's code is a row's
                if part.num_rows <= 1:
                    return [(pa.nulls(part.num_rows, wanted), pa.array([f"{type(e).__name__}: {e}"[:300]] * part.num_rows, pa.string()))]
            half = part.num_rows // 2
            return scored(part.slice(0, half)) + scored(part.slice(half))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, errors = (pa.concat_arrays(x) for x in zip(*scored(batch)))
                yield pa.RecordBatch.from_arrays([*batch.columns, out, errors], [*batch.schema.names, name, "error"])

        return candidates.drop(name, "error").mapInArrow(task, schema)

    return scorer


def last_replies(replies: DataFrame, keys: list[str], order: tuple[str, ...] = ("batch", "pos")) -> DataFrame:
    """The last reply of each candidate by batch and place in it."""
    rest = [c for c in replies.columns if c not in (*keys, *order)]
    return replies.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def passing(replies: DataFrame, floor: int = 45) -> DataFrame:
    """Score at least floor (what is no number is 0), and not marked as an incomplete thought."""
    score = F.coalesce(F.col("score").cast("string").try_cast("double"), F.lit(0.0)).cast("long")
    return replies.withColumn("score", score).filter((F.col("score") >= floor) & F.coalesce("complete_thought", F.lit(True)))


def profiles_of(profile: Column, known: tuple[str, ...] = ("A", "B")) -> Column:
    """BOTH stands for every profile, an unknown one for the first. To be exploded."""
    p = F.upper(F.trim(profile))
    return F.when(p == "BOTH", F.array(*[F.lit(k) for k in known])).when(p.isin(*known), F.array(p)).otherwise(F.array(F.lit(known[0])))


def in_batches(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """Contiguous batches of ceil(n / k) rows, k the lesser of n and most; the last may be short or missing."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(key))
    size = F.ceil(n / F.least(F.lit(most), n))
    return rows.withColumn("batch_no", F.floor((rn - 1) / size).cast("long"))


def diversified(rows: DataFrame, key: str, ids: list[str], limit: int = 60, per_bucket: int = 4, per_topic: int = 3, bucket_ms: int = 300_000) -> DataFrame:
    """The best by score with at most per_bucket of a stretch of time and per_topic of a structure; if that leaves the
    list short, the rest fills it in rounds over the stretches. rank is the place in the list. Rows need score,
    start_ms, end_ms, structure; ties go by time."""
    item = "struct<neg:bigint,start_ms:bigint,end_ms:bigint,b:bigint,topic:string," + ",".join(f"{i}:bigint" for i in ids if i not in ("start_ms", "end_ms")) + ">"
    extra = [F.col(i).cast("long").alias(i) for i in ids if i not in ("start_ms", "end_ms")]
    one = F.struct((-F.col("score")).cast("long").alias("neg"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.floor(F.col("start_ms") / bucket_ms).cast("long").alias("b"), F.lower(F.coalesce(F.nullif(F.col("structure"), F.lit("")), F.lit("other"))).alias("topic"), *extra)
    empty = F.array().cast(f"array<struct<i:int,c:{item}>>")
    # the fold holds what is chosen alone, so its arrays stay short; the rest is told by its places
    def step(chosen: Column, x: Column) -> Column:
        of = lambda name: F.size(F.filter(chosen, lambda k: k["c"][name] == x["c"][name]))
        refused = (F.size(chosen) >= limit) | (of("b") >= per_bucket) | (of("topic") >= per_topic)
        return F.when(refused, chosen).otherwise(F.concat(chosen, F.array(x)))

    items = F.transform(F.sort_array(F.collect_list(one)), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    folded = rows.groupBy(key).agg(items.alias("items"), F.transform(F.aggregate(items, empty, step), lambda x: x["i"]).alias("chosen"))
    n = F.size("chosen")
    each = folded.select(key, "chosen", F.explode("items").alias("x")).select(key, n.alias("n"), F.array_position("chosen", F.col("x.i")).alias("at"), "x.i", "x.c")
    each = each.where((F.col("at") > 0) | (F.col("n") < limit)).withColumn("picked", F.col("at") > 0)
    each = each.withColumn("turn", F.row_number().over(Window.partitionBy(key, "picked", "c.b").orderBy("i")))
    place = F.row_number().over(Window.partitionBy(key, "picked").orderBy("turn", "c.b"))
    out = each.withColumn("rank", F.when(F.col("picked"), F.col("at")).otherwise(F.col("n") + place).cast("long")).where(F.col("rank") <= limit)
    return out.select(key, "rank", *[F.col(f"c.{i}").alias(i) for i in ids], (-F.col("c.neg")).alias("score"), F.col("c.topic").alias("structure"))


def top_k(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def shortlisted(pool: DataFrame, picks: DataFrame, key: str, ids: list[str], keep: int) -> DataFrame:
    """Picked rows of the pool in the picks' order, at most keep; where a group's picks hit nothing, its best keep by
    rank. picks: key, ids, pick_order, why."""
    group = Window.partitionBy(key)
    both = pool.join(picks.withColumn("__hit", F.lit(True)), [key, *ids], "left").withColumn("__any", F.max("__hit").over(group))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.col("__hit").asc_nulls_last(), "pick_order")).cast("long")
    placed = both.withColumn("place", F.when(F.col("__any").isNull(), F.col("rank")).otherwise(turn))
    return placed.filter((F.col("place") <= keep) & (F.col("__hit").isNotNull() | F.col("__any").isNull())).select(key, *ids, "score", "place", "why")


def with_captions(clips: DataFrame, captions: DataFrame, keys: list[str]) -> DataFrame:
    """Clips with their caption copy; without one, the ranking's hook and blanks. At most eight hashtags."""
    out = clips.join(captions.withColumnRenamed("hook", "caption_hook"), keys, "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    return out.withColumns({
        "hook": F.trim(F.coalesce(F.nullif(F.trim("caption_hook"), F.lit("")), F.col("hook"), F.lit(""))), "caption": blank("caption"),
        "hashtags": F.slice(F.coalesce("hashtags", F.array().cast("array<string>")), 1, 8), "review_verdict": F.upper(blank("review_verdict")), "decision": F.lit("pending"),
    }).drop("caption_hook")


def batch_payload(rows: DataFrame, key: str, batch: str, order: list[str], line: Column) -> DataFrame:
    """One text a batch: its rows' lines in order."""
    got = rows.groupBy(key, batch).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("x"))
    return got.select(key, batch, F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("payload"))
