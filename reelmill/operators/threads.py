"""Threads and turns, context packs, and recovery of JSON from replies."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import mentions, token_estimate, unfenced

DECODER = json.JSONDecoder()

# Words that tell what a message is about.
RULES_WORDS = "rank|ranking|score|scoring|framework|rule|taste|style|voice|caption|hook|hashtag|profile|brand|trainer|raw|punch[- ]?in|zoom|edit|editing|length|clip|silence|crop|fram(e|ing)|prefer|instead|stop|start"
JOB_WORDS = "job|clip|ranked|list|verdict|flag|render|last run|batch"
TUNE_WORDS = "reject|rejected|tune|feedback|why did|keeps? (doing|picking)|wrong"


def thread_summary(turns: DataFrame, thread: str = "conv_id") -> DataFrame:
    return turns.groupBy(thread).agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.sum(token_estimate(F.col("text"))).alias("tokens"))


def last_turns(turns: DataFrame, n: int, thread: str = "conv_id") -> DataFrame:
    back = F.row_number().over(Window.partitionBy(thread).orderBy(F.desc("turn")))
    return turns.withColumn("back", back.cast("long")).filter(F.col("back") <= n)


def intent_flags(text: Column) -> dict[str, Column]:
    return {"wants_rules": mentions(text, RULES_WORDS), "wants_job": mentions(text, JOB_WORDS), "wants_tune": mentions(text, TUNE_WORDS)}


def compaction(turns: DataFrame, after: int = 15, keep: int = 6, chars: int = 600, thread: str = "conv_id") -> DataFrame:
    """Threads with more than after turns: all but the last keep, each cut to chars, as one text to sum up."""
    w = Window.partitionBy(thread)
    x = turns.withColumns({"n": F.count("*").over(w), "back": F.row_number().over(w.orderBy(F.desc("turn")))}).filter((F.col("n") > after) & (F.col("back") > keep))
    line = F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, chars))
    return x.groupBy(thread).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda t: t["l"]), "\n").alias("digest_input"), F.count("*").alias("old_turns"))


def context_pack(parts: list[tuple[str, Column, Column]]) -> dict[str, Column]:
    """(name, condition, text) -> the pack of the sections whose condition holds and whose text isn't blank, what was
    loaded, and its estimated tokens."""
    use = [(n, c & (F.trim(F.coalesce(t, F.lit(""))) != ""), t) for n, c, t in parts]
    pack = F.array_join(F.array_compact(F.array(*[F.when(c, F.concat(F.lit(f"== {n.upper()} ==\n"), t)) for n, c, t in use])), "\n\n")
    return {"pack": pack, "loaded": F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c, _ in use])), ","), "tokens": token_estimate(pack)}


def first_json(text: str) -> str | None:
    """The JSON value that begins at the first brace of a text, else the one at its first bracket; null if neither is one."""
    for opener in "{[":
        at = text.find(opener)
        if at >= 0:
            with suppress(ValueError, RecursionError):
                return text[at : DECODER.raw_decode(text, at)[1]]
    return None


def recovered(replies: DataFrame, reply: str, schema: str) -> DataFrame:
    """Replies with their JSON as value (null: none), whether it parsed at once, and an error. Only what Spark's parser
    does not take goes to Python."""
    x = replies.withColumn("__t", unfenced(F.col(reply)))
    x = x.withColumn("__ok", F.try_parse_json("__t").isNotNull())
    good = x.filter("__ok").withColumn("__j", F.col("__t"))
    bad = x.filter("not __ok or __ok is null")
    out = T.StructType([*bad.schema.fields, T.StructField("__j", T.StringType())])

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["__j"] = [first_json(t or "") for t in part["__t"]]
            yield part

    both = good.unionByName(bad.mapInPandas(task, out))
    return both.withColumns({"value": F.from_json("__j", schema), "at_once": F.coalesce("__ok", F.lit(False)), "error": F.when(F.col("__j").isNull(), "no parseable JSON")}).drop("__t", "__ok", "__j")
