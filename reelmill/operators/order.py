"""Long groups in order without a group in one task: smoothing over ranges, exact quantiles, both ends of a table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.streams import new_base

BINS = 1 << 16  #: of one round of exact_quantiles


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    path = f"{new_base(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SHORT = 256  #: points of a track that is folded in one row


def smoothed(points: DataFrame, key: str, order: str, value: str, alpha: float = 0.35, short: int = SHORT) -> DataFrame:
    """Exponential smoothing in order, seeded with the first value, and until when each value holds (null: to the end).
    Tracks of at most so many points are folded in a row each, in the JVM; longer ones are dealt out, see smoothed_long()."""
    x = written(points.select(key, order, F.col(value).cast("double").alias("x")))
    long = written(x.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > short).select(key))
    if long.isEmpty():
        return _folded(x, key, order, alpha)
    return _folded(x.join(long, key, "left_anti"), key, order, alpha).unionByName(smoothed_long(x.join(long, key, "left_semi"), key, order, "x", alpha))


def _folded(x: DataFrame, key: str, order: str, alpha: float) -> DataFrame:
    got = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "x"))).alias("p"))
    last = lambda xs: F.element_at(xs, -1)
    path = F.aggregate("p", F.array(F.col("p")[0]["x"]), lambda acc, q: F.concat(acc, F.array(last(acc) + alpha * (q["x"] - last(acc)))))
    rows = got.select(key, F.explode(F.arrays_zip(F.col("p"), F.slice(path, 2, F.size("p")).alias("s"), F.slice(F.col("p"), 2, F.size("p")).alias("after"))).alias("z"))
    return rows.select(key, F.col(f"z.p.{order}").alias(order), F.col("z.s").alias("smooth"), F.col(f"z.after.{order}").alias("until"))


def smoothed_long(points: DataFrame, key: str, order: str, value: str, alpha: float = 0.35) -> DataFrame:
    """smoothed() for tracks of any length.

    A step is a map s -> a s + alpha x with a = 1 - alpha, and n steps from another start differ by a**n times the starts'
    difference. So tracks are dealt out by ranges of key and order; each range smooths what it has of a track as if that
    began there, and only the track that goes on from the range before is moved by its share of the difference, which is
    known from each range's ends. No task holds a whole track, the work is linear, and a row a range comes to the driver."""
    x = points.select(key, order, F.col(value).cast("double").alias("x"))
    ranges = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = x.repartitionByRange(ranges, key, order).sortWithinPartitions(key, order, "x").withColumn("range_no", F.spark_partition_id())
    until = T.StructField("until", x.schema[order].dataType)
    schema = T.StructType([x.schema[key], x.schema[order], T.StructField("smooth", T.DoubleType()), until, T.StructField("range_no", T.IntegerType()), T.StructField("step", T.LongType()), T.StructField("head", T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = None  # the last row so far, which waits for the one behind it
        track, s, step, head = None, 0.0, 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            smooth, steps, heads = [], [], []
            for k, v in zip(batch.column(key).to_pylist(), batch.column("x").to_pylist()):
                if not step or k != track:
                    track, step, s, head = k, 0, v, v
                step += 1
                s += alpha * (v - s)
                smooth.append(s)
                steps.append(step)
                heads.append(head)
            part = pa.table([batch.column(key), batch.column(order), pa.array(smooth), batch.column("range_no"), pa.array(steps), pa.array(heads)], names=[key, order, "smooth", "range_no", "step", "head"])
            both = part if wait is None else pa.concat_tables([wait, part])
            wait = both.slice(both.num_rows - 1)
            if both.num_rows > 1:
                yield from _with_until(both).select(schema.names).to_batches()
        if wait is not None:
            yield from wait.append_column("until", pa.nulls(1, wait.schema.field(order).type)).select(schema.names).to_batches()

    def _with_until(both: pa.Table) -> pa.Table:
        """All rows but the last, with the order of the row behind if that is of the same track."""
        n = both.num_rows - 1
        goes_on = pc.greater(both.column("step").slice(1), 1)
        return both.slice(0, n).append_column("until", pc.if_else(goes_on, both.column(order).slice(1), pa.nulls(n, both.schema.field(order).type)))

    local = written(dealt.mapInArrow(task, schema))
    ends = local.groupBy("range_no").agg(F.min_by(F.struct(key, order, "head"), F.struct(key, "step")).alias("first"), F.max_by(F.struct(key, "step", "smooth"), F.struct(key, "step")).alias("last")).collect()
    moved, last, value_before = [], None, 0.0
    for r in sorted(ends):
        goes_on = last is not None and last["last"][key] == r["first"][key]
        by = value_before - r["first"]["head"] if goes_on else 0.0
        if goes_on:
            moved.append((r["range_no"], r["first"][key], by, None))
            moved.append((last["range_no"], r["first"][key], 0.0, r["first"][order]))
        alone = r["first"][key] == r["last"][key]
        value_before = r["last"]["smooth"] + (by * (1 - alpha) ** r["last"]["step"] if alone else 0.0)
        last = r
    if not moved:
        return local.select(key, order, "smooth", "until")
    ranges = local.sparkSession.createDataFrame(moved, T.StructType([T.StructField("range_no", T.IntegerType()), x.schema[key], T.StructField("by", T.DoubleType()), T.StructField("next", until.dataType)]))
    ranges = ranges.groupBy("range_no", key).agg(F.sum("by").alias("by"), F.max("next").alias("next"))
    joined = local.join(F.broadcast(ranges), ["range_no", key], "left")  # two rows a range at most
    return joined.select(key, order, (F.col("smooth") + F.coalesce(F.col("by") * F.pow(F.lit(1 - alpha), F.col("step")), F.lit(0.0))).alias("smooth"), F.coalesce("until", "next").alias("until"))


def exact_quantiles(rows: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """key and q, the exact quantiles of a double value (linear between neighbours) at the shares, nulls left out.

    The wanted ranks are narrowed down: the range that holds one is cut into BINS, which are counted (partly before the
    shuffle), and the bin with the rank gives the next range, of its own least and greatest value, until those are equal.
    So a group is never in one task, and what is shuffled is a row a bin. A round reads the rows once; each leaves under
    1/BINS of a range, so doubles need four or five and usual measurements two."""
    some = rows.select(key, F.col(value).cast("double").alias("v")).where("v is not null")
    ends = some.groupBy(key).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    parts = [F.struct(F.lit(i).alias("i"), F.lit(b).alias("upper"), F.least(F.floor(F.lit(s) * (F.col("n") - 1)) + b, F.col("n") - 1).alias("rank"), (F.lit(s) * (F.col("n") - 1) - F.floor(F.lit(s) * (F.col("n") - 1))).alias("part")) for i, s in enumerate(shares) for b in (0, 1)]
    open_ = written(ends.select(key, "lo", "hi", F.explode(F.array(*parts)).alias("w")).select(key, "lo", "hi", "w.*"))
    done = []
    while True:
        done.append(open_.where("lo = hi").select(key, "i", "upper", "part", F.col("lo").alias("v")))
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            break
        spans = open_.select(key, "lo", "hi").distinct()
        inside = some.join(spans, key).where(F.col("v").between(F.col("lo"), F.col("hi")))
        # halves, since a range of doubles may be wider than the greatest double
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bins = inside.groupBy(key, "lo", "hi", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy(key, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = open_.join(bins.withColumn("before", before), [key, "lo", "hi"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m")))
        open_ = written(hit.select(key, F.col("a").alias("lo"), F.col("b").alias("hi"), "i", "upper", (F.col("rank") - F.col("before")).alias("rank"), "part"))
    both = reduce(DataFrame.unionAll, done).groupBy(key, "i").agg(F.max(F.when(F.col("upper") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("upper") == 1, F.col("v"))).alias("high"), F.max("part").alias("part"))
    each = both.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("q")))).alias("x"))
    return each.select(key, F.transform("x", lambda x: x["q"]).alias("q"))


def two_ends(rows: DataFrame, place: Column, tie: list[str], n: int) -> DataFrame:
    """The n rows of the greatest place as side best, and of the least as side worst if there are more than n rows, in one
    pass over rows: each task keeps the n at its ends and counts the rest. tie: columns that order equal places, ascending
    for best and descending for worst. Nothing is run while the plan is built."""
    x = rows.withColumn("__place", place)
    schema = T.StructType([*x.schema.fields, T.StructField("__side", T.StringType()), T.StructField("__rows", T.LongType())])
    orders = {"best": [("__place", "descending"), *((t, "ascending") for t in tie)], "worst": [("__place", "ascending"), *((t, "descending") for t in tie)]}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, count = {}, 0
        for batch in batches:
            part = pa.Table.from_batches([batch])
            count += part.num_rows
            for side, order in orders.items():
                both = pa.concat_tables([ends[side], part]) if side in ends else part
                ends[side] = both.take(pc.sort_indices(both, sort_keys=order)[:n])
        for k, (side, kept) in enumerate(ends.items()):
            told = [count if k == 0 and i == 0 else 0 for i in range(kept.num_rows)]
            yield from kept.append_column("__side", pa.array([side] * kept.num_rows, pa.string())).append_column("__rows", pa.array(told, pa.int64())).to_batches()

    # at most 2 n rows of each task from here on
    few = x.mapInArrow(task, schema)
    sign = F.when(F.col("__side") == "best", -1.0).otherwise(1.0)
    best_tie = [F.when(F.col("__side") == "best", F.col(t)).asc_nulls_last() for t in tie]
    worst_tie = [F.when(F.col("__side") == "worst", F.col(t)).desc_nulls_last() for t in tie]
    rank = F.row_number().over(Window.partitionBy("__side").orderBy(sign * F.col("__place").cast("double"), *best_tie, *worst_tie))
    total = F.sum("__rows").over(Window.partitionBy(F.lit(0)))
    out = few.withColumns({"__rank": rank, "__total": total}).where((F.col("__rank") <= n) & ((F.col("__side") == "best") | (F.col("__total") > n)))
    return out.withColumnRenamed("__side", "side").drop("__place", "__rows", "__rank", "__total")
