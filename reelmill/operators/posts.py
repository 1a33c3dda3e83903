"""Posts with their latest metrics, performance patterns and the learning pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import two_ends

METRICS = ["views", "likes", "saves"]


def known_metrics(rows: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Known metrics as numbers; what is no number is missing."""
    return rows.withColumns({m: F.col(m).cast("string").try_cast("double") for m in metrics})


def posts_latest(log: DataFrame, keys: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """Published posts with the last reading of each metric by itself, and when the last reading of any was taken."""
    rest = [c for c in log.columns if c not in (*keys, "kind", *metrics)]
    published = log.filter("kind = 'published'").groupBy(*keys).agg(F.max_by(F.struct(*rest), "ts").alias("p")).select(*keys, "p.*")
    read = log.filter("kind = 'metrics'").groupBy(*keys).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col("ts"))).alias(m) for m in metrics], F.max("ts").alias("measured_ts"))
    return published.join(read, keys, "left").withColumn("has_metrics", F.col("measured_ts").isNotNull())


def patterns(posts: DataFrame, metric: str) -> DataFrame:
    """Average and size of a metric by slot time, weekday, source and topic, one pass; rows without a slot time have no
    slot or weekday cut, and "?" stands for a missing source or topic. few marks cells under three posts."""
    at = F.col("slot_at")
    valid = F.length(F.coalesce(at, F.lit(""))) >= 16
    day = F.date_format(F.try_to_timestamp(F.when(valid, F.substring(at, 1, 16)), F.lit("yyyy-MM-dd'T'HH:mm")), "E")
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?"))
    cuts = F.array(*[F.struct(F.lit(n).alias("dim"), v.alias("key")) for n, v in (("slot", F.when(valid, F.substring(at, 12, 5))), ("weekday", day), ("source", named("source")), ("topic", named("topic")))])
    rows = posts.filter(F.col("has_metrics") & F.col(metric).isNotNull()).select(F.explode(cuts).alias("c"), F.col(metric).alias("v")).select("c.*", "v").filter("key is not null")
    average = F.sum(F.col("v").cast("decimal(28,6)")).cast("double") / F.count("*")  # sums of doubles depend on their order
    return rows.groupBy("dim", "key").agg(average.alias("avg"), F.count("*").alias("n")).withColumn("few", F.col("n") < 3)


def pattern_gate(posts: DataFrame, metric: str, least: int = 12) -> DataFrame:
    n = F.count_if(F.col("has_metrics") & F.col(metric).isNotNull())
    return posts.agg(n.alias("posts_with_metrics"), F.count("*").alias("total_published"), (n >= least).alias("enough_data"), F.greatest(F.lit(0), least - n).alias("needed"))


def best_and_worst(posts: DataFrame, order: Column, tie: list[str], n: int = 8) -> DataFrame:
    """The best n, and the worst n if there are more than n, in one pass."""
    return two_ends(posts.filter("has_metrics"), order, tie, n)


def rejection_signal(rows: DataFrame, dims: list[str], order: str, most: int = 8) -> DataFrame:
    """Top counts of each dimension; ties go by what was seen first; "?" stands for a missing value."""
    cuts = F.array(*[F.struct(F.lit(c).alias("dim"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("?")).alias("value")) for c in dims])
    got = rows.select(order, F.explode(cuts).alias("c")).groupBy("c.dim", "c.value").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "first", "value")).cast("long")).filter(F.col("rank") <= most).select("dim", "value", "n", "rank")


def rejection_gate(rows: DataFrame, least: int = 8) -> DataFrame:
    return rows.agg(F.count("*").alias("rejections"), F.greatest(F.lit(0), least - F.count("*")).alias("needed"), (F.count("*") >= least).alias("ready"))


def split_rejections(rows: DataFrame, verdicts: tuple[str, ...], reasons: tuple[str, ...]) -> DataFrame:
    """A fault for each row that is no valid decision, null for valid ones."""
    return rows.withColumn("fault", F.coalesce(F.when(~F.col("verdict").isin(*verdicts) | F.col("verdict").isNull(), "verdict"), F.when((F.col("verdict") == "rejected") & ~F.coalesce(F.col("reason").isin(*reasons), F.lit(False)), "reason")))


def newest(posts: DataFrame, tie: list[str], n: int) -> DataFrame:
    """The last n posts, newest first."""
    return posts.orderBy(F.desc("ts"), *tie).limit(n)


def learning_pack(rejected: DataFrame, posts: DataFrame, order: str, keys: list[str], hooks: int = 20, reasons: int | None = 8) -> DataFrame:
    """What the tuner is shown, as section, key, body, n: notes of the commonest reasons (None: of all, a missing one too),
    the first rejected hooks, and the best and worst posts by views. rejected: reason, note, hook; posts: hook, views, saves, slot_at, has_metrics."""
    told = rejected
    if reasons is not None:
        common = rejection_signal(rejected, ["reason"], order, reasons).select(F.col("value").alias("reason"))
        told = rejected.join(F.broadcast(common), "reason", "left_semi")
    notes = first_notes(told, "reason", "note", order).select(F.lit("notes").alias("section"), F.col("reason").alias("key"), F.col("notes").alias("body"), "n")
    joined = lambda place, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, line.alias("line")))), lambda x: x["line"]), "\n")
    first = rejected.filter(F.trim("hook") != "").orderBy(order).limit(hooks)
    shown = first.agg(joined([F.col(order)], F.substring(F.trim("hook"), 1, 120)).alias("body"), F.count("*").alias("n")).select(F.lit("hooks").alias("section"), F.lit(None).cast("string").alias("key"), "body", "n")
    views = F.coalesce("views", F.lit(0.0))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    line = F.concat(F.substring("hook", 1, 90), F.lit(" :: views="), known("views"), F.when(F.col("side") == "best", F.concat(F.lit(" saves="), known("saves"))).otherwise(""), F.lit(" slot="), F.substring(F.coalesce("slot_at", F.lit("")), 12, 5))
    sign = F.when(F.col("side") == "best", -1.0).otherwise(1.0)
    ends = best_and_worst(posts, views, keys).groupBy(F.col("side").alias("section")).agg(joined([(sign * views).alias("place"), *keys], line).alias("body"), F.count("*").alias("n")).select("section", F.lit(None).cast("string").alias("key"), "body", "n")
    return notes.unionByName(shown).unionByName(ends)


def first_notes(rows: DataFrame, reason: str, note: str, order: str, n: int = 6) -> DataFrame:
    """The first n non-blank notes of each reason, as one text."""
    good = rows.filter(F.trim(note) != "").withColumn("k", F.row_number().over(Window.partitionBy(reason).orderBy(order))).filter(F.col("k") <= n)
    return good.groupBy(reason).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.substring(F.trim(note), 1, 200).alias("t")))), lambda x: x["t"]), "\n").alias("notes"), F.count("*").alias("n"))
