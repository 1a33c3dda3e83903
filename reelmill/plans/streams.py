"""Streams over the event log; their results equal the batch queries'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import post_log, with_views
from ..sources.readers import table
from ..streaming import streams as st


def _events(spark: SparkSession, d: str) -> DataFrame:
    # a pattern, as a stream's path may not name a single file
    return st.tail(spark, f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_posts_latest(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    metric = lambda e: F.when(t == e, F.col("value"))
    log = _events(spark, d).select(F.col("user_id").alias("job"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("clip"), "ts", F.when(t == "signup", "published").when(t == "error", "ignored").otherwise("metrics").alias("kind"), metric("view").alias("views"), metric("click").alias("likes"), metric("purchase").alias("saves"))
    out = st.drained(st.latest_metrics(log, ["job", "clip"], ["views", "likes", "saves"]), "complete")
    return out.withColumn("measured_ts", F.col("measured_ts").cast("timestamp_ntz"))


def stream_usage_daily(spark: SparkSession, d: str) -> DataFrame:
    calls = _events(spark, d).select(F.col("user_id").alias("job"), "ts", (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 5000).alias("tok_in"))
    return st.drained(st.usage_daily(calls), "complete").withColumn("day", F.col("day").cast("timestamp_ntz"))


def stream_status(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise("done")
    changes = _events(spark, d).select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), state.alias("status"))
    return st.drained(st.status_feed(changes, "id", restarted=True), "complete")


def stale_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that were closed when the log ended, less a day for late rows."""
    chunks = _events(spark, d).select(F.col("user_id").alias("upload"), "ts")
    out = st.drained(st.idle_sessions(chunks, "upload"), "append")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("began", "given_up")})


def stream_posts_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The latest metrics from a log of several files out of order, one a batch. The driver is lost after the second batch
    was written; the next run replays it and goes on."""
    rows = post_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).repartition(4, "job")
    base = st.new_base(spark)
    rows.write.parquet(f"{base}/log")
    feed = st.latest_metrics(st.tail(spark, f"{base}/log", per_trigger=1), ["job", "clip"], ["views", "likes", "saves"])
    st.advance(feed, base, "update", lose_batch=1)
    st.advance(feed, base, "update")
    return st.put_out(feed, base, ["job", "clip"]).withColumn("measured_ts", F.col("measured_ts").cast("timestamp_ntz"))


#: January in three parts; every 50th call is told only at the end.
_PART = "case when event_id % 50 = 0 or ts >= timestamp '2024-01-21' then 2 when ts >= timestamp '2024-01-11' then 1 else 0 end"


def _usage_parts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("job"), "ts", F.col("event_type").alias("label"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 5000).alias("tok_in"), F.expr(_PART).alias("part"))


def stream_usage_closed(spark: SparkSession, d: str) -> DataFrame:
    """Days of calls, each put out once, when it is closed; the log grows three times and the stream goes on from its
    checkpoint. Calls that come after their day was closed don't count."""
    base, feed = st.new_base(spark), []

    def more(folder: str) -> None:
        feed.append(st.usage_daily(st.tail(spark, folder)))
        st.advance(feed[-1], base, "append")

    st.growing(_usage_parts(spark, d), F.col("part"), 3, more)
    return st.put_out(feed[-1], base).withColumn("day", F.col("day").cast("timestamp_ntz"))


def stream_usage_late(spark: SparkSession, d: str) -> DataFrame:
    """The calls that stream_usage_closed leaves out, kept apart."""
    base = st.new_base(spark)
    closes = F.date_trunc("day", "ts") + F.expr("interval 1 day")
    st.growing(_usage_parts(spark, d), F.col("part"), 3, lambda folder: st.late_rows(st.tail(spark, folder), base, "ts", closes, "1 day"))
    return spark.read.parquet(f"{base}/late").select("job", F.col("ts").cast("timestamp_ntz").alias("ts"), "label", "tok_in")


def _upload_log(spark: SparkSession, d: str) -> DataFrame:
    """Uploads of seven chunks, told by every 64th event; chunks told by errors are lost."""
    k = F.floor(F.col("event_id") / 64) % 8
    e = table(spark, d, "events").where((k == 0) | (F.col("event_type") != "error"))
    part = F.when(F.col("ts") >= "2024-01-21", 2).when(F.col("ts") >= "2024-01-11", 1).otherwise(0)
    return e.select((F.floor(F.col("event_id") / 512) * 64 + F.col("event_id") % 64).alias("upload"), F.col("ts").cast("timestamp").alias("ts"), F.when(k == 0, "created").otherwise("chunk").alias("kind"), F.when(k == 0, 7).cast("long").alias("total"), F.when(k > 0, k - 1).cast("long").alias("idx"), part.alias("part"))


def stream_abandoned_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Uploads that were not complete 48 hours after their creation; the log grows three times."""
    base, feed = st.new_base(spark), []

    def more(folder: str) -> None:
        feed.append(st.abandoned_uploads(st.tail(spark, folder).drop("part")))
        st.with_timers(spark, lambda: st.advance(feed[-1], base, "append"))

    st.growing(_upload_log(spark, d), F.col("part"), 3, more)
    return st.put_out(feed[-1], base).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created", "given_up")})


_LATEST = "select job, clip, arg_max(views,ts) filter (views is not null) as views, arg_max(likes,ts) filter (likes is not null) as likes, arg_max(saves,ts) filter (saves is not null) as saves, max(ts) as measured_ts from post_log where kind='metrics' group by 1,2"
_PARTED = f"e as (select user_id as job, ts, event_type as label, event_id%5000 as tok_in, {_PART} as part, date_trunc('day',ts)::timestamp as day from events), late as (select * from e where part=2 and day + interval 1 day <= (select max(ts) from e where part<2) - interval 1 day)"

QUERIES = {
    "stream_posts_resumed": (stream_posts_resumed, with_views("post_log", _LATEST)),
    "stream_usage_closed": (stream_usage_closed, f"with {_PARTED} select day, job, count(*) filter (label<>'error') as calls, count(*) filter (label='error') as failed, cast(coalesce(sum(tok_in) filter (label<>'error'),0) as bigint) as tok_in from (select * from e except all select * from late) where day + interval 1 day <= (select max(ts) from e) - interval 1 day group by 1,2"),
    "stream_usage_late": (stream_usage_late, f"with {_PARTED} select job, ts, label, tok_in from late"),
    "stream_abandoned_uploads": (
        stream_abandoned_uploads,
        "with u as (select (event_id//512)*64+event_id%64 as upload, (event_id//64)%8 as k, ts, event_type from events), c as (select upload, date_trunc('milliseconds',ts) as created from u where k=0), g as (select c.upload, created, count(distinct k) filter (k>0 and event_type<>'error' and date_trunc('milliseconds',ts)<=created + interval 48 hour) as received from c join u on c.upload=u.upload group by 1,2) select upload, created, created + interval 48 hour as given_up, received, 7::bigint as total from g where received<7 and created + interval 48 hour <= (select max(ts) from events) - interval 1 day",
    ),
    "stream_posts_latest": (stream_posts_latest, with_views("post_log", "select job, clip, arg_max(views,ts) filter (views is not null) as views, arg_max(likes,ts) filter (likes is not null) as likes, arg_max(saves,ts) filter (saves is not null) as saves, max(ts) as measured_ts from post_log where kind='metrics' group by 1,2")),
    "stream_usage_daily": (stream_usage_daily, with_views("usage_calls", "select date_trunc('day',ts)::timestamp as day, job, count(*) filter (ok) as calls, count(*) filter (not ok) as failed, cast(coalesce(sum(tok_in) filter (ok),0) as bigint) as tok_in from usage_calls group by 1,2")),
    "stream_status": (stream_status, "with s as (select user_id as id, ts, event_id, case event_type when 'view' then 'queued' when 'click' then 'running' else 'done' end as status from events) select id, case arg_max(status,(ts,event_id)) when 'running' then 'queued' else arg_max(status,(ts,event_id)) end as status, count(*) as changes from s group by 1"),
    "stale_uploads": (
        stale_uploads,
        "with e as (select user_id as upload, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 48 hour then 0 else 1 end as n from events), g as (select *, sum(n) over (partition by upload order by ts rows unbounded preceding) as k from e), s as (select upload, min(ts) as began, max(ts)+interval 48 hour as given_up, count(*) as chunks from g group by upload, k) select * from s where given_up <= (select max(ts) from events) - interval 1 day",
    ),
}
