"""Posts, patterns, rejections and what is learned from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import posts as ps
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from ..sources.readers import metrics_wide, table
from ..sources.sinks import numbered_report

KEYS = ["job", "clip"]


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return ps.posts_latest(ps.known_metrics(fx.post_log(spark, d)), KEYS)


def posts_latest(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d)


def patterns(spark: SparkSession, d: str) -> DataFrame:
    return ps.patterns(_posts(spark, d), "views")


def pattern_gate(spark: SparkSession, d: str) -> DataFrame:
    return ps.pattern_gate(_posts(spark, d), "views")


def best_worst_posts(spark: SparkSession, d: str) -> DataFrame:
    p = _posts(spark, d).withColumn("v", F.coalesce("views", F.lit(0.0)))
    return ps.best_and_worst(p, F.col("v"), KEYS).select(*KEYS, "v", "side")


def rejection_signal(spark: SparkSession, d: str) -> DataFrame:
    return ps.rejection_signal(fx.feedback(spark, d), ["reason", "profile", "structure", "topic"], "doc_id")


def rejection_gate(spark: SparkSession, d: str) -> DataFrame:
    return ps.rejection_gate(fx.feedback(spark, d))


def reject_validation(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.element_at(F.array(*[F.lit(x) for x in ("approved", "rejected", "pending", "maybe")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", verdict.alias("verdict"), F.col("source").alias("reason"))
    return ps.split_rejections(rows, ("approved", "rejected", "pending"), ("src1", "src5", "src9")).groupBy("verdict", "fault").agg(F.count("*").alias("n"))


def learning_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.feedback(spark, d).withColumns({c: F.regexp_replace(c, r"\s+", " ") for c in ("note", "hook")})
    posts = _posts(spark, d).withColumn("hook", F.concat(F.lit("hook "), F.col("job").cast("string"), F.lit("-"), F.col("clip").cast("string")))
    return ps.learning_pack(rows, posts, "doc_id", KEYS, reasons=None)


def newest_posts(spark: SparkSession, d: str) -> DataFrame:
    return ps.newest(_posts(spark, d), KEYS, 50).select(*KEYS, "ts", "views")


def amendments(spark: SparkSession, d: str) -> DataFrame:
    """Learning replies hold amendments as JSON; they become rows and then a numbered report."""
    r = fx.feedback(spark, d)
    js = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), lambda k: F.struct(F.concat(F.lit("rule "), k.cast("string")).alias("rule"), F.concat(F.lit("seen in "), F.col("doc_id").cast("string")).alias("why"))).alias("amendments")))
    rows = r.select("doc_id", F.posexplode(F.from_json(js, "struct<amendments:array<struct<rule:string,why:string>>>")["amendments"]).alias("i", "a"))
    return numbered_report(rows, "doc_id", "i", F.concat_ws(" - ", "a.rule", "a.why"))


def metric_pivot(spark: SparkSession, d: str) -> DataFrame:
    return metrics_wide(table(spark, d, "events"), "user_id", "event_type", "value", {"view": "views", "click": "likes", "purchase": "saves"})


_POSTS = """pub as (select job, clip, max(ts) as ts, arg_max(slot_at,ts) as slot_at, arg_max(source,ts) as source, arg_max(topic,ts) as topic from post_log where kind='published' group by 1,2),
 met as (select job, clip, arg_max(views,ts) filter (views is not null) as views, arg_max(likes,ts) filter (likes is not null) as likes, arg_max(saves,ts) filter (saves is not null) as saves, max(ts) as measured_ts from post_log where kind='metrics' group by 1,2),
 posts as (select p.*, views, likes, saves, measured_ts, measured_ts is not null as has_metrics from pub p left join met m on p.job=m.job and p.clip=m.clip)"""

QUERIES = {
    "posts_latest": (posts_latest, with_views("post_log", "+" + _POSTS + " select * from posts")),
    "patterns": (
        patterns,
        with_views("post_log", "+" + _POSTS + """, h as (select * from posts where has_metrics and views is not null),
 c as (select 'slot' as dim, substr(slot_at,12,5) as key, views from h where length(slot_at)>=16 union all select 'weekday', strftime(strptime(substr(slot_at,1,16),'%Y-%m-%dT%H:%M'),'%a'), views from h where length(slot_at)>=16 union all select 'source', source, views from h union all select 'topic', topic, views from h)
 select dim, key, sum(views::decimal(28,6))::double/count(*) as avg, count(*) as n, count(*)<3 as few from c group by 1,2"""),
    ),
    "pattern_gate": (pattern_gate, with_views("post_log", "+" + _POSTS + " select count(*) filter (has_metrics and views is not null) as posts_with_metrics, count(*) as total_published, count(*) filter (has_metrics and views is not null)>=12 as enough_data, greatest(0,12-count(*) filter (has_metrics and views is not null)) as needed from posts")),
    "best_worst_posts": (best_worst_posts, with_views("post_log", "+" + _POSTS + ", h as (select job, clip, coalesce(views,0.0) as v from posts where has_metrics) select * from ((select *, 'best' as side from h order by v desc, job, clip limit 8) union all (select *, 'worst' from h where (select count(*) from h)>8 order by v, job desc, clip desc limit 8))")),
    "rejection_signal": (
        rejection_signal,
        with_views("feedback", "+c as (select doc_id, 'reason' as dim, coalesce(reason,'?') as value from feedback union all select doc_id, 'profile', coalesce(profile,'?') from feedback union all select doc_id, 'structure', coalesce(structure,'?') from feedback union all select doc_id, 'topic', coalesce(topic,'?') from feedback), g as (select dim, value, count(*) as n, min(doc_id) as f from c group by 1,2), r as (select dim, value, n, row_number() over (partition by dim order by n desc, f, value) as rank from g) select * from r where rank<=8"),
    ),
    "rejection_gate": (rejection_gate, with_views("feedback", "select count(*) as rejections, greatest(0,8-count(*)) as needed, count(*)>=8 as ready from feedback")),
    "reject_validation": (reject_validation, "with r as (select ['approved','rejected','pending','maybe'][1+doc_id%4] as verdict, source as reason from documents) select verdict, case when verdict='maybe' then 'verdict' when verdict='rejected' and reason not in ('src1','src5','src9') then 'reason' end as fault, count(*) as n from r group by 1,2"),
    "newest_posts": (newest_posts, with_views("post_log", "+" + _POSTS + " select job, clip, ts, views from posts order by ts desc, job, clip limit 50")),
    "learning_pack": (learning_pack, with_views("feedback post_log", "+" + _POSTS + """, n as (select doc_id, reason, trim(regexp_replace(note,'\\s+',' ','g')) as t from feedback), k as (select *, row_number() over (partition by reason order by doc_id) as k from n where t<>''), q as (select doc_id, trim(regexp_replace(hook,'\\s+',' ','g')) as t from feedback), q20 as (select * from q where t<>'' order by doc_id limit 20),
 h as (select *, 'hook '||job||'-'||clip as hook, coalesce(views,0.0) as v, row_number() over (order by coalesce(views,0.0) desc, job, clip) as best, row_number() over (order by coalesce(views,0.0), job desc, clip desc) as worst, count(*) over () as every from posts where has_metrics)
 select 'notes' as section, reason as key, string_agg(substr(t,1,200), chr(10) order by k) as body, count(*) as n from k where k<=6 group by 2 union all select 'hooks', null, string_agg(substr(t,1,120), chr(10) order by doc_id), count(*) from q20
 union all select 'best', null, string_agg(hook||' :: views='||coalesce(views::varchar,'?')||' saves='||coalesce(saves::varchar,'?')||' slot='||substr(coalesce(slot_at,''),12,5), chr(10) order by v desc, job, clip), count(*) from h where best<=8
 union all select 'worst', null, string_agg(hook||' :: views='||coalesce(views::varchar,'?')||' slot='||substr(coalesce(slot_at,''),12,5), chr(10) order by v, job, clip), count(*) from h where worst<=8 and every>8 having count(*)>0""")),
    "amendments": (amendments, with_views("feedback", "select doc_id, (select string_agg(i||'. rule '||i||' - seen in '||doc_id, chr(10) order by i) from unnest(range(1,doc_id%3+2)) u(i)) as report from feedback")),
    "metric_pivot": (metric_pivot, "select user_id, max(value) filter (event_type='view') as views, max(value) filter (event_type='click') as likes, max(value) filter (event_type='purchase') as saves from events group by 1"),
}
