"""Usage, uploads, storage, publishing and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_key, safe_filename
from ..operators import logs as lg
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from ..sources.readers import probe_summary, suffix_kind, table


def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    u = lg.usage_rollup(fx.usage_calls(spark, d))
    return u.withColumn("cost_usd", F.round("cost_usd", 5))


def call_reliability(spark: SparkSession, d: str) -> DataFrame:
    return lg.call_reliability(fx.usage_calls(spark, d), wall="wall_ms")


def retry_chains(spark: SparkSession, d: str) -> DataFrame:
    """Attempts run from 1 to 3, over and over, in each job's calls of one kind."""
    return lg.retry_chains(fx.usage_calls(spark, d).withColumn("kind", F.col("tok_in") % 2), ["job", "kind"], ["ts"])


def abandoned_uploads(spark: SparkSession, d: str) -> DataFrame:
    made = fx.uploads(spark, d).join(fx.recordings(spark, d).select(F.col("id").alias("upload_id"), "created_at"), "upload_id")
    return lg.abandoned_uploads(made, fx.upload_chunks(spark, d), F.lit("1997-06-01 00:00:00").cast("timestamp_ntz"))


def missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    return lg.missing_chunks(fx.uploads(spark, d), fx.upload_chunks(spark, d))


def upload_progress(spark: SparkSession, d: str) -> DataFrame:
    c = fx.upload_chunks(spark, d).groupBy("upload_id").agg(F.count("*").alias("received"), F.max("total_chunks").alias("total"))
    return c.withColumn("complete", F.col("received") == F.col("total"))


def storage_usage(spark: SparkSession, d: str) -> DataFrame:
    return lg.storage_usage(fx.files(spark, d)).drop("gb")


def _now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def retention_report(spark: SparkSession, d: str) -> DataFrame:
    f = fx.files(spark, d)
    number = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    f = f.withColumn("area", F.when(number % 3 == 0, F.col("area")).otherwise(F.concat("area", F.lit("-"), F.floor(number / 4).cast("string"))))
    good = table(spark, d, "labels").filter("quality = 1").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    return lg.retention_report(f, good, _now(), 48, 24 * 7, number % 3 == 0)


def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    age = (F.unix_timestamp(_now().cast("timestamp")) - F.unix_timestamp(F.col("mtime").cast("timestamp"))) / 3600.0
    return fx.files(spark, d).select("name", "length", suffix_kind(F.col("name")).alias("kind"), age.alias("age_h"), F.greatest(F.lit(0.0), 48.0 - age).alias("expires_h"))


def transcript_exists(spark: SparkSession, d: str) -> DataFrame:
    f = fx.files(spark, d).select("name")
    names = f.filter(F.length("name") % 2 == 0).withColumn("name", F.regexp_replace("name", "txt$", "srt"))
    return lg.with_transcript(f, names, ".srt")


def publish_eligibility(spark: SparkSession, d: str) -> DataFrame:
    p = probe_summary(fx.probe_json(spark, d))
    size = F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") * 1_000_000).cast("long")
    name = F.concat(F.lit("p"), F.col("id").cast("string"), F.when(F.col("id") % 4 == 0, ".txt").otherwise(".MP4"))
    path = F.when(F.col("id") % 11 == 0, "").when(F.col("id") % 11 == 1, F.concat(F.lit("/srv/uploads/"), name)).otherwise(F.concat(F.lit("/srv/my uploads/"), name))
    return p.select("id", lg.publish_fault(path, size, F.col("duration_s")).alias("fault"), lg.file_fault(name, size, F.col("width"), F.col("height"), F.col("duration_s") / 20).alias("file_fault"))


def scope_eta(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("seg_from") % 5 == 0, 0).otherwise((F.col("end_ms") - F.col("start_ms")) / 1000)
    eta = lg.scope_eta(fx.clips(spark, d), "doc_id", s)
    kept = fx.files(spark, d).filter("length % 3 > 0").select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("doc_id"), F.col("name").alias("source"))
    return lg.relook_plan(eta, kept, "doc_id")


def upload_keys(spark: SparkSession, d: str) -> DataFrame:
    f = fx.files(spark, d)
    return f.select("name", content_key(F.col("name"), F.col("length"), F.unix_timestamp(F.col("mtime").cast("timestamp"))).alias("key"), safe_filename(F.concat("area", F.lit("/.. my "), "name")).alias("safe"))


def review_tallies(spark: SparkSession, d: str) -> DataFrame:
    return lg.review_tallies(fx.clips(spark, d), "doc_id", ["approved", "rejected", "pending"])


def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """Recordings have clips where lines of the order came back."""
    li = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), "l_linenumber").distinct()
    clips = li.select("id", F.col("l_linenumber").alias("rank"), F.format_string("#%d of %d", "l_linenumber", "id").alias("line"))
    return lg.latest_with_clips(fx.recordings(spark, d), clips, "profile")


def oldest_queued(spark: SparkSession, d: str) -> DataFrame:
    return lg.oldest_queued(fx.recordings(spark, d), "profile")


def log_tail(spark: SparkSession, d: str) -> DataFrame:
    return lg.newest_first(fx.usage_calls(spark, d), "job", "ts", 400).select("job", "ts", "label", "back")


_SAFE = lambda x: f"substr(regexp_replace(regexp_replace({x},'[^A-Za-z0-9._-]+','_','g'),'^[._]+|[._]+$','','g'),1,120)"

QUERIES = {
    "retry_chains": (
        retry_chains,
        with_views("usage_calls", """+c as (select *, tok_in%2 as kind from usage_calls), b as (select *, attempt=1 or coalesce(lag(ok) over (partition by job, kind order by ts), true) as begins from c), n as (select *, sum(begins::int) over (partition by job, kind order by ts rows unbounded preceding)-1 as chain from b)
 select job, kind, chain::bigint as chain, count(*) as attempts, bool_or(ok) as ok, arg_max(error,ts) filter (not ok) as last_error, not bool_or(ok) as given_up, sum(wall_ms)::bigint as wall_ms from n group by 1,2,3"""),
    ),
    "abandoned_uploads": (abandoned_uploads, with_views("upload_chunks", "+h as (select upload_id, count(distinct idx) as n from upload_chunks group by 1) select o_orderkey as upload_id, o_orderdate as created_at, coalesce(n,0) as received, 7::bigint as total_chunks from orders left join h on upload_id=o_orderkey where o_orderdate < timestamp '1997-06-01' - interval 48 hour and coalesce(n,0)<7")),
    "usage_rollup": (usage_rollup, with_views("usage_calls", "select job, count(*) filter (ok) as calls, round(coalesce(sum(cost_usd) filter (ok),0),5) as cost_usd, cast(coalesce(sum(tok_in + coalesce(cache_create,0) + cache_read) filter (ok),0) as bigint) as tok_in, cast(coalesce(sum(tok_out) filter (ok),0) as bigint) as tok_out, count(*) filter (not ok) as failed from usage_calls group by 1")),
    "call_reliability": (call_reliability, with_views("usage_calls", "select label, count(*) as calls, count(*) filter (not ok) as failures, max(attempt) as most_attempts, sum(wall_ms)::bigint as wall_ms from usage_calls group by 1")),
    "missing_chunks": (missing_chunks, with_views("upload_chunks", "select upload_id, i as idx from (select o_orderkey as upload_id from orders) u, lateral unnest(range(0,7)) t(i) where not exists (select 1 from upload_chunks c where c.upload_id=u.upload_id and c.idx=i)")),
    "upload_progress": (upload_progress, with_views("upload_chunks", "select upload_id, count(*) as received, max(total_chunks)::bigint as total, count(*)=max(total_chunks) as complete from upload_chunks group by 1")),
    "storage_usage": (storage_usage, with_views("files", "select area, count(*) as files, cast(sum(length) as bigint) as bytes from files group by 1")),
    "retention_report": (
        retention_report,
        with_views("files", """+n as (select *, regexp_extract(name,'(\\d+)',1)::bigint as k, (epoch(timestamp '2024-02-01')-epoch(mtime))/3600.0 as age from files),
 f as (select name, length, k, age, case when k%3=0 then area else area||'-'||(k//4) end as area from n),
 ok as (select 'doc_'||doc_id||'.txt' as name from labels where quality=1),
 held as (select distinct area from f where k%3<>0 and name in (select name from ok))
 select 'source' as kind, name, length from f where k%3=0 and age>48 union all select 'group', area, cast(sum(length) as bigint) from f where k%3<>0 and area not in (select area from held) group by area having min(age)>168"""),
    ),
    "file_inventory": (file_inventory, with_views("files", "select name, length, 'text' as kind, (epoch(timestamp '2024-02-01')-epoch(mtime))/3600.0 as age_h, greatest(0.0, 48.0-(epoch(timestamp '2024-02-01')-epoch(mtime))/3600.0) as expires_h from files")),
    "transcript_exists": (transcript_exists, with_views("files", "+t as (select regexp_replace(name,'\\.txt$','') as s from files where length(name)%2=0) select name, exists (select 1 from t where starts_with(t.s, regexp_replace(name,'\\.[^.]*$',''))) as has_transcript from files")),
    "publish_eligibility": (
        publish_eligibility,
        with_views("probe_json", "+p as (select id, json_extract_string(js,'$.format.duration')::double as s, json_extract(js,'$.streams[1].width')::bigint as w, case when id%10<>0 then id*1000000 end as z from probe_json) select id, case when id%11=0 then 'no file' when z is null then 'missing' when z/1048576>100 then 'too large' when id%11=1 then 'source upload' when s<>0 and s<3 then 'too short' when s<>0 and s>900 then 'too long' end as fault, case when id%4=0 then 'suffix' when coalesce(z,0)<=0 then 'empty' when s/20>90 then 'too long' when coalesce(w,0)<=0 then 'dimensions' end as file_fault from p"),
    ),
    "scope_eta": (scope_eta, with_views("clips files", "+e as (select doc_id, count(*) as \"all\", count(*) filter (decision<>'rejected') as keeping, count(*) filter (decision='approved') as approved, greatest(1,round_even(sum(case when seg_from%5=0 then 60 else (end_ms-start_ms)/1000 end)/1.8/60,0))::bigint as eta_minutes from clips group by 1), s as (select name as source from files where length%3>0) select e.*, source, source is not null as lossless from e left join s on source='doc_'||doc_id||'.txt'")),
    "upload_keys": (upload_keys, with_views("files", f"select name, substr(sha256(name||'|'||length||'|'||epoch(mtime)::bigint),1,20) as key, {_SAFE(chr(39) + '.. my ' + chr(39) + '||name')} as safe from files")),
    "review_tallies": (review_tallies, with_views("clips", "select doc_id, count(*) filter (decision='approved') as approved, count(*) filter (decision='rejected') as rejected, count(*) filter (decision='pending') as pending from clips group by 1")),
    "latest_run": (
        latest_run,
        with_views("recordings", "+c as (select distinct l_orderkey as id, l_linenumber as rank from lineitem where l_returnflag='R'), l as (select profile, arg_max(id,(created_at,id)) as id from recordings where id in (select id from c) group by 1) select profile, l.id, string_agg('#'||rank||' of '||l.id, chr(10) order by rank) as summary from l join c using(id) where rank<=12 group by 1,2"),
    ),
    "oldest_queued": (oldest_queued, with_views("recordings", "select profile, arg_min(id,(created_at,id)) as id from recordings where status='queued' group by 1")),
    "log_tail": (log_tail, with_views("usage_calls", "+r as (select job, ts, label, row_number() over (partition by job order by ts desc) as back from usage_calls) select * from r where back<=400")),
}
