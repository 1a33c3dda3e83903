"""Records that are written to files and read back: documents, line logs with broken lines, folders, streamed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from ..sources.readers import inventory, read_entities, read_log, scan_folder, split_log, suffix_kind, table
from ..sources.sinks import append_events, append_stream, folded_entities, write_files
from ..streaming import streams as st


def _threads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("text", "turn").alias("last"))


def entity_files(spark: SparkSession, d: str) -> DataFrame:
    """A JSON document a conversation, some cut off; what cannot be read is told by its file."""
    path = f"{st.new_base(spark)}/jobs"
    t = _threads(spark, d)
    js = F.to_json(F.struct("conv_id", "turns", "last"))
    write_files(t.select("conv_id", F.when(F.col("conv_id") % 7 == 3, F.substring(js, 1, 20)).otherwise(js).alias("value")), "conv_id", path)
    good, bad = read_entities(spark, path, T.StructType.fromDDL("conv_id long, turns long, last string"))
    told = bad.select(F.regexp_extract("file", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turns"), F.lit(None).cast("string").alias("last"), F.lit(True).alias("broken"))
    return good.withColumn("broken", F.lit(False)).unionByName(told)


def _call() -> T.StructType:
    return T.StructType.fromDDL("job long, ts timestamp_ntz, label string, ok boolean, tok_in long")


def _call_log(spark: SparkSession, d: str) -> str:
    """A log that was appended to twice, and once by a writer that was cut off within its lines."""
    path = f"{st.new_base(spark)}/calls"
    calls = fx.usage_calls(spark, d).select("job", "ts", "label", "ok", "tok_in")
    append_events(calls.where("ok"), path)
    append_events(calls.where("not ok"), path)
    calls.where("tok_in % 97 = 5").select(F.concat(F.lit('{"job":'), F.col("job").cast("string"), F.lit(',"lab')).alias("value")).write.mode("append").text(path)
    return path


def log_files(spark: SparkSession, d: str) -> DataFrame:
    """Calls and tokens of each label from the log's files, and how many lines could not be read."""
    good, bad = split_log(spark, _call_log(spark, d), _call())
    return good.groupBy("label").agg(F.count("*").alias("n"), F.sum("tok_in").alias("tok_in")).unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("(broken)").alias("label"), "n", F.lit(0).cast("long").alias("tok_in")))


def log_file_tail(spark: SparkSession, d: str) -> DataFrame:
    """The log's last 400 good lines."""
    return read_log(spark, _call_log(spark, d), _call(), tail=400)


def _folder(spark: SparkSession, d: str) -> str:
    path, t = f"{st.new_base(spark)}/folder", _threads(spark, d)
    write_files(t.select("conv_id", F.col("last").alias("value")), "conv_id", f"{path}/notes")
    write_files(t.select("conv_id", "turns"), "conv_id", f"{path}/data", "json")
    return path


def folder_scan(spark: SparkSession, d: str) -> DataFrame:
    """Texts and other files below a folder, with the texts' first 100 characters."""
    return scan_folder(spark, _folder(spark, d), 100).where(F.col("path").rlike(r"/part-")).select(F.regexp_extract("path", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), "kind", "size", "head")


def folder_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes of each kind; contents are not read."""
    files = inventory(spark, _folder(spark, d)).where("name like 'part-%'")
    return files.groupBy(suffix_kind(F.col("name")).alias("kind")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def event_sink(spark: SparkSession, d: str) -> DataFrame:
    """Events streamed into a log of JSON lines in three runs, and read back."""
    base = st.new_base(spark)
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    st.growing(e, F.col("event_id") % 3, 3, lambda folder: append_stream(st.tail(spark, folder), f"{base}/events", f"{base}/state"))
    return read_log(spark, f"{base}/events", T.StructType.fromDDL("event_id long, user_id long, event_type string"))


def entity_fold(spark: SparkSession, d: str) -> DataFrame:
    """Records from creations, settings and appends; three events share a version."""
    e, t = table(spark, d, "events"), F.col("event_type")
    value = F.concat(F.lit("v"), F.col("event_id").cast("string"))
    log = e.select(
        F.col("user_id").alias("id"), F.floor(F.col("event_id") / 3).alias("version"), (F.col("event_id") % 3).alias("place"),
        F.when(t == "signup", "create").when(t == "view", "append").otherwise("set").alias("op"), F.when(t == "click", "status").when(t == "error", "error").when(t != "signup", "warnings").alias("field"),
        value.alias("value"), F.when(t == "purchase", F.array(value)).alias("items"),
    )
    return folded_entities(log, "id", ["version", "place"], ["status", "error"], ["warnings"])


_THREADS = "t as (select conv_id, count(*) as turns, arg_max(text,turn) as last from conversations group by 1)"
QUERIES = {
    "entity_files": (entity_files, f"with {_THREADS} select conv_id, case when conv_id%7<>3 then turns end as turns, case when conv_id%7<>3 then last end as last, conv_id%7=3 as broken from t"),
    "log_files": (log_files, with_views("usage_calls", "select label, count(*) as n, sum(tok_in)::bigint as tok_in from usage_calls group by 1 union all select '(broken)', count(*), 0 from usage_calls where tok_in%97=5")),
    "log_file_tail": (log_file_tail, with_views("usage_calls", "select job, ts, label, ok, tok_in from usage_calls order by ts desc limit 400")),
    "folder_scan": (folder_scan, f"with {_THREADS} select conv_id, 'text' as kind, strlen(last)+1 as size, substr(last||chr(10),1,100) as head from t union all select conv_id, 'other', strlen('{{\"turns\":'||turns||'}}')+1, null from t"),
    "folder_inventory": (folder_inventory, f"with {_THREADS} select 'text' as kind, count(*) as files, sum(strlen(last)+1)::bigint as bytes from t union all select 'other', count(*), sum(strlen('{{\"turns\":'||turns||'}}')+1)::bigint from t"),
    "event_sink": (event_sink, "select event_id, user_id, event_type from events"),
    "entity_fold": (
        entity_fold,
        """with made as (select user_id as id, min(event_id) as m from events where event_type='signup' group by 1), e as (select id, event_id as i, event_type as t, 'v'||event_id as v from events join made on id=user_id where event_id>=m),
 g as (select id, arg_max(v,i) filter (t='click') as status, arg_max(v,i) filter (t='error') as error, max(i) filter (t='purchase') as s from e group by 1)
 select g.id, status, error, coalesce((select list(v order by i) from e where e.id=g.id and ((t='view' and i>coalesce(s,-1)) or i=s)),[]) as warnings from g""",
    ),
}
