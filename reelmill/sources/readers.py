"""Readers of stored records: JSON documents and logs, transcripts, subtitles, folders, probes, sectioned texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Folders that are listed within are dealt out over some tasks a core; by itself Spark takes a task for each of the
    first 10,000."""
    before = spark.conf.get(LISTERS)
    spark.conf.set(LISTERS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTERS, before)


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return schema if CORRUPT in schema.names else T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_entities(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """One JSON document a file -> (good records, unreadable ones). An order is the reader's affair: newest first is
    orderBy(desc("created_at"))."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    with listing(spark):
        whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    raw = whole.withColumn("r", F.from_json("value", _with_corrupt(schema), options))
    return raw.filter(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT), raw.filter(F.col(f"r.{CORRUPT}").isNotNull()).select("file", F.col("value").alias(CORRUPT))


def read_log(spark: SparkSession, path: str, schema: T.StructType, tail: int | None = None, ts: str = "ts") -> DataFrame:
    """An append-only line log without its unreadable lines; tail: the last rows by ts."""
    good, _ = split_log(spark, path, schema)
    return good if tail is None else good.orderBy(F.desc(ts)).limit(tail)


def split_log(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """An append-only line log -> (good rows, unreadable lines with their file)."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("file"), "value", F.from_json("value", _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return raw.filter(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT), raw.filter(F.col(f"r.{CORRUPT}").isNotNull()).select("file", F.col("value").alias(CORRUPT))


TRANSCRIPT = "job_id string, segments array<struct<start:double,end:double,text:string,words:array<struct<w:string,start:double,end:double>>>>"


def flatten_transcripts(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested transcripts -> (segments, words), times in milliseconds. Segments tell how many words they have and when the
    last of them ends, so that needs no grouping of words."""
    ms = lambda c: F.round(c * 1000).cast("long")
    seg = nested.select("job_id", F.posexplode("segments").alias("seg", "s")).select("job_id", F.col("seg").cast("long").alias("seg"), "s.*")
    last = F.array_max(F.transform("words", lambda x: ms(x["end"])))
    segments = seg.select("job_id", "seg", ms(F.col("start")).alias("start_ms"), ms(F.col("end")).alias("end_ms"), "text", F.coalesce(F.array_size("words"), F.lit(0)).cast("long").alias("n_words"), last.alias("last_ms"))
    words = seg.select("job_id", "seg", F.posexplode("words").alias("pos", "x")).select("job_id", "seg", F.col("pos").cast("long").alias("pos"), F.col("x.w").alias("w"), ms(F.col("x.start")).alias("start_ms"), ms(F.col("x.end")).alias("end_ms"))
    return segments, words


def _cue_ms(text: Column, place: int) -> Column:
    part = lambda k: F.regexp_extract(text, r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)", place + k).cast("long")
    return ((part(0) * 60 + part(1)) * 60 + part(2)) * 1000 + part(3)


def cues_of(files: DataFrame, text: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Subtitle texts -> cue rows: blocks of at least three lines with a time line; pos is the block's place."""
    blocks = files.select(*keys, F.posexplode(F.split(F.regexp_replace(F.regexp_replace(text, "\r", ""), r"^\s+|\s+$", ""), r"\n\s*\n")).alias("pos", "block"))
    lines = blocks.withColumn("line", F.split(F.trim("block"), "\n"))
    good = lines.filter((F.size("line") >= 3) & F.col("line")[1].contains("-->"))
    return good.select(*keys, F.col("pos").cast("long").alias("pos"), _cue_ms(F.col("line")[1], 1).alias("start_ms"), _cue_ms(F.col("line")[1], 5).alias("end_ms"), F.array_join(F.slice("line", 3, F.size("line")), "\n").alias("text"))


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    return cues_of(spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()), keys=("file",))


KINDS = {"video": "mp4|mov|mkv|avi|webm|m4v", "text": "txt|md|srt|vtt", "image": "png|jpg|jpeg|webp"}


def suffix_kind(name: Column, kinds: dict[str, str] = KINDS) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(suffix.rlike(f"^({v})$"), k) for k, v in kinds.items()], F.lit("other"))


def _below(spark: SparkSession, path: str) -> DataFrame:
    with listing(spark):
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def scan_folder(spark: SparkSession, path: str, chars: int = 8000) -> DataFrame:
    """All files below a folder with their kind and, of texts, the first characters."""
    files = _below(spark, path)
    kind = suffix_kind(F.col("path"))
    return files.select("path", F.col("length").alias("size"), "modificationTime", kind.alias("kind"), F.when(kind == "text", F.substring(F.decode("content", "UTF-8"), 1, chars)).alias("head"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of all files below a folder; their contents are not read."""
    return _below(spark, path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


PROBE = "struct<format:struct<duration:string,bit_rate:string>,streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,duration:string,r_frame_rate:string>>>"


def probe_summary(probes: DataFrame, js: str = "js", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """First video and audio stream of media-probe JSON, frame rate as a number, and the duration: the container's, or where
    that is absent or blank the video stream's; 0 if what there is is no number (such as N/A). A text "0" is a duration."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    x = probes.select(*keys, F.from_json(js, PROBE).alias("p"))
    first = lambda kind: F.try_element_at(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(1))
    x = x.select(*keys, F.col("p.format").alias("f"), first("video").alias("v"), first("audio").alias("a"))
    rate = F.split("v.r_frame_rate", "/")
    fps = F.when(F.size(rate) == 2, F.try_divide(rate[0].try_cast("double"), rate[1].try_cast("double"))).otherwise(F.col("v.r_frame_rate").try_cast("double"))
    return x.select(
        *keys, F.round(F.coalesce(F.coalesce(blank("f.duration"), blank("v.duration")).try_cast("double"), F.lit(0.0)), 2).alias("duration_s"),
        F.coalesce("v.width", F.lit(0)).cast("long").alias("width"), F.coalesce("v.height", F.lit(0)).cast("long").alias("height"),
        F.col("v.codec_name").alias("vcodec"), F.col("a.codec_name").alias("acodec"), F.col("a").isNotNull().alias("has_audio"), fps.alias("fps"), F.col("f.bit_rate").try_cast("long").alias("bitrate"),
    )


def sections_of(docs: DataFrame, text: str = "doc", keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Texts with ``## `` headings -> one row a section; of equal names in a text the last wins."""
    parts = docs.select(*keys, F.posexplode(F.split(text, r"(?m)^##\s+")).alias("pos", "part")).filter("pos > 0")
    rows = parts.select(*keys, "pos", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("name"), F.trim(F.regexp_extract("part", r"(?s)^[^\n]*\n(.*)$", 1)).alias("body"))
    return rows.groupBy(*keys, "name").agg(F.max(F.struct("pos", "body")).alias("last")).select(*keys, "name", F.col("last.pos").cast("long").alias("pos"), F.col("last.body").alias("body"))


def metrics_wide(values: DataFrame, key: str, name: str, value: str, names: dict[str, str]) -> DataFrame:
    """A long list of metric readings -> one row a key with a column for each known name, renamed."""
    wide = values.groupBy(key).pivot(name, list(names)).agg(F.max(value))
    return wide.select(key, *[F.col(k).alias(v) for k, v in names.items()])
