"""Writers: appended events, replaced entities, subtitle texts, numbered reports."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cue_time


MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def append_events(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Adds event rows to a log; nothing written before changes. Times keep their microseconds."""
    rows.write.mode("append").format(fmt).options(**(MICROS if fmt == "json" else {})).save(path)


def by_tasks(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key over some tasks a core, for writers that make a file a row or so: Spark itself sizes tasks by
    bytes, and would write any number of small files in one. They are dealt out by a hash of the key: where rows lie by the key
    in as many parts already, as after grouping, Spark would drop this step and put its parts together by bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(key))


NO_KEY = "__HIVE_DEFAULT_PARTITION__"  #: in the name of a null key's folder, as Spark's writers have it


def write_files(rows: DataFrame, key: str, path: str, fmt: str = "text") -> None:
    """A file a row, below path/key=value. rows: key, distinct and of plain characters (a number), and a text's one column,
    or a JSON object's fields. In a store of local files Spark's writers start a process for each file, its checksum and its
    folder to set their modes, which takes nearly all of the time; there tasks write the files themselves, each put in place
    by a rename under a name that a repeated task gives it again."""
    rest = [c for c in rows.columns if c != key]
    store = urlparse(path)
    if store.scheme not in ("", "file"):
        by_tasks(rows, key).write.partitionBy(key).format(fmt).save(path)
        return
    top, suffix = unquote(store.path) if store.scheme else path, {"text": "txt", "json": "json"}[fmt]
    line = F.col(rest[0]) if fmt == "text" else F.to_json(F.struct(*rest))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, seen = f"part-{TaskContext.get().partitionId():05d}.{suffix}", set()
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k in seen:
                    raise ValueError(f"two rows of {key}={k}")
                seen.add(k)
                folder = f"{top}/{key}={k}"
                os.makedirs(folder, exist_ok=True)
                temp = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with open(temp, "wb") as out:
                    out.write(v.encode() + b"\n")
                os.replace(temp, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([len(seen)], pa.int64())], ["files"])

    os.makedirs(top, exist_ok=True)  # without rows the folder is there too
    named = by_tasks(rows, key).select(F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY)).alias("key"), F.coalesce(line, F.lit("")).alias("line"))
    named.mapInArrow(task, "files long").write.format("noop").mode("overwrite").save()


def latest_entities(versions: DataFrame, key: str, version: str) -> DataFrame:
    """Current records of an entity log: the row of the highest version of each key."""
    rest = [c for c in versions.columns if c not in (key, version)]
    return versions.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("r")).select(key, "r.*")


def append_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> None:
    """Adds what a stream has since its checkpoint to a log, each row once: the sink's own log of finished batches makes a
    batch that is run again count once."""
    stream.writeStream.format(fmt).options(**(MICROS if fmt == "json" else {})).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def folded_entities(events: DataFrame, key: str, order: list[str], fields: list[str], lists: list[str]) -> DataFrame:
    """Current records from their events, in the order of version and place: key, the last value set of each field, and
    each list: its last setting and what was appended after that. events: key, order, op (create, set, append), field,
    value, items (of a set list). A record is there from its first creation on; what comes before is ignored, as it is for
    keys that were never created. Events that tie in order go by their values."""
    at = F.struct(*order)
    of = lambda op, name: (F.col("op") == op) & (F.col("field") == name)
    sums = [F.min(F.when(F.col("op") == "create", at)).alias("__made")]
    sums += [F.max(F.when(of("set", f), F.struct(at.alias("at"), "value"))).alias(f"__f_{f}") for f in fields]
    sums += [F.max(F.when(of("set", f), F.struct(at.alias("at"), "items"))).alias(f"__s_{f}") for f in lists]
    sums += [F.array_sort(F.collect_list(F.when(of("append", f), F.struct(at.alias("at"), "value")))).alias(f"__a_{f}") for f in lists]
    x = events.groupBy(key).agg(*sums).where("__made is not null")
    made = F.col("__made")
    scalar = [F.when(F.col(f"__f_{f}.at") >= made, F.col(f"__f_{f}.value")).alias(f) for f in fields]
    none = F.array().cast("array<string>")

    def whole(f: str):
        set_at = F.when(F.col(f"__s_{f}.at") >= made, F.col(f"__s_{f}.at"))
        later = F.filter(f"__a_{f}", lambda e: (e["at"] >= made) & (set_at.isNull() | (e["at"] > set_at)))
        return F.concat(F.when(set_at.isNotNull(), F.coalesce(F.col(f"__s_{f}.items"), none)).otherwise(none), F.transform(later, lambda e: e["value"])).alias(f)

    return x.select(key, *scalar, *[whole(f) for f in lists])


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that rows touch."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def subtitle_text(cues: DataFrame, key: str) -> DataFrame:
    """One subtitle text a key from its cues (pos, start_ms, end_ms, text); blank cues are left out, their number too."""
    line = F.concat_ws("\n", F.col("pos").cast("string"), F.concat(cue_time(F.col("start_ms")), F.lit(" --> "), cue_time(F.col("end_ms"))), F.col("text"), F.lit(""))
    good = cues.filter(F.trim("text") != "").select(key, F.struct("pos", line.alias("line")).alias("x"))
    return good.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("value"))  # as many as a clip has cues


def write_subtitles(cues: DataFrame, key: str, path: str) -> None:
    subtitle_text(cues, key).write.mode("overwrite").partitionBy(key).text(path)


def numbered_report(rows: DataFrame, key: str, order: str, line) -> DataFrame:
    """One text a key: "1. ...", "2. ..." in the given order."""
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))).alias("x"))
    return got.select(key, F.array_join(F.transform("x", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n").alias("report"))
