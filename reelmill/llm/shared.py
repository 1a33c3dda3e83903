"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers of a session that was not started where they can import it anyway."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    context = spark.sparkContext
    if root in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) or getattr(context, "_reelmill_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="spark-package-")
    context.addPyFile(shutil.make_archive(f"{folder}/{os.path.basename(package)}", "zip", root, os.path.basename(package)))
    context._reelmill_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only in local mode, where that is unset (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    _made.append(path)
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for files that tasks write; sweep() deletes it like a table."""
    path = new_path(spark, name)
    _made.append(path)
    return path


_made: list[str] = []  #: tables and folders that are in use, and that nothing has deleted


def free_name(df: DataFrame, name: str = "__row") -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


NO_HOST = "^([^:/]*):///"  #: file:///a and file:/a name one file


def _is_scan(df: DataFrame) -> bool:
    """Whether df is one scan of files, each read once, with projections and filters alone."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    if not node.children().isEmpty() or not df.inputFiles() or node.getClass().getSimpleName() != "LogicalRelation":
        return False
    paths = node.relation().location().rootPaths()
    roots = sorted(re.sub(NO_HOST, r"\1:/", paths.apply(i).toString()).rstrip("/") + "/" for i in range(paths.size()))
    return not any(b.startswith(a) for a, b in zip(roots, roots[1:]))  # a path that is listed twice, or within another


FILE_BITS, PLACE_BITS = 24, 39  #: of a row's number: its file's place in the sorted list of files, its own place there


def _scattered(number: Column) -> Column:
    """A permutation of 64-bit numbers (xor with shifts of itself), so that neighbours don't follow each other."""
    number = number.bitwiseXOR(F.shiftleft(number, 13))
    number = number.bitwiseXOR(F.shiftrightunsigned(number, 7))
    return number.bitwiseXOR(F.shiftleft(number, 17))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    path, place = free_name(df, "__path"), free_name(df, "__place")
    placed = df.select("*", F.regexp_replace("_metadata.file_path", NO_HOST, "$1:/").alias(path), F.col("_metadata.row_index").alias(place))
    files = sorted({re.sub(NO_HOST, r"\1:/", f) for f in df.inputFiles()})
    if len(files) >= 1 << FILE_BITS:
        raise ValueError(f"{len(files)} files are more than row numbers have room for")
    at = pa.table({path: pa.array(files, pa.string()), name: pa.array(range(len(files)), pa.int64())})
    # one short row a file, of the list that the driver's own file index holds
    joined = placed.join(F.broadcast(df.sparkSession.createDataFrame(at)), path, "left")
    known = F.coalesce(F.col(name), F.raise_error(F.concat(F.lit("not among the files of the scan: "), F.col(path))).cast("long"))
    return joined.withColumn(name, _scattered(F.shiftleft(known, PLACE_BITS).bitwiseOR(F.col(place)))).drop(path, place)


def with_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a number for each row in a column of a free name, and that name. No two rows share one, and it stays the
    same in every plan, however partitions are cut and whichever executors are lost: it is made of the file's place in
    the list of files and the row's place in the file. What is not a plain scan of files is written first. (Numbers of a
    partition and a place in it change when Spark cuts a small scan anew for other cores.)"""
    ship(df.sparkSession)
    name = free_name(df)
    if not _is_scan(df):
        df = materialize(df, "rows")
    try:
        return _numbered(df, name), name
    except AnalysisException:  # the scan's own columns are hidden behind a projection
        return _numbered(materialize(df, "rows"), name), name


def drop(df: DataFrame) -> None:
    """Deletes a table made by materialize() which no later plan reads."""
    path = getattr(df, "_shared_path", None)
    if path:
        remove(df.sparkSession, path)
        if path in _made:
            _made.remove(path)


def tables_made() -> int:
    return len(_made)


def sweep(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Deletes the tables written after the first since of tables_made(), except the one that keep reads."""
    mine = getattr(keep, "_shared_path", None)
    for path in [p for p in _made[since:] if p != mine]:
        remove(spark, path)
        _made.remove(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more, rather than at its next
    collection, which on a large heap may be far off. What the first collection finds lets go of more for the second."""
    pa.default_memory_pool().release_unused()
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """task, whose worker gives what it freed back to the system at the end. A worker lives on from stage to stage, and
    would keep the most that any of them took beside the executor's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may be another than glibc
        if trim:
            trim(0)

    return run


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """From a task: a raw array file, put in place by a rename, so a repeated task does no harm."""
    part = urlparse(folder)
    if part.scheme in ("", "file"):
        os.makedirs(part.path, exist_ok=True)
        temp = f"{part.path}/.{name}-{uuid.uuid4().hex}"
        values.tofile(temp)
        os.replace(temp, f"{part.path}/{name}")
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    temp = f"{base}/.{name}-{uuid.uuid4().hex}"
    store.create_dir(base, recursive=True)
    with store.open_output_stream(temp) as out:
        out.write(values.tobytes())
    store.move(temp, f"{base}/{name}")


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    """In a task: the array memory-mapped. From a store without local paths it is copied to an unlinked temporary file first."""
    part = urlparse(folder)
    if part.scheme in ("", "file"):
        path = f"{part.path}/{name}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/{name}") as src, tempfile.NamedTemporaryFile() as local:
        size = 0
        while block := src.read(1 << 22):
            local.write(block)
            size += len(block)
        local.flush()
        return np.memmap(local.name, dtype, "r") if size else np.empty(0, dtype)
