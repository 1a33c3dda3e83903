"""Append-only logs as streams: latest metrics, daily usage, current status, abandoned uploads."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only in local mode, where that is unset (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tail(spark: SparkSession, path: str, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A log that grows by files, read as a stream with the columns that it has now."""
    reader = spark.readStream.format(fmt).schema(spark.read.format(fmt).load(path).schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it put out: the last state (complete), or every row
    (append). The table is written by the executors into the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own rows
        (batch.write.mode("overwrite").parquet(out) if mode == "complete" else batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns) if query.lastProgress else spark.createDataFrame([], stream.schema)


def new_base(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def growing(rows: DataFrame, part: Column, parts: int, after: Callable[[str], None]) -> None:
    """A log that grows: the rows of part 0, 1, .. are added to a folder of files one after another, and after(folder) is
    called each time."""
    folder = f"{new_base(rows.sparkSession)}/log"
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(folder)
        after(folder)


def advance(stream: DataFrame, base: str, mode: str, lose_batch: int | None = None) -> list[dict]:
    """Runs a stream over all that has come since base's checkpoint, and gives the progress of its batches. A batch's rows
    go to out/batch=N, whose number is what makes a replay harmless: it replaces its own rows. lose_batch: the run ends
    after this batch is written and before it is committed, as if the driver were lost; the next run replays it."""
    out = f"{base}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == lose_batch:
            raise RuntimeError("lost on purpose")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if "lost on purpose" not in str(e):
            raise
    return [json.loads(p.json) for p in query.recentProgress]


def put_out(stream: DataFrame, base: str, keys: list[str] | None = None) -> DataFrame:
    """What the batches of advance() have put out: all rows, or with keys (update mode) each key's last."""
    spark = stream.sparkSession
    try:
        rows = spark.read.parquet(f"{base}/out")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
    return rows.select(*stream.columns)


def late_rows(stream: DataFrame, base: str, ts: str, closes: Column, late: str) -> None:
    """Keeps apart the rows that come when what they belong to, which closes at a time, is closed already: when that time
    is not after the watermark, the last time of all earlier batches less late. Times seen are kept a row a batch, so the
    watermark outlives a restart. The rows go to late/batch=N."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.agg(F.max(ts).alias("seen")).write.mode("overwrite").parquet(f"{base}/marks/batch={number}")
            seen = spark.read.parquet(f"{base}/marks").where(F.col("batch") < number).agg(F.date_trunc("millisecond", F.max("seen")).alias("seen"))
            cut = seen.select((F.col("seen") - F.expr(f"interval {late}")).alias("__cut")).first()[0]
            some = batch.where(closes <= F.lit(cut)) if cut is not None else batch.limit(0)
            some.write.mode("overwrite").parquet(f"{base}/late/batch={number}")
        finally:
            batch.unpersist()

    stream.writeStream.option("checkpointLocation", f"{base}/late-state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


class UploadState(StatefulProcessor):
    """A bucket of uploads: of each open one when it was created, of how many chunks, and which have come when. An upload's
    time runs from its creation; when it ends, the upload was given up. The bucket's timer is set to the first that ends.
    Complete uploads are forgotten, and so are chunks of what was never created."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # made uploads with creation and total, then all chunks with their upload and time
        self.open = handle.getValueState("open", "made array<long>, created array<long>, total array<long>, upload array<long>, chunk array<long>, time array<long>, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        made, first, timer = self.load()
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64") // 1000
            uploads = [None] * len(part) if key[0] == NO_UPLOAD else part["upload"]
            for upload, kind, chunk, n, t in zip(uploads, part["kind"], part["idx"], part["total"], at):
                if kind == "created":
                    created, total = made.get(upload, (int(t), int(n)))
                    made[upload] = (min(created, int(t)), max(total, int(n)))
                elif kind == "chunk":
                    mine = first.setdefault(upload, {})
                    mine[int(chunk)] = min(int(t), mine.get(int(chunk), int(t)))
        for upload, (created, total) in list(made.items()):
            # what comes later is refused
            first[upload] = {c: t for c, t in first.get(upload, {}).items() if t <= created + self.wait_ms}
            if len(first[upload]) >= total:
                del made[upload], first[upload]
        self.keep(made, first, timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        made, first, timer = self.load()
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for upload, ends in self.ends(made, first).items():
            if ends <= now:
                chunks = first.pop(upload, {})
                if upload in made:
                    created, total = made.pop(upload)
                    out.append((upload, created, ends, len(chunks), total))
        self.keep(made, first, None)  # the timer that has ended is gone by itself
        if out:
            done = pd.DataFrame(out, columns=["upload", "created", "given_up", "received", "total"])
            for c in ("created", "given_up"):
                done[c] = pd.to_datetime(done[c], unit="ms", utc=True).dt.tz_localize(None)
            yield done

    def ends(self, made: dict, first: dict) -> dict:
        return {u: created + self.wait_ms for u, (created, _) in made.items()} | {u: max(c.values()) + self.wait_ms for u, c in first.items() if u not in made}

    def load(self) -> tuple[dict, dict, int | None]:
        made, created, total, upload, chunk, time, timer = self.open.get() or ([], [], [], [], [], [], None)
        first: dict = {}
        for u, c, t in zip(upload, chunk, time):
            first.setdefault(u, {})[c] = t
        return dict(zip(made, zip(created, total))), first, timer

    def keep(self, made: dict, first: dict, timer: int | None) -> None:
        soonest = min(self.ends(made, first).values(), default=None)
        if timer is not None and timer != soonest:
            self.handle.deleteTimer(timer)
        if soonest is None:
            self.open.clear()
            return
        if timer != soonest:
            self.handle.registerTimer(soonest)
        flat = [(u, c, t) for u, chunks in first.items() for c, t in chunks.items()]
        self.open.update((list(made), [c for c, _ in made.values()], [n for _, n in made.values()], *[[x[i] for x in flat] for i in range(3)], soonest))

    def close(self) -> None:
        pass


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PARTS = "spark.sql.shuffle.partitions"
BUCKETS, NO_UPLOAD = 4096, -1  #: of uploads; rows without one have a bucket of their own. A checkpoint is bound to them.


def abandoned_uploads(log: DataFrame, hours: int = 48, late: str = "1 day") -> DataFrame:
    """Uploads that were created and not complete within some hours, once the watermark has passed that time. log: upload
    long, ts, kind (created, chunk), total (of created), idx (of chunk). State holds open uploads alone; it is keyed by
    buckets of uploads with a timer each, as each key costs some calls between Python and the store a batch. Needs a state
    store with timers: run it under with_timers()."""
    out = "upload long, created timestamp, given_up timestamp, received long, total long"
    # no nulls among the numbers, which pandas would make floats
    bucket = F.when(F.col("upload").isNull(), NO_UPLOAD).otherwise(F.pmod(F.xxhash64("upload"), F.lit(BUCKETS))).cast("int")
    return log.withWatermark("ts", late).withColumns({"__bucket": bucket, "upload": F.coalesce("upload", F.lit(0))}).groupBy("__bucket").transformWithStateInPandas(UploadState(hours * 3_600_000), out, "append", "eventTime")


def with_timers(spark: SparkSession, run: Callable[[], list[dict]]) -> list[dict]:
    """Calls run() while streams that start get a state store that has timers, in some parts a core: each part costs a
    Python worker and a store a batch, whatever it holds."""
    parts = str(min(int(spark.conf.get(PARTS)), max(32, 4 * spark.sparkContext.defaultParallelism)))
    before = {k: spark.conf.get(k, None) for k in (ROCKS[0], PARTS)}
    spark.conf.set(*ROCKS)
    spark.conf.set(PARTS, parts)
    try:
        return run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def latest_metrics(log: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """The last reading of each metric; event time decides, so the order of arrival doesn't matter."""
    return log.filter("kind = 'metrics'").groupBy(*keys).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col("ts"))).alias(m) for m in metrics], F.max("ts").alias("measured_ts"))


def usage_daily(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls, failures and tokens by day and job."""
    day = F.window("ts", "1 day")
    out = calls.withWatermark("ts", late).groupBy(day, "job").agg(F.count_if("ok").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.when(F.col("ok"), F.col("tok_in")).otherwise(0)).alias("tok_in"))
    return out.select(F.col("window.start").alias("day"), "job", "calls", "failed", "tok_in")


def status_feed(changes: DataFrame, key: str, restarted: bool = False) -> DataFrame:
    """The current state of each entity; after a restart what was running is queued again."""
    now = changes.groupBy(key).agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.count("*").alias("changes"))
    return now.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status"))) if restarted else now


def idle_sessions(chunks: DataFrame, key: str, gap: str = "48 hours", late: str = "1 day") -> DataFrame:
    """Runs of activity that ended with no more within the gap, whether what was done is complete or not."""
    out = chunks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("chunks"))
    return out.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("given_up"), "chunks")
