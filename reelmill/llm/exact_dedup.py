"""Exact de-duplication through sharded cuckoo-filter indexes of live digests.

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Each text becomes a
SHA-256 digest plus a second content check (xxhash64 and length). Rows go through a cuckoo index twice: once inside each
input partition, which folds local copies before anything is shuffled, and once in the shard that owns the digest. So a
group of copies, however large, reaches its shard as one row for each input partition.

Local indexes are put out and begun anew at SHARD_ROWS digests, and there are as many shards as rows divided by that, so what
a task holds does not grow with the corpus. In an index a filter slot holds a 16-bit fingerprint; next to it the bucket holds the number of the stored key. A
fingerprint hit counts only after the whole stored digest (SHA-256) and content check agree. When an insertion finds no slot the
table doubles and is filled again from the stored keys. Digests can be deleted: ``apply_changes`` keeps a written index
up to date as documents come and go.

Defined results: a null text is an empty one; empty texts are equal to each other; a very long text is one digest like
any other; of equal texts the row with most code
points stays, then the smallest id (a null id comes last), then the first row read, so of rows repeated in full exactly
one is kept; an empty table gives an empty result; other columns are carried or ignored and never read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, materialize, with_rows

SLOTS = 4
MAX_KICKS = 200
INDEX_SCHEMA = "digest binary, check long, n_rows long, keep_chars long, keep_id long, keep_row long"


class CuckooIndex:
    """Digests with a payload each; the filter answers first, the bucketed keys decide."""

    def __init__(self, capacity: int = 1024):
        self.keys: list = []
        self.payloads: list = []
        self.free: list[int] = []
        self.resizes = 0
        self._clear(max(2, 1 << max(1, (capacity // 3).bit_length())))

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.entry = array("q", bytes(8 * SLOTS * buckets))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 3) & (self.buckets - 1))

    def _find(self, key) -> int:
        """The slot of a key, or -1; a fingerprint hit is verified against the stored key."""
        mark, one, two = self._places(key[0])
        prints = self.prints
        for bucket in (one, two):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if prints[slot] == mark and self.keys[self.entry[slot]] == key:
                    return slot
        return -1

    def get(self, key):
        slot = self._find(key)
        return None if slot < 0 else self.payloads[self.entry[slot]]

    def put(self, key, payload) -> None:
        slot = self._find(key)
        if slot >= 0:
            self.payloads[self.entry[slot]] = payload
            return
        if self.free:
            number = self.free.pop()
            self.keys[number], self.payloads[number] = key, payload
        else:
            number = len(self.keys)
            self.keys.append(key)
            self.payloads.append(payload)
        if not self._place(number):
            self._grow()

    def _place(self, number: int) -> bool:
        mark, bucket, two = self._places(self.keys[number][0])
        for at in (bucket, two):
            for slot in range(SLOTS * at, SLOTS * at + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entry[slot] = mark, number
                    return True
        for kick in range(MAX_KICKS):
            slot = SLOTS * bucket + kick % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.entry[slot], number = number, self.entry[slot]
            bucket = self._other(bucket, mark)
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entry[slot] = mark, number
                    return True
        return False

    def _grow(self) -> None:
        """Overflow: a table of twice the size, filled from the stored keys."""
        gone = set(self.free)
        while True:
            self.resizes += 1
            self._clear(2 * self.buckets)
            if all(self._place(i) for i in range(len(self.keys)) if i not in gone):
                return

    def delete(self, key) -> bool:
        slot = self._find(key)
        if slot < 0:
            return False
        number = self.entry[slot]
        self.prints[slot] = 0
        self.keys[number] = self.payloads[number] = None
        self.free.append(number)
        return True

    def items(self):
        return ((k, p) for k, p in zip(self.keys, self.payloads) if k is not None)


def _better(a: tuple, b: tuple) -> tuple:
    """(chars, id, row): more characters, then the smaller id, then the earlier row."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return a if rank(a) <= rank(b) else b


def _fold(index: CuckooIndex, batch: pa.RecordBatch, sign: int = 1) -> None:
    for digest, check, n, chars, doc, row in zip(*(batch.column(c).to_pylist() for c in ("digest", "check", "n_rows", "keep_chars", "keep_id", "keep_row"))):
        key = (digest, check)
        old = index.get(key)
        if sign > 0:
            index.put(key, (n, chars, doc, row) if old is None else (old[0] + n, *_better(old[1:], (chars, doc, row))))
        elif old is not None:
            if old[0] > n:
                index.put(key, (old[0] - n, *old[1:]))
            else:
                index.delete(key)


def _rows(index: CuckooIndex, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary(), *[pa.int64()] * 5]
    names = ["digest", "check", "n_rows", "keep_chars", "keep_id", "keep_row"]
    rows = []
    for key, payload in index.items():
        rows.append((*key, *payload))
        if len(rows) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _local_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _index_task(batches, False)


def _index_task(batches: Iterator[pa.RecordBatch], final: bool = True) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        _fold(index, batch)
        if not final and len(index) >= SHARD_ROWS:  # copies that meet no more here meet in their shard
            yield from _rows(index)
            index = CuckooIndex()
    yield from _rows(index)


def _change_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of op: what is there, deletions, insertions."""
    index = CuckooIndex()
    for batch in batches:
        for run in (0, 1, 2):
            part = batch.filter(pc.equal(batch.column("op"), run))
            if part.num_rows:
                _fold(index, part, -1 if run == 1 else 1)
    yield from _rows(index)


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """row, id, code points, digest and content check of every row, in narrow columns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    norm = F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")
    docs, number = with_rows(docs)
    return docs.select(F.col(number).alias("row"), F.col(key).cast("long").alias("doc_id"), F.length(whole).cast("long").alias("chars"), norm.alias("norm")).select(
        "row", "doc_id", "chars", F.unhex(F.sha2("norm", 256)).alias("digest"), (F.xxhash64("norm") + F.length("norm")).alias("check")
    )


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select("digest", "check", F.lit(1).cast("long").alias("n_rows"), F.col("chars").alias("keep_chars"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))


SHARD_ROWS = 1_000_000  #: rows for each index, about, so that is the most digests that a task holds


def shards_for(spark: SparkSession, rows: int) -> int:
    """Indexes for so many rows; Spark's own number of shuffle partitions where that is enough."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARD_ROWS))


def build_index(rows: DataFrame, count: int | None = None) -> DataFrame:
    """One row for each live digest of keyed() rows: how many rows have it, and which of them stays. count: of the rows, if
    it is known without reading them."""
    local = _entries(rows).mapInArrow(lean(_local_task), INDEX_SCHEMA)
    shards = shards_for(rows.sparkSession, rows.count() if count is None else count)
    return local.repartition(shards, "digest").mapInArrow(lean(_index_task), INDEX_SCHEMA)


def apply_changes(index: DataFrame, live: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after keyed() rows leave and others come. live: the keyed() rows that index stands for. A digest goes when
    its last row does. Where the row that stays is among the deleted ones, the best of those left takes its place: only
    such digests' rows are looked up in live, by narrow rows and partial counts."""
    tag = lambda df, op: df.withColumn("op", F.lit(op))
    all_rows = tag(index, 0).unionByName(tag(_entries(deleted), 1)).unionByName(tag(_entries(inserted), 2))
    shards = shards_for(index.sparkSession, index.count() + inserted.count())
    changed = materialize(all_rows.repartition(shards, "digest").sortWithinPartitions("op").mapInArrow(_change_task, INDEX_SCHEMA), "dedup-index")
    same = ["digest", "check", "chars", "doc_id"]
    lost = _lost(index, deleted)
    count = lambda df, sign: df.select(*same, "row", F.lit(sign).alias("d"))
    left = count(live, 1).unionByName(count(deleted, -1)).unionByName(count(inserted, 1)).join(lost, ["digest", "check"], "left_semi")
    left = left.groupBy(*same).agg(F.sum("d").alias("n"), F.min(F.when(F.col("d") > 0, F.col("row"))).alias("row")).filter("n > 0")
    best = left.groupBy("digest", "check").agg(F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    new = lambda c, x: F.when(F.col("best").isNull(), F.col(c)).otherwise(x).alias(c)
    return changed.join(best, ["digest", "check"], "left").select("digest", "check", "n_rows", new("keep_chars", -F.col("best.less")), new("keep_id", F.col("best.doc_id")), new("keep_row", F.col("best.row")))


def _lost(index: DataFrame, deleted: DataFrame) -> DataFrame:
    """digest, check of the index rows whose representative is among the deleted rows (one with its id and size is)."""
    kept = index.select("digest", "check", F.struct("keep_chars", "keep_id").alias("kept"))
    gone = deleted.select("digest", "check", F.struct(F.col("chars").alias("keep_chars"), F.col("doc_id").alias("keep_id")).alias("gone")).distinct()
    return kept.join(gone, ["digest", "check"]).filter(F.col("kept").eqNullSafe(F.col("gone"))).select("digest", "check").distinct()


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    rows = materialize(keyed(docs, text, key), "dedup-rows")
    index = build_index(rows)
    # one index row a digest; the rows of a very large group are split by AQE's skew join
    return rows.join(index, ["digest", "check"]).select(
        "row", "doc_id", "keep_id", F.col("n_rows").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept."""
    docs, number = with_rows(docs)
    whole = F.coalesce(F.col(text), F.lit(""))
    norm = F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")
    rows = docs.select(F.col(number).alias("row"), F.col(key).cast("long").alias("doc_id"), F.length(whole).cast("long").alias("chars"), F.unhex(F.sha2(norm, 256)).alias("digest"), (F.xxhash64(norm) + F.length(norm)).alias("check"))
    return docs.join(build_index(rows, docs.count()).select(F.col("keep_row").alias(number)), number, "left_semi").drop(number)
