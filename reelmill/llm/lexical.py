"""Ranked lexical search: for each item the TOP documents by a BM25 score in whole numbers, out of K2-treaps.

Documents become postings of the items' terms, one row each, in a written table; its counts give the statistics. A task
lays the postings it reads into shards of at most SHARD_POSTINGS, each a grid of terms by documents: a quadtree whose
cells hold which of their four quarters are not empty, where those begin, and the largest impact inside. An item goes
down all rows of its terms at once over ranges of documents: a range's bound is the sum of its cells' largest impacts by
the terms' weights, the ranges of the greatest bounds are split first, several at a time, and a range ends when its bound
(with equal bounds, its least doc_id) cannot beat the item's last place. Places that a task has found in one shard bound
the next. Each task gives its best places alone; those of all tasks are ranked in the end.

Terms' rows lie as far from each other as documents allow, so cells come to hold one term several levels above the leaves.
The weights and the items' terms go to every task. Beyond SHARD_CHARS characters items are dealt out over several passes.

Defined results: null and empty texts have no terms, are not counted and are never found; an item without terms has no
rows; an item's repeated terms count each time; items with one id are ranked each by itself; repeated documents have a
place each; equal scores go by doc_id, a null one last; very long texts are read whole; empty tables give an empty
result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, words
from .bpe import spread

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
SCALE, SATURATION, FLOOR, SHARE = 1000, 12, 75, 25  #: of the score: see impacts()
SHARD_POSTINGS = 1 << 22  #: postings of one grid, or those of one document
SHARD_CHARS = 4_000_000  #: of the items that are searched for in one pass over the documents
SPLIT_AT_ONCE = 512  #: ranges

BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_BELOW = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int64)  #: quarters before q


class Terms(NamedTuple):
    """Distinct terms of some items, ordered by hash."""

    hashes: np.ndarray
    data: np.ndarray  #: their bytes, one after another
    begin: np.ndarray
    size: np.ndarray

    def places(self, block: words.Block) -> tuple[words.Words, np.ndarray, np.ndarray]:
        """The block's words, those that are among the terms, and which; hashes propose, bytes decide."""
        found = words.split(block, BETWEEN)
        h = words.hashes(block, found)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == h) & (self.size[at] == found.ends - found.starts))
        at = at[hit]
        size = self.size[at]
        same = words.LOWER[block.data[spread(found.starts[hit], size)]] == self.data[spread(self.begin[at], size)]
        wrong = np.repeat(np.arange(len(hit)), size)[~same]
        keep = np.ones(len(hit), bool)
        keep[wrong] = False
        return found, hit[keep], at[keep]


def terms_of(texts: list[str]) -> tuple[Terms, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct terms of texts, and for each text which of them it holds and how often."""
    seen: dict[bytes, int] = {}
    lists = []
    for block in words.blocks(pa.array(texts, pa.string())):
        found, lower = words.split(block, BETWEEN), words.LOWER[block.data].tobytes()
        own = [seen.setdefault(lower[i:j], len(seen)) for i, j in zip(found.starts.tolist(), found.ends.tolist())]
        lists += np.split(np.array(own, np.int64), found.first[1:-1])
    terms = list(seen)
    whole = words.Block(0, np.frombuffer(b" ".join(terms), np.uint8), np.array([0, sum(map(len, terms)) + max(len(terms) - 1, 0)]))
    found = words.split(whole, BETWEEN)
    h = words.hashes(whole, found)
    order = np.argsort(h, kind="stable")
    if len(h) and (h[order][1:] == h[order][:-1]).any():
        raise ValueError("two terms of the items have one hash")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Terms(h[order], whole.data, found.starts[order], (found.ends - found.starts)[order]), [np.unique(place[x], return_counts=True) for x in lists]


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A term's whole-number share in a document of n terms, for one unit of the term's weight; under 10**6."""
    length = FLOOR + SHARE * n * documents // max(total, 1)
    return SCALE**3 * tf // (SCALE * tf + SATURATION * length)


def _bits(n: int) -> int:
    return max(n - 1, 0).bit_length()


def _apart(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers with a zero between each two."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


class Treap:
    """A quadtree over a grid of rows by columns whose cells know their largest value. Cells lie level by level; the last
    entry of each array stands for an empty cell."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int):
        self.levels = max(_bits(rows), _bits(columns))
        self.shift = self.levels - _bits(rows)
        key = _apart(row.astype(np.int64) << self.shift) << np.uint64(1) | _apart(column)
        order = np.argsort(key)
        key, peak = key[order], value[order]
        tiers = [(np.zeros(len(key), np.uint8), np.zeros(len(key), np.int64), peak)]
        for _ in range(self.levels):
            above = key >> np.uint64(2)
            begin = np.flatnonzero(np.append(True, above[1:] != above[:-1])) if len(key) else np.zeros(0, np.int64)
            quarter = np.left_shift(np.uint8(1), (key & np.uint64(3)).astype(np.uint8))
            peak = np.maximum.reduceat(peak, begin) if len(begin) else peak
            tiers.append((np.bitwise_or.reduceat(quarter, begin) if len(begin) else quarter, begin, peak))
            key = above[begin]
        mask, begin, peak = zip(*reversed(tiers))
        below = np.cumsum([len(x) for x in mask])  # where the next tier begins
        self.mask = np.append(np.concatenate(mask), np.uint8(0))
        self.begin = np.append(np.concatenate([b + (o if k < self.levels else 0) for k, (b, o) in enumerate(zip(begin, below))]), 0).astype(np.int32)
        self.peak = np.append(np.concatenate(peak), 0).astype(np.int32)

    def top(self, rows: np.ndarray, weights: np.ndarray, k: int, ids: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k greatest sums of weights by values over columns, as (sum, ids[column]), equal sums by ids, best among
        them. Columns ascend by ids; sums are over 0."""
        score, doc = best
        place = rows << self.shift
        cell, bound = np.zeros((1, len(rows)), np.int32), (self.peak[[0]] * weights).sum(keepdims=True)
        level, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.split = 0
        while len(bound):
            # what can still win
            if len(score) == k:
                left = (bound > score[-1]) | (bound == score[-1]) & (ids[np.minimum(first << (self.levels - level), len(ids) - 1)] < doc[-1])
            else:
                left = bound > 0
            cell, bound, level, first = cell[left], bound[left], level[left], first[left]
            if len(bound) > SPLIT_AT_ONCE:
                order = np.argpartition(-bound, SPLIT_AT_ONCE)
                now, later = order[:SPLIT_AT_ONCE], order[SPLIT_AT_ONCE:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            leaf = now[level[now] == self.levels]
            if len(leaf):
                score, doc = np.append(score, bound[leaf]), np.append(doc, ids[first[leaf]])
                order = np.lexsort((doc, -score))[:k]
                score, doc = score[order], doc[order]
            now = now[level[now] < self.levels]
            self.split += len(now)
            own, at = cell[now], level[now]
            mask, begin = self.mask[own], self.begin[own]
            low = 2 * (place >> (self.levels - 1 - at)[:, None] & 1)
            halves = []
            for half in (0, 1):
                quarter = low + half
                child = np.where(mask >> quarter & 1, begin + _BELOW[mask, quarter], -1).astype(np.int32)
                halves.append((child, self.peak[child] @ weights, at + 1, 2 * first[now] + half))
            cell, bound, level, first = (np.concatenate([x[later], *y]) for x, y in zip((cell, bound, level, first), zip(*halves)))
        return score, doc


POSTINGS = "doc_id long, n long, terms array<int>, tf array<int>"


def postings(docs: DataFrame, terms, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n (its terms with repeats), and which of the terms (a broadcast Terms) it holds how often, for every
    document that has any term at all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                found, hit, at = known.places(block)
                pair, tf = np.unique(found.row[hit] * len(known.size) + at, return_counts=True)
                offsets = pa.array(np.searchsorted(pair, np.arange(block.rows + 1) * len(known.size)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair % len(known.size), tf)]
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.rows), pa.array(found.per_row.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(found.per_row > 0))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, POSTINGS)


def frequencies(table: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the terms is; a row for each task and term is shuffled, one for each term comes here."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size).astype(np.int64)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    out = np.zeros(size, np.int64)
    got = table.select("terms").mapInArrow(task, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out[got["term"].to_numpy(np.int64)] = got["df"].to_numpy(np.int64)
    return out


class Queries(NamedTuple):
    numbers: list[int]
    terms: list[np.ndarray]
    counts: list[np.ndarray]
    weights: np.ndarray  #: of each term
    documents: int
    total: int


NULL = np.iinfo(np.int64).max  #: stands for a null doc_id inside a shard


def _search_task(sent, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        places = [none for _ in asked.numbers]

        def shard(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts)
            doc = rows["doc_id"].fill_null(int(NULL)).to_numpy()
            order = np.argsort(doc, kind="stable")
            column = np.empty(len(order), np.int64)
            column[order] = np.arange(len(order))
            lists, tf = (rows[c].combine_chunks() for c in ("terms", "tf"))
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            term, tf = (x.flatten().to_numpy(zero_copy_only=False) for x in (lists, tf))
            value = impacts(tf.astype(np.int64), np.repeat(rows["n"].to_numpy(), size), asked.documents, asked.total)
            treap = Treap(term, np.repeat(column, size), value, len(asked.weights), len(doc))
            ids = doc[order]
            for i, (own, count) in enumerate(zip(asked.terms, asked.counts)):
                places[i] = treap.top(own, asked.weights[own] * count, k, ids, places[i])

        parts, n = [], 0
        for batch in batches:
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            i = 0
            while i < batch.num_rows:
                have = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(ends, have + SHARD_POSTINGS - n, "right")))
                parts.append(batch.slice(i, j - i))
                n += int(ends[j - 1]) - have
                if j < batch.num_rows or n >= SHARD_POSTINGS:
                    shard(parts)
                    parts, n = [], 0
                i = j
        if n:
            shard(parts)
        score, doc = (np.concatenate([x[c] for x in places]) for c in (0, 1))
        item = np.repeat(np.array(asked.numbers, np.int64), [len(x[0]) for x in places])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == NULL), pa.array(score)], ["item_no", "doc_id", "score"])

    return task


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", key: str = "doc_id") -> DataFrame:
    """item_id, item_no (one for each row of items), rank, doc_id, score: each item's k best documents."""
    spark = docs.sparkSession
    shared.ship(spark)
    items = shared.materialize(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("item_no", F.monotonically_increasing_id()), "lexical-items")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = math.ceil(1.5 * chars / SHARD_CHARS) if chars > SHARD_CHARS else 1
    out = None
    for part in range(shards):
        # about SHARD_CHARS characters at most
        own = items.where(F.pmod(F.xxhash64("item_no"), F.lit(shards)) == part).select("item_no", "text").collect()
        terms, lists = terms_of([r.text for r in own])
        if not len(terms.size):
            continue
        table = shared.materialize(postings(docs, spark.sparkContext.broadcast(terms), text, key), "lexical-postings")
        documents, total = table.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = frequencies(table, len(terms.size))
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        some = [(r.item_no, *x) for r, x in zip(own, lists) if len(x[0])]
        asked = spark.sparkContext.broadcast(Queries(*map(list, zip(*some)), weights, documents, total))
        found = shared.materialize(table.mapInArrow(_search_task(asked, k), "item_no long, doc_id long, score long"), "lexical-found")
        shared.drop(table)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, item_no long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items.select("item_no", "item_id"), "item_no").select("item_id", "item_no", "rank", "doc_id", "score")
