"""Benchmark decontamination: BM25 inverted index of test items, block-max WAND, then overlap of question and answer.

Items are indexed, training passages are the queries. A posting's impact is the term's BM25 weight in the item divided
by the item's weight against itself, so a score is the share of an item's BM25 mass that a passage covers, and one
threshold serves all items. Passages are windows of twice the longest item's words that step by half, so every
occurrence of an item lies whole inside one.

WAND runs on a block of passages at a time, with arrays: terms whose upper bounds sum to less than half the threshold
open no candidates (the pivot rule); the rest are summed over blocks of postings by the blocks' maxima, and blocks below
the threshold are skipped; items of the blocks left are scored in part, dropped if the closed terms cannot lift them,
and then scored in full. All items at or over the threshold are retrieved, no top k. A retrieved pair counts when the
passage holds at least 0.8 of the item's five-word shingles, and those that it holds cover half of the words of its
question and of its answer. An item's answer is its last sentence, if another stands before it, else its last quarter of words; an item under five
words is one shingle. So a copy with one word changed within is no match if the item has fewer than 29 words: the five
shingles that hold the word are more than a fifth of all.

The index goes to every worker, so its size is bounded: beyond ``SHARD_CHARS`` characters items are dealt out over several
indexes, each built by a task and written as one file into the shared folder. The documents are still read once: a worker
maps the files and holds each block of texts against one index after another. Document frequencies, the number of items,
their mean length and the longest are those of all items, so scores and results don't depend on how items are dealt out.

Defined results: null or empty items match nothing; a null text is an empty one; a very long text is worked on whole, as a
block of its own; repeated documents or items are matched each, items with one id count as the best of them (by score,
then overlaps, which leaves no tie that shows); an empty table on either side gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

SHARD_CHARS = 8_000_000  #: text of one index at most; a longer item has an index of its own
OPEN = 256  #: indexes that a worker keeps mapped
BLOCK_ITEMS = 16  #: items in a block of a posting list
K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE = 5
OVERLAP, PART_OVERLAP = 0.8, 0.5
STOPS = np.frombuffer(b".?!:", np.uint8)  #: what ends a sentence
MIX = np.uint64(0x9E3779B97F4A7C15)


class Index(NamedTuple):
    item_ids: list
    terms: np.ndarray  #: sorted hashes
    top: np.ndarray  #: the largest impact of each term
    wide: np.ndarray  #: terms in more than an eighth of the items
    first: np.ndarray  #: terms+1 offsets into postings
    items: np.ndarray
    impact: np.ndarray
    block_first: np.ndarray  #: terms+1 offsets into blocks
    block: np.ndarray  #: number of each block
    block_top: np.ndarray
    block_at: np.ndarray  #: where each block's postings begin
    shingles: list  #: of each item, in order
    shingle_words: list  #: words in each item's shingles
    answer_at: list  #: the word at which each item's answer begins
    window: int


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        out = words.mix(out * MIX + hashes[i : i + len(out)])
    return out


class Statistics(NamedTuple):
    """Of all items with words: how many, their mean and greatest number of words, and terms with the items they are in."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray  #: sorted hashes, at least those of the index that is built
    df: np.ndarray


def build_index(items: list[tuple[int, str]], known: Statistics | None = None) -> Index | None:
    """The index of some items; known: the statistics of all, if these are not all."""
    ids, kept = [i for i, _ in items], []
    for block in words.blocks(pa.array([t for _, t in items], pa.string())):
        found = words.split(block)
        stops = np.isin(block.data[found.ends - 1], STOPS)
        hashed = zip(np.split(stops, found.first[1:-1]), np.split(words.hashes(block, found), found.first[1:-1]))
        kept += [(ids[block.first + k], s, h) for k, (s, h) in enumerate(hashed) if len(h)]
    if not kept:
        return None
    n = len(kept)
    length = np.array([len(h) for _, _, h in kept])
    item = np.repeat(np.arange(n), length)
    pair, tf = np.unique(np.stack([np.concatenate([h for _, _, h in kept]), item.astype(np.uint64)], 1), axis=0, return_counts=True)
    items_of = pair[:, 1].astype(np.int64)
    terms, of, df = np.unique(pair[:, 0], return_inverse=True, return_counts=True)
    known = known or Statistics(n, float(length.mean()), int(length.max()), terms, df)
    of_all = known.df[np.searchsorted(known.terms, terms)]
    idf = np.log(1 + (known.items - of_all + 0.5) / (of_all + 0.5))
    weight = idf[of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[items_of] / known.mean))
    impact = weight / np.bincount(items_of, weight, n)[items_of]
    first = np.concatenate([[0], np.cumsum(df)])
    # blocks: runs of one term's postings with one number
    number = items_of // BLOCK_ITEMS
    starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (number[1:] != number[:-1])]))
    size = [min(SHINGLE, len(h)) for _, _, h in kept]
    return Index(
        [i for i, _, _ in kept], terms, np.maximum.reduceat(impact, first[:-1]), df > n / 8, first, items_of, impact,
        np.searchsorted(starts, first), number[starts], np.maximum.reduceat(impact, starts), np.append(starts, len(impact)),
        [shingle_hashes(h, k) for (_, _, h), k in zip(kept, size)], size, [_answer_at(s) for _, s, _ in kept], 2 * known.longest,
    )


def _answer_at(stops: np.ndarray) -> int:
    """The word at which an item's answer begins: the last sentence, or the last quarter. stops: words that end one."""
    ends = np.flatnonzero(stops[:-1])
    return min(int(ends[-1]) + 1 if len(ends) else math.ceil(0.75 * len(stops)), len(stops) - 1)


class Lists(NamedTuple):
    """Arrays one after another."""

    flat: np.ndarray
    at: np.ndarray  #: their offsets

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.at[i] : self.at[i + 1]]


class Ids:
    """Numbers of which some are null."""

    def __init__(self, values: np.ndarray, null: np.ndarray):
        self.values, self.null = values, null

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, i: int) -> int | None:
        return None if self.null[i] else int(self.values[i])


PACKED = ("terms", np.uint64), ("top", np.float64), ("wide", np.int64), ("first", np.int64), ("items", np.int64), ("impact", np.float64), ("block_first", np.int64), ("block", np.int64), ("block_top", np.float64), ("block_at", np.int64), ("shingle_words", np.int64), ("answer_at", np.int64)


def packed(index: Index) -> np.ndarray:
    """An index as one array: the window, the lengths of its parts, the parts."""
    sizes = [len(x) for x in index.shingles]
    parts = [np.asarray(getattr(index, name), dtype) for name, dtype in PACKED]
    parts += [np.array([i or 0 for i in index.item_ids], np.int64), np.array([i is None for i in index.item_ids], np.int64)]
    parts += [np.concatenate(index.shingles), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
    return np.concatenate([np.array([index.window, *[len(x) for x in parts]], np.uint64), *[x.view(np.uint64) for x in parts]])


def unpacked(raw: np.ndarray) -> Index:
    n = len(PACKED) + 4
    ends = 1 + n + np.cumsum(raw[1 : 1 + n].astype(np.int64))
    kinds = [dtype for _, dtype in PACKED] + [np.int64, np.int64, np.uint64, np.int64]
    parts = [raw[i:j].view(dtype) for i, j, dtype in zip([1 + n, *ends[:-1].tolist()], ends.tolist(), kinds)]
    named = dict(zip([name for name, _ in PACKED], parts))
    ids, null, flat, at = parts[-4:]
    return Index(item_ids=Ids(ids, null), shingles=Lists(flat, at), window=int(raw[0]), **named | {"wide": named["wide"].astype(bool)})


@lru_cache(OPEN)
def opened(folder: str, shard: int) -> Index:
    return unpacked(shared.map_array(folder, str(shard), np.uint64))


def _terms_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct terms."""
    for batch in batches:
        for block in words.blocks(batch.column("text")):
            found = words.split(block)
            part = np.repeat(batch.column("shard").slice(block.first, block.rows).to_numpy(), found.per_row)
            h = words.hashes(block, found)
            first = np.unique(np.stack([found.row.astype(np.uint64), h]), axis=1, return_index=True)[1] if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(h[first].view(np.int64))], ["shard", "term"])


def _lengths_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words of each item that has some."""
    for batch in batches:
        for block in words.blocks(batch.column("text")):
            n = words.split(block).per_row
            yield pa.RecordBatch.from_arrays([pa.array(n[n > 0])], ["words"])


def spread(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of which, all positions first[w]..first[w+1]: (index into which, position)."""
    size = first[which + 1] - first[which]
    total = np.cumsum(size)
    of = np.repeat(np.arange(len(which)), size)
    return of, np.arange(total[-1] if len(total) else 0) + np.repeat(first[which] - (total - size), size)


def summed(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, of = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(of, x, len(kinds))


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, n_passages: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """passage, item, score of all pairs at or over the threshold. passage, term: the passages' distinct terms, sorted by
    passage."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bound = index.top[term]
    alive = np.bincount(passage, bound, n_passages) >= threshold
    keep = alive[passage]
    passage, term, bound = passage[keep], term[keep], bound[keep]
    if not len(passage):
        return none
    # closed terms: wide ones, smallest bounds first, while they sum to less than half the threshold
    order = np.lexsort((bound, ~index.wide[term], passage))
    passage, term, bound = passage[order], term[order], bound[order]
    total = np.cumsum(bound)
    first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    before = np.repeat(total[first] - bound[first], np.diff(np.append(first, len(passage))))
    closed = index.wide[term] & (total - before < threshold / 2)
    slack = np.bincount(passage[closed], bound[closed], n_passages)
    open_p, open_t = passage[~closed], term[~closed]
    # blocks by their maxima
    n_blocks = len(index.item_ids) // BLOCK_ITEMS + 1
    of, at = spread(index.block_first, open_t)
    key, best = summed(open_p[of] * n_blocks + index.block[at], index.block_top[at])
    key = key[best + slack[key // n_blocks] >= threshold]
    if not len(key):
        return none
    mine = open_p[of] * n_blocks + index.block[at]
    place = np.minimum(np.searchsorted(key, mine), len(key) - 1)
    hit = key[place] == mine
    of, at = of[hit], at[hit]
    inner, post = spread(index.block_at, at)
    n_items = len(index.item_ids)
    pair, part = summed(open_p[of[inner]] * n_items + index.items[post], index.impact[post])
    some = part + slack[pair // n_items] >= threshold - 1e-9
    pair, part = pair[some], part[some]
    if not len(pair):
        return none
    # the closed terms of the pairs left
    wanted = np.zeros(n_passages, bool)
    wanted[pair // n_items] = True
    rest = closed & wanted[passage]
    of, post = spread(index.first, term[rest])
    mine = passage[rest][of] * n_items + index.items[post]
    place = np.minimum(np.searchsorted(pair, mine), len(pair) - 1)
    hit = pair[place] == mine
    part = part + np.bincount(place[hit], index.impact[post[hit]], len(pair))
    some = part >= threshold - 1e-9
    return pair[some] // n_items, pair[some] % n_items, part[some]


def _match_block(index: Index, found: words.Words, h: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """row, item, score, overlap, question overlap, answer overlap. found, h: a block's words and their hashes."""
    first, step = found.first, index.window // 2
    # window j of a row has its words j*step .. j*step+window; each word lies in two windows, or one at the start
    local = np.arange(len(h)) - first[found.row]
    per_row = np.maximum((found.per_row + step - 1) // step, 1)
    base = np.cumsum(per_row) - per_row
    place = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[place] == h)
    late = base[found.row[hit]] + local[hit] // step
    early = late - 1
    inside = local[hit] >= step
    passage = np.concatenate([late, early[inside]])
    term = np.concatenate([place[hit], place[hit][inside]])
    n_terms = len(index.terms)
    distinct = np.unique(passage * n_terms + term)
    p, item, score = retrieve(index, distinct // n_terms, distinct % n_terms, int(per_row.sum()), threshold)
    row = np.searchsorted(base, p, "right") - 1
    out = []
    for r, j, i, s in zip(row.tolist(), (p - base[row]).tolist(), item.tolist(), score.tolist()):
        lo = first[r] + j * step
        got = h[lo : min(lo + index.window, first[r + 1])]
        k, answer = index.shingle_words[i], index.answer_at[i]
        held = np.isin(index.shingles[i], shingle_hashes(got, k))
        covered = np.convolve(held, np.ones(k, int)) > 0
        out.append((r, i, s, held.mean(), covered[:answer].mean() if answer else 1.0, covered[answer:].mean()))
    return tuple(np.array(x) for x in zip(*out)) if out else ()


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap: one row for each document and item it holds."""
    spark = docs.sparkSession
    shared.ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    if chars > SHARD_CHARS:
        folder = shared.new_folder(spark, "decontaminate-index")
        shards = write_indexes(items, math.ceil(1.5 * chars / SHARD_CHARS), folder)
        return rows.mapInArrow(shared.lean(_task(partial(_mapped, folder, shards), threshold)), schema)
    index = build_index([(r.item_id, r.text) for r in items.collect()])  # SHARD_CHARS characters at most
    if index is None:
        return spark.createDataFrame([], schema)
    return rows.mapInArrow(shared.lean(_task(partial(_sent, spark.sparkContext.broadcast(index)), threshold)), schema)


def write_indexes(items: DataFrame, shards: int, folder: str) -> list[int]:
    """Deals items (item_id, text) out over indexes, writes each as a file of the folder, and says which there are. An
    index is one task's, about two thirds of SHARD_CHARS characters or one longer item; what is collected is its number."""
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    terms = shared.materialize(items.select("shard", "text").mapInArrow(_terms_task, "shard long, term long"), "decontaminate-terms")
    once = items.select("text").mapInArrow(_lengths_task, "words long").agg(F.count("*").alias("n"), F.avg("words").alias("mean"), F.max("words").alias("longest")).first()
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    own = terms.distinct().join(df, "term").select("shard", "term", "df")

    def build(texts: pa.Table, known: pa.Table) -> pa.Table:
        if not len(texts) or not len(known):
            return pa.table({"shard": pa.array([], pa.int64())})
        term = known.column("term").to_numpy().view(np.uint64)
        order = np.argsort(term, kind="stable")
        of_all = Statistics(once.n, once.mean, once.longest, term[order], known.column("df").to_numpy()[order])
        index = build_index(list(zip(texts.column("item_id").to_pylist(), texts.column("text").to_pylist())), of_all)
        shard = texts.column("shard")[0].as_py()
        shared.write_array(folder, str(shard), packed(index))
        return pa.table({"shard": [shard]})

    made = items.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(build, "shard long").collect()
    shared.drop(terms)
    return sorted(r.shard for r in made)


def _mapped(folder: str, shards: list[int]) -> Iterator[Index]:
    return (opened(folder, shard) for shard in shards)


def _sent(index) -> list[Index]:
    return [index.value]


def _task(indexes, threshold: float):
    """indexes: gives them one after another."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for block in words.blocks(batch.column("text")):
                found = words.split(block)
                best = _best(indexes(), found, words.hashes(block, found), threshold)
                if best:
                    row = pa.array([block.first + r for r, _ in best])
                    values = list(zip(*best.values()))
                    yield pa.RecordBatch.from_arrays([ids.take(row), pa.array([i for _, i in best], pa.int64()), *[pa.array(v, pa.float64()) for v in values]], ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

    return task


def _best(indexes: Iterable[Index], found: words.Words, h: np.ndarray, threshold: float) -> dict:
    """(row, item_id): the best score and overlaps of the items with that id, in whichever index they are."""
    best: dict = {}
    for index in indexes:
        for r, i, s, total, q, a in zip(*[x.tolist() for x in _match_block(index, found, h, threshold)]):
            if total >= OVERLAP and q >= PART_OVERLAP and a >= PART_OVERLAP:
                k = (int(r), index.item_ids[int(i)])
                best[k] = max(best.get(k, (0.0,)), (s, total, q, a))
    return best


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows that hold an item."""
    docs, number = shared.with_rows(docs)
    found = leaks(docs, benchmark, text, number).select(F.col("doc_id").alias(number)).distinct()
    return docs.join(found, number, "left_anti").drop(number)
