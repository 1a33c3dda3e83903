"""Ranked lexical search against scores of every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from reelmill.llm import lexical, words

from .common import frame, lower, sample

TERM = re.compile(lexical.TERM)


def brute(rows, items, k=20):
    """item number, rank, doc_id, score."""
    docs = [(i, Counter(TERM.findall(lower(t)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for number, (_, text) in enumerate(items):
        own = Counter(TERM.findall(lower(text)))
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in own}
        scored = []
        for i, c in docs:
            m = 100 - 25 + 25 * c.total() * n // total
            s = sum(own[t] * w[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(number, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def got(frame_of_results, items):
    rows = frame_of_results.collect()
    number = {n: k for k, n in enumerate(sorted({r.item_no for r in rows}))}
    by = {}
    for r in rows:
        by.setdefault(r.item_no, []).append((r.rank, r.doc_id, r.score))
    return by, number, rows


def same(spark, rows, items, **kw):
    docs = frame(spark, rows)
    asked = spark.createDataFrame([(i, t, "x", 5) for i, t in items], "item_id long, text string, rank string, score int").coalesce(1)
    found = lexical.search(docs, asked, **kw)
    assert found.columns == ["item_id", "item_no", "rank", "doc_id", "score"]
    result = sorted((r.item_no, r["rank"], r.doc_id if r.doc_id is not None else "null", r.score, r.item_id) for r in found.collect())
    wanted = [(n, rank, d if d is not None else "null", s, items[n][0]) for n, rank, d, s in brute(rows, items, kw.get("k", 20))]
    assert result == sorted(wanted)


ITEMS = [(1, "a b"), (2, "Abc dEf-ghi x"), (3, None), (4, ""), (5, "é ñ 漢字"), (1, "a b"), (None, "b a a a"), (7, "nothing that is anywhere 0000"), (8, "!!! ..."), (9, "X" * 3000 + " edited")]


def test_same_as_every_pair(spark):
    rows = [*sample(3, 120), (None, "a b a"), (None, "a"), (5, "a b"), (5, "a b"), (6, "...")]
    texts = [t for _, t in rows if t and len(t) > 50]
    rng = random.Random(5)
    items = ITEMS + [(100 + i, " ".join(rng.choice(texts).split(" ")[:30])) for i in range(15)]
    same(spark, rows, items)
    same(spark, rows, items, k=3)


@pytest.mark.parametrize("postings,at_once,chars", [(50, 2, 4_000_000), (1, 512, 4_000_000), (400, 7, 60)])
def test_small_shards(spark, monkeypatch, postings, at_once, chars):
    """Many grids a task, documents larger than a grid, few ranges split at a time, and several passes for the items."""
    from pyspark import cloudpickle

    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(lexical, "SPLIT_AT_ONCE", at_once)
    monkeypatch.setattr(lexical, "SHARD_CHARS", chars)
    cloudpickle.register_pickle_by_value(lexical)
    try:
        same(spark, sample(8, 90), [x for x in ITEMS if x[1] and len(x[1]) < 100], k=5)
    finally:
        cloudpickle.unregister_pickle_by_value(lexical)


@pytest.mark.parametrize("seed", range(15))
def test_treap(seed):
    """Sums over sparse grids of any shape, with ties, and places found before."""
    rng = np.random.default_rng(seed)
    rows, columns = int(rng.integers(1, 80)), int(rng.integers(1, 300))
    grid = rng.integers(1, 6, (rows, columns)) * (rng.random((rows, columns)) < rng.choice([0.02, 0.3, 1.0]))
    row, column = np.nonzero(grid)
    treap = lexical.Treap(row, column, grid[row, column], rows, columns)
    assert treap.peak[0] == (grid.max() if grid.any() else 0)
    ids = np.sort(rng.choice(10_000, columns, replace=False))
    for _ in range(6):
        own = rng.choice(rows, int(rng.integers(1, rows + 1)), replace=False)
        weights = rng.integers(0, 4, len(own))
        before = np.array([9, 3]), np.array([5, 20_000])
        sums = (grid[own] * weights[:, None]).sum(0)
        wanted = sorted([(-s, i) for s, i in zip(sums.tolist(), ids.tolist()) if s > 0] + [(-9, 5), (-3, 20_000)])[:4]
        score, doc = treap.top(own, weights, 4, ids, before)
        assert [(-s, i) for s, i in zip(score.tolist(), doc.tolist())] == wanted


def test_bounds_save_work(monkeypatch):
    """With one document far above, most ranges are never split."""
    monkeypatch.setattr(lexical, "SPLIT_AT_ONCE", 8)
    rng = np.random.default_rng(0)
    row, column = np.nonzero(rng.random((64, 4096)) < 0.3)
    value = np.where(column == 1234, 900, rng.integers(1, 50, len(row)))
    treap = lexical.Treap(row, column, value, 64, 4096)
    none = np.zeros(0, np.int64)
    score, doc = treap.top(np.arange(20), np.ones(20, np.int64), 1, np.arange(4096), (none, none))
    assert doc.tolist() == [1234] and treap.split < 300


def test_equal_hashes_are_told_apart():
    terms, _ = lexical.terms_of(["abc xyz"])
    block = next(words.blocks(__import__("pyarrow").array(["ABC xyz abd"])))
    assert len(terms.places(block)[1]) == 2
    forged = terms._replace(data=np.frombuffer(b"abd xyz", np.uint8))  # what a word with the hash of abc but other bytes meets
    assert [words.split(block, lexical.BETWEEN).starts[i] for i in forged.places(block)[1]] == [4]


def test_empty(spark):
    docs, items = frame(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs, spark.createDataFrame([(1, None)], "item_id long, text string")).collect() == []
