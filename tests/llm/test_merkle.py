"""The Merkle manifest against a plain recursion."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import types as T

from reelmill.llm import merkle, queries

H = lambda s: sha256(s.encode()).hexdigest()
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def brute(rows):
    """Levels as lists of lists; every proof is read off them."""
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H("".join(field(r[c]) for c in COLUMNS))
    groups = {}
    for r in rows:
        own = leaf(r)
        cut = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        groups.setdefault(r["lang"], []).append((r["doc_id"], own, leaf({**r, "text": lower(r["text"])}) if cut else own))
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def climb(tree, i, said):
        siblings = ""
        for level in tree[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            siblings += "".join(run[: i % 8] + run[i % 8 + 1 :])
            said = H("".join([*run[: i % 8], said, *run[i % 8 + 1 :]]))
            i //= 8
        return siblings, said

    trees = {}
    for v in langs:
        groups[v].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[v] = levels([x[1] for x in groups[v]])
    upper = levels([trees[v][-1][0] for v in langs])
    out = []
    for k, v in enumerate(langs):
        for i, (doc_id, own, said) in enumerate(groups[v]):
            a, folded = climb(trees[v], i, said)
            b, folded = climb(upper, k, folded)
            out.append((doc_id, own, trees[v][-1][0], upper[-1][0], H(a + b), folded, folded == upper[-1][0]))
    return out


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("leaf", T.StringType()), T.StructField("group", T.StringType()), T.StructField("pos", T.StringType())])


def table(spark, rows, parts=5):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "clash", "g", "p") for r in rows], SCHEMA).repartition(parts)


def made(seed, n, langs):
    rng = random.Random(seed)
    rows = [{"doc_id": i * 3, "source": rng.choice(["web", None, ""]), "lang": rng.choice(langs), "n_chars": rng.choice([None, 5, i]), "text": rng.choice([None, "", "Ab Cd", "É Ñ", f"Text {i}", f"plain {i}"])} for i in range(n)]
    rng.shuffle(rows)
    return rows


def same(got, rows):
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))


@pytest.mark.parametrize("levels", range(1, 7))
def test_addresses_are_a_permutation(levels):
    at = np.concatenate([merkle.place(levels, d, np.arange(merkle.RUN**d)) for d in range(levels)])
    assert sorted(at.tolist()) == list(range(merkle.nodes_in(levels)))
    if levels > 1:  # the upper half comes first, then each subtree in one piece
        upper = levels // 2
        assert max(int(merkle.place(levels, d, np.arange(merkle.RUN**d)).max()) for d in range(upper)) < merkle.nodes_in(upper)
        first = merkle.place(levels, levels - 1, np.arange(merkle.RUN ** (levels - 1 - upper)))
        assert first.max() - first.min() < merkle.nodes_in(levels - upper)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 513])
def test_block_is_the_plain_tree(n):
    digests = [H(str(i)).encode() for i in range(n)]
    height = next(h for h in range(5) if 8**h >= n)
    block = merkle.Block.built(digests, height)
    again = merkle.Block.unpacked(block.size, block.height, block.packed())
    level = [d.decode() for d in digests]
    while len(level) > 1:
        level = [H("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    assert block.root.decode() == level[0]
    for i in {0, n // 2, n - 1}:
        assert merkle.fold(digests[i], again.path(i)) == block.root and merkle.path_of(merkle.path_bytes(again.path(i))) == again.path(i)
        assert n == 1 or merkle.fold(b"0" * 64, again.path(i)) != block.root


def test_same_as_plain_recursion(spark):
    rows = made(1, 700, ["en", "de", None, "", "é", "z"])
    rows += [{"doc_id": None, "source": "s", "lang": "en", "n_chars": 1, "text": "Null id"}, {"doc_id": None, "source": None, "lang": None, "n_chars": None, "text": None}]
    rows += [dict(rows[0]) for _ in range(20)] + [{**rows[1], "text": "Other text of the same id"}]  # repeated rows and ties
    rows += [{"doc_id": 999_999, "source": "s", "lang": "alone", "n_chars": 2_000_000, "text": "Long " * 400_000}]
    same(merkle.audit(table(spark, rows)), rows)


@pytest.mark.parametrize("height,n,langs", [(1, 300, ["a", None]), (2, 700, ["a"]), (1, 150, [f"l{i}" for i in range(100)]), (1, 8, ["a"]), (1, 9, ["a"]), (2, 1, [None])])
def test_several_tiers(spark, monkeypatch, height, n, langs):
    """Small blocks, so that groups and the roots of many groups need several tiers. Tasks get the height with the function."""
    rows = made(height * n, n, langs)
    monkeypatch.setattr(merkle, "HEIGHT", height)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(merkle)
    try:
        same(merkle.audit(table(spark, rows)), rows)
    finally:
        cloudpickle.unregister_pickle_by_value(merkle)


def test_empty(spark):
    assert merkle.audit(table(spark, [])).collect() == []


def test_tampering_is_found(spark):
    """Rows whose texts change under lower-casing and that the check tampers with fail, and only they."""
    rows = made(5, 200, ["en", "de"])
    got = {r.doc_id: r for r in merkle.audit(table(spark, rows)).collect()}
    for r in rows:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in r["text"] or "")
        assert got[r["doc_id"]].verified == (not changed)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(queries.queries()["op13_merkle_manifest"](spark, sf), rows)
