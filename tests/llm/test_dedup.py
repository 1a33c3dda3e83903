import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from reelmill.llm import components, decontaminate, exact_dedup, jaccard_join, suffix_dedup, words as W

from .common import frame, sample, words

GAP = re.compile(r"[\x20\x09-\x0D]")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[GAP.sub("", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}


def test_exact_dedup(spark):
    rows = sample()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert got == brute_exact(rows)


def test_exact_dedup_of_repeated_and_null_ids(spark):
    got = exact_dedup.exact_dedup(frame(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")])).collect()
    assert sorted((str(r.doc_id), r.group_size) for r in got) == [("1", 3), ("1", 3), ("None", 2), ("None", 2), ("None", 3)]
    assert sum(r.kept for r in got) == 2 and {r.keep_id for r in got if r.group_size == 3} == {1}
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(frame(spark, [(1, "a"), (1, "a"), (2, "A")])).count() == 2


def test_cuckoo_index_grows_deletes_and_verifies():
    index, keys = exact_dedup.CuckooIndex(8), [(hashlib.sha256(str(i).encode()).digest(), i) for i in range(5000)]
    for k in keys:
        index.put(k, k[1])
    assert index.resizes > 3 and len(index) == 5000
    assert all(index.get(k) == k[1] for k in keys)
    same_print = (keys[0][0][:10] + b"\0" * 22, 0)  # the same fingerprint and buckets, another digest
    assert index.get(same_print) is None and not index.delete(same_print)
    assert all(index.delete(k) for k in keys[::2]) and len(index) == 2500
    assert all((index.get(k) is None) == (k[1] % 2 == 0) for k in keys)
    for k in keys[::2]:
        index.put(k, -1)
    assert len(index) == 5000 and index.get(keys[4]) == -1


def test_shards_follow_the_rows(spark, monkeypatch):
    """Small indexes: local ones are begun anew, and there are more of them than Spark's own partitions."""
    from pyspark import cloudpickle

    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 10)
    cloudpickle.register_pickle_by_value(exact_dedup)
    try:
        rows = exact_dedup.keyed(frame(spark, [(i, f"t{i % 100}") for i in range(300)]))
        index = exact_dedup.build_index(rows)
        assert index.rdd.getNumPartitions() == 30 and sorted(r.n_rows for r in index.collect()) == [3] * 100
    finally:
        cloudpickle.unregister_pickle_by_value(exact_dedup)


def test_index_changes(spark):
    keyed = lambda rows: exact_dedup.keyed(frame(spark, rows))
    live = keyed([(1, "a"), (2, "a"), (3, "b"), (6, "d"), (6, "d"), (7, "d "), (8, "e"), (None, "e")])
    index = exact_dedup.build_index(live)
    after = exact_dedup.apply_changes(index, live, keyed([(4, "c"), (5, "a"), (9, "d")]), keyed([(1, "a"), (3, "b"), (7, "d "), (8, "e")]))
    # a: 1 gave way to 2; b went; d: 7, the longest, gave way to 6, which is there twice; e: the row without an id is left
    assert sorted((r.n_rows, r.keep_chars, str(r.keep_id)) for r in after.collect()) == [(1, 1, "4"), (1, 1, "None"), (2, 1, "2"), (3, 1, "6")]
    again = exact_dedup.apply_changes(index, live, keyed([]), keyed([(6, "d"), (2, "a")]))
    assert sorted((r.n_rows, str(r.keep_id)) for r in again.collect()) == [(1, "1"), (1, "3"), (2, "7"), (2, "8")]


def test_columns_named_like_the_row_numbers(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 6), (1, "a b c d e f", 5, 6), (2, "x", 5, 6)], "doc_id long, text string, __row long, ___ROW long")
    for fn in (exact_dedup.drop_exact_copies, jaccard_join.drop_near_copies):
        assert sorted(tuple(r) for r in fn(docs).collect()) == [(1, "a b c d e f", 5, 6), (2, "x", 5, 6)]
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.drop_leaks(docs, items).collect()] == [(2, "x", 5, 6)]


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_components(spark, k, num, den):
    rows = sample(3, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows), k, num, den).collect()}
    assert got == brute_components(rows, k, num, den)


def chain(n, size, seed=0):
    """Texts in which each differs a little from the one before, so the ends of the chain have little in common; and
    texts that share the words of the chain without linking to it."""
    rng = random.Random(seed)
    w = [f"w{i}" for i in range(size)]
    out = []
    for i in range(n):
        w = list(w)
        w[rng.randrange(size)] = f"v{i}"
        out.append(" ".join(w))
    out += [" ".join(w[: size * 2 // 3] + [f"u{i}_{j}" for j in range(size // 3)]) for i in range(n // 4)]
    return list(enumerate(out))


def test_jaccard_blocks_in_chunks(spark, monkeypatch):
    rows = chain(60, 80)
    monkeypatch.setattr(jaccard_join, "OFTEN", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows), 3, 9, 10).collect()}
    assert got == brute_components(rows, 3, 9, 10)


def test_jaccard_blocks_of_many_sizes(spark, monkeypatch):
    """One frequent line holds texts of all sizes in one block; links cross the bands' edges."""
    rng, line = random.Random(8), " ".join(f"line{i}" for i in range(12))
    rows = []
    for i in range(60):
        w = [f"x{i}_{j}" for j in range(rng.randint(1, 60))]
        rows += [line + " " + " ".join(w), line + " " + " ".join(w[:-1]), " ".join(w + [f"y{i}_{j}" for j in range(len(w) // 9)]) + " " + line]
    monkeypatch.setattr(jaccard_join, "OFTEN", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 9)
    for k, num, den in ((3, 9, 10), (5, 4, 5), (2, 1, 1)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, list(enumerate(rows))), k, num, den).collect()}
        assert got == brute_components(list(enumerate(rows)), k, num, den)


@pytest.mark.parametrize("sketched", [16, 8192])
def test_jaccard_texts_that_only_share_a_line_meet_by_sketches(spark, monkeypatch, sketched):
    """A frequent line routes all texts to one block; only those that may link are dealt out as texts."""
    line, rows = " ".join(f"line{i}" for i in range(60)), []
    for i in range(120):
        w = [f"x{i}_{j}" for j in range(6)]
        rows += [line + " " + " ".join(w)] + [line + " " + " ".join(w[:-1])] * (i % 10 == 0)
    monkeypatch.setattr(jaccard_join, "OFTEN", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 9)
    monkeypatch.setattr(jaccard_join, "SKETCHED", sketched, raising=False)
    links, dealt = jaccard_join._links, []
    monkeypatch.setattr(jaccard_join, "_links", lambda members, *rest: dealt.append(members.count()) or links(members, *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, list(enumerate(rows))), 3, 9, 10).collect()}
    assert got == brute_components(list(enumerate(rows)), 3, 9, 10)
    assert sum(dealt) < len(rows)


def test_sketches_never_hide_a_link():
    rng = np.random.default_rng(4)
    items = [np.unique(rng.integers(0, 1 << 62, int(s), dtype=np.uint64)) for s in rng.integers(20, 400, 60)]
    items += [np.unique(np.concatenate([x[len(x) // 20 :], rng.integers(0, 1 << 62, len(x) // 40, dtype=np.uint64)])) for x in items]
    items += [np.arange(99_000, dtype=np.uint64), np.arange(1_000, 99_000, dtype=np.uint64), np.arange(0, 40_000 * 256, 256, dtype=np.uint64)]  # over 255 in all buckets, or all in one
    n, counts = np.array([len(x) for x in items]), jaccard_join.sketches_of(np.concatenate(items), np.concatenate([[0], np.cumsum([len(x) for x in items])]))
    linked = {(a, b) for a in range(len(items)) for b in range(a) if jaccard_join.overlap(items[a], items[b]) * 19 >= 9 * (n[a] + n[b])}
    assert len(linked) > 20
    for side in (np.zeros(len(items), int), np.arange(len(items)) % 2):
        forest = jaccard_join.Forest()
        edges = jaccard_join.close_sketches(n, counts, side, 9, 10)
        for a, b in edges:
            forest.join(a, b)
        assert all(forest.find(a) == forest.find(b) for a, b in linked if not side.any() or side[a] != side[b])
        assert len(edges) < len(linked) + 10 and (not side.any() or all(side[a] != side[b] for a, b in edges))


def test_texts_without_a_partner_are_not_dealt_out(spark):
    rows = frame(spark, [(i, f"t{i}") for i in range(400)]).selectExpr("doc_id as row", "text")
    members = spark.createDataFrame([(5, 0, 0, 0, 7, 7), (5, 0, 0, 0, 9, 9)], "block long, chunk long, other long, side int, row long, label long")
    passed = jaccard_join.likely(rows, members.select("row"))
    assert {7, 9} <= {r.row for r in passed.collect()} and passed.count() < 100
    plan = jaccard_join._links(members, rows, members.select("row"), 3, 9, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan


def test_jaccard_streamed_tokens(spark, monkeypatch):
    rows = chain(40, 60, 1)
    monkeypatch.setattr(jaccard_join, "OFTEN", 10**9)
    monkeypatch.setattr(jaccard_join, "PAIRED", 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows), 3, 9, 10).collect()}
    assert got == brute_components(rows, 3, 9, 10)


def test_jaccard_tokens_are_counted_by_hash(spark):
    """Not sorted: a struct beside the count would be, and the rows of every shingle with it."""
    heads = {1: [5, 6], 2: [5], 9: [6, 5, 7], 4: []}
    wide = spark.createDataFrame([(r, 3, 1, 2, h) for r, h in heads.items()], "row long, n long, one long, two long, head array<long>")
    got = jaccard_join.counted_tokens(wide)
    assert sorted(map(tuple, got.collect())) == [(5, 3, 1), (6, 2, 1), (7, 1, 9)]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_jaccard_edges_of_tables(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0
    got = jaccard_join.jaccard_components(frame(spark, [(5, "a b"), (5, "a b"), (None, "a b"), (None, None), (7, "")])).collect()
    assert sorted(str(r.component_id) for r in got) == ["5", "5", "5", "7", "None"]
    assert jaccard_join.drop_near_copies(frame(spark, [(5, "a b"), (5, "a b"), (4, "a b"), (7, ""), (8, "")])).count() == 3


def test_tree_bounds_lose_nothing():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    items = [np.sort(np.unique(np.concatenate([base[rng.random(len(base)) < 0.97], rng.integers(0, 1 << 62, 8).astype(np.uint64)]))) for _ in range(40)]
    items += [np.sort(np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64))) for _ in range(60)]
    tree = jaccard_join.Tree(items, 1024)
    i, j = jaccard_join.dual_traversal(tree, tree, 9, 10)
    left = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    linked = {(a, b) for a in range(100) for b in range(a + 1, 100) if jaccard_join.overlap(items[a], items[b]) * 19 >= 9 * (len(items[a]) + len(items[b]))}
    assert linked <= left and len(left) < 3000


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cut(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = defaultdict(int)
    for _, t in texts:
        for j in range(len(t) - length + 1):
            seen[t[j : j + length]] += 1
    out = []
    for i, t in texts:
        mask = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                mask[j : j + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        out.append((i, len(t), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    held = defaultdict(set)
    of = []
    for k, (i, t) in enumerate(rows):
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        of.append([(t or "").encode()[at[j][0] : at[j + 50][1]] for j in range(len(at) - 50)])
        for x in of[-1]:
            held[x].add(k)
    return sorted((*o, sum(len(held[x]) > 1 for x in p)) for o, p in zip(out, of))


@pytest.mark.parametrize("length, group", [(400, 2000), (120, 2000), (120, 2), (30, 5)])
def test_repeats(spark, monkeypatch, length, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = sample(5, 90)
    got = sorted(tuple(r) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows), length)).collect())
    assert got == brute_cut(rows, length)


def test_repeats_of_long_texts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SCAN_BYTES", 1000)
    rng = random.Random(2)
    long = "".join(rng.choices("ab ", k=9000))
    rows = [(1, long), (2, long[2000:2700] + "x" + long[4000:4500]), (3, "q" * 1500), (4, "same " * 10), (4, "same " * 10), (5, None)]
    got = sorted(tuple(r) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows))).collect())
    assert got == brute_cut(rows, 400)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_periodic_texts(spark, monkeypatch):
    """Rulers, runs of one letter and longer periods, alone, cut off, twice, and next to each other."""
    rng = random.Random(9)
    unit = "".join(rng.choices("abcdefgh", k=37))
    rows = [(1, "-" * 1000), (2, "x" + "-" * 399), (3, "y" + "-" * 400 + "z"), (4, "ab" * 450), (5, unit * 30), (6, "q" + unit * 14 + "r"), (7, "0" * 700 + "1" * 700), (8, "a " * 300), (9, "ab" * 210 + unit * 12), (10, unit * 30), (11, "*" * 401), (12, "+" * 400), (13, rng.choice("ab") * 5 + "".join(rng.choices("abcdefgh", k=290)) * 4)]
    for scan in (1 << 20, 500):
        monkeypatch.setattr(suffix_dedup, "SCAN_BYTES", scan)
        got = sorted(tuple(r) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows))).collect())
        assert got == brute_cut(rows, 400)
    groups = defaultdict(set)
    for r in suffix_dedup.repeat_groups(frame(spark, rows[:3])).collect():
        groups[r.repeat].add((r.doc_id, r.start))
    assert {(1, 0), (1, 300), (1, 600), (3, 1)} <= set().union(*groups.values())


def test_a_run_of_three_megabytes_is_a_row(spark):
    import time

    data = np.frombuffer(b"-" * 3_000_000, np.uint8)
    row, lo, hi, _, anchor, mark = suffix_dedup.segments(data, np.array([0, len(data)]))
    first, times = suffix_dedup.folded(row, lo, hi - lo + 1, anchor, mark)
    assert len(first) < 10 and times.sum() == len(row)
    rows = [(1, "-" * 3_000_000), (2, "+-" * 100_000 + "end"), (3, "plain")]
    began = time.time()
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows))).collect()}
    assert got == {1: (3_000_000, 1), 2: (200_000, 1), 3: (0, 0)} and time.time() - began < 60


def test_maximal_repeats_have_all_places():
    parts = [b"xxABCDEFGHIJyy", b"zABCDEFGHIJq", b"ABCDEFGHIJKLM", b"-ABCDEFGH-"]
    data, starts, ends = suffix_dedup.packed(parts)
    found = suffix_dedup.maximal_repeats(data, starts, ends, np.array([len(p) - 7 for p in parts]), 8)
    assert sorted((n, len(at)) for n, at in found) == [(8, 4), (10, 3)]


def test_what_stands_behind_a_segment_does_not_sort_it():
    """The first segment ends within the repeat of the two others, and the next byte in the array is the one they go on
    with."""
    parts = [b"zABCDEFGH", b"IxABCDEFGHIJ", b"yABCDEFGHIJ"]
    data, starts, ends = suffix_dedup.packed(parts)
    found = suffix_dedup.maximal_repeats(data, starts, ends, np.array([len(p) - 7 for p in parts]), 8)
    assert sorted((n, len(at)) for n, at in found) == [(8, 3), (10, 2)]


def test_repeat_groups_hold_all_occurrences(spark):
    """Every group's occurrences hold one string, and together they cover what is removed and no more."""
    rows = sample(5, 60)
    texts = {i: (t or "").encode() for i, t in rows}
    groups, cover = defaultdict(set), {i: np.zeros(len(t), bool) for i, t in texts.items()}
    for r in suffix_dedup.repeat_groups(frame(spark, rows), 120).collect():
        groups[r.repeat, r.n_bytes].add((r.doc_id, r.start))
    assert len(groups) > 10
    for (_, n), at in groups.items():
        assert len(at) > 1 and len({texts[i][s : s + n] for i, s in at}) == 1 and n >= 120
        for i, s in at:
            cover[i][s : s + n] = True
    assert {i: int(c.sum()) for i, c in cover.items()} == {r[0]: r[2] for r in brute_cut(rows, 120)}
    assert suffix_dedup.repeat_groups(frame(spark, [])).count() == 0


def test_repeat_groups_of_frequent_anchors(spark, monkeypatch):
    """Counts find the repeats that the tree finds, with all their places, however many segments an anchor has."""
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choices("abcd ", k=n))
    passage, other = draw(150), draw(140)
    rows = sample(5, 60) + [(1000 + k, draw(rng.randint(0, 40)) + passage[: rng.choice((130, 140, 150))] + draw(rng.randint(0, 40))) for k in range(30)]
    rows += [(2000 + k, draw(20) + other + "xyz"[k % 3]) for k in range(6)] + [(3000, "-" * 400), (3001, passage + passage), (3002, passage)]
    found = []
    for most in (2000, 1, 4):
        monkeypatch.setattr(suffix_dedup, "GROUP", most)
        found.append({tuple(r) for r in suffix_dedup.repeat_groups(frame(spark, rows), 120).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
    assert len({(i, at) for _, n, i, at in found[1] if 1000 <= i < 1030 and n >= 120}) >= 30


def test_passages_of_few_bytes(spark, monkeypatch):
    rng = random.Random(4)
    draw = lambda n: " ".join(rng.choices("a b c d ee ff".split(), k=n))
    one, two = draw(51), draw(60)
    rows = [(1, draw(30) + " " + one + " " + draw(9)), (2, one), (3, draw(40) + "\n" + two + draw(30)), (4, two[: two.rindex(" ")] + " q"), (5, draw(80) + " " + draw(80)), (6, "k " * 200), (7, None), (8, draw(50))]
    for scan in (1 << 17, 70):
        monkeypatch.setattr(suffix_dedup, "SCAN_WORDS", scan)
        got = sorted(tuple(r) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows))).collect())
        assert got == brute_cut(rows, 400)
    assert {r[0] for r in got if r[-1]} == {1, 2, 3, 4} and not any(r[2] for r in got if r[0] < 5)


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for w in (1, 3, 7, 200):
        assert suffix_dedup.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(200 - w + 1)]


def test_words_agree_with_the_pattern():
    import pyarrow as pa

    texts = [t for _, t in sample()]
    got = []
    for block in W.blocks(pa.array(texts), 500):
        found = W.split(block)
        raw = [bytes(block.data[a:b]).decode() for a, b in zip(found.starts, found.ends)]
        got += [[x for x, r in zip(raw, found.row) if r == k] for k in range(block.rows)]
    assert [[x.lower() if x.isascii() else x for x in g] for g in got] == [[x for x in words(t)] for t in texts]


def test_row_numbers_of_paths_listed_twice(spark, tmp_path):
    from reelmill.llm import shared

    path = f"{tmp_path}/t"
    spark.range(17).selectExpr("id as doc_id", "'t' as text").repartition(2).write.parquet(path)
    for paths in ([path, path], [path, f"file:{path}/"]):
        rows, name = shared.with_rows(spark.read.parquet(*paths))
        assert rows.count() == 34 and rows.select(name).distinct().count() == 34
    assert shared._is_scan(spark.read.parquet(path)) and not shared._is_scan(spark.read.parquet(path, path))


def test_row_numbers_are_distinct_and_steady(spark, tmp_path):
    """Many files, odd names and partitions cut differently: each row has one number of its own."""
    from reelmill.llm import shared

    path = f"{tmp_path}/odd name%20é"
    spark.range(3000).selectExpr("id as doc_id", "'t' as text", "id % 7 as p").repartition(9).write.partitionBy("p").parquet(path)
    seen = []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows, name = shared.with_rows(spark.read.parquet(path).filter("doc_id >= 10"))
        assert rows.columns[-1] == name and set(rows.columns) == {"doc_id", "text", "p", name}
        seen.append({r.doc_id: r[name] for r in rows.collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 2990
