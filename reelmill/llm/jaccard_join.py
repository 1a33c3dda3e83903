"""N-gram Jaccard self-join: blocks of candidates, and in each block a join of signature trees.

A document's set holds its distinct shingles of ``k`` words (the whole sequence, if it has fewer words). Two documents
link when the overlap of their sets is at least ``num/den`` of the union; the result is each document's component.

1. Documents with one set become one node. Equal copies go no further.
2. Routing is exact prefix filtering. Shingles are ordered: first those not known as common, then the common, then the
   frequent, each by hash. Two sets that link share a shingle within a short prefix of each, at places whose rest still
   allows the overlap; that holds in any one order, so the list of frequent shingles (at most ``FREQUENT`` of them) and
   the bitmap of common ones may miss some or hold others: they only save work. Nodes that share an ordinary prefix shingle
   at allowed places and sizes are routed together; a frequent one routes its nodes to one pivot each, where they are
   read, so no task gathers them.
3. Components of the routes are blocks. A block's texts meet in one task, which builds a signature tree: leaves hold
   token bitmaps, inner nodes the OR of their children's, with ranges of size. The tree is joined with itself from the
   root: a pair of nodes is dropped when its size ranges don't allow a link, or when the bits that both have, plus the
   tokens that share a bit, are fewer than the overlap that its least sizes need. Leaves left are verified on the sets.
   Pairs that are connected already are skipped, so a group of near copies costs little more than its size.
4. A block over ``BLOCK`` nodes (or ``BLOCK_SHINGLES``) is first cut by sketches: a set's shingles counted in ``SKETCH``
   buckets, whose least counts bound the overlap. Routes through a pivot are untested, so most of such a block may not link;
   sketches are held against each other where sizes allow a link, and the components of the pairs that they leave are the
   blocks. One that is still as large is cut into chunks, by bands of sizes and in a band by hash. Sets that link lie in one band or neighbouring ones, whose chunks share a few pivots; after chunks are joined and their
   links resolved, the nodes outside the block's largest component are joined with the chunks of their own and the
   neighbouring bands. So no link between two nodes is lost, and no task holds more than two chunks.

Defined results: a very long text is worked on whole, as a block of its own; of equal sets the least id stands for all,
and of rows with that id the first read; a null text is an empty one; a document without words has no shingles and is its own component; of rows
with one id (repeated rows) each is listed, and they count as documents of that id; a null id comes last; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .components import components
from .decontaminate import shingle_hashes
from .secrets import likely
from .shared import drop, lean, materialize, release, with_rows

FREQUENT = 100_000  #: frequent shingles that are known to all tasks, at most
OFTEN = 64  #: rows with a shingle from which it counts as frequent
COMMON = 4  #: rows with a shingle from which it counts as common
COMMON_BITS = 24  #: common shingles are known by as many bits of their hash, in a bitmap of two megabytes
COMMON_BUCKETS = 1 << 22  #: bits set in it at most; beyond that, COMMON is doubled
PAIRED = 256  #: nodes of an ordinary shingle that are paired; beyond that they meet at a pivot
BLOCK = 1000  #: nodes in one tree
BLOCK_SHINGLES = 2_000_000  #: and shingles of all its nodes, about
BAND = 4  #: width of a band of sizes in a large block, as a power of den/num; over 1, so that links reach the next band at most
PIVOTS = 2  #: nodes of a band that all its chunks and those of the bands beside it share
SKETCH = 256  #: buckets of a sketch, a byte each
SKETCHED = 8192  #: sketches in one chunk
FANOUT = 8
COMPARED = 1 << 20  #: 64-bit words of bitmaps compared at once
LOCAL_EDGES = 200_000


def sets(block: words.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' shingle hashes, each row's distinct and sorted, and rows+1 offsets."""
    found = words.split(block)
    h = words.hashes(block, found)
    first = found.first
    shingles = shingle_hashes(h, k)
    row = found.row[: len(shingles)]
    inside = np.arange(len(shingles)) + k <= first[row + 1]
    shingles, row = shingles[inside], row[inside]
    short = np.flatnonzero((found.per_row > 0) & (found.per_row < k))
    if len(short):
        whole = np.array([shingle_hashes(h[first[r] : first[r + 1]], int(found.per_row[r]))[0] for r in short], np.uint64)
        shingles, row = np.concatenate([shingles, words.mix(whole)]), np.concatenate([row, short])
    order = np.lexsort((shingles, row))
    shingles, row = shingles[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingles[1:] != shingles[:-1])
    shingles, row = shingles[new], row[new]
    return shingles, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=block.rows))])


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles of a set of n of which one must be in common, in any one order, with whatever links to it."""
    least = -(-num * n // den)  # size of the smallest partner
    overlap = -(-num * (n + least) // (num + den))
    return np.where(n > 0, n - overlap + 1, 0)


def _spans(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(at - (total - size), size)


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def _sets_task(k: int, num: int, den: int):
    """n, two set hashes, and a third more than the prefix by hash, for the list of frequent shingles."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                flat, at = sets(block, k)
                n = np.diff(at)
                sums = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(np.stack([words.mix(flat), words.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5))]), axis=1, dtype=np.uint64)], axis=1)
                one, two = sums[:, at[1:]] - sums[:, at[:-1]]
                size = np.minimum(n, prefix_length(n, num, den) * 4 // 3)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _lists(flat[_spans(at[:-1], size)], size)], ["row", "doc_id", "n", "one", "two", "head"])

    return task


def _prefix_task(k: int, num: int, den: int, frequent: np.ndarray, common: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                flat, at = sets(block, k)
                n = np.diff(at)
                row = np.repeat(np.arange(block.rows), n)
                bucket = flat >> np.uint64(64 - COMMON_BITS)
                often = common[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1
                if len(frequent):
                    often[np.isin(flat, frequent)] = 2
                flat = flat[np.lexsort((flat, often, row))]
                size = prefix_length(n, num, den)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(n), _lists(flat[_spans(at[:-1], size)], size)], ["row", "n", "prefix"])

    return task


class Forest:
    """Union-find over any whole numbers; keeps the edges that joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def stars(self) -> list[tuple[int, int]]:
        """Every node with the least of its tree: as many edges as there were, and no paths left to follow."""
        return [(x, self.find(x)) for x in list(self.up) if self.find(x) != x]


def _edges_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _route_task(num: int, den: int):
    """Rows (token, row, n, pos) sorted by token: routes between nodes that may link. A token with over PAIRED nodes
    that is not on the frequent list is streamed: its nodes beyond those meet at its first one."""

    def pairs(size: np.ndarray, begin: np.ndarray, row, n, pos) -> tuple[np.ndarray, np.ndarray]:
        # entry i of a group with all later ones
        at = _spans(begin, size)
        later = np.repeat(begin + size, size) - at - 1
        i = np.repeat(at, later)
        j = _spans(at + 1, later)
        small, big = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        most = np.minimum(n[i] - pos[i], n[j] - pos[j])
        ok = (small * den >= num * big) & (most * (num + den) >= num * (small + big))
        return row[i[ok]], row[j[ok]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held = [np.zeros(0, np.int64) for _ in range(4)]
        pivot = None  # (token, row) of a token that is streamed

        def work(token, row, n, pos) -> None:
            edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            size = np.diff(np.append(edge, len(token)))
            some = (size > 1) & (size <= PAIRED)
            # 2 million pairs at a time
            begin, size_of = edge[some], size[some]
            cost = np.cumsum(size_of * size_of)
            for s in np.split(np.arange(len(begin)), np.searchsorted(cost, np.arange(2_000_000, int(cost[-1]) if len(cost) else 0, 2_000_000))):
                if len(s):
                    a, b = pairs(size_of[s], begin[s], row, n, pos)
                    if len(a):
                        for x, y in np.unique(np.stack([a, b], 1), axis=0).tolist():
                            forest.join(x, y)
            for e, m in zip(edge[size > PAIRED].tolist(), size[size > PAIRED].tolist()):
                for x in row[e + 1 : e + m].tolist():
                    forest.join(int(row[e]), x)

        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("token", "row", "n", "pos")]
            if pivot is not None:
                same = new[0] == pivot[0]
                for x in new[1][same].tolist():
                    forest.join(pivot[1], x)
                if same.all():
                    continue
                new, pivot = [x[~same] for x in new], None
            held = [np.concatenate([x, y]) for x, y in zip(held, new)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if len(held[0]) - last > PAIRED:
                pivot = (held[0][-1], int(held[1][last]))
                last = len(held[0])
            work(*[x[:last] for x in held])
            held = [x[last:] for x in held]
            if len(forest.edges) > LOCAL_EDGES:
                yield _edges_batch(forest.stars())
                forest = Forest()
        work(*held)
        yield _edges_batch(forest.stars())

    return task


class Tree:
    """A signature tree over sets, level 0 the leaves."""

    def __init__(self, items: list[np.ndarray], bits: int):
        n = np.array([len(x) for x in items], np.int64)
        least = np.array([x[0] for x in items], np.uint64)
        self.order = np.lexsort((n, least))  # near copies mostly share the least hash
        bitmap = np.zeros((len(items), bits // 64), np.uint64)
        for place, i in enumerate(self.order.tolist()):
            bit = items[i] & np.uint64(bits - 1)
            np.bitwise_or.at(bitmap[place], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        n = n[self.order]
        excess = n - np.bitwise_count(bitmap).sum(1)  # tokens beyond one a bit
        self.levels = [(bitmap, n, n, excess)]
        while len(self.levels[-1][0]) > 1:
            bitmap, low, high, excess = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bitmap, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))


def _allowed(x, y, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether nodes i of level x and j of level y may hold sets that link."""
    ok = (x[2][i] * den >= num * y[1][j]) & (y[2][j] * den >= num * x[1][i])
    at = np.flatnonzero(ok)
    step = max(1, COMPARED // x[0].shape[1])
    for s in range(0, len(at), step):
        p = at[s : s + step]
        both = np.bitwise_count(x[0][i[p]] & y[0][j[p]]).sum(1)
        most = np.minimum(both + np.minimum(x[3][i[p]], y[3][j[p]]), np.minimum(x[2][i[p]], y[2][j[p]]))
        ok[p] = most * (num + den) >= num * (x[1][i[p]] + y[1][j[p]])
    return ok


def dual_traversal(one: Tree, two: Tree, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs (of the items' own numbers) that the bounds leave; each pair once if both trees are one."""
    itself = one is two
    a, b = len(one.levels) - 1, len(two.levels) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        ok = _allowed(one.levels[a], two.levels[b], i, j, num, den)
        i, j = i[ok], j[ok]
        if not a and not b:
            break
        down_a, down_b = a > 0 and a >= b, b > 0 and b >= a
        if down_a:
            a -= 1
            size = np.minimum(FANOUT, len(one.levels[a][1]) - i * FANOUT)
            j, i = np.repeat(j, size), _spans(i * FANOUT, size)
        if down_b:
            b -= 1
            size = np.minimum(FANOUT, len(two.levels[b][1]) - j * FANOUT)
            i, j = np.repeat(i, size), _spans(j * FANOUT, size)
        if itself:
            keep = i <= j
            i, j = i[keep], j[keep]
    if itself:
        i, j = i[i < j], j[i < j]
    return one.order[i], two.order[j]


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def join_block(left: list[np.ndarray], right: list[np.ndarray] | None, label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect all linked pairs of left with right (or itself); numbers count left, then right. label: what
    is connected already."""
    both = left + (right or [])
    bits = 256
    while bits < 4 * max(len(x) for x in both) and bits < 1 << 16:
        bits *= 2
    tree = Tree(left, bits)
    a, b = dual_traversal(tree, tree if right is None else Tree(right, bits), num, den)
    if right is not None:
        b = b + len(left)
    label, edges = label.copy(), []
    near = np.argsort(np.abs(a - b), kind="stable")
    a, b = a[near], b[near]
    step = 64
    while len(a):
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        for x, y in zip(a[:step].tolist(), b[:step].tolist()):
            if label[x] != label[y] and overlap(both[x], both[y]) * (num + den) >= num * (len(both[x]) + len(both[y])):
                edges.append((x, y))
                label[label == label[y]] = label[x]
        a, b = a[step:], b[step:]
        step = min(4096, 2 * step)
    return edges


def _tree_task(k: int, num: int, den: int):
    """Rows (block, chunk, other, side, row, label, text) sorted by the first three: the links of each block."""

    def solve(rows: list) -> list[tuple[int, int]]:
        rows = list({(x[0], x[1]): x for x in rows}.values())
        tokens = []
        for block in words.blocks(pa.array([x[3] for x in rows], pa.large_string())):
            flat, at = sets(block, k)
            tokens += np.split(flat, at[1:-1])
        own = [i for i, x in enumerate(rows) if x[0] == 0]
        other = [i for i, x in enumerate(rows) if x[0] == 1]
        if not own or len(rows) < 2:
            return []
        label = np.unique([x[2] for x in rows], return_inverse=True)[1]
        place = own + other
        edges = join_block([tokens[i] for i in own], [tokens[i] for i in other] if other else None, label[place], num, den)
        forest = Forest()
        for x, y in edges:
            forest.join(rows[place[x]][1], rows[place[y]][1])
        return forest.stars()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for *at, side, row, label, text in zip(*[batch.column(c).to_pylist() for c in ("block", "chunk", "other", "side", "row", "label", "text")]):
                if at != key:
                    if held:
                        out += solve(held)
                    key, held = at, []
                held.append((side, row, label, text))
            if len(out) > 10_000:
                yield _edges_batch(out)
                out = []
        if held:
            out += solve(held)
        yield _edges_batch(out)

    return task


def sketches_of(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each set's shingles counted in SKETCH buckets by hash, up to 255 each."""
    rows = len(at) - 1
    bucket = np.repeat(np.arange(rows), np.diff(at)) * SKETCH + (flat % np.uint64(SKETCH)).astype(np.int64)
    return np.minimum(np.bincount(bucket, minlength=rows * SKETCH), 255).astype(np.uint8).reshape(rows, SKETCH)


def _sketch_task(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                counts = sketches_of(*sets(block, k))
                yield pa.RecordBatch.from_arrays([batch.slice(block.first, block.rows).column("row"), pa.array([x.tobytes() for x in counts], pa.binary())], ["row", "sketch"])

    return task


def close_sketches(n: np.ndarray, counts: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect all pairs of places whose sketches allow a link: of side 0 with side 1, or if there is none, with
    each other. What is over 255 in buckets is bounded by its sum."""
    order = np.lexsort((n, side))
    n, counts, own = n[order], counts[order], int((side == 0).sum())
    excess = n - counts.sum(1, dtype=np.int64)
    first = own if own < len(n) else 0
    low = first + np.searchsorted(n[first:], -(-n[:own] * num // den)) if first else np.arange(own) + 1
    high = first + np.searchsorted(n[first:], n[:own] * den // num, "right")
    label, edges = np.arange(len(n)), []
    for i in range(own):
        j = low[i] + np.flatnonzero(label[low[i] : high[i]] != label[i])
        most = np.minimum(counts[i], counts[j]).sum(1, dtype=np.int64) + np.minimum(excess[i], excess[j])
        j = j[most * (num + den) >= num * (n[i] + n[j])]
        if len(j):
            met, at = np.unique(label[j], return_index=True)
            edges += [(int(order[i]), x) for x in order[j[at]].tolist()]
            label[np.isin(label, met)] = label[i]
    return edges


def _sketch_pairs_task(num: int, den: int):
    """Rows (block, chunk, other, side, row, n, sketch) sorted by the first three: what the sketches of each leave."""

    def solve(key: list, rows: list) -> list[tuple[int, int]]:
        side, row, n, sketch = zip(*rows)
        side = np.array(side)
        if not (side == 0).any() or key[1] != key[2] and side.all() == side.any():
            return []
        counts = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(rows), SKETCH)
        return [(row[x], row[y]) for x, y in close_sketches(np.array(n, np.int64), counts, side, num, den)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for *at, side, row, n, sketch in zip(*[batch.column(c).to_pylist() for c in ("block", "chunk", "other", "side", "row", "n", "sketch")]):
                if at != key:
                    if held:
                        out += solve(key, held)
                    key, held = at, []
                held.append((side, row, n, sketch))
            if len(out) > 10_000:
                yield _edges_batch(out)
                out = []
        if held:
            out += solve(key, held)
        yield _edges_batch(out)

    return task


def wide_blocks(bands: DataFrame) -> DataFrame:
    """The blocks of more than one chunk. bands: block, size, total."""
    return bands.groupBy("block").agg(F.sum("size").alias("s"), F.sum("total").alias("t")).filter((F.col("s") > BLOCK) | (F.col("t") > BLOCK_SHINGLES)).select("block")


def cut_by_sketches(placed: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """placed (row, block, n, band) with wide blocks cut into components of the pairs whose sketches allow a link; what is
    in none links with nothing and goes."""
    bands = materialize(placed.groupBy("block", "band").agg(F.count("*").alias("size"), F.sum("n").alias("total")), "jaccard-bands")
    parts = materialize(bands.join(wide_blocks(bands), "block").select("block", F.col("band").alias("near"), F.ceil(F.col("size") / SKETCHED).cast("long").alias("parts")), "jaccard-parts")
    if not parts.take(1):
        return placed
    many = materialize(placed.join(parts.withColumnRenamed("near", "band"), ["block", "band"]), "jaccard-wide")
    sketches = likely(rows, many.select("row")).mapInArrow(lean(_sketch_task(k)), "row long, sketch binary")
    own = part_name("band", F.pmod(F.xxhash64("row"), "parts")).alias("own")
    held = materialize(many.join(sketches, "row").select("block", own, "row", "n", "sketch", F.col("band")), "jaccard-sketches")
    near = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("near")
    pairs = held.select("*", near).join(parts, ["block", "near"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i")).withColumn("name", part_name("near", "i"))
    keys = ["block", "chunk", "other"]
    pairs = pairs.select("block", F.least("own", "name").alias("chunk"), F.greatest("own", "name").alias("other"), (F.col("name") < F.col("own")).cast("int").alias("side"), "row", "n", "sketch")
    edges = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(_sketch_pairs_task(num, den)), "a long, b long")
    close = components(edges, "jaccard-close").select(F.col("node").alias("row"), F.col("component").alias("block"))
    cut = materialize(many.select("row", "n", "band").join(close, "row").select("row", "block", "n", "band"), "jaccard-placed")
    drop(held)
    return placed.join(parts.select("block").distinct(), "block", "left_anti").unionByName(cut)


def _links(members: DataFrame, texts: DataFrame, narrow: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """members: block, chunk, other, side, row, label. narrow: the rows among them; few other texts are dealt out."""
    whole = members.join(likely(texts, narrow), "row")
    keys = ["block", "chunk", "other"]
    return whole.select(*keys, "side", "row", "label", "text").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(_tree_task(k, num, den)), "a long, b long")


def node_links(rows: DataFrame, nodes: DataFrame, frequent: np.ndarray, pivots: np.ndarray, common: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """a, b: verified links that connect all nodes which link. rows: row, text of all documents; nodes: row and n of each
    node; frequent: sorted; pivots: a node with each; common: the bitmap of common shingles."""
    spark = rows.sparkSession
    prefixes = materialize(rows.mapInArrow(lean(_prefix_task(k, num, den, frequent, common)), "row long, n long, prefix array<long>").join(nodes.select("row"), "row", "left_semi"), "jaccard-prefixes")
    release(spark)
    posted = prefixes.select("row", "n", F.posexplode("prefix").alias("pos", "token"))
    if len(frequent):
        known = spark.createDataFrame(pd.DataFrame({"token": frequent.view(np.int64), "pivot": pivots}))
        known = F.broadcast(known)  # at most FREQUENT rows
        to_pivots = posted.join(known, "token").select(F.col("row").alias("a"), F.col("pivot").alias("b")).filter("a <> b")
        posted = posted.join(known, "token", "left_anti")
    routes = posted.select("token", "row", "n", F.col("pos").cast("long").alias("pos")).repartition("token").sortWithinPartitions("token").mapInArrow(lean(_route_task(num, den)), "a long, b long")
    if len(frequent):
        routes = routes.unionByName(to_pivots)
    routed = materialize(components(routes, "jaccard-routes").select(F.col("node").alias("row"), F.col("component").alias("block")), "jaccard-blocks")
    drop(prefixes)
    del posted, routes
    release(spark)

    # two sets that link have sizes within den/num of each other, so they lie in one band of sizes or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / (BAND * math.log(den / num))).cast("long") if den > num else F.col("n")
    placed = materialize(routed.join(nodes, "row").select("row", "block", "n", band.alias("band")), "jaccard-placed")
    placed = cut_by_sketches(placed, rows, k, num, den)
    release(spark)
    least = [F.min(F.struct(F.xxhash64("row", F.lit(s)), "row"))["row"] for s in range(PIVOTS)]
    bands = materialize(placed.groupBy("block", "band").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.array_distinct(F.array(*least)).alias("pivots")), "jaccard-bands")
    # small tables are written before joins on the block, so that AQE can split the rows of a large one
    cut = materialize(bands.join(wide_blocks(bands), "block").select("block", "band", "pivots", parts_of("size", "total").alias("chunks")), "jaccard-cuts")
    chunk = F.when(F.col("chunks").isNull(), F.lit(0).cast("long")).otherwise(part_name("band", F.pmod(F.xxhash64("row"), "chunks")))
    own = materialize(placed.join(cut.drop("pivots"), ["block", "band"], "left").select("block", chunk.alias("chunk"), F.lit(0).cast("long").alias("other"), F.lit(0).alias("side"), "row", F.col("row").alias("label"), "n", "band", F.col("chunks").isNotNull().alias("wide")), "jaccard-chunks")
    near = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("near")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("i")
    pivots_of = cut.select("block", F.col("band").alias("near"), F.explode("pivots").alias("row"))
    shared_pivots = cut.select("block", "band", each).select("block", part_name("band", "i").alias("chunk"), near).join(pivots_of, ["block", "near"])
    columns = ["block", "chunk", "other", "side", "row", "label"]
    members = own.select(*columns).unionByName(shared_pivots.select("block", "chunk", F.lit(0).cast("long").alias("other"), F.lit(0).alias("side"), "row", F.col("row").alias("label")))
    links = materialize(_links(members, rows, own.select("row"), k, num, den), "jaccard-links")
    release(spark)

    own = own.filter("wide")
    if not own.take(1):
        return links
    # blocks of several chunks: what is not in the largest component meets every chunk of sizes that it may link with
    joined = components(links, "jaccard-first")
    labelled = materialize(own.drop("label").join(joined.select(F.col("node").alias("row"), F.col("component").alias("label")), "row", "left").withColumn("label", F.coalesce("label", "row")), "jaccard-labels")
    largest = labelled.groupBy("block", "label").agg(F.count("*").alias("c")).groupBy("block").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    largest = materialize(largest.filter("all > most").select("block", "main"), "jaccard-largest")
    rest = materialize(labelled.join(largest, "block").filter("label <> main").select("block", "band", "row", "label", "n"), "jaccard-rest")
    parts = materialize(rest.groupBy("block", "band").agg(parts_of(F.count("*"), F.sum("n")).alias("parts")), "jaccard-parts")
    left = rest.join(parts, ["block", "band"]).select("block", part_name("band", F.pmod(F.xxhash64("row", F.lit(1)), "parts")).alias("chunk"), "row", "label", near)
    left = left.join(cut.select("block", F.col("band").alias("near"), "chunks"), ["block", "near"]).select("block", "chunk", "row", "label", "near", each)
    left = left.select("block", "chunk", part_name("near", "i").alias("other"), F.lit(0).alias("side"), "row", "label")
    right = labelled.select("block", F.col("chunk").alias("other"), "row", "label", near).join(parts.select("block", F.col("band").alias("near"), F.col("parts").alias("chunks")), ["block", "near"])
    right = right.select("block", "other", "row", "label", "near", each).select("block", part_name("near", "i").alias("chunk"), "other", F.lit(1).alias("side"), "row", "label")
    return links.unionByName(materialize(_links(left.unionByName(right), rows, labelled.select("row"), k, num, den), "jaccard-links"))


def parts_of(size: Column | str, total: Column | str) -> Column:
    """Parts for so many nodes with so many shingles in all."""
    one, two = (F.col(x) if isinstance(x, str) else x for x in (size, total))
    return F.greatest(F.ceil(one / BLOCK), F.ceil(two / BLOCK_SHINGLES)).cast("long")


def part_name(band: str, number: Column | str) -> Column:
    return F.shiftleft(F.col(band) + 1, 32) + (F.col(number) if isinstance(number, str) else number)


def counted_tokens(wide: DataFrame) -> DataFrame:
    """token, c (rows that have it in their head), row (the least of them). Numbers alone, which are summed up by hash: a
    struct would be sorted, with several times the memory and shuffle."""
    return wide.select("row", F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("c"), F.min("row").alias("row"))


def common_bitmap(counted: DataFrame) -> np.ndarray:
    """A bitmap over the upper bits of the hashes of common shingles. counted: token, c."""
    bucket = F.shiftrightunsigned("token", 64 - COMMON_BITS).cast("int").alias("b")
    least = COMMON
    while True:
        buckets = counted.filter(F.col("c") >= least).select(bucket).distinct()
        if least >= 1 << 40 or buckets.count() <= COMMON_BUCKETS:
            break
        least *= 2
    out = np.zeros(1 << COMMON_BITS, bool)
    out[buckets.toPandas()["b"].to_numpy(np.int64)] = True  # COMMON_BUCKETS at most
    return np.packbits(out, bitorder="little")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, text: str = "text", key: str = "doc_id", number: str | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id, first_row (the row that stands for the component) for every row of docs.
    number: the column of with_rows(), if docs has it already."""
    if number is None:
        docs, number = with_rows(docs)
    rows = docs.select(F.col(number).alias("row"), F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    wide = materialize(rows.mapInArrow(lean(_sets_task(k, num, den)), "row long, doc_id long, n long, one long, two long, head array<long>"), "jaccard-sets")
    rows = rows.select("row", "text")
    same = ["n", "one", "two"]
    found = materialize(wide.drop("head"), "jaccard-rows")
    nodes = materialize(found.filter("n > 0").groupBy(*same).agg(F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("first")), "jaccard-nodes")

    counted = materialize(counted_tokens(wide).filter(F.col("c") >= COMMON), "jaccard-counts")
    common = common_bitmap(counted)
    often = counted.filter(F.col("c") > OFTEN).orderBy(F.desc("c"), "token").limit(FREQUENT)
    often = often.join(found, "row").join(nodes.select(*same, "node"), same).select("token", "node").toPandas()  # at most FREQUENT rows
    drop(wide)
    drop(counted)
    release(docs.sparkSession)
    order = np.argsort(often["token"].to_numpy(np.int64).view(np.uint64), kind="stable")
    frequent, pivots = often["token"].to_numpy(np.int64).view(np.uint64)[order], often["node"].to_numpy(np.int64)[order]

    links = node_links(rows, nodes.select(F.col("node").alias("row"), "n"), frequent, pivots, common, k, num, den)
    linked = components(links, "jaccard-last")
    named = nodes.join(linked.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select(*same, "first", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "jaccard-named")
    firsts = named.groupBy("component").agg(F.min("first").alias("of_all"))
    of_set = named.join(firsts, "component").select(*same, "of_all")
    # a set's row meets all its copies; a very large group is split by AQE's skew join
    out = found.select("row", "doc_id", *same).join(of_set, same, "left")
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("of_all").isNull(), F.col("doc_id")).otherwise(F.col("of_all.doc_id")).alias("component_id"), F.coalesce("of_all.row", "row").alias("first_row"))


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the row of the least id of each component; documents without words all stay."""
    docs, number = with_rows(docs)
    kept = jaccard_components(docs, k, num, den, text, key, number).filter("row = first_row").select(F.col("row").alias(number))
    return docs.join(kept, number, "left_semi").drop(number)
