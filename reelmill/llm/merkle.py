"""A Merkle manifest of a table: a tree of digests over each group's rows, and one over the groups' roots.

Rows are leaves in order of their key. Every RUN consecutive nodes have one parent. Aligned subtrees of HEIGHT levels of
parents are blocks: a block's digests stand in one array in van Emde Boas order (the upper half of its levels first, then
each subtree below it, each again split at half height), and the same address arithmetic places digests when a block is
built and finds siblings when a proof is asked for. The roots of blocks are leaves of the next tier of blocks, until a
group has one node left, and the groups' roots go through the same tiers.

Leaves are hashed by Spark's own functions, dealt out by ranges of (group, key), written, and numbered within their group
from the counts of ranges; a block of at most RUN**HEIGHT digests is one task's group, however many rows a group has.

Defined results: a null field counts as "-" and an empty one as "0:"; a null key comes before all others and so does a
null group; of rows that tie in the key the one with the lesser leaf comes first, and rows repeated in full are equal
leaves next to each other; very long texts are hashed whole; an empty table gives an empty result; other columns are
ignored, whatever they are called. A null key has no check sum, so such a row is never tampered with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

RUN = 8  #: nodes below one parent
HEIGHT = 4  #: levels of parents in a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
EMPTY = sha256(b"").hexdigest()
BLOCK = "grp string, block long, blocks long, size int, height int, digest string, nodes binary"
PATH = "grp string, block long, path binary, subroot string, root string"


def nodes_in(levels: int) -> int:
    return (RUN**levels - 1) // (RUN - 1)


def place(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes with these indexes at a depth stand in the array of a full tree of so many levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return place(upper, depth, index)
    lower, below = levels - upper, RUN ** (depth - upper)
    return nodes_in(upper) + index // below * nodes_in(lower) + place(lower, depth - upper, index % below)


@lru_cache(16)
def places(levels: int) -> list[list[int]]:
    """place() of all nodes by depth."""
    return [place(levels, d, np.arange(RUN**d)).tolist() for d in range(levels)]


class Block:
    """A subtree's digests, as hexadecimal text, in van Emde Boas order."""

    def __init__(self, size: int, height: int, cells: list[bytes] | None = None):
        self.size, self.height = size, height
        self.at = places(height + 1)
        self.cells = cells or [b""] * nodes_in(height + 1)

    @classmethod
    def built(cls, digests: list[bytes], height: int) -> Block:
        out = cls(len(digests), height)
        for a, x in zip(out.at[height], digests):
            out.cells[a] = x
        for depth in range(height, 0, -1):
            for i in range(-(-out.width(depth) // RUN)):
                out.cells[out.at[depth - 1][i]] = sha256(b"".join(out.run(depth, i))).hexdigest().encode()
        return out

    def width(self, depth: int) -> int:
        """Nodes at a depth."""
        return -(-self.size // RUN ** (self.height - depth))

    def run(self, depth: int, i: int) -> list[bytes]:
        """The i-th run of a depth."""
        return [self.cells[a] for a in self.at[depth][i * RUN : min((i + 1) * RUN, self.width(depth))]]

    @property
    def root(self) -> bytes:
        return self.cells[0]

    def path(self, i: int) -> list[tuple[bytes, bytes]]:
        """What stands before and behind the i-th leaf and each of its parents in their runs, up to the root."""
        out = []
        for depth in range(self.height, 0, -1):
            run, own = self.run(depth, i // RUN), i % RUN
            out.append((b"".join(run[:own]), b"".join(run[own + 1 :])))
            i //= RUN
        return out

    def packed(self) -> bytes:
        return b"".join(bytes.fromhex(x.decode()) if x else bytes(32) for x in self.cells)

    @classmethod
    def unpacked(cls, size: int, height: int, raw: bytes) -> Block:
        return cls(size, height, [raw[i : i + 32].hex().encode() for i in range(0, len(raw), 32)])


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf has with these siblings."""
    for before, behind in path:
        digest = sha256(before + digest + behind).hexdigest().encode()
    return digest


def path_bytes(path: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + a + b for a, b in path)


def path_of(raw: bytes) -> list[tuple[bytes, bytes]]:
    out, i = [], 0
    while i < len(raw):
        a, b = i + 2 + 64 * raw[i], i + 2 + 64 * (raw[i] + raw[i + 1])
        out.append((raw[i + 2 : a], raw[a:b]))
        i = b
    return out


def leaf(*fields: Column) -> Column:
    """Hexadecimal SHA-256 of fields, each with its length in bytes before it."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with pos, a row's place in its group from 0, and total, the rows of the group. Rows are dealt out by ranges and
    written; what is counted over is a row for each group and range."""
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = shared.materialize(dealt.withColumns({"range_no": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "merkle-order")
    each = dealt.groupBy(group, "range_no").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first"))
    own = Window.partitionBy(group)
    each = each.withColumns({"total": F.sum("rows").over(own), "ahead": F.coalesce(F.sum("rows").over(own.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return dealt.join(each.drop("rows"), [group, "range_no"]).withColumn("pos", F.col("ahead") + F.col("seq") - F.col("first")).drop("range_no", "seq", "first", "ahead")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """BLOCK rows of (grp, pos, total, digest): a block's root, the blocks that its group has, and its digests."""

    def task(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        total = part["total"][0].as_py()
        height = HEIGHT
        if total <= RUN**HEIGHT:  # the group's only block ends at its one root
            height = next(h for h in range(HEIGHT + 1) if RUN**h >= total)
        block = Block.built([x.encode() for x in part["digest"].to_pylist()], height)
        row = {"grp": key[0].as_py(), "block": key[1].as_py(), "blocks": -(-total // RUN**HEIGHT), "size": block.size, "height": height, "digest": block.root.decode(), "nodes": block.packed()}
        return pa.Table.from_pylist([row], pa.schema([("grp", pa.string()), ("block", pa.int64()), ("blocks", pa.int64()), ("size", pa.int32()), ("height", pa.int32()), ("digest", pa.string()), ("nodes", pa.binary())]))

    return nodes.select("grp", F.expr(f"pos div {RUN**HEIGHT}").alias("block"), "pos", "total", "digest").groupBy("grp", "block").applyInArrow(task, BLOCK)


def tower(nodes: DataFrame) -> list[DataFrame]:
    """The tiers of blocks over (grp, pos, total, digest), lowest first, each written."""
    tiers = [shared.materialize(blocks_of(nodes), "merkle-tier")]
    while (tiers[-1].agg(F.max("blocks")).first()[0] or 0) > 1:
        below = tiers[-1].where("blocks > 1").select("grp", F.col("block").alias("pos"), F.col("blocks").alias("total"), "digest")
        tiers.append(shared.materialize(blocks_of(below), "merkle-tier"))
    return tiers


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(grp, digest) of every group: the only block of the tier where it has one."""
    tops = [t.where("blocks = 1").select("grp", "digest") for t in tiers]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionAll(t)
    return out


def paths_below(tier: DataFrame, paths: DataFrame) -> DataFrame:
    """PATH rows of the leaves of a tier's blocks, given those of the blocks themselves."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block.unpacked(r["size"], r["height"], r["nodes"])
                own = [path_bytes(block.path(i)) + r["path"] for i in range(block.size)]
                first = r["block"] * RUN**HEIGHT
                n = block.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["grp"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(own, pa.binary()), pa.array([r["subroot"]] * n, pa.string()), pa.array([r["root"]] * n, pa.string())],
                    ["grp", "block", "path", "subroot", "root"],
                )

    return tier.join(paths, ["grp", "block"]).select("grp", "block", "size", "height", "nodes", "path", "subroot", "root").mapInArrow(task, PATH)


def descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """PATH rows of the lowest tier's blocks, given those of the groups' roots: (grp, path, subroot, root)."""
    tops = tops.withColumn("block", F.lit(0).cast("long")).select("grp", "block", "path", "subroot", "root")
    paths = None
    for k in range(len(tiers) - 1, -1, -1):
        here = tops.join(tiers[k].where("blocks = 1").select("grp"), "grp", "left_semi") if len(tiers) > 1 else tops
        paths = here if paths is None else paths_below(tiers[k + 1], paths).unionAll(here)
    return paths


@dataclass
class Manifest:
    """Written tables. leaves: grp, key, leaf, what else was kept, pos, total. tiers: blocks over leaves. paths: what
    stands above each block of the lowest tier, with its group's root and the root of all."""

    leaves: DataFrame
    tiers: list[DataFrame]
    paths: DataFrame


def build(rows: DataFrame) -> Manifest:
    """The manifest of rows (group string, key, leaf string, and others that are kept)."""
    rows = rows.withColumn("grp", F.coalesce(F.concat(F.lit("1"), F.col("group").cast("string")), F.lit("0"))).drop("group")
    # in a column that only spreads rows repeated in full, written before anything is sorted by it
    rows = shared.materialize(rows.withColumn("spread", F.monotonically_increasing_id()), "merkle-leaves")
    leaves = numbered(rows, "grp", "key", "leaf", "spread")
    shared.drop(rows)
    tiers = tower(leaves.withColumnRenamed("leaf", "digest"))
    subroots = numbered(roots(tiers).select(F.lit("").alias("grp"), F.col("grp").alias("member"), "digest"), "grp", "member")
    above = tower(subroots)
    top = roots(above).select("grp", F.lit(b"").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    of_groups = paths_below(above[0], descend(above, top)).select(F.col("block").alias("pos"), "path", "root")
    tops = subroots.join(of_groups, "pos").select(F.col("member").alias("grp"), "path", F.col("digest").alias("subroot"), "root")
    return Manifest(leaves.drop("spread"), tiers, shared.materialize(descend(tiers, shared.materialize(tops, "merkle-tops")), "merkle-paths"))


PROVED = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def proved(manifest: Manifest, claim: str) -> DataFrame:
    """PROVED rows: each leaf's proof as one digest of all its siblings, and the root that the leaf of the column claim
    (its own where that is null) leads to with them."""

    def task(leaves: pa.Table, blocks: pa.Table) -> pa.Table:
        r = blocks.to_pylist()[0]
        block, above = Block.unpacked(r["size"], r["height"], r["nodes"]), path_of(r["path"])
        rest, ended = b"".join(a + b for a, b in above), {}
        proofs, folded = [], []
        for pos, own, said in zip(leaves["pos"].to_pylist(), leaves["leaf"].to_pylist(), leaves["claim"].to_pylist()):
            path = block.path(pos % RUN**HEIGHT)
            proofs.append(sha256(b"".join(a + b for a, b in path) + rest).hexdigest())
            node = fold((said or own).encode(), path)
            if node not in ended:
                ended[node] = fold(node, above).decode()
            folded.append(ended[node])
        n = leaves.num_rows
        return pa.table([leaves["key"], leaves["leaf"], pa.array([r["subroot"]] * n, pa.string()), pa.array([r["root"]] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string())], ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    leaves = manifest.leaves.select("grp", F.expr(f"pos div {RUN**HEIGHT}").alias("block"), "pos", "key", "leaf", F.col(claim).alias("claim"))
    blocks = manifest.tiers[0].select("grp", "block", "size", "height", "nodes").join(manifest.paths, ["grp", "block"])
    return leaves.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInArrow(task, PROVED)


def tampered(key: Column) -> Column:
    """Which rows a check tampers with: 3 divides the CRC-32 of the decimal key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest of docs by lang and doc_id, and
    whether each row is still the one that it holds after some texts were lower-cased."""
    shared.ship(docs.sparkSession)
    fields = {f: F.col(f) for f in FIELDS}
    changed = fields | {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    rows = docs.select(F.col("lang").alias("group"), F.col("doc_id").cast("long").alias("key"), leaf(*fields.values()).alias("leaf"), F.when(tampered(F.col("doc_id")), leaf(*changed.values())).alias("changed"))
    out = proved(build(rows), "changed")
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
