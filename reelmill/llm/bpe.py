"""Byte-level BPE: encoding of whole texts by a file of ranks, and decoding.

A text is cut by the tokenizer's pattern; a match that is a token is that token, any other is merged from its bytes. New
distinct matches are merged together: those of like length are rows of one padded matrix of token ids, and in each round
every row merges its leftmost pair of least rank. The ranks of pairs come from an open-addressing hash table; rows that
have no pair left go out of the matrix, and the others close the gap and lose a column. A match of over WIDEST bytes is a
matrix of one row, which would take a round for each merge; there, a round merges all pairs of the least rank from left
to right, up to the first whose merge makes a pair of lower rank, which is what single merges would do. Matches that
recur are looked up: a worker keeps their ids from text to text.

Defined results: a null or empty text has no ids and decodes to an empty text; a very long text is worked on whole, as a
block of its own, and so is a long run without a cut; strings of special tokens are ordinary text; of pairs that tie in
rank the leftmost is merged; repeated rows are encoded each; an empty table gives an empty result; columns named
token_ids or decoded are replaced, other columns are carried.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .shared import ship

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
NONE = np.int32(2**31 - 1)  #: the rank of a pair that is no token
WIDEST = 128  #: bytes of the widest rows of a matrix with others


class PairTable:
    """(left id, right id) -> id of the pair's token, in arrays with open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << (4 * len(left) + 2).bit_length()
        self.mask, self.keys, self.values = size - 1, np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]  # of several that want one slot, one gets it
            done = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[done]]] = merged[todo[done]]
            todo = todo[~done]
            at[todo] = at[todo] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (words.mix(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, of any shape; negative ids are padding and pair with nothing."""
        a, b = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        out = np.full(len(a), NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[todo] << 32 | b[todo]
        at = self._slot(keys)
        while len(todo):
            there = self.keys[at]
            hit = there == keys
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (there >= 0)
            todo, keys, at = todo[more], keys[more], at[more] + 1 & self.mask
        return out.reshape(left.shape)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of several spans, one after another."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)


class Vocabulary:
    """Tokens and their ranks, which are their ids."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, raw.splitlines()))}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        # bytes of the tokens and their decimal ids with a space behind, by id
        n = max(self.ranks.values()) + 1
        tokens, numbers = [b""] * n, [b""] * n
        for t, r in self.ranks.items():
            tokens[r], numbers[r] = t, b"%d " % r
        self.tokens, self.numbers = self._packed(tokens), self._packed(numbers)

    @staticmethod
    def _packed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    @staticmethod
    def joined(packed: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of ids one after another, and where those of each row begin; at: rows+1 offsets of ids."""
        data, begin, size = packed
        each = size[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(each, out=ends[1:])
        return data[spread(begin[ids], each)], ends[at]

    def merged(self, matches: list[bytes]) -> list[np.ndarray]:
        """ids of each match that is not itself a token."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(matches)
        size = np.array([len(x) for x in matches], np.int64)
        width = 2
        while width <= WIDEST:
            rows = np.flatnonzero((size <= width) & (size > (width // 2 if width > 2 else 0)))
            if len(rows):
                ids = np.full((len(rows), width), -1, np.int32)
                ids[np.arange(width) < size[rows, None]] = self.byte_ids[np.frombuffer(b"".join(matches[i] for i in rows.tolist()), np.uint8)]
                for i, x in zip(rows.tolist(), self.merge_matrix(ids)):
                    out[i] = x
            width *= 2
        for i in np.flatnonzero(size > WIDEST).tolist():
            out[i] = self.merge_row(self.byte_ids[np.frombuffer(matches[i], np.uint8)])
        return out

    def merge_matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Rows of ids, padded by -1, merged to the end."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(ids)
        row, ranks = np.arange(len(ids)), self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            least = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE)
            ended = least == NONE
            if ended.any():
                for i, x, n in zip(row[ended].tolist(), ids[ended], (ids[ended] >= 0).sum(1).tolist()):
                    out[i] = x[:n].copy()
                row, ids, ranks, at, least = row[~ended], ids[~ended], ranks[~ended], at[~ended], least[~ended]
                if not len(row):
                    break
            # every row got shorter by one, so the matrix loses its last column
            each, cols = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            right = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            right[each, at] = least
            ranks = np.take_along_axis(ranks, cols[:-1] + (cols[:-1] > at[:, None]), 1)
            ids = right
            inner = np.flatnonzero(at < ranks.shape[1])
            ranks[inner, at[inner]] = self.pairs.find(ids[inner, at[inner]], ids[inner, at[inner] + 1])
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.pairs.find(ids[inner, at[inner] - 1], ids[inner, at[inner]])
        return out

    def merge_row(self, ids: np.ndarray) -> np.ndarray:
        """One long row: its tokens are a linked list, and the pairs of each rank wait in a list of places."""
        n, ids = len(ids), ids.astype(np.int32)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive, ranks = np.ones(n, bool), np.append(self.pairs.find(ids[:-1], ids[1:]), NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[ranks[places] != NONE]
            places = places[np.argsort(ranks[places], kind="stable")]
            rank, first = np.unique(ranks[places], return_index=True)
            for r, x in zip(rank.tolist(), np.split(places, first[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(x)

        wait(np.arange(n))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at] & (ranks[at] == rank)]
            if not len(at):
                continue
            # of pairs that share a token, the leftmost: every other one of a run
            place = np.arange(len(at))
            begins = np.append(True, at[1:] != after[at[:-1]])
            pick = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            gone = after[pick]
            beyond, left = after[gone], before[pick]
            merged_left = np.append(False, left[1:] == gone[:-1])
            a = np.where(left < 0, -1, np.where(merged_left, rank, ids[left]))
            b = np.where(beyond < n, ids[np.minimum(beyond, n - 1)], -1)
            token = np.full(len(pick), rank)
            lower = np.flatnonzero((self.pairs.find(a, token) < rank) | (self.pairs.find(token, b) < rank))
            if len(lower):  # a lower pair comes first; what stands behind waits again
                k = lower[0] + 1
                rest = at[at > pick[k - 1]]
                pick, gone, beyond = pick[:k], gone[:k], beyond[:k]
            ids[pick] = rank
            alive[gone], ranks[gone] = False, NONE
            after[pick] = beyond
            inside = beyond < n
            before[beyond[inside]] = pick[inside]
            near = before[pick]
            near = np.unique(np.concatenate([pick, near[near >= 0]]))
            following = after[near]
            ranks[near] = self.pairs.find(ids[near], np.where(following < n, ids[np.minimum(following, n - 1)], -1))
            wait(near)
            if len(lower):
                wait(rest[alive[rest] & (ranks[rest] == rank)])
        return ids[alive]


class Encoder:
    """A worker's encoder, with the ids of matches it has met."""

    KEPT, KEPT_BYTES = 1 << 20, 1 << 25  #: matches, and bytes of them, beyond which the worker begins anew

    def __init__(self, raw: bytes, pattern: str):
        self.vocabulary, self.find = Vocabulary(raw), regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.size, self.flat, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def block(self, block: words.Block) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows, and rows+1 offsets."""
        at, raw = block.offsets.tolist(), block.data.tobytes()
        found = [self.find(raw[i:j].decode("utf-8", "replace")) for i, j in zip(at[:-1], at[1:])]
        flat = list(chain.from_iterable(found))
        if new := list(set(flat) - self.known.keys()):
            self._keep(new)
        number = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        each = self.size[number]
        ids = self.flat[spread(self.begin[number], each)]
        ends = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(each, out=ends[1:])
        first = np.zeros(block.rows + 1, np.int64)
        np.cumsum([len(x) for x in found], out=first[1:])
        if len(self.known) > self.KEPT or self.bytes > self.KEPT_BYTES:
            self.clear()
        return ids, ends[first]

    def _keep(self, new: list[str]) -> None:
        ranks, raw = self.vocabulary.ranks, [x.encode() for x in new]
        whole = [ranks.get(x) for x in raw]
        ids = [None if r is None else np.array([r], np.int32) for r in whole]
        rest = [i for i, r in enumerate(whole) if r is None]
        for i, x in zip(rest, self.vocabulary.merged([raw[i] for i in rest])):
            ids[i] = x
        size = np.array([len(x) for x in ids], np.int64)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size) - size)
        self.size, self.flat = np.append(self.size, size), np.concatenate([self.flat, *ids])
        self.bytes += sum(map(len, raw))


@lru_cache(2)
def encoder(raw: bytes, pattern: str) -> Encoder:
    return Encoder(raw, pattern)


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """docs with token_ids array<int>. The file of ranks is read by the driver and sent with the tasks (under a megabyte)."""
    ship(docs.sparkSession)
    raw, docs = _file(ranks), docs.drop("token_ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(text)):
                ids, at = encoder(raw, pattern).block(block)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], [*part.schema.names, "token_ids"])

    return docs.mapInArrow(task, schema)


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The rows with the bytes that token_ids stand for as decoded; an id without a token is an error."""
    ship(encoded.sparkSession)
    raw, encoded = _file(ranks), encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(raw, PATTERN).vocabulary
        for batch in batches:
            lists = batch.column("token_ids").to_pylist()
            ids = np.fromiter(chain.from_iterable(x or [] for x in lists), np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.tokens[2]) or not vocabulary.tokens[2][ids].all()):
                raise ValueError("an id has no token")
            at = np.zeros(len(lists) + 1, np.int64)
            np.cumsum([len(x or []) for x in lists], out=at[1:])
            data, ends = vocabulary.joined(vocabulary.tokens, ids, at)
            whole, ends = data.tobytes(), ends.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([whole[i:j] for i, j in zip(ends[:-1], ends[1:])], pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(task, schema)


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 (of the bytes that the ids
    stand for). Encodes and decodes in one pass, so that neither ids nor texts leave the worker."""
    ship(docs.sparkSession)
    raw = _file(ranks)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                coder = encoder(raw, pattern)
                ids, at = coder.block(block)
                columns = []
                for packed, tail in ((coder.vocabulary.numbers, 1), (coder.vocabulary.tokens, 0)):
                    data, ends = coder.vocabulary.joined(packed, ids, at)
                    view, ends = memoryview(data), ends.tolist()
                    columns.append(pa.array([hashlib.sha256(view[i : max(i, j - tail)]).hexdigest() for i, j in zip(ends[:-1], ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.rows), pa.array(np.diff(at)), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
