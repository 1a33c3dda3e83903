"""SentencePiece models on the tokenizers library: encoding and decoding of whole texts.

The model's protobuf is read and its parts are rebuilt: the normaliser (character map, extra white space, dummy prefix),
the white-space marker, the pieces with their scores (a unigram model as such, a BPE model as merges ordered by score)
and byte fallback. Batches are encoded by several threads. The ids are the tokenizers library's; the sentencepiece
library encodes the same, and the column ``parity`` says whether both agree on all of a text.

The rebuilt model works on chunks that begin at a marker: no piece holds a marker after another character (checked when
the model is read), so no merge and no best path crosses such a place. Each distinct chunk is encoded, compared and
decoded once and then kept by its worker.

Defined results: a null or empty text has no ids and decodes to an empty text; a very long text is worked on whole, as a
block of its own; control pieces written out in a text are ordinary characters; a marker written out in a text decodes
to a space, so that text has no round trip; repeated rows are encoded each, and no result depends on an order, so there
are no ties; an empty table gives an empty result; columns named token_ids, parity or decoded are replaced, other columns
are carried.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .shared import lean, ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # fixed values of a piece's type
BATCH_BYTES = 1 << 19  #: text encoded by one call


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, raw[at : at + size]
        at += size


class Model:
    """The parts of a model file that encoding needs."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normal = {}, {}
        for number, value in fields(raw):
            if number == 1:
                x = dict(fields(value))
                self.pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x.get(2, bytes(4)))[0], x.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        self.unigram = trainer.get(3, 1) == 1
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models are known here")
        if any(kind == USER for _, _, kind in self.pieces):
            raise ValueError("user-defined pieces are not known here")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk_id = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        self.char_map = normal.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = (bool(normal.get(k, 1)) for k in (3, 4, 5))


def rebuilt(model: Model):
    """The same model as a tokenizers.Tokenizer."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = model.pieces
    if model.unigram:
        core = models.Unigram([(p, s) for p, s, _ in pieces], model.unk_id, byte_fallback=model.byte_fallback)
    else:
        ids = {p: i for i, (p, _, _) in enumerate(pieces)}
        plain = {p for p, _, kind in pieces if kind == NORMAL}
        merges = []
        for i, (p, score, kind) in enumerate(pieces):
            if kind == NORMAL:
                ways = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
                merges += [(-score, i, ids[a], ids[b], (a, b)) for a, b in ways]
        core = models.BPE(ids, [m[-1] for m in sorted(merges)], unk_token=pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = []
    if model.char_map:
        steps.append(normalizers.Precompiled(model.char_map))
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind == NORMAL):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


@lru_cache(2)
def loaded(raw: bytes, threads: int):
    """Tokenizer, its reference and the control ids; once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    import sentencepiece

    return rebuilt(Model(raw)), sentencepiece.SentencePieceProcessor(model_proto=raw)


def runs_of(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit characters, or one row."""
    i, total = 0, 0
    for j, size in enumerate(sizes):
        if j > i and total + size > limit:
            yield i, j
            i, total = j, 0
        total += size
    if sizes:
        yield i, len(sizes)


def _ints(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int32)


class Encoder:
    """Encodes texts, each with whether both libraries agree on it and whether decoding gives it again. Distinct chunks
    are encoded once, by the tokenizers library as the result and by the sentencepiece library for parity, and kept in
    arrays sorted by hash, so that words which recur cost a look-up. What a hash finds is compared byte by byte; a row with
    a chunk that is another than the one found is encoded whole. New chunks go to the libraries many in a string:
    a chunk's first piece is the one that begins with a marker after a piece that is more than markers."""

    KEPT = 1 << 20  #: chunks kept by a worker; beyond that it begins anew
    KEPT_BYTES = 1 << 24  #: and bytes of them
    COMPARED = 1 << 16  #: bytes compared at once
    JOINED = 500  #: new chunks in one string

    def __init__(self, raw: bytes, threads: int):
        self.tokenizer, self.reference = loaded(raw, threads)
        self.threads, model = threads, Model(raw)
        self.chunked = self.tokenizer.pre_tokenizer is not None and model.dummy_prefix and model.escape and not model.squeeze and not model.char_map
        self.lead = np.array([p.startswith(MARK) for p, _, _ in model.pieces])
        self.blank = np.array([bool(p) and not p.strip(MARK) for p, _, _ in model.pieces])
        self.clear()

    def clear(self) -> None:
        self.marks, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each chunk's pieces in flat, by place
        self.flat = np.zeros(0, np.int32)
        self.raw = np.zeros(0, np.uint8)  # bytes of the chunks
        self.raw_begin, self.raw_size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each chunk in raw, by place
        self.same, self.again = np.zeros(0, bool), np.zeros(0, bool)

    def whole(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """ids, parity and round trip of texts by themselves."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        wanted = self.reference.encode(texts, num_threads=self.threads)
        back = self.tokenizer.decode_batch(got, skip_special_tokens=False)
        return got, np.array([a == b for a, b in zip(got, wanted)], bool), np.array([a == b for a, b in zip(texts, back)], bool)

    def _flat(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of several strings, and where chunks begin in them."""
        flat = _ints(ids)
        first = self.lead[flat]
        first[1:] &= ~self.blank[flat[:-1]]
        first[np.cumsum([0, *[len(x) for x in ids[:-1]]])] = True
        return flat, np.flatnonzero(first)

    def together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Pieces one after another, sizes, parity and round trip of chunks that hold more than spaces and no marker;
        nothing if the chunks cannot be told apart."""
        strings = [" ".join(texts[i : i + self.JOINED]) for i in range(0, len(texts), self.JOINED)]
        got = [x.ids for x in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        flat, first = self._flat(got)
        if len(first) != len(texts):
            return None
        size = np.diff(np.append(first, len(flat)))
        wanted, other = self._flat(self.reference.encode(strings, num_threads=self.threads))
        if len(other) != len(texts):
            return None
        if np.array_equal(flat, wanted):
            same = np.ones(len(texts), bool)
        else:
            ends = [*other[1:].tolist(), len(wanted)]
            same = np.array([np.array_equal(flat[a : a + n], wanted[b:e]) for a, n, b, e in zip(first.tolist(), size.tolist(), other.tolist(), ends)], bool)
        again = np.ones(len(texts), bool)
        if self.tokenizer.decode_batch(got, skip_special_tokens=False) != strings:
            alone = self.tokenizer.decode_batch([flat[a : a + n].tolist() for a, n in zip(first.tolist(), size.tolist())], skip_special_tokens=False)
            again = np.array([a == b for a, b in zip(texts, alone)], bool)
        return flat, size, same, again

    def blanks(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Chunks of spaces at the end of a text, read behind a letter."""
        ids, same, again = self.whole([f"x {x}" for x in texts])
        return [x[len(self.whole(["x"])[0][0]) :] for x in ids], same, again

    def block(self, block: words.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all rows, rows+1 offsets, parity and round trip of each row."""
        data, at = block.data, block.offsets
        rows = block.rows
        out = np.zeros(rows + 1, np.int64)
        if not self.chunked:
            ids, same, again = self.whole([bytes(data[i:j]).decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:])])
            np.cumsum([len(x) for x in ids], out=out[1:])
            return _ints(ids), out, same, again
        # a chunk begins at the start of a text and at a space after another character; one marker before it is implied
        begin = np.zeros(len(data), bool)
        space = data == 0x20
        begin[1:] = space[1:] & ~space[:-1]
        head = at[:-1][at[1:] > at[:-1]]
        begin[head] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        row = np.searchsorted(at, starts, "right") - 1
        skip = np.ones(len(starts), np.int64)
        skip[np.searchsorted(starts, head)] = 0
        starts = starts + skip
        # a marker written out in a text counts as a space, so rows with one are encoded whole
        odd = np.zeros(rows, bool)
        odd[np.searchsorted(at, np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)), "right") - 1] = True
        if odd.any():
            use = ~odd[row]
            starts, ends, row = starts[use], ends[use], row[use]
        marks, first, back = np.unique(words.span_hash(words.prefix_hash(data, False), starts, ends), return_index=True, return_inverse=True)
        number = self.numbers(data, starts[first], ends[first], marks)[back]
        odd[row[self.differ(data, starts, ends, number)]] = True
        each, from_ = self.size[number], self.begin[number]
        total = np.cumsum(each)
        ids = self.flat[np.arange(total[-1] if len(total) else 0) + np.repeat(from_ - (total - each), each)]
        np.cumsum(np.bincount(row, each, rows).astype(np.int64), out=out[1:])
        same, again = (np.bincount(row[~x[number]], minlength=rows) == 0 for x in (self.same, self.again))
        if odd.any():
            which = np.flatnonzero(odd)
            alone, same[which], again[which] = self.whole([bytes(data[at[i] : at[i + 1]]).decode("utf-8", "replace") for i in which.tolist()])
            lists = np.split(ids, out[1:-1])
            for i, x in zip(which.tolist(), alone):
                lists[i] = np.asarray(x, np.int32)
            ids = np.concatenate(lists)
            np.cumsum([len(x) for x in lists], out=out[1:])
        return ids, out, same, again

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The place of each distinct chunk among those kept. marks: sorted."""
        if len(self.marks) > self.KEPT or len(self.raw) > self.KEPT_BYTES:
            self.clear()
        at = np.minimum(np.searchsorted(self.marks, marks), max(len(self.marks) - 1, 0))
        new = np.flatnonzero(self.marks[at] != marks) if len(self.marks) else np.arange(len(marks))
        if len(new):
            raw = data.tobytes()
            self._keep(marks[new], [raw[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist())])
            at = np.searchsorted(self.marks, marks)
        return self.place[at]

    def differ(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which of the chunks are not the kept ones of these numbers: others with their hash."""
        size = ends - starts
        out = self.raw_size[number] != size
        like = np.flatnonzero(~out & (size > 0))
        long = like[size[like] > self.COMPARED]
        for i, a, n, b in zip(long.tolist(), starts[long].tolist(), size[long].tolist(), self.raw_begin[number[long]].tolist()):
            out[i] = not np.array_equal(data[a : a + n], self.raw[b : b + n])
        like = like[size[like] <= self.COMPARED]
        cuts = np.flatnonzero(np.diff(np.cumsum(size[like]) // self.COMPARED)) + 1
        for some in np.split(like, cuts):  # at most twice COMPARED bytes, each of which has a place of 64 bits
            each = size[some]
            before = np.cumsum(each) - each
            inner = np.arange(each.sum())
            here, there = np.repeat(starts[some] - before, each), np.repeat(self.raw_begin[number[some]] - before, each)
            if len(inner):
                out[some] = np.add.reduceat(data[inner + here] != self.raw[inner + there], before, dtype=np.int64) > 0
        return np.flatnonzero(out)

    def _keep(self, marks: np.ndarray, chunks: list[bytes]) -> None:
        texts = [x.decode("utf-8", "replace") for x in chunks]
        blank = np.array([not x.strip(" ") for x in texts])
        parts = []
        for k in (False, True):
            here = np.flatnonzero(blank == k)
            if not len(here):
                continue
            own = [texts[i] for i in here.tolist()]
            got = None if k else self.together(own)
            if got is None:
                ids, same, again = self.blanks(own) if k else self.whole(own)
                got = _ints(ids), np.array([len(x) for x in ids], np.int64), same, again
            parts.append((here, *got))
        here, flat, size, same, again = (np.concatenate(x) for x in zip(*parts))
        begin = len(self.flat) + np.cumsum(size) - size
        number = len(self.begin) + np.arange(len(here))
        sizes = np.array([len(chunks[i]) for i in here.tolist()], np.int64)
        self.raw_begin, self.raw_size = np.append(self.raw_begin, len(self.raw) + np.cumsum(sizes) - sizes), np.append(self.raw_size, sizes)
        self.raw = np.append(self.raw, np.frombuffer(b"".join([chunks[i] for i in here.tolist()]), np.uint8))
        self.flat, self.begin, self.size = np.append(self.flat, flat), np.append(self.begin, begin), np.append(self.size, size)
        self.same, self.again = np.append(self.same, same), np.append(self.again, again)
        marks = np.append(self.marks, marks[here])
        order = np.argsort(marks, kind="stable")
        self.marks, self.place = marks[order], np.append(self.place, number)[order]


@lru_cache(2)
def encoder(raw: bytes, threads: int) -> Encoder:
    """A worker's encoder; its chunks are kept from task to task."""
    return Encoder(raw, threads)


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, threads: int = 2) -> DataFrame:
    """docs with token_ids array<int> and parity boolean. The model file is read by the driver and sent with the tasks
    (half a megabyte)."""
    ship(docs.sparkSession)
    raw = _model_bytes(model)
    docs = docs.drop("token_ids", "parity")
    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("parity", T.BooleanType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(text)):
                ids, at, same, _ = encoder(raw, threads).block(block)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(same)], [*part.schema.names, "token_ids", "parity"])

    return docs.mapInArrow(lean(task), schema)


def decode(encoded: DataFrame, model: str = MODEL, threads: int = 2) -> DataFrame:
    """The rows with the text that token_ids stand for as decoded."""
    ship(encoded.sparkSession)
    raw = _model_bytes(model)
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, _ = loaded(raw, threads)
        for batch in batches:
            ids = batch.column("token_ids").to_pylist()
            for i, j in runs_of([4 * len(x or []) for x in ids]):
                part = batch.slice(i, j - i)
                texts = tokenizer.decode_batch([x or [] for x in ids[i:j]], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(task, schema)


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL, threads: int = 2) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of little-endian 32-bit ids), parity, and round_trip: whether decoding the ids
    gives the text again. Encodes and decodes in one pass, chunk by chunk, so that neither ids nor texts leave the worker."""
    ship(docs.sparkSession)
    raw = _model_bytes(model)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                ids, at, same, again = encoder(raw, threads).block(block)
                lists = np.split(ids, at[1:-1])
                digests = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in lists]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.rows), pa.array(np.diff(at)), pa.array(digests), pa.array(same), pa.array(again)], ["doc_id", "n_pieces", "ids_sha256", "parity", "round_trip"])

    return rows.mapInArrow(lean(task), "doc_id long, n_pieces long, ids_sha256 string, parity boolean, round_trip boolean")
