"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from memory-mapped sorted hash arrays.

Tokens are lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` and one end token a text. Counting takes two passes over the
training texts, after one that sums their bytes, from which the number of word parts follows. The first counts words;
the second counts n-grams of ``order`` words, whose parts are dealt out by context, except that a context whose last word
has a large share of all tokens ("hot", found in the first pass) is dealt out by the whole n-gram. Every map task folds
its own counts before the shuffle. Each part becomes sorted arrays in the shared folder, and gives what is left of its
n-grams without their first word to the parts of the next lower order, down to single words: continuation counts, the
number of different words before. N-grams at a text's beginning have nothing before them and keep their own counts.
Workers map the arrays and look up sorted queries; nothing is sent whole.

Words are counted by 64-bit hashes. A counted word's code is its place in the saved word arrays, one after another, so
known words never share one; unseen words have a code without counts. Bigrams are pairs of 32-bit codes; longer n-grams
are counted and looked up by 64-bit hashes of their codes, which differ for those of one context. An order adds a
shuffle of all its distinct n-grams a task and their arrays, so two is the least and the cheapest.

Defined results: a null text is an empty one and has the end token alone; a very long text is worked on whole, as a block
of its own; repeated rows count and are scored each; scores depend on no order, so there are no ties; with no training text every probability is uniform over one unknown word; an empty table gives an empty result; a null id
counts as training text (its hash is null); other columns are never read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, words

END = np.uint64(0xE4D0000000000001)  #: the end token's hash
BEGIN, UNSEEN = np.uint64(0), np.uint64(0xFFFFFFFF)  #: codes of the context before a text's first token and of unseen words
FOLD_BYTES = 8 << 20  #: text whose counts are folded before they leave a task
WORD_PART_BYTES = 32 << 20  #: training text for each part of the words, about: so many folds' distinct words at most
PART_ROWS = 1_000_000  #: bigram tokens in one part, about
LEAST_PARTS = 16
SHIFT = np.uint64(32)


class Lm(NamedTuple):
    folder: str
    order: int
    word_parts: int
    parts: int
    train_tokens: int
    vocabulary: int
    word_first: np.ndarray  #: the code of each word part's first word
    hot: np.ndarray  #: sorted codes of hot words
    hot_stats: np.ndarray  #: total, n1, n2, n3+ of each as the context of bigrams
    discounts: tuple  #: three for each order from one on
    gamma1: float
    continuations: int


def tokens(block: words.Block) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of a block's rows one after another, each row's ended by END, and rows+1 offsets."""
    found = words.split(block)
    ends = np.cumsum(found.per_row + 1)
    out = np.full(ends[-1] if len(ends) else 0, END, np.uint64)
    hold = np.ones(len(out), bool)
    hold[ends - 1] = False
    out[hold] = words.hashes(block, found)
    return out, np.concatenate([[0], ends])


def grams(code: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """A row for each place in an n-gram, a column for each token: the codes before it, as far as its text goes, and its own."""
    out = np.empty((order, len(code)), np.uint64)
    out[-1] = code
    for k in range(order - 2, -1, -1):
        out[k, 1:] = out[k + 1, :-1]
        out[k, at[:-1]] = BEGIN
    return out


def gram_key(gram: np.ndarray) -> np.ndarray:
    """The code of a word, the pair of codes of two, a hash of more."""
    out = gram[0] << SHIFT | gram[1] if len(gram) > 1 else gram[0]
    for code in gram[2:]:
        out = words.mix(words.mix(out) + code)
    return out


def part_of(gram: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part of each n-gram: by its context, or by all its words where the context ends in a hot one."""
    context = gram_key(gram[:-1])
    if len(hot):
        context = np.where(is_in(gram[-2], hot), words.mix(gram_key(gram)), context)
    return (words.mix(context) % np.uint64(parts)).astype(np.int32)


def is_in(codes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, codes), len(hot) - 1)] == codes


def columns(order: int) -> str:
    return "part int, k long, n long" + "".join(f", c{j} int" for j in range(order - 2))


def _packed(gram: np.ndarray, n: np.ndarray, part: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of n-grams: the last two codes as one number, those before in columns of their own."""
    earlier = {f"c{j}": code.astype(np.uint32).view(np.int32) for j, code in enumerate(gram[:-2])}
    return {"part": part, "k": gram_key(gram[-2:]).view(np.int64), "n": n.astype(np.int64), **earlier}


def _unpacked(table: pa.Table, order: int) -> np.ndarray:
    earlier = [_column(table, f"c{j}").astype(np.int32).view(np.uint32).astype(np.uint64) for j in range(order - 2)]
    return np.stack([*earlier, *_pair(_column(table, "k").view(np.uint64))])


def _pair(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys >> SHIFT, keys & UNSEEN


def _fold(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams and their counts."""
    if len(gram) > 2:
        _, first, n = np.unique(gram_key(gram), return_index=True, return_counts=True)
        return gram[:, first], n
    keys, n = np.unique(gram_key(gram), return_counts=True)
    return np.stack(_pair(keys)), n


def _word_task(parts: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"part": (keys % np.uint64(parts)).astype(np.int32), "k": keys.view(np.int64), "n": n})

        yield from map(out, _in_folds(batches, lambda token, at: token))

    return task


def _gram_task(order: int, parts: int, hot: np.ndarray, folder: str, word_first: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes(folder, word_first)

        def coded(token: np.ndarray, at: np.ndarray) -> np.ndarray:
            kinds, of = np.unique(token, return_inverse=True)
            return grams(known.get(kinds)[1][of], at, order)

        for held in _in_folds(batches, coded):
            gram, n = _fold(np.concatenate(held, axis=1))
            yield pa.RecordBatch.from_pydict(_packed(gram, n, part_of(gram, hot, parts)))

    return task


def _in_folds(batches: Iterator[pa.RecordBatch], of_tokens) -> Iterator[list[np.ndarray]]:
    """What of_tokens gives for each block of texts, in lists of about FOLD_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        for block in words.blocks(batch.column("text")):
            held.append(of_tokens(*tokens(block)))
            size += len(block.data) + 8 * block.rows
            if size >= FOLD_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the sum of each one's n, and a place of each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n, order[first]


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([c.to_numpy(zero_copy_only=False) for c in table.column(name).chunks] or [np.zeros(0, np.int64)])


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()


def _save(folder: str, name: str, keys: np.ndarray, n: np.ndarray) -> None:
    """Sorted keys; counts as bytes, those over 254 in a list of their own."""
    big = np.flatnonzero(n > 254)
    shared.write_array(folder, f"{name}.n", np.minimum(n, 255).astype(np.uint8))
    shared.write_array(folder, f"{name}.big", np.stack([big, n[big]]).astype(np.int64).ravel())
    shared.write_array(folder, f"{name}.k", keys)


class Counts:
    """Look-ups in a saved sorted array."""

    def __init__(self, folder: str, name: str, dtype):
        self.keys, self.n = shared.map_array(folder, f"{name}.k", dtype), shared.map_array(folder, f"{name}.n", np.uint8)
        self.big = np.array(shared.map_array(folder, f"{name}.big", np.int64)).reshape(2, -1)

    def get(self, wanted: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, 0 for those that are not there."""
        return self.find(wanted)[0]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of sorted keys, 0 for those that are not there, and the places of those that are."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        n = np.where(self.keys[at] == wanted, self.n[at], 0).astype(np.int64)
        over = np.flatnonzero(n == 255)
        n[over] = self.big[1][np.searchsorted(self.big[0], at[over])]
        return n, at


class Open(OrderedDict):
    """What a worker has mapped; beyond MOST parts the one that was used longest ago is let go."""

    MOST = 4000  #: of three files each, while a process may have some 65,000

    def part(self, key, make):
        """The mapped part of key, None where there is no such file."""
        if key not in self:
            try:
                self[key] = make()
            except FileNotFoundError:
                self[key] = None
            if len(self) > self.MOST:
                self.popitem(last=False)
        self.move_to_end(key)
        return self[key]


class WordCodes:
    """In a worker: counts and codes of words from the saved word arrays, opened when a part is first asked for."""

    def __init__(self, folder: str, word_first: np.ndarray):
        self.folder, self.first, self.open = folder, word_first, Open()

    def get(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and codes of sorted distinct hashes; 0 and UNSEEN of words that were not counted."""
        known, code = np.zeros(len(kinds), np.int64), np.full(len(kinds), UNSEEN, np.uint64)
        part = (kinds % np.uint64(len(self.first))).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
            p = int(part[run[0]])
            if (saved := self.open.part(p, lambda: Counts(self.folder, f"word-{p}", np.uint64))) is not None:  # noqa: B023
                n, at = saved.find(kinds[run])
                known[run] = n
                code[run[n > 0]] = (self.first[p] + at[n > 0]).astype(np.uint64)
        return known, code


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney; fixed ones where a count of counts is 0 or a discount is not above 0, as then
    contexts would leave nothing for unseen words."""
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        found = tuple(k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        if min(found) > 0:
            return found
    return 0.5, 1.0, 1.5


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Lm:
    """Counts all rows of docs."""
    if order < 2:
        raise ValueError(f"the order is {order}, but two at least")
    spark = docs.sparkSession
    shared.ship(spark)
    folder = shared.new_path(spark, "lm")
    rows = docs.select(F.col(text).alias("text"))
    # a text's end token is counted as 8 bytes, as in the folds
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)), F.lit(0)).alias("n")).first().n
    word_parts = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // WORD_PART_BYTES))

    def save_words(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys, n, _ = _sums(_column(table, "k").view(np.uint64), _column(table, "n"))
        _save(folder, f"word-{part}", keys, n)
        # words that can be hot: the threshold below is at least this, whatever the other parts hold
        top = np.flatnonzero(n > min(int(n.sum()) // (8 * LEAST_PARTS), PART_ROWS // 8)) if len(n) else n
        return pa.table({"part": [part], "tokens": [int(n.sum())], "kinds": [len(n)], "top": [top.tolist()], "top_n": [n[top].tolist()]}, schema=pa.schema([("part", pa.int32()), ("tokens", pa.int64()), ("kinds", pa.int64()), ("top", pa.list_(pa.int64())), ("top_n", pa.list_(pa.int64()))]))

    counted = rows.mapInArrow(_word_task(word_parts), "part int, k long, n long")
    stats = counted.groupBy("part").applyInArrow(save_words, "part int, tokens long, kinds long, top array<long>, top_n array<long>").collect()  # a row for each part
    total, vocabulary = sum(r.tokens for r in stats), sum(r.kinds for r in stats)
    if vocabulary >= UNSEEN:
        raise ValueError(f"{vocabulary} distinct words do not fit 32-bit codes")
    parts = max(LEAST_PARTS, total // PART_ROWS)
    kinds = np.zeros(word_parts, np.int64)
    for r in stats:
        kinds[r.part] = r.kinds
    word_first = np.cumsum(kinds) - kinds + 1
    frequent = [int(word_first[r.part]) + k for r in stats for k, n in zip(r.top, r.top_n) if n > total / (8 * parts)]
    hot = np.unique(np.append(np.asarray(frequent, np.uint64), BEGIN))

    def save_grams(size: int):
        def save(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            gram = _unpacked(table, size)
            keys, n, places = _sums(gram_key(gram), _column(table, "n"))
            gram = gram[:, places]
            _save(folder, f"gram{size}-{part}", keys, n)
            context = gram_key(gram[:-1])
            by_context = np.argsort(context, kind="stable")
            context = context[by_context]
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            stat = np.stack([np.add.reduceat(x[by_context].astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2)], 1)
            codes, is_hot = context[first], is_in(gram[-2][by_context][first], hot)
            shared.write_array(folder, f"context{size}-{part}.k", codes[~is_hot].astype(key_type(size - 1)))
            shared.write_array(folder, f"context{size}-{part}.n", stat[~is_hot].astype(np.uint32).ravel())
            # rows of a key and four sums: those of the part's hot contexts, and its counts of counts under a key of their own
            sums = np.concatenate([codes[is_hot].view(np.int64)[:, None], stat[is_hot]], 1)
            shared.write_array(folder, f"sums{size}-{part}", np.concatenate([sums, [[-1, *_counts_of_counts(n)]]]).astype(np.int64).ravel())
            # how many different words stand before what follows; before a text's beginning nothing can
            lower, before, places = _sums(gram_key(gram[1:]), np.where(gram[1] == BEGIN, n, 1))
            if size == 2:
                return pa.table({"part": (words.mix(lower) % np.uint64(word_parts)).astype(np.int32), "k": lower.view(np.int64), "n": before})
            rest = gram[1:, places]
            return pa.table(_packed(rest, before, part_of(rest, hot, parts)))

        return save

    def save_continuations(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys, n, _ = _sums(_column(table, "k").view(np.uint64), _column(table, "n"))
        _save(folder, f"after-{part}", keys.astype(np.uint32), n)
        return pa.table({"n": [[int(n.sum()), *_counts_of_counts(n), int((n > 2).sum())]]}, schema=pa.schema([("n", pa.list_(pa.int64()))]))

    left = rows.mapInArrow(_gram_task(order, parts, hot, folder, word_first), columns(order))
    for size in range(order, 1, -1):
        left = left.groupBy("part").applyInArrow(save_grams(size), columns(size - 1))
    after = [r.n for r in left.groupBy("part").applyInArrow(save_continuations, "n array<long>").collect()]  # a row for each part

    # the parts' sums meet in Spark; a row for each hot word comes here, and longer hot contexts go to arrays
    of_grams, hot_stats = np.zeros((order - 1, 4), np.int64), np.zeros((len(hot), 4), np.int64)
    for size in range(2, order + 1) if after else []:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"sums{size}-*").load(folder).select("content")
        met = files.mapInArrow(_sums_task(parts), "part int, code long, a long, b long, c long, d long").groupBy("part", "code").agg(*[F.sum(c).alias(c) for c in "abcd"])
        if size == 2:
            for r in met.filter("code >= 0").drop("part").collect():
                hot_stats[np.searchsorted(hot, np.uint64(r.code))] += r[1:]
        else:
            met.filter("code <> -1").groupBy("part").applyInArrow(_save_hot(folder, size), "part int").collect()  # a row for each part
        of_grams[size - 2] = met.filter("code = -1").select(*"abcd").first()
    continuations, n1, n2, n3, n4, n3up = np.sum(after or [[0] * 6], axis=0).tolist()
    d1 = discounts(n1, n2, n3, n4)
    gamma1 = (d1[0] * n1 + d1[1] * n2 + d1[2] * n3up) / continuations if continuations else 1.0
    return Lm(folder, order, word_parts, parts, total, vocabulary, word_first, hot, hot_stats, (d1, *[discounts(*x) for x in of_grams.tolist()]), gamma1, continuations)


def key_type(size: int):
    """What a saved key of so many words takes."""
    return np.uint32 if size == 1 else np.uint64


def _sums_task(parts: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows = np.frombuffer(raw.as_py(), np.int64).reshape(-1, 5)
                part = (words.mix(rows[:, 0].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(rows[:, k]) for k in range(5)]], ["part", "code", *"abcd"])

    return task


def _save_hot(folder: str, size: int):
    def save(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        codes = _column(table, "code").view(np.uint64)
        order = np.argsort(codes)
        shared.write_array(folder, f"hot{size}-{part}.k", codes[order])
        shared.write_array(folder, f"hot{size}-{part}.n", np.stack([_column(table, c) for c in "abcd"], 1)[order].astype(np.int64).ravel())
        return pa.table({"part": np.array([part], np.int32)})

    return save


class Scorer:
    """In a worker: the mapped arrays, opened when a part is first asked for."""

    def __init__(self, lm: Lm):
        self.lm, self.open, self.words = lm, Open(), WordCodes(lm.folder, lm.word_first)

    def _part(self, kind: str, part: int, dtype):
        return self.open.part((kind, part), lambda: Counts(self.lm.folder, f"{kind}-{part}", dtype))

    def _spread(self, kind: str, keys: np.ndarray, part: np.ndarray, dtype) -> np.ndarray:
        """Counts of sorted distinct keys from the parts that hold them."""
        out = np.zeros(len(keys), np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order])) + 1
        for run in np.split(order, edges) if len(order) else []:
            counts = self._part(kind, int(part[run[0]]), dtype)
            if counts is not None:
                out[run] = counts.get(keys[run].astype(dtype))
        return out

    def _contexts(self, size: int, keys: np.ndarray, last: np.ndarray) -> np.ndarray:
        """total, n1, n2, n3+ of sorted distinct contexts of n-grams of size words, with each one's last word."""
        lm = self.lm
        out, is_hot = np.zeros((len(keys), 4), np.int64), is_in(last, lm.hot)
        out[~is_hot] = self._stats(f"context{size}", keys[~is_hot], key_type(size - 1), np.uint32)
        out[is_hot] = lm.hot_stats[np.searchsorted(lm.hot, keys[is_hot])] if size == 2 else self._stats(f"hot{size}", keys[is_hot], np.uint64, np.int64)
        return out

    def _stats(self, kind: str, keys: np.ndarray, of_key, of_stat) -> np.ndarray:
        folder, out = self.lm.folder, np.zeros((len(keys), 4), np.int64)
        part = (words.mix(keys) % np.uint64(self.lm.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
            p = int(part[run[0]])
            mapped = lambda: (shared.map_array(folder, f"{kind}-{p}.k", of_key), shared.map_array(folder, f"{kind}-{p}.n", of_stat).reshape(-1, 4))  # noqa: B023, E731
            if (found := self.open.part((kind, p), mapped)) is not None and len(found[0]):
                saved, stats = found
                wanted = keys[run].astype(of_key)
                at = np.minimum(np.searchsorted(saved, wanted), len(saved) - 1)
                out[run] = np.where((saved[at] == wanted)[:, None], stats[at], 0)
        return out

    def block(self, block: words.Block) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and model score of each row."""
        lm = self.lm
        token, at = tokens(block)
        row = np.repeat(np.arange(block.rows), np.diff(at))
        kinds, of = np.unique(token, return_inverse=True)
        known, codes = self.words.get(kinds)
        base = np.log10((known + 0.1) / (lm.train_tokens + 0.1 * (lm.vocabulary + 1)))

        sorted_codes, of_code = np.unique(codes, return_inverse=True)  # unseen words share one
        after = self._spread("after", sorted_codes, (words.mix(sorted_codes) % np.uint64(lm.word_parts)).astype(np.int64), np.uint32)[of_code]
        d1 = np.array([0.0, *lm.discounts[0]])
        low = np.maximum(after - d1[np.minimum(after, 3)], 0) / max(lm.continuations, 1) + lm.gamma1 / (lm.vocabulary + 1)

        gram, p = grams(codes[of], at, lm.order), low[of]
        for size in range(2, lm.order + 1):
            keys, first, which = np.unique(gram_key(gram[-size:]), return_index=True, return_inverse=True)
            one = gram[-size:, first]
            seen = self._spread(f"gram{size}", keys, part_of(one, lm.hot, lm.parts), np.uint64)
            contexts, first, of_context = np.unique(gram_key(one[:-1]), return_index=True, return_inverse=True)
            stats = self._contexts(size, contexts, one[-2, first])
            d = np.array([0.0, *lm.discounts[size - 1]])
            total = stats[of_context, 0]
            back = stats[of_context, 1:] @ d[1:]
            own = np.maximum(seen - d[np.minimum(seen, 3)], 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                own, back = np.where(total > 0, own / total, 0.0), np.where(total > 0, back / total, 1.0)
            p = own[which] + back[which] * p
        log_p = np.log10(p)
        count = lambda x: np.bincount(row, x, block.rows)
        return np.diff(at), count((known > 0)[of]).astype(np.int64), count(base[of]), count(log_p)


def score(docs: DataFrame, lm: Lm, text: str = "text") -> DataFrame:
    """docs without its text, with n_tokens, n_known, base_score, score (log10 probability of the text and its end)."""
    keep = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "base_score", "score")]
    rows = docs.select(*keep, F.col(text).alias("text"))
    from pyspark.sql import types as T

    new = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([*rows.select(*keep).schema.fields, *[T.StructField(n, k) for n, k in new]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lm)
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                got = scorer.block(block)
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array(x) for x in got]], [*keep, *[n for n, _ in new]])

    return rows.mapInArrow(task, schema)


def perplexity(n_tokens: Column, score: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def lm_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 10, order: int = 2) -> DataFrame:
    """Trains on the rows outside fold 0 and scores every row. The scores are written, and the model's folder deleted."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key, folds, 0).alias("held_out"), F.col(text).alias("text"))
    lm = train(rows.filter("not held_out"), order=order)
    out = shared.materialize(score(rows, lm).withColumn("train_tokens", F.lit(lm.train_tokens).cast("long")), "lm-scores")
    shared.remove(docs.sparkSession, lm.folder)
    return out
