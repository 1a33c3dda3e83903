"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins an embedding of the word with the mean embedding of its character 3- and 4-grams (both hashed), so
unseen words are read by their letters. A word of over 40 bytes is cut into consecutive pieces, which are words of their
own, so that windows pass over the whole of a text without spaces: between signs and letters, and what is then still over
40 bytes between characters into pieces of word size (12 bytes at most). Two recurrent networks read a window of words in either direction; attention
weighs their states; a linear layer gives the window's logit. Windows overlap, and all windows of every whole text are
scored: the text's logit is that of its highest window, scaled to a probability on a part of the sample kept for it.

Training takes at most ``learning.SAMPLE`` labelled rows. All their windows bear the text's label in the first round;
afterwards only each text's highest window is trained on, since one toxic passage makes a text toxic.

Defined results: a null or empty text has one empty window and gets its score; all windows of a very long text are scored,
and of windows that tie for the highest any gives the same score; with no labelled rows, or of one label
only, every score is 0; repeated rows are scored each; an empty table gives an empty result; labels, lang and source are
never inputs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning, words
from .shared import release, with_rows

WINDOW, STEP = 64, 48
LONGEST, PIECE = 40, 12  #: bytes of a word that is read whole, and of a piece of a longer one, at most
WORD_BUCKETS, GRAM_BUCKETS = 1 << 13, 1 << 13
WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
SIGN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
ROUNDS = 5
BATCH = 256  #: windows in a training step
PART = 2048  #: windows scored at once
FOLDS, FOLD = 4, 2


class Reader(NamedTuple):
    """A block's distinct words as bucket numbers, and its windows as rows of word numbers (-1: none)."""

    word: np.ndarray
    grams: np.ndarray
    gram_of: np.ndarray  #: words+1 offsets into grams
    windows: np.ndarray
    row: np.ndarray  #: of each window


def signs(data: np.ndarray) -> np.ndarray:
    """Whether each byte is of a sign: ASCII without letters and digits, U+0080-BF, U+2000-207F, U+3000-303F."""
    out = SIGN[data]
    two = data == 0xC2
    out |= two
    out[1:] |= two[:-1]
    lead, second = data[:-1], data[1:]
    three = (lead == 0xE2) & ((second == 0x80) | (second == 0x81)) | (lead == 0xE3) & (second == 0x80)
    out[:-1] |= three
    out[1:] |= three
    out[2:] |= three[:-1]
    return out


def pieces(block: words.Block, found: words.Words) -> words.Words:
    """The words, those of over LONGEST bytes cut where signs and letters meet, and runs of over LONGEST bytes between
    characters into pieces of at most PIECE bytes."""
    long = found.ends - found.starts > LONGEST
    if not long.any():
        return found
    sign = signs(block.data)
    cut = np.flatnonzero(sign[1:] != sign[:-1]) + 1
    word = np.searchsorted(found.starts, cut) - 1
    cut = cut[(word >= 0) & long[word] & (cut < found.ends[word])]
    starts, ends = np.sort(np.append(found.starts, cut)), np.sort(np.append(found.ends, cut))
    step = PIECE - 3  # a cut goes back over at most 3 bytes of a character
    size = ends - starts
    parts = np.where(size > LONGEST, -(-size // step), 1)
    of = np.repeat(np.arange(len(size)), parts)
    place = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, ends = starts[of] + step * place, ends[of]
    for _ in range(3):
        starts -= (place > 0) & (block.data[starts] & 0xC0 == 0x80)
    inner = np.flatnonzero(place[1:])
    ends[inner] = starts[inner + 1]
    row = np.searchsorted(block.offsets, starts, "right") - 1
    return words.Words(starts, ends, row, np.bincount(row, minlength=block.rows))


def read(block: words.Block) -> Reader:
    found = pieces(block, words.split(block))
    h = words.hashes(block, found)
    kinds, first, number = np.unique(h, return_index=True, return_inverse=True)
    starts, ends = found.starts[first], found.ends[first]
    size = ends - starts
    # the letters of distinct words with a mark before and after, one word after another
    total = np.cumsum(size + 2)
    begin = total - size - 2
    letters = np.full(int(total[-1]) if len(total) else 0, 32, np.uint64)
    place = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    letters[np.arange(int(size.sum())) + np.repeat(begin + 1 - (np.cumsum(size) - size), size)] = words.LOWER[block.data[place]]
    word_of = np.repeat(np.arange(len(kinds)), size + 2)
    grams, owner = [], []
    for n in (3, 4):
        if len(letters) >= n:
            code = np.zeros(len(letters) - n + 1, np.uint64)
            for k in range(n):
                code = code << np.uint64(8) | letters[k : k + len(code)]
            inside = word_of[: len(code)] == word_of[n - 1 :]
            grams.append((words.mix(code[inside]) % np.uint64(GRAM_BUCKETS)).astype(np.int16))
            owner.append(word_of[: len(code)][inside])
    grams, owner = (np.concatenate(x) if x else np.zeros(0, np.int16) for x in (grams, owner))
    order = np.argsort(owner, kind="stable")
    gram_of = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(kinds)))])
    # windows
    n = found.per_row
    per_row = np.maximum(-(-(n - (WINDOW - STEP)) // STEP), 1)
    row = np.repeat(np.arange(block.rows), per_row)
    start = found.first[row] + STEP * (np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row))
    at = start[:, None] + np.arange(WINDOW)
    inside = at < found.first[row + 1][:, None]
    windows = np.where(inside, number[np.minimum(at, len(number) - 1)] if len(number) else -1, -1).astype(np.int32)
    return Reader((kinds % np.uint64(WORD_BUCKETS)).astype(np.int64), grams[order], gram_of, windows, row)


def new_params(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    d = WORD_DIM + GRAM_DIM
    out = {"word": draw(WORD_BUCKETS, WORD_DIM, scale=0.1), "gram": draw(GRAM_BUCKETS, GRAM_DIM, scale=0.2)}
    for way in "fb":
        out |= {f"x{way}": draw(d, 3 * HIDDEN, scale=d**-0.5), f"h{way}": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
    return out | {"wa": draw(2 * HIDDEN, ATTEND, scale=0.3), "va": draw(ATTEND, scale=0.3), "w": draw(2 * HIDDEN, scale=0.3), "b": np.zeros((), np.float32)}


def inputs(p: dict, reader: Reader) -> tuple[np.ndarray, np.ndarray]:
    """The input of each distinct word, and one over its number of grams."""
    sums = np.zeros((len(reader.word), GRAM_DIM), np.float32)
    size = np.diff(reader.gram_of)
    some = size > 0
    if some.any():
        sums[some] = np.add.reduceat(p["gram"][reader.grams], reader.gram_of[:-1][some])
    scale = (1 / np.maximum(size, 1)).astype(np.float32)
    return np.concatenate([p["word"][reader.word], sums * scale[:, None]], 1), scale


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def forward(p: dict, table: np.ndarray, windows: np.ndarray, keep: bool = False):
    """Logits of windows over the input table; with keep, also what backward() needs."""
    b, steps = windows.shape
    mask = (windows >= 0).astype(np.float32)
    number = np.ascontiguousarray(windows.T)
    full = (windows >= 0).all(0)
    states = np.zeros((steps, b, 2 * HIDDEN), np.float32)
    tape = {}
    for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        side = slice(0, HIDDEN) if way == "f" else slice(HIDDEN, None)
        ahead = np.concatenate([table @ p[f"x{way}"] + p[f"c{way}"], np.zeros((1, 3 * HIDDEN), np.float32)])  # -1: nothing
        h = np.zeros((b, HIDDEN), np.float32)
        kept = []
        for t in order:
            m = mask[:, t : t + 1]
            gate = ahead[number[t]]
            back = h @ p[f"h{way}"]
            zr = _sigmoid(gate[:, : 2 * HIDDEN] + back[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(gate[:, 2 * HIDDEN :] + r * back[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if keep:
                kept.append((t, h, z, r, n, back[:, 2 * HIDDEN :]))
            h = new if full[t] else h + m * (new - h)
            states[t, :, side] = h
        tape[way] = kept
    u = np.tanh(states @ p["wa"])
    e = (u @ p["va"]).T + (mask - 1) * 1e4
    e = np.exp(e - e.max(1, keepdims=True))
    alpha = e / e.sum(1, keepdims=True) * (mask.any(1, keepdims=True))
    pooled = np.einsum("bt,tbh->bh", alpha, states)
    logits = pooled @ p["w"] + p["b"]
    return (logits, (mask, states, u, alpha, pooled, tape)) if keep else logits


def backward(p: dict, reader: Reader, table: np.ndarray, scale: np.ndarray, windows: np.ndarray, kept, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    mask, states, u, alpha, pooled, tape = kept
    g = {"w": pooled.T @ d_logit, "b": d_logit.sum()}
    d_pooled = d_logit[:, None] * p["w"]
    d_alpha = np.einsum("bh,tbh->bt", d_pooled, states)
    d_states = alpha.T[:, :, None] * d_pooled[None]
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(1, keepdims=True))
    d_u = d_e.T[:, :, None] * p["va"] * (1 - u * u)
    g["va"] = np.einsum("bt,tba->a", d_e, u)
    g["wa"] = np.einsum("tbh,tba->ha", states, d_u)
    d_states += d_u @ p["wa"].T
    d_table = np.zeros_like(table)
    for way in "fb":
        side = slice(0, HIDDEN) if way == "f" else slice(HIDDEN, None)
        g[f"h{way}"] = np.zeros_like(p[f"h{way}"])
        d_h = np.zeros((len(windows), HIDDEN), np.float32)
        d_ahead = np.zeros((len(table) + 1, 3 * HIDDEN), np.float32)
        for t, h, z, r, n, back in reversed(tape[way]):
            d_h = d_h + d_states[t, :, side]
            m = mask[:, t : t + 1]
            d_new = d_h * m
            d_n = d_new * (1 - z) * (1 - n * n)
            d_z = d_new * (h - n) * z * (1 - z)
            d_r = d_n * back * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r, d_n], 1)
            d_back = np.concatenate([d_z, d_r, d_n * r], 1)
            np.add.at(d_ahead, windows[:, t], d_gate)
            g[f"h{way}"] += h.T @ d_back
            d_h = d_h * (1 - m) + d_new * z + d_back @ p[f"h{way}"].T
        d_ahead = d_ahead[:-1]
        g[f"x{way}"], g[f"c{way}"] = table.T @ d_ahead, d_ahead.sum(0)
        d_table += d_ahead @ p[f"x{way}"].T
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    used = np.flatnonzero(np.abs(d_table).sum(1))
    np.add.at(g["word"], reader.word[used], d_table[used, :WORD_DIM])
    size = np.diff(reader.gram_of)[used]
    place = np.arange(int(size.sum())) + np.repeat(reader.gram_of[used] - (np.cumsum(size) - size), size)
    np.add.at(g["gram"], reader.grams[place], np.repeat(d_table[used, WORD_DIM:] * scale[used, None], size, 0))
    return g


def narrowed(reader: Reader, windows: np.ndarray) -> tuple[Reader, np.ndarray]:
    """The part of a reader that some windows need, and the windows in its numbers."""
    kinds, number = np.unique(windows, return_inverse=True)
    number = number.reshape(windows.shape)
    if kinds[0] < 0:
        kinds, number = kinds[1:], number - 1
    size = np.diff(reader.gram_of)[kinds]
    place = np.arange(int(size.sum())) + np.repeat(reader.gram_of[kinds] - (np.cumsum(size) - size), size)
    return Reader(reader.word[kinds], reader.grams[place], np.concatenate([[0], np.cumsum(size)]), windows, reader.row), number


def logits_of(p: dict, reader: Reader, windows: np.ndarray | None = None) -> np.ndarray:
    table, _ = inputs(p, reader)
    windows = reader.windows if windows is None else windows
    return np.concatenate([forward(p, table, windows[i : i + PART]) for i in range(0, len(windows), PART)] or [np.zeros(0, np.float32)])


def highest(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.full(rows, -np.inf, np.float32)
    np.maximum.at(out, row, values)
    return out


class Toxicity(NamedTuple):
    params: dict
    slope: float
    shift: float

    def block(self, block: words.Block) -> np.ndarray:
        if not self.params:
            return np.zeros(block.rows)
        reader = read(block)
        return learning.sigmoid(self.slope * highest(logits_of(self.params, reader), reader.row, block.rows) + self.shift)


def fit(texts: list[str], y: np.ndarray, rounds: int = ROUNDS, seed: int = 1) -> Toxicity:
    if not len(y) or y.min() == y.max():
        return Toxicity({}, 1.0, 0.0)
    rng = np.random.default_rng(seed)
    spare = np.zeros(len(y), bool)  # a fifth calibrates
    spare[rng.permutation(len(y))[: len(y) // 5]] = True
    p = new_params(seed)
    adam = learning.Adam(p, 0.01)
    blocks = []
    order = rng.permutation(len(y))
    texts = [texts[i] for i in order]
    y, spare = y[order], spare[order]
    for block in words.blocks(pa.array(texts, pa.large_string())):
        here = slice(block.first, block.first + block.rows)
        blocks.append((read(block), y[here], spare[here]))
    passes = max(1, round(3000 / len(y)))  # a small sample is gone over more often
    for turn in range(rounds * passes):
        for k in rng.permutation(len(blocks)):
            reader, label, out = blocks[k]
            use = np.flatnonzero(~out[reader.row])
            if turn >= passes:  # each text's highest window
                value = logits_of(p, reader)
                top = highest(value, reader.row, len(label))
                use = use[value[use] >= top[reader.row[use]]]
            use = rng.permutation(use)
            for i in range(0, len(use), BATCH):
                pick = use[i : i + BATCH]
                part, windows = narrowed(reader, reader.windows[pick])
                table, scale = inputs(p, part)
                logit, kept = forward(p, table, windows, keep=True)
                target = label[reader.row[pick]]
                d = (learning.sigmoid(logit) - target).astype(np.float32) / len(pick)
                adam.update(backward(p, part, table, scale, windows, kept, d))
    top, truth = [], []
    for reader, label, out in blocks:
        value = highest(logits_of(p, reader), reader.row, len(label))
        top.append(value[out])
        truth.append(label[out])
    slope, shift = learning.calibrated(np.concatenate(top), np.concatenate(truth))
    return Toxicity({k: np.asarray(v, np.float32) for k, v in p.items()}, slope, shift)


def train(docs: DataFrame, labels: DataFrame, rows: int = learning.SAMPLE, text: str = "text", key: str = "doc_id") -> Toxicity:
    texts, y = learning.labelled_sample(docs, labels, "toxic", FOLDS, FOLD, rows, text, key)
    release(docs.sparkSession)
    model = fit(texts, y)
    release(docs.sparkSession)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    return apply(docs, train(docs, labels, text=text, key=key), text, key)


def apply(docs: DataFrame, model: Toxicity, text: str = "text", key: str = "doc_id") -> DataFrame:
    return learning.score_rows(docs, lambda: model.block, FOLDS, FOLD, text, key)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic."""
    model = train(docs, labels)
    marked, row = with_rows(docs)
    bad = apply(marked, model, key=row).filter("predicted = 1").select(F.col("doc_id").alias(row))
    return marked.join(bad, row, "left_anti").drop(row)
