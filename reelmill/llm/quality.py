"""Quality by attention-based multiple-instance learning over passages.

A text is a bag of passages of 64 words. Every passage is encoded: shares of kinds of characters, word lengths, repeats
inside the passage and of its word pairs elsewhere in the text, and hashed counts of its words. A layer turns that into a
representation; gated attention (tanh times sigmoid) learns from the texts' labels which passages matter; the weighted
sum of the representations is scored by a linear layer and calibrated on a part of the sample kept for it.

Training takes at most ``learning.SAMPLE`` labelled rows, with all passages of each.

Defined results: a null or empty text is one empty passage and gets its score; a very long text is read whole, passage by
passage; scores depend on no order, so there are no ties; with no labelled rows, or of one label
only, every score is 0 or 1 as that label says (0 without any); repeated rows are scored each; an empty table gives an
empty result; labels, lang and source are never inputs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import learning, words

PASSAGE = 64
HASHED = 32
FEATURES = 18 + HASHED
REPRESENTATION, GATE = 16, 8
ROUNDS = 30
BATCH = 64  #: texts in a training step
FOLDS, FOLD = 5, 0

UPPER, LOWER_CASE, DIGIT, PIPE, BANG, MARK, END, COMMA, OTHER, HIGH = range(10)
KIND = np.full(256, OTHER, np.int64)
KIND[128:] = HIGH
KIND[65:91], KIND[97:123], KIND[48:58] = UPPER, LOWER_CASE, DIGIT
for kind, signs in ((PIPE, b"|"), (BANG, b"!"), (MARK, b"#$%&*@"), (END, b".?"), (COMMA, b",;:")):
    KIND[list(signs)] = kind


def encode(block: words.Block) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and its row; a row without words has one passage of zeros."""
    found = words.split(block)
    per_row = np.maximum(-(-found.per_row // PASSAGE), 1)
    row = np.repeat(np.arange(block.rows), per_row)
    base = np.cumsum(per_row) - per_row
    n = len(row)
    passage = base[found.row] + (np.arange(len(found.row)) - found.first[found.row]) // PASSAGE
    out = np.zeros((n, FEATURES), np.float32)
    if not len(passage):
        return out, row
    count = np.bincount(passage, minlength=n)
    size = found.ends - found.starts
    sums = lambda x: np.bincount(passage, x, n)
    letters = np.maximum(sums(size), 1)
    # bytes of words by kind
    kinds = KIND[block.data]
    for k in range(10):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        out[:, k] = sums(total[found.ends] - total[found.starts]) / letters
    many = np.maximum(count, 1)
    h = words.hashes(block, found)
    distinct = lambda key, of: np.bincount((np.unique(key) // np.uint64(1 << 40)).astype(np.int64), minlength=of)[:of]
    low = h & np.uint64((1 << 40) - 1)
    out[:, 10] = distinct(passage.astype(np.uint64) << np.uint64(40) | low, n) / many
    out[:, 11] = sums(size) / many / 10
    out[:, 12] = sums(size > 15) / many
    lines = np.concatenate([[0], np.cumsum(block.data == 10)])
    gap_start = np.concatenate([[0], found.ends[:-1]])
    out[:, 13] = sums(lines[found.starts] - lines[np.minimum(gap_start, found.starts)]) / many
    # word pairs that the text has more than once
    pair = words.mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    inside = found.row[:-1] == found.row[1:]
    key = words.mix(pair[inside] ^ words.mix(found.row[:-1][inside].astype(np.uint64)))
    _, of, times = np.unique(key, return_inverse=True, return_counts=True)
    out[:, 14] = np.bincount(passage[:-1][inside], times[of] > 1, n) / many
    ratio = np.bincount(found.row, minlength=block.rows)
    out[:, 15] = (distinct(found.row.astype(np.uint64) << np.uint64(40) | low, block.rows) / np.maximum(ratio, 1))[row]
    out[:, 16] = np.log1p(ratio)[row] / 10
    out[:, 17] = count / PASSAGE
    bag = np.bincount(passage * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    out[:, 18:] = np.sqrt(bag / many[:, None])
    return out, row


def new_params(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
    return {"e": draw(FEATURES, REPRESENTATION), "eb": np.zeros(REPRESENTATION), "v": draw(REPRESENTATION, GATE), "u": draw(REPRESENTATION, GATE), "a": draw(GATE), "w": draw(REPRESENTATION), "b": np.zeros(())}


def forward(p: dict, x: np.ndarray, bag: np.ndarray, bags: int):
    """The logit of each bag, and what backward() needs. bag: of each passage, ascending; none is empty."""
    h = np.tanh(x @ p["e"] + p["eb"])
    t, s = np.tanh(h @ p["v"]), learning.sigmoid(h @ p["u"])
    e = (t * s) @ p["a"]
    first = np.searchsorted(bag, np.arange(bags))
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    alpha = e / np.add.reduceat(e, first)[bag]
    pooled = np.add.reduceat(alpha[:, None] * h, first)
    return pooled @ p["w"] + p["b"], (h, t, s, alpha, pooled, first)


def backward(p: dict, x: np.ndarray, bag: np.ndarray, kept, d: np.ndarray) -> dict[str, np.ndarray]:
    h, t, s, alpha, pooled, first = kept
    g = {"w": pooled.T @ d, "b": d.sum()}
    d_pooled = (d[:, None] * p["w"])[bag]
    d_alpha = (d_pooled * h).sum(1)
    d_e = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, first)[bag])
    g["a"] = (t * s).T @ d_e
    d_gate = d_e[:, None] * p["a"]
    d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
    g["v"], g["u"] = h.T @ d_t, h.T @ d_s
    d_h = (alpha[:, None] * d_pooled + d_t @ p["v"].T + d_s @ p["u"].T) * (1 - h * h)
    g["e"], g["eb"] = x.T @ d_h, d_h.sum(0)
    return g


class Quality(NamedTuple):
    params: dict
    mean: np.ndarray
    scale: np.ndarray
    slope: float
    shift: float
    constant: float | None = None

    def block(self, block: words.Block) -> np.ndarray:
        if self.constant is not None:
            return np.full(block.rows, self.constant)
        x, row = encode(block)
        logit, _ = forward(self.params, (x - self.mean) / self.scale, row, block.rows)
        return learning.sigmoid(self.slope * logit + self.shift)


def fit(texts: list[str], y: np.ndarray, rounds: int = ROUNDS, seed: int = 1) -> Quality:
    if not len(y) or y.min() == y.max():
        return Quality({}, np.zeros(0), np.zeros(0), 1.0, 0.0, float(y[0]) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    features, owner = [], []
    for block in words.blocks(pa.array(texts, pa.large_string())):
        x, row = encode(block)
        features.append(x)
        owner.append(row + block.first)
    x, owner = np.concatenate(features), np.concatenate(owner)
    mean, scale = x.mean(0), x.std(0) + 0.05
    x = (x - mean) / scale
    first = np.searchsorted(owner, np.arange(len(y) + 1))
    order = rng.permutation(len(y))
    spare, use = order[: len(y) // 5], order[len(y) // 5 :]  # a fifth calibrates
    p = new_params(seed)
    adam = learning.Adam(p, 0.005)

    def gathered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = first[rows + 1] - first[rows]
        at = np.arange(int(size.sum())) + np.repeat(first[rows] - (np.cumsum(size) - size), size)
        return x[at], np.repeat(np.arange(len(rows)), size)

    for _ in range(rounds * max(1, round(2000 / len(y)))):
        use = rng.permutation(use)
        for i in range(0, len(use), BATCH):
            pick = use[i : i + BATCH]
            own, bag = gathered(pick)
            logit, kept = forward(p, own, bag, len(pick))
            adam.update(backward(p, own, bag, kept, (learning.sigmoid(logit) - y[pick]) / len(pick)))
    logit, _ = forward(p, *gathered(spare), len(spare))
    return Quality(p, mean, scale, *learning.calibrated(logit, y[spare]))


def train(docs: DataFrame, labels: DataFrame, rows: int = learning.SAMPLE, text: str = "text", key: str = "doc_id") -> Quality:
    return fit(*learning.labelled_sample(docs, labels, "quality", FOLDS, FOLD, rows, text, key))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = train(docs, labels, text=text, key=key)
    return learning.score_rows(docs, lambda: model.block, FOLDS, FOLD, text, key)
