import os
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from reelmill.llm import learning, quality, toxicity
from reelmill.llm import words as W

from .common import frame


def made(n, seed=0):
    """Labelled texts: insults make a text toxic; signs glued to words make it poor."""
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(vocabulary, rng.integers(5, 200)))
        toxic, poor = bool(rng.random() < 0.3), bool(rng.random() < 0.3)
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w[rng.integers(len(w))] = rng.choice(["zidiotz", "zclownz", "zscumz"])
        if poor:
            w = [x + "***" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def world(spark):
    rows, labels = made(500)
    rows += [(1000, None), (1001, ""), (1001, ""), (1002, "word " * 5000), (None, "zidiotz zscumz a b")]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, (q, t)) for i, q, t in labels), rows


@pytest.mark.parametrize("module, fn, place, folds, fold", [(toxicity, "toxicity", 1, 4, 2), (quality, "quality", 0, 5, 0)])
def test_held_out_accuracy(world, module, fn, place, folds, fold):
    docs, labels, truth, rows = world
    got = getattr(module, fn)(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id][place] for r in held]) > 0.93


def test_one_label_or_none(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.0}
    assert quality.quality(frame(spark, []), none).count() == 0
    good = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality(frame(spark, [(i, "x") for i in range(9)]), good).collect()} == {1.0}


def test_the_sample_is_bounded(spark):
    rows, labels = made(200)
    texts, y = learning.labelled_sample(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "toxic", 4, 2, rows=20)
    assert len(texts) == 20 and y.sum() == 10


def numeric(loss, p, k, i, e):
    old = p[k][i]
    p[k][i] = old + e
    up = loss()
    p[k][i] = old - e
    down = loss()
    p[k][i] = old
    return (up - down) / (2 * e)


def plain_toxicity(model, text):
    """The recurrent network, one window and one step at a time."""
    p, reader = model.params, toxicity.read(next(W.blocks(pa.array([text or ""]))))
    sig = lambda x: 1 / (1 + np.exp(-x))
    best = -np.inf
    for window in reader.windows:
        xs = []
        for k in window[window >= 0]:
            grams = reader.grams[reader.gram_of[k] : reader.gram_of[k + 1]]
            xs.append(np.concatenate([p["word"][reader.word[k]], p["gram"][grams].mean(0)]))
        states = np.zeros((len(xs), 2 * toxicity.HIDDEN))
        for way, order, side in (("f", range(len(xs)), 0), ("b", range(len(xs) - 1, -1, -1), toxicity.HIDDEN)):
            h, n = np.zeros(toxicity.HIDDEN), toxicity.HIDDEN
            for t in order:
                ahead, back = xs[t] @ p[f"x{way}"] + p[f"c{way}"], h @ p[f"h{way}"]
                z, r = sig(ahead[:n] + back[:n]), sig(ahead[n : 2 * n] + back[n : 2 * n])
                new = np.tanh(ahead[2 * n :] + r * back[2 * n :])
                h = (1 - z) * new + z * h
                states[t, side : side + n] = h
        weight = np.exp([np.tanh(s @ p["wa"]) @ p["va"] for s in states])
        pooled = sum((a / weight.sum() * s for a, s in zip(weight, states)), np.zeros(2 * toxicity.HIDDEN))
        best = max(best, pooled @ p["w"] + p["b"])
    return sig(model.slope * best + model.shift)


def plain_quality(model, text):
    """Gated attention over passages, one passage at a time."""
    p, (x, _) = model.params, quality.encode(next(W.blocks(pa.array([text or ""]))))
    hs, es = [], []
    for features in (x - model.mean) / model.scale:
        h = np.tanh(features @ p["e"] + p["eb"])
        hs.append(h)
        es.append((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"])
    weight = np.exp(np.array(es) - max(es))
    logit = sum(a / weight.sum() * h for a, h in zip(weight, hs)) @ p["w"] + p["b"]
    return 1 / (1 + np.exp(-(model.slope * logit + model.shift)))


@pytest.mark.parametrize("module, fn, place, plain", [(toxicity, "toxicity", 1, plain_toxicity), (quality, "quality", 0, plain_quality)])
def test_scores_as_by_plain_loops(world, module, fn, place, plain):
    """The whole query against the same model run by plain loops over every text."""
    docs, labels, truth, rows = world
    model = module.train(docs, labels)
    few = {i: t for i, t in rows if i is not None and (i % 25 == 0 or i > 500)}
    got = {r.doc_id: r for r in getattr(module, fn)(docs, labels).collect() if r.doc_id in few}
    for i, text in few.items():
        want = plain(model, text)
        assert got[i].score == pytest.approx(want, abs=2e-4) and (got[i].predicted == (want >= 0.3) or abs(want - 0.3) < 1e-3)


def test_the_sample_takes_other_names_and_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, None)], "k long, body string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    keep = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts, y = learning.labelled_sample(docs, labels, "toxic", 4, 2, text="body", key="k")
    assert list(zip(texts, y)) == [x for i, x in ((1, ("a", 0.0)), (2, ("c", 1.0)), (3, ("", 0.0))) if i in keep]


def test_recurrent_gradients():
    p = {k: np.asarray(v, np.float64) for k, v in toxicity.new_params(3).items()}
    reader = toxicity.read(next(W.blocks(pa.array(["ab cd ef gh ij", "x yy zzz idiot a b c", "q", ""]))))
    windows, y = reader.windows[:, :8], np.array([0.0, 1, 1, 0])
    table, scale = toxicity.inputs(p, reader)
    logit, kept = toxicity.forward(p, table, windows, keep=True)
    g = toxicity.backward(p, reader, table, scale, windows, kept, (learning.sigmoid(logit) - y) / 4)
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * toxicity.forward(p, toxicity.inputs(p, reader)[0], windows)))))
    for k in g:
        if np.ndim(g[k]):
            i = np.unravel_index(np.argmax(np.abs(g[k])), np.shape(g[k]))
            assert g[k][i] == pytest.approx(numeric(loss, p, k, i, 1e-3), rel=2e-3, abs=1e-6)


def test_attention_gradients():
    x, row = quality.encode(next(W.blocks(pa.array(["ab cd ef gh " * 30, "x y | zz!", "q"]))))
    p, y = quality.new_params(1), np.array([0.0, 1, 1])
    logit, kept = quality.forward(p, x, row, 3)
    g = quality.backward(p, x, row, kept, (learning.sigmoid(logit) - y) / 3)
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * quality.forward(p, x, row, 3)[0]))))
    for k in g:
        if np.ndim(g[k]):
            i = np.unravel_index(np.argmax(np.abs(g[k])), np.shape(g[k]))
            assert g[k][i] == pytest.approx(numeric(loss, p, k, i, 1e-4), rel=1e-3, abs=1e-7)


def test_windows_cover_every_word():
    for n in (0, 1, 48, 63, 64, 65, 112, 113, 500):
        reader = toxicity.read(next(W.blocks(pa.array([" ".join(f"w{i}" for i in range(n)) or "x"]))))
        assert set(reader.windows[reader.windows >= 0].tolist()) == set(range(max(n, 1)))


def test_long_words_are_read_to_their_end():
    texts = ["漢字" * 300, "a" * 39 + "é🎉" * 20 + " b", "x" * 40, "y" * 41, None, "", "🎉" * 11 + " " + "z" * 40, "one-two_three" * 4 + "\u00a0end。", "-" * 90]
    block = next(W.blocks(pa.array(texts)))
    found = toxicity.pieces(block, W.split(block))
    raw = block.data.tobytes()
    got = [[] for _ in texts]
    for start, end, row in zip(found.starts, found.ends, found.row):
        assert 0 < end - start <= 40
        got[row].append(raw[start:end].decode())
    assert ["".join(x) for x in got] == [(t or "").replace(" ", "") for t in texts]
    assert found.per_row.tolist() == [len(x) for x in got] and [len(got[k]) for k in (2, 3)] == [1, 5]
    assert got[7][:6] == ["one", "-", "two", "_", "threeone", "-"] and got[7][-3:] == ["\u00a0", "end", "。"]
    a, b = (toxicity.read(next(W.blocks(pa.array(["漢字" * 300 + end])))) for end in ("罵", "倒"))
    assert set(a.grams.tolist()) != set(b.grams.tolist())


@pytest.mark.parametrize("joint, passage", [("-", 0), ("\u00a0", 0), ("", 8)])
def test_toxic_texts_without_spaces(joint, passage):
    """Insults after the first 50 bytes of texts without spaces; without any joint, as a passage."""
    rows, labels = made(600, 3)
    y, rng, texts = np.array([t for _, _, t in labels], np.float32), np.random.default_rng(1), []
    for (_, text), toxic in zip(rows, y):
        w = text.split(" ")
        if passage:
            w = [x for x in w if "z" not in x]
            at = rng.integers(len(w) + 1)
            w[at:at] = rng.choice(["zidiotz", "zclownz", "zscumz"], passage if toxic else 0).tolist()
        texts.append(joint.join(["abcdefghij"] * 5 + w))
    model = toxicity.fit(texts[:450], y[:450])
    score = np.concatenate([model.block(block) for block in W.blocks(pa.array(texts[450:]))])
    assert np.mean((score >= 0.3) == y[450:]) > 0.93


def test_mapped_parts_are_let_go():
    from reelmill.llm import language_model as lm

    held = lm.Open()
    held.MOST = 3
    made = []

    def make(k):
        if k == 5:
            raise FileNotFoundError
        made.append(k)
        return k

    for k in (1, 2, 3, 1, 4, 5, 1):
        assert held.part(k, lambda: make(k)) == (None if k == 5 else k)
    assert list(held) == [4, 5, 1] and made == [1, 2, 3, 4]


def test_workers_give_back_what_a_task_took(spark):
    """A worker is used again by the next stages, beside whose memory the most of an earlier task would stay."""

    def make():
        def score(block):
            took = [np.ones(12_000) for _ in range(4000)]  # 384 MB in small pieces
            os.above = np.ones(12_000)  # and one that stays, above them
            return np.full(block.rows, os.getpid() + 0 * len(took))

        return score

    pids = {int(r.score) for r in learning.score_rows(frame(spark, [(1, "a")]), make, 4, 2).collect()}
    assert len(pids) == 1
    held = int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pids.pop()}/status").read_text()).group(1)) / 1024
    assert held < 350, held
