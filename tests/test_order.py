"""Long groups in order: smoothing, quantiles, two ends, texts and islands, against plain loops."""

import contextlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.operators import logs, order, posts, qc, windows
from reelmill.plans import all_queries

SF = "/root/testdata/sf0.001"


@contextlib.contextmanager
def many_ranges(spark, n="7"):
    """Exchanges stay in n parts, as they would with much data."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": n}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def smooth(track, alpha=0.35):
    out = []
    for t, x in sorted(track):
        out.append((t, x if not out else out[-1][1] + alpha * (x - out[-1][1])))
    return [(t, s, out[i + 1][0] if i + 1 < len(out) else None) for i, (t, s) in enumerate(out)]


@pytest.mark.parametrize("alpha,short", [(0.01, 0), (0.35, 3), (0.35, 1000), (1.0, 256)])
def test_smoothing_over_ranges(spark, alpha, short):
    rng = random.Random(int(alpha * 100))
    tracks = {0: [(t * 3, rng.uniform(-50, 50)) for t in range(400)], **{k: [(t, rng.uniform(0, 9)) for t in range(rng.randint(1, 5))] for k in range(1, 12)}}
    points = [(k, t, x) for k, track in tracks.items() for t, x in track]
    rng.shuffle(points)
    with many_ranges(spark):
        df = spark.createDataFrame(points, "clip long, t long, x double").repartition(5)
        assert df.repartitionByRange("clip", "t").where("clip = 0").select(F.spark_partition_id()).distinct().count() > 2
        got = qc.smoothed(df, "clip", "t", "x", alpha, short).collect()
    for k, track in tracks.items():
        mine = sorted((r.t, r.smooth, r.until) for r in got if r.clip == k)
        wanted = smooth(track, alpha)
        assert [(t, u) for t, _, u in mine] == [(t, u) for t, _, u in wanted]
        assert [s for _, s, _ in mine] == pytest.approx([s for _, s, _ in wanted], abs=1e-9)
    assert len(got) == len(points)


def test_a_very_long_track(spark):
    """A million points in linear time: four times the points take nowhere near sixteen times as long."""
    took = {}
    for n in (250_000, 1_000_000):
        df = spark.range(n).select(F.lit(1).alias("clip"), F.col("id").alias("t"), (F.col("id") % 97).cast("double").alias("x"))
        began = time.time()
        r = qc.smoothed(df, "clip", "t", "x").agg(F.count("*").alias("n"), F.max_by("smooth", "t").alias("end"), F.count("until").alias("u")).first()
        took[n] = time.time() - began
        assert r.n == n and r.u == n - 1
        s = 0.0
        for i in range(n - 300, n):
            s += 0.35 * (i % 97 - s)
        assert r.end == pytest.approx(s, abs=1e-9)
    assert took[1_000_000] < 8 * max(took[250_000], 2)


@pytest.mark.parametrize("seed", range(4))
def test_quantiles(spark, seed):
    rng = random.Random(seed)
    groups = {
        "even": [i / 7 for i in range(1000)], "one": [3.5], "same": [2.0] * 50, "two": [-1.0, 1e300], "wide": [-1.7e308, 1.7e308, 0.0, 1.0], "near": [1e9 + i * 1e-7 for i in range(100)] + [0.0],
        "ties": [float(rng.randint(0, 3)) for _ in range(200)], "any": [rng.gauss(0, 10) for _ in range(rng.randint(1, 400))],
    }
    shares = [0.0, 0.01, 0.25, 0.5, 0.8, 0.99, 1.0]
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    rng.shuffle(rows)
    got = {r.k: r.q for r in order.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", shares).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        s = sorted(vs)
        for p, q in zip(shares, got[k]):
            at = p * (len(s) - 1)
            low, high = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            assert q == pytest.approx(low + (at - int(at)) * (high - low), rel=1e-12, abs=1e-12), (k, p)


def test_quantiles_of_a_large_group_shuffle_bins(spark):
    """One group holds nearly all rows; no aggregate collects or sorts them."""
    df = spark.range(300_000).select(F.when(F.col("id") % 1000 == 0, 1).otherwise(0).alias("k"), ((F.col("id") * 7919) % 300_007).cast("double").alias("v"))
    r = {x.k: x.q for x in order.exact_quantiles(df, "k", "v", [0.5]).collect()}
    v = np.sort((np.arange(300_000) * 7919 % 300_007)[np.arange(300_000) % 1000 != 0])
    assert r[0] == [pytest.approx(np.quantile(v, 0.5))]
    plan = all_queries()["level_profile"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], "k long, t long, v double, has_metrics boolean")
    assert order.exact_quantiles(none, "k", "v", [0.5]).count() == 0 and qc.smoothed(none, "k", "t", "v").count() == 0
    assert posts.best_and_worst(none, F.col("v"), ["k"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 40])
def test_both_ends(spark, n):
    rng = random.Random(n)
    rows = [(i, i % 3, float(rng.randint(0, 4)), True) for i in range(n)] + [(900, 0, 99.0, False)]
    df = spark.createDataFrame(rows, "job long, clip int, views double, has_metrics boolean").repartition(3)
    got = posts.best_and_worst(df, F.col("views"), ["job", "clip"])
    assert got.columns == [*df.columns, "side"]
    real = [r for r in rows if r[3]]
    best, worst = sorted(real, key=lambda r: (-r[2], r[0], r[1]))[:8], sorted(real, key=lambda r: (r[2], -r[0], -r[1]))[:8] if n > 8 else []
    assert sorted(tuple(r) for r in got.collect()) == sorted([(*r, "best") for r in best] + [(*r, "worst") for r in worst])


def test_both_ends_in_one_pass_and_later(spark):
    jobs = spark.sparkContext.statusTracker()
    before = set(jobs.getJobIdsForGroup())
    df = spark.read.parquet(f"{SF}/events.parquet").withColumn("has_metrics", F.lit(True))
    before = set(jobs.getJobIdsForGroup())
    plan = posts.best_and_worst(df, F.col("value"), ["event_id"])._jdf.queryExecution().executedPlan().toString()
    assert set(jobs.getJobIdsForGroup()) == before  # nothing ran
    assert plan.count("FileScan parquet") == 1


def test_texts_of_segments_that_begin_at_once(spark):
    segments = spark.createDataFrame([(1, 0, 0, 5, "A"), (1, 1, 10, 20, "B"), (1, 2, 10, 30, "C"), (1, 3, 35, 50, "D"), (1, 4, 130, 140, "E")], "doc_id long, seg long, start_ms long, end_ms long, text string")
    found = spark.createDataFrame([(1, a, b) for a, b in ((0, 0), (1, 2), (2, 2), (2, 3), (1, 3), (0, 3), (3, 4))], "doc_id long, seg_from long, seg_to long")
    for wide in (100, 1000):
        got = {(r.seg_from, r.seg_to): r.text for r in windows.with_text(found, segments.repartition(4), "doc_id", wide).collect()}
        assert got == {(0, 0): "A", (1, 2): "B C", (2, 2): "C", (2, 3): "C D", (1, 3): "B C D", (0, 3): "A B C D", (3, 4): "D E"}


def greedy(rows, ratio=0.85, cap=320):
    kept = []
    for r in sorted(rows, key=lambda r: (not r[4], not r[5], r[2], r[3], r[0], r[1])):
        if len(kept) < cap and not any(min(r[3], k[3]) - max(r[2], k[2]) > ratio * min(r[3] - r[2], k[3] - k[2]) for k in kept):
            kept.append(r)
    return kept


@pytest.mark.parametrize("cap", [4, 320])
def test_islands_keep_what_one_fold_keeps(spark, cap):
    rng = random.Random(cap)
    rows = []
    for k in range(4):
        at = 0
        for i in range(150):
            at += rng.choice([0, 900, 4800, 4800, 95_000])
            rows.append((k, i, i + 3, at, at + rng.choice([10_000, 30_000, 30_000, 61_234, 80_000]), rng.random() < 0.1, rng.random() < 0.3))
    df = spark.createDataFrame(rows, "doc_id long, seg_from long, seg_to long, start_ms long, end_ms long, has_recital boolean, has_aha boolean").repartition(6)
    islands = {}
    for r in windows.in_islands(df, "doc_id").collect():
        islands.setdefault((r.doc_id, r.island), []).append((r.start_ms, r.end_ms))
    assert len(islands) > 40
    whole = {k: [min(a for a, _ in v), max(b for _, b in v)] for k, v in islands.items()}
    for (d, i), (a, b) in whole.items():
        assert not any(d == e and i != j and a < y and x < b for (e, j), (x, y) in whole.items())
    got = sorted((r.doc_id, r.seg_from, r.start_ms, r.end_ms) for r in windows.suppress_overlaps(df, "doc_id", cap=cap).collect())
    wanted = sorted((k, r[0], r[2], r[3]) for k in range(4) for r in greedy([x[1:] for x in rows if x[0] == k], cap=cap))
    assert got == wanted


def test_crop_by_hand(spark):
    frames = spark.createDataFrame([(1, 0.0, 36.0), (1, 0.0, 108.0), (2, 0.0, 1.0), (3, 0.0, 300.0), (4, 0.0, 20.0)], "clip long, span double, big_h double")
    got = {r.clip: r.crop for r in qc.track_decision(frames, 640.0, 360.0, 0.5).collect()}
    assert got[1] == pytest.approx(5.5 * 72 / 360 if 5.5 * 72 / 360 < 1 else 1.0) and got[2] == 0.34 and got[3] == 1.0 and got[4] == 0.34
    frames = spark.createDataFrame([(1, 0.0, 30.0)], "clip long, span double, big_h double")
    assert qc.track_decision(frames, 640.0, 360.0, 0.5).first().crop == pytest.approx(5.5 * 30 / 360)


def test_notes_of_the_commonest_reasons_alone(spark):
    rows = [(i * 20 + k, f"r{i}", f"note {i} {k}", "h") for i in range(10) for k in range(12 - i)]
    rejected = spark.createDataFrame(rows, "doc_id long, reason string, note string, hook string")
    none = spark.createDataFrame([], "job long, clip int, hook string, views double, saves double, slot_at string, has_metrics boolean")
    got = posts.learning_pack(rejected, none, "doc_id", ["job", "clip"]).where("section = 'notes'").collect()
    assert sorted(r.key for r in got) == [f"r{i}" for i in range(8)] and {r.n for r in got} <= {5, 6}


def test_minutes_that_end_in_a_half_are_exact(spark):
    seconds = [45.6, 66.0, 73.2, 61.2, 60.0, 59.6, 50.0, 62.8, 38.4, 38.4, 55.6, 41.6, 30.4, 69.2, 40.0, 57.6, 68.4]  # 918, or a little more as doubles
    clips = spark.createDataFrame([(1, "approved", x) for x in seconds], "doc_id long, decision string, s double").coalesce(1)
    for rows in (clips, clips.orderBy("s"), clips.repartition(4)):
        assert logs.scope_eta(rows, "doc_id", F.col("s")).first().eta_minutes == 8


def test_notes_of_all_reasons(spark):
    rows = [(i * 20 + k, f"r{i}" if i else None, f"note {i} {k}", "h") for i in range(10) for k in range(12 - i)]
    rejected = spark.createDataFrame(rows, "doc_id long, reason string, note string, hook string")
    none = spark.createDataFrame([], "job long, clip int, hook string, views double, saves double, slot_at string, has_metrics boolean")
    got = posts.learning_pack(rejected, none, "doc_id", ["job", "clip"], reasons=None).where("section = 'notes'").collect()
    assert {r.key for r in got} == {None, *(f"r{i}" for i in range(1, 10))} and {r.n for r in got} <= {3, 4, 5, 6}


def test_learning_pack_has_every_reason(spark):
    from reelmill.sources import fixtures

    d = "/root/testdata/sf0.01"
    keys = {r.key for r in all_queries()["learning_pack"][0](spark, d).where("section = 'notes'").collect()}
    wanted = {r.reason for r in fixtures.feedback(spark, d).where("trim(note) <> ''").select("reason").distinct().collect()}
    assert len(wanted) > 8 and keys == wanted


def test_texts_ahead_are_not_shuffled(spark):
    """Each text is dealt out once: what a segment's followers say is put together behind the one exchange."""
    seg = spark.createDataFrame([(1, i, f"t{i}", i * 4800) for i in range(60)], "doc_id long, seg long, text string, start_ms long")
    win = spark.createDataFrame([(1, a, b, a * 4800, (b + 1) * 4800) for a in range(0, 50, 3) for b in (a, a + 7)] + [(1, 99, 99, 0, 1)], "doc_id long, seg_from long, seg_to long, start_ms long, end_ms long")
    got = windows.with_text(win, seg, "doc_id", 80_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {(r.seg_from, r.seg_to): r.text for r in got.collect()} == {(a, b): " ".join(f"t{i}" for i in range(a, b + 1)) for a in range(0, 50, 3) for b in (a, a + 7)}
