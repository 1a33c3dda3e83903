"""Streams that stop and go on, late rows, and uploads with timers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reelmill.streaming import streams as st

DAY = dt.datetime(2024, 1, 1)
KEYS = ["job", "clip"]


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def metrics(spark, n=200):
    """Readings in no order of time."""
    rows = [(i % 7, i % 3, at((i * 7919) % 500 / 10), "metrics", float(i) if i % 2 else None, float(-i), None) for i in range(n)]
    return spark.createDataFrame(rows, "job long, clip int, ts timestamp, kind string, views double, likes double, saves double")


def test_a_lost_batch_is_replayed(spark):
    log, base = metrics(spark), st.new_base(spark)
    log.repartition(5).write.parquet(f"{base}/log")
    feed = st.latest_metrics(st.tail(spark, f"{base}/log", per_trigger=1), KEYS, ["views", "likes", "saves"])
    st.advance(feed, base, "update", lose_batch=2)
    assert sorted(r.batch for r in spark.read.parquet(f"{base}/out").select("batch").distinct().collect()) == [0, 1, 2]
    part = rows_of(spark.read.parquet(f"{base}/out").where("batch = 2").drop("batch"))
    again = st.advance(feed, base, "update")
    assert [p["batchId"] for p in again if p["numInputRows"]] == [2, 3, 4]
    assert rows_of(spark.read.parquet(f"{base}/out").where("batch = 2").drop("batch")) == part  # the replay put its rows in place of the lost ones
    whole = st.latest_metrics(log, KEYS, ["views", "likes", "saves"])
    assert rows_of(st.put_out(feed, base, KEYS)) == rows_of(whole)
    files = spark.read.parquet(f"{base}/out").count()
    assert not [p for p in st.advance(feed, base, "update") if p["numInputRows"]]  # nothing new
    assert spark.read.parquet(f"{base}/out").count() == files


def test_a_log_that_grows_between_runs(spark):
    log, base = metrics(spark), st.new_base(spark)
    seen = []

    def more(folder):
        seen.append(st.latest_metrics(st.tail(spark, folder), KEYS, ["views", "likes", "saves"]))
        st.advance(seen[-1], base, "update")

    st.growing(log, F.col("job") % 3, 3, more)
    assert rows_of(st.put_out(seen[-1], base, KEYS)) == rows_of(st.latest_metrics(log, KEYS, ["views", "likes", "saves"]))


def test_nothing_put_out(spark):
    base = st.new_base(spark)
    metrics(spark, 4).limit(0).write.parquet(f"{base}/log")
    feed = st.latest_metrics(st.tail(spark, f"{base}/log"), KEYS, ["views"])
    st.advance(feed, base, "update")
    assert st.put_out(feed, base, KEYS).columns == [*KEYS, "views", "measured_ts"] and st.put_out(feed, base, KEYS).count() == 0


def test_closed_days_are_put_out_once_and_late_calls_kept_apart(spark):
    rows = [(j, at(24 * d + h), True, 10, part) for part, days in ((0, (0, 1, 2)), (1, (3, 4, 5)), (2, (6, 7))) for d in days for h in (1, 13) for j in (1, 2)]
    late = [(1, at(5), True, 1000, 1), (2, at(29), True, 1000, 2), (1, at(24 * 5 + 2), True, 7, 2)]  # the last one's day is still open
    log = spark.createDataFrame(rows + late, "job long, ts timestamp, ok boolean, tok_in long, part int")
    base, runs = st.new_base(spark), []

    def more(folder):
        stream = st.usage_daily(st.tail(spark, folder))
        runs.append((stream, st.advance(stream, base, "append")))
        st.late_rows(st.tail(spark, folder), base, "ts", F.date_trunc("day", "ts") + F.expr("interval 1 day"), "1 day")

    st.growing(log, F.col("part"), 3, more)
    got = {(r.day, r.job): (r.calls, r.tok_in) for r in st.put_out(runs[-1][0], base).collect()}
    assert len(got) == st.put_out(runs[-1][0], base).count()  # each once
    wanted = {(at(24 * d), j): (2, 20) for d in range(6) for j in (1, 2)}  # day 6 ended less than a day before the last call
    wanted[at(24 * 5), 1] = (3, 27)
    assert got == wanted
    kept = spark.read.parquet(f"{base}/late")
    assert rows_of(kept.select("job", "tok_in")) == ["(1, 1000)", "(2, 1000)"]
    dropped = sum(op["numRowsDroppedByWatermark"] for _, run in runs for p in run for op in p["stateOperators"])
    assert dropped == kept.count()  # one a day and job here, as the operator counts after its first sum


UPLOADS = "upload long, ts timestamp, kind string, total long, idx long, part int"


def abandoned(spark, rows, parts=4):
    base, feed, progress = st.new_base(spark), [], []

    def more(folder):
        feed.append(st.abandoned_uploads(st.tail(spark, folder).drop("part"), 48, "1 day"))
        progress.extend(st.with_timers(spark, lambda: st.advance(feed[-1], base, "append")))

    st.growing(spark.createDataFrame(rows, UPLOADS), F.col("part"), parts, more)
    got = st.put_out(feed[-1], base)
    return {r.upload: (r.created, r.given_up, r.received, r.total) for r in got.collect()}, got.count(), progress


def test_uploads_with_timers(spark):
    made = lambda u, h, n, part: (u, at(h), "created", n, None, part)
    chunk = lambda u, h, i, part: (u, at(h), "chunk", None, i, part)
    rows = [
        made(1, 0, 2, 0), chunk(1, 1, 0, 0), chunk(1, 2, 1, 1),  # complete over two batches
        chunk(1, 3, 1, 2),  # a chunk sent again after that
        made(2, 0, 2, 0), chunk(2, 1, 0, 0), chunk(2, 2, 0, 1),  # one chunk twice
        chunk(3, 1, 0, 0), made(3, 0, 2, 1), chunk(3, 30, 1, 1),  # a chunk before its upload, and complete
        made(4, 0, 2, 0), chunk(4, 1, 0, 0), chunk(4, 49, 1, 1),  # complete too late
        made(5, 0, 1, 0), chunk(5, 48, 0, 1),  # complete at the last moment
        chunk(6, 1, 0, 0),  # never created
        made(7, 0, 3, 0),  # nothing came
        made(8, 130, 3, 2), made(9, 171, 1, 3),  # still waited for; the last time of all
    ]
    got, n, progress = abandoned(spark, rows)
    assert got == {2: (at(0), at(48), 1, 2), 4: (at(0), at(48), 1, 2), 7: (at(0), at(48), 0, 3)} and n == 3
    assert len([p for p in progress if p["numInputRows"]]) == 4


def test_timers_do_not_outlive_the_setting(spark):
    before = spark.conf.get(st.ROCKS[0], None)
    with pytest.raises(ValueError):
        st.with_timers(spark, lambda: (_ for _ in ()).throw(ValueError()))
    assert spark.conf.get(st.ROCKS[0], None) == before


def test_uploads_share_state_by_buckets(spark, monkeypatch):
    """Each key of the state costs calls between Python and the store, so there are few keys for many uploads."""
    monkeypatch.setattr(st, "BUCKETS", 8, raising=False)
    rows = [(u, at(u % 40), "created", 2, None, 0) for u in range(300)] + [(u, at(3), "created", 1, None, 0) for u in (None, 2**60 + 1)]
    rows += [(u, at(u % 40 + 1 + k), "chunk", None, k, 0) for u in range(300) for k in range(u % 3)]
    got, n, progress = abandoned(spark, [*rows, (1000, at(106), "created", 1, None, 1)], 2)
    wanted = {u: (at(u % 40), at(u % 40 + 48), u % 3, 2) for u in range(300) if u % 3 < 2 and u % 40 <= 34}  # the last watermark is at 34 + 48 hours
    wanted |= {u: (at(3), at(51), 0, 1) for u in (None, 2**60 + 1)}
    assert got == wanted and n == len(wanted)
    assert max(op["numRowsTotal"] for p in progress for op in p["stateOperators"]) <= 9
