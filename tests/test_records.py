"""Records folded from events, retries, a caller's scorer, guards and files."""

import datetime as dt

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from reelmill.operators import logs, ranking
from reelmill.plans import files
from reelmill.sources import readers, sinks

SF = "/root/testdata/sf0.001"
EVENT = "id string, version int, place int, op string, field string, value string, items array<string>"


def fold(spark, rows):
    got = sinks.folded_entities(spark.createDataFrame(rows, EVENT).repartition(3), "id", ["version", "place"], ["status", "note"], ["warnings", "tags"])
    return {r.id: (r.status, r.note, r.warnings, r.tags) for r in got.collect()}


def test_entities_from_events(spark):
    rows = [
        ("a", 5, 0, "set", "status", "done", None), ("a", 1, 0, "create", None, None, None), ("a", 2, 1, "append", "warnings", "second", None), ("a", 2, 0, "append", "warnings", "first", None),
        ("a", 3, 0, "set", "status", "running", None), ("a", 4, 0, "append", "tags", "gone", None), ("a", 4, 1, "set", "tags", None, ["x", "y"]), ("a", 6, 0, "append", "tags", "z", None), ("a", 9, 0, "create", None, None, None),
        ("b", 1, 0, "set", "status", "too early", None), ("b", 1, 1, "append", "warnings", "too early", None), ("b", 2, 0, "create", None, None, None), ("b", 2, 1, "append", "warnings", "w", None), ("b", 2, 1, "append", "warnings", "v", None),
        ("c", 1, 0, "set", "status", "never made", None), ("d", 1, 0, "create", None, None, None), ("d", 2, 0, "set", "note", "n", None), ("d", 3, 0, "set", "note", None, None), ("d", 3, 1, "set", "warnings", None, None),
    ]
    assert fold(spark, rows) == {"a": ("done", None, ["first", "second"], ["x", "y", "z"]), "b": (None, None, ["v", "w"], []), "d": (None, None, [], [])}
    assert fold(spark, []) == {}


def test_chains_of_attempts(spark):
    rows = [("j", "a", t, n, ok, e, 10) for t, n, ok, e in ((1, 1, False, "x"), (2, 2, True, None), (3, 2, False, "y"), (4, 3, False, "z"), (5, 1, None, "q"), (6, 1, True, None))] + [("j", "b", 1, 2, True, None, 5)]
    df = spark.createDataFrame(rows, "job string, label string, ts int, attempt int, ok boolean, error string, wall_ms long").repartition(3)
    got = sorted(tuple(r) for r in logs.retry_chains(df, ["job", "label"], ["ts"]).collect())
    assert got == [("j", "a", 0, 2, True, "x", False, 20), ("j", "a", 1, 2, False, "z", True, 20), ("j", "a", 2, 1, False, "q", True, 10), ("j", "a", 3, 1, True, None, False, 10), ("j", "b", 0, 1, True, None, False, 5)]


def test_a_scorer_that_raises(spark):
    def score(part):
        if -1 in part.column("x").to_pylist():
            raise KeyError("no such row")
        return pc.cast(pc.multiply(part.column("x"), 2), pa.float64())

    df = spark.createDataFrame([(i, -1 if i == 7 else i, "old", "old") for i in range(50)], "i int, x int, score string, error string").repartition(2)
    got = {r.i: (r.score, r.error) for r in ranking.arrow_scorer(score)(df).collect()}
    assert got == {i: (None, "KeyError: 'no such row'") if i == 7 else (2.0 * i, None) for i in range(50)}
    assert ranking.arrow_scorer(score)(df.limit(0)).columns == ["i", "x", "score", "error"]


@pytest.mark.parametrize("wrong", [lambda p: pa.array([1.0]), lambda p: p.column("x"), lambda p: [1.0] * p.num_rows])
def test_a_scorer_of_another_kind_fails(spark, wrong):
    df = spark.range(30).select(F.col("id").alias("x")).coalesce(1)
    with pytest.raises(Exception, match="must return"):
        ranking.arrow_scorer(wrong)(df).collect()


def test_a_caller_gives_whole_numbers(spark):
    df = spark.range(5).select(F.col("id").alias("x"))
    assert [r.rank for r in ranking.arrow_scorer(lambda p: p.column("x"), "bigint", "rank")(df).orderBy("x").collect()] == [0, 1, 2, 3, 4]


def test_push_guards(spark):
    rows = [(None, 1, 10.0), ("", 1, 10.0), ("/a/clip.mp4", None, 10.0), ("/a/uploads/clip.mp4", 1, 10.0), ("uploads/clip.mp4", 1, 10.0), ("C:\\\\uploads\\\\clip.mp4", 1, 10.0), ("/a/my uploads/clip.mp4", 1, 10.0), ("/uploads/big.mp4", 200 << 20, 10.0), ("/a/clip.mp4", 1, 2.0), ("/a/clip.mp4", 1, 0.0), ("/a/clip.mp4", 1, None)]
    df = spark.createDataFrame(rows, "path string, size long, s double").coalesce(1)
    got = [r[0] for r in df.select(logs.publish_fault(F.col("path"), F.col("size"), F.col("s"))).collect()]
    assert got == ["no file", "no file", "missing", "source upload", "source upload", "source upload", None, "too large", "too short", None, None]


def test_tokens_with_the_cache(spark):
    df = spark.createDataFrame([("j", True, 1.0, 10, 1, 5, None), ("j", True, None, None, 2, None, 7), ("j", False, 9.0, 99, 9, 9, 9)], "job string, ok boolean, cost_usd double, tok_in long, tok_out long, cache_create long, cache_read long")
    assert tuple(logs.usage_rollup(df).first()) == ("j", 2, 1.0, 22, 3, 1)


def test_durations_of_probes(spark):
    js = lambda f, v: '{"format":{%s},"streams":[{"codec_type":"video"%s}]}' % (f'"duration":"{f}"' if f is not None else "", f',"duration":"{v}"' if v is not None else "")
    cases = [(js("12.345", "9"), 12.35), (js(None, "9.5"), 9.5), (js("", "9.5"), 9.5), (js("0", "9.5"), 0.0), (js("N/A", "9.5"), 0.0), (js(None, None), 0.0), ("{}", 0.0)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, js string").coalesce(1)
    assert [r.duration_s for r in readers.probe_summary(df).orderBy("id").collect()] == [pytest.approx(c[1]) for c in cases]


def test_abandoned_uploads_by_age(spark):
    day = lambda h: dt.datetime(2024, 1, 10) - dt.timedelta(hours=h)
    uploads = spark.createDataFrame([(1, day(49), 2), (2, day(49), 2), (3, day(47), 2), (4, None, 2), (5, day(100), 2), (6, day(48), 2)], "upload_id long, created_at timestamp_ntz, total_chunks long")
    got = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1), (3, 0)], "upload_id long, idx long")
    out = logs.abandoned_uploads(uploads, got, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    assert sorted((r.upload_id, r.received) for r in out.collect()) == [(1, 1), (5, 0)]


def test_inventory_reads_no_contents(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x" * 10)
    plan = readers.inventory(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert "content" in readers.scan_folder(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_broken_lines_are_told_with_their_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"v": 1}\n\nbroken\n{"v": 3}\n{"v":')
    good, bad = readers.split_log(spark, str(tmp_path), readers.T.StructType.fromDDL("v long"))
    assert sorted(r.v for r in good.collect()) == [1, 3] and sorted(r[readers.CORRUPT] for r in bad.collect()) == ["broken", '{"v":'] and all(r.file.endswith("a.jsonl") for r in bad.collect())


def test_streamed_log_holds_each_event_once(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert files.event_sink(spark, SF).count() == n


def test_folders_are_written_by_many_tasks(spark):
    import re

    from reelmill.plans import files

    d = "/root/testdata/sf0.001"
    before = spark.conf.get(readers.LISTERS)
    paths = [r.path for r in readers.scan_folder(spark, files._folder(spark, d)).select("path").collect()]
    writers = {kind: {re.search(r"part-(\d+)", p).group(1) for p in paths if f"/{kind}/" in p and "/part-" in p} for kind in ("notes", "data")}
    assert len(paths) > 10 and all(len(w) > 1 for w in writers.values()) and spark.conf.get(readers.LISTERS) == before


def test_folders_after_grouping_are_written_by_many_tasks(spark):
    """Grouped rows lie by the key in as many parts as the writer asks for."""
    import re

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * spark.sparkContext.defaultParallelism))
    try:
        paths = [r.path for r in readers.scan_folder(spark, files._folder(spark, SF)).select("path").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(len({re.search(r"part-(\d+)", p).group(1) for p in paths if f"/{kind}/" in p}) > 4 for kind in ("notes", "data"))


def test_files_of_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb"), (2, ""), (3, None), (None, "é"), (-7, "x" * 5000)], "id long, value string")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.rowfiles.link./t", f"file://{tmp_path}/far")
    (tmp_path / "far").mkdir()
    got = []
    for path in (f"file://{tmp_path}/a b", f"{tmp_path}/plain", "viewfs://rowfiles/t/x"):  # the last is written by Spark
        sinks.write_files(rows, "id", path.replace("a b", "a%20b"))
        got.append(sorted(spark.read.text(path, wholetext=True).select("value", F.col("id").cast("string")).collect(), key=str))
    assert len(got[0]) == 5 and got[0] == got[1] == got[2]
    assert not [p for p in (tmp_path / "plain").rglob("*") if p.is_file() and not p.name.startswith("part-")]
    sinks.write_files(rows.select("id", F.length("value").alias("n")), "id", f"{tmp_path}/js", "json")
    assert sorted(spark.read.text(f"{tmp_path}/js", recursiveFileLookup=True).collect(), key=str) == sorted([('{"n":3}',), ('{"n":0}',), ("{}",), ('{"n":1}',), ('{"n":5000}',)], key=str)
    assert all(p.suffix == ".json" for p in (tmp_path / "js").rglob("part-*"))
    sinks.write_files(rows.where("id = 99"), "id", f"{tmp_path}/none")
    assert readers.scan_folder(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="two rows of id="):
        sinks.write_files(rows.unionByName(rows), "id", f"{tmp_path}/twice")


def test_few_calls_for_rows_that_raise(spark):
    def score(part):
        calls.add(1)
        if pc.any(pc.less(part.column("x"), 40)).as_py():
            raise ValueError("no")
        return pc.cast(part.column("x"), pa.float64())

    calls = spark.sparkContext.accumulator(0)
    df = spark.range(2000).select(F.col("id").alias("x")).coalesce(1)
    got = ranking.arrow_scorer(score)(df).orderBy("x").collect()
    assert [(r.score, r.error) for r in got] == [(None, "ValueError: no") if x < 40 else (float(x), None) for x in range(2000)] and calls.value < 120
