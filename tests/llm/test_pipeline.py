"""The pipeline against its stages done by brute force; the classifier's own verdicts are taken from its operator."""

import corpus_pipeline
from reelmill.llm import queries, toxicity

from .test_dedup import brute_components, brute_exact

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    rows = [(i, t) for i, t in text.items() if i not in bad]
    exact = brute_exact(rows)
    rows = [(i, t) for i, t in rows if exact[i][2]]
    near = brute_components(rows, 5, 4, 5)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    leaked = {r.doc_id for r in queries.op1_decontaminate(spark, SF).collect()}
    want = {i for i, _ in rows if i not in leaked}
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "token_ids", "parity"} == set(got.columns)
    found = got.collect()
    assert sorted(r.doc_id for r in found) == sorted(want) and all(r.text == text[r.doc_id] and r.parity for r in found)


def test_run_over_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names; then an empty table."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None), (2, "", "x"), (3, "a b c d e f g", "x"), (3, "a b c d e f g", "x"), (4, long, None), (5, long + " end", "x"), (None, "other words stand here now", "x"), (6, "what is asked here about nothing much then", "y"), (7, " \t\n", "x")]
    schema = "doc_id long, text string, row string"
    wide = lambda df: df.selectExpr("*", "'q' as __row", "1 as component", "2 as token")
    for name, data in (("some", rows), ("none", [])):
        d = str(tmp_path / name)
        wide(spark.createDataFrame(data, schema)).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "what is asked here about nothing much then"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d)
        assert set(out.columns) == {"doc_id", "text", "row", "__row", "component", "token", "token_ids", "parity"}
        got = sorted((str(r.doc_id), (r.text or "")[:9]) for r in out.collect())
        # of the blank texts 7 has most code points; 4 and 5 are near copies; 6 leaks
        assert got == ([("3", "a b c d e"), ("4", long[:9]), ("7", " \t\n"), ("None", "other wor")] if data else [])


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, SF).columns == ["doc_id", "text", "lang", "source", "n_chars"]
