"""Small cases worked out by hand, and properties."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from reelmill.functions import text as tx
from reelmill.operators import captions, logs, posts, qc, ranking, schedule, threads, windows
from reelmill.sources import readers, sinks


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_openers(spark):
    df = spark.createDataFrame([("Some one",), ("And so",), ("The end.",)], "t string")
    assert [r[0] for r in df.select(tx.self_contained(F.col("t"))).collect()] == [False, False, True]
    assert [r[0] for r in df.select(tx.self_contained(F.col("t"), strict=True)).collect()] == [True, False, True]


def test_stamps(spark):
    got = one(spark, a=tx.stamp(F.lit(65_000)), b=tx.stamp(F.lit(3_665_000)), c=tx.cue_time(F.lit(3_661_042)))
    assert tuple(got) == ("1:05", "1:01:05", "01:01:01,042")


def test_corrections_chain(spark):
    assert one(spark, x=tx.corrected(F.lit("A ab b"), [("a", "b"), ("b", "c")])).x == "c ab c"
    assert one(spark, x=tx.corrected(F.lit("cost. now"), [("cost", "$1\\x")])).x == "$1\\x. now"


def test_shorter_window_first(spark):
    rows = [(1, 0, 3, 0, 50_000, False, False), (1, 0, 2, 0, 45_000, False, False)]
    w = spark.createDataFrame(rows, "doc_id long, seg_from long, seg_to long, start_ms long, end_ms long, has_recital boolean, has_aha boolean")
    assert [r.end_ms for r in windows.suppress_overlaps(w, "doc_id").collect()] == [45_000]


def test_kept_windows_do_not_overlap_and_dropped_ones_do(spark):
    rows = [(k, 0, i, i * 900, i * 900 + 30_000 + (i * 7919) % 50_000, i % 11 == 0, i % 5 == 0) for k in range(3) for i in range(150)]
    w = spark.createDataFrame(rows, "doc_id long, seg_from long, seg_to long, start_ms long, end_ms long, has_recital boolean, has_aha boolean")
    kept = {}
    for r in windows.suppress_overlaps(w, "doc_id", 0.85, 1000).collect():
        kept.setdefault(r.doc_id, []).append((r.start_ms, r.end_ms))
    clash = lambda a, b: min(a[1], b[1]) - max(a[0], b[0]) > 0.85 * min(a[1] - a[0], b[1] - b[0])
    for k, spans in kept.items():
        assert not any(clash(a, b) for i, a in enumerate(spans) for b in spans[:i])
        assert all((r[3], r[4]) in spans or any(clash((r[3], r[4]), s) for s in spans) for r in rows if r[0] == k)


def test_metric_merge(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    log = spark.createDataFrame([(1, "published", t(0), None, None, None), (1, "metrics", t(1), 5.0, None, None), (1, "metrics", t(2), None, 2.0, None), (1, "metrics", t(3), None, None, 1.0)], "k int, kind string, ts timestamp_ntz, views double, likes double, saves double")
    r = posts.posts_latest(log, ["k"]).first()
    assert (r.views, r.likes, r.saves, r.measured_ts, r.has_metrics) == (5.0, 2.0, 1.0, t(3), True)


def test_floor_and_last_reply(spark):
    rows = [(1, 1, 1, "44", True), (2, 1, 1, "45", True), (3, 1, 1, "x", True), (4, 1, 1, "90", None), (5, 1, 1, "90", False), (6, 1, 1, "90", True), (6, 2, 1, "10", True), (7, 2, 2, "90", True), (7, 2, 1, "10", True), (7, 1, 3, "10", True)]
    r = spark.createDataFrame(rows, "cid long, batch int, pos int, score string, complete_thought boolean")
    assert sorted(x.cid for x in ranking.passing(ranking.last_replies(r, ["cid"])).collect()) == [2, 4, 7]


def test_batches_are_contiguous(spark):
    r = spark.createDataFrame([(1, i) for i in range(4)], "k int, i int")
    got = ranking.in_batches(r, "k", ["i"], 3).groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [tuple(x) for x in got] == [(0, 2), (1, 2)]


def test_caption_groups_count_blanks(spark):
    w = spark.createDataFrame([(1, i, x, i * 100, i * 100 + 90) for i, x in enumerate(["a", "", "b", "c", "d"])], "k int, pos int, w string, rel_start_ms long, rel_end_ms long")
    got = captions.caption_cards(w, ["k"]).orderBy("card").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in got] == [("a b c", 0, 390), ("d", 400, 490)]


def test_word_over_the_start(spark):
    w = spark.createDataFrame([(1, 0, "x", 0, 100), (1, 1, "y", 100, 200)], "doc_id int, pos int, w string, start_ms long, end_ms long")
    c = spark.createDataFrame([(1, 50, 100)], "doc_id int, start_ms long, end_ms long")
    got = windows.words_in_clips(w, c, "doc_id").orderBy("pos").collect()
    assert [(r.rel_start_ms, r.rel_end_ms) for r in got] == [(0, 50), (50, 150)]


def keeps(spark, cuts, duration=10_000):
    items = spark.createDataFrame([(1, duration, None, None)], "k int, duration_ms long, trim_from long, trim_to long")
    got = qc.keep_ranges(items, spark.createDataFrame([(1, a, b) for a, b in cuts], "k int, a long, b long"), ["k"])
    return sorted((r.from_ms, r.to_ms) for r in got.collect())


def test_keep_ranges(spark):
    assert keeps(spark, [(1000, 4000), (3000, 5000), (5000, 5040)]) == [(0, 1000), (5000, 10_000)]
    assert keeps(spark, [(0, 20_000)]) == [(0, 10_000)]


def test_silence_guards(spark):
    items = spark.createDataFrame([(1, 60_000), (2, 60_000), (3, 60_000)], "k int, duration_ms long")
    quiet = [(1, 10_000, 12_000), (2, 0, 30_000)] + [(3, 5_000 * i, 5_000 * i + 1500) for i in range(1, 8)]
    got = qc.silence_keeps(items, spark.createDataFrame(quiet, "k int, from_ms long, to_ms long"), "k")
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == [(1, 0, 10_250), (1, 11_750, 60_000), (2, 0, 60_000), (3, 0, 60_000)]


def test_voice_by_hand(spark):
    """Equal bands share half each; a high band 20 dB down has 0.1/1.1 of the amplitude."""
    levels = spark.createDataFrame([(0.0, -20.0, -60.0, -30.0, -30.0), (0.0, -10.0, -20.0, -40.0, -20.0), (0.0, -10.0, -20.0, None, -20.0)], "peak double, rms double, floor double, high double, low double")
    m = levels.select(*[c.alias(k) for k, c in qc.voice_measures(*[F.col(c) for c in levels.columns]).items()])
    got = m.select("tilt", *[c.alias(k) for k, c in qc.voice_treatment(F.col("separation"), F.col("tilt"), F.col("crest")).items()]).collect()
    assert [r.tilt for r in got] == pytest.approx([0.5, 0.1 / 1.1, 0.4])
    assert [r.presence for r in got] == pytest.approx([1.0, 4.0, 1.0]) and [r.deess for r in got] == [0.25, 0.0, 0.25]
    assert [r.warmth for r in got] == [-1.5, -3.0, -3.0] and [r.compress for r in got] == [True, False, False]
    assert [r.denoise for r in got] == pytest.approx([0.0, 0.85, 0.85])


def test_silences_of_a_log(spark):
    log = "silence_start: -0.02\nsilence_end: 1.5 | silence_duration: 1.52\nsilence_start: 3\nsilence_end: 4\nsilence_start: 8.5\n"
    pairs = one(spark, x=qc.log_measurements(F.lit(log), F.lit(9.0))["pairs"]).x
    assert [(p.a, p.b) for p in pairs] == [(0.0, 1.5), (3.0, 4.0), (8.5, 9.0)]


def test_slots_respect_cap_gap_and_past(spark):
    c = spark.createDataFrame([("a", "2024-01-01 00:00", "2024-01-01 12:00"), ("b", "2020-01-01 00:00", "2024-01-01 12:00")], "channel string, start string, now string")
    c = c.withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("start", "now")})
    at = [r.at for r in schedule.slot_grid(c, ["11:30", "18:30", "20:00"], list(range(7)), 2, 5, 3).orderBy("at").collect()]
    assert at[0] == dt.datetime(2024, 1, 1, 18, 30)
    assert all(b - a >= dt.timedelta(hours=5) for a, b in zip(at, at[1:]))
    assert max(sum(x.date() == y.date() for x in at) for y in at) <= 2


def test_pins_keep_their_time(spark):
    day = lambda d: dt.datetime(2024, 1, d, 18, 30)
    clips = spark.createDataFrame([("c", 1, 1, None), ("c", 2, 2, day(2)), ("c", 3, 3, day(2)), ("c", 4, 4, day(30))], "channel string, id int, approved_at int, pinned_at timestamp_ntz")
    slots = spark.createDataFrame([("c", day(2)), ("c", day(3))], "channel string, at timestamp_ntz")
    done = schedule.placed(clips, slots, "channel", ["id"], ["approved_at", "id"])
    assert {r.id: r.scheduled_at for r in done.collect()} == {1: day(3), 2: day(2), 3: day(2), 4: day(30)}
    assert [r.id for r in schedule.calendar(slots, done, "channel", ["id"], ["approved_at", "id"]).orderBy("at").collect()] == [3, 1]


def test_transcripts_begin_like_their_upload(spark):
    uploads = spark.createDataFrame([("a.mp4",), ("ab.mov",), ("b.mp4",), ("noend",)], "name string")
    names = spark.createDataFrame([("a.transcript.json",), ("abc-2.transcript.json",), ("b.json",), (".transcript.json",)], "name string")
    got = {r.name: r.has_transcript for r in logs.with_transcript(uploads, names, ".transcript.json").collect()}
    assert got == {"a.mp4": True, "ab.mov": True, "b.mp4": False, "noend": False}


def test_blank_segments_go(spark):
    s = spark.createDataFrame([(1, 0, "a"), (1, 1, " \n"), (1, 2, None), (1, 3, "b."), (2, 0, "")], "doc_id long, seg long, text string")
    assert sorted(tuple(r) for r in windows.spoken(s, "doc_id").select("doc_id", "seg", "text").collect()) == [(1, 0, "a"), (1, 1, "b.")]


def test_faces_by_hand(spark):
    boxes = spark.createDataFrame([(1, 0, 10.0, 20.0, 30.0, 40.0), (1, 0, 60.0, 10.0, 20.0, 80.0)], "clip long, t long, x double, y double, w double, h double")
    r = qc.frame_boxes(boxes).first()
    assert (r.left, r.right, r.span, r.mid, r.cx, r.big_h, r.n) == (10.0, 80.0, 70.0, 45.0, 70.0, 80.0, 2) and r.eye == pytest.approx(10 + 0.42 * 80)


def test_turns_differ_by_one_at_most(spark):
    clips = spark.createDataFrame([("c", s, i) for s, n in ((1, 5), (2, 2), (3, 4)) for i in range(n)], "channel string, source int, i int")
    order = [r.source for r in schedule.interleaved(clips, "channel", ["source"], ["i"]).orderBy("place").collect()]
    left = {1: 5, 2: 2, 3: 4}
    for k in range(len(order)):
        taken = {s: order[: k + 1].count(s) for s in left}
        open_ = [taken[s] for s in left if taken[s] < left[s]]
        assert not open_ or max(open_) - min(open_) <= 1


def test_reapproval_keeps_its_place(spark):
    rows = [(1, 1, "approved"), (1, 2, "approved"), (2, 1, "approved"), (2, 2, "rejected"), (2, 3, "approved"), (3, 1, "approved"), (3, 2, "pending")]
    e = spark.createDataFrame(rows, "clip int, ts int, decision string").withColumns({"reason": F.lit(None).cast("string"), "note": F.lit("n"), "pin": F.lit(None).cast("int"), "pinned": F.lit(False), "posted": F.lit(None).cast("boolean")})
    assert {r.clip: (r.decision, r.approved_at) for r in schedule.clip_state(e, "clip").collect()} == {1: ("approved", 1), 2: ("approved", 3), 3: ("pending", None)}


@pytest.mark.parametrize("text, found", [('Sure [{"a":1}] ok', '{"a":1}'), ('{"b":"}"} x', '{"b":"}"}'), ("[1, 2] is it", "[1, 2]"), ('{"id":1', None), ("", None), ('{oops} [3] then', "[3]"), ('a {"k": [1, {"z": "}{"}]}}', '{"k": [1, {"z": "}{"}]}'), ('{"q": "\\\\"} "', '{"q": "\\\\"}')])
def test_first_json(text, found):
    assert threads.first_json(text) == found


def test_recovered_rows(spark):
    df = spark.createDataFrame([(1, '```json\n{"id": 7}\n```'), (2, 'prose {"id": 8} more'), (3, "none"), (4, None)], "k int, reply string")
    got = {r.k: (r.value.id if r.value else None, r.at_once) for r in threads.recovered(df, "reply", "struct<id:bigint>").collect()}
    assert got[1] == (7, True) and got[2] == (8, False) and got[3][0] is None and got[4][0] is None


def test_sessions_of_unreadable_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": 1, "v": 1}\nbroken\n{"ts": 3, "v": 3}\n{"ts": 2, "v": 2}\n')
    got = readers.read_log(spark, str(tmp_path), readers.T.StructType.fromDDL("ts long, v long"), tail=2)
    assert [r.v for r in got.collect()] == [3, 2]


def test_entities_skip_what_is_broken(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "n": 1}, indent=1))
    (tmp_path / "b.json").write_text("{ nope")
    good, bad = readers.read_entities(spark, str(tmp_path), readers.T.StructType.fromDDL("id string, n long"))
    assert [r.id for r in good.collect()] == ["a"] and bad.count() == 1


def test_subtitles_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([(1, 1, 0, 900, "one"), (1, 2, 900, 1000, " "), (1, 3, 1000, 2500, "two\nlines")], "clip int, pos long, start_ms long, end_ms long, text string")
    sinks.write_subtitles(cues, "clip", str(tmp_path / "srt"))
    got = readers.read_cues(spark, str(tmp_path / "srt" / "clip=1")).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(0, 900, "one"), (1000, 2500, "two\nlines")]


def test_append_and_inventory(spark, tmp_path):
    path = str(tmp_path / "events")
    for i in range(2):
        sinks.append_events(spark.createDataFrame([(i,)], "v int"), path)
    assert spark.read.json(path).count() == 2
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "clip.MP4").write_bytes(b"abc")
    (tmp_path / "x" / "note.txt").write_text("hello")
    assert {(r.name, r.size) for r in readers.inventory(spark, str(tmp_path / "x")).collect()} == {("clip.MP4", 3), ("note.txt", 5)}
    assert {(r.kind, r.head) for r in readers.scan_folder(spark, str(tmp_path / "x")).collect()} == {("video", None), ("text", "hello")}


def test_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    sinks.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "upload_id long, idx long, total_chunks long")
    assert logs.missing_chunks(none, none).count() == 0
    some = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "upload_id long, total_chunks long")
    assert sorted(tuple(r) for r in logs.missing_chunks(some, spark.createDataFrame([(2, 0)], "upload_id long, idx long")).collect()) == [(1, 0), (1, 1)]
    assert posts.pattern_gate(spark.createDataFrame([], "has_metrics boolean, views double"), "views").first().needed == 12


def test_fences_go_and_what_they_hold_stays(spark):
    cases = {"```json\n{\"a\": 1}\n```": '{"a": 1}', " ```\nx\n\ny``` ": "x\n\ny", "```py\nno end": "no end", "``````": "", "a ``` b": "a ``` b", "```x\n1\n``` after": "1\n``` after", "": ""}
    got = spark.createDataFrame(list(cases.items()), "reply string, want string").select(tx.unfenced(F.col("reply")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def shuffles(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_transcripts_shuffle_texts_once(spark):
    from reelmill.plans import candidates

    plan, n = shuffles(candidates.transcripts(spark, "/root/testdata/sf0.001"))
    assert n == 1 and "Join" not in plan


def test_flattened_segments_tell_their_words(spark):
    nested = spark.createDataFrame([("a", [(0.0, 1.5, "x y", [("x", 0.0, 0.5), ("y", 0.5, 1.2)]), (2.0, 3.0, "", []), (3.0, 4.0, "z", None)])], readers.TRANSCRIPT)
    segments, words = readers.flatten_transcripts(nested)
    assert [(r.seg, r.n_words, r.last_ms) for r in segments.orderBy("seg").collect()] == [(0, 2, 1200), (1, 0, None), (2, 0, None)]
    assert [(r.seg, r.pos, r.w, r.end_ms) for r in words.orderBy("pos").collect()] == [(0, 0, "x", 500), (0, 1, "y", 1200)]


def test_words_by_clip_shuffle_a_word_once(spark):
    """Twenty clips hold each word; its row is dealt out once, or twice at the beginning of a bucket."""
    rows = [(k, i, f"w{i % 7}" if i % 5 else "", 370 * i + 7 * (i % 3), 370 * i + 400 + 90_000 * (i == 200)) for k in range(3) for i in range(9000)]
    w = spark.createDataFrame(rows, "doc_id long, pos long, w string, start_ms long, end_ms long")
    spans = [(k, s, s + n) for k in range(3) for s in range(0, 3_400_000, 13_000) for n in (0, 30_000, 80_000)]
    c = spark.createDataFrame(spans, "doc_id long, start_ms long, end_ms long")
    got = windows.words_by_clip(w, c, "doc_id", 80_000)
    wanted = windows.words_in_clips(w, c, "doc_id")
    flat = got.select("doc_id", "start_ms", "end_ms", F.explode("words").alias("x")).select("doc_id", "start_ms", "end_ms", "x.*")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, wanted.select(flat.columns).collect()))
    assert all([x.pos for x in r.words] == sorted(x.pos for x in r.words) for r in got.collect())
    cards = captions.cards_of(got.withColumnsRenamed({"start_ms": "a", "end_ms": "b"}), ["doc_id", "a", "b"])
    rowwise = captions.caption_cards(wanted.withColumnsRenamed({"start_ms": "a", "end_ms": "b"}), ["doc_id", "a", "b"])
    assert sorted(map(tuple, cards.collect())) == sorted(map(tuple, rowwise.collect()))
    plan, n = shuffles(captions.cards_of(windows.words_by_clip(w, c.withColumns({"a": F.col("start_ms"), "b": F.col("end_ms")}), "doc_id", 80_000).drop("start_ms", "end_ms"), ["doc_id", "a", "b"]))
    assert n == 1 and "Join" not in plan
    with pytest.raises(Exception, match="longer than 79999"):
        windows.words_by_clip(w, c, "doc_id", 79_999).collect()


def test_the_diversified_fold_holds_what_is_chosen_alone(spark):
    """Equal rows are told apart, and what is refused is not carried from step to step."""
    rows = [(1, 90 - i // 2, 200_000 * (i % 3), 1000, "t" if i % 4 else "u", i // 2) for i in range(12)]
    r = spark.createDataFrame([*rows, (1, 90, 0, 1000, "u", 0)], "doc_id long, score long, start_ms long, end_ms long, structure string, seg long")
    df = ranking.diversified(r, "doc_id", ["seg", "start_ms", "end_ms"])
    plan, n = shuffles(df)
    assert n == 1 and "Union" not in plan
    got = df.orderBy("rank").collect()
    assert [x["rank"] for x in got] == list(range(1, 14)) and [x.seg for x in got[:2]] == [0, 0] and len([x for x in got[:6] if x.structure == "u"]) == 3
