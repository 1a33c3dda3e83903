"""Segments, words, candidate windows, clips' words and caption cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bucket, ceil_div, collapsed, corrected, post_text, safe_filename, shortened, stamp, word_count
from ..operators.captions import cards_of, emphasis_windows, sample_times
from ..operators.windows import flagged, numbered, spoken, suppress_overlaps, with_text, words_by_clip, words_in_clips
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from ..sources.readers import cues_of, flatten_transcripts, table
from ..sources.sinks import latest_entities, subtitle_text

# The test tables hold invented text, in which these occur.
AHA, RECITAL = ["thing", "with the"], ["ver", "that the"]
CORRECTIONS = [("the", "der"), ("der", "DER$1"), ("of", "o\\f")]


def segments(spark: SparkSession, d: str) -> DataFrame:
    return fx.segments(spark, d)


def words(spark: SparkSession, d: str) -> DataFrame:
    return fx.words(spark, d)


def spoken_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth segment is blank."""
    s = fx.segments(spark, d).withColumn("text", F.when(F.col("seg") % 5 == 1, " ").otherwise(F.col("text")))
    return spoken(s, "doc_id").select("doc_id", "seg", "start_ms", F.length("text").cast("long").alias("size"))


def text_measures(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", word_count(F.col("text")).alias("n_words"), bucket(n, 100).alias("hundred"), ceil_div(n, F.lit(60)).alias("lines"), shortened(collapsed(F.col("text")), 40).alias("head"))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Nested transcripts are built and flattened again. Their words are cut from the texts after these were gathered, so
    each text is shuffled once."""
    one = F.struct("seg", "start_ms", "end_ms", "text")
    gathered = fx.segments(spark, d).groupBy(F.col("doc_id").cast("string").alias("job_id")).agg(F.array_sort(F.collect_list(one)).alias("segments"))
    word = lambda s: lambda w, i: F.struct(w.alias("w"), ((s["start_ms"] + i * 400) / 1000.0).alias("start"), ((s["start_ms"] + i * 400 + 400) / 1000.0).alias("end"))
    whole = lambda s: F.struct((s["start_ms"] / 1000.0).alias("start"), (s["end_ms"] / 1000.0).alias("end"), s["text"].alias("text"), F.transform(F.split(s["text"], " "), word(s)).alias("words"))
    flat, _ = flatten_transcripts(gathered.select("job_id", F.transform("segments", whole).alias("segments")))
    return flat.where("n_words > 0")


def latest_entity(spark: SparkSession, d: str) -> DataFrame:
    r = fx.recordings(spark, d).withColumn("entity", F.col("id") % 500).withColumn("version", F.struct("created_at", "id"))
    return latest_entities(r.select("entity", "version", "status", "profile"), "entity", "version").select("entity", F.col("version.id").alias("id"), "status", "profile")


def candidate_windows(spark: SparkSession, d: str) -> DataFrame:
    return fx.windows(spark, d)


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return flagged(with_text(fx.windows(spark, d), fx.segments(spark, d), "doc_id", 80_000), AHA, RECITAL).drop("text")


def clip_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidate windows with cues, greedily thinned and numbered."""
    kept = numbered(suppress_overlaps(_flagged(spark, d), "doc_id"), "doc_id")
    return kept.withColumn("stamp", stamp(F.col("start_ms")))


def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("has_aha").alias("n_aha"), F.count_if("has_recital").alias("n_recital"))


def clip_words(spark: SparkSession, d: str) -> DataFrame:
    w = words_in_clips(fx.words(spark, d), _approved(spark, d), "doc_id")
    return w.groupBy(*CLIP).agg(F.count("*").alias("n_words"), F.min("rel_start_ms").alias("first_ms"), F.max("rel_end_ms").alias("last_ms"), F.sum("pos").alias("pos_sum"))


CLIP = ["doc_id", "seg_from", "seg_to"]


def _approved(spark: SparkSession, d: str) -> DataFrame:
    return fx.clips(spark, d).filter("decision = 'approved'").select(*CLIP, "start_ms", "end_ms")


def cards(spark: SparkSession, d: str) -> DataFrame:
    w = words_by_clip(fx.words(spark, d), _approved(spark, d), "doc_id", 80_000)
    return cards_of(w, CLIP, 4, CORRECTIONS)


def cues_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Segments written as subtitle texts and read again: the same cues come back."""
    s = fx.segments(spark, d).select("doc_id", (F.col("seg") + 1).alias("pos"), "start_ms", "end_ms", "text")
    return cues_of(subtitle_text(s, "doc_id"), keys=("doc_id",))


def peaks(spark: SparkSession, d: str) -> DataFrame:
    c = _approved(spark, d).withColumn("dur", F.col("end_ms") - F.col("start_ms"))
    at = F.array(*[((F.col("doc_id") * 977 + 7919 * k) % (F.col("dur") + 5000)).cast("long") for k in range(4)])
    return c.select(*CLIP, F.posexplode(emphasis_windows(at, F.col("dur"))).alias("i", "x")).select(*CLIP, F.col("i").cast("long").alias("i"), "x.from_ms", "x.to_ms")


def samples(spark: SparkSession, d: str) -> DataFrame:
    c = _approved(spark, d)
    return c.select(*CLIP, F.posexplode(sample_times(F.col("end_ms") - F.col("start_ms"))).alias("i", "at_ms")).select(*CLIP, F.col("i").cast("long").alias("i"), "at_ms")


def post_texts(spark: SparkSession, d: str) -> DataFrame:
    c = _approved(spark, d)
    caption = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit("clip "), F.col("doc_id").cast("string")))
    tags = F.array(F.lit("#one"), F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")))
    return c.select(*CLIP, post_text(caption, F.when(F.col("doc_id") % 2 == 0, "Follow"), tags).alias("post"))


def corrections(spark: SparkSession, d: str) -> DataFrame:
    s = fx.segments(spark, d)
    return s.select("doc_id", "seg", corrected(F.col("text"), CORRECTIONS).alias("text"), safe_filename(F.col("text")).alias("file"))


_FLAGGED = """, texts as (select doc_id, list(text order by seg) as ts from segments group by doc_id),
 joined as (select w.*, array_to_string(ts[seg_from+1:seg_to+1],' ') as t from windows w join texts using(doc_id)),
 flagged as (select *, contains(lower(t),'ver') or contains(lower(t),'that the') as has_recital from joined),
 cues as (select doc_id, seg_from, seg_to, start_ms, end_ms, has_recital, contains(lower(t),'thing') or contains(lower(t),'with the') or has_recital as has_aha from flagged)"""
_STAMP = "case when start_ms>=3600000 then format('{}:{:02d}:{:02d}',start_ms//3600000,(start_ms//60000)%60,(start_ms//1000)%60) else format('{}:{:02d}',start_ms//60000,(start_ms//1000)%60) end"
_PICKED = "picked as (select doc_id, seg_from, seg_to, start_ms, end_ms from clips where decision='approved')"
_FIX = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x},'\\bthe\\b','der','gi'),'\\bder\\b','DER$1','gi'),'\\bof\\b','o\\\\f','gi')"

QUERIES = {
    "spoken_segments": (spoken_segments, with_views("segments", "+s as (select doc_id, seg, start_ms, case when seg%5=1 then ' ' else text end as text from segments) select doc_id, row_number() over (partition by doc_id order by seg)-1 as seg, start_ms, length(text) as size from s where trim(text)<>''")),
    "text_measures": (text_measures, "with c as (select doc_id, n_chars, trim(regexp_replace(coalesce(text,''),'\\s+',' ','g')) as t from documents) select doc_id, case when t='' then 0 else len(string_split(t,' ')) end::bigint as n_words, n_chars//100 as hundred, ceil(n_chars/60.0)::bigint as lines, substr(t,1,40) as head from c"),
    "segments": (segments, with_views("segments", "select doc_id, seg, text, start_ms, end_ms from segments")),
    "words": (words, with_views("words", "select doc_id, pos, w, start_ms, end_ms from words")),
    "transcripts": (transcripts, with_views("segments", "select doc_id::varchar as job_id, seg, start_ms, end_ms, text, len(string_split(text,' ')) as n_words, end_ms as last_ms from segments")),
    "latest_entity": (latest_entity, with_views("recordings", "select id%500 as entity, arg_max(id,(created_at,id)) as id, arg_max(status,(created_at,id)) as status, arg_max(profile,(created_at,id)) as profile from recordings group by 1")),
    "candidate_windows": (candidate_windows, with_views("windows", "select doc_id, seg_from, seg_to, start_ms, end_ms from windows")),
    "flag_counts": (flag_counts, with_views("windows", "+" + _FLAGGED.lstrip(", ") + " select doc_id, count(*) as n, count(*) filter (has_aha) as n_aha, count(*) filter (has_recital) as n_recital from cues group by 1")),
    "clip_candidates": (
        clip_candidates,
        with_views("windows", "+" + _FLAGGED.lstrip(", ") + f""", sorted as (select doc_id, list([struct_pack(r := has_recital, a := has_aha, s := start_ms, e := end_ms, f := seg_from, t := seg_to)] order by not has_recital, not has_aha, start_ms, end_ms) as xs from cues group by doc_id),
 folded as (select doc_id, list_reduce(xs, lambda acc, x: case when len(acc) >= 320 or len(list_filter(acc, lambda k: least(k.e, x[1].e) - greatest(k.s, x[1].s) > 0.85 * least(k.e - k.s, x[1].e - x[1].s))) > 0 then acc else list_concat(acc, x) end) as kept from sorted),
 kept as (select doc_id, unnest(kept) as k from folded)
 select doc_id, k.f as seg_from, k.t as seg_to, k.s as start_ms, k.e as end_ms, k.r as has_recital, k.a as has_aha, format('c{{:03d}}', row_number() over (partition by doc_id order by k.s, k.e) - 1) as cid, {_STAMP.replace("start_ms", "k.s")} as stamp from kept"""),
    ),
    "clip_words": (clip_words, with_views("words clips", "select c.doc_id, seg_from, seg_to, count(*) as n_words, min(greatest(0, w.start_ms-c.start_ms)) as first_ms, max(w.end_ms-c.start_ms) as last_ms, cast(sum(pos) as bigint) as pos_sum from words w join clips c on w.doc_id=c.doc_id and w.end_ms>=c.start_ms and w.start_ms<=c.end_ms where decision='approved' group by 1,2,3")),
    "caption_cards": (
        cards,
        with_views("words clips", "+" + _PICKED + f""", inside as (select w.doc_id, seg_from, seg_to, pos, w, greatest(0, w.start_ms-s.start_ms) as a, w.end_ms-s.start_ms as b from words w join picked s on w.doc_id=s.doc_id and w.end_ms>=s.start_ms and w.start_ms<=s.end_ms),
 placed as (select *, (row_number() over (partition by doc_id, seg_from, seg_to order by pos)-1)//4 as card from inside)
 select doc_id, seg_from, seg_to, card, arg_min(a,pos) as start_ms, arg_max(b,pos) as end_ms, {_FIX("trim(string_agg(w,' ' order by pos))")} as text from placed where w<>'' group by 1,2,3,4"""),
    ),
    "cues_roundtrip": (cues_roundtrip, with_views("segments", "select doc_id, row_number() over (partition by doc_id order by seg)-1 as pos, start_ms, end_ms, text from segments where trim(text)<>''")),
    "emphasis_windows": (
        peaks,
        with_views("clips", "+" + _PICKED + """, pts as (select doc_id, seg_from, seg_to, end_ms-start_ms as dur, list_transform(range(0,3), lambda k: (doc_id*977+7919*k) % (end_ms-start_ms+5000)) as ps from picked),
 good as (select doc_id, seg_from, seg_to, dur, list_filter(ps, lambda t: t>=0 and t<=greatest(0,dur-500)) as g from pts)
 select doc_id, seg_from, seg_to, i-1 as i, greatest(0,g[i]-300) as from_ms, least(dur,g[i]+1800) as to_ms from good, lateral unnest(range(1,len(g)+1)) u(i)"""),
    ),
    "sample_times": (
        samples,
        with_views("clips", "+" + _PICKED + """, pts as (select doc_id, seg_from, seg_to, list_concat(list_concat([50], list_filter(list_transform(range(1,7), lambda k: k*4000), lambda t: t < greatest(200,end_ms-start_ms)-200)), [greatest(100,greatest(200,end_ms-start_ms)-200)]) as ts from picked)
 select doc_id, seg_from, seg_to, i-1 as i, ts[i] as at_ms from pts, lateral unnest(range(1,len(ts)+1)) u(i)"""),
    ),
    "post_text": (
        post_texts,
        with_views("clips", "+" + _PICKED + """ select doc_id, seg_from, seg_to, array_to_string(list_filter([case when doc_id%3=0 then '' else 'clip '||doc_id end, case when doc_id%2=0 then 'Follow' else '' end, '#one #t'||(doc_id%7)], lambda x: x<>''), chr(10)||chr(10)) as post from picked"""),
    ),
    "corrections": (
        corrections,
        with_views("segments", f"""select doc_id, seg, {_FIX("text")} as text, substr(case when f='' then 'video' else f end,1,120) as file from (select doc_id, seg, text, regexp_replace(regexp_replace(regexp_extract(text,'([^/\\\\]*)$',1),'[^A-Za-z0-9._-]+','_','g'),'^[._]+|[._]+$','','g') as f from segments)"""),
    ),
}
