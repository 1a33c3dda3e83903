"""Scores, batches, diversified selection, shortlists and captions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as rk
from ..sources import fixtures as fx
from ..sources.fixtures import with_views

KEYS = ["doc_id", "seg_from", "seg_to"]


def _merged(spark: SparkSession, d: str) -> DataFrame:
    w = fx.windows(spark, d)
    return rk.passing(rk.reply_scorer(fx.replies(spark, d), KEYS)(w), 45)


def ranked_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).drop("complete_thought")


def profile_fanout(spark: SparkSession, d: str) -> DataFrame:
    r = fx.recordings(spark, d)
    wanted = F.element_at(F.array(*[F.lit(x) for x in ("a", "BOTH", "b ", "other")]), (F.col("id") % 4 + 1).cast("int"))
    return r.select("id", F.explode(rk.profiles_of(wanted)).alias("profile"))


def rank_batches(spark: SparkSession, d: str) -> DataFrame:
    return rk.in_batches(fx.windows(spark, d), "doc_id", ["start_ms", "end_ms"], 3).groupBy("doc_id", "batch_no").agg(F.count("*").alias("n"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return rk.diversified(_merged(spark, d), "doc_id", ["seg_from", "seg_to", "start_ms", "end_ms"])


def diversified_topn(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d)


def score_rank(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("score"), "start_ms", "end_ms"]
    return rk.top_k(_merged(spark, d), "doc_id", order, 21).select(*KEYS, "score", "rank")


def shortlist_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Picks come in another order than the ranks; every fifth recording's picks hit nothing."""
    pool = _pool(spark, d).select(*KEYS, "score", "rank")
    hash_ = (F.col("seg_from") * 31 + F.col("seg_to") * 17) % 1009
    picks = fx.windows(spark, d).filter((F.col("seg_from") + F.col("seg_to")) % 3 == 0).select("doc_id", F.when(F.col("doc_id") % 5 == 0, -F.col("seg_from") - 1).otherwise(F.col("seg_from")).alias("seg_from"), "seg_to", F.struct(hash_, "seg_from", "seg_to").alias("pick_order"), F.concat(F.lit("w"), F.col("seg_to").cast("string")).alias("why"))
    return rk.shortlisted(pool, picks, "doc_id", ["seg_from", "seg_to"], 7)


def caption_merge(spark: SparkSession, d: str) -> DataFrame:
    clips = rk.top_k(_merged(spark, d), "doc_id", [F.desc("score"), "start_ms", "end_ms"], 5).withColumn("hook", F.concat(F.lit("hook "), F.col("rank").cast("string")))
    i = F.col("seg_from")
    tags = F.transform(F.sequence(F.lit(1), (i % 12 + 1).cast("int")), lambda k: F.concat(F.lit("t"), k.cast("string")))
    captions = fx.windows(spark, d).filter(i % 3 != 0).select(*KEYS, F.when(i % 2 == 0, " ").otherwise("own hook ").alias("hook"), F.lit(" text ").alias("caption"), tags.alias("hashtags"), F.when(i % 5 == 0, None).otherwise("keep").alias("review_verdict"))
    out = rk.with_captions(clips, captions, KEYS)
    return out.select(*KEYS, "rank", "hook", "caption", F.array_join("hashtags", " ").alias("tags"), "review_verdict", "decision")


def payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = rk.in_batches(fx.windows(spark, d), "doc_id", ["start_ms", "end_ms"], 3)
    line = F.format_string("[%d-%d] %d", "seg_from", "seg_to", F.col("end_ms") - F.col("start_ms"))
    return rk.batch_payload(rows, "doc_id", "batch_no", ["start_ms", "end_ms"], line)


def _own_score(part: pa.RecordBatch) -> pa.Array:
    """Stands for a caller's model; it cannot take windows that end at every 13th segment."""
    a, b = part.column("seg_from"), part.column("seg_to")
    if pc.any(pc.equal(pc.subtract(b, pc.multiply(pc.divide(b, 13), 13)), 0)).as_py():
        raise ValueError("cannot be scored")
    return pc.cast(pc.add(pc.multiply(a, 7), b), pa.float64())


def own_scores(spark: SparkSession, d: str) -> DataFrame:
    """Windows go to the model by their ends, so that those it cannot take lie together."""
    return rk.arrow_scorer(_own_score)(fx.windows(spark, d).select(*KEYS).sortWithinPartitions("seg_to"))


def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    from .candidates import _flagged

    scored = rk.rule_scorer()(_flagged(spark, d))
    return scored.groupBy("doc_id", "score").agg(F.count("*").alias("n"))


_MERGED = """latest as (select doc_id, seg_from, seg_to, arg_max(struct_pack(score, structure, complete_thought), (batch, pos)) as r from replies group by 1,2,3),
 merged as (select w.*, cast(r.score as bigint) as score, r.structure as structure from windows w join latest using(doc_id, seg_from, seg_to) where r.score>=45 and coalesce(r.complete_thought, true))"""
_BATCH = "cast(floor((row_number() over (partition by doc_id order by start_ms, end_ms)-1) / ceil(count(*) over (partition by doc_id) / least(3, count(*) over (partition by doc_id))::double)) as bigint) as batch_no"
_POOL = _MERGED + """, items as (select doc_id, struct_pack(neg := -score, s := start_ms, e := end_ms, b := start_ms//300000, topic := structure, f := seg_from, t := seg_to) as c from merged),
 lists as (select doc_id, list(struct_pack(chosen := [c], over := list_filter([c], lambda z: false)) order by c) as xs from items group by doc_id),
 folded as (select doc_id, list_reduce(xs, lambda a, x: case when len(a.chosen) >= 60 then a
  when len(list_filter(a.chosen, lambda k: k.b = x.chosen[1].b)) >= 4 or len(list_filter(a.chosen, lambda k: k.topic = x.chosen[1].topic)) >= 3 then struct_pack(chosen := a.chosen, over := list_concat(a.over, x.chosen))
  else struct_pack(chosen := list_concat(a.chosen, x.chosen), over := a.over) end) as f from lists),
 first as (select doc_id, i as rank, f.chosen[i] as c from folded, lateral unnest(range(1, len(f.chosen)+1)) u(i)),
 rest as (select doc_id, len(f.chosen) as n, i as p, f.over[i] as c from folded, lateral unnest(range(1, len(f.over)+1)) u(i) where len(f.chosen) < 60),
 turns as (select *, row_number() over (partition by doc_id, c.b order by p) as turn from rest),
 filled as (select doc_id, n + row_number() over (partition by doc_id order by turn, c.b) as rank, c from turns),
 pool as (select doc_id, rank, c.f as seg_from, c.t as seg_to, c.s as start_ms, c.e as end_ms, -c.neg as score, c.topic as structure from (select * from first union all select * from filled where rank <= 60))"""

QUERIES = {
    "own_scores": (own_scores, with_views("windows", "select doc_id, seg_from, seg_to, case when seg_to%13<>0 then (seg_from*7+seg_to)::double end as score, case when seg_to%13=0 then 'ValueError: cannot be scored' end as error from windows")),
    "ranked_merge": (ranked_merge, with_views("replies", "+" + _MERGED + " select doc_id, seg_from, seg_to, start_ms, end_ms, score, structure from merged")),
    "profile_fanout": (profile_fanout, with_views("recordings", "select id, unnest(case id%4 when 0 then ['A'] when 1 then ['A','B'] when 2 then ['B'] else ['A'] end) as profile from recordings")),
    "rank_batches": (rank_batches, with_views("windows", f"select doc_id, batch_no, count(*) as n, min(start_ms) as first_ms, max(start_ms) as last_ms from (select *, {_BATCH} from windows) group by 1,2")),
    "diversified_topn": (diversified_topn, with_views("replies", "+" + _POOL + " select * from pool")),
    "score_rank": (score_rank, with_views("replies", "+" + _MERGED + ", r as (select doc_id, seg_from, seg_to, score, row_number() over (partition by doc_id order by score desc, start_ms, end_ms) as rank from merged) select * from r where rank<=21")),
    "shortlist_fallback": (
        shortlist_fallback,
        with_views("replies", "+" + _POOL + """, picks as (select doc_id, case when doc_id%5=0 then -seg_from-1 else seg_from end as seg_from, seg_to, (seg_from*31+seg_to*17)%1009 as h, seg_from as o, 'w'||seg_to as why from windows where (seg_from+seg_to)%3=0),
 hit as (select p.doc_id, p.seg_from, p.seg_to, p.score, row_number() over (partition by p.doc_id order by h, o, p.seg_to) as place, why from pool p join picks k on p.doc_id=k.doc_id and p.seg_from=k.seg_from and p.seg_to=k.seg_to)
 select * from hit where place<=7 union all select doc_id, seg_from, seg_to, score, rank, null from pool where rank<=7 and doc_id not in (select doc_id from hit)"""),
    ),
    "caption_merge": (
        caption_merge,
        with_views("replies", "+" + _MERGED + """, r as (select *, row_number() over (partition by doc_id order by score desc, start_ms, end_ms) as rank from merged)
 select doc_id, seg_from, seg_to, rank, case when seg_from%3<>0 and seg_from%2=1 then 'own hook' else 'hook '||rank end as hook, case when seg_from%3<>0 then 'text' else '' end as caption,
 case when seg_from%3<>0 then array_to_string(list_transform(range(1, least(seg_from%12+1,8)+1), lambda k: 't'||k),' ') else '' end as tags, case when seg_from%3<>0 and seg_from%5<>0 then 'KEEP' else '' end as review_verdict, 'pending' as decision from r where rank<=5"""),
    ),
    "batch_payload": (payloads, with_views("windows", f"select doc_id, batch_no, string_agg('['||seg_from||'-'||seg_to||'] '||(end_ms-start_ms), chr(10) order by start_ms, end_ms) as payload from (select *, {_BATCH} from windows) group by 1,2")),
    "rule_scores": (
        rule_scores,
        with_views("windows", "+texts as (select doc_id, list(text order by seg) as ts from segments group by doc_id), joined as (select w.*, lower(array_to_string(ts[seg_from+1:seg_to+1],' ')) as t from windows w join texts using(doc_id)), f as (select doc_id, contains(t,'ver') or contains(t,'that the') as r, contains(t,'thing') or contains(t,'with the') as a from joined) select doc_id, cast(least(100, 55 + case when a or r then 30 else 0 end + case when r then 25 else 0 end) as bigint) as score, count(*) as n from f group by 1,2"),
    ),
}
