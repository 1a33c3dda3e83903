"""Slots, queues, calendars, review state and the deck."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schedule as sc
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from ..sources.readers import table

TIMES, CAP, GAP = ["11:30", "18:30", "20:00"], 2, 5
IDS, ORDER = ["doc_id", "seg_from", "seg_to"], ["approved_at", "doc_id", "seg_from", "seg_to"]


def _channel():
    return F.concat(F.lit("ch"), (F.col("doc_id") % 20).cast("string"), F.col("profile"))


def slot_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every user is a channel that starts on the day of its first event, weekends off for odd ones' sake of days 0-4."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("channel")).agg(F.min("ts").cast("timestamp_ntz").alias("now"))
    return sc.slot_grid(e.withColumn("start", F.col("now")), TIMES, [0, 1, 2, 3, 4], CAP, GAP, 14)


def _approved(spark: SparkSession, d: str) -> DataFrame:
    c = fx.clips(spark, d).filter("decision = 'approved' and not posted").withColumn("channel", _channel())
    pin = F.when((F.col("seg_from") % 13 == 0) & (F.col("seg_to") % 4 == 0), F.lit("2024-01-02 18:30:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("doc_id") % 20).cast("int")))
    return c.withColumn("pinned_at", pin)


def _slots(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    return sc.slot_grid(_approved(spark, d).select("channel").distinct().withColumns({"start": now, "now": now}), TIMES, list(range(7)), CAP, GAP, 14)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return sc.placed(_approved(spark, d), _slots(spark, d), "channel", ["doc_id"], ORDER)


def interleave(spark: SparkSession, d: str) -> DataFrame:
    return sc.interleaved(_approved(spark, d), "channel", ["doc_id"], ORDER).select("channel", *IDS, "place")


def placement(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select("channel", *IDS, "scheduled_at")


def calendar(spark: SparkSession, d: str) -> DataFrame:
    return sc.calendar(_slots(spark, d), _placed(spark, d), "channel", IDS, ORDER)


def adjacent_source(spark: SparkSession, d: str) -> DataFrame:
    return sc.adjacent_warnings(_placed(spark, d), "channel", "doc_id", ORDER).select("channel", *IDS, "scheduled_at")


def queue_health(spark: SparkSession, d: str) -> DataFrame:
    return sc.queue_health(_placed(spark, d), "channel", CAP, 1)


def calendar_days(spark: SparkSession, d: str) -> DataFrame:
    cal = sc.calendar(_slots(spark, d), _placed(spark, d), "channel", IDS, ORDER)
    out = sc.calendar_days(cal, "channel", F.col("doc_id").cast("string"))
    return out.withColumn("day", F.col("day").cast("string"))


def clip_state(spark: SparkSession, d: str) -> DataFrame:
    """Events of 50 keys a user stand for reviews."""
    e = table(spark, d, "events")
    t = F.col("event_type")
    decision = F.when(t == "view", "approved").when(t == "click", "rejected").when(t == "purchase", F.when(F.col("event_id") % 2 == 0, "approved").otherwise("pending"))
    rows = e.select(
        F.col("user_id").alias("clip"), F.col("ts").cast("timestamp_ntz").alias("ts"), decision.alias("decision"), F.when(t == "click", F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string"))).alias("reason"),
        F.when(t == "click", F.col("props")).alias("note"), F.when((t == "signup") & (F.col("event_id") % 2 == 0), F.col("event_id")).alias("pin"), (t == "signup").alias("pinned"), F.when(t == "error", F.col("event_id") % 2 == 0).alias("posted"),
    )
    return sc.clip_state(rows, "clip")


def deck(spark: SparkSession, d: str) -> DataFrame:
    c = fx.clips(spark, d).filter("decision = 'pending'").withColumn("channel", _channel())
    topic = F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string"))
    return sc.deck(c, IDS, topic, F.col("start_ms")).select("channel", *IDS, "topic", "stretch", "place")


_GRID = """every as (select channel, n, list([t] order by t) as ts from (select c.channel, c.n, c.d0 + to_days(i::int) + to_minutes(m) as t from chans c, lateral unnest(range(0,15)) a(i), (values (690),(1110),(1200)) b(m)) where {ok} group by 1,2),
 start as (select channel, n, list_concat([[timestamp '1900-01-01']], ts) as ts from every),
 fold as (select channel, list_reduce(ts, lambda a, x: case when x[1] > n and len(list_filter(a, lambda o: o::date = x[1]::date)) < 2 and x[1] - a[len(a)] >= interval 5 hour then list_concat(a, x) else a end) as s from start),
 slots as (select channel, unnest(s[2:]) as at_ from fold)"""
_APP = "app as (select *, 'ch'||(doc_id%20)||profile as channel, case when seg_from%13=0 and seg_to%4=0 then timestamp '2024-01-02 18:30:00' + to_days((doc_id%20)::int) end as pin from clips where decision='approved' and not posted)"
_INTER = "turns as (select *, row_number() over (partition by channel, doc_id order by approved_at, doc_id, seg_from, seg_to) as turn from app where {0}), queue as (select *, row_number() over (partition by channel order by turn, doc_id) as place from turns)"
_PLACED = (
    _APP + ", chans as (select distinct channel, timestamp '2024-01-01 12:00:00' as n, timestamp '2024-01-01' as d0 from app), " + _GRID.format(ok="true") + ", " + _INTER.format("pin is null")
    + ", open as (select channel, at_, row_number() over (partition by channel order by at_) as place from slots s where not exists (select 1 from app p where p.channel=s.channel and p.pin=s.at_))"
    + ", placed as (select channel, doc_id, seg_from, seg_to, approved_at, pin as at_ from app where pin is not null union all select q.channel, doc_id, seg_from, seg_to, approved_at, o.at_ from queue q left join open o on q.channel=o.channel and q.place=o.place)"
)
_CAL = _PLACED + ", last as (select channel, at_, arg_max(doc_id,(approved_at,doc_id,seg_from,seg_to)) as doc_id, arg_max(seg_from,(approved_at,doc_id,seg_from,seg_to)) as seg_from, arg_max(seg_to,(approved_at,doc_id,seg_from,seg_to)) as seg_to from placed where at_ is not null group by 1,2), cal as (select s.channel, s.at_, doc_id, seg_from, seg_to from slots s left join last l on s.channel=l.channel and s.at_=l.at_)"

QUERIES = {
    "slot_grid": (slot_grid, "with chans as (select user_id as channel, min(ts) as n, date_trunc('day', min(ts)) as d0 from events group by 1), " + _GRID.format(ok="isodow(t) <= 5") + ' select channel, at_ as "at" from slots'),
    "interleave": (interleave, with_views("clips", "+" + _APP + ", " + _INTER.format("true") + " select channel, doc_id, seg_from, seg_to, place from queue")),
    "placement": (placement, with_views("clips", "+" + _PLACED + " select channel, doc_id, seg_from, seg_to, at_ as scheduled_at from placed")),
    "calendar": (calendar, with_views("clips", "+" + _CAL + ' select channel, at_ as "at", doc_id, seg_from, seg_to from cal')),
    "adjacent_source": (adjacent_source, with_views("clips", "+" + _PLACED + ", l as (select *, lag(doc_id) over (partition by channel order by at_, approved_at, doc_id, seg_from, seg_to) as b from placed where at_ is not null) select channel, doc_id, seg_from, seg_to, at_ as scheduled_at from l where b=doc_id")),
    "queue_health": (queue_health, with_views("clips", "+" + _PLACED + " select channel, count(at_) as queued, count(*)-count(at_) as beyond_window, round(count(at_)/2.0,1)::double as days_of_runway, '2 a day allowed, 1 slot times set' as note from placed group by 1")),
    "calendar_days": (calendar_days, with_views("clips", "+" + _CAL + ", x as (select channel, at_::date as day, count(*) as slots, list(doc_id::varchar order by at_) filter (doc_id is not null) as xs from cal group by 1,2) select channel, day::varchar as day, slots, coalesce(len(xs),0)::bigint as clips, coalesce(array_to_string(xs[1:3],','),'') as first, greatest(0,coalesce(len(xs),0)-3)::bigint as more from x")),
    "clip_state": (
        clip_state,
        """with r as (select user_id as clip, ts, event_id, case event_type when 'view' then 'approved' when 'click' then 'rejected' when 'purchase' then case when event_id%2=0 then 'approved' else 'pending' end end as decision, case when event_type='click' then 'r'||(event_id%3) end as reason, case when event_type='click' then props end as note, event_type as t from events),
 s as (select clip, max(ts) filter (decision is not null and decision<>'approved') as reset, max(ts) filter (decision is not null) as dt, max(ts) filter (t='signup') as pt, max(ts) filter (t='error') as et from r group by 1)
 select s.clip, a.decision, case when a.decision='rejected' then a.reason end as reason, case when a.decision='rejected' then substr(a.note,1,500) end as note, (select min(ts) from r where r.clip=s.clip and decision='approved' and (s.reset is null or ts>s.reset)) as approved_at, case when p.event_id%2=0 then p.event_id end as pin, coalesce(e.event_id%2=0,false) as posted
 from s left join r a on a.clip=s.clip and a.ts=s.dt left join r p on p.clip=s.clip and p.ts=s.pt left join r e on e.clip=s.clip and e.ts=s.et""",
    ),
    "deck": (deck, with_views("clips", "+c as (select 'ch'||(doc_id%20)||profile as channel, doc_id, seg_from, seg_to, 't'||(doc_id%7) as topic, start_ms//300000 as stretch, md5(doc_id||'-'||seg_from||'-'||seg_to||'-11') as h from clips where decision='pending'), t as (select *, row_number() over (partition by channel, topic, stretch order by h, doc_id, seg_from, seg_to) as turn from c) select channel, doc_id, seg_from, seg_to, topic, stretch, row_number() over (partition by channel order by turn, topic, stretch) as place from t")),
}
