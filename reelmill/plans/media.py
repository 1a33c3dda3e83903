"""Quiet runs, keep ranges, quality flags, level profiles, detections and treatments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import qc
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from ..sources.readers import probe_summary, table

FRAME = 200
THRESHOLD = -35.0
HEIGHT = 360.0  #: of the frames, in the units of the boxes


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return qc.quiet_runs(fx.level_frames(spark, d), "item", THRESHOLD, FRAME, 600)


def quiet_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)


def audio_flags(spark: SparkSession, d: str) -> DataFrame:
    m = qc.level_summary(fx.level_frames(spark, d), _runs(spark, d), "item", FRAME)
    return qc.audio_flags(m.withColumn("mean_db", F.round("mean_db", 6))).select("item", "silence_share", "peak_db", "mean_db", "ok", F.size("flags").cast("long").alias("n_flags"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return fx.windows(spark, d).groupBy("doc_id").agg((F.max("end_ms") + 1000).alias("duration_ms"), (F.min("start_ms") + 700).alias("trim_from"), F.max("end_ms").alias("trim_to"))


def keep_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Cuts: part of every window; recordings divisible by 9 lose everything, and so keep all."""
    w = fx.windows(spark, d)
    cuts = w.filter((F.col("seg_from") + F.col("seg_to")) % 3 == 0).select("doc_id", F.when(F.col("doc_id") % 9 == 0, 0).otherwise(F.col("start_ms") + 100).alias("a"), F.when(F.col("doc_id") % 9 == 0, 10**9).otherwise(F.col("start_ms") + F.col("seg_to") * 37 % 9000).alias("b"))
    return qc.keep_ranges(_items(spark, d), cuts, ["doc_id"])


def silence_keeps(spark: SparkSession, d: str) -> DataFrame:
    frames = fx.level_frames(spark, d)
    items = frames.groupBy("item").agg((F.count("*") * FRAME).alias("duration_ms"))
    return qc.silence_keeps(items, qc.quiet_runs(frames, "item", THRESHOLD, FRAME, 1200), "item", per_minute=8.0, least_share=0.6)  # readings are no speech: with the defaults of 4 and 0.75 all is kept


def level_profile(spark: SparkSession, d: str) -> DataFrame:
    p = qc.level_profile(fx.pixels(spark, d), "item")
    p = p.withColumn("in_target", qc.within({"black": (0, 60), "white": (190, 255), "mean": (110, 140), "contrast": (10, 60)}))
    return p.select("item", "in_target", *[F.round(c, 5).alias(c) for c in p.columns if c not in ("item", "in_target")])


def frame_boxes(spark: SparkSession, d: str) -> DataFrame:
    f = qc.frame_boxes(fx.detections(spark, d))
    f = f.withColumn("face_share", F.col("big_h") / HEIGHT)
    return f.select("clip", "t", "n", "big_h", *[F.round(c, 6).alias(c) for c in ("left", "right", "span", "mid", "cx", "eye", "face_share")])


def track_decision(spark: SparkSession, d: str) -> DataFrame:
    t = qc.track_decision(qc.frame_boxes(fx.detections(spark, d)), 640.0, HEIGHT, 0.07)
    return t.select("clip", "both_fit", F.round("crop", 6).alias("crop"))


def ema_track(spark: SparkSession, d: str) -> DataFrame:
    f = qc.frame_boxes(fx.detections(spark, d))
    s = qc.smoothed(qc.centred(f, 640.0, 0.07), "clip", "t", "centre")
    return s.select("clip", "t", "smooth", "until")


def treatment_decision(spark: SparkSession, d: str) -> DataFrame:
    levels = fx.level_frames(spark, d).groupBy("item").agg(F.max("level_db").alias("peak"), F.percentile("level_db", F.lit(0.5)).alias("rms"), F.min("level_db").alias("floor"), F.percentile("level_db", F.lit(0.25)).alias("high"), F.percentile("level_db", F.lit(0.4)).alias("low"))
    m = levels.select("item", *[c.alias(n) for n, c in qc.voice_measures(*[F.col(c) for c in ("peak", "rms", "floor", "high", "low")]).items()])
    out = m.select("item", "separation", "crest", "tilt", *[c.alias(n) for n, c in qc.voice_treatment(F.col("separation"), F.col("tilt"), F.col("crest")).items()])
    words = qc.described([(F.col("denoise") > 0, F.lit("denoise")), (F.col("presence") > 0, F.lit("lift")), (F.col("deess") > 0, F.lit("de-ess")), (F.col("compress"), F.lit("compress"))])
    return out.select("item", "compress", words.alias("words"), *[F.round(c, 5).alias(c) for c in ("separation", "crest", "tilt", "denoise", "presence", "deess", "warmth")])


def log_measurements(spark: SparkSession, d: str) -> DataFrame:
    """Tool logs of ten seconds are written from orders and read back: the first silence begins before 0, the last has
    no end."""
    o, n = table(spark, d, "orders"), F.col("o_orderkey") % 4
    spans = F.transform(F.sequence(F.lit(1), (n + 1).cast("int")), lambda k: F.concat(F.lit("silence_start: "), k.cast("string"), F.lit(".5\nsilence_end: "), (k + 1).cast("string"), F.lit(".25 | silence_duration: 0.75\n")))
    log = F.concat(F.lit("silence_start: -0.25\nsilence_end: 0.5 | silence_duration: 0.75\n"), F.array_join(spans, ""), F.lit("silence_start: 9.5\nmax_volume: -9.0 dB\nmax_volume: -"), n.cast("string"), F.lit('.5 dB\n{"input_i" : "bad"}\n{ "input_i" : "-'), (n + 10).cast("string"), F.lit('.25", "x" : "1" }\n'))
    m = qc.log_measurements(log, F.lit(10.0))
    return o.select(F.col("o_orderkey").alias("id"), m["silent_s"].alias("silent_s"), m["peak_db"].alias("peak_db"), m["lufs"].alias("lufs"), F.size(m["pairs"]).cast("long").alias("n_pairs"), F.aggregate(m["pairs"], F.lit(0.0), lambda a, x: a + x["b"] - x["a"]).alias("paired_s"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    p = probe_summary(fx.probe_json(spark, d))
    return p.select("id", "duration_s", "width", "height", "vcodec", "acodec", "has_audio", "bitrate", F.round("fps", 6).alias("fps"))


_RUNS = "q as (select item, frame, frame - row_number() over (partition by item order by frame) as i from level_frames where level_db < -35), runs as (select item, min(frame)*200 as from_ms, (min(frame)+count(*))*200 as to_ms, count(*) as n from q group by item, i having count(*)*200 >= {0})"
_BOXES = "boxes as (select clip, t, min(x) as l, max(x+w) as r, arg_max(x+w/2, (h,x,w)) as cx, arg_max(h, (h,x,w)) as big_h, arg_max(y+h*0.42, (h,x,w,y)) as eye, count(*) as n from detections group by 1,2)"

QUERIES = {
    "quiet_runs": (quiet_runs, with_views("level_frames", "+" + _RUNS.format(600) + " select item, from_ms, to_ms from runs")),
    "audio_flags": (
        audio_flags,
        with_views("level_frames", "+" + _RUNS.format(600) + """, m as (select item, count(*) as n, max(level_db) as peak_db, round(10*log10(avg(pow(10.0, level_db/10))),6) as mean_db from level_frames group by 1),
 s as (select item, sum(to_ms-from_ms) as silent from runs group by 1),
 x as (select m.item, round(least(1.0, coalesce(silent,0)/(n*200)::double),3) as silence_share, peak_db, mean_db from m left join s using(item)),
 f as (select *, (silence_share>0.3)::int + (peak_db>=-0.5)::int + (mean_db < -34)::int + (peak_db-mean_db<6 and mean_db < -20)::int as n_flags from x)
 select item, silence_share, peak_db, mean_db, n_flags=0 as ok, n_flags::bigint as n_flags from f"""),
    ),
    "keep_ranges": (
        keep_ranges,
        with_views("windows", """+items as (select doc_id, min(start_ms)+700 as t0, max(end_ms) as t1 from windows group by 1),
 cuts as (select w.doc_id, greatest(t0, case when w.doc_id%9=0 then 0 else start_ms+100 end) as a, least(t1, case when w.doc_id%9=0 then 1000000000 else start_ms+seg_to*37%9000 end) as b, t0, t1 from windows w join items using(doc_id) where (seg_from+seg_to)%3=0),
 good as (select * from cuts where b-a>50),
 c as (select *, greatest(t0, coalesce(max(b) over (partition by doc_id order by a,b rows between unbounded preceding and 1 preceding), t0)) as cur from good),
 k as (select doc_id, cur as from_ms, a as to_ms from c where a>cur union all select doc_id, max(b), max(t1) from good group by 1 having max(b)<max(t1))
 select * from k union all select doc_id, t0, t1 from items where doc_id not in (select doc_id from k)"""),
    ),
    "silence_keeps": (
        silence_keeps,
        with_views("level_frames", "+" + _RUNS.format(1200) + """, d as (select item, count(*)*200 as dur from level_frames group by 1),
 c as (select r.item, dur, from_ms, to_ms, greatest(0, coalesce(max(to_ms-250) over (partition by r.item order by from_ms,to_ms rows between unbounded preceding and 1 preceding),0)) as cur from runs r join d using(item)),
 p as (select item, cur as a, least(from_ms+250,dur) as b from c union all select item, greatest(0,max(to_ms-250)), max(dur) from c group by item),
 k as (select * from p where b-a>250),
 g as (select k.item from k join d using(item) group by k.item, dur having count(*)-1 <= greatest(1.0, dur/60000.0*8) and sum(b-a) >= dur*0.6)
 select item, a as from_ms, b as to_ms from k where item in (select item from g) union all select item, 0, dur from d where item not in (select item from g)"""),
    ),
    "level_profile": (
        level_profile,
        with_views("pixels", """+y as (select *, round(0.2126*r+0.7152*g+0.0722*b,6) as y from pixels),
 o as (select item, quantile_cont(y,0.01) as black, quantile_cont(y,0.8) as p80, quantile_cont(y,0.99) as white, avg(y) as mean, stddev_pop(y) as contrast, avg(r) as mean_r, avg(g) as mean_g, avg(b) as mean_b from y group by 1),
 c as (select y.item, avg(r)-avg(b) as x from y join o using(item) where y>p80 group by 1)
 select item, black between 0 and 60 and white between 190 and 255 and mean between 110 and 140 and contrast between 10 and 60 as in_target, round(black,5) as black, round(p80,5) as p80, round(white,5) as white, round(mean,5) as mean, round(contrast,5) as contrast, round(mean_r,5) as mean_r, round(mean_g,5) as mean_g, round(mean_b,5) as mean_b, round(coalesce(x,0),5) as "cast" from o left join c using(item)"""),
    ),
    "frame_boxes": (frame_boxes, with_views("detections", "+" + _BOXES + ' select clip, t, n, big_h, round(l,6) as "left", round(r,6) as "right", round(r-l,6) as span, round((l+r)/2,6) as mid, round(cx,6) as cx, round(eye,6) as eye, round(big_h/360,6)::double as face_share from boxes')),
    "track_decision": (track_decision, with_views("detections", "+" + _BOXES + " select clip, avg(r-l)/640 < 0.07*0.9 as both_fit, round(least(1.0, greatest(0.34, 5.5*greatest(0.02, avg(big_h/360)))),6) as crop from boxes group by 1")),
    "ema_track": (
        ema_track,
        with_views("detections", "+" + _BOXES + """, c as (select clip, t, case when avg(r-l) over (partition by clip)/640 < 0.07*0.9 then (l+r)/2 else cx end as cx from boxes), s as (select clip, list([cx] order by t) as xs, list(t order by t) as ts from c group by 1),
 f as (select clip, ts, list_reduce(xs, lambda a, x: list_concat(a, [a[len(a)] + 0.35*(x[1]-a[len(a)])])) as ys from s)
 select clip, ts[i] as t, ys[i] as smooth, ts[i+1] as until from f, lateral unnest(range(1,len(ts)+1)) u(i)"""),
    ),
    "treatment_decision": (
        treatment_decision,
        with_views("level_frames", """+l as (select item, max(level_db) as peak, quantile_cont(level_db,0.5) as rms, min(level_db) as floor, quantile_cont(level_db,0.25) as high, quantile_cont(level_db,0.4) as low from level_frames group by 1),
 m as (select item, peak-floor as separation, peak-rms as crest, coalesce(pow(10.0,high/20)/greatest(pow(10.0,low/20)+pow(10.0,high/20),1e-9),0.4) as tilt from l),
 t as (select *, case when 52-separation>2 then least(0.85,greatest(0.0,(52-separation)/22)) else 0 end as denoise, case when tilt<0.28 then least(4.0,greatest(0.0,(0.28-tilt)*22)) when tilt>0.52 then 0 else 1 end as presence, case when tilt<0.28 then 0 when tilt>0.52 then least(0.6,greatest(0.0,(tilt-0.52)*2)) else 0.25 end as deess, case when tilt<0.45 then -3.0 else -1.5 end as warmth, crest>14 as compress from m)
 select item, compress, array_to_string(list_filter([case when denoise>0 then 'denoise' else '' end, case when presence>0 then 'lift' else '' end, case when deess>0 then 'de-ess' else '' end, case when compress then 'compress' else '' end], lambda x: x<>''), ', ') as words, round(separation,5) as separation, round(crest,5) as crest, round(tilt,5) as tilt, round(denoise,5)::double as denoise, round(presence,5)::double as presence, round(deess,5)::double as deess, warmth::double as warmth from t"""),
    ),
    "log_measurements": (log_measurements, "select o_orderkey as id, 0.75*(o_orderkey%4+2)::double as silent_s, -(o_orderkey%4+0.5)::double as peak_db, -(o_orderkey%4+10.25)::double as lufs, o_orderkey%4+3 as n_pairs, 0.75*(o_orderkey%4+1)::double+1.0 as paired_s from orders"),
    "probe_summary": (
        probes,
        with_views("probe_json", "select id, json_extract_string(js,'$.format.duration')::double as duration_s, json_extract(js,'$.streams[1].width')::bigint as width, json_extract(js,'$.streams[1].height')::bigint as height, json_extract_string(js,'$.streams[1].codec_name') as vcodec, json_extract_string(js,'$.streams[0].codec_name') as acodec, true as has_audio, json_extract_string(js,'$.format.bit_rate')::bigint as bitrate, round(30000/1001.0,6)::double as fps from probe_json"),
    ),
}
