"""Recordings, clips, posts and logs derived from the driver's tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapsed, complete_thought, self_contained
from .readers import table


def _words_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.split(collapsed(F.col("text")), " ").alias("ws"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    w = _words_of(spark, d)
    n = F.size("ws")
    k = F.explode(F.sequence(F.lit(0), F.ceil(n / 12.0).cast("int") - 1)).alias("seg")
    return w.select("doc_id", "ws", k).select(
        "doc_id", F.col("seg").cast("long").alias("seg"), F.array_join(F.slice("ws", F.col("seg") * 12 + 1, 12), " ").alias("text"), (F.col("seg") * 4800).cast("long").alias("start_ms"), (F.col("seg") * 4800 + 400 * F.least(F.lit(12), n - 12 * F.col("seg"))).cast("long").alias("end_ms")
    )


def words(spark: SparkSession, d: str) -> DataFrame:
    return _words_of(spark, d).select("doc_id", F.posexplode("ws").alias("p", "w")).select("doc_id", F.col("p").cast("long").alias("pos"), "w", (F.col("p") * 400).cast("long").alias("start_ms"), (F.col("p") * 400 + 400).cast("long").alias("end_ms"))


def windows(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.windows import enumerate_windows

    s = segments(spark, d)
    return enumerate_windows(s, "doc_id", self_contained(F.col("text")), complete_thought(F.col("text")), 30_000, 80_000)


def replies(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).select("doc_id", "seg_from", "seg_to")
    tags = F.array(*[F.lit(x) for x in ("teach", "story", "loop", "raw", "other")])
    d_, a, b = F.col("doc_id"), F.col("seg_from"), F.col("seg_to")
    reply = lambda batch, pos, score, structure, thought: F.struct(F.lit(batch).alias("batch"), F.lit(pos).alias("pos"), (score % 101).alias("score"), structure.alias("structure"), thought.alias("complete_thought"))
    one = F.when((d_ + a) % 9 != 0, reply(1, 1, d_ * 7 + a * 13 + b, F.element_at(tags, (1 + (d_ + a) % 5).cast("int")), (d_ + b) % 11 != 0))
    two = F.when(d_ % 10 == 0, reply(2, 1, d_ * 3 + a, F.lit("other"), F.lit(None).cast("boolean")))
    three = F.when(d_ % 15 == 0, reply(2, 2, d_ * 5 + b, F.lit("loop"), F.lit(True)))
    return w.select("*", F.explode(F.array_compact(F.array(one, two, three))).alias("r")).select("doc_id", "seg_from", "seg_to", "r.*")


def clips(spark: SparkSession, d: str) -> DataFrame:
    states = F.array(F.lit("approved"), F.lit("rejected"), F.lit("pending"))
    minutes = F.make_dt_interval(mins=(F.col("doc_id") * 37 + F.col("seg_from")).cast("int"))
    return windows(spark, d).filter(F.col("seg_to") % 2 == 0).select(
        "doc_id", "seg_from", "seg_to", "start_ms", "end_ms", F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("profile"),
        F.element_at(states, (1 + (F.col("doc_id") + F.col("seg_to")) % 3).cast("int")).alias("decision"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minutes).alias("approved_at"), (F.col("doc_id") % 7 == 0).alias("posted"),
    )


def post_log(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "signup", "published").when(F.col("event_type") == "error", "ignored").otherwise("metrics")
    metric = lambda e: F.when(F.col("event_type") == e, F.col("value"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("job"), (k % 5).cast("int").alias("clip"), F.col("ts").cast("timestamp_ntz").alias("ts"), kind.alias("kind"), metric("view").alias("views"), metric("click").alias("likes"), metric("purchase").alias("saves"),
        F.when(F.col("event_id") % 10 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:00")).otherwise("").alias("slot_at"), F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("source"), F.concat(F.lit("t"), (k % 7).cast("string")).alias("topic"),
    )


def usage_calls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("label"), (F.col("event_type") != "error").alias("ok"), (1 + F.col("event_id") % 3).alias("attempt"), (F.col("value") / 1000).alias("cost_usd"), (F.col("event_id") % 900).alias("wall_ms"), (F.col("event_id") % 5000).alias("tok_in"), (F.col("event_id") % 700).alias("tok_out"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 90).alias("cache_create"), (F.col("event_id") % 40).alias("cache_read"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"))


def level_frames(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("item"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("frame"), (-F.col("value")).alias("level_db"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("t"), (F.col("l_discount") * 1000).alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"), (20 + F.col("l_tax") * 100).alias("w"), F.col("l_quantity").alias("h"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    # 32-bit arithmetic, as the vectors are floats
    channel = lambda k: F.floor((F.col("embedding")[F.col("i") * 3 + k].cast("double") + 1) * 127.5).cast("double")
    return e.select(F.col("label").alias("item"), (F.col("vec_id") * 21 + F.col("i")).alias("i"), channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def upload_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload_id"), (F.col("l_linenumber") - 1).cast("long").alias("idx"), F.lit(7).cast("long").alias("total_chunks")).distinct()


def uploads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("upload_id"), F.lit(7).cast("long").alias("total_chunks"))


def recordings(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), state.alias("status"), F.col("o_orderpriority").alias("profile"))


def feedback(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "labels").filter("quality = 0 or toxic = 1")
    return table(spark, d, "documents").join(bad, "doc_id").select("doc_id", F.col("source").alias("reason"), F.col("lang").alias("profile"), F.substring("text", 1, 200).alias("note"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("k"), (F.col("doc_id") % 5).cast("string"))).alias("structure"), F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")).alias("topic"), F.when(F.col("doc_id") % 4 > 0, F.substring("text", 1, 150)).alias("hook"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("area"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("n_chars").alias("length"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("mtime"))


def raw_replies(spark: SparkSession, d: str) -> DataFrame:
    i, n, k = F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), F.col("doc_id") % 4
    obj = F.concat(F.lit('{"id":'), i, F.lit(',"n":'), n, F.lit("}"))
    return table(spark, d, "documents").select("doc_id", F.when(k == 0, obj).when(k == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure: "), obj, F.lit(" done"))).otherwise(F.concat(F.lit('{"id":'), i)).alias("reply"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.lit("## "), F.upper("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("doc"))


def probe_json(spark: SparkSession, d: str) -> DataFrame:
    js = F.concat(F.lit('{"format":{"duration":"'), F.col("p_retailprice").cast("string"), F.lit('","bit_rate":"'), (F.col("p_size") * 1000).cast("string"), F.lit('"},"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","width":'), (F.col("p_size") * 64).cast("string"), F.lit(',"height":'), (F.col("p_size") * 36).cast("string"), F.lit(',"r_frame_rate":"30000/1001"}]}'))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), js.alias("js"))


_OPENER = "^(and|but|so|because|then|which|that''s why|like i said|as i mentioned|going back|anyway|also|plus|or |too\\b|again\\b)"
_WS = "(select doc_id, string_split(regexp_replace(trim(text),'\\s+',' ','g'),' ') ws from documents)"
SQL = {
    "segments": f"select doc_id, k as seg, array_to_string(ws[12*k+1:12*k+12],' ') as text, k*4800 as start_ms, k*4800+400*least(12,len(ws)-12*k) as end_ms from {_WS} w, lateral unnest(range(0,cast(ceil(len(ws)/12.0) as bigint))) t(k)",
    "words": f"select doc_id, p as pos, ws[p+1] as w, 400*p as start_ms, 400*p+400 as end_ms from {_WS} w, lateral unnest(range(0,len(ws))) t(p)",
    "windows": f"select a.doc_id, a.seg seg_from, b.seg seg_to, a.start_ms, b.end_ms from segments a join segments b on a.doc_id=b.doc_id and b.seg>=a.seg and b.end_ms-a.start_ms between 30000 and 80000 where not regexp_matches(lower(a.text),'{_OPENER}') and regexp_matches(b.text,'[.!?][\"'')\\]]?\\s*$')",
    "replies": "select doc_id, seg_from, seg_to, 1 as batch, 1 as pos, (doc_id*7+seg_from*13+seg_to) % 101 as score, ['teach','story','loop','raw','other'][1+(doc_id+seg_from)%5] as structure, (doc_id+seg_to)%11<>0 as complete_thought from windows where (doc_id+seg_from)%9<>0 union all select doc_id, seg_from, seg_to, 2, 1, (doc_id*3+seg_from) % 101, 'other', null from windows where doc_id%10=0 union all select doc_id, seg_from, seg_to, 2, 2, (doc_id*5+seg_to) % 101, 'loop', true from windows where doc_id%15=0",
    "clips": "select doc_id, seg_from, seg_to, start_ms, end_ms, case when doc_id%2=0 then 'A' else 'B' end as profile, ['approved','rejected','pending'][1+(doc_id+seg_to)%3] as decision, timestamp '2024-01-01' + to_minutes(cast(doc_id*37+seg_from as bigint)) as approved_at, doc_id%7=0 as posted from windows where seg_to%2=0",
    "post_log": "select user_id as job, cast(json_extract_string(props,'$.k') as int)%5 as clip, ts, case when event_type='signup' then 'published' when event_type='error' then 'ignored' else 'metrics' end as kind, case when event_type='view' then value end as views, case when event_type='click' then value end as likes, case when event_type='purchase' then value end as saves, case when event_id%10<>0 then strftime(ts,'%Y-%m-%dT%H:00') else '' end as slot_at, 's'||(user_id%20) as source, 't'||(cast(json_extract_string(props,'$.k') as int)%7) as topic from events",
    "usage_calls": "select user_id as job, ts, event_type as label, event_type<>'error' as ok, 1+event_id%3 as attempt, value/1000 as cost_usd, event_id%900 as wall_ms, event_id%5000 as tok_in, event_id%700 as tok_out, case when event_id%3>0 then event_id%90 end as cache_create, event_id%40 as cache_read, case when event_type='error' then 'e'||event_id end as error from events",
    "level_frames": "select user_id as item, row_number() over (partition by user_id order by ts, event_id)-1 as frame, -value as level_db from events",
    "detections": "select l_orderkey as clip, l_linenumber as t, l_discount*1000 as x, (l_suppkey%50)::double as y, 20+l_tax*100 as w, l_quantity as h from lineitem",
    "pixels": "select label as item, vec_id*21+i as i, floor((embedding[3*i+1]::double+1)*127.5) r, floor((embedding[3*i+2]::double+1)*127.5) g, floor((embedding[3*i+3]::double+1)*127.5) b from embeddings, lateral unnest(range(0,21)) t(i)",
    "upload_chunks": "select distinct l_orderkey as upload_id, l_linenumber-1 as idx, 7 as total_chunks from lineitem",
    "recordings": "select o_orderkey as id, o_orderdate as created_at, case o_orderstatus when 'O' then 'queued' when 'P' then 'running' else 'done' end as status, o_orderpriority as profile from orders",
    "feedback": "select d.doc_id, d.source as reason, d.lang as profile, substr(d.text,1,200) as note, case when doc_id%3>0 then 'k'||(doc_id%5) end as structure, 't'||(doc_id%7) as topic, case when doc_id%4>0 then substr(d.text,1,150) end as hook from documents d join labels l using(doc_id) where l.quality=0 or l.toxic=1",
    "files": "select source as area, 'doc_'||doc_id||'.txt' as name, n_chars as length, timestamp '2024-01-01' + to_hours(cast(doc_id as bigint)) as mtime from documents",
    "raw_replies": "select doc_id, case doc_id%4 when 0 then '{\"id\":'||doc_id||',\"n\":'||n_chars||'}' when 1 then '```json'||chr(10)||'{\"id\":'||doc_id||',\"n\":'||n_chars||'}'||chr(10)||'```' when 2 then 'Sure: {\"id\":'||doc_id||',\"n\":'||n_chars||'} done' else '{\"id\":'||doc_id end as reply from documents",
    "sections": "select conv_id, string_agg('## '||upper(role)||' '||turn||chr(10)||text, chr(10) order by turn) as doc from conversations group by conv_id",
    "probe_json": "select p_partkey as id, '{\"format\":{\"duration\":\"'||p_retailprice||'\",\"bit_rate\":\"'||(p_size*1000)||'\"},\"streams\":[{\"codec_type\":\"audio\",\"codec_name\":\"aac\"},{\"codec_type\":\"video\",\"width\":'||(p_size*64)||',\"height\":'||(p_size*36)||',\"r_frame_rate\":\"30000/1001\"}]}' as js from part",
}
_NEEDS = {"windows": ["segments"], "replies": ["segments", "windows"], "clips": ["segments", "windows"]}


def with_views(views: str, body: str) -> str:
    """body after the CTEs of the views it names (space-separated) and of those they need."""
    names: list[str] = []
    for v in views.split():
        names += [x for x in [*_NEEDS.get(v, []), v] if x not in names]
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().lstrip("+")
