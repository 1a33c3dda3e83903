"""Threads, sections, context packs and JSON recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import threads as th
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from ..sources.readers import sections_of, table


def thread_summary(spark: SparkSession, d: str) -> DataFrame:
    return th.thread_summary(table(spark, d, "conversations"))


def last_turns(spark: SparkSession, d: str) -> DataFrame:
    return th.last_turns(table(spark, d, "conversations"), 2)


def intent_flags(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    text = F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in ("why did it", "my HOOK style", "the last run", "hooked", "keeps picking", "a punch-in")]), (F.col("turn") % 6 + 1).cast("int")), "text")
    return c.select("conv_id", "turn", *[v.alias(k) for k, v in th.intent_flags(text).items()])


def compaction(spark: SparkSession, d: str) -> DataFrame:
    return th.compaction(table(spark, d, "conversations"), after=5, keep=2, chars=60)


def compaction_long(spark: SparkSession, d: str) -> DataFrame:
    """Eight conversations as one thread, so that there are more turns than compaction's own 15."""
    c = table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 8).alias("conv_id"), (F.col("conv_id") % 8 * 100 + F.col("turn")).alias("turn"), "role", "text")
    return th.compaction(c)


def section_split(spark: SparkSession, d: str) -> DataFrame:
    """Headed documents split again: their sections are the turns."""
    return sections_of(fx.sections(spark, d)).select("conv_id", "name", F.regexp_replace("body", r"^\s+|\s+$", "").alias("body"))


def context_packs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"), F.min_by("text", "turn").alias("first"), F.count("*").alias("n"))
    some = F.col("conv_id")
    parts = [("voice", F.lit(True), F.lit("plain")), ("rules", some % 2 == 0, F.col("first")), ("run", some % 3 == 0, F.lit(" ")), ("message", F.lit(True), F.col("last"))]
    return c.select("conv_id", *[v.alias(k) for k, v in th.context_pack(parts).items()])


def json_recovery(spark: SparkSession, d: str) -> DataFrame:
    r = th.recovered(fx.raw_replies(spark, d), "reply", "struct<id:bigint,n:bigint>")
    return r.select("doc_id", F.col("value.id").alias("id"), F.col("value.n").alias("n"), "at_once", "error")


_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_ANY = lambda words: f"regexp_matches(t, '(?i)\\b({words})\\b')"
_PARTS = ["'== VOICE ==' || chr(10) || 'plain'", "case when conv_id%2=0 and trim(first)<>'' then '== RULES ==' || chr(10) || first end", "case when trim(last)<>'' then '== MESSAGE ==' || chr(10) || last end"]

QUERIES = {
    "thread_summary": (thread_summary, "select conv_id, count(*) as turns, max(turn) as last_turn, cast(sum(length(text)//4) as bigint) as tokens from conversations group by 1"),
    "last_turns": (last_turns, "with r as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) select * from r where back<=2"),
    "intent_flags": (
        intent_flags,
        f"with c as (select conv_id, turn, ['why did it','my HOOK style','the last run','hooked','keeps picking','a punch-in'][1+turn%6]||' '||text as t from conversations) select conv_id, turn, {_ANY(th.RULES_WORDS)} as wants_rules, {_ANY(th.JOB_WORDS)} as wants_job, {_ANY(th.TUNE_WORDS)} as wants_tune from c",
    ),
    "compaction": (compaction, "with r as (select *, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn desc) as back from conversations) select conv_id, string_agg(role||': '||substr(text,1,60), chr(10) order by turn) as digest_input, count(*) as old_turns from r where n>5 and back>2 group by 1"),
    "compaction_long": (compaction_long, "with c as (select conv_id//8 as conv_id, conv_id%8*100+turn as turn, role, text from conversations), r as (select *, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn desc) as back from c) select conv_id, string_agg(role||': '||substr(text,1,600), chr(10) order by turn) as digest_input, count(*) as old_turns from r where n>15 and back>6 group by 1"),
    "section_split": (section_split, f"select conv_id, upper(role)||' '||turn as name, {_TRIM.format('text')} as body from conversations"),
    "context_packs": (
        context_packs,
        f"with c as (select conv_id, arg_max(text,turn) as last, arg_min(text,turn) as first from conversations group by 1), p as (select conv_id, concat_ws(chr(10)||chr(10), {', '.join(_PARTS)}) as pack, concat_ws(',','voice', case when conv_id%2=0 and trim(first)<>'' then 'rules' end, case when trim(last)<>'' then 'message' end) as loaded from c) select *, length(pack)//4 as tokens from p",
    ),
    "json_recovery": (json_recovery, "select doc_id, case when doc_id%4<>3 then doc_id end as id, case when doc_id%4<>3 then n_chars end as n, doc_id%4<2 as at_once, case when doc_id%4=3 then 'no parseable JSON' end as error from documents"),
}
