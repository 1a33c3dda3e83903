"""The driver's queries over this package's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, jaccard_join, language_model, lexical, merkle, pieces, quality, secrets, shared, suffix_dedup, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.lm_scores(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=9, den=10)
    return out.select("doc_id", "n_shingles", "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages")).drop("ratio")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"

_OP5 = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text,''),{_AZ}),'[^\x20\x09-\x0D]+') as ws from documents),
 s as (select doc_id, case when len(ws)=0 then [] when len(ws)<3 then [array_to_string(ws,' ')] else list_distinct(list_transform(range(1,len(ws)-1), lambda i: array_to_string(ws[i:i+2],' '))) end as sh from w),
 e as (select doc_id, unnest(sh) as g from s), n as (select doc_id, len(sh) as n from s),
 o as (select a.doc_id as a, b.doc_id as b, count(*) as i from e a join e b on a.g=b.g and a.doc_id<>b.doc_id group by 1,2),
 l as (select o.a, o.b from o join n x on x.doc_id=o.a join n y on y.doc_id=o.b where 100*i>=90*(x.n+y.n-i)),
 reach as (select a, b from l union select r.a, l.b from reach r join l on r.b=l.a)
 select n.doc_id, n.n::bigint as n_shingles, least(n.doc_id, coalesce((select min(b) from reach where a=n.doc_id), n.doc_id)) as component_id from n"""

_OP6 = """with n as (select doc_id, length(coalesce(text,'')) as c, regexp_replace(coalesce(text,''),'[\x20\x09-\x0D]','','g') as t from documents),
 k as (select *, first_value(doc_id) over (partition by t order by c desc, doc_id) as keep_id, count(*) over (partition by t) as group_size from n)
 select doc_id, keep_id, group_size, doc_id=keep_id as kept, sha256(t) as text_sha256 from k"""


def _op3_sql() -> str:
    """Every rule scans every text here; the index only saves work."""
    parts = []
    for k, r in enumerate(secrets.RULES):
        p = "'" + ("(?i)" if r.fold else "") + r.pattern.replace("'", "''") + "'"
        parts.append(f"select doc_id, '{r.kind}' as kind, {k} as k, {r.least} as least, list_transform(regexp_split_to_array(t,{p}), lambda x: length(x)) as g, list_transform(regexp_extract_all(t,{p},0), lambda x: length(x)) as m, list_transform(regexp_extract_all(t,{p},{r.group}), lambda x: length(x)) as v from d")
    count = lambda kind: f"count(*) filter (kind='{kind}') as n_{kind}"
    base = [r.kind for r in secrets.RULES if r.base]
    spans = lambda cond: f"coalesce(string_agg(kind||':'||s||':'||e, ',' order by s, k, e) filter ({cond}),'')"
    return f"""with d as (select doc_id, coalesce(text,'') as t from documents), m as ({' union all '.join(parts)}),
 x as (select doc_id, kind, k, least, v[i] as v, list_sum(g[1:i])::bigint + coalesce(list_sum(m[1:i-1]),0)::bigint as s, list_sum(g[1:i])::bigint + list_sum(m[1:i])::bigint as e from m, lateral unnest(range(1,len(m.m)+1)) u(i)),
 y as (select d.doc_id, x.kind, k, s, e from d left join x on d.doc_id=x.doc_id and x.v>=x.least)
 select doc_id, {', '.join(count(k) for k in base)}, sha256({spans(f"k < {len(base)}")}) as base_sha256, {spans('true')} as spans from y group by 1"""


def _op9_sql() -> str:
    u = url_filter
    longest = sorted(u.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = lambda value: "case " + " ".join(f"when (host='{h}' or ends_with(host,'.{h}')) and starts_with(path,'{p}') then '{value(a, h + p)}'" for a, h, p in longest) + " end"
    steps = []
    for k in range(1, u.ORDER + 1):
        part = f"substr(g,{u.ORDER - k + 1},{k})"
        context = f"partition by substr(g,{u.ORDER - k + 1},{k - 1})" if k > 1 else ""
        was = lambda c: f"p{c}{k - 1}" if k > 1 else f"{1.0 / u.SYMBOLS}::double"
        prob = lambda c: f"case when sum({c}) over ({context}) >= {u.MIN_CONTEXT} then (sum({c}) over (partition by {part}) + {u.ALPHA}::double * {was(c)}) / (sum({c}) over ({context}) + {u.ALPHA}::double) else {was(c)} end as p{c}{k}"
        steps.append(f"l{k} as (select *, {prob('a')}, {prob('r')} from {'seen' if k == 1 else f'l{k - 1}'})")
    return f"""with parts as (select page_id, coalesce(url,'') as url, case when contains(coalesce(url,''),'://') then substr(url, instr(url,'://')+3) else '' end as rest from pages),
 hosts as (select page_id, url, translate(regexp_extract(rest,'^([^/?#]*)',1),{_AZ}) as host, regexp_extract(rest,'^[^/?#]*([^?#]*)',1) as path from parts),
 base as (select row_number() over () as rid, page_id, host, path, {rule(lambda a, n: n)} as rule, {rule(lambda a, n: a)} as action, coalesce(page_id%{u.CALIBRATION_FOLDS}=0,false) as held, '^^^'||regexp_replace(regexp_replace(translate(url,{_AZ}),'[0-9]','0','g'),'[^a-z0./:?=&#_%-]','~','g')||'$' as s from hosts),
 grams as (select rid, action, held, substr(s,i,{u.ORDER}) as g from base, lateral unnest(range(1,length(s)-{u.ORDER - 2})) t(i)),
 seen as (select g, count(*) filter (action='allow' and not held)::double as a, count(*) filter (action='block' and not held)::double as r from grams group by 1),
 {', '.join(steps)},
 model as (select g, case when (select sum(a) from seen)>0 and (select sum(r) from seen)>0 then round({u.SCALE}*(ln(pa{u.ORDER})-ln(pr{u.ORDER})))::bigint else 0 end as llr from l{u.ORDER}),
 ratios as (select rid, sum(llr)/count(*)::double as ratio from grams join model using(g) group by 1),
 middles as (select action, quantile_cont(round(ratio),0.5) as m from base join ratios using(rid) where held and action is not null group by 1),
 cut as (select case when count(*)=2 then sum(m)/2 else 0 end as threshold from middles)
 select page_id, host, path, rule, coalesce(action, case when ratio>=threshold then 'allow' else 'block' end) as verdict from base join ratios using(rid), cut"""


def _op10_sql() -> str:
    """Bytes as pairs of hexadecimal digits; every window of both kinds is listed and counted here. Windows are cut from
    overlapping blocks only because a cut far into a long string is slow."""
    n, k = suffix_dedup.LENGTH, suffix_dedup.PASSAGE
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text,'') as t, hex(encode(coalesce(text,''))) as h from documents),
 blocks as (select r, lo, substr(h,2*lo+1,{4 * n - 2}) as part from d, lateral unnest(range(0,length(h)//2-{n}+1,{n})) u(lo)),
 w as (select r, lo+i as i, md5(substr(part,2*i-1,{2 * n})) as m from blocks, lateral unnest(range(1,length(part)//2-{n}+2)) u(i)),
 starts as (select r, i, lag(i) over (partition by r order by i) as before from w where m in (select m from w group by m having count(*)>1)),
 numbered as (select r, i, count(*) filter (before is null or i>before+{n}) over (partition by r order by i) as span from starts),
 spans as (select r, min(i) as a, max(i)+{n} as b from numbered group by r, span),
 edges as (select r, coalesce(lag(b) over (partition by r order by a),1) as x, a as y, b from spans),
 cut as (select r, sum(b-y)::bigint as n_removed, count(*) as n_spans, string_agg(substr(h,2*x-1,2*(y-x)),'' order by y)||substr(any_value(h),2*max(b)-1) as kept from edges join d using(r) group by r),
 p as (select r, regexp_extract_all(t,'[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') as ws from d),
 passages as (select r, md5(array_to_string(ws[i:i+{k - 2}],'')||regexp_extract(ws[i+{k - 1}],'^[^\x20\x09-\x0D]+')) as m from p, lateral unnest(range(1,len(ws)-{k}+2)) u(i)),
 shared as (select r, count(*) as c from passages where m in (select m from passages group by m having count(distinct r)>1) group by r)
 select doc_id, (length(h)//2)::bigint as n_bytes, coalesce(n_removed,0) as n_removed, coalesce(n_spans,0) as n_spans, sha256(unhex(coalesce(kept,h))) as kept_sha256, coalesce(c,0) as n_shared from d left join cut using(r) left join shared using(r)"""


_OP12 = f"""with term as (select doc_id, r, unnest(regexp_extract_all(translate(text,{_AZ}),'{lexical.TERM}')) as t from (select *, row_number() over () as r from documents)),
 tf as (select r, any_value(doc_id) as doc_id, t, count(*) as tf from term group by r, t), n as (select r, sum(tf)::bigint as n from tf group by r),
 al as (select count(*) as nn, sum(n)::bigint as l from n), df as (select t, count(*) as df from tf group by t),
 item as (select i, any_value(item_id) as item_id, t, count(*) as c from (select i, item_id, unnest(regexp_extract_all(translate(text,{_AZ}),'{lexical.TERM}')) as t from (select *, row_number() over () as i from benchmark)) group by i, t),
 s as (select i, any_value(item_id) as item_id, tf.r, any_value(tf.doc_id) as doc_id, sum(c*floor(1000*ln((2*nn+2)::double/(2*df+1)::double))::bigint*((1000000000*tf.tf)//(1000*tf.tf+12*({lexical.FLOOR}+(({lexical.SHARE}*n*nn)//l)))))::bigint as score from item join tf using(t) join df using(t) join n on n.r=tf.r, al group by i, tf.r),
 k as (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from s where score>0)
 select item_id, rank::int as rank, doc_id, score from k where rank<={lexical.TOP}"""


def _op13_sql(levels: int = 9, langs: int = 4) -> str:
    """So many levels of runs over leaves and over languages; a tree that has ended stays as it is."""
    run, entries = merkle.RUN, []
    for c in range(256):  # the table of CRC-32
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        entries.append(str(c))
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar,''), x -> ascii(x)::bigint)), lambda a, b: xor(a >> 8, ([{','.join(entries)}]::bigint[])[(xor(a, b) & 255) + 1])), 4294967295)".replace("x -> ascii", "lambda x: ascii")
    value = lambda v: f"coalesce(strlen({v})||':'||{v},'-')"
    leaf = lambda text: "sha256(" + "||".join(value(text if f == "text" else f"{f}::varchar") for f in merkle.FIELDS) + ")"

    def tree(name: str, start: str, depth: int) -> list[str]:
        """name0 .. with (g, p, c, d), runs with what stands before and behind each node."""
        out = [f"{name}0 as ({start})"]
        for k in range(depth):
            frame = f"partition by g, p//{run} order by p rows between"
            out += [
                f"{name}r{k} as (select g, p, c, coalesce(string_agg(d,'') over ({frame} unbounded preceding and 1 preceding),'') as l, coalesce(string_agg(d,'') over ({frame} 1 following and unbounded following),'') as r from {name}{k})",
                f"{name}{k + 1} as (select g, p//{run} as p, (any_value(c)+{run - 1})//{run} as c, case when any_value(c)>1 then sha256(string_agg(d,'' order by p)) else any_value(d) end as d from {name}{k} group by g, p//{run})",
            ]
        return out

    def climb(name: str, track: str, depth: int) -> list[str]:
        """track0 .. with id, the place g, p, the siblings so far, and the digest that the claim leads to."""
        return [f"{track}{k + 1} as (select t.id, t.g, t.p//{run} as p, proof||n.l||n.r as proof, case when n.c>1 then sha256(n.l||f||n.r) else f end as f from {track}{k} t join {name}r{k} n on t.g=n.g and t.p=n.p)" for k in range(depth)]

    parts = [
        f"d as (select row_number() over () as id, doc_id, coalesce('1'||lang,'0') as g, {leaf('text')} as leaf, case when {crc}%3=0 then {leaf(f'translate(text,{_AZ})')} end as changed from documents)",
        "placed as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by g) as c from d)",
        *tree("n", "select g, p, c, leaf as d from placed", levels),
        "t0 as (select id, g, p, '' as proof, coalesce(changed,leaf) as f from placed)", *climb("n", "t", levels),
        f"langs as (select g as lang, d, row_number() over (order by g) - 1 as p, count(*) over () as c from n{levels})",
        *tree("m", "select 0 as g, p, c, d from langs", langs),
        f"u0 as (select t.id, 0 as g, langs.p, t.proof, t.f from t{levels} t join langs on t.g=langs.lang)", *climb("m", "u", langs),
    ]
    return f"with {', '.join(parts)} select doc_id, leaf, langs.d as subroot, m.d as root, sha256(u.proof) as proof_sha256, u.f as folded_root, u.f=m.d as verified from d join u{langs} u using(id) join langs on langs.lang=d.g, m{langs} m"


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express in a time that is fit for a check; tests hold the rest against brute force."""
    return {"op3_secret_scan": _op3_sql(), "op5_jaccard_join": _OP5, "op6_exact_dedup": _OP6, "op9_url_filter": _op9_sql(), "op10_suffix_dedup": _op10_sql(), "op12_lexical_search": _OP12, "op13_merkle_manifest": _op13_sql()}
