"""Secret scan through a trigram inverted index. DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams: a text that the rule matches must satisfy it. The
index holds postings (trigram, row) of the trigrams that some query names, written in order of the trigram. Each way of a
clause is the intersection of its trigrams' postings, a clause the union of its ways, a rule the intersection of its
clauses; rows are intersected by counting, for all rules in one pass over the postings that they name. Only a rule's
candidates are verified with its expression. A rule whose expression forces no trigram (runs of hex digits) scans every
text.

Spans come from the same two native calls for every rule: the pieces between the matches and the matches themselves,
whose lengths add up to code-point positions.

Defined results: a very long text is scanned whole; spans that begin at one place come in the rules' order; a null text
is an empty one; an empty text has no spans and the digest of an empty string; repeated
rows are scanned each; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re._constants as K
import re._parser as P
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, materialize, with_rows


class Rule(NamedTuple):
    kind: str
    pattern: str
    fold: bool = False  #: letters in either case
    group: int = 0  #: the part whose length counts
    least: int = 1  #: code points that part has at least
    base: bool = True


#: Fixed kinds and expressions of the base scan, in the order that breaks ties, then those that this method adds.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", least=40, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30, base=False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
]
MOST_STRINGS = 32  #: alternatives kept while a query is derived

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strings_of(parsed) -> list[set[str] | None]:
    """The expression as a row of items: the exact strings an item may be, or None for anything."""
    items: list[set[str] | None] = []
    for op, arg in parsed:
        if op is K.LITERAL:
            items.append({chr(arg)})
        elif op is K.IN and all(x is K.LITERAL for x, _ in arg) and len(arg) <= 8:
            items.append({chr(a) for _, a in arg})
        elif op is K.SUBPATTERN:
            items += strings_of(arg[3])
        elif op is K.BRANCH:
            ways = [joined(strings_of(x)) for x in arg[1]]
            items.append(set().union(*ways) if all(w is not None for w in ways) else None)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            part = joined(strings_of(inner))
            if part is not None and high <= 3 and len(part) <= 4:
                items.append({"".join(x) for n in range(low, high + 1) for x in product(part, repeat=n)})
            elif part is not None and 0 < low <= 3 and len(part) <= 4:
                items += [part] * low + [None]
            else:
                items.append(None)
        elif op is not K.AT:
            items.append(None)
    return items


def joined(items: list[set[str] | None]) -> set[str] | None:
    """All strings of a row of items, or None where it is not a small set."""
    out = {""}
    for x in items:
        if x is None or len(out) * len(x) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in x}
    return out


def trigram_query(rule: Rule) -> list[list[list[str]]]:
    """An AND of ORs of ANDs of trigrams that every match satisfies; empty: none is mandatory."""
    import re

    query, run = [], []
    for item in [*strings_of(P.parse(rule.pattern, re.I if rule.fold else 0)), None]:
        if item is not None and joined([*run, item]) is not None:
            run.append(item)
            continue
        words = joined(run)
        run = [item] if item is not None else []
        if words and all(len(w) >= 3 for w in words):
            fold = (lambda w: w.lower()) if rule.fold else (lambda w: w)
            query.append(sorted({tuple(sorted({fold(w)[i : i + 3] for i in range(len(w) - 2)})) for w in words}))
    return [[list(ways) for ways in ors] for ors in query]


def _name(rule: Rule, trigram: str) -> str:
    return ("i:" if rule.fold else "c:") + trigram


def spans(text: Column, rule: Rule) -> Column:
    """kind, start, end of the leftmost non-overlapping matches that are long enough, in code points."""
    java = ("(?i)" if rule.fold else "") + rule.pattern
    between = F.transform(F.split(text, java, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, F.lit(java), F.lit(0)), lambda x: F.length(x))
    part = F.transform(F.regexp_extract_all(text, F.lit(java), F.lit(rule.group)), lambda x: F.length(x)) if rule.group else whole
    rows = F.arrays_zip(between.alias("gap"), whole.alias("size"), part.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,s:int,e:int>>").alias("got"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.coalesce(x["size"], F.lit(0))
        hit = F.array(F.struct(F.lit(rule.kind).alias("kind"), s.alias("s"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["got"], hit)).otherwise(acc["got"]).alias("got"))

    # runs of one class are matched from their first character, so the length can stand in the expression itself
    return F.aggregate(rows, start, step)["got"]


def _tight(rule: Rule) -> Rule:
    """The same matches by an expression that skips short ones; only for a literal followed by one run of a class that
    holds the literal's characters, where dropping a short match frees nothing."""
    if rule.kind == "hex":
        return rule._replace(pattern=rf"[0-9a-f]{{{rule.least},}}")
    if rule.kind == "access":
        return rule._replace(pattern=rf"AKIA[A-Z0-9]{{{rule.least - 4},}}")
    return rule


def postings(rows: DataFrame, rules=RULES) -> DataFrame:
    """trigram, row: the inverted index over the trigrams that the rules' queries name."""
    named = sorted({(r.fold, t) for r in rules for ors in trigram_query(r) for ways in ors for t in ways})
    lower = F.translate("text", _UPPER, _LOWER)
    parts = {"__low": lower} if any(f for f, _ in named) else {}
    has = [F.when(F.col("__low" if fold else "text").contains(t), F.lit(("i:" if fold else "c:") + t)) for fold, t in named]
    return rows.withColumns(parts).select("row", F.explode(F.array_compact(F.array(*has))).alias("trigram")) if has else rows.select("row", F.lit("").alias("trigram")).limit(0)


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """row, kinds: the rules whose trigram query the postings satisfy."""
    ways = [(r.kind, c, w, len(way), _name(r, t)) for r in rules for c, ors in enumerate(trigram_query(r)) for w, way in enumerate(ors) for t in way]
    clauses = {r.kind: len(trigram_query(r)) for r in rules}
    if not ways:
        return index.select("row", F.array().cast("array<string>").alias("kinds")).limit(0)
    # a few hundred rows that come from the rules alone
    query = F.broadcast(index.sparkSession.createDataFrame(ways, "kind string, clause int, way int, size int, trigram string"))
    held = index.join(query, "trigram").groupBy("row", "kind", "clause", "way", "size").agg(F.count("*").alias("n")).filter("n = size")
    met = held.groupBy("row", "kind").agg(F.count_distinct("clause").alias("met"))
    whole = F.create_map(*[x for k, n in clauses.items() for x in (F.lit(k), F.lit(n))])
    return met.filter(F.col("met") == whole[F.col("kind")]).groupBy("row").agg(F.collect_set("kind").alias("kinds"))  # as many as there are rules


BITS_EACH, MOST_BITS = 8, 1 << 28  #: of the candidates' bitmap: for each candidate, and at most (32 MB)
BUCKET = 1 << 15  #: bits in one row of the bitmap, as Spark's bitmap functions have it


def likely(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """The rows of narrow and few others (an eighth of the rest at most, unless the bitmap's bound is met): each candidate
    sets a bit of a bitmap that goes to every task, and other rows go before anything of them is dealt out."""
    count = narrow.count()
    bits = min(MOST_BITS, max(BUCKET, 1 << (BITS_EACH * count - 1).bit_length()))
    place = F.pmod(F.xxhash64("row"), F.lit(bits))
    bucket, bit = F.floor(place / BUCKET), place % BUCKET
    bitmap = narrow.groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = rows.withColumns({"__bucket": bucket, "__bit": bit}).join(F.broadcast(bitmap), "__bucket")  # MOST_BITS / 8 bytes at most
    return marked.where(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1).drop("__bucket", "__bit", "__bits")


def secret_scan(docs: DataFrame, rules=RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256, spans for every row of docs."""
    docs, number = with_rows(docs)
    rows = docs.select(F.col(number).alias("row"), F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    index = materialize(postings(rows, rules).sortWithinPartitions("trigram"), "secret-postings")
    narrow = materialize(candidates(index, rules), "secret-candidates")
    drop(index)
    full = [r for r in rules if not trigram_query(r)]
    scanned = {r.kind: spans(F.col("text"), _tight(r)) for r in full}
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")

    # the texts of candidates travel to their postings, with few others; the rest are scanned where they are read
    everyone = rows.select("row", "doc_id", *[c.alias(f"at_{k}") for k, c in scanned.items()])
    chosen = likely(rows.select("row", "text"), narrow).join(narrow, "row").select("row", *[F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), _tight(r))).otherwise(none).alias(f"at_{r.kind}") for r in rules if r not in full])
    both = everyone.join(chosen, "row", "left")
    for r in rules:
        both = both.withColumn(f"at_{r.kind}", F.coalesce(f"at_{r.kind}", none))

    order = {r.kind: i for i, r in enumerate(rules)}

    def text_of(kinds: list[Rule]) -> Column:
        place = F.create_map(*[x for r in kinds for x in (F.lit(r.kind), F.lit(order[r.kind]))])
        parts = F.transform(F.concat(*[F.col(f"at_{r.kind}") for r in kinds]), lambda x: F.struct(x["s"].alias("s"), place[x["kind"]].alias("o"), x["e"].alias("e"), x["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(parts), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    base = [r for r in rules if r.base]
    return both.select("doc_id", *[F.size(f"at_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base], F.sha2(text_of(base), 256).alias("base_sha256"), text_of(list(rules)).alias("spans"))
