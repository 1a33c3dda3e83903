"""URL filter: host and path rules first, then a character language-model ratio. DataFrame functions only.

Two smoothed variable-order Markov models over characters are counted, one from the URLs that a rule allows and one from
those that a rule blocks. A context of up to three characters is used in a model where that model saw it at least
``min_context`` times; otherwise the next shorter one decides. Counts are interpolated down to a uniform model. A URL
without a rule is judged by its log-likelihood difference divided by its length, against a threshold calibrated on
ruled pages that were kept out of the counts (a fifth, by id): the midpoint between the two classes' medians.

Characters fold to at most 40 symbols, so a model has at most 40**4 rows whatever the input: that is the bound of what
is broadcast. Log ratios are kept in millionths as integers, so sums do not depend on their order.

Defined results: a very long URL is read whole; longest rules fit first and no two have one length and fit one URL, so
there are no ties; a null URL, or one without ``://``, has empty host and path, meets no rule and is scored as its text
(null as empty); without pages of both classes every ratio is 0, the threshold is 0 and the verdict is allow; repeated
rows are judged each; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, with_rows

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
ORDER = 4  #: characters in a counted gram: three of context and one
SYMBOLS = 40  #: at most, after folding
ALPHA = 2.0  #: weight of the shorter context
MIN_CONTEXT = 4
SCALE = 1_000_000
CALIBRATION_FOLDS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("__url"))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule as host+path, and its action; null where none fits."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest]
    name = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, longest)], F.lit(None).cast("string"))
    action = F.coalesce(*[F.when(f, F.lit(a)) for f, (a, _, _) in zip(fits, longest)], F.lit(None).cast("string"))
    return name, action


def folded(url: Column) -> Column:
    """The URL in at most 40 symbols: letters, one for all digits, a few marks, ~ for the rest, ^ and $ at the ends."""
    plain = F.regexp_replace(F.translate(url, _UPPER, _LOWER), "[0-9]", "0")
    return F.concat(F.lit("^^^"), F.regexp_replace(plain, r"[^a-z0./:?=&#_%-]", "~"), F.lit("$"))


def grams(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(F.expr(f"transform(sequence(1, length(s) - {ORDER - 1}), i -> substring(s, i, {ORDER}))")).alias("g"))


def ratios(seen: DataFrame, min_context: int = MIN_CONTEXT, alpha: float = ALPHA) -> DataFrame:
    """g, llr for every gram of seen (g, a, r): the log of accepted over rejected probability of its last character."""
    total = seen.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("r"), F.lit(0)).alias("r")).first()
    if not total.a or not total.r:
        return seen.select("g", F.lit(0).cast("long").alias("llr"))
    out = seen.select("g").withColumns({f"p{c}": F.lit(1.0 / SYMBOLS) for c in "ar"})
    for k in range(1, ORDER + 1):
        gram, context = F.substring("g", ORDER - k + 1, k), F.substring("g", ORDER - k + 1, k - 1)
        sums = [F.sum("a").alias("a"), F.sum("r").alias("r")]
        out = out.withColumns({"x": gram, "y": context}).join(seen.groupBy(gram.alias("x")).agg(*sums), "x")
        if k > 1:
            out = out.join(seen.groupBy(context.alias("y")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr")), "y")
        else:
            out = out.withColumns({"ca": F.lit(total.a), "cr": F.lit(total.r)})
        step = {f"p{c}": F.when(F.col(f"c{c}") >= min_context, (F.col(c) + alpha * F.col(f"p{c}")) / (F.col(f"c{c}") + alpha)).otherwise(F.col(f"p{c}")) for c in "ar"}
        out = out.withColumns(step).select("g", "pa", "pr")
    return out.select("g", F.round(SCALE * (F.ln("pa") - F.ln("pr"))).cast("long").alias("llr"))


def medians(rows: DataFrame, step: int = 4096) -> dict[str, float]:
    """The exact median of v for each action. Counts of values go through two histograms, of steps and then of the values
    in the steps that hold the middle, so no task gathers one action's rows. rows: action, v (long)."""
    found = materialize(rows.groupBy("action", "v").agg(F.count("*").alias("n")), "url-ratios")
    low = F.floor(F.col("v") / step).cast("long").alias("low")
    # ratios lie within the log of the smallest probability, so there are some ten thousand steps at most
    coarse = found.groupBy("action", low).agg(F.sum("n").alias("n")).orderBy("action", "low").collect()
    out = {}
    for action in {r.action for r in coarse}:
        own, total = [r for r in coarse if r.action == action], sum(r.n for r in coarse if r.action == action)
        middle = [(total - 1) // 2, total // 2]  # places from 0
        values = []
        for place in middle:
            before = 0
            for r in own:
                if place < before + r.n:
                    break
                before += r.n
            for x in found.filter((F.col("action") == action) & (low == r.low)).groupBy("v").agg(F.sum("n").alias("n")).orderBy("v").collect():  # at most step rows
                before += x.n
                if place < before:
                    values.append(x.v)
                    break
        out[action] = sum(values) / 2
    return out


def url_filter(pages: DataFrame, rules=RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, ratio (millionths a character) for every row of pages."""
    pages, number = with_rows(pages)
    base = pages.select(F.col(number).alias("row"), F.col(key).alias("page_id"), F.col(url).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    base = base.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    held = F.coalesce(F.col("page_id") % CALIBRATION_FOLDS == 0, F.lit(False))
    base = base.withColumns({"rule": rule, "action": action, "s": folded(F.coalesce("__url", F.lit(""))), "held": held}).drop("__url")
    base = materialize(base, "url-pages")

    learn = lambda a: F.sum(F.when((F.col("action") == a) & ~F.col("held"), 1).otherwise(0))
    seen = materialize(grams(base, ["action", "held"]).groupBy("g").agg(learn("allow").alias("a"), learn("block").alias("r")), "url-grams")
    model = F.broadcast(ratios(seen))  # at most SYMBOLS ** ORDER rows
    sums = grams(base, ["row"]).join(model, "g").groupBy("row").agg(F.sum("llr").alias("llr"), F.count("*").alias("n"))
    scored = materialize(base.join(sums, "row").select("page_id", "host", "path", "rule", "action", "held", (F.col("llr") / F.col("n")).alias("ratio")), "url-scores")

    middles = medians(scored.filter("held and action is not null").select("action", F.round("ratio").cast("long").alias("v")))
    threshold = (middles["allow"] + middles["block"]) / 2 if len(middles) == 2 else 0.0
    verdict = F.coalesce("action", F.when(F.col("ratio") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")
