"""Caption cards, emphasis windows and sample times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import corrected


def caption_cards(words: DataFrame, keys: list[str], group: int = 4, corrections: Sequence[tuple[str, str]] = (), upper: bool = False) -> DataFrame:
    """Words in groups by position, blanks dropped after grouping: card, first start, last end, text. Corrections come
    before upper case."""
    word = F.struct("pos", "w", "rel_start_ms", "rel_end_ms")
    return cards_of(words.groupBy(*keys).agg(F.array_sort(F.collect_list(word)).alias("words")), keys, group, corrections, upper)


def cards_of(clips: DataFrame, keys: list[str], group: int = 4, corrections: Sequence[tuple[str, str]] = (), upper: bool = False) -> DataFrame:
    """caption_cards() of clips that hold their words in order."""
    said = lambda i: F.filter(F.slice("words", (i * group + 1).cast("int"), group), lambda x: F.coalesce(x["w"], F.lit("")) != "")
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.ceil(F.size("words") / group).cast("int") - 1))
    cards = F.transform(places, lambda i: F.struct(i.cast("long").alias("card"), said(i).alias("said")))
    each = clips.select(*keys, F.explode(cards).alias("c")).select(*keys, "c.*").where(F.size("said") > 0)
    text = corrected(F.trim(F.array_join("said.w", " ")), corrections)
    return each.select(*keys, "card", F.col("said")[0]["rel_start_ms"].alias("start_ms"), F.element_at("said", -1)["rel_end_ms"].alias("end_ms"), (F.upper(text) if upper else text).alias("text"))


def emphasis_windows(peaks_ms: Column, duration_ms: Column) -> Column:
    """The first three peaks inside the clip, from 0.3 s before to 1.8 s after, kept within it."""
    latest = F.greatest(F.lit(0), duration_ms - 500)
    good = F.filter(F.slice(peaks_ms, 1, 3), lambda t: t.isNotNull() & (t >= 0) & (t <= latest))
    return F.transform(good, lambda t: F.struct(F.greatest(F.lit(0).cast("long"), t - 300).alias("from_ms"), F.least(duration_ms, t + 1800).alias("to_ms")))


def sample_times(duration_ms: Column, every_ms: int = 4000, cap: int = 8) -> Column:
    """50 ms, every four seconds, and 0.2 s before the end: at most cap of them."""
    d = F.greatest(F.lit(200).cast("long"), duration_ms)
    inner = F.filter(F.transform(F.sequence(F.lit(1), F.lit(cap - 2)), lambda k: (k * every_ms).cast("long")), lambda t: t < d - 200)
    return F.concat(F.array(F.lit(50).cast("long")), inner, F.array(F.greatest(F.lit(100).cast("long"), d - 200)))
