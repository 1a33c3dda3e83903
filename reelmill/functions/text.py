"""Text, time and identifier helpers as Columns; all of them stay inside the JVM's generated code where Spark can."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a segment begins that depends on what came before it.
DEPENDENT_OPENERS = "and|but|so|because|then|which|that's why|like i said|as i mentioned|going back|anyway|also|plus|or |too\\b|again\\b"
SENTENCE_END = r"""[.!?]["')\]]?\s*$"""


def collapsed(text: Column) -> Column:
    """White space squeezed to single spaces, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def word_count(text: Column) -> Column:
    clean = collapsed(text)
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " "))).cast("long")


def self_contained(text: Column, strict: bool = False) -> Column:
    """Whether the opener stands alone. strict adds a word boundary, so that "Some" is not taken for "So"."""
    openers = "|".join(x if x.endswith(("\\b", " ")) else x + "\\b" for x in DEPENDENT_OPENERS.split("|")) if strict else DEPENDENT_OPENERS
    return ~F.lower(F.ltrim(text)).rlike(f"^({openers})")


def complete_thought(text: Column) -> Column:
    return text.rlike(SENTENCE_END)


def has_any(text: Column, cues: Sequence[str]) -> Column:
    """Whether any cue occurs, as part of a word too."""
    low = F.lower(text)
    out = F.lit(False)
    for cue in cues:
        out = out | low.contains(cue)
    return out


def stamp(ms: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(ms / 1000).cast("long")
    h, m, sec = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, sec)).otherwise(F.format_string("%d:%02d", m, sec))


def cue_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of a subtitle file."""
    x = F.greatest(F.lit(0), ms).cast("long")
    s = F.floor(x / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60, x % 1000)


def corrected(text: Column, corrections: Sequence[tuple[str, str]]) -> Column:
    """Whole-word corrections, one after another, in either case; a later one sees what an earlier one wrote."""
    for wrong, right in corrections:
        if wrong:
            quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in wrong)
            text = F.regexp_replace(text, rf"(?i)\b{quoted}\b", right.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def safe_filename(name: Column, most: int = 120) -> Column:
    base = F.regexp_extract(F.coalesce(name, F.lit("video")), r"([^/\\]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.substring(F.when(clean == "", "video").otherwise(clean), 1, most)


def content_key(name: Column, size: Column, mtime_s: Column) -> Column:
    """Twenty hex digits that name one version of a file."""
    return F.substring(F.sha2(F.concat_ws("|", name, size.cast("string"), mtime_s.cast("string")), 256), 1, 20)


def joined_nonblank(parts: Sequence[Column], sep: str) -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(F.trim(p), F.lit("")) for p in parts]), lambda x: x != ""), sep)


def post_text(caption: Column, call_to_action: Column, hashtags: Column) -> Column:
    """Caption, call to action and tags with blank lines between, blanks left out."""
    tags = F.array_join(F.transform(hashtags, lambda t: F.concat(F.lit("#"), F.regexp_replace(t, "^#+", ""))), " ")
    return joined_nonblank([caption, call_to_action, tags], "\n\n")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def mentions(text: Column, words: str) -> Column:
    """Whether any of the words (an alternation) occurs whole, in either case."""
    return text.rlike(rf"(?i)\b({words})\b")


def unfenced(text: Column) -> Column:
    """A reply without the code fence around it."""
    t = F.trim(text)
    body = F.regexp_extract(t, r"(?s)\A`{3}[a-zA-Z]*\s*(.*?)\s*(?:`{3})?\Z", 1)
    return F.when(t.startswith("```"), body).otherwise(t)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def bucket(x: Column, width: float) -> Column:
    return F.floor(x / width).cast("long")


def shortened(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def age_hours(now: Column, then: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(then)) / 3600.0
