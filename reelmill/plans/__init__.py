"""The driver's queries over the library's own operators, with their equivalents in DuckDB SQL."""

from __future__ import annotations


def all_queries() -> dict:
    """name -> (function of spark and sf_dir, SQL or None)."""
    from . import calendar, candidates, files, logs, media, posts, selection, streams, threads

    out: dict = {}
    for module in (candidates, selection, media, calendar, posts, logs, threads, streams, files):
        out |= module.QUERIES
    return out
