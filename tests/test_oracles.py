"""Every query of the library's own operators against DuckDB, at the smallest scale."""

import pytest

from reelmill import plans

from .oracle import assert_same

SF = "/root/testdata/sf0.001"
QUERIES = plans.all_queries()


@pytest.mark.parametrize("name", [k for k, (_, sql) in QUERIES.items() if sql])
def test_same_as_sql(spark, name):
    fn, sql = QUERIES[name]
    assert_same(spark, fn, sql, SF)


def test_deck_keeps_like_clips_apart(spark):
    rows = QUERIES["deck"][0](spark, SF).orderBy("channel", "place").collect()
    again = QUERIES["deck"][0](spark, SF).repartition(7).orderBy("channel", "place").collect()
    assert rows == again
    channels = {}
    for r in rows:
        channels.setdefault(r.channel, []).append((r.topic, r.stretch))
    assert all(a != b for deck in channels.values() if len(set(deck)) > 1 for a, b in zip(deck[: 2 * len(set(deck))], deck[1 : len(set(deck))]))
