"""Every query of the catalog against its oracle."""

import pytest
from oracle import check, connect

from tidemark.plans.catalog import ORACLES, QUERIES

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    check(spark, sf, name, QUERIES[name], ORACLES[name], connect(sf))


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark).collect()
    assert found and [r.key for r in found] == sorted(r.key for r in found)
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_wal_crc(spark, sf):
    rows = QUERIES["wal_crc"](spark, sf)
    assert rows.where("not ok").count() == 0 and rows.count() == 1000


def test_early_tombstone_filter_is_wrong(spark, sf):
    """Dropping deletes before the newest version is known revives keys."""
    from tidemark.operators.state import latest
    from tidemark.sources.adapters import events_log

    log = events_log(spark, sf)
    assert latest(log.where("kind <> 1")).count() > QUERIES["latest_state"](spark, sf).count()
