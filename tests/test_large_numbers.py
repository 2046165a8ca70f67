"""Queries over event numbers that only large tables have."""

import duckdb
import pytest
from test_engine import rows

from netglean.plans import catalog


@pytest.fixture
def late_events(spark, tmp_path):
    """Events of a few flows: the first two of each, and some after those at which a falling clock's made timestamps pass 0."""
    duckdb.sql(f"copy (select n * 97 + flow as event_id from (values (3), (7), (17)) t(flow), (select range as n from range(2) union all select range from range(16600, 16900)) order by 1) to '{tmp_path}/events.parquet' (format parquet)")
    return str(tmp_path)


def equal(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"create view events as from '{sf}/events.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    names = sorted(got.columns)
    have = got.select(*names).collect()
    assert have and rows(map(tuple, have)) == rows(con.sql(catalog.sql()[name]).project(",".join(f'"{n}"' for n in names)).fetchall())
    return have


def test_uptime_anchor_fold(spark, late_events):
    assert any(r.hours < 0 for r in equal(spark, late_events, "uptime_anchor_fold"))


def test_uptime_by_answers(spark, late_events):
    assert any(r.minutes < 0 for r in equal(spark, late_events, "uptime_by_answers"))


def test_uptime_by_answers_of_flows_without_beginnings(spark, tmp_path):
    """Flow 3 lacks its first answer, 17 its SYN, 30 both; 40 has its SYN twice; 7 is whole."""
    duckdb.sql(f"copy (select n * 97 + flow as event_id from (values (3), (7), (17), (30), (40)) t(flow), range(200) r(n) where not (flow in (3, 30) and n = 1 or flow in (17, 30) and n = 0) union all select 40) to '{tmp_path}/events.parquet' (format parquet)")
    assert {r.flow for r in equal(spark, str(tmp_path), "uptime_by_answers")} == {7, 40}
