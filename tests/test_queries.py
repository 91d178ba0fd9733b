"""Every query of the core against its SQL at the smallest scale."""

import pytest

from brindle import queries, upkeep, workload
from tests.conftest import DATA
from tests.oracle import check, no_pairs, plan_text

ALL = {**workload.QUERIES, **upkeep.QUERIES, **queries.queries()}
SQL = {**workload.SQL, **upkeep.SQL, **queries.oracle_sql()}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    check(spark, DATA, name, ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    assert ALL[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_approximate_distinct_is_near(spark):
    near = {r[0]: r["Distinct"] for r in ALL["distinct_approx"](spark, str(DATA)).collect()}
    exact = {r[0]: r["Distinct"] for r in ALL["distinct_by_group"](spark, str(DATA)).collect()}
    assert near.keys() == exact.keys()
    assert all(abs(near[k] - exact[k]) <= max(2, 0.05 * exact[k]) for k in exact)


def test_distinct_limit_gives_any_groups(spark):
    assert ALL["distinct_limit"](spark, str(DATA)).count() == 5


@pytest.mark.parametrize("name", sorted(set(ALL) - set(upkeep.QUERIES)))
def test_no_plan_builds_pairs(spark, name):
    no_pairs(ALL[name](spark, str(DATA)), name)


def test_scans_read_what_a_query_names(spark):
    text = plan_text(ALL["w11_avg_host_regex"](spark, str(DATA)))
    assert "ReadSchema: struct<host:string,ping:bigint>" in text
    text = plan_text(ALL["filter_int_gt_missing"](spark, str(DATA)))
    assert "GreaterThan(ping,40)" in text and "ReadSchema: struct<status:string,ping:bigint>" in text
