import random

import pytest

from brindle.llm import percentiles as P
from tests.conftest import rows

SCHEMA = "host string, status string, ping bigint, load_no bigint, v string, n int, level string"
LEVELS = {"host": ["host"], "status": ["status"], "both": ["host", "status"]}
KEYS = ["host", "status"]


def brute(data, permille=P.PERMILLE):
    out = set()
    for level, own in LEVELS.items():
        groups = {}
        for h, s, p, *_ in data:
            if p is not None:
                groups.setdefault((h if "host" in own else None, s if "status" in own else None), []).append(p)
        for key, vals in groups.items():
            vals.sort()
            for pm in permille:
                v = vals[max(1, -(-pm * len(vals) // 1000)) - 1]
                out.add((level, *key, pm, len(vals), v))
    return out


def made(n, values, seed=0):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "a", "a", "b", "", None]), rnd.choice(["200", None, "x"]), rnd.choice([None, *values]), rnd.randrange(3), "x", 1, "y") for _ in range(n)]


def got(spark, data, **how):
    df = P.percentiles(spark.createDataFrame(data, SCHEMA), "ping", KEYS, LEVELS, **how)
    return {(r["level"], r["host"], r["status"], r["permille"], r["n"], r["value"]) for r in df.collect()}, df


@pytest.mark.parametrize("values", [[5], range(300), [-1, 2**31 - 1, *range(20, 40)], [-(2**63), -1, 0, 1, 2**63 - 1], [-(2**62), 2**62], [-7, -7, -3]])
def test_is_the_brute_force(spark, values):
    data = made(400, list(values))
    assert got(spark, data)[0] == brute(data)


@pytest.mark.parametrize("bits", [3, 16])
def test_any_number_of_halvings_a_pass(spark, bits):
    data = made(200, range(1000))
    assert got(spark, data, bits=bits)[0] == brute(data)


def test_empty_and_all_null(spark):
    assert got(spark, [])[0] == set()
    assert got(spark, [("a", "b", None, 1, "", 0, "")])[0] == set()


def test_one_group_with_most_rows_and_ties(spark):
    data = [("hot", "200", k % 7, 0, "", 0, "") for k in range(3000)] + made(100, range(5))
    assert got(spark, data)[0] == brute(data)


def test_partial_results_combine(spark):
    data = made(300, range(50))
    df = spark.createDataFrame(data, SCHEMA)
    parts = [P.value_counts(df.where(f"load_no = {k}"), "ping", KEYS, ["load_no"]) for k in range(3)]
    whole = P.from_counts(P.merge(*parts, keys=KEYS), KEYS, LEVELS)
    assert rows(whole) == rows(P.percentiles(df, "ping", KEYS, LEVELS))


def test_early_stop_bounds_the_value(spark):
    data = made(300, range(1000))
    exact = {k[:4]: k[5] for k in brute(data)}
    _, df = got(spark, data, stop_width=16)
    for r in df.collect():
        assert r["lower"] <= exact[r["level"], r["host"], r["status"], r["permille"]] <= r["upper"] and r["max_error"] < 16


def test_early_stop_at_the_end_of_the_domain(spark):
    data = [("a", "x", v, 0, "", 0, "") for v in (2**63 - 10, 2**63 - 1)]
    _, df = got(spark, data, stop_width=16)
    for r in df.collect():
        assert r["lower"] <= r["value"] and r["upper"] <= 2**63 - 1 and 0 <= r["max_error"] < 16


def test_intervals_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(P, "LIVE", 0)
    data = made(300, [-1, 2**31 - 1, *range(20, 40)])
    assert got(spark, data)[0] == brute(data)
