from collections import Counter

import pytest

from brindle.llm import frequent as Q
from tests.conftest import rows

SCHEMA = "city string, company string, value string, n bigint, h bigint, field string"


def made(n_rare=3000):
    out = [("Top", None, "", 0, 0, "")] * 900 + [("", "A", "", 0, 0, "")] * 100 + [(None, "B", "", 0, 0, "")] * 60
    out += [(f"rare{k}", f"r{k // 2}", "", 0, 0, "") for k in range(n_rare)]
    return out + [("Edge", "x" * 5000, "", 0, 0, "")] * 41 + [("just below", "r", "", 0, 0, "")] * 40


def brute(data, share=0.01):
    out = []
    for k, f in enumerate(("city", "company")):
        out += [(f, v, n) for v, n in Counter(r[k] for r in data).items() if v is not None and n >= share * len(data)]
    return sorted(out)


@pytest.mark.parametrize("width,tables", [(None, 5), (1024, 3)])
def test_is_the_brute_force(spark, width, tables):
    data = made()
    data = data + [("Edge", None, "", 0, 0, "")] * (4141 - len(data))
    assert len(data) == 4141
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = Q.frequent(df, ["city", "company"], width=width, tables=tables)
    assert sorted(tuple(r) for r in got.select("field", "value", "n").collect()) == brute(data)
    assert all(r["approx_count"] >= r["n"] and r["n_rows"] == 4141 for r in got.collect())


def test_share_of_exactly_the_limit(spark):
    data = [("a", "c", "", 0, 0, "")] * 5 + [(f"x{k}", "c", "", 0, 0, "") for k in range(495)]
    got = Q.frequent(spark.createDataFrame(data, SCHEMA), ["city", "company"])
    assert sorted((r["field"], r["value"], r["n"]) for r in got.collect()) == [("city", "a", 5), ("company", "c", 500)]


def test_empty_and_all_null(spark):
    assert Q.frequent(spark.createDataFrame([], SCHEMA), ["city"]).count() == 0
    assert Q.frequent(spark.createDataFrame([(None, None, "", 0, 0, "")] * 3, SCHEMA), ["city"]).count() == 0


def test_sketches_add_up(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    parts = [Q.sketch(df.where(f"pmod(hash(city), 3) = {k}"), ["city"]) for k in range(3)] + [Q.sketch(df.where("city is null"), ["city"])]
    assert rows(Q.merge(*parts)) == rows(Q.sketch(df, ["city"]))


def test_values_that_share_a_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(Q, "_hash", lambda c: F.length(c).cast("bigint"))
    data = [("aa", "", "", 0, 0, "")] * 60 + [("bb", "", "", 0, 0, "")] * 39 + [("c", "", "", 0, 0, "")]
    got = Q.frequent(spark.createDataFrame(data, SCHEMA), ["city"])
    assert sorted((r["value"], r["n"]) for r in got.collect()) == [("aa", 60), ("bb", 39), ("c", 1)]


def test_values_that_collide_in_every_table_are_found_with_a_wider_sketch(spark):
    data = [(v, "", "", 0, 0, "") for v, n in (("a", 40), ("b", 30), ("c", 30), ("d", 25), ("e", 25)) for _ in range(n)]
    got = Q.frequent(spark.createDataFrame(data, SCHEMA), ["city"], width=2, tables=1)
    assert sorted((r["value"], r["n"]) for r in got.collect()) == [("a", 40), ("b", 30), ("c", 30), ("d", 25), ("e", 25)]
