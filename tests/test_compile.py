import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import histogram
from brindle.plans import compile as plan
from brindle.plans.builder import Query
from brindle.plans.compile import compile_query, extents
from brindle.plans.spec import Filter, QuerySpec, Replace, SpecError
from brindle.results import to_json, to_text
from tests.conftest import rows
from tests.oracle import plan_text

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("age", T.LongType()), T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("w", T.LongType()), T.StructField("time", T.LongType())])
DATA = [
    (1, 10, "a", ["x", "y"], 2, 0),
    (2, 20, "a", ["x", "x"], None, 3599),
    (3, None, "b", [], 3, 3600),
    (4, 40, "", None, 1, -1),
    (5, 50, None, ["y"], 1, None),
    (6, -5, "b2", ["z"], 0, -3601),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(DATA, SCHEMA)


def ids(df, *filters):
    return [r["id"] for r in compile_query(QuerySpec(samples=True, sort="id", sort_asc=True, sample_cols=("id",), filters=filters), df).collect()]


@pytest.mark.parametrize(
    "f,want",
    [
        (("int", "age", "gt", 20), [4, 5]), (("int", "age", "lt", 20), [1, 6]), (("int", "age", "eq", 20), [2]), (("int", "age", "neq", 20), [1, 4, 5, 6]),
        (("str", "name", "eq", "a"), [1, 2]), (("str", "name", "neq", "a"), [3, 4, 6]), (("str", "name", "re", "^b"), [3, 6]), (("str", "name", "nre", "^b"), [1, 2, 4]), (("str", "name", "re", ""), [1, 2, 3, 4, 6]),
        (("set", "tags", "in", "x"), [1, 2]), (("set", "tags", "nin", "x"), [3, 5, 6]),
    ],
)
def test_missing_satisfies_no_filter(df, f, want):
    assert ids(df, Filter(*f)) == want


def test_two_patterns_on_one_column(df):
    assert ids(df, Filter("str", "name", "re", "b"), Filter("str", "name", "nre", "2")) == [3]


def test_missing_group_and_empty_group_are_one(df):
    got = rows(compile_query(QuerySpec(groups=("name",), ints=("age",)), df))
    assert got == [("", 45.0, 2, 2), ("a", 15.0, 2, 2), ("b", None, 1, 1), ("b2", -5.0, 1, 1)]


def test_weights_default_to_one(df):
    got = rows(compile_query(QuerySpec(groups=("name",), ints=("age",), weight_col="w"), df))
    assert got == [("", 45.0, 2, 2), ("a", 40 / 3, 3, 2), ("b", None, 3, 1), ("b2", None, 0, 1)]


def test_no_rows_no_result(df, spark):
    assert compile_query(QuerySpec(ints=("age",), filters=(Filter("int", "age", "gt", 99),)), df).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    for spec in (QuerySpec(ints=("age",)), QuerySpec(op="hist", ints=("age",)), QuerySpec(groups=("name",), op="distinct"), QuerySpec(groups=("name",), time=True), QuerySpec(samples=True)):
        assert compile_query(spec, empty).count() == 0


def test_order_limit_and_ties(df):
    spec = dict(groups=("name",), ints=("age",))
    first = lambda **k: [r["name"] for r in compile_query(QuerySpec(**spec, **k), df).collect()]
    assert first(limit=2) == ["", "a"]
    assert first(sort_asc=True) == ["b", "b2", "", "a"]
    assert first(sort="age") == ["", "a", "b2", "b"]
    assert first(sort="age", sort_asc=True, limit=1) == ["b2"]
    assert len(first(sort="", limit=1)) == 4


def test_time_buckets_cut_towards_zero(df):
    got = rows(compile_query(QuerySpec(time=True), df))
    assert sorted((r[0], r[1]) for r in got) == [(-3600, 1), (0, 3), (3600, 1)]


def test_time_series_of_the_top_groups(df):
    got = compile_query(QuerySpec(groups=("name",), time=True, limit=1), df)
    assert sorted((r["name"], r["time_bucket"], r["Count"]) for r in got.collect()) == [("a", 0, 2)]
    by_mean = compile_query(QuerySpec(groups=("name",), ints=("age",), time=True, limit=1, sort="age"), df)
    assert [r["name"] for r in by_mean.collect()] == [""]
    hist = compile_query(QuerySpec(op="hist", groups=("name",), ints=("age",), time=True, limit=1, sort="age"), df)
    assert [r["name"] for r in hist.collect()] == [""]


def test_distinct_counts_missing_as_a_value(df):
    assert rows(compile_query(QuerySpec(op="distinct", distincts=("name",), exact_distinct=True), df)) == [(4, 4)]
    assert rows(compile_query(QuerySpec(op="distinct", distincts=("name", "age")), df)) == [(6, 6)]


def test_replacement_before_filter_and_group(df):
    got = rows(compile_query(QuerySpec(groups=("name",), replaces=(Replace("name", "b2?", "$0!"),), filters=(Filter("str", "name", "re", "!$"),)), df))
    assert got == [("b!", 1, 1), ("b2!", 1, 1)]


def test_totals(df):
    got = compile_query(QuerySpec(groups=("name",), ints=("age",), totals=True, limit=1), df).collect()
    assert [(r["name"], r["Count"], r["is_total"]) for r in got] == [("", 2, False), ("", 6, True)]
    assert got[1]["age"] == 23.0


def test_clashing_group_name(spark):
    with pytest.raises(SpecError):
        compile_query(QuerySpec(groups=("Count",)), spark.createDataFrame([("a",)], "Count string"))


def test_columns_with_dots_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "`x.y` string, `v w` bigint, __w bigint")
    got = rows(compile_query(QuerySpec(groups=("x.y",), ints=("v w", "__w")), df))
    assert got == [("a", 1.0, 2.0, 1, 1), ("b", 3.0, 4.0, 1, 1)]


def test_sums_past_64_bits(spark):
    df = spark.createDataFrame([(2**62,)] * 8, "v bigint")
    assert compile_query(QuerySpec(ints=("v",)), df).first()["v"] == float(2**62)


def percentiles_of(values, low, high, int_bucket=0):
    width, n = histogram.layout(low, high, int_bucket)
    edges = sorted(min((v - low) // width, n - 1) * width + low for v in values)
    out = []
    for i in range(100):
        k = next(k for k in range(1, len(edges) + 1) if (edges[k - 1] != edges[k] if k < len(edges) else True) and 100 * k // len(edges) > i)
        out.append(edges[k - 1])
    return out


@pytest.mark.parametrize("size", [0, 1, 99, 100, 999, 1000, 1999, 250000])
def test_hist_is_the_brute_force_one(spark, size):
    rnd = random.Random(size)
    values = [rnd.randint(-50, size - 50) for _ in range(200)] + [-50, size - 50]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    h = compile_query(QuerySpec(op="hist", ints=("v",)), df).first()["v"]
    assert h["percentiles"] == percentiles_of(values, -50, size - 50)
    assert h["samples"] == 202 and h["sum"] == sum(values) and math.isclose(h["avg"], sum(values) / 202)
    assert sum(h["buckets"].values()) == 202
    width = histogram.layout(-50, size - 50)[0]
    if width * 1002 > size:
        assert abs(h["stddev"] - math.sqrt(sum((v - h["avg"]) ** 2 for v in values) / 202)) <= 2 * width + 1
    log = compile_query(QuerySpec(op="hist", loghist=True, ints=("v",)), df).first()["v"]
    assert len(log["percentiles"]) == 100 and log["percentiles"] == sorted(log["percentiles"])
    exact = sorted(values)
    assert all(exact[min((i + 1) * 202 // 100, 201)] >= p for i, p in enumerate(log["percentiles"]))


def test_hist_of_all_negative_and_of_no_values(spark):
    df = spark.createDataFrame([("a", -5), ("a", -50), ("b", None)], "g string, v bigint")
    got = {r["g"]: r["v"] for r in compile_query(QuerySpec(op="hist", groups=("g",), ints=("v",)), df).collect()}
    assert got["a"]["sum"] == -55 and got["a"]["buckets"] == {"-50": 1, "-5": 1} and got["b"] is None


def test_hist_of_the_whole_64_bit_range(spark):
    df = spark.createDataFrame([(-(2**63),), (0,), (2**63 - 1,)], "v bigint")
    h = compile_query(QuerySpec(op="hist", ints=("v",)), df).first()["v"]
    assert len(h["percentiles"]) == 100 and h["percentiles"][0] == -(2**63) and h["percentiles"][99] > 2**62


def test_two_hist_columns_with_weights(df):
    got = compile_query(QuerySpec(op="hist", groups=("name",), ints=("age", "id"), weight_col="w"), df)
    by = {r["name"]: r for r in got.collect()}
    assert by["a"]["Count"] == 3 and by["a"]["Samples"] == 2 and by["a"]["age"]["samples"] == 3 and by["a"]["age"]["sum"] == 40.0
    assert by["b"]["age"] is None and by["b"]["id"]["percentiles"] == [3] * 100


def test_merged_slices_are_the_whole(df):
    for spec in (QuerySpec(groups=("name",), ints=("age",)), QuerySpec(op="hist", groups=("name",), ints=("age", "id")), QuerySpec(op="distinct", distincts=("name",)), QuerySpec(op="distinct", distincts=("name",), exact_distinct=True), QuerySpec(time=True, ints=("age",))):
        ext = plan.extents(df, spec.ints)
        parts = [plan.state(spec, df.where(f"id % 3 = {k}"), ext) for k in range(3)]
        assert rows(plan.finish(spec, plan.merge(spec, *parts))) == rows(compile_query(spec, df)), spec


def test_pushdown_and_pruning(spark, tmp_path):
    spark.createDataFrame(DATA, SCHEMA).write.parquet(f"{tmp_path}/t")
    q = compile_query(QuerySpec(groups=("name",), filters=(Filter("int", "age", "gt", 20),)), spark.read.parquet(f"{tmp_path}/t"))
    text = q._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(age,20)" in text and "ReadSchema: struct<age:bigint,name:string>" in text


def test_builder(df):
    q = Query(df).group_by("name").aggregate("age").int_gt("age", 0).str_neq("name", "zz").set_nin("tags", "q").order_by("age").limit(5)
    assert [tuple(r) for r in q.run().collect()] == [("a", 15.0, 2, 2)]
    assert Query(df).log_hist("age").run().count() == 1
    assert Query(df).distinct("name", exact=True).run().first()["Distinct"] == 4
    assert len(Query(df).samples("id").limit(2).run().collect()) == 2


def test_rendering(df):
    spec = QuerySpec(op="hist", groups=("name",), ints=("age",))
    assert '"name": "b", ' in to_json(spec, compile_query(spec, df)) or '"age": {}' in to_json(spec, compile_query(spec, df))
    spec = QuerySpec(groups=("name",), ints=("age",), weight_col="w", totals=True)
    text = to_text(spec, compile_query(spec, df))
    assert text.splitlines()[0].split()[:3] == ["8", "(6)", "TOTAL"]
    spec = QuerySpec(time=True)
    assert to_json(spec, compile_query(spec, df)).startswith('{"-3600": [')


def test_quantile_sketches(spark):
    df = spark.range(10001).selectExpr("cast(id % 2 as string) g", "if(id % 100 = 7, null, id) v", "id w")
    spec = QuerySpec(op="hist", tdigest=True, groups=("g",), ints=("v", "w"))
    for got in (compile_query(spec, df), plan.finish(spec, plan.merge(spec, *[plan.state(spec, df.where(f"w % 3 = {k}")) for k in range(3)]))):
        for r in got.collect():
            assert all(abs(p - 100 * i) < 300 for i, p in enumerate(r["w"]["percentiles"])) and len(r["v"]["percentiles"]) == 100
            assert r["w"]["avg"] == 5000.0 and r["w"]["stddev"] == 0.0 and r["w"]["buckets"] == {}
    none = df.select("g", F.lit(None).cast("bigint").alias("v"), "w")
    assert [r["v"] for r in compile_query(spec, none).collect()] == [None, None]


def test_a_tab_in_a_value_does_not_make_tuples_equal(spark):
    df = spark.createDataFrame([("a\tb", "c"), ("a", "b\tc"), ("a", "b\tc"), (None, ""), ("", None)], "x string, y string")
    for exact in (True, False):
        got = compile_query(QuerySpec(op="distinct", distincts=("x", "y"), exact_distinct=exact), df).first()
        assert got["Distinct"] == 3


def test_distinct_limit_reads_no_further(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(0, 4_000_000, 1, 64).selectExpr("cast(id % 1000 as string) as g", "id")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = compile_query(QuerySpec(groups=("g",), distinct_limit=5), df.mapInArrow(count, df.schema))
    assert got.distinct().count() == 5 and seen.value < 400_000
    few = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "g string").repartition(4)
    assert sorted(r[0] for r in compile_query(QuerySpec(groups=("g",), distinct_limit=9), few).collect()) == ["", "a", "b"]
    assert compile_query(QuerySpec(groups=("g",), distinct_limit=9), few.limit(0)).count() == 0


def test_no_limit_plans_neither_sort_nor_single_partition(spark):
    df = spark.range(1000).selectExpr("cast(id % 7 as string) as g", "id as v", "id as time")
    for spec in (QuerySpec(groups=("g",), ints=("v",), limit=None), QuerySpec(groups=("g",), ints=("v",), op="hist", limit=None), QuerySpec(groups=("g",), time=True, limit=None), QuerySpec(groups=("g",), op="distinct", distincts=("v",), exact_distinct=True, limit=None)):
        text = plan_text(compile_query(spec, df))
        assert "SinglePartition" not in text and "rangepartitioning" not in text and "Limit" not in text
    text = plan_text(compile_query(QuerySpec(groups=("g",), ints=("v",), limit=3), df))
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in plan_text(compile_query(QuerySpec(samples=True, sort="", limit=3), df))


def test_extents_without_outliers(spark):
    df = spark.createDataFrame([(x,) for x in [*range(20, 980), None, -1, -1, 2147483647, 2147483647, 2147483647]], "v bigint")
    assert extents(df, ("v",)) == {"v": (-1, 2147483647)}
    assert extents(df, ("v",), True) == {"v": (20, 979)}
    assert extents(df.where("v > 1000000"), ("v",), True) == {"v": (2147483647, 2147483647)} and extents(df.limit(0), ("v",), True) == {"v": (0, 0)}
    h = compile_query(QuerySpec(op="hist", ints=("v",), skip_outliers=True), df).first()["v"]
    assert h["samples"] == 965 and len(set(h["percentiles"])) > 90 and sum(h["buckets"].values()) == 965


@pytest.mark.parametrize("kind", ["ints", "few", "skewed"])
def test_percentiles_are_within_one_of_the_sorted_data(spark, kind):
    """Spans below 1000 have buckets of width 1."""
    r = random.Random(3)
    values = {"ints": [r.randrange(900) for _ in range(300)], "few": [r.randrange(10, 30) for _ in range(300)], "skewed": [min(990, int(r.expovariate(0.01))) for _ in range(300)]}[kind]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    p = compile_query(QuerySpec(op="hist", ints=("v",)), df).first()["v"]["percentiles"]
    values.sort()
    width = max(1, (values[-1] - values[0]) // 100) if values[-1] - values[0] >= 100 else 1
    assert all(abs(p[i] - values[i * 3]) <= max(1, width) or values[i * 3] <= p[i] <= values[min(299, i * 3 + 3)] for i in range(100))
