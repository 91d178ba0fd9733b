import pytest
from pyspark.sql import functions as F

from brindle.llm import cardinality as C
from tests.conftest import rows

KEYS = ["utc_day", "country"]
LEVELS = {"day": ["utc_day"], "country": ["country"], "both": KEYS}


@pytest.fixture(scope="module")
def df(spark):
    base = spark.range(60000).select((F.col("id") % 20000).cast("string").alias("s"), (F.col("id") % 3).alias("utc_day"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), (F.col("id") % 2).cast("string"))).alias("country"), F.lit("x").alias("reg"), F.lit(1).alias("rank"))
    return base.unionByName(base.limit(100)).unionByName(base.limit(50).withColumn("s", F.lit(None).cast("string")))


def exact(df):
    out = {}
    for level, own in LEVELS.items():
        for r in df.where("s is not null").groupBy(*own).agg(F.count_distinct("s").alias("k")).collect():
            out[level, r["utc_day"] if "utc_day" in own else None, r["country"] if "country" in own else None] = r["k"]
    return out


@pytest.mark.parametrize("p", [8, 12, 14])
def test_within_the_stated_error(df, p):
    want = exact(df)
    got = {(r["level"], r["utc_day"], r["country"]): r for r in C.distinct_counts(df, "s", KEYS, LEVELS, p).collect()}
    assert got.keys() == want.keys()
    errors = [abs(r["approx_distinct"] / want[k] - 1) / r["std_error"] for k, r in got.items()]
    assert max(errors) < 4 and sum(errors) / len(errors) < 1.5


def test_small_counts_are_near_exact(spark):
    for n in (1, 2, 10, 100, 1000):
        r = C.estimate(C.registers(spark.range(n).selectExpr("cast(id as string) s"), "s", []), []).first()
        assert abs(r["approx_distinct"] - n) <= max(0, 0.02 * n)


def test_all_registers_of_the_largest_rank(spark):
    full = spark.range(16).selectExpr("cast(id as int) reg", "cast(61 as tinyint) rank")
    assert C.estimate(full, [], 4).first()["approx_distinct"] > 10**15


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "s string, utc_day bigint, country string")
    assert C.distinct_counts(empty, "s", KEYS, LEVELS).count() == 0
    assert C.distinct_counts(spark.createDataFrame([(None, 1, "a")], "s string, utc_day bigint, country string"), "s", KEYS, LEVELS).count() == 0
    assert C.distinct_counts(spark.createDataFrame([("", None, None)], "s string, utc_day bigint, country string"), "s", KEYS, LEVELS).count() == 3


def test_merge_repeats_and_packing(df):
    whole = C.registers(df, "s", KEYS, 10)
    parts = [C.registers(df.where(f"pmod(hash(s), 3) = {k}"), "s", KEYS, 10) for k in range(3)]
    assert rows(C.merge(*parts, whole, keys=KEYS)) == rows(whole.select(*KEYS, "reg", "rank"))
    packed = C.pack(whole, KEYS, 10)
    assert all(len(r["packed"]) == 1024 for r in packed.collect())
    assert rows(C.unpack(packed, KEYS)) == rows(whole.select(*KEYS, "reg", "rank"))


def test_rank_is_leading_zeros_plus_one(spark):
    got = spark.createDataFrame([(0,), (1,), (2,), (3,), (2**49,), (2**50 - 1,)], "w bigint").select(C._rank(F.col("w"), 50)).collect()
    assert [r[0] for r in got] == [51, 50, 49, 49, 1, 1]
