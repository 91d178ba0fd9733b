import math

from brindle.operators import quality
from brindle.queries import RULES
from tests.conftest import rows

SCHEMA = "load_no bigint, status string, age bigint, groups array<string>, n string, value string"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def loads(good, bad):
    return [(1, *good, "x", "y")] * 20 + [(2, *bad, "x", "y")] * 20


def kinds(spark, data, table="host_generator", columns=("status",)):
    counts = quality.deltas(frame(spark, data), table, columns)
    return {(r["column_name"], r["kind"]) for r in quality.findings(quality.compared(counts, RULES), RULES).collect()}


def test_profile_of_every_column(spark):
    data = [(1, "200", 5, ["a"], "1", None), (1, None, None, [], "", None), (1, "x", -3, ["a"], "1", None), (None, "200", 7, None, "2", None)]
    got = {(r["column_name"], r["load_no"]): r for r in quality.profile(quality.metrics(quality.deltas(frame(spark, data), "host_generator"), RULES)).collect()}
    s = got["status", 1]
    assert (s["n_rows"], s["n_null"], s["n_bad"], s["n_distinct"], s["least"]) == (3, 1, 1, 2, "200") and math.isclose(s["entropy"], 1.0)
    assert (got["age", 1]["least"], got["age", 1]["greatest"]) == ("-3", "5")
    assert got["groups", 1]["n_distinct"] == 2 and got["value", 1]["bad_rate"] is None and got["value", 1]["entropy"] is None
    assert got["status", None]["n_rows"] == 1
    assert got["value", 1]["n_bad"] is None and got["status", 1]["n_bad"] == 1  # null: no form to check


def test_findings(spark):
    same = ("200", 30, None)
    assert kinds(spark, loads(same, same)) == set()
    assert kinds(spark, loads(same, (None, 30, None))) == {("status", "null_rate")}  # no value to take a share of
    assert kinds(spark, loads(same, ("20", 30, None))) == {("status", "pattern")}
    assert kinds(spark, loads(same, ("404", 30, None))) == {("status", "distribution")}
    assert kinds(spark, loads(same, ("200", 121, None)), "people_generator", ("age",)) == {("age", "range")}
    assert kinds(spark, loads(same, ("200", 45, None)), "people_generator", ("age",)) == {("age", "distribution")}
    data = [(1, "200", 1, None, "", "")] * 100 + [(2, "200", 1, None, "", "")] * 92 + [(2, None, 1, None, "", "")] * 8
    assert kinds(spark, data) == {("status", "null_rate")}  # a difference of exactly the limit counts


def test_city_form(spark):
    values = ["Ålholt", "Saint-Mer", "O'Neil St.", "Ñuñoa", "Ωmega"], ["x", "", " A", "A1", "A\n", "Ａ1", "É"[:1].lower()]
    data = [(1, v, 0, None, "", "") for v in values[0]] + [(2, v, 0, None, "", "") for v in values[1]]
    df = frame(spark, data).select("load_no", "status").toDF("load_no", "city")
    got = {r["load_no"]: r["n_bad"] for r in quality.profile(quality.metrics(quality.deltas(df, "people_generator", ["city"]), RULES)).collect()}
    assert got == {1: 0, 2: 7}


def test_distinct_falls(spark):
    data = [(1, f"C{chr(97 + k)}", 0, None, "", "") for k in range(10)] + [(2, f"C{chr(97 + k)}", 0, None, "", "") for k in range(4)] + [(3, f"C{chr(97 + k)}", 0, None, "", "") for k in range(5)]
    df = frame(spark, data).select("load_no", "status").toDF("load_no", "city")
    counts = quality.deltas(df, "people_generator", ["city"])
    got = quality.findings(quality.compared(counts, RULES), RULES)
    assert rows(got.where("kind = 'distinct'")) == [("people_generator", "city", 2, "distinct")]


def test_signed_deltas(spark):
    a = quality.deltas(frame(spark, [(1, "200", 1, None, "", ""), (1, None, 1, None, "", "")]), "t", ["status"])
    b = quality.deltas(frame(spark, [(2, "200", 1, None, "", "")] * 3), "t", ["status"])
    both = quality.apply(a, (b, 1))
    assert rows(both.select("value", "n")) == [(None, 1), ("200", 4)]
    assert rows(quality.apply(both, (a, -1)).select("value", "n")) == [("200", 3)]


def test_kept_versions(spark, tmp_path):
    kept = quality.ValueCounts(spark, str(tmp_path))
    a = quality.deltas(frame(spark, [(1, "200", 1, None, "", ""), (2, "404", 1, None, "", ""), (None, "500", 1, None, "", "")]), "t", ["status"])
    late = quality.deltas(frame(spark, [(2, "404", 1, None, "", "")] * 2), "t", ["status"])
    seen = lambda q: rows(q.current().select("load_no", "value", "n"))
    assert kept.change(a, {"t": [1, 2, None]}, name="first") == 1 and kept.change(a, {"t": [1, 2, None]}, name="first") == 1
    assert seen(kept) == [(None, "500", 1), (1, "200", 1), (2, "404", 1)]
    before = kept.kept.get()["parts"]
    again = quality.ValueCounts(spark, str(tmp_path))  # opened again
    again.change(late, {"t": [2]})
    assert seen(again) == [(None, "500", 1), (1, "200", 1), (2, "404", 3)]
    after = again.kept.get()["parts"]
    assert {k for k in before if before[k] != after[k]} == {"t.2"}  # only the load's part is written
    again.change(a, {"t": [1, 2, None]}, -1)
    assert seen(kept) == [(2, "404", 2)]
    other = quality.deltas(frame(spark, [(2, "404", 1, None, "", "")]), "u", ["status"])
    kept.change(other, {"u": [2]})
    assert rows(kept.current().select("table_name", "n")) == [("t", 2), ("u", 1)]


def test_ranges_of_big_integers_are_exact(spark):
    df = spark.createDataFrame([(1, 2**53 + 1, 0.5), (1, 5, -1e30), (1, 2**53, None), (1, -(2**63), 2.5)], "load_no bigint, i bigint, f double")
    got = {r["column_name"]: (r["least"], r["greatest"]) for r in quality.profile(quality.metrics(quality.deltas(df, "t"), {})).collect()}
    assert got == {"i": (str(-(2**63)), str(2**53 + 1)), "f": ("-1.0E30", "2.5")}


def test_empty_and_one_load(spark):
    empty = frame(spark, [])
    counts = quality.deltas(empty, "t")
    assert quality.profile(quality.metrics(counts, RULES)).count() == 0
    assert quality.findings(quality.compared(counts, RULES), RULES).count() == 0
    assert kinds(spark, [(1, "200", 3, None, "", "")]) == set()


def test_drift_sees_values_of_equal_length(spark):
    data = [(1, "Aaaa", k, None, "", "") for k in range(10, 20)] + [(2, "Bbbb", 19 - k % 2, None, "", "") for k in range(10)] + [(3, "Aaaa", k, None, "", "") for k in range(10, 20)]
    df = frame(spark, data).selectExpr("load_no", "status as country", "age as ping")
    got = {(r["column_name"], r["load_no"]): r["drift"] for r in quality.compared(quality.deltas(df, "t"), RULES).collect()}
    want = {("country", 1): 0.0, ("country", 2): 1.0, ("country", 3): 0.0, ("ping", 1): 0.0, ("ping", 2): 0.8, ("ping", 3): 0.0}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
