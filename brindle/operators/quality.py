"""Column-level data quality profile from maintained value-count tables.

What is kept is, per column and load, how often each value occurs. A load changes it by a signed delta
(``ValueCounts.change``): the counts of any set of loads are maintained without reading old rows, and a load
can be taken back. The counts are kept at a path, one part per load, so a change writes the parts of its
loads only, and another process goes on from there. Every metric is derived from counts exactly: null rate,
distinct values, least and greatest value, values out of form, entropy, and the distance between the
distributions of two loads.

All columns are counted in one scan with map-side combining, so a frequent value is one row per task, and the
plan is as small for thirty columns as for one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import stage
from brindle.sources.versions import Versions


@dataclass(frozen=True)
class Rule:
    """What a column's values should be. good: SQL over ``value`` (text), true if in form, None: not checked; bin: SQL giving the
    class whose shares are compared between loads (null: not compared), None: the default of ``shares``. kinds: findings to report."""

    good: str | None = None
    bin: str | None = None
    kinds: tuple[str, ...] = ()


def _text(df: DataFrame, column: str) -> Column:
    """A value as text: arrays, maps and structs as JSON, others by cast; null stays null."""
    kind = df.schema[column].dataType
    c = F.col(column)
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def deltas(df: DataFrame, table_name: str, columns: Sequence[str] | None = None, load_col: str = "load_no") -> DataFrame:
    """``table_name, column_name, load_no, numeric, value, n``: the value counts of each load of each column (all but the load column by default).

    Null is counted as a value, null, so rates have all rows below them; the empty string is a value; rows
    with a null load form a load of their own, null; repeated rows count each time. The load column itself
    may be among the columns. Values are compared by their text.
    """
    names = list(columns) if columns is not None else [x for x in df.columns if x != load_col]
    if not names:
        raise ValueError("no columns to profile")
    numeric = [isinstance(df.schema[c].dataType, T.NumericType) for c in names]
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(n).alias("numeric"), _text(df, c).alias("value")) for c, n in zip(names, numeric)])
    rows = df.select(F.col(load_col).cast("bigint").alias("load_no"), F.explode(entries).alias("e")).select("load_no", "e.*")
    counts = rows.groupBy("column_name", "load_no", "numeric", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.lit(table_name).alias("table_name"), "column_name", "load_no", "numeric", "value", "n")


def apply(counts: DataFrame, *changes: tuple[DataFrame, int], by_load: bool = False) -> DataFrame:
    """Maintained counts after signed deltas: (delta, +1) adds a load, (delta, -1) takes it back; values whose count becomes 0 vanish."""
    keys = ["table_name", "column_name", *(["load_no"] if by_load else []), "numeric", "value"]
    out = counts.select(*keys, "n")
    for d, sign in changes:
        out = out.unionByName(d.select(*keys, (F.col("n") * sign).alias("n")))
    return out.groupBy(*keys).agg(F.sum("n").alias("n")).where("n != 0")


class ValueCounts:
    """The value counts at a path, kept as versions with a part per table and load; opening the path again goes on from the current version."""

    SCHEMA = T.StructType().add("table_name", "string").add("column_name", "string").add("load_no", "long").add("numeric", "boolean").add("value", "string").add("n", "long")

    def __init__(self, spark: SparkSession, path: str, keep: int = 2) -> None:
        self.kept = Versions(spark, path, keep)

    def current(self, number: int | None = None) -> DataFrame:
        """The counts of a version, the current one by default."""
        return self.kept.read(self.kept.get(number)["parts"], self.SCHEMA)

    def change(self, delta: DataFrame, loads: Mapping[str, Sequence[int | None]], sign: int = 1, name: str | None = None) -> int:
        """Add the delta of some loads (sign 1) or take it back (-1); the number of the version that results.

        loads: the tables and their loads that delta has rows of (a null load too); other rows of it are an error of the caller.
        name: what the change is known by, so that one that is applied again after a failure counts once.
        """

        def how(old: dict) -> tuple[dict[str, str], dict] | None:
            done = old["facts"].get("done", [])
            if name is not None and name in done:
                return None
            mine = {f"{t}.{x}" for t, of in loads.items() for x in of}
            near = {k: p for k, p in old["parts"].items() if k in mine}
            new = apply(self.kept.read(near, self.SCHEMA), (delta, sign), by_load=True) if near else delta.withColumn("n", F.col("n") * sign)
            new = new.select(*self.SCHEMA.names, F.concat("table_name", F.lit("."), F.coalesce(F.col("load_no").cast("string"), F.lit("None"))).alias("part"))
            written = self.kept.write(new, "part")
            parts = {k: p for k, p in old["parts"].items() if k not in mine}
            return {**parts, **written}, {"done": [*done, name] if name is not None else done}

        return self.kept.change(how)["number"]


def _of(column: tuple[str, str]) -> Column:
    return (F.col("table_name") == column[0]) & (F.col("column_name") == column[1])


def _rules(rules: dict[tuple[str, str], Rule], pick: str, default: Column, kind: str) -> Column:
    """The rule of each row's column as one expression of type *kind*."""
    out = default
    for column, r in rules.items():
        if (sql := getattr(r, pick)) is not None:
            out = F.when(_of(column), F.expr(sql).cast(kind)).otherwise(out)
    return out


def _judged(counts: DataFrame, rules: dict[tuple[str, str], Rule]) -> DataFrame:
    """Counts with ``good``: the value is not null and in form (where no form is given: not null)."""
    return counts.withColumn("good", F.col("value").isNotNull() & F.coalesce(_rules(rules, "good", F.lit(True), "boolean"), F.lit(False)))


def metrics(counts: DataFrame, rules: dict[tuple[str, str], Rule], by: Sequence[str] = ("load_no",)) -> DataFrame:
    """One row per table, column and *by* with sums over the counts. ``n_bad`` is null where the column has no form to check.

    ``least`` and ``greatest`` are texts as stored: of numbers the least and greatest by value (integers of any size exactly), of others by code point.
    """
    value = F.col("value").isNotNull()
    # a double orders, and among integers that it can't tell apart the integer does
    place = F.when(F.col("numeric") & value, F.struct(F.expr("try_cast(value as double)").alias("d"), F.expr("try_cast(value as bigint)").alias("i"), "value"))
    checked = F.lit(False)
    for column, r in rules.items():
        if r.good is not None:
            checked = checked | _of(column)
    rows = _judged(counts, rules)
    n_bad = F.coalesce(F.sum(F.when(value & ~F.col("good"), F.col("n"))), F.lit(0))
    got = rows.groupBy("table_name", "column_name", *by, "numeric").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~value, F.col("n"))), F.lit(0)).alias("n_null"),
        F.when(F.bool_or(checked), n_bad).alias("n_bad"),
        F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("n_good"),
        F.count(F.when(value, 1)).alias("n_distinct"),
        F.coalesce(F.sum(F.when(value, F.col("n") * F.log2("n"))), F.lit(0.0)).alias("n_log_n"),
        F.min(place).alias("__low"), F.max(place).alias("__high"),
        F.min(F.when(~F.col("numeric"), F.col("value"))).alias("__first"), F.max(F.when(~F.col("numeric"), F.col("value"))).alias("__last"),
    )
    return got.withColumn("least", F.coalesce("__low.value", "__first")).withColumn("greatest", F.coalesce("__high.value", "__last")).drop("__low", "__high", "__first", "__last")


def profile(sums: DataFrame, by: Sequence[str] = ("load_no",)) -> DataFrame:
    """One row per table, column and *by*: rates, distinct values, range, values out of form, entropy in bits (of the non-null values)."""
    valued = F.col("n_rows") - F.col("n_null")
    return sums.select(
        "table_name", "column_name", *by, "n_rows", "n_null", (F.col("n_null") / F.col("n_rows")).alias("null_rate"), "n_distinct",
        "least", "greatest", "n_bad", F.when(valued > 0, F.col("n_bad") / valued).alias("bad_rate"), "n_good",
        F.when(valued > 0, F.greatest(F.lit(0.0), F.log2(valued) - F.col("n_log_n") / valued)).alias("entropy"),
    )


#: Width bins of a number column between its first load's extents without outliers, and the share (one value in so many) of outliers at an end.
BINS, OUTLIERS = 20, 200


def width_bins(counts: DataFrame, rules: dict[tuple[str, str], Rule], heads: DataFrame) -> DataFrame:
    """``table_name, column_name, lo, hi, w``: where a number column's bins begin and end, and their width, from the first load's good values.

    Values are counted by sign and number of digits (some 40 classes a column); classes at an end that hold at
    most one value in ``OUTLIERS`` are left out. One row per column; columns without whole numbers have none.
    """
    keys = ["table_name", "column_name"]
    rows = _judged(counts.where("numeric"), rules).where("good").join(F.broadcast(heads.select(*keys, F.col("first_load_no").alias("load_no")).distinct()), [*keys, "load_no"])
    digits, v = F.length("value"), F.expr("try_cast(value as bigint)")
    size = F.when(F.col("value").startswith("-"), F.lit(1) - digits).otherwise(digits)
    classes = rows.where(v.isNotNull()).groupBy(*keys, size.alias("size")).agg(F.sum("n").alias("n"), F.min(v).alias("a"), F.max(v).alias("z"))
    of = Window.partitionBy(*keys)
    up = F.sum("n").over(of.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    down = F.sum("n").over(of.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = classes.select(*keys, "a", "z", up.alias("up"), down.alias("down"), F.sum("n").over(of).alias("total")).where(f"up * {OUTLIERS} > total and down * {OUTLIERS} > total")
    width = F.expr(f"greatest(1, (cast(hi as decimal(20,0)) - lo) div {BINS} + 1)").cast("bigint").alias("w")
    return kept.groupBy(*keys).agg(F.min("a").alias("lo"), F.max("z").alias("hi")).select(*keys, "lo", "hi", width)


def shares(counts: DataFrame, rules: dict[tuple[str, str], Rule], heads: DataFrame, only_classes: bool = False) -> DataFrame:
    """``table_name, column_name, load_no, shared``: the sum over bins of the smaller of the load's and the first load's share.

    A column's bins are its rule's, else the values themselves of texts and ``width_bins`` of numbers
    (only_classes: columns without a rule's bins are left out). heads: one row per column and load with
    ``n_good, first_load_no, first_n_good``. A bin's counts meet in one row with an entry per load.
    """
    keys = ["table_name", "column_name"]
    rows = counts.where(F.col("load_no").isNotNull())
    default = F.lit(None).cast("string")
    if only_classes:
        own = F.lit(False)
        for column, r in rules.items():
            own = own | _of(column) if r.bin is not None else own
        rows = _judged(rows.where(own), rules)
    else:
        rows = _judged(rows, rules).join(F.broadcast(width_bins(counts, rules, heads)), keys, "left")
        v = F.expr("try_cast(value as bigint)")
        inside = F.expr("(try_cast(value as decimal(20,0)) - lo) div w").cast("string")
        number = F.when(v < F.col("lo"), F.lit("-1")).when(v > F.col("hi"), F.lit(str(BINS))).otherwise(inside)
        default = F.when(~F.col("numeric"), F.col("value")).when(F.col("lo").isNotNull(), number)
    rows = rows.where("good").withColumn("bin", _rules(rules, "bin", default, "string")).where("bin is not null")
    per = rows.groupBy(*keys, "bin", "load_no").agg(F.sum("n").alias("k"))
    bins = per.groupBy(*keys, "bin").agg(F.map_from_entries(F.collect_list(F.struct("load_no", "k"))).alias("loads"))
    first = F.broadcast(heads.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("load_no", "n_good"))).alias("goods"), F.first("first_load_no").alias("l1"), F.first("first_n_good").alias("g1")))
    bins = bins.join(first, keys).withColumn("k1", F.element_at("loads", F.col("l1"))).where("k1 is not null")
    each = bins.select(*keys, "k1", "g1", "goods", F.explode("loads").alias("load_no", "k"))
    return each.groupBy(*keys, "load_no").agg(F.sum(F.least(F.col("k") / F.element_at("goods", F.col("load_no")), F.col("k1") / F.col("g1"))).alias("shared"))


def compared(counts: DataFrame, rules: dict[tuple[str, str], Rule], only_classes: bool = False) -> DataFrame:
    """The profile of each load with the first load's (``first_*``) and ``drift``: half the sum of the absolute
    differences of the shares of bins among good values. Null where a side has no value to take a share of.

    counts is read several times and should be a written table.
    """
    keys = ["table_name", "column_name", "load_no"]
    loads = profile(stage(metrics(counts, rules), "quality")).where(F.col("load_no").isNotNull())
    first = Window.partitionBy("table_name", "column_name").orderBy("load_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in ("load_no", "null_rate", "bad_rate", "n_distinct", "n_good"):
        loads = loads.withColumn(f"first_{c}", F.first(c).over(first))
    heads = loads.select(*keys, "n_good", "first_load_no", "first_n_good")
    out = loads.join(F.broadcast(shares(counts, rules, heads, only_classes)), keys, "left")
    # 1 - sum of the smaller shares: bins that only one of the two has add nothing
    return out.withColumn("drift", F.when((F.col("n_good") > 0) & (F.col("first_n_good") > 0), F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce("shared", F.lit(0.0))))).drop("shared")


def findings(compared_loads: DataFrame, rules: dict[tuple[str, str], Rule], null_rise: float = 0.08, bad_rise: float = 0.05, drift: float = 0.25, distinct_part: float = 0.5) -> DataFrame:
    """``table_name, column_name, load_no, kind`` of the loads that differ from the first one by the limits, for the kinds that a column's rule names."""
    eps = 1e-12  # the shares are quotients: a difference of exactly the limit counts
    tests = {
        "null_rate": F.col("null_rate") - F.col("first_null_rate") >= null_rise - eps,
        "pattern": F.col("bad_rate") - F.col("first_bad_rate") >= bad_rise - eps,
        "range": F.col("bad_rate") - F.col("first_bad_rate") >= bad_rise - eps,
        "distribution": F.col("drift") >= drift - eps,
        "distinct": F.col("n_distinct") < F.lit(distinct_part) * F.col("first_n_distinct"),
    }
    wanted = {k: F.lit(False) for k in tests}
    for (table, column), r in rules.items():
        for k in r.kinds:
            wanted[k] = wanted[k] | ((F.col("table_name") == table) & (F.col("column_name") == column))
    kinds = F.array_compact(F.array(*[F.when(wanted[k] & tests[k], F.lit(k)) for k in tests]))
    return compared_loads.where("load_no != first_load_no").select("table_name", "column_name", "load_no", F.explode(kinds).alias("kind"))
