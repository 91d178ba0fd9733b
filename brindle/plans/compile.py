"""A QuerySpec as a DataFrame.

Aggregation goes through a mergeable partial state: ``state`` is one grouped aggregate over the scan (so map-side
combined, with filters and columns pushed into it), ``merge`` adds states of slices, ``finish`` turns a state
into result columns. A plain query is ``finish(state)``; saved states of files, nodes or days give the same result.

Result columns: the groups as text (missing is ""), ``time_bucket`` in a time query, one column per int column
(``avg``: its mean; ``hist``: a struct of percentiles, buckets, stddev, avg, sum, samples), then ``Count`` (weighted)
and ``Samples``; a distinct query has ``Distinct`` and ``Count``, both the cardinality. A group named like one of these
columns is an error. No matching rows give no result rows, also without groups. Ties in the order are broken by the
groups (and the bucket), so every limit is deterministic; a query without a limit plans neither order nor limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import histogram
from brindle.functions.filters import predicate
from brindle.functions.text import replace_all
from brindle.plans.spec import COUNT, QuerySpec, SpecError

BUCKET = "time_bucket"
SLICE = "__slice"
RESERVED = {"Count", "Samples", "Distinct", BUCKET}
Extents = Mapping[str, tuple[int, int]]


def catalog_of(df: DataFrame) -> dict[str, str]:
    """int, str or set for the columns of a DataFrame in the three-type model; other columns are left out."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("bigint", "int", "smallint", "tinyint"):
            out[f.name] = "int"
        elif kind == "string":
            out[f.name] = "str"
        elif kind == "array<string>":
            out[f.name] = "set"
    return out


#: With skip_outliers, at most one value in so many is left out of the extents at each end.
OUTLIERS = 200


def extents(df: DataFrame, columns: tuple[str, ...], skip_outliers: bool = False) -> dict[str, tuple[int, int]]:
    """Least and greatest value of int columns over the whole table; (0, 0) for a column without values.

    skip_outliers: the values are counted by sign and number of digits (at most some 40 classes, in one pass);
    classes at either end that together hold at most one value in ``OUTLIERS`` don't widen the extents. Such
    values still count: in the histogram they are in its first or last bucket.
    """
    if not columns:
        return {}
    if not skip_outliers:
        row = df.agg(*[f(F.col(f"`{c}`").cast("bigint")).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("a", F.min), ("z", F.max))]).first()
        return {c: (row[f"a{k}"] or 0, row[f"z{k}"] or 0) for k, c in enumerate(columns)}
    out = {}
    for c in columns:
        v = F.col(f"`{c}`").cast("bigint")
        digits = F.length(v.cast("string"))
        size = F.when(v < 0, F.lit(1) - digits).otherwise(digits).alias("size")  # of -7, 7, 42: -1, 1, 2
        got = df.where(v.isNotNull()).groupBy(size).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("a"), F.max(v).alias("z")).orderBy("size").collect()
        total = sum(r["n"] for r in got)

        def inside(classes: list) -> list:
            cut = 0
            while classes and (cut + classes[0]["n"]) * OUTLIERS <= total:
                cut += classes[0]["n"]
                classes = classes[1:]
            return classes

        kept = inside(inside(got)[::-1])
        out[c] = (min(r["a"] for r in kept), max(r["z"] for r in kept)) if kept else (0, 0)
    return out


def matching(spec: QuerySpec, df: DataFrame) -> DataFrame:
    """The rows a query is about: replacements first, then the filters (ints, sets, strings)."""
    for r in spec.replaces:
        df = df.withColumn(r.column, replace_all(F.col(f"`{r.column}`"), r.pattern, r.replacement))
    for f in sorted(spec.filters, key=lambda f: ("int", "set", "str").index(f.kind)):
        df = df.where(predicate(f))
    return df.where(F.col(f"`{spec.time_col}`").isNotNull()) if spec.time else df


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def _item(spec: QuerySpec) -> Column:
    """What a distinct query counts: the tuple of its columns' texts; with several columns each text has its length before it, so no text can run into the next."""
    parts = [_text(c) for c in spec.distincts]
    return parts[0] if len(parts) == 1 else F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])


def _keys(spec: QuerySpec) -> list[str]:
    return [*spec.groups, *([BUCKET] if spec.time else [])]


def _q(names) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _halves(v: Column, w: Column) -> tuple[Column, Column]:
    """Weighted sums of the high and the low 32 bits of v: both stay in 64 bits where the sum of v would not."""
    return F.sum(F.shiftright(v, 32) * w), F.sum(v.bitwiseAND(F.lit(0xFFFFFFFF)) * w)


def _whole(hi: Column, lo: Column) -> Column:
    return hi.cast("double") * F.lit(float(1 << 32)) + lo.cast("double")


def state(spec: QuerySpec, df: DataFrame, ext: Extents | None = None, slices: tuple[str, ...] = ()) -> DataFrame:
    """The mergeable partial result of the rows of df. ext: extents of the int columns of a hist query, the same for all states that are merged.

    slices: columns that are further keys of the state, to keep the states of several slices of the rows apart."""
    if set(_keys(spec)) & (RESERVED - ({BUCKET} if spec.time else set())):
        raise SpecError(f"a group may not be named {sorted(RESERVED)}")
    rows = matching(spec, df)
    w = F.coalesce(F.col(f"`{spec.weight_col}`").cast("bigint"), F.lit(1)) if spec.weight_col else F.lit(1).cast("bigint")
    cols = [*[F.col(c) for c in slices], *[_text(g).alias(g) for g in spec.groups]]
    if spec.time:
        cols.append((F.call_function("div", F.col(f"`{spec.time_col}`").cast("bigint"), F.lit(spec.time_bucket)) * spec.time_bucket).alias(BUCKET))
    keys = _q([*slices, *_keys(spec)])
    n = [F.sum("__w").alias("__count"), F.count(F.lit(1)).alias("__samples")]
    if spec.op == "distinct":
        rows = rows.select(*cols, _item(spec).alias("__item"), w.alias("__w"))
        if spec.exact_distinct:
            return rows.groupBy(*keys, "__item").agg(*n)
        return rows.groupBy(*keys).agg(*n, F.hll_sketch_agg("__item", F.lit(14)).alias("__sketch"))
    ints = [F.col(f"`{c}`").cast("bigint").alias(f"__v{k}") for k, c in enumerate(spec.ints)]
    rows = rows.select(*cols, *ints, w.alias("__w"))
    if spec.op == "avg" or not spec.ints:
        sums = []
        for k in range(len(spec.ints)):
            v = F.col(f"__v{k}")
            hi, lo = _halves(v, F.col("__w"))
            sums += [hi.alias(f"__hi{k}"), lo.alias(f"__lo{k}"), F.sum(F.when(v.isNotNull(), F.col("__w"))).alias(f"__n{k}")]
        return rows.groupBy(*keys).agg(*n, *sums)
    if spec.tdigest:
        sums = []
        for k in range(len(spec.ints)):
            v = F.col(f"__v{k}")
            hi, lo = _halves(v, F.col("__w"))
            sums += [hi.alias(f"__hi{k}"), lo.alias(f"__lo{k}"), F.sum(F.when(v.isNotNull(), F.col("__w"))).alias(f"__n{k}"), F.kll_sketch_agg_bigint(v).alias(f"__kll{k}")]
        return rows.groupBy(*keys).agg(*n, *sums)
    if ext is None:
        raise SpecError("a hist query needs the extents of its int columns")
    entries = []
    for k, c in enumerate(spec.ints):
        make = histogram.log_edge if spec.loghist else histogram.edge
        edge = F.when(F.col(f"__v{k}").isNotNull(), make(F.col(f"__v{k}"), *ext[c], spec.int_bucket))
        entries.append(F.struct(F.lit(k).alias("k"), F.col(f"__v{k}").alias("v"), edge.alias("edge")))
    if len(entries) == 1:
        rows = rows.select(*keys, "__w", entries[0].alias("__e"))
    else:
        rows = rows.select(*keys, "__w", F.explode(F.array(*entries)).alias("__e"))
    rows = rows.select(*keys, "__w", F.col("__e.k").alias("__k"), F.col("__e.v").alias("__v"), F.col("__e.edge").alias("__edge"))
    hi, lo = _halves(F.col("__v"), F.col("__w"))
    return rows.groupBy(*keys, "__k", "__edge").agg(*n, hi.alias("__hi"), lo.alias("__lo"))


def _same_but(spec: QuerySpec, part: DataFrame) -> tuple[list[str], list[Column]]:
    """Key columns of a state and the aggregates that add it up."""
    keys = [c for c in part.columns if not c.startswith("__") or c in ("__k", "__edge", "__item")]
    how = lambda c: F.hll_union_agg(c) if c == "__sketch" else F.kll_merge_agg_bigint(c) if c.startswith("__kll") else F.sum(c)
    adds = [how(c).alias(c) for c in part.columns if c not in keys]
    return keys, adds


def merge(spec: QuerySpec, *parts: DataFrame) -> DataFrame:
    """Add up states of different slices of the rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    keys, adds = _same_but(spec, out)
    return out.groupBy(*_q(keys)).agg(*adds)


def rebucket(spec: QuerySpec, part: DataFrame, ext: Extents) -> DataFrame:
    """The state of a hist query with the bucket edges of other extents: each old edge falls into its new bucket.

    Counts, means and sums stay exact; percentiles move by at most one old bucket width.
    """
    make = histogram.log_edge if spec.loghist else histogram.edge
    edge = F.lit(None).cast("bigint")
    for k, c in enumerate(spec.ints):
        edge = F.when(F.col("__k") == k, make(F.col("__edge"), *ext[c], spec.int_bucket)).otherwise(edge)
    return merge(spec, part.withColumn("__edge", F.when(F.col("__edge").isNotNull(), edge)))


def _without(spec: QuerySpec, part: DataFrame, *names: str) -> DataFrame:
    """A state rolled up to fewer keys."""
    keys, adds = _same_but(spec, part)
    return part.groupBy(*_q([k for k in keys if k not in names])).agg(*adds)


def _hist_columns(spec: QuerySpec, part: DataFrame) -> DataFrame:
    """Counts, samples and one struct per int column. A group has at most some 1000 edges a column (10 times that for loghist)."""
    keys = _keys(spec)
    by = Window.partitionBy(*_q(keys), "__k")
    upto = by.orderBy("__edge").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valued = F.when(F.col("__edge").isNotNull(), F.col("__count")).otherwise(0)
    rows = part.withColumn("__n", valued).withColumn("__total", F.sum("__n").over(by)).withColumn("__cum", F.sum("__n").over(upto))
    rows = rows.withColumn("__mean", F.when(F.col("__total") != 0, _whole(F.sum("__hi").over(by), F.sum("__lo").over(by)) / F.col("__total")))
    # percentile i is the least edge with floor(100 * cum / total) > i: an edge gives as many of them as that floor rises
    rise = lambda c: F.call_function("div", c * 100, F.col("__total"))
    some = F.col("__edge").isNotNull() & (F.col("__total") > 0)
    rows = rows.withColumn("__times", F.when(some, rise(F.col("__cum")) - rise(F.col("__cum") - F.col("__n"))).otherwise(0).cast("int"))
    entry = F.struct("__edge", "__n", "__times")
    groups = rows.groupBy(*_q(keys), "__k").agg(
        F.sum("__count").alias("__count"),
        F.sum("__samples").alias("__samples"),
        F.sort_array(F.collect_list(F.when(some & (F.col("__n") > 0), entry))).alias("__list"),
        F.max("__mean").alias("__mean"),
        F.max("__total").alias("__total"),
        F.sum("__hi").alias("__hi"),
        F.sum("__lo").alias("__lo"),
        F.sum(F.when(some, F.col("__n") * F.pow(F.col("__edge") - F.col("__mean"), F.lit(2.0)))).alias("__squares"),
    )
    e = F.col("__list")
    hist = F.when(
        F.col("__total") > 0,
        F.struct(
            F.flatten(F.transform(e, lambda x: F.array_repeat(x["__edge"], x["__times"]))).alias("percentiles"),
            F.map_from_arrays(F.transform(e, lambda x: x["__edge"].cast("string")), F.transform(e, lambda x: x["__n"])).alias("buckets"),
            F.sqrt(F.col("__squares") / F.col("__total")).alias("stddev"),
            F.col("__mean").alias("avg"),
            _whole(F.col("__hi"), F.col("__lo")).alias("sum"),
            F.col("__total").alias("samples"),
        ),
    )
    groups = groups.select(*_q(keys), "__k", "__count", "__samples", hist.alias("__hist"))
    if len(spec.ints) == 1:
        return groups.withColumnsRenamed({"__hist": spec.ints[0]}).drop("__k")
    pick = [F.first(F.when(F.col("__k") == k, F.col("__hist")), ignorenulls=True).alias(c) for k, c in enumerate(spec.ints)]
    # every row of the table is in the state once per int column
    return groups.groupBy(*_q(keys)).agg(F.max("__count").alias("__count"), F.max("__samples").alias("__samples"), *pick)


def _sketch_columns(spec: QuerySpec, part: DataFrame) -> DataFrame:
    """The hist struct from quantile sketches: percentiles within the sketch's rank error (of unweighted rows), no buckets, stddev 0, exact mean and sum."""
    cols = []
    ranks = F.array(*[F.lit(i / 100) for i in range(100)])
    for k, c in enumerate(spec.ints):
        hi, lo, n = (F.col(f"__{x}{k}") for x in ("hi", "lo", "n"))
        parts = F.struct(
            F.kll_sketch_get_quantile_bigint(f"__kll{k}", ranks).alias("percentiles"),
            F.create_map().cast("map<string,bigint>").alias("buckets"),
            F.lit(0.0).alias("stddev"),
            (_whole(hi, lo) / n).alias("avg"),
            _whole(hi, lo).alias("sum"),
            n.alias("samples"),
        )
        cols.append(F.when(n > 0, parts).alias(c))
    return part.where("__samples > 0").select(*_q(_keys(spec)), *cols, "__count", "__samples")


def _values(spec: QuerySpec, part: DataFrame) -> DataFrame:
    """Result columns and, for ordering, ``__count``."""
    keys = _q(_keys(spec))
    if spec.op == "distinct":
        if spec.exact_distinct:
            part = part.groupBy(*keys).agg(F.sum("__count").alias("__count"), F.count(F.lit(1)).alias("Distinct"))
        else:
            part = part.withColumn("Distinct", F.hll_sketch_estimate("__sketch"))
        return part.where("Distinct > 0").select(*keys, "Distinct", F.col("Distinct").alias("Count"), "__count")
    if spec.op == "avg" or not spec.ints:
        means = [F.when(F.col(f"__n{k}") != 0, _whole(F.col(f"__hi{k}"), F.col(f"__lo{k}")) / F.col(f"__n{k}")).alias(c) for k, c in enumerate(spec.ints)]
        out = part.where("__samples > 0").select(*keys, *means, "__count", "__samples")
    else:
        out = _sketch_columns(spec, part) if spec.tdigest else _hist_columns(spec, part)
    return out.select(*keys, *_q(spec.ints), F.col("__count").alias("Count"), F.col("__samples").alias("Samples"), "__count")


def _rank(spec: QuerySpec, valued: DataFrame) -> list[Column]:
    """The order of groups; ties by the groups' text."""
    if spec.sort == "":
        return []
    if spec.sort == COUNT:
        by = F.col("__count")
    else:
        by = F.col(f"`{spec.sort}`.avg") if spec.op == "hist" and spec.ints else F.col(f"`{spec.sort}`")
    return [by.asc_nulls_last() if spec.sort_asc else by.desc_nulls_last(), *_q(spec.groups)]


def finish(spec: QuerySpec, part: DataFrame, limit: bool = True) -> DataFrame:
    """The result of a state, ordered and limited. A time query keeps the buckets of the top groups by their all-time rank."""
    if not spec.time:
        out = _values(spec, part)
        order = _rank(spec, out)
        if limit and spec.limit is not None and (order or spec.distinct_limit > 0):
            out = (out.orderBy(*order) if order else out).limit(spec.limit)
        out = out.drop("__count")
        if spec.totals:
            out = out.withColumn("is_total", F.lit(False)).unionByName(total(spec, part).withColumn("is_total", F.lit(True)))
        return out
    out = _values(spec, part)
    if limit and spec.limit is not None and spec.sort != "" and spec.groups:
        flat = QuerySpec(**{**spec.__dict__, "time": False})
        tops = _values(flat, _without(spec, part, BUCKET))
        tops = tops.orderBy(*_rank(spec, tops)).limit(spec.limit).select(*_q(spec.groups))
        out = out.join(tops, list(spec.groups), "left_semi")
    return out.drop("__count")


def total(spec: QuerySpec, part: DataFrame) -> DataFrame:
    """The grand total of a state as one row with empty groups; no row for an empty state."""
    flat = QuerySpec(**{**spec.__dict__, "time": False, "groups": (), "totals": False})
    out = _values(flat, _without(spec, part, *_keys(spec))).drop("__count")
    return out.select(*[F.lit("").alias(g) for g in spec.groups], *_q(out.columns))


def samples(spec: QuerySpec, df: DataFrame) -> DataFrame:
    """Matching rows as they are: the chosen columns (all by default), ordered by -sort, else newest first if there is a time column.

    With an empty -sort they are any rows, and the scan stops when it has them."""
    rows = matching(spec, df)
    catalog = catalog_of(rows)
    chosen = [*spec.sample_cols, *spec.ints, *spec.strs, *spec.sets] or list(catalog)
    order = []
    if spec.sort not in ("", COUNT):
        order = [F.col(f"`{spec.sort}`").asc_nulls_last() if spec.sort_asc else F.col(f"`{spec.sort}`").desc_nulls_last()]
    elif spec.sort != "" and spec.time_col in catalog:
        order = [F.col(f"`{spec.time_col}`").desc_nulls_last()]
    if order and spec.limit is not None:
        rows = rows.orderBy(*order)
    rows = rows.select(*_q(dict.fromkeys(chosen)))
    return rows if spec.limit is None else rows.limit(spec.limit)


def distinct_groups(spec: QuerySpec, df: DataFrame) -> DataFrame:
    """Any distinct_limit groups; the scan stops when it has them.

    Each partition gives its first distinct groups and reads no further once it has enough; the partitions are
    taken step by step, as Spark's take does it. Only if they repeat each other's groups is more asked for.
    This runs at once: what comes to the driver is at most distinct_limit groups a partition that was read.
    """
    n = spec.distinct_limit
    rows = matching(spec, df).select(*[_text(g).alias(g) for g in spec.groups])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            new = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row not in seen:
                    seen.add(row)
                    new.append(row)
                    if len(seen) >= n:
                        break
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*new)], names=batch.schema.names)
            if len(seen) >= n:
                return

    some, ask = rows.mapInArrow(first, rows.schema), n
    while True:
        got = some.limit(ask).collect()
        found = list(dict.fromkeys(tuple(r) for r in got))
        if len(found) >= n or len(got) < ask:
            return df.sparkSession.createDataFrame(found[:n], rows.schema)
        ask *= 4


#: Top groups of a time query up to which they are broadcast.
BROADCAST_GROUPS = 10_000


def _of_top_groups(spec: QuerySpec, df: DataFrame) -> tuple[QuerySpec, DataFrame]:
    """The matching rows of the top groups, and the spec that is left to do.

    Ranking groups needs one count (or mean) per group over all time; with that known, only the rows of at
    most ``limit`` groups are rolled up, instead of every group in every bucket.
    """
    rows = matching(spec, df)
    ranked = QuerySpec(groups=spec.groups, ints=() if spec.sort == COUNT else (spec.sort,), weight_col=spec.weight_col, sort=spec.sort, sort_asc=spec.sort_asc, limit=spec.limit)
    tops = finish(ranked, state(ranked, rows)).select(*[F.col(f"`{g}`").alias(f"__top{k}") for k, g in enumerate(spec.groups)])
    if spec.limit <= BROADCAST_GROUPS:
        tops = F.broadcast(tops)
    same = [_text(g) == F.col(f"__top{k}") for k, g in enumerate(spec.groups)]
    return QuerySpec(**{**spec.__dict__, "filters": (), "replaces": ()}), rows.join(tops, same, "left_semi")


def compile_query(spec: QuerySpec, df: DataFrame, ext: Extents | None = None, table_name: str | None = None, limit: bool = True) -> DataFrame:
    """The result of a spec on a table in the three-type model. Extents are those of the whole table, computed if not given."""
    spec = spec.for_table(table_name)
    spec.check(catalog_of(df))
    if spec.samples:
        return samples(spec, df)
    if spec.distinct_limit > 0 and spec.groups and not spec.ints and not spec.time and not spec.distincts:
        return distinct_groups(spec, df)
    if spec.op == "hist" and spec.ints and ext is None and not spec.tdigest:
        ext = extents(df, spec.ints, spec.skip_outliers)
    if spec.time and limit and spec.limit is not None and spec.sort != "" and spec.groups:
        spec, df = _of_top_groups(spec, df)
        return finish(spec, state(spec, df, ext), limit=False)
    return finish(spec, state(spec, df, ext), limit)
