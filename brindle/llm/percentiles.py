"""Exact percentiles per group by bisection over mergeable counts.

A partial result is a table of ``(slice, keys, value, n)``: how often each value occurs per group, kept per
load or per day. Partial results combine by adding ``n`` and nothing else, so percentiles of any union of
slices are those of the whole, with error 0.

Bisection: every group and percentile owns an interval of the value domain, at first the whole of it. A
pass joins the counts to the intervals that are live, counts the rows of each of the ``2**bits`` equal parts
of an interval, that is the rows below ``2**bits - 1`` midpoints, ``bits`` halvings at once, and keeps the
part that holds the target rank. An interval with at most ``2**bits`` different values is resolved by one
last pass over these values, since midpoints between them tell all of them apart. Counts outside every live
interval are dropped by the join before anything is shuffled. The live intervals (one row per group and
interval) are broadcast while they are at most ``LIVE`` rows, counted before; beyond that both sides are
shuffled by interval. No group is ever gathered: every shuffle key contains the part of the domain, and a
task sorts at most ``2**bits`` parts or values of an interval, so a group that holds a third of all rows is
spread like the others.

Percentiles are nearest-rank: the value at rank ``max(1, ceil(permille * n / 1000))`` of the ordered
non-null values. ``stop_width`` ends the bisection early: then the value is known to lie in
``[lower, upper]`` and ``max_error = upper - lower < stop_width``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import stage

#: Live intervals up to which they are broadcast (some 100 bytes each).
LIVE = 100_000
PERMILLE = (10, 50, 250, 500, 750, 900, 950, 990)


def value_counts(df: DataFrame, value: str, keys: Sequence[str], slices: Sequence[str] = ()) -> DataFrame:
    """The partial result: columns *slices*, *keys*, ``v`` and ``n``.

    Null values are left out (a percentile is one of the non-null values); a null key is a key of its own;
    repeated rows count each time; no rows give an empty table. Other columns of df don't matter, whatever their names.
    """
    cols = [F.col(c) for c in (*slices, *keys)]
    return df.where(F.col(value).isNotNull()).groupBy(*cols, F.col(value).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def merge(*parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine partial results of different slices: counts add up."""
    out = parts[0].select(*keys, "v", "n")
    for p in parts[1:]:
        out = out.unionByName(p.select(*keys, "v", "n"))
    return out.groupBy(*keys, "v").agg(F.sum("n").alias("n"))


def grouping_levels(counts: DataFrame, keys: Sequence[str], levels: dict[str, Sequence[str]]) -> DataFrame:
    """Counts of several groupings from those of the finest one; keys a level doesn't group by are null."""
    out = None
    for level, own in levels.items():
        part = counts.groupBy(*own, "v").agg(F.sum("n").alias("n"))
        part = part.select(F.lit(level).alias("level"), *[F.col(k) if k in own else F.lit(None).cast(counts.schema[k].dataType).alias(k) for k in keys], "v", "n")
        out = part if out is None else out.unionByName(part)
    return out


def bisect(counts: DataFrame, keys: Sequence[str], permille: Sequence[int] = PERMILLE, bits: int = 8, stop_width: int = 1) -> DataFrame:
    """Percentiles of counts (*keys*, ``v``, ``n``), which is read several times and should be a written table.

    Columns: *keys*, ``permille``, ``n`` (values of the group), ``value``, ``lower``, ``upper``, ``max_error``.
    A group without values has no row. The full int64 range is handled: where max - min does not fit, the
    domain is split at zero and each half is offset on its own.
    """
    names, types = list(keys), {k: counts.schema[k].dataType for k in keys}
    # every key as a text and a null flag, neither ever null: joins and windows then agree on one partitioning
    keys = [f"__{x}{k}" for k in range(len(names)) for x in "kn"]
    counts = counts.select(*[c for k, name in enumerate(names) for c in (F.coalesce(F.col(name).cast("string"), F.lit("")).alias(f"__k{k}"), F.col(name).isNull().alias(f"__n{k}"))], "v", "n")
    lo, hi = counts.agg(F.min("v"), F.max("v")).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    wide = hi - lo >= 1 << 62
    # side 0: negative values, side 1: the others, only when the span doesn't fit an offset in 62 bits
    if wide:
        cells = counts.select(*keys, (F.col("v") >= 0).cast("int").alias("side"), F.when(F.col("v") < 0, F.col("v") - F.lit(-(1 << 63))).otherwise(F.col("v")).alias("u"), "n")
        span = 63
    else:
        cells = counts.select(*keys, F.lit(0).alias("side"), (F.col("v") - F.lit(lo)).alias("u"), "n")
        span = max(1, (hi - lo).bit_length())
    ends = max(0, (max(1, stop_width)).bit_length() - 1)
    shifts = [*range(ends, span, bits), span]  # part widths, finest first; the last is the whole domain (of a side)

    cell = [*keys, "side", "part"]
    permilles = ", ".join(map(str, permille))
    # the whole domain of a side is one interval at first; the ranks of a group with both sides fall into one of them
    sides = cells.groupBy(*keys, "side").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"))
    of = f"over (partition by {', '.join(keys)} order by side)"
    sides = sides.selectExpr(*keys, "side", "n", "cells", f"sum(n) {of} as cum", f"sum(n) over (partition by {', '.join(keys)}) as total")
    asks = f"transform(array({permilles}), p -> struct(p as pm, greatest(1, (p * total + 999) div 1000) as rank))"
    hit = "filter({}, a -> a.rank <= cum and a.rank > cum - n)"
    move = "transform({}, a -> struct(a.pm as pm, a.rank - cum + n as rank))"
    live = sides.selectExpr(*keys, "side", "cast(0 as bigint) as part", "total", "cells", f"{move.format(hit.format(asks))} as asks").where("size(asks) > 0")

    def resolve(intervals: DataFrame, n_rows: int, above: int, s: int) -> DataFrame:
        """Count the parts of width 2**s of the intervals of width 2**above, and give those that the ranks fall into."""
        near = F.broadcast(intervals) if n_rows <= LIVE else intervals
        part = "cast(0 as bigint)" if above == span else f"shiftright(u, {above})"
        parts = cells.selectExpr(*keys, "side", f"{part} as part", f"shiftright(u, {s}) as sub", "n").join(near.select(*cell), cell)
        if s == 0:  # cells are different values already
            parts = parts.selectExpr(*cell, "sub", "n", "1 as cells")
        else:
            parts = parts.groupBy(*cell, "sub").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"))
        parts = parts.selectExpr(*cell, "sub", "n", "cells", f"sum(n) over (partition by {', '.join(cell)} order by sub) as cum")
        hits = parts.join(near.select(*cell, "total", "asks"), cell).selectExpr(*keys, "side", "sub as part", "total", "n", "cum", "cells", f"{hit.format('asks')} as asks").where("size(asks) > 0")
        return hits.selectExpr(*keys, "side", "part", "total", "cells", f"{move.format('asks')} as asks")

    done = []
    for above, s in zip(shifts[::-1], shifts[-2::-1]):
        live = stage(live, "intervals")
        few = live.where(F.col("cells") <= 1 << bits) if ends == 0 and s > 0 else live.where("false")
        live = live.where(F.col("cells") > 1 << bits) if ends == 0 and s > 0 else live
        n_few, n_live = (f.count() for f in (few, live))
        if n_few:
            done.append(resolve(few, n_few, above, 0))
        if not n_live and done:
            live = None
            break
        live = resolve(live, n_live, above, s)
    found = live
    for d in done:
        found = d if found is None else found.unionByName(d)
    active = found.selectExpr(*keys, "side", "part", "total", "explode(asks) as ask").selectExpr(*keys, "side", "part", "total", "ask.pm as pm")

    base = F.when(F.col("side") == 0, F.lit(-(1 << 63))).otherwise(F.lit(0)) if wide else F.lit(lo)
    last = shifts[0]
    low = (F.shiftleft(F.col("part"), last) if last else F.col("part")) + base
    back = [F.when(~F.col(f"__n{k}"), F.col(f"__k{k}")).cast(types[name]).alias(name) for k, name in enumerate(names)]
    width, top = F.lit((1 << last) - 1).cast("bigint"), (1 << 63) - 1
    upper = F.when(low > F.lit(top) - width, F.lit(top)).otherwise(low + F.when(low > F.lit(top) - width, F.lit(0)).otherwise(width))
    return active.select(*back, F.col("pm").alias("permille"), F.col("total").alias("n"), low.alias("value"), low.alias("lower"), upper.alias("upper"), (upper - low).alias("max_error"))


def percentiles(df: DataFrame, value: str, keys: Sequence[str], levels: dict[str, Sequence[str]], permille: Sequence[int] = PERMILLE, **how: int) -> DataFrame:
    """Percentiles of every grouping in levels, from rows: partial result, roll-up to the levels, bisection."""
    return from_counts(value_counts(df, value, keys), keys, levels, permille, **how)


def from_counts(counts: DataFrame, keys: Sequence[str], levels: dict[str, Sequence[str]], permille: Sequence[int] = PERMILLE, **how: int) -> DataFrame:
    """Percentiles from (merged) partial results."""
    return bisect(stage(grouping_levels(counts, keys, levels), "counts"), ["level", *keys], permille, **how)
