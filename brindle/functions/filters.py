"""Filters as predicates. A missing value satisfies no filter, negated ones included."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import java_pattern
from brindle.plans.spec import Filter


def predicate(f: Filter) -> Column:
    """The filter as a boolean column that is null or false where the value is missing."""
    c = F.col(f"`{f.column}`")
    if f.kind == "int":
        v = F.lit(int(f.value)).cast("bigint")
        return {"gt": c > v, "lt": c < v, "eq": c == v, "neq": c != v}[f.op]
    if f.kind == "str":
        if f.op in ("re", "nre"):
            hit = c.rlike(java_pattern(str(f.value)))
            return hit if f.op == "re" else ~hit
        return c == F.lit(f.value) if f.op == "eq" else c != F.lit(f.value)
    has = F.coalesce(F.array_contains(c, F.lit(f.value)), F.lit(False))
    return c.isNotNull() & (has if f.op == "in" else ~has)
