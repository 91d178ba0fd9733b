"""Bucket edges of the linear and the logarithmic histogram, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: buckets of a histogram.
NUM_BUCKETS = 1000


def layout(low: int, high: int, int_bucket: int = 0) -> tuple[int, int]:
    """Width and number of the buckets of a linear histogram over low..high."""
    size, buckets = high - low, NUM_BUCKETS
    width = int_bucket if int_bucket > 0 else size // NUM_BUCKETS
    if width == 0:
        if size < 100:
            width, buckets = 1, size
        else:
            width = size // 100
            buckets = size // width
    return width, buckets + 2


def edge(v: Column, low: int, high: int, int_bucket: int = 0) -> Column:
    """The lower edge of v's bucket; values past the last bucket count in the last, values below low in the first."""
    width, n = layout(low, high, int_bucket)
    # past 62 bits the differences are computed as decimals, which don't overflow
    kind = "bigint" if high - low < 1 << 62 and width * n < 1 << 62 else "decimal(20,0)"
    lit = lambda x: F.lit(str(x)).cast(kind)
    index = F.call_function("div", v.cast(kind) - lit(low), lit(width))
    return (F.greatest(lit(0), F.least(index.cast(kind), lit(n - 1))) * lit(width) + lit(low)).cast("bigint")


def log_ranges(low: int, high: int) -> list[tuple[int, int]]:
    """The closed ranges of a logarithmic histogram, from the highest down: each half as wide as the one before, the last reaches low."""
    span = high - low
    # halvings until at most NUM_BUCKETS is left: range k is span >> k wide
    halvings = max(0, (span // (NUM_BUCKETS + 1)).bit_length())
    right = [high - sum(span >> k for k in range(1, j + 1)) for j in range(halvings + 1)]
    return [*zip(right[1:], right), (low, right[-1])]


def log_edge(v: Column, low: int, high: int, int_bucket: int = 0) -> Column:
    """The lower edge of v's bucket in the first range, from the highest down, that contains it."""
    out = None
    for a, b in log_ranges(low, high):
        e = edge(v, a, b, int_bucket)
        out = F.when(v >= a, e) if out is None else out.when(v >= a, e)
    return out.otherwise(F.lit(low))
