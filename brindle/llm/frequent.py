"""Most frequent values of columns with very many distinct values: combinatorial group testing.

A value is hashed to 32 bits. For each of ``tables`` hash functions the value falls into one of ``width``
buckets, and a bucket keeps a total and 32 counters, one per bit of the hash: how many rows had that bit
set. If one value makes up more than half of a bucket, each of its bits is the majority bit, so the bucket
names the value's hash directly; no candidate list is kept while scanning. Sketches add up, so one is made
per partition, and memory is ``tables * width * 33`` counters whatever the number of rows or distinct values.

A second pass verifies: rows whose hash was decoded are counted exactly by their value, which also resolves
values that share a hash. What it sends to the executors is bounded by ``tables * width`` numbers.

Nothing is missed either: a value that the pass did not count leaves, in each of the tables, a bucket whose total
exceeds what the counted values explain by at least ``share`` of all rows. If some table has no such bucket, that
proves the result whole; otherwise (values that collide in all tables) the sketch is made again with four times the
width, until it does. Nothing infrequent can be reported.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import stage

BITS = 32
#: Odd multipliers of the bucket functions (any odd numbers do); their number bounds the number of tables.
MULTIPLIERS = tuple((0x9E3779B97F4A7C15 * (2 * k + 1) ^ (0xD1B54A32D192ED03 * (k + 1))) & (2**64 - 1) | 1 for k in range(16))

SKETCH = T.StructType([T.StructField("field", T.StringType()), T.StructField("tab", T.IntegerType()), T.StructField("bucket", T.IntegerType())] + [T.StructField(f"c{b}", T.LongType()) for b in range(BITS + 1)])
DECODED = T.StructType([T.StructField("field", T.StringType()), T.StructField("h", T.LongType()), T.StructField("bound", T.LongType())])


def _buckets(h: np.ndarray, tab: int, width_bits: int) -> np.ndarray:
    """Multiply-shift: the high bits of h times an odd number."""
    return ((h.astype(np.uint64) * np.uint64(MULTIPLIERS[tab])) >> np.uint64(64 - width_bits)).astype(np.int64)


def _hash(column: str) -> "F.Column":
    return F.xxhash64(F.col(column)).bitwiseAND(F.lit((1 << BITS) - 1))


def sketch(df: DataFrame, fields: Sequence[str], width: int = 512, tables: int = 5) -> DataFrame:
    """The mergeable sketch of the columns *fields* of df, one row per used bucket: ``field, tab, bucket, c0`` (total), ``c1..c32``.

    Nulls are not counted; the empty string is a value; repeated rows count each time. Values are compared as
    stored. Only the hashes go to Python, as 8-byte numbers in Arrow batches.
    """
    width_bits = width.bit_length() - 1
    if 1 << width_bits != width or not 0 < tables <= len(MULTIPLIERS):
        raise ValueError("width is a power of two, tables at most 16")
    names = list(fields)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), tables, BITS + 1, width), np.int64)
        for batch in batches:
            for k in range(len(names)):
                h = batch.column(k).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(h):
                    continue
                for t in range(tables):
                    at = _buckets(h, t, width_bits)
                    sums[k, t, 0] += np.bincount(at, minlength=width)
                    for b in range(BITS):
                        sums[k, t, b + 1] += np.bincount(at[(h >> b) & 1 == 1], minlength=width)
        k, t, w = np.nonzero(sums[:, :, 0, :])
        counters = sums[k, t, :, w]
        cols = [pa.array([names[x] for x in k], pa.string()), pa.array(t.astype(np.int32)), pa.array(w.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols + [pa.array(counters[:, b]) for b in range(BITS + 1)], names=SKETCH.names)

    hashed = df.select(*[F.when(F.col(c).isNotNull(), _hash(c)).alias(f"h{k}") for k, c in enumerate(names)])
    return merge(hashed.mapInArrow(make, SKETCH))


def merge(*sketches: DataFrame) -> DataFrame:
    """Add sketches (of partitions, loads or days) that were made with the same width and tables."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("field", "tab", "bucket").agg(*[F.sum(f"c{b}").alias(f"c{b}") for b in range(BITS + 1)])


def decode(sketched: DataFrame, width: int = 512) -> DataFrame:
    """Hashes that dominate a bucket: ``field, h, bound``, at most tables * width rows a field.

    ``bound`` is the least total of a bucket that h falls in among those it dominates: its count is at most that.
    """
    width_bits = width.bit_length() - 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tab, bucket = batch.column("tab").to_numpy(), batch.column("bucket").to_numpy()
            total = batch.column("c0").to_numpy()
            h = np.zeros(len(total), np.int64)
            for b in range(BITS):
                h |= (2 * batch.column(f"c{b + 1}").to_numpy() > total).astype(np.int64) << b
            fits = np.zeros(len(total), bool)  # a decoded hash that belongs to another bucket is noise
            for t in np.unique(tab):
                m = tab == t
                fits[m] = _buckets(h[m], int(t), width_bits) == bucket[m]
            at = np.nonzero(fits)[0]
            yield pa.RecordBatch.from_arrays([batch.column("field").take(pa.array(at)), pa.array(h[at]), pa.array(total[at])], names=DECODED.names)

    return sketched.mapInArrow(read, DECODED).groupBy("field", "h").agg(F.min("bound").alias("bound"))


def frequent(df: DataFrame, fields: Sequence[str], share: float = 0.01, width: int | None = None, tables: int = 5) -> DataFrame:
    """Values that stand in at least ``share`` of all rows of df: ``field, value, approx_count, n, n_rows``.

    ``approx_count`` is the sketch's estimate (at least ``n``), ``n`` the exact count of the verifying pass,
    ``n_rows`` all rows of df, those with null included. An empty df or a column of nulls gives no rows.
    Values with equal counts are all reported. The columns are cast to strings.
    """
    if width is None:
        width = 1 << max(6, int(np.ceil(np.log2(5 / share))))
    df = df.select(*[F.col(c).cast("string").alias(c) for c in fields])
    schema = "field string, value string, approx_count bigint, n bigint, n_rows bigint"
    out, todo = [], list(fields)
    while todo:
        kept = stage(sketch(df, todo, width, tables), "sketch")
        bounds: dict[str, dict[int, int]] = {c: {} for c in todo}
        totals: dict[str, dict[tuple[int, int], int]] = {c: {} for c in todo}
        # at most tables * width rows a field, whatever the data
        for r in decode(kept, width).collect():
            bounds[r["field"]][r["h"]] = r["bound"]
        for r in kept.select("field", "tab", "bucket", "c0").collect():
            totals[r["field"]][r["tab"], r["bucket"]] = r["c0"]
        again = []
        for c in todo:
            counted, n_rows = _count(df, c, bounds[c])
            least = Decimal(str(share)) * n_rows  # exact: a share of just the limit counts
            if n_rows and not _whole(counted, totals[c], least, width, tables):
                again.append(c)
                continue
            out += [(c, v, bounds[c][h], n, n_rows) for v, h, n in counted if n >= least]
        todo, width = again, width * 4
        if todo and width > MAX_WIDTH:
            raise RuntimeError(f"values of {todo} that differ have one 32-bit hash; their counts can't be told apart")
    return df.sparkSession.createDataFrame(out, schema)


#: Width at which a sketch is given up: colliding totals then can't come from the bucket functions any more.
MAX_WIDTH = 1 << 16


def _count(df: DataFrame, field: str, known: dict[int, int]) -> tuple[list[tuple[str, int, int]], int]:
    """The verifying pass: (value, hash, rows) of the values whose hash was decoded, and the number of all rows."""
    spark = df.sparkSession
    names = F.broadcast(spark.createDataFrame([(int(h),) for h in known] or [(-1,)], "h bigint").withColumn("hit", F.lit(True)))
    rows = df.select(F.col(field).alias("value")).withColumn("h", F.when(F.col("value").isNotNull(), _hash("value"))).join(names, "h", "left")
    # one group for all rows without a decoded hash: it gives the number of rows in the same pass
    got = rows.groupBy(F.when(F.col("hit"), F.col("value")).alias("value"), F.when(F.col("hit"), F.col("h")).alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()
    return [(r["value"], r["h"], r["n"]) for r in got if r["h"] is not None], sum(r["n"] for r in got)


def _whole(counted: list[tuple[str, int, int]], totals: dict[tuple[int, int], int], least: Decimal, width: int, tables: int) -> bool:
    """Is there a table all of whose buckets are explained by the counted values, but for less than *least* rows each?"""
    h = np.array([x[1] for x in counted], np.int64)
    n = np.array([x[2] for x in counted], np.int64)
    for t in range(tables):
        explained = np.zeros(width, np.int64)
        if len(h):
            np.add.at(explained, _buckets(h, t, width.bit_length() - 1), n)
        left = max((c0 - int(explained[bucket]) for (tab, bucket), c0 in totals.items() if tab == t), default=0)
        if left < least:
            return True
    return False
