"""Distinct counts over huge identifier sets: log-log registers per group, merged by maximum.

The 64-bit hash of an identifier picks one of ``2**p`` registers by its low bits; the register keeps the
largest rank (leading zeros + 1) seen among the other 64-p bits. A partial result is the table of non-zero
registers ``(keys, reg, rank)``; partial results of other loads, days or groups merge by taking the maximum
per register, so a roll-up from (day, country) to day never touches the identifiers again, and a row that
arrives twice changes nothing. A group holds at most ``2**p`` rows, so neither a hot group nor a hot
identifier makes a large task.

The estimate is the improved raw estimator of Ertl (2017), which needs no bias tables and no switch to
linear counting; its relative standard error is ``1.04 / sqrt(2**p)``, reported with every estimate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = 14


def _rank(word: Column, bits: int) -> Column:
    """Leading zeros of a number of ``bits`` bits, plus 1; bits + 1 for zero. Integer operations only: smear, then count the ones."""
    for s in (1, 2, 4, 8, 16, 32):
        word = word.bitwiseOR(F.shiftrightunsigned(word, s))
    return (F.lit(bits + 1) - F.bit_count(word)).cast("tinyint")


def registers(df: DataFrame, value: str, keys: Sequence[str], p: int = P) -> DataFrame:
    """The partial result of df: *keys*, ``reg``, ``rank``.

    Null identifiers are not counted, the empty string is one; null keys form a group of their own; an
    empty table has no registers, so no groups. Other columns don't matter, whatever their names.
    """
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k) for k in keys], F.xxhash64(F.col(value)).alias("__h"))
    reg = F.col("__h").bitwiseAND(F.lit((1 << p) - 1)).cast("int").alias("reg")
    return rows.groupBy(*keys, reg).agg(F.max(_rank(F.shiftrightunsigned("__h", p), 64 - p)).alias("rank"))


def merge(*parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge partial results, or roll one up to fewer keys: the maximum per register."""
    out = parts[0].select(*keys, "reg", "rank")
    for x in parts[1:]:
        out = out.unionByName(x.select(*keys, "reg", "rank"))
    return out.groupBy(*keys, "reg").agg(F.max("rank").alias("rank"))


def pack(regs: DataFrame, keys: Sequence[str], p: int = P) -> DataFrame:
    """One row per group with its registers as bytes, for keeping: *keys*, ``packed`` (2**p bytes; at most 2**p rows are gathered)."""
    entry = F.map_from_entries(F.collect_list(F.struct("reg", "rank")))
    full = F.transform(F.sequence(F.lit(0), F.lit((1 << p) - 1)), lambda i: F.coalesce(F.element_at(F.col("__m"), i).cast("int"), F.lit(0)))
    hexes = F.transform(full, lambda r: F.lpad(F.hex(r), 2, "0"))
    return regs.groupBy(*keys).agg(entry.alias("__m")).select(*keys, F.unhex(F.array_join(hexes, "")).alias("packed"))


def unpack(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The registers of packed rows."""
    rows = packed.select(*keys, F.hex("packed").alias("__x")).withColumn("__i", F.explode(F.sequence(F.lit(0), (F.length("__x") / 2 - 1).cast("int"))))
    rank = F.conv(F.substring("__x", F.col("__i") * 2 + 1, F.lit(2)), 16, 10).cast("tinyint")
    return rows.select(*keys, F.col("__i").alias("reg"), rank.alias("rank")).where("rank > 0")


def estimate(regs: DataFrame, keys: Sequence[str], p: int = P) -> DataFrame:
    """*keys*, ``approx_distinct`` (rounded), ``std_error`` (relative)."""
    m, q = 1 << p, 64 - p
    got = regs.groupBy(*keys).agg(
        F.sum(F.when(F.col("rank") <= q, F.pow(F.lit(2.0), -F.col("rank").cast("double"))).otherwise(0.0)).alias("__s"),
        F.sum((F.col("rank") > q).cast("long")).alias("__top"),
        F.count(F.lit(1)).alias("__used"),
    )
    x = (F.lit(m) - F.col("__used")) / F.lit(float(m))  # share of empty registers
    # sigma(x) = x + sum x^(2^k) 2^(k-1): after p + 7 terms the rest is below double precision unless all registers are empty
    terms = lambda n, start, f: F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda acc, k: acc + f(k.cast("double")))
    two = F.lit(2.0)
    sigma = terms(p + 7, x, lambda k: F.pow(x, F.pow(two, k)) * F.pow(two, k - 1))
    y = F.lit(1.0) - F.col("__top") / F.lit(float(m))
    tau = terms(39, F.lit(1.0) - y, lambda k: -F.pow(F.lit(1.0) - F.pow(y, F.pow(two, -k)), two) * F.pow(two, -k))
    z = F.lit(float(m)) * sigma + F.col("__s") + F.when(F.col("__top") > 0, F.lit(float(m)) * tau / 3.0 * 2.0**-q).otherwise(0.0)
    value = F.lit(m * m / (2 * math.log(2))) / z
    return got.select(*keys, F.round(F.least(value, F.lit(2.0**62))).cast("bigint").alias("approx_distinct"), F.lit(1.04 / math.sqrt(m)).alias("std_error"))


def distinct_counts(df: DataFrame, value: str, keys: Sequence[str], levels: dict[str, Sequence[str]], p: int = P) -> DataFrame:
    """Estimates of several groupings of *keys* from one pass over df: ``level``, *keys* (null where not grouped by), estimate, error."""
    return from_registers(registers(df, value, keys, p), keys, levels, p)


def from_registers(regs: DataFrame, keys: Sequence[str], levels: dict[str, Sequence[str]], p: int = P) -> DataFrame:
    """Estimates of several groupings from merged partial results."""
    out = None
    for level, own in levels.items():
        part = estimate(merge(regs, keys=own), own, p)
        part = part.select(F.lit(level).alias("level"), *[F.col(k) if k in own else F.lit(None).cast(regs.schema[k].dataType).alias(k) for k in keys], "approx_distinct", "std_error")
        out = part if out is None else out.unionByName(part)
    return out
