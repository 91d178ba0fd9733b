"""Intra-class correlation of an int column over groups (one-way analysis of variance)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def icc(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """One row: ``n``, ``k`` groups, ``ms_between``, ``ms_within``, ``icc`` = between / (between + within).

    Mean squares: between = sum n_g (mean_g - mean)^2 / (k - 1), within = sum of squares inside groups / (n - k).
    Null values are left out, a null group is a group; icc is 1 for a single group, null without values.
    """
    v = F.col(f"`{value}`").cast("double")
    per = df.where(v.isNotNull()).groupBy(*[F.col(f"`{g}`") for g in groups]).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    all_ = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("s")).alias("ssw"))
    between = F.when(F.col("k") > 1, (F.col("nmm") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("k") - 1))
    within = F.when(F.col("n") > F.col("k"), F.col("ssw") / (F.col("n") - F.col("k"))).otherwise(0.0)
    out = all_.where("n > 0").select("n", "k", between.alias("ms_between"), within.alias("ms_within"))
    share = F.col("ms_between") / F.when(F.col("ms_between") + F.col("ms_within") != 0, F.col("ms_between") + F.col("ms_within"))
    return out.withColumn("icc", F.when(F.col("k") <= 1, F.lit(1.0)).otherwise(share))
