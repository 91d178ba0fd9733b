"""Any DataFrame in the three-type model: 64-bit ints, strings, sets of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ColumnTypeError(ValueError):
    """One column has values of two types."""


def as_model(c: Column, kind: T.DataType) -> Column | None:
    """A column in the model: doubles are cut towards zero (null if they don't fit), booleans are 0 or 1, times
    epoch seconds, arrays sets of texts without nulls; None for structs, maps and binary, which have no model type."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return c.try_cast("bigint")
    if isinstance(kind, T.IntegralType):
        return c.cast("bigint")
    if isinstance(kind, T.BooleanType):
        return c.cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_timestamp(c.cast("timestamp"))
    if isinstance(kind, T.StringType):
        return c.cast("string")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.NumericType)):
        items = c if isinstance(kind.elementType, T.StringType) else F.transform(c, lambda x: x.cast("string"))
        return F.array_compact(items) if kind.containsNull else items
    return None


def to_model(df: DataFrame, **sets: Column) -> DataFrame:
    """df in the model; further set columns by name. Columns without a model type are left out."""
    cols = [x.alias(f.name) for f in df.schema.fields if (x := as_model(F.col(f"`{f.name}`"), f.dataType)) is not None]
    return df.select(*cols, *[c.alias(k) for k, c in sets.items()])
