"""JSON lines and CSV into the three-type model, without a schema.

JSON is parsed once into VARIANT; one aggregate over it discovers the columns (the only thing that comes to
the driver is the merged schema), then every column is one typed extraction, so that all of it stays in the
JVM. Objects are flattened (``a_b``), arrays become sets of texts, numbers are cut towards zero, booleans are
0 or 1. A column with values of two types raises ``ColumnTypeError`` before anything is written.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import RFC3339, epoch, rounded_text
from brindle.sources.model import ColumnTypeError

_NUMBER = {"BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT", "BOOLEAN"}


@dataclass(frozen=True)
class IngestOptions:
    path: str = "$"  # where the records are in each document, e.g. $.a.b.0
    exclude: tuple[str, ...] = ()  # flattened names, with what is below them
    ints: tuple[str, ...] = ()  # text columns to read as ints
    timestamps: tuple[str, ...] = ()  # text columns to read as times
    timestamp_format: str = RFC3339


def _parse_schema(text: str) -> object:
    """The nested form of a variant's schema text: a type name, ("array", element) or ("object", {field: type})."""
    at = 0

    def name() -> str:
        nonlocal at
        if text[at] == "`":
            out, at2 = "", at + 1
            while True:
                end = text.index("`", at2)
                out += text[at2:end]
                if text[end + 1 : end + 2] != "`":
                    break
                out, at2 = out + "`", end + 2
            at = end + 1
            return out
        m = re.compile(r"[^:]+").match(text, at)
        at = m.end()
        return m.group()

    def kind() -> object:
        nonlocal at
        m = re.compile(r"[A-Z_ ]+(?:\(\d+, ?\d+\))?").match(text, at)
        at = m.end()
        word = m.group()
        if word in ("ARRAY", "OBJECT", "STRUCT") and text[at : at + 1] == "<":
            at += 1
            if word == "ARRAY":
                out: object = ("array", kind())
                at += 1
                return out
            fields: dict[str, object] = {}
            while text[at] != ">":
                key = name()
                at += 2  # ": "
                fields[key] = kind()
                if text[at] == ",":
                    at += 2
            at += 1
            return ("object", fields)
        return word

    return kind()


def _step(key: str) -> str:
    return "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def records(docs: DataFrame, column: str, path: str) -> DataFrame:
    """The records (variants, column ``v``) at a path: keys walk objects, numbers arrays; an array gives its elements, an object itself, anything else none."""
    out = docs.select(F.try_parse_json(column).alias("v")).where("v is not null")
    steps = [s for s in path.lstrip("$").split(".") if s]
    if steps:
        at = "$" + "".join(f"[{s}]" if s.isdigit() else _step(s) for s in steps)
        out = out.select(F.try_variant_get("v", F.lit(at), "variant").alias("v"))
    kind = F.schema_of_variant("v")
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", F.lit("$"), "array<variant>")).when(kind.startswith("OBJECT"), F.array("v"))
    return out.select(F.explode(items).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))


def _leaves(schema: object, path: str, name: str, exclude: Sequence[str]):
    """(flattened name, path, type) of every value that isn't an object."""
    for key, kind in schema[1].items():
        full = f"{name}_{key}" if name else key
        if full in exclude:
            continue
        if isinstance(kind, tuple) and kind[0] == "object":
            yield from _leaves(kind, path + _step(key), full, exclude)
        else:
            yield full, path + _step(key), kind


def _item(e: Column) -> Column:
    """An array's element as text: strings as they are, numbers without decimals, anything else null."""
    kind = F.schema_of_variant(e)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(kind == "STRING", F.try_variant_get(e, F.lit("$"), "string")).when(number, rounded_text(F.try_variant_get(e, F.lit("$"), "double")))


def flatten(recs: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """Variants (column ``v``) as a typed flat DataFrame. Columns whose values are all null are left out; no records give no columns and no rows."""
    got = recs.agg(F.schema_of_variant_agg("v")).first()[0]
    parsed = _parse_schema(got) if got else "VOID"
    if not isinstance(parsed, tuple):
        return recs.select().limit(0)
    found: dict[str, list[tuple[str, str, str]]] = {}
    unclear: list[tuple[str, str]] = []
    for name, path, kind in _leaves(parsed, "$", "", options.exclude):
        if kind in ("VOID", "NULL"):
            continue
        if kind == "VARIANT":
            unclear.append((name, path))
            continue
        found.setdefault(name, []).append((path, *_model(kind, name, options)))
    if unclear:
        # types that don't merge: booleans with numbers are ints all the same, the rest is an error (a few names a column)
        row = recs.agg(*[F.collect_set(F.regexp_extract(F.schema_of_variant(F.try_variant_get("v", F.lit(p), "variant")), "^[A-Z]+", 0)).alias(f"c{k}") for k, (_, p) in enumerate(unclear)]).first()
        for k, (name, path) in enumerate(unclear):
            kinds = {x for x in row[k] if x not in ("VOID", "NULL")}
            if kinds <= _NUMBER | {"DECIMAL"}:
                found.setdefault(name, []).append((path, "int", "mixed"))
            elif kinds <= {"STRING"} | _NUMBER | {"DECIMAL"} and name in options.ints:
                found.setdefault(name, []).append((path, "int", "text"))
            else:
                raise ColumnTypeError(f"column {name!r} has values of the types {sorted(kinds)}")
    cols = []
    for name, ways in sorted(found.items()):
        if len({w[1] for w in ways}) > 1:
            raise ColumnTypeError(f"column {name!r} has values of the types {sorted({w[1] for w in ways})}")
        cols.append(F.coalesce(*[_extract(p, how, name, options) for p, _, how in ways]).alias(name))
    return recs.select(*cols)


def _model(kind: object, name: str, options: IngestOptions) -> tuple[str, str]:
    if isinstance(kind, tuple):
        return "set", "array"
    if kind == "BOOLEAN":
        return "int", "boolean"
    if kind == "STRING":
        return ("int", "time") if name in options.timestamps else ("int", "text") if name in options.ints else ("str", "string")
    return "int", "number"


def _extract(path: str, how: str, name: str, options: IngestOptions) -> Column:
    get = lambda kind: F.try_variant_get("v", F.lit(path), kind)
    if how == "array":
        return F.array_compact(F.transform(get("array<variant>"), _item))
    if how == "boolean":
        return get("boolean").cast("bigint")
    if how == "number":
        return F.coalesce(get("bigint"), get("double").try_cast("bigint"))
    if how == "mixed":
        kind = F.schema_of_variant(get("variant"))
        return F.when(kind == "BOOLEAN", get("boolean").cast("bigint")).otherwise(F.coalesce(get("bigint"), get("double").try_cast("bigint")))
    if how == "time":
        return epoch(get("string"), options.timestamp_format)
    if how == "text":
        return F.when(get("string").rlike(r"\A[+-]?[0-9]+\z"), get("string").try_cast("bigint"))
    return get("string")


def read_json(spark: SparkSession, paths: str | list[str], options: IngestOptions = IngestOptions()) -> DataFrame:
    """JSON lines; a line that is no JSON is skipped, lines may be of any length."""
    return flatten(records(spark.read.text(paths), "value", options.path), options)


def from_json_strings(df: DataFrame, column: str, options: IngestOptions = IngestOptions()) -> DataFrame:
    return flatten(records(df, column, options.path), options)


def typed_cells(df: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """A DataFrame of texts (a CSV file) in the model: a column of numbers is an int column, one without numbers a text column.

    Empty cells are missing. A column with both raises ColumnTypeError.
    """
    names = [c for c in df.columns if c not in options.exclude]
    cells = df.select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in names])
    number = lambda c: F.when(F.col(f"`{c}`").rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), F.col(f"`{c}`").try_cast("double"))
    plain = [c for c in names if c not in options.ints and c not in options.timestamps]
    seen = cells.agg(*[x for k, c in enumerate(plain) for x in (F.count(f"`{c}`").alias(f"a{k}"), F.count(number(c)).alias(f"n{k}"))]).first() if plain else None
    cols = []
    for c in names:
        text = F.col(f"`{c}`")
        if c in options.timestamps:
            cols.append(epoch(text, options.timestamp_format).alias(c))
        elif c in options.ints:
            cols.append(text.try_cast("bigint").alias(c))
        else:
            k = plain.index(c)
            if seen[f"a{k}"] == 0:
                continue
            if 0 < seen[f"n{k}"] < seen[f"a{k}"]:
                raise ColumnTypeError(f"column {c!r} has numbers and texts")
            exact = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))
            cols.append((F.coalesce(exact, number(c).try_cast("bigint")) if seen[f"n{k}"] else text).alias(c))
    return cells.select(*cols)


def read_csv(spark: SparkSession, paths: str | list[str], options: IngestOptions = IngestOptions()) -> DataFrame:
    """CSV with a header line; short rows miss their last cells, what a row has past the header is ignored."""
    return typed_cells(spark.read.option("header", True).option("mode", "PERMISSIVE").option("nullValue", "").csv(paths), options)
