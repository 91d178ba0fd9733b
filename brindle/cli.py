"""python -m brindle.cli COMMAND ...: ingest, digest, query, trim, index, rebuild, inspect, aggregate, version."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from dataclasses import replace
from typing import BinaryIO

from pyspark.sql import SparkSession

import brindle
from brindle import results
from brindle.plans import compile as plan
from brindle.plans.spec import QuerySpec
from brindle.session import local_session
from brindle.sources.files import Files
from brindle.sources.ingest import IngestOptions
from brindle.sources.storage import Table, list_tables

VERSION = {"version": brindle.__version__, "hist": True, "loghist": True, "tdigest": True, "query_cache": True}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="brindle")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("-dir", default="./db")
        c.add_argument("-table", default="")
        return c

    c = command("ingest")
    c.add_argument("-infile", nargs="+", help="files to read; standard input without it")
    c.add_argument("-file", default="log", help="what the names of the log directories start with")
    c.add_argument("-csv", action="store_true")
    c.add_argument("-path", default="$")
    c.add_argument("-skip-compact", action="store_true")
    for x in ("exclude", "ints", "timestamps"):
        c.add_argument(f"-{x}", default="")
    c.add_argument("-timestamp-format", default=IngestOptions.timestamp_format)
    c = command("digest")
    c.add_argument("-time-col", default="time")
    c = command("query")
    for x in ("op", "int", "str", "set", "sample-cols", "group", "distinct", "int-filter", "str-filter", "set-filter", "str-replace", "sort", "weight-col", "time-col"):
        c.add_argument(f"-{x}")
    for x in ("time-bucket", "int-bucket", "distinct-limit"):
        c.add_argument(f"-{x}", type=int)
    c.add_argument("-limit", type=lambda x: x if x == "all" else int(x))
    for x in ("time", "sort-asc", "loghist", "tdigest", "skip-outliers", "exact-distinct", "samples", "read-log", "json", "info", "tables", "export", "cache-queries", "encode-flags", "decode-flags", "update-info", "debug"):
        c.add_argument(f"-{x}", action="store_true")
    c.add_argument("-encode-results", metavar="DIR", help="write the partial result to DIR for aggregate")
    c.add_argument("-prune-sort", help="accepted; results are exact, nothing is pruned")
    c.add_argument("-field-separator", default=":")
    c.add_argument("-filter-separator", default=",")
    c = command("trim")
    c.add_argument("-time-col", required=True)
    c.add_argument("-before", type=int, default=0)
    c.add_argument("-mb", type=int, default=0)
    c.add_argument("-delete", action="store_true")
    c.add_argument("-really", action="store_true")
    c = command("index")
    c.add_argument("-int", default="")
    c = command("rebuild")
    c.add_argument("-replace", action="store_true")
    c.add_argument("-force", action="store_true")
    c = command("inspect")
    c.add_argument("-file", required=True)
    c = command("aggregate")
    c.add_argument("dirs", nargs="+")
    c.add_argument("-json", action="store_true")
    c = command("version")
    c.add_argument("-json", action="store_true")
    return p


def run(argv: list[str], spark: SparkSession | None = None, out=print, stdin: BinaryIO | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        out(json.dumps(VERSION) if a.json else "\n".join(f"{k} : {v}" for k, v in VERSION.items()))
        return 0
    if a.command == "query" and a.encode_flags:
        out(_spec(a).to_json())
        return 0
    spark = spark or local_session()
    names = lambda s: tuple(x for x in s.split(",") if x)
    if a.command == "aggregate":
        return _aggregate(spark, a, out)
    if a.command == "query" and a.tables:
        found = list_tables(spark, a.dir)
        if a.encode_results:
            Files(spark).write(f"{a.encode_results}/tables.json", json.dumps(found))
            return 0
        out(json.dumps(found) if a.json else "\n".join(found))
        return 0
    if not a.table:
        out("name a table with -table")
        return 2
    t = Table(spark, a.dir, a.table)
    if a.command == "ingest":
        options = IngestOptions(a.path, names(a.exclude), names(a.ints), names(a.timestamps), a.timestamp_format)
        infile = a.infile
        if not infile:
            infile = [f"{t.path}/stdin/{uuid.uuid4().hex}"]
            t.files.mkdirs(f"{t.path}/stdin")
            t.files.spool(infile[0], iter(lambda: (stdin or sys.stdin.buffer).read(1 << 20), b""))
        (t.ingest_csv if a.csv else t.ingest_json)(infile, options, compact=not a.skip_compact, prefix=a.file)
        if not a.infile:
            t.files.delete(infile[0])
    elif a.command == "digest":
        if not t.digest(a.time_col):
            out("another digest or trim of the table is running")
            return 3
    elif a.command == "trim":
        doomed = t.trim(a.time_col, a.before, a.mb)
        out("\n".join(doomed))
        if a.delete and doomed and (a.really or input(f"{len(doomed)} block files will be removed for good. Go on? [yes/no] ").strip().lower() in ("y", "yes")):
            t.trim(a.time_col, a.before, a.mb, delete=True)
    elif a.command == "index":
        out(json.dumps({k: list(v) for k, v in t.index(names(a.int)).items()}))
    elif a.command == "rebuild":
        out(json.dumps(t.rebuild(a.replace or a.force)))
    elif a.command == "inspect":
        out("\n".join(json.dumps(r.asDict(), ensure_ascii=False) for r in t.inspect(a.file).collect()))
    elif a.command == "query":
        return _query(t, a, out)
    return 0


def _spec(a: argparse.Namespace) -> QuerySpec:
    if a.decode_flags:
        return QuerySpec.from_json(sys.stdin.read())
    flags = {k: v for k, v in vars(a).items() if v not in (None, False)}
    return QuerySpec.from_flags({**flags, "totals": bool(not a.json and (a.group or a.int) and not a.time and not a.samples and a.op != "distinct")}, a.field_separator, a.filter_separator)


def _query(t: Table, a: argparse.Namespace, out) -> int:
    if a.info:
        info = t.info()
        if a.encode_results:
            t.files.write(f"{a.encode_results}/info.json", json.dumps(info))
            return 0
        out(json.dumps(info) if a.json else "\n".join(f"{k}: {v}" for k, v in info.items()))
        return 0
    spec = _spec(a)
    if a.json:
        spec = replace(spec, totals=False)
    if a.update_info and spec.ints:
        t.index(spec.ints)
    if a.export:
        t.export(f"{t.path}/export", spec)
    elif a.encode_results:
        spec = spec.for_table(t.name)
        spec.check(t.catalog())
        df = t.read(spec.read_log)
        if spec.samples:
            plan.samples(spec, df).write.mode("overwrite").parquet(f"{a.encode_results}/samples")
            t.files.write(f"{a.encode_results}/spec.json", json.dumps({"spec": spec.to_json(), "extents": None}))
            return 0
        ext = t.extents(spec.ints, df, spec.skip_outliers) if spec.op == "hist" and not spec.tdigest else None
        plan.state(spec, df, ext).write.mode("overwrite").parquet(f"{a.encode_results}/state")
        t.files.write(f"{a.encode_results}/spec.json", json.dumps({"spec": spec.to_json(), "extents": ext}))
    else:
        result = t.query(spec, cache=a.cache_queries)
        if a.debug:
            result.explain("formatted")
        out(results.to_json(spec, result) if a.json else results.to_text(spec, result))
    return 0


def _aggregate(spark: SparkSession, a: argparse.Namespace, out) -> int:
    """Merge what several nodes wrote with -encode-results: table lists, table infos, samples, or partial results of one query.

    Partial histograms of unequal extents are brought to the extents that contain all of them.
    """
    files = Files(spark)
    if all(files.exists(f"{d}/tables.json") for d in a.dirs):
        names = sorted({x for d in a.dirs for x in json.loads(files.read(f"{d}/tables.json"))})
        out(json.dumps(names) if a.json else "\n".join(names))
        return 0
    if all(files.exists(f"{d}/info.json") for d in a.dirs):
        infos = [json.loads(files.read(f"{d}/info.json")) for d in a.dirs]
        n, size = (sum(i[k] for i in infos) for k in ("count", "storageSize"))
        kinds = {k: sorted({c for i in infos for c in i["columns"][k]}) for k in ("strs", "ints", "sets")}
        info = {"count": n, "storageSize": size, "avgObjSize": size / n if n else 0.0, "columns": kinds}
        out(json.dumps(info) if a.json else "\n".join(f"{k}: {v}" for k, v in info.items()))
        return 0
    heads = [json.loads(files.read(f"{d}/spec.json")) for d in a.dirs]
    if len({h["spec"] for h in heads}) > 1:
        out("the partial results are of different queries")
        return 2
    spec = QuerySpec.from_json(heads[0]["spec"])
    if a.json:
        spec = replace(spec, totals=False)
    if spec.samples:
        rows = None
        for d in a.dirs:
            part = spark.read.parquet(f"{d}/samples")
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        result = plan.samples(replace(spec, filters=(), replaces=(), ints=(), strs=(), sets=(), sample_cols=tuple(rows.columns)), rows)
    else:
        parts = [spark.read.parquet(f"{d}/state") for d in a.dirs]
        extents = [h["extents"] for h in heads]
        if extents[0] and any(e != extents[0] for e in extents):
            whole = {c: (min(e[c][0] for e in extents), max(e[c][1] for e in extents)) for c in extents[0]}
            parts = [plan.rebucket(spec, p, whole) for p in parts]
        result = plan.finish(spec, plan.merge(spec, *parts))
    out(results.to_json(spec, result) if a.json else results.to_text(spec, result))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
