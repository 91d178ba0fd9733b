"""A table on shared storage: a log of arrivals, digested blocks, a small catalog.

::

    T/catalog/<n>.json     versions: column -> int | str | set, statistics and extents; the last one is current
    T/log/<id>/            arrivals, one append per ingest (parquet)
    T/digesting/<id>/      log directories that a digest has taken
    T/blocks/<id>/         one directory per digest, sorted by time, with the names of the log directories it has
    T/cache/<key>/<id>/    partial results of queries, per block directory
    T/locks/<what>/        leases of the writers that must not overlap: digest and trim, catalog

A digest holds a lease, so at most one runs; it takes the log by renaming (arrivals during it start a new log),
writes to a folder of its own and shows the blocks by one rename. One that dies loses its lease, and the next
takes up its directory: if the blocks are there only the inputs are deleted, else they are made anew. Until the
blocks are there, reads with the log read what the digest has taken.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.plans import compile as plan
from brindle.plans.spec import QuerySpec
from brindle.sources import ingest as reading
from brindle.sources.files import Files
from brindle.sources.lease import Busy, Lease
from brindle.sources.model import ColumnTypeError, to_model

_TYPES = {"int": T.LongType(), "str": T.StringType(), "set": T.ArrayType(T.StringType())}
#: When ingest starts a digest by itself: files in the log, bytes in the log.
LOG_FILES, LOG_BYTES = 256, 2 * 1024 * 1024
#: Rows of a block file at most.
BLOCK_ROWS = 1 << 20


def list_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables below a folder."""
    files = Files(spark)
    return [n for n, is_dir, _, _ in files.list(root) if is_dir and files.list(f"{root}/{n}/catalog")]


class Table:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.path = spark, name, f"{root.rstrip('/')}/{name}"
        self.files = Files(spark)
        self.log_files: int | None = None  # None: LOG_FILES
        self.lease_seconds = 120.0  # a writer that gave no sign of life for so long counts as dead

    # -- catalog ---------------------------------------------------------------------------------
    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _, _, _ in self.files.list(f"{self.path}/catalog") if n.endswith(".json"))

    def _catalog(self) -> dict:
        for _ in range(5):
            found = self._versions()
            if not found:
                return {"columns": {}, "extents": {}}
            try:
                return json.loads(self.files.read(f"{self.path}/catalog/{found[-1]}.json"))
            except Exception:  # noqa: BLE001  an old version that was deleted between the listing and the reading
                if self._versions()[-1:] == found[-1:]:
                    raise
        raise RuntimeError(f"the catalog of {self.path} changes too fast to be read")

    def catalog(self) -> dict[str, str]:
        return self._catalog()["columns"]

    def _change(self, how: Callable[[dict], dict]) -> None:
        """The next version of the catalog: how gets the current one and gives the new one, while no other writer changes it."""
        with Lease(self.files, f"{self.path}/locks/catalog"):
            old = self._catalog()
            new = how(dict(old))
            if new != old or not self._versions():
                found = self._versions()
                self.files.mkdirs(f"{self.path}/catalog")
                self.files.write(f"{self.path}/catalog/{(found or [0])[-1] + 1}.json", json.dumps(new, sort_keys=True))
                for n in found[:-3]:
                    self.files.delete(f"{self.path}/catalog/{n}.json")

    def _merge_columns(self, new: Mapping[str, str]) -> None:
        def merged(catalog: dict) -> dict:
            for c, kind in new.items():
                if catalog["columns"].get(c, kind) != kind:
                    raise ColumnTypeError(f"column {c!r} is of type {catalog['columns'][c]}, the new rows have {kind}")
            return {**catalog, "columns": {**catalog["columns"], **new}}

        if not self._versions() or merged(self._catalog()) != self._catalog():
            self._change(merged)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, _TYPES[k]) for c, k in sorted(self.catalog().items())])

    # -- writing ---------------------------------------------------------------------------------
    def ingest(self, df: DataFrame, compact: bool = True, prefix: str = "log") -> None:
        """Append a DataFrame (brought into the model) to the log; the catalog is checked before anything is written."""
        df = to_model(df)
        self._merge_columns(plan.catalog_of(df))
        if df.columns:
            df.write.parquet(f"{self.path}/log/{prefix}-{uuid.uuid4().hex}")
        if compact:
            self.maybe_digest()

    def ingest_json(self, paths: str | list[str], options: reading.IngestOptions = reading.IngestOptions(), **how) -> None:
        self.ingest(reading.read_json(self.spark, paths, options), **how)

    def ingest_csv(self, paths: str | list[str], options: reading.IngestOptions = reading.IngestOptions(), **how) -> None:
        self.ingest(reading.read_csv(self.spark, paths, options), **how)

    def add(self, records: Iterable[Mapping], **how) -> None:
        """Append Python records (nested ones are flattened)."""
        lines = [(json.dumps(r),) for r in records]
        docs = self.spark.createDataFrame(lines, "value string")
        self.ingest(reading.from_json_strings(docs, "value"), **how)

    def _log_dirs(self) -> list[str]:
        return [f"{self.path}/log/{n}" for n, d, _, _ in self.files.list(f"{self.path}/log") if d and self.files.exists(f"{self.path}/log/{n}/_SUCCESS")]

    def maybe_digest(self, time_col: str = "time") -> bool:
        """Digest if the log has grown past the limits."""
        dirs = self._log_dirs()
        n = sum(1 for d in dirs for x in self.files.list(d) if x[0].endswith(".parquet"))
        if n > (self.log_files or LOG_FILES) or self.files.size(f"{self.path}/log") > LOG_BYTES:
            self.digest(time_col)
            return True
        return False

    def digest(self, time_col: str = "time", block_rows: int = BLOCK_ROWS) -> bool:
        """Move the log into blocks ordered by time. False: another digest or a trim is running, and this one did nothing."""
        lease = Lease(self.files, f"{self.path}/locks/blocks", self.lease_seconds)
        if not lease.take():
            return False
        try:
            for name, is_dir, _, _ in self.files.list(f"{self.path}/digesting"):
                if is_dir:
                    self._digest(name, time_col, block_rows, lease)  # one that died
            dirs = self._log_dirs()
            if dirs:
                name = uuid.uuid4().hex
                self.files.mkdirs(f"{self.path}/digesting/{name}")
                for d in dirs:
                    self.files.rename(d, f"{self.path}/digesting/{name}/{d.rsplit('/', 1)[1]}")
                self._digest(name, time_col, block_rows, lease)
        finally:
            lease.release()
        return True

    def _digest(self, name: str, time_col: str, block_rows: int, lease: Lease) -> None:
        taken, out = f"{self.path}/digesting/{name}", f"{self.path}/blocks/{name}"
        if not self.files.exists(f"{out}/_SUCCESS"):
            logs = [n for n, d, _, _ in self.files.list(taken) if d and not n.startswith("_")]
            if logs:
                # a folder per holder of the lease: one that was thought dead and lives writes beside, not into it
                made = f"{taken}/_made-{lease.number}"
                self.files.delete(made)
                rows = self.spark.read.schema(self.schema()).parquet(*[f"{taken}/{n}" for n in logs])
                if time_col in rows.columns:
                    # a hash of the row after the time splits a time that many rows share over several tasks
                    rest = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
                    rows = rows.repartitionByRange(F.col(f"`{time_col}`"), rest).sortWithinPartitions(f"`{time_col}`")
                rows.write.option("maxRecordsPerFile", block_rows).option("compression", "zstd").parquet(made)
                self.files.write(f"{made}/_taken.json", json.dumps(logs))
                if not lease.held():
                    raise Busy(f"the digest of {self.path} was taken over by another one")
                self.files.delete(out)  # without its _SUCCESS file it is no block
                self.files.mkdirs(f"{self.path}/blocks")
                if not self.files.rename(made, out):
                    raise OSError(f"cannot rename {made} to {out}")
        if lease.held():
            self.files.delete(taken)

    def has_log(self, name: str) -> bool:
        """Has a log directory of this name been written, taken by a digest or made into blocks?"""
        if self.files.exists(f"{self.path}/log/{name}/_SUCCESS"):
            return True
        if any(self.files.exists(f"{self.path}/digesting/{n}/{name}") for n, d, _, _ in self.files.list(f"{self.path}/digesting") if d):
            return True
        kept = (f"{self.path}/blocks/{n}/_taken.json" for n, d, _, _ in self.files.list(f"{self.path}/blocks") if d)
        return any(name in json.loads(self.files.read(p)) for p in kept if self.files.exists(p))

    # -- reading ---------------------------------------------------------------------------------
    def block_dirs(self) -> list[str]:
        return [f"{self.path}/blocks/{n}" for n, d, _, _ in self.files.list(f"{self.path}/blocks") if d and self.files.exists(f"{self.path}/blocks/{n}/_SUCCESS")]

    def read(self, read_log: bool = False) -> DataFrame:
        """The blocks, with the log too if asked; a column that a file lacks is null. A file that can't be read is an error unless spark.sql.files.ignoreCorruptFiles is set."""
        dirs = self.block_dirs() + (self._arrivals() if read_log else [])
        if not dirs:
            return self.spark.createDataFrame([], self.schema())
        return self.spark.read.schema(self.schema()).parquet(*dirs)

    def _arrivals(self) -> list[str]:
        """The log, and what a digest has taken from it but not made into blocks yet."""
        out = self._log_dirs()
        for name, is_dir, _, _ in self.files.list(f"{self.path}/digesting"):
            if is_dir and not self.files.exists(f"{self.path}/blocks/{name}/_SUCCESS"):
                out += [f"{self.path}/digesting/{name}/{n}" for n, d, _, _ in self.files.list(f"{self.path}/digesting/{name}") if d and not n.startswith("_")]
        return out

    def query(self, spec: QuerySpec, cache: bool = False) -> DataFrame:
        """The result of a spec. cache: keep the partial result of each block directory and use those that are kept."""
        spec = spec.for_table(self.name)
        spec.check(self.catalog())
        df = self.read(spec.read_log)
        if spec.samples or spec.distinct_limit > 0 or not cache:
            ext = self.extents(spec.ints, df, spec.skip_outliers) if spec.op == "hist" and not spec.tdigest else None
            return plan.compile_query(spec, df, ext, self.name)
        ext = self.extents(spec.ints, df, spec.skip_outliers) if spec.op == "hist" and not spec.tdigest else None
        root = f"{self.path}/cache/{spec.state_key(ext and sorted(ext.items()))}"
        blocks = self.block_dirs()
        missing = [d for d in blocks if not self.files.exists(f"{root}/{d.rsplit('/', 1)[1]}/_SUCCESS")]
        if missing:
            self._fill_cache(spec, ext, root, missing)
        parts = [self.spark.read.parquet(*[f"{root}/{d.rsplit('/', 1)[1]}" for d in blocks])] if blocks else []
        if spec.read_log and (log := self._arrivals()):
            parts.append(plan.state(spec, self.spark.read.schema(self.schema()).parquet(*log), ext))
        if not parts:
            return plan.compile_query(spec, df, ext, self.name)
        return plan.finish(spec, plan.merge(spec, *parts))

    def _fill_cache(self, spec: QuerySpec, ext, root: str, blocks: list[str]) -> None:
        """The partial results of several block directories by one job: the directory is one more key of the state."""
        rows = self.spark.read.schema(self.schema()).parquet(*blocks)
        block = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        made = f"{root}/_made-{uuid.uuid4().hex}"
        part = plan.state(spec, rows.withColumn(plan.SLICE, block), ext, slices=(plan.SLICE,))
        part.repartition(plan.SLICE).write.partitionBy(plan.SLICE).parquet(made)
        for d in blocks:
            name = d.rsplit("/", 1)[1]
            at = f"{made}/{plan.SLICE}={name}"
            if not self.files.exists(at):  # no row of the block matches
                part.drop(plan.SLICE).limit(0).write.parquet(at)
            if not self.files.exists(f"{at}/_SUCCESS"):
                self.files.create(f"{at}/_SUCCESS")
            if not self.files.exists(f"{root}/{name}"):
                self.files.rename(at, f"{root}/{name}")
        self.files.delete(made)

    # -- stats -----------------------------------------------------------------------------------
    def _content(self) -> str:
        """Names the block files as they are: any file that comes, goes or is rewritten changes it."""
        return hashlib.sha256(json.dumps([x for x in self.files.tree(f"{self.path}/blocks") if not x[0].rsplit("/", 1)[1].startswith(("_", "."))]).encode()).hexdigest()[:32]

    def extents(self, columns: tuple[str, ...], df: DataFrame | None = None, robust: bool = False) -> dict[str, tuple[int, int]]:
        """Kept extents if the block files are those they were made from and nothing is in the log, else computed."""
        kept = {} if robust or self._arrivals() else self._catalog().get("extents", {})
        content = self._content() if kept else ""
        fresh = {c: tuple(kept[c]["range"]) for c in columns if c in kept and kept[c].get("content") == content}
        missing = tuple(c for c in columns if c not in fresh)
        return {**fresh, **plan.extents(df if df is not None else self.read(), missing, robust)}

    def index(self, ints: tuple[str, ...]) -> dict[str, tuple[int, int]]:
        """Recompute and keep the extents and statistics (count of values, mean) of int columns."""
        content = self._content()
        rows = self.read()
        got = plan.extents(rows, ints)
        stats = self.column_stats(ints, rows)
        entry = {c: {"range": list(v), "content": content, "count": stats[c]["count"], "mean": stats[c]["mean"]} for c, v in got.items()}
        self._change(lambda catalog: {**catalog, "extents": {**catalog.get("extents", {}), **entry}})
        return got

    def column_stats(self, columns: tuple[str, ...] = (), rows: DataFrame | None = None, top: int = 20) -> dict[str, dict]:
        """Per column of the blocks: int columns have count, min, max, mean; text columns count, cardinality (a sketch's) and the most frequent values."""
        rows = self.read() if rows is None else rows
        catalog = self.catalog()
        names = [c for c in (columns or sorted(catalog)) if catalog[c] in ("int", "str")]
        cols = []
        for k, c in enumerate(names):
            v = F.col(f"`{c}`")
            cols.append(F.count(v).alias(f"n{k}"))
            cols += [F.min(v).alias(f"a{k}"), F.max(v).alias(f"z{k}"), F.avg(v).alias(f"m{k}")] if catalog[c] == "int" else [F.approx_count_distinct(v).alias(f"d{k}")]
        row = rows.agg(*cols).first() if cols else {}
        out: dict[str, dict] = {}
        for k, c in enumerate(names):
            if catalog[c] == "int":
                out[c] = {"count": row[f"n{k}"], "min": row[f"a{k}"], "max": row[f"z{k}"], "mean": row[f"m{k}"]}
            else:
                v = F.col(f"`{c}`")
                best = rows.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(top).collect()
                out[c] = {"count": row[f"n{k}"], "cardinality": row[f"d{k}"], "top": {r["v"]: r["n"] for r in best}}
        return out

    def info(self) -> dict:
        """count, storageSize, avgObjSize and the names of the columns by type."""
        n, size = self.read().count(), self.files.size(f"{self.path}/blocks")
        of = lambda kind: sorted(c for c, k in self.catalog().items() if k == kind)
        return {"count": n, "storageSize": size, "avgObjSize": size / n if n else 0.0, "columns": {"strs": of("str"), "ints": of("int"), "sets": of("set")}}

    def rebuild(self, replace_catalog: bool = False) -> dict[str, str]:
        """The catalog as the files' own schemas give it; written if asked for."""
        found: dict[str, str] = {}
        for d in self.block_dirs() + self._log_dirs():
            for c, kind in plan.catalog_of(self.spark.read.option("mergeSchema", True).parquet(d)).items():
                if found.setdefault(c, kind) != kind:
                    raise ColumnTypeError(f"column {c!r} is of type {found[c]} and {kind} in different blocks")
        if replace_catalog:
            self._change(lambda catalog: {"columns": found, "extents": {}})
        return found

    def inspect(self, path: str) -> DataFrame:
        """Rows, and least and greatest value per column, of one block directory or file."""
        df = self.spark.read.parquet(path)
        entries = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            entries.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.lit(1)).alias("rows"), F.count(c).alias("present"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")))
        return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))

    # -- export and retention -----------------------------------------------------------------------
    def export(self, out: str, spec: QuerySpec | None = None) -> None:
        """The rows that match spec's filters as gzipped TSV with a header, all columns aligned; sets as JSON."""
        rows = self.read(spec.read_log if spec else False)
        if spec:
            rows = plan.matching(spec.for_table(self.name), rows)
        cols = [F.to_json(f"`{c}`").alias(c) if k == "set" else F.col(f"`{c}`") for c, k in sorted(self.catalog().items())]
        rows.select(*cols).write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(out)

    def trim(self, time_col: str, before: int = 0, mb: int = 0, delete: bool = False) -> list[str]:
        """Block files, newest first, that only hold rows from before a time or lie past a size; deleted if asked.

        A file without a time is left alone. What comes to the driver is one row per file.
        """
        if not self.block_dirs():
            return []
        if not delete:
            return self._doomed(time_col, before, mb)
        with Lease(self.files, f"{self.path}/locks/blocks", self.lease_seconds):
            out = self._doomed(time_col, before, mb)
            for f in out:
                self.files.delete(f)
            self.files.delete(f"{self.path}/cache")
            for d in self.block_dirs():
                if not any(n.endswith(".parquet") for n, _, _, _ in self.files.list(d)):
                    self.files.delete(d)
        self._change(lambda catalog: {**catalog, "extents": {}})
        return out

    def _doomed(self, time_col: str, before: int, mb: int) -> list[str]:
        rows = self.read().groupBy(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).agg(F.max(f"`{time_col}`").alias("t"))
        out, size = [], 0
        for r in rows.where("t is not null").orderBy(F.desc("t"), "f").toLocalIterator():
            if (mb > 0 and size // (1024 * 1024) >= mb) or r["t"] < before:
                out.append(r["f"])
            size += r["b"]
        return out
