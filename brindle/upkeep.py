"""Queries that show tables, sinks, streams and the other ways in and out on the driver's tables, with SQL for the same rows.

Where an operator's result is no table (a file layout, an error, an estimate), the query reports what must
hold of it, and the SQL says that it does.
"""

from __future__ import annotations

import io
import json
import re
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import cli, results
from brindle.plans.builder import Query
from brindle.plans.compile import catalog_of, compile_query
from brindle.plans.spec import Filter, QuerySpec, SpecError
from brindle.session import scratch
from brindle.sources import ingest
from brindle.sources.storage import Table, list_tables
from brindle.sources.tables import table
from brindle.streaming.digest import follow_json, rollup_stream
from brindle.workload import _E, _N, _O, events, hosts, orders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _shows(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _new(spark: SparkSession, name: str) -> Table:
    return Table(spark, scratch(spark, "tables"), name)


def _lines(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.expr(c) for c in cols])).alias("value"))


_BY_TYPE = f"select event_type, {_N} from events group by 1"

# -- ingest --------------------------------------------------------------------------------------------------


@_shows(_BY_TYPE)
def json_path(spark: SparkSession, d: str) -> DataFrame:
    """Records in an array below a key."""
    docs = _lines(table(spark, d, "events"), "named_struct('rows', array(named_struct('event_type', event_type, 'skip', null), named_struct('event_type', null, 'skip', 1))) as a")
    got = ingest.from_json_strings(docs, "value", ingest.IngestOptions(path="$.a.rows"))
    return compile_query(QuerySpec(groups=("event_type",), limit=None), got.where("event_type is not null"))


@_shows(_BY_TYPE)
def json_path_index(spark: SparkSession, d: str) -> DataFrame:
    """The second element of an array."""
    docs = _lines(table(spark, d, "events"), "array(named_struct('event_type', 'no'), named_struct('event_type', event_type)) as a")
    return compile_query(QuerySpec(groups=("event_type",), limit=None), ingest.from_json_strings(docs, "value", ingest.IngestOptions(path="$.a.1")))


@_shows("""select case when user_id % 2 = 0 then 1 else 0 end as ok, cast(cast(round_even(value, 0) as bigint) as varchar) as item, count(*) as rows, cast(sum(case when user_id % 3 > 0 then user_id end) as bigint) as n,
  cast(min(floor(epoch(ts))) as bigint) as first, cast(max(floor(epoch(ts))) as bigint) as last, 'arr,n,ok,t' as columns from events group by 1, 2""")
def json_casts(spark: SparkSession, d: str) -> DataFrame:
    """Texts as ints and times, booleans as ints, numbers in sets as texts, a subtree left out."""
    docs = _lines(
        table(spark, d, "events"), "if(user_id % 3 > 0, cast(user_id as string), 'none') as n", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as t", "user_id % 2 = 0 as ok", "array(value) as arr", "named_struct('x', event_type) as gone"
    )
    got = ingest.from_json_strings(docs, "value", ingest.IngestOptions(exclude=("gone",), ints=("n",), timestamps=("t",)))
    out = got.select("ok", F.explode("arr").alias("item"), "n", "t").groupBy("ok", "item").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    return out.withColumn("columns", F.lit(",".join(got.columns)))


@_shows("select count(*) as n, true as digested from orders")
def auto_digest(spark: SparkSession, d: str) -> DataFrame:
    """A log that grows past the limit on its files is digested by the ingest that makes it so."""
    t = _new(spark, "orders")
    t.log_files = 2
    for k in range(3):
        t.ingest(table(spark, d, "orders").where(f"o_orderkey % 3 = {k}").coalesce(1))
    return t.read().agg(F.count(F.lit(1)).alias("n")).withColumn("digested", F.lit(not t._log_dirs() and len(t.block_dirs()) == 1))


@_shows("select n_name as name, cast(n_nationkey as bigint) as key from nation")
def add_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of the program's own (a nested one is flattened), as the interface for single rows takes them."""
    t = _new(spark, "nation")
    t.add([{"n": {"name": r["n_name"]}, "key": r["n_nationkey"]} for r in table(spark, d, "nation").collect()], compact=False)
    return t.read(True).select(F.col("n_name").alias("name"), "key")


@_shows(_BY_TYPE)
def cli_stdin(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines from standard input through the command line, then a query through it."""
    at, said = scratch(spark, "tables"), []
    lines = "\n".join(r[0] for r in _lines(table(spark, d, "events"), "event_type").toLocalIterator())
    base = ("-dir", at, "-table", "events")
    cli.run(["ingest", *base, "-skip-compact"], spark, said.append, io.BytesIO(lines.encode()))
    cli.run(["query", *base, "-group", "event_type", "-read-log", "-json"], spark, said.append)
    return spark.createDataFrame(json.loads(said[-1]), "event_type string, Count bigint, Samples bigint")


# -- tables ----------------------------------------------------------------------------------------------------


@_shows("select cast(min(user_id) as bigint) as low, cast(max(user_id) as bigint) as high, true as kept, count(user_id) as n, round(avg(user_id), 6) as mean from events")
def index_extents(spark: SparkSession, d: str) -> DataFrame:
    t = _new(spark, "events")
    t.ingest(events(spark, d), compact=False)
    t.digest()
    low, high = t.index(("user_id",))["user_id"]
    kept = t._catalog()["extents"]["user_id"]
    return spark.createDataFrame([(low, high, t.extents(("user_id",)) == {"user_id": (low, high)}, kept["count"], round(kept["mean"], 6))], "low bigint, high bigint, kept boolean, n bigint, mean double")


@_shows("select event_type as value, count(*) as n, (select count(distinct event_type) from events) as cardinality from events where event_type is not null group by 1 order by 2 desc, 1 limit 20")
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _new(spark, "events")
    t.ingest(events(spark, d), compact=False)
    t.digest()
    got = t.column_stats(("event_type",))["event_type"]
    return spark.createDataFrame([(v, n, got["cardinality"]) for v, n in got["top"].items()], "value string, n bigint, cardinality bigint")


@_shows("select * from (values ('o_custkey', 'int'), ('o_orderdate', 'int'), ('o_orderkey', 'int'), ('o_orderpriority', 'str'), ('o_orderstatus', 'str'), ('o_totalprice', 'int')) t(name, kind)")
def rebuild_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog made again from the files' own schemas."""
    t = _new(spark, "orders")
    t.ingest(table(spark, d, "orders"), compact=False)
    t.digest("o_orderdate")
    t.files.delete(f"{t.path}/catalog")
    t.rebuild(True)
    return spark.createDataFrame(sorted(t.catalog().items()), "name string, kind string")


@_shows("select 'o_orderkey' as name, count(*) as rows, count(o_orderkey) as present, cast(min(o_orderkey) as varchar) as least, cast(max(o_orderkey) as varchar) as greatest from orders")
def inspect_blocks(spark: SparkSession, d: str) -> DataFrame:
    t = _new(spark, "orders")
    t.ingest(table(spark, d, "orders"), compact=False)
    t.digest("o_orderdate")
    return t.inspect(t.block_dirs()[0]).where("column = 'o_orderkey'").select(F.col("column").alias("name"), "rows", "present", "least", "greatest")


@_shows("select * from (values ('nation'), ('region')) t(name)")
def tables_listed(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "tables")
    for name in ("region", "nation"):
        Table(spark, root, name).ingest(table(spark, d, name), compact=False)
    return spark.createDataFrame([(n,) for n in list_tables(spark, root)], "name string")


@_shows("select true as hist, true as loghist, true as query_cache")
def version_capabilities(spark: SparkSession, d: str) -> DataFrame:
    said: list[str] = []
    cli.run(["version", "-json"], spark, said.append)
    return spark.createDataFrame([json.loads(said[0])], "hist boolean, loghist boolean, query_cache boolean")


@_shows("select count(*) as n, true as ordered, true as bounded from host_generator")
def block_order(spark: SparkSession, d: str) -> DataFrame:
    """A digest orders rows by time over its files, of at most so many rows each."""
    t = _new(spark, "hosts")
    t.ingest(table(spark, d, "host_generator"), compact=False)
    t.digest(block_rows=1000)
    files = t.read().groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("time").alias("a"), F.max("time").alias("z"), F.count(F.lit(1)).alias("k"))
    rows = sorted((r for r in files.collect() if r["a"] is not None), key=lambda r: (r["a"], r["z"]))
    ordered = all(x["z"] <= y["a"] for x, y in zip(rows, rows[1:]))
    return files.agg(F.sum("k").alias("n"), (F.max("k") <= 1000).alias("bounded")).withColumn("ordered", F.lit(ordered))


@_shows("select true as older_go, true as size_kept")
def trim_mb(spark: SparkSession, d: str) -> DataFrame:
    """Trimming to a size: the newest files that reach it stay, and only older ones go."""
    t = _new(spark, "lineitem")
    rows = table(spark, d, "lineitem")
    for k in range(4):
        wide = rows.where(f"year(l_shipdate) % 4 = {k}").withColumn("pad", F.sha2(F.concat_ws("-", "l_orderkey", "l_linenumber"), 512))
        t.ingest(wide, compact=False)
        t.digest("l_shipdate", block_rows=5000)
    doomed = set(t.trim("l_shipdate", mb=1))
    files = t.read().groupBy(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).agg(F.max("l_shipdate").alias("z")).collect()
    kept, gone = [r for r in files if r["f"] not in doomed], [r for r in files if r["f"] in doomed]
    older = not gone or min(r["z"] for r in kept) >= max(r["z"] for r in gone)
    size = sum(r["b"] for r in kept)
    return spark.createDataFrame([(older, not gone or size >= 1 << 20)], "older_go boolean, size_kept boolean")


@_shows("select count(*) as n, count(distinct o_orderkey) as n_keys from orders")
def overlapping_digests(spark: SparkSession, d: str) -> DataFrame:
    """Three digests started together: the lease lets one run, and no row is lost or doubled."""
    t = _new(spark, "orders")
    for k in range(2):
        t.ingest(table(spark, d, "orders").where(f"o_orderkey % 2 = {k}"), compact=False)
    threads = [threading.Thread(target=Table(spark, t.path.rsplit("/", 1)[0], "orders").digest, args=("o_orderdate",)) for _ in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t.digest("o_orderdate")
    return t.read().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_keys"))


# -- results ---------------------------------------------------------------------------------------------------

_TOP = QuerySpec(groups=("host",), limit=10)


@_shows(f"select coalesce(host, '') as host, {_N} from host_generator group by 1 order by 2 desc, 1 limit 10")
def result_json(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(json.loads(results.to_json(_TOP, compile_query(_TOP, hosts(spark, d)))), "host string, Count bigint, Samples bigint")


@_shows("with c as (select coalesce(status, '') as status, count(*) as n from host_generator where status is not null and status <> '' group by 1 order by 2 desc, 1 limit 5) select status, n from c union all select 'TOTAL', count(*) from host_generator where status is not null and status <> ''")
def result_text(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec(groups=("status",), limit=5, totals=True)
    text = results.to_text(spec, compile_query(spec, hosts(spark, d).where("status <> ''")))
    return spark.createDataFrame([tuple(re.split(r"\s{2,}", line.strip())[::-1]) for line in text.splitlines()], "status string, n string").select("status", F.col("n").cast("bigint"))


@_shows(f"with {_E} select cast(time // 86400 * 86400 as varchar) as bucket, {_N} from e group by 1")
def result_time_json(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec(time=True, time_bucket=86400, limit=None)
    got = json.loads(results.to_json(spec, compile_query(spec, events(spark, d))))
    return spark.createDataFrame([{"bucket": b, **r} for b, rows in got.items() for r in rows], "bucket string, Count bigint, Samples bigint")


@_shows(f"with {_E} select strftime(make_timestamp(time // 86400 * 86400 * 1000000), '%Y-%m-%d %H:%M:%S') as at, count(*) as n from e group by 1")
def result_time_text(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec(time=True, time_bucket=86400, limit=None)
    text = results.to_text(spec, compile_query(spec, events(spark, d)))
    return spark.createDataFrame([re.split(r"\s{2,}", x)[:2] for x in text.splitlines()], "at string, n string").select("at", F.col("n").cast("bigint"))


@_shows(f"with {_O} select o_orderstatus, {_N} from o where o_totalprice > 100000 and regexp_matches(o_orderpriority, '^[12]') group by 1")
def flags_transport(spark: SparkSession, d: str) -> DataFrame:
    """A query as JSON, read back and run."""
    spec = QuerySpec.from_flags({"group": "o_orderstatus", "int-filter": "o_totalprice:gt:100000", "str-filter": "o_orderpriority:re:^[12]", "limit": "all"})
    return compile_query(QuerySpec.from_json(spec.to_json()), orders(spark, d))


@_shows(f"with {_O} select o_orderstatus, cast(sum(o_totalprice) as double) / count(o_totalprice) as mean, count(*) as n from o group by 1")
def aggregate_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Two nodes' histograms with extents of their own, merged."""
    root, said = scratch(spark, "tables"), []
    for node, where in (("x", "o_totalprice < 150000"), ("y", "o_totalprice >= 150000")):
        t = Table(spark, f"{root}/{node}", "orders")
        t.ingest(table(spark, d, "orders").where(where), compact=False)
        t.digest("o_orderdate")
        cli.run(["query", "-dir", f"{root}/{node}", "-table", "orders", "-op", "hist", "-int", "o_totalprice", "-group", "o_orderstatus", "-json", "-encode-results", f"{root}/{node}-part"], spark, said.append)
    cli.run(["aggregate", f"{root}/x-part", f"{root}/y-part", "-json"], spark, said.append)
    return spark.createDataFrame([(r["o_orderstatus"], r["o_totalprice"]["avg"], r["Count"]) for r in json.loads(said[-1])], "o_orderstatus string, mean double, n bigint")


# -- checks, estimates, limits ---------------------------------------------------------------------------------------


@_shows("select * from (values ('group by a set', true), ('mean of a text', true), ('no such column', true), ('sort by another column', true), ('text filter on an int', true)) t(wrong, refused)")
def type_check(spark: SparkSession, d: str) -> DataFrame:
    wrong = {
        "group by a set": QuerySpec(groups=("groups",)), "mean of a text": QuerySpec(ints=("host",)), "no such column": QuerySpec(ints=("pong",)),
        "sort by another column": QuerySpec(ints=("ping",), sort="weight"), "text filter on an int": QuerySpec(filters=(Filter("str", "ping", "eq", "1"),)),
    }
    catalog, out = catalog_of(hosts(spark, d)), []
    for name, spec in wrong.items():
        try:
            spec.check(catalog)
            out.append((name, False))
        except SpecError:
            out.append((name, True))
    return spark.createDataFrame(out, "wrong string, refused boolean")


@_shows("select event_type, count(distinct user_id) as n, true as within from events group by 1")
def distinct_approx_error(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's estimate is within four standard errors (1.04 / 2^7) of the exact count."""
    near = Query(events(spark, d)).group_by("event_type").distinct("user_id").limit(None).run().select("event_type", F.col("Distinct").alias("near"))
    exact = Query(events(spark, d)).group_by("event_type").distinct("user_id", exact=True).limit(None).run().select("event_type", F.col("Distinct").alias("n"))
    return near.join(exact, "event_type").select("event_type", "n", (F.abs(F.col("near") - F.col("n")) <= F.greatest(F.lit(1.0), F.col("n") * 4 * 1.04 / 128)).alias("within"))


@_shows("with s as (select coalesce(status, '') as status from host_generator where ping is not null group by 1) select status, cast(unnest(range(100)) as integer) as ip, true as within from s")
def tdigest_rank_error(spark: SparkSession, d: str) -> DataFrame:
    """Every percentile of the sketch has a rank within 3 % of the one asked for."""
    rows = hosts(spark, d).select(F.coalesce("status", F.lit("")).alias("status"), "ping").where("ping is not null")
    spec = QuerySpec(op="hist", tdigest=True, groups=("status",), ints=("ping",), limit=None)
    near = compile_query(spec, rows).select("status", F.posexplode("ping.percentiles").alias("ip", "v"))
    counts = rows.groupBy("status", "ping").agg(F.count(F.lit(1)).alias("n"))
    both = counts.select("status", F.col("ping").alias("v"), "n", F.lit(None).cast("int").alias("ip")).unionByName(near.select("status", "v", F.lit(0).cast("bigint").alias("n"), "ip"))
    ranks = both.selectExpr("status", "ip", "sum(n) over (partition by status) as all", "sum(n) over (partition by status order by v) as upto", "sum(n) over (partition by status order by v) - sum(n) over (partition by status, v) as below").where("ip is not null")
    at = F.col("ip") / 100
    return ranks.select("status", "ip", ((F.col("below") / F.col("all") <= at + 0.03) & (F.col("upto") / F.col("all") >= at - 0.03)).alias("within"))


@_shows("select 5 as n, true as known")
def distinct_limit_groups(spark: SparkSession, d: str) -> DataFrame:
    got = compile_query(QuerySpec(groups=("status",), distinct_limit=5), hosts(spark, d))
    known = hosts(spark, d).select(F.coalesce("status", F.lit("")).alias("status")).distinct()
    return got.distinct().join(known.withColumn("k", F.lit(True)), "status", "left").agg(F.count(F.lit(1)).cast("int").alias("n"), F.bool_and(F.coalesce("k", F.lit(False))).alias("known"))


@_shows("select 20 as n, true as matching")
def samples_any(spark: SparkSession, d: str) -> DataFrame:
    """Any 20 matching rows, in no order: the scan stops when it has them."""
    got = compile_query(QuerySpec(samples=True, sort="", limit=20, filters=(Filter("int", "ping", "gt", 100),)), hosts(spark, d))
    return got.agg(F.count(F.lit(1)).cast("int").alias("n"), F.bool_and(F.col("ping") > 100).alias("matching"))


@_shows(f"select coalesce(status, '') as status, {_N} from host_generator where host <> 'x' and regexp_matches(host, '^(web|edge)') and list_contains(groups, 'mod2') and not list_contains(groups, 'mod5') and ping > 10 and ping < 1000 and ping <> 50 group by 1")
def builder_filters(spark: SparkSession, d: str) -> DataFrame:
    q = Query(hosts(spark, d)).group_by("status").str_neq("host", "x").str_re("host", "^(web|edge)").set_in("groups", "mod2").set_nin("groups", "mod5")
    return q.int_gt("ping", 10).int_lt("ping", 1000).int_neq("ping", 50).limit(None).run()


@_shows("select count(*) as \"Count\", count(*) as \"Samples\" from orders where regexp_matches(o_orderpriority, '^(1-URGENT|2-HIGH){1,2}$')")
def other_separators(spark: SparkSession, d: str) -> DataFrame:
    """A pattern with a comma in it."""
    spec = QuerySpec.from_flags({"str-filter": "o_orderpriority\x1ere\x1e^(1-URGENT|2-HIGH){1,2}$", "limit": "all"}, "\x1e", "\x1f")
    return compile_query(spec, orders(spark, d))


# -- streams ---------------------------------------------------------------------------------------------------------


@_shows(_BY_TYPE)
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Two folders followed into one table, each with a checkpoint of its own, one of them started twice."""
    t, at = _new(spark, "events"), scratch(spark, "stream")
    for k in range(2):
        table(spark, d, "events").where(f"event_id % 2 = {k}").select("event_id", "event_type").coalesce(2).write.json(f"{at}/in{k}")
        for _ in range(2 - k):
            follow_json(t, f"{at}/in{k}/*.json", f"{at}/checkpoint{k}", available_now=True).awaitTermination()
    return t.query(QuerySpec(groups=("event_type",), limit=None, read_log=True))


@_shows(f"with {_E} select time // 86400 * 86400 as time_bucket, event_type, count(*) as \"Count\", avg(value) as value from e group by 1, 2")
def stream_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The streaming roll-up over a folder that is read in several batches."""
    at = scratch(spark, "stream")
    rows = events(spark, d).select("time", "event_type", "value")
    rows.repartition(3).write.parquet(f"{at}/in")
    rolled = rollup_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), "time", 86400, ["event_type"], "value")
    name = "rolled_" + at.rsplit("-", 1)[1]
    rolled.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
