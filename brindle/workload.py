"""Queries that show each operator on the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.icc import icc
from brindle.plans import compile as plan
from brindle.plans.builder import Query
from brindle.plans.compile import compile_query
from brindle.plans.spec import QuerySpec
from brindle.session import scratch
from brindle.sources import ingest
from brindle.sources.model import to_model
from brindle.sources.storage import Table
from brindle.sources.tables import table

ALL = None

# -- tables in the three-type model ------------------------------------------------------------------


def events(spark: SparkSession, d: str) -> DataFrame:
    return to_model(table(spark, d, "events")).withColumnRenamed("ts", "time")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return to_model(table(spark, d, "orders"))


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return to_model(table(spark, d, "lineitem"))


def part(spark: SparkSession, d: str) -> DataFrame:
    return to_model(table(spark, d, "part"), words=F.split("p_name", " "))


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return to_model(table(spark, d, "host_generator"))


_E = "e as (select event_type, user_id, cast(trunc(value) as bigint) as value, cast(floor(epoch(ts)) as bigint) as time, props from events)"
_L = "l as (select l_returnflag, l_linestatus, l_linenumber, cast(trunc(l_quantity) as bigint) as l_quantity, cast(trunc(l_extendedprice) as bigint) as l_extendedprice from lineitem)"
_O = "o as (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, cast(trunc(o_totalprice) as bigint) as o_totalprice from orders)"
_N = 'count(*) as "Count", count(*) as "Samples"'


def _mean(c: str) -> str:
    return f"cast(sum({c}) as double) / nullif(count({c}), 0) as {c}"


def _spec(source: Callable[[SparkSession, str], DataFrame], **spec) -> Callable[[SparkSession, str], DataFrame]:
    """A query of flags over a table."""
    given = QuerySpec.from_flags({"limit": "all", **{k.replace("_", "-"): v for k, v in spec.items()}})
    return lambda spark, d: compile_query(given, source(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


# -- groups, counts, means, weights ---------------------------------------------------------------------
_add("group_avg", _spec(events, group="event_type", int="value"), f"with {_E} select event_type, {_mean('value')}, {_N} from e group by 1")
_add("global_total", _spec(lineitem, int="l_quantity"), f"with {_L} select {_mean('l_quantity')}, {_N} from l")
_add("global_total_empty", _spec(lineitem, int="l_quantity", int_filter="l_quantity:gt:1000000"), f"with {_L} select {_mean('l_quantity')}, {_N} from l where l_quantity > 1000000 having count(*) > 0")
_add("group_multi", _spec(lineitem, group="l_returnflag,l_linenumber", int="l_quantity,l_extendedprice"), f"with {_L} select l_returnflag, cast(l_linenumber as varchar) as l_linenumber, {_mean('l_quantity')}, {_mean('l_extendedprice')}, {_N} from l group by 1, 2")
_add("group_missing", _spec(hosts, group="status", int="ping"), f"select coalesce(status, '') as status, {_mean('ping')}, {_N} from host_generator group by 1")
_add("weighted_avg", _spec(lineitem, group="l_returnflag", int="l_extendedprice", weight_col="l_quantity"), f'with {_L} select l_returnflag, cast(sum(l_extendedprice * l_quantity) as double) / sum(l_quantity) as l_extendedprice, cast(sum(l_quantity) as bigint) as "Count", count(*) as "Samples" from l group by 1')
_add("weighted_avg_missing", _spec(hosts, group="host", int="ping", weight_col="weight"), 'select coalesce(host, \'\') as host, cast(sum(ping * coalesce(weight, 1)) as double) / nullif(sum(coalesce(weight, 1)) filter (ping is not null), 0) as ping, cast(sum(coalesce(weight, 1)) as bigint) as "Count", count(*) as "Samples" from host_generator group by 1')
_add("grand_total", lambda spark, d: Query(orders(spark, d)).group_by("o_orderpriority").aggregate("o_totalprice").totals().limit(ALL).run(), f"with {_O} select coalesce(o_orderpriority, '') as o_orderpriority, {_mean('o_totalprice')}, {_N}, grouping(o_orderpriority) = 1 as is_total from o group by grouping sets ((o_orderpriority), ())")

# -- filters -----------------------------------------------------------------------------------------------
for _op, _sql in (("gt", ">"), ("lt", "<"), ("eq", "="), ("neq", "<>")):
    _add(f"filter_int_{_op}", _spec(lineitem, group="l_returnflag", int="l_quantity", int_filter=f"l_linenumber:{_op}:3"), f"with {_L} select l_returnflag, {_mean('l_quantity')}, {_N} from l where l_linenumber {_sql} 3 group by 1")
    _add(f"filter_int_{_op}_missing", _spec(hosts, group="status", int_filter=f"ping:{_op}:40"), f"select coalesce(status, '') as status, {_N} from host_generator where ping {_sql} 40 group by 1")
for _op, _sql in (("eq", "="), ("neq", "<>")):
    _add(f"filter_str_{_op}", _spec(orders, group="o_orderstatus", str_filter=f"o_orderpriority:{_op}:2-HIGH"), f"with {_O} select o_orderstatus, {_N} from o where o_orderpriority {_sql} '2-HIGH' group by 1")
    _add(f"filter_str_{_op}_missing", _spec(hosts, str_filter=f"status:{_op}:200"), f"select {_N} from host_generator where status {_sql} '200' having count(*) > 0")
for _op, _sql in (("re", ""), ("nre", "not ")):
    _add(f"filter_str_{_op}", _spec(part, group="p_brand", int="p_size", str_filter=f"p_name:{_op}:^[a-m].*e"), f"select p_brand, {_mean('p_size')}, {_N} from part where {_sql}regexp_matches(p_name, '^[a-m].*e') group by 1")
    _add(f"filter_str_{_op}_missing", _spec(hosts, group="status", str_filter=f"host:{_op}:^edge.*example$"), f"select coalesce(status, '') as status, {_N} from host_generator where {_sql}regexp_matches(host, '^edge.*example$') group by 1")
for _op, _sql in (("in", ""), ("nin", "not ")):
    _add(f"filter_set_{_op}", _spec(part, group="p_brand", int="p_size", set_filter=f"words:{_op}:red"), f"select p_brand, {_mean('p_size')}, {_N} from part where {_sql}list_contains(string_split(p_name, ' '), 'red') group by 1")
    _add(f"filter_set_{_op}_missing", _spec(hosts, group="status", int="ping", set_filter=f"groups:{_op}:mod2"), f"select coalesce(status, '') as status, {_mean('ping')}, {_N} from host_generator where groups is not null and {_sql}coalesce(list_contains(groups, 'mod2'), false) group by 1")
_add("filter_combined", _spec(orders, group="o_orderstatus", int="o_totalprice", int_filter="o_totalprice:gt:100000,o_custkey:lt:900", str_filter="o_orderpriority:re:^[12],o_orderstatus:neq:P"), f"with {_O} select o_orderstatus, {_mean('o_totalprice')}, {_N} from o where o_totalprice > 100000 and o_custkey < 900 and regexp_matches(o_orderpriority, '^[12]') and o_orderstatus <> 'P' group by 1")
_add("filter_other_table", lambda spark, d: compile_query(QuerySpec.from_flags({"group": "o_orderstatus", "limit": "all", "int-filter": "o_custkey:lt:5:elsewhere,o_custkey:lt:100:orders"}), orders(spark, d), table_name="orders"), f"with {_O} select o_orderstatus, {_N} from o where o_custkey < 100 group by 1")
_add("str_replace_group", _spec(part, group="p_brand", int="p_size", str_replace="p_brand:Brand#([0-9])[0-9]:B$1"), f"select regexp_replace(p_brand, 'Brand#([0-9])[0-9]', 'B\\1', 'g') as p_brand, {_mean('p_size')}, {_N} from part group by 1")
_add("str_replace_filter", _spec(hosts, group="host", str_replace="host:[0-9]+:N", str_filter="host:re:^edge-N"), f"select regexp_replace(host, '[0-9]+', 'N', 'g') as host, {_N} from host_generator where regexp_matches(regexp_replace(host, '[0-9]+', 'N', 'g'), '^edge-N') group by 1")

# -- time ---------------------------------------------------------------------------------------------------
_add("time_rollup", _spec(events, group="event_type", int="value", time=True, time_bucket=3600), f"with {_E} select event_type, time // 3600 * 3600 as time_bucket, {_mean('value')}, {_N} from e group by 1, 2")
_add("time_rollup_topk", _spec(events, group="user_id", int="value", time=True, time_bucket=86400, limit=5), f"with {_E}, k as (select user_id from e group by 1 order by count(*) desc, cast(user_id as varchar) limit 5) select cast(user_id as varchar) as user_id, time // 86400 * 86400 as time_bucket, {_mean('value')}, {_N} from e where user_id in (select user_id from k) group by 1, 2")
_add("time_rollup_topk_mean", _spec(events, group="user_id", int="value", time=True, time_bucket=86400, limit=5, sort="value"), f"with {_E}, k as (select user_id from e group by 1 order by cast(sum(value) as double) / count(value) desc, cast(user_id as varchar) limit 5) select cast(user_id as varchar) as user_id, time // 86400 * 86400 as time_bucket, {_mean('value')}, {_N} from e where user_id in (select user_id from k) group by 1, 2")
_add("time_rollup_negative", _spec(hosts, time=True, time_bucket=604800), f"select time // 604800 * 604800 as time_bucket, {_N} from host_generator where time is not null group by 1")
_add("time_filter_aligned", _spec(events, int="value", time=True, time_bucket=86400, int_filter="time:gt:1704500000"), f"with {_E} select time // 86400 * 86400 as time_bucket, {_mean('value')}, {_N} from e where time > 1704500000 // 86400 * 86400 group by 1")

# -- distinct -----------------------------------------------------------------------------------------------
_add("distinct_tuple_tabs", lambda spark, d: compile_query(QuerySpec(op="distinct", distincts=("x", "y"), exact_distinct=True, limit=None), events(spark, d).selectExpr("concat(event_type, if(user_id % 2 = 0, '\t', ''), 'a') as x", "concat(if(user_id % 2 = 0, '', '\t'), cast(user_id as string)) as y")), "select count(*) as \"Distinct\", count(*) as \"Count\" from (select distinct event_type, user_id from events)")
_add("distinct_tuple", _spec(events, distinct="event_type,user_id", op="distinct", exact_distinct=True), f"with {_E}, x as (select count(distinct concat_ws(chr(9), event_type, cast(user_id as varchar))) as n from e) select n as \"Distinct\", n as \"Count\" from x")
_add("distinct_missing", _spec(hosts, group="status", distinct="host", op="distinct", exact_distinct=True), "select coalesce(status, '') as status, count(distinct coalesce(host, '')) as \"Distinct\", count(distinct coalesce(host, '')) as \"Count\" from host_generator group by 1")
_add("distinct_by_group", _spec(events, group="event_type", distinct="user_id", op="distinct", exact_distinct=True), f"with {_E} select event_type, count(distinct user_id) as \"Distinct\", count(distinct user_id) as \"Count\" from e group by 1")
_add("distinct_time", _spec(events, distinct="user_id", op="distinct", exact_distinct=True, time=True, time_bucket=86400), f"with {_E} select time // 86400 * 86400 as time_bucket, count(distinct user_id) as \"Distinct\", count(distinct user_id) as \"Count\" from e group by 1")
_add("distinct_approx", _spec(events, group="event_type", distinct="user_id", op="distinct"))
_add("distinct_limit", _spec(hosts, group="status", distinct_limit=5))

# -- order and limit ------------------------------------------------------------------------------------------
_add("sort_by_count", _spec(hosts, group="host", limit=10), f"select coalesce(host, '') as host, {_N} from host_generator group by 1 order by 2 desc, 1 limit 10")
_add("sort_by_count_asc", _spec(hosts, group="host", limit=10, sort_asc=True), f"select coalesce(host, '') as host, {_N} from host_generator group by 1 order by 2, 1 limit 10")
_add("sort_by_mean_desc", _spec(orders, group="o_custkey", int="o_totalprice", sort="o_totalprice", limit=20), f"with {_O} select cast(o_custkey as varchar) as o_custkey, {_mean('o_totalprice')}, {_N} from o group by 1 order by 2 desc, 1 limit 20")
_add("sort_by_mean_asc", _spec(orders, group="o_custkey", int="o_totalprice", sort="o_totalprice", sort_asc=True, limit=20), f"with {_O} select cast(o_custkey as varchar) as o_custkey, {_mean('o_totalprice')}, {_N} from o group by 1 order by 2, 1 limit 20")
_add("samples", _spec(orders, samples=True, sort="o_orderkey", sort_asc=True, limit=25, sample_cols="o_orderkey,o_orderstatus,o_totalprice", int_filter="o_totalprice:gt:200000"), f"with {_O} select o_orderkey, o_orderstatus, o_totalprice from o where o_totalprice > 200000 order by o_orderkey limit 25")
_add("samples_sorted", _spec(orders, samples=True, sort="o_orderkey", limit=10, int="o_orderkey", str="o_orderpriority"), f"with {_O} select o_orderkey, o_orderpriority from o order by o_orderkey desc limit 10")

# -- histograms -------------------------------------------------------------------------------------------------


def _exploded(column: str, groups: list[str], source, **spec) -> Callable[[SparkSession, str], DataFrame]:
    run = _spec(source, op="hist", int=column, group=",".join(groups), **spec)
    return lambda spark, d: run(spark, d).select(*groups, F.posexplode(f"{column}.percentiles").alias("ip", "v"))


def _bucketed(column: str, groups: list[str], source, **spec) -> Callable[[SparkSession, str], DataFrame]:
    run = _spec(source, op="hist", int=column, group=",".join(groups), **spec)
    return lambda spark, d: run(spark, d).select(*groups, F.explode(f"{column}.buckets").alias("edge", "n"))


_LAYOUT = """m as (select min(v) as mn, max(v) as mx from t), p as (select mn, mx,
  case when (mx - mn) // 1000 > 0 then (mx - mn) // 1000 when mx - mn < 100 then 1 else (mx - mn) // 100 end as bs,
  case when (mx - mn) // 1000 > 0 then 1000 when mx - mn < 100 then mx - mn else (mx - mn) // ((mx - mn) // 100) end + 2 as n from m)"""
# extents without outliers: values by sign and digits; classes at an end with at most one value in 200 are left out
_ROBUST = """cl as (select case when v < 0 then 1 - length(cast(v as varchar)) else length(cast(v as varchar)) end as size, count(*) as n, min(v) as a, max(v) as z from t where v is not null group by 1),
  cu as (select *, sum(n) over (order by size) as up, sum(n) over (order by size desc) as down, sum(n) over () as total from cl),
  m as (select min(a) as mn, max(z) as mx from cu where up * 200 > total and down * 200 > total)"""
_LAYOUT_ROBUST = _LAYOUT.replace("m as (select min(v) as mn, max(v) as mx from t)", _ROBUST)
_BUCKETS_ROBUST = _LAYOUT_ROBUST + ", b as (select g, greatest(0, least((v - mn) // bs, n - 1)) * bs + mn as edge, sum(w) as c from t, p where v is not null group by 1, 2)"
_BUCKETS = _LAYOUT + ", b as (select g, least((v - mn) // bs, n - 1) * bs + mn as edge, sum(w) as c from t, p where v is not null group by 1, 2)"
_PERCENT = """, x as (select g, edge, c, 100 * sum(c) over (partition by g order by edge) // sum(c) over (partition by g) as pk from b),
i as (select unnest(range(0, 100)) as ip) select g as {g}, cast(ip as integer) as ip, cast(min(edge) as bigint) as v from x, i where pk > ip group by g, ip"""
_add("hist_percentiles", _exploded("value", ["event_type"], events), f"with {_E}, t as (select value as v, event_type as g, 1 as w from e), {_BUCKETS}{_PERCENT.format(g='event_type')}")
_add("hist_percentiles_missing", _exploded("ping", ["status"], hosts, skip_outliers=True), f"with t as (select ping as v, coalesce(status, '') as g, 1 as w from host_generator), {_BUCKETS_ROBUST}{_PERCENT.format(g='status')}")
_add("hist_percentiles_weighted", _exploded("l_extendedprice", ["l_returnflag"], lineitem, weight_col="l_quantity"), f"with {_L}, t as (select l_extendedprice as v, l_returnflag as g, l_quantity as w from l), {_BUCKETS}{_PERCENT.format(g='l_returnflag')}")
_add("hist_buckets", _bucketed("l_extendedprice", ["l_returnflag"], lineitem), f"with {_L}, t as (select l_extendedprice as v, l_returnflag as g, 1 as w from l), {_BUCKETS} select g as l_returnflag, cast(cast(edge as bigint) as varchar) as edge, cast(c as bigint) as n from b")
_add("hist_int_bucket", _bucketed("l_extendedprice", ["l_linestatus"], lineitem, int_bucket=5000), f"with {_L}, m as (select min(l_extendedprice) as mn from l) select l_linestatus, cast(least((l_extendedprice - mn) // 5000, 1001) * 5000 + mn as varchar) as edge, count(*) as n from l, m group by 1, 2")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    h = _spec(lineitem, op="hist", int="l_extendedprice", group="l_returnflag")(spark, d)
    x = "l_extendedprice"
    return h.select("l_returnflag", F.round(f"{x}.stddev", 3).alias("stddev"), F.round(f"{x}.avg", 4).alias("avg"), f"{x}.sum", F.col(f"{x}.samples").alias("samples"), "Count", "Samples").toDF("l_returnflag", "stddev", "avg", "sum", "n_samples", "Count", "Samples")


_add("hist_stats", _stats, f"with {_L}, t as (select l_extendedprice as v, l_returnflag as g, 1 as w from l), {_BUCKETS}, a as (select g, cast(sum(v) as double) as s, count(v) as k, cast(sum(v) as double) / count(v) as av from t group by 1) select a.g as l_returnflag, round(sqrt(sum(c * (edge - av) * (edge - av)) / sum(c)), 3) as stddev, round(av, 4) as avg, s as sum, k as n_samples, k as \"Count\", k as \"Samples\" from a join b on a.g = b.g group by a.g, av, s, k")
_RANGES = """m as (select min(v) as mn, max(v) as mx from t),
r(step, size, lo, hi) as (
  select mx - mn, (mx - mn) // 2, mx - (mx - mn) // 2, mx from m where mx - mn > 1000
  union all select step // 2, size // 2, lo - size // 2, lo from r where step // 2 > 1000),
q as (select lo, hi from r union all select (select mn from m), coalesce((select min(lo) from r), (select mx from m))),
p as (select lo, hi, case when (hi - lo) // 1000 > 0 then (hi - lo) // 1000 when hi - lo < 100 then 1 else (hi - lo) // 100 end as bs,
  case when (hi - lo) // 1000 > 0 then 1000 when hi - lo < 100 then hi - lo else (hi - lo) // ((hi - lo) // 100) end + 2 as n from q),
b as (select g, least((v - lo) // bs, n - 1) * bs + lo as edge, sum(w) as c from t, p, m where v >= lo and (v < hi or hi = mx) group by 1, 2)"""
_add("loghist_percentiles", _exploded("o_totalprice", ["o_orderstatus"], orders, loghist=True), f"with recursive {_O}, t as (select o_totalprice as v, o_orderstatus as g, 1 as w from o), {_RANGES}{_PERCENT.format(g='o_orderstatus')}")
_add("loghist_buckets", _bucketed("ping", ["status"], hosts, loghist=True), f"with recursive t as (select ping as v, coalesce(status, '') as g, 1 as w from host_generator where ping is not null), {_RANGES} select g as status, cast(cast(edge as bigint) as varchar) as edge, cast(c as bigint) as n from b")
_add("hist_time", lambda spark, d: _spec(events, op="hist", int="value", time=True, time_bucket=86400)(spark, d).select("time_bucket", F.posexplode("value.percentiles").alias("ip", "v")), f"with {_E}, t as (select value as v, time // 86400 * 86400 as g, 1 as w from e), {_BUCKETS}{_PERCENT.format(g='time_bucket')}")


def _sketched(spark: SparkSession, d: str) -> DataFrame:
    """The sketch alternative to a histogram: mergeable quantiles with bounded rank error."""
    return _spec(hosts, op="hist", tdigest=True, int="ping", group="status")(spark, d).select("status", F.posexplode("ping.percentiles").alias("ip", "v"))


_add("tdigest_quantiles", _sketched)

# -- sources, sinks, partial results ---------------------------------------------------------------------------------


def _scratch_table(spark: SparkSession, name: str) -> Table:
    return Table(spark, scratch(spark, "tables"), name)


def _json_flatten(spark: SparkSession, d: str) -> DataFrame:
    flat = ingest.from_json_strings(table(spark, d, "events").select(F.concat(F.lit('{"props":'), "props", F.lit("}")).alias("value")), "value")
    return compile_query(QuerySpec(groups=("props_k",), limit=ALL), flat)


_add("json_flatten", _json_flatten, f"select coalesce(props->>'$.k', '') as props_k, {_N} from events group by 1")


def _read_log_union(spark: SparkSession, d: str) -> DataFrame:
    """Half of the orders digested into blocks, the other half still in the log."""
    t, rows = _scratch_table(spark, "orders"), table(spark, d, "orders")
    t.ingest(rows.where("o_orderstatus = 'F'"), compact=False)
    t.digest("o_orderdate")
    t.ingest(rows.where("o_orderstatus != 'F'"), compact=False)
    return t.query(QuerySpec(groups=("o_orderstatus",), ints=("o_totalprice",), limit=ALL, read_log=True))


_add("read_log_union", _read_log_union, f"with {_O} select o_orderstatus, {_mean('o_totalprice')}, {_N} from o group by 1")


def _json_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines, ingested, digested, queried."""
    t = _scratch_table(spark, "events")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("time"))
    rows.write.json(f"{t.path}-json")
    t.ingest_json(f"{t.path}-json", compact=False)
    t.digest()
    return t.query(QuerySpec(groups=("event_type",), ints=("value",), limit=ALL))


_add("json_ingest_digest", _json_ingest, f"with {_E} select event_type, {_mean('value')}, {_N} from e group by 1")


def _csv_ingest(spark: SparkSession, d: str) -> DataFrame:
    t = _scratch_table(spark, "customers")
    table(spark, d, "customer").write.option("header", True).csv(f"{t.path}-csv")
    t.ingest_csv(f"{t.path}-csv", compact=False)
    return t.query(QuerySpec(groups=("c_mktsegment",), ints=("c_acctbal",), limit=ALL, read_log=True))


_add("csv_ingest", _csv_ingest, f"with c as (select c_mktsegment, cast(trunc(c_acctbal) as bigint) as c_acctbal from customer) select c_mktsegment, {_mean('c_acctbal')}, {_N} from c group by 1")


def _export(spark: SparkSession, d: str) -> DataFrame:
    t = _scratch_table(spark, "hosts")
    t.ingest(table(spark, d, "host_generator"), compact=False)
    t.digest()
    t.export(f"{t.path}-tsv", QuerySpec.from_flags({"int-filter": "ping:gt:100"}))
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{t.path}-tsv")
    return back.groupBy("groups").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ping").cast("bigint")).alias("ping"))


_add("export_tsv", _export, "select cast(to_json(groups) as varchar) as groups, count(*) as n, cast(sum(ping) as bigint) as ping from host_generator where ping > 100 group by groups")


def _partial_merge(spark: SparkSession, d: str) -> DataFrame:
    """Partial results of four slices of the rows, merged."""
    rows = lineitem(spark, d)
    spec = QuerySpec(op="hist", groups=("l_returnflag",), ints=("l_extendedprice",), limit=ALL)
    ext = plan.extents(rows, spec.ints)
    parts = [plan.state(spec, rows.where(F.pmod(F.col("l_orderkey"), F.lit(4)) == k), ext) for k in range(4)]
    return plan.finish(spec, plan.merge(spec, *parts)).select("l_returnflag", F.posexplode("l_extendedprice.percentiles").alias("ip", "v"))


_add("partial_merge", _partial_merge, f"with {_L}, t as (select l_extendedprice as v, l_returnflag as g, 1 as w from l), {_BUCKETS}{_PERCENT.format(g='l_returnflag')}")


def _cached(spark: SparkSession, d: str) -> DataFrame:
    """A query from kept partial results of two blocks."""
    t, rows = _scratch_table(spark, "hosts"), table(spark, d, "host_generator")
    for where in ("load_no <= 3", "load_no > 3"):
        t.ingest(rows.where(where), compact=False)
        t.digest()
    spec = QuerySpec(groups=("status",), ints=("ping",), limit=ALL)
    t.query(spec, cache=True).count()
    return t.query(spec, cache=True)


_add("query_cache", _cached, f"select coalesce(status, '') as status, {_mean('ping')}, {_N} from host_generator group by 1")


def _info(spark: SparkSession, d: str) -> DataFrame:
    t = _scratch_table(spark, "hosts")
    t.ingest(table(spark, d, "host_generator"), compact=False)
    t.digest()
    info = t.info()
    return spark.createDataFrame([(info["count"], *[",".join(info["columns"][k]) for k in ("ints", "strs", "sets")])], "count bigint, ints string, strs string, sets string")


_add("table_info", _info, "select count(*) as count, 'index_int,load_no,loaded_at,ping,time,weight' as ints, 'host,index_str,status' as strs, 'groups' as sets from host_generator")


def _trim(spark: SparkSession, d: str) -> DataFrame:
    """Rows left after the blocks that only hold times before a day were deleted."""
    t, rows = _scratch_table(spark, "events"), events(spark, d)
    day = rows.agg(F.min("time")).first()[0] // 86400 * 86400 + 86400
    for where in (F.col("time") < day, F.col("time") >= day):
        t.ingest(rows.where(where), compact=False)
        t.digest()
    t.trim("time", before=day, delete=True)
    return t.query(QuerySpec(groups=("event_type",), limit=ALL))


_add("trim_before", _trim, f"with {_E} select event_type, {_N} from e where time >= (select min(time) // 86400 * 86400 + 86400 from e) group by 1")
# the mean squares of pings with sentinels have 15 digits and more: their logarithms are compared
_add("icc", lambda spark, d: icc(hosts(spark, d), ["status"], "ping").select("n", "k", F.round(F.log10("ms_between"), 5).alias("log_between"), F.round(F.log10("ms_within"), 5).alias("log_within"), F.round("icc", 5).alias("icc")), "with v as (select status, ping from host_generator where ping is not null), g as (select status, count(*) as n, avg(ping) as m, var_pop(ping) as s from v group by 1), a as (select sum(n) as n, count(*) as k, sum(n * m) / sum(n) as mm, sum(n * m * m) as q, sum(n * s) as w from g), f as (select n, k, (q - n * mm * mm) / (k - 1) as b, w / (n - k) as w from a) select cast(n as bigint) as n, k, round(log10(b), 5) as log_between, round(log10(w), 5) as log_within, round(b / (b + w), 5) as icc from f")

# -- the 15 shapes of the host workload ---------------------------------------------------------------------------------
_H = "h as (select coalesce(host, '') as host, coalesce(status, '') as status, host as h0, ping, time from host_generator)"
_add("w01_count", _spec(hosts), f"select {_N} from host_generator")
_add("w02_avg", _spec(hosts, int="ping"), f"select {_mean('ping')}, {_N} from host_generator")
_add("w03_hist", lambda spark, d: _spec(hosts, op="hist", int="ping", skip_outliers=True)(spark, d).select(F.posexplode("ping.percentiles").alias("ip", "v")), f"with t as (select ping as v, 0 as g, 1 as w from host_generator where ping is not null), {_BUCKETS_ROBUST}{_PERCENT.format(g='gg').replace('g as gg, ', '')}")
_add("loghist_total", lambda spark, d: _spec(hosts, op="hist", int="ping", loghist=True)(spark, d).select(F.posexplode("ping.percentiles").alias("ip", "v")), f"with recursive t as (select ping as v, 0 as g, 1 as w from host_generator where ping is not null), {_RANGES}{_PERCENT.format(g='gg').replace('g as gg, ', '')}")
_add("w04_avg_6h", _spec(hosts, int="ping", time=True, time_bucket=21600), f"select time // 21600 * 21600 as time_bucket, {_mean('ping')}, {_N} from host_generator where time is not null group by 1")
_add("w05_group_host", _spec(hosts, group="host"), f"with {_H} select host, {_N} from h group by 1")
_add("w06_distinct_host", _spec(hosts, op="distinct", distinct="host"))
_add("distinct_host_exact", _spec(hosts, op="distinct", distinct="host", exact_distinct=True), f"with {_H} select count(distinct host) as \"Distinct\", count(distinct host) as \"Count\" from h")
_add("w07_distinct_host_6h", _spec(hosts, op="distinct", distinct="host", time=True, time_bucket=21600))
_add("distinct_host_6h_exact", _spec(hosts, op="distinct", distinct="host", exact_distinct=True, time=True, time_bucket=21600), f"with {_H} select time // 21600 * 21600 as time_bucket, count(distinct host) as \"Distinct\", count(distinct host) as \"Count\" from h where time is not null group by 1")
_add("w08_avg_host", _spec(hosts, group="host", int="ping"), f"with {_H} select host, {_mean('ping')}, {_N} from h group by 1")
_add("w09_avg_host_limit", _spec(hosts, group="host", int="ping", limit=10), f"with {_H} select host, {_mean('ping')}, {_N} from h group by 1 order by count(*) desc, host limit 10")
_add("w10_hist_host", _exploded("ping", ["host"], hosts, skip_outliers=True), f"with {_H}, t as (select ping as v, host as g, 1 as w from h), {_BUCKETS_ROBUST}{_PERCENT.format(g='host')}")
_add("w11_avg_host_regex", _spec(hosts, group="host", int="ping", str_filter="host:re:^(web|db)[0-9]+"), f"with {_H} select host, {_mean('ping')}, {_N} from h where regexp_matches(h0, '^(web|db)[0-9]+') group by 1")
_add("w12_group_host_status", _spec(hosts, group="host,status"), f"with {_H} select host, status, {_N} from h group by 1, 2")
_add("w13_avg_host_status", _spec(hosts, group="host,status", int="ping"), f"with {_H} select host, status, {_mean('ping')}, {_N} from h group by 1, 2")
for _name, _k in (("w14_series_10", 10), ("w15_series_100", 100)):
    _add(_name, _spec(hosts, group="host", int="ping", time=True, time_bucket=21600, limit=_k), f"with {_H}, k as (select host from h where time is not null group by 1 order by count(*) desc, host limit {_k}) select host, time // 21600 * 21600 as time_bucket, {_mean('ping')}, {_N} from h where time is not null and host in (select host from k) group by 1, 2")
