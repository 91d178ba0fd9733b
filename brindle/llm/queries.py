"""The pN_ queries of the operators in this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import stage
from brindle.sources.tables import table, utc_day

from . import cardinality, frequent, languages, leaks, percentiles, tokens

P1_KEYS = ["host", "status"]
P1_LEVELS = {"host": ["host"], "status": ["status"], "host_status": ["host", "status"]}
P3_KEYS = ["utc_day", "country"]
P3_LEVELS = {"day": ["utc_day"], "country": ["country"], "day_country": ["utc_day", "country"]}


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of host_generator.ping per host, per status and per both, exact."""
    return percentiles.percentiles(table(spark, d, "host_generator"), "ping", P1_KEYS, P1_LEVELS)


def p1_merged_loads(spark: SparkSession, d: str) -> DataFrame:
    """The same from partial results that are kept per load_no and combined."""
    kept = stage(percentiles.value_counts(table(spark, d, "host_generator"), "ping", P1_KEYS, ["load_no"]), "p1-loads")
    return percentiles.from_counts(percentiles.merge(kept, keys=P1_KEYS), P1_KEYS, P1_LEVELS)


def p1_by_load(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of ping per load and status."""
    return percentiles.percentiles(table(spark, d, "host_generator"), "ping", ["load_no", "status"], {"load_status": ["load_no", "status"]})


def p2_frequent(spark: SparkSession, d: str) -> DataFrame:
    """Frequent cities, companies (people_generator) and addresses (top500) with their counts."""
    return _frequent(spark, d).select("field", "value", "n", "n_rows")


def p2_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The same with the sketch's own estimate, which is never below the exact count."""
    return _frequent(spark, d)


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    people = frequent.frequent(table(spark, d, "people_generator"), ["city", "company"])
    return people.unionByName(frequent.frequent(table(spark, d, "top500"), ["url"]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d).select("field", "value")


def p3_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct session_id per UTC day of time, per country and per both, with the relative standard error."""
    people = table(spark, d, "people_generator").select("session_id", "country", utc_day("time").alias("utc_day"))
    return cardinality.distinct_counts(people, "session_id", P3_KEYS, P3_LEVELS)


def p3_merged_loads(spark: SparkSession, d: str) -> DataFrame:
    """The same from registers kept per load_no and merged. Most (day, country, load) groups use few of their registers, so rows of used ones are kept, not packed ones."""
    people = table(spark, d, "people_generator").select("session_id", "country", utc_day("time").alias("utc_day"), "load_no")
    kept = stage(cardinality.registers(people, "session_id", [*P3_KEYS, "load_no"]), "p3-loads")
    return cardinality.from_registers(cardinality.merge(kept, keys=P3_KEYS), P3_KEYS, P3_LEVELS)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokens.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts that come back from the ids: the round trip must be exact."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of benchmark items, with the items."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, and into how many documents: every item has a row."""
    items = table(spark, d, "benchmark").select("item_id", "lang", "split_name")
    n = p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.join(n, "item_id", "left").select("item_id", "lang", "split_name", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose label is missing, names no language or a wrong one, or whose text has several languages, with the languages of the text."""
    return languages.wrong_labels(table(spark, d, "documents"), languages.fit(table(spark, d, "lang_samples")))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every passage of every document with its language and confidence."""
    return languages.passage_rows(table(spark, d, "documents"), languages.fit(table(spark, d, "lang_samples")))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The estimated proportions of the languages of every document."""
    return languages.mixture_rows(table(spark, d, "documents"), languages.fit(table(spark, d, "lang_samples")))


def p3_error(spark: SparkSession, d: str) -> DataFrame:
    """Every estimate against the exact count: is it within four standard errors (and one, for small groups)?"""
    people = table(spark, d, "people_generator").select("session_id", "country", utc_day("time").alias("utc_day"))
    near = cardinality.distinct_counts(people, "session_id", P3_KEYS, P3_LEVELS)
    exact = None
    for level, own in P3_LEVELS.items():
        part = people.where("session_id is not null").groupBy(*own).agg(F.countDistinct("session_id").alias("n"))
        part = part.select(F.lit(level).alias("level"), *[F.col(k) if k in own else F.lit(None).cast(people.schema[k].dataType).alias(k) for k in P3_KEYS], "n")
        exact = part if exact is None else exact.unionByName(part)
    both = near.alias("e").join(exact.alias("x"), (F.col("e.level") == F.col("x.level")) & F.col("e.utc_day").eqNullSafe(F.col("x.utc_day")) & F.col("e.country").eqNullSafe(F.col("x.country")))
    within = F.abs(F.col("approx_distinct") - F.col("n")) <= F.greatest(F.lit(1.0), 4 * F.col("std_error") * F.col("n"))
    return both.select("e.level", "e.utc_day", "e.country", "n", within.alias("within"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_percentiles": p1_percentiles,
        "p1_merged_loads": p1_merged_loads,
        "p1_by_load": p1_by_load,
        "p2_found": p2_found,
        "p2_frequent": p2_frequent,
        "p2_estimates": p2_estimates,
        "p3_distinct": p3_distinct,
        "p3_merged_loads": p3_merged_loads,
        "p6_ids": p6_ids,
        "p6_decoded": p6_decoded,
        "p7_found": p7_found,
        "p7_items": p7_items,
        "p8_found": p8_found,
        "p8_passages": p8_passages,
        "p8_mixture": p8_mixture,
        "p3_error": p3_error,
    }


_PERMILLE = ", ".join(f"({p})" for p in percentiles.PERMILLE)
_P1 = f"""
with pick as (select * from (values {_PERMILLE}) t(pm)),
g as (
  select 'host' as level, host, cast(null as varchar) as status, ping from host_generator where ping is not null
  union all select 'status', null, status, ping from host_generator where ping is not null
  union all select 'host_status', host, status, ping from host_generator where ping is not null),
r as (select level, host, status, ping, row_number() over (partition by level, host, status order by ping) as rn,
             count(*) over (partition by level, host, status) as n from g)
select level, host, status, cast(pm as integer) as permille, cast(n as bigint) as n, ping as value, ping as lower, ping as upper,
       cast(0 as bigint) as max_error
from r, pick where rn = greatest(1, (pm * n + 999) // 1000)
"""
_P1_LOAD = f"""
with pick as (select * from (values {_PERMILLE}) t(pm)),
r as (select load_no, status, ping, row_number() over (partition by load_no, status order by ping) as rn,
             count(*) over (partition by load_no, status) as n from host_generator where ping is not null)
select 'load_status' as level, load_no, status, cast(pm as integer) as permille, cast(n as bigint) as n, ping as value, ping as lower,
       ping as upper, cast(0 as bigint) as max_error
from r, pick where rn = greatest(1, (pm * n + 999) // 1000)
"""
_P2 = """
select field, value from (
  select 'city' as field, city as value, count(*) as n from people_generator group by city
  union all select 'company', company, count(*) from people_generator group by company) x
where value is not null and n >= 0.01 * (select count(*) from people_generator)
union all
select 'url', url from top500 where url is not null group by url having count(*) >= 0.01 * (select count(*) from top500)
"""


_P2_COUNTS = """
select field, value, n, n_rows from (
  select 'city' as field, city as value, count(*) as n, (select count(*) from people_generator) as n_rows from people_generator group by city
  union all select 'company', company, count(*), (select count(*) from people_generator) from people_generator group by company
  union all select 'url', url, count(*), (select count(*) from top500) from top500 group by url) x
where value is not null and n >= 0.01 * n_rows
"""
_P3_ERROR = """
with p as (select session_id, country, cast(floor(time / 86400.0) as bigint) as utc_day from people_generator where session_id is not null)
select 'day' as level, utc_day, cast(null as varchar) as country, count(distinct session_id) as n, true as within from p group by utc_day
union all select 'country', null, country, count(distinct session_id), true from p group by country
union all select 'day_country', utc_day, country, count(distinct session_id), true from p group by utc_day, country
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_frequent": _P2_COUNTS, "p3_error": _P3_ERROR, "p1_percentiles": _P1, "p1_merged_loads": _P1, "p1_by_load": _P1_LOAD, "p2_found": _P2, "p6_decoded": "select doc_id, coalesce(text, '') as text from documents"}
