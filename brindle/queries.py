"""The pN_ queries of the general operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import quality, rolling
from brindle.session import scratch
from brindle.sources.tables import table
from brindle.sources.versions import Versions

#: The window of the data (UTC days, both included); times outside it are faulty clocks.
FIRST_DAY, LAST_DAY = "2024-03-04", "2024-04-28"

RULES = {
    ("host_generator", "status"): quality.Rule("value rlike '\\\\A[1-5][0-9]{2}\\\\z'", "value", ("null_rate", "pattern", "distribution")),
    ("people_generator", "city"): quality.Rule(r"value rlike '\\A\\p{Lu}[\\p{L} .\\x27-]*\\z'", None, ("null_rate", "pattern", "distinct")),
    ("host_generator", "index_str"): quality.Rule("value rlike '\\\\A(0|[1-9][0-9]*)\\\\z'"),
    ("host_generator", "time"): quality.Rule("try_cast(value as bigint) between 1709510400 and 1714348799"),
    ("people_generator", "time"): quality.Rule("try_cast(value as bigint) between 1709510400 and 1714348799"),
    ("people_generator", "session_id"): quality.Rule("value not in ('', 'undefined')"),
    ("people_generator", "age"): quality.Rule("try_cast(value as bigint) between 0 and 120", "try_cast(value as bigint) div 10", ("null_rate", "range", "distribution")),
}


def _daily(spark: SparkSession, d: str, by: tuple[str, ...] = ()) -> DataFrame:
    rows = table(spark, d, "host_generator")
    for c in by:  # rows without a load belong to the first one
        low = rows.agg(F.min(c)).first()[0]
        rows = rows.withColumn(c, F.coalesce(c, F.lit(low or 0)))
    return rolling.daily(rows, "host", "time", "ping", FIRST_DAY, LAST_DAY, by)


def in_batches(loads: list[int], later: int = 3) -> list[list[int]]:
    """The loads in order as a history (the first half) and *later* batches of successive loads.

    A change of a kept state costs some seconds of planning whatever its size, so a version stands for a batch of loads."""
    half = (len(loads) + 1) // 2
    rest = loads[half:]
    size = -(-len(rest) // later) or 1
    return [loads[:half], *[rest[k : k + size] for k in range(0, len(rest), size)]]


def _state(spark: SparkSession, d: str) -> DataFrame:
    """The current version of the kept state after all loads in order, batch by batch, with their late days; the last batch is taken back and given again, as a correction would."""
    arrived = Versions(spark, scratch(spark, "arrivals"))
    loads = arrived.write(_daily(spark, d, ("load_no",)).repartition("load_no"), "load_no")
    state = rolling.RollingState(spark, scratch(spark, "rolling"))
    for batch in in_batches(sorted(loads, key=int)):
        rows, name = arrived.read({k: loads[k] for k in batch}, BATCH), ",".join(batch)
        state.load(rows, name)
    if loads:
        state.load(rows, name, -1)
        state.load(rows, name)
    return state.current()


BATCH = T.StructType().add("entity", "string").add("day", "integer").add("n_rows", "long").add("n", "long").add("total", "long")


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Sums and averages of ping over the last 7 and 30 days for every host and day, from the kept state."""
    return rolling.report(_state(spark, d), "host")


def p4_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The same for a history that is there at once: the first version of a state."""
    return rolling.report(rolling.bootstrap(_daily(spark, d)), "host")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Days of the kept state on which the host has no row."""
    return rolling.gaps(_state(spark, d), "host")


P5_FOUND = {"host_generator": ["status"], "people_generator": ["city", "age"]}
P5_ALL = {"host_generator": None, "people_generator": None}


def _counts(spark: SparkSession, d: str, columns: dict[str, list[str] | None], later: int = 3) -> quality.ValueCounts:
    """The kept value counts after the loads of the tables in order, batch by batch; the last load is taken back and given again, as a correction would."""
    kept = quality.ValueCounts(spark, scratch(spark, "value-counts"))
    loads = {name: [r[0] for r in table(spark, d, name).select("load_no").distinct().orderBy("load_no").collect()] for name in columns}  # null, if any, first
    batches = {name: in_batches(of, later) for name, of in loads.items()}

    def delta(name: str, batch: list[int | None]) -> DataFrame:
        known = [x for x in batch if x is not None]
        own = F.col("load_no").between(known[0], known[-1]) if known else F.lit(False)
        if len(known) < len(batch):
            own = own | F.col("load_no").isNull()
        return quality.deltas(table(spark, d, name).where(own), name, columns[name])

    def change(parts: dict[str, list[int | None]], sign: int = 1) -> None:
        out = None
        for name, batch in parts.items():
            part = delta(name, batch)
            out = part if out is None else out.unionByName(part)
        if out is not None:
            kept.change(out, parts, sign)

    for k in range(max(map(len, batches.values()))):
        change({name: of[k] for name, of in batches.items() if k < len(of) and of[k]})
    last = {name: of[-1:] for name, of in loads.items() if of}
    change(last, -1)
    change(last)
    return kept


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d, P5_FOUND).current()
    return quality.findings(quality.compared(counts, RULES, only_classes=True), RULES)


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of host_generator and people_generator, per load, from the kept counts; drift is over the values of texts and width bins of numbers where a rule has no classes."""
    out = quality.compared(_counts(spark, d, P5_ALL, 1).current(), RULES)
    return out.select("table_name", "column_name", "load_no", "n_rows", "n_null", "n_distinct", "least", "greatest", "n_bad", *[F.round(c, 6).alias(c) for c in ("null_rate", "bad_rate", "entropy", "drift")])


def p5_maintained(spark: SparkSession, d: str) -> DataFrame:
    """Profile of all loads together from counts maintained by signed deltas: all loads added, the first one taken back."""
    kept = _counts(spark, d, {"host_generator": ["status", "host"]})
    counts = kept.current()
    first = counts.agg(F.min("load_no")).first()[0]
    kept.change(counts.where(F.col("load_no") == F.lit(first)), {"host_generator": [first]}, -1)
    out = quality.profile(quality.metrics(quality.apply(kept.current()), RULES, by=()), by=())
    return out.select("table_name", "column_name", "n_rows", "n_null", "n_distinct", "n_bad", F.round("entropy", 6).alias("entropy"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p4_rolling": p4_rolling, "p4_bootstrap": p4_bootstrap, "p5_found": p5_found, "p5_profile": p5_profile, "p5_maintained": p5_maintained}


_P4 = """
with daily as (
  select host, cast(time // 86400 as integer) as day, count(*) as n_rows, count(ping) as n, coalesce(sum(ping), 0) as total
  from host_generator where host is not null and time >= 1709510400 and time < 1714348800 group by 1, 2),
ends as (select host, min(day) as a, max(day) as z from daily group by host),
days as (select host, cast(unnest(range(a, z + 1)) as integer) as day from ends),
f as (select d.host, d.day, coalesce(x.n_rows, 0) as n_rows, coalesce(x.n, 0) as n, coalesce(x.total, 0) as total
      from days d left join daily x on d.host = x.host and d.day = x.day)
"""
_P4_ROLLING = _P4 + """, s as (
  select host, day, n_rows,
    sum(total) over (partition by host order by day rows between 6 preceding and current row) as sum_7,
    sum(n) over (partition by host order by day rows between 6 preceding and current row) as n_7,
    sum(total) over (partition by host order by day rows between 29 preceding and current row) as sum_30,
    sum(n) over (partition by host order by day rows between 29 preceding and current row) as n_30 from f)
select host, strftime(date '1970-01-01' + day, '%Y-%m-%d') as day, cast(n_rows as bigint) as n_rows,
  cast(sum_7 as bigint) as sum_7, cast(n_7 as bigint) as n_7, case when n_7 > 0 then cast(sum_7 as double) / n_7 end as avg_7,
  cast(sum_30 as bigint) as sum_30, cast(n_30 as bigint) as n_30, case when n_30 > 0 then cast(sum_30 as double) / n_30 end as avg_30
from s
"""
_P4_FOUND = _P4 + "select host, strftime(date '1970-01-01' + day, '%Y-%m-%d') as gap_day from f where n_rows = 0"

_TIME = "try_cast(v as bigint) between 1709510400 and 1714348799"
_GOOD = {
    ("host_generator", "status"): "regexp_full_match(v, '[1-5][0-9]{2}')",
    ("people_generator", "city"): r"regexp_full_match(v, '\p{Lu}[\p{L} .''-]*')",
    ("people_generator", "age"): "try_cast(v as bigint) between 0 and 120",
    ("host_generator", "index_str"): "regexp_full_match(v, '0|[1-9][0-9]*')",
    ("host_generator", "time"): _TIME,
    ("people_generator", "time"): _TIME,
    ("people_generator", "session_id"): "v not in ('', 'undefined')",
}
_BIN = {"status": "v", "age": "cast(try_cast(v as bigint) // 10 as varchar)"}


def _p5_rows(table_name: str, column: str, numeric: bool = False, text: str | None = None) -> str:
    good, bin_ = _GOOD.get((table_name, column), "true"), _BIN.get(column, "cast(null as varchar)")
    return f"""select '{table_name}' as table_name, '{column}' as column_name, load_no, v, n, {str(numeric).lower()} as numeric, {str((table_name, column) in _GOOD).lower()} as ruled,
      v is not null and coalesce({good}, false) as good, case when v is not null and coalesce({good}, false) then {bin_} end as bin
      from (select load_no, {text or f'cast({column} as varchar)'} as v, count(*) as n from {table_name} group by 1, 2)"""


_P5_LOADS = """
l as (select table_name, column_name, load_no, cast(sum(n) as bigint) as n_rows, cast(coalesce(sum(n) filter (v is null), 0) as bigint) as n_null,
    case when bool_or(ruled) then cast(coalesce(sum(n) filter (v is not null and not good), 0) as bigint) end as n_bad, cast(coalesce(sum(n) filter (good), 0) as bigint) as n_good,
    count(v) as n_distinct, coalesce(sum(n * log2(n)) filter (v is not null), 0) as nlogn,
    case when bool_or(numeric) then cast(min(case when numeric then cast(v as bigint) end) as varchar) else min(v) end as least,
    case when bool_or(numeric) then cast(max(case when numeric then cast(v as bigint) end) as varchar) else max(v) end as greatest
  from r group by 1, 2, 3),
m as (select *, cast(n_null as double) / n_rows as null_rate, case when n_rows > n_null then cast(n_bad as double) / (n_rows - n_null) end as bad_rate,
    first_value(load_no) over w as load1, first_value(n_good) over w as good1, first_value(n_distinct) over w as distinct1
  from l window w as (partition by table_name, column_name order by load_no)),
b as (select table_name, column_name, load_no, bin, sum(n) as k from r where bin is not null group by 1, 2, 3, 4),
q as (select m.table_name, m.column_name, m.load_no, sum(least(b.k * 1.0 / m.n_good, c.k * 1.0 / m.good1)) as shared
  from m join b on m.table_name = b.table_name and m.column_name = b.column_name and m.load_no = b.load_no
  join b c on m.table_name = c.table_name and m.column_name = c.column_name and c.load_no = m.load1 and c.bin = b.bin group by 1, 2, 3),
z as (select m.*, f.null_rate as null1, f.bad_rate as bad1, case when m.n_good > 0 and m.good1 > 0 then greatest(0, 1 - coalesce(q.shared, 0)) end as drift
  from m join m f on f.table_name = m.table_name and f.column_name = m.column_name and f.load_no = m.load1
  left join q on q.table_name = m.table_name and q.column_name = m.column_name and q.load_no = m.load_no)
"""
_P5_FOUND = f"""
with r as ({_p5_rows('host_generator', 'status')} union all {_p5_rows('people_generator', 'city')} union all {_p5_rows('people_generator', 'age', True)}),
{_P5_LOADS}
select table_name, column_name, load_no, 'null_rate' as kind from z where load_no != load1 and null_rate - null1 >= 0.08
union all select table_name, column_name, load_no, 'pattern' from z where load_no != load1 and column_name != 'age' and bad_rate - bad1 >= 0.05
union all select table_name, column_name, load_no, 'range' from z where load_no != load1 and column_name = 'age' and bad_rate - bad1 >= 0.05
union all select table_name, column_name, load_no, 'distribution' from z where load_no != load1 and column_name != 'city' and drift >= 0.25
union all select table_name, column_name, load_no, 'distinct' from z where load_no != load1 and column_name = 'city' and n_distinct < 0.5 * distinct1
"""
_HOST_INTS = ["ping", "weight", "time", "index_int"]
_PEOPLE_INTS = ["time", "time2", "time3", "int_id", "int_canary", "int_canary_2", "int_canary_3", "age", "f1", "f2", "f3"]
_P5_COLUMNS = [
    *[_p5_rows("host_generator", c, c in _HOST_INTS) for c in ("status", "host", "index_str", *_HOST_INTS)],
    _p5_rows("host_generator", "groups", text="cast(to_json(groups) as varchar)"),
    *[_p5_rows("people_generator", c, c in _PEOPLE_INTS) for c in ("name", "session_id", "company", "city", "state", "country", "str_canary", "str_canary2", "str_canary3", *_PEOPLE_INTS)],
    *[_p5_rows(t, "loaded_at") for t in ("host_generator", "people_generator")],
]
# width bins of numbers: the first load's good values by sign and digits; classes at an end that hold at most one value in 200 are outliers
_P5_PROFILE = f"""
with r0 as ({" union all ".join(_P5_COLUMNS)}),
f as (select table_name, column_name, min(load_no) as load_no from r0 where load_no is not null group by 1, 2),
d as (select table_name, column_name, case when v like '-%' then 1 - length(v) else length(v) end as size, sum(n) as n, min(cast(v as bigint)) as a, max(cast(v as bigint)) as z
  from r0 join f using (table_name, column_name, load_no) where numeric and good group by 1, 2, 3),
c as (select *, sum(n) over (partition by table_name, column_name order by size) as up, sum(n) over (partition by table_name, column_name order by size desc) as down,
  sum(n) over (partition by table_name, column_name) as total from d),
e as (select table_name, column_name, min(a) as lo, max(z) as hi, greatest(1, (max(z) - min(a)) // 20 + 1) as w from c where up * 200 > total and down * 200 > total group by 1, 2),
r as (select r0.* exclude (bin), case when not good then null when column_name in ('status', 'age') then bin when not numeric then v
    when e.lo is null then null when cast(v as bigint) < lo then '-1' when cast(v as bigint) > hi then '20' else cast((cast(v as bigint) - lo) // w as varchar) end as bin
  from r0 left join e using (table_name, column_name)),
{_P5_LOADS}
select table_name, column_name, load_no, n_rows, n_null, n_distinct, least, greatest, n_bad, round(null_rate, 6) as null_rate,
  round(bad_rate, 6) as bad_rate, round(case when n_rows > n_null then greatest(0, log2(n_rows - n_null) - nlogn / (n_rows - n_null)) end, 6) as entropy,
  round(drift, 6) as drift from z
"""
_P5_MAINTAINED = """
with h as (select * from host_generator where load_no > (select min(load_no) from host_generator)),
r as (select 'status' as column_name, status as v, count(*) as n, coalesce(regexp_full_match(status, '[1-5][0-9]{2}'), false) as good from h group by status
  union all select 'host', host, count(*), true from h group by host)
select 'host_generator' as table_name, column_name, cast(sum(n) as bigint) as n_rows, cast(coalesce(sum(n) filter (v is null), 0) as bigint) as n_null,
  count(v) as n_distinct, case when column_name = 'status' then cast(coalesce(sum(n) filter (v is not null and not good), 0) as bigint) end as n_bad,
  round(log2(sum(n) filter (v is not null)) - sum(n * log2(n)) filter (v is not null) / sum(n) filter (v is not null), 6) as entropy
from r group by column_name
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": _P4_FOUND, "p4_rolling": _P4_ROLLING, "p4_bootstrap": _P4_ROLLING, "p5_found": _P5_FOUND, "p5_profile": _P5_PROFILE, "p5_maintained": _P5_MAINTAINED}
