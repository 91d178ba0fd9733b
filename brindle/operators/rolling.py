"""Totals and averages over trailing periods, kept as a versioned daily state.

The state has a row per entity and UTC day from the entity's first to its last day, also for days without
activity: the day's own amounts, and per trailing period the totals at the end of that day. A day follows
from the day before::

    total_w(d) = total_w(d - 1) + amount(d) - amount(d - w)

yesterday's totals, today's arrivals, and the amount of the day that expires. ``bootstrap`` runs the
recurrence over a whole history, ``advance`` makes the next version of a state from a batch of arrivals of
any days: it takes yesterday's totals from the state, recomputes the dates from the earliest corrected one
on, and only for entities that have arrivals; every other row is carried over. ``RollingState`` keeps the
versions at a path, in parts of some days each, and writes only the parts that a batch affects.

Rows are first reduced to one per entity and day, map-side, so that an entity with a third of all rows is a
few numbers per task before anything is shuffled; afterwards an entity has at most as many rows as the
window has days.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.tables import utc_day
from brindle.sources.versions import Versions

PERIODS = (7, 30)
OWN = ("n_rows", "n", "total")


def day_number(day: str) -> int:
    """Days since 1970-01-01 of a yyyy-MM-dd string."""
    return (date.fromisoformat(day) - date(1970, 1, 1)).days


def day_text(column: str) -> Column:
    """The yyyy-MM-dd string of a day number."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col(column).cast("int")), "yyyy-MM-dd")


def daily(df: DataFrame, entity: str, time: str, amount: str, first_day: str, last_day: str, by: Sequence[str] = ()) -> DataFrame:
    """*by*, ``entity, day, n_rows, n, total``: rows, non-null amounts and their sum per entity and UTC day.

    Rows with a null entity, a null time or a time outside first_day..last_day (a faulty clock) are left
    out; a null amount is a row without an amount; repeated rows count each time; the empty string is an
    entity; an empty table gives none. Sums are 64-bit: one that doesn't fit raises Spark's overflow error.
    """
    low, high = day_number(first_day) * 86400, (day_number(last_day) + 1) * 86400
    rows = df.where(F.col(entity).isNotNull() & (F.col(time) >= low) & (F.col(time) < high))
    rows = rows.select(*[F.col(c) for c in by], F.col(entity).alias("entity"), utc_day(time).cast("int").alias("day"), F.col(amount).cast("bigint").alias("amount"))
    return rows.groupBy(*by, "entity", "day").agg(F.count(F.lit(1)).alias("n_rows"), F.count("amount").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total"))


def _totals(periods: Sequence[int]) -> list[str]:
    return [f"{k}_{w}" for w in periods for k in ("n", "total")]


def _roll(rows: DataFrame, periods: Sequence[int]) -> DataFrame:
    """The recurrence over each entity's days. rows: entity, day, own amounts, totals, known (the totals are those of the end of the day as the state has it).

    One shuffle, by entity: adding up the rows of a day, filling the days between and all windows keep to it.
    """
    totals = _totals(periods)
    by_day = "over (partition by entity order by day)"
    so_far = "over (partition by entity order by day rows between unbounded preceding and current row)"
    sums = ", ".join([*[f"sum({c}) as {c}" for c in OWN], *[f"max({c}) as {c}" for c in totals], "bool_and(known) as known"])
    days = rows.repartition("entity").groupBy("entity", "day").agg(*map(F.expr, sums.split(", ")))
    days = days.selectExpr("*", f"coalesce(lead(day) {by_day} - 1, day) as until")
    days = days.selectExpr("entity", *OWN, *totals, "known", "day as at", "explode(sequence(day, until)) as day")
    days = days.selectExpr("entity", "day", *[f"if(day = at, {c}, 0) as {c}" for c in OWN], *totals, "day = at and known as known")
    # since: the first day whose totals are not known any more, an arrival or a day without rows that has to be filled
    step = days.selectExpr("*", "min(if(known, null, day)) over (partition by entity) as since")
    moves = []
    for w in periods:
        for kind in ("n", "total"):
            # from since on today's arrivals less the expiring day's, on the day before it yesterday's totals
            moves.append(f"case when day >= since then {kind} - lag({kind}, {w}, 0) {by_day} when day = since - 1 then {kind}_{w} else 0 end as move_{kind}_{w}")
    step = step.selectExpr("*", *moves)
    return step.selectExpr("entity", "day", *OWN, *[f"if(day >= since, sum(move_{c}) {so_far}, {c}) as {c}" for c in totals])


def bootstrap(arrivals: DataFrame, periods: Sequence[int] = PERIODS) -> DataFrame:
    """The first version of the state, from the daily amounts of a whole history."""
    return _roll(_arrivals(arrivals, periods), periods)


def _arrivals(rows: DataFrame, periods: Sequence[int]) -> DataFrame:
    return rows.selectExpr("entity", "day", *OWN, *[f"cast(null as bigint) as {c}" for c in _totals(periods)], "false as known")


def advance(state: DataFrame, arrivals: DataFrame, periods: Sequence[int] = PERIODS) -> DataFrame:
    """The next version: state with the daily amounts of a batch added (late days and signed corrections included).

    An entity's days then reach from its first to its last day in either; a day whose rows a correction
    takes back to 0 stays, as a day without rows.
    """
    old = state.selectExpr("entity", "day", *OWN, *_totals(periods), "true as known")
    return _roll(old.unionByName(_arrivals(arrivals, periods)), periods)


class RollingState:
    """The state at a path, kept as versions; opening the path again, in this process or another, goes on from its current version.

    Parts of the state are spans of ``span`` days. A batch reads the parts from the longest period before the
    earliest affected day on and rewrites those from that day on as far as the longest period reaches past
    the batch's last day; older and later parts stay as they are. ``ends`` has each entity's first and last day.
    """

    def __init__(self, spark: SparkSession, path: str, entity_type: str = "string", periods: Sequence[int] = PERIODS, span: int = 14, keep: int = 2):
        self.periods, self.span = tuple(periods), span
        self.kept = Versions(spark, path, keep)
        self.schema = T.StructType().add("entity", entity_type).add("day", "integer")
        for c in (*OWN, *_totals(self.periods)):
            self.schema = self.schema.add(c, "long")

    def current(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the current one by default."""
        parts = self.kept.get(number)["parts"]
        return self.kept.read({k: p for k, p in parts.items() if k != "ends"}, self.schema)

    def load(self, arrivals: DataFrame, name: str | int | None = None, sign: int = 1) -> int:
        """Apply a batch of daily amounts (sign -1: take it back) as the next version; its number.

        name: what the batch is known by, so that one that is applied again after a failure counts once; the
        same batch may be taken back and given again. arrivals is read three times and should be a written table.
        """

        def how(old: dict) -> tuple[dict[str, str], dict] | None:
            done = old["facts"].get("done", [])
            mark = None if name is None else str(name)
            if mark is not None and (mark in done) == (sign > 0):
                return None
            signed = arrivals if sign > 0 else arrivals.selectExpr("entity", "day", *[f"-{c} as {c}" for c in OWN])
            ends = self.kept.read({k: p for k, p in old["parts"].items() if k == "ends"}, self.schema).selectExpr("entity", "cast(n_rows as int) as first", "day as last")
            mine = signed.groupBy("entity").agg(F.expr("min(day) as a"), F.expr("max(day) as z"))
            both = mine.join(ends, "entity", "left")
            # days without a row between an entity's last day and the batch are filled, and those before its first day
            since, upto = "least(a, last + 1)", f"greatest(z, if(a < first, first - {max(self.periods) - 1}, null))"
            first, last = both.selectExpr(f"min({since})", f"max({upto})").first()
            facts = {"done": [*done, mark] if sign > 0 and mark is not None else [x for x in done if x != mark]}
            if first is None:
                return old["parts"], facts
            longest = max(self.periods)
            state = {int(k): p for k, p in old["parts"].items() if k != "ends"}
            top = (last + longest - 1) // self.span
            near = {str(k): p for k, p in state.items() if (first - longest) // self.span <= k <= top}
            new = advance(self.kept.read(near, self.schema), signed, self.periods) if near else bootstrap(signed, self.periods)
            low = first // self.span
            new = new.where(f"day >= {low * self.span}").selectExpr("*", f"cast(floor(day / {self.span}) as string) as part")
            # the ends are written by the same job, as a part of their own: first day in n_rows, last day in day
            merged = ends.unionByName(mine.selectExpr("entity", "a as first", "z as last")).groupBy("entity").agg(F.expr("cast(min(first) as bigint) as n_rows"), F.expr("max(last) as day"))
            rest = [f"cast(null as bigint) as {c}" for c in new.columns if c not in ("entity", "day", "n_rows", "part")]
            written = self.kept.write(new.unionByName(merged.selectExpr("entity", "day", "n_rows", *rest, "'ends' as part")), "part")
            left = {str(k): p for k, p in state.items() if k < low or k > top}
            return {**left, **written}, facts

        return self.kept.change(how)["number"]


def report(state: DataFrame, entity: str, periods: Sequence[int] = PERIODS) -> DataFrame:
    """*entity*, ``day`` (yyyy-MM-dd), ``n_rows``, and per period ``sum_w`` (0 without amounts), ``n_w``, ``avg_w`` (null without amounts)."""
    cols = []
    for w in periods:
        cols += [F.col(f"total_{w}").alias(f"sum_{w}"), F.col(f"n_{w}"), F.when(F.col(f"n_{w}") > 0, F.col(f"total_{w}") / F.col(f"n_{w}")).alias(f"avg_{w}")]
    return state.select(F.col("entity").alias(entity), day_text("day").alias("day"), "n_rows", *cols)


def gaps(state: DataFrame, entity: str) -> DataFrame:
    """*entity*, ``gap_day``: the days of the state without a row; the first and last day have rows unless a correction took them."""
    return state.where("n_rows = 0").select(F.col("entity").alias(entity), day_text("day").alias("gap_day"))
