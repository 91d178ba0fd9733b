"""A query built step by step; every step gives a new builder."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from brindle.plans.compile import compile_query
from brindle.plans.spec import Filter, QuerySpec, Replace


class Query:
    """``Query(df_or_table).group_by("host").aggregate("ping").limit(10).run()``"""

    def __init__(self, source, spec: QuerySpec = QuerySpec()):
        self.source, self.spec = source, spec

    def _with(self, **change) -> Query:
        return Query(self.source, replace(self.spec, **change))

    def _filter(self, kind: str, op: str, column: str, value) -> Query:
        return self._with(filters=(*self.spec.filters, Filter(kind, column, op, value)))

    def group_by(self, *columns: str) -> Query:
        return self._with(groups=(*self.spec.groups, *columns))

    def aggregate(self, *columns: str) -> Query:
        return self._with(ints=(*self.spec.ints, *columns))

    def hist(self, *columns: str, int_bucket: int = 0) -> Query:
        return self._with(op="hist", int_bucket=int_bucket, ints=tuple(dict.fromkeys((*self.spec.ints, *columns))))

    def log_hist(self, *columns: str) -> Query:
        return self.hist(*columns)._with(loghist=True)

    def distinct(self, *columns: str, exact: bool = False) -> Query:
        return self._with(op="distinct", distincts=columns, exact_distinct=exact)

    def distinct_limit(self, n: int) -> Query:
        return self._with(distinct_limit=n)

    def weight_col(self, column: str) -> Query:
        return self._with(weight_col=column)

    def time_series(self, bucket: int = 3600, column: str = "time") -> Query:
        return self._with(time=True, time_bucket=bucket, time_col=column)

    def order_by(self, column: str, ascending: bool = False) -> Query:
        return self._with(sort=column, sort_asc=ascending)

    def limit(self, n: int | None) -> Query:
        return self._with(limit=n)

    def samples(self, *columns: str) -> Query:
        return self._with(samples=True, sample_cols=columns)

    def read_log(self) -> Query:
        return self._with(read_log=True)

    def totals(self) -> Query:
        return self._with(totals=True)

    def str_replace(self, column: str, pattern: str, replacement: str) -> Query:
        return self._with(replaces=(*self.spec.replaces, Replace(column, pattern, replacement)))

    def int_eq(self, column: str, v: int) -> Query:
        return self._filter("int", "eq", column, v)

    def int_neq(self, column: str, v: int) -> Query:
        return self._filter("int", "neq", column, v)

    def int_gt(self, column: str, v: int) -> Query:
        return self._filter("int", "gt", column, v)

    def int_lt(self, column: str, v: int) -> Query:
        return self._filter("int", "lt", column, v)

    def str_eq(self, column: str, v: str) -> Query:
        return self._filter("str", "eq", column, v)

    def str_neq(self, column: str, v: str) -> Query:
        return self._filter("str", "neq", column, v)

    def str_re(self, column: str, pattern: str) -> Query:
        return self._filter("str", "re", column, pattern)

    def str_nre(self, column: str, pattern: str) -> Query:
        return self._filter("str", "nre", column, pattern)

    def set_in(self, column: str, v: str) -> Query:
        return self._filter("set", "in", column, v)

    def set_nin(self, column: str, v: str) -> Query:
        return self._filter("set", "nin", column, v)

    def run(self) -> DataFrame:
        if isinstance(self.source, DataFrame) or hasattr(self.source, "sparkSession"):
            return compile_query(self.spec, self.source)
        return self.source.query(self.spec)
