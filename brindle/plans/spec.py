"""The query: one table, AND-ed filters, groups, a time bucket, one aggregation op, order and limit.

A ``QuerySpec`` is plain data: it can be parsed from flag strings, checked against a catalog, written as
JSON and read back, and it compiles to a DataFrame (``brindle.plans.compile``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

COUNT = "$COUNT"
INT_OPS = ("gt", "lt", "eq", "neq")
STR_OPS = ("eq", "neq", "re", "nre")
SET_OPS = ("in", "nin")
_OPS = {"int": INT_OPS, "str": STR_OPS, "set": SET_OPS}


class SpecError(ValueError):
    """The query names an unknown column, uses one as another type, or an unknown op."""


@dataclass(frozen=True)
class Filter:
    kind: str  # int, str or set
    column: str
    op: str
    value: str | int
    table: str | None = None  # the filter holds on this table only

    def __post_init__(self) -> None:
        if self.op not in _OPS.get(self.kind, ()):
            raise SpecError(f"unknown {self.kind} filter op {self.op!r}")
        if self.kind == "int":
            try:
                object.__setattr__(self, "value", int(self.value))
            except ValueError:
                object.__setattr__(self, "value", 0)  # a literal that is no number counts as 0


@dataclass(frozen=True)
class Replace:
    column: str
    pattern: str
    replacement: str


@dataclass(frozen=True)
class QuerySpec:
    op: str = "avg"  # avg, hist or distinct
    groups: tuple[str, ...] = ()
    ints: tuple[str, ...] = ()
    strs: tuple[str, ...] = ()
    sets: tuple[str, ...] = ()
    distincts: tuple[str, ...] = ()
    exact_distinct: bool = False
    filters: tuple[Filter, ...] = ()
    replaces: tuple[Replace, ...] = ()
    weight_col: str | None = None
    time: bool = False
    time_col: str = "time"
    time_bucket: int = 3600
    sort: str = COUNT  # $COUNT, an int column (by its mean), or "" for none
    sort_asc: bool = False
    limit: int | None = 100  # None: all groups, in no order
    loghist: bool = False
    tdigest: bool = False
    int_bucket: int = 0
    skip_outliers: bool = False  # hist extents without the few values of the extreme orders of magnitude
    samples: bool = False
    sample_cols: tuple[str, ...] = ()
    distinct_limit: int = -1
    read_log: bool = False
    totals: bool = False

    def __post_init__(self) -> None:
        if self.op == "distinct" and not self.distincts:
            object.__setattr__(self, "distincts", self.groups)
            object.__setattr__(self, "groups", ())
        if self.op not in ("avg", "hist", "distinct"):
            raise SpecError(f"unknown op {self.op!r}")
        if self.distinct_limit > 0:
            object.__setattr__(self, "limit", self.distinct_limit)
        if self.time and self.time_bucket <= 0:
            raise SpecError("time_bucket must be positive")

    # -- flags ---------------------------------------------------------------------------------
    @classmethod
    def from_flags(cls, flags: Mapping[str, object], field_sep: str = ":", filter_sep: str = ",") -> QuerySpec:
        """From flag names and values as on a command line, e.g. {"group": "a,b", "int-filter": "age:gt:20"}."""
        f = {k.replace("-", "_"): v for k, v in flags.items() if v not in (None, "")}
        names = lambda k: tuple(x for x in str(f.get(k, "")).split(filter_sep) if x)
        filters = []
        for kind in ("int", "set", "str"):
            for token in names(f"{kind}_filter"):
                part = token.split(field_sep)
                if len(part) < 3:
                    raise SpecError(f"a filter is col{field_sep}op{field_sep}value: {token!r}")
                filters.append(Filter(kind, part[0], part[1], part[2], part[3] if len(part) > 3 else None))
        replaces = []
        for token in names("str_replace"):
            part = token.split(field_sep)
            if len(part) != 3:
                raise SpecError(f"a replacement is col{field_sep}pattern{field_sep}replacement: {token!r}")
            replaces.append(Replace(*part))
        plain = {k: f[k] for k in ("op", "weight_col", "time_col", "sort") if k in f}
        plain |= {k: int(f[k]) for k in ("time_bucket", "int_bucket", "distinct_limit") if k in f}
        if "limit" in f:
            plain["limit"] = None if f["limit"] == "all" else int(f["limit"])
        plain |= {k: bool(f[k]) for k in ("time", "sort_asc", "loghist", "tdigest", "skip_outliers", "samples", "read_log", "totals", "exact_distinct") if k in f}
        if flags.get("sort") == "":
            plain["sort"] = ""
        return cls(groups=names("group"), ints=names("int"), strs=names("str"), sets=names("set"), distincts=names("distinct"), sample_cols=names("sample_cols"), filters=tuple(filters), replaces=tuple(replaces), **plain)

    # -- JSON ----------------------------------------------------------------------------------
    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> QuerySpec:
        raw = json.loads(text)
        known = {f.name for f in fields(cls)}
        raw = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known}
        raw["filters"] = tuple(Filter(**x) for x in raw.get("filters", ()))
        raw["replaces"] = tuple(Replace(**x) for x in raw.get("replaces", ()))
        return cls(**raw)

    def state_key(self, *more: object) -> str:
        """Names everything that a partial result depends on; order and limit don't."""
        part = asdict(replace(self, sort=COUNT, sort_asc=False, limit=0, read_log=False, totals=False, distinct_limit=-1))
        return hashlib.sha256(json.dumps([part, [str(x) for x in more]], sort_keys=True).encode()).hexdigest()[:32]

    # -- checks --------------------------------------------------------------------------------
    def for_table(self, name: str | None) -> QuerySpec:
        """Without the filters of other tables, and with the time filters rounded down to the bucket in a time query."""
        kept = []
        for x in self.filters:
            if x.table and name and x.table != name:
                continue
            if self.time and x.kind == "int" and x.column == self.time_col:
                v = int(x.value)
                x = replace(x, value=(abs(v) // self.time_bucket * self.time_bucket) * (1 if v >= 0 else -1))
            kept.append(x)
        return replace(self, filters=tuple(kept))

    def check(self, catalog: Mapping[str, str]) -> None:
        """Raise SpecError unless every column exists and has the type it is used as."""

        def need(column: str, *kinds: str) -> None:
            if column not in catalog:
                raise SpecError(f"no column {column!r}; there are {sorted(catalog)}")
            if catalog[column] not in kinds:
                raise SpecError(f"column {column!r} is of type {catalog[column]}, not {' or '.join(kinds)}")

        for c in (*self.groups, *self.distincts):
            need(c, "int", "str")
        for c in self.ints:
            need(c, "int")
        for c in self.strs:
            need(c, "str")
        for c in self.sets:
            need(c, "set")
        for c in self.sample_cols:
            need(c, "int", "str", "set")
        for x in self.filters:
            need(x.column, x.kind)
        for r in self.replaces:
            need(r.column, "str")
        if self.weight_col:
            need(self.weight_col, "int")
        if self.time:
            need(self.time_col, "int")
        if self.sort not in ("", COUNT) and not self.samples:
            if self.sort not in self.ints:
                raise SpecError(f"to sort by the mean of {self.sort!r} it must be among the int columns of the query")
