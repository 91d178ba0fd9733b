"""Results as JSON and as text."""

from __future__ import annotations

import json
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Row

from brindle.plans.compile import BUCKET
from brindle.plans.spec import QuerySpec


def _value(v):
    if isinstance(v, Row):
        return {k: _value(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): _value(x) for k, x in v.items()}
    return [_value(x) for x in v] if isinstance(v, list) else v


def as_dicts(spec: QuerySpec, df: DataFrame) -> list[dict]:
    """The rows of a (limited) result; a hist without values is {}."""
    rows = [{k: _value(v) for k, v in r.asDict().items()} for r in df.toLocalIterator()]
    if spec.op == "hist" and not spec.samples:
        for r in rows:
            r.update({c: r[c] or {} for c in spec.ints if c in r})
    return rows


def to_json(spec: QuerySpec, df: DataFrame) -> str:
    """A list of results, or for a time query an object of lists by bucket."""
    rows = as_dicts(spec, df)
    if not spec.time or spec.samples:
        return json.dumps(rows, ensure_ascii=False)
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r[BUCKET]):
        out.setdefault(str(r.pop(BUCKET)), []).append(r)
    return json.dumps(out, ensure_ascii=False)


def to_text(spec: QuerySpec, df: DataFrame) -> str:
    """Aligned lines: count (or ``Distinct: n``), samples if weighted, groups, then means, or percentiles with the standard
    deviation; the total first if the result has one. Times are those of the session's time zone."""
    rows = as_dicts(spec, df)
    zone = ZoneInfo(df.sparkSession.conf.get("spark.sql.session.timeZone"))
    if spec.samples:
        return "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
    lines = []
    for r in sorted(rows, key=lambda r: (not r.get("is_total", False), r.get(BUCKET, 0))):
        cells = [datetime.fromtimestamp(r[BUCKET], zone).strftime("%Y-%m-%d %H:%M:%S")] if BUCKET in r else []
        cells += [f"Distinct: {r['Distinct']}" if "Distinct" in r else str(r.get("Count", ""))] + ([f"({r['Samples']})"] if spec.weight_col and "Samples" in r else [])
        cells.append("TOTAL" if r.get("is_total") else "\t".join(str(r[g]) for g in spec.groups) or "total")
        for c in spec.ints if spec.op != "distinct" else ():
            v = r.get(c)
            if isinstance(v, dict):
                p = v.get("percentiles")
                cells.append(f"{c} " + (f"avg {v['avg']:.2f} " + " ".join(f"p{i} {p[i]}" for i in (0, 25, 50, 75, 99)) + f" stddev {v['stddev']:.2f}" if p else "-"))
            else:
                cells.append(f"{c} " + ("-" if v is None else f"{v:.2f}"))
        lines.append(cells)
    width = [max((len(x[i]) for x in lines if i < len(x)), default=0) for i in range(max(map(len, lines), default=0))]
    return "\n".join("  ".join(x.rjust(w) for x, w in zip(cells, width)) for cells in lines)
