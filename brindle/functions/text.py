"""Text functions whose rules come from another regex or time dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_pattern(pattern: str) -> str:
    """An RE2 pattern for Java's engine: named groups are written differently; the rest of the common subset is the same."""
    return pattern.replace("(?P<", "(?<")


def java_template(template: str, pattern: str) -> str:
    """A replacement template with $name, ${name}, $$ for Java: names are as long as possible ($1x is group "1x"),
    groups that the pattern doesn't have are empty, a backslash is an ordinary character."""
    try:
        compiled = re.compile(pattern)
        numbers, names = compiled.groups, set(compiled.groupindex)
    except re.error:
        numbers, names = 9, set()
    out, i = [], 0
    while i < len(template):
        c = template[i]
        if c == "$":
            if template[i + 1 : i + 2] == "$":
                out.append("\\$")
                i += 2
                continue
            m = re.compile(r"\$(?:\{(\w+)\}|(\w+))").match(template, i)
            if not m:
                out.append("\\$")
                i += 1
                continue
            name = m[1] or m[2]
            if name.isdigit():
                if int(name) <= numbers:
                    out.append(f"${int(name)}")
                    # a digit that follows would be read as part of the number
                    if template[m.end() : m.end() + 1].isdigit():
                        out.append("\\" + template[m.end()])
                        i = m.end() + 1
                        continue
            elif name in names:
                out.append("${%s}" % name)
            i = m.end()
        elif c == "\\":
            out.append("\\\\")
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def replace_all(column: Column, pattern: str, template: str) -> Column:
    """Every match of pattern in column replaced by the template; null stays null."""
    return F.regexp_replace(column, F.lit(java_pattern(pattern)), F.lit(java_template(template, pattern)))


#: Elements of a time layout that is written as the reference time, and Java's letters for them, longest first.
LAYOUT = {
    "2006": "yyyy", "January": "MMMM", "Jan": "MMM", "Monday": "EEEE", "Mon": "EEE", "MST": "z",
    "Z07:00": "XXX", "-07:00": "xxx", "Z0700": "XX", "-0700": "xx", "-07": "x",
    "01": "MM", "02": "dd", "03": "hh", "04": "mm", "05": "ss", "06": "yy", "15": "HH",
    "PM": "a", "1": "M", "2": "d", "3": "h", "4": "m", "5": "s", "_2": "ppd",
}
_layout = re.compile("|".join(re.escape(k) for k in sorted(LAYOUT, key=len, reverse=True)) + r"|[.,](0+|9+)(?!\d)")


def java_time_pattern(layout: str) -> str:
    """A layout such as 2006-01-02T15:04:05Z07:00 as a Java pattern; text between elements is quoted."""
    out, at = [], 0

    def quote(s: str) -> None:
        if s:
            out.append("'" + s.replace("'", "''") + "'" if re.search("[A-Za-z']", s) else s)

    for m in _layout.finditer(layout):
        quote(layout[at : m.start()])
        out.append(LAYOUT[m.group()] if m.group() in LAYOUT else m.group()[0] + "S" * len(m.group(1)))
        at = m.end()
    quote(layout[at:])
    return "".join(out)


RFC3339 = "2006-01-02T15:04:05Z07:00"


def epoch(column: Column, layout: str = RFC3339) -> Column:
    """Epoch seconds of a time written in layout; null if it can't be read."""
    pattern = java_time_pattern(layout)
    if layout == RFC3339:  # a fraction of a second is accepted though the layout has none
        pattern = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]XXX"
    return F.unix_timestamp(F.try_to_timestamp(column, F.lit(pattern)))


def rounded_text(column: Column) -> Column:
    """A number as text without decimals, halves to even."""
    return F.bround(column.cast("double"), 0).cast("decimal(38,0)").cast("string")
