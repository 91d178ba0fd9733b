import pytest
from hypothesis import given
from hypothesis import strategies as st

from brindle.functions import histogram
from brindle.functions.text import java_template, java_time_pattern
from brindle.plans.spec import Filter, QuerySpec, Replace, SpecError

CATALOG = {"a": "int", "s": "str", "g": "set", "time": "int"}


def test_flags():
    spec = QuerySpec.from_flags({"group": "s,a", "int": "a", "int-filter": "a:gt:10,a:lt:x", "str-filter": "s:re:^b", "set-filter": "g:nin:z", "sort": "a", "limit": "5", "time": True, "str-replace": "s:x:y"})
    assert spec.groups == ("s", "a") and spec.limit == 5 and spec.time
    assert spec.filters == (Filter("int", "a", "gt", 10), Filter("int", "a", "lt", 0), Filter("set", "g", "nin", "z"), Filter("str", "s", "re", "^b"))
    assert spec.replaces == (Replace("s", "x", "y"),)


def test_other_separators_let_values_hold_commas_and_colons():
    spec = QuerySpec.from_flags({"str-filter": "s\x1ere\x1ea:b,c"}, "\x1e", "\x1f")
    assert spec.filters[0].value == "a:b,c"


def test_op_distinct_takes_the_groups():
    spec = QuerySpec.from_flags({"op": "distinct", "group": "s,a"})
    assert spec.distincts == ("s", "a") and spec.groups == ()


def test_json_round_trip():
    spec = QuerySpec(groups=("s",), ints=("a",), filters=(Filter("int", "a", "gt", 3),), replaces=(Replace("s", "(x)", "$1"),), time=True, sort="a", totals=True)
    assert QuerySpec.from_json(spec.to_json()) == spec


def test_state_key_depends_on_what_the_rows_depend_on():
    a = QuerySpec(ints=("a",), weight_col="a")
    assert a.state_key() == QuerySpec(ints=("a",), weight_col="a", limit=3, sort="a").state_key()
    for other in (QuerySpec(ints=("a",)), QuerySpec(ints=("a",), weight_col="a", int_bucket=3), QuerySpec(ints=("a",), weight_col="a", time=True), QuerySpec(ints=("a",), weight_col="a", filters=(Filter("str", "s", "eq", "x"),))):
        assert a.state_key() != other.state_key()


@pytest.mark.parametrize(
    "bad",
    [dict(groups=("nope",)), dict(groups=("g",)), dict(ints=("s",)), dict(weight_col="s"), dict(sort="a"), dict(filters=(Filter("int", "s", "eq", 1),)), dict(replaces=(Replace("a", "x", "y"),)), dict(time=True, time_col="s")],
)
def test_checks(bad):
    with pytest.raises(SpecError):
        QuerySpec(**bad).check(CATALOG)


def test_unknown_ops():
    with pytest.raises(SpecError):
        Filter("int", "a", "re", 1)
    with pytest.raises(SpecError):
        QuerySpec(op="median")


def test_time_filters_are_rounded_down_and_other_tables_dropped():
    spec = QuerySpec(time=True, time_bucket=100, filters=(Filter("int", "time", "gt", 250), Filter("int", "time", "gt", -250), Filter("int", "a", "gt", 250), Filter("int", "a", "gt", 1, "other")))
    assert [f.value for f in spec.for_table("mine").filters] == [200, -200, 250]


@pytest.mark.parametrize("template,pattern,want", [("$1", "(a)", "$1"), ("$1x", "(a)", ""), ("${1}x", "(a)", "$1x"), ("${1}2", "(a)", "$1\\2"), ("$3", "(a)", ""), ("$$5", "(a)", "\\$5"), ("a\\b", "a", "a\\\\b"), ("${n}", "(?P<n>a)", "${n}"), ("5$", "a", "5\\$")])
def test_templates(template, pattern, want):
    assert java_template(template, pattern) == want


@pytest.mark.parametrize("layout,want", [("2006-01-02T15:04:05Z07:00", "yyyy-MM-dd'T'HH:mm:ssXXX"), ("02/Jan/2006 03:04 PM", "dd/MMM/yyyy hh:mm a"), ("2006-01-02 15:04:05.000", "yyyy-MM-dd HH:mm:ss.SSS")])
def test_layouts(layout, want):
    assert java_time_pattern(layout) == want


@pytest.mark.parametrize("size,want", [(0, (1, 2)), (1, (1, 3)), (99, (1, 101)), (100, (1, 102)), (999, (9, 113)), (1000, (1, 1002)), (1999, (1, 1002)), (123456, (123, 1002))])
def test_histogram_layout(size, want):
    assert histogram.layout(5, 5 + size) == want


@given(st.integers(-(2**62), 2**62), st.integers(0, 2**62))
def test_log_ranges_cover(low, size):
    ranges = histogram.log_ranges(low, low + size)
    assert ranges[0][1] == low + size and ranges[-1][0] == low
    assert all(a[0] == b[1] for a, b in zip(ranges, ranges[1:]))
