import random
import subprocess
import sys
from datetime import date
from pathlib import Path

import pytest

from brindle.operators import rolling
from brindle.session import stage
from tests.conftest import rows

FIRST, LAST = "2024-03-04", "2024-04-28"
DAY0 = rolling.day_number(FIRST)
ROOT = Path(__file__).resolve().parent.parent
SCHEMA = "host string, time bigint, ping bigint, entity string, day int"


def brute(data):
    own = {}
    for h, t, p, *_ in data:
        if h is not None and t is not None and DAY0 <= t // 86400 <= rolling.day_number(LAST):
            n = own.setdefault(h, {}).setdefault(t // 86400, [0, 0, 0])
            n[0] += 1
            if p is not None:
                n[1] += 1
                n[2] += p
    out = []
    for h, days in own.items():
        for d in range(min(days), max(days) + 1):
            row = [h, str(date.fromordinal(date(1970, 1, 1).toordinal() + d)), days.get(d, [0])[0]]
            for w in (7, 30):
                got = [days[x] for x in range(d - w + 1, d + 1) if x in days]
                s, n = sum(x[2] for x in got), sum(x[1] for x in got)
                row += [s, n, s / n if n else None]
            out.append(tuple(row))
    return sorted(out)


def made(seed, n=300):
    rnd = random.Random(seed)
    hosts = ["a", "a", "a", "b", "", None, "c"]
    return [(rnd.choice(hosts), rnd.choice([None, -5, (DAY0 - 1) * 86400, (DAY0 + 56) * 86400, *[(DAY0 + rnd.randrange(56)) * 86400 + rnd.randrange(86400) for _ in range(9)]]), rnd.choice([None, -1, 2**31 - 1, *range(9)]), "clash", 1) for _ in range(n)]


def daily(spark, data):
    return rolling.daily(spark.createDataFrame(data, SCHEMA), "host", "time", "ping", FIRST, LAST)


@pytest.mark.parametrize("n", [0, 1, 20, 300])
def test_bootstrap_is_the_brute_force(spark, n):
    data = made(n, n)
    assert rows(rolling.report(rolling.bootstrap(daily(spark, data)), "host")) == sorted(brute(data), key=lambda t: [(v is not None, str(v)) for v in t])


def same(got, data):
    assert rows(rolling.report(got, "host")) == sorted(brute(data), key=lambda t: [(v is not None, str(v)) for v in t])


@pytest.mark.parametrize("seed,span", [(1, 14), (2, 5)])
def test_versions_with_late_days_and_new_entities(spark, tmp_path, seed, span):
    data = made(seed, 60)
    state, so_far = rolling.RollingState(spark, str(tmp_path), span=span), []
    for k, part in enumerate((data[:20], data[20:25], [("new", DAY0 * 86400, 5, "", 0)], [("late", (DAY0 + 50) * 86400, 5, "", 0)], [("late", DAY0 * 86400, 4, "", 0)], [], data[25:])):
        so_far += part
        batch = stage(daily(spark, part))
        assert state.load(batch, k) == k + 1
        assert state.load(batch, k) == k + 1  # known by its name: counts once
        same(state.current(), so_far)
        if k == 3:
            state = rolling.RollingState(spark, str(tmp_path), span=span)  # opened again


def test_a_batch_is_taken_back_and_given_again(spark, tmp_path):
    a, b = made(5, 40), made(6, 10)
    state = rolling.RollingState(spark, str(tmp_path))
    one, two = stage(daily(spark, a)), stage(daily(spark, b))
    state.load(one, "a")
    state.load(two, "b")
    state.load(one, "a", -1)
    left = {(r[0], r[1]): tuple(r)[2:] for r in rolling.report(state.current().where("n_rows > 0"), "host").collect()}
    want = {x[:2]: x[2:] for x in brute(b) if x[2]}
    assert {k: v[0] for k, v in left.items()} == {k: v[0] for k, v in want.items()}
    assert state.load(one, "a", -1) == 3  # it is not there any more
    state.load(one, "a")
    same(state.current(), a + b)


def test_only_affected_parts_are_written_and_old_ones_go(spark, tmp_path):
    state = rolling.RollingState(spark, str(tmp_path), periods=(2, 3), span=10)
    at = lambda *days: daily(spark, [("a", (DAY0 + k) * 86400, 1, "", 0) for k in days])
    state.load(at(*range(50)), 1)
    before = state.kept.get()["parts"]
    state.load(at(20), 2)  # affects three days
    after = state.kept.get()["parts"]
    changed = {k for k in before if before[k] != after[k]}
    assert before.keys() == after.keys() and changed == {str((DAY0 + 20) // 10), "ends"} | ({str((DAY0 + 22) // 10)})
    same_rows = state.current().agg({"day": "count"}).first()[0]
    assert same_rows == 50
    for k in range(3, 6):
        state.load(at(40 + k), k)
    assert state.kept.numbers() == [4, 5]
    live = {p for n in (4, 5) for p in state.kept.get(n)["parts"].values()}
    there = {f"data/{d}/{n}" for d, _, _, _ in state.kept.files.list(f"{tmp_path}/data") for n, is_dir, _, _ in state.kept.files.list(f"{tmp_path}/data/{d}") if is_dir}
    assert there == live


def test_another_process_goes_on(spark, tmp_path):
    data = made(9, 50)
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "rows"))
    state = rolling.RollingState(spark, str(tmp_path / "state"))
    state.load(daily(spark, data[:25]), 1)
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from brindle.operators import rolling
from brindle.session import local_session
spark = local_session(2, spark__sql__shuffle__partitions="2", spark__driver__memory="2g")
rows = spark.createDataFrame({data[25:]!r}, {SCHEMA!r})
rolling.RollingState(spark, {str(tmp_path / "state")!r}).load(rolling.daily(rows, "host", "time", "ping", {FIRST!r}, {LAST!r}), 2)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=200)
    assert state.kept.get()["number"] == 2
    same(state.current(), data)


def test_signed_correction(spark):
    data = [("a", (DAY0 + k) * 86400, 10, "", 0) for k in (0, 5, 40)]
    state = stage(rolling.bootstrap(daily(spark, data)))
    back = daily(spark, data[1:2]).selectExpr("entity", "day", "-n_rows as n_rows", "-n as n", "-total as total")
    got = rolling.report(rolling.advance(state, back), "host")
    want = brute([data[0], data[2]])
    assert rows(got) == sorted(want, key=lambda t: [(v is not None, str(v)) for v in t])


def test_gaps(spark):
    data = [("a", (DAY0 + k) * 86400, None, "", 0) for k in (0, 1, 4)]
    assert rows(rolling.gaps(rolling.bootstrap(daily(spark, data)), "host")) == [("a", "2024-03-06"), ("a", "2024-03-07")]


def test_rows_without_a_load_count(spark, tmp_path):
    from brindle import queries

    data = [("a", DAY0 * 86400, 5, 1), ("a", (DAY0 + 2) * 86400, 6, None), ("a", (DAY0 + 4) * 86400, 7, 2), ("b", DAY0 * 86400, 1, None)]
    spark.createDataFrame(data, "host string, time bigint, ping bigint, load_no bigint").write.parquet(str(tmp_path / "host_generator.parquet"))
    assert rows(queries.p4_rolling(spark, str(tmp_path))) == rows(queries.p4_bootstrap(spark, str(tmp_path)))
    assert rows(queries.p4_found(spark, str(tmp_path))) == [("a", "2024-03-05"), ("a", "2024-03-07")]
