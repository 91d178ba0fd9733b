import io
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from brindle import cli
from brindle.plans.compile import compile_query
from brindle.plans.spec import Filter, QuerySpec
from brindle.sources.files import Files
from brindle.sources.ingest import IngestOptions, from_json_strings, read_csv
from brindle.sources.lease import Lease
from brindle.sources.model import ColumnTypeError
from brindle.sources.storage import Table, list_tables
from brindle.streaming.digest import correct_late, follow_json, rollup_stream
from tests.conftest import rows

LINES = [
    '{"a": 1, "b": {"c": "x", "d": [1, 2.5, "s", null, {"q": 1}]}, "t": "2024-03-04T00:00:01Z", "n": "12", "ok": true}',
    '{"a": 2.9, "b": {"c": null}, "t": "never", "n": "twelve", "ok": false, "big": 9007199254740993}',
    "not json",
    '{"a": -2.9, "b": {"c": "", "d": []}, "t": "2024-03-04T01:00:01.5+01:00"}',
    "[1, 2]",
]


def docs(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_json_types(spark):
    got = from_json_strings(docs(spark, LINES), "value", IngestOptions(ints=("n",), timestamps=("t",)))
    assert {f.name: f.dataType.simpleString() for f in got.schema.fields} == {"a": "bigint", "b_c": "string", "b_d": "array<string>", "big": "bigint", "n": "bigint", "ok": "bigint", "t": "bigint"}
    assert [r.asDict() for r in got.collect()] == [
        {"a": 1, "b_c": "x", "b_d": ["1", "2", "s"], "big": None, "n": 12, "ok": 1, "t": 1709510401},
        {"a": 2, "b_c": None, "b_d": None, "big": 9007199254740993, "n": None, "ok": 0, "t": None},
        {"a": -2, "b_c": "", "b_d": [], "big": None, "n": None, "ok": None, "t": 1709510401},
    ]


def test_json_exclude_path_and_names(spark):
    got = from_json_strings(docs(spark, LINES), "value", IngestOptions(exclude=("b", "t", "n", "ok", "big")))
    assert got.columns == ["a"]
    nested = ['{"x": {"rows": [{"k.1": 1, "it\'s": "v"}, {"k.1": 2}, 5]}}', '{"x": {"rows": 3}}', '{"x": {}}']
    got = from_json_strings(docs(spark, nested), "value", IngestOptions(path="$.x.rows"))
    assert sorted(tuple(r) for r in got.select("`k.1`").collect()) == [(1,), (2,)] and "it's" in got.columns
    first = from_json_strings(docs(spark, nested), "value", IngestOptions(path="$.x.rows.0"))
    assert first.count() == 1


def test_json_conflict_and_mixed_numbers(spark):
    with pytest.raises(ColumnTypeError, match="'a'"):
        from_json_strings(docs(spark, ['{"a": 1}', '{"a": "x"}']), "value")
    assert sorted(r[0] for r in from_json_strings(docs(spark, ['{"a": 1}', '{"a": true}', '{"a": 2.5}']), "value").collect()) == [1, 1, 2]
    assert from_json_strings(docs(spark, ["nothing"]), "value").columns == []


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("n,f,s,empty\n1,1.9,a,\n,-2.5,b\n3,,,,9\n")
    got = read_csv(spark, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in got.collect()] == [(1, 1, "a"), (None, -2, "b"), (3, None, None)] and got.columns == ["n", "f", "s"]
    (tmp_path / "y.csv").write_text("n\n1\nx\n")
    with pytest.raises(ColumnTypeError):
        read_csv(spark, str(tmp_path / "y.csv"))


def people(spark, n=300):
    return spark.createDataFrame([(i, 10 + i % 20, str(10 + i % 20), [str(10 + i % 20)], 1000 + i) for i in range(n)], "id bigint, age bigint, age_str string, age_set array<string>, time bigint")


def test_ingest_digest_query(spark, tmp_path):
    t = Table(spark, str(tmp_path), "p")
    t.ingest(people(spark), compact=False)
    spec = QuerySpec(groups=("age_str",), ints=("age",))
    assert t.query(spec).count() == 0  # still in the log
    log = QuerySpec(groups=("age_str",), ints=("age",), read_log=True)
    assert t.query(log).count() == 20
    t.digest()
    got = t.query(spec).collect()
    assert len(got) == 20 and all(float(r["age_str"]) == r["age"] and r["Count"] == 15 for r in got)
    for f, n in (("neq", 19), ("eq", 1)):
        assert t.query(QuerySpec(groups=("age",), filters=(Filter("str", "age_str", f, "20"),))).count() == n
    assert t.query(QuerySpec(groups=("age",), filters=(Filter("str", "age_str", "re", "^2"),))).count() == 10
    assert t.query(QuerySpec(groups=("age",), filters=(Filter("set", "age_set", "nin", "20"),))).count() == 19
    assert list_tables(spark, str(tmp_path)) == ["p"]
    info = t.info()
    assert info["count"] == 300 and info["columns"] == {"strs": ["age_str"], "ints": ["age", "id", "time"], "sets": ["age_set"]}


def test_new_columns_and_type_conflict(spark, tmp_path):
    t = Table(spark, str(tmp_path), "p")
    t.add([{"a": 1, "time": 5}], compact=False)
    t.digest()
    t.add([{"a": 2, "b": "x", "time": 6}], compact=False)
    t.digest()
    assert rows(t.read().select("a", "b")) == [(1, None), (2, "x")]
    with pytest.raises(ColumnTypeError):
        t.add([{"a": "text"}])
    assert t.read(True).count() == 2
    assert t.rebuild() == {"a": "int", "b": "str", "time": "int"}


def test_digest_takes_up_one_that_died(spark, tmp_path):
    t = Table(spark, str(tmp_path), "p")
    t.ingest(people(spark), compact=False)
    log = t._log_dirs()[0]
    t.files.mkdirs(f"{t.path}/digesting/dead")
    t.files.rename(log, f"{t.path}/digesting/dead/x")  # taken, nothing written
    t.files.mkdirs(f"{t.path}/blocks/dead")  # an unfinished block directory
    assert t.read().count() == 0 and t.read(True).count() == 300  # what was taken and is in no block yet counts as log
    t.digest()
    assert t.read().count() == 300 and t.files.list(f"{t.path}/digesting") == []


def test_auto_digest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("brindle.sources.storage.LOG_FILES", 1)
    t = Table(spark, str(tmp_path), "p")
    t.ingest(people(spark).repartition(3))
    assert t.block_dirs() and not t._log_dirs()


def test_cache_of_partial_results(spark, tmp_path):
    t = Table(spark, str(tmp_path), "p")
    for k in range(2):
        t.ingest(people(spark).where(f"id % 2 = {k}"), compact=False)
        t.digest()
    for spec in (QuerySpec(groups=("age",), ints=("id",)), QuerySpec(op="hist", ints=("age",)), QuerySpec(op="hist", ints=("age",), loghist=True), QuerySpec(op="distinct", distincts=("age_str",))):
        want = rows(t.query(spec))
        assert rows(t.query(spec, cache=True)) == want and rows(t.query(spec, cache=True)) == want
    t.ingest(people(spark), compact=False)
    t.digest()
    assert t.query(QuerySpec(groups=("age",), ints=("id",)), cache=True).first()["Count"] == 30


def test_trim_index_export_inspect(spark, tmp_path):
    t = Table(spark, str(tmp_path), "p")
    for k in range(3):
        t.ingest(people(spark).where(f"id div 100 = {k}"), compact=False)
        t.digest(block_rows=100)
    assert t.index(("age", "time")) == {"age": (10, 29), "time": (1000, 1299)}
    assert t.extents(("age",)) == {"age": (10, 29)}
    doomed = t.trim("time", before=1100)
    assert doomed and t.read().count() == 300
    assert len(t.trim("time", mb=1)) == 0
    t.trim("time", before=1100, delete=True)
    assert t.read().count() == 200
    t.export(f"{tmp_path}/out", QuerySpec(filters=(Filter("int", "age", "lt", 12),)))
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/out")
    assert back.count() == 20 and back.columns == ["age", "age_set", "age_str", "id", "time"]
    seen = [{r["column"]: r for r in t.inspect(d).collect()} for d in t.block_dirs()]
    assert [x["age"]["rows"] for x in seen] == [100, 100] and {x["time"]["least"] for x in seen} == {"1100", "1200"}


def test_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "in.json").write_text("\n".join(json.dumps({"host": f"h{i % 3}", "ping": i, "time": 3600 * i}) for i in range(30)))
    said = []
    run = lambda *a: cli.run(list(a), spark, said.append)
    base = ("-dir", str(tmp_path / "db"), "-table", "t")
    assert run("ingest", *base, "-infile", str(tmp_path / "in.json"), "-skip-compact") == 0
    run("digest", *base)
    run("query", *base, "-group", "host", "-int", "ping", "-int-filter", "ping:lt:9", "-json")
    assert json.loads(said[-1])[0] == {"host": "h0", "ping": 3.0, "Count": 3, "Samples": 3}
    run("query", *base, "-group", "host", "-int", "ping")
    assert "TOTAL" in said[-1].splitlines()[0]
    run("query", *base, "-time", "-time-bucket", "36000", "-json")
    assert list(json.loads(said[-1])) == ["0", "36000", "72000"]
    run("query", *base, "-samples", "-limit", "2", "-json")
    assert [r["time"] for r in json.loads(said[-1])] == [3600 * 29, 3600 * 28]
    run("query", *base, "-info", "-json")
    assert json.loads(said[-1])["count"] == 30
    run("query", "-dir", str(tmp_path / "db"), "-tables")
    assert said[-1] == "t"
    run("index", *base, "-int", "ping")
    for node in ("n1", "n2"):
        run("query", *base, "-group", "host", "-op", "hist", "-int", "ping", "-encode-results", str(tmp_path / node))
    run("aggregate", str(tmp_path / "n1"), str(tmp_path / "n2"), "-json")
    assert json.loads(said[-1])[0]["ping"]["samples"] == 20
    run("query", *base, "-group", "host", "-encode-flags")
    monkeypatch.setattr("sys.stdin", io.StringIO(said[-1]))
    run("query", *base, "-decode-flags", "-json")
    assert len(json.loads(said[-1])) == 3
    run("trim", *base, "-time-col", "time", "-before", "99999999", "-delete", "-really")
    run("query", *base, "-json")
    assert json.loads(said[-1]) == []
    assert cli.run(["version", "-json"], None, said.append) == 0


def test_stream_of_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"a": 1, "time": 1}\n{"a": 2, "time": 2}\n')
    t = Table(spark, str(tmp_path), "s")
    for k in (1, 2):
        follow_json(t, str(tmp_path / "in"), str(tmp_path / "ck"), available_now=True).awaitTermination()
        assert t.read(True).count() == 2 * k
        (tmp_path / "in" / f"{k + 1}.json").write_text('{"a": 3, "time": 3}\n{"a": 4, "b": "x", "time": 4}\n')
    # another folder and checkpoint into the same table: its batches have the same numbers and are written all the same
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2" / "1.json").write_text("".join(f'{{"a": {k}, "time": {k}}}\n' for k in range(5)))
    follow_json(t, str(tmp_path / "in2"), str(tmp_path / "ck2"), available_now=True).awaitTermination()
    assert t.read(True).count() == 9
    stream = t.files.read(f"{tmp_path}/ck2/stream-id")
    assert t.has_log(f"stream-{stream}-0") and not t.has_log(f"stream-{stream}-1")
    t.digest()  # a batch that is run again after its log was digested is known by the block
    assert t.has_log(f"stream-{stream}-0") and t.read().count() == 9


def test_streaming_roll_up_is_the_batch_one(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"time": x, "g": g, "v": v} for x, g, v in [(5, "a", 1), (65, "a", 2), (70, None, 3), (-5, "a", 4), (-65, "b", 5), (7, "", None), (None, "a", 6), (100000, "a", 7), (6, "a", 8)]]
    for k, line in enumerate(lines):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(line) + "\n")
    schema = "time bigint, g string, v bigint"
    stream = rollup_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in")), "time", 60, ["g"], "v")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.schema(schema).json(str(tmp_path / "in"))
    want = compile_query(QuerySpec(groups=("g",), ints=("v",), time=True, time_bucket=60, limit=None), batch).select("time_bucket", "g", "Count", "v")
    assert rows(spark.table("rolled")) == rows(want) and {r[0] for r in want.collect()} == {0, 60, -60, 99960}
    # with a watermark late rows are dropped; the table's own rows put the buckets since then right
    fixed = correct_late(spark.table("rolled").withColumn("Count", F.lit(0).cast("bigint")), batch, 0, "time", 60, ["g"], "v")
    assert rows(fixed.where("time_bucket >= 0")) == rows(want.where("time_bucket >= 0"))


@pytest.mark.parametrize("delay", [0.0, 0.2, 0.6, 1.5])
def test_overlapping_digests_keep_all_rows(spark, tmp_path, delay):
    t = Table(spark, str(tmp_path), "p")
    for k in range(4):
        t.ingest(spark.range(k * 300_000, (k + 1) * 300_000).selectExpr("id", "id div 7 as time"), compact=False)
    failed = []

    def one(wait):
        time.sleep(wait)
        try:
            Table(spark, str(tmp_path), "p").digest()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=one, args=(w,)) for w in (0.0, delay, delay)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t.digest()
    assert not failed
    got = t.read().selectExpr("count(*)", "count(distinct id)").first()
    assert tuple(got) == (1_200_000, 1_200_000)


def test_lease_has_one_holder_and_outlives_a_dead_one(spark, tmp_path):
    files = Files(spark)
    a, b = (Lease(files, f"{tmp_path}/l", 1.0) for _ in "ab")
    assert a.take() and a.held() and not b.take()
    time.sleep(1.5)  # renewed by its thread
    assert not b.take()
    a._stop.set()  # a gives no more sign of life
    time.sleep(1.2)
    assert b.take() and b.held() and not a.held()
    b.release()
    assert a.take() and not b.held()
    a.release()
    got = []
    threads = [threading.Thread(target=lambda: got.append(Lease(files, f"{tmp_path}/m").take())) for _ in range(8)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert got.count(True) == 1


def test_catalog_is_never_absent_and_loses_no_change(spark, tmp_path):
    t = Table(spark, str(tmp_path), "p")
    t._merge_columns({"a0": "int"})
    seen, done = [], threading.Event()

    def look():
        while not done.is_set():
            seen.append(len(Table(spark, str(tmp_path), "p").catalog()))

    reader = threading.Thread(target=look)
    reader.start()
    writers = [threading.Thread(target=lambda k=k: Table(spark, str(tmp_path), "p")._merge_columns({f"a{k}": "int"})) for k in range(1, 9)]
    for x in writers:
        x.start()
    for x in writers:
        x.join()
    done.set()
    reader.join()
    assert len(t.catalog()) == 9 and min(seen) >= 1 and seen == sorted(seen)


def test_kept_extents_go_with_trimmed_files(spark, tmp_path):
    t = Table(spark, str(tmp_path), "p")
    t.ingest(spark.range(10_000).selectExpr("id", "id as time").coalesce(1), compact=False)
    t.digest(block_rows=1000)
    t.index(("id",))
    assert t.extents(("id",)) == {"id": (0, 9999)}
    t.trim("time", before=9000, delete=True)
    low = t.read().selectExpr("min(id)").first()[0]
    assert low > 0 and t.extents(("id",)) == {"id": (low, 9999)}
    assert t.column_stats(("id",))["id"]["min"] == low


def test_column_statistics(spark, tmp_path):
    t = Table(spark, str(tmp_path), "p")
    t.ingest(people(spark), compact=False)
    t.digest()
    got = t.column_stats()
    assert got["age"] == {"count": 300, "min": 10, "max": 29, "mean": 19.5} and "age_set" not in got
    assert got["age_str"]["count"] == 300 and abs(got["age_str"]["cardinality"] - 20) <= 1 and len(got["age_str"]["top"]) == 20


def test_command_line_from_standard_input_and_aggregates(spark, tmp_path):
    said = []
    run = lambda *a, stdin=None: cli.run(list(a), spark, said.append, stdin)
    for node, shift in (("x", 0), ("y", 500)):
        base = ("-dir", str(tmp_path / node), "-table", "t")
        lines = "\n".join(json.dumps({"h": f"h{i % 2}", "ping": i + shift, "time": i}) for i in range(100))
        assert run("ingest", *base, "-file", "mine", "-skip-compact", stdin=io.BytesIO(lines.encode())) == 0
        t = Table(spark, str(tmp_path / node), "t")
        assert t._log_dirs()[0].rsplit("/", 1)[1].startswith("mine-") and t.files.list(f"{t.path}/stdin") == []
        run("digest", *base)
        for name, flags in (("hist", ("-op", "hist", "-int", "ping", "-group", "h")), ("some", ("-samples", "-limit", "7")), ("info", ("-info",)), ("tables", ("-tables",))):
            run("query", *base, *flags, "-encode-results", str(tmp_path / f"{node}-{name}"))
    both = lambda name: (str(tmp_path / f"x-{name}"), str(tmp_path / f"y-{name}"), "-json")
    run("aggregate", *both("hist"))
    got = json.loads(said[-1])
    assert [(r["h"], r["Count"], r["ping"]["samples"], r["ping"]["avg"]) for r in got] == [("h0", 100, 100, 299.0), ("h1", 100, 100, 300.0)]
    assert abs(got[0]["ping"]["percentiles"][50] - 500) <= 6  # unequal extents: within a bucket
    run("aggregate", *both("some"))
    assert len(json.loads(said[-1])) == 7
    run("aggregate", *both("info"))
    assert json.loads(said[-1])["count"] == 200
    run("aggregate", *both("tables"))
    assert json.loads(said[-1]) == ["t"]
    run("query", *base, "-group", "h", "-op", "hist", "-int", "ping")
    assert "stddev" in said[-1]
    run("query", *base, "-op", "distinct", "-distinct", "h")
    assert "Distinct: 2" in said[-1]
