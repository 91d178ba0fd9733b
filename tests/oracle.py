"""Queries against their SQL on DuckDB."""

from pathlib import Path

import duckdb

from tools.compare import rows_of


def check(spark, d, name, f, sql):
    db = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    df = f(spark, str(d))
    want = db.sql(sql)
    assert sorted(df.columns) == sorted(want.columns), name
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall()), name


def plan_text(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def no_pairs(df, name):
    """No step of the plan builds all pairs of rows."""
    text = plan_text(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
