"""Ingest and digest as a stream: a folder of JSON lines is followed, each micro-batch goes to the table's log.

The log is digested by the table's own limits after a batch. A batch that is run again after a failure is
written once: its log directory has a name made of the checkpoint's identity and the batch number, shows by
one rename, and a digest keeps the names of what it took. Streams with checkpoints of their own don't meet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.plans import compile as plan
from brindle.sources import ingest
from brindle.sources.model import to_model
from brindle.sources.storage import Table


def follow_json(table: Table, folder: str, checkpoint: str, options: ingest.IngestOptions = ingest.IngestOptions(), time_col: str = "time", available_now: bool = False) -> StreamingQuery:
    """Start following a folder of JSON lines; available_now: stop when what is there has been read."""

    files = table.files
    mark = f"{checkpoint.rstrip('/')}/stream-id"
    files.create(mark, uuid.uuid4().hex)  # only the first start makes one
    stream = files.read(mark)
    replayed = True  # only the first batch of a start can be one that ran before

    def batch(docs: DataFrame, number: int) -> None:
        nonlocal replayed
        name = f"stream-{stream}-{number}"
        if not (replayed and table.has_log(name)):
            rows = to_model(ingest.from_json_strings(docs, "value", options))
            if rows.columns:
                table._merge_columns(plan.catalog_of(rows))
                made = f"{table.path}/stream/{name}-{uuid.uuid4().hex}"
                rows.write.parquet(made)
                files.mkdirs(f"{table.path}/log")
                files.rename(made, f"{table.path}/log/{name}")
        replayed = False
        table.maybe_digest(time_col)

    docs = table.spark.readStream.text(folder)
    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def rollup_stream(rows: DataFrame, time_col: str, bucket: int, groups: list[str], value: str, late: str | None = None) -> DataFrame:
    """A streaming time roll-up for output modes complete and update: count and mean per bucket and groups, whole at every trigger.

    Buckets are cut towards zero, as in batch queries. late: a watermark, which bounds the state and drops
    rows that are later than it (``correct_late`` makes the results whole again); None: no row is dropped,
    and the state has a row per bucket and group. Rows without a time are left out, a missing group is "".
    """
    at = rows.where(F.col(f"`{time_col}`").isNotNull())
    bucket_of = F.call_function("div", F.col(f"`{time_col}`").cast("bigint"), F.lit(bucket)) * bucket
    keys = [F.coalesce(F.col(f"`{g}`").cast("string"), F.lit("")).alias(g) for g in groups]
    if late is not None:
        at = at.withColumn("__at", F.timestamp_seconds(bucket_of)).withWatermark("__at", late)
        out = at.groupBy(F.col("__at"), *keys)
    else:
        out = at.groupBy(bucket_of.alias("time_bucket"), *keys)
    out = out.agg(F.count(F.lit(1)).alias("Count"), F.avg(F.col(f"`{value}`")).alias(value))
    first = F.unix_timestamp("__at").alias("time_bucket") if late is not None else F.col("time_bucket")
    return out.select(first, *[F.col(f"`{g}`") for g in groups], "Count", F.col(f"`{value}`"))


def correct_late(rolled: DataFrame, table_rows: DataFrame, since: int, time_col: str, bucket: int, groups: list[str], value: str) -> DataFrame:
    """A roll-up made with a watermark, with the buckets from *since* on taken from the table's own rows instead: the exact way for late rows."""
    start = since // bucket * bucket
    of = F.call_function("div", F.col(f"`{time_col}`").cast("bigint"), F.lit(bucket)) * bucket
    again = rollup_stream(table_rows.where(of >= start), time_col, bucket, groups, value)
    return rolled.where(F.col("time_bucket") < start).unionByName(again)
