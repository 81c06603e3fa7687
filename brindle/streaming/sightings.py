"""Structured Streaming: availability of listings as keyed state, deduplicated enrichment, and windowed counts.

The state machine has no timer: a listing expires when a failed check arrives more than three days after its last sighting,
and not before.  Windows with watermarks serve monitoring; the batch operators give the same counts over finished tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.operators.graph import shared_dir, written
from brindle.operators.lifecycle import EXPIRY_DAYS, unseen

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
STATUS = "listing long, event_id long, status string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "*", files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Status of each failed check of one listing; the state is the time of the last sighting."""
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
    limit = pd.Timedelta(days=EXPIRY_DAYS)
    out = []
    for event_id, ts, failed in zip(rows["event_id"], rows["ts"], rows["failed"]):
        if not failed:
            last = ts if last is None else max(last, ts)
        else:
            out.append((key[0], event_id, "unknown" if last is None else "expired" if last < ts - limit else "unreachable"))
    if last is not None:
        state.update((last.value // 1000,))
    yield pd.DataFrame(out, columns=["listing", "event_id", "status"])


def statuses(events: DataFrame) -> DataFrame:
    """Streaming form of the sighting status; rows of one listing must arrive in order across batches."""
    rows = events.select("event_id", "ts", F.col("user_id").alias("listing"), (F.col("event_type") == "error").alias("failed"))
    return rows.groupBy("listing").applyInPandasWithState(follow, STATUS, "last bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window; late rows beyond the watermark are dropped."""
    stream = events.withWatermark("ts", watermark) if events.isStreaming else events
    return stream.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", watermark: str = "1 day") -> DataFrame:
    stream = events.withWatermark("ts", watermark) if events.isStreaming else events
    return stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def fresh_inputs(inputs: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Inputs whose (listing_id, fingerprint) has not been seen within the watermark: reprocessing is idempotent."""
    return inputs.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["listing_id", "fingerprint"])


def append_new(path: str, key: list[str], schema: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that appends only rows whose key the table does not have; a repeated batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        from brindle.sources.files import exists

        spark = batch.sparkSession
        rows = batch.dropDuplicates(key)
        if exists(spark, path):
            rows = unseen(rows, spark.read.schema(schema).parquet(path), key)
        rows.write.mode("append").parquet(path)

    return write


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all files that are there now into a table on shared storage, and read it: appended, or rewritten each batch."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/log").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/rows").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def single(rows: DataFrame, step: Callable[[DataFrame], DataFrame], attempts: int = 3) -> DataFrame:
    """One micro-batch through an idempotent step, tried again when it fails."""
    for left in range(attempts - 1, -1, -1):
        try:
            return written(step(rows), "batch")
        except Exception:
            if not left:
                raise
    raise AssertionError


def scheduled(stream: DataFrame, step: Callable[[DataFrame, int], None], folder: str, every: str = "10 minutes"):
    """A running query that hands over what is new every so often; a batch that takes longer delays the next one."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", folder).trigger(processingTime=every).start()


def slots(requests: DataFrame, interval_seconds: float, piece_seconds: float = 3600.0) -> DataFrame:
    """Reserved times (request, at, slot) at least an interval apart: slot i is the later of its time and slot i - 1 + interval.

    max over earlier requests of (at_j - j * interval) + i * interval, a running maximum.  Requests are cut into pieces of
    time; counts and maxima of earlier pieces are carried forward in a table with one row a piece.
    """
    cut = requests.withColumn("_piece", F.floor(F.col("at") / piece_seconds))
    inside, earlier = Window.partitionBy("_piece").orderBy("at", "request"), Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("_piece").agg(F.count("*").alias("_n"))
    skipped = counts.select("_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    numbered = cut.join(skipped, "_piece").withColumn("_i", F.row_number().over(inside) + F.col("_skip")).withColumn("_lead", F.col("at") - F.col("_i") * interval_seconds)
    most = numbered.groupBy("_piece").agg(F.max("_lead").alias("_most")).select("_piece", F.max("_most").over(earlier).alias("_carried"))
    lead = F.greatest(F.max("_lead").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_carried"))
    return numbered.join(most, "_piece").withColumn("slot", lead + F.col("_i") * interval_seconds).select(*requests.columns, "slot")
