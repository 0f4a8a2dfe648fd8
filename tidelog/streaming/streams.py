"""Structured Streaming forms of the operators.

State is bounded by watermarks; progress and state live in the checkpoint
folder of each query, so a lost executor or driver resumes where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.model import is_error_stats, label
from tidelog.operators import lateness
from tidelog.operators.delivery import message_key

WATERMARK = "10 minutes"


def read_stream(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def once_each(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Messages delivered more than once, within the watermark: the first copy
    of (stream, identifier) passes. Rows without either pass as they are
    through a key of their own. Rows without an ingestion time have no place on
    the clock: they go around the watermark and all pass."""
    lone = F.col("log_stream_name").isNull() | F.col("event_id").isNull()
    dated = events.where("ingestion_time is not null").withColumns({"_k": F.when(lone, F.concat(F.lit("#"), F.col("delivery_id").cast("string"))).otherwise(message_key()), "_t": F.timestamp_millis("ingestion_time")})
    once = dated.withWatermark("_t", late).dropDuplicatesWithinWatermark(["log_stream_name", "_k"]).drop("_k", "_t")
    return once.unionByName(events.where("ingestion_time is null"))


def late_partials(events: DataFrame, sink: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: appends each micro-batch's partial counts, one folder
    per batch, overwritten if the batch is retried; ``lateness.corrected`` over
    the folder gives the counts as of now."""

    def write(batch: DataFrame, batch_id: int) -> None:
        lateness.partial_counts(batch).write.mode("overwrite").parquet(f"{sink}/micro={batch_id}")

    return write


def histogram(rows: DataFrame, every: str = "1 second", late: str = WATERMARK) -> DataFrame:
    """Counts, errors and warnings per event-time window, with a watermark."""
    level = F.lower(label("level"))
    g = rows.withWatermark("ts", late).groupBy(F.window("ts", every))
    return g.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(is_error_stats(level), 1)).alias("errors"), F.count(F.when(level.isin("warn", "warning"), 1)).alias("warnings")).select(F.col("window.start").alias("bucket"), "total", "errors", "warnings")


def cooldown(matched: DataFrame, seconds: dict[str, int], late: str = WATERMARK) -> DataFrame:
    """Firings of matches (rule, ts, seq) with the last firing per rule as state.
    Matches of a micro-batch are taken in time order; those older than the last
    firing don't fire."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        wait = seconds[key[0]] * 1000
        out = []
        for f in frames:
            for ts, seq in sorted(zip(f["ts"], f["seq"])):
                ms = int(ts.timestamp() * 1000)
                if last is None or ms - last >= wait:
                    last = ms
                    out.append((key[0], ts, seq))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["rule", "ts", "seq"])

    return matched.withWatermark("ts", late).groupBy("rule").applyInPandasWithState(step, "rule string, ts timestamp, seq bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def snapshots(rows: DataFrame, report: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds", once: bool = False):
    """Start a query that hands each micro-batch to ``report``."""
    w = rows.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
