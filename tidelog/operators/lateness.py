"""Per-hour counts by event time, corrected by late records (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
GRACE_MS = 15 * 60_000
CUTOFF_MS = 24 * HOUR_MS


def to_millis(col: str) -> Column:
    """An epoch written in s, ms or µs, brought to ms by its magnitude.

    Below 1e11 it is seconds (ms would lie before 1973-03), from 1e14 on it is
    µs (ms would lie after the year 5138).
    """
    c = F.col(col)
    return F.when(F.abs(c) < 100_000_000_000, c * 1000).when(F.abs(c) >= 100_000_000_000_000, F.floor(c / 1000)).otherwise(c)


def partial_counts(
    df: DataFrame,
    *,
    stream: str = "log_stream_name",
    event_time: str = "event_timestamp",
    ingestion: str = "ingestion_time",
    batch: str = "batch_id",
    period_ms: int = HOUR_MS,
    grace_ms: int = GRACE_MS,
    cutoff_ms: int = CUTOFF_MS,
) -> DataFrame:
    """Mergeable partial aggregates per stream, period and arrival batch.

    ``n_first`` counts events that came up to ``grace_ms`` after the period's
    end, ``n_late`` those after that up to ``cutoff_ms``, ``n_refused`` the
    rest. The three are sums, so partials of any batches add up in any order.
    Rows without stream, event time or ingestion time are left out. A hot
    stream is reduced map-side: at most one row per period and batch moves.
    """
    ms = to_millis(event_time)
    start = (F.floor(ms / period_ms) * period_ms).cast("bigint")
    lag = F.col(ingestion) - (F.col("start") + period_ms)
    return (
        df.where(F.col(stream).isNotNull() & F.col(event_time).isNotNull() & F.col(ingestion).isNotNull())
        .select(F.col(stream), F.col(batch), start.alias("start"), F.col(ingestion))
        .select(
            F.col(stream).alias("log_stream_name"),
            F.col("start").alias("hour_start_ms"),
            F.col(batch).alias("batch_id"),
            (lag <= grace_ms).cast("bigint").alias("f"),
            ((lag > grace_ms) & (lag <= cutoff_ms)).cast("bigint").alias("l"),
            (lag > cutoff_ms).cast("bigint").alias("r"),
        )
        .groupBy("log_stream_name", "hour_start_ms", "batch_id")
        .agg(F.sum("f").alias("n_first"), F.sum("l").alias("n_late"), F.sum("r").alias("n_refused"))
    )


def combine(partials: DataFrame) -> DataFrame:
    """Combine partials on read: the first count, the corrected one, the refused."""
    return partials.groupBy("log_stream_name", "hour_start_ms").agg(
        F.sum("n_first").alias("n_first"),
        (F.sum("n_first") + F.sum("n_late")).alias("n_final"),
        F.sum("n_refused").alias("n_refused"),
    )


def merge_batch(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Incremental merge: partials of new batches beside the stored ones.

    A batch that is merged again replaces its earlier partials, so a retried
    job doesn't count twice.
    """
    again = new.select("batch_id").distinct()
    kept = stored.join(again, stored["batch_id"].eqNullSafe(again["batch_id"]), "left_anti")
    return kept.unionByName(new)


def corrected(partials: DataFrame) -> DataFrame:
    """The periods that any event reached after the grace time."""
    return combine(partials).where("n_final > n_first or n_refused > 0")
