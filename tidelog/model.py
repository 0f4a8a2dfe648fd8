"""The one row type of the engine and the predicates over its labels.

A log row is ``seq bigint`` (arrival order, the only order operators rely on),
``ts timestamp``, ``labels map<string,string>``, ``line string``, ``raw string``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "seq bigint, ts timestamp, labels map<string,string>, line string, raw string"
BLOCK = 65_536


class SourceError(Exception):
    """A source can't be used; the subclasses say why."""


class ConnectionFailed(SourceError):
    pass


class AuthFailed(SourceError):
    pass


class QueryFailed(SourceError):
    pass


class TimedOut(SourceError):
    pass


class RateLimited(SourceError):
    pass


def label(key: str) -> Column:
    return F.col("labels")[key]


def first_label(*keys: str, default: str | None = None) -> Column:
    cols = [label(k) for k in keys]
    return F.coalesce(*cols, F.lit(default)) if default is not None else F.coalesce(*cols)


def level_of_alert() -> Column:
    """level, else severity, in lower case."""
    return F.lower(first_label("level", "severity"))


def level_of_stats() -> Column:
    """level, else severity, else lvl, else 'unknown', in lower case."""
    return F.lower(first_label("level", "severity", "lvl", default="unknown"))


def is_error_analytics() -> Column:
    """level is error or fatal (analytics)."""
    return F.coalesce(F.lower(label("level")).isin("error", "fatal"), F.lit(False))


def is_error_stats(level: Column) -> Column:
    """error, err, fatal or critical (statistics and histogram)."""
    return F.coalesce(F.lower(level).isin("error", "err", "fatal", "critical"), F.lit(False))


def is_error_span() -> Column:
    """The line contains 'error' or the level is error (traces)."""
    return F.contains(F.lower("line"), F.lit("error")) | F.coalesce(F.lower(label("level")) == "error", F.lit(False))


def merge_labels(base: Column, new: Column) -> Column:
    """``new`` entries over ``base``, without relying on the session's duplicate policy."""
    return F.when(new.isNull(), base).otherwise(F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(new, k)), new))


def labels_text(labels: Column) -> Column:
    """Labels as ``k=v;`` in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def row_index(df: DataFrame, order: str = "seq", name: str = "idx", block: int = BLOCK) -> DataFrame:
    """0-based position of each row in ``order``, without sorting in one task.

    Rows are numbered within blocks of ``block`` order values; the blocks'
    offsets come from a running sum over one row per block.
    """
    b = df.withColumn("_b", F.floor(F.col(order) / block))
    offsets = b.groupBy("_b").count().withColumn("_o", F.coalesce(F.sum("count").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    local = b.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(order)) - 1)
    return local.join(offsets, "_b").withColumn(name, F.col("_o") + F.col("_r")).drop("_b", "_o", "_r")


def with_previous(df: DataFrame, cols: dict[str, str], order: str = "seq", block: int = BLOCK) -> DataFrame:
    """Add columns of the row before in ``order``: ``cols`` maps column to new name.

    As :func:`row_index`: the last row of each block goes to the next block,
    over one row per block. Null in the first row of all.
    """
    b = df.withColumn("_b", F.floor(F.col(order) / block))
    last = b.groupBy("_b").agg(F.max_by(F.struct(*cols), order).alias("_s")).withColumn("_l", F.lag("_s").over(W.orderBy("_b"))).drop("_s")
    w = W.partitionBy("_b").orderBy(order)
    local = b.withColumn("_p", F.lag(F.struct(*cols)).over(w))
    joined = local.join(last, "_b", "left").withColumn("_q", F.coalesce("_p", "_l"))
    return joined.withColumns({new: F.col("_q")[c] for c, new in cols.items()}).drop("_b", "_p", "_l", "_q")


def running_sum(df: DataFrame, value: Column, name: str, order: str = "seq", block: int = BLOCK) -> DataFrame:
    """Running sum of ``value`` in ``order`` over all rows, block by block."""
    b = df.withColumn("_b", F.floor(F.col(order) / block)).withColumn("_v", value)
    offsets = b.groupBy("_b").agg(F.sum("_v").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    local = b.withColumn("_r", F.sum("_v").over(W.partitionBy("_b").orderBy(order)))
    return local.join(offsets, "_b").withColumn(name, F.col("_o") + F.col("_r")).drop("_b", "_v", "_o", "_r")


def event_log(spark: SparkSession, d: str, line: str = "text") -> DataFrame:
    """The events table as log rows; ``line`` is 'text' or 'json'."""
    e = spark.read.parquet(f"{d}/events.parquet")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warn").when(F.col("event_type") == "signup", "debug").otherwise("info")
    service = F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))
    text = F.concat(F.col("event_type"), F.lit(" /u/"), F.col("user_id").cast("string"), F.lit(" took "), F.col("value").cast("string"), F.lit("ms"))
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.create_map(F.lit("level"), level, F.lit("service"), service).alias("labels"), (F.col("props") if line == "json" else text).alias("line"), F.lit(None).cast("string").alias("raw"))


#: The same view in SQL, for the oracles: lvl, service, line_text, line_json.
EVENT_SQL = """ev AS (SELECT event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'debug' ELSE 'info' END AS lvl,
  'svc-' || (user_id % 5) AS service, event_type || ' /u/' || user_id || ' took ' || value || 'ms' AS line_text, props AS line_json FROM events)"""
