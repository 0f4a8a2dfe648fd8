"""Messages delivered more than once, and the copies to keep (problem 7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"^\s+|\s+$"


def message_key(event_id: str = "event_id") -> Column:
    """The identifier as it is compared: without outer blanks, in lower case."""
    return F.lower(F.regexp_replace(F.col(event_id), BLANKS, ""))


def keep_first(
    df: DataFrame,
    *,
    stream: str = "log_stream_name",
    event_id: str = "event_id",
    order: str = "delivery_id",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Exactly one row for each message: the one of rank 1 in arrival order.

    Rank 1 within ``(stream, identifier)`` is found as the minimum of the struct
    ``(order, carried columns)``, so copies are reduced map-side before the
    single shuffle and a message with a billion copies costs one row per map
    task; a window would sort all copies in one task. ``order`` must be unique;
    the carried columns break ties if it is not.

    A null stream or identifier matches nothing: such rows are all kept (the
    third key, non-null only for them, keeps them apart). Rows whose ``order``
    is null are dropped only when a copy with an order exists. Empty input
    gives empty output. The result has the columns of ``carry`` (default: all).
    """
    cols = list(carry) if carry is not None else df.columns
    lone = F.col(stream).isNull() | F.col(event_id).isNull()
    fields = [F.col(order).isNull().alias("o0"), F.col(order).alias("o1")]
    fields += [F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]
    keyed = df.select(
        F.col(stream).alias("k0"),
        message_key(event_id).alias("k1"),
        F.when(lone, F.col(order)).alias("k2"),
        F.struct(*fields).alias("row"),
    )
    first = keyed.groupBy("k0", "k1", "k2").agg(F.min("row").alias("row"))
    return first.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(cols)])


def surplus_copies(
    df: DataFrame,
    *,
    stream: str = "log_stream_name",
    event_id: str = "event_id",
    order: str = "delivery_id",
    salts: int | None = None,
) -> DataFrame:
    """One row ``(kept_id, dropped_id)`` for each surplus copy of a message.

    The keys are pre-aggregated per salt and then once more per key; only keys
    that occur more than once go back to the rows, joined on (key, salt), so a
    key with a third of all rows is spread over ``salts`` tasks (default: as
    many as the session shuffles to). Nulls in the
    stream, the identifier or the order match nothing. Rows repeated with the
    same order value count as one row.
    """
    salts = salts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.where(F.col(stream).isNotNull() & F.col(event_id).isNotNull() & F.col(order).isNotNull()).select(
        F.col(stream).alias("k0"),
        message_key(event_id).alias("k1"),
        F.col(order).alias("id"),
        F.pmod(F.hash(F.col(order)), F.lit(salts)).alias("salt"),
    )
    part = rows.groupBy("k0", "k1", "salt").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    whole = (
        part.groupBy("k0", "k1")
        .agg(F.min("lo").alias("kept_id"), F.max("hi").alias("hi"), F.collect_set("salt").alias("salts"))
        .where("hi > kept_id")
        .select("k0", "k1", "kept_id", F.explode("salts").alias("salt"))
    )
    return (
        rows.join(whole, ["k0", "k1", "salt"])
        .where(F.col("id") > F.col("kept_id"))
        .select("kept_id", F.col("id").alias("dropped_id"))
        .distinct()
    )


def unseen(batch: DataFrame, stored: DataFrame, *, stream: str = "log_stream_name", event_id: str = "event_id", order: str = "delivery_id") -> DataFrame:
    """The rows of a new batch to store: first copies whose identifier isn't stored.

    ``stored`` needs only the stream and the identifier. The anti join shuffles
    keys of both sides; where the store is bucketed by them only the batch moves.
    """
    known = stored.where(F.col(stream).isNotNull()).select(F.col(stream).alias("s0"), message_key(event_id).alias("s1")).where("s1 is not null").distinct()
    first = keep_first(batch, stream=stream, event_id=event_id, order=order)
    return first.join(known, (first[stream] == known["s0"]) & (message_key(event_id) == known["s1"]), "left_anti")
