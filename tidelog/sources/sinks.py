"""Exports of log rows: JSON, NDJSON, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import first_label

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row; ``raw`` is left out where there is none."""
    row = F.struct(F.date_format("ts", ISO).alias("timestamp"), "labels", "line", F.try_parse_json("raw").alias("raw"))
    return df.select("seq", F.to_json(row).alias("value"))


def write_ndjson(df: DataFrame, path: str) -> None:
    as_json(df).orderBy("seq").select("value").write.mode("overwrite").text(path)


def json_array(df: DataFrame) -> DataFrame:
    """All rows as one JSON array: for exports of a bounded view, in one row."""
    return as_json(df).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), ",\n"), F.lit("]")).alias("value"))


def quoted(c: Column) -> Column:
    return F.when(c.rlike(r'[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_columns(df: DataFrame) -> DataFrame:
    """timestamp, level, labels (sorted ``k=v;`` without levels), line."""
    rest = F.filter(F.array_sort(F.map_entries("labels")), lambda e: ~e["key"].isin("level", "severity", "lvl"))
    labels = F.array_join(F.transform(rest, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return df.select("seq", F.date_format("ts", ISO).alias("timestamp"), first_label("level", "severity", "lvl", default="").alias("level"), labels.alias("labels"), "line")


def as_csv(df: DataFrame) -> DataFrame:
    """One CSV record per row, quoted only where needed."""
    c = csv_columns(df)
    return c.select("seq", F.concat_ws(",", *[quoted(F.col(x)) for x in ("timestamp", "level", "labels", "line")]).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    csv_columns(df).orderBy("seq").drop("seq").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
