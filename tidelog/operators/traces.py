"""Trace detection in lines and trace reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import first_label, is_error_span

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
HEX32, HEX16 = "[0-9a-fA-F]{32}", "[0-9a-fA-F]{16}"
# JSON members and text patterns by kind, in order of priority.
JSON_IDS = (("trace_id", "trace"), ("traceId", "trace"), ("request_id", "request"), ("requestId", "request"), ("correlationId", "correlation"), ("correlation_id", "correlation"), ("span_id", "span"), ("spanId", "span"))
TEXT_IDS = (
    (rf"(?i)(?:trace_id|traceId|trace-id)\s*[=:]\s*({HEX32}|{UUID})", "trace"),
    (rf"(?i)(?:request_id|requestId|req_id)\s*[=:]\s*({UUID}|{HEX32})", "request"),
    (rf"(?i)(?:correlation_id|correlationId)\s*[=:]\s*({UUID}|{HEX32})", "correlation"),
    (rf"(?i)X-Request-Id:\s*({UUID})", "request"),
    (rf"(?i)(?:span_id|spanId)\s*[=:]\s*({HEX16})", "span"),
)
SPAN_TEXT = TEXT_IDS[-1][0]
PARENT_TEXT = rf"(?i)(?:parent_span_id|parentSpanId|parent_id|parentId)\s*[=:]\s*({HEX16})"
SPAN_TEXT_FIXED = rf"(?i)(?<![A-Za-z0-9]|parent_)(?:span_id|spanId)\s*[=:]\s*({HEX16})"
PARENT_JSON = ("parent_span_id", "parentSpanId", "parent_id", "parentId")
WATERFALL = r"(?i)(?:duration|took|latency|elapsed)[=: ]+(\d+(?:\.\d+)?)\s*(ms|s)"


def with_ids(df: DataFrame, fixed: bool = False) -> DataFrame:
    """Add ``trace_id``, ``trace_kind``, ``span_id``, ``parent_span_id``.

    JSON members come first, of any form; then text patterns. By default the
    span pattern also hits inside ``parent_span_id=``; ``fixed`` prevents that.
    The line is parsed once, beside the generated code, which stays whole.
    """

    def read(s: Column) -> Column:
        def member(name: str) -> Column:
            return F.nullif(F.try_variant_get(s["v"], f"$.{name}", "string"), F.lit(""))

        def text(pattern: str) -> Column:
            return F.nullif(F.regexp_extract(s["line"], pattern, 1), F.lit(""))

        options = [(member(n), k) for n, k in JSON_IDS] + [(text(p), k) for p, k in TEXT_IDS]
        found = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("id"), F.lit(k).alias("kind"))) for v, k in options])
        span = F.coalesce(member("span_id"), member("spanId"), text(SPAN_TEXT_FIXED if fixed else SPAN_TEXT))
        parent = F.coalesce(*[member(n) for n in PARENT_JSON], text(PARENT_TEXT))
        return F.struct(found.alias("t"), span.alias("s"), parent.alias("p"))

    v = F.try_parse_json(F.when(F.ltrim("line").startswith("{"), F.trim("line")))
    rows = df.withColumn("_x", F.transform(F.array(F.struct(F.col("line"), v.alias("v"))), read)[0])
    return rows.withColumns({"trace_id": F.col("_x.t.id"), "trace_kind": F.col("_x.t.kind"), "span_id": F.col("_x.s"), "parent_span_id": F.col("_x.p")}).drop("_x")


def spans(df: DataFrame, fixed: bool = False) -> DataFrame:
    """Spans of all detected traces: first row's fields, time range, status."""
    rows = with_ids(df, fixed).where("trace_id is not null")
    present = lambda *k: F.coalesce(*[F.when(F.col("labels")[x] != "", F.col("labels")[x]) for x in k])
    rows = rows.withColumns({"service": present("service", "app", "job", "container"), "operation": present("operation", "op", "method", "endpoint"), "bad": is_error_span()})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy("trace_id", F.coalesce("span_id", F.lit("_default")).alias("span_key")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), first("parent_span_id"), first("service"), first("operation"),
        F.when(F.bool_or("bad"), "error").otherwise("ok").alias("status"), F.count(F.lit(1)).alias("entries"),
    ).withColumn("duration_us", F.unix_micros("end_ts") - F.unix_micros("start_ts"))


def traces(df: DataFrame, fixed: bool = False) -> DataFrame:
    """Traces: spans, total duration, services, errors. The total ends with the
    span that starts last; ``fixed`` takes the latest end."""
    s = spans(df, fixed)
    end = F.max("end_ts") if fixed else F.max_by("end_ts", F.struct("start_ts", "span_key"))
    return s.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_spans"), F.min("start_ts").alias("start_ts"), (F.unix_micros(end) - F.unix_micros(F.min("start_ts"))).alias("total_us"), F.count_distinct("service").alias("service_count"), F.count(F.when(F.col("status") == "error", 1)).alias("error_count"))


def waterfall(df: DataFrame, columns: int = 60) -> DataFrame:
    """Rows of traces with two or more rows, with offset and width in columns."""
    rows = with_ids(df).where("trace_id is not null").withColumn("service", first_label("service", "app", "job", default="unknown"))
    v, unit = F.regexp_extract("line", WATERFALL, 1), F.regexp_extract("line", WATERFALL, 2)
    rows = rows.withColumn("duration_ms", F.when(v != "", v.try_cast("double") * F.when(unit == "s", 1000).otherwise(1)))
    t = rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1")).where("n >= 2")
    total = F.greatest(F.floor((F.unix_micros("t1") - F.unix_micros("t0")) / 1000), F.lit(0))
    out = rows.join(t, "trace_id").withColumn("total_ms", total).withColumn("offset_ms", F.floor((F.unix_micros("ts") - F.unix_micros("t0")) / 1000))
    scale = lambda c: F.coalesce(F.floor(F.try_divide(F.col(c) * columns, F.col("total_ms"))), F.lit(0)).cast("int")
    return out.select("trace_id", "seq", "ts", "service", "line", "duration_ms", "total_ms", "offset_ms", scale("offset_ms").alias("offset_col"), scale("duration_ms").alias("width_col"), "t1")
