"""Log stores: their answers as rows, requests and their signing.

Answers saved as files are read by ``*_rows``; ``stores`` asks live ones.
Requests use the standard library only.
"""

from __future__ import annotations

import hashlib
import hmac
import urllib.error
import urllib.request
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.model import AuthFailed, ConnectionFailed, QueryFailed, RateLimited, TimedOut


def _numbered(df: DataFrame, *order) -> DataFrame:
    """seq in the order a store answers. An answer is bounded by its limit."""
    return df.withColumn("seq", (F.row_number().over(W.orderBy(*order)) - 1).cast("bigint")).select("seq", "ts", "labels", "line", "raw")


STREAMS = "status string, data struct<resultType:string,result:array<struct<stream:map<string,string>,values:array<array<string>>>>>"


def loki_rows(answers: DataFrame, column: str = "value") -> DataFrame:
    """Rows of range answers, newest first; ns times keep their µs."""
    v = answers.select(F.explode(F.from_json(column, STREAMS)["data"]["result"]).alias("s")).select(F.col("s.stream").alias("labels"), F.posexplode("s.values").alias("p", "v"))
    ns = F.col("v")[0].try_cast("bigint")
    rows = v.select(F.timestamp_micros(F.floor(ns / 1000)).alias("ts"), ns.alias("ns"), "p", "labels", F.col("v")[1].alias("line"), F.lit(None).cast("string").alias("raw"))
    return _numbered(rows, F.desc("ns"), F.array_sort(F.map_entries("labels")), "p")


def _es_time(text: Column) -> Column:
    iso = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^-?\d+$"), F.timestamp_millis(text.try_cast("bigint"))).when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]"), F.try_to_timestamp(iso))


def elastic_hits(hits: DataFrame, source: str = "_source", index: str = "_index", order: str | None = None) -> DataFrame:
    """Rows of search hits.

    Time: ``@timestamp``, else ``timestamp``, only as text (RFC 3339, ISO, or
    epoch ms); else the time of reading. Line: the first of message, msg and
    log that is present, if it is text, else the whole document. Labels: text,
    number and boolean members on top but those three, and ``_index``.
    Documents that aren't JSON objects keep their text as line.
    """
    doc = F.try_parse_json(F.col(source))
    rows = hits.withColumn("_v", doc).withColumn("_m", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.from_json(source, "map<string,string>")))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("_v", f"$['{k}']", "variant"))
    text = lambda k: F.when(kind(k) == "STRING", F.try_variant_get("_v", f"$['{k}']", "string"))
    there = lambda k: F.map_contains_key("_m", F.lit(k))
    ts = F.coalesce(F.when(there("@timestamp"), _es_time(text("@timestamp"))).otherwise(_es_time(text("timestamp"))), F.current_timestamp())
    first = F.when(there("message"), text("message")).when(there("msg"), text("msg")).when(there("log"), text("log"))
    line = F.coalesce(first, F.col(source))
    kinds = F.transform_values(F.col("_v").try_cast("map<string,variant>"), lambda k, v: F.schema_of_variant(v))
    flat = F.map_filter("_m", lambda k, v: v.isNotNull() & ~k.isin("message", "msg", "log") & ~F.coalesce(kinds[k].rlike("^(OBJECT|ARRAY|VOID)"), F.lit(False)))
    labels = F.map_concat(F.map_filter(F.coalesce(flat, F.create_map().cast("map<string,string>")), lambda k, v: k != "_index"), F.create_map(F.lit("_index"), F.coalesce(index, F.lit(""))))
    out = rows.select(*([F.col(order).alias("_o")] if order else []), ts.alias("ts"), labels.alias("labels"), line.alias("line"), F.col(source).alias("raw"))
    if order:
        return out.select(F.col("_o").alias("seq"), "ts", "labels", "line", "raw")
    return _numbered(out, F.desc("ts"), "line")


def elastic_rows(answers: DataFrame, column: str = "value") -> DataFrame:
    hits = answers.select(F.explode(F.from_json(column, "hits struct<hits:array<struct<_index:string,_source:string>>>")["hits"]["hits"]).alias("h")).select("h.*")
    return elastic_hits(hits)


def cloudwatch_events(events: DataFrame, group: str = "", order: str | None = None) -> DataFrame:
    """Rows of filtered events; those without a time are dropped. Columns:
    log_stream_name, event_timestamp (ms), message, event_id, ingestion_time."""
    raw = F.to_json(F.struct("log_stream_name", "event_timestamp", "message", "event_id", "ingestion_time"))
    rows = events.where("event_timestamp is not null").select(*([F.col(order).alias("_o")] if order else []), F.timestamp_millis("event_timestamp").alias("ts"), F.create_map(F.lit("log_group"), F.lit(group), F.lit("log_stream"), F.coalesce("log_stream_name", F.lit(""))).alias("labels"), F.coalesce("message", F.lit("")).alias("line"), raw.alias("raw"))
    return rows.select(F.col("_o").alias("seq"), "ts", "labels", "line", "raw") if order else _numbered(rows, F.desc("ts"), "line")


def cloudwatch_rows(answers: DataFrame, group: str = "", limit: int | None = None, column: str = "value") -> DataFrame:
    """Rows of saved answers; ``limit`` keeps the earliest, then newest first."""
    e = answers.select(F.explode(F.from_json(column, "events array<struct<logStreamName:string,timestamp:bigint,message:string,eventId:string,ingestionTime:bigint>>")["events"]).alias("e"))
    flat = e.select(F.col("e.logStreamName").alias("log_stream_name"), F.col("e.timestamp").alias("event_timestamp"), F.col("e.message").alias("message"), F.col("e.eventId").alias("event_id"), F.col("e.ingestionTime").alias("ingestion_time"))
    return cloudwatch_events(flat.orderBy("event_timestamp").limit(limit) if limit is not None else flat, group)


def signing_key(secret: str, day: str, region: str, service: str) -> bytes:
    """The derived key of request signatures, version 4."""
    key = ("AWS4" + secret).encode()
    for part in (day, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def signed_headers(access: str, secret: str, region: str, service: str, host: str, target: str, body: bytes, now: datetime, token: str = "") -> dict[str, str]:
    """Headers of a signed POST to ``/``."""
    stamp, day = now.strftime("%Y%m%dT%H%M%SZ"), now.strftime("%Y%m%d")
    headers = {"content-type": "application/x-amz-json-1.1", "host": host, "x-amz-date": stamp, "x-amz-target": target} | ({"x-amz-security-token": token} if token else {})
    names = ";".join(sorted(headers))
    canonical = "\n".join(["POST", "/", "", *[f"{k}:{headers[k]}" for k in sorted(headers)], "", names, hashlib.sha256(body).hexdigest()])
    scope = f"{day}/{region}/{service}/aws4_request"
    text = "\n".join(["AWS4-HMAC-SHA256", stamp, scope, hashlib.sha256(canonical.encode()).hexdigest()])
    signature = hmac.new(signing_key(secret, day, region, service), text.encode(), hashlib.sha256).hexdigest()
    return headers | {"authorization": f"AWS4-HMAC-SHA256 Credential={access}/{scope}, SignedHeaders={names}, Signature={signature}"}


def search_body(query: str, start_ms: int, end_ms: int, size: int, after: list | None = None, ascending: bool = False) -> dict:
    """A search by query text and time range; empty text or ``{}`` matches all."""
    what = {"match_all": {}} if query.strip() in ("", "{}") else {"query_string": {"query": query}}
    order = "asc" if ascending else "desc"
    body = {"size": size, "query": {"bool": {"must": [what, {"range": {"@timestamp": {"gte": start_ms, "lte": end_ms, "format": "epoch_millis"}}}]}}, "sort": [{"@timestamp": order}, {"_id": order}] if ascending else [{"@timestamp": order}]}
    return body | ({"search_after": after} if after else {})


def ask(url: str, body: bytes | None = None, headers: dict[str, str] | None = None, timeout: float = 30) -> str:
    """One request; HTTP errors become the engine's errors."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers or {}), timeout=timeout) as r:
            return r.read().decode()
    except urllib.error.HTTPError as e:
        kind = AuthFailed if e.code in (401, 403) else RateLimited if e.code == 429 else QueryFailed
        raise kind(f"{url}: {e.code}") from e
    except TimeoutError as e:
        raise TimedOut(url) from e
    except urllib.error.URLError as e:
        raise ConnectionFailed(f"{url}: {e.reason}") from e
