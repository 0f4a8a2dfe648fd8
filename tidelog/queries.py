"""Queries over the test tables by the operators of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import oracles
from tidelog.operators import delivery, entries, hierarchy, lateness, nested, templates
from tidelog.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return entries.found_entries(table(spark, d, "log_entry"), table(spark, d, "grouped_entry"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return entries.all_lines(table(spark, d, "log_entry"), table(spark, d, "grouped_entry"))


def p2_templates(spark: SparkSession, d: str) -> DataFrame:
    """The templates of all lines: constants and slots, lines, shapes merged,
    and what the header's slots hold."""
    m = templates.mine(_lines(spark, d), "line")
    text = F.udf(templates.readable, "string")
    return m.select(text("template").alias("template"), "lines", "shapes", (F.col("time_group") > 0).alias("has_time"), (F.col("level_group") > 0).alias("has_level"), (F.col("component_group") > 0).alias("has_component"))


def p2_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with their message and all of their lines, one below the other."""
    lines = _lines(spark, d)
    parsed = entries.parse_headers(lines, templates.layouts(lines, "line"))
    return entries.entry_texts(parsed).select("source_table", "row_id", "line_no", "event_us", "log_level", "component", "message", F.array_join("lines", "\n").alias("entry_text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "trace_span"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy with each span's path from its root."""
    return hierarchy.hierarchy(table(spark, d, "trace_span"), with_path=True)


def p3_rings(spark: SparkSession, d: str) -> DataFrame:
    """Spans caught in rings: the ring, its members told from spans below, and
    the links that close it."""
    return hierarchy.rings(table(spark, d, "trace_span"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every span with each of its descendants and how far below it is."""
    return hierarchy.descendants(p3_paths(spark, d))


def json_records(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "es_hit").select(F.lit("es_hit").alias("source_table"), F.col("hit_id").alias("row_id"), F.col("_source").alias("text"))
    return hits.unionByName(table(spark, d, "log_entry").select(F.lit("log_entry").alias("source_table"), F.col("seq").alias("row_id"), F.col("raw").alias("text")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.flatten_records(json_records(spark, d), source="source_table", row_id="row_id", text="text", with_object=False)
    return rows.select("source_table", "row_id", "child_path", "parent_path", "n_fields")


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables that come out: rows and records by kind of object."""
    rows = nested.flatten_records(json_records(spark, d), source="source_table", row_id="row_id", text="text", with_object=False)
    return rows.groupBy("source_table", "table_path").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_records"), F.max("n_fields").alias("max_fields"))


def p6_partials(spark: SparkSession, d: str) -> DataFrame:
    """Partial aggregates per stream, hour and arrival batch over the kept copies."""
    kept = delivery.keep_first(table(spark, d, "filtered_log_event"), carry=["log_stream_name", "event_timestamp", "ingestion_time", "batch_id"])
    return lateness.partial_counts(kept)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lateness.corrected(p6_partials(spark, d))


def p6_merged(spark: SparkSession, d: str) -> DataFrame:
    """All periods as known once the newest batch is merged into what was
    stored before; merging it twice, as a retried job does, changes nothing."""
    p = p6_partials(spark, d)
    newest = p.agg(F.max("batch_id").alias("m"))
    marked = p.withColumn("newest", newest.scalar())
    old, new = marked.where("batch_id < newest or batch_id is null").drop("newest"), marked.where("batch_id = newest").drop("newest")
    return lateness.combine(lateness.merge_batch(lateness.merge_batch(old, new), new))


def p7_unseen(spark: SparkSession, d: str) -> DataFrame:
    """What the newest batch adds to the messages of all batches before it."""
    e = table(spark, d, "filtered_log_event")
    marked = e.withColumn("newest", e.agg(F.max("batch_id").alias("m")).scalar())
    return delivery.unseen(marked.where("batch_id = newest").drop("newest"), marked.where("batch_id < newest or batch_id is null")).select("delivery_id", "log_stream_name", "event_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.surplus_copies(table(spark, d, "filtered_log_event"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Exactly one row for each message, with all of its columns."""
    return delivery.keep_first(table(spark, d, "filtered_log_event"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_templates, p2_entries, p3_found, p3_paths, p3_rings, p3_descendants, p5_found, p5_tables, p6_partials, p6_found, p6_merged, p7_found, p7_kept, p7_unseen)}


_KEY = "lower(regexp_replace(event_id, '^\\s+|\\s+$', '', 'g'))"
_KEPT = f"""kept AS (
  SELECT * FROM filtered_log_event
  QUALIFY log_stream_name IS NULL OR event_id IS NULL
    OR row_number() OVER (PARTITION BY log_stream_name, {_KEY} ORDER BY delivery_id) = 1)"""
_COUNTED = f"""{_KEPT}, ms AS (
  SELECT log_stream_name, batch_id, ingestion_time,
    CASE WHEN abs(event_timestamp) < 100000000000 THEN event_timestamp * 1000
         WHEN abs(event_timestamp) >= 100000000000000 THEN CAST(floor(event_timestamp / 1000) AS BIGINT)
         ELSE event_timestamp END AS t
  FROM kept WHERE log_stream_name IS NOT NULL AND event_timestamp IS NOT NULL AND ingestion_time IS NOT NULL),
 lag AS (SELECT log_stream_name, batch_id, CAST(floor(t / 3600000) * 3600000 AS BIGINT) AS hour_start_ms,
    ingestion_time - (CAST(floor(t / 3600000) * 3600000 AS BIGINT) + 3600000) AS late FROM ms)"""
_TREE = """ids AS (
  SELECT lower(trim(trace_id)) AS trace_id, lower(trim(span_id)) AS span_id,
    max(CASE WHEN regexp_full_match(lower(trim(parent_span_id)), '0*') THEN NULL ELSE lower(trim(parent_span_id)) END) AS parent
  FROM trace_span WHERE span_id IS NOT NULL AND trace_id IS NOT NULL AND trim(span_id) <> '' GROUP BY 1, 2),
 up AS (SELECT c.trace_id, c.span_id, p.span_id AS parent FROM ids c LEFT JOIN ids p ON p.trace_id = c.trace_id AND p.span_id = c.parent),
 tree AS (
  SELECT trace_id, span_id, span_id AS root, 0 AS depth, span_id AS path FROM up WHERE parent IS NULL
  UNION ALL
  SELECT u.trace_id, u.span_id, t.root, t.depth + 1, t.path || '/' || u.span_id FROM up u JOIN tree t ON u.trace_id = t.trace_id AND u.parent = t.span_id),
 anc AS (SELECT trace_id, unnest(string_split(path, '/')) AS a FROM tree),
 below AS (SELECT trace_id, a, count(*) - 1 AS n FROM anc GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": oracles.P2_FOUND,
        "p2_entries": oracles.P2_ENTRIES,
        "p5_found": oracles.P5_FOUND,
        "p5_tables": oracles.P5_TABLES,
        "p3_found": f"""WITH RECURSIVE {_TREE}
SELECT u.trace_id, u.span_id, coalesce(t.root, '') AS root_span_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS span_depth, CAST(coalesce(b.n, -1) AS INTEGER) AS n_descendants
FROM up u LEFT JOIN tree t USING (trace_id, span_id) LEFT JOIN below b ON b.trace_id = u.trace_id AND b.a = u.span_id""",
        "p3_paths": f"""WITH RECURSIVE {_TREE}
SELECT u.trace_id, u.span_id, coalesce(t.root, '') AS root_span_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS span_depth, CAST(coalesce(b.n, -1) AS INTEGER) AS n_descendants, t.path AS path
FROM up u LEFT JOIN tree t USING (trace_id, span_id) LEFT JOIN below b ON b.trace_id = u.trace_id AND b.a = u.span_id""",
        "p3_descendants": f"""WITH RECURSIVE {_TREE}, pairs AS (SELECT trace_id, span_id, depth, unnest(string_split(path, '/')) AS a, unnest(range(0, depth + 1)) AS pos FROM tree)
SELECT trace_id, a AS ancestor_id, span_id AS descendant_id, CAST(depth - pos AS INTEGER) AS distance FROM pairs WHERE pos < depth""",
        "p3_rings": f"""WITH RECURSIVE {_TREE}, caught AS (SELECT u.* FROM up u LEFT JOIN tree t USING (trace_id, span_id) WHERE t.span_id IS NULL),
 steps AS (
  SELECT trace_id, span_id AS start, span_id AS cur, [span_id] AS seen, FALSE AS over FROM caught
  UNION ALL
  SELECT s.trace_id, s.start, c.parent, list_append(s.seen, c.parent), list_contains(s.seen, c.parent) FROM steps s JOIN caught c ON c.trace_id = s.trace_id AND c.span_id = s.cur WHERE NOT s.over),
 ends AS (SELECT trace_id, start, seen[list_position(seen, cur):len(seen) - 1] AS ring FROM steps WHERE over)
SELECT trace_id, start AS span_id, list_contains(ring, start) AS on_ring, list_min(ring) AS cycle_id, CAST(len(ring) AS BIGINT) AS n_members, start = list_min(ring) AS back_edge FROM ends""",
        "p6_partials": f"""WITH {_COUNTED}
SELECT log_stream_name, hour_start_ms, batch_id, CAST(count(*) FILTER (late <= 900000) AS BIGINT) AS n_first,
  CAST(count(*) FILTER (late > 900000 AND late <= 86400000) AS BIGINT) AS n_late, CAST(count(*) FILTER (late > 86400000) AS BIGINT) AS n_refused
FROM lag GROUP BY 1, 2, 3""",
        "p6_found": f"""WITH {_COUNTED}
SELECT log_stream_name, hour_start_ms, CAST(count(*) FILTER (late <= 900000) AS BIGINT) AS n_first,
  CAST(count(*) FILTER (late <= 86400000) AS BIGINT) AS n_final, CAST(count(*) FILTER (late > 86400000) AS BIGINT) AS n_refused
FROM lag GROUP BY 1, 2 HAVING count(*) FILTER (late > 900000) > 0""",
        "p6_merged": f"""WITH {_COUNTED}
SELECT log_stream_name, hour_start_ms, CAST(count(*) FILTER (late <= 900000) AS BIGINT) AS n_first,
  CAST(count(*) FILTER (late <= 86400000) AS BIGINT) AS n_final, CAST(count(*) FILTER (late > 86400000) AS BIGINT) AS n_refused
FROM lag GROUP BY 1, 2""",
        "p7_unseen": f"""WITH k AS (SELECT *, {_KEY} AS k FROM filtered_log_event), n AS (SELECT max(batch_id) AS m FROM k)
SELECT delivery_id, log_stream_name, event_id FROM k, n WHERE batch_id = m
  AND NOT EXISTS (SELECT 1 FROM k o WHERE (o.batch_id < m OR o.batch_id IS NULL) AND o.log_stream_name = k.log_stream_name AND o.k = k.k)
QUALIFY log_stream_name IS NULL OR k IS NULL OR row_number() OVER (PARTITION BY log_stream_name, k ORDER BY delivery_id) = 1""",
        "p7_found": f"""WITH k AS (SELECT delivery_id, min(delivery_id) OVER (PARTITION BY log_stream_name, {_KEY}) AS kept_id
  FROM filtered_log_event WHERE log_stream_name IS NOT NULL AND event_id IS NOT NULL)
SELECT kept_id, delivery_id AS dropped_id FROM k WHERE delivery_id > kept_id""",
        "p7_kept": f"WITH {_KEPT} SELECT * FROM kept",
    }
