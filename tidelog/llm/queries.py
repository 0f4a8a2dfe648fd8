"""Queries over the test tables by the operators of this package, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog import oracles
from tidelog.llm import digests, leaks, mixing, runs, subjects
from tidelog.runtime import table


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """All percentiles with stated bound and certified error."""
    return digests.all_percentiles(table(spark, d, "log_metric"), table(spark, d, "endpoint_latency"))


def p1_certified(spark: SparkSession, d: str) -> DataFrame:
    """Every group of every level: how many values it has, whether the counted
    rank error keeps the stated bound, and, for groups of up to 100 values,
    which no digest may blur, the percentile itself."""
    p = p1_percentiles(spark, d)
    keys = ["column_name", "group_name", "service", F.unix_micros("period").cast("string").alias("period_us"), "level", "quantile", "n"]
    return p.select(*keys, (F.col("error") <= F.col("bound")).alias("within_bound"), F.when(F.col("n") <= 100, F.col("estimate")).alias("small_estimate"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The runs without their times, which are therefore not read."""
    found = runs.found_runs(table(spark, d, "log_entry"), table(spark, d, "dedup_group"), times=False)
    return found.select("source_table", "first_id", "last_id", "event_count")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each run as one event: count, first and last time as its events state them."""
    return runs.found_runs(table(spark, d, "log_entry"), table(spark, d, "dedup_group"))


def p4_similar(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal or nearly equal events at most ten minutes apart."""
    return runs.similar_runs(table(spark, d, "log_entry"), table(spark, d, "dedup_group"))


def p4_relay(spark: SparkSession, d: str) -> DataFrame:
    """The runs of dedup_group alone, with their times."""
    return runs.collapse(runs.relay_events(table(spark, d, "dedup_group"))).where("event_count > 1").select("stream", "first_id", "last_id", "event_count", "first_us", "last_us")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 13 words of a passage up to one edit in 20 characters."""
    return leaks.nearly_leaked(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The multiset of each mix: copies of each document."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares each source reached, in tokens."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


GOALS = {"targets": {}, "all tokens": {"total": "all"}, "even": {"evenness": 0.9}}


def p9_goals(spark: SparkSession, d: str) -> DataFrame:
    """Every goal a mix may have: the targets, as many tokens as there are (the
    exponent is bisected to the repeat limits), an entropy of nine tenths of the
    greatest (bisected to it). Per source whether its copies keep the limit and
    its tokens come within one document of the budget, and whether the shares
    of the mix add up to 1."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_target")
    counted = mixing.counted_documents(docs)
    out = None
    for goal, how in GOALS.items():
        r = mixing.mix(docs, targets, counted=counted, **how)[1]
        r = r.select(
            F.lit(goal).alias("goal"), "mix_name", "doc_source", "max_repeats", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"),
            (F.abs(F.col("mixed_tokens") - F.col("budget")) <= F.col("largest") + 1).alias("within_a_document"),
            (F.abs(F.sum("reached_share").over(W.partitionBy("mix_name")) - 1) < 1e-9).alias("adds_up"),
        )
        out = r if out is None else out.unionByName(r)
    return out


def p9_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Exponents, weights and shares where the total is that of all sources."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"), total="all")[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(table(spark, d, "documents"), table(spark, d, "subject_label"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the corpus by subject."""
    docs = table(spark, d, "documents")
    return subjects.composition(docs, subjects.subjects(docs, table(spark, d, "subject_label")), table(spark, d, "subject_area"))


def p10_rules(spark: SparkSession, d: str) -> DataFrame:
    """The mined rules: their words, the class they tell most, and its share."""
    r = subjects.fit(table(spark, d, "documents"), table(spark, d, "subject_label"))
    rows = [(list(k), r.classes[max(range(len(v)), key=v.__getitem__)], max(v)) for k, v in sorted(r.table.items())]
    return spark.createDataFrame(rows, "words array<string>, subject string, confidence double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_percentiles, p1_certified, p4_found, p4_runs, p4_similar, p4_relay, p8_found, p8_near, p9_mix, p9_shares, p9_goals, p9_tempered, p10_found, p10_composition, p10_rules)}


def _constant(line: str) -> str:
    """:func:`runs.constant_text` as DuckDB says it."""
    c = f"lower(rtrim(regexp_replace({line}, '\\x1b\\[[0-9;]*[A-Za-z]', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
    for pattern, put in ((runs.TIMES, "#"), (r"(^|[^\w])[+-]?(?:[a-z_][a-z_.@-]*)?\d[\w.:+@-]*%?", r"\1#"), (r"#(?:,#)+", "#"), (runs.UNITS, "#"), (r"\s\s+|[\t\r\n]", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{put}', 'g')"
    return f"trim({c}, ' ')"


_RELAY = f"""w AS (SELECT coalesce(stream_name, '') AS stream, group_id, coalesce(event_count, 1) AS n, coalesce(epoch_us(coalesce(first_ts, last_ts)), 0) AS t0, coalesce(epoch_us(coalesce(last_ts, first_ts)), 0) AS t1, {_constant("coalesce(line, '')")} AS c FROM dedup_group),
 d AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY group_id) AS run FROM (SELECT *, coalesce(c = lag(c) OVER (PARTITION BY stream ORDER BY group_id), FALSE) AS same FROM w)),
 relay AS (SELECT stream, min(group_id) AS first_id, max(group_id) AS last_id, CAST(sum(n) AS BIGINT) AS event_count, min(t0) AS first_us, max(t1) AS last_us FROM d GROUP BY stream, run HAVING sum(n) > 1)"""


_RUNS = f"""e AS (SELECT stream, min(row_id) AS id, any_value(l) FILTER (h IS NOT NULL) || chr(31) || arg_min(component, row_id) || chr(31) || string_agg(c, chr(31) ORDER BY row_id) AS key, count(*) AS n, arg_min(line, row_id) AS line
   FROM (SELECT *, {oracles.LEVEL_SQL} AS l, {_constant('line')} AS c FROM heads WHERE source_table = 'log_entry' AND gid > 0) GROUP BY stream, gid),
 r AS (SELECT *, CASE WHEN n = 1 AND contains(line, 'repeated') THEN TRY_CAST(nullif(regexp_extract(lower(line), '{runs.REPEATED}', 1), '') AS BIGINT) END AS told FROM e),
 k AS (SELECT *, last_value(CASE WHEN told IS NULL THEN key END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eff, last_value(CASE WHEN told IS NULL THEN key END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
 g AS (SELECT *, sum(CASE WHEN told IS NULL AND key IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY id) AS run FROM k WHERE eff IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_certified": """WITH once AS (SELECT metric_name, labels['service'] AS service, batch_day, metric_value AS v FROM log_metric
    QUALIFY metric_id IS NULL OR row_number() OVER (PARTITION BY metric_id ORDER BY batch_day NULLS FIRST) = 1),
 ends AS (SELECT endpoint_pattern, window_start, min(p50_ms) AS p50, min(p99_ms) AS p99 FROM endpoint_latency GROUP BY window_id, endpoint_pattern, window_start, shard_name),
 metric_groups AS (SELECT 'metric_value' AS column_name, metric_name AS group_name, NULL AS service, NULL::TIMESTAMP AS period, 'metric_name' AS level, v FROM once
  UNION ALL SELECT 'metric_value', metric_name, service, NULL, 'metric_name+service', v FROM once
  UNION ALL SELECT 'metric_value', metric_name, NULL, batch_day::TIMESTAMP, 'metric_name+batch_day', v FROM once
  UNION ALL SELECT 'metric_value', metric_name, service, batch_day::TIMESTAMP, 'metric_name+service+batch_day', v FROM once),
 both_columns AS (SELECT 'p50_ms' AS c, endpoint_pattern, window_start::TIMESTAMP AS w, p50 AS v FROM ends UNION ALL SELECT 'p99_ms', endpoint_pattern, window_start::TIMESTAMP, p99 FROM ends),
 everything AS (SELECT * FROM metric_groups UNION ALL SELECT c, endpoint_pattern, NULL, NULL, 'endpoint_pattern', v FROM both_columns UNION ALL SELECT c, endpoint_pattern, NULL, w, 'endpoint_pattern+window', v FROM both_columns),
 g AS (SELECT column_name, group_name, service, period, level, list_sort(list(v)) AS vs, count(*) AS n FROM everything WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2, 3, 4, 5)
SELECT column_name, group_name, service, CAST(epoch_us(period) AS VARCHAR) AS period_us, level, quantile, n, TRUE AS within_bound, CASE WHEN n <= 100 THEN vs[greatest(1, ceil(quantile * n - 1e-9)::BIGINT)] END AS small_estimate
FROM g, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE), (0.999::DOUBLE)) AS q(quantile)""",
        "p4_relay": f"WITH {_RELAY} SELECT * FROM relay",
        "p4_found": f"""WITH {oracles.P2_HEADS}, {_RELAY}, {_RUNS}
SELECT 'log_entry' AS source_table, min(id) AS first_id, max(id) AS last_id, CAST(sum(coalesce(told, 1)) AS BIGINT) AS event_count FROM g GROUP BY stream, run HAVING sum(coalesce(told, 1)) > 1
UNION ALL SELECT 'dedup_group', first_id, last_id, event_count FROM relay""",
        "p4_runs": f"""WITH {oracles.P2_TIMED}, {_RELAY}, {_RUNS}
SELECT 'log_entry' AS source_table, stream, min(id) AS first_id, max(id) AS last_id, CAST(sum(coalesce(told, 1)) AS BIGINT) AS event_count, min(event_us) AS first_us, max(event_us) AS last_us
FROM g JOIN timed t ON t.source_table = 'log_entry' AND t.row_id = g.id GROUP BY stream, run HAVING sum(coalesce(told, 1)) > 1
UNION ALL SELECT 'dedup_group', stream, first_id, last_id, event_count, first_us, last_us FROM relay""",
        "p8_found": r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS ws FROM eval_item),
 g AS (SELECT DISTINCT item_id, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
 d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
 h AS (SELECT doc_id, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)""",
        "p9_goals": """SELECT goal, mix_name, regexp_replace(lower(trim(doc_source)), '[\\s-]+', '_', 'g') AS doc_source, max(max_repeats) AS max_repeats, TRUE AS within_repeats, TRUE AS within_a_document, TRUE AS adds_up
FROM mix_target, (VALUES ('targets'), ('all tokens'), ('even')) AS g(goal) GROUP BY ALL""",
    }
