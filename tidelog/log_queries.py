"""Queries for the log operators over the events table, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import structured
from tidelog.model import EVENT_SQL, event_log, label, labels_text
from tidelog.operators import alerts, analytics, lateness, traces, views
from tidelog.plans import compiler
from tidelog.runtime import table
from tidelog.sources import registry, remote, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def ev(sql: str) -> str:
    return f"WITH {EVENT_SQL} {sql}"


ROW = ("seq", "line")


@query(ev("SELECT seq, service || ' ' || json_extract_string(line_json, '$.k') AS line FROM ev WHERE lvl = 'error' AND regexp_matches(coalesce(json_extract_string(line_json, '$.k'), ''), '6.*') ORDER BY seq LIMIT 10"))
def pip_slice(spark, d):
    """Selector, json, label filter, line_format, limit end to end."""
    return compiler.run(event_log(spark, d, "json"), '{level="error"} | json | k=~"6.*" | line_format "{{.service}} {{.k}}" | limit 10').select(*ROW)


@query(ev("SELECT seq, json_extract_string(line_json, '$.k') AS k FROM ev"))
def pip_json(spark, d):
    return compiler.run(event_log(spark, d, "json"), "{} | json").select("seq", label("k").alias("k"))



@query(ev("SELECT seq, lvl AS l, service AS svc, CAST(seq AS VARCHAR) AS n FROM ev"))
def pip_logfmt(spark, d):
    rows = event_log(spark, d).withColumn("line", F.concat(F.lit("l="), label("level"), F.lit(' junk svc="'), label("service"), F.lit('" n='), F.col("seq").cast("string")))
    return compiler.run(rows, "{} | logfmt").select("seq", label("l").alias("l"), label("svc").alias("svc"), label("n").alias("n"))


@query(ev(r"SELECT seq, regexp_extract(line_text, '^(\w+) /u/(\d+)', 1) AS kind, regexp_extract(line_text, '^(\w+) /u/(\d+)', 2) AS user_no FROM ev"))
def pip_regex(spark, d):
    return compiler.run(event_log(spark, d), r'{} | regex `^(?P<kind>\w+) /u/(?P<user_no>\d+)`').select("seq", label("kind").alias("kind"), label("user_no").alias("user_no"))


@query(ev("SELECT seq, line_text AS line FROM ev WHERE lvl <> 'info' AND regexp_matches(service, '[13]') AND NOT regexp_matches(lvl, 'deb') AND coalesce(NULL, '') = ''"))
def pip_label_filters(spark, d):
    return compiler.run(event_log(spark, d), '{} | level!="info" | service=~"[13]" | level!~"deb" | absent=""').select(*ROW)


@query(ev("SELECT seq, line_text AS line FROM ev WHERE contains(line_text, 'click') AND NOT contains(line_text, '/u/7 ') AND regexp_matches(line_text, 'took [0-9]{2}\\.') AND NOT regexp_matches(line_text, '5ms$')"))
def pip_line_filters(spark, d):
    return compiler.run(event_log(spark, d), r'{} |= "click" != "/u/7 " |~ `took [0-9]{2}\.` !~ "5ms$"').select(*ROW)


@query(ev("SELECT seq, '[' || lvl || '] ' || service || ' {{.none}}' AS line FROM ev"))
def pip_line_format(spark, d):
    return compiler.run(event_log(spark, d), '{} | line_format "[{{.level}}] {{ .service }} {{.none}}"').select(*ROW)


@query(ev("SELECT seq, 'service=' || service AS labels FROM ev"))
def pip_label_drop(spark, d):
    return compiler.run(event_log(spark, d), "{} | label_drop level").select("seq", labels_text(F.col("labels")).alias("labels"))


@query(ev("SELECT seq, 'level=' || lvl AS labels FROM ev"))
def pip_label_keep(spark, d):
    return compiler.run(event_log(spark, d), "{} | label_keep level, nothing").select("seq", labels_text(F.col("labels")).alias("labels"))


@query(ev("SELECT seq, lvl AS line FROM ev QUALIFY lag(lvl) OVER (ORDER BY seq) IS DISTINCT FROM lvl"))
def pip_dedup(spark, d):
    return compiler.run(event_log(spark, d), '{} | line_format "{{.level}}" | dedup').select(*ROW)


@query(ev("SELECT seq, line_text AS line FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM ev WHERE lvl = 'error') WHERE i % 7 = 0"))
def pip_sample(spark, d):
    return compiler.run(event_log(spark, d), '{level="error"} | sample 7').select(*ROW)


@query(ev("SELECT seq, line_text AS line FROM ev ORDER BY seq LIMIT 25"))
def pip_limit(spark, d):
    return compiler.run(event_log(spark, d), "{} | rate | limit 25").select(*ROW)


@query(ev("SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM ev GROUP BY 1"))
def pip_rate_extension(spark, d):
    return compiler.rate(event_log(spark, d), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(ev("SELECT seq, line_text AS line FROM ev WHERE regexp_full_match(service, 'svc-[01]') AND lvl = 'warn'"))
def sel_matchers(spark, d):
    return compiler.run(event_log(spark, d), '{service=~"svc-[01]", level="warn"}').select(*ROW)


@query(ev("SELECT seq, 'json' AS kind, 'k=' || json_extract_string(line_json, '$.k') AS fields FROM ev"))
def str_structured(spark, d):
    s = structured.structured(F.col("line"))
    return event_log(spark, d, "json").withColumn("s", s).where("s is not null").select("seq", F.col("s.kind").alias("kind"), labels_text(F.col("s.fields")).alias("fields"))



@query(ev("SELECT seq, coalesce(json_extract_string(line_json, '$.k'), '-') AS k, '-' AS missing FROM ev"))
def str_tabular(spark, d):
    return views.tabular(event_log(spark, d, "json"), ["k", "missing"], sort_by="k")


@query(ev("SELECT seq, line_text AS line FROM ev WHERE regexp_matches(line_text, '(?i)PURCHASE /u/1')"))
def vw_search(spark, d):
    return views.search(event_log(spark, d), "PURCHASE /u/1").select(*ROW)


@query(ev("""SELECT seq, m AS is_match, coalesce(i - lag(i) OVER (ORDER BY seq) > 1, i > 0) AS gap_before FROM (
  SELECT *, max(CASE WHEN m THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, row_number() OVER (ORDER BY seq) - 1 AS i
  FROM (SELECT *, regexp_matches(line_text, '(?i)purchase /u/1[0-4] ') AS m FROM ev)) WHERE near = 1"""))
def vw_context(spark, d):
    return views.context(event_log(spark, d), "purchase /u/1[0-4] ", 3).select("seq", "is_match", "gap_before")


DEDUP_SQL = "SELECT {k} AS pattern, count(*) AS n, arg_min(ts, seq) AS first_ts, arg_max(ts, seq) AS last_ts, max(seq) AS last_seq FROM ev GROUP BY 1"
NORM_SQL = "regexp_replace(regexp_replace({x}, '\\b\\d+(\\.\\d+)?\\s*(ms|us|µs|ns|s|sec|min)\\b', '<DUR>', 'g'), '\\b\\d{2,}\\b', '<N>', 'g')"


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query(ev(DEDUP_SQL.format(k="line_text")))
def vw_dedup_exact(spark, d):
    return _ntz(views.dedup(event_log(spark, d)).drop("line"), "first_ts", "last_ts")


@query(ev(DEDUP_SQL.format(k=NORM_SQL.replace("{x}", "line_text"))))
def vw_dedup_fuzzy(spark, d):
    return _ntz(views.dedup(event_log(spark, d), fuzzy=True).drop("line"), "first_ts", "last_ts")



@query(ev("SELECT lvl AS level, count(*) AS n FROM ev GROUP BY 1"))
def vw_stats_levels(spark, d):
    return views.stats_levels(event_log(spark, d))


@query(ev("SELECT count(*) AS total, round(avg(CASE WHEN lvl IN ('error', 'err', 'fatal', 'critical') THEN 1 ELSE 0 END) * 100, 6) AS error_rate FROM ev"))
def vw_stats_summary(spark, d):
    return views.stats_summary(event_log(spark, d)).withColumn("error_rate", F.round("error_rate", 6))


@query(ev("SELECT service AS source, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, source LIMIT 5"))
def vw_top_sources(spark, d):
    return views.top_sources(event_log(spark, d))


HIST_SQL = """, b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, count(*) AS total, count(*) FILTER (lvl = 'error') AS errors, count(*) FILTER (lvl = 'warn') AS warnings FROM ev GROUP BY 1),
 spine AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 6 HOUR)) AS bucket),
 h AS (SELECT bucket, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM spine LEFT JOIN b USING (bucket))"""


@query(f"WITH {EVENT_SQL}{HIST_SQL} SELECT * FROM h")
def vw_histogram(spark, d):
    return _ntz(views.histogram(event_log(spark, d), 6 * 3600, last=None), "bucket")


@query(f"WITH {EVENT_SQL}{HIST_SQL} SELECT CASE WHEN count(*) >= 3 THEN round(avg(total) + 2 * stddev_pop(total), 6) END AS threshold FROM h WHERE total > 0")
def vw_histogram_threshold(spark, d):
    return views.histogram_threshold(views.histogram(event_log(spark, d), 6 * 3600, last=None)).select(F.round("threshold", 6).alias("threshold"))


@query(f"WITH {EVENT_SQL}{HIST_SQL} SELECT bucket, CASE WHEN total > 90 THEN 'error' WHEN total = 0 THEN 'info' WHEN errors / total > 0.3 THEN 'error' WHEN warnings / total > 0.3 THEN 'warn' ELSE 'info' END AS class FROM h")
def vw_histogram_class(spark, d):
    h = views.histogram(event_log(spark, d), 6 * 3600, last=None)
    return _ntz(h.select("bucket", views.bucket_class(F.lit(90)).alias("class")), "bucket")


@query(ev("""SELECT coalesce(l.ts, r.ts) AS ts, CASE WHEN l.seq IS NULL THEN 'right_only' WHEN r.seq IS NULL THEN 'left_only' ELSE 'both' END AS side, l.seq AS left_seq, r.seq AS right_seq
  FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY seq) AS k FROM ev WHERE contains(line_text, 'click')) l
  FULL JOIN (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY seq) AS k FROM ev WHERE contains(line_text, '/u/1')) r ON l.ts = r.ts AND l.k = r.k"""))
def vw_diff(spark, d):
    return _ntz(views.diff_queries(event_log(spark, d), "click", "/u/1").select("ts", "side", "left_seq", "right_seq"), "ts")


@query(ev(r"SELECT seq, line_text AS line, regexp_extract(line_text, '/u/(\d+) took (\d+)', 0) AS match, strpos(line_text, '/u/') - 1 AS start, 'match ' || (strpos(line_text, '/u/') - 1) || ' ' || (strpos(line_text, '/u/') - 1 + length(regexp_extract(line_text, '/u/(\d+) took (\d+)', 0))) || ',user_no ' || (strpos(line_text, '/u/') + 2) || ' ' || (strpos(line_text, ' took ') - 1) || ',group_2 ' || (strpos(line_text, ' took ') + 5) || ' ' || (strpos(line_text, '/u/') - 1 + length(regexp_extract(line_text, '/u/(\d+) took (\d+)', 0))) AS ranges, regexp_extract(line_text, '/u/(\d+) took (\d+)', 1) AS user_no, regexp_extract(line_text, '/u/(\d+) took (\d+)', 2) AS group_2 FROM ev WHERE regexp_matches(line_text, '/u/(\d+) took (\d+)') ORDER BY seq LIMIT 500"))
def vw_playground(spark, d):
    p = views.playground(event_log(spark, d), r"/u/(?P<user_no>\d+) took (\d+)")
    return p.withColumn("start", F.col("start").cast("bigint")).withColumn("ranges", F.array_join(F.transform("ranges", lambda x: F.concat_ws(" ", x["name"], x["start"], x["end"])), ","))


@query(ev("SELECT seq, line_text AS line FROM ev ORDER BY seq DESC LIMIT 1000"))
def vw_newest(spark, d):
    return views.newest(event_log(spark, d), 1000).select(*ROW)


@query(ev("SELECT DISTINCT service AS name FROM ev WHERE contains(lower(service), 'vc-1')"))
def vw_suggest(spark, d):
    names = event_log(spark, d).select(label("service").alias("name")).distinct()
    return views.suggest(names, "vc-1", order="name").select("name")


CLUSTER_SQL = r"""WITH RECURSIVE toks AS (SELECT seq, line, list_filter(string_split_regex(line, '[ \t\n\f\r=:]'), lambda x: x <> '') AS t FROM log_entry),
 rows AS MATERIALIZED (SELECT len(t) AS size, row_number() OVER (PARTITION BY len(t) ORDER BY seq) AS k, seq, line, t FROM toks WHERE len(t) > 0),
 state(size, k, pats) USING KEY (size) AS (
  SELECT size, CAST(1 AS BIGINT) AS k, [{'t': t, 'n': CAST(1 AS BIGINT), 'example': line, 'first_seq': seq}] AS pats FROM rows WHERE k = 1
  UNION
  SELECT size, k, CASE WHEN list_max(sims) >= 0.4 THEN list_transform(pats, lambda p, i: CASE WHEN i = list_position(sims, list_max(sims)) THEN {'t': list_transform(p.t, lambda x, j: CASE WHEN x = t[j] THEN x ELSE '{*}' END), 'n': p.n + 1, 'example': line, 'first_seq': p.first_seq} ELSE p END)
    ELSE list_append(pats, {'t': t, 'n': CAST(1 AS BIGINT), 'example': line, 'first_seq': seq}) END
  FROM (SELECT s.size, r.k, s.pats, r.t, r.line, r.seq, list_transform(s.pats, lambda p: len(list_filter(range(1, s.size + 1), lambda i: p.t[i] = r.t[i] OR p.t[i] = '{*}')) / s.size) AS sims FROM state s JOIN rows r ON r.size = s.size AND r.k = s.k + 1)),
 found AS (SELECT array_to_string(p.t, ' ') AS template, p.n AS n, p.example AS example, p.first_seq AS first_seq FROM (SELECT unnest(pats) AS p FROM state))"""


@query(f"{CLUSTER_SQL} SELECT * FROM found")
def ana_cluster(spark, d):
    """All patterns of log_entry's lines. The SQL folds each token count row by row."""
    return analytics.cluster(table(spark, d, "log_entry")).select("template", "n", "example", "first_seq")


@query(f"{CLUSTER_SQL} SELECT template, n FROM found ORDER BY n DESC, template LIMIT 20")
def ana_top_patterns(spark, d):
    return analytics.top_patterns(analytics.cluster(table(spark, d, "log_entry"))).select("template", "n")


@query(f"{CLUSTER_SQL} SELECT template, n, first_seq FROM found JOIN (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS i FROM log_entry) ON seq = first_seq WHERE i >= 1000")
def ana_new_clusters(spark, d):
    """Patterns that came up after the first thousand rows."""
    return analytics.new_cluster_patterns(table(spark, d, "log_entry")).select("template", "n", "first_seq")


@query(ev("""SELECT tick, actual, round(expected, 6) AS expected, round(z, 6) AS z FROM (
 SELECT tick, actual, expected, CASE WHEN sd > 0 THEN (actual - expected) / sd WHEN actual > 0 AND (expected = 0 OR actual > 2 * expected) THEN 'inf'::DOUBLE END AS z FROM (
  SELECT tick, actual, count(*) OVER w AS k, avg(actual) OVER w AS expected, stddev_pop(actual) OVER w AS sd FROM (
   SELECT s.tick, coalesce(c, 0) AS actual FROM (SELECT unnest(generate_series((SELECT min(time_bucket(INTERVAL 1 HOUR, ts)) FROM ev), (SELECT max(time_bucket(INTERVAL 1 HOUR, ts)) FROM ev), INTERVAL 1 HOUR)) AS tick) s
   LEFT JOIN (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS tick, count(*) AS c FROM ev WHERE lvl = 'error' GROUP BY 1) g ON s.tick = g.tick)
  WINDOW w AS (ORDER BY tick ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE k >= 2) WHERE z > 2
 AND tick >= (SELECT min(time_bucket(INTERVAL 1 HOUR, ts)) FROM ev WHERE lvl = 'error')""").replace("FROM ev), (SELECT max(time_bucket(INTERVAL 1 HOUR, ts)) FROM ev)", "FROM ev WHERE lvl = 'error'), (SELECT max(time_bucket(INTERVAL 1 HOUR, ts)) FROM ev WHERE lvl = 'error')"))
def ana_volume(spark, d):
    v = analytics.volume_anomalies(event_log(spark, d).where(label("level") == "error"), 3600, 60, 2.0)
    return _ntz(v.withColumns({"expected": F.round("expected", 6), "z": F.round("z", 6)}), "tick")


@query(ev("SELECT k AS template, min(seq) AS seq FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i, regexp_extract(line_text, '^(\\S+ \\S+)', 1) AS k FROM ev) GROUP BY 1 HAVING min(i) >= 100"))
def ana_new_patterns(spark, d):
    return analytics.new_patterns(event_log(spark, d), F.regexp_extract("line", r"^(\S+ \S+)", 1), 100).select("template", "seq")


@query(ev("""SELECT label, value, round(coalesce(be / nullif(bt, 0), 0), 6) AS baseline_rate, round(ce / ct, 6) AS current_rate FROM (
  SELECT label, value, count(*) FILTER (now) AS ct, count(*) FILTER (now AND err) AS ce, count(*) FILTER (NOT now) AS bt, count(*) FILTER (NOT now AND err) AS be FROM (
   SELECT ts >= (SELECT max(ts) FROM ev) - INTERVAL 10 DAY AS now, lvl = 'error' AS err, unnest(['level', 'service']) AS label, unnest([lvl, service]) AS value FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 25 DAY) GROUP BY 1, 2) WHERE ce > 0"""))
def ana_correlation(spark, d):
    c = analytics.error_correlation(event_log(spark, d), 15 * 1440, 10 * 1440)
    return c.select("label", "value", F.round("baseline_rate", 6).alias("baseline_rate"), F.round("current_rate", 6).alias("current_rate"))


LAT_SQL = """, lat AS (SELECT array_to_string(list_filter(string_split_regex(trim(line_text), '\\s+'), lambda t: NOT regexp_matches(t, '^[0-9.:TZ-]*$'))[1:3], ' ') AS endpoint,
  CAST(regexp_extract(line_text, '(?i)(?:duration|latency|took|elapsed|time)[=: ]+(\\d+(?:\\.\\d+)?)\\s*(?:ms|s|us)', 1) AS DOUBLE) AS ms FROM ev)"""


@query(f"WITH {EVENT_SQL}{LAT_SQL}, l AS (SELECT endpoint, list_sort(list(ms)) AS v FROM lat GROUP BY 1) SELECT endpoint, v[((len(v)-1)*50)//100 + 1] AS p50_ms, v[((len(v)-1)*95)//100 + 1] AS p95_ms, v[((len(v)-1)*99)//100 + 1] AS p99_ms, v[len(v)] AS max_ms, len(v) AS n FROM l ORDER BY p95_ms DESC, endpoint LIMIT 10")
def ana_slowest(spark, d):
    return analytics.slowest_endpoints(event_log(spark, d))


@query(ev("SELECT service AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ev), 6) AS pct FROM ev GROUP BY 1 ORDER BY n DESC, value LIMIT 10"))
def ana_noisiest(spark, d):
    return analytics.noisiest(event_log(spark, d)).withColumn("pct", F.round("pct", 6))


@query(ev("SELECT service AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ev WHERE lvl = 'error'), 6) AS pct FROM ev WHERE lvl = 'error' GROUP BY 1 ORDER BY n DESC, value LIMIT 10"))
def ana_top_errors(spark, d):
    return analytics.noisiest(event_log(spark, d), errors_only=True).withColumn("pct", F.round("pct", 6))


@query(ev(""", e AS (SELECT max(ts) AS m FROM ev), p AS (SELECT i, avg(err) AS ratio, row_number() OVER (ORDER BY i) - 1 AS x FROM (
   SELECT CAST(floor(epoch(ts - (m - INTERVAL 20 DAY)) / 86400) AS BIGINT) AS i, CASE WHEN lvl = 'error' THEN 1 ELSE 0 END AS err FROM ev, e WHERE ts >= m - INTERVAL 20 DAY AND ts < m) GROUP BY 1)
 SELECT count(*) AS points, round(regr_slope(ratio, x), 8) AS slope, round(CASE WHEN var_pop(ratio) = 0 THEN 0 ELSE regr_r2(ratio, x) END, 6) AS r2 FROM p HAVING count(*) >= 2""").replace(") , e AS", "), e AS"))
def ana_trend(spark, d):
    return analytics.trend(event_log(spark, d), 20, 86400).select("points", F.round("slope", 8).alias("slope"), F.round("r2", 6).alias("r2"))


METRIC_SQL = "SELECT seq, 'duration_ms' AS name, CAST(regexp_extract(l, 'took=(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS value FROM (SELECT seq, replace(line_text, 'took ', 'took=') AS l FROM ev)"


@query(ev(METRIC_SQL))
def ana_metrics(spark, d):
    rows = event_log(spark, d).withColumn("line", F.replace("line", F.lit("took "), F.lit("took=")))
    return analytics.extract_metrics(rows).select("seq", "name", "value")


@query(ev("SELECT seq, 'k' AS name, CAST(json_extract_string(line_json, '$.k') AS DOUBLE) AS value FROM ev"))
def ana_json_metrics(spark, d):
    return analytics.json_metrics(event_log(spark, d, "json")).select("seq", "name", "value")


def _trace_rows(spark, d):
    tid = F.lpad(F.hex(F.col("seq") % 97), 32, "0")
    sid = F.lpad(F.hex(F.col("seq") % 5), 16, "0")
    return event_log(spark, d).withColumn("line", F.concat(F.col("line"), F.lit(" trace_id="), tid, F.lit(" span_id="), sid))


TRACE_SQL = f"{EVENT_SQL}, t AS (SELECT *, lpad(upper(to_hex(seq % 97)), 32, '0') AS tid, lpad(upper(to_hex(seq % 5)), 16, '0') AS sid FROM ev)"


@query(f"WITH {TRACE_SQL} SELECT tid AS trace_id, 'trace' AS trace_kind, count(*) AS n FROM t GROUP BY 1")
def trc_detect(spark, d):
    return traces.with_ids(_trace_rows(spark, d)).groupBy("trace_id", "trace_kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRACE_SQL} SELECT tid AS trace_id, sid AS span_key, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(service, seq) AS service, CASE WHEN bool_or(lvl = 'error' OR contains(lower(line_text), 'error')) THEN 'error' ELSE 'ok' END AS status, count(*) AS entries FROM t GROUP BY 1, 2")
def trc_spans(spark, d):
    return _ntz(traces.spans(_trace_rows(spark, d)).select("trace_id", "span_key", "start_ts", "end_ts", "service", "status", "entries"), "start_ts", "end_ts")


@query(f"WITH {TRACE_SQL}, s AS (SELECT tid, sid, min(ts) AS a, max(ts) AS b, arg_min(service, seq) AS service, bool_or(lvl = 'error') AS e FROM t GROUP BY 1, 2) SELECT tid AS trace_id, count(*) AS n_spans, CAST(epoch_us(arg_max(b, (a, sid))) - epoch_us(min(a)) AS BIGINT) AS total_us, count(DISTINCT service) AS service_count, count(*) FILTER (e) AS error_count FROM s GROUP BY 1")
def trc_traces(spark, d):
    return traces.traces(_trace_rows(spark, d)).select("trace_id", "n_spans", "total_us", "service_count", "error_count")


@query(f"WITH {TRACE_SQL}, g AS (SELECT tid, min(ts) AS a, max(ts) AS b FROM t GROUP BY 1 HAVING count(*) >= 2) SELECT t.tid AS trace_id, seq, service, CAST(floor((epoch_us(b) - epoch_us(a)) / 1000) AS BIGINT) AS total_ms, CAST(floor((epoch_us(ts) - epoch_us(a)) / 1000) AS BIGINT) AS offset_ms FROM t JOIN g ON t.tid = g.tid")
def trc_waterfall(spark, d):
    return traces.waterfall(_trace_rows(spark, d)).select("trace_id", "seq", "service", "total_ms", "offset_ms")


def _rules(*rules: alerts.Rule) -> alerts.Config:
    return alerts.Config(True, 300, list(rules))


@query(ev("SELECT 'pay' AS rule, seq FROM ev WHERE regexp_matches(line_text, 'purchase /u/1[0-9] ') AND service = 'svc-3'"))
def alr_pattern(spark, d):
    return alerts.evaluate(event_log(spark, d), _rules(alerts.Rule("pay", "pattern_match", pattern="purchase /u/1[0-9] ", cooldown_seconds=0, labels=(("service", "svc-3"),)))).select("rule", "seq")


@query(ev("SELECT 'bad' AS rule, seq FROM ev WHERE lvl IN ('warn', 'error', 'fatal')"))
def alr_level(spark, d):
    return alerts.evaluate(event_log(spark, d), _rules(alerts.Rule("bad", "level_threshold", level="warn", cooldown_seconds=0))).select("rule", "seq")


@query(ev("SELECT 'many' AS rule, seq FROM (SELECT seq, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM ev WHERE lvl = 'error') WHERE n >= 3"))
def alr_rate(spark, d):
    rows = event_log(spark, d)
    return alerts.evaluate(rows, _rules(alerts.Rule("many", "rate_threshold", count=3, window_seconds=3600, cooldown_seconds=0, labels=(("level", "error"),)))).select("rule", "seq")


@query(ev(""", m AS (SELECT seq, ts, row_number() OVER (ORDER BY seq) AS i FROM ev WHERE lvl = 'warn')
SELECT seq FROM f""").replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT seq FROM f", ", f AS (SELECT seq, ts FROM m WHERE i = 1 UNION ALL SELECT n.seq, n.ts FROM f, LATERAL (SELECT seq, ts FROM m WHERE m.ts >= f.ts + INTERVAL 6 HOUR ORDER BY seq LIMIT 1) n) SELECT 'slow' AS rule, seq FROM f"))
def alr_cooldown(spark, d):
    rule = alerts.Rule("slow", "level_threshold", level="warn", cooldown_seconds=6 * 3600, labels=(("level", "warn"),))
    return alerts.evaluate(event_log(spark, d), _rules(rule)).select("rule", "seq")


@query(ev("SELECT lvl || ';' || service AS pair, count(*) AS n FROM ev GROUP BY 1"))
def udf_plugins(spark, d):
    """A transform and a filter as registered batch functions."""
    from tidelog.plugins import Plugin, Registry

    def tag(b):
        return b.assign(line=[f"{dict(x)['level']};{dict(x)['service']}" for x in b["labels"]])

    r = Registry()
    r.add(Plugin("tag", "transform", tag))
    r.add(Plugin("keep", "filter", lambda b: b["line"] != ""))
    return r.apply(event_log(spark, d)).groupBy(F.col("line").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@query(ev("SELECT 'a' AS src, seq FROM ev WHERE lvl = 'error' UNION ALL SELECT 'b' AS src, seq FROM ev WHERE lvl = 'warn'"))
def src_merge(spark, d):
    rows = event_log(spark, d)
    both = registry.merge({"a": rows.where(label("level") == "error"), "b": rows.where(label("level") == "warn")})
    return both.select(label("__source__").alias("src"), "seq")



@query(ev("SELECT service AS value, count(*) AS n FROM ev GROUP BY 1"))
def src_label_values(spark, d):
    return registry.label_values(event_log(spark, d), "service", 100)



@query("SELECT delivery_id AS seq, CASE WHEN abs(event_timestamp) < 100000000000 THEN event_timestamp * 1000000 WHEN abs(event_timestamp) >= 100000000000000 THEN (event_timestamp // 1000) * 1000 ELSE event_timestamp * 1000 END AS ts_us, 'log_group=g;log_stream=' || coalesce(log_stream_name, '') AS labels, coalesce(message, '') AS line FROM filtered_log_event WHERE event_timestamp IS NOT NULL")
def src_cloudwatch_events(spark, d):
    """All events with a time; some agents write s or µs, which are brought to ms."""
    e = table(spark, d, "filtered_log_event").withColumn("event_timestamp", lateness.to_millis("event_timestamp"))
    return remote.cloudwatch_events(e, "g", order="delivery_id").select("seq", F.unix_micros("ts").alias("ts_us"), labels_text(F.col("labels")).alias("labels"), "line")


@query(ev("SELECT seq, lvl AS level, 'service=' || service AS labels, line_text AS line FROM ev"))
def snk_csv(spark, d):
    return sinks.csv_columns(event_log(spark, d)).select("seq", "level", "labels", "line")


@query(ev("""SELECT seq, json_extract_string(v, '$.line') AS line, json_extract_string(v, '$.labels.service') AS service FROM (SELECT seq, json_object('line', line_text, 'labels', json_object('service', service)) AS v FROM ev)"""))
def snk_ndjson(spark, d):
    return sinks.as_json(event_log(spark, d)).select("seq", F.get_json_object("value", "$.line").alias("line"), F.get_json_object("value", "$.labels.service").alias("service"))
