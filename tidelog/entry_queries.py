"""Queries for the log operators over log_entry and its like, with their SQL.

The tables hold many programs' layouts, colour codes, carriage returns, odd
labels and broken JSON; each query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import structured
from tidelog.log_queries import ROW, query
from tidelog.model import is_error_analytics, label, labels_text, level_of_stats
from tidelog.operators import alerts, analytics, traces, views
from tidelog.plans import compiler, lang, nl
from tidelog.plugins import Plugin, Registry
from tidelog.runtime import table
from tidelog.sources import local, registry, remote, sinks


def log(spark, d):
    return table(spark, d, "log_entry")


TEXT = "array_to_string(list_transform(list_sort(map_entries({m})), lambda e: e.key || '=' || e.value), ';')"
LEVEL = "coalesce(labels['level'], labels['severity'], labels['lvl'], 'unknown')"
JSON = "(json_valid(line) AND json_type(CASE WHEN json_valid(line) THEN line END) = 'OBJECT')"


def member(path: str) -> str:
    return f"CASE WHEN {JSON} THEN json_extract_string(CASE WHEN {JSON} THEN line END, '{path}') END"


# Pipeline stages


@query(f"SELECT seq, coalesce({member('$.level')}, labels['level']) AS level, {member('$.logger')} AS logger, {member('$.severity')} AS json_severity, coalesce({member('$.msg')}, {member('$.message')}) AS message, labels['stream'] AS stream FROM (SELECT seq, labels, rtrim(line, chr(13)) AS line FROM log_entry)")
def log_json(spark, d):
    """Members of JSON lines over the labels of all lines; others stay as they are."""
    r = compiler.run(log(spark, d), "{} | json")
    sev = F.when(~F.coalesce(structured.json_labels(F.col("line"))["severity"].isNull(), F.lit(True)), label("severity"))
    return r.select("seq", label("level").alias("level"), label("logger").alias("logger"), sev.alias("json_severity"), F.coalesce(label("msg"), label("message")).alias("message"), label("stream").alias("stream"))


@query(f"SELECT seq, {member('$.log.level')} AS log_level, {member('$.log.logger')} AS log_logger, coalesce({member('$.message')}, labels['message']) AS message FROM (SELECT seq, labels, rtrim(line, chr(13)) AS line FROM log_entry)")
def log_unpack(spark, d):
    """Nested members as dotted labels."""
    return compiler.run(log(spark, d), "{} | unpack").select("seq", label("log.level").alias("log_level"), label("log.logger").alias("log_logger"), label("message").alias("message"))


@query(r"""SELECT seq, list_extract(regexp_extract_all(bare, '(?:^|\s)kept=(\d+)', 1), -1) AS kept, list_extract(regexp_extract_all(bare, '(?:^|\s)dropped=(\d+)', 1), -1) AS dropped FROM (SELECT seq, regexp_replace(line, '="(?:\\.|[^"\\])*"?', '=', 'g') AS bare FROM log_entry)""")
def log_logfmt(spark, d):
    """Pairs inside any line; quoted values hide what they hold."""
    return compiler.run(log(spark, d), "{} | logfmt").select("seq", label("kept").alias("kept"), label("dropped").alias("dropped"))


KEYED = r'''^(ts|severity|level)=[^\s"]+ [^\s"=]+="?[^\s"]+"? [^\s"=]+="[^"\\]*"|^(ts|severity|level)=\S+ \S+=\S+ msg="[^"\\]*"'''


@query(rf"""SELECT seq, CASE WHEN regexp_matches(line, '{KEYED}') THEN regexp_extract(line, '^(?:[^"]|"[^"]*")*?\bmsg="([^"]*)"', 1) END AS msg FROM log_entry""")
def log_logfmt_quoted(spark, d):
    """The quoted message of lines that are written as key-value pairs."""
    return compiler.run(log(spark, d), "{} | logfmt").select("seq", F.when(F.col("line").rlike(KEYED), label("msg")).alias("msg"))


@query(r"""SELECT seq, nullif(regexp_extract(line, '\[(\w+\.\w+)\] ([a-z]+)?', 1), '') AS logger, CASE WHEN regexp_matches(line, '\[(\w+\.\w+)\] ') THEN nullif(regexp_extract(line, '\[(\w+\.\w+)\] ([a-z]+)?', 2), '') END AS word FROM log_entry""")
def log_regex(spark, d):
    """Named groups, one of them optional: it is a label only where it took part."""
    return compiler.run(log(spark, d), r"{} | regex `\[(?P<logger>\w+\.\w+)\] (?P<word>[a-z]+)?`").select("seq", label("logger").alias("logger"), label("word").alias("word"))


@query(r"SELECT seq, line FROM log_entry WHERE contains(line, 'er') AND NOT contains(line, 'session') AND regexp_matches(line, '\d+ms|\d{3} \d+') AND NOT regexp_matches(line, '^\s')")
def log_line_filters(spark, d):
    return compiler.run(log(spark, d), r"{} |= `er` != `session` |~ `\d+ms|\d{3} \d+` !~ `^\s`").select(*ROW)


@query("SELECT seq, line FROM log_entry WHERE coalesce(labels['level'], '') <> 'info' AND regexp_matches(coalesce(labels['service'], ''), 'gateway|vault') AND NOT regexp_matches(coalesce(labels['region'], ''), '^north') AND coalesce(labels['job'], '') = ''")
def log_label_filters(spark, d):
    """Missing labels are empty texts to every operator."""
    return compiler.run(log(spark, d), '{} | level!="info" | service=~"gateway|vault" | region!~"^north" | job=""').select(*ROW)


@query("SELECT seq, line FROM log_entry WHERE regexp_full_match(coalesce(labels['namespace'], ''), 'li.e|lab') AND labels['host'] <> 'node-15' AND labels['service'] IS NOT NULL AND labels['service'] <> ''")
def log_selector(spark, d):
    return compiler.run(log(spark, d), '{namespace=~"li.e|lab", host!="node-15", service!=""}').select(*ROW)


@query("SELECT seq, '<' || coalesce(labels['service'], '{{.service}}') || '> ' || coalesce(labels['level'], '{{ .level }}') || ' {{.none}}' AS line FROM log_entry")
def log_line_format(spark, d):
    """What isn't a label stays as it is written."""
    return compiler.run(log(spark, d), '{} | line_format "<{{.service}}> {{ .level }} {{.none}}"').select(*ROW)


@query(f"SELECT seq, {TEXT.format(m='map_from_entries(list_filter(map_entries(labels), lambda e: e.key NOT IN (' + chr(39) + 'host' + chr(39) + ', ' + chr(39) + 'level' + chr(39) + ')))')} AS labels FROM log_entry")
def log_label_drop(spark, d):
    return compiler.run(log(spark, d), "{} | label_drop host, level").select("seq", labels_text(F.col("labels")).alias("labels"))


@query(f"SELECT seq, {TEXT.format(m='map_from_entries(list_filter(map_entries(labels), lambda e: e.key IN (' + chr(39) + 'service' + chr(39) + ', ' + chr(39) + 'app' + chr(39) + ')))')} AS labels FROM log_entry")
def log_label_keep(spark, d):
    return compiler.run(log(spark, d), "{} | label_keep service, app").select("seq", labels_text(F.col("labels")).alias("labels"))


@query("SELECT seq, coalesce(labels['namespace'], '{{.namespace}}') AS line FROM log_entry QUALIFY coalesce(labels['namespace'], '') IS DISTINCT FROM lag(coalesce(labels['namespace'], '')) OVER (ORDER BY seq)")
def log_dedup(spark, d):
    return compiler.run(log(spark, d), '{} | line_format "{{.namespace}}" | dedup').select(*ROW)


@query("SELECT seq, line FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM log_entry WHERE contains(line, 'probe')) WHERE i % 5 = 0 ORDER BY seq LIMIT 40")
def log_sample_limit(spark, d):
    return compiler.run(log(spark, d), "{} |= `probe` | sample 5 | limit 40").select(*ROW)


@query("SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS start, count(*) AS n FROM log_entry GROUP BY 1")
def log_rate(spark, d):
    return compiler.rate(log(spark, d), "1 minute").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT DISTINCT '{host="' || labels['host'] || '", stream="' || labels['stream'] || '"}' AS selector, 2 AS matchers FROM log_entry""")
def sel_build(spark, d):
    """Selectors built from labels, and how many matchers they are read back as."""
    rows = log(spark, d).select(label("host").alias("h"), label("stream").alias("s")).distinct()

    @F.udf("struct<selector:string,matchers:int>")
    def build(h, s):
        text = lang.build_selector([("host", h), ("stream", s)])
        return text, len(lang.matchers(text)) if lang.balanced(text) else 0

    return rows.select(build("h", "s").alias("x")).select("x.*")


# Structured lines


PAIRS = r"""regexp_extract_all(trim(line, ' '), '(?:[^\s=]+)=(?:"(?:\\.|[^"\\])*"?|''(?:\\.|[^''\\])*''?|[^\s"'']\S*)?|\S+')"""


@query(rf"""SELECT seq, CASE WHEN {JSON} AND len(json_keys(CASE WHEN {JSON} THEN line END)) > 0 THEN 'json' ELSE 'key_value' END AS kind FROM (SELECT seq, trim(rtrim(line, chr(13)), ' ') AS line FROM log_entry)
 WHERE ({JSON} AND len(json_keys(CASE WHEN {JSON} THEN line END)) > 0) OR len(list_filter({PAIRS}, lambda x: regexp_matches(x, '^[^\s=]+='))) >= 2""")
def log_structured(spark, d):
    """Which lines are JSON objects, which hold two pairs or more."""
    s = structured.structured(F.col("line"))
    return log(spark, d).select("seq", s["kind"].alias("kind")).where("kind is not null")


@query(f"""SELECT name, CASE WHEN name = 'timestamp' THEN 0 WHEN name = 'level' THEN 1 ELSE 2 END AS rank FROM (SELECT DISTINCT unnest(json_keys(CASE WHEN {JSON} THEN line END)) AS name FROM (SELECT rtrim(line, chr(13)) AS line FROM log_entry) WHERE {JSON})""")
def log_columns(spark, d):
    """Columns of the JSON lines in table order."""
    rows = log(spark, d).where(structured.structured(F.col("line"))["kind"] == "json")
    return views.columns_of(rows)


@query(f"""SELECT row_number() OVER (ORDER BY coalesce({member('$.message')}, '') DESC, seq) AS place, seq, coalesce({member('$.level')}, '-') AS level, coalesce({member('$.message')}, '-') AS message FROM (SELECT seq, rtrim(line, chr(13)) AS line FROM log_entry) WHERE {JSON}""")
def log_tabular(spark, d):
    """JSON lines as a table sorted by a column, with each row's place."""
    rows = log(spark, d).where(structured.structured(F.col("line"))["kind"] == "json")
    t = views.tabular(rows, ["level", "message"], sort_by="message", descending=True)
    key = F.when(F.col("message") == "-", "").otherwise(F.col("message"))
    return t.withColumn("place", F.row_number().over(views.W.orderBy(key.desc(), "seq")).cast("bigint")).select("place", "seq", "level", "message")


# Views


@query(r"SELECT seq, line FROM log_entry WHERE regexp_matches(line, '(?i)CANCELLED|lease on \w+')")
def log_search(spark, d):
    return views.search(log(spark, d), r"CANCELLED|lease on \w+").select(*ROW)


NORMAL_SQL = "line"
for _p, _to in views.NORMAL:
    NORMAL_SQL = f"regexp_replace({NORMAL_SQL}, '{_p}', '{_to}', 'g')"


@query(f"SELECT {NORMAL_SQL} AS pattern, count(*) AS n, max(seq) AS last_seq, arg_max(line, seq) AS line FROM log_entry GROUP BY 1")
def log_dedup_fuzzy(spark, d):
    """All six kinds of placeholders."""
    return views.dedup(log(spark, d), fuzzy=True).select("pattern", "n", "last_seq", "line")


@query("""SELECT group_id, CASE WHEN s IS NULL THEN '' WHEN s > 0 AND n > 1 THEN ' over ' || CASE WHEN s >= 3600 THEN (s // 3600) || 'h' WHEN s >= 60 THEN (s // 60) || 'm' ELSE s || 's' END ELSE '' END AS span
 FROM (SELECT group_id, coalesce(event_count, 1) AS n, abs(CAST(floor(epoch_us(last_ts) / 1000000) AS BIGINT) - CAST(floor(epoch_us(first_ts) / 1000000) AS BIGINT)) AS s FROM dedup_group)""")
def vw_span_text(spark, d):
    r = table(spark, d, "dedup_group")
    return r.select("group_id", views.span_text(F.coalesce("event_count", F.lit(1)), F.col("first_ts"), F.col("last_ts")).alias("span"))


@query(r"""WITH h AS (SELECT seq, line, labels['level'] IS NOT NULL OR labels['severity'] IS NOT NULL AS has FROM log_entry),
 c AS (SELECT *, CASE WHEN lag(seq) OVER (ORDER BY seq) IS NULL THEN 1 WHEN regexp_matches(line, '(?s)^(?:\t|  )|^\s*(?:(?i:at )|Caused by:|--- |File "|goroutine |[|+]|0x|#\s*[0-9]|\.\.\. (?:.* )?more$)') OR (lag(has) OVER (ORDER BY seq) AND NOT has) THEN 0 ELSE 1 END AS head FROM h),
 g AS (SELECT *, sum(head) OVER (ORDER BY seq) AS gid FROM c)
SELECT min(seq) AS seq, arg_min(line, seq) AS line, count(*) - 1 AS n, coalesce(string_agg(CASE WHEN head = 0 THEN line END, chr(10) ORDER BY seq), '') AS continuation FROM g GROUP BY gid""")
def log_multiline(spark, d):
    """Groups by looks and levels, in arrival order, with what continues them."""
    g = views.multiline(log(spark, d))
    return g.select("seq", "line", F.size("continuation_lines").cast("bigint").alias("n"), F.array_join("continuation_lines", "\n").alias("continuation"))


@query("SELECT l.seq, l.line FROM log_entry l WHERE l.seq IN (SELECT CAST(sort_values[1] AS BIGINT) % 1000 FROM es_hit WHERE sort_values IS NOT NULL)")
def vw_bookmarks(spark, d):
    """Rows marked by a list of numbers, some twice, some without a row."""
    marks = table(spark, d, "es_hit").where("sort_values is not null").select((F.get("sort_values", F.lit(0)) % 1000).alias("seq"))
    return views.bookmarks(log(spark, d), marks).select(*ROW)


@query("SELECT p AS minutes, count(*) AS n FROM log_entry, (VALUES (5), (15), (30), (60), (180), (360), (720), (1440), (2880), (10080)) AS m(p), (SELECT max(ts) AS newest FROM log_entry) WHERE ts >= newest - to_minutes(p) GROUP BY 1")
def vw_presets(spark, d):
    """Rows in each preset range before the newest row."""
    rows = log(spark, d)
    newest = rows.agg(F.max("ts").alias("m"))
    marked = rows.withColumn("now", newest.scalar())
    out = None
    for p in views.TIME_PRESETS_MIN:
        n = views.preset(marked, p, F.col("now")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("minutes"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT name, CASE WHEN starts_with(lower(name), 'node-1') THEN 0 ELSE 1 END AS rank FROM (SELECT DISTINCT labels['host'] AS name FROM log_entry) WHERE contains(lower(name), 'node-1')")
def vw_suggest_hosts(spark, d):
    names = log(spark, d).select(label("host").alias("name")).distinct()
    return views.suggest(names, "NODE-1", order="name").select("name", "rank")


@query(f"SELECT {LEVEL} AS level, count(*) AS n FROM log_entry GROUP BY 1")
def log_stats_levels(spark, d):
    return views.stats_levels(log(spark, d))


@query(f"SELECT count(*) AS total, round(avg(CASE WHEN {LEVEL} IN ('error', 'err', 'fatal', 'critical') THEN 1 ELSE 0 END) * 100, 6) AS error_rate FROM log_entry")
def log_stats_summary(spark, d):
    return views.stats_summary(log(spark, d)).withColumn("error_rate", F.round("error_rate", 6))


@query("SELECT coalesce(labels['service'], labels['app'], labels['job'], labels['container'], labels['source'], 'unknown') AS source, count(*) AS n FROM log_entry GROUP BY 1 ORDER BY n DESC, source LIMIT 15")
def log_top_sources(spark, d):
    return views.top_sources(log(spark, d), 15)


LOG_HIST = """b AS (SELECT epoch_us(ts) // 600000000 AS b, count(*) AS total, count(*) FILTER (lower(labels['level']) IN ('error', 'err', 'fatal', 'critical')) AS errors, count(*) FILTER (lower(labels['level']) IN ('warn', 'warning')) AS warnings FROM log_entry GROUP BY 1),
 spine AS (SELECT unnest(range((SELECT min(b) FROM b), (SELECT max(b) FROM b) + 1)) AS b),
 h AS (SELECT make_timestamp(b * 600000000) AS bucket, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM spine LEFT JOIN b USING (b))"""


@query(f"WITH {LOG_HIST} SELECT * FROM h")
def log_histogram(spark, d):
    """All buckets of ten minutes, the empty ones too."""
    return views.histogram(log(spark, d), 600, last=None).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(f"WITH {LOG_HIST} SELECT * FROM h ORDER BY bucket DESC LIMIT 60")
def log_histogram_last(spark, d):
    return views.histogram(log(spark, d), 600).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(f"WITH {LOG_HIST}, t AS (SELECT avg(total) + 2 * stddev_pop(total) AS threshold FROM h WHERE total > 0) SELECT bucket, CASE WHEN total > threshold THEN 'error' WHEN total = 0 THEN 'info' WHEN errors / total > 0.3 THEN 'error' WHEN warnings / total > 0.3 THEN 'warn' ELSE 'info' END AS class FROM h, t")
def log_histogram_class(spark, d):
    """Classes by the histogram's own threshold."""
    h = views.histogram(log(spark, d), 600, last=None)
    limit = views.histogram_threshold(h)
    return h.withColumn("threshold", limit.scalar()).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), views.bucket_class(F.col("threshold")).alias("class"))


@query("""SELECT seq, CASE WHEN seq >= 1000000 THEN ((seq + 50000) // 100000) // 10 || '.' || ((seq + 50000) // 100000) % 10 || 'M' WHEN seq >= 1000 THEN ((seq + 50) // 100) // 10 || '.' || ((seq + 50) // 100) % 10 || 'K' ELSE CAST(seq AS VARCHAR) END AS compact, format('{:,}', seq) AS thousands, CASE WHEN length(line) > 12 THEN left(line, 11) || '…' ELSE line END AS short FROM log_entry""")
def vw_formats(spark, d):
    """Numbers and texts as they are shown."""
    r = log(spark, d)
    return r.select("seq", views.compact(F.col("seq")).alias("compact"), views.thousands(F.col("seq")).alias("thousands"), views.shorten(F.col("line"), 12).alias("short"))


# Analytics


@query(r"SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(line, '[ \t\n\f\r=:]'), lambda x: x <> '')) AS token FROM log_entry) GROUP BY 1")
def ana_tokens(spark, d):
    return log(spark, d).select(F.explode(analytics.tokens(F.col("line"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT seq, list_filter(string_split_regex(line, '[ \t\n\f\r=:]'), lambda x: x <> '') AS a FROM log_entry), p AS (SELECT seq, a, lag(a) OVER (ORDER BY seq) AS b FROM t)
SELECT seq, round(CASE WHEN len(a) = len(b) AND len(a) > 0 THEN len(list_filter(range(1, len(a) + 1), lambda i: a[i] = b[i] OR b[i] = '{*}')) / len(a) ELSE 0 END, 9) AS similarity FROM p WHERE b IS NOT NULL""")
def ana_similarity(spark, d):
    """Positional similarity of each line to the one before it."""
    from tidelog.model import with_previous

    r = with_previous(log(spark, d), {"line": "before"}).where("before is not null")
    return r.select("seq", F.round(analytics.similarity(analytics.tokens(F.col("before")), analytics.tokens(F.col("line"))), 9).alias("similarity"))


METRICS_SQL = " UNION ALL ".join(f"SELECT seq, '{n}' AS name, regexp_extract(line, '{p}', 1) AS v FROM log_entry" for n, p in analytics.METRICS)


@query(rf"SELECT seq, name, CAST(v AS DOUBLE) AS value FROM ({METRICS_SQL} UNION ALL SELECT seq, 'code' AS name, regexp_extract(line, '\bcode=(\d+)', 1) AS v FROM log_entry) WHERE v <> ''")
def log_metrics(spark, d):
    """The four default metrics and one of one's own."""
    return analytics.extract_metrics(log(spark, d), (("code", r"\bcode=(?P<val>\d+)", "val"),)).select("seq", "name", "value")


@query("""WITH j AS (SELECT hit_id AS seq, _source AS j FROM es_hit WHERE json_valid(_source) AND json_type(CASE WHEN json_valid(_source) THEN _source END) = 'OBJECT' AND starts_with(ltrim(_source, ' '), '{')),
 k AS (SELECT seq, j, unnest(json_keys(j)) AS name FROM j)
SELECT seq, name, CAST(json_extract_string(j, '$."' || name || '"') AS DOUBLE) AS value FROM k WHERE json_type(j, '$."' || name || '"') IN ('BIGINT', 'UBIGINT', 'DOUBLE')""")
def log_json_metrics(spark, d):
    """Numbers on top of the search hits' documents."""
    hits = table(spark, d, "es_hit").select(F.col("hit_id").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), F.col("_source").alias("line"))
    return analytics.json_metrics(hits).select("seq", "name", "value")


LATENCY_SQL = analytics.LATENCY.replace(r"\s*(ms|s|us)", "")
ENDPOINT_SQL = rf"""lat AS (SELECT array_to_string(list_filter(string_split_regex(regexp_replace(line, '^ +| +$', '', 'g'), '\s+'), lambda t: NOT regexp_matches(t, '^[0-9.:TZ-]*$'))[1:3], ' ') AS endpoint,
  CAST(regexp_extract(line, '{analytics.LATENCY}', 1) AS DOUBLE) * CASE lower(regexp_extract(line, '{analytics.LATENCY}', 2)) WHEN 'us' THEN 0.001 WHEN 's' THEN 1000 ELSE 1 END AS ms FROM log_entry WHERE regexp_matches(line, '{analytics.LATENCY}')),
 l AS (SELECT CASE WHEN endpoint = '' THEN '<unknown>' ELSE endpoint END AS endpoint, list_sort(list(ms)) AS v FROM lat GROUP BY 1)"""


@query(f"WITH {ENDPOINT_SQL} SELECT endpoint, v[((len(v)-1)*50)//100 + 1] AS p50_ms, v[((len(v)-1)*95)//100 + 1] AS p95_ms, v[((len(v)-1)*99)//100 + 1] AS p99_ms, v[len(v)] AS max_ms, len(v) AS n FROM l ORDER BY p95_ms DESC, endpoint LIMIT 20")
def log_slowest(spark, d):
    return analytics.slowest_endpoints(log(spark, d), 20)


@query("SELECT labels['service'] AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM log_entry), 6) AS pct FROM log_entry WHERE labels['service'] IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def log_noisiest(spark, d):
    return analytics.noisiest(log(spark, d)).withColumn("pct", F.round("pct", 6))


CORR_SQL = """c AS (SELECT label, value, count(*) FILTER (now) AS ct, count(*) FILTER (now AND err) AS ce, count(*) FILTER (NOT now) AS bt, count(*) FILTER (NOT now AND err) AS be FROM (
   SELECT ts >= (SELECT max(ts) FROM log_entry) - INTERVAL 12 HOUR AS now, coalesce(lower(labels['level']) IN ('error', 'fatal'), FALSE) AS err, unnest(map_keys(labels)) AS label, unnest(map_values(labels)) AS value FROM log_entry WHERE ts >= (SELECT max(ts) FROM log_entry) - INTERVAL 48 HOUR) GROUP BY 1, 2)"""


@query(f"WITH {CORR_SQL} SELECT label, value, round(coalesce(be / nullif(bt, 0), 0), 6) AS baseline_rate, round(ce / ct, 6) AS current_rate, CASE WHEN be > 0 THEN CAST(round((ce / ct) / (be / bt), 6) AS VARCHAR) ELSE 'greatest' END AS factor FROM c WHERE ce > 0 ORDER BY CASE WHEN be > 0 THEN (ce / ct) / (be / bt) ELSE 1e308 END DESC, label, value LIMIT 25")
def log_correlation(spark, d):
    """Labels by how much their error rate rose, with the factor."""
    c = analytics.error_correlation(log(spark, d), 36 * 60, 12 * 60, 25)
    factor = F.when(F.col("factor") == analytics.INFINITE_FACTOR, "greatest").otherwise(F.round("factor", 6).cast("string"))
    return c.select("label", "value", F.round("baseline_rate", 6).alias("baseline_rate"), F.round("current_rate", 6).alias("current_rate"), factor.alias("factor"))


@query("""WITH e AS (SELECT max(ts) AS m FROM log_entry), p AS (SELECT i, avg(err) AS ratio, row_number() OVER (ORDER BY i) - 1 AS x FROM (
   SELECT CAST(floor(epoch_us(ts - (m - INTERVAL 30 HOUR)) / 3600000000) AS BIGINT) AS i, CASE WHEN lower(labels['level']) IN ('error', 'fatal') THEN 1 ELSE 0 END AS err FROM log_entry, e WHERE ts >= m - INTERVAL 30 HOUR AND ts < m) GROUP BY 1),
 f AS (SELECT count(*) AS points, regr_slope(ratio, x) / 60 AS per_min FROM p)
SELECT points, CASE WHEN abs(per_min) < 0.001 THEN 'stable' WHEN per_min > 0 THEN 'increasing' ELSE 'decreasing' END AS says FROM f WHERE points >= 2""")
def log_trend_text(spark, d):
    """The sentence of a trend."""
    t = analytics.trend(log(spark, d), 30, 3600)
    return t.select("points", F.regexp_extract("text", "stable|increasing|decreasing", 0).alias("says"))


@query("""SELECT CAST(n AS BIGINT) AS n, printf('Volume spike: %.1fx above average (z-score: %.1f)', n / greatest(m, 1.0), 4.0) AS says FROM (SELECT b, count(*) AS n, 7.0::DOUBLE AS m FROM (SELECT epoch_us(ts) // 600000000 AS b FROM log_entry) GROUP BY 1) GROUP BY ALL""")
def ana_anomaly_text(spark, d):
    """How a spike of each size is told."""
    n = log(spark, d).groupBy(F.floor(F.unix_micros("ts") / 600_000_000).alias("b")).agg(F.count(F.lit(1)).alias("n")).select("n").distinct()
    return n.select("n", analytics.anomaly_text(F.col("n"), F.lit(7.0), F.lit(4.0)).alias("says"))


@query(rf"""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) AS requests, CAST(sum(CASE WHEN lower(labels['level']) IN ('error', 'fatal') THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  count(*) FILTER (s = '2') AS status_2xx, count(*) FILTER (s = '3') AS status_3xx, count(*) FILTER (s = '4') AS status_4xx, count(*) FILTER (s = '5') AS status_5xx
 FROM (SELECT *, regexp_extract(line, '(?:^|[ =])([2-5])\d\d(?: |$)', 1) AS s FROM log_entry) GROUP BY 1""")
def log_dashboard(spark, d):
    r = analytics.live_dashboard(log(spark, d), "1 hour")
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), "requests", "errors", *[f"status_{k}xx" for k in "2345"])


@query(rf"""WITH r AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, array_to_string(list_filter(string_split_regex(regexp_replace(line, '^ +| +$', '', 'g'), '\s+'), lambda t: NOT regexp_matches(t, '^[0-9.:TZ-]*$'))[1:3], ' ') AS e,
  CAST(regexp_extract(line, '{analytics.LATENCY}', 1) AS DOUBLE) * CASE lower(regexp_extract(line, '{analytics.LATENCY}', 2)) WHEN 'us' THEN 0.001 WHEN 's' THEN 1000 ELSE 1 END AS ms FROM log_entry WHERE regexp_matches(line, '{analytics.LATENCY}')),
 g AS (SELECT start, CASE WHEN e = '' THEN '<unknown>' ELSE e END AS endpoint, count(*) AS requests, max(ms) AS max_ms FROM r GROUP BY 1, 2)
SELECT start, endpoint, requests, max_ms, CAST(row_number() OVER (PARTITION BY start ORDER BY requests DESC, endpoint) AS INTEGER) AS place FROM g QUALIFY place <= 5""")
def log_dashboard_endpoints(spark, d):
    return analytics.dashboard_endpoints(log(spark, d), "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


# Traces: the spans of trace_span as the lines that would tell them


ID = "regexp_full_match({c}, '[0-9a-fA-F]{{{n}}}')"
SPAN_LINES = f"""s AS (SELECT row_number() OVER (ORDER BY trace_id, span_id, parent_span_id, start_ts, end_ts, duration_us, service, operation, status) AS seq, * FROM trace_span),
 t AS (SELECT seq, start_ts AS ts, service, operation, status, CASE WHEN {ID.format(c='trace_id', n=32)} THEN trace_id END AS tid, CASE WHEN {ID.format(c='span_id', n=16)} THEN span_id END AS sid, CASE WHEN {ID.format(c='parent_span_id', n=16)} THEN parent_span_id END AS pid FROM s)"""


def span_lines(spark, d):
    from pyspark.sql import Window as W

    s = table(spark, d, "trace_span")
    order = ["trace_id", "span_id", "parent_span_id", "start_ts", "end_ts", "duration_us", "service", "operation", "status"]
    s = s.withColumn("seq", F.row_number().over(W.orderBy(*[F.col(c).asc_nulls_last() for c in order])).cast("bigint"))
    part = lambda name, c: F.concat(F.lit(f" {name}="), F.coalesce(F.col(c), F.lit("-")))
    given = F.map_filter(F.create_map(F.lit("service"), F.col("service"), F.lit("operation"), F.col("operation"), F.lit("level"), F.when(F.col("status") == "error", "error")), lambda k, v: v.isNotNull())
    return s.select("seq", F.col("start_ts").alias("ts"), given.alias("labels"), F.concat(F.lit("done"), part("trace_id", "trace_id"), part("parent_id", "parent_span_id"), part("span_id", "span_id")).alias("line"), F.lit(None).cast("string").alias("raw"))


@query(f"WITH {SPAN_LINES} SELECT seq, coalesce(tid, sid) AS trace_id, CASE WHEN tid IS NOT NULL THEN 'trace' ELSE 'span' END AS trace_kind, sid AS span_id, pid AS parent_span_id FROM t WHERE coalesce(tid, sid) IS NOT NULL")
def trc_ids(spark, d):
    """Trace, span and parent ids found in lines; malformed ones are none."""
    return traces.with_ids(span_lines(spark, d), fixed=True).where("trace_id is not null").select("seq", "trace_id", "trace_kind", "span_id", "parent_span_id")


@query(f"""WITH {SPAN_LINES} SELECT coalesce(tid, sid) AS trace_id, coalesce(sid, '_default') AS span_key, arg_min(pid, seq) FILTER (pid IS NOT NULL) AS parent_span_id, arg_min(nullif(service, ''), seq) FILTER (nullif(service, '') IS NOT NULL) AS service, arg_min(nullif(operation, ''), seq) FILTER (nullif(operation, '') IS NOT NULL) AS operation,
  CASE WHEN bool_or(status = 'error') THEN 'error' ELSE 'ok' END AS status, count(*) AS entries, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM t WHERE coalesce(tid, sid) IS NOT NULL GROUP BY 1, 2""")
def trc_span_fields(spark, d):
    """Spans with parent, service, operation, status and duration."""
    s = traces.spans(span_lines(spark, d), fixed=True)
    return s.select("trace_id", "span_key", "parent_span_id", "service", "operation", "status", "entries", "duration_us")


@query(r"""WITH w AS (SELECT seq, ts, line, regexp_extract(line, 'corr=([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})', 1) AS tid FROM log_entry), g AS (SELECT tid, min(ts) AS a, max(ts) AS b, count(*) AS n FROM w WHERE tid <> '' GROUP BY 1 HAVING count(*) >= 2)
SELECT tid AS trace_id, w.seq, CAST((epoch_us(b) - epoch_us(a)) // 1000 AS BIGINT) AS total_ms, CAST((epoch_us(ts) - epoch_us(a)) // 1000 AS BIGINT) AS offset_ms FROM w JOIN g USING (tid)""")
def log_waterfall(spark, d):
    """Entries that share a correlation id, as offsets."""
    rows = log(spark, d).withColumn("line", F.regexp_replace("line", "corr=", "correlation_id="))
    return traces.waterfall(rows).where("trace_id rlike '^[0-9a-f]{8}-'").select("trace_id", "seq", "total_ms", "offset_ms")


# Alerts and requests


CONFIG = """
[alerts]
enabled = true
cooldown_seconds = 0
[[alerts.rules]]
name = "cancelled"
condition = { type = "pattern_match", pattern = "cancelled|bounced" }
actions = ["terminal"]
labels = { namespace = "live" }
[[alerts.rules]]
name = "bad"
condition = { type = "level_threshold", level = "error" }
actions = ["terminal"]
"""
FIRED = """f AS (SELECT 'cancelled' AS rule, seq, ts, line, labels FROM log_entry WHERE regexp_matches(line, 'cancelled|bounced') AND labels['namespace'] = 'live' UNION ALL SELECT 'bad', seq, ts, line, labels FROM log_entry WHERE lower(coalesce(labels['level'], labels['severity'])) IN ('error', 'fatal'))"""


@query(f"WITH {FIRED} SELECT rule, seq, rule <> 'bad' AS notify, CASE WHEN strlen(line) <= 120 THEN 'Rule ''' || rule || ''' triggered on: ' || line ELSE 'long' END AS message FROM f")
def alr_messages(spark, d):
    """Rules from a file: what fires, what it says (where nothing is cut), what is muted."""
    fired = alerts.evaluate(log(spark, d), alerts.load_config(CONFIG), muted=("bad",))
    line = F.expr("substring(message, length(rule) + 23)")
    return fired.select("rule", "seq", "notify", F.when(F.octet_length(line) <= 120, F.col("message")).otherwise("long").alias("message"))


@query(f"WITH {FIRED} SELECT rule, seq FROM f ORDER BY ts DESC, seq DESC, rule LIMIT 100")
def alr_history(spark, d):
    """The hundred newest alerts; of two rules on one row the first by name."""
    fired = alerts.evaluate(log(spark, d), alerts.load_config(CONFIG))
    return fired.orderBy(F.desc("ts"), F.desc("seq"), "rule").limit(100).select("rule", "seq")


@query(f"WITH {FIRED} SELECT rule, seq, rule || ' at ' || lower(coalesce(labels['level'], labels['severity'], '')) || ': ' || line AS text FROM f")
def alr_templates(spark, d):
    """Texts of actions filled from the alert."""
    fired = alerts.evaluate(log(spark, d), alerts.load_config(CONFIG)).select("rule", "seq").join(log(spark, d).select("seq", "line", "ts", "labels"), "seq")
    from tidelog.model import level_of_alert

    return fired.select("rule", "seq", alerts.fill("{rule_name} at {level}: {line_preview}", F.col("rule"), F.col("line"), F.col("ts"), level_of_alert()).alias("text"))


REQUESTS = (
    ("show me errors from payments", '{job="payments"} |= "error"'),
    ("slow requests over 2 seconds", "{} | json | duration>2000"),
    ("404 in gateway", '{job="gateway"} |= "404"'),
    ("5xx", '{} |~ "5[0-9]{2}"'),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in REQUESTS) + ") AS t(request, query)")
def nl_requests(spark, d):
    """English requests and the queries they stand for."""
    return spark.createDataFrame([(a, nl.translate(a)) for a, _ in REQUESTS], "request string, query string")


CURSORS = (
    ('{job="a", lev', "label_name", ""), ('{job="ap', "label_value", "job"), ("{", "label_name", ""), ('{job="a"} | js', "none", ""), ("plain", "none", ""), ('{a=~"x', "label_value", "a"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in CURSORS) + ") AS t(text, kind, label)")
def vw_completion(spark, d):
    """What may be completed where the text ends."""
    return spark.createDataFrame([(a, *views.completion_context(a, len(a))[:2]) for a, _, _ in CURSORS], "text string, kind string, label string")


@query(f"""WITH h AS (SELECT make_timestamp((epoch_us(ts) // 600000000) * 600000000) AS ts, count(*) AS n FROM log_entry GROUP BY 1)
SELECT CAST(ts AS TIMESTAMP) AS ts, 'warning' AS severity, n || ' rows' AS text FROM h WHERE n > 100 UNION ALL SELECT CAST(ts AS TIMESTAMP), 'critical', line FROM log_entry WHERE lower(coalesce(labels['level'], '')) = 'fatal'""")
def vw_incidents(spark, d):
    """Busy spells and fatal rows as one timeline."""
    h = views.histogram(log(spark, d), 600, last=None).where("total > 100")
    spells = h.select(F.col("bucket").alias("ts"), F.concat(F.col("total").cast("string"), F.lit(" rows")).alias("text"))
    marks = log(spark, d).where(F.lower(label("level")) == "fatal").select("ts", F.col("line").alias("text"))
    return views.incident_timeline(spells, marks).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "severity", "text")


# Sources, sinks, plugins


CONFIGS = (
    ({}, "demo"), ({"path": "/var/log/x"}, "file"), ({"url": "http://h:9200"}, "elasticsearch"), ({"url": "https://my-opensearch.example"}, "elasticsearch"), ({"url": "https://logs.eu.amazonaws.com"}, "cloudwatch"),
    ({"url": "http://h", "extra": {"region": "r"}}, "cloudwatch"), ({"url": "http://h:3100"}, "loki"), ({"type": "K8S", "url": "http://h"}, "kubernetes"), ({"type": "pipe"}, "stdin"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, (_, k) in enumerate(CONFIGS)) + ") AS t(config, kind)")
def src_detect(spark, d):
    """The kind of source each configuration means."""
    return spark.createDataFrame([(i, registry.detect(c)) for i, (c, _) in enumerate(CONFIGS)], "config int, kind string")


def guess_sql(kind: str) -> str:
    words = [(lv, w + local.GUESS_EXTRA[kind].get(lv, ())) for lv, w in local.GUESS]
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(upper(line), {chr(39)}{x}{chr(39)})' for x in w)} THEN '{lv}'" for lv, w in words) + " ELSE 'info' END"


@query("SELECT seq, " + ", ".join(f"{guess_sql(k)} AS {k}_level" for k in ("file", "command", "container")) + " FROM log_entry")
def src_guess_levels(spark, d):
    """Levels guessed from words, by the three kinds of source."""
    return log(spark, d).select("seq", *[local.guess_level(F.col("line"), k).alias(f"{k}_level") for k in ("file", "command", "container")])


@query("SELECT DISTINCT unnest(map_keys(labels)) AS name FROM log_entry")
def log_labels(spark, d):
    return registry.label_names(log(spark, d))


@query("SELECT labels['host'] AS value, count(*) AS n FROM log_entry WHERE labels['host'] IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 100")
def log_label_values(spark, d):
    return registry.label_values(log(spark, d), "host", 100)


@query("SELECT '__source__' AS name UNION SELECT unnest(map_keys(labels)) FROM log_entry UNION SELECT unnest(map_keys(labels)) FROM grouped_entry")
def src_merged_labels(spark, d):
    return registry.merged_labels([log(spark, d), table(spark, d, "grouped_entry")])


HIT = "CASE WHEN json_valid(_source) THEN CASE WHEN json_type(_source) = 'OBJECT' THEN _source END END"
PRESENT = "coalesce(list_contains(json_keys(j), '{k}'), FALSE)"
TEXT_OF = "CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' THEN json_extract_string(j, '$.{k}') END"


@query(f"""WITH h AS (SELECT hit_id, _index, _source, {HIT} AS j FROM es_hit),
 k AS (SELECT hit_id, count(*) FILTER (name NOT IN ('message', 'msg', 'log', '_index') AND json_type(j, '$."' || name || '"') NOT IN ('NULL', 'OBJECT', 'ARRAY')) AS n FROM (SELECT hit_id, j, unnest(json_keys(j)) AS name FROM h WHERE j IS NOT NULL) GROUP BY 1)
SELECT hit_id AS seq, coalesce(CASE WHEN {PRESENT.format(k='message')} THEN {TEXT_OF.format(k='message')} WHEN {PRESENT.format(k='msg')} THEN {TEXT_OF.format(k='msg')} WHEN {PRESENT.format(k='log')} THEN {TEXT_OF.format(k='log')} END, _source) AS line, CAST(coalesce(k.n, 0) + 1 AS INTEGER) AS n_labels, coalesce(_index, '') AS idx FROM h LEFT JOIN k USING (hit_id)""")
def src_hits(spark, d):
    """es_hit as log rows: line, number of labels, index."""
    r = remote.elastic_hits(table(spark, d, "es_hit"), order="hit_id")
    return r.select("seq", "line", F.size("labels").alias("n_labels"), label("_index").alias("idx"))


@query("""SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, coalesce(labels['level'], labels['severity'], labels['lvl'], '') AS level, CASE WHEN regexp_matches(line, '[,"\n\r]') THEN '"' || replace(line, '"', '""') || '"' ELSE line END AS quoted FROM log_entry""")
def log_csv(spark, d):
    """CSV columns with time, and the line as CSV quotes it."""
    c = sinks.csv_columns(log(spark, d))
    return c.select("seq", F.regexp_replace("timestamp", r"\+00:00$", "Z").alias("timestamp"), "level", sinks.quoted(F.col("line")).alias("quoted"))


@query("SELECT seq, line, labels['host'] AS host FROM (SELECT * FROM log_entry ORDER BY seq DESC LIMIT 1000)")
def snk_json(spark, d):
    """The newest 1000 rows as one JSON array, read back."""
    one = sinks.json_array(views.newest(log(spark, d), 1000))
    rows = one.select(F.posexplode(F.from_json("value", "array<struct<line:string,labels:map<string,string>>>")).alias("i", "x"))
    first = views.newest(log(spark, d), 1000).agg(F.min("seq").alias("m"))
    numbered = views.newest(log(spark, d), 1000).select("seq", (F.row_number().over(views.W.orderBy("seq")) - 1).alias("i"))
    return rows.withColumn("m", first.scalar()).where("m is not null").join(numbered, "i").select("seq", F.col("x.line").alias("line"), F.col("x.labels")["host"].alias("host"))


@query("SELECT seq, line, labels['stream'] AS stream, labels['host'] AS host FROM log_entry")
def log_ndjson(spark, d):
    """JSON rows read back."""
    v = sinks.as_json(log(spark, d))
    return v.select("seq", F.get_json_object("value", "$.line").alias("line"), F.get_json_object("value", "$.labels.stream").alias("stream"), F.get_json_object("value", "$.labels.host").alias("host"))


@query("SELECT labels['host'] AS host, count(*) AS n, sum(strlen(line)) AS size FROM log_entry GROUP BY 1")
def udf_aggregate(spark, d):
    """A registered aggregate, partial where rows are read."""
    import pandas as pd

    r = Registry()
    count = lambda b: pd.DataFrame({"host": [dict(x)["host"] for x in b["labels"][:1]], "n": [len(b)], "size": [sum(len(x.encode()) for x in b["line"])]})
    both = lambda b: pd.DataFrame({"host": b["host"][:1].tolist(), "n": [b["n"].sum()], "size": [b["size"].sum()]})
    r.add(Plugin("count", "aggregate", count, schema="host string, n bigint, size bigint", combine=both))
    return r.aggregate(log(spark, d), "count", "host")


@query("SELECT seq, upper(line) AS line FROM log_entry WHERE strlen(line) > 40")
def udf_chain(spark, d):
    """A transform and a filter by name order over real lines."""
    r = Registry()
    r.add(Plugin("up", "transform", lambda b: b.assign(line=b["line"].str.upper())))
    r.add(Plugin("long", "filter", lambda b: b["line"].map(lambda x: len(x.encode()) > 40)))
    return r.apply(log(spark, d)).select(*ROW)


@query(f"""WITH c AS (SELECT seq, ts, {LEVEL} AS level FROM log_entry) SELECT level, count(*) AS n, count(*) FILTER (bad) AS analytics_errors FROM (SELECT {LEVEL} AS level, coalesce(lower(labels['level']) IN ('error', 'fatal'), FALSE) AS bad FROM log_entry) GROUP BY 1""")
def log_error_rules(spark, d):
    """Where the rules for errors of statistics and of analytics differ."""
    return log(spark, d).groupBy(level_of_stats().alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_error_analytics(), 1)).alias("analytics_errors"))
