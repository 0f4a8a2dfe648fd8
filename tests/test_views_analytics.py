import time

import pytest
from pyspark.sql import functions as F

from tidelog.functions import structured
from tidelog.operators import analytics, traces, views


def one(df):
    return df.collect()[0]


def test_normalize(spark):
    cases = {
        "id 550e8400-e29b-41d4-a716-446655440000": "id <UUID>", "from 10.0.0.1:8080": "from <IP>", "at 2024-01-15T10:30:00Z": "at <TS>",
        "took 432ms": "took <DUR>", "code 500": "code <N>", "span abcdef0123456789": "span <HEX>",
    }
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r.line: r.n for r in df.select("line", views.normalize(F.col("line")).alias("n")).collect()} == cases


def test_multiline(log_rows):
    lv = {"level": "error"}
    rows = [("boom", lv), ("\tat a.b(C.java:1)", {}), ("\tat d", {}), ("Caused by: x", {}), ("\t... 3 more", {}), ("next", lv)]
    out = [(r.line, len(r.continuation_lines)) for r in views.multiline(log_rows(rows)).orderBy("gid").collect()]
    assert out == [("boom", 4), ("next", 0)]
    assert [len(r.continuation_lines) for r in views.multiline(log_rows([("a", lv), ("b", lv), ("c", lv)])).collect()] == [0, 0, 0]
    assert views.multiline(log_rows([])).count() == 0


def test_dedup_context_diff(log_rows):
    rows = log_rows(["a", "b", "a", "a", "b"])
    assert {(r.pattern, r.n) for r in views.dedup(rows).collect()} == {("a", 3), ("b", 2)}
    c = views.context(log_rows([f"l{i}" for i in range(20)] + ["hit"] + [f"m{i}" for i in range(9)] + ["hit"]), "hit", 3).orderBy("seq").collect()
    assert [r.seq for r in c] == [17, 18, 19, 20, 21, 22, 23, 27, 28, 29, 30] and [r.seq for r in c if r.gap_before] == [17, 27]
    left, right = log_rows([("x", {}, 0), ("y", {}, 1), ("z", {}, 1)]), log_rows([("p", {}, 1), ("q", {}, 2)])
    assert sorted(r.side for r in views.diff(left, right).collect()) == ["both", "left_only", "left_only", "right_only"]


def test_structured(log_rows):
    df = log_rows(['{"msg":"hello","level":"info","code":200,"x":null}', "[1,2,3]", 'level=error msg="connection failed" duration=42ms', "level=warn msg='disk low' host=w", "level=error", "GET /api 200 1ms"])
    got = [r.s for r in df.orderBy("seq").select(structured.structured(F.col("line")).alias("s")).collect()]
    assert got[0].kind == "json" and got[0].fields == {"msg": "hello", "level": "info", "code": "200", "x": "null"}
    assert got[1] is None and got[4] is None and got[5] is None
    assert got[2].fields == {"level": "error", "msg": "connection failed", "duration": "42ms"} and got[3].fields["msg"] == "disk low"


def test_completion_and_formats(spark):
    assert views.completion_context('{le', 3) == ("label_name", "", 1)
    assert views.completion_context('{level="er', 10) == ("label_value", "level", 8)
    assert views.completion_context("plain", 3)[0] == "none"
    df = spark.createDataFrame([(1234,), (2_500_000,), (7,)], "n bigint")
    assert [r[0] for r in df.select(views.compact(F.col("n"))).collect()] == ["1.2K", "2.5M", "7"]


def test_cluster(log_rows):
    rows = log_rows([f"GET /api/v1/users/{a} 200 {b}ms" for a, b in ((123, 45), (456, 67), (789, 23))] + ["", None, "one two", "one two"])
    got = {(r.template, r.n) for r in analytics.cluster(rows).collect()}
    assert got == {("GET {*} 200 {*}", 3), ("one two", 2)}
    users = log_rows([f"user {i} logged in from 10.0.0.{i}" for i in range(3)])
    assert one(analytics.cluster(users)).template == "user {*} logged in from {*}"


def test_volume(log_rows):
    ticks = [(f"r{i}", {}, t) for t in range(10) for i in range(100)] + [("x", {}, 10)] * 500
    r = one(analytics.volume_anomalies(log_rows(ticks), 1, 10, 2.0))
    assert r.actual == 500 and r.z == float("inf")
    assert analytics.volume_anomalies(log_rows([(f"r{i}", {}, t) for t in range(20) for i in range(10)])).count() == 0
    assert analytics.volume_anomalies(log_rows([])).count() == 0


def test_top_n(log_rows):
    lines = ["GET /api/users duration=45ms", "GET /api/users duration=120ms", "GET /api/users duration=200ms", "POST /api/orders latency: 500ms", "POST /api/orders latency: 800ms"]
    got = {r.endpoint: r for r in analytics.slowest_endpoints(log_rows(lines)).collect()}
    assert len(got) == 4 and got["POST /api/orders latency:"].p95_ms == 500 and got["POST /api/orders latency:"].max_ms == 800
    svc = [("x", {"service": s, "level": v}) for s, v in (("auth", "error"), ("auth", "info"), ("auth", "info"), ("payments", "error"), ("payments", "error"))]
    assert tuple(analytics.noisiest(log_rows(svc), n=1).collect()[0]) == ("auth", 3, 60.0)
    assert [r.value for r in analytics.noisiest(log_rows(svc), errors_only=True).collect()] == ["payments", "auth"]


def test_percentile_rule(spark):
    df = spark.createDataFrame([([float(x) for x in range(1, 11)],)], "v array<double>")
    assert [df.select(analytics.at_percentile(F.col("v"), p)).collect()[0][0] for p in (50, 95, 99)] == [5, 9, 9]


def test_trend_and_correlation(log_rows):
    rows = []
    for b in range(10):
        n, bad = (11, 1) if b < 5 else (10, 5)
        rows += [("x", {"level": "error" if i < bad else "info"}, b * 60 + i) for i in range(n)]
    rows.append(("x", {"level": "info"}, 600))
    r = one(analytics.trend(log_rows(rows), 10, 60))
    assert r.slope > 0 and r["class"] == "increasing" and "increasing" in r.text
    flat = [("x", {"level": "error" if i == 0 else "info"}, b * 60 + i) for b in range(10) for i in range(10)] + [("x", {}, 600)]
    assert abs(one(analytics.trend(log_rows(flat), 10, 60)).slope) < 0.1
    c = [("x", {"service": "a", "level": "info"}, 0), ("x", {"service": "b", "level": "info"}, 1), ("x", {"service": "a", "level": "error"}, 1900)]
    got = {(r.label, r.value): r for r in analytics.error_correlation(log_rows(c)).collect()}
    assert got[("service", "a")].factor == analytics.INFINITE_FACTOR and ("level", "error") in got


def test_metrics(log_rows):
    rows = log_rows(["request completed duration=45ms status=200", "latency: 12.5 ms", "status_code=404 x", "bytes=2048", "num_items=42"])
    got = {(r.seq, r.name): r.value for r in analytics.extract_metrics(rows).collect()}
    assert got == {(0, "duration_ms"): 45, (0, "status_code"): 200, (1, "duration_ms"): 12.5, (2, "status_code"): 404, (3, "bytes"): 2048, (4, "count"): 42}
    own = analytics.extract_metrics(log_rows(["temp=23.5"]), (("temp", r"temp[=:]\s*(?P<val>\d+\.\d+)", "val"),))
    assert one(own).value == 23.5
    js = analytics.json_metrics(log_rows(['{"duration":150,"status":200,"message":"7","ratio":0.95}', "x"]))
    assert {(r.name, r.value) for r in js.collect()} == {("duration", 150.0), ("status", 200.0), ("ratio", 0.95)}
    with pytest.raises(ValueError):
        analytics.extract_metrics(rows, (("x", "(", 1),))


def test_traces(log_rows):
    h32, h16, u = "abcdef01234567890abcdef012345678", "abcdef0123456789", "550e8400-e29b-41d4-a716-446655440000"
    cases = [(f"trace_id={h32}", h32, "trace"), (f"traceId: {u}", u, "trace"), (f"req_id={u}", u, "request"), (f"X-Request-Id: {u}", u, "request"), (f"span_id={h16}", h16, "span"), ('{"requestId":"any"}', "any", "request"), ("nothing", None, None)]
    got = [(r.trace_id, r.trace_kind) for r in traces.with_ids(log_rows([c[0] for c in cases])).orderBy("seq").collect()]
    assert got == [c[1:] for c in cases]
    rows = log_rows([(f"trace_id={h32} span_id={'a' * 16} start", {"service": "api"}, 0), (f"trace_id={h32} parent_span_id={'a' * 16} span_id={'b' * 16} Error", {"app": "db"}, 1), (f"trace_id={h32} span_id={'a' * 16} end", {}, 9)])
    assert one(traces.traces(rows)).n_spans == 1
    fixed = one(traces.traces(rows, fixed=True))
    assert (fixed.n_spans, fixed.total_us, fixed.error_count, fixed.service_count) == (2, 9_000_000, 1, 2)
    assert traces.waterfall(rows).count() == 3


def test_a_single_wrong_time_makes_no_billions(spark, log_rows):
    import pytest

    far = log_rows([("a", {}, 0), ("a", {}, 5), ("b", {}, 200_000_000)])
    with pytest.raises(Exception, match="gap of more than"):
        views.histogram(far, 1, last=None).collect()
    assert views.histogram(far, 1).count() == 60 and views.histogram(far, 3_000_000, last=None).count() > 60
    assert analytics.volume_anomalies(far, 1, 60, 3.0).count() >= 0


def test_playground_ranges_are_bytes_of_groups_that_took_part(log_rows):
    r = views.playground(log_rows(["xé k=v"]), r"(?P<k>k)=(v)|(z)").collect()[0]
    assert [tuple(x) for x in r.ranges] == [("match", "k=v", 4, 7), ("k", "k", 4, 5), ("group_2", "v", 6, 7)] and r.start == 4


def test_presets(log_rows):
    from pyspark.sql import functions as F

    rows = log_rows([("a", {}, 0), ("b", {}, 4000), ("c", {}, 7300)])
    now = F.lit("2025-03-10 02:00:00").cast("timestamp")
    assert [r.line for r in views.preset(rows, 60, now).collect()] == ["b"]


def test_bounded_patterns_and_leading_ones(log_rows):
    lines = ["a b c", "x y", "a b d", "q", "a b e", "x y", "u v w z", "q"]
    rows = log_rows(lines)
    assert {(r.template, r.n) for r in analytics.buffer_patterns(rows, 0.5).collect()} == {("a b {*}", 3), ("x y", 2), ("q", 2), ("u v w z", 1)}
    # two patterns at most: the one with fewest lines goes, the oldest of equals
    assert {(r.template, r.n) for r in analytics.buffer_patterns(rows, 0.5, most=2).collect()} == {("a b {*}", 3), ("q", 1)}
    assert {r.template for r in analytics.buffer_patterns(rows, 0.5, buffer=2).collect()} == {"u v w z", "q"}
    assert [(r.template, r.seq) for r in analytics.new_leading_patterns(rows, 0.5, learning=1).collect()] == [("a b {*}", 2)]
    assert analytics.new_leading_patterns(rows, 0.5, learning=3).count() == 0
    assert {r.template for r in analytics.new_cluster_patterns(rows, 0.5, learning=3).collect()} == {"q", "u v w z"}
    assert analytics.snapshot(rows)["new_patterns"].count() == 0


def folded(lines, threshold=0.4):
    """Patterns line by line, against every pattern."""
    groups = {}
    for i, x in enumerate(lines):
        if toks := analytics.split(x or ""):
            groups.setdefault(len(toks), analytics._Patterns(threshold)).take(toks, i, x, i)
    return sorted((" ".join(p[0]), p[1], p[2], p[3], p[4]) for g in groups.values() for p in g.found)


def test_cluster_counted_where_read(log_rows):
    # behind the head: lines that agree, others, new patterns, and an earlier pattern that gets wide enough for lines counted for a later one
    lines = ["a b c d", "p q r d", "a b c e", "p q s d", "", None, "z"] * 3 + ["p q t d", "a x y d", "p q t d", "p w v d", "y z", "z", "z z", "k=z:{*}", "k=z:1", "p q r f"] * 4 + [f"u{i % 7} v x{i} {i % 3}" for i in range(40)]
    for threshold, heads in ((0.4, ((65_536, 256), (5, 1), (21, 2), (40, 4))), (1.0, ((14, 1),)), (0.25, ((14, 1),))):
        want = folded(lines, threshold)
        for head, least in heads:
            got = analytics.cluster(log_rows(lines), threshold, head=head, least=least).collect()
            assert sorted((r.template, r.n, r.example, r.first_seq, r.last_ts.minute * 60 + r.last_ts.second) for r in got) == want


def test_cluster_steals_back(log_rows):
    # "b b x y" is counted for the second pattern until the first one gets wide
    lines = ["a b c d", "b b x y"] + ["b b x y"] * 5 + ["a b x d", "a b c y", "e b x y", "b b x y", "b b x y"]
    assert folded(lines, 0.5) == [("b b x y", 6, "b b x y", 1, 6), ("{*} b {*} {*}", 6, "b b x y", 0, 11)]
    got = analytics.cluster(log_rows(lines), 0.5, head=3, least=1).collect()
    assert sorted((r.template, r.n, r.example, r.first_seq, r.last_ts.minute * 60 + r.last_ts.second) for r in got) == folded(lines, 0.5)


def test_cluster_of_many_patterns(spark):
    """A pattern for each line: steps in proportion to the lines, not to their square."""
    rows = spark.range(40_000).select(F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), F.concat(F.lit("id-"), F.col("id") % 30_000).alias("line"))
    began = time.monotonic()
    assert analytics.cluster(rows).agg(F.count("n"), F.sum("n")).first() == (30_000, 40_000)
    assert time.monotonic() - began < 60


def test_new_clusters_number_no_rows(spark, log_rows):
    """The first row that isn't learned is looked for; rows without a line count."""
    rows = log_rows(["a", None, "", "b", "a", "c c", "b", "d d d"])
    for learning, want in ((0, {"b", "c c", "d d d"}), (3, {"b", "c c", "d d d"}), (4, {"c c", "d d d"}), (7, {"d d d"}), (8, set()), (100, set())):
        assert {r.template for r in analytics.new_cluster_patterns(rows, learning=learning).collect()} == want
    many = spark.range(40_000).select((F.col("id") * 3).alias("seq"), F.timestamp_seconds("id").alias("ts"), F.concat(F.lit("id-"), F.col("id") % 30_000).alias("line"))
    began = time.monotonic()
    new = analytics.new_cluster_patterns(many)
    assert new.agg(F.count("n"), F.sum("n"), F.min("first_seq")).first() == (29_000, 38_000, 3000)
    assert time.monotonic() - began < 60
    assert "Window" not in new._jdf.queryExecution().executedPlan().toString()


def test_top_patterns_of_many(spark):
    """Counts of patterns that come up behind the head are whole, ties go by template."""
    late = F.col("id") >= 90_000
    line = F.when(F.col("id") % 4 == 0, F.concat(F.lit("x"), F.col("id"))).when(late & (F.col("id") % 4 == 1), "late").when(late & (F.col("id") % 4 == 2), "later").otherwise(F.concat(F.lit("took "), F.col("id"), F.lit(" ms")))
    rows = spark.range(130_000).select(F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), line.alias("line"))
    began = time.monotonic()
    top = [(r.template, r.n) for r in analytics.top_patterns(analytics.cluster(rows), 5).collect()]
    assert top == [("took {*} ms", 77_500), ("late", 10_000), ("later", 10_000), ("x0", 1), ("x100", 1)]
    assert time.monotonic() - began < 90
