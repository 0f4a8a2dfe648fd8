import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidelog.model import SourceError, labels_text
from tidelog.operators import alerts
from tidelog.plugins import Plugin, Registry
from tidelog.sources import local, registry, remote, sinks


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_conditions(log_rows):
    rows = log_rows([("an ERROR", {"level": "error"}), ("info", {"level": "info"}), ("FATAL x", {"severity": "FATAL"}), ("w", {"level": "warning"})])
    assert seqs(alerts.matches(rows, alerts.Rule("p", "pattern_match", pattern="ERROR|FATAL"))) == [0, 2]
    assert seqs(alerts.matches(rows, alerts.Rule("p", "pattern_match", pattern="[bad"))) == []
    assert seqs(alerts.matches(rows, alerts.Rule("l", "level_threshold", level="warn"))) == [0, 2]
    assert seqs(alerts.matches(rows, alerts.Rule("l", "level_threshold", level="odd"))) == []
    assert seqs(alerts.matches(rows, alerts.Rule("p", "pattern_match", pattern=".", labels=(("level", "info"),)))) == [1]


def test_rate_window(log_rows):
    rows = log_rows([("x", {}, t) for t in (0, 10, 20, 30, 200, 200, 200, 261)])
    assert seqs(alerts.matches(rows, alerts.Rule("r", "rate_threshold", count=3, window_seconds=60))) == [2, 3, 6]


def test_cooldown_and_messages(log_rows):
    rows = log_rows([("FATAL " + "é" * 100, {}, t) for t in (0, 10, 299, 300, 301, 700)])
    c = alerts.Config(True, 300, [alerts.Rule("f", "pattern_match", pattern="FATAL")])
    fired = alerts.evaluate(rows, c, muted=("f",)).orderBy("seq").collect()
    assert [r.seq for r in fired] == [0, 3, 5] and fired[0].message == "Rule 'f' triggered on: FATAL " + "é" * 57 + "..." and not fired[0].notify
    assert alerts.evaluate(rows, alerts.Config(False, 300, c.rules)).count() == 0


def test_config():
    text = '[alerts]\nenabled = true\n[[alerts.rules]]\nname = "a"\nactions = ["desktop"]\ncondition = {type = "pattern_match", pattern = "x"}\n'
    assert alerts.load_config(text).rules[0].pattern == "x"
    with pytest.raises(ValueError):
        alerts.load_config('[alerts]\n[[alerts.rules]]\nname = "a"\npattern = "x"\n')
    with pytest.raises(ValueError):
        alerts.load_config(text + text.split("\n", 2)[2])


def test_stores(spark):
    loki = json.dumps({"status": "success", "data": {"resultType": "streams", "result": [{"stream": {"a": "b"}, "values": [["1700000000123456789", "old"], ["1700000001000000000", "new"]]}]}})
    rows = remote.loki_rows(spark.createDataFrame([(loki,)], "value string")).orderBy("seq").collect()
    assert [r.line for r in rows] == ["new", "old"] and rows[1].ts.microsecond == 123456
    hits = [(1, "i", '{"@timestamp":"2024-01-01T00:00:00Z","message":"m","n":1,"o":{"p":1},"b":true}'), (2, "i", '{"timestamp":"1700000000000","msg":{"x":1},"message":5}'), (3, None, "broken"), (4, "i", None)]
    out = remote.elastic_hits(spark.createDataFrame(hits, "hit_id bigint, _index string, _source string"), order="hit_id")
    got = {r.seq: (r.line, r.l) for r in out.select("seq", "line", labels_text(F.col("labels")).alias("l")).collect()}
    assert got[1] == ("m", "@timestamp=2024-01-01T00:00:00Z;_index=i;b=true;n=1") and got[2][0] == hits[1][2] and got[3] == ("broken", "_index=")
    cw = json.dumps({"events": [{"logStreamName": "s", "timestamp": 1000, "message": "a", "eventId": "1"}, {"message": "no time"}]})
    assert [r.line for r in remote.cloudwatch_rows(spark.createDataFrame([(cw,)], "value string"), "g").collect()] == ["a"]
    assert remote.signing_key("wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "20120215", "us-east-1", "iam").hex() == "f4780e2d9f65fa895f9c67b32ce1baf0b0d8a43505a000a1a9e090d414db404d"
    assert "authorization" in remote.signed_headers("a", "b", "r", "logs", "h", "t", b"{}", datetime(2024, 1, 1, tzinfo=timezone.utc))
    assert remote.search_body("{}", 1, 2, 3)["query"]["bool"]["must"][0] == {"match_all": {}}


def test_registry(spark, log_rows, tmp_path):
    assert registry.detect({}) == "demo" and registry.detect({"url": "http://x:9200"}) == "elasticsearch" and registry.detect({"path": "a"}) == "file"
    assert registry.detect({"url": "https://logs.r.amazonaws.com"}) == "cloudwatch" and registry.detect({"url": "http://x:3100"}) == "loki" and registry.detect({"type": "k8s"}) == "kubernetes"
    (tmp_path / "a.log").write_text("one\n\nERROR two\n")
    f = registry.open_source(spark, {"path": str(tmp_path / "a.log")}).orderBy("seq").collect()
    assert [(r.line, r.labels["level"], r.labels["filename"]) for r in f] == [("ERROR two", "error", "a.log"), ("one", "info", "a.log")]
    assert registry.open_source(spark, {"type": "demo", "limit": 500}).count() == 100
    with pytest.raises(SourceError):
        registry.open_source(spark, {"type": "command", "command": "ls"})
    cmd = local.read_command(spark, "echo a; echo PANIC >&2", allow=True).orderBy("seq").collect()
    assert [(r.line, r.labels["level"]) for r in cmd] == [("PANIC", "fatal"), ("a", "info")]

    def broken():
        raise SourceError("down")

    m = registry.merge({"x": log_rows(["a", "b"]), "y": broken, "z": log_rows(["c"])}, limit=2)
    assert [(r.line, r.labels["__source__"]) for r in m.collect()] == [("a", "x"), ("c", "z")]
    with pytest.raises(SourceError):
        registry.merge({"y": broken})
    assert [r.name for r in registry.merged_labels([log_rows([("a", {"k": "v"})])]).collect()] == ["__source__", "k"]


def test_sinks_and_plugins(log_rows):
    rows = log_rows([('say "hi", you', {"level": "warn", "b": "2", "a": "1"}), ("x", {})])
    got = [r.value for r in sinks.as_csv(rows).orderBy("seq").collect()]
    assert got[0] == '2025-03-10T00:00:00.000000Z,warn,a=1;b=2,"say ""hi"", you"' and got[1].endswith(",,,x")
    assert json.loads(sinks.json_array(rows).collect()[0].value)[0]["line"] == 'say "hi", you'
    r = Registry()
    r.add(Plugin("b", "filter", lambda b: b["line"].str.len() > 1))
    r.add(Plugin("a", "transform", lambda b: b.assign(line=b["line"].str.upper())))
    r.add(Plugin("c", "filter", lambda b: 1 / 0))
    assert [x.line for x in r.apply(rows).collect()] == ['SAY "HI", YOU']


def test_streams(spark, log_rows, tmp_path):
    from tidelog.model import SCHEMA
    from tidelog.operators import lateness
    from tidelog.streaming import streams

    log_rows([("x", {"level": "error"}, t) for t in (0, 0.2, 5, 100)]).write.parquet(str(tmp_path / "in"))
    src = streams.read_stream(spark, str(tmp_path / "in"), SCHEMA)
    q = streams.histogram(src, "10 seconds", "0 seconds").writeStream.format("memory").queryName("hist").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.errors for r in spark.table("hist").collect()) == [1, 3]
    f = streams.cooldown(src.selectExpr("'r' AS rule", "ts", "seq"), {"r": 50}).writeStream.format("memory").queryName("fired").outputMode("append").trigger(availableNow=True).start()
    f.awaitTermination()
    assert sorted(r.seq for r in spark.table("fired").collect()) == [0, 3]
    ev = [(i, 1, "s", 3_600_000, "m", "a" if i < 2 else str(i), 3_700_000) for i in range(4)]
    spark.createDataFrame(ev, "delivery_id bigint, batch_id bigint, log_stream_name string, event_timestamp bigint, message string, event_id string, ingestion_time bigint").write.parquet(str(tmp_path / "ev"))
    es = streams.read_stream(spark, str(tmp_path / "ev"), spark.read.parquet(str(tmp_path / "ev")).schema)
    w = streams.snapshots(streams.once_each(es), streams.late_partials(es, str(tmp_path / "parts")), str(tmp_path / "cp"), once=True)
    w.awaitTermination()
    got = lateness.combine(spark.read.parquet(str(tmp_path / "parts"))).collect()
    assert [(r.n_first, r.n_final) for r in got] == [(3, 3)]


def test_cloudwatch_query_keeps_every_event_with_a_time(spark, tmp_path):
    from tidelog.log_queries import QUERIES

    rows = [(1, "s", 1_742_164_227_910), (2, "s", 1_742_164_227_910_000), (3, None, 1_741_569_264), (4, "s", None)]
    e = spark.createDataFrame(rows, "delivery_id bigint, log_stream_name string, event_timestamp bigint").selectExpr("*", "'m' AS message", "'e' AS event_id", "0L AS ingestion_time")
    e.write.parquet(str(tmp_path / "filtered_log_event.parquet"))
    got = {(r.seq, r.ts_us) for r in QUERIES["src_cloudwatch_events"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1_742_164_227_910_000), (2, 1_742_164_227_910_000), (3, 1_741_569_264_000_000)}


def test_text_labels_that_look_like_json_stay(spark):
    from tidelog.sources import remote

    doc = '{"message": "m", "a": "[core]", "b": "{x}", "n": 5, "o": {"x": 1}, "l": [1], "t": true, "z": null}'
    hits = spark.createDataFrame([(1, "i", doc), (2, "i", "broken {")], "hit_id bigint, _index string, _source string")
    got = {r.seq: r.labels for r in remote.elastic_hits(hits, order="hit_id").collect()}
    assert got == {1: {"_index": "i", "a": "[core]", "b": "{x}", "n": "5", "t": "true"}, 2: {"_index": "i"}}


def test_plugins_of_a_folder_and_partial_aggregates(spark, log_rows, tmp_path):
    from tidelog.plugins import Registry

    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "plugin.py").write_text("def call(b):\n    return b.assign(line=b['line'].str.upper())\n")
    (tmp_path / "n.py").write_text("import pandas as pd\ndef call(b):\n    return pd.DataFrame({'n': [len(b)]})\ndef combine(b):\n    return pd.DataFrame({'n': [b['n'].sum()]})\n")
    (tmp_path / "n.toml").write_text("[plugin]\nname = 'n'\nversion = '1.2'\ntype = 'aggregate'\nschema = 'n bigint'\n")
    (tmp_path / "bad.py").write_text("def (")
    r = Registry()
    assert r.load(str(tmp_path)) == ["bad"] and r.plugins["n"].version == "1.2" and r.plugins["up"].version == "0.0.0"
    rows = log_rows([("a", {"s": "x"}), ("b", {"s": "x"}), ("c", {"s": "y"}), ("d", {})])
    assert sorted(x.n for x in r.aggregate(rows, "n", "s").collect()) == [1, 1, 2]
    assert {x.line for x in r.apply(rows).collect()} == set("ABCD")


def test_actions_are_off_by_default_and_report_what_happened(spark, log_rows, tmp_path):
    import http.server
    import threading

    got = []

    class Hook(http.server.BaseHTTPRequestHandler):
        def do_PUT(self):
            got.append((self.headers["x-key"], json.loads(self.rfile.read(int(self.headers["content-length"])))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    text = f"""[alerts]
enabled = true
cooldown_seconds = 0
[[alerts.rules]]
name = "bad"
condition = {{ type = "pattern_match", pattern = "ERROR" }}
actions = [{{ type = "webhook", url = "http://127.0.0.1:{server.server_port}/x", method = "put", headers = {{ x-key = "k" }} }}, {{ type = "email", to = ["a@b"] }}, {{ type = "other" }}]
"""
    config = alerts.load_config(text)
    rows = log_rows([("an ERROR", {"level": "error"}), ("fine", {})])
    fired = alerts.evaluate(rows, config)
    assert {r.error for r in alerts.deliver(fired, rows, config).collect()} == {"actions run only with allow=True"} and not got
    out = {r.action: r.error for r in alerts.deliver(fired, rows, config, allow=True).collect()}
    assert out["webhook"] is None and "smtp" in out["email"] and "unknown" in out["other"]
    assert got[0][0] == "k" and got[0][1]["rule_name"] == "bad" and got[0][1]["labels"] == {"level": "error"} and got[0][1]["line_preview"] == "an ERROR"
    assert alerts.deliver(alerts.evaluate(rows, config, muted=("bad",)), rows, config, allow=True).count() == 0
    alerts.action_sink(config, str(tmp_path / "log"), allow=True)(rows, 3)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    server.shutdown()


def test_cooldown_over_spells_equals_a_plain_fold(spark):
    import random

    r = random.Random(6)
    rows, at = [], {"a": 0, "b": 0, "free": 0}
    for i in range(600):
        rule = r.choice(["a", "b", "free"])
        at[rule] += r.choice([0, 1, 20, 400, 5000])
        rows.append((rule, i, at[rule]))
    df = spark.createDataFrame(rows, "rule string, seq bigint, s bigint").select("rule", "seq", F.timestamp_seconds("s").alias("ts"))
    wait = {"a": 300, "b": 4000, "free": 0}
    want, last = set(), {}
    for rule, seq, s in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        if rule not in last or s - last[rule] >= wait[rule]:
            last[rule] = s
            want.add((rule, seq))
    assert {(x.rule, x.seq) for x in alerts.cooldown(df, wait).collect()} == want
    assert alerts.cooldown(df.limit(0), wait).count() == 0
