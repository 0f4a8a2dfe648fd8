"""Live stores against a local stub server that pages, throttles and fails."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tidelog.model import AuthFailed, QueryFailed, RateLimited, SourceError
from tidelog.sources import local, registry, stores

LOKI = [(1_700_000_000_000_000_000 + (i // 3) * 1000, {"app": f"a{i % 2}"}, f"line {i}") for i in range(20)]
HITS = [{"_index": "i", "_id": f"{i:03d}", "_source": {"@timestamp": f"2024-01-01T00:00:{i:02d}Z", "message": f"m{i}", "n": i, "o": {"x": 1}}, "sort": [1_704_067_200_000 + i * 1000, f"{i:03d}"]} for i in range(12)]
EVENTS = [{"logStreamName": "s", "timestamp": 1_700_000_000_000 + i * 400, "message": f"e{i}", "eventId": str(i), "ingestionTime": 5} for i in range(11)] + [{"message": "no id", "timestamp": 1_700_000_000_000}]


class Stub(BaseHTTPRequestHandler):
    throttle = 0
    asked: list[str] = []

    def log_message(self, *a):
        pass

    def answer(self, body, code=200):
        data = (body if isinstance(body, str) else json.dumps(body)).encode()
        self.send_response(code)
        self.send_header("content-length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def busy(self):
        if Stub.throttle:
            Stub.throttle -= 1
            self.answer("slow down", 429)
            return True
        return False

    def do_GET(self):
        u = urllib.parse.urlparse(self.path)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(u.query).items()}
        Stub.asked.append(self.path)
        if self.busy():
            return
        if u.path.endswith("/query_range"):
            rows = [r for r in LOKI if int(q["start"]) <= r[0] < int(q["end"])]
            rows = sorted(rows, key=lambda r: r[0], reverse=q["direction"] == "backward")[: int(q["limit"])]
            self.answer({"status": "success", "data": {"resultType": "streams", "result": [{"stream": s, "values": [[str(n), x]]} for n, s, x in rows]}})
        elif u.path.endswith("/labels"):
            self.answer({"data": ["b", "app"]})
        elif u.path.endswith("/label/app/values"):
            self.answer({"data": ["a1", "a0"]})
        elif u.path == "/ready":
            self.answer("ready")
        elif u.path.endswith("/_field_caps"):
            self.answer({"fields": {"message": {}, "_id": {}, "n": {}}})
        elif u.path == "/_cluster/health":
            self.answer({"status": "yellow"})
        else:
            self.answer("", 401 if "secret" in u.path else 500)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        if self.busy():
            return
        if self.path.endswith("/_search"):
            if "aggs" in body:
                self.answer({"aggregations": {"values": {"buckets": [{"key": 3, "doc_count": 2}, {"key": "x", "doc_count": 1}]}}})
                return
            r = body["query"]["bool"]["must"][1]["range"]["@timestamp"]
            got = [h for h in HITS if r["gte"] <= h["sort"][0] <= r["lte"] and h["sort"] > body.get("search_after", [])]
            self.answer({"hits": {"hits": got[: body["size"]]}})
            return
        assert self.headers["authorization"].startswith("AWS4-HMAC-SHA256")
        action = self.headers["x-amz-target"].split(".")[1]
        if action == "FilterLogEvents":
            mine = [e for e in EVENTS if body["startTime"] <= e["timestamp"] <= body["endTime"]]
            at = int(body.get("nextToken", 0))
            end = at + min(body["limit"], 4)
            self.answer({"events": mine[at:end]} | ({"nextToken": str(end)} if end < len(mine) else {}))
        elif action == "DescribeLogGroups":
            self.answer({"logGroups": [{"logGroupName": "g"}, {}]})
        else:
            self.answer({"logStreams": [{"logStreamName": "s"}]})


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def drain(df, spark, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_loki_pages_until_a_slice_is_empty(spark, url):
    for page, n in ((4, 1), (7, 3), (5000, 2)):
        df = registry.open_source(spark, {"type": "loki", "url": url, "start_ns": LOKI[0][0], "end_ns": LOKI[-1][0] + 1, "page": page, "slices": n})
        rows = df.orderBy("seq").collect()
        assert sorted(r.line for r in rows) == sorted(x for *_, x in LOKI) and len({r.seq for r in rows}) == 20, page
        assert [r.ts for r in rows] == sorted((r.ts for r in rows), reverse=True)
    with pytest.raises(QueryFailed):
        list(stores.Loki({"url": url, "page": 3}).rows(LOKI[0][0], LOKI[-1][0] + 1))


def test_loki_tail_and_labels(spark, url, tmp_path):
    rows = drain(registry.tail(spark, {"type": "loki", "url": url, "start_ns": LOKI[0][0], "page": 5}), spark, "loki_tail", tmp_path)
    assert [r.line for r in sorted(rows, key=lambda r: r.seq)] == [x for *_, x in LOKI]
    c = {"type": "loki", "url": url}
    assert [r.name for r in registry.store_labels(spark, c).collect()] == ["app", "b"]
    assert [r.value for r in registry.store_values(spark, c, "app").collect()] == ["a0", "a1"] and registry.check(c)
    assert not registry.check({"type": "loki", "url": "http://127.0.0.1:1"})


def test_elastic_batch_tail_and_fields(spark, url, tmp_path):
    c = {"type": "elasticsearch", "url": url, "start_ms": HITS[0]["sort"][0], "end_ms": HITS[-1]["sort"][0] + 1, "page": 5, "slices": 2}
    rows = registry.open_source(spark, c).orderBy("ts").collect()
    assert [r.line for r in rows] == [f"m{i}" for i in range(12)] and rows[3].labels["n"] == "3" and "o" not in rows[3].labels
    tail = drain(registry.tail(spark, c), spark, "es_tail", tmp_path)
    assert sorted(r.seq for r in tail) == list(range(12)) and {r.line for r in tail} == {r.line for r in rows}
    assert [r.name for r in registry.store_labels(spark, c).collect()] == ["message", "n"]
    assert [r.value for r in registry.store_values(spark, c, "n").collect()] == ["3", "x"] and registry.check(c)


def test_cloudwatch_pages_limit_tail_and_values(spark, url, tmp_path):
    c = {"type": "cloudwatch", "url": url, "log_group": "g", "region": "r", "access": "a", "secret": "s", "start_ms": 1_700_000_000_000, "end_ms": 1_700_000_100_000}
    assert registry.open_source(spark, c).count() == 12
    few = registry.open_source(spark, c | {"limit": 6}).orderBy("ts", "line").collect()
    assert {r.line for r in few} == {f"e{i}" for i in range(6)} and few[0].labels == {"log_group": "g", "log_stream": "s"}
    tail = drain(registry.tail(spark, c), spark, "cw_tail", tmp_path)
    assert sorted(r.line for r in tail) == sorted(f"e{i}" for i in range(11)), "events without an id are left out, none comes twice"
    assert [r.name for r in registry.store_labels(spark, c).collect()] == ["log_group", "log_stream", "level"]
    for name, want in (("log_group", ["g"]), ("log_stream", ["s"]), ("level", [])):
        assert [r.value for r in registry.store_values(spark, c, name).collect()] == want
    with pytest.raises(QueryFailed):
        stores.CloudWatch({"url": url}).group()


def test_file_tail_and_merged_tails(spark, tmp_path):
    f = tmp_path / "a.log"
    f.write_text("old\n")
    t = stores.FileTail({"path": str(tmp_path / "*.log")})
    at = t.begin()
    with f.open("a") as out:
        out.write("ERROR new\n\nhalf")
    rows, at = t.follow(at)
    assert rows == [(str(f), "ERROR new")] and t.follow(at)[0] == []
    with f.open("a") as out:
        out.write(" done\r\n")
    assert t.follow(at)[0] == [(str(f), "half done")]
    whole = registry.tail(spark, {"type": "file", "path": str(f), "from_start": "true"})
    both = registry.merge_tails({"x": whole, "y": whole})
    got = drain(both, spark, "file_tail", tmp_path)
    assert sorted((r.labels["__source__"], r.labels["level"], r.line) for r in got) == sorted((s, lv, x) for s in "xy" for lv, x in (("info", "old"), ("error", "ERROR new"), ("info", "half done")))


def test_command_and_container_tails(spark, tmp_path):
    f = tmp_path / "said"
    f.write_text("one\n")
    t = stores.CommandTail({"kind": "command", "command": f"cat {f}", "allow": "true"})
    at = t.begin()
    f.write_text("one\nPANIC two\n")
    rows, at = t.follow(at)
    assert [x for _, x in rows] == ["PANIC two"] and t.follow(at)[0] == []
    stub = tmp_path / "docker"
    stub.write_text(f"#!/bin/sh\ncat {tmp_path}/log\n")
    stub.chmod(0o755)
    log = tmp_path / "log"
    log.write_text("2030-01-01T00:00:00.1Z a\n2030-01-01T00:00:00.2Z b\n")
    t = stores.CommandTail({"kind": "docker", "container": "c", "program": str(stub), "allow": "true"})
    rows, at = t.follow(t.begin())
    assert [x for _, x in rows] == ["a", "b"]
    log.write_text("2030-01-01T00:00:00.2Z b\n2030-01-01T00:00:00.2Z b\n2030-01-01T00:00:00.3Z c\n")
    assert [x for _, x in t.follow(at)[0]] == ["b", "c"]
    with pytest.raises(QueryFailed):
        stores.CommandTail({"kind": "docker"})
    got = drain(registry.tail(spark, {"type": "command", "command": f"cat {f}", "allow": True, "from_start": True}), spark, "command_tail", tmp_path)
    assert sorted((r.line, r.labels["service"], r.labels["level"]) for r in got) == [("PANIC two", "cat", "fatal"), ("one", "cat", "info")]


def test_throttling_is_waited_out_and_errors_pass(url):
    waits: list[float] = []
    Stub.throttle = 2
    loki = stores.Loki({"url": url})
    assert stores.patiently(lambda: stores.ask(f"{url}/loki/api/v1/labels"), sleep=waits.append) and waits == [11, 12]
    Stub.throttle = 5
    with pytest.raises(RateLimited):
        stores.patiently(lambda: stores.ask(f"{url}/ready"), tries=3, sleep=waits.append)
    Stub.throttle = 0
    with pytest.raises(AuthFailed):
        stores.patiently(lambda: stores.ask(f"{url}/secret"))
    assert loki.labels() == ["app", "b"]
    with pytest.raises(SourceError):
        registry.client({"type": "demo"})


def test_demo_says_all_it_has(spark):
    rows = local.demo(spark, 100).collect()
    assert len(local.DEMO_LINES) == 20 and len(local.DEMO_JSON) == 12 and len(rows) == 100
    assert all(json.loads(x) for x in local.DEMO_JSON) and {r.line for r in rows} <= {*local.DEMO_LINES, *local.DEMO_JSON}
