"""Live log stores: batch readers, tails, discovery and health.

``spark.read.format("log_store")`` and ``spark.readStream.format("log_store")``
with the option ``kind`` (loki, elasticsearch, cloudwatch; tails also file, command,
docker, kubernetes). What
comes out is what the store sends; ``registry`` brings it to log rows with the
same expressions as saved answers. Requests use the standard library only.
"""

from __future__ import annotations

import glob
import json
import os
import subprocess
import time
import urllib.parse
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tidelog.model import SCHEMA, ConnectionFailed, QueryFailed, RateLimited, SourceError, TimedOut
from tidelog.sources.remote import ask, search_body, signed_headers

HIT_SCHEMA = "seq bigint, _index string, _id string, _source string"
EVENT_SCHEMA = "seq bigint, log_stream_name string, event_timestamp bigint, message string, event_id string, ingestion_time bigint"
FILE_SCHEMA = "seq bigint, path string, line string"
JSON_TYPE = {"content-type": "application/json"}
#: Waits between tries, in seconds; a throttled store gets more.
FIRST_WAIT, LONGEST_WAIT, TRIES, THROTTLED_WAIT = 1, 30, 10, 10


def patiently(call: Callable, tries: int = TRIES, sleep: Callable[[float], None] | None = None):
    """The answer of ``call``, tried again after 1, 2, 4... up to 30 seconds
    while the store can't be reached or throttles. Other errors pass at once."""
    wait = FIRST_WAIT
    for left in range(tries - 1, -1, -1):
        try:
            return call()
        except (ConnectionFailed, TimedOut, RateLimited) as e:
            if not left:
                raise
            (sleep or time.sleep)(wait + (THROTTLED_WAIT if isinstance(e, RateLimited) else 0))
            wait = min(wait * 2, LONGEST_WAIT)


def now_ms() -> int:
    return int(time.time() * 1000)


class Loki:
    """Range queries, labels and readiness of a store with streams of labels."""

    schema = SCHEMA
    unit = 1_000_000  # ns a ms

    def __init__(self, o: dict):
        self.o = o
        self.url = o["url"].rstrip("/")
        self.page = int(o.get("page", 5000))

    def get(self, path: str, **params) -> dict:
        q = urllib.parse.urlencode(params)
        return json.loads(patiently(lambda: ask(f"{self.url}/loki/api/v1/{path}?{q}")))

    def range(self, start: int, end: int, direction: str) -> list[tuple[int, dict, str]]:
        """Up to a page of rows of [start, end), in nanoseconds."""
        got = self.get("query_range", query=self.o.get("query", "{}"), start=start, end=end, limit=self.page, direction=direction)
        rows = [(int(v[0]), s["stream"], v[1]) for s in got["data"]["result"] for v in s["values"]]
        return sorted(rows, key=lambda r: r[0], reverse=direction == "backward")

    def rows(self, start: int, end: int) -> Iterator[tuple]:
        """All rows of [start, end), newest first, page by page. The oldest
        instant of a page is asked again, as rows of it may be missing."""
        edge, seen = None, Counter()
        while True:
            got = self.range(start, end, "backward")
            given = Counter()
            fresh = 0
            for ns, labels, line in got:
                key = (ns, tuple(sorted(labels.items())), line)
                given[key] += 1
                if ns == edge and given[key] <= seen[key]:
                    continue
                fresh += 1
                yield self.row(ns, labels, line)
            if len(got) < self.page:
                return
            if not fresh:
                raise QueryFailed(f"more than {self.page} rows at one instant; raise the page size")
            edge = got[-1][0]
            seen = Counter({k: n for k, n in given.items() if k[0] == edge})
            end = edge + 1

    def row(self, ns: int, labels: dict, line: str) -> tuple:
        return datetime.fromtimestamp(ns // 1_000_000_000, timezone.utc).replace(microsecond=ns // 1000 % 1_000_000), labels, line, None

    def labels(self) -> list[str]:
        return sorted(self.get("labels").get("data") or [])

    def values(self, name: str) -> list[str]:
        return sorted(self.get(f"label/{urllib.parse.quote(name)}/values").get("data") or [])

    def health(self) -> None:
        ask(f"{self.url}/ready")

    def begin(self) -> dict:
        return {"ns": int(self.o.get("start_ns", now_ms() * self.unit)), "seen": [], "n": 0}

    def follow(self, at: dict) -> tuple[list[tuple], dict]:
        """The next page of rows from the cursor on; rows of its own instant
        that were given are known by their texts."""
        got = self.range(at["ns"], now_ms() * self.unit + self.unit, "forward")
        left = Counter(at["seen"])
        out = []
        last, seen = at["ns"], list(at["seen"])
        for ns, labels, line in got:
            key = json.dumps([labels, line], sort_keys=True)
            if ns == at["ns"] and left[key]:
                left[key] -= 1
                continue
            if ns != last:
                last, seen = ns, []
            seen.append(key)
            out.append(self.row(ns, labels, line))
        if not out and len(got) >= self.page:
            raise QueryFailed(f"more than {self.page} rows at one instant; raise the page size")
        return out, {"ns": last, "seen": seen, "n": at["n"] + len(out)}


class Elastic:
    """Searches, fields and health of a store of JSON documents."""

    schema = HIT_SCHEMA
    unit = 1

    def __init__(self, o: dict):
        self.o = o
        self.url = o["url"].rstrip("/")
        self.index = o.get("index", "_all")
        self.page = int(o.get("page", 500))

    def post(self, path: str, body: dict) -> dict:
        return json.loads(patiently(lambda: ask(f"{self.url}/{self.index}/{path}", json.dumps(body).encode(), JSON_TYPE)))

    def hits(self, start: int, end: int, after: list | None) -> list[dict]:
        return self.post("_search", search_body(self.o.get("query", ""), start, end, self.page, after, True))["hits"]["hits"]

    def row(self, h: dict) -> tuple:
        return h.get("_index"), h.get("_id"), json.dumps(h["_source"], ensure_ascii=False)

    def rows(self, start: int, end: int) -> Iterator[tuple]:
        """All hits of [start, end), page by page with a (time, id) cursor."""
        after = None
        while True:
            got = self.hits(start, end - 1, after)
            yield from map(self.row, got)
            if len(got) < self.page:
                return
            after = got[-1]["sort"]

    def labels(self) -> list[str]:
        caps = json.loads(patiently(lambda: ask(f"{self.url}/{self.index}/_field_caps?fields=*")))
        return sorted(f for f in caps["fields"] if not f.startswith("_"))

    def values(self, name: str) -> list[str]:
        got = self.post("_search", {"size": 0, "aggs": {"values": {"terms": {"field": name, "size": 100}}}})
        return [str(b.get("key_as_string", b["key"])) for b in got["aggregations"]["values"]["buckets"]]

    def health(self) -> None:
        status = json.loads(ask(f"{self.url}/_cluster/health"))["status"]
        if status not in ("green", "yellow"):
            raise QueryFailed(f"cluster is {status}")

    def begin(self) -> dict:
        return {"after": [int(self.o.get("start_ms", now_ms())), ""], "n": 0}

    def follow(self, at: dict) -> tuple[list[tuple], dict]:
        got = self.hits(0, 1 << 52, at["after"])
        return [self.row(h) for h in got], {"after": got[-1]["sort"] if got else at["after"], "n": at["n"] + len(got)}


class CloudWatch:
    """Filtered events of a log group, its streams, and signed requests."""

    schema = EVENT_SCHEMA
    unit = 1

    def __init__(self, o: dict):
        self.o = o
        self.region = o.get("region", "us-east-1")
        self.url = (o.get("url") or f"https://logs.{self.region}.amazonaws.com").rstrip("/")
        self.page = min(int(o.get("page", 10_000)), 10_000)

    def call(self, action: str, body: dict) -> dict:
        data = json.dumps(body).encode()
        host = urllib.parse.urlparse(self.url).netloc

        def send() -> str:
            headers = signed_headers(self.o.get("access", ""), self.o.get("secret", ""), self.region, "logs", host, f"Logs_20140328.{action}", data, datetime.now(timezone.utc), self.o.get("token", ""))
            return ask(f"{self.url}/", data, headers)

        return json.loads(patiently(send))

    def group(self) -> str:
        if not self.o.get("log_group"):
            raise QueryFailed("a log group is needed")
        return self.o["log_group"]

    def events(self, start: int, end: int, limit: int, token: str | None = None) -> dict:
        body = {"logGroupName": self.group(), "startTime": start, "endTime": end, "limit": limit}
        if self.o.get("query"):
            body["filterPattern"] = self.o["query"]
        return self.call("FilterLogEvents", body | ({"nextToken": token} if token else {}))

    def row(self, e: dict) -> tuple:
        return e.get("logStreamName"), e.get("timestamp"), e.get("message"), e.get("eventId"), e.get("ingestionTime")

    def rows(self, start: int, end: int) -> Iterator[tuple]:
        """All events of [start, end), page by page; with ``limit`` the earliest."""
        left = int(self.o["limit"]) if self.o.get("limit") else None
        token = None
        while left is None or left > 0:
            got = self.events(start, end - 1, self.page if left is None else min(self.page, left), token)
            mine = got.get("events") or []
            yield from map(self.row, mine if left is None else mine[:left])
            left = None if left is None else left - len(mine)
            token = got.get("nextToken")
            if not token:
                return

    def labels(self) -> list[str]:
        return ["log_group", "log_stream", "level"]

    def values(self, name: str) -> list[str]:
        if name == "log_group":
            return [g["logGroupName"] for g in self.call("DescribeLogGroups", {}).get("logGroups", []) if g.get("logGroupName")]
        if name == "log_stream":
            got = self.call("DescribeLogStreams", {"logGroupName": self.group(), "orderBy": "LastEventTime", "descending": True})
            return [s["logStreamName"] for s in got.get("logStreams", []) if s.get("logStreamName")]
        return []

    def health(self) -> None:
        self.call("DescribeLogGroups", {})

    def begin(self) -> dict:
        return {"ms": int(self.o.get("start_ms", now_ms() - 30_000)), "seen": [], "n": 0}

    def follow(self, at: dict) -> tuple[list[tuple], dict]:
        """Events from the cursor on, with a second of overlap; those given in
        it are known by their ids. Events without an id are left out."""
        seen, out, newest, token = set(at["seen"]), [], None, None
        ids: list[tuple[int, str]] = []
        while True:
            got = self.events(at["ms"], now_ms() + 1000, min(self.page, 1000), token)
            for e in got.get("events") or []:
                if not e.get("eventId") or e.get("timestamp") is None:
                    continue
                ids.append((e["timestamp"], e["eventId"]))
                newest = max(newest or 0, e["timestamp"])
                if e["eventId"] not in seen:
                    seen.add(e["eventId"])
                    out.append(self.row(e))
            token = got.get("nextToken")
            if not token:
                break
        start = at["ms"] if newest is None else max(at["ms"], newest - 1000)
        return out, {"ms": start, "seen": sorted({i for t, i in ids if t >= start}) if newest is not None else at["seen"], "n": at["n"] + len(out)}


class FileTail:
    """Lines appended to files, read by the driver from byte positions on."""

    schema = FILE_SCHEMA

    def __init__(self, o: dict):
        self.o = o
        self.most = int(o.get("batch_bytes", 16 << 20))

    def paths(self) -> list[str]:
        return sorted(glob.glob(self.o["path"]))

    def begin(self) -> dict:
        """The ends of the files there are, or their beginnings with ``from_start``."""
        whole = str(self.o.get("from_start", "")).lower() == "true"
        return {"at": {p: 0 if whole else os.path.getsize(p) for p in self.paths()}, "n": 0}

    def follow(self, at: dict) -> tuple[list[tuple], dict]:
        """Whole new lines; empty ones are skipped, files that shrank begin again."""
        out, ends = [], dict(at["at"])
        for p in self.paths():
            start = ends.get(p, 0)
            if os.path.getsize(p) < start:
                start = 0
            with open(p, "rb") as f:
                f.seek(start)
                data = f.read(self.most)
            end = data.rfind(b"\n") + 1
            if not end and len(data) == self.most:
                raise QueryFailed(f"{p}: a line is longer than {self.most} bytes; raise batch_bytes")
            out += [(p, x.rstrip("\r")) for x in data[:end].decode(errors="replace").split("\n") if x.rstrip("\r")]
            ends[p] = start + end
        return out, {"at": ends, "n": at["n"] + len(out)}


class CommandTail:
    """What a command, a container or a pod says from now on, asked by the driver.

    A command is run anew each time and its lines beyond those given are new.
    Containers and pods are asked since the last time stamp; lines of that
    stamp which were given are known by their texts. Needs ``allow``.
    """

    schema = FILE_SCHEMA

    def __init__(self, o: dict):
        self.o = o
        if str(o.get("allow", "")).lower() != "true":
            raise QueryFailed("commands run only with allow=True")

    def lines(self, args: list[str]) -> list[str]:
        done = subprocess.run(args, capture_output=True, text=True, errors="replace", timeout=60)
        return [x.rstrip("\r") for x in (done.stdout + done.stderr).splitlines() if x.strip()]

    def stamped(self, since: str) -> list[str]:
        if self.o["kind"] == "docker":
            return self.lines([self.o.get("program", "docker"), "logs", "--timestamps", "--since", since, self.o["container"]])
        what = [self.o["pod"]] if self.o.get("pod") else ["-l", self.o["selector"], "--prefix"]
        return self.lines([self.o.get("program", "kubectl"), "logs", "-n", self.o.get("namespace", "default"), "--timestamps", f"--since-time={since}", *what])

    def begin(self) -> dict:
        if self.o["kind"] == "command":
            return {"seen": 0 if str(self.o.get("from_start", "")).lower() == "true" else len(self.lines(["sh", "-c", self.o["command"]])), "n": 0}
        return {"since": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "seen": [], "n": 0}

    def follow(self, at: dict) -> tuple[list[tuple], dict]:
        if self.o["kind"] == "command":
            got = self.lines(["sh", "-c", self.o["command"]])
            out = [(self.o["command"], x) for x in got[at["seen"] :]]
            return out, {"seen": max(len(got), at["seen"]), "n": at["n"] + len(out)}
        left, out, last, seen = Counter(at["seen"]), [], at["since"], list(at["seen"])
        for x in self.stamped(at["since"]):
            stamp, _, text = x.partition(" ")
            if stamp == at["since"] and left[text]:
                left[text] -= 1
                continue
            if stamp > last:
                last, seen = stamp, []
            if stamp == last:
                seen.append(text)
            if text:
                out.append((self.o.get("container") or self.o.get("pod") or self.o.get("selector"), text))
        return out, {"since": last, "seen": seen, "n": at["n"] + len(out)}


KINDS = {"loki": Loki, "elasticsearch": Elastic, "cloudwatch": CloudWatch, "file": FileTail, "command": CommandTail, "docker": CommandTail, "kubernetes": CommandTail}


class Slice(InputPartition):
    def __init__(self, number: int, start: int, end: int):
        self.number, self.start, self.end = number, start, end


class StoreReader(DataSourceReader):
    """A time range in slices that load in parallel; every slice is read to its
    end. ``seq`` numbers the rows of a slice as they come."""

    def __init__(self, kind: type, o: dict):
        self.kind, self.o = kind, o

    def partitions(self) -> list[InputPartition]:
        unit = self.kind.unit
        bound = lambda x, other: int(self.o[f"{x}_ns"]) if f"{x}_ns" in self.o and unit > 1 else int(self.o[f"{x}_ms"]) * unit if f"{x}_ms" in self.o else other
        b = bound("end", now_ms() * unit)
        a = bound("start", b - 3_600_000 * unit)
        n = max(1, int(self.o.get("slices", 1)))
        edges = [a + (b - a) * i // n for i in range(n + 1)]
        cuts = list(zip(edges, edges[1:]))
        if self.kind is Loki:
            cuts.reverse()
        return [Slice(i, s, e) for i, (s, e) in enumerate(cuts)]

    def read(self, part: Slice) -> Iterator[tuple]:
        for i, row in enumerate(self.kind(self.o).rows(part.start, part.end)):
            yield ((part.number << 40) + i, *row)


class StoreTail(SimpleDataSourceStreamReader):
    """Polls a store; the cursor of the store is the offset, so a restarted
    query goes on where it was."""

    def __init__(self, kind: type, o: dict):
        self.kind, self.o = kind, o

    def initialOffset(self) -> dict:
        return self.kind(self.o).begin()

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self.kind(self.o).follow(start)
        return iter([(start["n"] + i, *r) for i, r in enumerate(rows)]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at, rows = start, []
        while at["n"] < end["n"]:
            got, after = self.read(at)
            rows += got
            if after["n"] == at["n"]:
                break
            at = after
        return iter(rows[: end["n"] - start["n"]])


class LogStore(DataSource):
    """The data source ``log_store``."""

    @classmethod
    def name(cls) -> str:
        return "log_store"

    def kind(self) -> type:
        kind = self.options.get("kind", "loki")
        if kind not in KINDS:
            raise SourceError(f"unknown store {kind!r}")
        return KINDS[kind]

    def schema(self) -> str:
        return self.kind().schema

    def reader(self, schema) -> DataSourceReader:
        return StoreReader(self.kind(), dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return StoreTail(self.kind(), dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogStore)
