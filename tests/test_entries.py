import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidelog.operators import entries as E
from tidelog.operators import templates as T

DAY = datetime(2025, 3, 10, 6, 0, 0, tzinfo=timezone.utc)


def heads(i, at):
    """One line per layout with what its header states."""
    lv = ["INFO", "WARN", "ERROR"][i % 3]
    norm = lv.lower()
    us = int(at.timestamp() * 1_000_000)
    ms, s = us // 1000 * 1000, us // 1_000_000 * 1_000_000
    iso = at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}"
    east = (at + timedelta(hours=5, minutes=30)).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}+05:30"
    sp, comma = iso.replace("T", " "), iso.replace("T", " ").replace(".", ",")
    word = ["info", "error", "panic"][i % 3]
    tail = f"{word} budget {i} of job-{i} is at {i}ms" if i // 14 % 4 else f"{word} job-{i} (last of 9) is done"
    return [
        (f"{iso}Z {lv:5} [mint.open] {tail}", ms, norm, "mint.open"),
        (f"{east} \x1b[33m{lv}\x1b[0m [mint.seal] {tail}", ms, norm, "mint.seal"),
        (f"{sp.replace('-', '/')} UTC [{i}] mint.pull {lv}:  {tail}", ms, norm, "mint.pull"),
        (f"[{comma}: {lv}/mint.push] {tail}\r", ms, norm, "mint.push"),
        (f"{comma} [exec-{i}] {lv:5} o.mint.Task - {tail}", ms, norm, "o.mint.Task"),
        (f"{lv[0]}{at.strftime('%m%d %H:%M:%S.%f')} {i:7d} pull.go:{i}] {tail}", us, norm, "pull.go"),
        (f"{iso[11:]} {lv[0]}/mint.sync: {tail}", ms, norm, "mint.sync"),
        (f"{ms // 1_000_000}.{ms // 1000 % 1000:03d}|{lv}|mint.pipe|{tail}", ms, norm, "mint.pipe"),
        (f"{at.strftime('%b')} {at.day:2d} {at.strftime('%H:%M:%S')} host-{i} mintd[{i}]: {tail}", s, "", "mintd"),
        (f"{lv}:mint.note:{tail}", None, norm, "mint.note"),
        (f"10.0.{i % 200}.7 - - [{at.strftime('%d/%b/%Y:%H:%M:%S')} +0000] \"GET /v1/x/{i} HTTP/1.1\" 200 {i}", s, "", ""),
        (f'{{"time":"{iso}Z","level":"{lv}","logger":"mint.json","message":"{tail} \\"level\\": x"}}', ms, norm, "mint.json"),
        (f'ts={iso}Z level={norm} component=mint.kv msg="{tail} level=fatal"', ms, norm, "mint.kv"),
        (f'severity={lv} logger=mint.sev msg="{tail} ts=1" ts={ms // 1_000_000}.{ms // 1000 % 1000:03d}', ms, norm, "mint.sev"),
    ]


NEXT = ["\tat a.b.C(D.java:9)", "  File \"x.py\", line 3, in f", "", "KeyError: x 3", "-- ERROR hint: index is stale", "| a | 5 |", "    2025-03-10T00:00:00Z ERROR [relay] quoted", "SELECT a.id, b.x", '{', '  "level": "info"', "}", "exit status 4", "goroutine 9 [running]:"]


def sample(n, seed=5):
    r = random.Random(seed)
    rows, want, seq = [], {}, 0
    for i in range(n):
        at = DAY + timedelta(seconds=37 * i, microseconds=r.randrange(1_000_000))
        k = i % 14
        line, us, lv, comp = heads(i, at)[k]
        seq += 1
        first = seq
        rows.append((seq, at, {"stream": f"s{k}"}, line, None))
        more = r.randrange(0, 4) if i % 3 == 0 else 0
        for _ in range(more):
            seq += 1
            rows.append((seq, at, {"stream": f"s{k}"}, r.choice(NEXT), None))
        ts = int(at.timestamp()) * 1_000_000 + at.microsecond
        want[("log_entry", first, 0)] = (ts if us is None else us, lv, comp, 1 + more)
    return rows, want


SCHEMA = "seq bigint, ts timestamp, labels map<string,string>, line string, raw string"
GROUPED = "group_id bigint, ts timestamp, labels map<string,string>, line string, continuation_lines array<string>, collapsed boolean"


def test_all_layouts_are_found_and_read(spark):
    rows, want = sample(700)
    grouped = spark.createDataFrame([], GROUPED)
    out = E.found_entries(spark.createDataFrame(rows, SCHEMA), grouped)
    got = {(r.source_table, r.row_id, r.line_no): (r.event_us, r.log_level, r.component, r.n_lines) for r in out.collect()}
    assert got == want


def test_groups_may_hold_and_share_entries(spark):
    ts = DAY
    h = "2025-03-10T06:00:00.000Z INFO  [a.b] x"
    rows = [(1, ts, {"stream": "g"}, h, ["\tat x", h, None], True), (2, ts, {"stream": "g"}, "\tat y", None, False), (3, ts, {"stream": "g"}, None, [h], None), (4, ts, None, h, [], None)]
    out = E.found_entries(spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, GROUPED))
    assert {(r.row_id, r.line_no): r.n_lines for r in out.collect()} == {(1, 0): 2, (1, 2): 4, (3, 1): 1, (4, 0): 1}


def test_blocks_give_the_same_entries_and_digests(spark):
    rows, _ = sample(300, 9)
    lines = E.log_lines(spark.createDataFrame(rows, SCHEMA))
    parsed = E.parse_headers(lines, T.layouts(lines, "line"))
    key = lambda df: {tuple(r) for r in df.select("stream", "row_id", "n_lines", "d0", "d1").collect()}
    one = key(E.group_entries(parsed, text=F.col("line")))
    assert one == key(E.group_entries(parsed, text=F.col("line"), block=7)) == key(E.group_entries(parsed, text=F.col("line"), block=1))
    long = {(r.stream, r.row_id): len(r.lines) for r in E.entry_texts(parsed, block=7).collect()}
    assert long == {(s, i): n for s, i, n, _, _ in one}


def test_lines_without_any_head_and_empty_tables(spark):
    rows = [(1, DAY, {"stream": "s"}, "plain words only", None), (2, None, {"stream": "s"}, None, None)]
    assert E.found_entries(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], GROUPED)).count() == 0
    assert E.found_entries(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], GROUPED)).count() == 0


def test_missing_date_parts_are_nearest(spark):
    df = spark.createDataFrame([("Dec 31 23:59:59", T.BSD, "2025-01-01 00:00:05"), ("0229 10:00:00.5", T.COMPACT, "2024-03-01 00:00:00"), ("23:59:58.250", T.CLOCK, "2025-03-10 00:00:03")], "t string, k string, at string")
    got = df.select(F.timestamp_micros(E.stated_time(F.col("k"), F.col("t"), F.unix_micros(F.to_timestamp("at")))).cast("string")).collect()
    assert [r[0] for r in got] == ["2024-12-31 23:59:59", "2024-02-29 10:00:00.5", "2025-03-09 23:59:58.25"]


def test_lcs():
    r = random.Random(3)
    for _ in range(200):
        a = [r.choice("abc") for _ in range(r.randrange(0, 9))]
        b = [r.choice("abc") for _ in range(r.randrange(0, 9))]
        t = T.lcs_template(a, b)
        assert T.lcs_length(a, b) == sum(x != T.GAP for x in t)


def test_templates_decide_what_is_a_header(spark):
    """A word is a component, and a header without time one at all, only where messages of different make share the frame."""
    tagged = [f"Mar 10 06:00:0{i} host-{i} mintd[{i}]: {m}" for i, m in enumerate(("started", "took 5 ms (warm)", "peer 10.0.0.1:80 left, code=7"))]
    note = [f"INFO:mint.note:{m}" for m in ("started", "took 5 ms (warm)", "peer 10.0.0.1:80 left, code=7")]
    lone = ["Mar 11 06:00:00 host-1 other[7]: started"]
    make = lambda lines: spark.createDataFrame([(x,) for x in lines], "line string")
    both = T.layouts(make(tagged + note), "line")
    assert {(bool(x.time), bool(x.level), bool(x.component)) for x in both} == {(True, False, True), (False, True, True)}
    alone = T.layouts(make(lone + note[:1]), "line")
    assert {(bool(x.time), bool(x.level), bool(x.component)) for x in alone} == {(True, False, False)}
    shapes = [(f"{T.BSD} {host} {T.WORD}[{T.NUMBER}]: {T.WORD}", 1, 1) for host in (T.IDENT, T.WORD)]
    merged = T.cluster(shapes)
    assert len(merged) == 1 and T.GAP in merged[0][0] and T.layout_of(*merged[0][::2]).component, "a host that varies is a slot"
    assert T.readable("".join(merged[0][0])).startswith("<time> <...>")


def test_entry_texts_hold_all_lines_over_block_borders(spark):
    rows = [(i, DAY, {"stream": "s"}, f"2025-03-10T06:00:00Z INFO [a.b] message {i}" if i % 5 == 0 else f"  at {i}", None) for i in range(40)]
    lines = E.log_lines(spark.createDataFrame(rows, "seq bigint, ts timestamp, labels map<string,string>, line string, raw string"))
    parsed = E.parse_headers(lines, T.layouts(lines, "line"))
    for block in (1, 7, 1000):
        got = {r.row_id: r.lines for r in E.entry_texts(parsed, block=block).collect()}
        assert got == {i: [x[3] for x in rows[i : i + 5]] for i in range(0, 40, 5)}
