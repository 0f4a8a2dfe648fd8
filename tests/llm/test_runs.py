import random

from pyspark.sql import functions as F

from tidelog.llm import runs as R

S = "source_table string, stream string, id bigint, key string, toks array<bigint>, weight bigint, first_us bigint, last_us bigint, repeat boolean, block int"


def brute(events):
    out = []
    by = {}
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        by.setdefault(e[1], []).append(e)
    for stream, es in by.items():
        cur = None
        for e in es:
            if e[8]:
                if cur:
                    cur[3], cur[4] = e[2], cur[4] + e[5]
            elif cur and cur[5] == e[3] and e[3] is not None:
                cur[3], cur[4] = e[2], cur[4] + (e[5] or 1)
            else:
                if cur:
                    out.append(cur)
                cur = ["t", stream, e[2], e[2], e[5] or 1, e[3]]
        if cur:
            out.append(cur)
    return {tuple(x[1:5]) for x in out if x[4] > 1}


def test_runs_over_any_blocks_equal_brute_force(spark):
    r = random.Random(4)
    for seed in range(3):
        ev = []
        for i in range(300):
            rep = r.random() < 0.08
            ev.append(("t", f"s{i % 3}" if i % 2 else "hot", i, None if rep or r.random() < 0.03 else r.choice("ab"), None, r.choice([1, 1, 2, None]) if not rep else r.randrange(1, 5), i, i, rep, 7))
        df = spark.createDataFrame(ev, S)
        want = brute(ev)
        for block in (1, 2, 7, 10_000):
            got = R.collapse(df, block=block).where("event_count > 1")
            assert {(x.stream, x.first_id, x.last_id, x.event_count) for x in got.collect()} == want, block


def test_keys_keep_all_digits_where_a_block_begins_with_a_report(spark):
    ev = [("t", f"s{k}", i, "same", None, 1, i, i, i == 110, 7) for k in range(5) for i in range(200)]
    ev = [(*e[:3], None if e[8] else e[3], *e[4:]) for e in ev]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # blocks of a stream in several tasks
    got = R.collapse(spark.createDataFrame(ev, S), block=10)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.stream, r.first_id, r.last_id, r.event_count) for r in got.collect()} == {(f"s{k}", 0, 199, 200) for k in range(5)}


def brute_similar(events, theta, gap):
    """Equal neighbours first; then, of all neighbouring runs whose touching events are alike and near, the most similar ones again and again."""
    runs = []
    for e in sorted(events, key=lambda e: e[2]):
        if runs and runs[-1]["key"] == e[3] and e[6] - runs[-1]["t1"] <= gap:
            runs[-1].update(last=e[2], n=runs[-1]["n"] + 1, t1=max(runs[-1]["t1"], e[7]))
        else:
            runs.append({"key": e[3], "rep": set(e[4]), "end": set(e[4]), "first": e[2], "last": e[2], "n": 1, "t0": e[6], "t1": e[7]})
    jac = lambda a, b: len(a & b) / len(a | b)
    for x, y in zip(runs, runs[1:]):
        x["link"] = jac(x["end"], y["rep"]) >= theta and y["t0"] - x["t1"] <= gap
    while True:
        best = max(((jac(x["rep"], y["rep"]), -i) for i, (x, y) in enumerate(zip(runs, runs[1:])) if x["link"]), default=(0, 0))
        if best[0] < theta or not best[0]:
            return {(x["first"], x["last"], x["n"]) for x in runs}
        i = -best[1]
        x, y = runs[i], runs.pop(i + 1)
        x.update(last=y["last"], n=x["n"] + y["n"], link=y.get("link", False))


def test_near_equal_runs_over_any_blocks_equal_brute_force(spark):
    r = random.Random(8)
    kinds = {"a": [1, 2, 3, 4, 5], "b": [1, 2, 3, 4, 6], "c": [1, 2, 3, 7, 6], "d": [1, 2, 8, 7, 6], "e": [9, 10], "f": [9, 10, 11]}
    ev, at = [], 0
    for i in range(250):
        k = r.choice("aabbccddef")
        at += r.choice([1, 1, 1, 40])
        ev.append(("t", "s", i, k, kinds[k], 1, at, at, False, 7))
    df = spark.createDataFrame(ev, S)
    for theta, gap in ((0.6, 20), (0.4, 1000)):
        want = brute_similar(ev, theta, gap)
        for block in (1, 7, 100_000):
            got = {(x.first_id, x.last_id, x.event_count) for x in R.collapse_similar(df, min_similarity=theta, max_gap_us=gap, block=block).collect()}
            assert got == want, (theta, block)
    assert R.collapse_similar(df.limit(0), min_similarity=0.5).count() == 0


def test_null_tokens_are_like_nothing(spark):
    ev = [("t", "s", i, k, None, 1, 0, 0, False, 0) for i, k in enumerate("aab")]
    got = {(x.first_id, x.last_id, x.n_kinds) for x in R.collapse_similar(spark.createDataFrame(ev, S), min_similarity=0.1).collect()}
    assert got == {(0, 1, 1), (2, 2, 1)}


def test_most_similar_pair_goes_first():
    ev = [(0, "a", frozenset([1, 2, 3, 4]), 1, 0, 0, False), (1, "b", frozenset([1, 2, 3, 5]), 1, 0, 0, False), (2, "b", frozenset([1, 2, 3, 5]), 1, 0, 0, False), (3, "c", frozenset([7]), 1, 0, 0, False)]
    assert [(r[2], r[3], r[4]) for r in R.agglomerate(ev, 0.5, None)] == [(0, 2, 3), (3, 3, 1)]


def test_constant_text(spark):
    same = [("Lease  on x renewed until 2025-05-22T11:06:15Z by node-11\r", "lease on \x1b[31mx\x1b[0m renewed until 2025-04-01T00:00:00Z by node-2"), ("took 72.1s of 1,234 kB", "took 5ms of 7 kB"), ("from 10.0.0.1:80: refused", "from 10.20.30.40: refused"), ("Mar  1 10:00:00 h-1 x[1]: a", "Apr 30 23:59:59 h-2 x[77]: a"), ("id=592513eb-89c7-95b7-5e45-34d3f3035284", "id=f92513eb-89c7-95b7-5e45-34d3f3035284"), ('{"ts": 1741565367136}', '{"ts":  1741565367999}')]
    other = [("cinder.drain: 5 items", "cinder.seal: 5 items"), ("GET /v2/profile/4", "GET /v2/ticket/4"), ("kept=1", "lost=1")]
    df = spark.createDataFrame([(a, b, True) for a, b in same] + [(a, b, False) for a, b in other], "a string, b string, eq boolean")
    bad = df.where((R.constant_text(F.col("a")) == R.constant_text(F.col("b"))) != F.col("eq")).collect()
    assert not bad


def test_found_runs_of_both_tables(spark):
    from datetime import datetime, timedelta, timezone

    t0 = datetime(2025, 3, 10, tzinfo=timezone.utc)
    at = lambda i: (t0 + timedelta(seconds=i)).strftime("%b %d %H:%M:%S")
    lines = [f"{at(1)} h-1 xd[1]: disk for a is 5% full", f"{at(2)} h-1 xd[2]: Disk for a  is 99% full", f"{at(3)} h-1 last message repeated 4 times", f"{at(4)} h-1 xd[2]: message repeated 2 times: [ disk for a is 7% full]", f"{at(5)} h-1 xd[2]: disk for b is 7% full", f"{at(6)} h-1 yd[2]: disk for b is 7% full"]
    log = spark.createDataFrame([(i + 1, t0, {"stream": "s"}, x, None) for i, x in enumerate(lines)], "seq bigint, ts timestamp, labels map<string,string>, line string, raw string")
    dd = [(1, "s", "INFO a.b: x 5", 0, 3), (2, "s", "INFO a.b: x 77", 3, None), (3, "s", "WARN a.b: x 77", 4, 1), (4, None, "INFO a.b: x", 5, 2), (5, "r", None, 1, 1)]
    ded = spark.createDataFrame([(a, b, c, d, e, t0, None) for a, b, c, d, e in dd], "group_id bigint, stream_name string, line string, entry_idx bigint, event_count bigint, first_ts timestamp, last_ts timestamp")
    got = {(r.source_table, r.first_id, r.last_id, r.event_count) for r in R.found_runs(log, ded).collect()}
    assert got == {("log_entry", 1, 4, 8), ("dedup_group", 1, 2, 4), ("dedup_group", 4, 4, 2)}
    times = {r.first_id: (r.first_us, r.last_us) for r in R.found_runs(log, ded).where("source_table = 'log_entry'").collect()}
    us = int(t0.timestamp()) * 1_000_000
    assert times == {1: (us + 1_000_000, us + 4_000_000)}, "the times that the events state"
    assert R.similar_runs(log, ded, min_similarity=0.5).where("source_table = 'log_entry'").count() >= 1
