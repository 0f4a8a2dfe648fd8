import math
import random
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import digests as D


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, d date, v double, n int, mean string")


def shapes(n, seed=3):
    r = random.Random(seed)
    one = [("tail", math.exp(r.gauss(0, 3))) for _ in range(n)]
    two = [("humps", r.gauss(0, 1) if r.random() < 0.5 else r.gauss(100, 1)) for _ in range(n)]
    tie = [("ties", float(r.choice([200, 200, 200, 404]))) for _ in range(n)]
    srt = [("sorted", float(i)) for i in range(n)]
    few = [("few", -1.0), (None, 5.0), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 1.0), ("nan", float("nan")), ("null", None)]
    return [(g, date(2025, 3, 1 + i % 3), v, 0, "x") for i, (g, v) in enumerate(one + two + tie + srt + few)]


def test_certified_errors_keep_the_bound(spark):
    rows = shapes(4000)
    df = frame(spark, rows).repartition(5)
    days = D.merge(D.build(df, ["g", "d"], "v"), ["g", "d"], levels=1)
    for keys, digests in ((["g"], D.merge(days, ["g"])), (["g", "d"], days)):
        wide = D.percentiles(digests, keys)
        out = D.tall(D.certify(df, wide, [D.key_hash(keys)], "v", D.key_hash(keys)), keys).collect()
        assert any(r.error > 0 for r in out), "day digests blur values too"
        for r in out:
            assert r.error <= r.bound < 0.06, r
            vals = sorted(v for g, d, v, *_ in rows if g == r.g and (len(keys) == 1 or d == r.d) and v is not None and not math.isnan(v))
            assert r.n == len(vals)
            rank = max(1, math.ceil(r.quantile * r.n - 1e-9))
            lo, hi = np.searchsorted(vals, r.estimate, "left"), np.searchsorted(vals, r.estimate, "right")
            off = max(lo + (hi > lo) - rank, rank - hi, 0) / r.n
            assert abs(off - r.error) < 1e-12
        assert {r.g for r in out} == {"tail", "humps", "ties", "sorted", "few", "inf", None}


def test_small_groups_are_exact_and_flushes_merge(spark, monkeypatch):
    vals = list(range(50))
    df = frame(spark, [("a", None, float(v), 0, "") for v in vals])
    r = D.percentiles(D.merge(D.build(df, ["g"], "v"), ["g"]), ["g"]).collect()[0]
    assert r.exact and [r.e0, r.e1, r.e2, r.e3, r.e4] == [24.0, 44.0, 47.0, 49.0, 49.0] and [r.x0, r.x1, r.x2, r.x3, r.x4] == [0.0] * 5
    whole = D.percentiles(D.merge(D.build(df, [], "v"), []), []).collect()
    assert [x.e0 for x in whole] == [24.0]


def test_ways_of_counting_and_of_holding_agree(spark, monkeypatch):
    df = frame(spark, shapes(3000)).repartition(4)
    one = {(r.g, r.quantile): r for r in D.grouped(df, ["g"], "v").collect()}
    monkeypatch.setattr(D, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(D, "HELD_CENTROIDS", 100)
    monkeypatch.setattr(D, "FLUSH_ROWS", 500)
    two = {(r.g, r.quantile): r for r in D.grouped(df, ["g"], "v").collect()}
    assert one.keys() == two.keys() and all(two[k].n == one[k].n and two[k].error <= two[k].bound for k in one)


def test_empty(spark):
    assert D.grouped(frame(spark, []), ["g"], "v").count() == 0


def test_cluster_keeps_totals():
    v = np.sort(np.random.default_rng(1).exponential(size=10_000))
    g, m, w, lo, hi = D.cluster(np.zeros(10_000, int), v, np.ones(10_000, int), v, v)
    assert w.sum() == 10_000 and len(w) <= D.DELTA and np.isclose((m * w).sum(), v.sum()) and (lo <= m).all() and (m <= hi).all()


def test_repeated_deliveries_count_once(spark):
    s = "metric_id bigint, metric_name string, metric_value double, ts timestamp, batch_day date, labels map<string,string>, extra int"
    rows = [(1, "a", 1.0, None, date(2025, 1, 1), {"service": "x"}, 0), (1, "a", 1.0, None, date(2025, 1, 2), {"service": "x"}, 0), (None, "a", 2.0, None, None, None, 0), (None, "a", 2.0, None, None, None, 0)]
    got = D.first_deliveries(spark.createDataFrame(rows, s))
    assert sorted(r.v for r in got.collect()) == [1.0, 2.0, 2.0]
    e = "window_id bigint, endpoint_pattern string, window_start timestamp, shard_name string, p50_ms double, p99_ms double, b int"
    ends = [(1, "/x", None, "s", 1.0, None, 0), (1, "/x", None, "s", 1.0, None, 0), (2, None, None, "s", 3.0, 4.0, 0)]
    p = D.all_percentiles(spark.createDataFrame(rows, s), spark.createDataFrame(ends, e)).where("quantile = 0.5").collect()
    assert [(r.n, r.estimate, r.error, r.bound) for r in p if r.level == "metric_name"] == [(3, 2.0, 0.0, 0.0)]
    assert sorted((r.period is None, r.service or "", r.n) for r in p if r.level == "metric_name+service+batch_day") == [(False, "x", 1), (True, "", 2)]
    assert sorted((r.column_name, r.group_name or "", r.n) for r in p if r.level == "endpoint_pattern") == [("p50_ms", "", 1), ("p50_ms", "/x", 1), ("p99_ms", "", 1)]


def test_names_swapped_with_null_stay_apart(spark):
    s = "metric_id bigint, metric_name string, metric_value double, ts timestamp, batch_day date, labels map<string,string>"
    rows = [(1, "a", 1.0, None, None, {}), (2, None, 2.0, None, None, {"service": "a"})]
    e = "window_id bigint, endpoint_pattern string, window_start timestamp, shard_name string, p50_ms double, p99_ms double"
    p = D.all_percentiles(spark.createDataFrame(rows, s), spark.createDataFrame([], e)).where("quantile = 0.5 and level = 'metric_name+service'").collect()
    assert sorted((r.group_name or "", r.service or "", r.estimate) for r in p) == [("", "a", 2.0), ("a", "", 1.0)]
