"""Percentiles of very large numeric columns with a certified bound (problem 1).

Merging centroid digests. Sorted values are clustered under a size function of
the quantile (k1: arcsine), so that clusters are small at the tails. Partial
digests of partitions, days or windows merge by sorting their centroids and
clustering again. Each centroid keeps its least and greatest value, so a digest
proves by itself between which ranks an estimate lies, however often it was
merged: that is the stated bound. A second pass over the values counts how many
lie below and at each estimate: the rank error that comes out is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.runtime import cut, drop_cut

DELTA = 1000
QUANTILES = (0.5, 0.9, 0.95, 0.99, 0.999)
FLUSH_ROWS = 400_000
DIGEST = "n bigint, mean array<double>, weight array<bigint>, lo array<double>, hi array<double>"
VALUES = ["n", "mean", "weight", "lo", "hi"]
#: Centroids a merging task holds before it closes groups.
HELD_CENTROIDS = 1_000_000


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, delta: int = DELTA):
    """Cluster sorted centroids of many groups at once.

    ``group`` is non-decreasing and ``mean`` sorted within it. A centroid goes
    to cluster floor(k1(q)) of its middle rank q; clusters are runs of equal
    floors, so each covers at most one unit of k1.
    """
    if not len(group):
        return group, mean, weight, lo, hi
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((first, [len(group)])))
    total = np.repeat(np.add.reduceat(weight, first), sizes)
    upto = np.cumsum(weight)
    before = upto - weight - np.repeat((upto - weight)[first], sizes)
    q = (before + weight / 2) / total
    k = np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1)))
    start = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (group[1:] != group[:-1]))))
    w = np.add.reduceat(weight, start)
    with np.errstate(invalid="ignore", over="ignore"):
        m = np.add.reduceat(mean * (weight / np.repeat(w, np.diff(np.concatenate((start, [len(group)]))))), start)
    low, high = np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)
    m = np.where(np.isnan(m), low, np.clip(m, low, high))
    return group[start], m, w, low, high


def ranks(q: float, n: np.ndarray) -> np.ndarray:
    """The wanted rank of each group: ceil(q*n), at least 1."""
    return np.maximum(1, np.ceil(q * n - 1e-9)).astype(np.int64)


def estimates_at(q: float, n: np.ndarray, sizes: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each group the value at rank ceil(q*n): between the ends of the
    centroid that covers it. ``sizes`` tells how many centroids each group has."""
    upto = np.cumsum(weight)
    first = np.cumsum(sizes) - sizes
    base = (upto - weight)[first]
    rank = ranks(q, n)
    i = np.minimum(np.searchsorted(upto, base + rank), first + sizes - 1)
    w, low, high = weight[i], lo[i], hi[i]
    at = base + rank - (upto[i] - w)
    between = (w > 1) & (low != high) & np.isfinite(low) & np.isfinite(high)
    with np.errstate(invalid="ignore"):
        inner = low + (high - low) * ((at - 1) / np.maximum(w - 1, 1))
    return np.where(between, inner, np.where(at <= w / 2, low, high))


def estimate(q: float, n: int, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> float:
    """:func:`estimates_at` of one digest."""
    return float(estimates_at(q, np.array([n]), np.array([len(weight)]), weight, lo, hi)[0])


def _codes(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row and the first row of each group (null is a key)."""
    code = np.zeros(len(t), np.int64)
    for k in keys:
        d = t[k].combine_chunks().dictionary_encode(null_encoding="encode")
        code = pd.factorize(code * max(len(d.dictionary), 1) + d.indices.to_numpy(zero_copy_only=False).astype(np.int64))[0].astype(np.int64)
    first = np.full(int(code.max(initial=-1)) + 1, -1, np.int64)
    first[code[::-1]] = np.arange(len(t) - 1, -1, -1)
    return code, first


def _pack(keys: pa.Table, group, mean, weight, lo, hi) -> pa.Table:
    """Digests as rows: ``keys`` has one row per group number.

    Ends that equal the means, and weights that are all 1, aren't stored: most
    groups are small and their centroids single values.
    """
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(first, len(group)))
    cols = {k: keys[k].take(pa.array(group[first])) for k in keys.column_names}
    cols["n"] = pa.array(np.add.reduceat(weight, first))

    def lists(x: np.ndarray, kept: np.ndarray) -> pa.ListArray:
        ends = np.cumsum(np.where(kept, sizes, 0))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(x[np.repeat(kept, sizes)]))

    blurred = ~np.minimum.reduceat((lo == mean) & (hi == mean), first)
    cols["mean"] = lists(mean, np.ones(len(first), bool))
    cols["weight"] = lists(weight, np.maximum.reduceat(weight, first) > 1)
    cols["lo"], cols["hi"] = lists(lo, blurred), lists(hi, blurred)
    return pa.table(cols)


def _sizes(t: pa.Table, name: str = "mean") -> np.ndarray:
    return np.diff(t[name].combine_chunks().offsets.to_numpy())


def _flat(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, weights, least and greatest values of all centroids, in order."""
    sizes, mean = _sizes(t), _flat(t, "mean").astype(float, copy=False)

    def column(name: str, plain: np.ndarray) -> np.ndarray:
        plain[np.repeat(_sizes(t, name) > 0, sizes)] = _flat(t, name)
        return plain

    return mean, column("weight", np.ones(len(mean), np.int64)), column("lo", mean.copy()), column("hi", mean.copy())


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def build(df: DataFrame, keys: Sequence[str], value: str, *, delta: int = DELTA) -> DataFrame:
    """Partial digests: rows are clustered where they are read, before any shuffle.

    Null and NaN values are left out; infinite ones count as least or greatest.
    Groups are ``keys`` (null is a key like any other). One row per group and
    flush of a task; :func:`merge` makes one of them.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            v = t["_v"].to_numpy()
            code, first = _codes(t, keys)
            order = np.lexsort((v, code))
            x = v[order]
            made = _pack(t.select(keys).take(pa.array(first)) if keys else pa.table({}), *cluster(code[order], x, np.ones(len(x), np.int64), x, x, delta))
            return iter(made.to_batches(max_chunksize=20_000))

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= FLUSH_ROWS:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    return rows.mapInArrow(run, f"{_ddl(df, keys)}, {DIGEST}" if keys else DIGEST)


def _merge_once(partials: DataFrame, keys: list[str], spread: list[str], delta: int, coarser: Sequence[dict[str, int]] = ()) -> DataFrame:
    by = keys + spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(t: pa.Table) -> pa.Table:
            code, first = _codes(t, by)
            g = np.repeat(code, _sizes(t))
            m, w, lo, hi = _unpack(t)
            order = np.lexsort((hi, lo, m, g))
            return _pack(t.select(by).take(pa.array(first)) if by else pa.table({}), *cluster(g[order], m[order], w[order], lo[order], hi[order], delta))

        def close(t: pa.Table) -> Iterator[pa.RecordBatch]:
            made = pack(t)
            yield from made.select([*keys, *VALUES]).to_batches(max_chunksize=20_000)
            for fixed in coarser:
                up = made
                for k, v in fixed.items():
                    up = up.set_column(up.schema.get_field_index(k), k, pa.array(np.full(len(up), v), up.schema.field(k).type))
                yield from pack(up).select([*keys, *VALUES]).to_batches(max_chunksize=20_000)

        # rows come sorted by group: whole groups are closed as soon as enough
        # is held, and a group too large to hold is clustered where it stands
        held: list[pa.Table] = []
        total = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            total += int(_sizes(held[-1]).sum())
            if total > HELD_CENTROIDS:
                t = pa.concat_tables(held)
                code, _ = _codes(t, by)
                closed = int(np.argmax(code == code[-1]))
                if closed:
                    yield from close(t.slice(0, closed))
                open_one = pack(t.slice(closed)).select(t.column_names)
                held = [open_one.cast(t.schema)]
                total = int(_sizes(held[0]).sum())
        if held:
            yield from close(pa.concat_tables(held))

    cols = [*by, *VALUES]
    placed = partials.select(*cols).repartition(*by).sortWithinPartitions(*by) if by else partials.select(*cols).coalesce(1)
    return placed.mapInArrow(run, (f"{_ddl(partials, keys)}, " if keys else "") + DIGEST)


def merge(partials: DataFrame, keys: Sequence[str], *, delta: int = DELTA, salts: int = 16, levels: int = 2, coarser: Sequence[dict[str, int]] = ()) -> DataFrame:
    """One digest per group of ``keys`` from partial digests of any making.

    The first level merges a group's partials in ``salts`` tasks, the second
    those: a group with a third of all partials never meets in one task whole.
    A task holds ``HELD_CENTROIDS`` at most; a group beyond is clustered where
    it stands. ``coarser`` lists key columns and the values they are set to: the
    groups' digests also come out merged, per task, under those keys.
    """
    keys = list(keys)
    if levels > 1:
        salted = partials.withColumn("_salt", F.pmod(F.xxhash64("n", "mean"), F.lit(salts)))
        partials = _merge_once(salted, keys, ["_salt"], delta)
    return _merge_once(partials, keys, [], delta, coarser)


def proven_bound(e: np.ndarray, rank: np.ndarray, n: np.ndarray, sizes: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How far at most the wanted rank lies outside the ranks of the estimates.

    A centroid whose least value is below the estimate and whose greatest isn't
    has between one and all but one of its values below it; the others are
    known. What is summed over the centroids holds for any order of merges.
    """
    first = np.cumsum(sizes) - sizes
    at = np.repeat(e, sizes)
    most_below = np.add.reduceat(np.where(lo < at, weight - (hi >= at), 0), first)
    least_upto = np.add.reduceat(np.where(hi <= at, weight, (lo <= at).astype(np.int64)), first)
    return np.maximum(np.maximum(most_below + 1 - rank, rank - least_upto), 0) / n


def percentiles(digests: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = QUANTILES, *, delta: int = DELTA) -> DataFrame:
    """One row per group: ``n``, ``exact`` (no centroid blurs its values), the
    estimates ``e0``, ``e1``... of the quantiles and their proven bounds ``x0``..."""
    keys = list(keys)
    size = range(len(quantiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            n, sizes = t["n"].to_numpy(), _sizes(t)
            _, weight, lo, hi = _unpack(t)
            out = t.select([*keys, "n"]).append_column("exact", pa.array(np.minimum.reduceat(lo == hi, np.cumsum(sizes) - sizes)))
            got = [estimates_at(q, n, sizes, weight, lo, hi) for q in quantiles]
            bounds = [proven_bound(e, ranks(q, n), n, sizes, weight, lo, hi) for q, e in zip(quantiles, got)]
            for name, x in [*((f"e{i}", got[i]) for i in size), *((f"x{i}", bounds[i]) for i in size)]:
                out = out.append_column(name, pa.array(x))
            yield from out.combine_chunks().to_batches()

    schema = (f"{_ddl(digests, keys)}, " if keys else "") + "n bigint, exact boolean" + "".join(f", e{i} double" for i in size) + "".join(f", x{i} double" for i in size)
    return digests.select(*keys, *VALUES).mapInArrow(run, schema)


#: Estimates go to every task of the counting pass up to so many groups (about 60 bytes each).
BROADCAST_GROUPS = 100_000


def key_hash(keys: Sequence[str | Column]) -> Column:
    """64 bits that stand for a group's key; null is a value like any other."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.xxhash64(*[x for c in cols for x in (c, c.isNull())]) if cols else F.lit(0).cast("bigint")


def certify(df: DataFrame, estimates: DataFrame, levels: Sequence[Column], value: str, of: Column) -> DataFrame:
    """Second counting pass: the exact rank error of each estimate, in one scan.

    ``levels`` are the key hashes (:func:`key_hash`) of the groups each row of
    ``df`` counts in, ``of`` that of each row of ``estimates``. Values less than
    and equal to the estimates are counted; ``r0``... is how far the wanted rank
    lies outside the ranks the estimate stands for, as a share of n. Exact
    digests need no count. Counts are reduced where rows are read; the estimates
    are sent to the tasks if there are at most ``BROADCAST_GROUPS`` inexact
    groups, else joined by their hash. Two groups with one hash (2**-64 a pair)
    are an error if both are counted.
    """
    size, n_levels = range(len(QUANTILES)), len(levels)
    estimates = estimates.withColumn("_h", of)
    wide = estimates.where("not exact").select("_h", *[f"e{i}" for i in size])
    held = wide.limit(BROADCAST_GROUPS + 1).toPandas()
    rows = df.select(F.col(value).cast("double").alias("_v"), *[h.alias(f"h{k}") for k, h in enumerate(levels)]).where("_v is not null and not isnan(_v)")
    counts = "_h bigint, " + ", ".join(f"b{i} bigint" for i in size) + ", " + ", ".join(f"a{i} bigint" for i in size)
    if len(held) <= BROADCAST_GROUPS:
        held = held.sort_values("_h")
        known, at = held["_h"].to_numpy(), held[[f"e{i}" for i in size]].to_numpy()
        if len(known) and (known[1:] == known[:-1]).any():
            raise ValueError("two groups have the same hash; certify them apart")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below, same = np.zeros((len(size), len(known)), np.int64), np.zeros((len(size), len(known)), np.int64)
            parts: list[pa.RecordBatch] = []

            def take() -> None:
                t = pa.Table.from_batches(parts)
                v = t["_v"].to_numpy()
                for k in range(n_levels):
                    code, uniq = pd.factorize(t[f"h{k}"].to_numpy())
                    spot = np.minimum(np.searchsorted(known, uniq), len(known) - 1)
                    g = np.where(known[spot] == uniq, spot, -1)[code]
                    mine = np.flatnonzero(g >= 0)
                    gs, vs = g[mine], v[mine]
                    for i in size:
                        e = at[gs, i]
                        below[i] += np.bincount(gs[vs < e], minlength=len(known))
                        same[i] += np.bincount(gs[vs == e], minlength=len(known))
                parts.clear()

            n = 0
            for b in batches:
                if b.num_rows and len(known):
                    parts.append(b)
                    n += b.num_rows
                if n >= FLUSH_ROWS:
                    take()
                    n = 0
            if parts:
                take()
            some = np.flatnonzero(below.any(axis=0) | same.any(axis=0))
            cols = {"_h": known[some]} | {f"b{i}": below[i][some] for i in size} | {f"a{i}": same[i][some] for i in size}
            yield pa.RecordBatch.from_pydict({k: pa.array(c, pa.int64()) for k, c in cols.items()})

        part = rows.mapInArrow(count, counts)
    else:
        each = rows.select("_v", F.explode(F.array(*[f"h{k}" for k in range(len(levels))])).alias("_h")).join(wide, "_h")
        part = each.select("_h", *[(F.col("_v") < F.col(f"e{i}")).cast("bigint").alias(f"b{i}") for i in size], *[(F.col("_v") == F.col(f"e{i}")).cast("bigint").alias(f"a{i}") for i in size])
    total = part.groupBy("_h").agg(*[F.sum(c).alias(c) for c in [f"{x}{i}" for x in "ba" for i in size]])
    error = {}
    for i, q in enumerate(QUANTILES):
        rank, b, a = F.greatest(F.ceil(F.lit(q) * F.col("n") - 1e-9), F.lit(1)), F.col(f"b{i}"), F.col(f"a{i}")
        off = F.greatest(b + (a > 0).cast("bigint") - rank, rank - b - a, F.lit(0))
        error[f"r{i}"] = F.when(F.col("exact"), 0.0).otherwise(off / F.col("n"))
    return estimates.join(total, "_h", "left").withColumns(error).drop("_h", *[f"{x}{i}" for x in "ba" for i in size])


def tall(wide: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """One row per group and quantile: ``quantile, n, estimate, error, bound``."""
    each = F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"e{i}").alias("estimate"), F.col(f"r{i}").alias("error"), F.col(f"x{i}").alias("bound")) for i, q in enumerate(QUANTILES)])
    return wide.select(*keys, "n", F.explode(each).alias("_q")).select("*", "_q.*").drop("_q")


def grouped(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Certified percentiles of ``value`` per group of ``keys``, in one go."""
    keys = list(keys)
    wide = cut(percentiles(merge(build(df, keys, value), keys), keys))
    return tall(certify(df, wide, [key_hash(keys)], value, key_hash(keys)), keys)


# The levels of the reports: what of (a, b, p) names a group. 3 is the finest.
NAME, PAIR, PERIOD, FINEST = 0, 1, 2, 3
KEYS = ["s", "l", "a", "b", "p"]
NEVER = -(1 << 62)
COLUMN_NAMES = ("metric_value", "p50_ms", "p99_ms")
DAY_SHIFT = 40
DAY_BASE = 1_000_000


def first_deliveries(log_metric: DataFrame) -> DataFrame:
    """Each metric row once, as fixed-width codes ``(s, a, b, p, v)``: of rows
    under the same ``metric_id`` the one of the first batch day counts (a
    missing day is before all), of several on that day one by a hash of the
    row; rows without an id are all kept.

    ``a`` and ``b`` stand for the name and for name and service, ``p`` is the
    day. Names aren't carried, so the aggregate is a hash aggregate that reduces
    copies where they are read. :func:`names` has the names of the codes.
    """
    service = F.col("labels")["service"]
    a, b = key_hash([F.lit("name"), "metric_name"]), key_hash([F.lit("pair"), "metric_name", service])
    day = F.coalesce(F.unix_date("batch_day") + DAY_BASE, F.lit(0)).cast("bigint")
    order = F.shiftleft(day, DAY_SHIFT) + F.shiftrightunsigned(F.xxhash64("ts", "metric_name", service, "metric_value"), 64 - DAY_SHIFT)
    rows = log_metric.select("metric_id", F.when(F.col("metric_id").isNull(), F.monotonically_increasing_id()).alias("k"), order.alias("o"), a.alias("a"), b.alias("b"), F.col("metric_value").alias("v"))
    once = rows.groupBy("metric_id", "k").agg(F.min("o").alias("o"), F.min_by("a", "o").alias("a"), F.min_by("b", "o").alias("b"), F.min_by("v", "o").alias("v"))
    p = F.shiftright("o", DAY_SHIFT)
    return once.select(F.lit(0).alias("s"), "a", "b", F.when(p == 0, NEVER).otherwise((p - DAY_BASE) * 86_400_000_000).alias("p"), "v").where("v is not null and not isnan(v)")


def endpoint_values(endpoint_latency: DataFrame) -> DataFrame:
    """The values of both columns per pattern and window, coded as the metrics;
    repeated rows of a (window, shard) count once."""
    once = endpoint_latency.groupBy("window_id", "endpoint_pattern", "window_start", "shard_name").agg(F.min("p50_ms").alias("p50_ms"), F.min("p99_ms").alias("p99_ms"))
    pair = F.array(F.struct(F.lit(1).alias("s"), F.col("p50_ms").alias("v")), F.struct(F.lit(2).alias("s"), F.col("p99_ms").alias("v")))
    rows = once.select(key_hash([F.lit("endpoint"), "endpoint_pattern"]).alias("a"), F.coalesce(F.unix_micros("window_start"), F.lit(NEVER)).alias("p"), F.explode(pair).alias("x"))
    return rows.select("x.s", "a", F.lit(0).cast("bigint").alias("b"), "p", "x.v").where("v is not null and not isnan(v)")


def names(log_metric: DataFrame, endpoint_latency: DataFrame) -> DataFrame:
    """``j`` (the code) with ``group_name`` and ``service``: one row per code.
    Two names with one code are an error, not a mixed group."""
    pairs = log_metric.select("metric_name", F.col("labels")["service"].alias("service")).distinct()
    two = F.array(F.struct(key_hash([F.lit("name"), "metric_name"]).alias("j"), F.lit(None).cast("string").alias("service")), F.struct(key_hash([F.lit("pair"), "metric_name", "service"]).alias("j"), F.col("service").alias("service")))
    rows = pairs.select(F.col("metric_name").alias("group_name"), F.explode(two).alias("x")).select("x.j", "group_name", "x.service")
    ends = endpoint_latency.select(key_hash([F.lit("endpoint"), "endpoint_pattern"]).alias("j"), F.col("endpoint_pattern").alias("group_name"), F.lit(None).cast("string").alias("service"))
    both = rows.unionByName(ends).distinct()
    one = both.groupBy("j").agg(F.min(F.struct("group_name", "service")).alias("x"), F.count(F.lit(1)).alias("k"))
    return one.select("j", F.when(F.col("k") > 1, F.raise_error(F.lit("two names have the same code"))).otherwise(F.col("x")).alias("x")).select("j", "x.*")


def all_percentiles(log_metric: DataFrame, endpoint_latency: DataFrame) -> DataFrame:
    """Percentiles of metric_value per name, and per name and service; of p50_ms
    and p99_ms per endpoint pattern; each per batch day or window and, from the
    periods' digests, for the whole time; certified.

    Null and NaN values are left out; a null name, service, pattern or period is
    one like any other. ``period`` and ``service`` are null in the levels
    without them. Empty tables give no rows.
    """
    rows = cut(first_deliveries(log_metric).unionByName(endpoint_values(endpoint_latency)))
    coarser = [{"l": NAME, "b": 0, "p": 0}, {"l": PAIR, "p": 0}, {"l": PERIOD, "b": 0}]
    periods = cut(merge(build(rows.withColumn("l", F.lit(FINEST)), KEYS, "v"), KEYS, levels=1, coarser=coarser))
    # an endpoint has no service: its finest level is also that per pattern and period
    wanted = periods.where(f"l < {FINEST} and (s = 0 or l = {NAME})")
    wide = cut(percentiles(merge(wanted, KEYS).unionByName(periods.where(f"l = {FINEST}")), KEYS))
    drop_cut(periods)
    one = lambda level, b, p: key_hash([F.col("s"), F.lit(level), F.col("a"), b, p])
    none = F.lit(0).cast("bigint")
    levels = [one(NAME, none, none), one(PAIR, F.col("b"), none), one(PERIOD, none, F.col("p")), one(FINEST, F.col("b"), F.col("p"))]
    sure = certify(rows, wide, levels, "v", key_hash(KEYS))
    named = sure.withColumn("j", F.when((F.col("s") == 0) & F.col("l").isin(PAIR, FINEST), F.col("b")).otherwise(F.col("a"))).join(names(log_metric, endpoint_latency), "j", "left")
    metric = {NAME: "metric_name", PAIR: "metric_name+service", PERIOD: "metric_name+batch_day", FINEST: "metric_name+service+batch_day"}
    level = F.when(F.col("s") > 0, F.when(F.col("l") == NAME, "endpoint_pattern").otherwise("endpoint_pattern+window"))
    for k, text in metric.items():
        level = level.when(F.col("l") == k, text)
    period = F.when(F.col("l").isin(PERIOD, FINEST) & (F.col("p") != NEVER), F.timestamp_micros("p"))
    keys = [F.get(F.array(*map(F.lit, COLUMN_NAMES)), F.col("s")).alias("column_name"), "group_name", "service", period.alias("period"), level.alias("level")]
    return tall(named, keys).select("column_name", "group_name", "service", "period", "level", "quantile", "n", "estimate", "error", "bound")
