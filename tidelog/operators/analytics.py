"""Log analytics: clustering, anomalies, correlation, trend, top-N, metrics."""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions import rx
from tidelog.model import BLOCK, is_error_analytics, label, row_index
from tidelog.runtime import cut, drop_cut, micros

LATENCY = r"(?i)(?:duration|latency|took|elapsed|time)[=: ]+(\d+(?:\.\d+)?)\s*(ms|s|us)"
# Name and pattern of the default metrics; group 1 is the value.
METRICS = (
    ("duration_ms", r"(?i)(?:duration|latency|elapsed|response_time|took)\s*[=:]\s*(\d+(?:\.\d+)?)\s*(?:ms|milliseconds?)?"),
    ("status_code", r"(?i)(?:status|status_code|http_status)\s*[=:]\s*(\d{3})"),
    ("bytes", r"(?i)(?:bytes|size|content_length|response_size)\s*[=:]\s*(\d+)"),
    ("count", r"(?i)(?:count|total|num_|items)\s*[=:]\s*(\d+)"),
)
INFINITE_FACTOR = 1.7976931348623157e308
WILD = "{*}"


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"[ \t\n\f\r=:]"), lambda x: x != "")


def similarity(pattern: Column, toks: Column) -> Column:
    """Share of positions that agree; ``{*}`` agrees with all; 0 for unequal lengths."""
    same = F.aggregate(F.zip_with(pattern, toks, lambda a, b: ((a == b) | (a == WILD)).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return F.when((F.size(pattern) == F.size(toks)) & (F.size(toks) > 0), same / F.size(toks)).otherwise(0.0)


class _Patterns:
    """Patterns of one token count, in order of creation."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.found: list[list] = []

    def take(self, toks: list[str], seq: int, line: str, ts) -> list:
        best, at = 0.0, None
        for k, p in enumerate(self.found):
            s = sum(a == b or a == WILD for a, b in zip(p[0], toks)) / len(toks)
            if s > best:
                best, at = s, k
        if at is not None and best >= self.threshold:
            p = self.found[at]
            p[0] = [a if a == b else WILD for a, b in zip(p[0], toks)]
            p[1] += 1
            p[2] = line
            p[4] = ts
            return p
        self.found.append([list(toks), 1, line, seq, ts])
        return self.found[-1]


def split(line: str) -> list[str]:
    """As :func:`tokens`, in Python."""
    for x in "\t\n\f\r=:":
        line = line.replace(x, " ")
    return [x for x in line.split(" ") if x]


class _Index:
    """As :class:`_Patterns`, without a look at every pattern.

    A pattern that agrees with a line throughout is looked up by its fixed
    tokens, once for each set of fixed positions; the most similar one is among
    those that hold a token of the line where the line has it, and the one with
    most wild positions. The first of equals wins in both.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.found: list[list[str]] = []
        self.wild: list[int] = []
        self.fixed: dict[tuple[int, ...], tuple[Callable, dict]] = {}
        self.holders: dict[tuple[int, str], set[int]] = {}
        self.widest = (0, 0)

    def add(self, toks: list[str]) -> int:
        self.found.append(toks)
        self.wild.append(0)
        self._enter(len(self.found) - 1)
        return len(self.found) - 1

    def _enter(self, k: int) -> None:
        toks = self.found[k]
        at = tuple(j for j, x in enumerate(toks) if x != WILD)
        if at not in self.fixed:
            self.fixed[at] = (itemgetter(*at) if at else lambda _: (), {})
        get, keys = self.fixed[at]
        insort(keys.setdefault(get(toks), []), k)
        for j in at:
            self.holders.setdefault((j, toks[j]), set()).add(k)
        self.wild[k] = len(toks) - len(at)
        self.widest = max(self.widest, (self.wild[k], -k))

    def _leave(self, k: int) -> None:
        toks = self.found[k]
        at = tuple(j for j, x in enumerate(toks) if x != WILD)
        get, keys = self.fixed[at]
        same = keys[get(toks)]
        same.remove(k)
        if not same:
            del keys[get(toks)]
        if not keys:
            del self.fixed[at]
        for j in at:
            self.holders[j, toks[j]].discard(k)

    def agreeing(self, toks: list[str]) -> int | None:
        """The first pattern that agrees with every token."""
        best = None
        for get, keys in self.fixed.values():
            same = keys.get(get(toks))
            if same and (best is None or same[0] < best):
                best = same[0]
        return best

    def take(self, toks: list[str]) -> tuple[int, bool]:
        """The pattern a line joins, and whether that made or changed it."""
        k = self.agreeing(toks)
        if k is not None:
            return k, False
        hits = Counter(k for j, x in enumerate(toks) for k in self.holders.get((j, x), ()))
        same, k = max([self.widest, *((n + self.wild[k], -k) for k, n in hits.items())])
        if same == 0 or same / len(toks) < self.threshold:
            return self.add(toks), True
        self._leave(-k)
        self.found[-k] = [a if a == b else WILD for a, b in zip(self.found[-k], toks)]
        self._enter(-k)
        return -k, True


# Lines, tallies of a pattern (k, no toks) and patterns (k, toks) of one token count.
_PARTS = pa.schema([("size", pa.int32()), ("k", pa.int64()), ("n", pa.int64()), ("first_seq", pa.int64()), ("seq", pa.int64()), ("line", pa.string()), ("us", pa.int64()), ("toks", pa.list_(pa.string())), ("changed", pa.bool_())])
_PARTS_DDL = "size int, k bigint, n bigint, first_seq bigint, seq bigint, line string, us bigint, toks array<string>, changed boolean"
HELD_ROWS = 10_000


def _parts(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), HELD_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + HELD_ROWS]), _PARTS)], schema=_PARTS)


def _later(seq: int | None, last: int | None) -> bool:
    return last is None or (seq is not None and seq >= last)


def _settle(rows: DataFrame, known: list, settled: set[tuple[int, int]], threshold: float) -> DataFrame:
    """Lines as tallies per task where the first of the ``known`` patterns that
    agrees with the whole line is ``settled``; the others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, _Index] = {}
        for size, _, toks in known:
            groups.setdefault(size, _Index(threshold)).add(toks)
        tallies: dict[tuple[int, int], list] = {}
        for b in batches:
            out = []
            for q, line, us in zip(*(c.to_pylist() for c in b.columns)):
                toks = split(line)
                size = len(toks)
                if not size:
                    continue
                at = (size, groups[size].agreeing(toks)) if size in groups else None
                if at not in settled:
                    out.append((size, None, 1, q, q, line, us, None, False))
                elif (t := tallies.get(at)) is None:
                    tallies[at] = [1, q, line, us]
                else:
                    t[0] += 1
                    if q >= t[1]:
                        t[1:] = q, line, us
            yield from _parts(out)
        yield from _parts([(*at, n, None, q, line, us, None, False) for at, (n, q, line, us) in tallies.items()])

    return rows.mapInArrow(run, _PARTS_DDL)


def _fold(parts: DataFrame, threshold: float) -> DataFrame:
    """The patterns after all ``parts``: those given come first, then lines in
    order, each token count in one task. ``changed``: given, and wider now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, facts, size = _Index(threshold), [], None

        def close() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(facts), HELD_ROWS):
                yield from _parts([(size, k, *facts[k][:5], held.found[k], facts[k][5]) for k in range(i, min(i + HELD_ROWS, len(facts)))])

        given = 0
        for b in batches:
            for s, k, n, first, q, line, us, toks, _ in zip(*(c.to_pylist() for c in b.columns)):
                if s != size:
                    yield from close()
                    held, facts, size, given = _Index(threshold), [], s, 0
                if toks is not None:
                    held.add(toks)
                    facts.append([n, first, q, line, us, False])
                    given += 1
                    continue
                new = False
                if k is None:
                    k, new = held.take(split(line))
                    if k == len(facts):
                        facts.append([n, first, q, line, us, False])
                        continue
                f = facts[k]
                f[0] += n
                f[5] = f[5] or (new and k < given)
                if _later(q, f[2]):
                    f[2:5] = q, line, us
        yield from close()

    pattern = F.col("toks").isNotNull()
    return parts.repartition("size").sortWithinPartitions("size", ~pattern, F.when(pattern, F.col("k")), "seq").mapInArrow(run, _PARTS_DDL)


def cluster(df: DataFrame, threshold: float = 0.4, head: int = BLOCK, least: int = 256) -> DataFrame:
    """Patterns of lines by greedy positional similarity in arrival order.

    A line joins the first pattern of its token count with the strictly highest
    similarity, if that reaches the threshold. A line that a pattern agrees with
    throughout changes nothing, and patterns only get wider. So the first
    ``head`` rows are folded; later lines that one of these patterns agrees with
    are counted where they are read, and only the others are folded, each token
    count in a task. Where an earlier pattern has got wider meanwhile, so that it
    may agree with lines counted for a later one, the lines of the later one are
    folded too, as are those of token counts with fewer than ``least`` rows in
    the head. The cap on patterns and its eviction belong to a bounded buffer
    and don't apply here: all patterns come out.
    """
    rows = df.where("line is not null").select("seq", "line", micros("ts").alias("us"))
    n, last = rows.select("seq").where("seq is not null").orderBy("seq").limit(head).agg(F.count("seq"), F.max("seq")).first()
    if n < head:
        return _shown(_fold(_settle(rows, [], set(), threshold), threshold))
    first = cut(_fold(_settle(rows.where(F.col("seq").isNull() | (F.col("seq") <= last)), [], set(), threshold), threshold))
    known = first.select("size", "k", "toks", F.sum("n").over(W.partitionBy("size")).alias("n")).orderBy("size", "k").collect()
    settled = {(p.size, p.k) for p in known if p.n >= least}
    given = [(p.size, p.k, p.toks) for p in known]
    while True:
        found = cut(_fold(first.union(_settle(rows.where(F.col("seq") > last), given, settled, threshold)), threshold))
        wider: dict[int, list] = {}
        for p in found.where("changed").select("size", "k", "toks").collect():
            wider.setdefault(p.size, []).append((p.k, p.toks))
        open_ = {(s, k) for s, k, toks in given if (s, k) in settled and any(j < k and all(a == b or WILD in (a, b) for a, b in zip(w, toks)) for j, w in wider.get(s, ()))}
        if not open_:
            drop_cut(first)
            return _shown(found)
        drop_cut(found)
        settled -= open_


def _shown(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("toks", " ").alias("template"), "n", F.col("line").alias("example"), "first_seq", F.timestamp_micros("us").alias("last_ts"))


BUFFER_ROWS = 50_000
MOST_PATTERNS = 1000


class _Bounded:
    """Patterns of all token counts, at most ``most``; room is made by dropping
    the one with fewest lines, the oldest of equals."""

    def __init__(self, threshold: float, most: int):
        self.threshold, self.most = threshold, most
        self.groups: dict[int, _Patterns] = {}
        self.total = 0
        self.lead: list | None = None

    def take(self, toks: list[str], seq: int, line: str, ts) -> None:
        group = self.groups.setdefault(len(toks), _Patterns(self.threshold))
        before = len(group.found)
        p = group.take(toks, seq, line, ts)
        if len(group.found) > before:
            self.total += 1
            if self.total > self.most:
                self._drop(p)
        if self.lead is None or (p[1], -p[3]) > (self.lead[1], -self.lead[3]):
            self.lead = p

    def _drop(self, newest: list) -> None:
        old, where = min(((p, g) for g in self.groups.values() for p in g.found if p is not newest), key=lambda x: (x[0][1], x[0][3]), default=(newest, None))
        if where is None:
            return
        where.found.remove(old)
        self.total -= 1
        if old is self.lead:
            self.lead = max((p for g in self.groups.values() for p in g.found), key=lambda p: (p[1], -p[3]))


def _in_order(df: DataFrame, buffer: int) -> DataFrame:
    """The newest ``buffer`` rows in one task, in order: a view's buffer, not the log."""
    newest = df.orderBy(F.desc("seq")).limit(buffer)
    rows = newest.select("seq", "line", "ts", tokens(F.col("line")).alias("toks")).where(F.size("toks") > 0)
    return rows.coalesce(1).sortWithinPartitions("seq")


def buffer_patterns(df: DataFrame, threshold: float = 0.4, most: int = MOST_PATTERNS, buffer: int = BUFFER_ROWS) -> DataFrame:
    """As :func:`cluster` over a bounded buffer with a cap on patterns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Bounded(threshold, most)
        for b in batches:
            for q, line, ts, toks in zip(b["seq"], b["line"], b["ts"], b["toks"]):
                held.take(list(toks), q, line, ts)
        yield pd.DataFrame([(" ".join(p[0]), *p[1:]) for g in held.groups.values() for p in g.found], columns=["template", "n", "example", "first_seq", "last_ts"])

    return _in_order(df, buffer).mapInPandas(run, "template string, n bigint, example string, first_seq bigint, last_ts timestamp")


def new_leading_patterns(df: DataFrame, threshold: float = 0.4, learning: int = 1000, most: int = MOST_PATTERNS, buffer: int = BUFFER_ROWS) -> DataFrame:
    """New patterns as a live view tells them (``top1``): after each row only the
    pattern with most lines is looked at, and told when its template, as it is
    then, wasn't seen in the first ``learning`` looks or later."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, known, looks, out = _Bounded(threshold, most), set(), 0, []
        for b in batches:
            for q, line, ts, toks in zip(b["seq"], b["line"], b["ts"], b["toks"]):
                held.take(list(toks), q, line, ts)
                template = " ".join(held.lead[0])
                looks += 1
                if template not in known:
                    known.add(template)
                    if looks > max(learning, 1):
                        out.append((template, held.lead[2], q, ts))
        yield pd.DataFrame(out, columns=["template", "example", "seq", "ts"])

    return _in_order(df, buffer).mapInPandas(run, "template string, example string, seq bigint, ts timestamp")


def new_cluster_patterns(df: DataFrame, threshold: float = 0.4, learning: int = 1000) -> DataFrame:
    """Patterns whose first line is number ``learning`` or later (at least 1)."""
    at = df.select(F.col("seq").alias("_at")).where("_at is not null").orderBy("_at").offset(max(learning, 1)).limit(1)
    return cluster(df, threshold).join(F.broadcast(at), F.col("first_seq") >= F.col("_at")).drop("_at")


def top_patterns(patterns: DataFrame, n: int = 20) -> DataFrame:
    return patterns.orderBy(F.desc("n"), "template").limit(n)


def volume_anomalies(df: DataFrame, tick_s: int = 1, window: int = 60, z: float = 3.0) -> DataFrame:
    """Ticks whose count is more than ``z`` deviations above the ticks before.

    Empty ticks count as 0. With no deviation a tick is reported (z infinite)
    if it is above twice the mean, or above a mean of 0. Ticks are few against
    rows: they are counted first, then windowed.
    """
    w = tick_s * 1_000_000
    got = df.where("ts is not null").groupBy(F.floor(F.unix_micros("ts") / w).alias("t")).agg(F.count(F.lit(1)).alias("actual"))
    # only ticks with rows can stand out; the empty ones before them count as 0 without being made
    before = W.orderBy("t").rangeBetween(-window, -1)
    some = got.withColumns({"k": F.least(F.col("t") - F.min("t").over(W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)), F.lit(window)), "s": F.coalesce(F.sum("actual").over(before), F.lit(0)), "ss": F.coalesce(F.sum(F.col("actual") * F.col("actual")).over(before), F.lit(0))}).where("k >= 2")
    m = some.withColumns({"expected": F.col("s") / F.col("k"), "sd": F.sqrt((F.col("k") * F.col("ss") - F.col("s") * F.col("s")).cast("double")) / F.col("k")})
    score = F.when(F.col("sd") > 0, (F.col("actual") - F.col("expected")) / F.nullif(F.col("sd"), F.lit(0.0))).when((F.col("actual") > 0) & ((F.col("expected") == 0) | (F.col("actual") > 2 * F.col("expected"))), F.lit(float("inf")))
    return m.withColumn("z", score).where(F.col("z") > z).select(F.timestamp_micros(F.col("t") * w).alias("tick"), "actual", "expected", "z")


def anomaly_text(actual: Column, expected: Column, z: Column) -> Column:
    return F.format_string("Volume spike: %.1fx above average (z-score: %.1f)", actual / F.greatest(expected, F.lit(1.0)), z)


def new_patterns(df: DataFrame, key: Column, learning: int = 1000) -> DataFrame:
    """First occurrences of keys after the learning phase: a key is new if its
    first row is number ``learning`` or later (at least 1)."""
    at = row_index(df.withColumn("_k", key), name="_i")
    return at.groupBy(F.col("_k").alias("template")).agg(F.min("_i").alias("i"), F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts")).where(F.col("i") >= max(learning, 1)).drop("i")


def error_correlation(df: DataFrame, baseline_min: float = 30, comparison_min: float = 5, top: int = 10) -> DataFrame:
    """Labels whose error rate changed most between the comparison window, which
    ends at the newest row, and the baseline before it. A baseline without
    errors gives the greatest double as factor. The label level is included."""
    end = df.agg(F.max("ts").alias("end"))
    us = F.unix_micros("ts") - F.unix_micros("end")
    c, b = int(comparison_min * 60_000_000), int((comparison_min + baseline_min) * 60_000_000)
    rows = df.withColumn("end", end.scalar()).where((us >= -b) & (us <= 0)).select((us >= -c).alias("now"), is_error_analytics().alias("err"), F.explode("labels").alias("label", "value"))
    n = lambda cond: F.count(F.when(cond, 1))
    g = rows.groupBy("label", "value").agg(n(F.col("now")).alias("ct"), n(F.col("now") & F.col("err")).alias("ce"), n(~F.col("now")).alias("bt"), n(~F.col("now") & F.col("err")).alias("be"))
    rate = lambda e, t: F.coalesce(F.try_divide(F.col(e).cast("double"), F.col(t)), F.lit(0.0))
    out = g.where("ce > 0").select("label", "value", rate("be", "bt").alias("baseline_rate"), rate("ce", "ct").alias("current_rate"))
    factor = F.when(F.col("baseline_rate") > 0, F.try_divide("current_rate", "baseline_rate")).otherwise(F.lit(INFINITE_FACTOR))
    return out.withColumn("factor", factor).orderBy(F.desc("factor"), "label", "value").limit(top)


def latency_ms(line: Column, pattern: str = LATENCY) -> Column:
    """The first latency in a line, in ms; null if there is none."""
    v, unit = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
    x = v.try_cast("double")
    return F.when(v != "", F.when(F.lower(unit) == "us", x / 1000).when(F.lower(unit) == "s", x * 1000).otherwise(x))


def endpoint_key(line: Column) -> Column:
    """The first three words that aren't made of digits, colons, dots, dashes, T and Z."""
    words = F.slice(F.filter(F.split(F.trim(line), r"\s+"), lambda t: ~t.rlike("^[0-9.:TZ-]*$")), 1, 3)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise("<unknown>")


def at_percentile(values: Column, p: int) -> Column:
    """Element floor((n-1)*p/100) of a sorted array."""
    return F.get(values, F.floor((F.size(values) - 1) * p / 100).cast("int"))


def slowest_endpoints(df: DataFrame, n: int = 10) -> DataFrame:
    """Endpoints by p95 latency, with p50, p99, max and count.

    Percentiles are exact: values are ranked in a window partitioned by
    endpoint, so a large endpoint spills instead of filling an array.
    """
    rows = df.select(endpoint_key(F.col("line")).alias("endpoint"), latency_ms(F.col("line")).alias("ms")).where("ms is not null")
    counts = rows.groupBy("endpoint", "ms").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("endpoint").orderBy("ms")
    cum = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(W.partitionBy("endpoint"))})
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p / 100), F.col("ms")))
    return cum.groupBy("endpoint").agg(at(50).alias("p50_ms"), at(95).alias("p95_ms"), at(99).alias("p99_ms"), F.max("ms").alias("max_ms"), F.sum("c").alias("n")).orderBy(F.desc("p95_ms"), "endpoint").limit(n)


def noisiest(df: DataFrame, key: str = "service", n: int = 10, errors_only: bool = False) -> DataFrame:
    """Label values by rows, with their percentage of all (or all error) rows."""
    rows = df.where(is_error_analytics()) if errors_only else df
    counted = rows.groupBy(label(key).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.where("value is not null").withColumn("total", total.scalar()).select("value", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct")).orderBy(F.desc("n"), "value").limit(n)


def trend_points(df: DataFrame, buckets: int = 30, width_s: int = 60) -> DataFrame:
    """Error ratio per non-empty bucket before the newest row; rows at the
    newest time itself fall beyond the last bucket and don't count."""
    w = width_s * 1_000_000
    end = df.agg(F.max("ts").alias("end"))
    us = F.unix_micros("ts") - (F.unix_micros("end") - buckets * w)
    at = F.when(us > -1_000_000, F.greatest(us, F.lit(0)))  # whole seconds are truncated towards zero
    i = F.floor(F.floor(at / 1_000_000) / width_s)
    rows = df.withColumn("end", end.scalar()).select(i.alias("i"), is_error_analytics().cast("int").alias("e")).where((F.col("i") >= 0) & (F.col("i") < buckets))
    return rows.groupBy("i").agg(F.avg("e").alias("ratio"), F.count(F.lit(1)).alias("n"))


def trend(df: DataFrame, buckets: int = 30, width_s: int = 60) -> DataFrame:
    """Least squares over the points, at most ``buckets`` of them: slope per
    minute, R² (0 for a constant ratio) and a sentence. No row below two points."""
    pts = trend_points(df, buckets, width_s).withColumn("x", F.row_number().over(W.orderBy("i")) - 1)
    fit = pts.agg(F.count(F.lit(1)).alias("points"), F.regr_slope("ratio", "x").alias("slope"), F.when(F.var_pop("ratio") == 0, 0.0).otherwise(F.regr_r2("ratio", "x")).alias("r2")).where("points >= 2")
    per_min = F.col("slope") / (width_s / 60)
    text = F.when(F.abs(per_min) < 0.001, "Error rate stable").otherwise(F.concat(F.lit("Error rate "), F.when(per_min > 0, "increasing").otherwise("decreasing"), F.format_string(": %+.1f%%/min (R²=%.2f)", per_min * 100, F.col("r2"))))
    return fit.withColumn("per_min", per_min).withColumn("text", text).withColumn("class", F.when(F.col("slope") > 0.001, "increasing").when(F.col("slope") < -0.001, "decreasing").otherwise("stable"))


def extract_metrics(df: DataFrame, extra: tuple[tuple[str, str, str | int], ...] = ()) -> DataFrame:
    """Metrics named by pattern, first match of each; ``extra`` adds (name,
    pattern, group). Values keep the unit they are written in."""
    cols = [F.struct(F.lit(n).alias("name"), F.regexp_extract("line", p, 1).alias("v")) for n, p in METRICS]
    for n, p, g in extra:
        r = rx.to_java(p)
        if r is None:
            raise ValueError(f"invalid metric pattern: {p}")
        cols.append(F.struct(F.lit(n).alias("name"), F.regexp_extract("line", r.java, dict(r.names).get(g, g)).alias("v")))
    return df.select("seq", "ts", "labels", F.explode(F.filter(F.array(*cols), lambda x: x["v"] != "")).alias("m")).select("seq", "ts", "labels", F.col("m.name").alias("name"), F.col("m.v").try_cast("double").alias("value")).where("value is not null")


def json_metrics(df: DataFrame) -> DataFrame:
    """Numeric top-level members of JSON object lines."""
    rows = df.where(F.ltrim("line").startswith("{")).select("seq", "ts", F.try_parse_json(F.trim("line")).alias("v")).where("v is not null")
    each = rows.select("seq", "ts", F.explode(F.from_json(F.to_json("v"), "map<string,string>")).alias("name", "text"))
    return each.where(F.col("text").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")).join(_numeric(rows), ["seq", "name"], "left_semi").select("seq", "ts", "name", F.col("text").cast("double").alias("value"))


def _numeric(rows: DataFrame) -> DataFrame:
    """(seq, name) of members whose JSON value is a number, not text that looks like one."""
    from pyspark.sql.functions import expr

    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer())).where(expr("schema_of_variant(value) rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)'")).select("seq", F.col("key").alias("name"))


def snapshot(df: DataFrame) -> dict[str, DataFrame]:
    """All reports over one buffer of rows."""
    return {
        "patterns": top_patterns(cluster(df)),
        "anomalies": volume_anomalies(df),
        "new_patterns": new_cluster_patterns(df),
        "correlation": error_correlation(df),
        "trend": trend(df),
        "slowest": slowest_endpoints(df),
        "noisiest": noisiest(df),
    }


def live_dashboard(df: DataFrame, every: str = "1 second") -> DataFrame:
    """Requests, errors, latency percentiles and status classes per window. The
    percentiles are approximate (one in 10,000 ranks), as streams need them;
    :func:`slowest_endpoints` has exact ones."""
    status = F.regexp_extract("line", r"(?:^|[ =])([2-5])\d\d(?: |$)", 1)
    rows = df.select("ts", is_error_analytics().cast("int").alias("e"), latency_ms(F.col("line")).alias("ms"), status.alias("s"))
    return rows.groupBy(F.window("ts", every).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("e").alias("errors"), F.avg("e").alias("error_ratio"),
        F.percentile_approx("ms", 0.5).alias("p50_ms"), F.percentile_approx("ms", 0.95).alias("p95_ms"), F.percentile_approx("ms", 0.99).alias("p99_ms"),
        *[F.count(F.when(F.col("s") == k, 1)).alias(f"status_{k}xx") for k in "2345"],
    ).select(F.col("w.start").alias("start"), "*").drop("w")


def dashboard_endpoints(df: DataFrame, every: str = "1 second", n: int = 5) -> DataFrame:
    """The ``n`` endpoints of each window with most rows, ties by name, with
    their rows and slowest answer. Rows are counted per window and endpoint before any order."""
    rows = df.select(F.window("ts", every)["start"].alias("start"), endpoint_key(F.col("line")).alias("endpoint"), latency_ms(F.col("line")).alias("ms")).where("ms is not null")
    g = rows.groupBy("start", "endpoint").agg(F.count(F.lit(1)).alias("requests"), F.max("ms").alias("max_ms"))
    rank = F.row_number().over(W.partitionBy("start").orderBy(F.desc("requests"), "endpoint"))
    return g.withColumn("place", rank).where(F.col("place") <= n)
