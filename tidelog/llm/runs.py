"""Runs of the same or nearly the same consecutive event, collapsed (problem 4).

Adjacent agglomeration: the events of an entity form a linked list of runs; a
priority queue over neighbouring pairs repeatedly merges the most similar pair
until no pair meets the similarity and the gap limit. Entities are cut into
blocks of consecutive sequence numbers, so a hot stream is worked on by many
tasks; runs at block borders are then joined over a few rows per block. Equal
neighbours always merge first, so near-equal ones are looked for among the runs
of equal ones, and only inside chains of touching runs that are similar.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators import entries as E
from tidelog.operators import templates as T
from tidelog.runtime import cut, drop_cut

BLOCK = 1 << 18
REPEATED = r"(?:^|[ :])(?:last )?message repeated (\d{1,15}) times(?::? *\[ .*\])?\s*$"
TIMES = r"\d{1,2}/[a-z]{3}/\d{4}:\d\d:\d\d:\d\d(?: [+-]\d{4})?|[adfjmnos](?:an|eb|ar|pr|ay|un|ul|ug|ep|ct|ov|ec) +\d{1,2} \d\d:\d\d:\d\d"
UNITS = r"# ?(?:ns|us|µs|ms|s|secs?|seconds?|min|mins|minutes?|h|hours?|bytes|[kmgt]?i?b)\b"


def constant_text(line: Column) -> Column:
    """What stays of a line from one emission to the next: lower case, single
    spaces, no colour codes, and ``#`` for times, numbers with or without unit,
    addresses and identifiers that hold a digit."""
    c = F.lower(T.plain(line))
    c = F.regexp_replace(c, TIMES, "#")
    c = F.regexp_replace(c, r"(?<![\w])[+-]?(?:[a-z_][a-z_.@-]*+)?\d[\w.:+@-]*%?", "#")
    c = F.regexp_replace(c, r"#(?:,#)+", "#")
    c = F.regexp_replace(c, UNITS, "#")
    return F.trim(F.regexp_replace(c, r"\s\s+|[\t\r\n]", " "))


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def agglomerate(events: list[tuple], min_similarity: float, max_gap: int | None) -> list[list]:
    """Runs of one block: ``events`` are (id, key, tokens, weight, first, last, repeat).

    Equal keys have similarity 1; else the Jaccard similarity of the tokens
    counts. A repeat report (key None) belongs to the run before it. Pairs are
    merged in order of similarity, the leftmost first among equals; a merged run
    is represented by the tokens of its first event.
    """
    runs: list[list] = []  # key, tokens, first id, last id, weight, first time, last time, has key
    for i, key, toks, weight, first, last, rep in events:
        if rep and runs:
            r = runs[-1]
            r[3], r[4], r[5], r[6] = i, r[4] + weight, min(r[5], first), max(r[6], last)
        else:
            runs.append([None if rep else key, toks, i, i, weight, first, last])
    n = len(runs)
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def similarity(a: int, b: int) -> float:
        x, y = runs[a], runs[b]
        if x[0] is None or y[0] is None or (max_gap is not None and y[5] - x[6] > max_gap):
            return 0.0
        if x[0] == y[0]:
            return 1.0
        return jaccard(x[1], y[1]) if x[1] is not None and y[1] is not None else 0.0

    heap = [(-s, a, a + 1, 0) for a in range(n - 1) if (s := similarity(a, a + 1)) >= min_similarity]
    heapq.heapify(heap)
    stamp = [0] * n
    while heap:
        _, a, b, seen = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or right[a] != b or stamp[a] + stamp[b] != seen:
            continue
        x, y = runs[a], runs[b]
        x[3], x[4], x[5], x[6] = y[3], x[4] + y[4], min(x[5], y[5]), max(x[6], y[6])
        alive[b] = False
        right[a] = right[b]
        if right[a] < n:
            left[right[a]] = a
        stamp[a] += 1
        for p, q in ((left[a], a), (a, right[a])):
            if p >= 0 and q < n and (s := similarity(p, q)) >= min_similarity:
                heapq.heappush(heap, (-s, p, q, stamp[p] + stamp[q]))
    return [r for r, ok in zip(runs, alive) if ok]


RUN = "source_table string, stream string, block bigint, run int, side int, key bigint, toks array<bigint>, first_id bigint, last_id bigint, event_count bigint, first_us bigint, last_us bigint"


def collapse(events: DataFrame, *, max_gap_us: int | None = None, block: int = BLOCK, singles: bool = False) -> DataFrame:
    """One row per maximal run of equal events: first and last id, count, first and last time.

    ``events``: source_table, stream, id (unique order within the stream), key
    (equal keys are the same event; any type, compared by 64 bits), toks
    (array<bigint> or null; with ``singles`` those of the first event are carried), weight, first_us, last_us, repeat (a report that the
    event before was repeated ``weight`` times; it has no key of its own).

    Block borders: the first and last run of each block go on to one pass per
    stream, where neighbours with equal keys within the gap limit become one;
    the result is that of the unbroken stream. A repeat report with no event
    before it in its stream is left out. Null weights count as 1, null keys
    never match, null times as no gap. Runs of one event worth 1 may be missing
    unless ``singles`` is set.
    """
    names = [x.split()[0] for x in RUN.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        # objects: a column of keys with gaps would else become floats and lose digits
        return pd.DataFrame(rows, columns=names, dtype=object)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        at = None
        out: list[tuple] = []

        def close() -> None:
            runs = agglomerate(held, 1.0, max_gap_us)
            n = len(runs)
            head = 2 if n > 1 and runs[0][0] is None else 1
            for k, r in enumerate(runs):
                side = 1 if k < head or k == n - 1 else 0
                if side or singles or r[4] > 1:
                    out.append((*at, k, side, r[0], None if r[1] is None else list(r[1]), r[2], r[3], r[4], r[5], r[6]))

        for b in batches:
            tokens = b["toks"] if singles else [None] * len(b)
            for s, st, bl, i, key, weight, first, last, rep, toks in zip(b["source_table"], b["stream"], b["block"], b["id"], b["key"], b["weight"], b["first_us"], b["last_us"], b["repeat"], tokens):
                if at != (s, st, bl):
                    if held:
                        close()
                        held = []
                    at = (s, st, bl)
                held.append((i, key, frozenset(toks) if toks is not None else None, weight, first, last, rep))
            if len(out) > 20_000:
                yield frame(out)
                out.clear()
        if held:
            close()
        yield frame(out)

    ready = events.select(
        "source_table", "stream", F.floor(F.col("id") / block).alias("block"), "id",
        F.when(F.col("key").isNull(), F.xxhash64(F.lit("lone"), "id")).otherwise(F.xxhash64("key")).alias("key"),
        F.coalesce("weight", F.lit(1)).cast("bigint").alias("weight"), F.coalesce("first_us", F.lit(0)).alias("first_us"), F.coalesce("last_us", "first_us", F.lit(0)).alias("last_us"), F.coalesce("repeat", F.lit(False)).alias("repeat"),
        *(["toks"] if singles else []),
    )
    blocks = ready.repartition("source_table", "stream", "block").sortWithinPartitions("source_table", "stream", "block", "id")
    runs = cut(blocks.mapInPandas(work, RUN))  # read twice below
    w = W.partitionBy("source_table", "stream").orderBy("block", "run")
    sides = runs.where("side = 1").withColumn("eff", F.last("key", ignorenulls=True).over(w))
    prev = F.lag("eff").over(w)
    near = F.lit(True) if max_gap_us is None else (F.col("first_us") - F.lag("last_us").over(w) <= max_gap_us)
    joined = F.col("key").isNull() | ((prev == F.col("eff")) & ((F.lag("block").over(w) != F.col("block")) | F.lag("key").over(w).isNull()) & near)
    sides = sides.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    merged = sides.where("eff is not null").groupBy("source_table", "stream", "g").agg(
        F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("event_count").alias("event_count"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.min_by("toks", "first_id").alias("toks"),
    )
    cols = ["source_table", "stream", "first_id", "last_id", "event_count", "first_us", "last_us", "toks"]
    return runs.where("side = 0").select(cols).unionByName(merged.select(cols))


#: Runs of equal events in one chain; it is held by one task (about 500 bytes each).
MAX_CHAIN = 1_000_000
CHAIN = "source_table string, stream string, first_id bigint, last_id bigint, event_count bigint, first_us bigint, last_us bigint, n_kinds int"


def jaccard_column(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def collapse_similar(events: DataFrame, *, min_similarity: float, max_gap_us: int | None = None, block: int = BLOCK) -> DataFrame:
    """Runs of equal or nearly equal events, as :func:`collapse`, with ``n_kinds``, how many different neighbours were merged.

    Equal neighbours merge before all others, so the runs of equal events come
    first. Two runs may merge only while the events that touch are at least
    ``min_similarity`` alike (Jaccard of ``toks``) and at most ``max_gap_us``
    apart: that depends on the two alone, so a stream falls into chains that
    never merge with each other. In each chain the priority queue merges the
    most similar neighbours, the leftmost first among equals, while the first
    events of both are similar enough. The result doesn't depend on ``block``.
    A chain beyond ``MAX_CHAIN`` runs is an error, not cut. Null ``toks`` are
    like nothing but equal keys.
    """
    runs = cut(collapse(events, max_gap_us=max_gap_us, block=block, singles=True).withColumn("_b", F.floor(F.col("first_id") / block)))
    key = ["source_table", "stream"]
    here, over = W.partitionBy(*key, "_b").orderBy("first_id"), W.partitionBy(*key).orderBy("_b")
    tail = runs.groupBy(*key, "_b").agg(F.max_by(F.struct("toks", "last_us"), "first_id").alias("_t"))
    tail = tail.withColumn("_before", F.lag("_t").over(over)).drop("_t")
    before = F.coalesce(F.lag(F.struct("toks", "last_us")).over(here), F.col("_before"))
    near = F.lit(True) if max_gap_us is None else F.coalesce(F.col("first_us") - F.col("_p.last_us") <= max_gap_us, F.lit(True))
    alike = F.coalesce(jaccard_column(F.col("_p.toks"), F.col("toks")) >= min_similarity, F.lit(False)) & F.col("_p.toks").isNotNull() & F.col("toks").isNotNull()
    linked = cut(runs.join(tail, [*key, "_b"]).withColumn("_p", before).withColumn("_start", F.when(~(alike & near), F.col("first_id"))).drop("_before", "_p"))
    drop_cut(runs)
    # the chain of a row: the last start up to it, in its block or an earlier one
    ends = linked.groupBy(*key, "_b").agg(F.max("_start").alias("_s")).withColumn("_carry", F.max("_s").over(over.rowsBetween(W.unboundedPreceding, -1))).drop("_s")
    chain = linked.join(ends, [*key, "_b"]).withColumn("chain", F.coalesce(F.max("_start").over(here.rowsBetween(W.unboundedPreceding, W.currentRow)), F.col("_carry")))
    names = [x.split()[0] for x in CHAIN.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        at = None
        out: list[tuple] = []

        def close() -> None:
            if len(held) > MAX_CHAIN:
                raise ValueError(f"a chain of more than {MAX_CHAIN} similar neighbours; raise the similarity or set a gap limit")
            kinds = iter(held)
            for r in agglomerate([(i, None if toks is None else toks, toks, n, a, b, False) for i, _, n, a, b, toks in held], min_similarity, None):
                mine = [next(kinds)]
                while mine[-1][0] != r[3]:
                    mine.append(next(kinds))
                out.append((*at[:2], r[2], mine[-1][1], r[4], r[5], r[6], len(mine)))

        for b in batches:
            for s, st, c, i, last, n, t0, t1, toks in zip(b["source_table"], b["stream"], b["chain"], b["first_id"], b["last_id"], b["event_count"], b["first_us"], b["last_us"], b["toks"]):
                if at != (s, st, c):
                    if held:
                        close()
                        held = []
                    at = (s, st, c)
                held.append((i, last, n, t0, t1, None if toks is None else frozenset(toks)))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        if held:
            close()
        yield pd.DataFrame(out, columns=names)

    placed = chain.select(*key, "chain", "first_id", "last_id", "event_count", "first_us", "last_us", "toks").repartition(*key, "chain").sortWithinPartitions(*key, "chain", "first_id")
    return placed.mapInPandas(work, CHAIN)


def words(line: Column) -> Column:
    """The distinct words of a line's constant text, as hashes."""
    return F.array_distinct(F.transform(F.split(constant_text(line), " "), lambda x: F.xxhash64(x)))


def log_events(log_entry: DataFrame, *, times: bool = True, tokens: bool = False) -> DataFrame:
    """log_entry's entries as events, whole texts compared by a digest.

    The time of an event is the one its header states; with ``times`` off, for
    callers that have no use for it, the row's. ``tokens`` adds the words of the
    entry's first line.
    """
    lines = E.log_lines(log_entry)
    parsed = E.parse_headers(lines, T.layouts(lines, "line"), times=times)
    told = F.try_to_number(F.regexp_extract(F.lower("line"), REPEATED, 1), F.lit("999999999999999"))
    rep = F.when(F.contains(F.col("line"), F.lit("repeated")), told)
    text = F.concat(F.lit("k"), constant_text(F.col("line")))
    toks = words(F.col("line")) if tokens else F.lit(None).cast("array<bigint>")
    both = E.group_entries(parsed.withColumn("component", F.struct("component", rep.alias("k"), *([toks.alias("t")] if tokens else []))), text=text)
    k = F.when(F.col("n_lines") == 1, F.col("component.k"))
    return both.select(
        "source_table", "stream", F.col("row_id").alias("id"),
        F.xxhash64("log_level", "component.component", "n_lines", "d0", "d1").alias("key"),
        (F.col("component.t") if tokens else toks).alias("toks"), F.coalesce(k, F.lit(1)).cast("bigint").alias("weight"),
        F.col("event_us").alias("first_us"), F.col("event_us").alias("last_us"), k.isNotNull().alias("repeat"),
    )


def relay_events(dedup_group: DataFrame, *, tokens: bool = False) -> DataFrame:
    """dedup_group's rows as events, each worth its event_count, from its first
    to its last time (a missing one is the other)."""
    rows = dedup_group.select(F.lit("dedup_group").alias("source_table"), F.coalesce("stream_name", F.lit("")).alias("stream"), F.col("group_id").alias("id"), F.coalesce("line", F.lit("")).alias("line"), F.unix_micros(F.coalesce("first_ts", "last_ts")).alias("ts_us"), F.unix_micros(F.coalesce("last_ts", "first_ts")).alias("last_us"), F.col("event_count").alias("weight"))
    parsed = E.parse_headers(rows, T.layouts(rows, "line"), times=False)
    return parsed.select(
        "source_table", "stream", "id",
        F.xxhash64("log_level", "component", constant_text(F.col("line"))).alias("key"),
        (words(F.col("line")) if tokens else F.lit(None).cast("array<bigint>")).alias("toks"), "weight", F.col("ts_us").alias("first_us"), "last_us", F.lit(False).alias("repeat"),
    )


def found_runs(log_entry: DataFrame, dedup_group: DataFrame, *, times: bool = True) -> DataFrame:
    """Maximal runs of two or more events in both tables, with first and last time."""
    events = log_events(log_entry, times=times).unionByName(relay_events(dedup_group))
    return collapse(events).where("event_count > 1").drop("toks")


def similar_runs(log_entry: DataFrame, dedup_group: DataFrame, *, min_similarity: float = 0.7, max_gap_us: int = 600_000_000) -> DataFrame:
    """Runs of two or more equal or nearly equal events in both tables."""
    events = log_events(log_entry, tokens=True).unionByName(relay_events(dedup_group, tokens=True))
    return collapse_similar(events, min_similarity=min_similarity, max_gap_us=max_gap_us).where("event_count > 1")
