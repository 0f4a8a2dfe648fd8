"""Physical lines into entries with time, level, component and message (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators import templates as T

#: Rows of one stream are ordered per block of so many sequence numbers; no task sorts a whole stream.
BLOCK = 65_536
DAY = 86_400_000_000
P = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)
SEP = "\x01"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def log_lines(df: DataFrame) -> DataFrame:
    """log_entry as lines: one physical line per row, in ``seq`` order within its stream."""
    return df.select(F.lit("log_entry").alias("source_table"), F.coalesce(F.col("labels")["stream"], F.lit("")).alias("stream"), F.col("seq").alias("row_id"), F.lit(0).alias("line_no"), F.unix_micros("ts").alias("ts_us"), F.coalesce("line", F.lit("")).alias("line"))


def grouped_lines(df: DataFrame) -> DataFrame:
    """grouped_entry as lines: ``line`` is number 0, continuation line n is number n."""
    all_lines = F.concat(F.array(F.coalesce("line", F.lit(""))), F.coalesce("continuation_lines", F.array().cast("array<string>")))
    return df.select(F.coalesce(F.col("labels")["stream"], F.lit("")).alias("stream"), F.col("group_id").alias("row_id"), F.unix_micros("ts").alias("ts_us"), F.posexplode(all_lines).alias("line_no", "line")).select(
        F.lit("grouped_entry").alias("source_table"), "stream", "row_id", "line_no", "ts_us", F.coalesce("line", F.lit("")).alias("line")
    )


def _stamp(text: Column) -> Column:
    """Micros of ``YYYY-MM-DDThh:mm:ss[.f][zone]``; UTC where no zone is given."""
    sign = lambda back: F.substring(text, -back, 1).isin("+", "-")
    zoned = F.when((F.right(text, F.lit(1)) == "Z") | sign(6) | sign(5), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def _month(name: Column) -> Column:
    return F.lpad((F.floor((F.instr(F.lit(MONTHS), name) + 2) / 3)).cast("string"), 2, "0")


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it's used."""
    return F.transform(F.array(value), body)[0]


def _nearest(cands: list[Column], ts: Column) -> Column:
    """The candidate nearest to ``ts``, the earlier one of two as near."""
    best = F.array_min(F.array(*[F.when(c.isNotNull(), F.struct(F.abs(c - ts).alias("d"), c.alias("c"))) for c in cands]))
    return best["c"]


def stated_time(kind: Column, text: Column, ts: Column) -> Column:
    """Epoch micros of a header's time text by its format; what is missing of
    the date is chosen nearest to ``ts``. Null if it isn't a time."""
    dots = F.translate(text, ",", ".")
    iso = F.translate(F.translate(dots, "/", "-"), " ", "T")
    day_of = F.substring_index(text, "/", 1)
    full = F.when(F.substring(text, -5, 1).isin("+", "-"), text).otherwise(F.concat(text, F.lit(" +0000")))
    after = F.substring(full, -(len("Mar/2025:00:00:00 +0000")), 100)  # all but the day has one width
    clf = F.concat(F.substring(after, 5, 4), F.lit("-"), _month(F.substring(after, 1, 3)), F.lit("-"), F.lpad(day_of, 2, "0"), F.lit("T"), F.substring(after, 10, 8), F.substring(after, 19, 5))
    year = F.year(F.timestamp_micros(ts))
    bsd_tail = F.concat(F.lit("-"), _month(F.substring(text, 1, 3)), F.lit("-"), F.lpad(F.trim(F.substring(F.regexp_replace(text, "  +", " "), 5, 2)), 2, "0"), F.lit("T"), F.substring_index(text, " ", -1))
    compact_tail = F.concat(F.lit("-"), F.substring(text, 1, 2), F.lit("-"), F.substring(text, 3, 2), F.lit("T"), F.substring(dots, 6, 20))

    def yearly(tail: Column) -> Column:
        # the row's own year first; another one only if that is half a year off or no date at all
        same = _stamp(F.concat(year.cast("string"), tail))
        far = _nearest([_stamp(F.concat((year + k).cast("string"), tail)) for k in (-1, 0, 1)], ts)
        return bind(same, lambda x: F.when(F.abs(x - ts) < 180 * DAY, x).otherwise(far))

    clock = _stamp(F.concat(F.lit("1970-01-01T"), dots))
    day = F.floor(ts / DAY) * DAY
    return (
        F.when(kind.isin(T.ISO, T.SLASH), _stamp(iso))
        .when(kind == T.CLF, _stamp(clf))
        .when(kind == T.BSD, yearly(bsd_tail))
        .when(kind == T.COMPACT, yearly(compact_tail))
        .when(kind == T.MILLIS, text.try_cast("bigint") * 1000)
        .when(kind == T.SECONDS, (text.try_cast("decimal(20,6)") * 1_000_000).cast("bigint"))
        .when(kind == T.CLOCK, bind(day + clock, lambda x: F.when(ts - x > DAY // 2, x + DAY).when(ts - x <= -(DAY // 2), x - DAY).otherwise(x)))
    )


def stated_level(text: Column) -> Column:
    """One of trace, debug, info, warn, error, fatal; '' where none is stated."""
    words: dict[str, list[str]] = {}
    for w, to in T.LEVELS.items():
        words.setdefault(to, []).append(w)
    low = F.lower(text)
    out = F.when(low.isNull(), "")
    for to, ws in words.items():
        out = out.when(low.isin(ws), to)
    return out.otherwise("")


def parse_headers(lines: DataFrame, layouts: list[T.Layout], *, line: str = "line", ts_us: str = "ts_us", times: bool = True) -> DataFrame:
    """Add ``is_head``, ``event_us``, ``log_level``, ``component`` to each line.

    One pass of built-in regular expressions, tried where a line may be of a
    layout; the first that matches counts. ``event_us`` of a header without a (valid) time is the row's own;
    with ``times`` off it is for all, for callers that go by the rows' times.
    """
    clean = lines.withColumn("_p", T.plain(F.col(line)))

    def read(s: Column) -> Column:
        """``SEP layout SEP time SEP level SEP component`` of the first layout
        that matches: a replacement that leaves other lines as they are."""
        tries = []
        for i, lay in enumerate(layouts):
            groups = SEP.join(f"${g}" if g else "" for g in (lay.time, lay.level, lay.component))
            text = F.regexp_replace(s["p"], lay.regex + "(?s:.*)$", f"{SEP}{i}{SEP}{groups}")
            tries.append(F.when(lay.may_head(s["p"]), bind(text, lambda x: F.when(x.startswith(SEP), x))))
        return F.coalesce(*tries) if tries else F.lit(None).cast("string")

    clean = clean.withColumn("_f", F.split(fence([F.col("_p").alias("p")], read), SEP))
    get = lambda i: F.nullif(F.get("_f", F.lit(i + 1)), F.lit(""))
    kind = F.get(F.array(*[F.lit(x.kind) for x in layouts]) if layouts else F.array().cast("array<string>"), get(0).cast("int"))
    clean = clean.withColumns({"_k": kind, "_t": get(1)})
    when = fence([F.col("_k").alias("k"), F.col("_t").alias("t"), F.col(ts_us).alias("ts")], lambda s: stated_time(s["k"], s["t"], s["ts"]))
    return clean.withColumns({
        "is_head": F.col("_f").isNotNull(), "event_us": F.coalesce(F.when(F.col("_t").isNotNull(), when), F.col(ts_us)) if times else F.col(ts_us), "log_level": stated_level(get(2)), "component": F.coalesce(get(3), F.lit("")),
    }).drop("_p", "_f", "_k", "_t")


def fence(inputs: list[Column], body) -> Column:
    """``body`` over a struct of ``inputs``, outside whole-stage code.

    A branch for each layout makes more code than one JVM method may hold; as
    the body of a higher-order function it is evaluated beside the generated
    code, which stays whole for everything around it.
    """
    return F.transform(F.array(F.struct(*inputs)), lambda s: body(s))[0]


def _power(base: int, k: Column) -> Column:
    """``base ** k`` modulo P for k below 2**40, from tables of 32 powers.

    Most lines stand near their head, so one look-up does; the further tables
    are only consulted beyond.
    """
    at = lambda j: F.get(F.array(*[F.lit(pow(base, i << (5 * j), P)).cast("bigint") for i in range(32)]), F.shiftrightunsigned(k, 5 * j).bitwiseAND(F.lit(31)).cast("int"))
    out = at(0)
    for j in range(1, 8):
        out = out * at(j) % P
    return F.when(k < 32, at(0)).otherwise(out)


def group_entries(parsed: DataFrame, *, text: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row per entry: its head's fields, ``n_lines`` and, with ``text``, a digest of all its lines.

    Two levels. Within (stream, block of sequence numbers) a running count of
    heads numbers the segments; a segment that an earlier block's entry runs
    into, and the last one of each block, are then joined per stream, over two
    rows a block. So a stream with a third of all rows is sorted in pieces.

    The digest is a polynomial in the line hashes modulo two primes' powers; it
    adds up over segments by shifting with the number of lines before.
    Lines before the first head of a stream belong to no entry and are left out.
    """
    keys = ["source_table", "stream", "block"]
    narrow = parsed.select("source_table", "stream", F.floor(F.col("row_id") / block).alias("block"), "row_id", "line_no", F.col("is_head").cast("int").alias("head"), F.when(F.col("is_head"), F.struct("row_id", "line_no", "event_us", "log_level", "component")).alias("f"), *([F.xxhash64(text).alias("x")] if text is not None else []))
    w = W.partitionBy(*keys).orderBy("row_id", "line_no")
    seg = narrow.withColumn("hid", F.sum("head").over(w))
    aggs = [F.count(F.lit(1)).alias("n"), F.min("f").alias("f")]
    if text is not None:
        seg = seg.withColumn("rn", F.row_number().over(w).cast("bigint"))
        seg = seg.withColumn("j", F.col("rn") - F.coalesce(F.max(F.when(F.col("head") == 1, F.col("rn"))).over(w), F.lit(1).cast("bigint")))
        parts = (F.pmod(F.col("x"), F.lit(P)), F.pmod(F.shiftright("x", 31), F.lit(P)))
        aggs += [(F.sum(p * _power(b, F.col("j")) % P) % P).alias(f"d{i}") for i, (b, p) in enumerate(zip(BASES, parts))]
    seg = seg.groupBy(*keys, "hid").agg(*aggs)
    seg = seg.withColumn("edge", (F.col("hid") == 0) | (F.col("hid") == F.max("hid").over(W.partitionBy(*keys))))
    digests = ["d0", "d1"] if text is not None else []
    inner = seg.where("not edge").select("source_table", "stream", "f", "n", *digests)
    v = W.partitionBy("source_table", "stream").orderBy("block", "hid")
    edge = seg.where("edge").withColumn("gid", F.sum((F.col("hid") > 0).cast("int")).over(v))
    aggs = [F.min("f").alias("f"), F.sum("n").alias("n")]
    if text is not None:
        u = W.partitionBy("source_table", "stream", "gid").orderBy("block", "hid").rowsBetween(W.unboundedPreceding, -1)
        edge = edge.withColumn("before", F.coalesce(F.sum("n").over(u), F.lit(0).cast("bigint")))
        aggs += [(F.sum(F.col(f"d{i}") * _power(b, F.col("before")) % P) % P).alias(f"d{i}") for i, b in enumerate(BASES)]
    edge = edge.where("gid > 0").groupBy("source_table", "stream", "gid").agg(*aggs).drop("gid")
    return inner.unionByName(edge).select("source_table", "stream", "f.*", F.col("n").cast("int").alias("n_lines"), *digests)


def found_entries(log_entry: DataFrame, grouped_entry: DataFrame) -> DataFrame:
    """All entries of both tables, layouts mined from their own lines."""
    lines = all_lines(log_entry, grouped_entry)
    return group_entries(parse_headers(lines, T.layouts(lines, "line"))).select("source_table", "row_id", "line_no", "event_us", "log_level", "component", "n_lines")


def all_lines(log_entry: DataFrame, grouped_entry: DataFrame) -> DataFrame:
    """The physical lines of both tables."""
    return log_lines(log_entry).unionByName(grouped_lines(grouped_entry))


def entry_texts(parsed: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Entries with ``message`` (the head's line) and ``lines``, all of their lines in order.

    As :func:`group_entries`, with the lines collected per entry; an entry is
    as long as its program wrote it. Only the segments at block edges, two rows
    a block, go through the pass per stream.
    """
    keys = ["source_table", "stream", "block"]
    w = W.partitionBy(*keys).orderBy("row_id", "line_no")
    rows = parsed.withColumn("block", F.floor(F.col("row_id") / block))
    at = rows.withColumn("hid", F.sum(F.col("is_head").cast("int")).over(w))
    seg = at.groupBy(*keys, "hid").agg(F.min(F.when(F.col("is_head"), F.struct("row_id", "line_no", "event_us", "log_level", "component"))).alias("f"), F.array_sort(F.collect_list(F.struct("row_id", "line_no", "line"))).alias("part"))
    seg = seg.withColumn("edge", (F.col("hid") == 0) | (F.col("hid") == F.max("hid").over(W.partitionBy(*keys))))
    inner = seg.where("not edge").select("source_table", "stream", "f", F.col("part").alias("all"))
    gid = seg.where("edge").withColumn("gid", F.sum((F.col("hid") > 0).cast("int")).over(W.partitionBy("source_table", "stream").orderBy("block", "hid")))
    outer = gid.where("gid > 0").groupBy("source_table", "stream", "gid").agg(F.min("f").alias("f"), F.flatten(F.array_sort(F.collect_list("part"))).alias("all")).drop("gid")
    out = inner.unionByName(outer)
    return out.select("source_table", "stream", "f.*", F.transform("all", lambda x: x["line"]).alias("lines")).withColumn("message", F.col("lines")[0])
