"""Buffer and view operators over log rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions import rx, structured
from tidelog.model import first_label, is_error_stats, label, level_of_stats, row_index, running_sum, with_previous

# What changes in a line and its placeholder, in order.
NORMAL = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b", "<IP>"),
    (r"\b[0-9a-fA-F]{16,}\b", "<HEX>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"\b\d+(\.\d+)?\s*(ms|us|µs|ns|s|sec|min)\b", "<DUR>"),
    (r"\b\d{2,}\b", "<N>"),
)
#: What a line that continues the entry before it looks like.
CONTINUATION = r'(?s)^(?:\t|  )|^\s*(?:(?i:at )|Caused by:|--- |File "|goroutine |[|+]|0x|#\s*[0-9]|\.\.\. (?:.* )?more$)'
TIME_PRESETS_MIN = (5, 15, 30, 60, 180, 360, 720, 1440, 2880, 10080)
DEFAULT_PRESET_MIN = 60
#: Empty buckets between two that have rows; a single wrong time would else make billions.
MAX_GAP = 1_000_000


def preset(df: DataFrame, minutes: int = DEFAULT_PRESET_MIN, now: Column | None = None) -> DataFrame:
    """The rows of one of the preset time ranges, which ends at ``now`` (default:
    the time of the query). Rows without a time are in none."""
    if minutes not in TIME_PRESETS_MIN:
        raise ValueError(f"presets are {TIME_PRESETS_MIN} minutes")
    end = F.current_timestamp() if now is None else now
    us = F.unix_micros("ts") - F.unix_micros(end)
    return df.where((us >= -minutes * 60_000_000) & (us <= 0))


def search_pattern(term: str) -> str:
    """Case-insensitive regex of a search term; a literal one if it isn't valid."""
    r = rx.to_java(term)
    return "(?i)" + (r.java if r else rx.quote(term))


def search(df: DataFrame, term: str) -> DataFrame:
    return df.where(F.col("line").rlike(search_pattern(term)))


def context(df: DataFrame, term: str, k: int) -> DataFrame:
    """Rows within ``k`` rows of a match: ``is_match`` and ``gap_before``, true
    where rows are left out before one.

    Positions are numbered over blocks; every match marks its 2k+1 positions,
    so no window spans more than its surroundings. k is small (0 to 10).
    """
    at = row_index(df, name="_i").withColumn("is_match", F.col("line").rlike(search_pattern(term)))
    near = at.where("is_match").select(F.explode(F.sequence(F.col("_i") - k, F.col("_i") + k)).alias("_i")).distinct()
    kept = at.join(near, "_i", "left_semi")
    return with_previous(kept, {"_i": "_pi"}, order="seq").withColumn("gap_before", F.coalesce(F.col("_i") - F.col("_pi") > 1, F.col("_i") > 0)).drop("_i", "_pi")


def normalize(line: Column) -> Column:
    for pattern, put in NORMAL:
        line = F.regexp_replace(line, pattern, put)
    return line


def dedup(df: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Global groups of equal (or equally normalized) lines; the last row stands
    for the group, first and last time are those of its first and last row."""
    key = normalize(F.col("line")) if fuzzy else F.col("line")
    return df.groupBy(key.alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min_by("ts", "seq").alias("first_ts"), F.max_by("ts", "seq").alias("last_ts"), F.max("seq").alias("last_seq"), F.max_by("line", "seq").alias("line"))


def span_text(n: Column, first: Column, last: Column) -> Column:
    """`` over Nh``/``Nm``/``Ns`` of the distance, for groups of more than one."""
    s = F.abs(F.unix_seconds(last) - F.unix_seconds(first))
    unit = F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit("h"))).when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).otherwise(F.concat(s.cast("string"), F.lit("s")))
    return F.when((s > 0) & (n > 1), F.concat(F.lit(" over "), unit)).otherwise("")


def multiline(df: DataFrame) -> DataFrame:
    """Groups of rows: head fields and ``continuation_lines``. A row continues
    the group if its line looks so, or if the row before states a level (label
    level or severity) and it doesn't. The first row always starts a group."""
    has = first_label("level", "severity").isNotNull()
    rows = with_previous(df.withColumn("_h", has), {"_h": "_ph", "seq": "_ps"})
    cont = F.col("line").rlike(CONTINUATION) | (F.col("_ph") & ~F.col("_h"))
    head = F.when(F.col("_ps").isNull() | ~cont, 1).otherwise(0)
    at = running_sum(rows.withColumn("_head", head), F.col("_head"), "gid")
    lines = F.array_sort(F.collect_list(F.when(F.col("_head") == 0, F.struct("seq", "line"))))
    return at.groupBy("gid").agg(F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"), F.min_by("labels", "seq").alias("labels"), F.min_by("line", "seq").alias("line"), F.transform(lines, lambda x: x["line"]).alias("continuation_lines"))


def stats_levels(df: DataFrame) -> DataFrame:
    return df.groupBy(level_of_stats().alias("level")).agg(F.count(F.lit(1)).alias("n"))


def stats_summary(df: DataFrame) -> DataFrame:
    """One row: total and error rate in percent (0 for no rows)."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.avg(is_error_stats(level_of_stats()).cast("int")) * 100, F.lit(0.0)).alias("error_rate"))


def source_label() -> Column:
    """service, app, job, container, source, else the first other label by key."""
    rest = F.filter(F.array_sort(F.map_entries("labels")), lambda e: ~e["key"].isin("level", "severity", "lvl"))
    return F.coalesce(first_label("service", "app", "job", "container", "source"), F.get(rest, F.lit(0))["value"], F.lit("unknown"))


def top_sources(df: DataFrame, n: int = 5) -> DataFrame:
    return df.groupBy(source_label().alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(n)


def histogram(df: DataFrame, every_s: int, last: int | None = 60) -> DataFrame:
    """Zero-filled buckets of ``every_s`` seconds: total, errors, warnings; the
    ``last`` ones, or all. Levels are those of the label ``level`` alone. More
    than ``MAX_GAP`` empty buckets in a row are an error."""
    w = every_s * 1_000_000
    b = F.floor(F.unix_micros("ts") / w)
    level = F.lower(label("level"))
    got = df.where("ts is not null").groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(is_error_stats(level), 1)).alias("errors"), F.count(F.when(level.isin("warn", "warning"), 1)).alias("warnings"))
    zero = lambda c: F.coalesce(F.when(F.col("k") == 0, F.col(c)), F.lit(0)).alias(c)
    if last is not None:
        spine = got.agg(F.greatest(F.min("b"), F.max("b") - (last - 1)).alias("lo"), F.max("b").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("b"))
        each = spine.join(got, "b", "left").withColumn("k", F.lit(0))
    else:
        # one row per bucket that has rows makes the empty ones up to the next
        gaps = got.withColumn("g", F.coalesce(F.lead("b").over(W.orderBy("b")), F.col("b") + 1) - F.col("b"))
        held = F.when(F.col("g") > MAX_GAP, F.raise_error(F.lit(f"a gap of more than {MAX_GAP} buckets; take wider ones or cut the times off"))).otherwise(F.col("g"))
        each = gaps.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), held - 1)))
    return each.select(F.timestamp_micros((F.col("b") + F.col("k")) * w).alias("bucket"), zero("total"), zero("errors"), zero("warnings"))


def histogram_threshold(buckets: DataFrame) -> DataFrame:
    """mean + 2 population deviations of the non-empty buckets; null below three."""
    some = buckets.where("total > 0")
    return some.agg(F.when(F.count(F.lit(1)) >= 3, F.avg("total") + 2 * F.stddev_pop("total")).alias("threshold"))


def bucket_class(threshold: Column) -> Column:
    t = F.col("total")
    return F.when(t > threshold, "error").when(t == 0, "info").when(F.try_divide(F.col("errors"), t) > 0.30, "error").when(F.try_divide(F.col("warnings"), t) > 0.30, "warn").otherwise("info")


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two lists aligned on equal times: both, left_only, right_only."""
    number = lambda d, s: d.select("ts", F.row_number().over(W.partitionBy("ts").orderBy("seq")).alias("k"), F.col("seq").alias(f"{s}_seq"), F.col("line").alias(f"{s}_line"))
    both = number(left, "left").join(number(right, "right"), ["ts", "k"], "full_outer")
    side = F.when(F.col("left_seq").isNull(), "right_only").when(F.col("right_seq").isNull(), "left_only").otherwise("both")
    return both.select("ts", side.alias("side"), "left_line", "right_line", "left_seq", "right_seq")


def diff_queries(df: DataFrame, left: str, right: str) -> DataFrame:
    """Diff of the rows that contain one text and those that contain another."""
    return diff(df.where(F.contains(F.col("line"), F.lit(left))), df.where(F.contains(F.col("line"), F.lit(right))))


def _ranges(line: str, pattern: str, names: list[str]) -> list[tuple[str, str, int, int]] | None:
    import regex

    m = regex.search(pattern, line)
    if m is None:
        return None
    at = lambda k: len(line[:k].encode())
    return [(n, m[i], at(m.start(i)), at(m.end(i))) for i, n in enumerate(["match", *names]) if m[i] is not None]


def playground(df: DataFrame, pattern: str, limit: int = 500) -> DataFrame:
    """The first matching lines with the match, its groups by name or number,
    and ``ranges``: name, text, start and end in bytes of the match and of each
    group that took part."""
    r = rx.to_java(pattern)
    if r is None:
        raise ValueError(f"invalid pattern: {pattern}")
    names = {i: n for n, i in r.names}
    called = [names.get(i, f"group_{i}") for i in range(1, r.groups + 1)]
    hits = df.where(F.col("line").rlike(r.java)).orderBy("seq").limit(limit)
    plain = r.java.removeprefix("(?U)")

    @F.pandas_udf("array<struct<name:string,text:string,start:int,end:int>>")
    def ranges(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: _ranges(x, plain, called))

    hits = hits.withColumn("m", F.regexp_substr("line", F.lit(r.java))).withColumn("ranges", ranges("line"))
    return hits.select("seq", "line", F.col("m").alias("match"), F.get("ranges", F.lit(0))["start"].alias("start"), "ranges", *[F.regexp_extract("line", r.java, i + 1).alias(n) for i, n in enumerate(called)])


def columns_of(df: DataFrame) -> DataFrame:
    """Field names of structured lines in table order: timestamp, level, then by name."""
    s = df.select(F.explode(F.map_keys(structured.structured(F.col("line"))["fields"])).alias("name")).distinct()
    rank = F.when(F.col("name") == "timestamp", 0).when(F.col("name") == "level", 1).otherwise(2)
    return s.select("name", rank.alias("rank"))


def tabular(df: DataFrame, names: list[str], sort_by: str | None = None, descending: bool = False) -> DataFrame:
    """Fields of structured lines as columns, ``-`` where missing, sorted as text."""
    rows = df.withColumn("_f", structured.structured(F.col("line"))["fields"])
    if sort_by:
        key = F.coalesce(F.col("_f")[sort_by], F.lit(""))
        rows = rows.orderBy(key.desc() if descending else key.asc(), "seq")
    return rows.select("seq", *[F.coalesce(F.col("_f")[n], F.lit("-")).alias(n) for n in names])


def newest(df: DataFrame, n: int = 50_000) -> DataFrame:
    """The ring buffer: the last ``n`` rows by arrival."""
    return df.orderBy(F.desc("seq")).limit(n)


def suggest(names: DataFrame, typed: str, column: str = "name", order: str = "ord") -> DataFrame:
    """Completions: those that start with the text first, then those that contain it."""
    low, t = F.lower(F.col(column)), typed.lower()
    rank = F.when(low.startswith(t), 0).when(F.contains(low, F.lit(t)), 1)
    return names.withColumn("rank", rank).where("rank is not null").orderBy("rank", order)


def completion_context(text: str, cursor: int) -> tuple[str, str, int]:
    """(kind, label, start): label_name after ``{`` or ``,``, label_value inside
    a quoted value, else none."""
    import re

    before = text[:cursor]
    brace = before.rfind("{")
    if brace < 0 or "}" in before[brace:]:
        return "none", "", cursor
    m = re.search(r'([A-Za-z0-9_.]+)\s*(?:=~|!~|!=|=)\s*"([^"]*)$', before)
    if m:
        return "label_value", m[1], cursor - len(m[2])
    m = re.search(r"[{,]\s*([A-Za-z0-9_.]*)$", before)
    return ("label_name", "", cursor - len(m[1])) if m else ("none", "", cursor)


def bookmarks(df: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows whose ``seq`` is marked."""
    return df.join(marks.select("seq").distinct(), "seq", "left_semi")


def incident_timeline(anomalies: DataFrame, marks: DataFrame) -> DataFrame:
    """Events newest first: anomalies warn, marks set by hand are critical."""
    a = anomalies.select("ts", F.lit("warning").alias("severity"), "text")
    return a.unionByName(marks.select("ts", F.lit("critical").alias("severity"), "text")).orderBy(F.desc("ts"), "severity", "text")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def compact(n: Column) -> Column:
    """1234 as 1.2K, 2500000 as 2.5M."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1_000, F.format_string("%.1fK", n / 1_000)).otherwise(n.cast("string"))


def shorten(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))).otherwise(text)


