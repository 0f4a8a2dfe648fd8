"""Local sources: files, commands, containers, stdin, generated rows."""

from __future__ import annotations

import shlex
import subprocess
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import SCHEMA, QueryFailed, row_index

# Words that tell a level, the first hit counts.
GUESS = (("fatal", ("FATAL", "CRITICAL")), ("error", ("ERROR", "ERR ")), ("warn", ("WARN",)), ("debug", ("DEBUG",)), ("trace", ("TRACE",)))
GUESS_EXTRA = {"file": {}, "command": {"fatal": ("PANIC",), "error": ("FAILED",), "debug": ("VERBOSE",)}, "container": {"fatal": ("PANIC",)}}


def guess_level(line: Column, kind: str = "file") -> Column:
    """The level a line seems to have; info if no word tells."""
    up = F.upper(line)
    out = None
    for level, words in GUESS:
        hit = None
        for w in words + GUESS_EXTRA[kind].get(level, ()):
            c = F.contains(up, F.lit(w))
            hit = c if hit is None else hit | c
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise("info")


def read_files(spark: SparkSession, paths: str | list[str], limit: int | None = None) -> DataFrame:
    """Lines of text files, newest (last) first, with source, filename, level.

    The order is (file, position). Positions are numbered per file by the
    reader's own line order, block by block; ``limit`` keeps the last lines.
    Rows carry the time they are read.
    """
    raw = spark.read.text(paths).select(F.col("value").alias("line"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos"))
    rows = row_index(raw.where("line <> ''"), order="pos", name="i", block=1 << 33)
    n = rows.agg(F.max("i").alias("m"))
    at = rows.withColumn("m", n.scalar()).select((F.col("m") - F.col("i")).alias("seq"), F.current_timestamp().alias("ts"), F.create_map(F.lit("source"), F.lit("file"), F.lit("filename"), F.element_at(F.split("file", "/"), -1), F.lit("level"), guess_level(F.col("line"))).alias("labels"), "line", F.lit(None).cast("string").alias("raw"))
    return at if limit is None else at.where(F.col("seq") < limit)


def from_lines(spark: SparkSession, lines: Iterable[str], labels: dict[str, str], kind: str = "file", limit: int | None = None, newest_first: bool = False) -> DataFrame:
    """Rows of lines held by the driver: what a pipe or a command gave."""
    held = [x for x in (y.rstrip("\r\n") for y in lines) if x]
    if limit is not None:
        held = held[-limit:] if newest_first else held[:limit]
    if newest_first:
        held.reverse()
    now = datetime.now(timezone.utc)
    rows = spark.createDataFrame([(i, now, labels, x, None) for i, x in enumerate(held)], SCHEMA)
    return rows.withColumn("labels", F.map_concat("labels", F.create_map(F.lit("level"), guess_level(F.col("line"), kind))))


def read_command(spark: SparkSession, command: str, limit: int = 1000, *, allow: bool = False, timeout: float = 60) -> DataFrame:
    """Output of a shell command, standard output then errors, last lines first.
    Runs on the driver and only if ``allow`` is set."""
    if not allow:
        raise QueryFailed("commands run only with allow=True")
    done = subprocess.run(["sh", "-c", command], capture_output=True, text=True, errors="replace", timeout=timeout)
    words = shlex.split(command) or [""]
    return from_lines(spark, [*done.stdout.splitlines(), *done.stderr.splitlines()], {"source": "command", "service": words[0]}, "command", limit, True)


def read_docker(spark: SparkSession, container: str, limit: int = 1000, **kw) -> DataFrame:
    df = read_command(spark, f"docker logs --tail {int(limit)} {shlex.quote(container)} 2>/dev/null", limit, **kw)
    return _relabel(df, {"source": "docker", "container": container})


def read_kubernetes(spark: SparkSession, pod: str = "", selector: str = "", namespace: str = "default", limit: int = 1000, **kw) -> DataFrame:
    """Logs of a pod or of a selector's pods; with a selector the pod's name is
    the text before the first space."""
    if not pod and not selector:
        raise QueryFailed("a pod or a selector is needed")
    what = shlex.quote(pod) if pod else f"-l {shlex.quote(selector)} --prefix"
    df = _relabel(read_command(spark, f"kubectl logs -n {shlex.quote(namespace)} --tail={int(limit)} {what} 2>/dev/null", limit, **kw), {"source": "kubernetes", "namespace": namespace})
    name = F.lit(pod) if pod else F.substring_index("line", " ", 1)
    return df.withColumn("labels", F.map_concat("labels", F.create_map(F.lit("pod"), name)))


def _relabel(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    new = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    level = guess_level(F.col("line"), "container")
    return df.withColumn("labels", F.map_concat(new, F.create_map(F.lit("level"), level)))


# The services, namespaces and weighted levels of the demo source.
DEMO_SERVICES = ("api-gateway", "auth-service", "order-service", "user-service", "payment-service")
DEMO_NAMESPACES = ("prod", "staging")
DEMO_LEVELS = (("debug", 10), ("info", 50), ("warn", 25), ("error", 12), ("fatal", 3))

# What it says: made from parts, so every run of the source has all of them.
DEMO_THINGS = ("basket", "invoice", "session", "thumbnail", "coupon")
DEMO_SAYINGS = ("stored {} in {} ms", "no {} left in the pool, waited {} ms", "retrying {} after {} ms", "{} was refused by its owner after {} ms")
DEMO_EVENTS = ("opened", "closed", "expired", "moved")
DEMO_LINES = tuple(s.format(t, 7 + 13 * i + 5 * j) for j, s in enumerate(DEMO_SAYINGS) for i, t in enumerate(DEMO_THINGS))
DEMO_JSON = tuple(f'{{"event":"{t} {e}","took_ms":{3 + 9 * i + 4 * j},"ok":{"true" if (i + j) % 3 else "false"}}}' for i, t in enumerate(DEMO_THINGS[:3]) for j, e in enumerate(DEMO_EVENTS))


def demo(spark: SparkSession, limit: int = 100, seed: int = 7) -> DataFrame:
    """Up to 100 generated rows: 30 % JSON lines, weighted levels."""
    pick = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), F.floor(F.rand(seed + k) * len(xs)).cast("int"))
    u, upto, level = F.col("u"), 0, None
    for name, share in DEMO_LEVELS:
        upto += share
        level = F.when(u * 100 < upto, name) if level is None else level.when(u * 100 < upto, name)
    base = spark.range(min(limit, 100)).select(F.col("id").alias("seq"), F.rand(seed).alias("u"), F.rand(seed + 1).alias("j"), pick(DEMO_SERVICES, 2).alias("s"), pick(DEMO_NAMESPACES, 3).alias("n"), pick(DEMO_LINES, 4).alias("t"), pick(DEMO_JSON, 5).alias("o"))
    return base.select("seq", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("seq")).alias("ts"), F.create_map(F.lit("service"), F.col("s"), F.lit("namespace"), F.col("n"), F.lit("level"), level.otherwise("fatal")).alias("labels"), F.when(F.col("j") < 0.3, F.col("o")).otherwise(F.col("t")).alias("line"), F.lit(None).cast("string").alias("raw"))
