"""Alert rules over log rows, in batch on the event-time clock."""

from __future__ import annotations

import json
import smtplib
import subprocess
import tomllib
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.message import EmailMessage
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions import rx
from tidelog.model import label, level_of_alert

LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")
GLOBAL_COOLDOWN_S = 300
BUCKETS = 256


@dataclass(frozen=True)
class Rule:
    """``kind``: pattern_match, rate_threshold or level_threshold."""

    name: str
    kind: str
    pattern: str = ""
    count: int = 0
    window_seconds: int = 0
    level: str = ""
    actions: tuple[str, ...] = ()
    cooldown_seconds: int | None = None
    labels: tuple[tuple[str, str], ...] = ()
    #: The actions as they are configured, as JSON texts.
    details: tuple[str, ...] = ()


@dataclass
class Config:
    enabled: bool = False
    cooldown_seconds: int = GLOBAL_COOLDOWN_S
    rules: list[Rule] = field(default_factory=list)
    smtp: dict = field(default_factory=dict)


def load_config(text: str) -> Config:
    """Rules from TOML. Missing conditions or actions and repeated names raise."""
    a = tomllib.loads(text).get("alerts", {})
    rules = []
    for r in a.get("rules", []):
        c = r.get("condition")
        if c is None or "actions" not in r:
            raise ValueError(f"alert rule {r.get('name')!r} needs a condition and actions")
        if c.get("type") not in ("pattern_match", "rate_threshold", "level_threshold"):
            raise ValueError(f"alert rule {r.get('name')!r}: unknown condition {c.get('type')!r}")
        rules.append(Rule(r["name"], c["type"], c.get("pattern", ""), c.get("count", 0), c.get("window_seconds", 0), c.get("level", ""), tuple(x if isinstance(x, str) else x.get("type", "") for x in r["actions"]), r.get("cooldown_seconds"), tuple(sorted(r.get("labels", {}).items())), tuple(json.dumps({"type": x} if isinstance(x, str) else x) for x in r["actions"])))
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("alert rule names must differ")
    return Config(a.get("enabled", False), a.get("cooldown_seconds", GLOBAL_COOLDOWN_S), rules, a.get("smtp", {}))


def label_condition(rule: Rule) -> Column:
    return reduce(lambda c, kv: c & F.coalesce(label(kv[0]) == kv[1], F.lit(False)), rule.labels, F.lit(True))


def level_condition(level: str) -> Column:
    """Levels from the threshold up; unknown thresholds and levels match nothing."""
    up = LEVELS[LEVELS.index(level.lower()) :] if level.lower() in LEVELS else ()
    return F.coalesce(level_of_alert().isin(*up), F.lit(False)) if up else F.lit(False)


def rate_matches(rows: DataFrame, count: int, window_s: int) -> DataFrame:
    """Rows at which at least ``count`` rows lie within the window up to them.

    Counts per instant are taken first. Windows are cut into buckets as long as
    the window; each bucket also sees the one before it, so a stream is not
    sorted in one task.
    """
    if count <= 1:
        return rows
    w = max(window_s, 0) * 1_000_000
    size = max(w, 60_000_000)
    us = F.unix_micros("ts")
    at = rows.where("ts is not null").withColumn("_us", us)
    per = at.groupBy("_us").agg(F.count(F.lit(1)).alias("_n"))
    b = F.floor(F.col("_us") / size)
    both = per.select("_us", "_n", F.explode(F.array(b, b + 1)).alias("_b"))
    near = both.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("_b").orderBy("_us").rangeBetween(-w, -1)), F.lit(0))).where(F.floor(F.col("_us") / size) == F.col("_b")).select("_us", "_before")
    peers = at.withColumn("_k", F.row_number().over(W.partitionBy("_us").orderBy("seq")))
    return peers.join(near, "_us").where(F.col("_before") + F.col("_k") >= count).drop("_us", "_before", "_k")


def matches(df: DataFrame, rule: Rule) -> DataFrame:
    """Rows at which the rule's condition holds. An invalid pattern matches none."""
    rows = df.where(label_condition(rule))
    if rule.kind == "pattern_match":
        r = rx.to_java(rule.pattern)
        return rows.where(F.col("line").rlike(r.java) if r else F.lit(False))
    if rule.kind == "level_threshold":
        return rows.where(level_condition(rule.level))
    return rate_matches(rows, rule.count, rule.window_seconds)


def cooldown(matched: DataFrame, seconds: dict[str, int]) -> DataFrame:
    """Per rule, in time order: a match fires if the rule never fired or its
    last firing is at least the cooldown ago.

    Matches of one instant are reduced to one first. Where nothing matched for as
    long as the cooldown, the next match fires whatever came before, so a rule
    falls into spells that are folded apart; they are found over hours, with one
    row an hour in order per rule. The instants of a spell stream through a task in
    sorted runs that spill, and only the time of the last firing is held: a
    rule that never rests that long is one spell.
    """
    per = matched.groupBy("rule", F.unix_micros("ts").alias("us")).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    always = [r for r, s in seconds.items() if s <= 0]
    free = matched.where(F.col("rule").isin(always)).select("rule", "seq", "ts") if always else None

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, 0
        for b in batches:
            rows = []
            for r, spell, us, seq in zip(b["rule"], b["spell"], b["us"], b["seq"]):
                if (r, spell) != at or us - last >= seconds[r] * 1_000_000:
                    at, last = (r, spell), us
                    rows.append((r, seq))
            yield pd.DataFrame(rows, columns=["rule", "seq"])

    held = per.where(~F.col("rule").isin(always)) if always else per
    waits = F.create_map(*[F.lit(x) for r, w in seconds.items() for x in (r, w * 1_000_000)]) if seconds else F.create_map().cast("map<string,bigint>")
    hours = held.withColumn("b", F.floor(F.col("us") / 3_600_000_000))
    inside, over = W.partitionBy("rule", "b").orderBy("us"), W.partitionBy("rule").orderBy("b")
    last = hours.groupBy("rule", "b").agg(F.max("us").alias("m")).withColumn("m", F.lag("m").over(over))
    before = F.coalesce(F.lag("us").over(inside), F.col("m"))
    marked = hours.join(last, ["rule", "b"]).withColumn("p", before).withColumn("start", F.when(F.col("p").isNull() | (F.col("us") - F.col("p") >= waits[F.col("rule")]), F.col("us")))
    carry = marked.groupBy("rule", "b").agg(F.max("start").alias("s")).withColumn("s", F.max("s").over(over.rowsBetween(W.unboundedPreceding, -1)))
    spells = marked.join(carry, ["rule", "b"]).withColumn("spell", F.coalesce(F.max("start").over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col("s")))
    fired = spells.select("rule", "spell", "us", "seq").repartition("rule", "spell").sortWithinPartitions("rule", "spell", "us").mapInPandas(fold, "rule string, seq bigint")
    out = fired.join(matched.select("rule", "seq", "ts").distinct(), ["rule", "seq"])
    return out.unionByName(free.select(out.columns)) if free is not None else out


def _cut_bytes(text: str | None, limit: int) -> str | None:
    raw = text.encode() if text is not None else b""
    return text if len(raw) <= limit else raw[:limit].decode(errors="ignore") + "..."


def _preview(line: Column, limit: int) -> Column:
    """The line cut at ``limit`` bytes, never inside a character."""

    @F.pandas_udf("string")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda s: _cut_bytes(s, limit))

    return run(line)


def message(rule: Column, line: Column) -> Column:
    """``Rule 'N' triggered on: `` and the line cut at 120 bytes."""
    return F.concat(F.lit("Rule '"), rule, F.lit("' triggered on: "), _preview(line, 120))


def fill(template: str, rule: Column, line: Column, ts: Column, level: Column) -> Column:
    out = F.lit(template)
    for name, value in (("rule_name", rule), ("line_preview", line), ("timestamp", ts.cast("string")), ("level", level)):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def evaluate(df: DataFrame, config: Config, muted: tuple[str, ...] = ()) -> DataFrame:
    """Fired alerts: rule, seq, ts, message, ``notify`` (false for muted rules).
    Rules are unrolled into one plan each; a disabled engine fires nothing."""
    parts = [matches(df, r).select(F.lit(r.name).alias("rule"), "seq", "ts") for r in config.rules] if config.enabled else []
    matched = reduce(DataFrame.unionByName, parts) if parts else df.select(F.lit("").alias("rule"), "seq", "ts").limit(0)
    seconds = {r.name: config.cooldown_seconds if r.cooldown_seconds is None else r.cooldown_seconds for r in config.rules}
    fired = cooldown(matched, seconds)
    return fired.join(df.select("seq", "line"), "seq").select("rule", "seq", "ts", message(F.col("rule"), F.col("line")).alias("message"), (~F.col("rule").isin(*muted) if muted else F.lit(True)).alias("notify"))


def history(fired: DataFrame, n: int = 100) -> DataFrame:
    return fired.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


RESULT = "rule string, seq bigint, action string, error string"


def _send(action: dict, smtp: dict, alert: dict) -> None:
    """One webhook call, mail or desktop notice."""
    fill_in = lambda t: t.replace("{rule_name}", alert["rule_name"]).replace("{line_preview}", alert["line_preview"]).replace("{timestamp}", alert["timestamp"]).replace("{level}", alert["labels"].get("level") or alert["labels"].get("severity") or "")
    if action["type"] == "webhook":
        headers = {"content-type": "application/json"} | action.get("headers", {})
        request = urllib.request.Request(action["url"], json.dumps(alert).encode(), headers, method=action.get("method", "POST").upper())
        urllib.request.urlopen(request, timeout=30).close()
    elif action["type"] == "email":
        if not smtp:
            raise ValueError("a mail needs the smtp settings")
        with smtplib.SMTP(smtp["host"], int(smtp.get("port", 587)), timeout=30) as server:
            if smtp.get("starttls", True):
                server.starttls()
            if smtp.get("username"):
                server.login(smtp["username"], smtp.get("password", ""))
            for to in action["to"]:
                mail = EmailMessage()
                mail["From"], mail["To"] = smtp["from"], to
                mail["Subject"] = fill_in(action.get("subject_template") or "Alert: {rule_name}")
                mail.set_content("\n".join(f"{k}: {v}" for k, v in alert.items()))
                server.send_message(mail)
    elif action["type"] == "desktop":
        subprocess.run(["notify-send", action.get("title") or alert["rule_name"], alert["message"]], check=True, timeout=30, capture_output=True)
    else:
        raise ValueError(f"unknown action {action['type']!r}")


def deliver(fired: DataFrame, rows: DataFrame, config: Config, *, allow: bool = False, send: Callable[[dict, dict, dict], None] | None = None) -> DataFrame:
    """Carry out the actions of fired alerts: one row per alert and action, with
    its error or null.

    Nothing is sent unless ``allow`` is set. Alerts with ``notify`` false send
    nothing. Actions run in the tasks that hold the alerts, when the result is
    written; a task that runs again sends again, so receivers see each alert at
    least once. A failed action doesn't stop the others.
    """
    details = {r.name: [json.loads(x) for x in r.details] for r in config.rules}
    smtp, act = dict(config.smtp), send or _send

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rule, seq, message, preview, stamp, labels in zip(b["rule"], b["seq"], b["message"], b["preview"], b["stamp"], b["labels"]):
                alert = {"rule_name": rule, "message": message, "line_preview": preview, "timestamp": stamp, "labels": dict(labels or {})}
                for action in details.get(rule, []):
                    error = None
                    try:
                        if not allow:
                            raise ValueError("actions run only with allow=True")
                        act(action, smtp, alert)
                    except Exception as e:
                        error = str(e) or type(e).__name__
                    out.append((rule, seq, action["type"], error))
            yield pd.DataFrame(out, columns=["rule", "seq", "action", "error"])

    told = fired.where("notify").join(rows.select("seq", "line", "labels"), "seq")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return told.select("rule", "seq", "message", _preview(F.col("line"), 200).alias("preview"), stamp.alias("stamp"), "labels").mapInPandas(run, RESULT)


def action_sink(config: Config, log: str, *, muted: tuple[str, ...] = (), allow: bool = False, send: Callable[[dict, dict, dict], None] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: alerts of a micro-batch of log rows are acted on, and
    the outcomes appended under ``log``, one folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        deliver(evaluate(batch, config, muted), batch, config, allow=allow, send=send).write.mode("overwrite").parquet(f"{log}/micro={batch_id}")

    return write
