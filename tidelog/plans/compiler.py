"""Pipeline stages as DataFrame transformations; Catalyst plans them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import rx, structured
from tidelog.model import label, merge_labels, row_index, with_previous
from tidelog.plans.lang import LabelFilter, LineFilter, PipelineError, Stage, Word, matchers, parse


def line_filter(df: DataFrame, f: LineFilter) -> DataFrame:
    """Substring or unanchored regex; an invalid regex is taken literally."""
    found = F.contains(F.col("line"), F.lit(f.text))
    if f.regex and (r := rx.to_java(f.text)):
        found = F.col("line").rlike(r.java)
    return df.where(~found if f.negated else found)


def _matches(f: LabelFilter, anchored: bool) -> Column:
    value = F.coalesce(label(f.label), F.lit(""))
    if f.op in ("=", "!="):
        return (value == f.value) if f.op == "=" else (value != f.value)
    if f.op in ("=~", "!~"):
        r = rx.to_java(f.value)
        if r is None:
            return F.lit(f.op == "!~")
        hit = value.rlike(f"^(?:{r.java})$" if anchored else r.java)
        return hit if f.op == "=~" else ~hit
    number, than = value.try_cast("double"), F.lit(float(f.value))
    return {">": number > than, ">=": number >= than, "<": number < than, "<=": number <= than}[f.op]


def label_filter(df: DataFrame, f: LabelFilter) -> DataFrame:
    """A missing label is ''; regexes are unanchored; an invalid one drops all
    rows of ``=~`` and keeps all of ``!~``."""
    return df.where(_matches(f, False))


def select_streams(df: DataFrame, selector: str) -> DataFrame:
    """The selector's matchers on labels; here regexes are anchored."""
    return reduce(lambda d, m: d.where(_matches(m, True)), matchers(selector), df)


def regex_stage(df: DataFrame, pattern: str) -> DataFrame:
    """Named groups of the first match become labels, if they took part in it,
    also with an empty text. An invalid regex passes rows through."""
    r = rx.to_java(pattern)
    if r is None or not r.names:
        return df
    hit = F.col("line").rlike(r.java)
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.regexp_extract("line", r.java, i).alias("value"), took_part(r, i).alias("took")) for n, i in r.names])
    new = F.map_from_entries(F.transform(F.filter(entries, lambda e: e["took"]), lambda e: F.struct(e["key"], e["value"])))
    return df.withColumn("labels", F.when(hit, merge_labels(F.col("labels"), new)).otherwise(F.col("labels")))


def took_part(r: rx.Rx, group: int) -> Column:
    """Whether a group took part in the first match. One that is empty did if a
    back-reference to it, put behind the match, finds nothing to match; it fails
    for a group that was passed over."""
    return (F.regexp_extract("line", r.java, group) != "") | F.col("line").rlike(f"^(?s:(?!{r.bare}).)*+(?>{r.java})(?:\\{group})")


def line_format(df: DataFrame, template: str) -> DataFrame:
    """``{{.k}}`` and then ``{{ .k }}`` replaced by labels in key order."""
    entries = F.array_sort(F.map_entries("labels"))
    tight = F.aggregate(entries, F.lit(template), lambda a, e: F.replace(a, F.concat(F.lit("{{."), e["key"], F.lit("}}")), e["value"]))
    loose = F.aggregate(entries, tight, lambda a, e: F.replace(a, F.concat(F.lit("{{ ."), e["key"], F.lit(" }}")), e["value"]))
    return df.withColumn("line", loose)


def apply_stage(df: DataFrame, s: Stage) -> DataFrame:
    if isinstance(s, LineFilter):
        return line_filter(df, s)
    if isinstance(s, LabelFilter):
        return label_filter(df, s)
    match s.name:
        case "json":
            return df.withColumn("labels", merge_labels(F.col("labels"), structured.json_labels(F.col("line"))))
        case "logfmt":
            return df.withColumn("labels", merge_labels(F.col("labels"), structured.logfmt(F.col("line"))))
        case "unpack":
            return df.withColumn("_u", structured.unpacked("line")).withColumn("labels", merge_labels(F.col("labels"), F.col("_u"))).drop("_u")
        case "regex":
            return regex_stage(df, s.text)
        case "line_format":
            return line_format(df, s.text)
        case "label_drop":
            return df.withColumn("labels", F.map_filter("labels", lambda k, v: ~k.isin(*s.names)))
        case "label_keep":
            return df.withColumn("labels", F.map_filter("labels", lambda k, v: k.isin(*s.names)))
        case "dedup":
            return with_previous(df, {"line": "_prev", "seq": "_ps"}).where(F.col("_ps").isNull() | ~F.col("line").eqNullSafe(F.col("_prev"))).drop("_prev", "_ps")
        case "sample":
            return row_index(df, name="_i").where(F.col("_i") % s.number == 0).drop("_i")
        case "limit":
            return df.orderBy("seq").limit(s.number)
        case "rate":
            return df
    raise PipelineError(f"no such stage: {s}")


ROW_WISE = ("json", "logfmt", "unpack", "regex", "label_drop", "label_keep")


def push_filters(stages: list[Stage]) -> list[Stage]:
    """Line filters moved before stages that change neither line nor row set;
    a repeated ``json`` right after another is dropped."""
    out: list[Stage] = []
    for s in stages:
        if isinstance(s, Word) and s.name == "json" and out and out[-1] == s:
            continue
        at = len(out)
        if isinstance(s, LineFilter):
            while at and (isinstance(out[at - 1], LabelFilter) or isinstance(out[at - 1], Word) and out[at - 1].name in ROW_WISE):
                at -= 1
        out.insert(at, s)
    return out


def run(df: DataFrame, text: str, strict: bool = False) -> DataFrame:
    """Parse a query and apply it to log rows."""
    selector, stages = parse(text, strict)
    return reduce(apply_stage, push_filters(stages), select_streams(df, selector))


def rate(df: DataFrame, every: str) -> DataFrame:
    """Rows per time window: what the no-op ``rate`` stage stands for (extension)."""
    return df.groupBy(F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
