"""Structured lines: JSON objects, logfmt pairs, flattening."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r'(?s)(?:([^\s=]+)=(?:"((?:\\.|[^"\\]|\\$)*)"?|([^\s"]\S*)?)|\S+)'
QUOTED_TOKEN = r"""(?s)(?:([^\s=]+)=(?:"((?:\\.|[^"\\]|\\$)*)"?|'((?:\\.|[^'\\]|\\$)*)'?|([^\s"']\S*)?)|\S+)"""


def json_object(line: Column) -> Column:
    """map<string,string> of a line that is a JSON object, else null. Strings
    as they are, other values as JSON text, null members kept as null."""
    whole = F.try_parse_json(line)
    return F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.from_json(line, "map<string,string>", {"allowSingleQuotes": "false"}))


def json_labels(line: Column) -> Column:
    return F.map_filter(json_object(line), lambda k, v: v.isNotNull())


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _pairs(line: Column, token: str, quoted: list[int], bare: int) -> Column:
    groups = [F.regexp_extract_all(line, F.lit(token), F.lit(i)) for i in (1, *quoted, bare)]
    rows = F.filter(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]), lambda r: r["g0"] != "")

    def value(r: Column) -> Column:
        out = r[f"g{len(quoted) + 1}"]
        for i in range(len(quoted)):
            out = F.when(r[f"g{i + 1}"] != "", _unescape(r[f"g{i + 1}"])).otherwise(out)
        return out

    return F.transform(rows, lambda r: F.struct(r["g0"].alias("key"), value(r).alias("value")))


def last_wins(pairs: Column) -> Column:
    """A map of (key, value) pairs in which the last of equal keys counts."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def logfmt(line: Column) -> Column:
    """map of ``k=v`` and ``k="v"`` tokens; other tokens are skipped."""
    return last_wins(_pairs(line, TOKEN, [2], 3))


def key_values(line: Column) -> Column:
    """As :func:`logfmt`, with single quotes too."""
    return last_wins(_pairs(line, QUOTED_TOKEN, [2, 3], 4))


def structured(line: Column) -> Column:
    """struct(kind, fields): a JSON object with members, else at least two
    key-value pairs, else null; a null member reads 'null'."""
    trimmed = F.trim(line)
    obj = F.transform_values(json_object(trimmed), lambda k, v: F.coalesce(v, F.lit("null")))
    kv = key_values(trimmed)
    return F.when(F.size(obj) > 0, F.struct(F.lit("json").alias("kind"), obj.alias("fields"))).when(F.size(_pairs(trimmed, QUOTED_TOKEN, [2, 3], 4)) >= 2, F.struct(F.lit("key_value").alias("kind"), kv.alias("fields")))


def flatten_object(text: str | None) -> dict[str, str] | None:
    """Dotted paths of a JSON object's members; nulls dropped, arrays as text."""
    try:
        top = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    out: dict[str, str] = {}
    stack = [("", top)]
    while stack:
        prefix, obj = stack.pop()
        for k, v in obj.items():
            name = f"{prefix}.{k}" if prefix else k
            if isinstance(v, dict):
                stack.append((name, v))
            elif v is not None:
                out[name] = v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    return out


def unpacked(line: Column | str) -> Column:
    """Members of any depth as dotted labels; null where the line isn't an object."""

    @F.pandas_udf("map<string,string>")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(flatten_object)

    return run(line)
