"""Deeply nested records into flat tables with parent links (problem 5).

Dewey labelling: a depth-first walk gives every object the path of ordinals and
member names that leads to it; the parent link is that path truncated at the
closest enclosing array element that is an object; objects with the same path
without ordinals (the schema path) form one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPENING = re.compile(r"\s*[\[{]")
#: Bound on the schema members that are now an array, now a bare object; one entry is about 100 bytes.
MAX_MIXED = 200_000


def _refuse(name: str):
    raise ValueError(name)


def parse(text: str | None):
    """The JSON value of ``text``, or None if it isn't valid JSON (NaN isn't)."""
    if not text:
        return None
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


def _opened(value):
    """A string that holds a JSON object or array stands for what it holds."""
    while isinstance(value, str) and OPENING.match(value):
        inner = parse(value)
        if not isinstance(inner, (dict, list)):
            return value
        value = inner
    return value


def members(value, mixed: frozenset[str] = frozenset()) -> Iterator[tuple[str, bool]]:
    """(schema path, is array) of each member that holds an array of objects or an object.

    Below a bare object under a member of ``mixed`` the paths are those of an array.
    """
    stack = [("", _opened(value))]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                x = _opened(x)
                at = f"{path}.{k}" if path else k
                if isinstance(x, dict):
                    yield at, False
                    if at in mixed:
                        at = f"{at}[]"
                elif isinstance(x, list):
                    if any(isinstance(_opened(y), dict) for y in x):
                        yield at, True
                else:
                    continue
                stack.append((at, x))
        elif isinstance(v, list):
            stack.extend((f"{path}[]", y) for y in map(_opened, v) if isinstance(y, (dict, list)))


def labels(value, mixed: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, str, dict]]:
    """(child path, parent path, schema path, object) of each array element that is an object.

    Paths with and without ordinals are kept side by side, so a bare object
    under a member of ``mixed`` is labelled as element 0 of an array of one.
    """
    stack = [("", "", "", _opened(value))]
    while stack:
        path, schema, parent, v = stack.pop()
        if isinstance(v, dict):
            below = []
            for k, x in v.items():
                x = _opened(x)
                if not isinstance(x, (dict, list)):
                    continue
                at, sch = (f"{path}.{k}", f"{schema}.{k}") if path else (k, k)
                if isinstance(x, dict) and sch in mixed:
                    x = [x]
                below.append((at, sch, parent, x))
            stack.extend(reversed(below))
        elif isinstance(v, list):
            below = []
            for i, x in enumerate(v):
                x = _opened(x)
                at, sch = f"{path}[{i}]", f"{schema}[]"
                if isinstance(x, dict):
                    yield at, parent, sch, x
                    below.append((at, sch, at, x))
                elif isinstance(x, list):
                    below.append((at, sch, parent, x))
            stack.extend(reversed(below))


def mixed_members(df: DataFrame, text: str, source: str) -> dict[str, frozenset[str]]:
    """By source, the members that hold arrays of objects in some records and bare objects in others.

    Each task sends one row per distinct member; the answer depends on the
    schema, not on the number of records. Below a mixed member, records write
    the same member in two ways, so the scan is repeated with the members found
    until no more come; each further scan reaches mixed members nested deeper.
    Beyond ``MAX_MIXED`` (ids used as member names on both shapes) it stops
    with an error instead of guessing.
    """
    mixed: dict[str, frozenset[str]] = {}
    while True:
        found = _mixed_under(df, text, source, mixed)
        grown = {s: mixed.get(s, frozenset()) | p for s, p in found.items()}
        if all(p == mixed.get(s) for s, p in grown.items()):
            return mixed
        mixed = mixed | grown


def _mixed_under(df: DataFrame, text: str, source: str, mixed: dict[str, frozenset[str]]) -> dict[str, frozenset[str]]:
    """One scan of :func:`mixed_members`, with paths as ``mixed`` makes them."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str, bool]] = set()
        for b in batches:
            new = {(s, p, a) for s, t in zip(b["s"], b["t"]) for p, a in members(parse(t), mixed.get(s, frozenset()))} - seen
            seen |= new
            if len(seen) > MAX_MIXED:
                seen = set()
            yield pd.DataFrame(list(new), columns=["s", "p", "a"])

    found = (
        df.select(F.col(source).alias("s"), F.col(text).alias("t"))
        .where("t is not null")
        .mapInPandas(scan, "s string, p string, a boolean")
        .groupBy("s", "p")
        .agg(F.max("a").alias("some"), F.min("a").alias("every"))
        .where("some and not every")
        .select("s", "p")
        .limit(MAX_MIXED + 1)
        .collect()
    )
    if len(found) > MAX_MIXED:
        raise ValueError(f"more than {MAX_MIXED} members hold arrays and bare objects; use stable member names")
    out: dict[str, set[str]] = {}
    for s, p in found:
        out.setdefault(s, set()).add(p)
    return {s: frozenset(p) for s, p in out.items()}


def flatten_records(df: DataFrame, *, source: str, row_id: str, text: str, with_object: bool = True) -> DataFrame:
    """One row per object that is an element of an array, at any depth.

    Columns: ``source_table``, ``row_id``, ``child_path``, ``parent_path``,
    ``table_path`` (the schema path: one flat table each), ``depth``,
    ``n_fields`` (own members that aren't null) and, if wanted, ``fields``, the
    scalar members as JSON text. Null, empty, broken or scalar texts yield
    nothing; null elements keep their position; the last of repeated member
    names counts. The second pass is map-only: no row is shuffled.
    """
    mixed = mixed_members(df, text, source)
    schema = "source_table string, row_id bigint, child_path string, parent_path string, table_path string, depth int, n_fields int"
    schema += ", fields string" if with_object else ""
    names = [c.split()[0] for c in schema.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, i, t in zip(b["s"], b["i"], b["t"]):
                for child, parent, sch, obj in labels(parse(t), mixed.get(s, frozenset())):
                    row = (s, i, child, parent, sch, sch.count("[]"), sum(v is not None for v in obj.values()))
                    if with_object:
                        row += (json.dumps({k: v for k, v in obj.items() if not isinstance(v, (dict, list))}, ensure_ascii=False),)
                    rows.append(row)
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return df.select(F.col(source).alias("s"), F.col(row_id).cast("bigint").alias("i"), F.col(text).alias("t")).where("t is not null and i is not null").mapInPandas(walk, schema)


def flat_table(objects: DataFrame, table_path: str, columns: dict[str, str]) -> DataFrame:
    """One kind of object as a typed table: ``columns`` maps member names to Spark types."""
    ddl = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    return objects.where(F.col("table_path") == table_path).select("source_table", "row_id", "child_path", "parent_path", F.from_json("fields", ddl).alias("o")).select("source_table", "row_id", "child_path", "parent_path", "o.*")
