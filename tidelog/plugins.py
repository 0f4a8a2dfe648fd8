"""User functions over batches of log rows: transforms, filters, aggregates."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.model import SCHEMA


@dataclass(frozen=True)
class Plugin:
    """``kind``: transform (frame to frame), filter (frame to booleans) or
    aggregate (frame of one group to frame)."""

    name: str
    kind: str
    call: Callable
    version: str = "0.0.0"
    schema: str = SCHEMA
    combine: Callable | None = None


class Registry:
    """Plugins in order of name. A failing transform or filter leaves its batch
    as it was, unless ``strict``."""

    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}

    def add(self, plugin: Plugin) -> None:
        if plugin.kind not in ("transform", "filter", "aggregate"):
            raise ValueError(f"unknown plugin kind {plugin.kind!r}")
        self.plugins[plugin.name] = plugin

    def apply(self, df: DataFrame, strict: bool = False) -> DataFrame:
        """All transforms, then all filters, batch by batch."""
        mine = [self.plugins[n] for n in sorted(self.plugins)]
        steps = [p for p in mine if p.kind == "transform"] + [p for p in mine if p.kind == "filter"]
        if not steps:
            return df

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for p in steps:
                    try:
                        got = p.call(b)
                        b = got if p.kind == "transform" else b[pd.Series(got, index=b.index).astype(bool)]
                    except Exception:
                        if strict:
                            raise
                yield b[["seq", "ts", "labels", "line", "raw"]]

        return df.select("seq", "ts", "labels", "line", "raw").mapInPandas(run, SCHEMA)

    def aggregate(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """A grouped aggregate (extension), once per label value.

        With ``combine`` the plugin first runs on each batch's rows of a value,
        where they are read, and ``combine`` then on the partial frames, so a hot
        value moves as a few rows; without it a value's rows must fit a task.
        """
        p = self.plugins[name]
        keyed = df.withColumn("_g", F.col("labels")[by])
        if p.combine is None:
            return keyed.groupBy("_g").applyInPandas(lambda g: p.call(g.drop(columns="_g")), p.schema)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for g, rows in b.groupby("_g", dropna=False):
                    yield p.call(rows.drop(columns="_g")).assign(_g=None if pd.isna(g) else g)

        return keyed.mapInPandas(partial, f"{p.schema}, _g string").groupBy("_g").applyInPandas(lambda g: p.combine(g.drop(columns="_g")), p.schema)

    def load(self, folder: str) -> list[str]:
        """Add the plugins of a folder: ``x/plugin.py`` with ``manifest.toml``, or
        ``x.py`` with ``x.toml``; without a manifest a transform of version
        0.0.0. The code defines ``call`` (and ``combine``). Returns the names of
        those that couldn't be loaded. It runs their code: load only your own.
        """
        failed = []
        root = Path(folder)
        for code in sorted([*root.glob("*.py"), *root.glob("*/plugin.py")]):
            manifest = code.with_name("manifest.toml") if code.name == "plugin.py" else code.with_suffix(".toml")
            name = code.parent.name if code.name == "plugin.py" else code.stem
            try:
                m = tomllib.loads(manifest.read_text()) if manifest.exists() else {}
                m = m.get("plugin", m)
                space: dict = {}
                exec(compile(code.read_text(), str(code), "exec"), space)
                self.add(Plugin(m.get("name", name), m.get("type", m.get("kind", "transform")).lower(), space["call"], m.get("version", "0.0.0"), m.get("schema", SCHEMA), space.get("combine")))
            except Exception:
                failed.append(name)
        return failed
