"""Mixing sources to target weights (problem 9).

Temperature mixing: weights are proportional to share ** exponent, here along
the geometric path from the natural token shares (exponent 0) to the target
shares (exponent 1). The exponent is bisected to the largest at which no source
must be repeated more often than allowed. The weights are then realised by
block permutations: each source's documents are put in a pseudo-random order of
blocks, whole blocks are taken while the budget lasts, and only the one block
at the border is cut document by document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BLOCKS = 4096
#: Bound on mix rows and sources that go to the driver; both are settings, not data.
MAX_SOURCES = 100_000
#: Longer texts are counted in pieces, cut where the tokenizer cuts anyway.
PIECE = 1 << 16
#: Before a blank between two ASCII letters: no token of a byte-level tokenizer reaches over it.
CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
#: Characters per call of the tokenizer; its answers take some hundred bytes a token.
FLUSH_CHARS = 200_000


def source_name(col: str) -> Column:
    """A source as targets spell it: lower case, no outer blanks, ``_`` inside."""
    return F.regexp_replace(F.lower(F.trim(F.col(col))), r"[\s-]+", "_")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in pieces of some ``size`` characters whose token counts add up
    to that of the whole; a text without a place to cut stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        m = CUT.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` and ``n_tokens`` of each document; null and empty texts have 0.

    Batched calls of the tokenizer over bounded pieces (:func:`pieces`); counts
    are those of the whole texts.
    """
    types = dict(docs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(tokenizer)
        encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
        for b in batches:
            n = [0] * len(b)
            parts, owner = [], []

            def flush() -> None:
                for i, e in zip(owner, encode(parts, add_special_tokens=False)):
                    n[i] += len(e)
                parts.clear()
                owner.clear()

            size = 0
            for i, t in enumerate(b["_t"]):
                for p in pieces(t) if t else ():
                    parts.append(p)
                    owner.append(i)
                    size += len(p)
                    if size > FLUSH_CHARS:
                        flush()
                        size = 0
            if parts:
                flush()
            out = b.drop(columns="_t")
            out["n_tokens"] = pd.array(n, dtype="int64")
            yield out

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens bigint"
    return docs.select(*keep, F.col(text).alias("_t")).mapInPandas(run, schema)


def tempered(natural: dict[str, float], target: dict[str, float], exponent: float) -> dict[str, float]:
    """Weights proportional to target ** exponent * natural ** (1 - exponent)."""
    raw = {s: target[s] ** exponent * natural[s] ** (1 - exponent) for s in target if target[s] > 0 and natural.get(s, 0) > 0}
    total = sum(raw.values())
    return {s: v / total for s, v in raw.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def exponent_for_entropy(natural: dict[str, float], wanted: float, steps: int = 60, most: float = 16.0) -> float:
    """The exponent whose weights natural ** exponent have the wanted entropy
    (1: natural shares, 0: uniform, above 1: sharper), by bisection."""
    lo, hi = 0.0, most
    for _ in range(steps):
        mid = (lo + hi) / 2
        if entropy(powered(natural, mid)) > wanted:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def powered(natural: dict[str, float], exponent: float) -> dict[str, float]:
    """Weights proportional to natural ** exponent."""
    top = max(natural.values())
    raw = {s: (v / top) ** exponent for s, v in natural.items() if v > 0}
    total = sum(raw.values())
    return {s: v / total for s, v in raw.items()}


def weights(tokens: dict[str, int], target: dict[str, float], repeats: dict[str, int], total: float | str | None = None, steps: int = 60, evenness: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weight by source, total tokens, exponent).

    Without a total it is the largest at which the target shares hold within
    the repeat limits (exponent 1). With a larger total the exponent is bisected
    down until the limits hold; where not even exponent 0 does, sources at their
    limit give all they may and the rest keeps its proportions. Sources without
    tokens get weight 0 and the others share what they leave. ``total`` may be
    ``"all"``: as many tokens as the sources have. With ``evenness`` the targets
    only say which sources take part: the exponent of the natural shares is
    bisected to an entropy of ``evenness`` times the greatest possible.
    """
    have = {s: t for s, t in tokens.items() if t > 0 and s in target and target[s] > 0 and repeats.get(s, 0) > 0}
    if not have:
        return {}, 0.0, 1.0
    size = sum(have.values())
    natural = {s: t / size for s, t in have.items()}
    goal = tempered(natural, {s: target[s] for s in have}, 1.0)
    room = {s: have[s] * repeats[s] for s in have}
    total = float(size) if total == "all" else total
    if evenness is not None:
        exponent = exponent_for_entropy(natural, evenness * math.log(len(have)), steps)
        w = powered(natural, exponent)
        most = min(room[s] / w[s] for s in have)
        return w, min(total, most) if total is not None else most, exponent
    if total is None:
        total = min(room[s] / goal[s] for s in have)
    total = min(total, sum(room.values()))
    fits = lambda w: all(w[s] * total <= room[s] * (1 + 1e-12) for s in w)
    if fits(goal):
        return goal, total, 1.0
    lo, hi = 0.0, 1.0
    if fits(tempered(natural, goal, 0.0)):
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if fits(tempered(natural, goal, mid)) else (lo, mid)
        return tempered(natural, goal, lo), total, lo
    w = tempered(natural, goal, 0.0)
    full: set[str] = set()
    while True:
        left = total - sum(room[s] for s in full)
        free = sum(w[s] for s in w if s not in full)
        over = [s for s in w if s not in full and w[s] / free * left > room[s] * (1 + 1e-12)]
        if not over:
            return {s: room[s] / total if s in full else w[s] / free * left / total for s in w}, total, 0.0
        full |= set(over)


def plan(sizes: DataFrame, targets: DataFrame, total: float | str | None = None, evenness: float | None = None) -> DataFrame:
    """Per mix and source: weight, token budget, whole passes and the rest.
    ``sizes``: doc_source, tokens, largest (tokens of its largest document).

    Works on one row per source and one per target, both settings-sized and
    checked against ``MAX_SOURCES``.
    """
    spark = sizes.sparkSession
    t_rows = targets.where("mix_name is not null and doc_source is not null").select("mix_name", source_name("doc_source").alias("s"), F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(1))).limit(MAX_SOURCES + 1).collect()
    wanted = {r[1] for r in t_rows}
    s_rows = sizes.where(F.col("doc_source").isin(list(wanted))).collect() if wanted else []
    if len(t_rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target rows")
    tokens = {r["doc_source"]: int(r["tokens"] or 0) for r in s_rows}
    largest = {r["doc_source"]: int(r["largest"] or 0) for r in s_rows}
    out = []
    for mix in sorted({r[0] for r in t_rows}):
        target: dict[str, float] = {}
        repeats: dict[str, int] = {}
        for _, s, share, most in (r for r in t_rows if r[0] == mix):
            target[s] = target.get(s, 0.0) + share
            repeats[s] = max(repeats.get(s, 0), most)
        w, size, exponent = weights(tokens, target, repeats, total, evenness=evenness)
        for s in sorted(target):
            budget = min(w.get(s, 0.0) * size, float(tokens.get(s, 0) * repeats[s]))
            have = tokens.get(s, 0)
            passes = min(int((budget + 0.5) // have), repeats[s]) if have else 0
            out.append((mix, s, target[s], repeats[s], w.get(s, 0.0), exponent, have, budget, passes, max(0.0, budget - passes * have) if passes < repeats[s] else 0.0, largest.get(s, 0)))
    return spark.createDataFrame(out, "mix_name string, doc_source string, target_share double, max_repeats int, weight double, exponent double, source_tokens bigint, budget double, passes int, rest double, largest bigint")


def counted_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``doc_source`` and ``n_tokens`` of the documents that may be
    mixed, written down: several mixes of them count tokens once."""
    named = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), source_name(source).alias("doc_source"))
    return cut(token_counts(named.where("doc_source is not null and text <> ''"), ["doc_id", "doc_source"], "text", tokenizer))


def mix(docs: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", total: float | str | None = None, evenness: float | None = None, tokenizer: str = TOKENIZER, seed: str = "mix", counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(multiset, report): ``copies`` of each document per mix, and the shares reached.

    Every document of a source is used ``passes`` times; the last, partial pass
    takes a prefix of the source's permuted documents whose tokens come nearest
    to the rest. The prefix is found over block sums (``BLOCKS`` per source),
    then inside the one border block: no task holds a source. Documents
    without source, text or id are in no mix; repeated rows count as they come.
    ``counted``: what :func:`counted_documents` gave, if it is there.
    """
    if counted is None:
        counted = counted_documents(docs, doc_id=doc_id, text=text, source=source, tokenizer=tokenizer)
    sizes = counted.groupBy("doc_source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"))
    plans = plan(sizes, targets, total, evenness)
    order = F.xxhash64(F.lit(seed), F.col("mix_name"), F.col("doc_id"))
    rows = counted.join(F.broadcast(plans), "doc_source").select("mix_name", "doc_source", "doc_id", "n_tokens", "passes", "rest", order.alias("o"), F.shiftrightunsigned(order, 52).cast("int").alias("block"))
    sums = rows.groupBy("mix_name", "doc_source", "block").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("t").over(W.partitionBy("mix_name", "doc_source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    border = sums.withColumn("before", before).where("before < rest and before + t >= rest").select("mix_name", "doc_source", F.col("block").alias("border"), F.col("before"))
    # one row per mix and source, as many as the plan has
    placed = rows.join(F.broadcast(border), ["mix_name", "doc_source"], "left")
    sure = placed.withColumn("more", F.when(F.col("rest") <= 0, 0).when(F.col("border").isNull() | (F.col("block") < F.col("border")), 1).otherwise(0))
    inside = placed.where("block = border and rest > 0")
    upto = F.sum("n_tokens").over(W.partitionBy("mix_name", "doc_source").orderBy("o", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    cutting = inside.withColumn("upto", F.col("before") + upto).withColumn("more", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    cols = ["mix_name", "doc_source", "doc_id", "n_tokens", (F.col("passes") + F.col("more")).alias("copies")]
    whole = sure.where("border is null or block <> border or rest <= 0").select(*cols).unionByName(cutting.select(*cols)).where("copies > 0")
    chosen = cut(whole)
    got = chosen.groupBy("mix_name", "doc_source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("records"), F.max("copies").alias("most_copies"))
    report = plans.join(got, ["mix_name", "doc_source"], "left").select(
        "mix_name", "doc_source", "target_share", "max_repeats", "source_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "exponent", "weight", "budget", "largest"
    )
    report = report.withColumn("reached_share", F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.sum("mixed_tokens").over(W.partitionBy("mix_name"))), F.lit(0.0)))
    return chosen, report
