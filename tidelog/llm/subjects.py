"""Subject areas of each document (problem 10).

Class-association rules: labelled documents give sentences with a class;
parallel frequent-pattern growth mines the word sets that go with a class; rules
that a more general rule already implies are pruned; every sentence of every
document is scored by the evidence of the rules it matches, brought to a
probability by labels kept out of the mining; a document gets the subjects that
enough of its sentences are about.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.runtime import cut, drop_cut

SPLIT = r"(?<=[.!?])\s+|[\r\n]+"
#: A line that goes on in the next one: no stop at its end, a small letter (after a quote mark) at the start of the next.
WRAPPED = r"(?<![.!?:;\s])[ \t]*\r?\n(?:[ \t]*>)?[ \t]*(?=\p{Ll})"
TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|-)*")
#: The rules are fitted on at most so many labelled documents (the smallest hashes of their ids).
MAX_LABELLED = 50_000
#: Bound on the rules that go to each task; about 300 bytes each.
MAX_RULES = 300_000
MAX_WORDS = 3
#: Words of a sentence that make one transaction; a longer sentence makes several.
PIECE = 10
NONE = "none"
#: Between sentences, on their way to Python.
MARK = "\x01"
SHARE = 0.25
#: Every so many-th labelled document is kept out of the mining and calibrates the evidence.
HELD_OUT = 4
BINS = 20
MEMO = 200_000
#: Up to so many words the JVM looks them up; beyond, a plan that holds them all would be slower than Python.
MAX_LITERALS = 10_000


@dataclass
class Rules:
    """Word sets and, for each, the share of each class among the sentences that
    hold it; ``curve`` turns evidence into a probability, by words that speak."""

    classes: list[str]
    table: dict[tuple[str, ...], list[float]] = field(default_factory=dict)
    words: frozenset[str] = frozenset()
    curve: list[list[float]] = field(default_factory=lambda: calibrated({}))
    by_word: dict[str, list[tuple[str, ...]]] = field(default_factory=dict)
    memo: dict[tuple[str, ...], tuple[int, float, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for key in self.table:
            self.by_word.setdefault(key[0], []).append(key)

    def evidence(self, words: Iterable[str]) -> tuple[int, float, int]:
        """(class, evidence in 0..1, words that speak for it); class -1 for none.

        Of the matching rules only those count that no longer matching rule
        contains. Their evidence is the log of the smoothed class shares.
        """
        have = tuple(sorted(self.words.intersection(words)))
        if not have:
            return -1, 0.0, 0
        got = self.memo.get(have)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            got = self.memo[have] = self._weigh(have)
        return got

    def _weigh(self, have: tuple[str, ...]) -> tuple[int, float, int]:
        held = set(have)
        matched = sorted((key for w in have for key in self.by_word.get(w, ()) if held.issuperset(key)), key=lambda k: (-len(k), k))
        covered: set[tuple[str, ...]] = set()
        shares, keys = [], []
        for key in matched:
            if key not in covered:
                keys.append(key)
                shares.append(self.table[key])
                for m in range(1, len(key)):
                    covered.update(combinations(key, m))
        if not shares:
            return -1, 0.0, 0
        score = [sum(math.log(p[c] + 0.02) for p in shares) for c in range(len(self.classes))]
        best = max(range(len(score)), key=score.__getitem__)
        top = max(p[best] for p in shares)
        odds = sum(math.exp(x - score[best]) for x in score)
        spoken = {w for key, p in zip(keys, shares) if p[best] >= 0.5 for w in key}
        return best, top / odds, len(spoken)

    def about(self, words: Iterable[str]) -> int:
        """The class a sentence is more likely than not about, or -1."""
        k, raw, spoken = self.evidence(words)
        return k if k >= 0 and self.curve[min(spoken, 2)][bin_of(raw)] >= 0.5 else -1


def bin_of(raw: float) -> int:
    return min(int(raw * BINS), BINS - 1)


def calibrated(counts: dict[tuple[int, int], tuple[int, int]], weight: float = 10.0) -> list[list[float]]:
    """How often evidence in each bin was right, never falling with more of it.

    ``counts``: (words that speak, bin) to (sentences, of them right). What the
    bin itself says, halved where one word alone speaks and nothing where none
    does, counts as ``weight`` sentences, so few labels move it little. Bins
    that fall are pooled (isotonic regression).
    """
    out = []
    for spoken in range(3):
        pools: list[list[float]] = []
        for k in range(BINS):
            n, right = counts.get((spoken, k), (0, 0))
            prior = (k + 0.5) / BINS * (0.0, 0.5, 1.0)[spoken]
            pools.append([(right + weight * prior) / (n + weight), n + weight, 1])
            while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
                p, w, m = pools.pop()
                q = pools[-1]
                pools[-1] = [(q[0] * q[1] + p * w) / (q[1] + w), q[1] + w, q[2] + m]
        out.append([p for p, _, m in pools for _ in range(m)])
    return out


def prose(text: Column) -> Column:
    """The sentences of a text, wrapped lines joined, in one string with a mark between them."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, MARK, " "), WRAPPED, " "), SPLIT, MARK)


def sentences(marked: str) -> list[list[str]]:
    """The words of each sentence of a text that :func:`prose` marked."""
    return [TOKEN.findall(x) for x in marked.lower().split(MARK)]


def classed_sentences(docs: DataFrame, keep: str) -> DataFrame:
    """``words`` (distinct, in order of first use, as one string) of each sentence, with its document's ``keep``."""
    kind = dict(docs.dtypes)[keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, " ".join(dict.fromkeys(ws))) for c, t in zip(b["c"], b["t"]) for ws in sentences(t) if ws]
            yield pd.DataFrame(rows, columns=["c", "words"])

    return docs.select(F.col(keep).alias("c"), prose(F.col("text")).alias("t")).mapInPandas(run, f"c {kind}, words string")


def mine_rules(classed: DataFrame, classes: list[str], *, min_support: float = 0.0001, min_count: int = 4, min_confidence: float = 0.35) -> Rules:
    """Class-association rules from sentences ``(c, words)`` with a class each.

    Words are counted per class first: one is an item if its share in its best
    class is surely above ``min_confidence`` (lower Wilson bound at one sigma).
    Parallel FP-growth then mines the frequent sets of items and class, and all
    rules, those of single words too, come from its sets. A sentence of more
    than ``PIECE`` items makes several transactions, so the sets of one can't
    grow without bound. A rule is redundant, and dropped, if a part of it already gives
    every class about the same share (within 0.05). A set that surely tells no
    class though its words do is kept: it blocks them where it matches.
    """
    n_wc = cut(classed.select("c", F.explode(F.split("words", " ")).alias("w")).groupBy("w", "c").agg(F.count(F.lit(1)).alias("k")))
    n_w = n_wc.groupBy("w").agg(F.sum("k").alias("n"), F.max(F.when(F.col("c") != NONE, F.col("k"))).alias("k")).where(F.col("n") >= min_count)
    p = F.col("k") / F.col("n")
    low = (p + 0.5 / F.col("n") - F.sqrt((p * (1 - p) + 0.25 / F.col("n")) / F.col("n"))) / (1 + 1 / F.col("n"))
    words = [r[0] for r in n_w.where(low >= min_confidence).select("w").limit(MAX_RULES + 1).collect()]
    drop_cut(n_wc)
    if len(words) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} words tell classes; raise min_count")
    if not words:
        return Rules(classes)
    vocabulary = frozenset(words)

    known = F.filter(F.split("words", " "), lambda w: w.isin(words)) if len(words) <= MAX_LITERALS else _known(vocabulary)(F.col("words"))
    held = classed.select("c", known.alias("k")).where(F.size("k") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("k") - 1) / PIECE).cast("int"))
    items = cut(held.select("c", "k", F.explode(starts).alias("i")).select(F.concat(F.slice("k", F.col("i") * PIECE + 1, F.lit(PIECE)), F.array(F.concat(F.lit("="), "c"))).alias("items")))
    support = max(min_support, min_count / max(items.count(), 1))
    freq = FPGrowth(itemsCol="items", minSupport=min(1.0, support)).fit(items).freqItemsets
    plain = F.filter("items", lambda x: ~x.startswith("="))
    of = F.filter("items", lambda x: x.startswith("="))
    sets = freq.where(F.size("items") <= MAX_WORDS + 1).select(F.array_sort(plain).alias("x"), of.alias("c"), "freq").where((F.size("x") > 0) & (F.size("x") <= MAX_WORDS))
    rows = sets.groupBy("x").agg(F.max(F.when(F.size("c") == 0, F.col("freq"))).alias("n"), F.collect_list(F.when(F.size("c") == 1, F.struct(F.col("c")[0].alias("c"), "freq"))).alias("by")).where("n is not null")
    got = rows.limit(MAX_RULES + 1).collect()
    drop_cut(items)
    if len(got) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; raise min_support")
    at = {"=" + c: i for i, c in enumerate(classes)}
    table: dict[tuple[str, ...], tuple[list[float], int]] = {}
    for r in got:
        share = [0.0] * len(classes)
        for b in r["by"]:
            if b["c"] in at:
                share[at[b["c"]]] = b["freq"] / (r["n"] + 1.0)
        table[tuple(r["x"])] = share, r["n"]
    pruned: dict[tuple[str, ...], list[float]] = {}
    for key in sorted(table, key=lambda k: (len(k), k)):
        share, n = table[key]
        parts = [pruned[s] for m in range(1, len(key)) for s in combinations(key, m) if s in pruned]
        top = max(share)
        if (top < min_confidence and (len(key) < 2 or top + 2 * math.sqrt(max(top * (1 - top), 0.01) / n) >= min_confidence)) or any(all(abs(a - b) <= 0.05 for a, b in zip(share, q)) for q in parts):
            continue
        pruned[key] = share
    return Rules(classes, pruned, frozenset(w for k in pruned for w in k))


def _known(vocabulary: frozenset[str]):
    @F.pandas_udf("array<string>")
    def keep(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: [w for w in ws.split(" ") if w in vocabulary])

    return keep


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", subject: str = "subject", rounds: int = 2) -> Rules:
    """Rules from hand labels, at most ``MAX_LABELLED`` documents of them; one
    in ``HELD_OUT`` takes no part in the mining and calibrates the result.

    First round: sentences of documents with one label carry it. Further
    rounds: the rules of the round before are spread over all documents; a
    document about one class alone gives it to all of its sentences. What
    stands in documents of any class (standing phrases, quoted logs and tests)
    so keeps a flat share, and words too rare among the labels are learned.
    """
    by_doc = labels.where(F.col(doc_id).isNotNull() & F.col(subject).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.array_sort(F.collect_set(subject)).alias("cls"))
    by_doc = by_doc.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(MAX_LABELLED)
    named = docs.where(F.col(doc_id).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    labelled = cut(named.join(by_doc, "doc_id"))
    classes = sorted(r[0] for r in labelled.select(F.explode("cls")).distinct().collect())
    one = labelled.where(F.size("cls") == 1).select("text", F.col("cls")[0].alias("c"), (F.pmod("o", F.lit(HELD_OUT)) == 0).alias("out"))
    first = cut(classed_sentences(one.where("not out"), "c"))
    rules = mine_rules(first, classes)
    drop_cut(first)
    for _ in range(rounds - 1):
        if not rules.table:
            break
        rules.curve = _curve(one.where("out"), rules)
        spread = cut(_spread(named, rules))
        rules = mine_rules(spread, classes, min_confidence=0.5)
        drop_cut(spread)
    rules.curve = _curve(one.where("out"), rules)
    drop_cut(labelled)
    return rules


def _curve(held_out: DataFrame, rules: Rules) -> list[list[float]]:
    """The calibration by sentences of labelled documents that weren't mined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = [(c, *rules.evidence(ws.split(" "))) for c, ws in zip(b["c"], b["words"])]
            yield pd.DataFrame([(min(n, 2), bin_of(raw), rules.classes[k] == c) for c, k, raw, n in seen if k >= 0], columns=["n", "bin", "good"])

    got = classed_sentences(held_out, "c").mapInPandas(run, "n int, bin int, good boolean").groupBy("n", "bin").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("good"), 1)).alias("right"))
    return calibrated({(r["n"], r["bin"]): (r["all"], r["right"]) for r in got.collect()})


def _spread(docs: DataFrame, rules: Rules) -> DataFrame:
    """The sentences of documents about one class alone: the others together
    have less than the share that makes a subject. Map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["t"]:
                words = sentences(t)
                n = _topical(words, rules)
                best = max(n, key=n.__getitem__, default=-1)
                total = sum(n.values())
                if total >= 2 and n[best] > (1 - SHARE) * total:
                    rows += [(rules.classes[best], " ".join(dict.fromkeys(ws))) for ws in words if ws]
            yield pd.DataFrame(rows, columns=["c", "words"])

    return docs.select(prose(F.col("text")).alias("t")).mapInPandas(run, "c string, words string")


def _topical(sentences: Iterable[Iterable[str]], rules: Rules) -> dict[int, int]:
    """Sentences about each class."""
    n: dict[int, int] = {}
    for words in sentences:
        k = rules.about(words)
        if k >= 0:
            n[k] = n.get(k, 0) + 1
    return n


def sentence_counts(docs: DataFrame, rules: Rules, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document and subject: sentences about it, and about any subject. Map-only."""
    cols = ["doc_id", "subject", "n_sentences", "n_topical"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["d"], b["t"]):
                n = _topical(sentences(t), rules)
                total = sum(n.values())
                rows += [(d, rules.classes[k], v, total) for k, v in n.items()]
            yield pd.DataFrame(rows, columns=cols)

    return docs.where((F.col(text) != "") & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), prose(F.col(text)).alias("t")).mapInPandas(run, "doc_id bigint, subject string, n_sentences int, n_topical int")


def subjects(docs: DataFrame, labels: DataFrame, *, share: float = SHARE) -> DataFrame:
    """One row per document and subject that at least ``share`` of its topical
    sentences are about. Empty and null texts, and texts about nothing, have
    no row; repeated rows of a document give repeated rows only if their texts
    differ. Without labels there are no rules and no rows."""
    counts = sentence_counts(docs, fit(docs, labels))
    return counts.where(F.col("n_sentences") >= share * F.col("n_topical")).select("doc_id", "subject").distinct()


def composition(docs: DataFrame, found: DataFrame, areas: DataFrame) -> DataFrame:
    """Make-up of the corpus by subject: documents and their share; a document
    with several subjects counts for each. Every subject area has a row."""
    total = docs.agg(F.countDistinct("doc_id").alias("n_docs"))
    per = found.groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))
    return areas.select("subject").distinct().join(per, "subject", "left").withColumn("n_docs", total.scalar()).select("subject", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(F.try_divide(F.coalesce("documents", F.lit(0)).cast("double"), "n_docs"), F.lit(0.0)).alias("share"))
