"""Evaluation texts leaking into training text (problem 8).

Q-gram lemma filtering. Two texts within ``k`` edits over a window of ``w``
characters share at least ``w - q + 1 - k*q`` q-grams, on diagonals that span at
most ``k``. Each document's q-grams are looked up in an index of the passages and
hits are counted in overlapping diagonal bands. Without edits, chains of hits
that reach the bound are verified by banded alignment of their words; with an
edit budget, every window of words that reaches its own bound is verified by
alignment of its characters inside the band. Map-only: no row is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+")
Q = 12
MIN_WORDS = 13
MOD = np.uint64(0x9E3779B97F4A7C15)
#: Characters of passages searched in one pass; each worker's index takes about 40 bytes a character. Larger sets are searched in parts.
MAX_PASSAGE_CHARS = 5_000_000
#: Characters of documents hashed at once.
FLUSH_CHARS = 1_000_000
BASE = 0x2545F4914F6CDD1D


def words_of(text: str | None) -> list[str]:
    """The runs of letters and digits of the lower-cased text."""
    return WORDS.findall(text.lower()) if text else []


def grams(text: str, q: int) -> np.ndarray:
    """Hashes of all q-grams of ``text``, by position: polynomials modulo 2**64,
    put together from those of half the length, and mixed."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, size = codes + np.uint64(1), 1
    h, have = None, 0
    left = q
    with np.errstate(over="ignore"):
        while True:
            if left & 1:
                h = part[:n] if h is None else h * np.uint64(pow(BASE, size, 1 << 64)) + part[have : have + n]
                have += size
            left >>= 1
            if not left:
                break
            part = part[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + part[size:]
            size *= 2
        h = (h ^ (h >> np.uint64(32))) * MOD
        return h ^ (h >> np.uint64(29))


def infix_edits(pattern: str, text: str) -> int:
    """Least edit distance of ``pattern`` to any stretch of ``text``, one machine
    step per character of ``text`` (bit-parallel columns)."""
    m = len(pattern)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for c in text:
        eq = at.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        best = min(best, score)
    return best


def banded_alignment(a: list[str], b: list[str], shift: int, band: int) -> tuple[int, int, int]:
    """Best local word alignment of ``a`` and ``b`` within ``band`` of the diagonal ``shift``.

    Returns (longest run of equal words, words matched in the best alignment,
    edits in it). A match scores 1, an edit costs 1.
    """
    run = best = 0
    edits_best = 0
    prev: dict[int, tuple[int, int, int]] = {}
    for i in range(len(a)):
        cur: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i - shift - band), min(len(b), i - shift + band + 1)):
            score, ed, straight = prev.get(j - 1, (0, 0, 0))
            if a[i] == b[j]:
                cell = (score + 1, ed, straight + 1)
            else:
                up, le = prev.get(j, (0, 0, 0)), cur.get(j - 1, (0, 0, 0))
                s, e = max((score - 1, ed + 1), (up[0] - 1, up[1] + 1), (le[0] - 1, le[1] + 1))
                cell = (s, e, 0) if s > 0 else (0, 0, 0)
            if cell[0]:
                cur[j] = cell
                run = max(run, cell[2])
                if cell[0] > best:
                    best, edits_best = cell[0], cell[1]
        prev = cur
    return run, best, edits_best


class Index:
    """The passages' q-grams, sorted, with passage and position.

    With ``error_rate`` a window of ``min_words`` words may differ by that share
    of its characters; q is lowered until the lemma's bound is positive for
    every window of every passage.
    """

    def __init__(self, items: list[tuple[int, str]], q: int, min_words: int, error_rate: float = 0.0):
        self.min_words, self.error_rate = min_words, error_rate
        self.ids: list[int] = []
        self.words: list[list[str]] = []
        self.texts: list[str] = []
        self.starts: list[np.ndarray] = []
        self.windows: list[tuple[np.ndarray, np.ndarray]] = []
        for item, passage in items:
            ws = words_of(passage)
            if len(ws) < min_words:
                continue
            self.ids.append(item)
            self.words.append(ws)
            self.texts.append(" ".join(ws))
            starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in ws])))
            self.starts.append(starts)
            self.windows.append((starts[: len(ws) - min_words + 1], starts[min_words:] - 1))
        self.empty = not self.ids
        if self.empty:
            return
        shortest = np.array([int((b - a).min()) for a, b in self.windows])
        least = int(shortest.min())
        # the fewest characters bound the q that leaves every window with a q-gram it can't lose
        self.q = min(q, int((least + 1) // (1 + self.budget(least))), least)
        if self.q < min(3, least):
            raise ValueError(f"windows of {least} characters can't be filtered at {error_rate} edits a character")
        g = [grams(t, self.q) for t in self.texts]
        h = np.concatenate(g)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.who = np.repeat(np.arange(len(g), dtype=np.int32), [len(x) for x in g])[order]
        self.pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in g])[order]
        # the q-gram lemma's bound for the shortest window of min_words words of each passage
        self.need = shortest - self.q + 1 - np.array([self.budget(w) for w in shortest]) * self.q
        bits = 22
        self.filter = np.zeros(1 << bits, bool)
        self.shift = np.uint64(64 - bits)
        self.filter[(self.h >> self.shift).astype(np.int64)] = True

    def budget(self, chars: int) -> int:
        """The edits that a window of so many characters may differ by."""
        return int(chars * self.error_rate + 1e-9)

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, document position, passage position) of all shared q-grams."""
        g = grams(text, self.q)
        maybe = np.flatnonzero(self.filter[(g >> self.shift).astype(np.int64)])
        lo = np.searchsorted(self.h, g[maybe], "left")
        hi = np.searchsorted(self.h, g[maybe], "right")
        n = hi - lo
        at = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return self.who[at], np.repeat(maybe, n), self.pos[at]

    def scan(self, docs: list[tuple[int, str]]) -> Iterator[tuple]:
        """(doc, item, longest run of equal words, aligned words, edits) of each
        pair that passed; many texts are hashed at once, parted by a character
        that no passage holds."""
        if self.empty:
            return
        texts = [words_of(t) for _, t in docs]
        joined = [" ".join(ws) for ws in texts]
        at = np.cumsum([0] + [len(j) + 1 for j in joined])
        who, dpos, ppos = self.hits("\n".join(joined))
        doc = np.searchsorted(at, dpos, "right") - 1
        begin = np.searchsorted(doc, np.arange(len(docs) + 1))
        for k in np.unique(doc):
            s, e = begin[k], begin[k + 1]
            args = texts[k], joined[k], who[s:e], dpos[s:e] - at[k], ppos[s:e]
            for hit in self.near(*args) if self.error_rate else self.exact(*args):
                yield (docs[k][0], *hit)

    def bands(self, who: np.ndarray, dpos: np.ndarray, ppos: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The hits by passage and diagonal band, in document order: (order, ends
        of groups that reach their passage's bound). Bands overlap by half."""
        diag = dpos.astype(np.int64) - ppos
        for half in (0, width // 2):
            band = (diag + half) // width
            key = np.lexsort((dpos, band, who))
            k, b = who[key], band[key]
            cut = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (b[1:] != b[:-1]))))
            size = np.diff(np.append(cut, len(k)))
            ok = size >= self.need[k[cut]]
            if ok.any():
                yield key, np.stack((cut[ok], cut[ok] + size[ok]), axis=1)

    def exact(self, ws: list[str], joined: str, who: np.ndarray, dpos: np.ndarray, ppos: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Chains of hits in a band, each aligned by words from its own word offset."""
        found: dict[int, tuple[int, int, int]] = {}
        starts = np.cumsum([0] + [len(w) + 1 for w in ws])
        seen: set[tuple[int, ...]] = set()
        for key, groups in self.bands(who, dpos, ppos, 8):
            for s0, e0 in groups:
                mine = key[s0:e0]
                item = int(who[mine[0]])
                p, pp = dpos[mine], ppos[mine]
                w0 = np.searchsorted(starts, p, "right") - 1
                w1 = np.searchsorted(starts, p + self.q - 1, "right") - 1
                cut = np.concatenate(([0], np.flatnonzero(w0[1:] > w1[:-1]) + 1, [len(p)]))
                pw, pst = self.words[item], self.starts[item]
                for s, e in zip(cut[:-1], cut[1:]):
                    if e - s < self.need[item]:
                        continue
                    a0, a1 = int(w0[s]), min(len(ws), int(np.searchsorted(starts, p[e - 1] + self.q, "left")))
                    v0 = np.searchsorted(pst, pp[s:e], "right") - 1
                    b0, b1 = int(v0.min()), min(len(pw), int(np.searchsorted(pst, pp[s:e].max() + self.q, "left")))
                    # the band holds the word offset of every hit
                    off = w0[s:e] - v0 - (a0 - b0)
                    lo, hi = int(off.min()), int(off.max())
                    region = (item, a0, a1, b0, b1, lo, hi)
                    if region in seen:
                        continue
                    seen.add(region)
                    got = banded_alignment(ws[a0:a1], pw[b0:b1], (lo + hi) // 2, (hi - lo + 1) // 2 + 2)
                    if got > found.get(item, (0, 0, 0)):
                        found[item] = got
        return [(self.ids[i], *v) for i, v in sorted(found.items())]

    def near(self, ws: list[str], joined: str, who: np.ndarray, dpos: np.ndarray, ppos: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Windows of ``min_words`` words within their edit budget: per passage
        how many, as run and aligned words, and the fewest edits."""
        most = max(self.budget(int((b - a).max())) for a, b in (self.windows[i] for i in np.unique(who)))
        good: dict[int, dict[int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for key, groups in self.bands(who, dpos, ppos, 2 * (most + 1)):
            for s, e in groups:
                mine = key[s:e]
                item = int(who[mine[0]])
                first, last = self.windows[item]
                pp = np.unique(ppos[mine])
                have = np.searchsorted(pp, last - self.q, "right") - np.searchsorted(pp, first, "left")
                w = last - first
                k = (w * self.error_rate + 1e-9).astype(int)
                diag = dpos[mine].astype(np.int64) - ppos[mine]
                lo, hi = int(diag.min()), int(diag.max())
                for j in np.flatnonzero(have >= w - self.q + 1 - k * self.q):
                    a, b, budget = int(first[j]), int(last[j]), int(k[j])
                    c, d = max(0, a + lo - budget), b + hi + budget
                    if (item, int(j), c) in tried or good.get(item, {}).get(int(j), budget + 1) == 0:
                        continue
                    tried.add((item, int(j), c))
                    edits = infix_edits(self.texts[item][a:b], joined[c:d])
                    if edits <= budget:
                        good.setdefault(item, {})[int(j)] = min(edits, good.get(item, {}).get(int(j), edits))
        out = []
        for item, js in sorted(good.items()):
            covered = set()
            for j in js:
                covered.update(range(j, j + self.min_words))
            run = best = 0
            for x in range(len(self.words[item])):
                run = run + 1 if x in covered else 0
                best = max(best, run)
            out.append((self.ids[item], best, len(covered), min(js.values())))
        return out


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", q: int = Q, min_words: int = MIN_WORDS, error_rate: float = 0.0) -> DataFrame:
    """One row per document and item with a shared region that passed the filter.

    Without ``error_rate``: ``run_words``, the longest run of equal words,
    ``aligned_words`` (score of the best banded alignment of words) and its
    ``edits``. With it, every window of ``min_words`` words of a passage that
    stands in the document with at most ``error_rate`` edits a character is
    found: ``run_words`` is the longest stretch of the passage that such windows
    cover, ``aligned_words`` how many words they cover, ``edits`` the fewest of
    one window. Items are searched ``MAX_PASSAGE_CHARS`` at a time; test sets
    are small and fixed. Null or empty texts, null ids and passages shorter than
    ``min_words`` yield nothing; repeated item rows yield one row. Documents of
    any length are searched whole.
    """
    cols = ["doc_id", "item_id", "run_words", "aligned_words", "edits"]
    known = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(passage).alias("p")).where("p is not null").distinct()
    size = known.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).collect()[0][0]
    parts = max(1, -(-2 * size // MAX_PASSAGE_CHARS) if size > MAX_PASSAGE_CHARS else 1)
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t <> '' and d is not null")
    out = None
    for part in range(parts):
        mine = known if parts == 1 else known.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part)
        found = rows.mapInPandas(_scanner([(r[0], r[1]) for r in mine.collect()], q, min_words, error_rate, cols), "doc_id bigint, item_id bigint, run_words int, aligned_words int, edits int")
        out = found if out is None else out.unionByName(found)
    return out


def _scanner(held: list[tuple[int, str]], q: int, min_words: int, error_rate: float, cols: list[str]):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(held, q, min_words, error_rate)
        for b in batches:
            rows: list[tuple] = []
            some: list[tuple[int, str]] = []
            size = 0
            for d, t in zip(b["d"], b["t"]):
                some.append((d, t))
                size += len(t)
                if size > FLUSH_CHARS:
                    rows += index.scan(some)
                    some, size = [], 0
            if some:
                rows += index.scan(some)
            yield pd.DataFrame(rows, columns=cols)

    return scan


def leaked(docs: DataFrame, items: DataFrame, *, min_words: int = MIN_WORDS, **names) -> DataFrame:
    """Documents and items with at least ``min_words`` equal words in a row."""
    return find_leaks(docs, items, min_words=min_words, **names).where(f"run_words >= {min_words}").select("doc_id", "item_id").distinct()


def nearly_leaked(docs: DataFrame, items: DataFrame, *, min_words: int = MIN_WORDS, error_rate: float = 0.05, **names) -> DataFrame:
    """Documents and items that share ``min_words`` words or more, up to
    ``error_rate`` edits a character, with the words covered and the edits."""
    found = find_leaks(docs, items, min_words=min_words, error_rate=error_rate, **names)
    return found.groupBy("doc_id", "item_id").agg(F.max("aligned_words").alias("passage_words"), F.min("edits").alias("fewest_edits"))
