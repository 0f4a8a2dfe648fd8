import random

import pytest

from tidelog.llm import leaks as L

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "a", "7") for b in ("ra", "st", "x", "ü", "")]


def brute(docs, items):
    out = set()
    docs = [x for x in docs if x[0] is not None]
    for i, p in items:
        pw = L.words_of(p)
        grams = {tuple(pw[k : k + 13]) for k in range(len(pw) - 12)}
        for d, t in docs:
            tw = L.words_of(t)
            if any(tuple(tw[k : k + 13]) in grams for k in range(len(tw) - 12)):
                out.add((d, i))
    return out


def test_equals_brute_force(spark):
    r = random.Random(8)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    items = [(i, text(r.randrange(5, 60))) for i in range(25)] + [(90, None), (91, ""), (92, "a b c d e f g h i j k l m"), (3, "other text under the same id " * 5)]
    docs = []
    for d in range(150):
        i, p = r.choice(items[:25])
        w = p.split()
        n = r.choice([12, 13, 14, 40])
        at = r.randrange(max(1, len(w) - n))
        piece = " ".join(w[at : at + n]).upper().replace(" ", r.choice([" ", ",\n ", " -- ", "_"]))
        docs.append((d, f"{text(20)} {piece} {text(r.randrange(0, 300))}"))
    docs += [(None, docs[0][1]), (500, None), (501, ""), (502, "A-B,C;D E F G H I J K L M!"), (503, "x " * 50_000 + items[1][1]), (504, docs[0][1]), (0, docs[0][1])]
    got = L.leaked(spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, d int"), spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, passage string, t int"))
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == brute(docs, items) and len(rows) == len(set(rows))


def edit_distance_infix(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i]
        for j in range(1, len(t) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
        row = new
    return min(row)


def test_infix_edits():
    r = random.Random(3)
    for _ in range(200):
        p = "".join(r.choice("abc ") for _ in range(r.randrange(1, 90)))
        t = "".join(r.choice("abc ") for _ in range(r.randrange(0, 60))) + p[: r.randrange(len(p) + 1)]
        assert L.infix_edits(p, t) == edit_distance_infix(p, t)


def test_near_leaks_equal_brute_force(spark):
    """Planted passages with edits: every pair within the budget is found, none beyond it."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(r.randrange(13, 22)))) for i in range(6)]
    docs = []
    for d in range(60):
        p = list(r.choice(items)[1])
        for _ in range(r.randrange(0, 12)):
            at = r.randrange(len(p))
            p[at : at + r.randrange(2)] = r.choice(["", "x", "z", "q"])
        docs.append((d, " ".join(word() for _ in range(8)) + " " + "".join(p) + " " + " ".join(word() for _ in range(8))))
    got = {(x.doc_id, x.item_id) for x in L.nearly_leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")).collect()}
    want = set()
    for i, p in items:
        ws = L.words_of(p)
        for d, t in docs:
            joined = " ".join(L.words_of(t))
            if any(edit_distance_infix(w, joined) <= int(len(w) * 0.05 + 1e-9) for w in (" ".join(ws[k : k + 13]) for k in range(len(ws) - 12))):
                want.add((d, i))
    assert got == want and 10 < len(want) < 60


def test_empty_tables_and_parts(spark, monkeypatch):
    base = [(k, " ".join(f"word{k}x{i}" for i in range(30))) for k in range(9)]
    d = spark.createDataFrame([(k, t) for k, t in base], "doc_id bigint, text string")
    i = spark.createDataFrame(base, "item_id bigint, passage string")
    assert L.leaked(d.limit(0), i).count() == 0 and L.leaked(d, i.limit(0)).count() == 0
    monkeypatch.setattr(L, "MAX_PASSAGE_CHARS", 600)
    assert {tuple(x) for x in L.leaked(d, i).collect()} == {(k, k) for k in range(9)}


def test_short_windows_lower_q(spark):
    i = L.Index([(1, "a b c d e f g h i j k l m")], 12, 13, 0.05)
    assert i.q == 12 and i.need[0] > 0
    assert L.Index([(1, "ab " * 13)], 12, 13, 0.1).q < 12
    with pytest.raises(ValueError):
        L.Index([(1, "ab " * 13)], 12, 13, 0.5)


def test_run_behind_a_stretch_with_more_words(spark):
    head, tail = "alpha bravo charlie delta", " ".join(f"shared{i}" for i in range(13))
    short = "a b c d e f g h ij kl mn op qrs"
    long = "p" * 15 + " " + "q" * (len(short) - 16)
    longer = "x y z x y z x y z x y z x y z x y z x y z w" * 3
    item = [(1, f"{head} {long} {tail}"), (2, f"{head} {'r' * 60} {'s' * (len(longer) - 61)} {tail}")]
    docs = [(1, f"{head} {short} {tail}"), (2, f"{head} {longer} {tail}"), (3, f"{head} {short} other {tail[:60]}")]
    got = L.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(item, "item_id bigint, passage string"))
    assert {tuple(x) for x in got.collect()} == brute(docs, item) == {(1, 1), (1, 2), (2, 1), (2, 2)}
