import math
import random

from tidelog.llm import mixing as M


def test_weights_and_exponents():
    tokens = {"a": 1000, "b": 100, "c": 0}
    w, total, e = M.weights(tokens, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 4, "c": 9})
    assert e == 1 and math.isclose(w["a"], 0.5 / 0.9) and math.isclose(total, min(1000 / w["a"], 400 / w["b"]))
    w, total, e = M.weights(tokens, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 4}, total=1500)
    assert 0 < e < 1 and w["b"] * total <= 400 * (1 + 1e-9) and math.isclose(w["b"] * total, 400, rel_tol=1e-6)
    w, total, e = M.weights(tokens, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}, total=10_000)
    assert total == 1400 and math.isclose(w["b"] * total, 400)
    assert M.weights({}, {"a": 1.0}, {"a": 1}) == ({}, 0.0, 1.0)
    nat = {"a": 0.9, "b": 0.1}
    x = M.exponent_for_entropy(nat, 0.6)
    raw = {k: v**x for k, v in nat.items()}
    assert math.isclose(M.entropy({k: v / sum(raw.values()) for k, v in raw.items()}), 0.6, abs_tol=1e-6)


def test_mix_reaches_shares_within_limits(spark):
    r = random.Random(2)
    docs = []
    for i in range(900):
        s = r.choice(["Big", "big ", "BIG", "small-one", "small_one"] if i % 9 == 0 else ["big"])
        docs.append((i, "word " * r.randrange(1, 60), s, "x"))
    docs += [(1000, None, "big", "x"), (1001, "", "big", "x"), (1002, "no source", None, "x"), (1003, "word " * 30, "unasked", "x"), (None, "x", "big", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, weight string")
    t = spark.createDataFrame([("m", "big", 0.6, 1), ("m", "small_one", 0.3, 3), ("m", "missing", 0.1, 2), (None, "big", 1.0, 1)], "mix_name string, doc_source string, target_share double, max_repeats int")
    chosen, report = M.mix(d, t)
    rows = chosen.collect()
    rep = {x.doc_source: x for x in report.collect()}
    assert len(rows) == len({x.doc_id for x in rows}) and all(x.copies <= {"big": 1, "small_one": 3}[x.doc_source] for x in rows)
    assert abs(rep["big"].reached_share - 2 / 3) < 0.01 and abs(rep["small_one"].reached_share - 1 / 3) < 0.01
    assert rep["missing"].mixed_tokens == 0 and rep["missing"].reached_share == 0
    again, _ = M.mix(d, t)
    assert sorted((x.doc_id, x.copies) for x in again.collect()) == sorted((x.doc_id, x.copies) for x in rows)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, doc_source string, target_share double, max_repeats int")
    chosen, report = M.mix(d, t)
    assert chosen.count() == 0 and report.collect()[0].mixed_tokens == 0
    one = spark.createDataFrame([(1, "a b", "a")], "doc_id bigint, text string, source string")
    chosen, report = M.mix(one, t.limit(0))
    assert chosen.count() == 0 and report.count() == 0


def test_long_text_is_counted_whole(spark):
    r = random.Random(1)
    texts = ["alpha beta\n" * 30_000, " ".join(r.choice(["it's", "größe", "x9", "naïve", "don't", "42", "...", "日本"]) for _ in range(60_000)), "x" * 200_000, "ab cd " * 40_000 + "  \n\t" * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    n = {x.doc_id: x.n_tokens for x in M.token_counts(d, ["doc_id"]).collect()}
    tok = M._tokenizer(M.TOKENIZER)
    assert n == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert len(M.pieces(texts[0])) > 3 and "".join(M.pieces(texts[1])) == texts[1]


def test_goals_bisect_the_exponent(spark):
    docs = [(i, "word " * 10, "big" if i % 10 else "small") for i in range(2000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 3)], "mix_name string, doc_source string, target_share double, max_repeats int")
    rep = {x.doc_source: x for x in M.mix(d, t, total="all")[1].collect()}
    assert 0 < rep["small"].exponent < 1 and rep["small"].most_copies == 3 and abs(rep["small"].reached_share - 0.3) < 0.01
    rep = M.mix(d, t, evenness=0.8)[1].collect()
    assert abs(M.entropy({x.doc_source: x.reached_share for x in rep}) - 0.8 * math.log(2)) < 0.01
    sharp = M.exponent_for_entropy({"a": 0.6, "b": 0.4}, 0.3)
    assert sharp > 1 and abs(M.entropy(M.powered({"a": 0.6, "b": 0.4}, sharp)) - 0.3) < 1e-6
