import random

from tidelog.llm import subjects as S

VOCAB = {
    "law": (["privacy notice", "audit trail"], ["breached the agreement", "lacked a lawful basis"]),
    "sport": (["match report", "relay team"], ["missed the final whistle", "set a season record"]),
    "storage": (["tape shelf", "object bucket"], ["deleted blobs early", "filled up overnight"]),
}
FILLER = ["No further action for now.", "Please add your notes.", "See the earlier thread for the story."]


def corpus(n, seed):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        main = r.choice(list(VOCAB))
        parts, count = [], {}
        for _ in range(r.randrange(4, 9)):
            c = main if r.random() < 0.85 else r.choice(list(VOCAB))
            count[c] = count.get(c, 0) + 1
            np, vp = VOCAB[c]
            parts.append(f"Graphs show the {r.choice(np)} {r.choice(vp)} {r.randrange(99)} times.")
            if r.random() < 0.4:
                parts.append(r.choice(FILLER))
        total = sum(count.values())
        truth[i] = {c for c, k in count.items() if 4 * k >= total}
        docs.append((i, " ".join(parts), "x"))
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(500, 1)
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, FILLER[0], "x"), (0, docs[0][1], "x")]
    labels = [(i, s, "op") for i in range(150) for s in truth[i]]
    labels[3] = (labels[3][0], "sport", "wrong")
    d = spark.createDataFrame(docs, "doc_id bigint, text string, cls string")
    lab = spark.createDataFrame(labels + [(None, "law", "op"), (7, None, "op")], "doc_id bigint, subject string, labelled_by string")
    got: dict[int, set] = {}
    rows = S.subjects(d, lab).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i) == truth[i] for i in range(150, 500)) >= 340
    assert not {1000, 1001, 1002} & set(got)
    areas = spark.createDataFrame([("law",), ("sport",), ("storage",), ("none_such",)], "subject string")
    comp = {r.subject: r.documents for r in S.composition(d, S.subjects(d, lab), areas).collect()}
    assert comp["none_such"] == 0 and comp["law"] > 50


def test_no_labels_no_rows(spark):
    d = spark.createDataFrame([(1, "the tape shelf filled up overnight.")], "doc_id bigint, text string")
    lab = spark.createDataFrame([], "doc_id bigint, subject string")
    assert S.subjects(d, lab).count() == 0 and S.subjects(d.limit(0), lab).count() == 0


def test_rules_are_spread_over_all_documents(spark):
    r = random.Random(3)

    def about(c, more=""):
        np, vp = VOCAB[c]
        return " ".join(f"The {r.choice(np)} {r.choice(vp)}{more}." for _ in range(3))

    docs = [(i, about(list(VOCAB)[i % 3])) for i in range(20_000)]
    docs += [(i, about("storage", " behind the zeppelin")) for i in range(20_000, 20_040)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, list(VOCAB)[i % 3]) for i in range(20_000)], "doc_id bigint, subject string")
    assert ("zeppelin",) in S.fit(d, lab).table


def test_mined_sets_decide_where_single_words_do_not(spark):
    r = random.Random(5)
    nouns, verbs = ["table", "ledger", "gate", "frame"], ["locked", "closed", "moved", "opened"]
    # the class follows from noun and verb together: neither tells it alone
    cls = {(n, v): ["law", "sport"][(i + j) % 2] for i, n in enumerate(nouns) for j, v in enumerate(verbs)}
    docs, labels = [], []
    for i in range(600):
        c = r.choice(["law", "sport"])
        pairs = r.choices([k for k, x in cls.items() if x == c], k=4)
        docs.append((i, " ".join(f"The {n} {v} again." for n, v in pairs) + f" Our {c} note."))
        labels.append((i, c, "op"))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = S.classed_sentences(d.withColumn("c", S.F.when(S.F.col("text").contains("law note"), "law").otherwise("sport")), "c")
    rules = S.mine_rules(found, ["law", "sport"], min_confidence=0.3)
    for (n, v), c in cls.items():
        k, raw, spoken = rules.evidence(["the", n, v, "again"])
        assert rules.classes[k] == c and raw > 0.9 and spoken >= 2


def test_calibration_follows_the_labels():
    curve = S.calibrated({(1, 19): (1000, 950), (2, 19): (1000, 100), (2, 3): (1000, 900)})
    assert curve[1][19] > 0.9 and abs(curve[2][19] - curve[2][3]) < 0.01, "falling bins are pooled"
    assert all(a <= b for row in curve for a, b in zip(row, row[1:]))
    assert S.calibrated({})[1][19] < 0.5 <= S.calibrated({})[2][10]


def test_long_sentences_are_cut_into_transactions(spark):
    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    text = " ".join(words) + "."
    d = spark.createDataFrame([(i, text, "law") for i in range(40)], "doc_id bigint, text string, c string")
    for limit in (10_000, 1):
        S.MAX_LITERALS = limit
        rules = S.mine_rules(S.classed_sentences(d, "c"), ["law", "sport"])
        assert all((w,) in rules.table for w in words) and rules.about(words) == 0
    S.MAX_LITERALS = 10_000
