import random

from tidelog.operators import hierarchy as H

S = "trace_id string, span_id string, parent_span_id string, path string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], S)


def brute(rows):
    up = {}
    for t, s, p in rows:
        if t and s:
            p = (p or "").strip().lower()
            k = (t.lower(), s.lower())
            up[k] = max(filter(None, [up.get(k), p if p.strip("0") else None]), default=None)
    out = {}
    for t, s in up:
        chain, at = [s], s
        while True:
            p = up[(t, at)]
            if p is None or (t, p) not in up:
                break
            if len(chain) > len(up):
                chain = None
                break
            chain.append(p)
            at = p
        out[(t, s)] = chain
    down = {k: 0 for k in out}
    for (t, _), c in out.items():
        for a in (c or [])[1:]:
            down[(t, a)] += 1
    return {(t, s, c[-1] if c else "", len(c) - 1 if c else -1, down[(t, s)] if c else -1) for (t, s), c in out.items()}


def rows_at_random(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = f"T{r.randrange(3)}"
        p = r.choice([None, "", "0000", f"S{r.randrange(n // 2)}", f"s{max(0, i - 1)}", f"s{i}" if r.random() < 0.05 else f"S{r.randrange(n)}"])
        rows.append((t, r.choice([f"s{i}", f"S{i}", None]) if r.random() < 0.2 else f"s{i}", p))
    return rows + rows[: n // 10]


def test_both_ways_agree_with_brute_force(spark):
    for seed in (1, 2):
        rows = rows_at_random(120, seed)
        want = brute(rows)
        assert {tuple(r) for r in H.hierarchy(frame(spark, rows)).collect()} == want
        assert {tuple(r) for r in H.hierarchy(frame(spark, rows), max_group=30).collect()} == want


def test_paths_descendants_and_rings(spark):
    rows = [("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "d", "a"), ("t", "x", "y"), ("t", "y", "x"), ("t", "z", "y"), ("t", "q", "q")]
    for limit in (100, 2):
        h = H.hierarchy(frame(spark, rows), with_path=True, max_group=limit)
        assert {r.span_id: r.path for r in h.collect()} == {"a": "a", "b": "a/b", "c": "a/b/c", "d": "a/d", "x": None, "y": None, "z": None, "q": None}
        assert {(r.ancestor_id, r.descendant_id, r.distance) for r in H.descendants(h).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
        assert {(r.span_id, r.on_ring) for r in H.rings(frame(spark, rows), max_group=limit).collect()} == {("x", True), ("y", True), ("z", False), ("q", True)}
        assert {(r.span_id, r.cycle_id, r.n_members, r.back_edge) for r in H.rings(frame(spark, rows), max_group=limit).collect()} == {("x", "x", 2, True), ("y", "x", 2, False), ("z", "x", 2, False), ("q", "q", 1, True)}


def test_empty_and_deep(spark):
    assert H.hierarchy(frame(spark, [])).count() == 0
    chain = [("t", f"n{i}", f"n{i - 1}" if i else None) for i in range(1500)]
    for limit in (10_000, 100):
        r = H.hierarchy(frame(spark, chain), max_group=limit).where("span_id = 'n1499' or span_id = 'n0'").collect()
        assert {(x.span_id, x.span_depth, x.n_descendants) for x in r} == {("n1499", 1499, 0), ("n0", 0, 1499)}


def test_long_rings_and_tails(spark):
    ring = [("t", f"r{i:03d}", f"r{(i + 1) % 90:03d}") for i in range(90)]
    tail = [("t", f"z{i}", f"z{i - 1}" if i else "r007") for i in range(60)]
    got = H.rings(frame(spark, ring + tail)).collect()
    assert len(got) == 150 and {r.cycle_id for r in got} == {"r000"} and sum(r.on_ring for r in got) == 90 and [r.span_id for r in got if r.back_edge] == ["r000"]


def test_components(spark):
    rows = [("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "d", "none"), ("t", "x", "y"), ("t", "y", "x"), ("t", "z", "y")]
    got = {r.span_id: r.comp for r in H.components(H.links(frame(spark, rows))).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "x": "ring x", "y": "ring x", "z": "ring x"}
