import json

from tidelog.operators import nested as N


def test_labels_of_every_shape():
    rec = {"a": [{"x": 1, "y": None}, None, 3, {"b": [{"c": []}]}, [{"z": 1}]], "s": json.dumps({"k": [{"m": 1}]}), "o": {"p": [{"q": 1}]}}
    got = {(p, q, sum(v is not None for v in o.values())) for p, q, _, o in N.labels(rec)}
    assert got == {("a[0]", "", 1), ("a[3]", "", 1), ("a[3].b[0]", "a[3]", 1), ("a[4][0]", "", 1), ("s.k[0]", "", 1), ("o.p[0]", "", 1)}


def test_bare_object_counts_as_array_of_one(spark):
    rows = [("t", 1, '{"a":[{"x":1}]}', 0), ("t", 2, '{"a":{"x":1,"b":[{"y":2}]}}', 0), ("u", 3, '{"a":{"x":1}}', 0), ("t", 4, "{broken", 0), ("t", 5, None, 0), ("t", 6, "", 0), ("t", 7, '{"a": NaN}', 0), ("t", 8, "[[{}]]", 0), (None, 9, '[{"b":1}]', 0)]
    df = spark.createDataFrame(rows, "s string, i bigint, t string, p int")
    out = N.flatten_records(df, source="s", row_id="i", text="t")
    got = {(r.source_table, r.row_id, r.child_path, r.parent_path, r.n_fields) for r in out.collect()}
    assert got == {("t", 1, "a[0]", "", 1), ("t", 2, "a[0]", "", 2), ("t", 2, "a[0].b[0]", "a[0]", 1), ("t", 8, "[0][0]", "", 0), (None, 9, "[0]", "", 1)}
    flat = N.flat_table(out, "a[]", {"x": "int"}).collect()
    assert {(r.row_id, r.x) for r in flat} == {(1, 1), (2, 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "s string, i bigint, t string")
    assert N.flatten_records(df, source="s", row_id="i", text="t").count() == 0


def test_round_trip_of_fields(spark):
    rec = {"a": [{"n": i, "t": f"é{i}\n", "f": i / 4, "z": None} for i in range(50)]}
    df = spark.createDataFrame([("t", 1, json.dumps(rec))], "s string, i bigint, t string")
    out = N.flatten_records(df, source="s", row_id="i", text="t").collect()
    assert [json.loads(r.fields) for r in sorted(out, key=lambda r: int(r.child_path[2:-1]))] == rec["a"]


def test_mixed_below_mixed_is_found_in_any_spelling(spark):
    rows = [("t", 1, '{"a":{"b":[{"c":{"x":1}}]}}'), ("t", 2, '{"a":[{"b":{"c":[{"x":1}]}}]}')]
    out = N.flatten_records(spark.createDataFrame(rows, "s string, i bigint, t string"), source="s", row_id="i", text="t")
    got = {(r.row_id, r.child_path, r.parent_path) for r in out.collect()}
    assert got == {(i, c, q) for i in (1, 2) for c, q in (("a[0]", ""), ("a[0].b[0]", "a[0]"), ("a[0].b[0].c[0]", "a[0].b[0]"))}


def test_records_of_a_table_are_counted_exactly(spark, tmp_path):
    from tidelog.queries import p5_tables

    spark.range(5000).selectExpr("id AS hit_id", "'{\"a\":[{\"x\":1},{\"x\":2}]}' AS _source").write.parquet(str(tmp_path / "es_hit.parquet"))
    spark.range(3).selectExpr("id AS seq", "'{}' AS raw").write.parquet(str(tmp_path / "log_entry.parquet"))
    got = [(r.source_table, r.table_path, r.n_rows, r.n_records) for r in p5_tables(spark, str(tmp_path)).collect()]
    assert got == [("es_hit", "a[]", 10_000, 5000)]
