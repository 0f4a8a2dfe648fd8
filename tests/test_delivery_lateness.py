from tidelog.operators import delivery, lateness

S = "delivery_id bigint, batch_id bigint, log_stream_name string, event_timestamp bigint, message string, event_id string, ingestion_time bigint, salt string, k0 int"


def events(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], S)


ROWS = [
    (1, 1, "s", 3_600_000, "m", "Evt-1", 3_600_500),
    (2, 1, "s", 3_600_000, "m", " evt-1\t", 9_000_000),
    (3, 2, "s", 3_600_000, "M", "EVT-1", 9_000_000),
    (4, 2, "t", 3_600_000, "m", "evt-1", 3_700_000),
    (5, 2, None, 3_600_000, "m", "evt-1", 1),
    (6, 2, "s", 3_600_000, "m", None, 3_700_000),
    (7, 2, "s", 3_600_000, "m", None, 3_700_000),
    (8, 3, "s", None, "m", "evt-8", 3_700_000),
    (9, 3, "s", 7200, "m", "evt-9", 7_200_000 + 3_600_000 + 900_001),
    (10, 3, "s", 7_200_000_000_000_000, "m", "evt-10", None),
]


def test_copies_keep_the_first_and_nulls_match_nothing(spark):
    df = events(spark, ROWS)
    kept = {r.delivery_id for r in delivery.keep_first(df).collect()}
    assert kept == {1, 4, 5, 6, 7, 8, 9, 10}
    assert {tuple(r) for r in delivery.surplus_copies(df).collect()} == {(1, 2), (1, 3)}
    assert delivery.keep_first(df).columns == df.columns


def test_empty_and_hot_keys(spark):
    assert delivery.surplus_copies(events(spark, [])).count() == 0
    hot = spark.range(5000).selectExpr("id AS delivery_id", "'s' AS log_stream_name", "IF(id % 2 = 0, 'a', concat('b', id)) AS event_id")
    out = delivery.surplus_copies(hot)
    assert out.count() == 2499 and out.where("kept_id <> 0").count() == 0


def test_new_batch_against_stored(spark):
    df = events(spark, ROWS)
    stored = df.where("delivery_id = 1")
    assert {r.delivery_id for r in delivery.unseen(df, stored).collect()} == {4, 5, 6, 7, 8, 9, 10}


def test_partials_combine_in_any_order_and_retries_replace(spark):
    kept = delivery.keep_first(events(spark, ROWS))
    p = lateness.partial_counts(kept)
    once = sorted(map(tuple, lateness.combine(p).collect()))
    parts = [lateness.partial_counts(kept.where(f"batch_id = {b}")) for b in (3, 1, 2)]
    step = parts[0]
    for x in parts[1:] + [parts[1]]:
        step = lateness.merge_batch(step, x)
    assert sorted(map(tuple, lateness.combine(step).collect())) == once
    assert ("s", 7_200_000, 0, 1, 0) in once
    assert [tuple(r) for r in lateness.corrected(p).collect()] == [("s", 7_200_000, 0, 1, 0)]


def test_units_and_cutoff(spark):
    h = 3_600_000
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_123,), (1_700_000_000_123_456,), (None,)], "event_timestamp bigint")
    assert [r[0] for r in df.select(lateness.to_millis("event_timestamp")).collect()] == [1_700_000_000_000, 1_700_000_000_123, 1_700_000_000_123, None]
    edge = [(1, 1, "s", 200_000_000_000, "", "a", 0)]
    start = 200_000_000_000 // h * h
    rows = [(i, 1, "s", 200_000_000_000, "", str(i), start + h + lag) for i, lag in enumerate((900_000, 900_001, 24 * h, 24 * h + 1))]
    assert tuple(lateness.corrected(lateness.partial_counts(events(spark, rows))).collect()[0]) == ("s", start, 1, 3, 1)
    assert lateness.corrected(lateness.partial_counts(events(spark, edge).limit(0))).count() == 0
