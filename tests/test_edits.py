"""Edits as folds, lookups, ordered sets, groups without end and the bus: odd rows."""

from pyspark.sql import functions as F

from radiolake.operators import ingest, observe, readmodel, upserts
from radiolake.streaming import bus


def test_overrides_clear_and_stay(spark, as_rows):
    rows = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (None, "z", None)], "id long, user_name string, notes string")
    edits = spark.createDataFrame([(1, "user_name", None, 5), (1, "user_name", "early", 2), (2, "user_name", "b", 1), (2, "other", "no", 2), (None, "notes", "n", 1)], "id long, field string, value string, seq long")
    assert as_rows(upserts.overridden(rows, edits, ["user_name", "notes"]), "id", "user_name", "notes") == [(None, "z", None), (1, None, "x"), (2, "b", "y")]
    assert as_rows(upserts.overridden(rows, edits.limit(0), ["user_name"]), "id", "user_name") == [(None, "z"), (1, "a"), (2, None)]


def test_upkeep(spark, as_rows):
    r = spark.createDataFrame([(1, "n", False, 4, 9.0), (2, None, True, None, None)], "id long, name string, removed boolean, stall_count long, last_stall_at double")
    log = [(1, "stall", None, 1.0), (1, "stall", None, 3.0), (2, "stall", None, 1.0), (2, "clear", None, 2.0), (2, "stall", None, 5.0), (2, "restore", None, 3.0), (2, "remove", None, 1.0), (1, "name", None, 2.0)]
    got = as_rows(upserts.maintained(r, spark.createDataFrame(log, "id long, op string, value string, seq double")), "id", "name", "removed", "stall_count", "last_stall_at")
    assert got == [(1, None, False, 6, 3.0), (2, None, False, 1, 5.0)]


def test_ends_and_keys(spark, as_rows):
    s = spark.createDataFrame([(1, None, "old"), (2, 5.0, None)], "id long, ended_at double, notes string")
    ends = spark.createDataFrame([(1, 7.0, None, 2), (1, 6.0, "new", 1)], "id long, at double, notes string, seq long")
    assert as_rows(upserts.ended(s, ends), "id", "ended_at", "notes") == [(1, 7.0, "new"), (2, 5.0, None)]
    k = spark.createDataFrame([("AB" * 16, "one", None, 1), ("ab" * 16, "two", 4, 2), ("zz", "no", 1, 3), (None, "no", 1, 4)], "key_hex string, label string, device_id long, seq long")
    assert as_rows(upserts.keys_added(k)) == [("ab" * 16, "one", 4)]


def test_lookups(spark, as_rows):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "stable_key string, id long")
    wanted = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "stable_key string")
    assert as_rows(readmodel.looked_up(wanted, d, "stable_key", "id")) == [(None, None, False), ("a", 1, True), ("c", None, False)]
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, None), (5, 6)], "x long, y long")
    ids = spark.createDataFrame([(1,), (3,), (4,)], "device_id long")
    assert as_rows(readmodel.at_either_end(ids, links, "x", "y"), "device_id", "x", "y") == [(1, 1, 2), (1, 2, 1), (3, 3, 3), (4, 4, None)]


def test_groups_have_no_depth_limit_and_rings_end(spark):
    chain = spark.createDataFrame([(1, 50)] + [(i, i - 1) for i in range(2, 51)], "id long, parent_group_id long")
    got = {r["id"]: r["depth"] for r in readmodel.subtree(chain, 1).collect()}
    assert got == {i: i - 1 for i in range(1, 51)}


def test_values_in_order_met(spark, as_rows):
    rows = spark.createDataFrame([(1, "b", 2.0), (1, "a", 3.0), (1, "b", 9.0), (1, "c", None), (1, None, 0.0), (2, "x", None)], "d long, v string, ts double")
    assert as_rows(observe.in_order_met(rows, "d", "v", "ts")) == [(1, ["b", "a", "c"]), (2, ["x"])]


def test_packet_log_fills_what_is_missing(spark, as_rows):
    p = spark.createDataFrame([("AA:BB:CC:DD:EE:FF", False, True, 1.0, None, None, "ODD"), ("", False, True, 1.0, 1, 1, "ADV_IND"), ("aa:bb:cc:dd:ee:ff", True, False, 1.0, 1, 1, "ADV_IND")], "adv_addr string, is_random boolean, crc_ok boolean, ts double, rssi int, channel int, pdu_type string")
    assert as_rows(ingest.packet_log(p, 3), "session_id", "rssi", "channel", "pdu_type") == [(3, 0, 0, 255)]


def test_a_failing_subscriber_keeps_nobody_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(7).write.mode("overwrite").parquet(str(tmp_path / "in"))
    seen = []

    def broken(batch, number):
        raise ValueError("no")

    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    bus.publish(stream, {"broken": broken, "count": lambda b, n: seen.append(b.agg(F.sum("id")).first()[0])}, str(tmp_path / "cp")).awaitTermination()
    assert seen == [21]
