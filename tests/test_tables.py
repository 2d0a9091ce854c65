"""Rollups, upserts, as-of attribution, monitors, the read model and inventory."""

import random

import pytest
from pyspark.sql import functions as F

from radiolake.operators import asof, blocked, inventory, monitors, observe, readmodel, upserts


def test_rollup(spark):
    rows = [(1, 5, 10.0, -70, 0), (1, 5, 30.0, None, None), (1, 5, 20.0, -60, 9), (2, 5, None, -50, 1)]
    df = spark.createDataFrame(rows, "session_id long, device_id long, ts double, rssi int, pdu_type int")
    got = {r["session_id"]: r for r in observe.observations(df, ["session_id", "device_id"], is_advertising=F.col("pdu_type").between(0, 7)).collect()}
    r = got[1]
    assert (r["packet_count"], r["adv_count"], r["data_count"], r["rssi_min"], r["rssi_max"], r["rssi_sum"], r["rssi_samples"], r["first_seen"], r["last_seen"]) == (3, 2, 1, -70, -60, -130, 2, 10.0, 30.0)
    assert (got[2]["first_seen"], got[2]["packet_count"]) == (None, 1)
    t = observe.totals(observe.observations(df, ["session_id", "device_id"], is_advertising=F.lit(True)), ["device_id"]).first()
    assert (t["packet_count"], t["rssi_avg"]) == (4, -60.0)


def test_histograms(spark):
    df = spark.createDataFrame([(1, 1, 37), (1, 1, 37), (2, 1, 37), (2, 1, 39), (2, 1, None)], "s long, d long, channel int")
    long = observe.histogram(df, ["s", "d"], "channel")
    assert observe.as_map(long, ["d"], "channel").first()["channel_histogram"] == {37: 3, 39: 1}
    maps = observe.as_map(long, ["s", "d"], "channel")
    assert observe.merged_maps(maps, ["d"], "channel_histogram").first()["channel_histogram"] == {37: 3, 39: 1}


def test_bad_packets_only(spark):
    obs = spark.createDataFrame([(1, 5, 5, 0, 3, 1.0, 9.0)], "d long, packet_count long, adv_count long, data_count long, rssi_samples long, first_seen double, last_seen double")
    bad = spark.createDataFrame([(2, 3, 4.0), (1, 1, 12.0)], "d long, bad_packet_count long, last_bad double")
    got = {r["d"]: (r["packet_count"], r["bad_packet_count"], r["first_seen"], r["last_seen"]) for r in observe.with_bad(obs, bad, ["d"]).collect()}
    assert got == {1: (5, 1, 1.0, 12.0), 2: (0, 3, 4.0, 4.0)}


def test_vocabulary_batches_combine(spark, as_rows):
    df = spark.createDataFrame([(1, 3, "a", 5.0), (1, 3, "a", 2.0), (1, 9, "a", 4.0)], "d long, t int, v string, ts double")
    parts = observe.vocabulary(df.limit(1), ["d", "t", "v"]).unionAll(observe.vocabulary(df.filter("ts < 5"), ["d", "t", "v"]))
    assert as_rows(observe.combined(parts, ["d", "t", "v"])) == [(1, 3, "a", 2.0, 5.0, 2), (1, 9, "a", 4.0, 4.0, 1)]


def test_freshness_by_session(spark, as_rows):
    rows = [(1, 1, 9_999_999_000.0), (1, 2, 9_999_999_000.0), (2, 3, 500.0), (2, 4, 499.0), (2, 1, 10.0)]
    obs = spark.createDataFrame(rows, "session_id long, device_id long, last_seen double")
    assert as_rows(observe.fresh(obs, "device_id", "session_id", F.lit(2), F.lit(495.0)), "device_id") == [(3,), (4,)]


def test_upserts(spark):
    rows = [(1, 1.0, "k", "a", None, "phone", None), (2, 5.0, "k", None, 7, "airtag", "first"), (3, 3.0, "k", "b", None, "apple_device", "second")]
    df = spark.createDataFrame(rows, "seq long, ts double, stable_key string, local_name string, vendor_id int, device_class string, vendor string").withColumns({"kind": F.lit("nrpa"), "model": F.lit(None).cast("string"), "appearance": F.lit(None).cast("int")})
    r = upserts.devices(df).first()
    assert (r["local_name"], r["vendor_id"], r["device_class"], r["vendor"], r["first_seen"], r["last_seen"]) == ("b", 7, "airtag", "first", 1.0, 5.0)
    tie = spark.createDataFrame([(1, "phone"), (2, "watch"), (3, "unknown")], "seq long, device_class string")
    assert tie.agg(upserts.most_specific("device_class", "seq")).first()[0] == "phone"
    a = spark.createDataFrame([(1, 1.0, "x", "rpa", None), (2, 2.0, "x", "rpa", 5), (3, 3.0, "x", "rpa", 6)], "seq long, ts double, address string, address_type string, device_id long")
    assert tuple(upserts.addresses(a).first()) == ("x", "rpa", 5, 1.0, 3.0)
    b = spark.createDataFrame([(1, 1, 1.0, 9, None, "n", 1, True, None), (1, 2, 2.0, 9, 4, None, None, False, "2M")], "session_id int, seq int, ts double, broadcast_id int, broadcaster_device_id int, broadcast_name string, bis_count int, encrypted boolean, phy string")
    r = upserts.broadcasts(b).first()
    assert (r["broadcaster_device_id"], r["broadcast_name"], r["bis_count"], r["phy"], r["encrypted"]) == (4, "n", 1, "2M", True)
    m = spark.createDataFrame([(1, 1, {"a": "x", "b": "y"}), (1, 2, {"a": "z"})], "k int, seq int, m map<string,string>")
    assert upserts.merged_identifiers(m, "k", "m", "seq").first()["m"] == {"a": "z", "b": "y"}


def test_sweeps_and_states(spark, as_rows):
    known = spark.createDataFrame([("A", "mine", "p1", True, True, 1.0, 2.0), ("B", None, "p2", True, False, 1.0, 2.0)], "serial_number string, name string, usb_port_id string, is_active boolean, removed boolean, first_seen double, last_seen double")
    sweep = spark.createDataFrame([("A", "other", "p9", 5.0), ("C", "new", "p3", 5.0)], "serial_number string, name string, usb_port_id string, seen_at double")
    assert as_rows(upserts.discovered(known, sweep)) == [("A", "mine", "p9", True, False, 1.0, 5.0), ("B", None, "p2", False, False, 1.0, 2.0), ("C", "new", "p3", True, False, 5.0, 5.0)]
    assert {r["is_active"] for r in upserts.discovered(known, sweep.limit(0)).collect()} == {False}
    log = spark.createDataFrame([(1, 1.0, 1, "pending"), (1, 3.0, 2, "response"), (2, 1.0, 3, "pending")], "id int, at double, seq int, status string")
    assert as_rows(upserts.current_state(log, "id", "at", "seq"), "id", "status") == [(1, "response"), (2, "pending")]
    kids = spark.createDataFrame([(1, 10), (2, 11)], "c int, p int")
    assert as_rows(upserts.without_parents(kids, spark.createDataFrame([(10,)], "id int"), "p")) == [(2, 11)]


@pytest.mark.parametrize("block", [7, 100_000])
def test_attribution(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice(["s1", "s1", "s1", "s2", None]), 37 + rng.randrange(2), 10.0 + i * 0.7 + rng.uniform(-1, 1), rng.choice([None, 1, 2, 3]), rng.random() < 0.6) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, source string, channel int, ts double, device_id long, crc_ok boolean")
    got = {r["seq"]: r["credited"] for r in asof.attribute(df, ["source", "channel"], "seq", "ts", "crc_ok", "device_id", block=block).collect()}
    last, want = {}, {}
    for seq, source, channel, ts, device, ok in rows:
        if ok and device is not None:
            last[source, channel] = (ts, device)
        elif not ok:
            held = last.get((source, channel))
            want[seq] = held[1] if held and ts - held[0] <= 2.0 else None
    assert got == want


def test_previous_over_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), float(rng.randrange(1000))) for _ in range(300)]
    got = sorted((r["k"] or 0, r["t"], -1.0 if r["previous"] is None else r["previous"]) for r in blocked.with_previous(spark.createDataFrame(rows, "k int, t double"), ["k"], "t", 50).collect())
    want = []
    for k in (1, 2, None):
        times = sorted(t for x, t in rows if x == k)
        want += [(k or 0, t, p) for t, p in zip(times, [-1.0, *times])]
    assert got == sorted(want)


def test_rolling_window(spark):
    rows = [(1, 0, -65, True), (1, 4_000_000, -75, True), (1, 5_000_000, -99, False), (1, 9_100_000, -60, True), (2, 1, -50, False)]
    df = spark.createDataFrame(rows, "d int, us long, rssi int, crc_ok boolean")
    for seconds in (3600, 2):
        got = {(r["d"], r["us"]): (r["recent_rssi"], r["good"], r["bad"]) for r in monitors.rolling(df, ["d"], "us", "rssi", "crc_ok", block_seconds=max(5, seconds)).collect()}
        assert got == {(1, 0): (-65.0, 1, 0), (1, 4_000_000): (-70.0, 2, 0), (1, 5_000_000): (-70.0, 2, 1), (1, 9_100_000): (-60.0, 1, 1), (2, 1): (None, 0, 1)}


def test_stalls_and_peaks(spark, as_rows):
    df = spark.createDataFrame([("a", t) for t in (0.0, 50.0, 111.0, 86_400.0 * 3)] + [("b", 5.0), (None, 1.0), ("a", None)], "s string, ts double")
    assert as_rows(monitors.stalls(df, "s", "ts")) == [("a", 50.0, 111.0), ("a", 111.0, 259_200.0)]
    assert as_rows(monitors.silent_now(df, "s", "ts", F.lit(60.0), 50.0), "s") == [("b",)]
    c = spark.createDataFrame([(37, 0.0, 30), (37, 0.4, 2), (37, 1.0, 1), (37, 3.0, 0)], "channel int, at double, n int")
    assert [round(r["peak"], 6) for r in monitors.decayed_peak(c, "channel", "at", "n").orderBy("at").collect()] == [30.0, 30.0, 17.5, 0.0]


def test_templates(spark):
    lines = spark.createDataFrame([("INFO", f"flush {i} rows", 10_000_000 * i) for i in range(5)] + [("INFO", "other", 7)], "level string, body string, us long")
    got = {r["template"]: r for r in monitors.templates(lines, ["level"], "body", "us").collect()}
    r = got["flush <num> rows"]
    assert (r["n"], r["interval_avg"]) == (5, 10.0) and r["interval_jitter"] < 0.001 and got["other"]["interval_avg"] is None


def test_read_model(spark, as_rows):
    everyone = spark.createDataFrame(
        [(1, "Kit", None, "HA", "nrpa", 1.0, "hid"), (2, None, None, "HA", "nrpa", 2.0, None), (3, "L", None, "Two", "nrpa", 1.0, None), (4, "R", None, "Two", "nrpa", 2.0, None), (5, None, None, "Two", "nrpa", 3.0, None), (6, None, "airtag", None, "nrpa", 3.0, None), (7, None, None, None, "nrpa", 3.0, "x")],
        "id long, user_name string, user_device_class string, local_name string, kind string, last_seen double, device_class string",
    )
    members = spark.createDataFrame([(9, 6, 0.95), (9, 7, 0.95)], "cluster_id long, device_id long, score double")
    got = {r["id"]: (r["user_name"], r["device_class"]) for r in readmodel.propagated(everyone, everyone, members).collect()}
    assert got == {1: ("Kit", "hid"), 2: ("Kit", None), 3: ("L", None), 4: ("R", None), 5: (None, None), 6: (None, "airtag"), 7: (None, "airtag")}
    facts = spark.createDataFrame([(6, "nrpa", 10, 10, 0, -50.0, -60, -40, 5.0), (7, "public_mac", 30, 30, 0, -70.0, -80, -60, 4.0), (8, "nrpa", 1, 1, 0, None, None, None, 1.0)], "device_id long, kind string, packet_count long, adv_count long, data_count long, rssi_avg double, rssi_min int, rssi_max int, last_seen double")
    rows = {r["device_id"]: r for r in readmodel.collapsed(facts, members).collect()}
    assert set(rows) == {7, 8}
    assert (rows[7]["packet_count"], rows[7]["rssi_avg"], rows[7]["rssi_min"], rows[7]["rssi_max"], rows[7]["last_seen"], rows[7]["members"]) == (40, -65.0, -80, -40, 5.0, 2)
    assert {r["device_id"] for r in readmodel.collapsed(facts, members, 0.99).collect()} == {6, 7, 8}
    groups = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id long, parent_group_id long")
    assert as_rows(readmodel.subtree(groups, 1)) == [(1, 0), (2, 1), (3, 2)]


def test_sort_keys(spark):
    df = spark.createDataFrame([(1, "b", "x", None, -50.0, "v", None, 5, 1.0), (2, None, "A", "nrpa", None, None, "a", 9, None)], "id int, device_class string, label string, kind string, rssi_avg double, vendor string, oui_vendor string, packet_count int, last_seen double")
    order = {name: [r["id"] for r in df.orderBy(key).collect()] for name, key in readmodel.sort_keys().items()}
    assert order == {"Type": [1, 2], "Name": [2, 1], "Address kind": [2, 1], "RSSI (avg)": [1, 2], "Vendor": [2, 1], "Packets": [2, 1], "Last seen": [1, 2]}


def test_inventory(spark, as_rows):
    rows = [(1, 255, "4C0010025BE0", 3), (2, 255, "4C0007070E0E202B9F8000", 2), (3, 255, "5900AA", 1), (1, 3, "0A18", 9)]
    v = spark.createDataFrame(rows, "device_id long, ad_type int, v string, count long").withColumn("ad_value", F.unhex("v"))
    assert as_rows(inventory.vendors(v)) == [(0x4C, 5, 2), (0x59, 1, 1)]
    assert as_rows(inventory.message_types(v)) == [(7, "ProximityPairing", 2, 1), (16, "NearbyInfo", 3, 1)]
    assert as_rows(inventory.models(v)) == [("AirPods Pro 1st gen", 1)] and as_rows(inventory.actions(v)) == [("MeshRelay", 1)]
    held = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (1, "y"), (2, "y"), (2, "y")], "device_id long, payload string")
    assert [tuple(r) for r in inventory.shared_payloads(held, 2).collect()] == [(1, 2, 2), (1, 3, 1)]
