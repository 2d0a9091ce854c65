import json
import struct

import pytest
from pyspark.sql import functions as F

from radiolake.functions.drain import DrainTree
from radiolake.operators import ingest, mining
from radiolake.sources import capture, dimensions, dissected, profiles, settings, sinks


def document(ms, pdu="0", addr="AA:BB:CC:DD:EE:01", tx="1", rssi="-60", ad=None, **layers):
    key = "btcommon_btcommon_eir_ad_entry_"
    btle = {"btle_btle_advertising_header_pdu_type": pdu, "btle_btle_advertising_address": addr, "btle_btle_advertising_header_randomized_tx": tx} | {key + k: v for k, v in (ad or {}).items()}
    return json.dumps({"timestamp": str(ms), "layers": {"btle": btle, "nordic_ble": {"nordic_ble_nordic_ble_channel": "37", "nordic_ble_nordic_ble_rssi": rssi}, **layers}})


@pytest.fixture
def packets(spark, tmp_path):
    lines = [
        '{"index": {"_type": "x"}}', "not json", document(1_000_000, ad={"device_name": "Tag", "uuid_16": ["0x180a", "6162"], "company_id": "0x004c", "data": "12:01:00"}),
        document(2_000_000, pdu="0x07", ad={"uuid_16": "0x1852", "type": ["22"], "service_data": "ac:65:b8", "broadcast_name": "Hall"}), document(3_000_000, addr=["c0:00:00:00:00:02"], ad={"appearance": "0x0040"}),
        document(4_000_000, tx=None, addr="01:02:03:04:05:06"), json.dumps({"timestamp": "5", "layers": {"frame": {}}}), document(6_000_000, addr=None), json.dumps({"timestamp": "7000", "layers": {"btle": {"btle_btle_advertising_header_pdu_type": "ODD"}, "btle_rf": {"btle_rf_btle_rf_channel": "8", "btle_rf_btle_rf_signal_dbm": "-5"}, "nordic_ble": {"nordic_ble_nordic_ble_crcok": "0"}}}),
    ]
    (tmp_path / "x.ndjson").write_text("\n".join(lines))
    return dissected.packets(dissected.documents(spark, str(tmp_path))).withColumn("seq", F.col("ts").cast("long"))


def test_dissected(packets):
    got = {r["ts"]: r for r in packets.collect()}
    assert sorted(got) == [7.0, 1000.0, 2000.0, 3000.0, 4000.0, 6000.0]
    r = got[1000.0]
    assert (r["channel"], r["rssi"], r["pdu_type"], r["adv_addr"], r["is_random"], r["name"], r["uuids"], r["company"], r["data"]) == (37, -60, "ADV_IND", "aa:bb:cc:dd:ee:01", True, "Tag", [0x180A, 6162], 0x4C, "12:01:00")
    assert got[2000.0]["pdu_type"] == "ADV_EXT_IND" and got[2000.0]["uuids"] == [0x1852] and got[3000.0]["adv_addr"] == "c0:00:00:00:00:02" and got[4000.0]["is_random"] is None
    odd = got[7.0]
    assert (odd["pdu_type"], odd["channel"], odd["rssi"], odd["crc_ok"], odd["uuids"]) == ("ODD", 8, -5, False, [])


def test_ingest(packets, tmp_path):
    t = ingest.tables(packets, 5)
    devices = {r["stable_key"]: r for r in t["devices"].collect()}
    assert set(devices) == {"anon:aa:bb:cc:dd:ee:01", "rs:c0:00:00:00:00:02", "anon:01:02:03:04:05:06"}
    d = devices["anon:aa:bb:cc:dd:ee:01"]
    assert (d["local_name"], d["device_class"], d["vendor_id"], d["first_seen"], d["last_seen"]) == ("Tag", "apple_device", 0x4C, 1000.0, 2000.0)
    assert devices["rs:c0:00:00:00:00:02"]["device_class"] == "phone" and devices["rs:c0:00:00:00:00:02"]["kind"] == "random_static_mac"
    entries = {(r["stable_key"], r["ad_type"], bytes(r["ad_value"]).hex()): r["count"] for r in t["ad_history"].collect()}
    assert entries["anon:aa:bb:cc:dd:ee:01", 255, "4c00120100"] == 1 and entries["anon:aa:bb:cc:dd:ee:01", 9, b"Tag".hex()] == 1 and len(entries) == 6
    b = t["broadcasts"].first()
    assert (b["broadcast_id"], b["broadcast_name"], b["broadcaster_device_id"], b["encrypted"]) == (0xB865AC, "Hall", "anon:aa:bb:cc:dd:ee:01", False)
    assert {r["stable_key"]: r["packet_count"] for r in t["observations"].collect()}["anon:aa:bb:cc:dd:ee:01"] == 2
    assert ingest.report(packets).first().asDict() == {"packets": 6, "corrupted": 1, "without_address": 1, "devices": 3, "addresses": 3, "extended": 1, "announcing": 1}
    counts = sinks.swap({n: t[n] for n in ("devices", "addresses")}, str(tmp_path / "out"))
    assert counts == {"devices": 3, "addresses": 3}
    assert sinks.swap({"devices": t["devices"].limit(1)}, str(tmp_path / "out")) == {"devices": 1}
    assert packets.sparkSession.read.parquet(str(tmp_path / "out/devices.parquet")).count() == 1
    assert not list((tmp_path / "out").glob("_staged*"))


def test_capture_files(spark, tmp_path):
    record = lambda t, data, order="<": struct.pack(order + "IIII", t, 500_000, len(data), len(data)) + data
    head = lambda order, dlt: (b"\xd4\xc3\xb2\xa1" if order == "<" else b"\xa1\xb2\xc3\xd4") + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, dlt)
    (tmp_path / "a.pcap").write_bytes(head("<", 272) + record(5, b"abc") + record(6, b"d") + struct.pack("<IIII", 7, 0, 0, 0) + record(8, b"lost"))
    (tmp_path / "b.pcap").write_bytes(head(">", 256) + record(9, b"xy", ">") + struct.pack(">IIII", 9, 0, 10, 10) + b"cut")
    (tmp_path / "c.pcap").write_bytes(b"junk")
    capture.register(spark)
    got = sorted((r["source"], r["ts"], r["dlt"], bytes(r["data"])) for r in spark.read.format("capture").load(str(tmp_path)).collect())
    assert got == [("a", 5.5, 272, b"abc"), ("a", 6.5, 272, b"d"), ("b", 9.5, 256, b"xy")]


def test_makers(spark, as_rows):
    lines = spark.createDataFrame([(0, "AA:BB:CC\tThree"), (1, "AA:BB:CC\tLater"), (2, "AA:BB:CC:D0:00:00/28\tFour"), (3, "AA:BB:CC:DD:E0:00/36\tFive"), (4, "no tab"), (5, "AA:BB\tshort")], "seq int, value string")
    table = dimensions.prefixes(lines)
    a = spark.createDataFrame([("aa:bb:cc:dd:ee:01",), ("aa:bb:cc:d1:00:00",), ("aa:bb:cc:00:00:00",), ("00:00:00:00:00:00",), (None,)], "address string")
    assert as_rows(dimensions.maker(a, "address", table)) == sorted([("aa:bb:cc:dd:ee:01", "Five"), ("aa:bb:cc:d1:00:00", "Four"), ("aa:bb:cc:00:00:00", "Three"), ("00:00:00:00:00:00", None), (None, None)], key=lambda t: (t[0] is not None, str(t)))


def test_sweeps(spark, as_rows):
    ports = spark.createDataFrame([("h", "/dev/cu.usbserial-1"), ("h", "/dev/cu.SLAB_USBtoUART"), ("i", "/dev/cu.SLAB_USBtoUART")], "host string, path string")
    assert as_rows(dimensions.without_aliases(ports), "host", "path") == [("h", "/dev/cu.usbserial-1"), ("i", "/dev/cu.SLAB_USBtoUART")]
    p = spark.createDataFrame([("p1", "AB12", "0x1"), ("p2", None, "0x14"), ("p3", "zz", None)], "path string, serial string, location string")
    usb = spark.createDataFrame([(1, "xxAB12", "0x1410", "dongle"), (2, None, "0x1420", "hub")], "usb_id int, usb_serial string, usb_location string, product string")
    assert as_rows(dimensions.described(p, usb), "path", "usb_id", "product") == [("p1", 1, "dongle"), ("p2", 2, "hub"), ("p3", None, None)]


def test_profiles(spark, tmp_path):
    p = profiles.load()
    assert set(p) == {"airpods", "airtag", "apple_device", "apple_watch", "default", "hearing_aid", "iphone"}
    assert p["airtag"]["threshold"] == 0.7 and p["airtag"]["decisive_threshold"] == 0.95 and list(p["default"]["weights"])[0] == "service_uuid_match"
    assert profiles.parameter(p, "rotation_cohort", "expected", 900.0) == {"airtag": 30.0, "iphone": 30.0}
    (tmp_path / "x.toml").write_text('[x]\nrequired = ["a"]\nweights = { a = 1 }\n')
    assert profiles.load(tmp_path)["x"]["required_eventually"] == ["a"] and profiles.rules(spark, profiles.load(tmp_path)).first()["eventually"]


def test_settings(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text("[cluster]\ncollapse_threshold = 0.5\nmax_per_class = 1\n")
    got = settings.load(path, {"RADIOLAKE_CAPTURE_KEEP_PACKETS": "yes", "RADIOLAKE_CLUSTER_COLLAPSE_THRESHOLD": "nine", "RADIOLAKE_LOG_LEVEL": "loud"})
    assert (got["cluster.collapse_threshold"], got["cluster.max_per_class"], got["capture.keep_packets"], got["log.level"]) == (0.5, 1500, True, "info")
    settings.save(got, path)
    assert settings.load(path, {}) == got


def test_drain_tree():
    t = DrainTree(most_groups=3)
    assert [t.add(f"flush took {i} ms in total")[1] for i in (1, 2)] == [True, False]
    assert t.add("flush took 3 ms in total")[2] == "flush took <*> ms in total"
    assert t.add("quite another line")[1] and t.add("") == (3, True, "")
    t.add("one more group of many words here"), t.add("and yet another one")
    assert t.add("flush took 4 ms in total")[1]  # forgotten in between


def test_mined(spark):
    lines = spark.createDataFrame([("a", f"job {w} is done now", i) for i, w in enumerate(["x", "y", "x", "z"])] + [("b", "alone", 9), ("a", None, 1)], "source string, body string, us long")
    got = {(r["source"], r["template"]): r["n"] for r in mining.mine(lines, "source", "body", "us").collect()}
    assert got == {("a", "job x is done now"): 2, ("a", "job y is done now"): 1, ("a", "job z is done now"): 1, ("b", "alone"): 1} or got == {("a", "job <*> is done now"): 4, ("b", "alone"): 1}


def test_text_sink(spark, tmp_path):
    sinks.text(spark.range(25).selectExpr("cast(id as string) as value").coalesce(1), str(tmp_path / "t"), most_lines=10)
    assert len(list((tmp_path / "t").glob("part*"))) == 3


def test_swap_is_never_without_a_table(spark, tmp_path):
    root = str(tmp_path)
    sinks.swap({"t": spark.range(3)}, root)
    (tmp_path / "t.parquet").rename(tmp_path / "_old-t.parquet")  # cut short between the moves
    assert sinks.table(spark, root, "t").count() == 3
    sinks.swap({"t": spark.range(5)}, root)
    assert sinks.table(spark, root, "t").count() == 5 and not list(tmp_path.glob("_*"))


def test_text_parts_by_size(spark, tmp_path):
    words = ["é" * (i % 7) for i in range(300)] + ["long" * 30]
    df = spark.createDataFrame(list(enumerate(words)), "no long, value string")
    told = {r["part"]: (r["lines"], r["bytes"]) for r in sinks.text_by_size(df, str(tmp_path / "t"), 100, "no", block=40).collect()}
    sizes = {p.name.split("=")[1]: sum(f.stat().st_size for f in p.glob("part*")) for p in (tmp_path / "t").glob("part=*")}
    assert sizes == {k: n for k, (_, n) in told.items()} and sum(n for n, _ in told.values()) == 301
    assert max(n for k, n in sizes.items() if "-" not in k) <= 100 and [n for k, n in sizes.items() if "-" in k] == [121]


def ng(order, *interfaces, packets=()):
    """A pcapng file: a section, its interfaces (link type, option bytes), packets (interface, ticks, data)."""
    block = lambda code, body: struct.pack(order + "II", code, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)
    out = b"\x0a\x0d\x0d\x0a" + struct.pack(order + "IIHHq", 28, 0x1A2B3C4D, 1, 0, -1) + struct.pack(order + "I", 28)
    for dlt, options in interfaces:
        out += block(1, struct.pack(order + "HHI", dlt, 0, 65535) + options)
    for number, ticks, data in packets:
        out += block(6, struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data + b"\0" * (-len(data) % 4))
    return out


def test_newer_captures_and_other_files(spark, tmp_path):
    nano = struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0)
    (tmp_path / "a.pcapng").write_bytes(ng("<", (272, b""), (256, nano), packets=[(0, 5_500_000, b"abc"), (1, 7_000_000_001, b"defgh"), (4, 1, b"no interface")]) + ng(">", (251, b""), packets=[(0, 2_000_000, b"z")]) + b"\x06\0\0\0cut")
    (tmp_path / "empty.pcap").write_bytes(b"")
    want = [("a", 2.0, 251, b"z"), ("a", 5.5, 272, b"abc"), ("a", 7.000000001, 256, b"defgh")]
    show = lambda df: sorted((r["source"], r["ts"], r["dlt"], bytes(r["data"])) for r in df.collect())
    capture.register(spark)
    assert show(capture.read(spark, str(tmp_path))) == want == show(spark.read.format("capture").option("strict", "true").load(str(tmp_path)))
    (tmp_path / "c.pcap").write_bytes(b"junk and more")
    assert show(capture.read(spark, str(tmp_path), strict=False)) == want
    for df in (capture.read(spark, str(tmp_path)), spark.read.format("capture").option("strict", "true").load(str(tmp_path))):
        with pytest.raises(Exception, match="no capture file"):
            df.collect()


def test_captures_are_followed_as_they_grow(spark, tmp_path):
    record = lambda t, data: struct.pack("<IIII", t, 0, len(data), len(data)) + data
    (tmp_path / "in").mkdir()
    live = tmp_path / "in" / "live.pcap"
    live.write_bytes(b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 65535, 272) + record(1, b"one") + record(2, b"two")[:10])
    capture.register(spark)
    stream = spark.readStream.format("capture").load(str(tmp_path / "in")).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        stream.processAllAvailable()
        assert [bytes(r["data"]) for r in spark.table("followed").collect()] == [b"one"]
        with open(live, "ab") as f:
            f.write(record(2, b"two")[10:] + record(3, b"three"))
        stream.processAllAvailable()
        assert sorted(bytes(r["data"]) for r in spark.table("followed").collect()) == [b"one", b"three", b"two"]
    finally:
        stream.stop()
