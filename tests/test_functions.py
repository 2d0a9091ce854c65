import pytest
from pyspark.sql import functions as F

from radiolake.functions import broadcast, continuity, frames, identity, radio, roles, text
from radiolake.functions.binary import be16, i8, le16, le24, mac, to_bytes, u8


def one(spark, column, **values):
    """The value of an expression over one row of typed values."""
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{n} {t}" for n, (_, t) in values.items())) if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


def of_hex(spark, make, data):
    return one(spark, make(F.unhex("h")), h=(data, "string"))


AA, ADDRESS = "D6BE898E", "665544332211"


def test_numbers(spark):
    row = spark.range(1).select(F.unhex(F.lit("FE0180")).alias("b")).select(u8(F.col("b"), 0), i8(F.col("b"), 0), le16(F.col("b"), 0), be16(F.col("b"), 0), le24(F.col("b"), 0), u8(F.col("b"), 9)).first()
    assert tuple(row) == (254, -2, 0x01FE, 0xFE01, 0x8001FE, None)
    assert of_hex(spark, lambda b: mac(b, 0), ADDRESS + "99") == "11:22:33:44:55:66"
    assert of_hex(spark, lambda b: mac(b, 0), "EC61E6") is None
    assert one(spark, F.hex(to_bytes(F.col("s"))), s=("ac:65 B8", "string")) == "AC65B8"
    assert one(spark, to_bytes(F.col("s")), s=("xyz", "string")) is None


def test_legacy_frame(spark):
    f = of_hex(spark, frames.link_layer, AA + "420B" + ADDRESS + "0201060301" + "AABBCC")
    assert (f["pdu_type"], f["tx_random"], f["rx_random"], f["address"], bytes(f["data"]).hex()) == ("ADV_NONCONN_IND", True, False, "11:22:33:44:55:66", "0201060301")


@pytest.mark.parametrize(
    "payload, address, data",
    [
        ("07" + "01" + ADDRESS + "020106", "11:22:33:44:55:66", "020106"),
        ("09" + "09" + ADDRESS + "3412" + "0201", "11:22:33:44:55:66", "0201"),
        ("00" + "0201060A", None, "0201060a"),
        ("03" + "08" + "3412" + "0A0B0C0D0E", None, "0a0b0c0d0e"),
        ("02" + "01" + ADDRESS, None, ""),  # the header is too short for the address
        ("3F" + "01" + ADDRESS, None, ""),  # the header is longer than the payload
    ],
)
def test_extended_frame(spark, payload, address, data):
    f = of_hex(spark, frames.link_layer, AA + "47" + f"{len(payload) // 2:02X}" + payload + "AABBCCDDEE")
    assert (f["pdu_type"], f["address"], bytes(f["data"]).hex()) == ("ADV_EXT_IND", address, data)


def test_no_frame(spark):
    for data in ("", AA, "8E89BED6" + "420B" + ADDRESS + "AABBCC", AA + "4203" + ADDRESS + "AABBCC"):
        assert of_hex(spark, frames.link_layer, data) is None


def test_capture_records(spark):
    ll = AA + "4206" + ADDRESS + "AABBCC"
    make = lambda dlt: lambda b: frames.captured(b, F.lit(dlt))
    r = of_hex(spark, make(256), "25" + "C4" + "0000" + "D6BE898E" + "000C" + ll)
    assert (r["channel"], r["rssi"], r["crc_ok"], r["frame"]["address"]) == (37, -60, True, "11:22:33:44:55:66")
    r = of_hex(spark, make(256), "25" + "C4" + "0000" + "D6BE898E" + "0004" + ll)
    assert (r["crc_ok"], r["frame"]) == (False, None)
    assert of_hex(spark, make(256), "25" + "C4" + "0000" + "D6BE898E" + "0000" + ll)["crc_ok"] is True
    head = "01" + "0000" + "02" + "0000" + "00" + "0A"
    r = of_hex(spark, make(272), head + "01" + "26" + "3C" + "0000" + "00000000" + ll)
    assert (r["channel"], r["rssi"], r["crc_ok"]) == (38, -60, True)
    r = of_hex(spark, make(272), head + "00" + "26" + "3C" + "0000" + "00000000")
    assert (r["channel"], r["crc_ok"], r["frame"]) == (38, False, None)
    assert of_hex(spark, make(272), head + "01" + "26" + "3C" + "0000" + "00000000") is None
    assert of_hex(spark, make(99), head + "01" + "26" + "3C" + "0000" + "00000000" + ll) is None


def test_ad_structures(spark):
    got = of_hex(spark, frames.ad_structures, "020106" + "03030A18" + "05FF4C00" + "10")
    assert [(r["type"], bytes(r["value"]).hex()) for r in got] == [(1, "06"), (3, "0a18")]
    assert of_hex(spark, frames.ad_structures, "00FFFF") == [] == of_hex(spark, frames.ad_structures, "")
    assert of_hex(spark, frames.ad_structures, None) is None


def test_canonical_entries(spark):
    c = frames.canonical_entries(*[F.col(x) for x in ("n", "u", "c", "d", "p", "a")])
    kinds = {"n": "string", "u": "array<int>", "c": "int", "d": "string", "p": "int", "a": "int"}
    go = lambda **v: [(r["type"], bytes(r["value"]).hex()) for r in one(spark, c, **{k: (v.get(k), t) for k, t in kinds.items()})]
    assert go(n="Tag", u=[0x180A], c=0x4C, d="12:19:00", p=-8, a=0x180) == [(9, "546167"), (3, "0a18"), (255, "4c00121900"), (10, "f8"), (25, "8001")]
    assert go(c=0x59) == [(255, "5900")]
    assert go(p=-500) == [(10, "80")]
    assert go() == []


def test_messages(spark):
    got = of_hex(spark, continuity.messages, "4C00" + "0C0308E55A" + "10020B1C" + "1604AA")
    assert [(m["type"], bytes(m["payload"]).hex()) for m in got] == [(12, "08e55a"), (16, "0b1c")]
    for other in ("", "4C00", "4C0010", "59000C0308E55A", "4C00" + "0916AABB"):
        assert of_hex(spark, continuity.messages, other) == []
    assert of_hex(spark, continuity.handoff_seq, "4C00" + "10020B1C" + "0C0308E55A") == 0xE55A
    assert of_hex(spark, continuity.handoff_seq, "4C00" + "0C0208E5") is None
    cut = of_hex(spark, continuity.ingest_messages, "0C0308E55A" + "1604AA")
    assert [(m["type"], m["length"], bytes(m["payload"]).hex()) for m in cut] == [(12, 3, "08e55a"), (22, 4, "aa")]


def test_message_decoders(spark):
    p = of_hex(spark, continuity.pairing, "010E202B9F8000")
    assert (p["model"], p["state"], p["status"], p["left"], p["right"], p["case"]) == ("AirPods Pro 1st gen", 1, 0x2B, 90, None, 80)
    assert of_hex(spark, continuity.pairing, "010E202B")["left"] is None and of_hex(spark, continuity.pairing, "010E20") is None
    n = of_hex(spark, continuity.nearby, "5BE0")
    assert (n["action"], n["name"], n["flags"], n["wifi"], n["earbuds"], n["authenticated"]) == (5, "MeshRelay", 11, True, True, True)
    assert [of_hex(spark, continuity.pair_state, "00" * k)["variant"] for k in (2, 5, 25, 9)] == ["state_code", "short_auth", "find_my_anchor", "unknown_length"]
    h = of_hex(spark, continuity.handoff, "080102")
    assert (h["has_data"], h["seq"]) == (True, 258)
    b = of_hex(spark, continuity.beacon, "00" * 16 + "0001" + "0002" + "C5")
    assert (b["major"], b["minor"], b["power"]) == (1, 2, -59)
    assert of_hex(spark, continuity.home, "01" + "665544332211" + "0500" + "0700" + "0902")["device"] == "11:22:33:44:55:66"
    assert of_hex(spark, continuity.finding, "80AABB")["battery"] == 2


@pytest.mark.parametrize(
    "data, cls, model",
    [
        ("0703010E20" + "1001AA", "airpods", "AirPods Pro"), ("0703017777", "airpods", "AirPods (0x7777)"), ("1601AA" + "1201AA", "airtag", "AirTag"), ("1101AA", "apple_watch", "Apple Watch"),
        ("10010D", "apple_watch", "Apple Watch"), ("10010F", "mac", None), ("100101" + "10010F", "mac", None), ("1201AA", "apple_device", None), ("100101", "apple_device", None), ("0901AA", "apple_airplay", None),
        ("0601AA", "homekit", None), ("0201AA", "ibeacon", None),
    ],
)
def test_classes(spark, data, cls, model):
    got = of_hex(spark, lambda b: continuity.classify(continuity.ingest_messages(b)), data)
    assert (got["device_class"], got["model"]) == (cls, model)


def test_no_class(spark):
    assert of_hex(spark, lambda b: continuity.classify(continuity.ingest_messages(b)), "0101AA") is None


def test_broadcast(spark):
    go = lambda t, u, d: one(spark, broadcast.announcement(F.col("t"), F.col("u"), F.col("d")), t=(t, "array<int>"), u=(u, "array<int>"), d=(d, "array<string>"))
    r = go([1, 3, 0x16, 0x16], [0x180A, 0x1852, 0x1856], ["ac:65:b8", "01"])
    assert (r["broadcast_id"], r["features"], r["encrypted"]) == (0xB865AC, 1, True)
    assert go([0x16], [0x1856, 0x1852], ["00", "0a:0b:0c"])["broadcast_id"] == 0x0C0B0A  # paired wrongly: the data of three bytes
    assert go([0x16], [0x180A], ["ac:65:b8"]) is None and go([0x16], [0x1852], ["01"]) is None


def test_addresses_and_keys(spark):
    cls = lambda a, r: one(spark, identity.address_class(F.col("a"), F.lit(r)), a=(a, "string"))
    assert [cls("c0:00", True), cls("4f:00", True), cls("3f:00", True), cls("80:00", True), cls("zz", True), cls("c0:00", False)] == ["random_static", "rpa", "nrpa", "unknown", "unknown", "public"]
    k = one(spark, identity.device_key(F.col("a"), F.lit("rpa")), a=("AA:BB", "string"))
    assert tuple(k) == ("rpa:aa:bb", "unresolved_rpa")
    assert tuple(one(spark, identity.device_key(F.col("a"), F.lit(None).cast("string")), a=("AA", "string"))) == ("anon:aa", "unknown")
    assert one(spark, identity.resolves(F.lit("70:81:94:0d:fb:aa"), F.lit("ec0234a357c8ad05341010a60a397d9b"))) is True
    assert one(spark, identity.resolves(F.lit("70:81:94:0d:fb:ab"), F.lit("ec0234a357c8ad05341010a60a397d9b"))) is False
    assert one(spark, identity.resolves(F.lit("70:81"), F.lit("ec"))) is None
    assert one(spark, identity.normal_mac(F.lit("aa-bb.cc:dd ee0f"))) == "AABBCCDDEE0F" and one(spark, identity.normal_mac(F.lit("aa:bb"))) is None


def test_classes_and_labels(spark):
    at = lambda v: one(spark, identity.appearance_class(F.lit(v)))
    assert [at(0x40), at(0x3C1), at(0x3C0), at(0x0A40), at(0x7FFF)] == ["phone", "hid_keyboard", "hid", "hearing_aid", None]
    assert [one(spark, identity.precedence(F.lit(c).cast("string"))) for c in (None, "unknown", "apple_device", "airtag", "kettle")] == [0, 0, 1, 5, 3]
    assert one(spark, identity.class_label(F.lit("hid_mouse"))) == "HID mouse" and one(spark, identity.class_label(F.lit("heart_rate_sensor"))) == "heart rate sensor"
    label = lambda *v: one(spark, identity.best_label(*[F.lit(x).cast("string") for x in v]))
    assert label("", "g", "l", "v", "o", "m", "c", "rs:x") == "g" and label(None, None, "", "v", None, "m", None, "rs:x") == "v m"
    assert label(None, None, None, "", "o", "", "c", "rs:x") == "o c" and label(None, None, None, None, "o", None, None, "rs:x") == "o"
    assert label(*[None] * 7, "rpa:aa:bb") == "aa:bb"
    stable = lambda kind, n, cls, packets: one(spark, identity.is_stable(F.lit(kind), F.lit(n), F.lit(None).cast("string"), F.lit("").cast("string"), F.lit(cls), F.lit(packets)))
    assert stable("public_mac", 1, None, 0) and stable("nrpa", 2, None, 0) and stable("nrpa", 1, "airtag", 500)
    assert not stable("nrpa", 1, "airtag", 499) and not stable("nrpa", 1, "apple_device", 9999)


def test_radio(spark):
    mhz = [one(spark, radio.megahertz(F.lit(c))) for c in (37, 0, 10, 38, 11, 36, 39, 40)]
    assert mhz == [2402, 2404, 2424, 2426, 2428, 2478, 2480, None]
    assert [one(spark, radio.meter(F.lit(v).cast("int"))) for v in (-120, -60, 0, None)] == [0.0, 0.5, 1.0, None]
    shown = lambda age, **kw: one(spark, radio.opacity(F.lit(1000.0), F.lit(1000.0 + age), **kw))
    assert shown(5) == 1.0 and shown(90_000) == 0.1 and 0.1 < shown(3600) < shown(300) < 1
    assert one(spark, radio.opacity(F.lit(0.0), F.lit(5.0))) == 0.1 and shown(20, horizon=30.0) < 1
    assert one(spark, radio.uncovered(F.array(F.lit(38)))) == [37, 39]
    for n, want in ((1, ["scan"]), (2, ["pin37", "scan"]), (3, ["pin37", "pin38", "pin39"]), (4, ["pin37", "pin38", "pin39", "idle"])):
        df = spark.createDataFrame([("h", i) for i in range(n)], "host string, i int")
        assert [r["role"] for r in roles.defaults(df, "host", F.lit(True), "i").orderBy("i").collect()] == want


def test_roles(spark):
    go = lambda role, channels=None, address=None, key=None: one(spark, roles.problems(F.lit(role), F.col("c"), F.lit(address).cast("string"), F.lit(key).cast("string")), c=(channels, "array<int>"))
    assert go("pin", [37, 39]) == [] == go("scan") == go("follow", None, "aa:bb:cc:dd:ee:ff", "0" * 32)
    assert go("pin") == ["no channel"] and go("pin", [5, 5]) == ["channel isn't primary", "channel given twice"]
    assert go("follow", None, "aa:bb") == ["address of the wrong form"] and go("idle", None, None, "xy") == ["key of the wrong form"]
    assert one(spark, roles.masked_key(F.lit("a" * 28 + "beef"))) == "…beef" and one(spark, roles.short_name(F.lit("SN12"), F.lit("dk"), F.lit(3))) == "dk-SN12"


def test_log_lines(spark):
    go = lambda s: one(spark, text.log_line(F.col("s"), F.lit(7.0)), s=(s, "string"))
    assert tuple(go("2026-05-06 14:23:01.123  INFO     flush done\n")) == (1778077381.123, "INFO", "flush done")
    assert tuple(go("2026-05-06 14:23:01  STALL detected sniffer=abc")) == (1778077381.0, None, "STALL detected sniffer=abc")
    assert tuple(go("  Traceback line")) == (7.0, None, "  Traceback line") and go("  \n") is None and go(None) is None
    assert one(spark, text.masked(F.lit("adv e0:50:66:96:a7:3f rssi=-43 name='x 1' id=0x1F v4.5"))) == "adv <mac> rssi=-<num> name=<text> id=<hex> v<num>"
    line = one(spark, text.summary_line(F.lit("t"), F.lit(5), F.lit("INFO"), F.lit("x <*>"), F.lit(10.0), F.lit(0.0)))
    assert line == "t  SUMMARY  [×5]  INFO x <*> (every 10.00s ±0.00)"


def test_other_texts(spark):
    assert [one(spark, text.dissected_int(F.lit(s).cast("string"))) for s in ("0x1F", "12", " -3 ", "x", None)] == [31, 12, -3, None, None]
    assert [one(spark, text.version(F.lit(s))) for s in ("4.1.1", "4", "x.1")] == [[4, 1, 1], [4], None]
    status = lambda *v: one(spark, text.coded_phy_status(F.array(*[F.lit(x).cast("string") for x in v])))
    assert [status("4.1.1", "4.2.0"), status("4.2.0", None), status("4.1.0"), status(None)] == ["blocked", "warning", None, None]
    assert one(spark, text.uuid128(F.lit(0x180A))) == "0000180a-0000-1000-8000-00805f9b34fb"
    assert of_hex(spark, text.printable, "416263") == "Abc" and of_hex(spark, text.printable, "41FF") is None and of_hex(spark, text.printable, "4100") is None
    assert one(spark, text.short_source(F.lit("/dev/tty.usbserial-12345678901"))) == "…12345678901" and one(spark, text.can_transmit(F.lit("nRF Sniffer"), F.lit(""))) is False
    for data in ("0601AB02BC03CD", "", "ABBCCD"):
        framed = of_hex(spark, lambda b: F.hex(text.slip_frame(b)), data)
        assert framed[:2] == "AB" and framed[-2:] == "BC" and "BC" not in [framed[i : i + 2] for i in range(2, len(framed) - 2, 2)]
        assert of_hex(spark, lambda b: F.hex(text.slip_payload(b)), framed) == data
