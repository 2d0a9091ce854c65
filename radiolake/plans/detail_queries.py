"""Queries over single functions, edits, lookups and lists of the reference's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.functions import broadcast, continuity, frames, radio, roles, text
from radiolake.operators import inventory, monitors, observe, readmodel, signals, upserts
from radiolake.plans import views
from radiolake.plans.reference_queries import _FRAMES, _LABEL, _LINES, _label, _log_lines, _stream
from radiolake.plans.registry import registry
from radiolake.runtime import fresh_folder, materialize, read
from radiolake.sources import dimensions, logs, sinks
from radiolake.streaming import bus, stateful

QUERIES, SQL, query = registry()


# Capture records: raw frames behind the two kinds of pseudo-header

_RECORDS = f"""{_FRAMES}, r AS (SELECT p.id, 256 AS dlt, coalesce(p.channel, 0) AS channel, p.rssi IS NULL AS bad, greatest(-128, least(127, coalesce(p.rssi, 0))) AS rssi, octet_length(p.raw) AS n FROM packets p WHERE p.raw IS NOT NULL
  UNION ALL SELECT p.id, 272, coalesce(p.channel, 0), p.rssi IS NULL, -least(255, abs(coalesce(p.rssi, 0))), octet_length(p.raw) FROM packets p WHERE p.raw IS NOT NULL)"""


@query(
    f"""WITH {_RECORDS} SELECT DISTINCT r.id, dlt, r.channel, r.rssi, NOT bad AS crc_ok, CASE WHEN NOT bad THEN list_extract(['ADV_IND', 'ADV_DIRECT_IND', 'ADV_NONCONN_IND', 'SCAN_REQ', 'SCAN_RSP', 'CONNECT_IND', 'ADV_SCAN_IND', 'ADV_EXT_IND'], fr.code + 1) END AS pdu_type
    FROM r LEFT JOIN fr ON fr.id = r.id WHERE (dlt = 272 OR n >= 15) AND (bad OR fr.id IS NOT NULL)"""
)
def q93_capture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-5, SF-6: raw packets as records of both link types, decoded again; those without a level stand for failed checksums."""
    p = read(spark, sf_dir, "packets").filter("raw is not null").select("id", "raw", F.coalesce("channel", F.lit(0)).alias("c"), F.col("rssi").isNull().alias("bad"), F.coalesce("rssi", F.lit(0)).alias("v")).distinct()
    byte = lambda x: F.lpad(F.hex(x.bitwiseAND(255)), 2, "0")
    zeros = lambda n: F.lit("00" * n)
    one = F.concat(byte(F.col("c")), byte(F.greatest(F.lit(-128), F.least(F.lit(127), "v"))), zeros(6), F.when(F.col("bad"), "0004").otherwise("000C"))
    two = F.concat(zeros(8), F.when(F.col("bad"), "00").otherwise("01"), byte(F.col("c")), byte(F.least(F.lit(255), F.abs("v"))), zeros(6))
    kinds = F.array(F.struct(F.lit(256).alias("dlt"), F.unhex(one).alias("head")), F.struct(F.lit(272).alias("dlt"), F.unhex(two).alias("head")))
    records = p.select("id", "raw", F.explode(kinds).alias("k")).select("id", "k.dlt", F.concat("k.head", "raw").alias("data"))
    return records.withColumn("f", frames.captured(F.col("data"), F.col("dlt"))).filter("f is not null").select("id", "dlt", "f.channel", "f.rssi", "f.crc_ok", "f.frame.pdu_type")


# Vendor messages made of the event stream's numbers

_BYTE = "printf('%02X', {} & 255)"


@query(
    f"""WITH {views.EVENT_PACKETS} SELECT seq, k & 255 AS state, seq & 255 AS status, CASE WHEN (k >> 4) & 15 <> 15 THEN ((k >> 4) & 15) * 10 END::INTEGER AS left, CASE WHEN k & 15 <> 15 THEN (k & 15) * 10 END::INTEGER AS right,
    CASE WHEN k % 3 = 0 THEN 'state_code' WHEN k % 3 = 1 THEN 'short_auth' ELSE 'unknown_length' END AS variant, CASE WHEN k % 3 = 0 THEN (k & 255) * 256 + (seq & 255) END::INTEGER AS code, ((seq >> 8) & 255) * 256 + (seq & 255) AS major, ((k & 255) + 128) % 256 - 128 AS power,
    (seq & 255) * 256 + (k & 255) AS category, (k & 255) >> 6 AS battery, 'ProximityPairing' AS name, {_BYTE.format("k")} || {_BYTE.format("seq")} || '00' || {_BYTE.format("seq")} AS stable FROM ev"""
)
def q94_message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-12, SF-17, SF-19, SF-20, SF-22: fields of pairing, pairing-state, beacon, home and finding messages."""
    byte = lambda c: F.lpad(F.hex(F.col(c).bitwiseAND(255)), 2, "0")
    k, s, s2 = byte("k"), byte("seq"), F.lpad(F.hex(F.shiftright("seq", 8).bitwiseAND(255)), 2, "0")
    pairing = F.concat(F.lit("0707"), k, s, F.lit("00"), s, k, F.lit("30FF"))
    state = F.when(F.col("k") % 3 == 0, F.concat(F.lit("1202"), k, s)).when(F.col("k") % 3 == 1, F.concat(F.lit("1204"), k, s, k, s)).otherwise(F.concat(F.lit("1203"), k, s, k))
    beacon = F.concat(F.lit("0215"), F.lit("AB" * 16), s2, s, F.lit("0001"), k)
    home = F.concat(F.lit("060D"), F.lit("01"), F.lit("112233445566"), k, s, F.lit("0100"), F.lit("05"), F.lit("00"))
    finding = F.concat(F.lit("1603"), k, s, k)
    e = views.event_packets(spark, sf_dir).select("seq", F.unhex(F.concat(F.lit("4C00"), pairing, state, beacon, home, finding)).alias("blob")).withColumn("m", continuity.messages(F.col("blob")))
    at = lambda i: F.get("m", F.lit(i))
    of = lambda i: at(i)["payload"]
    told = e.select("seq", continuity.pairing(of(0)).alias("p"), continuity.pair_state(of(1)).alias("s"), continuity.beacon(of(2)).alias("b"), continuity.home(of(3)).alias("h"), continuity.finding(of(4)).alias("f"), continuity.type_name(at(0)["type"]).alias("name"), F.hex(continuity.stable_prefix(at(0))).alias("stable"))
    return told.select("seq", "p.state", "p.status", "p.left", "p.right", "s.variant", "s.code", "b.major", "b.power", "h.category", "f.battery", "name", "stable")


@query(f"WITH {views.EVENT_PACKETS} SELECT k AS bis_count, CASE k % 4 WHEN 0 THEN '1M' WHEN 1 THEN '2M' WHEN 2 THEN 'Coded' END AS phy, count(*) AS n, count(*) FILTER (event_type = 'error') AS encrypted FROM ev GROUP BY ALL")
def q95_stream_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-25: stream groups of periodic advertisements; a group key means encrypted."""
    e = views.event_packets(spark, sf_dir)
    g = broadcast.group_info(F.col("k"), F.col("k") % 4, F.lit(40), F.lit(40), F.lit(10_000), F.lit(8), F.when(F.col("event_type") == "error", F.lit("00")))
    return e.select(g.alias("g")).groupBy("g.bis_count", "g.phy").agg(F.count(F.lit(1)).alias("n"), F.count_if("g.encrypted").alias("encrypted"))


# Texts, names and receivers


@query(
    """SELECT id, coalesce(kind, 'receiver') || '-' || coalesce(nullif(right(serial_number, 4), ''), id::VARCHAR) AS short, NOT contains(lower(concat_ws(' ', kind, name)), 'sniffer') AS transmits, '…' || right(serial_number, 4) AS masked,
    CASE WHEN length(regexp_replace(usb_port_id, '^.*[/.]', '')) <= 6 THEN regexp_replace(usb_port_id, '^.*[/.]', '') ELSE '…' || right(usb_port_id, 5) END AS port FROM sniffers"""
)
def q96_receiver_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-36, SF-45, SF-46: short names of receivers and ports, whether they can transmit, serial numbers masked."""
    s = read(spark, sf_dir, "sniffers")
    return s.select("id", roles.short_name(F.col("serial_number"), F.col("kind"), F.col("id")).alias("short"), text.can_transmit(F.col("kind"), F.col("name")).alias("transmits"), roles.masked_key(F.col("serial_number")).alias("masked"), text.short_source(F.col("usb_port_id"), 6).alias("port"))


@query(
    """WITH a AS (SELECT id, CASE WHEN channel IS NOT NULL THEN [channel, coalesce(rssi, 37)] END AS cs, address_id FROM packets WHERE id IN (SELECT min(id) FROM packets GROUP BY address_id))
    SELECT a.id, array_to_string([x FOR x IN [CASE WHEN len(coalesce(cs, [])) < 1 THEN 'no channel' END, CASE WHEN NOT coalesce(list_has_all([37, 38, 39], cs), TRUE) THEN 'channel isn''t primary' END, CASE WHEN cs[1] = cs[2] THEN 'channel given twice' END] IF x IS NOT NULL], ',') AS pinned FROM (SELECT DISTINCT * FROM a) a"""
)
def q97_role_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-46: what is wrong with pinning a receiver to the channels of each address's first packet."""
    p = read(spark, sf_dir, "packets").select("id", "channel", "rssi", "address_id")
    first = p.join(p.groupBy("address_id").agg(F.min("id").alias("id")).select("id"), "id", "left_semi").distinct()
    channels = F.when(F.col("channel").isNotNull(), F.array("channel", F.coalesce("rssi", F.lit(37))))
    return first.select("id", F.array_join(roles.problems(F.lit("pin"), channels, F.lit(None).cast("string"), F.lit(None).cast("string")), ",").alias("pinned"))


_VERSIONS = """v AS (SELECT vendor_id, identifiers['firmware_rev'] AS raw FROM devices WHERE identifiers['firmware_rev'] IS NOT NULL), n AS (SELECT *, CASE WHEN regexp_matches(raw, '^\\d+(\\.\\d+)*$') THEN [CAST(x AS INTEGER) FOR x IN string_split(raw, '.')] END AS ns FROM v)"""


@query(f"WITH {_VERSIONS} SELECT vendor_id, count(*) AS n, count(ns) AS known, CASE WHEN bool_or(ns = [4, 1, 1]) THEN 'blocked' WHEN bool_or(ns > [4, 1, 1]) THEN 'warning' END AS status FROM n GROUP BY vendor_id")
def q98_firmware_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-41, SF-42: whether a maker's firmware is the version known to be broken."""
    v = read(spark, sf_dir, "devices").select("vendor_id", F.try_element_at("identifiers", F.lit("firmware_rev")).alias("raw")).filter("raw is not null")
    return v.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"), F.count(text.version(F.col("raw"))).alias("known"), text.coded_phy_status(F.collect_set("raw")).alias("status"))


@query("SELECT appearance, printf('%08x-0000-1000-8000-00805f9b34fb', appearance) AS uuid, count(*) AS n FROM devices WHERE appearance IS NOT NULL GROUP BY appearance")
def q99_long_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-44: 16-bit numbers as whole service ids."""
    return read(spark, sf_dir, "devices").filter("appearance is not null").groupBy("appearance", text.uuid128(F.col("appearance")).alias("uuid")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT id, 'AB' || coalesce(list_aggregate([CASE x WHEN 'AB' THEN 'CDAC' WHEN 'BC' THEN 'CDBD' WHEN 'CD' THEN 'CDCE' ELSE x END FOR x IN [substr(hex(raw), 2 * i + 1, 2) FOR i IN range(0, octet_length(raw))]], 'string_agg', ''), '') || 'BC' AS frame, TRUE AS same
    FROM (SELECT DISTINCT id, raw FROM packets WHERE raw IS NOT NULL)"""
)
def q100_serial_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-40: raw packets framed for the serial line, and whether the frame gives them back."""
    p = read(spark, sf_dir, "packets").filter("raw is not null").select("id", "raw").distinct().withColumn("f", text.slip_frame(F.col("raw")))
    return p.select("id", F.hex("f").alias("frame"), (text.slip_payload(F.col("f")) == F.col("raw")).alias("same"))


@query("SELECT channel, round((channel * 137.50776405003785::DOUBLE) % 360, 6) AS hue FROM (SELECT DISTINCT channel FROM packets WHERE channel IS NOT NULL)")
def q101_channel_hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-34: colours of channels."""
    return read(spark, sf_dir, "packets").filter("channel is not null").select("channel").distinct().select("channel", F.round(radio.hue(F.col("channel")), 6).alias("hue"))


@query(f"WITH {_LINES} SELECT coalesce(level, '-') AS level, regexp_matches(body, '{logs.VERBATIM}') AS verbatim, fits AS timed, count(*) AS n FROM lg GROUP BY ALL")
def q102_verbatim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13, SRC-10: log lines that are told as they stand."""
    name = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    raw = read(spark, sf_dir, "documents").filter(name == "capture_log").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    told = logs.lines(raw, F.col("doc_id"))
    return told.groupBy(F.coalesce("level", F.lit("-")).alias("level"), "verbatim", F.col("ts").isNotNull().alias("timed")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINES}, c AS (SELECT level, count(*) AS n, count(DISTINCT body) AS bodies FROM lg WHERE fits GROUP BY level) SELECT '2026-01-01  SUMMARY  [×' || n || ']  ' || coalesce(level || ' ', '') || 'lines' || CASE WHEN bodies > 1 THEN printf(' (every %.2fs ±%.2f)', bodies::DOUBLE, n::DOUBLE) ELSE '' END AS line FROM c")
def q103_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-39: summary lines, here of the lines per level."""
    c = _log_lines(spark, sf_dir).filter("ts is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("body").alias("bodies"))
    every = F.when(F.col("bodies") > 1, F.col("bodies").cast("double"))
    return c.select(text.summary_line(F.lit("2026-01-01"), F.col("n"), F.col("level"), F.lit("lines"), every, F.col("n").cast("double")).alias("line"))


@query("SELECT kind AS host, usb_port_id AS path FROM (SELECT *, bool_or(contains(usb_port_id, 'usbserial')) OVER (PARTITION BY kind) AS named FROM (SELECT kind, CASE WHEN is_active THEN usb_port_id ELSE '/dev/cu.SLAB_USBtoUART' || id END AS usb_port_id FROM sniffers UNION ALL SELECT kind, '/dev/cu.usbserial-' || id FROM sniffers WHERE name IS NULL)) WHERE NOT (named AND contains(usb_port_id, 'SLAB_USBtoUART'))")
def q104_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7: ports of a sweep without their doubles."""
    s = read(spark, sf_dir, "sniffers")
    port = F.when(F.col("is_active"), F.col("usb_port_id")).otherwise(F.concat(F.lit("/dev/cu.SLAB_USBtoUART"), F.col("id").cast("string")))
    ports = s.select(F.col("kind").alias("host"), port.alias("path")).unionAll(s.filter("name is null").select("kind", F.concat(F.lit("/dev/cu.usbserial-"), F.col("id").cast("string"))))
    return dimensions.without_aliases(ports)


@query("SELECT s.usb_port_id AS path, u.id AS usb_id FROM sniffers s LEFT JOIN sniffers u ON u.id = s.id AND u.serial_number IS NOT NULL")
def q105_described_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-8: ports with the USB descriptors that fit them, by serial numbers inside one another."""
    s = read(spark, sf_dir, "sniffers")
    ports = s.select(F.col("usb_port_id").alias("path"), F.lower("serial_number").alias("serial"), F.lit(None).cast("string").alias("location"))
    usb = s.select(F.col("id").alias("usb_id"), F.concat(F.lit("x-"), F.col("serial_number")).alias("usb_serial"), F.col("location_id_hex").alias("usb_location"), F.col("kind").alias("product"))
    return dimensions.described(ports, usb).select("path", "usb_id")


@query("WITH t AS (SELECT vendor_id AS code, arg_max(vendor, row(last_seen, id)) FILTER (vendor IS NOT NULL) AS company FROM devices WHERE vendor_id IS NOT NULL AND appearance IS NOT NULL GROUP BY 1) SELECT d.id, t.company FROM devices d LEFT JOIN t ON t.code = d.vendor_id")
def q106_company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: makers by company id; ids the table hasn't stay unnamed."""
    d = read(spark, sf_dir, "devices")
    table = d.filter("vendor_id is not null and appearance is not null").withColumn("seq", F.struct("last_seen", "id")).groupBy(F.col("vendor_id").alias("code")).agg(upserts.latest_known("vendor", "seq").alias("company"))
    return dimensions.company(d.select("id", "vendor_id"), table).select("id", "company")


@query("SELECT phy, name, n FROM (SELECT CASE pdu_type % 4 WHEN 0 THEN '1M' WHEN 1 THEN '2M' ELSE 'Coded' END AS phy, CASE WHEN pdu_type < 8 THEN list_extract(['ADV_IND', 'ADV_DIRECT_IND', 'ADV_NONCONN_IND', 'SCAN_REQ', 'SCAN_RSP', 'CONNECT_IND', 'ADV_SCAN_IND', 'ADV_EXT_IND'], pdu_type + 1) ELSE '0x' || printf('%X', pdu_type) END AS name, count(*) AS n FROM (SELECT coalesce(pdu_type, 9) + CASE WHEN channel < 10 THEN 5 ELSE 0 END AS pdu_type FROM packets) GROUP BY ALL)")
def q107_code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-16: names of codes from small fixed tables; unknown codes as hex."""
    p = read(spark, sf_dir, "packets").select((F.coalesce("pdu_type", F.lit(9)) + F.when(F.col("channel") < 10, 5).otherwise(0)).alias("c"))
    return p.groupBy(frames.lookup({0: "1M", 1: "2M", 2: "Coded", 3: "Coded"}, F.col("c") % 4).alias("phy"), frames.pdu_name(F.col("c")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


# Lists, lookups and sets

_SORTS = {
    "Type": "coalesce(device_class, '~')", "Name": "lower(label)", "Address kind": "coalesce(kind, '~')", "RSSI (avg)": "coalesce(rssi_avg, -200.0) DESC", "Vendor": "lower(coalesce(nullif(vendor, ''), nullif(oui_vendor, ''), '~'))",
    "Packets": "packet_count DESC", "Last seen": "coalesce(last_seen, 0.0) DESC",
}
_SHOWN = f"""WITH {views.OBSERVED}, t AS (SELECT device_id, CAST(sum(packet_count) AS BIGINT) AS packet_count, round(sum(rssi_sum) / sum(rssi_samples), 6) AS rssi_avg FROM obs GROUP BY device_id),
s AS (SELECT d.id, {_LABEL} AS label, d.device_class, d.kind, d.vendor, d.oui_vendor, d.last_seen, t.packet_count, t.rssi_avg FROM (SELECT *, coalesce(nullif(vendor, ''), nullif(oui_vendor, '')) AS mk FROM devices) d JOIN t ON t.device_id = d.id)"""


@query(_SHOWN + " " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS sorted_by, row_number() OVER (ORDER BY {o}, id)::INTEGER AS place, id FROM s ORDER BY place LIMIT 40)" for n, o in _SORTS.items()))
def q108_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-1: the first forty devices in each order a user may choose."""
    t = observe.totals(views.observed(spark, sf_dir), ["device_id"]).select("device_id", "packet_count", F.round("rssi_avg", 6).alias("rssi_avg"))
    d = read(spark, sf_dir, "devices").withColumn("label", _label()).select("id", "label", "device_class", "kind", "vendor", "oui_vendor", "last_seen")
    shown = materialize(d.join(t, F.col("id") == F.col("device_id")), "shown")
    place = lambda key: F.row_number().over(Window.partitionBy("sorted_by").orderBy(key, "id"))  # noqa: E731  # over forty rows
    lists = [shown.orderBy(key, "id").limit(40).withColumn("sorted_by", F.lit(name)).select("sorted_by", place(key).alias("place"), "id") for name, key in readmodel.sort_keys().items()]
    out = lists[0]
    for more in lists[1:]:
        out = out.unionAll(more)
    return out


@query("WITH k AS (SELECT DISTINCT 'pub:' || address AS stable_key FROM addresses UNION SELECT stable_key FROM devices WHERE kind = 'nrpa') SELECT k.stable_key, d.id, d.local_name, d.id IS NOT NULL AS found FROM k LEFT JOIN devices d ON d.stable_key = k.stable_key")
def q109_device_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: lookups of devices by their unique key; missing ones are told."""
    d = read(spark, sf_dir, "devices")
    wanted = read(spark, sf_dir, "addresses").select(F.concat(F.lit("pub:"), "address").alias("stable_key")).union(d.filter("kind = 'nrpa'").select("stable_key"))
    return readmodel.looked_up(wanted, d, "stable_key", "id", "local_name")


@query("SELECT m.device_id, d.run_id, d.a_id, d.b_id, count(*) AS n FROM (SELECT DISTINCT device_id FROM device_cluster_members) m JOIN merge_decisions d ON d.a_id = m.device_id OR d.b_id = m.device_id GROUP BY ALL")
def q110_links_at_either_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12: verdicts one of whose ends is a clustered device."""
    links = read(spark, sf_dir, "merge_decisions").select("run_id", "a_id", "b_id")
    return readmodel.at_either_end(read(spark, sf_dir, "device_cluster_members"), links, "a_id", "b_id").groupBy("device_id", "run_id", "a_id", "b_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {views.EVENT_VOCABULARY} SELECT device_id, string_agg(v, ',' ORDER BY t, v) AS services FROM (SELECT device_id, v, min(first_seen) AS t FROM voc WHERE ad_type = 3 GROUP BY ALL) GROUP BY device_id")
def q111_services_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-6: each device's services, once each, in order of their first appearance."""
    v = views.event_vocabulary(spark, sf_dir).filter("ad_type = 3").select("device_id", F.hex("ad_value").alias("v"), "first_seen")
    return observe.in_order_met(v, "device_id", "v", "first_seen").select("device_id", F.array_join("values", ",").alias("services"))


@query("WITH RECURSIVE g AS (SELECT id, CASE WHEN id > 1 THEN id // 2 END AS parent FROM (SELECT DISTINCT id FROM sessions)), r AS (SELECT id, 0 AS depth FROM g WHERE id = 1 UNION ALL SELECT g.id, r.depth + 1 FROM g JOIN r ON g.parent = r.id) SELECT id, depth FROM r")
def q112_groups_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP-10: all groups below one, however deep."""
    groups = read(spark, sf_dir, "sessions").select("id").distinct().withColumn("parent_group_id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2)))
    return readmodel.subtree(groups, 1)


@query(
    f"""WITH {views.EVENT_PACKETS}, c AS (SELECT channel, us // 900000000 * 900 AS moment, count(*) AS n FROM ev GROUP BY ALL)
    SELECT o.channel, o.moment, any_value(o.n) AS n, round(greatest(0, max(p.n - greatest(0, o.moment - p.moment - 900) / 300)), 6) AS peak FROM c o JOIN c p ON p.channel = o.channel AND p.moment <= o.moment AND o.moment - p.moment <= 36000 GROUP BY o.channel, o.moment"""
)
def q113_held_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-11: packets per channel and quarter of an hour, with peaks that hold for one and then fall."""
    e = views.event_packets(spark, sf_dir).groupBy("channel", (F.floor(F.col("us") / 900_000_000) * 900).alias("moment")).agg(F.count(F.lit(1)).alias("n"))
    return monitors.decayed_peak(materialize(e, "counts"), "channel", "moment", "n", hold_s=900.0, fall_per_s=1 / 300, reach_s=36_000.0).withColumn("peak", F.round("peak", 6))


# Vocabulary inventory

_TOLD = f"WITH {views.EVENT_VOCABULARY}, m AS (SELECT device_id, k % 256 AS b, CAST(sum(n) AS BIGINT) AS n FROM voc WHERE ad_type = 255 GROUP BY ALL)"
_ACTIONS = "list_extract([" + ", ".join(f"'{n}'" for n in continuity.ACTIONS.values()) + "], b // 16 + 1)"


@query(_TOLD + f" SELECT coalesce({_ACTIONS}, 'unknown') AS action, count(DISTINCT device_id) AS devices FROM m GROUP BY 1")
def q114_nearby_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-14: devices by the action of their nearby messages."""
    return inventory.actions(views.event_vocabulary(spark, sf_dir))


@query(_TOLD + " SELECT 16 AS type, device_id, CAST(sum(n) AS BIGINT) AS count FROM m GROUP BY device_id UNION ALL SELECT 12, device_id, CAST(sum(n) AS BIGINT) FROM m GROUP BY device_id")
def q115_message_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-14: the devices behind some types of messages."""
    return inventory.holders(views.event_vocabulary(spark, sf_dir), [12, 16])


@query(
    _TOLD + f""", n AS (SELECT 'vendors' AS section, '0x004C' AS name, count(DISTINCT device_id) AS d FROM m UNION ALL SELECT 'messages', unnest(['Handoff', 'NearbyInfo']), count(DISTINCT device_id) FROM m UNION ALL SELECT 'actions', coalesce({_ACTIONS}, 'unknown'), count(DISTINCT device_id) FROM m GROUP BY 2)
    SELECT section, row_number() OVER (PARTITION BY section ORDER BY d DESC, name)::INTEGER AS place, printf('%6d  %s', d, name) AS line FROM n QUALIFY place <= 20"""
)
def q116_inventory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5: the inventory as text, section by section."""
    return inventory.report(views.event_vocabulary(spark, sf_dir))


@query(
    """WITH k AS (SELECT device_id AS id, min(resolved_via_irk_id) AS irk FROM addresses WHERE device_id IS NOT NULL AND resolved_via_irk_id IS NOT NULL GROUP BY 1), c AS (SELECT id, coalesce(user_device_class, device_class) AS cls FROM devices)
    SELECT x.id AS a, y.id AS b, CASE WHEN x.irk = y.irk THEN 1.0 ELSE -1.0 END::DOUBLE AS score FROM k x JOIN c cx ON cx.id = x.id JOIN k y ON y.id > x.id JOIN c cy ON cy.id = y.id AND cy.cls = cx.cls"""
)
def q117_identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG-8: pairs of one class whose addresses identity keys resolved: one key speaks for them, two against."""
    known = views.devices(spark, sf_dir).select("id", "device_class")
    keys = read(spark, sf_dir, "addresses").filter("device_id is not null and resolved_via_irk_id is not null").groupBy(F.col("device_id").alias("id")).agg(F.min("resolved_via_irk_id").alias("irk_id"))
    return signals.resolved(None, keys, devices=known)


# Edits, as logs folded into tables; the event stream stands for users

_EDITS = f"{views.EVENT_PACKETS}, ed AS (SELECT seq, device_id AS id, CASE event_type WHEN 'click' THEN 'user_name' WHEN 'view' THEN 'user_device_class' ELSE 'notes' END AS field, CASE WHEN k % 5 > 0 THEN 'v' || k END AS value FROM ev)"


@query(
    f"""WITH {_EDITS}, l AS (SELECT id, field, arg_max(row(value), seq) AS v FROM ed GROUP BY ALL), p AS (SELECT d.*, l.field, l.v FROM devices d LEFT JOIN l ON l.id = d.id)
    SELECT id, {", ".join(f"CASE WHEN count(*) FILTER (field = '{c}') > 0 THEN max(v[1]) FILTER (field = '{c}') ELSE any_value({c}) END AS {c}" for c in ("user_name", "user_device_class", "notes"))} FROM p GROUP BY id"""
)
def q118_user_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP-7: devices after the edits of users; an edit to nothing clears."""
    e = views.event_packets(spark, sf_dir)
    field = F.when(F.col("event_type") == "click", "user_name").when(F.col("event_type") == "view", "user_device_class").otherwise("notes")
    edits = e.select(F.col("device_id").alias("id"), field.alias("field"), F.when(F.col("k") % 5 > 0, F.concat(F.lit("v"), F.col("k").cast("string"))).alias("value"), "seq")
    rows = read(spark, sf_dir, "devices").select("id", "user_name", "user_device_class", "notes")
    return upserts.overridden(rows, edits, ["user_name", "user_device_class", "notes"])


_UPKEEP = f"{views.EVENT_PACKETS}, up AS (SELECT (k % 13 + 1)::BIGINT AS id, seq, CASE event_type WHEN 'click' THEN 'remove' WHEN 'view' THEN 'restore' WHEN 'error' THEN 'stall' ELSE CASE WHEN seq % 1000 < 3 THEN 'clear' ELSE 'name' END END AS op, CASE WHEN k % 3 > 0 THEN 'n' || k END AS value FROM ev)"


@query(
    f"""WITH {_UPKEEP}, c AS (SELECT id, max(seq) AS c FROM up WHERE op = 'clear' GROUP BY id)
    SELECT s.id, coalesce(max(r.removed), s.removed) AS removed, CASE WHEN count(n.id) > 0 THEN max(n.v) ELSE s.name END AS name, CASE WHEN max(c.c) IS NULL THEN coalesce(s.stall_count, 0) ELSE 0 END + coalesce(max(t.n), 0) AS stall_count
    FROM sniffers s LEFT JOIN c ON c.id = s.id LEFT JOIN (SELECT id, arg_max(op = 'remove', seq) AS removed FROM up WHERE op IN ('remove', 'restore') GROUP BY id) r ON r.id = s.id
    LEFT JOIN (SELECT id, (arg_max(row(value), seq))[1] AS v FROM up WHERE op = 'name' GROUP BY id) n ON n.id = s.id LEFT JOIN (SELECT up.id, count(*) AS n FROM up LEFT JOIN c ON c.id = up.id WHERE op = 'stall' AND (c.c IS NULL OR seq > c.c) GROUP BY up.id) t ON t.id = s.id GROUP BY s.id, s.removed, s.name, s.stall_count"""
)
def q119_receiver_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP-6: receivers after removals, names, stalls and clearings."""
    e, t = views.event_packets(spark, sf_dir), F.col("event_type")
    op = F.when(t == "click", "remove").when(t == "view", "restore").when(t == "error", "stall").when(F.col("seq") % 1000 < 3, "clear").otherwise("name")
    log = e.select((F.col("k") % 13 + 1).cast("long").alias("id"), op.alias("op"), F.when(F.col("k") % 3 > 0, F.concat(F.lit("n"), F.col("k").cast("string"))).alias("value"), F.col("seq").cast("double").alias("seq"))
    return upserts.maintained(read(spark, sf_dir, "sniffers").select("id", "name", "removed", "stall_count", "last_stall_at"), log).select("id", "removed", "name", "stall_count")


@query("WITH e AS (SELECT session_id AS id, max(ts) AS t, count(*) AS n FROM packets WHERE ts < 1796601600 GROUP BY 1) SELECT s.id, coalesce(e.t, s.ended_at) AS ended_at, coalesce(CASE WHEN e.n > 20 THEN 'ended by a packet' END, s.notes) AS notes FROM sessions s LEFT JOIN e ON e.id = s.id")
def q120_session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP-14: sessions ended by their last packets; notes stay where the end has none."""
    p = read(spark, sf_dir, "packets").filter("ts < 1796601600")
    busy = p.groupBy(F.col("session_id").alias("id")).agg(F.max("ts").alias("at"), F.count(F.lit(1)).alias("n")).select("id", "at", F.when(F.col("n") > 20, "ended by a packet").alias("notes"), F.col("at").alias("seq"))
    return upserts.ended(read(spark, sf_dir, "sessions").select("id", "ended_at", "notes"), busy).select("id", "ended_at", "notes")


@query(
    f"""WITH {views.EVENT_PACKETS}, h AS (SELECT seq, CASE WHEN k % 7 = 0 THEN 'bad' ELSE CASE WHEN crc_ok THEN upper(md5(CAST(k AS VARCHAR))) ELSE md5(CAST(k AS VARCHAR)) END END AS key_hex, CASE WHEN event_type <> 'view' THEN event_type END AS label, CASE WHEN channel > 37 THEN device_id END AS device_id FROM ev)
    SELECT lower(key_hex) AS key_hex, arg_min(label, seq) FILTER (label IS NOT NULL) AS label, arg_max(device_id, seq) FILTER (device_id IS NOT NULL) AS device_id FROM h WHERE regexp_matches(lower(key_hex), '^[0-9a-f]{{32}}$') GROUP BY 1"""
)
def q121_identity_keys_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP-14: identity keys entered and linked."""
    e = views.event_packets(spark, sf_dir)
    digits = F.md5(F.col("k").cast("string"))
    key = F.when(F.col("k") % 7 == 0, "bad").when(F.col("crc_ok"), F.upper(digits)).otherwise(digits)
    return upserts.keys_added(e.select("seq", key.alias("key_hex"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("label"), F.when(F.col("channel") > 37, F.col("device_id")).alias("device_id")))


@query(f"WITH {views.EVENT_PACKETS} SELECT k, arg_max(event_type, row(ts, seq)) AS status, arg_max(device_id, row(ts, seq)) AS device_id FROM ev GROUP BY k")
def q122_request_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP-11: the state of each request, from its log."""
    e = views.event_packets(spark, sf_dir).select("k", "ts", "seq", F.col("event_type").alias("status"), "device_id")
    return upserts.current_state(e, "k", "ts", "seq").select("k", "status", "device_id")


# Written parts and streams


@query("SELECT lang, sum(octet_length(encode(t)) + 1)::BIGINT AS bytes, count(*) AS lines FROM (SELECT coalesce(lang, '-') AS lang, replace(replace(coalesce(title, ''), chr(10), ' '), chr(13), ' ') AS t FROM documents) GROUP BY lang")
def q123_rotated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3: titles written as text in parts of bounded size, read back and counted."""
    clean = F.translate(F.coalesce("title", F.lit("")), "\n\r", "  ")
    lines = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("lang", F.lit("-")), F.lit("\x01"), clean).alias("value"))
    root = fresh_folder(spark, "text")
    sinks.text_by_size(lines, root, 64_000, "doc_id")
    parts = F.split("value", "\x01")
    back = spark.read.text(root).select(parts[0].alias("lang"), parts[1].alias("t"))
    return back.groupBy("lang").agg(F.sum(F.octet_length("t") + 1).alias("bytes"), F.count(F.lit(1)).alias("lines"))


@query("SELECT 'types' AS topic, event_type AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'users', CAST(user_id % 10 AS VARCHAR), count(*) FROM events GROUP BY 2")
def q124_bus_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16: a stream published to three subscribers, one of which fails each time."""
    root = fresh_folder(spark, "bus")

    def counting(topic: str, key: F.Column):
        return lambda batch, number: batch.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("topic", F.lit(topic)).write.mode("overwrite").parquet(f"{root}/{topic}/batch={number}")

    def failing(batch: DataFrame, number: int) -> None:
        raise RuntimeError("a subscriber that always fails")

    subscribers = {"types": counting("types", F.col("event_type")), "broken": failing, "users": counting("users", (F.col("user_id") % 10).cast("string"))}
    bus.publish(_stream(spark, sf_dir, "events"), subscribers, f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/types").unionByName(spark.read.parquet(f"{root}/users")).groupBy("topic", "key").agg(F.sum("n").alias("n"))


@query(f"WITH {views.EVENT_PACKETS} SELECT device_id, rssi_mean, n FROM (SELECT device_id, (us // 3600000000) AS h, round(avg(CASE WHEN crc_ok THEN rssi END), 6) AS rssi_mean, count(*) AS n FROM ev GROUP BY ALL)")
def q125_hourly_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-10: mean level and packets of each device and hour, by windows of event time."""
    e = views.event_packets(spark, sf_dir)
    return e.groupBy(F.window("at", "1 hour"), "device_id").agg(F.round(F.avg(F.when(F.col("crc_ok"), F.col("rssi"))), 6).alias("rssi_mean"), F.count(F.lit(1)).alias("n")).drop("window")


@query()
def q126_stream_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-9: templates mined from a stream of log lines: the first line of each, then summaries."""
    root = fresh_folder(spark, "stream-lines")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    told = _log_lines(spark, sf_dir).filter("ts is not null").select(F.coalesce("level", F.lit("-")).alias("source"), "ts", "body")
    told.write.parquet(f"{root}/lines")
    stream = spark.readStream.schema(told.schema).parquet(f"{root}/lines")
    stateful.templates(stream).writeStream.format("parquet").option("path", f"{root}/templates").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/templates")


@query()
def q127_stream_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-7: stalls told by a watchdog over a stream of receivers' packets, with its attempts."""
    root = fresh_folder(spark, "stream-watch")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    e = _stream(spark, sf_dir, "events").select((F.col("event_id") % 4).cast("string").alias("sniffer"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("ts").cast("timestamp").alias("at"))
    stateful.watchdog(e, stall=1.0).writeStream.format("parquet").option("path", f"{root}/alarms").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("sniffer string, silent_for double, attempt int, stuck boolean").parquet(f"{root}/alarms")
