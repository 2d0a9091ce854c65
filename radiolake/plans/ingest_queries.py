"""Queries over file ingest: dissector lines are written from the tables, read and normalised, and folded into the target tables. The SQL starts from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions import frames, identity
from radiolake.operators import ingest
from radiolake.plans.registry import registry
from radiolake.runtime import fresh_folder, materialize, read
from radiolake.sources import dissected, sinks

QUERIES, SQL, query = registry()
VENDOR_CLASSES = ["airpods", "airtag", "apple_watch", "apple_device", "phone"]
#: Manufacturer data by channel: a pairing, a nearby, a pairing-state and a finding message.
MESSAGES = {37: "07:03:01:0e:20", 38: "10:02:0d:00", 39: "12:02:00:03"}
OTHER_MESSAGE = "16:01:00"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, value``: a dissector's line for every packet, in the forms a dissector writes (hex and decimal, single and listed, two kinds of receiver), between index
    lines and broken ones."""
    a = read(spark, sf_dir, "addresses").select(F.col("id").alias("address_id"), "address", "address_type").distinct()
    d = read(spark, sf_dir, "devices").select(F.col("id").alias("device_id"), "local_name", "vendor_id", "appearance", "device_class")
    p = read(spark, sf_dir, "packets").select("id", "ts", "rssi", "channel", "pdu_type", "sniffer_id", "address_id", "device_id").join(a, "address_id", "left").join(d, "device_id", "left")
    own, ext = F.col("sniffer_id").isNotNull(), F.col("pdu_type") == 7
    code = lambda c, n: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), n, "0"))
    text = lambda c: F.col(c).cast("string")
    company = F.when(F.col("device_class").isin(VENDOR_CLASSES), 76).otherwise(F.col("vendor_id"))
    message = F.when(F.col("channel").isNotNull(), F.coalesce(frames.lookup(MESSAGES, F.col("channel")), F.lit(OTHER_MESSAGE)))
    number = F.lpad(F.hex(F.col("device_id")), 6, "0")
    announced = F.concat_ws(":", *[F.lower(F.substring(number, k, 2)) for k in (5, 3, 1)])
    flags = F.when(F.col("channel") == 37, "01").otherwise("00")
    tx = F.when(F.col("address_type") == "public", "0").when(F.col("address_type") == "nrpa", "True").when(F.col("address_type").isNotNull(), "1")
    bad = F.when((F.col("rssi") > 10) | (F.col("rssi") < -120), "0").when(F.col("rssi").isNotNull(), "1")
    key = "btcommon_btcommon_eir_ad_entry_"
    link = F.struct(
        F.when(own, text("pdu_type")).otherwise(code(F.col("pdu_type"), 2)).alias("btle_btle_advertising_header_pdu_type"), F.array(F.upper("address")).alias("btle_btle_advertising_address"),
        tx.alias("btle_btle_advertising_header_randomized_tx"),
    )
    common = F.struct(
        F.col("local_name").alias(key + "device_name"), F.when(ext, F.array(F.lit("0x1852"), F.lit("6230"))).when(company.isNotNull(), F.array(F.lit("0x180f"))).alias(key + "uuid_16"),
        code(company, 4).alias(key + "company_id"), F.when(company.isNotNull(), message).alias(key + "data"), text("rssi").alias(key + "power_level"), code(F.col("appearance"), 4).alias(key + "appearance"),
        F.when(ext, F.array(F.lit("0x16"), F.lit("22"))).alias(key + "type"), F.when(ext, F.array(announced, flags)).alias(key + "service_data"), F.when(ext, F.array("local_name")).alias(key + "broadcast_name"),
    )
    nordic = F.when(own, F.struct(text("channel").alias("nordic_ble_nordic_ble_channel"), text("rssi").alias("nordic_ble_nordic_ble_rssi"), bad.alias("nordic_ble_nordic_ble_crcok"), F.when(ext, "2").otherwise("0").alias("nordic_ble_nordic_ble_phy")))
    radio = F.when(~own, F.struct(text("channel").alias("btle_rf_btle_rf_channel"), F.array(text("rssi")).alias("btle_rf_btle_rf_signal_dbm"), F.lit("1").alias("btle_rf_btle_rf_phy")))
    document = F.to_json(F.struct(F.floor(F.col("ts") * 1000).cast("string").alias("timestamp"), F.struct(link.alias("btle"), nordic.alias("nordic_ble"), radio.alias("btle_rf"), common.alias("btcommon")).alias("layers")))
    between = read(spark, sf_dir, "sessions").select(F.lit(None).cast("long").alias("seq"), F.explode(F.array(F.lit('{"index": {"_type": "doc"}}'), F.lit("cut {"), F.lit('{"timestamp": "5", "layers": {"frame": {}}}'))).alias("value"))
    return p.select(F.col("id").alias("seq"), document.alias("value")).unionAll(between)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dissected.packets(dissected.parsed(lines(spark, sf_dir)), keep=["seq"])


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return ingest.tables(materialize(packets(spark, sf_dir), "packets"), 1)  # lines are read once for all tables


_NAMES = ", ".join(f"'{n}'" for n in frames.PDU_NAMES)
_CLASS = (
    "CASE WHEN (appearance >> 6) & 1023 = 15 THEN CASE appearance & 63 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in identity.INPUT_DEVICES.items())
    + " ELSE 'hid' END ELSE CASE (appearance >> 6) & 1023 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in identity.APPEARANCE.items()) + " END END"
)
_BASE = f"""ad AS (SELECT DISTINCT id, address, address_type FROM addresses),
n AS (SELECT p.id AS seq, p.device_id, coalesce(CAST(floor(p.ts * 1000) AS BIGINT) / 1000, 0.0) AS ts, p.channel, p.rssi, CASE WHEN p.sniffer_id IS NULL THEN '2M' WHEN p.pdu_type = 7 THEN 'Coded' ELSE '1M' END AS phy, list_extract([{_NAMES}], p.pdu_type + 1) AS pdu_type,
  a.address AS adv_addr, CASE WHEN a.address_type IS NOT NULL THEN a.address_type <> 'public' END AS is_random, p.sniffer_id IS NULL OR p.rssi IS NULL OR p.rssi BETWEEN -120 AND 10 AS crc_ok, d.local_name AS name, d.appearance,
  CASE WHEN d.device_class IN ({", ".join(f"'{c}'" for c in VENDOR_CLASSES)}) THEN 76 ELSE d.vendor_id END AS company, CASE p.channel {" ".join(f"WHEN {k} THEN '{v}'" for k, v in MESSAGES.items())} ELSE CASE WHEN p.channel IS NOT NULL THEN '{OTHER_MESSAGE}' END END AS msg, p.pdu_type = 7 AS ext
  FROM packets p LEFT JOIN ad a ON a.id = p.address_id LEFT JOIN devices d ON d.id = p.device_id),
t AS (SELECT *, CASE WHEN company IS NOT NULL THEN msg END AS data, CASE WHEN ext THEN [6226, 6230] WHEN company IS NOT NULL THEN [6159] ELSE [] END AS uuids,
  CASE WHEN is_random IS NULL THEN 'unknown' WHEN NOT is_random THEN 'public' ELSE CASE CAST('0x' || substr(adv_addr, 1, 2) AS INTEGER) >> 6 WHEN 3 THEN 'random_static' WHEN 1 THEN 'rpa' WHEN 0 THEN 'nrpa' ELSE 'unknown' END END AS address_type FROM n),
k AS (SELECT *, CASE address_type WHEN 'public' THEN 'pub:' WHEN 'random_static' THEN 'rs:' WHEN 'rpa' THEN 'rpa:' WHEN 'nrpa' THEN 'nrpa:' ELSE 'anon:' END || adv_addr AS stable_key,
  CASE address_type WHEN 'public' THEN 'public_mac' WHEN 'random_static' THEN 'random_static_mac' WHEN 'rpa' THEN 'unresolved_rpa' WHEN 'nrpa' THEN 'nrpa' ELSE 'unknown' END AS kind,
  CASE WHEN company = 76 AND channel IS NOT NULL THEN CASE channel WHEN 37 THEN 'airpods' WHEN 38 THEN 'apple_watch' WHEN 39 THEN 'apple_device' ELSE 'airtag' END ELSE {_CLASS} END AS cls,
  CASE WHEN company = 76 THEN CASE WHEN channel = 37 THEN 'AirPods Pro' WHEN channel = 38 THEN 'Apple Watch' WHEN channel <> 39 THEN 'AirTag' END END AS model
  FROM t WHERE crc_ok AND adv_addr IS NOT NULL)"""
_RANK = "CASE " + " ".join(f"WHEN cls = '{c}' THEN {r}" for c, r in identity.PRECEDENCE.items()) + " ELSE 3 END"


@query(f"WITH {_BASE} SELECT seq, ts, channel, rssi, phy, pdu_type, adv_addr, is_random, crc_ok, name, company, data, rssi AS power, appearance, array_to_string(uuids, ',') AS uuids FROM t")
def q84_ingest_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1, FLT-1, FLT-2, SF-1 to SF-4: normalised packets of dissector lines."""
    shown = F.array_join(F.transform("uuids", lambda u: u.cast("string")), ",").alias("uuids")
    return packets(spark, sf_dir).select("seq", "ts", "channel", "rssi", "phy", "pdu_type", "adv_addr", "is_random", "crc_ok", "name", "company", "data", "power", "appearance", shown)


@query(
    f"""WITH {_BASE} SELECT stable_key, arg_min(kind, seq) AS kind, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(name, seq) FILTER (name <> '') AS local_name, arg_max(company, seq) FILTER (company IS NOT NULL) AS vendor_id,
    arg_max(model, seq) FILTER (model IS NOT NULL) AS model, arg_max(appearance, seq) FILTER (appearance IS NOT NULL) AS appearance, arg_max(cls, row({_RANK}, -seq)) FILTER (cls IS NOT NULL) AS device_class FROM k GROUP BY stable_key"""
)
def q85_ingest_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-3, UP-1, SF-12, SF-14 to SF-16, SF-28: devices of an ingest with what their packets tell."""
    return _tables(spark, sf_dir)["devices"].drop("vendor")


@query(f"WITH {_BASE} SELECT adv_addr AS address, address_type, arg_min(stable_key, seq) AS device_id, min(ts) AS first_seen, max(ts) AS last_seen FROM k GROUP BY ALL")
def q86_ingest_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP-2: addresses of an ingest, under the first device they were told of."""
    return _tables(spark, sf_dir)["addresses"]


_LE = "printf('%02X%02X', {0} & 255, ({0} >> 8) & 255)"
_WORDS = f"""e AS (SELECT stable_key, ts, 9 AS ad_type, hex(encode(name)) AS v FROM k WHERE name <> '' UNION ALL SELECT stable_key, ts, 3, {_LE.format("u")} FROM (SELECT stable_key, ts, unnest(uuids) AS u FROM k)
  UNION ALL SELECT stable_key, ts, 255, {_LE.format("company")} || upper(replace(coalesce(data, ''), ':', '')) FROM k WHERE company IS NOT NULL
  UNION ALL SELECT stable_key, ts, 10, printf('%02X', greatest(-128, least(127, rssi)) & 255) FROM k WHERE rssi IS NOT NULL UNION ALL SELECT stable_key, ts, 25, {_LE.format("appearance")} FROM k WHERE appearance IS NOT NULL)"""


@query(f"WITH {_BASE}, {_WORDS} SELECT stable_key, ad_type, v AS ad_value, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS count FROM e GROUP BY ALL")
def q87_ingest_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF-13: vocabulary of an ingest in canonical form."""
    return _tables(spark, sf_dir)["ad_history"].withColumn("ad_value", F.hex("ad_value"))


@query(f"WITH {_BASE} SELECT stable_key, count(*) AS packet_count, count(*) AS adv_count, min(rssi) AS rssi_min, max(rssi) AS rssi_max, CAST(sum(rssi) AS BIGINT) AS rssi_sum, count(rssi) AS rssi_samples, min(ts) AS first_seen, max(ts) AS last_seen FROM k GROUP BY stable_key")
def q88_ingest_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-1 over an ingest: counters per device of the session."""
    return _tables(spark, sf_dir)["observations"].drop("session_id", "data_count")


@query(
    f"""WITH {_BASE} SELECT CAST(device_id AS INTEGER) AS broadcast_id, arg_max(stable_key, seq) AS broadcaster_device_id, arg_max(name, seq) FILTER (name IS NOT NULL) AS broadcast_name, bool_or(coalesce(channel = 37, FALSE)) AS encrypted, min(ts) AS first_seen, max(ts) AS last_seen
    FROM k WHERE ext AND device_id IS NOT NULL GROUP BY device_id"""
)
def q89_ingest_broadcasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP-4, SF-24: audio broadcasts announced by extended packets."""
    return _tables(spark, sf_dir)["broadcasts"].drop("session_id", "bis_count", "phy")


@query(
    f"""WITH {_BASE} SELECT count(*) AS packets, count(*) FILTER (NOT crc_ok) AS corrupted, count(*) FILTER (crc_ok AND adv_addr IS NULL) AS without_address, (SELECT count(DISTINCT stable_key) FROM k) AS devices, (SELECT count(DISTINCT adv_addr) FROM k) AS addresses,
    count(*) FILTER (crc_ok AND adv_addr IS NOT NULL AND ext) AS extended, count(*) FILTER (crc_ok AND adv_addr IS NOT NULL AND ext AND device_id IS NOT NULL) AS announcing FROM t"""
)
def q90_ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6, AG-19: the counters of an ingest."""
    return ingest.report(packets(spark, sf_dir))


@query(f"WITH {_BASE}, {_WORDS} SELECT 'devices' AS name, count(DISTINCT stable_key) AS n FROM k UNION ALL SELECT 'addresses', count(*) FROM (SELECT DISTINCT adv_addr, address_type FROM k) UNION ALL SELECT 'ad_history', count(*) FROM (SELECT DISTINCT stable_key, ad_type, v FROM e)")
def q91_ingest_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1: the tables of an ingest written at once and read back."""
    found, root = _tables(spark, sf_dir), fresh_folder(spark, "ingest")
    sinks.swap({n: found[n] for n in ("devices", "addresses", "ad_history")}, root)
    counts = [sinks.table(spark, root, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("devices", "addresses", "ad_history")]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query(f"WITH {_BASE} SELECT coalesce(channel, 0) AS channel, coalesce(rssi, 0) AS rssi, coalesce(list_position([{_NAMES}], pdu_type) - 1, 255)::INTEGER AS pdu_type, count(*) AS n FROM k GROUP BY ALL")
def q92_packet_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UP-15: the packet log an ingest keeps when asked to, by what it holds."""
    kept = ingest.packet_log(packets(spark, sf_dir), 1)
    return kept.groupBy("channel", "rssi", "pdu_type").agg(F.count(F.lit(1)).alias("n"))
