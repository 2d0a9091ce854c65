"""Views of the test tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.operators.observe import observations, vocabulary
from radiolake.runtime import read


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations per session and device."""
    return observations(read(spark, sf_dir, "packets"), ["session_id", "device_id"], is_advertising=F.col("pdu_type").between(0, 7))


OBSERVED = """obs AS (SELECT session_id, device_id, count(*) AS packet_count, count(*) FILTER (coalesce(pdu_type BETWEEN 0 AND 7, TRUE)) AS adv_count,
  count(*) FILTER (NOT coalesce(pdu_type BETWEEN 0 AND 7, TRUE)) AS data_count, min(rssi) AS rssi_min, max(rssi) AS rssi_max, CAST(sum(rssi) AS BIGINT) AS rssi_sum,
  count(rssi) AS rssi_samples, min(ts) AS first_seen, max(ts) AS last_seen FROM packets GROUP BY session_id, device_id)"""


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices with their effective class."""
    return read(spark, sf_dir, "devices").withColumn("device_class", F.coalesce("user_device_class", "device_class"))


DEVICES = "dev AS (SELECT * REPLACE (coalesce(user_device_class, device_class) AS device_class) FROM devices)"


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as packets with a checksum flag: errors are corrupted."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("at"),
        F.col("user_id").alias("device_id"), (F.col("event_type") != "error").alias("crc_ok"), (-(F.floor("value").cast("int") % 70 + 30)).cast("int").alias("rssi"),
        (F.col("event_id") % 3 + 37).cast("int").alias("channel"), (F.col("event_id") % 4).cast("int").alias("sniffer_id"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type",
    )


EVENT_PACKETS = """ev AS (SELECT event_id AS seq, epoch_us(ts) / 1e6 AS ts, epoch_us(ts) AS us, ts AS at, user_id AS device_id, event_type <> 'error' AS crc_ok,
  CAST(-(CAST(floor(value) AS INTEGER) % 70 + 30) AS INTEGER) AS rssi, CAST(event_id % 3 + 37 AS INTEGER) AS channel, CAST(event_id % 4 AS INTEGER) AS sniffer_id,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events)"""


def event_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of the event stream: clicks and views name services, other events carry vendor messages with a handoff and a nearby part."""
    low, high = F.lpad(F.hex(F.col("k") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col("k") / 256)), 2, "0")
    service = F.col("event_type").isin("click", "view")
    value = F.when(service, F.concat(low, high)).otherwise(F.concat(F.lit("4C000C0308"), high, low, F.lit("1002"), low, F.lit("00")))
    rows = event_packets(spark, sf_dir).select("device_id", "ts", F.when(service, 3).otherwise(255).alias("ad_type"), F.unhex(value).alias("ad_value"))
    return vocabulary(rows, ["device_id", "ad_type", "ad_value"])


EVENT_VOCABULARY = (
    EVENT_PACKETS
    + """, voc AS (SELECT device_id, CASE WHEN event_type IN ('click', 'view') THEN 3 ELSE 255 END AS ad_type,
  CASE WHEN event_type IN ('click', 'view') THEN printf('%02X%02X', k % 256, k // 256) ELSE printf('4C000C0308%02X%02X1002%02X00', k // 256, k % 256, k % 256) END AS v, k,
  min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM ev GROUP BY ALL)"""
)


def event_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices of the event stream (``id``) with their market segment as class."""
    seen = read(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    classes = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("device_class"))
    return seen.join(classes, "id")


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of the event stream's devices, of one market segment."""
    from radiolake.operators.candidates import same_class_pairs

    return same_class_pairs(event_devices(spark, sf_dir))


EVENT_PAIRS = """cls AS (SELECT DISTINCT user_id AS id, c_mktsegment AS device_class FROM events JOIN customer ON c_custkey = user_id),
pairs AS (SELECT x.id AS a, y.id AS b FROM cls x JOIN cls y ON x.device_class = y.device_class AND x.id < y.id)"""
