"""Packets to tables: each target is one aggregation of the attributed packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.functions.broadcast import announcement
from radiolake.functions.continuity import classify, ingest_messages
from radiolake.functions.binary import bound, to_bytes
from radiolake.functions.frames import PDU_NAMES, canonical_entries, lookup
from radiolake.functions.identity import address_class, appearance_class, device_key
from radiolake.operators import observe, upserts
from radiolake.runtime import materialize

VENDOR = 0x004C


def attributed(packets: DataFrame) -> DataFrame:
    """Sound packets that name an address, with the address's type and the device's key and kind."""
    kind = F.when(F.col("is_random").isNull(), F.lit("unknown")).otherwise(address_class(F.col("adv_addr"), F.col("is_random")))
    return packets.filter("crc_ok and adv_addr is not null and adv_addr <> ''").withColumn("address_type", kind).withColumn("k", device_key(F.col("adv_addr"), F.col("address_type"))).select("*", "k.*").drop("k")


def clues(packets: DataFrame) -> DataFrame:
    """What a packet tells of its device: name, maker, appearance; class and model from one vendor's messages, else a class from the appearance."""
    told = bound(ingest_messages(F.when(F.col("company") == VENDOR, to_bytes(F.col("data")))), classify)
    return packets.withColumn("t", told).withColumns(
        {"local_name": F.nullif(F.col("name"), F.lit("")), "vendor_id": F.col("company"), "vendor": F.lit(None).cast("string"), "model": F.col("t.model"), "device_class": F.coalesce("t.device_class", appearance_class(F.col("appearance")))}
    ).drop("t")


def is_advertising(pdu_type: Column) -> Column:
    return pdu_type.isin(PDU_NAMES)


def tables(packets: DataFrame, session_id: int) -> dict[str, DataFrame]:
    """Devices, addresses, observations, vocabulary and broadcasts of one session's packets (``seq``: their order of arrival)."""
    known = materialize(clues(attributed(packets)).withColumn("session_id", F.lit(session_id)), "attributed")  # messages are read once for all tables
    entries = known.select("stable_key", "ts", F.explode(canonical_entries(*[F.col(c) for c in ("name", "uuids", "company", "data", "power", "appearance")])).alias("e"))
    spoken = known.filter("pdu_type = 'ADV_EXT_IND'").withColumn("b", announcement(F.col("ad_types"), F.col("uuids"), F.col("service_data"))).filter("b is not null")
    return {
        "devices": upserts.devices(known),
        "addresses": upserts.addresses(known.withColumnsRenamed({"adv_addr": "address", "stable_key": "device_id"})),
        "observations": observe.observations(known, ["session_id", "stable_key"], is_advertising=is_advertising(F.col("pdu_type"))),
        "ad_history": observe.vocabulary(entries.select("stable_key", "ts", F.col("e.type").alias("ad_type"), F.col("e.value").alias("ad_value")), ["stable_key", "ad_type", "ad_value"]),
        "broadcasts": upserts.broadcasts(
            spoken.select("session_id", "seq", "ts", "b.broadcast_id", F.col("stable_key").alias("broadcaster_device_id"), "broadcast_name", F.lit(None).cast("int").alias("bis_count"), F.lit(None).cast("string").alias("phy"), "b.encrypted")
        ),
    }


def report(packets: DataFrame) -> DataFrame:
    """One row of counters: packets, corrupted, unattributed, devices, addresses, extended and announcing packets."""
    known = F.col("crc_ok") & (F.coalesce("adv_addr", F.lit("")) != "")
    ext = known & (F.col("pdu_type") == "ADV_EXT_IND")
    kind = F.when(F.col("is_random").isNull(), "unknown").otherwise(address_class(F.col("adv_addr"), F.col("is_random")))
    return packets.agg(
        F.count(F.lit(1)).alias("packets"), F.count_if(~F.col("crc_ok")).alias("corrupted"), F.count_if(F.col("crc_ok") & ~known).alias("without_address"),
        F.count_distinct(F.when(known, device_key(F.col("adv_addr"), kind)["stable_key"])).alias("devices"), F.count_distinct(F.when(known, F.col("adv_addr"))).alias("addresses"),
        F.count_if(ext).alias("extended"), F.count_if(ext & announcement(F.col("ad_types"), F.col("uuids"), F.col("service_data")).isNotNull()).alias("announcing"),
    )


def packet_log(packets: DataFrame, session_id: int) -> DataFrame:
    """The log of single packets, kept on request: ``session_id, stable_key, address, ts, rssi, channel, pdu_type``, to be written partitioned by session.

    As in the tables before it, a missing level or channel is 0 and a PDU type without a code 255.
    """
    code = F.coalesce(lookup({n: i for i, n in enumerate(PDU_NAMES)}, F.col("pdu_type")), F.lit(255))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return attributed(packets).select(F.lit(session_id).alias("session_id"), "stable_key", F.col("adv_addr").alias("address"), "ts", zero("rssi"), zero("channel"), code.alias("pdu_type"))
