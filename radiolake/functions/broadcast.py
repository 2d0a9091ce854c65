"""Audio broadcast announcements in dissected AD fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from radiolake.functions.binary import le24, to_bytes, u8
from radiolake.functions.frames import lookup

#: Service ids of the announcement and of its public part, AD types that carry service ids or service data.
ANNOUNCEMENT, PUBLIC = 0x1852, 0x1856
WITH_UUID, WITH_DATA, SERVICE_DATA = [0x02, 0x03, 0x14, 0x16], [0x16, 0x20, 0x21], 0x16
PHYS = {0: "1M", 1: "2M", 2: "Coded"}


def announcement(types: Column, uuids: Column, datas: Column) -> Column:
    """Struct (broadcast_id, features, encrypted) from parallel arrays of AD types, 16-bit services and service data (hex text).

    Each AD type takes the next service id and the next data of those kinds that it carries. Null unless the announcement's id is among
    the services and a broadcast id comes out; where pairing fails, the first data of exactly three bytes is taken for it.
    """
    empty = F.struct(F.lit(0).alias("u"), F.lit(0).alias("d"), F.lit(None).cast("int").alias("id"), F.lit(None).cast("int").alias("features"))

    def step(s: Column, t: Column) -> Column:
        takes_u, takes_d = t.isin(WITH_UUID), t.isin(WITH_DATA)
        u, d = F.get(uuids, s["u"]), to_bytes(F.get(datas, s["d"]))
        paired = (t == SERVICE_DATA) & u.isNotNull() & d.isNotNull()
        found = F.when(s["id"].isNull() & paired & (u == ANNOUNCEMENT) & (F.length(d) >= 3), le24(d, 0))
        feature = F.when(s["features"].isNull() & paired & (u == PUBLIC) & (F.length(d) >= 1), u8(d, 0))
        return F.struct(
            (s["u"] + F.coalesce(takes_u, F.lit(False)).cast("int")).alias("u"), (s["d"] + F.coalesce(takes_d, F.lit(False)).cast("int")).alias("d"),
            F.coalesce(s["id"], found).alias("id"), F.coalesce(s["features"], feature).alias("features"),
        )

    walked = F.aggregate(types, empty, step)
    three = F.get(F.transform(F.filter(datas, lambda x: F.length(to_bytes(x)) == 3), lambda x: le24(to_bytes(x), 0)), F.lit(0))
    ident = F.coalesce(walked["id"], three)
    out = F.struct(ident.alias("broadcast_id"), walked["features"].alias("features"), F.coalesce(walked["features"].bitwiseAND(1) == 1, F.lit(False)).alias("encrypted"))
    return F.when(F.array_contains(uuids, ANNOUNCEMENT) & ident.isNotNull(), out)


def group_info(num_bis: Column, phy: Column, max_pdu: Column, max_sdu: Column, sdu_interval: Column, iso_interval: Column, key: Column) -> Column:
    """Struct of a periodic advertisement's stream group; a group key means encrypted."""
    return F.struct(
        num_bis.alias("bis_count"), lookup(PHYS, phy).alias("phy"), max_pdu.alias("max_pdu"), max_sdu.alias("max_sdu"),
        sdu_interval.alias("sdu_interval_us"), iso_interval.alias("iso_interval"), key.isNotNull().alias("encrypted"),
    )
