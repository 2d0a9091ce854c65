"""Captured link-layer frames: pseudo-headers, advertising headers, extended headers and AD structures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from radiolake.functions.binary import Offset, i8, le16, mac, part, records, tail, to_bytes, u8

#: Fixed values of the link layer: access address of advertising as sent, names of PDU types, sizes of the optional extended fields.
ACCESS_ADDRESS = "D6BE898E"
PDU_NAMES = ["ADV_IND", "ADV_DIRECT_IND", "ADV_NONCONN_IND", "SCAN_REQ", "SCAN_RSP", "CONNECT_IND", "ADV_SCAN_IND", "ADV_EXT_IND"]
EXTENDED_SIZES = [6, 6, 1, 2, 3, 18, 1]
PSEUDO_HEADER = {256: 10, 272: 17}
CRC_FAIL = "CRC_FAIL"


def lookup(names: dict, key: Column, default: Column | None = None) -> Column:
    """A small fixed table as an expression; keys and values in order of the table."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def pdu_name(code: Column) -> Column:
    return F.coalesce(lookup(dict(enumerate(PDU_NAMES)), code.cast("int")), F.concat(F.lit("0x"), F.hex(code)))


def link_layer(ll: Column) -> Column:
    """Struct (pdu_type, header, tx_random, rx_random, address, data) of a link-layer frame; null if it isn't advertising or is cut too short.

    The payload is what the header's length says or what is there. Extended payloads name their address only if
    the flag for it is set; a header longer than the payload or fields longer than the header give neither address nor data.
    """
    header = le16(ll, 4)
    code, payload = header.bitwiseAND(15), part(ll, 6, u8(ll, 5))
    ext, flags = u8(payload, 0).bitwiseAND(63), u8(payload, 1)
    fields = sum((F.when(flags.bitwiseAND(1 << bit) != 0, size).otherwise(0) for bit, size in enumerate(EXTENDED_SIZES)), F.lit(2))
    sound = (F.length(payload) >= ext + 1) & (ext > 0) & (fields <= ext + 1)
    extended_address = F.when(sound & (flags.bitwiseAND(1) != 0), mac(payload, 2))
    extended_data = F.when(ext == 0, tail(payload, 1)).when(sound, tail(payload, ext + 1)).otherwise(F.to_binary(F.lit(""), F.lit("hex")))
    is_ext = code == 7
    out = F.struct(
        pdu_name(code).alias("pdu_type"), header.alias("header"), (header.bitwiseAND(64) != 0).alias("tx_random"), (header.bitwiseAND(128) != 0).alias("rx_random"),
        F.when(is_ext, extended_address).otherwise(mac(payload, 0)).alias("address"), F.when(is_ext, extended_data).otherwise(tail(payload, 6)).alias("data"),
    )
    return F.when((F.length(ll) >= 15) & (F.hex(part(ll, 0, 4)) == ACCESS_ADDRESS) & (is_ext | (F.length(payload) >= 6)), out)


def captured(buf: Column, dlt: Column) -> Column:
    """Struct (channel, rssi, crc_ok, frame) of a capture record of link type 256 or 272; null if it is too short or of another type.

    A record whose checksum failed keeps channel and level only. Type 256 says so by bit 10 (checked) without bit 11 (valid) of its flags and needs a
    whole frame; type 272 by bit 0 of its flags, and then needs its header only.
    """
    checked = le16(buf, 8)
    bad256 = (checked.bitwiseAND(1 << 10) != 0) & (checked.bitwiseAND(1 << 11) == 0)
    bad272 = u8(buf, 8).bitwiseAND(1) == 0

    def of(channel: Column, rssi: Column, bad: Column, header: Offset) -> Column:
        frame = link_layer(tail(buf, header))
        whole = F.struct(channel.alias("channel"), rssi.alias("rssi"), (~bad).alias("crc_ok"), F.when(~bad, frame).alias("frame"))
        return F.when(bad | frame.isNotNull(), whole)

    n = F.length(buf)
    return F.when((dlt == 256) & (n >= 25), of(u8(buf, 0), i8(buf, 1), bad256, 10)).when((dlt == 272) & (n >= 17), of(u8(buf, 9), -u8(buf, 10), bad272, 17))


def ad_structures(data: Column) -> Column:
    """Array of (type, value) of an AD stream; stops at a zero length or where an entry would run over the end."""

    def size(b: Column, at: Column) -> Column:
        n = u8(b, at)
        return F.when((n > 0) & (at + 1 + n <= F.length(b)), n + 1)

    return records(data, 0, lambda b, at: F.struct(u8(b, at + 1), part(b, at + 2, u8(b, at) - 1)), size, "struct<type:int,value:binary>")


def canonical_entries(name: Column, uuids: Column, company: Column, data: Column, power: Column, appearance: Column) -> Column:
    """Vocabulary entries (type, value) of dissected fields: name, each 16-bit service, company with its data, transmit power, appearance.

    ``uuids`` is an array of INT, ``data`` hex text, the others scalars; missing fields give no entry.
    """
    kind = "struct<type:int,value:binary>"
    le = lambda v: F.unhex(F.concat(F.lpad(F.hex(v.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(v, 8).bitwiseAND(255)), 2, "0")))
    one = lambda code, value, when: F.when(when, F.array(F.struct(F.lit(code), value).cast(kind)))
    clamped = F.greatest(F.lit(-128), F.least(F.lit(127), power))
    none = F.array().cast(f"array<{kind}>")
    parts = [
        one(9, F.encode(name, "UTF-8"), name != ""),
        F.transform(F.filter(uuids, lambda u: u.isNotNull()), lambda u: F.struct(F.lit(3), le(u)).cast(kind)),
        one(255, F.concat(le(company), F.coalesce(to_bytes(data), F.to_binary(F.lit(""), F.lit("hex")))), company.isNotNull()),
        one(10, F.unhex(F.lpad(F.hex(clamped.bitwiseAND(255)), 2, "0")), power.isNotNull()),
        one(25, le(appearance), appearance.isNotNull()),
    ]
    return F.concat(*[F.coalesce(p, none) for p in parts])
