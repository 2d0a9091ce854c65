"""Type-length-value messages in one vendor's manufacturer data, their decoding and the classes they tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from radiolake.functions.binary import be16, i8, le16, mac, part, records, u8
from radiolake.functions.frames import lookup

#: Names of the types, bytes that stay the same when the address rotates, models of the pairing message.
TYPE_NAMES = {
    0x01: "unknown_01", 0x02: "iBeacon", 0x03: "AirPrint", 0x05: "AirDrop", 0x06: "HomeKit", 0x07: "ProximityPairing", 0x08: "HeySiri", 0x09: "AirPlaySource",
    0x0A: "AirPlayTarget", 0x0B: "MagicSwitch", 0x0C: "Handoff", 0x0D: "TetheringTarget", 0x0E: "TetheringSource", 0x0F: "NearbyAction", 0x10: "NearbyInfo",
    0x11: "FindMyOrFamily", 0x12: "Pairing", 0x13: "unknown_13", 0x14: "unknown_14", 0x16: "unknown_16",
}
STABLE_BYTES = {0x07: 4, 0x09: 4, 0x0A: 4, 0x0B: 2, 0x0C: 3, 0x0D: 2, 0x0E: 2, 0x0F: 4, 0x10: 2, 0x11: 1, 0x12: 1, 0x16: 4}
MODELS = {
    0x0220: "AirPods 1st gen", 0x0F20: "AirPods 2nd gen", 0x1320: "AirPods 3rd gen", 0x1920: "AirPods 4th gen", 0x1B20: "AirPods 4th gen w/ANC",
    0x0E20: "AirPods Pro 1st gen", 0x1420: "AirPods Pro 2nd gen", 0x2420: "AirPods Pro 2nd gen (USB-C)", 0x0520: "AirPods Max", 0x1F20: "AirPods Max (USB-C)",
    0x0320: "PowerBeats 3", 0x0620: "PowerBeats Pro", 0x0B20: "Beats Solo Pro", 0x0C20: "PowerBeats 4", 0x1020: "Beats Flex", 0x1120: "Beats Studio Buds",
    0x1720: "Beats Studio Pro", 0x1820: "Beats Solo 4", 0x1A20: "Beats Studio Buds+",
}
#: Models as ingest names them; the two tables differ in a few codes on purpose.
INGEST_MODELS = {
    0x0220: "AirPods (1st gen)", 0x0F20: "AirPods (2nd gen)", 0x1320: "AirPods (3rd gen)", 0x1920: "AirPods (4th gen)", 0x1B20: "AirPods (4th gen, ANC)",
    0x0E20: "AirPods Pro", 0x1420: "AirPods Pro (2nd gen)", 0x2420: "AirPods Pro (2nd gen, USB-C)", 0x0A20: "AirPods Max", 0x1F20: "AirPods Max (USB-C)",
    0x0520: "BeatsX", 0x0620: "Beats Solo3", 0x0920: "BeatsStudio3", 0x0B20: "Powerbeats3", 0x0C20: "Beats Solo Pro", 0x1020: "Powerbeats Pro",
    0x1120: "Beats Flex", 0x1720: "Beats Studio Buds", 0x1820: "Beats Fit Pro", 0x1D20: "Beats Studio Pro", 0x2520: "Beats Solo 4", 0x2620: "Beats Studio Buds+",
}
ACTIONS = {
    0x0: "ActivityLevel", 0x1: "VPN", 0x2: "SetupNew", 0x3: "WatchLockScreen", 0x4: "TVTransferAuthority", 0x5: "MeshRelay", 0x6: "AutoUnlock", 0x7: "ScreenSharing",
    0x8: "LiveAudio", 0x9: "TargetPresence", 0xA: "AudioTransfer", 0xB: "FollowUpScreen", 0xC: "ProximityPair", 0xD: "PairCompletion", 0xE: "Unknown",
}

KIND = "struct<type:int,length:int,payload:binary>"


def messages(blob: Column) -> Column:
    """Array of (type, length, payload) of manufacturer data that begins with the vendor's id; a message running over the end is dropped.

    Data of another vendor, or of less than four bytes, has none (an empty array).
    """

    def size(b: Column, at: Column) -> Column:
        n = u8(b, at + 1)
        return F.when(at + 2 + n <= F.length(b), n + 2)

    found = records(blob, 2, lambda b, at: F.struct(u8(b, at), u8(b, at + 1), part(b, at + 2, u8(b, at + 1))), size, KIND)
    return F.when((F.length(blob) >= 4) & (F.hex(part(blob, 0, 2)) == "4C00"), found).when(blob.isNotNull(), F.array().cast(f"array<{KIND}>"))


def ingest_messages(data: Column) -> Column:
    """Array of (type, length, payload) of manufacturer data after the vendor's id; a cut last message is kept with what there is of it."""

    def size(b: Column, at: Column) -> Column:
        return F.when(at + 2 <= F.length(b), u8(b, at + 1) + 2)

    return records(data, 0, lambda b, at: F.struct(u8(b, at), u8(b, at + 1), part(b, at + 2, u8(b, at + 1))), size, KIND)


def type_name(code: Column) -> Column:
    return lookup(TYPE_NAMES, code, F.concat(F.lit("type_0x"), F.lpad(F.hex(code), 2, "0")))


def stable_prefix(m: Column) -> Column:
    """The payload's bytes that survive a change of address."""
    return part(m["payload"], 0, F.least(lookup(STABLE_BYTES, m["type"], F.lit(0)), F.length(m["payload"])))


def _battery(nibble: Column) -> Column:
    return F.when(nibble != 15, nibble * 10)


def pairing(p: Column) -> Column:
    """Struct (model, state, status, left, right, case) of a pairing message (type 7) of at least four bytes; batteries need seven."""
    high, low = F.shiftright(u8(p, 4), 4), u8(p, 4).bitwiseAND(15)
    long = F.length(p) >= 7
    out = F.struct(
        lookup(MODELS, be16(p, 1), F.lit("unknown")).alias("model"), u8(p, 0).alias("state"), u8(p, 3).alias("status"),
        F.when(long, _battery(high)).alias("left"), F.when(long, _battery(low)).alias("right"), F.when(long, _battery(F.shiftright(u8(p, 5), 4))).alias("case"),
    )
    return F.when(F.length(p) >= 4, out)


def nearby(p: Column) -> Column:
    """Struct (action, name, flags, wifi, earbuds, authenticated) of a nearby message (type 16); the action is the high four bits."""
    action, status = F.shiftright(u8(p, 0), 4), u8(p, 1)
    bit = lambda mask: status.bitwiseAND(mask) != 0
    out = F.struct(action.alias("action"), lookup(ACTIONS, action, F.lit("unknown")).alias("name"), u8(p, 0).bitwiseAND(15).alias("flags"), bit(0x80).alias("wifi"), bit(0x40).alias("earbuds"), bit(0x20).alias("authenticated"))
    return F.when(F.length(p) >= 1, out)


def pair_state(p: Column) -> Column:
    """Struct (variant, code) of a pairing-state message (type 18), by its length."""
    n = F.length(p)
    return F.struct(F.when(n == 2, "state_code").when(n.between(4, 6), "short_auth").when(n >= 24, "find_my_anchor").otherwise("unknown_length").alias("variant"), F.when(n == 2, be16(p, 0)).alias("code"))


def handoff(p: Column) -> Column:
    """Struct (clipboard, has_data, seq) of a handoff message (type 12) of at least three bytes."""
    return F.when(F.length(p) >= 3, F.struct(u8(p, 0).alias("clipboard"), (u8(p, 0) == 8).alias("has_data"), be16(p, 1).alias("seq")))


def beacon(p: Column) -> Column:
    """Struct (uuid, major, minor, power) of a beacon message (type 2) of at least 21 bytes."""
    return F.when(F.length(p) >= 21, F.struct(F.lower(F.hex(part(p, 0, 16))).alias("uuid"), be16(p, 16).alias("major"), be16(p, 18).alias("minor"), i8(p, 20).alias("power")))


def home(p: Column) -> Column:
    """Struct (flag, device, category, state, config) of a home accessory's message (type 6) of at least 13 bytes."""
    return F.when(F.length(p) >= 13, F.struct(u8(p, 0).alias("flag"), mac(p, 1).alias("device"), le16(p, 7).alias("category"), le16(p, 9).alias("state"), u8(p, 11).alias("config")))


def finding(p: Column) -> Column:
    """Struct (battery, key_length) of a finding message (types 18 and 22)."""
    return F.when(F.length(p) >= 1, F.struct(F.shiftright(u8(p, 0), 6).alias("battery"), (F.length(p) - 1).alias("key_length")))


def handoff_seq(blob: Column) -> Column:
    """Sequence number of the first handoff message of at least three bytes; null without one."""
    return F.get(F.transform(F.filter(messages(blob), lambda m: (m["type"] == 12) & (m["length"] >= 3)), lambda m: be16(m["payload"], 1)), F.lit(0))


def classify(entries: Column) -> Column:
    """Struct (device_class, model) from ingest messages, the most telling type first; of several messages of a type the last counts.

    The nearby message's action is its low four bits here: 13 is a watch, 15 a mac.
    """
    has = lambda code: F.exists(entries, lambda m: m["type"] == code)
    last = lambda code: F.try_element_at(F.filter(entries, lambda m: m["type"] == code), F.lit(-1))["payload"]
    out = lambda cls, model: F.struct(F.lit(cls).alias("device_class"), model.cast("string").alias("model"))
    none = F.lit(None)
    code = be16(last(7), 1)
    model = F.when(F.length(last(7)) >= 3, lookup(INGEST_MODELS, code, F.concat(F.lit("AirPods (0x"), F.lpad(F.lower(F.hex(code)), 4, "0"), F.lit(")"))))
    action = u8(last(16), 0).bitwiseAND(15)
    return (
        F.when(has(7), out("airpods", model))
        .when(has(22), out("airtag", F.lit("AirTag")))
        .when(has(17) | (action == 13), out("apple_watch", F.lit("Apple Watch")))
        .when(action == 15, out("mac", none))
        .when(has(18) | has(16), out("apple_device", none))
        .when(has(9) | has(10), out("apple_airplay", none))
        .when(has(6), out("homekit", none))
        .when(has(2), out("ibeacon", none))
    )
