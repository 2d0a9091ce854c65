"""Addresses, keys, classes and labels of devices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from radiolake.functions.frames import lookup

#: Classes by appearance category, input devices by sub-category, how specific a class is (others 3), ranks of key kinds.
APPEARANCE = {
    0x001: "phone", 0x002: "computer", 0x003: "watch", 0x004: "clock", 0x005: "display", 0x006: "remote_control", 0x007: "eyewear", 0x008: "tag", 0x009: "keyring",
    0x00A: "media_player", 0x00B: "barcode_scanner", 0x00C: "thermometer", 0x00D: "heart_rate_sensor", 0x00E: "blood_pressure_monitor", 0x00F: "hid",
    0x010: "glucose_meter", 0x011: "running_walking_sensor", 0x012: "cycling_sensor", 0x014: "pulse_oximeter", 0x015: "weight_scale",
    0x016: "personal_mobility_device", 0x017: "continuous_glucose_monitor", 0x018: "insulin_pump", 0x019: "medication_delivery", 0x029: "hearing_aid", 0x031: "fitness_tracker",
}
INPUT_DEVICES = {0x01: "hid_keyboard", 0x02: "hid_mouse", 0x03: "hid_joystick", 0x04: "hid_gamepad"}
PRECEDENCE = {
    "unknown": 0, "apple_device": 1, "apple_airplay": 2, "homekit": 2, "ibeacon": 2, "phone": 3, "computer": 3, "watch": 3,
    "airpods": 5, "airtag": 5, "apple_watch": 5, "iphone": 5, "ipad": 5, "mac": 5, "hearing_aid": 5,
}
KIND_RANK = {"public_mac": 0, "random_static_mac": 1, "irk_identity": 1, "rs": 1, "unresolved_rpa": 2, "nrpa": 3, "unknown": 4}
STABLE_KINDS = ["public_mac", "random_static_mac", "irk_identity"]
SPECIFIC_CLASSES = ["airtag", "airpods", "apple_watch", "hearing_aid", "auracast_source", "phone", "mac"]
KEY_PREFIXES = {"public": "pub:", "random_static": "rs:", "rpa": "rpa:", "nrpa": "nrpa:"}
KINDS = {"public": "public_mac", "random_static": "random_static_mac", "rpa": "unresolved_rpa", "nrpa": "nrpa"}
CLASS_LABELS = {"hid": "HID (generic)", "hid_keyboard": "HID keyboard", "hid_mouse": "HID mouse", "hid_joystick": "HID joystick", "hid_gamepad": "HID gamepad"}


def address_class(address: Column, is_random: Column) -> Column:
    """public, or by the top two bits of a random address's first byte random_static, rpa, nrpa; unknown where they say nothing."""
    top = F.shiftright(F.conv(F.when(address.rlike("^[0-9A-Fa-f]{2}(:|$)"), F.substring(address, 1, 2)), 16, 10).cast("int"), 6)
    return F.when(~is_random, "public").when(top == 3, "random_static").when(top == 1, "rpa").when(top == 0, "nrpa").otherwise("unknown")


def device_key(address: Column, address_type: Column) -> Column:
    """Struct (stable_key, kind) under which an address is first entered."""
    return F.struct(F.concat(lookup(KEY_PREFIXES, address_type, F.lit("anon:")), F.lower(address)).alias("stable_key"), lookup(KINDS, address_type, F.lit("unknown")).alias("kind"))


def appearance_class(value: Column) -> Column:
    category = F.shiftright(value, 6).bitwiseAND(0x3FF)
    return F.when(category == 0x00F, lookup(INPUT_DEVICES, value.bitwiseAND(0x3F), F.lit("hid"))).otherwise(lookup(APPEARANCE, category))


def precedence(cls: Column) -> Column:
    return F.when(cls.isNull(), 0).otherwise(lookup(PRECEDENCE, cls, F.lit(3)))


def class_label(cls: Column) -> Column:
    return lookup(CLASS_LABELS, cls, F.replace(cls, F.lit("_"), F.lit(" ")))


def best_label(user_name: Column, gatt_name: Column, local_name: Column, vendor: Column, oui_vendor: Column, model: Column, cls: Column, key: Column, broadcast_name: Column | None = None) -> Column:
    """The most telling name a device has; empty names are missing ones."""
    some = lambda c: F.nullif(c, F.lit(""))
    maker = F.coalesce(some(vendor), some(oui_vendor))
    names = [some(user_name), some(gatt_name), some(local_name), *([some(broadcast_name)] if broadcast_name is not None else [])]
    return F.coalesce(*names, F.concat(maker, F.lit(" "), some(model)), F.concat(maker, F.lit(" "), some(cls)), maker, F.regexp_replace(key, "^(pub|rs|rpa|nrpa|irk|anon):", ""))


def normal_mac(text: Column) -> Column:
    """Twelve upper-case hex digits of an address in any notation; null if it hasn't twelve."""
    digits = F.upper(F.regexp_replace(text, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(digits) == 12, digits)


def resolves(address: Column, key_hex: Column) -> Column:
    """Whether a resolvable private address was made with an identity resolving key: its lower half is the key's AES of its upper half.

    Null where the address or key isn't whole.
    """
    digits, key = normal_mac(address), F.when(key_hex.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(key_hex))
    block = F.unhex(F.concat(F.lit("0" * 26), F.substring(digits, 1, 6)))
    return F.substring(F.hex(F.aes_encrypt(block, key, F.lit("ECB"), F.lit("PKCS"))), 27, 6) == F.substring(digits, 7, 6)


def is_stable(kind: Column, members: Column, user_name: Column, local_name: Column, cls: Column, packets: Column, least_packets: int = 500) -> Column:
    """Whether a device is one in its own right: by its kind of address, a merge, a name, or a telling class seen often enough."""
    told = lambda c: F.coalesce(c != "", F.lit(False))
    return F.coalesce(kind.isin(STABLE_KINDS), F.lit(False)) | F.coalesce(members > 1, F.lit(False)) | told(user_name) | told(local_name) | F.coalesce(cls.isin(SPECIFIC_CLASSES) & (packets >= least_packets), F.lit(False))
