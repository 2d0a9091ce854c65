"""Small tables: makers by address prefix and by company id, receivers found by a sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.identity import normal_mac


def prefixes(lines: DataFrame) -> DataFrame:
    """``bits, prefix, vendor`` from tab-separated lines ``prefix[/bits] <tab> vendor`` (``seq``, ``value``); the first of a prefix counts."""
    parts = F.split("value", "\t")
    mask = F.regexp_extract(parts[0], "/(\\d+)$", 1)
    digits = F.upper(F.regexp_replace(F.regexp_replace(parts[0], "/\\d+$", ""), "[^0-9A-Fa-f]", ""))
    bits = F.when(mask != "", mask.try_cast("int")).otherwise(F.length(digits) * 4)
    rows = lines.filter((F.size(parts) >= 2) & (digits != "")).select("seq", bits.alias("bits"), F.substring(digits, F.lit(1), (bits / 4).cast("int")).alias("prefix"), F.trim(parts[1]).alias("vendor"))
    return rows.filter("bits in (24, 28, 36)").groupBy("bits", "prefix").agg(F.min_by("vendor", "seq").alias("vendor"))


def longest_prefix(rows: DataFrame, key: Column, table: DataFrame, lengths: tuple[int, ...] = (9, 7, 6), name: str = "vendor") -> DataFrame:
    """``rows`` with the table's entry (``prefix``, ``vendor``) of the longest matching prefix; one equi-join per length, longest first."""
    out, found = rows, []
    for n in lengths:
        part = table.filter(F.length("prefix") == n).select(F.col("prefix").alias(f"_p{n}"), F.col("vendor").alias(f"_v{n}"))
        out = out.join(part, F.substring(key, 1, n) == F.col(f"_p{n}"), "left")
        found.append(F.col(f"_v{n}"))
    return out.withColumn(name, F.coalesce(*found)).drop(*[f"_{x}{n}" for n in lengths for x in "pv"])


def maker(rows: DataFrame, address: str, table: DataFrame) -> DataFrame:
    """The maker of each address by prefixes of 36, 28 and 24 bits."""
    return longest_prefix(rows, normal_mac(F.col(address)), table, name="oui_vendor")


def without_aliases(ports: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Ports of a sweep: where a host has any named ``usbserial``, its ``SLAB_USBtoUART`` doubles go."""
    named = F.bool_or(F.contains(path, F.lit("usbserial"))).over(Window.partitionBy(host))
    return ports.withColumn("_n", named).filter(~(F.col("_n") & F.contains(path, F.lit("SLAB_USBtoUART")))).drop("_n")


def described(ports: DataFrame, usb: DataFrame) -> DataFrame:
    """Ports (``path, serial, location``) with the USB descriptor that fits best (``usb_id, usb_serial, usb_location, product``).

    The serial number inside the descriptor's (or the other way round) comes before a location that begins alike; of several the smallest id. A descriptor
    is given to one port, the first by path. Sweeps are a handful of rows per host.
    """
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    by_serial = (F.length(text(F.col("serial"))) > 0) & (F.length(text(F.col("usb_serial"))) > 0) & (F.contains(text(F.col("usb_serial")), text(F.col("serial"))) | F.contains(text(F.col("serial")), text(F.col("usb_serial"))))
    by_place = (F.length(text(F.col("location"))) > 0) & F.startswith(text(F.col("usb_location")), text(F.col("location")))

    def matched(free: DataFrame, rows: DataFrame, condition: Column) -> DataFrame:
        first = free.join(rows, condition).groupBy("usb_id", "product").agg(F.min("path").alias("path"))
        return first.groupBy("path").agg(F.min(F.struct("usb_id", "product")).alias("w")).select("path", "w.usb_id", "w.product")

    one = matched(ports, usb, by_serial)
    two = matched(ports.join(one, "path", "left_anti"), usb.join(one, "usb_id", "left_anti"), by_place)
    return ports.join(one.unionByName(two), "path", "left")


def company(rows: DataFrame, table: DataFrame, column: str = "vendor_id") -> DataFrame:
    """``rows`` with the name of each company id (``code``, ``company``); null where the table hasn't it."""
    return rows.join(table.select(F.col("code").alias("_code"), "company"), F.col(column) == F.col("_code"), "left").drop("_code")
