"""Log lines, versions, dissector values and other texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Form of a capture log's line. Fixed value.
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(?:(ERROR|WARNING|INFO|VERBOSE|DEBUG|SUMMARY)\s+)?(.*)$"
BASE_UUID = "-0000-1000-8000-00805f9b34fb"
#: Masks of variable parts, most specific first.
MASKS = [
    (r"\b(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}\b", "<mac>"), (r"\b0[xX][0-9a-fA-F]+\b", "<hex>"), (r"\b[0-9a-fA-F]{8,}\b", "<hex>"), (r"'[^']*'", "<text>"), (r"\d+(?:\.\d+)?", "<num>"),
]
BROKEN_VERSION = [4, 1, 1]


def log_line(raw: Column, fallback: Column | None = None) -> Column:
    """Struct (ts, level, body) of a capture log's line; null for a blank one. A line of another form is all body, at the fallback time."""
    line = F.regexp_replace(raw, "[\r\n]+$", "")
    fits = line.rlike(LINE)
    when = F.when(fits, F.regexp_extract(line, LINE, 1)).try_cast("timestamp")
    ts = F.coalesce(F.when(fits, F.unix_micros(when) / 1e6), F.lit(None).cast("double") if fallback is None else fallback)
    out = F.struct(ts.alias("ts"), F.when(fits, F.nullif(F.regexp_extract(line, LINE, 2), F.lit(""))).alias("level"), F.when(fits, F.regexp_extract(line, LINE, 3)).otherwise(line).alias("body"))
    return F.when(raw.rlike("\\S"), out)


def masked(body: Column) -> Column:
    """A log body with its variable parts masked: the template by pattern."""
    for pattern, name in MASKS:
        body = F.regexp_replace(body, pattern, name)
    return body


def summary_line(ts: Column, count: Column, level: Column, template: Column, average: Column, jitter: Column) -> Column:
    """Line of a periodic summary; the interval is told only where there is one."""
    every = F.when(average > 0, F.format_string(" (every %.2fs ±%.2f)", average, F.coalesce(jitter, F.lit(0.0)))).otherwise("")
    return F.concat(ts.cast("string"), F.lit("  SUMMARY  [×"), count.cast("string"), F.lit("]  "), F.coalesce(F.concat(level, F.lit(" ")), F.lit("")), template, every)


def dissected_int(v: Column) -> Column:
    """Whole number of a dissector's text, decimal or 0x hex; null for anything else."""
    s = F.trim(v)
    return F.when(s.rlike("^0[xX][0-9A-Fa-f]+$"), F.conv(F.substring(s, 3, 16), 16, 10).try_cast("bigint")).otherwise(s.try_cast("bigint"))


def version(text: Column) -> Column:
    """``4.1.1`` as an array of numbers; null if it isn't one."""
    return F.when(text.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(text, "\\."), lambda p: p.cast("int")))


def coded_phy_status(versions: Column) -> Column:
    """``blocked`` if any firmware is the version known to be broken, ``warning`` if any is newer, else null; unknown versions don't count."""
    broken = F.array(*map(F.lit, BROKEN_VERSION))
    return F.when(F.exists(versions, lambda v: version(v) == broken), "blocked").when(F.exists(versions, lambda v: version(v) > broken), "warning")


def uuid128(short: Column) -> Column:
    return F.format_string(f"%08x{BASE_UUID}", short)


def printable(value: Column) -> Column:
    """A value's text if it is UTF-8 of printable characters, else null."""
    text = F.try_validate_utf8(value.cast("string"))
    return F.when(text.rlike(r"^[^\p{Cc}\p{Cf}\p{Co}\p{Cn}]+$"), text)


def value_hash(value: Column) -> Column:
    return F.sha1(value)


def short_source(source: Column, most: int = 12) -> Column:
    """A capture source's name without its path, at most so many characters from its end."""
    name = F.regexp_replace(source, "^.*[/.]", "")
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.lit("…"), F.substring(name, -most + 1, most - 1)))


def can_transmit(product: Column, display: Column) -> Column:
    """A receiver whose names say ``sniffer`` can only listen."""
    return ~F.contains(F.lower(F.concat_ws(" ", product, display)), F.lit("sniffer"))


def slip_frame(payload: Column) -> Column:
    """Bytes framed for the serial line: AB before, BC after, and both and CD inside written as CD with AC, BD or CE."""
    pairs = F.regexp_extract_all(F.hex(payload), F.lit("(..)"), F.lit(1))
    escaped = F.transform(pairs, lambda p: F.when(p == "AB", "CDAC").when(p == "BC", "CDBD").when(p == "CD", "CDCE").otherwise(p))
    return F.unhex(F.concat(F.lit("AB"), F.array_join(escaped, ""), F.lit("BC")))


def slip_payload(frame: Column) -> Column:
    """The bytes of a frame; null where it isn't one."""
    h = F.hex(frame)
    inner = F.regexp_extract_all(F.regexp_extract(h, "^AB((?:..)*)BC$", 1), F.lit("(..)"), F.lit(1))
    state = F.struct(F.lit(False).alias("esc"), F.lit("").alias("out"))
    step = lambda s, p: F.when(p == "CD", F.struct(F.lit(True).alias("esc"), s["out"].alias("out"))).otherwise(
        F.struct(F.lit(False).alias("esc"), F.concat(s["out"], F.when(s["esc"], F.when(p == "AC", "AB").when(p == "BD", "BC").when(p == "CE", "CD").otherwise(p)).otherwise(p)).alias("out"))
    )
    return F.when(h.rlike("^AB(..)*BC$"), F.unhex(F.aggregate(inner, state, step, lambda s: s["out"])))
