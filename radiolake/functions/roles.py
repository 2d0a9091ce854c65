"""What receivers do: checks of assignments, default assignments, short names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.radio import PRIMARY


def problems(role: Column, channels: Column, address: Column, key_hex: Column) -> Column:
    """What is wrong with an assignment, as an array of texts: pinned to no or to other than primary channels, to one twice, a target or key of the wrong form."""
    pinned = role == "pin"
    checks = [
        (pinned & (F.coalesce(F.size(channels), F.lit(0)) < 1), "no channel"),
        (pinned & (F.size(F.array_except(channels, F.array(*map(F.lit, PRIMARY)))) > 0), "channel isn't primary"),
        (pinned & (F.size(F.array_distinct(channels)) < F.size(channels)), "channel given twice"),
        ((role == "follow") & ~F.coalesce(address.rlike("^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"), F.lit(False)), "address of the wrong form"),
        (key_hex.isNotNull() & ~key_hex.rlike("^[0-9A-Fa-f]{32}$"), "key of the wrong form"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in checks]), lambda x: x.isNotNull())


def masked_key(key_hex: Column) -> Column:
    """A key with only its last four digits readable."""
    return F.concat(F.lit("…"), F.right(key_hex, F.lit(4)))


def defaults(receivers: DataFrame, by: str, listens_only: Column, order: str) -> DataFrame:
    """``receivers`` with ``role`` per host ``by``: those that only listen come first to be pinned to 37, 38 and 39; a lone one scans, as does the second of two; the rest idle."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(listens_only), order)) - 1
    count = F.count(F.lit(1)).over(Window.partitionBy(by))
    placed = receivers.withColumn("_n", n).withColumn("_c", count)
    role = F.when((F.col("_c") == 1) | ((F.col("_c") == 2) & (F.col("_n") == 1)), "scan").when(F.col("_n") < 3, F.concat(F.lit("pin"), (F.col("_n") + 37).cast("string"))).otherwise("idle")
    return placed.withColumn("role", role).drop("_n", "_c")


def short_name(serial: Column, kind: Column, number: Column) -> Column:
    """A name for a receiver without one: its kind with the last four of its serial, or its number."""
    return F.concat(F.coalesce(kind, F.lit("receiver")), F.lit("-"), F.coalesce(F.nullif(F.right(serial, F.lit(4)), F.lit("")), number.cast("string")))
