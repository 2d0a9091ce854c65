"""Irregular readings onto a regular grid, by compact-kernel local linear regression."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.runtime import MICROS, floor_div, is_valid_time, micros

#: The kernel reaches one and a half slots to either side of a slot's centre.
REACH = 1.5


def _support(m: Column, j: int) -> list[Column]:
    """What a slot's moments ``m`` add to the weighted sums of the slot that lies ``j`` slots before it."""
    shift = j / REACH
    power = lambda name, p: sum((m[f"{name}{k}"] * (comb(p, k) * shift ** (p - k)) for k in range(p + 1)), F.lit(0.0))
    z, y = [power("z", p) for p in range(5)], [power("y", p) for p in range(4)]
    return [z[0] - z[2], z[1] - z[3], z[2] - z[4], y[0] - y[2], y[1] - y[3], z[0] - 2 * z[2] + z[4]]


def regular_series(readings: DataFrame, key: str, ts: str, value: str, slot_seconds: int = 600, least_support: float = 1.5) -> DataFrame:
    """A regular series per key from irregular readings, every slot between its first and last reading included.

    Returns ``key, slot, n_readings, support, estimate, status``: ``slot`` is the epoch second at which the slot begins (a
    multiple of ``slot_seconds``), ``support`` the effective number of readings behind the estimate ((sum w)^2 / sum w^2),
    ``estimate`` the local linear regression at the slot's centre (null where marked missing), ``status`` one of
    ``observed`` (the slot has a reading), ``filled`` (no reading, but support of at least ``least_support`` from its
    neighbours) and ``missing``.

    Method: weighted local polynomial (linear) regression with the compact kernel 1 - u^2. Its reach of one and a half slots
    around a slot's centre is exactly the slot and its two neighbours, and inside those the weight is a polynomial of time.
    So a slot's readings need no pairing with grid times: nine moments per (key, slot), combined map-side, are the index
    from which the regression of each grid time is put together. Where the readings lie too one-sided for a
    slope, the weighted mean is used. A key has at most one row per slot after the first step, however hot it is.

    Defined results: rows with a null key, a null value or without a valid time are no readings; repeated rows weigh as
    often as stored; a key with one reading has one slot; no rows, no slots. Other columns are not read.
    """
    width = slot_seconds * MICROS
    x, y = F.col("x"), F.col("y")
    slots = (
        readings.filter(is_valid_time(F.col(ts)) & F.col(key).isNotNull() & F.col(value).isNotNull())
        .select(F.col(key).alias("k"), micros(F.col(ts)).alias("us"), F.col(value).cast("double").alias("y"))
        .withColumn("slot", floor_div(F.col("us"), width))
        .withColumn("x", ((F.col("us") - F.col("slot") * width) / width - 0.5) / REACH)
        .groupBy("k", "slot")
        .agg(
            F.count(F.lit(1)).alias("z0"), F.sum(x).alias("z1"), F.sum(x * x).alias("z2"), F.sum(x * x * x).alias("z3"), F.sum(x * x * x * x).alias("z4"),
            F.sum(y).alias("y0"), F.sum(x * y).alias("y1"), F.sum(x * x * y).alias("y2"), F.sum(x * x * x * y).alias("y3"),
        )
        .select("k", "slot", F.struct("z0", "z1", "z2", "z3", "z4", "y0", "y1", "y2", "y3").alias("m"))
    )
    along = Window.partitionBy("k").orderBy("slot")
    near = slots.select("k", "slot", "m", F.lag("slot").over(along).alias("a"), F.lag("m").over(along).alias("am"), F.lead("slot").over(along).alias("b"), F.lead("m").over(along).alias("bm"))
    grid = near.withColumn("g", F.explode(F.sequence(F.col("slot"), F.coalesce(F.col("b") - 1, F.col("slot")))))
    g, own = F.col("g"), F.col("g") == F.col("slot")
    parts = [
        (F.when(own, 0).when(g == F.col("slot") + 1, -1), "m"),
        (F.when(own & (F.col("a") == g - 1), -1), "am"),
        (F.when(F.col("b") == g + 1, 1), "bm"),
    ]
    sums: list[Column] = [F.lit(0.0)] * 6
    for offset, name in parts:
        by = {j: _support(F.col(name), j) for j in (-1, 0, 1)}
        sums = [s + F.coalesce(F.when(offset == -1, by[-1][i]).when(offset == 0, by[0][i]).when(offset == 1, by[1][i]), F.lit(0.0)) for i, s in enumerate(sums)]
    named = grid.select("k", "g", F.when(own, F.col("m.z0")).otherwise(F.lit(0)).cast("long").alias("n_readings"), *[s.alias(f"s{i}") for i, s in enumerate(sums)])
    s0, s1, s2, t0, t1, q = (F.col(f"s{i}") for i in range(6))
    slope = (s0 * s2 - s1 * s1) > 0.1 * s0 * s2
    fitted = named.withColumn("support", F.when(q > 1e-9, s0 * s0 / q).otherwise(0.0)).withColumn(
        "fit", F.when(slope & (s0 > 1e-9), (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1)).when(s0 > 1e-9, t0 / s0)
    )
    status = F.when(F.col("n_readings") > 0, "observed").when(F.col("support") >= least_support, "filled").otherwise("missing")
    return fitted.select(
        F.col("k").alias(key), (F.col("g") * slot_seconds).alias("slot"), "n_readings", "support", F.when(status != "missing", F.col("fit")).alias("estimate"), status.alias("status")
    )
