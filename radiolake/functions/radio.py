"""Channels, meters and recency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIMARY = [37, 38, 39]


def megahertz(channel: Column) -> Column:
    """Centre frequency of an advertising or data channel; null for channels that don't exist."""
    return (
        F.when(channel == 37, 2402).when(channel == 38, 2426).when(channel == 39, 2480).when(channel.between(0, 10), 2404 + 2 * channel).when(channel.between(11, 36), 2428 + 2 * (channel - 11))
    )


def hue(channel: Column) -> Column:
    """Colour angle of a channel: steps of the golden angle, so that neighbours differ."""
    return F.pmod(channel * F.lit(137.50776405003785), F.lit(360.0))


def meter(level: Column) -> Column:
    """Level between -100 and -20 as a fraction; null stays null."""
    return F.when(level.isNotNull(), (F.greatest(F.lit(-100.0), F.least(F.lit(-20.0), level.cast("double"))) + 100) / 80)


def quality(good: Column, bad: Column) -> Column:
    return F.try_divide(good, good + bad)


def opacity(last_seen: Column, now: Column, horizon: float = 86_400.0, fresh_most: float = 60.0, least: float = 0.1) -> Column:
    """1 for what was just heard, falling with the logarithm of its age to ``least`` at the horizon; never heard is ``least``."""
    fresh = min(fresh_most, 0.2 * horizon)
    age = F.greatest(F.lit(0.0), now - last_seen)
    if horizon <= fresh:
        return F.when(last_seen.isNull() | (last_seen <= 0) | (age >= horizon), least).otherwise(1.0)
    done = (F.log10(age) - F.log10(F.lit(fresh))) / (F.log10(F.lit(horizon)) - F.log10(F.lit(fresh)))
    return F.when(last_seen.isNull() | (last_seen <= 0), least).when(age < fresh, 1.0).when(age >= horizon, least).otherwise(1 - (1 - least) * done)


def grid_place(ordinal: Column, columns: int) -> Column:
    """Struct (column, row) of the n-th item of a grid."""
    return F.struct(F.pmod(ordinal, F.lit(columns)).alias("column"), F.floor(ordinal / columns).alias("row"))


def uncovered(pinned: Column) -> Column:
    """Primary channels that no receiver is pinned to."""
    return F.array_except(F.array(*map(F.lit, PRIMARY)), pinned)
