"""Rolling quality, channel activity, stalls and log templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.text import masked
from radiolake.operators.blocked import with_previous


def rolling(packets: DataFrame, by: list[str], us: str, rssi: str, ok: str, seconds: float = 5.0, block_seconds: int = 21_600) -> DataFrame:
    """For each packet the mean level of sound packets and the sound and corrupted counts of its key over the last ``seconds``.

    Rows are also given to the block after theirs where its windows reach back to them, so a window runs per (key, block) and not over a whole key.
    """
    reach, block = int(seconds * 1e6), block_seconds * 1_000_000
    home = F.floor(F.col(us) / block)
    rows = packets.withColumn("blk", F.explode(F.array_distinct(F.array(home, F.floor((F.col(us) + reach) / block))))).withColumn("core", F.col("blk") == home)
    w = Window.partitionBy(*by, "blk").orderBy(us).rangeBetween(-reach, 0)
    good = F.col(ok)
    return rows.withColumns({"recent_rssi": F.avg(F.when(good, F.col(rssi))).over(w), "good": F.count_if(good).over(w), "bad": F.count_if(~good).over(w)}).filter("core").drop("blk", "core")


def channel_activity(packets: DataFrame, ts: str, channel: str, width: str = "1500 milliseconds", step: str = "50 milliseconds") -> DataFrame:
    """Packets per channel in sliding windows: ``channel, window_start, n``."""
    return packets.groupBy(F.window(ts, width, step), channel).agg(F.count(F.lit(1)).alias("n")).select(channel, F.col("window.start").alias("window_start"), "n")


def decayed_peak(counts: DataFrame, by: str, at: str, n: str, hold_s: float = 0.5, fall_per_s: float = 25.0, reach_s: float = 60.0) -> DataFrame:
    """Peak with hold and fall per channel: at each time the greatest of the counts before it, each held for ``hold_s`` and then falling.

    Looked back over at most ``reach_s`` (a count of ``fall_per_s * reach_s`` is gone by then). ``at`` is in seconds.
    """
    past, now = counts.alias("p"), counts.alias("n")
    b = lambda c: F.floor(F.col(c) / reach_s)
    old = past.withColumn("blk", F.explode(F.array(b(f"p.{at}"), b(f"p.{at}") + 1)))
    age = F.col(f"n.{at}") - F.col(f"p.{at}")
    joined = now.withColumn("blk", b(f"n.{at}")).alias("n").join(old.alias("p"), (F.col(f"n.{by}") == F.col(f"p.{by}")) & (F.col("n.blk") == F.col("p.blk")) & (age >= 0) & (age <= reach_s))
    value = F.col(f"p.{n}") - F.greatest(F.lit(0.0), age - hold_s) * fall_per_s
    return joined.groupBy(F.col(f"n.{by}").alias(by), F.col(f"n.{at}").alias(at)).agg(F.max(F.col(f"n.{n}")).alias(n), F.greatest(F.lit(0.0), F.max(value)).alias("peak"))


def stalls(packets: DataFrame, by: str, ts: str, seconds: float = 60.0, block_seconds: int = 86_400) -> DataFrame:
    """Silences of a source longer than ``seconds``: ``by, silent_from, silent_to``."""
    rows = packets.filter(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(by, F.col(ts).alias("ts"))
    seen = with_previous(rows, [by], "ts", block_seconds)
    return seen.filter(F.col("ts") - F.col("previous") > seconds).select(by, F.col("previous").alias("silent_from"), F.col("ts").alias("silent_to"))


def silent_now(packets: DataFrame, by: str, ts: str, now: Column, seconds: float = 60.0) -> DataFrame:
    return packets.filter(F.col(by).isNotNull()).groupBy(by).agg(F.max(ts).alias("last_seen")).filter(now - F.col("last_seen") > seconds)


def templates(lines: DataFrame, by: list[str], body: str, us: str) -> DataFrame:
    """Log templates by masking: count, first and last time, mean and deviation of the positive intervals between lines of a template.

    The interval statistics come from sums per template; only lines of one (template, hour) are sorted together.
    """
    keys = [*by, "template"]
    step = with_previous(lines.withColumn("template", masked(F.col(body))), keys, us, 3_600_000_000)
    gap = (F.col(us) - F.col("previous")) / 1e6
    gap = F.when(gap > 0, gap)
    return step.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.avg(gap).alias("interval_avg"), F.stddev_pop(gap).alias("interval_jitter"))


def interval_jitter(rows: DataFrame, by: str, ts: str, last: int = 256) -> DataFrame:
    """Mean and deviation of the last ``last`` positive intervals of each key."""
    gaps = with_previous(rows, [by], ts, 86_400).withColumn("gap", F.col(ts) - F.col("previous")).filter("gap > 0")
    recent = gaps.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ts)))).filter(F.col("k") <= last)  # limited before the shuffle
    return recent.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("interval_avg"), F.stddev_pop("gap").alias("interval_jitter"))
