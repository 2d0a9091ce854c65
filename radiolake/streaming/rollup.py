"""Streams into tables: every micro-batch is aggregated on its own and written under its number, readers combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from radiolake.operators.observe import observations


def observe_stream(packets: DataFrame, path: str, checkpoint: str, keys: list[str], is_advertising: Column, **trigger) -> StreamingQuery:
    """Observations of a stream. A batch that is run again overwrites its own files, so each packet counts once."""

    def write(batch: DataFrame, number: int) -> None:
        observations(batch, keys, is_advertising=is_advertising).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return packets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def observed(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The batches of :func:`observe_stream` as one rollup."""
    sums = ["packet_count", "adv_count", "data_count", "rssi_sum", "rssi_samples"]
    return spark.read.parquet(path).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.min("rssi_min").alias("rssi_min"), F.max("rssi_max").alias("rssi_max"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def rolling_quality(packets: DataFrame, ts: str, by: str, late: str = "10 seconds", width: str = "5 seconds", step: str = "250 milliseconds") -> DataFrame:
    """Mean level and good and bad counts per key in sliding windows of a stream; later packets than ``late`` are left out."""
    ok = F.col("crc_ok")
    return packets.withWatermark(ts, late).groupBy(F.window(ts, width, step), by).agg(F.avg(F.when(ok, F.col("rssi"))).alias("rssi"), F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


def channel_activity(packets: DataFrame, ts: str, late: str = "5 seconds", width: str = "1500 milliseconds", step: str = "50 milliseconds") -> DataFrame:
    return packets.withWatermark(ts, late).groupBy(F.window(ts, width, step), "channel").agg(F.count(F.lit(1)).alias("n"))


def sessions(packets: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions of a stream."""
    return packets.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
