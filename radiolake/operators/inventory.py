"""What the vocabulary tells: vendors, messages, models, shared payloads."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.binary import le16
from radiolake.functions.continuity import messages, nearby, pairing, type_name
from radiolake.operators import blocks


def vendors(vocabulary: DataFrame) -> DataFrame:
    """Maker ids of manufacturer data with the times heard and the devices: ``company, n, devices``."""
    data = vocabulary.filter("ad_type = 255").withColumn("company", le16(F.col("ad_value"), 0)).filter("company is not null")
    return data.groupBy("company").agg(F.sum("count").alias("n"), F.count_distinct("device_id").alias("devices"))


def told(vocabulary: DataFrame) -> DataFrame:
    """Each message of each device: ``device_id, type, length, payload, count``."""
    return vocabulary.filter("ad_type = 255").select("device_id", "count", F.explode(messages(F.col("ad_value"))).alias("m")).select("device_id", "count", "m.*")


def message_types(vocabulary: DataFrame) -> DataFrame:
    m = told(vocabulary)
    return m.groupBy("type", type_name(F.col("type")).alias("name")).agg(F.sum("count").alias("n"), F.count_distinct("device_id").alias("devices"))


def models(vocabulary: DataFrame) -> DataFrame:
    return told(vocabulary).filter("type = 7").select("device_id", pairing(F.col("payload"))["model"].alias("model")).filter("model is not null").groupBy("model").agg(F.count_distinct("device_id").alias("devices"))


def actions(vocabulary: DataFrame) -> DataFrame:
    return told(vocabulary).filter("type = 16").select("device_id", nearby(F.col("payload"))["name"].alias("action")).filter("action is not null").groupBy("action").agg(F.count_distinct("device_id").alias("devices"))


def shared_payloads(holders: DataFrame, top: int = 20, size: int = blocks.BLOCK) -> DataFrame:
    """Pairs of devices by the number of payloads they share, most first: ``a, b, n``.

    ``holders``: ``device_id, payload``. Payloads are counted for all pairs of a block of devices with another at once, and each pair of blocks gives its first ``top``; those
    are ordered together.
    """
    h = holders.select(F.col("device_id").alias("id"), "payload").filter("id is not null and payload is not null").distinct()
    all_in_one = h.select("id", F.lit(0).alias("device_class")).distinct()
    counted = blocks.scored(h, all_in_one, _shared, top, size).select("a", "b", F.col("score").cast("long").alias("n"))
    return counted.orderBy(F.desc("n"), "a", "b").limit(top)


def _shared(x: blocks.Block, y: blocks.Block) -> tuple[np.ndarray, np.ndarray]:
    n = blocks.common(x, y, "payload")
    return n, n > 0


def holders(vocabulary: DataFrame, types: list[int]) -> DataFrame:
    """``type, device_id, count``: the devices that told messages of the types, and how often."""
    return told(vocabulary).filter(F.col("type").isin(types)).groupBy("type", "device_id").agg(F.sum("count").alias("count"))


def report(vocabulary: DataFrame, top: int = 20) -> DataFrame:
    """The inventory as lines of text, section by section, each with its ``top`` rows of most devices: ``section, place, line``."""
    sections = [("vendors", vendors(vocabulary), F.format_string("0x%04X", "company")), ("messages", message_types(vocabulary), F.col("name")), ("models", models(vocabulary), F.col("model")), ("actions", actions(vocabulary), F.col("action"))]
    parts = []
    for title, df, name in sections:
        first = df.select(F.lit(title).alias("section"), name.alias("name"), "devices").orderBy(F.desc("devices"), "name").limit(top)
        place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("devices"), "name"))  # ``top`` rows
        parts.append(first.select("section", place.alias("place"), F.format_string("%6d  %s", "devices", "name").alias("line")))
    return reduce(DataFrame.unionAll, parts)
