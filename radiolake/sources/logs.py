"""Capture logs as tables and streams of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions.text import log_line

#: Bodies that are always told as they stand. Fixed value.
VERBATIM = r"\bSTALL\b|\bcapture (started|stopped)\b|\bdongle short_id=|\brole short_id="


def lines(raw: DataFrame, source: Column) -> DataFrame:
    """``source, ts, level, body, verbatim`` of text rows (``value``); blank lines are left out, a line of another form has no time."""
    return raw.select(source.alias("source"), log_line(F.col("value")).alias("l")).filter("l is not null").select("source", "l.*").withColumn("verbatim", F.col("body").rlike(VERBATIM))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files of a folder; a file's name is its source."""
    return lines(spark.read.text(path), F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))


def follow(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The same as a stream: files that are rotated into the folder are read once, in order of their times."""
    return lines(spark.readStream.options(**options).text(folder), F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
