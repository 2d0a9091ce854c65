"""Session helpers: the shared folder, written intermediate tables, valid times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A valid time lies from 2025-01-01 up to but not including 2027-01-01 (epoch seconds).
TIME_FROM, TIME_TO = 1735689600, 1798761600
MICROS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, read from the session's ``spark.checkpoint.dir``.

    Only a session inside one process (``local[...]``, as in tests) may do without: it gets a temporary folder of this machine. On a cluster executors
    couldn't read each other's files there, so a missing setting is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir isn't set: it must name a folder that all executors of {sc.master} share")
    own = tempfile.mkdtemp(prefix="radiolake-")
    sc.setCheckpointDir("file://" + own)
    return "file://" + own


def _path(spark: SparkSession, name: str):
    """A path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the application's own one in the shared folder, which goes when the application ends (or by :func:`discard`)."""
    root = f"{shared_dir(spark)}/radiolake/{spark.sparkContext.applicationId}"
    path, fs = _path(spark, root)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Delete all intermediate tables of the application at once, for sessions that live long; results not yet written can't be read afterwards."""
    path, fs = _path(spark, f"{shared_dir(spark)}/radiolake/{spark.sparkContext.applicationId}")
    fs.delete(path, True)


class Stage:
    """A table written to the shared folder, so that later jobs neither recompute it nor depend on an executor."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = fresh_folder(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that no later plan reads."""
        path, fs = _path(self.spark, self.path)
        fs.delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors. The files go with the application."""
    return Stage(df, label).df


def is_valid_time(ts: Column) -> Column:
    """True for a time in the valid range; null, NaN and broken clocks are false."""
    return F.coalesce((ts >= F.lit(float(TIME_FROM))) & (ts < F.lit(float(TIME_TO))), F.lit(False))


def micros(ts: Column) -> Column:
    """Epoch seconds (DOUBLE) as whole microseconds, the resolution of the data."""
    return F.round(ts * MICROS).cast("long")


def floor_div(a: Column, b: int) -> Column:
    """Whole-number division rounding down, for negative numerators too."""
    return F.floor((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by the keys in as many partitions as the session's setting says, for joins whose result is far larger than their input.

    Partitions are otherwise joined up at run time by the size of the input, which would leave such a join to a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
