"""Queries of the general problems (1, 2, 3, 6, 7) over the domain tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.operators.activity import activity_sessions
from radiolake.operators.frequency import heavy_keys, profile, value_frequencies
from radiolake.operators.grid import regular_series
from radiolake.operators.intervals import continuous_periods, gaps
from radiolake.operators.spikes import suspicious_readings
from radiolake.runtime import MICROS, TIME_FROM, TIME_TO, floor_div, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
VALID = f"ts >= {TIME_FROM} AND ts < {TIME_TO}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_SESSIONS = f"""
WITH e AS (SELECT device_id, ts FROM packets WHERE {VALID} AND device_id IS NOT NULL),
l AS (SELECT *, lag(ts) OVER (PARTITION BY device_id ORDER BY ts) AS before FROM e),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM l),
g AS (SELECT device_id, no, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY device_id, no)
"""


@query(_SESSIONS + "SELECT device_id, CAST(floor(a) AS BIGINT) AS period_start, CAST(floor(b) AS BIGINT) AS period_end FROM g")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity periods per device."""
    s = activity_sessions(read(spark, sf_dir, "packets"), "device_id", "ts")
    return s.select("device_id", floor_div(F.col("start_us"), MICROS).alias("period_start"), floor_div(F.col("end_us"), MICROS).alias("period_end"))


@query(_SESSIONS + "SELECT device_id, CAST(floor(a) AS BIGINT) AS period_start, CAST(floor(b) AS BIGINT) AS period_end, round(b - a, 3) AS duration_s, CAST(n AS BIGINT) AS n_packets FROM g")
def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity periods with duration and the number of stored packet rows."""
    s = activity_sessions(read(spark, sf_dir, "packets"), "device_id", "ts")
    return s.select(
        "device_id", floor_div(F.col("start_us"), MICROS).alias("period_start"), floor_div(F.col("end_us"), MICROS).alias("period_end"),
        F.round((F.col("end_us") - F.col("start_us")) / MICROS, 3).alias("duration_s"), F.col("n_events").alias("n_packets"),
    )


_SPIKES = f"""
WITH ranged AS (SELECT DISTINCT id FROM packets WHERE rssi > 10 OR rssi < -120),
r AS (SELECT id, sniffer_id, ts, min(rssi) AS rssi FROM packets WHERE rssi IS NOT NULL AND sniffer_id IS NOT NULL AND {VALID} GROUP BY id, sniffer_id, ts),
c AS (SELECT *, CASE WHEN rssi = lag(rssi) OVER w THEN 0 ELSE 1 END AS opens FROM r WINDOW w AS (PARTITION BY sniffer_id ORDER BY ts, id)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY sniffer_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY sniffer_id, run) AS len FROM i),
k AS (SELECT *, median(rssi) OVER (PARTITION BY sniffer_id ORDER BY ts RANGE BETWEEN 21600 PRECEDING AND 21600 FOLLOWING EXCLUDE CURRENT ROW) AS level
      FROM n WHERE len < 12 AND rssi BETWEEN -120 AND 10),
w AS (SELECT id, 0 AS rank FROM ranged UNION ALL SELECT id, 1 FROM n WHERE len >= 12 UNION ALL SELECT id, 2 FROM k WHERE abs(rssi - level) >= 20)
"""


@query(_SPIKES + "SELECT DISTINCT id FROM w")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of packets whose level their sniffer can't have heard."""
    return suspicious_readings(spark, read(spark, sf_dir, "packets")).select("id")


@query(_SPIKES + "SELECT CASE r WHEN 0 THEN 'range' WHEN 1 THEN 'stuck' ELSE 'spike' END AS reason, count(*) AS n FROM (SELECT id, min(rank) AS r FROM w GROUP BY id) GROUP BY r")
def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readings were flagged for each reason."""
    return suspicious_readings(spark, read(spark, sf_dir, "packets")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_PERIODS = """
WITH v AS (SELECT device_id, first_seen AS s, last_seen AS e, count(*) AS n FROM addresses WHERE device_id IS NOT NULL AND last_seen >= first_seen AND NOT isnan(first_seen) AND NOT isnan(last_seen) GROUP BY 1, 2, 3),
m AS (SELECT *, max(e) OVER (PARTITION BY device_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
"""


@query(_PERIODS + "SELECT device_id, CAST(floor(before) AS BIGINT) AS gap_start, CAST(floor(s) AS BIGINT) AS gap_end FROM m WHERE s > before")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the continuous seen periods of each device."""
    g = gaps(continuous_periods(read(spark, sf_dir, "addresses"), "device_id", "first_seen", "last_seen"), "device_id")
    return g.select("device_id", F.floor("gap_start").alias("gap_start"), F.floor("gap_end").alias("gap_end"))


@query(_PERIODS + "SELECT device_id, min(s) AS period_start, max(e) AS period_end, CAST(sum(n) AS BIGINT) AS n_intervals FROM i GROUP BY device_id, island")
def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous seen periods of each device."""
    return continuous_periods(read(spark, sf_dir, "addresses"), "device_id", "first_seen", "last_seen").drop("previous_end")


_HEAVY = "SELECT '{0}' AS key_column, {0} AS key_value FROM packets WHERE {0} IS NOT NULL GROUP BY {0} HAVING count(*) > 0.05 * (SELECT count(*) FROM packets)"


@query(_HEAVY.format("device_id") + " UNION ALL " + _HEAVY.format("session_id"))
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold more than a twentieth of all stored packet rows."""
    return heavy_keys(value_frequencies(read(spark, sf_dir, "packets"), ["device_id", "session_id"], "rssi")).select("key_column", F.col("key").alias("key_value"))


_PROFILE = """
WITH f AS (SELECT {0} AS key, rssi AS value, count(*) AS n FROM packets WHERE {0} IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) OVER (PARTITION BY key ORDER BY value NULLS FIRST) AS upto, sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) OVER (PARTITION BY key) AS total FROM f)
SELECT '{0}' AS key_column, key AS key_value, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS n_values, count(value) AS n_distinct,
  CAST(arg_min(value, row(-n, value)) FILTER (value IS NOT NULL) AS INTEGER) AS mode, min(value) FILTER (upto >= ceil(total * 0.5)) AS p50, min(value) FILTER (upto >= ceil(total * 0.9)) AS p90
FROM c GROUP BY key
"""


@query(_PROFILE.format("device_id") + " UNION ALL " + _PROFILE.format("session_id").replace("WITH f", "SELECT * FROM (WITH f") + ")")
def p6_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts, modes and percentiles of the level per device and per session."""
    return profile(value_frequencies(read(spark, sf_dir, "packets"), ["device_id", "session_id"], "rssi"), {"p50": 0.5, "p90": 0.9}).withColumnRenamed("key", "key_value")


_SLOTS = f"""
WITH r AS (SELECT address_id, CAST(floor(ts / 600) AS BIGINT) AS s, rssi FROM packets WHERE {VALID} AND rssi IS NOT NULL AND address_id IS NOT NULL),
o AS (SELECT address_id, s, count(*) AS n FROM r GROUP BY address_id, s),
x AS (SELECT address_id, min(s) AS a, max(s) AS b FROM o GROUP BY address_id),
g AS (SELECT address_id, unnest(generate_series(a, b)) AS s FROM x)
"""


@query(_SLOTS + "SELECT g.address_id, g.s * 600 AS slot FROM g LEFT JOIN o ON o.address_id = g.address_id AND o.s = g.s WHERE o.n IS NULL")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots without a reading between the first and the last reading of each address."""
    return regular_series(read(spark, sf_dir, "packets"), "address_id", "ts", "rssi").filter("status <> 'observed'").select("address_id", "slot")


_FIT = (
    _SLOTS
    + f""", q AS (SELECT address_id, CAST(floor(ts / 600) AS BIGINT) AS s, ts, CAST(rssi AS DOUBLE) AS y FROM packets WHERE {VALID} AND rssi IS NOT NULL AND address_id IS NOT NULL),
near AS (SELECT address_id, s + 1 AS s, ts, y FROM q UNION ALL SELECT address_id, s, ts, y FROM q UNION ALL SELECT address_id, s - 1, ts, y FROM q),
z AS (SELECT address_id, s, (ts - s * 600 - 300) / 900 AS z, y FROM near),
m AS (SELECT address_id, s, sum(1 - z*z) AS s0, sum((1 - z*z) * z) AS s1, sum((1 - z*z) * z*z) AS s2, sum((1 - z*z) * y) AS t0, sum((1 - z*z) * z * y) AS t1, sum((1 - z*z) * (1 - z*z)) AS q FROM z GROUP BY address_id, s),
f AS (SELECT g.address_id, g.s, coalesce(o.n, 0) AS n, CASE WHEN m.q > 1e-9 THEN s0 * s0 / m.q ELSE 0 END AS support,
  CASE WHEN s0*s2 - s1*s1 > 0.1*s0*s2 AND s0 > 1e-9 THEN (s2*t0 - s1*t1) / (s0*s2 - s1*s1) WHEN s0 > 1e-9 THEN t0 / s0 END AS fit
  FROM g LEFT JOIN o ON o.address_id = g.address_id AND o.s = g.s LEFT JOIN m ON m.address_id = g.address_id AND m.s = g.s),
t AS (SELECT *, CASE WHEN n > 0 THEN 'observed' WHEN support >= 1.5 THEN 'filled' ELSE 'missing' END AS status FROM f)
SELECT address_id, s * 600 AS slot, CAST(n AS BIGINT) AS n_readings, round(CASE WHEN status <> 'missing' THEN fit END, 2) AS estimate, status FROM t
"""
)


@query(_FIT)
def p7_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of each address on a grid of 600 s."""
    s = regular_series(read(spark, sf_dir, "packets"), "address_id", "ts", "rssi")
    return s.select("address_id", "slot", "n_readings", F.round("estimate", 2).alias("estimate"), "status")
