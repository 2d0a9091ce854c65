import pytest
from pyspark.sql import functions as F

from radiolake.streaming import rollup, stateful

T0 = 1_735_689_600


@pytest.fixture
def feed(spark, tmp_path):
    """Writes batches as files, and opens them as a stream of one file per micro-batch."""

    def open_(schema, *batches):
        folder = tmp_path / "in"
        for i, b in enumerate(batches):
            spark.createDataFrame(b, schema).coalesce(1).write.json(str(folder / f"{i:03d}"))
            import os

            for f in (folder / f"{i:03d}").glob("part*"):
                os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(folder))

    return open_


def result(df, tmp_path, mode="append"):
    out = tmp_path / "out"
    df.writeStream.format("parquet").outputMode(mode).option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(str(out)).collect()


def test_rollup(spark, feed, tmp_path):
    stream = feed("d int, rssi int, ts double, pdu int", [(1, -5, 1.0, 0), (1, None, 3.0, 9)], [(1, -7, 2.0, 0), (2, -9, 5.0, None)])
    rollup.observe_stream(stream, str(tmp_path / "obs"), str(tmp_path / "cp"), ["d"], F.col("pdu") < 8).awaitTermination()
    assert len(list((tmp_path / "obs").glob("batch=*"))) == 2
    got = {r["d"]: (r["packet_count"], r["adv_count"], r["rssi_sum"], r["rssi_min"], r["first_seen"], r["last_seen"]) for r in rollup.observed(spark, str(tmp_path / "obs"), ["d"]).collect()}
    assert got == {1: (3, 2, -12, -7, 1.0, 3.0), 2: (1, 1, -9, -9, 5.0, 5.0)}


def test_crc_credit_over_batches(feed, tmp_path):
    stream = feed("source string, channel int, seq long, ts double, device_id long, crc_ok boolean", [("a", 37, 1, 1.0, 5, True), ("a", 37, 2, 1.5, None, False), ("a", 38, 3, 1.5, None, False)], [("a", 37, 4, 2.9, None, False), ("a", 37, 5, 3.1, None, False), ("a", 37, 6, 3.2, 6, True), ("a", 37, 7, 3.3, None, False)])
    assert sorted((r["seq"], r["credited"]) for r in result(stateful.crc_credits(stream), tmp_path) if r["seq"] != 3) == [(2, 5), (4, 5), (5, None), (7, 6)]


def test_templates_over_batches(feed, tmp_path):
    stream = feed("source string, ts double, body string", [("a", 10.0 * i, f"flush {i} rows") for i in range(3)], [("a", 10.0 * i, f"flush {i} rows") for i in range(3, 5)] + [("a", 99.0, "once")])
    got = sorted((r["kind"], r["ts"], r["text"], r["n"], r["interval_avg"]) for r in result(stateful.templates(stream), tmp_path))
    assert [g[:4] for g in got] == [("line", 0.0, "flush 0 rows", 1), ("line", 99.0, "once", 1), ("summary", 20.0, "flush <num> rows", 3), ("summary", 40.0, "flush <num> rows", 5)]
    assert got[3][4] == pytest.approx(10.0)


def test_watchdog_tells_stalls(feed, tmp_path):
    schema = "sniffer string, ts double"
    stream = feed(schema, [("a", T0 + 1.0), ("b", T0 + 1.0)], [("b", T0 + 50.0)], [("b", T0 + 100.0)], [("b", T0 + 400.0)], [("b", T0 + 401.0)])
    out = result(stateful.watchdog(stream.withColumn("at", F.timestamp_seconds("ts"))), tmp_path)
    a = sorted((r["attempt"], r["stuck"]) for r in out if r["sniffer"] == "a")
    assert a and a[0] == (1, False) and all(r["silent_for"] > 60 for r in out)
    assert stateful.stall_steps([(0.0, None), (0.0, 90.0)], 100.0) == [True, False]


def test_windows_of_a_stream(feed, tmp_path):
    stream = feed("ts double, d int, rssi int, crc_ok boolean, channel int", [(T0 + 0.0, 1, -60, True, 37), (T0 + 1.0, 1, -70, False, 37)], [(T0 + 100.0, 1, -60, True, 37)], [(T0 + 200.0, 1, -60, True, 37)]).withColumn("at", F.timestamp_seconds("ts"))
    rows = result(rollup.rolling_quality(stream, "at", "d", width="5 seconds", step="5 seconds"), tmp_path)
    assert [(r["good"], r["bad"], r["rssi"]) for r in rows if r["bad"]] == [(1, 1, -60.0)]


def test_sessions_of_a_stream(feed, tmp_path):
    stream = feed("ts double, d int", [(T0 + 0.0, 1), (T0 + 60.0, 1)], [(T0 + 9000.0, 1)], [(T0 + 90_000.0, 1)]).withColumn("at", F.timestamp_seconds("ts"))
    rows = result(rollup.sessions(stream, "at", "d"), tmp_path)
    assert 2 in [r["n"] for r in rows]
