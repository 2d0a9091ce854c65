"""Capture files as tables and streams: records of pcap and pcapng files, one task per file."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from io import BytesIO
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "ts double, dlt int, data binary, source string"
#: Magic numbers by byte order and time unit, and block types of the newer format. Fixed values of the formats.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
SECTION, INTERFACE, PACKET, SIMPLE, RESOLUTION = b"\x0a\x0d\x0d\x0a", 1, 6, 3, 9
ORDERS = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
LONGEST = 65_535
Record = tuple[float, int, bytes]


def _classic(f: BinaryIO, order: str, unit: float, dlt: int) -> Iterator[Record]:
    """Records after the file's header; stops at a record of no length, of over 65535 bytes or cut off."""
    while len(r := f.read(16)) == 16:
        seconds, fraction, size, _ = struct.unpack(order + "IIII", r)
        if not 0 < size <= LONGEST:
            return
        data = f.read(size)
        if len(data) < size:
            return
        yield seconds + fraction / unit, dlt, data


def _resolution(options: bytes, order: str) -> float:
    """Ticks a second of an interface; a millionth without the option."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at : at + 4])
        if code == RESOLUTION and size >= 1:
            v = options[at + 4]
            return float(2 ** (v & 127) if v & 128 else 10**v)
        at += 4 + (size + 3) // 4 * 4
        if code == 0:
            break
    return 1e6


def _blocks(f: BinaryIO) -> Iterator[Record]:
    """Packets of a pcapng file, by the interfaces of their section; a packet block without time is at 0. Stops where a block is cut off or of no sense."""
    order, interfaces, kind = "<", [], SECTION
    while True:
        if kind == SECTION:
            head = f.read(8)
            if len(head) < 8 or head[4:] not in ORDERS:
                return
            order, interfaces = ORDERS[head[4:]], []
            size, known = struct.unpack(order + "I", head[:4])[0], 12
        else:
            head = f.read(4)
            if len(head) < 4:
                return
            size, known = struct.unpack(order + "I", head)[0], 8
        if size < known + 4 or size % 4:
            return
        body = f.read(size - known)
        if len(body) < size - known:
            return
        if kind != SECTION:
            code, body = struct.unpack(order + "I", kind)[0], body[:-4]
            if code == INTERFACE and len(body) >= 8:
                interfaces.append((struct.unpack(order + "H", body[:2])[0], _resolution(body[8:], order)))
            elif code == PACKET and len(body) >= 20:
                number, high, low, captured, _ = struct.unpack(order + "IIIII", body[:20])
                if number < len(interfaces) and 0 < captured <= min(LONGEST, len(body) - 20):
                    dlt, unit = interfaces[number]
                    yield ((high << 32) + low) / unit, dlt, body[20 : 20 + captured]
            elif code == SIMPLE and len(body) > 4 and interfaces:
                yield 0.0, interfaces[0][0], body[4 : 4 + min(len(body) - 4, struct.unpack(order + "I", body[:4])[0])]
        kind = f.read(4)
        if len(kind) < 4:
            return


def parsed(f: BinaryIO, name: str, strict: bool = True) -> Iterator[Record]:
    """Records of one open file, read as a stream, of either format; a file of neither is an error, or (not ``strict``) has none. An empty file has none."""
    first = f.read(4)
    if first == SECTION:
        yield from _blocks(f)
    elif first in MAGIC:
        rest = f.read(20)
        if len(rest) == 20:
            order, unit = MAGIC[first]
            yield from _classic(f, order, unit, struct.unpack(order + "I", rest[16:])[0])
    elif first and strict:
        raise ValueError(f"{name} is no capture file: it begins with {first.hex()}")


def read(spark: SparkSession, path: str, pattern: str = "*.pcap*", strict: bool = True) -> DataFrame:
    """Records (``ts, dlt, data, source``) of all captures below a path of any file system Spark knows, one row of work per file (each up to 2 GB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            ts, dlt, data, source = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ts, pa.float64()), pa.array(dlt, pa.int32()), pa.array(data, pa.binary()), pa.array(source, pa.string())], names=["ts", "dlt", "data", "source"])

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                held = []
                for ts, dlt, data in parsed(BytesIO(content.as_buffer()), name, strict):
                    held.append((ts, dlt, data, Path(name).stem))
                    if len(held) >= 10_000:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(path: str) -> list[Path]:
    root = Path(path)
    return [root] if root.is_file() else sorted(p for p in root.rglob("*.pcap*") if p.is_file())


class _Reader(DataSourceReader):
    def __init__(self, path: str, strict: bool):
        self.path, self.strict = path, strict

    def partitions(self) -> list[InputPartition]:
        return [_Part(str(p)) for p in _files(self.path)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for record in parsed(f, partition.path, self.strict):
                yield (*record, Path(partition.path).stem)


class _Follower(SimpleDataSourceStreamReader):
    """Records as live captures append them. The offset holds the place up to which each file was read; a record that isn't whole yet waits for the next batch."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def _from(self, name: str, start: int, stop: int | None) -> tuple[list[tuple], int]:
        with open(name, "rb") as f:
            head = f.read(24)
            if len(head) < 24 or head[:4] not in MAGIC:
                return [], start
            order, unit = MAGIC[head[:4]]
            out, at = [], max(start, 24)
            f.seek(at)
            for record in _classic(f, order, unit, struct.unpack(order + "I", head[20:24])[0]):
                if stop is not None and at >= stop:
                    break
                at += 16 + len(record[2])
                out.append((*record, Path(name).stem))
        return out, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for p in _files(self.path):
            found, end[str(p)] = self._from(str(p), start.get(str(p), 0), None)
            rows += found
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for name, stop in end.items():
            yield from self._from(name, start.get(name, 0), stop)[0]


class CaptureSource(DataSource):
    """``spark.read.format("capture").load(folder)``: one partition per file of a folder all executors see; other files are passed over, or with the option
    ``strict`` an error. ``spark.readStream`` follows classic captures as they grow (on the driver: one receiver's captures)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("strict", "false").lower() == "true")

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Follower(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)
