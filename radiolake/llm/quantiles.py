"""Percentiles of very large numeric columns by deterministic buffer collapsing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.runtime import materialize

#: Values of a buffer, full buffers a sketch may hold, and sketches merged in one step of the tree.
SIZE, BUFFERS, FAN_IN = 1024, 16, 32


class Sketch:
    """Equal-size sorted buffers with weights, and one short buffer of weight 1.

    Too many full buffers are collapsed: those of least weight become one, of the elements at evenly spaced positions of their
    weighted merge. A collapse to weight W moves no rank by more than W / 2, so ``error``, the sum over all collapses, bounds the
    rank error of any answer. Merging collapses buffers of like weight, as a tree: of n values the bound is about
    n / (2 SIZE) for each level.
    """

    __slots__ = ("error", "full", "rest")

    def __init__(self) -> None:
        self.error, self.full, self.rest = 0.0, [], []

    def add(self, values: np.ndarray) -> None:
        """Values of weight 1."""
        self.rest.append(values)
        if sum(map(len, self.rest)) >= SIZE:
            v = np.concatenate(self.rest)
            whole = len(v) // SIZE * SIZE
            self.full += [(1, b) for b in np.sort(v[:whole].reshape(-1, SIZE), axis=1)]
            self.rest = [v[whole:]]
            self.shrink()

    def shrink(self) -> None:
        while len(self.full) > BUFFERS:
            self.full.sort(key=lambda b: b[0])
            least = self.full[0][0]
            n = max(2, sum(w <= 2 * least for w, _ in self.full))
            weight = sum(w for w, _ in self.full[:n])
            v = np.concatenate([b for _, b in self.full[:n]])
            order = np.argsort(v, kind="stable")
            upto = np.repeat([w for w, _ in self.full[:n]], SIZE)[order].cumsum()
            at = np.arange(SIZE, dtype=np.int64) * weight + (weight + 1) // 2
            self.full[:n] = [(weight, v[order][np.searchsorted(upto, at)])]
            self.error += weight / 2

    def merge(self, weight: int, values: np.ndarray) -> None:
        if weight == 1 and len(values) < SIZE:
            self.add(values)
        else:
            self.full.append((weight, values))

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        yield from self.full
        rest = np.concatenate(self.rest) if self.rest else np.empty(0)
        if len(rest):
            yield 1, np.sort(rest)


def _emit(sketches: dict, keys: list[pa.Array], part: int, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows (keys, part, weight, values, error) of sketches by the index of their keys; the error stands on a sketch's first row."""
    at, weights, values, errors = [], [], [], []

    def batch() -> pa.RecordBatch:
        offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
        take = pa.array(at, pa.int64())
        cols = [k.take(take) for k in keys]
        return pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(at), pa.int64()), pa.array(weights, pa.int64()), lists, pa.array(errors, pa.float64())], names=[*[f"k{i}" for i in range(len(keys))], "part", "weight", "vals", "error"])

    for i, s in sketches.items():
        first = True
        for w, v in s.rows():
            at.append(i), weights.append(w), values.append(v), errors.append(s.error if first else 0.0)
            first = False
            if len(at) >= size:
                yield batch()
                at, weights, values, errors = [], [], [], []
    if at:
        yield batch()


def _codes(columns: list[pa.ChunkedArray | pa.Array], known: dict[tuple, int], lists: list[list]) -> np.ndarray:
    """The index of each row's key tuple; new tuples are appended to ``known`` and ``lists``."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    dictionaries = []
    for c in columns:
        d = pc.dictionary_encode(c, null_encoding="encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
        dictionaries.append(d)
    uniq, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    tuples = zip(*[d.dictionary.take(d.indices.take(pa.array(first))).to_pylist() for d in dictionaries])
    index = np.empty(len(uniq), dtype=np.int64)
    for j, t in enumerate(tuples):
        i = known.get(t)
        if i is None:
            i = known[t] = len(known)
            for held, x in zip(lists, t):
                held.append(x)
        index[j] = i
    return index[inverse]


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)) + ", part long, weight long, vals array<double>, error double"


def sketch(rows: DataFrame, keys: list[str], value: str, rows_at_once: int = 200_000) -> DataFrame:
    """One sketch per key and partition, without a shuffle: ``keys, part, weight, vals, error``, a row per buffer.

    Defined results: null and NaN values are left out; a null in a key is a key of its own; repeated rows count as stored; no rows, no
    sketches. Sketches of several calls (days, partitions) can be united and combined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        lists: list[list] = [[] for _ in keys]
        sketches: dict[int, Sketch] = {}
        held: list[pa.RecordBatch] = []

        def take() -> None:
            table = pa.Table.from_batches(held)
            held.clear()
            v = table.column(len(keys)).to_numpy()
            code = _codes([table.column(i) for i in range(len(keys))], known, lists)
            ok = ~np.isnan(v)
            v, code = v[ok], code[ok]
            order = np.argsort(code, kind="stable")
            v, code = v[order], code[order]
            cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else []
            for a, b in zip(cuts, [*cuts[1:], len(code)]):
                sketches.setdefault(int(code[a]), Sketch()).add(v[a:b])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= rows_at_once:
                take()
        if held:
            kinds = [held[0].column(i).type for i in range(len(keys))]
            take()
        elif known:
            kinds = [b.column(i).type for i in range(len(keys))]
        if known:
            yield from _emit(sketches, [pa.array(x, t) for x, t in zip(lists, kinds)], TaskContext.get().partitionId())

    wanted = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("v")).filter("v is not null")
    return wanted.mapInArrow(run, _schema(rows, keys)).withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def combine(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches combined to one per key (of ``keys``, possibly fewer than before), by a tree of merges of at most ``FAN_IN`` at a time.

    The parts are counted first; a key that comes from many partitions is merged in several steps, so no task reads more
    than ``FAN_IN`` sketches of one key at once, however hot the key.
    """
    have = materialize(sketches.select(*keys, "part", "weight", "vals", "error"), "sketches")
    parts = (have.agg(F.max("part").alias("m")).first()["m"] or 0) + 1
    names = [f"k{i}" for i in range(len(keys))]
    have = have.withColumnsRenamed(dict(zip(keys, names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stream is sorted by key and part, so a sketch is done when the key or part changes."""
        now, s = None, Sketch()
        done: list[tuple[tuple, int, Sketch]] = []
        kinds: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            by_part: dict[int, list] = {}
            for key, part, x in done:
                by_part.setdefault(part, []).append((key, x))
            done.clear()
            for part, items in by_part.items():
                yield from _emit({i: x for i, (_, x) in enumerate(items)}, [pa.array([k[j] for k, _ in items], kinds[j]) for j in range(len(names))], part)

        for b in batches:
            kinds = [b.column(i).type for i in range(len(names))]
            ids = list(zip(*[b.column(i).to_pylist() for i in range(len(names) + 1)]))
            weights, errors = b.column(len(names) + 1).to_pylist(), b.column(len(names) + 3).to_pylist()
            lists = b.column(len(names) + 2)
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, at in enumerate(ids):
                if at != now:
                    if now is not None:
                        done.append((now[:-1], now[-1], s))
                        if len(done) >= 2000:
                            yield from flush()
                    now, s = at, Sketch()
                s.merge(weights[i], flat[offsets[i] : offsets[i + 1]])
                s.error += errors[i]
                s.shrink()
        if now is not None:
            done.append((now[:-1], now[-1], s))
        yield from flush()

    while True:
        have = have.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        kinds = ", ".join(f"{n} {have.schema[n].dataType.simpleString()}" for n in names)
        have = have.repartition(*names, "part").sortWithinPartitions(*names, "part", "weight").mapInArrow(run, f"{kinds}, part long, weight long, vals array<double>, error double")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return have.withColumnsRenamed(dict(zip(names, keys)))


def estimate(combined: DataFrame, keys: list[str], fractions: dict[str, float]) -> DataFrame:
    """``keys, n, rank_error, <name of each fraction>`` from combined sketches.

    The estimate for q is the value at rank ceil(q n); its true rank is off by at most ``rank_error``, which is 0 (and the result exact)
    for keys that never filled more than the buffers.
    """
    held = combined.groupBy(*keys).agg(F.sum("error").alias("rank_error"), F.collect_list(F.struct("weight", "vals")).alias("buffers"))
    names = list(fractions)
    kinds = ", ".join(f"`{k}` {combined.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, out = [], [[] for _ in names]
            for buffers in b.column(len(keys) + 1).to_pylist():
                v = np.concatenate([x["vals"] for x in buffers])
                w = np.repeat([x["weight"] for x in buffers], [len(x["vals"]) for x in buffers])
                order = np.argsort(v, kind="stable")
                upto = w[order].cumsum()
                ns.append(int(upto[-1]))
                for o, q in zip(out, fractions.values()):
                    o.append(float(v[order][np.searchsorted(upto, max(1, np.ceil(q * upto[-1] - 1e-9)))]))
            cols = [b.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ns, pa.int64()), b.column(len(keys)), *[pa.array(o, pa.float64()) for o in out]], names=[*keys, "n", "rank_error", *names])

    return held.mapInArrow(run, f"{kinds}, n long, rank_error double, " + ", ".join(f"{n} double" for n in names))
