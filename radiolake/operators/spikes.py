"""Spikes, stuck values and impossible readings, by a hidden Markov model per source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.runtime import MICROS, Stage, floor_div, is_valid_time, materialize, micros

#: Hard bounds of a reading, how far off the level is a spike, how long a run is stuck, how far the level looks to either side.
HIGH, LOW, OFF, RUN, REACH_S = 10, -120, 20, 12, 6 * 3600
BLOCK, MINUTE, DAY = 2048, 60, 1440
VALUES = HIGH - LOW + 1
REACH_M = REACH_S // MINUTE

#: The states, and the reasons they stand for.
STATES = ("normal", "spike", "stuck", "range")


def _transition() -> np.ndarray:
    return np.array([[0.986, 0.01, 0.002, 0.002], [0.88, 0.10, 0.01, 0.01], [0.04, 0.005, 0.95, 0.005], [0.88, 0.01, 0.01, 0.10]])


@dataclass(frozen=True)
class Model:
    """The hidden Markov model of one source: transitions (rows where from, columns where to), how it starts, and what each state emits.

    A normal reading lies about the source's level with the source's own spread and less than ``OFF`` away; a spike lies ``OFF`` or more away, anywhere;
    a stuck receiver repeats a value for ``RUN`` readings or more, which a working one hardly ever does (``repeats``); a reading out of range is beyond the hard bounds.
    ``never`` is the likelihood of what a state doesn't emit, ``edge`` the least one of a normal reading inside its bounds.
    """

    transition: np.ndarray = field(default_factory=_transition)
    start: np.ndarray = field(default_factory=lambda: np.array([0.95, 0.02, 0.02, 0.01]))
    anywhere: float = 0.01
    repeated: float = 0.98
    repeats: float = 1e-6
    edge: float = 1e-4
    never: float = 1e-12

    def emissions(self, value: np.ndarray, off: np.ndarray, run: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Likelihood of each reading in each state, last axis. off: distance from the level; run: one of at least ``RUN`` equal readings in a
        row; spread: the source's usual deviation."""
        impossible = (value > HIGH) | (value < LOW)
        chance = np.where(run, self.repeats, 1.0)
        bell = np.exp(-0.5 * (off / spread) ** 2) / (2.5066 * spread)
        e = np.empty((*np.shape(value), 4))
        e[..., 0] = np.where(off < OFF, np.maximum(bell, self.edge), self.never) * chance
        e[..., 1] = np.where(off < OFF, self.never, self.anywhere) * chance
        e[..., 2] = np.where(run, self.repeated, self.never)
        e[..., 3] = self.never
        e[impossible] = [self.never, self.never, self.never, 1.0]
        return e

    def forward_backward(self, emission: np.ndarray) -> np.ndarray:
        """State probabilities (time, chain, state) of many chains at once, given their emissions of the same shape."""
        steps = emission.shape[0]
        alpha = np.empty_like(emission)
        a = self.start * emission[0]
        alpha[0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, steps):
            a = (alpha[t - 1] @ self.transition) * emission[t]
            alpha[t] = a / a.sum(axis=1, keepdims=True)
        beta = np.ones_like(emission[0])
        back = self.transition.T
        for t in range(steps - 2, -1, -1):
            beta = (beta * emission[t + 1]) @ back
            beta /= beta.sum(axis=1, keepdims=True)
            alpha[t] *= beta
        return alpha / alpha.sum(axis=2, keepdims=True)


def _blocks(batches: Iterator[pa.RecordBatch], at_once: int = 64) -> Iterator[dict[str, np.ndarray]]:
    """Whole blocks of the sorted stream, some ``at_once`` together, as arrays; nulls are -1."""
    held: list[pa.RecordBatch] = []

    def arrays(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(parts)
        return {c: table.column(c).fill_null(-1).to_numpy() if pa.types.is_integer(table.schema.field(c).type) else table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names}

    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= at_once * BLOCK:
            a = arrays(held)
            last = np.flatnonzero((a["source"] != a["source"][-1]) | (a["blk"] != a["blk"][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield {c: v[:cut] for c, v in a.items()}
                held = pa.Table.from_batches(held).slice(cut).to_batches()
                rows -= cut
    if rows:
        yield arrays(held)


def _bounds(source: np.ndarray, blk: np.ndarray) -> np.ndarray:
    """First index of each block, and the end."""
    edges = np.flatnonzero((source[1:] != source[:-1]) | (blk[1:] != blk[:-1])) + 1
    return np.concatenate([[0], edges, [len(source)]])


def _runs(batches: Iterator[pa.RecordBatch], halo: int, size: int) -> Iterator[pa.RecordBatch]:
    """Marks readings of long enough runs of one value, drops second copies and the halo; ``short``: the halo held too few readings."""
    for a in _blocks(batches):
        new_block = np.r_[True, (a["source"][1:] != a["source"][:-1]) | (a["blk"][1:] != a["blk"][:-1])]
        copy = np.r_[False, (a["us"][1:] == a["us"][:-1]) & (a["id"][1:] == a["id"][:-1])] & ~new_block
        keep = np.flatnonzero(~copy)
        value, opens = a["value"][keep], new_block[keep]
        opens = opens | np.r_[True, value[1:] != value[:-1]]
        run = np.cumsum(opens) - 1
        length = np.bincount(run)[run]
        core = a["core"][keep]
        block = np.cumsum(new_block[keep]) - 1
        # The halo must hold RUN - 1 readings to either side wherever the source goes on beyond it.
        start, rows_block = a["blk"] * size, np.cumsum(new_block) - 1
        lacking = np.zeros(block[-1] + 1, dtype=bool)
        for side in (a["pos"] < start, a["pos"] >= start + size):
            stored = np.bincount(rows_block[side], minlength=len(lacking))
            distinct = np.bincount(block[side[keep]], minlength=len(lacking))
            lacking |= (stored >= halo) & (distinct < RUN - 1)
        at = keep[core]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(a["source"][at], pa.int64()), pa.array(a["minute"][at], pa.int64()), pa.array(a["us"][at], pa.int64()), pa.array(a["id"][at], pa.int64()),
                pa.array(a["value"][at], pa.int32()), pa.array(a["pos"][at], pa.int64()), pa.array(length[core] >= RUN, pa.bool_()), pa.array(lacking[block[core]], pa.bool_()),
            ],
            names=["source", "minute", "us", "id", "value", "pos", "run", "short"],
        )


def _decode(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Forward-backward over each block (with halo): the readings whose most likely state isn't normal, and those whose distance from the level the
    bounds leave open (``doubt``), with what their neighbours say of their state (``c_*``, the probabilities without the reading's own emission)."""
    for a in _blocks(batches):
        marker = ~a["real"].astype(bool)
        at_marker = np.maximum.accumulate(np.where(marker, np.arange(len(marker)), -1))
        edges_all = _bounds(a["source"], a["blk"])
        begin = np.repeat(edges_all[:-1], np.diff(edges_all))
        known = (at_marker >= begin) & (a["minute"][at_marker] == a["minute"])
        real = np.flatnonzero(~marker)
        if not len(real):
            continue
        lo, hi, usual = (a[c][at_marker].astype(float) for c in ("lo", "hi", "spread"))
        value = a["value"].astype(float)
        far = np.where(known, np.maximum(abs(value - lo), abs(value - hi)), 0.0)[real]
        near = np.where(known, np.maximum(0, np.maximum(lo - value, value - hi)), 0.0)[real]
        spread = np.where(known, usual / 10, 6.0)[real]  # carried in tenths
        value, run, core = value[real], a["run"][real].astype(bool), a["core"][real]
        edges = _bounds(a["source"][real], a["blk"][real])
        sizes = np.diff(edges)
        chain, step = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(real)) - np.repeat(edges[:-1], sizes)
        free = ~run & (value <= HIGH) & (value >= LOW)
        doubt = free & (near < OFF) & (far >= OFF)
        own = model.emissions(value, np.where(doubt, (near + far) / 2, np.where(near >= OFF, near, far)), run, spread)
        e = np.ones((sizes.max(), len(sizes), 4))
        e[step, chain] = own
        p = model.forward_backward(e)[step, chain]
        hit = np.flatnonzero(((p.argmax(axis=1) != 0) | doubt) & core)
        at, around = real[hit], p[hit] / own[hit]
        around /= around.sum(axis=1, keepdims=True)
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.array(a[c][at], pa.int64()) for c in ("source", "minute", "us", "id")], pa.array(a["value"][at], pa.int32()), pa.array(doubt[hit], pa.bool_()), pa.array(spread[hit], pa.float64()),
                *[pa.array(p[hit, k], pa.float64()) for k in (1, 2, 3)], *[pa.array(around[:, k], pa.float64()) for k in range(4)],
            ],
            names=["source", "minute", "us", "id", "value", "doubt", "spread", "p_spike", "p_stuck", "p_range", "c_normal", "c_spike", "c_stuck", "c_range"],
        )


def _cumulated(day: int, minute: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts of each value before each minute, for the day and the reach to either side (one minute more)."""
    counts = np.zeros((DAY + 2 * REACH_M + 2, VALUES), dtype=np.int64)
    np.add.at(counts, (minute - (day * DAY - REACH_M) + 1, value - LOW), n)
    return counts.cumsum(axis=0)


def _levels(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bounds of the median of the other readings around any reading of each minute of one day, from counts per minute."""
    source, day = int(pdf["source"].iloc[0]), int(pdf["day"].iloc[0])
    minute, value, n = (pdf[c].to_numpy() for c in ("minute", "value", "n"))
    cum = _cumulated(day, minute, value, n)
    own = np.unique(minute[(minute >= day * DAY) & (minute < (day + 1) * DAY)])
    i = own - (day * DAY - REACH_M)
    inner = (cum[i + REACH_M] - cum[i - REACH_M + 1]).cumsum(axis=1)
    n_in = inner[:, -1]
    u = cum[i + REACH_M + 1][:, :].sum(axis=1) - cum[i - REACH_M].sum(axis=1) - n_in
    low_at, high_at = (n_in - 2 + u) // 2 - u, (n_in - 1 + u) // 2 + 1
    lo = np.where(low_at < 0, LOW, (inner <= np.maximum(low_at, 0)[:, None]).sum(axis=1) + LOW)
    hi = np.where(high_at > n_in - 1, HIGH, (inner <= np.minimum(high_at, n_in - 1)[:, None]).sum(axis=1) + LOW)
    alone = n_in - 1 + u <= 0
    keep = ~alone
    return pd.DataFrame({"source": source, "minute": own[keep], "lo": lo[keep].astype("int32"), "hi": hi[keep].astype("int32")})


def _settle(pdf: pd.DataFrame, model: Model) -> pd.DataFrame:
    """State probabilities of the readings in doubt of one source and day: their emission by the exact median of the other readings, times what the
    neighbours say of them."""
    day = int(pdf["day"].iloc[0])
    kind = pdf["kind"].to_numpy()
    h, c, e = pdf[kind == 0], pdf[kind == 1].sort_values("id", kind="stable"), pdf[kind == 2]
    columns = ["id", "source", "value", "p_spike", "p_stuck", "p_range"]
    if not len(c):
        return pd.DataFrame({n: pd.Series(dtype="float64" if n.startswith("p_") else "int64") for n in columns})
    cum = _cumulated(day, h["minute"].to_numpy(), h["value"].to_numpy(), h["n"].to_numpy())
    ids, x = c["id"].to_numpy(), c["value"].to_numpy()
    i = c["minute"].to_numpy() - (day * DAY - REACH_M)
    off = np.zeros(len(ids))
    edge_at, edge_v, edge_n = np.searchsorted(ids, e["id"].to_numpy()), e["value"].to_numpy() - LOW, e["n"].to_numpy()
    by = np.argsort(edge_at, kind="stable")
    edge_at, edge_v, edge_n = edge_at[by], edge_v[by], edge_n[by]
    for a in range(0, len(ids), 4096):
        s = slice(a, min(a + 4096, len(ids)))
        counts = cum[i[s] + REACH_M] - cum[i[s] - REACH_M + 1]
        f, t = np.searchsorted(edge_at, [s.start, s.stop])
        np.add.at(counts, (edge_at[f:t] - s.start, edge_v[f:t]), edge_n[f:t])
        counts[np.arange(s.stop - s.start), x[s] - LOW] -= 1
        upto = counts.cumsum(axis=1)
        n = upto[:, -1]
        m1 = (upto <= ((n - 1) // 2)[:, None]).sum(axis=1) + LOW
        m2 = (upto <= (n // 2)[:, None]).sum(axis=1) + LOW
        off[s] = np.where(n > 0, abs(x[s] - (m1 + m2) / 2), 0)
    p = model.emissions(x.astype(float), off, np.zeros(len(x), dtype=bool), c["spread"].to_numpy()) * c[["c_normal", "c_spike", "c_stuck", "c_range"]].to_numpy()
    p /= p.sum(axis=1, keepdims=True)
    return pd.DataFrame(dict(zip(columns, (ids, c["source"].to_numpy(), x, p[:, 1], p[:, 2], p[:, 3]))))


def _spread_days(counts: DataFrame) -> DataFrame:
    """Each count once for every day whose level it touches."""
    days = F.array_distinct(F.array(*[floor_div(F.col("minute") + d, DAY) for d in (-REACH_M, 0, REACH_M)]))
    return counts.withColumn("day", F.explode(days))


def _spreads(counts: DataFrame, levels: DataFrame) -> DataFrame:
    """``source, spread``: each source's usual deviation from its level in tenths (1.4826 times the median distance, between 2 and 6), from counts per minute and value."""
    off = F.abs(F.col("value") - (F.col("lo") + F.col("hi")) / 2)
    by_off = counts.join(levels, ["source", "minute"]).groupBy("source", off.alias("off")).agg(F.sum("n").alias("n"))
    usual = 1.4826 * F.percentile("off", F.lit(0.5), F.col("n"))
    return by_off.groupBy("source").agg(F.round(F.greatest(F.lit(2.0), F.least(F.lit(6.0), usual)) * 10).cast("int").alias("spread"))


def suspicious_readings(
    spark: SparkSession, packets: DataFrame, source: str = "sniffer_id", ts: str = "ts", value: str = "rssi", ident: str = "id", block: int = BLOCK, model: Model | None = None
) -> DataFrame:
    """Readings that can't be what their source heard: ``id, source, value, p_spike, p_stuck, p_range, reason``, one row per id.

    ``reason`` is the most likely state: ``range`` (above +10 or below -120), ``stuck`` (one of at least 12 consecutive equal readings of the source in
    time order) or ``spike`` (20 or more off the median of the source's other readings within six hours to either side, leaving
    out range and stuck cases). Each id has one row, of the first reason in that order.

    Method: a hidden Markov model per source (:class:`Model`) with the states normal, spike, stuck and out of range, decoded by forward-backward: a
    reading is flagged when its most likely state isn't normal. The normal state is centred on the source's level with the source's own spread and ends 20 off it;
    the stuck state emits the repeats of long runs; the hard bounds are the state out of range. Readings are numbered
    along each source (a running sum of counts per minute, then a row number inside the minute) and cut into blocks of equal size
    with a halo, so a source is spread over its blocks; forward-backward runs over all blocks of a batch at once. Only the numbering sorts one minute of one source in one task.
    Counts per (source, minute, value) bound the median around any time of a minute whatever the number of readings. Where the bounds don't tell on which
    side of the normal state's edge a reading lies, the model keeps what its neighbours say of it, its exact median comes from the counts plus the two
    minutes at the window's edges, and the product of both gives its state.

    Defined results: a null value is no reading; a reading without source or valid time can only be out of range, by the hard bounds alone; copies of an id at
    one time are one reading; no rows, no result; a source with a single reading has no level. Other columns are not read.
    """
    model = Model() if model is None else model
    rows = packets.select(F.col(ident).alias("id"), F.col(source).cast("long").alias("source"), F.col(ts).alias("ts"), F.col(value).cast("int").alias("value")).filter("value is not null")
    placed = F.col("source").isNotNull() & F.col("id").isNotNull() & is_valid_time(F.col("ts"))
    unplaced = rows.filter(~placed & ((F.col("value") > HIGH) | (F.col("value") < LOW))).select("id", "source", "value", F.lit(0.0).alias("p_spike"), F.lit(0.0).alias("p_stuck"), F.lit(1.0).alias("p_range"))

    heard = rows.filter(placed).withColumn("us", micros(F.col("ts"))).withColumn("minute", floor_div(F.col("us"), MINUTE * MICROS)).drop("ts")
    along = Window.partitionBy("source").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = Stage(heard.groupBy("source", "minute").agg(F.count(F.lit(1)).alias("n")).withColumn("c0", F.coalesce(F.sum("n").over(along), F.lit(0))), "spike-offsets")
    at = offsets.df.select("source", "minute", "c0")
    numbered = heard.join(at, ["source", "minute"]).withColumn("pos", F.col("c0") + F.row_number().over(Window.partitionBy("source", "minute").orderBy("us", "id")) - 1)

    def in_blocks(df: DataFrame, halo: int) -> DataFrame:
        blks = F.sequence(floor_div(F.col("pos") - halo, block), floor_div(F.col("pos") + halo, block))
        return df.withColumn("blk", F.explode(blks)).withColumn("core", F.col("blk") == floor_div(F.col("pos"), block)).filter("blk >= 0")

    run_schema = "source long, minute long, us long, id long, value int, pos long, run boolean, short boolean"
    halo = 64
    while True:
        short = Observation()
        blocked = in_blocks(numbered.select("source", "minute", "us", "id", "value", "pos"), halo).repartition("source", "blk").sortWithinPartitions("source", "blk", "us", "id")
        done = Stage(blocked.mapInArrow(lambda b, h=halo: _runs(b, h, block), run_schema).observe(short, F.count_if("short").alias("n")).drop("short"), "spike-readings")
        if not short.get["n"]:
            break
        done.drop()
        halo *= 16
    readings = done.df

    clean = readings.filter(~F.col("run") & F.col("value").between(LOW, HIGH))
    counts = materialize(clean.groupBy("source", "minute", "value").agg(F.count(F.lit(1)).alias("n")), "spike-counts")
    levels = Stage(_spread_days(counts).groupBy("source", "day").applyInPandas(_levels, "source long, minute long, lo int, hi int"), "spike-levels")
    spreads = Stage(_spreads(counts, levels.df), "spike-spreads")

    first, last = floor_div(F.col("c0") - halo, block), floor_div(F.col("c0") + F.col("n") + halo, block)
    markers = levels.df.join(offsets.df, ["source", "minute"]).join(spreads.df, "source").withColumn("blk", F.explode(F.sequence(first, last)))
    none = [F.lit(None).cast("int").alias(c) for c in ("lo", "hi", "spread")]
    chains = in_blocks(readings, halo).select("source", "blk", "us", "id", "minute", "value", "run", "core", *none)
    no, nobody = F.lit(False), F.lit(-1).cast("long")
    chains = chains.unionByName(
        markers.select("source", "blk", (F.col("minute") * MINUTE * MICROS).alias("us"), nobody.alias("id"), "minute", F.lit(0).alias("value"), no.alias("run"), no.alias("core"), "lo", "hi", "spread")
    )
    chains = chains.withColumn("real", F.col("lo").isNull()).repartition("source", "blk").sortWithinPartitions("source", "blk", "us", "real", "id")
    around = ["c_normal", "c_spike", "c_stuck", "c_range"]
    decoded_schema = f"source long, minute long, us long, id long, value int, doubt boolean, spread double, p_spike double, p_stuck double, p_range double, {', '.join(f'{c} double' for c in around)}"
    decoded = materialize(chains.mapInArrow(lambda b: _decode(b, model), decoded_schema), "spike-decoded")
    for table in (offsets, levels, spreads):
        table.drop()

    doubtful = decoded.filter("doubt").withColumn("day", floor_div(F.col("minute"), DAY)).select("source", "day", "minute", "us", "id", "value", "spread", *around)
    ends = doubtful.select("source", "day", F.col("us").alias("at"), F.col("id").alias("of"), F.explode(F.array(F.col("minute") - REACH_M, F.col("minute") + REACH_M)).alias("minute"))
    edge = (
        ends.join(clean.select("source", "minute", "us", "value"), ["source", "minute"])
        .filter(F.abs(F.col("us") - F.col("at")) <= REACH_S * MICROS)
        .groupBy("source", "day", F.col("of").alias("id"), "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    touched = _spread_days(counts).join(doubtful.select("source", "day").distinct(), ["source", "day"], "left_semi")
    zero, unknown = F.lit(0).cast("long"), [F.lit(None).cast("double").alias(c) for c in ("spread", *around)]
    shape = lambda df, k, ident, minute, n, rest: df.select("source", "day", F.lit(k).alias("kind"), ident.alias("id"), minute.alias("minute"), "value", n.cast("long").alias("n"), *rest)
    settled = (
        shape(touched, 0, zero, F.col("minute"), F.col("n"), unknown)
        .unionByName(shape(doubtful, 1, F.col("id"), F.col("minute"), F.lit(1), ["spread", *around]))
        .unionByName(shape(edge, 2, F.col("id"), zero, F.col("n"), unknown))
        .groupBy("source", "day")
        .applyInPandas(lambda pdf: _settle(pdf, model), "id long, source long, value int, p_spike double, p_stuck double, p_range double")
    )
    told = ["id", "source", "value", "p_spike", "p_stuck", "p_range"]
    judged = decoded.filter("not doubt").select(*told).unionByName(settled).unionByName(unplaced)
    p = [1 - F.col("p_spike") - F.col("p_stuck") - F.col("p_range"), F.col("p_spike"), F.col("p_stuck"), F.col("p_range")]
    most = F.greatest(*p)
    reason = F.when(p[3] == most, STATES[3]).when(p[2] == most, STATES[2]).when(p[1] == most, STATES[1])
    rank = F.when(F.col("reason") == "range", 0).when(F.col("reason") == "stuck", 1).otherwise(2)
    whole = F.struct(rank.alias("rank"), "source", "value", "p_spike", "p_stuck", "p_range", "reason")
    return judged.withColumn("reason", reason).filter("reason is not null").groupBy("id").agg(F.min(whole).alias("w")).select("id", "w.source", "w.value", "w.p_spike", "w.p_stuck", "w.p_range", "w.reason")
