"""Upserts as folds: parquet has no MERGE, so tables are united with changes and aggregated again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.identity import precedence


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. A running best per task, not a sort: rows combine before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_known(column: str, seq: str) -> Column:
    """The value of the greatest ``seq`` where it isn't null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(seq))).alias(column)


def first_known(column: str, seq: str) -> Column:
    """The value of the least ``seq`` where it isn't null: once set it sticks."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(seq))).alias(column)


def most_specific(column: str, seq: str) -> Column:
    """The first class of the highest precedence: a later one replaces it only if more specific."""
    known = F.col(column).isNotNull()
    return F.max_by(column, F.when(known, F.struct(precedence(F.col(column)).alias("r"), (-F.col(seq)).alias("s")))).alias(column)


def devices(sightings: DataFrame, key: str = "stable_key", seq: str = "seq", ts: str = "ts") -> DataFrame:
    """Devices from sightings with clues: latest known names, first known vendor, most specific class, times."""
    return sightings.groupBy(key).agg(
        F.min_by("kind", seq).alias("kind"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), latest_known("local_name", seq), latest_known("vendor_id", seq),
        first_known("vendor", seq), latest_known("model", seq), latest_known("appearance", seq), most_specific("device_class", seq),
    )


def addresses(sightings: DataFrame, seq: str = "seq", ts: str = "ts") -> DataFrame:
    return sightings.groupBy("address", "address_type").agg(first_known("device_id", seq), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def broadcasts(sightings: DataFrame, seq: str = "seq", ts: str = "ts") -> DataFrame:
    """Audio broadcasts per session: latest known fields; once encrypted, always."""
    return sightings.groupBy("session_id", "broadcast_id").agg(
        *[latest_known(c, seq) for c in ("broadcaster_device_id", "broadcast_name", "bis_count", "phy")], F.coalesce(F.bool_or("encrypted"), F.lit(False)).alias("encrypted"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
    )


def merged_identifiers(rows: DataFrame, key: str, column: str, seq: str) -> DataFrame:
    """MAP columns of a key merged; of equal names the latest value counts."""
    long = rows.select(key, seq, F.explode(column).alias("name", "value"))
    return long.groupBy(key, "name").agg(F.max_by("value", seq).alias("value")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(column))


def discovered(known: DataFrame, sweep: DataFrame, key: str = "serial_number") -> DataFrame:
    """Receivers after a discovery sweep: found ones active and not removed, others inactive; given names stay; an empty sweep deactivates all."""
    k, s = known.alias("k"), sweep.alias("s")
    hit = F.col(f"s.{key}").isNotNull()
    return k.join(s, F.col(f"k.{key}") == F.col(f"s.{key}"), "full_outer").select(
        F.coalesce(f"k.{key}", f"s.{key}").alias(key), F.coalesce("k.name", "s.name").alias("name"), F.when(hit, F.col("s.usb_port_id")).otherwise(F.col("k.usb_port_id")).alias("usb_port_id"),
        hit.alias("is_active"), F.when(hit, F.lit(False)).otherwise(F.col("k.removed")).alias("removed"), F.coalesce("k.first_seen", "s.seen_at").alias("first_seen"), F.coalesce("s.seen_at", "k.last_seen").alias("last_seen"),
    )


def without_parents(children: DataFrame, deleted: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Cascading delete: children whose parent isn't deleted."""
    return children.join(deleted.select(F.col(key).alias("_gone")), F.col(column) == F.col("_gone"), "left_anti")


def current_state(log: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """State of each request from its log: the row of the greatest (time, seq)."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, seq)).alias("r")).select(key, "r.*")


def overridden(rows: DataFrame, edits: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """``rows`` after the edits of users (``key, field, value, seq``): the last edit of a field counts, a null value clears it, other fields stay."""
    last = edits.filter(F.col("field").isin(fields)).groupBy(key, "field").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    wide = last.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("v"))).alias(f"_{f}") for f in fields])
    return rows.join(wide, key, "left").withColumns({f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def maintained(receivers: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Receivers after a log of upkeep (``key, op, value, seq``): ``remove`` and ``restore`` (the last counts), ``name`` (the last; null clears), ``stall`` (counted from the last
    ``clear`` on, on top of what there was if none cleared it; ``seq`` of the last is its time)."""
    op = lambda *names: F.col("op").isin(*names)
    cleared = log.filter(op("clear")).groupBy(key).agg(F.max("seq").alias("_cleared"))
    seen = log.join(cleared, key, "left").groupBy(key).agg(
        F.max_by(op("remove"), F.when(op("remove", "restore"), F.col("seq"))).alias("_removed"), F.max_by(F.struct("value"), F.when(op("name"), F.col("seq"))).alias("_name"), F.first("_cleared").alias("_cleared"),
        F.count_if(op("stall") & F.coalesce(F.col("seq") > F.col("_cleared"), F.lit(True))).alias("_stalls"), F.max(F.when(op("stall") & F.coalesce(F.col("seq") > F.col("_cleared"), F.lit(True)), F.col("seq"))).alias("_at"),
    )
    held = F.when(F.col("_cleared").isNull(), F.coalesce("stall_count", F.lit(0))).otherwise(0)
    return receivers.join(seen, key, "left").withColumns(
        {
            "removed": F.coalesce("_removed", "removed"), "name": F.when(F.col("_name").isNotNull(), F.col("_name.value")).otherwise(F.col("name")), "stall_count": held + F.coalesce("_stalls", F.lit(0)),
            "last_stall_at": F.coalesce("_at", F.when(F.col("_cleared").isNull(), F.col("last_stall_at"))),
        }
    ).drop("_removed", "_name", "_cleared", "_stalls", "_at")


def ended(sessions: DataFrame, ends: DataFrame, key: str = "id") -> DataFrame:
    """Sessions after their ends (``key, at, notes, seq``): the last end's time, its notes where it has any, else those there were."""
    last = ends.groupBy(key).agg(F.max_by("at", "seq").alias("_at"), F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("seq"))).alias("_notes"))
    return sessions.join(last, key, "left").withColumns({"ended_at": F.coalesce("_at", "ended_at"), "notes": F.coalesce("_notes", "notes")}).drop("_at", "_notes")


def keys_added(keys: DataFrame, seq: str = "seq") -> DataFrame:
    """Identity keys by their digits in lower case: the first label, the last device linked; other texts than 32 hex digits are no keys."""
    hex32 = keys.withColumn("key_hex", F.lower("key_hex")).filter(F.col("key_hex").rlike("^[0-9a-f]{32}$"))
    return hex32.groupBy("key_hex").agg(first_known("label", seq), latest_known("device_id", seq))
