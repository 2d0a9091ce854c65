"""Dissector output: one JSON document a line, read by schema, normalised to packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.functions.binary import bound
from radiolake.functions.frames import PDU_NAMES, lookup
from radiolake.functions.text import dissected_int

PHYS = {"0": "1M", "1": "2M", "2": "Coded", "3": "Coded"}


#: Fields read, by layer; AD fields may stand in the link layer or the common one. Fixed values of the dissector.
FIELDS = {
    "btle": ["advertising_header_pdu_type", "advertising_address", "advertising_header_randomized_tx", "target_address", "scanning_address"],
    "nordic_ble": ["channel", "rssi", "phy", "crcok"], "btle_rf": ["channel", "signal_dbm", "phy"], "btcommon": [],
}
AD_PREFIX = "btcommon_btcommon_eir_ad_entry_"
AD_FIELDS = ["device_name", "uuid_16", "company_id", "data", "power_level", "appearance", "type", "service_data", "broadcast_name"]


def _keys(layer: str, name: str) -> list[str]:
    """The names under which a field may stand: with the layer's name doubled, single or left out."""
    return [f"{layer}_{layer}_{name}", f"{layer}_{name}", name]


def _schema() -> str:
    of = lambda layer, names: [k for n in names for k in _keys(layer, n)] + ([AD_PREFIX + n for n in AD_FIELDS] if layer in ("btle", "btcommon") else [])
    layers = ", ".join(f"{layer}: struct<{', '.join(f'{k}: string' for k in of(layer, names))}>" for layer, names in FIELDS.items())
    return f"timestamp string, layers struct<{layers}>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents that have layers: ``timestamp`` (text, milliseconds) and ``layers``, of text files."""
    return parsed(spark.read.text(path))


def parsed(lines: DataFrame) -> DataFrame:
    """The same of lines (``value``), with their other columns. Lines without layers (index lines, broken ones) are skipped.

    A line is read once, by a schema of the fields used; lists come as their JSON text.
    """
    rest = [c for c in lines.columns if c != "value"]
    # Exploded, so that no condition on the parts is moved below and reads the line again.
    return lines.select(*rest, F.explode(F.filter(F.array(F.from_json("value", _schema())), lambda d: d["layers"].isNotNull())).alias("d")).select(*rest, "d.timestamp", "d.layers")


def _listed(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def _is_list(text: Column) -> Column:
    return F.startswith(text, F.lit("["))


def field(layers: Column, layer: str, name: str) -> Column:
    """A header field's first value as text, whether it stands alone or in a list; also under the layer's name doubled."""
    text = F.coalesce(*[layers[layer][key] for key in _keys(layer, name)])
    return F.when(_is_list(text), F.get(_listed(text), F.lit(0))).otherwise(text)


def values(layers: Column, name: str) -> Column:
    """All values of an AD field as an array of texts, from the link or the common layer; empty where it is missing."""
    text = F.coalesce(layers["btle"][AD_PREFIX + name], layers["btcommon"][AD_PREFIX + name])
    return F.when(_is_list(text), _listed(text)).when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))


def packets(docs: DataFrame, source: str = "file", keep: list[str] | None = None) -> DataFrame:
    """Normalised packets of documents with a link layer: time, channel, level, phy, PDU type, addresses and AD fields.

    Channel, level and phy come from the sniffer's layer, else from the radio's. A time that is missing is 0; ``crc_ok`` comes from the input
    (missing: sound). Addresses are lower case; their type is known only with the transmit bit. ``keep``: columns of ``docs`` to carry along.
    """
    L = F.col("layers")
    whole = lambda text: bound(text, dissected_int)
    either = lambda a, b: F.coalesce(whole(field(L, "nordic_ble", a)), whole(field(L, "btle_rf", b)))
    pdu = field(L, "btle", "advertising_header_pdu_type")
    tx = F.lower(field(L, "btle", "advertising_header_randomized_tx"))
    random = bound(tx, lambda t: F.when(t.isin("1", "true"), True).when(t.isin("0", "false"), False))
    first = lambda name: F.get(values(L, name), F.lit(0))
    return docs.filter(L["btle"].isNotNull()).select(
        *(keep or []),
        (F.coalesce(F.col("timestamp").try_cast("double"), F.lit(0.0)) / 1000).alias("ts"), F.lit(source).alias("source"),
        either("channel", "channel").cast("int").alias("channel"), either("rssi", "signal_dbm").cast("int").alias("rssi"),
        lookup(PHYS, F.coalesce(field(L, "nordic_ble", "phy"), field(L, "btle_rf", "phy"))).alias("phy"),
        bound(pdu, lambda t: F.coalesce(lookup(dict(enumerate(PDU_NAMES)), dissected_int(t).cast("int")), t)).alias("pdu_type"),
        F.lower(field(L, "btle", "advertising_address")).alias("adv_addr"), random.alias("is_random"),
        F.lower(F.coalesce(field(L, "btle", "target_address"), field(L, "btle", "scanning_address"))).alias("peer_addr"),
        (F.coalesce(whole(field(L, "nordic_ble", "crcok")), F.lit(1)) != 0).alias("crc_ok"),
        first("device_name").alias("name"), F.transform(values(L, "uuid_16"), lambda u: dissected_int(u).cast("int")).alias("uuids"),
        whole(first("company_id")).cast("int").alias("company"), first("data").alias("data"), whole(first("power_level")).cast("int").alias("power"),
        whole(first("appearance")).cast("int").alias("appearance"), F.transform(values(L, "type"), lambda t: dissected_int(t).cast("int")).alias("ad_types"), values(L, "service_data").alias("service_data"),
        first("broadcast_name").alias("broadcast_name"),
    )
