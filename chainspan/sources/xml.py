"""Rendered event records (XML text) to canonical events.

The envelope and the named data items are read by the built-in XML reader. Only records without named items need
their free-form part walked, and only those texts are sent to Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainspan.functions.hashing import hash_raw
from chainspan.functions.text import trimmed
from chainspan.functions.times import coerce_timestamp
from chainspan.session import ship_package

_EVENT = (
    "System struct<EventID struct<_VALUE string, _Qualifiers string>, "
    "TimeCreated struct<_SystemTime string, _VALUE string>, Provider struct<_Name string, _VALUE string>, "
    "EventRecordID string, Channel string, Computer string, Security struct<_UserID string, _VALUE string>>, "
    "EventData struct<Data array<struct<_Name string, _VALUE string>>>, _corrupt string"
)


def user_data_fields(raw: pd.Series) -> pd.Series:
    """Leaf element name -> text of the UserData part of each record (None in, None out)."""
    import xml.etree.ElementTree as ET

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    def leaves(text):
        if text is None:
            return None
        try:
            root = ET.fromstring(text)
        except ET.ParseError:
            return None
        out = {}
        for part in root:
            if local(part.tag) != "UserData":
                continue
            # iter() walks in document order, so of two leaves with one name the later one stays.
            for node in part.iter():
                value = (node.text or "").strip()
                if node is not part and len(node) == 0 and value:
                    out[local(node.tag)] = value
        return out or None

    return raw.map(leaves)


def shred_event_xml(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(events, rejected). Every input column is kept; events gain code, time, provider, channel, computer, user,
    record_id, fields and hash_raw. Text that is not an event record is rejected."""
    ship_package(df.sparkSession)
    parsed = df.withColumn(
        "_x", F.from_xml(F.col(raw), _EVENT, {"rowTag": "Event", "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    )
    bad = F.col("_x").isNull() | F.col("_x._corrupt").isNotNull() | F.col("_x.System").isNull()
    parsed = parsed.withColumn("_bad", bad)
    s = "_x.System."
    items = F.transform(
        F.coalesce(F.col("_x.EventData.Data"), F.array().cast("array<struct<_Name string,_VALUE string>>")),
        lambda d: F.struct(trimmed(F.coalesce(d["_Name"], F.lit(""))).alias("k"), trimmed(F.coalesce(d["_VALUE"], F.lit(""))).alias("v")),
    )
    named = F.filter(items, lambda d: d["k"] != "")
    # A repeated name keeps its last value: drop an item when the same name follows.
    last = F.filter(
        named, lambda d, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["k"] == d["k"])
    )
    walk = F.pandas_udf(user_data_fields, T.MapType(T.StringType(), T.StringType()))
    text = lambda c: F.coalesce(F.col(s + c), F.lit(""))
    good = (
        parsed.filter(~F.col("_bad"))
        .withColumn("_named", F.map_from_entries(last))
        .withColumn("_loose", walk(F.when(F.size("_named") == 0, F.col(raw))))
        .select(
            *df.columns,
            trimmed(text("EventID._VALUE")).alias("event_code"),
            coerce_timestamp(F.col(s + "TimeCreated._SystemTime")).alias("ts_ns"),
            text("Provider._Name").alias("provider"),
            text("Channel").alias("channel"),
            text("Computer").alias("computer"),
            text("Security._UserID").alias("user"),
            trimmed(F.col(s + "EventRecordID")).try_cast("bigint").alias("record_id"),
            F.when(F.size("_named") > 0, F.col("_named")).otherwise(F.col("_loose")).alias("fields"),
            hash_raw(F.col(raw)).alias("hash_raw"),
        )
    )
    return good, parsed.filter("_bad").select(*df.columns)
