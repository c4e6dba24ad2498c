"""Event tables and message catalogues from any Spark source (parquet, csv, json, jdbc, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainspan import model
from chainspan.functions.hashing import hash_raw
from chainspan.functions.text import trimmed
from chainspan.functions.times import OUT_OF_RANGE, coerce_timestamp, epoch_ns, reads_as_time
from chainspan.operators.identity import identity_hash


class MissingColumns(ValueError):
    pass


def _match(actual: list[str], wanted: dict[str, tuple[str, ...]]) -> dict[str, str]:
    by_lower = {c.lower(): c for c in actual}
    found = {}
    for name, aliases in wanted.items():
        hit = next((by_lower[a] for a in (name, *aliases) if a in by_lower), None)
        if hit is not None:
            found[name] = hit
    return found


def resolve_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]] = model.COLUMN_ALIASES) -> DataFrame:
    """Rename by case-insensitive alias to the canonical columns; optional ones default to ''.

    Only the resolved columns are read. A missing required column is an error that names it.
    """
    found = _match(df.columns, aliases)
    missing = sorted(c for c in model.REQUIRED_COLUMNS if c not in found)
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    cols = [F.col(f"`{found[c]}`").alias(c) for c in model.REQUIRED_COLUMNS]
    for c in model.OPTIONAL_COLUMNS:
        cols.append((F.col(f"`{found[c]}`").cast("string") if c in found else F.lit("")).alias(c))
    return df.select(*cols)


def timestamp_ns(df: DataFrame, column: str) -> Column:
    """``ts_ns`` of a column of any type."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return epoch_ns(c)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return coerce_timestamp(c.cast("bigint"))
    return coerce_timestamp(c)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of a resolved table. A bad row is set aside with its reason and never stops a load."""
    code = trimmed(F.col("event_id").cast("string"))
    stamp = trimmed(F.col("timestamp").cast("string"))
    def told(ns: Column) -> Column:
        reason = (
            F.when(F.coalesce(stamp, F.lit("")) == "", "empty timestamp")
            .when(ns.isNull() & reads_as_time(F.col("timestamp")), OUT_OF_RANGE)
            .when(ns.isNull(), "unrecognized timestamp")
            .when(F.coalesce(code, F.lit("")) == "", "empty event id")
        )
        return F.struct(ns.alias("ts_ns"), reason.alias("reason"))

    # A row generated from each row: a filter on it is not moved to before it, where it would read the time once more.
    checked = df.select("*", F.inline(F.transform(F.array(timestamp_ns(df, "timestamp")), told)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    good = checked.filter(F.col("reason").isNull()).select(
        code.alias("event_code"),
        "ts_ns",
        text("provider"),
        text("channel"),
        text("computer"),
        text("user"),
        text("raw_xml"),
    )
    return good, checked.filter(F.col("reason").isNotNull()).drop("ts_ns")


def message_catalogue(messages: DataFrame, providers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undated events from a message table left-joined to its providers; rows without an event id are set aside.

    The message text is part of the identity, since such rows have neither time nor host.
    """
    m = _match(messages.columns, {"event_id": (), "provider_id": (), "message": ()} | model.MESSAGE_ALIASES)
    p = _match(providers.columns, model.PROVIDER_ALIASES)
    missing = [c for c in ("event_id", "provider_id", "message") if c not in m] + [c for c in ("id", "name") if c not in p]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    # No hint: Spark broadcasts the provider side when its statistics say it is small enough.
    names = providers.select(F.col(p["id"]).alias("_pid"), F.col(p["name"]).cast("string").alias("_name"))
    joined = messages.select(
        F.col(m["event_id"]).cast("string").alias("_code"),
        F.col(m["provider_id"]).alias("_provider"),
        F.coalesce(F.col(m["message"]).cast("string"), F.lit("")).alias("message"),
    ).join(names, F.col("_provider") == F.col("_pid"), "left")
    rows = joined.select(
        trimmed(F.coalesce("_code", F.lit(""))).alias("event_code"),
        F.lit(None).cast("bigint").alias("ts_ns"),
        trimmed(F.coalesce("_name", F.lit(""))).alias("provider"),
        F.lit("").alias("channel"),
        F.lit("").alias("computer"),
        F.lit("").alias("user"),
        F.lit("").alias("source_identifier"),
        "message",
        F.create_map(F.lit("message"), F.col("message")).alias("fields"),
        hash_raw(F.col("message")).alias("hash_raw"),
    )
    good = rows.filter("event_code <> ''").withColumn("hash_normalized", identity_hash(F.col("message")))
    return good, rows.filter("event_code = ''").select("event_code", "message")


def stamp_source(df: DataFrame, source_type: str, identifier: str | Column | None = None) -> DataFrame:
    """Origin class and the concrete file or channel. Without an identifier the file each row came from is used."""
    where = F.col("_metadata.file_path") if identifier is None else identifier
    where = F.lit(where) if isinstance(where, str) else where
    return df.withColumn("source_type", F.lit(source_type)).withColumn("source_identifier", where)
