"""Writers for event sets, with the analyst's findings beside each event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspan.functions.times import utc_text

EXPORT_COLUMNS = ("id", "event_id", "timestamp", "provider", "channel", "computer", "user", "hash_raw", "hash_normalized")


def export_frame(df: DataFrame, findings: DataFrame | None = None, fmt: str = "csv") -> DataFrame:
    """The table an export writes.

    CSV gets flat ``finding_*`` columns, only when some event has a finding; JSON gets one ``finding`` object, left out
    where there is none. Findings never mix with the evidence columns.
    """
    base = df.withColumn("event_id", F.col("event_code")).withColumn("timestamp", F.coalesce(utc_text(F.col("ts_ns")), F.lit("")))
    base = base.select(*EXPORT_COLUMNS)
    if findings is None:
        return base
    side = findings.withColumnRenamed("key", "hash_normalized")
    if fmt == "json":
        note = F.struct("flagged", "tags", "note", "descriptor").alias("finding")
        return base.join(side.select("hash_normalized", note), "hash_normalized", "left").select(*EXPORT_COLUMNS, "finding")
    if base.join(side, "hash_normalized", "left_semi").isEmpty():
        return base
    flat = side.select(
        "hash_normalized",
        F.when(F.col("flagged"), "true").otherwise("false").alias("finding_flagged"),
        F.array_join("tags", "; ").alias("finding_tags"),
        F.coalesce("note", F.lit("")).alias("finding_note"),
    )
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return base.join(flat, "hash_normalized", "left").select(
        *EXPORT_COLUMNS, blank("finding_flagged"), blank("finding_tags"), blank("finding_note")
    )


def export_events(df: DataFrame, path: str, findings: DataFrame | None = None, fmt: str = "csv") -> None:
    """Write the export as many files as the data has partitions."""
    out = export_frame(df, findings, fmt)
    if fmt == "csv":
        # Quotes inside a value are doubled, as spreadsheets expect.
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        out.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
