"""Event identity and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspan.functions.hashing import hash_fields
from chainspan.functions.times import utc_text


def identity_hash(*extra: Column) -> Column:
    """Content hash of an event. A dated event includes its time and source; an undated one neither."""
    base = [F.col(c) for c in ("provider", "channel", "computer", "user")]
    dated = hash_fields(F.col("event_code"), utc_text(F.col("ts_ns")), *base, F.col("source_identifier"), *extra)
    return F.when(F.col("ts_ns").isNotNull(), dated).otherwise(hash_fields(F.col("event_code"), *base, *extra))


def hash_normalized(df: DataFrame, extra: tuple[Column, ...] = ()) -> DataFrame:
    return df.withColumn("hash_normalized", identity_hash(*extra))


def identity_counts(df: DataFrame, order: str = "id") -> DataFrame:
    """Per identity: ``dedup_count``, ``source_counts`` and the order value of the first row.

    Counted by (identity, source) first, where copies collapse before the shuffle: a hash that makes up a third of
    the input goes on as one row per source.
    """
    source = F.coalesce(F.col("source_identifier"), F.lit("")).alias("_source")
    per_source = df.groupBy("hash_normalized", source).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return per_source.groupBy("hash_normalized").agg(
        F.min("_first").alias("_first"),
        F.sum("_n").alias("dedup_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_source", "_n")))).alias("source_counts"),
    )


def dedup(df: DataFrame, order: str = "id") -> DataFrame:
    """One row per identity, the first seen, with ``dedup_count`` and ``source_counts`` (their sum is the count).

    ``order`` is unique. Only hashes and counts are aggregated; the first rows are then fetched by ``order``, so wide
    rows are shuffled once and on a key that cannot be skewed.
    """
    df = df.drop("dedup_count", "source_counts")
    counts = identity_counts(df, order).withColumnRenamed("_first", order).drop("hash_normalized")
    return df.join(counts, order).select(*df.columns, "dedup_count", "source_counts")


def divergent_duplicates(df: DataFrame, order: str = "id") -> DataFrame:
    """One row: copies whose raw hash differs from that of the first row with the same identity.

    Counted from (identity, raw hash) totals, so no group of copies is ever gathered.
    """
    groups = df.groupBy("hash_normalized", "hash_raw").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    per = groups.groupBy("hash_normalized").agg(F.sum("n").alias("all"), F.min_by("n", "first").alias("same"))
    return per.agg(F.coalesce(F.sum(F.col("all") - F.col("same")), F.lit(0)).alias("divergent"))


def merge_batch(existing: DataFrame, batch: DataFrame, order: str = "id") -> DataFrame:
    """``existing`` (already de-duplicated) plus a raw batch: new identities are added, known ones get counts.

    The stored row of a known identity is kept as it is.
    """
    new = dedup(batch, order)
    names = [c for c in existing.columns if c not in ("dedup_count", "source_counts")]
    old_side = existing.select(
        "hash_normalized",
        F.struct(*names).alias("o"),
        F.col("dedup_count").alias("on"),
        F.col("source_counts").alias("om"),
    )
    new_side = new.select(
        "hash_normalized",
        F.struct(*names).alias("b"),
        F.col("dedup_count").alias("bn"),
        F.col("source_counts").alias("bm"),
    )
    empty = F.create_map().cast("map<string,bigint>")
    zero = F.lit(0).cast("bigint")
    merged = F.map_zip_with(
        F.coalesce("om", empty), F.coalesce("bm", empty), lambda k, a, b: F.coalesce(a, zero) + F.coalesce(b, zero)
    )
    both = old_side.join(new_side, "hash_normalized", "full_outer").withColumn("r", F.coalesce("o", "b"))
    return both.select(
        *[F.col("r")[c].alias(c) for c in names],
        (F.coalesce("on", zero) + F.coalesce("bn", zero)).alias("dedup_count"),
        merged.alias("source_counts"),
    ).select(*existing.columns)


def append_batch(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Plain append, for a load that keeps every copy."""
    one = batch.withColumn("dedup_count", F.lit(1).cast("bigint")).withColumn(
        "source_counts", F.create_map(F.coalesce(F.col("source_identifier"), F.lit("")), F.lit(1).cast("bigint"))
    )
    return existing.unionByName(one.select(*existing.columns))


def ingest_summary(good: DataFrame, rejected: DataFrame, order: str = "id", raw_hash: bool = True) -> DataFrame:
    """One row: read, persisted, duplicate, skipped, undated, divergent."""
    seen = good.agg(
        F.count(F.lit(1)).alias("read"), F.count_if(F.col("ts_ns").isNull()).alias("undated")
    )
    kept = good.groupBy("hash_normalized").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("persisted"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate")
    )
    skipped = rejected.agg(F.count(F.lit(1)).alias("skipped"))
    out = seen
    parts = [kept, skipped] + ([divergent_duplicates(good, order)] if raw_hash else [])
    for one_row in parts:
        out = out.join(F.broadcast(one_row), how="left")
    return out
