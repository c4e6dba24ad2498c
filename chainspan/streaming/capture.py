"""Continuous capture: a stream of records into event tables.

Each micro-batch is written as its own folder of *observations*: one row per (identity, source) with a count and the
first row seen. The folder is named after the batch and replaced as a whole, so a batch that is run again after a
failure changes nothing, and no batch ever rewrites what earlier ones stored. The event table is the sum over the
folders. ``compact`` folds finished ones into one beside them and then notes, in ``manifest``, up to which batch: readers
take the folded part and the batches after it, so a capture may go on meanwhile.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

_STATE = ("_source", "_n", "_first")


def capture(spark: SparkSession, source: str, schema, **options) -> DataFrame:
    """A stream of records; the channel is a column, so one query can follow many channels."""
    return spark.readStream.format(source).schema(schema).options(**options).load()


def observe_batch(batch: DataFrame, batch_id: int) -> DataFrame:
    """(identity, source, raw hash) totals of one micro-batch and the first row of each.

    ``_first`` orders rows over the whole stream: batch, then record order within it.
    """
    order = F.struct(F.lit(batch_id).cast("bigint").alias("batch"), F.col("id").cast("bigint").alias("seq"))
    row = F.struct(*batch.columns)
    source = F.coalesce(F.col("source_identifier"), F.lit("")).alias("_source")
    return (
        batch.withColumn("_o", order)
        .groupBy("hash_normalized", source, F.coalesce("hash_raw", F.lit("")).alias("_raw"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min_by(row, F.col("_o")).alias("row"), F.min("_o").alias("_first"))
    )


def run_capture(
    stream: DataFrame,
    tables: str,
    checkpoint: str,
    mode: str = "available_now",
    channel: str = "channel",
    record_id: str = "record_id",
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Start the capture. ``available_now`` drains what is there and stops; ``continuous`` keeps following.

    The stream must already carry ``id``, ``hash_normalized``, ``hash_raw``, ``source_identifier``, ``ts_ns``, the
    channel and the record id. Positions are written after the events of the same batch, never before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            _overwrite(observe_batch(batch, batch_id), f"{tables}/observations", batch_id)
            counts = batch.agg(
                F.count(F.lit(1)).alias("read"), F.count_if(F.col("ts_ns").isNull()).alias("undated")
            )
            _overwrite(counts, f"{tables}/progress", batch_id)
            where = batch.groupBy(F.col(channel).alias("channel")).agg(F.max(record_id).alias("position"))
            _overwrite(where, f"{tables}/positions", batch_id)
        finally:
            batch.unpersist()

    counted = stream.observe("capture", F.count(F.lit(1)).alias("read"), F.count_if(F.col("ts_ns").isNull()).alias("undated"))
    writer = counted.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if mode == "available_now":
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def _overwrite(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


class _Counts(StreamingQueryListener):
    def __init__(self, callback: Callable[[dict], None]):
        self.callback = callback

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("capture")
        if seen is not None:
            self.callback({"batch": event.progress.batchId, "read": seen["read"], "undated": seen["undated"]})

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def follow(spark: SparkSession, callback: Callable[[dict], None]) -> StreamingQueryListener:
    """Call ``callback`` with the batch, and the records read and undated in it, as captures go on.

    Returns the listener, for ``spark.streams.removeListener``.
    """
    listener = _Counts(callback)
    spark.streams.addListener(listener)
    return listener


def _folded_to(spark: SparkSession, tables: str) -> int | None:
    """Up to which batch the tables are folded."""
    try:
        return spark.read.schema("upto long").parquet(f"{tables}/manifest").agg(F.max("upto")).first()[0]
    except AnalysisException:
        return None


def _stored(spark: SparkSession, tables: str, kind: str) -> DataFrame:
    """A table's folded part, as of its last batch, and the batches after it."""
    upto = _folded_to(spark, tables)
    fresh = spark.read.parquet(f"{tables}/{kind}").withColumn("batch", F.col("batch").cast("long"))
    if upto is None:
        return fresh
    folded = spark.read.parquet(f"{tables}/folded/{upto}/{kind}").withColumn("batch", F.lit(upto).cast("long"))
    return folded.unionByName(fresh.filter(F.col("batch") > upto))


def captured_events(spark: SparkSession, tables: str) -> DataFrame:
    """The event table: first row per identity, with total and per-source counts."""
    seen = _stored(spark, tables, "observations").drop("batch")
    return fold_observations(seen).select("row.*", "dedup_count", "source_counts")


def _per_source(seen: DataFrame, *more: str) -> DataFrame:
    return seen.groupBy("hash_normalized", "_source", *more).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))


def fold_observations(seen: DataFrame) -> DataFrame:
    """Counts per identity, and its first row. Only hashes and counts are aggregated; the wide first rows are then
    fetched by their place in the stream, which is unique."""
    counts = (
        _per_source(seen)
        .groupBy("hash_normalized")
        .agg(
            F.min("_first").alias("_first"),
            F.sum("_n").alias("dedup_count"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("_source", "_n")))).alias("source_counts"),
        )
    )
    return _fetch_rows(seen, counts)


def _fetch_rows(seen: DataFrame, counts: DataFrame) -> DataFrame:
    place = lambda df: df.withColumn("_b", F.col("_first.batch")).withColumn("_s", F.col("_first.seq"))
    rows = place(seen).select("_b", "_s", "row")
    return place(counts).join(rows, ["_b", "_s"]).drop("_b", "_s")


def compact(spark: SparkSession, tables: str) -> None:
    """Fold all finished batches. Positions are a batch's last write, so the highest one stored is finished."""
    upto = spark.read.parquet(f"{tables}/positions").agg(F.max("batch")).first()[0]
    if upto is None or upto == _folded_to(spark, tables):
        return
    finished = lambda kind: _stored(spark, tables, kind).filter(F.col("batch") <= upto)
    seen = finished("observations").drop("batch")
    parts = {
        "observations": _fetch_rows(seen, _per_source(seen, "_raw")),
        "progress": finished("progress").agg(F.sum("read").alias("read"), F.sum("undated").alias("undated")),
        "positions": _latest(spark, tables, finished("positions")),
    }
    for kind, df in parts.items():
        df.write.mode("overwrite").parquet(f"{tables}/folded/{upto}/{kind}")
    spark.range(1).select(F.lit(upto).cast("long").alias("upto")).write.mode("append").parquet(f"{tables}/manifest")


def _latest(spark: SparkSession, tables: str, where: DataFrame) -> DataFrame:
    try:
        resets = spark.read.schema("channel string, batch long").parquet(f"{tables}/resets")
    except AnalysisException:
        resets = spark.createDataFrame([], "channel string, batch long")
    last = resets.groupBy("channel").agg(F.max("batch").alias("reset"))
    valid = where.join(last, "channel", "left").filter(F.col("reset").isNull() | (F.col("batch") > F.col("reset")))
    return valid.groupBy("channel").agg(F.max("position").alias("position"))


def positions(spark: SparkSession, tables: str) -> DataFrame:
    """Highest record id stored per channel since the channel was last reset."""
    return _latest(spark, tables, _stored(spark, tables, "positions"))


def reset_position(spark: SparkSession, tables: str, channel: str) -> None:
    """Forget a channel's position, so that it is read again; what is stored of it stays, and copies are counted."""
    now = spark.read.parquet(f"{tables}/positions").agg(F.max("batch")).first()[0]
    row = spark.range(1).select(F.lit(channel).alias("channel"), F.lit(-1 if now is None else now).cast("long").alias("batch"))
    row.write.parquet(f"{tables}/resets/reset={uuid.uuid4().hex}")


def progress(spark: SparkSession, tables: str) -> DataFrame:
    """Running totals over all batches: read, persisted, duplicate, undated, divergent.

    Divergent are records whose raw hash differs from that of the first record of their identity in the whole capture.
    """
    p = _stored(spark, tables, "progress").agg(F.sum("read").alias("read"), F.sum("undated").alias("undated"))
    seen = _stored(spark, tables, "observations")
    texts = seen.groupBy("hash_normalized", "_raw").agg(F.sum("_n").alias("n"), F.min("_first").alias("first"))
    each = texts.groupBy("hash_normalized").agg((F.sum("n") - F.min_by("n", "first")).alias("others"))
    kept = each.agg(F.count(F.lit(1)).alias("persisted"), F.coalesce(F.sum("others"), F.lit(0)).cast("long").alias("divergent"))
    return p.join(F.broadcast(kept), how="left").withColumn("duplicate", F.col("read") - F.col("persisted"))
