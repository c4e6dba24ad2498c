"""Continuous capture, drained once over the shared events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainspan.catalog.correlation import BURST_RULE, _chain
from chainspan.catalog.frames import CANON, WITH_CANON, canon, canon_of, table
from chainspan.catalog.registry import ORACLES, query
from chainspan.session import checkpoint_root
from chainspan.streaming import capture as c
from chainspan.streaming import matching as m


def _captured(spark, sf) -> str:
    """Drain the events file through a capture; returns the folder of its tables."""
    folder = f"{checkpoint_root(spark)}/capture-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    # The stream source takes a folder or a pattern.
    raw = spark.readStream.format("parquet").schema(schema).load(f"{sf}/event[s].parquet")
    events = canon_of(raw).withColumn("record_id", F.col("id") + 1)
    run = c.run_capture(events, f"{folder}/tables", f"{folder}/checkpoint")
    run.awaitTermination()
    return f"{folder}/tables"


@query(
    "capture_events",
    f"""WITH {CANON}, per AS (SELECT hash_normalized, source_identifier AS s, count(*) AS n FROM canon GROUP BY ALL),
      counts AS (SELECT hash_normalized, CAST(sum(n) AS BIGINT) AS dedup_count, string_agg(s || '=' || n, ';' ORDER BY s) AS source_counts FROM per GROUP BY 1)
      SELECT id, event_code, ts_ns, canon.hash_normalized, dedup_count, source_counts FROM canon JOIN counts USING (hash_normalized)
      QUALIFY row_number() OVER (PARTITION BY canon.hash_normalized ORDER BY id) = 1""",
)
def captured(spark, sf):
    return _shown(c.captured_events(spark, _captured(spark, sf)))


def _shown(out):
    pairs = F.transform(F.array_sort(F.map_entries("source_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select(
        "id", "event_code", "ts_ns", "hash_normalized", "dedup_count", F.array_join(pairs, ";").alias("source_counts")
    )


CAPTURED_SQL = ORACLES["capture_events"]


def _stage(events: DataFrame, folder: str, files: int, k: int) -> None:
    """Add the ``k``-th batch to ``folder`` in exactly so many files; where rows are too few, undated ones fill them."""
    spark = events.sparkSession
    present = lambda: len(spark.read.schema(events.schema).parquet(folder).inputFiles())
    before = present() if k else 0
    events.repartition(files).write.mode("append").parquet(folder)
    missing = before + files - present()
    if missing > 0:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]
        spark.range(0, missing, 1, missing).select(*none).write.mode("append").parquet(folder)


@query("match_temporal_stream", ORACLES["match_temporal"])
def matched(spark, sf):
    """The rule of ``match_temporal`` over a stream: six micro-batches, events up to some hours late across their cuts."""
    folder = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    events = canon(spark, sf).select("id", "event_code", "ts_ns", "computer")
    span = events.agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi")).first()
    width = max((span.hi or 0) - (span.lo or 0), 1)
    # Rows arrive by a time up to six hours after their own.
    arrival = F.col("ts_ns") + F.pmod(F.xxhash64("id"), F.lit(6 * 3_600)) * 1_000_000_000
    batch = F.least(F.floor((arrival - F.lit(span.lo or 0)) * 6 / width), F.lit(5)).cast("int")
    dated = events.filter("ts_ns is not null")
    dated.withColumn("batch", batch).write.partitionBy("batch").parquet(f"{folder}/dealt")
    dealt = spark.read.schema(T.StructType([*events.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/dealt")
    # The source reads files in the order they were written, those of one batch in each micro-batch.
    files = spark.sparkContext.defaultParallelism
    for k in range(6):
        _stage(dealt.filter(F.col("batch") == k).select(*events.columns), f"{folder}/in", files, k)
    m.closing(spark, events).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    run = m.run_matching(stream, m.Pattern(BURST_RULE, "8 hours"), f"{folder}/out", f"{folder}/checkpoint")
    run.awaitTermination()
    return _chain(spark.read.schema("scope string, ids array<bigint>, gap_ns bigint").parquet(f"{folder}/out"), "scope")


@query("capture_compacted", CAPTURED_SQL)
def compacted(spark, sf):
    """The same table after its batches were folded."""
    tables = _captured(spark, sf)
    c.compact(spark, tables)
    return _shown(c.captured_events(spark, tables))


@query("capture_reset", WITH_CANON + "SELECT channel, max(id) + 1 AS position FROM canon WHERE channel <> 'Security' GROUP BY channel")
def reset(spark, sf):
    """Positions after one channel was reset and the batches were folded."""
    tables = _captured(spark, sf)
    c.reset_position(spark, tables, "Security")
    c.compact(spark, tables)
    return c.positions(spark, tables)


@query("capture_positions", WITH_CANON + "SELECT channel, max(id) + 1 AS position FROM canon GROUP BY channel")
def position(spark, sf):
    return c.positions(spark, _captured(spark, sf))


@query(
    "capture_progress",
    WITH_CANON + """, f AS (SELECT hash_raw, first_value(hash_raw) OVER (PARTITION BY hash_normalized ORDER BY id) AS h FROM canon)
      SELECT count(*) AS read, count(*) - count(ts_ns) AS undated, (SELECT count(*) FROM f WHERE hash_raw <> h) AS divergent,
        count(DISTINCT hash_normalized) AS persisted, count(*) - count(DISTINCT hash_normalized) AS duplicate FROM canon""",
)
def progressed(spark, sf):
    return c.progress(spark, _captured(spark, sf))
