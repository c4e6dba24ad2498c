"""Timed rules over streams: late rows, ties, cuts between micro-batches."""

import random

import models
from pyspark.sql import functions as F

from chainspan.plans.rules import Rule
from chainspan.streaming.matching import Pattern, closing, run_matching

SCHEMA = "id long, event_code string, ts_ns long, computer string, logon_id string"
SECOND = 1_000_000_000


def test_stream_equals_batch(spark, tmp_path):
    """Rows arrive up to 50 seconds late, in five micro-batches; the last one closes the stream."""
    rnd, t, rows = random.Random(5), 1_700_000_000, []
    for i in range(240):
        t += rnd.choice([0, 0, 1, 4, 9, 40])
        rows.append((i, rnd.choice("AABC"), None if rnd.random() < 0.03 else t * SECOND + rnd.randrange(3), rnd.choice(["h"] * 4 + ["g", None]), rnd.choice(["x", "x", "y", None])))
    arrives = sorted(rows, key=lambda r: (r[2] or 0) + rnd.randrange(50) * SECOND)
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(4):
        part = arrives[k * 60 : (k + 1) * 60]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    closing(spark, df).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rule = Rule("burst", ("A", "A", "B"), "temporal", window_within="60s", window_total="90s", match_fields=("logon_id",))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = run_matching(stream, Pattern(rule, "2 minutes"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    run.awaitTermination()
    assert run.lastProgress["batchId"] >= 4
    got = spark.read.schema("scope string, logon_id string, ids array<bigint>, gap_ns bigint").parquet(f"{tmp_path}/out").collect()
    buckets = models.ordered(rows, lambda e: None if e[4] is None else (e[3] or "", e[4]))
    expected = sorted((k, m) for k, b in buckets.items() for m in models.temporal(b, rule.sequence, rule.within_ns, rule.total_ns))
    assert expected and sorted(((r.scope, r.logon_id), tuple(r.ids)) for r in got) == expected
    when = {r[0]: r[2] for r in rows}
    assert all(r.gap_ns == max(when[b] - when[a] for a, b in zip(r.ids, r.ids[1:])) for r in got)


def test_every_batch_is_dealt_into_as_many_files(spark, tmp_path):
    from chainspan.catalog.streams import _stage

    folder = f"{tmp_path}/in"
    for k, rows in enumerate((500, 2, 0)):
        some = spark.range(rows).selectExpr("id", "'A' as event_code", "id as ts_ns", "'h' as computer")
        _stage(some, folder, 5, k)
        got = spark.read.schema(some.schema).parquet(folder)
        assert len(got.inputFiles()) == 5 * (k + 1)
    assert got.filter("ts_ns is not null").count() == 502
