"""Time histograms, relation heatmaps and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspan import model
from chainspan.functions.text import trimmed
from chainspan.functions.times import whole_div
from chainspan.operators.edges import small_side
from chainspan.operators.graph import graph_membership
from chainspan.session import durable


class Bucketing:
    """Equal-width buckets over [lo, hi] in whole nanoseconds; the last one takes the remainder.

    A span too short to divide gives a single bucket.
    """

    def __init__(self, lo: int, hi: int, count: int):
        count = model.DEFAULT_BUCKETS if count <= 0 else count
        width = (hi - lo) // count if hi > lo else 0
        self.lo, self.hi = lo, hi
        self.count, self.width = (count, width) if width > 0 else (1, 1)

    def index(self, ns: Column) -> Column:
        """Bucket of a time at or after ``lo``; NULL before it."""
        if self.count == 1:
            return F.lit(0).cast("bigint")
        off = ns - F.lit(self.lo)
        return F.when(off >= 0, F.least(whole_div(off, self.width), F.lit(self.count - 1).cast("bigint")))

    def spine(self, spark) -> DataFrame:
        """One row per bucket: bucket, start_ns, end_ns."""
        b = F.col("bucket")
        last = b == self.count - 1
        end = F.when(last, F.lit(self.hi)).otherwise(F.lit(self.lo) + (b + 1) * self.width)
        return spark.range(self.count).select(
            F.col("id").alias("bucket")
        ).select("bucket", (F.lit(self.lo) + b * self.width).alias("start_ns"), end.cast("bigint").alias("end_ns"))


def extent(df: DataFrame, ns: str = "ts_ns") -> tuple[int | None, int | None, int, int]:
    """(earliest, latest, dated, undated): one row brought to the driver."""
    r = df.agg(F.min(ns), F.max(ns), F.count(ns), F.count_if(F.col(ns).isNull())).first()
    return r[0], r[1], r[2], r[3]


def _filled(spark, counts: DataFrame, buckets: Bucketing) -> DataFrame:
    zero = F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias("n")
    return buckets.spine(spark).join(small_side(counts, buckets.count), "bucket", "left").select("bucket", "start_ns", "end_ns", zero)


def lane_text(c: Column) -> Column:
    return F.when(trimmed(F.coalesce(c.cast("string"), F.lit(""))) == "", F.lit(model.LANE_NONE)).otherwise(c.cast("string"))


def fold_lanes(counts: DataFrame, top: int | None = model.MAX_LANES) -> DataFrame:
    """(lane, bucket, n) with all but the ``top`` largest lanes (ties by name) folded into one; None keeps all."""
    if top is None:
        return counts.select("lane", "bucket", "n")
    lanes = counts.groupBy("lane").agg(F.sum("n").alias("total"))
    keep = lanes.orderBy(F.col("total").desc(), "lane").limit(top).select("lane", F.lit(True).alias("kept"))
    keep = small_side(keep, top)
    lane = F.when(F.col("kept"), F.col("lane")).otherwise(model.LANE_OTHER)
    return (
        counts.join(keep, "lane", "left")
        .select(F.coalesce(lane, F.lit(model.LANE_OTHER)).alias("lane"), "bucket", "n")
        .groupBy("lane", "bucket")
        .agg(F.sum("n").alias("n"))
    )


LANE_COLUMNS = ("provider", "channel", "user", "computer")


def timeline(
    df: DataFrame,
    buckets: int = model.DEFAULT_BUCKETS,
    group_by: str = "",
    time_from: int | None = None,
    time_to: int | None = None,
    edges: DataFrame | None = None,
    top: int | None = model.MAX_LANES,
) -> DataFrame:
    """Histogram of filtered events. Without ``group_by``: (bucket, start_ns, end_ns, n), zero buckets included.

    With it: (lane, bucket, n), the ``top`` largest lanes and one for the rest (None: all lanes). ``graph`` lanes count an event once per
    graph it belongs to. ``time_from``/``time_to`` narrow the extent; the caller has filtered by them already.
    """
    spark = df.sparkSession
    lo, hi, dated, _ = extent(df)
    if not dated:
        empty = "bucket bigint, start_ns bigint, end_ns bigint, n bigint"
        return spark.createDataFrame([], "lane string, bucket bigint, n bigint" if group_by else empty)
    lo = max(lo, time_from) if time_from is not None else lo
    hi = min(hi, time_to) if time_to is not None else hi
    slices = Bucketing(lo, hi, buckets)
    placed = df.filter(F.col("ts_ns").isNotNull()).withColumn("bucket", slices.index(F.col("ts_ns")))
    placed = placed.filter(F.col("bucket").isNotNull())
    if not group_by:
        return _filled(spark, placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), slices)
    if group_by == "graph":
        if edges is None:
            raise ValueError("graph lanes need the edges table")
        lanes = placed.select("id", "bucket").join(graph_membership(edges), "id", "left")
        lane = F.coalesce(F.col("graph_id").cast("string"), F.lit(model.LANE_NONE))
    else:
        lanes = placed
        c = F.col(group_by) if group_by in LANE_COLUMNS else F.lit("")
        lane = F.when(F.coalesce(c, F.lit("")) == "", F.lit(model.LANE_NONE)).otherwise(c)
    return fold_lanes(lanes.groupBy(lane.alias("lane"), "bucket").agg(F.count(F.lit(1)).alias("n")), top)


def timeline_summary(df: DataFrame, time_from: int | None = None, time_to: int | None = None) -> DataFrame:
    """One row: from_ns, to_ns, dated, undated."""
    one = df.agg(
        F.min("ts_ns").alias("from_ns"),
        F.max("ts_ns").alias("to_ns"),
        F.count("ts_ns").alias("dated"),
        F.count_if(F.col("ts_ns").isNull()).alias("undated"),
    )
    lo = F.greatest("from_ns", F.lit(time_from)) if time_from is not None else F.col("from_ns")
    hi = F.least("to_ns", F.lit(time_to)) if time_to is not None else F.col("to_ns")
    return one.select(
        F.when(F.col("dated") > 0, lo).alias("from_ns"), F.when(F.col("dated") > 0, hi).alias("to_ns"), "dated", "undated"
    )


def place_edges(edges: DataFrame, df: DataFrame) -> DataFrame:
    """Edges with ``at_ns``, the later of their two times (NULL unless both ends are dated), and that end's computer."""
    when = df.filter(F.col("ts_ns").isNotNull()).select("id", "ts_ns", "computer")
    side = lambda p, on: when.select(
        F.col("id").alias(on), F.col("ts_ns").alias(p + "_ns"), F.col("computer").alias(p + "_host")
    )
    both = edges.join(side("a", "src"), "src", "left").join(side("b", "dst"), "dst", "left")
    later = F.col("b_ns") > F.col("a_ns")
    dated = F.col("a_ns").isNotNull() & F.col("b_ns").isNotNull()
    return both.withColumn("at_ns", F.when(dated, F.greatest("a_ns", "b_ns"))).withColumn(
        "anchor_host", F.when(later, F.col("b_host")).otherwise(F.col("a_host"))
    )


def _heat_lane(group_by: str) -> Column:
    step = F.when(
        (F.coalesce(F.col("rel_version"), F.lit(0)) == 0)
        | (F.coalesce(F.col("rule_id"), F.lit("")) == "")
        | (F.col("algorithm") == "lineage"),
        F.lit(model.LANE_NONE),
    ).otherwise(F.concat(F.lit("step "), (F.col("step_index") + 1).cast("string")))
    if group_by == "step":
        return step
    return lane_text(
        F.col({"rule": "rule_id", "relation_type": "relation_type", "created_by": "created_by", "computer": "anchor_host"}[group_by])
    )


def relation_heatmap(
    edges: DataFrame,
    df: DataFrame,
    buckets: int = model.DEFAULT_BUCKETS,
    group_by: str = "rule",
    graph_id: int | None = None,
    time_from: int | None = None,
    time_to: int | None = None,
    top: int | None = model.MAX_LANES,
) -> tuple[DataFrame, DataFrame]:
    """((lane, bucket, n), one-row summary: total, placed, undated, outside, max_cell)."""
    group_by = group_by or "rule"
    if group_by not in model.HEATMAP_GROUPS:
        raise ValueError(f"unknown grouping {group_by!r}; one of {', '.join(model.HEATMAP_GROUPS)}")
    spark = df.sparkSession
    if graph_id:
        edges = edges.filter(F.col("graph_id") == graph_id)
    at = F.col("at_ns")
    outside = F.lit(False)
    if time_from is not None:
        outside = outside | (at < time_from)
    if time_to is not None:
        outside = outside | (at > time_to)
    # Written once, three narrow columns: the extent and the cells both come from it, so the joins run once.
    placed = durable(place_edges(edges, df).select(at, _heat_lane(group_by).alias("lane"), outside.alias("outside")))
    inside = at.isNotNull() & ~F.col("outside")
    r = placed.agg(
        F.count(F.lit(1)),
        F.count_if(at.isNull()),
        F.count_if(at.isNotNull() & F.col("outside")),
        F.min(F.when(inside, at)),
        F.max(F.when(inside, at)),
    ).first()
    total, undated, beyond, lo, hi = r
    shape = "total bigint, placed bigint, undated bigint, outside bigint"
    summary = spark.createDataFrame([(total, total - undated - beyond, undated, beyond)], shape)
    if lo is None:
        cells = spark.createDataFrame([], "lane string, bucket bigint, n bigint")
    else:
        slices = Bucketing(
            time_from if time_from is not None else lo, time_to if time_to is not None else hi, buckets
        )
        counts = placed.filter(inside).groupBy("lane", slices.index(at).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        cells = fold_lanes(counts.filter(F.col("bucket").isNotNull()), top)
    most = cells.agg(F.coalesce(F.max("n"), F.lit(0).cast("bigint")).alias("max_cell"))
    return cells, summary.join(F.broadcast(most), how="left")


def replay_schedule(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key, at_ns, approximate): when every node and edge appears; NULL means from the start.

    An edge appears with its later end. With one undated end it appears with the dated one and is approximate; with
    two it is there from the start, approximately. Edges with an end outside the nodes do not appear.
    """
    when = nodes.select("id", "ts_ns")
    n = nodes.select(
        F.lit("node").alias("kind"), F.col("id").cast("string").alias("key"), F.col("ts_ns").alias("at_ns"), F.lit(False).alias("approximate")
    )
    both = edges.join(when.select(F.col("id").alias("src"), F.col("ts_ns").alias("a")), "src").join(
        when.select(F.col("id").alias("dst"), F.col("ts_ns").alias("b")), "dst"
    )
    e = both.select(
        F.lit("edge").alias("kind"),
        F.col("edge_id").alias("key"),
        F.greatest("a", "b").alias("at_ns"),  # greatest skips NULLs
        (F.col("a").isNull() | F.col("b").isNull()).alias("approximate"),
    )
    return n.unionByName(e)


def replay_at(schedule: DataFrame, t: int) -> DataFrame:
    return schedule.filter(F.col("at_ns").isNull() | (F.col("at_ns") <= t))


def replay_summary(schedule: DataFrame) -> DataFrame:
    node = F.col("kind") == "node"
    return schedule.agg(
        F.min(F.when(node, F.col("at_ns"))).alias("from_ns"),
        F.max(F.when(node, F.col("at_ns"))).alias("to_ns"),
        F.count_if(node & F.col("at_ns").isNotNull()).alias("dated"),
        F.count_if(node).alias("total"),
        F.count_if(node & F.col("at_ns").isNull()).alias("undated"),
        F.count_if((~node) & F.col("approximate")).alias("approximate"),
    )
