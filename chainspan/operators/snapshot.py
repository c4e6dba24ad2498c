"""Snapshots of a graph by content, and what of one can be restored later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
APPLIED, MOVED, RECREATABLE, UNRESOLVED = "applied", "moved", "recreatable", "unresolved"
# --- end of fixed values ----------------------------------------------------

# Why an edge is not applied.
NO_LINK, NEITHER, NO_SOURCE, NO_TARGET = "edge missing", "both ends missing", "source missing", "target missing"


def take_snapshot(
    events: DataFrame, edges: DataFrame, nodes: DataFrame, graph_id: int, snapshot_id: str, label: str, at_ns: int
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one graph keyed by content hash. ``nodes(id)`` are the events shown; an edge with an end
    outside them is left out."""
    shown = events.join(nodes.select("id").distinct(), "id", "left_semi")
    stamp = [
        F.lit(snapshot_id).alias("snapshot_id"),
        F.lit(graph_id).cast("bigint").alias("graph_id"),
        F.lit(label).alias("label"),
        F.lit(at_ns).cast("bigint").alias("taken_ns"),
    ]
    text = F.concat_ws(" ", "event_code", F.col("computer"))
    n = shown.select(*stamp, "id", F.col("hash_normalized").alias("hash"), text.alias("descriptor"))
    h = shown.select("id", "hash_normalized")
    e = (
        edges.filter(F.col("graph_id") == graph_id)
        .drop("graph_id", "label_")
        .join(h.select(F.col("id").alias("src"), F.col("hash_normalized").alias("from_hash")), "src")
        .join(h.select(F.col("id").alias("dst"), F.col("hash_normalized").alias("to_hash")), "dst")
        .select(
            *stamp[:2],
            *stamp[3:],
            "edge_id",
            "from_hash",
            "to_hash",
            "relation_type",
            F.col("label").alias("edge_label"),
            "rule_id",
        )
    )
    return n, e


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder per snapshot; writing a snapshot again replaces it."""
    for df, name in ((nodes, "nodes"), (edges, "edges")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(
            f"{path}/{name}"
        )


def restore_plan(
    snap_nodes: DataFrame, snap_edges: DataFrame, events: DataFrame, edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """What a snapshot's nodes and edges are today.

    A node is applied (same event id), moved (same content under another id) or unresolved. An edge is applied when
    the edge of that id joins the same two events, recreatable when the events are there but the edge is not, and
    unresolved, with the reason, when an event is gone. Of several events with one hash the lowest id counts.
    """
    # Events without a hash get no live id here; a filter on the hash would have every hash computed twice.
    live = events.groupBy(F.col("hash_normalized").alias("hash")).agg(F.min(F.when(F.col("hash_normalized") != "", F.col("id"))).alias("live_id"))
    node_plan = snap_nodes.join(live, "hash", "left").withColumn(
        "outcome",
        F.when(F.col("live_id").isNull(), UNRESOLVED).when(F.col("live_id") != F.col("id"), MOVED).otherwise(APPLIED),
    )
    now = edges.select("edge_id", F.col("src").alias("now_src"), F.col("dst").alias("now_dst"))
    found = (
        snap_edges.join(live.select(F.col("hash").alias("from_hash"), F.col("live_id").alias("src")), "from_hash", "left")
        .join(live.select(F.col("hash").alias("to_hash"), F.col("live_id").alias("dst")), "to_hash", "left")
        .join(now, "edge_id", "left")
    )
    has_src, has_dst = F.col("src").isNotNull(), F.col("dst").isNotNull()
    same = (F.col("now_src") == F.col("src")) & (F.col("now_dst") == F.col("dst"))
    outcome = F.when(~has_src | ~has_dst, UNRESOLVED).when(F.coalesce(same, F.lit(False)), APPLIED).otherwise(RECREATABLE)
    reason = (
        F.when(~has_src & ~has_dst, NEITHER)
        .when(~has_src, NO_SOURCE)
        .when(~has_dst, NO_TARGET)
        .when(F.coalesce(same, F.lit(False)), "")
        .otherwise(NO_LINK)
    )
    both = has_src & has_dst
    edge_plan = found.select(
        *snap_edges.columns,
        F.when(both, F.col("src")).alias("src"),
        F.when(both, F.col("dst")).alias("dst"),
        outcome.alias("outcome"),
        reason.alias("reason"),
    )
    return node_plan.select(*snap_nodes.columns, "live_id", "outcome"), edge_plan


def reingested(node_plan: DataFrame) -> DataFrame:
    """One row: whether events of the snapshot came back under other ids."""
    return node_plan.agg((F.count_if(F.col("outcome") == MOVED) > 0).alias("reingested"))


def plan_counts(node_plan: DataFrame, edge_plan: DataFrame) -> DataFrame:
    """(item, outcome, n)."""
    n = node_plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("item"), "outcome", "n")
    e = edge_plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("item"), "outcome", "n")
    return n.unionByName(e)


def recreate_edges(edge_plan: DataFrame, chosen: DataFrame, snapshot_id: str, graph_id: int) -> DataFrame:
    """Changes for ``apply_edge_changes`` that bring back the chosen recreatable edges as the analyst's own."""
    picked = edge_plan.filter(F.col("outcome") == RECREATABLE).join(
        chosen.select("edge_id").distinct(), "edge_id", "left_semi"
    )
    return picked.select(
        F.lit("create").alias("op"),
        F.concat(F.lit("restored/"), F.lit(snapshot_id), F.lit("/"), F.col("edge_id")).alias("edge_id"),
        "src",
        "dst",
        F.lit(graph_id).cast("bigint").alias("graph_id"),
        "relation_type",
        F.col("edge_label").alias("label"),
        F.lit(0.0).alias("confidence"),
        F.lit("user").alias("created_by"),
        F.array(F.lit(f"restored from snapshot {snapshot_id}")).alias("basis"),
    )


def delete_snapshots(
    snap_nodes: DataFrame, snap_edges: DataFrame, snapshot_ids: DataFrame | None = None, graph_id: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the snapshots named, or without all of a graph."""
    if (snapshot_ids is None) == (graph_id is None):
        raise ValueError("name snapshots or a graph")
    if graph_id is not None:
        return tuple(df.filter(~F.col("graph_id").eqNullSafe(F.lit(graph_id))) for df in (snap_nodes, snap_edges))
    gone = snapshot_ids.select("snapshot_id").distinct()
    return tuple(df.join(gone, "snapshot_id", "left_anti").select(*df.columns) for df in (snap_nodes, snap_edges))


def list_snapshots(snap_nodes: DataFrame, snap_edges: DataFrame) -> DataFrame:
    """Newest first, with node and edge counts."""
    n = snap_nodes.groupBy("snapshot_id", "graph_id", "label", "taken_ns").agg(F.count(F.lit(1)).alias("nodes"))
    e = snap_edges.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("edges"))
    zero = F.coalesce("edges", F.lit(0).cast("bigint")).alias("edges")
    out = n.join(e, "snapshot_id", "left").select("snapshot_id", "graph_id", "label", "taken_ns", "nodes", zero)
    return out.orderBy(F.col("taken_ns").desc(), "snapshot_id")
