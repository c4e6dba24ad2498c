"""Edge-table queries and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspan.operators.layout import ordered_layout, running_position
from chainspan import model
from chainspan.functions.text import trimmed


def edges_by(
    edges: DataFrame, graph_id: int | None = None, rule_id: str | None = None, created_by: str | None = None
) -> DataFrame:
    """Edges of a graph, a rule or a creator. A blank rule id names no rule, so it selects nothing."""
    if graph_id is not None:
        edges = edges.filter(F.col("graph_id") == graph_id)
    if rule_id is not None:
        edges = edges.filter((F.col("rule_id") == rule_id) & (F.lit(rule_id) != ""))
    if created_by is not None:
        edges = edges.filter(F.col("created_by") == created_by)
    return edges


def endpoints(edges: DataFrame, *carry: str) -> DataFrame:
    """(id, other, ...): one row per end of an edge; a self-edge has one."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("id"), F.col("src").alias("other")),
    )
    once = F.when(F.col("src") == F.col("dst"), F.slice(ends, 1, 1)).otherwise(ends)
    return edges.select(F.explode(once).alias("e"), *carry).select("e.id", "e.other", *carry)


def incident_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ``ids``, each once: two key joins rather than one join on "or"."""
    ids = ids.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    into = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    into = into.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    return out.select(*edges.columns).unionByName(into.select(*edges.columns))


def adjacency(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per event with edges: edges, distinct types and neighbours (itself excluded), system and analyst edges.

    Neighbours are counted from (event, neighbour) totals, so an event that touches a third of all edges costs no
    single task its whole neighbour list; ``neighbours_of`` gives the list as rows.
    """
    ends = endpoints(edges, "relation_type", "created_by")
    if ids is not None:
        ends = ends.join(ids.select("id").distinct(), "id", "left_semi")
    per = ends.groupBy("id", "other").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("created_by") == "system").alias("s"),
        # Relation types come from a fixed set of three, so the set stays small.
        F.collect_set(F.when(F.col("relation_type") != "", F.col("relation_type"))).alias("t"),
    )
    return per.groupBy("id").agg(
        F.sum("n").alias("edge_count"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("t")))), ",").alias("types"),
        F.count_if(F.col("id") != F.col("other")).alias("neighbours"),
        F.sum("s").alias("system_count"),
        F.sum(F.col("n") - F.col("s")).alias("user_count"),
    )


def neighbours_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    ends = endpoints(edges).filter(F.col("id") != F.col("other")).distinct()
    return ends.join(ids.select("id").distinct(), "id", "left_semi").withColumnRenamed("other", "neighbour")


def inspect_edges(edges: DataFrame, events: DataFrame, graphs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen edges with both events, the graph name, the other edges of the same match, and whether provenance exists.

    A match has at most as many edges as its rule has steps, so its siblings fit in one row.
    """
    picked = edges.join(chosen.select("edge_id").distinct(), "edge_id", "left_semi")
    named = graphs.select("graph_id", F.col("name").alias("graph_name"))
    brief = lambda p, on: events.select(
        F.col("id").alias(on),
        F.col("event_code").alias(p + "_code"),
        F.col("ts_ns").alias(p + "_ts_ns"),
        F.col("computer").alias(p + "_computer"),
    )
    tracked = edges.filter((F.col("rule_id") != "") & (F.col("match_id") != ""))
    tracked = tracked.join(picked.select("rule_id", "match_id").distinct(), ["rule_id", "match_id"], "left_semi")
    family = tracked.groupBy("rule_id", "match_id").agg(F.array_sort(F.collect_list("edge_id")).alias("_family"))
    return (
        picked.join(brief("from", "src"), "src", "left")
        .join(brief("to", "dst"), "dst", "left")
        .join(named, "graph_id", "left")
        .join(family, ["rule_id", "match_id"], "left")
        .withColumn("siblings", F.coalesce(F.array_remove("_family", F.col("edge_id")), F.array().cast("array<string>")))
        .withColumn("recorded", F.col("rel_version") > 0)
        .withColumn("graph_name", F.coalesce("graph_name", F.lit("")))
        .drop("_family")
    )


def graph_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))


def dangling_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges with an end that is not an event. The missing ids are found first, once each."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    missing = ends.join(events.select("id"), "id", "left_anti")
    return incident_edges(edges, missing)


def graph_membership(edges: DataFrame) -> DataFrame:
    """(id, graph_id): the graphs an event has an edge in; graph 0 is "no graph"."""
    inside = edges.filter(F.coalesce(F.col("graph_id"), F.lit(0)) != 0)
    return inside.select(F.explode(F.array("src", "dst")).alias("id"), "graph_id").distinct()


def order_clusters(clusters: DataFrame) -> DataFrame:
    """Largest first, then label, then id."""
    return clusters.orderBy(F.col("size").desc(), "label", "cluster_id")


def place_clusters(clusters: DataFrame) -> DataFrame:
    """``clusters`` with the place of each in the order of ``order_clusters``, from 1; in no order itself."""
    keyed = clusters.withColumn("_less", -F.col("size"))
    layout = ordered_layout(keyed, [], ["_less", "label", "cluster_id"], [c for c in clusters.columns if c not in ("label", "cluster_id")])
    return running_position(layout).select(*clusters.columns, (F.col("position") + 1).alias("place"))


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id", "label").agg(F.count(F.lit(1)).alias("size"))


def rule_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, label, id): events by the rules whose edges touch them, overlapping; the rest in one cluster.

    Events and ends of edges meet in one grouping by id rather than in joins, each of which would hold all ids of a task
    once more. An event gathers at most as many values as there are rules.
    """
    touched = edges.filter(F.coalesce(F.col("rule_id"), F.lit("")) != "").select(
        F.explode(F.array("src", "dst")).alias("id"), "rule_id"
    )
    marks = nodes.select("id", F.lit(None).cast("string").alias("rule_id")).unionByName(touched.filter("id is not null"))
    found = marks.groupBy("id").agg(F.collect_set("rule_id").alias("rules"), F.bool_or(F.col("rule_id").isNull()).alias("known"))
    by_rule = found.filter("known").select("id", F.explode_outer("rules").alias("rule_id"))
    return by_rule.select(
        F.coalesce(F.concat(F.lit("rule-"), F.col("rule_id")), F.lit("rule-none")).alias("cluster_id"),
        F.coalesce("rule_id", F.lit(model.NO_RULE_LABEL)).alias("label"),
        "id",
    )


def slot_clusters(nodes: DataFrame, slot: str) -> DataFrame:
    """(cluster_id, label, id): events by slot value; those without one share a cluster that claims no relation."""
    v = F.col(slot if slot in model.SLOTS else model.SLOTS[0])
    return nodes.select(
        F.when(v.isNotNull(), F.concat(F.lit("slot-"), v)).otherwise("slot-absent").alias("cluster_id"),
        F.coalesce(v, F.lit(model.ABSENT_SLOT_LABEL)).alias("label"),
        "id",
    ).distinct()


def slot_groups(nodes: DataFrame, slot: str) -> DataFrame:
    """Slot values by their earliest event, values with only undated events next, events without a value last."""
    v = F.col(slot)
    return (
        nodes.groupBy(v.alias("value"))
        .agg(F.min("ts_ns").alias("first_ns"), F.count(F.lit(1)).alias("size"))
        .withColumn("label", F.coalesce("value", F.lit(model.ABSENT_SLOT_LABEL)))
        .orderBy(F.col("value").isNull(), F.col("first_ns").asc_nulls_last(), "value")
    )


def delete_events(events: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove events and every edge that has an end among them."""
    gone = ids.select("id").distinct()
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return events.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def delete_graph(edges: DataFrame, graphs: DataFrame, graph_id: int) -> tuple[DataFrame, DataFrame]:
    """Edges and registry without a graph; its snapshots go by ``snapshot.delete_snapshots(graph_id=...)``."""
    return (
        edges.filter(~F.col("graph_id").eqNullSafe(F.lit(graph_id))),
        graphs.filter(F.col("graph_id") != graph_id),
    )


def assign_graph(edges: DataFrame, graph_id: int) -> DataFrame:
    """Put edges that are in no graph into ``graph_id``."""
    none = F.coalesce(F.col("graph_id"), F.lit(0)) == 0
    return edges.withColumn("graph_id", F.when(none, F.lit(graph_id).cast("bigint")).otherwise(F.col("graph_id")))


def _known_type(c: Column) -> Column:
    return F.when(c.isin(*model.RELATION_TYPES), c).otherwise("default")


def apply_edge_changes(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply analyst changes ``(op, edge_id, src, dst, graph_id, relation_type, label, confidence, created_by, basis)``.

    ``create`` appends; ``update`` sets type, label and, unless it is zero, confidence; ``delete`` removes. One change
    per edge id; changes to unknown edges are ignored.
    """
    made = changes.filter("op = 'create'").select(
        "edge_id",
        "src",
        "dst",
        "graph_id",
        _known_type(F.col("relation_type")).alias("relation_type"),
        trimmed(F.coalesce("label", F.lit(""))).alias("label"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("created_by") == "system", "system").otherwise("user").alias("created_by"),
        F.lit("").alias("rule_id"),
        F.lit("").alias("algorithm"),
        F.lit("").alias("match_id"),
        F.lit(0).alias("step_index"),
        "basis",
        F.lit(0).alias("rel_version"),
    )
    other = changes.filter("op in ('update', 'delete')").select(
        "edge_id",
        F.col("op").alias("_op"),
        F.col("relation_type").alias("_type"),
        F.col("label").alias("_label"),
        F.col("confidence").alias("_conf"),
    )
    upd = F.col("_op") == "update"
    kept = (
        edges.join(other, "edge_id", "left")
        .filter(F.col("_op").isNull() | upd)
        .withColumn("relation_type", F.when(upd, _known_type(F.col("_type"))).otherwise(F.col("relation_type")))
        .withColumn("label", F.when(upd, trimmed(F.coalesce("_label", F.lit("")))).otherwise(F.col("label")))
        .withColumn(
            "confidence",
            F.when(upd & (F.coalesce(F.col("_conf"), F.lit(0.0)) != 0), F.col("_conf")).otherwise(F.col("confidence")),
        )
        .select(*edges.columns)
    )
    return kept.unionByName(made)


def ensure_graphs(graphs: DataFrame | None, rules: DataFrame) -> DataFrame:
    """The graph table after making sure every rule has a graph.

    A rule keeps the graph that carries its id; otherwise it adopts the oldest unclaimed graph of its name; otherwise
    it gets a new id above all others, in rule order.
    """
    wanted = rules.select("rule_ix", "rule_id", "name").dropDuplicates(["rule_id"])
    # Rules and graphs are registries of a case, not data: numbering the new ones in one task is all they need.
    by_rule = F.row_number().over(Window.orderBy("rule_ix"))
    if graphs is None:
        return wanted.select(by_rule.cast("bigint").alias("graph_id"), "rule_id", "name")
    graphs = graphs.select("graph_id", F.coalesce("rule_id", F.lit("")).alias("rule_id"), "name")
    open_rules = wanted.join(graphs.select("rule_id"), "rule_id", "left_anti")
    unclaimed = graphs.filter("rule_id = ''").groupBy("name").agg(F.min("graph_id").alias("graph_id"))
    # One graph can be adopted once: the first rule of that name gets it.
    by_name = open_rules.groupBy("name").agg(F.min_by("rule_id", "rule_ix").alias("new_rule"))
    adopted = by_name.join(unclaimed, "name").select("graph_id", "new_rule")
    kept = graphs.join(adopted, "graph_id", "left").select(
        "graph_id", F.coalesce("new_rule", "rule_id").alias("rule_id"), "name"
    )
    rest = open_rules.join(adopted.select(F.col("new_rule").alias("rule_id")), "rule_id", "left_anti")
    top = graphs.agg(F.coalesce(F.max("graph_id"), F.lit(0)).alias("top"))
    new = rest.join(F.broadcast(top), how="left").select((by_rule + F.col("top")).alias("graph_id"), "rule_id", "name")
    return kept.unionByName(new)
