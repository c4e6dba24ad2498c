"""Edge tables, clusters and iterative graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspan import model
from chainspan.catalog.frames import (
    BUYS,
    RULES,
    WITH_CANON,
    WITH_EDGES,
    canon,
    edges,
    graphs,
)
from chainspan.catalog.registry import query
from chainspan.operators import components as c
from chainspan.operators import graph as g
from chainspan.plans.rules import Rule, rules_frame

_FLAT = "edge_id, src, dst, graph_id, relation_type, label, confidence, created_by, rule_id, algorithm, match_id, step_index, basis, rel_version"


def _flat(df):
    return df.select(*[F.array_join("basis", ";").alias("basis") if x == "basis" else F.col(x) for x in model.EDGE_COLUMNS])


@query("edges", WITH_EDGES + f"SELECT {_FLAT} FROM edges")
def all_edges(spark, sf):
    return _flat(edges(spark, sf))


@query("edges_by_graph", WITH_EDGES + "SELECT edge_id FROM edges WHERE graph_id = 2")
def by_graph(spark, sf):
    return g.edges_by(edges(spark, sf), graph_id=2).select("edge_id")


@query("edges_by_rule", WITH_EDGES + "SELECT edge_id FROM edges WHERE rule_id = 'error-then-purchase'")
def by_rule(spark, sf):
    made = edges(spark, sf)
    return g.edges_by(made, rule_id=BUYS.rule_id).unionByName(g.edges_by(made, rule_id="")).select("edge_id")


@query("edges_by_creator", WITH_EDGES + "SELECT edge_id FROM edges WHERE created_by = 'user'")
def by_creator(spark, sf):
    return g.edges_by(edges(spark, sf), created_by="user").select("edge_id")


_BIG = "SELECT id FROM canon WHERE value > 40"


@query("incident_edges", WITH_EDGES + f"SELECT edge_id FROM edges WHERE src IN ({_BIG}) OR dst IN ({_BIG})")
def incident(spark, sf):
    return g.incident_edges(edges(spark, sf), canon(spark, sf).filter("value > 40")).select("edge_id")


@query(
    "adjacency",
    WITH_EDGES + """, ends AS (SELECT src AS id, dst AS other, relation_type, created_by FROM edges
                     UNION ALL SELECT dst, src, relation_type, created_by FROM edges WHERE src <> dst)
      SELECT id, count(*) AS edge_count, array_to_string(list_sort(list(DISTINCT relation_type)), ',') AS types,
        count(DISTINCT other) FILTER (other <> id) AS neighbours, count(*) FILTER (created_by = 'system') AS system_count,
        count(*) FILTER (created_by <> 'system') AS user_count FROM ends GROUP BY id""",
)
def adjacent(spark, sf):
    return g.adjacency(edges(spark, sf))


@query(
    "inspect_edges",
    WITH_EDGES + """SELECT e.edge_id, a.event_code AS from_code, a.computer AS from_computer, b.event_code AS to_code, b.ts_ns AS to_ts_ns, gr.name AS graph_name,
        coalesce((SELECT string_agg(s.edge_id, ';' ORDER BY s.edge_id) FROM edges s WHERE s.rule_id = e.rule_id AND s.match_id = e.match_id
           AND s.edge_id <> e.edge_id AND s.rule_id <> ''), '') AS siblings, CAST(rel_version > 0 AS INT) AS recorded
      FROM edges e JOIN canon a ON a.id = src JOIN canon b ON b.id = dst LEFT JOIN graphs gr USING (graph_id)""",
)
def inspected(spark, sf):
    out = g.inspect_edges(edges(spark, sf), canon(spark, sf), graphs(spark), edges(spark, sf))
    return out.select(
        "edge_id", "from_code", "from_computer", "to_code", "to_ts_ns", "graph_name",
        F.array_join("siblings", ";").alias("siblings"), F.col("recorded").cast("int").alias("recorded"),
    )


@query("graph_counts", WITH_EDGES + "SELECT graph_id, count(*) AS edges FROM edges GROUP BY 1")
def counts(spark, sf):
    return g.graph_counts(edges(spark, sf))


@query(
    "dangling_edges",
    WITH_EDGES + """, live AS (SELECT id FROM canon WHERE event_code <> 'view' OR value < 50)
      SELECT edge_id FROM edges WHERE src NOT IN (SELECT id FROM live) OR dst NOT IN (SELECT id FROM live)""",
)
def dangling(spark, sf):
    return g.dangling_edges(edges(spark, sf), canon(spark, sf).filter("event_code <> 'view' OR value < 50")).select("edge_id")


_NODES = "nodes AS (SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges UNION ALL SELECT id FROM canon WHERE event_code = 'purchase'))"


def _nodes(spark, sf):
    """Every end of an edge, and all purchases, linked or not. Only what is no purchase has to be looked up."""
    events = canon(spark, sf).filter("id is not null")
    ends = edges(spark, sf).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    bought = F.col("event_code").eqNullSafe(F.lit("purchase"))
    return events.filter(bought).unionByName(events.filter(~bought).join(ends, "id", "left_semi"))


@query(
    "connected_components",
    WITH_EDGES + f""", {_NODES}, links AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
      reach(id, r) AS (SELECT id, id FROM nodes UNION SELECT b, r FROM reach JOIN links ON a = id AND r < b)
      SELECT id, min(r) AS component FROM reach GROUP BY id""",
)
def connected(spark, sf):
    return c.connected_components(_nodes(spark, sf), edges(spark, sf))


@query(
    "component_clusters",
    WITH_EDGES + f""", {_NODES}, links AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
      reach(id, r) AS (SELECT id, id FROM nodes UNION SELECT b, r FROM reach JOIN links ON a = id AND r < b),
      comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)
      SELECT 'component-' || component AS cluster_id, 'Group of ' || count(*) AS label, count(*) AS size FROM comp GROUP BY component""",
)
def component_table(spark, sf):
    return g.order_clusters(c.component_clusters(_nodes(spark, sf), edges(spark, sf)))


@query(
    "rule_clusters",
    WITH_EDGES + f""", {_NODES}, t AS (SELECT DISTINCT rule_id, id FROM (SELECT rule_id, src AS id FROM edges UNION ALL SELECT rule_id, dst FROM edges) WHERE rule_id <> '')
      SELECT 'rule-' || rule_id AS cluster_id, rule_id AS label, id FROM t
      UNION ALL SELECT 'rule-none', 'Not from a rule', id FROM nodes WHERE id NOT IN (SELECT id FROM t)""",
)
def by_rules(spark, sf):
    return g.rule_clusters(_nodes(spark, sf), edges(spark, sf))


@query(
    "slot_clusters",
    WITH_CANON + "SELECT coalesce('slot-' || logon_id, 'slot-absent') AS cluster_id, coalesce(logon_id, 'Not recorded') AS label, id FROM canon",
)
def by_slot(spark, sf):
    return g.slot_clusters(canon(spark, sf), "logon_id")


@query(
    "order_clusters",
    WITH_CANON + """, s AS (SELECT coalesce('slot-' || target_user, 'slot-absent') AS cluster_id, coalesce(target_user, 'Not recorded') AS label, count(*) AS size FROM canon GROUP BY ALL)
      SELECT *, row_number() OVER (ORDER BY size DESC, label, cluster_id) AS place FROM s""",
)
def cluster_order(spark, sf):
    return g.place_clusters(g.cluster_sizes(g.slot_clusters(canon(spark, sf), "target_user")))


@query("graph_membership", WITH_EDGES + "SELECT src AS id, graph_id FROM edges UNION SELECT dst, graph_id FROM edges")
def membership(spark, sf):
    return g.graph_membership(edges(spark, sf))


@query(
    "delete_events",
    WITH_EDGES + """, gone AS (SELECT id FROM canon WHERE value > 60)
      SELECT 'event' AS kind, CAST(id AS VARCHAR) AS key FROM canon WHERE id NOT IN (SELECT id FROM gone)
      UNION ALL SELECT 'edge', edge_id FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)""",
)
def deleted(spark, sf):
    ev = canon(spark, sf)
    left, kept = g.delete_events(ev, edges(spark, sf), ev.filter("value > 60"))
    return left.select(F.lit("event").alias("kind"), F.col("id").cast("string").alias("key")).unionByName(
        kept.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("key"))
    )


@query(
    "delete_graph",
    WITH_EDGES + """SELECT 'edge' AS kind, edge_id AS key FROM edges WHERE graph_id <> 1
      UNION ALL SELECT 'graph', name FROM graphs WHERE graph_id <> 1""",
)
def graph_deleted(spark, sf):
    kept, left = g.delete_graph(edges(spark, sf), graphs(spark), 1)
    return kept.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("key")).unionByName(
        left.select(F.lit("graph").alias("kind"), F.col("name").alias("key"))
    )


@query("assign_graph", WITH_EDGES + "SELECT edge_id, CAST(CASE graph_id WHEN 3 THEN 9 ELSE graph_id END AS BIGINT) AS graph_id FROM edges")
def assigned(spark, sf):
    made = edges(spark, sf)
    loose = made.withColumn("graph_id", F.when(F.col("graph_id") != 3, F.col("graph_id")))
    return g.assign_graph(loose, 9).select("edge_id", "graph_id")


@query(
    "apply_edge_changes",
    WITH_EDGES + """SELECT edge_id, src, dst, graph_id, CASE created_by WHEN 'user' THEN 'temporal' ELSE relation_type END AS relation_type,
        CASE created_by WHEN 'user' THEN 'checked' ELSE label END AS label,
        CASE WHEN created_by = 'user' AND src % 2 = 1 THEN CAST(0.75 AS DOUBLE) ELSE confidence END AS confidence, created_by
      FROM edges WHERE graph_id <> 2
      UNION ALL SELECT 'new/' || id, id, id, 3, 'default', 'odd one', 0.0, 'user' FROM canon WHERE event_code = 'error' AND ts_ns IS NULL""",
)
def changed(spark, sf):
    """Analyst edges are updated, graph 2's are deleted, undated errors get a new one each."""
    made, ev = edges(spark, sf), canon(spark, sf)
    none = F.lit(None)
    upd = made.filter("graph_id <> 1").select(
        F.when(F.col("graph_id") == 2, "delete").otherwise("update").alias("op"),
        "edge_id", "src", "dst", "graph_id",
        F.lit("temporal").alias("relation_type"), F.lit(" checked ").alias("label"),
        F.when(F.col("src") % 2 == 1, 0.75).otherwise(0.0).alias("confidence"),
        none.cast("string").alias("created_by"), none.cast("array<string>").alias("basis"),
    )
    new = ev.filter("event_code = 'error' AND ts_ns IS NULL").select(
        F.lit("create").alias("op"),
        F.concat(F.lit("new/"), F.col("id")).alias("edge_id"), F.col("id").alias("src"), F.col("id").alias("dst"),
        F.lit(3).cast("bigint").alias("graph_id"), F.lit("whatever").alias("relation_type"), F.lit("odd one").alias("label"),
        F.lit(0.0).alias("confidence"), F.lit("").alias("created_by"), none.cast("array<string>").alias("basis"),
    )
    out = g.apply_edge_changes(made, upd.unionByName(new))
    return out.select("edge_id", "src", "dst", "graph_id", "relation_type", "label", "confidence", "created_by")


@query(
    "step_rank",
    WITH_EDGES + f""", {_NODES}, e AS (SELECT DISTINCT src, dst FROM edges),
      p(id, r) AS (SELECT id, 0 FROM nodes UNION SELECT dst, r + 1 FROM p JOIN e ON src = id)
      SELECT id, max(r) AS rank FROM p GROUP BY id""",
)
def ranks(spark, sf):
    return c.step_rank(_nodes(spark, sf), edges(spark, sf)).select("id", "rank")


@query(
    "tree_depth",
    WITH_EDGES + f""", {_NODES}, up AS (
        SELECT dst AS id, arg_min(src, struct_pack(u := c.ts_ns IS NULL, t := coalesce(c.ts_ns, 0), i := src)) AS parent
        FROM edges JOIN canon c ON c.id = src WHERE src <> dst GROUP BY dst),
      w(id, cur, d) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT w.id, parent, d + 1 FROM w JOIN up ON up.id = cur)
      SELECT id, arg_max(cur, d) AS root, max(d) AS depth FROM w GROUP BY id""",
)
def depths(spark, sf):
    return c.tree_depth(_nodes(spark, sf), edges(spark, sf))


@query(
    "slot_groups",
    WITH_CANON + """, s AS (SELECT logon_id AS value, min(ts_ns) AS first_ns, count(*) AS size FROM canon GROUP BY 1)
      SELECT coalesce(value, 'Not recorded') AS label, first_ns, size FROM s""",
)
def groups(spark, sf):
    return g.slot_groups(canon(spark, sf), "logon_id").select("label", "first_ns", "size")


@query(
    "ensure_graphs",
    WITH_CANON + """, old AS (SELECT row_number() OVER (ORDER BY p) AS graph_id, p AS name FROM (SELECT DISTINCT provider AS p FROM canon)),
      want AS (SELECT row_number() OVER (ORDER BY name) AS o, name FROM (SELECT 'P-1' AS name UNION SELECT DISTINCT event_code FROM canon))
      SELECT graph_id, CASE name WHEN 'P-1' THEN 'p-1' ELSE '' END AS rule_id, name FROM old
      UNION ALL SELECT (SELECT max(graph_id) FROM old) + row_number() OVER (ORDER BY o), name, name FROM want WHERE name <> 'P-1'""",
)
def ensured(spark, sf):
    """One rule per event code, and one whose graph already exists under its name but has no rule yet."""
    from chainspan.operators.layout import ordered_layout, running_position

    ev = canon(spark, sf)
    names = running_position(ordered_layout(ev.select("provider").distinct(), [], ["provider"]))
    old = names.select((F.col("position") + 1).alias("graph_id"), F.lit("").alias("rule_id"), F.col("provider").alias("name"))
    codes = sorted(["P-1"] + [r.event_code for r in ev.select("event_code").distinct().collect()])
    return g.ensure_graphs(old, rules_frame(spark, [Rule(x, ("a", "b")) for x in codes]))
