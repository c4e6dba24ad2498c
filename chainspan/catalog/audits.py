"""Findings, snapshots, integrity and rule checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspan import model
from chainspan.catalog.frames import (
    CANON, EDGES, FINDINGS, GRAPHS, RULES, WITH_CANON, WITH_EDGES, WITH_FINDINGS, canon, edges, findings, graphs, table,
)
from chainspan.catalog.registry import query
from chainspan.functions import normalize_tags
from chainspan.operators import audit as a
from chainspan.operators import findings as f
from chainspan.operators import snapshot as s
from chainspan.operators.graph import apply_edge_changes
from chainspan.plans import checks
from chainspan.plans.rules import Rule
from chainspan.session import written

NOW = 1_720_000_000_000_000_000


def _changes(ev):
    """New values for every error finding and every second signup; some are emptied, some keys are blank."""
    k = F.col("k")
    live = (F.col("event_code") == "signup") & F.col("ts_ns").isNotNull() & (k % 2 == 0)
    fresh = (F.col("event_code") == "view") & F.col("ts_ns").isNotNull()
    return ev.filter(live | fresh).select(
        F.when(k % 10 == 4, "  ").otherwise(F.concat(F.lit(" "), F.col("hash_normalized"))).alias("key"),
        (k % 3 == 1).alias("flagged"),
        F.when(k % 3 == 2, F.array(F.lit(" B "), F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.lit("").alias("note"),
        F.when(k % 4 == 0, "changed").otherwise("").alias("descriptor"),
    )


@query(
    "upsert_findings",
    WITH_FINDINGS + f""", ch AS (SELECT hash_normalized AS key, k % 3 = 1 AS flagged, CASE WHEN k % 3 = 2 THEN 'a;b' ELSE '' END AS tags, CASE WHEN k % 4 = 0 THEN 'changed' ELSE '' END AS descriptor
        FROM canon WHERE ts_ns IS NOT NULL AND k % 10 <> 4 AND ((event_code = 'signup' AND k % 2 = 0) OR event_code = 'view'))
      SELECT key, CAST(CASE WHEN c.key IS NULL THEN o.flagged ELSE c.flagged END AS INT) AS flagged,
        CASE WHEN c.key IS NULL THEN array_to_string(o.tags, ';') ELSE c.tags END AS tags,
        CASE WHEN c.key IS NULL THEN o.note ELSE '' END AS note,
        CASE WHEN c.key IS NOT NULL AND c.descriptor <> '' THEN c.descriptor ELSE coalesce(o.descriptor, '') END AS descriptor,
        coalesce(created_ns, {NOW}) AS created_ns, CASE WHEN c.key IS NULL THEN updated_ns ELSE {NOW} END AS updated_ns
      FROM findings o FULL JOIN ch c USING (key) WHERE c.key IS NULL OR c.flagged OR c.tags <> ''""",
)
def upserted(spark, sf):
    ev = canon(spark, sf)
    out, _ = f.upsert_findings(findings(ev), _changes(ev), NOW)
    return out.withColumn("flagged", F.col("flagged").cast("int")).withColumn("tags", F.array_join("tags", ";"))


@query(
    "normalize_tags",
    """SELECT doc_id, array_to_string(list_sort(list_distinct_ordered), ';') AS tags FROM (
         SELECT doc_id, list_distinct(w) AS list_distinct_ordered FROM (
           SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: lower(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8203)))), lambda x: x <> '') AS w
           FROM documents))""",
)
def tags(spark, sf):
    """The words of every document as its tags."""
    out = normalize_tags(F.split("text", " "))
    return table(spark, sf, "documents").select("doc_id", F.array_join(out, ";").alias("tags"))


@query(
    "finding_keys",
    WITH_FINDINGS + """SELECT 'flagged' AS state, key FROM findings WHERE flagged UNION ALL SELECT 'noted', key FROM findings WHERE note <> ''
      UNION ALL SELECT 'annotated', key FROM findings UNION ALL SELECT 'tag', key FROM findings WHERE list_contains(tags, 'host-4')""",
)
def keys(spark, sf):
    notes = findings(canon(spark, sf))
    out = f.keys_with_tag(notes, "HOST-4 ").select(F.lit("tag").alias("state"), "key")
    for state in ("flagged", "noted", "annotated"):
        out = out.unionByName(f.finding_keys(notes, state).select(F.lit(state).alias("state"), "key"))
    return out


@query("tag_counts", WITH_FINDINGS + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM findings) GROUP BY 1")
def tag_totals(spark, sf):
    return f.tag_counts(findings(canon(spark, sf)))


@query(
    "finding_stats",
    WITH_FINDINGS + """SELECT count(*) AS total, count(*) FILTER (flagged) AS flagged, count(*) FILTER (note <> '') AS noted,
      count(*) FILTER (len(tags) > 0) AS tagged FROM findings""",
)
def stats(spark, sf):
    return f.finding_stats(findings(canon(spark, sf)))


@query("list_findings", WITH_FINDINGS + "SELECT key, updated_ns FROM findings JOIN (SELECT hash_normalized AS key FROM canon WHERE k > 50) USING (key)")
def listed(spark, sf):
    ev = canon(spark, sf)
    return f.list_findings(findings(ev), ev.filter("k > 50").select(F.col("hash_normalized").alias("key"))).select("key", "updated_ns")


@query(
    "audit_findings",
    WITH_FINDINGS + """SELECT key, 'orphan' AS problem FROM findings WHERE key NOT IN (SELECT hash_normalized FROM canon)
      UNION ALL SELECT key, 'stale' FROM findings""",
)
def audited(spark, sf):
    ev = canon(spark, sf)
    notes = findings(ev)
    return f.audit_findings(notes, ev, 2, 2).unionByName(f.audit_findings(notes, ev, 1, 2))


@query("annotation_hashes", WITH_CANON + "SELECT DISTINCT hash_normalized AS key FROM canon WHERE event_code IN ('error', 'view')")
def anchors(spark, sf):
    h = F.col("hash_normalized")
    at = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("hash"))
    kind = F.when(F.col("event_code").isin("error", "view"), "event").otherwise("region")
    items = canon(spark, sf).select(F.array(F.struct(kind.alias("kind"), h.alias("hash")), at("event", F.lit(""))).alias("anchors"))
    return f.annotation_hashes(items)


_SNAP = (
    # Kept once each, so that no plan works them out again for every join.
    WITH_EDGES.replace("canon AS (", "canon AS MATERIALIZED (", 1).replace("edges AS (", "edges AS MATERIALIZED (", 1)
    + """, snap_nodes AS (SELECT id, hash_normalized AS hash FROM canon WHERE ts_ns IS NOT NULL AND event_code <> 'click'),
  snap_edges AS (SELECT edge_id, a.hash AS from_hash, b.hash AS to_hash, relation_type, label FROM edges JOIN snap_nodes a ON a.id = src JOIN snap_nodes b ON b.id = dst WHERE graph_id = 1)"""
)


def _snapshot(spark, sf):
    ev = canon(spark, sf)
    shown = ev.filter("ts_ns IS NOT NULL AND event_code <> 'click'")
    return s.take_snapshot(ev, edges(spark, sf), shown, 1, "s1", "first look", NOW)


@query(
    "take_snapshot",
    _SNAP + "SELECT 'node' AS kind, CAST(id AS VARCHAR) AS key, hash AS h1, '' AS h2 FROM snap_nodes UNION ALL SELECT 'edge', edge_id, from_hash, to_hash FROM snap_edges",
)
def taken(spark, sf):
    n, e = _snapshot(spark, sf)
    return n.select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("key"), F.col("hash").alias("h1"), F.lit("").alias("h2")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("key"), F.col("from_hash").alias("h1"), F.col("to_hash").alias("h2"))
    )


_NOW_STATE = """, moved AS (SELECT CASE WHEN computer = 'HOST-7' THEN id + 1000000 ELSE id END AS id, hash_normalized FROM canon WHERE NOT (event_code = 'purchase' AND value > 60)),
   live AS MATERIALIZED (SELECT hash_normalized AS hash, min(id) AS live_id FROM moved GROUP BY 1)"""


def _later(spark, sf):
    """HOST-7 was read again under new ids, and expensive purchases are gone."""
    return canon(spark, sf).filter("NOT (event_code = 'purchase' AND value > 60)").withColumn(
        "id", F.when(F.col("computer") == "HOST-7", F.col("id") + 1_000_000).otherwise(F.col("id"))
    )


@query(
    "restore_plan_nodes",
    _SNAP + _NOW_STATE + """SELECT id, live_id, CASE WHEN live_id IS NULL THEN 'unresolved' WHEN live_id <> id THEN 'moved' ELSE 'applied' END AS outcome
      FROM snap_nodes LEFT JOIN live USING (hash)""",
)
def plan_nodes(spark, sf):
    n, e = _snapshot(spark, sf)
    return s.restore_plan(n, e, _later(spark, sf), edges(spark, sf))[0].select("id", "live_id", "outcome")


_EDGE_PLAN = _SNAP + _NOW_STATE + """, p AS (SELECT s.edge_id, s.label, a.live_id AS ns, b.live_id AS nd,
      CASE WHEN a.live_id IS NULL OR b.live_id IS NULL THEN 'unresolved' WHEN e.src = a.live_id AND e.dst = b.live_id THEN 'applied' ELSE 'recreatable' END AS outcome
      FROM snap_edges s LEFT JOIN live a ON a.hash = from_hash LEFT JOIN live b ON b.hash = to_hash LEFT JOIN edges e USING (edge_id)) """


@query(
    "restore_plan_edges",
    _EDGE_PLAN + """SELECT edge_id, CASE WHEN outcome <> 'unresolved' THEN ns END AS src, CASE WHEN outcome <> 'unresolved' THEN nd END AS dst, outcome,
      CASE outcome WHEN 'applied' THEN '' WHEN 'recreatable' THEN 'edge missing'
        ELSE CASE WHEN ns IS NULL AND nd IS NULL THEN 'both ends missing' WHEN ns IS NULL THEN 'source missing'
        ELSE 'target missing' END END AS reason FROM p""",
)
def plan_edges(spark, sf):
    n, e = _snapshot(spark, sf)
    return s.restore_plan(n, e, _later(spark, sf), edges(spark, sf))[1].select("edge_id", "src", "dst", "outcome", "reason")


@query(
    "restore_plan_counts",
    _EDGE_PLAN + """SELECT 'edge' AS item, outcome, count(*) AS n FROM p GROUP BY ALL
      UNION ALL SELECT 'node', CASE WHEN live_id IS NULL THEN 'unresolved' WHEN live_id <> id THEN 'moved' ELSE 'applied' END AS o, count(*)
      FROM snap_nodes LEFT JOIN live USING (hash) GROUP BY o""",
)
def plan_totals(spark, sf):
    n, e = _snapshot(spark, sf)
    return s.plan_counts(*s.restore_plan(n, e, _later(spark, sf), edges(spark, sf)))


@query(
    "recreate_edges",
    _EDGE_PLAN + """SELECT 'restored/s1/' || edge_id AS edge_id, ns AS src, nd AS dst, CAST(1 AS BIGINT) AS graph_id, label, 'user' AS created_by,
      '' AS rule_id, 'restored from snapshot s1' AS basis FROM p WHERE outcome = 'recreatable'""",
)
def recreated(spark, sf):
    n, e = _snapshot(spark, sf)
    now = edges(spark, sf)
    # All of the plan is chosen: it is read twice, so it is stored once.
    plan = written(s.restore_plan(n, e, _later(spark, sf), now)[1])
    changes = s.recreate_edges(plan, plan.select("edge_id"), "s1", 1)
    out = apply_edge_changes(now.filter("false"), changes)
    return out.select("edge_id", "src", "dst", "graph_id", "label", "created_by", "rule_id", F.array_join("basis", ";").alias("basis"))


@query(
    "list_snapshots",
    _SNAP + f"""SELECT 's1' AS snapshot_id, CAST(1 AS BIGINT) AS graph_id, 'first look' AS label, CAST({NOW} AS BIGINT) AS taken_ns,
      (SELECT count(*) FROM snap_nodes) AS nodes, (SELECT count(*) FROM snap_edges) AS edges
      UNION ALL SELECT 's2', 3, 'later', {NOW} + 1, (SELECT count(*) FROM snap_nodes WHERE id IN (SELECT id FROM canon WHERE event_code = 'view')), 0""",
)
def snapshots(spark, sf):
    n, e = _snapshot(spark, sf)
    ev = canon(spark, sf)
    n2, e2 = s.take_snapshot(ev, edges(spark, sf), ev.filter("event_code = 'view' AND ts_ns IS NOT NULL"), 3, "s2", "later", NOW + 1)
    return s.list_snapshots(n.unionByName(n2), e.unionByName(e2))


@query("reingested", _SNAP + _NOW_STATE + "SELECT CAST(count(*) > 0 AS INT) AS reingested FROM snap_nodes JOIN live USING (hash) WHERE live_id <> id")
def came_back(spark, sf):
    n, e = _snapshot(spark, sf)
    plan, _ = s.restore_plan(n, e, _later(spark, sf), edges(spark, sf))
    return s.reingested(plan).select(F.col("reingested").cast("int").alias("reingested"))


@query(
    "delete_snapshots",
    _SNAP + """SELECT 'node' AS kind, 's2' AS snapshot_id, count(*) AS n FROM canon WHERE event_code = 'view' AND ts_ns IS NOT NULL
      UNION ALL SELECT 'node of other graphs', 's1', count(*) FROM snap_nodes UNION ALL SELECT 'edge of other graphs', 's1', count(*) FROM snap_edges""",
)
def thinned(spark, sf):
    """Two snapshots of two graphs: once the first is deleted, once all of the second one's graph."""
    n, e = _snapshot(spark, sf)
    ev = canon(spark, sf)
    n2, e2 = s.take_snapshot(ev, edges(spark, sf), ev.filter("event_code = 'view' AND ts_ns IS NOT NULL"), 3, "s2", "later", NOW + 1)
    n, e = n.unionByName(n2), e.unionByName(e2)
    count = lambda df, kind: df.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "snapshot_id", "n")
    kept = s.delete_snapshots(n, e, n.filter("snapshot_id = 's1'"))
    others = s.delete_snapshots(n, e, graph_id=3)
    return count(kept[0], "node").unionByName(count(others[0], "node of other graphs")).unionByName(count(others[1], "edge of other graphs"))


@query(
    "inventory",
    WITH_CANON + """SELECT 'total' AS kind, 'events' AS name, count(*) AS n FROM canon UNION ALL SELECT 'total', 'undated', count(*) FROM canon WHERE ts_ns IS NULL
      UNION ALL SELECT 'total', 'stale', count(*) FROM canon WHERE corr_version <> 2 UNION ALL SELECT 'channel', channel, count(*) FROM canon GROUP BY channel"""
    + "".join(f" UNION ALL SELECT 'slot', '{x}', count({x}) FROM canon" for x in model.SLOTS),
)
def counted(spark, sf):
    return a.inventory(canon(spark, sf))


CHECKED = [
    *RULES,
    Rule("Wants Another Log", ("error", "view"), channels=("Security", "System")),
    Rule("Cannot Fire", ("error", "reboot", "crash", "reboot"), channels=("Security",)),
    Rule("Blocked", ("error", "view"), "field", match_fields=("logon_id", "service_name", "subject_user"), channels=("Application",)),
    Rule("No Parents", (), "lineage", lineage_create_ids=("fork",), channels=("Security",)),
    Rule("Switched Off", ("nothing", "never"), enabled=False),
]

_RULE_ROWS = """SELECT 'missing_channel' AS code, 'warning' AS severity, 'wants-another-log' AS subject, 'System' AS detail, 0 AS n
      WHERE 'System' NOT IN (SELECT channel FROM canon)
    UNION ALL SELECT 'channel_undeclared', 'info', '', '', 1
    UNION ALL SELECT 'rule_inert', 'warning', 'cannot-fire', 'crash, reboot', 0 WHERE NOT EXISTS (SELECT 1 FROM canon WHERE event_code IN ('crash', 'reboot'))
    UNION ALL SELECT 'rule_inert', 'warning', 'no-parents', 'fork', 0 WHERE NOT EXISTS (SELECT 1 FROM canon WHERE event_code = 'fork')
    UNION ALL SELECT 'rule_blocked', 'warning', 'blocked', 'service_name', 0 WHERE (SELECT count(service_name) FROM canon) = 0"""


@query("check_rules", WITH_CANON + _RULE_ROWS)
def rule_state(spark, sf):
    return a.check_rules(canon(spark, sf), CHECKED)


@query(
    "integrity_report",
    f"WITH RECURSIVE {CANON}, {EDGES}, {GRAPHS}, {FINDINGS}, live AS (SELECT * FROM canon WHERE value <= 90) " + f"""
      SELECT 'dangling_relations' AS code, 'error' AS severity, '' AS subject, '' AS detail, count(*) AS n FROM edges
        WHERE src NOT IN (SELECT id FROM live) OR dst NOT IN (SELECT id FROM live) HAVING count(*) > 0
      UNION ALL SELECT 'orphan_findings', 'warning', '', '', count(*) FROM findings WHERE key NOT IN (SELECT hash_normalized FROM live) HAVING count(*) > 0
      UNION ALL SELECT 'orphan_graph', 'warning', '3', '', count(*) FROM edges WHERE graph_id = 3
      UNION ALL SELECT 'empty_graph', 'info', 'Unused', '', 0
      UNION ALL SELECT 'stale_projection', 'warning', '', '', count(*) FROM live WHERE corr_version <> 2
      UNION ALL SELECT * FROM ({_RULE_ROWS.replace("FROM canon", "FROM live")})""",
)
def report(spark, sf):
    """Events over 90 are gone, and the analyst's graph is not in the registry."""
    ev = canon(spark, sf)
    registry = graphs(spark).filter("graph_id <> 3")
    return a.integrity_report(ev.filter("value <= 90"), edges(spark, sf), registry, findings(ev), CHECKED)


@query(
    "report_counts",
    f"WITH RECURSIVE {CANON}, {EDGES}, {GRAPHS}, {FINDINGS} " + """SELECT (SELECT count(*) FROM canon) AS events, (SELECT count(*) FROM edges) AS relations,
      (SELECT count(*) FROM graphs) AS graphs, (SELECT count(*) FROM findings) AS findings, 6 AS enabled_rules, 1 AS rules_unchecked""",
)
def report_totals(spark, sf):
    ev = canon(spark, sf)
    return a.report_counts(ev, edges(spark, sf), graphs(spark), findings(ev), CHECKED)


def _documents(spark, sf):
    """A rule document per event: well-formed or broken in one of ten ways."""
    k = F.get_json_object("props", "$.k").cast("int") % 10
    code = F.col("event_type")
    open_, seq = F.concat(F.lit('{"name": "R '), code, F.lit('", "channels": ["S"]')), F.concat(F.lit(', "sequence": ["'), code, F.lit('", "x"]'))
    doc = (
        F.when(k == 0, F.concat(open_, seq, F.lit(', "match_scope": "global"}')))
        .when(k == 1, F.concat(open_, F.lit(', "sequence": ["'), code, F.lit('"]}')))
        .when(k == 2, F.concat(open_, seq))
        .when(k == 3, F.concat(F.lit('{"name": " "'), seq, F.lit(', "format_version": 1}')))
        .when(k == 4, F.concat(open_, seq, F.lit(', "algorithm": "guess"}')))
        .when(k == 5, F.concat(open_, seq, F.lit(', "algorithm": "temporal", "window_within": "10m", "window_total": "90s"}')))
        .when(k == 6, F.concat(open_, seq, F.lit(', "algorithm": "field", "match_fields": ["logon_id", "what", "logon_id"]}')))
        .when(k == 7, F.concat(F.lit('{"format_version": 99, "name": "'), code, F.lit('"}')))
        .when(k == 8, F.concat(open_, F.lit(', "algorithm": "lineage", "lineage_depth": -2, "lineage_create_ids": ["a", " "]}')))
        .otherwise(F.concat(open_, F.lit(', "sequence": "'), code, F.lit('"}')))
    )
    return table(spark, sf, "events").select(F.col("event_id").cast("string").alias("rule_id"), doc.alias("doc"))


_M = "CAST(json_extract_string(props, '$.k') AS INT) % 10"
_ERRORS = [
    (1, 0, "sequence_short", -1), (2, 0, "syntax", -1), (3, 0, "name_required", -1), (4, 0, "unknown_algorithm", -1),
    (5, 0, "window_total_too_small", -1), (6, 0, "unknown_match_field", 1), (6, 1, "duplicate_match_field", 2),
    (7, 0, "unsupported_format", -1), (8, 0, "lineage_ids_empty", 1), (8, 1, "lineage_depth_range", -1), (9, 0, "syntax", -1),
]


@query(
    "validate_rules",
    "SELECT CAST(event_id AS VARCHAR) AS rule_id, position, code, place AS \"at\" FROM events JOIN (VALUES "
    + ", ".join(str(x) for x in _ERRORS)
    + f") AS v(m, position, code, place) ON m = {_M}",
)
def validated(spark, sf):
    return checks.validate_rules(_documents(spark, sf))


_NOTES = [(m, "no_description", "description") for m in (0, 1, 3, 4, 5, 6, 7, 8)] + [(m, "no_channels", "channels") for m in (3, 7)] + [(0, "global_without_fields", "match_scope")]


@query(
    "advise_rules",
    "SELECT CAST(event_id AS VARCHAR) AS rule_id, code, field FROM events JOIN (VALUES "
    + ", ".join(str(x) for x in _NOTES)
    + f") AS v(m, code, field) ON m = {_M}",
)
def advised(spark, sf):
    return checks.advise_rules(_documents(spark, sf)).select("rule_id", "code", "field")


@query(
    "effective_rules",
    """WITH u AS (SELECT DISTINCT c_mktsegment AS name, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS f FROM customer),
       b AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT lower(c_mktsegment) FROM customer),
       s AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS slug, name, 'user' AS source FROM u
             UNION ALL SELECT regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), name, 'builtin' FROM b
             WHERE regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') NOT IN (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') FROM u))
       SELECT slug, name, source, CAST(NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 2 AND regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') = slug) AS INT) AS enabled FROM s""",
)
def effective(spark, sf):
    """Every customer brings a rule named after its segment; nations are built in; those of one region are switched off."""
    customers, nations = table(spark, sf, "customer"), table(spark, sf, "nation")
    user = customers.select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("file"))
    builtin = nations.select(F.col("n_name").alias("name")).union(customers.select(F.lower("c_mktsegment"))).distinct()
    off = nations.filter("n_regionkey = 2").select(
        F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", "-").alias("slug"), F.lit(False).alias("enabled")
    )
    out, _ = checks.effective_rules(builtin, user, off)
    return out.withColumn("enabled", F.col("enabled").cast("int"))
