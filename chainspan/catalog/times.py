"""Histograms, heatmaps and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspan.catalog.frames import WITH_CANON, WITH_EDGES, canon, edges
from chainspan.catalog.registry import query
from chainspan.catalog.selection import FROM_NS, TO_NS
from chainspan.operators import timeline as t
from chainspan.operators.query import EventFilter, filter_events


def _sliced(n: int, lo: str = "min(ts_ns)", hi: str = "max(ts_ns)", where: str = "ts_ns IS NOT NULL") -> str:
    """x: extent and width; placed: events with their bucket."""
    return f"""ext AS (SELECT {lo} AS lo, {hi} AS hi FROM canon WHERE {where}), x AS (SELECT *, (hi - lo) // {n} AS w FROM ext),
      placed AS (SELECT canon.*, least((ts_ns - lo) // w, {n} - 1) AS bucket FROM canon, x WHERE {where} AND ts_ns >= lo)"""


@query(
    "timeline",
    WITH_CANON + ", " + _sliced(240) + """
      SELECT b AS bucket, lo + b * w AS start_ns, CASE WHEN b = 239 THEN hi ELSE lo + (b + 1) * w END AS end_ns, count(id) AS n
      FROM range(240) r(b) CROSS JOIN x LEFT JOIN placed ON bucket = b GROUP BY ALL""",
)
def density(spark, sf):
    return t.timeline(canon(spark, sf))


@query(
    "timeline_fine",
    WITH_CANON + ", " + _sliced(5000) + """
      SELECT b AS bucket, lo + b * w AS start_ns, CASE WHEN b = 4999 THEN hi ELSE lo + (b + 1) * w END AS end_ns, count(id) AS n
      FROM range(5000) r(b) CROSS JOIN x LEFT JOIN placed ON bucket = b GROUP BY ALL""",
)
def fine(spark, sf):
    return t.timeline(canon(spark, sf), 5000)


@query("timeline_all_lanes", WITH_CANON + ", " + _sliced(50) + """SELECT "user" AS lane, bucket, count(*) AS n FROM placed GROUP BY ALL""")
def all_lanes(spark, sf):
    return t.timeline(canon(spark, sf), 50, "user", top=None)


@query(
    "timeline_bounded",
    WITH_CANON + ", " + _sliced(60, f"greatest(min(ts_ns), {FROM_NS})", f"least(max(ts_ns), {TO_NS})", f"ts_ns BETWEEN {FROM_NS} AND {TO_NS} AND event_code = 'error'") + """
      SELECT b AS bucket, lo + b * w AS start_ns, CASE WHEN b = 59 THEN hi ELSE lo + (b + 1) * w END AS end_ns, count(id) AS n
      FROM range(60) r(b) CROSS JOIN x LEFT JOIN placed ON bucket = b GROUP BY ALL""",
)
def bounded(spark, sf):
    ev = filter_events(canon(spark, sf), EventFilter(code="error", time_from=FROM_NS, time_to=TO_NS))
    return t.timeline(ev, 60, time_from=FROM_NS, time_to=TO_NS)


@query("timeline_summary", WITH_CANON + "SELECT min(ts_ns) AS from_ns, max(ts_ns) AS to_ns, count(ts_ns) AS dated, count(*) - count(ts_ns) AS undated FROM canon")
def extents(spark, sf):
    return t.timeline_summary(canon(spark, sf))


def _lanes(lane: str) -> str:
    return f"SELECT {lane} AS lane, bucket, count(*) AS n FROM placed GROUP BY ALL"


@query("timeline_lanes", WITH_CANON + ", " + _sliced(100) + _lanes("provider"))
def lanes(spark, sf):
    return t.timeline(canon(spark, sf), 100, "provider")


@query(
    "timeline_lanes_folded",
    WITH_CANON + ", " + _sliced(50) + ", l AS (" + _lanes('"user"') + """),
      top AS (SELECT lane FROM l GROUP BY lane ORDER BY sum(n) DESC, lane LIMIT 12)
      SELECT CASE WHEN lane IN (SELECT lane FROM top) THEN lane ELSE '(other)' END AS lane, bucket, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY ALL""",
)
def folded(spark, sf):
    return t.timeline(canon(spark, sf), 50, "user")


@query(
    "timeline_lanes_by_graph",
    WITH_EDGES + ", " + _sliced(40) + """, m AS (SELECT src AS id, graph_id FROM edges UNION SELECT dst, graph_id FROM edges)
      SELECT coalesce(CAST(graph_id AS VARCHAR), '(none)') AS lane, bucket, count(*) AS n FROM placed LEFT JOIN m USING (id) GROUP BY ALL""",
)
def graph_lanes(spark, sf):
    return t.timeline(canon(spark, sf), 40, "graph", edges=edges(spark, sf))


_PLACED = """, timed AS (SELECT e.*, CASE WHEN a.ts_ns IS NOT NULL AND b.ts_ns IS NOT NULL THEN greatest(a.ts_ns, b.ts_ns) END AS at_ns,
      CASE WHEN b.ts_ns > a.ts_ns THEN b.computer ELSE a.computer END AS host
      FROM edges e LEFT JOIN canon a ON a.id = src LEFT JOIN canon b ON b.id = dst) """


def _heat(lane: str, n: int = 240) -> str:
    return (
        WITH_EDGES + _PLACED + f""", x AS (SELECT min(at_ns) AS lo, (max(at_ns) - min(at_ns)) // {n} AS w FROM timed)
      SELECT {lane} AS lane, least((at_ns - lo) // w, {n} - 1) AS bucket, count(*) AS n FROM timed, x WHERE at_ns IS NOT NULL GROUP BY ALL"""
    )


def _heat_query(name: str, group_by: str, lane: str):
    @query(name, _heat(lane))
    def heat(spark, sf):
        cells, _ = t.relation_heatmap(edges(spark, sf), canon(spark, sf), 240, group_by)
        return cells

    return heat


_heat_query("relation_heatmap", "rule", "CASE rule_id WHEN '' THEN '(none)' ELSE rule_id END")
_heat_query("heatmap_by_relation_type", "relation_type", "relation_type")
_heat_query("heatmap_by_creator", "created_by", "created_by")
_heat_query("heatmap_by_computer", "computer", "host")
_heat_query("heatmap_by_step", "step", "CASE WHEN rel_version = 0 OR rule_id = '' THEN '(none)' ELSE 'step ' || (step_index + 1) END")


@query(
    "relation_heatmap_summary",
    WITH_EDGES + _PLACED + f""", y AS (SELECT * FROM timed WHERE graph_id = 1 AND at_ns BETWEEN {FROM_NS} AND {TO_NS})
      SELECT (SELECT count(*) FROM timed WHERE graph_id = 1) AS total, count(*) AS placed,
        (SELECT count(*) FROM timed WHERE graph_id = 1 AND at_ns IS NULL) AS undated,
        (SELECT count(*) FROM timed WHERE graph_id = 1 AND NOT at_ns BETWEEN {FROM_NS} AND {TO_NS}) AS outside,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM y GROUP BY rule_id, least((at_ns - {FROM_NS}) // (({TO_NS} - {FROM_NS}) // 30), 29))) AS max_cell FROM y""",
)
def heat_summary(spark, sf):
    return t.relation_heatmap(edges(spark, sf), canon(spark, sf), 30, "rule", 1, FROM_NS, TO_NS)[1]


_SCHEDULE = (
    WITH_EDGES
    + """, shown AS (SELECT id, CASE WHEN event_code = 'view' THEN NULL ELSE ts_ns END AS ts_ns FROM canon WHERE event_code <> 'purchase' OR value < 50),
    plan AS (SELECT 'node' AS kind, CAST(id AS VARCHAR) AS key, ts_ns AS at_ns, 0 AS approximate FROM shown
      UNION ALL SELECT 'edge', edge_id, greatest(a.ts_ns, b.ts_ns), CAST(a.ts_ns IS NULL OR b.ts_ns IS NULL AS INT)
      FROM edges JOIN shown a ON a.id = src JOIN shown b ON b.id = dst) """
)


def _schedule(spark, sf):
    """Views lose their time; expensive purchases are not shown."""
    shown = canon(spark, sf).filter("event_code <> 'purchase' OR value < 50").withColumn(
        "ts_ns", F.when(F.col("event_code") != "view", F.col("ts_ns"))
    )
    return t.replay_schedule(shown, edges(spark, sf))


@query("replay_schedule", _SCHEDULE + "SELECT * FROM plan")
def schedule(spark, sf):
    return _schedule(spark, sf).withColumn("approximate", F.col("approximate").cast("int"))


@query("replay_at", _SCHEDULE + f"SELECT kind, key FROM plan WHERE at_ns IS NULL OR at_ns <= {FROM_NS}")
def state_at(spark, sf):
    return t.replay_at(_schedule(spark, sf), FROM_NS).select("kind", "key")


@query(
    "replay_summary",
    _SCHEDULE + """SELECT min(at_ns) FILTER (kind = 'node') AS from_ns, max(at_ns) FILTER (kind = 'node') AS to_ns,
      count(at_ns) FILTER (kind = 'node') AS dated, count(*) FILTER (kind = 'node') AS total,
      count(*) FILTER (kind = 'node' AND at_ns IS NULL) AS undated, count(*) FILTER (kind = 'edge' AND approximate = 1) AS approximate FROM plan""",
)
def replay_totals(spark, sf):
    return t.replay_summary(_schedule(spark, sf))
