"""Event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspan.catalog.frames import CANON, EDGES, FINDINGS, WITH_CANON, WITH_EDGES, WITH_FINDINGS, canon, edges, findings
from chainspan.catalog.registry import query
from chainspan.operators import query as q
from chainspan.operators.query import EventFilter

# 2024-01-10 and 2024-01-20, midnight.
FROM_NS, TO_NS = 1_704_844_800_000_000_000, 1_705_708_800_000_000_000
OUT = ("id", "event_code", "ts_ns", "computer")


def _run(spark, sf, flt, **tables):
    return q.filter_events(canon(spark, sf), flt, **tables).select(*OUT)


def _sql(where: str, base: str = WITH_CANON) -> str:
    return base + f"SELECT id, event_code, ts_ns, computer FROM canon WHERE {where}"


@query("equality_filters", _sql("event_code = 'error' AND provider = 'P-3' AND channel = 'Security' AND ts_ns IS NOT NULL"))
def equality(spark, sf):
    return _run(spark, sf, EventFilter(code="error", provider="P-3", channel="Security", user="", source_type="table"))


@query(
    "search_text",
    _sql("contains(lower(concat_ws(' ', event_code, provider, channel, \"user\", computer)), 'ecurity u-1') AND ts_ns IS NOT NULL"),
)
def search(spark, sf):
    return _run(spark, sf, EventFilter(search="ECURITY u-1"))


@query("time_range", _sql(f"ts_ns BETWEEN {FROM_NS} AND {TO_NS}"))
def time_range(spark, sf):
    return _run(spark, sf, EventFilter(time_from=FROM_NS, time_to=TO_NS, undated="include"))


@query("time_upper_bound", _sql(f"ts_ns IS NULL OR ts_ns <= {TO_NS}"))
def upper_bound(spark, sf):
    """An upper bound alone lets undated events pass."""
    return _run(spark, sf, EventFilter(time_to=TO_NS, undated="include"))


_COUNTED = f"""WITH {CANON}, counted AS (
   SELECT *, CASE WHEN k % 4 = 0 THEN NULL ELSE k % 4 END AS dedup_count FROM canon) """


@query(
    "source_and_count_filters",
    _COUNTED + """SELECT id, event_code, ts_ns, computer FROM counted
      WHERE source_identifier = 'feed-a' AND coalesce(dedup_count, 1) >= 2 AND ts_ns IS NOT NULL""",
)
def source_and_count(spark, sf):
    k = F.col("k") % 4
    ev = canon(spark, sf).withColumn("dedup_count", F.when(k != 0, k))
    return q.filter_events(ev, EventFilter(source_identifier="feed-a", min_count=2)).select(*OUT)


def _linked(condition: str) -> str:
    return (
        WITH_EDGES
        + f""", ends AS (SELECT src AS id FROM edges WHERE {condition} UNION SELECT dst FROM edges WHERE {condition})
       SELECT id, event_code, ts_ns, computer FROM canon WHERE id IN (SELECT id FROM ends) AND ts_ns IS NOT NULL"""
    ).replace(") , ends", "), ends")


@query("relation_state_any", _linked("true"))
def related(spark, sf):
    return _run(spark, sf, EventFilter(relation_state="any"), edges=edges(spark, sf))


@query("relation_state_system", _linked("created_by = 'system'"))
def related_system(spark, sf):
    return _run(spark, sf, EventFilter(relation_state="system"), edges=edges(spark, sf))


@query("relation_state_user", _linked("created_by <> 'system'"))
def related_user(spark, sf):
    return _run(spark, sf, EventFilter(relation_state="user"), edges=edges(spark, sf))


@query(
    "undated_policy",
    WITH_CANON + """SELECT 'exclude' AS policy, count(*) FILTER (ts_ns IS NOT NULL) AS n FROM canon
      UNION ALL SELECT 'include', count(*) FROM canon UNION ALL SELECT 'only', count(*) FILTER (ts_ns IS NULL) FROM canon""",
)
def undated(spark, sf):
    ev = canon(spark, sf)
    parts = [
        q.count_events(ev, EventFilter(undated=p)).select(F.lit(p).alias("policy"), "n") for p in ("exclude", "include", "only")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "hash_sets",
    WITH_FINDINGS + """SELECT 'in' AS how, id FROM canon WHERE hash_normalized IN (SELECT key FROM findings)
      UNION ALL SELECT 'not in', id FROM canon WHERE hash_normalized NOT IN (SELECT key FROM findings)""",
)
def hash_sets(spark, sf):
    """Members, the others, and the members of an empty set (none)."""
    ev = canon(spark, sf)
    keys = findings(ev).select("key")
    return (
        q.filter_hashes(ev, hashes=keys).select(F.lit("in").alias("how"), "id")
        .unionByName(q.filter_hashes(ev, exclude=keys).select(F.lit("not in").alias("how"), "id"))
        .unionByName(q.filter_hashes(ev, hashes=keys.filter("false")).select(F.lit("in nothing").alias("how"), "id"))
    )


_STATES = {
    "flagged": "hash_normalized IN (SELECT key FROM findings WHERE flagged)",
    "annotated": "hash_normalized IN (SELECT key FROM findings)",
    "noted": "hash_normalized IN (SELECT key FROM findings WHERE note <> '')",
    "none": "hash_normalized NOT IN (SELECT key FROM findings)",
}


@query(
    "finding_state",
    WITH_FINDINGS
    + " UNION ALL ".join(f"SELECT '{s}' AS state, id FROM canon WHERE ts_ns IS NOT NULL AND {c}" for s, c in _STATES.items())
    + """ UNION ALL SELECT 'tagged', id FROM canon WHERE ts_ns IS NOT NULL
          AND hash_normalized IN (SELECT key FROM findings WHERE list_contains(tags, 'p-2'))
          UNION ALL SELECT 'both', id FROM canon WHERE ts_ns IS NOT NULL
          AND hash_normalized IN (SELECT key FROM findings WHERE list_contains(tags, 'p-2') AND flagged)""",
)
def finding_state(spark, sf):
    ev = canon(spark, sf)
    notes = findings(ev)
    out = None
    cases = [(s, EventFilter(finding_state=s)) for s in _STATES]
    cases += [("tagged", EventFilter(tag=" P-2 ")), ("both", EventFilter(tag="p-2", finding_state="flagged"))]
    for name, flt in cases:
        part = q.filter_events(ev, flt, findings=notes).select(F.lit(name).alias("state"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "order_events",
    WITH_CANON + """SELECT id, ts_ns, row_number() OVER (ORDER BY ts_ns DESC NULLS LAST, id) - 1 AS place FROM canon""",
)
def ordered(spark, sf):
    """Every event with its place in descending order."""
    return q.place_events(canon(spark, sf).select("id", "ts_ns"), descending=True)


@query("page_events", WITH_CANON + "SELECT id, event_code, ts_ns, computer FROM canon ORDER BY ts_ns NULLS LAST, id LIMIT 512 OFFSET 300")
def page(spark, sf):
    return q.page_events(canon(spark, sf).select(*OUT), 300, 512)


@query(
    "page_events_descending_tail",
    WITH_CANON + "SELECT id, event_code, ts_ns, computer FROM canon ORDER BY ts_ns DESC NULLS LAST, id OFFSET 700",
)
def deep_page(spark, sf):
    """All that follows an offset: cut out of the range-partitioned order."""
    return q.page_events(canon(spark, sf).select(*OUT), 700, 0, descending=True)


@query("count_events", WITH_CANON + f"SELECT count(*) AS n FROM canon WHERE ts_ns >= {FROM_NS} AND computer = 'HOST-3' AND contains(lower(concat_ws(' ', event_code, provider, channel, \"user\", computer)), 'host-3')")
def count(spark, sf):
    return q.count_events(canon(spark, sf).filter("computer = 'HOST-3'"), EventFilter(time_from=FROM_NS, search="host-3"))


@query("find_by_hash", WITH_CANON + "SELECT min(id) AS id FROM canon WHERE hash_normalized = (SELECT max(hash_normalized) FROM canon)")
def by_hash(spark, sf):
    ev = canon(spark, sf)
    return q.find_by_hash(ev, ev.agg(F.max("hash_normalized").alias("h")).first().h)


@query("totals", WITH_EDGES + "SELECT (SELECT count(*) FROM canon) AS events, (SELECT count(*) FROM edges) AS relations")
def table_totals(spark, sf):
    return q.totals(canon(spark, sf), edges(spark, sf))
