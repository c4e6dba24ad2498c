import os

import duckdb
import pytest

import models
from chainspan.catalog import registry
from chainspan.catalog.correlation import recoded
from chainspan.catalog.frames import canon
from chainspan.plans.library import builtin_rules

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")
registry.load()

# One query of each kind; the whole catalog is checked outside the unit tests.
CHECKED = [
    "quarantine", "shred_event_xml", "dedup", "extract_slots", "relation_state_any", "page_events_descending_tail",
    "match_sequence", "match_field", "match_temporal", "process_lifetimes", "match_basis", "cap_matches_buckets",
    "build_outcomes", "adjacency", "rule_clusters", "timeline_lanes_folded", "relation_heatmap", "replay_schedule",
    "restore_plan_edges", "integrity_report",
]


def text(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert text([tuple(r) for r in df.collect()], df.columns) == text(cur.fetchall(), columns)


def test_builtin_rules_agree_with_brute_force(spark):
    events = [(r.id, r.event_code, r.ts_ns, r.computer, r) for r in recoded(canon(spark, SF)).collect()]
    got = {r.rule_id: r for r in registry.QUERIES["builtin_rules"](spark, SF).collect()}
    for rule in builtin_rules():
        if rule.algorithm == "lineage":
            continue
        slots = rule.bucket_slots
        key = lambda e: None if any(e[4][s] is None for s in slots) else (e[3], *[e[4][s] for s in slots])  # noqa: B023, E731
        codes = list(rule.sequence)
        n = sum(
            len(models.temporal(b, codes, rule.within_ns) if rule.algorithm == "temporal" else models.sequence(b, codes))
            for b in models.ordered(events, key).values()
        )
        assert (got[rule.rule_id].matches, got[rule.rule_id].relations) == (n, n * (len(codes) - 1)), rule.name
    create, life = "4688", []
    for e in sorted((e for e in events if e[2] is not None), key=lambda e: (e[2], e[0])):
        if e[1] in (create, "4689"):
            life.append(e)
    starts = [e for e in life if e[1] == create]
    alive = lambda c: [p for p in life if p[3] == c[3] and p[4].new_process_id == c[4].process_id and p[2] <= c[2]]
    resolved = sum(bool(a := alive(c)) and a[-1][1] == create for c in starts)
    ancestry = got["process-ancestry"]
    assert (ancestry.matches, ancestry.unresolved_parents) == (resolved, len(starts) - resolved)
