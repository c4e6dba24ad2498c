import random

import pytest

import models
from chainspan.operators import layout, lineage
from chainspan.operators.edges import emit_edges, first_matches
from chainspan.operators.layout import neighbours, ordered_layout, running_position
from chainspan.operators.matching import match_rules
from chainspan.plans.rules import Rule

SCHEMA = "id long, event_code string, ts_ns long, computer string, logon_id string, corr_version int"
RULES = [
    Rule("pair", ("A", "B")),
    Rule("repeat", ("A", "A", "B")),
    Rule("same", ("A", "A", "A")),
    Rule("four", ("A", "B", "C", "A")),
    Rule("everywhere", ("A", "B", "C"), match_scope="global"),
    Rule("quick pair", ("A", "B"), "temporal", window_within="3ns"),
    Rule("quick burst", ("A", "A", "B"), "temporal", window_within="6ns", window_total="9ns"),
    Rule("slow", ("A", "B", "C"), "temporal", window_within="40ns"),
    Rule("session", ("A", "B"), "field", match_fields=("logon_id",)),
    Rule("session burst", ("B", "B", "A"), "field", match_fields=("logon_id",)),
    Rule("quick session", ("A", "B"), "temporal", window_within="9ns", match_fields=("logon_id",)),
]


def make(seed, n=500):
    """Most events sit on one host and in one session, some have no host, session or time; many share a time."""
    rnd, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rnd.choice([0, 1, 2, 3, 9])
        host = rnd.choice(["h0"] * 8 + ["h1", None])
        rows.append((i + 1, rnd.choice("ABCD"), None if rnd.random() < 0.03 else t, host, rnd.choice(["x"] * 6 + ["y", None]), 2))
    rnd.shuffle(rows)
    return rows


def expected(rows, rule):
    def key(e):
        scope = "" if rule.match_scope == "global" else (e[3] or "")
        if rule.bucket_slots:
            return None if e[4] is None else (scope, e[4])
        return scope

    out = []
    for b in models.ordered(rows, key).values():
        out += models.temporal(b, rule.sequence, rule.within_ns, rule.total_ns) if rule.algorithm == "temporal" else models.sequence(b, rule.sequence)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [23, 65_536])
def test_every_matcher_agrees_with_the_model(spark, monkeypatch, seed, block):
    monkeypatch.setattr(layout, "BLOCK_ROWS", block)
    rows = make(seed)
    got = {}
    for r in match_rules(spark.createDataFrame(rows, SCHEMA), RULES).collect():
        got.setdefault(r.rule_ix, []).append(tuple(r.ids))
    for ix, rule in enumerate(RULES):
        assert sorted(got.get(ix, [])) == expected(rows, rule), rule.name


def test_one_partition_and_many_agree(spark):
    rows = make(3)
    found = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = spark.createDataFrame(random.sample(rows, len(rows)), SCHEMA)
        found.append(sorted((r.rule_ix, tuple(r.ids)) for r in match_rules(df, RULES).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1]


def test_edges_carry_provenance(spark):
    rows = [(1, "A", 10, "h", "s", 2), (2, "B", 25, "h", "s", 2), (3, "C", 30, "h", "s", 2)]
    rules = [
        Rule("Three", ("A", "B", "C"), labels=("first",), relation_type="temporal"),
        Rule("Fast", ("A", "B"), "temporal", window_within="1us", match_fields=("logon_id",)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.edge_id: r for r in emit_edges(match_rules(df, rules), rules).collect()}
    assert set(got) == {"three/m-1-3-3/0", "three/m-1-3-3/1", "fast/m-1-2-2/0"}
    assert [got["three/m-1-3-3/0"].label, got["three/m-1-3-3/1"].label] == ["first", ""]
    assert got["three/m-1-3-3/1"].src == 2 and got["three/m-1-3-3/1"].dst == 3
    assert got["three/m-1-3-3/0"].basis == [] and got["three/m-1-3-3/0"].relation_type == "temporal"
    assert got["fast/m-1-2-2/0"].basis == ["logon_id=s", "max Δt=15ns ≤ 1µs"]


def test_first_matches_and_counts(spark):
    rows = make(5)
    rules = [RULES[0], RULES[8], RULES[4]]
    df = spark.createDataFrame(rows, SCHEMA)
    kept, totals = first_matches(match_rules(df, rules), df, rules, 20)
    got = {}
    for r in kept.collect():
        got.setdefault(r.rule_ix, set()).add(tuple(r.ids))
    for ix, rule in enumerate(rules):
        order = []
        slots = bool(rule.bucket_slots)
        groups = models.ordered(rows, lambda e: ("" if rule.match_scope == "global" else e[3] or "", e[4]) if slots else ("" if rule.match_scope == "global" else e[3] or "",))
        names = sorted(groups, key=lambda k: (k[0], (groups[k][0][2], groups[k][0][0])))
        for k in names:
            if not (slots and k[1] is None):
                order += models.sequence(groups[k], rule.sequence)
        assert totals[ix] == len(order)
        assert got[ix] == set(order[:20])


def test_neighbours_and_positions(spark):
    rows = make(7)
    df = spark.createDataFrame(rows, SCHEMA).filter("ts_ns is not null").na.fill("", ["computer"])
    lay = ordered_layout(df, ["computer"], ["ts_ns", "id"])
    after = {r.id: r.id_next for r in neighbours(lay, ["id"], 1).collect()}
    before = {r.id: r.id_prev for r in neighbours(lay, ["id"], -1).collect()}
    place = {r.id: r.position for r in running_position(lay).collect()}
    flat = []
    for _, b in sorted(models.ordered(rows, lambda e: e[3] or "").items()):
        ids = [e[0] for e in b]
        flat += ids
        assert [after[i] for i in ids] == ids[1:] + [None]
        assert [before[i] for i in ids] == [None] + ids[:-1]
    assert [place[i] for i in flat] == list(range(len(flat)))


PROC = "id long, event_code string, ts_ns long, computer string, process_id string, new_process_id string, parent_process_id string, process_name string"
TREE = Rule("Tree", (), "lineage", lineage_depth=3)


def resolve(spark, rows):
    edges, counts = lineage.match_lineage(spark.createDataFrame(rows, PROC), TREE)
    return sorted((r.src, r.dst, r.step_index) for r in edges.collect()), counts


def test_lineage_reuse_exit_and_ties(spark):
    rows = [
        (1, "4688", 10, "h", "0x9", "0x1", None, "a"),  # creator unknown
        (2, "4688", 20, "h", "0x1", "0x2", None, "b"),  # child of 1
        (3, "4689", 30, "h", "0x1", None, None, "a"),  # 1 ends
        (4, "4688", 30, "h", "0x1", "0x3", None, "c"),  # nobody is 0x1 any more
        (5, "4688", 40, "h", "0x2", "0x1", None, "d"),  # 0x1 again, child of 2
        (6, "4688", 50, "h", "0x1", "0x4", None, "e"),  # child of 5, not of 1
        (7, "4688", 60, "g", "0x1", "0x5", None, "f"),  # another host
        (8, "4688", 70, "h", "0x6", None, "0x4", "g"),  # explicit parent
        (9, "4688", None, "h", "0x1", "0x8", None, "x"),  # undated
    ]
    got, counts = resolve(spark, rows)
    assert got == sorted([(1, 2, 0), (2, 5, 0), (5, 6, 0), (6, 8, 0), (1, 5, 1), (2, 6, 1), (1, 6, 2), (5, 8, 1), (2, 8, 2), (1, 8, 3)])
    assert counts == {"matches": 4, "unresolved": 3, "relations": 10}


def test_lineage_agrees_with_brute_force(spark):
    rnd = random.Random(4)
    rows, t = [], 0
    for i in range(400):
        t += rnd.choice([0, 0, 1, 2])
        pid, ppid = (f"0x{rnd.choice([1, 1, 1, 1, 2, 3, 4])}" for _ in range(2))
        rows.append((i, rnd.choice(["4688", "4688", "4689", "1"]), t, rnd.choice(["h", "h", "h", "g"]), ppid, pid, None, f"p{i}"))
    parents = {}
    life = [r for r in rows if r[1] in ("4688", "4689")]
    for c in (r for r in life if r[1] == "4688"):
        last = [r for r in life if r[3] == c[3] and r[5] == c[4] and r[2] <= c[2]]
        last = max(last, key=lambda r: (r[2], r[0]), default=None)
        if last and last[1] == "4688":
            parents[c[0]] = last[0]
    expected_edges = []
    for child, p in parents.items():
        for d in range(4):
            expected_edges.append((p, child, d))
            p = parents.get(p)
            if p is None:
                break
    random.Random(1).shuffle(rows)
    assert resolve(spark, rows)[0] == sorted(expected_edges)


def _jobs(spark, run):
    """How many Spark jobs ``run`` starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_jobs_of_a_timed_rule_do_not_grow_with_runs(spark):
    """A then many B, then C, without a gap over the limit: what one run begins with depends on all before it."""
    codes = ["A", *["B"] * 30, "C"] * 13
    rows = [(i, c, 10 * i, "h", None, 2) for i, c in enumerate(codes)]
    rule = Rule("chain", ("A", "B", "C"), "temporal", window_within="1us")
    counts = {}
    for n in (8, 200):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = []
        counts[n] = _jobs(spark, lambda: got.extend(match_rules(spark.createDataFrame(rows, SCHEMA), [rule]).collect()))
        assert sorted(tuple(r.ids) for r in got) == sorted(models.temporal([(r[0], r[1], r[2]) for r in rows], ("A", "B", "C"), 1000))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert counts[8] == counts[200]


def test_states_shuffled_to_runs_give_the_same_matches(spark, monkeypatch):
    monkeypatch.setattr(layout, "BLOCK_ROWS", 23)
    rows = make(11)
    found = []
    for limit in (32 << 20, 0):
        monkeypatch.setattr(layout, "SENT_BYTES", limit)
        found.append(sorted((r.rule_ix, tuple(r.ids)) for r in match_rules(spark.createDataFrame(rows, SCHEMA), RULES).collect()))
    assert found[0] == found[1]


def test_sixty_four_generations_take_seven_rounds(spark, monkeypatch):
    n, jumps = 70, []
    real = lineage.written
    monkeypatch.setattr(lineage, "written", lambda df: (jumps.append(1) if df.columns == ["rule_ix", "at", "up"] else None, real(df))[1])
    rows = [(i, "4688", 10 * i, "h", f"0x{i:x}", f"0x{i + 1:x}", None, "p") for i in range(n)]
    edges, counts = lineage.match_lineage(spark.createDataFrame(rows, PROC), Rule("Deep", (), "lineage", lineage_depth=64))
    got = {(r.src, r.dst, r.step_index) for r in edges.collect()}
    assert got == {(j, i, i - j - 1) for i in range(n) for j in range(max(0, i - 65), i)}
    assert counts["relations"] == len(got) and len(jumps) <= 7
