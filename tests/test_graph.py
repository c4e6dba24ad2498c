import random

import pytest

from pyspark.sql import functions as F

from chainspan.operators import components as c
from chainspan.operators.graph import rule_clusters


def frames(spark, n, pairs):
    nodes = spark.createDataFrame([(i, i) for i in range(n)], "id long, ts_ns long")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    return nodes, edges


def test_components_with_a_hub(spark):
    rnd = random.Random(2)
    pairs = [(0, i) for i in range(1, 60)] + [(rnd.randrange(60, 120), rnd.randrange(60, 120)) for _ in range(35)] + [(5, 999)]
    nodes, edges = frames(spark, 120, pairs)
    label = list(range(120))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        if b < 120:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    assert {r.id: r.component for r in c.connected_components(nodes, edges).collect()} == {i: find(i) for i in range(120)}


def kahn(n, pairs):
    """Ranks in id order, forcing the lowest id when only circles are left."""
    pairs = {(a, b) for a, b in pairs if a != b}
    rank, placed = dict.fromkeys(range(n), 0), set()
    while len(placed) < n:
        ready = [i for i in range(n) if i not in placed and not any(b == i and a not in placed for a, b in pairs)]
        for i in ready or [min(set(range(n)) - placed)]:
            placed.add(i)
            for a, b in pairs:
                if a == i and b not in placed:
                    rank[b] = max(rank[b], rank[i] + 1)
    return rank


def test_step_rank(spark):
    rnd = random.Random(3)
    pairs = [tuple(sorted(rnd.sample(range(30), 2))) for _ in range(40)]
    nodes, edges = frames(spark, 30, pairs)
    assert {r.id: r.rank for r in c.step_rank(nodes, edges).collect()} == kahn(30, pairs)


def test_step_rank_opens_circles(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 5), (7, 7)]
    nodes, edges = frames(spark, 8, pairs)
    got = c.step_rank(nodes, edges).collect()
    assert {r.id: r.rank for r in got} == kahn(8, pairs)
    assert {r.id for r in got if r.forced} == {1, 5}


def test_tree_depth(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5), (7, 8), (8, 7), (8, 9)]
    nodes, edges = frames(spark, 10, pairs)
    got = {r.id: (r.root, r.depth) for r in c.tree_depth(nodes, edges).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (0, 1), 6: (6, 0), 7: (7, 0), 8: (7, 1), 9: (7, 2)}


def test_step_rank_without_edges(spark):
    nodes, edges = frames(spark, 3, [(0, 1)])
    assert c.step_rank(nodes, edges.filter(F.lit(False))).agg(F.sum("rank")).first()[0] == 0


def longest(n, pairs):
    rank = [0] * n
    for _ in range(n):
        for a, b in pairs:
            rank[b] = max(rank[b], rank[a] + 1)
    return rank


def test_step_rank_of_branching_graphs(spark):
    rnd = random.Random(8)
    for n, m in ((12, 14), (30, 34), (25, 80)):
        pairs = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)})
        nodes = spark.range(n)
        edges = spark.createDataFrame(pairs, "src long, dst long")
        got = {r.id: (r.rank, r.forced) for r in c.step_rank(nodes, edges).collect()}
        assert got == {i: (r, False) for i, r in enumerate(longest(n, pairs))}


def test_step_rank_of_a_long_ladder_takes_few_jobs(spark):
    n = 20_000
    nodes = spark.range(2 * n)
    edges = spark.range(1, n).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    edges = edges.union(spark.range(n).select((F.col("id") + n).alias("src"), F.col("id").alias("dst")))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = c.step_rank(nodes, edges).filter(f"id < {n}").agg(F.max("rank"), F.count_if(F.col("rank") != F.col("id") + 1)).first()
    assert tuple(got) == (n, 0)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 600


def test_step_rank_by_taking_nodes_out(spark, monkeypatch):
    """A ladder, circles with tails and a dense random graph, nearly to the end before the last task."""
    monkeypatch.setattr(c, "SMALL_EDGES", 14)
    rnd = random.Random(12)
    ladder = [(2 * k + a, 2 * k + 2 + b) for k in range(9) for a in (0, 1) for b in (0, 1)]
    tail = [(k, k + 1) for k in range(6)] + [(4, 0)] + [(k, k + 1) for k in range(8, 12)] + [(10, 12), (12, 9), (6, 11)]
    mixed = [tuple(sorted(rnd.sample(range(18), 2))) for _ in range(24)]
    for n, pairs in ((20, ladder), (14, tail), (18, mixed)):
        nodes, edges = frames(spark, n, pairs)
        assert {r.id: r.rank for r in c.step_rank(nodes, edges).collect()} == kahn(n, pairs)


def test_step_rank_of_lone_edges_taken_out(spark, monkeypatch):
    """Of an edge between two ends that nothing else touches, either end may be the one taken out."""
    monkeypatch.setattr(c, "SMALL_EDGES", 0)
    pairs = [(2 * k, 2 * k + 1) for k in range(12)] + [(30, 31), (31, 32), (33, 32)]
    nodes, edges = frames(spark, 34, pairs)
    assert {r.id: r.rank for r in c.step_rank(nodes, edges).collect()} == kahn(34, pairs)


def test_rounds_follow_the_logarithm(spark, monkeypatch):
    """A ladder of 10,000 levels and a ring with a tail: how often nodes are taken out."""
    rounds = []
    monkeypatch.setattr(c, "SMALL_EDGES", 10_000)
    real = c.durable
    monkeypatch.setattr(c, "durable", lambda df: (rounds.append(df.columns) if df.columns == ["id", "turn"] else None, real(df))[1])
    n = 10_000
    level = spark.range(n - 1)
    ladder = level.selectExpr("explode(array(struct(2*id as src, 2*id+2 as dst), struct(2*id as src, 2*id+3 as dst), struct(2*id+1 as src, 2*id+2 as dst), struct(2*id+1 as src, 2*id+3 as dst))) as e").select("e.*")
    got = c.step_rank(spark.range(2 * n), ladder).agg(F.max("rank"), F.count_if(F.expr("rank <> id div 2"))).first()
    assert tuple(got) == (n - 1, 0) and len(rounds) <= 30
    rounds.clear()
    ring = spark.range(2 * n).selectExpr("id as src", f"case when id = {n} then 0 else id + 1 end as dst")
    got = c.step_rank(spark.range(2 * n), ring.union(spark.createDataFrame([(n, n + 1)], "src long, dst long"))).agg(F.max("rank"), F.count_if("forced")).first()
    assert tuple(got) == (2 * n - 1, 1) and len(rounds) <= 30


def test_rule_clusters_meet_in_one_grouping(spark):
    """Repeated events, events of two rules, ends that are no event, edges without a rule; no join, whose sides would add up in a task."""
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 4, 5, None)], "id long")
    edges = spark.createDataFrame([(1, 2, "a"), (2, 1, "a"), (2, 3, "b"), (9, 9, "b"), (None, 9, "a"), (4, 9, ""), (5, 4, None)], "src long, dst long, rule_id string")
    got = rule_clusters(nodes, edges)
    rows = sorted((r.cluster_id, r.label, r.id or 0) for r in got.collect())
    assert rows == [("rule-a", "a", 1), ("rule-a", "a", 2), ("rule-b", "b", 2), ("rule-b", "b", 3), ("rule-none", "Not from a rule", 0), ("rule-none", "Not from a rule", 4), ("rule-none", "Not from a rule", 5)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
