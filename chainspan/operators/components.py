"""Iterative graph operators. Every round is a few joins and ends in a written table, so plans stay short."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspan.session import durable, ship_package


def with_package(df: DataFrame) -> DataFrame:
    ship_package(df.sparkSession)
    return df


def _inner_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges with both ends among the nodes, without self-edges."""
    ids = nodes.select("id").distinct()
    e = edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )


def _fingerprint(pairs: DataFrame) -> tuple:
    r = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")
    ).first()
    return (r.n, r.h)


def _star(links: DataFrame) -> DataFrame:
    """Point every u's links at the smallest id among u and what it links to.

    The minimum is a partial aggregate and the join looks up one row per u, so a hub costs no task its whole list:
    adaptive execution splits the hub's rows on the many side.
    """
    low = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return links.join(low, "u")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): direction ignored, component is its smallest member, lone nodes are their own.

    Alternates between linking each node's larger neighbours, and its smaller ones, to the smallest id it knows; the
    links turn into stars in a number of rounds logarithmic in the graph.
    """
    ids = nodes.select("id").distinct()
    inner = _inner_edges(nodes, edges)
    pairs = durable(
        inner.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    seen = _fingerprint(pairs)
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        s = _star(large)
        small = s.select(F.col("v").alias("u"), F.col("m").alias("v")).union(s.select("u", F.col("m").alias("v")))
        pairs = durable(small.filter(F.col("u") != F.col("v")).distinct())
        now = _fingerprint(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def component_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, label, size) of the components."""
    sizes = connected_components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.select(
        F.concat(F.lit("component-"), F.col("component")).alias("cluster_id"),
        F.concat(F.lit("Group of "), F.col("size")).alias("label"),
        "size",
    )


#: A rank that no path has: the node lies on a circle or behind one.
_ENDLESS = 1 << 40
#: What is left is ranked in one task once it has so few edges.
SMALL_EDGES = 100_000
#: Nodes whose removal leaves at most so many edges more than it takes away are taken out together.
MOST_FILL = 4


def step_rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rank, forced): length of the longest path of edges that ends in a node.

    Where circles leave no node that nothing leads to, the lowest id of each remaining piece is ranked as if nothing
    unranked led to it, and says so (``forced``).
    """
    ids = nodes.select("id").distinct()
    left = durable(_inner_edges(nodes, edges).withColumn("w", F.lit(1).cast("bigint")))
    forced = ids.limit(0)
    while True:
        ranks = _longest_paths(left)
        endless = durable(ranks.filter(F.col("rank") >= _ENDLESS).select("id"))
        if endless.isEmpty():
            break
        behind = left.join(endless.withColumnRenamed("id", "src"), "src", "left_semi").join(endless.withColumnRenamed("id", "dst"), "dst", "left_semi")
        lowest = connected_components(endless, behind).groupBy("component").agg(F.min("id").alias("id")).select("id")
        forced = durable(forced.unionByName(lowest))
        cut = behind.join(lowest.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
        left = durable(left.join(cut, ["src", "dst"], "left_anti"))
    out = ids.join(ranks, "id", "left").join(forced.withColumn("forced", F.lit(True)), "id", "left")
    return out.select("id", F.coalesce("rank", F.lit(0)).cast("int").alias("rank"), F.coalesce("forced", F.lit(False)).alias("forced"))


def _longest_paths(edges: DataFrame) -> DataFrame:
    """(id, rank) of all nodes of weighted edges (src, dst, w): the heaviest path to each, ``_ENDLESS`` on and behind circles.

    Nodes are taken out, many at a time: the paths through a node become edges past it, of the sum of both weights, and
    the heaviest of edges between the same two stays. Taking out a node that few edges touch leaves no more edges than
    before; nodes nothing leads to or that lead nowhere leave fewer. Those taken out together are never neighbours, and
    in chains, trees, ladders and whatever is narrow they are a fixed share of all, so the rounds follow the logarithm of
    the size, not the length of paths. An edge past a node back to where it came from shows a circle. Once little is
    left, one task ranks it; then the nodes taken out get their ranks from those they were taken from, last round first.
    """
    removed: list[DataFrame] = []
    floors = None  # the heaviest paths that begin at a node taken out
    n, most, number = edges.count(), MOST_FILL, 0
    while n > SMALL_EDGES:
        number += 1
        ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        degree = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        cheap = durable(degree.filter(F.col("i") * F.col("o") <= F.col("i") + F.col("o") + most).select("id", F.xxhash64("id", F.lit(number)).alias("turn")))
        # Of two neighbours the one with the smaller number goes.
        both = edges.join(cheap.select(F.col("id").alias("src"), F.col("turn").alias("a")), "src").join(cheap.select(F.col("id").alias("dst"), F.col("turn").alias("b")), "dst")
        stays = both.select(F.when(F.struct("a", "src") > F.struct("b", "dst"), F.col("src")).otherwise(F.col("dst")).alias("id")).distinct()
        gone = durable(cheap.select("id").join(stays, "id", "left_anti"))
        into = durable(edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "w"))
        out = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "w")
        rest = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "w")
        past = into.select("src", F.col("dst").alias("via"), F.col("w").alias("first")).join(out.withColumnRenamed("src", "via"), "via")
        past = past.select("src", "dst", (F.col("first") + F.col("w")).alias("w"))
        known = gone.join(floors, "id", "left").select("id", F.coalesce("rank", F.lit(0).cast("bigint")).alias("rank")) if floors is not None else gone.withColumn("rank", F.lit(0).cast("bigint"))
        known = durable(known)
        handed = out.join(known.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.least(F.col("rank") + F.col("w"), F.lit(_ENDLESS)).alias("rank"))
        handed = handed.unionByName(past.filter("src = dst").select(F.col("dst").alias("id"), F.lit(_ENDLESS).alias("rank")))
        if floors is not None:
            handed = handed.unionByName(floors.join(gone, "id", "left_anti"))
        floors = durable(handed.groupBy("id").agg(F.max("rank").alias("rank")))
        removed.append(known.join(into.select(F.col("dst").alias("id"), "src", "w"), "id", "left").select("id", "rank", "src", "w"))
        edges = durable(rest.unionByName(past.filter("src <> dst")).groupBy("src", "dst").agg(F.max("w").alias("w")))
        before, n = n, edges.count()
        # What is dense everywhere fills up; then only nodes at its ends go, and those it costs least.
        most = most if n < 0.95 * before else 2 * most
    started = edges.select("src", "dst", "w")
    if floors is not None:
        started = started.unionByName(floors.select(F.lit(None).cast("bigint").alias("src"), F.col("id").alias("dst"), F.col("rank").alias("w")))
    ranks = durable(with_package(started).repartition(1).mapInArrow(_ranked, "id bigint, rank bigint"))
    for gone in reversed(removed):
        above = gone.join(ranks.select(F.col("id").alias("src"), F.col("rank").alias("up")), "src", "left")
        # A node whose edges all went with their other ends is in no table of ranks: nothing leads to it.
        best = F.greatest(F.max("rank"), F.max(F.coalesce(F.coalesce("up", F.lit(0)) + F.col("w"), F.lit(0))))
        ranks = durable(ranks.unionByName(above.groupBy("id").agg(F.least(best, F.lit(_ENDLESS)).alias("rank"))))
    return ranks


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of a small graph: edges, and floors as edges from nowhere."""
    after: dict[int, list[tuple[int, int]]] = {}
    rank: dict[int, int] = {}
    waits: dict[int, int] = {}
    for src, dst, w in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        waits.setdefault(dst, 0)
        if src is None:
            rank[dst] = max(rank.get(dst, 0), w)
            continue
        after.setdefault(src, []).append((dst, w))
        waits.setdefault(src, 0)
        waits[dst] += 1
    ready = [i for i, n in waits.items() if n == 0]
    while ready:
        i = ready.pop()
        for dst, w in after.get(i, ()):
            rank[dst] = min(max(rank.get(dst, 0), rank.get(i, 0) + w), _ENDLESS)
            waits[dst] -= 1
            if waits[dst] == 0:
                ready.append(dst)
    ids = list(waits)
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "rank": pa.array([_ENDLESS if waits[i] else rank.get(i, 0) for i in ids], pa.int64())})


def choose_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent): of several parents the earliest, undated ones last, lowest id on ties."""
    inner = _inner_edges(nodes, edges)
    when = nodes.select(F.col("id").alias("src"), "ts_ns")
    order = F.struct(F.col("ts_ns").isNull(), F.col("ts_ns"), F.col("src"))
    return inner.join(when, "src").groupBy(F.col("dst").alias("id")).agg(F.min_by("src", order).alias("parent"))


def tree_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root, depth) over the chosen parents, by pointer jumping: the distance doubles every round.

    Where parents run in a circle, the lowest id met becomes the root.
    """
    ids = nodes.select("id").distinct()
    parents = durable(choose_parents(nodes, edges))
    placed, circular = _jump(ids, parents)
    if circular is not None:
        cut = circular.filter(F.col("low") == F.col("id")).select("id")
        parents = durable(parents.join(cut, "id", "left_anti"))
        placed, circular = _jump(ids, parents)
    return placed


def _jump(ids: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Roots reached, and the rows that never reach one (with the lowest id on their way), if any."""
    roots = ids.join(parents, "id", "left_anti")
    done = roots.select("id", F.col("id").alias("root"), F.lit(0).alias("depth"))
    hop = durable(
        parents.join(roots.select(F.col("id").alias("parent"), F.lit(True).alias("top")), "parent", "left").select(
            "id",
            F.col("parent").alias("up"),
            F.lit(1).alias("depth"),
            F.least("id", "parent").alias("low"),
            F.coalesce("top", F.lit(False)).alias("top"),
        )
    )
    total = hop.count()
    open_rows, rounds = hop.filter("not top").count(), 0
    # 2**rounds steps have been taken; more than there are rows means a circle.
    while open_rows and 2**rounds <= total:
        ahead = hop.select(
            F.col("id").alias("up"),
            F.col("up").alias("up2"),
            F.col("depth").alias("d2"),
            F.col("low").alias("low2"),
            F.col("top").alias("top2"),
        )
        moved = (
            hop.filter("not top")
            .join(ahead, "up")
            .select(
                "id",
                F.col("up2").alias("up"),
                (F.col("depth") + F.col("d2")).alias("depth"),
                F.least("low", "low2").alias("low"),
                F.col("top2").alias("top"),
            )
        )
        hop = durable(hop.filter("top").unionByName(moved))
        open_rows = hop.filter("not top").count()
        rounds += 1
    reached = hop.filter("top").select("id", F.col("up").alias("root"), "depth")
    return done.unionByName(reached), (hop.filter("not top") if open_rows else None)
