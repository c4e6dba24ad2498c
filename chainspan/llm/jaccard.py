"""Similarity join of documents on word shingles: a forest of MinHash signatures, then exact verification.

1. Documents with the same shingles are one node; copies are counted, never paired.
2. Each tree of the forest reads a signature along a path of its own; nodes that share a prefix of a path are a bucket. How
   long the prefix is, is settled node by node: it is shortened as far as the buckets around a node stay small, and the
   more values it keeps, the more trees are read (``levels``), so that at each length a pair right at the threshold shares
   a bucket with the target chance. Two nodes are met at the shorter of their lengths. A crowded bucket is worked on whole
   if most of its pairs share a much longer prefix as well, for then its nodes are near copies; otherwise (pages of one
   template) all its nodes keep a longer prefix. So every pair is looked for in all trees of one length, whatever else the
   table holds.
3. All nodes of a bucket are compared by signature, those of a large bucket in pairs of blocks, and a spanning forest of
   the pairs whose signatures do not rule similarity out comes back. Its trees form candidate groups.
4. Within a candidate group all pairs are verified on the whole shingle sets. Large groups are cut into blocks and pairs
   of blocks are verified side by side; a block pair reports link counts and a spanning forest, never pairs.
5. Classes are the connected components of verified links.

Results in edge cases: null and empty texts have no shingles, are classes of their own and have no links; texts of fewer
words than a shingle are one shingle; repeated rows are copies of each other; a class is named by its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspan.llm.common import clear_kept, mix, parts, rolling, rows_of, strong_word_hashes, with_python
from chainspan.operators.components import connected_components
from chainspan.session import written

SHINGLE, THRESHOLD = 5, (4, 5)
TREES, DEPTH, SHORTEST = 16, 8, 3
RECALL = 0.999
#: Signatures agreeing in fewer than this share of values rule a link out: five deviations below the threshold.
RULED_OUT = 0.62
#: Nodes, and shingles, a block holds.
BLOCK_NODES, BLOCK_SHINGLES = 256, 1_000_000
#: Nodes a block of a bucket holds (more make a bucket crowded), and rows of whole buckets in a unit.
BUCKET_NODES, UNIT_ROWS = 512, 20_000
#: Values by which a prefix grows, how often, and the share of pairs that agree on so many more in a bucket of near copies.
STEP, STEPS, TIGHT = 4, 2, 0.25

_FACTORS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    h = strong_word_hashes(text)
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return rolling(h, len(h)) ^ np.uint64(len(h))
    return np.unique(rolling(h, SHINGLE))


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of the least image of the set under each of a family of hash functions."""
    out = np.empty(len(_FACTORS), np.uint16)
    for k, f in enumerate(_FACTORS):
        out[k] = ((s * f) >> np.uint64(16)).min() & np.uint64(0xFFFF)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, n, sig) of each row; node is a hash of the set, null without shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_kept()
        for b in rows_of(batches):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            nodes = [node_of(s) for s in sets]
            sigs = pa.array([signature(s).astype("<u2").tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), sigs], ["doc_id", "text_key", "node", "n", "sig"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return with_python(keyed).mapInArrow(sign, "doc_id long, text_key long, node long, n long, sig binary")


def node_of(s: np.ndarray) -> int | None:
    if not len(s):
        return None
    at = np.arange(1, len(s) + 1, dtype=np.uint64)
    return int(mix(np.bitwise_xor.reduce(mix(s + at * np.uint64(0x9E3779B97F4A7C15)), keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def depth_for(counts: list[tuple[int, float, int]], recall: float) -> int:
    """The longest prefix that meets ``recall``; counts are (depth met at, likeness, pairs) of pairs likely similar.

    Each pair stands for as many as its chance to be met at the shortest prefix says.
    """
    stands_for = sum(n / (1 - (1 - s**SHORTEST) ** TREES) for _, s, n in counts)
    for d in range(DEPTH, SHORTEST, -1):
        found = sum(n for at, _, n in counts if at >= d)
        if found and found >= recall * stands_for:
            return d
    return SHORTEST


def prefix_for(recall: float) -> int:
    """The longest prefix at which ``recall`` of the pairs right at the threshold share a bucket, whatever else a table holds."""
    s = THRESHOLD[0] / THRESHOLD[1]
    met = [1 - (1 - s**d) ** TREES for d in range(SHORTEST, DEPTH + 1)] + [0.0]
    return depth_for([(d, s, met[k] - met[k + 1]) for k, d in enumerate(range(SHORTEST, DEPTH + 1))], recall)


@cache
def trees_for(depth: int, recall: float) -> int:
    """The fewest trees in which a pair at the threshold shares a prefix of ``depth`` values with the chance ``recall``.

    Paths choose from the same values: of m equal ones among all, a path of distinct values takes equal ones only with
    the chance comb(m, depth) / comb(all, depth), and m is binomial.
    """
    n, (a, b) = TREES * DEPTH, THRESHOLD
    m = np.arange(n + 1)
    weight = np.array([comb(n, k) * a**k * (b - a) ** (n - k) / b**n for k in m.tolist()])
    missed = 1 - np.array([comb(k, depth) / comb(n, depth) for k in m.tolist()])
    trees = TREES
    while 1 - (weight * missed**trees).sum() < recall:
        trees += 1
    return trees


def levels(recall: float) -> list[tuple[int, int]]:
    """(prefix length, trees) from the shortest to the longest prefix a node may keep."""
    first = prefix_for(recall)
    return [(first, TREES), *((first + k * STEP, trees_for(first + k * STEP, recall)) for k in range(1, STEPS + 1))]


def paths(trees: int, depth: int) -> np.ndarray:
    """Which values of a signature each tree reads, in order. The first ``TREES`` begin with values of their own."""
    n = TREES * DEPTH
    order = mix(np.arange(trees * n, dtype=np.uint64).reshape(trees, n) + np.uint64(1)) | np.uint64(1 << 63)
    for t in range(min(trees, TREES)):
        order[t, t * DEPTH : (t + 1) * DEPTH] = np.arange(DEPTH, dtype=np.uint64)
    return np.argsort(order, axis=1, kind="stable")[:, :depth]


def prefixes(sigs: np.ndarray, depth: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each signature's prefix of ``depth`` values in each tree, and of the one ``STEP`` values longer."""
    way = paths(trees, depth + STEP)
    h = np.broadcast_to(mix(np.arange(1, trees + 1, dtype=np.uint64)), (len(sigs), trees))
    for k in range(depth + STEP):
        if k == depth:
            short = h
        h = mix((h ^ sigs[:, way[:, k]]) + np.uint64(0x9E3779B97F4A7C15))
    return short, h


def level(nodes: DataFrame, depth: int, trees: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """(key, node, n): nodes of each prefix shared by two or more that is worked on here, and (node): those that go on.

    Of prefixes with the same nodes one is kept.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 4096):
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, TREES * DEPTH).astype(np.uint64)
            key, child = prefixes(sigs, depth, trees)
            node = np.repeat(b.column("node").to_numpy(zero_copy_only=False), trees)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.ravel().view(np.int64), child.ravel().view(np.int64), node)], ["key", "child", "node"])

    keyed = with_python(nodes.select("node", "sig")).mapInArrow(spread, "key long, child long, node long")
    # Sets of nodes are told apart by their size and 128 bits.
    marks = [f"x{k}" for k in (3, 4)]
    by_child = keyed.groupBy("key", "child").agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (3, 4)))
    sets = by_child.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("same"), *(F.bit_xor(x).alias(x) for x in marks)).filter("n > 1")
    loose = F.lit(False) if last else (F.col("n") > BUCKET_NODES) & (F.col("same") < TIGHT * F.col("n").cast("double") * F.col("n"))
    one = sets.groupBy("n", *marks).agg(F.min(F.struct(loose.alias("loose"), "key")).alias("m"))
    members = written(keyed.select("key", "node").join(written(one.select("m.key", "n", "m.loose")), "key"))
    return members.filter("not loose").drop("loose"), members.filter("loose").select("node").distinct()


def meet(rows: pa.Table) -> pa.Table:
    """(src, dst): a spanning forest of the nodes in each bucket of a unit whose signatures do not rule similarity out."""
    size = TREES * DEPTH
    key, node, block = (rows[k].to_numpy() for k in ("key", "node", "block"))
    sigs = np.frombuffer(b"".join(rows["sig"].to_pylist()), "<u2").reshape(-1, size)
    order = np.lexsort((node, key))
    key, node, block, sigs = key[order], node[order], block[order], sigs[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(start, len(key)))
    a, b = rows["i"][0].as_py(), rows["j"][0].as_py()
    two = start[n == 2]
    if a != b:  # pairs within a block have a unit of their own
        two = two[block[two] != block[two + 1]]
    two = two[(sigs[two] == sigs[two + 1]).sum(axis=1) >= RULED_OUT * size]
    src, dst = [node[two + 1]], [node[two]]
    for at, m in zip(start[n > 2].tolist(), n[n > 2].tolist(), strict=True):
        these, columns = slice(at, at + m), np.ascontiguousarray(sigs[at : at + m].T)
        same = np.zeros((m, m), np.uint8)
        for c in columns:
            same += c[:, None] == c[None, :]
        yes = same >= RULED_OUT * size
        if a != b:
            yes &= block[these][:, None] != block[these][None, :]
        low = roots(yes, node[these])
        src.append(node[these][low != node[these]])
        dst.append(low[low != node[these]])
    return pa.Table.from_pydict({"src": np.concatenate(src), "dst": np.concatenate(dst)}, schema=pa.schema([("src", pa.int64()), ("dst", pa.int64())]))


def candidates(nodes: DataFrame, recall: float = RECALL) -> DataFrame:
    """(src, dst): a spanning forest of the nodes that may be linked or lie on the way between linked ones."""
    at, found = nodes.select("node", "sig"), []
    every = levels(recall)
    for k, (depth, trees) in enumerate(every):
        here, crowded = level(at, depth, trees, k == len(every) - 1)
        found.append(compared(here, at))
        if k == len(every) - 1 or crowded.isEmpty():
            break
        at = written(at.join(crowded, "node", "left_semi"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def compared(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): a spanning forest within each bucket of (key, node, n)."""
    members = members.withColumn("blocks", F.ceil(F.col("n") / BUCKET_NODES).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))
    small = members.filter("blocks = 1").count()
    signed_ones = members.join(nodes, "node")
    bins = max(parts(nodes.sparkSession), -(-small // UNIT_ROWS))
    whole, paired = units_of("key", bins)
    dealt = signed_ones.select("key", "node", "block", "sig", F.explode(F.when(F.col("blocks") == 1, whole).otherwise(paired)).alias("u"))
    dealt = with_python(dealt.select("u.*", "key", "node", "block", "sig"))
    return dealt.groupBy("shared", "unit", "i", "j").applyInArrow(meet, "src long, dst long")


def units_of(group: str, bins: int) -> tuple[Column, Column]:
    """Where a row is worked on: small groups share units; a block of a large one meets every block."""
    whole = F.array(F.struct(F.pmod(F.xxhash64(group), F.lit(bins)).alias("unit"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("shared")))
    paired = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col(group).alias("unit"), F.least("block", k).alias("i"), F.greatest("block", k).alias("j"), F.lit(False).alias("shared")))
    return whole, paired


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share, as a matrix built over slices of the values that occur in two sets or more."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = n >= 2
    number = np.cumsum(shared) - 1
    keep = shared[at]
    column, owner = number[at[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total, width = int(shared.sum()), max(64, 4_000_000 // m)
    out = np.zeros((m, m), np.int64)
    for lo in range(0, total, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        dense = np.zeros((m, width), np.float32)
        dense[owner[i:j], column[i:j] - lo] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def linked(sets: list[np.ndarray]) -> np.ndarray:
    both = intersections(sets)
    n = np.array([len(s) for s in sets], np.int64)
    yes = THRESHOLD[1] * both >= THRESHOLD[0] * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(yes, False)
    return yes


def roots(yes: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name each member reaches."""
    low = names.copy()
    while True:
        reach = np.where(yes, low[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(low, reach)
        if (new == low).all():
            return low
        low = new


def verify(rows: pa.Table) -> pa.Table:
    """(node, links, root): of each node in a unit, the copies of what it is linked to there and a linked root."""
    group = rows["comp"].to_numpy()
    node, block, copies = (rows[k].to_numpy() for k in ("node", "block", "copies"))
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()]
    # A node comes once, even if its row was repeated.
    order = np.lexsort((node, group))
    order = order[np.concatenate([[True], np.diff(node[order]) != 0])] if len(order) else order
    a, b = rows["i"][0].as_py(), rows["j"][0].as_py()
    out: list[list] = [[], [], []]
    for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(at) > 1:
            yes = linked([sets[k] for k in at])
            if a != b:  # pairs within a block have a unit of their own
                yes &= block[at][:, None] != block[at][None, :]
            for column, x in zip(out, (node[at], yes @ copies[at], roots(yes, node[at])), strict=True):
                column += x.tolist()
    return pa.Table.from_pydict({"node": out[0], "links": out[1], "root": out[2]}, schema=pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))


def similar(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_key, class_id, class_node, n_links) of every row of (doc_id, text).

    class_id is the smallest id of the class, class_node names the class where ids are null or repeated (null for rows
    without shingles), n_links counts the other documents that are similar, copies included.
    """
    spark = docs.sparkSession
    rows = written(signed(docs))
    named = rows.filter("node is not null")
    nodes = named.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n", "sig")).alias("m"))
    nodes = written(nodes.select("node", "copies", F.col("m.doc_id").alias("first_id"), F.col("m.text_key").alias("text_key"), F.col("m.n").alias("n"), F.col("m.sig").alias("sig")))
    edges = written(candidates(nodes, recall))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    groups = connected_components(ends, edges)
    members = written(groups.join(nodes.select(F.col("node").alias("id"), "copies", "first_id", "text_key", "n"), "id"))
    sizes = members.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_NODES), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"), F.sum("n").alias("total"))
    small = sizes.filter("blocks = 1").agg(F.sum("total").alias("n")).first()
    bins = max(parts(spark), -(-(small.n or 0) // BLOCK_SHINGLES))
    dealt = members.join(sizes.select("component", "blocks"), "component").withColumn("block", F.pmod(F.xxhash64(F.lit(2), "id"), F.col("blocks")).cast("int"))
    whole, paired = units_of("component", bins)
    dealt = dealt.select(F.col("id").alias("node"), F.col("component").alias("comp"), "copies", "first_id", "text_key", "block", F.when(F.col("blocks") == 1, whole).otherwise(paired).alias("units"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_kept()
        for b in rows_of(batches):
            sets = pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("node", "comp", "copies", "block", "units")), sets], ["node", "comp", "copies", "block", "units", "shingles"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    # The same plan at every size: a broadcast of few members would turn into a shuffle of texts as they grow.
    met = texts.join(dealt.hint("merge"), (texts["key"] == dealt["text_key"]) & texts["doc_id"].eqNullSafe(dealt["first_id"]))
    unit = "array<struct<unit:long,i:int,j:int,shared:boolean>>"
    spelt = with_python(met.select("node", "comp", "copies", "block", "units", "text")).mapInArrow(spell, f"node long, comp long, copies long, block int, units {unit}, shingles binary")
    spelt = spelt.withColumn("u", F.explode("units")).select("u.*", "node", "comp", "copies", "block", "shingles")
    found = written(spelt.groupBy("shared", "unit", "i", "j").applyInArrow(verify, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    firm = found.filter("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")).distinct()
    classes = connected_components(found.select(F.col("node").alias("id")).distinct(), firm).select(F.col("id").alias("node"), "component")
    of_node = nodes.select("node", "copies", "first_id").join(links, "node", "left").join(classes, "node", "left")
    of_node = of_node.select("node", F.coalesce("component", "node").alias("class_node"), "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    least = of_node.groupBy("class_node").agg(F.min("first_id").alias("class_id"))
    of_node = of_node.join(least, "class_node").select(F.col("node").alias("of"), "class_node", "class_id", "links")
    out = rows.join(of_node, rows["node"] == of_node["of"], "left")
    return out.select("doc_id", "text_key", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_node", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the smallest id of each class; rows without shingles stay.

    Of repeated rows of that id one stays.
    """
    found = similar(docs.select("doc_id", "text"), **options).filter("class_node is not null and doc_id <=> class_id")
    keep = found.groupBy("class_node").agg(F.min(F.struct("doc_id", "text_key")).alias("m")).select(F.col("m.doc_id").alias("__id"), F.col("m.text_key").alias("__key"))
    d = docs.withColumn("__text", F.xxhash64("text"))
    without = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"^[\x20\x09-\x0D]*$")) > 0
    kept = d.filter(~without).join(keep, d["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text"]).unionByName(d.filter(without)).select(*docs.columns)
