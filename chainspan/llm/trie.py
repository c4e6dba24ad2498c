"""The trie of the prefixes of conversations, from range minima over sorted common prefixes.

A conversation is the sequence of its turns' 128-bit hashes. All conversations are sorted; ``lcp[i]`` is how many turns
conversation i shares with the one before it. The members of the depth-d prefix of conversation i are then the interval
around i in which no ``lcp`` is below d. A sparse table answers range minima in one step, so each candidate prefix finds
the left and the right end of its interval by two binary searches, on its own: no stack, no order among the candidates.
Candidates are the prefixes at which neighbours part and those at which conversations end; prefixes in between have the
interval of the next candidate below them and are written out from it. Everything else is a difference of prefix sums:
the members, the childless nodes (ends of conversations that no next one continues), and the bytes of repeated turns
(those each conversation shares with the one before it, less what lies above the node).

The sorted conversations lie in blocks of bounded size, each worked on by itself. Prefixes that hold neither the first nor
the last conversation of a block are settled there. What is left of a block are the places where the least common prefix
seen from an end of the block falls: few rows, as many as there are such depths. The same search over these rows of all
blocks, in one task, settles the rest. A block of t turns leaves at most about 2 * sqrt(2t) rows, and usually some ten.

The hash of the members that end at a node is a running hash over their ids in order. Within a block it is made at once;
for equal conversations that cross blocks each block hands on its ids as text in pieces, which one task reads in order.

Results in edge cases: rows without a conversation id belong to none. Null roles and texts are empty. Turns of the same
number are taken in the order of their hash. Repeated rows are repeated turns. An empty table has no nodes, not even a
root. Other columns are left aside. Each conversation is held as the hashes and sizes of its turns, never as texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainspan.llm.common import with_python
from chainspan.session import written

#: A block ends after so many conversations or turns.
BLOCK_ROWS, BLOCK_TURNS = 200_000, 1_000_000
#: Ids in one piece of text, and nodes in one batch.
PIECE_IDS, BATCH_NODES = 1_000, 50_000
EMPTY = hashlib.sha256(b"").hexdigest()
_NONE = np.iinfo(np.int64).max
FIRST, LAST = 1, 2


def rebuilt(turns: DataFrame, family: int = 5, shared: int = 9) -> DataFrame:
    """(conv_id, path, sizes): each conversation begins with the first turns of the first of its family of five, as many
    as a checksum of its id says, and goes on with its own. ``path`` has 16 bytes for each turn, ``sizes`` its text's bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32))
    turn = F.struct(F.col("turn").isNotNull().alias("dated"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    head = F.col("conv_id") - F.col("conv_id") % family
    given = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", head.alias("head"), turn.alias("one"))
    own = given.repartition("head").groupBy("head", "conv_id").agg(F.array_sort(F.collect_list("one")).alias("own"))
    lent = F.max(F.when(F.col("conv_id") == F.col("head"), F.slice("own", 1, shared - 1))).over(W.partitionBy("head"))
    both = own.select("conv_id", "own", F.coalesce(lent, F.array().cast(own.schema["own"].dataType)).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    both = both.select("conv_id", F.concat(F.slice("lent", F.lit(1), h), F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))).alias("all"))
    path = F.unhex(F.array_join(F.transform("all", lambda t: t["digest"]), ""))
    return both.select("conv_id", path.alias("path"), F.transform("all", lambda t: t["size"]).alias("sizes"))


class Minima:
    """Range minima of an array: row k of the table has the minima of all runs of 2^k values."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of each closed range."""
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for j in np.unique(k):
            at = k == j
            row = self.rows[j]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(j)) + 1])
        return out

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The furthest place to the left that all values after it, up to ``at``, let pass."""
        p = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            to = p - (1 << k)
            ok = to >= 0
            ok[ok] = self.rows[k][to[ok] + 1] >= depth[ok]
            p[ok] = to[ok]
        return p

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The furthest place to the right, all values after ``at`` up to it let pass."""
        p, n = at.copy(), len(self.rows[0])
        for k in range(len(self.rows) - 1, -1, -1):
            to = p + (1 << k)
            ok = to < n
            ok[ok] = self.rows[k][p[ok] + 1] >= depth[ok]
            p[ok] = to[ok]
        return p


@dataclass
class Rows:
    """Neighbouring conversations, or groups of them, in order. A group stands for its first one towards its left."""

    lcp: np.ndarray  # turns shared with the conversation before
    n: np.ndarray  # conversations
    conv: np.ndarray  # the smallest id
    shared: np.ndarray  # bytes of the turns that the first one shares with the one before
    inner: np.ndarray  # bytes that the others share each with the one before
    leaves: np.ndarray  # conversations that the next one does not continue
    least: np.ndarray  # the least lcp within the group
    fresh: np.ndarray  # conversations within the group that have it and go on
    goes_on: np.ndarray  # whether the first one has turns it does not share with the one before
    length: np.ndarray  # turns of the first one
    base: np.ndarray  # depth of the first of its known byte counts
    cum: np.ndarray  # byte counts up to each depth, row after row
    cum_at: np.ndarray  # where each row's begin


@dataclass
class Nodes:
    lo: np.ndarray
    hi: np.ndarray
    depth: np.ndarray
    above: np.ndarray  # depth of the next candidate above
    n: np.ndarray
    conv: np.ndarray
    leaves: np.ndarray
    children: np.ndarray
    shared: np.ndarray  # bytes that members share with the ones before them
    up_lo: np.ndarray  # interval of the candidate above
    up_hi: np.ndarray
    up_conv: np.ndarray


def intervals(r: Rows, at: np.ndarray, depth: np.ndarray, lcp: Minima) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, depth) of the candidates' intervals, each once."""
    lo, hi = lcp.left(at, depth), lcp.right(at, depth)
    order = np.lexsort((depth, lo))
    lo, hi, depth = lo[order], hi[order], depth[order]
    one = np.ones(len(lo), bool)
    one[1:] = (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])
    return lo[one], hi[one], depth[one]


def nodes(r: Rows, at: np.ndarray, depth: np.ndarray, whole: bool) -> Nodes:
    """The nodes of the candidates (place, depth); those that hold an end of the rows only where the rows are ``whole``."""
    m = len(r.n)
    lcp, conv = Minima(r.lcp), Minima(r.conv)
    lo, hi, depth = intervals(r, at, depth, lcp)
    if not whole:
        inside = (lo > 0) & (hi < m - 1)
        lo, hi, depth = lo[inside], hi[inside], depth[inside]
    after = np.append(r.lcp, -1)
    above = np.maximum(np.where(lo > 0, r.lcp[lo], -1), after[hi + 1])
    above = np.where(depth > 0, np.maximum(above, 0), -1)
    up = np.maximum(above, 0)
    up_lo, up_hi = lcp.left(lo, up), lcp.right(lo, up)
    sums = lambda v: np.concatenate([[0], np.cumsum(v)])
    n, leaves, both = sums(r.n), sums(r.leaves), sums(r.shared + r.inner)
    # Children begin where a conversation goes on from exactly this depth; the first one's own, where it is longer.
    values = np.concatenate([r.lcp[1:], r.least])
    places = np.concatenate([2 * np.arange(1, m), 2 * np.arange(m) + 1])
    weights = np.concatenate([r.goes_on[1:], r.fresh])
    used = values != _NONE
    key = values[used] * (2 * m + 2) + places[used]
    order = np.argsort(key, kind="stable")
    key, total = key[order], sums(weights[used][order])
    begins = lambda place: total[np.searchsorted(key, depth * (2 * m + 2) + place, side="right")]
    children = (r.length[lo] > depth) + begins(2 * hi + 1) - begins(2 * lo)
    return Nodes(
        lo, hi, depth, above, n[hi + 1] - n[lo], conv.least(lo, hi), leaves[hi + 1] - leaves[lo], children,
        both[hi + 1] - both[lo] - r.shared[lo], up_lo, up_hi, conv.least(up_lo, up_hi),
    )


_SCHEMA = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "block long, side int, place int, lcp long, shared long, inner long, least long, fresh long, length long, base long, cum array<long>, path binary, ids string"
)
NODE, ROW, PIECE, ANSWER, RUN = range(5)
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_COLUMNS = {c: _TYPES[t] for c, t in (x.split(" ") for x in _SCHEMA.split(", "))}


def _batch(n: int, **given) -> pa.RecordBatch:
    arrays = []
    for c, t in _COLUMNS.items():
        v = given.get(c)
        arrays.append(pa.nulls(n, t) if v is None else v if isinstance(v, pa.Array) else pa.array(v, t) if np.ndim(v) else pa.array(np.full(n, v), t))
    return pa.RecordBatch.from_arrays(arrays, list(_COLUMNS))


def _written_out(r: Rows, f: Nodes, ends: list[str], end_of: np.ndarray, **more) -> Iterator[pa.RecordBatch]:
    """All nodes, also those between a candidate and the one above it. ``more`` has columns for the topmost of each."""
    texts = pa.array([*ends, EMPTY], pa.string())
    count = f.depth - f.above
    stops = np.cumsum(count)
    begin = 0
    while begin < len(count):
        done = stops[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(stops, done + BATCH_NODES)))
        some = slice(begin, end)
        k = np.repeat(np.arange(begin, min(end, len(count))), count[some])
        depth = f.above[k] + 1 + np.arange(len(k)) - np.repeat(stops[some] - count[some] - done, count[some])
        top, bottom = depth == f.above[k] + 1, depth == f.depth[k]
        over = r.cum[np.where(depth > 0, r.cum_at[f.lo[k]] + depth - 1 - r.base[f.lo[k]], 0)]
        saved = f.shared[k] - (f.n[k] - 1) * np.where(depth > 0, over, 0)
        parent = np.where(top, f.up_conv[k], f.conv[k])
        own = bottom & (r.length[f.lo[k]] == depth)
        extra = {c: pa.array(v[k], _COLUMNS[c], mask=~top | (v[k] < 0)) if c != "place" else pa.array(v[k], _COLUMNS[c], mask=~own | (v[k] < 0)) for c, v in more.items()}
        unknown = depth == 0
        if "side" in more:
            unknown = unknown | (top & (more["side"][k] >= 0))
        yield _batch(
            len(k), kind=NODE, conv_id=f.conv[k], depth=depth, parent_conv_id=pa.array(parent, pa.int64(), mask=unknown), n_convs=f.n[k],
            n_children=np.where(bottom, f.children[k], 1), n_leaves=f.leaves[k], saved_tokens=saved,
            ends_sha256=texts.take(pa.array(np.where(own, end_of[f.lo[k]], len(ends)))), **extra,
        )
        begin = end


def _pairs(flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many leading turns each conversation shares with the one before; the first shares none that is known."""
    m = np.minimum(length[1:], length[:-1])
    out = m.copy()
    seg = np.repeat(np.arange(len(m)), m)
    pos = np.arange(len(seg)) - np.repeat(np.cumsum(m) - m, m)
    apart = np.flatnonzero((flat[at[1:][seg] + pos] != flat[at[:-1][seg] + pos]).any(axis=1))
    which, first = np.unique(seg[apart], return_index=True)
    out[which] = pos[apart[first]]
    return np.concatenate([[0], out])


def _settled(block: int, conv: np.ndarray, paths: list[bytes], sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes inside one block, and what is left of it."""
    length = np.fromiter((len(p) // 16 for p in paths), np.int64, len(paths))
    flat = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    at = np.cumsum(length) - length
    lcp = _pairs(flat, at, length)
    same = np.zeros(len(conv), bool)
    same[1:] = (lcp[1:] == length[1:]) & (length[1:] == length[:-1])
    head = np.flatnonzero(~same)
    m = len(head)
    stops = np.append(head, len(conv))
    n, lcp, length, at = np.diff(stops), lcp[head], length[head], at[head]
    # Bytes up to each depth of each distinct conversation, 0 first.
    cum_at = np.cumsum(length + 1) - (length + 1)
    seg = np.repeat(np.arange(m), length)
    own = np.zeros(int((length + 1).sum()), np.int64)
    pos = np.arange(len(seg)) - np.repeat(np.cumsum(length) - length, length)
    own[cum_at[seg] + pos + 1] = sizes[at[seg] + pos]
    cum = np.cumsum(own)
    cum -= np.repeat(cum[cum_at], length + 1)
    leaves = np.append(lcp[1:] < length[:-1], False).astype(np.int64)  # of the last one the next block decides
    known = np.ones(m, np.int64)
    r = Rows(
        lcp, n, conv[head], np.where(np.arange(m) > 0, cum[cum_at + lcp], 0), (n - 1) * cum[cum_at + length], leaves,
        np.full(m, _NONE), np.zeros(m, np.int64), known, length, np.zeros(m, np.int64), cum, cum_at,
    )
    text = lambda i: ",".join(map(str, conv[stops[i] : stops[i + 1]].tolist()))
    ends = [hashlib.sha256(text(i).encode()).hexdigest() if 0 < i < m - 1 else "" for i in range(m)]
    every = np.arange(m)
    f = nodes(r, np.concatenate([every[1:], every]), np.concatenate([lcp[1:], length]), whole=False)
    side = np.where(f.up_lo == 0, FIRST, np.where(f.up_hi == m - 1, LAST, -1))
    yield from _written_out(r, f, ends, every, side=side, block=np.where(side >= 0, block, -1))
    # What is left: rows begin where the least lcp seen from either end falls.
    keep = np.zeros(m, bool)
    keep[[0, m - 1]] = True
    if m > 1:
        least = np.minimum.accumulate(lcp[1:])
        keep[1:] |= np.concatenate([[True], lcp[2:] < least[:-1]])
        least = np.minimum.accumulate(lcp[:0:-1])[::-1]
        keep[1:] |= np.concatenate([lcp[1:-1] < least[1:], [True]])
    begin = np.flatnonzero(keep)
    within = np.where(keep, _NONE, lcp)
    low = np.minimum.reduceat(within, begin)
    group = np.cumsum(keep) - 1
    total = lambda v: np.add.reduceat(v, begin)
    inner = total(r.shared + r.inner) - r.shared[begin]
    fresh = total(((within == low[group]) & ~keep).astype(np.int64))
    edge = np.where(begin == 0, FIRST, 0) + np.where(begin == m - 1, LAST, 0)
    further = np.append(lcp[begin[1:]], 0)
    base = np.where(edge > 0, 0, lcp[begin])
    top = np.where(edge > 0, length[begin], np.maximum(base, further))
    yield _batch(
        len(begin), kind=ROW, block=block, place=np.arange(len(begin)), side=edge, lcp=lcp[begin], n_convs=total(n), conv_id=np.minimum.reduceat(r.conv, begin),
        shared=r.shared[begin], inner=inner, n_leaves=total(leaves), least=low, fresh=fresh, length=length[begin], base=base,
        cum=pa.array([cum[cum_at[b] + lo : cum_at[b] + hi + 1] for b, lo, hi in zip(begin, base, top, strict=True)], _COLUMNS["cum"]),
        path=pa.array([paths[head[b]] if e else None for b, e in zip(begin, edge, strict=True)], pa.binary()),
        ends_sha256=pa.array([ends[b] for b in begin], pa.string()),
    )
    for i in sorted({0, m - 1}):
        ids = conv[stops[i] : stops[i + 1]].tolist()
        pieces = [",".join(map(str, ids[k : k + PIECE_IDS])) for k in range(0, len(ids), PIECE_IDS)]
        for k in range(0, len(pieces), 64):
            some = pieces[k : k + 64]
            yield _batch(len(some), kind=PIECE, block=block, side=FIRST if i == 0 else LAST, place=np.arange(k, k + len(some)), ids=pa.array(some, pa.string()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations (chunk, conv_id, path, sizes), a block at a time."""
    convs, paths, sizes, turns, number, chunk = [], [], [], 0, 0, 0

    def settle() -> Iterator[pa.RecordBatch]:
        yield from _settled((chunk << 32) + number, np.concatenate(convs), list(paths), np.concatenate(sizes))

    for whole in batches:
        for lo in range(0, whole.num_rows, min(1_000, BLOCK_ROWS)):
            b = whole.slice(lo, min(1_000, BLOCK_ROWS))
            chunk = b.column("chunk")[0].as_py()
            convs.append(b.column("conv_id").to_numpy(zero_copy_only=False))
            paths += b.column("path").to_pylist()
            sizes.append(b.column("sizes").flatten().to_numpy(zero_copy_only=False))
            turns += len(sizes[-1])
            if len(paths) >= BLOCK_ROWS or turns >= BLOCK_TURNS:
                yield from settle()
                convs, paths, sizes, turns, number = [], [], [], 0, number + 1
    if paths:
        yield from settle()


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that hold ends of blocks, from what is left of all blocks in order.

    Also tells each block the ids of its open nodes, and which equal conversations at ends of blocks go together.
    """
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    ints = lambda c: t.column(c).to_numpy()
    side, block, length, lcp = ints("side"), ints("block"), ints("length"), ints("lcp").copy()
    m = len(side)
    lists = t.column("cum").combine_chunks()
    cum, cum_at = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
    cum_at = np.cumsum(cum_at) - cum_at
    edges = np.flatnonzero(side > 0)
    starts = np.flatnonzero(side & FIRST)
    paths = dict(zip(edges.tolist(), (t.column("path")[int(i)].as_py() for i in edges), strict=True))
    for i in starts[1:].tolist():
        two = [paths[i - 1], paths[i]]
        lens = np.array([len(p) // 16 for p in two])
        lcp[i] = _pairs(np.frombuffer(b"".join(two), np.uint64).reshape(-1, 2), np.cumsum(lens) - lens, lens)[1]
    shared, leaves = ints("shared").copy(), ints("n_leaves").copy()
    shared[starts] = cum[cum_at[starts] + lcp[starts]]
    lcp[0], shared[0] = -1, 0
    ends = np.flatnonzero(side & LAST)
    leaves[ends] += np.append(lcp, -1)[ends + 1] < length[ends]
    goes_on = np.where((side & FIRST) > 0, length > lcp, True).astype(np.int64)
    r = Rows(lcp, ints("n_convs"), ints("conv_id"), shared, ints("inner"), leaves, ints("least"), ints("fresh"), goes_on, length, ints("base"), cum, cum_at)
    every = np.arange(m)
    at = np.concatenate([every[1:], edges, [0]])
    f = nodes(r, at, np.concatenate([lcp[1:], length[edges], [0]]), whole=True)
    # Equal conversations at neighbouring ends of blocks are one run, named by the row it begins at.
    joined = np.zeros(m, bool)
    joined[1:] = (side[1:] > 0) & (side[:-1] > 0) & (lcp[1:] == length[1:]) & (length[1:] == length[:-1])
    run = np.maximum.accumulate(np.where(joined, 0, every))
    yield from _written_out(r, f, t.column("ends_sha256").to_pylist(), every, place=np.where(side[f.lo] > 0, f.lo, -1))
    one = np.where(side[edges] & FIRST, FIRST, LAST)
    yield _batch(len(edges), kind=RUN, block=block[edges], side=one, place=run[edges])
    inner = np.flatnonzero((side & FIRST) == 0)
    table = Minima(lcp)
    lo, hi = table.left(inner, lcp[inner]), table.right(inner, lcp[inner])
    begin = np.maximum.accumulate(np.where(side & FIRST, every, 0))[inner]
    if len(inner):
        yield _batch(len(inner), kind=ANSWER, block=block[inner], side=np.where(lo <= begin, FIRST, LAST), depth=lcp[inner] + 1, conv_id=Minima(r.conv).least(lo, hi))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each run's pieces, which come in order."""
    run, sha = None, hashlib.sha256()
    for b in batches:
        out = []
        for r, ids in zip(b.column("run").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if r != run:
                if run is not None:
                    out.append((run, sha.hexdigest()))
                run, sha = r, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out])], ["run", "sha"])
    if run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([sha.hexdigest()])], ["run", "sha"])


OUTPUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, path, sizes): one row each, in the columns of ``OUTPUT``."""
    by = ("path", "conv_id")
    order = with_python(conversations).repartitionByRange(*by).sortWithinPartitions(*by)
    order = order.select(F.spark_partition_id().cast("long").alias("chunk"), "conv_id", "path", "sizes")
    made = written(order.mapInArrow(_blocks, _SCHEMA))
    left = made.filter(F.col("kind") == ROW).repartition(1).sortWithinPartitions("block", "place")
    rest = written(left.mapInArrow(_rest, _SCHEMA))
    runs = rest.filter(F.col("kind") == RUN).select("block", "side", F.col("place").alias("run"))
    pieces = made.filter(F.col("kind") == PIECE).select("block", "side", "place", "ids").join(runs, ["block", "side"])
    pieces = pieces.repartition("run").sortWithinPartitions("run", "block", "side", "place").select("run", "ids")
    ends = pieces.mapInArrow(_hashed, "run int, sha string")
    open_nodes = rest.filter(F.col("kind") == NODE)
    settled = open_nodes.filter("place is null").select(*OUTPUT)
    ended = open_nodes.filter("place is not null").join(ends, F.col("place") == F.col("run"), "left").withColumn("ends_sha256", F.col("sha")).select(*OUTPUT)
    told = rest.filter(F.col("kind") == ANSWER).select("block", "side", "depth", F.col("conv_id").alias("up")).distinct()
    inside = made.filter(F.col("kind") == NODE)
    closed = inside.filter("side is null").select(*OUTPUT)
    top = inside.filter("side is not null").join(told, ["block", "side", "depth"], "left").withColumn("parent_conv_id", F.col("up")).select(*OUTPUT)
    return closed.unionByName(top).unionByName(settled).unionByName(ended)
