"""Ordered layouts: how anything that depends on event order is spread over a cluster.

A window over ``PARTITION BY computer`` sends every event of one computer to one task, and one computer may hold a
third of a case. Here the events are range-partitioned by (bucket keys, time, id) instead: each partition is one
contiguous run of that order, a large bucket simply spans several partitions, and many small buckets share one.
The layout is written once (``durable``), so every later pass sees the same runs.

A pass walks each run as a stream of Arrow batches and keeps only its own small state. Where a bucket continues from
one run into the next, the state at the seam is composed from one summary row per run. These rows stay in tables: they
are composed in groups on the executors, and each run's state is joined to its blocks by the number of the run.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainspan.session import durable, ship_package, written


# Rows per stored block: large enough that a pass pays per block, small enough to hold a few in a worker.
BLOCK_ROWS = 65_536

Batches = Iterator[pa.RecordBatch]


#: States of all runs together, in bytes, up to which they are sent to every executor instead of being shuffled to the runs.
SENT_BYTES = 32 << 20


@dataclass(frozen=True)
class Layout:
    df: DataFrame  # (chunk, seq, rows, block): the sorted rows of each run as Arrow blocks, in order
    schema: T.StructType  # columns inside the blocks: keys, order columns, carried columns, chunk
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def runs(self) -> int:
        return self.df.rdd.getNumPartitions()

    def scan(self, walk: Callable[..., Batches], schema, states: DataFrame | None = None, state_bytes: int = 256) -> DataFrame:
        """Run ``walk`` over the ordered batches of every run.

        With ``states`` (chunk, states), ``walk`` also gets what its run begins with: a dict, number to decoded JSON. States
        of ``state_bytes`` a run go to the executors as they are where that is little for all runs; otherwise the blocks are
        dealt out by run, next to their states, and put in order again.
        """
        df = self.df
        if states is not None and self.runs * state_bytes <= SENT_BYTES:
            df = df.join(F.broadcast(states), "chunk", "left")
        elif states is not None:
            df = df.join(states.hint("merge"), "chunk", "left").sortWithinPartitions("chunk", "seq")
        return df.mapInArrow(_over_blocks(walk, states is not None), schema)


def _over_blocks(walk: Callable[..., Batches], with_states: bool) -> Callable[[Batches], Batches]:
    def stored_rows(stored: Batches) -> Iterator[tuple]:
        for b in stored:
            states = b.column("states") if with_states else None
            for i, chunk in enumerate(b.column("chunk").to_pylist()):
                yield chunk, b.column("block")[i], states[i] if with_states else None

    def unpacked(rows: Iterator[tuple]) -> Batches:
        for _, block, _ in rows:
            with pa.ipc.open_stream(block.as_buffer()) as blocks:
                yield from blocks

    def over(stored: Batches) -> Batches:
        for _, rows in groupby(stored_rows(stored), key=lambda r: r[0]):
            first = next(rows)
            batches = unpacked(chain([first], rows))
            if with_states:
                yield from walk(batches, {j: json.loads(v) for j, v in first[2].as_py() or ()})
            else:
                yield from walk(batches)

    return over


def _into_blocks(batches: Batches) -> Batches:
    """Sorted rows to blocks. A pass over blocks hands Python whole buffers instead of converting row by row."""
    held: list[pa.RecordBatch] = []
    seq = 0

    def flush() -> pa.RecordBatch:
        nonlocal seq
        whole = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole[0].schema) as out:
            for b in whole:
                out.write_batch(b)
        rows = sum(b.num_rows for b in held)
        chunk = held[0].column("chunk")[0].as_py()
        held.clear()
        seq += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int32()), pa.array([seq], pa.int32()), pa.array([rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()])],
            names=["chunk", "seq", "rows", "block"],
        )

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK_ROWS:
            yield flush()
    if held:
        yield flush()


def ordered_layout(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str] = ()) -> Layout:
    """Range-partition and sort ``df`` by keys then order, keep only the named columns, number the runs.

    Keys must not be NULL. The number of runs follows ``spark.sql.shuffle.partitions``; adaptive execution merges
    small ones, which keeps runs contiguous.
    """
    ship_package(df.sparkSession)
    by = [F.col(c) for c in (*keys, *order)]
    out = (
        df.select(*keys, *order, *carry)
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("chunk", F.spark_partition_id())
    )
    blocks = out.mapInArrow(_into_blocks, "chunk int, seq int, rows bigint, block binary")
    return Layout(durable(blocks), out.schema, tuple(keys), tuple(order))


def bucket_starts(batch: pa.RecordBatch, keys: Sequence[str], previous: tuple | None) -> np.ndarray:
    """Row by row: does a new bucket start here? ``previous`` holds the keys of the row before the batch."""
    n = batch.num_rows
    starts = np.zeros(n, dtype=bool)
    if not keys:
        starts[0] = previous is None
        return starts
    for k in keys:
        col = batch.column(k)
        starts[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts[0] = previous is None or previous != keys_at(batch, keys, 0)
    return starts


def keys_at(batch: pa.RecordBatch, keys: Sequence[str], i: int) -> tuple:
    return tuple(batch.column(k)[i].as_py() for k in keys)


class Tail:
    """What a pass remembers about the bucket a run ends in."""

    def start(self, states: dict, whole_bucket: bool) -> None:
        """A bucket begins: inside the run, or before it, with the states the run was given."""
        raise NotImplementedError

    def feed(self, batch: pa.RecordBatch) -> None:
        raise NotImplementedError

    def summary(self) -> list:
        """One value for each thing that is followed, as JSON knows them; None: nothing to say."""
        raise NotImplementedError


SEAM_SCHEMA = "chunk int, first_keys string, last_keys string, single boolean, summary array<string>, given map<int,string>"
_SEAM = pa.schema(
    [
        ("chunk", pa.int32()), ("first_keys", pa.string()), ("last_keys", pa.string()), ("single", pa.bool_()),
        ("summary", pa.list_(pa.string())), ("given", pa.map_(pa.int32(), pa.string())),
    ]
)
_STATES = pa.schema([("chunk", pa.int32()), ("states", pa.map_(pa.int32(), pa.string()))])

#: ``compose(number, summary, begin, single)``: the state after a run that began with ``begin``; None: nothing.
Compose = Callable[[int, object, object, bool], object]


def carried(layout: Layout, make: Callable[[], Tail], compose: Compose, states: DataFrame | None = None) -> DataFrame:
    """(chunk, states): what each run begins with, a map of numbers to JSON.

    A pass over the runs summarises the bucket each of them ends in, one row per run. One task then reads these rows in
    order and composes them, holding one state for each thing that is followed. What a tail says nothing on keeps the
    state it was given in ``states``. The result is written, so that no later pass waits for this one again.
    """
    keys = layout.keys

    def scan(batches: Batches, begin: dict | None = None) -> Batches:
        tail, chunk, first, last, single = make(), None, None, None, True
        for b in batches:
            if b.num_rows == 0:
                continue
            if chunk is None:
                chunk = b.column("chunk")[0].as_py()
                first = last = keys_at(b, keys, 0)
                tail.start(begin or {}, whole_bucket=False)
            starts = bucket_starts(b, keys, last)
            at = np.flatnonzero(starts)
            if at.size:
                # Only the bucket the run ends in matters to the next run; skip straight to it.
                single = False
                tail.start({}, whole_bucket=True)
                b = b.slice(int(at[-1]))
            tail.feed(b)
            last = keys_at(b, keys, b.num_rows - 1)
        if chunk is not None:
            told = [None if v is None else json.dumps(v) for v in tail.summary()]
            given = [(j, json.dumps(v)) for j, v in (begin or {}).items()]
            row = {"chunk": chunk, "first_keys": json.dumps(first), "last_keys": json.dumps(last), "single": single, "summary": told, "given": given}
            yield pa.RecordBatch.from_pylist([row], schema=_SEAM)

    def fold(batches: Batches) -> Batches:
        after: dict[int, object] = {}
        before = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                begin = after if before == r["first_keys"] else {}
                kept = dict(r["given"])
                now = {j: json.dumps(begin[j]) if told is not None else kept[j] for j, told in enumerate(r["summary"]) if (j in begin if told is not None else j in kept)}
                out.append({"chunk": r["chunk"], "states": list(now.items())})
                made = {j: compose(j, json.loads(told), begin.get(j), r["single"]) for j, told in enumerate(r["summary"]) if told is not None}
                after, before = {j: v for j, v in made.items() if v is not None}, r["last_keys"]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_STATES)

    told = layout.scan(scan, SEAM_SCHEMA, states).repartition(1).sortWithinPartitions("chunk")
    return written(told.mapInArrow(fold, "chunk int, states map<int,string>"))


def last_said(number: int, told, begin, single: bool):
    """The composition of "the last one seen": what a run says, else what it began with. A summary is [value] or []."""
    if told:
        return told[0]
    return begin if single else None


def neighbours(layout: Layout, columns: Sequence[str], offset: int = 1) -> DataFrame:
    """LAG (offset -1) or LEAD (offset 1) of ``columns`` within a bucket, as ``<name>_prev`` / ``<name>_next``.

    Equal to the window functions, without gathering a bucket in one task.
    """
    if offset not in (-1, 1):
        raise ValueError("offset must be -1 or 1")
    keys, forward = layout.keys, offset == 1
    suffix = "_next" if forward else "_prev"
    fields = {f.name: f for f in layout.schema.fields}
    extra = [T.StructField(c + suffix, fields[c].dataType, True) for c in columns]
    schema = T.StructType([*layout.schema.fields, *extra])
    states = _edge_rows(layout, columns, forward) if layout.runs > 1 else None
    names = schema.names

    def emit(rows: pa.RecordBatch, other: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, *other], names=names)

    def scan(batches: Batches, begin: dict | None = None) -> Batches:
        # One batch is held back so that its last row can see the first row of the next one.
        beyond = tuple(map(tuple, begin[0])) if begin else None  # keys and values of the row beyond this run
        held: pa.RecordBatch | None = None
        before: tuple | None = None  # keys and values of the row before ``held``
        for b in batches:
            if b.num_rows == 0:
                continue
            if held is None:
                held = b
                before = beyond if not forward else None
                continue
            after = (keys_at(b, keys, 0), keys_at(b, columns, 0))
            yield emit(held, _shifted(held, keys, columns, forward, before, after))
            n = held.num_rows - 1
            before = (keys_at(held, keys, n), keys_at(held, columns, n))
            held = b
        if held is not None:
            after = beyond if forward else None
            yield emit(held, _shifted(held, keys, columns, forward, before, after))

    return layout.scan(scan, schema, states)


def _shifted(b, keys, columns, forward, before, after) -> list[pa.Array]:
    n = b.num_rows
    if forward:
        same_next = np.zeros(n, dtype=bool)
        same_next[:-1] = ~bucket_starts(b, keys, None)[1:]
        edge = after if after is not None and after[0] == keys_at(b, keys, n - 1) else None
        take = np.arange(1, n + 1)
        ok = same_next
        edge_at = n - 1
    else:
        ok = ~bucket_starts(b, keys, None)
        edge = before if before is not None and before[0] == keys_at(b, keys, 0) else None
        take = np.arange(-1, n - 1)
        edge_at = 0
    idx = pa.array(np.where(ok, take, 0), mask=~ok)
    out = []
    for j, c in enumerate(columns):
        col = b.column(c).take(idx)
        if edge is not None:
            one = pa.array([edge[1][j]], type=col.type)
            parts = [col.slice(0, n - 1), one] if edge_at == n - 1 else [one, col.slice(1)]
            col = pa.concat_arrays(parts)
        out.append(col)
    return out


def _edge_rows(layout: Layout, columns: Sequence[str], forward: bool) -> DataFrame:
    """For every run the first row of the run after it (or the last row of the run before it), as its state."""
    keys = layout.keys

    def scan(batches: Batches) -> Batches:
        row = None
        for b in batches:
            if b.num_rows == 0 or (forward and row is not None):
                continue
            i = 0 if forward else b.num_rows - 1
            row = {"chunk": b.column("chunk")[0].as_py(), "edge": json.dumps([keys_at(b, keys, i), keys_at(b, columns, i)])}
        if row is not None:
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("chunk", pa.int32()), ("edge", pa.string())]))

    # One row per run.
    line = W.orderBy("chunk")
    other = F.lead("edge").over(line) if forward else F.lag("edge").over(line)
    edges = layout.scan(scan, "chunk int, edge string").select("chunk", other.alias("edge")).filter("edge is not null")
    return edges.select("chunk", F.create_map(F.lit(0), "edge").alias("states"))


def running_position(layout: Layout, weight: str | None = None) -> DataFrame:
    """Add ``position``: how many rows (or how much ``weight``) come before each row in the layout's order.

    Equal to a running sum over one global window, but only the per-run totals are ever brought together.
    """
    schema = T.StructType([*layout.schema.fields, T.StructField("position", T.LongType())])
    names = schema.names
    states = None

    def _weigh(batches: Batches) -> Batches:
        for b in batches:
            n = pc.sum(b.column(weight)).as_py() or 0
            yield pa.RecordBatch.from_arrays(
                [b.column("chunk").slice(0, 1), pa.array([n], pa.int64())], names=["chunk", "n"]
            )

    if layout.runs > 1:
        if weight is None:
            sums = layout.df.groupBy("chunk").agg(F.sum("rows").alias("n"))
        else:
            sums = layout.scan(_weigh, "chunk int, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))
        # One row per run.
        before = F.sum("n").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
        states = sums.select("chunk", F.create_map(F.lit(0), F.coalesce(before, F.lit(0)).cast("string")).alias("states"))

    def scan(batches: Batches, begin: dict | None = None) -> Batches:
        seen = begin[0] if begin else 0
        for b in batches:
            if b.num_rows == 0:
                continue
            if weight is None:
                w = np.ones(b.num_rows, dtype=np.int64)
            else:
                w = b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = seen + np.cumsum(w)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - w, pa.int64())], names=names)
            seen = int(ends[-1])

    return layout.scan(scan, schema, states)
