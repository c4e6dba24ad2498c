"""Process ancestry through identifier lifetimes.

An identifier is in use from a create event until the next create or the first exit of that identifier, whichever
comes first. So the last create-or-exit event at or before a moment decides: a create is the process alive then, an
exit means nobody was. That is an as-of lookup, done here over an ordered layout of (scope, identifier, time), so an
identifier or a host that holds most of the events is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspan import model
from chainspan.operators.edges import basis_entry, edge_id, match_id, small_side
from chainspan.operators.layout import Layout, Tail, bucket_starts, carried, keys_at, last_said, neighbours, ordered_layout
from chainspan.operators.matching import scope_column
from chainspan.plans.rules import Rule, rules_frame
from chainspan.session import new_folder, written

CREATE, EXIT, PROBE = 0, 1, 2


def subject_pid() -> Column:
    """The process an event is about."""
    return F.coalesce(F.col("new_process_id"), F.col("process_id"))


def creator_pid() -> Column:
    """Its creator: an explicit parent, else the plain identifier when the event also names a new one."""
    return F.coalesce(F.col("parent_process_id"), F.when(F.col("new_process_id").isNotNull(), F.col("process_id")))


def _life_events(events: DataFrame, create_ids: Sequence[str], exit_id: str, scope: str) -> DataFrame:
    is_create = F.col("event_code").isin(*create_ids)
    return (
        events.filter(F.col("ts_ns").isNotNull() & (is_create | (F.col("event_code") == exit_id)))
        .withColumn("kind", F.when(is_create, F.lit(CREATE)).otherwise(F.lit(EXIT)))
        .withColumn("scope", scope_column(scope))
    )


def process_lifetimes(
    events: DataFrame,
    create_ids: Sequence[str] = (model.LINEAGE_CREATE_ID,),
    exit_id: str = model.LINEAGE_EXIT_ID,
    scope: str = "computer",
) -> DataFrame:
    """(scope, pid, id, start_ns, end_ns); end_ns is exclusive and NULL while the process is still running."""
    life = _life_events(events, create_ids, exit_id, scope).withColumn("pid", subject_pid())
    layout = ordered_layout(life.filter(F.col("pid").isNotNull()), ["scope", "pid"], ["ts_ns", "id"], ["kind"])
    return (
        neighbours(layout, ["ts_ns"], 1)
        .filter(F.col("kind") == CREATE)
        .select("scope", "pid", "id", F.col("ts_ns").alias("start_ns"), F.col("ts_ns_next").alias("end_ns"))
    )


class _LastLife(Tail):
    def start(self, states: dict, whole_bucket: bool) -> None:
        self.last: list = []

    def feed(self, batch: pa.RecordBatch) -> None:
        at = np.flatnonzero(batch.column("kind").to_numpy(zero_copy_only=False) < PROBE)
        if at.size:
            self.last = [_life_row(batch, int(at[-1]))]

    def summary(self) -> list:
        return [self.last]


def _life_row(b: pa.RecordBatch, i: int) -> tuple:
    return tuple(b.column(c)[i].as_py() for c in ("kind", "id", "ts_ns", "image"))


_RESOLVED = (
    "rule_ix int, scope string, parent_pid string, child_id bigint, child_ts bigint, child_image string, "
    "parent_id bigint, parent_ts bigint, parent_image string"
)


def _resolve(layout: Layout) -> DataFrame:
    keys = layout.keys
    states = carried(layout, _LastLife, last_said) if layout.runs > 1 else None

    def scan(batches: Iterator[pa.RecordBatch], begin: dict | None = None) -> Iterator[pa.RecordBatch]:
        alive, last_keys, begun = (begin or {}).get(0), None, False
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            if not begun:
                begun = True
                last_keys = keys_at(b, keys, 0)
            starts = bucket_starts(b, keys, last_keys)
            kind = b.column("kind").to_numpy(zero_copy_only=False)
            at = np.arange(n)
            bucket_begin = np.maximum.accumulate(np.where(starts, at, -1))  # -1: bucket of the previous batch
            life = np.maximum.accumulate(np.where(kind < PROBE, at, -1))
            here = (life >= 0) & (life >= bucket_begin)
            from_before = ~here & (bucket_begin < 0)
            probe = kind == PROBE
            found = probe & here & (kind[np.where(here, life, 0)] == CREATE)
            sel = np.flatnonzero(probe)
            if sel.size:
                idx = pa.array(np.where(found, life, 0)[sel], mask=~found[sel])
                parent = [b.column(c).take(idx) for c in ("id", "ts_ns", "image")]
                if alive is not None and alive[0] == CREATE and from_before[sel].any():
                    mask = pa.array(from_before[sel])
                    parent = [pc.if_else(mask, pa.scalar(v, p.type), p) for v, p in zip(alive[1:], parent)]
                rows = pa.array(sel)
                cols = [b.column(c).take(rows) for c in (*keys, "id", "ts_ns", "image")]
                yield pa.RecordBatch.from_arrays(
                    [*cols, *parent],
                    names=[
                        "rule_ix", "scope", "parent_pid", "child_id", "child_ts", "child_image",
                        "parent_id", "parent_ts", "parent_image",
                    ],
                )
            tail_begin = int(bucket_begin[-1])
            lives = np.flatnonzero(kind < PROBE)
            if lives.size and lives[-1] >= tail_begin:
                alive = _life_row(b, int(lives[-1]))
            elif tail_begin >= 0:
                alive = None
            last_keys = keys_at(b, keys, n - 1)

    return layout.scan(scan, _RESOLVED, states)


def resolve_parents(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule and create event that names a creator; parent_* are NULL when nobody with that identifier was
    alive. All rules share one layout and one pass."""

    def entry(ix: int, scope: Column, pid: Column, phase: int, kind: Column) -> Column:
        return F.struct(
            F.lit(ix).alias("rule_ix"), scope.alias("scope"), pid.alias("pid"), F.lit(phase).alias("phase"), kind.alias("kind")
        )

    # At one instant every create and exit comes before any lookup: a lifetime includes its own start.
    entries, codes = [], set()
    for ix, r in enumerate(rules):
        creates = F.col("event_code").isin(*r.create_ids)
        kind = F.when(creates, F.lit(CREATE)).when(F.col("event_code") == r.lineage_exit_id, F.lit(EXIT))
        scope = scope_column(r.match_scope)
        entries.append(entry(ix, scope, subject_pid(), 0, kind))
        entries.append(entry(ix, scope, creator_pid(), 1, F.when(creates, F.lit(PROBE))))
        codes |= {*r.create_ids, r.lineage_exit_id}
    rows = (
        events.filter(F.col("ts_ns").isNotNull() & F.col("event_code").isin(sorted(codes)))
        .select("ts_ns", "id", F.col("process_name").alias("image"), F.explode(F.array(*entries)).alias("e"))
        .select("ts_ns", "id", "image", "e.*")
        .filter(F.col("pid").isNotNull() & F.col("kind").isNotNull())
    )
    return _resolve(ordered_layout(rows, ["rule_ix", "scope", "pid"], ["ts_ns", "phase", "id"], ["kind", "image"]))


def match_lineage(events: DataFrame, rule: Rule) -> tuple[DataFrame, dict]:
    """Parent-to-child edges of one rule (and ancestors when it asks for depth), with its counters."""
    edges, counters = match_lineages(events, [rule])
    return edges, counters[0]


def match_lineages(events: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, list[dict]]:
    """Edges of all rules, and per rule a dict of matches, unresolved and relations."""
    resolved = written(resolve_parents(events, rules))
    counted = resolved.groupBy("rule_ix").agg(
        F.count("parent_id").alias("found"), F.count_if(F.col("parent_id").isNull()).alias("unresolved")
    )
    # One row per rule.
    totals = {r.rule_ix: (r.found, r.unresolved) for r in counted.collect()}
    direct = resolved.filter(F.col("parent_id").isNotNull())
    child, parent = F.coalesce("child_image", F.lit("")) != "", F.coalesce("parent_image", F.lit("")) != ""
    ppid = basis_entry(F.lit("ppid="), F.col("parent_pid"))
    image = basis_entry(F.lit("image="), F.col("child_image"))
    creator = basis_entry(F.lit("parent="), F.col("parent_image"))
    basis = (
        F.when(child & parent, F.array(ppid, image, creator))
        .when(child, F.array(ppid, image))
        .when(parent, F.array(ppid, creator))
        .otherwise(F.array(ppid))
    )
    first = direct.select("rule_ix", "child_id", F.col("parent_id").alias("src"), basis.alias("basis"))
    edges = _edges(first, rules, F.lit(0), model.CONFIDENCE_EXACT)
    relations = {ix: found for ix, (found, _) in totals.items()}
    depths = {ix: r.lineage_depth for ix, r in enumerate(rules) if r.lineage_depth > 0}
    if depths:
        above = ancestors(direct.select("rule_ix", "child_id", "parent_id"), depths)
        for r in above.groupBy("rule_ix").agg(F.count(F.lit(1)).alias("n")).collect():
            relations[r.rule_ix] += r.n
        why = F.array(F.concat((F.col("step") + 1).cast("string"), F.lit(" generations up")), F.lit("through the direct parents"))
        further = above.select("rule_ix", "child_id", F.col("ancestor_id").alias("src"), "step", why.alias("basis"))
        edges = edges.unionByName(_edges(further, rules, F.col("step"), model.CONFIDENCE_ANCESTOR))
    counters = []
    for ix in range(len(rules)):
        found, unresolved = totals.get(ix, (0, 0))
        counters.append(
            {
                "matches": found,
                "unresolved": unresolved,
                "relations": relations.get(ix, 0),
            }
        )
    return edges, counters


def ancestors(direct: DataFrame, depths: dict[int, int]) -> DataFrame:
    """(rule_ix, child_id, ancestor_id, step): all ancestors beyond the direct parent, ``step`` generations above it, as
    many generations as ``depths`` gives each rule.

    Each process has at most one parent, so a jump table (who is 2^k generations up) is a lookup by a unique key. All
    generations up to 2^k, each moved up by that jump, give those up to 2^(k+1): the rounds are the bits of the depth.
    """
    spark, limits = direct.sparkSession, F.create_map(*[F.lit(x) for kv in depths.items() for x in kv])
    jump = written(direct.filter(F.col("rule_ix").isin(list(depths))).select("rule_ix", F.col("child_id").alias("at"), F.col("parent_id").alias("up")))
    known = jump.select("rule_ix", F.col("at").alias("child_id"), F.col("up").alias("ancestor_id"), F.lit(0).alias("step"))
    folder, reach = new_folder(spark, "ancestors"), 1
    known.write.parquet(f"{folder}/{reach}")
    while reach <= max(depths.values()):
        known = spark.read.schema(known.schema).parquet(*[f"{folder}/{2**k}" for k in range(reach.bit_length())])
        moved = known.join(jump.withColumnRenamed("at", "ancestor_id"), ["rule_ix", "ancestor_id"])
        moved = moved.select("rule_ix", "child_id", F.col("up").alias("ancestor_id"), (F.col("step") + reach).alias("step"))
        moved.filter(F.col("step") <= F.element_at(limits, F.col("rule_ix"))).write.parquet(f"{folder}/{2 * reach}")
        reach *= 2
        if reach <= max(depths.values()):
            ahead = jump.select("rule_ix", F.col("at").alias("up"), F.col("up").alias("up2"))
            jump = written(jump.join(ahead, ["rule_ix", "up"]).select("rule_ix", "at", F.col("up2").alias("up")))
    return spark.read.schema(known.schema).parquet(*[f"{folder}/{2**k}" for k in range(reach.bit_length())]).filter("step > 0")


def _edges(rows: DataFrame, rules: Sequence[Rule], step: Column, confidence: float) -> DataFrame:
    names = rules_frame(rows.sparkSession, list(rules)).select("rule_ix", "rule_id", "relation_type", "labels")
    label = F.when(step == 0, F.coalesce(F.get("labels", F.lit(0)), F.lit(""))).otherwise(F.lit(""))
    match = match_id(F.col("src"), F.col("child_id"), F.lit(2))
    return rows.join(small_side(names, len(rules)), "rule_ix").select(
        edge_id(F.col("rule_id"), match, step).alias("edge_id"),
        "src",
        F.col("child_id").alias("dst"),
        F.lit(None).cast("bigint").alias("graph_id"),
        "relation_type",
        label.alias("label"),
        F.lit(confidence).alias("confidence"),
        F.lit("system").alias("created_by"),
        "rule_id",
        F.lit("lineage").alias("algorithm"),
        match.alias("match_id"),
        step.alias("step_index"),
        "basis",
        F.lit(model.RELATION_VERSION).alias("rel_version"),
    )
