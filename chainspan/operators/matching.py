"""Ordered-pattern matching: sequence, field and temporal rules over one shared layout.

Rules with the same scope and the same match fields share one layout and one pass, so adding rules to a build adds
neither shuffles nor reads. ``match_rules`` returns one row per occurrence; ``edges.emit_edges`` turns them into edges.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspan.operators.automata import (
    AdvanceCounter,
    Found,
    PairMatcher,
    Rows,
    SequenceMatcher,
    TemporalMatcher,
    TemporalPairMatcher,
)
from chainspan.operators.layout import Layout, Tail, bucket_starts, carried, keys_at, ordered_layout
from chainspan.plans.rules import Rule
from chainspan.session import written


def scope_column(scope: str):
    """The partition a match must stay inside. Events without a computer share one."""
    return F.coalesce(F.col("computer"), F.lit("")) if scope == "computer" else F.lit("")


def rule_layout(events: DataFrame, rules: Sequence[Rule]) -> Layout:
    """The layout for rules that share a scope and match fields.

    Undated events, events of other codes and events without one of the match fields cannot take part in any of the
    rules, so they are dropped before the shuffle.
    """
    scope, slots = rules[0].match_scope, tuple(sorted(set(rules[0].bucket_slots)))
    codes = sorted({c for r in rules for c in r.sequence})
    kept = events.filter(F.col("ts_ns").isNotNull() & F.col("event_code").isin(codes))
    for s in slots:
        kept = kept.filter(F.col(s).isNotNull())
    kept = kept.withColumn("scope", scope_column(scope))
    return ordered_layout(kept, ["scope", *slots], ["ts_ns", "id"], ["event_code"])


STEPWISE = ("sequence", "field", "temporal")


def group_rules(rules: Sequence[Rule]) -> list[list[tuple[int, Rule]]]:
    """Rules by shared layout, each with its position in the rule list. Others than these kinds are matched elsewhere."""
    groups: dict[tuple, list[tuple[int, Rule]]] = defaultdict(list)
    for i, r in enumerate(rules):
        if r.algorithm in STEPWISE:
            groups[(r.match_scope, tuple(sorted(set(r.bucket_slots))))].append((i, r))
    return list(groups.values())


class _Plan:
    """What a task needs to know about the rules of one group; plain data, pickled with the task."""

    def __init__(self, numbered: Sequence[tuple[int, Rule]], keys: Sequence[str]):
        self.keys = tuple(keys)
        self.codes = sorted({c for _, r in numbered for c in r.sequence})
        at = {c: i for i, c in enumerate(self.codes)}
        self.rule_ix = [i for i, _ in numbered]
        self.seqs = [[at[c] for c in r.sequence] for _, r in numbered]
        self.temporal = [(r.within_ns, r.total_ns) if r.algorithm == "temporal" else None for _, r in numbered]

    def pair(self, j: int) -> bool:
        return len(set(self.seqs[j])) == len(self.seqs[j]) == 2

    @property
    def rounds(self) -> int:
        """Passes that find the states runs begin with: one, or as many as the longest rule with bounded gaps has steps."""
        return max([len(s) for j, s in enumerate(self.seqs) if self.swept(j)], default=1)

    def swept(self, j: int) -> bool:
        return self.temporal[j] is not None and not self.pair(j)

    def matcher(self, j: int, begin):
        if self.temporal[j] is not None:
            kind = TemporalPairMatcher if self.pair(j) else TemporalMatcher
            return kind(self.seqs[j], *self.temporal[j], begin)
        kind = PairMatcher if self.pair(j) else SequenceMatcher
        return kind(self.seqs[j], begin or 0)

    def compose(self, j: int, told, begin, single: bool):
        """The state after a run, in the form ``matcher`` takes it; None: a fresh start."""
        if self.temporal[j] is None:
            taken = begin or 0
            return (taken + told[taken % len(self.seqs[j])] if single else told[0]) or None
        chains, after = told
        held = begin[0] if begin and single else [None] * len(chains)
        if self.pair(j):
            chains, fresh = chains if after else held, None
        else:
            # Who completed a step last: in the run, else before it.
            chains = [c or h for c, h in zip(chains, held)]
            fresh = after[begin[1] if begin and single else -1]
        return [chains, fresh] if any(chains) else None

    def code_index(self, batch: pa.RecordBatch) -> np.ndarray:
        ix = pc.index_in(batch.column("event_code"), value_set=pa.array(self.codes, pa.string()))
        return pc.fill_null(ix, -1).to_numpy(zero_copy_only=False)


class _RuleTails(Tail):
    """End-of-run summary of every rule: advances for sequence rules, live chains for temporal ones.

    Passes after the first, and only these, are given states; they are for the rules with bounded gaps alone.
    """

    def __init__(self, plan: _Plan, number: int):
        self.plan, self.number = plan, number

    def start(self, states: dict, whole_bucket: bool) -> None:
        p = self.plan
        self.state: list = []
        for j, seq in enumerate(p.seqs):
            if self.number and not p.swept(j):
                self.state.append(None)
            elif p.temporal[j] is None:
                self.state.append(AdvanceCounter(seq, 1 if whole_bucket else len(seq)))
            else:
                m = p.matcher(j, states.get(j))
                m.all_moves = self.number == p.rounds - 1
                self.state.append(m)

    def feed(self, batch: pa.RecordBatch) -> None:
        rows = Rows(
            self.plan.code_index(batch),
            np.zeros(batch.num_rows, dtype=np.int64),
            batch.column("id").to_numpy(zero_copy_only=False),
            batch.column("ts_ns").to_numpy(zero_copy_only=False),
        )
        for state in self.state:
            if state is not None:
                state.feed(rows)

    def summary(self) -> list:
        return [None if s is None else s.advances() if isinstance(s, AdvanceCounter) else s.summary() for s in self.state]


def begin_states(layout: Layout, plan: _Plan) -> DataFrame | None:
    """(chunk, states): the state each rule begins each run with; no state means a fresh start.

    Sequence rules compose in one go, since a run is fully described by its advance from each possible state. For a
    rule with bounded gaps, which events of a run complete a step depends on the chains that completed the step before
    it earlier, in other runs. So the first pass settles which chain completed the first step last before each run, the
    second pass, with these, the second step, and so on; the last pass also says, for every number of chains that are
    still free at the beginning of a run, how many are at its end. However many runs there are, and whatever is in
    them, the passes are as many as the rule has steps.
    """
    if layout.runs <= 1:
        return None
    states = None
    for number in range(plan.rounds):
        states = carried(layout, lambda k=number: _RuleTails(plan, k), plan.compose, states)
    return states


def _piece_schema(keys: Sequence[str]) -> str:
    key_cols = ", ".join(f"{k} string" for k in keys)
    return (
        f"rule_ix int, whole boolean, occ bigint, step0 int, chunk int, pos bigint, {key_cols}, "
        "ids array<bigint>, gap_ns bigint"
    )


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _batch_of(found: list[tuple[int, Found, int]], n_steps: dict[int, int], timed: set[int], keys, key_cols, chunk) -> pa.RecordBatch:
    """Rows of one batch: (rule, matches, position of its first) in, pieces before whole occurrences."""
    cat = lambda xs: np.concatenate([np.asarray(x, dtype=np.int64) for x in xs])
    sizes = [f.size for _, f, _ in found]
    pieces = [f.pieces for _, f, _ in found]
    zeros = [[0] * len(f.rows) for _, f, _ in found]
    lengths = cat(
        [[len(p.ids) for p in f.pieces] + [n_steps[ix]] * len(f.rows) for ix, f, _ in found]
    )
    rule_ix = np.repeat([ix for ix, _, _ in found], sizes)
    want = np.repeat([n_steps[ix] for ix, _, _ in found], sizes)
    arrays = [
        pa.array(rule_ix, pa.int32()),
        pa.array(lengths == want),
        pa.array(cat([[p.occ for p in ps] + z for ps, z in zip(pieces, zeros)]), pa.int64()),
        pa.array(cat([[p.step0 for p in ps] + z for ps, z in zip(pieces, zeros)]), pa.int32()),
        pa.array(np.full(len(lengths), chunk), pa.int32()),
        pa.array(cat([np.arange(first, first + n) for (_, _, first), n in zip(found, sizes)]), pa.int64()),
        *key_cols,
        _lists(cat([x for _, f, _ in found for x in (*[p.ids for p in f.pieces], f.ids)]), lengths),
        pa.concat_arrays([_widest_gaps(f, n_steps[ix], ix in timed) for ix, f, _ in found]),
    ]
    return pa.RecordBatch.from_arrays(
        arrays, names=["rule_ix", "whole", "occ", "step0", "chunk", "pos", *keys, "ids", "gap_ns"]
    )


def _widest_gaps(f: Found, n: int, timed: bool) -> pa.Array:
    """Largest step of each occurrence of a temporal rule; NULL for the others, which no gap decides."""
    if not timed:
        return pa.nulls(f.size, pa.int64())
    return pa.array(np.diff(f.ts.reshape(-1, n), axis=1).max(axis=1), pa.int64())


def match_layout(layout: Layout, numbered: Sequence[tuple[int, Rule]]) -> DataFrame:
    """Occurrences of every rule of one group: (rule_ix, keys, chunk, pos, ids, gap_ns). (chunk, pos) is match order.

    What the pass finds is written once; whole occurrences and the few pieces to join are both read from there.
    """
    plan = _Plan(numbered, layout.keys)
    states = begin_states(layout, plan)
    keys = layout.keys
    n_steps = {ix: len(s) for ix, s in zip(plan.rule_ix, plan.seqs)}
    timed = {ix for ix, t in zip(plan.rule_ix, plan.temporal) if t is not None}

    def scan(batches: Iterator[pa.RecordBatch], begin: dict | None = None) -> Iterator[pa.RecordBatch]:
        matchers, chunk, last, counts = None, None, None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            if matchers is None:
                chunk = b.column("chunk")[0].as_py()
                matchers = [plan.matcher(j, (begin or {}).get(j)) for j in range(len(plan.seqs))]
                counts = [0] * len(matchers)
                last = keys_at(b, keys, 0)
            rows = Rows(
                plan.code_index(b),
                np.cumsum(bucket_starts(b, keys, last)),
                b.column("id").to_numpy(zero_copy_only=False),
                b.column("ts_ns").to_numpy(zero_copy_only=False),
            )
            last = keys_at(b, keys, b.num_rows - 1)
            found = []
            for j, m in enumerate(matchers):
                f = m.feed(rows)
                if f.size:
                    found.append((plan.rule_ix[j], f, counts[j]))
                    counts[j] += f.size
            if found:
                at = pa.array(np.concatenate([x for _, f, _ in found for x in ([p.row for p in f.pieces], f.rows)]).astype(np.int64))
                yield _batch_of(found, n_steps, timed, keys, [b.column(k).take(at) for k in keys], chunk)
        if matchers is not None:
            found = [(plan.rule_ix[j], f, counts[j]) for j, m in enumerate(matchers) if (f := m.open_piece()).size]
            if found:
                key_cols = [pa.array([last[i]] * len(found), pa.string()) for i in range(len(keys))]
                yield _batch_of(found, n_steps, timed, keys, key_cols, chunk)

    size = sum(64 * len(s) ** 2 for s in plan.seqs)
    pieces = written(layout.scan(scan, _piece_schema(keys), states, size))
    out = ["rule_ix", *keys, "chunk", "pos", "ids", "gap_ns"]
    if layout.runs <= 1:
        return pieces.filter("whole").select(*out)
    # Each rule leaves at most one open occurrence per run, so the pieces to join are few.
    length = F.create_map(*[F.lit(x) for kv in n_steps.items() for x in kv])
    last = F.element_at("parts", -1)
    joined = (
        pieces.filter(~F.col("whole"))
        .groupBy("rule_ix", *keys, "occ")
        .agg(F.array_sort(F.collect_list(F.struct("step0", "chunk", "pos", "ids"))).alias("parts"))
        .select(
            "rule_ix",
            *keys,
            last["chunk"].alias("chunk"),
            last["pos"].alias("pos"),
            F.flatten(F.col("parts.ids")).alias("ids"),
            F.lit(None).cast("bigint").alias("gap_ns"),
        )
        .filter(F.size("ids") == F.element_at(length, F.col("rule_ix")))
    )
    return pieces.filter("whole").select(*out).unionByName(joined)


def match_rules(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Occurrences of all sequence, field and temporal rules.

    Columns: rule_ix, scope, bucket (map of match field to value), chunk, pos, ids, gap_ns (temporal rules: the
    widest step).
    """
    parts = []
    for numbered in group_rules(rules):
        layout = rule_layout(events, [r for _, r in numbered])
        slots = layout.keys[1:]
        found = match_layout(layout, numbered)
        bucket = (
            F.create_map(*[x for s in slots for x in (F.lit(s), F.col(s))])
            if slots
            else F.create_map().cast("map<string,string>")
        )
        parts.append(found.select("rule_ix", "scope", bucket.alias("bucket"), "chunk", "pos", "ids", "gap_ns"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def match_sequence(events: DataFrame, codes: Sequence[str], scope: str = "computer") -> DataFrame:
    return match_rules(events, [Rule("sequence", tuple(codes), "sequence", match_scope=scope)])


def match_field(events: DataFrame, codes: Sequence[str], slots: Sequence[str], scope: str = "computer") -> DataFrame:
    return match_rules(events, [Rule("field", tuple(codes), "field", match_fields=tuple(slots), match_scope=scope)])


def match_temporal(
    events: DataFrame,
    codes: Sequence[str],
    within: str,
    total: str = "",
    slots: Sequence[str] = (),
    scope: str = "computer",
) -> DataFrame:
    rule = Rule(
        "temporal",
        tuple(codes),
        "temporal",
        match_fields=tuple(slots),
        match_scope=scope,
        window_within=within,
        window_total=total,
    )
    return match_rules(events, [rule])


def occurrence_steps(occurrences: DataFrame) -> DataFrame:
    """One row per event of an occurrence: rule_ix, scope, bucket, first_id, step, id."""
    return occurrences.select(
        "rule_ix", "scope", "bucket", F.element_at("ids", 1).alias("first_id"), F.posexplode("ids").alias("step", "id")
    )
