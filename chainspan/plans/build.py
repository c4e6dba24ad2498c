"""Running a set of rules against one event table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspan import model
from chainspan.operators.edges import emit_edges, exclusion_counts, match_totals, small_side
from chainspan.operators.graph import ensure_graphs
from chainspan.operators.lineage import match_lineage, match_lineages
from chainspan.operators.matching import STEPWISE, group_rules, match_rules, scope_column
from chainspan.operators.query import EventFilter, filter_events
from chainspan.plans.rules import Rule, rules_frame, small_table
from chainspan.session import recorded, remove

_LINEAGE_SLOTS = ("process_id", "new_process_id", "parent_process_id", "process_name")

_MATCHERS: dict = {}


def register_matcher(algorithm: str, fn) -> None:
    """Add a matching algorithm: ``fn(events, rule) -> (edges, counters)``, shaped like what ``match_lineage`` returns.

    The matcher gets all events the build does, with every column.
    """
    _MATCHERS[algorithm] = fn


@dataclass
class Build:
    edges: DataFrame
    outcomes: DataFrame
    graphs: DataFrame
    folders: tuple[str, ...] = ()  # what ``edges`` is read from

    def discard(self) -> None:
        """Remove the tables behind ``edges``, once they are stored elsewhere."""
        remove(self.edges.sparkSession, self.folders)


def prepare(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The events and columns ``rules`` can match on: dated, of a code some rule names, and only the slots read.

    Events of other codes never affect a match, so they are left behind before anything is kept or shuffled.
    """
    codes = {c for r in rules for c in r.step_codes} | {r.lineage_exit_id for r in rules if r.algorithm == "lineage"}
    slots = {s for r in rules for s in r.bucket_slots}
    if any(r.algorithm == "lineage" for r in rules):
        slots.update(_LINEAGE_SLOTS)
    kept = events.filter(F.col("ts_ns").isNotNull() & F.col("event_code").isin(sorted(codes)))
    return kept.select("id", "event_code", "ts_ns", "computer", *[s for s in model.SLOTS if s in slots])


def select_rules(rules: Sequence[Rule], ids: Sequence[str] = ()) -> list[Rule]:
    """The named rules whatever their enabled flag, or all enabled ones; an unknown id is an error."""
    if not ids:
        return [r for r in rules if r.enabled]
    by_id = {r.rule_id: r for r in rules}
    unknown = [i for i in ids if i not in by_id]
    if unknown:
        raise KeyError(f"unknown rules: {', '.join(unknown)}")
    return [by_id[i] for i in ids]


def build(
    events: DataFrame,
    rules: Sequence[Rule],
    flt: EventFilter | None = None,
    graphs: DataFrame | None = None,
    previous: DataFrame | None = None,
    cache: bool = False,
) -> Build:
    """Edges, per-rule outcomes and the graph table after running ``rules``.

    Rules that share a scope and match fields share one shuffle and one pass; lineage rules share another. With
    ``cache`` the narrowed events are kept between the passes: worth it when ``events`` is costly to produce, not for
    a columnar table, whose few columns are cheaper to read again. ``previous`` (the edge table before this run) only feeds the ``removed`` counts: a rule's edges
    replace what its graph held. Undated events are only counted, so ``flt`` always lets them pass.
    """
    rules = list(rules)
    if flt is not None:
        events = filter_events(events, flt.without_paging(undated="include"))
    prepared = prepare(events, rules)
    layouts = len(group_rules(rules)) + sum(r.algorithm == "lineage" for r in rules)
    cache = cache and layouts > 1
    if cache:
        prepared = prepared.persist()
    try:
        with recorded() as folders:
            out = _build(events, prepared, rules, graphs, previous)
        return replace(out, folders=tuple(folders))
    finally:
        if cache:
            prepared.unpersist()


def _build(events, prepared, rules, graphs, previous) -> Build:
    spark = events.sparkSession
    stepwise = [r for r in rules if r.algorithm in STEPWISE]
    ancestry = [r for r in rules if r.algorithm == "lineage"]
    parts: list[DataFrame] = []
    counters: dict[str, dict] = {}
    if stepwise:
        found = match_rules(prepared, stepwise)
        totals = match_totals(found)
        parts.append(emit_edges(found, stepwise))
        for ix, r in enumerate(stepwise):
            n = totals.get(ix, 0)
            counters[r.rule_id] = {"matches": n, "unresolved": 0, "relations": n * (len(r.sequence) - 1)}
    if ancestry:
        edges, counts = match_lineages(prepared, ancestry)
        parts.append(edges)
        counters |= {r.rule_id: c for r, c in zip(ancestry, counts)}
    for r in rules:
        if r.algorithm in _MATCHERS:
            edges, counters[r.rule_id] = _MATCHERS[r.algorithm](events, r)
            parts.append(edges)
    unknown = sorted({r.algorithm for r in rules} - {*STEPWISE, "lineage", *_MATCHERS})
    if unknown:
        raise ValueError(f"no matcher for {', '.join(unknown)}")
    if not parts:
        raise ValueError("no rules to run")
    edges = parts[0]
    for e in parts[1:]:
        edges = edges.unionByName(e)
    registry = ensure_graphs(graphs, rules_frame(spark, rules))
    ids = registry.filter(F.col("rule_id") != "").select("rule_id", F.col("graph_id").alias("g"))
    edges = (
        edges.join(small_side(ids, len(rules)), "rule_id")
        .withColumn("graph_id", F.col("g"))
        .select(*model.EDGE_COLUMNS)
    )
    outcomes = build_outcomes(rules, counters, registry, previous, exclusion_counts(events, rules))
    used = [r.rule_id for r in rules if counters.get(r.rule_id, {}).get("relations")]
    idle = [r.rule_id for r in rules if r.rule_id not in used]
    return Build(edges, outcomes, registry.filter(~F.col("rule_id").isin(idle)) if idle else registry)


def build_outcomes(
    rules: Sequence[Rule],
    counters: dict[str, dict],
    graphs: DataFrame,
    previous: DataFrame | None,
    excluded: DataFrame,
) -> DataFrame:
    """One row per rule: what it matched, wrote, replaced and could not consider.

    ``counters`` holds matches, unresolved and relations by rule id, as the matchers counted them.
    """
    spark = graphs.sparkSession
    none = {"matches": 0, "unresolved": 0, "relations": 0}
    rows = [
        {"rule_ix": i, "rule_id": r.rule_id, "rule_name": r.name} | none | counters.get(r.rule_id, {})
        for i, r in enumerate(rules)
    ]
    frame = small_table(
        spark,
        rows,
        "rule_ix int, rule_id string, rule_name string, matches bigint, unresolved bigint, relations bigint",
    )
    named = graphs.select("rule_id", "graph_id", F.col("name").alias("graph_name"))
    out = frame.join(named, "rule_id", "left").join(
        excluded.select("rule_ix", "skipped_undated", "skipped_no_keys"), "rule_ix", "left"
    )
    if previous is not None:
        removed = previous.groupBy("graph_id").agg(F.count(F.lit(1)).alias("removed"))
        out = out.join(removed, "graph_id", "left")
    else:
        out = out.withColumn("removed", F.lit(0).cast("bigint"))
    return out.select(
        "rule_id",
        "rule_name",
        "graph_id",
        "graph_name",
        "matches",
        "relations",
        F.coalesce("removed", F.lit(0).cast("bigint")).alias("removed"),
        "skipped_undated",
        "skipped_no_keys",
        F.col("unresolved").alias("unresolved_parents"),
        (F.col("relations") == 0).alias("graph_discarded"),
    )


def write_edges(edges: DataFrame, path: str) -> None:
    """Replace the edges of the rules in ``edges`` and leave all other rules' edges alone.

    One folder per rule: dynamic overwrite swaps exactly those folders, so a repeated or retried run is harmless.
    """
    (
        edges.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("rule_id")
        .parquet(path)
    )


def dry_run(
    events: DataFrame, rule: Rule, samples: int = 20, flt: EventFilter | None = None
) -> tuple[DataFrame, DataFrame]:
    """What a rule would produce: one row of exact counts, and the events of the first ``samples`` matches."""
    samples = max(0, samples)
    if flt is not None:
        events = filter_events(events, flt.without_paging(undated="include"))
    prepared = prepare(events, [rule])
    if rule.algorithm == "lineage":
        edges, counters = match_lineage(prepared, rule)
        order = _lineage_order(edges, events, rule)
    else:
        found = match_rules(prepared, [rule])
        n = match_totals(found).get(0, 0)
        counters = {"matches": n, "unresolved": 0, "relations": n * (len(rule.sequence) - 1)}
        order = _match_order(found, events, rule)
    counts = "matches bigint, unresolved bigint, relations bigint"
    excluded = exclusion_counts(events, [rule]).drop("rule_ix", "rule_id")
    summary = small_table(events.sparkSession, [counters], counts).join(F.broadcast(excluded), how="left")
    # Top-k over matches; only ``samples`` of them go on.
    first = order.orderBy("o").limit(samples)
    first = first.withColumn("sample", F.row_number().over(_over("o"))).drop("o")
    wanted = first.select("sample", "match_id", F.posexplode("ids").alias("step", "id"))
    shown = ("id", "event_code", "ts_ns", "computer", "provider", "channel", "user")
    detail = events.select(*shown).join(small_side(wanted, samples * max(len(rule.sequence), 2)), "id")
    return summary, detail.select("sample", "match_id", "step", *shown)


def _over(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)  # only ever applied to the samples asked for


def _match_order(found: DataFrame, events: DataFrame, rule: Rule) -> DataFrame:
    ids = F.col("ids")
    name = F.concat_ws("-", F.lit("m"), F.element_at(ids, 1), F.element_at(ids, -1), F.size(ids))
    if not rule.bucket_slots:
        return found.select(name.alias("match_id"), "ids", F.struct("chunk", "pos").alias("o"))
    slots = sorted(set(rule.bucket_slots))
    dated = events.filter(F.col("ts_ns").isNotNull()).withColumn("scope", scope_column(rule.match_scope))
    for s in slots:
        dated = dated.filter(F.col(s).isNotNull())
    first = dated.groupBy("scope", *slots).agg(F.min(F.struct("ts_ns", "id")).alias("f"))
    keyed = found.select("*", *[F.element_at("bucket", s).alias(s) for s in slots]).join(first, ["scope", *slots])
    return keyed.select(name.alias("match_id"), "ids", F.struct("scope", "f", "chunk", "pos").alias("o"))


def _lineage_order(edges: DataFrame, events: DataFrame, rule: Rule) -> DataFrame:
    child = events.select(F.col("id").alias("dst"), "ts_ns", scope_column(rule.match_scope).alias("scope"))
    direct = edges.join(child, "dst")
    return direct.select("match_id", F.array("src", "dst").alias("ids"), F.struct("scope", "ts_ns", "dst", "step_index").alias("o"))
