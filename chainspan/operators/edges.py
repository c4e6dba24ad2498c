"""Occurrences to edges: provenance, basis, the first matches and what was left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspan import model
from chainspan.functions.text import trimmed
from chainspan.functions.times import duration_text
from chainspan.operators.layout import ordered_layout, running_position
from chainspan.operators.matching import scope_column
from chainspan.plans.rules import Rule, rules_frame, small_table

# Beyond this many rows a side is joined by shuffle instead of being broadcast.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` when its row count, known to the caller, is small; otherwise leave the choice to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def match_id(first: Column, last: Column, n: Column) -> Column:
    return F.concat_ws("-", F.lit("m"), first.cast("string"), last.cast("string"), n.cast("string"))


def edge_id(rule_id: Column, match: Column, step: Column) -> Column:
    """Built from what makes an edge unique, so a rebuild gives every edge the name it had before."""
    return F.concat_ws("/", rule_id, match, step.cast("string"))


def basis_entry(*parts: Column) -> Column:
    return trimmed(F.concat(*parts))


def with_basis(occurrences: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``basis`` to occurrences that carry match_fields, bucket, gap_ns and within_text.

    Shared values come first, then the gap a temporal match was decided by. Every shape of basis the rules can have is a plain array over text columns made in a
    step of their own, so no per-element function runs over the matches.
    """
    shapes = sorted({(len(r.bucket_slots), r.algorithm == "temporal") for r in rules} - {(0, False)})
    name = lambda i: F.get("match_fields", F.lit(i))
    widest = max((n for n, _ in shapes), default=0)
    texts = {
        f"_f{i}": F.concat(name(i), F.lit("="), F.element_at("bucket", name(i)))
        for i in range(widest)
    }
    if any(timed for _, timed in shapes):
        texts["_gap"] = F.concat(F.lit("max Δt="), duration_text(F.col("gap_ns")), F.lit(" ≤ "), F.col("within_text"))
    staged = occurrences.withColumns(texts) if texts else occurrences
    basis = F.array().cast("array<string>")
    for n, timed in shapes:
        entries = [F.col(f"_f{i}") for i in range(n)] + ([F.col("_gap")] if timed else [])
        within = F.col("within_text")
        fits = (F.size("match_fields") == n) & (within.isNotNull() if timed else within.isNull())
        basis = F.when(fits, F.array(*entries)).otherwise(basis)
    return staged.withColumn("basis", basis).drop(*texts)


def emit_edges(occurrences: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One edge per pair of consecutive events of an occurrence (graph_id is left NULL for the build to fill)."""
    frame = rules_frame(occurrences.sparkSession, list(rules)).select(
        "rule_ix", "rule_id", "algorithm", "relation_type", "labels", "match_fields", "within_text"
    )
    n = F.size("ids")
    joined = with_basis(occurrences.join(small_side(frame, len(rules)), "rule_ix"), rules).select(
        "rule_id",
        "algorithm",
        "relation_type",
        "labels",
        "ids",
        match_id(F.element_at("ids", 1), F.element_at("ids", -1), n).alias("match_id"),
        "basis",
        F.posexplode(F.slice("ids", F.lit(2), n - 1)).alias("step_index", "dst"),
    )
    step = F.col("step_index")
    return joined.select(
        edge_id(F.col("rule_id"), F.col("match_id"), step).alias("edge_id"),
        F.element_at("ids", step + 1).alias("src"),
        "dst",
        F.lit(None).cast("bigint").alias("graph_id"),
        "relation_type",
        F.coalesce(F.get("labels", step), F.lit("")).alias("label"),
        F.lit(model.CONFIDENCE_EXACT).alias("confidence"),
        F.lit("system").alias("created_by"),
        "rule_id",
        "algorithm",
        "match_id",
        "step_index",
        "basis",
        F.lit(model.RELATION_VERSION).alias("rel_version"),
    )


def match_totals(occurrences: DataFrame) -> dict[int, int]:
    """Matches per rule: one row per rule comes back."""
    return {r.rule_ix: r.n for r in occurrences.groupBy("rule_ix").agg(F.count(F.lit(1)).alias("n")).collect()}


def first_matches(
    occurrences: DataFrame, events: DataFrame, rules: Sequence[Rule], limit: int
) -> tuple[DataFrame, list[int]]:
    """A report of the first ``limit`` matches of each rule in match order, and how many each rule has.

    For looking at; builds keep every match. Match order is scope, then the bucket's first event, then time. Rules
    under the limit pass untouched; for the others ranks come from per-run and per-bucket counts, without sorting the
    matches.
    """
    found = match_totals(occurrences)
    totals = [found.get(i, 0) for i in range(len(rules))]
    over = [i for i, n in enumerate(totals) if n > limit]
    if not over:
        return occurrences, totals
    kept = [occurrences.filter(~F.col("rule_ix").isin(over))]
    for i in over:
        ranked = _ranked(occurrences.filter(F.col("rule_ix") == i), events, rules[i])
        kept.append(ranked.filter(F.col("match_rank") < limit).drop("match_rank"))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out, totals


def _ranked(occ: DataFrame, events: DataFrame, rule: Rule) -> DataFrame:
    """One rule's occurrences with ``match_rank`` counted from 0."""
    spark = occ.sparkSession
    # One row per run, so this is the size of the partition list.
    counts = sorted(((r.chunk, r.n) for r in occ.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).collect()))
    offsets, total = [], 0
    for chunk, n in counts:
        offsets.append((chunk, total))
        total += n
    before = small_table(spark, [{"chunk": c, "before": n} for c, n in offsets], "chunk int, before bigint")
    placed = occ.join(small_side(before, len(offsets)), "chunk").withColumn("match_rank", F.col("before") + F.col("pos"))
    placed = placed.drop("before")
    slots = sorted(set(rule.bucket_slots))
    if not slots:
        return placed
    keyed = placed.select("*", *[F.element_at("bucket", s).alias(s) for s in slots])
    keys = ["scope", *slots]
    sizes = keyed.groupBy(*keys).agg(F.min("match_rank").alias("first_rank"), F.count(F.lit(1)).alias("n"))
    seen = events.filter(F.col("ts_ns").isNotNull()).withColumn("scope", scope_column(rule.match_scope))
    for s in slots:
        seen = seen.filter(F.col(s).isNotNull())
    first = seen.groupBy(*keys).agg(F.min(F.struct("ts_ns", "id")).alias("f"))
    buckets = sizes.join(first, keys).select("*", F.col("f.ts_ns").alias("ts_ns"), F.col("f.id").alias("id"))
    layout = ordered_layout(buckets, ["scope"], ["ts_ns", "id"], [*slots, "first_rank", "n"])
    place = running_position(layout, "n").select(*keys, "first_rank", "position")
    return (
        keyed.join(place, keys)
        .withColumn("match_rank", F.col("position") + F.col("match_rank") - F.col("first_rank"))
        .drop(*slots, "first_rank", "position")
    )


def exclusion_counts(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per rule: undated events, dated events without a match field, dated events with an old projection.

    All rules are counted in one pass over the events.
    """
    dated = F.col("ts_ns").isNotNull()
    aggs = [F.count_if(~dated).alias("undated"), F.count_if(dated & (F.col("corr_version") != model.SLOT_VERSION)).alias("stale")]
    sets = sorted({tuple(r.bucket_slots) for r in rules if r.bucket_slots})
    for i, slots in enumerate(sets):
        missing = F.lit(False)
        for s in slots:
            missing = missing | F.col(s).isNull()
        aggs.append(F.count_if(dated & missing).alias(f"no_keys_{i}"))
    one = events.agg(*aggs)
    rows = []
    for i, r in enumerate(rules):
        at = sets.index(tuple(r.bucket_slots)) if r.bucket_slots else None
        rows.append(
            F.struct(
                F.lit(i).alias("rule_ix"),
                F.lit(r.rule_id).alias("rule_id"),
                F.col("undated").alias("skipped_undated"),
                (F.lit(0).cast("bigint") if at is None else F.col(f"no_keys_{at}")).alias("skipped_no_keys"),
                (F.lit(0).cast("bigint") if r.algorithm == "sequence" else F.col("stale")).alias("stale_keys"),
            )
        )
    return one.select(F.inline(F.array(*rows)))
