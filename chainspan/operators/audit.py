"""Case integrity: one report table over events, edges, graphs, findings and rules.

Everything is counted on the cluster; only rows of the report itself (per rule, channel or graph) are ever small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspan import model
from chainspan.operators.findings import audit_findings
from chainspan.operators.graph import dangling_edges, graph_counts
from chainspan.operators.slots import projection_status, slot_coverage
from chainspan.plans.rules import Rule, rules_frame

REPORT = ("code", "severity", "subject", "detail", "n")


def inventory(df: DataFrame) -> DataFrame:
    """(kind, name, n): events, undated and stale events, events per channel, events per slot."""
    one = df.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("ts_ns").isNull()).alias("undated"),
        F.count_if(F.coalesce(F.col("corr_version"), F.lit(0)) != model.SLOT_VERSION).alias("stale"),
        *[F.count(s).alias(s) for s in model.SLOTS],
    )
    row = lambda kind, name, c: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.col(c).alias("n"))
    rows = [row("total", c, c) for c in ("events", "undated", "stale")] + [row("slot", s, s) for s in model.SLOTS]
    channels = df.groupBy(F.coalesce("channel", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return one.select(F.inline(F.array(*rows))).unionByName(
        channels.select(F.lit("channel").alias("kind"), "name", "n")
    )


def _rows(df: DataFrame, code: str, severity: str, subject: Column, detail: Column, n: Column) -> DataFrame:
    return df.select(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        subject.alias("subject"),
        detail.alias("detail"),
        n.cast("bigint").alias("n"),
    )


def _counted(df: DataFrame, code: str, severity: str) -> DataFrame:
    """One row when ``df`` has rows."""
    n = df.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    return _rows(n, code, severity, F.lit(""), F.lit(""), F.col("n"))


def check_edges(edges: DataFrame, events: DataFrame) -> DataFrame:
    return _counted(dangling_edges(edges, events), "dangling_relations", "error")


def check_findings(findings: DataFrame, events: DataFrame, written_version: int, recipe_version: int) -> DataFrame:
    code = "orphan_findings" if written_version == recipe_version else "stale_findings"
    return _counted(audit_findings(findings, events, written_version, recipe_version), code, "warning")


def check_graphs(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    counts = graph_counts(edges).filter(F.col("graph_id").isNotNull())
    known = graphs.select("graph_id", "name")
    lost = counts.join(known, "graph_id", "left_anti")
    empty = known.join(counts, "graph_id", "left_anti")
    return _rows(
        lost, "orphan_graph", "warning", F.col("graph_id").cast("string"), F.lit(""), F.col("edges")
    ).unionByName(_rows(empty, "empty_graph", "info", F.col("name"), F.lit(""), F.lit(0)))


def check_projection(df: DataFrame) -> DataFrame:
    stale = projection_status(df).filter("stale > 0")
    return _rows(stale, "stale_projection", "warning", F.lit(""), F.lit(""), F.col("stale"))


def check_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Missing channels, undeclared channels, rules that cannot fire, and rules blocked on an empty slot."""
    spark = df.sparkSession
    frame = rules_frame(spark, [r for r in rules if r.enabled])
    channels = df.select(F.col("channel").alias("ch")).distinct()
    codes = df.select(F.col("event_code").alias("code_")).distinct()

    wants = frame.select("rule_id", F.explode("channels").alias("ch")).filter("ch <> ''")
    absent = wants.join(channels, "ch", "left_anti")
    missing = _rows(absent, "missing_channel", "warning", F.col("rule_id"), F.col("ch"), F.lit(0))

    silent = frame.filter(F.size("channels") == 0).agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    undeclared = _rows(silent, "channel_undeclared", "info", F.lit(""), F.lit(""), F.col("n"))

    steps = frame.select("rule_id", F.explode(F.array_distinct("step_codes")).alias("code_")).filter("code_ <> ''")
    dead = steps.join(codes, "code_", "left_anti").groupBy("rule_id").agg(
        F.array_join(F.array_sort(F.collect_list("code_")), ", ").alias("codes")
    )
    inert = _rows(dead, "rule_inert", "warning", F.col("rule_id"), F.col("codes"), F.lit(0))

    empty_slots = slot_coverage(df).filter("events = 0").select("slot")
    fields = frame.join(dead.select("rule_id"), "rule_id", "left_anti").select(
        "rule_id", F.posexplode("match_fields").alias("pos", "slot")
    )
    stuck = fields.join(empty_slots, "slot", "left_semi").groupBy("rule_id").agg(F.min_by("slot", "pos").alias("slot"))
    blocked = _rows(stuck, "rule_blocked", "warning", F.col("rule_id"), F.col("slot"), F.lit(0))
    return missing.unionByName(undeclared).unionByName(inert).unionByName(blocked)


def unmatched_rules(outcomes: DataFrame, report: DataFrame) -> DataFrame:
    """Rules that could have matched, since all their steps occur, but did not."""
    idle = outcomes.filter("matches = 0").select("rule_id")
    could = idle.join(report.filter("code in ('rule_inert', 'rule_blocked')").select(F.col("subject").alias("rule_id")), "rule_id", "left_anti")
    return _rows(could, "rule_unmatched", "info", F.col("rule_id"), F.lit(""), F.lit(0))


def order_report(report: DataFrame) -> DataFrame:
    """Errors, then warnings, then notes; by code and subject within each."""
    rank = F.array_position(F.array(*[F.lit(s) for s in model.SEVERITIES]), F.col("severity"))
    return report.orderBy(rank, "code", "subject", "detail")


def integrity_report(
    df: DataFrame,
    edges: DataFrame,
    graphs: DataFrame,
    findings: DataFrame,
    rules: Sequence[Rule],
    written_version: int = 1,
    recipe_version: int = 1,
) -> DataFrame:
    """All checks as rows of (code, severity, subject, detail, n), in report order."""
    parts = [
        check_findings(findings, df, written_version, recipe_version),
        check_graphs(edges, graphs),
        check_projection(df),
        check_rules(df, rules),
    ]
    out = check_edges(edges, df)
    for p in parts:
        out = out.unionByName(p)
    return order_report(out)


def report_counts(df: DataFrame, edges: DataFrame, graphs: DataFrame, findings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row: events, relations, graphs, findings, enabled_rules, rules_unchecked."""
    live = [r for r in rules if r.enabled]
    out = df.agg(F.count(F.lit(1)).alias("events"))
    for other, name in ((edges, "relations"), (graphs, "graphs"), (findings, "findings")):
        out = out.join(F.broadcast(other.agg(F.count(F.lit(1)).alias(name))), how="left")
    return out.withColumn("enabled_rules", F.lit(len(live)).cast("bigint")).withColumn(
        "rules_unchecked", F.lit(sum(not r.channels for r in live)).cast("bigint")
    )
