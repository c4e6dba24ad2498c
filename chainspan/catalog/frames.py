"""Canonical inputs derived from the shared tables, in Spark and as SQL. Keep each pair in step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspan import model
from chainspan.functions.hashing import hash_raw
from chainspan.functions.times import epoch_ns
from chainspan.operators.edges import emit_edges
from chainspan.operators.graph import ensure_graphs
from chainspan.operators.identity import hash_normalized
from chainspan.operators.layout import neighbours, ordered_layout
from chainspan.operators.matching import match_rules
from chainspan.plans.rules import Rule, rules_frame
from chainspan.session import durable


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def canon(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as canonical events."""
    return canon_of(table(spark, sf, "events"))


def canon_of(raw: DataFrame) -> DataFrame:
    ev = raw.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    none = F.lit(None).cast("string")
    out = ev.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("event_code"),
        F.when(F.col("k") != 7, epoch_ns(F.col("ts"))).alias("ts_ns"),
        text("P-", (F.col("k") % 5).cast("string")).alias("provider"),
        F.when(F.col("event_type").isin("error", "signup"), "Security").otherwise("Application").alias("channel"),
        text("HOST-", (F.col("user_id") % 10).cast("string")).alias("computer"),
        text("U-", F.col("user_id").cast("string")).alias("user"),
        F.lit("table").alias("source_type"),
        F.when(F.col("event_id") % 3 == 0, "feed-a").otherwise("feed-b").alias("source_identifier"),
        hash_raw(F.col("props")).alias("hash_raw"),
        F.when(F.col("k") != 0, text("0x", F.col("k").cast("string"))).alias("logon_id"),
        none.alias("subject_logon_id"),
        text("0x", (F.col("k") % 12 + 1).cast("string")).alias("process_id"),
        text("0x", (F.col("user_id") % 12 + 1).cast("string")).alias("new_process_id"),
        none.alias("parent_process_id"),
        text("proc-", (F.col("k") % 4).cast("string")).alias("process_name"),
        text("acct-", (F.col("user_id") % 50).cast("string")).alias("target_user"),
        none.alias("subject_user"),
        text("10.0.0.", (F.col("k") % 20).cast("string")).alias("ip_address"),
        none.alias("service_name"),
        F.when(F.col("k") % 10 == 9, 1).otherwise(model.SLOT_VERSION).alias("corr_version"),
        F.col("k").alias("k"),
        F.col("value").alias("value"),
    )
    return hash_normalized(out)


_STAMP = "strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S.%f') || '000Z'"

CANON = f"""
base AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
),
canon0 AS (
  SELECT event_id AS id, event_type AS event_code,
         CASE WHEN k <> 7 THEN epoch_us(ts) * 1000 END AS ts_ns,
         'P-' || CAST(k % 5 AS VARCHAR) AS provider,
         CASE WHEN event_type IN ('error', 'signup') THEN 'Security' ELSE 'Application' END AS channel,
         'HOST-' || CAST(user_id % 10 AS VARCHAR) AS computer,
         'U-' || CAST(user_id AS VARCHAR) AS "user",
         'table' AS source_type,
         CASE WHEN event_id % 3 = 0 THEN 'feed-a' ELSE 'feed-b' END AS source_identifier,
         sha256(props) AS hash_raw,
         CASE WHEN k <> 0 THEN '0x' || CAST(k AS VARCHAR) END AS logon_id,
         CAST(NULL AS VARCHAR) AS subject_logon_id,
         '0x' || CAST(k % 12 + 1 AS VARCHAR) AS process_id,
         '0x' || CAST(user_id % 12 + 1 AS VARCHAR) AS new_process_id,
         CAST(NULL AS VARCHAR) AS parent_process_id,
         'proc-' || CAST(k % 4 AS VARCHAR) AS process_name,
         'acct-' || CAST(user_id % 50 AS VARCHAR) AS target_user,
         CAST(NULL AS VARCHAR) AS subject_user,
         '10.0.0.' || CAST(k % 20 AS VARCHAR) AS ip_address,
         CAST(NULL AS VARCHAR) AS service_name,
         CASE WHEN k % 10 = 9 THEN 1 ELSE 2 END AS corr_version,
         k, value
  FROM base
),
canon AS (
  SELECT *, sha256(CASE WHEN ts_ns IS NOT NULL
      THEN concat_ws(chr(31), event_code, {_STAMP}, provider, channel, computer, "user", source_identifier)
      ELSE concat_ws(chr(31), event_code, provider, channel, computer, "user") END) AS hash_normalized
  FROM canon0
)"""

BUYS = Rule("Error Then Purchase", ("error", "purchase"), labels=("then buys",), channels=("Security", "Application"))
SESSION = Rule(
    "Signup Then View Same Session", ("signup", "view"), "field", labels=("then views",), match_fields=("logon_id",)
)
RULES = [BUYS, SESSION]

_EDGES: dict[tuple[str, str], DataFrame] = {}


def user_edges(events: DataFrame) -> DataFrame:
    """Analyst edges: each dated signup to the next one of the same user, in graph 3."""
    signups = events.filter((F.col("event_code") == "signup") & F.col("ts_ns").isNotNull())
    linked = neighbours(ordered_layout(signups, ["user"], ["ts_ns", "id"]), ["id"], 1).filter("id_next IS NOT NULL")
    return linked.select(
        F.concat_ws("/", F.lit("user"), "id", "id_next").alias("edge_id"),
        F.col("id").alias("src"),
        F.col("id_next").alias("dst"),
        F.lit(3).cast("bigint").alias("graph_id"),
        F.lit("default").alias("relation_type"),
        F.lit("same person").alias("label"),
        F.lit(0.5).alias("confidence"),
        F.lit("user").alias("created_by"),
        F.lit("").alias("rule_id"),
        F.lit("").alias("algorithm"),
        F.lit("").alias("match_id"),
        F.lit(0).alias("step_index"),
        F.array().cast("array<string>").alias("basis"),
        F.lit(0).alias("rel_version"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of two rules (graphs 1 and 2) and the analyst's (graph 3); built once per session and table set."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _EDGES:
        ev = canon(spark, sf)
        made = emit_edges(match_rules(ev, RULES), RULES)
        which = F.when(F.col("rule_id") == BUYS.rule_id, 1).otherwise(2).cast("bigint")
        made = made.withColumn("graph_id", which).select(*model.EDGE_COLUMNS)
        _EDGES[key] = durable(made.unionByName(user_edges(ev)))
    return _EDGES[key]


def graphs(spark: SparkSession) -> DataFrame:
    """Graphs 1 to 3, and an empty graph 9."""
    kept = ensure_graphs(None, rules_frame(spark, RULES))
    more = spark.createDataFrame([(3, "", "By Hand"), (9, "", "Unused")], "graph_id bigint, rule_id string, name string")
    return kept.unionByName(more)


_PAIR = """
  SELECT {keys}, prev_id AS src, id AS dst, prev_ns, ts_ns FROM (
    SELECT *, lag(id) OVER w AS prev_id, lag(event_code) OVER w AS prev_code, lag(ts_ns) OVER w AS prev_ns
    FROM (
      SELECT * FROM (
        SELECT *, lag(event_code) OVER (PARTITION BY {keys} ORDER BY ts_ns, id) AS before
        FROM canon WHERE ts_ns IS NOT NULL AND event_code IN ('{a}', '{b}') {extra}
      ) WHERE event_code <> coalesce(before, '{b}')
    )
    WINDOW w AS (PARTITION BY {keys} ORDER BY ts_ns, id)
  ) WHERE event_code = '{b}'"""


def pair_sql(a: str, b: str, keys: str = "computer", extra: str = "") -> str:
    """Sequence matches of two different codes: with repeats dropped, the codes alternate."""
    return _PAIR.format(a=a, b=b, keys=keys, extra=extra)


def rule_edges_sql(rule_id: str, pairs: str, graph: int, label: str, algorithm: str, basis: str) -> str:
    return f"""
  SELECT '{rule_id}/m-' || src || '-' || dst || '-2/0' AS edge_id, src, dst, CAST({graph} AS BIGINT) AS graph_id,
         'correlation' AS relation_type, '{label}' AS label, CAST(1.0 AS DOUBLE) AS confidence,
         'system' AS created_by, '{rule_id}' AS rule_id, '{algorithm}' AS algorithm,
         'm-' || src || '-' || dst || '-2' AS match_id, 0 AS step_index, {basis} AS basis, 1 AS rel_version
  FROM ({pairs})"""


_BUYS_SQL = rule_edges_sql("error-then-purchase", pair_sql("error", "purchase"), 1, "then buys", "sequence", "''")
_SESSION_SQL = rule_edges_sql(
    "signup-then-view-same-session",
    pair_sql("signup", "view", "computer, logon_id", "AND logon_id IS NOT NULL"),
    2,
    "then views",
    "field",
    "'logon_id=' || logon_id",
)

EDGES = f"""
edges AS (
  {_BUYS_SQL}
  UNION ALL {_SESSION_SQL}
  UNION ALL
  SELECT 'user/' || id || '/' || nxt, id, nxt, CAST(3 AS BIGINT), 'default', 'same person', CAST(0.5 AS DOUBLE), 'user',
         '', '', '', 0, '', 0
  FROM (SELECT id, lead(id) OVER (PARTITION BY "user" ORDER BY ts_ns, id) AS nxt FROM canon
        WHERE event_code = 'signup' AND ts_ns IS NOT NULL) WHERE nxt IS NOT NULL
)"""

GRAPHS = """
graphs AS (
  SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'error-then-purchase', 'Error Then Purchase'),
    (2, 'signup-then-view-same-session', 'Signup Then View Same Session'), (3, '', 'By Hand'), (9, '', 'Unused'))
    AS t(graph_id, rule_id, name)
)"""

WITH_CANON = f"WITH RECURSIVE {CANON} "
WITH_EDGES = f"WITH RECURSIVE {CANON}, {EDGES}, {GRAPHS} "


def findings(events: DataFrame) -> DataFrame:
    """A finding per dated signup, and one for each error over 90 whose event is gone."""
    live = (F.col("event_code") == "signup") & F.col("ts_ns").isNotNull()
    lost = (F.col("event_code") == "error") & (F.col("value") > 90)
    return events.filter(live | lost).select(
        F.when(live, F.col("hash_normalized")).otherwise(F.sha2(F.concat(F.lit("gone-"), F.col("id")), 256)).alias("key"),
        (F.col("value") > 20).alias("flagged"),
        F.when(F.col("k") > 20, F.array_sort(F.array(F.lower("provider"), F.lower("computer"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("tags"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("seen on "), F.col("computer"))).otherwise("").alias("note"),
        F.concat_ws(" ", "event_code", "computer").alias("descriptor"),
        F.coalesce("ts_ns", F.lit(0)).alias("created_ns"),
        (F.coalesce("ts_ns", F.lit(0)) - F.col("k") * 1000).alias("updated_ns"),
    )


FINDINGS = """
findings AS (
  SELECT CASE WHEN event_code = 'signup' THEN hash_normalized ELSE sha256('gone-' || id) END AS key,
         value > 20 AS flagged,
         CASE WHEN k > 20 THEN list_sort([lower(provider), lower(computer)]) ELSE CAST([] AS VARCHAR[]) END AS tags,
         CASE WHEN k % 2 = 0 THEN 'seen on ' || computer ELSE '' END AS note,
         event_code || ' ' || computer AS descriptor,
         coalesce(ts_ns, 0) AS created_ns, coalesce(ts_ns, 0) - k * 1000 AS updated_ns
  FROM canon
  WHERE (event_code = 'signup' AND ts_ns IS NOT NULL) OR (event_code = 'error' AND value > 90)
)"""

WITH_FINDINGS = f"WITH RECURSIVE {CANON}, {FINDINGS} "


def copies(spark: SparkSession, sf: str) -> DataFrame:
    """Events seen again: every Security event once more (errors with another raw text), undated ones from a third feed."""
    ev = canon(spark, sf)
    again = ev.filter("channel = 'Security'").withColumns(
        {
            "id": F.col("id") + 10_000_000,
            "hash_raw": F.when(F.col("event_code") == "error", F.sha2(F.concat(F.col("hash_raw"), F.lit("x")), 256)).otherwise(
                F.col("hash_raw")
            ),
        }
    )
    third = ev.filter("ts_ns IS NULL").withColumns(
        {"id": F.col("id") + 20_000_000, "source_identifier": F.lit("feed-c")}
    )
    return again.unionByName(third)


COPIES = """
copies AS (
  SELECT * REPLACE (id + 10000000 AS id, CASE WHEN event_code = 'error' THEN sha256(hash_raw || 'x') ELSE hash_raw END AS hash_raw)
  FROM canon WHERE channel = 'Security'
  UNION ALL
  SELECT * REPLACE (id + 20000000 AS id, 'feed-c' AS source_identifier) FROM canon WHERE ts_ns IS NULL
)"""
