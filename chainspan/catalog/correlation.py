"""Pattern matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspan import model
from chainspan.catalog.frames import BUYS, CANON, RULES, SESSION, WITH_CANON, canon, pair_sql, table
from chainspan.catalog.registry import query
from chainspan.functions.times import epoch_ns
from chainspan.operators import edges as e
from chainspan.operators import lineage
from chainspan.operators.layout import neighbours, ordered_layout
from chainspan.operators.matching import match_field, match_rules, match_sequence, match_temporal, occurrence_steps
from chainspan.plans import build as b
from chainspan.plans.library import builtin_rules
from chainspan.plans.rules import Rule


def _chain(df, *more):
    """Occurrences as text: ids joined by '>'."""
    return df.select(*more, F.array_join(F.transform("ids", lambda x: x.cast("string")), ">").alias("chain"))


@query(
    "prepare",
    WITH_CANON + """SELECT id, event_code, ts_ns, computer FROM canon WHERE ts_ns IS NOT NULL AND event_code IN ('error', 'purchase', 'signup', 'view')""",
)
def prepared(spark, sf):
    return b.prepare(canon(spark, sf), RULES).drop("logon_id")


@query(
    "scoped_order",
    WITH_CANON + """SELECT computer AS scope, id, lag(id) OVER w AS id_prev, lead(id) OVER w AS id_next FROM canon WHERE ts_ns IS NOT NULL
      WINDOW w AS (PARTITION BY computer ORDER BY ts_ns, id)""",
)
def scoped(spark, sf):
    """Each dated event with the one before and after it on its computer."""
    ev = canon(spark, sf).filter("ts_ns IS NOT NULL").withColumnRenamed("computer", "scope")
    back = neighbours(ordered_layout(ev, ["scope"], ["ts_ns", "id"]), ["id"], -1).drop("chunk")
    return neighbours(ordered_layout(back, ["scope"], ["ts_ns", "id"], ["id_prev"]), ["id"], 1).select(
        "scope", "id", "id_prev", "id_next"
    )


def sequence_sql(codes: list[str], keys: str = "computer", extra: str = "") -> str:
    """Greedy matching row by row: from each taken row jump to the next row of the code wanted next."""
    n = len(codes)
    part = f"PARTITION BY {keys}" if keys else ""
    key = f"concat_ws('|', {keys})" if keys else "''"
    wanted = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(codes))
    inlist = ", ".join(f"'{c}'" for c in sorted(set(codes)))
    return f"""WITH RECURSIVE {CANON},
      rows AS (SELECT {key} AS g, id, event_code, row_number() OVER ({part} ORDER BY ts_ns, id) AS rn FROM canon
               WHERE ts_ns IS NOT NULL AND event_code IN ({inlist}) {extra}),
      start AS (SELECT g, min(rn) AS rn FROM rows WHERE event_code = '{codes[0]}' GROUP BY g),
      walk(g, k, rn) AS (
        SELECT g, 0, rn FROM start
        UNION ALL
        SELECT g, k, rn FROM (SELECT w.g, w.k + 1 AS k, (SELECT min(r.rn) FROM rows r WHERE r.g = w.g AND r.rn > w.rn
            AND r.event_code = CASE (w.k + 1) % {n} {wanted} END) AS rn FROM walk w) WHERE rn IS NOT NULL),
      taken AS (SELECT w.g, w.k, r.id FROM walk w JOIN rows r ON r.g = w.g AND r.rn = w.rn),
      done AS (SELECT g, k // {n} AS occ, string_agg(CAST(id AS VARCHAR), '>' ORDER BY k) AS chain FROM taken GROUP BY ALL HAVING count(*) = {n})
      """


BURST = ["error", "error", "error", "purchase"]


@query("match_sequence", sequence_sql(BURST) + "SELECT g AS scope, chain FROM done")
def sequence(spark, sf):
    return _chain(match_sequence(canon(spark, sf), BURST), "scope")


@query("match_sequence_global", sequence_sql(["signup", "view", "purchase"], "") + "SELECT chain FROM done")
def sequence_global(spark, sf):
    return _chain(match_sequence(canon(spark, sf), ["signup", "view", "purchase"], "global"))


@query("match_sequence_pair", WITH_CANON + f"SELECT src || '>' || dst AS chain FROM ({pair_sql('error', 'purchase')})")
def sequence_pair(spark, sf):
    return _chain(match_sequence(canon(spark, sf), ["error", "purchase"]))


@query(
    "match_field",
    sequence_sql(["error", "view", "error"], "computer, logon_id", "AND logon_id IS NOT NULL") + "SELECT g AS bucket, chain FROM done",
)
def field(spark, sf):
    found = match_field(canon(spark, sf), ["error", "view", "error"], ["logon_id"])
    return _chain(found, F.concat_ws("|", "scope", F.element_at("bucket", "logon_id")).alias("bucket"))


_HOUR = 3_600_000_000_000


def temporal_pair_sql(a: str, b: str, within: int, keys: str = "computer") -> str:
    return WITH_CANON + f"""SELECT prev_id || '>' || id AS chain FROM (
        SELECT *, lag(id) OVER w AS prev_id, lag(event_code) OVER w AS prev_code, lag(ts_ns) OVER w AS prev_ns
        FROM canon WHERE ts_ns IS NOT NULL AND event_code IN ('{a}', '{b}')
        WINDOW w AS (PARTITION BY {keys} ORDER BY ts_ns, id))
      WHERE event_code = '{b}' AND prev_code = '{a}' AND ts_ns - prev_ns <= {within}"""


@query("match_temporal_pair", temporal_pair_sql("error", "purchase", _HOUR))
def temporal_pair(spark, sf):
    return _chain(match_temporal(canon(spark, sf), ["error", "purchase"], "1h"))


BURST_RULE = Rule("temporal", ("error", "error", "purchase"), "temporal", window_within="4h", window_total="6h")


@query(
    "match_temporal",
    WITH_CANON + f""",
      rows AS (SELECT computer AS g, id, ts_ns AS t, event_code AS c, row_number() OVER (PARTITION BY computer ORDER BY ts_ns, id) AS rn
               FROM canon WHERE ts_ns IS NOT NULL AND event_code IN ('error', 'purchase')),
      -- a1, a2: latest chains that end at the first and the second step; out: a chain completed by this row
      sweep(g, rn, a1, t1, a2, t2, s2, out) AS (
        SELECT g, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT),
               CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT g FROM rows)
        UNION ALL
        SELECT s.g, r.rn,
          CASE WHEN c = 'error' THEN CAST(r.id AS VARCHAR) WHEN fin THEN NULL ELSE a1 END,
          CASE WHEN c = 'error' THEN t WHEN fin THEN NULL ELSE t1 END,
          CASE WHEN c = 'error' AND t - t1 <= {4 * _HOUR} THEN a1 || '>' || r.id WHEN fin THEN NULL ELSE a2 END,
          CASE WHEN c = 'error' AND t - t1 <= {4 * _HOUR} THEN t WHEN fin THEN NULL ELSE t2 END,
          CASE WHEN c = 'error' AND t - t1 <= {4 * _HOUR} THEN t1 WHEN fin THEN NULL ELSE s2 END,
          CASE WHEN fin THEN a2 || '>' || r.id END
        FROM sweep s JOIN rows r ON r.g = s.g AND r.rn = s.rn + 1,
        LATERAL (SELECT coalesce(c = 'purchase' AND t - t2 <= {4 * _HOUR} AND t - s2 <= {6 * _HOUR}, false) AS fin)
      )
      SELECT g AS scope, out AS chain FROM sweep WHERE out IS NOT NULL""",
)
def temporal(spark, sf):
    return _chain(match_rules(canon(spark, sf), [BURST_RULE]), "scope")


_LIFE = f"""WITH RECURSIVE {CANON},
  life AS (SELECT computer, new_process_id AS pid, id, ts_ns, event_code,
             lead(ts_ns) OVER (PARTITION BY computer, new_process_id ORDER BY ts_ns, id) AS end_ns
           FROM canon WHERE ts_ns IS NOT NULL AND event_code IN ('signup', 'error')),
  lifetimes AS (SELECT computer AS scope, pid, id, ts_ns AS start_ns, end_ns FROM life WHERE event_code = 'signup'),
  kids AS (SELECT computer AS scope, process_id AS ppid, id, ts_ns, process_name FROM canon
           WHERE ts_ns IS NOT NULL AND event_code = 'signup'),
  direct AS (SELECT k.scope, k.ppid, k.id AS child, k.ts_ns, k.process_name AS image, l.id AS parent, l.end_ns
             FROM kids k ASOF LEFT JOIN lifetimes l ON l.scope = k.scope AND l.pid = k.ppid AND k.ts_ns >= l.start_ns),
  resolved AS (SELECT *, CASE WHEN end_ns IS NULL OR ts_ns < end_ns THEN parent END AS p FROM direct)
"""


@query("process_lifetimes", _LIFE + "SELECT * FROM lifetimes")
def lifetimes(spark, sf):
    return lineage.process_lifetimes(canon(spark, sf), ("signup",), "error")


TREE = Rule("Ancestry", (), "lineage", labels=("spawned",), lineage_create_ids=("signup",), lineage_exit_id="error")


@query("resolve_parents", _LIFE + "SELECT scope, ppid AS parent_pid, child AS child_id, p AS parent_id FROM resolved")
def parents(spark, sf):
    return lineage.resolve_parents(canon(spark, sf), [TREE]).select("scope", "parent_pid", "child_id", "parent_id")


@query(
    "match_lineage",
    _LIFE + """SELECT 'ancestry/m-' || p || '-' || child || '-2/0' AS edge_id, p AS src, child AS dst, 'spawned' AS label,
        'ppid=' || ppid || ';image=' || image || ';parent=' || c.process_name AS basis
      FROM resolved JOIN canon c ON c.id = p""",
)
def lineage_edges(spark, sf):
    found, _ = lineage.match_lineage(canon(spark, sf), TREE)
    return found.select("edge_id", "src", "dst", "label", F.array_join("basis", ";").alias("basis"))


@query(
    "lineage_ancestors",
    _LIFE + """, walk(child, cur, d) AS (
        SELECT child, p, 0 FROM resolved WHERE p IS NOT NULL
        UNION ALL SELECT w.child, r.p, w.d + 1 FROM walk w JOIN resolved r ON r.child = w.cur WHERE r.p IS NOT NULL AND w.d < 20)
      SELECT cur AS src, child AS dst, d AS step_index, CAST(CASE WHEN d = 0 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence FROM walk""",
)
def ancestors(spark, sf):
    from dataclasses import replace

    found, _ = lineage.match_lineage(canon(spark, sf), replace(TREE, lineage_depth=20))
    return found.select("src", "dst", "step_index", "confidence")


@query(
    "emit_edges",
    sequence_sql(BURST) + f""", pairs AS (
        SELECT occ, g, k % 4 AS step, id AS src, lead(id) OVER w AS dst, first_value(id) OVER w AS f, last_value(id) OVER w AS l
        FROM taken JOIN done USING (g) WHERE taken.k // 4 = done.occ
        WINDOW w AS (PARTITION BY g, occ ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
      SELECT 'burst/m-' || f || '-' || l || '-4/' || step AS edge_id, src, dst, step AS step_index,
        CASE step WHEN 2 THEN 'then buys' ELSE '' END AS label, 'correlation' AS relation_type, 'system' AS created_by
      FROM pairs WHERE dst IS NOT NULL""",
)
def emitted(spark, sf):
    rule = Rule("Burst", tuple(BURST), labels=("", "", "then buys"))
    return e.emit_edges(match_rules(canon(spark, sf), [rule]), [rule]).select(
        "edge_id", "src", "dst", "step_index", "label", "relation_type", "created_by"
    )


@query(
    "occurrence_steps",
    sequence_sql(BURST) + "SELECT g AS scope, CAST(k % 4 AS INT) AS step, id FROM taken JOIN done USING (g) WHERE taken.k // 4 = done.occ",
)
def steps(spark, sf):
    return occurrence_steps(match_sequence(canon(spark, sf), BURST)).select("scope", "step", "id")


@query(
    "match_basis",
    WITH_CANON + """SELECT prev_id AS src, id AS dst, 'logon_id=' || logon_id || ';ip_address=' || ip_address || ';max Δt=' ||
        CASE WHEN gap >= 60000000 THEN (gap // 60000000) || 'm' ELSE '' END ||
        CASE WHEN gap < 1000 THEN gap || 'µs'
             WHEN gap < 1000000 THEN regexp_replace(printf('%d.%03d', gap // 1000, gap % 1000), '\\.?0*$', '') || 'ms'
             ELSE regexp_replace(printf('%d.%06d', (gap % 60000000) // 1000000, gap % 1000000), '\\.?0*$', '') || 's' END
        || ' ≤ 30m0s' AS basis FROM (
        SELECT id, logon_id, ip_address, event_code, lag(event_code) OVER w AS pc, lag(id) OVER w AS prev_id, (ts_ns - lag(ts_ns) OVER w) // 1000 AS gap
        FROM canon WHERE ts_ns IS NOT NULL AND event_code IN ('view', 'click') AND logon_id IS NOT NULL
        WINDOW w AS (PARTITION BY logon_id, ip_address ORDER BY ts_ns, id))
      WHERE event_code = 'click' AND pc = 'view' AND gap <= 1800000000""",
)
def bases(spark, sf):
    """Views followed by a click of the same session within half an hour, anywhere."""
    rule = Rule("Clicks", ("view", "click"), "temporal", match_fields=("logon_id", "ip_address"), window_within="30m", match_scope="global")
    return e.emit_edges(match_rules(canon(spark, sf), [rule]), [rule]).select("src", "dst", F.array_join("basis", ";").alias("basis"))


@query(
    "cap_matches",
    WITH_CANON + f"""SELECT src || '>' || dst AS chain FROM ({pair_sql('error', 'purchase')}) QUALIFY row_number() OVER (ORDER BY computer, ts_ns, dst) <= 100""",
)
def capped(spark, sf):
    ev = canon(spark, sf)
    kept, _ = e.first_matches(match_rules(ev, [BUYS]), ev, [BUYS], 100)
    return _chain(kept)


@query(
    "cap_matches_buckets",
    WITH_CANON + f""", m AS ({pair_sql('signup', 'view', 'computer, logon_id', 'AND logon_id IS NOT NULL')}),
      f AS (SELECT computer, logon_id, min(ts_ns) AS first_ns FROM canon WHERE ts_ns IS NOT NULL AND logon_id IS NOT NULL GROUP BY ALL)
      SELECT src || '>' || dst AS chain FROM m JOIN f USING (computer, logon_id)
      QUALIFY row_number() OVER (ORDER BY computer, first_ns, ts_ns, dst) <= 150""",
)
def capped_buckets(spark, sf):
    """With shared fields, matches count by bucket, in the order the buckets first appear."""
    ev = canon(spark, sf)
    kept, _ = e.first_matches(match_rules(ev, [SESSION]), ev, [SESSION], 150)
    return _chain(kept)


@query(
    "exclusion_counts",
    WITH_CANON + """SELECT 'error-then-purchase' AS rule_id, count(*) FILTER (ts_ns IS NULL) AS skipped_undated, CAST(0 AS BIGINT) AS skipped_no_keys,
        CAST(0 AS BIGINT) AS stale_keys FROM canon
      UNION ALL SELECT 'signup-then-view-same-session', count(*) FILTER (ts_ns IS NULL), count(*) FILTER (ts_ns IS NOT NULL AND logon_id IS NULL),
        count(*) FILTER (ts_ns IS NOT NULL AND corr_version <> 2) FROM canon""",
)
def excluded(spark, sf):
    return e.exclusion_counts(canon(spark, sf), RULES).drop("rule_ix")


NEVER = Rule("Refund Then Error", ("refund", "error"))


@query(
    "build",
    WITH_CANON + f"""SELECT 'error-then-purchase' AS rule_id, count(*) AS edges, sum(src) AS srcs, sum(dst) AS dsts FROM ({pair_sql('error', 'purchase')})
      UNION ALL SELECT 'signup-then-view-same-session', count(*), sum(src), sum(dst) FROM ({pair_sql('signup', 'view', 'computer, logon_id', 'AND logon_id IS NOT NULL')})""",
)
def built(spark, sf):
    out = b.build(canon(spark, sf), [*RULES, NEVER])
    return out.edges.groupBy("rule_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("src").alias("srcs"), F.sum("dst").alias("dsts"))


@query(
    "build_outcomes",
    WITH_CANON + f"""SELECT 'error-then-purchase' AS rule_id, count(*) AS matches, count(*) AS relations, CAST(0 AS BIGINT) AS removed,
        (SELECT count(*) FROM canon WHERE ts_ns IS NULL) AS skipped_undated, CAST(0 AS BIGINT) AS skipped_no_keys, CAST(0 AS BIGINT) AS unresolved_parents,
        0 AS graph_discarded FROM ({pair_sql('error', 'purchase')})
      UNION ALL SELECT 'signup-then-view-same-session', count(*), count(*), 0, (SELECT count(*) FROM canon WHERE ts_ns IS NULL),
        (SELECT count(*) FROM canon WHERE ts_ns IS NOT NULL AND logon_id IS NULL), 0, 0
        FROM ({pair_sql('signup', 'view', 'computer, logon_id', 'AND logon_id IS NOT NULL')})
      UNION ALL SELECT 'refund-then-error', 0, 0, 0, (SELECT count(*) FROM canon WHERE ts_ns IS NULL), 0, 0, 1""",
)
def outcomes(spark, sf):
    out = b.build(canon(spark, sf), [*RULES, NEVER]).outcomes
    return out.select(
        "rule_id", "matches", "relations", "removed", "skipped_undated", "skipped_no_keys", "unresolved_parents",
        F.col("graph_discarded").cast("int").alias("graph_discarded"),
    )


@query(
    "dry_run",
    WITH_CANON + f""", m AS ({pair_sql('error', 'purchase')}),
      s AS (SELECT *, row_number() OVER (ORDER BY computer, ts_ns, dst) AS sample FROM m QUALIFY sample <= 20)
      SELECT CAST(sample AS INT) AS sample, 'm-' || src || '-' || dst || '-2' AS match_id, step, c.id, c.event_code, c.ts_ns, c.computer, c.provider, c.channel, c."user"
      FROM (SELECT sample, src, dst, 0 AS step, src AS id FROM s UNION ALL SELECT sample, src, dst, 1, dst FROM s) x JOIN canon c ON c.id = x.id""",
)
def dry(spark, sf):
    _, samples = b.dry_run(canon(spark, sf), BUYS, 20)
    return samples


@query(
    "dry_run_counts",
    WITH_CANON + f"""SELECT count(*) AS relations, count(*) AS matches, CAST(0 AS BIGINT) AS unresolved,
        (SELECT count(*) FROM canon WHERE ts_ns IS NULL) AS skipped_undated,
        (SELECT count(*) FROM canon WHERE ts_ns IS NOT NULL AND logon_id IS NULL) AS skipped_no_keys,
        (SELECT count(*) FROM canon WHERE ts_ns IS NOT NULL AND corr_version <> 2) AS stale_keys
      FROM ({pair_sql('signup', 'view', 'computer, logon_id', 'AND logon_id IS NOT NULL')})""",
)
def dry_counts(spark, sf):
    counts, _ = b.dry_run(canon(spark, sf), SESSION, 20)
    return counts


def _handovers(events, rule):
    """A matcher of its own kind: two events of the rule's codes on one computer within the same minute."""
    first, second = rule.sequence
    at = lambda code, name: events.filter((F.col("event_code") == code) & F.col("ts_ns").isNotNull()).select(
        "computer", F.call_function("div", F.col("ts_ns"), F.lit(60_000_000_000)).alias("minute"), F.col("id").alias(name)
    )
    pairs = at(first, "src").join(at(second, "dst"), ["computer", "minute"])
    match = e.match_id(F.col("src"), F.col("dst"), F.lit(2))
    edges = pairs.select(
        e.edge_id(F.lit(rule.rule_id), match, F.lit(0)).alias("edge_id"), "src", "dst", F.lit(None).cast("bigint").alias("graph_id"),
        F.lit(rule.relation_type).alias("relation_type"), F.lit("").alias("label"), F.lit(1.0).alias("confidence"), F.lit("system").alias("created_by"),
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.algorithm).alias("algorithm"), match.alias("match_id"), F.lit(0).alias("step_index"),
        F.array().cast("array<string>").alias("basis"), F.lit(model.RELATION_VERSION).alias("rel_version"),
    )
    n = edges.count()
    return edges, {"matches": n, "unresolved": 0, "relations": n}


@query(
    "register_matcher",
    WITH_CANON + f""", h AS (SELECT a.id AS src, b.id AS dst FROM canon a JOIN canon b ON a.computer = b.computer AND a.ts_ns // 60000000000 = b.ts_ns // 60000000000
        WHERE a.event_code = 'view' AND b.event_code = 'signup')
      SELECT 'handover' AS rule_id, count(*) AS edges, sum(src) AS srcs, sum(dst) AS dsts FROM h HAVING count(*) > 0
      UNION ALL SELECT 'error-then-purchase', count(*), sum(src), sum(dst) FROM ({pair_sql('error', 'purchase')})""",
)
def registered(spark, sf):
    b.register_matcher("handover", _handovers)
    out = b.build(canon(spark, sf), [BUYS, Rule("Handover", ("view", "signup"), "handover")])
    return out.edges.groupBy("rule_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("src").alias("srcs"), F.sum("dst").alias("dsts"))


# The shared events know five codes; for the built-in rules each event gets one of the rules' own codes, by its id.
RULE_CODES = sorted({c for r in builtin_rules() for c in (*r.step_codes, *((r.lineage_exit_id,) if r.algorithm == "lineage" else ()))})


def recoded(events):
    """The events under the codes of the built-in rules."""
    place = F.pmod(F.call_function("div", F.col("id") * (F.col("id") + 7), F.lit(3)), F.lit(len(RULE_CODES)))
    return events.withColumn("event_code", F.element_at(F.array(*[F.lit(c) for c in RULE_CODES]), (place + 1).cast("int")))


def _quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def builtin_rules_sql() -> str:
    """Rules as a table; earliest steps by jumps, timed rules (one code again and again, then another) by a sweep."""
    rules = [r for r in builtin_rules() if r.algorithm != "lineage"]
    listed = ", ".join(
        f"('{r.rule_id}', '{r.algorithm}', {_quoted(r.sequence)}, '{r.match_fields[0] if r.match_fields else ''}', CAST({r.within_ns or 0} AS BIGINT))" for r in rules
    )
    tree = next(r for r in builtin_rules() if r.algorithm == "lineage")
    create, leave = f"'{tree.lineage_create_ids[0]}'", f"'{tree.lineage_exit_id}'"
    life = _LIFE.replace(f"WITH RECURSIVE {CANON},", "").replace("FROM canon", "FROM coded").replace("'signup', 'error'", f"{create}, {leave}").replace("'signup'", create)
    return f"""WITH RECURSIVE {CANON},
      coded AS (SELECT * REPLACE ({_quoted(RULE_CODES)}[1 + (id * (id + 7) // 3) % {len(RULE_CODES)}] AS event_code) FROM canon),
      rules(rule_id, kind, codes, slot, within) AS (VALUES {listed}),
      rows AS (
        SELECT *, row_number() OVER (PARTITION BY rule_id, g ORDER BY ts_ns, id) AS rn FROM (
          SELECT rule_id, kind, codes, within, id, ts_ns, event_code,
            concat_ws('|', computer, CASE slot WHEN 'logon_id' THEN logon_id WHEN 'target_user' THEN target_user END) AS g
          FROM rules JOIN coded ON list_contains(codes, event_code)
          WHERE ts_ns IS NOT NULL AND (slot <> 'logon_id' OR logon_id IS NOT NULL) AND (slot <> 'target_user' OR target_user IS NOT NULL))),
      walk(rule_id, codes, g, k, rn) AS (
        SELECT rule_id, any_value(codes), g, 0, min(rn) FROM rows WHERE kind <> 'temporal' AND event_code = codes[1] GROUP BY rule_id, g
        UNION ALL
        SELECT rule_id, codes, g, k, rn FROM (SELECT w.rule_id, w.codes, w.g, w.k + 1 AS k, (SELECT min(r.rn) FROM rows r
            WHERE r.rule_id = w.rule_id AND r.g = w.g AND r.rn > w.rn AND r.event_code = w.codes[1 + (w.k + 1) % len(w.codes)]) AS rn FROM walk w) WHERE rn IS NOT NULL),
      stepwise AS (SELECT rule_id, sum(n) AS matches FROM (SELECT rule_id, g, (max(k) + 1) // any_value(len(codes)) AS n FROM walk GROUP BY rule_id, g) GROUP BY rule_id),
      sweep(rule_id, g, rn, near, last, done) AS (
        SELECT DISTINCT rule_id, g, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false FROM rows WHERE kind = 'temporal'
        UNION ALL
        SELECT s.rule_id, s.g, r.rn,
          CASE WHEN event_code = codes[1] THEN CASE WHEN ts_ns - s.last <= within THEN s.near + 1 ELSE 1 END WHEN fin THEN 0 ELSE s.near END,
          CASE WHEN event_code = codes[1] THEN ts_ns WHEN fin THEN NULL ELSE s.last END, fin
        FROM sweep s JOIN rows r ON r.rule_id = s.rule_id AND r.g = s.g AND r.rn = s.rn + 1,
        LATERAL (SELECT coalesce(event_code = codes[-1] AND s.near >= len(codes) - 1 AND ts_ns - s.last <= within, false) AS fin)),
      timed AS (SELECT rule_id, count(*) FILTER (done) AS matches FROM sweep GROUP BY rule_id),
      {life.strip()},
      found AS (SELECT * FROM stepwise UNION ALL SELECT * FROM timed)
      SELECT r.rule_id, CAST(coalesce(f.matches, 0) AS BIGINT) AS matches, CAST(coalesce(f.matches, 0) * (len(r.codes) - 1) AS BIGINT) AS relations,
        CASE r.slot WHEN 'logon_id' THEN (SELECT count(*) FROM coded WHERE ts_ns IS NOT NULL AND logon_id IS NULL)
          WHEN 'target_user' THEN (SELECT count(*) FROM coded WHERE ts_ns IS NOT NULL AND target_user IS NULL) ELSE 0 END AS skipped_no_keys,
        CAST(0 AS BIGINT) AS unresolved_parents
      FROM rules r LEFT JOIN found f USING (rule_id)
      UNION ALL SELECT '{tree.rule_id}', count(p), count(p), 0, count(*) - count(p) FROM resolved"""


@query("builtin_rules", builtin_rules_sql())
def library(spark, sf):
    """Matches and edges of every built-in rule."""
    out = b.build(recoded(canon(spark, sf)), builtin_rules()).outcomes
    return out.select("rule_id", "matches", "relations", "skipped_no_keys", "unresolved_parents")


@query(
    "equal_times",
    """WITH o AS (SELECT o_orderkey AS id, o_custkey % 10 AS g, epoch_us(o_orderdate) AS t, o_orderstatus AS c FROM orders WHERE o_orderstatus IN ('F', 'O')),
      r AS (SELECT *, lag(c) OVER (PARTITION BY g ORDER BY t, id) AS before FROM o),
      p AS (SELECT *, lag(id) OVER (PARTITION BY g ORDER BY t, id) AS prev_id FROM r WHERE c <> coalesce(before, 'O'))
      SELECT CAST(g AS VARCHAR) AS scope, prev_id || '>' || id AS chain FROM p WHERE c = 'O'""",
)
def equal_times(spark, sf):
    """Many orders share a date, so the id decides their order."""
    ev = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("event_code"),
        epoch_ns(F.col("o_orderdate")).alias("ts_ns"),
        (F.col("o_custkey") % 10).cast("string").alias("computer"),
        *[F.lit(None).cast("string").alias(s) for s in model.SLOTS],
    )
    return _chain(match_sequence(ev, ["F", "O"]), "scope")
