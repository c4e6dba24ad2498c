"""Sources, identity and slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspan import model
from chainspan.catalog.frames import CANON, COPIES, WITH_CANON, canon, copies, findings, table, FINDINGS
from chainspan.catalog.registry import query
from chainspan.functions import (
    canon_identifier,
    coerce_timestamp,
    epoch_ns,
    filetime_to_ns,
    hash_raw as hash_raw_column,
    image_basename,
    truncate_bytes,
)
from chainspan.functions.times import filetime_problem, whole_div
from chainspan.operators import identity, slots
from chainspan.operators.query import event_detail
from chainspan.sources import export, tables
from chainspan.sources.payload import flatten_payload
from chainspan.sources.xml import shred_event_xml


def _aliased(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("EventID"),
        F.col("ts").alias("System_Time"),
        F.concat(F.lit("P-"), (k % 5).cast("string")).alias("Provider_Name"),
        F.lit("Security").alias("LogName"),
        F.concat(F.lit("HOST-"), (F.col("user_id") % 10).cast("string")).alias("HostName"),
        F.col("user_id").alias("SID"),
        F.col("value").alias("unused"),
    )


@query(
    "resolve_columns",
    """SELECT event_type AS event_id, epoch_us(ts) * 1000 AS ts_ns,
       'P-' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 5 AS VARCHAR) AS provider, 'Security' AS channel,
       'HOST-' || CAST(user_id % 10 AS VARCHAR) AS computer, CAST(user_id AS VARCHAR) AS "user", '' AS raw_xml
       FROM events""",
)
def resolve_columns(spark, sf):
    df = tables.resolve_columns(_aliased(spark, sf))
    return df.select("event_id", epoch_ns(F.col("timestamp")).alias("ts_ns"), "provider", "channel", "computer", "user", "raw_xml")


_K = "CAST(json_extract_string(props, '$.k') AS INT)"


def _time_texts(spark, sf):
    """Each event's time written in one of eight ways."""
    ev = table(spark, sf, "events")
    way = F.col("event_id") % 8
    ns = epoch_ns(F.col("ts"))
    fmt = lambda p: F.date_format("ts", p)
    text = (
        F.when(way == 0, whole_div(ns, 1_000_000_000).cast("string"))
        .when(way == 1, whole_div(ns, 1_000_000).cast("string"))
        .when(way == 2, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
        .when(way == 3, F.concat(F.lit("  "), fmt("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("789")))
        .when(way == 4, fmt("yyyy-MM-dd HH:mm:ss"))
        .when(way == 5, fmt("yyyy-MM-dd'T'HH:mm:ss"))
        .when(way == 6, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .otherwise(F.concat(F.lit("at "), fmt("HH:mm")))
    )
    return ev.select(F.col("event_id").alias("id"), text.alias("t"))


@query(
    "coerce_timestamp",
    """SELECT event_id AS id, CASE event_id % 8
         WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000000
         WHEN 1 THEN epoch_us(ts) // 1000 * 1000000
         WHEN 2 THEN epoch_us(ts) * 1000
         WHEN 3 THEN epoch_us(ts) * 1000 + 789
         WHEN 4 THEN epoch_us(ts) // 1000000 * 1000000000
         WHEN 5 THEN epoch_us(ts) // 1000000 * 1000000000
         WHEN 6 THEN (epoch_us(ts) // 1000000 - 7200) * 1000000000 END AS ts_ns
       FROM events""",
)
def coerce_timestamps(spark, sf):
    return _time_texts(spark, sf).select("id", coerce_timestamp(F.col("t")).alias("ts_ns"))


@query(
    "quarantine",
    f"""SELECT coalesce(reason, 'good') AS reason, provider, count(*) AS n, sum(id) AS ids FROM (
          SELECT event_id AS id, 'P-' || CAST({_K} % 5 AS VARCHAR) AS provider,
            CASE WHEN {_K} % 10 = 1 THEN 'empty timestamp' WHEN {_K} % 10 = 2 THEN 'unrecognized timestamp'
                 WHEN {_K} % 10 = 3 THEN 'empty event id' WHEN {_K} % 10 IN (4, 5) THEN 'time out of range' END AS reason
          FROM events) GROUP BY ALL""",
)
def quarantined(spark, sf):
    k = F.col("k")
    raw = _with_k(spark, sf).select(
        F.when(k % 10 == 3, "  ").otherwise(F.col("event_type")).alias("event_id"),
        F.when(k % 10 == 1, " ").when(k % 10 == 2, "soon").when(k % 10 == 4, "1601-01-01 00:00:00").when(k % 10 == 5, "9999-12-31T23:59:59Z").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.concat(F.lit("P-"), (k % 5).cast("string")).alias("provider"),
        F.lit("c").alias("channel"),
        F.lit("h").alias("computer"),
        F.col("event_id").cast("string").alias("user"),
    )
    good, rejected = tables.quarantine(tables.resolve_columns(raw))
    both = good.select(F.lit("good").alias("reason"), "provider", "user").unionByName(
        rejected.select("reason", "provider", "user")
    )
    return both.groupBy("reason", "provider").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("user").cast("bigint")).alias("ids")
    )


@query(
    "message_catalogue",
    """SELECT CAST(c_custkey AS VARCHAR) AS event_code, coalesce(n_name, '') AS provider, c_name AS message,
         sha256(c_name) AS hash_raw,
         sha256(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), coalesce(n_name, ''), '', '', '', c_name)) AS hash_normalized
       FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON n_nationkey = c_nationkey""",
)
def message_catalogue(spark, sf):
    messages = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("EID"), F.col("c_nationkey").alias("source_id"), F.col("c_name").alias("Text")
    )
    providers = (
        table(spark, sf, "nation").filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    )
    good, _ = tables.message_catalogue(messages, providers)
    return good.select("event_code", "provider", "message", "hash_raw", "hash_normalized")


@query(
    "shred_event_xml",
    f"""SELECT event_id AS id, event_type AS event_code, epoch_us(ts) * 1000 AS ts_ns, 'P & Co' AS provider,
          'Security' AS channel, 'HOST-' || CAST(user_id % 10 AS VARCHAR) AS computer, 'U-' || user_id AS "user",
          event_id AS record_id,
          CASE WHEN {_K} % 3 = 0 THEN 'Kind=' || event_type || ';User=' || user_id
               WHEN {_K} % 3 = 1 THEN 'NewProcessId=0x1;ProcessId=' || user_id
               ELSE '' END AS fields
        FROM events WHERE {_K} <> 99""",
)
def shredded(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id").cast("string")
    wrap = lambda a, b, c: F.concat(F.lit(a), b, F.lit(c))
    data = (
        F.when(
            k % 3 == 0,
            F.concat(
                F.lit("<UserData><Log xmlns='u'><Kind>"), F.col("event_type"), F.lit("</Kind><In><User> "), user,
                F.lit(" </User></In></Log></UserData>"),
            ),
        )
        .when(
            k % 3 == 1,
            F.concat(
                F.lit("<EventData><Data Name='ProcessId'>9</Data><Data>x</Data><Data Name='NewProcessId'>0x1</Data><Data Name='ProcessId'>"),
                user,
                F.lit("</Data></EventData>"),
            ),
        )
        .otherwise("")
    )
    raw = F.concat(
        F.lit("<Event xmlns='e'><System><Provider Name='P &amp; Co' Guid='g'/>"),
        wrap("<EventID>", F.col("event_type"), "</EventID>"),
        wrap("<TimeCreated SystemTime='", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "000Z'/>"),
        wrap("<EventRecordID>", F.col("event_id").cast("string"), "</EventRecordID><Channel>Security</Channel>"),
        wrap("<Computer>HOST-", (F.col("user_id") % 10).cast("string"), "</Computer>"),
        wrap("<Security UserID='U-", user, "'/></System>"),
        data,
        F.when(k == 99, "").otherwise("</Event>"),
    )
    good, _ = shred_event_xml(table(spark, sf, "events").select(F.col("event_id").alias("id"), raw.alias("raw")))
    return good.select(
        "id", "event_code", "ts_ns", "provider", "channel", "computer", "user", "record_id", _joined("fields")
    )


def _joined(fields: str):
    pairs = F.transform(F.sort_array(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(pairs, ";"), F.lit("")).alias(fields)


@query(
    "flatten_payload",
    f"""SELECT event_id AS id, 'a.k=' || {_K} || ';a.o.t=' || event_type || ';a.o.x=' ||
          CASE WHEN event_id % 3 = 0 THEN ';d.e.f.g.h.i=' || user_id || ';d.e.f.g.n=end' ELSE '' END || ';l=[' || user_id || ',"z"]' || ';ok=true'
          AS fields FROM events""",
)
def flattened(spark, sf):
    k = F.get_json_object("props", "$.k")
    doc = F.concat(
        F.lit('{"ok": true, "a": {"k": '), k, F.lit(', "o": {"t": "'), F.col("event_type"),
        F.lit('", "x": null}}, "a.k": '), k,
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "d": {"e": {"f": {"g": {"h": {"i": '), F.col("user_id").cast("string"), F.lit('}, "n": "end"}}}}'))).otherwise(F.lit("")),
        F.lit(', "l": ['), F.col("user_id").cast("string"), F.lit(', "z"]}'),
    )
    flat = table(spark, sf, "events").select(F.col("event_id").alias("id"), flatten_payload(doc).alias("fields"))
    return flat.select("id", _joined("fields"))


@query("filetime_to_ts", WITH_CANON + "SELECT id, ts_ns FROM canon")
def filetime(spark, sf):
    ticks = F.coalesce(F.call_function("div", F.col("ts_ns"), F.lit(100)) + 116_444_736_000_000_000, F.lit(0))
    return canon(spark, sf).select("id", ticks.alias("ft")).select("id", filetime_to_ns(F.col("ft")).alias("ts_ns"))


@query(
    "filetime_problem",
    WITH_CANON + "SELECT id, CASE WHEN id % 7 IN (1, 2) THEN 'time out of range' ELSE '' END AS problem FROM canon",
)
def filetime_problems(spark, sf):
    """Ticks of 1601 and of the far future have no time and say so; zero has none and is fine."""
    ticks = F.when(F.col("id") % 7 == 0, 0).when(F.col("id") % 7 == 1, 1).when(F.col("id") % 7 == 2, 9_000_000_000_000_000_000)
    ticks = ticks.otherwise(F.coalesce(F.call_function("div", F.col("ts_ns"), F.lit(100)) + 116_444_736_000_000_000, F.lit(0)))
    return canon(spark, sf).select("id", F.coalesce(filetime_problem(ticks), F.lit("")).alias("problem"))


@query(
    "stamp_source",
    "SELECT event_id AS id, 'file' AS source_type, 'events.parquet' AS source_identifier FROM events",
)
def stamped(spark, sf):
    df = tables.stamp_source(table(spark, sf, "events"), "file")
    return df.select(F.col("event_id").alias("id"), "source_type", F.element_at(F.split("source_identifier", "/"), -1).alias("source_identifier"))


_EXPORT = """SELECT id, event_code AS event_id,
   coalesce(strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S.%f') || '000Z', '') AS "timestamp",
   provider, channel, computer, "user", hash_raw, c.hash_normalized"""


@query(
    "export_events",
    f"WITH {CANON}, {FINDINGS} " + _EXPORT + """,
     CASE WHEN f.key IS NULL THEN '' WHEN flagged THEN 'true' ELSE 'false' END AS finding_flagged,
     coalesce(array_to_string(tags, '; '), '') AS finding_tags, coalesce(note, '') AS finding_note
     FROM canon c LEFT JOIN findings f ON f.key = c.hash_normalized""",
)
def exported(spark, sf):
    ev = canon(spark, sf)
    return export.export_frame(ev, findings(ev))


@query(
    "event_detail",
    WITH_CANON + """SELECT pos, c.id, event_code, ts_ns, computer, props AS raw
     FROM (VALUES (0, 500), (1, 3), (2, 999), (3, 500)) AS w(pos, id) JOIN canon c ON c.id = w.id
     JOIN events e ON e.event_id = c.id""",
)
def detail(spark, sf):
    ev = canon(spark, sf).select("id", "event_code", "ts_ns", "computer")
    payload = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("raw"))
    return event_detail(ev, payload, [500, 3, 999, 500, -1])


@query("hash_raw", "SELECT doc_id, sha256(text) AS hash_raw FROM documents")
def raw_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hash_raw_column(F.col("text")).alias("hash_raw"))


@query("hash_normalized", WITH_CANON + "SELECT id, hash_normalized FROM canon")
def content_hashes(spark, sf):
    return canon(spark, sf).select("id", "hash_normalized")


_ALL = f"WITH {CANON}, {COPIES}, seen AS (SELECT * FROM canon UNION ALL SELECT * FROM copies) "
_PER = """per AS (SELECT hash_normalized, source_identifier AS s, count(*) AS n FROM {t} GROUP BY ALL),
 counts AS (SELECT hash_normalized, CAST(sum(n) AS BIGINT) AS dedup_count, string_agg(s || '=' || n, ';' ORDER BY s) AS source_counts
            FROM per GROUP BY 1)"""


def _counts_text():
    pairs = F.transform(F.array_sort(F.map_entries("source_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(pairs, ";").alias("source_counts")


@query(
    "dedup",
    _ALL + "," + _PER.format(t="seen") + """
     SELECT id, event_code, ts_ns, hash_raw, seen.hash_normalized, dedup_count, source_counts FROM seen JOIN counts USING (hash_normalized)
     QUALIFY row_number() OVER (PARTITION BY seen.hash_normalized ORDER BY id) = 1""",
)
def deduplicated(spark, sf):
    out = identity.dedup(canon(spark, sf).unionByName(copies(spark, sf)))
    return out.select("id", "event_code", "ts_ns", "hash_raw", "hash_normalized", "dedup_count", _counts_text())


_DIVERGENT = """SELECT count(*) AS n FROM (SELECT hash_raw, first_value(hash_raw) OVER (PARTITION BY hash_normalized ORDER BY id) AS f FROM seen)
   WHERE hash_raw <> f"""


@query("divergent_duplicates", _ALL + f"SELECT CAST(n AS BIGINT) AS divergent FROM ({_DIVERGENT})")
def divergent(spark, sf):
    return identity.divergent_duplicates(canon(spark, sf).unionByName(copies(spark, sf)))


@query(
    "merge_batch",
    _ALL + "," + _PER.format(t="seen") + """
     SELECT id, event_code, hash_raw, seen.hash_normalized, dedup_count, source_counts FROM seen JOIN counts USING (hash_normalized)
     QUALIFY row_number() OVER (PARTITION BY seen.hash_normalized ORDER BY id >= 10000000, id) = 1""",
)
def merged(spark, sf):
    """The Application half is stored first; the Security half and all copies arrive as a batch."""
    ev = canon(spark, sf)
    old = identity.dedup(ev.filter("channel = 'Application'"))
    batch = ev.filter("channel = 'Security'").unionByName(copies(spark, sf))
    out = identity.merge_batch(old, batch)
    return out.select("id", "event_code", "hash_raw", "hash_normalized", "dedup_count", _counts_text())


@query(
    "ingest_summary",
    _ALL + f""", good AS (SELECT * FROM seen WHERE value <= 95)
     SELECT count(*) AS read, count(DISTINCT hash_normalized) AS persisted, count(*) - count(DISTINCT hash_normalized) AS duplicate,
       (SELECT count(*) FROM seen WHERE value > 95) AS skipped, count(*) FILTER (ts_ns IS NULL) AS undated,
       (SELECT CAST(n AS BIGINT) FROM ({_DIVERGENT.replace("FROM seen)", "FROM good)")})) AS divergent FROM good""",
)
def summary(spark, sf):
    seen = canon(spark, sf).unionByName(copies(spark, sf))
    return identity.ingest_summary(seen.filter("value <= 95"), seen.filter("value > 95"))


def _with_k(spark, sf):
    """Events with the number in their properties as a column, read once for each row."""
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _fields(spark, sf):
    """Field maps as a reader would deliver them, names in mixed case."""
    k, e = F.col("k"), F.lit
    fields = F.create_map(
        e("targetlogonid"), F.when(k % 4 == 0, "-").otherwise(k.cast("string")),
        e("SubjectLogonId"), F.concat(e("0x"), F.upper(F.hex(F.col("event_id")))),
        e(" ProcessId"), F.when(k % 3 == 0, "0x0").otherwise(F.col("user_id").cast("string")),
        e("NewProcessName"), F.concat(e("C:\\Tools\\"), F.col("event_type"), e(".EXE")),
        e("TargetUserName"), F.when(k % 5 == 0, "N/A").otherwise(F.concat(e("Usér-With-A-Näme-Löng-Enough-"), F.col("user_id").cast("string"))),
        e("AccountName"), e("Fallback"),
        e("IpAddress"), F.when(k % 2 == 0, e(" 10.0.0.1 ")),
    )
    return _with_k(spark, sf).select(F.col("event_id").alias("id"), fields.alias("fields"))


_SLOT_SQL = f"""SELECT event_id AS id,
   CASE WHEN {_K} % 4 = 0 OR {_K} = 0 THEN CASE WHEN event_id <> 0 THEN '0x' || lower(to_hex(event_id)) END ELSE '0x' || lower(to_hex({_K})) END AS logon_id,
   CASE WHEN event_id <> 0 THEN '0x' || lower(to_hex(event_id)) END AS subject_logon_id,
   CASE WHEN {_K} % 3 <> 0 AND user_id <> 0 THEN '0x' || lower(to_hex(user_id)) END AS process_id,
   CAST(NULL AS VARCHAR) AS new_process_id, CAST(NULL AS VARCHAR) AS parent_process_id,
   event_type || '.exe' AS process_name,
   CASE WHEN {_K} % 5 = 0 THEN 'fallback' ELSE 'usér-with-a-näme-löng-enough-' || user_id END AS target_user,
   CAST(NULL AS VARCHAR) AS subject_user,
   CASE WHEN {_K} % 2 = 0 THEN '10.0.0.1' END AS ip_address, CAST(NULL AS VARCHAR) AS service_name
   FROM events"""


@query("extract_slots", _SLOT_SQL)
def extracted(spark, sf):
    return slots.extract_slots(_fields(spark, sf)).select("id", *model.SLOTS)


@query(
    "canon_identifier",
    f"""SELECT event_id AS id, CASE {_K} % 5
          WHEN 0 THEN CASE WHEN event_id <> 0 THEN '0x' || lower(to_hex(event_id * 7654321)) END
          WHEN 1 THEN CASE WHEN event_id <> 0 THEN '0x' || lower(to_hex(event_id)) END
          WHEN 2 THEN NULL WHEN 3 THEN event_type ELSE '0xffffffffffffffff' END AS identifier
        FROM events""",
)
def identifiers(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 5
    text = (
        F.when(k == 0, (F.col("event_id") * 7654321).cast("string"))
        .when(k == 1, F.concat(F.lit("0X00"), F.hex("event_id")))
        .when(k == 2, "0x000")
        .when(k == 3, F.upper("event_type"))
        .otherwise("18446744073709551615")
    )
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), canon_identifier(text).alias("identifier"))


@query(
    "image_basename",
    f"""SELECT event_id AS id, CASE {_K} % 3 WHEN 0 THEN event_type || '.exe' WHEN 1 THEN event_type END AS image FROM events""",
)
def basenames(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    path = (
        F.when(k == 0, F.concat(F.lit("C:\\Program Files\\App/"), F.upper("event_type"), F.lit(".EXE ")))
        .when(k == 1, F.col("event_type"))
        .otherwise(F.concat(F.lit("/usr/"), F.col("event_type"), F.lit("/")))
    )
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), image_basename(path).alias("image"))


@query(
    "truncate_bytes",
    """SELECT doc_id, left(text, CAST(list_max(list_filter(range(0, 65), lambda n: strlen(left(text, n)) <= 64)) AS BIGINT)) AS cut
       FROM documents""",
)
def cut_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", truncate_bytes(F.col("text"), 64).alias("cut"))


@query(
    "projection_status",
    WITH_CANON + """SELECT count(*) AS total, count(*) FILTER (corr_version = 2) AS current, count(*) FILTER (corr_version <> 2) AS stale
                    FROM canon""",
)
def status(spark, sf):
    return slots.projection_status(canon(spark, sf))


_CANON_SLOTS = ", ".join(f"c.{s}" for s in model.SLOTS)
_FRESH_SLOTS = ", ".join(f"f.{s}" for s in model.SLOTS)


@query(
    "backfill_slots",
    f"WITH {CANON}, fresh AS ({_SLOT_SQL}) " + f"""
     SELECT c.id, {_FRESH_SLOTS}, 2 AS corr_version FROM canon c JOIN fresh f USING (id) WHERE corr_version <> 2 AND event_code <> 'view'
     UNION ALL SELECT c.id, {_CANON_SLOTS}, corr_version FROM canon c WHERE corr_version = 2 OR event_code = 'view'""",
)
def backfilled(spark, sf):
    """The payload of views cannot be read, so stale views stay stale."""
    ev = canon(spark, sf)
    kept = ev.filter("event_code <> 'view'").select("id")
    payload = _fields(spark, sf).join(kept, "id", "left_semi")
    out, _ = slots.backfill_slots(ev, payload)
    return out.select("id", *model.SLOTS, "corr_version")


@query(
    "slot_coverage",
    WITH_CANON + " UNION ALL ".join(f"SELECT '{s}' AS slot, count({s}) AS events FROM canon" for s in model.SLOTS),
)
def coverage(spark, sf):
    return slots.slot_coverage(canon(spark, sf))
