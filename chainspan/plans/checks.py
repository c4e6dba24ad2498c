"""Bulk checks over a table of rule documents (``rule_id``, ``doc``): one column expression per check.

A check is a condition on the parsed document. The checks run in the JVM over any number of documents at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspan import model
from chainspan.functions.text import slug, trimmed
from chainspan.functions.times import parse_duration
from chainspan.plans.rules import (
    ALGORITHMS,
    FORMAT_VERSION,
    MAX_RULE_BYTES,
    MAX_SEQUENCE,
    MAX_WINDOW_NS,
    MIN_SEQUENCE,
    SCOPES,
)

# field -> (type in the document, accepted variant types)
_FIELDS = {
    "format_version": ("bigint", "^(BIGINT|VOID)$"),
    "name": ("string", "^(STRING|VOID)$"),
    "description": ("string", "^(STRING|VOID)$"),
    "relation_type": ("string", "^(STRING|VOID)$"),
    "algorithm": ("string", "^(STRING|VOID)$"),
    "sequence": ("array<string>", "^(ARRAY<(STRING|VOID)>|VOID)$"),
    "labels": ("array<string>", "^(ARRAY<(STRING|VOID)>|VOID)$"),
    "match_fields": ("array<string>", "^(ARRAY<(STRING|VOID)>|VOID)$"),
    "match_scope": ("string", "^(STRING|VOID)$"),
    "window_within": ("string", "^(STRING|VOID)$"),
    "window_total": ("string", "^(STRING|VOID)$"),
    "lineage_create_ids": ("array<string>", "^(ARRAY<(STRING|VOID)>|VOID)$"),
    "lineage_depth": ("bigint", "^(BIGINT|VOID)$"),
    "channels": ("array<string>", "^(ARRAY<(STRING|VOID)>|VOID)$"),
}


def _parsed(docs: DataFrame) -> DataFrame:
    """Add one column per field, ``_bad`` (not a rule document) and ``_keys`` (the fields it has)."""
    small = F.octet_length("doc") <= MAX_RULE_BYTES
    shape = ", ".join(f"{n} {kind}" for n, (kind, _) in _FIELDS.items())
    out = docs.withColumn("_too_large", ~small).withColumn("_v", F.when(small, F.try_parse_json("doc")))
    out = out.withColumn("_entries", F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>")))
    expected = F.create_map(*[F.lit(x) for n, (_, accepted) in _FIELDS.items() for x in (n, accepted)])
    wrong = F.exists(
        "_entries",
        lambda e: ~F.coalesce(F.regexp(F.schema_of_variant(e["value"]), F.try_element_at(expected, e["key"])), F.lit(True)),
    )
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    out = (
        out.withColumn("_bad", F.coalesce(~is_object | wrong, F.lit(True)))
        .withColumn("_keys", F.transform("_entries", lambda e: e["key"]))
        .withColumn("_d", F.from_json("doc", shape))
        .select(*docs.columns, "_too_large", "_bad", "_keys", "_d.*")
    )
    blank = F.array().cast("array<string>")
    texts = [n for n, (k, _) in _FIELDS.items() if k == "string"]
    lists = [n for n, (k, _) in _FIELDS.items() if k == "array<string>"]
    fill = {n: F.coalesce(F.col(n), F.lit("")) for n in texts}
    fill |= {n: F.transform(F.coalesce(F.col(n), blank), lambda x: F.coalesce(x, F.lit(""))) for n in lists}
    fill |= {n: F.coalesce(F.col(n), F.lit(0)) for n in ("format_version", "lineage_depth")}
    out = out.withColumns(fill)
    algo = F.when(trimmed(F.col("algorithm")) == "", "sequence").otherwise(trimmed(F.col("algorithm")))
    return out.withColumn("_algo", algo)


def _reads(field: str) -> Column:
    return F.col("_algo").isin([a for a, (_, fields) in ALGORITHMS.items() if field in fields] or [""])


def _once(condition: Column, code: str) -> Column:
    return F.when(condition, F.array(F.struct(F.lit(code).alias("code"), F.lit(-1).alias("at")))).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<code:string,at:int>>")


def _each(items: Column, bad, code: str, when: Column | None = None) -> Column:
    """One error per list entry ``bad(entry, position)`` holds for."""
    marked = F.transform(items, lambda x, i: F.when(bad(x, i), i))
    hits = F.transform(F.filter(marked, lambda i: i.isNotNull()), lambda i: F.struct(F.lit(code).alias("code"), i.alias("at")))
    return hits if when is None else F.when(when, hits).otherwise(_none())


def _duration_errors(field: str) -> Column:
    v = F.col(field)
    d = parse_duration(v)
    given = trimmed(v) != ""
    return F.concat(
        _once(given & (d.isNull() | (d <= 0)), "bad_duration"), _once(given & (d > MAX_WINDOW_NS), "window_too_large")
    )


def _errors() -> Column:
    seq, labels, fields = F.col("sequence"), F.col("labels"), F.col("match_fields")
    needs_seq = F.col("_algo").isin([a for a, (need, _) in ALGORITHMS.items() if need])
    blank = lambda x, i: trimmed(x) == ""
    known = F.array(*[F.lit(s) for s in model.SLOTS])
    clean = F.transform(fields, trimmed)
    repeated = lambda x, i: (
        F.array_contains(known, trimmed(x)) & (F.array_position(clean, trimmed(x)) < i + 1)
    )
    within, total = parse_duration(F.col("window_within")), parse_duration(F.col("window_total"))
    scope = trimmed(F.col("match_scope"))
    unknown_field = _each(fields, lambda x, i: ~F.array_contains(known, trimmed(x)), "unknown_match_field")
    field_errors = F.array_sort(
        F.concat(unknown_field, _each(fields, repeated, "duplicate_match_field")), lambda a, b: a["at"] - b["at"]
    )
    checks = [
        _once(trimmed(F.col("name")) == "", "name_required"),
        _once(needs_seq & (F.size(seq) < MIN_SEQUENCE), "sequence_short"),
        _once(needs_seq & (F.size(seq) > MAX_SEQUENCE), "sequence_long"),
        _each(seq, blank, "sequence_empty_id", needs_seq),
        _once(needs_seq & (F.size(seq) >= MIN_SEQUENCE) & (F.size(labels) > F.size(seq) - 1), "labels_too_many"),
        _once((scope != "") & ~scope.isin(*SCOPES), "unknown_scope"),
        _once((F.col("_algo") == "field") & (F.size(fields) == 0), "match_fields_required"),
        F.when(_reads("match_fields"), field_errors).otherwise(_none()),
        F.when(
            _reads("window_within"),
            F.concat(
                _once(trimmed(F.col("window_within")) == "", "window_required"),
                _duration_errors("window_within"),
                _duration_errors("window_total"),
                _once((total > 0) & (within > 0) & (total < within), "window_total_too_small"),
            ),
        ).otherwise(_none()),
        _each(F.col("lineage_create_ids"), blank, "lineage_ids_empty", _reads("lineage_create_ids")),
        _once(
            _reads("lineage_depth") & (F.col("lineage_depth") < 0), "lineage_depth_range"
        ),
        _each(F.col("channels"), blank, "channel_empty"),
    ]
    return (
        F.when(F.col("_too_large"), _once(F.lit(True), "file_too_large"))
        .when(F.col("_bad"), _once(F.lit(True), "syntax"))
        .when(F.col("format_version") > FORMAT_VERSION, _once(F.lit(True), "unsupported_format"))
        .when(~F.col("_algo").isin(*ALGORITHMS), _once(F.lit(True), "unknown_algorithm"))
        .otherwise(F.concat(*checks))
    )


def validate_rules(docs: DataFrame) -> DataFrame:
    """(rule_id, position, code, at): every error of every document, in order; ``at`` is a list index or -1.

    An unreadable document, a newer format or an unknown algorithm is reported alone.
    """
    found = _parsed(docs).select("rule_id", F.posexplode(_errors()).alias("position", "e"))
    return found.select("rule_id", "position", F.col("e.code").alias("code"), F.col("e.at").alias("at"))


def advise_rules(docs: DataFrame) -> DataFrame:
    """(rule_id, position, code, field): things that are legal but probably not meant."""
    empty = F.array().cast("array<struct<code:string,field:string>>")

    def note(condition: Column, code: str, field: str) -> Column:
        one = F.array(F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
        return F.when(condition, one).otherwise(empty)

    filled = {
        "match_fields": F.size("match_fields") > 0,
        "window_within": trimmed(F.col("window_within")) != "",
        "window_total": trimmed(F.col("window_total")) != "",
        "lineage_create_ids": F.size("lineage_create_ids") > 0,
        "lineage_depth": F.col("lineage_depth") != 0,
    }
    known_algo = F.col("_algo").isin(*ALGORITHMS)
    no_sequence = F.col("_algo").isin([a for a, (need, _) in ALGORITHMS.items() if not need])
    extra = F.array_except("_keys", F.array(*[F.lit(f) for f in _FIELDS]))
    notes = F.concat(
        note(trimmed(F.col("description")) == "", "no_description", "description"),
        note(F.size("channels") == 0, "no_channels", "channels"),
        *[note(known_algo & on & ~_reads(f), "field_not_for_algorithm", f) for f, on in filled.items()],
        note(known_algo & no_sequence & (F.size("sequence") > 0), "sequence_ignored", "sequence"),
        # Legal for every matcher, but then one stream of all computers' events is matched.
        note(known_algo & ~no_sequence & (trimmed(F.col("match_scope")) == "global") & (F.size("match_fields") == 0), "global_without_fields", "match_scope"),
        F.transform(extra, lambda k: F.struct(F.lit("unknown_field").alias("code"), k.alias("field"))),
    )
    ok = _parsed(docs).filter(~F.col("_bad") & ~F.col("_too_large"))
    found = ok.select("rule_id", F.posexplode(notes).alias("position", "e"))
    return found.select("rule_id", "position", F.col("e.code").alias("code"), F.col("e.field").alias("field"))


def effective_rules(builtin: DataFrame, user: DataFrame, enabled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((slug, name, source, enabled) by name, rejected user rules).

    ``builtin(name)``, ``user(name, file)``, ``enabled(slug, enabled)``. A user rule replaces the built-in one with
    the same slug; of user rules with one slug the first file wins. Rules are on unless switched off.
    """
    b = builtin.select(slug(F.col("name")).alias("slug"), trimmed(F.col("name")).alias("name"))
    u = user.select(slug(F.col("name")).alias("slug"), trimmed(F.col("name")).alias("name"), "file")
    first = u.groupBy("slug").agg(F.min("file").alias("file"), F.min_by("name", "file").alias("name"))
    rejected = u.join(first.select("slug", "file"), ["slug", "file"], "left_anti")
    kept = b.join(first.select("slug"), "slug", "left_anti").select("slug", "name", F.lit("builtin").alias("source"))
    both = kept.unionByName(first.select("slug", "name", F.lit("user").alias("source")))
    switch = enabled.select("slug", F.col("enabled").alias("_on"))
    out = both.join(switch, "slug", "left").select("slug", "name", "source", F.coalesce("_on", F.lit(True)).alias("enabled"))
    return out.orderBy("name"), rejected
