"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspan.llm import decontamination, html, jaccard, mixing, quality, simhash, sql, structure, substrings, tokens, toxicity, trie, urls, warc
from chainspan.llm.common import table
from chainspan.llm.registry import query


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a fetch time that follows from its id: some second of 2024."""
    second = F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(31622400))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(second).alias("fetched_at"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block list that follows from the pages: every third page lists its host, every 50th its address, some of them
    are taken off again, and the domains above are listed for a while."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    h = urls.host_of(F.col("url"))
    at = lambda k, least: F.date_add(F.lit("2024-01-01").cast("date"), (F.lit(least) + F.pmod(F.col("page_id") * k, F.lit(200))).cast("int"))
    kinds = [
        ("page_id % 3 = 0", h, "add", at(31, 0)),
        ("page_id % 6 = 0", h, "remove", at(31, 30)),
        ("page_id % 50 = 0", F.concat(h, F.regexp_replace(urls.path_of(F.col("url")), "/+$", "")), "add", at(17, 0)),
        ("page_id % 97 = 0", F.regexp_extract(h, r"[^.]+\.[^.]+$", 0), "add", at(7, 100)),
        ("page_id % 97 = 0", F.regexp_extract(h, r"[^.]+\.[^.]+$", 0), "remove", at(7, 107)),
    ]
    lists = [p.filter(c).select(k.alias("pattern"), F.lit(a).alias("action"), d.alias("dated")) for c, k, a, d in kinds]
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.filter("pattern <> ''")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS h,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path,
    CAST(make_timestamp((1704067200 + (page_id * 7919) % 31622400) * 1000000) AS TIMESTAMP) AS fetched_at
  FROM pages),
e AS (
  SELECT h AS pattern, false AS off, DATE '2024-01-01' + CAST((page_id * 31) % 200 AS INTEGER) AS dated FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT h, true, DATE '2024-01-01' + CAST(30 + (page_id * 31) % 200 AS INTEGER) FROM p WHERE page_id % 6 = 0
  UNION ALL SELECT h || regexp_replace(path, '/+$', ''), false, DATE '2024-01-01' + CAST((page_id * 17) % 200 AS INTEGER) FROM p WHERE page_id % 50 = 0
  UNION ALL SELECT regexp_extract(h, '[^.]+\.[^.]+$'), false, DATE '2024-01-01' + CAST(100 + (page_id * 7) % 200 AS INTEGER) FROM p WHERE page_id % 97 = 0
  UNION ALL SELECT regexp_extract(h, '[^.]+\.[^.]+$'), true, DATE '2024-01-01' + CAST(107 + (page_id * 7) % 200 AS INTEGER) FROM p WHERE page_id % 97 = 0),
d AS (SELECT pattern, dated, bool_or(off) AS off FROM e WHERE pattern <> '' GROUP BY 1, 2),
c AS (SELECT *, coalesce(lag(off) OVER (PARTITION BY pattern ORDER BY dated), true) AS was FROM d),
s AS (SELECT *, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS valid_to FROM c WHERE off <> was),
i AS (SELECT pattern, dated AS valid_from, valid_to FROM s WHERE NOT off),
k AS (
  SELECT DISTINCT page_id, CAST(fetched_at AS DATE) AS d, unnest(
    list_concat(
      list_transform(range(1, greatest(len(string_split(h, '.')), 2)), lambda x: array_to_string(string_split(h, '.')[x:], '.')),
      list_transform(range(1, len(list_filter(string_split(path, '/'), lambda y: y <> '')) + 1), lambda x: h || '/' || array_to_string(list_filter(string_split(path, '/'), lambda y: y <> '')[1:x], '/')))) AS pattern
  FROM p WHERE h <> ''),
m AS (
  SELECT page_id, pattern, valid_from, valid_to, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC, valid_from DESC) AS r
  FROM k JOIN i USING (pattern) WHERE valid_from <= d AND (valid_to IS NULL OR d < valid_to))
SELECT p.page_id, p.url, strftime(p.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, m.pattern IS NOT NULL AS blocked, m.pattern,
  strftime(m.valid_from, '%Y-%m-%d') AS valid_from, strftime(m.valid_to, '%Y-%m-%d') AS valid_to
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.r = 1
"""


@query("op4_url_filter", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(captures(spark, sf_dir), urls.intervals(list_entries(spark, sf_dir)))
    days = {c: F.date_format(c, "yyyy-MM-dd") for c in ("valid_from", "valid_to")}
    return found.withColumns({"fetched_at": F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"), **days})


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


#: Where the public tokenizer lies that the token queries use.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op6_tokens")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.index(spark, tokens.write(table(spark, sf_dir, "documents"), TOKENIZER))


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op9_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query("op10_substrings")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.parsed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op11_prefix_trie", sql.TRIE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(table(spark, sf_dir, "conversations")))


@query("op12_structure_repair", sql.STRUCTURE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return structure.repaired(structure.damaged(turns), turns)


@query("op13_warc", sql.WARC)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.catalogued(table(spark, sf_dir, "pages"))
