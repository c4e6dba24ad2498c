"""SimHash fingerprints of documents, with DataFrame operations only.

Terms are word trigrams (the last ones of a text are shorter, so that a text of one word has a term), weighted by how
often they occur and by the length of their words. Each term's hash votes, with its weight, for or against each bit.

Votes are summed in lanes: two 32-bit counters lie in one long, so 64 sums make 128 votes. Explode, hash and partial sums
run in one stage per input task; what is shuffled is one row of sums per text and task.

Results in edge cases: null and empty texts have no terms and the fingerprint of zeros; equal texts have equal
fingerprints whatever their ids; repeated rows are separate documents; null ids come first in the order.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspan.llm.common import words
from chainspan.llm.ordering import following, ranges

BITS = 128
#: Bit 0 of each 32-bit lane of a long.
LANES = 0x0000000100000001
#: A term counts as many times as its words have letters, up to this.
MOST_WEIGHT = 24


def fingerprints(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, low, high): the fingerprint as two longs, one row per distinct key; rows of a key are taken together."""
    w = words(F.col(text))
    d = df.select(F.col(key).alias("key"), w.alias("w"))
    d = d.select("key", F.explode_outer(F.arrays_zip(F.col("w"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("x"), F.expr("slice(w, 3, greatest(size(w) - 2, 0))").alias("y"))).alias("t"))
    a, b, c = F.col("t.w"), F.col("t.x"), F.col("t.y")
    length = lambda x: F.coalesce(F.length(x), F.lit(0))
    d = d.select(
        "key",
        F.when(a.isNotNull(), F.least(F.lit(MOST_WEIGHT), length(a) + length(b) + length(c))).otherwise(0).cast("long").alias("n"),
        F.xxhash64(a, b, c).alias("h"),
    ).withColumn("g", F.xxhash64("h"))
    mask = F.lit(LANES)
    ones = lambda h, k: F.sum(F.shiftrightunsigned(F.col(h), k).bitwiseAND(mask) * F.col("n"))
    sums = d.groupBy("key").agg(F.sum("n").alias("total"), *[ones(h, k).alias(f"{h}{k}") for h in "hg" for k in range(32)])

    def bit(h: str, k: int) -> list[Column]:
        s = F.col(f"{h}{k}")
        lanes = (s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32))
        return [F.when(2 * v > F.col("total"), F.lit(1 << p if p < 63 else -(1 << 63))).otherwise(F.lit(0)) for v, p in zip(lanes, (k, k + 32), strict=True)]

    def merged(h: str) -> Column:
        found = [x for k in range(32) for x in bit(h, k)]
        while len(found) > 1:
            found = [found[i].bitwiseOR(found[i + 1]) for i in range(0, len(found), 2)]
        return found[0]

    return sums.select(F.col("key").alias(key), merged("h").alias("low"), merged("g").alias("high"))


def hexed(low: Column, high: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(high)), 16, "0"), F.lpad(F.lower(F.hex(low)), 16, "0"))


def apart(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Bits two fingerprints differ in."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text is the first half of a text followed by as much of the next document's beginning.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    among = ranges(d)
    d = d.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    d = following(d, {"next_text": F.col("text")}, order, among)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.select(
        "doc_id", "tie", n.cast("long").alias("n_chars"), "text",
        F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"),
    ).withColumn("id", F.monotonically_increasing_id())
    # What belongs to a document is short and rides along in the key, so its votes need no join.
    of = ("id", "doc_id", "tie", "n_chars")
    each = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    both = d.select(*of, F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha256"), F.explode(each).alias("e"))
    both = both.select(F.struct(*of, "edited_sha256", "e.which").alias("key"), "e.t")
    prints = fingerprints(both, "key", "t")
    own = lambda c, k: F.max(F.when(F.col("key.which") == k, F.col(c)))
    pairs = prints.groupBy(*[F.col(f"key.{c}").alias(c) for c in of], F.lower(F.hex("key.edited_sha256")).alias("edited_sha256")).agg(
        own("low", 0).alias("low"), own("high", 0).alias("high"), own("low", 1).alias("edited_low"), own("high", 1).alias("edited_high")
    )
    pairs = following(pairs, {"next_low": F.col("low"), "next_high": F.col("high")}, order, among)
    p = {k: (F.col(f"{k}low"), F.col(f"{k}high")) for k in ("", "edited_", "next_")}
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", hexed(*p[""]).alias("fingerprint"), hexed(*p["edited_"]).alias("edited_fingerprint"),
        (1 - apart(p[""], p["edited_"]) / F.lit(float(BITS))).alias("near_edited"), (1 - apart(p[""], p["next_"]) / F.lit(float(BITS))).alias("near_next"),
    )


def within_radius(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(a, b, distance): all pairs of different fingerprints at most ``radius`` bits apart, each once.

    ``prints`` has low and high. Fingerprints are cut into blocks; two within the radius agree in all blocks but
    ``radius``, so each choice of ``blocks - radius`` blocks is a table keyed by these, permuted to the front. Equal
    fingerprints are one class before the search (callers keep the membership by joining on the fingerprint); a pair met
    in several tables is kept in the first one.
    """
    m = blocks or radius + 2
    width = -(-BITS // m)
    d = prints.select("low", "high").distinct()
    text = F.concat(F.lpad(F.conv(F.hex("high"), 16, 2), 64, "0"), F.lpad(F.conv(F.hex("low"), 16, 2), 64, "0"))
    d = d.withColumn("pieces", F.array(*[F.substring(text, i * width + 1, width) for i in range(m)]))
    tables = list(combinations(range(m), m - radius))
    keyed = d.select("low", "high", "pieces", F.posexplode(F.array(*[F.concat_ws("|", *[F.col("pieces")[i] for i in t]) for t in tables])).alias("table", "block"))
    left = keyed.select("table", "block", F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.col("pieces").alias("a_pieces"))
    right = keyed.select("table", "block", F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.col("pieces").alias("b_pieces"))
    met = left.join(right, ["table", "block"]).filter((F.col("a_high") < F.col("b_high")) | ((F.col("a_high") == F.col("b_high")) & (F.col("a_low") < F.col("b_low"))))
    distance = apart((F.col("a_low"), F.col("a_high")), (F.col("b_low"), F.col("b_high")))
    first = F.coalesce(*[F.when(F.forall(F.array(*[F.col("a_pieces")[i] == F.col("b_pieces")[i] for i in t]), lambda x: x), F.lit(k)) for k, t in enumerate(tables)])
    met = met.withColumn("distance", distance).filter((F.col("distance") <= radius) & (F.col("table") == first))
    return met.select(hexed(F.col("a_low"), F.col("a_high")).alias("a"), hexed(F.col("b_low"), F.col("b_high")).alias("b"), "distance")
