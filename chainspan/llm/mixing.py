"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key; within its source the rows lie in key order, split into key ranges, so that no source
needs one task. Words are summed per range first, then running within a range; each source is cut at its exact budget.

Results in edge cases: a null text counts no words; a null source is a source of its own, the last one; repeated rows
are separate documents; rows that agree in key and size are interchangeable. Sources without words take nothing. Columns
beside the four used are kept by ``mixed`` and ignored by ``mix_plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainspan.llm.common import n_words
from chainspan.session import written

#: Rows a key range is meant to hold.
RANGE_ROWS = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the total size. A target stops at
    ``most_epochs`` times its source; the excess goes to the others by weight until none is above. In order of the
    ratio limit / weight the sources that stop come first, so a running sum gives the share per unit of weight.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.withColumn("at", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("limit", (F.col("source_size") * most_epochs).cast("double"))
    every = W.partitionBy()
    by_ratio = W.orderBy((F.col("limit") / F.col("weight")), "at")
    s = (
        s.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("stopped", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("unit", (F.col("total") - F.col("stopped")) / F.col("open"))
    )
    # The first source in ratio order that does not stop sets the share per weight; later ones see the same share.
    fits = F.col("unit") * F.col("weight") <= F.col("limit")
    level = F.first(F.when(fits, F.col("unit")), ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("share", level)
    return s.select("source", "source_size", F.least("limit", F.coalesce(F.col("share") * F.col("weight"), F.col("limit"))).alias("target"))


def mix_plan(
    docs: DataFrame, seed: int = 5, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, whole, taken, last): what the mix takes of each row.

    ``whole`` epochs take all of it, ``taken`` counts words with the part the cut leaves of the last document;
    ``last`` holds on the row the cut goes through if at least half of it lies before the cut.
    """
    sized = written(
        docs.select(
            "doc_id", "source", n_words(F.col("text")).alias("size"),
            F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), 1).alias("key"),
        )
    )
    n = sized.count()
    shift = 63 - max(1, (n // range_rows)).bit_length()
    ranged = sized.withColumn("range", F.shiftright("key", shift))
    cells = ranged.groupBy("source", "range").agg(F.sum("size").alias("cell"))
    plan = targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), weights, most_epochs)
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("source", "range", F.coalesce(F.sum("cell").over(earlier), F.lit(0)).alias("base"))
    starts = cells.join(plan, cells.source.eqNullSafe(plan.source)).select(cells.source, "range", "base", "source_size", "target")
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    r = ranged.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    r = r.join(starts, r.source.eqNullSafe(starts.source) & (r["range"] == starts["range"])).select(
        "doc_id", r.source, "key", "size", "source_size", "target", (F.col("base") + F.col("inner")).alias("before")
    )
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    r = r.withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size") - F.col("before"))
    part = F.greatest(F.lit(0).cast("long"), F.least("left", "size"))
    whole = F.col("epochs") + ((F.col("size") > 0) & (F.col("left") >= F.col("size"))).cast("long")
    return r.select(
        "doc_id", "source", "key", "size", "source_size", "target", whole.alias("whole"),
        (F.col("epochs") * F.col("size") + part).alias("taken"),
        ((F.col("left") > 0) & (F.col("left") < F.col("size")) & (2 * F.col("left") >= F.col("size"))).alias("last"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: rows of ``docs``, repeated by epoch, whole.

    The document the cut goes through is taken once more if at least half of it lies before the cut, so a source misses
    its budget by half a document at most. Rows with the same id, source and size are counted together and share their
    copies, the first ones in text order taking one more where the number does not divide. Documents without words
    are in no budget: they stay once if their source takes any words.
    """
    plan = mix_plan(docs, **options)
    times = F.when(F.col("size") == 0, (F.col("target") > 0).cast("long")).otherwise(F.col("whole") + F.col("last").cast("long"))
    copies = plan.groupBy("doc_id", "source", "size").agg(F.sum(times).alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    copies = copies.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "__copies", "__rows").filter("__copies > 0")
    # Ids nearly always name one row: only those that do not need a place among their like.
    d = docs.withColumn("__n", n_words(F.col("text")))
    met = d.join(copies, d.doc_id.eqNullSafe(F.col("__id")) & d.source.eqNullSafe(F.col("__source")) & (F.col("__n") == F.col("__size")))
    single = met.filter("__rows = 1").withColumn("__times", F.col("__copies"))
    like = W.partitionBy("doc_id", "source", "__n").orderBy("text")
    several = met.filter("__rows > 1").withColumn("__at", F.row_number().over(like))
    several = several.withColumn("__times", F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__at") <= F.col("__copies") % F.col("__rows")).cast("long")).drop("__at")
    out = single.unionByName(several).filter("__times > 0")
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times").cast("long")))
    return out.select(*[d[c] for c in docs.columns], repeats.alias("__epoch")).drop("__epoch")
