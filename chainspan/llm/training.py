"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspan.llm.common import held_out

#: Labelled rows of each class a classifier is fitted on. All other statistics and all scores cover every row.
ROWS_PER_CLASS = 2_000


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) outside the held-out fold: 1 if any label of the id is 1; rows without id or label say nothing."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max((F.col(label) >= 1).cast("int")).alias("y"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int = ROWS_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most ``per_class`` rows of each class, the ones first in hash order, and how many rows each class has.

    The sample's ids are few by construction, so they are sent to the documents, not the documents to them.
    """
    known = labelled(labels, label)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    return docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "text", "y"), counts
