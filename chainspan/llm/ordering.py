"""Global order by an id without one task for all rows."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainspan.llm.common import parts


def id_bounds(ids: DataFrame, column: str, n: int) -> list[int]:
    """At most ``n - 1`` distinct upper bounds that cut the ids into nearly equal ranges."""
    if n < 2:
        return []
    found = ids.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [k / n for k in range(1, n)], 0.2 / n)
    return sorted({int(x) for x in found})


def range_of(column: Column, bounds: list[int]) -> Column:
    """The place of the range an id falls in: 0 for null ids and those up to the first bound.

    The place is found step by step in one array, so the plan does not grow with the bounds and a row costs log2(n) steps.
    """
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    all_bounds = _longs(bounds)
    return F.aggregate(F.expr(f"array({', '.join(map(str, steps))})"), F.lit(0), lambda p, k: F.when(F.get(all_bounds, p + k - 1) < column, p + k).otherwise(p))


def place(value: int | None, bounds: list[int]) -> int:
    return 0 if value is None else bisect_left(bounds, value)


def ranged(df: DataFrame, column: str = "doc_id", name: str = "__range", ranges: int | None = None) -> DataFrame:
    """``df`` with the range of its id, dealt out by it: rows of a range lie in one partition."""
    n = ranges or 4 * parts(df.sparkSession)
    bounds = id_bounds(df, column, n)
    return df.withColumn(name, range_of(F.col(column), bounds))


@dataclass(frozen=True)
class Ranges:
    """Ranges of an id: their upper bounds, and the first id of each range that has rows (None: a null id)."""

    bounds: list[int]
    firsts: dict[int, int | None]

    def of(self, column: Column) -> Column:
        return range_of(column, self.bounds)


def _longs(values: list[int | None]) -> Column:
    """An array of known values; ``values`` is not empty."""
    return F.expr(f"cast(array({', '.join('null' if v is None else repr(str(v)) for v in values)}) as array<bigint>)")


def ranges(df: DataFrame, column: str = "doc_id", n: int | None = None) -> Ranges:
    """Nearly equal ranges of the ids of ``df``. Only ids are read; one row per range comes to the driver."""
    found = Ranges(id_bounds(df, column, n or 4 * parts(df.sparkSession)), {})
    low = df.select(F.col(column).alias("v")).groupBy(found.of(F.col("v")).alias("r")).agg(F.min("v").alias("v"), F.count_if(F.col("v").isNull()).alias("nulls"))
    found.firsts.update((x.r, None if x.nulls else x.v) for x in low.collect())
    return found


def following(df: DataFrame, values: dict[str, Column], order: list[Column], among: Ranges, column: str = "doc_id") -> DataFrame:
    """``df`` with columns that hold, for each row, expressions of the next row in the order; the last row's next is the first.

    The order begins with ``column``, nulls first. Rows with the first id of a range stand at the end of the range before it
    once more, where they are seen but not returned. So a window within each range sees all it needs, and ``df`` is read once.
    """
    there = sorted(among.firsts)
    n = len(among.bounds) + 1
    before = dict(zip(there, [*there[-1:], *there[:-1]], strict=True))
    own = among.of(F.col(column))
    first = F.col(column).eqNullSafe(F.get(_longs([among.firsts.get(r) for r in range(n)]), F.col("__own")))
    place = lambda r, again: F.struct(r.cast("int").alias("at"), F.lit(again).alias("again"))
    here, there_too = place(F.col("__own"), False), place(F.get(_longs([before.get(r) for r in range(n)]), F.col("__own")), True)
    placed = df.withColumn("__own", own).withColumn("__place", F.explode(F.when(first, F.array(here, there_too)).otherwise(F.array(here))))
    w = W.partitionBy("__place.at").orderBy("__place.again", *order)
    seen = placed.withColumn("__next", F.lead(F.struct(*[c.alias(k) for k, c in values.items()])).over(w)).filter("not __place.again")
    return seen.select(*df.columns, *[F.col(f"__next.{k}").alias(k) for k in values])
