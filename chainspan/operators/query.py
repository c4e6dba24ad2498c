"""Filtered, ordered and paged event queries. Pages, counts and histograms all start from ``filter_events``."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspan.operators.layout import ordered_layout, running_position
from chainspan.functions.text import trimmed

# Up to this depth a page is a bounded top-k; deeper pages are cut out of a range-partitioned order.
TOP_K_ROWS = 100_000


@dataclass(frozen=True)
class EventFilter:
    """Blank text and None mean "no condition"; the conditions are ANDed. Times are inclusive nanoseconds."""

    code: str = ""
    provider: str = ""
    channel: str = ""
    user: str = ""
    search: str = ""
    time_from: int | None = None
    time_to: int | None = None
    source_type: str = ""
    source_identifier: str = ""
    min_count: int = 0
    relation_state: str = ""  # any | system | user
    undated: str = "exclude"  # exclude | include | only
    finding_state: str = ""  # flagged | annotated | noted | none
    tag: str = ""
    offset: int = 0
    limit: int = 0
    descending: bool = False

    def without_paging(self, **changes) -> "EventFilter":
        return replace(self, offset=0, limit=0, **changes)


def search_text() -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("event_code", "provider", "channel", "user", "computer")]
    return F.lower(F.concat_ws(" ", *parts))


def edge_endpoints(edges: DataFrame) -> DataFrame:
    """Distinct event ids that are an end of some edge. Repeats collapse before the shuffle."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def finding_keys(findings: DataFrame, state: str) -> DataFrame:
    """Keys of findings that are flagged, noted, or (any other state) present at all."""
    if state == "flagged":
        findings = findings.filter("flagged")
    elif state == "noted":
        findings = findings.filter(F.coalesce(F.col("note"), F.lit("")) != "")
    return findings.select("key")


def keys_with_tag(findings: DataFrame, tag: str) -> DataFrame:
    wanted = F.lower(trimmed(F.lit(tag)))
    return findings.filter((wanted != "") & F.array_contains("tags", wanted)).select("key")


def filter_events(
    df: DataFrame, flt: EventFilter, edges: DataFrame | None = None, findings: DataFrame | None = None
) -> DataFrame:
    """Events that meet ``flt``. ``edges`` and ``findings`` are needed by the relation and finding conditions."""
    for column, value in (
        ("event_code", flt.code),
        ("provider", flt.provider),
        ("channel", flt.channel),
        ("user", flt.user),
        ("source_type", flt.source_type),
        ("source_identifier", flt.source_identifier),
    ):
        if value:
            df = df.filter(F.col(column) == value)
    if flt.search:
        df = df.filter(F.contains(search_text(), F.lower(F.lit(flt.search))))
    ns = F.col("ts_ns")
    if flt.time_from is not None:
        df = df.filter(ns >= flt.time_from)
        if flt.time_to is not None:
            df = df.filter(ns <= flt.time_to)
    elif flt.time_to is not None:
        # An event without a time sorts before every bound, so an upper bound alone lets it pass.
        df = df.filter(ns.isNull() | (ns <= flt.time_to))
    if flt.undated == "only":
        df = df.filter(ns.isNull())
    elif flt.undated != "include":
        df = df.filter(ns.isNotNull())
    if flt.min_count > 0:
        df = df.filter(F.greatest(F.coalesce(F.col("dedup_count"), F.lit(1)), F.lit(1)) >= flt.min_count)
    if flt.relation_state in ("any", "system", "user"):
        chosen = _need(edges, "edges")
        if flt.relation_state == "system":
            chosen = chosen.filter(F.col("created_by") == "system")
        elif flt.relation_state == "user":
            chosen = chosen.filter(F.col("created_by") != "system")
        df = df.join(edge_endpoints(chosen), "id", "left_semi")
    if flt.finding_state:
        keys = finding_keys(_need(findings, "findings"), flt.finding_state).withColumnRenamed("key", "hash_normalized")
        df = df.join(keys, "hash_normalized", "left_anti" if flt.finding_state == "none" else "left_semi")
    if flt.tag:
        keys = keys_with_tag(_need(findings, "findings"), flt.tag).withColumnRenamed("key", "hash_normalized")
        df = df.join(keys, "hash_normalized", "left_semi")
    return df


def _need(df: DataFrame | None, name: str) -> DataFrame:
    if df is None:
        raise ValueError(f"this filter needs the {name} table")
    return df


def filter_hashes(df: DataFrame, hashes: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Keep / drop events by content hash. An empty set is a real set: nothing is in it."""
    if hashes is not None:
        df = df.join(hashes.select(F.col("key").alias("hash_normalized")).distinct(), "hash_normalized", "left_semi")
    if exclude is not None:
        df = df.join(exclude.select(F.col("key").alias("hash_normalized")).distinct(), "hash_normalized", "left_anti")
    return df


def _order(descending: bool) -> list[Column]:
    ts = F.col("ts_ns")
    return [ts.desc_nulls_last() if descending else ts.asc_nulls_last(), F.col("id").asc()]


def order_events(df: DataFrame, descending: bool = False) -> DataFrame:
    """By time, undated last in both directions, id ascending on ties in both directions."""
    return df.orderBy(*_order(descending))


def page_events(df: DataFrame, offset: int = 0, limit: int = 0, descending: bool = False) -> DataFrame:
    """A page of the ordered events; ``limit`` 0 or less means all that follow the offset."""
    offset = max(offset, 0)
    if limit > 0 and offset + limit <= TOP_K_ROWS:
        return order_events(df, descending).offset(offset).limit(limit)
    if offset == 0 and limit <= 0:
        return order_events(df, descending)
    # Deep page: only the stretch of times that holds it is sorted.
    part, before = _stretch(df, offset, limit, descending)
    at = place_events(part, descending, "_place").filter(F.col("_place") >= offset - before)
    if limit > 0:
        at = at.filter(F.col("_place") < offset - before + limit)
    return order_events(at.select(*df.columns), descending)


#: Stretches of about equally many events that the times are cut into to find a deep page.
STRETCHES = 256


def _place_among(value: Column, cuts: list[int]) -> Column:
    """How many of the (ascending) cuts are below a value, by halving."""

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= cuts[mid], half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(cuts))


def _stretch(df: DataFrame, offset: int, limit: int, descending: bool) -> tuple[DataFrame, int]:
    """The events of the few stretches of time that hold a page, and how many events come before them.

    Cuts come from a mergeable quantile sketch of the times, made beside the data; how good they are only decides how
    much is sorted. The events between them are then counted exactly, from the times alone, and at most ``STRETCHES``
    numbers come back. The stretch is a range of times, so files outside it are skipped by their statistics.
    """
    cuts = df.agg(F.percentile_approx("ts_ns", F.array(*[F.lit(k / STRETCHES) for k in range(1, STRETCHES)]), 10 * STRETCHES)).first()[0]
    cuts = sorted(set(cuts or []))
    # Stretch k holds the times above cut k - 1 and up to cut k; undated events come last in both directions.
    k = F.when(F.col("ts_ns").isNull(), F.lit(len(cuts) + 1)).otherwise(_place_among(F.col("ts_ns"), cuts))
    counted = {r.k: r.n for r in df.select(k.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [*range(len(cuts), -1, -1), len(cuts) + 1] if descending else list(range(len(cuts) + 2))
    before, seen, held = 0, 0, []
    for at in order:
        n = counted.get(at, 0)
        if seen + n <= offset:
            before += n
        elif limit <= 0 or seen < offset + limit:
            held.append(at)
        seen += n
    undated = len(cuts) + 1 in held
    dated = [at for at in held if at <= len(cuts)]
    keep = F.col("ts_ns").isNull() if undated else F.lit(False)
    if dated:
        lo, hi = min(dated), max(dated)
        within = F.col("ts_ns").isNotNull()
        if lo > 0:
            within &= F.col("ts_ns") > cuts[lo - 1]
        if hi < len(cuts):
            within &= F.col("ts_ns") <= cuts[hi]
        keep = keep | within if undated else within
    return df.filter(keep), before


def place_events(df: DataFrame, descending: bool = False, name: str = "place") -> DataFrame:
    """``df`` with the place of each event in the order of ``order_events``, from 0; in no order itself."""
    sign = F.lit(-1 if descending else 1)
    keyed = df.withColumn("_undated", F.col("ts_ns").isNull()).withColumn("_at", F.coalesce(F.col("ts_ns") * sign, F.lit(0)))
    rest = [c for c in keyed.columns if c not in ("_undated", "_at", "id")]
    layout = ordered_layout(keyed, [], ["_undated", "_at", "id"], rest)
    return running_position(layout).select(*df.columns, F.col("position").alias(name))


def count_events(df: DataFrame, flt: EventFilter, edges: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    return filter_events(df, flt.without_paging(), edges, findings).agg(F.count(F.lit(1)).alias("n"))


def find_by_hash(df: DataFrame, content_hash: str) -> DataFrame:
    """Lowest id with this hash; no row when there is none."""
    hit = df.filter(F.col("hash_normalized") == content_hash).agg(F.min("id").alias("id"))
    return hit.filter(F.col("id").isNotNull())


def totals(df: DataFrame, edges: DataFrame) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("events"))
    return n.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("relations"))), how="left")


def event_detail(df: DataFrame, payload: DataFrame, ids: list[int]) -> DataFrame:
    """Chosen events with their raw record and fields, in the order asked for; unknown ids give no row."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id bigint")
    if len(ids) <= TOP_K_ROWS:
        wanted = F.broadcast(wanted)
    few = df.join(wanted, "id")
    # Narrow the payload by the same ids first: its wide text is read, never shuffled.
    text = payload.join(wanted.select("id").distinct(), "id", "left_semi")
    return few.join(text, "id", "left").orderBy("pos")
