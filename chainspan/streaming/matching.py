"""Rules with bounded gaps over a stream of events.

A stream brings events late and out of order, a rule needs them in order. So each scope (and, where the rule has match
fields, each of their values) holds its events back until the watermark has passed them, and then gives them in order
of time and id to the same matcher that batches use. What is kept for a scope is the events not yet in order and the
matcher's few open chains, in the state store; an event-time timer wakes a scope when its earliest event is due.

Rows later than ``delay`` behind the latest event of the rule seen are dropped, as with any watermark. All other rows give the
occurrences that a batch over the whole table gives, whatever the order of arrival and the cuts between micro-batches.
Events of the last ``delay`` stay held until the watermark moves on; ``closing`` is a row that moves it past everything.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chainspan.operators.automata import Rows, TemporalMatcher
from chainspan.operators.matching import scope_column
from chainspan.plans.rules import Rule
from chainspan.session import ship_package

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The scope of the row that closes a stream.
CLOSING = "\x00closing"
#: Held events go to the state many to a row: id, code and time of each, as bytes.
_HELD, _HELD_ROWS = "events binary", 65_536


def _packed(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[k : k + _HELD_ROWS].tobytes(),) for k in range(0, len(rows), _HELD_ROWS)]


class _Held(StatefulProcessor):
    """One scope: events behind the watermark go to the matcher in order, the others wait."""

    def __init__(self, codes: tuple[str, ...], seq: tuple[int, ...], within: int, total: int, keys: tuple[str, ...]):
        self.codes, self.seq, self.within, self.total, self.keys = codes, list(seq), within, total, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)
        self.open = handle.getValueState("open", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for some in rows:
            some = some[some["event_code"].isin(self.codes)]
            if some.empty:
                continue
            code = some["event_code"].map({c: i for i, c in enumerate(self.codes)})
            self.held.appendList(_packed(np.stack([some["id"].to_numpy(np.int64), code.to_numpy(np.int64), some["ts_ns"].to_numpy(np.int64)], axis=1)))
            least = int(some["ts_ns"].min())
            earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            self._wake(earliest)
        return iter(())

    def _wake(self, ts_ns: int) -> None:
        self.handle.registerTimer(ts_ns // 1_000_000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due_before = timerValues.getCurrentWatermarkInMs() * 1_000_000
        rows = np.frombuffer(b"".join(bytes(r[0]) for r in self.held.get()), np.int64).reshape(-1, 3)
        late = rows[:, 2] < due_before
        due, wait = rows[late], rows[~late]
        if len(wait):
            self._wake(int(wait[:, 2].min()))
        if not len(due):
            return
        if len(wait):
            self.held.put(_packed(wait))
        else:
            self.held.clear()
        ids, codes, ts = due[np.lexsort((due[:, 1], due[:, 0], due[:, 2]))].T.copy()
        begin = json.loads(self.open.get()[0]) if self.open.exists() else None
        matcher = TemporalMatcher(self.seq, self.within, self.total, begin)
        found = matcher.feed(Rows(codes, np.zeros(len(codes), dtype=np.int64), ids, ts))
        self.open.update((json.dumps([matcher.chains, matcher.fresh]),))
        if len(found.rows):
            n = len(self.seq)
            out = {k: [v] * len(found.rows) for k, v in zip(self.keys, key, strict=True)}
            out["ids"] = found.ids.reshape(-1, n).tolist()
            out["gap_ns"] = np.diff(found.ts.reshape(-1, n), axis=1).max(axis=1)
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Pattern:
    """A rule with bounded gaps, as a stream is matched against it."""

    rule: Rule
    delay: str = "1 hour"

    @property
    def keys(self) -> tuple[str, ...]:
        return ("scope", *sorted(set(self.rule.bucket_slots)))


def match_stream(events: DataFrame, pattern: Pattern) -> DataFrame:
    """Occurrences of a rule in a stream of (id, event_code, ts_ns, computer, match fields): (scope, match fields, ids, gap_ns).

    Undated events and those without a match field take no part.
    """
    spark, r = events.sparkSession, pattern.rule
    if r.algorithm != "temporal":
        raise ValueError("only rules with bounded gaps can be matched in a stream")
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    codes = tuple(sorted(set(r.sequence)))
    # Events of other codes are not shuffled; they move no watermark either, so it may stay behind for longer.
    kept = events.filter(F.col("ts_ns").isNotNull() & F.col("event_code").isin(*codes, CLOSING))
    for s in pattern.keys[1:]:
        kept = kept.filter(F.col(s).isNotNull() | (F.col("event_code") == CLOSING))
    kept = kept.withColumn("scope", scope_column(r.match_scope)).withColumn("event_time", F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000))))
    kept = kept.withWatermark("event_time", pattern.delay).select(*pattern.keys, "id", "event_code", "ts_ns", "event_time")
    processor = _Held(codes, tuple(codes.index(c) for c in r.sequence), r.within_ns, r.total_ns, pattern.keys)
    schema = ", ".join(f"{k} string" for k in pattern.keys) + ", ids array<bigint>, gap_ns bigint"
    return kept.groupBy(*pattern.keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="eventTime"
    )


def run_matching(events: DataFrame, pattern: Pattern, table: str, checkpoint: str, mode: str = "available_now", interval: str = "10 seconds") -> StreamingQuery:
    """Match a stream into the table of occurrences at ``table``: once over what is there, or for as long as it goes on."""
    writer = match_stream(events, pattern).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if mode == "available_now" else writer.trigger(processingTime=interval)
    return writer.start(table)


def closing(spark: SparkSession, events: DataFrame, ts_ns: int = 9_000_000_000_000_000_000) -> DataFrame:
    """A row in the columns of ``events`` that moves the watermark past all times before ``ts_ns``, and matches nothing."""
    known = {"id": F.lit(0).cast("bigint"), "event_code": F.lit(CLOSING), "ts_ns": F.lit(ts_ns), "computer": F.lit(CLOSING)}
    return spark.range(1).select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])
