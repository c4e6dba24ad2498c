
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from chainspan.catalog import frames
from chainspan.operators import components, identity, lineage, timeline
from chainspan.operators.query import EventFilter, count_events, filter_events, page_events
from chainspan.plans.build import build
from chainspan.plans.rules import Rule
from chainspan.session import checkpoint_root, local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "20"))

CODES = ("click", "error", "purchase", "signup", "view")


def mixed_rules(n: int) -> list[Rule]:
    """``n`` rules, a quarter of each kind."""
    out = []
    for i in range(n):
        a, b, c = CODES[i % 5], CODES[(i + 1 + i // 5) % 5], CODES[(i + 2 + i // 5) % 5]
        kind = i % 4
        if kind == 0:
            out.append(Rule(f"sequence {i}", (a, b, c)))
        elif kind == 1:
            out.append(Rule(f"field {i}", (a, b), "field", match_fields=("logon_id",)))
        elif kind == 2:
            out.append(Rule(f"temporal {i}", (a, a, b), "temporal", window_within="2h"))
        else:
            out.append(Rule(f"lineage {i}", (), "lineage", lineage_create_ids=(a,), lineage_exit_id=b))
    return out


def enlarged(events, copies: int):
    """``copies`` shifted copies: later by a month each, on other computers, under other ids."""
    shift = F.col("c")
    wide = events.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))))
    return wide.select(
        (F.col("id") + shift * 10_000_000).alias("id"),
        "event_code",
        (F.col("ts_ns") + shift * 2_678_400_000_000_000).alias("ts_ns"),
        F.concat("computer", F.lit("-"), (shift % 10).cast("string")).alias("computer"),
        *[c for c in events.columns if c not in ("id", "event_code", "ts_ns", "computer")],
    )


def main() -> None:
    spark = local_session(f"local[{CPUS}]", int(CPUS), **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, fn):
        start = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)

    folder = checkpoint_root(spark)

    def stored(df, name):
        """The event table a case would hold: parquet files, one per core."""
        df.repartition(int(CPUS)).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    ev = stored(frames.canon(spark, SF_DIR), "events")
    n = ev.count()
    warm = ev.limit(2000)
    out = build(warm, mixed_rules(5))  # starts the Python workers
    out.outcomes.collect()
    out.edges.count()

    run = lambda df: df.write.format("noop").mode("overwrite").save()

    def full(events, rules, **options):
        """A whole build: outcomes read and every edge produced."""
        out = build(events, rules, **options)
        out.outcomes.collect()
        run(out.edges)
        out.discard()

    timed("build_1_rule", lambda: full(ev, mixed_rules(1)))
    timed("build_5_rules", lambda: full(ev, mixed_rules(5)))
    timed("build_20_rules", lambda: full(ev, mixed_rules(20)))
    one_host = ev.withColumn("computer", F.lit("ONE"))
    timed("build_20_rules_one_host", lambda: full(one_host, mixed_rules(20)))
    timed("timeline_12_lanes", lambda: run(timeline.timeline(filter_events(ev, EventFilter(search="security")), 240, "user")))
    timed("first_page_512", lambda: page_events(ev, 0, 512).collect())
    timed("count_with_search", lambda: count_events(ev, EventFilter(search="u-12")).collect())
    narrow = EventFilter(time_from=1_704_844_800_000_000_000, time_to=1_704_848_400_000_000_000)
    wide = EventFilter(time_from=1_704_844_800_000_000_000, time_to=1_706_140_800_000_000_000)
    timed("narrow_time_range", lambda: page_events(filter_events(ev, narrow), 0, 512).collect())
    timed("wide_time_range", lambda: page_events(filter_events(ev, wide), 0, 512).collect())
    timed("dedup", lambda: run(identity.dedup(ev)))
    timed("process_lifetimes", lambda: run(lineage.process_lifetimes(ev, ("signup",), "error")))
    linked = frames.edges(spark, SF_DIR)
    timed("connected_components", lambda: run(components.connected_components(ev, linked)))

    if COPIES > 1:
        big = stored(enlarged(ev.select("id", "event_code", "ts_ns", "computer", "corr_version", *frames.model.SLOTS), COPIES), "large")
        timed("build_1_rule_large", lambda: full(big, mixed_rules(1)))
        timed("build_20_rules_large", lambda: full(big, mixed_rules(20)))
        one = big.withColumn("computer", F.lit("ONE"))
        timed("build_20_rules_large_one_host", lambda: full(one, mixed_rules(20)))
        times_per = round(n * COPIES / times["build_20_rules_large"])
    else:
        times_per = round(n / times["build_20_rules"])
    print(
        json.dumps(
            {
                "metric": "headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "events": n,
                "events_large": n * COPIES,
                "events_per_sec_20_rules": times_per,
            }
        )
    )


if __name__ == "__main__":
    main()
