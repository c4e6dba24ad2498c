import os
import random

import pytest
from chainspan.functions.times import filetime_problem, filetime_to_ns
from chainspan.session import discard_written, written
from chainspan.sources.payload import flatten_payload
from pyspark.sql import functions as F

from chainspan.operators import identity, snapshot
from chainspan.plans.build import build, select_rules, write_edges
from chainspan.plans.rules import Rule
from chainspan.sources.export import export_events
from chainspan.sources.tables import MissingColumns, quarantine, resolve_columns
from chainspan.streaming import capture as c

EVENT = "id long, event_code string, ts_ns long, provider string, channel string, computer string, user string, source_identifier string, hash_raw string, record_id long"


def rows(n, start=0):
    """Every fourth event repeats the one before it, under another id and sometimes from another file."""
    out = []
    for i in range(start, start + n):
        t = (i - (i % 4 == 3)) * 1000
        out.append((i, "C", t if i % 10 else None, "P", f"ch{i % 2}", "h", "u", "f1", f"r{i % 7}", i))
    return out


def events(spark, data):
    return identity.hash_normalized(spark.createDataFrame(data, EVENT))


def drain(spark, folder, stream_dir):
    schema = events(spark, rows(1)).schema
    stream = c.capture(spark, "parquet", schema, path=str(stream_dir), maxFilesPerTrigger=1)
    c.run_capture(stream, str(folder / "tables"), str(folder / "ck")).awaitTermination()


def test_capture_in_batches_equals_one_load(spark, tmp_path):
    inbox = tmp_path / "in"
    seen = []
    for part in range(3):
        data = rows(40, part * 30)  # overlapping: ten events come twice
        seen += data
        events(spark, data).coalesce(1).write.mode("append").parquet(str(inbox))
        if part != 1:
            drain(spark, tmp_path, inbox)  # resumes where it stopped
    tables = str(tmp_path / "tables")
    got = {r.hash_normalized: (r.dedup_count, r.source_counts) for r in c.captured_events(spark, tables).collect()}
    whole = identity.identity_counts(events(spark, seen)).collect()
    assert got == {r.hash_normalized: (r.dedup_count, r.source_counts) for r in whole}
    assert {r.channel: r.position for r in c.positions(spark, tables).collect()} == {"ch0": 98, "ch1": 99}
    p = c.progress(spark, tables).first()
    assert (p.read, p.persisted, p.read - p.persisted) == (120, len(got), p.duplicate)
    totals = c.progress(spark, tables).first()
    c.compact(spark, tables)
    assert c.progress(spark, tables).first() == totals
    again = {r.hash_normalized: (r.dedup_count, r.source_counts) for r in c.captured_events(spark, tables).collect()}
    assert again == got


def test_a_batch_run_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "observations")
    for _ in range(2):
        c._overwrite(c.observe_batch(events(spark, rows(20)), 0), path, 0)
    assert c.captured_events(spark, str(tmp_path)).agg(F.sum("dedup_count")).first()[0] == 20


def test_merging_batches_equals_dedup_of_all(spark):
    a, b = events(spark, rows(40)), events(spark, rows(40, 30))
    merged = identity.merge_batch(identity.dedup(a), b)
    whole = identity.identity_counts(a.unionByName(b))
    pick = lambda df: {r.hash_normalized: (r.dedup_count, r.source_counts) for r in df.collect()}
    assert pick(merged) == pick(whole)
    assert identity.append_batch(merged, b).count() == merged.count() + 40


CASE = "id long, event_code string, ts_ns long, computer string, logon_id string, corr_version int"


def test_a_rebuild_replaces_only_its_own_edges(spark, tmp_path):
    path = str(tmp_path / "edges")
    first, second = Rule("One", ("A", "B")), Rule("Two", ("B", "A"))
    data = [(i, "AB"[i % 2], i, "h", None, 2) for i in range(20)]
    df = spark.createDataFrame(data, CASE)
    out = build(df, [first, second])
    write_edges(out.edges, path)
    before = spark.read.parquet(path)
    assert {r.rule_id: r["count"] for r in before.groupBy("rule_id").count().collect()} == {"one": 10, "two": 9}
    kept = {r.edge_id for r in before.filter("rule_id = 'two'").collect()}
    redo = build(df.filter("id < 10"), [first], graphs=out.graphs, previous=before)
    o = redo.outcomes.first()
    assert (o.matches, o.relations, o.removed, o.graph_id) == (5, 5, 10, 1)
    write_edges(redo.edges, path)
    after = spark.read.parquet(path)
    assert {r.rule_id: r["count"] for r in after.groupBy("rule_id").count().collect()} == {"one": 5, "two": 9}
    assert {r.edge_id for r in after.filter("rule_id = 'two'").collect()} == kept


def test_a_rule_without_matches_loses_its_graph(spark):
    df = spark.createDataFrame([(1, "A", 1, "h", None, 2)], CASE)
    out = build(df, [Rule("None", ("A", "B"))])
    assert out.outcomes.first().graph_discarded and out.graphs.isEmpty() and out.edges.isEmpty()


def test_rule_selection():
    rules = [Rule("On", ("A", "B")), Rule("Off", ("A", "B"), enabled=False)]
    assert [r.name for r in select_rules(rules)] == ["On"]
    assert [r.name for r in select_rules(rules, ["off"])] == ["Off"]
    with pytest.raises(KeyError):
        select_rules(rules, ["what"])


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1, "x")], "EventID int, Host string")
    with pytest.raises(MissingColumns, match="channel, provider, timestamp"):
        resolve_columns(df)


def test_exports(spark, tmp_path):
    ev = events(spark, rows(5)).withColumn("provider", F.lit('a "b", c'))
    note = ev.limit(1).select(
        F.col("hash_normalized").alias("key"), F.lit(True).alias("flagged"), F.array(F.lit("x"), F.lit("y")).alias("tags"),
        F.lit("n").alias("note"), F.lit("d").alias("descriptor"),
    )
    export_events(ev, str(tmp_path / "csv"), note)
    got = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert got.filter("finding_flagged = 'true'").first().finding_tags == "x; y"
    assert got.first().provider == 'a "b", c'
    export_events(ev, str(tmp_path / "plain"), note.filter("false"))
    assert "finding_note" not in spark.read.option("header", True).csv(str(tmp_path / "plain")).columns
    export_events(ev, str(tmp_path / "json"), note, "json")
    j = spark.read.json(str(tmp_path / "json"))
    assert j.filter("finding is not null").count() == j.filter("finding.flagged").count() >= 1


def test_snapshots_are_many_and_can_be_deleted(spark, tmp_path):
    n = spark.range(60).select(F.lit(1).cast("bigint").alias("graph_id"), F.col("id").cast("string").alias("snapshot_id"))
    snapshot.write_snapshot(n, n, str(tmp_path))
    snapshot.write_snapshot(n.filter("snapshot_id = '7'"), n.filter("snapshot_id = '7'"), str(tmp_path))
    held = spark.read.parquet(str(tmp_path / "nodes"))
    assert held.count() == 60
    some, _ = snapshot.delete_snapshots(held, held, held.filter("snapshot_id < 10"))
    assert some.count() == 50
    assert snapshot.delete_snapshots(held, held, graph_id=1)[0].count() == 0
    with pytest.raises(ValueError):
        snapshot.delete_snapshots(held, held)


def test_written_tables_can_be_discarded(spark):
    discard_written(spark)
    df = written(spark.range(5))
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(folder)
    assert discard_written(spark) == 1 and not os.path.exists(folder) and discard_written(spark) == 0


def test_loads_survive_odd_times(spark):
    df = spark.sql(
        "select 'x' event_id, timestamp_ntz'1601-01-01 00:00:00' timestamp, 'p' provider, 'c' channel, 'h' computer, '' user, '' raw_xml "
        "union all select 'x', timestamp_ntz'9999-01-01 00:00:00', 'p', 'c', 'h', '', '' union all select 'x', timestamp_ntz'2024-01-01 00:00:00', 'p', 'c', 'h', '', ''"
    )
    good, rejected = quarantine(df)
    assert good.count() == 1 and {r.reason for r in rejected.collect()} == {"time out of range"}
    ticks = spark.createDataFrame([(0,), (1,), (9_000_000_000_000_000_000,), (133_000_000_000_000_000,), (None,)], "t long")
    got = ticks.select(filetime_to_ns(F.col("t")).isNull(), filetime_problem(F.col("t")).isNotNull()).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True), (True, True), (False, False), (True, False)]


def test_payloads_of_any_depth(spark):
    docs = [
        '{"a.b":1,"a":{"b":2}}', '{"a":{"b":{"c":{"d":{"e":{"f":1}}},"x":[1,{"y":2}]}}}', '{"a":{"b":{"c":{"d":{}}}}}', "not json", None, "[1]",
        '{"q":{"a":{"b":{"c":{"d":null,"e":"t","f":true}}}},"q.a.b.c.e":"later"}',
    ]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = {r.i: r.m for r in df.select("i", flatten_payload(F.col("d")).alias("m")).collect()}
    assert got[0] == {"a.b": "1"} and got[1] == {"a.b.c.d.e.f": "1", "a.b.x": '[1,{"y":2}]'} and got[2] == {}
    assert got[3] == got[4] == got[5] == {} and got[6] == {"q.a.b.c.d": "", "q.a.b.c.e": "later", "q.a.b.c.f": "true"}


def test_payloads_do_not_depend_on_depth(spark):
    leaves = [
        "1", "1.0", "1e5", "1E-7", "12345678901234567890", "0.1000", "-0", "true", "null", '"text \\" \\u00e9 \\n"', "[]", '[{"b":1,"a":[]}]', '[1.50,"x",null]', "{}",
        '{"b":1,"a":{}}', '[[{"z":{},"y":[{}]}]]', '"\ue000"', "123456789012345678901234567890.5",
    ]
    rows = []
    for i, leaf in enumerate(leaves):
        rows += [(i, "low", '{"k":%s}' % leaf), (i, "high", '{"p":{"q":{"r":{"s":{"t":{"k":%s}}}}}}' % leaf)]
    df = spark.createDataFrame(rows, "i int, at string, d string")
    got = {(r.i, r["at"]): r.m for r in df.select("i", "at", flatten_payload(F.col("d")).alias("m")).collect()}
    for i, leaf in enumerate(leaves):
        assert {f"p.q.r.s.t.{k}": v for k, v in got[(i, "low")].items()} == got[(i, "high")], leaf
    assert got[(13, "low")] == {} and got[(11, "low")] == {"k": '[{"a":[],"b":1}]'}


def test_a_build_removes_its_tables(spark):
    from chainspan.plans.build import build
    from chainspan.plans.rules import Rule

    rows = [(i, "AB"[i % 2], 10 * i, "h", 2) for i in range(20)]
    events = spark.createDataFrame(rows, "id long, event_code string, ts_ns long, computer string, corr_version int")
    before = discard_written(spark)
    out = build(events, [Rule("pair", ("A", "B"))])
    assert out.edges.count() == 10 and out.folders and before >= 0
    assert all(os.path.isdir(f.removeprefix("file:")) for f in out.folders)
    out.discard()
    assert not any(os.path.exists(f.removeprefix("file:")) for f in out.folders) and discard_written(spark) == 0


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("stretches", [7, 256])
def test_deep_pages_sort_the_stretch_that_holds_them(spark, monkeypatch, tmp_path, descending, stretches):
    from chainspan.operators import query

    monkeypatch.setattr(query, "STRETCHES", stretches)
    monkeypatch.setattr(query, "TOP_K_ROWS", 0)
    rnd = random.Random(stretches)
    rows = [(i, None if rnd.random() < 0.1 else rnd.choice([5, 5, rnd.randrange(400)])) for i in range(300)]
    spark.createDataFrame(rows, "id long, ts_ns long").write.parquet(f"{tmp_path}/e")
    df = spark.read.parquet(f"{tmp_path}/e")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0) if descending else r[1] or 0, r[0]))
    for offset, limit in ((120, 30), (0, 3), (285, 40), (300, 5), (250, 0)):
        got = [tuple(r) for r in query.page_events(df, offset, limit, descending).collect()]
        assert got == (order[offset : offset + limit] if limit else order[offset:])
    if stretches == 7:
        part, before = query._stretch(df, 120, 10, descending)
        assert part.count() < 200 and before <= 120  # two in three share one time
        assert "PushedFilters: [IsNotNull(ts_ns)" in part._jdf.queryExecution().executedPlan().toString()


def test_flattening_parses_a_payload_once(spark):
    df = spark.createDataFrame([("{}",)], "d string").select(flatten_payload(F.col("d")).alias("m"))
    # Once more for those that go to Python, before they go.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json(") + plan.count("ParseJson(") + plan.count("parseJson(") in (1, 2)


def test_a_stored_plan_is_read_by_recreated_edges(spark):
    """The plan of a snapshot's edges is computed once, although it is chosen from itself."""
    from chainspan.catalog.audits import recreated

    got = recreated(spark, "/root/testdata/sf0.001")
    assert "sha2(" not in got._jdf.queryExecution().optimizedPlan().toString() and got.columns[0] == "edge_id"


def test_events_without_a_hash_restore_nothing(spark):
    events = spark.createDataFrame([(1, ""), (2, None), (3, "a"), (4, "a")], "id long, hash_normalized string")
    nodes = spark.createDataFrame([(1, ""), (2, None), (4, "a")], "id long, hash string")
    links = spark.createDataFrame([("e", "a", "")], "edge_id string, from_hash string, to_hash string")
    now = spark.createDataFrame([], "edge_id string, src long, dst long")
    plan = snapshot.restore_plan(nodes, links, events, now)
    assert {(r.id, r.live_id, r.outcome) for r in plan[0].collect()} == {(1, None, "unresolved"), (2, None, "unresolved"), (4, 3, "moved")}
    assert plan[1].first().reason == "target missing"
