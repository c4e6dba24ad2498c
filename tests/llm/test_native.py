"""Mixing, SimHash and URL lists: operators of DataFrame functions alone."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from chainspan.llm import mixing, ordering, simhash, urls
from pyspark.sql import functions as F

from tests.llm.conftest import MESSY, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted_targets(sizes):
    """By the rule itself: share by weight, stop at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        unit = left / sum(weight[s] for s in open_)
        for s in open_:
            out[s] += unit * weight[s]
        left = 0.0
        for s in list(open_):
            if out[s] >= 3 * sizes[s]:
                left += out[s] - 3 * sizes[s]
                out[s] = 3.0 * sizes[s]
                open_.discard(s)
    return out


@pytest.mark.parametrize("which", ["messy", "small", "skewed"])
def test_mix_plan_meets_targets(spark, messy, small, which):
    skewed = documents(spark, [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 11}") for i in range(900)])
    docs = {"messy": messy, "small": small, "skewed": skewed}[which]
    rows = mixing.mix_plan(docs, range_rows=40).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    wanted, taken = wanted_targets(sizes), Counter()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in sizes)
    again = mixing.mix_plan(docs.repartition(7), range_rows=40).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in rows) == Counter((r.doc_id, r.size, r.taken) for r in again)


def test_mixed_rows_are_whole_and_near_the_target(small, messy, empty):
    plan = {(r.source): (r.target, r.source_size) for r in mixing.mix_plan(small).collect()}
    texts = {r.text for r in small.collect()}
    got, most = Counter(), max(len(WORD.findall(t)) for t in texts)
    rows = mixing.mixed(small).collect()
    assert all(r.text in texts for r in rows) and max(Counter((r.doc_id, r.text) for r in rows).values()) <= 3
    for r in rows:
        got[r.source] += len(WORD.findall(r.text))
    assert all(abs(got[s] - t) <= most for s, (t, _) in plan.items())
    assert mixing.mixed(messy).columns == messy.columns and mixing.mixed(messy).count() > 0
    assert mixing.mixed(empty).count() == 0 and mixing.mix_plan(empty).count() == 0


def test_edited_texts_and_likeness(messy, small, empty):
    rows = sorted(((r.doc_id, r.text or "") for r in small.collect()))
    found = {r.doc_id: r for r in simhash.edited_fingerprints(small).collect()}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        r = found[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and len(r.fingerprint) == simhash.BITS // 4
    assert sum(r.near_edited > r.near_next for r in found.values()) > 0.9 * len(found)
    odd = simhash.edited_fingerprints(messy).collect()
    assert len(odd) == len(MESSY) and len({r.fingerprint for r in odd if r.n_chars == 0}) == 1
    assert len({r.fingerprint for r in odd if r.doc_id in (5, 6) and r.n_chars > 50}) == 1
    assert simhash.edited_fingerprints(empty).count() == 0


def test_next_rows_are_found_in_one_pass(spark):
    """Whatever the number of ranges, rows are read once, and ids at the bounds, without one and repeated keep their places."""
    rows = [(None, "x0"), (None, "x1"), *[(i * i - 50, f"t{i:03}") for i in range(200)], (39_551, "u0"), (39_551, "u1")]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    want = dict(zip(rows, [*rows[1:], rows[0]], strict=True))
    for n in (1, 7, 211):
        among = ordering.ranges(df, n=n)
        found = ordering.following(df, {"next": F.col("text")}, [F.col("doc_id").asc_nulls_first(), F.col("text")], among)
        got = {(r.doc_id, r.text): r.next for r in found.collect()}
        assert got == {k: v[1] for k, v in want.items()} and found.count() == len(rows)
    # The plan was ten times as long with so many ranges, which took the driver's memory.
    plan = simhash.edited_fingerprints(df.repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("RepartitionByExpression") + plan.count("Repartition ") == 1


def test_votes_are_those_of_weighted_terms(spark):
    text = "a bb ccc bb a"
    got = simhash.fingerprints(spark.createDataFrame([(1, text)], "k long, text string"), "k").first()
    w = [*text.split(), None, None]
    terms = [(w[i : i + 3], sum(len(x) for x in w[i : i + 3] if x)) for i in range(5)]
    df = spark.createDataFrame([(*t, n) for t, n in terms], "a string, b string, c string, n int").withColumn("h", F.xxhash64("a", "b", "c"))
    votes = [(r.h & (1 << 64) - 1, r.n) for r in df.collect()]
    low = sum(1 << k for k in range(64) if 2 * sum(n for h, n in votes if h >> k & 1) > sum(n for _, n in votes))
    assert got.low & (1 << 64) - 1 == low


def test_within_radius_finds_every_pair(spark, small):
    prints = simhash.fingerprints(small.withColumn("k", F.monotonically_increasing_id()), "k")
    base = prints.limit(20).collect()
    rows = [(r.low ^ m, r.high ^ (m << 5)) for r in base for m in (0, 1, 5)]
    df = spark.createDataFrame(rows, "low long, high long")
    bits = {f"{h & (1 << 64) - 1:016x}{l & (1 << 64) - 1:016x}" for l, h in rows}
    want = {(a, b) for a in bits for b in bits if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 4}
    got = [(min(r.a, r.b), max(r.a, r.b)) for r in simhash.within_radius(df, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_url_list(spark):
    d = lambda x: f"2024-01-{x:02d}"
    entries = [
        ("example.com", "add", d(3)), ("example.com", "add", d(4)), ("example.com", "remove", d(10)), ("example.com", "remove", d(11)), ("example.com", "add", d(20)),
        ("www.other.org/bad", "add", d(1)), ("www.other.org/bad/worse", "add", d(5)), ("x.net", "add", d(7)), ("x.net", "remove", d(7)), (None, "add", d(1)), ("y.net", "what", d(1)), ("z.net", "add", None),
    ]
    e = spark.createDataFrame(entries, "pattern string, action string, dated string").withColumn("dated", F.col("dated").cast("date"))
    spans = urls.intervals(e)
    assert {(r.pattern, str(r.valid_from), str(r.valid_to)) for r in spans.collect()} == {
        ("example.com", d(3), d(10)), ("example.com", d(20), "None"), ("www.other.org/bad", d(1), "None"), ("www.other.org/bad/worse", d(5), "None"),
    }
    asked = [
        (1, "http://u@A.Example.com:80/x?q", d(3), "example.com"), (2, "http://a.example.com", d(2), None), (3, "http://example.com/", d(10), None), (4, "http://example.com/", d(9), "example.com"),
        (5, "https://www.other.org/bad/worse/1", d(6), "www.other.org/bad/worse"), (6, "https://www.other.org/bad/worse/1", d(4), "www.other.org/bad"), (7, "https://www.other.org/badly", d(6), None),
        (8, None, d(5), None), (9, "not a url", d(5), None), (10, "http://example.com", None, None), (11, "http://x.net/", d(8), None), (12, "http://example.com", "2025-06-01", "example.com"),
    ]
    c = spark.createDataFrame([(i, u, t, "kept") for i, u, t, _ in asked + asked[:1]], "page_id int, url string, fetched_at string, month string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    rows = urls.judge(c, spans).collect()
    assert Counter((r.page_id, r.pattern, r.blocked) for r in rows) == Counter((i, p, p is not None) for i, _, _, p in asked + asked[:1])
    assert all(r.month == "kept" for r in rows)
    assert urls.judge(c, urls.intervals(e.limit(0))).filter("blocked").count() == 0 and urls.judge(c.limit(0), spans).count() == 0


def test_plans_do_not_grow_with_the_ranges(spark):
    """A range is a lookup in one array. Nested comparisons, one for each bound, took the driver's memory with 844 ranges."""
    df = spark.createDataFrame([(None,), *[(i * i - 50,) for i in range(200)]], "doc_id long")
    bounds = sorted({i * 45 - 100 for i in range(843)} | {-50, -49, 39_551})
    got = df.select("doc_id", ordering.range_of(F.col("doc_id"), bounds).alias("r"))
    assert dict(got.dtypes)["r"] == "int"
    assert {r.doc_id: r.r for r in got.collect()} == {i: ordering.place(i, bounds) for i in (None, *[k * k - 50 for k in range(200)])}
    assert {r.r for r in df.select(ordering.range_of(F.col("doc_id"), []).alias("r")).collect()} == {0}
    nodes = got.filter("doc_id > 0")._jdf.queryExecution().analyzed().toString()
    assert nodes.count("CASE WHEN") <= 1
