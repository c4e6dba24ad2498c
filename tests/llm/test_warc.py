"""Archives: exact round trips, pushed predicates, foreign files, lost tasks."""

import base64
import gzip
import hashlib

import pytest
from chainspan.llm import warc
from pyarrow import fs
from pyspark.sql import functions as F

LOCAL = fs.LocalFileSystem()
ROWS = [
    (1, "http://a.example/1", "<p>one</p>"), (2, "http://a.example/2", "<p>one</p>"), (3, None, ""), (4, "", None), (5, "http://b.example/ a\r\nX-Page-Id: 9", "<p>größe 漢字</p>"),
    (None, "http://c.example", "<p>one</p>"), (None, "http://c.example", "only without an id"), (None, "http://c.example", "only without an id"),
    (7, "http://d.example", "x" * 300_000 + "\r\n\r\nWARC/1.1\r\n"), (-3, "http://d.example", "x" * 300_000 + "\r\n\r\nWARC/1.1\r\n"), (8, "u", "same row"), (8, "u", "same row"), (8, "v", "same row"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, b"p", 5, "k") for r in rows], "page_id long, url string, html string, payload binary, kind int, digest string")


def expected(rows, least=0):
    last = lambda i: (i is None, i or 0)
    groups, out = {}, []
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    for body, ids in groups.items():
        ids.sort(key=last)
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        for k, i in enumerate(ids):
            first = k == 0 or len(body) < least
            out.append((i, len(body), sha, "response" if first else "revisit", None if first else ids[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 12])
def test_catalogue(spark, least):
    got = [tuple(r) for r in warc.catalogued(pages(spark, ROWS).repartition(3), least).collect()]
    assert sorted(got, key=str) == expected(ROWS, least)


def test_empty_table(spark):
    assert warc.catalogued(pages(spark, [])).collect() == []


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_payloads_come_back(spark, tmp_path, compression):
    folder = warc.archive(pages(spark, ROWS), str(tmp_path / "a"), compression=compression, file_bytes="2000")
    got = warc.read(spark, folder, "page_id long, target_uri string, record_type string, payload binary, refers_to long").filter("record_type <> 'warcinfo'").collect()
    bodies = {i: (h or "").encode() for i, _, h in ROWS if i is not None}
    assert len(got) == len(ROWS)
    for r in got:
        if r.record_type == "response" and r.page_id is not None:
            assert bytes(r.payload) == bodies[r.page_id]
        assert (r.payload is None) == (r.record_type == "revisit")
    assert {r.target_uri for r in got} >= {"http://a.example/1", "http://b.example/%20a%0D%0AX-Page-Id:%209", None}


def test_members_are_plain_gzip(spark, tmp_path):
    warc.archive(pages(spark, ROWS[:2]), str(tmp_path))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted(tmp_path.glob("*.warc.gz")))
    assert data.count(b"WARC/1.1\r\n") == data.count(b"WARC-Type: warcinfo") + 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_reach_the_reader(spark, tmp_path):
    folder = warc.archive(pages(spark, ROWS), str(tmp_path))
    all_rows = warc.read(spark, folder, "page_id long, record_type string, target_uri string, payload_bytes long")
    cases = ["record_type = 'revisit'", "record_type in ('response', 'revisit') and page_id >= 5", "target_uri like 'http://d%'", "payload_bytes < 11 and page_id is not null", "target_uri is null"]
    held = [r.asDict() for r in all_rows.collect()]
    checks = [
        lambda r: r["record_type"] == "revisit", lambda r: r["record_type"] in ("response", "revisit") and (r["page_id"] or 0) >= 5,
        lambda r: (r["target_uri"] or "").startswith("http://d"), lambda r: r["payload_bytes"] < 11 and r["page_id"] is not None, lambda r: r["target_uri"] is None,
    ]
    for text, check in zip(cases, checks, strict=True):
        df = all_rows.filter(text)
        assert " Filter " not in plan(df)
        assert sorted(map(str, (r.asDict() for r in df.collect()))) == sorted(str(r) for r in held if check(r))
    assert " Filter " in plan(all_rows.filter("page_id % 2 = 0"))
    assert all_rows.filter("page_id % 2 = 0").count() == sum(r["page_id"] is not None and r["page_id"] % 2 == 0 for r in held)


def test_unwanted_payloads_stay_packed(spark, tmp_path):
    warc.archive(pages(spark, ROWS).coalesce(1), str(tmp_path))
    for path in map(str, tmp_path.glob("*.warc.gz")):
        every, some, none = {}, {}, {}
        rows = list(warc.records_of(LOCAL, path, ["page_id", "payload"], [], False, every))
        list(warc.records_of(LOCAL, path, ["page_id", "payload"], [("page_id", "=", 1)], False, some))
        assert [r["page_id"] for r in rows] == [r["page_id"] for r in warc.records_of(LOCAL, path, ["page_id"], [], False, none)]
        assert some.get("payloads", 0) <= 1 and "payloads" not in none
        # The long payload is stepped over: only its first bytes were inflated.
        data = warc._Bytes(LOCAL, path)
        r = warc._Gzip(data, 0)
        assert r.find(b"\r\n\r\n", 0) > 0 and r.end() > 0


def foreign(payload, chunk=b"", headers=b""):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + headers + b"\r\n" + payload
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x\r\n y\r\nwarc-date: 2020-01-01T00:00:00Z\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [True, False])
def test_files_of_others(spark, tmp_path, packed):
    """Members without a stated length, headers in any case and on two lines, folders without a manifest."""
    records = [foreign(b"a" * n) for n in (0, 5, 200_000)]
    (tmp_path / "deep").mkdir()
    path = tmp_path / "deep" / ("x.warc.gz" if packed else "x.warc")
    path.write_bytes(b"".join(gzip.compress(r) if packed else r for r in records))
    df = warc.read(spark, str(tmp_path), "target_uri string, warc_date string, payload binary, payload_bytes long, position long")
    got = sorted(df.collect(), key=lambda r: r.position)
    assert [(r.target_uri, r.warc_date, len(r.payload), r.payload_bytes) for r in got] == [("http://x y", "2020-01-01T00:00:00Z", n, n) for n in (0, 5, 200_000)]
    assert df.select("position").count() == 3


def test_damage_is_told(spark, tmp_path):
    for name, data in [("cut", gzip.compress(foreign(b"abc"))[:-20]), ("short", foreign(b"a" * 900)[:-500]), ("none", b"not an archive, but long enough to be one\r\n\r\n")]:
        path = tmp_path / f"{name}.warc"
        path.write_bytes(data)
        with pytest.raises((ValueError, EOFError)):
            list(warc.records_of(LOCAL, str(path), ["payload"], [], False))
    wrong = foreign(b"abc").replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Payload-Digest: sha1:" + b"A" * 32)
    (tmp_path / "wrong.warc").write_bytes(wrong)
    with pytest.raises(ValueError, match="payload"):
        list(warc.records_of(LOCAL, str(tmp_path / "wrong.warc"), ["page_id"], [], True))


def test_records_of_lost_tasks_are_not_read(spark, tmp_path):
    folder = warc.archive(pages(spark, ROWS[:3]), str(tmp_path))
    (tmp_path / "part-lost-00000.warc").write_bytes(foreign(b"left behind"))
    assert warc.read(spark, folder, "record_type string").filter("record_type <> 'warcinfo'").count() == 3
    warc.archive(pages(spark, ROWS[3:5]), str(tmp_path))
    assert warc.read(spark, folder, "record_type string").filter(F.col("record_type") != "warcinfo").count() == 5


def test_files_are_packed_into_partitions(spark, tmp_path):
    folder = warc.archive(pages(spark, [(i, "u", f"page {i}") for i in range(60)]).repartition(6), str(tmp_path), file_bytes="3000")
    one = warc.read(spark, folder, "page_id long")
    many = spark.read.format(warc.FORMAT).schema("page_id long").option("split_bytes", "6000").load(folder)
    assert one.rdd.getNumPartitions() == 1 < many.rdd.getNumPartitions() < len(list(tmp_path.glob("*.warc.gz")))
    assert one.count() == many.count() == 60 + len(list(tmp_path.glob("*.warc.gz")))
