from pyspark.sql import functions as F

from chainspan.functions import duration_text, normalize_tags, parse_duration, slot_value, truncate_bytes
from chainspan.operators.slots import extract_slots
from chainspan.plans import rules


def values(spark, items, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_truncate_never_splits_a_character(spark):
    texts = ["abc", "aé" * 9, "日本語" * 4, "😀😀😀", "a😀bb", ""]
    for n in (1, 4, 5, 7, 12):
        expected = [t.encode()[:n].decode(errors="ignore") for t in texts]
        assert values(spark, texts, lambda c, n=n: truncate_bytes(c, n)) == expected


def test_slot_values(spark):
    ident = lambda c: slot_value(c, "identifier")
    assert values(spark, [" 0X00FF ", "255", "0", "0x0", "-", "S-1-0-0", "(null)", "18446744073709551615", "18446744073709551616", "abc"], ident) == [
        "0xff", "0xff", None, None, None, None, None, "0xffffffffffffffff", "18446744073709551616", "abc",
    ]
    image = lambda c: slot_value(c, "image")
    assert values(spark, ["C:\\A\\B.EXE", "/usr/bin/x", "y", "dir\\", "n/a"], image) == ["b.exe", "x", "y", None, None]


def test_first_useful_source_wins(spark):
    fields = [(1, {"TARGETLOGONID": "-", "subjectlogonid": "0x3e7", " Image ": "c:\\x.exe"}), (2, {"logonid": "1", "LogonId": "2"}), (3, None)]
    got = {r.id: r for r in extract_slots(spark.createDataFrame(fields, "id int, fields map<string,string>")).collect()}
    assert (got[1].logon_id, got[1].subject_logon_id, got[1].process_name) == ("0x3e7", "0x3e7", "x.exe")
    assert got[2].logon_id == "0x2" and got[3].logon_id is None  # of names differing in case, the smallest


def test_durations_agree_with_the_rule_parser(spark):
    texts = ["1h30m", "90s", "1.5h", "-5m", "250ms", "7ns", "3.25µs", "0", "", "720h0m1s"]
    assert values(spark, texts, parse_duration) == [rules.duration_ns(t) for t in texts]
    assert values(spark, texts, lambda c: duration_text(parse_duration(c))) == [rules.duration_text(rules.duration_ns(t)) for t in texts]


def test_tags(spark):
    long = "x" * 70
    row = [" B", "a", "b ", "", long, long + "y"] + [f"t{i:02}" for i in range(40)]
    got = spark.createDataFrame([(row,)], "t array<string>").select(normalize_tags(F.col("t"))).first()[0]
    assert got == sorted(["b", "a", long, long + "y"] + [f"t{i:02}" for i in range(40)])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_slots_read_the_fields_once(spark):
    df = spark.createDataFrame([(1, {"ProcessId": "7"})], "id int, fields map<string,string>")
    assert _plan(extract_slots(df)).count("map_entries(") == 1


def test_quarantine_reads_each_time_once(spark):
    from chainspan.sources.tables import quarantine

    raw = spark.createDataFrame([("4624", "soon", "p", "c", "h", "u", "")], "event_id string, timestamp string, provider string, channel string, computer string, user string, raw_xml string")
    for part in quarantine(raw):
        assert _plan(part).count("unix_seconds(") == 1
