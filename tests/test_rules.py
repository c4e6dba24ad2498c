import json

import pytest

from chainspan.plans.checks import advise_rules, validate_rules
from chainspan.plans.library import builtin_rules
from chainspan.plans.rules import Rule, duration_ns, duration_text

OK = {"name": "R", "description": "d", "channels": ["S"], "sequence": ["1", "2"]}
# document changes -> error codes, in order
CASES = [
    ({}, []),
    ({"format_version": 1, "labels": ["x"], "relation_type": "odd"}, []),
    ({"format_version": 2, "name": ""}, ["unsupported_format"]),
    ({"name": " \t"}, ["name_required"]),
    ({"sequence": ["1"]}, ["sequence_short"]),
    ({"sequence": None}, ["sequence_short"]),
    ({"sequence": ["1", " ", ""]}, ["sequence_empty_id", "sequence_empty_id"]),
    ({"sequence": ["1"] * 1001}, ["sequence_long"]),
    ({"labels": ["a", "b"]}, ["labels_too_many"]),
    ({"name": "", "sequence": [""]}, ["name_required", "sequence_short", "sequence_empty_id"]),
    ({"algorithm": "magic", "name": ""}, ["unknown_algorithm"]),
    ({"algorithm": " "}, []),
    ({"sequence": "1"}, ["syntax"]),
    ({"name": 5}, ["syntax"]),
    ({"match_scope": "planet"}, ["unknown_scope"]),
    ({"algorithm": "field"}, ["match_fields_required"]),
    ({"algorithm": "field", "match_fields": ["logon_id", "nope", "logon_id"]}, ["unknown_match_field", "duplicate_match_field"]),
    ({"match_fields": ["nope"]}, []),
    ({"algorithm": "temporal"}, ["window_required"]),
    ({"algorithm": "temporal", "window_within": "soon"}, ["bad_duration"]),
    ({"algorithm": "temporal", "window_within": "-5m"}, ["bad_duration"]),
    ({"algorithm": "temporal", "window_within": "721h"}, ["window_too_large"]),
    ({"algorithm": "temporal", "window_within": "10m", "window_total": "1m"}, ["window_total_too_small"]),
    ({"algorithm": "lineage", "sequence": None}, []),
    ({"algorithm": "lineage", "lineage_depth": -1, "lineage_create_ids": ["1", ""]}, ["lineage_ids_empty", "lineage_depth_range"]),
    ({"channels": ["S", " "]}, ["channel_empty"]),
]


def docs(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "rule_id string, doc string")


def codes(df):
    out = {}
    for r in df.orderBy("rule_id", "position").collect():
        out.setdefault(int(r.rule_id), []).append(r.code)
    return out


def test_validation(spark):
    texts = [json.dumps(OK | change) for change, _ in CASES]
    got = codes(validate_rules(docs(spark, texts + ["{", "[1]", '{"name": "' + "x" * (1 << 20) + '"}'])))
    assert [got.get(i, []) for i in range(len(CASES))] == [c for _, c in CASES]
    assert [got[len(CASES) + i] for i in range(3)] == [["syntax"], ["syntax"], ["file_too_large"]]


def test_advice(spark):
    texts = [
        json.dumps(OK),
        json.dumps({"name": "R", "sequence": ["1", "2"], "max_gap": 3}),
        json.dumps(OK | {"match_fields": ["logon_id"], "window_within": "5m", "lineage_depth": 1}),
        json.dumps(OK | {"algorithm": "lineage"}),
    ]
    got = codes(advise_rules(docs(spark, texts)))
    assert got == {
        1: ["no_description", "no_channels", "unknown_field"],
        2: ["field_not_for_algorithm"] * 3,
        3: ["sequence_ignored"],
    }


def test_builtin_rules_are_valid_and_distinct(spark):
    rules = builtin_rules()
    assert len(rules) == len({r.rule_id for r in rules}) == 34
    texts = docs(spark, [r.to_json() for r in rules])
    assert validate_rules(texts).isEmpty() and advise_rules(texts).isEmpty()
    assert [Rule.from_json(r.to_json()).step_codes for r in rules] == [r.step_codes for r in rules]


def test_durations():
    assert duration_ns("1h30m") == 5_400_000_000_000 and duration_ns("1.5s") == 1_500_000_000 and duration_ns("-2ms") == -2_000_000
    for text in ("5m0s", "1h0m0s", "1.5s", "250ms", "1h2m3.5s", "7ns", "0s"):
        assert duration_text(duration_ns(text)) == text
    for bad in ("5", "five", "5 m", "m"):
        with pytest.raises(ValueError):
            duration_ns(bad)
