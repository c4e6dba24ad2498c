"""The prefix trie against brute force."""

import hashlib
import random
import zlib

import pytest
from chainspan.llm import trie
from pyspark.sql import functions as F


def rebuild(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, hash_of(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(head, [])[:h] + own[c][h:]
    return out


def hash_of(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def expected(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own + sum(saved[k] for k in kids.get(p, []))
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed, n, words, longest):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rnd.randrange(0, longest)):
            rows.append((c * rnd.choice([1, 1, 1, 7]), t if rnd.random() < 0.97 else None, rnd.choice(["user", "assistant", None]), rnd.choice([*words, None])))
    return rows


@pytest.mark.parametrize(("block", "seed"), [((1, 1), 1), ((3, 1_000), 2), ((7, 20), 1), ((200_000, 1_000_000), 2)])
def test_rebuilt_conversations(spark, monkeypatch, block, seed):
    monkeypatch.setattr(trie, "BLOCK_ROWS", block[0])
    monkeypatch.setattr(trie, "BLOCK_TURNS", block[1])
    rows = random_rows(seed, 120, ["a", "ß", "", "b " * 5], 14) + [(None, 1, "user", "nobody's")]
    assert found(trie.trie(trie.rebuilt(table(spark, rows)))) == expected(rebuild(rows))


def as_paths(spark, convs):
    rows = [(c, bytearray(b"".join(hashlib.md5(t.encode()).digest() for t in turns)), [len(t) for t in turns]) for c, turns in convs.items()]
    return spark.createDataFrame(rows, "conv_id long, path binary, sizes array<long>")


@pytest.mark.parametrize("rows", [2, 1_000])
@pytest.mark.parametrize("kind", ["copies", "ladder", "bush", "prefixes", "one", "none"])
def test_shapes(spark, monkeypatch, rows, kind):
    """Copies that fill many blocks, each conversation a prefix of the next, many children, nothing but a root."""
    monkeypatch.setattr(trie, "BLOCK_ROWS", rows)
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    rnd = random.Random(rows)
    convs = {
        "copies": {c: ["x", "y", "z"][: 3 if c % 4 else 2] for c in range(60)},
        "ladder": {c: [str(k) for k in range(c % 25)] for c in range(40)},
        "bush": {c: ["x", str(c % 30), *["y"] * (c % 3)] for c in range(60)},
        "prefixes": {c: [rnd.choice("ab") for _ in range(rnd.randrange(0, 7))] for c in range(-30, 60)},
        "one": {5: ["x"]},
        "none": {1: [], 2: [], 0: []},
    }[kind]
    want = [(*r[:6], r[6], r[7]) for r in expected({c: [("", t) for t in v] for c, v in convs.items()})]
    assert found(trie.trie(as_paths(spark, convs))) == want


def test_empty(spark):
    assert trie.trie(trie.rebuilt(table(spark, []))).collect() == []


def test_range_minima():
    import numpy as np

    rnd = np.random.default_rng(1)
    v = rnd.integers(0, 5, 50)
    m = trie.Minima(v)
    for i in range(50):
        for d in range(6):
            lo, hi = i, i
            while lo > 0 and v[lo] >= d:
                lo -= 1
            while hi < 49 and v[hi + 1] >= d:
                hi += 1
            assert m.left(np.array([i]), np.array([d]))[0] == lo and m.right(np.array([i]), np.array([d]))[0] == hi
        for j in range(i, 50):
            assert m.least(np.array([i]), np.array([j]))[0] == v[i : j + 1].min()


def test_a_node_counts_once(spark):
    df = trie.trie(trie.rebuilt(table(spark, random_rows(5, 80, ["a", "b"], 9))))
    assert df.groupBy("conv_id", "depth").agg(F.count("*").alias("n")).filter("n > 1").count() == 0
