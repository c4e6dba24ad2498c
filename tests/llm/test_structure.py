"""Conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from chainspan.llm import structure

GRAMMAR = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(c, t, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def faults(turns):
    """(role, text, fault) in order."""
    seen, out = set(), []
    for t, role, text in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest())):
        rest = text.rstrip(WHITE)
        fault = "blank" if not rest else "duplicate" if (role, text) in seen else "" if rest[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((t, role, text, fault))
    return out


def edits(rows):
    """All (cost, letters, lines) by the rules, cheapest and ASCII-least first: forward over whole strings."""
    def given(made):
        return "assistant" if made[-1:] == "u" else "user"

    best = {"": (0, "", [])}  # initials so far, folded to what the grammar tells apart
    fold = lambda s: s if len(s) < 2 else s[-1]

    def relax(into, key, item):
        if key not in into or item[:2] < into[key][:2]:
            into[key] = item

    def inserted(at):
        out = dict(at)
        for _ in range(3):
            for k, (c, a, lines) in list(out.items()):
                r = given(k)
                relax(out, fold(k + r[0]), (c + 5, a + "I", lines + [r + ":"]))
        return out

    for _, role, text, fault in rows:
        new = {}
        for k, (c, a, lines) in inserted(best).items():
            relax(new, k, (c + 2, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            i = role[:1]
            if (i == "s" and k == "") or (i == "u" and k[-1:] != "u") or (i == "a" and k[-1:] == "u"):
                relax(new, fold(k + i), (c + extra, a + "K", lines + [f"{role}:{text}"]))
            r = given(k)
            relax(new, fold(k + r[0]), (c + 1 + extra, a + "R", lines + [f"{r}:{text}"]))
        best = new
    ends = [v for k, v in inserted(best).items() if k == "" or k[-1] == "a"]
    return min(ends, key=lambda v: v[:2])


def expected(rows):
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in damage(rows):
        out[c].append((t, role, text))
    got = set()
    for c, turns in out.items():
        flawed = faults(turns)
        n = [sum(f == k for *_, f in flawed) for k in ("blank", "duplicate", "truncated")]
        known = [t for t, *_ in flawed if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(flawed))
        cost, audit, lines = edits(flawed)
        got.add((c, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return got


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string")


def check(spark, rows):
    df = table(spark, rows)
    got = [tuple(r) for r in structure.repaired(structure.damaged(df), df).collect()]
    want = expected(rows)
    assert len(got) == len(want) and set(got) == want


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
TEXTS = ["Yes.", "No!", "cut off", "", " \t\n", None, "stop. ", "Why? ", "é漢."]


def test_random_conversations(spark):
    rnd, rows = random.Random(1), []
    for c in range(150):
        for t in range(rnd.randrange(1, 9)):
            turn = None if rnd.random() < 0.05 else t + (rnd.random() < 0.1) * 3
            role = rnd.choice(ROLES) if rnd.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rnd.choice(TEXTS) if rnd.random() < 0.5 else f"turn {t} of {c}."
            rows.append((c, turn, role, text))
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(6)]
    rnd.shuffle(rows)
    check(spark, rows)


def test_one_long_conversation_across_batches(spark):
    rnd = random.Random(2)
    rows = [(5, t, rnd.choice(ROLES), rnd.choice([f"text {t}.", f"text {t}", "again."])) for t in range(2_000)]
    check(spark, rows + [(6, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(300)])


def test_repeated_rows_and_ties(spark):
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 0, "assistant", "b."), (1, None, "system", "s."), (1, None, "system", "t."), (2, 7, None, None)]
    check(spark, rows * 2)


def test_empty_table(spark):
    assert structure.repaired(table(spark, [])).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_edits_against_all_strings(n):
    """Every string of edits is tried, with at most three insertions in one place."""
    for codes in itertools.product(range(12), repeat=n) if n < 3 else (tuple(random.Random(k).randrange(12) for _ in range(n)) for k in range(40)):
        found = []
        for letters in itertools.product("DKR", repeat=n):
            for inserts in itertools.product(range(3), repeat=n + 1):
                cost, out, audit, fine = 5 * sum(inserts), "", "", True
                for i in range(n + 1):
                    for _ in range(inserts[i]):
                        out += "a" if out[-1:] == "u" else "u"
                    audit += "I" * inserts[i]
                    if i == n:
                        break
                    initial, fault = divmod(codes[i], 3)
                    audit += letters[i]
                    if letters[i] == "D":
                        cost += 2
                        continue
                    fine &= fault != 2
                    cost += 5 * (fault == 1)
                    if letters[i] == "K":
                        out += "suat"[initial]
                    else:
                        cost += 1
                        out += "a" if out[-1:] == "u" else "u"
                if fine and GRAMMAR.fullmatch(out):
                    found.append((cost, audit))
        assert structure.cheapest(bytes(codes)) == min(found)


def test_checkpoints_give_the_same_edits_as_all_vectors():
    codes = bytes(random.Random(9).randrange(12) for _ in range(5_000))
    vectors = [(0, 10, 5, 0)]
    for c in reversed(codes):
        vectors.append(structure.before(c, vectors[-1])[0])
    vectors.reverse()
    state, letters = 0, ""
    for i, c in enumerate(codes):
        more, state = structure.step(c, vectors[i + 1], state)
        letters += more
    assert structure.cheapest(codes)[1].startswith(letters)
