import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import models
from chainspan.operators.automata import (
    AdvanceCounter, PairMatcher, Rows, SequenceMatcher, TemporalMatcher, TemporalPairMatcher,
)

stream = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.booleans()), max_size=60)
CODES = "ABCD"


def batches(rows, size):
    """(code, gap, new bucket) triples as batches; ids are positions."""
    ts, bucket, out = 0, 0, []
    times, buckets = [], []
    for _, gap, fresh in rows:
        ts += gap
        bucket += fresh
        times.append(ts)
        buckets.append(bucket)
    last = buckets[0] if buckets else 0
    for i in range(0, len(rows), size):
        part = range(i, min(i + size, len(rows)))
        b = np.array([buckets[p] for p in part])
        starts = np.diff(np.concatenate([[last], b])) != 0
        last = b[-1]
        out.append(Rows(np.array([rows[p][0] for p in part]), np.cumsum(starts), np.array(part), np.array([times[p] for p in part])))
    events = [(p, CODES[r[0]], times[p], buckets[p]) for p, r in enumerate(rows)]
    return out, models.ordered(events, lambda e: e[3])


def run(matcher, parts, n):
    found = []
    for rows in parts:
        f = matcher.feed(rows)
        assert not any(p.step0 for p in f.pieces)
        found += [tuple(p.ids) for p in f.pieces if len(p.ids) == n]
        found += [tuple(x) for x in f.ids.reshape(-1, n).tolist()]
    return sorted(found)


@settings(max_examples=200, deadline=None)
@given(stream, st.integers(1, 9), st.lists(st.integers(0, 2), min_size=2, max_size=4))
def test_sequence(rows, size, seq):
    parts, buckets = batches(rows, size)
    codes = [CODES[s] for s in seq]
    expected = sorted(m for b in buckets.values() for m in models.sequence(b, codes))
    assert run(SequenceMatcher(seq), parts, len(seq)) == expected
    if len(seq) == 2 and seq[0] != seq[1]:
        assert run(PairMatcher(seq), parts, 2) == expected


@settings(max_examples=200, deadline=None)
@given(stream, st.integers(1, 9), st.lists(st.integers(0, 2), min_size=2, max_size=4), st.integers(1, 12), st.integers(0, 20))
def test_temporal(rows, size, seq, within, total):
    parts, buckets = batches(rows, size)
    codes = [CODES[s] for s in seq]
    expected = sorted(m for b in buckets.values() for m in models.temporal(b, codes, within, total))
    assert run(TemporalMatcher(seq, within, total), parts, len(seq)) == expected
    if len(seq) == 2 and seq[0] != seq[1]:
        assert run(TemporalPairMatcher(seq, within, total), parts, 2) == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 2), min_size=2, max_size=4))
def test_advance_from_every_state(codes, seq):
    counter = AdvanceCounter(seq, len(seq))
    counter.feed(codes[: len(codes) // 2])
    counter.feed(codes[len(codes) // 2 :])
    for start, got in enumerate(counter.advances()):
        k = start
        for c in codes:
            k += c == seq[k % len(seq)]
        assert got == k - start


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.booleans().map(lambda x: False)), min_size=1, max_size=60),
    st.lists(st.integers(1, 6), min_size=1, max_size=20),
    st.lists(st.integers(0, 2), min_size=2, max_size=4),
    st.integers(1, 12),
    st.integers(0, 20),
)
def test_temporal_states_of_runs_are_settled_in_as_many_passes_as_steps(rows, sizes, seq, within, total):
    """Runs of one bucket, each worked on by itself; only summaries of whole runs go from one to the next."""
    parts, buckets = batches(rows, 1)
    flat = parts
    runs, at = [], 0
    for k in range(len(flat)):
        if at >= len(flat):
            break
        n = sizes[k % len(sizes)]
        runs.append(flat[at : at + n])
        at += n
    n = len(seq)
    begin = [None] * len(runs)
    for number in range(n):
        after, fresh = [None] * (n - 1), n - 1
        begun = []
        for run_rows, given_state in zip(runs, begin):
            begun.append([list(after), fresh] if any(after) else None)
            m = TemporalMatcher(seq, within, total, given_state)
            m.all_moves = number == n - 1
            for r in run_rows:
                m.feed(r)
            chains, moves = m.summary()
            fresh = moves[fresh if any(after) else -1]
            after = [c or h for c, h in zip(chains, after)]
        begin = begun
    found = []
    for run_rows, given_state in zip(runs, begin):
        m = TemporalMatcher(seq, within, total, given_state)
        for r in run_rows:
            found += [tuple(x) for x in m.feed(r).ids.reshape(-1, n).tolist()]
    codes = [CODES[s] for s in seq]
    assert sorted(found) == sorted(x for b in buckets.values() for x in models.temporal(b, codes, within, total))
