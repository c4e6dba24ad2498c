"""Classifiers: held-out accuracy, and the chain recursions against plain enumeration."""

import itertools
import tracemalloc

import numpy as np
from chainspan.llm import quality, toxicity

from tests.llm.conftest import MESSY


def accuracy(rows, labels, column, least):
    y = {r.doc_id: r[column] for r in labels.collect()}
    held = [(r.score, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(held) > 40 and auc > least, auc


def test_quality(larger, labels, messy, empty):
    model = quality.train(larger, labels)
    accuracy(quality.score(larger, model).collect(), labels, "quality", 0.97)
    rows = quality.score(messy, model).collect()
    assert len(rows) == len(MESSY) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert quality.score(empty, model).count() == 0
    assert quality.score(messy, quality.train(empty, labels)).count() == len(MESSY)
    one = quality.train(larger, labels.filter("quality = 1"))
    assert all(r.score > 0.9 for r in quality.score(messy, one).collect())


def test_fit_holds_few_bytes_for_each_token():
    """Once 281 MB for these million tokens, 106 MB now."""
    rng = np.random.default_rng(5)
    names = np.array([f"word{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(5_000)])
    texts = [" ".join(["idiot"] * (i % 2) + names[rng.integers(0, len(names), 10_000)].tolist()) for i in range(100)]
    tracemalloc.start()
    toxicity.fit(texts, np.arange(100) % 2, 0.5, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_toxicity(larger, labels, messy, empty):
    field = toxicity.train(larger, labels)
    rows = toxicity.score(larger, field).collect()
    accuracy(rows, labels, "toxic", 0.9)
    texts = {r.doc_id: r.text for r in larger.collect()}
    spans = [texts[r.doc_id][s.start : s.end] for r in rows for s in r.spans]
    assert spans and all(w.isalpha() for w in spans)
    odd = toxicity.score(messy, field).collect()
    assert len(odd) == len(MESSY) and all(0 <= r.score <= 1 for r in odd) and len({r.score for r in odd if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(empty, field).count() == 0
    assert toxicity.score(messy, toxicity.train(empty, labels)).count() == len(MESSY)
    assert toxicity.annotate(messy, field).columns == [*messy.columns, "__score", "__spans"]


def test_forward_backward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([4, 0, 1, 6])
    e, move, begin = rng.normal(size=11), rng.normal(size=(2, 2)), rng.normal(size=2)
    got = toxicity.marginals(e, lengths, toxicity.Field(np.zeros(1), move, begin))
    lo = 0
    for n in lengths:
        weight, hot = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)) if n else []:
            s = begin[path[0]] + sum(e[lo + t] * path[t] for t in range(n)) + sum(move[path[t - 1], path[t]] for t in range(1, n))
            weight += np.exp(s)
            hot += np.exp(s) * np.array(path)
        assert np.allclose(got[lo : lo + n], hot / weight if n else [])
        lo += n
    p = np.full(5, 0.1)
    assert np.allclose(1 / (1 + np.exp(-toxicity.evidence(p, np.array([3, 2])))), [1 - 0.9**3, 1 - 0.9**2])


def test_spans_keep_offsets():
    text = "İstanbul IDIOT!  naïve"
    words = toxicity.tokens(text)
    assert [text[s["start"] : s["end"]] for s in toxicity.spans(text, list(range(len(words))))][1:] == ["IDIOT", "naïve"]
