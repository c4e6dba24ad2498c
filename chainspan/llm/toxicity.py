"""Toxic spans and scores by a linear-chain conditional random field.

Tokens are runs of letters in lower case. A token is toxic or not; its score depends on hashes of the word and of its
beginnings, neighbours on the transitions. Forward-backward gives each token's marginal; a document's score comes from the
chance that any token is toxic, calibrated on the labelled documents, and the offending offsets are the tokens above
one half.

Labels are given per document, so tokens are labelled first: those of the fewest words and beginnings of words that
explain the toxic documents and hardly occur in the others (``toxic_words``). The field is fitted on these tokens, over a bounded sample of documents (``training.ROWS_PER_CLASS``).

All documents of a batch form one chain whose transition forgets the past at each document's first token, so the
recursions run over blocks in parallel, exactly, however long a text is.

Results in edge cases: null and empty texts have no tokens and get the score of such documents; if one class has no
labels the score is the share of the other; no labels at all score 0.5; repeated rows and ids are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspan.llm.common import clear_kept, held_out, rows_of, with_python
from chainspan.llm.training import ROWS_PER_CLASS, training_rows

TABLE_BITS = 18
#: Bytes of a word's beginning that are features; the last stands for the whole word.
PREFIXES = (4, 5, 6, 8, None)
LEAST_DOCS = 4
LIFT = 4.0
PURE = 25.0
#: Tokens whose scores a worker remembers.
REMEMBERED = 150_000
_LETTERS = bytes(i if i >= 0x80 or 97 <= i <= 122 else 32 for i in range(256))
_TOKEN = re.compile("[a-z\x80-\U0010ffff]+")


def lowered(text: str | None) -> str:
    """Lower case that keeps every offset."""
    t = text or ""
    low = t.lower()
    return low if len(low) == len(t) else "".join(c if len(c.lower()) != 1 else c.lower() for c in t)


def tokens(text: str | None) -> list[bytes]:
    return lowered(text).encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def token_features(words: list[bytes]) -> np.ndarray:
    """Places in the table, one row per word."""
    out = np.empty((len(words), len(PREFIXES)), np.uint32)
    for k, n in enumerate(PREFIXES):
        out[:, k] = np.fromiter((zlib.crc32(w[:n], k + 1) for w in words), np.uint32, len(words))
    return out >> np.uint32(32 - TABLE_BITS)


@dataclass
class Field:
    """``emit`` scores a feature for the toxic state, the clean one has 0; ``move`` and ``begin`` are log weights."""

    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def emission(self, words: list[bytes]) -> np.ndarray:
        return self.emit[token_features(words)].sum(axis=1) if words else np.empty(0)


def forward_backward(e: np.ndarray, first: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward and backward values, each of shape (2, tokens), of a chain with fresh starts at ``first``.

    Blocks of about the square root of the chain's length are multiplied out side by side; the short chain of blocks
    then gives each block's entry values.
    """
    n = len(e)
    if not n:
        return np.empty((2, 0)), np.empty((2, 0))
    size = max(1, int(np.sqrt(n)))
    count = -(-n // size)
    x = np.zeros(count * size)
    x[:n] = np.clip(e, -25, 25)
    x = np.exp(x).reshape(count, size)
    fresh = np.ones(count * size, bool)  # what fills the last block starts afresh and so says nothing
    fresh[:n] = first
    fresh = fresh.reshape(count, size)
    a, b = np.exp(move), np.exp(begin)

    def ahead(u0, u1, t):
        r, both = fresh[:, t], u0 + u1
        return np.where(r, both * b[0], u0 * a[0, 0] + u1 * a[1, 0]), np.where(r, both * b[1], u0 * a[0, 1] + u1 * a[1, 1]) * x[:, t]

    def back(v0, v1, t):
        r, w1 = fresh[:, t], v1 * x[:, t]
        start = b[0] * v0 + b[1] * w1
        return np.where(r, start, a[0, 0] * v0 + a[0, 1] * w1), np.where(r, start, a[1, 0] * v0 + a[1, 1] * w1)

    p = [np.ones(count), np.zeros(count), np.zeros(count), np.ones(count)]  # rows of each block's product
    for t in range(size):
        p[0], p[1] = ahead(p[0], p[1], t)
        p[2], p[3] = ahead(p[2], p[3], t)
        s = p[0] + p[1] + p[2] + p[3]
        p = [q / s for q in p]
    into, out = np.empty((2, count)), np.empty((2, count))
    u = (0.5, 0.5)
    for k in range(count):
        into[:, k] = u
        u = (u[0] * p[0][k] + u[1] * p[2][k], u[0] * p[1][k] + u[1] * p[3][k])
        s = u[0] + u[1]
        u = (u[0] / s, u[1] / s)
    v = (0.5, 0.5)
    for k in range(count - 1, -1, -1):
        out[:, k] = v
        v = (p[0][k] * v[0] + p[1][k] * v[1], p[2][k] * v[0] + p[3][k] * v[1])
        s = v[0] + v[1]
        v = (v[0] / s, v[1] / s)
    alpha, beta = np.empty((2, count, size)), np.empty((2, count, size))
    u0, u1 = into
    v0, v1 = out
    for t in range(size):
        u0, u1 = ahead(u0, u1, t)
        s = u0 + u1
        u0, u1 = u0 / s, u1 / s
        alpha[0, :, t], alpha[1, :, t] = u0, u1
    for t in range(size - 1, -1, -1):
        beta[0, :, t], beta[1, :, t] = v0, v1
        v0, v1 = back(v0, v1, t)
        s = v0 + v1
        v0, v1 = v0 / s, v1 / s
    return alpha.reshape(2, -1)[:, :n], beta.reshape(2, -1)[:, :n]


def marginals(e: np.ndarray, lengths: np.ndarray, field: Field) -> np.ndarray:
    """Each token's chance of being toxic."""
    alpha, beta = forward_backward(e, starts(lengths), field.move, field.begin)
    both = alpha * beta
    return both[1] / both.sum(axis=0)


def starts(lengths: np.ndarray) -> np.ndarray:
    first = np.zeros(int(lengths.sum()), bool)
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    first[at[lengths > 0].astype(np.int64)] = True
    return first


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def evidence(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log odds that any token of a document is toxic."""
    clean = np.log1p(-np.minimum(p, 1 - 1e-9))
    ends = np.concatenate([[0.0], np.cumsum(clean)])
    stops = np.cumsum(lengths)
    none = np.minimum(ends[stops] - ends[stops - lengths], -1e-6)
    return np.log(-np.expm1(none)) - none


def toxic_words(ids: np.ndarray, doc: np.ndarray, places: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which words count as toxic in toxic documents.

    The word or beginning that explains the most toxic documents not yet explained is taken, again and again, so what
    merely stands beside a toxic word, as in copies of one text, is not. It must be ``LIFT`` times as frequent in toxic
    documents, and occur in more of them than chance would let any feature; unless it is ``PURE`` times as frequent it
    must also explain that many of them by itself.
    """
    size = 1 << TABLE_BITS
    chosen = np.zeros(len(places), bool)
    if not len(ids):
        return chosen
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    in_doc = np.unique(doc.astype(np.int64) * len(places) + ids)
    d, w = in_doc // len(places), (in_doc % len(places)).astype(np.int32)
    del in_doc
    # Counts of all pairs of feature and document; only those of toxic documents are held, one kind of feature after another.
    toxic: list[tuple[np.ndarray, np.ndarray]] = []
    neg = np.zeros(size * len(PREFIXES), np.int64)
    for k in range(len(PREFIXES)):
        pairs = np.unique(d * size + places[w, k])
        bad = y[pairs // size] == 1
        neg[k * size : (k + 1) * size] = np.bincount(pairs[~bad] % size, minlength=size)
        pairs = pairs[bad]
        toxic.append(((pairs % size + k * size).astype(np.int32), (pairs // size).astype(np.int32)))
    f, of = (np.concatenate(x) for x in zip(*toxic, strict=True))
    every = np.bincount(f, minlength=size * len(PREFIXES))
    least = np.log(100.0 * np.count_nonzero(neg + every)) / np.log((n0 + n1) / n1)
    lift = np.maximum(every, 1) / n1 / ((neg + 0.5) / n0)
    worth = np.where((lift >= LIFT) & (every >= max(LEAST_DOCS, least)), np.log(lift), 0.0)
    # Enough documents left to explain, or a pure feature that explains some at least.
    needed = np.where(lift >= PURE, 2, max(LEAST_DOCS, least))
    keep = worth[f] > 0
    f, of = f[keep], of[keep]
    while len(f):
        pos = np.bincount(f, minlength=size * len(PREFIXES))
        gain = np.where(pos >= needed, pos, 0) * worth
        best = int(gain.argmax())
        if not gain[best]:
            break
        chosen |= places[:, best // size] == best % size
        left = ~np.isin(of, of[f == best])
        f, of = f[left], of[left]
    return chosen


def moves(alpha: np.ndarray, beta: np.ndarray, x: np.ndarray, a: np.ndarray, prev: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """How often each state is expected to follow each. The four chances are made twice, so that few are held at a time."""

    def step(i: int, j: int) -> np.ndarray:
        made = alpha[i][prev]
        made *= a[i, j]
        if j:
            made *= x[inner]
        made *= beta[j][inner]
        return made

    whole = step(0, 0)
    for i, j in ((0, 1), (1, 0), (1, 1)):
        whole += step(i, j)
    return np.array([[(step(i, j) / whole).sum() for j in (0, 1)] for i in (0, 1)])


def fit(texts: list[str | None], y: np.ndarray, share: float, rounds: int = 12, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """A field from labelled documents; ``share`` of all labelled documents are toxic."""
    empty = Field(np.zeros(1 << TABLE_BITS, np.float32), np.zeros((2, 2)), np.zeros(2), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    if len(set(y.tolist())) < 2:
        return empty
    # The tokens of one text at a time become numbers: as objects, all together would take most of a worker's memory.
    number: dict[bytes, int] = {}
    of_doc = []
    for t in texts:
        words = tokens(t)
        of_doc.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
    lengths = np.array([len(d) for d in of_doc], np.int64)
    ids = np.concatenate(of_doc)
    places = token_features(list(number))
    doc = np.repeat(np.arange(len(of_doc), dtype=np.int32), lengths)
    del number, of_doc

    n1, n0 = int(y.sum()), int((1 - y).sum())
    z = toxic_words(ids, doc, places, y)[ids] & (y[doc] == 1)
    del doc

    # Gradient ascent on the conditional likelihood of the token labels, steps scaled per weight.
    first = starts(lengths)
    emit = np.zeros(1 << TABLE_BITS)
    rate_z = float(np.clip(z.astype(float).mean(), 1e-4, 0.5)) if len(z) else 0.01
    begin = np.log(np.array([1 - rate_z, rate_z]))
    move = np.stack([begin, begin])
    sums = [np.full(1 << TABLE_BITS, 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)]
    inner = ~first
    prev = (np.flatnonzero(inner) - 1).astype(np.int32)
    zi = z.astype(np.int8)
    want_move = np.zeros((2, 2))
    np.add.at(want_move, (zi[prev], zi[inner]), 1)
    want_begin = np.bincount(zi[first], minlength=2).astype(float)
    for _ in range(rounds):
        word_e = emit[places].sum(axis=1)
        alpha, beta = forward_backward(word_e[ids], first, move, begin)
        p = alpha[1] * beta[1]
        p /= alpha[0] * beta[0] + p
        have_begin = np.array([(1 - p[first]).sum(), p[first].sum()])
        by_word = np.bincount(ids, weights=z - p, minlength=len(places))
        del p
        have_move = moves(alpha, beta, np.exp(np.clip(word_e, -25, 25))[ids], np.exp(move), prev, inner)
        del alpha, beta
        g_emit = np.bincount(places.ravel(), weights=np.repeat(by_word, len(PREFIXES)), minlength=1 << TABLE_BITS) - decay * emit
        for value, g, s, r in ((emit, g_emit, sums[0], rate), (move, want_move - have_move, sums[1], rate / 2), (begin, want_begin - have_begin, sums[2], rate / 2)):
            s += g * g
            value += r * g / np.sqrt(s)
    field = Field(emit.astype(np.float32), move, begin)

    # Calibration of the document score on the same documents, classes weighted as among all labelled ones.
    s = np.clip(evidence(marginals(field.emit[places].sum(axis=1)[ids], lengths, field), lengths), -12, 12)
    weight = np.where(y == 1, share / max(n1, 1), (1 - share) / max(n0, 1)) * len(y)
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = logistic(slope * s + shift)
        r, q = weight * (y - p), weight * p * (1 - p) + 1e-6
        h = np.array([[(q * s * s).sum() + 10.0, (q * s).sum()], [(q * s).sum(), q.sum() + 1.0]])
        ds, dt = np.linalg.solve(h, [(r * s).sum() - 10 * (slope - 1.0), r.sum() - shift])
        slope, shift = slope + ds, shift + dt
        if abs(ds) + abs(dt) < 1e-9:
            break
    field.slope, field.shift = float(max(slope, 1e-3)), float(shift)
    return field


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = ROWS_PER_CLASS) -> Field:
    rows, counts = training_rows(docs, labels, label, per_class)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5

    def one(sample: pa.Table) -> pa.Table:
        clear_kept()  # what an earlier step left in this worker would come on top
        sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        f = fit(sample["text"].to_pylist(), sample["y"].to_numpy().astype(np.int64), share)
        return pa.table({"emit": pa.array([f.emit.tobytes()], pa.binary()), "rest": [[*f.move.ravel().tolist(), *f.begin.tolist(), f.slope, f.shift]]})

    # The sample is bounded, so one task fits it; the driver gets the model alone.
    found = with_python(rows).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(one, "emit binary, rest array<double>").collect()
    if not found:
        return fit([], np.empty(0, np.int64), share)
    r = found[0].rest
    return Field(np.frombuffer(bytes(found[0].emit), np.float32), np.array(r[:4]).reshape(2, 2), np.array(r[4:6]), r[6], r[7])



def document_scores(texts: list[str | None], field: Field, memory: dict[bytes, float]) -> tuple[np.ndarray, list[list[int]]]:
    """Scores, and of each text the places of its toxic tokens."""
    of_doc = [tokens(t) for t in texts]
    lengths = np.array([len(d) for d in of_doc], np.int64)
    flat = [w for d in of_doc for w in d]
    fresh = list({w for w in flat if w not in memory})
    e_fresh = field.emission(fresh)
    known = memory
    if len(memory) + len(fresh) <= REMEMBERED:
        memory.update(zip(fresh, e_fresh.tolist(), strict=True))
    elif fresh:
        known = memory | dict(zip(fresh, e_fresh.tolist(), strict=True))
    e = np.fromiter(map(known.__getitem__, flat), float, len(flat))
    p = marginals(e, lengths, field)
    s = field.slope * np.clip(evidence(p, lengths), -12, 12) + field.shift
    hot = np.flatnonzero(p >= 0.5)
    ends = np.cumsum(lengths)
    places: list[list[int]] = [[] for _ in texts]
    for i, k in zip(hot.tolist(), np.searchsorted(ends, hot, side="right").tolist(), strict=True):
        places[k].append(i - int(ends[k] - lengths[k]))
    return logistic(s), places


def spans(text: str | None, places: list[int]) -> list[dict[str, int]]:
    """Character offsets of the tokens at the given places."""
    if not places:
        return []
    at = [m.span() for m in _TOKEN.finditer(lowered(text))]
    return [{"start": at[i][0], "end": at[i][1]} for i in places]


def score(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, held_out, score, spans) of every document; spans are the offsets of toxic tokens in the text."""
    return annotate(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), field).select("doc_id", "held_out", F.col("__score").alias("score"), F.col("__spans").alias("spans"))


def annotate(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with __score and __spans."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_kept()
        memory: dict[bytes, float] = {}
        for b in rows_of(batches):
            texts = b.column("text").to_pylist()
            s, places = document_scores(texts, sent.value, memory)
            found = pa.array([spans(t, x) for t, x in zip(texts, places, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), found], [*b.schema.names, "__score", "__spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return with_python(docs).mapInArrow(scored, f"{schema}, __score double, __spans array<struct<start:int,end:int>>")
