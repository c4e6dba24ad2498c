"""Quality scores: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates.

N-grams of one and two words are hashed into a table of fixed size, in three spaces: the words themselves; their shapes
(what is left of a word without its small letters), which carry over to words not seen before; and repetition (a word
that equals the one before). The values of a space are the square roots of relative frequencies, so long and short texts
weigh alike, and a score is one sparse dot product.

Texts are hashed by the same code in training and scoring, on the executors. The fit runs over a bounded sample of
labelled rows (``training.ROWS_PER_CLASS``); the model has a fixed size and is sent to the tasks.

Results in edge cases: null and empty texts have no n-grams and score by the intercept; if one class has no labels the
score is the share of the other; no labels at all score 0.5; repeated rows and ids are scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspan.llm.common import held_out, mix, rows_of, with_python, word_hashes
from chainspan.llm.training import ROWS_PER_CLASS, training_rows

TABLE_BITS = 18
_SMALL = bytes(range(ord("a"), ord("z") + 1)) + bytes(range(0x80, 0x100))
_SHAPE = bytes(ord("A") if 65 <= i <= 90 else ord("0") if 48 <= i <= 57 else i for i in range(256))


def shape_hashes(text: str | None) -> np.ndarray:
    w = (text or "").encode("utf-8", "surrogatepass").translate(_SHAPE, _SMALL).split()
    return mix(np.fromiter(map(zlib.crc32, w), np.uint64, len(w)) + np.uint64(1 << 40))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table and values of the n-grams of a text."""
    h, s = word_hashes(text), shape_hashes(text)
    places, values = [], []
    again = np.full(int((h[1:] == h[:-1]).sum()), 7, np.uint64)
    rest = np.full(len(h) - len(again), 11, np.uint64)
    for k, ngrams in enumerate(((h, mix(h[1:] + mix(h[:-1]))), (s, mix(s[1:] + mix(s[:-1]))), (again, rest))):
        x = np.concatenate([mix(g + np.uint64(1 + 2 * k + j)) for j, g in enumerate(ngrams)]) >> np.uint64(64 - TABLE_BITS)
        at, n = np.unique(x.astype(np.uint32), return_counts=True)
        places.append(at)
        values.append(np.sqrt(n / max(1, n.sum())).astype(np.float32))
    return np.concatenate(places), np.concatenate(values)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, at: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.bias + float(self.weights[at] @ values)))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], share: float, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> Model:
    """Follow the regularised leader over the rows in their order; ``share`` of all labelled rows are of class 1."""
    if not rows or len({y for *_, y in rows}) < 2:
        return Model(np.zeros(1 << TABLE_BITS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    ones = sum(y for *_, y in rows) / len(rows)
    weight = {1: share / ones, 0: (1 - share) / (1 - ones)}
    z, n = np.zeros(1 << TABLE_BITS), np.zeros(1 << TABLE_BITS)
    bias, seen = float(np.log(share / (1 - share))), 1.0

    def leader(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, v, y in rows:
            w = leader(at)
            p = 1 / (1 + np.exp(-np.clip(bias + w @ v, -30, 30)))
            g = weight[y] * (p - y) * v
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
            seen += (p - y) ** 2
            bias -= 0.1 * weight[y] * (p - y) / np.sqrt(seen)
    every = np.arange(1 << TABLE_BITS)
    return Model(leader(every).astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = ROWS_PER_CLASS) -> Model:
    rows, counts = training_rows(docs, labels, label, per_class)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()), b.column("y")], ["doc_id", "at", "v", "y"]
            )

    got = with_python(rows).mapInArrow(hashed, "doc_id long, at binary, v binary, y int").toPandas()
    got["order"] = mix(got["doc_id"].to_numpy(np.int64).view(np.uint64))
    got = got.sort_values(["order", "doc_id"])
    sample = [(np.frombuffer(a, np.uint32), np.frombuffer(v, np.float32), int(y)) for a, v, y in zip(got["at"], got["v"], got["y"], strict=True)]
    total = sum(counts.values())
    return fit(sample, counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in rows_of(batches):
            s = [m.score(*features(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return with_python(d).mapInArrow(scored, "doc_id long, held_out boolean, score double")
