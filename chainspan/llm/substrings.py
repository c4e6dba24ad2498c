"""Removal of passages that occur earlier, by relative Lempel-Ziv parsing over words.

The corpus is its own reference. All runs of ``WORDS`` words are indexed, and the index is split into reference blocks by
hash; a block knows, for each run, the first chunk of documents that holds it. A document is parsed greedily: a factor
starts at a run that occurs earlier and grows as long as the next run does too; runs across the end of a factor are
looked up like all others, so nothing is lost at boundaries. Factors are at least ``WORDS`` long and are the duplicate
spans.

Documents are dealt out in chunks of consecutive ids. A chunk sorts its run hashes, keeps one of each, and sends every
block its share as sorted differences: about six bytes a run, no ids and no positions, since the place of a chunk in the
order says what is earlier and a run met twice within a chunk is settled there. The block answers with one bit per run in
the order they came, and the chunk, parsed again, reads the bits. A passage in a third of all documents is one entry per
chunk; a group of copies is no group anywhere. Texts are shuffled once, both passes read that shuffle.

Runs are compared by 64-bit hashes of 64-bit word hashes (XXH3), both without a weakness on words of one form; among r
different runs about r * r / 2^65 pairs meet by chance, none below 10^9 runs.

Results in edge cases: null and empty texts have no words; texts shorter than a run keep all; null ids come before all
others; rows with the same id are separate documents, in the order of a hash of their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspan.llm.common import parts, rolling, strong_word_hashes, with_python
from chainspan.llm.ordering import id_bounds, range_of

WORDS = 20
#: Characters of text a chunk is meant to hold, and runs a block is meant to hold.
CHUNK_CHARS, BLOCK_RUNS = 8_000_000, 1_500_000

_SENT = pa.schema([("block", pa.int32()), ("id_range", pa.int32()), ("sub", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("runs", pa.binary())])
_ANSWER = pa.schema([("id_range", pa.int32()), ("sub", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])


def packed(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted values as differences of a fixed number of bytes."""
    d = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return width, np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(width: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


class Chunk:
    """The runs of a chunk's documents, in order."""

    def __init__(self, docs: pa.Table, words: int) -> None:
        ids, ties = docs.column("doc_id").to_pylist(), docs.column("tie").to_pylist()
        self.order = sorted(range(docs.num_rows), key=lambda i: (ids[i] is not None, ids[i] or 0, ties[i]))
        self.texts = docs.column("text")
        runs = [rolling(strong_word_hashes(self.texts[i].as_py()), words) for i in self.order]
        self.counts = [len(r) for r in runs]
        every = np.concatenate(runs) if runs else np.empty(0, np.uint64)
        self.values, self.first, self.inverse = np.unique(every, return_index=True, return_inverse=True)

    def blocks(self, count: int) -> np.ndarray:
        """Where each block's share of the sorted values begins, and the end."""
        edges = np.array([(k << 64) // count for k in range(1, count)], np.uint64)
        return np.concatenate([[0], np.searchsorted(self.values, edges), [len(self.values)]]).astype(np.int64)

    def earlier(self, bits: np.ndarray) -> np.ndarray:
        """Whether each run occurs earlier, given which values do before this chunk."""
        if not len(self.inverse):
            return np.empty(0, bool)
        return bits[self.inverse] | (np.arange(len(self.inverse)) != self.first[self.inverse])


def factors(earlier: np.ndarray, words: int) -> list[tuple[int, int]]:
    """The duplicate spans [start, end) of a document in words: maximal chains of runs that occur earlier."""
    at = np.flatnonzero(earlier)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > words)  # spans that touch or overlap are one
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + words).tolist(), strict=True))


def chunked(docs: DataFrame, chunk_chars: int) -> tuple[DataFrame, int]:
    """Documents with id_range and sub, which rise with the id and hold about ``chunk_chars`` each; all characters.

    Quantiles of the id make the ranges; where these are too large, they are cut evenly by id.
    """
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    chars, most = size.chars or 0, 4 * parts(docs.sparkSession)
    n = max(1, min(most, max(most // 4, -(-chars // chunk_chars))))
    bounds = id_bounds(docs, "doc_id", n)
    subs = max(1, -(-chars // (chunk_chars * max(1, n))))
    sub = F.lit(0).cast("long")
    if subs > 1:
        ends = F.array(*[F.lit(x).cast("double") for x in [size.lo - 1, *bounds, max(size.hi, (bounds or [size.hi])[-1] + 1)]])
        lo, hi = F.element_at(ends, F.col("id_range") + 1), F.element_at(ends, F.col("id_range") + 2)
        sub = F.coalesce(F.floor((F.col("doc_id") - lo) / (hi - lo) * subs), F.lit(0)).cast("long")
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), range_of(F.col("doc_id"), bounds).alias("id_range"))
    return d.withColumn("sub", sub), chars


def parsed(docs: DataFrame, words: int = WORDS, chunk_chars: int = CHUNK_CHARS, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, spans): each document without the words of its duplicate spans.

    kept joins the remaining words by one space; spans count words.
    """
    d, chars = chunked(with_python(docs).select("doc_id", "text"), chunk_chars)
    blocks = max(parts(docs.sparkSession), -(-chars // (6 * block_runs)))

    def send(docs: pa.Table) -> pa.Table:
        chunk = Chunk(docs, words)
        at = chunk.blocks(blocks)
        rows: list[list] = [[] for _ in _SENT]
        for k in np.flatnonzero(np.diff(at)).tolist():
            width, data = packed(chunk.values[at[k] : at[k + 1]])
            for column, x in zip(rows, (k, docs["id_range"][0].as_py(), docs["sub"][0].as_py(), int(at[k + 1] - at[k]), width, data), strict=True):
                column.append(x)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _SENT, strict=True)], schema=_SENT)

    def answer(sent: pa.Table) -> pa.Table:
        rows = sorted(sent.to_pylist(), key=lambda r: (r["id_range"], r["sub"]))
        every = np.concatenate([unpacked(r["width"], r["runs"]) for r in rows])
        order = np.argsort(every, kind="stable")  # equal values stay in the order of their chunks
        ranked = every[order]
        met = np.zeros(len(every), bool)
        met[order[1:]] = ranked[1:] == ranked[:-1]
        ends = np.cumsum([r["n"] for r in rows])
        bits = [np.packbits(met[e - r["n"] : e]).tobytes() for e, r in zip(ends, rows, strict=True)]
        columns = [[r["id_range"] for r in rows], [r["sub"] for r in rows], [r["block"] for r in rows], [r["n"] for r in rows], bits]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ANSWER, strict=True)], schema=_ANSWER)

    def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(docs, words)
        rows = sorted(answers.to_pylist(), key=lambda r: r["block"])
        bits = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in rows]
        earlier = chunk.earlier(np.concatenate(bits) if bits else np.empty(0, bool))
        out: dict[str, list] = {f.name: [] for f in _PARSED}
        lo = 0
        for i, n in zip(chunk.order, chunk.counts, strict=True):
            w = (chunk.texts[i].as_py() or "").encode("utf-8", "surrogatepass").split()
            spans = factors(earlier[lo : lo + n], words)
            lo += n
            keep, end = [], 0
            for a, b in spans:
                keep += w[end:a]
                end = b
            kept = b" ".join(keep + w[end:] if spans else w)
            row = (docs["doc_id"][i].as_py(), len(w), sum(b - a for a, b in spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass"), [{"start": a, "end": b} for a, b in spans])
            for column, x in zip(out.values(), row, strict=True):
                column.append(x)
        return pa.Table.from_pydict(out, schema=_PARSED)

    grouped = d.groupBy("id_range", "sub")
    sent = grouped.applyInArrow(send, "block int, id_range int, sub long, n long, width int, runs binary")
    answers = sent.groupBy("block").applyInArrow(answer, "id_range int, sub long, block int, n long, bits binary")
    return grouped.cogroup(answers.groupBy("id_range", "sub")).applyInArrow(
        finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:long,end:long>>"
    )


_PARSED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
