"""Token ids of documents in binary files, compressed one by one with a shared dictionary.

The files are Parquet tables in one folder. ``dictionary`` has one row: the zstandard dictionary, trained on the id arrays
of a bounded sample of documents, its SHA-256, the width of an id, and the tokenizer. ``blocks`` has rows of up to
``BLOCK_DOCS`` consecutive documents in ascending id order: their ids, token counts and frame offsets, and the frames,
each compressed alone, so one document is read by the statistics of its block, its offset and its frame. ``ranges`` says
how many ids lie before each id range.

Documents are dealt out by ranges of their id. Encoded frames, not texts, are shuffled; a task writes its ranges in order
and counts the ids within a range as it goes, so the whole order needs only one total per range.

Results in edge cases: null and empty texts are documents of the end id alone; null ids come first; repeated ids are
separate documents, in the order of their token arrays; an empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainspan.llm.common import KEPT, clear_kept, rows_of, with_python
from chainspan.llm.ordering import ranged
from chainspan.session import new_folder

END_ID = 2
#: Documents whose id arrays the dictionary is trained on, the bytes of the pieces these are cut into, and how many pieces
#: from anywhere in them are taken; every document is compressed with it.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_PIECES = 1_000, 16_384, 2_000
DICTIONARY_BYTES = 65_536
BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 20
#: Pieces of text a worker remembers the ids of.
REMEMBERED = 1_000_000
#: The most frequent of them, by the first batch that is larger.
COMMON = 16_384

# A word of letters up to a stop, a stop after it, or any run of white space with what follows it. Tokens end at all of
# these places: a letter and a stop are never in one token, nor white space and what stands before it.
_PIECE = re.compile(r"\s*+[A-Za-zÀ-ÖØ-öø-ɏ]++(?![^\s.,])|[.,](?!\S)|\s*\S+|\s+")
#: Characters on which Python and the tokenizer may disagree whether they are white space.
_DOUBTFUL = re.compile("[\x1c-\x1f\x85᠎​⁠﻿]")


_ENDS = frozenset(c for c in map(chr, range(0x3001)) if c.isspace())


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece of text once.

    A byte-level tokenizer never joins what precedes a run of white space with the run, so the ids of a text are those
    of its pieces, one after the other. Texts with doubtful characters are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # In a byte-level vocabulary each character of a token stands for one byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.known: dict[str, int] = {}
        self.common: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has.

        Pieces that begin with white space and end without are encoded many at a time, as a text, and told apart by the
        bytes their ids stand for.
        """
        joined: list[str] = []
        rest: list[str] = []
        for p in pieces:
            (joined if p[0] in " \n" and p[-1] not in _ENDS else rest).append(p)
        flat, counts = [], []
        for lo in range(0, len(joined), 512):
            some = joined[lo : lo + 512]
            text = "".join(some)
            ids = np.array(self.raw([text])[0], np.uint32)
            ends = np.cumsum(np.fromiter(map(len, some if text.isascii() else [p.encode("utf-8", "surrogatepass") for p in some]), np.int64, len(some)))
            at = np.searchsorted(np.cumsum(self.bytes[ids]), ends)
            n = np.diff(at, prepend=-1)
            if "<|" in text or not len(ids) or at[-1] != len(ids) - 1:
                made = self.raw(some)
                n, ids = np.array([len(m) for m in made]), np.fromiter((i for m in made for i in m), np.uint32)
            flat.append(ids), counts.append(n)
        made = self.raw(rest)
        flat.append(np.fromiter((i for m in made for i in m), np.uint32)), counts.append(np.array([len(m) for m in made], np.int64))
        pieces[:] = joined + rest
        return np.concatenate(flat), np.concatenate(counts)

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[np.ndarray]:
        cut = [[t] if _DOUBTFUL.search(t) else _PIECE.findall(t) for t in (x or "" for x in texts)]
        flat = list(chain.from_iterable(cut))
        # Most pieces are among the few that come again and again; their table is small enough to stay close.
        at = np.fromiter(map(self.common.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        rest = [flat[i] for i in missing.tolist()]
        found = np.fromiter(map(self.known.get, rest, repeat(-1)), np.int64, len(rest))
        unseen = np.flatnonzero(found < 0)
        ids, starts = self.ids, self.starts
        if len(unseen):
            wanted = [rest[i] for i in unseen.tolist()]
            fresh = list(dict.fromkeys(wanted))
            made, n = self.pieces(fresh)
            numbers = dict(zip(fresh, range(len(starts) - 1, len(starts) - 1 + len(fresh)), strict=True))
            found[unseen] = np.fromiter(map(numbers.__getitem__, wanted), np.int64, len(wanted))
            ids, starts = np.concatenate([ids, made]), np.concatenate([starts, starts[-1] + np.cumsum(n)])
            if len(self.known) + len(fresh) <= REMEMBERED:
                self.known.update(numbers)
                self.ids, self.starts = ids, starts
        at[missing] = found
        if not self.common and len(at) > COMMON:
            often = np.argsort(-np.bincount(at[at < len(self.known)], minlength=len(self.known)))[:COMMON]
            names = list(self.known)
            self.common = {names[k]: k for k in often.tolist()}
        n = starts[at + 1] - starts[at]
        ends = np.cumsum(n)
        out = ids[np.repeat(starts[at] - ends + n, n) + np.arange(int(n.sum()))]
        stops = np.concatenate([[0], ends])[np.cumsum([len(p) for p in cut], dtype=np.int64)] if len(cut) else []
        tail = [] if end_id is None else [end_id]
        docs, lo = [], 0
        for hi in stops:
            docs.append(np.concatenate([out[lo:hi], np.array(tail, np.uint32)]))
            lo = hi
        return docs


def encoder(path: str) -> Encoder:
    """One encoder per worker and tokenizer."""
    if ("tokens", path) not in KEPT:
        clear_kept()
        KEPT["tokens", path] = Encoder(path)
    return KEPT["tokens", path]


def _packed(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, end_id: int) -> bytes:
    """A dictionary from the first documents in hash order; empty where there is too little to train on.

    The documents are chosen by their hashes alone, and the hashes are sent to the texts, not the texts to one task.
    """
    named = docs.select("text", F.xxhash64(F.lit(6), F.col("doc_id"), F.length("text")).alias("h"))
    chosen = named.select("h").orderBy("h").limit(SAMPLE_DOCS).distinct()
    some = named.join(F.broadcast(chosen), "h", "left_semi").select("text").limit(SAMPLE_DOCS)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 64):
            got = [_packed(a, width) for a in encoder(tokenizer).encode(b.column("text").to_pylist(), end_id)]
            cut = [a[k : k + SAMPLE_BYTES] for a in got for k in range(0, len(a), SAMPLE_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["a"])

    pieces = some.mapInArrow(arrays, "a binary").orderBy(F.xxhash64("a"), "a").limit(SAMPLE_PIECES)
    samples = sorted(bytes(r.a) for r in pieces.collect())
    if sum(map(len, samples)) < 16 * 1024 or len(samples) < 16:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    return zstandard.train_dictionary(size, samples, level=3).as_bytes()


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    if not data:
        return zstandard.ZstdCompressor(level=3)
    shared = zstandard.ZstdCompressionDict(data)
    shared.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=shared)


def _decompressor(data: bytes, expected: str) -> zstandard.ZstdDecompressor:
    if hashlib.sha256(data).hexdigest() != expected:
        raise ValueError("the dictionary is not the one the frames were compressed with")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data)) if data else zstandard.ZstdDecompressor()


_BLOCK = (
    "id_range int, first_id long, last_id long, start_in_range long, n_ids long, dictionary_sha256 string, "
    "doc_ids array<long>, n_tokens array<long>, frame_ends array<long>, frames binary"
)


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None) -> str:
    """Write the token files of (doc_id, text) and return their folder, a new one in the checkpoint folder if not given."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    with_python(docs)
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    data = train_dictionary(docs, tokenizer, width, end_id)
    sha = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(sha, bytearray(data), width, end_id, os.path.basename(tokenizer))], "sha256 string, dictionary binary, width int, end_id int, tokenizer string").coalesce(1).write.parquet(f"{folder}/dictionary")
    sent = spark.sparkContext.broadcast(data)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = _compressor(sent.value)
        for b in rows_of(batches):
            got = encoder(tokenizer).encode(b.column("text").to_pylist(), end_id)
            yield pa.RecordBatch.from_arrays(
                [b.column("id_range"), b.column("doc_id"), pa.array([len(a) for a in got], pa.int64()), pa.array([squeeze.compress(_packed(a, width)) for a in got], pa.binary())],
                ["id_range", "doc_id", "n", "frame"],
            )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before, size = None, 0, 0
        ids: list[int | None] = []
        counts: list[int] = []
        held: list[bytes] = []

        def block() -> pa.RecordBatch:
            nonlocal before
            known = [i for i in ids if i is not None]
            row = {
                "id_range": [current], "first_id": [min(known, default=None)], "last_id": [max(known, default=None)], "start_in_range": [before], "n_ids": [sum(counts)],
                "dictionary_sha256": [sha], "doc_ids": [list(ids)], "n_tokens": [list(counts)], "frame_ends": [np.cumsum([len(f) for f in held]).tolist()], "frames": [b"".join(held)],
            }
            before += sum(counts)
            ids.clear(), counts.clear(), held.clear()
            return pa.RecordBatch.from_pydict(row, schema=_SCHEMA)

        for b in batches:
            for r, i, n, f in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (r != current or len(held) >= BLOCK_DOCS or size + len(f) > BLOCK_BYTES):
                    yield block()
                    size = 0
                if r != current:
                    current, before = r, 0
                ids.append(i), counts.append(n), held.append(f)
                size += len(f)
        if held:
            yield block()

    d = ranged(docs.select("doc_id", "text"), name="id_range").select("id_range", "doc_id", "text")
    made = d.mapInArrow(frames, "id_range int, doc_id long, n long, frame binary")
    dealt = made.repartition("id_range").sortWithinPartitions("id_range", F.col("doc_id").asc_nulls_first(), "n", "frame")
    dealt.mapInArrow(blocks, _BLOCK).write.parquet(f"{folder}/blocks")
    totals = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks").groupBy("id_range").agg(F.sum("n_ids").alias("n_ids"))
    line = W.orderBy("id_range").rowsBetween(W.unboundedPreceding, -1)
    totals.select("id_range", "n_ids", F.coalesce(F.sum("n_ids").over(line), F.lit(0)).cast("long").alias("before")).coalesce(1).write.parquet(f"{folder}/ranges")
    return folder


_SCHEMA = pa.schema(
    [
        ("id_range", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("start_in_range", pa.int64()), ("n_ids", pa.int64()), ("dictionary_sha256", pa.string()),
        ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("frame_ends", pa.list_(pa.int64())), ("frames", pa.binary()),
    ]
)


def _decoded(spark: SparkSession, folder: str, rows: DataFrame, output: str, make) -> DataFrame:
    """One output row per document of the blocks in ``rows``; ``make`` gets id, start and ids."""
    d = spark.read.parquet(f"{folder}/dictionary").first()
    sent = spark.sparkContext.broadcast(bytes(d.dictionary))
    kind, columns = "<u2" if d.width == 2 else "<u4", [c.strip().split(" ") for c in output.split(",")]
    types = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, types[t]) for n, t in columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1):
            r = {k: v[0] for k, v in b.to_pydict().items()}
            expand = _decompressor(sent.value, r["dictionary_sha256"])
            start, lo, out = r["before"] + r["start_in_range"], 0, []
            for i, n, hi in zip(r["doc_ids"], r["n_tokens"], r["frame_ends"], strict=True):
                ids = np.frombuffer(expand.decompress(r["frames"][lo:hi]), kind).astype("<u4")
                if len(ids) != n:
                    raise ValueError(f"document {i} has {len(ids)} ids, its index says {n}")
                out.append(make(i, start, ids))
                start, lo = start + n, hi
            yield pa.RecordBatch.from_pydict({c: [o[k] for o in out] for k, (c, _) in enumerate(columns)}, schema=schema)

    # One row per id range: as many as partitions were asked for when the files were written.
    ranges = spark.read.parquet(f"{folder}/ranges").select("id_range", "before")
    return with_python(rows.join(F.broadcast(ranges), "id_range")).mapInArrow(read, output)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    rows = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    return _decoded(spark, folder, rows, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda i, s, ids: (i, s, len(ids), zlib.crc32(ids.tobytes())))


def document(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """(doc_id, start, ids) of one document: the blocks that cannot hold it are skipped by their statistics."""
    rows = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return _decoded(spark, folder, rows, "doc_id long, start long, ids array<int>", lambda i, s, ids: (i, s, ids.tolist())).filter(F.col("doc_id") == doc_id)
