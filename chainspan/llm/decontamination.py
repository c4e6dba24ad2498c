"""Benchmark passages in documents, also with other numbers, names and units put in.

Words are brought to a template: numbers, names (capitalised words within a sentence) and units become typed
placeholders, other words lose case and punctuation. Whether the capitalised first word of a sentence is a name cannot be
seen, so windows that hold one are taken both ways, in items and in documents. Windows of ``WINDOW`` template words of the benchmark are joined by
hash with those of the documents. Matches that lie on one diagonal (document place minus item place) are one occurrence;
it counts if its windows make up ``ENOUGH`` words of the item or all of a shorter one, and if its slots are consistent: the same
value of the item always meets the same value in the document (two values may meet the same one). Windows with equal values
that make up as much by themselves are a verbatim copy, whatever the other slots hold.

Before the join, documents drop windows that are surely not in the benchmark by a bitmap of fixed size; what passes by
chance falls out in the join. The join is an equi-join whatever the sizes, so adaptive execution may split a hot window.

Results in edge cases: null and empty texts hold nothing; windows of fewer than ``LEAST_WORDS`` literal words
match with equal values only; items shorter than a window match as a whole; repeated items and repeated documents are each judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspan.llm.common import clear_kept, mix, rolling, rolling_at, rows_of, with_python
from chainspan.session import written

WINDOW = 8
LEAST_WORDS = 4
ENOUGH = 13
#: Bits of the bitmap, as a power of two: two megabytes at any size of the benchmark.
BITMAP = 24

# Units of measure and currency as they follow or precede a number.
UNITS = frozenset(
    "% $ € £ ¥ mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg t lb lbs oz ton tons ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph km/h m/s hz khz mhz ghz w kw mw v a j kj cal kcal "
    "pa bar k c f °c °f dollar dollars cent cents euro euros pound pounds eur usd gbp percent degree degrees bit bits byte bytes kb mb gb tb".split()
)
WORD_KIND, NUMBER, NAME, UNIT = range(4)
#: Words kept in a table small enough to stay close.
COMMON = 16_384
_NUMBER = re.compile(r"([$€£¥]?)[+-]?(\d[\d.,:/]*)(\D*)")
_EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "%$°") + "“”‘’«»¿¡…–—"
_PLACEHOLDERS = mix(np.arange(1, 6, dtype=np.uint64))


def _hash(word: bytes) -> int:
    """61 bits, so that a value and its kind fit a long."""
    return xxhash.xxh3_64_intdigest(word) >> 3


def canon(word: str) -> tuple[list[tuple[int, int]], bool, bool]:
    """The (kind, value hash) template words of a word, whether it is capitalised, and whether a sentence ends with it."""
    if word.isascii() and len(word) > 2:  # most words are letters, with a stop or without
        stop = word[-1] if word[-1] in ",.;:!?" else ""
        bare = word[:-1] if stop else word
        if bare.isalpha() and (low := bare.lower()) not in UNITS:
            return [(WORD_KIND, _hash(low.encode()))], bare[0].isupper(), stop in (".", "!", "?", ":")
    bare = word.strip(_EDGE)
    ends = word.rstrip("\"')]}”’»")[-1:] in (".", "!", "?", ":")
    if not bare:
        return [], False, ends
    low = bare.lower()
    if low in UNITS:
        # One-letter units are words as often: only beside a number do they count, which the number's own suffix covers.
        return [(UNIT if len(low) > 1 or not low.isalpha() else WORD_KIND, _hash(low.encode("utf-8", "surrogatepass")))], False, ends
    m = _NUMBER.fullmatch(low)
    if m:
        out = [(NUMBER, _hash(m[2].rstrip(".,:/").encode()))]
        out += [(UNIT, _hash(u.encode("utf-8", "surrogatepass"))) for u in (m[1], m[3]) if u]
        return out, False, ends
    return [(WORD_KIND, _hash(low.encode("utf-8", "surrogatepass")))], bare[0].isupper(), ends


class Templates:
    """Turns texts into template words, many texts at a time; remembers what words turn into."""

    def __init__(self, remembered: int = 300_000) -> None:
        self.remembered = remembered
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.common: dict[str, int] = {}
        # Each word has up to three template words, one after the other, from its start on; of each its kind, value and code.
        self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.kind, self.value, self.code = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.capital, self.ends = np.empty(0, bool), np.empty(0, bool)

    def learn(self, words: list[str]) -> None:
        capital, ends, count = np.zeros(len(words), bool), np.zeros(len(words), bool), np.ones(len(words), np.int64)
        plain, lows, rest = [], [], []
        for i, w in enumerate(words):
            # As ``canon`` does for most words: letters, with a stop or without.
            stop = w[-1]
            bare = w[:-1] if stop in ",.;:!?" else w
            if len(w) > 2 and bare.isalpha() and (low := bare.lower()) not in UNITS:
                plain.append(i), lows.append(low)
                if bare[0].isupper():
                    capital[i] = True
                if stop in ".!?:":
                    ends[i] = True
            else:
                rest.append(i)
        others = [canon(words[i]) for i in rest]
        count[rest] = [len(made) for made, _, _ in others]
        capital[rest], ends[rest] = [c for _, c, _ in others], [e for _, _, e in others]
        start = np.cumsum(count) - count
        kind, value = np.full(int(count.sum()), WORD_KIND, np.int64), np.zeros(int(count.sum()), np.uint64)
        value[start[plain]] = np.fromiter(map(xxhash.xxh3_64_intdigest, lows), np.uint64, len(lows)) >> np.uint64(3)
        for i, (made, _, _) in zip(start[rest].tolist(), others, strict=True):
            for j, (k, v) in enumerate(made):
                kind[i + j], value[i + j] = k, v
        code = np.where(kind == WORD_KIND, mix(value + np.uint64(1 << 33)), _PLACEHOLDERS[kind])
        self.known.update(zip(words, range(len(self.start), len(self.start) + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.kind) + start])
        self.count = np.concatenate([self.count, count])
        self.kind, self.value, self.code = np.concatenate([self.kind, kind]), np.concatenate([self.value, value]), np.concatenate([self.code, code])
        self.capital, self.ends = np.concatenate([self.capital, capital]), np.concatenate([self.ends, ends])

    def numbers(self, flat: list[str]) -> np.ndarray:
        """The numbers of words, new ones learned. Most are among the few that come again and again."""
        at = np.fromiter(map(self.common.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        rest = [flat[i] for i in missing.tolist()]
        found = np.fromiter(map(self.known.get, rest, repeat(-1)), np.int64, len(rest))
        unseen = np.flatnonzero(found < 0)
        if len(unseen):
            wanted = [rest[i] for i in unseen.tolist()]
            fresh = list(dict.fromkeys(wanted))
            if self.known and len(self.known) + len(fresh) > self.remembered:
                self.clear()
                return self.numbers(flat)
            self.learn(fresh)
            found[unseen] = np.fromiter(map(self.known.__getitem__, wanted), np.int64, len(wanted))
        at[missing] = found
        if not self.common and len(at) > COMMON:
            names = list(self.known)
            self.common = {names[k]: k for k in np.argsort(-np.bincount(at, minlength=len(names)))[:COMMON].tolist()}
        return at

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes, kinds, values, bounds, initial) of the texts' template words, one text after the other.

        ``initial`` has the places of capitalised words that begin a sentence, which may be names.
        """
        cut = [(t or "").split() for t in texts]
        at = self.numbers(list(chain.from_iterable(cut)))
        ends = np.cumsum([len(w) for w in cut], dtype=np.int64)
        inside = np.ones(len(at), bool)
        inside[1:] = ~self.ends[at[:-1]]
        first = np.concatenate([[0], ends[:-1]])
        inside[first[first < len(at)]] = False
        count = self.count[at]
        stops = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(self.start[at] - stops[:-1], count) + np.arange(stops[-1])
        kind, value, code = self.kind[place], self.value[place], self.code[place]
        # A capitalised word has one template word.
        capital = self.capital[at]
        name = stops[np.flatnonzero(capital & inside)]
        kind[name], code[name] = NAME, _PLACEHOLDERS[NAME]
        return code, kind, value, np.concatenate([[0], stops[ends]]), stops[np.flatnonzero(capital & ~inside)]


def windows(codes: np.ndarray, kinds: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of ``n`` template words, and which have enough literal words; the others are hashed with their values."""
    h = rolling(codes, n) + np.uint64(n)
    if not len(h):
        return h, np.empty(0, bool)
    literal = np.concatenate([[0], np.cumsum(kinds == WORD_KIND)])
    good = literal[n:] - literal[:-n] >= min(n, LEAST_WORDS)
    poor = np.flatnonzero(~good)
    if len(poor):
        exact = codes.copy()
        slots = np.flatnonzero(kinds != WORD_KIND)
        exact[slots] = mix(codes[slots] + values[slots] + np.uint64(1))
        h[poor] = mix(rolling_at(exact, n, poor) + np.uint64(n))
    return h, good


def named(codes: np.ndarray, kinds: np.ndarray, initial: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and kinds with the words at these places as names."""
    codes, kinds = codes.copy(), kinds.copy()
    codes[initial], kinds[initial] = _PLACEHOLDERS[NAME], NAME
    return codes, kinds


def both_ways(codes: np.ndarray, kinds: np.ndarray, values: np.ndarray, initial: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, hashes, which are good, kinds) of all windows, then of those that hold a word of ``initial``, as names."""
    h, good = windows(codes, kinds, values, n)
    yield np.arange(len(h)), h, good, kinds
    if len(h) and len(initial):
        codes, kinds = named(codes, kinds, initial)
        some = np.zeros(len(codes) + 1, np.int32)
        some[initial + 1] = 1
        some = np.cumsum(some)
        at = np.flatnonzero(some[n:] > some[:-n])
        h, good = windows(codes, kinds, values, n)
        yield at, h[at], good[at], kinds


def _slots(kinds: np.ndarray, values: np.ndarray, at: int, n: int) -> list[int]:
    """Values of the placeholders of a window, in order; the kind is part of a value."""
    return [int(v) * 4 + int(k) for k, v in zip(kinds[at : at + n], values[at : at + n], strict=True) if k != WORD_KIND]


def _words_in(places: str) -> Column:
    """How many words the windows at these places hold together."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + F.col("size") - 1)))))


_LONGS = pa.list_(pa.int64())


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(hash, item_id, place, size, words, open, slots) of every window; open words of the item are in windows that match with other values."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates()
        for b in batches:
            out: list[tuple] = []
            every = t.of(b.column("text").to_pylist())
            for k, item in enumerate(b.column("item_id").to_pylist()):
                lo, hi = every[3][k], every[3][k + 1]
                codes, kinds, values = (x[lo:hi] for x in every[:3])
                initial = every[4][(every[4] >= lo) & (every[4] < hi)] - lo
                n = min(WINDOW, len(codes))
                if n:
                    free = 0
                    for at, h, good, as_read in both_ways(codes, kinds, values, initial, n):
                        if as_read is kinds:  # as names, the same windows have fewer literal words
                            free = int((np.convolve(good, np.ones(n)) > 0.5).sum())
                        out += [(x, item, i, n, len(codes), free, _slots(as_read, values, i, n)) for i, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), _LONGS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], ["hash", "item_id", "place", "size", "words", "open", "slots"])

    items = with_python(benchmark.select("item_id", "text"))
    return items.mapInArrow(cut, "hash long, item_id long, place long, size long, words long, open long, slots array<long>")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Which top bits occur among the hashes. At most 2 ** (BITMAP - 6) rows come back, whatever the number of hashes."""
    place = F.shiftrightunsigned("hash", 64 - BITMAP)
    words = hashes.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITMAP}) & 63 as int))").alias("b"))
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[r.w] = np.uint64(r.b & 0xFFFFFFFFFFFFFFFF)
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, start, n_windows): where documents hold an item, counted in template words."""
    items = written(item_windows(benchmark))
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # at most WINDOW of them
    sent = docs.sparkSession.sparkContext.broadcast((bitmap(items), sizes))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_kept()
        t, (bits, sizes) = Templates(), sent.value
        for b in rows_of(batches):
            out: list[tuple] = []
            codes, kinds, values, bounds, initial = t.of(b.column("text").to_pylist())
            docs, keys = b.column("doc_id").to_pylist(), b.column("text_key").to_pylist()
            for n in sizes:
                for at, h, _, as_read in both_ways(codes, kinds, values, initial, n):
                    top = h >> np.uint64(64 - BITMAP)
                    maybe = np.flatnonzero(((bits[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1)).astype(bool))
                    met, h = at[maybe], h[maybe].view(np.int64)
                    of = np.searchsorted(bounds, met, side="right") - 1
                    within = met + n <= bounds[of + 1]  # not across the end of a text
                    for i, x, k in zip(met[within].tolist(), h[within].tolist(), of[within].tolist(), strict=True):
                        out.append((docs[k], keys[k], x, i - int(bounds[k]), _slots(as_read, values, i, n)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), _LONGS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], ["doc_id", "text_key", "hash", "at", "found"])

    texts = with_python(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"))
    asked = texts.mapInArrow(look, "doc_id long, text_key long, hash long, at long, found array<long>")
    met = asked.join(items, "hash").withColumn("start", F.col("at") - F.col("place"))
    met = met.filter(F.size("slots") == F.size("found"))
    # A diagonal has at most two matches per place of its item, so these sets are as long as an item at most.
    pairs = F.arrays_zip("slots", "found")
    one = met.groupBy("doc_id", "text_key", "item_id", "start").agg(
        F.count_distinct("place").alias("n_windows"), F.first("words").alias("words"), F.first("size").alias("size"), F.first("open").alias("open"),
        F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("slots") == F.col("found"), F.col("place"))).alias("same"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
    )
    n = F.size("pairs")
    consistent = n == F.size(F.array_distinct("pairs.slots"))
    need = F.greatest(F.col("size"), F.least(F.lit(ENOUGH), F.col("words") - 1))
    # Windows that match with equal values only do not count against an item met with other values.
    bound = F.when(F.col("open") > 0, F.least(need, F.col("open"))).otherwise(need)
    enough = consistent & (_words_in("places") >= bound)
    verbatim = _words_in("same") >= need
    return one.filter(enough | verbatim).select("doc_id", "text_key", "item_id", "start", "n_windows")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, items) of each row: the items a document holds, in order."""
    held = occurrences(docs, benchmark).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    held = held.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "items")
    d = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    out = d.join(held, d["doc_id"].eqNullSafe(held["__id"]) & (d["text_key"] == held["__key"]), "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    held = occurrences(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    met = docs["doc_id"].eqNullSafe(held["__id"]) & (F.xxhash64(docs["text"]) == held["__key"])
    return docs.join(held, met, "left_anti")
