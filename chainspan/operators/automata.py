"""Step matchers that run inside a task over one ordered run.

Each object follows one rule through a stream of batches and keeps only the occurrence it is in the middle of. They
know nothing about Spark; ``matching`` decides which rows they see and with which state they begin.

No matcher looks at rows one by one. Where a step continues is a lookup in the positions of its code, made for all
places an occurrence could begin at in one go. That gives each beginning its end, each end the beginning that comes
next, and from there on only the jumps from one accepted occurrence to the next are followed, by doubling.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_NONE = np.zeros(0, dtype=np.int64)


@dataclass
class Rows:
    """One batch, as the matchers read it. What is looked up for one rule is kept for the others."""

    codes: np.ndarray  # index into the rule set's codes
    bucket: np.ndarray  # running number of bucket starts within the batch; 0 = bucket of the previous batch
    ids: np.ndarray
    ts: np.ndarray
    _at: dict[int, np.ndarray] = field(default_factory=dict, repr=False)
    _before: dict[int, np.ndarray] = field(default_factory=dict, repr=False)

    @property
    def size(self) -> int:
        return len(self.codes)

    def at(self, code: int) -> np.ndarray:
        """The places of a code."""
        if code not in self._at:
            self._at[code] = np.flatnonzero(self.codes == code)
        return self._at[code]

    def before(self, code: int) -> np.ndarray:
        """How many rows of a code come before each place, the end included."""
        if code not in self._before:
            self._before[code] = ranks(self.at(code), self.size)
        return self._before[code]

    def following(self, code: int, place):
        """The first place of a code at or after each given one; the end where there is none."""
        return np.append(self.at(code), self.size)[self.before(code)[place]]

    def bucket_end(self, place):
        """Where the bucket of each place ends."""
        return np.searchsorted(self.bucket, self.bucket[place], side="right")


def ranks(places: np.ndarray, size: int) -> np.ndarray:
    """How many of the (ascending) places come before each of 0..size."""
    marks = np.zeros(size + 1, dtype=np.int32)
    marks[places + 1] = 1
    return np.cumsum(marks, dtype=np.int32)


def follow(after: np.ndarray, first: int) -> np.ndarray:
    """``first``, after[first], after[after[first]], ... as long as inside. ``after`` points forward, past the end to stop.

    Each round follows jumps twice as long as the round before, from all places reached so far.
    """
    n = len(after)
    if first >= n:
        return _NONE
    jump = np.append(np.minimum(after, n), n)
    out = np.array([first])
    while True:
        more = jump[out]
        more = more[more < n]
        done = len(more) < len(out)
        out = np.concatenate([out, more])
        if done:
            return out
        jump = jump[jump]


@dataclass
class Piece:
    """Part of an occurrence that crosses runs, from step ``step0`` on. ``row`` is the batch row it ends at."""

    row: int
    occ: int
    step0: int
    ids: list[int]
    ts: list[int]


@dataclass
class Found:
    """What one rule matched in one batch: whole occurrences as flat arrays, and pieces of occurrences."""

    rows: np.ndarray  # batch row of each occurrence's last event
    ids: np.ndarray  # event ids, occurrence after occurrence
    ts: np.ndarray
    pieces: list[Piece]

    @property
    def size(self) -> int:
        return len(self.rows) + len(self.pieces)


def _found(pieces: list[Piece] | None = None, rows=_NONE, ids=_NONE, ts=_NONE) -> Found:
    return Found(rows, ids, ts, pieces or [])


def _select(rows: Rows, wanted: np.ndarray) -> np.ndarray:
    """Batch rows whose code is wanted."""
    inside = (rows.codes >= 0) & (rows.codes < len(wanted))
    return np.flatnonzero(inside & wanted[np.where(inside, rows.codes, 0)])


class _Starts:
    """All places an occurrence of ``seq`` could begin at in a batch: its steps, whether it ends in its bucket, and the
    beginning to look at next."""

    def __init__(self, rows: Rows, seq: list[int]):
        self.rows = rows
        starts = rows.at(seq[0])
        steps = [starts]
        for code in seq[1:]:
            steps.append(rows.following(code, np.minimum(steps[-1] + 1, rows.size)))
        self.steps = np.stack(steps)
        here = rows.bucket[starts]
        self.whole = np.append(rows.bucket, -1)[self.steps[-1]] == here
        beyond = np.where(self.whole, self.steps[-1] + 1, 0)
        if not self.whole.all():
            # Nothing later in the bucket can finish what this one cannot.
            beyond[~self.whole] = rows.bucket_end(starts[~self.whole])
        self.after = rows.before(seq[0])[beyond]

    def partial(self, start: int) -> np.ndarray:
        """The places of the steps that are there in the bucket of a beginning."""
        steps = self.steps[:, start]
        return steps[np.append(self.rows.bucket, -1)[steps] == self.rows.bucket[steps[0]]]


def _remaining(rows: Rows, seq: list[int], step: int, stop: int) -> list[int]:
    """The places that take up ``seq`` from ``step`` on, before ``stop``."""
    got: list[int] = []
    for code in seq[step:]:
        place = int(rows.following(code, got[-1] + 1 if got else 0))
        if place >= stop:
            break
        got.append(place)
    return got


class SequenceMatcher:
    """Earliest, greedy, non-overlapping occurrences: an event is taken iff its code is the next one wanted.

    ``taken`` is how many events of the bucket earlier runs took. When that is not a multiple of the length, the
    first occurrence began in an earlier run: its pieces carry the same occurrence number and are joined afterwards.
    """

    def __init__(self, seq: list[int], taken: int = 0):
        self.seq = seq
        self.n = len(seq)
        self.wanted = np.zeros(max(seq) + 1, dtype=bool)
        self.wanted[seq] = True
        self.occ, self.step = divmod(taken, self.n)
        self.step0 = self.step  # step of the first event held here
        self.ids: list[int] = []
        self.ts: list[int] = []

    def _reset(self) -> None:
        self.occ = self.step = self.step0 = 0
        self.ids, self.ts = [], []

    def _hold(self, rows: Rows, places) -> None:
        self.ids += rows.ids[places].tolist()
        self.ts += rows.ts[places].tolist()

    def feed(self, rows: Rows) -> Found:
        last = int(rows.bucket[-1])
        pieces: list[Piece] = []
        begin = 0
        if self.step:
            stop = int(np.searchsorted(rows.bucket, 0, side="right"))
            got = _remaining(rows, self.seq, self.step, stop)
            self._hold(rows, got)
            self.step += len(got)
            if self.step == self.n:
                pieces.append(Piece(got[-1], self.occ, self.step0, self.ids, self.ts))
                self.occ += 1
                self.step = self.step0 = 0
                self.ids, self.ts = [], []
                begin = got[-1] + 1
            elif last == 0:
                return _found()
            else:
                begin = stop
        s = _Starts(rows, self.seq)
        path = follow(s.after, int(rows.before(self.seq[0])[begin]))
        whole = path[s.whole[path]]
        ends = s.steps[-1][whole]
        flat = s.steps[:, whole].T.ravel()
        if last:
            self._reset()
        self.occ += int(np.count_nonzero(rows.bucket[ends] == last)) if last else len(ends)
        if path.size and not s.whole[path[-1]] and rows.bucket[s.steps[0, path[-1]]] == last:
            got = s.partial(int(path[-1]))
            self._hold(rows, got)
            self.step, self.step0 = len(got), 0
        return _found(pieces, ends, rows.ids[flat], rows.ts[flat])

    def open_piece(self) -> Found:
        """The unfinished occurrence at the end of the run; a later run may finish it."""
        return _found([Piece(-1, self.occ, self.step0, self.ids, self.ts)] if self.ids else None)


class PairMatcher(SequenceMatcher):
    """``SequenceMatcher`` for two different codes, whole batches at a time.

    With only the two codes left, an event is taken exactly when its code differs from the one before it (a bucket
    begins as if the second code had just been seen).
    """

    def feed(self, rows: Rows) -> Found:
        last_bucket = int(rows.bucket[-1])
        sel = _select(rows, self.wanted)
        if sel.size == 0:
            if last_bucket:
                self._reset()
            return _found()
        is_a = rows.codes[sel] == self.seq[0]
        bucket, ids, ts = rows.bucket[sel], rows.ids[sel], rows.ts[sel]
        fresh = np.empty(sel.size, dtype=bool)
        fresh[0] = bucket[0] != 0
        fresh[1:] = bucket[1:] != bucket[:-1]
        if fresh[0]:
            self._reset()
        prev_a = np.empty(sel.size, dtype=bool)
        prev_a[0] = self.step == 1
        prev_a[1:] = is_a[:-1]
        prev_a[fresh] = False
        taken = np.flatnonzero(is_a != prev_a)
        ends = np.flatnonzero(~is_a[taken])  # positions in ``taken`` that close an occurrence
        pieces = []
        if ends.size and ends[0] == 0:
            # The first code of this occurrence was seen before this batch.
            end = taken[0]
            got_ids, got_ts = self.ids + [int(ids[end])], self.ts + [int(ts[end])]
            pieces.append(Piece(int(sel[end]), self.occ, self.step0, got_ids, got_ts))
            ends = ends[1:]
            self.occ += 1
            self.step = self.step0 = 0
            self.ids, self.ts = [], []
        pairs = np.stack([taken[ends - 1], taken[ends]], axis=1).ravel()
        second = taken[ends]
        final = int(bucket[-1])
        if bool(fresh.any()):
            self._reset()
        self.occ += int(np.count_nonzero(bucket[second] == final))
        if final != last_bucket:
            self._reset()
        elif taken.size and is_a[taken[-1]] and bucket[taken[-1]] == final:
            self.ids, self.ts = [int(ids[taken[-1]])], [int(ts[taken[-1]])]
            self.step, self.step0 = 1, 0
        return _found(pieces, sel[second], ids[pairs], ts[pairs])


class AdvanceCounter:
    """How many events of one bucket are taken, for every state it could begin in."""

    def __init__(self, seq: list[int], starts: int):
        self.seq = seq
        self.n = len(seq)
        self.state = np.arange(starts)
        self.taken = np.zeros(starts, dtype=np.int64)

    def feed(self, codes) -> None:
        if not isinstance(codes, Rows):
            codes = np.asarray(codes, dtype=np.int64)
            codes = Rows(codes, np.zeros(len(codes), dtype=np.int64), codes, codes)
        if codes.size == 0:
            return
        starts = _Starts(codes, self.seq)
        for state in np.unique(self.state).tolist():
            n = self._taken(codes, starts, state)
            at = self.state == state
            self.taken[at] += n
        self.state = (np.arange(len(self.taken)) + self.taken) % self.n

    def _taken(self, rows: Rows, starts: _Starts, state: int) -> int:
        got = _remaining(rows, self.seq, state, rows.size) if state else []
        if state and state + len(got) < self.n:
            return len(got)
        path = follow(starts.after, int(rows.before(self.seq[0])[got[-1] + 1 if got else 0]))
        if not path.size:
            return len(got)
        rest = 0 if starts.whole[path[-1]] else len(starts.partial(int(path[-1])))
        return len(got) + int(np.count_nonzero(starts.whole[path])) * self.n + rest

    def advances(self) -> list[int]:
        return self.taken.tolist()


class _Step:
    """The events of a batch that complete one step of a timed rule, and the chain each of them ends.

    Place -1 is the event before the batch that did so last. ``start`` is where the chain began: a place, or -k for the
    chain that had got to step k - 1 before the batch, so that later beginnings are greater.
    """

    def __init__(self, place, bucket, ts, start, start_ts, back):
        self.place, self.bucket, self.ts = place, bucket, ts
        self.start, self.start_ts, self.back = start, start_ts, back


class TemporalMatcher:
    """Latest-anchored occurrences with bounded gaps.

    A step continues the chain that most recently completed the step before it. Which events complete which step does
    not depend on which occurrences are accepted: chains that begin later also end later, so forgetting all chains after
    an occurrence is the same as keeping them and passing over those that began before its end. So a batch is worked on
    step by step, each step with one lookup per event; the chains that complete the last step are intervals in order, and
    the accepted ones are those reached by jumps from each to the first that begins after it ended.

    What a batch hands on is therefore two things: per step the chain that completed it last, whatever was accepted; and
    how many of these chains began after the last accepted end (``fresh``; they are those of the first steps). ``moves``
    says for every number of fresh chains at the beginning how many there are at the end.
    """

    def __init__(self, seq: list[int], within: int, total: int, begin: list | None = None):
        self.seq = seq
        self.n = len(seq)
        self.within, self.total = within, total
        chains, fresh = begin or (None, None)
        self.chains = [[tuple(e) for e in c] if c else None for c in chains] if chains else [None] * (self.n - 1)
        self.fresh = self.n - 1 if fresh is None else fresh
        self.own = [False] * (self.n - 1)  # whether a chain's last event was fed, not handed in
        self.moves = list(range(self.n))
        self.all_moves = False

    def _steps(self, rows: Rows) -> list[_Step]:
        out: list[_Step] = []
        for s, code in enumerate(self.seq):
            place = rows.at(code)
            if s == 0:
                bucket, ts = rows.bucket[place], rows.ts[place]
                step = _Step(place, bucket, ts, place, ts, place)
            else:
                prev = out[-1]
                inside = prev.place[1:] if prev.place.size and prev.place[0] < 0 else prev.place
                held = len(prev.place) - len(inside)
                back = ranks(inside, rows.size)[place] + (held - 1)
                ok = back >= 0
                place, back = place[ok], back[ok]
                bucket, ts = rows.bucket[place], rows.ts[place]
                ok = (prev.bucket[back] == bucket) & (ts - prev.ts[back] <= self.within)
                if self.total:
                    ok &= ts - prev.start_ts[back] <= self.total
                place, back, bucket, ts = place[ok], back[ok], bucket[ok], ts[ok]
                step = _Step(place, bucket, ts, prev.start[back], prev.start_ts[back], back)
            if s < self.n - 1 and self.chains[s] is not None:
                chain = self.chains[s]
                first = (-1, 0, chain[-1][1], -(s + 1), chain[0][1], -1)
                names = ("place", "bucket", "ts", "start", "start_ts", "back")
                step = _Step(*[np.concatenate([[v], getattr(step, c)]) for c, v in zip(names, first)])
            out.append(step)
        return out

    def _trace(self, rows: Rows, steps: list[_Step], s: int, k: int) -> list[tuple[int, int]]:
        """The chain that the k-th event of step s ends."""
        out: list[tuple[int, int]] = []
        while s >= 0:
            place = int(steps[s].place[k])
            if place < 0:
                return [*self.chains[s], *reversed(out)]
            out.append((int(rows.ids[place]), int(rows.ts[place])))
            k, s = int(steps[s].back[k]), s - 1
        return out[::-1]

    def feed(self, rows: Rows) -> Found:
        last = int(rows.bucket[-1])
        steps = self._steps(rows)
        ends = steps[-1]
        after = np.searchsorted(ends.start, ends.place, side="right")
        # The chains handed on, by where they began; none of an earlier bucket.
        kept = [len(x.place) - 1 if x.place.size and x.bucket[-1] == last else None for x in steps[:-1]]
        began = [int(x.start[k]) if k is not None else None for x, k in zip(steps, kept)]

        def accepted(fresh: int) -> np.ndarray:
            return follow(after, int(np.searchsorted(ends.start, -fresh, side="left")))

        def moved(fresh: int, path: np.ndarray) -> int:
            least = int(ends.place[path[-1]]) + 1 if path.size else -fresh
            return next((s for s, b in enumerate(began) if b is not None and b < least), self.n - 1)

        path = accepted(self.fresh)
        whole = path[1:] if path.size and ends.start[path[0]] < 0 else path
        places = np.empty((self.n, len(whole)), dtype=np.int64)
        k = whole
        for s in range(self.n - 1, -1, -1):
            places[s] = steps[s].place[k]
            k = steps[s].back[k]
        flat = places.T.ravel()
        ids, times = rows.ids[flat], rows.ts[flat]
        if len(whole) < len(path):
            # It began before this batch.
            chain = self._trace(rows, steps, self.n - 1, int(path[0]))
            ids = np.concatenate([np.array([e for e, _ in chain], dtype=np.int64), ids])
            times = np.concatenate([np.array([t for _, t in chain], dtype=np.int64), times])
        if self.all_moves:
            now = [moved(f, accepted(f)) for f in range(self.n)]
            self.moves = [now[m] for m in self.moves]
        self.fresh = moved(self.fresh, path)
        self.own = [k is not None and (own or steps[s].place[k] >= 0) for s, (k, own) in enumerate(zip(kept, self.own))]
        self.chains = [self._trace(rows, steps, s, k) if k is not None else None for s, k in enumerate(kept)]
        return _found(None, ends.place[path], ids, times)

    def summary(self) -> list:
        """The chains of the events fed, and ``moves``."""
        return [[c if own else None for c, own in zip(self.chains, self.own)], self.moves]

    def open_piece(self) -> Found:
        return _found()


class TemporalPairMatcher(TemporalMatcher):
    """``TemporalMatcher`` for two different codes, whole batches at a time.

    The latest first code is the row right before the second one, or no first code has been seen since the last
    occurrence; so a second code matches exactly when the row before it is a first code within the limit.
    """

    def __init__(self, seq: list[int], within: int, total: int, begin: list | None = None):
        super().__init__(seq, within, total, begin)
        self.wanted = np.zeros(max(seq) + 1, dtype=bool)
        self.wanted[seq] = True
        self.touched = False

    def feed(self, rows: Rows) -> Found:
        last_bucket = int(rows.bucket[-1])
        sel = _select(rows, self.wanted)
        if sel.size == 0:
            if last_bucket:
                self.chains = [None]
            return _found()
        self.touched = True
        limit = min(self.within, self.total) if self.total else self.within
        bucket, ids, ts = rows.bucket[sel], rows.ids[sel], rows.ts[sel]
        is_a = rows.codes[sel] == self.seq[0]
        held = self.chains[0]
        if held is not None and bucket[0] == 0:
            # Put the first code seen before this batch in front.
            sel, bucket, is_a = np.insert(sel, 0, -1), np.insert(bucket, 0, 0), np.insert(is_a, 0, True)
            ids, ts = np.insert(ids, 0, held[-1][0]), np.insert(ts, 0, held[-1][1])
        match = is_a[:-1] & ~is_a[1:] & (bucket[1:] == bucket[:-1]) & (ts[1:] - ts[:-1] <= limit)
        second = np.flatnonzero(match) + 1
        pairs = np.stack([second - 1, second], axis=1).ravel()
        open_end = bool(is_a[-1]) and int(bucket[-1]) == last_bucket
        self.chains = [[(int(ids[-1]), int(ts[-1]))] if open_end else None]
        return _found(None, sel[second], ids[pairs], ts[pairs])

    def summary(self) -> list:
        return [self.chains, self.touched]
