"""Periodic runs of words, caught online by catchers over completed power-of-two blocks.

A run is a stretch of words with smallest period p that no neighbouring word extends, at least four periods long.
A period p belongs to the level of the largest power of two b <= p. The stretch's first aligned block of b words
occurs again p and 2p words later, so the catcher over that block sees the run as soon as those words are there.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

EXPONENT, LEAST = 4, 6
# Words that are appended at once, and about as many are held of short documents together.
PIECE = 1 << 18
_FACTOR = 0x9E3779B97F4A7C15
Words = list[bytes]


class _Level:
    """The open catchers over blocks of ``size`` words, and hashes of all windows they still need."""

    def __init__(self, size: int):
        self.size, self.power = size, np.uint64(pow(_FACTOR, size // 2, 1 << 64))
        self.base, self.hashes, self.block = 0, np.empty(0, np.uint64), 0

    def extend(self, lower: _Level) -> None:
        """Hash the windows that the words appended to ``lower`` have completed."""
        half, at = self.size // 2, self.base + len(self.hashes) - lower.base
        ends = lower.hashes[at + half:]
        self.hashes = np.concatenate([self.hashes, lower.hashes[at:at + len(ends)] * self.power + ends])

    def caught(self, closing: bool) -> tuple[np.ndarray, np.ndarray]:
        """Blocks' starts and distances at which the block occurs again and once more, by period and start.

        A catcher closes when it has seen every period of its level, or when the stream ends. The windows
        that follow a block at the level's distances are the next block's places, so one comparison
        per word looks at all of them.
        """
        b, length = self.size, self.base + len(self.hashes)
        last = -(-length // b) if closing else (length - 4 * b + 1) // b + 1
        if last <= self.block:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = self.block * b - self.base
        rows = self.hashes[at:at + (last - self.block + 1) * b]
        rows = np.concatenate([rows, np.zeros((last - self.block + 1) * b - len(rows), np.uint64)]).reshape(-1, b)
        block, shift = np.nonzero(rows[1:] == rows[:-1, :1])
        starts, periods = (block + self.block) * b, shift + b
        self.block = last
        inside = starts + 2 * periods < length
        starts, periods = starts[inside], periods[inside]
        again = self.hashes[starts + periods - self.base] == self.hashes[starts + 2 * periods - self.base]
        starts, periods = starts[again], periods[again]
        order = np.lexsort((starts, periods))
        return starts[order], periods[order]

    def forget(self) -> None:
        """Drop hashes that neither an open catcher nor the next level's windows need."""
        keep = min(self.block * self.size, self.base + len(self.hashes) - self.size)
        if keep > self.base:
            self.hashes, self.base = self.hashes[keep - self.base:], keep


class Catchers:
    """Runs of a stream of word numbers that arrives in pieces. Periods above ``longest`` are not looked for."""

    def __init__(self, longest: int, exponent: int = EXPONENT, least: int = LEAST):
        if exponent < 4:
            raise ValueError("a block and two further occurrences lie in four periods or more")
        self.longest, self.exponent, self.least = longest, exponent, least
        self.words, self.size = np.empty(0, np.int64), 0
        self.levels = [_Level(1 << k) for k in range(max(1, longest).bit_length())]
        self.found: dict[tuple[int, int], int] = {}
        # Per period: start and end of the newest stretch. An end at the stream's end still grows.
        self.newest: dict[int, list[int]] = {}
        self.growing: set[int] = set()
        # Per word: end and period of the run around it that reaches furthest.
        self.reach, self.around = np.empty(0, np.int64), np.empty(0, np.int64)

    def append(self, words: np.ndarray, closing: bool = False) -> None:
        total = self.size + len(words)
        if total > len(self.words):
            room = max(total, 2 * self.size)
            for name, fill in (("words", 0), ("reach", 0), ("around", 1)):
                grown = np.full(room, fill, np.int64)
                grown[:self.size] = getattr(self, name)[:self.size]
                setattr(self, name, grown)
        self.words[self.size:total] = words
        self.size = total
        for period in sorted(self.growing):
            self._grow(period)
        first = self.levels[0]
        scrambled = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTOR)
        first.hashes = np.concatenate([first.hashes, (scrambled ^ (scrambled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)])
        for lower, level in zip(self.levels, self.levels[1:]):
            level.extend(lower)
        for level in self.levels:
            starts, periods = level.caught(closing)
            if len(starts):
                self._squares(level.size, starts, periods)
        for level in self.levels:
            level.forget()

    def runs(self) -> list[tuple[int, int, int]]:
        """Close all catchers; (start, length, period) of every run by start and period."""
        self.append(np.empty(0, np.int64), closing=True)
        for period in list(self.growing):
            self._report(period)
        return sorted((start, end - start, period) for (start, end), period in self.found.items())

    def _squares(self, block: int, starts: np.ndarray, periods: np.ndarray) -> None:
        """Merge squares into runs. Inside a run of period q a square of a multiple of q tells nothing new."""
        new = (starts + periods + block > self.reach[starts]) | (periods % self.around[starts] != 0)
        starts, periods = starts[new], periods[new]
        cuts = np.r_[0, np.flatnonzero(np.diff(periods)) + 1, len(periods)]
        for low, high in zip(cuts.tolist(), cuts[1:].tolist()):
            if low == high or (period := int(periods[low])) > self.longest:
                break
            own, at = starts[low:high], 0
            while at < len(own):
                start = int(own[at])
                known = self.newest.get(period)
                if known is not None and start < known[1] - period:
                    at = int(np.searchsorted(own, known[1] - period))
                elif start + period + block <= self.reach[start] and period % self.around[start] == 0:
                    at += 1
                else:
                    self._catch(start, period)
                    at += 1

    def _same(self, start: int, period: int, step: int) -> int:
        """How many words from ``start`` on, or before it, equal the word a period later: compared in growing pieces."""
        size, done = 16, 0
        while True:
            if step > 0:
                low, high = start + done, min(start + done + size, self.size - period)
            else:
                low, high = max(start - done - size, 0), start - done
            if high <= low:
                return done
            differ = np.flatnonzero(self.words[low:high] != self.words[low + period:high + period])
            if len(differ):
                return done + (int(differ[0]) if step > 0 else high - low - 1 - int(differ[-1]))
            done, size = done + high - low, 2 * size

    def _catch(self, start: int, period: int) -> None:
        after = self._same(start, period, 1)
        if not after:  # equal hashes of unequal words
            return
        before = self._same(start, period, -1)
        self.growing.discard(period)
        self.newest[period] = [start - before, start + after + period]
        self._keep(period)

    def _grow(self, period: int) -> None:
        stretch = self.newest[period]
        more = self._same(stretch[1] - period, period, 1)
        stretch[1] += more
        self._keep(period)

    def _keep(self, period: int) -> None:
        start, end = self.newest[period]
        if end == self.size:
            self.growing.add(period)
        else:
            self.growing.discard(period)
            self._report(period)
        if end - start >= self.exponent * period:
            part = slice(start, end)
            further = self.reach[part] < end
            self.around[part][further] = period
            self.reach[part][further] = end

    def _report(self, period: int) -> None:
        start, end = self.newest[period]
        if end - start >= max(self.least, self.exponent * period):
            self.found[start, end] = min(period, self.found.get((start, end), period))


def runs_of(documents: list[Words], exponent: int = EXPONENT, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, (start, length, period). Documents follow each other in one stream, with a
    word of its own behind each, so that no run goes across."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    catchers = Catchers(max((len(d) for d in documents), default=0) // exponent, exponent, least)
    starts, at, own = [], 0, count(1 << 40)
    waiting: list[np.ndarray] = []
    for words in documents:
        starts.append(at)
        for low in range(0, len(words), PIECE):
            part = words[low:low + PIECE]
            waiting.append(np.fromiter(map(number.__getitem__, part), np.int64, len(part)))
            if len(words) > PIECE:
                catchers.append(np.concatenate(waiting))
                waiting.clear()
        waiting.append(np.array([next(own)]))
        at += len(words) + 1
    if waiting:
        catchers.append(np.concatenate(waiting))
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    found = catchers.runs()
    owners = np.searchsorted(np.array(starts, np.int64), [f[0] for f in found], side="right") - 1
    for owner, (start, length, period) in zip(owners.tolist(), found):
        out[owner].append((start - starts[owner], length, period))
    return out


def collapsed(words: Words, runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by blanks, without those that some run has after its first period."""
    if not runs:
        return b" ".join(words)
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SQL = ("n_words long, runs array<struct<start:long,length:long,period:long>>, "
        "strongest struct<start:long,length:long,period:long>, collapsed string")


def _named(run: tuple[int, int, int]) -> dict[str, int]:
    return dict(zip(("start", "length", "period"), run))


def _strongest(runs: list[tuple[int, int, int]]) -> dict[str, int] | None:
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return None if best is None else _named(best)


def _search(exponent: int, least: int, rewrite: Callable[[object, Words], Words] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Documents of like length share a stream: short ones are not searched for long periods.
        held: dict[int, list[tuple[object, Words]]] = defaultdict(list)
        sizes: dict[int, int] = defaultdict(int)
        kind = None

        def settle(size: int) -> pa.RecordBatch:
            ids, texts = zip(*held.pop(size))
            sizes.pop(size)
            found = runs_of(list(texts), exponent, least)
            return pa.record_batch([
                pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[_named(r) for r in runs] for runs in found], pa.list_(_RUN)),
                pa.array([_strongest(runs) for runs in found], _RUN),
                pa.array([collapsed(t, runs).decode() for t, runs in zip(texts, found)], pa.string()),
            ], names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                words = words if rewrite is None else rewrite(doc_id, words)
                size = len(words).bit_length()
                held[size].append((doc_id, words))
                sizes[size] += len(words) + 1
                if sizes[size] >= PIECE:
                    yield settle(size)
        for size in list(held):
            yield settle(size)

    return run


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, text: str = "text", doc_id: str = "doc_id",
                  rewrite: Callable[[object, Words], Words] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, strongest, collapsed`` for every row of ``docs``, repeated rows and null ids included.

    Words are runs of characters other than ASCII white space, numbered from 0, as they are written. ``runs``
    are all maximal stretches of ``least`` words and ``exponent`` (4 or more) smallest periods at
    least, by start and period; ``strongest`` is that of the greatest exact length over period (ties: smallest
    start, then period), null if there is none. ``collapsed`` has the words, joined by single blanks, that
    no run holds after its first period. A null or empty text has no word. ``rewrite`` may change the
    words of a row first. Other columns are not read. An empty table gives no rows.

    Nothing is shuffled; a task holds up to about 20 streams of a quarter of a million words, or one longer document.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_search(exponent, least, rewrite), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_SQL}")


def repeat_tail(doc_id: object, words: Words) -> Words:
    """For about every tenth id the words from some place on repeat with some period; both follow from the id."""
    hashed = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    rest, size = hashed // 10, len(words)
    if hashed % 10 or not size:
        return words
    start = rest % size
    period = 1 + (size - start) // (3 + rest % 8)
    unit = words[start:start + period]
    return words[:start] + (unit * -(-(size - start) // period))[:size - start]


def digests(found: DataFrame) -> DataFrame:
    """One row per document with its strongest run and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
