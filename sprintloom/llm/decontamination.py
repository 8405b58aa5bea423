"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are brought to one form: lower case, one blank for every run of other than
letters and digits. An item occurs in a text if a part of the text is within the item's edit
budget. By the q-gram lemma such a part shares at least m + 1 - q (k + 1) q-grams with an item of
m characters and budget k, and they lie on at most k + 1 neighbouring diagonals. So shared q-grams are
counted in diagonal bands that overlap by the largest budget, only bands that reach the item's bound are
kept, and those are verified by banded alignment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sprintloom.llm.common import Shipped, worker_cache

Q = 10
EDIT_SHARE = 0.06
# Characters of benchmark text that are collected and broadcast at once; more come in further passes.
BLOCK_CHARS = 8_000_000
_GROUP_CHARS = 1 << 21
_BASE = np.uint32(0x9E3779B1)
_FILTER_BITS = 22
_BOUNDARY = 1
_HIT = "array<struct<item_id: long, start: long, end: long, edits: int, shared_qgrams: int>>"


def _forms() -> np.ndarray:
    """For each code point its lower case if that is one character, else itself; 0 unless letter or digit."""
    cache = worker_cache("decontamination")
    if "forms" not in cache:
        low = (c.lower() if len(c.lower()) == 1 else c for c in map(chr, range(0x110000)))
        cache["forms"] = np.array([ord(x) if x.isalnum() else 0 for x in low], np.uint32)
    return cache["forms"]


def normal_forms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in normal form, boundaries between them, and each one's place in
    the joined texts."""
    codes = _codes("\n".join(texts))
    forms = _forms()[codes]
    forms[np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64) - 1] = _BOUNDARY
    letter = forms > _BOUNDARY
    keep = forms > 0
    keep[1:] |= letter[:-1]
    place = np.flatnonzero(keep)
    out = forms[place]
    out[out == 0] = 32
    return out, place


def normal_form(text: str | None) -> str:
    """Lower case, one blank for each run of other than letters and digits, none at either end."""
    return _text(normal_forms([text or ""])[0]).strip()


def budget(chars: int, q: int = Q, share: float = EDIT_SHARE) -> int:
    """Edits that an item of ``chars`` characters may suffer: its share, but at most what leaves the
    q-gram lemma a bound of one or more."""
    return max(0, min(int(share * chars), (chars + 1 - q - 1) // q))


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit polynomial hash of every q-gram, by doubling the length hashed. Chance collisions can
    only add candidates, which alignment then refuses."""
    power, part, length, result, done = _BASE, codes.astype(np.uint32), 1, None, 0
    with np.errstate(over="ignore"):
        while q:
            if q & 1:
                size = len(codes) - done - length + 1
                result = part[:size] if result is None else result[:size] * power + part[done:done + size]
                done += length
            q >>= 1
            if q:
                size = len(codes) - 2 * length + 1
                part = part[:size] * power + part[length:length + size]
                length, power = 2 * length, power * power
        return result * _BASE


@dataclass
class Index:
    """A block of benchmark items and the hashes of their q-grams in runs: ``length`` neighbouring places of an item,
    from ``place`` on, that have the same hash. Runs are sorted by hash."""

    q: int
    ids: list
    items: list[str]
    budgets: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    length: np.ndarray
    present: np.ndarray
    short: list[int]

    @property
    def band(self) -> int:
        """Band width: a power of two of at least twice the largest budget."""
        return 1 << max(4, int(2 * max(1, self.budgets.max(initial=0)) - 1).bit_length())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def index(items: list[tuple[int | None, str]], q: int = Q, share: float = EDIT_SHARE) -> Index:
    """Items are (id, normal form). Empty ones never match. Those shorter than q are searched for exactly."""
    items = [(i, t) for i, t in items if t]
    long = [n for n, (_, t) in enumerate(items) if len(t) >= q]
    hashes = [qgram_hashes(_codes(items[n][1]), q) for n in long]
    owner = np.repeat(np.array(long, np.int64), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes]) if long else np.empty(0, np.int64)
    joined = np.concatenate(hashes) if long else np.empty(0, np.uint32)
    first = np.flatnonzero(np.r_[True, (joined[1:] != joined[:-1]) | (place[1:] != place[:-1] + 1)]) if len(joined) else np.empty(0, np.int64)
    length = np.diff(np.r_[first, len(joined)])
    order = np.argsort(joined[first], kind="stable")
    budgets = np.array([budget(len(t), q, share) for _, t in items], np.int64)
    sizes = np.array([len(t) for _, t in items], np.int64)
    present = np.zeros(1 << _FILTER_BITS, bool)
    present[joined >> np.uint32(32 - _FILTER_BITS)] = True
    return Index(q, [i for i, _ in items], [t for _, t in items], budgets, sizes + 1 - q * (budgets + 1),
                 joined[first][order], owner[first][order], place[first][order], length[order], present,
                 [n for n, (_, t) in enumerate(items) if len(t) < q])


def banded_alignment(item: np.ndarray, text: np.ndarray, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """The best alignment of the whole item with a part of ``text`` on diagonals ``first`` to ``last`` (text
    position less item position): (edits, start, end), or None above ``most`` edits. Of equal ones
    the earliest end counts. Cells off the band or the text cost too much to be used."""
    width, big = last - first + 1, most + 1
    steps = np.arange(width)
    column = first + steps
    cost = np.where((column >= 0) & (column <= len(text)), 0, big)
    begin = column.copy()
    padded = np.full(len(text) + 2, 0xFFFFFFFF, np.uint32)
    padded[1:-1] = text
    for row in range(1, len(item) + 1):
        end = first + row + steps
        inside = (end >= 0) & (end <= len(text))
        letters = padded[np.clip(end, 0, len(text) + 1)]
        diagonal = cost + ((letters != item[row - 1]) | (end < 1))
        above, above_begin = np.append(cost[1:], big) + 1, np.append(begin[1:], 0)
        take = above < diagonal
        best, best_begin = np.where(take, above, diagonal), np.where(take, above_begin, begin)
        best = np.where(inside, best, big)
        # Left neighbours: a running minimum of cost less position gives the cheapest run of insertions.
        key = (best - steps) * (width + 1) + steps
        source = np.minimum.accumulate(key) % (width + 1)
        cost = np.where(inside, np.minimum(best[source] + steps - source, big), big)
        begin = best_begin[source]
        if cost.min() > most:
            return None
    at = int(np.argmin(cost))
    return (int(cost[at]), int(begin[at]), first + len(item) + at) if cost[at] <= most else None


# Entries of bands that are written out at once.
_SLICE = 1 << 20


def _bands(found: Index, joined: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (text, item, band) and how many q-grams they share, for bands that share any.

    A place in a text and a run of places in an item share a stretch of diagonals, so they add to a band the part of the stretch
    that lies in it: one entry for each band, not for each pair of places. The entries are
    written out in slices, so memory does not grow with texts and items that repeat themselves.
    """
    hashes = qgram_hashes(joined, found.q)
    at = np.flatnonzero(found.present[hashes >> np.uint32(32 - _FILTER_BITS)])
    low = np.searchsorted(found.hashes, hashes[at], "left")
    times = np.searchsorted(found.hashes, hashes[at], "right") - low
    at, low, times = at[times > 0], low[times > 0], times[times > 0]
    band, most = found.band, int(found.budgets.max(initial=0))
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    span = (2 * (len(joined) + int(found.bounds.max(initial=0)) + 1) + found.q * (most + 1)) // band + 4
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        nonlocal keys, sums
        every = np.concatenate([keys, *(k for k, _ in waiting)])
        keys, where = np.unique(every, return_inverse=True)
        sums = np.bincount(where, np.concatenate([sums, *(s for _, s in waiting)]), len(keys)).astype(np.int64)
        waiting.clear()

    runs_before = np.cumsum(times)
    done = 0
    while done < len(at):
        stop = max(done + 1, int(np.searchsorted(runs_before, (runs_before[done - 1] if done else 0) + _SLICE, "right")))
        some = slice(done, stop)
        done = stop
        n = times[some]
        run = np.repeat(low[some] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        place = np.repeat(at[some], n)
        doc = np.searchsorted(starts, place, "right") - 1
        highest = place - starts[doc] - found.place[run]
        lowest = highest - found.length[run] + 1
        first, last = (lowest - most) // band, highest // band
        entries = np.cumsum(last - first + 1)
        begun = 0
        while begun < len(run):
            end = max(begun + 1, int(np.searchsorted(entries, (entries[begun - 1] if begun else 0) + _SLICE, "right")))
            part = slice(begun, end)
            begun = end
            many = (last - first + 1)[part]
            slot = np.repeat(first[part] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            owner, text = np.repeat(found.owner[run[part]], many), np.repeat(doc[part], many)
            inside = (np.minimum(np.repeat(highest[part], many), slot * band + band + most - 1)
                      - np.maximum(np.repeat(lowest[part], many), slot * band) + 1)
            own = (text * len(found.items) + owner) * span + slot + span // 2
            own, where = np.unique(own[inside > 0], return_inverse=True)
            waiting.append((own, np.bincount(where, inside[inside > 0], len(own)).astype(np.int64)))
            if sum(len(k) for k, _ in waiting) > 4 * _SLICE:
                merge()
    merge()
    pair, slot = np.divmod(keys, span)
    return np.stack([*np.divmod(pair, max(1, len(found.items))), slot - span // 2], 1), sums


def find(found: Index, texts: list[str]) -> list[list[tuple]]:
    """For each text the items that occur in it: (item number, start, end, edits, shared q-grams), the best
    place of each item, as character offsets of the text as given."""
    hits: list[list[tuple]] = [[] for _ in texts]
    if not texts:
        return hits
    joined, origin = normal_forms(texts)
    given = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts = np.r_[0, np.flatnonzero(joined == _BOUNDARY) + 1, len(joined) + 1]

    def add(d: int, n: int, start: int, end: int, edits: int, shared: int) -> None:
        spot = origin[starts[d] + start:starts[d] + end]
        hits[d].append((n, int(spot[0] - given[d]), int(spot[-1] + 1 - given[d]), edits, shared) if len(spot) else (n, 0, 0, edits, shared))

    for d in range(len(texts)) if found.short else ():
        text = f" {_text(joined[starts[d]:starts[d + 1] - 1])} "
        for n in found.short:
            at = text.find(f" {found.items[n]} ")
            if at >= 0:
                add(d, n, at, at + len(found.items[n]), 0, 0)
    if not len(found.hashes) or len(joined) < found.q:
        return hits
    bands, counts = _bands(found, joined, starts)
    band, most = found.band, int(found.budgets.max(initial=0))
    enough = counts >= found.bounds[bands[:, 1]]
    best: dict[tuple[int, int], tuple] = {}
    for (d, n, s), count in zip(bands[enough].tolist(), counts[enough].tolist()):
        if (d, n) in best and best[d, n][0] == 0:
            continue
        size, first, last = len(found.items[n]), s * band, s * band + band + most - 1
        left = max(0, first)
        right = max(left, min(int(starts[d + 1] - 1 - starts[d]), last + size))
        part = joined[starts[d] + left:starts[d] + right]
        exact = _text(part).find(found.items[n])
        if exact >= 0:
            result = (0, exact, exact + size)
        else:
            result = banded_alignment(_codes(found.items[n]), part, first - left, last - left, int(found.budgets[n]))
        if result:
            result = (result[0], result[1] + left, result[2] + left, count)
            if (d, n) not in best or result[:3] < best[d, n][:3]:
                best[d, n] = result
    for (d, n), (edits, start, end, count) in sorted(best.items()):
        add(d, n, start, end, edits, count)
    return hits


def occurrences(found: Index, text: Column, spark) -> Column:
    """Array of the items that occur in each whole text, with character offsets in the text as given."""
    shared = Shipped(spark, "decontamination", found)

    @F.pandas_udf(_HIT)
    def of(texts: pd.Series) -> pd.Series:
        own, out, group, chars = shared.value, [], [], 0

        def flush() -> None:
            out.extend([(own.ids[n], *rest) for n, *rest in hits] for hits in find(own, group))

        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars > _GROUP_CHARS:
                flush()
                group, chars = [], 0
        flush()
        return pd.Series([[dict(zip(("item_id", "start", "end", "edits", "shared_qgrams"), h)) for h in hits] for hits in out],
                         dtype=object)

    return of(text)


def benchmark_blocks(benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, text: str = "text",
                     item_id: str = "item_id", block_chars: int = BLOCK_CHARS) -> list[Index]:
    """The benchmark as indexes of at most about ``block_chars`` characters each.

    The size is measured first; each block is collected by itself and bounds what is broadcast."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).dropna(subset=["text"]).distinct()
    chars = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = 1 + chars // block_chars
    part = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    return [index(sorted(((r.id, normal_form(r.text)) for r in items.filter(part == b).collect()),
                         key=lambda x: (x[1], x[0] is None, x[0] or 0)), q, share) for b in range(blocks)]


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, item_id, start, end, edits, shared_qgrams``: a row for each document and item it holds.

    Offsets are characters of the text as given; of several places the one with the fewest edits, then the
    first. Null and empty texts hold nothing and items without a letter or digit are never held.
    Repeated documents give repeated rows, repeated benchmark rows count once. Other columns
    are not read. No shuffle takes place: every task holds a block of the benchmark's index.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    for found in benchmark_blocks(benchmark, q, share):
        part = rows.select("doc_id", F.explode(occurrences(found, F.col("text"), spark)).alias("h")).select("doc_id", "h.*")
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns stay as they were."""
    for found in benchmark_blocks(benchmark, q, share):
        docs = docs.filter(F.size(occurrences(found, F.col(text), docs.sparkSession)) == 0)
    return docs
