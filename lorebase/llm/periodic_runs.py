"""Periodic runs of words: maximal stretches that repeat with a period, found on harmonic grids with sampled suffixes.

A run of period q is a stretch in which words q apart are the same; where it is long enough, the places x with
words[x] == words[x + q] fill an interval that is at least ``g = max(q, least - q)`` long, so one of them is a multiple
of g. For every q the multiples of g are tried, n/1 + n/2 + ... places in all, and each that agrees is extended
to both sides by longest common extensions.

Longest common extensions compare V words; places that agree in all of them are both in a difference cover modulo V after
fewer, where the two sampled suffixes' common prefix is a minimum in their sorted order, read from a sparse table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import frugal, slices
from lorebase.workers import ship

#: Every difference modulo V is one of two members of COVER.
V, COVER = 13, (0, 1, 3, 9)
#: Grid places tried at once.
PAIRS = 1 << 18
#: Documents up to so many words share their grids in a task.
SHORT = 512

_IN = np.isin(np.arange(V), COVER)
#: Words to compare before places with these remainders are both in the cover.
_AHEAD = np.array([[next(d for d in range(V) if _IN[(a + d) % V] and _IN[(b + d) % V]) for b in range(V)] for a in range(V)])


class Extensions:
    """Longest common extensions to the right of two places of an array of numbers from 0."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        self.words = np.r_[words, np.full(2 * V, -1, words.dtype)]  # no word: differs from all before the end
        self.table: list[np.ndarray] | None = None

    def _sort(self) -> None:
        """Ranks of the sampled suffixes by doubling, common prefixes of neighbours, and their sparse table."""
        n = self.n
        at = np.flatnonzero(np.tile(_IN, n // V + 1)[: n + 1])
        slot = np.full(n + 1, -1, np.int64)
        slot[at] = np.arange(len(at))
        radix = int(self.words.max()) + 2
        key, width, rank = np.zeros(len(at), np.int64), 1, None
        for c in range(V):  # first V words, as many at a time as fit in 62 bits
            if width * radix >= 1 << 62:
                rank = np.unique(key, return_inverse=True)[1]
                key, width = rank, int(rank.max()) + 1
            key, width = key * radix + (self.words[at + c] + 1), width * radix
        ranks, far = [np.unique(key, return_inverse=True)[1]], V
        while int(ranks[-1].max()) + 1 < len(at):
            later = np.where(at + far <= n, slot[np.minimum(at + far, n)], -1)
            after = np.where(later >= 0, ranks[-1][later] + 1, 0)
            ranks.append(np.unique(ranks[-1] * (len(at) + 1) + after, return_inverse=True)[1])
            far *= 2
        self.slot, self.rank = slot, ranks[-1]
        order = np.argsort(self.rank)
        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(len(a), np.int64)
        for k in reversed(range(len(ranks))):
            step = V << k
            x, y = a + common, b + common
            same = (x + step <= n) & (y + step <= n)
            same &= ranks[k][slot[np.minimum(x, n)]] == ranks[k][slot[np.minimum(y, n)]]
            common += step * same
        active = np.arange(len(a))
        while len(active):
            active = active[self.words[a[active] + common[active]] == self.words[b[active] + common[active]]]
            active = active[np.maximum(a[active], b[active]) + common[active] < n]
            common[active] += 1
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` > ``i`` on are the same."""
        out, deep = np.zeros(len(i), np.int64), np.arange(len(i))
        for k in range(V):  # most places differ within a few words, so few documents need their suffixes sorted
            deep = deep[self.words[i[deep] + k] == self.words[j[deep] + k]]
            if not len(deep):
                return out
            out[deep] = k + 1
        ahead = _AHEAD[i[deep] % V, j[deep] % V]
        if self.table is None:
            self._sort()
        a, b = self.rank[self.slot[i[deep] + ahead]], self.rank[self.slot[j[deep] + ahead]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for one in np.unique(level):
            mine, row = level == one, self.table[one]
            out[deep[mine]] = ahead[mine] + np.minimum(row[low[mine]], row[high[mine] - (1 << one)])
        return out


def grid(n: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All places x and periods q to try in n words, about ``PAIRS`` at a time."""
    q = np.arange(1, n // 2 + 1)
    g = np.maximum(q, least - q)
    counts = (n - q + g - 1) // g
    ends = np.cumsum(counts)
    first = 0
    while first < len(q):
        past = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        c = counts[first:past]
        number = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        yield number * np.repeat(g[first:past], c), np.repeat(q[first:past], c)
        first = past


@lru_cache(SHORT)
def _short_grid(n: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return list(grid(n, least))


def _fewest(found: np.ndarray) -> np.ndarray:
    """Of rows start, length, period with the same stretch the one with the smallest period; by start, then length."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)]] if len(found) else found


def runs(words: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows start, length, period of all runs of at least ``max(least, 2 * period)`` numbers, by start, then period.

    A stretch of several periods counts with its smallest: where it has another one that it holds twice, that is a
    multiple and has the same ends.
    """
    n = len(words)
    right, left, found = Extensions(words), None, []
    for x, q in _short_grid(n, least) if n <= SHORT else grid(n, least):
        agree = words[x] == words[x + q]
        x, q = x[agree], q[agree]
        if not len(x):
            continue
        ahead = right(x, x + q)
        left = left or Extensions(words[::-1].copy())
        behind = left(n - x - q, n - x)
        long = ahead + behind >= np.maximum(q, least - q)
        if long.any():
            found.append(_fewest(np.stack([x - behind, ahead + behind + q, q], axis=1)[long]))
    out = _fewest(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def plant(words: list[bytes], seed: int) -> list[bytes]:
    """The words with a repeated passage, from a place and of a length that ``seed`` (the crc32 of the id) says, in every tenth document."""
    n, g = len(words), seed // 10
    if seed % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    passage = words[a : a + p]
    return words[:a] + (passage * ((n - a) // p + 1))[: n - a]


def numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


Row = Callable[[list[bytes], np.ndarray, bytes], tuple]


def _per_document(docs: DataFrame, least: int, planted: bool, shape: str, fields: list[pa.Field], row: Row, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            out = []
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                if planted and key is not None:
                    words = plant(words, zlib.crc32(key.encode()))
                found = runs(numbers(words), least)
                rest = words if not len(found) else [w for w, k in zip(words, kept(len(words), found), strict=True) if k]
                out.append(row(words, found, b" ".join(rest)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(f.name for f in fields)])

    return slim.mapInArrow(frugal(run), f"doc_id {kind}, {shape}")


def collapse_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period in words) and text (the words left, joined by single blanks) of every document.

    Of each run the first period stays. Null texts count as empty and have no runs; equal texts give equal results; repeated
    rows and null ids are kept as they are; other columns are left out; an empty table gives no rows. Documents are
    judged whole, each by itself, so nothing is shuffled.
    """
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    fields = [pa.field("runs", pa.list_(one)), pa.field("text", pa.string())]

    def row(_words: list[bytes], found: np.ndarray, rest: bytes) -> tuple:
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()], rest.decode("utf-8", "replace")

    return _per_document(docs, least, False, "runs array<struct<start:long,length:long,period:long>>, text string", fields, row, id_col, text_col)


def run_digests(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the longest run and digests of all runs and of the words left, over documents with planted passages.

    ``plant`` says which; a null id plants nothing. Cases as in ``collapse_runs``.
    """
    names = ("n_runs", "start", "length", "period", "exponent_milli")
    fields = [pa.field(x, pa.int64()) for x in names] + [pa.field("runs_sha256", pa.string()), pa.field("collapsed_sha256", pa.string())]

    def row(_words: list[bytes], found: np.ndarray, rest: bytes) -> tuple:
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
        start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist() if len(found) else (None, None, None)
        return len(found), start, length, period, None if length is None else 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()

    shape = ", ".join(f"{x} long" for x in names) + ", runs_sha256 string, collapsed_sha256 string"
    return _per_document(docs, least, True, shape, fields, row, id_col, text_col)
