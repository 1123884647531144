"""Periodic runs of words: stretches that repeat one unit four times or more.

Suffixes of a document's words are sorted and joined with their neighbours in order of falling
common prefix, as Kruskal joins edges: when the classes of two suffixes meet at common prefix l,
every position of the smaller class is put into the ordered set of the larger one, and a position
that becomes its neighbour there at a distance d of at most l shares l words with it, so that
d is a period of the d + l words from the earlier one on, and no longer stretch to the right has it.

The first position of a run of smallest period q and the position q later meet in this way and
no position lies between them, because their class at that moment holds only places where the
unit begins, and a unit that is no power does not begin inside two copies of itself. So every run
is seeded from its first word, and the smallest start for each period and end is the run. A run
of at least four units has a common prefix of at least three, five words or more in all, so edges
of fewer words are left out and a document in which no five words recur is not sorted at all.

Defined results: a null or empty text has no words and no runs; equal rows give equal results; a
null id changes nothing. Columns of the input other than the id and the text do not reach the
result, so their names cannot clash. Rows never leave their task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 6
LEAST_UNITS = 4
NAMES = ("start", "length", "period")
RUN = "struct<start: long, length: long, period: long>"

#: A change to a document's words before they are searched, from its id.
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def numbered(words: Sequence[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def recurs(ids: np.ndarray, width: int) -> bool:
    """Whether ``width`` numbers in a row may occur twice; never false when they do."""
    count = len(ids) - width + 1
    if count < 2:
        return False
    mixed = np.zeros(count, np.uint64)
    for i in range(width):
        mixed = (mixed ^ ids[i : i + count].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def sorted_suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order and, for each but the first, the words it shares with the one before it."""
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
    while True:
        rank, step = ranks[-1].astype(np.int64), 1 << (len(ranks) - 1)
        later = np.zeros(n, np.int64)
        later[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        finer = np.empty(n, np.int32)
        finer[order] = np.cumsum(fresh) - 1
        if fresh.all():
            break
        ranks.append(finer)
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    # Equal ranks of a level mean that many equal words; the levels are tried from the longest down.
    for level in range(len(ranks) - 1, -1, -1):
        inside = (left < n) & (right < n)
        inside[inside] = ranks[level][left[inside]] == ranks[level][right[inside]]
        width = inside.astype(np.int64) << level
        shared, left, right = shared + width, left + width, right + width
    return order, shared


def seeds(ids: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, period, end) of periodic stretches, every run's first word among the starts; common
    prefixes under ``least`` words are left out."""
    order, shared = sorted_suffixes(ids)
    edges = np.flatnonzero(shared >= least)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    places, sizes = order.tolist(), shared.tolist()
    owner: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def root(slot: int) -> int:
        if slot not in owner:
            owner[slot], members[slot] = slot, [places[slot]]
        while owner[slot] != slot:
            owner[slot] = owner[owner[slot]]
            slot = owner[slot]
        return slot

    for edge in edges.tolist():
        size, big, small = sizes[edge], root(edge), root(edge + 1)
        if len(members[big]) < len(members[small]):
            big, small = small, big
        owner[small] = big
        held, moved = members[big], members.pop(small)
        # Neighbours from one class were neighbours before and share more words, so only those from both count.
        for last, place, following in zip([-1, *moved], moved, [*moved[1:], len(ids)]):
            at = bisect_left(held, place)
            if at and held[at - 1] != last and place - held[at - 1] <= size:
                yield held[at - 1], place - held[at - 1], place + size
            if at < len(held) and held[at] < following and held[at] - place <= size:
                yield place, held[at] - place, held[at] + size
            held.insert(at, place)


def runs_of(words: Sequence[bytes], least_words: int = LEAST_WORDS, least_units: int = LEAST_UNITS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    if least_units < 2:
        raise ValueError("a run has two units at least")
    # A run of period q has a first common prefix of its length less q words.
    least = max(1, min(max(least_words, least_units * q) - q for q in range(1, least_words + 1)))
    if len(words) < least_words or len(set(words)) == len(words):
        return []
    ids = numbered(words)
    if not recurs(ids, least):
        return []
    first: dict[tuple[int, int], int] = {}
    for start, period, end in seeds(ids, least):
        if start < first.get((period, end), end):
            first[period, end] = start
    return sorted((start, end - start, period) for (period, end), start in first.items() if end - start >= max(least_words, least_units * period))


def strongest(runs: Sequence[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length in units; ties go to the smaller start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: Sequence[bytes], runs: Iterable[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first unit."""
    kept, at = [], 0
    for lo, hi in sorted((start + period, start + length) for start, length, period in runs):
        if hi > at:
            kept.extend(words[at : max(at, lo)])
            at = hi
    return [*kept, *words[at:]]


def _detect(rewrite: Rewrite | None, least_words: int, least_units: int):
    def batches_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, best, texts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if rewrite:
                    words = rewrite(doc, words)
                runs = runs_of(words, least_words, least_units)
                found.append([dict(zip(NAMES, run)) for run in runs])
                best.append(dict(zip(NAMES, strongest(runs))) if runs else None)
                texts.append(b" ".join(collapsed(words, runs)))
            kind = pa.struct([(name, pa.int64()) for name in NAMES])
            columns = [batch.column(0), pa.array(found, pa.list_(kind)), pa.array(best, kind), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "strongest", "collapsed"])

    return batches_of


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None, least_words: int = LEAST_WORDS, least_units: int = LEAST_UNITS) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), the strongest of them and the
    collapsed text of every row. ``rewrite`` changes a document's words, given its id, before the search."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_detect(rewrite, least_words, least_units), f"doc_id long, runs array<{RUN}>, strongest {RUN}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted_tail(doc: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by the checksum of its id, gets a tail that repeats some of its own words."""
    if doc is None or not words:
        return words
    draw, n = zlib.crc32(str(doc).encode()), len(words)
    if draw % 10:
        return words
    rest = draw // 10
    start = rest % n
    period = 1 + (n - start) // (3 + rest % 8)
    return [*words[:start], *(words[start + (i - start) % period] for i in range(start, n))]
