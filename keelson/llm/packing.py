"""Packing documents into sequences of a fixed number of tokens by minimum bin slack.

A document longer than a sequence gives whole sequences first; what remains of each document
waits in a window of bounded size. A sequence starts with the longest waiting remainder, then
a subset-sum bitset over the multiset of waiting lengths finds the filling closest to the
capacity, and walking back over the bitsets gives how many remainders of each length it takes.
Where no filling is exact, the next remainder is cut at the gap. At the end of a partition the
last, short sequence is cut into powers of two, which need no padding.

Partitions pack on their own: nothing is shuffled, memory is bounded by the window, and a lost
task repeats its own partition only. Rows of a null or empty text hold just the end id; equal
rows are packed each on its own; an empty table gives no pieces.
"""

from __future__ import annotations

from bisect import insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import codec, tokenizer_path

CAPACITY = 4096
END_ID = 2
#: Tokens that wait at most before sequences are formed, and that stay for a rich choice.
WINDOW_TOKENS = 256 * CAPACITY
TEXTS_AT_ONCE = 256

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how many of each, whose sum is the largest that fits ``room``.

    Bit s of a bitset says that some filling has sum s. A length that occurs m times is added
    in groups of 1, 2, 4, ... so that one shift per group covers every count up to m.
    """
    reach, steps, full = 1, [], 1 << room
    limit = (full << 1) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left:
            take = min(group, left)
            wider = (reach | reach << length * take) & limit
            if wider != reach:
                steps.append((length, take, reach))
                reach = wider
            left -= take
            group *= 2
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:  # this sum needs the group
            chosen[length] += take
            total -= length * take
    return dict(chosen)


class Packer:
    """Forms sequences from pieces (tag, start, ids); ``emit`` gets (tag, start, ids, sequence, offset)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, window: int = WINDOW_TOKENS):
        self.capacity, self.window, self.sequence = capacity, window, first_sequence
        self.waiting: dict[int, list] = defaultdict(list)
        self.lengths: list[int] = []  # distinct, ascending
        self.held = 0
        self.out: list[tuple] = []

    def add(self, tag, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.out.append((tag, start, ids[start : start + self.capacity], self.sequence, 0))
            self.sequence += 1
        if whole < len(ids):
            self._wait((tag, whole, ids[whole:]))
        if self.held > self.window:
            while self.held > self.window // 2:
                self._form()

    def _wait(self, piece: tuple) -> None:
        length = len(piece[2])
        if not self.waiting[length]:
            insort(self.lengths, length)
        self.waiting[length].append(piece)
        self.held += length

    def _take(self, length: int) -> tuple:
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
            self.lengths.remove(length)
        self.held -= length
        return piece

    def _form(self) -> None:
        """One sequence; the longest waiting piece comes first."""
        pieces = [self._take(self.lengths[-1])]
        room = self.capacity - len(pieces[0][2])
        filling = best_filling({n: len(self.waiting[n]) for n in self.lengths if n <= room}, room)
        for length, count in filling.items():
            pieces += [self._take(length) for _ in range(count)]
            room -= length * count
        if room and self.lengths:  # every waiting piece is longer than the gap: cut one
            tag, start, ids = self._take(self.lengths[-1])
            pieces.append((tag, start, ids[:room]))
            self._wait((tag, start + room, ids[room:]))
            room = 0
        if room:
            self._close_in_powers(pieces)
        else:
            self._place(pieces)

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for tag, start, ids in pieces:
            self.out.append((tag, start, ids, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def _close_in_powers(self, pieces: list[tuple]) -> None:
        total, queue = sum(len(p[2]) for p in pieces), pieces[::-1]
        for bit in range(total.bit_length() - 1, -1, -1):
            if not total >> bit & 1:
                continue
            room, part = 1 << bit, []
            while room:
                tag, start, ids = queue.pop()
                part.append((tag, start, ids[:room]))
                if len(ids) > room:
                    queue.append((tag, start + room, ids[room:]))
                room -= len(part[-1][2])
            self._place(part)

    def finish(self) -> None:
        while self.held:
            self._form()

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _packed(path: str, end_id: int, capacity: int, window: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 40, capacity, window)
        encoder, end = codec(path, "word"), np.array([end_id], np.uint32)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = [
                pa.array([t[0] for t, *_ in found], pa.int64()),
                pa.array([s for _, s, *_ in found], pa.int64()),
                pa.array([len(i) for _, _, i, *_ in found], pa.int64()),
                pa.array([i.astype("<u4").tobytes() for _, _, i, *_ in found], pa.binary()),
                pa.array([t[1] for t, *_ in found], pa.int64()),
                pa.array([f[3] for f in found], pa.int64()),
                pa.array([f[4] for f in found], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                ids, counts = encoder.encode(part.column(1).to_pylist())
                ends = np.cumsum(counts)
                for doc_id, lo, hi in zip(part.column(0).to_pylist(), ends - counts, ends):
                    packer.add((doc_id, int(hi - lo) + 1), np.concatenate([ids[lo:hi], end]))
                yield rows(packer.drain())
        packer.finish()
        yield rows(packer.drain())

    return pack


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, window: int = WINDOW_TOKENS
) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packed(path, end_id, capacity, window), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id, length and ids in order of offset; a sequence has at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda ids, part: F.concat(ids, part["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
