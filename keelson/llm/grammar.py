"""Token-id files compressed by Re-Pair grammars.

Documents are range-partitioned by id and encoded; every partition writes shards of about
``SHARD_TOKENS`` ids. Inside a shard, frequent pairs of neighbouring symbols are replaced by
nonterminals, round after round, until no pair is frequent; pairs never reach across the end of
a document. A shard is one Parquet row of binary columns:

* ``rules``: left and right symbol of each nonterminal, unsigned 32-bit little-endian;
* ``spans``: the expansion length of each nonterminal;
* ``symbols``: the compressed sequence; ``cuts``: where each document begins in it;
* ``doc_ids``, ``doc_tokens``: the documents of the shard, in order of id.

With the spans, any token range of a document is found and expanded without the rest of the
shard (``decode_range``). A round replaces many pairs at once: where chosen pairs overlap, the
more frequent one wins, and of a run every second one. A pair's count is that of its occurrences
that do not overlap, and only pairs that the last round made or left over are counted again.

Defined results: a null or empty text is the end id alone; documents of equal id stay separate
rows, next to each other in the order of their texts; null ids come first; an empty table writes
no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, scratch_path
from .tokens import codec, tokenizer_path

END_ID = 0
FIRST_NONTERMINAL = 1 << 17
SHARD_TOKENS = 1 << 20
#: A pair gets a rule from this many occurrences in a shard.
LEAST_PAIRS = 2
PAIRS_A_ROUND = 1 << 14
#: Bytes of text that are encoded together; a longer text is encoded alone.
BYTES_AT_ONCE = 8 << 20

SHARD = "part long, shard long, start_in_part long, n_tokens long, n_docs long, doc_ids binary, id_nulls binary, doc_tokens binary, cuts binary, rules binary, spans binary, symbols binary"


#: Most bits of the table that finds candidate pairs; two pairs in one slot wait for another round.
SLOT_BITS = 20


def frequent_pairs(keys: np.ndarray, least: int) -> np.ndarray:
    """The keys that occur ``least`` times or more, commonest first."""
    ordered = np.sort(keys)
    if not len(ordered):
        return ordered
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(edge, len(ordered)))
    often = np.flatnonzero(counts >= least)
    often = often[np.argsort(-counts[often], kind="stable")]
    return ordered[edge[often]]


def slot_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def overlapping(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in ``at`` of the pairs that overlap one before them: in a run of one symbol, every second pair."""
    again = np.flatnonzero(keys[1:] == keys[:-1]) + 1
    again = again[at[again] == at[again - 1] + 1]
    if not len(again):
        return again
    starts = np.concatenate([[True], again[1:] != again[:-1] + 1])
    begin = np.maximum.accumulate(np.where(starts, again, 0))
    return again[(again - begin) % 2 == 0]


def not_overlapping(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs at ascending positions to replace: the lowest rank first, none beside another one."""
    taken = np.zeros(len(at), bool)
    left = np.arange(len(at))
    while len(left):
        where, order = at[left], rank[left]
        beside = where[1:] == where[:-1] + 1
        best = np.ones(len(left), bool)
        best[1:] &= ~beside | (order[1:] < order[:-1])
        best[:-1] &= ~beside | (order[:-1] < order[1:])
        taken[left[best]] = True
        gone = best.copy()
        gone[1:] |= beside & best[:-1]
        gone[:-1] |= beside & best[1:]
        left = left[~gone]
    return taken


def compress(ids: np.ndarray, last: np.ndarray, first: int = FIRST_NONTERMINAL, least: int = LEAST_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, which of them end a document, and the rules (n x 2). ``last`` marks each document's final id."""
    symbols, last, rules = ids.astype(np.uint32), last.copy(), []
    made = 0
    # A pair's count never grows, so a pair that is not frequent is never looked at again.
    open_ = ~last
    open_[-1:] = False
    while True:
        at = np.flatnonzero(open_)
        keys = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1]
        second = overlapping(at, keys)
        pairs = frequent_pairs(np.delete(keys, second) if len(second) else keys, least)
        if not len(pairs):
            break
        bits = max(8, min(SLOT_BITS, 2 + len(at).bit_length()))
        # The commonest pair of a slot is written last.
        table = np.full(1 << bits, -1, np.int32)
        table[slot_of(pairs, bits)[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
        guess = table[slot_of(keys, bits)]
        known = guess >= 0
        open_[at[~known]] = False
        known &= guess < PAIRS_A_ROUND
        known[second] = False
        now = np.flatnonzero(known)
        now = now[pairs[guess[now]] == keys[now]]
        at, rank = at[now], guess[now]
        taken = not_overlapping(at, rank)
        # Commoner pairs may have left too few of a pair; the commonest one keeps all.
        counts = np.bincount(rank[taken], minlength=len(pairs))
        taken &= counts[rank] >= least
        at, rank = at[taken], rank[taken]
        used = np.flatnonzero(counts >= least)
        number = np.zeros(len(pairs), np.uint32)
        number[used] = first + made + np.arange(len(used))
        rules.append(np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], 1))
        symbols[at] = number[rank]
        made += len(used)
        last[at] = last[at + 1]
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        open_[at] = True
        open_[np.maximum(at, 1) - 1] = True
        symbols, last, open_ = symbols[kept], last[kept], open_[kept]
        open_ &= ~last
        open_[-1] = False
    rows = np.concatenate(rules) if rules else np.empty((0, 2), np.uint64)
    return symbols, last, rows.astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, first: int = FIRST_NONTERMINAL, spans: np.ndarray | None = None) -> np.ndarray:
    """The ids of the symbols; each nonterminal writes to where the spans before it end.

    Of more symbols than there are rules, each distinct one is expanded once and copied to its places.
    """
    spans = spans_of(rules, first) if spans is None else spans
    if len(symbols) > len(rules) > 0:
        return _expand_many(symbols, rules, first, spans)
    rules = rules.astype(np.int64)
    length = lambda s: np.where(s < first, 1, spans[np.maximum(s - first, 0)]) if len(spans) else np.ones(len(s), np.int64)
    symbols = symbols.astype(np.int64)
    lengths = length(symbols)
    ends = np.cumsum(lengths)
    at, out = ends - lengths, np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    while len(symbols):
        plain = symbols < first
        out[at[plain]] = symbols[plain]
        at, rule = at[~plain], symbols[~plain] - first
        left, right = rules[rule, 0], rules[rule, 1]
        symbols, at = np.concatenate([left, right]), np.concatenate([at, at + length(left)])
    return out


def _expand_many(symbols: np.ndarray, rules: np.ndarray, first: int, spans: np.ndarray) -> np.ndarray:
    nested = np.flatnonzero(symbols >= first)
    rule = symbols[nested].astype(np.int64) - first
    used = np.zeros(len(rules), bool)
    used[rule] = True
    once = np.flatnonzero(used)
    ends = np.cumsum(spans[once])
    # Plain symbols are kept behind the expansions, where each is its own.
    held = np.concatenate([expand(once + first, rules, first, spans), symbols.astype(np.uint32)])
    starts = np.zeros(len(rules), np.int64)
    starts[once] = ends - spans[once]
    begin, lengths = np.arange(len(held) - len(symbols), len(held)), np.ones(len(symbols), np.int64)
    begin[nested], lengths[nested] = starts[rule], spans[rule]
    at = np.cumsum(lengths)
    places = np.repeat(begin - at + lengths, lengths)
    places += np.arange(len(places))
    return held[places]


def spans_of(rules: np.ndarray, first: int = FIRST_NONTERMINAL) -> np.ndarray:
    """Expansion lengths; a rule names earlier rules only, so one pass per nesting level is enough."""
    spans = np.zeros(len(rules), np.int64)
    inner = rules.astype(np.int64) - first
    missing = np.arange(len(rules))
    while len(missing):
        some = inner[missing]
        known = np.where(some < 0, 1, spans[np.maximum(some, 0)])
        ready = (known > 0).all(1)
        spans[missing[ready]] = known[ready].sum(1)
        missing = missing[~ready]
    return spans


class Shard:
    """A shard's row, opened for reading."""

    def __init__(self, row: dict, first: int = FIRST_NONTERMINAL):
        self.first = first
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.spans = np.frombuffer(row["spans"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], "<u4")
        self.cuts = np.frombuffer(row["cuts"], "<u4").astype(np.int64)
        self.doc_tokens = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)

    def document(self, n: int) -> np.ndarray:
        return expand(self.symbols[self.cuts[n] : self.cuts[n + 1]], self.rules, self.first, self.spans)

    def decode_range(self, n: int, start: int, length: int) -> np.ndarray:
        """Ids [start, start + length) of the n-th document, expanding only the symbols that hold them."""
        symbols = self.symbols[self.cuts[n] : self.cuts[n + 1]].astype(np.int64)
        nested = symbols >= self.first
        lengths = np.where(nested, self.spans[np.where(nested, symbols - self.first, 0)] if len(self.spans) else 1, 1)
        ends = np.cumsum(lengths)
        lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left") + 1
        skipped = ends[lo] - lengths[lo] if lo < len(ends) else 0
        return expand(symbols[lo:hi], self.rules, self.first, self.spans)[start - skipped : start - skipped + length]


def _shard_row(part: int, shard: int, start: int, doc_ids: list, counts: list[int], ids: np.ndarray) -> dict:
    ends = np.cumsum(counts)
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    symbols, last, rules = compress(ids, last)
    u4 = lambda a: np.ascontiguousarray(a, "<u4").tobytes()
    return {
        "part": part, "shard": shard, "start_in_part": start, "n_tokens": len(ids), "n_docs": len(counts),
        "doc_ids": np.array([x or 0 for x in doc_ids], "<i8").tobytes(), "id_nulls": bytes(x is None for x in doc_ids),
        "doc_tokens": u4(counts), "cuts": u4(np.concatenate([[0], np.flatnonzero(last) + 1])),
        "rules": u4(rules), "spans": u4(spans_of(rules)), "symbols": u4(symbols),
    }


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in SHARD.split(", "))])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``BYTES_AT_ONCE`` of text, or of one text."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BYTES_AT_ONCE, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _write_shards(path: str, end_id: int, shard_tokens: int):
    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = codec(path, "blank"), np.array([end_id], np.uint32)
        part, shard, start, held = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids, counts, pieces = [], [], []

        def close() -> pa.RecordBatch:
            row = _shard_row(part, shard, start, doc_ids, counts, np.concatenate(pieces))
            return pa.RecordBatch.from_pylist([row], _arrow_schema())

        for batch in batches:
            for some in _slices(batch):
                ids, lengths = encoder.encode(some.column(1))
                ends = np.cumsum(lengths)
                for doc_id, lo, hi in zip(some.column(0).to_pylist(), ends - lengths, ends):
                    doc_ids.append(doc_id)
                    counts.append(int(hi - lo) + 1)
                    pieces += [ids[lo:hi], end]
                    held += counts[-1]
                    if held >= shard_tokens:
                        yield close()
                        shard, start, held = shard + 1, start + held, 0
                        doc_ids, counts, pieces = [], [], []
        if counts:
            yield close()

    return shards


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Writes the shards of all documents, ascending by id over the parts and inside each."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    writer = _write_shards(tokenizer or tokenizer_path("byte_bpe_50k.json"), end_id, shard_tokens)
    ordered.mapInArrow(writer, SHARD).write.option("compression", "zstd").parquet(path)


def _read_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row)
            counts = shard.doc_tokens
            doc_ids = np.frombuffer(row["doc_ids"], "<i8")
            nulls = np.frombuffer(row["id_nulls"], bool)
            starts = row["part_start"] + row["start_in_part"] + np.cumsum(counts) - counts
            data, ends = expand(shard.symbols, shard.rules, spans=shard.spans).astype("<u4").tobytes(), 4 * np.cumsum(counts)
            ids = [data[lo:hi] for lo, hi in zip((ends - 4 * counts).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, mask=nulls), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"]
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary) of every document, decoded from the shards.

    ``start`` needs the tokens of all earlier parts: one row per part, as many as the writing
    job had tasks, is summed in order and joined back.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    # One row per task of the writing job: bounded by the partition setting, not by the data.
    placed = shards.join(F.broadcast(starts), "part")
    return placed.select("part_start", "start_in_part", "doc_ids", "id_nulls", "doc_tokens", "cuts", "rules", "spans", "symbols").mapInArrow(
        _read_shards, "doc_id long, start long, n_tokens long, ids binary"
    )


def encode_corpus(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the files (to the shared folder unless a path is given) and reads them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path, **options)
    return read_token_files(spark, path)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
