"""Language-model scores by Katz backoff over bigrams.

Counts up to ``GT_MAX`` are discounted by Good-Turing; what the discounts free is given to the
words never seen after a history, in proportion to their unigram probability, with weights that
make every history's distribution sum to exactly one. The unigram level is discounted likewise
and gives what is freed to one unknown word. A token is evaluated recursively: the bigram if it
was seen, else the history's backoff weight times the unigram, else the unknown word.

The corpus is read once. Tokens are kept in slabs: one row per about ``SLAB_TOKENS`` tokens with
a local vocabulary, in a table bucketed by slab, so that the later steps join to it without a
shuffle. A step sends each slab's distinct keys (64-bit hashes of words, word pairs or histories)
to the partition that owns them, sorted and packed, one row per slab and partition; the owner adds
up what all slabs say of a key and answers every slab in the order of its keys. Partitions own
ranges of hashes: a frequent word, pair or history is one key per slab and never a heavy task.

    words      -> count of each word            (unigram table)
    pairs      -> count of each pair            (bigram table)
    histories  -> backoff weight of each history (backoff table)

Defined results: a null or empty text is the end token alone; rows of a null id are learned from
like the others; repeated rows count as often as they occur; with nothing to learn from, every
token is the unknown word with probability one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, remainder_of_id, scratch_path, written

SLAB_TOKENS = 1 << 21
GT_MAX = 5
HASH_SEED = 7
END, BEGIN = b"\n end", b"\n begin"  # no word holds white space

SLAB = "slab long, docs binary, nulls binary, held binary, lengths binary, words binary, tokens binary"
REQUEST = "p int, slab long, keys binary, numbers binary, more binary"
ANSWER = "kind string, p int, slab long, keys binary, numbers binary"


def squeeze(array: np.ndarray) -> bytes:
    """Bytes of an array, like bytes next to each other, compressed."""
    import zstandard

    array = np.ascontiguousarray(array)
    planes = array.view(np.uint8).reshape(len(array), -1).T if len(array) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, "<u8"), dtype=np.uint64)


def word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, HASH_SEED)


def pair_hash(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes; the order matters."""
    with np.errstate(over="ignore"):
        x = history * np.uint64(0x9E3779B97F4A7C15) + (word << np.uint64(23) | word >> np.uint64(41))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        return x ^ x >> np.uint64(31)


def owner_edges(count: int) -> np.ndarray:
    """First hash of each partition."""
    return np.array([(n << 64) // count for n in range(count)], np.uint64)


# ------------------------------------------------------------------ discounts


def discounts(of_counts: dict[int, int], most: int = GT_MAX) -> np.ndarray:
    """Good-Turing factors by count; 1 from ``most`` + 1 on. ``of_counts``: how many events have each count.

    Where a factor is not defined or not in (0, 1), absolute discounting by n1 / (n1 + 2 n2) stands in.
    """
    n = lambda r: of_counts.get(r, 0)
    absolute = n(1) / (n(1) + 2 * n(2)) if n(1) else 0.5
    out = np.ones(most + 2)
    over = (most + 1) * n(most + 1) / n(1) if n(1) else 1.0
    for r in range(1, most + 1):
        d = ((r + 1) * n(r + 1) / (r * n(r)) - over) / (1 - over) if n(r) and over != 1 else 0.0
        out[r] = d if 0 < d < 1 else max(0.05, 1 - max(absolute, 0.05) / r)
    return out


@dataclass(frozen=True)
class Unigrams:
    """What the word counts add up to: tokens, types, training texts and discounted probabilities."""

    tokens: int
    types: int
    texts: int
    factor: np.ndarray
    scale: float
    unknown: float

    @classmethod
    def of(cls, tokens: int, types: int, texts: int, of_counts: dict[int, int]) -> "Unigrams":
        factor = discounts(of_counts)
        freed = sum(r * n * (1 - factor[r]) for r, n in of_counts.items() if r <= GT_MAX)
        if tokens == 0:
            return cls(0, types, texts, factor, 1.0, 1.0)
        if freed <= 0:  # nothing is discounted: one more count makes room
            return cls(tokens, types, texts, factor, 1 / (tokens + 1), 1 / (tokens + 1))
        return cls(tokens, types, texts, factor, 1 / tokens, freed / tokens)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        counts = counts.astype(np.int64)
        return np.where(counts > 0, self.factor[np.minimum(counts, GT_MAX + 1)] * counts * self.scale, self.unknown)


# ---------------------------------------------------------------------- slabs


class _SlabMaker:
    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.local: dict[bytes, int] = {}
        self.tokens: list[int] = []
        self.docs, self.held, self.lengths = [], [], []

    def add(self, doc_id, held: bool, text: bytes | None) -> None:
        local, before = self.local, len(self.tokens)
        self.tokens += [local.setdefault(w, len(local)) for w in (text or b"").lower().split()]
        self.tokens.append(local.setdefault(END, len(local)))
        self.docs.append(doc_id)
        self.held.append(held)
        self.lengths.append(len(self.tokens) - before)

    def row(self, slab: int) -> dict:
        words = np.fromiter(map(word_hash, self.local), np.uint64, len(self.local))
        return {
            "slab": slab, "docs": squeeze(np.array([d or 0 for d in self.docs], "<i8")), "nulls": squeeze(np.array([d is None for d in self.docs], np.uint8)),
            "held": squeeze(np.array(self.held, np.uint8)), "lengths": squeeze(np.array(self.lengths, "<u4")), "words": squeeze(words), "tokens": squeeze(np.array(self.tokens, "<u4")),
        }


def _make_slabs(slab_tokens: int):
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slab, maker = TaskContext.get().partitionId() << 24, _SlabMaker()
        schema = pa.schema([(n, pa.int64() if k == "long" else pa.binary()) for n, k in (f.split() for f in SLAB.split(", "))])
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                maker.add(doc_id, held, text.as_py())
                if len(maker.tokens) >= slab_tokens:
                    yield pa.RecordBatch.from_pylist([maker.row(slab)], schema)
                    slab += 1
                    maker.clear()
        if maker.docs:
            yield pa.RecordBatch.from_pylist([maker.row(slab)], schema)

    return make


class Slab:
    """A slab's row, opened: hashes of the local words, tokens, histories, and distinct pairs."""

    def __init__(self, row):
        self.number = int(row["slab"])
        self.docs, self.nulls = unsqueeze(row["docs"], "<i8"), unsqueeze(row["nulls"], "u1").astype(bool)
        self.held, self.lengths = unsqueeze(row["held"], "u1").astype(bool), unsqueeze(row["lengths"], "<u4").astype(np.int64)
        words = unsqueeze(row["words"], "<u8")
        # Local numbers in the order of hashes, so that every list of keys is sorted.
        order = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words = words[order]
        self.tokens = place[unsqueeze(row["tokens"], "<u4")]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.learned = np.repeat(~self.held, self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.learned], minlength=len(self.words))

    def pairs(self) -> None:
        """Histories (the number after the last word is the beginning), and distinct pairs by hash."""
        self.begin = len(self.words)
        self.history = np.concatenate([[self.begin], self.tokens[:-1]]) if len(self.tokens) else self.tokens
        self.history[self.starts] = self.begin
        self.history_hash = np.append(self.words, np.uint64(word_hash(BEGIN)))
        codes = self.history * (self.begin + 1) + self.tokens
        distinct, which = np.unique(codes, return_inverse=True)
        self.pair_history, self.pair_word = distinct // (self.begin + 1), distinct % (self.begin + 1)
        hashes = pair_hash(self.history_hash[self.pair_history], self.words[self.pair_word])
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair_history, self.pair_word, self.pair_keys, self.pair_of = self.pair_history[order], self.pair_word[order], hashes[order], place[which]

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of[self.learned], minlength=len(self.pair_keys))

    def requests(self, keys: np.ndarray, numbers: np.ndarray, more: np.ndarray | None, count: int) -> list[tuple]:
        """One row per partition that owns some of the sorted keys."""
        cuts = np.append(np.searchsorted(keys, owner_edges(count)), len(keys))
        return [
            (p, self.number, squeeze_sorted(keys[lo:hi]), squeeze(numbers[lo:hi]), squeeze(more[lo:hi]) if more is not None else b"")
            for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:]))
            if lo < hi
        ]


def answered(answers: pd.DataFrame, kind: str, number: str) -> np.ndarray:
    """All numbers of one kind that a slab was sent, in the order of its keys."""
    own = answers[answers["kind"] == kind].sort_values("p")
    parts = [unsqueeze(x, number) for x in own["numbers"]]
    return np.concatenate(parts) if parts else np.empty(0, number)


# --------------------------------------------------------------------- owners


def _merged(group: pd.DataFrame, number: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of slab; distinct keys, the key of every entry, and all numbers."""
    group = group.sort_values("slab")
    keys = [unsqueeze_sorted(x) for x in group["keys"]]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    return list(zip(group["slab"], map(len, keys))), distinct, which, np.concatenate([unsqueeze(x, number) for x in group["numbers"]])


def _table_and_answers(kind: str, p: int, slabs: list, distinct: np.ndarray, table: np.ndarray, answers: np.ndarray) -> pd.DataFrame:
    rows, at = [(f"{kind}-table", p, -1, squeeze_sorted(distinct), squeeze(table))], 0
    for slab, count in slabs:
        rows.append((kind, p, slab, b"", squeeze(answers[at : at + count])))
        at += count
    return pd.DataFrame(rows, columns=["kind", "p", "slab", "keys", "numbers"])


def _own_counts(kind: str):
    """Adds up counts. An answer is twice the total, plus one for the first slab that learned the key."""

    def own(group: pd.DataFrame) -> pd.DataFrame:
        slabs, distinct, which, counts = _merged(group, "<u4")
        totals = np.bincount(which, counts, len(distinct)).astype(np.uint64)
        learned = np.flatnonzero(counts)
        _, first = np.unique(which[learned], return_index=True)
        answers = totals[which] << np.uint64(1)
        answers[learned[first]] |= np.uint64(1)
        return _table_and_answers(kind, int(group["p"].iloc[0]), slabs, distinct, totals, answers)

    return own


def _own_backoff(group: pd.DataFrame) -> pd.DataFrame:
    """Backoff weights: freed share of the history over the unigram mass of what never followed it.

    An answer is the weight; it is negative if nothing was discounted after the history, and then one
    more count makes room: pairs are taken over count + 1. A history never learned has weight 1.
    """
    slabs, distinct, which, freed = _merged(group, "<f8")
    more = np.concatenate([unsqueeze(x, "<c16") for x in group.sort_values("slab")["more"]])
    freed = np.bincount(which, freed, len(distinct))
    seen_mass = np.bincount(which, more.real, len(distinct))
    count = np.zeros(len(distinct))
    count[which] = more.imag
    bare = (freed <= 1e-9) & (count > 0)
    share = np.where(bare, 1 / (count + 1), freed / np.maximum(count, 1))
    weight = np.where(count > 0, share / np.maximum(1 - seen_mass, 1e-12), 1.0)
    weight = np.where(bare, -weight, weight)
    return _table_and_answers("backoff", int(group["p"].iloc[0]), slabs, distinct, weight, weight[which])


# ---------------------------------------------------------------------- steps


def _ask_words(count: int):
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                slab = Slab(row)
                yield _request_batch(slab.requests(slab.words, slab.word_counts().astype("<u4"), None, count))

    return ask


def _request_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["p", "slab", "keys", "numbers", "more"])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["p", "slab", "keys", "numbers", "more"])


def _slabs(left: pd.DataFrame) -> Iterator[Slab]:
    for row in left.to_dict("records"):
        slab = Slab(row)
        slab.pairs()
        yield slab


def _ask_pairs(count: int):
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                slab = Slab(row)
                slab.pairs()
                yield _request_batch(slab.requests(slab.pair_keys, slab.pair_counts().astype("<u4"), None, count))

    return ask


def _ask_backoff(count: int, unigrams: Unigrams, factor: np.ndarray):
    def ask(slabs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for slab in _slabs(slabs):
            words = (answered(answers, "word", "<u8") >> np.uint64(1)).astype(np.int64)
            found = answered(answers, "pair", "<u8")
            first, counts = (found & np.uint64(1)).astype(bool), (found >> np.uint64(1)).astype(np.int64)
            history, word, c = slab.pair_history[first], slab.pair_word[first], counts[first]
            width = slab.begin + 1
            freed = np.bincount(history, c * (1 - factor[np.minimum(c, GT_MAX + 1)]), width)
            mass = np.bincount(history, unigrams.probability(words[word]), width)
            total = np.append(words, unigrams.texts).astype(np.float64)
            # A history only asks if it precedes some token of the slab; its own count is known here.
            used = np.unique(slab.pair_history)
            used = used[np.argsort(slab.history_hash[used])]
            rows += slab.requests(slab.history_hash[used], freed[used], (mass + 1j * total)[used], count)
        return _frame(rows)

    return ask


def _score(unigrams: Unigrams, factor: np.ndarray):
    def score(slabs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for slab in _slabs(slabs):
            words = (answered(answers, "word", "<u8") >> np.uint64(1)).astype(np.int64)
            counts = (answered(answers, "pair", "<u8") >> np.uint64(1)).astype(np.int64)
            used = np.unique(slab.pair_history)
            used = used[np.argsort(slab.history_hash[used])]
            weight = np.ones(slab.begin + 1)
            weight[used] = answered(answers, "backoff", "<f8")
            total = np.append(words, unigrams.texts).astype(np.float64)
            total += weight < 0
            history = slab.pair_history
            seen = factor[np.minimum(counts, GT_MAX + 1)] * counts / np.maximum(total[history], 1)
            unseen = np.abs(weight[history]) * unigrams.probability(words[slab.pair_word])
            logs = np.log10(np.where(counts > 0, seen, unseen))
            base = np.log10((words + 1) / (unigrams.tokens + unigrams.types + 1))
            per_doc = lambda x: np.add.reduceat(x, slab.starts)
            frame = pd.DataFrame({"doc_id": pd.array(slab.docs, "Int64"), "held_out": slab.held, "n_tokens": slab.lengths, "n_known": per_doc((words[slab.tokens] > 0).astype(np.int64)), "base_score": per_doc(base[slab.tokens]), "score": per_doc(logs[slab.pair_of])})
            frame.loc[slab.nulls, "doc_id"] = pd.NA
            out.append(frame)
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


def _count_of_counts(kind: str):
    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, types, by = 0, 0, np.zeros(GT_MAX + 2, np.int64)
        for frame in frames:
            for data in frame["numbers"]:
                totals = unsqueeze(data, "<u8").astype(np.int64)
                tokens, types = tokens + int(totals.sum()), types + int((totals > 0).sum())
                by += np.bincount(np.minimum(totals, GT_MAX + 2), minlength=GT_MAX + 3)[: GT_MAX + 2]
        yield pd.DataFrame({"tokens": [tokens], "types": [types], "by": [by.tolist()]})

    return count


def totals_of(table: DataFrame, kind: str) -> tuple[int, int, dict[int, int]]:
    """Tokens, types and counts of counts of a stored table: one row per task comes to the driver's sum."""
    rows = table.where(F.col("kind") == f"{kind}-table").select("numbers").mapInPandas(_count_of_counts(kind), "tokens long, types long, by array<long>")
    sums = rows.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), *[F.sum(F.col("by")[r]).alias(f"n{r}") for r in range(1, GT_MAX + 2)]).first()
    return sums["tokens"] or 0, sums["types"] or 0, {r: sums[f"n{r}"] or 0 for r in range(1, GT_MAX + 2)}


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", slab_tokens: int = SLAB_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row."""
    spark = docs.sparkSession
    count = partitions(spark)
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    name = f"keelson_slabs_{uuid.uuid4().hex[:12]}"
    made = rows.mapInArrow(_make_slabs(slab_tokens), SLAB)
    made.write.bucketBy(count, "slab").option("compression", "uncompressed").option("path", scratch_path(spark, "slabs")).saveAsTable(name)
    slabs = spark.table(name)
    texts = rows.where("NOT held").count()

    def owned(requests: DataFrame, owner, label: str) -> DataFrame:
        return written(requests.groupBy("p").applyInPandas(owner, ANSWER), label)

    words = owned(slabs.mapInArrow(_ask_words(count), REQUEST), _own_counts("word"), "words")
    tokens, types, of_counts = totals_of(words, "word")
    unigrams = Unigrams.of(tokens, types, texts, of_counts)
    pairs = owned(slabs.mapInArrow(_ask_pairs(count), REQUEST), _own_counts("pair"), "pairs")
    factor = discounts(totals_of(pairs, "pair")[2])
    known = words.where("slab >= 0").unionByName(pairs.where("slab >= 0"))
    asked = slabs.groupBy("slab").cogroup(known.groupBy("slab")).applyInPandas(_ask_backoff(count, unigrams, factor), REQUEST)
    backoff = owned(asked, _own_backoff, "backoff")
    known = known.unionByName(backoff.where("slab >= 0"))
    scored = slabs.groupBy("slab").cogroup(known.groupBy("slab")).applyInPandas(_score(unigrams, factor), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(unigrams.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_col: str = "doc_id", divisor: int = 7, remainder: int = 2) -> Column:
    return remainder_of_id(id_col, divisor) == remainder
