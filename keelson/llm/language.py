"""Language identification with blended-spectrum string kernels.

The kernel of two texts counts the character n-grams (1 to 3 bytes of the lower-cased UTF-8
text, hashed) that both hold, by presence, normalised per order and averaged over the orders.
Nystroem landmarks turn it into features; one ridge regression per language, one against the
rest, is solved on them. A batch of texts is scored by two matrix products: grams by landmarks,
kernel values by dual weights. Whole texts count, whatever their length.

The model is fitted on a sample bounded by ``SAMPLE_PER_LANGUAGE`` expected rows a language,
chosen by a hash of the id among the learning rows; every row is then predicted.

Defined results: a null text, or one without a letter, is ``und`` with score 0; if nothing can
be learned, every row is. Neither the id, the source nor the label enters a prediction.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder_of_id

#: Hashed slots of the grams of each order; single bytes have one each.
SLOT_BITS = (8, 12, 13)
WIDTH = sum(1 << b for b in SLOT_BITS)
SAMPLE_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 48
RIDGE = 0.1
TEXTS_AT_ONCE = 128
UNKNOWN = "und"

LETTER = r"\p{L}"
_MIX = np.uint32(0x9E3779B1)


def presence(texts: list[str]) -> np.ndarray:
    """A 0/1 row per text: which gram slots it holds."""
    rows = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(rows, texts):
        grams = np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8).astype(np.uint32)
        codes, first = grams, 0
        for order, bits in enumerate(SLOT_BITS):
            if order:
                codes = codes[:-1] << np.uint32(8) | grams[order:]
            row[first + (codes if not order else codes * _MIX >> np.uint32(32 - bits))] = 1
            first += 1 << bits
    return rows


def normalised(rows: np.ndarray) -> np.ndarray:
    """Scaled so that the product of two rows is the blended kernel, 1 for equal texts."""
    first = 0
    for bits in SLOT_BITS:
        part = rows[:, first : first + (1 << bits)]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(SLOT_BITS))
        first += 1 << bits
    return rows


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # packed bits, one row a landmark
    weights: np.ndarray  # landmarks by languages
    offset: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        kernel = normalised(presence(texts)) @ self.expanded().T
        return kernel @ self.weights + self.offset

    def expanded(self) -> np.ndarray:
        if "rows" not in self.__dict__:
            bits = np.unpackbits(self.landmarks, axis=1)[:, :WIDTH].astype(np.float32)
            self.__dict__["rows"] = normalised(bits)
        return self.__dict__["rows"]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}


def train(packed: np.ndarray, labels: list[str], per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """``packed``: presence bits of the sample, in the order in which landmarks are taken."""
    languages = tuple(sorted(set(labels)))
    number = np.array([languages.index(x) for x in labels])
    marks = np.concatenate([np.flatnonzero(number == n)[:per_language] for n in range(len(languages))])
    rows = normalised(np.unpackbits(packed, axis=1)[:, :WIDTH].astype(np.float32))
    kernel = (rows @ rows[marks].T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[marks])
    held = values > 1e-6 * values[-1]
    root = vectors[:, held] / np.sqrt(values[held])
    features = kernel @ root
    targets = np.where(number[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Languages weigh the same, whatever their share of the sample.
    share = 1 / np.bincount(number)[number]
    share *= len(share) / share.sum()
    mean, centre = (share @ features) / share.sum(), (share @ targets) / share.sum()
    shifted = features - mean
    solved = np.linalg.solve((shifted * share[:, None]).T @ shifted + ridge * np.eye(shifted.shape[1]), (shifted * share[:, None]).T @ (targets - centre))
    return Model(languages, packed[marks], (root @ solved).astype(np.float32), (centre - mean @ solved).astype(np.float32))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(at, TEXTS_AT_ONCE)
            bits = np.packbits(presence(part.column(2).to_pylist()).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], ["order", "lang", "bits"])


def fit(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """The model learned from rows where ``learns`` holds and the label is not null.

    Rows are chosen by thresholds on a hash, one per label, so nothing is shuffled; twice the
    expected number a label is the bound; every label takes part.
    """
    able = docs.where(learns & F.col(label_col).isNotNull() & F.col(text_col).rlike(LETTER))
    counted = docs.where(learns & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(label_col).count().collect()
    if not counted:
        return None
    slots = 1 << 30
    limit = {r[label_col]: min(slots, int(slots * per_language / r["count"]) + 1) for r in counted}
    order = F.pmod(F.xxhash64(F.lit("language-sample"), F.col(id_col).cast("string")), F.lit(slots))
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in limit.items() for x in pair]), F.col(label_col))
    chosen = able.where(order < bound).select(order.alias("order"), F.col(label_col).alias("lang"), F.col(text_col).alias("text"))
    rows = sorted((r["order"], r["lang"], bytes(r["bits"])) for r in chosen.mapInArrow(_packed, "order long, lang string, bits binary").collect())
    if not rows:
        return None
    return train(np.stack([np.frombuffer(b, np.uint8) for *_, b in rows]), [lang for _, lang, _ in rows])


def _predict(model: Model):
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = part.column(2).to_pylist()
                able = [n for n, letters in enumerate(part.column(3).to_pylist()) if letters]
                names, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if able:
                    scores = model.scores([texts[n] for n in able])
                    parts = np.exp(4 * (scores - scores.max(1, keepdims=True)).astype(np.float64))
                    best = scores.argmax(1)
                    top = parts[np.arange(len(able)), best] / parts.sum(1)
                    for n, b, s in zip(able, best, top):
                        names[n], sure[n] = model.languages[b], float(s)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names), pa.array(sure, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per input row. Rows held out are never learned from."""
    held = F.coalesce(held_out, F.lit(False))
    model = fit(docs, ~held, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(text_col).cast("string").rlike(LETTER).alias("letters"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(id_col: str = "doc_id", divisor: int = 4, remainder: int = 2) -> Column:
    return remainder_of_id(id_col, divisor) == remainder
