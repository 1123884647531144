"""What each filter of a chain removes, in every order of the chain.

A document is a mask of the filters that it fails. Under an order of filters it leaves at the
smallest position of a filter in its mask: with masks as a matrix that is 0 at a failing filter
and infinite elsewhere, and orders as a matrix of each filter's position (the inverse of the
order), the steps are their product over the semiring of minimum and sum. The steps then place
the weights of masks (documents, good ones, toxic ones) by order and step, and every failing
filter that stands later is redundant there.

Documents are measured once where they lie and never move. What moves are counts: equal texts share
their mask, so ids of one text meet as partial aggregates, and in the end a part (a language) is at
most one row for each mask. A text of a third of all rows is no large group anywhere.

Defined results: a null or empty text has no words and equals other null or empty ones; a null id
has no labels, is never a duplicate, and makes none; documents of one id and one text do not make
each other duplicates; an id with several labels is good (toxic) if one of them says so; null parts
count as the empty one; an empty table has no parts and so no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARKS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = "n_words long, n_distinct long, n_capitals long, n_points long, n_marks long"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@dataclass(frozen=True)
class Filter:
    """``fails`` is a predicate over the measurements; none means: repeats the text of a smaller id."""

    letter: str
    fails: Callable[[Callable[[str], Column]], Column] | None


FILTERS = (
    Filter("A", lambda m: m("n_words") < 100),
    Filter("B", lambda m: 100 * m("n_distinct") < 80 * m("n_words")),
    Filter("C", lambda m: 100 * m("n_capitals") > 10 * m("n_points")),
    Filter("D", lambda m: m("n_marks") > 0),
    Filter("E", None),
)


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    count = lambda marks: len(text) - len(text.translate(None, marks))
    return len(words), len(set(words)), count(CAPITALS), len(text.decode("utf-8", "replace")), count(MARKS)


def _measure_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in MEASURES.split(", ")]
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        found = list(zip(*map(measure, texts))) or [()] * len(names)
        digests = pa.array([sha256(t or b"").digest() for t in texts], pa.binary())
        columns = [pa.array(values, pa.int64()) for values in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, *columns], ["doc_id", "part", "digest", *names])


def masks(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good: Column | None = None, toxic: Column | None = None) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by part and failing filters, bit i for filter i."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    measured = rows.mapInArrow(_measure_batches, f"doc_id long, part string, digest binary, {MEASURES}")
    bit = lambda test, i: F.when(test, F.lit(1 << i)).otherwise(F.lit(0))
    own = F.lit(0)
    for i, f in enumerate(filters):
        if f.fails is not None:
            own = own.bitwiseOR(bit(f.fails(F.col), i))
    once = measured.select("doc_id", "part", "digest", own.alias("own")).groupBy("doc_id", "part", "digest", "own").agg(F.count("*").alias("n"))

    said = lambda test: F.coalesce(F.max(F.coalesce(test, F.lit(False))), F.lit(False))
    good, toxic = F.col("quality") == 1 if good is None else good, F.col("toxic") == 1 if toxic is None else toxic
    judged = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").cast("string").alias("__key")).agg(said(good).alias("good"), said(toxic).alias("toxic"))
    # Rows without an id meet no label, and go by their text so that they do not meet each other either.
    keyed = once.withColumn("__key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.hex("digest"))))
    flagged = keyed.join(judged, "__key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})

    # Of each text: rows by part and labels, the smallest id and how many rows have it; then the text's smallest.
    kinds = flagged.groupBy("digest", "own", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("least"),
        F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))["n"], F.lit(0)).alias("n_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_nameless"),
    )
    split = kinds.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    firsts = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0)) + F.col("n_nameless")
    repeats = sum(1 << i for i, f in enumerate(filters) if f.fails is None)
    pair = F.array(F.struct(F.col("own").alias("mask"), firsts.alias("n")), F.struct(F.col("own").bitwiseOR(F.lit(repeats)).alias("mask"), (F.col("n") - firsts).alias("n")))
    counted = split.select("part", "good", "toxic", F.explode(pair).alias("y")).where("y.n > 0")
    count = lambda test: F.sum(F.when(test, F.col("y.n")).otherwise(0))
    return counted.groupBy("part", F.col("y.mask").alias("mask")).agg(F.sum("y.n").alias("n"), count(F.col("good")).alias("n_good"), count(F.col("toxic")).alias("n_toxic"))


def removal_ranks(n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, ranks): every order of the filters, and for each mask and order the position at which
    a document with that mask is removed, or the number of filters if it is not."""
    orders = np.array(list(permutations(range(n_filters))), np.int64).reshape(-1, n_filters)
    positions = np.argsort(orders, axis=1)
    failing = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    costs = np.where(failing == 1, 0, n_filters)
    ranks = np.full((len(failing), len(orders)), n_filters, np.int64)
    for i in range(n_filters):
        np.minimum(ranks, costs[:, i, None] + positions[:, i], out=ranks)
    return orders, ranks


def effects(weights: np.ndarray, orders: np.ndarray, ranks: np.ndarray) -> dict[str, np.ndarray]:
    """The counts, one row an order and one column a step, from ``weights``: documents, good and toxic ones by mask."""
    n_orders, n_filters = orders.shape
    slots = ranks + np.arange(n_orders) * (n_filters + 1)

    def scattered(weight: np.ndarray) -> np.ndarray:
        out = np.zeros(n_orders * (n_filters + 1), np.int64)
        np.add.at(out, slots.ravel(), np.repeat(weight, n_orders))
        return out.reshape(n_orders, n_filters + 1)[:, :n_filters]

    removed, good, toxic = map(scattered, weights)
    failing = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    fails = weights[0] @ failing
    per_filter = np.zeros(n_filters, np.int64)
    np.add.at(per_filter, orders.ravel(), removed.ravel())
    return {
        "kept": weights[0].sum() - removed.cumsum(axis=1),
        "removed": removed,
        "redundant": fails[orders] - removed,
        "unique_fails": weights[0][1 << np.arange(n_filters)][orders],
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": per_filter[orders],
    }


def _rows_of_parts(letters: str):
    def batches_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(letters)
        orders, ranks = removal_ranks(n)
        names = ["".join(letters[i] for i in order) for order in orders]
        for batch in batches:
            for part, rows in zip(batch.column(0), batch.column(1).to_pylist()):
                weights = np.zeros((3, 1 << n), np.int64)
                for row in rows:
                    weights[:, row["mask"]] += row["n"], row["n_good"], row["n_toxic"]
                found = effects(weights, orders, ranks)
                columns = [pa.array([part.as_py()] * (len(names) * n), pa.string()), pa.array(np.repeat(names, n), pa.string()), pa.array(np.tile(np.arange(1, n + 1), len(names)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(found[c].ravel(), pa.int64()) for c in COUNTS]], ["part", "filter_order", "step", *COUNTS])

    return batches_of


def audit(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS, **columns: str | Column) -> DataFrame:
    """One row per part, order of filters and step, with the counts named in ``COUNTS``."""
    letters = "".join(f.letter for f in filters)
    per_part = masks(docs, labels, filters, **columns).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("rows"))
    return per_part.mapInArrow(_rows_of_parts(letters), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


#: The audit as one statement for DuckDB, order by order.
AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
judged AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
          'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(d.doc_id > first, false)} AS f
  FROM d JOIN firsts USING (text) LEFT JOIN judged ON d.doc_id = judged.doc_id),
fails AS (
  SELECT part, good, toxic, unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([f.A, f.B, f.C, f.D, f.E]) AS failed,
         f.A::INT + f.B::INT + f.C::INT + f.D::INT + f.E::INT AS n_failed,
         concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END,
                CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS all_failed FROM m),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier
          FROM orders, (SELECT unnest(range(1, 6)) AS step)),
patterns AS (SELECT part, letter, failed, n_failed, all_failed, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
             FROM fails GROUP BY ALL),
counted AS (
  SELECT part, filter_order, step, letter,
         sum(n) FILTER (WHERE failed AND NOT hit) AS removed, sum(n) FILTER (WHERE failed AND hit) AS redundant,
         sum(n) FILTER (WHERE failed AND n_failed = 1) AS unique_fails, sum(n) AS documents,
         sum(n_good) FILTER (WHERE failed AND NOT hit) AS good_lost, sum(n_toxic) FILTER (WHERE failed AND NOT hit) AS toxic_lost
  FROM (SELECT *, translate(earlier, all_failed, '') <> earlier AS hit FROM patterns JOIN steps USING (letter)) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(documents - sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter_order ORDER BY step) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
