"""SimHash near-duplicates through covering locality-sensitive hashing.

Each of the 64 bits gets one of the nonzero vectors of r + 1 bits; table v keeps the bits
whose vector has an odd product with v. Two fingerprints that differ in at most r bits differ
in bits whose vectors leave some v orthogonal to all of them, so they agree on all that table v
keeps: every pair within the radius meets in one of the 2^(r+1) - 1 tables.

A table's bucket that holds two different fingerprints is then checked exactly, without forming
its pairs: two members are within distance 2 just when some value within distance 1 of both
exists, and it differs from them in bits that the table does not keep. Members therefore emit
their neighbours at distance at most 1 in those bits, and all that meet at one value (65 at most)
are linked to the smallest. This keeps every component and has no large group.

Components come from alternating large-star and small-star steps, with a checkpoint each round.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like
any other; equal rows are copies; ids that are null never name a component unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, written

RADIUS = 2
SHINGLE = 3
HASH_SEED = 42
HASHES_AT_ONCE = 1 << 16
FP = "__simhash"


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = HASH_SEED) -> int:
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingle = len(words)
    line, count = b" ".join(words), len(words) - shingle + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    lo, hi = starts[:count].tolist(), (starts[shingle : shingle + count] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, count, HASHES_AT_ONCE):
        part = zip(lo[at : at + HASHES_AT_ONCE], hi[at : at + HASHES_AT_ONCE])
        hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in part], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > count).tolist())


def _with_fingerprint(at: int, shingle: int):
    def batches_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(at).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, FP])

    return batches_of


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The input rows and their fingerprint, a signed long in ``FP``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(FP, T.LongType())])
    return docs.mapInArrow(_with_fingerprint(docs.columns.index(text_col), shingle), schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_fingerprint(rows, "text", shingle).select("doc_id", F.col(FP).alias("fp"))


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Per table, the bits that it keeps."""
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << radius + 1)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a > b, that connect exactly what distances of at most 2 connect. ``fps``: distinct values fp."""
    masks = covering_masks(RADIUS)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("t", "bucket"))
    shared = keyed.groupBy("t", "bucket").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("t", "bucket")
    members = keyed.join(shared, ["t", "bucket"]).select("t", "fp")

    def near(mask: int) -> Column:
        free = [signed(1 << i) for i in range(64) if not mask >> i & 1]
        return F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(f)) for f in free])

    balls = F.coalesce(*[F.when(F.col("t") == n, near(m)) for n, m in enumerate(masks)])
    meeting = members.select("t", "fp", F.explode(balls).alias("middle"))
    groups = meeting.groupBy("t", "middle").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    pairs = groups.select(F.explode("members").alias("a"), F.array_min("members").alias("b"))
    return pairs.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the component's smallest node.

    Large-star joins every larger neighbour to the smallest one, small-star every smaller one;
    both take minima with partial aggregation and join them back, so a node with many neighbours
    is no single group. It ends when a round changes nothing, that is, when all stars are flat.
    """
    edges = cut_lineage(edges.select("a", "b"))

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = state(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("x"), "m").select(F.col("x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = cut_lineage(small)
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    flat = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return flat.unionByName(flat.select(F.col("root").alias("node"), "root").distinct())


def classes(rows: DataFrame) -> DataFrame:
    """fp, root and component_id of every distinct fingerprint of ``rows`` (doc_id, fp)."""
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = cut_lineage(components(links(distinct.select("fp"))))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.select("fp", "root").join(names, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) for every row."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    return rows.join(classes(rows), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The input rows, every column, less all but one row of each group of near-duplicates.

    The row of the group's smallest id stays (null ids last); of several rows with that id, the
    one with the smallest fingerprint, and of those that agree in both, the smallest in its text
    and then in its other columns. Texts and fingerprints are written once and read by both steps.
    """
    held = written(with_fingerprint(docs, text_col, shingle), "fingerprints")
    rows = held.select(F.col(id_col).cast("long").alias("doc_id"), F.col(FP).alias("fp"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    chosen = rows.join(classes(rows).select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("x"))
    kept = chosen.select(F.col("x.doc_id").alias("__id"), F.col("x.fp").alias("__fp"))
    often = rows.groupBy("doc_id", "fp").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.lit(True).alias("__often"))
    kept = cut_lineage(kept.join(often, kept["__id"].eqNullSafe(often["__id"]) & (kept["__fp"] == often["__fp"]), "left").select(kept["__id"], kept["__fp"], F.coalesce("__often", F.lit(False)).alias("__often")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col(FP) == F.col("__fp"))
    found = held.join(kept, same)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = found.where("NOT __often").select(*columns)
    if not kept.where("__often").take(1):
        return once
    again = found.where("__often").groupBy(id_col, FP).agg(F.min(F.struct(F.col(text_col).alias("__text"), F.struct(*columns).alias("__row"))).alias("x"))
    return once.unionByName(again.select("x.__row.*"))
