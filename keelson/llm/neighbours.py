"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a vector by three rounds of random signs and a fast Hadamard transform, and
its bucket is the nearest signed axis. A query probes the ``probes`` nearest signed axes of
every table; what lies in the probed buckets is ranked by the exact cosine. A query that finds
too few there is run again with every signed axis of one table, which reaches each entry once.

Equal vectors are one entry with its smallest ids, as only these can be among the nearest.
The index entries of a bucket are dealt over blocks of bounded size and so are the queries
that probe it, so a full bucket is many tasks; each task multiplies one block of the index by
one block of queries and keeps the best per query. No candidate is dropped.

Vectors that are null, empty, zero, or hold a null or non-finite component, or whose length
differs from ``dimension``, take no part, and neither do rows without an id. An id that occurs twice
is two rows: a query leaves out one row of its own id and its own vector, and finds the others. Ties
go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage

TABLES = 4
PROBES = 28
BLOCK_ROWS = 8_192
SEED = 20_011


def signs(width: int, table: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, table]).choice(np.array([-1.0, 1.0]), (3, width))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    count, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(count, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(count, width)
        step *= 2
    return rows / np.sqrt(width)


def rotate(vectors: np.ndarray, table: int) -> np.ndarray:
    width = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    turned = np.zeros((len(vectors), width))
    turned[:, : vectors.shape[1]] = vectors
    for row in signs(width, table):
        turned = hadamard(turned * row)
    return turned


def nearest_axes(vectors: np.ndarray, table: int, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of each vector; axis i is 2i for +, 2i + 1 for -."""
    turned = rotate(vectors, table)
    signed = np.stack([turned, -turned], 2).reshape(len(turned), -1)
    count = min(count, signed.shape[1])
    return np.argsort(-signed, axis=1, kind="stable")[:, :count]


def _axes(count: int):
    """Per table, the ``count`` nearest axes: one for index entries, several for queries."""

    @F.pandas_udf("array<array<int>>")
    def axes(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        matrix = np.stack(vectors.to_numpy()).astype(np.float64)
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        found = np.stack([nearest_axes(matrix, t, count) for t in range(TABLES)], 1)
        return pd.Series(found.tolist())

    return axes


def usable(vector: Column, dimension: int | None) -> Column:
    numbers = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(numbers, lambda x: x != 0)
    right = F.size(vector) == dimension if dimension else F.size(vector) > 0
    return vector.isNotNull() & right & finite & some


def cosines(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Cosine of a vector with each row, in double precision, in one order of summation."""
    dots = (many * one).sum(1)
    return dots / (np.sqrt((one * one).sum()) * np.sqrt((many * many).sum(1)))


def _rank_block(keep: int):
    def rank(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            index = index.sort_values("first_id", kind="stable")
            ids, keys, vectors = index["first_id"].to_numpy(), index["ikey"].to_numpy(), np.stack(index["vector"].to_numpy()).astype(np.float64)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            asked = np.stack(queries["vector"].to_numpy()).astype(np.float64)
            turned = asked / np.linalg.norm(asked, axis=1, keepdims=True)
            for at in range(0, len(asked), 256):
                scores = turned[at : at + 256] @ unit.T
                # Rounding of the product must not decide: rank whatever is as good as the last one kept.
                last = np.partition(scores, max(0, len(ids) - keep), axis=1)[:, max(0, len(ids) - keep)] - 1e-9
                for n, row in enumerate(scores):
                    near = np.flatnonzero(row >= last[n])
                    exact = cosines(asked[at + n], vectors[near])
                    best = np.lexsort((ids[near], -exact))[:keep]
                    key = queries["vkey"].iloc[at + n]
                    out += [(key, keys[near[b]], float(exact[b]), index["ids"].iloc[near[b]]) for b in best]
        return pd.DataFrame(out, columns=["qkey", "ikey", "score", "ids"])

    return rank


def _best_lists(index: DataFrame, probing: DataFrame, k: int, block_rows: int) -> DataFrame:
    """qkey, near: the k + 1 best rows, in order, among those that share a bucket with the query."""
    blocks = lambda df, name: df.groupBy("table", "bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    # At most tables x 2 x width rows, whatever the data.
    layout = F.broadcast(blocks(index, "n_index").join(blocks(probing, "n_query"), ["table", "bucket"]))
    own = lambda n: F.pmod(F.xxhash64("vkey"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = ["table", "bucket", "index_block", "query_block"]
    left = index.join(layout, ["table", "bucket"]).withColumn("index_block", own("n_index")).withColumn("query_block", every("n_query"))
    right = probing.join(layout, ["table", "bucket"]).withColumn("query_block", own("n_query")).withColumn("index_block", every("n_index"))
    ranked = (
        left.select(*place, F.col("vkey").alias("ikey"), "first_id", "ids", "vector")
        .groupBy(*place)
        .cogroup(right.select(*place, "vkey", "vector").groupBy(*place))
        .applyInPandas(_rank_block(k + 1), "qkey string, ikey string, score double, ids array<long>")
    )
    found = ranked.groupBy("qkey", "ikey").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("vec_id", F.explode("ids"))
        .withColumn("n", F.row_number().over(best))
        .where(F.col("n") <= k + 1)
        .groupBy("qkey")
        .agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", (F.col("ikey") == F.col("qkey")).alias("same")))).alias("near"))
    )


def nearest(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query: Column | None = None, k: int = 5, dimension: int | None = None, probes: int = PROBES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that ``query`` selects.

    ``dimension`` is the length of a usable vector; unset, it is the commonest length.
    """
    chosen = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), (F.lit(True) if query is None else query).alias("asked")).where("vec_id IS NOT NULL")
    if dimension is None:
        widths = chosen.where(usable(F.col("vector"), None)).groupBy(F.size("vector").alias("width")).count()
        found = widths.orderBy(F.desc("count"), "width").first()
        dimension = found["width"] if found else 1
    good = chosen.where(usable(F.col("vector"), dimension)).withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
    keyed = cut_lineage(good.withColumn("vkey", F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "vector")))))

    # A query leaves itself out, so k + 1 ids of equal vectors are enough.
    smallest = Window.partitionBy("vkey").orderBy("vec_id")
    copies = keyed.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    entries = copies.groupBy("vkey").agg(F.min("vec_id").alias("first_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    asked = keyed.where("asked").groupBy("vkey").agg(F.first("vector").alias("vector"))

    def bucketed(df: DataFrame, count: int) -> DataFrame:
        spread = df.withColumn("axes", _axes(count)("vector")).select("*", F.posexplode("axes").alias("table", "found")).drop("axes")
        return spread.withColumn("bucket", F.explode("found")).drop("found")

    index, probing = cut_lineage(bucketed(entries, 1)), cut_lineage(bucketed(asked, probes))
    lists = cut_lineage(_best_lists(index, probing, k, block_rows))
    # A list holds the query's own row too; where there are fewer rows, it holds them all.
    enough = min(k + 1, keyed.limit(k + 1).count())
    full = lists.where(F.size("near") >= enough)
    short = cut_lineage(asked.join(full, asked["vkey"] == full["qkey"], "left_anti"))
    if not short.isEmpty():
        axes = 2 << max(1, (dimension - 1).bit_length())
        everywhere = short.select("vkey", "vector", F.lit(0).alias("table"), F.explode(F.sequence(F.lit(0), F.lit(axes - 1))).alias("bucket"))
        lists = full.unionByName(_best_lists(index.where("table = 0"), everywhere, k, block_rows))
    members = keyed.where("asked").select(F.col("vec_id").alias("query_id"), F.col("vkey").alias("qkey"))
    # One row of the query's own id and vector is the query itself.
    own = F.array_position(F.transform("near", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), F.lit(True))
    others = F.filter("near", lambda x, i: i + 1 != F.col("own"))
    answers = members.join(lists, "qkey").withColumn("own", own).withColumn("near", F.slice(others, 1, k))
    return answers.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
