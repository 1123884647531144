"""Mixing sources to target weights.

Documents get a hash-random key, are ordered by it inside their source, and each source is
cut exactly where the prefix sum of its sizes reaches its budget; a source whose target is
larger than itself is repeated. Prefix sums have two levels: sums per (source, leading digits
of the key), then a window inside one such bucket, so that no source meets in one task.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of
its own that sorts last; repeated rows count as often as they occur (equal rows swap places
freely, so reruns agree as multisets). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, WORD, cut_lineage

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
ROWS_PER_BUCKET = 20_000


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Budget per source from (src, is_null, source_size): one row per source, in and out.

    Shares of the total go by weight, in order of the source's code points. A source stops at
    ``most`` times its size and its excess is shared out by weight among the others, until none
    is above. That is the water level L where sum(min(cap, weight * L)) is the total: ordered
    by cap / weight, the first source that need not stop fixes L.
    """
    everyone = Window.orderBy("is_null", "src")
    ranked = sources.withColumn("n", F.row_number().over(everyone) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    levelled = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    stepped = (
        levelled.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weights_left"))
        .withColumn("first_free", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("n", "level")))
    )
    # The level of the first source, in that order, that stays under its cap.
    order = F.struct((F.col("cap") / F.col("weight")).alias("c"), F.col("n").alias("n"))
    level = F.min_by("level", F.when(F.col("first_free").isNotNull(), order)).over(everything)
    return stepped.withColumn("target", F.least(F.col("cap"), F.col("weight") * level)).select("is_null", "src", "source_size", "target")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict:
    """Columns of a row's place in the mix: its source, size and hash-random key."""
    return {
        "doc_id": F.col(id_col).cast("long"),
        "src": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "is_null": F.col(source_col).isNull(),
        "size": F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long"),
        "key": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))),
    }


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], most: int) -> DataFrame:
    """Every row's size and key with its source's size, target, whole epochs and rest, and ``before``:
    the size of the rows ahead of it."""
    sized = cut_lineage(docs.select(*[c.alias(n) for n, c in _sized(docs, id_col, text_col, source_col).items()]))
    # Leading hex digits of the key: enough buckets for small windows whatever the row count.
    rows, digits = sized.count(), 1
    while rows > ROWS_PER_BUCKET * 16**digits / 16 and digits < 8:
        digits += 1
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))

    group = ["is_null", "src", "bucket"]
    sums = cut_lineage(sized.groupBy(*group).agg(F.sum("size").alias("bucket_size")))
    sources = sums.groupBy("is_null", "src").agg(F.sum("bucket_size").alias("source_size"))
    budget = targets(sources, weights, most).withColumn("budget", F.least(F.round("target").cast("long"), F.col("source_size") * most))
    budget = budget.withColumn("whole", F.expr("IF(source_size > 0, budget div source_size, 0)")).withColumn("rest", F.expr("IF(source_size > 0, budget % source_size, 0)"))
    earlier = Window.partitionBy("is_null", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before_bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size").join(budget, ["is_null", "src"])

    inside = Window.partitionBy(*group).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return sized.join(starts, group).withColumn("before", F.col("before_bucket") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; one row per input row."""
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return _placed(docs, id_col, text_col, source_col, weights, most).select(
        "doc_id",
        F.when(~F.col("is_null"), F.col("src")).alias("source"),
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + part).cast("long").alias("taken"),
    )


def cuts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source: whole epochs, the place of the first row that the last epoch does not take whole,
    and the words that it takes there, shared evenly if equal rows stand at that place."""
    place = F.struct("key", "doc_id", "size")
    placed = _placed(docs, id_col, text_col, source_col, weights, most)
    short = F.col("before") + F.col("size") > F.col("rest")
    per_source = placed.groupBy("is_null", "src").agg(F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.min(F.when(short, place)).alias("edge"))
    at_edge = placed.groupBy("is_null", "src", place.alias("edge")).agg(F.count("*").alias("rows_there"), F.min("before").alias("before"))
    part = F.expr("CAST(greatest(0, (rest - before) div rows_there) AS BIGINT)")
    return per_source.join(at_edge, ["is_null", "src", "edge"], "left").select("is_null", "src", "whole", "edge", F.coalesce(part, F.lit(0)).alias("part"))


#: Sources whose cuts are sent to every task; beyond it they are joined by a shuffle.
MOST_BROADCAST_SOURCES = 100_000


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The mixed corpus: the input's columns, each row as often as the mix takes it whole, and the
    first words of the row at the edge of each source's budget."""
    edges = cut_lineage(cuts(docs, id_col, text_col, source_col, weights, most))
    small = edges.count() <= MOST_BROADCAST_SOURCES
    own = _sized(docs, id_col, text_col, source_col)
    names = {n: f"__mix_{n}" for n in own}
    rows = docs.select("*", *[c.alias(names[n]) for n, c in own.items()])
    edges = edges.select(*[F.col(c).alias(f"__cut_{c}") for c in edges.columns])
    same = (F.col("__mix_src") == F.col("__cut_src")) & (F.col("__mix_is_null") == F.col("__cut_is_null"))
    joined = rows.join(F.broadcast(edges) if small else edges, same)
    place = F.struct(F.col("__mix_key").alias("key"), F.col("__mix_doc_id").alias("doc_id"), F.col("__mix_size").alias("size"))
    words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(rf"[{SPACES}]*{WORD}"), F.lit(0))
    copies = F.array_repeat(F.col(text_col), (F.col("__cut_whole") + F.when(F.col("__cut_edge").isNull() | (place < F.col("__cut_edge")), 1).otherwise(0)).cast("int"))
    some = F.when(place == F.col("__cut_edge"), F.col("__cut_part")).otherwise(0)
    texts = F.when(some > 0, F.concat(copies, F.array(F.array_join(F.slice(words, F.lit(1), F.greatest(some, F.lit(1)).cast("int")), "")))).otherwise(copies)
    taken = joined.withColumn("__mix_text", F.explode(texts))
    return taken.select(*[F.col("__mix_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


#: The same mix as one statement for DuckDB, without buckets.
MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size::DOUBLE * 3 AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER before, 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT level FROM levels WHERE level <= cap / weight ORDER BY cap / weight, n LIMIT 1),
budgets AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM free)) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, least(CAST(round(b.target) AS BIGINT), b.source_size * 3) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0
            THEN budget // source_size * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
