"""Benchmark decontamination by a prefix-filtered set join.

A window of benchmark words is contained in a document only if all its shingles are, so it is
enough to join on one of them: with the whole set required, the prefix that a set join needs is a
single token, and the rarest is the cheapest. One pass over the documents finds every shingle
that the benchmark has, with the words around it; that table gives the order by rarity. Each
window then meets the places of its rarest shingle, places too near the start or the end of a
document for the whole window fall out by position and length, and the words of the window are
compared one by one. Everything is DataFrame functions.

Documents cross the network once, as rows of counts and places. What the benchmark has goes to
every task only while its counted size is under a bound; beyond it the same joins are shuffled.
Windows of equal words are one window, and items of equal windows share them, so repeated items
cost no more joins.

Defined results: null and empty texts have no words, no items and are not contaminated; items
without words never occur; rows of a null item id are hit but not counted as an item; repeated
documents are separate rows, and an item id that repeats is one item with all its windows.
Columns other than ids and texts do not reach the result, so their names cannot clash.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WINDOW = 10
SHINGLE = 5
#: A word is a run of characters other than these, after A-Z are lower-cased (a Java and RE2 class).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles and windows of the benchmark that are sent to every task, at most; about 100 bytes each.
MOST_BROADCAST = 500_000


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased and no other letters; of a null text none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def shingle_key(words: Column, at: Column, size: int) -> Column:
    """A hash of ``size`` words from position ``at`` (from 0)."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)], F.lit(size))


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, words): every run of ``window`` words of every item, or all its words if they are fewer."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return rows.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at") + 1, window).alias("words")).distinct()


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= most else df


def _keys_of_windows(windows: DataFrame, shingle: int, sizes: list[int]) -> DataFrame:
    """(words, key, offset) of every shingle of every distinct window; a window shorter than a shingle is one."""

    def keys(size: int) -> Column:
        offsets = F.sequence(F.lit(0), F.size("words") - size)
        return F.transform(offsets, lambda at: F.struct(shingle_key(F.col("words"), at, size).alias("key"), at.alias("offset")))

    size = F.least(F.size("words"), F.lit(shingle))
    found = F.coalesce(*[F.when(size == n, keys(n)) for n in sizes])
    return windows.select("words").distinct().select("words", F.explode(found).alias("x")).select("words", "x.key", "x.offset")


def places(docs: DataFrame, keys: DataFrame, sizes: list[int], window: int, id_col: str, text_col: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Two kinds of rows from one pass: for each document (row, doc_id, n_words), and for each place where
    it has a shingle of ``keys`` (row, key, place, near, near_from): the words around it and the place of their first."""
    small = keys.count() <= most_broadcast
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    # Place -1 stands for the document itself; its key is its own, so that no key is common to all.
    spread = rows.select("row", "doc_id", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("place"))
    held = F.col("place") >= 0
    if len(sizes) == 1:
        keyed = spread.withColumn("key", F.when(held, shingle_key(F.col("w"), F.col("place"), sizes[0])).otherwise(F.col("row")))
    else:
        each = F.array(*[shingle_key(F.col("w"), F.col("place"), n) for n in sizes])
        keyed = spread.withColumn("key", F.explode(F.when(held, each).otherwise(F.array("row"))))
    near_from = F.greatest(F.col("place") - (window - min(sizes)), F.lit(0))
    around = F.when(held, F.slice("w", near_from + 1, F.col("place") + window - near_from))
    own = [F.when(~held, F.col("doc_id")).alias("doc_id"), F.when(~held, F.size("w")).alias("n_words"), F.when(held, near_from).alias("near_from"), around.alias("near")]
    if not small:  # What is shuffled is a few words, never the whole document again.
        keyed, own = keyed.select("row", "place", "key", *own), ["doc_id", "n_words", "near_from", "near"]
    known = keys.withColumn("known", F.lit(True))
    found = keyed.join(F.broadcast(known) if small else known, "key", "left").where(~held | F.col("known"))
    return found.select("row", F.when(held, F.col("key")).alias("key"), F.when(held, F.col("place")).alias("place"), *own)


def occurrences(found: DataFrame, keys: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(row, words, start): every place where all words of a window stand in a row, from ``places``
    and the shingles of windows. The rarest shingle of a window is joined, then its words are compared."""
    sites = found.where("place IS NOT NULL")
    rarity = sites.groupBy("key").agg(F.count("*").alias("n"))
    # A shingle that no document has keeps its window from occurring anywhere: it wins and meets nothing.
    ranked = keys.join(rarity, "key", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset")).alias("x"))
    prefix = written(ranked.where("x.n > 0").select("words", "x.key", "x.offset"), "rarest-shingles")
    joined = sites.join(_bounded(prefix, most_broadcast), "key").withColumn("start", F.col("place") - F.col("offset"))
    inside = (F.col("start") >= 0) & (F.col("start") >= F.col("near_from"))
    same = F.slice("near", F.greatest(F.col("start") - F.col("near_from"), F.lit(0)) + 1, F.size("words")) == F.col("words")
    return joined.where(inside & same).select("row", "words", "start")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit (words inside occurring windows) and items (their ids as sorted strings)."""
    windows = written(windows_of(items, item_col, item_text_col, window), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect()) or [shingle]
    keys = written(_keys_of_windows(windows, shingle, sizes), "window-shingles")
    distinct_keys = written(keys.select("key").distinct(), "shingles")
    found = written(places(docs, distinct_keys, sizes, window, id_col, text_col, most_broadcast), "places")
    at = occurrences(found, keys, most_broadcast)

    # Words covered: each window adds what lies past the end of those that start before it.
    spans = at.select("row", "start", (F.col("start") + F.size("words")).alias("end")).groupBy("row", "start").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest(F.col("start"), F.least(F.coalesce(F.max("end").over(earlier), F.lit(0)), F.col("end")))
    hits = spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    of_row = at.select("row", "words").distinct().join(_bounded(windows, most_broadcast), "words").where("item_id IS NOT NULL")
    named = of_row.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    documents = found.where("place IS NULL").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    joined = documents.join(hits, "row", "left").join(named, "row", "left")
    return joined.select("doc_id", "n_words", F.coalesce(F.col("n_hit").cast("long"), F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))


#: The same result as one statement for DuckDB, by joining whole windows.
CONTAMINATION_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, w[s + 1 : s + {WINDOW}] AS words
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(words) AS k FROM windows),
spread AS (
  SELECT r, k, s, w[s + 1 : s + k] AS words
  FROM (SELECT r, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS s FROM d, sizes)),
found AS (SELECT r, s, k, item_id FROM spread JOIN windows USING (words)),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM found) GROUP BY r),
named AS (
  SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (r) LEFT JOIN named i USING (r)
"""
