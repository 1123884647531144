"""Chunks, filtered cosine top-k, the grounding gate and query framing.

Splitting a text into sections and overlapping windows follows data-dependent breaks, so it runs
per document in Arrow batches; everything after it is columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 1200
OVERLAP = 200
LEAST_CHUNK = 40
MOST_CHUNKS = 120
LEAST_SIMILARITY = 0.30
LEAST_TEXT = 400
NEAREST = 5
QUERY_LENGTH = 600
TEXTS_AT_ONCE = 64
CHUNKS_AT_ONCE = 8192

# What a heading and a code fence look like.
_HEADING = re.compile(r"(#{1,6})\s+(.*\S)\s*$")
_FENCE = re.compile(r"\s*(```|~~~)")


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(heading, body): marks and title of each heading and what follows it; headings inside code fences are text, and what precedes the first has none."""
    lines = text.splitlines()
    fences = accumulate(1 if _FENCE.match(line) else 0 for line in lines)
    titles = [None if n % 2 or _FENCE.match(line) else _HEADING.match(line) for line, n in zip(lines, fences)]
    starts = [n for n, title in enumerate(titles) if title]
    for begin, end in pairwise([-1, *starts, len(lines)]):
        heading = " ".join(titles[begin].groups()) if begin >= 0 else ""
        body = "\n".join(lines[begin + 1 : end]).strip()
        if heading or body:
            yield heading, body


def windows(body: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[str]:
    """Pieces of at most ``size``, cut after the last blank line, else line end, of the back half; each begins
    in the last ``overlap`` characters of the one before. White space around a piece goes, and pieces of nothing else."""
    body = body.strip()
    start, end = 0, 0
    while end < len(body):
        end = min(len(body), start + size)
        if end < len(body):
            cuts = (body.rfind(mark, start + size // 2, end) + len(mark) for mark in ("\n\n", "\n") if mark in body[start + size // 2 : end])
            end = next(cuts, end)
        if piece := body[start:end].strip():
            yield piece
        start = max(start + 1, end - overlap)


def each_chunk(text: str, sha: str, path: str, most: int | None = None) -> Iterator[tuple[str, str, str]]:
    """(chunk id, heading, text) of a document, to its end or to the first ``most``: short ones dropped, repeats dropped."""
    wholes = (((f"{heading}\n{piece}" if heading else piece).strip(), heading) for heading, body in sections(text) for piece in windows(body))
    seen: set[str] = set()
    for whole, heading in wholes:
        if len(seen) == most:
            return
        if len(whole) >= LEAST_CHUNK:
            key = hashlib.sha256("\0".join((sha, path, whole)).encode()).hexdigest()[:12]
            if key not in seen:
                seen.add(key)
                yield key, heading, whole


def chunks_of(text: str, sha: str, path: str, most: int | None = None) -> list[tuple[str, str, str]]:
    return list(each_chunk(text, sha, path, most))


def chunk_documents(documents: DataFrame, key: str, text: str = "text", sha: Column | None = None, path: Column | None = None, most: int | None = None) -> DataFrame:
    """key, chunk_index, chunk_id, heading, text of every chunk, or of the first ``most`` of each document.
    So many texts at once, of however many Arrow sends, are Python objects, and so many chunks at once, of however long texts, leave."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                texts = zip(*(some.column(n).to_pylist() for n in (1, 2, 3)))
                rows = ((i, n, *c) for i, (t, s, p) in enumerate(texts) for n, c in enumerate(each_chunk(t or "", s, p, most)))
                while held := list(islice(rows, CHUNKS_AT_ONCE)):
                    places, numbers, ids, headings, pieces = zip(*held)
                    words = [pa.array(c, pa.string()) for c in (ids, headings, pieces)]
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(places, pa.int64())), pa.array(numbers, pa.int32()), *words], ["k", "chunk_index", "chunk_id", "heading", "text"])

    source = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), (sha if sha is not None else F.sha1(F.coalesce(text, F.lit("")))).alias("s"), (path if path is not None else F.lit("README.md")).alias("p"))
    kind = dict(source.dtypes)["k"]
    return source.mapInArrow(cut, f"k {kind}, chunk_index int, chunk_id string, heading string, text string").withColumnRenamed("k", key)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    return F.try_divide(dot(left, right), length(left) * length(right))


def clamped(nearness: Column) -> Column:
    """In [0, 1] and rounded to four places before anything looks at it."""
    return F.round(F.least(F.greatest(nearness, F.lit(0.0)), F.lit(1.0)), 4)


def similarity(left: Column, right: Column) -> Column:
    return clamped(cosine(left, right))


def nearest_chunks(queries: DataFrame, chunks: DataFrame, *keys: str, k: int = NEAREST) -> DataFrame:
    """The k most similar chunks of each query among those with equal keys; none is no error, only no rows.

    Only ids and similarities are ranked; texts join the few that are kept. A chunk id occurs once for equal keys.
    """
    # Vectors become doubles and their lengths are taken once a row; a pair costs one product.
    as_doubles = lambda c: F.col(c).cast("array<double>").alias(c)
    held = chunks.select(*keys, "chunk_id", as_doubles("vector"), length(F.col("vector")).alias("__l"))
    asked = queries.select(*keys, "query_id", as_doubles("query_vector"), length(F.col("query_vector")).alias("__q"))
    nearness = F.try_divide(dot(F.col("query_vector"), F.col("vector")), F.col("__q") * F.col("__l"))
    scored = asked.join(held, [*keys]).select(*keys, "query_id", "chunk_id", clamped(nearness).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    best = scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    rest = queries.drop("query_vector")
    return best.join(rest, [*keys, "query_id"]).join(chunks.drop("vector"), [*keys, "chunk_id"])


def grounding(queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """sufficient if the best similarity and the text retrieved reach their least values; nothing retrieved is low."""
    held = retrieved.groupBy("query_id").agg(F.max("similarity").alias("best"), F.sum(F.length("text")).alias("n_chars"))
    enough = (F.col("best") >= LEAST_SIMILARITY) & (F.col("n_chars") >= LEAST_TEXT)
    return queries.select("query_id").join(held, "query_id", "left").select("query_id", "best", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.when(enough, "sufficient").otherwise("low").alias("grounding"))


def framed_query(package: Column, version: Column, reason: Column, fixed: Column, latest: Column) -> tuple[Column, Column]:
    """Branch and text of the retrieval query: the reason given, else the fixed version, else upgrading to the latest."""
    has = F.trim(F.coalesce(reason, F.lit(""))) != ""
    named = F.concat(package, F.lit(" "), F.coalesce(version, F.lit("")))
    text = (
        F.when(has, F.concat(named, F.lit(" deprecated: "), reason))
        .when(fixed.isNotNull(), F.concat(named, F.lit(" changes fixed in "), fixed))
        .otherwise(F.concat(named, F.lit(" upgrade to "), F.coalesce(F.nullif(latest, F.lit("")), F.lit("the latest release")), F.lit(" breaking changes and migration notes")))
    )
    return F.when(has, "reason_available").otherwise("no_reason"), F.substring(F.trim(text), 1, QUERY_LENGTH)


def store_chunks(existing: DataFrame | None, found: DataFrame) -> DataFrame:
    """Upsert by content: a chunk id of a scan is kept once."""
    every = found if existing is None else existing.unionByName(found)
    return every.dropDuplicates(["scan_id", "chunk_id"])
