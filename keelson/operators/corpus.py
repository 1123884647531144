"""Building the corpus of chunks that reports retrieve from: once for each dependency that is asked for.

Dependencies that have chunks in the store are taken out before anything is fetched or cut. What is
left finds its repository, the best of its documents, the chunks of that and their vectors; every
step that fails is a reason in the result, never an error. Documents are cut once each, however many
dependencies share them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import repository_at, repository_path
from ..session import shared_path
from ..sources.chunk_store import DEPENDENCY, ChunkStore
from ..sources.sharded import MOST_SENT
from .retrieval import MOST_CHUNKS, chunk_documents

# Names of a changelog in the order in which they are tried, the most bytes of a document, and the
# reasons, in the order of the steps that give them.
CHANGELOGS = ("CHANGELOG.md", "CHANGELOG", "CHANGES.md", "HISTORY.md")
MOST_BYTES = 500 * 1024
REASONS = ("store_unavailable", "no_repository_url", "not_github", "repository_unreachable", "documents_too_large", "no_documents", "embedding_unavailable")

#: White space around a document, which is no part of it.
SPACE = " \t\n\x0b\f\r"
#: Bits that mark which keys are asked for, of whatever number: at most 262,144 words are sent to every task.
MARKS = 1 << 24

#: Adds a column ``vector`` to distinct rows of chunk_id and text; null where no vector can be had.
Embed = Callable[[DataFrame], DataFrame]


def decoded(answers: DataFrame) -> DataFrame:
    """Answers for documents with ``outcome`` (found, missing, too_large, unreachable) and the text of those found.

    ``answers``: owner, name, asked (the name of a file, or README), status (ok, not_found, too_large, or any
    other word for a failure), size, encoding, content, path, sha. What is not base64 was too large
    to be sent; undecodable or empty text is as good as missing.
    """
    # Each step is a column of its own before its users: inlined, a document would be decoded for every use.
    read = answers.withColumn("__bytes", F.try_to_binary(F.regexp_replace("content", r"\s", ""), F.lit("base64")))
    read = read.withColumn("__text", F.trim(F.make_valid_utf8(F.col("__bytes").cast("string")), F.lit(SPACE)))
    large = (F.col("status") == "too_large") | (F.coalesce("size", F.lit(0)) > MOST_BYTES) | ~F.coalesce(F.col("encoding") == "base64", F.lit(False)) | (F.octet_length("__bytes") > MOST_BYTES)
    outcome = (
        F.when(F.col("status") == "not_found", "missing")
        .when(~F.col("status").isin("ok", "too_large"), "unreachable")
        .when(F.coalesce(large, F.lit(False)), "too_large")
        .when(F.coalesce("__text", F.lit("")) == "", "missing")
        .otherwise("found")
    )
    told = read.withColumn("outcome", outcome)
    return told.select("owner", "name", "asked", "outcome", F.when(F.col("outcome") == "found", F.col("__text")).alias("text"), F.coalesce("path", "asked").alias("path"), F.coalesce("sha", F.lit("")).alias("sha"))


def best_documents(answers: DataFrame) -> DataFrame:
    """Per repository (owner, name): its document (asked, path, sha, text), or the reason why it has none."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, CHANGELOGS)), F.col("asked")), F.lit(0))
    order = F.when(rank == 0, len(CHANGELOGS) + 1).otherwise(rank)
    found = F.col("outcome") == "found"
    first = F.min(F.when(found, F.struct(order.alias("order"), "asked", "path", "sha", "text"))).alias("d")
    some = lambda word: F.bool_or(F.col("outcome") == word)
    grouped = decoded(answers).groupBy("owner", "name").agg(first, some("unreachable").alias("unreachable"), some("too_large").alias("large"))
    reason = F.when(F.col("d").isNotNull(), F.lit(None)).when(F.col("unreachable"), "repository_unreachable").when(F.col("large"), "documents_too_large").otherwise("no_documents")
    return grouped.select("owner", "name", "d.asked", "d.path", "d.sha", "d.text", reason.alias("reason"))


def ensure(requests: DataFrame, packages: DataFrame, answers: DataFrame, store: ChunkStore, embed: Embed) -> DataFrame:
    """Builds what is missing and returns, for each dependency, its chunks, the reason if it has none, and
    whether they were there before.

    ``requests``: scan_id, ecosystem, package_name, resolved_version. ``packages``: ecosystem,
    package_name, link (the declared repository). Repeated requests are one.
    """
    spark = requests.sparkSession
    keep = lambda df, label: _kept(df, shared_path(spark, label))
    wanted = keep(store.named(requests), "wanted")
    try:
        asked = keep(store.count_named(wanted), "asked")
    except AnalysisException:  # the store's folder is not there
        return wanted.select(*DEPENDENCY, F.lit(0).cast("long").alias("chunks"), F.lit(REASONS[0]).alias("reason"), F.lit(False).alias("reused"))
    stored = asked.where("n > 0").select(*DEPENDENCY, F.col("n").alias("chunks"), F.lit(None).cast("string").alias("reason"), F.lit(True).alias("reused"))

    missing = asked.where("n = 0").drop("n")
    # Links are read once a package, and of those alone that are asked for.
    package = ["ecosystem", "package_name"]
    links = _wanted(packages, missing.select(*package), *package).groupBy(*package).agg(F.min(F.when(F.trim("link") != "", F.trim("link"))).alias("link"))
    places = links.withColumn("p", repository_path(F.col("link"))).withColumn("r", repository_at(F.col("p"))).select(*package, "link", "r.owner", "r.name")
    placed = keep(missing.join(places, package, "left").select(*DEPENDENCY, "link", "owner", "name"), "placed")
    repositories = keep(placed.where("owner IS NOT NULL").select("owner", "name").distinct(), "repositories")
    documents = keep(best_documents(_wanted(answers, repositories, "owner", "name")), "documents")

    cut = documents.where("reason IS NULL").withColumn("k", F.struct("owner", "name", "path", "sha", F.when(F.col("asked").isin(*CHANGELOGS), "changelog").otherwise("readme").alias("kind")))
    chunks = keep(chunk_documents(cut.select("k", "text", "sha", "path"), "k", sha=F.col("sha"), path=F.col("path"), most=MOST_CHUNKS), "chunks")
    vectors = keep(embed(chunks.select("chunk_id", "text").distinct()).select("chunk_id", "vector"), "vectors")
    ready = chunks.join(vectors, "chunk_id", "left").select("k.owner", "k.name", F.col("k.path").alias("source_path"), F.col("k.sha").alias("source_sha"), F.col("k.kind").alias("source_kind"), "chunk_id", "heading", "chunk_index", "text", "vector")
    made = ready.groupBy("owner", "name").agg(F.count("*").alias("made"), F.bool_or(F.col("vector").isNull()).alias("bare"))

    # Those without a repository meet nothing; as null keys they would all be one task's.
    met = placed.where("owner IS NOT NULL").join(documents.select("owner", "name", "reason"), ["owner", "name"], "left").join(made, ["owner", "name"], "left")
    joined = met.unionByName(placed.where("owner IS NULL"), allowMissingColumns=True)
    reason = (
        F.when(F.col("link").isNull(), "no_repository_url")
        .when(F.col("owner").isNull(), "not_github")
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("made").isNull(), "no_documents")
        .when(F.col("bare"), "embedding_unavailable")
    )
    built = keep(joined.select(*DEPENDENCY, "owner", "name", F.coalesce("made", F.lit(0)).alias("made"), reason.alias("reason")), "built")
    good = built.where("reason IS NULL").select(*DEPENDENCY, "owner", "name")
    store.add(good.join(ready, ["owner", "name"]).withColumnRenamed("version", "resolved_version"))
    new = built.select(*DEPENDENCY, F.when(F.col("reason").isNull(), F.col("made")).otherwise(0).alias("chunks"), "reason", F.lit(False).alias("reused"))
    return stored.unionByName(new)


def _wanted(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Rows whose ``keys`` are among ``wanted``. Few of these go to where the rows lie; many meet them in a shuffle that sorts
    nothing, and which only rows enter whose keys have a mark among ``MARKS`` bits."""
    if wanted.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return rows.join(F.broadcast(wanted), [*keys], "left_semi")
    slot = F.pmod(F.xxhash64(*keys), F.lit(MARKS))
    word, bit = F.floor(slot / 64), (slot % 64).cast("int")
    one = F.lit(1).cast("long")
    marks = wanted.select(word.alias("__word"), F.call_function("shiftleft", one, bit).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = (F.col("__word") == word) & (F.call_function("shiftrightunsigned", F.col("__bits"), bit).bitwiseAND(one) == 1)
    return rows.join(F.broadcast(marks), marked, "left_semi").join(wanted.hint("shuffle_hash"), [*keys], "left_semi")


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
