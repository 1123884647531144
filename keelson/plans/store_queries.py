"""Stores that change in place and sets that are published whole, written and read back as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Query
from ..operators import analytics, corpus, scan_set
from ..operators.retrieval import MOST_CHUNKS, chunk_documents
from ..session import kept, shared_path
from ..sources import published
from ..sources.chunk_store import DEPENDENCY, ChunkStore
from ..sources.sharded import ShardedTable
from .analytics_queries import FLAGGED, flagged
from .fixtures import KEY, advisory, occurrence, report, scan_run, table, with_views
from .lifecycle_queries import CHUNKS_SQL

SHARDS = 8


def _dependency(doc):
    version = F.when(doc % 3 != 0, F.concat(F.lit(" 1."), (doc % 3).cast("string")))
    names = {"scan_id": doc % 40, "ecosystem": F.when(doc % 2 == 0, "npm").otherwise("pypi"), "package_name": F.concat(F.lit("p"), (doc % 7).cast("string")), "resolved_version": version}
    return [c.alias(n) for n, c in names.items()]


def q_chunk_store(spark, sf_dir):
    """Two additions that overlap, the chunks of some dependencies deleted, whole scans dropped; then what is left, by dependency."""
    doc = F.col("doc_id")
    documents = table(spark, sf_dir, "documents")
    cut = chunk_documents(documents.select("doc_id", "text"), "doc_id", sha=doc.cast("string"), most=MOST_CHUNKS)
    vector = F.array(F.length("text").cast("float"), (F.col("chunk_index") + 1).cast("float"))
    chunks = cut.select(*_dependency(doc), "doc_id", "chunk_id", F.lit("README.md").alias("source_path"), doc.cast("string").alias("source_sha"), F.lit("readme").alias("source_kind"), "heading", "chunk_index", "text", vector.alias("vector"))
    everyone = documents.select(*_dependency(doc)).distinct()
    store = ChunkStore(shared_path(spark, "chunk-store"), SHARDS).create(spark)
    store.add(chunks.where("doc_id % 3 <> 2"))
    store.add(chunks.where("doc_id % 3 <> 0"))
    store.delete_for(everyone.where("package_name = 'p3' AND ecosystem = 'npm'"))
    store.drop_scans(everyone.where("scan_id % 10 = 9"))
    listed = store.scans(spark).withColumn("listed", F.lit(True))
    return store.count_for(everyone).join(listed, "scan_id", "left").select(*DEPENDENCY, "n", F.coalesce("listed", F.lit(False)).alias("listed"))


CHUNK_STORE_SQL = CHUNKS_SQL + """,
named AS (SELECT doc_id, CAST(doc_id % 40 AS VARCHAR) AS scan_id, CASE WHEN doc_id % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, 'p' || (doc_id % 7) AS package_name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '1.' || (doc_id % 3) END AS version FROM documents),
held AS (SELECT * FROM named JOIN kept USING (doc_id) WHERE NOT (package_name = 'p3' AND ecosystem = 'npm') AND scan_id::INT % 10 <> 9),
counted AS (SELECT scan_id, ecosystem, package_name, version, count(*) AS n FROM held GROUP BY ALL)
SELECT scan_id, ecosystem, package_name, version, coalesce(n, 0) AS n, scan_id IN (SELECT scan_id FROM held) AS listed
FROM (SELECT DISTINCT scan_id, ecosystem, package_name, version FROM named) LEFT JOIN counted USING (scan_id, ecosystem, package_name, version)"""


def q_in_place(spark, sf_dir):
    """Stored scans whose counts are set for the completed ones and then once more; failed ones are set to null."""
    shape = T.StructType([T.StructField("scan_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("dependency_count", T.LongType()), T.StructField("flagged_count", T.LongType())])
    scans = scan_run(spark, sf_dir).select("scan_id", "status")
    stored = ShardedTable(shared_path(spark, "scans"), shape, ("scan_id",), ("scan_id",), SHARDS).create(spark)
    stored.upsert(scans.withColumns({"dependency_count": F.lit(0).cast("long"), "flagged_count": F.lit(-1).cast("long")}))
    counts = analytics.scan_counts(flagged(spark, sf_dir, named=False)).select("scan_id", "dependency_count", "flagged_count")
    done = counts.join(scans.where("status = 'completed'").select("scan_id"), "scan_id", "left_semi")
    stored.update(done)
    stored.update(done)
    stored.update(scans.where("status = 'failed'").select("scan_id", F.lit(None).cast("long").alias("dependency_count")))
    return stored.read(spark)


def q_published(spark, sf_dir):
    """Completed scans as one published set, and what its four tables hold of each."""
    done = scan_run(spark, sf_dir).where("status = 'completed'").select("scan_id")
    rows = occurrence(spark, sf_dir, scans=done)
    # Lines that agree in scan, part, supplier and number are one occurrence.
    rest = [c for c in rows.columns if c not in KEY]
    rows = rows.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("x")).select(*KEY, "x.*")
    # Three tables of the set come from these rows, so they are made once.
    path = shared_path(spark, "occurrences")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    found = advisory(spark, sf_dir, scans=done)
    twice = found.unionByName(found.where("i % 2 = 0")).withColumn("osv_id", F.when(F.col("i") % 5 != 0, F.col("osv_id")))
    root = shared_path(spark, "scan-sets")
    published.publish(spark, root, scan_set.build(rows, twice, None, *KEY), scan_set.rules(*KEY))
    tables = published.read_set(spark, root, *scan_set.TABLES)
    manifests = tables["manifests"].groupBy("scan_id").agg(F.count("*").alias("manifests"))
    own = tables["occurrences"].join(tables["packages"], ["ecosystem", "package_name"]).groupBy("scan_id").agg(F.count("*").alias("occurrences"), F.count_distinct("ecosystem", "package_name").alias("packages"))
    advisories = tables["advisories"].groupBy("scan_id").agg(F.count("*").alias("advisories"))
    return manifests.join(own, "scan_id").join(advisories, "scan_id", "left").select("scan_id", "manifests", "occurrences", "packages", F.coalesce("advisories", F.lit(0)).alias("advisories"))


def _corpus_inputs(spark, sf_dir):
    """Dependencies with a report of their own, the links of their packages, and the answers for documents:
    text ``n`` is the changelog or the README of the repository of part ``n``."""
    lines = occurrence(spark, sf_dir, named=False).where("line_no = 1").select("scan_id", "ecosystem", "part_id", "resolved_version")
    name = F.concat(F.lit("part-"), F.col("part_id").cast("string"))
    requests = lines.join(report(spark, sf_dir).select("scan_id"), "scan_id", "left_semi").select("scan_id", "ecosystem", name.alias("package_name"), "resolved_version")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.explode(F.array(F.lit("npm"), F.lit("pypi"))).alias("ecosystem"))
    at = F.col("part_id") % 11
    link = F.when(at == 0, F.lit(None)).when(at == 1, " ").when(at == 2, F.concat(F.lit("https://gitlab.com/o/r"), "part_id")).otherwise(F.concat(F.lit("https://github.com/o/r"), "part_id"))
    packages = part.select("ecosystem", name.alias("package_name"), link.alias("link"))
    doc, base = F.col("doc_id") % 7, table(spark, sf_dir, "documents").select("doc_id", "text")
    answer = lambda asked, status, has: F.struct(F.lit(asked).alias("asked"), status.alias("status"), F.when(has, F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("content"))
    status = F.when(doc == 0, "rate_limited").when(doc == 1, "too_large").when(doc.isin(2, 3), "not_found").otherwise("ok")
    readme = F.when(doc.isin(3, 4), "ok").otherwise("not_found")
    both = base.select("doc_id", F.explode(F.array(answer("CHANGELOG.md", status, doc > 3), answer("README", readme, doc.isin(3, 4)))).alias("a"))
    answers = both.select(F.lit("o").alias("owner"), F.concat(F.lit("r"), "doc_id").alias("name"), "a.*", F.lit(None).cast("long").alias("size"), F.lit("base64").alias("encoding"), F.col("a.asked").alias("path"), F.concat(F.lit("sha"), "doc_id").alias("sha"))
    return requests, packages, answers


def _embed(chunks):
    """No vector for a chunk of a certain length, so that some dependency cannot be embedded."""
    return chunks.withColumn("vector", F.when(F.length("text") % 97 != 0, F.array(F.length("text").cast("float"), F.lit(1.0).cast("float"))))


def q_corpus(spark, sf_dir):
    """The corpus built for half of the dependencies and then for all: what each run says of every dependency."""
    requests, packages, answers = _corpus_inputs(spark, sf_dir)
    requests = kept(requests, "requests")
    store = ChunkStore(shared_path(spark, "corpus"), SHARDS).create(spark)
    corpus.ensure(requests.where("scan_id % 8 = 0"), packages, answers, store, _embed)
    found = corpus.ensure(requests, packages, answers, store, _embed)
    missing = corpus.ensure(requests.where("scan_id % 16 = 0"), packages, answers, ChunkStore(shared_path(spark, "absent"), SHARDS), _embed)
    lost = missing.select("scan_id", "package_name", "version", "ecosystem", F.col("reason").alias("without_store"))
    return found.join(lost, list(DEPENDENCY), "left")


CORPUS_SQL = with_views(
    CHUNKS_SQL.strip().removeprefix("WITH RECURSIVE ") + """,
asked AS (SELECT DISTINCT scan_id, ecosystem, part_id, resolved_version FROM occurrence SEMI JOIN report USING (scan_id) WHERE line_no = 1),
pieces_of AS (SELECT doc_id, count(*) AS n, bool_or(length(text) % 97 = 0) AS bare FROM kept GROUP BY doc_id),
told AS (
  SELECT *, CASE WHEN part_id % 11 < 2 THEN 'no_repository_url' WHEN part_id % 11 = 2 THEN 'not_github' WHEN d.doc_id IS NULL THEN 'no_documents' WHEN d.doc_id % 7 = 0 THEN 'repository_unreachable' WHEN d.doc_id % 7 = 1 THEN 'documents_too_large'
    WHEN d.doc_id % 7 = 2 OR n IS NULL THEN 'no_documents' WHEN bare THEN 'embedding_unavailable' END AS reason
  FROM asked a LEFT JOIN (SELECT doc_id FROM documents) d ON d.doc_id = part_id LEFT JOIN pieces_of p ON p.doc_id = part_id)
SELECT CAST(scan_id AS VARCHAR) AS scan_id, ecosystem, 'part-' || part_id AS package_name, resolved_version AS version, CASE WHEN reason IS NULL THEN n ELSE 0 END AS chunks, reason, reason IS NULL AND scan_id % 8 = 0 AS reused,
       CASE WHEN scan_id % 16 = 0 THEN 'store_unavailable' END AS without_store FROM told""",
    "occurrence", "report",
).replace("WITH ", "WITH RECURSIVE ", 1)

QUERIES = {
    "chunk_store_cycle": Query(q_chunk_store, CHUNK_STORE_SQL, "SNK09 X02"),
    "counts_in_place": Query(
        q_in_place,
        with_views(FLAGGED + """,
counts AS (SELECT scan_id, count(*) AS n, count(*) FILTER (WHERE is_flagged) AS f FROM flagged GROUP BY scan_id)
SELECT scan_id, status, CASE WHEN status = 'failed' THEN NULL WHEN status = 'completed' AND n IS NOT NULL THEN n ELSE 0 END AS dependency_count, CASE WHEN status = 'completed' AND n IS NOT NULL THEN f ELSE -1 END AS flagged_count
FROM scan_run LEFT JOIN counts USING (scan_id)""", "scan_run", "occurrence"),
        "SNK02",
    ),
    "published_scan_set": Query(
        q_published,
        with_views("""done AS (SELECT scan_id FROM scan_run WHERE status = 'completed'),
own AS (SELECT scan_id, count(DISTINCT manifest_path) AS manifests, count(DISTINCT (part_id, supp_id, line_no)) AS occurrences, count(DISTINCT (ecosystem, package_name)) AS packages FROM occurrence SEMI JOIN done USING (scan_id) GROUP BY scan_id),
found AS (SELECT scan_id, count(DISTINCT (part_id, supp_id, line_no, osv_id)) AS advisories FROM advisory SEMI JOIN done USING (scan_id) WHERE i % 5 <> 0 GROUP BY scan_id)
SELECT scan_id, manifests, occurrences, packages, coalesce(advisories, 0) AS advisories FROM own LEFT JOIN found USING (scan_id)""", "scan_run", "occurrence", "advisory"),
        "SNK01 Q05",
    ),
    "corpus_build": Query(q_corpus, CORPUS_SQL, "X01 SRC08"),
}
