"""The store of document chunks and their vectors, by scan: add, search, count, delete, list and drop.

One row a chunk of a scan, known by its content, so that adding what is there changes nothing. A
dependency is named by ecosystem, package and version; an unknown version is the empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import version_tag
from ..operators.retrieval import NEAREST, nearest_chunks
from .sharded import ShardedTable

DEPENDENCY = ("scan_id", "ecosystem", "package_name", "version")
TEXTS = ("scan_id", "chunk_id", "ecosystem", "package_name", "version", "source_path", "source_sha", "source_kind", "heading", "text")
SCHEMA = T.StructType([*[T.StructField(c, T.StringType()) for c in TEXTS], T.StructField("chunk_index", T.IntegerType()), T.StructField("vector", T.ArrayType(T.FloatType()))])


class ChunkStore:
    """Methods that change the store write it before they return; those that read give DataFrames.

    Dependencies come as rows of scan_id, ecosystem, package_name and resolved_version.
    """

    def __init__(self, path: str, shards: int = 64) -> None:
        self.table = ShardedTable(path, SCHEMA, ("scan_id", "chunk_id"), ("scan_id",), shards)

    def create(self, spark: SparkSession) -> ChunkStore:
        self.table.create(spark)
        return self

    @staticmethod
    def named(dependencies: DataFrame) -> DataFrame:
        """Distinct dependencies as they are spelled in the store."""
        tag = version_tag(F.col("resolved_version"))
        return dependencies.select(F.col("scan_id").cast("string"), "ecosystem", "package_name", tag.alias("version")).distinct()

    def add(self, chunks: DataFrame) -> list[int]:
        """Adds chunks with a dependency's columns; of two dependencies of a scan that share a chunk, the later addition keeps it.
        A chunk without a vector fails the job."""
        vector = F.coalesce("vector", F.raise_error(F.lit("a chunk needs a vector")).cast("array<float>"))
        tagged = chunks.withColumns({"version": version_tag(F.col("resolved_version")), "vector": vector})
        return self.table.upsert(tagged)

    def chunks_of(self, dependencies: DataFrame) -> DataFrame:
        """The stored chunks of the dependencies."""
        return self._held(self.named(dependencies))

    def _held(self, wanted: DataFrame) -> DataFrame:
        return self.table.read(wanted.sparkSession, wanted).join(wanted, list(DEPENDENCY), "left_semi")

    def count_for(self, dependencies: DataFrame) -> DataFrame:
        """Every dependency asked for and its number of chunks, 0 included."""
        return self.count_named(self.named(dependencies))

    def count_named(self, wanted: DataFrame) -> DataFrame:
        """The same for dependencies as ``named`` gives them, which are used several times."""
        held = self._held(wanted).groupBy(*DEPENDENCY).agg(F.count("*").alias("n"))
        return wanted.join(held, list(DEPENDENCY), "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def delete_for(self, dependencies: DataFrame) -> list[int]:
        return self.table.delete(self.named(dependencies))

    def scans(self, spark: SparkSession) -> DataFrame:
        """scan_id of every scan of which something is stored."""
        return self.table.read(spark).select("scan_id").distinct()

    def drop_scans(self, scans: DataFrame) -> list[int]:
        """Drops all chunks of the scans; scans that are not there are no error."""
        return self.table.delete(scans.select(F.col("scan_id").cast("string")).distinct())

    def nearest(self, queries: DataFrame, k: int = NEAREST) -> DataFrame:
        """The k nearest chunks of each query (query_id, query_vector) among those of its own dependency."""
        asked = queries.withColumn("version", version_tag(F.col("resolved_version"))).withColumn("scan_id", F.col("scan_id").cast("string")).select(*DEPENDENCY, "query_id", "query_vector")
        return nearest_chunks(asked, self.chunks_of(queries), *DEPENDENCY, k=k)
