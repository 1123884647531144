"""Stored tables that change in place: rows are dealt into shards, and a change rewrites only the shards it touches.

A shard is a partition folder, chosen by the hash of the columns ``by``. A change is staged first,
so that it is computed once; then the touched shards are read, merged and written over with dynamic
partition overwrite. Readers prune to the shards they ask for. Every shard holds one empty row, so
that a shard whose last row goes is written over like any other.

Each change is keyed: to repeat it, or to run it again after it was interrupted while shards were
being swapped, gives the same table. One writer at a time. A DataFrame that was read before a change
must be read again after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path

SHARD, BLANK = "__shard", "__blank"
#: Rows to delete by are sent to every task up to this number; more meet the table in a shuffle.
MOST_SENT = 20_000


@dataclass(frozen=True)
class ShardedTable:
    """``keys`` name a row, ``by`` (some of them) its shard. Choose ``shards`` so that one is about a
    gigabyte: a shard is rewritten whole, by as many tasks as its size asks for."""

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    by: tuple[str, ...]
    shards: int = 64

    def __post_init__(self) -> None:
        if not set(self.by) <= set(self.keys) <= set(self.schema.names):
            raise ValueError("columns of shards must be keys, and keys columns")

    def shard(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.shards)).cast("int")

    def create(self, spark: SparkSession) -> ShardedTable:
        """An empty table; it replaces what is there."""
        self._blanks(spark, range(self.shards)).write.mode("overwrite").partitionBy(SHARD).parquet(self.path)
        return self

    def _blanks(self, spark: SparkSession, shards) -> DataFrame:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        return spark.range(self.shards).where(F.col("id").isin(list(shards))).select(*nothing, F.lit(True).alias(BLANK), F.col("id").cast("int").alias(SHARD))

    def _stored(self, spark: SparkSession) -> DataFrame:
        fields = [T.StructField(f.name, f.dataType) for f in self.schema.fields]
        shape = T.StructType([*fields, T.StructField(BLANK, T.BooleanType()), T.StructField(SHARD, T.IntegerType())])
        return spark.read.schema(shape).parquet(self.path).where(~F.col(BLANK)).drop(BLANK)

    def read(self, spark: SparkSession, wanted: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the shards that the rows of ``wanted`` (with the columns ``by``) belong to."""
        rows = self._stored(spark)
        if wanted is not None:
            rows = rows.where(F.col(SHARD).isin(self._touched(wanted)))
        return rows.drop(SHARD)

    def _touched(self, rows: DataFrame) -> list[int]:
        """Shards of the rows: no more numbers than the table has shards."""
        return [r[0] for r in rows.select(self.shard()).distinct().collect()]

    def _staged(self, changes: DataFrame) -> DataFrame:
        path = shared_path(changes.sparkSession, "changes")
        changes.write.parquet(path)
        return changes.sparkSession.read.schema(changes.schema).parquet(path)

    def _put(self, rows: DataFrame, touched: list[int], dealt: bool = False) -> None:
        """Writes the shards over. Unless rows are ``dealt``, so that a task holds few shards, they are moved for that."""
        whole = rows.select(*self.schema.names, F.lit(False).alias(BLANK), self.shard().alias(SHARD)).unionByName(self._blanks(rows.sparkSession, touched))
        # Tasks of even size, each with few shards: a large shard is split over several.
        whole = whole if dealt else whole.hint("rebalance", SHARD)
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SHARD).parquet(self.path)

    def _digests(self, rows: DataFrame) -> DataFrame:
        """Keys of the rows and a digest of all else: what differs is found without moving the rows."""
        rest = [c for c in self.schema.names if c not in self.keys]
        told = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("")
        return rows.select(*self.keys, F.sha2(told, 256).alias("__digest"))

    def _differing(self, changes: DataFrame) -> list[int]:
        """Shards in which the smallest row of some key is not the stored one."""
        spark = changes.sparkSession
        held = self._digests(self.read(spark, changes)).withColumnRenamed("__digest", "__held").alias("old")
        first, last = F.min("__digest").alias("__first"), F.max("__digest").alias("__last")
        each = self._digests(changes).groupBy(*self.keys).agg(first, last)
        met = each.alias("new").join(held, self._same("old", "new", self.keys), "left")
        same, several = F.col("__first").eqNullSafe(F.col("__held")), F.col("__first") != F.col("__last")
        marked = self._staged(met.where(~same | several).select(*[F.col(f"new.{k}").alias(k) for k in self.keys], several.alias("__several")))
        touched = set(self._touched(marked.where("NOT __several")))
        # Only where a key has unlike rows does it need the rows to tell which is the smallest.
        unlike = marked.where("__several")
        if not unlike.isEmpty():
            mine = changes.alias("all").join(unlike.alias("unlike"), self._same("all", "unlike", self.keys), "left_semi")
            smallest = self._digests(self._smallest(mine, *self.keys)).alias("new").join(held, self._same("old", "new", self.keys), "left")
            touched |= set(self._touched(smallest.where(~F.col("__digest").eqNullSafe(F.col("__held"))).select(*[F.col(f"new.{k}").alias(k) for k in self.keys])))
        return sorted(touched)

    def _smallest(self, rows: DataFrame, *group: str, first: tuple[str, ...] = ()) -> DataFrame:
        """One row of each group: the smallest by the columns ``first`` and then by all that are no keys."""
        rest = [c for c in self.schema.names if c not in self.keys]
        kept = rows.groupBy(*group).agg(F.min(F.struct(*first, *rest, F.lit(0).alias("__none"))).alias("__row"))
        return kept.select(*self.keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*self.schema.names)

    def upsert(self, found: DataFrame) -> list[int]:
        """Rows of new keys are added, rows of known keys replace theirs. Of several rows of one key in ``found``
        the smallest counts. Shards in which nothing differs are left alone. Returns the rewritten shards.

        Whole rows move once: stored and found ones of the touched shards meet where they are written."""
        spark = found.sparkSession
        changes = self._staged(found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]))
        touched = self._differing(changes)
        if touched:
            old = self._stored(spark).where(F.col(SHARD).isin(touched)).withColumn("__old", F.lit(1))
            new = changes.withColumns({SHARD: self.shard(), "__old": F.lit(0)}).where(F.col(SHARD).isin(touched))
            # A shard is some tasks' work, as many as there are partitions for each.
            pieces = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // len(touched))
            dealt = old.unionByName(new).withColumn("__piece", F.pmod(F.xxhash64(*self.keys), F.lit(pieces))).repartition(SHARD, "__piece")
            self._put(self._smallest(dealt, SHARD, "__piece", *self.keys, first=("__old",)), touched, dealt=True)
        return touched

    def update(self, changes: DataFrame) -> list[int]:
        """Sets the columns of ``changes``, other than its keys, in the rows that have these keys; a null sets a null,
        and other keys are not added. ``changes`` has one row a key. Returns the rewritten shards."""
        spark = changes.sparkSession
        changed = [c for c in changes.columns if c not in self.keys]
        if not changed or not set(changed) <= set(self.schema.names) or not set(self.keys) <= set(changes.columns):
            raise ValueError("an update has all keys and some other columns of the table")
        staged = self._staged(changes.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in changes.columns]))
        new = staged.select(*self.keys, F.struct(*changed).alias("__new"))
        met = self._stored(spark).where(F.col(SHARD).isin(self._touched(staged))).alias("old").join(new.alias("new"), self._same("old", "new", self.keys))
        touched = [r[0] for r in met.where(~F.struct(*[F.col(f"old.{c}").alias(c) for c in changed]).eqNullSafe(F.col("__new"))).select(f"old.{SHARD}").distinct().collect()]
        if touched:
            rows = self._stored(spark).where(F.col(SHARD).isin(touched)).alias("old")
            joined = rows.join(new.alias("new"), self._same("old", "new", self.keys), "left")
            after = F.coalesce(F.col("__new"), F.struct(*[F.col(f"old.{c}").alias(c) for c in changed]))
            self._put(joined.select(*[after[c].alias(c) if c in changed else F.col(f"old.{c}") for c in self.schema.names]), touched)
        return touched

    def delete(self, gone: DataFrame) -> list[int]:
        """Deletes the rows that agree with some row of ``gone`` in all its columns, the columns ``by`` among them;
        null agrees with null. Returns the rewritten shards."""
        spark = gone.sparkSession
        if not set(self.by) <= set(gone.columns) <= set(self.schema.names):
            raise ValueError("rows to delete are named by columns of the table, those of the shard among them")
        staged = self._staged(gone.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in gone.columns]).distinct())
        same = self._same("old", "gone", tuple(gone.columns))
        # Few rows go to where the table lies, whose files stay in their shards.
        few = staged.limit(MOST_SENT + 1).count() <= MOST_SENT
        sent = F.broadcast(staged.alias("gone")) if few else staged.alias("gone")
        candidates = self._stored(spark).where(F.col(SHARD).isin(self._touched(staged))).alias("old")
        touched = [r[0] for r in candidates.join(sent, same, "left_semi").select(SHARD).distinct().collect()]
        if touched:
            rows = self._stored(spark).where(F.col(SHARD).isin(touched)).drop(SHARD).alias("old")
            self._put(rows.join(sent, same, "left_anti"), touched, dealt=few)
        return touched

    @staticmethod
    def _same(left: str, right: str, columns: tuple[str, ...]) -> Column:
        found = F.lit(True)
        for c in columns:
            found = found & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
        return found
