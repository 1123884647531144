"""Sets of tables that become visible together or not at all.

The tables of a set are written to a folder of their own, read back and checked, and then one
pointer file is put in place; readers follow the newest pointer. Whatever fails before that leaves
nothing visible, and a task that runs twice writes to the same staged table. Files are reached
through Hadoop's file systems, so the folder may lie in any store that Spark writes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]


class SetRefused(RuntimeError):
    """A set that broke a check; nothing of it is visible."""


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _pointers(spark: SparkSession, root: str) -> list[str]:
    """Names of the pointers, oldest first."""
    files, folder = _folder(spark, f"{root}/published")
    if not files.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(folder) if not s.getPath().getName().startswith((".", "_")))


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the newest published set, if there is one."""
    names = _pointers(spark, root)
    return f"{root}/sets/{names[-1].split('-', 1)[1]}" if names else None


def read_set(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """The named tables, all of one published set."""
    folder = current(spark, root)
    if folder is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def publish(spark: SparkSession, root: str, tables: Tables, checks: Callable[[Tables], Mapping[str, DataFrame]] = lambda tables: {}) -> str:
    """Writes, checks and publishes the tables; returns the folder of the set.

    ``checks`` gets the tables as they were written and returns a DataFrame of offending rows for each
    rule; one row in any of them refuses the set. The pointer's number is one more than the newest
    that was there at the start: of two writers that began together the second to finish is refused.
    """
    before = _pointers(spark, root)
    number = int(before[-1].split("-", 1)[0]) + 1 if before else 1
    name = uuid.uuid4().hex
    folder = f"{root}/sets/{name}"
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}")
    written = {table: spark.read.schema(rows.schema).parquet(f"{folder}/{table}") for table, rows in tables.items()}
    broken = [rule for rule, offending in checks(written).items() if offending.take(1)]
    if broken:
        raise SetRefused("broken rules: " + ", ".join(sorted(broken)))
    files, pointers = _folder(spark, f"{root}/published")
    files.mkdirs(pointers)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_pointer")
    files.create(staged, True).close()
    taken = {p.split("-", 1)[0] for p in _pointers(spark, root)}
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/published/{number:012}-{name}")
    if f"{number:012}" in taken or not files.rename(staged, place):
        raise SetRefused("another set was published meanwhile")
    return folder


def prune_sets(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes the folders of all but the newest ``keep`` published sets, pointers first; returns their names."""
    gone = _pointers(spark, root)[: -keep or None]
    for pointer in gone:
        for path in (f"{root}/published/{pointer}", f"{root}/sets/{pointer.split('-', 1)[1]}"):
            files, where = _folder(spark, path)
            files.delete(where, True)
    return [p.split("-", 1)[1] for p in gone]


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def parentless(rows: DataFrame, parents: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key no parent has, a null key among them."""
    return rows.select(*keys).join(parents.select(*keys).distinct(), list(keys), "left_anti")
