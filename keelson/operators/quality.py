"""Integrity rules as violation tables: checks, unique keys, references, decision ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """One row per row and broken rule; every rule is evaluated in the same scan. Null passes a check, as in SQL."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items()])
    return rows.select(*keys, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def duplicate_keys(rows: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    held = rows if where is None else rows.where(where)
    return held.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key or key).alias(key)), key, "left_anti")


def earliest_matches(rows: DataFrame, ident: str, *keys: tuple[str, ...]) -> DataFrame:
    """The rows that agree with an earlier one (a smaller ``ident``) in all columns of one of the ``keys``, and the earliest such.

    A minimum for each key, joined back: no pairs are formed, so a class of any size costs one row a member.
    Null agrees with nothing.
    """
    found = rows
    for n, key in enumerate(keys):
        first = rows.groupBy(*key).agg(F.min(ident).alias(f"__first_{n}"))
        found = found.join(first, list(key), "left")
    firsts = [F.col(f"__first_{n}") for n in range(len(keys))]
    earliest = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    return found.withColumn("earliest", earliest).where(F.col("earliest") < F.col(ident)).select(*rows.columns, "earliest")


def matching_pairs(rows: DataFrame, ident: str, *keys: tuple[str, ...]) -> DataFrame:
    """Every pair of rows, the smaller ``ident`` first and the other as ``o_`` and its name, that agree in all columns of one of the ``keys``.

    A union of equi-joins. A pair comes from the first key in which it agrees, so pairs need no exchange
    to be distinct. Null agrees with nothing.
    """
    other = rows.select(*[F.col(c).alias(f"o_{c}") for c in rows.columns])
    found, before = None, F.lit(False)
    for key in keys:
        same = F.lit(True)
        for c in key:
            same = same & (F.col(c) == F.col(f"o_{c}"))
        pairs = rows.join(other, same & (F.col(ident) < F.col(f"o_{ident}")) & ~before).select(ident, f"o_{ident}")
        found, before = pairs if found is None else found.unionByName(pairs), before | F.coalesce(same, F.lit(False))
    return found


def first_failure(ladder: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first rule of a ladder that holds decides."""
    chain = None
    for name, holds in ladder:
        chain = F.when(holds, name) if chain is None else chain.when(holds, name)
    return chain.otherwise(otherwise)


def dedupe_advisories(advisories: DataFrame, *keys: str) -> DataFrame:
    """One advisory per key and id, the empty id skipped; counts are taken before this step."""
    return advisories.where("osv_id <> ''").dropDuplicates([*keys, "osv_id"])
