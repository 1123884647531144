"""The four tables of scans (packages, manifests, occurrences, advisories) as one set, and its rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.published import Tables, parentless, repeated

TABLES = ("packages", "manifests", "occurrences", "advisories")


def build(occurrences: DataFrame, advisories: DataFrame, known: DataFrame | None, *key: str) -> dict[str, DataFrame]:
    """The set of the given occurrences and of their advisories. ``key`` names an occurrence in both.

    Packages are those that are known and the new ones, one row each. Advisories without an id are
    left out, and of several of one id for one occurrence one stays, the smallest in its other fields.
    """
    packages = occurrences.select("ecosystem", "package_name").distinct()
    if known is not None:
        packages = known.select("ecosystem", "package_name").unionByName(packages).distinct()
    rest = [c for c in advisories.columns if c not in (*key, "osv_id")]
    named = advisories.where(F.trim(F.coalesce("osv_id", F.lit(""))) != "")
    once = named.groupBy(*key, "osv_id").agg(F.min(F.struct(*rest)).alias("x")).select(*key, "osv_id", "x.*")
    return {
        "packages": packages,
        "manifests": occurrences.groupBy("scan_id", "ecosystem", "manifest_path").agg(F.count("*").alias("n_occurrences")),
        "occurrences": occurrences,
        "advisories": once,
    }


def rules(*key: str):
    """Checks for ``publish``: unique keys, parents of every row, and counts that agree."""

    def offending(tables: Tables) -> Mapping[str, DataFrame]:
        packages, manifests, occurrences, advisories = (tables[name] for name in TABLES)
        counted = occurrences.groupBy("scan_id", "manifest_path").agg(F.count("*").alias("n"))
        return {
            "packages are unique": repeated(packages, "ecosystem", "package_name"),
            "manifests are unique": repeated(manifests, "scan_id", "manifest_path"),
            "occurrences are unique": repeated(occurrences, *key),
            "advisories are unique": repeated(advisories, *key, "osv_id"),
            "occurrences have packages": parentless(occurrences, packages, "ecosystem", "package_name"),
            "occurrences have manifests": parentless(occurrences, manifests, "scan_id", "manifest_path"),
            "advisories have occurrences": parentless(advisories, occurrences, *key),
            "manifests count occurrences": manifests.join(counted, ["scan_id", "manifest_path"], "left").where("n IS NULL OR n <> n_occurrences"),
        }

    return offending
