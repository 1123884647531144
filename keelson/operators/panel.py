"""The research panel: the whole history scored again under any set of weight versions, at both grains.

Occurrences are scored for all versions in one pass; the repository grain is rolled up from their signals
alone, which are narrow, so names and paths are never dealt by scan. Unassessable occurrences are in the panel, without a score. Nothing stored is changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import kept, released
from ..sources import sinks
from .rollup import COUNTS, carded, with_points
from .scoring import is_flagged, score_occurrences
from .weights import WeightsError, versions

OCCURRENCE_COLUMNS = (
    "scan_id", "data_source", "created_on", "ecosystem", "manifest_path", "package_name", "dependency_group", "resolved_version", "resolution", "is_unassessable",
    "is_deprecated", "cvss_tenths", "vulnerability_count", "staleness_days", "used_version", "penalty", "score", "recomputed_flagged", "cvss_reduced_confidence",
)
REPOSITORY_COLUMNS = (
    "scan_id", "repository_id", "data_source", "created_on", "used_version", "dependency_count", "assessed_count", "recomputed_flagged_count", "recomputed_score",
    "recomputed_classification", "stored_score", "stored_classification", "stored_formula_version",
)

PARTS = 2


def oldest(scans: DataFrame, source: str | None = None, limit: int | None = None) -> DataFrame:
    """The scans of a data source, oldest first up to a limit where one is given."""
    chosen = scans if source is None else scans.where(F.col("data_source") == source)
    return chosen if limit is None else chosen.orderBy("created_on", "scan_id").limit(limit)


def known(wanted: Sequence[str]) -> list[str]:
    if unknown := sorted(set(wanted) - set(versions())):
        raise WeightsError(f"no such versions: {', '.join(unknown)}; there are {', '.join(versions())}")
    return list(dict.fromkeys(wanted))


def each(wanted: Sequence[str]) -> Column:
    return F.explode(F.array(*map(F.lit, wanted)))


def build(scans: DataFrame, occurrences: DataFrame, wanted: Sequence[str], *key: str, source: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrence panel, repository panel), both for every wanted version.

    ``scans``: scan_id, repository_id, data_source, created_on, stored_score, stored_classification,
    formula_version. ``key`` names an occurrence within its scan and breaks ties of rank. A version
    that cannot be loaded is an error: a panel under other weights than asked for would mislead.
    """
    chosen = oldest(scans, source, limit)
    rows = kept(occurrence_panel(occurrences.join(chosen.select("scan_id", "data_source", "created_on"), "scan_id"), wanted, *key), "panel")
    return rows, repository_panel(rolled(chosen, occurrences, wanted, *key))


def occurrence_panel(held: DataFrame, wanted: Sequence[str], *key: str) -> DataFrame:
    """Every row for every version, in one pass without a shuffle. ``held``: occurrences with data_source and created_on of their scans."""
    scored = score_occurrences(held.withColumn("own_version", each(known(wanted))), F.col("own_version"), keep=True)
    able = ~F.col("is_unassessable")
    flags = {"recomputed_flagged": able & is_flagged(), "cvss_reduced_confidence": F.coalesce("cvss_reduced_confidence", F.lit(False))}
    return scored.withColumns(flags).select(*dict.fromkeys((*OCCURRENCE_COLUMNS, *key)))


def by_version(scans: DataFrame, occurrences: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Scans with all their columns and, in a map, the deduction and the counts of each wanted version.

    Occurrences are dealt by scan once, as what a score needs and no more, before versions multiply them; they are ranked and
    counted in one pass, so nothing is dealt twice. Versions are folded where they lie, so scans meet them by scan_id alone.
    Equal penalties cost the same in any order: a sum needs no ties broken.
    """
    signals = occurrences.select("scan_id", "ecosystem", "is_unassessable", "is_deprecated", "cvss_tenths", "vulnerability_count", "staleness_days")
    rows = signals.repartition("scan_id").withColumn("own_version", each(known(wanted)))
    able, one = ~F.col("is_unassessable"), ["scan_id", "used_version"]
    scored = score_occurrences(rows, F.col("own_version"), keep=True).select(*one, "penalty", able.alias("able"), (able & is_flagged()).alias("flagged"))
    worst = Window.partitionBy(*one).orderBy(F.desc_nulls_last("penalty"))
    ranked = with_points(scored.withColumn("rank", F.row_number().over(worst) - 1), "left")
    sums = F.sum("points").cast("decimal(9,2)").alias("deduction"), F.count_if("able"), F.count_if("flagged"), F.count_if(~F.col("able"))
    cards = ranked.groupBy(*one).agg(sums[0], *[x.alias(c) for x, c in zip(sums[1:], COUNTS)])
    folded = cards.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("used_version", F.struct("deduction", *COUNTS)))).alias("cards"))
    return scans.join(folded, "scan_id", "left")


def of_version(held: DataFrame, version: Column) -> DataFrame:
    """The card of each row of ``by_version`` under one version or, where ``version`` is ``each``, under several; all columns stay."""
    one = held.withColumn("used_version", version)
    card = F.try_element_at("cards", F.col("used_version"))
    return carded(one.withColumns({c: card[c] for c in ("deduction", *COUNTS)}), *one.columns)


def rolled(scans: DataFrame, occurrences: DataFrame, wanted: Sequence[str], *key: str) -> DataFrame:
    """The roll-up of every scan under every version, beside the columns of the scan. ``key`` is not needed in a sum."""
    return of_version(by_version(scans, occurrences, wanted), each(known(wanted))).drop("cards")


def repository_panel(cards: DataFrame) -> DataFrame:
    """Scans, with their stored score, beside each of their cards as ``rolled`` gives them."""
    found = {
        "dependency_count": F.col("assessed_count") + F.col("unassessable_count"), "recomputed_flagged_count": F.col("flagged_count"), "recomputed_score": F.col("score"),
        "recomputed_classification": F.col("classification"), "stored_formula_version": F.col("formula_version"),
    }
    return cards.withColumns(found).select(*REPOSITORY_COLUMNS)


def write(occurrences: DataFrame, repositories: DataFrame, prefix: str) -> None:
    """Both panels as CSV folders and a JSON manifest with a row for each version.

    Occurrences are written in parts by scan, and what a part has shuffled is removed before the next: it is more than the panel itself.
    """
    part = F.pmod(F.xxhash64("scan_id"), F.lit(PARTS))
    with released(occurrences.sparkSession):
        for n in range(PARTS):
            sinks.write_panel(occurrences.where(part == n).select(*OCCURRENCE_COLUMNS), f"{prefix}_occurrences", "append" if n else "overwrite")
        sinks.write_panel(repositories, f"{prefix}_repositories")
    changed = F.count_if(~F.col("recomputed_score").eqNullSafe(F.col("stored_score")))
    totals = repositories.groupBy("used_version").agg(F.count("*").alias("scan_rows"), F.sum("dependency_count").alias("occurrence_rows"), changed.alias("scores_differing_from_stored"))
    totals.coalesce(1).write.mode("overwrite").json(f"{prefix}_manifest")
