"""Rank-decayed roll-up of penalties per scan, classification, and rescoring under other weights.

Both halves shrink their rows before the exchange: the ranking keeps each task's worst rows of a
scan (its limit runs before and after), the counts are partial aggregates. So a scan of any size
is no heavy task. A scan without assessable rows scores 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scoring import is_flagged, score_occurrences, with_weights
from .weights import ACTIVE, factor_table, load, threshold_table, usable_version, versions

COUNTS = ("assessed_count", "flagged_count", "unassessable_count")


def classify(score: Column, safe_min: Column, medium_min: Column) -> Column:
    return F.when(score >= safe_min, "safe").when(score >= medium_min, "medium").otherwise("high_alert")


def ranked_points(scored: DataFrame, *tie_break: str) -> DataFrame:
    """The penalties that count, worst first, each with rank and decayed points."""
    worst = Window.partitionBy("scan_id", "used_version").orderBy(F.desc("penalty"), *tie_break)
    most = max(load(v).max_terms for v in versions())
    return with_points(scored.withColumn("rank", F.row_number().over(worst) - 1).where(F.col("rank") < most))


def with_points(ranked: DataFrame, how: str = "inner") -> DataFrame:
    """Decayed points of ranked penalties; those beyond a version's limit fall out or, with ``how`` left, have none."""
    factors = factor_table(ranked.sparkSession).withColumnRenamed("version", "f_version").withColumnRenamed("rank", "f_rank")
    # A few rows per weight version; ranks beyond a version's limit find no factor and fall out.
    kept = ranked.join(F.broadcast(factors), (F.col("used_version") == F.col("f_version")) & (F.col("rank") == F.col("f_rank")), how)
    return kept.withColumn("points", F.round(F.col("penalty") * F.col("factor"), 2).cast("decimal(7,2)")).drop("f_version", "f_rank", "factor")


def roll_up(scans: DataFrame, occurrences: DataFrame, version: Column | str = ACTIVE, tie_break: tuple[str, ...] = ("part_id", "supp_id", "line_no")) -> DataFrame:
    """Every scan and version (scan_id, used_version): deduction, score, class and counts, empty scans included."""
    each = ["scan_id", "used_version"]
    scored = score_occurrences(occurrences, version)
    deductions = ranked_points(scored, *tie_break).groupBy(*each).agg(F.sum("points").cast("decimal(9,2)").alias("deduction"))
    able = ~F.col("is_unassessable")
    counted = with_weights(occurrences, version).groupBy(*each).agg(F.count_if(able).alias("assessed_count"), F.count_if(able & is_flagged()).alias("flagged_count"), F.count_if(~able).alias("unassessable_count"))
    return carded(scans.join(deductions, each, "left").join(counted, each, "left"), *each)


def carded(joined: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the card of rows with a used_version, its deduction and its counts, which are null where a scan has no lines."""
    limits = F.broadcast(threshold_table(joined.sparkSession).withColumnRenamed("version", "used_version"))
    zero = F.lit(0).cast("decimal(9,2)")
    score = F.least(F.greatest(F.lit(100) - F.col("deduction"), F.lit(0)), F.lit(100)).cast("decimal(5,2)")
    filled = joined.join(limits, "used_version").withColumn("deduction", F.coalesce("deduction", zero)).withColumn("score", score)
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return filled.select(*columns, "deduction", "score", classify(F.col("score"), F.col("safe_min"), F.col("medium_min")).alias("classification"), *counts)


def scorecard(scans: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The roll-up of each scan under its own formula version (the active one where that is unknown)."""
    own = scans.select("scan_id", usable_version(F.col("formula_version")).alias("used_version"))
    held = occurrences.join(own.withColumnRenamed("used_version", "own_version"), "scan_id")
    return roll_up(own, held, F.col("own_version"))


def rescore(scans: DataFrame, occurrences: DataFrame, version: str, source: str | None = None, limit: int | None = None) -> DataFrame:
    """The roll-up of the whole history (or one data source, or its oldest scans) under another version."""
    chosen = scans if source is None else scans.where(F.col("data_source") == source)
    chosen = chosen if limit is None else chosen.orderBy("created_on", "scan_id").limit(limit)
    held = occurrences if source is None and limit is None else occurrences.join(chosen.select("scan_id"), "scan_id", "left_semi")
    return roll_up(chosen.select("scan_id", F.lit(version).alias("used_version")), held, version)


def rescore_panel(scans: DataFrame, occurrences: DataFrame, before: str, after: str) -> DataFrame:
    """Scans whose score changes between two versions."""
    both = F.explode(F.array(F.lit(before), F.lit(after)))
    cards = roll_up(scans.select("scan_id", both.alias("used_version")), occurrences.withColumn("own_version", both), F.col("own_version"))
    of = lambda version, column: F.max(F.when(F.col("used_version") == version, F.col(column)))
    panel = cards.groupBy("scan_id").agg(
        of(before, "score").alias("score_before"), of(before, "classification").alias("class_before"), of(after, "score").alias("score_after"), of(after, "classification").alias("class_after")
    )
    return panel.where("score_before <> score_after")


def top_contributors(occurrences: DataFrame, version: Column | str = ACTIVE, limit: int = 3) -> DataFrame:
    """Per scan the ``limit`` occurrences that cost most points, stopping at points of zero.

    The ranking is by score, path and name; it uses the active weights unless told otherwise.
    """
    scored = score_occurrences(occurrences, version)
    order = Window.partitionBy("scan_id").orderBy("score", "manifest_path", "package_name", "part_id", "line_no")
    first = scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < limit)
    factors = F.broadcast(factor_table(occurrences.sparkSession).select(F.col("version").alias("used_version"), "rank", "factor"))
    found = first.join(factors, ["used_version", "rank"]).withColumn("points", F.round(F.col("penalty") * F.col("factor"), 2).cast("decimal(7,2)"))
    return found.where("points > 0").select("scan_id", (F.col("rank") + 1).alias("position"), "package_name", "manifest_path", "score", "points")
