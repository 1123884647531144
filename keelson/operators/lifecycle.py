"""Status expiry, retention, sweeps, guards and decision tables. "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import ACTIVE_STATUS


# Minutes after which a scan (since it was created) or a report (since its last change) counts as dead.
SCAN_MINUTES = 15
REPORT_MINUTES = 5


def expired(status: Column, since: Column, now: Column, minutes: int) -> Column:
    """The status, or failed where an active row has not been heard of for longer than ``minutes``."""
    return F.when(status.isin(*ACTIVE_STATUS) & (since < now - F.make_interval(mins=F.lit(minutes))), "failed").otherwise(status)


def prune(scans: DataFrame, keep: DataFrame, key: str = "repository_id") -> DataFrame:
    """Scans that retention deletes: all others of the repositories named in ``keep`` (key, scan_id)."""
    touched = keep.select(key).distinct()
    return scans.join(touched, key, "left_semi").join(keep.select("scan_id"), "scan_id", "left_anti")


def cascade(children: DataFrame, deleted: DataFrame, key: str = "scan_id") -> DataFrame:
    """Rows that go with their deleted parents."""
    return children.join(deleted.select(key), key, "left_semi")


def reports_at_risk(scans: DataFrame, reports: DataFrame) -> DataFrame:
    """Completed reports over every scan of a repository, 0 where there is none."""
    done = reports.where("status = 'completed'").groupBy("repository_id").agg(F.count("*").alias("n"))
    return scans.select("repository_id").distinct().join(done, "repository_id", "left").select("repository_id", F.coalesce("n", F.lit(0)).alias("reports_at_risk"))


def start_outcome(at_risk: Column, active: Column, confirmed: Column) -> Column:
    return F.when(active.isNotNull(), "already_running").when((at_risk > 0) & ~F.coalesce(confirmed, F.lit(False)), "confirmation_needed").otherwise("started")


def sweep(collections: DataFrame, scans: DataFrame, active_reports: DataFrame) -> DataFrame:
    """What becomes of each stored collection: dropped without its scan, or without an active report."""
    marked = collections.join(scans.select("scan_id", F.lit(True).alias("has_scan")), "scan_id", "left").join(active_reports.select("scan_id").distinct().withColumn("has_report", F.lit(True)), "scan_id", "left")
    return marked.select(
        *collections.columns,
        F.when(F.col("has_scan").isNull(), "drop_orphan").when(F.col("has_report").isNull(), "drop_idle").otherwise("keep").alias("action"),
    )


def report_decision(status: Column) -> Column:
    return F.when(status == "completed", "cached").when(status.isin(*ACTIVE_STATUS), "conflict").when(status == "failed", "requeue").otherwise("create")


def history_rows(scans: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows to append to the permanent history; a scan without a score is refused by failing the job."""
    joined = scans.join(cards, "scan_id", "left")
    refused = F.when(F.col("score").isNull(), F.raise_error(F.lit("an unscored scan has no history row"))).otherwise(F.col("score"))
    return joined.withColumn("score", refused.cast("decimal(5,2)"))


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("data_source").parquet(path)


def upsert(known: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Known rows and the found ones whose key is new; one row per key."""
    fresh = found.dropDuplicates([*keys]).join(known.select(*keys), [*keys], "left_anti")
    return known.unionByName(fresh)


def updated(rows: DataFrame, fresh: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the columns of ``fresh`` in place of their own where ``fresh`` has the key; a null there counts too.

    ``fresh`` has one row a key. Doing it again changes nothing; null keys meet nothing.
    """
    columns = [c for c in fresh.columns if c not in keys]
    joined = rows.join(fresh.select(*keys, F.struct(*columns).alias("__new")), list(keys), "left")
    new = lambda c: F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c)
    return joined.select(*[new(c) if c in columns else F.col(c) for c in rows.columns])


FAILURES = {"rate_limited": "The service is busy; try again later.", "unauthorized": "Sign in again.", "timeout": "It took too long.", "invalid_payload": "The answer could not be read."}
OTHER_FAILURE = "Something went wrong."


def failure_message(kind: Column) -> Column:
    table = F.create_map(*[x for pair in FAILURES.items() for x in map(F.lit, pair)])
    return F.coalesce(F.element_at(table, kind), F.lit(OTHER_FAILURE))
