"""What is served: rows of occurrences, snapshots, report look-ups and guards, and projects with their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import REPORT_MINUTES, expired, report_decision

# The fields of a listed occurrence with the columns they come from, and the columns of a snapshot.
OCCURRENCE_FIELDS = {
    "id": "occurrence_id", "packageName": "package_name", "ecosystem": "ecosystem", "registryUrl": "registry_url", "manifestPath": "manifest_path", "group": "dependency_group",
    "declaredSpecifier": "declared_specifier", "resolvedVersion": "resolved_version", "resolution": "resolution", "latestVersion": "latest_version", "latestReleaseAt": "latest_release_at",
    "stalenessDays": "staleness_days", "versionsBehind": "versions_behind", "isDeprecated": "is_deprecated", "deprecationReason": "deprecation_reason", "isUnassessable": "is_unassessable",
    "unassessableReason": "unassessable_reason", "vulnerabilityCount": "vulnerability_count", "highestSeverity": "highest_severity", "cvssMax": "cvss_max", "isFlagged": "is_flagged",
    "riskComponentScore": "risk_component_score", "cvssReducedConfidence": "cvss_reduced_confidence", "report": "report",
}
SNAPSHOT_COLUMNS = (
    "ecosystem", "package_name", "manifest_path", "dependency_group", "declared_specifier", "resolved_version", "resolution", "latest_version", "staleness_days", "versions_behind_major",
    "versions_behind_minor", "versions_behind_patch", "is_deprecated", "deprecation_reason", "vulnerability_count", "highest_severity", "cvss_max", "is_unassessable", "risk_component_score",
)
LEAST_MEMBERS = 2


def versions_behind() -> Column:
    return F.struct(*[F.col(f"behind_{x}").cast("int").alias(x) for x in ("major", "minor", "patch")]).alias("versions_behind")


def occurrence_rows(rows: DataFrame) -> DataFrame:
    """The 24 fields of a listed occurrence; ``report`` is a struct or null, ``versions_behind`` a struct."""
    return rows.select(*[F.col(source).alias(name) for name, source in OCCURRENCE_FIELDS.items()])


def snapshot(rows: DataFrame, history: str) -> DataFrame:
    """The 20 columns kept of an occurrence for good, the id of its history row first; nothing in it refers to tables that change."""
    spread = rows.withColumns({f"versions_behind_{x}": F.col(f"versions_behind.{x}") for x in ("major", "minor", "patch")})
    return spread.select(F.col(history).alias("scan_history_id"), *SNAPSHOT_COLUMNS)


def report_key(kind: Column, scan: Column, dependency: Column) -> Column:
    """combined:<scan>, or per_dependency:<scan>:<dependency>."""
    return F.when(kind == "combined", F.concat_ws(":", kind, scan.cast("string"))).otherwise(F.concat_ws(":", kind, scan.cast("string"), dependency.cast("string")))


def current_reports(reports: DataFrame, now: Column) -> DataFrame:
    """The report that is read under each key: the newest, after those that were not heard of for five minutes have failed.

    ``reports``: report_id, report_type, scan_id, dependency_id, status, created_at, updated_at. Of one time the larger id counts.
    """
    status = expired(F.col("status"), F.col("updated_at"), now, REPORT_MINUTES)
    keyed = reports.select(report_key(F.col("report_type"), F.col("scan_id"), F.col("dependency_id")).alias("report_key"), "report_id", status.alias("status"), "created_at")
    newest = keyed.groupBy("report_key").agg(F.max(F.struct("created_at", "report_id", "status")).alias("r"))
    return newest.select("report_key", "r.report_id", "r.status")


def request_outcome(kind: Column, scan_status: Column, is_unassessable: Column, is_flagged: Column, report_status: Column) -> Column:
    """What asking for a report does. A dependency must be assessable and flagged, then its scan completed, and then what is stored decides."""
    single = kind == "per_dependency"
    return (
        F.when(single & F.coalesce(is_unassessable, F.lit(True)), "not_assessed")
        .when(single & ~F.coalesce(is_flagged, F.lit(False)), "not_flagged")
        .when(F.coalesce(scan_status != "completed", F.lit(True)), "scan_not_reportable")
        .otherwise(report_decision(report_status))
    )


def project_members(repositories: DataFrame, states: DataFrame) -> DataFrame:
    """Per project its members by full name, each with the state of its newest scan and its newest completed one.

    ``states``: repository_id, latest_scan_id, latest_status, latest_completed_id. Repositories without a project are in none.
    """
    member = F.struct("full_name", "repository_id", "latest_scan_id", "latest_status", "latest_completed_id")
    held = repositories.where("project_id IS NOT NULL").join(states, "repository_id", "left")
    return held.groupBy("user_id", "project_id").agg(F.sort_array(F.collect_list(member)).alias("members"))


def ungroup(repositories: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repositories without the given projects, how many members each project had, 0 included). Nothing else changes."""
    named = gone.select("user_id", "project_id").distinct()
    marked = repositories.join(named.withColumn("__gone", F.lit(True)), ["user_id", "project_id"], "left")
    free = marked.withColumn("project_id", F.when(F.col("__gone").isNull(), F.col("project_id"))).select(*repositories.columns)
    counted = repositories.join(named, ["user_id", "project_id"], "left_semi").groupBy("user_id", "project_id").agg(F.count("*").alias("n"))
    return free, named.join(counted, ["user_id", "project_id"], "left").select("user_id", "project_id", F.coalesce("n", F.lit(0)).alias("kept"))


def deletion(repositories: DataFrame, asked: DataFrame) -> DataFrame:
    """What each request to delete a repository does.

    ``asked``: repository_id and confirm, the project that the reader agreed to lose or null. A member of
    a project of two or more takes all of them with it, and only if confirmed by the project's own id;
    otherwise the answer has the counts and the members' full names, sorted. Gives repository_id, outcome
    (missing, deleted, confirm_project), deleted, member_count, other_count, names.
    """
    groups = repositories.where("project_id IS NOT NULL").groupBy("user_id", "project_id").agg(F.count("*").alias("member_count"), F.sort_array(F.collect_list("full_name")).alias("names"))
    own = repositories.select("repository_id", "user_id", "project_id", F.lit(True).alias("__known"))
    joined = asked.select("repository_id", "confirm").join(own, "repository_id", "left").join(groups, ["user_id", "project_id"], "left")
    alone = F.col("project_id").isNull() | (F.col("member_count") < LEAST_MEMBERS)
    agreed = F.col("confirm").eqNullSafe(F.col("project_id"))
    asks = ~alone & ~agreed
    outcome = F.when(F.col("__known").isNull(), "missing").when(asks, "confirm_project").otherwise("deleted")
    return joined.select(
        "repository_id",
        outcome.alias("outcome"),
        F.when(outcome != "deleted", 0).when(alone, 1).otherwise(F.col("member_count")).cast("long").alias("deleted"),
        F.when(outcome == "confirm_project", F.col("member_count")).alias("member_count"),
        F.when(outcome == "confirm_project", F.col("member_count") - 1).alias("other_count"),
        F.when(outcome == "confirm_project", F.col("names")).alias("names"),
    )


MOST_NAME = 80


def project_creation(asked: DataFrame, repositories: DataFrame) -> DataFrame:
    """What each request for a new project does; the first refusal counts.

    ``asked``: request_id, user_id, name, ids (texts). In order: the name, white space collapsed, is there and
    not too long; two ids at least are given; each is a number; two of them differ; all are repositories of
    the user; none is in a project. Gives request_id, outcome, name, and the full names of members that are in one.
    """
    name = F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+", " "))
    given = asked.select("request_id", "user_id", name.alias("name"), "ids", F.array_distinct(F.transform("ids", lambda x: F.trim(x).try_cast("long"))).alias("__ids"))
    wanted = given.select("request_id", "user_id", F.explode("__ids").alias("repository_id"))
    met = wanted.join(repositories.select("repository_id", "user_id", "project_id", "full_name"), ["user_id", "repository_id"])
    held = met.groupBy("request_id").agg(F.count_distinct("repository_id").alias("n"), F.array_compact(F.sort_array(F.collect_list(F.when(F.col("project_id").isNotNull(), F.col("full_name"))))).alias("grouped"))
    joined = given.join(held, "request_id", "left")
    count, distinct = F.greatest(F.coalesce(F.size("ids"), F.lit(0)), F.lit(0)), F.size("__ids")
    outcome = (
        F.when(F.col("name") == "", "name_required")
        .when(F.char_length("name") > MOST_NAME, "name_too_long")
        .when(count < LEAST_MEMBERS, "too_small")
        .when(F.exists("__ids", lambda x: x.isNull()), "unknown_repository")
        .when(distinct < LEAST_MEMBERS, "too_small")
        .when(F.coalesce("n", F.lit(0)) != distinct, "unknown_repository")
        .when(F.size("grouped") > 0, "already_grouped")
        .otherwise("created")
    )
    return joined.select("request_id", outcome.alias("outcome"), "name", F.when(outcome == "already_grouped", F.col("grouped")).alias("grouped"))


def registration(ladder: Column, scan_failure: Column) -> Column:
    """struct<outcome, scan>: a registration's outcome, and what became of the first scan of a created one; its failure is no failure of the registration."""
    return F.struct(ladder.alias("outcome"), F.when(ladder == "created", F.when(scan_failure.isNull(), "queued").otherwise("not_started")).alias("scan"))
