"""Counts, latest-per-group, history, listing and dashboard operators.

Latest-per-group is an aggregate of a struct (partial before the exchange), never a window over a
whole group; a scan id breaks ties of time, where the source system left them open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import kept, shared_path


def scan_counts(occurrences: DataFrame) -> DataFrame:
    """Manifests, and occurrences as unassessable, flagged and clean; the last three add up."""
    return occurrences.groupBy("scan_id").agg(
        F.count_distinct("manifest_path").alias("manifest_count"),
        F.count("*").alias("dependency_count"),
        F.count_if("is_unassessable").alias("unassessable_count"),
        F.count_if(~F.col("is_unassessable") & F.col("is_flagged")).alias("flagged_count"),
        F.count_if(~F.col("is_unassessable") & ~F.col("is_flagged")).alias("clean_count"),
    )


def manifest_counts(manifests: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Occurrences per manifest, 0 for an empty one. Rows of ``manifests`` that name one manifest are one; null meets nothing.

    One aggregate of both tables, so a task holds one table of groups and sorts nothing.
    """
    key = ["scan_id", "manifest_path"]
    both = manifests.select(*key, F.lit(True).alias("listed")).unionByName(occurrences.select(*key, F.lit(False).alias("listed")))
    able = ~F.col("listed") & F.col("scan_id").isNotNull() & F.col("manifest_path").isNotNull()
    counted = both.groupBy(*key).agg(F.count_if(able).alias("dependency_count"), F.bool_or("listed").alias("listed"))
    return counted.where("listed").drop("listed")


SEVERITY_RANK = {"unknown": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def severity(tenths: Column) -> Column:
    return F.when(tenths >= 90, "critical").when(tenths >= 70, "high").when(tenths >= 40, "medium").when(tenths >= 0, "low")


def advisory_roll_up(advisories: DataFrame, *keys: str) -> DataFrame:
    """Count, highest CVSS and highest severity by rank; a null severity is unknown."""
    word = F.coalesce(severity(F.col("cvss_tenths")), F.lit("unknown"))
    rank = F.create_map(*[x for pair in SEVERITY_RANK.items() for x in map(F.lit, pair)])
    return advisories.groupBy(*keys).agg(F.count("*").alias("vulnerability_count"), F.max("cvss_tenths").alias("cvss_max_tenths"), F.max_by(word, F.element_at(rank, word)).alias("highest_severity"))


def latest_state(scans: DataFrame) -> DataFrame:
    """Per repository: its newest scan of any status, and its newest completed one."""
    when = F.struct("created_on", "scan_id")
    newest = F.max(F.struct(when.alias("w"), F.col("status").alias("status")))
    return scans.groupBy("repository_id").agg(newest.alias("n"), F.max(F.when(F.col("status") == "completed", when)).alias("c")).select(
        "repository_id", F.col("n.w.scan_id").alias("latest_scan_id"), F.col("n.status").alias("latest_status"), F.col("c.scan_id").alias("latest_completed_id")
    )


def latest_completed(scans: DataFrame) -> DataFrame:
    return scans.where("status = 'completed'").groupBy("repository_id").agg(F.max_by("scan_id", F.struct("created_on", "scan_id")).alias("scan_id"))


def placed(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Adds ``position``, the place of a row in its group from 1. ``order`` leaves no ties; null is a group too.

    Rows are written range-partitioned by group and order; a place is that within the range, plus what
    the group has in the ranges before it. So a large group is many tasks' work.
    """
    path = shared_path(rows.sparkSession, "placed")
    rows.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    kept = rows.sparkSession.read.parquet(path)
    sums = kept.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*[F.col(c).alias(f"__a_{c}") for c in (*group, "__range")], F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__ahead"))
    inside = kept.withColumn("__place", F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order)))
    same = F.col("__range") == F.col("__a___range")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__a_{c}"))
    return inside.join(ahead, same).select(*rows.columns, (F.col("__ahead") + F.col("__place")).cast("int").alias("position"))


ACTIVE_STATUS = ("queued", "running")


def active_scans(scans: DataFrame, now: Column, minutes: int) -> DataFrame:
    """The newest active scan of each repository, by ``created_at``, that is not older than so many minutes."""
    live = scans.where(F.col("status").isin(*ACTIVE_STATUS) & (F.col("created_at") >= now - F.make_interval(mins=F.lit(minutes))))
    return live.groupBy("repository_id").agg(F.max_by("scan_id", F.struct("created_at", "scan_id")).alias("scan_id"))


def history_window(history: DataFrame, newest: int = 200) -> DataFrame:
    """Per repository the newest rows, numbered from the oldest of them, with the total before the cut."""
    by = Window.partitionBy("repository_id")
    down = by.orderBy(F.desc("created_on"), F.desc("scan_id"))
    total = history.groupBy("repository_id").agg(F.count("*").alias("total"))
    kept = history.withColumn("back", F.row_number().over(down)).where(F.col("back") <= newest)
    numbered = kept.withColumn("position", F.row_number().over(by.orderBy("created_on", "scan_id")))
    return numbered.join(total, "repository_id").drop("back")


def formula_changes(history: DataFrame) -> DataFrame:
    """Marks the points whose formula version differs from the point before; the first is none."""
    by_time = Window.partitionBy("repository_id").orderBy("created_on", "scan_id")
    before = F.lag("formula_version").over(by_time)
    return history.withColumn("previous_version", before).withColumn("changed", F.coalesce(before != F.col("formula_version"), F.lit(False)))


def version_order(history: DataFrame) -> DataFrame:
    """Formula versions per repository in the order in which they first appear."""
    first = history.groupBy("repository_id", "formula_version").agg(F.min(F.struct("created_on", "scan_id")).alias("at"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "formula_version"))), lambda x: x["formula_version"])
    return first.groupBy("repository_id").agg(F.array_join(listed, ",").alias("versions"))


def trend(history: DataFrame, value: str) -> DataFrame:
    """Evenly spaced positions by scan order, with the first and last value of the line."""
    by_time = Window.partitionBy("repository_id").orderBy("created_on", "scan_id")
    whole = by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return history.select(
        "repository_id",
        "scan_id",
        (F.row_number().over(by_time) - 1).alias("step"),
        (F.count("*").over(whole) - 1).alias("last_step"),
        F.first(value).over(whole).alias("first_value"),
        F.last(value).over(whole).alias("last_value"),
    )


def page(rows: DataFrame, per_page: int, number: int, *order: Column) -> DataFrame:
    """One page of a fully ordered listing; order, offset and limit become a bounded top-k."""
    return rows.orderBy(*order).offset(per_page * (number - 1)).limit(per_page)


def tri_state(column: Column, wanted: bool | None) -> Column:
    return F.lit(True) if wanted is None else column == F.lit(wanted)


def parse_tri_state(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off"), False)


def owned(rows: DataFrame, user: int | None, column: str = "user_id") -> DataFrame:
    """Rows of one owner; nobody owns nothing."""
    return rows.where(F.lit(False)) if user is None else rows.where(F.col(column) == user)


def status_label() -> Column:
    return F.when(F.col("is_unassessable"), "unassessable").when(F.col("is_flagged"), "flagged").otherwise("clean")


def ecosystem_list(scans: DataFrame, occurrences: DataFrame, manifests: DataFrame) -> DataFrame:
    """Sorted ecosystems of a scan's occurrences, or of its manifests where it has none."""
    names = lambda df, alias: df.groupBy("scan_id").agg(F.array_join(F.sort_array(F.collect_set("ecosystem")), ",").alias(alias))
    found = scans.select("scan_id").join(names(occurrences, "own"), "scan_id", "left").join(names(manifests, "listed"), "scan_id", "left")
    return found.select("scan_id", F.coalesce("own", "listed", F.lit("")).alias("ecosystems"))


def ecosystem_summary(occurrences: DataFrame) -> DataFrame:
    per = occurrences.groupBy("scan_id").agg(F.count_distinct("ecosystem").alias("n"), F.min("ecosystem").alias("one"))
    return per.select("scan_id", F.when(F.col("n") > 1, "Mixed").otherwise(F.col("one")).alias("summary"))


STATUS_RANK = {"flagged": 0, "unassessable": 1, "clean": 2}
MOST_LINES = 40


def sibling_lines(members: DataFrame, latest: DataFrame, occurrences: DataFrame, subject: Column | None = None, most: int = MOST_LINES) -> DataFrame:
    """Occurrences in the latest completed scans of a subject's siblings that use one of its flagged packages: the first
    ``most`` of each subject by package, sibling, status and path, and how many more there are. Every member is a subject unless told otherwise.

    Siblings share project and owner with the subject. Of each package only the lines that can be among
    the first of some subject go on to meet the subjects: ``most`` lines of each of the first ``most`` + 1
    repositories, as a subject passes over its own. How many there are in all is counted before: the
    package's lines less the subject's own.
    """
    group = ["project_id", "user_id", "ecosystem", "package_name"]
    at = members.join(latest.select("repository_id", "scan_id"), "repository_id")
    # Five steps use these lines, so they are made once; a step then holds its own sort and no more.
    lines = kept(occurrences.join(at, "scan_id"), "sibling-lines")
    chosen = lines if subject is None else lines.where(subject)
    wanted = chosen.where("is_flagged AND NOT is_unassessable").select(F.col("repository_id").alias("subject_id"), *group).distinct()

    own = lines.groupBy(*group, "repository_id", "full_name").agg(F.count("*").alias("n_own"))
    by_package = Window.partitionBy(*group)
    first = own.withColumn("__r", F.row_number().over(by_package.orderBy("full_name", "repository_id"))).where(F.col("__r") <= most + 1).select(*group, "repository_id")
    rank = F.create_map(*[x for pair in STATUS_RANK.items() for x in map(F.lit, pair)])
    place = [F.element_at(rank, F.col("status")), "manifest_path", "part_id", "line_no"]
    inside = Window.partitionBy(*group, "repository_id").orderBy(*place)
    heads = lines.withColumn("__n", F.row_number().over(inside)).where(F.col("__n") <= most).drop("__n").join(first, [*group, "repository_id"], "left_semi")

    total = own.groupBy(*group).agg(F.sum("n_own").alias("n_all"))
    mine = own.select(*group, F.col("repository_id").alias("subject_id"), "n_own")
    counted = wanted.join(total, group).join(mine, [*group, "subject_id"], "left").groupBy("subject_id").agg(F.sum(F.col("n_all") - F.coalesce("n_own", F.lit(0))).alias("total"))
    met = heads.join(wanted, group).where("repository_id <> subject_id")
    order = Window.partitionBy("subject_id").orderBy("package_name", "full_name", *place)
    best = met.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    return best.join(counted, "subject_id").withColumn("omitted", F.greatest(F.col("total") - most, F.lit(0))).drop("total")


MOST_PROMPT_ROWS = 30


def worst_first(scored: DataFrame, *order: str, most: int = MOST_PROMPT_ROWS) -> DataFrame:
    """Per scan the ``most`` worst rows for a prompt with their position, and how many are left out. ``scored``: flagged rows."""
    ranked = F.row_number().over(Window.partitionBy("scan_id").orderBy("score", *order))
    total = scored.groupBy("scan_id").agg(F.count("*").alias("total"))
    kept = scored.withColumn("position", ranked).where(F.col("position") <= most)
    return kept.join(total, "scan_id").withColumn("omitted", F.greatest(F.col("total") - most, F.lit(0))).drop("total")


def with_report(occurrences: DataFrame, reports: DataFrame, *keys: str) -> DataFrame:
    """Each occurrence with the state of its newest report on it alone, null where it has none.

    Reports are cut to that kind and to three fields before the join, so no document is moved. Of reports
    of one time the larger id counts.
    """
    own = reports.where("report_type = 'per_dependency'")
    newest = own.groupBy(*keys).agg(F.max(F.struct("created_on", "report_id", "status", "generated_on")).alias("r"))
    state = newest.select(*keys, F.struct("r.report_id", "r.status", "r.generated_on").alias("report"))
    return occurrences.join(state, list(keys), "left")


#: How each kind of row is listed where nothing else is asked for; the last column breaks ties.
DEFAULT_ORDER = {
    "scan": ("-created_on", "-scan_id"),
    "manifest": ("manifest_path",),
    "package": ("ecosystem", "package_name"),
    "occurrence": ("manifest_path", "package_name", "part_id", "supp_id", "line_no"),
    "advisory": ("osv_id", "i"),
    "repository": ("-registered_on", "-repository_id"),
    "project": ("name", "created_on", "project_id"),
}


def default_order(kind: str) -> list[Column]:
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first() for c in DEFAULT_ORDER[kind]]


def listed(rows: DataFrame, kind: str, parent: str) -> DataFrame:
    """Position from 1 of each row in the list of its parent. Parents bound the lists; there is no order over a whole table."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(parent).orderBy(*default_order(kind))))
