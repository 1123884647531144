"""Counts, latest state, history, listings, dashboards and sibling context as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Query
from ..operators import analytics as a
from ..operators import rollup, scoring
from ..operators.weights import threshold_table
from ..session import kept
from .fixtures import KEY, TODAY, advisory, occurrence, repository, scan_run, table, with_views
from .scoring_queries import CLASS_SQL, KEYS, cents, rolled_sql

FLAG_SQL = "(is_deprecated OR vulnerability_count > 0 OR coalesce(staleness_days >= 730, false))"
NOW = "1998-12-01"


def clocked(scans: DataFrame) -> DataFrame:
    """Scans with the minute at which they were created: in the half hour before ``NOW``."""
    return scans.withColumn("created_at", F.lit(NOW).cast("timestamp") - F.make_interval(mins=(F.col("scan_id") * 7 % 30).cast("int")))


CLOCKED = f"clocked AS (SELECT *, TIMESTAMP '{NOW}' - to_minutes((scan_id * 7 % 30)::INT) AS created_at FROM scan_run)"


def flagged(spark: SparkSession, sf_dir: str, named: bool = True, scans: DataFrame | None = None) -> DataFrame:
    """Occurrences, of the given scans or of all, with their flag; an unassessable one is never flagged."""
    rows = occurrence(spark, sf_dir, named, scans).withColumn("stale_flag_days", F.lit(730))
    return rows.withColumn("is_flagged", ~F.col("is_unassessable") & scoring.is_flagged())


FLAGGED = f"flagged AS (SELECT *, NOT is_unassessable AND {FLAG_SQL} AS is_flagged FROM occurrence)"


def q_scan_counts(spark, sf_dir):
    return a.scan_counts(flagged(spark, sf_dir, named=False))


def q_count_totals(spark, sf_dir):
    return flagged(spark, sf_dir, named=False).agg(
        F.count("*").alias("total"), F.count_if("is_unassessable").alias("unassessable"), F.count_if("is_flagged").alias("flagged"), (F.count("*") - F.count_if("is_unassessable") - F.count_if("is_flagged")).alias("clean")
    )


def q_manifest_counts(spark, sf_dir):
    rows = occurrence(spark, sf_dir, named=False)
    return a.manifest_counts(rows.select("scan_id", "manifest_path"), rows.where("line_no <= 3"))


def q_advisory_roll_up(spark, sf_dir):
    return a.advisory_roll_up(advisory(spark, sf_dir), *KEY)


def q_latest_state(spark, sf_dir):
    return a.latest_state(scan_run(spark, sf_dir))


def q_active_scans(spark, sf_dir):
    return a.active_scans(clocked(scan_run(spark, sf_dir)), F.lit(NOW).cast("timestamp"), 15)


def q_history_window(spark, sf_dir):
    done = scan_run(spark, sf_dir).where("status = 'completed' AND data_source = 'live_scan'").withColumnRenamed("created_on", "day").withColumn("created_on", F.col("day"))
    return a.history_window(done.drop("day")).select("repository_id", "scan_id", "position", "total")


def q_formula_changes(spark, sf_dir):
    done = scan_run(spark, sf_dir).where("status = 'completed'")
    return a.formula_changes(done).select("repository_id", "scan_id", "formula_version", "previous_version", "changed")


def q_version_order(spark, sf_dir):
    return a.version_order(scan_run(spark, sf_dir).where("status = 'completed'"))


def q_history_thresholds(spark, sf_dir):
    limits = F.broadcast(threshold_table(spark))
    done = scan_run(spark, sf_dir).where("status = 'completed'")
    return done.join(limits, done["formula_version"] == limits["version"], "left").select("scan_id", "formula_version", "safe_min", "medium_min")


def q_trend(spark, sf_dir):
    done = scan_run(spark, sf_dir).where("status = 'completed'")
    return a.trend(done, "scan_id")


def q_dependency_page(spark, sf_dir):
    rows = flagged(spark, sf_dir).withColumn("status", a.status_label())
    found = a.page(rows, 50, 3, F.col("is_unassessable"), F.col("manifest_path"), F.col("package_name"), F.col("scan_id"), F.col("part_id"), F.col("line_no"))
    return found.select(*KEY, "ecosystem", "manifest_path", "package_name", "resolved_version", "resolution", "status")


def q_flagged_tab(spark, sf_dir):
    return flagged(spark, sf_dir).where(a.tri_state(F.col("is_flagged"), True) & a.tri_state(F.col("is_unassessable"), None)).select(*KEY, "package_name")


def q_unassessable_tab(spark, sf_dir):
    return flagged(spark, sf_dir).where(a.tri_state(F.col("is_unassessable"), True)).select(*KEY, "package_name")


def q_tri_state(spark, sf_dir):
    words = F.element_at(F.array(*[F.lit(w) for w in ("1", " TRUE ", "no", "off", "maybe", "")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", words.alias("word")).select("event_id", a.parse_tri_state(F.col("word")).alias("wanted"))


def q_owner_scoped(spark, sf_dir):
    repos = a.owned(repository(spark, sf_dir), 2)
    return repos.join(scan_run(spark, sf_dir), "repository_id").select("repository_id", "scan_id", "status")


def q_live_history(spark, sf_dir):
    return scan_run(spark, sf_dir).where("data_source = 'live_scan' AND status = 'completed'").select("scan_id", "repository_id", F.col("created_on").cast("string").alias("created_on"))


def q_ecosystem_list(spark, sf_dir):
    rows = occurrence(spark, sf_dir, named=False)
    manifests = rows.select("scan_id", F.col("ecosystem"))
    return a.ecosystem_list(scan_run(spark, sf_dir), rows.where("line_no = 1"), manifests)


def q_ecosystem_summary(spark, sf_dir):
    return a.ecosystem_summary(occurrence(spark, sf_dir, named=False))


def _latest_cards(spark, sf_dir):
    scans, rows = scan_run(spark, sf_dir), flagged(spark, sf_dir, named=False)
    newest = a.latest_state(scans).where("latest_status = 'completed'").select("repository_id", F.col("latest_scan_id").alias("scan_id"))
    # Only the newest scans are scored and counted.
    shown = newest.select("scan_id")
    cards = rollup.rescore(shown, occurrence(spark, sf_dir, named=False).join(shown, "scan_id", "left_semi"), "v2").select("scan_id", "score")
    return newest.join(cards, "scan_id").join(a.scan_counts(rows.join(shown, "scan_id", "left_semi")), "scan_id", "left")


def q_dashboard_totals(spark, sf_dir):
    repos = repository(spark, sf_dir).join(_latest_cards(spark, sf_dir), "repository_id", "left")
    return repos.groupBy("user_id").agg(
        F.count("*").alias("repositories"),
        F.count_distinct("owner").alias("owners"),
        F.coalesce(F.sum("dependency_count"), F.lit(0)).alias("dependencies"),
        F.coalesce(F.sum("unassessable_count"), F.lit(0)).alias("unassessable"),
        F.floor(F.sum((F.col("score") * 100).cast("long")) / (F.count("score") * 100) + 0.5).cast("long").alias("mean_score"),
    )


def q_projects_grouping(spark, sf_dir):
    """Members of projects with their place; the independent repositories of an owner are one group more."""
    repos = repository(spark, sf_dir).select("user_id", "project_id", "repository_id", "name")
    return a.placed(repos, ("user_id", "project_id"), ("name", "repository_id")).drop("name")


def _siblings(spark, sf_dir):
    members = repository(spark, sf_dir).where("project_id IS NOT NULL")
    latest = kept(a.latest_completed(scan_run(spark, sf_dir)).join(members.select("repository_id"), "repository_id", "left_semi"), "latest")
    # One scan a repository: the others' lines are left before names are given.
    rows = flagged(spark, sf_dir, scans=latest.select("scan_id")).withColumn("status", a.status_label())
    return a.sibling_lines(members, latest, rows.select("scan_id", "part_id", "line_no", "ecosystem", "package_name", "manifest_path", "status", "is_flagged", "is_unassessable"))


def q_sibling_context(spark, sf_dir):
    return _siblings(spark, sf_dir).select("subject_id", "position", "package_name", "full_name", "status", "manifest_path", "omitted")


def q_siblings_not_scanned(spark, sf_dir):
    members = repository(spark, sf_dir).where("project_id IS NOT NULL")
    latest = a.latest_completed(scan_run(spark, sf_dir))
    joined = members.join(latest, "repository_id", "left")
    return joined.groupBy("project_id", "user_id").agg(F.count("scan_id").alias("compared"), F.count_if(F.col("scan_id").isNull()).alias("not_scanned"))


def q_worst_first(spark, sf_dir):
    """Per scan the 30 worst flagged occurrences for a prompt, and how many are left out."""
    scored = scoring.score_occurrences(occurrence(spark, sf_dir)).where(scoring.is_flagged())
    return a.worst_first(scored, "manifest_path", "package_name", "part_id", "line_no").select("scan_id", "position", "package_name", cents("score"), "omitted")


def _ordered_advisories(spark, sf_dir, null_as_zero: bool, most: int | None = None):
    rows = advisory(spark, sf_dir)
    rank = F.coalesce("cvss_tenths", F.lit(0 if null_as_zero else -1))
    listed = F.sort_array(F.collect_list(F.struct((-rank).alias("r"), "osv_id", "cve_id")))
    grouped = rows.groupBy(*KEY).agg(listed.alias("all"))
    shown = F.col("all") if most is None else F.slice("all", 1, most)
    ids = lambda x: F.coalesce(x["cve_id"], x["osv_id"])
    return grouped.select(
        *KEY,
        F.array_join(F.transform(shown, lambda x: x["osv_id"]), ",").alias("osv_ids"),
        F.array_join(F.array_distinct(F.transform(shown, ids)), ",").alias("cves"),
    )


def q_advisory_order_a(spark, sf_dir):
    return _ordered_advisories(spark, sf_dir, False)


def q_advisory_order_b(spark, sf_dir):
    return _ordered_advisories(spark, sf_dir, True, 5)


def q_wide_join(spark, sf_dir):
    """Occurrence, scan and repository with their project, as one row."""
    scans = scan_run(spark, sf_dir).select("scan_id", "repository_id", "status")
    return occurrence(spark, sf_dir).join(scans, "scan_id").join(repository(spark, sf_dir), "repository_id").groupBy("user_id", "project_id", "status").agg(F.count("*").alias("occurrences"), F.count_distinct("package_name").alias("packages"))


def q_props(spark, sf_dir):
    value = F.expr("try_variant_get(try_parse_json(props), '$.k', 'int')")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(value).alias("total"), F.max(value).alias("top"))


_ORDER = "ORDER BY created_on, scan_id"
_ADVISORIES = "array_to_string(list(osv_id ORDER BY {rank} DESC, osv_id){cut}, ',')"
QUERIES = {
    "scan_count_partition": Query(
        q_scan_counts,
        with_views(FLAGGED + """
SELECT scan_id, count(DISTINCT manifest_path) AS manifest_count, count(*) AS dependency_count, count(*) FILTER (WHERE is_unassessable) AS unassessable_count,
       count(*) FILTER (WHERE is_flagged) AS flagged_count, count(*) FILTER (WHERE NOT is_flagged AND NOT is_unassessable) AS clean_count FROM flagged GROUP BY scan_id""", "occurrence"),
        "A01 A02 A08",
    ),
    "count_totals": Query(
        q_count_totals,
        with_views(FLAGGED + """
SELECT count(*) AS total, count(*) FILTER (WHERE is_unassessable) AS unassessable, count(*) FILTER (WHERE is_flagged) AS flagged,
       count(*) FILTER (WHERE NOT is_flagged AND NOT is_unassessable) AS clean FROM flagged""", "occurrence"),
        "A04",
    ),
    "manifest_dependency_counts": Query(
        q_manifest_counts,
        with_views("SELECT scan_id, manifest_path, count(*) FILTER (WHERE line_no <= 3) AS dependency_count FROM occurrence GROUP BY ALL", "occurrence"),
        "A03",
    ),
    "advisory_rollup": Query(
        q_advisory_roll_up,
        with_views(f"""SELECT {KEYS}, count(*) AS vulnerability_count, max(cvss_tenths) AS cvss_max_tenths,
       CASE WHEN max(cvss_tenths) >= 90 THEN 'critical' WHEN max(cvss_tenths) >= 70 THEN 'high' WHEN max(cvss_tenths) >= 40 THEN 'medium'
            WHEN max(cvss_tenths) >= 0 THEN 'low' ELSE 'unknown' END AS highest_severity FROM advisory GROUP BY {KEYS}""", "advisory"),
        "A05 FN11 FN12",
    ),
    "latest_scan_state": Query(
        q_latest_state,
        with_views("""SELECT repository_id, arg_max(scan_id, (created_on, scan_id)) AS latest_scan_id, arg_max(status, (created_on, scan_id)) AS latest_status,
       arg_max(scan_id, (created_on, scan_id)) FILTER (WHERE status = 'completed') AS latest_completed_id FROM scan_run GROUP BY repository_id""", "scan_run"),
        "W02 W03 W04",
    ),
    "active_scans": Query(
        q_active_scans,
        with_views(f"""{CLOCKED}
SELECT repository_id, arg_max(scan_id, (created_at, scan_id)) AS scan_id FROM clocked
WHERE status IN ('queued', 'running') AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE GROUP BY repository_id""", "scan_run"),
        "W05",
    ),
    "score_history_window": Query(
        q_history_window,
        with_views("""ranked AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_on DESC, scan_id DESC) AS back, count(*) OVER (PARTITION BY repository_id) AS total
  FROM scan_run WHERE status = 'completed' AND data_source = 'live_scan')
SELECT repository_id, scan_id, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY created_on, scan_id) AS INT) AS position, total FROM ranked WHERE back <= 200""", "scan_run"),
        "W06 A10 P05",
    ),
    "formula_change_markers": Query(
        q_formula_changes,
        with_views(f"""SELECT repository_id, scan_id, formula_version, lag(formula_version) OVER w AS previous_version, coalesce(lag(formula_version) OVER w <> formula_version, false) AS changed
FROM scan_run WHERE status = 'completed' WINDOW w AS (PARTITION BY repository_id {_ORDER})""", "scan_run"),
        "W07",
    ),
    "version_order": Query(
        q_version_order,
        with_views("""firsts AS (SELECT repository_id, formula_version, min((created_on, scan_id)) AS first_at FROM scan_run WHERE status = 'completed' GROUP BY ALL)
SELECT repository_id, string_agg(formula_version, ',' ORDER BY first_at) AS versions FROM firsts GROUP BY repository_id""", "scan_run"),
        "W13 W09",
    ),
    "history_thresholds": Query(
        q_history_thresholds, with_views("SELECT scan_id, formula_version, 80 AS safe_min, 50 AS medium_min FROM scan_run WHERE status = 'completed'", "scan_run"), "J17"
    ),
    "trend_geometry": Query(
        q_trend,
        with_views(f"""SELECT repository_id, scan_id, CAST(row_number() OVER w - 1 AS INT) AS step, count(*) OVER (PARTITION BY repository_id) - 1 AS last_step,
       first_value(scan_id) OVER w AS first_value, last_value(scan_id) OVER (PARTITION BY repository_id {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_value
FROM scan_run WHERE status = 'completed' WINDOW w AS (PARTITION BY repository_id {_ORDER})""", "scan_run"),
        "W12",
    ),
    "dependency_page": Query(
        q_dependency_page,
        with_views(FLAGGED + f"""
SELECT {KEYS}, ecosystem, manifest_path, package_name, resolved_version, resolution,
       CASE WHEN is_unassessable THEN 'unassessable' WHEN is_flagged THEN 'flagged' ELSE 'clean' END AS status
FROM flagged ORDER BY is_unassessable, manifest_path, package_name, scan_id, part_id, line_no LIMIT 50 OFFSET 100""", "occurrence"),
        "T05 P11",
    ),
    "flagged_tab": Query(q_flagged_tab, with_views(FLAGGED + f"\nSELECT {KEYS}, package_name FROM flagged WHERE is_flagged", "occurrence"), "P01 P03"),
    "unassessable_tab": Query(q_unassessable_tab, with_views(FLAGGED + f"\nSELECT {KEYS}, package_name FROM flagged WHERE is_unassessable", "occurrence"), "P02 P03"),
    "tri_state_parameter": Query(
        q_tri_state, "SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS wanted FROM events", "FN40"
    ),
    "owner_scoped": Query(
        q_owner_scoped, with_views("SELECT repository_id, scan_id, status FROM repository JOIN scan_run USING (repository_id) WHERE user_id = 2", "repository", "scan_run"), "P04"
    ),
    "live_history_only": Query(
        q_live_history, with_views("SELECT scan_id, repository_id, created_on::VARCHAR AS created_on FROM scan_run WHERE data_source = 'live_scan' AND status = 'completed'", "scan_run"), "P05"
    ),
    "ecosystem_list": Query(
        q_ecosystem_list,
        with_views("""names AS (SELECT scan_id, string_agg(DISTINCT ecosystem, ',' ORDER BY ecosystem) FILTER (WHERE line_no = 1) AS own, string_agg(DISTINCT ecosystem, ',' ORDER BY ecosystem) AS listed
  FROM occurrence GROUP BY scan_id)
SELECT scan_id, coalesce(own, listed, '') AS ecosystems FROM scan_run LEFT JOIN names USING (scan_id)""", "scan_run", "occurrence"),
        "A07",
    ),
    "ecosystem_summary": Query(
        q_ecosystem_summary, with_views("SELECT scan_id, CASE WHEN count(DISTINCT ecosystem) > 1 THEN 'Mixed' ELSE min(ecosystem) END AS summary FROM occurrence GROUP BY scan_id", "occurrence"), "A13"
    ),
    "dashboard_totals": Query(
        q_dashboard_totals,
        with_views(
            rolled_sql("'v2'", "SELECT scan_id, 'v2' AS used_version FROM scan_run")
            + """,
newest AS (SELECT repository_id, arg_max(scan_id, (created_on, scan_id)) AS scan_id, arg_max(status, (created_on, scan_id)) AS status FROM scan_run GROUP BY repository_id),
counts AS (SELECT scan_id, count(*) AS n, count(*) FILTER (WHERE is_unassessable) AS u FROM occurrence GROUP BY scan_id),
cards AS (SELECT repository_id, score_cents, n, u FROM newest JOIN rolled USING (scan_id) LEFT JOIN counts USING (scan_id) WHERE status = 'completed')
SELECT user_id, count(*) AS repositories, count(DISTINCT owner) AS owners, coalesce(sum(n), 0)::BIGINT AS dependencies, coalesce(sum(u), 0)::BIGINT AS unassessable,
       floor(sum(score_cents) / (count(score_cents) * 100) + 0.5)::BIGINT AS mean_score FROM repository LEFT JOIN cards USING (repository_id) GROUP BY user_id""",
            "repository", "scan_run", "occurrence",
        ),
        "A11 W02",
    ),
    "projects_grouping": Query(
        q_projects_grouping,
        with_views("SELECT user_id, project_id, repository_id, row_number() OVER (PARTITION BY user_id, project_id ORDER BY name, repository_id)::INT AS position FROM repository", "repository"),
        "A12 J02",
    ),
    "sibling_context": Query(
        q_sibling_context,
        with_views(FLAGGED + """,
latest AS (SELECT repository_id, arg_max(scan_id, (created_on, scan_id)) AS scan_id FROM scan_run WHERE status = 'completed' GROUP BY repository_id),
subject AS (SELECT repository_id AS subject_id, project_id, user_id FROM repository WHERE project_id IS NOT NULL),
sibling AS (SELECT subject_id, r.repository_id, full_name FROM repository r JOIN subject USING (project_id, user_id) WHERE r.repository_id <> subject_id),
wanted AS (SELECT DISTINCT subject_id, ecosystem, package_name FROM subject JOIN latest ON subject_id = latest.repository_id JOIN flagged USING (scan_id) WHERE is_flagged),
lines AS (SELECT s.subject_id, f.*, full_name, CASE WHEN is_unassessable THEN 'unassessable' WHEN is_flagged THEN 'flagged' ELSE 'clean' END AS status
  FROM sibling s JOIN latest USING (repository_id) JOIN flagged f USING (scan_id) SEMI JOIN wanted w ON s.subject_id = w.subject_id AND f.ecosystem = w.ecosystem AND f.package_name = w.package_name),
placed AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY package_name, full_name, CASE status WHEN 'flagged' THEN 0 WHEN 'unassessable' THEN 1 ELSE 2 END, manifest_path, part_id, line_no) AS position,
  count(*) OVER (PARTITION BY subject_id) AS total FROM lines)
SELECT subject_id, CAST(position AS INT) AS position, package_name, full_name, status, manifest_path, greatest(total - 40, 0) AS omitted FROM placed WHERE position <= 40""", "repository", "scan_run", "occurrence"),
        "J09 J10 T08 R15 P11",
    ),
    "siblings_not_scanned": Query(
        q_siblings_not_scanned,
        with_views("""latest AS (SELECT DISTINCT repository_id, 1 AS scan_id FROM scan_run WHERE status = 'completed')
SELECT project_id, user_id, count(scan_id) AS compared, count(*) FILTER (WHERE scan_id IS NULL) AS not_scanned
FROM repository LEFT JOIN latest USING (repository_id) WHERE project_id IS NOT NULL GROUP BY ALL""", "repository", "scan_run"),
        "A16",
    ),
    "worst_first_prompt_rows": Query(
        q_worst_first,
        with_views(
            rolled_sql("'v2'", "SELECT 1 AS scan_id, 'v2' AS used_version")
            + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY penalty DESC, manifest_path, package_name, part_id, line_no) AS position, count(*) OVER (PARTITION BY scan_id) AS total
  FROM scored WHERE is_flagged)
SELECT scan_id, position::INT AS position, package_name, CAST(10000 - penalty AS BIGINT) AS score_cents, greatest(total - 30, 0) AS omitted FROM placed WHERE position <= 30""",
            "occurrence",
        ),
        "T02 R09",
    ),
    "advisory_order_a": Query(
        q_advisory_order_a,
        with_views(f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY coalesce(cvss_tenths, -1) DESC, osv_id) AS n, coalesce(cve_id, osv_id) AS shown FROM advisory),
firsts AS (SELECT {KEYS}, shown, min(n) AS n FROM ordered GROUP BY ALL),
named AS (SELECT {KEYS}, string_agg(shown, ',' ORDER BY n) AS cves FROM firsts GROUP BY {KEYS}),
listed AS (SELECT {KEYS}, string_agg(osv_id, ',' ORDER BY n) AS osv_ids FROM ordered GROUP BY {KEYS})
SELECT * FROM listed JOIN named USING ({KEYS})""", "advisory"),
        "T03 W09 J03",
    ),
    "advisory_order_b": Query(
        q_advisory_order_b,
        with_views(f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY coalesce(cvss_tenths, 0) DESC, osv_id) AS n, coalesce(cve_id, osv_id) AS shown FROM advisory),
firsts AS (SELECT {KEYS}, shown, min(n) AS n FROM ordered WHERE n <= 5 GROUP BY ALL),
named AS (SELECT {KEYS}, string_agg(shown, ',' ORDER BY n) AS cves FROM firsts GROUP BY {KEYS}),
listed AS (SELECT {KEYS}, string_agg(osv_id, ',' ORDER BY n) AS osv_ids FROM ordered WHERE n <= 5 GROUP BY {KEYS})
SELECT * FROM listed JOIN named USING ({KEYS})""", "advisory"),
        "T04 W09",
    ),
    "occurrence_wide_join": Query(
        q_wide_join,
        with_views("""SELECT user_id, project_id, status, count(*) AS occurrences, count(DISTINCT package_name) AS packages
FROM occurrence JOIN (SELECT scan_id, repository_id, status FROM scan_run) USING (scan_id) JOIN repository USING (repository_id) GROUP BY ALL""", "occurrence", "scan_run", "repository"),
        "J01 J02 SRC11",
    ),
    "props_json_extract": Query(
        q_props, "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS total, max(CAST(json_extract(props, '$.k') AS INT)) AS top FROM events GROUP BY event_type", "X15"
    ),
}
