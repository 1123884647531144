"""Scoring, roll-up, rescoring and top contributors as queries.

Amounts leave as whole cents, so that decimals here and integers there compare exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query
from ..operators import rollup, scoring
from ..operators.weights import ECOSYSTEMS, SIGNALS, load, versions
from .fixtures import KEY, occurrence, scan_run, with_views


def cents(column: str) -> Column:
    return (F.col(column) * 100).cast("long").alias(f"{column}_cents")


def _weights_sql() -> str:
    rows = ", ".join(f"('{v}', '{e}', {', '.join(str(int(load(v).weights[e][s] * 10000)) for s in SIGNALS)})" for v in versions() for e in ECOSYSTEMS)
    return f"weights AS (SELECT * FROM (VALUES {rows}) AS t(version, eco, wd, ws, wc, wt))"


def scored_sql(version: str) -> str:
    """Expressions ``weights`` and ``scored``: integer cents per term and penalty. ``version``: SQL of a row's version."""
    term = lambda w, num, den: f"(2::BIGINT * {w} * {num} * 10000 + tot * {den}) // (2 * tot * {den})"
    return f"""{_weights_sql()},
vectors AS (
  SELECT o.*, w.version AS used_version, wd, ws, wc, wt, wd + ws + wc + CASE WHEN staleness_days IS NULL THEN 0 ELSE wt END AS tot,
         CASE WHEN is_deprecated THEN 1 ELSE 0 END AS n_dep,
         CASE WHEN cvss_tenths IS NOT NULL THEN least(greatest(cvss_tenths, 0), 100) WHEN vulnerability_count > 0 THEN 50 ELSE 0 END AS n_sev,
         least(greatest(vulnerability_count, 0), 10) AS n_cnt, least(greatest(staleness_days, 0), 1095) AS n_stale
  FROM occurrence o JOIN weights w ON w.eco = o.ecosystem AND w.version = {version} WHERE NOT is_unassessable),
terms AS (
  SELECT *, {term('wd', 'n_dep', 1)} AS p_dep, {term('ws', 'n_sev', 100)} AS p_sev, {term('wc', 'n_cnt', 10)} AS p_cnt,
         CASE WHEN staleness_days IS NOT NULL THEN {term('wt', 'n_stale', 1095)} END AS p_stale FROM vectors),
scored AS (
  SELECT *, least(10000, greatest(0, p_dep + p_sev + p_cnt + coalesce(p_stale, 0))) AS penalty,
         is_deprecated OR vulnerability_count > 0 OR coalesce(staleness_days >= 730, false) AS is_flagged FROM terms)"""


def rolled_sql(version: str, scans: str) -> str:
    """Expression ``rolled`` over ``scans`` (scan_id, used_version)."""
    return f"""{scored_sql(version)},
scans AS ({scans}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY penalty DESC) - 1 AS k FROM scored),
deductions AS (
  SELECT scan_id, sum((2 * penalty + (1::BIGINT << k)) // (1::BIGINT << (k + 1))) AS deduction FROM ranked WHERE k < 20 GROUP BY scan_id),
assessed AS (SELECT scan_id, count(*) AS assessed_count, count(*) FILTER (WHERE is_flagged) AS flagged_count FROM scored GROUP BY scan_id),
unassessed AS (SELECT scan_id, count(*) FILTER (WHERE is_unassessable) AS unassessable_count FROM occurrence GROUP BY scan_id),
rolled AS (
  SELECT s.scan_id, s.used_version, CAST(coalesce(deduction, 0) AS BIGINT) AS deduction_cents,
         CAST(least(10000, greatest(0, 10000 - coalesce(deduction, 0))) AS BIGINT) AS score_cents,
         coalesce(assessed_count, 0) AS assessed_count, coalesce(flagged_count, 0) AS flagged_count, coalesce(unassessable_count, 0) AS unassessable_count
  FROM scans s LEFT JOIN deductions USING (scan_id) LEFT JOIN assessed USING (scan_id) LEFT JOIN unassessed USING (scan_id))"""


CLASS_SQL = "CASE WHEN score_cents >= 8000 THEN 'safe' WHEN score_cents >= 5000 THEN 'medium' ELSE 'high_alert' END"
OWN = "(SELECT formula_version FROM scan_run r WHERE r.scan_id = o.scan_id)"
ROLLED = f"SELECT scan_id, used_version, deduction_cents, score_cents, {CLASS_SQL} AS classification, assessed_count, flagged_count, unassessable_count FROM rolled"


def _card(df: DataFrame) -> DataFrame:
    return df.select("scan_id", "used_version", cents("deduction"), cents("score"), "classification", "assessed_count", "flagged_count", "unassessable_count")


def repo_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _card(rollup.scorecard(scan_run(spark, sf_dir), occurrence(spark, sf_dir, named=False)))


def _rescored(version: str, source: str | None = None, limit: int | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _card(rollup.rescore(scan_run(spark, sf_dir), occurrence(spark, sf_dir, named=False), version, source, limit))

    return run


def _rescored_sql(version: str, where: str = "") -> str:
    return with_views(rolled_sql(f"'{version}'", f"SELECT scan_id, '{version}' AS used_version FROM scan_run {where}") + "\n" + ROLLED, "scan_run", "occurrence")


def rescore_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = rollup.rescore_panel(scan_run(spark, sf_dir), occurrence(spark, sf_dir, named=False), "v1", "v2")
    return panel.select("scan_id", cents("score_before"), "class_before", cents("score_after"), "class_after")


def occurrence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_occurrences(occurrence(spark, sf_dir, named=False))
    return scored.select(*KEY, *[cents(f"points_{s}") for s in SIGNALS], cents("penalty"), cents("score"), "redistributed", "cvss_reduced_confidence")


def flag_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = scoring.with_weights(occurrence(spark, sf_dir, named=False).where("NOT is_unassessable"))
    return held.select(*KEY, F.array_join(scoring.flag_reasons(), ",").alias("reasons"), scoring.is_flagged().alias("is_flagged"))


def term_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = scoring.term_breakdown(scoring.score_occurrences(occurrence(spark, sf_dir, named=False)), *KEY)
    return terms.select(*KEY, "term_order", "signal", "raw_value", cents("points"))


def omitted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.omitted_terms(scoring.score_occurrences(occurrence(spark, sf_dir, named=False)), *KEY)


def stored_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose score under each scan's own version equals the one stored, here that of the active version."""
    own = scan_run(spark, sf_dir).select("scan_id", "formula_version")
    again = scoring.score_occurrences(occurrence(spark, sf_dir, named=False).join(own, "scan_id"), F.col("formula_version")).select(*KEY, F.col("score").alias("again"))
    stored = scoring.score_occurrences(occurrence(spark, sf_dir, named=False)).select(*KEY, F.col("score").alias("stored"))
    return again.join(stored, list(KEY), "left").select(*KEY, scoring.matches_stored(F.col("again"), F.col("stored")).alias("matches_stored"))


def top_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollup.top_contributors(occurrence(spark, sf_dir))
    return found.select("scan_id", "position", "package_name", "manifest_path", cents("score"), cents("points"))


def contributor_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scan: points shown by the top contributors, and what of the deduction they leave or overshoot."""
    occurrences = occurrence(spark, sf_dir)
    shown = rollup.top_contributors(occurrences).groupBy("scan_id").agg(F.sum("points").alias("shown"))
    cards = rollup.rescore(scan_run(spark, sf_dir), occurrences, "v2").select("scan_id", "score")
    lost = F.lit(100) - F.col("score")
    joined = cards.join(shown, "scan_id", "left").withColumn("shown", F.coalesce("shown", F.lit(0))).withColumn("rest", lost - F.col("shown"))
    return joined.select("scan_id", cents("shown"), cents("rest"), (F.col("rest") < -0.005).alias("overshoots"))


KEYS = ", ".join(KEY)
_ACTIVE = scored_sql("'v2'")
QUERIES = {
    "repo_scorecard": Query(
        repo_scorecard, with_views(rolled_sql(OWN, "SELECT scan_id, formula_version AS used_version FROM scan_run") + "\n" + ROLLED, "scan_run", "occurrence"), "SC01-SC07 SC11-SC16 W01 J08 J17"
    ),
    "rescore_v0": Query(_rescored("v0_equal"), _rescored_sql("v0_equal"), "SC18 SC16"),
    "rescore_v1": Query(_rescored("v1"), _rescored_sql("v1"), "SC18 SC16"),
    "rescore_live_oldest": Query(
        _rescored("v2", "live_scan", 500), _rescored_sql("v2", "WHERE data_source = 'live_scan' ORDER BY created_on, scan_id LIMIT 500"), "SC18 T10 P05"
    ),
    "rescore_diff_v1_v2": Query(
        rescore_diff,
        with_views(
            rolled_sql("v.version", "SELECT scan_id, version AS used_version FROM scan_run CROSS JOIN (VALUES ('v1'), ('v2')) AS v(version)")
            .replace("FROM occurrence o JOIN weights", "FROM occurrence o CROSS JOIN (VALUES ('v1'), ('v2')) AS v(version) JOIN weights")
            .replace("PARTITION BY scan_id", "PARTITION BY scan_id, used_version")
            .replace("SELECT scan_id, sum((2", "SELECT scan_id, used_version, sum((2")
            .replace("k < 20 GROUP BY scan_id", "k < 20 GROUP BY scan_id, used_version")
            .replace("SELECT scan_id, count(*) AS assessed_count", "SELECT scan_id, used_version, count(*) AS assessed_count")
            .replace("FROM scored GROUP BY scan_id", "FROM scored GROUP BY scan_id, used_version")
            .replace("LEFT JOIN deductions USING (scan_id) LEFT JOIN assessed USING (scan_id)", "LEFT JOIN deductions USING (scan_id, used_version) LEFT JOIN assessed USING (scan_id, used_version)")
            + f""",
carded AS (SELECT *, {CLASS_SQL} AS classification FROM rolled)
SELECT a.scan_id, a.score_cents AS score_before_cents, a.classification AS class_before, b.score_cents AS score_after_cents, b.classification AS class_after
FROM carded a JOIN carded b ON a.scan_id = b.scan_id AND a.used_version = 'v1' AND b.used_version = 'v2' WHERE a.score_cents <> b.score_cents""",
            "scan_run",
            "occurrence",
        ),
        "SC18",
    ),
    "occurrence_scores": Query(
        occurrence_scores,
        with_views(
            f"""{_ACTIVE}
SELECT {KEYS}, CAST(p_dep AS BIGINT) AS points_deprecation_cents, CAST(p_sev AS BIGINT) AS points_severity_cents, CAST(p_cnt AS BIGINT) AS points_count_cents,
       CAST(p_stale AS BIGINT) AS points_staleness_cents, CAST(penalty AS BIGINT) AS penalty_cents, CAST(10000 - penalty AS BIGINT) AS score_cents,
       staleness_days IS NULL AS redistributed, cvss_tenths IS NULL AND vulnerability_count > 0 AS cvss_reduced_confidence FROM scored""",
            "occurrence",
        ),
        "SC01-SC07 SC12",
    ),
    "flag_reasons": Query(
        flag_reasons,
        with_views(
            f"""SELECT {KEYS}, concat_ws(',', CASE WHEN is_deprecated THEN 'deprecated' END, CASE WHEN vulnerability_count > 0 THEN 'vulnerable' END,
       CASE WHEN staleness_days >= 730 THEN 'stale' END) AS reasons,
       is_deprecated OR vulnerability_count > 0 OR coalesce(staleness_days >= 730, false) AS is_flagged FROM occurrence WHERE NOT is_unassessable""",
            "occurrence",
        ),
        "SC11 SC12",
    ),
    "term_breakdown": Query(
        term_breakdown,
        with_views(
            f"""{_ACTIVE}
SELECT {KEYS}, 0 AS term_order, 'deprecation' AS signal, n_dep AS raw_value, CAST(p_dep AS BIGINT) AS points_cents FROM scored
UNION ALL SELECT {KEYS}, 1, 'severity', cvss_tenths, CAST(p_sev AS BIGINT) FROM scored
UNION ALL SELECT {KEYS}, 2, 'count', vulnerability_count, CAST(p_cnt AS BIGINT) FROM scored
UNION ALL SELECT {KEYS}, 3, 'staleness', staleness_days, CAST(p_stale AS BIGINT) FROM scored WHERE staleness_days IS NOT NULL""",
            "occurrence",
        ),
        "SC08 SC19",
    ),
    "omitted_terms": Query(
        omitted_terms, with_views(f"SELECT {KEYS}, 'staleness' AS signal, 'no_release_date' AS reason FROM occurrence WHERE NOT is_unassessable AND staleness_days IS NULL", "occurrence"), "SC09"
    ),
    "stored_agreement": Query(
        stored_agreement,
        with_views(
            _ACTIVE
            + f""",
again AS (SELECT {KEYS}, penalty FROM ({_ACTIVE.replace(_weights_sql() + ",", "WITH").replace("w.version = 'v2'", f"w.version = {OWN}")} SELECT * FROM scored))
SELECT {', '.join('a.' + k for k in KEY)}, coalesce(a.penalty = s.penalty, false) AS matches_stored FROM again a LEFT JOIN scored s USING ({KEYS})""",
            "scan_run",
            "occurrence",
        ),
        "SC10 SC16",
    ),
    "top_contributors": Query(
        top_contributors,
        with_views(
            f"""{_ACTIVE},
placed AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY penalty DESC, manifest_path, package_name, part_id, line_no) - 1 AS k FROM scored)
SELECT scan_id, CAST(k + 1 AS INT) AS position, package_name, manifest_path, CAST(10000 - penalty AS BIGINT) AS score_cents,
       CAST((2 * penalty + (1::BIGINT << k)) // (1::BIGINT << (k + 1)) AS BIGINT) AS points_cents
FROM placed WHERE k < 3 AND (2 * penalty + (1::BIGINT << k)) // (1::BIGINT << (k + 1)) > 0""",
            "occurrence",
        ),
        "T01 W01",
    ),
    "contributor_remainder": Query(
        contributor_remainder,
        with_views(
            rolled_sql("'v2'", "SELECT scan_id, 'v2' AS used_version FROM scan_run")
            + """,
shown AS (SELECT scan_id, sum((2 * penalty + (1::BIGINT << k)) // (1::BIGINT << (k + 1))) AS shown FROM ranked WHERE k < 3 GROUP BY scan_id)
SELECT scan_id, CAST(coalesce(shown, 0) AS BIGINT) AS shown_cents, CAST(10000 - score_cents - coalesce(shown, 0) AS BIGINT) AS rest_cents,
       10000 - score_cents < coalesce(shown, 0) AS overshoots FROM rolled LEFT JOIN shown USING (scan_id)""",
            "scan_run",
            "occurrence",
        ),
        "A14",
    ),
}
