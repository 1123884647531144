"""Listings walked by key, served rows and snapshots, reports and projects, constraints, and the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Query
from ..functions import text as tx
from ..operators import analytics, constraints, enrich, paging, panel, reports, scoring, serving
from ..operators.weights import TRIAL, load
from ..session import kept, released, shared_path
from ..sources import sinks
from .analytics_queries import FLAGGED, NOW, flagged
from .fixtures import KEY, occurrence, report, repository, scan_run, table, with_views
from .scoring_queries import CLASS_SQL, KEYS, cents, rolled_sql


def q_page_walk(spark, sf_dir):
    """The first twenty pages of all occurrences in the order of the listing."""
    rows = flagged(spark, sf_dir).select(*KEY, "is_unassessable", "manifest_path", "package_name", "resolved_version")
    order = ("is_unassessable", "manifest_path", "package_name", "scan_id", "part_id", "supp_id", "line_no")
    listing = paging.Listing(shared_path(spark, "listing"), order).write(rows)
    walked, total, cut = listing.walk(spark)
    return walked.select(*KEY, "manifest_path", "package_name", "page", F.lit(total).cast("long").alias("total"), F.lit(cut).alias("is_cut"))


def _reports(spark, sf_dir):
    """Reports on scans and on dependencies, some of them tried again, by the minute of their last change."""
    now = F.lit(NOW).cast("timestamp")
    base = report(spark, sf_dir).select("scan_id", F.explode(F.sequence(F.lit(0), F.col("scan_id") % 3)).alias("n"))
    number = F.col("scan_id") * 10 + F.col("n")
    single = F.col("scan_id") % 2 == 0
    status = F.element_at(F.array(*map(F.lit, ("completed", "running", "failed", "queued"))), (number % 4 + 1).cast("int"))
    return base.select(
        number.alias("report_id"), "scan_id", F.when(single, "per_dependency").otherwise("combined").alias("report_type"), F.when(single, F.col("scan_id") % 5 + 1).alias("dependency_id"),
        status.alias("status"), (now - F.make_interval(mins=(number % 17 + 9).cast("int"))).alias("created_at"), (now - F.make_interval(mins=(number % 9).cast("int"))).alias("updated_at"),
    )


_REPORTS = f"""told AS (SELECT scan_id, scan_id * 10 + n AS report_id, CASE WHEN scan_id % 2 = 0 THEN 'per_dependency' ELSE 'combined' END AS report_type, CASE WHEN scan_id % 2 = 0 THEN scan_id % 5 + 1 END AS dependency_id,
  ['completed', 'running', 'failed', 'queued'][1 + (scan_id * 10 + n) % 4] AS status, TIMESTAMP '{NOW}' - to_minutes(((scan_id * 10 + n) % 17 + 9)::INT) AS created_at, (scan_id * 10 + n) % 9 AS idle
  FROM (SELECT scan_id, unnest(range(0, scan_id % 3 + 1)) AS n FROM report)),
keyed AS (SELECT *, CASE WHEN report_type = 'combined' THEN 'combined:' || scan_id ELSE 'per_dependency:' || scan_id || ':' || dependency_id END AS report_key,
  CASE WHEN status IN ('queued', 'running') AND idle > 5 THEN 'failed' ELSE status END AS now_status FROM told),
current AS (SELECT report_key, arg_max(report_id, (created_at, report_id)) AS report_id, arg_max(now_status, (created_at, report_id)) AS status FROM keyed GROUP BY report_key)"""


def q_report_lookup(spark, sf_dir):
    return serving.current_reports(_reports(spark, sf_dir), F.lit(NOW).cast("timestamp"))


def q_report_request(spark, sf_dir):
    """What asking for the report of every scan and of each of its lines does."""
    held = serving.current_reports(_reports(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    scans = scan_run(spark, sf_dir).select("scan_id", F.col("status").alias("scan_status"))
    lines = flagged(spark, sf_dir, named=False).groupBy("scan_id", F.col("line_no").cast("long").alias("dependency_id")).agg(F.bool_or("is_unassessable").alias("is_unassessable"), F.bool_or("is_flagged").alias("is_flagged"))
    single = scans.join(lines, "scan_id").withColumn("kind", F.lit("per_dependency"))
    whole = scans.withColumns({"dependency_id": F.lit(None).cast("long"), "is_unassessable": F.lit(None).cast("boolean"), "is_flagged": F.lit(None).cast("boolean"), "kind": F.lit("combined")})
    asked = single.unionByName(whole).withColumn("report_key", serving.report_key(F.col("kind"), F.col("scan_id"), F.col("dependency_id")))
    joined = asked.join(held.select("report_key", F.col("status").alias("stored")), "report_key", "left")
    return joined.select("report_key", serving.request_outcome(F.col("kind"), F.col("scan_status"), F.col("is_unassessable"), F.col("is_flagged"), F.col("stored")).alias("outcome"))


def q_project_members(spark, sf_dir):
    states = analytics.latest_state(scan_run(spark, sf_dir))
    found = serving.project_members(repository(spark, sf_dir), states)
    text = F.transform("members", lambda m: F.concat_ws(" ", m["full_name"], F.coalesce(m["latest_scan_id"].cast("string"), F.lit("-")), F.coalesce(m["latest_status"], F.lit("-")), F.coalesce(m["latest_completed_id"].cast("string"), F.lit("-"))))
    return found.select("user_id", "project_id", F.array_join(text, "|").alias("members"))


def q_ungroup(spark, sf_dir):
    """Projects of even number dissolved, and one that nobody has; what every repository is in afterwards."""
    repos = repository(spark, sf_dir)
    gone = repos.where("project_id % 2 = 0").select("user_id", "project_id").union(spark.createDataFrame([(0, -1)], "user_id long, project_id long"))
    free, kept = serving.ungroup(repos, gone)
    sizes = kept.select("user_id", F.col("project_id").alias("old_project"), F.col("kept"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("old_project"))
    left = free.groupBy("user_id", "project_id").agg(F.count("*").alias("repositories")).select("user_id", F.lit("left").alias("side"), F.col("project_id").cast("long").alias("project_id"), "repositories")
    lost = sizes.join(nation, "old_project", "left").select("user_id", F.lit("dissolved").alias("side"), F.col("old_project").cast("long").alias("project_id"), F.col("kept").alias("repositories"))
    return left.unionByName(lost)


def q_deletion(spark, sf_dir):
    """A request to delete each repository, confirmed by its own project, by another one, or not at all; and one for what is not there."""
    repos = repository(spark, sf_dir)
    r = F.col("repository_id")
    asked = repos.select("repository_id", F.when(r % 4 == 0, F.col("project_id")).when(r % 4 == 1, F.col("project_id") + 1).alias("confirm")).union(repos.where(r % 10 == 0).select((-r - 1).alias("repository_id"), "project_id"))
    found = serving.deletion(repos, asked)
    return found.select("repository_id", "outcome", "deleted", "member_count", "other_count", F.element_at("names", 1).alias("first_name"), F.element_at("names", -1).alias("last_name"))


def _full_rows(spark, sf_dir, scans=None, how="left_semi", together=False):
    """Occurrences with every column that is served; what the tables lack is derived from their keys, ``scans`` are joined before that."""
    part, line, rows = F.col("part_id"), F.col("line_no"), occurrence(spark, sf_dir, scans=scans, how=how, together=together)
    flag = ~F.col("is_unassessable") & scoring.is_flagged()
    joined = scoring.score_occurrences(rows, keep=True).select(*rows.columns, F.col("score").alias("risk_component_score"), "cvss_reduced_confidence", flag.alias("is_flagged"))
    latest = F.when(part % 4 != 0, F.concat((part % 5 + 1).cast("string"), F.lit(".0.0")))
    behind = {"behind_major": part % 3, "behind_minor": line % 4, "behind_patch": F.lit(0)}
    return joined.withColumns(
        {
            "occurrence_id": F.concat_ws("-", *KEY), "registry_url": F.concat(F.lit("https://host/"), "package_name"), "declared_specifier": F.when(line % 2 == 0, F.concat(F.lit("^"), "resolved_version")), "latest_version": latest,
            "latest_release_at": F.when(part % 4 != 0, F.date_add(F.lit("1998-01-01").cast("date"), (part % 300).cast("int")).cast("string")), "unassessable_reason": F.when(F.col("is_unassessable"), "git_specifier"),
            "highest_severity": F.when(F.col("vulnerability_count") > 0, F.coalesce(analytics.severity(F.col("cvss_tenths")), F.lit("unknown"))), "cvss_max": (F.col("cvss_tenths") / 10).cast("decimal(3,1)"), **behind,
        }
    ).withColumn("versions_behind", serving.versions_behind())


def q_occurrence_rows(spark, sf_dir):
    state = report(spark, sf_dir).select("scan_id", F.struct("report_id", "status").alias("report"))
    rows = _full_rows(spark, sf_dir, state, "left")
    served = serving.occurrence_rows(rows)
    return served.withColumns({"versionsBehind": F.to_json("versionsBehind"), "report": F.to_json("report"), "riskComponentScore": (F.col("riskComponentScore") * 100).cast("long"), "cvssMax": (F.col("cvssMax") * 10).cast("long")})


def q_snapshot(spark, sf_dir):
    """Twenty columns of each occurrence of completed scans that are live."""
    done = scan_run(spark, sf_dir).where("status = 'completed' AND data_source = 'live_scan'").select("scan_id")
    found = serving.snapshot(_full_rows(spark, sf_dir, done), "scan_id")
    return found.withColumns({"risk_component_score": (F.col("risk_component_score") * 100).cast("long"), "cvss_max": (F.col("cvss_max") * 10).cast("long")})


_FULL = """full_rows AS (
  SELECT f.*, CASE WHEN part_id % 4 <> 0 THEN (part_id % 5 + 1) || '.0.0' END AS latest_version, CASE WHEN vulnerability_count > 0 THEN CASE WHEN cvss_tenths >= 90 THEN 'critical' WHEN cvss_tenths >= 70 THEN 'high'
    WHEN cvss_tenths >= 40 THEN 'medium' WHEN cvss_tenths >= 0 THEN 'low' ELSE 'unknown' END END AS highest_severity, CASE WHEN line_no % 2 = 0 THEN '^' || resolved_version END AS declared_specifier
  FROM (SELECT *, 10000 - penalty AS score, cvss_tenths IS NULL AND vulnerability_count > 0 AS low FROM scored o
        UNION ALL BY NAME SELECT *, false AS is_flagged FROM occurrence WHERE is_unassessable) f)"""


def q_constraints(spark, sf_dir):
    """Every declared rule of scans and reports, with what breaks it and the totals, each table in one scan."""
    orders = table(spark, sf_dir, "orders")
    price, k = F.round(F.col("o_totalprice")).cast("long"), F.col("o_orderkey")
    scans = orders.select(
        k.alias("scan_id"), F.when(k % 40 == 0, "cron").when(k % 3 == 0, "initial").otherwise("manual").alias("trigger_type"), F.when(F.col("o_orderstatus") == "P", "paused").otherwise("completed").alias("status"),
        F.when(k % 5 > 0, price % 104 - 2).alias("risk_score"), (price % 7 - 1).alias("skipped_manifest_count"), F.when(k % 6 > 0, F.when(price % 9 == 0, "unsafe").otherwise("safe")).alias("classification"),
    )
    told = orders.select(
        k.alias("scan_id"), F.when(k % 50 == 0, "weekly").when(k % 2 == 0, "combined").otherwise("per_dependency").alias("report_type"), F.when(price % 3 > 0, price).alias("dependency_id"), F.lit("queued").alias("status"),
        F.when(k % 4 == 0, "low").when(k % 31 == 0, "none").alias("grounding_confidence"),
    )
    out = []
    for name, rows in (("scan", scans), ("report", told)):
        found, totals = constraints.audit(rows, constraints.RULES[name], "scan_id")
        counts = spark.createDataFrame([(rule, n) for rule, n in totals.items() if rule != "rows"], "rule string, total long")
        out.append(found.join(F.broadcast(counts), "rule").select(F.lit(name).alias("table"), "rule", "scan_id", "total", F.lit(totals["rows"]).cast("long").alias("rows")))
    return out[0].unionByName(out[1])


def q_panels(spark, sf_dir):
    """The history under two versions, both panels written as CSV and read back."""
    scans = panel.oldest(scan_run(spark, sf_dir), "live_scan")
    held = panel.by_version(scans, occurrence(spark, sf_dir, named=False), ("v0_equal", "v1", "v2"))
    stored = panel.of_version(held, F.lit("v0_equal")).select(*held.columns, F.col("score").alias("stored_score"), F.col("classification").alias("stored_classification"))
    with released(spark):
        cards = kept(panel.repository_panel(panel.of_version(stored, panel.each(("v1", "v2")))), "cards")
    # Scans meet the bare lines, and names come last: the wide rows are written where they are made.
    rows = panel.occurrence_panel(occurrence(spark, sf_dir, scans=scans.select("scan_id", "data_source", "created_on"), how="inner"), ("v1", "v2"), *KEY)
    prefix = shared_path(spark, "history-panel")
    panel.write(rows, cards, prefix)
    first = sinks.read_panel(spark, f"{prefix}_occurrences", *panel.OCCURRENCE_COLUMNS)
    whole = lambda c: F.col(c).cast("long").alias(c)
    cents = lambda c, name: F.round(F.col(c).cast("decimal(9,2)") * 100).cast("long").alias(name)
    # Cells become numbers before they are dealt, which are a third of their text.
    counted = first.groupBy(whole("scan_id"), "used_version").agg(
        F.count("*").alias("rows"), F.count_if(F.col("is_unassessable") == "True").alias("unassessable"), F.count_if((F.col("is_unassessable") == "True") & (F.col("score") == "")).alias("unscored"),
        F.coalesce(F.sum(F.round(F.expr("try_cast(penalty AS decimal(9,2))") * 100).cast("long")), F.lit(0)).alias("penalty_cents"),
    )
    cells = sinks.read_panel(spark, f"{prefix}_repositories", *panel.REPOSITORY_COLUMNS)
    second = cells.select(
        whole("scan_id"), "used_version", whole("dependency_count"), whole("assessed_count"), whole("recomputed_flagged_count"), cents("recomputed_score", "score_cents"), "recomputed_classification",
        cents("stored_score", "stored_cents"), "stored_formula_version",
    )
    manifest = spark.read.json(f"{prefix}_manifest").select("used_version", "scan_rows", "scores_differing_from_stored")
    joined = second.join(counted, ["scan_id", "used_version"], "left").join(manifest, "used_version")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "unassessable", "unscored", "penalty_cents")]
    return joined.select(*second.columns, *counts, "scan_rows", "scores_differing_from_stored")


def _panel_sql() -> str:
    def version(v: str) -> str:
        own = rolled_sql(f"'{v}'", f"SELECT scan_id, '{v}' AS used_version FROM scan_run WHERE data_source = 'live_scan'")
        return f"(WITH {own},\npen AS (SELECT scan_id, sum(penalty)::BIGINT AS penalty_cents FROM scored GROUP BY scan_id)\nSELECT r.*, {CLASS_SQL} AS classification, coalesce(penalty_cents, 0) AS penalty_cents FROM rolled r LEFT JOIN pen USING (scan_id))"

    old = f"(WITH {rolled_sql(chr(39) + 'v0_equal' + chr(39), 'SELECT scan_id, 1 AS used_version FROM scan_run')}\nSELECT scan_id, score_cents AS stored_cents FROM rolled)"
    return with_views(
        f"""each_version AS (SELECT * FROM {version('v1')} UNION ALL SELECT * FROM {version('v2')}),
old AS {old},
joined AS (SELECT b.*, stored_cents, formula_version FROM each_version b JOIN old USING (scan_id) JOIN scan_run USING (scan_id))
SELECT scan_id, used_version, assessed_count + unassessable_count AS dependency_count, assessed_count, flagged_count AS recomputed_flagged_count, score_cents, classification AS recomputed_classification, stored_cents, formula_version AS stored_formula_version,
  assessed_count + unassessable_count AS rows, unassessable_count AS unassessable, unassessable_count AS unscored, penalty_cents, count(*) OVER (PARTITION BY used_version) AS scan_rows, count(*) FILTER (WHERE score_cents <> stored_cents) OVER (PARTITION BY used_version) AS scores_differing_from_stored FROM joined""",
        "scan_run", "occurrence",
    )


def q_epss_scores(spark, sf_dir):
    """Scores with the term of the exploit probability, which some occurrences do not have, and under the weights without it."""
    chance = F.when(F.col("part_id") % 3 > 0, (F.col("part_id") % 997 / F.lit(900.0)).cast("decimal(6,5)"))
    rows = occurrence(spark, sf_dir, named=False).withColumn("epss", chance).dropDuplicates(list(KEY))
    with_term = scoring.score_occurrences(rows, "v3_epss", TRIAL).select(*KEY, cents("points_epss"), cents("score"), "redistributed")
    without = scoring.score_occurrences(rows, "v2", TRIAL).select(*KEY, cents("score")).withColumnRenamed("score_cents", "score_without_cents")
    return with_term.join(without, list(KEY))


def _epss_sql() -> str:
    """Every weight in ten-thousandths; the probability in hundred-thousandths."""
    def term(w: str, num: str, den: int) -> str:
        return f"(2::BIGINT * {w} * {num} * 10000 + tot * {den}) // (2 * tot * {den})"

    def side(version: str, epss: int) -> str:
        weights = ", ".join(f"('{e}', {', '.join(str(int(load(version, TRIAL).weights[e][s] * 10000)) for s in ('deprecation', 'severity', 'count', 'staleness'))})" for e in ("npm", "pypi"))
        return f"""(SELECT {KEYS}, chance, staleness_days IS NULL OR {epss} > 0 AND chance IS NULL AS redistributed, CASE WHEN {epss} > 0 AND chance IS NOT NULL THEN {term(str(epss), 'e5', 100000)} END AS p_epss,
  least(10000, {term('wd', 'n_dep', 1)} + {term('ws', 'n_sev', 100)} + {term('wc', 'n_cnt', 10)} + coalesce(CASE WHEN staleness_days IS NOT NULL THEN {term('wt', 'n_stale', 1095)} END, 0) + CASE WHEN {epss} > 0 AND chance IS NOT NULL THEN {term(str(epss), 'e5', 100000)} ELSE 0 END) AS penalty
  FROM (SELECT *, wd + ws + wc + CASE WHEN staleness_days IS NULL THEN 0 ELSE wt END + CASE WHEN chance IS NULL THEN 0 ELSE {epss} END AS tot, least(1.0, chance) * 100000 AS e5x, CAST(round(least(1.0, chance) * 100000) AS BIGINT) AS e5,
    CASE WHEN is_deprecated THEN 1 ELSE 0 END AS n_dep, CASE WHEN cvss_tenths IS NOT NULL THEN cvss_tenths WHEN vulnerability_count > 0 THEN 50 ELSE 0 END AS n_sev, least(vulnerability_count, 10) AS n_cnt, least(greatest(staleness_days, 0), 1095) AS n_stale
    FROM base JOIN (VALUES {weights}) AS t(eco, wd, ws, wc, wt) ON eco = ecosystem))"""

    return with_views(
        f"""base AS (SELECT DISTINCT ON ({KEYS}) *, CASE WHEN part_id % 3 > 0 THEN CAST(round((part_id % 997) / 900.0::DOUBLE, 5) AS DECIMAL(6,5)) END AS chance FROM occurrence WHERE NOT is_unassessable)
SELECT {KEYS}, a.p_epss AS points_epss_cents, 10000 - a.penalty AS score_cents, a.redistributed, 10000 - b.penalty AS score_without_cents FROM {side('v3_epss', 1000)} a JOIN {side('v2', 0)} b USING ({KEYS})""",
        "occurrence",
    )


def q_project_creation(spark, sf_dir):
    """Requests of every user for a project of each run of three of their repositories, with what can be wrong in turn."""
    repos = repository(spark, sf_dir)
    r = F.col("repository_id")
    text = lambda c: c.cast("string")
    name = F.when(r % 19 == 0, " \t ").when(r % 17 == 0, F.repeat(F.lit("n"), 81)).otherwise(F.concat(F.lit("  My   "), text(r), F.lit("\n")))
    ids = F.when(r % 13 == 0, F.array(text(r))).when(r % 11 == 0, F.array(text(r), F.lit("x1"))).when(r % 7 == 0, F.array(text(r), F.concat(F.lit(" "), text(r)))).when(r % 5 == 0, F.array(text(r), text(r + 1))).otherwise(F.array(text(r), text(-r - 1), text(r)))
    loose = F.when(r % 2 == 1, F.col("project_id"))
    # Every repository owns a twin with a negative number, so that a pair of one's own exists.
    owned = repos.select("repository_id", "user_id", loose.alias("project_id"), "full_name").union(repos.select(-r - 1, "user_id", F.lit(None).cast("long"), F.concat("full_name", F.lit("-twin"))))
    asked = repos.select(r.alias("request_id"), "user_id", name.alias("name"), ids.alias("ids"))
    found = serving.project_creation(asked, owned)
    return found.select("request_id", "outcome", "name", F.array_join("grouped", ",").alias("grouped"))


def q_registrations(spark, sf_dir):
    """Registrations with their first scan, which some could not start."""
    c = F.col("repository_id")
    ladder = F.when(c % 11 == 0, "repo_inaccessible").when(c % 17 == 0, "duplicate").otherwise("created")
    failure = F.when(c % 3 == 0, F.concat(F.lit("no thread for "), "full_name"))
    return repository(spark, sf_dir).select("repository_id", serving.registration(ladder, failure).alias("x")).select("repository_id", "x.outcome", "x.scan")


def q_addresses(spark, sf_dir):
    branch = F.concat(F.lit("feature/é ~*+"), F.col("repository_id").cast("string"))
    return repository(spark, sf_dir).select("repository_id", tx.tree_address(F.col("owner"), F.col("name"), branch).alias("tree"), tx.blob_address(F.col("owner"), F.col("full_name"), F.sha1("name")).alias("blob"))


def q_signal_read(spark, sf_dir):
    """Scores from live rows and from the snapshot of the same rows, read by the same columns."""
    live = occurrence(spark, sf_dir, named=False)
    count = F.when(F.col("vulnerability_count") > 0, F.col("vulnerability_count"))
    kept = live.withColumn("vulnerability_count", count).drop("part_id")
    keys = ("scan_id", "supp_id", "line_no", "ecosystem", "is_unassessable")
    both = scoring.signal_columns(live, *keys).withColumn("side", F.lit("live")).unionByName(scoring.signal_columns(kept, *keys).withColumn("side", F.lit("history")))
    return scoring.score_occurrences(both).groupBy("side", "scan_id").agg(F.count("*").alias("n"), F.sum((F.col("score") * 100).cast("long")).alias("score_cents"))


def q_advisory_targets(spark, sf_dir):
    """Occurrences that are asked about: those whose package was found and available, with a version of their own or the latest."""
    rows = occurrence(spark, sf_dir).select(*KEY, "ecosystem", F.col("package_name").alias("name"), F.when(F.col("line_no") != 2, F.col("resolved_version")).alias("resolved_version"), F.when(F.col("is_unassessable"), "git_specifier").alias("unassessable_reason"), F.length("package_name").alias("size"))
    facts = rows.where("size % 7 > 0").select("ecosystem", "name", "resolved_version", (F.col("size") % 5 == 0).alias("unavailable"), (F.col("size") % 6 == 0).alias("not_found"), F.when(F.col("size") % 4 > 0, F.concat(F.lit("9."), "size")).alias("latest_version")).distinct()
    return enrich.asked_for_advisories(enrich.with_facts(rows, facts)).select(*KEY, "assessed_version")


def q_cited_passages(spark, sf_dir):
    """Citations of every report, some of what was never retrieved, in the order in which they are cited."""
    s = F.col("scan_id")
    passage = lambda n: F.struct(F.concat(F.lit(f"c{n}-"), s.cast("string")).alias("chunk_id"), (F.lit(n) / F.lit(4.0)).alias("similarity"))
    cites = F.transform(F.sequence(F.lit(0), (s % 4).cast("int")), lambda i: F.concat(F.lit("c"), ((s + i) % 5).cast("string"), F.lit("-"), s.cast("string")))
    stored = report(spark, sf_dir).select("report_id", cites.alias("citations"), F.array(*[passage(n) for n in range(3)]).alias("retrieved"))
    return reports.cited_passages(stored)


QUERIES = {
    "project_creation": Query(
        q_project_creation,
        with_views("""r AS (SELECT *, CASE WHEN repository_id % 2 = 1 THEN project_id END AS p FROM repository),
o AS (
  SELECT a.repository_id AS k, a.full_name, CASE WHEN a.repository_id % 19 = 0 THEN '' WHEN a.repository_id % 17 = 0 THEN repeat('n', 81) ELSE 'My ' || a.repository_id END AS name, a.p, b.repository_id AS other, b.p AS other_p, b.full_name AS other_name
  FROM r a LEFT JOIN r b ON b.repository_id = a.repository_id + 1 AND b.user_id = a.user_id),
w AS (SELECT *, CASE WHEN k % 19 = 0 THEN 'name_required' WHEN k % 17 = 0 THEN 'name_too_long' WHEN k % 13 = 0 THEN 'too_small' WHEN k % 11 = 0 THEN 'unknown_repository' WHEN k % 7 = 0 THEN 'too_small' WHEN k % 5 = 0 AND other IS NULL THEN 'unknown_repository'
  WHEN p IS NOT NULL OR k % 5 = 0 AND other_p IS NOT NULL THEN 'already_grouped' ELSE 'created' END AS outcome FROM o)
SELECT k AS request_id, outcome, name, CASE WHEN outcome = 'already_grouped' THEN CASE WHEN k % 5 = 0 AND p IS NOT NULL AND other_p IS NOT NULL THEN least(full_name, other_name) || ',' || greatest(full_name, other_name) WHEN p IS NOT NULL THEN full_name ELSE other_name END END AS grouped FROM w""", "repository"),
        "Q06",
    ),
    "registrations": Query(
        q_registrations,
        with_views("""o AS (SELECT repository_id, CASE WHEN repository_id % 11 = 0 THEN 'repo_inaccessible' WHEN repository_id % 17 = 0 THEN 'duplicate' ELSE 'created' END AS outcome FROM repository)
SELECT repository_id, outcome, CASE WHEN outcome = 'created' THEN CASE WHEN repository_id % 3 = 0 THEN 'not_started' ELSE 'queued' END END AS scan FROM o""", "repository"),
        "X22",
    ),
    "request_addresses": Query(
        q_addresses,
        with_views("""SELECT repository_id, 'https://api.github.com/repos/' || url_encode(owner) || '/' || url_encode(name) || '/git/trees/' || url_encode('feature/é ~*+' || repository_id) AS tree,
'https://api.github.com/repos/' || url_encode(owner) || '/' || url_encode(full_name) || '/git/blobs/' || sha1(name) AS blob FROM repository""", "repository"),
        "X19",
    ),
    "signals_of_any_rows": Query(
        q_signal_read,
        with_views(rolled_sql("'v2'", "SELECT 1 AS scan_id, 1 AS used_version") + """,
sums AS (SELECT scan_id, count(*) AS n, sum(10000 - penalty)::BIGINT AS score_cents FROM scored GROUP BY scan_id)
SELECT side, scan_id, n, score_cents FROM sums, (VALUES ('live'), ('history')) AS v(side)""", "occurrence"),
        "X18",
    ),
    "advisory_targets": Query(
        q_advisory_targets,
        with_views(f"""rows AS (SELECT *, length(package_name) AS size, CASE WHEN line_no <> 2 THEN resolved_version END AS v FROM occurrence)
SELECT {KEYS}, coalesce(v, '9.' || size) AS assessed_version FROM rows WHERE NOT is_unassessable AND size % 7 > 0 AND size % 5 > 0 AND size % 6 > 0 AND (v IS NOT NULL OR size % 4 > 0)""", "occurrence"),
        "P06",
    ),
    "cited_passages": Query(
        q_cited_passages,
        with_views("""c AS (SELECT report_id, scan_id, unnest(range(0, scan_id % 4 + 1)) AS i FROM report)
SELECT report_id, CAST(i + 1 AS INT) AS cited_at, 'c' || ((scan_id + i) % 5) || '-' || scan_id AS chunk_id, ((scan_id + i) % 5) / 4.0::DOUBLE AS similarity FROM c WHERE (scan_id + i) % 5 < 3""", "report"),
        "J14",
    ),
    "dependency_page_walk": Query(
        q_page_walk,
        with_views(f"""placed AS (SELECT *, row_number() OVER (ORDER BY is_unassessable, manifest_path, package_name, scan_id, part_id, supp_id, line_no) AS n, count(*) OVER () AS total FROM occurrence)
SELECT {KEYS}, manifest_path, package_name, CAST((n - 1) // 50 + 1 AS INT) AS page, total, total > 1000 AS is_cut FROM placed WHERE n <= 1000""", "occurrence"),
        "T05 T06",
    ),
    "report_lookup": Query(q_report_lookup, with_views(_REPORTS + "\nSELECT report_key, report_id, status FROM current", "report"), "X08 P08"),
    "report_request": Query(
        q_report_request,
        with_views(FLAGGED + ",\n" + _REPORTS + """,
lines AS (SELECT scan_id, line_no, bool_or(is_unassessable) AS u, bool_or(is_flagged) AS f FROM flagged GROUP BY ALL),
asked AS (SELECT 'per_dependency:' || scan_id || ':' || line_no AS report_key, scan_id, u, f FROM lines UNION ALL SELECT 'combined:' || scan_id, scan_id, NULL, NULL FROM scan_run)
SELECT report_key, CASE WHEN report_key LIKE 'per%' AND u THEN 'not_assessed' WHEN report_key LIKE 'per%' AND NOT f THEN 'not_flagged' WHEN s.status <> 'completed' THEN 'scan_not_reportable'
  WHEN c.status = 'completed' THEN 'cached' WHEN c.status IN ('queued', 'running') THEN 'conflict' WHEN c.status = 'failed' THEN 'requeue' ELSE 'create' END AS outcome
FROM asked JOIN scan_run s USING (scan_id) LEFT JOIN current c USING (report_key)""", "scan_run", "report", "occurrence"),
        "P07 R14 X08",
    ),
    "project_members": Query(
        q_project_members,
        with_views("""state AS (SELECT repository_id, arg_max(scan_id, (created_on, scan_id)) AS a, arg_max(status, (created_on, scan_id)) AS b, arg_max(scan_id, (created_on, scan_id)) FILTER (WHERE status = 'completed') AS c FROM scan_run GROUP BY repository_id)
SELECT user_id, project_id, string_agg(full_name || ' ' || coalesce(a::VARCHAR, '-') || ' ' || coalesce(b, '-') || ' ' || coalesce(c::VARCHAR, '-'), '|' ORDER BY full_name, repository_id) AS members
FROM repository LEFT JOIN state USING (repository_id) WHERE project_id IS NOT NULL GROUP BY ALL""", "repository", "scan_run"),
        "X11 A12",
    ),
    "ungrouped_projects": Query(
        q_ungroup,
        with_views("""SELECT user_id, 'left' AS side, CASE WHEN project_id % 2 = 0 THEN NULL ELSE project_id END::BIGINT AS project_id, count(*) AS repositories FROM repository GROUP BY ALL
UNION ALL SELECT user_id, 'dissolved', project_id, count(*) FROM repository WHERE project_id % 2 = 0 GROUP BY ALL UNION ALL SELECT 0, 'dissolved', -1, 0""", "repository"),
        "X12",
    ),
    "repository_deletion": Query(
        q_deletion,
        with_views("""grp AS (SELECT user_id, project_id, count(*) AS n, min(full_name) AS a, max(full_name) AS b FROM repository WHERE project_id IS NOT NULL GROUP BY ALL),
asked AS (SELECT r.*, n, a, b, n IS NULL OR n < 2 AS alone, repository_id % 4 = 0 AS agreed FROM repository r LEFT JOIN grp USING (user_id, project_id))
SELECT repository_id, CASE WHEN alone OR agreed THEN 'deleted' ELSE 'confirm_project' END AS outcome, CASE WHEN alone THEN 1 WHEN agreed THEN n ELSE 0 END::BIGINT AS deleted,
  CASE WHEN NOT alone AND NOT agreed THEN n END AS member_count, CASE WHEN NOT alone AND NOT agreed THEN n - 1 END AS other_count, CASE WHEN NOT alone AND NOT agreed THEN a END AS first_name, CASE WHEN NOT alone AND NOT agreed THEN b END AS last_name FROM asked
UNION ALL SELECT -repository_id - 1, 'missing', 0, NULL, NULL, NULL, NULL FROM repository WHERE repository_id % 10 = 0""", "repository"),
        "Q08",
    ),
    "occurrence_rows": Query(
        q_occurrence_rows,
        with_views(rolled_sql("'v2'", "SELECT 1 AS scan_id, 'v2' AS used_version") + ",\n" + _FULL + """
SELECT scan_id || '-' || part_id || '-' || supp_id || '-' || line_no AS id, package_name AS packageName, ecosystem, 'https://host/' || package_name AS registryUrl, manifest_path AS manifestPath, dependency_group AS "group", declared_specifier AS declaredSpecifier, resolved_version AS resolvedVersion,
  resolution, latest_version AS latestVersion, CASE WHEN part_id % 4 <> 0 THEN CAST(DATE '1998-01-01' + (part_id % 300)::INT AS VARCHAR) END AS latestReleaseAt, staleness_days AS stalenessDays, '{"major":' || (part_id % 3) || ',"minor":' || (line_no % 4) || ',"patch":0}' AS versionsBehind,
  is_deprecated AS isDeprecated, deprecation_reason AS deprecationReason, is_unassessable AS isUnassessable, CASE WHEN is_unassessable THEN 'git_specifier' END AS unassessableReason, vulnerability_count AS vulnerabilityCount, highest_severity AS highestSeverity, cvss_tenths::BIGINT AS cvssMax,
  is_flagged AS isFlagged, score AS riskComponentScore, low AS cvssReducedConfidence, CASE WHEN r.report_id IS NOT NULL THEN '{"report_id":' || r.report_id || ',"status":"' || r.status || '"}' END AS report FROM full_rows LEFT JOIN report r USING (scan_id)""", "occurrence", "report"),
        "P10",
    ),
    "history_snapshot": Query(
        q_snapshot,
        with_views(rolled_sql("'v2'", "SELECT 1 AS scan_id, 'v2' AS used_version") + ",\n" + _FULL + """
SELECT scan_id AS scan_history_id, ecosystem, package_name, manifest_path, dependency_group, declared_specifier, resolved_version, resolution, latest_version, staleness_days, (part_id % 3)::INT AS versions_behind_major, (line_no % 4)::INT AS versions_behind_minor, 0 AS versions_behind_patch,
  is_deprecated, deprecation_reason, vulnerability_count, highest_severity, cvss_tenths::BIGINT AS cvss_max, is_unassessable, score AS risk_component_score
FROM full_rows SEMI JOIN (SELECT scan_id FROM scan_run WHERE status = 'completed' AND data_source = 'live_scan') d USING (scan_id)""", "occurrence", "scan_run"),
        "P12 SNK03",
    ),
    "declared_constraints": Query(
        q_constraints,
        """WITH s AS (SELECT o_orderkey AS k, round(o_totalprice)::BIGINT AS p, o_orderstatus AS st FROM orders),
v AS (
  SELECT 'scan' AS "table", 'trigger_type_valid' AS rule, k FROM s WHERE k % 40 = 0 UNION ALL SELECT 'scan', 'status_valid', k FROM s WHERE st = 'P' UNION ALL SELECT 'scan', 'risk_score_range', k FROM s WHERE k % 5 > 0 AND p % 104 - 2 NOT BETWEEN 0 AND 100
  UNION ALL SELECT 'scan', 'skipped_manifests_non_negative', k FROM s WHERE p % 7 = 0 UNION ALL SELECT 'scan', 'classification_valid', k FROM s WHERE k % 6 > 0 AND p % 9 = 0
  UNION ALL SELECT 'report', 'type_valid', k FROM s WHERE k % 50 = 0 UNION ALL SELECT 'report', 'grounding_confidence_valid', k FROM s WHERE k % 4 <> 0 AND k % 31 = 0
  UNION ALL SELECT 'report', 'dependency_matches_type', k FROM s WHERE k % 50 = 0 OR (k % 2 = 0) = (p % 3 > 0))
SELECT "table", rule, k AS scan_id, count(*) OVER (PARTITION BY "table", rule) AS total, (SELECT count(*) FROM s) AS rows FROM v""",
        "Q01 Q03",
    ),
    "history_panels": Query(q_panels, _panel_sql(), "SC18 SNK05 SNK06"),
    "epss_scores": Query(q_epss_scores, _epss_sql(), "SC05 SC06 FN20 FN21"),
}
