"""Paging, constraints, reports, projects, the fifth signal and the panel, with literal expectations."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keelson.operators import constraints, paging, panel, scoring, serving, weights


@pytest.fixture(scope="module")
def listing(spark, tmp_path_factory):
    rows = spark.range(0, 1230, numPartitions=3).select((F.col("id") % 7).alias("g"), F.concat(F.lit("n"), F.lpad((F.col("id") * 37 % 1230).cast("string"), 5, "0")).alias("name"), F.col("id"))
    return paging.Listing(str(tmp_path_factory.mktemp("listing") / "l"), ("g", "name")).write(rows.repartition(16))


def test_a_walk_is_the_head_of_the_listing(spark, listing):
    rows, total, cut = listing.walk(spark)
    want = [r.id for r in listing.read(spark).orderBy("g", "name").limit(1000).collect()]
    got = sorted(((r.page, r.g, r.name, r.id) for r in rows.collect()))
    assert [r[3] for r in got] == want and total == 1230 and cut
    assert {p: sum(r[0] == p for r in got) for p in range(1, 21)} == dict.fromkeys(range(1, 21), 50)
    whole, total, cut = listing.walk(spark, size=100, most=20)
    assert whole.count() == 1230 and not cut and whole.agg(F.max("page")).first()[0] == 13


def test_a_page_reads_what_can_hold_it(spark, listing):
    page = listing.page(spark, (5, "n00100"))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(g,5)" in plan
    assert (page.first().g, page.first().name > "n00100") == (5, True)
    assert listing.page(spark, (6, "zzz")).count() == 0 and listing.page(spark, (6, None)).count() == 0


def test_an_empty_listing(spark, tmp_path):
    empty = paging.Listing(f"{tmp_path}/e", ("a",)).write(spark.createDataFrame([], "a int, b int"))
    rows, total, cut = empty.walk(spark)
    assert (rows.count(), total, cut) == (0, 0, False) and rows.columns == ["a", "b", "page"]


def test_constraints_in_one_pass(spark):
    shape = "id int, report_type string, dependency_id int, status string, grounding_confidence string"
    rows = [(1, "combined", None, "queued", None), (2, "combined", 7, "done", "low"), (3, "per_dependency", None, "failed", "none"), (4, "per_dependency", 7, "running", "sufficient"), (5, None, 7, None, None), (6, "weekly", 1, "completed", "low")]
    found, totals = constraints.audit(spark.createDataFrame(rows, shape), constraints.RULES["report"], "id")
    assert {(r.id, r.rule) for r in found.collect()} == {(2, "dependency_matches_type"), (2, "status_valid"), (3, "dependency_matches_type"), (3, "grounding_confidence_valid"), (6, "type_valid"), (6, "dependency_matches_type")}
    assert totals == {"rows": 6, "type_valid": 1, "status_valid": 1, "grounding_confidence_valid": 1, "dependency_matches_type": 3}
    assert constraints.audit(spark.createDataFrame([], shape), constraints.RULES["report"], "id")[1]["rows"] == 0
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        constraints.audit(spark.createDataFrame([(1,)], "id int"), {"x": "missing > 1"}, "id")


def test_reports_are_read_by_key_after_expiry(spark):
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    rows = [(1, "combined", 5, None, "completed", "10:00", "10:00"), (2, "combined", 5, None, "running", "11:00", "11:54"), (3, "per_dependency", 5, 9, "queued", "11:00", "11:55"), (4, "per_dependency", 5, 8, "failed", "09:00", "09:00"), (5, "per_dependency", 5, 8, "completed", "09:00", "09:00")]
    frame = spark.createDataFrame([(*r[:5], *[f"2026-01-01 {t}:00" for t in r[5:]]) for r in rows], "report_id int, report_type string, scan_id int, dependency_id int, status string, created_at string, updated_at string")
    timed = frame.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at")})
    got = {r.report_key: (r.report_id, r.status) for r in serving.current_reports(timed, now).collect()}
    assert got == {"combined:5": (2, "failed"), "per_dependency:5:9": (3, "queued"), "per_dependency:5:8": (5, "completed")}


def test_what_asking_for_a_report_does(spark):
    cases = [
        ("combined", "completed", None, None, None, "create"), ("combined", "running", None, None, "completed", "scan_not_reportable"), ("per_dependency", "running", True, True, None, "not_assessed"), ("per_dependency", "running", False, False, None, "not_flagged"),
        ("per_dependency", "failed", False, True, None, "scan_not_reportable"), ("per_dependency", "completed", False, True, "completed", "cached"), ("per_dependency", "completed", False, True, "queued", "conflict"), ("per_dependency", "completed", False, True, "failed", "requeue"),
    ]
    frame = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, k string, s string, u boolean, f boolean, r string, want string")
    out = frame.orderBy("n").select(serving.request_outcome(*[F.col(c) for c in "ksufr"]).alias("o"), "want").collect()
    assert [r.o for r in out] == [r.want for r in out]


REPOSITORIES = [(1, 1, 10, "b/x"), (2, 1, 10, "a-b/x"), (3, 1, 10, "ab/x"), (4, 1, None, "solo/x"), (5, 1, 11, "lone/x"), (6, 2, 10, "other/x")]


def test_projects(spark):
    repos = spark.createDataFrame(REPOSITORIES, "repository_id int, user_id int, project_id int, full_name string")
    asked = spark.createDataFrame([(1, None), (2, 10), (3, 11), (4, None), (5, None), (6, 99), (77, 10)], "repository_id int, confirm int")
    got = {r.repository_id: (r.outcome, r.deleted, r.member_count, r.other_count, r.names) for r in serving.deletion(repos, asked).collect()}
    names = ["a-b/x", "ab/x", "b/x"]
    assert got == {1: ("confirm_project", 0, 3, 2, names), 2: ("deleted", 3, None, None, None), 3: ("confirm_project", 0, 3, 2, names), 4: ("deleted", 1, None, None, None), 5: ("deleted", 1, None, None, None), 6: ("deleted", 1, None, None, None), 77: ("missing", 0, None, None, None)}
    free, kept = serving.ungroup(repos, spark.createDataFrame([(1, 10), (3, 1)], "user_id int, project_id int"))
    assert {r.repository_id: r.project_id for r in free.collect()} == {1: None, 2: None, 3: None, 4: None, 5: 11, 6: 10} and free.columns == repos.columns
    assert {(r.user_id, r.project_id): r.kept for r in kept.collect()} == {(1, 10): 3, (3, 1): 0}
    states = spark.createDataFrame([(2, 5, "failed", 4)], "repository_id int, latest_scan_id int, latest_status string, latest_completed_id int")
    members = {(r.user_id, r.project_id): [(m.full_name, m.latest_status) for m in r.members] for r in serving.project_members(repos, states).collect()}
    assert members[1, 10] == [("a-b/x", "failed"), ("ab/x", None), ("b/x", None)] and len(members) == 3


ROW = "k int, ecosystem string, is_unassessable boolean, is_deprecated boolean, vulnerability_count int, cvss_tenths int, staleness_days int, epss decimal(6,5)"


def test_the_fifth_signal(spark):
    rows = [(1, "npm", False, True, 0, None, 0, Decimal("0.5")), (2, "npm", False, True, 0, None, 0, None), (3, "npm", False, False, 0, None, None, Decimal("1.0")), (4, "npm", True, True, 0, None, 0, Decimal("1.0"))]
    frame = spark.createDataFrame(rows, ROW)
    got = {r.k: (r.points_epss, r.points_deprecation, r.score, r.redistributed) for r in scoring.score_occurrences(frame, "v3_epss", weights.TRIAL).collect()}
    # Of weights 0.2720 + 0.3829 + 0.1570 + 0.0881 + 0.1 = 1; without the fifth 0.9, without staleness 0.9119.
    assert got == {
        1: (Decimal("5.00"), Decimal("27.20"), Decimal("67.80"), False),
        2: (None, Decimal("30.22"), Decimal("69.78"), True),
        3: (Decimal("10.97"), Decimal("0.00"), Decimal("89.03"), True),
    }
    off = {r.k: (r.points_epss, r.score) for r in scoring.score_occurrences(frame, "v2", weights.TRIAL).collect()}
    plain = {r.k: r.score for r in scoring.score_occurrences(frame.drop("epss"), "v2").collect()}
    assert off == {k: (None, score) for k, score in plain.items()}


def test_panel_accounts_for_every_occurrence(spark):
    scans = spark.createDataFrame([(1, 7, "live_scan", "2026-01-01", None, None, "v1"), (2, 7, "live_scan", "2026-01-02", None, None, "v1"), (3, 8, "corpus_scan", "2026-01-01", None, None, "v2")], "scan_id int, repository_id int, data_source string, created_on string, stored_score decimal(5,2), stored_classification string, formula_version string")
    columns = "scan_id int, part_id int, supp_id int, line_no int, ecosystem string, manifest_path string, package_name string, dependency_group string, resolved_version string, resolution string, is_unassessable boolean, is_deprecated boolean, vulnerability_count int, cvss_tenths int, staleness_days int"
    line = lambda scan, n, unassessable: (scan, n, 1, n, "npm", "m", "p", "runtime", "1", "pinned", unassessable, True, 0, None, 0)
    rows = spark.createDataFrame([line(1, 1, False), line(1, 2, True), line(3, 1, False)], columns)
    key = ("scan_id", "part_id", "supp_id", "line_no")
    found, cards = panel.build(scans, rows, ("v1", "v2", "v1"), *key, source="live_scan")
    assert sorted((r.scan_id, r.line_no, r.used_version, r.score is None, r.recomputed_flagged) for r in found.collect()) == [(1, 1, "v1", False, True), (1, 1, "v2", False, True), (1, 2, "v1", True, False), (1, 2, "v2", True, False)]
    got = {(r.scan_id, r.used_version): (r.dependency_count, r.assessed_count, r.recomputed_flagged_count, r.recomputed_score) for r in cards.collect()}
    assert got[1, "v2"][:3] == (2, 1, 1) and got[2, "v1"] == (0, 0, 0, Decimal("100.00")) and len(got) == 4 and got[1, "v2"][3] == Decimal("72.80")
    assert panel.oldest(scans, None, 2).count() == 2 and {r.scan_id for r in panel.oldest(scans, None, 2).collect()} == {1, 3}
    with pytest.raises(weights.WeightsError, match="v9"):
        panel.build(scans, rows, ("v9",), *key)


def test_scans_meet_lines_before_names_do(spark):
    from keelson.catalog import QUERIES

    for name, kind in (("occurrence_rows", "LeftOuter"), ("history_snapshot", "LeftSemi")):
        plan = QUERIES[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joins = [line for line in plan if f"Join {kind}, (" in line and "w_" not in line]
        assert joins and all("l_orderkey" in line for line in joins)


def test_advisories_are_made_for_the_scans_asked_for(spark):
    from keelson.plans import fixtures

    sf = "/root/testdata/sf0.001"
    done = spark.createDataFrame([(1,), (2,), (3,)], "scan_id long")
    found = fixtures.advisory(spark, sf, scans=done)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    place = lambda text: next(n for n, line in enumerate(plan) if text in line)
    assert place("Generate explode") < place("Join LeftSemi")
    want = fixtures.advisory(spark, sf).join(done, "scan_id", "left_semi")
    assert sorted(found.collect(), key=str) == sorted(want.collect(), key=str)
