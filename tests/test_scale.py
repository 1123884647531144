"""Shapes of plans and of what is written that keep work in proportion to the input."""

from decimal import Decimal

from pyspark.sql import functions as F

from keelson.operators import analytics, paging, panel, retrieval, scoring

LINE = "scan_id int, part_id int, supp_id int, line_no int, ecosystem string, manifest_path string, package_name string, dependency_group string, resolved_version string, resolution string, is_unassessable boolean, is_deprecated boolean, vulnerability_count int, cvss_tenths int, staleness_days int"
KEY = ("scan_id", "part_id", "supp_id", "line_no")


def line(scan, n, unassessable=False, ecosystem="npm"):
    return (scan, n, 1, n, ecosystem, "m", "p", "runtime", "1", "pinned", unassessable, True, 0, None, 0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_and_unassessable_rows_in_one_pass(spark):
    rows = spark.createDataFrame([line(1, 1), line(1, 2, True), line(1, 3, True, "cargo"), line(1, 4, None)], LINE)
    kept = scoring.score_occurrences(rows, keep=True)
    assert {r.line_no: r.score for r in kept.collect()} == {1: scoring.score_occurrences(rows).first().score, 2: None, 3: None}
    assert "Union" not in plan(kept)


def test_wide_rows_of_the_panel_are_not_shuffled(spark):
    rows = spark.createDataFrame([line(1, 1), line(1, 2, True), line(2, 1)], LINE)
    scans = spark.createDataFrame([(1, 7, "live_scan", "2026-01-01", None, None, "v1")], "scan_id int, repository_id int, data_source string, created_on string, stored_score decimal(5,2), stored_classification string, formula_version string")
    wide = panel.occurrence_panel(rows.withColumns({"data_source": F.lit("live_scan"), "created_on": F.lit("2026-01-01")}), ("v1", "v2"), *KEY)
    assert "hashpartitioning" not in plan(wide) and wide.count() == 6
    cards = panel.rolled(scans, rows, ("v1", "v2"), *KEY)
    assert {r.used_version: r.score for r in cards.collect()}["v2"] == Decimal("72.80")


def test_siblings_lines_are_made_once(spark):
    members = spark.createDataFrame([(1, 1, 10, "o/a"), (2, 1, 10, "o/b")], "repository_id int, user_id int, project_id int, full_name string")
    rows = spark.createDataFrame([(n, "npm", "p", "m", 1, 1, True, False, "flagged") for n in (1, 2)], "scan_id int, ecosystem string, package_name string, manifest_path string, part_id int, line_no int, is_flagged boolean, is_unassessable boolean, status string")
    found = analytics.sibling_lines(members, members.selectExpr("repository_id", "repository_id AS scan_id"), rows)
    assert "ExistingRDD" not in plan(found) and sorted(r.subject_id for r in found.collect()) == [1, 2]


def test_manifests_are_counted_in_one_aggregate(spark):
    manifests = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None)], "scan_id int, manifest_path string")
    lines = spark.createDataFrame([(1, "a"), (1, "a"), (1, "c"), (2, None)], "scan_id int, manifest_path string")
    found = analytics.manifest_counts(manifests, lines)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "a", 2), (1, "b", 0), (2, None, 0)] and "Join" not in plan(found)


def test_counts_meet_their_scans_as_one_row_each(spark):
    from keelson.catalog import QUERIES

    found = plan(QUERIES["counts_updated"].run(spark, "/root/testdata/sf0.001"))
    assert "lineitem" not in found and "Aggregate" not in found


def test_few_texts_are_python_objects_at_once(spark):
    texts = spark.range(0, 200, 1, 1).select(F.struct("id").alias("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("# h\n"), F.repeat(F.lit("word "), 300))).alias("text"))
    found = retrieval.chunk_documents(texts, "id")
    assert "MapInArrow" in plan(found) and retrieval.TEXTS_AT_ONCE < 100
    assert sorted((r.id.id, r.chunk_index) for r in found.collect()) == [(n, i) for n in range(200) if n % 3 for i in (0, 1)]


def test_lengths_are_taken_once_a_vector(spark):
    queries = spark.createDataFrame([("k", "q", [1.0, 0.0])], "key string, query_id string, query_vector array<float>")
    chunks = spark.createDataFrame([("k", "a", [2.0, 0.0]), ("k", "b", [0.0, 3.0]), ("k", "z", [0.0, 0.0])], "key string, chunk_id string, vector array<float>")
    found = retrieval.nearest_chunks(queries, chunks, "key")
    assert {r.chunk_id: r.similarity for r in found.collect()}["a"] == 1.0
    joined = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "zip_with" in x.lower())
    assert joined.lower().count("zip_with") == 1


def test_a_walk_reads_the_ranges_of_its_pages(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 5000, 1, 4).select((F.col("id") * 7 % 5000).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listing = paging.Listing(f"{tmp_path}/l", ("k",)).write(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen, plain = [], paging.Listing._after
    monkeypatch.setattr(paging.Listing, "_after", lambda self, near, after: seen.append(near.count()) or plain(self, near, after))
    walked, total, cut = listing.walk(spark, size=100, most=30)
    assert sorted((r.k, r.page) for r in walked.collect()) == [(k, k // 100 + 1) for k in range(3000)] and (total, cut) == (5000, True)
    assert len(seen) == 30 and max(seen) < 4000


def test_lines_meet_their_scans_once_for_all_appends(spark, monkeypatch):
    from keelson.catalog import QUERIES
    from keelson.operators import lifecycle

    seen, plain = [], lifecycle.append_history
    monkeypatch.setattr(lifecycle, "append_history", lambda rows, path: seen.append((path, plan(rows))) or plain(rows, path))
    QUERIES["history_appended"].run(spark, "/root/testdata/sf0.001")
    appended = [p for path, p in seen if path.endswith("/occurrences")]
    assert len(appended) == 2 and not any("Join" in p or "lineitem" in p for p in appended)


def test_answers_are_read_once(spark):
    from keelson.catalog import QUERIES

    found = plan(QUERIES["advisory_answers"].run(spark, "/root/testdata/sf0.001"))
    assert "advisory_batches" not in found and "BatchScan" not in found


def test_the_panel_deals_lines_and_scans_once(spark):
    rows = spark.createDataFrame([line(1, 1), line(1, 2, True), line(2, 1)], LINE)
    scans = spark.createDataFrame([(n, 7, "live_scan", "2026-01-01", None, None, "v1") for n in (1, 2, 3)], "scan_id int, repository_id int, data_source string, created_on string, stored_score decimal(5,2), stored_classification string, formula_version string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(panel.repository_panel(panel.rolled(scans, rows, ("v1", "v2"), *KEY)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.count("Exchange hashpartitioning(scan_id") == found.count("Exchange hashpartitioning") == 2


def test_cards_of_the_panel_are_those_of_the_roll_up(spark):
    from keelson.operators import rollup

    wide = lambda scan, n: (*line(scan, n, n % 7 == 0, "npm" if n % 2 else "pypi")[:11], n % 3 == 0, n % 5, n * 7 % 100 if n % 4 else None, n * 40 if n % 6 else None)
    rows = spark.createDataFrame([*(wide(1, n) for n in range(1, 90)), *(wide(2, n) for n in range(1, 4)), wide(3, 7), line(4, 1, None), line(None, 1)], LINE)
    scans = spark.createDataFrame([(n, 7) for n in (1, 1, 2, 3, 4, 5)], "scan_id int, repository_id int")
    got = panel.rolled(scans, rows, ("v0_equal", "v1", "v2"), *KEY).drop("repository_id")
    for v in ("v0_equal", "v1", "v2"):
        want = rollup.roll_up(scans.select("scan_id", F.lit(v).alias("used_version")), rows, v)
        assert sorted(map(tuple, got.where(F.col("used_version") == v).select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_panels_are_written_small(spark, tmp_path):
    from keelson.sources import sinks

    rows = spark.range(0, 20_000, 1, 2).select("id", F.lit('a "quoted", cell\nof two lines').alias("cell"), (F.col("id") % 2 == 0).alias("even"), F.when(F.col("id") % 3 == 0, "x").alias("some"))
    sinks.write_panel(rows, f"{tmp_path}/p")
    files = [f for f in (tmp_path / "p").iterdir() if f.name.startswith("part-")]
    assert len(files) == 2 and sum(f.stat().st_size for f in files) < 20_000 * 10
    read = sinks.read_panel(spark, f"{tmp_path}/p", *rows.columns)
    assert sorted(map(tuple, read.collect())) == sorted((str(n), 'a "quoted", cell\nof two lines', str(n % 2 == 0), "" if n % 3 else "x") for n in range(20_000))


def test_shuffled_files_are_released(spark, tmp_path):
    import time

    from keelson.session import released

    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in held if "shuffle_" in f}

    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    was = spark.conf.get(name, None)
    with released(spark):
        spark.range(1000).groupBy(F.col("id") % 10).count().write.parquet(f"{tmp_path}/a")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(name, None) == was


def test_a_panel_written_in_parts_is_whole(spark, tmp_path, monkeypatch):
    from keelson.sources import sinks

    seen, plain = [], sinks.write_panel
    monkeypatch.setattr(sinks, "write_panel", lambda rows, path, *mode: seen.append((path, rows.count())) or plain(rows, path, *mode))
    lines = [*(line(n % 30, n, n % 9 == 0) for n in range(1, 200)), line(None, 200)]
    rows = panel.occurrence_panel(spark.createDataFrame(lines, LINE).withColumns({"data_source": F.lit("live_scan"), "created_on": F.lit("2026-01-01")}), ("v1", "v2"), *KEY)
    cards = spark.createDataFrame([(1, "v1", 2, None, None)], "scan_id int, used_version string, dependency_count long, recomputed_score decimal(5,2), stored_score decimal(5,2)")
    panel.write(rows, cards, f"{tmp_path}/h")
    parts = [n for path, n in seen if path.endswith("_occurrences")]
    assert len(parts) == panel.PARTS > 1 and 0 < max(parts) < sum(parts) == 400
    read = sinks.read_panel(spark, f"{tmp_path}/h_occurrences", *panel.OCCURRENCE_COLUMNS)
    told = sorted(("" if scan is None else str(scan), v) for scan, *_ in lines for v in ("v1", "v2"))
    assert sorted((r.scan_id, r.used_version) for r in read.collect()) == told
