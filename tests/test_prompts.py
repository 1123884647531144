"""Prompts, payload checks and documents, with literal expectations."""

import json

from pyspark.sql import functions as F

from keelson.operators import prompts, reports
from keelson.sources import sinks

PASSAGE = "request_id string, position int, chunk_id string, source_path string, similarity double, text string"


def test_dependency_prompts(spark):
    requests = spark.createDataFrame([("a", "reason_available", "q1", '{"x": 1}', "sufficient"), ("b", "odd", None, None, "low"), ("c", "no_reason", "q3", "{}", "sufficient")], "request_id string, branch string, query string, target string, grounding string")
    found = spark.createDataFrame([("a", 2, "c2", None, 0.5, "second"), ("a", 1, "c1", "docs/x.md", 0.9, "y" * 2000), ("a", 3, "c3", "d", 0.4, "z" * 100), ("b", 1, "c4", "d", 0.1, "thin")], PASSAGE)
    got = {r.request_id: r for r in prompts.dependency_prompts(requests, found, budget=1650).collect()}
    assert got["a"].prompt == f"{prompts.TASKS['reason_available']}\n\nThe question asked of the documents: q1\n\nBEGIN TARGET\n{{\"x\": 1}}\nEND TARGET\n\nBEGIN SOURCE\n[1] id: c1\nfrom: docs/x.md\n---\n{'y' * 1600}\n\n[2] id: c2\nfrom: (unknown file)\n---\nsecond\nEND SOURCE\n"
    assert got["a"].shown == 2 and [(t.chunk_id, t.shown) for t in got["a"].trace] == [("c1", True), ("c2", True), ("c3", False)]
    assert prompts.NO_PASSAGES in got["b"].prompt and got["b"].prompt.startswith(prompts.TASKS["no_reason"]) and [(t.chunk_id, t.shown) for t in got["b"].trace] == [("c4", False)] and got["b"].shown == 0
    assert got["c"].trace == [] and prompts.NO_PASSAGES in got["c"].prompt


def test_a_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([("g", n, size) for n, size in enumerate([5, 5, 100, 1])] + [("h", 0, 50)], "g string, n int, size int")
    got = {(r.g, r.n): r.fits for r in prompts.within_budget(rows, "g", F.col("n"), F.col("size"), 20).collect()}
    assert got == {("g", 0): True, ("g", 1): True, ("g", 2): False, ("g", 3): False, ("h", 0): False}


def test_advisories_of_a_prompt(spark):
    rows = [(1, "B", "CVE-1", "high", 7.0, None), (1, "A", "CVE-1", "high", 7.0, "2"), (1, "C", None, None, None, None), *[(1, f"D{n}", None, "low", 1.0 + n, None) for n in range(5)]]
    row = prompts.advisory_lists(spark.createDataFrame(rows, "k int, osv_id string, cve_id string, severity string, cvss double, fixed_version string"), "k").first()
    assert [a.osv_id for a in row.advisories] == ["A", "B", "D4", "D3", "D2"] and row.cves == ["CVE-1", "D4", "D3", "D2", "D1", "D0", "C"]


def test_rows_meet_their_lists_where_they_lie(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 1, None), (None, 1, "n")], "scan_id int, line_no int, x string")
    found = spark.createDataFrame([(1, 1, "B", "CVE-1", "high", 7.0, None), (1, 1, "A", None, "low", 1.0, None), (9, 1, "Z", None, None, None, None), (None, 1, "N", None, None, None, None)], "scan_id int, line_no int, osv_id string, cve_id string, severity string, cvss double, fixed_version string")
    key = ("scan_id", "line_no")
    made = prompts.with_lists(rows.repartition("scan_id"), prompts.advisory_lists(found.repartition("scan_id"), *key), *key)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = {(r.scan_id, r.line_no, r.x): ([a.osv_id for a in r.advisories], r.cves) for r in made.collect()}
    both = (["B", "A"], ["CVE-1", "A"])
    assert got == {(1, 1, "a"): both, (1, 1, "b"): both, (1, 2, "c"): ([], []), (2, 1, None): ([], []), (None, 1, "n"): ([], [])}


def test_rows_of_a_scan_are_ranked_where_they_lie(spark):
    from keelson.catalog import QUERIES

    found = QUERIES["combined_prompts"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in found


def test_payload_shapes(spark):
    good = {"package": " p ", "manifest_path": "m", "ecosystem": "npm", "fix_type": "upgrade", "priority": 1, "extra": 1}
    cases = [
        ({"summary_md": "x", "fixes": [good]}, []), ({"summary_md": "s" * 5000, "fixes": []}, []), ({"summary_md": "x"}, []), ({"summary_md": "", "fixes": []}, ["summary_md"]), ({"fixes": [good]}, ["summary_md"]), ([1], ["not an object"]), ("{", ["not an object"]),
        ({"summary_md": "x", "fixes": [good, {**good, "package": "p" * 215, "manifest_path": "m" * 501}]}, ["fixes.1.package", "fixes.1.manifest_path"]), ({"summary_md": "x", "fixes": [{**good, "package": " " + "p" * 214 + " ", "target_version": "1" * 101}]}, ["fixes.0.target_version"]),
        ({"summary_md": "x", "fixes": [{**good, "ecosystem": "NPM", "fix_type": None, "priority": 1000, "replacement_package": "r" * 215}]}, ["fixes.0.ecosystem", "fixes.0.fix_type", "fixes.0.replacement_package", "fixes.0.priority"]),
    ]
    frame = spark.createDataFrame([(n, p if isinstance(p, str) else json.dumps(p)) for n, (p, _) in enumerate(cases)], "report_id int, payload string")
    got = reports.checked(frame).orderBy("report_id").collect()
    assert [r.wrong for r in got] == [want for _, want in cases] and [r.is_valid for r in got] == [not want for _, want in cases]
    assert len(got[1].summary_md) == 4000


def test_report_documents(spark):
    shape = "report_id int, report_type string, repository string, scan_id int, scoring_formula_version string, generated_at string, model string, grounding_confidence string, project_context string, summary_md string, fixes array<string>, package string, ecosystem string, manifest_path string, resolved_version string, declared_specifier string"
    rows = spark.createDataFrame([(1, "per_dependency", "o/r", 5, "v2", "t", "m", "low", None, "é", ["f"], "p", "npm", "a", "1", None), (2, "combined", "o/r", 5, "v2", "t", "m", None, None, "s", [], None, None, None, None, None)], shape)
    passages = spark.createDataFrame([(1, 2, "c2", "f", "s", "h", 0.5, "two"), (1, None, "c3", "f", "s", "h", 0.4, "not cited"), (1, 1, "c1", "f", "s", "h", 0.25, "one")], "report_id int, cited_at int, chunk_id string, source_path string, source_sha string, heading string, similarity double, text string")
    got = {r.report_id: r.document for r in sinks.report_documents(rows, passages, "note").collect()}
    first, second = json.loads(got[1]), json.loads(got[2])
    assert list(first) == list(sinks.DOCUMENT_FIELDS) == list(second) and "é" in got[1]
    assert [c["chunk_id"] for c in first["citations"]] == ["c1", "c2"] and list(first["citations"][0]) == list(sinks.PASSAGE_FIELDS)
    assert first["dependency"] == {"package": "p", "ecosystem": "npm", "manifest_path": "a", "resolved_version": "1", "declared_specifier": None} and second["dependency"] is None and second["citations"] == [] and second["fixes"] == []


def test_scope_sentences(spark):
    rows = [("P", [], [], False), ("P", [], ["a/b"], False), ("P", ["a/b"], [], True), ("P", ["a/b", "c/d"], ["e/f"], False), ("P", ["a/b", "c/d", "e/f"], ["g/h", "i/j"], True), (None, [], [], False)]
    frame = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, p string, c array<string>, m array<string>, l boolean")
    got = [r[0] for r in frame.orderBy("n").select(reports.scope_sentence(*[F.col(c) for c in "pcml"])).collect()]
    assert got == [
        "Part of the project P.",
        "Part of the project P. No other repository of it has a completed scan, so nothing was compared.",
        "Part of the project P. Compared with the latest scan of a/b as of this report.",
        "Part of the project P. Nothing in this report occurs in the latest scans of a/b and c/d as of this report. e/f has no completed scan and took no part.",
        "Part of the project P. Compared with the latest scans of a/b, c/d and e/f as of this report. g/h and i/j have no completed scan and took no part.",
        None,
    ]


def test_siblings_are_cut_before_they_meet(spark):
    from keelson.operators import analytics

    members = spark.createDataFrame([(r, 1, 10, f"o/r{r:02}") for r in range(1, 61)] + [(99, 1, None, "o/alone")], "repository_id int, user_id int, project_id int, full_name string")
    latest = members.selectExpr("repository_id", "repository_id * 10 AS scan_id")
    lines = [(r * 10, "npm", "p", f"m{n}", n, 1, True, False, "flagged") for r in range(1, 61) for n in range(1 + 60 * (r in (1, 2)))] + [(30, "npm", "q", "m", 1, 1, True, False, "flagged"), (990, "npm", "p", "m", 1, 1, True, False, "flagged"), (40, "npm", "q", "m", 1, 1, False, True, "unassessable")]
    rows = spark.createDataFrame(lines, "scan_id int, ecosystem string, package_name string, manifest_path string, part_id int, line_no int, is_flagged boolean, is_unassessable boolean, status string")
    found = analytics.sibling_lines(members.where("project_id IS NOT NULL"), latest, rows).collect()
    own = {r: [l for l in lines if l[0] == r * 10 and l[2] == "p"] for r in range(1, 61)}
    for subject in (1, 2, 3, 60):
        mine = sorted((x.position, x.package_name, x.full_name, x.manifest_path) for x in found if x.subject_id == subject)
        others = [("p", f"o/r{r:02}", l[3]) for r in range(1, 61) if r != subject for l in sorted(own[r], key=lambda l: (l[3], l[4]))] + [("q", "o/r04", "m")] * (subject == 3)
        assert [x[1:] for x in mine] == others[:40] and {x.omitted for x in found if x.subject_id == subject} == {len(others) - 40}
    assert not any(x.subject_id in (99,) for x in found) and sum(x.subject_id == 4 for x in found) == 40
