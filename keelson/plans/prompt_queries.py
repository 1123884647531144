"""Prompts, payload checks and whole report documents as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Query
from ..operators import prompts, reports, retrieval, rollup, scoring
from ..operators import analytics as a
from ..sources import sinks
from .analytics_queries import FLAGGED, flagged
from .fixtures import KEY, advisory, chunk, occurrence, report, repository, scan_run, table, with_views
from .lifecycle_queries import _COSINE, _queries
from .scoring_queries import CLASS_SQL, KEYS, rolled_sql
from .serving_queries import _FULL, _full_rows

NOTE = "Suggestions only; check before acting."


def q_combined(spark, sf_dir):
    """The prompt of every completed scan under the active weights."""
    scans = scan_run(spark, sf_dir).where("status = 'completed'")
    cards = rollup.rescore(scan_run(spark, sf_dir), occurrence(spark, sf_dir, named=False), "v2").select("scan_id", F.col("score").alias("risk_score"), "classification")
    counts = a.scan_counts(flagged(spark, sf_dir, named=False))
    about = scans.join(repository(spark, sf_dir).select("repository_id", F.col("full_name").alias("repository")), "repository_id").join(cards, "scan_id").join(counts, "scan_id")
    summary = about.withColumn("scoring_formula_version", F.lit("v2"))
    tenths = (F.col("cvss_tenths") / 10).cast("double")
    done = scans.select("scan_id")
    found = advisory(spark, sf_dir, done, together=True).select(*KEY, "osv_id", "cve_id", a.severity(F.col("cvss_tenths")).alias("severity"), tenths.alias("cvss"), F.when(F.col("i") % 2 == 0, F.concat(F.col("i").cast("string"), F.lit(".0"))).alias("fixed_version"))
    reasons = scoring.with_weights(_full_rows(spark, sf_dir, done, together=True).where("is_flagged")).withColumn("flag_reasons", scoring.flag_reasons())
    rows = reasons.select(*KEY, F.col("risk_component_score").alias("score"), *[c for c in prompts.ROW_FIELDS.values() if c not in ("score", "advisories", "cves")])
    filled = prompts.with_lists(rows, prompts.advisory_lists(found, *KEY), *KEY)
    return prompts.combined_prompts(summary, filled, "manifest_path", "package_name", "part_id", "supp_id", "line_no")


def _number(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


COMBINED_SQL = with_views(
    rolled_sql("'v2'", "SELECT scan_id, 'v2' AS used_version FROM scan_run") + ",\n" + _FULL + ",\n" + FLAGGED + f""",
lists AS (SELECT {KEYS}, list({{'osv_id': osv_id, 'cve_id': cve_id, 'severity': CASE WHEN cvss_tenths >= 90 THEN 'critical' WHEN cvss_tenths >= 70 THEN 'high' WHEN cvss_tenths >= 40 THEN 'medium' WHEN cvss_tenths >= 0 THEN 'low' END, 'cvss': cvss_tenths / 10.0::DOUBLE,
    'fixed_version': CASE WHEN i % 2 = 0 THEN i || '.0' END}} ORDER BY coalesce(cvss_tenths, 0) DESC, osv_id) AS every FROM advisory GROUP BY {KEYS}),
named AS (SELECT {KEYS}, list(shown ORDER BY n) AS cves FROM (SELECT {KEYS}, shown, min(n) AS n FROM (SELECT *, coalesce(cve_id, osv_id) AS shown, row_number() OVER (PARTITION BY {KEYS} ORDER BY coalesce(cvss_tenths, 0) DESC, osv_id) AS n FROM advisory) GROUP BY ALL) GROUP BY {KEYS}),
placed AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score, manifest_path, package_name, part_id, supp_id, line_no) AS position, count(*) OVER (PARTITION BY scan_id) AS total FROM full_rows WHERE is_flagged),
rows AS (
  SELECT scan_id, max(greatest(total - 30, 0)) AS omitted, list({{'package': package_name, 'ecosystem': ecosystem, 'manifest_path': manifest_path, 'group': dependency_group, 'declared_specifier': declared_specifier, 'current_version': resolved_version, 'version_source': resolution,
    'latest_version': latest_version, 'versions_behind': {{'major': part_id % 3, 'minor': line_no % 4, 'patch': 0}}, 'deprecated': is_deprecated, 'advisory_count': vulnerability_count, 'highest_severity': highest_severity, 'max_cvss': cvss_tenths / 10.0::DOUBLE,
    'risk_component_score': score / 100.0::DOUBLE, 'flag_reasons': list_filter([CASE WHEN is_deprecated THEN 'deprecated' END, CASE WHEN vulnerability_count > 0 THEN 'vulnerable' END, CASE WHEN staleness_days >= 730 THEN 'stale' END], lambda x: x IS NOT NULL),
    'advisories': coalesce(every[:5], []), 'cves': coalesce(cves, [])}} ORDER BY position) AS rows FROM placed LEFT JOIN lists USING ({KEYS}) LEFT JOIN named USING ({KEYS}) WHERE position <= 30 GROUP BY scan_id),
counts AS (SELECT scan_id, count(DISTINCT manifest_path) AS m, count(*) AS n, count(*) FILTER (WHERE is_flagged) AS f, count(*) FILTER (WHERE is_unassessable) AS u FROM flagged GROUP BY scan_id)
SELECT scan_id, to_json({{'scan': {{'repository': full_name, 'risk_score': score_cents / 100.0::DOUBLE, 'classification': {CLASS_SQL}, 'scoring_formula_version': 'v2', 'manifest_count': m, 'dependency_count': n, 'flagged_count': f, 'clean_count': n - f - u, 'unassessable_count': u,
  'flagged_rows_omitted': coalesce(omitted, 0)}}, 'rows': coalesce(rows, [])}})::VARCHAR AS prompt
FROM scan_run JOIN repository USING (repository_id) JOIN rolled USING (scan_id) JOIN counts USING (scan_id) LEFT JOIN rows USING (scan_id) WHERE status = 'completed'""",
    "repository", "scan_run", "occurrence", "advisory",
)


def q_dependency_prompts(spark, sf_dir):
    """The prompt of every request with its nearest passages, those of thin retrieval hidden but traced."""
    asked = _queries(spark, sf_dir)
    found = retrieval.nearest_chunks(asked, chunk(spark, sf_dir), "package_key")
    grounded = retrieval.grounding(asked, found).select("query_id", "grounding")
    q = F.col("query_id")
    branch = F.element_at(F.array(*map(F.lit, ("reason_available", "no_reason", "fixed_framing", "other"))), (q / 100 % 4 + 1).cast("int"))
    requests = grounded.select(q.alias("request_id"), branch.alias("branch"), F.concat(F.lit("what of "), q.cast("string")).alias("query"), F.to_json(F.struct(q.alias("id"))).alias("target"), "grounding")
    passages = found.select(q.alias("request_id"), "position", F.col("chunk_id").cast("string").alias("chunk_id"), F.when(F.col("chunk_id") % 3 > 0, F.concat(F.lit("docs/"), F.col("chunk_id").cast("string"))).alias("source_path"), "similarity", "text")
    made = prompts.dependency_prompts(requests, passages, budget=4_000)
    return made.select("request_id", "prompt", F.col("shown").cast("long").alias("shown"), F.array_join(F.transform("trace", lambda t: F.concat_ws(":", t["position"], t["chunk_id"], F.when(t["shown"], "shown").otherwise("hidden"))), " ").alias("trace"))


_T = prompts.TASKS
DEPENDENCY_SQL = with_views(
    _COSINE + f""",
near AS (SELECT query_id, chunk_id, position, substr(coalesce(text, ''), 1, 1600) AS text, similarity FROM placed WHERE position <= 5),
best AS (SELECT query_id, max(similarity) AS best, sum(length(coalesce(c.text, ''))) AS n FROM placed c WHERE position <= 5 GROUP BY query_id),
cut AS (SELECT n.*, best >= 0.30 AND b.n >= 400 AND sum(length(text)) OVER (PARTITION BY query_id ORDER BY position) <= 4000 AS shown FROM near n JOIN best b USING (query_id)),
listed AS (SELECT query_id, count(*) FILTER (WHERE shown) AS shown, string_agg('[' || position || '] id: ' || chunk_id || chr(10) || 'from: ' || CASE WHEN chunk_id % 3 > 0 THEN 'docs/' || chunk_id ELSE '(unknown file)' END || chr(10) || '---' || chr(10) || text, chr(10) || chr(10) ORDER BY position) FILTER (WHERE shown) AS blocks,
  string_agg(position || ':' || chunk_id || ':' || CASE WHEN shown THEN 'shown' ELSE 'hidden' END, ' ' ORDER BY position) AS trace FROM cut GROUP BY query_id)
SELECT query_id AS request_id, ['{_T["reason_available"]}', '{_T["no_reason"]}', '{_T["fixed_framing"]}', '{_T["no_reason"]}'][1 + query_id // 100 % 4] || chr(10) || chr(10) || 'The question asked of the documents: what of ' || query_id || chr(10) || chr(10) || 'BEGIN TARGET' || chr(10) || '{{"id":' || query_id || '}}' || chr(10)
  || 'END TARGET' || chr(10) || chr(10) || 'BEGIN SOURCE' || chr(10) || coalesce(blocks, '{prompts.NO_PASSAGES}') || chr(10) || 'END SOURCE' || chr(10) AS prompt, coalesce(shown, 0) AS shown, coalesce(trace, '') AS trace
FROM asked LEFT JOIN listed USING (query_id)""",
    "chunk",
)


def q_payload_shapes(spark, sf_dir):
    """Payloads whose fields break the shape one at a time, by the length of texts of the tables."""
    p = F.col("page_id")
    long = lambda n: F.repeat(F.lit("x"), (p % n).cast("int"))
    fix = F.struct(
        F.concat(F.lit(" "), long(230), F.lit(" ")).alias("package"), F.when(p % 13 > 0, "a/package.json").alias("manifest_path"), F.when(p % 11 == 0, "cargo").otherwise("npm").alias("ecosystem"), F.when(p % 7 == 0, "dance").otherwise("upgrade").alias("fix_type"),
        F.when(p % 5 == 0, long(120)).alias("target_version"), F.lit(None).cast("string").alias("replacement_package"), (p % 17).cast("int").alias("priority"),
    )
    summary = F.when(p % 19 > 0, F.substring(F.col("url"), 1, 20)).otherwise("")
    body = F.to_json(F.struct(F.concat(summary, F.when(p % 3 == 0, F.repeat(F.lit("s"), 5_000)).otherwise("")).alias("summary_md"), F.array(fix).alias("fixes")))
    rows = table(spark, sf_dir, "pages").select(p.alias("report_id"), F.when(p % 23 == 0, "[]").otherwise(body).alias("payload"))
    return reports.checked(rows).select("report_id", "is_valid", F.array_join("wrong", " ").alias("wrong"), F.length("summary_md").alias("summary_length"))


PAYLOAD_SQL = """
WITH p AS (SELECT page_id AS k, CASE WHEN page_id % 19 > 0 THEN length(substr(url, 1, 20)) ELSE 0 END + CASE WHEN page_id % 3 = 0 THEN 5000 ELSE 0 END AS n FROM pages),
w AS (SELECT k, n, CASE WHEN k % 23 = 0 THEN 'not an object' ELSE array_to_string(list_filter([CASE WHEN n = 0 THEN 'summary_md' END, CASE WHEN k % 230 = 0 OR k % 230 > 214 THEN 'fixes.0.package' END, CASE WHEN k % 13 = 0 THEN 'fixes.0.manifest_path' END, CASE WHEN k % 11 = 0 THEN 'fixes.0.ecosystem' END,
  CASE WHEN k % 7 = 0 THEN 'fixes.0.fix_type' END, CASE WHEN k % 5 = 0 AND k % 120 > 100 THEN 'fixes.0.target_version' END, CASE WHEN k % 17 = 0 THEN 'fixes.0.priority' END], lambda x: x IS NOT NULL), ' ') END AS wrong FROM p)
SELECT k AS report_id, wrong = '' AS is_valid, wrong, CASE WHEN k % 23 > 0 THEN least(n, 4000)::INT END AS summary_length FROM w"""


def q_documents(spark, sf_dir):
    """Reports on scans and on dependencies as whole documents, with the passages they cite."""
    s = F.col("scan_id")
    scans = scan_run(spark, sf_dir).select("scan_id", "repository_id", "formula_version")
    named = report(spark, sf_dir).where("status = 'completed'").join(scans, ["scan_id", "repository_id"]).join(repository(spark, sf_dir).select("repository_id", "full_name"), "repository_id")
    lines = occurrence(spark, sf_dir).where("line_no = 1").groupBy("scan_id").agg(F.min(F.struct("package_name", "ecosystem", "manifest_path", "resolved_version")).alias("o"))
    single = s % 3 > 0
    own = lambda c: F.when(single, F.col(f"o.{c}"))
    fix = F.struct(F.lit("upgrade").alias("fix_type"), (s % 9 + 1).alias("priority"))
    rows = named.join(lines, "scan_id", "left").select(
        "report_id", "scan_id", F.when(single, "per_dependency").otherwise("combined").alias("report_type"), F.col("full_name").alias("repository"), F.col("formula_version").alias("scoring_formula_version"), F.lit("2026-01-01T00:00:00Z").alias("generated_at"), F.lit("m").alias("model"),
        F.when(single, F.when(s % 2 == 0, "low").otherwise("sufficient")).alias("grounding_confidence"), F.lit(None).cast("string").alias("project_context"), F.concat(F.lit("About \"scan\" "), s.cast("string")).alias("summary_md"), F.when(s % 5 > 0, F.array(fix)).otherwise(F.array()).alias("fixes"),
        own("package_name").alias("package"), own("ecosystem").alias("ecosystem"), own("manifest_path").alias("manifest_path"), own("resolved_version").alias("resolved_version"), F.lit(None).cast("string").alias("declared_specifier"),
    )
    spread = rows.where(single).select("report_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    cited = F.when(F.col("n") <= F.col("report_id") % 4, 4 - F.col("n"))
    passages = spread.select("report_id", cited.alias("cited_at"), F.concat(F.lit("c"), "n").alias("chunk_id"), F.lit("README.md").alias("source_path"), F.lit("sha").alias("source_sha"), F.lit("").alias("heading"), (F.col("n") / F.lit(8.0)).alias("similarity"), F.concat(F.lit("passage "), "n").alias("text"))
    return sinks.report_documents(rows, passages, NOTE)


DOCUMENTS_SQL = with_views(
    f"""lines AS (SELECT scan_id, min({{'p': package_name, 'e': ecosystem, 'm': manifest_path, 'v': resolved_version}}) AS o FROM occurrence WHERE line_no = 1 GROUP BY scan_id),
r AS (SELECT r.report_id, r.scan_id, formula_version, full_name, o, scan_id % 3 > 0 AS single FROM report r JOIN scan_run s USING (scan_id, repository_id) JOIN repository USING (repository_id) LEFT JOIN lines USING (scan_id) WHERE r.status = 'completed'),
c AS (SELECT report_id, list({{'chunk_id': 'c' || n, 'source_path': 'README.md', 'source_sha': 'sha', 'heading': '', 'similarity': n / 8.0::DOUBLE, 'text': 'passage ' || n}} ORDER BY n DESC) AS c FROM r, (VALUES (1), (2), (3)) AS v(n) WHERE single AND n <= report_id % 4 GROUP BY report_id)
SELECT report_id, to_json({{'schema': 'keelson/report@1', 'report_type': CASE WHEN single THEN 'per_dependency' ELSE 'combined' END, 'repository': full_name, 'scan_id': scan_id::VARCHAR, 'scoring_formula_version': formula_version, 'generated_at': '2026-01-01T00:00:00Z', 'model': 'm',
  'dependency': CASE WHEN single AND o.p IS NOT NULL THEN {{'package': o.p, 'ecosystem': o.e, 'manifest_path': o.m, 'resolved_version': o.v, 'declared_specifier': NULL::VARCHAR}} END, 'grounding_confidence': CASE WHEN single THEN CASE WHEN scan_id % 2 = 0 THEN 'low' ELSE 'sufficient' END END, 'citations': coalesce(c, []), 'project_context': NULL::VARCHAR,
  'note': '{NOTE}', 'summary_md': 'About "scan" ' || scan_id, 'fixes': CASE WHEN scan_id % 5 > 0 THEN [{{'fix_type': 'upgrade', 'priority': scan_id % 9 + 1}}] ELSE [] END}})::VARCHAR AS document FROM r LEFT JOIN c USING (report_id)""",
    "repository", "scan_run", "report", "occurrence",
)

QUERIES = {
    "combined_prompts": Query(q_combined, COMBINED_SQL, "R09 X03 X20 T02 T04"),
    "dependency_prompts": Query(q_dependency_prompts, DEPENDENCY_SQL, "X03 R16"),
    "payload_shapes": Query(q_payload_shapes, PAYLOAD_SQL, "R10 X05 X06"),
    "report_full_documents": Query(q_documents, DOCUMENTS_SQL, "SNK08"),
}
