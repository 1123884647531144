"""Lifecycle, integrity, retrieval and report operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Query
from ..operators import analytics as a
from ..operators import enrich, lifecycle, quality, reports, retrieval
from ..operators.weights import TRIAL, usable_version
from .analytics_queries import CLOCKED, NOW, clocked
from .fixtures import KEY, advisory, chunk, occurrence, report, repository, scan_run, table, with_views
from .scoring_queries import KEYS

def q_expire(spark, sf_dir):
    """Scans by the time they were created, and their reports by the time of their last change."""
    now = F.lit(NOW).cast("timestamp")
    scans = clocked(scan_run(spark, sf_dir)).select("scan_id", lifecycle.expired(F.col("status"), F.col("created_at"), now, lifecycle.SCAN_MINUTES).alias("status"))
    changed = now - F.make_interval(mins=(F.col("report_id") % 11).cast("int"))
    reports = report(spark, sf_dir).select("scan_id", lifecycle.expired(F.col("status"), changed, now, lifecycle.REPORT_MINUTES).alias("report_status"))
    return scans.join(reports, "scan_id", "left")


def q_prune(spark, sf_dir):
    scans = scan_run(spark, sf_dir)
    return lifecycle.prune(scans, a.latest_completed(scans)).select("scan_id", "repository_id")


def q_cascade(spark, sf_dir):
    scans = scan_run(spark, sf_dir)
    deleted = lifecycle.prune(scans, a.latest_completed(scans))
    return lifecycle.cascade(occurrence(spark, sf_dir, named=False), deleted).groupBy("scan_id").agg(F.count("*").alias("n_deleted"))


def q_at_risk(spark, sf_dir):
    return lifecycle.reports_at_risk(scan_run(spark, sf_dir), report(spark, sf_dir))


def q_start_outcome(spark, sf_dir):
    scans = scan_run(spark, sf_dir)
    active = a.active_scans(clocked(scans), F.lit(NOW).cast("timestamp"), lifecycle.SCAN_MINUTES).withColumnRenamed("scan_id", "active_id")
    joined = lifecycle.reports_at_risk(scans, report(spark, sf_dir)).join(active, "repository_id", "left")
    return joined.select("repository_id", lifecycle.start_outcome(F.col("reports_at_risk"), F.col("active_id"), F.col("repository_id") % 2 == 0).alias("outcome"))


def q_sweep(spark, sf_dir):
    collections = table(spark, sf_dir, "events").select((F.col("event_id") * 7).alias("scan_id"))
    active = report(spark, sf_dir).where("status = 'running'")
    return lifecycle.sweep(collections, scan_run(spark, sf_dir), active)


def q_report_decision(spark, sf_dir):
    joined = scan_run(spark, sf_dir).select("scan_id").join(report(spark, sf_dir).select("scan_id", "status"), "scan_id", "left")
    return joined.select("scan_id", lifecycle.report_decision(F.col("status")).alias("decision"))


def q_upsert(spark, sf_dir):
    rows = occurrence(spark, sf_dir)
    known = rows.where("ecosystem = 'npm'").select("ecosystem", "package_name").distinct()
    return lifecycle.upsert(known, rows.select("ecosystem", "package_name"), "ecosystem", "package_name")


def q_violations(spark, sf_dir):
    rules = {
        "quantity_range": F.col("l_quantity").between(1, 45),
        "discount_range": F.col("l_discount").between(0, 0.08),
        "flag_member": F.col("l_returnflag").isin("A", "N"),
    }
    return quality.violations(table(spark, sf_dir, "lineitem"), rules, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def q_duplicates(spark, sf_dir):
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def q_partial_unique(spark, sf_dir):
    found = quality.duplicate_keys(scan_run(spark, sf_dir), "repository_id", "created_on", where=F.col("status") == "completed")
    return found.withColumn("created_on", F.col("created_on").cast("string"))


def q_orphans(spark, sf_dir):
    return quality.orphans(table(spark, sf_dir, "events").select("event_id", F.col("user_id")), table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0"), "user_id", "c_custkey").select("event_id", "user_id")


def q_dedupe(spark, sf_dir):
    rows = advisory(spark, sf_dir)
    return quality.dedupe_advisories(rows.unionByName(rows.where("i = 1")), *KEY).groupBy(*KEY).agg(F.count("*").alias("n"))


def q_registration(spark, sf_dir):
    c = F.col("repository_id")
    ladder = [("repo_inaccessible", c % 11 == 0), ("no_write_access", c % 7 == 0), ("repo_empty", c % 5 == 0), ("no_manifest", c % 13 == 0), ("duplicate", c % 17 == 0)]
    return repository(spark, sf_dir).select("repository_id", quality.first_failure(ladder, "created").alias("outcome"))


def q_project_rules(spark, sf_dir):
    name = F.regexp_replace(F.trim(F.concat(F.lit(" Project  "), F.col("user_id").cast("string"), F.when(F.col("project_id") % 9 == 0, F.repeat(F.lit("x"), 90)).otherwise(""))), r"\s+", " ")
    grouped = repository(spark, sf_dir).groupBy("user_id", "project_id").agg(F.count_distinct("repository_id").alias("members"), F.count("*").alias("rows"))
    ladder = [("name_invalid", ~F.length(name).between(1, 80)), ("too_few", F.col("members") < 2), ("already_grouped", F.col("project_id").isNotNull() & (F.col("project_id") % 2 == 0))]
    return grouped.select("user_id", "project_id", quality.first_failure(ladder, "ok").alias("outcome"))


def q_duplicate_registration(spark, sf_dir):
    """Pairs of registrations that agree in remote id, or in owner and name; the earlier one stands first."""
    rows = repository(spark, sf_dir).select("repository_id", "owner", (F.col("repository_id") % 499).alias("remote_id"), (F.col("repository_id") % 211).alias("name_class"))
    return quality.matching_pairs(rows, "repository_id", ("remote_id",), ("owner", "name_class"))


def q_all_unavailable(spark, sf_dir):
    rows = occurrence(spark, sf_dir).select("ecosystem", "package_name", "part_id").distinct()
    facts = rows.select("ecosystem", "package_name", ((F.col("ecosystem") == "pypi") | (F.col("part_id") % 3 == 0)).alias("unavailable"))
    return enrich.failed_ecosystems(facts)


def q_facts_join(spark, sf_dir):
    """Null-safe version: occurrences whose version is unknown meet the facts kept without one."""
    rows = occurrence(spark, sf_dir).select(*KEY, "ecosystem", F.col("package_name").alias("name"), F.when(F.col("line_no") != 2, F.col("resolved_version")).alias("resolved_version"))
    facts = rows.where("line_no <= 3").select("ecosystem", "name", "resolved_version").distinct().withColumn("seen", F.lit(True))
    return enrich.with_facts(rows, facts).select(*KEY, F.coalesce("f_seen", F.lit(False)).alias("has_facts"))


def q_exits(spark, sf_dir):
    reason = F.when(F.col("line_no") == 4, "git_specifier")
    found = enrich.exits(reason, F.col("part_id") % 10 == 0, F.col("part_id") % 15 == 0)
    return occurrence(spark, sf_dir, named=False).select(*KEY, found.alias("reason"))


def q_advisory_lookup(spark, sf_dir):
    rows = advisory(spark, sf_dir)
    chance = table(spark, sf_dir, "part").select(F.concat(F.lit(" cve-2024-"), (F.col("p_partkey") + 900).cast("string"), F.lit(" ")).alias("cve"), (F.col("p_partkey") % 100).alias("epss"))
    probabilities = chance.select(F.upper(F.trim("cve")).alias("cve_id"), "epss").dropDuplicates(["cve_id"])
    return rows.join(probabilities, "cve_id", "left").select(*KEY, "i", "cve_id", "epss")


def _declared(spark, sf_dir):
    version = F.when(F.col("line_no") != 2, F.col("resolved_version"))
    reason = F.when(F.col("is_unassessable"), "git_specifier")
    return occurrence(spark, sf_dir).select(*KEY, "ecosystem", F.col("package_name").alias("name"), version.alias("resolved_version"), "is_unassessable", reason.alias("unassessable_reason"))


def q_advisory_batches(spark, sf_dir):
    """How many targets are asked for, and whether a batch has more than it may."""
    found = enrich.batches(enrich.targets(_declared(spark, sf_dir)), "ecosystem", "name", "resolved_version")
    return found.groupBy("batch").agg(F.count("*").alias("n")).agg(F.sum("n").alias("targets"), F.coalesce(F.max("n") > enrich.BATCH, F.lit(False)).alias("too_large"))


def q_advisory_path(spark, sf_dir):
    """Ids by name and version (none to two of each), documents by id (some are missing), probabilities by CVE."""
    rows = _declared(spark, sf_dir)
    many = F.length("name") % 3
    asked = enrich.targets(rows).where("resolved_version IS NOT NULL").withColumn("i", F.explode(F.when(many > 0, F.sequence(F.lit(1), many)))).withColumn("osv_id", F.concat_ws("-", F.lit("OSV"), "name", "resolved_version", "i"))
    hits = asked.select("ecosystem", "name", F.col("resolved_version").alias("version"), "osv_id")
    document = F.when((F.col("i") == 1) | (F.length("name") % 2 == 1), "{}")
    documents = asked.select("osv_id", document.alias("document"), F.when(F.col("i") == 1, F.concat(F.lit(" cve-2024-"), 1000 + F.length("name"))).alias("cve_id"))
    chance = table(spark, sf_dir, "part").select(F.concat(F.lit("CVE-2024-"), F.col("p_partkey") + 900).alias("cve"), (F.col("p_partkey") % 100).alias("epss"))
    return enrich.advisories(rows, hits, documents, chance).select(*KEY, "osv_id", F.trim("cve_id").alias("cve_id"), "epss")


def _queries(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    return vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("package_key"), F.col("embedding").alias("query_vector"))


def q_cosine(spark, sf_dir):
    found = retrieval.nearest_chunks(_queries(spark, sf_dir), chunk(spark, sf_dir), "package_key")
    return found.select("query_id", "position", "chunk_id", "similarity")


def q_grounding(spark, sf_dir):
    asked = _queries(spark, sf_dir)
    found = retrieval.nearest_chunks(asked, chunk(spark, sf_dir), "package_key")
    return retrieval.grounding(asked, found).select("query_id", F.col("n_chars").cast("long").alias("n_chars"), "grounding")


def q_chunk_windows(spark, sf_dir):
    return retrieval.chunk_documents(table(spark, sf_dir, "documents"), "doc_id")


def q_framing(spark, sf_dir):
    fixed = F.when(F.col("line_no") == 7, "9.9.9")
    latest = F.when(F.col("part_id") % 3 != 0, F.concat((F.col("part_id") % 5 + 1).cast("string"), F.lit(".0.0")))
    branch, text = retrieval.framed_query(F.col("package_name"), F.col("resolved_version"), F.col("deprecation_reason"), fixed, latest)
    return occurrence(spark, sf_dir).select(*KEY, branch.alias("branch"), text.alias("query"))


def _payloads(spark, sf_dir):
    s = F.col("s_suppkey").cast("string")
    fix = lambda name, kind, priority: F.concat(F.lit('{"package": "'), name, F.lit(f'", "manifest_path": "package.json", "ecosystem": "npm", "fix_type": "{kind}", "target_version": "2.0.0", "priority": {priority}, "extra": 1}}'))
    listed = F.concat_ws(",", fix(F.concat(F.lit(" Pkg-"), s), "upgrade", 5), fix(F.lit("ghost"), "remove", 1), fix(F.concat(F.lit("pkg-"), s), "replace", 2), fix(F.concat(F.lit("aux-"), s), "investigate", 3), fix(F.lit("bad"), "dance", 1))
    payload = F.concat(F.lit('{"summary_md": "x", "fixes": ['), listed, F.lit('], "citations": ["[A3F9C21B4E77]", "chunk a3f9c21b4e", "a3f9c21b", "a3f9", "deadbeef00aa"]}'))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report_id"), F.when(F.col("s_suppkey") % 8 == 0, "[1]").otherwise(payload).alias("payload"))


def _scanned(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report_id"), F.explode(F.array(F.lit("pkg-"), F.lit("aux-"))).alias("p"))
    name = F.concat("p", F.col("report_id").cast("string"))
    return s.select("report_id", reports.identity(F.lit("npm"), name, F.lit("package.json")).alias("identity"), F.lit("1.0.0").alias("current_version"), F.lit("high").alias("severity"))


def q_payloads(spark, sf_dir):
    found = reports.grounded(reports.fixes(_payloads(spark, sf_dir)), _scanned(spark, sf_dir), drop_unmatched=True)
    return found.select("report_id", "priority", F.trim("package").alias("package"), "fix_type", "current_version")


def q_payload_rejects(spark, sf_dir):
    found = reports.fixes(_payloads(spark, sf_dir))
    return reports.violations(found, _scanned(spark, sf_dir))


def q_citations(spark, sf_dir):
    chunks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report_id"), F.explode(F.array(F.lit("a3f9c21b4e77"), F.lit("a3f9c21b0000"))).alias("chunk_id"))
    return reports.citations(_payloads(spark, sf_dir), chunks)


def q_weights_fallback(spark, sf_dir):
    """Versions without a file, with one that is no YAML, and with one that breaks a rule fall back, each for itself."""
    tags = F.element_at(F.array(*map(F.lit, ("v9", "v3_epss", "v4_unsound", "v5_broken", "v2"))), (F.col("scan_id") % 5 + 1).cast("int"))
    shipped = usable_version(F.when(F.col("scan_id") % 4 == 0, "v9").otherwise(F.col("formula_version")))
    return scan_run(spark, sf_dir).select("scan_id", shipped.alias("version"), usable_version(tags, TRIAL).alias("trial_version"))


def q_failure_message(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("rate_limited", "unauthorized", "other"))), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", lifecycle.failure_message(kinds).alias("message"))


_LATEST = "latest AS (SELECT repository_id, arg_max(scan_id, (created_on, scan_id)) AS keep_id FROM scan_run WHERE status = 'completed' GROUP BY repository_id)"
_ACTIVE = f"{CLOCKED},\nactive AS (SELECT DISTINCT repository_id FROM clocked WHERE status IN ('queued', 'running') AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE)"
_RISK = "risk AS (SELECT repository_id, count(report_id) FILTER (WHERE r.status = 'completed') AS n FROM scan_run s LEFT JOIN report r USING (repository_id, scan_id) GROUP BY repository_id)"
_COSINE = """chunks AS (SELECT * FROM chunk),
asked AS (SELECT vec_id AS query_id, label AS package_key, embedding AS query_vector FROM embeddings WHERE vec_id % 100 = 0),
pairs AS (SELECT query_id, chunk_id, text, round(least(greatest(list_dot_product(query_vector::DOUBLE[], vector::DOUBLE[]) / (sqrt(list_dot_product(query_vector::DOUBLE[], query_vector::DOUBLE[])) * sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[]))), 0), 1), 4) AS similarity
  FROM asked JOIN chunks USING (package_key)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS position FROM pairs)"""
_ENDS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
_SPACES = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_stripped = lambda x: f"regexp_replace({x}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"
#: The chunks of every document, by recursion over each section's windows, and their numbers.
_FIRSTS_SQL = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, sha1(coalesce(text, '')) AS sha, unnest(string_split(regexp_replace(coalesce(text, ''), '{_ENDS}', chr(10), 'g'), chr(10))) AS line,
         generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '{_ENDS}', chr(10), 'g'), chr(10)), 1) AS n FROM documents),
fenced AS (SELECT *, regexp_matches(line, '^{_SPACES}*(```|~~~)') AS fence, count(*) FILTER (WHERE regexp_matches(line, '^{_SPACES}*(```|~~~)')) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM lines),
titled AS (SELECT *, NOT fence AND fences % 2 = 0 AND regexp_matches(line, '^#{{1,6}}{_SPACES}+[^\n]*[^\\s]') AS title FROM fenced),
numbered AS (SELECT *, count(*) FILTER (WHERE title) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM titled),
bodies AS (
  SELECT doc_id, sha, section, coalesce(max(regexp_extract(line, '^#+') || ' ' || {_stripped("regexp_replace(line, '^#+', '')")}) FILTER (WHERE title), '') AS heading,
         {_stripped("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT title), '')")} AS body FROM numbered GROUP BY doc_id, sha, section),
cut AS (
  SELECT doc_id, sha, section, heading, body, 0 AS first, 0 AS last, 0 AS n FROM bodies WHERE body <> ''
  UNION ALL
  SELECT doc_id, sha, section, heading, body, start,
         CASE WHEN start + 1200 >= length(body) THEN length(body)
              WHEN strpos(back, chr(10) || chr(10)) > 0 THEN start + 1200 - strpos(back, chr(10) || chr(10)) + 1
              WHEN strpos(back, chr(10)) > 0 THEN start + 1200 - strpos(back, chr(10)) + 1 ELSE start + 1200 END, n + 1
  FROM (SELECT *, reverse(substr(body, start + 601, 600)) AS back FROM (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(first + 1, last - 200) END AS start FROM cut WHERE last < length(body)))),
pieces AS (
  SELECT doc_id, sha, section, n, heading, {_stripped("substr(body, first + 1, last - first)")} AS piece FROM cut WHERE n > 0),
wholes AS (
  SELECT doc_id, section, n, heading, CASE WHEN heading = '' THEN piece ELSE heading || chr(10) || piece END AS text, sha FROM pieces WHERE piece <> ''),
firsts AS (
  SELECT *, sha256(sha || chr(0) || 'README.md' || chr(0) || text)[:12] AS chunk_id FROM wholes WHERE length(text) >= 40
  QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY section, n) = 1)"""
_NUMBERED_SQL = "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section, n) - 1)::INT AS chunk_index, chunk_id, heading, text FROM firsts"
#: Expression ``kept``: the chunks that a store takes of every document.
CHUNKS_SQL = f"""{_FIRSTS_SQL},
kept AS (
  {_NUMBERED_SQL} QUALIFY chunk_index < 120)
"""
QUERIES = {
    "expire_stale": Query(
        q_expire, with_views(f"""{CLOCKED}
SELECT scan_id, CASE WHEN c.status IN ('queued', 'running') AND created_at < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE THEN 'failed' ELSE c.status END AS status,
       CASE WHEN r.status = 'running' AND scan_id % 11 > 5 THEN 'failed' ELSE r.status END AS report_status FROM clocked c LEFT JOIN report r USING (scan_id)""", "scan_run", "report"), "P08"
    ),
    "prune_prior_scans": Query(q_prune, with_views(_LATEST + "\nSELECT scan_id, repository_id FROM scan_run JOIN latest USING (repository_id) WHERE scan_id <> keep_id", "scan_run"), "SNK04"),
    "cascade_delete": Query(
        q_cascade,
        with_views(_LATEST + "\nSELECT scan_id, count(*) AS n_deleted FROM occurrence JOIN scan_run USING (scan_id) JOIN latest USING (repository_id) WHERE scan_id <> keep_id GROUP BY scan_id", "scan_run", "occurrence"),
        "SNK04 Q04",
    ),
    "reports_at_risk": Query(q_at_risk, with_views(_RISK + "\nSELECT repository_id, n AS reports_at_risk FROM risk", "scan_run", "report"), "A06"),
    "scan_start_outcome": Query(
        q_start_outcome,
        with_views(_RISK + ",\n" + _ACTIVE + """
SELECT repository_id, CASE WHEN a.repository_id IS NOT NULL THEN 'already_running' WHEN n > 0 AND r.repository_id % 2 <> 0 THEN 'confirmation_needed' ELSE 'started' END AS outcome
FROM risk r LEFT JOIN active a USING (repository_id)""", "scan_run", "report"),
        "Q09 X21",
    ),
    "orphan_sweep": Query(
        q_sweep,
        with_views("""c AS (SELECT event_id * 7 AS scan_id FROM events)
SELECT c.scan_id, CASE WHEN s.scan_id IS NULL THEN 'drop_orphan' WHEN r.scan_id IS NULL THEN 'drop_idle' ELSE 'keep' END AS action
FROM c LEFT JOIN scan_run s USING (scan_id) LEFT JOIN (SELECT scan_id FROM report WHERE status = 'running') r USING (scan_id)""", "scan_run", "report"),
        "J11",
    ),
    "report_decision": Query(
        q_report_decision,
        with_views("SELECT scan_id, CASE r.status WHEN 'completed' THEN 'cached' WHEN 'running' THEN 'conflict' WHEN 'failed' THEN 'requeue' ELSE 'create' END AS decision FROM scan_run LEFT JOIN report r USING (scan_id)", "scan_run", "report"),
        "R14",
    ),
    "package_upsert": Query(q_upsert, with_views("SELECT DISTINCT ecosystem, package_name FROM occurrence", "occurrence"), "SNK01 S02 S04"),
    "constraint_violations": Query(
        q_violations,
        """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'quantity_range' AS rule FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 45
UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'discount_range' FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.08::DOUBLE
UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'flag_member' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')""",
        "Q01",
    ),
    "duplicate_keys": Query(q_duplicates, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", "Q02"),
    "partial_unique_keys": Query(q_partial_unique, with_views("SELECT repository_id, created_on::VARCHAR AS created_on, count(*) AS n FROM scan_run WHERE status = 'completed' GROUP BY ALL HAVING count(*) > 1", "scan_run"), "Q02"),
    "fk_orphans": Query(q_orphans, "SELECT event_id, user_id FROM events ANTI JOIN (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 3 <> 0) USING (user_id)", "Q04"),
    "advisory_dedupe": Query(q_dedupe, with_views(f"SELECT {KEYS}, count(DISTINCT osv_id) AS n FROM advisory GROUP BY {KEYS}", "advisory"), "Q05"),
    "registration_ladder": Query(
        q_registration,
        with_views("""SELECT repository_id, CASE WHEN repository_id % 11 = 0 THEN 'repo_inaccessible' WHEN repository_id % 7 = 0 THEN 'no_write_access' WHEN repository_id % 5 = 0 THEN 'repo_empty'
WHEN repository_id % 13 = 0 THEN 'no_manifest' WHEN repository_id % 17 = 0 THEN 'duplicate' ELSE 'created' END AS outcome FROM repository""", "repository"),
        "Q07 X22",
    ),
    "project_rules": Query(
        q_project_rules,
        with_views("""g AS (SELECT user_id, project_id, count(DISTINCT repository_id) AS members FROM repository GROUP BY ALL)
SELECT user_id, project_id, CASE WHEN project_id % 9 = 0 THEN 'name_invalid' WHEN members < 2 THEN 'too_few' WHEN project_id % 2 = 0 THEN 'already_grouped' ELSE 'ok' END AS outcome FROM g""", "repository"),
        "Q06",
    ),
    "duplicate_registrations": Query(
        q_duplicate_registration,
        with_views("""SELECT a.repository_id, b.repository_id AS o_repository_id FROM repository a JOIN repository b ON a.repository_id < b.repository_id
AND (a.repository_id % 499 = b.repository_id % 499 OR a.owner = b.owner AND a.repository_id % 211 = b.repository_id % 211)""", "repository"),
        "J19",
    ),
    "all_unavailable": Query(q_all_unavailable, "SELECT 'pypi' AS ecosystem", "A09"),
    "facts_join": Query(
        q_facts_join,
        with_views(f"""rows AS (SELECT {KEYS}, ecosystem, package_name AS name, CASE WHEN line_no <> 2 THEN resolved_version END AS v FROM occurrence),
facts AS (SELECT DISTINCT ecosystem, name, v FROM rows WHERE line_no <= 3)
SELECT {KEYS}, f.ecosystem IS NOT NULL AS has_facts FROM rows r LEFT JOIN facts f ON r.ecosystem = f.ecosystem AND r.name = f.name AND r.v IS NOT DISTINCT FROM f.v""", "occurrence"),
        "J05",
    ),
    "assessment_exits": Query(
        q_exits,
        with_views(f"SELECT {KEYS}, CASE WHEN line_no = 4 THEN 'git_specifier' WHEN part_id % 10 = 0 THEN 'registry_unavailable' WHEN part_id % 15 = 0 THEN 'not_in_registry' END AS reason FROM occurrence", "occurrence"),
        "P06 P09",
    ),
    "advisory_batches": Query(
        q_advisory_batches,
        with_views("""SELECT count(*)::BIGINT AS targets, false AS too_large
FROM (SELECT DISTINCT ecosystem, package_name, CASE WHEN line_no <> 2 THEN resolved_version END AS v FROM occurrence WHERE NOT is_unassessable)""", "occurrence"),
        "SRC05 S04",
    ),
    "advisory_path": Query(
        q_advisory_path,
        with_views(f"""rows AS (SELECT {KEYS}, package_name AS name, resolved_version AS v FROM occurrence WHERE NOT is_unassessable AND line_no <> 2),
ids AS (SELECT *, unnest(range(1, length(name) % 3 + 1)) AS i FROM rows)
SELECT {KEYS}, 'OSV-' || name || '-' || v || '-' || i AS osv_id, CASE WHEN i = 1 THEN 'cve-2024-' || (1000 + length(name)) END AS cve_id, CASE WHEN i = 1 THEN p_partkey % 100 END AS epss
FROM ids LEFT JOIN part ON p_partkey = 100 + length(name) WHERE i = 1 OR length(name) % 2 = 1""", "occurrence"),
        "J06 SRC06",
    ),
    "advisory_probabilities": Query(
        q_advisory_lookup,
        with_views(f"SELECT {KEYS}, i, cve_id, p_partkey % 100 AS epss FROM advisory LEFT JOIN part ON cve_id = 'CVE-2024-' || (p_partkey + 900)", "advisory"),
        "J07 SRC07",
    ),
    "cosine_topk": Query(q_cosine, with_views(_COSINE + "\nSELECT query_id, position::INT AS position, chunk_id, similarity FROM placed WHERE position <= 5", "chunk"), "R05 R06 T09"),
    "grounding_gate": Query(
        q_grounding,
        with_views(_COSINE + """,
best AS (SELECT query_id, max(similarity) AS best, sum(length(text)) AS n FROM placed WHERE position <= 5 GROUP BY query_id)
SELECT query_id, coalesce(n, 0)::BIGINT AS n_chars, CASE WHEN best >= 0.30 AND n >= 400 THEN 'sufficient' ELSE 'low' END AS grounding FROM asked LEFT JOIN best USING (query_id)""", "chunk"),
        "A15 R08",
    ),
    "chunk_windows": Query(q_chunk_windows, f"{_FIRSTS_SQL}\n{_NUMBERED_SQL}", "R01 R02 R03 W11"),
    "retrieval_query_framing": Query(
        q_framing,
        with_views(f"""SELECT {KEYS}, CASE WHEN trim(coalesce(deprecation_reason, '')) <> '' THEN 'reason_available' ELSE 'no_reason' END AS branch,
CASE WHEN trim(coalesce(deprecation_reason, '')) <> '' THEN package_name || ' ' || resolved_version || ' deprecated: ' || deprecation_reason
     WHEN line_no = 7 THEN package_name || ' ' || resolved_version || ' changes fixed in 9.9.9' ELSE package_name || ' ' || resolved_version || ' upgrade to ' || CASE WHEN part_id % 3 <> 0 THEN (part_id % 5 + 1) || '.0.0' ELSE 'the latest release' END || ' breaking changes and migration notes' END AS query FROM occurrence""", "occurrence"),
        "R07",
    ),
    "payload_validation": Query(
        q_payloads,
        """SELECT s_suppkey AS report_id, p::INT AS priority, CASE p WHEN 1 THEN 'aux-' ELSE 'Pkg-' END || s_suppkey AS package, CASE p WHEN 1 THEN 'investigate' ELSE 'upgrade' END AS fix_type, '1.0.0' AS current_version
FROM supplier, (VALUES (1), (2)) AS v(p) WHERE s_suppkey % 8 <> 0""",
        "R10 R11 R12 W10 J12 X04 X06",
    ),
    "payload_rejects": Query(q_payload_rejects, "SELECT s_suppkey AS report_id, 'ghost' AS unknown_packages FROM supplier WHERE s_suppkey % 8 <> 0", "J12 X05"),
    "citation_resolution": Query(q_citations, "SELECT s_suppkey AS report_id, 1 AS position, 'a3f9c21b4e77' AS chunk_id FROM supplier WHERE s_suppkey % 8 <> 0", "J13 J14"),
    "weights_fallback": Query(q_weights_fallback, with_views("SELECT scan_id, CASE WHEN scan_id % 4 = 0 THEN 'v2' ELSE formula_version END AS version, CASE WHEN scan_id % 5 = 1 THEN 'v3_epss' ELSE 'v2' END AS trial_version FROM scan_run", "scan_run"), "SC16 SC17 SRC10"),
    "failure_messages": Query(
        q_failure_message,
        "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'The service is busy; try again later.' WHEN 1 THEN 'Sign in again.' ELSE 'Something went wrong.' END AS message FROM events",
        "X07",
    ),
}
