"""Rendered reports, prompts, traces, history rows and sinks as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Query
from ..functions import text as tx
from ..functions import advisories as adv
from ..operators import enrich, lifecycle, reports, retrieval, rollup
from ..sources import sinks
from .fixtures import KEY, occurrence, report, repository, scan_run, table, with_views
from .lifecycle_queries import CHUNKS_SQL
from .scoring_queries import KEYS, cents, rolled_sql


def _fixes(spark, sf_dir):
    s = F.col("s_suppkey")
    kinds = F.element_at(F.array(*map(F.lit, ("upgrade", "replace", "remove", "investigate"))), (s % 4 + 1).cast("int"))
    one = lambda n: F.struct(F.lit(n).alias("priority"), F.concat(F.lit(f"p{n}|"), s.cast("string")).alias("package"), F.lit("a/package.json").alias("manifest_path"), kinds.alias("fix_type"), F.when(s % 8 == 0, "2.0").alias("target_version"), F.when(s % 8 == 1, "q").alias("replacement_package"))
    return table(spark, sf_dir, "supplier").select(s.alias("report_id"), F.explode(F.array(one(1), one(2))).alias("x")).select("report_id", "x.*")


def q_fix_sentences(spark, sf_dir):
    rows = _fixes(spark, sf_dir)
    return rows.select("report_id", "priority", tx.fix_sentence(F.col("fix_type"), F.col("package"), F.col("target_version"), F.col("replacement_package")).alias("sentence"))


def q_fixes_table(spark, sf_dir):
    return reports.fixes_table(_fixes(spark, sf_dir))


def q_report_markdown(spark, sf_dir):
    note = reports.confidence_note(F.lit("combined"), F.lit("low"), F.lit(0), F.lit(0))
    rows = reports.fixes_table(_fixes(spark, sf_dir))
    return sinks.report_markdown(rows.select("report_id", F.concat(F.lit("Report "), F.col("report_id").cast("string")).alias("title"), F.lit("Summary.").alias("summary_md"), "markdown", note.alias("note")))


def q_confidence(spark, sf_dir):
    e = F.col("event_id")
    note = reports.confidence_note(F.when(e % 5 == 0, "combined").otherwise("per_dependency"), F.when(e % 3 == 0, "low").otherwise("sufficient"), (e % 4).cast("int"), (e % 2).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", note.alias("note"))


def q_prompt(spark, sf_dir):
    rows = occurrence(spark, sf_dir).where("NOT is_unassessable")
    item = rows.select("scan_id", "package_name", F.col("staleness_days").alias("days_since_release"), "part_id", "supp_id", "line_no")
    return reports.prompt_json(item, "scan_id")


def q_trace(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report_id"))
    spread = base.select("report_id", F.posexplode(F.array(*[F.concat(F.lit(f"c{n}-"), F.col("report_id").cast("string")) for n in range(3)])).alias("position", "chunk_id")).withColumn("similarity", F.round(F.lit(0.5) + F.col("position") * 0.125, 3))
    cited = spread.where("position = report_id % 3").select("report_id", "chunk_id")
    return reports.trace(base, spread, cited).select("report_id", F.to_json("retrieved_chunks").alias("trace"))


def q_history_rows(spark, sf_dir):
    """What is appended to the permanent history for completed scans."""
    scans = scan_run(spark, sf_dir).where("status = 'completed'")
    # Lines of other scans fall out when the roll-up meets its scans: ranked and counted they are fewer to move than to meet the scans first.
    rows = occurrence(spark, sf_dir, named=False)
    cards = rollup.rescore(scans, rows, "v2").select("scan_id", "score", "classification", "flagged_count")
    done = scans.join(repository(spark, sf_dir).select("repository_id", "full_name"), "repository_id")
    return lifecycle.history_rows(done, cards).select("scan_id", "full_name", "data_source", cents("score"), "flagged_count")


def q_panel(spark, sf_dir):
    rows = occurrence(spark, sf_dir).select(*KEY, "is_deprecated", "deprecation_reason", "staleness_days")
    return rows.select(*KEY, *[sinks.csv_text(c, kind) for c, kind in rows.dtypes if c not in KEY])


def q_manifest(spark, sf_dir):
    """Both versions in one roll-up."""
    both = F.explode(F.array(F.lit("v1"), F.lit("v2")))
    cards = rollup.roll_up(scan_run(spark, sf_dir).select("scan_id", both.alias("used_version")), occurrence(spark, sf_dir, named=False).withColumn("own_version", both), F.col("own_version"))
    panel = cards.groupBy("scan_id").agg((F.min("score") != F.max("score")).alias("changed"))
    return sinks.manifest(panel, "v1", None)


def q_report_json(spark, sf_dir):
    return sinks.report_json(report(spark, sf_dir).withColumn("note", F.lit(None).cast("string")), "report_id", "status", "note")


def q_documents(spark, sf_dir):
    """The fetched document that is used of each repository, or why there is none."""
    p = F.col("page_id")
    body = F.when(p % 7 == 0, None).when(p % 5 == 0, F.repeat(F.lit("x"), 600)).otherwise("text")
    rows = table(spark, sf_dir, "pages").select(F.floor(p / 3).alias("repository_id"), (p % 3).alias("rank"), F.concat(F.lit("f"), (p % 3).cast("string")).alias("path"), body.alias("body"))
    return enrich.preferred_document(rows, "repository_id", 500).select("repository_id", "path", "reason")


def q_advisory_fields(spark, sf_dir):
    """Fields of advisory documents: CVE, best score, range, fix, source, declared severity."""
    e = F.col("event_id").cast("string")
    k = F.col("event_id") % 4
    body = F.concat(
        F.lit('{"id": "'), F.when(k == 3, "CVE-2000-").otherwise("GHSA-"), e, F.lit('", "aliases": ["X", "'), F.when(k == 0, "cve-1").otherwise("Y"), F.lit('"], "severity": [{"score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}], "affected": ['),
        F.lit('{"package": {"name": "other"}, "ranges": []}, {"package": {"name": "'), F.when(F.col("event_id") % 5 == 0, "Pkg").otherwise("pkg"), F.lit('"}, "severity": [{"score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H"}], "ranges": [{"events": [{"introduced": "1"}, '),
        F.when(k == 1, '{"last_affected": "4"}').otherwise('{"fixed": "2"}, {"fixed": "3"}'), F.lit(']}]}], "references": [{"type": "FIX", "url": "u"}'), F.when(k == 2, ', {"type": "WEB", "url": "w"}').otherwise(""), F.lit('], "word": "Moderate"}'),
    )
    shape = "struct<id: string, aliases: array<string>, severity: array<struct<score: string>>, affected: array<struct<package: struct<name: string>, severity: array<struct<score: string>>, ranges: array<struct<events: array<struct<introduced: string, fixed: string, last_affected: string>>>>>>, references: array<struct<type: string, url: string>>, word: string>"
    d = table(spark, sf_dir, "events").select("event_id", F.from_json(body, shape).alias("d"))
    scores = lambda a: F.transform(F.coalesce(a, F.expr("CAST(array() AS array<struct<score: string>>)")), lambda s: s["score"])
    entry = adv.affected_entry(F.col("d.affected"), F.lit("pkg"))
    events = F.flatten(F.transform(entry["ranges"], lambda r: r["events"]))
    return d.select(
        "event_id",
        adv.cve_of(F.col("d.id"), F.col("d.aliases")).alias("cve_id"),
        adv.best_cvss(scores(F.col("d.severity")), F.transform("d.affected", lambda x: scores(x["severity"]))).alias("cvss"),
        adv.affected_range(events).alias("affected_range"),
        adv.fixed_version(events).alias("fixed_version"),
        adv.source_url(F.col("d.id"), F.col("d.references")).alias("source_url"),
        adv.declared_severity(F.col("d.word")).alias("severity"),
    )


def q_pypi_documents(spark, sf_dir):
    """Yanked releases and inactive projects of PyPI documents, with upload times and source links."""
    p = F.col("p_partkey")
    files = F.array(F.struct((p % 3 != 0).alias("yanked"), F.when(p % 2 == 0, "broken").alias("yanked_reason"), F.lit("2020-01-02T00:00:00Z").alias("upload_time_iso_8601"), F.lit(None).cast("string").alias("upload_time")), F.struct(F.lit(True).alias("yanked"), F.lit("").alias("yanked_reason"), F.lit(None).cast("string").alias("upload_time_iso_8601"), F.lit("2021-05-06T00:00:00").alias("upload_time")))
    classifiers = F.when(p % 5 == 0, F.array(F.lit(tx.INACTIVE))).otherwise(F.array(F.lit("x")))
    found = tx.pypi_deprecation(files, classifiers)
    link = F.concat(F.lit("s"), p.cast("string"))
    second = F.when(p % 4 == 0, " Source ").when(p % 4 == 1, "Home").otherwise("Misc")
    urls = F.create_map(F.lit("Docs"), F.lit("d"), F.lit("source"), F.when(p % 12 == 0, "old").otherwise(" "), second, link)
    return table(spark, sf_dir, "part").select("p_partkey", found["is_deprecated"].alias("is_deprecated"), found["reason"].alias("reason"), F.date_format(tx.release_time(files), "yyyy-MM-dd").alias("uploaded"), tx.source_link(urls, F.lit("home")).alias("source"))


def q_display(spark, sf_dir):
    ratio = F.col("l_discount").cast("decimal(12,6)") * F.lit("0.12345").cast("decimal(12,6)")
    text = F.concat(F.lit("**"), "l_returnflag", F.lit("** and `x` _y_\n\n- item"))
    first = lambda field: F.get(tx.markdown_blocks(text), F.lit(0))[field]
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.bround(ratio, 4) * 10000).cast("long").alias("four_places_e4"), first("text").alias("first_text"), F.get(tx.markdown_blocks(text), F.lit(1))["kind"].alias("second_kind"), tx.quoted(F.concat("l_returnflag", F.lit("\nb"))).alias("quoted"), tx.version_tag(F.when(F.col("l_linenumber") > 3, " 1.2 ")).alias("tag"),
    )


def q_stored_chunks(spark, sf_dir):
    """Chunks of documents upserted twice by content: counts per document stay the same."""
    found = retrieval.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", most=retrieval.MOST_CHUNKS).withColumnRenamed("doc_id", "scan_id")
    return retrieval.store_chunks(found, found).groupBy("scan_id").agg(F.count("*").alias("n_chunks"))


_KINDS = "['upgrade', 'replace', 'remove', 'investigate'][1 + s_suppkey % 4]"
_FIXES = f"""fixes AS (SELECT s_suppkey AS report_id, n AS priority, 'p' || n || '|' || s_suppkey AS package, {_KINDS} AS kind,
  CASE WHEN s_suppkey % 8 = 0 THEN '2.0' END AS target, CASE WHEN s_suppkey % 8 = 1 THEN 'q' END AS replacement FROM supplier, (VALUES (1), (2)) AS v(n)),
said AS (SELECT *, CASE kind WHEN 'upgrade' THEN 'Upgrade ' || package || coalesce(' to ' || target, '') WHEN 'replace' THEN 'Replace ' || package || coalesce(' with ' || replacement, '')
  WHEN 'remove' THEN 'Remove ' || package ELSE 'Investigate ' || package END AS sentence FROM fixes),
tables AS (SELECT report_id, '| # | Package | Manifest | Fix |' || chr(10) || '|---|---|---|---|' || chr(10)
  || string_agg('| ' || priority || ' | ' || replace(package, '|', '\\|') || ' | a/package.json | ' || sentence || ' |', chr(10) ORDER BY priority) AS markdown FROM said GROUP BY report_id)"""
_AFTER = "CASE WHEN event_id % 4 = 1 THEN '>=1 <=4' ELSE '>=1 <3' END"
QUERIES = {
    "fix_sentences": Query(q_fix_sentences, f"WITH {_FIXES} SELECT report_id, priority, sentence FROM said", "FN34"),
    "fixes_table": Query(q_fixes_table, f"WITH {_FIXES} SELECT report_id, markdown FROM tables", "X10 FN33"),
    "report_markdown": Query(
        q_report_markdown,
        f"""WITH {_FIXES} SELECT report_id, '# Report ' || report_id || chr(10) || chr(10) || 'Summary.' || chr(10) || chr(10) || markdown || chr(10) || chr(10)
|| '> Written from scan results alone; no documents were consulted.' AS document FROM tables""",
        "SNK07",
    ),
    "confidence_notes": Query(
        q_confidence,
        """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Written from scan results alone; no documents were consulted.' WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN 'No documents were found for this package.'
WHEN event_id % 3 = 0 THEN 'The documents found say little about this; check before acting.' WHEN event_id % 2 = 0 THEN 'Documents were consulted, but none is cited.'
ELSE 'Based on ' || event_id % 2 || ' cited of ' || event_id % 4 || ' retrieved passages.' END AS note FROM events""",
        "R13",
    ),
    "prompt_documents": Query(
        q_prompt,
        with_views("""SELECT scan_id, '{"dependencies":[' || string_agg('{' || coalesce('"days_since_release":' || staleness_days || ',', '') || '"line_no":' || line_no || ',"package_name":"' || package_name || '","part_id":' || part_id || ',"supp_id":' || supp_id || '}', ','
  ORDER BY staleness_days NULLS FIRST, line_no, package_name, part_id, supp_id) || ']}' AS prompt FROM occurrence WHERE NOT is_unassessable GROUP BY scan_id""", "occurrence"),
        "R09 X03 X20",
    ),
    "trace_rows": Query(
        q_trace,
        """SELECT s_suppkey AS report_id, '[' || string_agg('{"position":' || n || ',"chunk_id":"c' || n || '-' || s_suppkey || '","similarity":' || CASE n WHEN 0 THEN '0.5' WHEN 1 THEN '0.625' ELSE '0.75' END || ',"cited":' || (s_suppkey % 3 = n) || '}', ',' ORDER BY n) || ']' AS trace
FROM supplier, (VALUES (0), (1), (2)) AS v(n) GROUP BY s_suppkey""",
        "R16",
    ),
    "history_rows": Query(
        q_history_rows,
        with_views(
            rolled_sql("'v2'", "SELECT scan_id, 'v2' AS used_version FROM scan_run")
            + "\nSELECT scan_id, full_name, data_source, score_cents, flagged_count FROM rolled JOIN scan_run USING (scan_id) JOIN repository USING (repository_id) WHERE status = 'completed'",
            "scan_run", "occurrence", "repository",
        ),
        "SNK03 P12 A08",
    ),
    "csv_panel": Query(
        q_panel,
        with_views(f"SELECT {KEYS}, CASE WHEN is_deprecated THEN 'True' ELSE 'False' END AS is_deprecated, coalesce(deprecation_reason, '') AS deprecation_reason, coalesce(staleness_days::VARCHAR, '') AS staleness_days FROM occurrence", "occurrence"),
        "SNK05",
    ),
    "run_manifest": Query(
        q_manifest,
        with_views(
            rolled_sql("'v1'", "SELECT scan_id, 'v1' AS used_version FROM scan_run")
            + f""",
other AS (WITH {rolled_sql("'v2'", "SELECT scan_id, 'v2' AS used_version FROM scan_run")} SELECT scan_id, score_cents AS score_after FROM rolled)
SELECT '{{"weights":"v1","n_repositories":' || count(*) || ',"n_changed":' || count(*) FILTER (WHERE score_cents <> score_after) || '}}' AS manifest FROM rolled JOIN other USING (scan_id)""",
            "scan_run", "occurrence",
        ),
        "SNK06",
    ),
    "report_json": Query(
        q_report_json, with_views("""SELECT '{"report_id":' || report_id || ',"status":"' || status || '","note":null}' AS document FROM report""", "report"), "SNK08"
    ),
    "preferred_documents": Query(
        q_documents,
        """WITH d AS (SELECT page_id // 3 AS repository_id, page_id % 3 AS rank, page_id % 7 <> 0 AS got, page_id % 7 <> 0 AND page_id % 5 <> 0 AS usable FROM pages)
SELECT repository_id, 'f' || min(rank) FILTER (WHERE usable) AS path, CASE WHEN bool_or(usable) THEN NULL WHEN bool_or(got) THEN 'documents_too_large' ELSE 'no_documents' END AS reason FROM d GROUP BY repository_id""",
        "SRC08 X01",
    ),
    "advisory_fields": Query(
        q_advisory_fields,
        f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'cve-1' WHEN 3 THEN 'CVE-2000-' || event_id END AS cve_id, 10.0::DOUBLE AS cvss, CASE WHEN event_id % 5 > 0 THEN {_AFTER} END AS affected_range, CASE WHEN event_id % 4 <> 1 AND event_id % 5 > 0 THEN '3' END AS fixed_version,
CASE WHEN event_id % 4 = 2 THEN 'w' ELSE 'https://osv.dev/vulnerability/' || CASE WHEN event_id % 4 = 3 THEN 'CVE-2000-' ELSE 'GHSA-' END || event_id END AS source_url, 'medium' AS severity FROM events""",
        "FN12 FN13 FN14 FN15 FN16",
    ),
    "pypi_documents": Query(
        q_pypi_documents,
        """SELECT p_partkey, p_partkey % 3 <> 0 OR p_partkey % 5 = 0 AS is_deprecated, CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'broken' WHEN p_partkey % 5 = 0 THEN 'Development Status :: 7 - Inactive' ELSE '' END
WHEN p_partkey % 5 = 0 THEN 'Development Status :: 7 - Inactive' END AS reason, '2021-05-06' AS uploaded, CASE WHEN p_partkey % 4 < 2 THEN 's' || p_partkey ELSE 'home' END AS source FROM part""",
        "FN24 FN25 FN27 SRC04 X17",
    ),
    "display_values": Query(
        q_display,
        """WITH d AS (SELECT *, CAST(round(l_discount * 100) AS BIGINT) * 12345 AS m FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN m % 1000 > 500 OR m % 1000 = 500 AND m // 1000 % 2 = 1 THEN m // 1000 + 1 ELSE m // 1000 END AS four_places_e4,
l_returnflag || ' and x y' AS first_text, 'list' AS second_kind, '> ' || l_returnflag || chr(10) || '> b' AS quoted, CASE WHEN l_linenumber > 3 THEN '1.2' ELSE '' END AS tag FROM d""",
        "FN22 FN33 FN37 FN39",
    ),
    "stored_chunks": Query(q_stored_chunks, CHUNKS_SQL + "SELECT doc_id AS scan_id, count(*) AS n_chunks FROM kept GROUP BY doc_id", "SNK09 R03"),
}
