"""Inputs of report generation: the combined prompt of a scan, and the prompt of one dependency with its passages.

A scan sends its worst flagged rows and says how many it leaves out. A dependency sends its measured
signals and, only where retrieval was sufficient, the passages; what was retrieved stays in the trace
either way. Groups are bounded by these caps before anything is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .analytics import MOST_PROMPT_ROWS, worst_first

# Characters of a passage, and advisories of a row.
MOST_PASSAGE = 1600
MOST_ADVISORIES = 5

#: What is asked, by branch; ``fixed_framing`` is one task for every dependency.
TASKS = {
    "reason_available": "The registry marks this dependency as deprecated. Say what replaces it and what the move takes, from the passages.",
    "no_reason": "This dependency is flagged and not deprecated. Say which release mends it and what the upgrade takes, from the passages.",
    "fixed_framing": "This dependency is flagged. Say how to mend or replace it and what that takes, from the passages.",
}
TRACE = "array<struct<position: int, chunk_id: string, similarity: double, shown: boolean>>"
NO_PASSAGES = "(no passages; nothing can be cited)"


def task(branch: Column) -> Column:
    named = F.create_map(*[x for pair in TASKS.items() for x in map(F.lit, pair)])
    return F.coalesce(F.try_element_at(named, branch), F.lit(TASKS["no_reason"]))


def within_budget(rows: DataFrame, group: str, order: Column, size: Column, budget: int) -> DataFrame:
    """Adds ``fits``: whether the sizes up to and with the row stay within the group's budget, in the given order.

    After the first row that does not fit none does, so that what is shown is a prefix.
    """
    up_to = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("fits", F.sum(size).over(up_to) <= budget)


def dependency_prompts(requests: DataFrame, retrieved: DataFrame, budget: int = 5 * MOST_PASSAGE) -> DataFrame:
    """request_id, prompt, shown (passages in it) and trace (every retrieved passage, and whether it was shown).

    ``requests``: request_id, branch, query, target (a JSON text), grounding. ``retrieved``: request_id,
    position, chunk_id, source_path, similarity, text. Passages of a request whose grounding is not
    sufficient are kept out of its prompt.
    """
    text = F.substring(F.coalesce("text", F.lit("")), 1, MOST_PASSAGE)
    cut = within_budget(retrieved.withColumn("text", text), "request_id", F.col("position"), F.length("text"), budget)
    marked = cut.join(requests.select("request_id", (F.col("grounding") == "sufficient").alias("grounded")), "request_id").withColumn("shown", F.coalesce(F.col("grounded") & F.col("fits"), F.lit(False)))
    block = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] id: "), "chunk_id", F.lit("\nfrom: "), F.coalesce("source_path", F.lit("(unknown file)")), F.lit("\n---\n"), "text")
    listed = marked.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("shown"), F.struct("position", block.alias("block"))))).alias("blocks"),
        F.sort_array(F.collect_list(F.struct("position", "chunk_id", "similarity", "shown"))).alias("trace"),
    )
    joined = requests.join(listed, "request_id", "left")
    blocks = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    passages = F.when(F.size("blocks") > 0, blocks).otherwise(NO_PASSAGES)
    prompt = F.concat(task(F.col("branch")), F.lit("\n\nThe question asked of the documents: "), F.coalesce("query", F.lit("")), F.lit("\n\nBEGIN TARGET\n"), F.coalesce("target", F.lit("{}")), F.lit("\nEND TARGET\n\nBEGIN SOURCE\n"), passages, F.lit("\nEND SOURCE\n"))
    traced = F.coalesce(F.col("trace").cast(TRACE), F.array().cast(TRACE))
    return joined.select("request_id", prompt.alias("prompt"), F.greatest(F.coalesce(F.size("blocks"), F.lit(0)), F.lit(0)).alias("shown"), traced.alias("trace"))


def advisory_lists(advisories: DataFrame, *key: str) -> DataFrame:
    """Per occurrence its advisories for a prompt, worst first (an unknown score is 0, ids break ties), five at most, and the
    distinct names (CVE, else id) of all of them in that order. ``advisories``: key, osv_id, cve_id, severity, cvss, fixed_version."""
    worst = F.struct((-F.coalesce("cvss", F.lit(0.0))).alias("rank"), "osv_id", "cve_id", "severity", "cvss", "fixed_version")
    listed = advisories.groupBy(*key).agg(F.sort_array(F.collect_list(worst)).alias("all"))
    shown = F.transform(F.slice("all", 1, MOST_ADVISORIES), lambda a: F.struct(*[a[c].alias(c) for c in ("osv_id", "cve_id", "severity", "cvss", "fixed_version")]))
    return listed.select(*key, shown.alias("advisories"), F.array_distinct(F.transform("all", lambda a: F.coalesce(a["cve_id"], a["osv_id"]))).alias("cves"))


def with_lists(rows: DataFrame, lists: DataFrame, *key: str) -> DataFrame:
    """The rows, each with the ``advisories`` and ``cves`` of its occurrence (see ``advisory_lists``), empty where there are none; a null key has none.

    One aggregate of both tables: where both lie partitioned by some column of the key nothing moves, as it would for a join.
    """
    rest, names = [c for c in rows.columns if c not in key], ("advisories", "cves")
    row = F.struct(*rest).alias("__row")
    bare = rows.select(*key, row, *[F.lit(None).cast(lists.schema[c].dataType).alias(c) for c in names])
    able = lists.dropna(subset=list(key))
    listed = able.select(*key, F.lit(None).cast(bare.schema["__row"].dataType).alias("__row"), *names)
    both = bare.unionByName(listed).groupBy(*key).agg(F.collect_list("__row").alias("__rows"), *[F.first(c, ignorenulls=True).alias(c) for c in names])
    return both.select(*key, F.explode("__rows").alias("__row"), *[F.coalesce(c, F.array()).alias(c) for c in names]).select(*key, "__row.*", *names)


#: Fields of a row in the combined prompt and the columns they come from.
ROW_FIELDS = {
    "package": "package_name", "ecosystem": "ecosystem", "manifest_path": "manifest_path", "group": "dependency_group", "declared_specifier": "declared_specifier", "current_version": "resolved_version", "version_source": "resolution",
    "latest_version": "latest_version", "versions_behind": "versions_behind", "deprecated": "is_deprecated", "advisory_count": "vulnerability_count", "highest_severity": "highest_severity", "max_cvss": "cvss_max",
    "risk_component_score": "score", "flag_reasons": "flag_reasons", "advisories": "advisories", "cves": "cves",
}
NUMBERS = ("max_cvss", "risk_component_score")
SUMMARY_FIELDS = ("repository", "risk_score", "classification", "scoring_formula_version", "manifest_count", "dependency_count", "flagged_count", "clean_count", "unassessable_count")


def combined_prompts(scans: DataFrame, flagged: DataFrame, *tie_break: str, most: int = MOST_PROMPT_ROWS) -> DataFrame:
    """scan_id and the prompt's JSON: the summary of the scan and its worst rows; decimals are written as numbers.

    ``scans``: scan_id and the columns of ``SUMMARY_FIELDS``. ``flagged``: the flagged and assessable
    occurrences with the columns that ``ROW_FIELDS`` names. A scan with none has an empty list.
    """
    number = lambda name, source: F.col(source).cast("double") if name in NUMBERS else F.col(source)
    row = F.struct(*[number(name, source).alias(name) for name, source in ROW_FIELDS.items()])
    kept = worst_first(flagged, *tie_break, most=most).select("scan_id", "position", "omitted", row.alias("row"))
    listed = kept.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("position", "row"))).alias("rows"), F.max("omitted").alias("omitted"))
    joined = scans.join(listed, "scan_id", "left")
    summary = F.struct(*[(F.col(c).cast("double") if c == "risk_score" else F.col(c)).alias(c) for c in SUMMARY_FIELDS], F.coalesce("omitted", F.lit(0)).alias("flagged_rows_omitted"))
    rows = F.transform("rows", lambda r: r["row"])
    whole = F.struct(summary.alias("scan"), F.coalesce(rows, F.array()).alias("rows"))
    return joined.select("scan_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("prompt"))
