"""Generated payloads checked against scanned rows, citations resolved, and documents rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fix_sentence, listed, table_cell

FIX_TYPES = ("upgrade", "replace", "remove", "investigate")
MOST_FIXES = 30
MOST_SUMMARY = 4000
MOST_CITATIONS = 5
LEAST_PREFIX = 8
PAYLOAD = "struct<summary_md: string, fixes: array<struct<package: string, manifest_path: string, ecosystem: string, fix_type: string, target_version: string, replacement_package: string, priority: int>>, citations: array<string>>"


def parsed(payload: Column) -> Column:
    """The payload by its schema; unknown keys fall away, anything but an object is null."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.from_json(payload, PAYLOAD))


# The most characters of a fix's fields.
MOST_LETTERS = {"package": 214, "manifest_path": 500, "target_version": 100, "replacement_package": 214}
ECOSYSTEMS = ("npm", "pypi")


def checked(reports: DataFrame, key: str = "report_id", payload: str = "payload") -> DataFrame:
    """Per payload: whether its shape holds, what is wrong with it (a hint for a second answer), and its summary.

    Any wrong field makes the whole payload wrong. A summary is never wrong for its length; it is cut.
    Texts are trimmed before they are measured.
    """
    p = parsed(F.col(payload))
    trimmed = lambda x, c: F.trim(x[c])
    over = lambda x, c: F.coalesce(F.length(trimmed(x, c)) > MOST_LETTERS[c], F.lit(False))
    blank = lambda x, c: F.coalesce(F.length(trimmed(x, c)) < 1, F.lit(True))

    def of_fix(x: Column, n: Column) -> Column:
        tests = {
            "package": blank(x, "package") | over(x, "package"),
            "manifest_path": blank(x, "manifest_path") | over(x, "manifest_path"),
            "ecosystem": ~F.coalesce(x["ecosystem"].isin(*ECOSYSTEMS), F.lit(False)),
            "fix_type": ~F.coalesce(x["fix_type"].isin(*FIX_TYPES), F.lit(False)),
            "target_version": over(x, "target_version"),
            "replacement_package": over(x, "replacement_package"),
            "priority": ~F.coalesce(x["priority"].between(1, 999), F.lit(False)),
        }
        return F.array(*[F.when(test, F.concat(F.lit("fixes."), n.cast("string"), F.lit(f".{name}"))) for name, test in tests.items()])

    lists = F.transform(F.coalesce(p["fixes"], F.array().cast("array<struct<package: string, manifest_path: string, ecosystem: string, fix_type: string, target_version: string, replacement_package: string, priority: int>>")), of_fix)
    summary = F.coalesce(F.length(p["summary_md"]), F.lit(0)) < 1
    wrong = F.when(p.isNull(), F.array(F.lit("not an object"))).otherwise(F.filter(F.concat(F.array(F.when(summary, "summary_md")), F.flatten(lists)), lambda x: x.isNotNull()))
    return reports.select(key, wrong.alias("wrong"), F.substring(p["summary_md"], 1, MOST_SUMMARY).alias("summary_md")).select(key, (F.size("wrong") == 0).alias("is_valid"), "wrong", "summary_md")


def identity(ecosystem: Column, package: Column, path: Column) -> Column:
    return F.concat_ws("\x1f", ecosystem, F.lower(F.trim(package)), F.trim(path))


def fixes(reports: DataFrame, key: str = "report_id", payload: str = "payload") -> DataFrame:
    """The first fixes of each payload whose fields are valid, the first per identity."""
    listed = reports.select(key, F.posexplode(F.slice(parsed(F.col(payload))["fixes"], 1, MOST_FIXES)).alias("at", "x")).select(key, "at", "x.*")
    valid = F.col("fix_type").isin(*FIX_TYPES) & F.col("priority").between(1, 999) & F.length("package").between(1, 214)
    held = listed.where(valid).withColumn("identity", identity(F.col("ecosystem"), F.col("package"), F.col("manifest_path")))
    first = Window.partitionBy(key, "identity").orderBy("at")
    return held.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def grounded(found: DataFrame, scanned: DataFrame, key: str = "report_id", drop_unmatched: bool = False) -> DataFrame:
    """Fixes with the facts of the scanned row in place of the payload's, renumbered by priority.

    ``scanned``: (key, identity, current_version, severity, cves). A fix for something not scanned rejects
    its whole payload, or is dropped on the second answer; a payload left with none gives no rows.
    """
    joined = found.join(scanned, [key, "identity"], "left").withColumn("__matched", F.col("current_version").isNotNull() | F.col("severity").isNotNull())
    if not drop_unmatched:
        bad = joined.where("NOT __matched").select(key).distinct()
        joined = joined.join(bad, key, "left_anti")
    order = Window.partitionBy(key).orderBy("priority", "at")
    return joined.where("__matched").withColumn("priority", F.row_number().over(order)).drop("__matched", "at")


def violations(found: DataFrame, scanned: DataFrame, key: str = "report_id", most: int = 8) -> DataFrame:
    """The hint for a second answer: the first unmatched fixes of each payload, spelled out."""
    lost = found.join(scanned.select(key, "identity"), [key, "identity"], "left_anti")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "package"))), lambda x: x["package"])
    return lost.groupBy(key).agg(F.array_join(F.slice(ordered, 1, most), ", ").alias("unknown_packages"))


def citations(reports: DataFrame, chunks: DataFrame, key: str = "report_id", payload: str = "payload") -> DataFrame:
    """Cited chunks in order of citation: the exact id, else the one id that a long enough prefix fits, either way round.

    ``chunks``: (key, chunk_id). Prefixes meet over their first characters, an equi-join.
    """
    spelled = F.regexp_extract(F.lower("x"), r"([0-9a-f]{4,})(?!.*[0-9a-f]{4})", 1)
    cited = reports.select(key, F.posexplode(parsed(F.col(payload))["citations"]).alias("at", "x")).select(key, "at", spelled.alias("cite")).where(F.length("cite") >= LEAST_PREFIX)
    head = lambda c: F.substring(c, 1, LEAST_PREFIX)
    near = cited.withColumn("head", head("cite")).join(chunks.withColumn("head", head("chunk_id")), [key, "head"])
    fits = F.col("chunk_id").startswith(F.col("cite")) | F.col("cite").startswith(F.col("chunk_id"))
    able = near.where(fits).groupBy(key, "at", "cite").agg(F.max(F.when(F.col("chunk_id") == F.col("cite"), F.col("chunk_id"))).alias("exact"), F.count_distinct("chunk_id").alias("n"), F.min("chunk_id").alias("only"))
    resolved = able.withColumn("chunk_id", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")))).where("chunk_id IS NOT NULL")
    first = resolved.groupBy(key, "chunk_id").agg(F.min("at").alias("at"))
    order = Window.partitionBy(key).orderBy("at")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= MOST_CITATIONS).select(key, "position", "chunk_id")


def cited_passages(stored: DataFrame, key: str = "report_id") -> DataFrame:
    """key, cited_at and the passage of each citation, in their order, from what the report itself stored.

    ``stored``: key, citations (ids), retrieved (an array of structs with chunk_id). An id that was not
    retrieved is dropped, and places stay those of the citations.
    """
    cited = stored.select(key, "retrieved", F.posexplode("citations").alias("at", "id"))
    found = cited.withColumn("p", F.get(F.filter("retrieved", lambda x: x["chunk_id"] == F.col("id")), F.lit(0)))
    return found.where("p IS NOT NULL").select(key, (F.col("at") + 1).alias("cited_at"), "p.*")


def confidence_note(kind: Column, grounding: Column, chunks: Column, cited: Column) -> Column:
    return (
        F.when(kind == "combined", "Written from scan results alone; no documents were consulted.")
        .when((grounding == "low") & (chunks == 0), "No documents were found for this package.")
        .when(grounding == "low", "The documents found say little about this; check before acting.")
        .when(cited == 0, "Documents were consulted, but none is cited.")
        .otherwise(F.format_string("Based on %d cited of %d retrieved passages.", cited, chunks))
    )


def scope_sentence(project: Column, compared: Column, missing: Column, has_lines: Column) -> Column:
    """What a report was compared with: named siblings with a completed scan, and those without one.

    It is there for every member of a project, so that no line is told apart from no comparison.
    ``compared`` and ``missing`` are arrays of full names in order; an independent repository has none (null).
    """
    opening = F.concat(F.lit("Part of the project "), project, F.lit("."))
    none, unseen = F.size(compared) == 0, F.size(missing) == 0
    scans = F.concat(F.when(F.size(compared) == 1, "the latest scan of ").otherwise("the latest scans of "), listed(compared), F.lit(" as of this report"))
    said = F.when(has_lines, F.concat(F.lit(" Compared with "), scans, F.lit("."))).otherwise(F.concat(F.lit(" Nothing in this report occurs in "), scans, F.lit(".")))
    rest = F.when(unseen, "").otherwise(F.concat(F.lit(" "), listed(missing), F.when(F.size(missing) == 1, " has").otherwise(" have"), F.lit(" no completed scan and took no part.")))
    text = F.when(none & unseen, opening).when(none, F.concat(opening, F.lit(" No other repository of it has a completed scan, so nothing was compared."))).otherwise(F.concat(opening, said, rest))
    return F.when(project.isNotNull(), text)


def fixes_table(rows: DataFrame, key: str = "report_id", omitted: Column | None = None) -> DataFrame:
    """A Markdown table of each report's fixes in order of priority, with a line for what is left out."""
    cells = F.transform(
        F.sort_array(F.collect_list(F.struct("priority", "package", "manifest_path", "fix_type", "target_version", "replacement_package"))),
        lambda x: F.concat(F.lit("| "), x["priority"].cast("string"), F.lit(" | "), table_cell(x["package"]), F.lit(" | "), table_cell(x["manifest_path"]), F.lit(" | "), fix_sentence(x["fix_type"], x["package"], x["target_version"], x["replacement_package"]), F.lit(" |")),
    )
    head = F.array(F.lit("| # | Package | Manifest | Fix |"), F.lit("|---|---|---|---|"))
    return rows.groupBy(key).agg(F.array_join(F.concat(head, cells), "\n").alias("markdown"))


def prompt_json(rows: DataFrame, *keys: str) -> DataFrame:
    """The prompt's JSON per group, fields in sorted order; a null field is left out."""
    fields = sorted(c for c in rows.columns if c not in keys)
    item = F.struct(*fields)
    return rows.groupBy(*keys).agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("dependencies"))).alias("prompt"))


def trace(reports: DataFrame, retrieved: DataFrame, cited: DataFrame, key: str = "report_id") -> DataFrame:
    """Every retrieved chunk, cited or not, as the nested array of a permanent trace row."""
    marked = retrieved.join(cited.select(key, "chunk_id", F.lit(True).alias("was_cited")), [key, "chunk_id"], "left")
    listed = marked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", "chunk_id", "similarity", F.coalesce("was_cited", F.lit(False)).alias("cited")))).alias("retrieved_chunks"))
    return reports.join(listed, key, "left")
