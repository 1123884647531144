"""Sinks of the engine: the CSV panel, the JSON manifest, and report documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_text(column: str, kind: str) -> Column:
    """Null is empty, booleans are spelled True and False."""
    value = F.col(column)
    text = F.when(value, "True").when(~value, "False") if kind == "boolean" else value.cast("string")
    return F.coalesce(text, F.lit("")).alias(column)


#: A quote inside a cell is doubled, and a cell may hold line ends.
CSV = {"header": "true", "escape": '"', "emptyValue": ""}


def write_panel(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files with a header in a folder, a file a task; gzip, as cells repeat and a file with line ends in cells is read whole anyway."""
    rows.select(*[csv_text(c, kind) for c, kind in rows.dtypes]).write.mode(mode).options(**CSV, compression="gzip").csv(path)


def read_panel(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The cells of a panel as text."""
    shape = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(shape).options(**CSV, multiLine="true", enforceSchema="false").csv(path).na.fill("")


def manifest(panel: DataFrame, version: str, source: str | None) -> DataFrame:
    """One JSON document on a run: version, filter and counts."""
    counts = panel.agg(F.count("*").alias("n_repositories"), F.count_if("changed").alias("n_changed"))
    return counts.select(F.to_json(F.struct(F.lit(version).alias("weights"), F.lit(source).alias("source"), "n_repositories", "n_changed")).alias("manifest"))


def report_json(reports: DataFrame, *fields: str) -> DataFrame:
    return reports.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


# Fields of a report's document in their order, and of a cited passage in it.
DOCUMENT_FIELDS = ("schema", "report_type", "repository", "scan_id", "scoring_formula_version", "generated_at", "model", "dependency", "grounding_confidence", "citations", "project_context", "note", "summary_md", "fixes")
PASSAGE_FIELDS = ("chunk_id", "source_path", "source_sha", "heading", "similarity", "text")
DEPENDENCY_FIELDS = ("package", "ecosystem", "manifest_path", "resolved_version", "declared_specifier")
DOCUMENT_SCHEMA = "keelson/report@1"


def report_documents(reports: DataFrame, passages: DataFrame, note: str) -> DataFrame:
    """report_id and the report as one JSON document: what it is about, what grounded it, the passages it cites, and the payload.

    ``reports``: report_id, the document's fields but for schema, citations and note, and those of the
    dependency (all null in a report on a whole scan); ``fixes`` and ``project_context`` are any columns.
    ``passages``: report_id, cited_at (place of the citation, from 1) and the fields of a passage.
    """
    passage = F.struct(*PASSAGE_FIELDS)
    cited = passages.where("cited_at IS NOT NULL").groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("cited_at", passage.alias("p")))).alias("c"))
    dependency = F.when(F.col("package").isNotNull(), F.struct(*DEPENDENCY_FIELDS))
    listed = F.transform("c", lambda x: x["p"])
    given = {
        "schema": F.lit(DOCUMENT_SCHEMA),
        "scan_id": F.col("scan_id").cast("string"),
        "dependency": dependency,
        "citations": F.coalesce(listed, F.array()),
        "note": F.lit(note),
    }
    document = F.struct(*[given.get(c, F.col(c)).alias(c) for c in DOCUMENT_FIELDS])
    return reports.join(cited, "report_id", "left").select("report_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def report_markdown(reports: DataFrame) -> DataFrame:
    """title, summary, fixes table and note as one document."""
    return reports.select("report_id", F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), "summary_md", "markdown", F.concat(F.lit("> "), "note")).alias("document"))
