"""Declared constraints of the model, as data, held against a table in one pass.

Rules are SQL predicates over one row; as in a database, a rule that is null passes. One scan gives
the rows that break a rule and, as observed metrics of the same job, the totals.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import shared_path

# The members of the model's enumerations.
STATUSES = ("queued", "running", "completed", "failed")
TRIGGERS = ("initial", "manual")
CLASSES = ("safe", "medium", "high_alert")
GROUNDING = ("sufficient", "low")
ECOSYSTEMS = ("npm", "pypi")
GROUPS = ("runtime", "development", "optional", "peer", "build", "unknown")
REPORT_TYPES = ("combined", "per_dependency")
RESOLUTIONS = ("lockfile", "pinned", "range_latest_approx")
SEVERITIES = ("unknown", "low", "medium", "high", "critical")


def _among(column: str, members: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(m) for m in members)})"


#: Rules by table and name.
RULES: dict[str, dict[str, str]] = {
    "scan": {
        "trigger_type_valid": _among("trigger_type", TRIGGERS),
        "status_valid": _among("status", STATUSES),
        "risk_score_range": "risk_score BETWEEN 0 AND 100",
        "skipped_manifests_non_negative": "skipped_manifest_count >= 0",
        "classification_valid": _among("classification", CLASSES),
    },
    "manifest": {"ecosystem_valid": _among("ecosystem", ECOSYSTEMS)},
    "package": {"ecosystem_valid": _among("ecosystem", ECOSYSTEMS)},
    "occurrence": {
        "group_valid": _among("dependency_group", GROUPS),
        "resolution_valid": _among("resolution", RESOLUTIONS),
        "severity_valid": _among("highest_severity", SEVERITIES),
        "vuln_count_non_negative": "vulnerability_count >= 0",
        "versions_behind_non_negative": "versions_behind_major >= 0 AND versions_behind_minor >= 0 AND versions_behind_patch >= 0",
        "component_score_range": "risk_component_score BETWEEN 0 AND 100",
    },
    "advisory": {"severity_valid": _among("severity", SEVERITIES)},
    "report": {
        "type_valid": _among("report_type", REPORT_TYPES),
        "status_valid": _among("status", STATUSES),
        "grounding_confidence_valid": _among("grounding_confidence", GROUNDING),
        # Both halves: a combined report names no dependency, and one on a dependency names it.
        "dependency_matches_type": "(report_type = 'combined' AND dependency_id IS NULL) OR (report_type = 'per_dependency' AND dependency_id IS NOT NULL)",
    },
}


def audit(rows: DataFrame, rules: Mapping[str, str], *keys: str) -> tuple[DataFrame, dict[str, int]]:
    """(keys and rule of every violation, totals by rule and of ``rows``), both from one scan of ``rows``.

    A rule over columns that the table lacks fails at once.
    """
    broken = F.array(*[F.when(~F.coalesce(F.expr(f"({test})"), F.lit(True)), name) for name, test in rules.items()])
    marked = rows.select(*keys, F.filter(broken, lambda x: x.isNotNull()).alias("broken"))
    seen = Observation()
    counts = [F.count_if(F.array_contains("broken", name)).alias(name) for name in rules]
    path = shared_path(rows.sparkSession, "violations")
    found = marked.observe(seen, F.count("*").alias("rows"), *counts).select(*keys, F.explode("broken").alias("rule"))
    found.write.parquet(path)
    return rows.sparkSession.read.schema(found.schema).parquet(path), dict(seen.get)
