"""Severity arithmetic and the fields of an advisory document, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the CVSS 3 standard.
AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
AC = {"L": 0.77, "H": 0.44}
PR = {"N": 0.85, "L": 0.62, "H": 0.27}
PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
UI = {"N": 0.85, "R": 0.62}
CIA = {"H": 0.56, "L": 0.22, "N": 0.0}
DECLARED = {"CRITICAL": "critical", "HIGH": "high", "MODERATE": "medium", "MEDIUM": "medium", "LOW": "low"}


def _metric(vector: Column, name: str, table: dict[str, float]) -> Column:
    letter = F.regexp_extract(vector, rf"(?:^|/){name}:([A-Z])(?:/|$)", 1)
    value = None
    for key, number in table.items():
        value = F.when(letter == key, F.lit(number)) if value is None else value.when(letter == key, F.lit(number))
    return value


def _round_up(x: Column) -> Column:
    """The standard's round-up to a tenth, over integers of a hundred-thousandth."""
    whole = F.rint(x * 100000).cast("long")
    return F.when(whole % 10000 == 0, whole / 100000.0).otherwise((F.floor(whole / 10000) + 1) / 10.0)


def cvss3(vector: Column) -> Column:
    """Base score of a CVSS 3.x vector; null for another version, a missing or an unknown metric."""
    scope = F.regexp_extract(vector, r"(?:^|/)S:([UC])(?:/|$)", 1)
    changed = scope == "C"
    loss = F.lit(1.0) - (F.lit(1.0) - _metric(vector, "C", CIA)) * (F.lit(1.0) - _metric(vector, "I", CIA)) * (F.lit(1.0) - _metric(vector, "A", CIA))
    impact = F.when(changed, F.lit(7.52) * (loss - 0.029) - F.lit(3.25) * F.pow(loss - 0.02, F.lit(15.0))).otherwise(F.lit(6.42) * loss)
    ease = F.lit(8.22) * _metric(vector, "AV", AV) * _metric(vector, "AC", AC) * F.when(changed, _metric(vector, "PR", PR_CHANGED)).otherwise(_metric(vector, "PR", PR)) * _metric(vector, "UI", UI)
    total = F.when(changed, F.lit(1.08) * (impact + ease)).otherwise(impact + ease)
    score = F.when(impact <= 0, F.lit(0.0)).otherwise(_round_up(F.least(total, F.lit(10.0))))
    known = vector.startswith("CVSS:3.") & (scope != "") & impact.isNotNull() & ease.isNotNull()
    return F.when(known, score)


def bucket(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score >= 0, "low")


def declared_severity(word: Column) -> Column:
    table = F.create_map(*[x for pair in DECLARED.items() for x in map(F.lit, pair)])
    return F.element_at(table, F.upper(F.trim(word)))


def cve_of(osv_id: Column, aliases: Column) -> Column:
    """The first alias that is a CVE, else the id if it is one."""
    is_cve = lambda x: F.upper(x).startswith("CVE-")
    return F.coalesce(F.get(F.filter(aliases, is_cve), F.lit(0)), F.when(is_cve(osv_id), osv_id))


def best_cvss(document_vectors: Column, affected_vectors: Column) -> Column:
    """Highest score over the document's own vectors and those of every affected entry (arrays of arrays)."""
    every = F.concat(F.coalesce(document_vectors, F.array().cast("array<string>")), F.coalesce(F.flatten(affected_vectors), F.array().cast("array<string>")))
    return F.array_max(F.transform(every, cvss3))


def affected_entry(affected: Column, package: Column) -> Column:
    """The first entry for the package, spelled as it is; one without a package object is for every package."""
    fits = lambda x: x["package"].isNull() | F.coalesce(x["package"]["name"] == package, F.lit(False))
    return F.get(F.filter(affected, fits), F.lit(0))


def affected_range(events: Column) -> Column:
    """The text of a range from its events, the last value of each kind deciding."""
    last = lambda field: F.element_at(F.filter(F.transform(events, lambda x: x[field]), lambda v: v.isNotNull()), -1)
    final = lambda field: F.when(F.exists(events, lambda x: x[field].isNotNull()), last(field))
    pieces = F.array(F.concat(F.lit(">="), final("introduced")), F.concat(F.lit("<"), final("fixed")), F.when(final("fixed").isNull(), F.concat(F.lit("<="), final("last_affected"))))
    return F.nullif(F.array_join(pieces, " "), F.lit(""))


def fixed_version(events: Column) -> Column:
    return F.when(F.exists(events, lambda x: x["fixed"].isNotNull()), F.element_at(F.filter(F.transform(events, lambda x: x["fixed"]), lambda v: v.isNotNull()), -1))


def source_url(osv_id: Column, references: Column) -> Column:
    """The first advisory or web reference with an address, else one built from the id."""
    good = F.filter(references, lambda x: x["type"].isin("ADVISORY", "WEB") & (F.coalesce(x["url"], F.lit("")) != ""))
    return F.coalesce(F.get(good, F.lit(0))["url"], F.concat(F.lit("https://osv.dev/vulnerability/"), osv_id))


def instant(text: Column) -> Column:
    return text.try_cast("timestamp")


def probability(text: Column) -> Column:
    """A probability in [0, 1] at five places, half to even; anything else is null."""
    number = text.try_cast("decimal(20,15)")
    return F.when(number.between(0, 1), F.bround(number, 5).cast("decimal(6,5)"))


def osv_ecosystem(name: Column) -> Column:
    return F.when(name == "npm", "npm").when(name == "pypi", "PyPI")
