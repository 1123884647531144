"""Registry documents from what the registry answered: one of three outcomes for each package, and the facts of those found.

An npm package has a full document and a reduced one. The full one counts unless it is over its cap;
then the reduced one does, which lacks the times of releases and the repository. PyPI has one. A name that
was never published is not found, and whatever else goes wrong makes the package unavailable: it is
then not assessed, never taken for clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import versions as ver
from . import npm

# The most bytes of a full and of a reduced npm document, and of a PyPI document.
MOST_FULL = 8 * 1024 * 1024
MOST_REDUCED = 16 * 1024 * 1024
MOST_PYPI = 8 * 1024 * 1024


def documents(answers: DataFrame, most_full: int = MOST_FULL, most_reduced: int = MOST_REDUCED, most_pypi: int = MOST_PYPI) -> DataFrame:
    """ecosystem, name, outcome (ok, not_found, unavailable), form and body of every package that was asked for.

    ``answers``: ecosystem, name, form (full or reduced), status (ok, not_found, too_large, or any other word
    for a failure), body. PyPI names are one package however they are spelled. Of several answers to one
    question the one with the smallest status, then body, counts. Only sizes are compared before a body is chosen.
    """
    pypi = F.col("ecosystem") == "pypi"
    name = F.when(pypi, ver.normalised_name(F.col("name"))).otherwise(F.col("name"))
    size = F.octet_length("body")
    cap = F.when(pypi, most_pypi).when(F.col("form") == "full", most_full).otherwise(most_reduced)
    state = F.when(F.col("status") == "not_found", "not_found").when((F.col("status") == "too_large") | (size > cap), "too_large").when((F.col("status") == "ok") & F.col("body").isNotNull(), "ok").otherwise("failed")
    judged = answers.select("ecosystem", name.alias("name"), "form", state.alias("state"), F.when(state == "ok", F.col("body")).alias("body"))
    first = lambda form: F.min(F.when(F.col("form") == form, F.struct("state", "body")))
    both = judged.groupBy("ecosystem", "name").agg(first("full").alias("f"), first("reduced").alias("r"))
    falls_back = ~pypi & (F.col("f.state") == "too_large")
    used = F.when(falls_back, F.col("r")).otherwise(F.col("f"))
    is_object = npm.is_object(F.try_parse_json(used["body"]))
    outcome = F.when(used["state"] == "not_found", "not_found").when((used["state"] == "ok") & is_object, "ok").otherwise("unavailable")
    return both.select("ecosystem", "name", outcome.alias("outcome"), F.when(outcome == "ok", F.when(falls_back, "reduced").otherwise("full")).alias("form"), F.when(outcome == "ok", used["body"]).alias("body"))


def facts(found: DataFrame) -> DataFrame:
    """ecosystem, name, outcome, latest_version, released (versions), times (map to instants), repository and, for
    PyPI, whether the latest release is yanked or the project inactive and why (null for npm, whose versions say so each).

    The latest version is the one the document names, else the highest of those published.
    """
    document = F.try_parse_json(F.col("body"))
    pypi = F.col("ecosystem") == "pypi"
    js = npm.packument(document)
    strings = lambda path, kind: F.try_variant_get(document, path, kind)
    releases = strings("$.releases", "map<string,array<struct<yanked: boolean, yanked_reason: string, upload_time_iso_8601: string, upload_time: string>>>")
    read = found.withColumns(
        {
            "__named": F.nullif(F.when(pypi, strings("$.info.version", "string")).otherwise(js["latest"]), F.lit("")),
            "__releases": releases,
            "released": F.when(pypi, F.map_keys(releases)).otherwise(F.map_keys(js["versions"])),
            "__times": js["times"],
            "repository": F.when(pypi, tx.source_link(strings("$.info.project_urls", "map<string,string>"), strings("$.info.home_page", "string"))).otherwise(F.nullif(F.trim(js["repository"]), F.lit(""))),
            "__classifiers": strings("$.info.classifiers", "array<string>"),
        }
    )
    # Few documents name no latest version; only theirs are ranked.
    unnamed = read.where("__named IS NULL AND outcome = 'ok'").select("ecosystem", "name", F.explode("released").alias("version"))
    highest = ver.latest(unnamed.where("ecosystem = 'npm'"), "npm", "ecosystem", "name").unionByName(ver.latest(unnamed.where("ecosystem = 'pypi'"), "pypi", "ecosystem", "name"))
    joined = read.join(highest.withColumnRenamed("latest_version", "__highest"), ["ecosystem", "name"], "left")
    latest = F.coalesce("__named", "__highest")
    uploaded = F.map_from_entries(F.filter(F.transform(F.map_entries("__releases"), lambda e: F.struct(e["key"].alias("key"), tx.release_time(e["value"]).alias("value"))), lambda e: e["value"].isNotNull()))
    stamped = F.map_from_entries(F.filter(F.transform(F.map_entries("__times"), lambda e: F.struct(e["key"].alias("key"), e["value"].try_cast("timestamp").alias("value"))), lambda e: e["value"].isNotNull()))
    files = F.coalesce(F.try_element_at("__releases", latest), F.array().cast("array<struct<yanked: boolean, yanked_reason: string, upload_time_iso_8601: string, upload_time: string>>"))
    deprecation = F.when(pypi & (F.col("outcome") == "ok"), tx.pypi_deprecation(files, F.coalesce("__classifiers", F.array().cast("array<string>"))))
    return joined.select("ecosystem", "name", "outcome", "form", latest.alias("latest_version"), F.coalesce("released", F.array().cast("array<string>")).alias("released"), F.when(pypi, uploaded).otherwise(stamped).alias("times"), "repository", deprecation.alias("deprecation"))
