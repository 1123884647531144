"""package.json and its lockfiles as rows, over variants: object keys may repeat, the last counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.versions import SEMVER, semver_pin

# Dependency blocks in order of precedence and the group each stands for.
BLOCKS = {"dependencies": "runtime", "devDependencies": "development", "optionalDependencies": "optional", "peerDependencies": "peer"}
PACKAGE_NAME = r"(?i)^(?:@[a-z0-9][\w.-]*/)?[a-z0-9][\w.-]*$"
SHORTHAND = r"^[\w.-]+/[\w.-]+(?:#.+)?$"


def specifier_class(specifier: Column) -> Column:
    """Why a registry cannot say anything of a specifier, most specific form first; null if it can."""
    text = F.trim(F.coalesce(specifier, F.lit("")))
    low = F.lower(text)
    begins = lambda *heads: F.array_max(F.array(*[low.startswith(h) for h in heads]))
    return (
        F.when(begins("file:"), "file_specifier")
        .when(begins("link:"), "link_specifier")
        .when(begins("workspace:"), "workspace_specifier")
        .when(begins("git:", "git+", "ssh://", "git@"), "git_specifier")
        .when(begins("github:"), "github_specifier")
        .when(begins("http://", "https://"), "url_specifier")
        .when(begins("npm:"), "alias_specifier")
        .when(text.rlike(SHORTHAND) & ~text.startswith("@"), "github_specifier")
    )


def is_object(document: Column) -> Column:
    return F.coalesce(F.schema_of_variant(document).startswith("OBJECT"), F.lit(False))


def declared(manifests: DataFrame, *keys: str, body: str = "body") -> DataFrame:
    """name, declared_specifier, dependency_group of every package.json; one row per name, the first block's.

    A body that is not a JSON object has no rows; find those with ``malformed``.
    """
    parsed = manifests.withColumn("__doc", F.try_parse_json(body)).where(is_object(F.col("__doc")))
    block = F.explode(F.array(*[F.struct(F.lit(n).alias("rank"), F.lit(group).alias("dependency_group"), F.try_variant_get("__doc", f"$.{name}", "map<string,variant>").alias("entries")) for n, (name, group) in enumerate(BLOCKS.items())])).alias("b")
    rows = parsed.select(*keys, block).select(*keys, "b.rank", "b.dependency_group", F.explode("b.entries").alias("name", "value")).where(F.col("name").rlike(PACKAGE_NAME))
    text = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string")).otherwise("")
    first = Window.partitionBy(*keys, "name").orderBy("rank")
    return rows.withColumn("declared_specifier", text).withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*keys, "name", "declared_specifier", "dependency_group")


def malformed(manifests: DataFrame, *keys: str, body: str = "body") -> DataFrame:
    return manifests.where(~is_object(F.try_parse_json(body))).select(*keys)


def locked(lockfiles: DataFrame, *keys: str, body: str = "body") -> DataFrame:
    """name, version of a package-lock: the hoisted entry, else the smallest nested one, else the old map's."""
    parsed = lockfiles.withColumn("__doc", F.try_parse_json(body)).where(is_object(F.col("__doc")))
    version = lambda v: F.nullif(F.try_variant_get(v, "$.version", "string"), F.lit(""))
    packages = parsed.select(*keys, F.explode(F.try_variant_get("__doc", "$.packages", "map<string,variant>")).alias("place", "value")).where(F.col("place").contains("node_modules/"))
    entries = packages.select(
        *keys,
        F.regexp_extract("place", r"node_modules/((?:@[^/]+/)?[^/]+)$", 1).alias("name"),
        F.col("place").rlike(r"^node_modules/(?:@[^/]+/)?[^/]+$").alias("hoisted"),
        version(F.col("value")).alias("version"),
        F.coalesce(F.try_variant_get("value", "$.link", "boolean"), F.lit(False)).alias("link"),
    ).where("name <> '' AND NOT link AND version IS NOT NULL")
    new = entries.groupBy(*keys, "name").agg(F.coalesce(F.min(F.when(F.col("hoisted"), F.col("version"))), F.min("version")).alias("new_version"))
    old = parsed.select(*keys, F.explode(F.try_variant_get("__doc", "$.dependencies", "map<string,variant>")).alias("name", "value")).select(*keys, "name", version(F.col("value")).alias("old_version")).where(F.col("old_version").rlike(SEMVER))
    return new.join(old, [*keys, "name"], "full").select(*keys, "name", F.coalesce("new_version", "old_version").alias("version"))


def resolve(rows: DataFrame, locks: DataFrame, *keys: str) -> DataFrame:
    """Adds unassessable_reason, resolved_version and resolution: unassessable, lockfile, pinned, or open."""
    joined = rows.join(locks.withColumnRenamed("version", "__locked"), [*keys, "name"], "left").withColumn("unassessable_reason", specifier_class(F.col("declared_specifier")))
    able, pin = F.col("unassessable_reason").isNull(), semver_pin(F.col("declared_specifier"))
    return joined.withColumn("resolved_version", F.when(able, F.coalesce("__locked", pin))).withColumn("resolution", F.when(able & F.col("__locked").isNotNull(), "lockfile").when(able & pin.isNotNull(), "pinned")).drop("__locked")


def packument(document: Column) -> Column:
    """struct<latest, versions, times, repository> of a registry document (a variant)."""
    return F.struct(
        F.try_variant_get(document, '$["dist-tags"].latest', "string").alias("latest"),
        F.try_variant_get(document, "$.versions", "map<string,variant>").alias("versions"),
        F.try_variant_get(document, "$.time", "map<string,string>").alias("times"),
        F.coalesce(F.try_variant_get(document, "$.repository.url", "string"), F.try_variant_get(document, "$.repository", "string")).alias("repository"),
    )
