"""Which files of a repository tree are manifests, which lockfile goes with each, and workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Folders of vendored code, manifest names, and the lockfiles of each kind of manifest in order of preference.
VENDORED = ("node_modules", "bower_components", "vendor", "site-packages", ".venv", "venv")
REQUIREMENTS = r"(?i)^(?:requirements[-_.][\w.-]*|[\w.-]*[-_.]requirements|requirements)\.txt$"
PYPI_FIXED = ("requirements.txt", "pyproject.toml", "Pipfile", "setup.py")
DEV_TOKENS = ("dev", "development", "test", "tests", "testing")
LOCKFILES = {"package_json": ("npm-shrinkwrap.json", "package-lock.json"), "pyproject": ("poetry.lock",), "pipfile": ("Pipfile.lock",)}
MOST_MANIFESTS = 50


def parts(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def depth(path: Column) -> Column:
    return F.size(parts(path)) - 1


def is_vendored(path: Column) -> Column:
    folders = F.slice(parts(path), F.lit(1), F.greatest(depth(path), F.lit(0)))
    return F.arrays_overlap(folders, F.array(*map(F.lit, VENDORED)))


def adapter(path: Column) -> Column:
    """npm, pypi, or null for a path that no adapter owns."""
    name = base_name(path)
    in_requirements = F.coalesce(F.lower(F.element_at(F.concat(F.array(F.lit("")), parts(directory(path))), -1)) == "requirements", F.lit(False)) & name.rlike(r"(?i)\.txt$")
    return F.when(is_vendored(path), F.lit(None).cast("string")).when(name == "package.json", "npm").when(name.isin(*PYPI_FIXED) | name.rlike(REQUIREMENTS) | in_requirements, "pypi")


def manifest_kind(path: Column) -> Column:
    name = base_name(path)
    return F.when(name == "package.json", "package_json").when(name == "pyproject.toml", "pyproject").when(name == "Pipfile", "pipfile").when(name == "setup.py", "setup_py").otherwise("requirements")


def requirements_group(path: Column) -> Column:
    stem = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    return F.when(F.arrays_overlap(F.split(F.lower(stem), "[-_.]+"), F.array(*map(F.lit, DEV_TOKENS))), "development").otherwise("runtime")


def tree_entries(responses: DataFrame, body: str = "body", *keys: str) -> DataFrame:
    """path, type, sha, size of staged tree responses; anything but a list of entries gives none."""
    shape = "struct<truncated: boolean, tree: array<struct<path: string, type: string, sha: string, size: bigint>>>"
    return responses.select(*keys, F.explode(F.from_json(body, shape)["tree"]).alias("e")).select(*keys, "e.*").where("path IS NOT NULL")


def blob_bytes(encoding: Column, content: Column, most: int) -> Column:
    """Decoded bytes of a blob response: base64 only, null if invalid or larger than ``most``."""
    decoded = F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))
    return F.when((encoding == "base64") & (F.octet_length(decoded) <= most), decoded)


def plan(entries: DataFrame, key: str = "scan_id", most: int = MOST_MANIFESTS) -> DataFrame:
    """The ``most`` shallowest manifests of each tree with the lockfile beside them that their kind prefers."""
    blobs = entries.where("type = 'blob'").withColumn("ecosystem", adapter(F.col("path")))
    rank = F.create_map(*[x for names in LOCKFILES.values() for n, name in enumerate(names) for x in (F.lit(name), F.lit(n))])
    kind = F.create_map(*[x for kind, names in LOCKFILES.items() for name in names for x in (F.lit(name), F.lit(kind))])
    name = base_name(F.col("path"))
    locks = blobs.select(key, directory(F.col("path")).alias("folder"), F.element_at(kind, name).alias("kind"), F.element_at(rank, name).alias("rank"), F.struct("path", "sha", "size").alias("lock")).where("rank IS NOT NULL")
    best = locks.groupBy(key, "folder", "kind").agg(F.min_by("lock", "rank").alias("lock"))
    owned = blobs.where("ecosystem IS NOT NULL").withColumns({"folder": directory(F.col("path")), "kind": manifest_kind(F.col("path"))})
    order = Window.partitionBy(key).orderBy(depth(F.col("path")), "path")
    kept = owned.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    return kept.join(best, [key, "folder", "kind"], "left").select(
        key, "position", "ecosystem", "path", "folder", "sha", "size", F.col("lock.path").alias("lockfile_path"), F.col("lock.sha").alias("lock_sha"), F.col("lock.size").alias("lock_size"), "kind"
    )


def skipped(entries: DataFrame, planned: DataFrame, failed: DataFrame, key: str = "scan_id") -> DataFrame:
    """Manifests that were not planned, plus planned ones that were too large, unreadable or malformed."""
    present = entries.where(F.col("type") == "blob").where(adapter(F.col("path")).isNotNull()).groupBy(key).agg(F.count("*").alias("present"))
    taken, lost = planned.groupBy(key).agg(F.count("*").alias("taken")), failed.groupBy(key).agg(F.count("*").alias("lost"))
    joined = present.join(taken, key, "left").join(lost, key, "left")
    return joined.select(key, (F.col("present") - F.coalesce("taken", F.lit(0)) + F.coalesce("lost", F.lit(0))).alias("skipped_manifest_count"))


def glob_pattern(glob: Column) -> Column:
    """A path glob as a pattern: * stays inside a folder, ** crosses folders, all else is literal."""
    cleaned = F.regexp_replace(glob, r"/+$", "")
    escaped = F.regexp_replace(cleaned, r"([.+?^$(){}|\[\]\\])", r"\\$1")
    crossing = F.replace(escaped, F.lit("**"), F.lit("\x01"))
    inside = F.replace(crossing, F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit("^"), F.replace(inside, F.lit("\x01"), F.lit(".*")), F.lit("$"))


def workspace_match(folder: Column, globs: Column) -> Column:
    """Included by some glob and excluded by none (those with !); the root itself is no member."""
    wanted = F.exists(globs, lambda g: ~g.startswith("!") & F.rlike(folder, glob_pattern(g)))
    barred = F.exists(globs, lambda g: g.startswith("!") & F.rlike(folder, glob_pattern(F.regexp_replace(g, "^!", ""))))
    return (folder != "") & wanted & ~barred


def workspace_globs(document: Column) -> Column:
    """Strings of ``workspaces``, an array or an object with ``packages``. ``document``: a variant."""
    listed = F.coalesce(F.try_variant_get(document, "$.workspaces.packages", "array<variant>"), F.try_variant_get(document, "$.workspaces", "array<variant>"))
    return F.filter(F.transform(listed, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda s: s.isNotNull())


def adopt(planned: DataFrame, globs: DataFrame, key: str = "scan_id") -> DataFrame:
    """Gives members without a lockfile that of the nearest ancestor that has one and whose globs match.

    ``globs``: (key, folder, globs) of each manifest with workspaces.
    """
    roots = planned.where("lockfile_path IS NOT NULL").join(globs, [key, "folder"]).select(key, F.col("ecosystem"), F.col("folder").alias("root"), "globs", F.col("lockfile_path").alias("root_lock"))
    bare = planned.where("lockfile_path IS NULL")
    segments = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/"))
    climbing = bare.where("folder <> ''").select(key, "path", "folder", "ecosystem", F.explode(ancestors).alias("root"))
    relative = F.when(F.col("root") == "", F.col("folder")).otherwise(F.expr("substring(folder, length(root) + 2)"))
    found = climbing.join(roots, [key, "ecosystem", "root"]).where(workspace_match(relative, F.col("globs")))
    nearest = found.groupBy(key, "path").agg(F.max_by("root_lock", F.length("root")).alias("adopted"))
    return planned.join(nearest, [key, "path"], "left").withColumn("lockfile_path", F.coalesce("lockfile_path", "adopted")).drop("adopted")
