"""The registry of manifest adapters as table functions of SQL.

    adapters.register(spark)
    spark.sql("SELECT f.path, m.* FROM files f, LATERAL manifest_entries(f.path, f.text) m")

``manifest_entries`` gives what a manifest declares, in order, whichever adapter owns its path;
``locked_versions`` the versions of a lockfile. A path that no adapter owns gives no rows, a bad file one
row with its error. Where the path is a constant, the analysis already refuses one that nobody owns.
Rows are raw entries; names and pins are read with column functions, as everywhere else.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import npm, paths, pypi
from .pypi import Entry

# Fixed value: the name of a requirements file, as for columns.
REQUIREMENTS = re.compile(paths.REQUIREMENTS)
_SKIPPED = re.compile(r"(^|\s)#.*$")
_HASH = re.compile(r"\s--hash[=\s]\S+")


def requirement_entries(text: str) -> Iterator[Entry]:
    """Logical lines that are no options; each is an entry of its own."""
    joined = re.sub(r"\r\n?", "\n", text).replace("\\\n", "")
    for line in joined.split("\n"):
        bare = _HASH.sub("", _SKIPPED.sub("", line)).strip()
        if bare and (re.match(pypi.EDITABLE, bare) or not bare.startswith("-")):
            yield Entry(bare, None)


def package_entries(text: str) -> Iterator[Entry]:
    """Names of package.json by block, the first block's for each name."""
    document = json.loads(text)
    if not isinstance(document, dict):
        raise ValueError("not an object")
    seen: set[str] = set()
    for block, group in npm.BLOCKS.items():
        entries = document.get(block)
        for name, value in entries.items() if isinstance(entries, dict) else ():
            if name not in seen and re.match(npm.PACKAGE_NAME, name):
                seen.add(name)
                yield Entry(name, value if isinstance(value, str) else "", group)


def package_lock(text: str) -> Iterator[Entry]:
    """The hoisted entry of a name, else the smallest nested one; links have no version of their own."""
    packages = json.loads(text).get("packages")
    best: dict[str, tuple[bool, str]] = {}
    for place, value in packages.items() if isinstance(packages, dict) else ():
        found = re.search(r"node_modules/((?:@[^/]+/)?[^/]+)$", place)
        version = value.get("version") if isinstance(value, dict) and not value.get("link") else None
        if found and isinstance(version, str) and version:
            rank = (re.fullmatch(r"node_modules/(?:@[^/]+/)?[^/]+", place) is None, version)
            best[found[1]] = min(rank, best.get(found[1], rank))
    yield from (Entry(name, version, pins=False) for name, (_, version) in best.items())


Reader = Callable[[str], Iterator[Entry]]
MANIFESTS: dict[str, Reader] = {"package_json": package_entries, "requirements": requirement_entries, "pyproject": pypi.pyproject_entries, "pipfile": pypi.pipfile_entries, "setup_py": pypi.setup_entries}
LOCKS: dict[str, Reader] = {"package-lock.json": package_lock, "npm-shrinkwrap.json": package_lock, "poetry.lock": pypi.poetry_lock, "Pipfile.lock": pypi.pipfile_lock}
FIXED = {"package.json": "package_json", "pyproject.toml": "pyproject", "Pipfile": "pipfile", "setup.py": "setup_py"}


def kind_of(path: str | None) -> str | None:
    """The kind of manifest that a path is, or none."""
    folders, name = (path or "").split("/")[:-1], (path or "").split("/")[-1]
    if set(folders) & set(paths.VENDORED):
        return None
    if name in FIXED:
        return FIXED[name]
    listed = folders and folders[-1].lower() == "requirements" and name.lower().endswith(".txt")
    return "requirements" if listed or REQUIREMENTS.match(name) else None


def _checked(path: AnalyzeArgument, text: AnalyzeArgument, owner: Callable[[str | None], object], what: str) -> None:
    for argument in (path, text):
        if not isinstance(argument.dataType, (T.StringType, T.NullType)):
            raise ValueError(f"{what} takes a path and a text, both strings")
    if path.isConstantExpression and path.value is not None and owner(path.value) is None:
        raise ValueError(f"no adapter reads {path.value!r}")


class ManifestEntries:
    """at, kind, entry, specifier, dependency_group, reason, pins, error."""

    SCHEMA = "at int, kind string, entry string, specifier string, dependency_group string, reason string, pins boolean, error string"

    @staticmethod
    def analyze(path: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        _checked(path, text, kind_of, "manifest_entries")
        return AnalyzeResult(_shape(ManifestEntries.SCHEMA))

    def eval(self, path: str | None, text: str | None):
        kind = kind_of(path)
        if kind is None:
            return
        try:
            found = list(MANIFESTS[kind](text))
        except Exception as error:  # whatever is wrong with a file loses that file alone
            yield -1, kind, None, None, None, None, None, type(error).__name__
            return
        for at, entry in enumerate(found):
            yield at, kind, entry.entry, entry.specifier, entry.grp, entry.reason, entry.pins, None


class LockedVersions:
    """name and version as the lockfile spells them; of a repeated name the last row counts."""

    SCHEMA = "at int, name string, version string, pins boolean, error string"

    @staticmethod
    def analyze(path: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        _checked(path, text, lambda p: LOCKS.get((p or "").split("/")[-1]), "locked_versions")
        return AnalyzeResult(_shape(LockedVersions.SCHEMA))

    def eval(self, path: str | None, text: str | None):
        reader = LOCKS.get((path or "").split("/")[-1])
        if reader is None:
            return
        try:
            found = list(reader(text))
        except Exception as error:  # whatever is wrong with a file loses that file alone
            yield -1, None, None, None, type(error).__name__
            return
        for at, entry in enumerate(found):
            yield at, entry.entry, entry.specifier, entry.pins, None


def _shape(schema: str) -> T.StructType:
    kinds = {"int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("manifest_entries", udtf(ManifestEntries))
    spark.udtf.register("locked_versions", udtf(LockedVersions))
