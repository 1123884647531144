"""Requirements files, pyproject.toml, Pipfile, setup.py and their lockfiles as rows.

Requirement lines are parsed with column functions. TOML and Python sources have grammars that
only a parser reads, so those manifests go through a table function per file, Arrow-batched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.versions import normalised_name, pep440_pin
from .paths import requirements_group

# Option spellings of requirement files.
OPTIONS = r"(?i)^(?:-r|--requirement|-c|--constraint|-i|--index-url|--extra-index-url|--no-index|-f|--find-links|--no-binary|--only-binary|--prefer-binary|--require-hashes|--pre|--trusted-host|--use-feature|--no-deps)"
EDITABLE = r"(?i)^(?:-e|--editable)\s*=?\s*"
GROUPS = {"install_requires": "runtime", "setup_requires": "build", "tests_require": "development", "extras_require": "optional"}
EXCERPT = 120

# A name as PEP 508 has it, then extras in brackets, then what remains; a fragment names its project by egg=.
NAME = r"([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)"
REQUIREMENT = rf"(?s)^{NAME}\s*(?:\[([^\]]*)\])?\s*(.*)$"
EGG = rf"[#&]egg={NAME}"


def logical_lines(text: Column) -> Column:
    """Lines with continuations joined, comments and hash options dropped, and blanks left out."""
    joined = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\\\n", "")
    tidy = F.transform(F.split(joined, "\n"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"(^|\s)#.*$", ""), r"\s--hash[=\s]\S+", "")))
    return F.filter(tidy, lambda s: s != "")


def reference_class(value: Column) -> Column:
    text = F.trim(value)
    low = F.lower(text)
    return (
        F.when(low.rlike(r"^(?:git\+|hg\+|svn\+|bzr\+|git:|git@)"), "vcs_specifier")
        .when(low.rlike(r"^https?://"), "url_specifier")
        .when(low.rlike(r"^(?:file:|\./|\.\./|\.\\|/)") | text.isin(".", ".."), "local_path_specifier")
    )


def with_requirement(rows: DataFrame, line: Column, to: str = "r") -> DataFrame:
    """Adds struct<name, declared_specifier, resolved_version, reason> of a line; null if it declares nothing.

    Each step is a column of its own, so that its pattern is matched once and the generated code stays small.
    """
    body = F.col("__body")
    steps = rows.withColumn("__text", F.trim(line)).withColumn("__editable", F.col("__text").rlike(EDITABLE))
    bare = F.when(F.col("__editable"), F.regexp_replace("__text", EDITABLE, "")).otherwise(F.col("__text"))
    steps = steps.withColumn("__body", F.trim(F.regexp_replace(bare, r";.*$", "")))
    steps = steps.withColumns({"__why": reference_class(body), "__egg": F.regexp_extract(body, EGG, 1), "__name": F.regexp_extract(body, REQUIREMENT, 1), "__rest": F.trim(F.regexp_extract(body, REQUIREMENT, 3))})
    steps = steps.withColumn("__target", F.when(F.col("__rest").startswith("@"), F.trim(F.regexp_replace("__rest", "^@", ""))))
    steps = steps.withColumns({"__reached": reference_class(F.col("__target")), "__pin": pep440_pin(F.col("__rest"))})
    refers, aims = F.col("__why").isNotNull(), F.col("__target").isNotNull()
    nothing = (~F.col("__editable") & F.col("__text").startswith("-")) | (body == "") | F.when(refers, F.col("__egg") == "").otherwise(F.col("__name") == "")
    made = F.struct(
        normalised_name(F.when(refers, F.col("__egg")).otherwise(F.col("__name"))).alias("name"),
        F.when(refers, body).when(aims, F.col("__target")).otherwise(F.col("__rest")).alias("declared_specifier"),
        F.when(~refers & ~aims, F.col("__pin")).alias("resolved_version"),
        F.when(refers, F.col("__why")).when(aims, F.coalesce("__reached", F.lit("url_specifier"))).alias("reason"),
    )
    return steps.withColumn(to, F.when(~nothing, made)).select(*rows.columns, to)


def requirements(files: DataFrame, *keys: str, path: str = "path", text: str = "text") -> DataFrame:
    """Rows of requirements files: first line of a name wins inside a file, the file's name gives the group."""
    lines = files.select(*keys, path, F.posexplode(logical_lines(F.col(text))).alias("__at", "__line"))
    rows = with_requirement(lines, F.col("__line"))
    first = Window.partitionBy(*keys, path, "r.name").orderBy("__at")
    kept = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1 AND r IS NOT NULL")
    return kept.select(*keys, path, "r.name", "r.declared_specifier", "r.resolved_version", F.col("r.reason").alias("unassessable_reason"), requirements_group(F.col(path)).alias("dependency_group"))


# --------------------------------------------------------------- parsed files


class Entry(NamedTuple):
    """A requirement line (``specifier`` null), or a name with what is declared for it."""

    entry: str
    specifier: str | None
    grp: str = ""
    reason: str | None = None
    pins: bool = True  # whether an exact specifier resolves the version


# Keys of a dependency table that refer to something outside the registry.
POETRY_REFERENCES = {"git": "vcs_specifier", "url": "url_specifier", "path": "local_path_specifier"}
PIPFILE_REFERENCES = {"git": "vcs_specifier", "file": "url_specifier", "path": "local_path_specifier"}


def _table(value) -> dict:
    return value if isinstance(value, dict) else {}


def _strings(value) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def _block(block, group: str, references: dict[str, str], lists: bool) -> Iterator[Entry]:
    """A table of names; values of no known shape declare nothing."""
    for name, value in _table(block).items():
        if isinstance(value, str):
            yield Entry(name, value, group)
        elif isinstance(value, dict):
            used = next((key for key in references if value.get(key)), None)
            if used:
                yield Entry(name, f"{used} = {value[used]}", group, references[used])
            else:
                yield Entry(name, "".join(_strings([value.get("version")])), group)
        elif lists and isinstance(value, list):
            yield Entry(name, " || ".join(_strings([_table(x).get("version") for x in value])), group, None, False)


def pyproject_entries(text: str) -> Iterator[Entry]:
    """Both the standard table and Poetry's, in order of precedence."""
    import tomllib

    document = tomllib.loads(text)
    project = _table(document.get("project"))
    yield from (Entry(line, None, "runtime") for line in _strings(project.get("dependencies")))
    for lines in _table(project.get("optional-dependencies")).values():
        yield from (Entry(line, None, "optional") for line in _strings(lines))
    poetry = _table(_table(document.get("tool")).get("poetry"))
    blocks = [(poetry.get("dependencies"), "runtime"), (poetry.get("dev-dependencies"), "development")]
    blocks += [(_table(g).get("dependencies"), "development") for g in _table(poetry.get("group")).values()]
    for block, group in blocks:
        yield from (e for e in _block(block, group, POETRY_REFERENCES, True) if e.entry.lower() != "python")


def pipfile_entries(text: str) -> Iterator[Entry]:
    import tomllib

    document = tomllib.loads(text)
    yield from _block(document.get("packages"), "runtime", PIPFILE_REFERENCES, False)
    yield from _block(document.get("dev-packages"), "development", PIPFILE_REFERENCES, False)


def setup_entries(text: str) -> Iterator[Entry]:
    """Keywords of the setup call, read without running anything: literals, names bound to literals, sums of lists.

    A keyword of which something cannot be read gives one more row, with an excerpt of its source.
    """
    import ast

    tree, known = ast.parse(text), {}
    for node in tree.body:
        if isinstance(node, ast.Assign):
            try:
                known |= dict.fromkeys((t.id for t in node.targets if isinstance(t, ast.Name)), ast.literal_eval(node.value))
            except (ValueError, TypeError, SyntaxError):
                pass  # not a literal: the name stays unknown

    def static(node):
        match node:
            case ast.Name(id=name) if name in known:
                return known[name]
            case ast.BinOp(left=left, op=ast.Add(), right=right):
                both = static(left), static(right)
                return both[0] + both[1] if all(isinstance(x, list) for x in both) else None
        try:
            return ast.literal_eval(node)
        except (ValueError, TypeError, SyntaxError):
            return None

    call = next((n for n in ast.walk(tree) if isinstance(n, ast.Call) and getattr(n.func, "id", getattr(n.func, "attr", "")) == "setup"), None)
    given = {k.arg: k.value for k in call.keywords} if call else {}
    for keyword in (k for k in GROUPS if k in given):
        found = static(given[keyword])
        lists = list(found.values()) if keyword == "extras_require" and isinstance(found, dict) else [found if keyword != "extras_require" else None]
        readable = all(isinstance(x, (list, tuple)) for x in lists)
        lines = [line for x in lists for line in x] if readable else []
        yield from (Entry(line, None, GROUPS[keyword]) for line in lines if isinstance(line, str))
        if not readable or not all(isinstance(line, str) for line in lines):
            excerpt = " ".join((ast.get_source_segment(text, given[keyword]) or "").split())
            yield Entry(f"setup.py:{keyword}", excerpt if len(excerpt) <= EXCERPT else excerpt[: EXCERPT - 3] + "...", GROUPS[keyword], "dynamic_setup_py")


def poetry_lock(text: str) -> Iterator[Entry]:
    import tomllib

    packages = tomllib.loads(text).get("package")
    for package in map(_table, packages if isinstance(packages, list) else []):
        if _strings([package.get("name"), package.get("version")])[1:]:
            yield Entry(package["name"], package["version"], pins=False)


def pipfile_lock(text: str) -> Iterator[Entry]:
    """The earliest entry of a name counts, so it comes last."""
    import json

    document = _table(json.loads(text))
    for block in ("develop", "default"):
        for name, entry in reversed(_table(document.get(block)).items()):
            yield Entry(name, str(_table(entry).get("version") or ""))


READERS = {"pyproject": pyproject_entries, "pipfile": pipfile_entries, "setup_py": setup_entries, "poetry.lock": poetry_lock, "Pipfile.lock": pipfile_lock}


def entries(files: DataFrame, key: str, kind: str = "kind", body: str = "text") -> DataFrame:
    """What each file declares, in order (``at``): the fields of ``Entry``. A bad or missing file gives one row with its error."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, what, text in zip(frame["k"], frame["kind"], frame["body"]):
                try:
                    out += [(name, n, *entry, None) for n, entry in enumerate(READERS[what](text))]
                except Exception as error:  # whatever is wrong with a file loses that file alone
                    out.append((name, -1, None, None, None, None, None, type(error).__name__))
            yield pd.DataFrame(out, columns=["k", "at", *Entry._fields, "error"])

    rows = files.select(F.col(key).cast("string").alias("k"), F.col(kind).alias("kind"), F.col(body).cast("string").alias("body"))
    return rows.mapInPandas(read, "k string, at int, entry string, specifier string, grp string, reason string, pins boolean, error string").withColumnRenamed("k", key)


def declared(files: DataFrame, key: str, kind: str = "kind", body: str = "text") -> DataFrame:
    """Dependencies of pyproject, Pipfile and setup.py files; the first mention of a name wins in a file."""
    found = with_requirement(entries(files, key, kind, body).where("error IS NULL"), F.when(F.col("specifier").isNull(), F.col("entry")), "line")
    spec, dynamic = F.col("specifier"), F.col("reason") == "dynamic_setup_py"
    stated = F.struct(
        F.when(dynamic, F.col("entry")).otherwise(normalised_name(F.col("entry"))).alias("name"),
        spec.alias("declared_specifier"),
        F.when(F.col("reason").isNull() & F.col("pins"), pep440_pin(spec)).alias("resolved_version"),
        F.col("reason"),
    )
    rows = found.withColumn("r", F.when(spec.isNull(), F.col("line")).otherwise(stated))
    first = Window.partitionBy(key, "r.name").orderBy("at")
    kept = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1 AND r.name <> ''")
    return kept.select(key, "r.name", "r.declared_specifier", "r.resolved_version", F.col("r.reason").alias("unassessable_reason"), F.col("grp").alias("dependency_group"))


def locked(files: DataFrame, key: str, kind: str = "kind", body: str = "text") -> DataFrame:
    """name, version of lockfiles: of a name that poetry.lock repeats the last counts, of Pipfile.lock the first exact pin."""
    version = F.when(F.col("pins"), pep440_pin(F.col("specifier"))).otherwise(F.col("specifier"))
    rows = entries(files, key, kind, body).where("error IS NULL").withColumn("version", version).where("version <> ''")
    return rows.groupBy(key, normalised_name(F.col("entry")).alias("name")).agg(F.max_by("version", "at").alias("version"))


def apply_lock(rows: DataFrame, locks: DataFrame, key: str) -> DataFrame:
    """A lockfile overrides a pin and never touches an unassessable row."""
    joined = rows.join(locks.withColumnRenamed("version", "__locked"), [key, "name"], "left")
    able = F.col("unassessable_reason").isNull()
    resolution = F.when(able & F.col("__locked").isNotNull(), "lockfile").when(able & F.col("resolved_version").isNotNull(), "pinned")
    return joined.withColumn("resolution", resolution).withColumn("resolved_version", F.when(able, F.coalesce("__locked", "resolved_version"))).drop("__locked")
