"""Parsed manifests and lockfiles, sinks written and read back, updates and listings as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Query
from ..functions import versions as ver
from ..operators import analytics, enrich, lifecycle
from ..session import kept, shared_path
from ..sources import pypi, sinks
from .analytics_queries import FLAGGED, flagged
from .fixtures import KEY, advisory, occurrence, scan_run, table, with_views
from .report_queries import q_history_rows
from .scoring_queries import KEYS, rolled_sql

STANDARD = """[project]
dependencies = ["Left_{p}>=1", "both==2.0"]
[project.optional-dependencies]
x = ["left.{p}==9", "opt~=1.1"]
"""
POETRY = """[tool.poetry.dependencies]
python = "^3"
G = {git = "https://h/{p}"}
V = {version = "==1.{p}"}
m = [{version = "<2"}, {version = ">=2"}]
n = 5
[tool.poetry.group.dev.dependencies]
t = "*"
g = "1"
"""
PIPFILE = """[packages]
q{p} = "==1.5"
w = {file = "https://h/{p}.zip"}
[dev-packages]
Q{p} = "*"
r = {version = ">1", extras = ["x"]}
"""
SETUP = """from setuptools import setup
BASE = ["a=={p}.0"]
setup(name="x", install_requires=BASE + ["b"], extras_require={"t": ["c>2"]}, tests_require=read(
    "t-{p}"), setup_requires="wheel")
"""
POETRY_LOCK = """[[package]]
name = "Left.{p}"
version = "1.4"
[[package]]
name = "LEFT-{p}"
version = "1.5"
"""
PIPFILE_LOCK = """{"default": {"q{p}": {"version": "==1.6"}, "r": {"version": ">=3"}},
 "develop": {"Q{p}": {"version": "==9"}, "r": {"version": "===3.1"}, "w": {"version": "==1"}}}"""


def _files(spark, sf_dir, *shapes: tuple[str | None, str | None]):
    """A file for each page: its kind and text by the id modulo the number of shapes, with the id put in."""
    at = (F.col("page_id") % len(shapes)).cast("int")
    pick = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), at)
    text = F.replace(pick(t for _, t in shapes), F.lit("{p}"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", pick(k for k, _ in shapes).alias("kind"), text.alias("text"))


def _declared(files):
    rows = pypi.declared(files, "page_id")
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "name", "declared_specifier", "resolved_version", "unassessable_reason", "dependency_group")


def q_pyproject(spark, sf_dir):
    """The standard table, Poetry's tables, a file that is no TOML, and one without text."""
    return _declared(_files(spark, sf_dir, ("pyproject", STANDARD), ("pyproject", POETRY), ("pyproject", "= ={p}"), ("pyproject", None)))


def q_pipfile(spark, sf_dir):
    return _declared(_files(spark, sf_dir, ("pipfile", PIPFILE), ("pipfile", "[packages")))


def q_setup(spark, sf_dir):
    return _declared(_files(spark, sf_dir, ("setup_py", SETUP), ("setup_py", "def (:"), ("setup_py", "print({p})")))


def q_locked(spark, sf_dir):
    rows = pypi.declared(_files(spark, sf_dir, ("pyproject", STANDARD), ("pipfile", PIPFILE)), "page_id")
    locks = pypi.locked(_files(spark, sf_dir, ("poetry.lock", POETRY_LOCK), ("Pipfile.lock", PIPFILE_LOCK)), "page_id")
    return pypi.apply_lock(rows, locks, "page_id").select(F.col("page_id").cast("long").alias("page_id"), "name", "resolved_version", "resolution", "unassessable_reason")


def q_release_dates(spark, sf_dir):
    """The latest version's time, one that is absent, one that is no time, no version's time at all, and no times."""
    k = (F.col("p_partkey") % 5).cast("int")
    time = lambda *pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    first, meta = ("1.0", "2020-01-02T00:00:00.000Z"), ("modified", "2024-01-01T00:00:00Z")
    times = F.get(F.array(time(first, ("2.0", "2021-03-04T05:00:00Z"), meta), time(first, ("1.5", "2020-06-07T00:00:00+02:00"), meta), time(first, ("2.0", "soon"), meta), time(meta), F.lit(None).cast("map<string,string>")), k)
    found = ver.latest_release_time(times, F.lit("2.0"), F.array(F.lit("1.0"), F.lit("1.5"), F.lit("2.0")))
    return table(spark, sf_dir, "part").select("p_partkey", F.date_format(found, "yyyy-MM-dd HH:mm").alias("released"))


def q_answers(spark, sf_dir):
    """Each word of a name with the answer to it, by place."""
    words = F.split("p_name", " ")
    pairs = enrich.answered(words, F.transform(words, F.length))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(pairs).alias("at", "x"))
    return rows.select("p_partkey", (F.col("at") + 1).alias("position"), F.col("x.question").alias("word"), F.col("x.answer").alias("length"))


def q_reported(spark, sf_dir):
    """Occurrences with the newest report on them; every third line has two, and one on its whole scan."""
    rows = occurrence(spark, sf_dir, named=False)
    one = rows.where("line_no % 3 = 0").select(*KEY, F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    reports = one.select(
        *KEY,
        F.concat_ws("-", F.lit("r"), "scan_id", "n").alias("report_id"),
        F.when(F.col("n") == 3, "combined").otherwise("per_dependency").alias("report_type"),
        F.date_add(F.lit("2001-01-01").cast("date"), F.when(F.col("scan_id") % 2 == 0, F.col("n")).otherwise(-F.col("n"))).alias("created_on"),
        F.when((F.col("scan_id") + F.col("n")) % 2 == 0, "completed").otherwise("failed").alias("status"),
        F.when((F.col("scan_id") + F.col("n")) % 2 == 0, F.lit("2001-02-03").cast("date")).alias("generated_on"),
    )
    found = analytics.with_report(rows.select(*KEY), reports, *KEY)
    return found.select(*KEY, "report.report_id", "report.status", F.date_format("report.generated_on", "yyyy-MM-dd").alias("generated_on"))


def q_listed(spark, sf_dir):
    """Scans of a repository, occurrences of a scan and advisories of an occurrence in their default orders."""
    line = F.concat_ws("/", *KEY)
    parts = (
        ("scan", scan_run(spark, sf_dir), F.col("repository_id").cast("string"), F.col("scan_id").cast("string")),
        ("occurrence", occurrence(spark, sf_dir), F.col("scan_id").cast("string"), line),
        ("advisory", advisory(spark, sf_dir), line, F.col("osv_id")),
    )
    found = [analytics.listed(rows.withColumns({"parent": parent, "row": row}), kind, "parent").select(F.lit(kind).alias("kind"), "parent", "row", "position") for kind, rows, parent, row in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


def q_updated(spark, sf_dir):
    """Counts of completed scans written over the stored ones, twice; a count of none is written as null."""
    stored = scan_run(spark, sf_dir).select("scan_id", F.lit(-1).cast("long").alias("flagged_count"), F.col("status").alias("counted"))
    done = scan_run(spark, sf_dir).where("status = 'completed'").select("scan_id")
    # Counted before they meet their scans: a row a scan is joined, not its lines, and once for both updates.
    counts = kept(analytics.scan_counts(flagged(spark, sf_dir, named=False)).select("scan_id", "flagged_count").join(done, "scan_id", "left_semi"), "counts")
    fresh = counts.select("scan_id", F.nullif("flagged_count", F.lit(0)).alias("flagged_count"), F.lit("yes").alias("counted"))
    return lifecycle.updated(lifecycle.updated(stored, fresh, "scan_id"), fresh, "scan_id")


def q_history_appended(spark, sf_dir):
    """The permanent history as read back after its appends: a row a scan, and the rows of its occurrences."""
    path, rows = shared_path(spark, "history"), occurrence(spark, sf_dir, named=False).select(*KEY)
    lifecycle.append_history(q_history_rows(spark, sf_dir), f"{path}/scans")
    scans = spark.read.parquet(f"{path}/scans")
    # All lines meet their scans once, whatever the number of appends.
    met = kept(rows.join(scans.select("scan_id", "data_source"), "scan_id"), "lines")
    for source in ("live_scan", "corpus_scan"):
        lifecycle.append_history(met.where(F.col("data_source") == source), f"{path}/occurrences")
    counts = spark.read.parquet(f"{path}/occurrences").groupBy("scan_id").agg(F.count("*").alias("dependency_count"))
    return scans.join(counts, "scan_id", "left").select("scan_id", "full_name", "data_source", "score_cents", F.coalesce("dependency_count", F.lit(0)).alias("dependency_count"))


def q_panel_files(spark, sf_dir):
    """The CSV panel as read back from its files; one of three reasons holds quotes, a comma and a line end."""
    reason = F.when(F.col("line_no") == 2, F.concat("deprecation_reason", F.lit(', "so"\nit is'))).otherwise(F.col("deprecation_reason"))
    rows = occurrence(spark, sf_dir).select(*KEY, "is_deprecated", reason.alias("reason"), "staleness_days")
    path = shared_path(spark, "panel")
    sinks.write_panel(rows, path)
    return sinks.read_panel(spark, path, *rows.columns)


def _rows_sql(where: str, *rows: tuple) -> str:
    """A branch for pages ``where``: name, specifier, version, reason, group, with {p} for the page."""
    cell = lambda v: "NULL" if v is None else "'" + v + "'"
    values = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    put = ", ".join(f"replace({c}, '{{p}}', page_id::VARCHAR) AS {c}" for c in ("name", "declared_specifier", "resolved_version"))
    return f"SELECT page_id, {put}, unassessable_reason, dependency_group FROM pages, (VALUES {values}) AS v(name, declared_specifier, resolved_version, unassessable_reason, dependency_group) WHERE {where}"


_STANDARD_ROWS = (("left-{p}", ">=1", None, None, "runtime"), ("both", "==2.0", "2.0", None, "runtime"), ("opt", "~=1.1", None, None, "optional"))
_POETRY_ROWS = (("g", "git = https://h/{p}", None, "vcs_specifier", "runtime"), ("v", "==1.{p}", "1.{p}", None, "runtime"), ("m", "<2 || >=2", None, None, "runtime"), ("t", "*", None, None, "development"))
_PIPFILE_ROWS = (("q{p}", "==1.5", "1.5", None, "runtime"), ("w", "file = https://h/{p}.zip", None, "url_specifier", "runtime"), ("r", ">1", None, None, "development"))
_SETUP_ROWS = (
    ("a", "=={p}.0", "{p}.0", None, "runtime"), ("b", "", None, None, "runtime"), ("c", ">2", None, None, "optional"),
    ("setup.py:tests_require", 'read( "t-{p}")', None, "dynamic_setup_py", "development"), ("setup.py:setup_requires", '"wheel"', None, "dynamic_setup_py", "build"),
)
_LOCKED = (("left-{p}", "1.5", "lockfile", None), ("both", "2.0", "pinned", None), ("opt", None, None, None)), (("q{p}", "1.6", "lockfile", None), ("w", None, None, "url_specifier"), ("r", "3.1", "lockfile", None))


def _locked_sql(remainder: int) -> str:
    rows = (_rows_sql(f"page_id % 2 = {remainder}", *[(name, None, version, reason, resolution) for name, version, resolution, reason in _LOCKED[remainder]]),)
    return f"SELECT page_id, name, resolved_version, dependency_group AS resolution, unassessable_reason FROM ({rows[0]})"


QUERIES = {
    "pyproject_rows": Query(q_pyproject, _rows_sql("page_id % 4 = 0", *_STANDARD_ROWS) + " UNION ALL " + _rows_sql("page_id % 4 = 1", *_POETRY_ROWS), "TVF14 TVF19"),
    "pipfile_rows": Query(q_pipfile, _rows_sql("page_id % 2 = 0", *_PIPFILE_ROWS), "TVF15"),
    "setup_rows": Query(q_setup, _rows_sql("page_id % 3 = 0", *_SETUP_ROWS), "TVF16"),
    "locked_requirements": Query(q_locked, f"{_locked_sql(0)} UNION ALL {_locked_sql(1)}", "TVF17 TVF18 J16"),
    "release_dates": Query(
        q_release_dates, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '2021-03-04 05:00' WHEN 1 THEN '2020-06-06 22:00' WHEN 2 THEN '2020-01-02 00:00' END AS released FROM part", "FN26 FN17"
    ),
    "answers_by_place": Query(
        q_answers,
        """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part), n AS (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM w)
SELECT p_partkey, i::INT AS position, words[i] AS word, length(words[i])::INT AS length FROM n""",
        "J18",
    ),
    "reported_occurrences": Query(
        q_reported,
        with_views(f"""r AS (SELECT {KEYS}, 'r-' || scan_id || '-' || n AS report_id, CASE n WHEN 3 THEN 'combined' ELSE 'per_dependency' END AS report_type,
  CASE WHEN scan_id % 2 = 0 THEN n ELSE -n END AS age, CASE WHEN (scan_id + n) % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN (scan_id + n) % 2 = 0 THEN '2001-02-03' END AS generated_on
  FROM occurrence, (VALUES (1), (2), (3)) AS v(n) WHERE line_no % 3 = 0),
newest AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY age DESC, report_id DESC) AS place FROM r WHERE report_type = 'per_dependency')
SELECT {KEYS}, report_id, status, generated_on FROM occurrence LEFT JOIN (SELECT * FROM newest WHERE place = 1) USING ({KEYS})""", "occurrence"),
        "J04",
    ),
    "default_orders": Query(
        q_listed,
        with_views(f"""named AS (SELECT *, scan_id || '/' || part_id || '/' || supp_id || '/' || line_no AS line FROM occurrence)
SELECT 'scan' AS kind, repository_id::VARCHAR AS parent, scan_id::VARCHAR AS row, row_number() OVER (PARTITION BY repository_id ORDER BY created_on DESC, scan_id DESC)::INT AS position FROM scan_run
UNION ALL SELECT 'occurrence', scan_id::VARCHAR, line, row_number() OVER (PARTITION BY scan_id ORDER BY manifest_path, package_name, part_id, supp_id, line_no)::INT FROM named
UNION ALL SELECT 'advisory', scan_id || '/' || part_id || '/' || supp_id || '/' || line_no, osv_id, row_number() OVER (PARTITION BY {KEYS} ORDER BY osv_id, i)::INT FROM advisory""", "scan_run", "occurrence", "advisory"),
        "T11",
    ),
    "counts_updated": Query(
        q_updated,
        with_views(FLAGGED + """,
counts AS (SELECT scan_id, count(*) FILTER (WHERE is_flagged) AS n FROM flagged GROUP BY scan_id)
SELECT scan_id, CASE WHEN n IS NOT NULL AND status = 'completed' THEN nullif(n, 0) ELSE -1 END AS flagged_count, CASE WHEN n IS NOT NULL AND status = 'completed' THEN 'yes' ELSE status END AS counted
FROM scan_run LEFT JOIN counts USING (scan_id)""", "scan_run", "occurrence"),
        "SNK02",
    ),
    "history_appended": Query(
        q_history_appended,
        with_views(
            rolled_sql("'v2'", "SELECT scan_id, 'v2' AS used_version FROM scan_run")
            + """,
own AS (SELECT scan_id, count(*) AS dependency_count FROM occurrence GROUP BY scan_id)
SELECT scan_id, full_name, data_source, score_cents, coalesce(dependency_count, 0) AS dependency_count FROM rolled JOIN scan_run USING (scan_id) JOIN repository USING (repository_id) LEFT JOIN own USING (scan_id) WHERE status = 'completed'""",
            "scan_run", "occurrence", "repository",
        ),
        "SNK03",
    ),
    "panel_files": Query(
        q_panel_files,
        with_views("SELECT " + ", ".join(f"{k}::VARCHAR AS {k}" for k in KEY) + """, CASE WHEN is_deprecated THEN 'True' ELSE 'False' END AS is_deprecated,
  coalesce(CASE WHEN line_no = 2 THEN deprecation_reason || ', "so"' || chr(10) || 'it is' ELSE deprecation_reason END, '') AS reason, coalesce(staleness_days::VARCHAR, '') AS staleness_days FROM occurrence""", "occurrence"),
        "SNK05",
    ),
}
