"""Scalar functions, version order and manifest rules as queries over derived inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Query
from ..functions import advisories as adv
from ..functions import text as tx
from ..functions import versions as ver
from ..session import shared_path
from ..sources import npm, paths, pypi
from .fixtures import KEY, occurrence, table, with_views
from .scoring_queries import KEYS

_VECTOR = "CONCAT('CVSS:3.1/AV:', substr('NALP', 1 + {k} % 4, 1), '/AC:', substr('LH', 1 + {k} // 4 % 2, 1), '/PR:', substr('NLH', 1 + {k} // 8 % 3, 1), '/UI:', substr('NR', 1 + {k} // 24 % 2, 1), '/S:', substr('UC', 1 + {k} // 48 % 2, 1), '/C:', substr('HLN', 1 + {k} // 96 % 3, 1), '/I:', substr('HLN', 1 + {k} // 288 % 3, 1), '/A:', substr('HLN', 1 + {k} // 864 % 3, 1))"


def q_cvss(spark, sf_dir):
    k = F.expr("CAST(event_id AS INT)")
    letters = [("AV", "NALP", 1), ("AC", "LH", 4), ("PR", "NLH", 8), ("UI", "NR", 24), ("S", "UC", 48), ("C", "HLN", 96), ("I", "HLN", 288), ("A", "HLN", 864)]
    pieces = [F.concat(F.lit(f"{name}:"), F.substring(F.lit(options), (F.floor(k / step) % len(options) + 1).cast("int"), F.lit(1))) for name, options, step in letters]
    vector = F.when(k % 97 == 0, "CVSS:4.0/AV:N").otherwise(F.concat_ws("/", F.lit("CVSS:3.1"), *pieces))
    return table(spark, sf_dir, "events").select("event_id", vector.alias("vector")).withColumn("cvss", adv.cvss3(F.col("vector"))).withColumn("severity", adv.bucket(F.col("cvss")))


CVSS_SQL = f"""
WITH v AS (SELECT event_id, event_id::INT AS k, CASE WHEN event_id % 97 = 0 THEN 'CVSS:4.0/AV:N' ELSE {_VECTOR.format(k='event_id::INT')} END AS vector FROM events),
m AS (SELECT *, [0.85, 0.62, 0.55, 0.2][1 + k % 4]::DOUBLE AS av, [0.77, 0.44][1 + k // 4 % 2]::DOUBLE AS ac,
  CASE WHEN k // 48 % 2 = 1 THEN [0.85, 0.68, 0.5][1 + k // 8 % 3] ELSE [0.85, 0.62, 0.27][1 + k // 8 % 3] END::DOUBLE AS pr, [0.85, 0.62][1 + k // 24 % 2]::DOUBLE AS ui,
  k // 48 % 2 = 1 AS changed,
  1::DOUBLE - (1::DOUBLE - [0.56, 0.22, 0.0][1 + k // 96 % 3]::DOUBLE) * (1::DOUBLE - [0.56, 0.22, 0.0][1 + k // 288 % 3]::DOUBLE) * (1::DOUBLE - [0.56, 0.22, 0.0][1 + k // 864 % 3]::DOUBLE) AS loss FROM v),
i AS (SELECT *, CASE WHEN changed THEN 7.52::DOUBLE * (loss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(loss - 0.02::DOUBLE, 15.0) ELSE 6.42::DOUBLE * loss END AS impact, 8.22::DOUBLE * av * ac * pr * ui AS ease FROM m),
r AS (SELECT *, round_even(least(CASE WHEN changed THEN 1.08::DOUBLE * (impact + ease) ELSE impact + ease END, 10.0::DOUBLE) * 100000, 0)::BIGINT AS whole FROM i),
s AS (SELECT event_id, vector, CASE WHEN k % 97 = 0 THEN NULL WHEN impact <= 0 THEN 0.0::DOUBLE WHEN whole % 10000 = 0 THEN whole / 100000.0::DOUBLE ELSE (whole // 10000 + 1) / 10.0::DOUBLE END AS cvss FROM r)
SELECT event_id, vector, cvss, CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' WHEN cvss >= 0 THEN 'low' END AS severity FROM s"""


def q_semver_latest(spark, sf_dir):
    return ver.latest(occurrence(spark, sf_dir).select("ecosystem", "package_name", F.col("resolved_version").alias("version")), "npm", "ecosystem", "package_name")


def q_behind(spark, sf_dir):
    """npm triples, and PyPI versions of two parts, after a release, before one, or of three; the seventh line's is unknown."""
    v, kind = F.col("resolved_version"), F.col("line_no") % 4
    spelled = F.when(kind == 0, F.substring_index(v, ".", 2)).when(kind == 1, F.concat(v, F.lit(".post1"))).when(kind == 2, F.concat(v, F.lit("rc1"))).otherwise(v)
    version = F.when(F.col("line_no") == 7, "unknown").when(F.col("ecosystem") == "npm", v).otherwise(spelled)
    rows = occurrence(spark, sf_dir, named=False).select("scan_id", "ecosystem", "part_id", "line_no", version.alias("resolved")).distinct()
    path = shared_path(spark, "resolved")
    rows.write.parquet(path)
    own = spark.read.parquet(path)
    releases = ver.with_release(own.select("ecosystem", "part_id", F.col("resolved").alias("version")).distinct(), "version", "ecosystem").where("stable")
    # Versions of the neighbouring parts of a package are its published releases here.
    near = releases.select("ecosystem", F.explode(F.sequence(F.col("part_id") - 2, F.col("part_id") + 2)).alias("part_id"), "falling", "stable")
    return ver.behind(own, near, "ecosystem", "part_id")


def q_pep440_order(spark, sf_dir):
    """Versions of several spellings, ranked inside each event type; equal versions share a rank."""
    from pyspark.sql.window import Window

    e = F.col("event_id")
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".dev1", "a1", "b2", "rc1", "", ".post1")]), (e % 6 + 1).cast("int"))
    version = F.concat((e % 7).cast("string"), F.lit("."), (F.floor(e / 7) % 5).cast("string"), F.when(e % 2 == 0, ".0").otherwise(""), suffix)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", version.alias("version"))
    # Only distinct versions are parsed and ranked; a window over all events would be as many tasks as types.
    keyed = rows.select("event_type", "version").distinct().withColumn("key", ver.pep440(F.col("version")))
    ranked = keyed.withColumn("rank", F.dense_rank().over(Window.partitionBy("event_type").orderBy("key"))).drop("key")
    return rows.join(ranked, ["event_type", "version"])


def q_pep503(spark, sf_dir):
    return occurrence(spark, sf_dir).select("package_name").distinct().select("package_name", ver.normalised_name(F.col("package_name")).alias("normalised"))


_SPECS = ("^1.2.3", "file:../x", "link:x", "workspace:*", "git+https://h/x", "github:o/r", "o/r#main", "https://h/x.tgz", "npm:y@1", "", " =1.2.3 ", "@scope/name")
_REASONS = (None, "file_specifier", "link_specifier", "workspace_specifier", "git_specifier", "github_specifier", "github_specifier", "url_specifier", "alias_specifier", None, None, None)


def q_specifiers(spark, sf_dir):
    spec = F.element_at(F.array(*map(F.lit, _SPECS)), (F.col("p_partkey") % len(_SPECS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", spec.alias("specifier")).withColumn("reason", npm.specifier_class(F.col("specifier"))).withColumn("pinned", ver.semver_pin(F.col("specifier")))


def q_staleness(spark, sf_dir):
    now, seen = F.to_timestamp(F.lit("2002-01-01 06:00:00")), F.col("l_shipdate").cast("timestamp")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", tx.staleness_days(seen, now).alias("staleness_days"))


_DEPRECATED = ('{"deprecated": "use b"}', '{"deprecated": true}', '{"deprecated": 0}', '{"deprecated": ""}', '{"deprecated": false}', '{"deprecated": null}', "{}")


def q_deprecation(spark, sf_dir):
    body = F.element_at(F.array(*map(F.lit, _DEPRECATED)), (F.col("p_partkey") % len(_DEPRECATED) + 1).cast("int"))
    found = tx.npm_deprecation(F.try_variant_get(F.try_parse_json(body), "$.deprecated", "variant"))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("d")).select("p_partkey", "d.is_deprecated", "d.reason")


def q_redact(spark, sf_dir):
    token = F.concat(F.lit("ghp_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 20))
    text = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, token), F.lit("end"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact(text).alias("text"))


def q_chunk_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.chunk_id(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("chunk_id"))


def q_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"), tx.table_cell(F.concat("url", F.lit("|x\ny"))).alias("cell"))


def q_listed(spark, sf_dir):
    words = F.sort_array(F.collect_set("p_type"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(tx.listed(words).alias("types"))


def q_relative(spark, sf_dir):
    """Labels as seen at a moment that is from zero to ten days after each event."""
    ts = F.col("ts").cast("timestamp")
    later = ts + F.make_dt_interval(secs=(F.pow(F.col("event_id") % 930, F.lit(2)) + F.lit(0.25)).cast("decimal(18,6)"))
    return table(spark, sf_dir, "events").select("event_id", tx.relative_time(ts, later).alias("label"), tx.utc_stamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("stamp"))


def q_repo_links(spark, sf_dir):
    forms = F.array(
        F.concat(F.lit("https://github.com/"), "c_mktsegment", F.lit("/r"), F.col("c_custkey").cast("string")),
        F.concat(F.lit("git@github.com:"), "c_mktsegment", F.lit("/r"), F.col("c_custkey").cast("string"), F.lit(".git")),
        F.concat("c_mktsegment", F.lit("/r"), F.col("c_custkey").cast("string")),
        F.concat(F.lit("github.com/"), "c_mktsegment", F.lit("/r"), F.col("c_custkey").cast("string"), F.lit("/tree/main")),
        F.concat(F.lit("https://example.org/"), "c_mktsegment", F.lit("/r")),
    )
    link = F.element_at(forms, (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.repository_of(link).alias("r")).select("c_custkey", "r.owner", "r.name")


def q_access(spark, sf_dir):
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tx.access_level(F.when(c % 4 == 0, "Me").otherwise("other"), F.lit("me"), c % 4 == 1, c % 4 == 2).alias("access_level")
    )


def q_epss(spark, sf_dir):
    text = F.when(F.col("event_id") % 11 == 0, "n/a").when(F.col("event_id") % 13 == 0, "1.5").otherwise(F.concat(F.lit("0."), F.lpad((F.col("event_id") * 37 % 1000000).cast("string"), 6, "0")))
    return table(spark, sf_dir, "events").select("event_id", (adv.probability(text) * 100000).cast("long").alias("epss_e5"))


_PATHS = ("package.json", "web/package.json", "requirements-dev.txt", "requirements-devops.txt", "dev-requirements.txt", "requirements/prod.txt", "node_modules/a/package.json", "docs/notes.txt", "requirements.in", "yarn.lock", "a/b/setup.py", "vendor/x/pyproject.toml", "third_party/x/package.json", "bower_components/x/package.json", "Requirements/prod.TXT")
_OWNERS = ("npm", "npm", "pypi", "pypi", "pypi", "pypi", None, None, None, None, "pypi", None, "npm", None, "pypi")
_GROUPS = ("runtime", "runtime", "development", "runtime", "development", *["runtime"] * 10)


def q_vendor_paths(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("page_id") % len(_PATHS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", "path", paths.adapter(F.col("path")).alias("adapter"), paths.requirements_group(F.col("path")).alias("dependency_group"))


_NAMES = ("package.json", "package-lock.json", "npm-shrinkwrap.json", "pyproject.toml", "poetry.lock", "Pipfile", "Pipfile.lock", "requirements.txt", "README.md")


def _tree(spark, sf_dir):
    p = F.col("page_id")
    folder = F.concat(F.lit("d"), (p % 7).cast("string"), F.when(p % 3 == 0, F.concat(F.lit("/e"), (p % 4).cast("string"))).otherwise(""))
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.floor(p / 7) % len(_NAMES) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select(F.explode(F.array(p % 5, p % 2)).alias("scan_id"), F.concat_ws("/", folder, name).alias("path")).distinct()
    entry = F.struct("path", F.lit("blob").alias("type"), F.lit("s").alias("sha"), F.lit(1).alias("size"))
    bodies = rows.select("scan_id", F.to_json(F.struct(F.lit(False).alias("truncated"), F.array(entry).alias("tree"))).alias("body"))
    return paths.tree_entries(bodies, "body", "scan_id")


def q_plan(spark, sf_dir):
    return paths.plan(_tree(spark, sf_dir)).select("scan_id", "position", "ecosystem", "path", "lockfile_path", "kind")


PLAN_SQL = f"""
WITH tree AS (SELECT DISTINCT unnest([page_id % 5, page_id % 2]) AS scan_id, 'd' || (page_id % 7) || CASE WHEN page_id % 3 = 0 THEN '/e' || (page_id % 4) ELSE '' END AS folder,
    [{', '.join(f"'{n}'" for n in _NAMES)}][1 + page_id // 7 % {len(_NAMES)}] AS name FROM pages),
owned AS (SELECT *, CASE name WHEN 'package.json' THEN 'npm' ELSE 'pypi' END AS ecosystem,
    row_number() OVER (PARTITION BY scan_id ORDER BY len(string_split(folder, '/')), folder || '/' || name)::INT AS position FROM tree WHERE name IN ('package.json', 'pyproject.toml', 'Pipfile', 'requirements.txt')),
here AS (SELECT scan_id, folder, list(name) AS names FROM tree GROUP BY ALL)
SELECT o.scan_id, position, o.ecosystem, o.folder || '/' || name AS path,
       CASE WHEN name = 'package.json' AND list_contains(names, 'npm-shrinkwrap.json') THEN o.folder || '/npm-shrinkwrap.json' WHEN name = 'package.json' AND list_contains(names, 'package-lock.json') THEN o.folder || '/package-lock.json'
            WHEN name = 'pyproject.toml' AND list_contains(names, 'poetry.lock') THEN o.folder || '/poetry.lock' WHEN name = 'Pipfile' AND list_contains(names, 'Pipfile.lock') THEN o.folder || '/Pipfile.lock' END AS lockfile_path,
       CASE name WHEN 'package.json' THEN 'package_json' WHEN 'Pipfile' THEN 'pipfile' WHEN 'requirements.txt' THEN 'requirements' ELSE 'pyproject' END AS kind
FROM owned o JOIN here USING (scan_id, folder) WHERE position <= 50"""


def q_skipped(spark, sf_dir):
    """Every third planned manifest counts as malformed."""
    tree = _tree(spark, sf_dir)
    planned = paths.plan(tree)
    return paths.skipped(tree, planned, planned.where("position % 3 = 0")).select("scan_id", F.col("skipped_manifest_count").cast("long").alias("skipped"))


def q_workspace_lists(spark, sf_dir):
    p = F.col("page_id")
    body = F.element_at(F.array(*map(F.lit, ('{"workspaces": ["a/*", 1, "b"]}', '{"workspaces": {"packages": ["c"]}}', '{"workspaces": "x"}', "{}", "[]"))), (p % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.coalesce(paths.workspace_globs(F.try_parse_json(body)), F.array().cast("array<string>")), "|").alias("globs"))


def q_packuments(spark, sf_dir):
    p = F.col("p_partkey")
    url = F.concat(F.lit("https://host/r"), p.cast("string"))
    repository = F.when(p % 3 == 0, F.concat(F.lit('"'), url, F.lit('"'))).when(p % 3 == 1, F.concat(F.lit('{"url": "'), url, F.lit('"}'))).otherwise("7")
    body = F.concat(F.lit('{"dist-tags": {"latest": "1.'), (p % 9).cast("string"), F.lit('.0"}, "versions": {"1.0.0": {}, "2.0.0": {"deprecated": "x"}}, "time": {"1.0.0": "2020-01-02"}, "repository": '), repository, F.lit("}"))
    found = npm.packument(F.try_parse_json(body))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("d")).select("p_partkey", "d.latest", F.size("d.versions").alias("n_versions"), F.element_at("d.times", F.lit("1.0.0")).alias("first_time"), F.when(p % 3 != 2, F.col("d.repository")).alias("repository"))


def q_osv_ecosystems(spark, sf_dir):
    return occurrence(spark, sf_dir, named=False).select("ecosystem", adv.osv_ecosystem(F.col("ecosystem")).alias("osv_name")).distinct()


def q_workspace_globs(spark, sf_dir):
    p = F.col("page_id")
    folder = F.element_at(F.array(*map(F.lit, ("packages/a", "packages/a/b", "packages/x", "", "apps/web"))), (p % 5 + 1).cast("int"))
    globs = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in (["packages/*"], ["packages/**"], ["packages/*", "!packages/x"], ["apps/*", "packages/a"], ["packages/?"], ["./packages/*"])]), (F.floor(p / 5) % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(paths.workspace_match(folder, globs), F.lit(False)).alias("member"))


_LINES = ('Django==4.2 ; python_version>"3.8"', "zope.interface[test]>=5", "-r base.txt", "-e .", "-e git+https://h/p.git#egg=My_Pkg", "pkg @ https://h/p.whl", "a==1.*", "# only a comment", "b_c == 2.0.1  # note")


def q_requirements(spark, sf_dir):
    p = F.col("page_id")
    one = lambda shift: F.element_at(F.array(*map(F.lit, _LINES)), ((p + shift) % len(_LINES) + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("requirements"), F.when(p % 2 == 0, "-dev").otherwise(""), F.lit(".txt")).alias("path"), F.concat_ws("\n", one(0), one(1), one(2)).alias("text"))
    return pypi.requirements(files, "page_id").select("page_id", "name", "declared_specifier", "resolved_version", "unassessable_reason", "dependency_group")


REQUIREMENTS_SQL = """
WITH lines(n, name, spec, pin, reason) AS (VALUES (0, 'django', '==4.2', '4.2', NULL), (1, 'zope-interface', '>=5', NULL, NULL), (4, 'my-pkg', 'git+https://h/p.git#egg=My_Pkg', NULL, 'vcs_specifier'),
  (5, 'pkg', 'https://h/p.whl', NULL, 'url_specifier'), (6, 'a', '==1.*', NULL, NULL), (8, 'b-c', '== 2.0.1', '2.0.1', NULL)),
files AS (SELECT page_id, unnest([page_id % 9, (page_id + 1) % 9, (page_id + 2) % 9]) AS n FROM pages)
SELECT page_id, name, spec AS declared_specifier, pin AS resolved_version, reason AS unassessable_reason, CASE WHEN page_id % 2 = 0 THEN 'development' ELSE 'runtime' END AS dependency_group
FROM files JOIN lines USING (n)"""


def q_package_json(spark, sf_dir):
    p = F.col("page_id").cast("string")
    body = F.concat(F.lit('{"dependencies": {"left-'), p, F.lit('": "^1.0.0", "both": "1.2.3"}, "devDependencies": {"both": "9.9.9", "odd": 5, "@s/p": "file:../x"}, "x": 1}'))
    files = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 10 == 0, "not json").otherwise(body).alias("body"))
    locks = files.select("page_id", F.concat(F.lit('{"packages": {"": {}, "node_modules/both": {"version": "1.2.4"}, "node_modules/q/node_modules/odd": {"version": "2.0.0"}, "node_modules/r/node_modules/odd": {"version": "10.0.0"}}, "dependencies": {"left-'), p, F.lit('": {"version": "1.0.7"}}}')).alias("body"))
    return npm.resolve(npm.declared(files, "page_id"), npm.locked(locks, "page_id"), "page_id").select("page_id", "name", "declared_specifier", "dependency_group", "unassessable_reason", "resolved_version", "resolution")


PACKAGE_JSON_SQL = """
WITH rows(name, spec, grp, reason, version, resolution) AS (VALUES ('both', '1.2.3', 'runtime', NULL, '1.2.4', 'lockfile'), ('odd', '', 'development', NULL, '10.0.0', 'lockfile'),
  ('@s/p', 'file:../x', 'development', 'file_specifier', NULL, NULL), ('left', '^1.0.0', 'runtime', NULL, '1.0.7', 'lockfile'))
SELECT page_id, CASE name WHEN 'left' THEN 'left-' || page_id ELSE name END AS name, spec AS declared_specifier, grp AS dependency_group, reason AS unassessable_reason, version AS resolved_version, resolution
FROM pages, rows WHERE page_id % 10 <> 0"""


def _cases(column: str, values) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {n} THEN '{v}'" for n, v in enumerate(values) if v is not None) + " END"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_TRIPLE = "CAST(string_split({v}, '.')[1] AS INT) AS a, CAST(string_split({v}, '.')[2] AS INT) AS b, CAST(string_split({v}, '.')[3] AS INT) AS c"
QUERIES = {
    "cvss_from_vector": Query(q_cvss, CVSS_SQL, "FN10 FN11"),
    "semver_latest": Query(
        q_semver_latest,
        with_views(f"""triples AS (SELECT ecosystem, package_name, resolved_version, {_TRIPLE.format(v='resolved_version')} FROM occurrence)
SELECT ecosystem, package_name, arg_max(resolved_version, (a, b, c)) AS latest_version FROM triples GROUP BY ALL""", "occurrence"),
        "FN01 FN02 FN08",
    ),
    "versions_behind": Query(
        q_behind,
        with_views(f"""rows AS (SELECT *, CASE WHEN line_no = 7 THEN 'unknown' WHEN ecosystem = 'npm' OR line_no % 4 = 3 THEN resolved_version WHEN line_no % 4 = 0 THEN regexp_replace(resolved_version, '[.][0-9]+$', '')
    WHEN line_no % 4 = 1 THEN resolved_version || '.post1' ELSE resolved_version || 'rc1' END AS resolved,
    CASE WHEN line_no <> 7 THEN string_split(resolved_version, '.')[1]::INT END AS x, string_split(resolved_version, '.')[2]::INT AS y,
    CASE WHEN ecosystem = 'pypi' AND line_no % 4 = 0 THEN 0 ELSE string_split(resolved_version, '.')[3]::INT END AS z FROM occurrence),
releases AS (SELECT DISTINCT ecosystem AS e, part_id AS other, x AS a, y AS b, z AS c FROM rows WHERE line_no <> 7 AND NOT (ecosystem = 'pypi' AND line_no % 4 = 2)),
own AS (SELECT DISTINCT scan_id, ecosystem, part_id, line_no, resolved, x, y, z FROM rows)
SELECT scan_id, ecosystem, part_id, line_no, resolved, count(DISTINCT a) FILTER (WHERE a > x) AS behind_major, count(DISTINCT b) FILTER (WHERE a = x AND b > y) AS behind_minor,
       count(DISTINCT c) FILTER (WHERE a = x AND b = y AND c > z) AS behind_patch FROM own LEFT JOIN releases ON e = ecosystem AND other BETWEEN part_id - 2 AND part_id + 2 GROUP BY ALL""", "occurrence"),
        "FN09",
    ),
    "pep440_order": Query(
        q_pep440_order,
        """SELECT event_id, event_type, (event_id % 7) || '.' || (event_id // 7 % 5) || CASE WHEN event_id % 2 = 0 THEN '.0' ELSE '' END || ['.dev1', 'a1', 'b2', 'rc1', '', '.post1'][1 + event_id % 6] AS version,
dense_rank() OVER (PARTITION BY event_type ORDER BY event_id % 7, CASE WHEN event_id // 7 % 5 = 0 THEN -1 ELSE event_id // 7 % 5 END, event_id % 6)::INT AS rank FROM events""",
        "FN04 FN05",
    ),
    "pep503_names": Query(
        q_pep503, with_views("SELECT DISTINCT package_name, lower(regexp_replace(trim(package_name), '[-_.]+', '-', 'g')) AS normalised FROM occurrence", "occurrence"), "FN07"
    ),
    "specifier_class": Query(
        q_specifiers,
        f"SELECT p_partkey, {_list(_SPECS)}[1 + p_partkey % 12] AS specifier, {_cases('p_partkey % 12', _REASONS)} AS reason, CASE WHEN p_partkey % 12 = 10 THEN '1.2.3' END AS pinned FROM part",
        "TVF09 FN03",
    ),
    "staleness_days": Query(
        q_staleness,
        "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(0, floor((epoch(TIMESTAMP '2002-01-01 06:00:00') - epoch(l_shipdate)) / 86400))::INT AS staleness_days FROM lineitem",
        "FN17 FN18",
    ),
    "deprecation_composite": Query(
        q_deprecation, "SELECT p_partkey, p_partkey % 7 < 4 AS is_deprecated, CASE p_partkey % 7 WHEN 0 THEN 'use b' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '' END AS reason FROM part", "FN23"
    ),
    "redact_documents": Query(
        q_redact,
        """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, '') || ' ' || CASE WHEN doc_id % 3 = 0 THEN 'ghp_' || sha256(doc_id::VARCHAR)[:20] || ' ' ELSE '' END || 'end', 'gh[pousr]_[A-Za-z0-9]{16,}', '[REDACTED]', 'g'), 'github_pat_[A-Za-z0-9_]{20,}', '[REDACTED]', 'g'), 'gAAAAA[A-Za-z0-9_=-]{20,}', '[REDACTED]', 'g') AS text FROM documents""",
        "FN30",
    ),
    "chunk_ids": Query(q_chunk_ids, "SELECT doc_id, sha256(coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, ''))[:12] AS chunk_id FROM documents", "FN38"),
    "slugs_and_cells": Query(
        q_slugs,
        "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'report') AS slug, replace(url || '|x y', '|', '\\|') AS cell FROM pages",
        "FN31 FN33",
    ),
    "english_lists": Query(
        q_listed,
        """WITH w AS (SELECT p_brand, list(DISTINCT p_type ORDER BY p_type) AS l FROM part GROUP BY p_brand)
SELECT p_brand, CASE len(l) WHEN 1 THEN l[1] ELSE array_to_string(l[:-2], ', ') || ' and ' || l[-1] END AS types FROM w""",
        "FN35",
    ),
    "relative_times": Query(
        q_relative,
        """WITH s AS (SELECT event_id, ts, (event_id % 930) * (event_id % 930) AS n FROM events),
m AS (SELECT *, (n + 30) // 60 AS minutes FROM s), h AS (SELECT *, (minutes + 30) // 60 AS hours FROM m), d AS (SELECT *, (hours + 12) // 24 AS days FROM h)
SELECT event_id, CASE WHEN n < 60 THEN 'just now' WHEN minutes < 60 THEN minutes || ' min ago' WHEN hours < 24 THEN hours || ' h ago' WHEN days < 7 THEN days || ' d ago' ELSE strftime(ts, '%-d %b %Y') END AS label,
       strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM d""",
        "FN32 FN36",
    ),
    "repository_links": Query(
        q_repo_links,
        "SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN c_mktsegment END AS owner, CASE WHEN c_custkey % 5 < 4 THEN 'r' || c_custkey END AS name FROM customer",
        "FN28 SRC09",
    ),
    "access_levels": Query(q_access, "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'collaborator' WHEN 2 THEN 'write' END AS access_level FROM customer", "FN29"),
    "epss_probability": Query(
        q_epss,
        """WITH e AS (SELECT event_id, event_id * 37 % 1000000 AS m FROM events)
SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL WHEN m % 10 > 5 OR m % 10 = 5 AND m // 10 % 2 = 1 THEN m // 10 + 1 ELSE m // 10 END AS epss_e5 FROM e""",
        "FN19",
    ),
    "vendor_path_filter": Query(
        q_vendor_paths,
        f"SELECT page_id, {_list(_PATHS)}[1 + page_id % 15] AS path, {_cases('page_id % 15', _OWNERS)} AS adapter, {_list(_GROUPS)}[1 + page_id % 15] AS dependency_group FROM pages",
        "TVF01 TVF02 X13",
    ),
    "skipped_manifests": Query(
        q_skipped, f"SELECT scan_id, count(*) FILTER (WHERE position % 3 = 0 OR position > 50)::BIGINT AS skipped FROM ({PLAN_SQL.replace('WHERE position <= 50', '')}) GROUP BY scan_id", "TVF04"
    ),
    "workspace_lists": Query(q_workspace_lists, "SELECT page_id, ['a/*|b', 'c', '', '', ''][1 + page_id % 5] AS globs FROM pages", "TVF07"),
    "packuments": Query(
        q_packuments,
        """SELECT p_partkey, '1.' || (p_partkey % 9) || '.0' AS latest, 2 AS n_versions, '2020-01-02' AS first_time, CASE WHEN p_partkey % 3 <> 2 THEN 'https://host/r' || p_partkey END AS repository FROM part""",
        "SRC03",
    ),
    "osv_ecosystems": Query(q_osv_ecosystems, with_views("SELECT DISTINCT ecosystem, CASE ecosystem WHEN 'npm' THEN 'npm' WHEN 'pypi' THEN 'PyPI' END AS osv_name FROM occurrence", "occurrence"), "X16"),
    "manifest_plan": Query(q_plan, PLAN_SQL, "TVF03 T07 J15 SRC01"),
    "workspace_globs": Query(
        q_workspace_globs,
        """SELECT page_id, CASE page_id // 5 % 6 WHEN 0 THEN page_id % 5 IN (0, 2) WHEN 1 THEN page_id % 5 IN (0, 1, 2) WHEN 2 THEN page_id % 5 = 0 WHEN 3 THEN page_id % 5 IN (0, 4) ELSE false END AS member FROM pages""",
        "TVF06",
    ),
    "requirement_lines": Query(q_requirements, REQUIREMENTS_SQL, "TVF12 TVF13 FN06 X14 W08"),
    "package_json_rows": Query(q_package_json, PACKAGE_JSON_SQL, "TVF08 TVF10 TVF11 TVF19 J16 T12"),
}
