"""Sources staged as files: whole repositories, and the answers to batches of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Query
from ..session import kept, shared_path
from ..sources import adapters, advisory_batches, checkout, registry
from ..sources import answers as told_by
from .fixtures import KEY, occurrence, table, with_views
from .scoring_queries import KEYS

#: Place and text of a repository's files; {s} is its number, {m7} and so on the number modulo seven.
_FILES = {
    "package.json": '{"workspaces": ["packages/*"], "dependencies": {"root-dep": "^1"}}',
    "package-lock.json": '{"packages": {"node_modules/root-dep": {"version": "1.9.{m7}"}, "node_modules/left": {"version": "1.{m7}.0"}}}',
    "packages/a/package.json": '{"dependencies": {"left": "^1.0.0", "p{s}": "2.0.0"}}',
    "packages/a/README.md": "package.json",
    "other/package.json": '{"dependencies": {"left": "^1"}}',
    "svc/pyproject.toml": '[project]\ndependencies = ["Dep.{s}>=1", "free"]',
    "svc/poetry.lock": '[[package]]\nname = "dep_{s}"\nversion = "3.{m5}"',
    "svc/requirements-dev.txt": "Pkg_{s}==1.{m5}  # pinned\n-r other.txt",
    "node_modules/x/package.json": '{"dependencies": {"vendored": "1.0.0"}}',
    "bad/package.json": "not json",
}


def _repositories(spark, sf_dir):
    """One repository a supplier. Every third root declares no workspaces; three in four last files are sound."""
    s = F.col("s_suppkey")
    pairs = F.explode(F.array(*[F.struct(F.lit(place).alias("place"), F.lit(text).alias("text")) for place, text in _FILES.items()]))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", pairs.alias("f")).select("s_suppkey", "f.*")
    text = F.col("text")
    for mark, value in (("{s}", s), ("{m7}", s % 7), ("{m5}", s % 5)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    root = F.when((F.col("place") == "package.json") & (s % 3 == 0), F.replace(text, F.lit("workspaces"), F.lit("worlds"))).otherwise(text)
    sound = F.when((F.col("place") == "bad/package.json") & (s % 4 != 0), '{"dependencies": {"z": "1.0.0"}}').otherwise(root)
    return rows.select(s.alias("key"), "place", sound.alias("text"))


def q_checkouts(spark, sf_dir):
    """Repositories written as files, then listed, planned, given their lockfiles and parsed."""
    root = shared_path(spark, "repositories")
    checkout.stage_tree(_repositories(spark, sf_dir), root)
    _, found, skipped = checkout.scan(checkout.read_staged(spark, root))
    return found.join(skipped, "key").select("key", "manifest_path", "lockfile_path", "name", "resolved_version", "resolution", "dependency_group", "skipped")


CHECKOUTS_SQL = """
WITH s AS (SELECT s_suppkey AS s, CAST(s_suppkey AS VARCHAR) AS key FROM supplier),
rows AS (
  SELECT s, key, 'package.json' AS manifest_path, 'package-lock.json' AS lockfile_path, 'root-dep' AS name, '1.9.' || (s % 7) AS resolved_version, 'lockfile' AS resolution, 'runtime' AS dependency_group FROM s
  UNION ALL SELECT s, key, 'packages/a/package.json', CASE WHEN s % 3 <> 0 THEN 'package-lock.json' END, 'left', CASE WHEN s % 3 <> 0 THEN '1.' || (s % 7) || '.0' END, CASE WHEN s % 3 <> 0 THEN 'lockfile' END, 'runtime' FROM s
  UNION ALL SELECT s, key, 'packages/a/package.json', CASE WHEN s % 3 <> 0 THEN 'package-lock.json' END, 'p' || s, '2.0.0', 'pinned', 'runtime' FROM s
  UNION ALL SELECT s, key, 'other/package.json', NULL, 'left', NULL, NULL, 'runtime' FROM s
  UNION ALL SELECT s, key, 'svc/pyproject.toml', 'svc/poetry.lock', 'dep-' || s, '3.' || (s % 5), 'lockfile', 'runtime' FROM s
  UNION ALL SELECT s, key, 'svc/pyproject.toml', 'svc/poetry.lock', 'free', NULL, NULL, 'runtime' FROM s
  UNION ALL SELECT s, key, 'svc/requirements-dev.txt', NULL, 'pkg-' || s, '1.' || (s % 5), 'pinned', 'development' FROM s
  UNION ALL SELECT s, key, 'bad/package.json', NULL, 'z', '1.0.0', 'pinned', 'runtime' FROM s WHERE s % 4 <> 0)
SELECT key, manifest_path, lockfile_path, name, resolved_version, resolution, dependency_group, CAST(CASE WHEN s % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS skipped FROM rows"""


def q_answers(spark, sf_dir):
    """Questions put in batches, answers staged as files and read by the source, documents read once an id.

    A package's name gives the number of its advisories, its version takes part in their ids."""
    rows = occurrence(spark, sf_dir).where("NOT is_unassessable AND line_no <> 2").select(*KEY, "ecosystem", F.col("package_name").alias("name"), "resolved_version")
    root = shared_path(spark, "advisory-batches")
    asked = advisory_batches.questions(rows.select("ecosystem", "name", F.col("resolved_version").alias("version")))
    advisory_batches.stage(asked, root, "questions")
    shape = "struct<queries: array<struct<package: struct<name: string, ecosystem: string>, version: string>>>"
    many = lambda q: F.length(q["package"]["name"]) % 3
    ids = lambda q: F.transform(F.sequence(F.lit(1), many(q)), lambda i: F.struct(F.concat_ws("-", F.lit("OSV"), q["package"]["name"], q["version"], i).alias("id")))
    told = F.transform(F.from_json("document", shape)["queries"], lambda q: F.struct(F.when(many(q) > 0, ids(q)).alias("vulns")))
    staged = spark.read.option("wholetext", "true").text(f"{root}/questions").select("batch", F.col("value").alias("document"))
    advisory_batches.stage(staged.select("batch", F.to_json(F.struct(told.alias("results"))).alias("document")), root, "answers")

    spark.dataSource.register(advisory_batches.AdvisoryBatches)
    # Three steps use the answers; the files are read and parsed once.
    answers = kept(spark.read.format("advisory_batches").load(root), "advisory-answers")
    # The second advisory of a package with an even name has no document.
    number = F.substring_index("osv_id", "-", -1)
    document = F.when((number == "1") | (F.length("name") % 2 == 1), F.to_json(F.struct(F.col("osv_id").alias("id"))))
    documents = answers.where("osv_id IS NOT NULL").select("osv_id", document.alias("document"))
    found = advisory_batches.advisories(rows, answers, documents, *KEY)
    return found.select(*KEY, "osv_id", F.get_json_object("document", "$.id").alias("document_id"))


#: One statement for manifests and lockfiles of every kind.
IN_SQL = """
WITH declared AS (
  SELECT f.key, f.place, regexp_replace(f.place, '/?[^/]*$', '') AS folder, m.kind, m.dependency_group, m.specifier, m.error,
         CASE WHEN m.kind = 'package_json' OR m.specifier IS NOT NULL THEN m.entry ELSE lower(regexp_replace(regexp_extract(m.entry, '^[A-Za-z0-9][A-Za-z0-9._-]*', 0), '[-_.]+', '-')) END AS name
  FROM {files} f, LATERAL manifest_entries(f.place, f.text) m),
locked AS (
  SELECT f.key, regexp_replace(f.place, '/?[^/]*$', '') AS folder, lower(regexp_replace(v.name, '[-_.]+', '-')) AS name, v.version
  FROM {files} f, LATERAL locked_versions(f.place, f.text) v WHERE v.error IS NULL)
SELECT d.key, d.place, d.kind, d.name, nullif(d.dependency_group, '') AS dependency_group, d.specifier, l.version, d.error
FROM declared d LEFT JOIN locked l ON d.key = l.key AND d.folder = l.folder AND d.name = l.name"""


def q_adapters(spark, sf_dir):
    """Every file of every repository, parsed by table functions in one SQL text."""
    adapters.register(spark)
    return spark.sql(IN_SQL, files=_repositories(spark, sf_dir))


def q_registry(spark, sf_dir):
    """What the registries answered for every part in both ecosystems, with small caps, and the facts of what was found."""
    p = F.col("p_partkey")
    statuses = F.element_at(F.array(*map(F.lit, ("ok", "ok", "ok", "not_found", "rate_limited", "too_large", "ok"))), (p % 7 + 1).cast("int"))
    pad = F.concat(F.lit(', "pad": "'), F.repeat(F.lit("x"), (p % 13 * 40).cast("int")), F.lit('"}'))
    tags = F.when(p % 2 == 0, F.concat(F.lit('"dist-tags": {"latest": "1.0.'), p % 10, F.lit('"}, '))).otherwise("")
    versions = F.concat(F.lit('"versions": {"1.0.0": {}, "2.'), p % 9, F.lit('.0": {}, "3.0.0-rc.1": {}}'))
    full = F.concat(F.lit("{"), tags, versions, F.lit(', "time": {"1.0.0": "2020-01-02T00:00:00Z", "x": "?"}, "repository": " r "'), pad)
    reduced = F.when(p % 3 > 0, F.concat(F.lit("{"), tags, versions, F.when(p % 5 == 0, F.repeat(F.lit(" "), 900)).otherwise(""), F.lit("}"))).otherwise("[]")
    info = F.concat(F.lit('{"info": {"version": "'), F.when(p % 4 > 0, F.concat(F.lit("1."), p % 4)).otherwise(""), F.lit('", "project_urls": {"Home": "h"}}, "releases": {"1.'), p % 4, F.lit('": [{"yanked": true, "upload_time": "2021-05-06T00:00:00"}], "0.9": []}'), pad)
    row = lambda ecosystem, name, form, status, body: F.struct(F.lit(ecosystem).alias("ecosystem"), name.alias("name"), F.lit(form).alias("form"), status.alias("status"), F.when(status == "ok", body).alias("body"))
    npm_name, pypi_name = F.concat(F.lit("Part."), p.cast("string")), F.concat(F.lit("Part_"), p.cast("string"))
    asked = F.array(row("npm", npm_name, "full", statuses, full), row("npm", npm_name, "reduced", F.lit("ok"), reduced), row("pypi", pypi_name, "full", statuses, info))
    answers = table(spark, sf_dir, "part").select(F.explode(asked).alias("a")).select("a.*")
    found = registry.facts(registry.documents(answers, 450, 600, 450))
    return found.select("ecosystem", "name", "outcome", "form", "latest_version", F.size("released").alias("n_released"), F.size(F.map_keys("times")).alias("n_times"), "repository", F.col("deprecation.is_deprecated").alias("is_deprecated"))


REGISTRY_SQL = """
WITH p AS (SELECT p_partkey AS k, ['ok', 'ok', 'ok', 'not_found', 'rate_limited', 'too_large', 'ok'][1 + p_partkey % 7] AS st, CASE WHEN p_partkey % 2 = 0 THEN length('"dist-tags": {"latest": "1.0.0"}, ') ELSE 0 END AS tags, 40 * (p_partkey % 13) AS pad FROM part),
n AS (SELECT *, 1 + tags + length('"versions": {"1.0.0": {}, "2.0.0": {}, "3.0.0-rc.1": {}}') AS head FROM p),
j AS (SELECT *, head + length(', "time": {"1.0.0": "2020-01-02T00:00:00Z", "x": "?"}, "repository": " r "') + length(', "pad": ""}') + pad AS full_size, CASE WHEN k % 3 > 0 THEN head + 1 + CASE WHEN k % 5 = 0 THEN 900 ELSE 0 END ELSE 2 END AS reduced_size FROM n),
w AS (SELECT *, st = 'too_large' OR st = 'ok' AND full_size > 450 AS large FROM j),
o AS (SELECT *, CASE WHEN large THEN CASE WHEN reduced_size <= 600 AND k % 3 > 0 THEN 'ok' ELSE 'unavailable' END WHEN st = 'not_found' THEN 'not_found' WHEN st = 'ok' THEN 'ok' ELSE 'unavailable' END AS outcome FROM w),
y AS (SELECT *, length('{"info": {"version": "') + CASE WHEN k % 4 > 0 THEN 3 ELSE 0 END + length('", "project_urls": {"Home": "h"}}, "releases": {"1.0": [{"yanked": true, "upload_time": "2021-05-06T00:00:00"}], "0.9": []}') + length(', "pad": ""}') + pad AS size FROM p),
z AS (SELECT *, CASE WHEN st = 'not_found' THEN 'not_found' WHEN st = 'ok' AND size <= 450 THEN 'ok' ELSE 'unavailable' END AS outcome FROM y)
SELECT 'npm' AS ecosystem, 'Part.' || k AS name, outcome, CASE WHEN outcome = 'ok' THEN CASE WHEN large THEN 'reduced' ELSE 'full' END END AS form, CASE WHEN outcome = 'ok' THEN CASE WHEN k % 2 = 0 THEN '1.0.' || (k % 10) ELSE CASE WHEN k % 9 >= 0 THEN '2.' || (k % 9) || '.0' END END END AS latest_version,
  CASE WHEN outcome = 'ok' THEN 3 ELSE 0 END AS n_released, CASE WHEN outcome = 'ok' AND NOT large THEN 1 END AS n_times, CASE WHEN outcome = 'ok' AND NOT large THEN 'r' END AS repository, NULL::BOOLEAN AS is_deprecated FROM o
UNION ALL SELECT 'pypi', 'part-' || k, outcome, CASE WHEN outcome = 'ok' THEN 'full' END, CASE WHEN outcome = 'ok' THEN '1.' || (k % 4) END, CASE WHEN outcome = 'ok' THEN 2 ELSE 0 END, CASE WHEN outcome = 'ok' THEN 1 END, CASE WHEN outcome = 'ok' THEN 'h' END, CASE WHEN outcome = 'ok' THEN true END FROM z"""


def q_answers_status(spark, sf_dir):
    """The word for every answer, and how long it says to wait: statuses, headers and sizes by the events' ids."""
    e = F.col("event_id")
    code = F.element_at(F.array(*[F.lit(c) for c in (200, 201, 302, 401, 403, 404, 409, 418, 429, 500, 503)]), (e % 11 + 1).cast("int"))
    given = F.when(e % 13 > 0, code)
    wait = F.element_at(F.array(*map(F.lit, ("7", "-3", "soon"))), (e % 3 + 1).cast("int"))
    headers = F.map_concat(
        F.when(e % 4 == 0, F.create_map(F.lit("X-RateLimit-Remaining"), F.when(e % 8 == 0, " 0 ").otherwise("12"))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(e % 5 == 0, F.create_map(F.lit("Retry-After"), wait)).otherwise(F.create_map().cast("map<string,string>")),
        F.when(e % 6 == 0, F.create_map(F.lit("content-length"), (e % 3000).cast("string"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    rows = table(spark, sf_dir, "events").select("event_id", given.alias("code"), headers.alias("h"), F.when(e % 7 > 0, (e % 1500).cast("long")).alias("size"))
    return rows.select("event_id", told_by.status_word(F.col("code"), F.col("h"), F.col("size"), 1000).alias("word"), told_by.retry_after(F.col("h")).alias("wait"))


QUERIES = {
    "answer_status": Query(
        q_answers_status,
        """WITH a AS (SELECT event_id, CASE WHEN event_id % 13 > 0 THEN [200, 201, 302, 401, 403, 404, 409, 418, 429, 500, 503][1 + event_id % 11] END AS code, event_id % 8 = 0 AS spent, event_id % 5 = 0 AS told,
  greatest(CASE WHEN event_id % 6 = 0 THEN event_id % 3000 ELSE 0 END, CASE WHEN event_id % 7 > 0 THEN event_id % 1500 ELSE 0 END) > 1000 AS large FROM events)
SELECT event_id, CASE WHEN code IS NULL THEN 'unavailable' WHEN code = 429 OR code = 403 AND (spent OR told) THEN 'rate_limited' WHEN code >= 500 THEN 'unavailable' WHEN code = 401 THEN 'unauthorized' WHEN code = 404 THEN 'not_found' WHEN code = 409 THEN 'conflict'
  WHEN code = 403 THEN 'forbidden' WHEN code = 418 THEN 'client_error' WHEN code = 302 THEN 'unavailable' WHEN large THEN 'too_large' ELSE 'ok' END AS word, CASE WHEN told THEN [7.0::DOUBLE, 0.0::DOUBLE, NULL][1 + event_id % 3] END AS wait FROM a""",
        "SRC12",
    ),
    "registry_documents": Query(q_registry, REGISTRY_SQL, "SRC03 SRC04 FN08 FN24 FN25 FN27 X17"),
    "manifests_in_sql": Query(
        q_adapters,
        """SELECT s_suppkey AS key, p.place, kind, replace(name, '{s}', s_suppkey::VARCHAR) AS name, grp AS dependency_group, spec AS specifier,
CASE name WHEN 'root-dep' THEN '1.9.' || (s_suppkey % 7) WHEN 'dep-{s}' THEN '3.' || (s_suppkey % 5) END AS version, CASE WHEN name IS NULL THEN 'JSONDecodeError' END AS error
FROM supplier, (VALUES ('package.json', 'package_json', 'root-dep', 'runtime', '^1'), ('packages/a/package.json', 'package_json', 'left', 'runtime', '^1.0.0'), ('packages/a/package.json', 'package_json', 'p{s}', 'runtime', '2.0.0'),
  ('other/package.json', 'package_json', 'left', 'runtime', '^1'), ('svc/pyproject.toml', 'pyproject', 'dep-{s}', 'runtime', NULL), ('svc/pyproject.toml', 'pyproject', 'free', 'runtime', NULL), ('svc/requirements-dev.txt', 'requirements', 'pkg-{s}', NULL, NULL),
  ('bad/package.json', 'package_json', 'z', 'runtime', '1.0.0'), ('bad/package.json', 'package_json', NULL, NULL, NULL)) AS p(place, kind, name, grp, spec)
WHERE p.place <> 'bad/package.json' OR (name IS NULL) = (s_suppkey % 4 = 0)""",
        "TVF01 TVF02 TVF14 TVF16 TVF17 TVF19 X13 X14",
    ),
    "repository_files": Query(q_checkouts, CHECKOUTS_SQL, "SRC01 SRC02 TVF03 TVF05 TVF18 J15 J16"),
    "advisory_answers": Query(
        q_answers,
        with_views(f"""rows AS (SELECT {KEYS}, package_name AS name, resolved_version AS v FROM occurrence WHERE NOT is_unassessable AND line_no <> 2),
ids AS (SELECT *, unnest(range(1, length(name) % 3 + 1)) AS i FROM rows)
SELECT {KEYS}, 'OSV-' || name || '-' || v || '-' || i AS osv_id, 'OSV-' || name || '-' || v || '-' || i AS document_id FROM ids WHERE i = 1 OR length(name) % 2 = 1""", "occurrence"),
        "SRC05 SRC06 J06 J18",
    ),
}
