import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from keelson.functions import advisories as adv
from keelson.functions import text as tx
from keelson.functions import versions as ver
from keelson.operators import enrich, lifecycle, reports, retrieval
from keelson.sources import npm, paths, pypi


def values(spark, column, rows, schema="x string"):
    frame = spark.createDataFrame([(n, *(r if isinstance(r, tuple) else (r,))) for n, r in enumerate(rows)], f"n int, {schema}")
    return [r[0] for r in frame.orderBy("n").select(column).collect()]


def test_cvss_every_vector(spark):
    av, ac, ui, cia = adv.AV, adv.AC, adv.UI, adv.CIA

    def score(a, c, p, u, s, x, i, v):
        pr = (adv.PR_CHANGED if s == "C" else adv.PR)[p]
        loss = 1 - (1 - cia[x]) * (1 - cia[i]) * (1 - cia[v])
        impact = 7.52 * (loss - 0.029) - 3.25 * (loss - 0.02) ** 15 if s == "C" else 6.42 * loss
        ease = 8.22 * av[a] * ac[c] * pr * ui[u]
        if impact <= 0:
            return 0.0
        whole = round(min(10, (1.08 if s == "C" else 1) * (impact + ease)) * 100000)
        return whole / 100000 if whole % 10000 == 0 else (math.floor(whole / 10000) + 1) / 10

    combos = list(itertools.product("NALP", "LH", "NLH", "NR", "UC", "HLN", "HLN", "HLN"))
    vectors = ["CVSS:3.1/AV:{}/AC:{}/PR:{}/UI:{}/S:{}/C:{}/I:{}/A:{}".format(*c) for c in combos]
    assert values(spark, adv.cvss3(F.col("x")), vectors) == [score(*c) for c in combos]
    assert values(spark, adv.cvss3(F.col("x")), ["CVSS:4.0/AV:N", vectors[0].replace("/AC:L", ""), "", None]) == [None] * 4


def test_semver(spark):
    ladder = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0"]
    frame = spark.createDataFrame([(v,) for v in reversed(ladder)], "x string")
    assert [r.x for r in frame.orderBy(ver.semver(F.col("x"))).collect()] == ladder
    assert values(spark, ver.semver(F.col("x")).isNull(), ["1.0", "01.2.3", "latest", "v1.2.3+b"]) == [True, True, True, False]
    assert values(spark, ver.semver_pin(F.col("x")), ["=1.2.3", "v1.2.3", "^1.2.3", "1.x"]) == ["1.2.3", "1.2.3", None, None]


def test_pep440(spark):
    ladder = ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1!0.1"]
    frame = spark.createDataFrame([(v,) for v in reversed(ladder)], "x string")
    assert [r.x for r in frame.orderBy(ver.pep440(F.col("x"))).collect()] == ladder
    same = lambda a, b: values(spark, ver.pep440(F.col("x")) == ver.pep440(F.col("y")), [(a, b)], "x string, y string")[0]
    assert same("1.0", "1.0.0") and same("1.0-1", "1.0.post1") and same("1.0.ALPHA-1", "1.0a1") and same("1.0+x", "1.0")
    assert values(spark, ver.pep440_pin(F.col("x")), ["==4.2", "===4.2", ">=5", "==1.*", "==1,<2"]) == ["4.2", "4.2", None, None, None]


def test_behind(spark):
    released = ["1.0.0", "2.1.0", "2.1.3", "2.4.0", "2.4.1", "3.0.0", "5.0.0", "6.0.0-rc.1"]
    frame = spark.createDataFrame([(1, "2.1.0", v) for v in released], "k int, resolved string, version string")
    row = ver.behind(frame.select("k", "resolved", F.lit("npm").alias("ecosystem")).distinct(), frame.select("k", "version", F.lit("npm").alias("ecosystem")), "k").first()
    assert (row.behind_major, row.behind_minor, row.behind_patch) == (2, 1, 1)
    assert ver.latest(frame, "npm", "k").first().latest_version == "5.0.0"


def test_links(spark):
    links = ["https://github.com/o/r", "http://www.github.com/o/r.git", "git@github.com:o/r.git", "github.com/o/r/tree/main", "o/r", "https://gitlab.com/o/r", "https://github.com/o", "-bad/r", "", None]
    got = values(spark, F.concat_ws("/", tx.repository_of(F.col("x"))["owner"], tx.repository_of(F.col("x"))["name"]), links)
    assert got == ["o/r"] * 5 + [""] * 5


def test_pypi_deprecation(spark):
    shape = "f array<struct<yanked: boolean, yanked_reason: string>>, c array<string>"
    rows = [([(True, ""), (True, "broken")], []), ([(True, "x"), (False, None)], []), ([], []), ([], [tx.INACTIVE]), ([(True, None)], [])]
    got = values(spark, tx.pypi_deprecation(F.col("f"), F.col("c")), rows, shape)
    assert [(g.is_deprecated, g.reason) for g in got] == [(True, "broken"), (False, None), (False, None), (True, tx.INACTIVE), (True, "")]


def test_parsed_manifests(spark):
    files = [
        ("p", "pyproject", '[project]\ndependencies = ["A_b>=1", "c==2.0"]\n[project.optional-dependencies]\nx = ["a-b==9"]\n[tool.poetry.dependencies]\npython = "^3"\nd = {git = "https://h/d.git"}\n'),
        ("f", "pipfile", '[packages]\nq = "==1.5"\n[dev-packages]\nq = "*"\nr = "*"\n'),
        ("s", "setup_py", 'from setuptools import setup\nR = ["a==1"]\nsetup(install_requires=R + ["b"], extras_require={"t": ["c>2"]}, setup_requires=read())\n'),
        ("bad", "pyproject", "= ="),
    ]
    frame = spark.createDataFrame(files, "path string, kind string, text string")
    got = {(r.path, r.name): (r.declared_specifier, r.resolved_version, r.unassessable_reason, r.dependency_group) for r in pypi.declared(frame, "path").collect()}
    assert got == {
        ("p", "a-b"): (">=1", None, None, "runtime"),
        ("p", "c"): ("==2.0", "2.0", None, "runtime"),
        ("p", "d"): ("git = https://h/d.git", None, "vcs_specifier", "runtime"),
        ("f", "q"): ("==1.5", "1.5", None, "runtime"),
        ("f", "r"): ("*", None, None, "development"),
        ("s", "a"): ("==1", "1", None, "runtime"),
        ("s", "b"): ("", None, None, "runtime"),
        ("s", "c"): (">2", None, None, "optional"),
        ("s", "setup.py:setup_requires"): ("read()", None, "dynamic_setup_py", "build"),
    }
    assert [r.path for r in pypi.entries(frame, "path").where("error IS NOT NULL").collect()] == ["bad"]
    locks = spark.createDataFrame([("p", "poetry.lock", '[[package]]\nname = "A.B"\nversion = "1.4"\n')], "path string, kind string, text string")
    applied = {(r.path, r.name): (r.resolved_version, r.resolution) for r in pypi.apply_lock(pypi.declared(frame, "path"), pypi.locked(locks, "path"), "path").collect()}
    assert applied["p", "a-b"] == ("1.4", "lockfile") and applied["p", "c"] == ("2.0", "pinned") and applied["p", "d"] == (None, None)


def test_workspace_adoption(spark):
    entries = [("package.json",), ("package-lock.json",), ("packages/a/package.json",), ("packages/x/package.json",), ("other/package.json",)]
    tree = spark.createDataFrame([(1, p, "blob", "s", 1) for (p,) in entries], "scan_id int, path string, type string, sha string, size long")
    globs = spark.createDataFrame([(1, "", ["packages/*", "!packages/x"])], "scan_id int, folder string, globs array<string>")
    got = {r.path: r.lockfile_path for r in paths.adopt(paths.plan(tree), globs).collect()}
    assert got == {"package.json": "package-lock.json", "packages/a/package.json": "package-lock.json", "packages/x/package.json": None, "other/package.json": None}


def test_blob_bytes(spark):
    got = values(spark, paths.blob_bytes(F.col("e"), F.col("c"), 5), [("base64", "aGk="), ("utf-8", "aGk="), ("base64", "!"), ("base64", "aGVsbG8gd29ybGQ=")], "e string, c string")
    assert [None if g is None else bytes(g) for g in got] == [b"hi", None, None, None]


def test_duplicate_json_keys(spark):
    files = spark.createDataFrame([(1, '{"dependencies": {"a": "1.0.0"}, "dependencies": {"b": "2.0.0"}}')], "k int, body string")
    assert [r.name for r in npm.declared(files, "k").collect()] == ["b"]


def test_chunks():
    assert [c[1:] for c in retrieval.chunks_of("x" * 1000, "s", "p")] == [("", "x" * 1000)]
    assert [len(w) for w in retrieval.windows("y" * 1300)] == [1200, 300]
    assert len(retrieval.chunks_of("z" * 39, "s", "p")) == 0 and len(retrieval.chunks_of("z" * 40, "s", "p")) == 1
    fenced = "```\n# not a heading\n```\n" + "t" * 50
    assert [h for _, h, _ in retrieval.chunks_of(fenced, "s", "p")] == [""]
    twice = "# A\n" + "u" * 60
    assert len(retrieval.chunks_of(f"{twice}\n{twice}", "s", "p")) == 1


def test_grounding(spark):
    asked = spark.createDataFrame([(n,) for n in range(4)], "query_id int")
    found = spark.createDataFrame([(0, 0.3, "x" * 400), (1, 0.2999, "x" * 400), (2, 0.9, "x" * 399)], "query_id int, similarity double, text string")
    assert {r.query_id: r.grounding for r in retrieval.grounding(asked, found).collect()} == {0: "sufficient", 1: "low", 2: "low", 3: "low"}


def test_payload_is_an_object(spark):
    assert values(spark, reports.parsed(F.col("x")).isNull(), ["[1]", "oops", "3", '{"fixes": []}', None]) == [True, True, True, False, True]


def test_parsed_manifests_of_odd_shapes(spark):
    files = [
        ("strings", "pyproject", '[project]\ndependencies = "a"\n[tool.poetry]\ndependencies = ["b"]\n'),
        ("mixed", "pyproject", '[project]\ndependencies = ["a", 1, "", "-r x"]\n'),
        ("empty", "pipfile", ""),
        ("no call", "setup_py", "x = 1"),
        ("sum", "setup_py", 'R = ["a"]\nS = R + ["z"]\nif 1:\n    setup(install_requires=R + ["b", 3], tests_require=S, extras_require={"t": "c"})\n'),
        ("long", "setup_py", f"setup(install_requires={'f' * 200}())"),
        (None, "pyproject", None),
    ]
    frame = spark.createDataFrame(files, "path string, kind string, text string")
    got = sorted((r.path, r.name, r.declared_specifier, r.unassessable_reason) for r in pypi.declared(frame, "path").collect())
    assert got == [
        ("long", "setup.py:install_requires", "f" * 117 + "...", "dynamic_setup_py"),
        ("mixed", "a", "", None),
        ("sum", "a", "", None),
        ("sum", "b", "", None),
        ("sum", "setup.py:extras_require", '{"t": "c"}', "dynamic_setup_py"),
        ("sum", "setup.py:install_requires", 'R + ["b", 3]', "dynamic_setup_py"),
        ("sum", "setup.py:tests_require", "S", "dynamic_setup_py"),
    ]
    locks = [("l", "poetry.lock", '[[package]]\nname = "a"\nversion = 1\n'), ("m", "Pipfile.lock", '{"default": {"a": "x", "b": {"version": "==2"}}, "develop": []}'), ("n", "Pipfile.lock", "[]")]
    found = pypi.locked(spark.createDataFrame(locks, "path string, kind string, text string"), "path").collect()
    assert [tuple(r) for r in found] == [("m", "b", "2")]


def test_answers_of_another_number_fail(spark):
    frame = spark.createDataFrame([(["a", "b"], ["x"])], "q array<string>, a array<string>")
    with pytest.raises(Exception, match="differ in number"):
        frame.select(enrich.answered(F.col("q"), F.col("a"))).collect()
    assert frame.select(enrich.answered(F.array(), F.array()).alias("x")).first().x == []


def test_update_keeps_what_is_not_named(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7)], "k int, v string, w int")
    fresh = spark.createDataFrame([(1, None), (3, "z"), (None, "n")], "k int, v string")
    got = sorted(lifecycle.updated(rows, fresh, "k").collect(), key=lambda r: r.w)
    assert [tuple(r) for r in got] == [(1, None, 5), (2, "b", 6), (None, "c", 7)]
    assert lifecycle.updated(rows, fresh.limit(0), "k").count() == 3


def test_behind_by_ecosystem(spark):
    """A PyPI release has as many parts as it likes; missing ones are zero, a post-release counts as its release."""
    own = spark.createDataFrame([("pypi", "4.2"), ("npm", "1.2.3"), ("pypi", "2.0.post1"), ("pypi", "no version"), ("npm", "4.2"), ("pypi", None)], "ecosystem string, resolved string")
    out = [("pypi", v) for v in ("4.2.1", "4.2.1.post1", "4.3", "4.3.0", "5", "6.0rc1", "6.0.dev1", "bad", "2.0", "4.2.1.7")] + [("npm", v) for v in ("1.2.4", "1.2.10", "1.3.0-rc.1", "2.0", "2.0.0")]
    releases = spark.createDataFrame([(1, *r) for r in out], "k int, ecosystem string, version string")
    got = {(r.ecosystem, r.resolved): (r.behind_major, r.behind_minor, r.behind_patch) for r in ver.behind(own.withColumn("k", F.lit(1)), releases, "k").collect()}
    assert got == {("pypi", "4.2"): (1, 1, 1), ("npm", "1.2.3"): (1, 0, 2), ("pypi", "2.0.post1"): (2, 0, 0), ("pypi", "no version"): (0, 0, 0), ("npm", "4.2"): (0, 0, 0), ("pypi", None): (0, 0, 0)}
    alone = ver.behind(own.withColumn("k", F.lit(2)), releases, "k")
    assert alone.count() == 6 and alone.agg(F.sum("behind_major")).first()[0] == 0


def test_lockfile_of_each_kind(spark):
    names = ["py/requirements.txt", "py/Pipfile", "py/pyproject.toml", "py/poetry.lock", "js/package.json", "js/package-lock.json", "js/npm-shrinkwrap.json", "third_party/package.json", "bower_components/a/package.json"]
    tree = spark.createDataFrame([(1, p, "blob", "s", 1) for p in names], "scan_id int, path string, type string, sha string, size long")
    got = {r.path: r.lockfile_path for r in paths.plan(tree).collect()}
    assert got == {"py/requirements.txt": None, "py/Pipfile": None, "py/pyproject.toml": "py/poetry.lock", "js/package.json": "js/npm-shrinkwrap.json", "third_party/package.json": None}


def test_plan_is_cut(spark):
    tree = spark.createDataFrame([(1, f"{'d/' * (n % 3)}p{n:02}/package.json", "blob", "s", 1) for n in range(60)], "scan_id int, path string, type string, sha string, size long")
    planned = paths.plan(tree)
    assert planned.count() == 50 and planned.where("path LIKE 'd/d/%'").count() == 10
    assert paths.skipped(tree, planned, planned.where("false")).first().skipped_manifest_count == 10


def test_globs(spark):
    cases = [
        ("packages/ab", ["packages/a?"], False), ("packages/a?", ["packages/a?"], True), ("packages/a", ["./packages/*"], False), ("packages/a/b", ["packages/*"], False), ("packages/a/b", ["packages/**"], True),
        ("packages/a", ["packages/*/"], True), ("a.b", ["a.b"], True), ("axb", ["a.b"], False), ("", ["**"], False), ("packages/x", ["packages/*", "!packages/x/"], False), ("p/" + "y" * 11_000, ["p/*", "!p/" + "y" * 11_000], False),
    ]
    got = values(spark, paths.workspace_match(F.col("x"), F.col("g")), [(a, b) for a, b, _ in cases], "x string, g array<string>")
    assert got == [want for _, _, want in cases]


def test_relative_time(spark):
    seconds = [-5, 0, 59, 60, 89, 90, 3569, 3570, 5369, 5370, 84_569, 84_570, 561_600, 604_800, 5_000_000]
    frame = [(s,) for s in seconds]
    now = F.lit("2026-08-20 12:00:00").cast("timestamp")
    got = values(spark, tx.relative_time(now - F.make_interval(secs=F.col("x")), now), frame, "x int")
    assert got[:2] == ["just now"] * 2 and got[2:12] == ["just now", "1 min ago", "1 min ago", "2 min ago", "59 min ago", "1 h ago", "1 h ago", "2 h ago", "23 h ago", "1 d ago"]
    assert got[12:] == ["14 Aug 2026", "13 Aug 2026", "23 Jun 2026"]
    assert values(spark, tx.relative_time(F.col("x"), now), [None], "x timestamp") == ["—"]


def test_source_links(spark):
    cases = [
        ({"Docs": "d", "Home": "h"}, "p", "h"), ({"source": " ", "Homepage": " x "}, "p", "x"), ({"Source": "a", "source ": "b"}, None, "b"), ({"GitHub": "g", "Repository": "r"}, None, "r"), ({}, "  ", None), (None, "p", "p"), ({"Source": None}, "p", "p"),
    ]
    urls = F.from_json("u", "map<string, string>")
    got = values(spark, tx.source_link(urls, F.col("h")), [(json.dumps(u), h) for u, h, _ in cases], "u string, h string")
    assert got == [want for *_, want in cases]


def test_package_names_are_exact(spark):
    shape = "a array<struct<package: struct<name: string>, n: int>>, p string"
    got = values(spark, adv.affected_entry(F.col("a"), F.col("p"))["n"], [([(("Pkg",), 1), (("pkg",), 2)], "pkg"), ([(("Pkg",), 1)], "pkg"), ([(None, 3)], "pkg"), ([((None,), 4)], "pkg")], shape)
    assert got == [2, None, 3, None]


def test_unusable_weight_files(tmp_path):
    from keelson.operators import weights

    for path in weights.FOLDER.glob("*.yaml"):
        (tmp_path / path.name).write_text(path.read_text())
    (tmp_path / "v7.yaml").write_text("weights: [")
    (tmp_path / "v8.yaml").write_text("a: 1")
    (tmp_path / "v9.yaml").write_bytes(b"\xff\xfe\xff")
    assert weights.versions(tmp_path) == weights.versions()
    with pytest.raises(weights.WeightsError):
        weights.load("v7", tmp_path)


def test_bounds_bite(spark):
    from keelson.operators import analytics

    rows = spark.createDataFrame([(1, n, f"m{n}") for n in range(35)], "scan_id int, score int, manifest_path string")
    kept = analytics.worst_first(rows, "manifest_path").collect()
    assert len(kept) == 30 and {r.omitted for r in kept} == {5} and max(r.score for r in kept) == 29
    history = spark.createDataFrame([(1, n, n) for n in range(230)], "repository_id int, scan_id int, created_on int")
    window = analytics.history_window(history).collect()
    assert len(window) == 200 and min(r.scan_id for r in window) == 30 and {r.total for r in window} == {230}


def test_minutes(spark):
    now = F.lit("2026-01-01 00:15:00").cast("timestamp")
    got = values(spark, lifecycle.expired(F.col("s"), F.col("t").cast("timestamp"), now, lifecycle.SCAN_MINUTES), [("running", "2026-01-01 00:00:00"), ("queued", "2025-12-31 23:59:59"), ("completed", "2020-01-01 00:00:00")], "s string, t string")
    assert got == ["running", "failed", "completed"]


def test_places_in_large_groups(spark):
    from keelson.operators import analytics

    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 > 0, F.lit(1)).alias("h"), F.lpad((F.col("id") * 7919 % 2000).cast("string"), 4, "0").alias("name"), "id").repartition(7)
    got = analytics.placed(rows, ("g", "h"), ("name", "id")).collect()
    assert len(got) == 2000
    for group in {(r.g, r.h) for r in got}:
        members = sorted((r for r in got if (r.g, r.h) == group), key=lambda r: (r["name"], r.id))
        assert [r.position for r in members] == list(range(1, len(members) + 1))


def test_independent_repositories_have_places(spark):
    from keelson.catalog import QUERIES

    assert QUERIES["projects_grouping"].run(spark, "/root/testdata/sf0.001").where("position IS NULL").count() == 0


def test_all_pairs_of_registrations(spark):
    from keelson.catalog import QUERIES
    from keelson.operators import quality

    rows = spark.createDataFrame([(1, 5, "x"), (2, 5, "x"), (3, 5, None), (4, None, "x"), (5, None, None), (6, 7, "x")], "i int, a int, b string")
    pairs = [tuple(r) for r in quality.matching_pairs(rows, "i", ("a",), ("b",)).collect()]
    assert sorted(pairs) == [(1, 2), (1, 3), (1, 4), (1, 6), (2, 3), (2, 4), (2, 6), (4, 6)]
    found = QUERIES["duplicate_registrations"].run(spark, "/root/testdata/sf0.01")
    assert found.groupBy("o_repository_id").count().where("count > 1").count() > 0


def test_behind_counts_in_one_sort(spark):
    import random

    drawn = random.Random(5)
    number = lambda: drawn.choice((0, 1, 2, 9, 10, 11, 99, 100, 12345678901234567890))
    published = [(drawn.choice("kl"), f"{number()}.{number()}.{number()}") for _ in range(400)]
    own = sorted({(drawn.choice("klm"), f"{number()}.{number()}.{number()}") for _ in range(300)})
    frame = lambda rows, name: spark.createDataFrame(rows, f"k string, {name} string").withColumn("ecosystem", F.lit("npm"))
    found = ver.behind(frame(own, "resolved"), frame(published, "version"), "k")
    plan = found._jdf.queryExecution().optimizedPlan()
    want = {}
    for k, v in own:
        a, b, c = map(int, v.split("."))
        out = [tuple(map(int, p.split("."))) for key, p in published if key == k]
        want[k, v] = (len({x for x, _, _ in out if x > a}), len({y for x, y, _ in out if x == a and y > b}), len({z for x, y, z in out if (x, y) == (a, b) and z > c}))
    assert {(r.k, r.resolved): (r.behind_major, r.behind_minor, r.behind_patch) for r in found.collect()} == want
    # All three counts come from one order.
    windows = [line for line in plan.toString().splitlines() if " Window [" in line or "+- Window [" in line]
    assert len(windows) == 3
