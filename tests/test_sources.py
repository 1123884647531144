"""Repositories as real files, and the data source of answers."""

import json

import pytest
from pyspark.sql import functions as F

from keelson.sources import advisory_batches, checkout


def test_a_checkout_is_planned_and_parsed(spark, tmp_path):
    files = {
        "one/package.json": '{"workspaces": {"packages": ["apps/*", "!apps/out"]}, "dependencies": {"a": "^1"}}', "one/package-lock.json": '{"packages": {"node_modules/a": {"version": "1.2.0"}}}', "one/npm-shrinkwrap.json": '{"packages": {"node_modules/a": {"version": "1.3.0"}}}',
        "one/apps/in/package.json": '{"dependencies": {"a": "^1"}}', "one/apps/out/package.json": '{"dependencies": {"a": "^1"}}', "one/apps/Pipfile": '[packages]\nB_b = "==1.0"', "one/apps/Pipfile.lock": '{"default": {"b-b": {"version": "==1.1"}}}',
        "one/vendor/package.json": "{}", "one/huge/package.json": '{"a": "' + "x" * checkout.MOST_MANIFEST_BYTES + '"}', "one/src/main.py": "x", "two/setup.py": 'from setuptools import setup\nsetup(install_requires=["c==2.0"])', "two/py/pyproject.toml": "= =", "two/empty/package.json": "{}",
        "two/req uirements/a b.txt": "no", "two/requirements/base.txt": "d>=1\nd==9",
    }
    for place, text in files.items():
        path = tmp_path / "repos" / place
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "repos/two/raw").mkdir()
    (tmp_path / "repos/two/raw/package.json").write_bytes(b'{"dependencies": {"\xff": "1"}}')
    tree = checkout.read_tree(spark, f"{tmp_path}/repos")
    assert {(r.key, r.place) for r in tree.select("key", "place").collect()} == {tuple(p.split("/", 1)) for p in [*files, "two/raw/package.json"] if not p.endswith(".py") or "setup" in p}
    manifests, found, skipped = checkout.scan(tree)
    assert {(r.key, r.manifest_path): r.lockfile_path for r in manifests.collect()} == {
        ("one", "package.json"): "npm-shrinkwrap.json", ("one", "apps/in/package.json"): "npm-shrinkwrap.json", ("one", "apps/out/package.json"): None, ("one", "apps/Pipfile"): "apps/Pipfile.lock",
        ("two", "setup.py"): None, ("two", "empty/package.json"): None, ("two", "requirements/base.txt"): None,
    }
    assert {(r.key, r.manifest_path, r.name): (r.resolved_version, r.resolution) for r in found.collect()} == {
        ("one", "package.json", "a"): ("1.3.0", "lockfile"), ("one", "apps/in/package.json", "a"): ("1.3.0", "lockfile"), ("one", "apps/out/package.json", "a"): (None, None), ("one", "apps/Pipfile", "b-b"): ("1.1", "lockfile"),
        ("two", "setup.py", "c"): ("2.0", "pinned"), ("two", "requirements/base.txt", "d"): (None, None),
    }
    assert {r.key: r.skipped for r in skipped.collect()} == {"one": 1, "two": 2}


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k/package.json").write_text("{}")
    tree = checkout.read_tree(spark, str(tmp_path))
    assert "content" not in tree.select("key", "place", "length")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert "LessThanOrEqual(length,10)" in tree.where("length <= 10")._jdf.queryExecution().executedPlan().toString()


def test_staged_trees_are_packed(spark, tmp_path):
    told = {(f"r{n}", f"päckages/a b={n % 3}/package.json"): "" if n == 7 else '{"x": "é%s"}' % n for n in range(300)}
    checkout.stage_tree(spark.createDataFrame([(*k, text) for k, text in told.items()], "key string, place string, text string"), f"{tmp_path}/staged")
    assert len([p for p in (tmp_path / "staged").rglob("*") if not p.name.startswith((".", "_"))]) <= 8
    rows = checkout.read_staged(spark, f"{tmp_path}/staged")
    assert {(r.key, r.place): (r.length, bytes(r.content).decode()) for r in rows.collect()} == {k: (len(t.encode()), t) for k, t in told.items()}
    assert "content" not in rows.select("key", "place", "length")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def put(root, part, number, document):
    folder = root / part / f"batch={number}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "part-0.txt").write_text(document if isinstance(document, str) else json.dumps(document))


def asked(*names):
    return {"queries": [{"package": {"name": n, "ecosystem": "npm"}, "version": "1"} for n in names]}


def test_answers_lie_beside_their_questions(spark, tmp_path):
    spark.dataSource.register(advisory_batches.AdvisoryBatches)
    read = lambda: {(r.batch, r.name, r.osv_id) for r in spark.read.format("advisory_batches").option("batchesPerTask", "1").load(str(tmp_path)).collect()}
    put(tmp_path, "questions", 0, asked("a", "b", "c"))
    put(tmp_path, "answers", 0, {"results": [{"vulns": [{"id": "X"}, {"id": "Y"}, {"id": 7}, "odd"]}, {}, {"vulns": [{"id": "X"}]}]})
    put(tmp_path, "questions", 12, asked("d"))
    with pytest.raises(Exception, match="1 batches have no answer, 12"):
        read()
    put(tmp_path, "answers", 12, {"results": [None]})
    assert read() == {(0, "a", "X"), (0, "a", "Y"), (0, "b", None), (0, "c", "X"), (12, "d", None)}
    for bad, told in [({"results": []}, "0 results for 1 questions"), ({"results": [{}, {}]}, "2 results for 1"), ({}, "no list of results"), ("[1", "batch 12")]:
        put(tmp_path, "answers", 12, bad)
        with pytest.raises(Exception, match=told):
            read()


def test_questions_are_batched(spark):
    targets = spark.createDataFrame([("npm", f"p{n}", "1") for n in range(250)] + [("npm", "p1", "1"), ("pypi", "q", None)], "ecosystem string, name string, version string")
    found = [json.loads(r.document)["queries"] for r in advisory_batches.questions(targets).collect()]
    assert sum(map(len, found)) == 250 and max(map(len, found)) <= 100


def test_a_document_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(n, "npm", f"p{n}", "1") for n in range(20)], "k int, ecosystem string, name string, resolved_version string")
    answers = spark.createDataFrame([(0, "npm", f"p{n}", "1", "SHARED") for n in range(20)] + [(0, "npm", "p1", "1", "GONE"), (0, "npm", "p1", "1", None)], advisory_batches.SCHEMA)

    def fetch(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    wanted = answers.where("osv_id IS NOT NULL").select("osv_id").distinct()
    documents = wanted.select("osv_id", F.when(F.col("osv_id") == "SHARED", "{}").alias("document")).mapInPandas(fetch, "osv_id string, document string")
    assert advisory_batches.advisories(rows, answers, documents, "k").count() == 20 and seen.value == 2


def test_adapters_as_table_functions(spark):
    from keelson.sources import adapters

    adapters.register(spark)
    files = [
        ("package.json", '{"devDependencies": {"a": "2"}, "dependencies": {"a": "1", "Bad Name": "1", "n": 5}}'), ("x/requirements-dev.txt", "A==1 \\\n # no\n-r b.txt\n-e git+https://h/p#egg=E\nb>=2 --hash=sha256:ab"), ("Pipfile", '[packages]\nq = "==1"'),
        ("setup.py", 'from setuptools import setup\nsetup(install_requires=["c"])'), ("pyproject.toml", "= ="), ("vendor/package.json", "{}"), ("Requirements/base.TXT", "z"), ("notes.txt", "z"), (None, "z"), ("deep/package.json", None), ("list/package.json", "[]"),
    ]
    frame = spark.createDataFrame(files, "path string, text string")
    got = {(r.path, r.entry): (r.kind, r.specifier, r.dependency_group, r.error) for r in spark.sql("SELECT f.path, m.* FROM {f} f, LATERAL manifest_entries(f.path, f.text) m", f=frame).collect()}
    assert got == {
        ("package.json", "a"): ("package_json", "1", "runtime", None), ("package.json", "n"): ("package_json", "", "runtime", None), ("x/requirements-dev.txt", "A==1"): ("requirements", None, "", None), ("x/requirements-dev.txt", "-e git+https://h/p#egg=E"): ("requirements", None, "", None),
        ("x/requirements-dev.txt", "b>=2"): ("requirements", None, "", None), ("Pipfile", "q"): ("pipfile", "==1", "runtime", None), ("setup.py", "c"): ("setup_py", None, "runtime", None), ("pyproject.toml", None): ("pyproject", None, None, "TOMLDecodeError"), ("Requirements/base.TXT", "z"): ("requirements", None, "", None),
        ("deep/package.json", None): ("package_json", None, None, "TypeError"), ("list/package.json", None): ("package_json", None, None, "ValueError"),
    }
    lock = '{"packages": {"": {}, "node_modules/a": {"version": "1.0"}, "node_modules/b/node_modules/a": {"version": "0.1"}, "node_modules/c": {"link": true, "version": "9"}, "node_modules/q/node_modules/d": {"version": "2"}, "node_modules/r/node_modules/d": {"version": "10"}}}'
    rows = spark.sql("SELECT * FROM locked_versions('w/package-lock.json', '" + lock + "')").collect()
    assert {(r.name, r.version) for r in rows} == {("a", "1.0"), ("d", "10")}
    for text, told in (("SELECT * FROM manifest_entries('README.md', 'x')", "no adapter reads"), ("SELECT * FROM locked_versions('yarn.lock', 'x')", "no adapter reads"), ("SELECT * FROM manifest_entries(1, 'x')", "both strings")):
        with pytest.raises(Exception, match=told):
            spark.sql(text).collect()


def test_registry_outcomes(spark):
    from keelson.sources import registry

    doc = '{"dist-tags": {"latest": "1.0.0"}, "versions": {"1.0.0": {}}}'
    big = '{"x": "' + "y" * registry.MOST_FULL + '"}'
    rows = [
        ("npm", "small", "full", "ok", doc), ("npm", "small", "reduced", "ok", "{}"), ("npm", "big", "full", "ok", big), ("npm", "big", "reduced", "ok", doc), ("npm", "told", "full", "too_large", None), ("npm", "told", "reduced", "not_found", None), ("npm", "both", "full", "too_large", None), ("npm", "both", "reduced", "too_large", None),
        ("npm", "gone", "full", "not_found", None), ("npm", "down", "full", "timeout", None), ("npm", "down", "reduced", "ok", doc), ("npm", "list", "full", "ok", "[]"), ("npm", "alone", "reduced", "ok", doc), ("npm", "Case", "full", "ok", doc), ("npm", "case", "full", "not_found", None),
        ("pypi", "A_b", "full", "ok", '{"info": {}, "releases": {"1.0": [], "2.0rc1": []}}'), ("pypi", "a.B", "full", "ok", '{"info": {}, "releases": {"1.0": [], "2.0rc1": []}}'), ("pypi", "big", "full", "ok", big), ("pypi", "big", "reduced", "ok", doc), ("pypi", "gone", "full", "not_found", None),
    ]
    found = registry.documents(spark.createDataFrame(rows, "ecosystem string, name string, form string, status string, body string"))
    got = {(r.ecosystem, r.name): (r.outcome, r.form) for r in found.collect()}
    ok, gone, down = ("ok", "full"), ("not_found", None), ("unavailable", None)
    assert got == {
        ("npm", "small"): ok, ("npm", "big"): ("ok", "reduced"), ("npm", "told"): gone, ("npm", "both"): down, ("npm", "gone"): gone, ("npm", "down"): down, ("npm", "list"): down, ("npm", "alone"): down, ("npm", "Case"): ok, ("npm", "case"): gone,
        ("pypi", "a-b"): ok, ("pypi", "big"): down, ("pypi", "gone"): gone,
    }
    facts = {(r.ecosystem, r.name): r for r in registry.facts(found).collect()}
    assert facts["pypi", "a-b"].latest_version == "1.0" and sorted(facts["pypi", "a-b"].released) == ["1.0", "2.0rc1"] and facts["npm", "big"].latest_version == "1.0.0" and facts["npm", "gone"].latest_version is None


def test_what_an_answer_means(spark):
    from keelson.sources import answers

    cases = [
        (200, {}, 5, "ok"), (200, {}, 11, "too_large"), (200, {"Content-Length": "11"}, None, "too_large"), (200, {"Content-Length": "many"}, 3, "ok"), (None, {}, None, "unavailable"), (302, {}, None, "unavailable"), (401, {}, None, "unauthorized"), (404, {}, 99, "not_found"),
        (409, {}, None, "conflict"), (403, {}, None, "forbidden"), (403, {"X-RateLimit-Remaining": " 0"}, None, "rate_limited"), (403, {"x-ratelimit-remaining": "5"}, None, "forbidden"), (403, {"RETRY-AFTER": "soon"}, None, "rate_limited"), (429, None, None, "rate_limited"),
        (418, {}, None, "client_error"), (502, {"retry-after": "9"}, None, "unavailable"),
    ]
    frame = spark.createDataFrame([(n, *c[:3]) for n, c in enumerate(cases)], "n int, code int, h map<string, string>, size long").orderBy("n")
    got = frame.select(answers.status_word(F.col("code"), F.col("h"), F.col("size"), 10).alias("w"), answers.retry_after(F.col("h")).alias("s")).collect()
    assert [r.w for r in got] == [c[3] for c in cases] and {c[3] for c in cases} == set(answers.WORDS) and got[15].s == 9 and got[12].s is None
