"""Tables that change in place, the chunk store, published sets and the corpus: what is on disk after each step."""

import base64
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators import corpus, scan_set
from keelson.sources import published
from keelson.sources.chunk_store import ChunkStore
from keelson.sources.sharded import ShardedTable

SHAPE = T.StructType([T.StructField("g", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("b", T.ArrayType(T.IntegerType()))])


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def rows(table, spark):
    return sorted((tuple(r) for r in table.read(spark).collect()), key=str)


@pytest.fixture
def stored(spark, tmp_path):
    table = ShardedTable(f"{tmp_path}/t", SHAPE, ("g", "k"), ("g",), 8).create(spark)
    table.upsert(spark.createDataFrame([(g, k, f"{g}{k}", [k]) for g in "abcdefgh" for k in range(3)] + [(None, 1, "n", None)], SHAPE))
    return table


def test_upsert_rewrites_touched_shards_only(spark, stored):
    before, held = files(stored.path), rows(stored, spark)
    assert len(held) == 25
    assert stored.upsert(spark.createDataFrame([("a", 1, "a1", [1]), (None, 1, "n", None)], SHAPE)) == [] and files(stored.path) == before
    change = spark.createDataFrame([("a", 1, "new", [9]), ("a", 7, "more", None), ("a", 7, "less", None)], SHAPE)
    assert len(stored.upsert(change)) == 1
    after = rows(stored, spark)
    assert {r[:3] for r in after} - {r[:3] for r in held} == {("a", 1, "new"), ("a", 7, "less")}
    assert len(after) == 26
    kept = {p: t for p, t in files(stored.path).items() if before.get(p) == t}
    shard = {p.split("__shard=")[1][0] for p in before} - {p.split("__shard=")[1][0] for p in kept}
    assert len(shard) == 1
    again = files(stored.path)
    assert stored.upsert(change) == [] and files(stored.path) == again


def test_update_sets_what_it_names(spark, stored):
    before = files(stored.path)
    change = spark.createDataFrame([("b", 0, None), ("b", 2, "x"), ("zz", 1, "not there"), (None, 1, "null key")], "g string, k int, a string")
    touched = stored.update(change)
    assert 1 <= len(touched) <= 2 and stored.update(change) == []
    got = {(r[0], r[1]): r[2:] for r in rows(stored, spark)}
    assert got["b", 0] == (None, [0]) and got["b", 2] == ("x", [2]) and got["b", 1] == ("b1", [1]) and got[None, 1] == ("null key", None) and len(got) == 25
    assert sum(before.get(p) == t for p, t in files(stored.path).items()) >= 6
    with pytest.raises(ValueError):
        stored.update(spark.createDataFrame([("b", "x")], "g string, a string"))


def test_delete_to_the_last_row(spark, stored):
    gone = spark.createDataFrame([(g,) for g in "abcdefgh"], "g string")
    assert stored.delete(gone.where("g <> 'c'")) and {r[0] for r in rows(stored, spark)} == {"c", None}
    assert stored.delete(gone) and stored.delete(spark.createDataFrame([(None,)], "g string")) and rows(stored, spark) == []
    assert stored.delete(gone) == []
    stored.upsert(spark.createDataFrame([("c", 1, "back", None)], SHAPE))
    assert [r[:3] for r in rows(stored, spark)] == [("c", 1, "back")]


def test_whole_rows_move_once(spark, stored, monkeypatch):
    from keelson.sources import sharded

    seen, plain = [], ShardedTable._put
    monkeypatch.setattr(ShardedTable, "_put", lambda self, rows, *a, **k: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or plain(self, rows, *a, **k))
    stored.upsert(spark.createDataFrame([("a", 1, "x", None), ("a", 1, "w", [2]), ("q", None, None, None)], SHAPE))
    assert "Join" not in seen[0] and seen[0].count("RepartitionByExpression") == 1
    held = rows(stored, spark)
    assert ("a", 1, "w", [2]) in held and ("q", None, None, None) in held and len(held) == 26
    gone = spark.createDataFrame([("a", 1), ("b", 2), (None, 1)], "g string, k int")
    stored.delete(gone.limit(2))
    assert len(seen) == 2 and len(rows(stored, spark)) == 24
    monkeypatch.setattr(sharded, "MOST_SENT", 0)
    assert stored.delete(gone) and len(rows(stored, spark)) == 23 and stored.delete(gone) == []


def test_reads_prune_to_the_shards_asked_for(spark, stored):
    plan = stored.read(spark, spark.createDataFrame([("a",)], "g string"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "__shard" in plan.split("PartitionFilters")[1][:120]


def chunk(scan, package, n, version=None, text="t"):
    return (scan, "npm", package, version, f"c{n}", "README.md", "s", "readme", "", n, text, [1.0, float(n)])


CHUNK = "scan_id string, ecosystem string, package_name string, resolved_version string, chunk_id string, source_path string, source_sha string, source_kind string, heading string, chunk_index int, text string, vector array<float>"


def test_chunk_store(spark, tmp_path):
    store = ChunkStore(f"{tmp_path}/c", 4).create(spark)
    first = spark.createDataFrame([chunk("s1", "a", 1), chunk("s1", "a", 2), chunk("s1", "b", 3, " 1.0 "), chunk("s2", "a", 1)], CHUNK)
    store.add(first)
    before = files(store.table.path)
    assert store.add(first) == [] and files(store.table.path) == before
    asked = spark.createDataFrame([("s1", "npm", "a", None), ("s1", "npm", "b", "1.0"), ("s1", "npm", "b", "2.0"), ("s3", "npm", "a", None), ("s1", "npm", "a", None)], "scan_id string, ecosystem string, package_name string, resolved_version string")
    count = lambda: {(r.scan_id, r.package_name, r.version): r.n for r in store.count_for(asked).collect()}
    assert count() == {("s1", "a", ""): 2, ("s1", "b", "1.0"): 1, ("s1", "b", "2.0"): 0, ("s3", "a", ""): 0}
    store.add(spark.createDataFrame([chunk("s1", "b", 2, "2.0")], CHUNK))  # the later owner of a shared chunk
    assert count()["s1", "a", ""] == 1 and count()["s1", "b", "2.0"] == 1
    query = spark.createDataFrame([("q", "s1", "npm", "b", "1.0", [0.0, 1.0])], "query_id string, scan_id string, ecosystem string, package_name string, resolved_version string, query_vector array<float>")
    assert [(r.query_id, r.chunk_id) for r in store.nearest(query).collect()] == [("q", "c3")]
    store.delete_for(asked.where("package_name = 'a'"))
    assert count()["s1", "a", ""] == 0 and sorted(r.scan_id for r in store.scans(spark).collect()) == ["s1", "s2"]
    store.drop_scans(spark.createDataFrame([("s1",), ("never",)], "scan_id string"))
    assert [r.scan_id for r in store.scans(spark).collect()] == ["s2"]
    with pytest.raises(Exception, match="needs a vector"):
        store.add(first.withColumn("vector", F.lit(None).cast("array<float>")))


def test_a_set_is_published_whole_or_not(spark, tmp_path):
    root, one, two = f"{tmp_path}/sets", spark.range(3), spark.range(5)
    with pytest.raises(FileNotFoundError):
        published.read_set(spark, root, "a")
    published.publish(spark, root, {"a": one, "b": one})
    broken = two.withColumn("x", F.when(F.col("id") == 4, F.raise_error(F.lit("midway"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="midway"):
        published.publish(spark, root, {"a": two, "b": broken})
    with pytest.raises(published.SetRefused, match="no rows over 3"):
        published.publish(spark, root, {"a": two, "b": two}, lambda t: {"no rows over 3": t["b"].where("id > 3")})
    seen = published.read_set(spark, root, "a", "b")
    assert [seen[t].count() for t in "ab"] == [3, 3]
    published.publish(spark, root, {"a": two, "b": two})
    assert published.read_set(spark, root, "b")["b"].count() == 5
    assert [seen[t].count() for t in "ab"] == [3, 3]  # an older reader keeps its set
    assert len(published.prune_sets(spark, root, 1)) == 1 and published.read_set(spark, root, "a")["a"].count() == 5
    assert len(os.listdir(f"{root}/published")) <= 2


def test_of_two_writers_one_is_refused(spark, tmp_path):
    root = f"{tmp_path}/sets"

    def meanwhile(tables):
        published.publish(spark, root, {"a": spark.range(7)})
        return {}

    with pytest.raises(published.SetRefused, match="meanwhile"):
        published.publish(spark, root, {"a": spark.range(1)}, meanwhile)
    assert published.read_set(spark, root, "a")["a"].count() == 7


def test_rules_of_a_scan_set(spark, tmp_path):
    occurrences = spark.createDataFrame([(1, 1, "npm", "p", "m"), (1, 2, "npm", "q", "m")], "scan_id int, line_no int, ecosystem string, package_name string, manifest_path string")
    advisories = spark.createDataFrame([(1, 1, "X", 5), (1, 1, "X", 4), (1, 1, "", 3), (1, 2, None, 3)], "scan_id int, line_no int, osv_id string, cvss int")
    known = spark.createDataFrame([("npm", "p"), ("npm", "old")], "ecosystem string, package_name string")
    built = scan_set.build(occurrences, advisories, known, "scan_id", "line_no")
    published.publish(spark, f"{tmp_path}/s", built, scan_set.rules("scan_id", "line_no"))
    seen = published.read_set(spark, f"{tmp_path}/s", *scan_set.TABLES)
    assert {n: t.count() for n, t in seen.items()} == {"packages": 3, "manifests": 1, "occurrences": 2, "advisories": 1} and seen["advisories"].first().cvss == 4
    for name, rows_, rule in [
        ("occurrences", occurrences.union(occurrences), "occurrences are unique"), ("occurrences", occurrences.withColumn("package_name", F.lit("z")), "occurrences have packages"), ("occurrences", occurrences.where("line_no = 2"), "advisories have occurrences"),
        ("manifests", built["manifests"].where("false"), "occurrences have manifests"), ("manifests", built["manifests"].withColumn("n_occurrences", F.lit(9)), "manifests count occurrences"),
    ]:
        with pytest.raises(published.SetRefused, match=rule):
            published.publish(spark, f"{tmp_path}/s", {**built, name: rows_}, scan_set.rules("scan_id", "line_no"))
    assert published.read_set(spark, f"{tmp_path}/s", "packages")["packages"].count() == 3


def test_corpus_reasons_and_reuse(spark, tmp_path, monkeypatch):
    b64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
    long = "A changelog entry that is long enough to be kept as a chunk. "
    answers = [
        ("good", "CHANGELOG.md", "not_found", None, None, None), ("good", "HISTORY.md", "ok", 9, "base64", b64(long)), ("good", "README", "ok", 9, "base64", b64("never reached " * 9)),
        ("down", "CHANGELOG.md", "rate_limited", None, None, None), ("down", "README", "too_large", None, None, None), ("large", "README", "ok", 600_000, "base64", b64(long)), ("none", "README", "ok", 9, "base64", "!!"),
        ("inline", "README", "ok", 9, "none", ""), ("blank", "README", "ok", 9, "base64", b64(" \n ")), ("short", "README", "ok", 9, "base64", b64("short")), ("mute", "README", "ok", 9, "base64", b64("mute " + long)), ("later", "README", "ok", 9, "base64", b64(b"\xff" + long.encode())),
        ("saved", "CHANGELOG.md", "timeout", None, None, None), ("saved", "README", "ok", 9, "base64", b64("saved " + long)),
    ]
    frame = spark.createDataFrame([("o", r, a, s, n, e, c, a, "sha") for r, a, s, n, e, c in answers], "owner string, name string, asked string, status string, size long, encoding string, content string, path string, sha string")
    names = ["good", "down", "large", "none", "inline", "blank", "short", "mute", "later", "saved", "nothing"]
    packages = [("npm", n, f"https://github.com/o/{n}") for n in names] + [("npm", "elsewhere", "https://example.org/o/r"), ("npm", "unlinked", " "), ("pypi", "good", "o/good")]
    linked = spark.createDataFrame(packages, "ecosystem string, package_name string, link string")
    asked = spark.createDataFrame([("s1", e, n, "1.0") for e, n, _ in packages] + [("s1", "npm", "unknown", None), ("s2", "npm", "good", None), ("s2", "npm", "good", " ")], "scan_id string, ecosystem string, package_name string, resolved_version string")
    store = ChunkStore(f"{tmp_path}/c", 4)
    seen = []
    plain = corpus.chunk_documents

    def spied(documents, *a, **k):
        seen.append(documents.count())
        return plain(documents, *a, **k)

    monkeypatch.setattr(corpus, "chunk_documents", spied)
    embed = lambda c: c.withColumn("vector", F.when(~F.col("text").startswith("mute"), F.array(F.lit(1.0).cast("float"))))
    run = lambda: {(r.scan_id, r.ecosystem, r.package_name): (r.chunks, r.reason, r.reused) for r in corpus.ensure(asked, linked, frame, store, embed).collect()}
    assert {v for v in run().values()} == {(0, "store_unavailable", False)} and not seen
    store.create(spark)
    first = run()
    want = {"good": None, "down": "repository_unreachable", "large": "documents_too_large", "none": "no_documents", "inline": "documents_too_large", "blank": "no_documents", "short": "no_documents", "mute": "embedding_unavailable", "later": None, "saved": None, "nothing": "no_documents", "elsewhere": "not_github", "unlinked": "no_repository_url", "unknown": "no_repository_url"}
    assert {n: first["s1", "npm", n][1] for n in want} == want and {r for _, r, _ in first.values()} | {"store_unavailable"} == {None, *corpus.REASONS}
    assert first["s1", "pypi", "good"] == (1, None, False) and first["s2", "npm", "good"] == (1, None, False) and not any(v[2] for v in first.values())
    assert seen == [5]
    texts = {r.text for r in store.table.read(spark).collect()}
    assert any("�" in t for t in texts) and not any("never" in t for t in texts)
    second = run()
    again = {k for k, v in second.items() if v[2]}
    assert all(second[k] == (first[k][0], None, True) for k in again) and ("s1", "npm", "later") in again and seen[1] <= 3
    good = asked.where("package_name IN ('later', 'saved')")
    assert {(r.chunks, r.reused) for r in corpus.ensure(good, linked, frame, store, embed).collect()} == {(1, True)} and seen[2] == 0


ANSWER = "owner string, name string, asked string, status string, size long, encoding string, content string, path string, sha string"


def test_a_document_is_decoded_once(spark):
    lines = base64.encodebytes(b"\x0b\n " + b"word " * 40 + b"\r\n\t").decode()
    asked = [("r", "ok", lines), ("n", None, base64.b64encode(b"kept").decode()), ("w", "ok", base64.b64encode(b" \f\n").decode()), ("x", "ok", "!!"), ("e", "ok", None)]
    frame = spark.createDataFrame([("o", n, "README", s, 9, "base64", c, None, None) for n, s, c in asked], ANSWER)
    told = corpus.decoded(frame)
    assert {r.name: (r.outcome, r.text) for r in told.collect()} == {"r": ("found", ("word " * 40).strip()), "n": ("found", "kept"), "w": ("missing", None), "x": ("missing", None), "e": ("missing", None)}
    for found in (told, corpus.best_documents(frame)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("unbase64") == 1


def test_requests_are_computed_once_and_many_keys_meet_rows_by_marks(spark, tmp_path, monkeypatch):
    names = [f"p{n}" for n in range(40)]
    text = lambda n: base64.b64encode(f"A readme of {n} that is long enough to be kept as a chunk.".encode()).decode()
    answers = spark.createDataFrame([("o", n, "README", "ok", 9, "base64", text(n), "README", "sha") for n in [*names, *(f"q{i}" for i in range(400))]], ANSWER)
    packages = spark.createDataFrame([("npm", n, f"https://github.com/o/{n}") for n in [*names, "other"]] + [("npm", None, "o/p1"), ("npm", "p1", None)], "ecosystem string, package_name string, link string")
    asked = spark.createDataFrame([("s", "npm", n, "1") for n in [*names, "p1", "unknown", None]], "scan_id string, ecosystem string, package_name string, resolved_version string")
    evaluated, decoded = spark.sparkContext.accumulator(0), []

    def told(version):
        evaluated.add(1)
        return version

    counted = asked.withColumn("resolved_version", F.udf(told, "string")("resolved_version"))
    plain = corpus.decoded
    monkeypatch.setattr(corpus, "decoded", lambda rows: decoded.append((rows.count(), rows._jdf.queryExecution().optimizedPlan().toString())) or plain(rows))
    embed = lambda c: c.withColumn("vector", F.array(F.lit(1.0).cast("float")))
    run = lambda rows, label: sorted(map(tuple, corpus.ensure(rows, packages, answers, ChunkStore(f"{tmp_path}/{label}", 4).create(spark), embed).collect()), key=str)
    few = run(counted, "few")
    assert evaluated.value == 43 and len(few) == 42 and sum(r[4] for r in few) == 40
    assert sorted(str(r[2]) for r in few if r[5] == "no_repository_url") == ["None", "unknown"]
    monkeypatch.setattr(corpus, "MOST_SENT", 0)
    for marks in (1 << 24, 128):  # with few marks most keys share one, and no row is lost or added by that
        monkeypatch.setattr(corpus, "MARKS", marks)
        assert run(asked, f"many{marks}") == few
    assert [n for n, _ in decoded] == [40] * 3 and "bit_or" not in decoded[0][1] and "bit_or" in decoded[1][1]


def test_blank_rows_need_no_python_rows(spark, stored):
    assert "ExistingRDD" not in stored._blanks(spark, [1, 5])._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["__shard"] for r in stored._blanks(spark, [1, 5]).collect()) == [1, 5]


def test_dependencies_without_a_repository_meet_no_documents(spark, tmp_path, monkeypatch):
    seen, plain = {}, corpus._kept
    monkeypatch.setattr(corpus, "_kept", lambda df, path: seen.update({path.split("keelson-")[-1].split("-")[0]: df._jdf.queryExecution().optimizedPlan().toString()}) or plain(df, path))
    packages = spark.createDataFrame([("npm", "a", " "), ("npm", "b", "https://example.org/o/r")], "ecosystem string, package_name string, link string")
    asked = spark.createDataFrame([("s", "npm", n, None) for n in "abc"], "scan_id string, ecosystem string, package_name string, resolved_version string")
    found = corpus.ensure(asked, packages, spark.createDataFrame([], ANSWER), ChunkStore(f"{tmp_path}/c", 4).create(spark), lambda c: c.withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    assert {r.package_name: r.reason for r in found.collect()} == {"a": "no_repository_url", "b": "not_github", "c": "no_repository_url"}
    assert "Union" in seen["built"] and "isnull(owner" in seen["built"]
