"""Periodic runs, decontamination and the filter audit, against brute force and edge cases."""

import hashlib
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from keelson.llm import decontaminate, filter_audit, periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, runs string, row string, mask string, words string"


def docs(spark, rows):
    return spark.createDataFrame([(*row, "s", "clash", "clash", "clash", "clash", "clash") for row in rows], SCHEMA)


# Periodic runs


def plain_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(start, start + length - p)) for p in range(1, q)):
                found.append((start, length, q))
            i += i == start
    return sorted(found)


def plain_collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def some_words(rng):
    words = [rng.choice("abcde"[: rng.choice([1, 2, 2, 3, 5])]).encode() for _ in range(rng.randint(0, 50))]
    if rng.random() < 0.5:
        words += words[: rng.randint(1, 5)] * rng.randint(2, 7) + words[:3]
    return periodic_runs.planted_tail(rng.randrange(1000), words)


def test_runs_are_those_of_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        words = some_words(rng)
        runs = periodic_runs.runs_of(words)
        assert runs == plain_runs(words)
        assert periodic_runs.collapsed(words, runs) == plain_collapse(words, runs)


def test_long_runs():
    assert periodic_runs.runs_of([b"a"] * 50_000) == [(0, 50_000, 1)]
    unit = [str(i).encode() for i in range(700)]
    assert periodic_runs.runs_of([b"x", *unit * 30, b"0"]) == [(1, 21_001, 700)]
    assert periodic_runs.runs_of(unit * 3) == [] and periodic_runs.runs_of([b"a"] * 5) == []


def test_runs_query(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "é é\té é  é é", "a b " * 3 + "a", "a b " * 4 + "c", "x" * 100_000, *[b" ".join(some_words(rng)).decode() for _ in range(80)]]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(9, "a " * 20, "en"), (9, "a " * 20, "en"), (None, "a " * 20, None)]
    docs(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    want = []
    for doc, text, _ in rows:
        words = periodic_runs.planted_tail(doc, [w.encode() for w in WORD.findall(text or "")])
        runs = plain_runs(words)
        best = sorted(runs, key=lambda r: (-(r[1] * 5040 // r[2]), r[0], r[2]))[0] if runs else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(plain_collapse(words, runs))).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[1] > 1 for r in got)
    empty = periodic_runs.detect(docs(spark, rows).where("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "runs", "strongest", "collapsed"]


# Decontamination


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_contamination(rows, items):
    found = []
    for doc, text in rows:
        words, hit, ids = plain_words(text), set(), set()
        for item, item_text in items:
            w = plain_words(item_text)
            k = min(10, len(w))
            windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
            for i in range(len(words) - k + 1) if k else ():
                if tuple(words[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    ids |= {str(item)} if item is not None else set()
        found.append((doc, len(words), len(hit), sorted(ids)))
    return sorted(found, key=str)


@pytest.mark.parametrize("most_broadcast", [decontaminate.MOST_BROADCAST, 0])
@pytest.mark.parametrize("short_items", [False, True])
def test_contamination(spark, most_broadcast, short_items):
    rng = random.Random(12)
    vocabulary = ["alpha", "BETA", "Gamma", "ünï", "İst", "ΣΑΣ", "d4", "x"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(10, 40))) for i in range(12)] + [(3, text(12)), (20, None), (21, "?!"), (None, text(15))]
    items += [(30, items[0][1]), (31, items[0][1].upper())]
    if short_items:
        items += [(100 + k, " ".join(f"s{k}w{i}" for i in range(k))) for k in range(1, 10)] + [(9, "alpha beta")]
    rows = [(0, None), (1, ""), (2, "..."), (None, items[1][1]), (4, items[1][1]), (4, items[1][1])]
    for i in range(5, 60):
        of = rng.choice(items)[1] or ""
        cut = rng.randrange(len(of) + 1)
        rows.append((i, f"{text(rng.randint(0, 30))} {of[cut:] if rng.random() < 0.5 else of} {text(rng.randint(0, 9))}"))
    rows += [(70, " ".join(items[0][1].split()[:9])), (71, "s9w0 s9w1"), (72, text(3000))]
    bench = spark.createDataFrame([(i, t, "clash", "clash") for i, t in items], "item_id long, text string, words string, key string")
    got = decontaminate.contamination(docs(spark, [(i, t, "en") for i, t in rows]), bench, most_broadcast=most_broadcast)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=str)
    assert got == plain_contamination(rows, items)
    assert any(len(r[3]) > 1 for r in got) and any(r[2] == 0 < r[1] for r in got)


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    some = docs(spark, [(1, "a b c d e f g h i j k", "en")])
    assert decontaminate.contamination(some.where("false"), bench).count() == 0
    assert [tuple(r) for r in decontaminate.contamination(some, bench.where("false")).collect()] == [(1, 11, 0, [])]


def test_contamination_runs_no_python(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    seen = []
    plain = decontaminate.written

    def spied(df, label):
        seen.append(df._jdf.queryExecution().toString())
        return plain(df, label)

    decontaminate.written = spied
    try:
        seen.append(decontaminate.contamination(docs(spark, [(1, "a", "en")]), bench)._jdf.queryExecution().toString())
    finally:
        decontaminate.written = plain
    assert len(seen) == 6 and not any(word in plan for plan in seen for word in ("Python", "Arrow", "Pandas"))


# Filter audit


def plain_audit(rows, labels):
    said = lambda column: {doc for doc, *values in labels if doc is not None and values[column] == 1}
    good, toxic = said(0), said(1)
    texts = [t or "" for _, t, _ in rows]
    first = {}
    for (doc, _, _), t in zip(rows, texts):
        if doc is not None:
            first[t] = min(doc, first.get(t, doc))
    failing = []
    for (doc, _, lang), t in zip(rows, texts):
        words = WORD.findall(t)
        tests = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc is not None and first[t] < doc,
        }
        failing.append((lang or "", doc, {f for f, fails in tests.items() if fails}))
    found = {}
    for part in {p for p, _, _ in failing}:
        own = [(doc, fails) for p, doc, fails in failing if p == part]
        all_removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(d, x) for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                all_removed[f] += len(gone)
                redundant = sum(f in x for _, x in own) - len(gone)
                alone = sum(x == {f} for _, x in own)
                found[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), f]
        for key, row in found.items():
            if key[0] == part:
                row[-1] = all_removed[row[-1]] if isinstance(row[-1], str) else row[-1]
    return {key: tuple(row) for key, row in found.items()}


def test_audit(spark):
    rng = random.Random(13)
    unlike = " ".join(f"w{i}" for i in range(120))
    kinds = [unlike, unlike + " #", "W" + unlike.upper(), "a b " * 60, "a b " * 60 + "$", "short", "SHORT", "é É *", "", None, " \n", "x" * 50_000]
    rows = [(i, rng.choice(kinds), rng.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(7, unlike, "en"), (7, unlike, "en"), (7, unlike + " other", "fr"), (None, unlike, "en"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(7, 0, 0), (7, 1, 1), (None, 1, 1), (9999, 1, 1)]
    judged = spark.createDataFrame([(*row, "clash") for row in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs(spark, rows), judged).collect()}
    want = plain_audit(rows, labels)
    assert got == want and {p for p, _, _ in got} == {"en", "de", "", "fr"} and len(got) == 4 * 600
    assert any(row[2] for row in got.values()) and any(row[4] and row[5] for row in got.values())
    assert filter_audit.audit(docs(spark, rows).where("false"), judged).count() == 0
    unjudged = filter_audit.audit(docs(spark, rows), judged.where("false"))
    assert unjudged.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0) and unjudged.count() == len(got)


def test_ranks_are_minima():
    orders, ranks = filter_audit.removal_ranks(4)
    for order, row in zip(orders.tolist(), ranks.T.tolist()):
        assert row == [min((order.index(f) for f in range(4) if mask >> f & 1), default=4) for mask in range(16)]
