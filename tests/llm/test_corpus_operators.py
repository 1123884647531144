"""Token files, packing, Katz, SimHash, neighbours and the pipeline, against brute force and edge cases."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keelson.llm import grammar, katz, neighbours, packing, simhash
from keelson.llm.tokens import codec, tokenizer_path

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 6))) for _ in range(60)]
TEXTS = [" ".join(RNG.choice(VOCABULARY) for _ in range(RNG.randint(1, 400))) for _ in range(60)]
ODD = [None, "", " ", "\n", "two  blanks", "tab\there", " lead", "trail ", "a\n\nb", "a\x1cb c", "<|endoftext|> x", "don't we're 'S", "ΣΑΣ σας", "İstanbul", "naïve é ﬁ", "hi! ok?", "x" * 3000, "a.\nB c, d"]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 1, b"x") for i, t in zip(ids or range(len(texts)), texts)], "doc_id long, text string, lang string, source string, n_tokens int, ids binary")


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "blank"), ("word_bpe_49k.json", "word")])
def test_pieces_give_the_tokenizer_s_ids(name, kind):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    texts = [*TEXTS, *ODD, *TEXTS[:3]]
    ids, counts = codec(path, kind).encode(texts)
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for row in want for i in row]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "blank"), ("word_bpe_49k.json", "word")])
def test_a_column_gives_the_ids_of_its_texts(name, kind):
    import pyarrow as pa

    path = tokenizer_path(name)
    cut = ["a b\nc d", "b\nb", " led", "ended\n", "two  blanks", "a\n\nb", "<|endoftext|> x", "x\u3000y", "Word, word. don't", "", None, "\u00e9t\u00e9 \u0130x"]
    texts = [*TEXTS, *ODD, *cut, *["long " * 20_000 + " "], *TEXTS[:3]]
    ids, counts = codec(path, kind).encode(pa.array(["before", *texts], pa.string()).slice(1))
    want, sizes = codec(path, kind).encode(texts)
    assert counts.tolist() == sizes.tolist() and ids.tolist() == want.tolist()


def test_slices_hold_few_bytes_or_one_text(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(grammar, "BYTES_AT_ONCE", 10)
    texts = ["12345", None, "1234", "12", "x" * 40, "", "1"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": texts})
    assert [s.column(1).to_pylist() for s in grammar._slices(batch)] == [["12345", None, "1234"], ["12"], ["x" * 40], ["", "1"]]


def test_many_symbols_expand_as_single_ones():
    ids = np.tile(np.array([5, 6, 7, 9], np.uint32), 300)
    ids[::13] = 3
    symbols, _, rules = grammar.compress(ids, np.arange(len(ids)) == len(ids) - 1)
    many = np.concatenate([symbols] * (len(rules) // len(symbols) + 2))
    assert len(many) > len(rules) and grammar.expand(many, rules).tolist() == [i for s in many for i in grammar.expand(np.array([s]), rules)]


def test_grammar_round_trip():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        ids = rng.integers(0, [3, 50, 50000][seed % 3], rng.integers(1, 4000)).astype(np.uint32)
        if seed % 4 == 0:
            ids = np.tile(ids[:7], 500)
        last = rng.random(len(ids)) < 0.01
        last[-1] = True
        symbols, ends, rules = grammar.compress(ids, last, least=4)
        assert (grammar.expand(symbols, rules) == ids).all() and ends.sum() == last.sum()
        spans = grammar.spans_of(rules)
        assert all(len(grammar.expand(np.array([grammar.FIRST_NONTERMINAL + n]), rules)) == s for n, s in enumerate(spans[:50]))


def frequent_left(symbols, ends, least):
    """Pairs of unequal symbols inside documents that still occur ``least`` times or more."""
    counts = collections.Counter((int(a), int(b)) for a, b, e in zip(symbols[:-1], symbols[1:], ends[:-1]) if not e and a != b)
    return [p for p, n in counts.items() if n >= least]


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(1)
    # A passage that repeats in 1.5% of a shard that has nothing else to gain.
    ids, passage = rng.integers(1, 1 << 16, 100_000).astype(np.uint32), rng.integers(1, 1 << 16, 50)
    for n in range(30):
        ids[n * 3000 : n * 3000 + 50] = passage
    last = np.zeros(len(ids), bool)
    last[2999::3000] = last[-1] = True
    symbols, ends, rules = grammar.compress(ids, last)
    assert (grammar.expand(symbols, rules) == ids).all() and ends.sum() == last.sum()
    assert len(symbols) <= len(ids) - 30 * 49 and not frequent_left(symbols, ends, grammar.LEAST_PAIRS)
    # A run of one symbol halves in each round.
    symbols, ends, rules = grammar.compress(np.full(3000, 7, np.uint32), np.arange(3000) == 2999)
    assert len(rules) <= 12 and (grammar.expand(symbols, rules) == 7).all()


def test_grammar_replaces_a_pair_that_occurs_twice():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        ids = rng.integers(1, [3, 50, 50000][seed % 3], 6000).astype(np.uint32)
        ids[3000:3400] = ids[1000:1400]
        last = np.zeros(len(ids), bool)
        last[999::1000] = True
        symbols, ends, rules = grammar.compress(ids, last)
        assert (grammar.expand(symbols, rules) == ids).all() and ends.sum() == last.sum()
        assert not frequent_left(symbols, ends, 2)
    assert len(symbols) <= 6000 - 2 * 399


def test_random_access():
    counts = [5, 900, 1, 300]
    ids = np.tile(np.arange(11, dtype=np.uint32), 200)[: sum(counts)]
    shard = grammar.Shard(grammar._shard_row(0, 0, 0, [1, 2, None, 3], counts, ids))
    starts = np.cumsum(counts) - counts
    for n, (start, count) in enumerate(zip(starts, counts)):
        assert (shard.document(n) == ids[start : start + count]).all()
        for lo, length in ((0, count), (0, 1), (count // 2, count - count // 2), (count - 1, 1)):
            assert (shard.decode_range(n, lo, length) == ids[start + lo : start + lo + length]).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, *TEXTS]
    frame = docs(spark, texts, [None, *range(len(texts) - 2, -1, -1)])
    rows = sorted(grammar.encode_corpus(frame, shard_tokens=2000).collect(), key=lambda r: r.start)
    tokenizer, at = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 0
    want = sorted(((d is not None, d or 0, t) for d, t in frame.select("doc_id", "text").collect()), key=lambda x: x[:2])
    for row, (known, doc_id, text) in zip(rows, want, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (doc_id if known else None, at, len(ids), ids.tobytes())
        at += len(ids)
    assert grammar.encode_corpus(frame.where("false")).count() == 0


def test_best_filling():
    rng = random.Random(1)
    for _ in range(50):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        items = [n for n, c in counts.items() for _ in range(c)]
        reach = {0}
        for n in items:
            reach |= {s + n for s in reach if s + n <= room}
        got = packing.best_filling(counts, room)
        assert sum(n * c for n, c in got.items()) == max(reach) and all(c <= counts[n] for n, c in got.items())


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, *TEXTS, " ".join(TEXTS * 3), TEXTS[0], TEXTS[0]]
    rows = packing.pack_documents(docs(spark, texts), window=20_000).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for n, text in enumerate(texts):
        pieces = sorted(by_doc[n], key=lambda r: r.start)
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert b"".join(bytes(p.ids) for p in pieces) == ids.tobytes() and [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces[:-1]]]).tolist()
        assert {p.doc_tokens for p in pieces} == {len(ids)}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces[:-1]]]).tolist() and total <= 4096 and total & (total - 1) == 0
    assert sum(len(bytes(r.ids)) for r in packing.sequences(packing.pack_documents(docs(spark, texts))).collect()) == 4 * sum(r.length for r in rows)
    assert packing.pack_documents(docs(spark, texts).where("false")).count() == 0


def test_katz(spark):
    texts = [*TEXTS, "A a", None, "", "never seen words here", TEXTS[0]]
    rows = {r.doc_id: r for r in katz.score_documents(docs(spark, texts), katz.held_out(), slab_tokens=1500).collect()}
    held = {n: zlib.crc32(str(n).encode()) % 7 == 2 for n in range(len(texts))}
    words = {n: (t or "").encode().lower().split() + [b"\n"] for n, t in enumerate(texts)}
    single, pair, begins = collections.Counter(), collections.Counter(), 0
    for n, w in words.items():
        if not held[n]:
            begins += 1
            single.update(w)
            pair.update(zip([b"\r", *w[:-1]], w))
    total = single.total()

    def factors(counts):
        n = collections.Counter(counts.values())
        over = 6 * n[6] / n[1] if n[1] else 1
        absolute = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        out = {}
        for r in range(1, 6):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - over) / (1 - over) if n[r] and over != 1 else 0
            out[r] = d if 0 < d < 1 else max(0.05, 1 - max(absolute, 0.05) / r)
        return lambda c: out.get(c, 1.0)

    d1, d2 = factors(single), factors(pair)
    freed = sum(c * (1 - d1(c)) for c in single.values())
    scale, unknown = (1 / total, freed / total) if freed > 0 else (1 / (total + 1), 1 / (total + 1))
    p1 = lambda w: d1(single[w]) * single[w] * scale if w in single else unknown
    count = {**single, b"\r": begins}
    after = collections.defaultdict(dict)
    for (h, w), c in pair.items():
        after[h][w] = c

    def p2(w, h):
        if not after[h]:
            return p1(w)
        left = sum(c * (1 - d2(c)) for c in after[h].values())
        bare = left <= 1e-9
        below = count[h] + bare
        if w in after[h]:
            return d2(after[h][w]) * after[h][w] / below
        return (1 if bare else left) / below / (1 - sum(map(p1, after[h]))) * p1(w)

    for h in list(after)[:20]:
        every = sum(p2(w, h) for w in single) + p2(b"\0", h)
        assert every == pytest.approx(1)
    for n, w in words.items():
        r = rows[n]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[n], len(w), sum(x in single for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((single[x] + 1) / (total + len(single) + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p2(x, h)) for h, x in zip([b"\r", *w[:-1]], w)))
    assert katz.score_documents(docs(spark, texts).where("false"), katz.held_out()).count() == 0
    alone = katz.score_documents(docs(spark, ["a b"]), F.lit(True)).first()
    assert (alone.n_known, alone.train_tokens, alone.score) == (0, 0, 0.0)


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(n) for n in range(len(prints))]


def test_covering_masks_meet():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for a in range(64):
        for b in range(64):
            assert any(not (1 << a | 1 << b) & m for m in masks)


def test_links_of_planted_prints(spark):
    rng = random.Random(9)
    prints = []
    for _ in range(40):
        x = rng.getrandbits(64)
        prints.append(x)
        for _ in range(rng.randint(0, 6)):
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    prints = list(dict.fromkeys([0, (1 << 64) - 1, *prints]))
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    groups = collections.defaultdict(set)
    for p, c in zip(prints, plain_components(prints)):
        groups[c].add(simhash.signed(p))
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_simhash(spark):
    near = TEXTS[5].split()
    texts = [*ODD, *TEXTS, *TEXTS[:10], " ".join([*near[:-1], "zz"]), TEXTS[7].upper()]
    ids = [500 - n for n in range(len(texts))]
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts, ids)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    roots = plain_components(prints)
    least = {}
    for i, r in zip(ids, roots):
        least[r] = min(least.get(r, i), i)
    for i, p, r in zip(ids, prints, roots):
        assert rows[i].fp == simhash.signed(p) and rows[i].component_id == least[r]
    frame = docs(spark, texts, ids)
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    twice = docs(spark, ["same text of words", "same text of words", "quite another one now", "a b"], [7, 7, 7, None])
    assert sorted(str(r.text) for r in simhash.keep_first(twice).collect()) == ["a b", "quite another one now", "same text of words"]
    assert simhash.near_duplicates(frame.where("false")).count() == 0 and simhash.keep_first(frame.where("false")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(600, 16)).astype(np.float32)
    vectors[100:140] = vectors[3]
    vectors[200:206] = vectors[50] * 2
    rows = [(n, [float(x) for x in v], 1.0) for n, v in enumerate(vectors)]
    rows += [(900, None, 1.0), (950, [0.0] * 16, 1.0), (1000, [float("nan")] * 16, 1.0), (1050, [None] * 16, 1.0), (1100, [1.0] * 3, 1.0), (1150, [], 1.0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame, query=F.col("vec_id") % 50 == 0, block_rows=64).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 50))
    wide = vectors.astype(np.float64)
    hits = 0
    for q, found in got.items():
        score = neighbours.cosines(wide[q], wide)
        order = [int(n) for n in np.lexsort((np.arange(600), -score)) if n != q][:5]
        assert [r for r, *_ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(score[v], abs=1e-12) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(order))
    assert hits / (5 * len(got)) >= 0.9
    assert [v for _, v, _ in sorted(got[100])] == [3, 101, 102, 103, 104]
    assert neighbours.nearest(frame.where("false")).count() == 0
    assert neighbours.nearest(frame.where("vec_id < 3"), query=F.col("vec_id") == 0).count() == 2


@pytest.mark.parametrize("count", [4, 8, 203])
def test_every_query_gets_k_neighbours(spark, count):
    rng = np.random.default_rng(count)
    vectors = rng.normal(size=(count, 64))
    if count > 10:
        # A few queries beside one tight cluster.
        vectors[3:] = vectors[3] + rng.normal(size=(count - 3, 64)) * 0.01
    frame = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame, query=F.col("vec_id") < 8).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert sorted(got) == list(range(min(count, 8)))
    assert all([r for r, _ in sorted(found)] == list(range(1, min(5, count - 1) + 1)) for found in got.values())
    if count <= 5:
        for q, found in got.items():
            order = [int(n) for n in np.lexsort((np.arange(count), -neighbours.cosines(vectors[q], vectors))) if n != q]
            assert [v for _, v in sorted(found)] == order


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(41, 32))
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(vectors[:40])]
    rows += [(0, rows[0][1]), (1, [float(x) for x in vectors[40]]), (None, rows[2][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame, query=F.col("vec_id") < 3).collect():
        got[r.query_id].append((r.rank, r.vec_id, round(r.score, 9)))
    # Two rows of id 0 have one vector, so each finds the other; two of id 1 have two; a row without an id is none.
    assert [r for r, *_ in sorted(got[0])] == sorted([*range(1, 6), *range(1, 6)]) and [v for r, v, s in got[0] if s == 1] == [0, 0]
    assert len(got[1]) == 10 and not any(s == 1 for *_, s in got[1])
    assert len(got[2]) == 5 and not any(v in (2, None) for _, v, _ in got[2])
    wide = np.array([r[1] for r in rows[:-1]])
    for q, at in ((0, 0), (2, 2)):
        score = neighbours.cosines(wide[at], wide)
        order = [rows[n][0] for n in np.lexsort((np.arange(len(wide)), -score)) if n != at][:5]
        assert [v for _, v, _ in sorted(set(got[q]))] == order


def test_pipeline(spark):
    word = lambda: "".join(RNG.choice("abcdefghij") for _ in range(6))
    good = [" ".join(word() for _ in range(RNG.randint(60, 200))) for _ in range(40)]
    texts = [*good, good[0], good[1], "short", None, "bad$$$ word### " * 60, good[2] + " mail x.y@example.com", "a b c " * 50]
    frame = docs(spark, texts)
    held = frame
    columns = held.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held = stage(spark, held, "")
        if n < 4:
            assert held.columns == columns
        if n == 0:
            assert sorted(r.doc_id for r in held.collect()) == [*range(42), 45]
        if n == 1:
            kept = {r.doc_id for r in held.collect()}
            assert {*range(40)} - kept <= {2} and 40 not in kept and 41 not in kept
        if n == 2:
            assert "example.com" not in " ".join(r.text for r in held.collect())
    assert sum(r.length for r in held.collect()) > 0
