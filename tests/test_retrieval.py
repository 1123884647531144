"""Chunking of awkward documents against its SQL."""

import duckdb
import pandas as pd

from keelson.catalog import QUERIES
from keelson.operators import retrieval

PARAGRAPH = "A line of changes that is long enough to fill some of a window, number {}."
AWKWARD = [
    None, "", "short", "# Title only\n\n## \n#no space\n####### seven\n" + "x" * 50, "intro " * 20 + "\n# One \t\n body body body body body body body body\n```sh\n# comment\n```\n## Two\nmore text of the second section here, yes",
    "x" * 3000, "\n\n".join(PARAGRAPH.format(n) for n in range(80)), "\n".join(PARAGRAPH.format(n) for n in range(80)), "# Same\n" + "repeat " * 10 + "\n# Same\n" + "repeat " * 10,
    "\r\n".join(["# Win", "", PARAGRAPH.format(1), "~~~", "# in", "~~~", "### Out  ", PARAGRAPH.format(2)]), "a\x0bb\x1cc\u2028# Sep\n" + "y" * 60, "  \n\n" + "word " * 900 + "\n\n  ", "\n".join("line %d" % n for n in range(30_000)), "\u00e9" * 1300 + "\n\n" + "\u4e2d" * 1300,
    "## Head\n" + "z" * 599 + "\n\n" + "q" * 598 + "\n\n" + "tail " * 100,
]


def test_chunks_of_awkward_documents():
    documents = pd.DataFrame({"doc_id": range(len(AWKWARD)), "text": AWKWARD})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(f"SELECT doc_id, chunk_index, heading, text FROM ({QUERIES['chunk_windows'].sql}) ORDER BY ALL").fetchall()
    got = [(n, i, heading, text) for n, whole in enumerate(AWKWARD) for i, (_, heading, text) in enumerate(retrieval.chunks_of(whole or "", "sha", "README.md"))]
    assert got == want and max(i for _, i, *_ in got) == retrieval.MOST_CHUNKS - 1
    assert ("# One", "## Two") == tuple(dict.fromkeys(h for n, _, h, _ in got if n == 4 and h))


def test_a_long_document_is_cut_to_its_end(spark):
    long = "\n".join("line %d" % n for n in range(30_000))
    documents = pd.DataFrame({"doc_id": [1, 2], "text": [long, "# Short\n" + "word " * 20]})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(f"SELECT doc_id, chunk_index, chunk_id, heading, text FROM ({QUERIES['chunk_windows'].sql}) ORDER BY ALL").fetchall()
    got = sorted(map(tuple, retrieval.chunk_documents(spark.createDataFrame(documents), "doc_id").collect()))
    assert got == want and len(got) > 300 and got[-2][4].endswith("line 29999")
    first = sorted(map(tuple, retrieval.chunk_documents(spark.createDataFrame(documents), "doc_id", most=retrieval.MOST_CHUNKS).collect()))
    assert first == [r for r in want if r[1] < retrieval.MOST_CHUNKS]


def test_chunks_of_a_long_document_leave_in_parts(monkeypatch, spark):
    monkeypatch.setattr(retrieval, "CHUNKS_AT_ONCE", 7)
    long = "\n".join("line %d" % n for n in range(3_000))
    got = retrieval.chunk_documents(spark.createDataFrame([(n, long) for n in range(3)], "id int, text string"), "id").collect()
    assert sorted((r.id, r.chunk_index, r.text) for r in got) == [(n, i, c[2]) for n in range(3) for i, c in enumerate(retrieval.chunks_of(long, "s", "p"))]
