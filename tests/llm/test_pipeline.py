"""The pipeline's stages keep what they should, and its queries are registered."""

import re
from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from pyspark.sql import functions as F

from tests.llm import cases


def test_stages_return_documents(spark):
    docs, folder = cases.documents(spark), "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
    ids = {r.doc_id for r in docs.collect()}
    assert {1, 7, 9, 12, 14} <= ids and not ids & {2, 4, 5, 6, 11}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in last} == ids and all(r.n_tokens == len(r.token_ids) for r in last)


def without_passages(rows, width, words):
    """Texts by doc_id, in plain Python."""
    seen = Counter(cases.raw(t)[i:i + width] for _, t, _ in rows for i in range(len(cases.raw(t)) - width + 1))
    out = {}
    for d, t, _ in rows:
        b = cases.raw(t)
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        kept, at = b"", 0
        for m in re.finditer(rb"\x01+", bytes(gone)):
            if m.end() - m.start() >= 400 or len(b[m.start():m.end()].split()) >= words:
                kept, at = kept + b[at:m.start()], m.end()
        out[d] = (kept + b[at:]).decode("utf-8", "ignore")
    return out


def test_passages_of_fifty_words_are_cut(spark):
    plain, short, line = cases.text_of(21, 51), " ".join("abcdefghij"[i * i % 10] for i in range(50)), cases.text_of(22, 30)
    own = lambda k: cases.text_of(k, 40)
    rows = [(1, f"{own(31)} {plain} {own(32)}", "en"), (2, f"{own(33)} {plain} {own(34)}", "en"), (3, f"{own(35)} {short} {own(36)}", "en"),
            (4, f"{own(37)} {short} {own(38)}", "en"), (5, f"{own(39)} {line} {own(40)}", "en"), (6, f"{own(41)} {line} {own(42)}", "en"),
            (7, own(43) + "日本" * 90, "en"), (8, own(44) + "日本" * 90, "en"), (9, None, "en"), (10, "", "en")]
    got = {r.doc_id: r for r in corpus_pipeline.repeated_bytes(spark, cases.documents(spark, rows), "").collect()}
    assert {d: r.text for d, r in got.items()} == without_passages(rows, 99, 50) | {9: None}
    assert all(plain not in got[d].text for d in (1, 2)) and all(short not in got[d].text for d in (3, 4)) and all(line in got[d].text for d in (5, 6))
    assert all(r.n_chars == len(r.text or "") for r in got.values())


def test_stages_meet_any_column_name(spark):
    taken = ("_doc_key", "_id", "_key", "_d", "_k", "_doc", "row", "doc", "own_key", "bad_id", "Absent", "_language", "_language_score")
    docs = cases.documents(spark).drop("key", "kind")
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(taken)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(tuple(r[c] for c in taken) == tuple(range(len(taken))) for r in rows), name


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
