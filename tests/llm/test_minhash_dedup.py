"""Operator 11 against all pairs of plain shingle sets."""

import random

import numpy as np
import pytest

from packetloom.llm import minhash_dedup
from packetloom.llm.queries import op11_minhash_dedup
from tests.llm.cases import ROWS, documents, jaccard_components, text_of


def found(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def expected(rows, width, percent):
    return sorted(((d, n, c, d == c) for d, n, c in jaccard_components(rows, width, percent)), key=str)


def edited(text, rng, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_hard_rows(spark):
    assert found(minhash_dedup.near_duplicates(documents(spark), 3, 85)) == expected(ROWS, 3, 85)


def test_chains_and_edge_of_the_threshold(spark):
    rng = random.Random(5)
    rows, text = [], text_of(11, 300)
    for k in range(60):  # a chain: neighbours are close, its ends are not
        rows.append((k, text, "en"))
        text = edited(text, rng, rng.choice([1, 3, 7, 9]))
    rows += [(100 + k, edited(rows[0][1], rng, k % 20), "en") for k in range(60)]
    rng.shuffle(rows)
    assert found(minhash_dedup.near_duplicates(documents(spark, rows), 3, 85)) == expected(rows, 3, 85)


@pytest.mark.parametrize("crowd", [8, 4096])
def test_crowded_buckets(spark, monkeypatch, crowd):
    monkeypatch.setattr(minhash_dedup, "CROWD", crowd)
    rng = random.Random(6)
    shared = text_of(21, 400)
    rows = [(k, f"{shared} {text_of(1000 + k // 3, 90)} {rng.random()}", "en") for k in range(60)]  # one passage, different ends
    assert found(minhash_dedup.near_duplicates(documents(spark, rows), 3, 85)) == expected(rows, 3, 85)


def test_empty_table(spark):
    assert found(minhash_dedup.near_duplicates(documents(spark, []), 3, 85)) == []


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    a = " ".join(f"v{i}" for i in rng.integers(0, 10**9, 3000))
    b = a[:len(a) * 9 // 10]
    data = np.frombuffer((a + b).encode(), dtype=np.uint8)
    sets = minhash_dedup.Sets(data, np.array([0, len(a), len(a) + len(b)]), 3)
    least = minhash_dedup.minima(sets)
    share = len(np.intersect1d(*(sets.hash[sets.edges[k]:sets.edges[k + 1]] for k in range(2)))) / sets.sizes.max()
    assert abs((least[0] == least[1]).mean() - share) < 0.1


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert found(op11_minhash_dedup(spark, folder)) == expected(rows, 3, 85)
