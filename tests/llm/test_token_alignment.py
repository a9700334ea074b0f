"""Operator 13 against tokenizers' own offsets and pairs found one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from packetloom.llm import token_alignment
from packetloom.llm.queries import op13_token_alignment
from tests.llm.cases import ROWS, documents, text_of

with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as source:
    DEFINITION = source.read()
with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as source:
    MODEL = source.read()


def plain(rows):
    """Expected rows of (doc_id, text)."""
    first = Tokenizer.from_str(DEFINITION)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    letters = token_alignment.byte_letters()
    shown = {i: w for w, i in first.get_vocab().items()}

    def spans(ids, raw):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(raw(i))))
            at = out[-1][1]
        return out

    bytes_a = lambda i: bytes(letters[c] for c in shown[i])
    bytes_b = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    done, holders = [], Counter()
    for doc, text in rows:
        text = text or ""
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        whole = (" " + text).encode()
        if not text or b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
            done.append((doc, [], [], [], []))
            continue
        at_a, at_b = spans(a, bytes_a), spans(b, bytes_b)
        ends = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, links, lo = [], [], 0
        for hi in ends:
            groups.append(",".join(str(i) for i, (_, e) in zip(a, at_a) if lo < e <= hi) + "|" + ",".join(str(i) for i, (_, e) in zip(b, at_b) if lo < e <= hi))
            lo = hi
        j = 0
        for i, (s, e) in zip(a, at_a):
            while at_b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and at_b[k][0] < e:
                links.append((i, b[k]))
                k += 1
        holders.update(set(links))
        done.append((doc, a, b, groups, links))
    top = defaultdict(int)
    for (i, _), n in holders.items():
        top[i] = max(top[i], n)
    out = []
    for doc, a, b, groups, links in done:
        best = sum(holders[x] == top[x[0]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(holders[x] for x in links), digest))
    return sorted(out, key=str)


def texts():
    rng = random.Random(4)
    words = ["Hello", "world", "été", "日本語", "naïve", "x" * 40, "1234567", "don't", "<|endoftext|>", "<s>", "🎉🎉", "..", "a▁b", " ", "tab\there", "\n\n", "ﬁ", "Straße", "don", "'t", "\x00"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 30]))) for _ in range(120)]
    return [(i, t) for i, t in enumerate([*out, "  two  spaces ", " ", "a", " a", "a ", "▁", "trailing\n", "a" * 3000, "日本" * 500, "<|endoftext|>", "é" * 5, text_of(3, 2000)])]


def got(spark, frame):
    return sorted((tuple(r) for r in token_alignment.digests(frame, DEFINITION, MODEL).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_hard_texts(spark):
    rows = texts()
    assert got(spark, spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, block int, a int").repartition(5)) == plain(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(d, t if t is None or len(t) < 4000 else t[:4000]) for d, t, _ in ROWS]
    assert got(spark, documents(spark, [(d, t, "en") for d, t in rows])) == plain(rows)


def test_empty_table(spark):
    assert got(spark, documents(spark, [])) == []


def test_small_blocks_and_a_forgetful_memory(spark, monkeypatch):
    rows = texts()[:60]
    monkeypatch.setattr(token_alignment, "REMEMBERED", 10)
    aligner = token_alignment.Aligner(DEFINITION, MODEL).ready()
    parts = [aligner.slice([t for _, t in rows[lo:lo + 7]]) for lo in range(0, 60, 7)]
    assert [tuple(int(p[c][k]) for c in token_alignment.DOC) for p in parts for k in range(len(p["groups"]))] == [r[1:5] for r in sorted(plain(rows), key=lambda r: r[0])]


def test_both_readers_of_the_definition_agree():
    level = token_alignment.ByteLevel(DEFINITION)
    assert level.quick is not None
    for _, t in texts():
        assert level.encode(" " + t) == level.library.encode(" " + t, add_special_tokens=False).ids


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_registered_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    short = [(d, t) for d, t in rows]
    found = sorted((tuple(r) for r in op13_token_alignment(spark, folder).collect()), key=str)
    want = plain(short)
    assert found == want
