"""Operator 10: language identification by rank-order profiles.

Learning counts every letter n-gram (one to three characters, words padded with a blank)
of all training texts; the most frequent ``PROFILE`` of a language, ordered by count and
then by the n-gram itself, are its profile. A text is compared with each profile by the
out-of-place measure: for each of its own most frequent n-grams, how far its rank is from
the rank in the profile, ``PROFILE`` where the profile lacks it. The nearest profile wins,
the alphabetically first language among equals; the score is 1 - distance / worst distance.

Counting is done with arrays inside each piece of a batch, summed by Spark with map-side
combine. The model is languages x PROFILE rows: the labels must be a bounded set.

Defined results: a null text, one without letters and an empty model give ``und`` with
score 0; ties and repeated rows are decided alike; whole texts are read; other columns do
not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import Shared, by_piece, lean, with_columns

PROFILE = 400
UNKNOWN = "und"
CHAR_BITS = 21
MANY = 1 << 23


def _chars(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased characters with words parted by one blank each, number of the text of each)."""
    lowered = [t.lower() if t else "" for t in texts]
    flat = np.frombuffer((" " + "".join(t + " " for t in lowered)).encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in lowered])
    owner = np.r_[owner[:1], owner]
    known = np.flatnonzero(np.bincount(flat))
    blank = np.zeros(int(known[-1]) + 1, dtype=bool)
    blank[[c for c in known.tolist() if not chr(c).isalpha()]] = True
    gap = blank[flat]
    keep = ~(gap & np.r_[False, gap[:-1]])
    return np.where(gap, np.uint32(32), flat)[keep], owner[keep]


def _dense(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes ascending, position of each code among them)."""
    if most <= MANY:
        known = np.flatnonzero(np.bincount(codes, minlength=1))
        at = np.zeros(most + 1, dtype=np.int32)
        at[known] = np.arange(len(known), dtype=np.int32)
        return known, at[codes]
    known, at = np.unique(codes, return_inverse=True)
    return known, at.astype(np.int64)


def _joined(left: np.ndarray, right: np.ndarray, lefts: int, rights: int) -> np.ndarray:
    if lefts * rights >= 1 << 31:
        left = left.astype(np.int64)
    return left * rights + right


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each distinct n-gram, text number and n-gram number of each occurrence)."""
    chars, owner = _chars(texts)
    letters, one = _dense(chars, int(chars.max()) if len(chars) else 0)
    a = len(letters)
    real = chars != 32
    pair_known, two = _dense(_joined(one[:-1], one[1:], a, a), a * a)
    three_known, three = _dense(_joined(two[:-1], one[2:], len(pair_known), a), len(pair_known) * a) if len(two) > 1 else (one[:0], one[:0])
    codes = letters.astype(np.int64)
    pairs = codes[pair_known // a] << CHAR_BITS | codes[pair_known % a] if a else codes[:0]
    triples = pairs[three_known // a] << CHAR_BITS | codes[three_known % a] if a else codes[:0]
    first = np.where(real[:-1], owner[:-1], owner[1:])
    inner = real[1:-1] if len(three) else real[:0]
    docs = np.concatenate([owner[real], first, first[:-1][inner]])
    which = np.concatenate([one[real], two + a, three[inner] + a + len(pairs)])
    return np.concatenate([codes, pairs, triples]), docs, which


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, code, rank): the profiles of every language in ``labelled``."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        known = sorted(set(names))
        codes, docs, which = grams(texts)
        of = np.array([known.index(n) for n in names], dtype=np.int64)
        counts = np.bincount(of[docs] * len(codes) + which, minlength=len(known) * len(codes))
        hit = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([known[i] for i in hit // len(codes)], pa.string()), pa.array(codes[hit % len(codes)]), pa.array(counts[hit])], names=["lang", "code", "n"])

    usable = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null and text != ''")
    counted = usable.mapInArrow(lean(by_piece(fn)), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return counted.select("lang", "code", F.row_number().over(order).alias("rank")).where(F.col("rank") <= size)


class Profiles:
    """Ranks of all profiles by n-gram, as arrays."""

    def __init__(self, rows: list, size: int = PROFILE):
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        self.codes = np.unique(np.array([r["code"] for r in rows], dtype=np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int64)
        for r in rows:
            self.ranks[np.searchsorted(self.codes, r["code"]), self.langs.index(r["lang"])] = r["rank"]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        codes, docs, which = grams(texts)
        if not self.langs or not len(docs):
            return [UNKNOWN] * n, np.zeros(n)
        keys = np.sort(_joined(docs, which, n, len(codes)))
        edges = np.r_[0, np.flatnonzero(np.diff(keys)) + 1]
        counts, keys = np.diff(np.r_[edges, len(keys)]), keys[edges].astype(np.int64)
        docs, which = keys // len(codes), keys % len(codes)
        most = int(counts.max())
        if n * (most + 1) * len(codes) < 1 << 62:  # one number sorts by text, falling count, n-gram
            packed = np.sort((docs * (most + 1) + most - counts) * len(codes) + which)
            docs, which = packed // (len(codes) * (most + 1)), packed % len(codes)
        else:
            order = np.lexsort((which, -counts, docs))
            docs, which = docs[order], which[order]
        starts = np.r_[0, np.flatnonzero(np.diff(docs)) + 1]
        rank = np.arange(len(docs)) - np.repeat(starts, np.diff(np.r_[starts, len(docs)])) + 1
        top = rank <= self.size
        docs, which, rank = docs[top], which[top], rank[top]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at = np.where(self.codes[at] == codes, at, len(self.codes))
        own = self.ranks[at[which]]
        away = np.where(own < 0, self.size, np.abs(own - rank[:, None]))
        distance = np.stack([np.bincount(docs, weights=away[:, k], minlength=n) for k in range(len(self.langs))], axis=1)
        held = np.bincount(docs, minlength=n)
        best = distance.argmin(axis=1)
        score = 1 - distance[np.arange(n), best] / np.maximum(1, held * self.size)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, held)], np.where(held > 0, score, 0.0)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language and its score (replacing columns so named)."""
    shared = Shared(docs.sparkSession, profiles)
    keep = [c for c in docs.columns if c not in (lang_out, score_out)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = shared.value.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
        return with_columns(batch, keep, {lang_out: pa.array(langs, pa.string()), score_out: pa.array(scores)})

    return docs.select(*keep).mapInArrow(lean(by_piece(fn, text, 1 << 18)), schema)


def fit(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles from the documents outside the held-out third."""
    return Profiles(learn(docs.where(~held_out()), size=size).collect(), size)  # languages x size rows


def held_out() -> Column:
    """True for a third of the documents, by their id (false for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    asked = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(asked, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
