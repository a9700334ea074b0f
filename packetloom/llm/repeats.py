"""Windows that occur elsewhere, over all documents: the shared part of operators 8 and 9.

A document's windows fall into runs (see ``Runs``); equal passages fall into equal runs, except
where a passage ends. So the search has two steps.

1. Every run is looked up by its anchor and content hash (128 bits together). Runs equal to
   another run are repeats as a whole. Runs that share an anchor with a different run are contested:
   some of their windows may still be equal.
2. Contested runs are compared window by window; how, is the operator's own.

Runs travel packed, one row per piece of input and bucket. Equal runs of one piece are settled
before the shuffle, so a passage that a third of all documents share sends one entry per piece; the
number of buckets grows with the bytes of text, so a bucket stays small. Answers go back packed
by document. Texts are compressed for the two joins with their answers: of documents with
contested runs for step 2, and of all documents at the end.

``smaller``: a window repeats if it starts in a document with a smaller id; otherwise if it starts
anywhere else, the same document included. A null id counts as larger than any other. Rows with
one id and different texts are different documents, neither smaller; repeated rows likewise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import lean, list_column, pieces, stored
from packetloom.llm.hashes import Runs, text_bytes

BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 256
ASKED, RUN, CONTESTED, WINDOW = range(4)
#: Columns of packed entries; the top bit of ``at`` and ``n`` says that a piece has met an entry several times.
TYPES = {"doc": "<i8", "key": "<i8", "at": "<u4", "a": "<u8", "b": "<u8", "sid": "<i8", "pivot": "<i8", "n": "<u4"}
ENTRY = ("doc", "key", "at", "a", "b")
ANSWER = ("doc", "key", "at")
MANY = np.uint32(1 << 31)
PACKED = "bucket int, kind int, packed binary"
ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary())])
Entries = dict[str, np.ndarray]
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def keyed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(doc, key, doc_id, text): an id that orders, and 64 bits of hash that tell apart rows with one id.

    With ``carry``, a struct of those columns travels in place of doc_id.
    """
    row = F.struct(*[docs[c] for c in carry]) if carry else F.col("doc_id")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("key"), row.alias("doc_id"), text.alias("text"))


def squeezed(base: DataFrame) -> DataFrame:
    """``base`` with compressed texts, for a shuffle."""

    def fn(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in pieces(batch, "text"):
                raw = [press.compress(x.as_buffer()) for x in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(raw, pa.binary())], names=["doc", "key", "doc_id", "small"])

    rows = base.select("doc", "key", "doc_id", "text")
    return rows.mapInArrow(lean(fn), T.StructType([*rows.schema.fields[:3], T.StructField("small", T.BinaryType())]))


def unsqueezed(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts as bytes, about ``most`` bytes together."""
    column = batch.column(batch.schema.get_field_index("small"))
    lo, size, texts = 0, 0, []
    press = zstandard.ZstdDecompressor()
    for k in range(batch.num_rows):
        texts.append(press.decompress(column[k].as_buffer()))
        size += len(texts[-1])
        if size >= most or k + 1 == batch.num_rows:
            yield batch.slice(lo, k + 1 - lo), texts
            lo, size, texts = k + 1, 0, []


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    edges = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=edges[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), edges


def bucket_count(base: DataFrame) -> int:
    total = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))


def pack(entries: Entries, kind: int, buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of entries, one per bucket, columns one after another."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    entries = {c: v[order] for c, v in entries.items()}
    heads = np.flatnonzero(np.r_[True, np.diff(buckets) != 0])
    raw = [b"".join(v[lo:hi].tobytes() for v in entries.values()) for lo, hi in zip(heads, np.r_[heads[1:], len(buckets)])]
    yield pa.RecordBatch.from_arrays([pa.array(buckets[heads].astype(np.int32)), pa.array(np.full(len(raw), kind, dtype=np.int32)), pa.array(raw, pa.binary())], schema=ARROW)


def unpack(rows: list[pa.Buffer], columns: tuple[str, ...]) -> Entries:
    types = [np.dtype(TYPES[c]) for c in columns]
    width = sum(t.itemsize for t in types)
    parts = []
    for raw in rows:
        n, at, own = raw.size // width, 0, []
        for t in types:
            own.append(np.frombuffer(raw, dtype=t, count=n, offset=at))
            at += n * t.itemsize
        parts.append(own)
    return {c: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=types[k]) for k, c in enumerate(columns)}


def chosen(entries: Entries, mask: np.ndarray, columns: tuple[str, ...]) -> Entries:
    return {c: entries[c][mask] for c in columns}


def answers(entries: Entries, mask: np.ndarray, kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
    own = chosen(entries, mask, ANSWER)
    own["at"] = own["at"] & ~MANY
    yield from pack(own, kind, (own["doc"] ^ own["key"]) % buckets)


def settle(entries: Entries, smaller: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks over entries: repeats, contested, and those that stand for all equal ones."""
    n = len(entries["a"])
    many = (entries["at"] & MANY) > 0
    repeat, contested, stands = many.copy(), np.zeros(n, dtype=bool), np.ones(n, dtype=bool)
    order = np.argsort(entries["a"])
    same = np.diff(entries["a"][order]) == 0
    order = order[np.r_[False, same] | np.r_[same, False]] if n else order
    if not len(order):
        return repeat, contested, stands
    order = order[np.lexsort((entries["doc"][order], entries["b"][order], entries["a"][order]))]
    a, b, docs = (entries[c][order] for c in ("a", "b", "doc"))
    new_a = np.r_[True, np.diff(a) != 0]
    new_b = new_a | np.r_[True, np.diff(b) != 0]
    heads, firsts = np.flatnonzero(new_b), np.flatnonzero(new_a)
    sizes = np.diff(np.r_[heads, len(order)])
    if smaller:
        hit = docs > np.repeat(docs[heads], sizes)
        stand = ~hit
    else:
        hit = np.repeat((sizes > 1) | np.logical_or.reduceat(many[order], heads), sizes)
        stand = new_b
    repeat[order] |= hit
    stands[order] = stand
    kinds = np.add.reduceat(new_b.astype(np.int64), firsts)
    contested[order] = stand & (np.repeat(kinds, np.diff(np.r_[firsts, len(order)])) > 1)
    return repeat, contested, stands


def ask(entries: Entries, buckets: int, smaller: bool, kind: int = RUN) -> Iterator[pa.RecordBatch]:
    """Entries of one piece: what it can settle alone, and the rest packed by bucket."""
    repeat, _, stands = settle(entries, smaller)
    yield from answers(entries, repeat, kind, buckets)
    if not smaller:
        entries["at"] = entries["at"] | np.where(repeat, MANY, np.uint32(0))
    sent = chosen(entries, stands, ENTRY)
    yield from pack(sent, ASKED, (sent["a"] % np.uint64(buckets)).astype(np.int64))


def by_bucket(batches: Iterator[pa.RecordBatch], skip: int | None = None):
    """(bucket, kind to packed rows) of sorted rows; batches of rows that need no work come as (None, batch)."""
    at, held = None, {}
    for batch in batches:
        ready = np.asarray(batch.column(1)) != skip if skip is not None else np.zeros(batch.num_rows, dtype=bool)
        if ready.any():
            yield None, batch.filter(pa.array(ready))
            batch = batch.filter(pa.array(~ready))
        for bucket, kind, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if bucket != at and held:
                yield at, held
                held = {}
            at = bucket
            held.setdefault(kind, []).append(raw.as_buffer())
    if held:
        yield at, held


def answered(asked: DataFrame, buckets: int, smaller: bool, kind: int = RUN) -> DataFrame:
    """Packed entries brought together by bucket; answers already known pass through."""

    def fn(batches):
        for bucket, held in by_bucket(batches, ASKED):
            if bucket is None:
                yield held
                continue
            entries = unpack(held[ASKED], ENTRY)
            repeat, contested, _ = settle(entries, smaller)
            yield from answers(entries, repeat & ((entries["at"] & MANY) == 0), kind, buckets)
            if kind == RUN:
                yield from answers(entries, contested, CONTESTED, buckets)

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(fn), PACKED)


def by_document(found: DataFrame) -> DataFrame:
    """(doc, key, runs, contested, windows): all answers of a document, in lists no longer than the document."""
    columns = ("runs", "contested", "windows")

    def fn(batches):
        for _, held in by_bucket(batches):
            parts = [unpack(held.get(kind, []), ANSWER) for kind in (RUN, CONTESTED, WINDOW)]
            doc, key, at = (np.concatenate([p[c] for p in parts]) for c in ANSWER)
            kind = np.repeat(np.arange(3), [len(p["doc"]) for p in parts])
            order = np.lexsort((at, kind, key, doc))
            doc, key, at, kind = doc[order], key[order], at[order], kind[order]
            heads = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(key) != 0)])
            owner = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(doc)]))
            lists = [list_column(at[kind == k].astype(np.int32), np.bincount(owner[kind == k], minlength=len(heads)), pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[heads]), pa.array(key[heads]), *lists], names=["doc", "key", *columns])

    lists = ", ".join(f"{c} array<int>" for c in columns)
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(fn), f"doc long, key long, {lists}")


def run_entries(runs: Runs, doc: np.ndarray, key: np.ndarray) -> Entries:
    return {"doc": doc[runs.text], "key": key[runs.text], "at": runs.ordinal.astype(np.uint32), "a": runs.anchor, "b": runs.content}


def repeated(docs: DataFrame, units: Units, window: int, gram: int, smaller: bool, compare, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, small, runs, windows) of every row; the lists are null where nothing repeats.

    ``runs`` are ordinals of whole repeated runs, ``windows`` starts of single repeated windows, ``small`` the text
    compressed. ``compare(suspects, buckets)`` gets (doc, key, small, contested) rows and returns packed WINDOW answers.
    """
    base = keyed(docs)
    buckets = bucket_count(base)
    whole = keyed(docs, carry)

    def fn(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                runs = Runs(*units(*text_bytes(part.column(2))), window, gram)
                yield from ask(run_entries(runs, np.asarray(part.column(0)), np.asarray(part.column(1))), buckets, smaller)

    asked = base.select("doc", "key", "text").mapInArrow(lean(fn), PACKED)
    found = stored(answered(asked, buckets, smaller), "runs")
    contested = by_document(found.where(F.col("kind") == CONTESTED)).select("doc", "key", "contested")
    suspects = squeezed(base).join(contested, ["doc", "key"]).select("doc", "key", "small", "contested")
    every = by_document(found.where(F.col("kind") == RUN).unionByName(compare(suspects, buckets)))
    return squeezed(whole).join(every.select("doc", "key", "runs", "windows"), ["doc", "key"], "left").select("doc_id", "small", "runs", "windows")


def covered(runs: Runs, text: int, n: int, whole: list[int] | None, single: list[int] | None, window: int) -> np.ndarray:
    """Mask over the ``n`` units of text number ``text``: those in a repeated window."""
    delta = np.zeros(n + 1, dtype=np.int64)
    if whole:
        which = np.searchsorted(runs.text, text) + np.unique(np.asarray(whole, dtype=np.int64))
        first = runs.first[which]
        np.add.at(delta, first, 1)
        np.add.at(delta, first + runs.count[which] - 1 + window, -1)
    if single:
        starts = np.unique(np.asarray(single, dtype=np.int64))
        np.add.at(delta, starts, 1)
        np.add.at(delta, starts + window, -1)
    return np.cumsum(delta[:-1]) > 0


def result_schema(found: DataFrame, count: str, kept: T.DataType) -> T.StructType:
    """Columns of a removal: the row's id, the count of its units, how many go, the stretches that go, and what stays."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return T.StructType([
        found.schema["doc_id"], T.StructField(count, T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(span)), T.StructField("kept", kept)])
