"""Operator 9: dedup of repeated byte strings by a hash-compared suffix sort.

A sparse suffix array is enough to find every 400-byte string that starts twice: equal
windows have the same anchor, so only suffixes that start at anchors are sorted. Whole equal
runs of windows are found first (see ``repeats``). The suffixes of contested runs are sorted per
bucket by mergesort; two suffixes are compared by binary search for their common extension
over polynomial prefix hashes, so a comparison takes logarithmic time. The common
extensions of neighbours are then checked byte by byte, which settles hash collisions. A window
that begins d bytes before its anchor repeats if another suffix of the same anchor has a
common extension of the remaining length and equal d bytes before it.

The sort runs for all suffixes of a bucket at once in arrays. Anchors with more than ``CROWD``
contested runs would make a bucket large; their windows are looked up one by one through the
same index as runs, which spreads them over all buckets.

Texts are UTF-8 bytes. Defined results: null and empty texts have no bytes; texts under 400
bytes lose nothing; overlapping occurrences in one text count; repeated rows repeat each
other; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm import repeats
from packetloom.llm.common import lean, stored, unused
from packetloom.llm.hashes import BASES, BYTE, Prefix, Runs, mixed

WINDOW, GRAM, CROWD = 400, 200, 1000
SEGMENT = "bucket int, anchor long, doc long, key long, at int, lead int, count int, piece binary"


def byte_values(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE[data], edges


class Suffixes:
    """Suffixes of one byte array, each with a group that sorts first and an end."""

    def __init__(self, data: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.group, self.start, self.end = data, group, start, end
        values = BYTE[data]
        self.prefix, self.other = Prefix(values), Prefix(values, BASES[1])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, by binary search over prefix hashes."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), dtype=np.int64), np.minimum(self.end[x] - a, self.end[y] - b)
        while len(x) and (low < high).any():
            mid = (low + high + 1) // 2
            same = self.prefix.spans(a, a + mid) == self.prefix.spans(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y; equal ones by number."""
        size = self.common(x, y)
        a, b = self.start[x] + size, self.start[y] + size
        left = np.where(a < self.end[x], self.data[np.minimum(a, len(self.data) - 1)].astype(np.int64), -1)
        right = np.where(b < self.end[y], self.data[np.minimum(b, len(self.data) - 1)].astype(np.int64), -1)
        first = np.where(left != right, left < right, x < y)
        return np.where(self.group[x] != self.group[y], self.group[x] < self.group[y], first)

    def sorted(self) -> np.ndarray:
        """Mergesort, bottom up; all merges of a level run side by side, each element finding its rank in the other run."""
        n = len(self.start)
        order, width = np.argsort(self.group, kind="stable"), 1
        while width < n:
            place = np.arange(n)
            run = place // width
            other = run ^ 1
            low, high = np.minimum(other * width, n), np.minimum((other + 1) * width, n)
            base = low.copy()
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                mid = (low[k] + high[k]) // 2
                ahead = self.before(order[mid], order[k])
                low[k], high[k] = np.where(ahead, mid + 1, low[k]), np.where(ahead, high[k], mid)
            target = np.minimum(run, other) * width + (place - run * width) + (low - base)
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, width * 2
        return order

    def extensions(self, order: np.ndarray) -> np.ndarray:
        """Common extension of each suffix in ``order`` with the one before it, checked byte by byte."""
        out = np.zeros(len(order), dtype=np.int64)
        x, y = order[:-1], order[1:]
        size = np.where(self.group[x] == self.group[y], self.common(x, y), 0)
        for lo in range(0, len(size), 2048):
            part = slice(lo, lo + 2048)
            reach = np.arange(max(int(size[part].max()), 1))
            last = len(self.data) - 1
            differ = self.data[np.minimum(self.start[x[part], None] + reach, last)] != self.data[np.minimum(self.start[y[part], None] + reach, last)]
            differ &= reach < size[part, None]
            size[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), size[part])
        out[1:] = size
        return out


def repeated_windows(anchor: np.ndarray, piece: list[bytes], lead: np.ndarray, count: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window within it) of windows that another segment with the same anchor holds at the same distance."""
    edges = np.zeros(len(piece) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in piece], out=edges[1:])
    data = np.frombuffer(b"".join(piece), dtype=np.uint8)
    suffixes = Suffixes(data, anchor, edges[:-1] + lead, edges[1:])
    order = suffixes.sorted()
    ext = suffixes.extensions(order)
    rank = np.empty(len(order), dtype=np.int64)
    start, lead, count = suffixes.start[order], lead[order], count[order]
    found = []
    for ahead in range(int(lead.max()) + 1 if len(lead) else 0):
        live = (ahead <= lead) & (ahead > lead - count)
        if live.sum() < 2:
            continue
        rank[:] = np.cumsum(ext < width - ahead)  # suffixes that agree for the rest of the window
        k = np.flatnonzero(live)
        left = suffixes.prefix.spans(start[k] - ahead, start[k]) ^ mixed(suffixes.other.spans(start[k] - ahead, start[k]))
        code = mixed(left + mixed(rank[k].astype(np.uint64)))
        by = np.argsort(code)
        same = np.diff(code[by]) == 0
        k = k[by[np.r_[False, same] | np.r_[same, False]]]
        found.append((order[k], lead[k] - ahead))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compare(suspects: DataFrame, buckets: int, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Window answers for contested runs: sorted suffixes by bucket, or the index for crowded anchors."""

    def cut(batches):
        for batch in batches:
            for part, texts in repeats.unsqueezed(batch):
                data, edges = repeats.joined(texts)
                runs = Runs(*byte_values(data, edges), width, gram)
                lists = part.column(3).to_pylist()
                which = np.concatenate([np.searchsorted(runs.text, t) + np.unique(np.array(own, dtype=np.int64)) for t, own in enumerate(lists)])
                first, count, text = runs.first[which], runs.count[which], runs.text[which]
                raw = data.tobytes()
                piece = [raw[a:a + c - 1 + width] for a, c in zip((edges[text] + first).tolist(), count.tolist())]
                anchor = runs.anchor[which]
                yield pa.RecordBatch.from_arrays([
                    pa.array((anchor % np.uint64(buckets)).astype(np.int32)), pa.array(anchor.astype(np.int64)), pa.array(np.asarray(part.column(0))[text]), pa.array(np.asarray(part.column(1))[text]),
                    pa.array(first.astype(np.int32)), pa.array(runs.lead[which].astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(piece, pa.binary())],
                    names=["bucket", "anchor", "doc", "key", "at", "lead", "count", "piece"])

    segments = suspects.mapInArrow(lean(cut), SEGMENT)
    segments = stored(segments, "segments")
    crowded = segments.groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor")
    few = segments.join(crowded, "anchor", "left_anti").select(*segments.columns)
    many = segments.join(crowded, "anchor", "left_semi").select(*segments.columns)

    def sort(batches):
        for bucket in _buckets(batches):
            anchor, lead, count = (bucket.column(c).to_numpy() for c in (1, 5, 6))
            segment, window = repeated_windows(anchor, [x.as_buffer() for x in bucket.column(7)], lead.astype(np.int64), count.astype(np.int64), width)
            entries = {"doc": bucket.column(2).to_numpy()[segment], "key": bucket.column(3).to_numpy()[segment], "at": (bucket.column(4).to_numpy()[segment] + window).astype(np.uint32)}
            yield from repeats.answers(entries, np.ones(len(segment), dtype=bool), repeats.WINDOW, buckets)

    def single(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                data, edges = repeats.joined([x.as_py() for x in part.column(7)])
                count = np.asarray(part.column(6)).astype(np.int64)
                owner = np.repeat(np.arange(part.num_rows), count)
                step = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
                start = edges[owner] + step
                a, b = (mixed(Prefix(BYTE[data], base).spans(start, start + width)) for base in BASES)
                entries = {"doc": np.asarray(part.column(2))[owner], "key": np.asarray(part.column(3))[owner], "at": (np.asarray(part.column(4))[owner] + step).astype(np.uint32), "a": a, "b": b}
                yield from repeats.ask(entries, buckets, False, repeats.WINDOW)

    plain = few.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(sort), repeats.PACKED)
    return plain.unionByName(repeats.answered(many.mapInArrow(lean(single), repeats.PACKED), buckets, False, repeats.WINDOW))


def _buckets(batches):
    """Whole buckets of sorted rows."""
    held, at = [], None
    for batch in batches:
        own = batch.column(0).to_numpy()
        heads = np.flatnonzero(np.r_[True, np.diff(own) != 0]) if len(own) else []
        for lo, hi in zip(heads, np.r_[heads[1:], len(own)]):
            if held and own[lo] != at:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            at = own[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def remove(docs: DataFrame, carry: list[str] | None = None, width: int = WINDOW, gram: int = GRAM, words: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): removed byte runs, and the remaining bytes.

    A run of repeated ``width``-byte strings goes if it has ``words`` words or ``WINDOW`` bytes.
    """
    found = repeats.repeated(docs, byte_values, width, gram, False, lambda suspects, buckets: _compare(suspects, buckets, width, gram), carry)

    def fn(batches):
        for batch in batches:
            for part, texts in repeats.unsqueezed(batch):
                wholes, singles = part.column(2).to_pylist(), part.column(3).to_pylist()
                hit = [k for k in range(len(texts)) if wholes[k] or singles[k]]
                data, edges = repeats.joined([texts[k] for k in hit])
                runs = Runs(*byte_values(data, edges), width, gram)
                gone, spans, kept = [0] * len(texts), [[] for _ in texts], list(texts)
                for t, k in enumerate(hit):
                    own = data[edges[t]:edges[t + 1]]
                    mask = repeats.covered(runs, t, len(own), wholes[k], singles[k], width)
                    flips = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                    for a, b in flips.reshape(-1, 2):
                        mask[a:b] = b - a >= WINDOW or len(own[a:b].tobytes().split()) >= words
                    flips = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                    gone[k], kept[k] = int(mask.sum()), own[~mask].tobytes()
                    spans[k] = [{"start": int(a), "end": int(b)} for a, b in flips.reshape(-1, 2)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return found.mapInArrow(lean(fn), repeats.result_schema(found, "n_bytes", T.BinaryType()))


def remove_from(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, words: int = 0) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated bytes cut from ``text``; a character cut in two goes whole.

    A null text stays null.
    """
    carry = [c for c in docs.columns if c != "text"]
    absent = unused(docs, "absent")
    cut = remove(docs.withColumn(absent, F.col("text").isNull()), [*carry, absent], width, gram, words)

    @F.pandas_udf(T.StringType())
    def readable(kept):
        return kept.map(lambda raw: raw.decode("utf-8", "ignore"))

    text = F.when(F.col("doc_id").getField(absent), F.lit(None)).when(F.col("n_removed") > 0, readable("kept")).otherwise(F.col("kept").cast("string"))
    made = cut.select(*[F.col("doc_id").getField(c).alias(c) for c in carry], text.alias("text"))
    return made.select(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
