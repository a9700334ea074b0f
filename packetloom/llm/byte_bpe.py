"""Operator 5: byte-level BPE encoding and decoding with two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern. The first tier is a minimal
perfect hash over the vocabulary: a pre-token that is itself a token costs one probe and
one comparison. Other pre-tokens go to the second tier, a heap of mergeable neighbours
over a doubly linked list of bytes, which pops the lowest rank first (the leftmost among
equals) and so repeats the vocabulary's own merges in O(n log n).

No shuffle: every document is encoded where it is read. Tables are built once on the
driver from the vocabulary file (bounded by the vocabulary, not by the data) and broadcast,
so executors need no file. Results of pre-tokens seen lately are kept per worker in two
dictionaries of bounded size, of which the older goes when the newer is full.

Defined results: a null or empty text has no tokens; null ids decode to null; an id outside
the vocabulary raises; rows keep their other columns and their number; repeated rows are
encoded alike. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import Shared, by_piece, id_and_text, lean, list_column, with_columns

#: Pre-tokens of one dictionary, about 260 bytes each; a worker has two and keeps them between its tasks.
REMEMBERED, PIECE_IDS = 1 << 17, 1 << 18
WORD, SPREAD, MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class PerfectHash:
    """Minimal perfect hash (hash, displace): n keys to n slots, one displacement per bucket of about four keys."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for k, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(k)
        hashed = np.array(hashes, dtype=np.uint64)
        moves, slot_of = np.zeros(self.buckets, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        singles = []
        for bucket, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                singles.append((bucket, members[0]))
                continue
            d = 0
            while True:  # tries are vectorised: 256 displacements at a time
                slots = self._slots(hashed[members][:, None], np.arange(d, d + 256, dtype=np.uint64))
                good = (slot_of[slots] < 0).all(axis=0) & (np.diff(np.sort(slots, axis=0), axis=0) > 0).all(axis=0)
                if good.any():
                    break
                d += 256
                if d > 1 << 24:
                    raise ValueError("no displacement found: are keys repeated?")
            d += int(np.argmax(good))
            moves[bucket] = d
            slot_of[self._slots(hashed[members], np.full(len(members), d, dtype=np.uint64))] = members
        free = np.flatnonzero(slot_of < 0)
        for (bucket, key), slot in zip(singles, free):  # buckets of one key take what is left, named directly
            moves[bucket] = -int(slot) - 1
            slot_of[slot] = key
        self.moves, self.key_at = moves.tolist(), slot_of.tolist()

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        mixed = (h ^ (d * np.uint64(SPREAD))) * np.uint64(MIX)
        return ((mixed >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def candidate(self, key: bytes) -> int:
        """The only key number that ``key`` can have; the caller compares."""
        h = xxhash.xxh64_intdigest(key)
        d = self.moves[h % self.buckets]
        return self.key_at[-d - 1 if d < 0 else ((((h ^ (d * SPREAD & WORD)) * MIX & WORD) >> 32) % self.n)]


class Vocabulary:
    """Tokens by rank, their perfect hash and their merges. Ranks are token ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.ids = pattern, sorted(ranks.values())
        self.tokens = {i: t for t, i in ranks.items()}
        keys = [self.tokens[i] for i in self.ids]
        self.hash = PerfectHash(keys)
        self.single = [ranks[bytes([b])] for b in range(256)]
        self._ready()

    def _ready(self) -> None:
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.merges: list[dict[int, int]] | None = None
        self.split = None
        self.listed: pa.Array | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "older", "merges", "split", "listed")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _pairs(self) -> list[dict[int, int]]:
        """For each left id, right neighbour to the id of their union."""
        rank = {t: i for i, t in self.tokens.items()}
        found: list[dict[int, int]] = [{} for _ in range(max(self.ids) + 1)]
        for token, i in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    found[a][b] = i
        return found

    def merged(self, piece: bytes) -> list[int]:
        """Second tier: merge neighbours by rank over linked bytes."""
        if self.merges is None:
            self.merges = self._pairs()
        union, last = self.merges, len(piece) - 1
        ids = list(map(self.single.__getitem__, piece))
        after, before = list(range(1, last + 2)), list(range(-1, last))
        ranks = [union[a].get(b, -1) for a, b in zip(ids, ids[1:])]  # of each live pair, by its left end
        ranks.append(-1)
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if ranks[i] != r:
                continue  # a neighbour has changed since this entry was made
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], ranks[j] = r, -1, -1
            if k <= last:
                before[k] = i
                ranks[i] = x = union[r].get(ids[k], -1)
                if x >= 0:
                    heapq.heappush(heap, x << 32 | i)
            else:
                ranks[i] = -1
            k = before[i]
            if k >= 0:
                ranks[k] = x = union[ids[k]].get(r, -1)
                if x >= 0:
                    heapq.heappush(heap, x << 32 | k)
        return [i for i in ids if i >= 0]

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        raw = piece.encode()
        first = self.ids[self.hash.candidate(raw)]
        ids = [first] if self.tokens[first] == raw else self.merged(raw)
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str) -> bytes:
        if self.split is None:
            self.split = regex.compile(self.pattern).findall
        if len(self.seen) > REMEMBERED:
            self.seen, self.older = {}, self.seen
        found, seen, older = self.split(text), self.seen, self.older
        for piece in set(found).difference(seen):
            seen[piece] = older.get(piece) or self.piece_ids(piece)
        return b"".join(map(seen.__getitem__, found))

    def decode(self, lists: pa.Array) -> pa.Array:
        """The bytes of each list of ids: tokens gathered from one array, cut at the lists' edges."""
        if self.listed is None:
            self.listed = pa.array([self.tokens.get(i) for i in range(max(self.ids) + 1)], pa.large_binary())
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
        found = self.listed.take(lists.flatten())
        if found.null_count:
            raise ValueError("an id is outside the vocabulary")
        edges = np.zeros(len(lists) + 1, dtype=np.int64)
        np.cumsum(lengths, out=edges[1:])
        at = np.frombuffer(found.buffers()[1], dtype=np.int64)[edges] if len(found) else edges
        absent = pc.is_null(lists).to_numpy(zero_copy_only=False)
        whole = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(lists), [pa.array(~absent).buffers()[1], pa.py_buffer(np.ascontiguousarray(at)), found.buffers()[2] or pa.py_buffer(b"")], int(absent.sum()))
        return whole.cast(pa.binary())


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return Vocabulary(ranks, pattern)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Rows of ``docs`` without ``text``, with their ids in ``out`` (which replaces a column of that name)."""
    shared = Shared(docs.sparkSession, vocabulary)
    keep = [c for c in docs.columns if c not in (text, out)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = shared.value
        coded = [vocab.encode(t) if t else b"" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        lengths = np.array([len(c) >> 2 for c in coded], dtype=np.int64)
        return with_columns(batch, keep, {out: list_column(np.frombuffer(b"".join(coded), dtype="<i4"), lengths, pa.int32())})

    return docs.select(*keep, text).mapInArrow(lean(by_piece(fn, text)), schema)


def decode(coded: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Rows of ``coded`` without ``ids``, with the bytes they stand for in ``out``."""
    shared = Shared(coded.sparkSession, vocabulary)
    keep = [c for c in coded.columns if c not in (ids, out)]
    schema = T.StructType([coded.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def fn(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            group = np.cumsum(sizes) // PIECE_IDS
            edges = np.flatnonzero(np.diff(group)) + 1
            for lo, hi in zip(np.r_[0, edges], np.r_[edges, batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                yield with_columns(part, keep, {out: shared.value.decode(part.column(part.schema.get_field_index(ids)))})

    return coded.select(*keep, ids).mapInArrow(fn, schema)


def encode_and_decode(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's digests per document, from real ids and really decoded bytes."""
    vocabulary = read_vocabulary(path, pattern)
    coded = encode(id_and_text(docs), vocabulary)
    listed = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    digests = coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        "token_ids",
    )
    return decode(digests, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
