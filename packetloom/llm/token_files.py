"""Operator 2: token ids as binary blocks with Elias-Fano document boundaries.

A token table is a folder that Spark writes and commits, so it may lie in any store and
survives lost executors. Each row is one block of consecutive documents: their ids
concatenated (two bytes each when the vocabulary allows it) and two Elias-Fano sequences,
the document boundaries within the block and the document ids. A sequence of n values up
to u takes about 2 + log2(u / n) bits per value; every 64th set bit of the upper part is
sampled, so ``select`` reads one sample and a few words, with no 64-bit offset table.

Documents lie in ascending doc_id order over shards (range partitions), blocks and
positions. A block's offset within its shard is written with it; the offset of a shard is a
prefix sum over one row per shard, which is bounded by the number of partitions.

Encoding uses the tokenizers library. Its pre-tokens never cross white space, so its model
encodes each distinct lower-cased pre-token once per worker, which is remembered (bounded
size). Texts with characters beyond Latin letters, or with special tokens, go to the library whole.

Defined results: null and empty texts hold the end id alone; null doc_ids come first; rows
with equal doc_id lie in the order of their texts; no rows give no blocks. A long document
is never split: it makes a block of its own.
"""

from __future__ import annotations

import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.common import Shared, id_and_text, pieces

BLOCK_IDS = 1 << 20
REMEMBERED = 600_000
SAMPLE = 64
MAGIC = b"EFT1"
#: Pre-tokens of the vocabulary, over lower-cased text (fixed values).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
SPECIAL = regex.compile(r"<\|(?:startoftext|endoftext)\|>")
#: Letters up to here are lower-cased and composed alike by every library.
SIMPLE = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ňŊ-ž]*")


class EliasFano:
    """A non-decreasing sequence of unsigned integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<IBII", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of ``raw``, and its length in bytes."""
        n, low_bits, lows, highs = struct.unpack_from("<IBII", raw)
        at = struct.calcsize("<IBII")
        take = lambda count, kind: np.frombuffer(raw, dtype=kind, count=count, offset=at)
        low = take(lows, np.uint8)
        at += lows
        high = take(highs, np.uint8)
        at += highs
        samples = take(-(-n // SAMPLE), "<u4")
        return cls(n, low_bits, low, high, samples), at + samples.nbytes

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        word = int.from_bytes(self.low[at >> 3:(at + self.low_bits + 7) >> 3].tobytes(), "little")
        return (word >> (at & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value number ``i``, from one sample and the bits after it."""
        start, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        at, width = start >> 3, 32
        skip = start & 7
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[at:at + width], bitorder="little")[skip:])
            if len(ones) > rest:
                return (start + int(ones[rest]) - i) << self.low_bits | self._low(i)
            width *= 4

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n].astype(np.uint64)
        bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return ((ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)) | low


class WordEncoder:
    """Whole texts to ids; the library's model sees each distinct pre-token once."""

    def __init__(self, definition: str):
        self.definition = definition
        self.words: dict[str, bytes] = {}
        self.seen: dict[str, bytes] = {}
        self.library = None

    def __getstate__(self):
        return self.definition

    def __setstate__(self, definition):
        self.__init__(definition)

    def _load(self) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(self.definition)
        self.model = self.library.model
        self.split = regex.compile(PRE_TOKENS).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary shows as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {**{b: b for b in shown}, **{b: 256 + k for k, b in enumerate(hidden)}}

    def _pre_token(self, token: str) -> bytes:
        ids = self.seen.get(token)
        if ids is None:
            shown = token if token.isascii() else token.encode().decode("latin-1").translate(self.letters)
            coded = [t.id for t in self.model.tokenize(shown)]
            ids = self.seen[token] = struct.pack(f"<{len(coded)}I", *coded)
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.library is None:
            self._load()
        if not SIMPLE.fullmatch(text) or SPECIAL.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        found, words = unicodedata.normalize("NFC", text).lower().split(), self.words
        for memory in (words, self.seen):
            if len(memory) > REMEMBERED:
                memory.clear()
        for word in set(found).difference(words):
            words[word] = b"".join(map(self._pre_token, self.split(word)))
        return b"".join(map(words.__getitem__, found))


def _block(shard: int, number: int, before: int, ids: list[bytes], keys: list[int | None]) -> dict:
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    edges = np.cumsum([0] + [len(x) >> 2 for x in ids])
    nulls = sum(k is None for k in keys)
    known = np.array(keys[nulls:], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    gaps = known.astype(np.uint64) - np.array(first).astype(np.uint64)  # wraps to the true gap
    payload = b"".join([
        MAGIC, struct.pack("<BIq", width, nulls, first), EliasFano.of(edges).to_bytes(), EliasFano.of(gaps).to_bytes(),
        flat.astype(f"<u{width}").tobytes(),
    ])
    return {"shard": shard, "block": number, "ids_before": before, "n_ids": len(flat), "payload": payload}


class Block:
    """A written block: its documents' ids are reached through the boundaries."""

    def __init__(self, payload: bytes):
        raw = memoryview(payload)
        if raw[:4] != MAGIC:
            raise ValueError("not a token block")
        self.width, self.nulls, self.first = struct.unpack_from("<BIq", raw, 4)
        at = 4 + struct.calcsize("<BIq")
        self.edges, size = EliasFano.from_bytes(raw[at:])
        at += size
        self.gaps, size = EliasFano.from_bytes(raw[at:])
        self.ids = np.frombuffer(raw, dtype=f"<u{self.width}", offset=at + size)
        self.n_docs = self.edges.n - 1

    def doc_ids(self) -> list[int | None]:
        known = (self.gaps.values() + np.array(self.first).astype(np.uint64)).astype(np.int64)
        return [None] * self.nulls + known.tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.edges.select(i):self.edges.select(i + 1)]


BLOCK_SCHEMA = "shard int, block int, ids_before long, n_ids long, payload binary"


def write_tokens(docs: DataFrame, definition: str, end_id: int, path: str) -> None:
    """Encodes every document, in ascending doc_id order, into the token table at ``path``."""
    encoder = Shared(docs.sparkSession, WordEncoder(definition))
    placed = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    ordered = placed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def fn(batches):
        shard, number, before, ids, keys, held = TaskContext.get().partitionId(), 0, 0, [], [], 0
        emit = lambda: pa.RecordBatch.from_pylist([_block(shard, number, before, ids, keys)], schema=out)
        for batch in batches:
            for part in pieces(batch, "text"):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    coded = encoder.value.encode(text) + end
                    size = len(coded) >> 2
                    if ids and held + size > BLOCK_IDS:
                        yield emit()
                        number, before, ids, keys, held = number + 1, before + held, [], [], 0
                    ids.append(coded)
                    keys.append(key)
                    held += size
        if ids:
            yield emit()

    out = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
    ordered.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fn, BLOCK_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids_le): ids as little-endian unsigned 32-bit integers, ``start`` counting all ids before."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    bases = totals.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    based = blocks.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("ids_before")).alias("base"), "payload")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids_le", pa.binary())])

    def fn(batches):
        for batch in batches:
            for base, payload in zip(*(c for c in batch.columns)):
                block = Block(payload.as_py())
                edges = block.edges.values().astype(np.int64)
                keys, wide = block.doc_ids(), block.ids.astype("<u4")
                for lo in range(0, block.n_docs, 1024):
                    hi = min(lo + 1024, block.n_docs)
                    raw = [wide[a:b].tobytes() for a, b in zip(edges[lo:hi], edges[lo + 1:hi + 1])]
                    starts = edges[lo:hi] + base.as_py()
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi], pa.int64()), pa.array(starts), pa.array(raw, pa.binary())], schema=out)

    return based.mapInArrow(fn, "doc_id long, start long, ids_le binary")


def token_digests(tokens: DataFrame) -> DataFrame:
    """The contract's columns, from ids that were read back."""
    return tokens.select(
        "doc_id", "start", (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"), F.crc32("ids_le").alias("ids_crc32"),
    )
