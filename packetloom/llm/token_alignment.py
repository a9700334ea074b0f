"""Operator 13: two tokenizations of one text aligned, by whitespace-token anchors.

Each text is tokenised whole by a byte-level BPE definition (A, over a space and the text) and by a sentencepiece
model (B, which adds the space itself). Where a token of A and a token of B end at the same byte and the next token of
both starts with a space, the text is cut: the windows between such anchors are mostly single words, so the same
windows come back all the time. A window is known by its ids in A and B; its groups and overlapping pairs are worked out once
and remembered by the id tuples. Windows of a piece of input are brought together by a hash and compared id by id
before they share an alignment.

Counts of id pairs are counts of documents over the whole corpus. A block (some megabytes of text) sends each of
its pairs once, with the number of its documents that hold it; totals, and the highest total of each A id, go back to
the block in the same way. So the rows shuffled follow the pairs of a block, not the pairs of documents, and a pair held by every
document is one row per block.

Defined results: texts that are null or empty, or whose tokens in A or B do not join to a space and the text, have no tokens, zero counts and
null ``groups``; rows with the same id, and repeated rows, are separate documents; columns other than id and text are not read. A special
token's string in a text is plain text. Long texts are windows like any others; a text without spaces is one window.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from packetloom.llm.common import Shared, pieces, stored
from packetloom.llm.hashes import Prefix, mixed

BLOCK_BYTES, SLICE_BYTES, REMEMBERED = 8 << 20, 1 << 20, 1_000_000  # bytes of text, of text, ids in remembered windows
MARK = "▁"
#: Pre-tokens of the byte-level scheme: fixed by that public format.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks whose letters and digits are the same in every Unicode version of the two libraries.
SETTLED = regex.compile(r"[\x00-ɏΐ-ώЀ-џ -⁯ぁ-ゖァ-ヺ一-龥가-힣]*")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TokenTable:
    """What each id stands for: bytes, their number, and whether they start with a space; and its text inside and at the end of a group."""

    def __init__(self, tokens: list[bytes], signs: str):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens])
        self.signed = [f"{i}{sign}" for i in range(len(tokens)) for sign in signs]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class ByteLevel:
    """Ids of a byte-level BPE definition. Its ranks are read by a second, faster library wherever both are known to agree."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        parsed, letters = json.loads(definition), byte_letters()
        vocabulary = parsed["model"]["vocab"]
        special = {t["content"] for t in parsed.get("added_tokens", [])}
        tokens = [b""] * (max([*vocabulary.values(), *(t["id"] for t in parsed.get("added_tokens", []))]) + 1)
        for t in parsed.get("added_tokens", []):
            tokens[t["id"]] = t["content"].encode()
        ranks = {}
        for word, i in vocabulary.items():
            if word not in special:
                tokens[i] = bytes(letters[c] for c in word)
                ranks[tokens[i]] = i
        self.table = TokenTable(tokens, ",|")
        merges = [m if isinstance(m, list) else m.split(" ") for m in parsed["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        rule = parsed.get("pre_tokenizer") or {}
        alike = (
            parsed.get("normalizer") is None and rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
            and not parsed["model"].get("dropout") and made == sorted(made) and len(set(made)) == len(ranks) - 256
        )
        self.quick = None
        if alike:
            import tiktoken

            self.quick = tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.quick is not None and SETTLED.fullmatch(text):
            return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        tokens = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace(MARK, " ").encode())
        self.table = TokenTable(tokens, ",;")

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


def flat_spans(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all stretches, one after another."""
    return np.arange(size.sum()) + np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) if len(size) else np.zeros(0, dtype=np.int64)


def window_alignments(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, table_a: TokenTable, table_b: TokenTable) -> list[tuple[str, bytes, int]]:
    """(groups as text, overlapping pairs as 64-bit a << 32 | b, number of groups) of every window; ``a`` and ``b`` hold the windows' ids one after another.

    Both sides of a window cover the same bytes, so ends are compared over all windows at once: between two
    neighbouring ends of either side lies exactly one overlapping pair, and a shared end closes a group.
    """
    end_a, end_b = np.cumsum(table_a.length[a]), np.cumsum(table_b.length[b])
    ends = np.union1d(end_a, end_b)
    link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    links = (a[link_a].astype(np.int64) << 32 | b[link_b]).tobytes()
    shared = np.flatnonzero((end_a[link_a] == ends) & (end_b[link_b] == ends))
    last_a, last_b = link_a[shared], link_b[shared]
    # a group's ids of A, then those of B: each id's text ends with the sign that follows it
    group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
    closes_a, closes_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    closes_a[last_a], closes_b[last_b] = 1, 1
    order = np.empty(len(a) + len(b), dtype=np.int64)
    order[np.arange(len(a)) + np.r_[0, last_b + 1][group_a]] = 2 * a + closes_a
    order[np.arange(len(b)) + last_a[group_b] + 1] = 2 * b + closes_b + len(table_a.signed)
    signed = table_a.signed + table_b.signed
    written = list(map(signed.__getitem__, order.tolist()))
    top_a, top_b = np.cumsum(size_a), np.cumsum(size_b)
    top = end_a[top_a - 1]
    hi_link, hi_group, hi_id = np.searchsorted(ends, top) + 1, np.searchsorted(ends[shared], top) + 1, top_a + top_b
    bounds = zip(*(x.tolist() for x in (np.r_[0, hi_id[:-1]], hi_id, 8 * np.r_[0, hi_link[:-1]], 8 * hi_link, np.diff(hi_group, prepend=0))))
    return [("".join(written[p:q])[:-1], links[x:y], n) for p, q, x, y, n in bounds]


class Aligner:
    """Both tokenizers and the windows seen so far; made once per Python worker."""

    def __init__(self, definition: str, model: bytes):
        self.source = definition, model
        self.a = self.b = None

    def __getstate__(self):
        return self.source

    def __setstate__(self, source):
        self.__init__(*source)

    def ready(self) -> Aligner:
        if self.a is None:
            self.a, self.b = ByteLevel(self.source[0]), Pieces(self.source[1])
            self.known: dict[tuple[bytes, bytes], tuple[str, bytes, int]] = {}
            self.held = 0
        return self

    def windows(self, a: np.ndarray, b: np.ndarray, bounds: tuple[np.ndarray, ...]) -> list[tuple[str, bytes, int]]:
        """Alignments of the windows with these bounds (lo and hi in ``a``, then in ``b``): remembered ones, the others worked out together."""
        raw_a, raw_b, get = a.tobytes(), b.tobytes(), self.known.get
        keys = [(raw_a[p:q], raw_b[r:s]) for p, q, r, s in zip(*((4 * x).tolist() for x in bounds))]
        found = list(map(get, keys))
        new = np.array([k for k, f in enumerate(found) if f is None], dtype=np.int64)
        if len(new):
            lo_a, hi_a, lo_b, hi_b = (x[new] for x in bounds)
            size_a, size_b = hi_a - lo_a, hi_b - lo_b
            fresh = window_alignments(a[flat_spans(lo_a, size_a)], b[flat_spans(lo_b, size_b)], size_a, size_b, self.a.table, self.b.table)
            self.held += int(size_a.sum() + size_b.sum())
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = int(size_a.sum() + size_b.sum())
            for k, f in zip(new.tolist(), fresh):
                found[k] = self.known[keys[k]] = f
        return found

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]] | None]:
        """Ids in A and B of each text, None where they do not stand for a space and the text."""
        out = []
        for t in texts:
            whole = b" " + (t or "").encode()
            ids = self.b.encode(t) if t else []
            own = self.a.encode(" " + t) if self.b.table.joined(ids) == whole else []
            out.append((own, ids) if t and self.a.table.joined(own) == whole else None)
        return out

    def slice(self, texts: list[str | None]) -> dict:
        """Per text: sizes and groups; and the distinct pairs of each text with their number."""
        coded = self.tokens(texts)
        good = [k for k, c in enumerate(coded) if c is not None]
        n = len(texts)
        out = {"n_a": np.zeros(n, np.int64), "n_b": np.zeros(n, np.int64), "n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64), "groups": [None] * n}
        out |= {"doc": np.zeros(0, np.int64), "pair": np.zeros(0, np.int64), "times": np.zeros(0, np.int64), "codes": np.zeros(0, np.int64)}
        if not good:
            return out
        size_a, size_b = (np.array([len(coded[k][s]) for k in good]) for s in (0, 1))
        out["n_a"][good], out["n_b"][good] = size_a, size_b
        a, b = (np.concatenate([np.array(coded[k][s], dtype=np.int32) for k in good]) for s in (0, 1))
        end_a, end_b = np.cumsum(self.a.table.length[a]), np.cumsum(self.b.table.length[b])
        # both ends, after the last token of each: positions in the texts joined, so a text's end is always shared
        both, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        last = np.searchsorted(both, end_a[np.cumsum(size_a) - 1])
        spaced_a, spaced_b = np.r_[self.a.table.spaced[a], True], np.r_[self.b.table.spaced[b], True]
        anchor = spaced_a[at_a + 1] & spaced_b[at_b + 1]
        anchor[last] = True
        hi_a, hi_b = at_a[anchor] + 1, at_b[anchor] + 1
        lo_a, lo_b = np.r_[0, hi_a[:-1]], np.r_[0, hi_b[:-1]]
        owner = np.searchsorted(np.cumsum(size_a), lo_a, side="right")
        index, kinds = self._kinds(a, b, lo_a, hi_a, lo_b, hi_b)
        sizes, groups = np.array([len(k[1]) >> 3 for k in kinds]), np.array([k[2] for k in kinds])
        out["n_groups"][good] = np.bincount(owner, weights=groups[index], minlength=len(good)).astype(np.int64)
        out["n_links"][good] = np.bincount(owner, weights=sizes[index], minlength=len(good)).astype(np.int64)
        texts_of, heads = [k[0] for k in kinds], np.searchsorted(owner, np.arange(len(good) + 1))
        for k, lo, hi in zip(good, heads[:-1].tolist(), heads[1:].tolist()):
            out["groups"][k] = ";".join(map(texts_of.__getitem__, index[lo:hi].tolist()))
        codes, code_of = np.unique(np.frombuffer(b"".join([k[1] for k in kinds]), dtype=np.int64), return_inverse=True)
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        many = sizes[index]
        entry, times = np.unique(np.repeat(np.array(good)[owner], many) << 32 | code_of[flat_spans(first[index], many)], return_counts=True)
        return out | {"doc": entry >> 32, "pair": entry & 0xFFFFFFFF, "times": times, "codes": codes}

    def _kinds(self, a, b, lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, list[tuple[str, bytes, int]]]:
        """(kind of every window, alignment of every kind)."""
        size_a, size_b = hi_a - lo_a, hi_b - lo_b
        spread = lambda x, salt: mixed(x.astype(np.uint64) + np.uint64(salt)) | np.uint64(1)
        name = mixed(Prefix(spread(a, 1)).spans(lo_a, hi_a) + (size_a << 32 | size_b).astype(np.uint64)) + mixed(Prefix(spread(b, 1 << 40)).spans(lo_b, hi_b))
        _, head, index = np.unique(name, return_index=True, return_inverse=True)
        model = head[index]
        same = (size_a == size_a[model]) & (size_b == size_b[model])
        for ids, lo, size in ((a, lo_a, size_a), (b, lo_b, size_b)):
            here, there = flat_spans(lo, size), np.minimum(flat_spans(lo[model], size), len(ids) - 1)
            wrong = np.flatnonzero(ids[here] != ids[there])
            same[np.searchsorted(np.cumsum(size), wrong, side="right")] = False
        odd = np.flatnonzero(~same)  # windows of equal hash and different ids stand for themselves
        index[odd] = len(head) + np.arange(len(odd))
        heads = np.r_[head, odd]
        return index, self.windows(a, b, (lo_a[heads], hi_a[heads], lo_b[heads], hi_b[heads]))


def packed(pair: np.ndarray, times: np.ndarray, press) -> bytes:
    """A text's pairs, as ascending indices into its block's pairs, with their number in the text."""
    return press.compress(np.r_[np.diff(pair, prepend=0), times].astype("<u4").tobytes()) if len(pair) else b""


def unpacked(raw: bytes, press) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(press.decompress(raw), dtype="<u4").astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


DOC = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, definition: str, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of kind 0, one per document: block, ``doc_id``, sizes, ``groups`` and packed ``pairs``; of kind 1, one per block and id pair: (a, b) and the ``docs`` of the block that hold it."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = Shared(docs.sparkSession, Aligner(definition, model))
    like = source.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("doc_id", like), *[T.StructField(c, T.LongType()) for c in DOC],
        T.StructField("groups", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
        T.StructField("docs", T.LongType()),
    ])
    names, id_type = schema.names, to_arrow_type(like)

    def block_rows(block: int, part: pa.RecordBatch, aligner: Aligner) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        done = [aligner.slice(own.column(1).to_pylist()) for own in pieces(part, "text", SLICE_BYTES)]
        codes, place = np.unique(np.concatenate([d["codes"] for d in done]), return_inverse=True)
        holders, at, row = np.zeros(len(codes), dtype=np.int64), 0, 0
        for d in done:
            pair = place[at:at + len(d["codes"])][d["pair"]]
            at += len(d["codes"])
            holders += np.bincount(pair, minlength=len(codes))
            n = len(d["groups"])
            edges = np.searchsorted(d["doc"], np.arange(n + 1))
            blobs = [packed(pair[lo:hi], d["times"][lo:hi], press) for lo, hi in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, block)), part.column(0).slice(row, n), *[pa.array(d[c]) for c in DOC],
                pa.array(d["groups"], pa.string()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names)
            row += n
        for lo in range(0, len(codes), 1 << 16):
            own = codes[lo:lo + (1 << 16)]
            m = len(own)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.ones(m, np.int32)), pa.array(np.full(m, block)), pa.nulls(m, id_type), *[pa.nulls(m, pa.int64()) for _ in DOC], pa.nulls(m, pa.string()),
                pa.nulls(m, pa.binary()), pa.array((own >> 32).astype(np.int32)), pa.array((own & 0xFFFFFFFF).astype(np.int32)), pa.array(holders[lo:lo + (1 << 16)])], names=names)

    def fn(batches):
        aligner, block = shared.value.ready(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, "text", BLOCK_BYTES):
                yield from block_rows(block, part, aligner)
                block += 1

    return source.mapInArrow(fn, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, count, best): documents of the corpus that hold each linked pair, and whether no pair of the A id is held by more."""
    counts = rows.where("kind = 1").groupBy("a", "b").agg(F.sum("docs").alias("count"))
    per_id = Window.partitionBy("a")  # no longer than the vocabulary of B
    return counts.withColumn("best", F.col("count") == F.max("count").over(per_id))


def digests(docs: DataFrame, definition: str, model: bytes) -> DataFrame:
    """The contract's columns of every document."""
    rows = aligned(docs, definition, model)
    rows = stored(rows.withColumn("groups_sha256", F.coalesce(F.sha2("groups", 256), F.lit(""))).drop("groups"), "aligned")
    asked = rows.where("kind = 1").select("block", "a", "b")
    answers = asked.join(pair_counts(rows), ["a", "b"]).select(F.col("block").alias("home"), "a", "b", "count", "best")
    own = rows.where("kind = 0").select("block", "doc_id", *DOC, "groups_sha256", "pairs")
    out = T.StructType([own.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in (*DOC, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def meet(mine: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by([("a", "ascending"), ("b", "ascending")])
        count, best = np.asarray(found.column("count").combine_chunks(), dtype=np.int64), np.asarray(found.column("best").combine_chunks().cast(pa.int64()))
        press, n_best, total = zstandard.ZstdDecompressor(), [], []
        for raw in mine.column("pairs").to_pylist():
            pair, times = unpacked(raw, press) if raw else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            n_best.append(int((times * best[pair]).sum()))
            total.append(int((times * count[pair]).sum()))
        sums = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table({c: sums[c] if c in sums else mine.column(c) for c in out.names})

    return own.groupBy("block").cogroup(answers.groupBy("home")).applyInArrow(meet, out)
