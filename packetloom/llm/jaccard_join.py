"""Operator 7: exact n-gram Jaccard join with a count-vector R-tree.

Shingles of a document are hashed into ``GROUPS`` groups; the group counts are a point, and
the overlap of two sets is at most the sum of the coordinate minima of their points. R-tree
nodes hold the coordinate maxima of their points, so the same sum bounds a whole node. A tree over
all points alone would not do: the counts of long texts are alike in every single
coordinate, so nodes do not part them, and work grows with the square of the documents.
The points are therefore first brought into neighbourhoods that hold every link, and trees
are built inside those:

1. Equal sets are one class from here on (64-bit sum of mixed hashes, and the size).
2. Two sets of n and m shingles with Jaccard t share one of their n - ceil(t n) + 1 first
   shingles in any common order. The order puts shingles frequent in the corpus last (counts of all
   documents in 2^20 counters, a table of fixed size). A neighbourhood is what shares such a shingle.
3. Each class is compared with the least class of its neighbourhoods: bound by points, then
   exactly on the shingle hashes. Linked classes form components.
4. In neighbourhoods that still hold several components, a tree over the points finds the pairs of
   different components that pass the bound. As many as join those components, and some more, are verified exactly, in
   three rounds; where others remain, sets are compared inside the neighbourhood and only links that join components come back.
   A large neighbourhood is split into blocks, and pairs of blocks are worked on apart.

No link between different classes is lost, and pairs inside a component are never listed.
Copies inside one piece of input are settled before the shuffle.

Words are runs of bytes other than white space (0x20, 0x09-0x0D) with A-Z lower-cased; a
shingle is identified by 54 bits of its hash. Defined results: null, empty and blank texts have
no shingles and are their own component; a text with fewer words than a shingle is one
shingle; equal rows are one class; a component is named by the least doc_id in it, null where it has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import repeats
from packetloom.llm.common import Shared, lean, pieces, stored
from packetloom.llm.components import components
from packetloom.llm.hashes import Prefix, mixed, owners, text_bytes, word_values

GROUPS, HASH_BITS, COUNTERS, CHUNK = 256, 54, 1 << 20, 1 << 16
LEAF, BLOCK, BLOCK_SHINGLES, BATCH = 32, 512, 1 << 20, 1024
#: Pairs that a component may give by round, besides those that join components.
ROOM = (0, 16, 256)
SHINGLE = np.uint64((1 << HASH_BITS) - 1)
POINT = ("sid", "comp", "n", "vec")


class Sets:
    """Distinct shingles of up to ``BATCH`` texts, ascending within each: ``hash``, ``text``, ``edges``, ``sizes``."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, width: int):
        words, at = word_values(data, edges, lower=True)
        counts = np.diff(at)
        prefix = Prefix(words)
        start = np.flatnonzero(np.arange(len(words)) + width <= np.repeat(at[1:], counts))
        text = owners(at)[start]
        short = np.flatnonzero((counts > 0) & (counts < width))
        hashes = np.r_[prefix.spans(start, start + width) + np.uint64(width), prefix.spans(at[short], at[short + 1]) + counts[short].astype(np.uint64)]
        text = np.r_[text, short].astype(np.uint64)
        packed = np.unique(text << np.uint64(HASH_BITS) | mixed(hashes) >> np.uint64(64 - HASH_BITS))
        self.hash, self.text = packed & SHINGLE, (packed >> np.uint64(HASH_BITS)).astype(np.int64)
        self.edges = np.searchsorted(self.text, np.arange(len(edges)))
        self.sizes = np.diff(self.edges)

    def names(self) -> np.ndarray:
        """A 64-bit name of every set."""
        sums = np.r_[np.uint64(0), np.cumsum(mixed(self.hash))]
        return mixed(sums[self.edges[1:]] - sums[self.edges[:-1]] + mixed(self.sizes.astype(np.uint64))).astype(np.int64)

    def points(self) -> np.ndarray:
        """Group counts, held at 255; what they miss is known from the size."""
        group = (self.hash >> np.uint64(HASH_BITS - 8)).astype(np.int64)
        counts = np.bincount(self.text * GROUPS + group, minlength=len(self.sizes) * GROUPS)
        return np.minimum(counts, 255).astype(np.uint8).reshape(-1, GROUPS)


def texts_in_sets(batch: pa.RecordBatch, text: int, width: int):
    """(rows, their sets), at most ``BATCH`` rows at a time."""
    for part in pieces(batch, batch.schema.names[text]):
        for lo in range(0, part.num_rows, BATCH):
            own = part.slice(lo, BATCH)
            yield own, Sets(*text_bytes(own.column(text)), width)


def bound(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most that two sets can share: coordinate minima, and what counts held at 255 may hide."""
    hidden = np.minimum(n_a - a.sum(axis=-1, dtype=np.int64), n_b - b.sum(axis=-1, dtype=np.int64))
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64) + hidden


def enough(shared: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n_a + n_b - shared)


def described(base: DataFrame, width: int) -> DataFrame:
    """Rows of kind 0: (doc, key, doc_id, n, sid, vec) of each document; of kind 1: packed counts of shingles, by chunk in ``key``."""
    kind = base.schema["doc_id"].dataType.simpleString()

    def fn(batches):
        counts = np.zeros(COUNTERS, dtype=np.uint32)
        for batch in batches:
            for part, sets in texts_in_sets(batch, 3, width):
                counts += np.bincount((sets.hash & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
                n, points = part.num_rows, sets.points()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(n, dtype=np.int32)), *part.columns[:3], pa.array(sets.sizes, pa.int64()), pa.array(sets.names()),
                    pa.array([p.tobytes() for p in points], pa.binary())], names=names)
        press = zstandard.ZstdCompressor(level=1)
        raw = [press.compress(counts[lo:lo + CHUNK].tobytes()) for lo in range(0, COUNTERS, CHUNK)]
        m = len(raw)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.ones(m, dtype=np.int32)), pa.nulls(m, pa.int64()), pa.array(np.arange(m)), pa.nulls(m, like), pa.nulls(m, pa.int64()),
            pa.nulls(m, pa.int64()), pa.array(raw, pa.binary())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    like, names = to_arrow_type(base.schema["doc_id"].dataType), ["kind", "doc", "key", "doc_id", "n", "sid", "vec"]
    return base.select("doc", "key", "doc_id", "text").mapInArrow(lean(fn), f"kind int, doc long, key long, doc_id {kind}, n long, sid long, vec binary")


def order_classes(rows: DataFrame) -> np.ndarray:
    """One byte per counter: how frequent its shingles are, on a logarithmic scale (below 64)."""

    def fn(batches):
        total: dict[int, np.ndarray] = {}
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(press.decompress(raw.as_buffer()), dtype=np.uint32).astype(np.int64)
        for chunk, counts in total.items():
            scale = np.minimum(np.log2(counts + 1.0) * 2, 63).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([scale.tobytes()], pa.binary())], names=["chunk", "scale"])

    chunks = rows.where("kind = 1").select("key", "vec").repartition("key").mapInArrow(lean(fn), "chunk int, scale binary").collect()  # 1 MB in all
    out = np.zeros(COUNTERS, dtype=np.uint8)
    for c in chunks:
        out[c["chunk"] * CHUNK:(c["chunk"] + 1) * CHUNK] = np.frombuffer(c["scale"], dtype=np.uint8)
    return out


def neighbourhoods(base: DataFrame, classes: np.ndarray, width: int, percent: int, buckets: int) -> DataFrame:
    """(a, sid, pivot): classes that share the prefix shingle ``a`` with another, and the least of them (of their piece, or of all)."""
    scale = Shared(base.sparkSession, classes)

    def asked(batches):
        for batch in batches:
            for part, sets in texts_in_sets(batch, 0, width):
                weight = scale.value[(sets.hash & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
                order = np.sort(sets.text.astype(np.uint64) << np.uint64(54) | weight << np.uint64(48) | sets.hash >> np.uint64(HASH_BITS - 48))
                first = sets.sizes + (-percent * sets.sizes) // 100 + 1  # n - ceil(t n) + 1
                place = np.arange(len(order)) - sets.edges[sets.text]
                token, text = order & SHINGLE, sets.text
                keep = place < first[text]
                token, sid = token[keep], sets.names()[text[keep]]
                token, sid = _distinct(token, sid)
                heads = np.flatnonzero(np.r_[True, np.diff(token) != 0]) if len(token) else token.astype(np.int64)
                sizes = np.diff(np.r_[heads, len(token)])
                pivot = np.repeat(sid[heads], sizes)
                others = sid != pivot
                yield from repeats.pack({"a": token[others], "sid": sid[others], "pivot": pivot[others]}, repeats.RUN, (sid[others] % buckets))
                met = np.where(sizes > 1, repeats.MANY, np.uint32(0)).astype(np.uint32)
                yield from repeats.pack({"a": token[heads], "sid": sid[heads], "n": met}, repeats.ASKED, (token[heads] % np.uint64(buckets)).astype(np.int64))

    def met(batches):
        for bucket, held in repeats.by_bucket(batches, repeats.ASKED):
            if bucket is None:
                yield held
                continue
            e = repeats.unpack(held[repeats.ASKED], ("a", "sid", "n"))
            order = np.lexsort((e["sid"], e["a"]))
            a, sid, many = e["a"][order], e["sid"][order], e["n"][order] > 0
            heads = np.flatnonzero(np.r_[True, np.diff(a) != 0])
            sizes = np.diff(np.r_[heads, len(a)])
            pivot = np.repeat(sid[heads], sizes)
            keep = np.repeat(np.logical_or.reduceat(many, heads) | (np.maximum.reduceat(sid, heads) != sid[heads]), sizes)
            yield from repeats.pack({"a": a[keep], "sid": sid[keep], "pivot": pivot[keep]}, repeats.RUN, sid[keep] % buckets)

    def rows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                e = repeats.unpack([x.as_buffer() for x in batch.column(2).slice(lo, 512)], ("a", "sid", "pivot"))
                yield pa.RecordBatch.from_arrays([pa.array(e["a"].astype(np.int64)), pa.array(e["sid"]), pa.array(e["pivot"])], names=["a", "sid", "pivot"])

    packed = base.select("text").mapInArrow(lean(asked), repeats.PACKED).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(met), repeats.PACKED)
    return packed.mapInArrow(lean(rows), "a long, sid long, pivot long")


def _distinct(token: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((sid, token))
    token, sid = token[order], sid[order]
    fresh = np.r_[True, (np.diff(token) != 0) | (np.diff(sid) != 0)] if len(token) else np.zeros(0, dtype=bool)
    return token[fresh], sid[fresh]


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.uint8).reshape(len(column), GROUPS)


def within_bound(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (sid, pivot) whose points allow the similarity."""
    own = points.select("sid", "n", "vec")
    other = points.select(F.col("sid").alias("pivot"), F.col("n").alias("n2"), F.col("vec").alias("vec2"))
    sized = pairs.join(own, "sid").join(other, "pivot").where(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))

    def fn(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                p = batch.slice(lo, 4096)
                n, n2 = (np.asarray(p.column(c)) for c in (2, 3))
                ok = enough(bound(_vectors(p.column(4)), n, _vectors(p.column(5)), n2), n, n2, percent)
                yield p.select([0, 1]).filter(pa.array(ok))

    return sized.select("sid", "pivot", "n", "n2", "vec", "vec2").mapInArrow(lean(fn), "sid long, pivot long")


def verified(pairs: DataFrame, points: DataFrame, base: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (u, v) = (sid, pivot) that are linked, by their whole shingle sets.

    Sets travel to their pivot; a pivot with many members is sent to several tasks.
    """
    crowd = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / 2048).cast("int").alias("parts"))
    to_pivot = pairs.join(crowd, "pivot").select("sid", F.struct("pivot", "parts", F.lit(1).alias("member")).alias("to"))
    own = crowd.select(F.col("pivot").alias("sid"), F.struct("pivot", "parts", F.lit(0).alias("member")).alias("to"))
    needed = to_pivot.unionByName(own).groupBy("sid").agg(F.collect_list("to").alias("to"))  # no more than the prefix of a set
    texts = repeats.squeezed(base).join(needed.join(points.select("sid", "doc", "key"), "sid"), ["doc", "key"]).select("small", "sid", "to")

    def send(batches):
        for batch in batches:
            for part, raw in repeats.unsqueezed(batch):
                for lo in range(0, part.num_rows, BATCH):
                    own = part.slice(lo, BATCH)
                    sets = Sets(*repeats.joined(raw[lo:lo + BATCH]), width)
                    out = []
                    for k, (sid, to) in enumerate(zip(own.column(1).to_pylist(), own.column(2).to_pylist())):
                        blob = sets.hash[sets.edges[k]:sets.edges[k + 1]].tobytes()
                        for t in to:
                            spots = [sid % t["parts"]] if t["member"] else range(t["parts"])
                            out += [(t["pivot"], s, t["member"], sid, blob) for s in spots]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["pivot", "part", "member", "sid", "hashes"])

    def check(batches):
        at, whole = None, None
        for batch in batches:
            u, v = [], []
            for pivot, part, member, sid, raw in zip(*(batch.column(c).to_pylist() if c < 4 else batch.column(c) for c in range(5))):
                own = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if not member:
                    at, whole = (pivot, part), own
                elif (pivot, part) == at:
                    if _linked(own, whole, percent):
                        u.append(sid)
                        v.append(pivot)
                else:
                    raise AssertionError("a pivot's own set must come first")
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    sent = texts.mapInArrow(lean(send), "pivot long, part int, member int, sid long, hashes binary")
    return sent.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member").mapInArrow(lean(check), "u long, v long").distinct()


class Tree:
    """R-tree leaves over points packed by size and main coordinates; a leaf holds coordinate maxima."""

    def __init__(self, vec: np.ndarray, n: np.ndarray):
        spread = np.argsort(-vec.astype(np.float32).var(axis=0))[:2]
        self.order = np.lexsort((vec[:, spread[1]], vec[:, spread[0]], n // 8))
        heads = np.arange(0, len(n), LEAF)
        self.edges = np.r_[heads, len(n)]
        self.high = np.maximum.reduceat(vec[self.order], heads, axis=0)
        hidden = n - vec.sum(axis=1, dtype=np.int64)
        self.hidden = np.maximum.reduceat(hidden[self.order], heads)
        self.least, self.most = np.minimum.reduceat(n[self.order], heads), np.maximum.reduceat(n[self.order], heads)

    def leaves(self, q: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Leaves that may hold a partner of the point ``q`` with ``n`` shingles."""
        top = np.minimum(q, self.high).sum(axis=1, dtype=np.int64) + np.minimum(self.hidden, n - int(q.sum(dtype=np.int64)))
        sized = (100 * self.most >= percent * n) & (100 * n >= percent * self.least)
        return np.flatnonzero(sized & enough(top, n, self.least, percent))

    def members(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([self.order[self.edges[k]:self.edges[k + 1]] for k in leaves]) if len(leaves) else self.order[:0]


class Forest:
    """Trees over the numbers below ``n``; of two trees that are joined the smaller one is renamed."""

    def __init__(self, n: int):
        self.root, self.held = np.arange(n), [[k] for k in range(n)]

    def join(self, a: int, b: int) -> None:
        a, b = sorted((int(self.root[a]), int(self.root[b])), key=lambda r: len(self.held[r]))
        if a != b:
            self.root[self.held[a]] = b
            self.held[b] += self.held[a]
            self.held[a] = []


def _places(sid: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each of ``sid`` stands in ``known``; -1 where it does not."""
    order = np.argsort(known)
    at = order[np.minimum(np.searchsorted(known, sid, sorter=order), len(known) - 1)]
    return np.where(known[at] == sid, at, -1)


def joining_pairs(left: dict, right: dict, percent: int, same: bool, room: int, barred: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Indices of pairs of different components, one point of each side and not ``barred``, that hold together all that such pairs connect.

    With sets, pairs are links. Without, they pass the bound; others come too while one of their components has given fewer
    than ``room`` of them, and the last value tells whether pairs were left out.
    """
    tree, whole = Tree(left["vec"], left["n"]), "set" in left
    names, place = np.unique(np.r_[left["comp"], right["comp"]], return_inverse=True)
    comp, forest, used = place[:len(left["n"])], Forest(len(names)), np.zeros(len(names), dtype=np.int64)
    order = np.argsort(barred[1], kind="stable")
    out, edges = barred[0][order], np.searchsorted(barred[1][order], np.arange(len(right["n"]) + 1))
    i, j, others = [], [], False
    for k in range(len(right["n"])):
        q, n, own = right["vec"][k], int(right["n"][k]), place[len(comp) + k]
        near = tree.members(tree.leaves(q, n, percent))
        near = near[(comp[near] != own) & ((left["sid"][near] < right["sid"][k]) if same else True)]
        if whole:
            near = near[forest.root[comp[near]] != forest.root[own]]
        shared = bound(left["vec"][near], left["n"][near], q[None], n)
        ok = enough(shared, left["n"][near], n, percent) & ~np.isin(near, out[edges[k]:edges[k + 1]])
        near = near[ok][np.argsort(-shared[ok] / (left["n"][near][ok] + n - shared[ok]), kind="stable")]  # the likeliest first
        spare = []
        while len(near):
            at = near[0]
            near = near[1:]
            if forest.root[comp[at]] == forest.root[own]:
                spare.append(np.r_[at])
            elif not whole or _linked(left["set"][at], right["set"][k], percent):
                i.append(at)
                j.append(k)
                forest.join(comp[at], own)
                inside = forest.root[comp[near]] == forest.root[own]
                spare.append(near[inside])
                near = near[~inside]
        rest = np.concatenate(spare) if spare and not whole else near
        free = rest[(used[own] < room) | (used[comp[rest]] < room)]
        others = others or len(free) < len(rest)
        for at in free:
            if min(used[own], used[comp[at]]) < room:
                i.append(at)
                j.append(k)
                used[own] += 1
                used[comp[at]] += 1
            else:
                others = True
    return np.array(i, dtype=np.int64), np.array(j, dtype=np.int64), others


def _linked(own: np.ndarray, whole: np.ndarray, percent: int) -> bool:
    spot = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
    return enough(int((whole[spot] == own).sum()), len(own), len(whole), percent)


def open_members(met: DataFrame, labels: DataFrame, points: DataFrame) -> DataFrame:
    """(a, sid, comp, own, others) in neighbourhoods with several components; of those with the same members one is left.

    A member is in block ``own`` and meets the blocks ``others``: those of the largest component meet only those of the rest.
    """
    labelled = met.select("a", "sid").distinct().join(labels.withColumnRenamed("node", "sid"), "sid", "left").join(points.select("sid", "n"), "sid")
    labelled = stored(labelled.select("a", "sid", F.coalesce("component", "sid").alias("comp"), "n"), "labelled")
    rows, n = F.count("*").alias("rows"), F.sum("n").alias("n")
    parts = labelled.groupBy("a", "comp").agg(rows, n, F.bit_xor("sid").alias("one"), F.bit_xor(F.xxhash64("sid")).alias("two"))
    most = F.max(F.struct("rows", "comp", "n")).alias("most")
    alike = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("rows").alias("rows"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two")]
    several = parts.groupBy("a").agg(most, F.sum("n").alias("n"), *alike).where("lo != hi")
    several = several.groupBy("most", "n", "lo", "hi", "rows", "one", "two").agg(F.min("a").alias("a"))

    def blocks(rows, n):
        """Bounded in rows and shingles; 32 blocks hold more rows each before there are more."""
        fit = F.least(F.ceil(rows / BLOCK), F.greatest(F.lit(32), F.ceil(rows / (16 * BLOCK))))
        return F.greatest(fit, F.ceil(n / BLOCK_SHINGLES)).cast("int")

    m, r = blocks(F.col("most.rows"), F.col("most.n")), blocks(F.col("rows") - F.col("most.rows"), F.col("n") - F.col("most.n"))
    placed = labelled.join(several.select("a", F.col("most.comp").alias("main"), m.alias("m"), r.alias("r")), "a")
    main, spot = F.col("comp") == F.col("main"), F.xxhash64("sid")
    own = F.when(main, F.pmod(spot, "m")).otherwise(F.col("m") + F.pmod(spot, "r")).cast("int")
    others = F.sequence(F.when(main, F.col("m")).otherwise(F.lit(0)), F.col("m") + F.col("r") - 1)
    return stored(placed.select("a", "sid", "comp", own.alias("own"), others.alias("others")), "several")


def open_pairs(members: DataFrame, points: DataFrame, rejected: DataFrame, percent: int, room: int) -> DataFrame:
    """(a, sid, pivot): pairs of ``joining_pairs`` in the neighbourhood ``a``, and a row without sid where others remain.

    Pairs in ``rejected`` are not listed again. ``points`` may bring whole sets in ``hashes``.
    """
    sets = ["hashes"] if "hashes" in points.columns else []
    barred = rejected.groupBy("sid").agg(F.collect_list("pivot").alias("barred"))
    known = points.select("sid", "n", "vec", *sets).join(barred, "sid", "left")
    placed = members.join(known, "sid").withColumn("other", F.explode("others"))
    placed = placed.select("a", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", *POINT, "barred", *sets)

    def fn(batches):
        for rows in _grouped(batches):
            own, x, y = (np.asarray(rows.column(c)) for c in (3, 1, 2))
            side = {c: np.asarray(rows.column(4 + k)) for k, c in enumerate(POINT[:3])} | {"vec": _vectors(rows.column(7))}
            if sets:
                side["set"] = np.empty(len(own), dtype=object)
                side["set"][:] = [np.frombuffer(raw.as_buffer(), dtype=np.uint64) for raw in rows.column(9)]
            pick = lambda m: {c: v[m] for c, v in side.items()}
            same = bool(x[0] == y[0])
            left, right = pick(own == x), pick(own == y)
            if len(left["n"]) and len(right["n"]):
                high, low = side["sid"][np.asarray(pc.list_parent_indices(rows.column(8)))], np.asarray(pc.list_flatten(rows.column(8)))
                out = [(_places(u, left["sid"]), _places(v, right["sid"])) for u, v in ((low, high), (high, low))]
                i, j = (np.concatenate(e) for e in zip(*out))
                here = (i >= 0) & (j >= 0)
                i, j, others = joining_pairs(left, right, percent, same, room, (i[here], j[here]))
                a, b = left["sid"][i], right["sid"][j]
                end = pa.nulls(int(others), pa.int64())
                sid, pivot = (pa.concat_arrays([pa.array(s, pa.int64()), end]) for s in (np.maximum(a, b), np.minimum(a, b)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid), rows.column(0)[0].as_py()), pa.int64()), sid, pivot], names=["a", "sid", "pivot"])

    return placed.repartition("a", "x", "y").sortWithinPartitions("a", "x", "y").mapInArrow(lean(fn), "a long, sid long, pivot long")


def with_sets(points: DataFrame, base: DataFrame, width: int) -> DataFrame:
    """``points`` and the ascending shingles of each in ``hashes``."""

    def fn(batches):
        for batch in batches:
            for part, raw in repeats.unsqueezed(batch):
                for lo in range(0, part.num_rows, BATCH):
                    sets = Sets(*repeats.joined(raw[lo:lo + BATCH]), width)
                    own = [sets.hash[a:b].tobytes() for a, b in zip(sets.edges[:-1], sets.edges[1:])]
                    yield pa.RecordBatch.from_arrays([part.column(1).slice(lo, BATCH), pa.array(own, pa.binary())], names=["sid", "hashes"])

    texts = repeats.squeezed(base).join(points.select("doc", "key", "sid"), ["doc", "key"]).select("small", "sid")
    found = texts.mapInArrow(lean(fn), "sid long, hashes binary").dropDuplicates(["sid"])
    return points.join(found, "sid")


def joined_up(met: DataFrame, linked: DataFrame, rejected: DataFrame, points: DataFrame, base: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) by ``linked`` and all links between its components in the neighbourhoods ``met``.

    Each round verifies pairs that pass the bound: what joins components, and ``ROOM`` more of each component, so that their number
    follows the members of a neighbourhood and not their pairs. Most of what is left out lies inside a component afterwards.
    Where others remain after the last round, whole sets go to the blocks, and only links that join components come back.
    """
    labels = stored(components(linked), "labels")
    for room in ROOM:
        members = open_members(met, labels, points)
        if members.isEmpty():
            return labels
        listed = stored(open_pairs(members, points, rejected, percent, room), "open")
        pairs = listed.where("sid is not null").select("sid", "pivot").distinct()
        if pairs.isEmpty():
            return labels
        more = stored(verified(pairs, points, base, width, percent), "more")
        if not more.isEmpty():
            linked = linked.unionByName(more)
            labels = stored(components(linked), "labels")
        remain = listed.where("sid is null").select("a").distinct()
        if remain.isEmpty():
            return labels
        rejected = rejected.unionByName(_without(pairs, more))
        met = members.join(remain, "a", "left_semi")
    members = open_members(met, labels, points)
    if members.isEmpty():
        return labels
    whole = stored(with_sets(points.join(members.select("sid"), "sid", "left_semi"), base, width), "whole")
    last = stored(open_pairs(members, whole, rejected, percent, 0), "last").select(F.col("sid").alias("u"), F.col("pivot").alias("v")).distinct()
    return stored(components(linked.unionByName(last)), "labels")


def _without(pairs: DataFrame, links: DataFrame) -> DataFrame:
    return pairs.join(links.select(F.col("u").alias("sid"), F.col("v").alias("pivot")), ["sid", "pivot"], "left_anti")


def _grouped(batches):
    """Rows that share their first three columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(3)], axis=1)
        heads = np.flatnonzero(np.r_[True, (np.diff(keys, axis=0) != 0).any(axis=1)]) if len(keys) else []
        for lo, hi in zip(heads, np.r_[heads[1:], len(keys)]):
            key = tuple(keys[lo])
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc, key, doc_id, n_shingles, component_id, comp) of every row.

    ``doc`` and ``key`` are those of ``repeats.keyed``; ``comp`` names the component by a class, null without shingles.
    """
    base = repeats.keyed(docs)
    buckets = repeats.bucket_count(base)
    rows = stored(described(base, width), "sets")
    members = rows.where("kind = 0")
    points = members.where("n > 0").groupBy("sid").agg(F.min(F.struct("doc", "key")).alias("d"), F.first("n").alias("n"), F.first("vec").alias("vec"))
    points = stored(points.select("sid", "d.doc", "d.key", "n", "vec"), "points")
    met = stored(neighbourhoods(base, order_classes(rows), width, percent, buckets), "met")
    stars = stored(met.where("sid != pivot").select("sid", "pivot").distinct(), "stars")
    near = stored(within_bound(stars, points, percent), "near")
    linked = stored(verified(near, points, base, width, percent), "linked")
    labels = joined_up(met, linked, _without(near, linked), points, base, width, percent)
    named = members.where("n > 0").join(labels, F.col("sid") == F.col("node"), "left").select("doc", "key", "doc_id", "n", F.coalesce("component", "sid").alias("comp"))
    named = stored(named, "named")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    full = named.join(least, "comp").select("doc", "key", "doc_id", F.col("n").alias("n_shingles"), "component_id", "comp")
    alone = members.where("n = 0").select("doc", "key", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("comp"))
    return full.unionByName(alone)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, unchanged, with one of each component: the least doc_id, then the least text hash.

    Rows without shingles all stay. Rows that agree in doc_id and text stay once.
    """
    found = join(docs, width, percent)
    first = found.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc", "key")).alias("d")).select("d.doc", "d.key")
    stay = first.unionByName(found.where("comp is null").select("doc", "key")).distinct()
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # whole rows travel in a struct, so their column names meet no others
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), doc.alias("doc"), key.alias("key"))
    kept = own.join(stay, ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"])
    return kept.select("row.*")
