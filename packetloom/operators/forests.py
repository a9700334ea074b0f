"""Random forests whose trees are rows of a table.

Spark's own forest fills dense statistics for every node in every task and keeps all trees on the driver. Deep
trees on noisy classes have about one node for two rows, so both grow with rows times trees. Here nodes with many
rows are split by histograms added up over all tasks; a node with few enough rows goes to one task with its rows, which
grows what is below it. Trees are scored where they lie: rows meet their part of each tree by a cogroup. Features are
columns, or the bytes of one binary column; rows can also be scored with some of their features zeroed.

The rules are those of Spark's forest: up to 32 bins a feature, Poisson draws of rows, ceil(sqrt(features)) features
a node, Gini with class weights, leaves that are pure, gain nothing or lie at the depth limit; votes are the leaves' class
shares. Draws are hashes of seed, tree and row, features of seed, tree and node, and counts are whole numbers: the
same forest on any partitioning, wherever the large nodes end.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from packetloom.operators.ordered import stored
from packetloom.operators.sampling import class_weights

BINS = 32
#: Values (rows times features) of a node that one task finishes alone.
NODE_VALUES = 4_000_000
#: Cells of the histograms that are held at once, here and for one job over large nodes.
CELLS, JOB_CELLS = 1 << 18, 1 << 23
#: Votes are whole numbers, so that their sum does not depend on its order.
ONE_VOTE = 1 << 32
ROW = "_row"
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, tree: int, use: int) -> np.ndarray:
    return _mixed(_mixed(np.array([seed & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)) ^ np.uint64(tree * 2 + use))


def draws(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often a tree draws each row, by Poisson with mean one."""
    even = (_mixed(rows.view(np.uint64) ^ _stream(seed, tree, 0)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.searchsorted(_POISSON, even, side="right").astype(np.uint8)


def node_features(seed: int, tree: int, nodes: np.ndarray, width: int) -> np.ndarray:
    """The features that each node may split on."""
    some = math.ceil(math.sqrt(width))
    own = _mixed(nodes.astype(np.uint64) ^ _stream(seed, tree, 1))
    order = _mixed(own[:, None] + np.arange(width, dtype=np.uint64)[None, :])
    return np.sort(np.argpartition(order, some - 1, axis=1)[:, :some], axis=1)


def histograms(slot, features, bins, code, times, classes: int) -> np.ndarray:
    """Drawn rows by (slot, feature of the slot, class, bin); ``features`` are those of each slot."""
    k, some = features.shape
    picked = np.take_along_axis(bins, features[slot], axis=1).astype(np.int64)
    cell = ((slot[:, None] * some + np.arange(some)) * classes + code[:, None]) * BINS + picked
    counts = np.bincount(cell.ravel(), weights=np.repeat(times, some), minlength=k * some * BINS * classes)
    return counts.reshape(k, some, classes, BINS)


def _gains(below, total: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gain in Gini of every cut; ``below``: for each class the drawn rows up to the cut, by node and further axes."""
    ranks = (slice(None), *[None] * (below[0].ndim - 1))
    weighed = total * weights
    mass, square, rows = (v[ranks] for v in (weighed.sum(axis=1), (weighed**2).sum(axis=1), total.sum(axis=1)))
    drawn = whole = left = right = 0.0
    for c, weight in enumerate(weights):
        drawn = drawn + below[c]
        own = below[c] * weight
        whole = whole + own
        left = left + own * own
        own = weighed[:, c][ranks] - own
        right = right + own * own
    valid = (drawn > 0) & (drawn < rows)
    parts = left / np.where(valid, whole, 1.0) + right / np.where(valid, mass - whole, 1.0)
    return np.where(valid, (parts - square / mass) / mass, -1.0)


def best_splits(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node: place of the feature among its own, last bin on the left, gain in Gini, weight of its rows."""
    total = counts[:, 0].sum(axis=2)
    flat = _gains(counts.cumsum(axis=3)[..., :-1].transpose(2, 0, 1, 3), total, weights).reshape(len(counts), -1)
    best = flat.argmax(axis=1)
    return best // (BINS - 1), best % (BINS - 1), flat[np.arange(len(flat)), best], (total * weights).sum(axis=1)


def best_mixed_splits(slot, features, picked, code, times, total: np.ndarray, weights: np.ndarray, many: np.ndarray):
    """:func:`best_splits` where only the features in ``many`` (by slot and place) have more than two bins."""
    (k, some), classes = features.shape, len(weights)
    row, place = np.nonzero(picked == 0)
    cell = (slot[row] * some + place) * classes + code[row]
    below = np.bincount(cell, weights=times[row], minlength=k * some * classes).reshape(k, some, classes)
    gain, last = _gains(below.transpose(2, 0, 1), total, weights), np.zeros((k, some), dtype=np.int64)
    node, at = np.nonzero(many)
    if len(node):
        pair = np.full(many.shape, -1)
        pair[node, at] = np.arange(len(node))
        row, place = np.nonzero(many[slot])
        cell = (pair[slot[row], place] * classes + code[row]) * BINS + picked[row, place]
        counts = np.bincount(cell, weights=times[row], minlength=len(node) * classes * BINS).reshape(len(node), classes, BINS)
        found = _gains(counts.cumsum(axis=2)[..., :-1].transpose(1, 0, 2), total[node], weights)
        last[node, at] = found.argmax(axis=1)
        gain[node, at] = found.max(axis=1)
    best, nodes = gain.argmax(axis=1), np.arange(k)
    return best, last[nodes, best], gain[nodes, best], (total * weights).sum(axis=1)


def votes_of(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    weighed = counts * weights
    return np.rint(weighed / weighed.sum(axis=-1, keepdims=True) * ONE_VOTE).astype(np.int64)


def walk(feature: np.ndarray, cut: np.ndarray, child: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The last node of each row; inner nodes have a feature, and their right child follows the left one."""
    at, going = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while len(going):
        going = going[feature[at[going]] >= 0]
        own = at[going]
        at[going] = child[own] + (bins[going, feature[own]] > cut[own])
    return at


def grow_below(bins, code, times, tree: int, root: int, seed: int, weights: np.ndarray, depth: int):
    """A tree below ``root`` (nodes number like a heap, the whole tree's root is 1): features, cuts, children, votes and
    the gain of every feature. Level by level, all nodes of a level at once."""
    classes, width = len(weights), bins.shape[1]
    gains, many = np.zeros(width), bins.max(axis=0, initial=0) > 1
    feature, cut, child, votes = [], [], [], []
    heap, slot, rows, made = np.array([root]), np.zeros(len(bins), dtype=np.int64), np.arange(len(bins)), 1
    while len(heap):
        k = len(heap)
        counts = np.bincount(slot * classes + code[rows], weights=times[rows], minlength=k * classes).reshape(k, classes)
        feature_k, cut_k, child_k = np.full(k, -1), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        level = int(heap[0]).bit_length() - 1
        order = np.argsort(slot, kind="stable")
        slot, rows = slot[order], rows[order]
        mixed = np.flatnonzero((counts > 0).sum(axis=1) > 1) if level < depth else np.array([], dtype=np.int64)
        edges = np.searchsorted(slot, np.arange(k + 1))
        block = max(1, int(CELLS / (math.ceil(math.sqrt(width)) * np.where(many, BINS, 1).mean() * classes)))
        for i in range(0, len(mixed), block):
            part = mixed[i:i + block]
            sizes = edges[part + 1] - edges[part]
            own = np.repeat(np.arange(len(part)), sizes)
            # rows of the part's nodes, node after node
            some = rows[np.arange(len(own)) + np.repeat(edges[part] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)]
            features = node_features(seed, tree, heap[part], width)
            picked = bins[some[:, None], features[own]]
            place, last, gain, mass = best_mixed_splits(own, features, picked, code[some], times[some], counts[part], weights, many[features])
            split = gain > 1e-12
            chosen = features[np.arange(len(part)), place]
            feature_k[part[split]], cut_k[part[split]] = chosen[split], last[split]
            np.add.at(gains, chosen[split], (gain * mass)[split])
        split = feature_k >= 0
        child_k[split] = made + 2 * np.arange(split.sum())
        made += 2 * int(split.sum())
        feature.append(feature_k), cut.append(cut_k), child.append(child_k), votes.append(np.where(split[:, None], 0, votes_of(counts, weights)))
        goes_on = split[slot]
        slot, rows = slot[goes_on], rows[goes_on]
        right = bins[rows, feature_k[slot]] > cut_k[slot]
        slot = 2 * (np.cumsum(split) - 1)[slot] + right
        heap = (2 * heap[split][:, None] + np.arange(2)).ravel()
    return np.concatenate(feature), np.concatenate(cut), np.concatenate(child), np.concatenate(votes), gains


class Top:
    """The part of one tree above the nodes that tasks finish; it has one node for about ``NODE_VALUES`` values."""

    def __init__(self):
        self.feature, self.cut, self.child, self.heap, self.votes = [-1], [0], [0], [1], [None]

    def split(self, at: int, feature: int, cut: int) -> list[int]:
        self.feature[at], self.cut[at], self.child[at] = feature, cut, len(self.heap)
        for side in (0, 1):
            for column, value in ((self.feature, -1), (self.cut, 0), (self.child, 0), (self.heap, 2 * self.heap[at] + side), (self.votes, None)):
                column.append(value)
        return [self.child[at], self.child[at] + 1]

    def walk(self, bins: np.ndarray) -> np.ndarray:
        return walk(np.array(self.feature), np.array(self.cut), np.array(self.child), bins)


def walk_zeroed(feature, cut, child, bins, blank, zeroed, row, kind, along):
    """The last nodes of walkers: ``(row, kind, node)``. Kind 0 walks by a row as it is, kind k by the row with the features
    in ``zeroed[k]`` at their bins in ``blank``. Kinds in ``along`` (by row) go with kind 0 until it would turn elsewhere
    without them; they then walk alone and are no longer along."""
    at, done = np.zeros(len(row), dtype=np.int64), []
    while True:
        own = feature[at].astype(np.int64)
        ends = own < 0
        done.append((row[ends], kind[ends], at[ends]))
        if ends.all():
            return tuple(np.concatenate(v) for v in zip(*done))
        row, kind, at, own = row[~ends], kind[~ends], at[~ends], own[~ends]
        emptied = blank[own] > cut[at]
        right = np.where(zeroed[kind, own], emptied, bins[row, own] > cut[at])
        turns = np.flatnonzero((kind == 0) & (right != emptied))
        which, alone = np.nonzero(along[row[turns]] & zeroed.T[own[turns]])
        leaves = turns[which]
        along[row[leaves], alone] = False
        at, apart = child[at].astype(np.int64) + right, child[at[leaves]].astype(np.int64) + emptied[leaves]
        row, kind, at = np.concatenate([row, row[leaves]]), np.concatenate([kind, alone]), np.concatenate([at, apart])


@dataclass(frozen=True)
class Forest:
    classes: list[str]
    features: list[str] | str
    edges: list[np.ndarray]
    tops: list[Top]
    parts: DataFrame  # (tree, node, feature, cut, child, votes, gains): what lies below each node where a top ends
    top_gains: list[tuple[int, int, float]]
    rows: int


def bin_edges(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of all bins but the last: halves between values where those are few, quantiles of all rows elsewhere."""
    near = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in features], *[F.max(c).alias(f"_max_{c}") for c in features]).first()
    few = [c for c in features if near[c] <= 1.5 * BINS]
    sets = rows.agg(*[F.collect_set(F.col(c).cast("double")).alias(c) for c in few]).first() if few else {}
    exact = {c: np.sort(np.array(sets[c])) for c in few if len(sets[c]) <= BINS}
    other = [c for c in features if c not in exact]
    quantiles = rows.approxQuantile(other, [k / BINS for k in range(1, BINS)], 0.001) if other else []
    found = {c: (v[1:] + v[:-1]) / 2 for c, v in exact.items()}
    found.update({c: np.unique([q for q in values if q < near[f"_max_{c}"]]) for c, values in zip(other, quantiles)})
    return [found[c] for c in features]


def byte_edges(rows: DataFrame, column: str) -> list[np.ndarray]:
    """:func:`bin_edges` of every byte of a binary column of one length, from the counts of all values at each place."""
    def count(batches):
        held = None
        for batch in batches:
            values = _values_of(batch.column(0))
            if values.size:
                cells = np.arange(values.shape[1]) * 256 + values
                found = np.bincount(cells.ravel(), minlength=values.shape[1] * 256).reshape(-1, 256)
                held = found if held is None else held + found
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array([h.tobytes() for h in held], pa.binary())], ["place", "counts"])

    def choose(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(c.as_py(), dtype=np.int64) for c in table.column("counts"))
        seen, below = np.flatnonzero(counts), counts.cumsum()
        ends = (seen[1:] + seen[:-1]) / 2
        if len(seen) > BINS:
            ends = np.unique(np.searchsorted(below, np.arange(1, BINS) / BINS * below[-1], side="left")).astype(np.float64)
            ends = ends[ends < seen[-1]]
        return pa.table({"place": table.column("place")[:1], "ends": pa.array([ends.tolist()], pa.list_(pa.float64()))})

    counted = rows.select(column).mapInArrow(count, "place int, counts binary")
    found = counted.groupBy("place").applyInArrow(choose, "place int, ends array<double>").orderBy("place").collect()
    return [np.array(r["ends"], dtype=np.float64) for r in found]


def binned(rows: DataFrame, key: Sequence[str], features: Sequence[str] | str, edges: list[np.ndarray], keep: Sequence[str] = ()) -> DataFrame:
    """(key, kept columns, ``_row``: a hash of the key, bins: those of every feature as in :class:`Bins`)."""
    names, form = [*key, *keep, ROW], Bins(edges)
    if isinstance(features, str):
        held = rows.select(*key, *keep, F.xxhash64(*key).alias(ROW), F.col(features).alias("bins"))
        as_held = to_arrow_schema(held.schema)

        def look_up(batches):
            of_value = np.stack([np.searchsorted(e, np.arange(256), side="left") for e in edges]).astype(np.uint8)
            for batch in batches:
                bins = of_value[np.arange(len(edges)), _values_of(batch.column("bins")).reshape(-1, len(edges))]
                yield pa.RecordBatch.from_arrays([*batch.select(names).columns, form.column(bins)], schema=as_held)

        return held.mapInArrow(look_up, held.schema)
    wide = rows.select(*key, *keep, F.xxhash64(*key).alias(ROW), *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)])
    schema = T.StructType([*wide.select(*names).schema.fields, T.StructField("bins", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def work(batches):
        for batch in batches:
            bins = np.column_stack([
                np.searchsorted(e, batch.column(f"_f{i}").to_numpy(zero_copy_only=False), side="left").astype(np.uint8)
                for i, e in enumerate(edges)
            ])
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, form.column(bins)], schema=arrow)

    return wide.mapInArrow(work, schema)


def _values_of(column) -> np.ndarray:
    """The bytes of binary values of one length, a row for each value."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), -1) if values else np.zeros((0, 0), dtype=np.uint8)


class Bins:
    """How the bins of a row travel: a byte for every feature, a bit where it has two bins, nothing where it has one."""

    def __init__(self, edges: list[np.ndarray]):
        sizes = np.array([len(e) + 1 for e in edges])
        self.width, self.bits, self.bytes = len(edges), np.flatnonzero(sizes == 2), np.flatnonzero(sizes > 2)
        self.size = len(self.bytes) + -(-len(self.bits) // 8)

    def column(self, bins: np.ndarray) -> pa.Array:
        held = np.concatenate([bins[:, self.bytes], np.packbits(bins[:, self.bits], axis=1)], axis=1)
        offsets = np.arange(len(held) + 1, dtype=np.int32) * self.size
        return pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(held))])

    def read(self, column) -> np.ndarray:
        held = _values_of(column).reshape(len(column), self.size)
        bins = np.zeros((len(held), self.width), dtype=np.uint8)
        bins[:, self.bytes] = held[:, :len(self.bytes)]
        if len(self.bits):
            bins[:, self.bits] = np.unpackbits(held[:, len(self.bytes):], axis=1, count=len(self.bits))
        return bins


def grow(
    rows: DataFrame, key: Sequence[str], label: str, features: Sequence[str] | str, seed: int = 42,
    trees: int = 100, depth: int = 20, weighted: bool = True,
) -> Forest:
    """A forest on ``rows``, which have a unique ``key`` and are read several times; ``weighted`` balances the classes.

    ``features`` are columns, or one binary column, whose values have one length: each byte is a feature."""
    key, features = list(key), features if isinstance(features, str) else list(features)
    sizes = {r["class"]: r["weight"] for r in class_weights(rows, label).collect()}
    names = sorted(sizes)
    classes, weights = len(names), np.array([sizes[c] if weighted else 1.0 for c in names])
    edges = byte_edges(rows, features) if isinstance(features, str) else bin_edges(rows, features)
    width, form = len(edges), Bins(edges)
    coded = rows.withColumn("_code", (F.array_position(F.array(*[F.lit(c) for c in names]), F.col(label)) - 1).cast("int"))
    base = stored(binned(coded, key, features, edges, ["_code"]).select(ROW, "_code", "bins"), "binned")
    count = base.count()
    limit, some = NODE_VALUES / width, math.ceil(math.sqrt(width))
    tops, top_gains = [Top() for _ in range(trees)], []
    pending = [(t, 0) for t in range(trees)] if count > limit else []
    while pending:
        at_once = max(1, JOB_CELLS // (some * BINS * classes))
        now, pending = pending[:at_once], pending[at_once:]
        for r in _large_nodes(base, tops, now, seed, weights, form).collect():
            top, at = tops[r["tree"]], r["at"]
            counts = np.array(r["counts"])
            if r["gain"] <= 1e-12 or int(top.heap[at]).bit_length() - 1 >= depth:
                top.votes[at] = votes_of(counts, weights)
                continue
            top_gains.append((r["tree"], r["feature"], r["gain"] * r["mass"]))
            children = top.split(at, r["feature"], r["cut"])
            pending += [(r["tree"], c) for c, n in zip(children, (r["left"], r["right"])) if n > limit]
    parts = stored(_small_nodes(base, tops, seed, weights, form, depth), "forest")
    return Forest(names, features, edges, tops, parts, top_gains, count)


def _large_nodes(base, tops, now, seed, weights, form: Bins) -> DataFrame:
    """The best split of every node in ``now``: each task adds up its rows, then the tasks' sums are added up."""
    classes, width = len(weights), form.width
    wanted: dict[int, list[int]] = {}
    for t, at in now:
        wanted.setdefault(t, []).append(at)
    own = {t: (tops[t], np.array(ats), node_features(seed, t, np.array([tops[t].heap[a] for a in ats]), width)) for t, ats in wanted.items()}
    sums = pa.schema([("tree", pa.int32()), ("at", pa.int32()), ("hist", pa.binary())])

    def add(batches):
        held = {}
        for batch in batches:
            ids, code, bins = batch.column(ROW).to_numpy(), batch.column("_code").to_numpy(), form.read(batch.column("bins"))
            for t, (top, ats, features) in own.items():
                slots = np.full(len(top.heap), -1)
                slots[ats] = np.arange(len(ats))
                slot, times = slots[top.walk(bins)], draws(seed, t, ids)
                use = np.flatnonzero((slot >= 0) & (times > 0))
                found = histograms(slot[use], features, bins[use], code[use], times[use], classes)
                held[t] = held[t] + found if t in held else found
        for t, found in held.items():
            ats = own[t][1]
            yield pa.RecordBatch.from_arrays([
                pa.array([t] * len(ats), pa.int32()), pa.array(ats, pa.int32()), pa.array([h.tobytes() for h in found], pa.binary()),
            ], schema=sums)

    schema = "tree int, at int, feature int, cut int, gain double, mass double, left double, right double, counts array<double>"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def choose(table: pa.Table) -> pa.Table:
        t, at = table.column("tree")[0].as_py(), table.column("at")[0].as_py()
        _, ats, features = own[t]
        mine = features[int(np.flatnonzero(ats == at)[0])]
        hist = sum(np.frombuffer(h.as_py()) for h in table.column("hist")).reshape(1, len(mine), classes, BINS)
        place, last, gain, mass = (v[0] for v in best_splits(hist, weights))
        counts = hist[0, 0].sum(axis=1)
        left = float(hist[0, place, :, :last + 1].sum())
        values = [t, at, int(mine[place]), int(last), float(gain), float(mass), left, float(counts.sum()) - left, counts.tolist()]
        return pa.Table.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, arrow)], schema=arrow)

    return base.mapInArrow(add, "tree int, at int, hist binary").groupBy("tree", "at").applyInArrow(choose, schema)


def _small_nodes(base, tops, seed, weights, form: Bins, depth) -> DataFrame:
    """Everything below the nodes where the tops end, each grown in the task that gets its rows."""
    sent = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("code", pa.int8()), ("times", pa.int8()), ("bins", pa.binary())])

    def send(batches):
        for batch in batches:
            ids, code, bins = batch.column(ROW).to_numpy(), batch.column("_code").to_numpy(), form.read(batch.column("bins"))
            for t, top in enumerate(tops):
                times = draws(seed, t, ids)
                use = np.flatnonzero(times)
                at = top.walk(bins[use])
                is_open = np.array([v is None for v in top.votes])[at]
                use, at = use[is_open], at[is_open]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(use), t, dtype=np.int32)), pa.array(np.array(top.heap, dtype=np.int64)[at]),
                    pa.array(code[use].astype(np.int8)), pa.array(times[use].astype(np.int8)), form.column(bins[use]),
                ], schema=sent)

    schema = "tree int, node long, feature binary, cut binary, child binary, votes binary, gains array<double>"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def finish(table: pa.Table) -> pa.Table:
        t, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        code, times = (table.column(c).to_numpy().astype(np.int64) for c in ("code", "times"))
        feature, cut, child, votes, gains = grow_below(form.read(table.column("bins")), code, times, t, node, seed, weights, depth)
        values = [t, node, feature.astype(np.int16).tobytes(), cut.astype(np.uint8).tobytes(), child.astype(np.int32).tobytes(),
                  votes.tobytes(), gains.tolist()]
        return pa.Table.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, arrow)], schema=arrow)

    rows = base.mapInArrow(send, "tree int, node long, code tinyint, times tinyint, bins binary")
    return rows.groupBy("tree", "node").applyInArrow(finish, schema)


def predict(forest: Forest, rows: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """(key, y_true, y_pred) of ``rows``: the class with most votes, of tied ones the first."""
    key, form, tops = list(key), Bins(forest.edges), forest.tops
    names = [f"_v{c}" for c in range(len(forest.classes))]
    base = binned(rows, key, forest.features, forest.edges)
    # a part of a tree meets as many rows at once as it was grown on
    blocks = max(1, math.ceil(rows.count() / max(1, forest.rows)))
    id_fields = base.select(*key).schema.fields
    sent = T.StructType([*id_fields, *T.StructType.fromDDL("tree int, node long, block int, bins binary").fields])
    voted = T.StructType([*id_fields, *[T.StructField(n, T.LongType()) for n in names]])
    sent_arrow, voted_arrow = to_arrow_schema(sent), to_arrow_schema(voted)

    def send(batches):
        for batch in batches:
            bins, ids = form.read(batch.column("bins")), batch.select(key)
            block = (batch.column(ROW).to_numpy() % blocks).astype(np.int32)
            for t, top in enumerate(tops):
                at = top.walk(bins)
                use = np.flatnonzero(np.array([v is None for v in top.votes])[at])
                yield pa.RecordBatch.from_arrays([
                    *ids.take(pa.array(use)).columns, pa.array(np.full(len(use), t, dtype=np.int32)),
                    pa.array(np.array(top.heap, dtype=np.int64)[at[use]]), pa.array(block[use]), form.column(bins[use]),
                ], schema=sent_arrow)

    def settled(batches):
        """Votes of leaves that large nodes became."""
        for batch in batches:
            bins = form.read(batch.column("bins"))
            votes = np.zeros((len(bins), len(names)), dtype=np.int64)
            for top in tops:
                if any(v is not None for v in top.votes):
                    votes += np.stack([np.zeros(len(names), dtype=np.int64) if v is None else v for v in top.votes])[top.walk(bins)]
            yield pa.RecordBatch.from_arrays([*batch.select(key).columns, *map(pa.array, np.ascontiguousarray(votes.T))], schema=voted_arrow)

    def meet(left: pa.Table, part: pa.Table) -> pa.Table:
        if part.num_rows == 0:
            # no training row of this tree came by here
            return voted_arrow.empty_table()
        get = lambda c, kind: np.frombuffer(part.column(c)[0].as_py(), dtype=kind)
        at = walk(get("feature", np.int16), get("cut", np.uint8), get("child", np.int32), form.read(left.column("bins")))
        votes = get("votes", np.int64).reshape(-1, len(names))[at]
        return pa.Table.from_arrays([*left.select(key).columns, *map(pa.array, np.ascontiguousarray(votes.T))], schema=voted_arrow)

    parts = forest.parts.drop("gains").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    at = ["tree", "node", "block"]
    votes = base.mapInArrow(send, sent).groupBy(*at).cogroup(parts.groupBy(*at)).applyInArrow(meet, voted)
    if any(v is not None for top in tops for v in top.votes):
        votes = votes.unionByName(base.mapInArrow(settled, voted))
    summed = votes.groupBy(*key).agg(F.array(*[F.sum(n) for n in names]).alias("_votes"))
    best = F.array_position("_votes", F.array_max("_votes")).cast("int")
    named = summed.select(*key, F.element_at(F.array(*[F.lit(c) for c in forest.classes]), best).alias("y_pred"))
    return rows.select(*key, F.col(label).alias("y_true")).join(named, key)


def predict_zeroed(
    forest: Forest, rows: DataFrame, key: Sequence[str], label: str, zeroed: Mapping[str, Sequence[int]], by: str = "region",
) -> DataFrame:
    """(key, ``by``, y_true, y_pred): every row as it is (``none``) and once for each name in ``zeroed`` (at most 62) with
    the features at those places set to zero. ``rows`` are read several times.

    A row is not copied: it visits a part of a tree once for all names that lead it there, and names that turn it
    nowhere else cost nothing. Votes of a name are kept as their difference from those of the row as it is."""
    key, form, tops, width = list(key), Bins(forest.edges), forest.tops, len(forest.edges)
    kinds, classes = ["none", *zeroed], len(forest.classes)
    names = [f"_v{c}" for c in range(classes)]
    hidden = np.zeros((len(kinds), width), dtype=bool)
    for k, places in enumerate(zeroed.values(), 1):
        hidden[k, list(places)] = True
    blank = np.array([np.searchsorted(e, 0.0, side="left") for e in forest.edges], dtype=np.uint8)
    flags = 1 << np.arange(len(kinds), dtype=np.int64)
    base = binned(rows, key, forest.features, forest.edges)
    id_fields = base.select(*key).schema.fields
    sent = T.StructType([*id_fields, *T.StructType.fromDDL("tree int, node long, block int, kinds long, bins binary").fields])
    voted = T.StructType([*id_fields, T.StructField("kind", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in names]])
    sent_arrow, voted_arrow = to_arrow_schema(sent), to_arrow_schema(voted)

    def ends(top: Top, bins: np.ndarray):
        """Where rows leave a top, and who is still along with the row as it is."""
        along = np.ones((len(bins), len(kinds)), dtype=bool)
        along[:, 0] = False
        start = np.arange(len(bins)), np.zeros(len(bins), dtype=np.int64)
        return *walk_zeroed(np.array(top.feature), np.array(top.cut), np.array(top.child), bins, blank, hidden, *start, along), along

    def visits(top: Top, bins: np.ndarray):
        """Row, open node of the top and the kinds that meet there as bits, each row and node once."""
        row, kind, at, along = ends(top, bins)
        is_open = np.array([v is None for v in top.votes])[at]
        row, kind, at = row[is_open], kind[is_open], at[is_open]
        bits = flags[kind] + np.where(kind == 0, along[row] @ flags, 0)
        pair, place = np.unique(row * len(top.heap) + at, return_inverse=True)
        met = np.zeros(len(pair), dtype=np.int64)
        np.bitwise_or.at(met, place, bits)
        return pair // len(top.heap), np.array(top.heap, dtype=np.int64)[pair % len(top.heap)], met

    def changes(bins, own: np.ndarray, row, kind, votes, along):
        """Votes of the rows as they are (``own``: those that are here) and what kinds that are not along differ by."""
        plain = np.zeros((len(bins), classes), dtype=np.int64)
        plain[row[kind == 0]] = votes[kind == 0]
        less = ~along & own[:, None]
        less[:, 0] = False
        away, missing = np.nonzero(less)
        return np.concatenate([row, away]), np.concatenate([kind, missing]), np.concatenate([votes, -plain[away]])

    def voting(ids, row, kind, votes):
        columns = [*ids.take(pa.array(row)).columns, pa.array(kind.astype(np.int32)), *map(pa.array, np.ascontiguousarray(votes.T))]
        return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]

    def count(batches):
        held = {}
        for batch in batches:
            bins = form.read(batch.column("bins"))
            for t, top in enumerate(tops):
                for node, n in zip(*np.unique(visits(top, bins)[1], return_counts=True)):
                    held[t, int(node)] = held.get((t, int(node)), 0) + int(n)
        trees, nodes = zip(*held) if held else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), pa.array(nodes, pa.int64()), pa.array(held.values(), pa.int64())], ["tree", "node", "n"])

    # zeroing can lead most rows to one node: it then meets them in several blocks
    limit = max(1, NODE_VALUES // width)
    counted = base.mapInArrow(count, "tree int, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n"))
    many = counted.where(F.col("n") > limit).select("tree", "node", F.ceil(F.col("n") / limit).cast("int").alias("blocks"))
    blocks: list[dict[int, int]] = [{} for _ in tops]
    for r in many.collect():
        blocks[r["tree"]][r["node"]] = r["blocks"]

    def send(batches):
        for batch in batches:
            bins, ids, hashed = form.read(batch.column("bins")), batch.select(key), batch.column(ROW).to_numpy()
            for t, top in enumerate(tops):
                row, node, met = visits(top, bins)
                some, place = np.unique(node, return_inverse=True)
                dealt = hashed[row] % np.array([blocks[t].get(int(n), 1) for n in some], dtype=np.int64)[place]
                for i in range(0, len(row), len(bins)):
                    use = slice(i, i + len(bins))
                    yield pa.RecordBatch.from_arrays([
                        *ids.take(pa.array(row[use])).columns, pa.array(np.full(len(row[use]), t, dtype=np.int32)), pa.array(node[use]),
                        pa.array(dealt[use].astype(np.int32)), pa.array(met[use]), form.column(bins[row[use]]),
                    ], schema=sent_arrow)

    def settled(batches):
        """Votes of leaves that large nodes became."""
        for batch in batches:
            bins = form.read(batch.column("bins"))
            total = np.zeros((len(bins), len(kinds), classes), dtype=np.int64)
            for top in tops:
                if any(v is not None for v in top.votes):
                    row, kind, at, along = ends(top, bins)
                    leaf = np.array([v is not None for v in top.votes])[at]
                    votes = np.stack([np.zeros(classes, dtype=np.int64) if v is None else v for v in top.votes])[at[leaf]]
                    own = np.zeros(len(bins), dtype=bool)
                    own[row[leaf & (kind == 0)]] = True
                    row, kind, votes = changes(bins, own, row[leaf], kind[leaf], votes, along)
                    np.add.at(total, (row, kind), votes)
            row, kind = np.nonzero(total.any(axis=2))
            yield pa.RecordBatch.from_arrays(voting(batch.select(key), row, kind, total[row, kind]), schema=voted_arrow)

    def meet(left: pa.Table, part: pa.Table) -> pa.Table:
        if part.num_rows == 0 or left.num_rows == 0:
            # no training row of this tree came by here, or no row to score
            return voted_arrow.empty_table()
        get = lambda c, kind: np.frombuffer(part.column(c)[0].as_py(), dtype=kind)
        bins, met = form.read(left.column("bins")), left.column("kinds").to_numpy()[:, None] & flags > 0
        own = met[:, 0]
        row, kind = np.nonzero(met & ~(own[:, None] & (np.arange(len(kinds)) > 0)))
        along = met & own[:, None]
        along[:, 0] = False
        row, kind, at = walk_zeroed(get("feature", np.int16), get("cut", np.uint8), get("child", np.int32), bins, blank, hidden, row, kind, along)
        votes = get("votes", np.int64).reshape(-1, classes)[at]
        return pa.Table.from_arrays(voting(left.select(key), *changes(bins, own, row, kind, votes, along)), schema=voted_arrow)

    spark = rows.sparkSession
    dealt = [(t, n, b) for t, own in enumerate(blocks) for n, b in own.items()]
    several = spark.createDataFrame(dealt, "tree int, node long, blocks int")
    parts = forest.parts.drop("gains").join(several, ["tree", "node"], "left")
    parts = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    at = ["tree", "node", "block"]
    votes = base.mapInArrow(send, sent).groupBy(*at).cogroup(parts.groupBy(*at)).applyInArrow(meet, voted)
    if any(v is not None for top in tops for v in top.votes):
        votes = votes.unionByName(base.mapInArrow(settled, voted))
    summed = votes.groupBy(*key, "kind").agg(F.array(*[F.sum(n) for n in names]).alias("_votes"))
    by_row = summed.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("kind", "_votes"))).alias("_all"))
    nothing = F.array(*[F.lit(0).cast("long")] * classes)
    plain = F.coalesce(F.try_element_at("_all", F.lit(0)), nothing)
    split = by_row.select(*key, plain.alias("_plain"), "_all", F.explode(F.sequence(F.lit(0), F.lit(len(kinds) - 1))).alias("kind"))
    moved = F.when(F.col("kind") > 0, F.coalesce(F.try_element_at("_all", F.col("kind")), nothing)).otherwise(nothing)
    split = split.select(*key, "kind", F.zip_with("_plain", moved, lambda a, b: a + b).alias("_votes"))
    best = F.array_position("_votes", F.array_max("_votes")).cast("int")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    named = split.select(*key, pick(kinds, F.col("kind") + 1).alias(by), pick(forest.classes, best).alias("y_pred"))
    return rows.select(*key, F.col(label).alias("y_true")).join(named, key).select(*key, by, "y_true", "y_pred")


def importances(forest: Forest) -> DataFrame:
    """Share of every feature in the trees' gains, each tree counting alike; highest first."""
    spark = forest.parts.sparkSession
    own = forest.parts.select("tree", F.posexplode("gains").alias("place", "gain"))
    if forest.top_gains:
        own = own.unionByName(spark.createDataFrame(forest.top_gains, "tree int, place int, gain double"))
    gained = own.groupBy("tree", "place").agg(F.sum("gain").alias("gain"))
    whole = gained.groupBy("tree").agg(F.sum("gain").alias("whole")).where("whole > 0")
    shares = gained.join(whole, "tree").groupBy("place").agg(F.sum(F.col("gain") / F.col("whole")).alias("share"))
    trees = whole.agg(F.count(F.lit(1)).alias("trees"))
    named = map(str, range(len(forest.edges))) if isinstance(forest.features, str) else forest.features
    names = spark.createDataFrame(list(enumerate(named)), "place int, feature string")
    share = F.coalesce(F.col("share") / F.col("trees"), F.lit(0.0))
    return names.join(shares, "place", "left").crossJoin(trees).select("feature", share.alias("importance")).orderBy(F.desc("importance"), "feature")
