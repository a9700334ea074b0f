"""Flow edges of a key that is too large for one task, without a chain from chunk to chunk.

What a chunk does to the flow that runs into it depends on two things alone: when that flow
started, and which of its sides have sent a FIN (the mode). So a chunk is a function from
(mode, start) to the flow that leaves it, and the function is a list of steps: all starts between
two bounds lead to the same last flow, or the flow passes the whole chunk. Steps of neighbouring
chunks are composed in pairs, then in fours and so on; the flow into each chunk is then read off
from the top down. Both ways take one round per doubling of the chunks, and functions and flows
stay in tables. A function has at most three steps for every distinct time within one timeout.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from packetloom.operators.ordered import CHUNK, Kernel, frozen_chunks, sorted_rows, stored

SPAN = "_span"
#: A start that every packet has outlived: the flow before has ended, or there is none.
FRESH = -(2**62)
NEVER = 2**62
MODES = (0, 1, 2)

STEPS = T.StructType([
    T.StructField("mode", T.ByteType()),
    T.StructField("since", T.LongType()),
    T.StructField("upto", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("head", T.LongType()),
    T.StructField("next_mode", T.ByteType()),
    T.StructField("passes", T.BooleanType()),
])
#: What a piece (the rows of one key in one chunk) leaves of the flow that runs out of it.
LEFT = T.StructType([
    T.StructField("opened", T.BooleanType()),
    T.StructField("start", T.LongType()),
    T.StructField("head", T.LongType()),
    T.StructField("head_side", T.BooleanType()),
    T.StructField("count", T.LongType()),
    T.StructField("last_a", T.LongType()),
    T.StructField("last_b", T.LongType()),
    T.StructField("fin_a", T.BooleanType()),
    T.StructField("fin_b", T.BooleanType()),
    T.StructField("ended", T.BooleanType()),
    T.StructField("segment", T.LongType()),
    T.StructField("first_us", T.LongType()),
    T.StructField("last_us", T.LongType()),
    T.StructField("first_side", T.BooleanType()),
])


class Steps:
    """Columns of a step function, sorted by mode and bound."""

    NAMES = STEPS.fieldNames()

    def __init__(self, mode, since, upto, start, head, next_mode, passes):
        self.columns = [np.asarray(c) for c in (mode, since, upto, start, head, next_mode, passes)]
        self.mode, self.since, self.upto, self.start, self.head, self.next_mode, self.passes = self.columns

    @classmethod
    def of_table(cls, table: pa.Table) -> "Steps":
        table = table.sort_by([("mode", "ascending"), ("since", "ascending")])
        return cls(*[table.column(c).to_numpy() for c in cls.NAMES])

    @classmethod
    def stacked(cls, parts: Sequence["Steps"]) -> "Steps":
        return cls(*[np.concatenate(c) for c in zip(*[p.columns for p in parts])])

    def take(self, rows) -> "Steps":
        return Steps(*[c[rows] for c in self.columns])

    def merged(self) -> "Steps":
        """Neighbours that lead to the same flow as one step; empty steps go."""
        own = self.take(np.flatnonzero(self.since < self.upto))
        if not len(own.mode):
            return own
        start, head = np.where(own.passes, 0, own.start), np.where(own.passes, 0, own.head)
        differs = np.zeros(len(own.mode) - 1, dtype=bool)
        for c in (own.mode, own.passes, own.next_mode, start, head):
            differs |= c[1:] != c[:-1]
        firsts = np.concatenate([[0], np.flatnonzero(differs) + 1])
        lasts = np.append(firsts[1:] - 1, len(own.mode) - 1)
        return Steps(own.mode[firsts], own.since[firsts], own.upto[lasts], start[firsts], head[firsts],
                     own.next_mode[firsts], own.passes[firsts])

    def then(self, later: "Steps") -> "Steps":
        """This function followed by ``later``."""
        parts = []
        for mode in MODES:
            own = self.take(np.flatnonzero(self.mode == mode))
            met = own.take(np.flatnonzero(~own.passes))
            start, head, next_mode = met.start.copy(), met.head.copy(), met.next_mode.copy()
            for between in MODES:
                rows = np.flatnonzero(met.next_mode == between)
                second = later.take(np.flatnonzero(later.mode == between))
                hit = second.take(np.searchsorted(second.upto, met.start[rows], side="right"))
                start[rows] = np.where(hit.passes, met.start[rows], hit.start)
                head[rows] = np.where(hit.passes, met.head[rows], hit.head)
                next_mode[rows] = hit.next_mode
            pieces = [Steps(met.mode, met.since, met.upto, start, head, next_mode, met.passes)]
            for row in np.flatnonzero(own.passes):  # at most one stretch of a mode passes
                second = later.take(np.flatnonzero(later.mode == own.next_mode[row]))
                since, upto = np.maximum(second.since, own.since[row]), np.minimum(second.upto, own.upto[row])
                pieces.append(Steps(np.full(len(since), mode, dtype=np.int8), since, upto, *second.columns[3:]))
            joined = Steps.stacked(pieces)
            parts.append(joined.take(np.argsort(joined.since, kind="stable")).merged())
        return Steps.stacked(parts)

    def to_columns(self) -> dict[str, pa.Array]:
        kinds = to_arrow_schema(STEPS)
        return {c: pa.array(v, type=kinds.field(c).type) for c, v in zip(self.NAMES, self.columns)}


class SpanKernel(Kernel):
    """A kernel whose keys can be folded in spans. ``piece`` is the sorted rows of one key in one chunk."""

    def steps(self, piece: pa.Table) -> Steps:
        raise NotImplementedError

    def left(self, piece: pa.Table, start: int, head: int, mode: int) -> tuple:
        """The fields of ``LEFT`` when that flow runs into the piece."""
        raise NotImplementedError

    def carry(self, row: dict):
        """The state that the kernel's call takes, from a row of :func:`_running`."""
        raise NotImplementedError


def fold_in_spans(
    hot: DataFrame, keys: Sequence[str], order: Sequence[str], kernel: SpanKernel, schema: T.StructType, max_key_rows: int,
) -> DataFrame:
    """``kernel`` over keys that are cut into chunks; see the module's description."""
    keys = list(keys)
    frozen = frozen_chunks(hot, keys, order, max_key_rows)
    entries, pieces = _entries(frozen, keys, order, kernel)
    into = entries.where(F.col(SPAN) > 0).select(F.col(CHUNK), "start", "head", "mode")
    key_fields = [hot.schema[c] for c in keys]
    left_schema = T.StructType([*key_fields, T.StructField(CHUNK, T.IntegerType()), *LEFT.fields])
    left_arrow = to_arrow_schema(left_schema)

    def settle(table: pa.Table, entry: pa.Table) -> pa.Table:
        table, starts = sorted_rows(table, keys, order)
        known = entry.to_pylist()
        rows = []
        for at, piece in _pieces(table, starts):
            flow = known[0] if known and at == 0 else {"start": FRESH, "head": 0, "mode": 0}
            named = [piece.column(c)[0].as_py() for c in keys]
            rows.append([*named, piece.column(CHUNK)[0].as_py(), *kernel.left(piece, flow["start"], flow["head"], flow["mode"])])
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), left_arrow)], schema=left_arrow)

    left = stored(frozen.groupBy(CHUNK).cogroup(into.groupBy(CHUNK)).applyInArrow(settle, left_schema), "left")
    running = _running(left, keys, kernel)
    arrow_schema = to_arrow_schema(schema)

    def run(table: pa.Table, state: pa.Table) -> pa.Table:
        table, starts = sorted_rows(table, keys, order)
        carry = kernel.carry(state.to_pylist()[0]) if state.num_rows else None
        out, _ = kernel(table, starts, carry, True)
        return out.select(arrow_schema.names).cast(arrow_schema)

    return frozen.groupBy(CHUNK).cogroup(running.groupBy(CHUNK)).applyInArrow(run, schema)


def _pieces(table: pa.Table, starts: np.ndarray):
    for begin, end in zip(starts, [*starts[1:], table.num_rows]):
        yield int(begin), table.slice(begin, end - begin)


def _entries(frozen: DataFrame, keys, order, kernel: SpanKernel) -> tuple[DataFrame, DataFrame]:
    """The flow that runs into every piece: (keys, chunk, span, start, head, mode)."""
    key_fields = [frozen.schema[c] for c in keys]
    first_schema = T.StructType([*key_fields, T.StructField(CHUNK, T.IntegerType()), *STEPS.fields])
    span_schema = T.StructType([*key_fields, T.StructField(SPAN, T.IntegerType()), *STEPS.fields])

    def tabled(named: dict, steps: Steps, like: T.StructType) -> pa.Table:
        kinds, columns = to_arrow_schema(like), steps.to_columns()
        count = len(steps.mode)
        return pa.Table.from_arrays(
            [columns[f.name] if f.name in columns else pa.array([named[f.name]] * count, type=f.type) for f in kinds], schema=kinds,
        )

    def survey(table: pa.Table) -> pa.Table:
        table, starts = sorted_rows(table, keys, order)
        return pa.concat_tables([
            tabled({c: piece.column(c)[0].as_py() for c in [*keys, CHUNK]}, kernel.steps(piece), first_schema)
            for _, piece in _pieces(table, starts)
        ])

    def compose(table: pa.Table) -> pa.Table:
        spans = table.column(SPAN).to_numpy()
        named = {c: table.column(c)[0].as_py() for c in keys} | {SPAN: int(spans[0]) // 2}
        halves = [Steps.of_table(table.filter(pa.array(spans == s))) for s in np.unique(spans)]
        return tabled(named, halves[0] if len(halves) == 1 else halves[0].then(halves[1]), span_schema)

    first = stored(frozen.groupBy(CHUNK).applyInArrow(survey, first_schema), "steps")
    # a row per chunk and key; chunks of a key follow each other
    pieces = first.select(*keys, CHUNK).distinct().withColumn(
        SPAN, F.row_number().over(Window.partitionBy(*keys).orderBy(CHUNK)) - 1)
    pieces = stored(pieces, "pieces")
    top = pieces.agg(F.max(SPAN)).first()[0] or 0
    levels = [first.join(pieces, [*keys, CHUNK]).select(*span_schema.names)]
    while top > 1:
        pairs = levels[-1].groupBy(*keys, F.expr(f"{SPAN} div 2").alias("_pair"))
        levels.append(stored(pairs.applyInArrow(compose, span_schema), "steps"))
        top //= 2

    flows = pieces.select(*keys).distinct().select(
        *keys, F.lit(0).alias(SPAN), F.lit(FRESH).alias("start"), F.lit(0).cast("long").alias("head"), F.lit(0).cast("byte").alias("mode"))
    for level in reversed(levels):
        # the left half gets the flow itself, the right half what the left one makes of it
        steps = level.select(
            *keys, (F.col(SPAN) / 2).cast("int").alias(SPAN), "mode", "since", "upto", F.col("start").alias("_start"),
            F.col("head").alias("_head"), "next_mode", "passes",
        ).where(level[SPAN] % 2 == 0).alias("f")
        came = flows.alias("s")
        same = [F.col(f"s.{c}") == F.col(f"f.{c}") for c in [*keys, SPAN, "mode"]]
        within = (F.col("s.start") >= F.col("f.since")) & (F.col("s.start") < F.col("f.upto"))
        half = lambda at, start, head, mode: F.struct(at.cast("int").alias(SPAN), start.alias("start"), head.alias("head"), mode.alias("mode"))
        kept = lambda own, new: F.when(F.col("f.passes"), F.col(own)).otherwise(F.col(new))
        both = F.array(
            half(F.col(f"s.{SPAN}") * 2, F.col("s.start"), F.col("s.head"), F.col("s.mode")),
            half(F.col(f"s.{SPAN}") * 2 + 1, kept("s.start", "f._start"), kept("s.head", "f._head"), F.col("f.next_mode")),
        )
        flows = (
            came.join(steps, [*same, within], "left")
            .select(*[F.col(f"s.{c}").alias(c) for c in keys], F.explode(both).alias("_half"))
            .select(*keys, "_half.*").where("mode is not null")
        )
    return flows.join(pieces, [*keys, SPAN]), pieces


def _running(left: DataFrame, keys, kernel: SpanKernel) -> DataFrame:
    """The running flow at the start of every chunk that goes on with a key: a row per piece, combined over the
    pieces since the one that opened the flow."""
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    flow = Window.partitionBy(*keys, "_flow").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda c: F.last(c, ignorenulls=True).over(flow)
    paused = ~F.col("opened") & (F.col("first_us") - F.lag("last_us").over(along) > kernel.gap_us)
    numbered = (
        left.withColumn("_flow", F.sum(F.col("opened").cast("int")).over(along))
        .withColumn("segment", F.coalesce("segment", F.when(paused, F.col("first_us"))))
        .withColumn("initiator", F.first("first_side").over(along))
    )
    after = numbered.select(
        *keys, CHUNK, "initiator", "ended",
        *[F.first(c).over(flow).alias(c) for c in ("start", "head", "head_side")],
        F.sum("count").over(flow).alias("count"),
        *[latest(c).alias(c) for c in ("last_a", "last_b", "segment")],
        *[F.max(c).over(flow).alias(c) for c in ("fin_a", "fin_b")],
    )
    fields = [c for c in after.columns if c not in (*keys, CHUNK)]
    handed = after.select(CHUNK, F.lag(F.struct(*fields)).over(along).alias("_state"))
    return handed.where("_state is not null").select(CHUNK, "_state.*")
