"""Operator 12: the cheapest repair of a conversation's turns, with block tables (Four Russians).

A repaired conversation is empty or reads ``s?(ua)+`` in the initials of its roles. What is left of
a conversation can be in one of four states (nothing yet, after s, after u, after a); the costs of repairing
it from each state are a cost vector. Every row turns the vector behind it into the one before it.
Reduced by their least entry these vectors are few, since one insertion leads from nearly any state to
the next; so they are numbered, and the transition of every vector by every block of ``BLOCK``
symbols is computed once. A conversation is read from its end block by block through that table. Then
its blocks are expanded in the opposite direction, from the first: there every optimal continuation
is known, and of equally cheap edits the first in ASCII order is taken, which gives the least audit.

Conversations need not fit a task. Rows are range-partitioned by conversation and place, so a long conversation
falls into fragments. A fragment maps each vector behind it to one before it, and each state before it
to one behind; the fragments of one conversation, a few numbers each, are composed, and then all are traced
in parallel. Repeated rows of one turn are counted before the first shuffle, and texts travel
as hashes until the repaired rows are written.

Defined results: null roles and texts count as one space; a null id is one conversation; rows are taken by turn
(nulls first), then role, then MD5 of the text; all copies of a row but the first are duplicates; a role without a
first letter fits nowhere and cannot be kept; a conversation without rows is repaired to nothing; columns other than
those named are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import stored, whole_groups

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where an inserted or re-roled row leads, and its role.
FORCED = [(USER, "u"), (USER, "u"), (ASSISTANT, "a"), (USER, "u")]
END = (0, 2 * INSERT, INSERT, 0)
INITIALS = "sua"
NEUTRAL, SYMBOLS, BLOCK = 8, 9, 3  # symbol: 2 x initial (s, u, a, other) + cut off; neutral: deleted in any case, or no row
SPACE = r"[\x20\x09-\x0D]"
LEGAL = ["su", "ua", "au"]


def _inserted(v: list[int]) -> list[int]:
    """Costs when rows may also be inserted here."""
    for _ in range(2):
        v = [min(v[s], INSERT + v[FORCED[s][0]]) for s in range(4)]
    return v


def _options(after: tuple[int, ...], symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, state behind, cost from here on) for one row, in ASCII order."""
    cut_off = CUT_OFF * (symbol & 1)
    found = [("D", state, DELETE + after[state])]
    kept = NEXT.get((state, INITIALS[symbol >> 1])) if symbol >> 1 < 3 else None
    if kept is not None:
        found.append(("K", kept, cut_off + after[kept]))
    found.append(("R", FORCED[state][0], REROLE + cut_off + after[FORCED[state][0]]))
    return found


class BlockTables:
    """Numbered cost vectors and their transitions by rows and by blocks of rows.

    ``row[v, symbol]`` and ``block[v, code]`` are the vectors before, given ``v`` behind; ``edit[v, symbol, state]``
    is an index of ``edits`` (edit strings of one row), ``then`` the state behind it, ``states`` the same for blocks.
    """

    def __init__(self):
        number, known = {END: 0}, [END]
        row, edit, then, strings = [], [], [], {"": 0}
        for after in known:
            row.append([])
            edit.append([])
            then.append([])
            for symbol in range(SYMBOLS):
                if symbol == NEUTRAL:
                    before, traced = after, [("", s) for s in range(4)]
                else:
                    costs = _inserted([min(c for _, _, c in _options(after, symbol, s)) for s in range(4)])
                    traced = [self._trace(after, symbol, s, costs) for s in range(4)]
                    before = tuple(c - min(costs) for c in costs)
                if before not in number:
                    number[before] = len(known)
                    known.append(before)
                row[-1].append(number[before])
                edit[-1].append([strings.setdefault(t, len(strings)) for t, _ in traced])
                then[-1].append([s for _, s in traced])
        self.row, self.edit, self.then = (np.array(x, dtype=np.int16) for x in (row, edit, then))
        self.edits, self.vectors = list(strings), known
        codes = np.array(list(itertools.product(range(SYMBOLS), repeat=BLOCK)))
        v = np.repeat(np.arange(len(known))[:, None], len(codes), axis=1)
        behind = []
        for k in reversed(range(BLOCK)):
            behind.append(v)
            v = self.row[v, codes[:, k]]
        state = np.broadcast_to(np.arange(4), (*v.shape, 4))
        for k in range(BLOCK):
            state = self.then[behind[BLOCK - 1 - k][..., None], codes[None, :, k, None], state]
        self.block, self.states = v.astype(np.int16), state.astype(np.int8)
        self.tail = ["", "ua", "a", ""]  # insertions behind the last row, by state

    @staticmethod
    def _trace(after, symbol: int, state: int, costs: list[int]) -> tuple[str, int]:
        """The first of the cheapest edits up to and with this row, and the state behind it."""
        inserted = ""
        while True:
            options = {e: (s, c) for e, s, c in _options(after, symbol, state)}
            target = FORCED[state][0]
            if options["D"][1] == costs[state]:
                return inserted + "D", options["D"][0]
            if INSERT + costs[target] == costs[state]:
                inserted, state = inserted + "I", target
                continue
            for e in "KR":
                if e in options and options[e][1] == costs[state]:
                    return inserted + e, options[e][0]
            raise AssertionError("some edit has the cost of its state")

    def padded(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fragments filled up in front with neutral symbols: (symbols, place of every row, first block of each fragment and the end)."""
        sizes = np.diff(np.r_[starts, len(symbols)])
        blocks = -(-sizes // BLOCK)
        first = np.r_[0, np.cumsum(blocks)]
        place = np.arange(len(symbols)) + np.repeat(first[1:] * BLOCK - np.r_[starts[1:], len(symbols)], sizes)
        full = np.full(first[-1] * BLOCK, NEUTRAL, dtype=np.int16)
        full[place] = symbols
        return full, place, first

    @staticmethod
    def code(full: np.ndarray) -> np.ndarray:
        digits = full.reshape(-1, BLOCK).astype(np.int64)
        return digits @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def traced(self, symbols: np.ndarray, starts: np.ndarray, end: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edit string, state in front) of each row, and the state behind each fragment, given its vector behind and its state in front."""
        full, place, first = self.padded(symbols, starts)
        code, blocks = self.code(full), np.diff(first)
        order = np.argsort(-blocks, kind="stable")
        alive = np.searchsorted(-blocks[order], -np.arange(blocks.max(initial=0)), side="left")  # fragments longer than j blocks
        behind, front = np.zeros(len(code), dtype=np.int16), np.zeros(len(code), dtype=np.int8)
        v, last = end[order].astype(np.int16), first[1:][order] - 1
        for j, n in enumerate(alive):
            at = last[:n] - j
            behind[at] = v[:n]
            v[:n] = self.block[v[:n], code[at]]
        s, head = begin[order].astype(np.int8), first[:-1][order]
        for j, n in enumerate(alive):
            at = head[:n] + j
            front[at] = s[:n]
            s[:n] = self.states[behind[at], code[at], s[:n]]
        left = np.zeros_like(s)
        left[order] = s
        cells = full.reshape(-1, BLOCK)
        vectors = [behind]
        for k in range(BLOCK - 1, 0, -1):
            vectors.append(self.row[vectors[-1], cells[:, k]])
        chosen, fronts, state = np.zeros(cells.shape, dtype=np.int16), np.zeros(cells.shape, dtype=np.int8), front
        for k in range(BLOCK):
            fronts[:, k] = state
            where = (vectors[BLOCK - 1 - k], cells[:, k], state)
            chosen[:, k], state = self.edit[where], self.then[where].astype(np.int8)
        return chosen.ravel()[place], fronts.ravel()[place], left

    def summary(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one fragment: the vector before it for each vector behind, and for those the state behind for each in front."""
        full, _, _ = self.padded(symbols, np.array([0]))
        code, lanes = self.code(full), np.arange(len(self.vectors), dtype=np.int16)
        behind = np.zeros((len(code), len(lanes)), dtype=np.int16)
        v = lanes
        for j in range(len(code) - 1, -1, -1):
            behind[j] = v
            v = self.block[v, code[j]]
        state = np.repeat(np.arange(4, dtype=np.int8)[None], len(lanes), axis=0)
        for j in range(len(code)):
            state = self.states[behind[j][:, None], code[j], state]
        return v, state


TABLES: list[BlockTables] = []


def tables() -> BlockTables:
    """Built once per process."""
    if not TABLES:
        TABLES.append(BlockTables())
    return TABLES[0]


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """(key, conv_id, turn, role, text, copies), nulls filled in; ``key`` names the conversation and is never null."""
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return rows.select(key.alias("key"), F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), *filled, (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))


def distinct_turns(rows: DataFrame) -> DataFrame:
    """Rows of ``turns`` told apart by (key, turn, role, MD5 of the text), with their copies and first faults."""
    text = F.col("text")
    marks = rows.select(
        "key", "turn", "role", "copies", F.md5(text.cast("binary")).alias("hash"), (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~text.rlike(rf"[.!?]{SPACE}*\z")).alias("cut_off"),
    )
    light = marks.groupBy("key", "turn", "role", "hash").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut_off").alias("cut_off"))
    light = stored(light, "turns")
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    first = light.groupBy("key", "role", "hash").agg(F.min(place).alias("first"))
    again = light.join(first, ["key", "role", "hash"]).withColumn("again", place > F.col("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut_off"), "truncated").otherwise("")
    return again.select("key", "turn", "role", "hash", "copies", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))


ORDER = ("key", "part", "turn", "role", "hash")
EDITS = """key string, part int, at int, turn long, role string, hash string, copies long, fault string, before string, action string, new_role string,
    after string, audit string, blank long, duplicate long, truncated long, illegal long, cost long, first_initial string, last_initial string"""


def _symbols(rows: pa.Table) -> np.ndarray:
    fault = np.array(rows.column("fault").to_pylist(), dtype=object)
    initial = np.array([INITIALS.find(c) if c else -1 for c in rows.column("initial").to_pylist()])
    return np.where((fault == "blank") | (fault == "duplicate"), NEUTRAL, np.where(initial < 0, 3, initial) * 2 + (fault == "truncated")).astype(np.int16)


def _summaries(rows: pa.Table) -> pa.Table:
    before, states = tables().summary(_symbols(rows.sort_by([(c, "ascending") for c in ("key", "part")])))
    return pa.table({"key": rows.column("key")[:1], "part": rows.column("part")[:1], "before": [before.astype("<i2").tobytes()], "states": [states.astype("<i1").tobytes()]})


def _composed(parts: pa.Table) -> pa.Table:
    """For every fragment of one conversation, the vector behind it and the state in front."""
    parts = parts.sort_by("part")
    maps = [np.frombuffer(x.as_buffer(), dtype="<i2") for x in parts.column("before")]
    states = [np.frombuffer(x.as_buffer(), dtype="<i1").reshape(-1, 4) for x in parts.column("states")]
    v, behind = 0, []
    for m in reversed(maps):
        behind.append(v)
        v = int(m[v])
    behind.reverse()
    s, front = START, []
    for b, m in zip(behind, states):
        front.append(s)
        s = int(m[b, s])
    last = [False] * (len(front) - 1) + [True]
    return pa.table({"key": parts.column("key"), "part": parts.column("part"), "end": pa.array(behind, pa.int32()), "begin": pa.array(front, pa.int32()), "last": last})


def _edited(rows: pa.Table, starts: np.ndarray) -> pa.Table:
    """Rows of whole fragments with their edits; a fragment's first row carries its sums."""
    t = tables()
    col = {c: rows.column(c).to_pylist() for c in ("copies", "fault", "role", "initial", "end", "begin", "last")}
    pick = lambda c, kind: np.array([col[c][i] for i in starts], dtype=kind)
    edit, state, left = t.traced(_symbols(rows), starts, pick("end", np.int16), pick("begin", np.int8))
    out = {c: [] for c in ("at", "before", "action", "new_role", "after", "audit", "blank", "duplicate", "truncated", "illegal", "cost", "first_initial", "last_initial")}
    for f, (lo, hi) in enumerate(zip(starts, np.r_[starts[1:], rows.num_rows])):
        audit, cost, count, illegal, previous = [], 0, {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, 0, None
        for i in range(lo, hi):
            copies, fault, own, s = col["copies"][i], col["fault"][i], t.edits[edit[i]], int(state[i])
            count[fault] += copies if fault == "blank" else 1
            before = ""
            if fault in ("blank", "duplicate"):
                action, written = "D", "D" * copies
                count["duplicate"] += copies - 1 if fault == "duplicate" else 0
            else:
                for _ in range(len(own) - 1):
                    before += FORCED[s][1]
                    s = FORCED[s][0]
                action, written = own[-1], own + "D" * (copies - 1)
                count["duplicate"] += copies - 1
            cost += INSERT * len(before) + DELETE * (written.count("D")) + (REROLE if action == "R" else 0) + (CUT_OFF if fault == "truncated" and action != "D" else 0)
            illegal += copies - 1 + (previous is not None and previous + col["initial"][i] not in LEGAL)
            previous = col["initial"][i]
            audit.append(written)
            out["at"].append(i - lo)
            out["before"].append(before)
            out["action"].append(action)
            out["new_role"].append({"K": col["role"][i], "R": "assistant" if FORCED[s][1] == "a" else "user"}.get(action))
            out["after"].append("")
        if col["last"][lo]:
            tail = t.tail[left[f]]
            out["after"][-1] = tail
            audit.append("I" * len(tail))
            cost += INSERT * len(tail)
        empty = [None] * (hi - lo - 1)
        for c, x in (("audit", "".join(audit)), ("blank", count["blank"]), ("duplicate", count["duplicate"]), ("truncated", count["truncated"]), ("illegal", illegal),
                     ("cost", cost), ("first_initial", col["initial"][lo]), ("last_initial", previous)):
            out[c] += [x, *empty]
    kinds = {"at": pa.int32(), **{c: pa.int64() for c in ("blank", "duplicate", "truncated", "illegal", "cost")}}
    own = {c: rows.column(c) for c in ("key", "part", "turn", "role", "hash", "copies", "fault")}
    made = pa.table(own | {c: pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()})
    return made.select([c.split()[0] for c in EDITS.split(",")])


def edits(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per distinct turn of ``rows`` (as ``turns`` makes them): what is inserted ``before`` and ``after`` it (role initials), its ``action`` (D, K, R) and new role.

    (part, at) orders the rows of a conversation. The row with at = 0 also holds the sums of its fragment.
    ``parts`` fixes the number of ranges; without it the planner does.
    """
    ranges = [F.col(c) for c in ORDER if c != "part"]
    laid = distinct_turns(rows).repartitionByRange(*([parts] if parts else []), *ranges).withColumn("part", F.spark_partition_id())
    laid = stored(laid, "laid")
    spread = laid.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    columns = [c for c in ORDER if c != "key"] + ["copies", "fault", "initial"]
    shared = laid.join(spread, "key").select("key", *columns)
    # a fragment is no larger than a range partition; a conversation has at most one per partition
    summaries = shared.groupBy("key", "part").applyInArrow(lambda t: _summaries(t.sort_by([(c, "ascending") for c in ORDER])), "key string, part int, before binary, states binary")
    seeds = summaries.groupBy("key").applyInArrow(_composed, "key string, part int, end int, begin int, last boolean")
    ready = laid.join(seeds, ["key", "part"], "left").select(
        "key", *columns, F.coalesce("end", F.lit(0)).alias("end"), F.coalesce("begin", F.lit(START)).alias("begin"), F.coalesce("last", F.lit(True)).alias("last"))
    ready = ready.repartition(F.xxhash64("key", "part")).sortWithinPartitions(*ORDER)
    return stored(ready.mapInArrow(lambda batches: whole_groups(batches, ["key", "part"], _edited), EDITS), "edits")


def repaired(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """(key, part, at, k, role, text): the rows of all repaired conversations, in the order of (part, at, k)."""
    texts = rows.select("key", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("hash")).groupBy("key", "turn", "role", "hash").agg(F.first("text").alias("text"))
    wanted = edited.where("action != 'D' or before != '' or after != ''").select("key", "part", "at", F.col("turn"), "role", "hash", "before", "action", "new_role", "after")
    met = wanted.alias("e").join(texts.alias("t"), (F.col("e.key") == F.col("t.key")) & F.col("e.turn").eqNullSafe(F.col("t.turn")) & (F.col("e.role") == F.col("t.role")) & (F.col("e.hash") == F.col("t.hash")))
    filler = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(F.when(x == "a", "assistant").otherwise("user").alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("e.action") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(F.col("e.new_role").alias("role"), F.col("t.text").alias("text"))))
    out = met.select("e.key", "e.part", "e.at", F.posexplode(F.concat(filler("e.before"), own, filler("e.after"))).alias("k", "row"))
    return out.select("key", "part", "at", "k", "row.role", "row.text")


def _text_hashes(batches):
    """(key, sha256 of its rows' ``role:text`` joined by line ends), streamed: a conversation of any length is never held."""
    last, digest = None, None
    for batch in batches:
        keys, sums = [], []
        for key, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 4, 5))):
            line = f"{role}:{text}".encode()
            if key != last:
                if digest is not None:
                    keys.append(last)
                    sums.append(digest.hexdigest())
                last, digest = key, hashlib.sha256(line)
            else:
                digest.update(b"\n" + line)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], names=["key", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])


def digests(all_rows: DataFrame, rows: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per conversation of ``all_rows``: faults, cost, audit and hash of the repaired ``rows`` (both as ``turns`` makes them)."""
    edited = edits(rows, parts)
    gaps = edited.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    ends = F.sort_array(F.collect_list(F.struct("part", "audit", "first_initial", "last_initial")))  # a row per fragment
    sums = edited.where("at = 0").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ends.alias("f"))
    joints = F.expr("size(filter(sequence(1, size(f) - 1), i -> i >= 1 and i < size(f) and concat(f[i - 1].last_initial, f[i].first_initial) not in ('su', 'ua', 'au')))")
    sums = sums.withColumn("illegal", F.col("illegal") + F.when(F.size("f") > 1, joints).otherwise(0)).withColumn("audit", F.array_join("f.audit", ""))
    lines = repaired(rows, edited).repartition("key").sortWithinPartitions("key", "part", "at", "k")
    hashes = lines.mapInArrow(_text_hashes, "key string, repaired_sha256 string")
    asked = all_rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    full = asked.join(sums.drop("f"), "key", "left").join(gaps, "key", "left").join(hashes, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return full.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to rows of ``turns``, by a checksum of conversation and turn."""
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(named.cast("binary")) % 20
    hit = rows.withColumn("kind", kind).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return hit.select(
        "key", "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 3, F.col("copies") * 2).otherwise(F.col("copies")).alias("copies"),
    )
