"""Step functions of chunks: composed they say what the plain fold says; jobs grow with the doublings."""

import random

import pyarrow as pa
import pytest

from packetloom.operators import flows as fl
from packetloom.operators.spans import FRESH, Steps
from tests.plain import SCHEMA, fold_flows
from tests.test_flows import A, B, SECOND, packet

KERNEL = fl.FlowKernel(120 * SECOND, 5 * SECOND)


def piece(rows):
    return pa.table({
        "ts_us": pa.array([r[0] for r in rows], pa.int64()), "capture_packet_index": pa.array(range(len(rows)), pa.int64()),
        "protocol": pa.array([6] * len(rows), pa.int32()), "tcp_flags": pa.array([r[2] for r in rows], pa.int32()),
        "from_b": pa.array([r[1] for r in rows]),
    })


def walked(rows, first, start, head, mode):
    """The flow after ``rows`` packet by packet: (start, head, mode), all fresh when it has ended."""
    for i, (at, from_b, flags) in enumerate(rows):
        if at - start > KERNEL.timeout_us:
            start, head, mode = at, first + i, 0
        if flags & 4:
            start, head, mode = FRESH, 0, 0
        elif flags & 1:
            mode |= 2 if from_b else 1
            if mode == 3:
                start, head, mode = FRESH, 0, 0
    return start, head, mode


def applied(steps, start, head, mode):
    own = steps.take((steps.mode == mode) & (steps.since <= start) & (start < steps.upto))
    assert len(own.mode) == 1
    kept = bool(own.passes[0])
    return (start if kept else int(own.start[0])), (head if kept else int(own.head[0])), int(own.next_mode[0])


@pytest.mark.parametrize("seed", range(40))
def test_composed_steps_equal_the_walk(seed):
    rnd = random.Random(seed)
    gaps = rnd.choice([[0, SECOND, 7 * SECOND], [0, 30 * SECOND, 120 * SECOND, 121 * SECOND], [5 * SECOND]])
    flags = rnd.choice([[16], [16] * 9 + [17], [16] * 9 + [17, 4], [17, 4]])
    rows, at = [], 0
    for _ in range(rnd.randint(4, 60)):
        at += rnd.choice(gaps)
        rows.append((at, rnd.random() < 0.5, rnd.choice(flags)))
    cuts = sorted(rnd.sample(range(1, len(rows)), min(3, len(rows) - 1)))
    functions = []
    for begin, end in zip([0, *cuts], [*cuts, len(rows)]):
        part = piece(rows).slice(begin, end - begin)
        functions.append(KERNEL.steps(part))
        for mode in (0, 1, 2):
            for start in [FRESH, *(rows[begin][0] - g * SECOND for g in (0, 1, 60, 119, 120))]:
                start, own = (start, mode) if start != FRESH else (FRESH, 0)
                assert applied(functions[-1], start, -1, own) == walked(rows[begin:end], begin, start, -1, own)
    whole = functions[0]
    for later in functions[1:]:
        whole = whole.then(later)
    for mode in (0, 1, 2):
        for start in (rows[0][0] - g * SECOND for g in (0, 1, 33, 119, 120)):
            assert applied(whole, start, -1, mode) == walked(rows, 0, start, -1, mode)
    assert isinstance(whole, Steps) and applied(whole, FRESH, -1, 0) == walked(rows, 0, FRESH, -1, 0)


def flood(count, gap, fins=()):
    return [packet(i, i * gap, *((A, B) if i % 3 else (B, A)), flags=17 if i in fins else 16) for i in range(count)]


@pytest.mark.parametrize("name,rows", [
    ("no end at all", flood(90, SECOND)),
    ("phases never meet", flood(90, 7 * SECOND)),
    ("one time for all", flood(60, 0)),
    ("fins in distant chunks", flood(90, SECOND, fins=(4, 5, 6, 40, 41, 70, 83))),
])
def test_unbroken_floods_in_every_column(spark, name, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    full = lambda limit: sorted(map(tuple, fl.group_into_flows(table, max_key_rows=limit).collect()), key=str)
    found = fl.group_into_flows(table, max_key_rows=10).collect()
    assert {(r.capture_file, r.capture_packet_index): (r.flow_id, r.packet_index, r.direction) for r in found} == fold_flows(rows)
    assert full(10) == full(1000)


def test_rounds_grow_with_the_doublings_of_the_chunks(spark, monkeypatch):
    """Four times the chunks: two more tables of composed steps, and no other."""
    from packetloom.operators import spans

    written = []
    monkeypatch.setattr(spans, "stored", lambda df, purpose: written.append(purpose) or store(df, purpose))
    from packetloom.operators.ordered import stored as store

    table = spark.createDataFrame(flood(64, SECOND), SCHEMA)
    counts = []
    for limit in (32, 8):  # chunks of 16 and of 4 rows
        written.clear()
        assert fl.group_into_flows(table, max_key_rows=limit).count() == 64
        counts.append(written.count("steps"))
    assert counts[1] <= counts[0] + 2 and len(written) == counts[1] + 2
