"""Operator 12 against a plain dynamic program over all repairs, with fragments forced."""

import hashlib
import random
import re
import zlib

import pytest

from packetloom.llm import dialogue_repair
from packetloom.llm.queries import op12_dialogue_repair

SCHEMA = "key int, conv_id long, part string, turn long, at int, role string, hash string, text string"
RULE = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def plain(rows):
    """Expected row of one conversation; ``rows`` are (turn, role, text) after damage, copies listed."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    known = [r[0] for r in rows if r[0] is not None]
    count, seen, illegal = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, set(), 0
    best = {0: (0, "", ())}

    def inserted(states):
        for _ in range(4):
            for s, (c, a, out) in list(states.items()):
                for i in "ua":
                    if (s, i) in RULE:
                        new = (c + 3, a + "I", (*out, f"{NAMES[i]}:"))
                        t = RULE[s, i]
                        states[t] = min(states.get(t, new), new)
        return states

    best = inserted(best)
    for k, (_, role, text) in enumerate(rows):
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        count[fault] += 1
        illegal += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        new = {}

        def offer(state, value):
            new[state] = min(new.get(state, value), value)

        for s, (c, a, out) in best.items():
            offer(s, (c + 4, a + "D", out))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if (s, role[:1]) in RULE:
                    offer(RULE[s, role[:1]], (c + more, a + "K", (*out, f"{role}:{text}")))
                for i in "ua":
                    if (s, i) in RULE:
                        offer(RULE[s, i], (c + 3 + more, a + "R", (*out, f"{NAMES[i]}:{text}")))
        best = inserted(new)
    cost, audit, out = min(best[s] for s in (0, 3) if s in best)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def sample(seed, n):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "User", "été", "a"], ["Yes.", "no", "Why?\n ", "", " \t", None, "one two!", "é", "end. x"]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            role = rng.choice(roles) if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            text = rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."
            rows += [(conv, rng.choice([None, turn, turn, turn, turn + 3]), role, text)] * rng.choice([1, 1, 1, 1, 3])
    rows += [(10_000, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{k}.", f"{k}?"])) for k in range(700)]
    return rows


def checked(spark, rows, parts):
    data = spark.createDataFrame([(1, c, "p", t, 2, r, "h", x) for c, t, r, x in rows], SCHEMA)
    turned = dialogue_repair.turns(data)
    got = sorted((tuple(r) for r in dialogue_repair.digests(turned, dialogue_repair.damaged(turned), parts).collect()), key=str)
    assert got == sorted(((conv, *plain(own)) for conv, own in after_damage(rows).items()), key=str)


@pytest.mark.parametrize("seed, parts", [(1, None), (2, 7), (3, 23)])
def test_equals_plain_program(spark, seed, parts):
    checked(spark, sample(seed, 60), parts)


def test_one_conversation_in_many_fragments(spark):
    rng = random.Random(9)
    checked(spark, [(5, k, rng.choice(["user", "assistant"]), rng.choice([f"{k}.", f"{k}", "again."])) for k in range(1500)], 16)


def test_conversation_without_rows_and_empty_table(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    checked(spark, [(1, gone, "user", "Gone.")], None)
    checked(spark, [], None)


def test_tables_hold_few_vectors():
    t = dialogue_repair.BlockTables()
    assert len(t.vectors) < 100 and t.block.shape == (len(t.vectors), dialogue_repair.SYMBOLS ** dialogue_repair.BLOCK)


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in op12_dialogue_repair(spark, folder).collect())
    assert got == sorted((conv, *plain(own)) for conv, own in after_damage(rows).items())
