"""What a Python worker keeps between tasks."""

import subprocess
import sys

import public_tokenizers

from packetloom.llm import byte_bpe

SCRIPT = """
import os
import numpy as np, pyarrow as pa
from packetloom.llm.common import lean

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

kept = []

def work(batches):
    for batch in batches:
        held = [np.ones(6_000) for _ in range(4_000)]  # 192 MB in pieces that malloc does not map one by one
        kept.append(bytes(100_000))  # stays on top
        del held
        yield batch

batch = pa.RecordBatch.from_pydict({"x": [1]})
before = resident()
for fn in (work, lean(work)):
    assert [b.num_rows for b in fn(iter([batch]))] == [1]
    print(resident() - before)
"""


def test_freed_memory_leaves_the_worker():
    done = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, check=True)
    plain, leaned = map(int, done.stdout.split())
    assert plain > 100 and leaned < 30


def test_encoder_forgets_rare_pre_tokens():
    vocabulary = byte_bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    letters = str.maketrans("0123456789", "qwzxvkjyhb")
    words = [f" {k:06d}".translate(letters) for k in range(300_000)]
    for at in range(0, len(words), 5_000):
        vocabulary.encode("".join(words[at:at + 5_000]))
        assert vocabulary.encode(" the") == vocabulary.piece_ids(" the")
    held = {**vocabulary.older, **vocabulary.seen}
    assert len(vocabulary.seen) + len(vocabulary.older) <= (1 << 18) + 20_000 < len(words)
    assert " the" in held and all(held[w] == vocabulary.piece_ids(w) for w in words[-1_000:])
