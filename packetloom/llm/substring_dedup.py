"""Operator 8: substring dedup by factoring documents relative to indexed reference blocks.

Every document is parsed into factors, content-defined runs of 13-word windows, and each
factor is looked up in every reference block: the buckets of an index over the runs of all
documents. A factor found whole in a document with a smaller id is a duplicate span. Where a
passage begins or ends, factors differ although windows inside them agree; there (the
factor boundaries) the single windows are looked up in the same way. Together this
is exact for every window, and no document is compared with every block by reading it again:
a parser that walks each document along each block would cost documents x blocks.

Words are runs of bytes other than white space (0x20, 0x09-0x0D), taken as they are. Defined
results: null and empty texts have no words; texts shorter than a window lose nothing; of
rows with equal doc_id none is smaller; a null id is larger than all; other columns do not matter.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm import repeats
from packetloom.llm.hashes import BASES, Prefix, Runs, mixed, word_values

WINDOW, GRAM = 13, 5


def _window_entries(values: np.ndarray, edges: np.ndarray, runs: Runs, part: pa.RecordBatch) -> repeats.Entries:
    """The single windows of contested runs."""
    lists = part.column(part.schema.get_field_index("contested")).to_pylist()
    which = np.concatenate([np.searchsorted(runs.text, t) + np.unique(np.array(own, dtype=np.int64)) for t, own in enumerate(lists)])
    counts = runs.count[which]
    starts = np.repeat(runs.first[which] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    text = np.repeat(runs.text[which], counts)
    a, b = (mixed(Prefix(values, base).spans(edges[text] + starts, edges[text] + starts + WINDOW)) for base in BASES)
    doc, key = np.asarray(part.column(0))[text], np.asarray(part.column(1))[text]
    return {"doc": doc, "key": key, "at": starts.astype(np.uint32), "a": a, "b": b}


def _compare(suspects: DataFrame, buckets: int) -> DataFrame:
    def fn(batches):
        for batch in batches:
            for part, texts in repeats.unsqueezed(batch):
                values, edges = word_values(*repeats.joined(texts))
                entries = _window_entries(values, edges, Runs(values, edges, WINDOW, GRAM), part)
                yield from repeats.ask(entries, buckets, True, repeats.WINDOW)

    return repeats.answered(suspects.mapInArrow(fn, repeats.PACKED), buckets, True, repeats.WINDOW)


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): removed stretches of words, and the rest joined by single spaces."""
    found = repeats.repeated(docs, word_values, WINDOW, GRAM, True, _compare)

    def fn(batches):
        for batch in batches:
            for part, texts in repeats.unsqueezed(batch):
                wholes, singles = part.column(2).to_pylist(), part.column(3).to_pylist()
                hit = [k for k in range(len(texts)) if wholes[k] or singles[k]]
                values, edges = word_values(*repeats.joined([texts[k] for k in hit]))
                runs = Runs(values, edges, WINDOW, GRAM)
                counts, gone, spans, kept = [], [0] * len(texts), [[] for _ in texts], []
                masks = {k: repeats.covered(runs, t, int(edges[t + 1] - edges[t]), wholes[k], singles[k], WINDOW) for t, k in enumerate(hit)}
                for k, text in enumerate(texts):
                    words = text.split()
                    counts.append(len(words))
                    if k in masks:
                        flips = np.flatnonzero(np.diff(np.r_[False, masks[k], False].astype(np.int8)))
                        gone[k] = int(masks[k].sum())
                        spans[k] = [{"start": int(a), "end": int(b)} for a, b in flips.reshape(-1, 2)]
                        words = compress(words, ~masks[k])
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return found.mapInArrow(fn, repeats.result_schema(found, "n_words", T.StringType()))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
