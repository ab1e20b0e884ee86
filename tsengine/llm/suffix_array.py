"""Suffix-array dedup by a depth-limited radix sort (operator 7).

Suffixes that start a window are ordered only through the window's length: passes by the most
significant digit (eight bytes), each inside the buckets the pass before has left, and a suffix alone in
its bucket is in order and leaves. Buckets that are left at full depth hold exactly the equal
windows. The buckets of the first pass are the groups of ``anchors`` (suffixes that share a gram at
one offset), which Spark deals to tasks.

A byte is removed when a window over it also starts earlier (smaller doc_id, or the same and an
earlier start), judged on the input; matches never cross texts. Null text is empty; shorter texts
than a window keep all. Rows with null doc_id come last and tie with each other; places that tie in
(doc_id, start) are not earlier than one another. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tsengine.llm.anchors import MOST, Group, Unit, keyed, placed, repeated_runs
from tsengine.llm.common import covered, spread, utf8

DIGIT = 8


def radix_classes(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, depth: int) -> np.ndarray:
    """Class of every suffix by its first ``depth`` bytes within its bucket; -1 if alone."""
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)])
    out = np.full(len(starts), -1, np.int64)
    live, bucket = np.arange(len(starts)), np.unique(bucket, return_inverse=True)[1].reshape(-1)
    for at in range(0, depth, DIGIT):
        wide = min(DIGIT, depth - at)
        place = starts[live] + at
        digit = np.zeros(len(live), np.uint64)
        for k in range(wide):
            digit = (digit << np.uint64(8)) | padded[place + k]
        order = np.lexsort((digit, bucket))
        b, d = bucket[order], digit[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (d[1:] != d[:-1])
        number = np.cumsum(new) - 1
        many = np.bincount(number, minlength=1)[number] > 1 if len(number) else np.zeros(0, bool)
        live, bucket = live[order][many], number[many]
        if not len(live):
            return out
    out[live] = np.unique(bucket, return_inverse=True)[1].reshape(-1)
    return out


def radix(length: int):
    """Resolver of ``anchors`` for byte windows."""
    def resolve(g: Group) -> np.ndarray:
        data = np.frombuffer(b"".join(g.content), np.uint8)
        sizes = np.array([len(c) for c in g.content], np.int64)
        base = np.cumsum(sizes) - sizes
        starts = spread(base, g.windows)
        seg = np.repeat(np.arange(len(g.windows)), g.windows)
        bucket = np.unique(g.gram, return_inverse=True)[1].reshape(-1)[seg] * (length + 1) + g.lead[seg] - (starts - base[seg])
        return radix_classes(data, starts, bucket, length)

    return resolve


def _whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without characters that it covers in part only."""
    head = (raw & 0xC0) != 0x80
    char = np.cumsum(head) - 1
    size, cut = np.bincount(char), np.bincount(char, gone)
    return (cut == size)[char]


def dedup_bytes(docs: DataFrame, length: int = 100, gram: int = 28, most: int = MOST, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept and carry (the other
    columns of the row) of every row of ``docs``. ``kept`` is text: a character of which only some
    bytes are removed stays whole in it."""
    rows = keyed(docs, carry=texts)
    runs = repeated_runs(placed(rows), Unit("bytes", length, gram), radix(length), True, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(1))
            size, removed, spans, sha, kept = [], [], [], [], []
            for k, found in enumerate(b.column(2).to_pylist()):
                raw = data[offs[k]:offs[k + 1]]
                stay, n, m = raw, 0, 0
                text = raw
                if found:
                    first = np.array([r["first"] for r in found], np.int64)
                    gone = covered(len(raw), first, first + np.array([r["windows"] for r in found], np.int64) + length - 1)
                    n, m = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    stay = raw[~gone]
                    text = raw[~_whole_characters(raw, gone)] if texts else raw
                size.append(len(raw))
                removed.append(n)
                spans.append(m)
                sha.append(hashlib.sha256(stay.tobytes()).hexdigest())
                if texts:
                    kept.append(text.tobytes().decode())
            cols = [b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.string()), b.column(3)] if texts else []),
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "carry"] * texts)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if texts:
        schema += f", kept string, carry {rows.schema['carry'].dataType.simpleString()}"
    return rows.join(runs, "rid", "left").select("doc_id", "text", "runs", *["carry"] * texts).mapInArrow(run, schema)
