"""Substring dedup with prefix-partitioned suffix trees (operator 5).

Suffixes (window starts) are split by prefix into groups that a task holds in memory (see
``anchors``; a frequent prefix is lengthened). For a group the task builds the suffix tree level by
level: the node of a suffix at depth 2d is the pair of the nodes at depth d of itself and of the
suffix d words on. Suffixes whose node has one leaf leave the tree. Internal nodes that reach the
threshold depth with two leaves or more are the deep nodes: their leaves are the repeated windows,
and neighbouring repeated windows make up the maximal repeats.

A word covered by a window whose words also start anywhere else, in the same text too, is removed;
windows are judged on the input. Null text has no words; texts shorter than a window keep all.
Equal rows (id and text) are separate places, so their windows repeat. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tsengine.llm.anchors import MOST, Group, Unit, keyed, placed, repeated_runs
from tsengine.llm.common import covered, spread, steps, utf8, words


def nodes_at(tokens: np.ndarray, starts: np.ndarray, top: np.ndarray, depth: int) -> np.ndarray:
    """Node of each suffix (``starts``) at ``depth``: suffixes share it when their first ``depth``
    tokens and their ``top`` are equal; -1 for a leaf that is alone before."""
    node, d = tokens, 1
    while 2 * d <= depth:
        # the node at 2d of every place from the nodes at d of the place and of the place d on
        key = node[:-d].astype(np.int64) << 32 | node[d:] if len(node) > d else np.zeros(0, np.int64)
        node = np.unique(key, return_inverse=True)[1].reshape(-1)
        d *= 2
    first, second = node[starts], node[starts + depth - d]
    order = np.lexsort((second, first, top))
    same = np.zeros(len(order), bool)
    if len(order):
        f, s, t = first[order], second[order], top[order]
        same[1:] = (f[1:] == f[:-1]) & (s[1:] == s[:-1]) & (t[1:] == t[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~same) - 1
    leaves = np.bincount(out, minlength=1)
    return np.where(leaves[out] > 1, out, -1) if len(out) else out


def subtree(length: int):
    """Resolver of ``anchors`` for word windows."""
    def resolve(g: Group) -> np.ndarray:
        lists = [c.split(b" ") for c in g.content]
        sizes = np.array([len(x) for x in lists], np.int64)
        number: dict[bytes, int] = {}
        tokens = np.fromiter((number.setdefault(w, len(number)) for x in lists for w in x), np.int64, int(sizes.sum()))
        base = np.cumsum(sizes) - sizes
        starts = spread(base, g.windows)
        seg = np.repeat(np.arange(len(g.windows)), g.windows)
        # the prefix (gram) and how far before it a suffix starts stand for the path to the subtree
        top = np.unique(g.gram, return_inverse=True)[1].reshape(-1)[seg] * (length + 1) + g.lead[seg] - (starts - base[seg])
        cls = nodes_at(tokens, starts, top, length)
        # one suffix of a segment with several places is a node with several leaves
        return cls

    return resolve


def dedup_words(docs: DataFrame, length: int = 35, gram: int = 8, most: int = MOST, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept (the words that stay, joined
    by one space) of every row of ``docs``."""
    rows = keyed(docs)
    runs = repeated_runs(placed(rows), Unit("words", length, gram), subtree(length), False, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(1))
            found = b.column(2).to_pylist()
            for i, j in steps(offs):
                part, po = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                ws, we, rows = words(part, po)
                raw = part.tobytes()
                n_words, removed, sha, kept = [], [], [], []
                for k in range(j - i):
                    n = int(rows[k + 1] - rows[k])
                    gone = None
                    if found[i + k]:
                        first = np.array([r["first"] for r in found[i + k]], np.int64)
                        size = np.array([r["windows"] for r in found[i + k]], np.int64)
                        gone = covered(n, first, first + size + length - 1)
                    if gone is None:
                        text = b" ".join(raw[po[k]:po[k + 1]].split())
                    else:
                        stay = np.flatnonzero(~gone) + rows[k]
                        text = b" ".join([raw[a:z] for a, z in zip(ws[stay].tolist(), we[stay].tolist(), strict=True)])
                    n_words.append(n)
                    removed.append(0 if gone is None else int(gone.sum()))
                    sha.append(hashlib.sha256(text).hexdigest())
                    if texts:
                        kept.append(text.decode())
                cols = [b.column(0).slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.string())] if texts else []),
                                                 names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (rows.join(runs, "rid", "left").select("doc_id", "text", "runs")
            .mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts))
