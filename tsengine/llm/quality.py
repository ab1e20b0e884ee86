"""Quality classifier: a byte-level convolutional network in numpy (operator 10).

Filters of WIDTH bytes run over overlapping chunks that cover the whole text. In each chunk every
filter is max-pooled; a linear layer turns the pooled values into the chunk's log-odds, and the
chunks' log-odds, weighted by the bytes they hold, average into the text's one probability.

Fitting runs on the driver on a bounded sample (``max_rows`` rows of each class, texts of at most
``max_bytes`` bytes, in the order of a hash of the id); scoring runs in tasks on every whole text.
Null text counts as empty and gets a score; a null label is no label; a label table without both
classes gives the constant score 0.5. Extra columns pass through; equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.llm.common import small_batches, steps, utf8

WIDTH, FILTERS = 4, 8
CHUNK, STRIDE = 256, 224
THRESHOLD = 0.3


@dataclass
class Model:
    """Byte tables ``conv`` (WIDTH, 256, FILTERS), bias per filter, output weights and bias."""

    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    constant: bool = False


def chunks_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk matrix with WIDTH - 1 look-ahead bytes, row of each chunk, bytes in each chunk);
    a row without bytes has one chunk of zeros."""
    n = np.diff(offs)
    count = np.maximum(1, -(-np.maximum(n - (CHUNK - STRIDE), 1) // STRIDE))
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    held = np.minimum(CHUNK, n[row] - k * STRIDE)
    at = np.arange(CHUNK + WIDTH - 1)
    index = (offs[row] + k * STRIDE)[:, None] + at
    inside = at < (n[row] - k * STRIDE)[:, None]
    padded = data if len(data) else np.zeros(1, np.uint8)
    x = np.where(inside, padded[np.minimum(index, len(padded) - 1)], 0).astype(np.uint8)
    return x, row, np.maximum(held, 1)


def _pairs(model: Model) -> list[np.ndarray]:
    """Tables over two bytes at once: half the look-ups of the byte tables."""
    return [(model.conv[k][:, None, :] + model.conv[k + 1][None, :, :]).reshape(65536, FILTERS).T.copy()
            for k in range(0, WIDTH, 2)]


def _pooled(pairs: list[np.ndarray], bias: np.ndarray, x: np.ndarray) -> np.ndarray:
    two = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
    out = np.empty((len(x), FILTERS), np.float32)
    for f in range(FILTERS):
        z = pairs[0][f].take(two[:, :CHUNK])
        for i in range(1, len(pairs)):
            z += pairs[i][f].take(two[:, 2 * i:2 * i + CHUNK])
        out[:, f] = z.max(axis=1)
    return np.maximum(out + bias, 0)


def _score(model: Model, pairs: list[np.ndarray], data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    if model.constant or not n:
        return np.full(n, 0.5)
    x, row, held = chunks_of(data, offs)
    total, weight = np.zeros(n), np.bincount(row, held, n)
    for i in range(0, len(x), 2048):
        logit = (_pooled(pairs, model.bias, x[i:i + 2048]).astype(np.float64) * model.out).sum(axis=1) + model.out_bias
        total += np.bincount(row[i:i + 2048], logit * held[i:i + 2048], n)
    return np.round(1 / (1 + np.exp(-np.clip(total / weight, -30, 30))), 6)


def fit(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.02, seed: int = 7) -> Model:
    """Adam on the chunks' log loss, classes weighted alike; only each filter's strongest place in a
    chunk gets a gradient, as max-pooling has it."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                  rng.normal(0, 0.5, FILTERS), 0.0)
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        model.constant = True
        return model
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    x, row, held = chunks_of(np.frombuffer(b"".join(raw), np.uint8), offs)
    target = y[row]
    per_doc = held / np.bincount(row, held)[row]
    weight = per_doc * np.where(target > 0.5, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    weight = weight / weight.mean()
    par = [model.conv, model.bias, model.out, np.zeros(1)]
    m, v, step = [np.zeros_like(p, dtype=np.float64) for p in par], [np.zeros_like(p, dtype=np.float64) for p in par], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), 256):
            b = order[i:i + 256]
            xb = x[b]
            z = sum(par[0][k][xb[:, k:k + CHUNK]] for k in range(WIDTH))
            best = z.argmax(axis=1)
            pre = np.take_along_axis(z, best[:, None, :], 1)[:, 0, :] + par[1]
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ par[2] + par[3][0], -30, 30)))
            d = (p - target[b]) * weight[b] / len(b)
            dh = d[:, None] * par[2] * (pre > 0)
            grad = [np.zeros((WIDTH, 256, FILTERS)), dh.sum(0), h.T @ d, np.array([d.sum()])]
            for k in range(WIDTH):
                np.add.at(grad[0][k], (np.take_along_axis(xb, best + k, 1), np.arange(FILTERS)[None, :]), dh)
            step += 1
            for j, g in enumerate(grad):
                g = g + 1e-4 * par[j]
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                par[j] = par[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return Model(par[0].astype(np.float32), par[1].astype(np.float32), par[2], float(par[3][0]))


def held_out():
    """True for the fold that no fitting may see: crc32 of the id as text modulo 5 is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_from_tables(docs: DataFrame, labels: DataFrame, max_rows: int = 1500, max_bytes: int = 65536) -> Model:
    """Fit on at most ``max_rows`` labelled rows of each class outside the held-out fold, of those
    whose texts have at most ``max_bytes`` bytes: the one bounded sample of this operator."""
    small_batches(docs.sparkSession)
    texts, ys = [], []
    for y in (0, 1):
        # ids first, by the labels alone; then only their texts come to the driver
        ids = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
               .where((F.col("quality") > 0) if y else (F.col("quality") <= 0)).select("doc_id").distinct()
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
        got = (docs.where(F.octet_length("text") <= max_bytes).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
               .dropDuplicates(["doc_id"]).select("doc_id", "text").collect())
        got.sort(key=lambda r: (r.doc_id, r.text))
        texts += [r.text for r in got]
        ys += [y] * len(got)
    return fit(texts, ys)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with columns score and predicted (1 if score >= threshold); columns of these names
    that ``docs`` has are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(model)
        for b in batches:
            data, offs = utf8(b.column(b.schema.get_field_index("text")))
            parts = [_score(model, pairs, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]) for i, j in steps(offs)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, f"{fields}, score double, predicted int")
