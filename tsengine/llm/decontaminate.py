"""Benchmark decontamination by q-gram lemma filtering (operator 2).

An item of m bytes matches a place of a text when at most e = floor(rate * m) edits turn one into
the other. Such a place shares at least m - q + 1 - q * e of the item's q-grams with it, and their
diagonals (place in the text minus place in the item) span at most e. Diagonals are cut into bands
of width 2 * (e + 1) that overlap by half, so that one band holds them all; bands with too few
shared q-grams drop out, and the rest are verified by banded alignment. Text and items are compared
as UTF-8 bytes with A-Z in lower case and every white-space byte as a space.

The items are the stated query set: they go to the tasks in blocks of about ``BLOCK_BYTES`` (any
number of blocks), every block meets every whole text, and no pairs are made before the filter.

Items under ``least`` bytes are too short for edits: they match where they stand as whole words, byte
by byte after folding (white space around them does not count). Null, empty or blank short items and
null or empty texts match nothing. Items that repeat or have a null item_id are items of their own (the
result then has a null item_id); rows that repeat give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.llm.common import Rolling, byte_values, small_batches, steps, utf8

Q, RATE, LEAST = 8, 0.08, 24
BLOCK_BYTES = 2 << 20
_UNSPACED = [("\u0e00", "\u109f"), ("\u1780", "\u17ff"), ("\u2e80", "\uabff"), ("\uf900", "\ufaff"), ("\U00020000", "\U0003ffff")]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    return x


class Index:
    """q-grams of a block of items: where each occurs."""

    def __init__(self, items: list[str], rate: float):
        self.ids = np.arange(len(items))
        self.raw = [_FOLD[np.frombuffer(t.encode(), np.uint8)] for t in items]
        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.edits = np.floor(self.size * rate + 1e-9).astype(np.int64)
        self.edits = np.minimum(self.edits, np.maximum(self.size - Q, 0) // Q)  # the lemma asks for one shared gram
        self.need = self.size - Q + 1 - Q * self.edits
        got = [grams(r) for r in self.raw]
        gram = np.concatenate([np.zeros(0, np.uint64), *got])
        item = np.repeat(np.arange(len(items)), [len(g) for g in got])
        at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in got]])
        order = np.argsort(gram, kind="stable")
        self.gram, first, count = np.unique(gram[order], return_index=True, return_counts=True)
        self.first, self.count, self.item, self.at = first, count, item[order], at[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.slot(self.gram)] = True

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def candidates(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Distinct (row, item, band) with enough shared q-grams, for folded bytes of many rows."""
        none = np.zeros((0, 3), np.int64)
        g = grams(data)
        if not len(g) or not len(self.gram):
            return none
        pos = np.flatnonzero(self.seen[self.slot(g)])
        k = np.minimum(np.searchsorted(self.gram, g[pos]), len(self.gram) - 1)
        hit = self.gram[k] == g[pos]
        pos, k = pos[hit], k[hit]
        row = np.searchsorted(offs, pos, side="right") - 1
        inside = pos + Q <= offs[row + 1]
        pos, k, row = pos[inside], k[inside], row[inside]
        if not len(pos):
            return none
        n = self.count[k]
        entry = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        item = self.item[entry]
        row = np.repeat(row, n)
        diagonal = np.repeat(pos - offs[row[np.cumsum(n) - n]] if len(n) else pos, n) - self.at[entry]
        step = self.edits[item] + 1
        shift = int(self.size.max()) + 1  # bands from 0 on
        band = (diagonal + shift) // step
        limit = int(band.max()) + 2
        if (int(row.max()) + 1) * len(self.ids) * limit >= 2**62:
            raise OverflowError("a step holds too many bands")
        low = (row * len(self.ids) + item) * limit
        key, count = np.unique(np.concatenate([low + band, low + np.maximum(band - 1, 0)]), return_counts=True)
        at, b = key // limit, key % limit
        r, i = at // len(self.ids), at % len(self.ids)
        keep = count >= self.need[i]
        return np.stack([r[keep], i[keep], b[keep] * (self.edits[i[keep]] + 1) - shift], axis=1)


def _joins(c: str) -> bool:
    """Whether a character is part of a word that goes on beside it (scripts without spaces have none)."""
    return c.isalnum() and not any(a <= c <= b for a, b in _UNSPACED)


class Short:
    """Short items by their bytes: where each stands as whole words."""

    def __init__(self, items: list[str]):
        self.items: dict[int, dict[bytes, list[int]]] = {}   # by length
        for k, t in enumerate(items):
            raw = _FOLD[np.frombuffer(t.encode(), np.uint8)].tobytes().strip(b" ")
            if raw:
                self.items.setdefault(len(raw), {}).setdefault(raw, []).append(k)
        self.hash = {n: np.concatenate([Rolling(byte_values(np.frombuffer(r, np.uint8))).grams(n) for r in named]) for n, named in self.items.items()}

    def first(self, data: np.ndarray, offs: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(0, start, end) of the first place by (row, item), for folded bytes of many rows."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not self.items:
            return out
        roll, raw = Rolling(byte_values(data)), data.tobytes()
        for n, named in self.items.items():
            pos = np.flatnonzero(np.isin(roll.grams(n), self.hash[n]))
            row = np.searchsorted(offs, pos, side="right") - 1
            inside = pos + n <= offs[row + 1]
            for p, r in zip(pos[inside].tolist(), row[inside].tolist(), strict=True):
                items = named.get(raw[p:p + n], [])
                if not items or (r, items[0]) in out:
                    continue
                low, high = int(offs[r]), int(offs[r + 1])
                t = raw[p:p + n].decode()
                before, after = raw[max(low, p - 4):p].decode(errors="ignore")[-1:], raw[p + n:min(high, p + n + 4)].decode(errors="ignore")[:1]
                if not (_joins(before) and _joins(t[0])) and not (_joins(after) and _joins(t[-1])):
                    out.update({(r, k): (0, p - low, p + n - low) for k in items})
        return out


def banded(item: np.ndarray, text: np.ndarray, first: int, last: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``item`` in ``text`` on diagonals first..last (the
    place of the item's byte i is i + diagonal), or None beyond ``edits``; the earliest end of equals."""
    width = last - first + 1
    far = len(item) + len(text) + 1
    col = first + np.arange(width)                  # text bytes consumed before item byte 0, by diagonal
    cost = np.where((col >= 0) & (col <= len(text)), 0, far)
    start = np.clip(col, 0, len(text))
    ramp = np.arange(width)
    for i in range(len(item)):
        # diagonal d at row i stands at text place i + d
        place = i + col
        ok = (place >= 0) & (place < len(text))
        miss = np.where(ok, text[np.clip(place, 0, max(len(text) - 1, 0))] != item[i], True) if len(text) else np.ones(width, bool)
        diag = np.where(ok, cost + miss, far)
        up = np.append(cost[1:] + 1, far)           # item byte without a text byte: one diagonal down
        ups = np.append(start[1:], 0)
        better = up < diag
        now, begin = np.where(better, up, diag), np.where(better, ups, start)
        flat = now - ramp                           # text byte without an item byte: along the row
        best = np.minimum.accumulate(flat)
        source = np.maximum.accumulate(np.where(flat == best, ramp, 0))
        now, begin = best + ramp, begin[source]
        now = np.where((i + 1 + col >= 0) & (i + 1 + col <= len(text)), now, far)
        cost, start = np.minimum(now, far), begin
        if cost.min() > edits:
            return None
    k = int(cost.argmin())
    return int(cost[k]), int(start[k]), int(len(item) + col[k])


def _verify(index: Index, raw: np.ndarray, item: int, band: int) -> tuple[int, int, int] | None:
    e, pattern = int(index.edits[item]), index.raw[item]
    first, last = band - e, band + 2 * (e + 1) - 1 + e
    low, high = max(0, first), min(len(raw), last + len(pattern) + 1)
    exact = raw[low:high].tobytes().find(pattern.tobytes())
    if exact >= 0:
        return 0, low + exact, low + exact + len(pattern)
    return banded(pattern, raw, first, last, e)


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, edits, start, end (bytes of the text): the best place of every benchmark item
    in every text that holds it within its edit budget, for items under ``least`` bytes the first."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where(F.octet_length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)  # a bounded share of the items
        shared = spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            whole = sorted(shared.value, key=lambda x: len(x[1].encode()) < least)   # short ones after the others
            if not whole:
                return
            long = [t for _, t in whole if len(t.encode()) >= least]
            index = Index(long, rate) if long else None
            short = Short([t for _, t in whole[len(long):]])
            for b in batches:
                data, offs = utf8(b.column(1))
                data = _FOLD[data]
                at, found = [], []
                for i, j in steps(offs):
                    part, po = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                    best = {(r, len(long) + k): got for (r, k), got in short.first(part, po).items()}
                    for r, item, band in index.candidates(part, po).tolist() if index else []:
                        got = _verify(index, part[po[r]:po[r + 1]], item, band)
                        if got is not None and got < best.get((r, item), (1 << 62, 0, 0)):
                            best[r, item] = got
                    for (r, item), got in sorted(best.items()):
                        at.append(i + r)
                        found.append((whole[item][0], *got))
                if at:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(at))] + [pa.array([f[k] for f in found], pa.int64()) for k in range(4)],
                        names=["doc_id", "item_id", "edits", "start", "end"])

        one = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, edits long, start long, end long")
        out = one if out is None else out.unionByName(one)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item."""
    whole = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    dirty = find_items(whole.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")), benchmark, rate).select(F.col("doc_id").alias("rid")).distinct()
    return whole.join(dirty, "rid", "left_anti").select("row.*")
