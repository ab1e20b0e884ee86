"""Repeated windows: the common frame of the two substring operators (5 and 7).

A window is ``length`` consecutive units (words or bytes) of one text. Its anchor is the place of
the least hash of ``gram`` units inside it (the leftmost of equals); equal windows have equal
anchors at equal offsets, so a window can repeat only if its anchor's gram occurs again. One anchor
serves a run of neighbouring windows, whose text is one segment.

1. Anchors only: (gram hash, row) of every text, counted; grams that occur once drop out.
2. Segments of the shared anchors; equal segments are counted, one of each is kept.
3. Segments that share a gram are a group of suffixes with that prefix. A group of at most ``most``
   segments goes to one task whole, where the operator's own ``resolve`` orders its suffixes; for a
   larger group the prefix grows to the full window length, so that each group of the final prefix
   holds equal windows only, and Spark aggregates them.
4. Runs of repeated windows come back per row.

No step gathers an unbounded group: counts and least places are partial aggregates, and rows meet
counts in joins whose large partitions Spark splits. Rows are identified by a hash of id and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.llm.common import STEP_BYTES, Rolling, byte_values, materialize, row_id, sliding_min, small_batches, spread, steps, utf8, word_hashes, words

MOST = 2048             # segments of a group that one task orders whole
_OTHER = np.uint64(0x5851F42D4C957F2D)  # a second, independent hash
GROUP_BYTES = 2 << 20   # segments that one step of a task orders together


@dataclass(frozen=True)
class Unit:
    """What a window counts: words or bytes."""

    kind: str
    length: int
    gram: int


@dataclass
class Runs:
    """Runs of windows with one anchor: window starts [first, last], the anchor, all in units of the
    batch; ``row`` of the batch; ``base`` first unit of the row."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    base: np.ndarray
    gram: np.ndarray


def units_of(unit: Unit, data: np.ndarray, offs: np.ndarray):
    """(unit hash values, first unit of each row + total, byte starts, byte ends)."""
    if unit.kind == "bytes":
        return byte_values(data), offs, None, None
    s, e, per_row = words(data, offs)
    return word_hashes(data, s, e), per_row, s, e


def runs_of(unit: Unit, values: np.ndarray, rows: np.ndarray) -> Runs:
    """All windows of the batch as runs with one anchor each."""
    grams = Rolling(values).grams(unit.gram)
    least = sliding_min(grams, unit.length - unit.gram + 1)
    count = np.maximum(0, np.diff(rows) - unit.length + 1)
    starts = spread(rows[:-1], count)               # every window's first unit
    if not len(starts):
        z = np.zeros(0, np.int64)
        return Runs(z, z, z, z, z, np.zeros(0, np.uint64))
    anchor = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(starts)) - 1
    row = np.searchsorted(rows, starts[at], side="right") - 1
    return Runs(row, starts[at], starts[ends], anchor[at], rows[row], grams[anchor[at]])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _batches(unit: Unit, most: int = STEP_BYTES):
    """Step through the text column of a batch; yields (first row of the step, data, offsets)."""
    def each(col):
        data, offs = utf8(col)
        for i, j in steps(offs, most):
            yield i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
    return each


def shared_anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """(rid, at: anchor places of the row whose gram occurs at two places or more)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy(zero_copy_only=False)
            for i, data, offs in _batches(unit)(b.column(1)):
                values, rows, _, _ = units_of(unit, data, offs)
                r = runs_of(unit, values, rows)
                yield pa.RecordBatch.from_arrays(
                    [_signed(r.gram), pa.array(rid[i + r.row]), pa.array((r.anchor - r.base).astype(np.int32))], names=["gram", "rid", "at"])

    # a stretch of one repeated gram gives an anchor a place: each is a row of its own
    found = docs.select("rid", "text").mapInArrow(run, "gram long, rid long, at int")
    twice = materialize(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "shared-grams", heavy=True)
    return found.join(twice, "gram", "left_semi").groupBy("rid").agg(F.collect_set("at").alias("at"))


def segments(docs: DataFrame, anchors: DataFrame, unit: Unit) -> DataFrame:
    """Segments of the shared anchors: gram, seg_a, seg_b (128-bit hash), rid, doc_id, start (unit
    of the first window), windows, lead (units before the anchor in the first window), content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, doc = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ats, lists = b.column(3).flatten().to_numpy(zero_copy_only=False), b.column(3)
            sizes = np.array(lists.value_lengths().to_pylist(), np.int64)
            begin = np.cumsum(sizes) - sizes
            for i, data, offs in _batches(unit)(b.column(2)):
                n = len(offs) - 1
                values, rows, ws, we = units_of(unit, data, offs)
                r = runs_of(unit, values, rows)
                if not len(r.row):
                    continue
                mine = spread(begin[i:i + n], sizes[i:i + n])
                want = np.sort(np.repeat(rows[:-1], sizes[i:i + n]) + ats[mine])
                at = np.minimum(np.searchsorted(want, r.anchor), max(len(want) - 1, 0))
                keep = np.flatnonzero(want[at] == r.anchor) if len(want) else np.zeros(0, np.int64)
                if not len(keep):
                    continue
                row, first, last = r.row[keep], r.first[keep], r.last[keep]
                roll, other = Rolling(values), Rolling(values ^ _OTHER)
                stop = last + unit.length
                if unit.kind == "bytes":
                    raw = data.tobytes()
                    content = [raw[a:z] for a, z in zip(first.tolist(), stop.tolist(), strict=True)]
                else:
                    raw = data.tobytes()
                    content = [b" ".join(raw[a:z].split()) for a, z in zip(ws[first].tolist(), we[stop - 1].tolist(), strict=True)]
                for k in range(0, len(keep), 20_000):
                    p = slice(k, k + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(r.gram[keep][p]), _signed(roll.ranges(first, stop)[p]), _signed(other.ranges(first, stop)[p]),
                         pa.array(rid[i + row][p]), pa.array(doc[i + row][p]), pa.array((first - rows[row]).astype(np.int32)[p]),
                         pa.array((last - first + 1).astype(np.int32)[p]), pa.array((r.anchor[keep] - first).astype(np.int32)[p]),
                         pa.array(content[p], pa.binary())], names=["gram", "seg_a", "seg_b", "rid", "doc_id", "start", "windows", "lead", "content"])

    return (docs.join(anchors, "rid").select("rid", "doc_id", "text", "at")
            .mapInArrow(run, "gram long, seg_a long, seg_b long, rid long, doc_id long, start int, windows int, lead int, content binary"))


@dataclass
class Group:
    """Segments of whole groups, as a task sees them. ``order``: (doc_id, start, rid) of each
    segment's first place; ``count``: its places; suffix i of segment j starts at unit i."""

    gram: np.ndarray
    lead: np.ndarray
    windows: np.ndarray
    count: np.ndarray
    doc_id: np.ndarray
    start: np.ndarray
    content: list[bytes]


#: Given the group, the class of every window (equal windows, and only those, share one; -1: alone);
#: windows are numbered segment by segment.
Resolve = Callable[[Group], np.ndarray]


def _run_rows(rid: np.ndarray, start: np.ndarray, seg: np.ndarray, offset: np.ndarray, flag: np.ndarray):
    """Flagged windows as maximal runs (rid, first window, number of windows)."""
    keep = np.flatnonzero(flag)
    if not len(keep):
        return None
    seg, offset = seg[keep], offset[keep]
    new = np.ones(len(keep), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (offset[1:] != offset[:-1] + 1)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(keep)))
    return pa.RecordBatch.from_arrays([pa.array(rid[seg[at]]), pa.array((start[seg[at]] + offset[at]).astype(np.int32)),
                                       pa.array(size.astype(np.int32))], names=["rid", "first", "windows"])


def _judge(cls: np.ndarray, seg: np.ndarray, offset: np.ndarray, g: Group, keep_first: bool) -> np.ndarray:
    """Which windows of each segment's first place repeat: any other place, or (``keep_first``) an
    earlier one by (doc_id, start)."""
    flag = np.zeros(len(cls), bool)
    some = np.flatnonzero(cls >= 0)
    if not len(some):
        return flag
    c, s, at = cls[some], seg[some], g.start[seg[some]] + offset[some]
    if not keep_first:
        flag[some] = np.bincount(c, g.count[s])[c] > 1
        return flag
    order = np.lexsort((at, g.doc_id[s], c))
    c2, d2, a2 = c[order], g.doc_id[s][order], at[order]
    head = np.ones(len(order), bool)
    head[1:] = c2[1:] != c2[:-1]
    which = np.cumsum(head) - 1
    flag[some[order]] = (d2 != d2[head][which]) | (a2 != a2[head][which])
    return flag


def _resolve_groups(distinct: DataFrame, resolve: Resolve, keep_first: bool) -> DataFrame:
    """Runs (rid, first, windows) at the first place of every segment, group by group in tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch | None:
            c = {n: t.column(n).to_numpy() for n in ("gram", "lead", "windows", "n", "doc_id", "start", "rid")}
            g = Group(c["gram"], c["lead"].astype(np.int64), c["windows"].astype(np.int64), c["n"], c["doc_id"],
                      c["start"].astype(np.int64), t.column("content").to_pylist())
            cls = resolve(g)
            seg = np.repeat(np.arange(len(g.windows)), g.windows)
            offset = spread(np.zeros(len(g.windows), np.int64), g.windows)
            return _run_rows(c["rid"], g.start, seg, offset, _judge(cls, seg, offset, g, keep_first))

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:  # sorted by gram: a step ends where a gram ends
            held.append(b)
            size += b.nbytes
            if size >= GROUP_BYTES:
                t = pa.Table.from_batches(held)
                gram = t.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))
                if cut:
                    out = done(t.slice(0, cut))
                    if out is not None:
                        yield out
                    t = t.slice(cut).combine_chunks()
                    held, size = t.to_batches(), t.nbytes
        if held:
            out = done(pa.Table.from_batches(held))
            if out is not None:
                yield out

    return (distinct.select("gram", "lead", "windows", "n", "doc_id", "start", "rid", "content").repartition("gram")
            .sortWithinPartitions("gram").mapInArrow(run, "rid long, first int, windows int"))


def _resolve_hot(hot: DataFrame, unit: Unit, keep_first: bool) -> DataFrame:
    """The same for large groups: each window by itself, under the full window as its prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names[:-1])}
            data, offs = utf8(b.column(b.num_columns - 1))
            if unit.kind == "bytes":
                values, rows = byte_values(data), offs
            else:
                s, e, rows = words(data, offs)
                values = word_hashes(data, s, e)
            windows = c["windows"].astype(np.int64)
            seg = np.repeat(np.arange(len(windows)), windows)
            at = spread(rows[:-1], windows)
            offset = at - rows[seg]
            roll, other = Rolling(values), Rolling(values ^ _OTHER)
            for k in range(0, len(at), 50_000):
                p = slice(k, k + 50_000)
                a = at[p]
                yield pa.RecordBatch.from_arrays(
                    [_signed(roll.ranges(a, a + unit.length)), _signed(other.ranges(a, a + unit.length)),
                     pa.array(c["n"][seg[p]]), pa.array(c["doc_id"][seg[p]]),
                     pa.array((c["start"][seg[p]] + offset[p]).astype(np.int32)), pa.array(c["rid"][seg[p]])],
                    names=["win_a", "win_b", "n", "doc_id", "first", "rid"])

    each = hot.select("windows", "n", "doc_id", "start", "rid", "content").mapInArrow(
        run, "win_a long, win_b long, n long, doc_id long, first int, rid long")
    whole = each.groupBy("win_a", "win_b").agg(F.sum("n").alias("total"), F.min(F.struct("doc_id", "first")).alias("least")).where("total > 1")
    whole = materialize(whole, "hot-windows")
    met = each.join(whole, ["win_a", "win_b"])
    if keep_first:
        met = met.where("struct(doc_id, first) != least")
    return met.select("rid", "first", F.lit(1).alias("windows"))


def repeated_runs(docs: DataFrame, unit: Unit, resolve: Resolve, keep_first: bool, most: int = MOST) -> DataFrame:
    """rid and ``runs`` (array of first window, number of windows) of every row with windows that
    occur elsewhere (``keep_first``: earlier by doc_id, then start). ``docs``: rid, doc_id, text."""
    small_batches(docs.sparkSession)
    segs = materialize(segments(docs, shared_anchors(docs, unit), unit), "segments", heavy=True)
    place = F.struct("doc_id", "start", "rid")
    distinct = materialize(
        segs.groupBy("seg_a", "seg_b").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(place.alias("p"), "gram", "windows", "lead", "content")).alias("s"))
        .select("seg_a", "seg_b", "n", "s.p.*", "s.gram", "s.windows", "s.lead", "s.content"), "distinct-segments", heavy=True)
    hot = materialize(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > most).select("gram"), "hot-grams")
    if hot.isEmpty():
        runs = _resolve_groups(distinct, resolve, keep_first)
    else:
        runs = (_resolve_groups(distinct.join(hot, "gram", "left_anti"), resolve, keep_first)
                .unionByName(_resolve_hot(distinct.join(hot, "gram", "left_semi"), unit, keep_first)))
    # every further place of a segment repeats its first place, window by window
    again = segs.select("seg_a", "seg_b", "rid", "doc_id", "start", "windows").join(
        distinct.where("n > 1").select("seg_a", "seg_b", F.col("doc_id").alias("d"), F.col("start").alias("s")), ["seg_a", "seg_b"])
    if keep_first:
        again = again.where("doc_id != d OR start != s")
    runs = runs.unionByName(again.select("rid", F.col("start").alias("first"), "windows"))
    return materialize(runs.groupBy("rid").agg(F.collect_set(F.struct("first", "windows")).alias("runs")), "runs", heavy=True)


def keyed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """rid, doc_id, text (null as empty) of every row and, with ``carry``, its other columns as one."""
    other = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("carry")] if carry else []
    return docs.select(row_id("doc_id", "text").alias("rid"), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *other)


def placed(rows: DataFrame) -> DataFrame:
    """rid, doc_id as a number (a null one last), text."""
    return rows.select("rid", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), "text")
