"""Sharding by a minimax contiguous partition (operator 4).

Groups of equal texts are atoms in the order of a hash of the text. The smallest capacity for which
a greedy pass needs no more than the given number of shards is found by binary search, and the
greedy cuts at that capacity are the shard borders. The atoms stay in Spark: the driver holds sums
over key ranges only, and splits (in one job a round) the ranges in which a cut falls, until every
cut is at an atom's border. A round brings at most ``FAN`` rows for each of some twenty ranges.

Null text is its own group of size 1 for each row (as 0 bytes + 1); its crc32 is that of the empty
text. An empty table gives an empty result; with fewer groups than shards some shards stay empty.
Rows that share a doc_id are separate rows. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.llm.common import materialize

FAN = 1024
SLOT_BINS = 1024


@dataclass
class Range:
    """Atoms with keys lo..hi: their bytes, number, and largest."""

    lo: int
    hi: int
    size: int
    count: int
    largest: int


def text_key(text: Column) -> Column:
    """Non-negative 62-bit key; equal texts share it."""
    return F.shiftrightunsigned(F.xxhash64(text), 2)


def _split(groups: DataFrame, parts: list[Range]) -> list[list[Range]]:
    """Each range in at most FAN smaller ones, all by one aggregation."""
    node = child = F.lit(None).cast("long")
    keep = F.lit(False)
    for i, p in enumerate(parts):
        width = (p.hi - p.lo) // FAN + 1
        inside = F.col("key").between(p.lo, p.hi)
        node = F.when(inside, F.lit(i).cast("long")).otherwise(node)
        child = F.when(inside, F.expr(f"(key - {p.lo}L) div {width}L")).otherwise(child)
        keep = keep | inside
    got = (groups.where(keep).groupBy(node.alias("node"), child.alias("child"))
           .agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("size"),
                F.count(F.lit(1)).alias("count"), F.max("size").alias("largest")).collect())
    out: list[list[Range]] = [[] for _ in parts]
    for r in got:
        out[r["node"]].append(Range(r["lo"], r["hi"], r["size"], r["count"], r["largest"]))
    return [sorted(x, key=lambda r: r.lo) for x in out]


def _greedy(ranges: list[Range], ends: list[int], shards: int, capacity: int, hopeful: bool) -> tuple[bool, list[int], set[int]]:
    """(fits, first keys of shards 1.., ranges in which a cut falls). ``hopeful``: a cut may be
    anywhere in a range of several atoms (a lower bound); else only before the range (an upper one)."""
    at, cuts, touched = 0, [], set()
    for _ in range(shards):
        j = bisect_right(ends, at + capacity)
        if j >= len(ranges):
            return True, cuts, touched
        begin = ends[j - 1] if j else 0
        if ranges[j].count > 1:
            touched.add(j)
        if ranges[j].count > 1 and hopeful:
            at += capacity
        elif begin <= at:
            return False, cuts, touched
        else:
            at = begin
        cuts.append(ranges[j].lo)
    return False, cuts, touched


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, first key of each shard after the first) of ``groups`` (key, size)."""
    top = groups.agg(F.min("key"), F.max("key"), F.sum("size"), F.count(F.lit(1)), F.max("size")).first()
    if top[0] is None:
        return 0, []
    ranges = [Range(*top)]
    split = [0] if ranges[0].count > 1 else []
    while True:
        if split:
            new = dict(zip(split, _split(groups, [ranges[i] for i in split]), strict=True))
            ranges = [r for i, x in enumerate(ranges) for r in new.get(i, [x])]
        ends, total = [], 0
        for r in ranges:
            total += r.size
            ends.append(total)
        bounds = []
        for hopeful in (True, False):
            lo, hi = max(-(-total // shards), top[4]), total
            while lo < hi:
                mid = (lo + hi) // 2
                if _greedy(ranges, ends, shards, mid, hopeful)[0]:
                    hi = mid
                else:
                    lo = mid + 1
            bounds.append(lo)
        low, high = bounds
        _, cuts, _ = _greedy(ranges, ends, shards, high, False)
        if low >= high:
            return high, cuts
        split = sorted(_greedy(ranges, ends, shards, low, True)[2] | _greedy(ranges, ends, shards, high, False)[2]
                       | _greedy(ranges, ends, shards, (low + high) // 2, True)[2])
        if not split:
            return high, cuts


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row (law ``bytes``)."""
    rows = docs.select(
        F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("key"))
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    _, cuts = minimax_cuts(groups, shards)
    where = F.lit(0)
    for c in cuts:
        where = where + (F.col("key") >= F.lit(c)).cast("int")
    # slots: rows are numbered inside bins of (shard, hash of the row), which no hot text can fill
    rows = rows.withColumns({"shard": where.cast("int"), "bin": F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_BINS)).cast("int")})
    per_bin = rows.groupBy("shard", "bin").count()
    before = per_bin.select("shard", "bin", (F.sum("count").over(
        Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "key")) - 1)
    # at most shards * SLOT_BINS rows
    return numbered.join(F.broadcast(before), ["shard", "bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
