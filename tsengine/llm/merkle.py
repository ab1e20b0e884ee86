"""Merkle dataset manifest by incremental witnesses (operator 11).

Leaves are appended in order to open subtrees. When a run of ``FAN`` nodes is complete, its digest
moves up a level, and the partial witness of every leaf below grows by the digests beside it. Spark
appends blocks of ``FAN ** HEIGHT`` aligned leaves in parallel; the roots of a source's blocks are
then further appends, block by block again, until one node, the source's subroot, is left. The
subroots are the leaves of one more such tree, whose top is the root. Nodes further up are built
first, so each block gets the witness of its own root along with its leaves and hangs it on theirs:
no witness is written, joined or shuffled but those of the block roots.

Every row is a leaf, rows that share a doc_id too: they follow each other by their digests, so equal
rows can change places freely. A null field is digested as ``-``; a null source is a source of its
own, before the others. Text is digested whole, whatever its length; an empty text is not a null. An
empty table has no leaves and gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.llm.common import materialize, small_batches
from tsengine.llm.order import place

FAN = 16
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WITNESS = "array<struct<left:string,right:string>>"
_PAIR = pa.struct([("left", pa.string()), ("right", pa.string())])


def leaf(text: Column | None = None) -> Column:
    """Digest of a row's fields, of another text if one is given."""
    parts = []
    for name in FIELDS:
        value = (text if name == "text" and text is not None else F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def height(nodes: int, fan: int = FAN) -> int:
    """Levels until one node is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fan), levels + 1
    return levels


class Appender:
    """Open subtrees, a run of at most ``fan`` nodes at each level, and the leaves' partial witnesses."""

    def __init__(self, fan: int = FAN, witnesses: bool = True):
        self.fan, self.size = fan, 0
        self.open: list[list[tuple[str, int, int]]] = [[]]
        self.witnesses: list[list[tuple[str, str]]] | None = [] if witnesses else None

    def append(self, digest: str) -> None:
        if self.witnesses is not None:
            self.witnesses.append([])
        self._add(0, digest, self.size, self.size + 1)
        self.size += 1

    def _add(self, level: int, digest: str, lo: int, hi: int) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((digest, lo, hi))
        if len(self.open[level]) == self.fan:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        whole = "".join(d for d, _, _ in run)
        if self.witnesses is not None:
            at = 0
            for digest, lo, hi in run:
                pair = (whole[:at], whole[at + len(digest):])
                at += len(digest)
                for w in self.witnesses[lo:hi]:
                    w.append(pair)
        self._add(level + 1, _digest(whole), run[0][1], run[-1][2])

    def finish(self, levels: int) -> str:
        """Close what is open below ``levels``; the digest of the one node there."""
        for level in range(levels):
            if self.open[level]:
                self._close(level)
        return self.open[levels][0][0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows of one (group, block) after the other; ``batches`` come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, blocks = batch.column("group"), batch.column("block")
        change = pc.or_(pc.not_equal(groups[1:], groups[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
        cuts = [0, *(np.flatnonzero(change.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            key = (groups[i].as_py(), blocks[i].as_py())
            if held and key != last:
                yield held
                held = []
            last = key
            held.append(batch.slice(i, j - i))
    if held:
        yield held


def _levels(total: int, fan: int, high: int) -> int:
    return high if total > fan ** high else height(total, fan)


def _roots(fan: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            tree = Appender(fan, witnesses=False)
            for part in block:
                for d in part.column("digest").to_pylist():
                    tree.append(d)
            total = block[0].column("total")[0].as_py()
            yield pa.RecordBatch.from_pydict({
                "group": block[0].column("group")[:1], "block": block[0].column("block")[:1],
                "total": pa.array([-(-total // fan ** high)], pa.int64()), "digest": pa.array([tree.finish(_levels(total, fan, high))], pa.string())})
    return run


def _grow(fan: int, high: int, names: list[str]):
    """Leaves of a block with their whole witnesses. The first row of a block, at pos -1, has the
    witness of the block's root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            tree = Appender(fan)
            head = block[0].slice(0, 1).to_pylist()[0]
            block[0] = block[0].slice(1)
            above = [(w["left"], w["right"]) for w in head["witness"]]
            for part in block:
                for d in part.column("digest").to_pylist():
                    tree.append(d)
            total = next(part.column("total")[0].as_py() for part in block if part.num_rows)
            tree.finish(_levels(total, fan, high))
            at = 0
            for part in block:
                for i in range(0, part.num_rows, 512):
                    rows = part.slice(i, 512)
                    n = rows.num_rows
                    mine = [w + above for w in tree.witnesses[at:at + n]]
                    at += n
                    flat = [p for w in mine for p in w]
                    offsets = np.cumsum([0, *map(len, mine)], dtype=np.int32)
                    pairs = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.string()), pa.array([p[1] for p in flat], pa.string())], fields=list(_PAIR))
                    out = {c: rows.column(c) for c in names}
                    out["witness"] = pa.ListArray.from_arrays(pa.array(offsets), pairs)
                    for c in ("subroot", "root"):
                        out[c] = rows.column(c) if head[c] is None else pa.array([head[c]] * n, pa.string())
                    yield pa.RecordBatch.from_pydict(out)
    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("group", "block").sortWithinPartitions("group", "block", "pos")


def _block(fan: int, high: int) -> Column:
    return F.expr(f"pos div {fan ** high}L").alias("block")


def _climb(nodes: DataFrame, fan: int, high: int) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of each stage, the one top node of each group) of (group, pos, total, digest)."""
    stages = []
    while True:
        stages.append(nodes)
        most = nodes.agg(F.max("total")).first()[0] or 0
        dealt = _dealt(nodes.select("group", _block(fan, high), "pos", "total", "digest"))
        tops = materialize(dealt.mapInArrow(_roots(fan, high), "group string, block long, total long, digest string"), "merkle-roots")
        if most <= fan ** high:
            return stages, tops.select("group", "digest")
        nodes = tops.select("group", F.col("block").alias("pos"), "total", "digest")


def _hang(nodes: DataFrame, above: DataFrame, keep: list[str], fan: int, high: int) -> DataFrame:
    """``nodes`` (group, pos, total, digest, subroot, root and ``keep``) with their witnesses, below
    ``above`` (group, block, witness, subroot, root), a row for each block."""
    rows = nodes.withColumns({"block": _block(fan, high), "witness": F.lit(None).cast(WITNESS)})
    heads = above.withColumn("pos", F.lit(-1).cast("long"))
    both = _dealt(rows.unionByName(heads, allowMissingColumns=True))
    names = ["group", "pos", "digest", *keep]
    schema = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in names)
    return both.mapInArrow(_grow(fan, high, names), f"{schema}, witness {WITNESS}, subroot string, root string")


def manifest(rows: DataFrame, keep: list[str], fan: int = FAN, high: int = HEIGHT) -> DataFrame:
    """``keep``, source, leaf, subroot, root and witness (from the leaf to the root, at each level
    the digests left and right of the node, joined) of rows (source, leaf, ``keep``). Leaves ascend
    by the first of ``keep``, then by digest. Names of ``keep`` must not be used here."""
    small_batches(rows.sparkSession)
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("group")
    leaves = materialize(rows.select(group, "source", F.col("leaf").alias("digest"), *keep), "merkle-leaves")
    placed = place(leaves, ["group"], [keep[0], "digest"], "merkle-order")
    lower, subroots = _climb(placed, fan, high)
    # the subroots, ordered by source, are one more group of leaves
    named = materialize(subroots.select(F.lit("").alias("group"), F.col("group").alias("owner"), "digest"), "merkle-subroots")
    upper, top = _climb(place(named, ["group"], ["owner"], "merkle-sources"), fan, high)
    none = F.lit(None).cast("string")
    above = top.select("group", F.lit(0).cast("long").alias("block"), F.expr(f"CAST(array() AS {WITNESS})").alias("witness"),
                       none.alias("subroot"), F.col("digest").alias("root"))
    for k, nodes in reversed(list(enumerate(upper))):
        nodes = nodes.withColumns({"subroot": F.col("digest") if k == 0 else none, "root": none})
        above = _hang(nodes, above, ["owner"] if k == 0 else [], fan, high)
        above = above.select("group", F.col("pos").alias("block"), "witness", "subroot", "root", *(["owner"] if k == 0 else []))
    above = above.select(F.col("owner").alias("group"), F.lit(0).cast("long").alias("block"), "witness", "subroot", "root")
    for k, nodes in reversed(list(enumerate(lower))):
        held = ["source", *keep] if k == 0 else []
        nodes = nodes.withColumns({"subroot": none, "root": none})
        above = _hang(nodes, above, held, fan, high)
        if k:
            above = above.select("group", F.col("pos").alias("block"), "witness", "subroot", "root")
    return above.select(*keep, "source", F.col("digest").alias("leaf"), "subroot", "root", "witness")


def fold(digest: Column, witness: Column) -> Column:
    """Root that a leaf and a witness lead to."""
    return F.aggregate(witness, digest, lambda d, w: F.sha2(F.concat(w["left"], d, w["right"]), 256))


def siblings(witness: Column) -> Column:
    """All digests of a witness, joined, from the leaf's run upwards, left to right."""
    return F.array_join(F.transform(witness, lambda w: F.concat(w["left"], w["right"])), "")


def audit(docs: DataFrame, tampered: Column) -> DataFrame:
    """The manifest of ``docs``, held against the same table with texts in lower case (A-Z) where
    ``tampered`` is true: what each row's leaf then folds to, and whether that is the root."""
    changed = F.when(F.coalesce(tampered, F.lit(False)) & F.col("text").isNotNull(), leaf(F.translate("text", UPPER, LOWER)))
    rows = docs.select("doc_id", "source", leaf().alias("leaf"), changed.alias("changed"))
    done = manifest(rows, ["doc_id", "changed"])
    folded = done.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("witness")))
    return folded.select("doc_id", "leaf", "subroot", "root", "witness", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
