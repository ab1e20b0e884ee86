"""Conversation prefix trie by time-forward processing (operator 13).

A node is a distinct beginning of conversations. Its key is a chain of SHA-256 over the turns (blocks
of ``CHAIN`` turns are chained apart and then onto each other, so that a conversation of any length is
dealt over tasks); equal beginnings meet by their keys, and counts are summed before they are
shuffled. Totals of subtrees pass from children to parents: nodes are sorted by descending depth
(Spark's external sort), and each sends its totals forward in time, to its parent's turn, through a
priority queue that spills sorted runs. A shard is a subtree cut so that its nodes' members number
more than ``FAN ** i`` and at most ``FAN ** (i + 1)``: at each depth it holds less than ``FAN`` nodes, whatever
the fan-out of the node above it. What the shards' roots hand on is summed by parent in Spark and
enters the next, higher level of shards; levels grow with the logarithm of the conversations. Below a
node with one member nothing is shared: its totals are known without a queue.

Turns are ordered by turn, nulls first; rows of one turn (repeated rows too) all count and follow each other by their
digests. Null roles and texts are empty ones. Rows without a conv_id belong to no conversation. An
empty table has no root: an empty result. Texts are digested whole, whatever their length; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import marshal
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.llm.common import materialize, small_batches
from tsengine.llm.merkle import _blocks
from tsengine.llm.order import place

CHAIN = 4096      # turns of a block
FAN = 4096        # a level of shards spans so many times the members of the one below
CHUNK = 4096      # ids digested as one string
QUEUE = 1 << 16   # messages that a queue holds before it spills
KEY = 16          # bytes of a node's key
ROOT = hashlib.sha256(b"root").digest()[:KEY]
NONE = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- turns and keys


def turns(conversations: DataFrame) -> DataFrame:
    """conv, pos, total, x (digest of role and text), size (bytes of the text) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"), F.octet_length(text).cast("long").alias("size"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("x"))
    return place(materialize(rows, "trie-turns"), ["conv"], ["turn", "x"], "trie-order")


def spliced(own: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from the first ``head`` (at most ``most``) turns of conversation ``base``, both columns over
    ``conv``, and their own turns after as many: (conv, depth, x, size, long), (conv, long)."""
    firsts = own.where("pos = 0").select("conv", "total")
    named = firsts.select("conv", "total", base.alias("base"), head.cast("long").alias("head"))
    known = firsts.select(F.col("conv").alias("base"), F.col("total").alias("base_total"))
    convs = named.join(known, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_total", F.lit(0).cast("long"))))
    convs = materialize(convs.select("conv", "base", "head", "taken", (F.col("taken") + F.greatest(F.col("total") - F.col("head"), F.lit(0))).alias("long")), "trie-convs")
    begins = own.where(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "x", "size")
    before = convs.where("taken > 0").join(begins, "base").where("pos < taken").select("conv", (F.col("pos") + 1).alias("depth"), "x", "size", "long")
    after = own.select("conv", "pos", "x", "size").join(convs, "conv").where("pos >= head").select(
        "conv", (F.col("taken") + F.col("pos") - F.col("head") + 1).alias("depth"), "x", "size", "long")
    return before.unionByName(after), convs.select("conv", "long")


def _key(seed: bytes, digest: bytes) -> bytes:
    return hashlib.sha256(seed + digest).digest()[:KEY]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, block, digest) of the turns of whole blocks, in order."""
    for block in _blocks(batches):
        digest = b""
        for part in block:
            for x in part.column("x").to_pylist():
                digest = hashlib.sha256(digest + x).digest()
        yield pa.RecordBatch.from_pydict({"group": block[0].column("group")[:1], "block": block[0].column("block")[:1], "digest": pa.array([digest], pa.binary())})


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key at the end of each block, from the blocks' digests in order."""
    last, seed = None, ROOT
    for batch in batches:
        out = []
        for conv, digest in zip(batch.column("group").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            seed, last = _key(ROOT if conv != last else seed, digest), conv
            out.append(seed)
        yield pa.RecordBatch.from_pydict({"group": batch.column("group"), "block": batch.column("block"), "seed": pa.array(out, pa.binary())})


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's key and its parent's. Blocks after the first begin with their seed."""
    last: tuple | None = None
    seed = parent = ROOT
    digest = b""
    for batch in batches:
        keys: list = []
        parents: list = []
        for conv, block, x, start in zip(*(batch.column(c).to_pylist() for c in ("group", "block", "x", "seed")), strict=True):
            if (conv, block) != last:
                last, digest, seed = (conv, block), b"", start or ROOT
                parent = seed
            if x is None:
                keys.append(None)
                parents.append(None)
                continue
            digest = hashlib.sha256(digest + x).digest()
            keys.append(_key(seed, digest))
            parents.append(parent)
            parent = keys[-1]
        out = pa.RecordBatch.from_pydict({
            "conv": batch.column("group"), "depth": batch.column("depth"), "key": pa.array(keys, pa.binary()), "parent": pa.array(parents, pa.binary()),
            "size": batch.column("size"), "ends": pa.array([a == b for a, b in zip(batch.column("depth").to_pylist(), batch.column("long").to_pylist(), strict=True)])})
        yield out.filter(pa.array([k is not None for k in keys]))


def paths(rebuilt: DataFrame, convs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """conv, depth, key, parent, size, ends (the conversation is over) of every beginning of every
    conversation, the empty one included."""
    block = F.expr(f"(depth - 1) div {chain}L")
    rows = rebuilt.select(F.col("conv").alias("group"), block.alias("block"), "depth", "x", "size", "long")

    def dealt(df: DataFrame, *by: str) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions("group", "block", *(["depth"] if "depth" in df.columns else []))

    whole = rows.where(F.col("long") > (F.col("block") + 1) * chain)
    digests = dealt(whole, "group", "block").mapInArrow(_chain, "group long, block long, digest binary")
    seeds = dealt(digests, "group").mapInArrow(_seeds, "group long, block long, seed binary")
    heads = seeds.select("group", (F.col("block") + 1).alias("block"), ((F.col("block") + 1) * chain).alias("depth"), "seed")
    both = rows.withColumn("seed", F.lit(None).cast("binary")).unionByName(heads, allowMissingColumns=True)
    keyed = dealt(both, "group", "block").mapInArrow(_keys, "conv long, depth long, key binary, parent binary, size long, ends boolean")
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"),
                         F.lit(0).cast("long").alias("size"), (F.col("long") == 0).alias("ends"))
    return materialize(keyed.unionByName(roots), "trie-paths")


# ---------------------------------------------------------------- nodes and their totals


class SpillingQueue:
    """Priority queue of tuples of numbers and bytes; beyond ``most`` they go, sorted, to runs on disk, in Spark's
    own spill folders and in files without a name, which end with the task."""

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.heads, self.runs = most, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self.heap.sort()
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            run = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
            for x in self.heap:
                marshal.dump(x, run)
            run.seek(0)
            self.heap, self.runs = [], self.runs + 1
            self._next(self.runs, run)

    def _next(self, number: int, run) -> None:
        try:
            heapq.heappush(self.heads, (marshal.load(run), number, run))
        except EOFError:
            run.close()

    def top(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, number, run = heapq.heappop(self.heads)
            self._next(number, run)
            return item
        return heapq.heappop(self.heap)


def _forward(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (anchor, depth descending, key): own totals in, subtree totals out."""
        queue, last = SpillingQueue(most), None
        for batch in batches:
            leaves, saved = [], []
            for anchor, depth, key, parent, own, cost in zip(*(batch.column(c).to_pylist() for c in ("anchor", "depth", "key", "parent", "n_leaves", "saved_tokens")), strict=True):
                if anchor != last:
                    queue, last = SpillingQueue(most), anchor
                now = (-depth, key)
                while (head := queue.top()) is not None and head[:2] == now:
                    _, _, more, less = queue.pop()
                    own, cost = own + more, cost + less
                if key != anchor:
                    queue.push((1 - depth, parent, own, cost))
                leaves.append(own)
                saved.append(cost)
            cols = {c: batch.column(c) for c in batch.schema.names if c not in ("n_leaves", "saved_tokens", "anchor")}
            yield pa.RecordBatch.from_pydict(cols | {"n_leaves": pa.array(leaves, pa.int64()), "saved_tokens": pa.array(saved, pa.int64()),
                                                     "handed": pa.array([a == k for a, k in zip(batch.column("anchor").to_pylist(), cols["key"].to_pylist(), strict=True)])})
    return run


def _level(n: Column, fan: int) -> Column:
    """i where fan ** i < n <= fan ** (i + 1); 0 for n = 1, too."""
    out, power = F.lit(0), fan
    while power < 2 ** 62:
        out, power = out + (n > F.lit(power)).cast("int"), power * fan
    return out


_NODE = "key binary, parent binary, depth long, rep long, parent_rep long, n long, n_children long"


def _totals(nodes: DataFrame, walks: DataFrame, fan: int, most: int) -> DataFrame:
    """``nodes`` with n_leaves and saved_tokens of their subtrees, level by level of shards."""
    columns = [c.split()[0] for c in _NODE.split(", ")]
    own = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n") - 1) * F.col("size")})
    alone = own.where("n = 1")
    done = [alone.select(*columns, F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))]
    handed = [alone.where("parent_n > 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))]
    # the shard of a node: the first beginning of its smallest member on the node's level
    high = nodes.where(F.col("n") > fan).select("key", _level(F.col("n"), fan).alias("level"))
    levels = walks.select("conv", "depth", "key").join(high, "key", "left").groupBy(
        F.col("conv").alias("rep"), F.coalesce("level", F.lit(0)).alias("level")).agg(F.min_by("key", "depth").alias("anchor"))
    shared = materialize(own.where("n > 1").withColumn("level", _level(F.col("n"), fan)).join(levels, ["rep", "level"])
                         .select(*columns, "n_leaves", "saved_tokens", "level", "anchor"), "trie-shared")
    top = shared.agg(F.max("level")).first()[0]
    for level in range(0 if top is None else top + 1):
        sent = handed[0]
        for more in handed[1:]:
            sent = sent.unionByName(more)
        sent = sent.groupBy(F.col("parent").alias("key")).agg(F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved"))
        rows = shared.where(F.col("level") == level).join(sent, "key", "left").select(
            *columns, "anchor", (F.col("n_leaves") + F.coalesce("in_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("in_saved", F.lit(0))).alias("saved_tokens"))
        rows = rows.repartition("anchor").sortWithinPartitions("anchor", F.col("depth").desc(), "key")
        out = materialize(rows.mapInArrow(_forward(most), f"{_NODE}, n_leaves long, saved_tokens long, handed boolean"), "trie-totals")
        done.append(out.drop("handed"))
        handed.append(out.where("handed").select("parent", "n_leaves", "saved_tokens"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def _sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha) of the chunks of each key, in order; a key's hash is carried along, not its chunks."""
    key = state = None
    for batch in batches:
        keys, shas = [], []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    shas.append(state.hexdigest())
                key, state = k, hashlib.sha256(text.encode("ascii"))
            else:
                state.update(b"," + text.encode("ascii"))
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(shas, pa.string())})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def _ends(walks: DataFrame, nodes: DataFrame, chunk: int) -> DataFrame:
    """key, ends_sha256 of the nodes at which conversations end. Many ids are numbered across
    partitions and joined by chunks first."""
    ends = walks.where("ends").select("key", "conv")
    many = nodes.where(F.col("n_ends") > chunk).select("key")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    few = ends.join(many, "key", "left_anti").groupBy("key").agg(F.sha2(listed, 256).alias("ends_sha256"))
    numbered = place(materialize(ends.join(many, "key", "left_semi"), "trie-ends"), ["key"], ["conv"], "trie-ends-order")
    chunks = numbered.groupBy("key", F.expr(f"pos div {chunk}L").alias("chunk")).agg(listed.alias("ids"))
    long = chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_sha, "key binary, ends_sha256 string")
    return few.unionByName(long)


def trie(conversations: DataFrame, base: Column, head: Column, most: int, chain: int = CHAIN, fan: int = FAN, chunk: int = CHUNK, queue: int = QUEUE) -> DataFrame:
    """One row per node of the conversations rebuilt by ``base`` and ``head`` (see ``spliced``)."""
    small_batches(conversations.sparkSession)
    rebuilt, convs = spliced(turns(conversations), base, head, most)
    walks = paths(rebuilt, convs, chain)
    counted = walks.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("size").alias("size"), F.min("conv").alias("rep"),
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ends").cast("long")).alias("n_ends"))
    counted = materialize(counted, "trie-nodes")
    kids = counted.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    above = counted.select(F.col("key").alias("parent"), F.col("rep").alias("parent_rep"), F.col("n").alias("parent_n"))
    nodes = counted.join(kids, "key", "left").join(above, "parent", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialize(nodes, "trie-linked")
    totals = _totals(nodes, walks, fan, queue)
    return totals.join(_ends(walks, nodes, chunk), "key", "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent_rep").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
