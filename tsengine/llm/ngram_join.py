"""N-gram Jaccard join with token-combination prefixes (operator 3).

A text's tokens are its distinct word n-grams. In a fixed order of all tokens, rare ones first, two
sets with Jaccard similarity t or more share a token within their first n - ceil(t n) + 1. Rare
tokens of that prefix are indexed alone. Where the prefix reaches the class of frequent tokens it
is extended to 2 D + 2 tokens, D = floor(n (1 - t) / t) being the most that two such sets differ
by: of the first D + 2 shared tokens, all frequent then, at least two neighbours stand side by side
in both sets, so pairs of neighbouring frequent tokens are indexed. Low tokens, those rare ones below
one bound for all texts, are indexed whether or not a prefix reaches them: a low token that only one set has is then
known to be in no other, and sets with many such tokens cannot be similar to anything (``_may_link``). Sets that share an entry are
compared, first by histograms of their tokens (a bound; where all pairs of an entry are joined, by their parity
within the join), then in full.

The class of frequent tokens is the ``CLASS`` most counted tokens in the plain prefixes, above
``FREQUENT`` texts each; it decides how much is compared, never what is found.

Equal sets are one node. Of an entry's sets, each is first compared with the least one (a star, not
all pairs). Entries whose sets are then not all linked together ask further stars, each entry with a
centre of its own, as long as these halve the pairs of sets in different components; the last round
compares those pairs. Links are joined to components by rounds of hooking and contraction,
all in tables. Null or empty texts, and texts without words, have no tokens and link with nothing;
with fewer words than n the whole sequence is the one token. Rows that share a doc_id are texts of
their own; a null doc_id never names a component that has another. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.llm.common import Rolling, materialize, mix, row_id, small_batches, spread, steps, utf8, word_hashes, words

FREQUENT = 64
CLASS = 65536
PAIRS = 16         # a row of an open entry, above which further stars are asked before all pairs
BINS = 512        # of a set's histogram: the L1 distance of two is at most the sets' symmetric difference
ODD = [f"b{k}" for k in range(BINS // 64)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all rows, row by row in ascending order; number of tokens of each row)."""
    data = _LOWER[data]
    s, e, rows = words(data, offs)
    count = np.diff(rows)
    roll = Rolling(word_hashes(data, s, e))
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    start = spread(rows[:-1], grams)
    row = np.repeat(np.arange(len(count)), grams)
    token = roll.ranges(start, start + np.minimum(n, count)[row]) >> np.uint64(1)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    return token[new], np.bincount(row[new], minlength=len(count))


def set_ids(token: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit identity of each row's set."""
    end = np.cumsum(size)
    return (Rolling(token).ranges(end - size, end) ^ mix(size.astype(np.uint64))).view(np.int64)


def prefix_size(n: np.ndarray, pct: int) -> np.ndarray:
    return np.where(n > 0, n - -(-n * pct // 100) + 1, 0)


def most_apart(n: np.ndarray, pct: int) -> np.ndarray:
    return n * (100 - pct) // pct


def entries(token: np.ndarray, size: np.ndarray, pct: int, frequent: np.ndarray, low_share: float = 1.0):
    """(entry, row, place in the row's order, whether it is low) of all rows: rare tokens of the prefix,
    all low ones (rare, below the same bound for every text), and pairs of neighbouring frequent tokens
    of the extended prefix where the prefix reaches those; and the number of low tokens of each row."""
    row = np.repeat(np.arange(len(size)), size)
    often = np.zeros(len(token), bool)
    if len(frequent):
        k = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
        often = frequent[k] == token
        order = np.lexsort((token, often, row))
        token, often = token[order], often[order]
    place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
    plain = place < prefix_size(size, pct)[row]
    reach = np.bincount(row[plain & often], minlength=len(size)) > 0
    low = ~often & (token < np.uint64(min(1.0, low_share * (100 - pct) / 100) * 2**63))
    single = (plain & ~often) | low
    pair = np.zeros(len(token), bool)
    if len(token) > 1:
        pair[:-1] = often[:-1] & (row[1:] == row[:-1]) & reach[row[:-1]] & (place[1:] < (2 * most_apart(size, pct) + 2)[row[:-1]])
    two = np.flatnonzero(pair)
    entry = np.concatenate([token[single], mix(token[two] * np.uint64(3) ^ mix(token[np.minimum(two + 1, max(len(token) - 1, 0))]))])
    return (entry.view(np.int64), np.concatenate([row[single], row[two]]), np.concatenate([place[single], place[two]]),
            np.concatenate([low[single], np.zeros(len(two), bool)]), np.bincount(row[low], minlength=len(size)))


def _plain_counts(docs: DataFrame, n: int, pct: int) -> np.ndarray:
    """The class of frequent tokens, sorted (at most CLASS of them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(0))
            for i, j in steps(offs):
                token, size = token_sets(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], n)
                entry = entries(token, size, pct, np.zeros(0, np.uint64))[0]
                yield pa.RecordBatch.from_arrays([pa.array(entry)], names=["token"])

    top = (docs.select("text").mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") > FREQUENT)
           .orderBy(F.desc("count"), "token").limit(CLASS).select("token"))
    return np.sort(np.array([r.token for r in top.collect()], np.int64).view(np.uint64))


def _index(docs: DataFrame, n: int, pct: int, frequent: np.ndarray, low_share: float) -> DataFrame:
    """rid, doc_id, sid, n, entries with their places and whether they are low, the number of low
    tokens, hist (tokens by their high bits) and odd (whether each bin holds an odd number, as bits)
    of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(2))
            for i, j in steps(offs):
                token, size = token_sets(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], n)
                entry, row, place, low, lows = entries(token, size, pct, shared.value, low_share)
                order = np.argsort(row, kind="stable")
                at = np.repeat(np.arange(len(size)), size) * BINS + (token >> np.uint64(54)).astype(np.int64)
                bins = np.bincount(at, minlength=len(size) * BINS)
                hist = np.minimum(bins, 255).astype(np.uint8).reshape(-1, BINS)
                odd = np.packbits((bins & 1).astype(np.uint8)).view(np.int64).reshape(-1, len(ODD))
                lists = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(set_ids(token, size)), pa.array(size.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(entry[order])),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(place[order].astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(low[order])), pa.array(lows.astype(np.int32)),
                     pa.array([h.tobytes() for h in hist], pa.binary()),
                     pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(odd[:, k])) for k in range(len(ODD))], names=ODD)],
                    names=["rid", "doc_id", "sid", "n", "entries", "places", "low", "lows", "hist", "odd"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"rid long, doc_id {kind}, sid long, n int, entries array<long>, places array<int>, low array<boolean>, lows int, "
                           f"hist binary, odd struct<{', '.join(f'{c}:long' for c in ODD)}>")


def _may_link(a: str, b: str, pct: int):
    """What a pair must fulfil to have the similarity asked for: lengths, places of a shared entry and low
    tokens of its own (``own``: no other set has them)."""
    n, m, i, j, u, v = f"{a}.n", f"{b}.n", f"{a}.place", f"{b}.place", f"{a}.own", f"{b}.own"
    return F.expr(f"100L * least({n}, {m}) >= {pct}L * greatest({n}, {m}) AND "
                  f"100L * least({n} - {u}, {m} - {v}) >= {pct}L * greatest({n} + {v}, {m} + {u}) AND "
                  f"({100 + pct}L) * (least({i}, {j}) + least({n} - {i}, {m} - {j})) >= {pct}L * ({n} + {m})")


def _parity(a: str, b: str, pct: int):
    """The same by parities. Sets differ by a token at least in each bin whose parity differs, and linked ones differ
    by no more tokens than their sizes allow."""
    apart = " + ".join(f"bit_count({a}.odd.{c} ^ {b}.odd.{c})" for c in ODD)
    return F.expr(f"({apart}) * {100 + pct}L <= {100 - pct}L * ({a}.n + {b}.n)")


def _near(pairs: DataFrame, index: DataFrame, pct: int) -> DataFrame:
    """``pairs`` (a, b) without those whose histograms are further apart than linked sets can be."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            x, y = (utf8(b.column(k))[0].reshape(-1, BINS).astype(np.int16) for k in (4, 5))
            apart = np.abs(x - y).sum(axis=1)
            keep = pa.array(np.flatnonzero(apart * (100 + pct) <= (100 - pct) * (n + m)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    hist = index.select("sid", "n", "hist").dropDuplicates(["sid"])
    return (pairs.join(hist.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("hist").alias("x")), "a")
            .join(hist.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("hist").alias("y")), "b")
            .select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long"))


def _verified(pairs: DataFrame, rows: DataFrame, index: DataFrame, n: int, pct: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(2), b.column(3)
            ok = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                x, y = np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                ok[k] = 100 * inter >= pct * (len(x) + len(y) - inter)
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    near = materialize(_near(pairs, index, pct), "near")
    sids = near.select(F.col("a").alias("sid")).unionByName(near.select(F.col("b").alias("sid"))).distinct()
    one = materialize(index.join(sids, "sid", "left_semi").groupBy("sid").agg(F.min("rid").alias("rid")).select("rid"), "rows")
    sets = materialize(_sets(rows, one, n).dropDuplicates(["sid"]), "sets", heavy=True)
    return materialize(
        near.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a")
        .join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
        .mapInArrow(run, "a long, b long"), "links", heavy=True)


def _sets(docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """sid and tokens (ascending 64-bit numbers) of the rows named by ``rows`` (rid)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8(b.column(0))
            for i, j in steps(offs):
                token, size = token_sets(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], n)
                end = np.cumsum(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_ids(token, size)), pa.array([token[z - k:z].tobytes() for k, z in zip(size.tolist(), end.tolist(), strict=True)], pa.binary())],
                    names=["sid", "tokens"])

    return docs.join(rows, "rid", "left_semi").select("text").mapInArrow(run, "sid long, tokens binary")


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of ``links`` (a, b): each node
    hooks on its least neighbour, hooks are shortened to roots, roots are contracted; and again."""
    edges = materialize(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "hooks")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            nearer = materialize(hook.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "hooks")
            hook = nearer.select("node", "root")
            if nearer.where("moved").isEmpty():
                break
        if total is None:
            total = hook
        else:
            total = materialize(total.join(hook.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
                                .select("node", F.coalesce("next", "root").alias("root")), "roots")
        ends = {c: hook.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"}
        edges = materialize(
            edges.join(ends["a"], "a").join(ends["b"], "b").where("a_root != b_root")
            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
    return total if total is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)


def _open(held: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the entries whose sets are not all of one component, with their roots; ``held`` has one row a
    set and entry."""
    named = held.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    open_ = materialize(named.groupBy("entry").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("entry"), "open")
    return materialize(named.join(open_, "entry").select("root", *held.columns), "rest", heavy=True)


def _linked(held: DataFrame, star: DataFrame, rows: DataFrame, index: DataFrame, n: int, pct: int) -> DataFrame:
    """node, root of the sets that link, by what they share in ``held``; ``star`` is the first round."""
    links, seen = _verified(star, rows, index, n, pct), star
    roots = components(links)
    rest = _open(held, roots)
    before = None
    while True:
        by_root = rest.groupBy("entry", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("entry").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        left = by_root.agg(F.sum(F.col("k") * F.col("k") - F.col("kk")).alias("pairs"), F.sum("k").alias("rows")).first()
        # a star asks one pair of each row: it pays while it halves what is left
        stars = (left.pairs or 0) > PAIRS * (left.rows or 0) and (before is None or 2 * left.pairs <= before)
        before = left.pairs
        if stars:
            pick = F.min(F.struct(F.xxhash64("entry", "sid", F.lit(before)).alias("h"), "sid", "n", "place", "root", "own"))
            found = rest.alias("x").join(rest.groupBy("entry").agg(pick.alias("y")), "entry")
        else:
            # all pairs of an entry: here alone are parities worth their way. Rows come set by set out of a merge join,
            # so that equal parities lie side by side in the shuffle and hardly add to it
            odd = index.groupBy("sid").agg(F.min("odd").alias("odd"))
            full = rest.join(odd.hint("merge"), "sid")
            found = full.alias("x").join(full.alias("y"), (F.col("x.entry") == F.col("y.entry")) & (F.col("x.sid") < F.col("y.sid"))).where(_parity("x", "y", pct))
        pairs = (found.where((F.col("x.root") != F.col("y.root")) & _may_link("x", "y", pct))
                 .select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct())
        pairs = materialize(pairs.join(seen, ["a", "b"], "left_anti"), "pairs", heavy=True)
        more = _verified(pairs, rows, index, n, pct)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)
        if not stars:
            return roots
        seen = seen.unionByName(pairs)
        rest = _open(rest.drop("root"), roots)


def similar_components(docs: DataFrame, n: int = 3, pct: int = 90, low_share: float = 1.0) -> DataFrame:
    """rid, doc_id, n_shingles, component_id (least doc_id reachable by links) and root (the
    component's identity, also where doc_ids are null or repeat) of every row. ``low_share``: low tokens
    as a multiple of what linked sets may differ by; more of them rule out more sets and cost entries,
    the links are the same."""
    small_batches(docs.sparkSession)
    rows = docs.select(row_id("doc_id", "text").alias("rid"), "doc_id", "text")
    index = materialize(_index(rows, n, pct, _plain_counts(rows, n, pct), low_share), "index", heavy=True)
    flat = (index.where("n > 0").select("sid", F.explode(F.arrays_zip("entries", "places", "low")).alias("e"))
            .select(F.col("e.entries").alias("entry"), "sid", F.col("e.places").alias("place"), F.col("e.low").alias("low")))
    # entries of one set alone (of copies, too) drop out before anything else is asked of them
    twice = materialize(flat.groupBy("entry").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a != b").select("entry"), "shared-entries", heavy=True)
    # one row a set and entry: where the join deals rows by entry, they need not travel again
    held = materialize(flat.join(twice, "entry", "left_semi").groupBy("entry", "sid").agg(*[F.min(c).alias(c) for c in ("place", "low")]), "entries", heavy=True)
    # low tokens that a set shares with none: every set lists its low tokens, so no other set has them
    shared = held.where("low").groupBy("sid").agg(F.count(F.lit(1)).alias("shared"))
    sets = (index.groupBy("sid").agg(*[F.min(c).alias(c) for c in ("n", "lows")]).join(shared, "sid", "left")
            .select("sid", "n", (F.col("lows") - F.coalesce("shared", F.lit(0))).alias("own")))
    # a set with more of its own than linked sets differ by links with nothing
    sets = sets.where(f"100L * (n - own) >= {pct}L * n")
    held = materialize(held.drop("low").join(sets, "sid"), "entries", heavy=True)
    # the least set of an entry is its star's centre
    centre = held.groupBy("entry").agg(F.min(F.struct("sid", "n", "place", "own")).alias("c"))
    star = materialize(held.alias("m").join(centre, "entry").where("m.sid != c.sid").where(_may_link("m", "c", pct))
                       .select(F.col("c.sid").alias("a"), F.col("m.sid").alias("b")).distinct(), "star", heavy=True)
    if held.isEmpty():
        roots = index.select(F.col("sid").alias("node"), F.col("sid").alias("root")).limit(0)
    else:
        roots = _linked(held, star, rows, index, n, pct)
    named = index.select("rid", "doc_id", "sid", "n").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    named = materialize(named.withColumn("root", F.coalesce("root", "sid")).select("rid", "doc_id", "n", "root"), "named")
    first = materialize(named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "first")
    return named.join(first, "root", "left").select(
        "rid", "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def keep_one(docs: DataFrame, n: int = 5, pct: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose group has a row before them: of each component one
    row stays, the least doc_id's (of rows equal in that, one). Rows without tokens all stay."""
    found = similar_components(docs, n, pct).where("n_shingles > 0")
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("s")).select("s.rid")
    gone = found.select("rid").join(stay, "rid", "left_anti").distinct()
    # columns of the table may have any names: they travel as one
    whole = docs.select(row_id("doc_id", "text").alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rest = whole.join(gone, "rid", "left_anti")
    # equal rows share their identity: one of them stays
    tokens = F.coalesce(F.length(F.trim(F.translate(F.coalesce(F.col("row.text"), F.lit("")), "\t\n\x0b\x0c\r", "     "))), F.lit(0)) > 0
    return rest.where(tokens).dropDuplicates(["rid"]).unionByName(rest.where(~tokens)).select("row.*")
