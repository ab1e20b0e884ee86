"""Helpers shared by the operators: table access, reliable lineage cuts, Arrow text buffers and
vectorised hashing of byte and word windows (numpy, inside tasks only)."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.session import ensure_checkpoint_dir

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text that one vectorised step of a task looks at (a longer text is a step of its own).
STEP_BYTES = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark (any file system)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by a few hundred rows: texts are long, so rows must not gather in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, heavy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage by files that survive lost
    executors. After a ``heavy`` job its shuffle files are given up before the next one begins."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if heavy:
        release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs: it acts when the driver collects
    garbage, the second time when the first one ran with the last job still being reported."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def row_id(*cols: str):
    """64-bit identity of a row by its values (nulls included); equal rows share it."""
    return F.xxhash64(*[F.col(c) for c in cols])


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if big else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def steps(offs: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``most`` bytes (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# ---------------------------------------------------------------- hashing

_BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 5  # odd and 5 mod 8: its powers have the longest period
_PI = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= (4 << 20):
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes of any [s, e) ranges of a sequence, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sum = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _pow(_P, n), out=self.sum[1:])

    def ranges(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        inv = _pow(_PI, len(self.sum))
        return mix((self.sum[e] - self.sum[s]) * inv[s] + (e - s).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of every k consecutive values."""
        n = len(self.sum) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sum[k:] - self.sum[:n]) * _pow(_PI, n))


_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row + total) of the words ``[^\\x20\\x09-\\x0D]+``."""
    space = _SPACE[data]
    start = ~space
    end = ~space
    if len(data):
        start[1:] &= space[:-1]
        end[:-1] &= space[1:]
        full = offs[1:] > offs[:-1]
        first, last = offs[:-1][full], offs[1:][full] - 1
        start[first] = ~space[first]
        end[last] = ~space[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: eight bytes after the other are mixed into a state (splitmix64's
    finaliser, no polynomial: words can be of any length and content)."""
    size = e - s
    state = mix(size.astype(np.uint64) + np.uint64(_P))
    if not len(s):
        return state
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at, live = s.copy(), np.arange(len(s))
    left = size.copy()
    while len(live):
        lane = eight[at] & _LANE[np.minimum(left, 8)]
        state[live] = mix(state[live] ^ lane)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return state


def sliding_min(h: np.ndarray, w: int, block: int = 1 << 23) -> np.ndarray:
    """For every i: the position of the least of h[i:i+w], the leftmost of equals (by its high 40
    bits); long inputs go block by block, as a position has 24 bits beside them."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.concatenate([a + _sliding_min(h[a:min(a + block, n) + w - 1], w) for a in range(0, n, block)])


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h) - w + 1
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    cover = 1
    while cover * 2 <= w:
        m = np.minimum(m[:-cover], m[cover:])
        cover *= 2
    if cover < w:
        m = np.minimum(m[:n], m[w - cover:w - cover + n])
    return (m & low).astype(np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [starts, starts + lengths)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.repeat(starts - begin, lengths) + np.arange(total)


def covered(total: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of length ``total`` of the positions inside any [starts, ends)."""
    d = np.zeros(total + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0
