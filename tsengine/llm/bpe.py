"""Byte-level BPE encoding and decoding by a monoid tree (operator 6).

Texts are cut by the tokenizer's pattern; each match is encoded on its own. A match is halved until
a leaf is short, leaves are merged by rank, and two neighbours join by re-encoding a window of
tokens around their border. The window grows until the token left of it and the token right of it
each form, with the window's outer token, a pair that encodes to itself: then every neighbouring
pair of the result is stable, which makes the result the encoding of the whole. Token sequences
under this join are a monoid, so the order of joins is free. Decoding concatenates up the same tree.

Null text counts as empty: no tokens. Special tokens are never made; their strings are plain text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tsengine.llm.common import small_batches

LEAF = 16          # bytes of a leaf
KEEP = 300_000     # matches whose ids a worker remembers


def _finder(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of the pattern. Texts below U+0250 go through an equal pattern whose property
    classes are spelt out (from the regex library itself), which the plain engine runs faster."""
    full = regex.compile(pattern).findall
    classes = {}
    for name in ("\\p{L}", "\\p{N}", "\\s"):
        hit = regex.compile(name).match
        classes[name] = "".join(re.escape(chr(c)) for c in range(0x250) if hit(chr(c)))
    if re.search(r"\\[^sSp]|\\p\{(?![LN]\})|\[[^\]]*\\S", pattern):
        return full
    # a class stands in brackets unless it is inside some already
    spelt, depth = [], 0
    for part in re.split(r"(\\p\{[LN]\}|\\s|\\S|\[|\])", pattern):
        depth += (part == "[") - (part == "]")
        if part in classes:
            part = classes[part] if depth else f"[{classes[part]}]"
        elif part == "\\S":
            part = f"[^{classes[chr(92) + 's']}]"
        spelt.append(part)
    plain, beyond = re.compile("".join(spelt)).findall, re.compile("[^\x00-\u024f]").search
    return lambda text: full(text) if beyond(text) else plain(text)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.bytes_by_text = {str(i): t for t, i in ranks.items()}
        self.find = _finder(pattern)
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.ids_text = _Kept(self)
        self._pairs: tuple[np.ndarray, np.ndarray] | None = None

    def merge(self, piece: bytes) -> list[int]:
        """Plain merges, least rank first."""
        ranks = self.ranks
        parts = [piece[i:i + 1] for i in range(len(piece))]
        got = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while got:
            best = min((r for r in got if r is not None), default=None)
            if best is None:
                break
            i = got.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del got[i]
            if i:
                got[i - 1] = ranks.get(parts[i - 1] + parts[i])
            if i < len(got):
                got[i] = ranks.get(parts[i] + parts[i + 1])
        return [ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Do the two tokens stay as they are when their bytes are encoded together?"""
        ok = self.pair_ok.get((a, b))
        if ok is None:
            if len(self.pair_ok) > KEEP:
                self.pair_ok.clear()
            ok = self.pair_ok[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """Encoding of x + y from the encodings a of x and b of y."""
        if not a or not b:
            return a + b
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            inner = b"".join(self.bytes_of[t] for t in a[len(a) - i:] + b[:j])
            window = self.merge(inner) if len(inner) <= 8 * LEAF else self.encode_piece(inner, direct=False)
            left = i == len(a) or self.stable(a[-i - 1], window[0])
            right = j == len(b) or self.stable(window[-1], b[j])
            if left and right:
                return a[:len(a) - i] + window + b[j:]
            i, j = i if left else 2 * i, j if right else 2 * j

    def encode_piece(self, piece: bytes, direct: bool = True) -> list[int]:
        """Leaves, then neighbours joined level by level (no recursion depth to run out of)."""
        if direct and piece in self.ranks:
            return [self.ranks[piece]]
        return self._joined([self.merge(piece[i:i + LEAF]) for i in range(0, len(piece), LEAF)])

    def _joined(self, level: list[list[int]]) -> list[int]:
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted pair keys, merged ids) of all pairs of tokens whose bytes together are a token."""
        if self._pairs is None:
            made = [((self.ranks[t[:i]] << 32) | self.ranks[t[i:]], r) for t, r in self.ranks.items()
                    for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
            made.sort()
            self._pairs = (np.array([k for k, _ in made] or [-1], np.int64), np.array([r for _, r in made] or [0], np.int64))
        return self._pairs

    def merge_leaves(self, leaves: list[bytes]) -> list[list[int]]:
        """``merge`` of many leaves of at most LEAF bytes, one least-rank merge of each at a time."""
        keys, merged = self.pair_table()
        none = np.int64(1) << 40

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            k = (a << 32) | b
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            return np.where((keys[at] == k) & (a >= 0) & (b >= 0), merged[at], none)

        size = np.array([len(x) for x in leaves], np.int64)
        wide = int(size.max())
        raw = np.frombuffer(b"".join([x.ljust(wide, b"\0") for x in leaves]), np.uint8).reshape(-1, wide)
        one = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        ids = np.where(np.arange(wide) < size[:, None], one[raw], -1)
        ids = np.concatenate([ids, np.full((len(leaves), 1), -1, np.int64)], axis=1)
        pair = np.concatenate([rank(ids[:, :-1], ids[:, 1:]), np.full((len(leaves), 1), none)], axis=1)
        live, at = np.arange(len(leaves)), np.arange(wide + 1)
        while len(live):
            sub_pair = pair[live]
            best = sub_pair.argmin(axis=1)
            low = sub_pair[np.arange(len(live)), best]
            live, best, low = live[low < none], best[low < none], low[low < none]
            if not len(live):
                break
            take = np.minimum(at + (at > best[:, None]), wide)
            row = np.take_along_axis(ids[live], take, 1)
            p = np.take_along_axis(pair[live], take, 1)
            r = np.arange(len(live))
            row[r, best] = low
            p[r, best] = rank(low, row[r, np.minimum(best + 1, wide)])
            left = np.maximum(best - 1, 0)
            p[r, left] = np.where(best > 0, rank(row[r, left], low), p[r, left])
            ids[live], pair[live] = row, p
        return [row[:n].tolist() for row, n in zip(ids, (ids >= 0).sum(axis=1), strict=True)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode matches not seen before: their leaves together, then each match's tree."""
        raw = [(p, p.encode()) for p in pieces]
        if len(self.ids_text) + len(raw) > KEEP:
            self.ids_text.clear()
        hard = []
        for p, b in raw:
            if b in self.ranks:
                self.ids_text[p] = str(self.ranks[b])
            elif len(p) <= 64:
                hard.append((p, [b[i:i + LEAF] for i in range(0, len(b), LEAF)]))
        hard.sort(key=lambda x: (len(x[1]), len(x[1][0])))
        for i in range(0, len(hard), 20_000):
            part = hard[i:i + 20_000]
            done = iter(self.merge_leaves([x for _, leaves in part for x in leaves]))
            for p, leaves in part:
                ids = next(done) if len(leaves) == 1 else self._joined([next(done) for _ in leaves])
                self.ids_text[p] = " ".join([self.text_of[t] for t in ids])

    def encode_texts(self, texts: list[str]) -> list[str]:
        """``encode_text`` of many texts."""
        found = [self.find(t) for t in texts]
        self.learn({p for f in found for p in f if p not in self.ids_text})
        return [" ".join(map(self.ids_text.__getitem__, f)) for f in found]

    def encode_text(self, text: str) -> str:
        """Ids of the whole text in decimal, joined by one space."""
        return " ".join(map(self.ids_text.__getitem__, self.find(text)))

    def decode_text(self, ids: str) -> bytes:
        """Bytes of the tokens, neighbours joined level by level up the tree."""
        parts = list(map(self.bytes_by_text.__getitem__, ids.split(" "))) if ids else [b""]
        while len(parts) > 1:
            odd = parts[-1:] if len(parts) % 2 else []
            parts = list(map(add, parts[::2], parts[1::2])) + odd
        return parts[0]


class _Kept(dict):
    """Ids (as text) of matches seen before; emptied when full."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> str:
        ids = " ".join(map(str, self.bpe.encode_piece(piece.encode())))
        if len(piece) <= 64:
            if len(self) >= KEEP:
                self.clear()
            self[piece] = ids
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file (token in base64, rank), read on the driver: its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_loaded: dict[str, Bpe] = {}


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the token ids and the
    decoded text. The vocabulary (bounded by its file) is broadcast; rows never leave their partition."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ranks)
    key = hashlib.sha256(f"{sorted(ranks.items())}{pattern}".encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded.get(key)
        if bpe is None:  # kept for the worker's later tasks
            _loaded.clear()
            bpe = _loaded[key] = Bpe(shared.value, pattern)
        for b in batches:
            counts, shas, decoded, out_ids, out_text = [], [], [], [], []
            texts = [x or "" for x in b.column(1).to_pylist()]
            for got in (g for i in range(0, len(texts), 128) for g in bpe.encode_texts(texts[i:i + 128])):
                back = bpe.decode_text(got)
                counts.append(got.count(" ") + 1 if got else 0)
                shas.append(hashlib.sha256(got.encode()).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                if ids:
                    out_ids.append(np.array(got.split(), np.int32))
                    out_text.append(back.decode())
            cols = [b.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols += [pa.array(out_ids, pa.list_(pa.int32())), pa.array(out_text, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>, decoded string" if ids else ""))
