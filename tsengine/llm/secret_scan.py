"""Secret scan with a token-efficiency test (operator 12).

Three kinds are found by their form: assignments to a secret's name, access keys, long hex strings.
The method adds a fourth, ``random``: runs of 20 or more of ``[A-Za-z0-9+/_-]``, with up to two ``=``
after them, whose characters per token under a byte-level vocabulary stay below ``RATIO``. A
vocabulary holds what people write, so a long string that falls into many short tokens was not
written but drawn. Known digests (hex of a digest's length, integrity strings) and identifiers
(UUIDs, numbers, names made of words and numbers) are excluded before the test, runs that meet a span
found already are not told twice. Spans of the first three kinds are never taken back.

Places are code points, ends are exclusive; spans go by start, then by kind as listed. Null texts
count as empty and have no spans. Every row is scanned whole and on its own, rows that share a doc_id
too; an empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.llm.common import small_batches, utf8

KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
RATIO = 2.5
LEAST = {"assign": 6, "access": 20, "hex": 24, "random": 20}

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-")] = True

#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGESTS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile(rf"(?:{'|'.join(f'[0-9a-fA-F]{{{n}}}' for n in DIGESTS)}|(?:sha|SHA)-?(?:1|224|256|384|512)[-_/].*)")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def known(run: str) -> bool:
    """A digest or an identifier: nothing to keep secret by its form."""
    if _DIGEST.fullmatch(run) or _UUID.fullmatch(run):
        return True
    for part in re.split(r"[+/_=-]+", run):
        if part.isdigit() or not part:
            continue
        # a name is words of three letters and more on average, set apart by case
        if not part.isalpha() or len(part) < 3 * len(_HUMP.findall(part)):
            return False
    return True


def _runs(kind: np.ndarray, data: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of a class within rows, from ``least`` bytes on."""
    inside = kind[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offs[1:] > offs[:-1]
    first, last = offs[:-1][full], offs[1:][full] - 1
    start[first], end[last] = inside[first], inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = e - s >= least
    return s[long], e[long]


def _rows_with(text: bytes, offs: np.ndarray, needles: tuple[bytes, ...]) -> set[int]:
    """Rows that hold one of the needles."""
    rows: set[int] = set()
    for needle in needles:
        at = text.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offs, at, side="right")) - 1
            if at + len(needle) <= offs[row + 1]:
                rows.add(row)
                at = text.find(needle, int(offs[row + 1]))
            else:
                at = text.find(needle, at + 1)
    return rows


class Scanner:
    def __init__(self, ranks: dict[bytes, int], pattern: str, ratio: float):
        import tiktoken
        self.encode = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ratio = ratio

    def random(self, run: str) -> bool:
        return not known(run) and len(run) < self.ratio * len(self.encode(run))

    def spans(self, data: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Row -> (start, kind, end) in code points, in order."""
        text = data.tobytes()
        found: dict[int, list[tuple[int, int, int]]] = {}

        def add(row: int, kind: int, s: int, e: int) -> None:
            found.setdefault(row, []).append((s, kind, e))

        for row in _rows_with(text.lower(), offs, _NAMES):
            lo = int(offs[row])
            for m in _ASSIGN.finditer(text[lo:int(offs[row + 1])]):
                if len(m[2]) >= LEAST["assign"]:
                    add(row, 0, lo + m.start(), lo + m.end())
        for row in _rows_with(text, offs, (b"AKIA",)):
            lo = int(offs[row])
            for m in _ACCESS.finditer(text[lo:int(offs[row + 1])]):
                if len(m[0]) >= LEAST["access"]:
                    add(row, 1, lo + m.start(), lo + m.end())
        s, e = _runs(_HEX, data, offs, LEAST["hex"])
        for row, a, b in zip((np.searchsorted(offs, s, side="right") - 1).tolist(), s.tolist(), e.tolist(), strict=True):
            add(row, 2, a, b)
        base = {row: list(x) for row, x in found.items()}
        s, e = _runs(_RUN, data, offs, LEAST["random"])
        for row, a, b in zip((np.searchsorted(offs, s, side="right") - 1).tolist(), s.tolist(), e.tolist(), strict=True):
            pad = 0
            while pad < 2 and b < offs[row + 1] and text[b] == 0x3D:
                pad, b = pad + 1, b + 1
            if not any(x < b and a < y for x, _, y in base.get(row, ())) and self.random(text[a:b].decode("ascii")):
                add(row, 3, a, b)
        for row, x in found.items():
            lo, hi = int(offs[row]), int(offs[row + 1])
            points = np.zeros(hi - lo + 1, np.int64)
            np.cumsum((data[lo:hi] & 0xC0) != 0x80, out=points[1:])
            found[row] = sorted((int(points[a - lo]), kind, int(points[b - lo])) for a, kind, b in x)
        return found


_scanners: dict[str, Scanner] = {}


def _scan(ranks: dict[bytes, int], pattern: str, ratio: float):
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern, ratio)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.get(key)
        if scanner is None:  # kept for the worker's next task
            scanner = _scanners[key] = Scanner(ranks, pattern, ratio)
        for batch in batches:
            data, offs = utf8(batch.column(1))
            found = scanner.spans(data, offs)
            lists = [found.get(i, ()) for i in range(batch.num_rows)]
            flat = [x for one in lists for x in one]
            spans = pa.StructArray.from_arrays(
                [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())],
                names=["kind", "start", "end"])
            offsets = pa.array(np.cumsum([0, *map(len, lists)], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, spans)], names=["doc_id", "found"])
    return run


def find_secrets(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ratio: float = RATIO) -> DataFrame:
    """doc_id and ``found`` (array of kind, start, end) of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(ranks, pattern, ratio), f"doc_id {kind}, found array<struct<kind:string,start:long,end:long>>")


def count(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")


def listing(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    some = F.filter("found", lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
