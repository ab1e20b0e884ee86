"""WARC archives: writing segmented records, reading them back, segment reassembly (operator 8).

Writing: one HTTP response record per page, its body in chunked transfer framing; a block longer
than ``SEGMENT`` bytes is cut into a first segment and continuation records. Of pages with equal
payloads of at least ``least`` bytes the one with the largest page_id is the response, the others
are revisit records that name it. Blocks are cut between characters, so that an archive is UTF-8
text throughout and Spark's text writer (any file system) writes it; ``\\r\\n\\r\\n`` ends a record.

Reading: archives are parsed by Content-Length; continuation records are grouped by the identifier
of their origin, ordered by segment number, checked against the total length, joined, and the
chunked framing is decoded. A record whose segments are missing or whose length is wrong is kept
with ``complete`` false and the payload that is there.

Null html counts as empty; a null url or page_id is left out of the headers and read back as null.
Rows that share a page_id are records of their own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import materialize, small_batches

SEGMENT = 32 * 1024        # bytes of a block in one record, at most
FILE_RECORDS = 512         # records of an archive: bounds its size
CHUNK = 8 * 1024           # bytes of a transfer chunk, about
END = "\r\n"


def _cut(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` UTF-8 bytes, cut between characters."""
    raw, out, i = text.encode(), [], 0
    while i < len(raw):
        j = min(i + most, len(raw))
        while j < len(raw) and raw[j] & 0xC0 == 0x80:
            j -= 1
        out.append(raw[i:j].decode())
        i = j
    return out


def _record(fields: list[tuple[str, str | int | None]], block: str) -> str:
    head = "".join(f"{k}: {v}{END}" for k, v in fields if v is not None)
    return f"WARC/1.1{END}{head}Content-Length: {len(block.encode())}{END}{END}{block}"


def _page_records(rid: str, page_id: int | None, url: str | None, html: str, digest: str, refers: int | None) -> Iterator[str]:
    target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    base = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Page-ID", page_id)]
    size = len(html.encode())
    if refers is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:record:{rid}>"), *base,
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To-Page", refers)],
                      f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {size}{END}{END}")
        return
    body = "".join(f"{len(c.encode()):X}{END}{c}{END}" for c in _cut(html, CHUNK)) + f"0{END}{END}"
    block = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Transfer-Encoding: chunked{END}{END}{body}"
    parts = _cut(block, SEGMENT)
    many = len(parts) > 1
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:record:{rid}>"), *base,
                   ("WARC-Segment-Number", 1 if many else None)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:record:{rid}:{n}>"),
                       ("WARC-Segment-Origin-ID", f"<urn:record:{rid}>"), ("WARC-Segment-Number", n),
                       ("WARC-Segment-Total-Length", len(block.encode()) if n == len(parts) else None)], part)


def write_archives(pages: DataFrame, path: str, least: int = 1000) -> None:
    """Write the archives of ``pages`` (page_id, url, html) into the new folder ``path``."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    equal = (rows.where(F.octet_length("html") >= least).groupBy("digest")
             .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers")).where("n > 1").select("digest", "refers"))
    # written first, so that Spark knows its size: pages are shuffled only when it is not small
    equal = materialize(equal, "equal-payloads")
    rows = rows.join(equal, "digest", "left").withColumn(
        "refers", F.when(~F.col("refers").eqNullSafe(F.col("page_id")), F.col("refers")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            out, held = [], 0
            for page_id, url, html, digest, refers in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                for r in _page_records(f"{part}-{k}", page_id, url, html, digest, refers):
                    out.append(r)
                    held += len(r)
                k += 1
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    (rows.select("page_id", "url", "html", "digest", "refers").mapInArrow(run, "value string")
     .write.option("lineSep", END * 2).option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of one archive, found by Content-Length."""
    at = 0
    while at < len(raw):
        if raw[at:at + 2] == b"\r\n":
            at += 2
            continue
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or raw[at:at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in raw[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        yield head, raw[end + 4:end + 4 + size]
        at = end + 4 + size


def decode_http(block: bytes) -> tuple[dict[str, str], bytes, bool]:
    """(HTTP headers, payload, complete) of a response block; chunked framing is decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)}
    if fields.get("transfer-encoding", "").lower() != "chunked":
        return fields, body, True
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return fields, b"".join(out), False
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return fields, b"".join(out), True
        out.append(body[end + 2:end + 2 + size])
        if len(out[-1]) < size:
            return fields, b"".join(out), False
        at = end + 4 + size


_PARSED = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()),
                     ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()),
                     ("block", pa.binary())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                   ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("complete", pa.bool_())])
_PARSED_SQL = ("origin string, segment int, total long, page_id long, url string, record_type string, refers_to long, "
               "digest string, block binary")
_READ_SQL = ("page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, "
             "payload_digest string, complete boolean")


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def _read_row(page_id, url, kind, refers, digest, block: bytes, whole: bool, payload: bool) -> tuple:
    fields, body, complete = decode_http(block)
    if kind == "revisit":
        return page_id, url, kind, refers, None, int(fields["content-length"]), digest, whole
    sha = hashlib.sha1(body).hexdigest()
    return page_id, url, kind, refers, body if payload else None, len(body), sha, whole and complete and sha == digest


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every response and revisit record: page_id, url, record_type, refers_to, payload (null for
    revisits, or without ``payload``), payload_bytes, payload_digest, complete."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                out, held = [], 0
                for h, block in parse(raw.as_py()):
                    rid = h["WARC-Record-ID"]
                    out.append((h.get("WARC-Segment-Origin-ID", rid), _number(h.get("WARC-Segment-Number")),
                                _number(h.get("WARC-Segment-Total-Length")), _number(h.get("WARC-Page-ID")), h.get("WARC-Target-URI"),
                                h["WARC-Type"], _number(h.get("WARC-Refers-To-Page")), h.get("WARC-Payload-Digest", "").removeprefix("sha1:"), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield _columns(out, _PARSED)
                        out, held = [], 0
                if out:
                    yield _columns(out, _PARSED)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            yield _columns([_read_row(c["page_id"][i], c["url"][i], c["record_type"][i], c["refers_to"][i], c["digest"][i],
                                      c["block"][i], True, payload) for i in range(b.num_rows)], _READ)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column(0).to_pylist():
                first, last = parts[0], parts[-1]
                block = b"".join(p["block"] for p in parts)
                good = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and last["total"] == len(block)
                out.append(_read_row(first["page_id"], first["url"], "response", None, first["digest"], block, good, payload))
            yield _columns(out, _READ)

    parsed = files.mapInArrow(records, _PARSED_SQL)
    single = parsed.where("segment IS NULL").mapInArrow(whole, _READ_SQL)
    groups = (parsed.where("segment IS NOT NULL").groupBy("origin")
              .agg(F.sort_array(F.collect_list(F.struct("segment", "total", "page_id", "url", "digest", "block"))).alias("parts")))
    return single.unionByName(groups.select("parts").mapInArrow(joined, _READ_SQL))
