"""WARC archives with segmented records.

Writing: one record per page. The payload (the page's UTF-8 text) is framed as a chunked HTTP
message. A block longer than SEGMENT is cut: the first record carries the origin's id and segment
number 1, `continuation` records name the origin and their number, the last one the total length.
Segments of one record lie in whichever archive their task writes, so an archive holds segments
whose origin is elsewhere. Of records with equal payloads of at least LEAST_REVISIT bytes the one
with the largest page_id is written whole; the others are `revisit` records that name it.

Reading: archives are parsed record by record; segments are grouped by origin, ordered by number,
checked for gaps and for the total length, joined, and the chunked framing is decoded. Revisits take
length and digest from the response they refer to. What doesn't add up keeps its row, with an
error and a null payload.

Each task writes archives under a name of its own attempt; only those in the stored manifest count.

Defined cases: null html is an empty payload. A null page_id is never part of a revisit group.
Rows of equal page_id and payload have one record id; read back they are as many rows again. An
empty table writes no archive and reads as an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemart.llm.common import opened, small_batches, written
from tidemart.session import work_dir

LEAST_REVISIT = 1000
#: Bytes of an archive read at once.
READ = 1 << 16
#: Bytes of a block that one record holds, and of a chunk of the HTTP framing.
SEGMENT, CHUNK = 16_384, 4_096
MANIFEST = "file string, n_records long, n_bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class BadRecord(ValueError):
    """A record or message whose framing doesn't add up."""


# --- framing -----------------------------------------------------------------------------------

def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked message; chunk extensions and trailers are allowed."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            raise BadRecord("a chunk without its size")
        size, at = int(digits, 16), end + 2
        if not size:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise BadRecord("a chunk shorter than its size")
        parts.append(body[at:at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise BadRecord("no end of the HTTP header")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [f"{k}: {v}" for k, v in headers.items()] + [f"Content-Length: {len(block)}"]
    text = "WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (by lower-case name) and block of each record of a gzip archive."""
    # what follows a record is copied for it, so reads are small
    packed, unpacker, held = stream.read(READ), zlib.decompressobj(31), io.BytesIO()
    while packed:
        held.write(unpacker.decompress(packed))
        if not unpacker.eof:
            packed = stream.read(READ)
            continue
        packed = unpacker.unused_data or stream.read(READ)
        text = held.getvalue()
        unpacker, held = zlib.decompressobj(31), io.BytesIO()
        head, found, block = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not found or not lines[0].startswith("WARC/"):
            raise BadRecord("no WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        if len(block) != length + 4:
            raise BadRecord("a block of another length than its header says")
        yield headers, block[:length]
    if held.tell():
        raise BadRecord("an archive that ends inside a record")


# --- writing -----------------------------------------------------------------------------------

def _record_id(page_id: Column, digest: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest))


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.UUID(name)}>"


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages with payload, digest, and `refers_to` where an equal payload with a larger page_id
    exists. Digests are grouped with partial maxima; only repeated ones are joined back."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"),
                        F.coalesce("url", F.lit("")).alias("url"),
                        payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    repeated = (rows.filter((F.length("payload") >= least) & F.col("page_id").isNotNull())
                .groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
                .filter("n > 1").select(F.col("digest").alias("same"), "last"))
    repeated = written(repeated, "warc-repeated")
    joined = rows.join(repeated, (F.col("digest") == F.col("same"))
                       & (F.length("payload") >= least) & F.col("page_id").isNotNull(), "left")
    refers = F.when(F.col("page_id") < F.col("last"), F.col("last"))
    return joined.select(
        "page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest",
        refers.alias("refers_to"), _record_id(F.col("page_id"), F.col("digest")).alias("id"),
        F.when(refers.isNotNull(), _record_id(refers, F.col("digest"))).alias("refers_id"))


def page_records(row: dict, segment: int = SEGMENT) -> Iterator[tuple[int, bytes]]:
    """(segment number, record) of one planned page."""
    common = {"WARC-Date": DATE, "WARC-Target-URI": " ".join(row["url"].split())}
    if row["page_id"] is not None:
        common["X-Page-Id"] = str(row["page_id"])
    digest = {"WARC-Payload-Digest": f"sha1:{_base32(row['digest'])}"}
    http = {"Content-Type": "application/http; msgtype=response"}
    if row["refers_to"] is not None:
        yield 1, record({"WARC-Type": "revisit", "WARC-Record-ID": _urn(row["id"]), **common,
                         "WARC-Profile": PROFILE, "WARC-Refers-To": _urn(row["refers_id"]),
                         "X-Refers-To-Page": str(row["refers_to"]), **digest, **http},
                        HTTP + b"\r\n")
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"])
    n = max(1, -(-len(block) // segment))
    for k in range(n):
        part = block[k * segment:(k + 1) * segment]
        if k:
            own = {"WARC-Type": "continuation",
                   "WARC-Record-ID": _urn(hashlib.md5(f"{row['id']}#{k}".encode()).hexdigest()),
                   "WARC-Segment-Origin-ID": _urn(row["id"]), **common}
        else:
            own = {"WARC-Type": "response", "WARC-Record-ID": _urn(row["id"]), **common, **digest,
                   **http}
        if n > 1:
            own["WARC-Segment-Number"] = str(k + 1)
            if k == n - 1:
                own["WARC-Segment-Total-Length"] = str(len(block))
        yield k + 1, record(own, part)


def write(pages: DataFrame, folder: str, segment: int = SEGMENT) -> DataFrame:
    """Writes the archives; the stored manifest has a row per archive. Each task fills one archive
    with whole records and first segments, and one with continuations."""
    small_batches(pages.sparkSession)
    plan = planned(pages)
    files, base = opened(folder)
    files.create_dir(base, recursive=True)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outs: dict[str, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for number, data in page_records(row, segment):
                    kind = "first" if number == 1 else "more"
                    if kind not in outs:
                        store, place = opened(folder)
                        name = (f"{kind}-{TaskContext.get().partitionId():06d}-"
                                f"{uuid.uuid4().hex[:12]}.warc.gz")
                        outs[kind] = [name, store.open_output_stream(f"{place}/{name}"), 0, 0]
                    out = outs[kind]
                    out[1].write(data)
                    out[2] += 1
                    out[3] += len(data)
        for out in outs.values():
            out[1].close()
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([o[0] for o in outs.values()], pa.string()),
            "n_records": pa.array([o[2] for o in outs.values()], pa.int64()),
            "n_bytes": pa.array([o[3] for o in outs.values()], pa.int64())})

    return written(plan.mapInArrow(archive, MANIFEST), "warc-manifest")


# --- reading -----------------------------------------------------------------------------------

RECORD = ("type string, id string, origin string, segment int, total long, page_id long, "
          "refers_id string, refers_to long, declared string, block binary")


def parsed(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of all archives of a manifest."""
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("type", pa.string()), ("id", pa.string()), ("origin", pa.string()),
            ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()),
            ("refers_id", pa.string()), ("refers_to", pa.int64()), ("declared", pa.string()),
            ("block", pa.binary())])
        number = lambda h, k: int(h[k]) if k in h else None
        for frame in frames:
            for name in frame.column(0).to_pylist():
                store, place = opened(folder)
                held, size = [], 0
                with store.open_input_stream(f"{place}/{name}") as stream:
                    for h, block in records(stream):
                        held.append({
                            "type": h["warc-type"], "id": h["warc-record-id"],
                            "origin": h.get("warc-segment-origin-id", h["warc-record-id"]),
                            "segment": number(h, "warc-segment-number") or 1,
                            "total": number(h, "warc-segment-total-length"),
                            "page_id": number(h, "x-page-id"),
                            "refers_id": h.get("warc-refers-to"),
                            "refers_to": number(h, "x-refers-to-page"),
                            "declared": h.get("warc-payload-digest"), "block": block,
                            # whether other records belong to it
                        } | ({} if "warc-segment-number" in h or h["warc-type"] == "continuation"
                             else {"segment": 0}))
                        size += len(block)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    n = max(1, min(manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism * 4))
    return manifest.select("file").repartition(n, "file").mapInArrow(parse, RECORD)


def reassembled(rows: DataFrame) -> DataFrame:
    """Whole records: segments of one origin in order as `parts`, if none is missing and their length
    is the total that the last one states. Unsegmented records (segment 0) stay where they are, with
    their `block`. Parts are joined once, by `decoded`."""
    whole = rows.filter("segment = 0").select(
        "type", "id", "page_id", "refers_id", "refers_to", "declared", "block",
        F.lit(None).cast("array<binary>").alias("parts"), F.lit(None).cast("string").alias("error"),
        F.lit(1).cast("bigint").alias("n"))
    one = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    # equal segments of repeated pages fall together and are counted
    parts = (rows.filter("segment > 0").groupBy(
                 "origin", "segment", F.length("block").alias("size"), F.sha2("block", 256).alias("of"))
             .agg(F.count("*").alias("n"), F.first("block").alias("block"),
                  *[F.max(c).alias(c) for c in (
                      "type", "total", "page_id", "refers_id", "refers_to", "declared")])
             .groupBy("origin").agg(
                 *[one(c) for c in ("type", "page_id", "refers_id", "refers_to", "declared")],
                 F.max("total").alias("total"), F.max(F.when(F.col("segment") == 1, F.col("n")))
                 .alias("n"), F.sort_array(F.collect_list(F.struct("segment", "block")))
                 .alias("parts"), F.sum("size").alias("size")))
    numbers = F.transform("parts", lambda p: p["segment"])
    complete = numbers == F.sequence(F.lit(1), F.size("parts"))
    error = (F.when(~complete, F.lit("segments are missing or repeated"))
             .when(F.col("total").isNull(), F.lit("no last segment"))
             .when(F.col("size") != F.col("total"), F.lit("another total length")))
    segmented = parts.select(
        "type", F.col("origin").alias("id"), "page_id", "refers_id", "refers_to", "declared",
        F.lit(None).cast("binary").alias("block"), F.when(error.isNull(), F.transform(
            "parts", lambda p: p["block"])).alias("parts"), error.alias("error"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("n"))
    return whole.union(segmented)


PAYLOAD = ("type string, id string, page_id long, refers_id string, refers_to long, error string, "
           "payload_bytes long, payload_digest string, payload binary")


def decoded(rows: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Payloads of whole records, with their digest compared to the declared one."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("type", pa.string()), ("id", pa.string()), ("page_id", pa.int64()),
            ("refers_id", pa.string()), ("refers_to", pa.int64()), ("error", pa.string()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("payload", pa.binary())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                got, error = None, row["error"]
                if error is None and row["type"] == "response":
                    try:
                        whole = row["block"] if row["parts"] is None else b"".join(row["parts"])
                        got = http_payload(whole)
                    except BadRecord as bad:
                        error = str(bad)
                digest = hashlib.sha1(got).hexdigest() if got is not None else None
                if got is not None and row["declared"] not in (None, f"sha1:{_base32(digest)}"):
                    got, digest, error = None, None, "another payload digest"
                out += [{k: row[k] for k in ("type", "id", "page_id", "refers_id", "refers_to")} | {
                    "error": error, "payload_bytes": None if got is None else len(got),
                    "payload_digest": digest,
                    "payload": got if keep_payload else None}] * row["n"]
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(decode, PAYLOAD)


def read(manifest: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """Pages read back from the archives: page_id, record_type, refers_to, error, payload (of
    responses), payload_bytes and payload_digest (revisits: those of the response)."""
    rows = decoded(reassembled(parsed(manifest, folder)), keep_payload)
    if not keep_payload:
        rows = written(rows.drop("payload"), "warc-decoded").withColumn(
            "payload", F.lit(None).cast("binary"))
    first = F.first("payload_bytes").alias("b"), F.first("payload_digest").alias("d")
    known = rows.filter("type = 'response'").groupBy(F.col("id").alias("of")).agg(*first)
    seen = rows.filter("type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        "refers_to", "error", "payload")
    again = (rows.filter("type = 'revisit'").join(known, F.col("refers_id") == F.col("of"), "left")
             .select("page_id", F.col("b").alias("payload_bytes"),
                     F.col("d").alias("payload_digest"), F.col("type").alias("record_type"),
                     "refers_to", F.coalesce("error", F.when(F.col("d").isNull(), F.lit(
                         "no such response"))).alias("error"), "payload"))
    return seen.union(again)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages and reads the archives back, one row per page, without payloads."""
    folder = folder or work_dir(pages.sparkSession, "warc")
    return read(write(pages, folder), folder, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
