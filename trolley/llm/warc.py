"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by offset.

The writer leaves each archive as one gzip stream over all its records, as many crawlers do; such a file can
only be read from its start. The normaliser inflates that stream once, rewrites every record as a gzip member
of its own, and writes a sidecar index of the members' offsets (CDXJ lines beside the archive, and a table).
With it a reader fetches any record alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.files import Readers, create, reader
from trolley.llm.textblock import as_batch
from trolley.llm.workspace import Workspace, partitions

#: Payloads of fewer bytes are always stored.
LEAST = 1000
#: Payload bytes after which a task starts its next archive.
ARCHIVE = 64 << 20
LEVEL = 3
#: Repeated payloads up to which all are broadcast, and copies of one payload from which it is at any number of them.
FEW, HOT = 100_000, 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, at long, size long, record_type string, page_id long, uri string, payload_digest string"


def _clean(value: str) -> str:
    """A header value on one line: control characters are escaped as in URIs."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(kind: str, page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit names the record with the payload and has no block but the HTTP head."""
    name = "none" if page_id is None else page_id
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{name}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": _clean(uri) if uri else f"urn:page:{name}",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        fields |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(data: bytes) -> dict[str, str]:
    """The header fields of a record that starts at data, names in lower case."""
    lines = data[: data.index(b"\r\n\r\n")].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; no more than one record and one chunk are held."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            size = end + 8 + int(parse_head(bytes(held[: end + 4]))["content-length"])
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
    if held:
        raise ValueError("the archive ends within a record")


def inflated(uri: str, step: int = 1 << 20) -> Iterator[bytes]:
    """The contents of a gzip file, whatever its number of members, in chunks of at most step bytes."""
    stream = zlib.decompressobj(31)
    with reader(uri) as source:
        while data := source.read(step):
            out = b""
            while data or len(out) == step:  # a full chunk may leave more behind
                if out := stream.decompress(data, step):
                    yield out
                data = stream.unconsumed_tail
                if stream.eof:
                    data, stream = stream.unused_data, zlib.decompressobj(31)


def _id(value: str | None) -> int | None:
    name = (value or "").rpartition(":")[2].rstrip(">")
    return int(name) if name.lstrip("-").isdigit() else None


def _revisits(pages: DataFrame) -> DataFrame:
    """Of pages that share a payload of LEAST bytes or more: its digest, their number, and the largest page_id among them (null if all are)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = pages.select("page_id", F.octet_length(payload).alias("size"), F.sha1(payload).alias("digest")).where(F.col("size") >= LEAST)
    return seen.groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1").select("digest", "first", "n")


def write_archives(pages: DataFrame, work: Workspace) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) into monolithic archives; a row per archive.

    Of rows with equal payloads of LEAST bytes or more, those with the largest page_id are responses and the
    others revisit it. A null html is an empty payload; a null page_id counts as the smallest.
    """
    folder = work.path("monolithic")
    first = work.table(_revisits(pages), "revisits")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    if first.limit(FEW + 1).count() <= FEW:  # repeated payloads, 100 bytes each at most
        rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest")).join(F.broadcast(first), "digest", "left")
    else:
        rows = _joined(pages, first, payload)
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    made = pa.schema([("archive", pa.string()), ("n_records", pa.int64())])

    def write(batches):
        out = None
        for batch in batches:
            for page, url, data, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    name, out = create(folder, ".warc.gz")
                    press, n, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                out.write(press.compress(record("response" if to is None else "revisit", page, url, data, to)))
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE:
                    out.write(press.flush())
                    out.close()
                    out = None
                    yield as_batch(made, archive=[name], n_records=[n])
        if out is not None:
            out.write(press.flush())
            out.close()
            yield as_batch(made, archive=[name], n_records=[n])

    return work.table(rows.mapInArrow(write, "archive string, n_records long"), "archives")


def _joined(pages: DataFrame, first: DataFrame, payload) -> DataFrame:
    """With many repeated payloads: the frequent ones are broadcast, the others joined by digest; rows that need no join are spread."""
    limit = max(HOT, (first.agg(F.sum("n")).first()[0] or 0) // FEW) if FEW else HOT
    hot = F.broadcast(first.where(F.col("n") >= limit).select("digest", F.col("first").alias("often"), F.lit(True).alias("hot")))
    cold = first.where(F.col("n") < limit).select(F.col("digest").alias("key"), "first")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest")).join(hot, "digest", "left")
    spread = F.col("hot").isNotNull() | (F.octet_length("payload") < LEAST)
    rows = rows.withColumn("key", F.when(spread, F.monotonically_increasing_id().cast("string")).otherwise(F.col("digest")))
    return rows.join(cold, "key", "left").select("page_id", "url", "payload", F.coalesce("often", "first").alias("first"))


def normalise(archives: DataFrame, work: Workspace) -> DataFrame:
    """Rewrite each archive (in `monolithic`) as one gzip member per record; the offset index as a table.

    Beside each new archive lies <archive>.cdxj with the same index as lines of text.
    """
    source, folder = work.path("monolithic"), work.path("normal")
    schema = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("payload_digest", pa.string())])

    def rewrite(batches):
        for batch in batches:
            for old in batch.column("archive").to_pylist():
                name, out = create(folder, ".warc.gz")
                at, rows = 0, []
                with out:
                    for whole in records(inflated(f"{source}/{old}")):
                        press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = press.compress(whole) + press.flush()
                        out.write(member)
                        head = parse_head(whole)
                        rows.append((name, at, len(member), head["warc-type"], _id(head["warc-record-id"]), head["warc-target-uri"], head["warc-payload-digest"]))
                        at += len(member)
                beside, out = create(f"{folder}/index", f"-{name}.cdxj")
                with out:
                    out.write("".join(f"{r[5]} {json.dumps({'filename': name, 'offset': r[1], 'length': r[2], 'type': r[3], 'digest': r[6]})}\n" for r in rows).encode())
                if rows:
                    yield as_batch(schema, **{f.name: list(c) for f, c in zip(schema, zip(*rows, strict=True), strict=True)})

    dealt = archives.select("archive").repartition(partitions(work.spark), "archive")
    return work.table(dealt.mapInArrow(rewrite, INDEX), "index")


def read_records(index: DataFrame, work: Workspace) -> DataFrame:
    """Each indexed record, read by its offset alone: page_id, record_type, refers_to, digest, payload (null for a revisit).

    A payload that does not have the digest its record states fails the job.
    """
    folder = work.path("normal")
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches):
        files = Readers(folder)
        for batch in batches:
            for part in (batch.slice(a, 64) for a in range(0, batch.num_rows, 64)):
                rows = []
                for name, at, size in zip(*(part.column(c).to_pylist() for c in ("archive", "at", "size")), strict=True):
                    whole = zlib.decompress(files.read(name, at, size), 31)
                    head = parse_head(whole)
                    block = whole[whole.index(b"\r\n\r\n") + 4 :][: int(head["content-length"])]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    sha = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).digest() != sha:
                        raise ValueError(f"{name} at {at}: the payload is damaged")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    rows.append((_id(head["warc-record-id"]), head["warc-type"], _id(head.get("warc-refers-to")), length, sha.hex(), None if revisit else payload))
                yield as_batch(schema, **{f.name: list(c) for f, c in zip(schema, zip(*rows, strict=True), strict=True)})

    dealt = index.select("archive", "at", "size").repartition(partitions(work.spark), "archive", F.floor(F.col("at") / (4 << 20))).sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(read, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archived(pages: DataFrame) -> DataFrame:
    """Write pages as archives, normalise these, and read every record back through the offset index."""
    work = Workspace(pages.sparkSession, "warc")
    index = normalise(write_archives(pages, work), work)
    work.drop("monolithic")
    return read_records(index, work)
