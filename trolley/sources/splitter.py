"""Records of XML files of any size, container and character set, one by one, with the fields that their file states once.

A file is read as a stream of byte chunks by Spark's own reader, so every store that Spark reads will do, and what a task holds is
a chunk, a record and the decoder's state, however large the file is. Gzip, zip and plain files are told by their first bytes.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators.shared import ship

#: The byte at which Spark's reader cuts a file into chunks; it is put back behind each.
CUT = b">"
#: Characters without a markup's end after which a file is taken for damaged, and records handed on at a time.
LONGEST, AT_A_TIME = 1 << 26, 1000
_TOKEN = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![A-Za-z](?:[^>\[]|\[.*?\])*>|<(/?)([^\s/>!?]+)(?:[^>"']|"[^"]*"|'[^']*')*?(/?)>""", re.DOTALL)
_ENTITY = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_ROW = "path string, fields map<string,string>, record string"


def unzipped(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a zip's members, one after another, from the local headers alone: no seek to the directory at its end."""
    held, more = b"", iter(parts)

    def need(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            part = next(more, None)
            if part is None:
                return False
            held += part
        return True

    while need(30) and held[:4] == b"PK\x03\x04":
        flags, method, _, _, _, size, _, name, extra = struct.unpack("<HHHHIIIHH", held[6:30])
        need(30 + name + extra)
        held = held[30 + name + extra :]
        if method == 8:
            press = zlib.decompressobj(-15)
            while not press.eof:
                if not held and not need(1):
                    raise ValueError("a zip member ends early")
                yield press.decompress(held)
                held = press.unused_data
        elif method == 0 and not flags & 8:
            while size:
                if not need(1):
                    raise ValueError("a zip member ends early")
                yield held[:size]
                size, held = size - min(size, len(held)), held[size:]
        else:
            raise ValueError(f"zip method {method} with flags {flags} can't be read as a stream")
        if flags & 8:  # sizes behind the data, with or without a mark
            need(16)
            held = held[16:] if held[:4] == b"PK\x07\x08" else held[12:]


def inflated(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members; what follows the last one is none."""
    press = zlib.decompressobj(31)
    for part in parts:
        while part:
            if press.eof:
                if part[:1] != b"\x1f":
                    return
                press = zlib.decompressobj(31)
            yield press.decompress(part)
            part = press.unused_data


def opened(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes that a file holds, whatever its container."""
    first = b""
    for part in parts:
        first += part
        if len(first) >= 4:
            break

    def whole() -> Iterator[bytes]:
        yield first
        yield from parts

    return unzipped(whole()) if first[:4] == b"PK\x03\x04" else inflated(whole()) if first[:2] == b"\x1f\x8b" else whole()


def _plain(text: str) -> str:
    return re.sub(r"&(#x[0-9a-fA-F]+|#[0-9]+|\w+);", lambda m: chr(int(m[1][2:], 16)) if m[1][:2] == "#x" else chr(int(m[1][1:])) if m[1][0] == "#" else _ENTITY.get(m[1], m[0]), text)


def records(parts: Iterator[bytes], tag: str, charset: str, wanted: frozenset[str]) -> Iterator[tuple[dict[str, str], str]]:
    """Each element `tag` as text, with the wanted fields that stood outside of records before it.

    Tags in comments and CDATA sections are no tags; an element of the same name inside a record belongs to it.
    """
    decode = codecs.getincrementaldecoder(charset)("replace").decode
    text, at, start, depth, leaf, leaf_at, fields = "", 0, -1, 0, None, 0, {}
    for part in opened(parts):
        text += decode(part)
        while True:
            token = _TOKEN.search(text, at)
            if token is None:
                break
            # a comment or section that is not closed yet may look like a tag, or end in one
            if text.startswith(("<!--", "<![CDATA["), open_at := text.find("<", at)) and token.start() > open_at:
                break
            at = token.end()
            name = token[2]
            if name is None:
                continue
            name, closing, alone = name.rpartition(":")[2], bool(token[1]), bool(token[3])
            if start >= 0:
                if name == tag and not alone:
                    depth += -1 if closing else 1
                    if not depth:
                        yield dict(fields), text[start:at]
                        start, leaf = -1, None
            elif name == tag and not closing:
                if alone:
                    yield dict(fields), token[0]
                else:
                    start, depth = token.start(), 1
            elif closing:
                if name == leaf:
                    value = text[leaf_at : token.start()]
                    inner = re.fullmatch(r"\s*<!\[CDATA\[(.*?)\]\]>\s*", value, re.DOTALL)
                    fields[name] = inner[1] if inner else _plain(value).strip()
                leaf = None
            else:
                leaf, leaf_at = (name, at) if name in wanted and not alone else (None, 0)
        keep = start if start >= 0 else leaf_at if leaf else at
        if keep:
            text, at, start, leaf_at = text[keep:], at - keep, start - keep if start >= 0 else -1, max(0, leaf_at - keep)
        if len(text) - at > LONGEST:
            raise ValueError("no end of a markup in sight: another character set, or no XML")


def unsplit(spark: SparkSession) -> SparkSession:
    """A session of the same context that gives each file to one task."""
    own = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(name, str(1 << 50))
    return own


def split(spark: SparkSession, path: str, tag: str, charset: str, wanted: list[str]) -> DataFrame:
    """path, fields, record: the records of the files at path, with the wanted fields of their file. A file is one task's work."""
    chunks = unsplit(ship(spark)).read.option("lineSep", CUT.decode()).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("chunk"))
    names = frozenset(wanted)
    schema = pa.schema([("path", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("record", pa.string())])

    def run(batches):
        rows = ((p, c) for b in batches for p, c in zip(b.column("path").to_pylist(), b.column("chunk").to_pylist(), strict=True))
        ahead = next(rows, None)
        out: list[tuple] = []

        def one(path: str) -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[0] == path:
                yield ahead[1] + CUT
                ahead = next(rows, None)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        while ahead is not None:
            path = ahead[0]
            for fields, record in records(one(path), tag, charset, names):
                out.append((path, list(fields.items()), record))
                if len(out) >= AT_A_TIME:
                    yield batch()
                    out.clear()
            while ahead is not None and ahead[0] == path:  # what lies behind a container's end
                ahead = next(rows, None)
        if out:
            yield batch()

    return chunks.mapInArrow(run, _ROW)
