"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Writing needs no Python on the executors: a record is one string, and Spark's text writer, with the blank lines that end a
WARC record as its line separator, writes the files to any store that Spark can write to. A page whose payload occurs
elsewhere under a smaller id becomes a revisit record without payload. Pages whose digest certainly occurs once never
leave their task; only the others meet by digest, as narrow rows first.

Reading takes files of any size and kind from any store: Spark streams a file's bytes to one task, which keeps them in a
local temporary file and goes over that, with one record in memory at a time. Records are checked (version line, headers,
length, end mark, block digest). Where a check fails, the reader searches on for the next valid gzip member or version line,
goes on there, and reports the bytes that it passed over as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import mmap
import re
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, sieve_join, text_or_empty
from graphloom.shipping import shipped

CRLF = "\r\n"
END = b"\r\n\r\n"
VERSION = b"WARC/1.1\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Files and gzip members above this size are looked at on disk, smaller ones in memory.
MEMORY_BYTES = 16 << 20
#: Of a file on disk, so many bytes at most stay mapped behind the reader.
MAPPED_BYTES = 64 << 20


# --- writing -------------------------------------------------------------------------------------------------------


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base32: 160 bits are 8 groups of 5 hex digits, and each group is 4 letters."""
    digest = F.sha1(data)
    letters = []
    for g in range(8):
        group = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(group, s).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _uri(url: Column) -> Column:
    """A target URI in one line: white space and control characters go, null is the empty page."""
    return F.coalesce(F.nullif(F.regexp_replace(url.cast("string"), r"[\s\x00-\x1f\x7f]+", ""), F.lit("")), F.lit("about:blank"))


def record_name(page_id: Column) -> Column:
    """An id as it stands in a record's name: percent-encoded, so that any text can be told again; ``null`` is no id, and nothing else is."""
    text = F.url_encode(page_id.cast("string"))
    return F.when(page_id.isNull(), "null").when(text == "null", "%6Eull").otherwise(text)


def id_of(name: Column) -> Column:
    """The id of a record's name, as text."""
    return F.when(name != "null", F.url_decode(name))


def _page_uri(url: Column) -> Column:
    """A header line that keeps a url which isn't its target URI as it was; otherwise nothing."""
    text = url.cast("string")
    kept = F.when(text.isNull(), "null").otherwise(F.concat(F.lit("="), F.url_encode(text)))
    return F.when(text == _uri(url), "").otherwise(F.concat(F.lit(f"{CRLF}X-Page-URI: "), kept))


def _record(kind: str, page_id: Column, url: Column, digest: Column, payload: Column, refers_to: Column | None) -> Column:
    size = F.octet_length(payload)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, payload) if kind == "response" else http
    lines = [
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <urn:x-page:"), record_name(page_id),
        F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), _uri(url), _page_uri(url),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), digest, F.lit(f"{CRLF}WARC-Block-Digest: sha1:"), base32_sha1(block.cast("binary")),
    ]
    if refers_to is not None:
        lines += [F.lit(f"{CRLF}WARC-Refers-To: <urn:x-page:"), record_name(refers_to), F.lit(f">{CRLF}WARC-Profile: {PROFILE}")]
    lines += [F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block]
    return F.concat(*lines)


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0) -> DataFrame:
    """One column ``value``: the text of each page's record, without the end mark.

    Null html is an empty payload, null urls become ``about:blank``. Of equal payloads of at least ``min_payload`` bytes the
    page with the smallest id is the response and the others revisit it; repeated rows of that page are responses too. Pages
    without an id never revisit and are never revisited.
    """
    html = text_or_empty(html_col)
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), html.alias("__html"), base32_sha1(html.cast("binary")).alias("__digest"))
    narrow = rows.filter((F.octet_length("__html") >= min_payload) & F.col("__id").isNotNull())
    copies = narrow.groupBy("__digest").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    copies = cut(copies.filter("__n > 1").select("__digest", "__first"))
    alone = sieve_join(rows, copies, "__digest", anti=True)
    # Those that may have copies: looked up exactly. By merge, as only then are large partitions split.
    looked = sieve_join(rows, copies, "__digest").join(copies.hint("merge"), "__digest", "left")
    revisit = (F.col("__id") != F.col("__first")) & (F.octet_length("__html") >= min_payload)
    make = lambda kind, first=None: _record(kind, F.col("__id"), F.col("__url"), F.col("__digest"), F.col("__html"), first)
    joined = looked.select(F.when(F.coalesce(revisit, F.lit(False)), make("revisit", F.col("__first"))).otherwise(make("response")).alias("value"))
    return alone.select(make("response").alias("value")).unionByName(joined)


def write_warc(pages: DataFrame, path: str, mode: str = "errorifexists", **columns) -> None:
    """Write the pages' records as uncompressed WARC files into the folder ``path`` of any store that Spark writes to."""
    warc_records(pages, **columns).write.mode(mode).option("lineSep", END.decode()).option("maxRecordsPerFile", 20_000).text(path)


def record_bytes(kind: str, uri: str, block: bytes, record_id: str, headers: dict[str, str] | None = None, compress: bool = False) -> bytes:
    """One record as bytes, for small local archives; ``compress`` makes it a gzip member."""
    own = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Block-Digest": f"sha1:{sha1_of(block)}"}
    own |= (headers or {}) | {"Content-Length": str(len(block))}
    data = VERSION + "".join(f"{k}: {v}{CRLF}" for k, v in own.items()).encode() + b"\r\n" + block + END
    return gzip.compress(data, mtime=0) if compress else data


def sha1_of(data: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


# --- reading -------------------------------------------------------------------------------------------------------


@dataclass
class Record:
    """A valid record: where it stands in the file (for gzip: its member), its headers and its block."""

    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """The HTTP headers (lower-case names) and the payload of a block with them; else no headers and the block."""
        if not self.block.startswith(b"HTTP/"):
            return {}, self.block
        head, _, body = self.block.partition(END)
        lines = head.decode("utf-8", "replace").split(CRLF)[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


@dataclass
class Gap:
    start: int
    end: int
    reason: str


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)

    def gap(self, start: int, end: int, reason: str) -> None:
        if self.gaps and self.gaps[-1].end == start:
            self.gaps[-1].end = end
        elif end > start:
            self.gaps.append(Gap(start, end, reason))


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_NEXT = re.compile(rb"\nWARC/1\.[01]\r\n")
#: Most headers end within so many bytes; only longer ones are looked for up to the next version line.
_MOST_HEADERS = 1 << 16


def _parse(data: bytes | mmap.mmap, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """The record that begins at ``at``: headers, block and end; or what is wrong with it."""
    m = _VERSION.match(data, at)
    if not m:
        return "no version line"
    stop = data.find(END, m.end() - 2, at + _MOST_HEADERS)
    if stop < 0:
        following = _NEXT.search(data, m.end())
        stop = data.find(END, m.end() - 2, following.start() + 1 if following else len(data))
    if stop < 0:
        return "headers without end"
    headers: dict[str, str] = {}
    last = ""
    for line in data[m.end() : stop].decode("utf-8", "replace").split(CRLF):
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            return "broken header line"
        last = name.strip().lower()
        headers[last] = value.strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "no length"
    begin, end = stop + 4, stop + 4 + int(length)
    if end + 4 > len(data):
        return "cut off"
    if data[end : end + 4] != END:
        return "no end mark after the block"
    block = data[begin:end]
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha1" and digest.upper() != sha1_of(block):
        return "block digest differs"
    return headers, block, end + 4


def _scan_plain(data: bytes | mmap.mmap, at: int = 0) -> Iterator[Record | Gap]:
    while at < len(data):
        got = _parse(data, at)
        if not isinstance(got, str):
            headers, block, end = got
            yield Record(at, end, headers, block)
            at = end
            continue
        # A version line inside a damaged record's payload is tried too; it counts only if a whole valid record follows.
        m = _VERSION.search(data, at + 1)
        until = m.start() if m else len(data)
        yield Gap(at, until, got)
        at = until


def _member(data: bytes | mmap.mmap, at: int) -> tuple[bytes | mmap.mmap, int] | None:
    """The content of the gzip member that begins at ``at``, and where it ends."""
    unzip, plain, pos = zlib.decompressobj(31), _Spool(), at
    try:
        while not unzip.eof and pos < len(data):
            piece = data[pos : pos + (1 << 16)]
            plain.write(unzip.decompress(piece))
            pos += len(piece)
    except zlib.error:
        return None
    return (plain.view(), pos - len(unzip.unused_data)) if unzip.eof else None


def _scan(data: bytes | mmap.mmap, at: int = 0) -> Iterator[Record | Gap]:
    """Valid records and gaps of an archive in order, beginning at ``at``; neighbouring gaps aren't joined."""
    first = data.find(_MEMBER, at)
    if first < 0 or (first >= at + 1024 and _VERSION.search(data, at, at + 1024)):
        yield from _scan_plain(data, at)
        return
    while at < len(data):
        got = _member(data, at) if data[at : at + 3] == _MEMBER else None
        if got is not None:
            plain, end = got
            inside = None
            for r in _scan_plain(plain):
                if isinstance(r, Gap):
                    inside = inside or r.reason
                else:
                    yield Record(at, end, r.headers, r.block)
            if inside:
                yield Gap(at, end, f"inside the member: {inside}")
            at = end
            continue
        if (plain_got := _parse(data, at)) and not isinstance(plain_got, str):  # a plain record between members
            headers, block, end = plain_got
            yield Record(at, end, headers, block)
            at = end
            continue
        mark = data.find(_MEMBER, at + 1)
        until = mark if mark > 0 else len(data)
        line = _VERSION.search(data, at + 1, until)
        until = line.start() if line else until
        yield Gap(at, until, "no valid member")
        at = until


def _collect(found: Iterator[Record | Gap]) -> Salvage:
    out = Salvage()
    for r in found:
        if isinstance(r, Gap):
            out.gap(r.start, r.end, r.reason)
        else:
            out.records.append(r)
    return out


def salvage_plain(data: bytes) -> Salvage:
    """All valid records of an uncompressed archive, and the gaps between them."""
    return _collect(_scan_plain(data))


def salvage(data: bytes) -> Salvage:
    """All valid records of an archive, plain or of gzip members (each with a record or more), and the quarantined gaps."""
    return _collect(_scan(data))


class _Spool:
    """Bytes that are written once and then looked at: in memory, or from ``MEMORY_BYTES`` on in a temporary file."""

    def __init__(self):
        self.file, self.size = tempfile.SpooledTemporaryFile(max_size=MEMORY_BYTES), 0

    def write(self, data: bytes) -> None:
        self.size += len(data)
        self.file.write(data)

    def view(self, size: int | None = None) -> bytes | mmap.mmap:
        """The first ``size`` bytes."""
        size = self.size if size is None else size
        self.file.seek(0)
        if self.size <= MEMORY_BYTES:
            return self.file.read(size)
        self.file.flush()
        return mmap.mmap(self.file.fileno(), size, access=mmap.ACCESS_READ)


SCHEMA = "path string, kind string, start long, end long, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, reason string, page_uri string"


_BOM = b"\xef\xbb\xbf"
_PASS = "org.apache.hadoop.io.compress.PassthroughCodec"
#: Spark's jars have Hadoop's option under a name of their own.
_PASS_OPTIONS = ("io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension")


def _lines(spark: SparkSession, path: str, names: list[str]) -> list[DataFrame]:
    """The lines (between line feeds) of all files in ``path`` as they are on disk: file, its size, line.

    A codec that changes nothing is set for each ending of the files' names. So compressed files aren't unpacked, and as no
    codec can be entered midway, a file isn't split: its lines come in order in one task. Files without an ending may be
    split; only their lines go through a shuffle, to one task a file.
    """
    columns = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line")
    bare = lambda n: n.rpartition("/")[2]
    out = []
    for ending in sorted({"." + bare(n).rpartition(".")[2] for n in names if "." in bare(n)}):
        options = dict.fromkeys(_PASS_OPTIONS, ending) | {"io.compression.codecs": _PASS, "lineSep": "\n", "pathGlobFilter": "*" + re.sub(r"([\\*?\[\]{}])", r"\\\1", ending)}
        out.append(spark.read.options(**options).text(path).select(*columns))
    if plain := [n for n in names if "." not in bare(n)]:
        rows = spark.read.option("lineSep", "\n").text(plain).select(*columns, F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
        out.append(rows.repartition("file").sortWithinPartitions("file", "at", "n").select("file", "size", "line"))
    return out


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes | mmap.mmap, int]]:
    """Each file of rows from ``_lines``: its number, a view of its bytes, and where in the view it begins."""
    spool, file, size = None, 0, 0

    def done() -> tuple[int, bytes | mmap.mmap, int]:
        # Spark's reader drops a byte order mark, so one is put in front in any case. The last line may have no line feed.
        for begin in (len(_BOM), 0):
            if spool.size - begin - size in (0, 1):
                return file, spool.view(begin + size), begin
        raise RuntimeError(f"read {spool.size - len(_BOM)} bytes of a file of {size}")

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if spool is None or ids[a] != file:
                if spool is not None:
                    yield done()
                spool, file, size = _Spool(), int(ids[a]), batch.column(1)[a].as_py()
                spool.write(_BOM)
            spool.write(b"\n".join([*batch.column(2).slice(a, b - a).to_pylist(), b""]))
    if spool is not None:
        yield done()


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives in ``path``, of any size.

    ``kind`` is the record's type, or ``gap`` for quarantined bytes (then ``start``, ``end`` and ``reason`` tell which and
    why). ``record_id`` and ``refers_to`` are names: ``id_of`` tells the pages' ids again, whatever is in them. ``page_uri`` is the url as it was. Of a revisit, digest and length are those of the payload that it stands for, from its headers; a response whose
    payload contradicts its payload digest is a gap. An empty file has no rows. ``payloads=False`` leaves the payload column
    null.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("_metadata.file_path").alias("file")).collect()
    names = {r.file: r.path for r in listed}
    if len(names) < len(listed):
        raise RuntimeError("two archives have the same hash of their paths")
    if not names:
        return spark.createDataFrame([], SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if k == "long" else pa.binary() if k == "binary" else pa.string()) for n, k in (x.split() for x in SCHEMA.split(", "))])
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for file, data, begin in _files(batches):
            gap, freed = None, 0
            for r in _scan(data, begin):
                if isinstance(r, Gap):
                    if gap is not None and gap.end == r.start:
                        gap.end = r.end
                        continue
                    new = gap, None
                    gap = r
                else:
                    new = gap, r
                    gap = None
                for x in new:
                    if x is not None:
                        rows.append(_row(names[file], x, payloads, begin))
                        held += len(rows[-1][9] or b"")
                if len(rows) >= 2000 or held >= MEMORY_BYTES:
                    yield batch()
                    rows, held = [], 0
                if isinstance(data, mmap.mmap) and r.end - freed > MAPPED_BYTES and hasattr(mmap, "MADV_DONTNEED"):
                    freed = r.end // mmap.PAGESIZE * mmap.PAGESIZE
                    data.madvise(mmap.MADV_DONTNEED, 0, freed)
            if gap is not None:
                rows.append(_row(names[file], gap, payloads, begin))
        if rows:
            yield batch()

    parts = [shipped(lines).mapInArrow(read, SCHEMA) for lines in _lines(spark, path, list(names.values()))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _row(name: str, r: Record | Gap, payloads: bool, begin: int = 0) -> tuple:
    start, end = r.start - begin, r.end - begin
    if isinstance(r, Gap):
        return (name, "gap", start, end, None, None, None, None, None, None, r.reason, None)
    h = r.headers
    http, body = r.http()
    revisit = h.get("warc-type") == "revisit"
    claimed = h.get("warc-payload-digest", "").partition(":")[2].upper()
    digest = claimed if revisit else sha1_of(body)
    if claimed and claimed != digest:
        return (name, "gap", start, end, None, None, None, None, None, None, "payload digest differs", None)
    size = http.get("content-length", "") if revisit else str(len(body))
    bare = lambda x: x.strip("<>").removeprefix("urn:x-page:") if x is not None else None
    return (name, h.get("warc-type", ""), start, end, bare(h.get("warc-record-id")), h.get("warc-target-uri"), bare(h.get("warc-refers-to")), digest, int(size) if size.isdigit() else None, body if payloads and not revisit else None, None, _url_of(h))


def _url_of(headers: dict[str, str]) -> str | None:
    """The url that a page had, where it isn't the target URI."""
    kept = headers.get("x-page-uri", "")
    return unquote_plus(kept[1:]) if kept.startswith("=") else None if kept == "null" else headers.get("warc-target-uri")
