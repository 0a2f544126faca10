"""Web archives: one gzip member per record, written by tasks and read as a stream.

A page is a ``response`` record, or a ``revisit`` where another page has the same payload; a revisit
keeps the HTTP head and the payload's digest and names the record that holds the payload.  The reader
goes through a file member by member with an incremental inflater, frames each block by its content
length and checks the digests, so it holds one piece of a record, however long files or records are.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epithet.llm.common import in_slices, shared_root, stage

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n"
ID_PREFIX = "urn:x-page:"

DATE = "2024-01-01T00:00:00Z"  # records carry no fetch time here, and equal input gives equal files
MIN_REVISIT = 1000  # shorter payloads are always written out
MAX_FILE = 1 << 30  # a file is closed once it has as many bytes
LEVEL = 6
PIECE = 1 << 16
MAX_HEAD = 1 << 20  # a header block beyond this is not a record


# --- records to bytes -------------------------------------------------------


def digest_field(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def digest_hex(field: str | None) -> str | None:
    """Lower-case hex of a digest field in base 32 or hex; null for other algorithms."""
    name, _, value = (field or "").partition(":")
    if name.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def record_name(value: str | None) -> str:
    return f"<{ID_PREFIX}{quote(value or '', safe='')}>"


def name_of(record_id: str | None) -> str | None:
    """What ``record_name`` was made from; an empty one is null."""
    if not record_id or not record_id.startswith("<" + ID_PREFIX):
        return None
    return unquote(record_id[len(ID_PREFIX) + 1 : -1]) or None


def _one_line(value: str) -> str:
    """Control characters and blanks percent-encoded, so that a field can't end its line."""
    return "".join(c if c > " " and c != "\x7f" else quote(c) for c in value)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = BREAK.join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"Content-Length: %d" % len(block)])
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    parts = (packer.compress(head + BREAK * 2), packer.compress(block), packer.compress(BREAK * 2), packer.flush())
    return b"".join(parts)


def page_record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """The record of a page.  A revisit's block is the HTTP head, which tells the payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_name(page)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", digest_field(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", digest_field(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", _one_line(url)))
    if revisit:
        fields += [("WARC-Refers-To", record_name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    return record(fields, block)


# --- bytes to records -------------------------------------------------------


class _Member:
    """One gzip member, inflated a piece at a time."""

    def __init__(self, source: "_Source"):
        self.source, self.inflater, self.out = source, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Inflate some more; false at the member's end."""
        if self.inflater.eof:
            return False
        data = self.inflater.unconsumed_tail or self.source.take()
        piece = self.inflater.decompress(data, PIECE)
        if not data and not piece and not self.inflater.eof:
            raise ValueError("the file ends within a record")
        self.out += piece
        if self.inflater.eof:
            self.source.held = self.inflater.unused_data
        return True

    def until(self, mark: bytes, limit: int) -> bytes:
        start = 0
        while (at := self.out.find(mark, start)) < 0:
            start = max(0, len(self.out) - len(mark) + 1)
            if len(self.out) > limit or not self.more():
                raise ValueError("no end of a header block")
        found = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return found

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.out and not self.more():
                raise ValueError("a block is shorter than its content length")
            piece = bytes(self.out[:size])
            del self.out[:size]
            size -= len(piece)
            if piece:
                yield piece

    def close(self) -> None:
        while self.more():
            if len(self.out) > 4:
                break
        if self.out != BREAK * 2:
            raise ValueError("a record does not end where its content length says")


class _Source:
    """Compressed bytes of a file; ``held`` was read but belongs to the next member."""

    def __init__(self, stream):
        self.stream, self.held, self.read = stream, b"", 0

    def take(self) -> bytes:
        if self.held:
            data, self.held = self.held, b""
            return data
        data = self.stream.read(PIECE)
        self.read += len(data)
        return data

    def members(self) -> Iterator[tuple[int, _Member]]:
        while True:
            if not self.held:
                self.held = self.take()
            if not self.held:
                return
            yield self.read - len(self.held), _Member(self)


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(stream, payloads: bool = False) -> Iterator[dict]:
    """The records of a stream in order; ``payloads`` keeps their payloads as well."""
    for offset, member in _Source(stream).members():
        version, *lines = member.until(BREAK * 2, MAX_HEAD).split(BREAK)
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at {offset}")
        head = _fields(lines)
        size, kind = int(head["content-length"]), head.get("warc-type")
        block, whole, length, kept = hashlib.sha1(), hashlib.sha1(), 0, []
        http: dict[str, str] = {}
        pending = b"" if head.get("content-type", "").startswith("application/http") else None
        for piece in member.pieces(size):
            block.update(piece)
            if pending is not None:  # still within the HTTP head
                pending += piece
                at = pending.find(BREAK * 2)
                if at < 0:
                    if len(pending) > MAX_HEAD:
                        raise ValueError("no end of an HTTP head")
                    continue
                http, piece, pending = _fields(pending[:at].split(BREAK)[1:]), pending[at + 4 :], None
            whole.update(piece)
            length += len(piece)
            if payloads:
                kept.append(piece)
        member.close()
        digest, revisit = digest_hex(head.get("warc-payload-digest")), kind == "revisit"
        claimed = digest_hex(head.get("warc-block-digest"))
        sound = claimed in (None, block.hexdigest()) and (revisit or digest in (None, whole.hexdigest()))
        yield {
            "offset": offset,
            "record_id": head.get("warc-record-id"),
            "record_type": kind,
            "target_uri": head.get("warc-target-uri"),
            "refers_to": head.get("warc-refers-to"),
            "payload_bytes": int(http.get("content-length", 0)) if revisit else length,
            "payload_digest": digest if revisit else whole.hexdigest(),
            "sound": sound,
            "payload": b"".join(kept) if payloads and not revisit else None,
        }


# --- jobs -------------------------------------------------------------------

MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORD = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("sound", pa.bool_()),
        ("payload", pa.binary()),
    ]
)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _payload() -> Column:
    return F.coalesce("html", F.lit("")).cast("binary")


def with_originals(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, refers_to): the page that holds an equal payload, or null.

    Of pages with equal payloads of ``least`` bytes or more the one with the largest id holds it.
    Only digests are aggregated; payloads that stand alone meet no one.  A payload of a third of all
    pages makes one wide key of the join, which adaptive execution splits; short payloads are spread
    by id.
    """
    rows = pages.select("page_id", "url", _payload().alias("payload"))
    long = F.octet_length("payload") >= least
    key = F.when(long, F.sha1("payload"))
    holders = (
        rows.select("page_id", key.alias("key"))
        .where("key is not null")
        .groupBy("key")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    spread = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    joined = rows.withColumn("key", F.coalesce(key, spread)).join(holders, "key", "left")
    own = F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select("page_id", "url", "payload", F.when(~own, F.col("holder")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = MIN_REVISIT) -> DataFrame:
    """Write the pages as archives in ``folder`` and return the manifest (path, records, bytes).

    A task writes files of its own name and lists them when they are closed; a lost or repeated task
    leaves files that no manifest names.  A null url is left out of the record, a null html is an
    empty payload, and a null page_id an empty record name.  Repeated rows of a page give repeated
    records, all responses if it is the page that holds the payload.  Columns other than page_id,
    url and html are ignored.
    """
    rows = with_originals(pages, least).select(
        F.col("page_id").cast("string").alias("page"), "url", "payload", F.col("refers_to").cast("string")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name = out = None
        n = size = 0

        def listed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]}, MANIFEST)

        for batch in in_slices(batches, 64):
            for page, url, payload, holder in zip(*(batch[c] for c in ("page", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{top}/{name.rsplit('/', 1)[1]}", compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
                    first = record(info, b"format: WARC File Format 1.1\r\n")
                    out.write(first)
                    n, size = 0, len(first)
                made = page_record(page.as_py(), url.as_py(), payload.as_py(), holder.as_py(), holder.is_valid)
                out.write(made)
                n, size = n + 1, size + len(made)
                if size >= MAX_FILE:
                    yield listed()
                    out = None
        if out is not None:
            yield listed()

    return stage(rows.mapInArrow(write, _ddl(MANIFEST)), "warc-manifest")


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the files named in ``path``, one task a file, in the order of the file.

    ``sound`` is false where a digest does not fit.  A file that is cut or damaged in its framing
    fails its task and so the read: no record is lost unseen.  Without files there are no rows.
    """
    paths = files.select("path")
    n = paths.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as stream:
                    rows, held = [], 0
                    for found in read_records(stream, payloads):
                        rows.append({"path": path, **found})
                        held += len(found["payload"] or b"")
                        if len(rows) == 1024 or held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)

    return paths.repartitionByRange(max(n, 1), "path").mapInArrow(read, _ddl(RECORD))


def pages_of(records: DataFrame, kind: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the page records.

    ``kind`` is the type of page ids.  A record whose digest does not fit is an error.
    """

    def page(c: str) -> Column:
        inner = F.regexp_extract(c, f"^<{ID_PREFIX}(.*)>$", 1)
        return F.nullif(F.url_decode(inner), F.lit("")).cast(kind)

    checked = F.when(F.col("sound"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("digest of "), "record_id", F.lit(" in "), "path"))
    )
    return records.where("record_type in ('response', 'revisit')").select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        checked.alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Every page written as a record and read back; see ``write_archives`` for nulls and repeats."""
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_root(spark)}/llm-warc-{uuid.uuid4().hex}"
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages_of(read_archives(write_archives(pages, folder)), kind)
