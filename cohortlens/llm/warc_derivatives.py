"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

Responses come from a table of pages or from WARC files; each gives two records that
refer to it by its id and keep its uri, date, headers and digest.  Rows are independent:
there is no exchange.  Ids are derived from the source, so a repeated run gives the same
records.  Text conversion and record reading are Python over Arrow batches, the rest is
column expressions.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from email.message import Message
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .markup import BLOCKS, events
from .scratch import prepare, tidy

CRLF = "\r\n"
#: Date of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Bytes of blocks handed over at once, and read at once.
BATCH, CHUNK = 8 << 20, 1 << 20

# Elements whose content is no text, cells that a space divides, and breaks beside the block elements.
_HIDDEN = frozenset("script style noscript template".split())
_CELLS = frozenset("td th".split())
_BREAKS = (BLOCKS | frozenset("br caption head html legend option optgroup select title".split())) - _CELLS
_BLANKS = re.compile(r"[^\S\n]+")


def plain_text(html: str) -> str:
    """Text of a page: lines without blanks around them, none of them empty.

    Block elements and line breaks divide lines, cells are divided by a space, other tags
    join; white space is one space (line feeds stay inside ``pre``); all character
    references are decoded.  Comments, scripts, styles and templates are left out, to the
    end of the page where they aren't closed.
    """
    out, pre = [], 0
    for before, name, closing, _ in events(html, _HIDDEN):
        if before:
            text = unescape(before) if "&" in before else before
            out.append(text if pre else text.replace("\n", " "))
        if name == "pre":
            pre = max(0, pre + (-1 if closing else 1))
        if name in _BREAKS:
            out.append("\n")
        elif name in _CELLS:
            out.append(" ")
    lines = (_BLANKS.sub(" ", x).strip(" ") for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def text_column(source: DataFrame, html_col: str = "payload", out: str = "text") -> DataFrame:
    """The rows with the plain text of a column; batches are cut by bytes, so a long page is one of its own."""
    prepare(source.sparkSession)
    names = [c for c in source.columns if c != out]
    kinds = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names] + [f"`{out}` string"])
    at = names.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([None if x is None else plain_text(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*names, out])

    return source.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(tidy(run), kinds)


def record_id(*parts: Column) -> Column:
    """A name-based URN from the parts."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


#: Columns of a response: ``payload`` is text, ``payload_length`` and ``payload_digest`` are of its bytes as received.
RESPONSE = ("source_key", "source_id", "target_uri", "warc_date", "http_headers", "payload", "payload_length", "payload_digest")


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = NO_DATE) -> DataFrame:
    """Responses of a table of pages, which has no headers and dates of its own.

    Null html is an empty payload; a null url is an empty uri.
    """
    html, url = F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"))
    return pages.select(F.col(id_col).alias("source_key"), record_id(F.lit("response"), F.col(id_col), url).alias("source_id"), url.alias("target_uri"),
                        F.lit(date).alias("warc_date"), headers.alias("http_headers"), html.alias("payload"), F.octet_length(html).cast("long").alias("payload_length"), digest(html).alias("payload_digest"))


def http_parts(block: bytes) -> tuple[str, bytes, str]:
    """(header lines, payload as received, payload as text) of a response's block: chunks and compression are undone, the charset is applied."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        head, body = b"", block
    text = head.decode("utf-8", "replace")
    fields: dict[str, str] = {}
    for line in text.split(CRLF)[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    data = _unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
    how = fields.get("content-encoding", "").lower()
    if how in ("gzip", "x-gzip", "deflate"):
        try:
            data = zlib.decompress(data, 47)  # gzip or zlib by the head
        except zlib.error:
            pass  # sent as it is under a wrong name
    kind = Message()
    kind["content-type"] = fields.get("content-type", "")
    found = re.search(rb"<meta[^>]{0,200}charset=[\"']?([a-zA-Z0-9_-]+)", data[:2048])
    try:
        return text, body, data.decode(kind.get_content_charset() or (found[1].decode() if found else "utf-8"), "replace")
    except LookupError:
        return text, body, data.decode("utf-8", "replace")


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def responses_of(records: DataFrame) -> DataFrame:
    """Responses among WARC records (headers, block): their own ids, uris, dates, headers and digests.

    A record without a payload digest gets the SHA-256 of its payload; records of other
    types are left out.  source_key is the record's id.
    """
    prepare(records.sparkSession)
    names = list(RESPONSE)
    kinds = [pa.int64() if c == "payload_length" else pa.string() for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for fields, block in zip(batch.column("headers").to_pylist(), batch.column("block").to_pylist()):
                h = {k.lower(): v for k, v in fields or []}
                head, body, text = http_parts(block or b"")
                own = h.get("warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest()
                rows.append((h.get("warc-record-id", ""), h.get("warc-record-id", ""), h.get("warc-target-uri", ""), h.get("warc-date", NO_DATE), head, text, len(body), own))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)

    kept = records.where(F.exists(F.map_entries("headers"), lambda e: (F.lower(e["key"]) == "warc-type") & (e["value"] == "response"))).select("headers", "block")
    return kept.mapInArrow(tidy(run), ", ".join(f"{c} {'long' if c == 'payload_length' else 'string'}" for c in names))


def derivatives(source: DataFrame) -> DataFrame:
    """Two records for each response (columns as in ``RESPONSE``): ``metadata`` and ``conversion``.

    Both refer to the response by its id and keep its uri and date; the metadata block
    has the source's headers and digest, the conversion block the text.  Columns:
    source_key, record_type, record_id, refers_to, target_uri, warc_date, content_type,
    source_digest, block, block_length, block_digest.  A null payload has an empty text;
    pages of any length are converted whole, in linear time; repeated responses give
    repeated records; an empty table gives none; other columns are ignored.
    """
    found = text_column(source.select(*RESPONSE), "payload", "text")
    length = F.coalesce("payload_length", F.lit(0)).cast("string")
    about = F.concat(F.lit("source-digest: "), F.col("payload_digest"), F.lit(f"{CRLF}source-length: "), length,
                     F.when(F.col("http_headers") != "", F.concat(F.lit(f"{CRLF}source-header: "), F.replace(F.col("http_headers"), F.lit(CRLF), F.lit(f"{CRLF}source-header: ")))).otherwise(""), F.lit(CRLF))
    kinds = F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), about.alias("block")),
                    F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.coalesce("text", F.lit("")).alias("block")))
    rows = found.select("*", F.inline(kinds))
    return rows.select("source_key", "record_type", record_id(F.col("record_type"), F.col("source_id")).alias("record_id"), F.col("source_id").alias("refers_to"),
                       "target_uri", "warc_date", "content_type", F.col("payload_digest").alias("source_digest"), "block",
                       F.octet_length("block").cast("long").alias("block_length"), digest(F.col("block")).alias("block_digest"))


# ---- files --------------------------------------------------------------------------------------


def record_text(records: DataFrame) -> DataFrame:
    """``record``: each derivative as it stands in a file, with the two line ends after it."""
    fields = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"),
              ("WARC-Source-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type")]
    lines = [F.lit("WARC/1.1" + CRLF)] + [F.when(F.col(c) != "", F.concat(F.lit(name + ": "), F.col(c), F.lit(CRLF))).otherwise("") for name, c in fields]
    head = F.concat(*lines, F.lit("Content-Length: "), F.col("block_length").cast("string"), F.lit(CRLF + CRLF))
    return records.select(F.concat(head, F.col("block"), F.lit(CRLF * 2)).alias("record"))


def write_warc(records: DataFrame, path: str, per_file: int = 256 << 20) -> None:
    """WARC files of about ``per_file`` compressed bytes in a shared folder: one gzip member a record.

    ``path`` is a folder or URI that pyarrow can open on every executor.  A file is
    written under the name of its attempt and moved when it is whole, so a task that runs
    again replaces its files.
    """
    prepare(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(base, recursive=True)
        task, k, size, stream = TaskContext.get(), 0, 0, None
        name = lambda: f"{base}/part-{task.partitionId():05d}-{k:04d}.warc.gz"
        hidden = f"{base}/_writing-{task.taskAttemptId()}"

        def close() -> None:
            stream.close()
            store.move(hidden, name())

        for batch in batches:
            for record in batch.column("record"):
                member = gzip.compress(record.as_py().encode(), mtime=0)
                if stream is None or size and size + len(member) > per_file:
                    if stream is not None:
                        close()
                        k += 1
                    stream, size = store.open_output_stream(hidden, compression=None), 0
                stream.write(member)
                size += len(member)
        if stream is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([k + 1], pa.int64())], ["files"])

    record_text(records).mapInArrow(tidy(run), "files long").agg(F.sum("files")).collect()


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of gzip members one after the other, in pieces of about CHUNK bytes; what isn't compressed comes as it is."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + CHUNK] for i in range(0, len(data), CHUNK))
        return
    view, at = memoryview(data), 0
    member = zlib.decompressobj(31)
    while at < len(view):
        piece = member.decompress(view[at : at + CHUNK], CHUNK)
        at += len(view[at : at + CHUNK])
        while True:
            if piece:
                yield piece
            if member.unused_data or member.eof:
                at -= len(member.unused_data)
                member = zlib.decompressobj(31)
                break
            if not member.unconsumed_tail:
                break
            piece = member.decompress(member.unconsumed_tail, CHUNK)


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; holds one record and one piece at a time."""
    buffer = bytearray()

    def fill(least: int) -> bool:
        while len(buffer) < least:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        while (start := buffer.find(b"WARC/1.")) < 0:
            del buffer[: max(0, len(buffer) - 6)]
            if not fill(len(buffer) + 1):
                return
        del buffer[:start]
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not fill(len(buffer) + 1):
                return
        fields: dict[str, str] = {}
        for line in buffer[:end].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            fields[name.strip()] = value.strip()
        size = int(next((v for k, v in fields.items() if k.lower() == "content-length"), 0))
        fill(end + 4 + size)
        yield fields, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]


def read_warc(spark, path: str) -> DataFrame:
    """(headers map<string,string>, block binary) of all records of WARC files, plain or gzip.

    A task holds a file as it is stored (of 2 GB at most, Spark's bound of a cell); it
    is decompressed piece by piece, and records are handed on in batches of some MB.
    """
    prepare(spark)
    kind = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(f.items()) for f, _ in rows], kind), pa.array([b for _, b in rows], pa.binary())], ["headers", "block"])

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, block in parse_records(inflated(content.as_py())):
                    rows.append((fields, block))
                    size += len(block)
                    if size >= BATCH:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("content")
    return files.mapInArrow(tidy(run), "headers map<string,string>, block binary")
