"""WARC archives: writing segmented records, and reassembling them.

Writing: each page becomes a response record whose block is an HTTP message in chunked transfer
coding, or, where another page has the same payload, a revisit record. A block above a segment size
is cut: the first segment stays in the response record and the rest goes to continuation records that
name the response as their origin. Spark's text writer puts the records into compressed files.

Reading: files are split wherever a version line may begin, so a file streams through a task whatever
its size, and a record goes on over what its Content-Length covers, version lines in it too. Header names
may be in any case. Segments of one origin, and only those, are shuffled, ordered by number, held
against the total length and then decoded. Revisits get the payload's figures from the response that they name,
or else that has their payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections import deque
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.tables import stored

VERSION = "WARC/1.1\r\n"
#: What files are split at; the version's last digit and line end follow.
STEM = "WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters of a block in one segment, and bytes in one chunk of the transfer coding.
SEGMENT, CHUNK = 16_384, 4_096
EMPTY_TYPE = "none"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest32(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_chunked(payload: str, size: int = CHUNK) -> str:
    """``payload`` in chunked transfer coding, chunks of ``size`` characters."""
    parts = [payload[at : at + size] for at in range(0, len(payload), size)]
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def decode_chunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, or None if its framing is broken or ends early."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(piece)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP message: decoded if its transfer coding is chunked, else as it is."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None
    lines = [x.partition(b":") for x in head.lower().split(b"\r\n")[1:]]
    chunked = any(k.strip() == b"transfer-encoding" and b"chunked" in v for k, _, v in lines)
    return decode_chunked(body) if chunked else body


def _record(fields: dict[str, object], block: str) -> str:
    """A record; the text writer's line end is the last of the two that close it."""
    fields = fields | {"Content-Length": len(block.encode())}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"\r\n{block}\r\n"


def _clean(value: str | None) -> str:
    return "".join(c if c.isprintable() else "%20" for c in value or "about:blank")


def _records_of(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, segment: int, date: str) -> Iterator[str]:
    payload = html or ""
    name = f"<urn:page:{'' if page_id is None else page_id}:{uuid.uuid4()}>"  # repeated or null ids still have records of their own
    common = {"WARC-Record-ID": name, "WARC-Date": date, "WARC-Target-URI": _clean(url), "WARC-Payload-Digest": f"sha1:{digest32(payload.encode())}"}
    if refers_to is not None:
        yield _record({"WARC-Type": "revisit"} | common | {"WARC-Profile": PROFILE}, "")
        return
    common |= {"Content-Type": "application/http; msgtype=response"}
    block = HEAD.decode() + encode_chunked(payload)
    if len(block) <= segment:
        yield _record({"WARC-Type": "response"} | common, block)
        return
    pieces = [block[at : at + segment] for at in range(0, len(block), segment)]
    yield _record({"WARC-Type": "response"} | common | {"WARC-Segment-Number": 1}, pieces[0])
    total = len(block.encode())
    for n, piece in enumerate(pieces[1:], 2):
        own = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Target-URI": common["WARC-Target-URI"]}
        last = {"WARC-Segment-Total-Length": total} if n == len(pieces) else {}
        yield _record(own | {"WARC-Segment-Origin-ID": name, "WARC-Segment-Number": n} | last, piece)


def plan_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: the largest page_id of those with this payload, null if its own.

    Payloads of under ``least`` bytes refer to nothing, nor do pages with a null id.
    """
    text = F.coalesce("html", F.lit(""))
    keys = pages.select("page_id", F.sha2(text.cast("binary"), 256).alias("_sha"), F.octet_length(text).alias("_n"))
    latest = keys.where(F.col("_n") >= least).groupBy("_sha").agg(F.max("page_id").alias("_latest"), F.count(F.lit(1)).alias("_copies"))
    # most payloads are single: only pages of shared ones are looked up
    shared = keys.join(latest.where("_copies > 1"), "_sha").where("page_id < _latest").select("page_id", "_sha", "_latest").distinct()
    shared = shared.withColumnsRenamed({"page_id": "_page", "_sha": "_key"})
    on = (F.col("page_id") == F.col("_page")) & (F.sha2(text.cast("binary"), 256) == F.col("_key"))
    return pages.join(shared, on, "left").drop("_page", "_key").withColumnRenamed("_latest", "refers_to")


def write_warc(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, dated: datetime | None = None) -> None:
    """Writes ``pages`` (page_id, url, html) as gzip-compressed archives under ``path``, one gzip member each.

    A null payload is empty, a null URL is ``about:blank``; other columns are left out. Each row is a record of its
    own, repeated ones too. A very long payload goes into many segments. Records carry the date ``dated``, by default now.
    """
    date = (dated or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    planned = plan_revisits(pages.select("page_id", "url", "html"), least)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[str] = []
            size = 0
            columns = [b.column(k) for k in ("page_id", "url", "html", "refers_to")]
            for i in range(b.num_rows):
                for record in _records_of(*(c[i].as_py() for c in columns), segment=segment, date=date):
                    out.append(record)
                    size += len(record)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    planned.mapInArrow(records, "value string").write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


_NAMED = ["record_id", "record_type", "refers_to_id", "url", "digest"]
_FIELDS = {
    "record_id": pa.string(), "record_type": pa.string(), "refers_to_id": pa.string(), "url": pa.string(), "digest": pa.string(), "origin": pa.string(), "segment": pa.int64(), "total": pa.int64(),
    "sound": pa.bool_(), "block": pa.binary(), "complete": pa.bool_(), "bytes": pa.int64(), "found": pa.string(), "payload": pa.binary(),
}
_DDL = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
_PARTS = [*_NAMED, "origin", "segment", "total", "sound", "block"]
_WHOLE = [*_NAMED, "complete", "bytes", "found", "payload"]


def _schema(names: list[str]) -> tuple[pa.Schema, str]:
    return pa.schema([(k, _FIELDS[k]) for k in names]), ", ".join(f"{k} {_DDL[_FIELDS[k]]}" for k in names)


#: Bytes of records that a task turns into one batch.
SLICE = 4_000_000


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _number(fields: dict[str, str], key: str) -> int | None:
    return int(fields[key]) if fields.get(key, "").isascii() and fields.get(key, "").isdigit() else None


def _parts(fields: dict[str, str], rest: bytes, length: int | None) -> dict:
    """A record's fields and block; ``sound`` if that is as long as declared. A first segment's origin is itself."""
    segment = _number(fields, "warc-segment-number")
    return {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type", EMPTY_TYPE), "refers_to_id": fields.get("warc-refers-to"),
        "url": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "origin": fields.get("warc-segment-origin-id") or (fields.get("warc-record-id") if segment is not None else None),
        "segment": segment, "total": _number(fields, "warc-segment-total-length"),
        "sound": length is not None and len(rest) >= length, "block": rest[:length] if length is not None else rest,
    }


def _records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[dict]:
    """Records from pieces (file, text after a stem), those of one file in order.

    A record takes as many pieces as its Content-Length covers. If its end isn't where it should be
    then, or the file ends before, the first piece alone is a damaged record and reading goes on after it.
    """
    held: deque[bytes] = deque()
    need = None  # length of the record that opens, if its head has been read
    fields: dict[str, str] = {}
    size = 0
    stem = STEM.encode()

    def opened(last: bool) -> Iterator[dict]:
        nonlocal need, fields, size
        while held:
            whole = None
            if held[0][:3] not in (b"0\r\n", b"1\r\n"):  # not a version line
                held.popleft()
                need, size = None, sum(map(len, held)) + len(stem) * len(held)
                continue
            if need is None:
                whole = held[0] if len(held) == 1 else stem.join(held)
                end = whole.find(b"\r\n\r\n")
                if end >= 0:
                    fields = _fields(whole[:end])
                    need = end + 4 + (_number(fields, "content-length") or 0)
            if need is not None and size - len(stem) >= need:
                whole = stem.join(held) if whole is None else whole
                if len(held) > 1 and whole[need : need + 4] not in (b"\r\n\r\n", b"\r\n", b""):
                    whole = held[0]
                yield from cut(whole)
                if whole is held[0] or len(held) == 1:
                    held.popleft()
                else:
                    held.clear()
            elif last:
                yield from cut(held.popleft())
            else:
                return
            need, size = None, sum(map(len, held)) + len(stem) * len(held)

    def cut(whole: bytes) -> Iterator[dict]:
        _, mark, rest = whole.partition(b"\r\n\r\n")
        if mark:
            yield _parts(fields, rest, _number(fields, "content-length"))

    of = None
    for file, piece in pieces:
        if file != of:
            yield from opened(True)
            of = file
        held.append(piece)
        size += len(piece) + len(stem)
        yield from opened(False)
    yield from opened(True)


def _whole(record: dict, keep: bool) -> dict:
    """A record's figures: its payload's size and digest, and whether all is as declared."""
    payload = payload_of(record["block"]) if record["record_type"] == "response" and record["sound"] else None
    found = None if payload is None else digest32(payload)
    sound = record["sound"] and record["record_type"] != "continuation"
    complete = sound and (record["record_type"] != "response" or (payload is not None and record["digest"] in (None, found)))
    return {k: record[k] for k in _NAMED} | {"complete": complete, "bytes": None if payload is None else len(payload), "found": found, "payload": payload if keep else None}


def _in_slices(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row, n in rows:
        out.append(row)
        size += n
        if size > SLICE or len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record: of one in several segments each with its ``block``, of others the payload's figures.

    Compressed files are read by one task each. Files that aren't may be split among tasks, which can break a record
    that holds a version line within; it is then given as incomplete.
    """
    schema, ddl = _schema([*_PARTS, "complete", "bytes", "found", "payload"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[dict, int]]:
            pieces = ((f, v.as_py()) for b in batches for f, v in zip(b.column("file").to_pylist(), b.column("value"), strict=True))
            for record in _records(pieces):
                n = len(record["block"])
                yield (record, n) if record["origin"] is not None else (record | _whole(record, payloads) | {"block": None}, n)

        yield from _in_slices(rows(), schema)

    pieces = spark.read.option("lineSep", STEM).text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(parse, ddl)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment of the records that the archives hold in several."""
    return read_records(spark, path, False).where("origin is not null").select(*_PARTS)


def reassemble(segments: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record that was cut: the segments of one origin in order, checked and decoded.

    ``complete`` is false, and the payload null, if a segment is missing or doubled, a length
    differs from what was declared, or the transfer coding is broken. Segments without a first
    one make a row of type ``continuation`` that isn't complete.
    """
    cut = segments.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"),
        *[F.min_by(c, "segment").alias(c) for c in _NAMED[1:]], F.max("total").alias("total"), F.bool_and("sound").alias("sound"),
    )
    numbers = F.col("segments")["segment"]
    joined = cut.withColumn("block", F.array_join(F.col("segments")["block"].cast("array<string>"), "").cast("binary")).withColumnRenamed("origin", "record_id")
    in_order = numbers == F.sequence(F.lit(1).cast("long"), F.size(numbers).cast("long"))
    as_long = F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))
    joined = joined.select(*_NAMED, (F.col("sound") & in_order & as_long).alias("sound"), "block")

    schema, ddl = _schema(_WHOLE)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[dict, int]]:
            for b in batches:
                for i in range(b.num_rows):
                    got = {k: b.column(k)[i].as_py() for k in (*_NAMED, "sound", "block")}
                    yield _whole(got, payloads), len(got["block"])

        yield from _in_slices(rows(), schema)

    return joined.mapInArrow(decode, ddl)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The archives' responses and revisits as pages, read once and stored.

    ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, complete, payload``; a
    revisit has no payload of its own but the figures of the one it refers to. A response's
    figures are taken from its payload again, which is left null unless ``payloads``. Continuations without a first
    segment give one row of type ``continuation`` that isn't complete. Records of other types, and no archives, give no rows.
    ``page_id`` is null for records that another program named.
    """
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+):', 1) as bigint)")
    read = stored(read_records(spark, path, payloads), "records")
    records = read.where("origin is null").select(*_WHOLE).unionByName(reassemble(read.where("origin is not null").select(*_PARTS), payloads))
    records = records.withColumn("page_id", page("record_id")).withColumnsRenamed({"bytes": "payload_bytes", "found": "payload_digest"})
    out = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "complete", "payload"]
    responses = records.where("record_type in ('response', 'continuation')").withColumn("refers_to", F.lit(None).cast("long"))
    by_digest = F.concat(F.lit("sha1:"), "payload_digest")
    origins = responses.where("complete").select(F.explode(F.array("record_id", by_digest)).alias("name"), "page_id", "payload_bytes").where("name is not null")
    origins = origins.groupBy("name").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("n"))
    revisits = records.where("record_type = 'revisit'").withColumn("name", F.coalesce("refers_to_id", F.concat(F.lit("sha1:"), "digest")))
    found = revisits.join(origins, "name", "left")
    found = found.withColumns({"complete": F.col("complete") & F.col("n").isNotNull(), "payload_bytes": F.col("n"), "payload_digest": F.col("digest"), "payload": F.lit(None).cast("binary")})
    return responses.select(*out).unionByName(found.select(*out))
