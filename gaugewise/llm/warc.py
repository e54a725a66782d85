"""WARC archives: pages to segmented records and back; continuation records are put together again and chunks decoded."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewise.llm.common import PASS_BYTES, passes, shared_dir, written

VERSION, CRLF, END = b"WARC/1.1", b"\r\n", "\r\n\r\n"
#: Longest block of a record in bytes, bytes of an HTTP chunk, and records of a file: SEGMENT * RECORDS bounds a file, and a file is what one task reads whole.
SEGMENT, CHUNK, RECORDS = 16_384, 4_096, 2_048
#: Pages carry no time; all records bear this one.
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
SAFE = "%/:?#[]@!$&'()*+,;=~"

PIECE = "origin string, segment int, total long, record_type string, page string, uri string, refers_to string, stated string, payload_bytes long, payload_digest string, complete boolean, block binary, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*of: object) -> str:
    """A record's name, from what tells it from others; None and texts that look alike differ."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(of).encode()).digest())}>"


def chunked(payload: bytes, most: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    pieces = (payload[i : i + most] for i in range(0, len(payload), most))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in pieces) + b"0\r\n\r\n"


class Dechunker:
    """Takes an HTTP message in pieces, cut anywhere, and gives the payload in pieces; holds a line at most.

    A message without chunked framing is passed on as it is. Chunk extensions and trailers are read over.
    """

    LONGEST_LINE = 65_536

    def __init__(self):
        self.state, self.rest, self.left, self.is_chunked, self.bad = "status", b"", 0, False, False

    def _line(self) -> bytes | None:
        line, found, rest = self.rest.partition(CRLF)
        if not found:
            self.bad |= len(line) > self.LONGEST_LINE
            return None
        self.rest = rest
        return line

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.rest += piece
        while not self.bad and self.rest:
            if self.state == "body":
                out, self.rest = self.rest, b""
                yield out
            elif self.state == "data":
                out, self.rest = self.rest[: self.left], self.rest[self.left :]
                self.left -= len(out)
                if out:
                    yield out
                if not self.left:
                    self.state = "data end"
            elif self.state == "over":
                self.bad = True
            elif (line := self._line()) is None:
                return
            elif self.state == "status":
                self.bad = not line.startswith(b"HTTP/")
                self.state = "header"
            elif self.state == "header":
                name, _, value = line.lower().partition(b":")
                self.is_chunked |= name.strip() == b"transfer-encoding" and value.strip() == b"chunked"
                if not line:
                    self.state = "size" if self.is_chunked else "body"
            elif self.state == "size":
                digits = line.partition(b";")[0].strip()
                if not digits or digits.strip(b"0123456789abcdefABCDEF"):
                    self.bad = True
                else:
                    self.left = int(digits, 16)
                    self.state = "data" if self.left else "trailer"
            elif self.state == "data end":
                self.bad, self.state = bool(line), "size"
            elif not line:
                self.state = "over"

    @property
    def complete(self) -> bool:
        return not self.bad and not self.rest and self.state in ("over", "body")


def records_of(page: object, uri: str | None, payload: bytes, serial: int, refers: tuple[object] | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page without what ends a record: a response in as many segments as its length asks for, or a revisit of a page."""
    digest = sha1_base32(payload)
    name = record_id(page, digest, serial)
    common = [("WARC-Date", DATE)]
    if uri is not None:
        common.append(("WARC-Target-URI", quote(uri, SAFE)))
    if page is not None:
        common.append(("WARC-Page-ID", quote(str(page), "")))
    http = ("Content-Type", "application/http; msgtype=response")

    def record(kind: str, own: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
        lines = [("WARC-Type", kind), ("WARC-Record-ID", own), *fields, ("Content-Length", str(len(block)))]
        return VERSION + CRLF + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + CRLF + block

    stated = [("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers:
        told = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers[0], digest, 0))]
        told += [("WARC-Refers-To-Page-ID", quote(str(refers[0]), ""))] * (refers[0] is not None)
        yield record("revisit", name, [*common, *stated, *told, http], HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        yield record("response", name, [*common, *stated, http], block)
        return
    yield record("response", name, [*common, *stated, http, ("WARC-Segment-Number", "1")], block[:segment])
    for k, at in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] * (at + segment >= len(block))
        yield record("continuation", record_id(page, digest, serial, k), [("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k)), *last], block[at : at + segment])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", segment: int = SEGMENT, compression: str = "none") -> None:
    """Writes a WARC record for every row of pages to new files in the folder `path`.

    Of rows with equal payloads (null: empty) that with the largest id is a response and the others revisit it (null
    is the smallest id); where that row is repeated, each is a response. Only ids and digests are grouped, sums first,
    and only rows that are not alone with their payload meet the pages again. Texts longer than a segment
    become several records. Addresses are percent-encoded where a header can't hold them; a null one is left out. compression: none, or gzip (each file as one stream).
    """
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    base = pages.select(F.col(id_col).alias("page"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = base.withColumn("digest", F.unhex(digest))
    ids = written(rows.groupBy("digest", "page").agg(F.count("*").alias("n")), "warc-ids")
    groups = ids.groupBy("digest").agg(F.max("page").alias("best"), F.sum("n").alias("rows")).where("rows > 1")
    crowded = ids.join(groups, "digest").select(F.col("digest").alias("of"), F.col("page").alias("of_page"), "best", "n")
    crowded = written(crowded, "warc-crowded")
    told = rows.join(crowded, (F.col("digest") == F.col("of")) & F.col("page").eqNullSafe(F.col("of_page")), "left").select(
        "page", "uri", F.col("payload").alias("text"), "best", (F.col("n").isNotNull() & ~F.col("page").eqNullSafe(F.col("best"))).alias("again"),
        F.when(F.col("n") > 1, F.monotonically_increasing_id() + 1).otherwise(0).alias("serial"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                out, held = [], 0
                for r in part.to_pylist():
                    for record in records_of(r["page"], r["uri"], r["text"].encode(), r["serial"], (r["best"],) if r["again"] else None, segment):
                        out.append(record)
                        held += len(record)
                        if held > PASS_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # Bytes pass through a cast to string unchanged, and the text writer adds what ends a record.
    records = told.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).option("compression", compression).text(path)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file, plain or in any number of gzip members."""
    if content[:2] == b"\x1f\x8b":
        pieces = []
        while content:
            stream = zlib.decompressobj(31)
            pieces.append(stream.decompress(content))
            content = stream.unused_data
        content = b"".join(pieces)
    at = 0
    while at < len(content):
        head = content.find(END.encode(), at)
        lines = content[at:head].decode("utf-8", "replace").split("\r\n")
        if head < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = head + 4
        end = start + int(fields["content-length"])
        if content[end : end + 4] != END.encode():
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield fields, content[start:end]
        at = end + 4


class _Payload:
    """What a message's payload comes to, piece by piece."""

    def __init__(self, keep: bool):
        self.message, self.sum, self.n, self.kept = Dechunker(), hashlib.sha1(), 0, [] if keep else None

    def feed(self, piece: bytes) -> None:
        for out in self.message.feed(piece):
            self.sum.update(out)
            self.n += len(out)
            if self.kept is not None:
                self.kept.append(out)

    def told(self, stated: str | None, whole: bool = True) -> dict:
        """Bytes, digest and payload, if the message is whole and its digest is the stated one; else only that it is not."""
        digest = base64.b32encode(self.sum.digest()).decode()
        complete = whole and self.message.complete and stated in (None, digest)
        return {"payload_bytes": self.n, "payload_digest": digest, "payload": None if self.kept is None else b"".join(self.kept), "complete": True} if complete else {"complete": False}


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per response and revisit record under `path`: record_id, page_id, uri, record_type, refers_to (all strings), payload_bytes, payload_digest, complete, payload (with_payload).

    A response in segments is put together by its origin's name and segment numbers, one segment at a time; it is
    complete if the numbers run from 1 without a gap to a last one that states the total length, that length is
    right, its chunks can be decoded and the digest is the stated one. Otherwise payload columns are null. A revisit
    has no payload of its own; its digest is the stated one. Continuations whose first segment is missing give a row
    of type continuation that is not complete. A segment that is there twice makes its record incomplete. A file is
    read whole by a task; an empty folder of files gives an empty table.
    """
    schema = T._parse_datatype_string(PIECE)
    arrow = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for f in schema])
    number = lambda x: None if x is None else int(x)

    def piece(fields: dict[str, str], block: bytes) -> dict | None:
        kind, get = fields.get("warc-type"), fields.get
        if kind not in ("response", "revisit", "continuation"):
            return None
        stated = get("warc-payload-digest", "").removeprefix("sha1:") or None
        own = {"record_type": kind, "origin": get("warc-segment-origin-id") if kind == "continuation" else get("warc-record-id"), "segment": number(get("warc-segment-number")), "total": number(get("warc-segment-total-length")), "stated": stated, "uri": get("warc-target-uri")}
        own |= {"page": None if get("warc-page-id") is None else unquote(get("warc-page-id")), "refers_to": None if get("warc-refers-to-page-id") is None else unquote(get("warc-refers-to-page-id"))}
        if kind == "revisit":
            return own | {"payload_digest": stated, "complete": stated is not None}
        if own["segment"] is not None:
            return own | {"block": block}
        payload = _Payload(with_payload)
        payload.feed(block)
        return own | payload.told(stated)

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{k: r.get(k) for k in arrow.names} for r in rows], arrow)

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                for fields, block in parsed(content.as_py()):
                    if (row := piece(fields, block)) is not None:
                        out.append(row)
                        held += len(block)
                    if held > PASS_BYTES:
                        yield batch_of(out)
                        out, held = [], 0
                if out:
                    yield batch_of(out)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by origin and segment; only what is open of one record is held."""
        first, payload, at, n, total, sound = None, None, 0, 0, None, True

        def over() -> dict:
            right = sound and first["record_type"] == "response" and total == n
            return {k: v for k, v in first.items() if k != "block"} | payload.told(first["stated"], right)

        for part in (p for batch in batches for p in passes(batch, "block")):
            out, held = [], 0
            for row in part.to_pylist():
                if first is not None and (row["segment"] is None or row["origin"] != first["origin"]):
                    out.append(over())
                    held += payload.n * with_payload
                    first = None
                if row["segment"] is None:
                    out.append(row)
                    held += len(row["payload"] or b"")
                elif first is None:
                    first, payload, at, n, total, sound = row, _Payload(with_payload), 1, 0, None, row["segment"] == 1
                else:
                    at += 1
                    sound = sound and row["segment"] == at and total is None and row["record_type"] == "continuation"
                if first is not None:
                    payload.feed(row["block"])
                    n += len(row["block"])
                    total = row["total"] if row["total"] is not None else total
                if held > PASS_BYTES:
                    yield batch_of(out)
                    out, held = [], 0
            if out:
                yield batch_of(out)
        if first is not None:
            yield batch_of([over()])

    files = spark.read.format("binaryFile").load(path).select("content")
    pieces = files.mapInArrow(take_apart, schema).repartition("origin").sortWithinPartitions("origin", F.col("segment").asc_nulls_first())
    whole = pieces.mapInArrow(put_together, schema)
    own = ["payload"] if with_payload else []
    return whole.select(F.col("origin").alias("record_id"), F.col("page").alias("page_id"), "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "complete", *own)


def archived(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Writes archives of pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to (page_id), complete; a row per row of pages.

    A revisit gets its payload's length from the response with its digest, and is complete if there is one. Null
    payloads count as empty; empty ones revisit each other like any other. A null id is the smallest, and stays null.
    Repeated rows get a record each; where the row with the largest id is repeated, each is a response. Very long
    payloads become many segments, of which reading holds one at a time; writing holds the payload. An empty table
    gives an empty one. Other columns of pages are not looked at.
    path: a new folder; one in the shared folder if None.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, uri_col, payload_col, segment)
    back = written(read_archives(spark, path), "warc-read")  # without payloads
    kind = pages.schema[id_col].dataType
    bodies = back.where("complete and record_type = 'response'").groupBy(F.col("payload_digest").alias("of")).agg(F.max("payload_bytes").alias("n"))
    responses = back.where("record_type <> 'revisit'")
    revisits = back.where("record_type = 'revisit'").join(bodies, F.col("payload_digest") == F.col("of"), "left").withColumn("payload_bytes", F.col("n")).withColumn("complete", F.col("complete") & F.col("n").isNotNull())
    both = responses.unionByName(revisits.select(*responses.columns))
    return both.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "complete")
