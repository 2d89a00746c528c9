"""WARC archives: writing with segments and revisits, reading with segment reassembly."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.storage import materialise

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    """SHA-1 in base32, as WARC digests are written."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """HTTP chunked transfer framing of a payload."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing; ValueError where the framing is broken or incomplete."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def _record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(record_id: str, url: str, payload: bytes, sha: str, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page, without the two line ends after each: a revisit, a response, or a response in segments."""
    same = {"WARC-Date": DATE, "Content-Type": "application/http; msgtype=response"}
    who = {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{sha}"} if url else {"WARC-Payload-Digest": f"sha1:{sha}"}
    if refers_to is not None:
        block = HTTP
        return [_record({"WARC-Type": "revisit", "WARC-Record-ID": record_id, **same, **who, "WARC-Refers-To": refers_to, "WARC-Profile": PROFILE, "WARC-Block-Digest": f"sha1:{digest(block)}"}, block)]
    block = HTTP + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = []
    for n, part in enumerate(parts, 1):
        fields = {"WARC-Type": "response", "WARC-Record-ID": record_id, **same, **who} if n == 1 else {"WARC-Type": "continuation", "WARC-Record-ID": f"{record_id[:-1]}/{n}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": record_id}
        if len(parts) > 1:
            fields["WARC-Segment-Number"] = str(n)
            if n == len(parts):
                fields["WARC-Segment-Total-Length"] = str(len(block))
        out.append(_record(fields | {"WARC-Block-Digest": f"sha1:{digest(part)}"}, part))
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, in lower case, and block of each record of an archive, one after another by their lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        stop = data.index(END, at)
        fields = {}
        for line in data[at:stop].decode().split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.lower()] = v.strip()
        n = int(fields["content-length"])
        block = data[stop + 4 : stop + 4 + n]
        if len(block) != n:
            raise ValueError("the archive ends inside a record")
        yield fields, block
        at = stop + 4 + n + len(END)


def _with_digest(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``key, page_id, url, html, sha, n``; the key of a null id is the empty text."""
    schema = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType()), StructField("sha", StringType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([digest(p) for p in payloads]), pa.array([len(p) for p in payloads])], names=schema.names)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, schema).withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Write one response or revisit record per row of ``pages`` to gzip-compressed archives in ``folder``.

    The payload is the UTF-8 of ``html_col`` (null: empty), sent as HTTP with chunked transfer framing; blocks over
    ``segment_bytes`` are cut into a first record and continuations.  Of equal payloads of at least ``min_bytes`` bytes the
    smallest id is the response and all others revisit it.  Rows that repeat id and payload: the first by url counts as the
    response.  A null id comes after all others.  Only (id, digest) is aggregated; pages are shuffled once, by id.
    """
    rows = _with_digest(pages, id_col, url_col, html_col)
    roles = materialise(rows.groupBy("key", "sha", "n").agg(F.min("page_id").alias("page_id")))
    first = materialise(roles.groupBy("sha", "n").agg(F.min("page_id").alias("origin")))
    roles = materialise(roles.join(first, ["sha", "n"]).select("key", "sha", F.coalesce(F.col("origin").cast("string"), F.lit("")).alias("origin")))
    nth = F.row_number().over(Window.partitionBy("key", "sha").orderBy("url"))
    known = rows.join(roles, ["key", "sha"]).withColumn("nth", nth)
    response = (F.col("n") < min_bytes) | ((F.col("key") == F.col("origin")) & (F.col("nth") == 1))
    name = lambda key, k: F.concat(F.lit("<urn:page:"), key, F.lit(":"), F.col("sha"), F.lit(":"), k, F.lit(">"))
    ready = known.select(
        name(F.col("key"), F.col("nth").cast("string")).alias("id"), "url", "html", "sha",
        F.when(~response, name(F.col("origin"), F.lit("1"))).alias("refers"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, htmls, shas, refers = b.columns
            out: list[bytes] = []
            for i in range(b.num_rows):
                url = re.sub(r"[\r\n]+", " ", urls[i].as_py() or "").strip()
                out += page_records(ids[i].as_py(), url, htmls[i].as_buffer().to_pybytes(), shas[i].as_py(), refers[i].as_py(), segment_bytes)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = ready.mapInArrow(run, StructType([StructField("record", BinaryType())]))
    # Two line ends close each record; the writer puts them after every row and the row's bytes out as they are.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option(
        "maxRecordsPerFile", 20_000
    ).mode("overwrite").text(folder)


_PAGE = re.compile(r"<urn:page:(-?\d*):")
_WHOLE = StructType([
    StructField("record_id", StringType()), StructField("url", StringType()), StructField("type", StringType()), StructField("refers", StringType()), StructField("sha", StringType()),
    StructField("payload_bytes", LongType()), StructField("payload", BinaryType()), StructField("ok", BooleanType()),
])


def _finish(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """One row of ``_WHOLE`` from the header of a record and its whole block."""
    sha = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    row = (fields["warc-record-id"], fields.get("warc-target-uri"), kind, fields.get("warc-refers-to"), sha)
    if kind != "response":
        return (*row, None, None, True)
    head, _, body = block.partition(END)
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    return (*row, len(payload), payload if payloads else None, digest(payload) == sha)


def _rows(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "integer": pa.int32(), "boolean": pa.bool_()}
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(cols, schema)], names=schema.names)


def inflated(data: bytes) -> bytes:
    """The content of all members of a compressed file, one after the other; zeros after a member are padding."""
    at, view, out = 0, memoryview(data), []
    while at < len(view):
        member = zlib.decompressobj(47)
        while not member.eof:
            if at >= len(view):
                raise ValueError("a compressed archive ends inside a member")
            piece = view[at : at + 65_536]
            out.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        while at < len(view) and not view[at]:
            at += 1
    return b"".join(out)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and with ``payloads`` the ``payload``.

    Archives are read file by file and records found by their lengths.  Records in one piece are decoded where they
    lie.  Segments are grouped by the id of their first record and put in order of their number; that no number is missing
    and that the total length is right is verified, then the chunked framing is decoded.  Every digest is verified.  A
    revisit takes the payload's length from the response it refers to; its ``payload`` is null.
    """
    schema = StructType([*_WHOLE.fields, StructField("origin", StringType()), StructField("number", IntegerType()), StructField("total", LongType()), StructField("block", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed, path in zip(b.column(0), b.column(1)):
                data, out = packed.as_buffer().to_pybytes(), []
                data = inflated(data) if path.as_py().endswith(".gz") else data
                for fields, block in parse(data):
                    if fields.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
                        raise ValueError(f"block digest of {fields['warc-record-id']} differs")
                    if "warc-segment-number" not in fields:
                        out.append((*_finish(fields, block, payloads), None, None, None, None))
                    else:
                        sha = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                        total = fields.get("warc-segment-total-length")
                        out.append((fields["warc-record-id"], fields.get("warc-target-uri"), fields["warc-type"], None, sha, None, None, None, origin, int(fields["warc-segment-number"]), total and int(total), block))
                    if len(out) >= 500:
                        yield _rows(out, schema)
                        out = []
                yield _rows(out, schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for origin, url, sha, total, segments in zip(*(c.to_pylist() for c in b.columns)):
                if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
                    raise ValueError(f"segments of {origin} are missing or repeated")
                block = b"".join(s["block"] for s in segments)
                if len(block) != total:
                    raise ValueError(f"segments of {origin} have {len(block)} bytes, not {total}")
                fields = {"warc-type": "response", "warc-record-id": origin, "warc-payload-digest": sha or ""} | ({"warc-target-uri": url} if url else {})
                out.append(_finish(fields, block, payloads))
            yield _rows(out, _WHOLE)

    found = materialise(spark.read.format("binaryFile").load(folder).select("content", "path").mapInArrow(run, schema))
    pieces = found.filter("origin is not null").groupBy("origin").agg(
        F.max("url").alias("url"), F.max("sha").alias("sha"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("segments")
    )
    whole = found.filter("origin is null").select(*_WHOLE.names).unionByName(pieces.mapInArrow(join, _WHOLE))
    whole = materialise(whole)
    page = lambda c: F.regexp_extract(c, _PAGE.pattern, 1).try_cast("long")
    sizes = whole.filter("type = 'response'").select(F.col("record_id").alias("refers"), F.col("payload_bytes").alias("known"))
    out = whole.join(sizes, "refers", "left")
    right = F.assert_true(F.coalesce("ok", F.lit(True)), F.concat(F.lit("payload digest differs: "), "record_id"))
    cols = [
        page("record_id").alias("page_id"), "url", F.coalesce("payload_bytes", "known").alias("payload_bytes"), F.col("sha").alias("payload_digest"),
        F.col("type").alias("record_type"), page("refers").alias("refers_to"),
    ]
    return out.filter(right.isNull()).select(*cols, *(["payload"] if payloads else []))
