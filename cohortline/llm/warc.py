"""WARC archives of web captures: writing, reading, and assembly of transactions."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete, shared_dir

#: Smallest payload that is stored once only, bytes of an archive file (more only for a single record), and leaders that are broadcast.
LEAST_BYTES, FILE_BYTES, FEW = 1000, 16_000_000, 50_000
BREAK = "\r\n"
#: A gzip member without content, in Latin-1: it ends each file.
NOTHING = gzip.compress(b"", mtime=0).decode("latin-1")
HTTP = f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}"
RECORD = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def record_id(*parts: Column) -> Column:
    """A urn:uuid made of a hash of the parts."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def record(kind: str | Column, headers: dict[str, Column], block: Column, media: str) -> Column:
    """The text of a record without the two line breaks that end it; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in headers.items()]
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat_ws(BREAK, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), *lines, F.lit(f"Content-Type: {media}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(BREAK * 2), block)


def leaders(pages: DataFrame, least: int) -> DataFrame:
    """``(digest, n, leader)`` of the payloads of at least ``least`` bytes that more than one page has."""
    same = pages.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("pages"))
    return cut(same.where("pages > 1 and leader is not null").select("digest", "n", "leader"))


def write_archives(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row ``(page_id, url, html)``.

    Of rows with equal payloads of at least ``least`` bytes, that with the largest ``page_id`` is the
    response (all such rows, if the id repeats) and the others are revisits that refer to it.  The
    files are WARC 1.1 with a gzip member for each record, so that a record can be read from its offset, of
    about ``file_bytes`` at most unless a single record is longer.  Spark writes them to ``path``, so that any
    store will do; payloads are not shuffled unless repeated ones are too many to broadcast.
    A null html is an empty payload; a null url is recorded as ``urn:page:<page_id>``.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))), r"[\r\n]", "").alias("url"), html.alias("html"))
    keyed = base.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    lead = leaders(keyed.select("page_id", "digest", "n"), least)
    lead = F.broadcast(lead) if lead.count() <= FEW else lead.repartition("leader", F.hash("digest"))
    full = keyed.withColumn("row", F.monotonically_increasing_id()).join(lead, ["digest", "n"], "left")
    again = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    request = record_id(F.lit("request"), F.col("row"), F.col("page_id"))
    response = record_id(F.when(again, "revisit").otherwise("response"), F.when(F.col("leader").isNull() | again, F.col("row")), F.col("page_id"), F.col("digest"))
    shared = {"WARC-Date": F.lit(date), "WARC-Target-URI": F.col("url")}
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    first = record("request", {"WARC-Record-ID": request, **shared}, F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{BREAK * 2}")), "application/http; msgtype=request")
    block = F.concat(F.lit(HTTP + BREAK), F.when(again, "").otherwise(F.col("html")))
    refers = F.when(again, record_id(F.lit("response"), F.lit(None), F.col("leader"), F.col("digest")))
    profile = F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    second = record(F.when(again, "revisit").otherwise("response"), {"WARC-Record-ID": response, "WARC-Concurrent-To": request, **shared, "WARC-Payload-Digest": digest, "WARC-Refers-To": refers, "WARC-Profile": profile}, block, "application/http; msgtype=response")
    facts = F.concat_ws(BREAK, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload-bytes: "), F.col("n").cast("string")))
    third = record("metadata", {"WARC-Record-ID": record_id(F.lit("metadata"), F.col("row"), F.col("page_id")), "WARC-Concurrent-To": request, **shared}, facts, "application/warc-fields")
    out = full.select(F.explode(F.array(first, second, third)).alias("value")).mapInArrow(lambda batches: archives(batches, file_bytes), "value binary")
    # a row is a file: the sink writes its bytes as they are, and the empty member in place of a line's end
    out.select(F.col("value").cast("string")).write.mode("error").option("encoding", "ISO-8859-1").option("lineSep", NOTHING).option("maxRecordsPerFile", 1).text(path)


def archives(batches: Iterable[pa.RecordBatch], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records as gzip members, one after another in rows of about ``file_bytes``."""
    held, size = [], 0

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["value"])

    for b in batches:
        for value in b.column(0):
            packed = zlib.compressobj(wbits=31)
            member = packed.compress(value.as_buffer()) + packed.compress(b"\r\n\r\n") + packed.flush()
            if held and size + len(member) > file_bytes:
                yield row()
                held, size = [], 0
            held.append(member)
            size += len(member)
    if held:
        yield row()


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an unpacked archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``, one row each (schema ``RECORD``).

    ``payload`` is the HTTP body of responses (null for other kinds, and for all if not ``payloads``), and
    ``payload_bytes`` and ``payload_digest`` are taken from it; those of a revisit come from its headers
    (the digest) and its metadata record (the size).  Files are unpacked as a stream.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out, size = [], 0
                for headers, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    out.append(_row(headers, block, payloads))
                    size += len(block)
                    if len(out) >= 2000 or size > 8_000_000:
                        yield _table(out)
                        out, size = [], 0
                if out:
                    yield _table(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, page_id long, payload_bytes long, payload_digest string, payload binary"
    return files.mapInArrow(run, schema)


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, page, size, digest, payload = headers["warc-type"], None, None, None, None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    elif kind == "revisit":
        digest = headers["warc-payload-digest"].partition(":")[2]
    elif kind == "metadata":
        facts = dict(x.split(": ", 1) for x in block.decode().split(BREAK) if ": " in x)
        page, size = (int(facts[k]) if k in facts else None for k in ("page-id", "payload-bytes"))
    return kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), page, size, digest, payload if payloads else None


def _table(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RECORD, strict=True)], schema=RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``page_id``, ``refers_to`` (page id) and the nested ``request``, ``response``, ``metadata``.

    Responses, revisits and metadata records name the request that they are concurrent to, and are joined
    with it by that; what a revisit refers to is joined by record id, through a table of one row per id, so
    that AQE can split a response that very many revisits refer to.
    """

    def of(*kinds: str, name: str) -> DataFrame:
        fields = [c for c in records.columns if c != "concurrent_to"]
        key = "record_id" if name == "request" else "concurrent_to"
        return records.where(F.col("kind").isin(*kinds)).select(F.col(key).alias("at"), F.struct(*fields).alias(name))

    whole = of("request", name="request").join(of("response", "revisit", name="response"), "at", "left").join(of("metadata", name="metadata"), "at", "left")
    pages = records.where("kind = 'metadata'").select("concurrent_to", F.col("page_id").alias("to_page"))
    ids = records.where("kind = 'response'").join(pages, "concurrent_to").groupBy(F.col("record_id").alias("to")).agg(F.max("to_page").alias("to_page"))
    aim = F.col("response.refers_to")
    none = whole.where(aim.isNull()).withColumn("to_page", F.lit(None).cast("long"))
    some = whole.where(aim.isNotNull()).withColumn("to", aim).join(ids.repartition("to_page", F.hash("to")), "to", "left").drop("to")
    return none.unionByName(some).select(F.col("metadata.page_id").alias("page_id"), F.col("to_page").alias("refers_to"), "request", "response", "metadata")


def round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives of ``pages``, reads them back and assembles the captures, one row each.

    Rows: ``page_id, payload_bytes, payload_digest`` (hex SHA-1), ``record_type``, ``refers_to``.  The
    archives are deleted when they have been read, unless ``path`` names their place.  Repeated rows all
    come back; a null html is an empty payload; a null page_id comes back null, and is never what others
    refer to; an empty table gives no rows; columns other than page_id, url and html are not looked at.
    """
    spark = pages.sparkSession
    place = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, place, least=least, file_bytes=file_bytes)
    records = cut(read_archives(spark, place, payloads=False).drop("payload"))
    if path is None:
        delete(spark, place)
    return assemble(records).select("page_id", F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), "refers_to")
