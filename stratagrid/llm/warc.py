"""WARC 1.1 archives kept as a table of chunks: (archive, record, chunk) rows that hold a record's bytes piece by piece.

The bytes of an archive's rows in order are a WARC file. A payload is cut into chunks of at most ``chunk`` bytes, each
row carries the SHA-256 of the payload up to its end, and neither writer nor reader ever holds more of a record than a
chunk (the writer reads slices of the column's own buffer)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Digests of repeated payloads, up to this many, are broadcast (about 100 bytes each); more are joined.
BROADCAST_DIGESTS = 100_000
#: Copies of one payload from which its rows don't meet by shuffle.
HOT = 10_000
CHUNKS = "archive string, record long, chunk int, chunks int, data binary, so_far string"
_END = b"\r\n\r\n"


def urn(page: object) -> str:
    """A key as a record identifier; keys may be texts of any characters, or null."""
    return "<urn:x-null:>" if page is None else f"<urn:x-page:{quote(str(page), safe='')}>"


def key_of(name: str | None) -> str | None:
    return None if name is None or name == "<urn:x-null:>" else unquote(name[len("<urn:x-page:") : -1])


def heads(page: object, url: str | None, size: int, digest: str, refers_to: object) -> bytes:
    """A record's WARC header and the HTTP header that its block begins with. A revisit's block is the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    address = "".join(c for c in url or "urn:x-unknown" if c >= " ")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + _END + http


def chunks_of(page: object, url: str | None, payload: memoryview, digest: str, refers_to: object, chunk: int) -> Iterator[tuple[int, bytes, str]]:
    """(number of chunks, bytes, SHA-256 of the payload so far) for each chunk of a record."""
    kept = payload if refers_to is None else payload[:0]
    many = max(1, -(-len(kept) // chunk))
    running = hashlib.sha256()
    for k in range(many):
        part = kept[k * chunk : (k + 1) * chunk]
        running.update(part)
        data = b"".join([heads(page, url, len(payload), digest, refers_to) if k == 0 else b"", part, _END if k == many - 1 else b""])
        yield many, data, running.copy().hexdigest()


def write_records(df: DataFrame, chunk: int = 1 << 16, key: str = "page_id", url: str = "url", body: str = "html", broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """The chunk table of df's rows, a record each, stored in the shared folder. Of rows with equal payloads of LEAST
    bytes or more, those with the smallest key are responses and the others revisit it. Null bodies are empty, null keys
    are never the smallest, and payloads of null keys alone are all responses; rows that repeat a key are records each.
    Control characters of an address are left out, its length is not bounded. Other columns are not carried, whatever
    their names. Empty table: no rows. Each Spark partition is one archive. Digests of repeated payloads are broadcast up
    to BROADCAST_DIGESTS; beyond, those of HOT copies or more still are, and the others are joined by shuffle."""
    rows = df.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.sha2(F.encode("body", "UTF-8"), 256))
    sized = rows.where(F.octet_length("body") >= LEAST)
    firsts = written(sized.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"))
    if firsts.count() <= broadcast_digests:
        met = rows.join(F.broadcast(firsts.select("digest", "first")), "digest", "left")
    else:
        # Rows of payloads with very many copies find their first record by broadcast, and are dealt out by themselves.
        hot = firsts.where(F.col("n") >= HOT).select("digest", F.col("first").alias("hot"))
        met = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_DIGESTS else hot, "digest", "left")
        met = met.withColumn("k", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.xxhash64("id", "url").cast("string")))
        cold = firsts.where(F.col("n") < HOT).select(F.col("digest").alias("k"), F.col("first").alias("cold"))
        met = met.join(cold, "k", "left").withColumn("first", F.coalesce("hot", "cold"))
    told = met.select("id", "url", "body", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = f"part-{TaskContext.get().partitionId():06d}"
        schema = pa.schema([("archive", pa.string()), ("record", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("data", pa.binary()), ("so_far", pa.string())])
        record, out, held = 0, [], 0
        for b in batches:
            ids, urls, bodies, digests, firsts = b.columns
            for page, address, text, digest, first in zip(ids.to_pylist(), urls.to_pylist(), bodies, digests.to_pylist(), firsts.to_pylist(), strict=True):
                for k, (many, data, so_far) in enumerate(chunks_of(page, address, memoryview(text.as_buffer()), digest, first, chunk)):
                    out.append((archive, record, k, many, data, so_far))
                    held += len(data)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
                record += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return written(told.mapInArrow(run, CHUNKS))


class Reader:
    """Reads one record from its chunks, in order, keeping no payload."""

    def __init__(self) -> None:
        self.place: tuple | None = None

    def feed(self, archive: str, record: int, chunk: int, chunks: int, data: memoryview, so_far: str) -> tuple | None:
        """The record once its last chunk is in: (key text, payload bytes, digest, type, refers to). ValueError if a
        chunk is lost or repeated, or a length or digest is wrong."""
        if chunk == 0:
            # The first chunk holds both headers, however long the address is, and no more than a chunk of the payload.
            self.place, self.running, self.seen, left = (archive, record, 0), hashlib.sha256(), 0, bytes(data)
            warc, found, rest = left.partition(_END)
            http, found2, _ = rest.partition(_END)
            if not found or not found2 or not warc.startswith(b"WARC/1.1\r\n"):
                raise ValueError(f"{archive} {record}: no header")
            self.fields = dict(x.split(": ", 1) for x in warc.decode().split("\r\n")[1:])
            self.http = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
            self.block = int(self.fields["Content-Length"]) - len(http) - len(_END)
            data = data[len(warc) + len(http) + 2 * len(_END) :]
        elif self.place != (archive, record, chunk):
            raise ValueError(f"{archive} {record}: chunk {chunk} is out of order")
        if chunk == chunks - 1:
            if bytes(data[-4:]) != _END:
                raise ValueError(f"{archive} {record}: no end")
            data = data[:-4]
        self.running.update(data)
        self.seen += len(data)
        if self.running.copy().hexdigest() != so_far:
            raise ValueError(f"{archive} {record}: digest of chunk {chunk}")
        self.place = (archive, record, chunk + 1)
        if chunk < chunks - 1:
            return None
        self.place = None
        kind, digest = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if self.seen != self.block or kind == "response" and (so_far != digest or self.seen != int(self.http["Content-Length"])):
            raise ValueError(f"{archive} {record}: length or digest of the payload")
        return key_of(self.fields["WARC-Record-ID"]), int(self.http["Content-Length"]), digest, kind, key_of(self.fields.get("WARC-Refers-To"))


def read_records(chunks: DataFrame, key_type: str = "bigint", key: str = "page_id") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every record of a chunk table. Records of one
    chunk are read where they lie; the chunks of longer ones are brought together and in order, a record at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        schema = pa.schema([("key", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
        for b in batches:
            out = []
            a, r, k, n, d, s = b.columns
            for archive, record, chunk, many, data, so_far in zip(a.to_pylist(), r.to_pylist(), k.to_pylist(), n.to_pylist(), d, s.to_pylist(), strict=True):
                if (got := reader.feed(archive, record, chunk, many, memoryview(data.as_buffer()), so_far)) is not None:
                    out.append(got)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)
        if reader.place is not None:
            raise ValueError(f"{reader.place}: chunks are missing")

    kinds = "key string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    short = chunks.where("chunks = 1").mapInArrow(run, kinds)
    long = chunks.where("chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk").mapInArrow(run, kinds)
    return short.union(long).select(F.col("key").cast(key_type).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(key_type).alias("refers_to"))


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written and read back."""
    pages = table(spark, sf_dir, "pages")
    return read_records(write_records(pages), pages.schema["page_id"].dataType.simpleString())


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
             min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
