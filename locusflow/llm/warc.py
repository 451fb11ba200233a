"""Content-addressed WARC archive.

Writing: pages become WARC/1.1 records.  Records of equal payloads of some size are written
once as ``response``; the others are ``revisit`` records that refer to it and carry no payload.

Reading: archives are parsed by their Content-Length, payloads are hashed again and held
against the digest their header claims, and the result is kept as two tables:

* ``headers``: exact header bytes per record, with type, ids and digest;
* ``payloads``: each payload once, under its verified SHA-256.

Joining both on the digest gives back every original record byte by byte.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, scratch_path

CRLF = "\r\n"
END = b"\r\n\r\n"
#: Payloads below this many bytes are always stored as responses.
SMALL = 100
#: Rows of a digest table that may be broadcast (about 100 bytes each); beyond it a shuffle join.
BROADCAST_ROWS = 50_000
#: Records and bytes of a file, about, before compression: a file is read as one value.
RECORDS_PER_FILE = 20_000
BYTES_PER_FILE = 128_000_000
#: Compressed bytes handed to the decompressor at once.
_INFLATED_TOGETHER = 262_144
DATE = "1970-01-01T00:00:00Z"
_BYTES_PER_BATCH = 4_000_000


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is known to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _http_head(length: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF * 2))


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, small: int = SMALL) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest and ``first_id``, the page a revisit refers to.

    Only digests that occur more than once are joined back, so payloads are not shuffled while
    that table is small; a hot digest is one row of it.
    """
    records = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    records = records.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    repeated = (
        records.where(F.col("payload_bytes") >= small)
        .groupBy("digest")
        .agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "least")
    )
    joined = records.join(_bounded(materialize(repeated, "repeated")), "digest", "left")
    return joined.withColumn("first_id", F.when(F.col("page_id") > F.col("least"), F.col("least"))).drop("least")


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", small: int = SMALL
) -> str:
    """Writes one record per row to gzipped WARC files below ``path`` and returns the path.

    Null payload: empty.  Null url: no target line; control characters in it are percent-encoded.
    A file takes about ``BYTES_PER_FILE``, by the mean size of a payload.  A null id is written as ``null`` and is never the page others refer to.  Rows that repeat the
    smallest id of their payload are responses too (a record does not revisit itself).  An empty
    table writes no records.  Other columns are ignored.
    """
    rows = with_roles(pages, id_col, url_col, payload_col, small)
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(F.col(payload_col)), F.lit(0))).alias("n")).first().n or 0.0
    each = max(1, min(RECORDS_PER_FILE, int(BYTES_PER_FILE / (mean + 500))))
    revisit = F.col("first_id").isNotNull()
    head = _http_head(F.col("payload_bytes"))
    clean = F.col("url")
    for code in (9, 10, 13):
        clean = F.replace(clean, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload").cast("string")))
    length = F.octet_length(head) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", clean)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", uri(F.col("first_id"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        block,
    )
    # The text writer ends each row with the separator, which is exactly a record's end.
    writer = rows.select(record.alias("record")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", each)
    writer.option("compression", "gzip").text(path)
    return path


@dataclass(frozen=True)
class Record:
    header: bytes  # up to and with the empty line
    http_head: bytes
    payload: bytes
    fields: dict[str, str]


def parse_records(chunks) -> "list[Record]":
    """Records of one archive from an iterator of its (decompressed) bytes, one at a time."""
    buffer, at, chunks = bytearray(), 0, iter(chunks)

    def need(n: int) -> bool:
        nonlocal at
        while len(buffer) - at < n:
            more = next(chunks, None)
            if more is None:
                return False
            if at:
                del buffer[:at]
                at = 0
            buffer.extend(more)
        return True

    while need(1):
        searched = at
        while (cut := buffer.find(END, searched)) < 0:
            behind = len(buffer) - at
            if not need(behind + 1):
                raise ValueError("archive ends within a header")
            searched = at + max(0, behind - 3)
        header = bytes(buffer[at : cut + 4])
        if not header.startswith(b"WARC/1."):
            raise ValueError("no WARC record at this place")
        fields = {}
        for name, value in re.findall(rb"\r\n([^:\r\n]+):[ \t]*([^\r\n]*)", header):
            fields.setdefault(name.decode("ascii", "replace").lower(), value.decode("utf-8", "replace"))
        length = int(fields["content-length"])
        size = len(header) + length + 4
        if not need(size) or buffer[at + size - 4 : at + size] != END:
            raise ValueError("record is cut off")
        block = bytes(buffer[at + len(header) : at + size - 4])
        at += size
        split = 0
        if fields.get("content-type", "").startswith("application/http"):
            found = block.find(END)
            split = found + 4 if found >= 0 else len(block)
        yield Record(header, block[:split], block[split:], fields)


def _unzipped(content: bytes):
    """Decompressed chunks of a gzip file of one or more members, or of a plain file.

    Linear in the file: a member's end is an offset, and what is behind it is not copied.
    """
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        stream, step = zlib.decompressobj(31), 4_096  # small first steps: most members are one record
        while not stream.eof:
            if at >= len(view):
                raise ValueError("archive ends within a gzip member")
            fed = view[at : at + step]
            out = stream.decompress(fed)
            at += len(fed) - len(stream.unused_data)
            step = min(4 * step, _INFLATED_TOGETHER)
            if out:
                yield out
        while at < len(view) and view[at] == 0:  # padding between members
            at += 1


_RECORD_SCHEMA = (
    "position string, record_type string, record_id string, refers_to string, url string, claimed string, "
    "header binary, http_head binary, payload binary, payload_bytes long, digest string"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``; ``digest`` is computed from the bytes read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        names = [f.split()[0] for f in _RECORD_SCHEMA.split(", ")]
        types = [*[pa.string()] * 6, *[pa.binary()] * 3, pa.int64(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py().rpartition("/")[2], batch.column(1)[i].as_py()
                for n, r in enumerate(parse_records(_unzipped(content))):
                    get = r.fields.get
                    carried = get("warc-type") != "revisit"
                    payload = r.payload if carried else None
                    rows.append(
                        (
                            f"{name}:{n:09d}", get("warc-type"), get("warc-record-id"), get("warc-refers-to"), get("warc-target-uri"),
                            (get("warc-payload-digest") or "").removeprefix("sha256:") or None, r.header, r.http_head,
                            payload, len(payload) if carried else None, sha256(payload).hexdigest() if carried else None,
                        )
                    )
                    held += len(r.header) + len(r.payload) + 300
                    if held > _BYTES_PER_BATCH:
                        yield batch_of(rows)
                        rows, held = [], 0
        yield batch_of(rows)

    return files.mapInArrow(parse, _RECORD_SCHEMA)


@dataclass(frozen=True)
class Store:
    """Two tables: ``headers`` (a row per record) and ``payloads`` (digest, payload, payload_bytes)."""

    headers: DataFrame
    payloads: DataFrame

    def records(self) -> DataFrame:
        """The archive's records, rebuilt: position, record (its exact bytes) and the full payload."""
        joined = self.headers.join(self.payloads, self.headers["digest"] == self.payloads["payload_digest"], "left")
        carried = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
        record = F.concat(F.col("header"), F.col("http_head"), carried, F.lit(END))
        return joined.select("position", "record_type", "record_id", "refers_to", record.alias("record"), "payload", "payload_bytes", "digest")


def build_store(spark: SparkSession, path: str) -> Store:
    """Reads archives into the content-addressed form.

    A record whose payload does not have the digest its header claims is kept under its true
    digest and marked ``verified`` false.  A payload that occurs in several records is stored
    once.  A revisit of a payload that no archive holds keeps its header and has no payload.
    """
    parsed = read_records(spark, path)
    at = scratch_path(spark, "records")
    parsed.write.option("compression", "zstd").parquet(at)
    records = spark.read.parquet(at)
    records._scratch_path = at
    digest = F.coalesce("digest", "claimed")
    headers = materialize(
        records.select(
            "position", "record_type", "record_id", "refers_to", "url", "header", "http_head", digest.alias("digest"),
            (F.col("digest").isNull() | F.col("digest").eqNullSafe(F.coalesce("claimed", "digest"))).alias("verified"),
        ),
        "headers",
    )
    held = records.where("digest is not null")
    several = held.groupBy("digest").agg(F.min("position").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = _bounded(materialize(several.select(F.col("digest").alias("_digest"), "keeper"), "keepers"))
    once = held.join(several, F.col("digest") == F.col("_digest"), "left").where("keeper is null or position = keeper")
    kept = scratch_path(spark, "payloads")
    once.select(F.col("digest").alias("payload_digest"), "payload", "payload_bytes").write.option("compression", "zstd").parquet(kept)
    payloads = spark.read.parquet(kept)
    payloads._scratch_path = kept
    discard(records)
    return Store(headers, payloads)
