"""Operator 2, WARC: a monolithic gzip normaliser with a sidecar offset index.

An archive that is one gzip stream over all its records cannot be read from
the middle. The normaliser inflates such a stream once, in bounded chunks,
finds the records, writes each one as a gzip member of its own and notes
offset and length of every member in a sidecar index, a table of its own, by
which single records are read without touching the rest.

The query writes one record per page into archives of this kind (a table of
archives in the shared folder), normalises them, and reads every record back
through the index.

Skew: digests that more than ``HOT_SHARE`` of the repeated pages have are
broadcast (there are few), so their pages stay where they are.

Edge cases: a null or empty payload is a record of length 0; repeated payloads
of 1000 bytes or more are revisits of the record with the largest page id
(where rows share that id, each of them is a response; pages without an id
revisit it); an empty table gives no archives; archives are rolled at a fixed size,
and a larger record has an archive to itself.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import discard, join_by_weight, materialise, slices, table

#: Uncompressed bytes after which a new archive begins.
ROLL_BYTES = 8_000_000
REVISIT_BYTES = 1000
CHUNK = 1 << 16
LEVEL = 6
#: Date of the records where the pages tell none.
UNDATED = "1970-01-01T00:00:00Z"
#: Fixed value: what a revisit by equal payload is called.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_END = b"\r\n\r\n"
#: A header block longer than this is refused as damaged.
HEAD_LIMIT = 1 << 20


class WarcError(ValueError):
    """An archive that does not follow the format."""


@dataclass
class Member:
    """One record in a normalised archive."""

    number: int
    offset: int
    length: int
    record_id: str
    uri: str


def warc_record(headers: dict[str, str], payload: bytes) -> bytes:
    """Bytes of one record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + HEAD_END + payload + HEAD_END


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields, by lower-case name; the first of repeated ones counts."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError(f"no record at {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Plain bytes of a gzip file of one or many members, a bounded piece at a time."""
    z, begun = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            begun = True
            out = z.decompress(chunk, 4 * CHUNK)
            if out:
                yield out
            chunk = z.unconsumed_tail
            if z.eof:
                chunk, z, begun = z.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
    if begun:
        raise WarcError("the gzip stream ends early")


def records(plain: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record bytes) of each record of an inflated stream."""
    source, held, over = iter(plain), bytearray(), False

    def more() -> bool:
        nonlocal over
        x = next(source, None)
        if x is None:
            over = True
            return False
        held.extend(x)
        return True

    while True:
        while not held and more():
            pass
        if not held:
            return
        while (end := held.find(HEAD_END)) < 0:
            if len(held) > HEAD_LIMIT or not more():
                if not held.strip(b"\r\n"):
                    return
                raise WarcError("a record's header has no end")
        fields = parse_head(bytes(held[:end]))
        try:
            total = end + 4 + int(fields["content-length"]) + 4
        except (KeyError, ValueError) as e:
            raise WarcError("a record has no usable length") from e
        while len(held) < total and more():
            pass
        if len(held) < total:
            raise WarcError("a record is cut short")
        yield fields, bytes(held[:total])
        del held[:total]


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member, the same bytes for the same data."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise(chunks: Iterable[bytes], sink: io.RawIOBase | io.BytesIO, level: int = LEVEL) -> Iterator[Member]:
    """Rewrite a gzip archive, given as chunks, into ``sink`` with a member per record; yields the index."""
    offset = 0
    for number, (fields, data) in enumerate(records(inflate(chunks))):
        member = gzip_member(data, level)
        sink.write(member)
        yield Member(number, offset, len(member), fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""))
        offset += len(member)


def read_member(archive: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Fields and payload of the record at an index entry."""
    data = zlib.decompress(archive[offset : offset + length], 31)
    end = data.index(HEAD_END)
    fields = parse_head(data[:end])
    return fields, data[end + 4 : end + 4 + int(fields["content-length"])]


def write_archives(records_df: DataFrame, date: str = UNDATED) -> DataFrame:
    """Archives (archive, content) from rows of page_id, url, payload, digest, refers_to: each a single gzip stream.

    A record with refers_to is a revisit and carries the digest and size of the payload instead of the payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, out, size, name = None, [], 0, hashlib.sha1()

        def close() -> pa.RecordBatch:
            content = b"".join([*out, z.flush()])
            return pa.RecordBatch.from_arrays([pa.array([name.hexdigest()]), pa.array([content], pa.binary())], ["archive", "content"])

        for b in slices(batches, "payload"):
            for r in b.to_pylist():
                if z is not None and size + len(r["payload"]) > ROLL_BYTES:
                    yield close()
                    z = None
                if z is None:
                    z, out, size, name = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0, hashlib.sha1()
                page = "" if r["page_id"] is None else str(r["page_id"])
                head = {
                    "WARC-Type": "response" if r["refers_to"] is None else "revisit",
                    "WARC-Record-ID": f"<urn:page:{page}>",
                    "WARC-Date": date,
                    "WARC-Target-URI": (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A"),
                    "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(r["digest"])).decode(),
                    "X-Payload-Length": str(len(r["payload"])),
                }
                if r["refers_to"] is None:
                    head["Content-Type"] = "text/html"
                else:
                    head |= {"WARC-Refers-To": f"<urn:page:{r['refers_to']}>", "WARC-Profile": PROFILE}
                data = warc_record(head, r["payload"] if r["refers_to"] is None else b"")
                out.append(z.compress(data))
                size += len(data)
                name.update(f"{page}:{r['digest']};".encode())
        if z is not None:
            yield close()

    return records_df.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, content binary")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Normalised archives with their sidecar index: archive, content, index (array of members)."""
    entry = pa.struct([("number", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("uri", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("archive"), b.column("content"), strict=True):
                view, sink = memoryview(content.as_buffer()), io.BytesIO()
                index = [vars(m) for m in normalise((bytes(view[k : k + CHUNK]) for k in range(0, len(view), CHUNK)), sink)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([sink.getvalue()], pa.binary()), pa.array([index], pa.list_(entry))], ["archive", "content", "index"])

    return archives.mapInArrow(run, "archive string, content binary, index array<struct<number:long,offset:long,length:long,record_id:string,uri:string>>")


def sidecar(normalised: DataFrame) -> DataFrame:
    """The index as a table: archive, number, offset, length, record_id, uri."""
    return normalised.select("archive", F.explode("index").alias("m")).select("archive", "m.*")


def read_archives(archives: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Every record that the index (by default the archives' own) lists, taken from its archive by its entry; payload checked against its digest."""
    entries = (sidecar(archives) if index is None else index).groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "record_id"))).alias("index"))

    def page(text: str | None) -> int | None:
        inner = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(inner) if inner.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"]
        for b in batches:
            for name, content, index in zip(b.column("archive"), b.column("content"), b.column("index"), strict=True):
                data, rows = content.as_py(), []
                for m in index.as_py():
                    fields, payload = read_member(data, m["offset"], m["length"])
                    kind = fields["warc-type"]
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise WarcError(f"record {m['record_id']} of {name} does not match its digest")
                    size = len(payload) if kind == "response" else int(fields["x-payload-length"])
                    rows.append((page(fields["warc-record-id"]), size, digest, kind, page(fields.get("warc-refers-to")), name.as_py(), m["offset"]))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                cols = list(zip(*rows, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return archives.select("archive", "content").join(entries, "archive").select("archive", "content", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long")


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null: the record is a response) of each page.

    Groups are found on small rows (id, digest): repeated digests only are
    joined back, so a popular payload is counted before it is shuffled.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    heads = base.where(large).groupBy("digest").agg(F.max("page_id").alias("_head"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # small pages of a digest are no part of its group: size and digest go together
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("_head")), F.col("_head"))
    return join_by_weight(base, materialise(heads, "heads"), ["digest"], "_n", outer=True).select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to monolithic archives, normalised, and read back by the index."""
    archives = materialise(write_archives(mark_revisits(table(spark, sf_dir, "pages"))), "warc")
    normalised = materialise(normalise_archives(archives), "warcnorm")
    discard(archives)
    return read_archives(normalised, materialise(sidecar(normalised), "warcindex")).drop("archive", "offset")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), h AS (SELECT d, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN h.head IS NULL OR h.head = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.head <> p.page_id THEN h.head END AS refers_to
FROM p LEFT JOIN h ON p.d = h.d AND p.n >= 1000
"""
