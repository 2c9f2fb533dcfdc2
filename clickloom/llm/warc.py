"""WARC archives, index first: records are written with an index and read back by coalesced ranges.

``write`` gives every page a record (one gzip member each, so any record is readable alone) and
reports where it went: file, offset, length, URL, digest. That report is stored as a table before
anything is read. Equal payloads are stored once: of the pages that share a digest and length of at
least ``least`` bytes, that with the largest page_id is a ``response``; the others are ``revisit``
records without payload that refer to it. Only digests are shuffled to decide that, not payloads.

``read`` takes any selection of index rows, sorts it by file and offset, merges ranges with small
gaps between them into one read of bounded size, and parses the records from it.

Files are named by task attempt and count only if the stored index names them, so a lost executor
or repeated task leaves at most a file that nobody reads.

Defined cases: a null html is an empty payload; rows without page_id are revisits where their
payload has any id, else responses; rows that repeat the largest page_id of a payload are all
responses; a null URL is written as an empty one; an empty table gives an empty index; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clickloom.llm import work

LEAST = 0  # bytes of a payload that can be revisited
GAP, READ = 1 << 16, 1 << 23  # bytes between two ranges of one read; bytes of a read, about
TASK = 1 << 27  # bytes that a reading task fetches, about
FILE_BYTES = 1 << 30  # an archive is closed beyond this size
_ID = "urn:clickloom:page:"
_DATE = "2000-01-01T00:00:00Z"  # pages have no fetch date; a fixed one keeps archives reproducible
INDEX = "file string, offset long, length long, url string, payload_digest string, page_id {id}"
FOUND = "page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Every page with its payload, SHA-1 (hex) and ``keeper``: the page_id that holds its payload."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    marked = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    shared = marked.where(F.octet_length("payload") >= least).groupBy("sha", F.octet_length("payload").alias("size")).agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = work.store(shared.select("sha", "size", "keeper"), "shared")
    joined = marked.withColumn("size", F.octet_length("payload")).join(shared, ["sha", "size"], "left")
    return joined.select("page_id", "url", "payload", "keeper")


def record(page_id, url: str | None, payload: bytes, keeper) -> tuple[bytes, str]:
    """(record as a gzip member, payload digest)."""
    sum32 = digest(payload)
    revisit = keeper is not None and keeper != page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{sum32}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{keeper}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + packer.flush(), sum32


def parse(member: bytes) -> dict:
    """Fields and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("damaged record")
    _, _, payload = block.partition(b"\r\n\r\n")
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda key: int(x) if (x := fields.get(key, "<>")[1:-1].removeprefix(_ID)) else None
    size = int(fields["X-Payload-Length"])
    if kind == "response" and (digest(payload) != stated or len(payload) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": number("WARC-Refers-To"),
        "payload_bytes": size, "payload_digest": stated, "payload": payload if kind == "response" else None,
    }


def write(pages: DataFrame, where: str, least: int = LEAST) -> DataFrame:
    """Write archives below ``where``; the stored index, one row per record."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, path = work.open_store(where)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, work.SLICE):
                    part, rows = batch.slice(at, work.SLICE), []
                    for page_id, url, payload, keeper in zip(*(c.to_pylist() for c in part.columns)):
                        if out is None or offset > FILE_BYTES:
                            if out:
                                out.close()
                            name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                            store.create_dir(path, recursive=True)
                            out = store.open_output_stream(f"{path}/{name}", compression=None)
                        member, sum32 = record(page_id, url, payload, keeper)
                        out.write(member)
                        rows.append((name, offset, len(member), sum32))
                        offset += len(member)
                    files, offsets, lengths, sums = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), part.column(1), pa.array(sums, pa.string()), part.column(0)],
                        names=["file", "offset", "length", "url", "payload_digest", "page_id"],
                    )
        finally:
            if out:
                out.close()

    found = roles(pages, least).select("page_id", F.col("url").cast("string"), "payload", "keeper").mapInArrow(run, INDEX.format(id=kind))
    return work.store(found, "index")


def _ranges(batches: Iterator) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, [(offset, length)]): sorted index rows merged into reads."""
    file, start, end, held = None, 0, 0, []
    for batch in batches:
        for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and (name != file or offset - end > GAP or offset + length - start > READ):
                yield file, start, end, held
                held = []
            if not held:
                file, start = name, offset
            end = offset + length
            held.append((offset, length))
    if held:
        yield file, start, end, held


def read(spark: SparkSession, selected: DataFrame, where: str, payloads: bool = True) -> DataFrame:
    """The records that the selected index rows point at; ``payloads=False`` leaves payloads out."""
    kind = selected.schema["page_id"].dataType.simpleString()
    schema = FOUND.format(id=kind) if payloads else FOUND.format(id=kind).removesuffix(", payload binary")

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, path = work.open_store(where)
        at, source = None, None
        for file, start, end, members in _ranges(batches):
            if file != at:
                if source:
                    source.close()
                at, source = file, store.open_input_file(f"{path}/{file}")
            data = source.read_at(end - start, start)
            for k in range(0, len(members), work.SLICE):
                rows = [parse(data[o - start : o - start + n]) for o, n in members[k : k + work.SLICE]]
                if not payloads:
                    for row in rows:
                        del row["payload"]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if source:
            source.close()

    rows = selected.select("file", "offset", "length")
    # Tasks by the bytes to read: index rows are far smaller than the records they point at.
    tasks = -(-(rows.agg(F.sum("length")).first()[0] or 0) // TASK)
    tasks = max(1, min(100_000, max(tasks, spark.sparkContext.defaultParallelism)))
    ordered = rows.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, schema)


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all pages, then read every record back: FOUND's columns without payload, from the archives."""
    spark = pages.sparkSession
    where = work.folder(spark, "warc")
    return read(spark, write(pages, where, least), where, payloads=False).drop("url")


#: The same rows from SQL: SHA-1 in base32 from its hex digits, five at a time.
SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY sha, payload_bytes) AS keeper,
    list_transform(range(0, 8), lambda k: CAST('0x' || substr(sha, CAST(5 * k + 1 AS INT), 5) AS INT)) AS parts FROM p
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(parts, lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)
  ), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""
