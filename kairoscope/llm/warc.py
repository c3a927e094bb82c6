"""WARC archives: written with an index, read back by coalesced byte ranges.

``write_archives`` writes one gzip member per record, so that every record can be read alone, and
returns the index: file, offset, length, url, digest and id of each record. ``read_records`` takes
any selection of index rows, sorts it by file and offset, joins near ranges into one read, and
yields the parsed records. Archives lie in a folder that all executors share; a task's file has a
name of its own and only the rows of successful attempts name it, so a lost executor leaves at
most a file that no index row points to.

Null payloads and urls count as empty. Repeated ids each get a record. Of equal payloads of at
least ``MIN_REVISIT`` bytes, the largest id is the response and the others revisit it (among rows
with that id too: equal rows are all the response). An empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.joins import salted_join
from kairoscope.session import materialise, scratch_path

MIN_REVISIT = 1_000
#: Rows of one repeated payload that a task gets where there are many such payloads.
PAYLOAD_ROWS = 1_000
#: Two selected records are read at once if no more bytes than this lie between them; a read stays below the second.
GAP, MOST = 64 << 10, 8 << 20
#: Bytes of archives that a task reads back.
STRETCH = 4 << 20
INDEX_SCHEMA = "page_id long, url string, record_type string, digest string, file string, offset long, length long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to: for a revisit the id of the response with the same payload, else null."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    slim = rows.select("page_id", F.octet_length("payload").alias("n"), F.sha1("payload").alias("digest")).where(F.col("n") >= MIN_REVISIT)
    # Only digests that occur again matter; a count first keeps single pages out of the join.
    again = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    again = materialise(again, "repeated-payloads")
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= MIN_REVISIT, F.sha1("payload")))
    rows = salted_join(rows, again, "digest", F.concat_ws(" ", "page_id", "url"), most=PAYLOAD_ROWS)  # of few repeated payloads none moves
    return rows.select("page_id", "url", "payload", F.when(F.col("refers_to") > F.col("page_id"), F.col("refers_to")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    """A record's id follows from its page and payload, so that a revisit can name the one that it refers to; equal rows have equal ids."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def _record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> tuple[bytes, str, str]:
    """One uncompressed record, its type and its digest."""
    sha = hashlib.sha1(payload)
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, sha.hexdigest())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest: sha1:" + base64.b32encode(sha.digest()).decode(),
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    block = HTTP % len(payload) + payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha.hexdigest())}", f"X-Refers-To-Page-Id: {refers_to}"]
        block = HTTP % len(payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", kind, sha.hexdigest()


def parse_record(raw: bytes) -> dict:
    """The fields of one uncompressed record; the payload of a response is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    whole = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": whole("X-Page-Id"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": whole("X-Refers-To-Page-Id"), "payload_bytes": len(payload) if payload is not None else whole("X-Payload-Length"), "payload_digest": digest, "payload": payload}


def write_archives(classified: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes classify()'s rows below ``folder``, one archive a task, and returns the index, itself stored there."""
    spark = classified.sparkSession
    folder = folder or scratch_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                raw, kind, digest = _record(r["page_id"], r["url"], r["payload"], r["refers_to"])
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = z.compress(raw) + z.flush()
                if out is None:
                    store, path = fs.FileSystem.from_uri(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                out.write(member)
                rows.append({"page_id": r["page_id"], "url": r["url"], "record_type": kind, "digest": digest, "file": name, "offset": at, "length": len(member)})
                at += len(member)
            if rows:
                out.flush()
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
        if out is not None:
            out.close()

    return materialise(classified.mapInArrow(write, INDEX_SCHEMA), "warc-index")


_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> Iterator[list[tuple[int, int]]]:
    """Groups of sorted (offset, length) that are read at once."""
    group: list[tuple[int, int]] = []
    for offset, length in ranges:
        if group and (offset - sum(group[-1]) > gap or offset + length - group[0][0] > most):
            yield group
            group = []
        group.append((offset, length))
    if group:
        yield group


def read_records(index: DataFrame, with_payload: bool = True, stretch: int = STRETCH) -> DataFrame:
    """The records that ``index`` selects. A task reads about ``stretch`` bytes that follow each other in few archives."""
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // stretch))
    chosen = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, store = None, None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(files):
                end = at
                while end < len(files) and files[end] == files[at]:
                    end += 1
                if files[at] != name:
                    name = files[at]
                    store, path = fs.FileSystem.from_uri(name)
                    stream = store.open_input_file(path)
                for group in coalesce_ranges(list(zip(offsets[at:end], lengths[at:end], strict=True))):
                    base = group[0][0]
                    stream.seek(base)
                    raw = stream.read(sum(group[-1]) - base)
                    rows = [parse_record(zlib.decompress(raw[o - base : o - base + n], 31)) for o, n in group]
                    if not with_payload:
                        rows = [r | {"payload": None} for r in rows]
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                at = end

    return chosen.mapInArrow(read, RECORD_SCHEMA)


def archive_roundtrip(pages: DataFrame) -> DataFrame:
    """Writes an archive record for every page, selects all of them in the index and reads them back."""
    index = write_archives(classify(pages))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
