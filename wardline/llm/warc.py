"""WARC archives: written by Spark tasks, indexed record by record, and read back by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import put_down, text_or_empty
from wardline.session import scratch_path

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

_INDEX = "file string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def open_store(uri: str):
    """(file system, path) of a folder's URI, for tasks that write or read byte ranges themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^(file|hdfs):/(?!/)", r"\1:///", re.sub(r"^s3[an]:", "s3:", uri)))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    digits = (record or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def format_record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    """A response record with its payload, or a revisit record with HTTP headers only."""
    block = HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload) + (b"" if is_revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}"]
    if url is not None:  # white space and controls cannot stand in a header
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(digest)).decode()}"]
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, payload after the HTTP headers)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to, is_revisit`` for every row of ``pages``.

    Of rows with equal payloads of at least ``least_bytes`` that with the largest id is the response and the others
    revisit it.  Copies are folded per digest before the shuffle; only the revisits return to the pages.
    """
    body = text_or_empty("html").cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "payload_digest")
    kept = large.groupBy(F.col("payload_digest").alias("digest")).agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    kept = kept.where((F.col("n") > 1) & F.col("kept").isNotNull())
    again = large.join(kept, (F.col("payload_digest") == F.col("digest")) & ~F.col("page_id").eqNullSafe(F.col("kept")))
    again = again.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "kept").distinct()
    same = rows["page_id"].eqNullSafe(F.col("r_id")) & (rows["payload_digest"] == F.col("r_digest"))
    return rows.join(again, same, "left").select(
        "page_id", "url", "payload", "payload_digest", F.col("kept").alias("refers_to"), F.col("kept").isNotNull().alias("is_revisit")
    )


def write_archives(records: DataFrame, folder: str, file_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write :func:`plan_records` rows as ``.warc.gz`` files under ``folder``; returns the stored index.

    Every record is a gzip member.  The index has ``file, offset, length, url, payload_digest, page_id, record_type``
    per record.  A task writes files of its own name and reports them through the index, which Spark commits: what a
    lost or repeated task left behind is in no index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in (dict(zip(batch.schema.names, values)) for values in zip(*batch.columns)):
                    page_id, url, digest, refers_to, again = (r[k].as_py() for k in ("page_id", "url", "payload_digest", "refers_to", "is_revisit"))
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    record = format_record(page_id, url, r["payload"].as_py(), digest, refers_to, again, date)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record) + packer.flush()
                    out.write(member)
                    rows.append((name, at, len(member), url, digest, page_id, "revisit" if again else "response"))
                    at += len(member)
                columns = list(zip(*rows)) or [()] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                names = ["file", "offset", "length", "url", "payload_digest", "page_id", "record_type"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        finally:
            if out is not None:
                out.close()

    return put_down(records.mapInArrow(run, _INDEX), "warc-index")


def coalesce_ranges(selected: DataFrame, block_bytes: int = 4 << 20, gap_bytes: int = 64 << 10) -> DataFrame:
    """``file, start, stop, records``: reads that cover the selected index rows.

    Rows are sorted by offset inside stretches of ``block_bytes`` of a file; a gap of more than ``gap_bytes`` between
    selected records starts a new read.  A stretch bounds both the read and its list of records (offset, length).
    """
    stretch = F.floor(F.col("offset") / F.lit(block_bytes))
    inside = Window.partitionBy("file", "stretch").orderBy("offset")
    rows = selected.select("file", "offset", "length", stretch.alias("stretch")).distinct()
    before = F.max(F.col("offset") + F.col("length")).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("offset") - before > gap_bytes, 1).otherwise(0))
    rows = rows.withColumn("read", F.sum("new").over(inside))
    return rows.groupBy("file", "stretch", "read").agg(
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"),
    ).select("file", "start", "stop", "records")


def read_records(selected: DataFrame, folder: str, with_payload: bool = True, task_bytes: int = 64 << 20) -> DataFrame:
    """The records of the selected index rows: ``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload``.

    A response's digest and size are computed from the payload as read; a digest that differs from the record's header
    raises.  A revisit has its header's digest and no size or payload.  ``url`` is as written in the archive.  A task reads
    about ``task_bytes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        names = [c.split()[0] for c in _RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for file, start, stop, places in zip(*batch.to_pydict().values()):
                with store.open_input_file(f"{root}/{file}") as f:
                    data = memoryview(f.read_at(stop - start, start))
                rows = []
                for place in places:
                    at = place["offset"] - start
                    record = zlib.decompress(data[at : at + place["length"]], 31)
                    headers, payload = parse_record(record)
                    kind, header = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        raw = hashlib.sha1(payload).digest()
                        if b32encode(raw).decode() != header:
                            raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
                    else:
                        raw, payload = b32decode(header), None
                    rows.append(
                        (
                            page_of(headers["warc-record-id"]),
                            headers.get("warc-target-uri"),
                            kind,
                            page_of(headers.get("warc-refers-to")),
                            raw.hex(),
                            None if payload is None else len(payload),
                            payload if with_payload else None,
                        )
                    )
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    # the table of reads is tiny beside what is read, so its own size must not decide the number of tasks
    stored = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-stored // task_bytes))
    return coalesce_ranges(selected).repartition(tasks, "file", "start").mapInArrow(run, _RECORD)


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000) -> DataFrame:
    """Write every row of ``pages`` to WARC files, read the files back, and resolve revisits.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``, all from the records as read; a
    revisit's size comes from the response that it refers to.  ``folder`` defaults to a new one under
    ``spark.checkpoint.dir``; any URI that pyarrow opens will do.

    A null html is an empty payload, a null url leaves out the header.  Null ids are written as such: a null id revisits
    a payload that another id has too, else it is a response.  Rows that repeat id and payload are all responses if theirs is
    the largest id.  No rows give no rows and no files.  Other columns are ignored.
    """
    folder = folder or scratch_path(pages.sparkSession, f"warc-{uuid.uuid4().hex}")
    index = write_archives(plan_records(pages, least_bytes), folder)
    records = put_down(read_records(index, folder, with_payload=False), "warc-records")
    full = records.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes))
    full = full.groupBy(F.col("page_id").alias("o_id"), F.col("payload_digest").alias("o_digest")).agg(F.max("payload_bytes").alias("o_bytes"))
    same = (F.col("refers_to") == F.col("o_id")) & (F.col("payload_digest") == F.col("o_digest"))
    revisits = records.where("record_type = 'revisit'").join(full, same, "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    resolved = revisits.withColumn("payload_bytes", F.col("o_bytes")).select(columns)
    return records.where("record_type = 'response'").select(columns).union(resolved)
