"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing comes with an index of one row a record: file, offset, length, URL and payload digest. Whatever is
to be read is selected from the index first. The selected records are dealt out by file and region, sorted,
and neighbouring ones are fetched in one read.

Records are gzip members of their own. The payload of a page is the HTTP body of its record. Of records with
equal payloads of a certain size, the one with the smallest page id is a response; the others are revisits,
which hold HTTP headers alone and refer to it.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import fresh_dir, stage
from .arrow import open_fs, small

_INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
_DATE = b"2000-01-01T00:00:00Z"


def _line(text: str) -> bytes:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").encode()


def _urn(page: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page is None else b"%d" % page)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed; a revisit if it refers to a page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _urn(page), b"WARC-Date: " + _DATE]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _line(url))
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _urn(refers_to)]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """A record's fields; payload is None and payload_bytes as announced for a revisit."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    http, _, payload = rest[: int(fields[b"Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields[b'WARC-Record-ID']!r}")

    def page(name: bytes) -> int | None:
        text = fields.get(name, b"<urn:page:null>")[10:-1]
        return None if text == b"null" else int(text)

    url = fields.get(b"WARC-Target-URI")
    url = None if url is None else url.decode().replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"page_id": page(b"WARC-Record-ID"), "url": url, "record_type": kind, "payload_digest": digest, "payload_bytes": size, "payload": None if kind == "revisit" else payload, "refers_to": page(b"WARC-Refers-To") if kind == "revisit" else None}


def _write(folder: str, level: int, file_bytes: int):
    def run(batches):
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in small(batches, "payload"):
                rows = []
                for page, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0  # a retried task writes files of its own
                        out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    revisit = first is not None and page != first
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(record(page, url, payload, digest, first if revisit else None)) + packer.flush()
                    out.write(member)
                    rows.append((page, url, digest, "revisit" if revisit else "response", name, offset, len(member)))
                    offset += len(member)
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                names = [part.split()[0] for part in _INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, level: int = 3, file_bytes: int = 1 << 30) -> DataFrame:
    """Write a record for each row below folder, which all executors share, and return the index as a staged table.

    A null html is an empty payload. Payloads below least_bytes are never revisits. Rows that repeat the
    smallest id of a group are responses, as is every row of a group without any id; a null id counts as
    larger than all others. A null URL is left out of the record. Other columns are not read.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stage(groups.select("digest", "first"), "first_of_equals")
    marked = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", "first")
    return stage(marked.mapInArrow(_write(folder, level, file_bytes), _INDEX), "index")


def _read(folder: str, gap: int, span: int, with_payload: bool):
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "payload", "refers_to"]
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64())

    def run(batches):
        fs, top = open_fs(folder)
        name, source = None, None
        for batch in batches:
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            at = 0
            while at < len(wanted):
                file, start, length = wanted[at]
                stop, upto = start + length, at + 1
                while upto < len(wanted) and wanted[upto][0] == file and wanted[upto][1] - stop <= gap and wanted[upto][1] + wanted[upto][2] - start <= span:
                    stop = max(stop, wanted[upto][1] + wanted[upto][2])
                    upto += 1
                if file != name:
                    name, source = file, fs.open_input_file(f"{top}/{file}")
                data = source.read_at(stop - start, start)
                found = [parse(data[o - start : o - start + n]) for _, o, n in wanted[at:upto]]
                columns = [[None if c == "payload" and not with_payload else f[c] for f in found] for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                at = upto

    return run


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, span: int = 4 << 20, region: int = 16 << 20, with_payload: bool = True, task_bytes: int = 64 << 20) -> DataFrame:
    """The records of the rows of index: page_id, url, record_type, payload_digest, payload_bytes, payload, refers_to.

    Reads skip at most gap bytes and take at most span, or one record. Payloads are checked against their
    digests. The number of tasks follows the bytes to be read, of which the index's own size says nothing.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / task_bytes))
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / region)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(folder, gap, span, with_payload), "page_id long, url string, record_type string, payload_digest string, payload_bytes long, payload binary, refers_to long")


def op1(spark, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
