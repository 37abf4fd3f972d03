"""WARC archives, index first.

Writing tasks stream records into one archive file each, every record a gzip member of its own, and return one
index row a record: file, offset, length, URL, digest, type. Files carry a random name, and only files that the index
names count, so what a failed or repeated attempt leaves behind is never read. Reading starts from the index: the
wanted rows are grouped into stretches of a file, sorted by offset, and neighbouring ranges are fetched in one read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes
from millrace.scratch import fresh_path, settle

MIN_REVISIT, GAP, STRETCH = 100, 1 << 16, 1 << 23
INDEX = "file string, offset long, length long, page_id {}, url string, payload_bytes long, digest string, record_type string, refers_to {}"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _name(page_id: object) -> str:
    """Percent-encoded, so that an id may hold any character; a null id has a name of its own."""
    return "<urn:page-without-id>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    block = b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {''.join(url.split())}")
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record a row and return the index, itself a written table.

    Of the rows whose payloads are equal and at least min_revisit bytes long, that with the smallest id is a response and the
    others revisit it; shorter payloads are responses each. Null html is an empty payload, a null url leaves the header
    out, rows with a null id revisit like others but are never referred to; rows that repeat an id and a payload are records
    of their own, of which none refers to itself; an empty table writes an empty index. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(as_bytes(html_col), F.lit(b"")).alias("payload"))
    marks = own.where(F.octet_length("payload") >= min_revisit).select("page_id", F.sha2("payload", 256).alias("digest"))
    first = marks.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    again = marks.join(first, "digest").where("page_id is null or page_id <> first").select(F.col("page_id").alias("again"), F.col("digest").alias("of"), "first").distinct()
    ready = own.join(again, F.col("page_id").eqNullSafe(F.col("again")) & (F.sha2("payload", 256) == F.col("of")), "left").select("page_id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        file, out, offset = "", None, 0
        try:
            for batch in batches:
                rows = []
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    for page, url, payload, ref in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        if out is None:
                            file = f"{uuid.uuid4().hex}.warc.gz"
                            out = store.open_output_stream(f"{base}/{file}", compression=None)
                        digest = hashlib.sha256(payload).hexdigest()
                        data = gzip.compress(record(page, url, payload, digest, ref, date), 6, mtime=0)
                        out.write(data)
                        rows.append((f"{folder}/{file}", offset, len(data), page, url, len(payload), digest, "response" if ref is None else "revisit", ref))
                        offset += len(data)
                names = ["file", "offset", "length", "page_id", "url", "payload_bytes", "digest", "record_type", "refers_to"]
                key = batch.schema.field(0).type
                types = [pa.string(), pa.int64(), pa.int64(), key, pa.string(), pa.int64(), pa.string(), pa.string(), key]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return settle(ready.mapInArrow(write, INDEX.format(kind, kind)), "warc-index")


def read_records(index: DataFrame, gap: int = GAP, stretch: int = STRETCH) -> DataFrame:
    """(file, offset, page_id, target_uri, record_type, refers_to, digest, block binary) of the index rows given, in any selection.

    Rows are grouped by file and by ``stretch`` bytes of it, so a group is bounded by the stretch and one record; in a group,
    ranges less than ``gap`` bytes apart are fetched as one.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, handle = None, None
        for batch in batches:
            wanted = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            at = 0
            while at < len(wanted):
                file, start, length = wanted[at]
                end, stop = start + length, at + 1
                while stop < len(wanted) and wanted[stop][0] == file and 0 <= wanted[stop][1] - end <= gap and wanted[stop][1] + wanted[stop][2] - start <= stretch:
                    end, stop = wanted[stop][1] + wanted[stop][2], stop + 1
                if file != open_file:
                    store, path = _open(file)
                    open_file, handle = file, store.open_input_file(path)
                data = handle.read_at(end - start, start)
                rows = []
                for k in range(at, stop):
                    off, size = wanted[k][1] - start, wanted[k][2]
                    headers, block = parse(zlib.decompress(data[off : off + size], wbits=31))
                    rows.append((file, wanted[k][1], headers["warc-record-id"], headers.get("warc-target-uri"), headers["warc-type"], headers.get("warc-refers-to"), headers["warc-payload-digest"].partition(":")[2], block))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary()], strict=True)], names=["file", "offset", "record_id", "target_uri", "record_type", "refers", "digest", "block"])
                at = stop

    key = F.floor(F.col("offset") / stretch)
    n = F.pmod(F.xxhash64("file", key), F.lit(1 << 20))
    dealt = index.select("file", "offset", "length").repartition(n).sortWithinPartitions("file", "offset")
    found = dealt.mapInArrow(fetch, "file string, offset long, record_id string, target_uri string, record_type string, refers string, digest string, block binary")
    ident = lambda c: F.when(c.rlike("^<urn:page:.*>$"), F.url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1)))
    return found.select("file", "offset", ident(F.col("record_id")).alias("page_id"), "target_uri", "record_type", ident(F.col("refers")).alias("refers_to"), "digest", "block")


def round_trip(spark: SparkSession, pages: DataFrame, **kw) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives that were just written.

    Bytes and digests are computed from the blocks read; a revisit takes them from the response that it names.
    """
    index = write_archives(pages, **kw)
    kind = index.schema["page_id"].dataType
    read = read_records(index).select(F.col("page_id").cast(kind).alias("page_id"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "digest", F.octet_length("block").cast("long").alias("n"), F.sha2("block", 256).alias("sha"))
    read = settle(read, "warc-read")
    full = read.where("record_type = 'response'").select("page_id", "record_type", "refers_to", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"))
    again = read.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", F.col("digest").alias("payload_digest"))
    named = full.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    back = again.join(named, ["refers_to", "payload_digest"]).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return full.unionByName(back).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
