"""WARC archives that are read by their index.

Each task writes one archive of gzip members, one a record, into the shared folder, and hands Spark the
index rows: archive, offset, length, URL and payload digest. The index is a table that Spark commits, so
what a lost or repeated task leaves behind is in no index and is never read. A read selects records from
the index, sorts them by place, joins neighbouring byte ranges and reads each range once.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, read_table

#: Payloads from this many bytes on are stored once.
REVISIT_FROM = 1000
#: Ranges nearer to each other than MAX_GAP are read as one; one range begins in MAX_RANGE bytes of its archive.
MAX_GAP, MAX_RANGE = 64 << 10, 4 << 20
#: A task begins another archive beyond this size.
ARCHIVE_BYTES = 128 << 20
#: Bytes of archives that one task reads back, as planned.
READ_BYTES = 32 << 20
CRLF = "\r\n"
_END = b"\r\n\r\n"
_INDEX = "page_id long, archive string, offset long, length long, url string, digest string, payload_bytes long, record_type string, refers_to long"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":/" in path else f"file://{path}")


def format_record(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes | None) -> bytes:
    """One WARC record: a response with its payload, or, given refers_to, a revisit without."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {size}".encode() + _END
    block = http if refers_to is not None else http + (payload or b"")
    header = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        header.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    header.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        header += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    header += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return CRLF.join(header).encode("utf-8", "surrogatepass") + _END + block + _END


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row of pages under path, and return the index, which is kept there too.

    path is in a store that pyarrow reaches from every executor: a shared folder, hdfs:// or s3://.
    Index: page_id, archive, offset, length, url, digest (SHA-1, hex), payload_bytes, record_type, refers_to.
    A null html is an empty payload; a null url gives a record without target. Of equal payloads of REVISIT_FROM
    bytes or more, the one with the largest id is a response and the others revisit it; rows that repeat that
    largest id are responses too. Extra columns of pages are not read. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    large = rows.filter(F.col("payload_bytes") >= REVISIT_FROM).select("page_id", "digest", "payload_bytes")
    stored = large.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = large.join(stored, ["digest", "payload_bytes"]).filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    decided = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "digest", "payload_bytes", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, store, folder = None, "", 0, *_store(f"{path}/archives")
        store.create_dir(folder, recursive=True)
        for batch in batches:
            places: list[tuple[str, int, int]] = []
            for i in range(batch.num_rows):
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                data = gzip.compress(format_record(*(batch.column(k)[i].as_py() for k in range(6))), 3, mtime=0)
                out.write(data)
                places.append((name, at, len(data)))
                at += len(data)
            kind = pa.array(["response" if x is None else "revisit" for x in batch.column(4).to_pylist()], pa.string())
            archive, offset, length = (pa.array([p[k] for p in places], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64())))
            columns = [batch.column(0), archive, offset, length, *batch.columns[1:4], kind, batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "archive", "offset", "length", "url", "digest", "payload_bytes", "record_type", "refers_to"])
        if out is not None:
            out.close()

    index = decided.mapInArrow(write, _INDEX)
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def parse_record(data: bytes) -> dict:
    """The headers, by lower-case name, and the payload of one record with its HTTP head taken off."""
    head, _, block = data.partition(_END)
    if not head.startswith(b"WARC/1.0\r\n") or not data.endswith(_END):
        raise ValueError("the index doesn't point at a record")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogateescape").split(CRLF)[1:])
    headers = {k.lower(): v for k, v in headers.items()}
    block = block[: int(headers["content-length"])]
    http, _, payload = block.partition(_END)
    return headers | {"payload": payload, "http": http}


def read_records(selected: DataFrame, path: str, max_gap: int = MAX_GAP, max_range: int = MAX_RANGE) -> DataFrame:
    """Read the records that rows of the index select: page_id, url, digest, record_type, refers_to, payload_bytes, payload (binary; null of a revisit).

    Everything returned comes from the archives. Each archive's selected records are sorted by offset and joined
    into ranges, which are read once each. Ranges are dealt by the bytes that they stand for, READ_BYTES a task, and
    over all cores where there is less: their own rows are tiny, so their number says nothing of the work.
    """
    by_place = Window.partitionBy("archive").orderBy("offset")
    end = F.col("offset") + F.col("length")
    ranged = selected.select("archive", "offset", "length").withColumn("gap", F.col("offset") - F.lag(end).over(by_place))
    ranged = ranged.withColumn("starts", (F.coalesce(F.col("gap") > max_gap, F.lit(True))).cast("int"))
    run = by_place.rowsBetween(Window.unboundedPreceding, 0)
    # a range is closed where a gap is, and wherever another max_range bytes of the archive begin
    ranged = ranged.withColumns({"stretch": F.sum("starts").over(run), "part": F.floor(F.col("offset") / max_range)})
    ranges = ranged.groupBy("archive", "stretch", "part").agg(F.min("offset").alias("from"), F.max(end).alias("to"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(f"{path}/archives")
        for batch in batches:
            for row in range(batch.num_rows):
                archive, start, stop, places = (batch.column(i)[row].as_py() for i in range(4))
                with store.open_input_file(f"{folder}/{archive}") as f:
                    data = f.read_at(stop - start, start)
                found = [parse_record(gzip.decompress(data[p["offset"] - start : p["offset"] - start + p["length"]])) for p in places]
                number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
                columns = [
                    [number(x.get("warc-record-id")) for x in found],
                    [x.get("warc-target-uri") for x in found],
                    [x["warc-payload-digest"].removeprefix("sha1:") for x in found],
                    [x["warc-type"] for x in found],
                    [number(x.get("warc-refers-to")) for x in found],
                    [int(re.search(rb"Content-Length: (\d+)", x["http"])[1]) for x in found],
                    [x["payload"] if x["warc-type"] == "response" else None for x in found],
                ]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "digest", "record_type", "refers_to", "payload_bytes", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    cores = selected.sparkSession.sparkContext.defaultParallelism
    size = selected.agg(F.sum("length")).first()[0] or 0
    ranges = ranges.select("archive", "from", "to", "places").repartition(max(cores, -(-size // READ_BYTES)), "archive", "from")
    return ranges.mapInArrow(read, "page_id long, url string, digest string, record_type string, refers_to long, payload_bytes long, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    index = write_archives(read_table(spark, sf_dir, "pages"), path)
    records = read_records(index, path)
    # a response's size and digest are taken from the payload as it was read back
    response = F.col("record_type") == "response"
    return records.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, html, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS stored FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN stored = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN stored = page_id THEN NULL ELSE stored END AS refers_to
FROM m
"""
