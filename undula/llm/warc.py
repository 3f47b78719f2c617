"""WARC archives with revisit records.

Headers alone (id, digest, length) are shuffled by payload digest; of the records with one payload one is the response
and the others revisit it. The records, with fresh headers, are then written through Spark's writer: its text format
with the record's end as the line's end is a WARC file byte for byte, committed as any other job's output. Reading
parses the files and joins each revisit to the response that it refers to.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import materialize

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 16 << 20


def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def base32(sha1: Column) -> Column:
    """The same for a column of hexadecimal SHA-1 digests: 8 letters for every 10 hexadecimal digits."""
    letters = F.split(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "")
    parts = [F.conv(F.substring(sha1, 10 * k + 1, 10), 16, 10).cast("long") for k in range(4)]
    return F.concat(*[F.element_at(letters, (F.shiftright(parts[i // 8], 35 - 5 * (i % 8)).bitwiseAND(31) + 1).cast("int")) for i in range(32)])


def revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers(page_id, sha1, n_bytes) -> (page_id, sha1, refers_to) of the records that are revisits.

    Among records of one payload of at least min_bytes the largest page_id is the response; a null id is smaller than any.
    Records that share the largest id, or null ids alone, are all responses.
    """
    responses = headers.where(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    found = headers.join(responses.where("n > 1").drop("n"), "sha1")
    return found.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha1", "refers_to").distinct()


def _record(page_id, url, payload: bytes, sha1: str, refers_to, date: str) -> bytes:
    digest, http = base32_of_hex(sha1), b""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    else:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE, file_bytes: int = FILE_BYTES) -> None:
    """A record for every row of pages. A null payload is empty, a null url gives no target URI, a null id an empty one."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    headers = materialize(rows.select("page_id", "sha1", F.octet_length("payload").alias("n_bytes")), "warc-headers")
    mean = headers.agg(F.avg("n_bytes")).first()[0] or 1.0
    decided = revisits(headers, min_bytes).select(F.col("page_id").alias("p"), F.col("sha1").alias("d"), "refers_to")
    # only headers travel to a revisit: its payload stays where it is read
    typed = rows.join(decided, rows["page_id"].eqNullSafe(decided["p"]) & (rows["sha1"] == decided["d"]), "left")
    slim = typed.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "sha1", "refers_to")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([_record(*x, date) for x in some], pa.binary())], ["record"])

    records = slim.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, int(file_bytes / (mean + 512)))).text(path)


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:] if ": " in x)}
        stop = end + 4 + int(head["content-length"])
        yield head, data[end + 4 : stop]
        at = stop + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest as the header has it, refers_to, payload: null for a revisit) per record."""
    schema = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary"

    def number(urn: str | None) -> int | None:
        value = (urn or "").rpartition(":")[2].rstrip(">")
        return int(value) if value else None

    def run(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa

        names, kinds = [x.split()[0] for x in schema.split(", ")], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for i in range(b.num_rows):
                content, held, size = gzip.decompress(b.column(0)[i].as_py()), [], 0
                for head, block in _parse(content):
                    revisit = head["warc-type"] == "revisit"
                    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                    held.append((number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), number(head.get("warc-refers-to")), payload))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records(page_id, record_type, payload_digest, refers_to, payload_bytes) with a revisit's payload_bytes taken from the
    response that it refers to, by id and digest; null where the archives don't hold that response."""
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("held")).where("refers_to is not null").distinct()
    return records.join(held, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "held")).drop("held")
