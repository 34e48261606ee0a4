"""WARC archives: writing with payload revisits, and reading back by boundary-chain verification.

Writing: Spark's text writer puts records into archives, several files of bounded size; the record separator of the
format is the line separator of the writer. Pages with equal payloads share one response record, that of the smallest
page id, and the others become revisit records without a body.

Reading: every place where the magic string stands is only a candidate, since a payload may hold it too. Tasks emit each
candidate with the offset of its successor; pointer jumping from the start of every file then finds the candidates that
lie on the chain of true records, in a number of rounds that is the logarithm of the records in a file. A file whose chain
does not end at its size (cut off, or with a length that is not the record's) is an error; it is never read in part.

Defined cases: a null html is an empty payload; a null url is written as an empty target; line breaks in a url are
dropped; rows with a null page id are not written; rows that repeat a page id are records of their own; an empty table
gives no archive and no record; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, cut, new_path

ARCHIVE_BYTES = 16 << 20
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
END = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 5 hexadecimal digits are 4 base-32 digits."""
    digits = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.upper(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, payload_bytes, digest, refers_to): refers_to is the response's id for a revisit, else null."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\r\n]", "").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    # Only groups of equal payloads are joined back, on the digest and the size.
    first = cut(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    few = first.count() <= BROADCAST_KEYS  # then the payloads need no shuffle for this
    return rows.join(F.broadcast(first) if few else first, ["digest", "payload_bytes"], "left").withColumn("refers_to", F.when(F.col("first") < F.col("id"), F.col("first"))).drop("first")


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the rows of records() as archives of about archive_bytes."""
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(""))
    block = F.concat(F.lit(HTTP), body)
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), head("WARC-Type", kind), head("WARC-Record-ID", urn("id")), head("WARC-Target-URI", F.col("url")), head("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), head("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("refers_to").isNotNull(), F.concat(head("WARC-Refers-To", urn("refers_to")), head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        head("Content-Type", F.lit("application/http; msgtype=response")), head("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )
    total = rows.agg(F.sum(F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0) + 700)).first()[0] or 0
    rows.repartition(max(1, -(-int(total) // archive_bytes)), "id").select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def parse(content: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """(headers, start of the block, end of the block) of a record that may begin at `at`, if it can be one."""
    stop = content.find(END, at)
    if stop < 0:
        return None
    heads = {}
    for line in content[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        heads[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = heads.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return None
    begin = stop + len(END)
    end = begin + int(size)
    return (heads, begin, end) if content[end : end + len(END)] == END else None


CANDIDATES = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("next", pa.int64()), ("size", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def candidate_batches(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    urn = re.compile(r"<urn:page:(-?\d+)>")
    number = lambda text: int(m[1]) if (m := urn.fullmatch(text or "")) else None
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            content = content.as_py()
            out: list[dict] = [{"file": file, "size": len(content)}]  # a row for the file itself, without an offset
            for m in MAGIC.finditer(content):
                if not (got := parse(content, m.start())):
                    continue
                heads, begin, end = got
                split = content.find(END, begin, end)
                payload = content[split + len(END) : end] if split >= 0 else b""
                kind = heads.get("warc-type")
                row = {"file": file, "offset": m.start(), "next": end + len(END), "size": len(content), "page_id": number(heads.get("warc-record-id")), "record_type": kind, "url": heads.get("warc-target-uri"), "payload": payload if with_payload else None}
                if kind == "revisit":
                    size = heads.get("x-payload-length", "")
                    row |= {"payload_bytes": int(size) if size.isdigit() else None, "payload_digest": heads.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": number(heads.get("warc-refers-to"))}
                else:
                    row |= {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, CANDIDATES)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The true records of the archives under path: file, offset, page_id, record_type, url, payload_bytes, payload_digest, refers_to, payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    schema = "file string, offset long, next long, size long, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    rows = cut(files.mapInArrow(lambda it: candidate_batches(it, with_payload), schema), "candidates")
    found = rows.where("offset is not null")
    jumps = found.select("file", "offset", F.when(F.col("next") < F.col("size"), F.col("next")).alias("jump"), (F.col("offset") == 0).alias("reached"))
    while not jumps.where("reached and jump is not null").isEmpty():
        ahead = jumps.select("file", F.col("offset").alias("jump"), F.col("jump").alias("further"))
        doubled = jumps.join(ahead, ["file", "jump"], "left").select("file", "offset", F.col("further").alias("jump"), "reached")
        marked = jumps.where("reached and jump is not null").select("file", F.col("jump").alias("offset"), F.lit(None).cast("long").alias("jump"), F.lit(True).alias("reached"))
        jumps = cut(doubled.unionByName(marked).groupBy("file", "offset").agg(F.max("jump").alias("jump"), F.max("reached").alias("reached")), "jumps")
    reached = jumps.where("reached").select("file", "offset", "reached")
    whole = F.max(F.coalesce(F.col("reached") & (F.col("next") == F.col("size")), F.lit(False)))
    ends = rows.select("file", "offset", "next", "size").join(reached, ["file", "offset"], "left").groupBy("file").agg(whole.alias("whole"))
    broken = ends.where("not whole").limit(3).collect()
    if broken:
        raise ValueError(f"archives whose records do not lead to their end: {', '.join(r.file for r in broken)}")
    return found.join(reached, ["file", "offset"], "left_semi").drop("next", "size")


def archive_round_trip(pages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write pages as archives (to path, or a new place in the shared folder) and read the records back."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(records(pages, **kw), path)
    return read_archives(spark, path, with_payload=False)
