"""WARC archives without repeated payloads.

Each page gets one record. Headers (digest, length, id, url) are shuffled by payload digest, without payloads; of equal
payloads of at least MIN_BYTES the one with the smallest page id is a response, and the others become revisit records whose
fresh headers refer to it, for which headers are all that is needed. Pages that are not in that table of revisits are
written as responses: where it is small it is sent to them, else pages meet it by id and digest, which spreads a payload
that very many pages share. Spark's text writer puts the records into gzip files through its commit protocol, so a lost
executor costs only the rewriting of its files, and the archives may lie in any store that Spark can write.

Every record starts with the same two header lines: the version, and WARC-Warcinfo-ID with the archive's own UUID.
No payload can hold that UUID, which is drawn when the archive is written, so those lines split an archive into
records exactly and records stream one by one, whatever bytes their payloads hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch, table, written

MIN_BYTES = 100
CRLF = "\r\n"


def _urn(text: Column) -> Column:
    """A version-5 style UUID from a SHA-1."""
    h = F.sha1(text.cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes and payload_digest of each row, and html; a null payload is empty."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), html.alias("html"))


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest and refers_to of the pages whose payload an original has.

    The originals are pre-aggregated by digest before the shuffle, so a payload that a third of the pages share costs one
    row a task; only digests that occur more than once reach the join. Rows with the smallest page id of a digest are
    its originals, all of them if that id is repeated. A null page id is never an original: it revisits,
    or is a response where no other page has that payload.
    """
    head = headers(pages).drop("html").where(F.col("payload_bytes") >= min_bytes)
    first = head.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and refers_to is not null").drop("__n")
    return head.join(first, "payload_digest").where("page_id is null or page_id != refers_to").select("page_id", "url", "payload_bytes", "payload_digest", "refers_to")


def _one_line(c: Column) -> Column:
    """A header's value: line ends and backslashes are escaped, since a url may hold anything."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "\r", r"\\r"), "\n", r"\\n")


def _record_id(page_id: Column, digest: Column, archive: str) -> Column:
    return _urn(F.concat_ws("|", F.lit(archive), F.coalesce(page_id.cast("string"), F.lit("null")), digest))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write a WARC 1.1 record for each row of pages (page_id, url, html; others are not read) below path.

    Returns the archive's id, which read_archive() needs. Equal payloads of at least min_bytes are written once.
    """
    spark, archive = pages.sparkSession, f"urn:uuid:{uuid.uuid4()}"
    again, again_path = written(revisits(pages, min_bytes), "revisits")
    rest = headers(pages).join(again.select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest")).distinct(), F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left_anti")
    records = rest.withColumn("refers_to", F.lit(None).cast("long")).withColumn("record_type", F.lit("response")).unionByName(again.withColumn("html", F.lit("")).withColumn("record_type", F.lit("revisit")))
    _write_records(records, path, archive, date)
    discard(spark, again_path)
    return archive


def _write_records(resolved: DataFrame, path: str, archive: str, date: str) -> None:
    spark = resolved.sparkSession
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <{archive}>{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), F.col("payload_digest"), archive), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", _one_line(F.col("url"))), F.lit("")),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<"), _record_id(F.col("refers_to"), F.col("payload_digest"), archive), F.lit(">"))))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
    )
    body = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    record = F.concat(head, line("Content-Length", F.octet_length(body).cast("string")), F.lit(CRLF), body, F.lit(CRLF))
    info = f"software: binmine{CRLF}format: WARC File Format 1.1{CRLF}"
    first = f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <{archive}>{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <{archive}>{CRLF}WARC-Date: {date}{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(info)}{CRLF * 2}{info}{CRLF}"
    out = resolved.select(record.alias("value")).unionByName(spark.createDataFrame([(first,)], "value string"))
    out.write.option("lineSep", CRLF).option("compression", "gzip").text(path)


def read_archive(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Headers and payloads of an archive's response and revisit records, one row each.

    ok tells whether a response's payload has the digest and the length that its headers state (null for revisits).
    """
    start = f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <{archive}>{CRLF}"
    raw = spark.read.option("lineSep", start).text(path).where("value != ''").select(F.substring_index("value", CRLF * 2, 1).alias("head"), F.col("value").cast("binary").alias("raw"))
    field = lambda name: F.nullif(F.regexp_extract(F.concat(F.lit(CRLF), "head", F.lit(CRLF)), rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    block_at = F.octet_length("head") + 4
    rec = raw.select(
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("refers_to_id"),
        field("X-Page-ID").cast("long").alias("page_id"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        F.substring("raw", block_at + 1, field("Content-Length").cast("int")).alias("block"),
    ).where("record_type in ('response', 'revisit')")
    http = F.substring_index(F.decode(F.substring("block", 1, 400), "iso-8859-1"), CRLF * 2, 1)
    rec = rec.withColumn("payload_bytes", F.regexp_extract(http, r"\r\nContent-Length: (\d+)", 1).cast("long")).withColumn("payload", F.when(F.col("record_type") == "response", F.expr("substring(block, octet_length(substring_index(decode(substring(block, 1, 400), 'iso-8859-1'), '\\r\\n\\r\\n', 1)) + 5)")))
    return rec.withColumn("ok", F.when(F.col("record_type") == "response", (F.sha2("payload", 256) == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes")))).drop("block")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Join revisit records to the responses that they refer to: page_id, sizes, digest, type, refers_to (a page id).

    A revisit whose original is missing has no refers_to and is not ok, as one whose digest or length is not its original's.
    """
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes")).dropDuplicates(["refers_to_id"])
    responses = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    revisits = records.where("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "ok"]
    return responses.select(cols).unionByName(revisits.withColumn("ok", F.coalesce((F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__bytes")), F.lit(False))).select(cols))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as a deduplicated archive in the shared folder and read it back."""
    path = scratch(spark, "warc")
    archive = write_archive(table(spark, sf_dir, "pages"), path)
    records, _ = written(read_archive(spark, path, archive).drop("payload"), "records")  # payloads are verified and left
    return resolve_revisits(records)
