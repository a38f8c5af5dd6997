"""A content-addressed WARC archive.

``archive`` writes two tables to the shared folder: *payloads* holds the bytes of each
distinct payload once, under its SHA-256, and *heads* holds for each record the exact bytes
that stand before its payload (WARC headers, and the HTTP head of its block). Of equal
payloads, the records with the largest page_id are responses; the others are revisits
that refer to one of those and have no payload in their block.

``records`` puts the original records together again: heads joined with payloads by page_id and
digest. ``read`` does that, and parses and checks each whole record: the lengths that the WARC and
HTTP heads declare against the bytes there are, and the payload against both digests.
Payload bytes are shuffled once, when the response's copy is picked, and bucketed as they
were dealt out, so the join in reading moves heads only. Revisits learn of their payload from what
was measured of the response, by record id. A digest or response that
many records share is split off, counted first (``plans.joins``).
``write_files`` gives ordinary .warc files, ``read_files`` reads such.

Defined results: each row of pages is a record, repeated ones too, with an id of its own; rows that
repeat the largest page_id of a payload are all responses, and the revisits refer to the one with the
greatest record id. A null html is an empty payload, and empty payloads are equal. A null url is
written as an empty target. A null page_id is smaller than all others. Very long payloads are rows like
others. An empty table gives no rows. Other columns are ignored, whatever their names. A record whose
bytes don't agree with its head, or whose response is missing, is there with ``verified`` false.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import join_dealt
from . import storage

CRLF = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(1 << 63)
KEYS = ["page_id", "digest"]


@dataclass
class Archive:
    heads: DataFrame  # page_id, digest, revisit, head; null page_ids are NO_ID
    payloads: DataFrame  # page_id (of the responses), digest, payload


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id() -> Column:
    """A urn:uuid for a record: of its page_id, url, digest and row."""
    page = F.coalesce(F.nullif(F.col("page_id"), F.lit(NO_ID)).cast("string"), F.lit("none"))
    h = F.md5(F.concat(F.lit("record "), page, F.lit(" "), F.col("digest"), F.lit(" "), F.col("row").cast("string"), F.coalesce(F.concat(F.lit(" "), F.col("url")), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _head(date: str) -> Column:
    """The bytes of a record before its payload."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    length = F.length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id()),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {REVISIT}")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), F.col("response.id"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), http).cast("binary")


def archive(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Write the pages (page_id, url, html) as records; see the module."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    page = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id")
    facts = pages.select(page, F.col("url").cast("string").alias("url"), payload.alias("payload")).select("page_id", "url", F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    facts = storage.keep(facts.withColumn("row", F.monotonically_increasing_id()), "warc-facts")
    chosen = facts.groupBy("digest").agg(F.max(F.struct("page_id", record_id().alias("id"))).alias("response"))
    heads = join_dealt(facts, chosen, "digest", spread="row", how="left").withColumn("revisit", F.col("page_id") != F.col("response.page_id"))
    heads = storage.keep(heads.select("page_id", "digest", "revisit", _head(date).alias("head")), "warc-heads")
    picked = heads.where("not revisit").select("page_id", "digest").distinct()
    # a digest has one page_id here, and of its rows one payload is stored; equal rows meet before the shuffle
    found = pages.select(page, payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).dropDuplicates(KEYS).join(picked, KEYS, "left_semi")
    return Archive(heads, storage.keep_bucketed(found.select(*KEYS, "payload"), "warc-payloads", KEYS))


def _responses(stored: Archive) -> DataFrame:
    """page_id, digest, head, record: the whole records of responses, byte for byte."""
    own = stored.heads.where("not revisit").select(*KEYS, "head").join(stored.payloads, KEYS, "left")
    return own.select(*KEYS, "head", F.concat("head", F.coalesce("payload", F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record"))


def records(stored: Archive) -> DataFrame:
    """page_id and record: the whole records, byte for byte."""
    again = stored.heads.where("revisit").select("page_id", F.concat("head", F.lit(b"\r\n\r\n")).alias("record"))
    return _responses(stored).select("page_id", "record").unionByName(again).withColumn("page_id", F.nullif("page_id", F.lit(NO_ID)))


def field(name: str, head: Column) -> Column:
    """A header's value; null where there is none."""
    return F.nullif(F.regexp_extract(head, rf"(?i)\r\n{name}: *([^\r\n]*)", 1), F.lit(""))


def _parsed(head: Column) -> list[Column]:
    """What a head says; its WARC part ends at the first empty line, its HTTP part is what follows."""
    text = F.decode(head, "UTF-8")
    http = F.substring_index(text, CRLF + CRLF, -2)  # ends with an empty line: the piece before it, and nothing
    return [
        field("WARC-Type", text).alias("record_type"),
        field("WARC-Record-ID", text).alias("record_id"),
        field("WARC-Refers-To", text).alias("refers_to_id"),
        F.replace(field("WARC-Payload-Digest", text), F.lit("sha1:"), F.lit("")).alias("declared"),
        field("Content-Length", F.substring_index(text, CRLF + CRLF, 1)).cast("long").alias("block_bytes"),
        F.octet_length(http).cast("long").alias("http_bytes"),
        field("Content-Length", F.concat(F.lit(CRLF), http)).cast("long").alias("http_says"),
    ]


def read(stored: Archive) -> DataFrame:
    """What the records say, put together again and checked byte by byte; see the module."""
    facts = ["payload_bytes", "payload_digest", "sound"]
    whole = _responses(stored).select(*KEYS, "record", F.octet_length("head").alias("head_bytes"), F.octet_length("record").cast("long").alias("record_bytes"), *_parsed(F.col("head")))
    # the payload is what the declared lengths cut from the record; if they are wrong, it isn't sound
    payload = F.expr("substring(record, head_bytes + 1, cast(least(greatest(block_bytes - http_bytes, 0), 2147483647) as int))")
    ends = F.expr("substring(record, -4, 4)") == F.lit(b"\r\n\r\n")
    whole = whole.withColumn("payload", payload).select(
        *KEYS, "record_id", "declared", "record_type", "record_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        (ends & (F.col("head_bytes") + F.col("block_bytes") - F.col("http_bytes") + 4 == F.col("record_bytes")) & (F.col("http_says") == F.octet_length("payload")) & (F.sha2("payload", 256) == F.col("digest"))).alias("sound"),
    )
    whole = storage.keep(whole, "warc-read")
    own = whole.select("page_id", *facts[:2], "record_type", F.lit(None).cast("long").alias("refers_to"), "record_bytes", (F.col("sound") & (F.col("declared") == F.col("payload_digest"))).alias("verified"))
    again = stored.heads.where("revisit").select(*KEYS, (F.octet_length("head") + 4).cast("long").alias("record_bytes"), *_parsed(F.col("head")))
    targets = whole.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("digest").alias("of"), *facts)
    again = join_dealt(again, targets, "refers_to_id", spread="record_id", how="left")
    agrees = F.col("sound") & (F.col("of") == F.col("digest")) & (F.col("declared") == F.col("payload_digest")) & (F.col("block_bytes") == F.col("http_bytes")) & (F.col("http_says") == F.col("payload_bytes"))
    out = own.unionByName(again.select("page_id", *facts[:2], "record_type", "refers_to", "record_bytes", agrees.alias("verified")))
    known = lambda c: F.nullif(c, F.lit(NO_ID)).alias(c)
    return out.select(known("page_id"), "payload_bytes", "payload_digest", "record_type", known("refers_to"), "record_bytes", F.coalesce("verified", F.lit(False)).alias("verified"))


def write_files(stored: Archive, path: str, records_a_file: int = 10_000) -> None:
    """Ordinary WARC files: the text sink writes a record's bytes as they are, and its end as line separator."""
    rows = records(stored).select(F.expr("cast(substring(record, 1, length(record) - 4) as string)").alias("value"))
    rows.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records_a_file).option("compression", "none").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, target, refers_to and payload of the records in WARC files."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at, rows = content.as_py(), 0, []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at)
                    head = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:] if b": " in line)
                    n = int(head[b"Content-Length"])
                    block = data[end + 4 : end + 4 + n]
                    get = lambda k, h=head: h[k].decode() if k in h else None
                    rows.append((get(b"WARC-Record-ID"), get(b"WARC-Type"), get(b"WARC-Target-URI"), get(b"WARC-Refers-To"), block.partition(b"\r\n\r\n")[2]))
                    at = end + 4 + n + 4
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.string()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["record_id", "record_type", "target", "refers_to", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, "record_id string, record_type string, target string, refers_to string, payload binary")
