"""Content-addressed WARC archive.

Two tables: payload bytes, once each, by SHA-256; and exact record headers with
the digest of the payload that their record holds or refers to. A response's
record is its header, its payload and the end; a revisit's has no block, and
its payload is its response's. Records come back by joining the tables, and
the digests are verified against the rebuilt records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.llm import common
from quillon.llm.common import Scratch

#: Shorter payloads are never revisited, as a record would save nothing.
LEAST_REVISIT = 1000
_END = "\r\n"


#: The format's profile of a revisit whose payload is the same (fixed value).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"


def _urn(page: Column, sha256: Column) -> Column:
    """A name-based record URI of a page and its payload."""
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), sha256).cast("binary"))
    version = F.concat(F.lit("3"), F.substring(h, 14, 3))
    variant = F.concat(F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), F.substring(h, 18, 3))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), version, F.lit("-"), variant, F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _header(page: Column, url: Column, date: str, revisit: Column, owner: Column, sha1: Column, sha256: Column, size: Column) -> Column:
    """A record's header up to and with the empty line. Line breaks in a url are percent-encoded."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    lines = [
        F.lit("WARC/1.1"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", _urn(page, sha256)), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)), line("X-Payload-SHA256", sha256), line("X-Payload-Length", size.cast("string")), line("X-Page-ID", page.cast("string")),
        F.when(revisit, F.concat_ws(_END, line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(owner, sha256)), line("X-Refers-To-Page-ID", owner.cast("string")))),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.when(revisit, 0).otherwise(size).cast("string")),
    ]
    return F.concat(F.concat_ws(_END, *lines), F.lit(_END + _END))


def write_archive(pages: DataFrame, scratch: Scratch, id_col="page_id", url_col="url", html_col="html", date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads): tables (header, sha256, whole) and (sha256, payload).

    The payload is the html in UTF-8, null as empty. Of records with equal
    payloads of LEAST_REVISIT bytes or more, those of the largest id are the
    response and the others revisit it; a null id is less than any other. Rows
    that repeat an id get a record each. whole says that the record's block is
    its payload. Other columns are ignored.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    payloads = scratch.keep(rows.groupBy("sha256").agg(F.first("payload").alias("payload"), F.max("id").alias("owner")), "zstd")
    light = rows.select("id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    facts = light.join(payloads.select("sha256", "owner"), "sha256")
    revisit = (F.col("size") >= LEAST_REVISIT) & ~F.col("id").eqNullSafe(F.col("owner"))
    headers = facts.select(_header(F.col("id"), F.col("url"), date, revisit, F.col("owner"), F.col("sha1"), F.col("sha256"), F.col("size")).alias("header"), "sha256", (~revisit).alias("whole"))
    return scratch.keep(headers), payloads.select("sha256", "payload")


def field(name: str, header: Column | None = None) -> Column:
    """A field of a header column; null if it is missing or empty."""
    return F.nullif(F.regexp_extract(F.col("header") if header is None else header, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def read_records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(header, sha256, record): each record's exact bytes, its header, its block if it is whole, and the end.

    Payloads that many records share meet their headers by a join of written
    tables, so that hot ones can be split; revisits need none.
    """
    parts = headers.where("whole").join(payloads, "sha256").select("header", "sha256", "payload")
    parts = parts.unionAll(headers.where(~F.col("whole")).select("header", "sha256", F.lit(b"").alias("payload")))
    return parts.select("header", "sha256", F.concat(F.col("header").cast("binary"), F.col("payload"), F.lit(_END + _END).cast("binary")).alias("record"))


def index_records(records: DataFrame) -> DataFrame:
    """What each rebuilt record says: page_id, url, payload_bytes, payload_digest (SHA-1), record_type, refers_to and verified.

    verified: the block has the header's length and, for a response, the
    digests that the header names; they are taken from the record's bytes. A
    revisit's digest and length are those of the payload that it refers to.
    """
    head, end = F.octet_length("header"), F.lit(len(_END + _END))
    block = F.expr(f"substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - {len(_END + _END)})")
    named = records.select("header", "record", "sha256").withColumn("block", block).withColumn("response", field("WARC-Type") == "response")
    size = F.octet_length("block").cast("long")
    sha1 = F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]{40})\r\n", 1)
    right = (field("Content-Length").try_cast("long") == size) & (F.octet_length("record") == head + F.octet_length("block") + end) & (field("X-Payload-SHA256") == F.col("sha256"))
    own = ~F.col("response") | ((F.sha2("block", 256) == F.col("sha256")) & (F.sha1("block") == sha1))
    number = lambda name: field(name).try_cast("long")
    return named.select(
        number("X-Page-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), F.when(F.col("response"), size).otherwise(number("X-Payload-Length")).alias("payload_bytes"),
        F.when(F.col("response"), F.sha1("block")).otherwise(sha1).alias("payload_digest"), field("WARC-Type").alias("record_type"), number("X-Refers-To-Page-ID").alias("refers_to"),
        F.coalesce(right & own, F.lit(False)).alias("verified"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, payloads = write_archive(common.read(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    index = index_records(read_records(headers, payloads))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


OP7_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as size, sha1(payload) as digest, sha256(payload) as strong from p),
o as (select strong, max(page_id) as owner from d group by strong)
select page_id, cast(size as bigint) as payload_bytes, digest as payload_digest,
  case when size >= {LEAST_REVISIT} and page_id <> owner then 'revisit' else 'response' end as record_type,
  case when size >= {LEAST_REVISIT} and page_id <> owner then owner end as refers_to, true as verified
from d join o using (strong)
"""
