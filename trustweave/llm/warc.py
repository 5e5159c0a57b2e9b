"""WARC archives: pages written as records, and records assembled into captures.

Writing. A page becomes three records: its request, its response (or a revisit, if an
equal payload is answered by a page with a smaller id) and its metadata. The request and
the metadata name the response in ``WARC-Concurrent-To``. The archive is written by
Spark's own text writer, so it goes to any file system that Spark knows.

Reading. Records are cut at their version line, so an archive of any size is split among
tasks and no task holds more than a record at a time. (The line end before it is no part
of the cut: a sequence that can overlap itself is missed where a reader's buffer ends.)
Each record's length is compared with its Content-Length; a record that doesn't fit is
``damaged``. A payload that itself holds a version line is written in base64, and says so
in its header; an url that ends like one is percent-encoded.

Assembly. Request, response and metadata are joined by the response's record id, as one
aggregate over one scan; all ids of a capture are unique, so no key is hot. A capture is one
nested row. Requests or
metadata without a response give no capture; a response without them has null fields.

Equal payloads are found on digests: groups of more than one page, with their smallest id,
are a narrow table. It is broadcast to the pages if its counted size allows, and joined
by shuffle otherwise; payloads themselves need no shuffle in the first case.

Defined cases: a null html is the empty payload; a null url is left out; pages of the same
id and payload are all responses if that id is the smallest; a page without an id answers
only for pages without one. Line ends in urls are percent-encoded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trustweave.llm.batches import name
from trustweave.llm.staging import staged

VERSION = "WARC/1.1"
END = "\r\n"
CUT = VERSION + END
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Groups of equal payloads (about 60 bytes each) that may be broadcast.
BROADCAST_GROUPS = 200_000


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits at a time are four letters."""
    digest = F.sha1(data)
    letters = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def payload_groups(pages: DataFrame, min_bytes: int) -> DataFrame:
    """For payloads of several pages: digest, smallest id and its url."""
    large = pages.where(F.col("bytes") >= min_bytes)
    # nulls come last; the url is that of the smallest id
    best = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    return large.groupBy("digest").agg(best.alias("first"), F.count("*").alias("n")).where("n > 1").select(
        "digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))


def _record(kind: Column, record_id: Column, headers: list[Column], block: Column) -> Column:
    head = F.concat_ws(END, F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    return F.concat(head, F.lit(END + END), block, F.lit(END))


def _urn(unique: Column, kind: str) -> Column:
    return F.concat(F.lit("<urn:uuid:"), unique, F.lit(f"-{kind}>"))


def write_archive(
    pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z",
) -> None:
    """Write all rows of ``pages`` as WARC records below ``path``."""
    address = F.regexp_replace(F.regexp_replace(name(url).cast("string"), "\r", "%0D"), "\n", "%0A")
    address = F.regexp_replace(address, r"WARC/1\.1\z", "%57ARC/1.1")
    rows = pages.select(name(page_id).alias("page_id"), address.alias("url"), F.coalesce(name(html).cast("string"), F.lit("")).alias("payload"))
    rows = rows.select("*", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("bytes"))
    groups = staged(payload_groups(rows.select("page_id", "url", "digest", "bytes"), min_bytes), "payloads")
    small = groups.count() <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(groups) if small else groups, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.select("*", (again & (F.col("bytes") >= min_bytes)).alias("again"), F.uuid().alias("unique"), F.contains(F.concat(F.col("payload"), F.lit(END)), F.lit(CUT)).alias("coded"))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), F.when(F.col("coded"), f"X-Archive-Coding: base64{END}").otherwise(""),
        F.lit("Content-Length: "), F.col("bytes"), F.lit(END + END),
    )
    stored = F.when(F.col("coded"), F.base64(F.encode("payload", "UTF-8"))).otherwise(F.col("payload"))
    target = F.concat(F.lit("WARC-Target-URI: "), F.col("url"))  # null without an url, and then left out
    day, joined = F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Concurrent-To: "), _urn(F.col("unique"), "response"))
    answer = _record(
        F.when(F.col("again"), "revisit").otherwise("response"), _urn(F.col("unique"), "response"),
        [
            day, target, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.lit("Content-Type: application/http;msgtype=response"),
            F.when(F.col("again"), F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To-Page: "), F.col("first_id"))),
            F.when(F.col("again"), F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("first_url"))),
        ],
        F.concat(http, F.when(F.col("again"), "").otherwise(stored)),
    )
    place = F.coalesce(F.regexp_extract("url", r"(?s)://[^/?#]*([^#]*)", 1), F.lit(""))
    ask = _record(
        F.lit("request"), _urn(F.col("unique"), "request"), [day, target, joined, F.lit("Content-Type: application/http;msgtype=request")],
        F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(f" HTTP/1.1{END}{END}")),
    )
    about = _record(
        F.lit("metadata"), _urn(F.col("unique"), "metadata"), [day, target, joined, F.lit("Content-Type: application/warc-fields")],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(END)),
    )
    rows.select(F.explode(F.array(ask, answer, about)).alias("value")).write.option("lineSep", END).text(path)


def _header(field: str) -> Column:
    """A header's value in the named column of lines, null if absent."""
    found = F.regexp_extract("head", rf"(?m)^(?i:{field}): *([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ids, type, header fields, HTTP head, payload, ``damaged``."""
    raw = spark.read.option("lineSep", CUT).text(path).where("value <> ''")  # nothing precedes the first
    # head, block and the record's end
    cut = F.split("value", END + END, 2)
    rows = raw.select(F.get(cut, F.lit(0)).alias("head"), F.coalesce(F.get(cut, F.lit(1)), F.lit("")).alias("block"))
    rows = rows.select("head", F.when(F.col("block").endswith(END + END), F.expr("left(block, char_length(block) - 4)")).otherwise(F.col("block")).alias("block"))
    rows = rows.select("head", "block", _header("Content-Length").cast("long").alias("length"))
    http = F.col("kind").isin("response", "revisit", "request")
    parts = F.split("block", END + END, 2)
    rows = rows.select("head", "length", "block", _header("WARC-Type").alias("kind"))
    rows = rows.select(
        _header("WARC-Record-ID").alias("record_id"), "kind", _header("WARC-Concurrent-To").alias("concurrent_to"), _header("WARC-Target-URI").alias("target_uri"),
        _header("WARC-Date").alias("date"), F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), _header("WARC-Refers-To-Page").alias("refers_to_page"),
        F.when(http, F.get(parts, F.lit(0))).alias("http_head"), F.when(http, F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).otherwise(F.col("block")).alias("payload"),
        (F.octet_length("block") != F.coalesce("length", F.lit(-1))).alias("damaged"),
    )
    coded = F.coalesce(F.col("http_head").contains("X-Archive-Coding: base64"), F.lit(False))
    return rows.withColumn("payload", F.when(coded & (F.col("kind") == "response"), F.decode(F.unbase64("payload"), "UTF-8")).otherwise(F.col("payload")))


def assemble(records: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One nested row per capture: record_id, and response (or revisit), request, metadata as
    structs of ``fields`` (default: all columns of ``records``, also those added to them).

    All kinds are read in one scan and meet in one aggregate by the response's id, which at
    most a few records share; name the fields that are needed to keep payloads out of it.
    """
    fields = [c for c in records.columns if c not in ("record_id", "concurrent_to")] if fields is None else list(fields)
    answer = F.col("kind").isin("response", "revisit")
    rows = records.select(
        F.when(answer, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("record_id"),
        F.when(answer, "response").otherwise(F.col("kind")).alias("part"), F.struct(*[name(f) for f in fields]).alias("own"),
    ).where("record_id IS NOT NULL")
    # of several requests of one response, the least
    of = lambda part: F.min(F.when(F.col("part") == part, F.col("own"))).alias(part)
    return rows.groupBy("record_id").agg(of("response"), of("request"), of("metadata")).where("response IS NOT NULL")
