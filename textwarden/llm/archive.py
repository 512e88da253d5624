"""Content-addressed WARC archive.

``write_archive`` stores every distinct payload once, under its SHA-256, SHA-1 and length, and
the exact header block of every record apart from it. ``read_records`` reads the headers back
and joins them to the verified payloads; ``reconstruct`` also returns the bytes of each record.

Defined results: a null payload is empty; a null URL leaves out the target line; line breaks in
a URL are percent-encoded. Of equal payloads of ``least_bytes`` or more, the record with the
largest id is the response and the others revisit it; rows that repeat that id are responses
too, a null id revisits any other. An empty table gives an empty archive. Other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textwarden.llm.common import salted_join

KEY = ["sha256", "sha1", "n_bytes"]
#: payloads below this many bytes are never revisited
LEAST_BYTES = 1000
#: capture date of records; the pages carry none
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(number: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(number.cast("string"), F.lit("null")), F.lit(">"))


def _keyed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    return (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         payload.alias("payload"))
            .withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"),
                          "n_bytes": F.octet_length("payload").cast("long")}))


def headers(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The exact header block of each record, from its id, URL, payload key and the key's response."""
    revisit = ((F.col("n_bytes") >= least_bytes) & F.col("response_id").isNotNull()
               & ~F.col("page_id").eqNullSafe(F.col("response_id")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    _line("Content-Length", F.col("n_bytes").cast("string")), F.lit("\r\n"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("n_bytes"))
    warc = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(_line("WARC-Refers-To", _urn(F.col("response_id"))),
                                          _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", length.cast("string")), F.lit("\r\n"))
    return (records.withColumns({"revisit": revisit, "http": http})
            .select(*KEY, "shared", F.concat(warc, F.col("http")).cast("binary").alias("header")))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write ``folder/payloads`` (one row per distinct payload) and ``folder/records`` (one per page).

    Copies of a payload combine before the shuffle, so a payload with any number of copies
    reaches its task at most once per input task. The headers join only shared payloads.
    """
    keyed = _keyed(pages, id_col, url_col, payload_col)
    (keyed.groupBy(*KEY).agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("copies"),
                             F.any_value("payload").alias("payload"))
     .write.parquet(f"{folder}/payloads"))
    kept = (pages.sparkSession.read.parquet(f"{folder}/payloads").filter("copies > 1")
            .select(*KEY, "response_id", F.lit(True).alias("shared")))
    records = salted_join(keyed.drop("payload"), kept, KEY, F.struct("page_id", "url"), "left")
    headers(records.withColumn("shared", F.coalesce("shared", F.lit(False))), least_bytes).write.parquet(
        f"{folder}/records")


def _field(name: str, pattern: str) -> Column:
    return F.regexp_extract(F.col("head"), rf"\r\n{name}: {pattern}\r\n", 1)


def _join_payloads(records: DataFrame, payloads: DataFrame) -> DataFrame:
    shared = salted_join(records.filter("shared"), payloads.filter("copies > 1"), KEY, F.col("header"))
    alone = records.filter("NOT shared").join(payloads.filter("copies = 1"), KEY)
    return shared.unionByName(alone)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per archived record: fields of its header, length and digest of its full payload.

    Payload lengths and digests are computed from the stored bytes and must equal the key that
    addresses them; an archive with a damaged payload fails the job instead of passing on.
    """
    whole = ((F.sha2("payload", 256) == F.col("sha256")) & (F.sha1("payload") == F.col("sha1"))
             & (F.octet_length("payload") == F.col("n_bytes")))
    payloads = (spark.read.parquet(f"{folder}/payloads")
                .select(*KEY, "copies", F.octet_length("payload").cast("long").alias("payload_bytes"),
                        F.when(whole, F.sha1("payload"))
                        .otherwise(F.raise_error(F.lit("payload differs from its digest")).cast("string"))
                        .alias("payload_digest")))
    joined = _join_payloads(spark.read.parquet(f"{folder}/records"), payloads)
    return (joined.withColumn("head", F.col("header").cast("string"))
            .select(_field("WARC-Record-ID", r"<urn:x-page:(-?\d+|null)>").try_cast("long").alias("page_id"),
                    "payload_bytes", "payload_digest", _field("WARC-Type", r"(\w+)").alias("record_type"),
                    _field("WARC-Refers-To", r"<urn:x-page:(-?\d+)>").try_cast("long").alias("refers_to"),
                    "header"))


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """The bytes of every original record: header block, payload (but for revisits) and end mark."""
    joined = _join_payloads(spark.read.parquet(f"{folder}/records"),
                            spark.read.parquet(f"{folder}/payloads").select(*KEY, "copies", "payload"))
    block = F.when(F.col("header").cast("string").startswith("WARC/1.1\r\nWARC-Type: revisit"),
                   F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("header", "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))
