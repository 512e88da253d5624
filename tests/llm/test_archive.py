import hashlib
import uuid

from textwarden.llm import archive

SCHEMA = "page_id long, url string, html string, payload string"


def stored(spark, tmp_path, rows, **options):
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    archive.write_archive(spark.createDataFrame(rows, SCHEMA), folder, **options)
    return folder


def test_round_trip_and_revisits(spark, tmp_path):
    long, other = "é" * 600, "x" * 999
    rows = [(1, "http://a/1", long, "k"), (2, "http://a/2", long, None), (3, "http://a\r\n/3", long, "k"),
            (4, None, other, "k"), (5, "u", other, "k"), (6, "u", None, "k"), (7, "u", "", "k")]
    folder = stored(spark, tmp_path, rows)
    got = {r.page_id: r for r in archive.read_records(spark, folder).collect()}
    assert [got[i].record_type for i in range(1, 8)] == ["revisit"] * 2 + ["response"] * 5
    assert [got[i].refers_to for i in range(1, 8)] == [3, 3] + [None] * 5
    for i, _, html, _ in rows:
        body = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    # each distinct payload is stored once, records are rebuilt with it
    payloads = spark.read.parquet(f"{folder}/payloads")
    assert payloads.count() == 3
    records = {bytes(r.header): (bytes(r.record), bytes(r.payload)) for r in archive.reconstruct(spark, folder).collect()}
    head = bytes(got[3].header)
    assert b"WARC-Target-URI: http://a%0D%0A/3\r\n" in head and b"WARC-Target-URI" not in bytes(got[4].header)
    assert records[head] == (head + long.encode() + b"\r\n\r\n", long.encode())
    block = len(head) - head.index(b"\r\n\r\n") - 4 + 1200
    assert f"Content-Length: {block}\r\n".encode() in head
    assert records[bytes(got[1].header)][0] == bytes(got[1].header) + b"\r\n\r\n"


def test_null_ids_repeated_rows_and_empty_table(spark, tmp_path):
    body = "y" * 2000
    rows = [(None, "u", body, "k"), (9, "u", body, "k"), (9, "u", body, "k"), (8, "u", body, "k")]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in archive.read_records(
        spark, stored(spark, tmp_path, rows)).collect())
    assert got == [(0, "revisit", 9), (8, "revisit", 9), (9, "response", None), (9, "response", None)]
    empty = archive.read_records(spark, stored(spark, tmp_path, []))
    assert empty.count() == 0


def test_damaged_payload_is_not_passed_on(spark, tmp_path):
    from pyspark.sql import functions as F
    import pytest

    folder = stored(spark, tmp_path, [(1, "u", "a" * 1500, "k")])
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit(b"b" * 1500))
    bad.write.parquet(f"{folder}/bad/payloads")
    spark.read.parquet(f"{folder}/records").write.parquet(f"{folder}/bad/records")
    with pytest.raises(Exception, match="differs from its digest"):
        archive.read_records(spark, f"{folder}/bad").collect()
