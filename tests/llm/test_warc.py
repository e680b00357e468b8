import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from quarry.llm import scratch, warc

ROWS = [(1, "http://a.example/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "http://b.example/", "<p>é</p>"), (3, "http://c.example/", ""), (4, "u", None), (6, "http://a.example/z", "big " * 50000), (None, "n", "<p>é</p>"), (6, "again", "big " * 50000)]


@pytest.fixture(scope="module", params=[True, False])
def archive(spark, request):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, payload string").repartition(3)
    path = scratch.new_path(spark, "warc")
    warc.archive(df, path, compress=request.param)
    return path


def test_round_trip(spark, archive):
    rows = warc.read(spark, archive).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["record_id"], []).append(r)
    assert by["<urn:page:5>"][0]["record_type"] == "response" and bytes(by["<urn:page:5>"][0]["payload"]) == "<p>é</p>".encode()
    for i in (1, 2):
        r = by[f"<urn:page:{i}>"][0]
        assert (r["record_type"], r["refers_to"], r["payload"], r["payload_length"]) == ("revisit", "<urn:page:5>", None, 9)
    assert by["<urn:page:4>"][0]["record_type"] == "response" and by["<urn:page:3>"][0]["refers_to"] == "<urn:page:4>"
    assert by["<urn:page:null>"][0]["record_type"] == "response"
    digest = "sha1:" + base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert {r["payload_digest"] for i in (1, 2, 5) for r in by[f"<urn:page:{i}>"]} == {digest}
    assert by["<urn:page:1>"][0]["target_uri"] == "http://a.example/x%20y"


def test_predicates_reach_the_reader(spark, archive):
    df = warc.read(spark, archive)
    assert df.where("record_type = 'revisit'").count() == sum(r["record_type"] == "revisit" for r in df.collect())
    assert {r["record_id"] for r in df.where(F.col("target_uri").startswith("http://a.")).collect()} == {"<urn:page:1>", "<urn:page:6>"}
    assert df.where("record_type in ('response', 'warcinfo') and refers_to is not null").count() == 0
    thin = warc.read(spark, archive, payload=False)
    assert thin.where("record_type = 'response'").where("payload is not null").count() == 0
    reader = warc.WarcReader({"path": archive}, list(warc.COLUMNS))
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 5)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"] and len(reader.tests) == 1


def test_least_payload_size(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = scratch.new_path(spark, "warc")
    warc.archive(df, path, min_bytes=3)
    kinds = {r["record_id"]: r["record_type"] for r in warc.read(spark, path).collect()}
    assert kinds == {"<urn:page:1>": "response", "<urn:page:2>": "response", "<urn:page:3>": "revisit", "<urn:page:4>": "response"}


def test_empty_table(spark):
    path = scratch.new_path(spark, "warc")
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


RECORDS = [warc.render(f"<urn:page:{i}>", "response", f"http://x/{i}", "2020-01-01T00:00:00Z", f"sha1:{warc.base32_digest(b)}", len(b), b, None) for i, b in enumerate([b"one", b"", b"\r\n\r\nWARC/1.1\r\n" * 9000])]


@pytest.mark.parametrize("pack", [lambda r: r, warc.gzip_member, gzip.compress])
def test_records_of_all_kinds_of_files(pack):
    f = io.BytesIO(b"".join(map(pack, RECORDS)))
    assert [r.headers["warc-record-id"] for r in warc.records(f)] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:2>"]
    f.seek(0)
    assert [len(warc._payload(r.block())[0]) for r in warc.records(f)] == [3, 0, 9000 * 14]
    assert gzip.decompress(b"".join(map(warc.gzip_member, RECORDS))) == b"".join(RECORDS)


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    warc.archive(df, str(tmp_path / "w"))
    (tmp_path / "w" / "part-lost.warc").write_bytes(RECORDS[0])
    assert [r["record_id"] for r in warc.read(spark, str(tmp_path / "w")).collect()] == ["<urn:page:1>"]


def test_damaged_payload_is_noticed(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(RECORDS[0].replace(b"one", b"two"))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, str(tmp_path)).collect()
