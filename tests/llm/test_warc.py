import gzip
import hashlib
import io
import random

import pytest

from tidemark.llm import warc

from .helpers import duck, same_rows

SF = "/root/testdata/sf0.001"


def test_against_sql(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    assert same_rows(warc.op1_warc(spark, SF), duck(pages=pages), warc.SQL)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    long, short = "é<p>" * 40, "tiny"
    rows = [(1, "http://a/1", long, "x"), (2, "http://a/2", long, "x"), (3, None, None, None), (4, "http://a/\n4", short, "x"), (5, "http://b/5", short, "x"),
            (6, "http://b/6", "", "x"), (None, "http://b/7", long, "x"), (8, "http://b/8", "WARC/1.1\r\n\r\n\r\nWARC-Type: response\r\n" * 9, "x")]
    path = str(tmp_path_factory.mktemp("warc") / "made")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, payload string"), path)
    return path, rows


def test_round_trip(spark, archive):
    path, rows = archive
    got = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == len(rows)
    for id_, uri, html, _ in rows:
        r = got[f"<urn:x-record:{id_}>" if id_ is not None else None]
        body = (html or "").encode()
        assert r.payload_length == len(body) and r.payload_digest == "sha256:" + hashlib.sha256(body).hexdigest()
        assert r.target_uri == (uri and uri.replace("\n", "%0A"))
        if id_ in (2, None):
            assert r.record_type == "revisit" and r.payload is None and r.refers_to == "<urn:x-record:1>"
        else:
            assert r.record_type == "response" and bytes(r.payload) == body and r.payload_sha256 == hashlib.sha256(body).hexdigest()


def test_predicates_are_pushed_down(spark, archive):
    path, rows = archive
    kinds = warc.read_warc(spark, path, "record_type string, target_uri string")
    revisits = kinds.filter("record_type = 'revisit'")
    assert "PythonScan" in revisits._jdf.queryExecution().toString() or revisits.count() == 2
    assert revisits.count() == 2 and kinds.filter("target_uri like 'http://b/%'").count() == 4 and kinds.filter("record_type in ('revisit', 'x')").count() == 2
    assert kinds.filter("target_uri is null").count() == 1

    reader = warc.WarcReader(kinds.schema, {"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("target_uri",), "a")]))
    assert len(left) == 1 and [t[0] for t in reader.tests] == ["warc-type"]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2


def test_unwanted_payloads_are_not_read():
    class Stream:
        def __init__(self, data):
            import io

            self.inner, self.payload_bytes = io.BytesIO(data), 0

        def readline(self):
            return self.inner.readline()

        def seek(self, *a):
            return self.inner.seek(*a)

        def read(self, n):
            self.payload_bytes += n
            return self.inner.read(n)

    data = b"".join(b"WARC/1.0\r\nWARC-Type: %s\r\nX-Long: a\r\n b\r\nContent-Length: 1000\r\n\r\n%s\r\n\r\n" % (kind, b"z" * 1000) for kind in (b"metadata", b"response", b"request"))
    skipped = Stream(data)
    assert [r[0] for r in warc.records(skipped, ["record_type"], [])] == ["metadata", "response", "request"] and skipped.payload_bytes == 0
    one = Stream(data)
    (row,) = warc.records(one, ["payload", "headers"], [("warc-type", ("eq", "response"))])
    assert row[0] == b"z" * 1000 and dict(row[1])["x-long"] == "a b" and one.payload_bytes == 1000
    with pytest.raises(ValueError):
        list(warc.records(Stream(b"HTTP/1.1 200\r\n"), ["record_type"], []))


def test_plain_and_gzip_files_and_empty_tables(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.warc").write_bytes(record * 2)
    (folder / "b.warc.gz").write_bytes(gzip.compress(record) * 3)  # a member per record, as archives usually have
    assert warc.read_warc(spark, str(folder)).filter("cast(payload as string) = 'ok'").count() == 5
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(none, str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_a_member_per_record_and_ranges_of_them(spark, archive, tmp_path):
    """Every cut of a file into ranges gives every record once; headers alone leave payloads packed."""
    path, rows = archive
    big = [(k, f"http://c/{k}", f"<p>{k} " + "".join(chr(32 + (k * 7919 + j * j) % 5000) for j in range(40 * (k % 90)))) for k in range(300)]
    warc.write_warc(spark.createDataFrame(big, "page_id long, url string, html string").coalesce(1), str(tmp_path / "big"))
    (file,) = (tmp_path / "big").glob("*.warc.gz")
    data = file.read_bytes()
    plain = gzip.decompress(data)
    assert plain.count(b"WARC/1.1\r\nWARC-Type: response") == 300 and not list((tmp_path / "big").glob("_*"))
    for size in (997, 20_000, len(data) + 1):
        reader = warc.WarcReader(warc.read_warc(spark, str(tmp_path / "big"), "record_id string, payload binary").schema, {"path": str(tmp_path / "big"), "partitionBytes": str(size)})
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert sorted((r["record_id"], r["payload"].decode()) for r in got) == sorted((f"<urn:x-record:{k}>", html) for k, _, html in big)

    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            found = super().read(n)
            Counting.total += len(found)
            return found

    noise = random.Random(1).randbytes(3_000_000)
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3000000\r\n\r\n" + noise + b"\r\n\r\n"
    packed = warc.member(one) * 3
    assert gzip.decompress(packed) == one * 3
    kinds = [row for m in warc.members(Counting(packed), 0, len(packed)) for row in warc.records(m, ["record_type"], [])]
    assert kinds == [("response",)] * 3 and Counting.total <= 3 * warc.CHUNK
    whole = [row[0] for m in warc.members(io.BytesIO(packed), 0, len(packed)) for row in warc.records(m, ["payload"], [])]
    assert whole == [noise] * 3


def test_files_end_by_size_and_runs_add_up(spark, tmp_path):
    pages = spark.createDataFrame([(k, None, f"{k} " * 500) for k in range(200)], "page_id long, url string, html string")
    for _ in range(2):
        warc.write_warc(pages, str(tmp_path / "parts"), file_bytes=5000)
    assert len(list((tmp_path / "parts").glob("*.gz"))) > 8 and warc.read_warc(spark, str(tmp_path / "parts")).count() == 400
