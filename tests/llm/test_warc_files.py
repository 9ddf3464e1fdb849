"""Archives of any size, ending and kind through Spark's readers."""

import gzip

import pytest

from graphloom.llm import queries, warc


def records(n, size=0):
    return [warc.record_bytes("response", f"http://x/{k}", b"a\r\nb\n\xff\xfe" * 9 + b"%d" % k + bytes(size), f"<urn:x-page:{k}>") for k in range(n)]


def test_file_above_256_mb(spark, tmp_path):
    (tmp_path / "big.warc").write_bytes(b"".join(records(9, 30 << 20)))
    assert (tmp_path / "big.warc").stat().st_size > 256 << 20
    rows = warc.read_warc(spark, str(tmp_path), payloads=False).select("kind", "record_id", "payload_bytes").collect()
    assert sorted((r.kind, r.record_id) for r in rows) == [("response", str(k)) for k in range(9)] and min(r.payload_bytes for r in rows) > 30 << 20


def test_bytes_and_places_by_name_and_kind(spark, tmp_path):
    """Whatever a file is called, it is read as it is on disk, with places in it."""
    one = records(40)
    plain, zipped = b"".join(one), b"".join(gzip.compress(r, mtime=0) for r in one)
    damaged = plain[:50] + b"\0" + plain[51:]
    files = {
        "a.warc": plain, "b.warc.gz": zipped, "c.gz": plain, "d": damaged, "e": zipped, "f.txt": b"\xef\xbb\xbf" + plain, "g.txt": damaged[:-1], "h.warc": b"", "i": b"\n\n", "j.warc.gz": gzip.compress(plain),
        "k.bz2": b"no archive", "l.odd[x]": plain, "m.txt": plain + b"\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in warc.read_warc(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.kind, r.start, r.end, bytes(r.payload or b"")))
    assert set(got) == set(files) - {"h.warc"}
    for name, rows in got.items():
        found = warc.salvage(files[name])
        want = [("gap", g.start, g.end, b"") for g in found.gaps] + [("response", r.start, r.end, r.block) for r in found.records]
        assert sorted(rows) == sorted(want), name


@pytest.mark.parametrize("make", [lambda r: b"".join(r), lambda r: gzip.compress(b"".join(r)), lambda r: b"".join(map(gzip.compress, r))])
def test_on_disk_as_in_memory(monkeypatch, make):
    data = make(records(40))[:-20] + b"rubbish"
    want = warc.salvage(data)
    monkeypatch.setattr(warc, "MEMORY_BYTES", 100)
    spool = warc._Spool()
    spool.write(data)
    got = warc._collect(warc._scan(spool.view()))
    assert got == want and got.gaps


def test_url_of_100_kb(spark, tmp_path):
    rows = [(1, "http://x/" + "u" * 100_000, "text"), (2, "http://y/WARC/1.1", "text"), (3, "http://z", "other")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in queries.op4_warc(spark, str(tmp_path)).collect()}
    assert got == {1: ("response", None, 4), 2: ("revisit", 1, 4), 3: ("response", None, 5)}


def test_headers_without_end_stop_at_the_next_record():
    one, other = records(2)
    broken = b"WARC/1.1\r\nWARC-Target-URI: " + b"u" * 100_000 + b"\r\n"
    found = warc.salvage(broken + one + other)
    assert [(g.start, g.end) for g in found.gaps] == [(0, len(broken))] and len(found.records) == 2


def test_query_fails_on_lost_pages(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"http://x/{k}", "text") for k in range(5)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op4_warc(spark, str(tmp_path)).count() == 5
    whole = warc.read_warc
    monkeypatch.setattr(warc, "read_warc", lambda *a, **b: whole(*a, **b).filter("record_id <> '3'"))
    with pytest.raises(RuntimeError, match="4 records and 0 gaps were read of 5 pages"):
        queries.op4_warc(spark, str(tmp_path))


def test_query_with_null_repeated_and_odd_ids(spark, tmp_path):
    odd = ["null", None, None, "a b", "<x>", "line\r\nbreak", "100%", "%6Eull", "a+b", "é", "", "a b"]
    rows = [(k, f"http://x/{n}", f"text {n % 9}") for n, k in enumerate(odd)]
    spark.createDataFrame(rows, "page_id string, url string, html string").write.parquet(str(tmp_path / "s/pages.parquet"))
    got = queries.op4_warc(spark, str(tmp_path / "s")).collect()
    assert sorted(map(repr, (r.page_id for r in got))) == sorted(map(repr, odd))
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {("é", "null")}
    numbers = [(None, "u", "t"), (3, None, "t"), (3, "about:blank", "t"), (None, "v", "other"), (-4, "w x", "t")]
    spark.createDataFrame(numbers, "page_id long, url string, html string").write.parquet(str(tmp_path / "n/pages.parquet"))
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in queries.op4_warc(spark, str(tmp_path / "n")).collect()), key=str)
    assert got == sorted([(None, "response", None)] * 2 + [(3, "revisit", -4)] * 2 + [(-4, "response", None)], key=str)


def test_urls_as_they_were(spark, tmp_path):
    urls = ["http://a/b", "http://a/ b", "http://a/%20b", None, "", "about:blank", "null", "=x", "a\nb+c"]
    warc.write_warc(spark.createDataFrame([(k, u, str(k)) for k, u in enumerate(urls)], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert {int(r.record_id): r.page_uri for r in warc.read_warc(spark, str(tmp_path / "w")).collect()} == dict(enumerate(urls))
