import gzip
import hashlib

from pyspark.sql import functions as F

from wardline.llm import warc

PAGES = "page_id long, url string, html string, record_type string"


def pages(spark):
    big, other = "<p>é" * 400, "x" * 1000
    rows = [(i, f"https://a.example/{i}", t, "clash") for i, t in enumerate([big, other, big, None, "", "short", "short", "a\r\n\r\nb" * 300])]
    rows += [(20, "https://a.example/a b\nc", other, None), (21, None, big, None), (22, "u", "y" * 999, None), (23, "u", "y" * 999, None)]
    rows += [(21, None, big, None), (None, "n", "z" * 2000, None), (None, "n", big, None), (30, "u", "q" * 300_000, None)]
    return spark.createDataFrame(rows, PAGES)


def brute(rows, least=1000):
    largest = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None:
            largest[body] = max(i, largest.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        kept = largest.get(body)
        again = len(body) >= least and kept is not None and i != kept
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    frame = pages(spark)
    got = warc.archive(frame)
    rows = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()), key=repr)
    assert rows == brute([tuple(r)[:3] for r in frame.collect()])


def test_files_and_selected_ranges(spark, tmp_path):
    frame = pages(spark)
    index = warc.write_archives(warc.plan_records(frame), tmp_path.as_uri())
    entries = index.collect()
    assert len(entries) == frame.count()
    for e in entries:
        record = gzip.decompress((tmp_path / e["file"]).read_bytes()[e["offset"] : e["offset"] + e["length"]])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        headers, payload = warc.parse_record(record)
        assert headers["warc-type"] == e["record_type"]
        if e["record_type"] == "response":
            assert hashlib.sha1(payload).hexdigest() == e["payload_digest"]
    some = index.where("page_id in (2, 5, 30) or url is null")
    html = {r["page_id"]: (r["html"] or "").encode() for r in frame.collect()}
    read = warc.read_records(some, tmp_path.as_uri()).collect()
    assert len(read) == some.count()
    assert all(r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html[r["page_id"]] for r in read)


def test_reads_are_coalesced(spark):
    rows = [("f", i * 100, 100) for i in range(50)] + [("f", 1_000_000, 10), ("g", 5, 10)]
    index = spark.createDataFrame(rows, "file string, offset long, length long")
    reads = sorted((r["file"], r["start"], r["stop"], len(r["records"])) for r in warc.coalesce_ranges(index).collect())
    assert reads == [("f", 0, 5000, 50), ("f", 1_000_000, 1_000_010, 1), ("g", 5, 15, 1)]


def test_small_files_are_begun_anew(spark, tmp_path):
    index = warc.write_archives(warc.plan_records(pages(spark)).coalesce(1), tmp_path.as_uri(), file_bytes=300)
    assert index.select("file").distinct().count() > 1
    assert warc.read_records(index, tmp_path.as_uri()).count() == index.count()


def test_no_rows(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).collect() == []
