import hashlib
import zlib

from tidemark.llm import warc
from tidemark.llm.common import file_system


def rows_of(df):
    return sorted(((r.page_id, r.url, r.record_type, r.payload, r.payload_bytes, r.payload_digest, r.refers_to) for r in df.collect()), key=repr)


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, u, h in rows:
        data = (h or "").encode()
        ref = first[h] if h in first and first[h] != i else None
        out.append((i, u, "response" if ref is None else "revisit", bytearray(data) if ref is None else None, len(data), hashlib.sha256(data).hexdigest(), ref))
    return sorted(out, key=repr)


def test_round_trip_with_revisits_nulls_and_empty_payloads(spark):
    big = "<p>é\r\n\r\nx</p>" * 20
    rows = [(5, "http://a/ b\r\nc", big), (3, "u", big), (9, None, big), (None, "n", big), (1, "s", "short"), (2, "s", "short"), (4, None, None), (6, "e", ""), (10, "", "short"), (11, " http://é%20x/\t\x00 ", None), (3, "u", big), (8, "l", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    assert rows_of(warc.archive_pages(pages)) == brute(rows)


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_members_and_index(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 30) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    raw = warc.write_archives(warc.with_revisits(pages).coalesce(1), f"file://{tmp_path}/raw")
    (path,) = (r.path for r in raw.collect())
    whole = file_system(path)[0].open_input_file(file_system(path)[1]).read()
    one = zlib.decompressobj(31)
    assert one.decompress(whole).count(b"WARC/1.1\r\n") == 20 and not one.unused_data
    (new,) = (r.path for r in warc.normalise(raw, f"file://{tmp_path}/records").collect())
    data, members = file_system(new)[0].open_input_file(file_system(new)[1]).read(), 0
    while data:
        one = zlib.decompressobj(31)
        assert one.decompress(data).count(b"WARC/1.1\r\n") == 1
        data, members = one.unused_data, members + 1
    assert members == 20
