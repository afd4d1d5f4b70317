import gzip
import hashlib

from folioweave.llm import warc
from folioweave.llm.warc import assemble, op7_warc, parse, read_archives, write_archives

BIG = "<html>" + "é\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n" * 60 + "</html>"
PAGES = [
    ("clash", 1, "http://a/ b", BIG),
    ("clash", 2, None, BIG),
    ("clash", 3, "http://c", "small"),
    ("clash", 4, "http://d", "small"),
    ("clash", 5, "http://e", None),
    ("clash", 6, "http://f", ""),
    ("clash", None, "http://g", BIG),
    ("clash", 7, "http://h", "x" * 999 + "é"),
    ("clash", 8, "http://h", "x" * 999 + "é"),
    ("clash", 8, "http://h", "x" * 999 + "é"),
]


def pages(spark, folder, rows=PAGES):
    spark.createDataFrame(rows, "type string, page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def expected(rows):
    out = []
    for _, i, _, html in rows:
        data = (html or "").encode()
        same = [j for _, j, _, h in rows if (h or "") == (html or "") and j is not None]
        again = len(data) >= 1000 and bool(same) and i != max(same)
        out.append((i or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else -1))
    return sorted(out)


def test_round_trip(spark, tmp_path):
    got = op7_warc(spark, pages(spark, tmp_path)).collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == expected(PAGES)


def test_the_query_assembles_transactions(spark, tmp_path):
    got = op7_warc(spark, pages(spark, tmp_path))
    assert "Join " in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.n_request, r.n_metadata) for r in got.collect()] == [(1, 1)] * len(PAGES)


def test_payloads_and_nested_rows(spark, tmp_path):
    write_archives(spark.read.parquet(f"{pages(spark, tmp_path)}/pages.parquet"), f"{tmp_path}/warc")
    records = read_archives(spark, f"{tmp_path}/warc", with_payload=True)
    rows = assemble(records).collect()
    full = [bytes(r.response.payload).decode() for r in rows if r.response.type == "response"]
    assert sorted(full) == sorted([BIG, "small", "small", "", "", "x" * 999 + "é"])
    assert all(r.n_request == 1 and r.n_metadata == 1 and r.request.uri == r.response.uri for r in rows)


def test_concurrent_to_either_way(spark):
    rows = [
        ("r1", "response", "q1", None, "u", 1, "d"),
        ("q1", "request", None, None, "u", 0, "d"),
        ("m1", "metadata", "q1", None, "u", 0, "d"),
        ("r2", "response", None, None, "v", 1, "d"),
        ("q2", "request", "r2", None, "v", 0, "d"),
        ("m2", "metadata", "q2", None, "v", 0, "d"),
        ("m3", "metadata", "r2", None, "v", 0, "d"),
        ("m4", "metadata", "nowhere", None, "v", 0, "d"),
    ]
    frame = spark.createDataFrame(rows, "record_id string, type string, concurrent_to string, refers_to string, uri string, payload_bytes long, payload_digest string")
    got = {r.record_id: (r.request.record_id, r.metadata.record_id, r.n_request, r.n_metadata) for r in assemble(frame).collect()}
    assert got == {"r1": ("q1", "m1", 1, 1), "r2": ("q2", "m2", 1, 2)}


def test_parse_members_and_plain():
    one = b"WARC/1.0\r\nWARC-Type: a\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for data in (one * 3, gzip.compress(one) * 3, gzip.compress(one * 3)):
        assert [(h["warc-type"], b) for h, b in parse(data, 7)] == [("a", b"abc")] * 3


def test_empty_table(spark, tmp_path):
    assert op7_warc(spark, pages(spark, tmp_path, [])).count() == 0


def test_what_a_revisit_refers_to_exists(spark, tmp_path):
    rows = PAGES + [("clash", 9, "http://i", BIG), ("clash", 9, "http://j", BIG), ("clash", 10, None, "y" * 3000), ("clash", 11, "http://k", "y" * 3000)]
    write_archives(spark.read.parquet(f"{pages(spark, tmp_path, rows)}/pages.parquet"), f"{tmp_path}/warc")
    records = read_archives(spark, f"{tmp_path}/warc").collect()
    full = {r.record_id: r.payload_digest for r in records if r.type == "response"}
    revisits = [r for r in records if r.type == "revisit"]
    assert len(revisits) == 5 and all(full[r.refers_to] == r.payload_digest for r in revisits)


def test_many_equal_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 7)
    rows = [("x", 1, "http://a", "same")] * 50 + [("x", 2, "http://b", "other")]
    assert sorted(r.page_id for r in op7_warc(spark, pages(spark, tmp_path, rows)).collect()) == [1] * 50 + [2]
