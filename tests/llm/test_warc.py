import base64
import gzip
import hashlib

import pytest

from leadmill.llm import warc
from leadmill.llm.queries import QUERIES
from leadmill.llm.staging import new_folder

HTML = {
    1: "<p>one</p>", 2: "<p>one</p>", 3: None, 4: "", 5: "ends \r\n", 6: "\r\n\r\n twice \r\n\r\n",
    7: "é😀" * 60_000, 8: "é😀" * 60_000, 9: "x" * warc.CHUNK, 10: "x" * (warc.CHUNK + 1),
    11: "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", 12: "<p>one</p>",
}


def want(html):
    first, out = {}, {}
    for i in sorted(html):
        data = (html[i] or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        target = first.setdefault(digest, i)
        kind = ("response", None) if target == i else ("revisit", target)
        out[i] = (len(data), digest, *kind)
    return out


def got(rows):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/ü {i}\n" if i % 2 else None, h, "z") for i, h in HTML.items()]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "page_id long, url string, html string, data string")


def test_round_trip(spark, pages):
    folder = new_folder(spark, "warc")
    warc.write_archives(pages, folder, archives=3)
    every = warc.read_records(spark, folder).collect()
    # The row that is repeated has a record of its own, as the contract asks.
    (again,) = (r for r in every if r.refers_to == r.page_id)
    assert (again.page_id, again.record_type) == (1, "revisit")
    rows = [r for r in every if r is not again]
    assert got(rows) == want(HTML) and len(rows) == len(HTML) and all(r.intact for r in every)
    chunks = warc.read_chunks(spark, folder).collect()
    assert max(len(r.data) for r in chunks) <= warc.CHUNK
    parts = sorted((r.chunk_no, bytes(r.data)) for r in chunks if ":7:" in r.record_id)
    assert b"".join(p for _, p in parts).decode() == HTML[7] and len(parts) > 5


def test_files_are_warc(spark, pages, tmp_path):
    folder = str(tmp_path / "archives")
    warc.write_archives(pages, folder, archives=2)
    files = sorted((tmp_path / "archives").glob("*.gz"))
    assert len(files) == 2
    for f in files:
        data, at = gzip.decompress(f.read_bytes()), 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            body = data.index(b"\r\n\r\n", at) + 4
            head = dict(x.split(": ", 1) for x in data[at:body].decode().split("\r\n")[1:-2])
            at = body + int(head["Content-Length"]) + 4
            assert data[at - 4 : at] == b"\r\n\r\n"


def test_pages_without_id_and_empty_tables(spark, pages):
    few = spark.createDataFrame(
        [(None, "u", "same"), (5, "u", "same"), (None, None, "own")],
        "page_id long, url string, html string",
    )
    folder = new_folder(spark, "warc")
    warc.write_archives(few, folder)
    rows = warc.read_records(spark, folder).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows) == [
        (0, "response", None), (0, "revisit", 5), (5, "response", None),
    ]
    folder = new_folder(spark, "warc")
    warc.write_archives(pages.limit(0), folder)
    assert warc.read_records(spark, folder).count() == 0


@pytest.mark.parametrize("min_bytes", [0, 200_000])
def test_every_row_has_a_record(spark, min_bytes):
    long = "z" * 150_000
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (1, None, "x"), (2, "c", "x"), (2, "c", "x"),
            (None, "n", "x"), (None, "n", "x"), (3, "l", long), (3, "l", long), (3, "l", "other")]
    few = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = new_folder(spark, "warc")
    warc.write_archives(few, folder, min_bytes=min_bytes, archives=2)
    read = warc.read_records(spark, folder).collect()
    found = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in read)
    assert all(r.intact for r in read)
    if min_bytes:
        assert found == sorted((i or 0, len(h), "response", 0) for i, _, h in rows)
    else:
        assert found == [
            (0, 1, "revisit", 1), (0, 1, "revisit", 1), (1, 1, "response", 0), (1, 1, "revisit", 1),
            (1, 1, "revisit", 1), (1, 1, "revisit", 1), (2, 1, "revisit", 1), (2, 1, "revisit", 1),
            (3, 5, "response", 0), (3, 150_000, "response", 0), (3, 150_000, "revisit", 3),
        ]


def test_small_payloads_are_not_revisited(spark, pages):
    folder = new_folder(spark, "warc")
    warc.write_archives(pages, folder, min_bytes=100)
    kinds = {r.page_id: r.record_type for r in warc.read_records(spark, folder).collect()}
    assert kinds[2] == "response" and kinds[8] == "revisit"


def test_query(spark, sf_dir):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert got(QUERIES["op7_warc"](spark, sf_dir).collect()) == want(html)
