"""WARC archives as a chunked record table.

A payload travels as rows of record key, chunk number and at most CHUNK bytes. An oversized
payload becomes a segmented record: a first segment and continuation records, as WARC 1.1
defines them, so neither writer nor reader ever builds a whole record. Digests are carried
from chunk to chunk.

Archives are written and read by Spark's text source with the end of a record, an empty line,
as line separator; so they can be in any store, and lost tasks are written again. Each file is
a plain WARC file under one gzip stream.
"""

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK = 1 << 16
#: Bytes of payloads in an archive, as planned from all pages.
ARCHIVE_BYTES = 64 << 20
#: Bytes of chunks that a Python worker hands on at once.
BATCH_BYTES = 1 << 23

_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:leadmill:page"
#: Stands for a chunk number behind all others.
_OTHERS = 1 << 62
_VISIBLE = "".join(map(chr, range(33, 127)))


def _base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _slices(payload: bytes) -> Iterator[memoryview]:
    """At least one slice, so that an empty payload has a chunk too."""
    view = memoryview(payload)
    for k in range(0, max(1, len(view)), CHUNK):
        yield view[k : k + CHUNK]


def _digest(payload: bytes) -> str:
    sha1 = hashlib.sha1()
    for part in _slices(payload):
        sha1.update(part)
    return _base32(sha1)


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows whose last value may be bytes, in frames of a bounded size."""
    block, size = [], 0
    for row in rows:
        block.append(row)
        size += 200 + len(row[-1] or b"")
        if size >= BATCH_BYTES:
            yield pd.DataFrame(block, columns=columns, dtype=object)
            block, size = [], 0
    if block:
        yield pd.DataFrame(block, columns=columns, dtype=object)


def _source(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"),
    )


def payload_digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest and url of the pages, and how many rows have them."""

    def work(batches):
        for pdf in batches:
            yield pd.DataFrame(
                {
                    "page_id": pdf["page_id"].astype("Int64"),
                    "url": pdf["url"],
                    "payload_bytes": [len(p) for p in pdf["payload"]],
                    "payload_digest": [_digest(p) for p in pdf["payload"]],
                }
            )

    return (
        _source(pages)
        .mapInPandas(work, "page_id long, url string, payload_bytes long, payload_digest string")
        .groupBy("page_id", "payload_bytes", "payload_digest", "url")
        .agg(F.count("*").alias("copies"))
    )


def _ids(batch: pd.DataFrame, column: str) -> list:
    return [None if pd.isna(i) else int(i) for i in batch[column]]


def payload_chunks(pages: DataFrame) -> DataFrame:
    """The chunked record table: the rows of a payload carry page_id, digest and chunk_no."""

    def rows(batches):
        for pdf in batches:
            for page_id, url, payload in zip(_ids(pdf, "page_id"), pdf["url"], pdf["payload"]):
                digest = _digest(payload)
                for n, part in enumerate(_slices(payload)):
                    yield page_id, digest, n, len(payload), url, bytes(part)

    columns = ["page_id", "payload_digest", "chunk_no", "payload_bytes", "url", "data"]
    return _source(pages).mapInPandas(
        lambda batches: _frames(rows(batches), columns),
        "page_id long, payload_digest string, chunk_no long, payload_bytes long, "
        "url string, data binary",
    )


def record_types(digests: DataFrame, min_bytes: int) -> DataFrame:
    """For each page and payload of payload_digests(): the page that has its payload, or null.

    Of equal payloads of min_bytes or more, the smallest page_id has the payload and the
    others point to it. Pages without an id come last among their equals. The page's first record
    has the least of its urls.
    """
    one = digests.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.min("url").alias("url"))
    first = one.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"))
    return one.join(first, ["payload_digest", "payload_bytes"]).select(
        "page_id",
        "payload_digest",
        "url",
        F.when(
            (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")),
            F.col("first_id"),
        ).alias("refers_to"),
    )


def _head(kind: str, fields: list[tuple[str, object]], length: int) -> bytes:
    lines = [("WARC-Type", kind), *fields, ("Content-Length", length)]
    return b"WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in lines).encode() + _END


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<{_ID}:{'none' if page_id is None else page_id}:{digest}>"


def _page_of(record_id: str) -> int | None:
    text = record_id[len(_ID) + 2 :].split(":")[0]
    return None if text == "none" else int(text)


def write_archives(
    pages: DataFrame,
    folder: str,
    date: str = "2024-01-01T00:00:00Z",
    min_bytes: int = 0,
    archives: int | None = None,
) -> None:
    """Write a record for each row of pages (page_id, url, html).

    A null html is an empty payload, a null url about:blank. Of rows that repeat both page_id and
    payload, one is as if it were alone, with the least of their urls; the others revisit it, or
    are responses too, if the payload is smaller than min_bytes. An empty table gives archives
    without page records. Other columns are left alone. The number of archives follows the bytes
    of all payloads, unless it is given.
    """
    source = _source(pages)
    if archives is None:
        size = source.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
        archives = max(1, -(-size // ARCHIVE_BYTES))
    digests = payload_digests(pages)
    types = record_types(digests, min_bytes)
    # The row with a page's type comes before its chunks, those of further rows come after them.
    key = ["page_id", "payload_digest"]
    again = digests.groupBy(*key).agg(F.sum("copies").alias("n")).where("n > 1").select(*key)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"a.{c}")) for c in key]
    others = digests.alias("d").join(again.alias("a"), same, "left_semi")
    others = others.select(*key, F.lit(_OTHERS).alias("chunk_no"), "payload_bytes", "url", "copies")
    rows = (
        payload_chunks(pages).drop("url")
        .unionByName(
            types.select(*key, F.lit(-1).cast("long").alias("chunk_no"), "url", "refers_to"),
            allowMissingColumns=True,
        )
        .unionByName(others, allowMissingColumns=True)
    )
    rows = rows.repartition(archives, *key).sortWithinPartitions(*key, "chunk_no", "url")

    def records(batches) -> Iterator[tuple]:
        yield (_head("warcinfo", [("WARC-Date", date), ("WARC-Record-ID", f"<{_ID}:info>")], 0),)
        last = refers_to = first_url = None
        small, made = [], 0
        for pdf in batches:
            for page_id, digest, n, size, url, data, target, copies in zip(
                _ids(pdf, "page_id"), pdf["payload_digest"], pdf["chunk_no"],
                pdf["payload_bytes"], pdf["url"], pdf["data"], _ids(pdf, "refers_to"), _ids(pdf, "copies"),
            ):
                own = _record_id(page_id, digest)
                if n < 0:
                    refers_to, first_url, small, made = target, url, [], 0
                elif n == _OTHERS:
                    to = own if refers_to is None else _record_id(refers_to, digest)
                    # One of them has been written, under the least url.
                    for _ in range(copies - (url == first_url)):
                        made += 1
                        again = f"{own[:-1]}:again{made}>"
                        if size < min_bytes:
                            for k, part in enumerate(small):
                                yield (response(again, digest, k, size, url, part),)
                        else:
                            yield (revisit(again, digest, url, to),)
                elif (page_id, digest, n) == last or refers_to is not None and n:
                    continue  # a repeated row, or a payload that another record has
                elif refers_to is not None:
                    yield (revisit(own, digest, first_url, _record_id(refers_to, digest)),)
                else:
                    if size < min_bytes:
                        small.append(data)
                    yield (response(own, digest, n, size, first_url, data),)
                if n >= 0:
                    last = page_id, digest, n

    def fields_of(own: str, digest: str, url: str | None, first: bool) -> list[tuple[str, object]]:
        uri = quote("about:blank" if url is None else url, safe=_VISIBLE)
        fields = [("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri)]
        if first:
            fields += [
                ("WARC-Payload-Digest", f"sha1:{digest}"),
                ("Content-Type", "application/http; msgtype=response"),
            ]
        return fields

    def revisit(own: str, digest: str, url: str | None, to: str) -> bytes:
        fields = [*fields_of(own, digest, url, True), ("WARC-Profile", _PROFILE), ("WARC-Refers-To", to)]
        return _head("revisit", fields, len(_HTTP)) + _HTTP

    def response(own: str, digest: str, n: int, size: int, url: str | None, data: bytes) -> bytes:
        fields = fields_of(own, digest, url, n == 0)
        if size > CHUNK:
            fields.append(("WARC-Segment-Number", n + 1))
        if not n:
            return _head("response", fields, len(_HTTP) + len(data)) + _HTTP + data
        fields[0] = ("WARC-Record-ID", f"{own[:-1]}:{n + 1}>")
        fields.append(("WARC-Segment-Origin-ID", own))
        if n == (size - 1) // CHUNK:
            fields.append(("WARC-Segment-Total-Length", len(_HTTP) + size))
        return _head("continuation", fields, len(data)) + data

    rows.mapInPandas(lambda b: _frames(records(b), ["value"]), "value binary").select(
        F.col("value").cast("string")
    ).write.option("lineSep", _END.decode()).option("compression", "gzip").text(folder)


def _parsed(lines: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record, from the files' parts between empty lines."""
    file, buffer, head = None, bytearray(), None
    for path, line in lines:
        if path != file:
            if buffer or head:
                raise ValueError(f"{file} ends within a record")
            file = path
        buffer += line
        buffer += _END
        while True:
            if head is None:
                at = buffer.find(_END)
                if at < 0:
                    break
                fields = buffer[:at].decode().split("\r\n")[1:]
                head = dict(f.split(": ", 1) for f in fields)
                del buffer[: at + 4]
            need = int(head["Content-Length"])
            if len(buffer) < need + 4:
                break
            yield head, bytes(buffer[:need])
            del buffer[: need + 4]
            head = None
    if buffer or head:
        raise ValueError(f"{file} ends within a record")


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    lines = ((p, v) for pdf in batches for p, v in zip(pdf["path"], pdf["value"]))
    for head, block in _parsed(lines):
        kind = head["WARC-Type"]
        if kind == "warcinfo":
            continue
        own = head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"])
        if kind != "continuation":
            block = block[block.index(_END) + 4 :]
        yield (
            own,
            int(head.get("WARC-Segment-Number", 1)) - 1,
            kind,
            head.get("WARC-Refers-To"),
            head.get("WARC-Payload-Digest", "")[5:],
            block,
        )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.option("lineSep", _END.decode())
        .text(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary"))
    )


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunked record table of archives."""
    columns = ["record_id", "chunk_no", "type", "refers_to", "digest", "data"]
    return _lines(spark, folder).mapInPandas(
        lambda b: _frames(_chunks(b), columns),
        "record_id string, chunk_no long, type string, refers_to string, digest string, "
        "data binary",
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record of archives.

    page_id, payload_bytes and payload_digest (bare base32) of the full payload, record_type,
    refers_to, and intact: whether the payload has the digest that its header names. A revisit
    takes its size from the response; if that is missing, size and intact are null.
    """

    def fold(batches) -> Iterator[tuple]:
        now = None
        for own, n, kind, target, digest, data in _chunks(batches):
            if n == 0:
                if now:
                    yield now[0], now[1], now[2], now[3], now[4], _base32(now[5])
                now = [own, kind, target, digest, 0, hashlib.sha1()]
            now[4] += len(data)
            now[5].update(data)
        if now:
            yield now[0], now[1], now[2], now[3], now[4], _base32(now[5])

    def work(batches):
        block = []
        for own, kind, target, named, size, found in fold(batches):
            refers = None if target is None else _page_of(target)
            block.append((_page_of(own), own, target, kind, refers, named, size, found == named))
            if len(block) == 5000:
                yield pd.DataFrame(block, columns=columns, dtype=object)
                block = []
        yield pd.DataFrame(block, columns=columns, dtype=object)

    columns = ["page_id", "record_id", "target", "record_type", "refers_to", "payload_digest",
               "payload_bytes", "intact"]
    records = _lines(spark, folder).mapInPandas(
        work,
        "page_id long, record_id string, target string, record_type string, refers_to long, "
        "payload_digest string, payload_bytes long, intact boolean",
    )
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    responses = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "intact").join(
        responses.select(F.col("record_id").alias("target"), "payload_bytes", "intact"),
        "target",
        "left",
    )
    return responses.select(out).unionByName(revisits.select(out))
