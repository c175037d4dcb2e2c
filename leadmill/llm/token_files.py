"""Token ids in Arrow files of equal-length sequences.

A shard is a range of documents in ascending order of their ids, in two files of the Arrow IPC
file format (the stream format with a footer that locates each batch):

* sequences: `ids`, fixed-size lists of unsigned integers of the vocabulary's width, and
  `mask`, fixed-size lists of booleans, false behind the last token. Each document's tokens are
  followed by the end id; a shard's tokens fill sequence after sequence, so only the last one
  of a shard is padded. All batches but the last have the same number of sequences.
* documents: id, start (tokens of the shard before it) and n_tokens.

Buffers are not compressed, so from a mapped file any sequence, mask or run of tokens is a view
of the file's pages. The manifest, a Parquet table, names the files of each shard; it is written
by Spark's commit protocol, so files of tasks that were lost or ran twice are in no manifest and
are removed.
"""

import os
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate, chain
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from leadmill.llm.bpe import no_collection

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text per shard, as planned from all texts' lengths.
SHARD_BYTES = 64 << 20
#: Pieces of text that one Python worker remembers, and the longest one.
MAX_PIECES, LONG_PIECE = 800_000, 40
#: Pieces of texts that are encoded at once.
GROUP = 200_000


@dataclass(frozen=True)
class Format:
    """Tokenizer file, id after each document, tokens in a sequence, sequences in a batch."""

    tokenizer: str
    end_id: int = 2
    length: int = 2048
    batch: int = 64


def _halves(piece: str) -> tuple[str, str]:
    """Two texts whose ids, joined, are those of the piece; they recur more often than it.

    The splitter parts a run of letters from a punctuation mark behind it, and the normaliser
    lowers all letters. A letter whose small form ends with a mark would join what follows.
    """
    core = piece.rstrip(",.;:!?")
    if core != piece and core.isalpha() and core[-1].lower().isalpha():
        return (core.lower() if core.isascii() else core), piece[len(core) :]
    return (piece.lower() if piece.isascii() and piece.isalpha() else piece), ""


class Encoder:
    """Ids of whole texts, from remembered pieces.

    No token of the vocabulary crosses white space, and neither its normaliser nor its splitter
    looks across it. So a text's ids are those of its pieces between spaces and line ends, one
    after the other; the library encodes each piece when it comes up first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}
        self.long: list[str] = []

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        code = "H" if self.kind.itemsize == 2 else "I"
        return {p: array(code, e.ids).tobytes() for p, e in zip(pieces, found)}

    def _knowing(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of all these pieces, and maybe of others."""
        new = pieces.difference(self.known)
        if not new:
            return self.known
        if len(self.known) + len(new) > MAX_PIECES:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        halves = {p: _halves(p) for p in new}
        parts = set(chain.from_iterable(halves.values())).difference(self.known)
        self.known |= self._learn(list(parts))
        known = self.known
        known |= {p: known[a] + known[b] for p, (a, b) in halves.items()}
        self.long = [p for p in parts | new if len(p) > LONG_PIECE]
        return known

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[bytes]]:
        """Per text its ids, in parts. Texts go in groups, whose new pieces the library encodes
        in one call; a long text goes in several such groups, so its pieces are never all held.
        A group's pieces are many lists, which searches for cyclic garbage would go through."""
        with no_collection():
            yield from self._grouped(texts)

    def _grouped(self, texts: Iterable[str | None]) -> Iterator[list[bytes]]:
        group, size = [], 0
        for text in texts:
            pieces = (text or "").replace("\n", " ").split(" ")
            if len(pieces) > GROUP:
                yield from self._encoded(group)
                group, size = [], 0
                yield [
                    part
                    for k in range(0, len(pieces), GROUP)
                    for (part,) in self._encoded([pieces[k : k + GROUP]])
                ]
                continue
            group.append(pieces)
            size += len(pieces)
            if size >= GROUP:
                yield from self._encoded(group)
                group, size = [], 0
        yield from self._encoded(group)

    def _encoded(self, group: list[list[str]]) -> Iterator[list[bytes]]:
        known = self._knowing(set(chain.from_iterable(group)))
        for pieces in group:
            yield [b"".join([known[p] for p in pieces])]
        for p in self.long:
            del known[p]
        self.long = []


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder's address and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


class _Writer:
    """Sequences of one shard, written batch by batch."""

    def __init__(self, sink, fmt: Format, kind: np.dtype):
        self.fmt, self.kind = fmt, kind
        self.width = fmt.length * kind.itemsize
        ids = pa.list_(pa.uint16() if kind.itemsize == 2 else pa.uint32(), fmt.length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), fmt.length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.waiting, self.size = [], 0

    def add(self, data: bytes) -> None:
        self.waiting.append(data)
        self.size += len(data)
        if self.size >= self.fmt.batch * self.width:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data, whole = b"".join(self.waiting), self.fmt.batch * self.width
        at = 0
        while len(data) - at >= whole:
            self._write(data[at : at + whole])
            at += whole
        if last and at < len(data):
            self._write(data[at:])
            at = len(data)
        self.waiting, self.size = [data[at:]], len(data) - at

    def _write(self, data: bytes) -> None:
        rows, tokens = -(-len(data) // self.width), len(data) // self.kind.itemsize
        n = rows * self.fmt.length
        data += bytes(rows * self.width - len(data))
        mask = np.packbits(np.arange(n) < tokens, bitorder="little")
        flat = [
            pa.Array.from_buffers(self.schema.field("ids").type.value_type, n, [None, pa.py_buffer(data)]),
            pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(mask)]),
        ]
        self.out.write_batch(
            pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(f, self.fmt.length) for f in flat], schema=self.schema
            )
        )

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class TokenShard:
    """Random access to the files of a shard; local files are mapped, not read."""

    def __init__(self, folder: str, sequences: str, documents: str):
        fs, path = filesystem(folder)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        opened = [
            pa.memory_map(f"{path}/{name}") if local else fs.open_input_file(f"{path}/{name}")
            for name in (sequences, documents)
        ]
        self.files = opened
        self.data, self.index = map(pa.ipc.open_file, opened)
        kind = self.data.schema.field("ids").type
        self.length = kind.list_size
        self.kind = np.dtype("<u2" if kind.value_type == pa.uint16() else "<u4")
        self.rows = self.data.get_batch(0).num_rows if self.data.num_record_batches else 1
        self._last = (-1, None)

    def __enter__(self) -> "TokenShard":
        return self

    def __exit__(self, *_) -> None:
        for f in self.files:
            f.close()

    def _flat(self, batch: int) -> np.ndarray:
        """All ids of a batch, as a view of its buffer."""
        if self._last[0] != batch:
            column = self.data.get_batch(batch).column("ids")
            self._last = (batch, np.frombuffer(column.flatten().buffers()[1], self.kind))
        return self._last[1]

    def sequence(self, k: int) -> np.ndarray:
        at = k % self.rows * self.length
        return self._flat(k // self.rows)[at : at + self.length]

    def mask(self, k: int) -> pa.BooleanArray:
        column = self.data.get_batch(k // self.rows).column("mask")
        return column.flatten().slice(k % self.rows * self.length, self.length)

    def tokens(self, start: int, count: int) -> Iterator[np.ndarray]:
        """`count` tokens from `start` on, in views of one batch each."""
        whole = self.rows * self.length
        while count > 0:
            batch, at = divmod(start, whole)
            part = self._flat(batch)[at : at + count]
            yield part
            start, count = start + len(part), count - len(part)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for k in range(self.index.num_record_batches):
            yield self.index.get_batch(k)


def write(
    docs: DataFrame, folder: str, fmt: Format, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all texts to `folder` and give the manifest: shard, files, documents, tokens.

    A null or empty text has the end id alone. Rows without an id come first; rows that share an
    id are in the order of a hash of their texts, and repeated rows follow each other, each a
    document. An empty table gives no shard. Texts are dealt by ranges of the id, that hash and
    their place in the input, so a frequent id is spread over shards; the number of shards follows
    the bytes of all texts. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(1, ((size[0] or 0) + 16 * size[1]) // SHARD_BYTES)
    order = [F.asc_nulls_first("id"), F.col("_text"), F.col("_place")]
    dealt = (
        rows.withColumns({"_text": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
        .repartitionByRange(shards, *order)
        .sortWithinPartitions(*order)
        .select("id", "text")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = index = None
        start = count = 0
        codec = encoder(fmt.tokenizer)
        end = np.array([fmt.end_id], codec.kind).tobytes()
        shard = TaskContext.get().partitionId()
        fs, path = filesystem(folder)
        names = [f"{what}-{shard:06d}-{uuid4().hex}.arrow" for what in ("sequences", "documents")]
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(path)
                sinks = [fs.open_output_stream(f"{path}/{name}") for name in names]
                writer = _Writer(sinks[0], fmt, codec.kind)
                fields = [batch.schema.field("id"), ("start", pa.int64()), ("n_tokens", pa.int64())]
                schema = pa.schema(fields)
                index = pa.ipc.new_file(sinks[1], schema)
            lengths = []
            for parts in codec.encode(text.as_py() for text in batch.column("text")):
                for data in [*parts, end]:
                    writer.add(data)
                lengths.append(sum(map(len, parts)) // codec.kind.itemsize + 1)
            starts = np.cumsum([start, *lengths])
            start, count = int(starts[-1]), count + len(lengths)
            index.write_batch(
                pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(starts[:-1]), pa.array(lengths, pa.int64())],
                    schema=schema,
                )
            )
        if writer is not None:
            writer.close()
            index.close()
            for sink in sinks:
                sink.close()
            row = [[shard], [names[0]], [names[1]], [count], [start]]
            yield pa.RecordBatch.from_arrays(
                list(map(pa.array, row)), ["shard", "sequences", "documents", "n_documents", "n_tokens"]
            )

    manifest = dealt.mapInArrow(
        work, "shard long, sequences string, documents string, n_documents long, n_tokens long"
    )
    manifest.write.parquet(f"{folder}/manifest")
    kept = spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")
    _remove_orphans(folder, kept)
    return kept


def _remove_orphans(folder: str, manifest: DataFrame) -> None:
    """Files of lost or repeated tasks: those that the manifest doesn't name."""
    fs, path = filesystem(folder)
    named = {name for r in manifest.select("sequences", "documents").collect() for name in r}
    for info in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
        if info.is_file and info.base_name.endswith(".arrow") and info.base_name not in named:
            fs.delete_file(info.path)


def read_digests(spark: SparkSession, folder: str, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """Per document in the folder's files: its id, start, n_tokens (with the end id), ids_crc32.

    start counts the tokens of all documents before it, over all shards. ids_crc32 is the CRC-32
    of its ids as little-endian unsigned 32-bit integers. Shards are read one by one, a batch at
    a time, each by the task that its row of the manifest goes to.
    """
    schema = "shard long, sequences string, documents string, n_documents long, n_tokens long"
    shards = sorted(spark.read.schema(schema).parquet(f"{folder}/manifest").collect())
    before = list(accumulate((s.n_tokens for s in shards), initial=0))
    rows = [(s.shard, s.sequences, s.documents, b) for s, b in zip(shards, before)]
    listed = spark.createDataFrame(rows, "shard long, sequences string, documents string, base long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with TokenShard(folder, row["sequences"], row["documents"]) as shard:
                    for part in shard.documents():
                        starts, counts = (part.column(c).to_numpy() for c in ("start", "n_tokens"))
                        sums = []
                        for start, count in zip(starts.tolist(), counts.tolist()):
                            crc = 0
                            for ids in shard.tokens(start, count):
                                crc = crc32(np.ascontiguousarray(ids, "<u4"), crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("id"), pa.array(starts + row["base"]), part.column("n_tokens"),
                             pa.array(sums, pa.int64())],
                            ["id", "start", "n_tokens", "ids_crc32"],
                        )

    if len(rows) > 1:
        listed = listed.repartitionByRange(len(rows), "shard")
    return listed.mapInArrow(
        work, f"id {id_type}, start long, n_tokens long, ids_crc32 long"
    ).withColumnRenamed("id", id_col)
