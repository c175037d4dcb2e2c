import gc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from leadmill.llm import token_files
from leadmill.llm.queries import QUERIES, TOKENS

SMALL = token_files.Format(TOKENS.tokenizer, length=16, batch=3)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def expected(tokenizer, docs):
    """doc_id, start, n_tokens, ids_crc32 of documents in order."""
    out, at = [], 0
    for i, text in docs:
        ids = ids_of(tokenizer, text)
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    want = expected(tokenizer, [(r.doc_id, r.text) for r in docs.collect()])
    rows = QUERIES["op13_token_files"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == want


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r\x1c\x85 ́éÉ'sİΣς<|>")), max_size=60))
def test_pieces_give_the_ids_of_the_whole_text(text):
    codec = token_files.encoder(TOKENS.tokenizer)
    ((*got,),) = codec.encode([text])
    got = np.frombuffer(b"".join(got), codec.kind).tolist()
    assert got == codec.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("most, group", [(3, 4), (5, 1), (1000, 200_000)])
def test_special_strings_and_forgetting(monkeypatch, most, group):
    monkeypatch.setattr(token_files, "MAX_PIECES", most)
    monkeypatch.setattr(token_files, "GROUP", group)
    codec = token_files.Encoder(TOKENS.tokenizer)
    texts = ["a b c d e f g a b c", None, "x<|endoftext|> y", "q" * 500 + " a", "", "  a\n\nb  ", "é" * 50_000]
    got = list(codec.encode(texts))
    assert len(got) == len(texts)
    for text, parts in zip(texts, got):
        ids = np.frombuffer(b"".join(parts), codec.kind).tolist()
        assert ids == codec.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_no_search_for_garbage_while_encoding():
    assert gc.isenabled()
    for _ in token_files.encoder(TOKENS.tokenizer).encode(["a b", None]):
        assert not gc.isenabled()
    assert gc.isenabled()


def test_files(spark, tmp_path, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 5_000)
    texts = [None, "", "# a # b", "word " * 4000, "é 漢字 emoji 🙂", "x" * 3000] + [f"text {i} " * (i % 9) for i in range(300)]
    docs = [(3 * i - 50, t) for i, t in enumerate(texts)]
    rows = [(*d, "x", 1) for d in docs] + [(None, "no id", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, id int").repartition(5)
    folder = str(tmp_path / "tokens")
    manifest = token_files.write(df, f"file://{folder}", SMALL).orderBy("shard").collect()
    want = expected(tokenizer, [(None, "no id"), *docs])
    got = token_files.read_digests(spark, folder).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert len(manifest) > 2 and sum(s.n_documents for s in manifest) == len(want)

    whole = np.concatenate([ids_of(tokenizer, t) for _, t in [(None, "no id"), *docs]])
    at = 0
    for s in manifest:
        with token_files.TokenShard(folder, s.sequences, s.documents) as shard:
            for k in range(-(-s.n_tokens // 16)):
                left = min(16, s.n_tokens - 16 * k)
                ids = shard.sequence(k)
                assert ids.tolist() == whole[at : at + left].tolist() + [0] * (16 - left)
                assert shard.mask(k).to_pylist() == [True] * left + [False] * (16 - left)
                assert len(ids) == 16 and not ids.flags.owndata
                at += left
    assert at == len(whole)


def test_views_are_of_the_mapped_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words " * 500)], "doc_id long, text string")
    (s,) = token_files.write(df, str(tmp_path / "t"), SMALL).collect()
    before = pa.total_allocated_bytes()
    with token_files.TokenShard(str(tmp_path / "t"), s.sequences, s.documents) as shard:
        parts = list(shard.tokens(5, 900))
        assert sum(map(len, parts)) == 900 and pa.total_allocated_bytes() - before < 1024


def test_files_outside_the_manifest_go(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "sequences-000000-lost.arrow").write_bytes(b"half")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id long, text string")
    token_files.write(df, str(folder), SMALL)
    assert not (folder / "sequences-000000-lost.arrow").exists()
    assert sorted(r.start for r in token_files.read_digests(spark, str(folder)).collect()) == [0, 2, 4]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert token_files.write(df, str(tmp_path / "t"), SMALL).count() == 0
    assert token_files.read_digests(spark, str(tmp_path / "t"), "string").count() == 0
