import base64
import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from leadmill.llm import bpe
from leadmill.llm.queries import QUERIES, VOCABULARY

TEXTS = [
    None, "", " ", "  two  spaces ", "don't we'll", "a" * 5000, "0123456789" * 40,
    "\n\n a\t b\r\n", "日本語のテキスト 😀😀", "x　y z", " \x1c \x85 q", "é" * 300,
    "the the the, the. the",
]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(VOCABULARY)


@pytest.fixture(scope="module")
def expected(codec):
    encoding = tiktoken.Encoding(
        "own", pat_str=VOCABULARY.pattern, mergeable_ranks=codec.fst.ranks, special_tokens={}
    )
    return encoding.encode_ordinary


def ids(codec, text):
    blocks = list(codec.encode(text))
    ids = [int(i) for decimals, _ in blocks for i in decimals[:-1].split(",")]
    assert ids == np.frombuffer(b"".join(b for _, b in blocks), np.uint32).tolist()
    return ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abethino ,.\n\t'sreéß😀日01")), max_size=60))
def test_ids_equal_those_of_the_library(codec, expected, text):
    assert ids(codec, text) == expected(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(codec, expected, text):
    assert ids(codec, text) == expected(text)


def test_small_bounds_change_nothing(codec, expected, monkeypatch):
    for name in ("MAX_STATES", "MAX_BORDERS", "MAX_FRAGMENTS", "DECODE_BLOCK"):
        monkeypatch.setattr(bpe, name, 3)
    monkeypatch.setattr(bpe.gc, "collect", lambda: 0)
    small = bpe.Codec(VOCABULARY)
    for text in TEXTS[1:]:
        assert ids(small, text) == expected(text)


def test_ends_of_rare_words_make_no_states(expected):
    fresh = bpe.Codec(VOCABULARY)
    words = [hashlib.md5(bytes([k])).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))
             for k in range(200)]
    text = " ".join(words)
    assert ids(fresh, text) == expected(text)
    assert len(fresh.fst.states) < len(text) // 10
    # A word that comes again and again, but is never remembered, is determinised.
    for _ in range(40):
        assert fresh.fst.encode(words[0].encode()) == expected(words[0])
    made = len(fresh.fst.states)
    assert fresh.fst.encode(words[0].encode()) == expected(words[0])
    assert len(fresh.fst.states) == made > 20


def test_decoder_keeps_an_unfinished_character(codec):
    one = [np.array([codec.fst.ranks[bytes((b,))]], np.uint32).tobytes() for b in "é😀".encode()]
    assert "".join(codec.decode(one)) == "é😀"
    assert "".join(codec.decode(one[:1])) == "�"


def test_encode_decode_and_digests(spark, codec, expected):
    docs = spark.createDataFrame(
        [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "y"), (1, "", "x")],
        "doc_id long, text string, n_tokens string",
    )
    encoded = bpe.encode(docs, VOCABULARY)
    rows = {r.doc_id: r for r in encoded.collect()}
    for i, t in enumerate(TEXTS):
        assert rows[i].tokens == expected(t or "") and rows[i].n_tokens == len(rows[i].tokens)
    back = {r.doc_id: r.text for r in bpe.decode(encoded, VOCABULARY).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
    for r in bpe.round_trip(docs, VOCABULARY).collect():
        text = "a b" if r.doc_id is None else TEXTS[r.doc_id] or ""
        tokens = expected(text)
        assert r.n_tokens == len(tokens)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), VOCABULARY).count() == 0


def test_query(spark, sf_dir, expected):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == len(expected(texts[r.doc_id]))


def test_ranks_without_a_byte_are_refused(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    small = bpe.Codec(bpe.Vocabulary(str(path), VOCABULARY.pattern))
    with pytest.raises(ValueError):
        list(small.encode("b"))
