"""Language and toxicity: held-out accuracy, and defined results at the edges."""

import zlib

import numpy as np
import pytest

from leadmill.llm import langid, toxicity
from leadmill.llm.queries import QUERIES

BIG = "/root/testdata/sf0.01"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}


def test_language_of_held_out_documents(spark, documents):
    rows = QUERIES["op4_language_id"](spark, BIG).collect()
    assert len(rows) == len(documents)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    tried = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == documents[r.doc_id].lang for r in tried)
    assert right >= 0.98 * len(tried)


def test_toxicity_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = QUERIES["op6_toxicity"](spark, BIG).collect()
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == (r.score >= 0.7) for r in rows)
    tried = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, t in tried if t == k] for k in (0, 1))
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert wins >= 0.85
    assert np.mean([s >= 0.7 for s in good]) <= 0.05


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 12, 40])
def test_codewords_tell_languages_apart(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
    assert n == 1 or len({tuple(c) for c in code}) == n


def test_language_edges(spark):
    rows = [(i, t, lang, 1.0) for i, (t, lang) in enumerate(
        [("the house and the garden " * 5, "en"), ("das Haus und der Garten " * 5, "de")] * 30
        + [(None, "en"), ("", "en"), ("12 34 !", None), ("und der die das " * 9000, None)]
    )] + [(None, "the house", None, 1.0), (0, "the house", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    found = langid.identify(docs, langid.train(docs)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found if r.doc_id is not None and r.doc_id > 0}
    assert [by[i].lang_pred for i in (60, 61, 62, 63)] == ["und", "und", "und", "de"]
    assert by[60].score == 0 and by[1].lang_pred == "de"
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), nothing).count() == 0
    one = langid.train(docs.where("lang = 'en'"))
    assert langid.identify(docs, one).where("doc_id = 1").first().lang_pred == "en"


def test_toxicity_edges(spark):
    rows = [(i, ("you idiot here " if i % 5 == 0 else "a good day ") + f"w{i % 7} " * 4, 5)
            for i in range(300)]
    rows += [(300, None, 5), (301, "", 5), (302, "fine " * 30000, 5), (None, "you idiot", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame(
        [(i, int(i % 5 == 0), 1) for i in range(0, 200)] + [(None, 1, 1), (3, None, 1), (5, 0, 1)],
        "doc_id long, toxic int, text int",
    )
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(found) == len(rows)
    assert found[295].predicted == 1 and found[296].predicted == 0 and found[302].predicted == 0
    assert found[300].score == found[301].score < 0.7 and found[None].predicted == 1
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted == 0 for r in found.values())
    none = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
    # All documents labelled: the fold itself serves as the unlabelled texts.
    assert toxicity.train(docs.where("doc_id < 200"), labels).vocabulary
