"""The similarity join against all pairs in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from leadmill.llm import ngram_join, shingles
from leadmill.llm.components import connected
from leadmill.llm.queries import QUERIES


def word_list(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text, n):
    w = word_list(text)
    if 0 < len(w) < n:
        return {tuple(w)}
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def expected(texts, n=4, percent=85):
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = Counter()
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] += 1
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_words_and_shingles():
    for text in ["", " ", "a", "The  THE\tthe\x0bÄ ä x\x85y z", "é" * 40 + " b", "a b " * 3000]:
        start, end, h = shingles.words(text.encode())
        data = text.encode()
        found = [data[s:e].decode() for s, e in zip(start, end)]
        assert ["".join(c.lower() if c.isascii() else c for c in w) for w in found] == word_list(text)
        assert len(set(h.tolist())) == len(set(word_list(text)))
        assert len(shingles.shingle_set(text, 4)) == len(shingle_set(text, 4))
    assert np.array_equal(shingles.shingle_set("A b", 4), shingles.shingle_set("a  B\n", 4))


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_against_all_pairs(spark, n, percent):
    rng = random.Random(n)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = {0: "", 1: None, 2: "a b", 3: "A  b", 4: "b a", 5: " \n", 6: "x " * 3000, 7: "x " * 2000}
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 120))] for _ in range(25)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    for i in range(10, 250):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts[i] = " ".join(w + common * (i % 3 == 0))
    docs = spark.createDataFrame(
        [(i, t, i) for i, t in texts.items()], "doc_id long, text string, n long"
    )
    how = ngram_join.Similarity(n, percent)
    want = expected(texts, n, percent)
    assert got(ngram_join.near_duplicates(docs, how)) == want
    kept = ngram_join.deduplicate(docs, how)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_missing_ids_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame(
        [(None, text), (None, text), (7, text), (7, text), (9, text + " end"), (3, None)],
        "doc_id long, text string",
    )
    rows = sorted(map(tuple, ngram_join.near_duplicates(docs).select(
        "doc_id", "n_shingles", "component_id").collect()), key=str)
    assert rows == sorted(
        [(None, 37, None)] * 2 + [(7, 37, 7)] * 2 + [(9, 38, 7), (3, 0, 3)], key=str
    )
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    assert ngram_join.deduplicate(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in connected(df).collect()}
    assert roots == {k: 1 for k in range(2, 41)} | {k: 100 for k in range(101, 140)}


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got(QUERIES["op2_ngram_join"](spark, sf_dir)) == expected(texts)
