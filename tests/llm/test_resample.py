import hashlib
import math
import re
import zlib

import pytest

from leadmill.llm import resample
from leadmill.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def buckets(text, f):
    return [zlib.crc32(x.encode()) % f.buckets for x in features(text, f.longest)]


def by_hand(docs, target, percent, min_words, f):
    """doc_id -> (n_features, weight, score, rank); docs have distinct ids."""
    raw, goal = [0] * f.buckets, [0] * f.buckets
    for counts, texts in ((raw, [t for _, t in docs]), (goal, target)):
        for t in texts:
            for b in buckets(t, f):
                counts[b] += 1
    s_all, t_all = sum(raw) + f.buckets, sum(goal) + f.buckets
    gain = [
        math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(raw, goal)
    ]
    out = {}
    for i, t in docs:
        b = buckets(t, f)
        weight = sum(gain[x] for x in b)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(b), weight, score, None]
    able = [i for i, t in docs if i is not None and len(words(t)) >= min_words]
    able.sort(key=lambda i: (-out[i][2], i))
    for rank, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][3] = rank
    return out


def found(rows):
    return {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in rows}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = QUERIES["op11_importance_resampling"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert found(rows) == by_hand(docs, target, 5, 20, resample.Features())


@pytest.mark.parametrize("longest, block", [(1, 3), (2, 1), (3, 2), (3, 50_000), (4, 3)])
def test_scan_equals_plain_runs(longest, block, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", block)
    f = resample.Features(longest, 1000)
    for text in [None, "", " ", "!?", "a", "A  b", "one, two-three\x7ffour", "é Ü x 1 2", "a " * 9]:
        got = list(f.scan(f.pattern(), text))
        assert sum(n for n, _ in got) == len(words(text))
        assert sorted(x for _, at in got for x in at) == sorted(buckets(text, f)), text


def test_edges(spark):
    f = resample.Features(2, 64)
    texts = [None, "", "--", "a b c d", "A B C D", "goal words here again", "ä ö ü x y", "z" * 90_000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "goal words here again"), (90, "long text " * 40_000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, rank string, bucket int")
    target = spark.createDataFrame([("goal words",), (None,), ("",)], "text string")
    got = resample.resample(df, target, percent=50, min_words=3, features=f)
    assert found(got.collect()) == by_hand(docs, ["goal words", None, ""], 50, 3, f)
    assert resample.resample(df.limit(0), target, features=f).count() == 0
    none = resample.resample(df, target.limit(0), percent=50, min_words=3, features=f)
    assert found(none.collect()) == by_hand(docs, [], 50, 3, f)


def test_repeated_rows_and_ties_are_ranked_one_by_one(spark):
    rows = [(7, "same words in all of these")] * 300 + [(i, "other words in this one") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = resample.resample(df, df, percent=90, min_words=2).collect()
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 361)) and len(got) == 400
    assert ranked == sorted(ranked, key=lambda r: (-r.score, r.doc_id, r["rank"]))
    left = [r for r in got if not r["rank"]]
    assert max(r.score for r in left) <= ranked[-1].score
