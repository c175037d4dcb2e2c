"""The pipeline against what its operators find, stage by stage."""

import corpus_pipeline
from leadmill.llm import decontaminate, toxicity
from leadmill.llm.queries import VOCABULARY
from leadmill.llm import bpe
from tests.llm.test_ngram_join import expected
from tests.llm.test_passages import covered, exact_repeats
from leadmill.llm import passages


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    assert clean.schema == docs.schema
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity.score(docs, model)
    assert set(rows(clean)) == {r.doc_id for r in scores.where("predicted = 0").collect()}

    first = stages["ngram_join"](spark, clean, sf_dir).cache()
    groups = expected({i: r.text for i, r in rows(clean).items()}, 5, 80)
    assert set(rows(first)) == {i for i, (_, c) in groups.items() if i == c}
    assert first.columns == docs.columns

    cut = stages["substring_dedup"](spark, first, sf_dir).cache()
    assert cut.columns == docs.columns and set(rows(cut)) == set(rows(first))
    before = {i: r.text for i, r in rows(first).items()}
    cover = covered(passages.repeated(first).collect())
    for i, r in rows(cut).items():
        assert r.n_chars == len(r.text)
        assert (r.text == before[i]) == (i not in cover)
    assert set(exact_repeats(before)) <= set(cover)

    pure = stages["decontamination"](spark, cut, sf_dir).cache()
    bad = decontaminate.find(cut, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert set(rows(pure)) == set(rows(cut)) - {r.doc_id for r in bad.collect()}

    last = rows(stages["byte_bpe"](spark, pure, sf_dir))
    assert last == rows(bpe.round_trip(pure, VOCABULARY))
    assert rows(corpus_pipeline.run(spark, sf_dir)) == last


def test_odd_rows_pass_all_stages(spark, sf_dir):
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0),
         (2, "word " * 9000, None, "s", 5), (3, None, "de", None, None)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() == docs.count(), name
