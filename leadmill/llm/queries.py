"""One query per operator, with production parameters over its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from leadmill.llm import (
    ann, bpe, chat, decontaminate, langid, ngram_join, passages, resample, sharding, token_files,
    toxicity, vector_codes, warc,
)
from leadmill.llm.folds import held_out
from leadmill.llm.staging import new_folder
from leadmill.llm.tables import table

VOCABULARY = bpe.Vocabulary(
    public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
)
TOKENS = token_files.Format(public_tokenizers.path("word_bpe_49k.json"))
#: Bytes of text in a shard.
SHARD_BYTES = 16 << 20


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a transcript, parsed back into turns; of the rendered turns, digests."""
    turns = chat.parse(chat.transcribe(table(spark, sf_dir, "conversations")))
    return turns.select(
        "conv_id", "turn_no", "chunk", "role", "n_lines", F.length("text").alias("n_chars"),
        F.sha2("rendered", 256).alias("rendered_sha256"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under similarity of 4-word shingles."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, and the item."""
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    folder = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_records(spark, folder)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every 20th embedding."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that an earlier document has, exactly or nearly."""
    return passages.repeated(table(spark, sf_dir, "documents")).drop("row_key")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five percent of the documents, drawn towards the benchmark's n-grams."""
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product code and the exact error of every embedding."""
    codes = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    sha = F.create_map(
        F.lit(-1), F.lit(""),
        *[F.lit(v) for n, books in codes.codebooks.items() for v in (n, vector_codes.digest(books))],
    )
    return vector_codes.label_errors(codes.df).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        sha[F.col("length")].alias("codebooks_sha256"),
    )


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to files of token sequences and read back."""
    folder = new_folder(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    token_files.write(docs, folder, TOKENS)
    return token_files.read_digests(spark, folder, docs.schema["doc_id"].dataType.simpleString())


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_ngram_join, op3_sharding, op4_language_id, op5_decontamination,
        op6_toxicity, op7_warc, op8_byte_bpe, op9_nearest_neighbours, op10_substring_dedup,
        op11_importance_resampling, op12_vector_codes, op13_token_files,
    )
}
ORACLES = {
    "op3_sharding": sharding.oracle(SHARD_BYTES),
    "op12_vector_codes": vector_codes.oracle(),
}
