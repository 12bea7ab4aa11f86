"""The registered queries of the training-data operators, each thin, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_extract, jaccard, lm_score, mixing, packing, phrases, sqls, substring_dedup, toxicity, vector_codes, vector_dedup, warc, wavelet
from .common import crc_of_id, materialize, table, word_count


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "removed_words", "removed", "text")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_of_id() % 5 == 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.links(table(spark, sf_dir, "embeddings"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_of_id() % 3 == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages)).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_wavelet_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents")))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size")))  # texts are read once
    plan = mixing.mixing_plan(docs, size=F.col("size"))
    taken = (F.col("mix_copies") * F.col("size")).alias("taken")
    return plan.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken, "source", "mix_shard")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.lookup(warc.write(pages), pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_lm_score": op3_lm_score,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_toxicity": op7_toxicity,
    "op8_html_main_text": op8_html_main_text,
    "op9_wavelet_token_ids": op9_wavelet_token_ids,
    "op10_mix_sources": op10_mix_sources,
    "op11_vector_codes": op11_vector_codes,
    "op12_warc_captures": op12_warc_captures,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLES: dict[str, str] = {
    "op11_vector_codes": sqls.CODES,
    "op12_warc_captures": sqls.CAPTURES,
    "op13_phrase_collocations": sqls.PHRASES,
}
