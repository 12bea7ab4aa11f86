"""A training corpus from `documents`: five stages, each over all rows that the one before it kept.

Toxic documents go; of each group of near copies one document stays; passages that an earlier document has are removed;
sources are mixed to their target weights; what is left is packed into sequences of 1024 tokens. A stage's result is
written as Parquet and read again as the next one's input; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import jaccard, mixing, packing, substring_dedup, toxicity
from sigloom.llm.common import crc_of_id, materialize, table
from sigloom.ship import ship

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM; labels of one id in three are left for measuring."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_of_id() % 3 != 1)
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, name).where(F.col(f"`{name}`") < TOXIC_FROM).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, 0.8); a repeated row stays once.

    Rows with a null id are in no group and all stay.
    """
    ship(spark)
    found = materialize(jaccard.near_duplicates(docs, k=5, num=80, den=100))
    rejected = found.where("component_id <> doc_id").select("doc_id").distinct()
    if rejected.count() <= jaccard.BROADCAST_MEMBERS:
        rejected = F.broadcast(rejected)
    kept = docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document of nothing else goes.

    Other columns stay as they are, whatever their names; n_chars, if there is one, follows a changed text.
    """
    ship(spark)
    others = {c: f"_other{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = substring_dedup.dedup(docs.withColumnsRenamed(others))
    left = out.where("removed_words = 0 or removed_words < n_words")
    kept = [F.col(others.get(c, c)).alias(c) for c in docs.columns]
    if "n_chars" in others:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        length = F.when(F.col("removed_words") > 0, length).otherwise(F.col(others["n_chars"]))
        kept[docs.columns.index("n_chars")] = length.alias("n_chars")
    return left.select(*kept)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its sequence and place there."""
    ship(spark)
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix_to_targets),
    ("best_fit_packing", pack_sequences),
]

#: Learnt scores, hashed draws and token ids are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
