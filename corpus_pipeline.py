"""From raw documents to token ids: toxicity, near-duplicates, personal data, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents; repeated rows count once from the second stage on. Further columns of docs pass through, whatever their names.

Defined cases: a null or empty text is not toxic, has no near-duplicates and no personal data, and counts no words in the
mix, which takes it as often as its source has whole epochs; texts of any length go through whole; a null doc_id stays until the end; of documents that tie
for a group of near-duplicates the smallest doc_id stays; with empty tables every stage gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, minhash, mixing, pii, toxicity
from tidemark.llm.common import Scratch, packed, table, unpacked


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below the threshold; the model learns from labels of these documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(packed(docs, "text"), model)
    return unpacked(scored.where(F.col("score") < toxicity.THRESHOLD), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of near-copies (five-word shingles, 0.8); rows without doc_id stay."""
    groups = minhash.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80)
    kept = groups.where("kept").select("doc_id").distinct()
    once = packed(docs.where("doc_id is not null").join(kept, "doc_id", "left_semi"), "doc_id", "text").dropDuplicates(["doc_id", "text"])
    return unpacked(once, docs).unionByName(docs.where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text replaced by its kind; n_chars is counted again."""
    found = pii.find(packed(docs, "text"))
    cleaned = unpacked(found.withColumn("text", F.col("redacted")), docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and digests of the ids and of what they decode to."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text")).drop("text"))
    return coded.select(
        "doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

ORACLE_SQL = None  # no stage but mixing is expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, f"{i}-{name}")
    return docs
