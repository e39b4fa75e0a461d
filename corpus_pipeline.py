"""From raw documents to token ids: five stages, each over all that the one before it kept.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of each class of the n-gram join the document with the least doc_id stays.
3. secrets: live-looking secrets are masked in the text.
4. mixing: every row gets its slot and place in the Pfair schedule; every row stays.
5. encoding: BPE ids of every text, and their number, with slot and place.

All stages but the last return the columns of ``documents``, mixing slot and place too: files and their
readers keep no order, so what trains on the result reads it by (slot, place). SQL can't express the stages (exact
binomial bounds, MinHash, byte-pair merges); tests hold ``run`` against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, ngram_join, quality, secrets
from tidemark.llm.queries import table, vocabulary
from tidemark.llm.shared import cut, discard, made
from tidemark.session import ship

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.placed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = bpe.encoded(docs.select(F.struct("doc_id", "slot", "place").alias("doc_id"), "text"), vocabulary("word_bpe_49k.json"), decode=False)
    return out.select("doc_id.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "doc_id.slot", "doc_id.place")


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", source_mix), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every other stage's table is deleted when the next one is written, with all that its
    stage left in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), set(made())
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            discard(spark, [p for p in made()[:-1] if p not in before])
    return docs
