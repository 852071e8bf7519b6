"""A corpus from documents to packed sequences: quality, near duplicates, personal data, mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's documents.  Verdicts are made, or looked up, where a row lies: only rows that may be
removed or changed are joined with a table, the others are never shuffled.

Defined cases: a row without doc_id is judged by its text, links with nothing and stays unless its text is
rejected; rows equal in doc_id and text become one at the second stage, of rows with one doc_id and several texts
all texts stay or go together; null and empty texts are rejected by the first stage; an empty table gives an empty
result; all but the last stage return the columns of documents, whatever further ones there are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import jaccard, mixing, packing, pii, quality, sieve
from chronoweave.plans.tables import table
from chronoweave.storage import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group linked by 80 % of common 5-word shingles."""
    groups = materialise(jaccard.join(docs, size=5, share=(4, 5)), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    again = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    doc_id = F.col("doc_id").cast("long")
    near, far = sieve.sift(docs, sieve.slot(doc_id), gone.unionByName(again).select(sieve.slot(F.col("doc_id")).alias("m")))
    near = near.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not again.isEmpty():
        once = near.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
        near = near.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
    return near.unionByName(far)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced and revealing terms generalised or removed."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 3, 1, 2 repeating, 150 % of all words."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences of 2048 ids."""
    sequences, width = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packing.pieces(sequences, width)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None  # the forest of the first stage and the tokenizer of the last have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
