"""From raw documents to token identifiers, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as Parquet and reads it again as the
next stage's documents, so a lost executor costs the stage at hand and no more. All stages but the last return the columns
of ``documents``. Rows are keyed by nothing but their content: repeated rows are near copies of each other, null texts
have no words and fail the quality rules.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.bpe_stream import encode_decode
from tidegrid.llm.common import table
from tidegrid.llm.decontaminate import drop_contaminated
from tidegrid.llm.pii import mask_pii
from tidegrid.llm.quality_rules import keep_good
from tidegrid.llm.simhash import keep_one
from tidegrid.session import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of four-word shingles at four or fewer differing bits: that with the smallest id."""
    return keep_one(docs, distance=4, shingle=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark window."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by its kind; ``n_chars`` follows."""
    return mask_pii(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of each document, with hashes of them and of the text that they decode to."""
    coded = encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("tokens", tokens_stage),
]

#: SQL can express neither the suffix arrays nor the merges; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what the stages return stays in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
