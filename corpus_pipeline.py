"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last
return the columns of ``documents``. A runner writes each result as Parquet and reads it back for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialedger.llm import decontamination, packing, pseudonyms, quality_rules
from medialedger.llm.jaccard_join import JaccardJoin
from medialedger.llm.queries import PSEUDONYM_KEY, table
from medialedger.llm.store import materialize


def sized(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of 1500 rows (some 4 MB) unless the session asks for other than Spark's 10,000: that
    is what a worker and its executor hold of them at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "1500")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the risk-controlled cutoffs reject."""
    sized(spark)
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near duplicates, told apart by id and text; rows without words stay."""
    sized(spark)
    return JaccardJoin(shingle=5, numerator=80).first_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to its edits."""
    sized(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows the new text."""
    done = pseudonyms.pseudonymize(docs, PSEUDONYM_KEY)
    columns = [F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return done.select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens.

    Workers are shared with the stages before, so fewer words are kept than when packing runs by itself.
    """
    sized(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, words_kept=50_000)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pseudonym_stage),
    ("best-fit packing", packing_stage),
]

#: The keyed hashes, the tokenizer and the packing can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
