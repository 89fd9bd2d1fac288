"""The training-data pipeline over documents: toxicity, quality rules, n-gram Jaccard join, decontamination, BPE.

Each stage gets what its predecessor kept, as a table read back from Parquet in
the shared folder; a lost executor costs its tasks alone. All but the last stage
return the columns of documents, and columns of other names that docs has.

Of all stages: null and empty texts are no error (quality rules reject them, the
others keep them); texts of any length are read whole; repeated rows get equal
decisions (the Jaccard join keeps one of them); an empty table gives an empty table;
columns that clash with names used within stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwood.llm.bpe_automaton import bpe_encode
from siftwood.llm.common import drop_stored, stored, table
from siftwood.llm.decontaminate import remove_documents
from siftwood.llm.jaccard_join import keep_one
from siftwood.llm.quality_rules import apply_policy, ledger
from siftwood.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps."""
    return apply_policy(ledger(docs)).where("kept").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more."""
    return keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_encode(docs.select("doc_id", "text"), digest=True).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: The toxicity model and the tokenizer can't be put in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:  # nothing reads the stage before any more
            drop_stored(last)
        last = docs
    return docs
