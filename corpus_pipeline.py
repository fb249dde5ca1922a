"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet to shared
storage and reread as the next one's docs; all but the last return the columns of documents, whatever
their names, untouched but for what the stage is for. An empty table goes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspark.llm.common import materialise, read_table, scratch, shared_folder
from reelspark.llm.decontamination import drop_contaminated
from reelspark.llm.packing import pack, tokenizer_path
from reelspark.llm.secrets import redact_secrets
from reelspark.llm.simhash import drop_similar
from reelspark.llm.toxicity import drop_toxic

#: Near-duplicates: words in a shingle, and the similarity from which on texts are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the lexicon is learned from ``labels`` without its held-out fifth.

    Null and empty texts stay, and so does all where no label teaches anything; repeated rows stay or go together.
    """
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id (null ids last).

    Null, empty and wordless texts are copies of each other; of repeated rows one stays; rows that share an id but not a group all stay.
    """
    return drop_similar(docs, SHINGLE, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` within its error budget go.

    Null, empty and wordless texts stay; repeated rows stay or go together.
    """
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes. Null and empty texts stay as they are, repeated rows each."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 2048 tokens: a row for each piece. Null and empty texts are the end mark alone; repeated rows are packed each."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: SQL can't express these stages; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has put by for itself is removed once its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), path)
    return STAGES[-1][1](spark, docs, sf_dir)
