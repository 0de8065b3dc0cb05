"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) that works on all rows its predecessor kept. All but the last return
the columns of ``documents``, extra ones included, whatever they are called. A stage's result is written before the next one
reads it. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, minhash, packing, pii, quality
from marlstone.llm.session import cut, prepare, table


#: percent of five-word shingles that near-duplicates share
NEAR = 80


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network rejects go. Null texts count as empty; repeated rows are judged alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id.

    Texts without words are linked with nothing and stay, as do rows without a doc_id. Rows that share doc_id and text are one.
    """
    return minhash.drop_near_duplicates(docs, NEAR)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null texts and rows without a doc_id hold none and stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in a text gives way to its kind; no document goes, null texts stay null, n_chars follows the text."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences; a null text is an end mark alone, repeated rows are packed each by itself."""
    return packing.pack(packing.pieces(docs, with_ids=False)).drop("ids")


STAGES = [
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_items),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]
#: a fitted network, signatures and token ids are beyond SQL; tests/llm compares with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents", True)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
