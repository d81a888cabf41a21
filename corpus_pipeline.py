"""A corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs; all but the last keep the columns
of documents. Every stage works on all rows that it is given:

* quality: a null or empty text is judged by the thresholds alone; ids that repeat are
  judged row by row; with no ratings every row stays.
* near_duplicates: of equal rows and of equal texts one stays, the one of the least id;
  null and wordless texts all stay.
* decontamination: null and empty texts have no words and stay, repeated rows go or
  stay together; an empty benchmark removes nothing.
* personal_data: null texts stay null; each row is masked for itself.
* packing: a null text is its end id; repeated rows are packed one by one.

Very long texts count in full in each of them. Tables with extra columns keep them up
to packing, whatever their names; empty tables give empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import decontam, minhash, packing, pii, quality
from shelfspark.llm.queries import TOKENIZER
from shelfspark.session import remove, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the rated ones, does not reject."""
    ratings = table(spark, sf_dir, "labels").select("doc_id", quality.grade().alias("grade"))
    return quality.keep_good(docs, quality.fit(docs, ratings))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: The model, the classes and the packing are not expressible in SQL; a test holds the whole against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
