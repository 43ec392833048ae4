"""From raw documents to training sequences: clean, drop near copies, benchmark passages and secrets, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm.decontaminate import clean_documents
from adloom.llm.packing import packed_documents
from adloom.llm.quality import line_quality
from adloom.llm.secrets import redact, secret_spans
from adloom.llm.simhash import one_of_each
from adloom.session import materialize


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """The given columns with a new text and, if there is one, its new number of characters."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return docs.select(*[new.get(c, F.col(c)).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    judged = line_quality(docs, name="_quality").filter("_quality.kept")
    return _with_text(judged, docs.columns, F.col("_quality.clean_text"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, each row judged by its own text."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_text=True)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    found = secret_spans(docs, name="_secrets")
    return _with_text(found, docs.columns, redact(F.col("text"), F.col("_secrets")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in a sequence."""
    return packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Fingerprints and token ids are beyond SQL; tests compare the pipeline with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
