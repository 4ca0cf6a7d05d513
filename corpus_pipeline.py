"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns the columns of `documents`; the last returns the packed pieces. Between stages
the rows are written as Parquet to the shared checkpoint folder and read again; a stage's
folder goes when the next one is written, the last stays for the result.

All stages read whole texts, however long, pass other columns through whatever their names,
and return an empty table for an empty one. What each does with nulls, repeated rows and
ties stands at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import checkpoint_dir, drop_folder
from quadrille.llm.decontaminate import drop_contaminated
from quadrille.llm.minhash import drop_near_duplicates
from quadrille.llm.packing import pack_documents
from quadrille.llm.quality import drop_low_quality
from quadrille.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and wordless texts go. Rows are judged by their texts alone, so repeated rows stay or
    go together, and null ids are kept like others. Evidence exactly at the threshold is kept.
    """
    return drop_low_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class.

    A similarity of exactly 0.8 is a link. Null and wordless texts are classes of their own and
    stay. Of rows with equal id and text one stays, even if their other columns differ; rows with
    one id and different texts stay together or go together. Rows with a null id stay.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised or not.

    Null and empty texts hold none. Rows with one id, a null one too, are judged together and go
    together. Null and empty items are held by nobody.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind; n_chars follows the text.

    Null texts stay null, with a null n_chars; repeated rows are changed alike; of
    overlapping spans the union is replaced by the kind of the first, ties by the rules' order.
    """
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets.

    Null and empty texts are the end token alone; repeated rows and null ids are packed like
    others; which of equally long pieces takes which place is arbitrary.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]
#: No stage but the last could be written in SQL alone; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
