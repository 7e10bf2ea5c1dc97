"""From raw documents to packed sequences: quality rules, language, one of each group of near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import op2_line_frequency, op3_language, op4_packing, op9_jaccard
from millrace.llm.common import settle

#: A document whose language is less certain than this goes.
LEAST_CERTAIN = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents of a host share are removed; documents that fail the base rules or are depleted go."""
    return op2_line_frequency.clean(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of an uncertain one, go; a document without a label gets the one found."""
    model = op3_language.fit(docs)
    found = op3_language.predict(docs, model).where((F.col("lang_pred") != op3_language.UNKNOWN) & (F.col("lang_score") >= LEAST_CERTAIN))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity 3/4 connect, the one with the smallest doc_id stays."""
    return op9_jaccard.one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, in sequences of at most 2048."""
    import public_tokenizers

    return op4_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies), ("packing", packing)]

#: Language identification and tokens are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
