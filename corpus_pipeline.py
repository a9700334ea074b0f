"""A cleaning pipeline over ``documents``: each stage works on all that the stage before kept.

Stages: language identification (documents without a recognisable language go), near
duplicates by shingle Jaccard (five words, 0.8; one document of each group stays), repeated
passages of 50 words or 400 bytes (cut from the texts), benchmark passages (documents that hold one go), and encoding.
All but the last return the columns of ``documents``, whatever further columns there are and however they are called.

Null, empty and letterless texts have no language and go in the first stage; called alone, each later stage keeps them, a
null text null (``encoded`` gives it no tokens). A null id is an id larger than all others. Of rows that agree in id
and text one stays; of tied copies the least id, then the least text hash. Texts are never shortened to a limit. No rows in, no rows out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import byte_bpe, decontaminate, jaccard_join, language_id, suffix_dedup
from packetloom.llm.common import unused
from packetloom.session import scratch_path

#: No passage of WORDS words is shorter than LEAST_BYTES: a byte for every word and every space between them.
WORDS, LEAST_BYTES, GRAM = 50, 99, 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; profiles come from these documents' own labels."""
    found, score = unused(docs, "found"), unused(docs, "score")
    judged = language_id.predict(docs, language_id.fit(docs), lang_out=found, score_out=score)
    return judged.where(F.col(found) != language_id.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or 400 bytes that occur elsewhere; ``n_chars`` follows the text."""
    cut = suffix_dedup.remove_from(docs, LEAST_BYTES, GRAM, WORDS)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, token_ids, n_tokens) of every document left."""
    vocabulary = byte_bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    return byte_bpe.encode(texts, vocabulary).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_bytes", repeated_bytes),
    ("without_benchmark", without_benchmark),
    ("encoded", encoded),
]

#: The byte-level stages have no SQL form; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
