"""A training corpus from raw documents: toxic ones go, one of each group of near duplicates stays, documents that hold
benchmark items go, personal values become pseudonyms, and the rest is encoded.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; all but the
last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, pii, simhash, toxicity
from tessera.llm.common import discard, stored, table, written
from tessera.llm.queries import DEMO_KEY, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.5. The classifier learns from those of `docs` that have labels."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near duplicates: five-word shingles, a similarity of 0.8."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the shingles of any benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal values replaced; n_chars follows the text."""
    out = pii.pseudonymize(docs, DEMO_KEY)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, ids_sha256, decoded_sha256 of every document."""
    out = bpe.digests(docs.select("doc_id", "text", "lang", "source"), tokenizer_path())
    return out.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pseudonyms", pseudonymize),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on `documents`; each stage's is written as Parquet and read again, after which what it has written besides goes."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        discard(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
