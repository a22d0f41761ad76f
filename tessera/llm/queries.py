"""The queries of this subpackage and, where SQL can express them, their DuckDB twins.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audit, bpe, chat, decontam, html, lm, pii, quality, repair, sharding, simhash, topk, toxicity
from tessera.llm.common import held_out, table

#: The key of the pseudonyms in the queries. A deployment passes its own secret.
DEMO_KEY = "tessera-demo-key"


def tokenizer_path() -> str:
    """The vocabulary file of the BPE queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted: quality of every document."""
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: test items that a document holds at 0.8 or more."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with personal values replaced by pseudonyms, n_replaced."""
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY, count="n_replaced")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score: how much more each document is like the benchmark than
    like all documents."""
    docs = table(spark, sf_dir, "documents")
    return lm.differences(docs.select("doc_id", "text"), docs, table(spark, sf_dir, "benchmark")).drop("text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id over links of two differing bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each document in 16 shards of near-equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 best for every vector whose id is divisible by 50."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page."""
    out = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted: toxicity of every document."""
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters keeps and removes at each step of all 120 orders, by language."""
    return audit.audit(audit.histograms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, faults, cost, audit and digest of every conversation, damaged by rule and mended at the least cost."""
    return repair.digests(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, digests and lengths of every conversation, read back from its format; with one, -7, of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(tricky))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_bpe": op4_bpe,
    "op5_cross_entropy": op5_cross_entropy,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_topk": op8_topk,
    "op9_main_text": op9_main_text,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_structure_repair": op12_structure_repair,
    "op13_chat_format": op13_chat_format,
}

ORACLES = {"op2_decontamination": decontam.LEAKS_SQL, "op8_topk": topk.TOPK_SQL, "op11_filter_audit": audit.AUDIT_SQL, "op12_structure_repair": repair.DIGESTS_SQL, "op13_chat_format": chat.DIGESTS_SQL}
