"""The plan behind an answered prompt: instructions, memory, retrieval and history become one context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Retrieval
from tessera.functions import text as T
from tessera.operators import retrieval

BASE_PROMPT = "You are a helpful assistant."


def system_message(users: DataFrame, instructions: DataFrame, memory: DataFrame | None = None, base: str = BASE_PROMPT) -> DataFrame:
    """user_id, message: the base prompt, the user's instructions (empty if there are none) and the lines of memory.

    users: user_id; instructions: user_id, instruction_text; memory: user_id, memory (as operators.memory.lines gives).
    """
    rows = users.join(instructions.select("user_id", "instruction_text"), "user_id", "left")
    message = F.concat(F.lit(base + "\n\nUser Instructions:\n"), F.coalesce("instruction_text", F.lit("")))
    if memory is not None:
        rows = rows.join(memory, "user_id", "left")
        message = F.concat(message, F.when(~T.is_blank(F.col("memory")), F.concat(F.lit("\n\n"), F.col("memory"))).otherwise(""))
    return rows.select("user_id", message.alias("message"))


def document_context(pages: DataFrame, key: str, order: str) -> DataFrame:
    """key, document: the texts in order, each after a line feed, in their tags."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce("text", F.lit("")).alias("text"))))
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("\n"), r["text"])), "")
    return pages.groupBy(key).agg(F.concat(F.lit("\n\n<document_context>\n"), body, F.lit("\n</document_context>\n")).alias("document"))


def contexts(candidates: DataFrame, request: str, config: Retrieval = Retrieval()) -> DataFrame:
    """request, context: candidates (request, rank, score, text) at the threshold or above, within the budget, as a block."""
    kept = candidates.where(F.col("score") >= config.threshold)
    kept = kept.where(F.col("rank") <= config.top_k)
    return retrieval.context_block(retrieval.budget(kept, request, [F.col("rank")], config), request, "rank")


def user_message(prompts: DataFrame, documents: DataFrame | None, blocks: DataFrame, request: str) -> DataFrame:
    """request, message: the prompt, the document context and the retrieved context, where there are any."""
    rows = prompts.join(blocks, request, "left")
    message = F.col("prompt")
    if documents is not None:
        rows = rows.join(documents, request, "left")
        message = F.concat(message, F.coalesce("document", F.lit("")))
    return rows.select(request, F.concat(message, F.coalesce(F.concat(F.lit("\n\n"), F.col("context")), F.lit(""))).alias("message"))
