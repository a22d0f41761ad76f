"""Per-user semantic memory: insert, search, delete, wipe, and facts from model responses."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Memory
from tessera.functions import text as T
from tessera.operators import retrieval
from tessera.session import ship


def provider(name: Column, known: list[str], default: str) -> Column:
    """The provider's name, the default for a blank one, null (an error, never a fallback) for an unknown one."""
    p = F.coalesce(F.lower(T.nonblank(T.strip(name))), F.lit(default))
    return F.when(p.isin(*known), p)


def insert_errors(user: Column, text: Column, config: Memory = Memory()) -> Column:
    """Why a memory can't be inserted; null if it can."""
    return (
        F.when(user.isNull() | ~user.rlike(config.user_pattern), "invalid user_id").when(T.is_blank(text), "text must not be blank")
        .when(F.length(text) > config.max_text, f"text must be at most {config.max_text} characters")
    )


def insert(items: DataFrame, new: DataFrame, default_user: str = "default", config: Memory = Memory()) -> DataFrame:
    """`items` and the valid rows of new(id, user_id, text), whose user falls back to the default one."""
    rows = new.withColumn("user_id", F.coalesce(T.nonblank(F.col("user_id")), F.lit(default_user)))
    return items.unionByName(rows.where(insert_errors(F.col("user_id"), F.col("text"), config).isNull()).select(*items.columns))


def shared_items(rows: DataFrame) -> DataFrame:
    """Rows of the memory store under the names that clients use: its `memory` is their text; a missing score is 0."""
    return rows.select("id", "user_id", F.col("memory").alias("text"), F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))


def delete(items: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return items.join(ids.select(key), key, "left_anti")


def wipe(items: DataFrame, user: Column, by: str = "user_id") -> DataFrame:
    """All but one user's items; items without a user stay."""
    return items.where(~F.col(by).eqNullSafe(user))


def search(items: DataFrame, query: list[float], user: Column, by: str = "user_id", k: int = Memory.top_k, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k items of one user most like the query: the filter comes before the scores."""
    return retrieval.vector_topk(items.where(F.col(by) == user), query, min(k, Memory.max_k), None, vec_id, embedding)


def lines(items: DataFrame, by: str = "user_id", rank: str = "rank") -> DataFrame:
    """by, memory: `- text` for each item with text, by rank."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank), F.concat(F.lit("- "), F.col("text")).alias("line"))))
    return items.where(~T.is_blank(F.col("text"))).groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("memory"))


def strings(text: str) -> list[str] | None:
    """The array of strings that a text is, scalars as text; None for anything else, arrays or objects within too."""
    try:
        value = json.loads(text)
    except ValueError:
        return None
    if not isinstance(value, list) or any(isinstance(x, (list, dict)) for x in value):
        return None
    return [x if isinstance(x, str) else json.dumps(x) for x in value if x is not None]


#: A pair of a backslash and what it hides, a quoted string (to the end of the text if nothing closes it), or a bracket.
SIGNS = re.compile(r'\\.|"(?:\\.|[^"\\])*(?:"|\Z)|[\[\]]', re.S)


def last_array(text: str) -> str | None:
    """The last bracketed range at the top level. Brackets in strings don't count; a quotation mark in prose opens a
    string too, and a backslash hides what follows wherever it stands."""
    opened: list[int] = []
    whole: list[tuple[int, int]] = []
    for sign in SIGNS.finditer(text):
        if sign[0] == "[":
            opened.append(sign.start())
        elif sign[0] == "]" and opened:
            span = opened.pop(), sign.end()
            if not opened:
                whole.append(span)
    return text[slice(*whole[-1])] if whole else None


#: A fence with its language before a text, and one after it.
FENCES = re.compile(r"\A```json\s*|\s*```\Z")


def facts(response: str | None) -> list[str]:
    """The facts in a model's response: the whole text as an array of strings, fences taken off, else its last array."""
    if not response or not response.strip():
        return []
    text = FENCES.sub("", response.strip())
    inner = None if (out := strings(text)) is not None else last_array(text)
    return (strings(inner) if inner else out) or []


def extract_facts(responses: DataFrame, text: str = "response") -> DataFrame:
    """`responses` with facts, an array of strings."""

    ship(responses.sparkSession)

    @F.pandas_udf("array<string>")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([facts(x) for x in s], dtype=object)

    return responses.withColumn("facts", each.asNondeterministic()(F.col(text)))


def fact_tally(inserts: DataFrame, by: str, ok: Column) -> DataFrame:
    return inserts.groupBy(by).agg(F.count(F.when(ok, 1)).alias("ok"), F.count(F.when(~ok, 1)).alias("failed"))
