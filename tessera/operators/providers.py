"""Providers: what a request resolves to, and deterministic stand-ins for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.expr import let

#: Context windows in tokens, and the models that see images.
CONTEXT_WINDOWS = {"openai": 128_000, "anthropic": 200_000, "gemini": 1_000_000, "minimax": 200_000, "lmstudio": 8_192}
VISION_GLOBS = {"lmstudio": ("*-vl-*", "qwen*-vl*", "*llava*"), "openai": ("gpt-4o*", "gpt-5*", "gpt-4-turbo*", "gpt-4-vision*"), "anthropic": ("claude-*",), "gemini": ("gemini-*",), "minimax": ()}
#: Embedding sizes that a chat provider cannot go with.
INCOMPATIBLE = ((768, "openai"), (1536, "lmstudio"))


def with_defaults(requests: DataFrame, providers: DataFrame, default: str, name: str = "provider") -> DataFrame:
    """`requests` with the columns of providers(name, ...) of the one asked for, or of the default if that is blank; an
    unknown one gives an error."""
    asked = requests.withColumn("_name", F.coalesce(F.lower(T.nonblank(T.strip(F.col(name)))), F.lit(default)))
    known = providers.withColumnRenamed("name", "_name").withColumn("_known", F.lit(True))
    out = asked.join(known, "_name", "left")
    return out.withColumn("error", F.when(F.col("_known").isNull(), F.concat(F.lit("unknown provider: "), F.col("_name")))).withColumnRenamed("_name", "resolved").drop("_known")


def context_window(provider: Column) -> Column:
    out = F.lit(8_192)
    for name, tokens in CONTEXT_WINDOWS.items():
        out = F.when(F.lower(provider) == name, tokens).otherwise(out)
    return out


#: Patterns that are broadcast row by row; more of them are so many to a row, so that rows aren't paired with each.
PATTERNS = 1_000


def matches_glob(rows: DataFrame, patterns: DataFrame, value: Column, pattern: str = "pattern") -> DataFrame:
    """`rows` times each pattern that `value` matches. patterns: a table of configuration, which is counted and broadcast."""
    n = patterns.count()
    if n <= PATTERNS:
        return rows.join(F.broadcast(patterns), F.regexp_like(value, T.glob(F.col(pattern))))
    block = patterns.select(F.pmod(F.xxhash64(pattern), F.lit(-(-n // PATTERNS))).alias("_block"), F.struct(*patterns.columns).alias("_p")).groupBy("_block").agg(F.collect_list("_p").alias("_all"))
    asked = rows.withColumn("_value", value).join(F.broadcast(block.drop("_block")))
    hits = asked.withColumn("_hit", F.explode(F.filter("_all", lambda p: F.regexp_like(F.col("_value"), T.glob(p[pattern])))))
    return hits.select(*[F.col(c) for c in rows.columns], *[F.col("_hit")[c].alias(c) for c in patterns.columns])


def sees_images(provider: Column, model: Column) -> Column:
    out = F.lit(False)
    for name, globs in VISION_GLOBS.items():
        for g in globs:
            out = out | ((F.lower(provider) == name) & F.regexp_like(model, T.glob(F.lit(g))))
    return F.coalesce(out, F.lit(False))


def is_compatible(size: Column, chat_provider: Column) -> Column:
    bad = F.lit(False)
    for n, p in INCOMPATIBLE:
        bad = bad | ((size == n) & (F.lower(chat_provider) == p))
    return ~bad


def embed(rows: DataFrame, text: str = "text", into: str = "embedding", size: int = 64) -> DataFrame:
    """A deterministic embedding: words hashed into `size` counts, of length one; zeros for a text without words."""
    slots = F.transform(T.words(F.lower(F.col(text))), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    counts = let(slots, lambda found: F.transform(places, lambda i: F.size(F.filter(found, lambda s: s == i)).cast("double")))

    def unit(n: Column) -> Column:
        length = F.sqrt(F.aggregate(n, F.lit(0.0), lambda s, x: s + x * x))
        return let(length, lambda d: F.transform(n, lambda x: F.when(d > 0, x / d).otherwise(0.0).cast("float")))

    return rows.withColumn(into, let(counts, unit))


def collection(size: Column, prefix: str = "vectors", separator: str = "-") -> Column:
    """The name of the collection for embeddings of a size: providers of one size share it."""
    return F.concat(F.lit(prefix + separator), size.cast("string"))


def missing_collections(providers: DataFrame, existing: DataFrame, prefix: str = "vectors") -> DataFrame:
    """name, size, metric: the collections that providers(name, size) ask for and existing(name) lacks, each once."""
    wanted = providers.where(F.col("size") > 0).select(collection(F.col("size"), prefix).alias("name"), "size", F.lit("cosine").alias("metric")).distinct()
    return wanted.join(existing.select("name"), "name", "left_anti")


def collections_by_provider(providers: DataFrame, prefix: str = "vectors") -> DataFrame:
    """One row with stores: the map of a provider's name to its collection."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("name").alias("key"), collection(F.col("size"), prefix).alias("value"))))
    return providers.agg(F.map_from_entries(entries).alias("stores"))
