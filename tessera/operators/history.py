"""Conversations: windows of turns, token estimates, and compaction into a summary.

A conversation is keyed by one column and ordered by another, with ties broken by the row's text and role where the
order column repeats. Columns: key, order, role, text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import Compaction
from tessera.functions import text as T


def tail(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn", keep: str = "latest") -> DataFrame:
    """The last n turns of each conversation, or the first n with keep="oldest". A rank below n prunes before the shuffle."""
    by = F.col(order).desc() if keep == "latest" else F.col(order).asc()
    ranked = turns.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(by, "role", "text")))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def token_estimates(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns, tokens: each text's length over four, rounded down, summed; null texts add nothing."""
    return turns.groupBy(key).agg(F.count("*").alias("turns"), F.coalesce(F.sum(T.token_estimate(F.col("text"))), F.lit(0)).alias("tokens"))


def compaction_plan(turns: DataFrame, config: Compaction = Compaction(), key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, turns, tokens, prefix: how many of the oldest turns a summary replaces; 0 for none.

    Compaction is due at `turn_trigger` turns or at `token_share` of the context window. A conversation that starts with a
    summary waits until it has as many turns besides. `keep` turns stay.
    """
    first = F.min_by(F.struct("role", "text"), F.col(order))
    sums = turns.groupBy(key).agg(F.count("*").alias("turns"), F.coalesce(F.sum(T.token_estimate(F.col("text"))), F.lit(0)).alias("tokens"), first.alias("_first"))
    return sums.select(key, "turns", "tokens", _prefix(F.col("turns"), F.col("tokens"), F.col("_first"), config).alias("prefix"))


def _prefix(n: Column, tokens: Column, first: Column, config: Compaction) -> Column:
    due = (n >= config.turn_trigger) | (tokens >= config.token_share * config.context_tokens)
    summarised = F.coalesce(T.is_summary(first["role"], first["text"], config), F.lit(False)) & (n - 1 < config.turn_trigger)
    prefix = F.greatest(F.lit(1), n - config.keep)
    prefix = F.when(prefix >= n, n - 1).otherwise(prefix)
    return F.when(due & ~summarised & (prefix >= 1), prefix).otherwise(0).cast("bigint")


def stub_summary(texts: int | Column, config: Compaction = Compaction()) -> Column:
    """The deterministic default: the marker and the number of turns that it stands for."""
    return F.concat(F.lit(config.marker + " "), F.lit(texts).cast("string") if isinstance(texts, int) else texts.cast("string"), F.lit(" turns"))


def compact(turns: DataFrame, config: Compaction = Compaction(), key: str = "conv_id", order: str = "turn", summarise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`turns` (key, order, role, text) with each due prefix replaced by one system turn, placed at the prefix's last
    order, just before the oldest turn that stays. One shuffle by the key serves the plan and the replacement.

    summarise: from (key, prefix, end) to (key, summary); blank and over-long summaries leave the conversation as it is.
    """
    whole = Window.partitionBy(key)
    ordered = whole.orderBy(order, "role", "text")
    rows = turns.select(key, order, "role", "text").withColumns({
        "_rank": F.row_number().over(ordered), "_first": F.first(F.struct("role", "text")).over(ordered),
        "_turns": F.count("*").over(whole), "_tokens": F.coalesce(F.sum(T.token_estimate(F.col("text"))).over(whole), F.lit(0)),
    })
    rows = rows.withColumn("prefix", _prefix(F.col("_turns"), F.col("_tokens"), F.col("_first"), config))
    if summarise:
        ends = rows.where(F.col("_rank") == F.col("prefix")).select(key, "prefix", F.col(order).alias("end"))
        rows = rows.join(summarise(ends).select(key, "summary"), key, "left")
    else:
        rows = rows.withColumn("summary", stub_summary(F.col("prefix"), config))
    rows = rows.withColumn("summary", F.when(F.col("prefix") > 0, T.valid_summary(F.col("summary"), config)))
    replaced = F.col("summary").isNotNull() & (F.col("_rank") == F.col("prefix"))
    kept = rows.where(F.col("summary").isNull() | (F.col("_rank") >= F.col("prefix")))
    return kept.select(key, order, F.when(replaced, "system").otherwise(F.col("role")).alias("role"), F.when(replaced, F.col("summary")).otherwise(F.col("text")).alias("text"))


def compact_list(messages: Column, prefix: Column, summary: Column) -> Column:
    """The same on an array of messages: the first `prefix` elements become one."""
    return F.concat(F.array(summary), F.slice(messages, prefix + 1, F.greatest(F.size(messages) - prefix, F.lit(0))))


def render(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, rendered: `ROLE: text` and an empty line for each turn, in order."""
    line = F.concat(F.upper("role"), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line"))))
    return turns.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered"))


def last_nonblank(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, text: of the last turn that has one."""
    return turns.where(~T.is_blank(F.col("text"))).groupBy(key).agg(F.max_by("text", order).alias("text"))


def role_sequence(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, roles: the known roles in order, joined by commas."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), T.known_role(F.col("role")).alias("role"))))
    return turns.groupBy(key).agg(F.array_join(F.transform(pairs, lambda x: x["role"]), ",").alias("roles"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last written by `order`, of the new table where both are equal."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("_new").desc())
    return both.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank", "_new")


def parse_messages(messages: Column) -> Column:
    """array<struct<role, content>> of an array of JSON strings; what doesn't parse has nulls."""
    return F.transform(messages, lambda m: F.from_json(m, "role string, content string"))


def cache_size(size: int, compacts: bool, config: Compaction = Compaction()) -> int:
    """How many turns a cache holds: with compaction at least what that leaves, the turns kept and their summary."""
    return max(size, config.keep + 1) if compacts else size


def compaction_target(requests: DataFrame, models: DataFrame, default: str) -> DataFrame:
    """`requests` (provider, override_provider, override_model) with target_provider and target_model: the override, else the request's provider, else the
    default one; the override's model, else the provider's own by models(name, model)."""
    provider = T.first_nonblank(F.lower("override_provider"), F.lower("provider"), F.lit(default))
    out = requests.withColumn("target_provider", provider).join(models.select(F.col("name").alias("target_provider"), F.col("model").alias("_model")), "target_provider", "left")
    return out.withColumn("target_model", T.first_nonblank(F.col("override_model"), F.col("_model"))).drop("_model")


#: What a cache holds for a user who is known to have no instructions, so that the next look-up needn't ask the store.
NO_INSTRUCTIONS = ""


def cached_instructions(users: DataFrame, instructions: DataFrame) -> DataFrame:
    """user_id, cached, instruction_text: the cache's value, the marker for users without instructions, and what a reader gets, null for the marker."""
    rows = users.select("user_id").distinct().join(instructions.select("user_id", "instruction_text"), "user_id", "left")
    cached = F.coalesce(T.nonblank(F.col("instruction_text")), F.lit(NO_INSTRUCTIONS))
    return rows.select("user_id", cached.alias("cached"), F.nullif(cached, F.lit(NO_INSTRUCTIONS)).alias("instruction_text"))
