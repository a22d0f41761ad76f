"""A cascade of page readers with escalation, as a state machine in columns.

Each page is asked of one tier after the other until one gives a text that passes the quality gate. Heavy pages begin at a later tier. A tier that
meets a challenge hands the page to the last tier, which stands for a person's browser; if that fails too, the page goes on to the next tier. A login
redirect goes to the last tier at once. A page that has spent its time is given up before the next tier is asked; before the last one, time doesn't count.

A tier is asked only of the pages that are still open: it gets null for the others, so a parser in Python does nothing there, and what it makes besides the text,
such as links, is made for these pages only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U

#: The first tier of heavy pages, from 0.
HEAVY_FROM = 3


@dataclass(frozen=True)
class Tier:
    """read: from the page (null: not asked) to its text, or to a struct with a field `text`; the same type in all tiers. challenged, person: whether the tier
    meets a challenge there, or finds that a person must act; seconds: what asking it takes."""

    name: str
    read: Callable[[Column], Column]
    challenged: Column | None = None
    person: Column | None = None
    seconds: Column | float = 0.0

    def is_(self, what: Column | None) -> Column:
        return F.lit(False) if what is None else F.coalesce(what, F.lit(False))

    @property
    def took(self) -> Column:
        return F.coalesce(self.seconds, F.lit(0.0)) if isinstance(self.seconds, Column) else F.lit(float(self.seconds))


def cascade(pages: DataFrame, tiers: list[Tier], url: str = "url", html: str = "html", heavy: Column | None = None, spent: Column | None = None, seconds: float = 90.0, struct: bool = False) -> DataFrame:
    """`pages` with made (what the tier that was right made), mode (its name), reason (without one: human_intervention, budget_exhausted or
    all_tiers_failed) and trace: `tier:outcome` of each tier that was asked, in order; success, refused, challenge, person or budget.

    spent: seconds that a page has used beforehand. struct: whether tiers make structs with a text.
    """
    login = F.coalesce(U.is_login_redirect(F.col(url)), F.lit(False))
    start = {"_open": F.lit(True), "_login": login, "_heavy": F.coalesce(heavy, F.lit(False)) if heavy is not None else F.lit(False), "_spent": F.coalesce(spent.cast("double"), F.lit(0.0)) if spent is not None else F.lit(0.0)}
    out = pages.withColumns(start | {"trace": F.array().cast("array<string>"), "mode": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    text = lambda made: made["text"] if struct else made
    last, made = tiers[-1], None

    def ask(df: DataFrame, tier: Tier, when: Column, name: str) -> DataFrame:
        """_outcome of the pages `when`, and what was made of those that were read, in the column `name`."""
        outcome = F.when(tier.is_(tier.challenged), "challenge").when(tier.is_(tier.person), "person")
        df = df.withColumn("_first", F.when(when, F.coalesce(outcome, F.lit("ask"))))
        df = df.withColumn(name, tier.read(F.when(F.col("_first") == "ask", F.col(html))))
        good = T.quality_gate(text(F.col(name))) == "ok"
        df = df.withColumn("_outcome", F.when(F.col("_first") == "ask", F.when(good, "success").otherwise("refused")).otherwise(F.col("_first")))
        note = F.concat(F.lit(f"{tier.name}:"), F.col("_outcome"))
        done = F.coalesce(F.col("_outcome").isin("success", "person"), F.lit(False))
        return df.withColumns({
            "trace": F.when(when, F.array_append("trace", note)).otherwise(F.col("trace")), "_spent": F.col("_spent") + F.when(when, tier.took).otherwise(F.lit(0.0)),
            "mode": F.when(F.col("_outcome") == "success", tier.name).otherwise(F.col("mode")), "reason": F.when(F.col("_outcome") == "person", "human_intervention").otherwise(F.col("reason")), "_open": F.col("_open") & ~done,
            name: F.when(F.col("_outcome") == "success", F.col(name)),
        })

    kept = []
    for i, tier in enumerate(tiers):
        final = tier is last
        turn = F.col("_open") & (F.lit(final) | (~F.col("_login") & (F.lit(i >= HEAVY_FROM) | ~F.col("_heavy"))))
        if not final:
            over = turn & (F.col("_spent") > seconds)
            out = out.withColumn("_over", over)
            out = out.withColumns({"trace": F.when(F.col("_over"), F.array_append("trace", F.lit(f"{tier.name}:budget"))).otherwise(F.col("trace")), "reason": F.when(F.col("_over"), "budget_exhausted").otherwise(F.col("reason")), "_open": F.col("_open") & ~F.col("_over")})
            turn = F.col("_open") & ~F.col("_login") & (F.lit(i >= HEAVY_FROM) | ~F.col("_heavy"))
        out = out.withColumn("_turn", turn)
        out = ask(out, tier, F.col("_turn"), f"_made_{i}")
        kept.append(f"_made_{i}")
        # a challenge goes to the last tier, which isn't sent there again
        out = out.withColumn("_up", F.coalesce(F.col("_turn") & (F.col("_outcome") == "challenge"), F.lit(False)))
        if tier.challenged is not None:
            out = ask(out, last, F.col("_up"), f"_up_{i}")
            kept.append(f"_up_{i}")
    made = F.coalesce(*kept)
    reason = F.when(F.col("mode").isNull(), F.coalesce("reason", F.lit("all_tiers_failed")))
    return out.withColumns({"made": made, "reason": reason}).select(*pages.columns, "made", "mode", "reason", "trace")
