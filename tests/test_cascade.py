"""The cascade of tiers against a loop that walks each page through them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import web
from tessera.operators.cascade import Tier, cascade
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def walk(page, names, limit=60.0):
    """(mode, reason, trace) of a page: {texts, ok, challenged, person, seconds} by tier, login, heavy."""
    trace, spent = [], 0.0

    def ask(i):
        nonlocal spent
        spent += page["seconds"][i]
        outcome = "challenge" if page["challenged"][i] else "person" if page["person"][i] else "success" if page["ok"][i] else "refused"
        trace.append(f"{names[i]}:{outcome}")
        return outcome

    end = len(names) - 1
    order = [end] if page["login"] else range(3, end + 1) if page["heavy"] else range(end + 1)
    for i in order:
        if i != end and spent > limit:
            trace.append(f"{names[i]}:budget")
            return None, "budget_exhausted", trace
        at, outcome = i, ask(i)
        if outcome == "challenge":
            at, outcome = end, ask(end)
        if outcome == "success":
            return names[at], None, trace
        if outcome == "person":
            return None, "human_intervention", trace
    return None, "all_tiers_failed", trace


def test_trace_equals_a_walk(spark):
    tiers = catalogue.cascade_tiers()
    pages = catalogue._pages(spark, SF)
    base = pages.withColumns({"login": U.is_login_redirect(F.col("url")), "heavy": F.col("page_id") % 9 == 1})
    for i, t in enumerate(tiers):
        base = base.withColumn(f"t{i}", t.read(F.col("html")))
        base = base.withColumns({f"ok{i}": T.quality_gate(F.col(f"t{i}")) == "ok", f"c{i}": t.is_(t.challenged), f"p{i}": t.is_(t.person), f"s{i}": t.took})
    facts = base.drop("html").collect()
    n = range(len(tiers))
    seen = set()
    got = {r["page_id"]: r for r in catalogue.cascade_trace(spark, SF).collect()}
    for r in facts:
        page = {"login": r["login"], "heavy": r["heavy"], "ok": [r[f"ok{i}"] for i in n], "challenged": [r[f"c{i}"] for i in n], "person": [r[f"p{i}"] for i in n], "seconds": [r[f"s{i}"] for i in n]}
        mode, reason, trace = walk(page, [t.name for t in tiers])
        mine = got[r["page_id"]]
        assert (mine["mode"], mine["reason"], mine["trace"]) == (mode, reason, " ".join(trace))
        assert (mine["n_chars"] is None) == (mode is None)
        seen |= {x.partition(":")[2] for x in trace} | {reason}
    assert seen >= {"success", "refused", "challenge", "person", "budget", "budget_exhausted", "human_intervention", "all_tiers_failed"}


def test_a_parser_sees_open_pages_only(spark):
    """Each tier is given null for pages that are done; links are made where they are asked for."""
    good = "This is a page of text with more than ten different words in it, all of them plain."
    pages = spark.createDataFrame([(i, "https://a.example/", f"<p>{good}" if i % 2 else "<p>short") for i in range(10)], "i int, url string, html string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(html):
        if html is not None:
            calls.add(1)
            return good

    got = cascade(pages, [Tier("a", web.plain_text), Tier("b", counted.asNondeterministic())]).collect()
    assert {r["i"]: r["mode"] for r in got} == {i: "a" if i % 2 else "b" for i in range(10)} and calls.value == 5
    none = spark.createDataFrame([], "i int, url string, html string")
    assert cascade(none, [Tier("a", web.plain_text)]).count() == 0
    nulls = spark.createDataFrame([(1, None, None)], "i int, url string, html string")
    assert [(r["mode"], r["reason"]) for r in cascade(nulls, [Tier("a", web.plain_text)]).collect()] == [(None, "all_tiers_failed")]
