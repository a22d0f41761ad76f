"""Every query of the catalogue against its twin on the smallest tables, and the queries without one against what they promise."""

from __future__ import annotations

import json

import pytest

from tessera.plans import catalogue
from tests.conftest import duck, normal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_its_twin(spark, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), duck(catalogue.ORACLES[name], SF)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


def test_entry(spark):
    rows = catalogue.entry(spark, SF).collect()
    assert rows and all(r["context"].startswith("<rag_context>") and r["context"].endswith("</rag_context>") for r in rows)


def test_chunks_lose_no_text(spark):
    docs = catalogue.table(spark, SF, "documents").select("doc_id", "text")
    parts = catalogue.ingest_chunks(spark, SF).orderBy("doc_id", "chunk_no").collect()
    for d in docs.collect():
        got = "".join("".join(p["chunk"].split()) for p in parts if p["doc_id"] == d["doc_id"])
        want = "".join(d["text"].split())
        assert got == want or want.endswith(want[len(got) :]) and len(want) - len(got) <= 5


def test_cascade_has_a_mode_or_a_reason(spark):
    rows = catalogue.read_cascade(spark, SF).collect()
    assert all((r["mode"] is None) != (r["reason"] is None) for r in rows)
    by = {r["page_id"]: r for r in rows}
    assert by[-1]["reason"] == by[-2]["reason"] == by[-4]["reason"] == "human_intervention"
    assert by[-5]["reason"] == by[-6]["reason"] == "all_tiers_failed"
    assert all(by[i]["mode"] == "patterns" for i in by if i >= 0 and by[i]["content"])


def test_facts(spark):
    got = {r["id"]: json.loads(r["facts"]) for r in catalogue.extract_json_facts(spark, SF).collect()}
    assert got == {0: ["a", "b"], 1: ["fact-A", "fact-B"], 2: ["User likes [brackets]"], 3: [], 4: [], 5: [], 6: ['User said "hello" loudly']}


def test_cache_hits_follow_a_sequential_cache(spark):
    events = catalogue.table(spark, SF, "events").toPandas().sort_values(["user_id", "ts", "event_id"])
    until, want = {}, {}
    for user, ts, event in zip(events["user_id"], events["ts"], events["event_id"], strict=True):
        want[event] = user in until and ts < until[user]
        if not want[event]:
            until[user] = ts + __import__("pandas").Timedelta(days=1)
    assert {r["event_id"]: r["hit"] for r in catalogue.ttl_cache_hits(spark, SF).collect()} == want


def test_stream_equals_batch_and_ingests_once(spark):
    streamed = catalogue.stream_ingest(spark, SF).groupBy("source").count().collect()
    chunks = catalogue.ingest_chunks(spark, SF).groupBy("doc_id").count().collect()
    assert sorted(r["count"] for r in streamed) == sorted(r["count"] for r in chunks)
