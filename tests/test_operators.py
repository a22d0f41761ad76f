"""Golden cases and invariants of single operators."""

from __future__ import annotations

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import Chunking, Compaction, Retrieval
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions.vectors import cosine
from tessera.operators import history, ingest, memory, metrics, providers, retrieval, shaping, transcript, web
from tessera.plans import prompt
from tessera.sources import files


def values(spark, column, rows, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in frame.select("i", column(F.col("x"))).orderBy("i").collect()]


def turns(spark, n, first=("user", "hello there"), text="some text"):
    rows = [(1, 1, *first)] + [(1, i, "assistant" if i % 2 == 0 else "user", text) for i in range(2, n + 1)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_threshold_is_inclusive_and_drops_null_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.75, 0.6614378]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "vec_id int, embedding array<double>")
    assert sorted(r["vec_id"] for r in retrieval.vector_threshold(v, [1.0, 0.0], 0.75).collect()) == [1, 2]
    assert [r["vec_id"] for r in retrieval.vector_topk(v, [1.0, 0.0], 5).collect()] == [1, 2, 3]


def test_topk_of_many_queries_without_queries(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<double>")
    assert retrieval.vector_topk_many(v, v.where("false"), 5).count() == 0


def test_cosine_of_unequal_lengths_is_null(spark):
    assert values(spark, lambda x: cosine(x, F.array(F.lit(1.0))), [[1.0], [1.0, 2.0], [0.0]], "array<double>") == [1.0, None, None]


def test_sources_in_first_seen_order(spark):
    rows = [("a.pdf", 0.91), ("a.pdf", 0.85), ("b.md", 0.80), ("a.pdf", 0.75), ("c.txt", 0.70), (" ", 0.6), ("d", None)]
    c = spark.createDataFrame([(i, s, " " if i % 2 else None, None, k, None, None) for i, (k, s) in enumerate(rows)], "rank int, score double, bucket string, key string, source string, title string, display_name string")
    got = retrieval.sources(c, Retrieval(default_bucket="b")).orderBy("rank").collect()
    assert [(r["bucket"], r["key"], r["name"]) for r in got] == [("b", "a.pdf", "a.pdf"), ("b", "b.md", "b.md"), ("b", "c.txt", "c.txt")]


def test_budget_skips_blank_text_and_stops(spark):
    c = spark.createDataFrame([("q", 1, "abcd"), ("q", 2, " \t"), ("q", 3, "efgh"), ("q", 4, "x"), ("q", 5, None)], "request string, rank int, text string")
    got = retrieval.budget(c, "request", [F.col("rank")], Retrieval(context_chars=6)).orderBy("rank").collect()
    assert [r["snippet"] for r in got] == ["abcd", "ef"]


@pytest.mark.parametrize(("n", "first", "left"), [(23, ("user", "x"), 9), (11, ("user", "x"), 11), (20, ("system", "[Conversation summary] y"), 20), (22, ("system", "[Conversation summary] y"), 9)])
def test_compaction(spark, n, first, left):
    out = history.compact(turns(spark, n, first), Compaction()).orderBy("turn").collect()
    assert len(out) == left
    if left == 9:
        assert out[0]["role"] == "system" and out[0]["text"].startswith("[Conversation summary]")
        assert [r["turn"] for r in out[1:]] == list(range(n - 7, n + 1))


def test_compaction_by_tokens_and_with_a_rejected_summary(spark):
    t = turns(spark, 3, text="y" * 20_000)
    assert history.compaction_plan(t).first()["prefix"] == 1
    long = history.compact(t, Compaction(), summarise=lambda e: e.select("conv_id", F.repeat(F.lit("z"), 10_000).alias("summary")))
    assert long.count() == 3


def test_tail_keeps_either_end(spark):
    t = turns(spark, 6)
    assert sorted(r["turn"] for r in history.tail(t, 2).collect()) == [5, 6]
    assert sorted(r["turn"] for r in history.tail(t, 2, keep="oldest").collect()) == [1, 2]


def test_list_compaction_and_message_parsing(spark):
    frame = spark.createDataFrame([(['{"role":"user","content":"a"}', "bad", '{"role":"x","content":"b"}'],)], "m array<string>")
    parsed = history.parse_messages(F.col("m"))
    out = frame.select(history.compact_list(parsed, F.lit(2), F.struct(F.lit("system").alias("role"), F.lit("s").alias("content"))).alias("o"), parsed.alias("p")).first()
    assert [x["content"] for x in out["o"]] == ["s", "b"] and out["p"][1]["role"] is None


def test_file_names(spark):
    got = values(spark, T.sanitized_filename, [None, "...secret.txt", "a   b!!!c.txt", "../../etc/passwd", "x" * 250 + ".pdf", "\t", "C:\\d\\e.doc"])
    assert got[:4] == ["unknown_file", "secret.txt", "a_b_c.txt", "passwd"]
    assert len(got[4]) == 200 and got[4].endswith(".pdf") and got[5:] == ["unknown_file", "e.doc"]


def test_file_names_are_stable(spark):
    once = values(spark, T.sanitized_filename, ["..a..b", "__x__", "ä ö.txt", "a" * 300])
    assert values(spark, T.sanitized_filename, once) == once


def test_quality_gate(spark):
    good = " ".join(f"word{i}" for i in range(210)) + "."
    assert values(spark, T.quality_gate, [good, "", "  ", "only one", "x Access Denied " + good, "foo " * 51, None]) == ["ok", "empty", "empty", "short", "error", "repetitive", "empty"]


def test_routes(spark):
    names = ["a.md", "b.DOCX", "c.webp", "d.odt", "e.pdf", "f.exe", "noext"]
    assert values(spark, ingest.parser, names) == ["markdown", "docling", "ocr", "unstructured", "per_page", None, None]
    assert values(spark, ingest.channel, ["markdown/x.txt", "y.MD", "documents/z", "else"]) == ["markdown", "markdown", "unstructured", None]
    assert values(spark, lambda x: ingest.image_mime(x, F.lit("a.jpg")), ["image/webp", "text/html", None]) == ["image/webp", "image/jpeg", "image/jpeg"]


def test_magic_bytes(spark):
    heads = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"GIF89a", b"BM..", b"II*\x00", b"MM\x00*", b"%PDF-1.7", b"RIFF1234WEBP", b"RIFF", b"text"]
    got = values(spark, ingest.sniffed_mime, [bytearray(h) for h in heads], "binary")
    assert got == ["image/png", "image/jpeg", "image/gif", "image/bmp", "image/tiff", "image/tiff", "application/pdf", "image/webp", None, None]


def test_ingesting_twice_adds_nothing(spark):
    o = spark.createDataFrame([("k", "1"), ("k", "1"), ("l", "2")], "key string, version string")
    assert ingest.new_versions(o, o.limit(0)).count() == 2 and ingest.new_versions(o, o).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?;\n\tß😀", max_size=400))
def test_chunks_keep_the_text(text):
    parts = ingest.split_text(text, Chunking(tokens=7, min_chars=5, min_embed_chars=0))
    assert "".join("".join(parts).split()) == "".join(text.split())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=8), max_size=5))
def test_facts_find_an_array_after_prose(items):
    import json

    assert memory.facts("some prose " + json.dumps(items)) == items


def test_users(spark):
    users = ["alice", "a b", "x" * 129, None, "a@b.c:+_-"]
    assert [e is None for e in values(spark, lambda u: memory.insert_errors(u, F.lit("t")), users)] == [True, False, False, False, True]
    items = spark.createDataFrame([(1, "u"), (2, "v"), (3, None)], "id int, user_id string")
    assert sorted(r["id"] for r in memory.wipe(items, F.lit("u")).collect()) == [2, 3]


def test_providers(spark):
    assert values(spark, lambda p: memory.provider(p, ["openai", "gemini"], "gemini"), [None, " ", " OpenAI ", "else"]) == ["gemini", "gemini", "openai", None]
    assert values(spark, lambda m: providers.sees_images(F.lit("OpenAI"), m), ["gpt-4o-mini", "GPT-5", "gpt-3.5", None]) == [True, True, False, False]
    assert values(spark, lambda p: providers.context_window(p), ["anthropic", "nobody"]) == [200_000, 8_192]
    assert values(spark, lambda p: providers.is_compatible(F.lit(768), p), ["openai", "gemini"]) == [False, True]


def test_embedding_is_a_unit_vector_or_zero(spark):
    rows = providers.embed(spark.createDataFrame([("a b a",), ("",), (None,)], "text string")).collect()
    assert [round(sum(x * x for x in r["embedding"]), 5) for r in rows] == [1.0, 0.0, 0.0]


HTML = '<nav><a href="/n">nav</a></nav><p>See <a href="/job-offer/1">one</a> and <a href="https://x.example/2">two</a></p><a href="#t">top</a><a href="mailto:a@b">m</a><a href="tel:1">t</a><a href="javascript:x()">j</a><footer><a href="/f">f</a></footer>'


def test_links():
    text, links = web.annotated(HTML, "https://b.example/a/")
    assert links == ["https://b.example/job-offer/1", "https://x.example/2"] and "one [1]" in text and "two [2]" in text and "nav" not in text
    assert web.annotated(HTML, "https://b.example", "/job-offer/")[1] == ["https://b.example/job-offer/1"]
    assert web.annotated("", "https://b.example") == ("", []) and web.annotated(None, "")[1] == []


def test_noise_goes():
    assert web.text_of('<script>var t="</p>";</script><style>p{}</style><p>a<b>b</b></p><iframe>x</iframe><!-- c -->d &amp; e') == "a b d & e"


def test_search_results():
    page = '<article class="result"><h3><a href="u1">One</a></h3><p class="content">text <b>1</b></p></article><article class="result"><h3>no link</h3></article><article class="result"><h3><a href="u2">Two</a></h3></article>'
    assert web.search_results(page, 2) == [{"title": "One", "url": "u1", "content": "text 1"}, {"title": "Two", "url": "u2", "content": ""}]


def test_urls(spark):
    assert values(spark, U.registrable_domain, ["https://a.b.example.co.uk:80/x", "sub.example.com/x", "http://10.0.0.1/"]) == ["example.co.uk", "example.com", "10.0.0.1"]
    addresses = ["http://example.com", "http://127.0.0.1/", "https://192.168.1.1", "ftp://example.com", "http://localhost", "http://8.8.8.8/"]
    assert values(spark, U.is_public_address, addresses) == [True, False, False, False, False, True]
    assert values(spark, lambda p: U.inside(p, "/data"), ["/data/a", "/data/../etc", "/database/x"]) == [True, False, False]


def test_transcripts(spark):
    rows = [("c", "ann", 0.5, 1, " hi "), ("c", "bob", 0.5, 1, "yo"), ("c", "ann", 3661.0, 2, "later"), ("c", "bob", 9.0, 2, " ")]
    s = spark.createDataFrame(rows, "conversation string, track string, start double, segment_no int, text string")
    assert transcript.merge(s, "conversation").first()["transcript"] == "[00:00:00] [ann] hi\n[00:00:00] [bob] yo\n[01:01:01] [ann] later"


def test_gaps_ignore_empty_clips(spark):
    c = spark.createDataFrame([("t", 1, 1.0, 2.0), ("t", 2, 3.5, 0.0), ("t", 3, 4.0, 1.0), ("t", 4, 5.0005, 1.0)], "track string, clip_id int, offset double, duration double")
    assert [r["gap"] for r in transcript.gaps(c).orderBy("clip_id").collect()] == [1.0, 1.0, 0.0]


def test_daily_rows(spark):
    s = spark.createDataFrame([("x", ["d1", "d2"], [1.0]), ("y", [], []), ("z", None, None)], "id string, time array<string>, t array<double>")
    got = shaping.daily_rows(s, {"t": "max"}).orderBy("id", "date").collect()
    assert [(r["id"], r["date"], r["max"], r["error"]) for r in got] == [("x", "d1", 1.0, None), ("x", "d2", None, None), ("y", None, None, "no_results"), ("z", None, None, "no_results")]


def test_ocr(spark):
    frame = spark.createDataFrame([(["a", "b", "c"], [0.9, 0.8], None)], "t array<string>, s array<double>, p array<array<array<double>>>")
    lines = frame.select(shaping.zip_lines(F.col("t"), F.col("s"), F.col("p")).alias("l")).first()["l"]
    assert [(x["text"], x["confidence"], x["bounding_box"]) for x in lines] == [("a", 0.9, []), ("b", 0.8, [])]
    payload = '{"pages":[{"page_number":1,"lines":[{"text":"x"},{"text":"y"}]},{"page_number":2,"lines":[]},{"page_number":3}]}'
    assert values(spark, lambda p: shaping.ocr_text(files.ocr_payload(p)["pages"]), [payload]) == ["x\ny"]


def test_payloads(spark):
    assert values(spark, lambda p: files.elements(p)["text"], ['[{"type":"Title","text":"T"},{"type":"P","text":"x"}]']) == ["T\nx\n"]
    assert values(spark, lambda p: files.elements(p)["title"], ['[{"type":"Title","text":" "},{"type":"Title","text":"U"}]']) == ["U"]
    docs = ['{"document":{"md_content":" ","text_content":"body"}}', '{"a":[{"text":"x"},{"b":{"text":"y \\"q\\""}}]}']
    assert values(spark, files.document_text, docs) == ["body", 'x\ny "q"']


def test_markdown(spark):
    f = spark.createDataFrame([(bytearray("intro\n# My *Title*\n- **bold** [link](http://x)\n".encode()),)], "content binary")
    row = files.markdown(f).first()
    assert row["title"] == "My *Title*" and row["text"] == "intro\nMy Title\nbold link"


def test_blocklist_and_archives(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("! comment\n\n ads.example \ntracker\n")
    assert sorted(r["rule"] for r in files.blocklist(spark, str(tmp_path / "rules.txt")).collect()) == ["ads.example", "tracker"]
    for name, entry in (("good.zip", "a/b.txt"), ("evil.zip", "../b.txt")):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr(entry, "hello")
        (tmp_path / name).write_bytes(data.getvalue())
    rows = files.archive_entries(files.objects(spark, str(tmp_path), glob="*.zip"), 100).orderBy("path").collect()
    assert rows[0]["error"] and rows[1]["name"] == "a/b.txt" and bytes(rows[1]["data"]) == b"hello"


def test_audio_projects(spark, tmp_path):
    (tmp_path / "p.aup").write_text('<project><wavetrack name="ann"><waveclip offset="1.5"/></wavetrack><wavetrack><waveclip offset="0"/></wavetrack></project>')
    got = sorted((r["track"], r["offset"]) for r in files.audio_projects(spark, str(tmp_path / "p.aup")).collect())
    assert got == [("Track_2", 0.0), ("ann", 1.5)]


def test_prompt(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    rows = prompt.system_message(users, spark.createDataFrame([("a", "be brief")], "user_id string, instruction_text string"), spark.createDataFrame([("a", "- likes tea")], "user_id string, memory string"), "base").orderBy("user_id").collect()
    assert [r["message"] for r in rows] == ["base\n\nUser Instructions:\nbe brief\n\n- likes tea", "base\n\nUser Instructions:\n"]
    pages = spark.createDataFrame([("r", 2, "two"), ("r", 1, "one")], "request string, page int, text string")
    assert prompt.document_context(pages, "request", "page").first()["document"] == "\n\n<document_context>\n\none\ntwo\n</document_context>\n"


def test_metrics(spark):
    e = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", None)], "k string, v double")
    assert [(r["le"], r["n"], r["total"], r["count"]) for r in metrics.histogram(e, ["k"], "v", (1.0, 10.0)).orderBy("le").collect()] == [(1.0, 1, 6.0, 2), (10.0, 2, 6.0, 2)]


def test_arrays_among_prose_strings_and_escapes():
    cases = {
        'intro ["a"] more thinking [["nested"], ["x", "y"]]': [], 'x ] ["a"]': ["a"], '["open", ["b"': [], 'say "[" and ["c]"]': ["c]"], 'a \\" quote ["d"]': ["d"],
        "```json\n[1, null, true]\n```": ["1", "true"], "": [], "[]": [],
    }
    assert {t: memory.facts(t) for t in cases} == cases


def test_cache_keys_and_polygons(spark):
    frame = spark.createDataFrame([(1, " \uff37arsaw\u00a0"), (2, None), (3, "\u2460\ufb01")], "i int, t string")
    assert [r["cache_key"] for r in shaping.cache_key(frame, "t").orderBy("i").collect()] == ["warsaw", None, "1fi"]
    raw = ["[[1,2],[3,4.5]]", "[[1,2,3]]", "[[1,null]]", "x", None]
    assert values(spark, shaping.polygons, raw) == [[[1.0, 2.0], [3.0, 4.5]], [], [], [], []]


def test_cascade_reads_only_what_is_left(spark):
    good = "This is a page of text with more than ten different words in it, all of them plain."
    rows = [(1, f"<p>{good}</p>", 0.0), (2, "<p>short", 0.0), (3, "<p>short", 100.0), (4, "<title>Log in</title>", 0.0)]
    pages = spark.createDataFrame(rows, "i int, html string, spent double").withColumn("url", F.lit("https://a.example/x"))
    second = lambda html: F.when(html.isNotNull(), F.lit(good))
    got = web.read(pages, [("first", web.plain_text(F.col("html"))), ("second", second)], spent=F.col("spent")).orderBy("i").collect()
    assert [(r["mode"], r["reason"]) for r in got] == [("first", None), ("second", None), (None, "budget_exhausted"), (None, "human_intervention")]


def test_links_cascade(spark):
    words = "more words of plain text so that the gate lets this page through at last"
    pages = spark.createDataFrame([(1, f'<p>{words} <a href="/a">here</a></p>'), (2, f"<p>{words}</p>"), (3, '<a href="/b">x</a>')], "i int, html string").withColumn("url", F.lit("https://a.example/x"))
    got = web.read_links(pages).orderBy("i").collect()
    assert [r["mode"] for r in got] == ["parser", "patterns", None] and got[0]["annotated"].endswith("here [1]") and got[0]["links"] == {1: "https://a.example/a"} and got[2]["links"] is None


def test_document_walk(spark):
    docs = [
        '{"b": {"text": "2"}, "text": "1", "a": [{"text": "3"}, [{"x": {"text": "4"}}]]}', '{"document": {"md_content": 5, "text_content": " ", "html_content": "<p>"}, "text": "no"}', '{"text": {"text": "in"}, "t": "{\\"text\\": \\"no\\"}"}',
        '{"text": "a", "x": {"text": "b"}, "text": "c"}', "no json", "", None, "[" * 100_000, '{"text": ""}', '"text"',
    ]
    assert values(spark, files.document_text, docs) == ["1\n2\n3\n4", "<p>", "in", "c\nb", "", "", None, "", "", ""]


def test_many_patterns(spark, monkeypatch):
    rows = spark.createDataFrame([("abc",), ("x1",), (None,)], "v string")
    patterns = spark.createDataFrame([(f"{c}*",) for c in "abxyz"] + [(f"no{i}",) for i in range(2000)], "pattern string")
    many = sorted(tuple(r) for r in providers.matches_glob(rows, patterns, F.col("v")).collect())
    assert many == [("abc", "a*"), ("x1", "x*")] == sorted(tuple(r) for r in providers.matches_glob(rows, patterns.limit(5), F.col("v")).collect())
