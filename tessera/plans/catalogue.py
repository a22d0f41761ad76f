"""The catalogue of queries over the test tables, each with its DuckDB twin where SQL can express it.

Parameters are scaled to the tables: conversations have up to eight turns, vectors 64 components.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import Compaction, Retrieval
from tessera.functions import registry, tools
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import filters, history, ingest, memory, metrics, nearest, providers, retrieval, shaping, transcript, web
from tessera.operators.cascade import Tier, cascade
from tessera.plans import prompt
from tessera.session import shared_dir, ship, table
from tessera.sources import files, projects
from tessera.sources.vectors import VectorStore
from tessera.streaming import cache, polling, windows
from tessera.streaming import ingest as streamed

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    """One query vector, by a filter that reaches the scan."""
    return table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


COSINE_SQL = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"


@query(f"WITH q AS (SELECT * FROM embeddings WHERE vec_id = 0) SELECT e.vec_id, {COSINE_SQL} AS score FROM embeddings e, q WHERE e.vec_id <> 0 AND {COSINE_SQL} >= 0.2 ORDER BY score DESC, e.vec_id LIMIT 5")
def vector_topk(spark, sf):
    return retrieval.vector_topk(table(spark, sf, "embeddings").where("vec_id <> 0"), _vector(spark, sf), 5, 0.2)


@query(f"WITH q AS (SELECT * FROM embeddings WHERE vec_id = 0) SELECT e.vec_id, {COSINE_SQL} AS score FROM embeddings e, q WHERE {COSINE_SQL} >= 0.2")
def vector_threshold(spark, sf):
    return retrieval.vector_threshold(table(spark, sf, "embeddings"), _vector(spark, sf), 0.2)


@query(
    f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {COSINE_SQL} AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT * FROM r WHERE rank <= 5"
)
def vector_topk_per_query(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return retrieval.vector_topk_many(vectors, vectors.where("vec_id % 100 = 0"), 5)


@query(f"WITH q AS (SELECT * FROM embeddings WHERE vec_id = 0) SELECT e.vec_id, {COSINE_SQL} AS score FROM embeddings e, q WHERE e.label = 3 ORDER BY score DESC, e.vec_id LIMIT 10")
def memory_search(spark, sf):
    return memory.search(table(spark, sf, "embeddings"), _vector(spark, sf), F.lit(3), "label", 10)


@query("SELECT vec_id, label FROM embeddings WHERE label IS DISTINCT FROM 3")
def memory_wipe(spark, sf):
    return memory.wipe(table(spark, sf, "embeddings").select("vec_id", "label"), F.lit(3), "label")


@query("SELECT vec_id, label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM embeddings d WHERE d.label = 5 AND d.vec_id % 2 = 0 AND d.vec_id = e.vec_id)")
def memory_delete(spark, sf):
    items = table(spark, sf, "embeddings").select("vec_id", "label")
    return memory.delete(items, items.where("label = 5 AND vec_id % 2 = 0"), "vec_id")


@query(
    "SELECT id, user_id, text FROM (SELECT conv_id * 100 + turn AS id, CASE WHEN role = 'system' OR turn % 3 = 0 THEN 'default' WHEN turn % 5 = 4 THEN 'bad user!' ELSE 'u' || CAST(conv_id AS VARCHAR) END AS user_id, text FROM conversations) "
    "WHERE regexp_full_match(user_id, '[A-Za-z0-9._@:+-]{1,128}') AND regexp_matches(coalesce(text, ''), '\\S') AND length(text) <= 32768"
)
def memory_insert_default_user(spark, sf):
    user = F.when((F.col("role") == "system") | (F.col("turn") % 3 == 0), " ").when(F.col("turn") % 5 == 4, "bad user!").otherwise(F.concat(F.lit("u"), F.col("conv_id").cast("string")))
    new = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), user.alias("user_id"), "text")
    return memory.insert(new.limit(0), new)


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM conversations) WHERE r <= 5")
def chat_tail_n(spark, sf):
    return history.tail(table(spark, sf, "conversations"), 5).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, count(*) AS turns, CAST(coalesce(sum(length(text) // 4), 0) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def conv_token_estimate(spark, sf):
    return history.token_estimates(table(spark, sf, "conversations"))


SMALL = Compaction(turn_trigger=6, keep=3, context_tokens=1_000_000)
PLAN_SQL = """
WITH s AS (SELECT conv_id, count(*) AS turns, CAST(coalesce(sum(length(text) // 4), 0) AS BIGINT) AS tokens, arg_min(role, turn) AS r1, arg_min(text, turn) AS t1 FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, turns, tokens, CASE WHEN NOT (turns >= 6 OR tokens >= 500000) THEN 0 WHEN lower(r1) = 'system' AND starts_with(t1, '[Conversation summary]') AND turns - 1 < 6 THEN 0
  WHEN greatest(1, turns - 3) >= turns THEN turns - 1 ELSE greatest(1, turns - 3) END AS prefix FROM s)
"""


@query(PLAN_SQL + "SELECT conv_id, turns, tokens, CAST(prefix AS BIGINT) AS prefix FROM p")
def compaction_plan(spark, sf):
    return history.compaction_plan(table(spark, sf, "conversations"), SMALL)


@query(
    PLAN_SQL + ", r AS (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn, role, text) AS n FROM conversations c) "
    "SELECT r.conv_id, r.turn, r.role, r.text FROM r JOIN p USING (conv_id) WHERE prefix = 0 OR n > prefix "
    "UNION ALL SELECT r.conv_id, r.turn, 'system', '[Conversation summary] ' || CAST(prefix AS VARCHAR) || ' turns' FROM r JOIN p USING (conv_id) WHERE n = prefix"
)
def compaction_apply(spark, sf):
    return history.compact(table(spark, sf, "conversations"), SMALL)


@query("SELECT conv_id, string_agg(upper(role) || ': ' || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def conversation_render(spark, sf):
    return history.render(table(spark, sf, "conversations"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE regexp_matches(coalesce(text, ''), '\\S') GROUP BY conv_id")
def last_nonblank_turn(spark, sf):
    return history.last_nonblank(table(spark, sf, "conversations"))


@query("SELECT conv_id, string_agg(lower(role), ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def turn_sequence(spark, sf):
    return history.role_sequence(table(spark, sf, "conversations"))


@query("SELECT user_id, instruction_text, turn FROM (SELECT 'u' || CAST(conv_id % 40 AS VARCHAR) AS user_id, text AS instruction_text, conv_id * 100 + turn AS turn, row_number() OVER (PARTITION BY conv_id % 40 ORDER BY conv_id * 100 + turn DESC) AS r FROM conversations WHERE role = 'system') WHERE r = 1")
def instruction_upsert(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'system'")
    rows = rows.select(F.concat(F.lit("u"), (F.col("conv_id") % 40).cast("string")).alias("user_id"), F.col("text").alias("instruction_text"), (F.col("conv_id") * 100 + F.col("turn")).alias("turn"))
    return history.upsert(rows.where("turn % 200 < 100"), rows.where("turn % 200 >= 100"), "user_id", "turn")


def _candidates(spark, sf):
    """Documents as retrieval candidates of their source, the longest first."""
    blank = F.lit(None).cast("string")
    return table(spark, sf, "documents").where("doc_id IS NOT NULL").select(
        F.struct((-F.col("n_chars")).alias("n"), "doc_id").alias("rank"), F.lit(1.0).alias("score"), F.when(F.col("doc_id") % 7 == 0, " ").otherwise("library").alias("bucket"),
        blank.alias("key"), "source", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("T"), F.col("doc_id").cast("string"))).alias("title"), blank.alias("display_name"), "text", "doc_id", "n_chars",
    )


@query(
    "WITH c AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 7 = 0 THEN 'documents' ELSE 'library' END AS bucket, source AS key, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'T' || CAST(doc_id AS VARCHAR) END AS name FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(source, '\\S')), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY n_chars DESC, doc_id) AS r FROM c) SELECT bucket, key, name, doc_id FROM r WHERE r = 1"
)
def rag_source_dedup(spark, sf):
    return retrieval.sources(_candidates(spark, sf)).select("bucket", "key", "name", F.col("rank.doc_id").alias("doc_id"))


@query(
    "WITH u AS (SELECT source, doc_id, n_chars, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')) "
    "SELECT source, doc_id, substr(text, 1, CAST(4000 - used AS BIGINT)) AS snippet FROM u WHERE used < 4000"
)
def rag_context_budget(spark, sf):
    return retrieval.budget(table(spark, sf, "documents"), "source", [F.col("n_chars"), F.col("doc_id")]).select("source", "doc_id", "snippet")


@query(
    "WITH k AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM documents), "
    "u AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM k WHERE rank <= 5 AND regexp_matches(coalesce(text, ''), '\\S')) "
    "SELECT source, '<rag_context>' || chr(10) || 'The following context may be relevant. Use it only if it helps; otherwise ignore it.' || chr(10) || chr(10) || string_agg(substr(text, 1, CAST(4000 - used AS BIGINT)) || chr(10) || chr(10), '' ORDER BY rank) || '</rag_context>' AS context FROM u WHERE used < 4000 GROUP BY source"
)
def rag_context_block(spark, sf):
    ranked = table(spark, sf, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id")))
    return prompt.contexts(ranked.withColumn("score", F.lit(1.0)), "source")


@query("SELECT 'u' || CAST(c.conv_id AS VARCHAR) AS user_id, 'You are a helpful assistant.' || chr(10) || chr(10) || 'User Instructions:' || chr(10) || coalesce(i.text, '') AS message FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id) i USING (conv_id)")
def system_message(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("user_id", F.concat(F.lit("u"), F.col("conv_id").cast("string")))
    instructions = turns.where("role = 'system'").groupBy("user_id").agg(F.min_by("text", "turn").alias("instruction_text"))
    return prompt.system_message(turns.select("user_id").distinct(), instructions)


NAMES = ("a.md", "B.MD", "x.docx", "y.PDF", "z.jpeg", "mail.eml", "archive.tar.gz", "noext", "page.html", "scan.tiff")


@query(
    f"SELECT name, CASE WHEN e = 'md' THEN 'markdown' WHEN e IN ('docx','xlsx','pptx','html') THEN 'docling' WHEN e IN ('png','jpg','jpeg','tiff','bmp','webp') THEN 'ocr' WHEN e IN ('eml','msg','epub','rtf','xml','odt') THEN 'unstructured' WHEN e = 'pdf' THEN 'per_page' END AS parser "
    f"FROM (SELECT name, lower(regexp_extract(name, '\\.([^./]+)$', 1)) AS e FROM (SELECT unnest({list(NAMES)}) AS name UNION ALL SELECT url FROM pages))"
)
def route_by_extension(spark, sf):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string").unionByName(table(spark, sf, "pages").select(F.col("url").alias("name")))
    return names.select("name", ingest.parser(F.col("name")).alias("parser"))


@query(
    "SELECT doc_id, key, CASE WHEN ends_with(lower(key), '.md') OR contains(key, 'markdown/') THEN 'markdown' WHEN contains(key, 'documents/') THEN 'unstructured' END AS channel "
    "FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'markdown/' WHEN 1 THEN 'documents/' WHEN 2 THEN 'other/' ELSE '' END || source || CASE WHEN doc_id % 5 = 0 THEN '.MD' ELSE '.txt' END AS key FROM documents)"
)
def route_ingest_channel(spark, sf):
    folder = F.element_at(F.array(*map(F.lit, ("markdown/", "documents/", "other/", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    key = F.concat(folder, F.col("source"), F.when(F.col("doc_id") % 5 == 0, ".MD").otherwise(".txt"))
    return table(spark, sf, "documents").select("doc_id", key.alias("key")).withColumn("channel", ingest.channel(F.col("key")))


@query("SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 50 THEN 'ocr' ELSE 'docling' END AS parser FROM documents")
def route_short_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ingest.page_parser(F.col("text")).alias("parser"))


@query(
    "WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[\\x00-\\x1f\\x7f]', '', 'g'), '\\.{2,}', '.', 'g'), '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g'), '^[._]+', '', 'g') AS n FROM pages) "
    "SELECT page_id, CASE WHEN length(n) = 0 THEN 'unknown_file' WHEN length(n) > 200 THEN substr(n, 1, 200 - length(regexp_extract(n, '(\\.[A-Za-z0-9_-]{1,20})$', 1))) || regexp_extract(n, '(\\.[A-Za-z0-9_-]{1,20})$', 1) ELSE n END AS name FROM b"
)
def sanitize_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.sanitized_filename(F.col("url")).alias("name"))


def _objects(spark, sf):
    return table(spark, sf, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("key"), F.crc32("text").cast("string").alias("version"), "doc_id")


@query("SELECT source || '/' || CAST(doc_id AS VARCHAR) AS key, doc_id FROM documents WHERE doc_id % 3 <> 0")
def ingest_new_versions(spark, sf):
    objects = _objects(spark, sf)
    return ingest.new_versions(objects, objects.where("doc_id % 3 = 0")).select("key", "doc_id")


@query(
    "WITH o AS (SELECT doc_id, source FROM documents WHERE (doc_id // 20) % 2 = 0), n AS (SELECT doc_id, source FROM documents WHERE (doc_id // 20) % 2 = 1 AND source IN ('src1', 'src4', 'src7')) "
    "SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source = o.source) UNION ALL SELECT * FROM n"
)
def ingest_replace_by_source(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return ingest.replace_by_source(docs.where("(doc_id div 20) % 2 = 0"), docs.where("(doc_id div 20) % 2 = 1 AND source IN ('src1', 'src4', 'src7')"))


@query(
    "SELECT source, CAST(coalesce(sum(CASE WHEN s = 'indexed' THEN c END), 0) AS BIGINT) AS indexed, CAST(coalesce(sum(CASE WHEN s IN ('skipped', 'empty') THEN 1 END), 0) AS BIGINT) AS skipped, CAST(coalesce(sum(CASE WHEN s = 'failed' THEN 1 END), 0) AS BIGINT) AS failed "
    "FROM (SELECT source, n_chars // 1000 + 1 AS c, CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN n_chars < 100 THEN 'empty' WHEN doc_id % 3 = 0 THEN 'skipped' ELSE 'indexed' END AS s FROM documents) GROUP BY source"
)
def ingest_tally(spark, sf):
    status = F.when(F.col("doc_id") % 11 == 0, "failed").when(F.col("n_chars") < 100, "empty").when(F.col("doc_id") % 3 == 0, "skipped").otherwise("indexed")
    return ingest.tally(table(spark, sf, "documents").select("source", status.alias("status"), F.expr("n_chars div 1000 + 1").alias("chunks")), "source")


@query()
def ingest_chunks(spark, sf):
    return ingest.chunks(table(spark, sf, "documents").select("doc_id", "text"))


#: Ten words and more, of which next to none are words, and a plain text beside them.
UNREADABLE = ((-1, "incomprehensibilities * * * * * * * * * *"), (-2, "### internationalization --- --- --- *** %%% &&& === +++ ~~~ unconstitutionality"), (-3, "a * b * c * d * e * f * g"))


@query(
    f"WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in UNREADABLE)}) v(doc_id, text)), "
    "w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w, regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}'']+') AS l FROM t) "
    "SELECT doc_id, CASE WHEN len(w) = 0 THEN 'empty' WHEN regexp_matches(text, 'Access Denied|403 Forbidden|Captcha|Security Check|Enable JavaScript|Additional Verification Required|Ray ID') THEN 'error' WHEN len(w) < 10 THEN 'short' "
    "WHEN len(l) < 10 AND 206.835 - 1.015 * greatest(len(l), 1) / greatest(len(regexp_extract_all(text, '[.!?]+')), 1) - 84.6 * coalesce(list_sum(list_transform(l, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')), 1))), 0) / greatest(len(l), 1) < 20 THEN 'unreadable' "
    "WHEN len(w) > 50 AND len(list_distinct(w)) / len(w) < 0.1 THEN 'repetitive' ELSE 'ok' END AS gate FROM w"
)
def text_quality_gate(spark, sf):
    odd = spark.createDataFrame([*UNREADABLE], "doc_id bigint, text string")
    return table(spark, sf, "documents").select("doc_id", "text").unionByName(odd).select("doc_id", T.quality_gate(F.col("text")).alias("gate"))


ODD_PAGES = (
    (-1, "https://a.example/login?login=1", "<title>Please Sign In</title><p>x</p>", 200),
    (-2, "https://b.example/x", "<p>Ray ID: 7f3a</p>", 200),
    (-3, "https://c.example/", "", 503),
    (-4, "https://d.example/signin", "<p>Just a moment...</p>", 200),
    (-5, "https://e.example/", "<p>Access Denied</p>", 200),
    (-6, "https://f.example/ok", "<p>all is well here</p>", 200),
)
ODD_SQL = "SELECT page_id, url, html, 200 AS status FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{u}', '{h}', {s})" for i, u, h, s in ODD_PAGES) + ") v(page_id, url, html, status)"


def _pages(spark, sf):
    odd = spark.createDataFrame([*ODD_PAGES], "page_id bigint, url string, html string, status int")
    return table(spark, sf, "pages").select("page_id", "url", "html", F.lit(200).alias("status")).unionByName(odd)


@query(f"SELECT page_id, regexp_matches(coalesce(html, ''), 'Access Denied|403 Forbidden|Captcha|Security Check|Enable JavaScript|Additional Verification Required|Ray ID') AS is_error FROM ({ODD_SQL})")
def page_error_keywords(spark, sf):
    return _pages(spark, sf).select("page_id", T.has_error_keyword(F.col("html")).alias("is_error"))


@query(
    "SELECT page_id, CASE WHEN coalesce(html, '') = '' THEN CASE WHEN status IN (403, 429, 503) THEN 'blocked' ELSE 'none' END WHEN length(html) > 50000 THEN 'none' "
    "WHEN regexp_matches(html, '(?i)Ray ID: \\w+') OR regexp_matches(html, 'arkoselabs\\.com|recaptcha/api\\.js|hcaptcha\\.com/1/api\\.js|datadome\\.co/tags\\.js|perimeterx\\.net|Prove your humanity|Pardon Our Interruption|Please verify you are a human|Checking if the site connection is secure|Just a moment\\.\\.\\.|Attention Required!|cf-turnstile|cf_clearance') THEN 'blocked' "
    f"WHEN regexp_matches(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 'sign in|log in|login|sign into|create account') THEN 'login' ELSE 'none' END AS challenge FROM ({ODD_SQL})"
)
def page_challenge_class(spark, sf):
    return _pages(spark, sf).select("page_id", web.challenge(F.col("html"), F.col("status")).alias("challenge"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.title(F.col("html")).alias("title"))


@query("SELECT page_id, CAST(n AS INT) AS link_no, l[n] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1) AS l FROM pages))")
def page_links_raw(spark, sf):
    return web.raw_links(table(spark, sf, "pages"))


@query(
    "SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace("
    + "regexp_replace(" * 5 + "html" + "".join(f", '(?is)<{n}\\b.*?</{n}\\s*>', ' ', 'g')" for n in web.NOISE)
    + ", '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages"
)
def html_plain_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.plain_text(F.col("html")).alias("text"))


@query()
def html_to_text(spark, sf):
    return web.html_to_text(table(spark, sf, "pages").select("page_id", "html")).select("page_id", "text")


@query()
def page_links(spark, sf):
    return web.page_links(table(spark, sf, "pages")).select("page_id", "annotated", F.to_json("links").alias("links"))


@query()
def read_cascade(spark, sf):
    ship(spark)
    return web.read(_pages(spark, sf), [("patterns", web.plain_text(F.col("html"))), ("parser", web.parsed)], status=F.col("status")).select("page_id", "content", "mode", "reason")


@query()
def read_links(spark, sf):
    """The cascade on texts with link markers."""
    return web.read_links(_pages(spark, sf), status=F.col("status")).select("page_id", "annotated", F.to_json("links").alias("links"), "mode", "reason")


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages")
def url_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"))


@query(f"SELECT page_id, regexp_matches(lower(url), '\\?login|continue=|signin|login=|auth\\?') AS is_login FROM ({ODD_SQL})")
def url_login_redirect(spark, sf):
    return _pages(spark, sf).select("page_id", U.is_login_redirect(F.col("url")).alias("is_login"))


@query("SELECT p_type, pattern, count(*) AS n FROM part JOIN (SELECT unnest(['economy*', '*dium', 's*', '*anodized*', 'none']) AS pattern) ON p_type ILIKE replace(pattern, '*', '%') GROUP BY p_type, pattern")
def glob_match(spark, sf):
    patterns = spark.createDataFrame([(p,) for p in ("economy*", "*dium", "s*", "*anodized*", "none")], "pattern string")
    types = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return providers.matches_glob(types, patterns, F.col("p_type")).select("p_type", "pattern", "n")


@query("SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'europe' WHEN n_nationkey % 7 = 0 THEN 'mars' ELSE lower(r.r_name) END AS resolved, p.r_regionkey AS region, CASE WHEN p.r_regionkey IS NULL THEN 'unknown provider: mars' END AS error FROM nation n JOIN region r ON n_regionkey = r.r_regionkey LEFT JOIN region p ON lower(p.r_name) = CASE WHEN n_nationkey % 5 = 0 THEN 'europe' WHEN n_nationkey % 7 = 0 THEN 'mars' ELSE lower(r.r_name) END")
def provider_defaults(spark, sf):
    regions = table(spark, sf, "region")
    asked = table(spark, sf, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.when(F.col("n_nationkey") % 5 == 0, "  ").when(F.col("n_nationkey") % 7 == 0, "MARS").otherwise(F.concat(F.lit(" "), F.col("r_name")))
    known = regions.select(F.lower("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    return providers.with_defaults(asked.select("n_name", name.alias("provider")), known, "europe").select("n_name", "resolved", "region", "error")


@query("WITH c AS (SELECT c_mktsegment AS query, c_custkey, n_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN n_name = 'FRANCE' THEN 0 ELSE 1 END, c_custkey) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT query, c_custkey, n_name FROM c WHERE r = 1")
def geocode_best_match(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("c_mktsegment").alias("query"), "c_custkey", "n_name", F.col("n_name").alias("country_code"))
    return shaping.best_match(rows, "query", "c_custkey", F.lit("france")).select("query", "c_custkey", "n_name")


@query("WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id AS date, CASE WHEN i < n THEN value END AS value FROM s")
def parallel_arrays_to_rows(spark, sf):
    pairs = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    series = table(spark, sf, "events").groupBy("user_id").agg(pairs.alias("p"))
    series = series.select("user_id", F.transform("p", lambda x: x["event_id"]).alias("time"), F.slice(F.transform("p", lambda x: x["value"]), 1, F.size("p") - 1).alias("v"))
    return shaping.daily_rows(series, {"v": "value"}).select("user_id", "date", "value")


@query("SELECT event_id, (event_id % 90000) // 900 AS chunk, CAST(event_id % 900 + ((event_id % 90000) // 900) * 900 AS DOUBLE) AS start, CAST(event_id % 900 + ((event_id % 90000) // 900) * 900 + 1 AS DOUBLE) AS \"end\" FROM events")
def segment_offsets(spark, sf):
    rows = table(spark, sf, "events").select("event_id", transcript.chunk_of(F.col("event_id") % 90000, 900).alias("chunk"), (F.col("event_id") % 900).cast("double").alias("start"), (F.col("event_id") % 900 + 1).cast("double").alias("end"))
    return transcript.shifted(rows, 900)


@query(
    "SELECT user_id // 10 AS conversation, string_agg('[' || lpad(CAST((event_id % 90000) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(((event_id % 90000) // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 90000 % 60 AS VARCHAR), 2, '0') || '] [' || CAST(user_id AS VARCHAR) || '] ' || event_type, chr(10) ORDER BY event_id % 90000, CAST(user_id AS VARCHAR), event_id) AS transcript FROM events GROUP BY user_id // 10"
)
def transcript_merge(spark, sf):
    rows = table(spark, sf, "events").select(F.expr("user_id div 10").alias("conversation"), F.col("user_id").cast("string").alias("track"), (F.col("event_id") % 90000).alias("start"), F.col("event_id").alias("segment_no"), F.concat(F.lit(" "), F.col("event_type"), F.lit("\t")).alias("text"))
    return transcript.merge(rows, "conversation")


@query(
    "WITH c AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS o, value AS d FROM events WHERE value > 0), g AS (SELECT *, o - coalesce(lag(o + d) OVER (PARTITION BY user_id ORDER BY o, event_id), 0.0) AS gap FROM c) SELECT user_id, event_id, round(CASE WHEN gap > 0.001 THEN gap ELSE 0.0 END, 3) AS gap FROM g"
)
def timeline_gaps(spark, sf):
    clips = table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("offset"), F.col("value").alias("duration"))
    return transcript.gaps(clips, "user_id", tie="event_id").select("user_id", "event_id", F.round("gap", 3).alias("gap"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def counter_by_label(spark, sf):
    return metrics.counters(table(spark, sf, "events"), ["event_type"])


BOUNDS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0)


@query(f"SELECT event_type, le, count(CASE WHEN value <= le THEN 1 END) AS n, round(sum(value), 4) AS total, count(value) AS count FROM events, (SELECT unnest({list(BOUNDS)}) AS le) GROUP BY event_type, le")
def latency_histogram(spark, sf):
    return metrics.histogram(table(spark, sf, "events"), ["event_type"], "value", BOUNDS)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def rate_limit(spark, sf):
    return metrics.rate_limited(table(spark, sf, "events"), "user_id", "ts", 3, "day").select("event_id", "allowed")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    "SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS session_start, CAST(epoch_us(max(ts) + INTERVAL 24 HOUR) AS BIGINT) AS session_end, count(*) AS n FROM s GROUP BY user_id, k"
)
def sessionize_events(spark, sf):
    rows = metrics.sessions(table(spark, sf, "events"), "user_id", "ts")
    return rows.withColumns({c: F.unix_micros(F.col(c)) for c in ("session_start", "session_end")})


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def event_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 12) AS user_hash FROM customer")
def user_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.user_hash(F.col("c_name")).alias("user_hash"))


DATES = ("2020-02-29", "2021-02-29", " ", "2026-01-01", "1940-01-01", "01/02/2003", "2019-12-31")


@query(
    f"WITH d AS (SELECT unnest({list(DATES)}) AS date UNION ALL SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) FROM events), p AS (SELECT date, CASE WHEN regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(date AS DATE) END AS p FROM d) "
    "SELECT date, CASE WHEN trim(date) = '' THEN 'date must not be blank' WHEN p IS NULL THEN 'date must be in ISO format yyyy-MM-dd' WHEN p >= DATE '2026-01-01' THEN 'date must be strictly in the past' WHEN p < DATE '1946-01-01' THEN 'date must be within the last 80 years' END AS error FROM p"
)
def validate_dates(spark, sf):
    days = table(spark, sf, "events").select(F.to_date("ts").cast("string").alias("date")).distinct()
    rows = spark.createDataFrame([(d,) for d in DATES], "date string").unionByName(days)
    return rows.select("date", shaping.date_error(F.col("date"), F.lit("2026-01-01").cast("date")).alias("error"))


RESPONSES = ('["a", "b"]', '```json\n["fact-A", "fact-B"]\n```', 'Reasoning: "the array starts with [" -- final: ["User likes [brackets]"]', 'intro ["a"] more thinking [["nested"], ["x", "y"]]', "", "no array", 'Some prose ["User said \\"hello\\" loudly"]')


@query()
def extract_json_facts(spark, sf):
    return memory.extract_facts(spark.createDataFrame([*enumerate(RESPONSES)], "id bigint, response string")).select("id", F.to_json("facts").alias("facts"))


@query()
def ttl_cache_hits(spark, sf):
    return metrics.ttl_hits(table(spark, sf, "events"), "user_id", "ts", 86_400).select("user_id", "event_id", "hit")


@query("SELECT user_id, count(*) AS calls, count(CASE WHEN event_type = 'click' AND event_id % 3 > 0 THEN 1 END) AS hits, CAST(sum(CASE WHEN event_type = 'click' THEN event_id % 3 ELSE 0 END) AS BIGINT) AS tokens_read, CAST(sum(event_id % 5) AS BIGINT) AS tokens_written FROM events GROUP BY user_id")
def prompt_cache_hits(spark, sf):
    calls = table(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "click", F.col("event_id") % 3).alias("read"), (F.col("event_id") % 5).alias("written"))
    return metrics.prompt_cache(calls, ["user_id"], "read", "written")


@query("SELECT user_id, bool_and(value < 95) AS ready FROM events GROUP BY user_id")
def service_readiness(spark, sf):
    return metrics.readiness(table(spark, sf, "events"), "user_id", F.when(F.col("value") < 50, "ok").when(F.col("value") < 95, "skipped").otherwise("down"))


@query("SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total <= 20000")
def archive_cap(spark, sf):
    return transcript.within_cap(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", 20_000)


@query(
    "WITH h AS (SELECT page_id, string_split(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '.') AS l FROM pages), d AS (SELECT page_id, array_to_string(list_slice(l, -2, -1), '.') AS domain FROM h), "
    "a AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id DESC) AS r FROM d) SELECT domain, page_id FROM a WHERE r = 1 AND page_id >= (SELECT max(page_id) // 2 FROM pages)"
)
def cookie_sessions(spark, sf):
    """The last session of each registrable domain, if it is alive; a page's id is its minute, the last one is now, and a session lives for half of all time."""
    pages = table(spark, sf, "pages")
    last = pages.agg(F.max("page_id")).first()[0] or 0
    rows = pages.select("page_id", U.registrable_domain(F.col("url")).alias("domain"), F.timestamp_seconds(F.col("page_id") * 60).alias("saved"))
    return metrics.latest_alive(rows, "domain", "saved", (last - last // 2) * 60, F.timestamp_seconds(F.lit(last * 60)), "page_id").select("domain", "page_id")


@query("SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY turn) AS memory FROM conversations WHERE role = 'user' AND regexp_matches(coalesce(text, ''), '\\S') GROUP BY conv_id")
def memory_lines(spark, sf):
    return memory.lines(table(spark, sf, "conversations").where("role = 'user'"), "conv_id", "turn")


@query("SELECT user_id, string_agg('[' || format('{:.2f}', event_id % 1000 / 4.0) || ' - ' || format('{:.2f}', event_id % 1000 / 4.0 + 0.5) || '] ' || event_type, chr(10) ORDER BY event_id % 1000, event_id) AS lines FROM events GROUP BY user_id")
def segment_lines(spark, sf):
    start = F.col("event_id") % 1000 / F.lit(4.0)
    rows = table(spark, sf, "events").select("user_id", start.alias("start"), (start + 0.5).alias("end"), F.col("event_id").alias("segment_no"), F.col("event_type").alias("text"))
    return transcript.segment_lines(rows, "user_id")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY seen) AS names FROM (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def tool_names(spark, sf):
    return metrics.first_seen(table(spark, sf, "events"), "user_id", "event_type", "event_id").select("user_id", F.array_join("names", ",").alias("names"))


@query("SELECT bucket, key, size, mime, 3600 AS ttl_seconds FROM (SELECT 'b' || CAST(doc_id % 3 AS VARCHAR) AS bucket, source || '/' || CAST(doc_id AS VARCHAR) AS key, n_chars AS size, CASE WHEN lang = 'en' THEN 'text/plain' WHEN lang = 'de' THEN 'Application/PDF' ELSE 'video/mp4' END AS mime FROM documents) WHERE size <= 3000 AND lower(mime) IN ('text/plain', 'application/pdf')")
def source_files(spark, sf):
    objects = table(spark, sf, "documents").select(F.concat(F.lit("b"), (F.col("doc_id") % 3).cast("string")).alias("bucket"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("key"), F.col("n_chars").alias("size"), F.when(F.col("lang") == "en", "text/plain").when(F.col("lang") == "de", "Application/PDF").otherwise("video/mp4").alias("mime"))
    return retrieval.source_files(objects.select("bucket", "key"), objects, 86_400, Retrieval(max_source_bytes=3000), ["text/plain", "application/pdf"])


@query("SELECT n_nationkey, n, CASE WHEN n IS NULL THEN 'no_results' ELSE 'ok' END AS status FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey")
def forecast_lookup(spark, sf):
    answers = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return shaping.with_status(table(spark, sf, "nation").select("n_nationkey"), answers, ["n_nationkey"])


@query(
    "SELECT event_type, CAST(epoch_us(w) AS BIGINT) AS window_start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY event_type, w"
)
def sliding_windows(spark, sf):
    rows = windows.counted(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], windows.sliding("ts", "2 hours", "1 hour"))
    return rows.select("event_type", F.unix_micros("window_start").alias("window_start"), "n")


@query()
def sql_tools(spark, sf):
    """The registered tools, called from SQL."""
    registry.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("tessera_documents")
    return spark.sql("SELECT d.doc_id, c.chunk_no, length(page_text(c.chunk)) AS n_chars FROM tessera_documents d, LATERAL split_text(d.text) c")


def _shared(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"


def _event_stream(spark, sf):
    """The events as a file stream, under a schema that is known beforehand."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf)


@query(
    "SELECT event_type, CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts) "
    "HAVING epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) + 3600000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)"
)
def stream_windows(spark, sf):
    """Hourly sums of the event stream, the windows that the watermark has closed."""
    folder = _shared(spark)
    hourly = windows.counted(windows.watermarked(_event_stream(spark, sf)), ["event_type"], windows.tumbling("ts", "1 hour"), "value")
    # append mode writes a window once, when it is closed
    run = hourly.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    out = spark.read.schema("event_type string, window_start timestamp, window_end timestamp, n bigint, total double").parquet(f"{folder}/out")
    return out.select("event_type", F.unix_micros("window_start").alias("window_start"), "n", F.round("total", 4).alias("total"))


@query()
def stream_ingest(spark, sf):
    """Documents written as files, ingested by a stream, twice; the second run adds nothing."""
    folder = _shared(spark)
    table(spark, sf, "documents").where("text IS NOT NULL").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("key"), F.crc32("text").cast("string").alias("version"), "text").write.parquet(f"{folder}/in")
    for _ in range(2):
        files = spark.readStream.schema("key string, version string, text string").parquet(f"{folder}/in")
        each = streamed.index_batches(f"{folder}/index", f"{folder}/ledger", lambda rows: rows.withColumn("error", F.lit(None).cast("string")))
        files.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return streamed.latest(spark, f"{folder}/index").select("source", "version", "chunk_no", "chunk")


MODELS = (("openai", 1536, "small"), ("gemini", 768, "flash"), ("lmstudio", 768, "local"), ("none", 0, None))
MODELS_SQL = "(VALUES ('openai', 1536, 'small'), ('gemini', 768, 'flash'), ('lmstudio', 768, 'local'), ('none', 0, NULL)) m(name, size, model)"


def _models(spark):
    return spark.createDataFrame([*MODELS], "name string, size int, model string")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM conversations) WHERE r <= 4")
def chat_cache(spark, sf):
    """What a cache of two turns holds when compaction keeps three."""
    return history.tail(table(spark, sf, "conversations"), history.cache_size(2, True, SMALL)).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM conversations) WHERE r <= 2")
def chat_head_n(spark, sf):
    return history.tail(table(spark, sf, "conversations"), 2, keep="oldest").select("conv_id", "turn", "role", "text")


@query(f"WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'OpenAI' END AS o, CASE WHEN c_custkey % 3 = 0 THEN 'gemini' WHEN c_custkey % 3 = 1 THEN ' ' END AS p, CASE WHEN c_custkey % 8 = 0 THEN 'big' END AS m FROM customer), t AS (SELECT *, coalesce(lower(o), nullif(trim(p), ''), 'lmstudio') AS target_provider FROM r) SELECT c_custkey, target_provider, coalesce(t.m, m.model) AS target_model FROM t LEFT JOIN {MODELS_SQL} ON m.name = target_provider")
def compaction_target(spark, sf):
    k = F.col("c_custkey")
    asked = table(spark, sf, "customer").select("c_custkey", F.when(k % 4 == 0, "OpenAI").alias("override_provider"), F.when(k % 3 == 0, "gemini").when(k % 3 == 1, " ").alias("provider"), F.when(k % 8 == 0, "big").alias("override_model"))
    return history.compaction_target(asked, _models(spark), "lmstudio").select("c_custkey", "target_provider", "target_model")


@query("SELECT 'u' || CAST(c.conv_id AS VARCHAR) AS user_id, coalesce(CASE WHEN regexp_matches(i.text, '\\S') THEN i.text END, '') AS cached, CASE WHEN regexp_matches(i.text, '\\S') THEN i.text END AS instruction_text FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id) i USING (conv_id)")
def cached_instructions(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("user_id", F.concat(F.lit("u"), F.col("conv_id").cast("string")))
    return history.cached_instructions(turns, turns.where("role = 'system'").groupBy("user_id").agg(F.min_by("text", "turn").alias("instruction_text")))


@query(f"SELECT DISTINCT 'vectors-' || size AS name, size, 'cosine' AS metric FROM {MODELS_SQL} WHERE size > 0 AND size <> 768")
def missing_collections(spark, sf):
    return providers.missing_collections(_models(spark), spark.createDataFrame([("vectors-768",)], "name string"))


@query("SELECT '{\"gemini\":\"vectors-768\",\"lmstudio\":\"vectors-768\",\"none\":\"vectors-0\",\"openai\":\"vectors-1536\"}' AS stores")
def collections_by_provider(spark, sf):
    return providers.collections_by_provider(_models(spark)).select(F.to_json("stores").alias("stores"))


@query("SELECT user_id, arg_min(event_id, event_id) AS date, arg_min(value, event_id) AS value, CAST(NULL AS VARCHAR) AS error FROM events GROUP BY user_id")
def first_day(spark, sf):
    pairs = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    series = table(spark, sf, "events").groupBy("user_id").agg(pairs.alias("p")).select("user_id", F.transform("p", lambda x: x["event_id"]).alias("time"), F.transform("p", lambda x: x["value"]).alias("v"))
    return shaping.first_day(series, {"v": "value"})


@query("SELECT json_object('location', json_object('n_name', n_name, 'n_regionkey', n_regionkey), 'key', json_object('value', n_nationkey, 'unit', 'no')) AS result FROM nation")
def current_result(spark, sf):
    rows = table(spark, sf, "nation").select("n_name", "n_regionkey", "n_nationkey", F.lit("no").alias("unit"))
    out = shaping.current_result(rows, ["n_name", "n_regionkey"], {"key": ("n_nationkey", "unit")})
    return out.select(F.to_json(F.struct("location", "key")).alias("result"))


@query("WITH c AS (SELECT n_name, c_custkey, n_nationkey % 13 AS l, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT n_name, c_custkey FROM c WHERE CASE WHEN l = 12 THEN r <= 5 WHEN l BETWEEN 1 AND 10 THEN r <= l ELSE false END")
def geocode_limit(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("n_name", "c_custkey", F.nullif(F.col("n_nationkey") % 13, F.lit(12)).alias("asked"))
    return shaping.limited(rows, "n_name", "c_custkey", F.col("asked")).select("n_name", "c_custkey")


@query("SELECT doc_id, key, ends_with(lower(key), '.md') OR contains(key, 'markdown/') OR contains(key, 'documents/') AS eligible FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'documents/' WHEN 1 THEN 'else/' ELSE 'x/' END || source || CASE WHEN doc_id % 4 = 0 THEN '.Md' ELSE '.txt' END AS key FROM documents)")
def ingest_eligible(spark, sf):
    key = F.concat(F.when(F.col("doc_id") % 3 == 0, "documents/").when(F.col("doc_id") % 3 == 1, "else/").otherwise("x/"), F.col("source"), F.when(F.col("doc_id") % 4 == 0, ".Md").otherwise(".txt"))
    return table(spark, sf, "documents").select("doc_id", key.alias("key")).withColumn("eligible", ingest.is_eligible(F.col("key")))


HEADS = (("89504E470D0A1A0A", "image/png"), ("FFD8FFE0", "image/jpeg"), ("474946383961", "image/gif"), ("424D0000", "image/bmp"), ("49492A00", "image/tiff"), ("255044462D31", "application/pdf"), ("524946460000000057454250", "image/webp"), ("7465787400", None))


@query("SELECT head, mime, CASE WHEN mime IS NULL THEN 'unrecognised file signature' WHEN mime NOT IN ('image/png', 'application/pdf') THEN 'type not allowed' END AS error FROM (VALUES " + ", ".join(f"('{h}', {repr(m) if m else 'NULL'})" for h, m in HEADS) + ") v(head, mime)")
def accepted_types(spark, sf):
    rows = spark.createDataFrame([(h,) for h, _ in HEADS], "head string").withColumn("content", F.unhex("head"))
    return ingest.accept(rows, ["image/png", "application/pdf"]).select("head", "mime", "error")


ADDRESSES = (
    ("http://example.com/a", True), ("http://127.0.0.1/", False), ("https://192.0.2.7/", False), ("https://192.0.3.7/", True), ("http://198.51.100.1/", False), ("http://198.51.7.1/", True), ("http://203.0.113.9/", False),
    ("http://203.0.1.9/", True), ("http://172.32.0.1/", True), ("http://172.31.0.1/", False), ("http://[::1]/", False), ("http://[fd00::1]/", False), ("http://[2606:4700::1]/", True), ("ftp://example.com/", False), ("http://localhost/", False),
)


@query("SELECT url, public FROM (VALUES " + ", ".join(f"('{u}', {str(p).lower()})" for u, p in ADDRESSES) + ") v(url, public) UNION ALL SELECT DISTINCT url, true FROM pages")
def public_addresses(spark, sf):
    urls = spark.createDataFrame([(u,) for u, _ in ADDRESSES], "url string").unionByName(table(spark, sf, "pages").select("url").distinct())
    return urls.select("url", U.is_public_address(F.col("url")).alias("public"))


RULES = ("! a comment", "||ththth.example.net^", "/page=", "@@||m.ththth.example.net/en/2", "|https://thther.", "##.ad", "com/fr/*5|", "#top|$third-party", "/org/de/[0-9]+$/")


@query("SELECT page_id, ((regexp_matches(url, '^[a-z]+://([^/?#]*\\.)?ththth\\.example\\.net([^A-Za-z0-9_.%-]|$)') OR contains(url, '/page=') OR starts_with(url, 'https://thther.') OR regexp_matches(url, 'com/fr/.*5$') OR regexp_matches(url, 'org/de/[0-9]+$')) AND NOT regexp_matches(url, '^[a-z]+://([^/?#]*\\.)?m\\.ththth\\.example\\.net/en/2')) AS is_blocked FROM pages")
def filter_rules(spark, sf):
    return filters.blocked(table(spark, sf, "pages").select("page_id", "url"), spark.createDataFrame([(r,) for r in RULES], "rule string")).select("page_id", "is_blocked")


@query(
    "WITH r AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS host, page_id % 6 AS k FROM pages), "
    "p AS (SELECT page_id, url, regexp_extract(url, '://([^/]+)', 1) AS host, ['script', 'image', 'document'][page_id % 3 + 1] AS kind FROM pages), "
    "q AS (SELECT p.*, lead(host) OVER (ORDER BY page_id) AS page FROM p), "
    "site AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS own, array_to_string(string_split(page, '.')[-2:], '.') AS other FROM q), "
    "hits AS (SELECT page_id, bool_or(k <> 5) AS yes, bool_or(k = 5) AS no FROM site s JOIN r ON s.host = r.host OR ends_with(s.host, '.' || r.host) WHERE CASE k WHEN 0 THEN s.host <> s.page AND own <> other AND page IS NOT NULL "
    "WHEN 1 THEN kind = 'script' WHEN 2 THEN ends_with(url, '#top') WHEN 3 THEN contains(url, '/en/') AND kind <> 'image' WHEN 4 THEN page = 'm.' || r.host OR page = 'blog.tionsh.example.net' ELSE contains(url, 'utm_') END GROUP BY page_id) "
    "SELECT page_id, coalesce(yes AND NOT no, false) AS is_blocked FROM site LEFT JOIN hits USING (page_id)"
)
def filter_requests(spark, sf):
    """Rules of six forms for every host of the pages, asked with the page that asks and the kind of request."""
    pages = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/]+)", 1).alias("host"))
    forms = ("||{}^$third-party", "||{}^$script", "||{}^*#top|", "||{}/en/$~image", "||{}^$domain=m.{}|blog.tionsh.example.net", "@@||{}^*utm_")
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("page_id") % 6 + 1).cast("int"))
    rules = pages.select(F.replace(form, F.lit("{}"), F.col("host")).alias("rule")).distinct()
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.concat(F.lit("https://"), "host", F.lit("/")).alias("page"))  # page_id has no gaps
    kind = F.element_at(F.array(*map(F.lit, ("script", "image", "document"))), (F.col("page_id") % 3 + 1).cast("int")).alias("kind")
    asked = pages.join(after, "page_id", "left").select("page_id", "url", "page", kind)
    return filters.blocked(asked, rules, page="page", kind="kind").select("page_id", "is_blocked")


@query("SELECT page_id, array_to_string(list_slice(l, -2, -1), '.') AS domain FROM (SELECT page_id, string_split(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '.') AS l FROM pages) UNION ALL SELECT * FROM (VALUES (-1, 'b.co.uk'), (-2, NULL), (-3, 'x.y.ck'), (-4, 'www.ck'), (-5, '10.0.0.1')) v(page_id, domain)")
def suffix_domains(spark, sf):
    odd = spark.createDataFrame([(-1, "http://a.b.co.uk/"), (-2, "http://co.uk"), (-3, "http://w.x.y.ck"), (-4, "http://a.www.ck"), (-5, "http://10.0.0.1/")], "page_id bigint, url string")
    rules = spark.createDataFrame([(r,) for r in ("com", "net", "org", "uk", "co.uk", "*.ck", "!www.ck")], "rule string")
    return U.with_registrable_domain(table(spark, sf, "pages").select("page_id", "url").unionByName(odd), rules).select("page_id", "domain")


def _zipped(projects: DataFrame, folder: str) -> int:
    """Writes projects(name, xml, files) as ZIP archives into a shared folder; their number."""

    def each(frames):
        import io
        import zipfile

        import pandas as pd
        from pyarrow import fs

        n = 0
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        for f in frames:
            for name, xml, files in f[["name", "xml", "files"]].itertuples(index=False, name=None):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr(f"/{name}/{name}.aup", xml)
                    for i, file in enumerate(files):
                        z.writestr(f"{name}/{name}_data/d{i % 3}/{file}", file)
                with store.open_output_stream(f"{path}/{name}.zip") as out:
                    out.write(data.getvalue())
                n += 1
        yield pd.DataFrame({"n": [n]})

    return projects.mapInPandas(each, "n bigint").agg(F.sum("n")).first()[0]


@query(
    "WITH t AS (SELECT conv_id, role, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY role) AS track_no, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS clip_no FROM conversations), "
    "b AS (SELECT t.*, b::INT AS block_no FROM t, range(1, 4) AS r(b) WHERE b <= turn % 3 + 1) "
    "SELECT 'c' || conv_id || '.zip' AS archive, track_no, CASE WHEN role = 'system' THEN 'Track_' || track_no ELSE role END AS track, clip_no, turn * 1.5 AS offset, block_no, (block_no - 1) * 1000 AS start, "
    "'b' || turn || '_' || block_no || CASE WHEN turn % 2 = 0 THEN '.au' ELSE '.wav' END AS file, CASE WHEN turn <> 4 THEN length('b' || turn || '_' || block_no) + CASE WHEN turn % 2 = 0 THEN 3 ELSE 4 END END AS size, "
    "NULL::VARCHAR AS error FROM b UNION ALL SELECT 'x' || conv_id || '.zip', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'File is not a zip file' FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 = 3)"
)
def audio_project_blocks(spark, sf):
    """Each conversation as an audio project of a track a role and a clip a turn, zipped, and read again by the data source; some archives are none."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    file = lambda i: F.concat(F.lit("b"), "turn", F.lit("_"), i.cast("string"), F.when(F.col("turn") % 2 == 0, ".au").otherwise(".wav"))
    numbers = F.sequence(F.lit(1), F.col("turn") % 3 + 1)
    block = lambda i: F.format_string('<b:waveblock start="%d"><b:%s/></b:waveblock>', (i - 1) * 1000, F.when(F.col("turn") % 2 == 0, F.format_string('simpleblockfile filename="%s"', file(i))).otherwise(F.format_string('pcmaliasblockfile aliasfile="/old/place/%s"', file(i))))
    clip = F.format_string('<b:waveclip offset="%s">%s</b:waveclip>', F.col("turn") * 1.5, F.array_join(F.transform(F.reverse(numbers), block), ""))
    clips = turns.select("conv_id", "role", "turn", clip.alias("clip"), F.when(F.col("turn") != 4, F.transform(numbers, file)).alias("files"))
    tracks = clips.groupBy("conv_id", "role").agg(F.reverse(F.sort_array(F.collect_list(F.struct("turn", "clip")))).alias("c"), F.flatten(F.collect_list("files")).alias("files"))
    track = F.format_string("<b:wavetrack%s>%s</b:wavetrack>", F.when(F.col("role") == "system", "").otherwise(F.format_string(' name="%s"', "role")), F.array_join("c.clip", ""))
    whole = tracks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("role", track.alias("track")))).alias("t"), F.flatten(F.collect_list("files")).alias("files"))
    xml = F.format_string('<?xml version="1.0"?><b:project xmlns:b="http://audio.example/xml/" rate="44100.0">%s</b:project>', F.array_join("t.track", ""))
    folder = _shared(spark)
    _zipped(whole.select(F.format_string("c%d", "conv_id").alias("name"), xml.alias("xml"), "files"), f"{folder}/projects")
    # files of one folder, as a folder for each would be listed one after the other
    _written_files(turns.where("conv_id % 10 = 3").select("conv_id").distinct().select(F.format_string("none/name=x%d", "conv_id").alias("name"), F.lit("no archive").alias("text")), folder)
    projects.register(spark)
    good = spark.read.format("audio_project").load(f"{folder}/projects")
    # what is no archive: text files, taken as archives by their names
    bad = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/none")
    failed = files.archive_entries(bad.select(F.concat(F.regexp_extract("path", "name=([^/]+)", 1), F.lit(".zip")).alias("path"), "content"), 1 << 20).select(F.col("path").alias("archive"), "error")
    columns = ["archive", "track_no", "track", "clip_no", "offset", "block_no", "start", "file", "size", "error"]
    return good.select(*columns).unionByName(failed, allowMissingColumns=True).select(*columns)


@query()
def bounded_cache_hits(spark, sf):
    """Events as look-ups of users in a cache of 50 for each type of event, which live for a day."""
    return cache.hits(table(spark, sf, "events"), "event_type", "user_id", "ts", 86_400, 50).select("cache", "key", "tie", "hit")


@query()
def stream_bounded_cache(spark, sf):
    """The same of the events as a stream, as far as the watermark has come."""
    folder = _shared(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        answered = cache.stream_hits(windows.watermarked(_event_stream(spark, sf)), "event_type", "user_id", "ts", 86_400, 50)
        answered.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(cache.RESULT).parquet(f"{folder}/out").select("cache", "key", "tie", "hit")


def _written_files(rows: DataFrame, folder: str) -> int:
    """Writes rows(name, text) as files into a shared folder; their number."""

    def each(frames):
        import pandas as pd
        from pyarrow import fs

        n, made = 0, set()
        store, path = fs.FileSystem.from_uri(folder)
        for f in frames:
            for name, text in f[["name", "text"]].itertuples(index=False, name=None):
                if (inner := name.rpartition("/")[0]) not in made:
                    store.create_dir(f"{path}/{inner}")
                    made.add(inner)
                with store.open_output_stream(f"{path}/{name}") as out:
                    out.write((text or "").encode())
                n += 1
        yield pd.DataFrame({"n": [n]})

    return rows.mapInPandas(each, "n bigint").agg(F.sum("n")).first()[0]


@query(
    "SELECT source || '/' || doc_id || '.md' AS key, (CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END)::BIGINT AS versions, md5(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' again' ELSE '' END) AS last_md5, "
    "strlen(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' again' ELSE '' END)::BIGINT AS last_length FROM documents"
)
def poll_versions(spark, sf):
    """Documents as files, polled three times: all, then every seventh changed, then none."""
    folder = _shared(spark)
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for changed in (docs, docs.where("doc_id % 7 = 0").withColumn("text", F.concat("text", F.lit(" again"))), docs.limit(0)):
            _written_files(changed.select("name", "text"), f"{folder}/in")  # by the tasks that read them, as a shuffle would hold all texts on disk again
            files = polling.accepted(spark, f"{folder}/in", listings=f"{folder}/listings")
            each = lambda rows, batch: polling.with_content(rows).select("key", "modified", "length", F.md5("content").alias("md5"), "error").write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
            files.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.schema("key string, modified bigint, length bigint, md5 string, error string").parquet(f"{folder}/out")
    return got.groupBy("key").agg(F.count("*").alias("versions"), F.max_by("md5", "modified").alias("last_md5"), F.max_by("length", "modified").alias("last_length"))


def _vector_store(spark, sf) -> VectorStore:
    """The embeddings, whole and their first 32 components, in a fresh store, by label; label 3 was replaced afterwards by its opposite vectors, label 5 removed."""
    store = VectorStore(spark, f"{_shared(spark)}/vectors", "label", id="vec_id")
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    store.replace(rows.unionByName(rows.withColumn("embedding", F.slice("embedding", 1, 32))))
    store.replace(rows.where("label = 3").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    store.remove([5])
    return store


@query(
    "SELECT vec_id, label, round(CAST(e[1] AS DOUBLE), 6) AS first, len(e)::INT AS size FROM (SELECT vec_id, label, CASE WHEN label = 3 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS e FROM embeddings WHERE label <> 5 UNION ALL "
    "SELECT vec_id, label, embedding[1:32] FROM embeddings WHERE label <> 5)"
)
def vector_store_rows(spark, sf):
    return _vector_store(spark, sf).all().select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.size("embedding").alias("size"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings WHERE label IN (3, 7)")
def vector_store_read(spark, sf):
    """One collection's vectors of two sources: one partition of the dimension's is read for each."""
    found = _vector_store(spark, sf).read(32, [3, 7])
    return found.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"SELECT DISTINCT 'vectors-' || size AS name, size, 'cosine' AS metric FROM {MODELS_SQL} WHERE size > 0 AND size NOT IN (SELECT DISTINCT len(embedding) FROM embeddings)")
def vector_collections_missing(spark, sf):
    """Collections that the models need and the store of the embeddings doesn't have."""
    store = VectorStore(spark, f"{_shared(spark)}/vectors", "label", id="vec_id")
    store.replace(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"))
    wanted = _models(spark).where("size > 0").select(F.concat(F.lit("vectors-"), F.col("size").cast("string")).alias("name"), "size", F.lit("cosine").alias("metric")).distinct()
    return store.missing(wanted)


def cascade_tiers() -> list[Tier]:
    """Six tiers that differ in what they can read, meet challenges and take time, by page_id."""
    i = F.col("page_id")
    if_ = lambda ok, text: (lambda page: F.when(page.isNotNull() & ok, text(page)))
    return [
        Tier("1-patterns", if_(i % 4 == 0, web.plain_text), challenged=i % 7 == 2, seconds=(i % 4) * 20.0),
        Tier("2-parser", lambda page: web.parsed(F.when(i % 4 == 1, page)), seconds=25.0),
        Tier("3-title", if_(F.lit(True), web.title), seconds=30.0),
        Tier("4-stealth", if_(i % 3 == 0, web.plain_text), challenged=i % 11 == 5, person=i % 13 == 4, seconds=10.0),
        Tier("5-adaptive", lambda page: web.parsed(F.when(i % 5 == 1, page)), seconds=5.0),
        Tier("6-person", if_(i % 2 == 0, web.plain_text), challenged=i % 17 == 3, person=i % 5 == 0),
    ]


@query()
def cascade_trace(spark, sf):
    """What each tier of a cascade made of each page, heavy ones from the fourth on."""
    ship(spark)
    out = cascade(_pages(spark, sf), cascade_tiers(), heavy=F.col("page_id") % 9 == 1, seconds=60.0)
    return out.select("page_id", "mode", "reason", F.array_join("trace", " ").alias("trace"), F.length("made").alias("n_chars"))


@query(
    "SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'whole ' || conv_id ELSE 'top' || chr(10) || string_agg(role || chr(10) || 'a \"text\": in a string' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) END AS text "
    "FROM conversations GROUP BY conv_id"
)
def document_walk(spark, sf):
    """Conversations as parsed documents: nested, `text` after what is below it, and in strings that look like members."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    below = F.struct(F.struct(F.lit("x").alias("label"), F.lit('a "text": in a string').alias("text")).alias("zone"), F.struct(F.array(F.struct(F.col("text"))).alias("deeper"), F.lit(7).alias("text")).alias("area"))
    node = F.struct(below.alias("children"), F.lit('{"text": "no"}').alias("label"), F.col("role").alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", node.alias("node")))).alias("n"))
    part = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("whole "), F.col("conv_id").cast("string"))).otherwise(" ")
    payload = F.to_json(F.struct(F.col("n.node").alias("pages"), F.struct(part.alias("md_content")).alias("document"), F.lit("top").alias("text")))
    return whole.select("conv_id", files.document_text(payload).alias("text"))


def _tool(spark, sf, sql: str, *names: str) -> DataFrame:
    """A query over some tables that calls the tools."""
    tools.register(spark)
    for name in names:
        table(spark, sf, name).createOrReplaceTempView(f"tessera_{name}")
    return spark.sql(sql)


@query(
    "SELECT city, event_id, round(temperature * 9 / 5 + 32, 6) AS temperature, 'fahrenheit' AS unit FROM (SELECT user_id AS city, event_id, value AS temperature, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"
)
def tool_weather_current(spark, sf):
    return _tool(spark, sf, "SELECT city, event_id, round(temperature, 6) AS temperature, unit FROM weather_current(TABLE(SELECT user_id AS city, event_id, ts AS time, value AS temperature FROM tessera_events), place => 'city', unit => 'Fahrenheit')", "events")


@query(
    "SELECT city, CAST(day AS VARCHAR) AS day, temperature_max, 'celsius' AS unit FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY day) AS r FROM (SELECT user_id AS city, CAST(ts AS DATE) AS day, max(value) AS temperature_max FROM events GROUP BY ALL)) WHERE r <= 3"
)
def tool_weather_forecast(spark, sf):
    daily = "SELECT user_id AS city, CAST(ts AS DATE) AS day, max(value) AS temperature_max FROM tessera_events GROUP BY user_id, CAST(ts AS DATE)"
    return _tool(spark, sf, f"SELECT city, CAST(day AS STRING) AS day, temperature_max, unit FROM weather_forecast(observations => TABLE({daily}), place => 'city', time => 'day', days => 3)", "events")


@query("SELECT user_id AS city, event_id, value AS reading FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-03'")
def tool_weather_historical(spark, sf):
    return _tool(spark, sf, "SELECT city, event_id, reading FROM weather_historical(TABLE(SELECT user_id AS city, event_id, ts, value AS reading FROM tessera_events), '2024-01-03', place => 'city', time => 'ts')", "events")


@query(
    "SELECT query, name, CAST(rank AS INT) AS rank FROM (SELECT n_name AS query, c_name AS name, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rank <= 4"
)
def tool_geocode(spark, sf):
    places = "SELECT n_name AS query, c_custkey AS pos, c_name AS name FROM tessera_customer JOIN tessera_nation ON c_nationkey = n_nationkey"
    return _tool(spark, sf, f"SELECT query, name, rank FROM weather_geocode(TABLE({places}), limit => 4)", "customer", "nation")


@query(f"WITH q AS (SELECT * FROM embeddings WHERE vec_id = 0) SELECT e.vec_id, e.label, {COSINE_SQL} AS score FROM embeddings e, q WHERE e.label = 3 ORDER BY score DESC, lpad(CAST(e.vec_id AS VARCHAR), 12, '0') LIMIT 7")
def tool_memory_search(spark, sf):
    vector = ", ".join(f"{float(x)!r}D" for x in _vector(spark, sf))
    items = "SELECT vec_id, lpad(vec_id, 12, '0') AS id, label, embedding FROM tessera_embeddings"
    return _tool(spark, sf, f"SELECT vec_id, label, score FROM memory_search(TABLE({items}), vector => array({vector}), user_id => 3, user => 'label', limit => 7)", "embeddings")


@query(
    "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'default' ELSE role END AS user_id, CASE WHEN NOT regexp_matches(coalesce(text, ''), '\\S') THEN 'text must not be blank' WHEN length(text) > 32768 THEN 'text must be at most 32768 characters' END AS error "
    "FROM conversations WHERE role <> 'assistant' AND conv_id <> 5"
)
def tool_memory_edits(spark, sf):
    """Items inserted, one removed, one user's wiped."""
    items = "SELECT conv_id, turn, nullif(role, 'system') AS user_id, text FROM tessera_conversations"
    return _tool(spark, sf, f"SELECT conv_id, turn, user_id, error FROM memory_insert(TABLE(SELECT * FROM memory_delete(TABLE(SELECT * FROM memory_wipe(TABLE({items}), user_id => 'assistant')), 5L, id => 'conv_id')))", "conversations")


@query(
    "SELECT conv_id, 'pl' AS language, CAST(CASE WHEN conv_id % 9 <> 0 THEN turn + 1 END AS INT) AS page_number, CAST(CASE WHEN conv_id % 9 <> 0 THEN l END AS INT) AS line_no, CASE WHEN conv_id % 9 <> 0 THEN CASE l WHEN 1 THEN role ELSE text END END AS text, "
    "CASE WHEN conv_id % 9 <> 0 AND l = 1 THEN 0.5 END AS confidence, CASE WHEN conv_id % 9 = 0 THEN 'unreadable payload: JSONDecodeError' END AS error FROM conversations, range(1, 3) AS r(l) WHERE conv_id % 9 <> 0 OR l = 1"
)
def tool_ocr_lines(spark, sf):
    line = "array(named_struct('text', role, 'confidence', 0.5D), named_struct('text', text, 'confidence', CAST(NULL AS DOUBLE)))"
    payloads = f"SELECT conv_id, CASE WHEN conv_id % 9 = 0 THEN '{{broken' ELSE to_json(named_struct('pages', array(named_struct('page_number', turn + 1, 'lines', {line})))) END AS scan FROM tessera_conversations"
    return _tool(spark, sf, f"SELECT conv_id, language, page_number, line_no, text, confidence, error FROM ocr_lines(TABLE({payloads}), payload => 'scan', lang => 'pl')", "conversations")


@query(
    f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {COSINE_SQL} AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 10 = 1 AND e.vec_id <> q.vec_id), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT * FROM r WHERE rank <= 4"
)
def vector_topk_pivots(spark, sf):
    """The best of all vectors for every tenth one, by blocks around pivots."""
    vectors = table(spark, sf, "embeddings")
    return nearest.topk(vectors, vectors.where("vec_id % 10 = 1"), 4)


@query(
    "SELECT doc_id, mime, CASE WHEN mime IS NULL THEN 'unrecognised file signature' WHEN mime NOT IN ('image/png', 'application/pdf') THEN 'type not allowed' END AS error FROM (SELECT doc_id, list_extract(["
    + ", ".join(repr(m) if m else "NULL" for _, m in HEADS) + "], (doc_id % 8 + 1)::INT) AS mime FROM documents)"
)
def accepted_documents(spark, sf):
    """Documents behind the signature of a type of file each."""
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h, _ in HEADS]), (F.col("doc_id") % 8 + 1).cast("int")))
    rows = table(spark, sf, "documents").select("doc_id", F.concat(head, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))
    return ingest.accept(rows, ["image/png", "application/pdf"]).select("doc_id", "mime", "error")


@query(
    "SELECT conv_id * 1000 + turn AS id, CASE turn % 3 WHEN 0 THEN '[\"' || role || '\",\"turn ' || turn || '\"]' WHEN 1 THEN '[\"likes [brackets] ' || conv_id || '\"]' ELSE '[]' END AS facts FROM conversations"
)
def conversation_facts(spark, sf):
    """Facts in what a model might say of each turn: prose around an array, brackets in strings, an array of arrays."""
    n = F.col("turn").cast("string")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('Notes "x [": ["'), "role", F.lit('", "turn '), n, F.lit('"] done'))).when(F.col("turn") % 3 == 1, F.concat(F.lit('```json\n["likes [brackets] '), F.col("conv_id").cast("string"), F.lit('"]\n```'))).otherwise(F.lit('so ["a"] and then [["nested"], ["x"]]'))
    return memory.extract_facts(table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), said.alias("response"))).select("id", F.to_json("facts").alias("facts"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a prompt's context for each source, out of the documents most like a query by their embedding."""
    docs = providers.embed(table(spark, sf, "documents").select("doc_id", "source", "text"))
    asked = docs.where("doc_id = 0").select("embedding").first()[0]
    scored = retrieval.vector_topk(docs, asked, 200, None, "doc_id").withColumnRenamed("doc_id", "id")
    found = docs.join(scored, docs.doc_id == scored.id).select("source", "score", "text", "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.col("score").desc(), "doc_id")))
    return prompt.contexts(ranked, "source", Retrieval(threshold=0.2))
