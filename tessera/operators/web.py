"""Web pages: text, links, classes, quality and the cascade of extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import PageGate
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators.cascade import Tier, cascade
from tessera.session import ship

#: Elements whose content is noise.
NOISE = ("script", "style", "nav", "footer", "iframe")
#: Signs of a blocked page and of a login wall.
SCRIPT_SIGNATURES = ("arkoselabs.com", "recaptcha/api.js", "hcaptcha.com/1/api.js", "datadome.co/tags.js", "perimeterx.net")
STRICT_PHRASES = ("Prove your humanity", "Pardon Our Interruption", "Please verify you are a human", "Checking if the site connection is secure", "Just a moment...", "Attention Required!")
CHALLENGE_MARKS = ("cf-turnstile", "cf_clearance")
RAY_ID = r"(?i)Ray ID: \w+"
LOGIN_TITLES = ("sign in", "log in", "login", "sign into", "create account")
SKIPPED_LINKS = ("#", "mailto:", "tel:", "javascript:")


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def raw_links(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, link_no, href: the href of each anchor as it stands, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(page_id, F.posexplode(found).alias("link_no", "href")).withColumn("link_no", F.col("link_no") + 1)


def plain_text(html: Column) -> Column:
    """Without noise elements and tags, white space as one space; by patterns, so nested noise of one name ends early."""
    out = html
    for name in NOISE:
        out = F.regexp_replace(out, rf"(?is)<{name}\b.*?</{name}\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(to))
    return T.strip(F.regexp_replace(out, r"\s+", " "))


class _Reader(HTMLParser):
    """Collects text outside noise elements, and anchors."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.noise: list[str] = []
        self.pieces: list[str] = []
        self.anchor: str | None = None
        self.start = 0
        self.anchors: list[tuple[str, int, int]] = []  # href and the pieces within

    def handle_starttag(self, tag, attrs):
        if tag in NOISE:
            self.noise.append(tag)
        elif tag == "a" and not self.noise:
            self._end_anchor()
            href = dict(attrs).get("href")
            if href is not None:
                self.anchor, self.start = href, len(self.pieces)

    def handle_endtag(self, tag):
        if tag in self.noise:
            while self.noise.pop() != tag:
                pass
        elif tag == "a":
            self._end_anchor()

    def _end_anchor(self):
        if self.anchor is not None:
            self.anchors.append((self.anchor, self.start, len(self.pieces)))
            self.anchor = None

    def handle_data(self, data):
        if not self.noise and data.strip():
            self.pieces.append(data.strip())


def _read(html: str | None) -> _Reader:
    reader = _Reader()
    try:
        reader.feed(html or "")
        reader.close()
    except (AssertionError, ValueError):  # what was read before a malformed declaration stays
        pass
    reader._end_anchor()
    return reader


def text_of(html: str | None) -> str:
    return " ".join(_read(html).pieces)


def resolved(href: str, base: str) -> str:
    """The absolute address, or nothing for one that leads to no page."""
    if not href or href.startswith(SKIPPED_LINKS):
        return ""
    try:
        absolute = urljoin(base, href)
        return absolute if urlparse(absolute).scheme in ("http", "https") else ""
    except ValueError:
        return ""


def annotated(html: str | None, base: str, part: str | None = None) -> tuple[str, list[str]]:
    """The text with [n] after the n-th kept link, and the links. part: what an address must contain to be kept."""
    reader, links = _read(html), []
    pieces: list[str | None] = [*reader.pieces]
    for href, a, b in reader.anchors:
        url = resolved(href, base or "")
        if not url or (part and part not in url):
            continue
        links.append(url)
        mark = f"{''.join(x or '' for x in pieces[a:b])} [{len(links)}]"
        if b > a:
            pieces[a:b] = [mark] + [None] * (b - a - 1)
        else:
            pieces.insert(a, mark.strip())
            reader.anchors = [(h, x + (x >= a), y + (y >= a)) for h, x, y in reader.anchors]
    return " ".join(x for x in pieces if x), links


def html_to_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([text_of(x) for x in s], dtype=object)

    return pages.withColumn(into, each.asNondeterministic()(F.col(html)))


def page_links(pages: DataFrame, part: str | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """`pages` with annotated (text with markers) and links (number to address)."""

    ship(pages.sparkSession)

    @F.pandas_udf("struct<annotated: string, links: array<string>>")
    def each(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for h, u in parts:
            rows = [annotated(x, y or "", part) for x, y in zip(h, u, strict=True)]
            yield pd.DataFrame({"annotated": [r[0] for r in rows], "links": [r[1] for r in rows]})

    out = pages.withColumn("_read", each.asNondeterministic()(F.col(html), F.col(url)))
    numbers = F.transform(F.col("_read.links"), lambda x, i: F.struct((i + 1).alias("key"), x.alias("value")))
    return out.withColumns({"annotated": F.col("_read.annotated"), "links": F.map_from_entries(numbers)}).drop("_read")


def is_blocked(html: Column, status: Column, config: PageGate = PageGate()) -> Column:
    """Whether a page is a challenge: an empty one by its status, a short one by its signs."""
    signs = html.rlike(RAY_ID)
    for s in (*SCRIPT_SIGNATURES, *STRICT_PHRASES, *CHALLENGE_MARKS):
        signs = signs | F.contains(html, F.lit(s))
    empty = html.isNull() | (html == "")
    return F.when(empty, F.coalesce(status.isin(403, 429, 503), F.lit(False))).when(F.length(html) > config.challenge_chars, False).otherwise(signs)


def is_login_wall(html: Column, config: PageGate = PageGate()) -> Column:
    titles = F.regexp_extract_all(html, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(1))

    def login(t: Column) -> Column:
        out = F.lit(False)
        for p in LOGIN_TITLES:
            out = out | F.contains(F.lower(t), F.lit(p))
        return out

    return F.coalesce((F.length(html) <= config.challenge_chars) & F.exists(titles, login), F.lit(False))


def challenge(html: Column, status: Column) -> Column:
    return F.when(is_blocked(html, status), "blocked").when(is_login_wall(html), "login").otherwise("none")


def read(pages: DataFrame, tiers: list[tuple[str, Column | Callable[[Column], Column]]], url: str = "url", html: str = "html", status: Column | None = None, spent: Column | None = None, seconds: float = 90.0) -> DataFrame:
    """`pages` with content, mode and reason: the first tier's text that passes the quality gate.

    A tier is a column, or a function from the page to one, such as a Python reader: it is given null for a page that an earlier tier has read,
    so it works only on what is left. A login redirect or a challenge needs a person and gives the reason human_intervention; a page that no tier reads
    all_tiers_failed, or budget_exhausted if it has `spent` more than `seconds`, which leaves it to the first tier alone.
    """
    blocked = U.is_login_redirect(F.col(url)) | (challenge(F.col(html), status if status is not None else F.lit(200)) != "none")
    late = F.coalesce(spent > seconds, F.lit(False)) if spent is not None else F.lit(False)
    out = pages.withColumns({"_blocked": F.coalesce(blocked, F.lit(False)), "_late": late, "_read": F.lit(None).cast("struct<content: string, mode: string>")})
    for i, (name, tier) in enumerate(tiers):
        open_ = F.col("_read").isNull() & ~F.col("_blocked") & (~F.col("_late") if i else F.lit(True))
        made = tier(F.when(open_, F.col(html))) if callable(tier) and not isinstance(tier, Column) else F.when(open_, tier)
        out = out.withColumn("_text", made)
        good = F.struct(F.col("_text").alias("content"), F.lit(name).alias("mode"))
        out = out.withColumn("_read", F.coalesce(F.col("_read"), F.when(open_ & (T.quality_gate(F.col("_text")) == "ok"), good))).drop("_text")
    failed = F.when(F.col("_late"), "budget_exhausted").otherwise("all_tiers_failed")
    reason = F.when(F.col("_blocked"), "human_intervention").when(F.col("_read").isNull(), failed)
    return out.withColumns({"content": F.col("_read.content"), "mode": F.col("_read.mode"), "reason": reason}).drop("_read", "_blocked", "_late")


def parsed(html: Column) -> Column:
    """text_of() as a tier; null for null."""

    @F.pandas_udf("string")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([None if x is None else text_of(x) for x in s], dtype=object)

    return each.asNondeterministic()(html)


def annotated_read(html: Column, url: Column, part: str | None = None) -> Column:
    """A struct of text (with link markers) and links of a page; null for null, which isn't parsed."""

    @F.pandas_udf("struct<text: string, links: array<string>>")
    def each(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for h, u in parts:
            rows = [(None, None) if x is None else annotated(x, y or "", part) for x, y in zip(h, u, strict=True)]
            yield pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object), "links": pd.Series([r[1] for r in rows], dtype=object)})

    return each.asNondeterministic()(html, url)


def read_links(pages: DataFrame, part: str | None = None, url: str = "url", html: str = "html", status: Column | None = None) -> DataFrame:
    """`pages` with annotated, links, mode and reason: the cascade of read() on texts with link markers. The first tier takes pages without
    anchors by patterns; only what it leaves open is parsed. What the gate refuses has no links."""
    ship(pages.sparkSession)
    none = F.array().cast("array<string>")
    plain = lambda page: F.when(~page.rlike(r"(?i)<a\s"), F.struct(plain_text(page).alias("text"), none.alias("links")))
    wall = challenge(F.col(html), status if status is not None else F.lit(200)) != "none"
    tiers = [Tier("patterns", plain, person=wall), Tier("parser", lambda page: annotated_read(page, F.col(url), part))]
    # a login redirect goes to a person at once: the last tier here is none, so it isn't asked of these
    login = F.coalesce(U.is_login_redirect(F.col(url)), F.lit(False))
    out = cascade(pages.withColumn("_page", F.when(~login, F.col(html))), [*tiers, Tier("person", lambda page: F.when(page.isNull(), F.lit(None).cast("struct<text: string, links: array<string>>")), person=login)], url, "_page", struct=True)
    numbers = F.transform(F.col("made.links"), lambda x, i: F.struct((i + 1).alias("key"), x.alias("value")))
    return out.withColumns({"annotated": F.col("made.text"), "links": F.map_from_entries(numbers)}).drop("made", "trace", "_page")


class _Results(HTMLParser):
    """article.result: the first h3 a, and p.content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict[str, str]] = []
        self.path: list[tuple[str, frozenset[str]]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "article" and "result" in (a.get("class") or "").split():
            self.rows.append({"title": "", "url": "", "content": ""})
        names = [n for n, _ in self.path]
        if tag == "a" and self.rows and "h3" in names and "article" in names and not self.rows[-1]["url"]:
            self.rows[-1]["url"] = a.get("href") or ""
        if tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.path.append((tag, frozenset((a.get("class") or "").split())))

    def handle_endtag(self, tag):
        if any(n == tag for n, _ in self.path):
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        names = [n for n, _ in self.path]
        if self.rows and "article" in names and data.strip():
            if "a" in names and "h3" in names:
                self.rows[-1]["title"] = f"{self.rows[-1]['title']} {data.strip()}".strip()
            elif any(n == "p" and "content" in c for n, c in self.path):
                self.rows[-1]["content"] = f"{self.rows[-1]['content']} {data.strip()}".strip()


def search_results(html: str | None, limit: int) -> list[dict[str, str]]:
    """title, url, content of at most `limit` results; those without a linked title don't count."""
    parser = _Results()
    parser.feed(html or "")
    return [r for r in parser.rows if r["title"] and r["url"]][:limit]


def parse_search(pages: DataFrame, limit: int = 10, html: str = "html") -> DataFrame:
    """A row with rank, title, url and content for each result of each page of results."""

    ship(pages.sparkSession)

    @F.pandas_udf("array<struct<title: string, url: string, content: string>>")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([search_results(x, limit) for x in s], dtype=object)

    others = [c for c in pages.columns if c not in (html, "title", "url", "content")]
    rows = pages.select(*others, F.posexplode(each.asNondeterministic()(F.col(html))).alias("_at", "_r"))
    return rows.select(*others, (F.col("_at") + 1).alias("rank"), "_r.title", "_r.url", "_r.content")
