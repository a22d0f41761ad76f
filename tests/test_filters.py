"""Filter lists against a matcher that walks a pattern by hand."""

from __future__ import annotations

import random
import re

from tessera.operators import filters

WORDS = ["ads", "track", "pixel", "shop", "news", "a1", "banner", "x"]
HOSTS = ["ads.example.com", "example.com", "cdn.track.net", "news.org", "a1.shop.co.uk", "shop.co.uk", "b.news.org"]


def walk(pattern: str, text: str, at: int) -> bool:
    """Whether pattern (* anything, ^ a separator or the end, a last $ the end) matches text at a place."""
    if not pattern:
        return True
    c, rest = pattern[0], pattern[1:]
    if c == "*":
        return any(walk(rest, text, i) for i in range(at, len(text) + 1))
    if c == "\0":
        return at == len(text)
    if c == "^":
        return (at == len(text) and walk(rest, text, at)) or (at < len(text) and not re.match(r"[A-Za-z0-9_.%-]", text[at]) and walk(rest, text, at + 1))
    return at < len(text) and text[at] == c and walk(rest, text, at + 1)


def matches(rule: str, url: str, page: str | None, kind: str | None) -> bool:
    body, _, options = rule.removeprefix("@@").partition("$") if "$" in rule and not rule.endswith("/") else (rule.removeprefix("@@"), "", "")
    names = [o for o in options.split(",") if o]
    site = lambda h: ".".join(h.split(".")[-3 if h.endswith("co.uk") else -2 :])
    host = url.split("/")[2]
    kinds = [o for o in names if o.lstrip("~") in filters.KINDS]
    for o in names:
        if o.endswith("third-party"):
            if page is None or (site(page) != site(host)) == o.startswith("~"):
                return False
        elif o.startswith("domain="):
            of = o[7:].split("|")
            inside = lambda d: page == d or page.endswith("." + d)
            good, bad = [d for d in of if d[0] != "~"], [d[1:] for d in of if d[0] == "~"]
            if page is None or (good and not any(map(inside, good))) or any(map(inside, bad)):
                return False
        elif o not in kinds and o != "match-case":
            return False
    if kinds:
        good, bad = [k for k in kinds if k[0] != "~"], [k[1:] for k in kinds if k[0] == "~"]
        if kind is None or (good and kind not in good) or kind in bad:
            return False
    if body.startswith("/") and body.endswith("/") and len(body) > 2:
        return re.search(body[1:-1], url, re.I) is not None
    if "match-case" not in names:
        body, url = body.lower(), url.lower()
    if body.endswith("|"):
        body = body[:-1] + "\0"
    if body.startswith("||"):
        begin = url.index("//") + 2
        end = begin + len(host)
        return any(walk(body[2:], url, i) for i in range(begin, end) if i == begin or url[i - 1] == ".")
    if body.startswith("|"):
        return walk(body[1:], url, 0)
    return any(walk(body, url, i) for i in range(len(url) + 1))


def golden(seed: int = 4):
    r = random.Random(seed)
    rules = []
    for _ in range(220):
        w = r.choice(WORDS)
        body = r.choice([f"||{r.choice(HOSTS)}^", f"/{w}/", f"{w}*{r.choice(WORDS)}", f"|https://{r.choice(HOSTS)}/", f"{w}.js|", f"?{w}=", f"^{w}^", f"||{r.choice(HOSTS)}/{w}", f"/{w}[0-9]+/", "*&", f"-{w}.", f"{w.upper()}"])
        body = body if not (body.startswith("/") and body.endswith("/") and "[" not in body) else body + "*"
        options = [r.choice(["third-party", "~third-party", "script", "~image", f"domain={r.choice(HOSTS)}", f"domain=~{r.choice(HOSTS)}|example.com", "match-case", "redirect=noop"]) for _ in range(r.choice([0, 0, 0, 1, 2]))]
        options = list(dict.fromkeys(options))
        if sum(o.startswith("domain=") for o in options) > 1 or {"third-party", "~third-party"} <= {*options}:
            options = []
        rules.append(("@@" if r.random() < 0.15 else "") + body + ("$" + ",".join(options) if options and not body.endswith("/") else ""))
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(HOSTS)}/{r.choice(WORDS)}{r.choice(['', '/', '.js', '-'])}{r.choice([*WORDS, 'Banner', 'ADS'])}{r.choice(['', '.js', '?ads=1&x', '/a1', '?q', '7'])}" for _ in range(300)]
    asks = [(i, u, r.choice([None, *HOSTS]), r.choice([None, "script", "image", "document"])) for i, u in enumerate(urls)]
    return rules, asks


def test_golden_list(spark):
    rules, asks = golden()
    for size in (8, 40, 220):
        some = rules[:size]
        want = {i: any(matches(x, u, p, k) for x in some if x[:2] != "@@") and not any(matches(x, u, p, k) for x in some if x[:2] == "@@") for i, u, p, k in asks}
        assert size == 220 or 0 < sum(want.values()) < len(want)
        df = spark.createDataFrame([(i, u, p and f"https://{p}/", k) for i, u, p, k in asks], "id int, url string, page string, kind string")
        list_ = spark.createDataFrame([(x,) for x in [*some, "! a comment", "", "[Adblock Plus]", "a.com##.ad"]], "rule string")
        assert {r["id"]: r["is_blocked"] for r in filters.blocked(df, list_, page="page", kind="kind").collect()} == want
        alone = {i: any(matches(x, u, None, None) for x in some if x[:2] != "@@") and not any(matches(x, u, None, None) for x in some if x[:2] == "@@") for i, u, _, _ in asks}
        assert {r["id"]: r["is_blocked"] for r in filters.blocked(df, list_).collect()} == alone


def test_a_rule_that_asks_for_more_does_not_block_by_url_alone(spark):
    urls = spark.createDataFrame([("http://a.com/#top", 1), ("http://a.com/#top", 2), (None, 3)], "url string, is_blocked int")
    ask = lambda *rules: [r["is_blocked"] for r in filters.blocked(urls, spark.createDataFrame([(x,) for x in rules], "rule string")).collect()]
    assert ask("#top|$third-party") == [False] * 3 and sorted(ask("#top|$match-case")) == [False, True, True]
    assert ask("#top|", "@@a.com$domain=b.com") == ask("#top|") and not any(ask("#top|", "@@/[A]\\.com/"))
    assert len(ask("#zzz")) == 3


def test_index_takes_the_rarest_run(spark):
    """Of 3,000 rules on similar hosts, no key leads to more than a few; only those without letters in a row have none."""
    rules = spark.createDataFrame([(f"||www.host{i}.example.com^",) for i in range(3000)] + [("https://www.",), ("^a^",), ("/[0-9]{4}/",)], "rule string")
    keys = filters.indexed(filters.parsed(rules)).groupBy("key").count().collect()
    assert max(r["count"] for r in keys) <= 20 and [r["count"] for r in keys if r["key"] is None] == [2]
    urls = spark.createDataFrame([(f"https://www.host{i}.example.com/",) for i in range(0, 6000, 500)], "url string")
    assert filters.blocked(urls, rules.where("rule not in ('https://www.', '/[0-9]{4}/')")).where("is_blocked").count() == 6
