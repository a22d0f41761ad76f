"""Filter lists: which requests a list of address rules blocks.

A rule is an address pattern or a `/regular expression/`, after `@@` an exception, and may end in `$options`. Options are predicates on the
request: `third-party`, `domain=`, kinds such as `script`, each with `~` for the opposite. A rule applies only to requests that have what
its options ask for, so a list that is asked by URL alone uses the rules without options (`match-case` asks for nothing); rules with options that
are none of these never apply.

Rules are found by an index: of the letters that a URL must have for a pattern to match, the run of five (three in short ones) that the
fewest rules have. A URL meets the rules of its own runs in an equi-join, so a list may be of any size, and common letters such as `https` or
`.com` lead to those rules only that have no others. Rules without three letters in a row, and regular expressions, are few in any
list; they are tried on every URL, KEYLESS at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions.expr import let

#: Characters that end a part of a URL; `^` in a rule stands for one, or for the end.
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|$)"
#: What a host anchor stands for.
HOST_ANCHOR = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
#: The kinds of requests that options name.
KINDS = ("document", "font", "image", "media", "object", "other", "ping", "popup", "script", "stylesheet", "subdocument", "websocket", "xmlhttprequest")
OPTIONS = r"\$(~?[A-Za-z][A-Za-z0-9_-]*(?:=[^,$]*)?(?:,~?[A-Za-z][A-Za-z0-9_-]*(?:=[^,$]*)?)*)$"
#: Letters of a key, for rules with a run so long, and for the others.
LONG, SHORT = 5, 3
#: Rules up to which the index is broadcast; rules without a key that are tried at a time.
BROADCAST_RULES, KEYLESS = 200_000, 1_000


def _pattern(address: Column, case: Column) -> Column:
    """A regular expression for a rule's address: `||` is the beginning of a host's label, `|` an end of the URL, `*` anything, `^` a separator."""
    host, start, end = address.startswith("||"), address.startswith("|"), address.endswith("|")
    core = F.regexp_replace(F.regexp_replace(address, r"^\|{1,2}", ""), r"\|$", "")
    core = F.regexp_replace(core, r"([.+?(){}\[\]|\\$])", r"\\$1")
    core = F.replace(F.replace(core, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(SEPARATOR))
    plain = F.concat(F.when(host, HOST_ANCHOR).when(start, "^").otherwise(""), core, F.when(end, "$").otherwise(""))
    given = F.expr("substring(address, 2, length(address) - 2)")
    return F.concat(F.when(case, "").otherwise("(?i)"), F.when(_is_regex(address), given).otherwise(plain))


def _is_regex(address: Column) -> Column:
    return address.startswith("/") & address.endswith("/") & (F.length(address) > 2)


def _runs(text: Column, n: int) -> Column:
    """The different pieces of n characters of `text` that have letters, digits and .-_% only."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.filter(pieces, lambda p: p.rlike(rf"^[a-z0-9._%-]{{{n}}}$")))


def parsed(rules: DataFrame) -> DataFrame:
    """Of rules(rule): pattern, excepts, third (null: not asked), domains and not_domains, kinds and not_kinds (null: not asked), address. Comments,
    blank lines, element rules and rules with unknown options are left out; rules of equal meaning are one."""
    line = rules.select(T.strip(F.col("rule")).alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("!") & ~F.col("line").startswith("[") & ~F.col("line").rlike("##|#@#|#[?$]#"))
    body = line.select(F.col("line").startswith("@@").alias("excepts"), F.regexp_replace("line", "^@@", "").alias("body"))
    body = body.withColumn("given", F.regexp_extract("body", OPTIONS, 1)).withColumn("address", F.expr("if(given = '', body, left(body, length(body) - length(given) - 1))"))
    options = F.filter(F.split(F.lower("given"), ","), lambda o: o != "")
    named = F.filter(options, lambda o: o.startswith("domain="))
    domains = F.flatten(F.transform(named, lambda o: F.split(F.substring(o, 8, 100_000), r"\|")))
    yes = lambda names: F.filter(names, lambda x: ~x.startswith("~") & (x != ""))
    no = lambda names: F.transform(F.filter(names, lambda x: x.startswith("~")), lambda x: F.substring(x, 2, 100_000))
    kinds = F.filter(options, lambda o: F.regexp_replace(o, "^~", "").isin(*KINDS))
    third = F.when(F.array_contains(options, "third-party"), True).when(F.array_contains(options, "~third-party"), False)
    known = F.forall(options, lambda o: o.isin("match-case", "third-party", "~third-party") | o.startswith("domain=") | F.regexp_replace(o, "^~", "").isin(*KINDS))
    asked = lambda names, values: F.when(F.size(names) > 0, values)
    return body.where(known & (F.col("address") != "")).select(
        _pattern(F.col("address"), F.array_contains(options, "match-case")).alias("pattern"), "excepts", third.alias("third"),
        asked(named, yes(domains)).alias("domains"), asked(named, no(domains)).alias("not_domains"), asked(kinds, yes(kinds)).alias("kinds"), asked(kinds, no(kinds)).alias("not_kinds"), "address",
    ).distinct()


def indexed(rules: DataFrame) -> DataFrame:
    """parsed() rules with `key`: of the runs that a matching URL must have, the one that the fewest rules have, the least of several. Null for rules
    without a run, and for regular expressions."""
    text = F.regexp_replace(F.lower("address"), r"^\|+|\|$", "")
    literal = F.when(_is_regex(F.col("address")), F.array().cast("array<string>")).otherwise(let(_runs(text, LONG), lambda long: F.when(F.size(long) > 0, long).otherwise(_runs(text, SHORT))))
    each = rules.withColumn("_rule", F.xxhash64("pattern", "excepts", "third", "domains", "not_domains", "kinds", "not_kinds")).withColumn("_runs", literal)
    runs = each.select("_rule", F.explode("_runs").alias("key"))
    often = runs.groupBy("key").agg(F.count("*").alias("n"))
    best = runs.join(often, "key").groupBy("_rule").agg(F.min(F.struct("n", "key")).alias("_best"))
    return each.join(best, "_rule", "left").select(*rules.columns, F.col("_best.key").alias("key"))


def _applies(rule) -> Column:
    """Whether the request of the columns _url, _page (host), _third, _kind has what a rule asks for. rule: its fields by name."""
    page, kind = F.col("_page"), F.col("_kind")
    below = lambda names: F.exists(names, lambda d: (page == d) | page.endswith(F.concat(F.lit("."), d)))
    domain = rule("domains").isNull() | (page.isNotNull() & ((F.size(rule("domains")) == 0) | below(rule("domains"))) & ~below(rule("not_domains")))
    kinds = rule("kinds").isNull() | (kind.isNotNull() & ((F.size(rule("kinds")) == 0) | F.array_contains(rule("kinds"), kind)) & ~F.array_contains(rule("not_kinds"), kind))
    third = rule("third").isNull() | (F.col("_third").isNotNull() & (rule("third") == F.col("_third")))
    return F.coalesce(third & domain & kinds, F.lit(False)) & F.regexp_like(F.col("_url"), rule("pattern"))


def blocked(requests: DataFrame, rules: DataFrame, url: str = "url", into: str = "is_blocked", page: str | None = None, kind: str | None = None) -> DataFrame:
    """`requests` with whether a rule of rules(rule) that applies matches the URL and no exception does.

    page: the column with the URL of the page that asks, for `domain=` and `third-party` (the registrable domains differ); kind: the column with
    the kind of request. Without one of them, or where it is null, rules that ask for it don't apply. A null URL isn't blocked.
    Each different request is looked up once; only those that meet a rule are joined back, by what was asked, so repeated requests may be many.
    """
    ask = [c for c in (url, page, kind) if c]
    page_url = F.col(page) if page else F.lit(None).cast("string")
    base = requests.select(*ask).distinct().where(F.col(url).isNotNull())
    seen = base.select(
        *[F.col(c).alias(f"_ask_{i}") for i, c in enumerate(ask)], F.col(url).alias("_url"), U.host(page_url).alias("_page"),
        F.when(page_url.isNotNull(), ~U.registrable_domain(F.col(url)).eqNullSafe(U.registrable_domain(page_url))).alias("_third"), (F.lower(kind) if kind else F.lit(None).cast("string")).alias("_kind"),
    )
    known = indexed(parsed(rules)).persist()
    few = known.count() <= BROADCAST_RULES
    by_key, rest = known.where("key IS NOT NULL").drop("address"), known.where("key IS NULL").drop("address", "key")
    lower = F.lower("_url")
    keyed = seen.withColumn("key", F.explode(F.concat(_runs(lower, LONG), _runs(lower, SHORT)))).join(F.broadcast(by_key) if few else by_key, "key")
    asked = [f"_ask_{i}" for i in range(len(ask))]
    hits = keyed.where(_applies(F.col)).select(*asked, "excepts")
    # rules without a key: one row for KEYLESS of them, so that nothing is paired row by row
    block = rest.select(F.pmod(F.xxhash64("pattern"), F.lit(max(1, -(-rest.count() // KEYLESS)))).alias("block"), F.struct(*rest.columns).alias("r")).groupBy("block").agg(F.collect_list("r").alias("rules"))
    found = seen.join(F.broadcast(block)).select(*asked, F.filter("rules", lambda r: _applies(r.getField)).alias("found")).select(*asked, F.explode("found").alias("f")).select(*asked, "f.excepts")
    marks = hits.unionByName(found).groupBy(*asked).agg((F.bool_or(~F.col("excepts")) & ~F.bool_or("excepts")).alias("_yes")).where("_yes")
    same = None
    for i, c in enumerate(ask):
        one = F.col(c).eqNullSafe(F.col(f"_ask_{i}")) if i else F.col(c) == F.col("_ask_0")
        same = one if same is None else same & one
    kept = [c for c in requests.columns if c != into]
    return requests.join(marks, same, "left").select(*kept, F.coalesce("_yes", F.lit(False)).alias(into))
