"""URL predicates on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a URL that lead to a login.
LOGIN_PARTS = ("?login", "continue=", "signin", "login=", "auth?")
#: Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "com.pl", "co.in", "com.cn", "co.za")


def host(url: Column) -> Column:
    """In lower case, without port; a missing scheme counts as http. Null for what is no URL."""
    whole = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))
    return F.lower(F.try_parse_url(whole, F.lit("HOST")))


def registrable_domain(url: Column) -> Column:
    """The host's last two labels, or three under a suffix of two."""
    h = host(url)
    labels = F.split(h, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return F.when(h.rlike(r"^[0-9.]+$"), h).when(last(2).isin(*TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def is_login_redirect(url: Column) -> Column:
    u = F.lower(url)
    out = F.lit(False)
    for part in LOGIN_PARTS:
        out = out | F.contains(u, F.lit(part))
    return out


#: Address ranges that are not public, IPv4 as base and prefix length, IPv6 as patterns of its text.
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
PRIVATE_V6 = r"^\[(?:::1?|(?:0{1,4}:){7}0{0,3}[01]|::ffff:.*|(?:0{1,4}:){5}ffff:.*|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:0?db8:.*|64:ff9b:1:.*|100::.*)\]$"


def is_public_address(url: Column) -> Column:
    """http or https with a host that is no literal address of a private, local, shared, test or reserved range."""
    h = host(url)
    octets = F.split(h, r"\.")
    at = lambda i: F.get(octets, F.lit(i)).cast("bigint")
    literal = h.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    number = F.when(literal, ((at(0) * 256 + at(1)) * 256 + at(2)) * 256 + at(3))
    private = F.lit(False)
    for base, bits in PRIVATE_V4:
        first = int.from_bytes(bytes(map(int, base.split("."))), "big")
        private = private | number.between(first, first + (1 << 32 - bits) - 1)
    local = h.isin("localhost", "metadata.google.internal") | h.endswith(".localhost") | h.rlike(PRIVATE_V6)
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https")
    return F.coalesce(scheme, F.lit(False)) & h.isNotNull() & ~F.coalesce(private, F.lit(False)) & ~F.coalesce(local, F.lit(False))


def with_registrable_domain(rows: DataFrame, rules: DataFrame, url: str = "url", into: str = "domain") -> DataFrame:
    """`rows` with the label before the longest public suffix of the URL's host, and that suffix. rules(rule) is a public suffix list: `com`,
    `co.uk`, `*.ck` for any label before, `!www.ck` for an exception. Without a rule for it, the last label is the suffix. Null where there is
    no host, or no label before the suffix; an address is its own domain. Joins by suffix, so the list may be of any size."""
    h = host(F.col(url))
    labels = F.split(h, r"\.")
    base = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_host", h)
    ends = base.select("_row", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_at", "_end"), F.size(labels).alias("_n"))
    ends = ends.withColumn("_any", F.regexp_replace("_end", r"^[^.]+", "*"))
    named = ends.select("_row", "_at", "_n", F.explode(F.array(F.struct(F.col("_end").alias("rule"), F.lit(0).alias("less")), F.struct(F.concat(F.lit("!"), F.col("_end")).alias("rule"), F.lit(-1).alias("less")), F.struct(F.col("_any").alias("rule"), F.lit(0).alias("less")))).alias("_r"))
    hit = named.select("_row", "_at", "_n", "_r.rule", "_r.less").join(rules.select("rule").distinct(), "rule")
    # an exception beats all others; its suffix is one label shorter
    best = hit.groupBy("_row").agg(F.max(F.struct((F.col("less") < 0).alias("x"), (F.col("_n") - F.col("_at") + F.col("less")).alias("size"))).alias("_b")).select("_row", F.col("_b.size").alias("_size"))
    size = F.coalesce(F.col("_size"), F.lit(1)) + 1
    h = F.col("_host")
    labels = F.split(h, r"\.")
    domain = F.when(h.rlike(r"^[0-9.]+$|^\["), h).when(F.size(labels) >= size, F.array_join(F.slice(labels, F.size(labels) - size + 1, size), "."))
    return base.join(best, "_row", "left").withColumn(into, domain).drop("_row", "_host", "_size")


def inside(path: Column, root: str) -> Column:
    """Whether a path without `..` steps lies under `root`."""
    top = root.rstrip("/") + "/"
    return path.startswith(top) & ~path.rlike(r"(^|/)\.\.(/|$)")
