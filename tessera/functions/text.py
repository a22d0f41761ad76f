"""Text functions on columns. Lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import Compaction, PageGate
from tessera.functions.expr import let


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; trim() takes spaces only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """True for null and white space."""
    return F.coalesce(~text.rlike(r"\S"), F.lit(True))


def nonblank(text: Column) -> Column:
    """The text, or null if blank."""
    return F.when(~is_blank(text), text)


def first_nonblank(*texts: Column) -> Column:
    return F.coalesce(*map(nonblank, texts))


def words(text: Column) -> Column:
    """The runs of characters other than white space; none for a blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the length, rounded down."""
    return F.floor(F.length(text) / 4).cast("bigint")


def is_summary(role: Column, text: Column, config: Compaction = Compaction()) -> Column:
    return (F.lower(role) == "system") & text.startswith(config.marker)


def valid_summary(summary: Column, config: Compaction = Compaction()) -> Column:
    """The stripped summary with its marker; null if blank or over 1.5 times its token budget."""
    s = strip(summary)
    marked = F.when(s.startswith(config.marker), s).otherwise(F.concat(F.lit(config.marker + "\n"), s))
    return F.when(~is_blank(summary) & (token_estimate(marked) <= int(1.5 * config.summary_tokens)), marked)


def known_role(role: Column) -> Column:
    """system, assistant, user or tool in lower case; anything else is a user."""
    r = F.lower(role)
    return F.when(r.isin("system", "assistant", "user", "tool"), r).otherwise("user")


def extension(name: Column) -> Column:
    """Lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def sanitized_filename(name: Column, fallback: str = "unknown_file", longest: int = 200) -> Column:
    """A file name of letters, digits, dots, dashes and underscores, at most `longest` with its extension kept."""
    out = basename(name)
    for pattern, to in ((r"[\x00-\x1f\x7f]", ""), (r"\.{2,}", "."), (r"[^A-Za-z0-9._-]", "_"), (r"_+", "_"), (r"^[._]+", "")):
        out = F.regexp_replace(out, pattern, to)
    tail = F.regexp_extract(out, r"(\.[A-Za-z0-9_-]{1,20})$", 1)
    short = F.concat(F.substring(out, F.lit(1), F.lit(longest) - F.length(tail)), tail)
    return F.coalesce(F.when(F.length(out) > longest, short).when(F.length(out) > 0, out), F.lit(fallback))


def reading_ease(text: Column) -> Column:
    """Flesch's reading ease (1948); syllables are runs of vowels, one a word at least."""
    w = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))
    sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    syllables = F.aggregate(w, F.lit(0), lambda n, x: n + F.greatest(F.regexp_count(F.lower(x), F.lit("[aeiouy]+")), F.lit(1)))
    n = F.greatest(F.size(w), F.lit(1))
    return F.lit(206.835) - F.lit(1.015) * n / sentences - F.lit(84.6) * syllables / n


#: Strings that mark a failed page, case-sensitive.
ERROR_KEYWORDS = ("Access Denied", "403 Forbidden", "Captcha", "Security Check", "Enable JavaScript", "Additional Verification Required", "Ray ID")


def has_error_keyword(text: Column) -> Column:
    out = F.lit(False)
    for k in ERROR_KEYWORDS:
        out = out | F.coalesce(F.contains(text, F.lit(k)), F.lit(False))
    return out


def quality_gate(text: Column, config: PageGate = PageGate()) -> Column:
    """Why a page's text is not worth keeping: empty, error, short, unreadable or repetitive; else ok."""
    letter = r"\p{L}\p{N}'"
    # whether there are `min_words` words without punctuation; anchored, so that it reads no further than these
    lexicon = text.rlike(rf"^[^{letter}]*+(?:[{letter}]++[^{letter}]++){{{config.min_words - 1}}}[{letter}]")

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return (
            F.when(n < config.min_words, "short").when(~lexicon & (reading_ease(text) < config.min_reading_ease), "unreadable")
            .when((n > config.repetition_words) & (F.size(F.array_distinct(w)) / n < config.min_distinct_share), "repetitive").otherwise("ok")
        )

    return F.when(is_blank(text), "empty").when(has_error_keyword(text), "error").otherwise(let(words(text), of_words))


def user_hash(user: Column) -> Column:
    """A pseudonym for logs: the first twelve hex digits of the SHA-256."""
    return F.substring(F.sha2(user, 256), 1, 12)


def glob(pattern: Column) -> Column:
    """A regular expression for a case-insensitive glob whose only wildcard is the star."""
    return F.concat(F.lit(r"(?is)^\Q"), F.replace(pattern, F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E$"))


def clock(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = F.floor(seconds).cast("bigint")
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", part(F.floor(s / 3600)), part(F.floor(s / 60) % 60), part(s % 60))
