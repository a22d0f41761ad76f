r"""Format-preserving pseudonyms by keyed Feistel networks.

What is replaced, where its form and its check hold: e-mail addresses (the local part), IBANs (length of the country, mod 97), IPv4
addresses, calendar dates of digits, US social security numbers (allowed areas), telephone numbers (of ten digits in groups, or
with a plus and a country code), and payment card numbers (Luhn). Numbers that fail their check stay as they are, and so do
dates with the month in words or without separators. A
value is permuted within its format: letters stay letters of their case, digits digits, separators stay, check digits
are computed anew, addresses and dates stay valid, a date in its 400 years. A date with slashes is read month first where that
is a date, else day first, and its pseudonym is read the same way. The permutation depends on the key and the
format only, so equal values get equal pseudonyms in every document, and different ones of a format get different
ones. Values are equal whatever their spelling: telephone numbers by their digits after the country code, e-mail local parts by
their letters without case, dates by their day.

Strings go through an alternating Feistel network on their two halves: a round shifts each letter or digit of one
half, within its class, by bytes of a SHA-512 of the key and the other half. Letters of Latin-1 with accents, of Cyrillic and of Greek are classes of
their own. A local part with letters or digits of any other script becomes a keyed digest of 16 letters and digits, as linked and as secret, but
without its format. A date may be followed by a time; IBANs may be in small letters. Addresses, dates and social security
numbers go through the same network on a pair of residues; days that are read day first are walked on until the day is over twelve
again. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Steps of a walk: about 0.4 of all days are no end of it, so that one in 10^19 values would need more.
STEPS = 48
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
# Country codes of one and of two digits; all others have three.
SHORT_CODES = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: In the order in which they are tried at a place of a text.
FORMS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Za-z]{2}[0-9]{2})(?i:" + "|".join(f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, lands in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])",
    "ip": rf"(?<![A-Za-z0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![A-Za-z0-9]|\.[0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![A-SU-Za-z0-9]|T(?![0-9]{2}:)|[-/.][0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,5})){2,5})(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}|[0-9]{13,19})(?![A-Za-z0-9])",
}
# A look at one character rules most places of a text out.
_NUMBERS = "(?=[0-9+(])(?:" + "|".join(f"(?:{p})" for n, p in FORMS.items() if n not in ("email", "iban")) + ")"
NO_MAIL = f"(?=[0-9+(]|[A-Za-z]{{2}}[0-9]{{2}})(?:(?:{FORMS['iban']})|{_NUMBERS})"
ANY = f"(?:{FORMS['email']})|{NO_MAIL}"
#: Classes of small letters beyond ASCII, by their first and last; capitals of theirs are those of the pseudonym's. What has other letters or digits has no format to keep.
SCRIPTS = (("à", "ö"), ("ø", "þ"), ("а", "я"), ("ѐ", "џ"), ("α", "ω"))
OTHERS = r"[\p{L}\p{M}\p{N}&&[^\x00-\xFFа-яѐ-џα-ω]]"
#: Set around matches, so that a text is searched once.
MARK = "\x00"


def _bytes(key: Column, round_: Column, half: Column, hexes: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", key, round_.cast("string"), half.cast("string")), 512), 1, hexes)


def pair(a: Column, b: Column, of_a: Column, of_b: Column, key: Column) -> Column:
    """struct(a, b) after a keyed permutation of the pairs below (of_a, of_b)."""

    def step(s: Column, i: Column) -> Column:
        by = lambda x: F.conv(_bytes(key, i, x, 12), 16, 10).cast("bigint")
        return F.when(i % 2 == 0, F.struct(F.pmod(s["a"] + by(s["b"]), of_a).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), F.pmod(s["b"] + by(s["a"]), of_b).alias("b")))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted(text: Column, key: Column) -> Column:
    """A string of up to 128 characters after a keyed permutation of the strings of its format."""

    def shifted(half: Column, other: Column, i: Column) -> Column:
        code = F.sha2(F.concat_ws("|", key, i.cast("string"), F.length(half).cast("string"), other), 512)

        def one(c: Column, j: Column) -> Column:
            by = F.conv(F.substring(code, 2 * j + 1, F.lit(2)), 16, 10).cast("int")
            move = lambda low, n: F.char(F.lit(ord(low)) + F.pmod(F.ascii(c) - F.lit(ord(low)) + by, F.lit(n)))
            plain = F.when(c.between("0", "9"), move("0", 10)).when(c.between("a", "z"), move("a", 26)).when(c.between("A", "Z"), move("A", 26))
            for low, high in SCRIPTS:
                letters = F.lit("".join(map(chr, range(ord(low), ord(high) + 1))))
                plain = plain.when(c.between(low, high), F.substring(letters, F.pmod(F.instr(letters, c) - 1 + by, F.length(letters)) + 1, F.lit(1)))
            return plain.otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(shifted(s["a"], s["b"], i).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), shifted(s["b"], s["a"], i).alias("b")))

    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("a"), F.substring(text, cut + 1, F.length(text)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def _luhn(payload: Column) -> Column:
    """The check digit of a string of digits, as a number."""
    parts = F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(parts, F.lit(0), lambda s, x: s + x), F.lit(10))


def _mod97(text: Column) -> Column:
    """Of a string of digits and capital letters, these as 10 to 35."""

    def step(s: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), F.pmod(s * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(s * 100 + letter, F.lit(97)))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _laid(form: Column, digits: Column) -> Column:
    """`form` with its letters and digits, in order, replaced by the characters of `digits`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))

    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def _email(m: Column, key: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    small = F.lower(local)
    out = permuted(small, F.concat(key, F.lit("|email")))
    # each letter in the case of the one that it stands for
    cased = F.zip_with(F.split(out, ""), F.zip_with(F.split(local, ""), F.split(small, ""), lambda x, y: x == y), lambda c, same: F.when(same, c).otherwise(F.upper(c)))
    whole = F.when(F.length(small) == F.length(local), F.array_join(cased, "")).otherwise(out)
    opaque = F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), small), 256), 1, 16)
    return F.concat(F.when(small.rlike(OTHERS), opaque).otherwise(whole), F.lit("@"), F.substring_index(m, "@", -1))


def _card(m: Column, key: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    out = permuted(payload, F.concat(key, F.lit("|card")))
    good = _luhn(payload) == F.substring(digits, -1, 1).cast("int")
    return F.when(good & F.length(digits).between(13, 19), _laid(m, F.concat(out, _luhn(out).cast("string"))))


def _iban(m: Column, key: Column) -> Column:
    plain = F.upper(F.replace(m, F.lit(" "), F.lit("")))
    land, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    out = permuted(rest, F.concat(key, F.lit("|iban"), land))
    check = F.lpad((F.lit(98) - _mod97(F.concat(out, land, F.lit("00")))).cast("string"), 2, "0")
    good = (_mod97(F.concat(rest, F.substring(plain, 1, 4))) == 1) & F.substring(plain, 3, 2).between("02", "98")
    laid = _laid(m, F.concat(land, check, out))
    return F.when(good, F.when(m == F.lower(m), F.lower(laid)).otherwise(laid))


def _ip(m: Column, key: Column) -> Column:
    p = F.split(m, r"\.")
    at = lambda i: F.get(p, F.lit(i)).cast("bigint")
    halves = F.array(pair(at(0) * 256 + at(1), at(2) * 256 + at(3), F.lit(65536), F.lit(65536), F.concat(key, F.lit("|ip"))))
    spelled = F.transform(halves, lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string")))
    return F.get(spelled, F.lit(0))


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    index = area - 1 - F.when(area > 666, 1).otherwise(0)  # 001 to 899 without 666
    out = F.array(pair(index, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.concat(key, F.lit("|ssn"))))
    spelled = F.transform(out, lambda s: F.concat_ws("-", F.lpad((s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), F.get(spelled, F.lit(0)))


def _date(m: Column, key: Column) -> Column:
    p = F.split(m, "[-/.]")
    part = lambda i: F.get(p, F.lit(i))
    year_first, dots = F.length(part(0)) == 4, F.contains(m, F.lit("."))
    of = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    month_first = ~year_first & ~dots & of(part(2), part(0), part(1)).isNotNull()
    day_first = ~year_first & ~dots & ~month_first
    day = F.when(year_first, of(part(0), part(1), part(2))).when(month_first, of(part(2), part(0), part(1))).otherwise(of(part(2), part(1), part(0)))
    start = F.lit("1600-01-01").cast("date")
    since = F.datediff(day, start)
    era = F.floor(since / 146097)  # the calendar repeats after 146097 = 189 * 773 days, 400 years
    within = F.pmod(since, F.lit(146097)).cast("bigint")

    def moved(x: Column) -> Column:
        out = F.array(pair(F.floor(x / 773), x % 773, F.lit(189), F.lit(773), F.concat(key, F.lit("|date"))))
        return F.get(F.transform(out, lambda s: s["a"] * 773 + s["b"]), F.lit(0))

    early = lambda x: F.dayofmonth(F.date_add(start, x.cast("int"))) <= 12
    walk = F.aggregate(F.when(day_first, F.sequence(F.lit(0), F.lit(STEPS))).otherwise(F.array(F.lit(0))), within, lambda x, i: F.when((i == 0) | early(x), moved(x)).otherwise(x))
    to = lambda x: F.date_add(start, (era * 146097 + x).cast("int"))
    width = lambda n, i: F.when(F.length(part(i)) > 1, F.lpad(n, 2, "0")).otherwise(n)
    d, mo, y = (lambda x: F.dayofmonth(x).cast("string")), (lambda x: F.month(x).cast("string")), (lambda x: F.lpad(F.year(x).cast("string"), 4, "0"))
    spelled = F.transform(F.transform(F.array(walk), to), lambda x: (
        F.when(year_first, F.concat(y(x), F.substring(m, 5, 1), F.lpad(mo(x), 2, "0"), F.substring(m, 5, 1), F.lpad(d(x), 2, "0"))).when(dots, F.concat_ws(".", width(d(x), 0), width(mo(x), 1), y(x)))
        .when(month_first, F.concat_ws("/", width(mo(x), 0), width(d(x), 1), y(x))).otherwise(F.concat_ws("/", width(d(x), 0), width(mo(x), 1), y(x)))
    ))
    return F.when(day.isNotNull() & (F.year(day) >= 1600), F.get(spelled, F.lit(0)))


def _phone(m: Column, key: Column) -> Column:
    """The country code stays; what follows it is permuted, however it is grouped."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    short = F.length(F.regexp_extract(m, rf"^{SHORT_CODES}", 0))  # with the plus
    code = F.when(~F.contains(m, F.lit("+")), 0).when(short > 0, short - 1).otherwise(3)
    out = permuted(F.substring(digits, code + 1, F.length(digits)), F.concat(key, F.lit("|phone")))
    return _laid(m, F.concat(F.substring(digits, F.lit(1), code), out))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a string that one of FORMS matches; null where its check fails."""
    k = F.lit(key)
    whole = {n: m.rlike(f"^(?:{p})$") for n, p in FORMS.items()}
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, k)).when(whole["iban"], _iban(m, k)).when(whole["ip"], _ip(m, k)).when(whole["date"], _date(m, k))
        .when(whole["ssn"], _ssn(m, k)).when(whole["phone"], _phone(m, k)).when(whole["card"], _card(m, k))
    )


def pseudonymize(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """`docs` with the personal values of `text` replaced, and their number in the column `count` if one is named.

    A column named `count` is replaced. Null texts stay null with a count of 0, empty ones stay empty. Each row is on its own;
    equal rows give equal rows.
    """
    t, parts, new = F.col(text), F.col("_tessera_parts"), F.col("_tessera_new")
    full = F.coalesce(t, F.lit(""))
    mark = lambda pattern: F.regexp_replace(full, pattern, f"{MARK}$0{MARK}")
    marked = F.split(F.when(F.contains(full, F.lit("@")), mark(ANY)).otherwise(mark(NO_MAIL)), MARK, -1)  # what is between matches, and these, in turn
    found = F.regexp_extract_all(full, F.lit(ANY), F.lit(0))
    apart = F.flatten(F.transform(F.split(full, ANY, -1), lambda g, i: F.when(i < F.size(found), F.array(g, F.get(found, i))).otherwise(F.array(g))))
    out = docs.withColumn("_tessera_parts", F.when(F.contains(full, F.lit(MARK)), apart).otherwise(marked))
    out = out.withColumn("_tessera_new", F.transform(parts, lambda m, i: F.when(i % 2 == 1, pseudonym(m, key))))
    mixed = F.array_join(F.zip_with(parts, new, lambda old, n: F.coalesce(n, old)), "")
    out = out.withColumn(text, F.when(F.size(parts) > 1, mixed).otherwise(t))
    if count:
        out = out.withColumn(count, F.size(F.filter(new, lambda x: x.isNotNull())))
    return out.drop("_tessera_parts", "_tessera_new")
