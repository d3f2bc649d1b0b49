r"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions only.

One pattern finds candidates; a candidate is private if it passes its kind's check: cards by Luhn's digit, IBANs by
their remainder modulo 97, social security numbers by their ranges, addresses by their octets, dates by the calendar,
mail addresses, phone numbers and labelled secrets by their form. A private value is permuted within its format:

* strings of digits and letters by a Feistel network over their halves, in which each character moves within its own
  class (digits, hexadecimal digits, letters of a case) by a keyed hash of the other half,
* numbers of a range ``a * b`` (dates, addresses, social security numbers) by a Feistel network over ``Z_a x Z_b``.

Check digits are worked out anew, separators stay in place, and the permutation depends on the key, the kind and the
value alone: equal values stay equal in all documents, different ones stay different, and who has the key can undo it.
Round keys are SHA-512 hashes. Kept as they are: the country of an IBAN, the part of a phone number before its first
separator, the domain of a mail address, and the fixed beginning of a secret.

A text in which a candidate fails its check is read a second time, every place where a form fits by itself, and only
the valid values are taken: what fails never hides a valid value that it covers or overlaps.

Cases: a null text stays null and has no value; a text without candidates is passed on as it is; values that fail their
check stay; rows are independent, so repeated rows, null ids and other columns do not matter; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Accented letters move among themselves.
LOWER_MORE, UPPER_MORE = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸŒ"
CLASSES = (DIGITS, LOWER, UPPER, LOWER_MORE, UPPER_MORE)
HEX_LOWER, HEX_UPPER = (DIGITS + "abcdef",), (DIGITS + "ABCDEF",)

#: Characters of an IBAN by country; other countries and lengths have the general form.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(size: int, countries: str) -> str:
    groups, rest = divmod(size - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


IBANS = "|".join(_iban_of(*x) for x in IBAN_LENGTHS.items())
OTHER_IBANS = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_L = r"[\p{L}\p{N}._%+\-]"
_DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})"
_PHONE = r"(?<![0-9])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4})"
#: Ten digits in national groups: 3-3-4, neither of the first two groups below 200, or five pairs from 01 on.
_NATIONAL = r"(?<![0-9.\-+])(?:[2-9][0-9]{2}(?:-[2-9][0-9]{2}-|\.[2-9][0-9]{2}\.| [2-9][0-9]{2} )[0-9]{4}|0[1-9](?:[ .\-][0-9]{2}){4})(?![0-9\-])"
#: How labelled secrets begin, also as JSON keys and at the end of longer names, and fixed beginnings of keys that need no label; both stay.
LABEL = (
    r"(?i:(?<![A-Za-z0-9])(?:token|secret|password|passwd|passphrase|pwd|(?:api|access|private|secret)[_\-]?key)(?![A-Za-z0-9])"
    r"(?:\\?[\"'])?\s*+[=:]\s*+(?:\\?[\"'])?)"
)
PREFIX = r"(?:AKIA|ASIA|AIza|gh[opsru]_|github_pat_|glpat-|sk-|xox[abprs]-|eyJ)"
BEARER = r"(?i:(?<![A-Za-z0-9])bearer\s++)"
#: Characters of a labelled secret: those of keys, of base64 and of web tokens; what belongs to no class of letters stays.
_SECRET = r"[A-Za-z0-9_\-./+=~]"
#: A web token: three parts, of which the first two begin alike.
_WEB_TOKEN = r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{6,}\.eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]++"
#: What must follow the kinds that have a check. A slash may part two whole dates.
TAILS = {
    "iban": r"(?![A-Za-z0-9])",
    "card": r"(?![0-9])",
    "ssn": r"(?![0-9\-])",
    "date": rf"(?:(?![0-9./\-]?[0-9])|(?=/{_DATE}(?![0-9./\-]?[0-9])))",
    "ip": r"(?!\.?[0-9])",
    "phone": r"(?![0-9])",
}
#: Forms of the kinds, in order of precedence.
FORMS = {
    "email": rf"(?<!{_L}){_L}++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{{2,}}",
    "secret": rf"(?:{LABEL}{_SECRET}{{16,}}+|{_WEB_TOKEN}|{BEARER}(?=\S*[0-9]){_SECRET}{{16,}}+|(?<![A-Za-z0-9_\-]){PREFIX}[A-Za-z0-9_\-]{{16,}}+)",
    "iban": rf"(?<![A-Za-z0-9])(?:(?:{IBANS}){TAILS['iban']}|{OTHER_IBANS}{TAILS['iban']})",
    "card": rf"(?<![0-9])(?:[0-9]{{4}}(?:[ \-][0-9]{{4}}){{3}}|[0-9]{{4}}[ \-][0-9]{{6}}[ \-][0-9]{{5}}|[0-9]{{13,19}}){TAILS['card']}",
    "ssn": rf"(?<![0-9\-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{TAILS['ssn']}",
    "date": rf"(?:(?<![0-9./\-])|(?<=(?<![0-9./\-]){_DATE}/)){_DATE}{TAILS['date']}",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}{TAILS['ip']}",
    "phone": rf"(?:\+[0-9]{{1,3}}[ .\-]?)?(?<![0-9])\([0-9]{{2,4}}\)[ .\-]?[0-9]{{3,4}}[ .\-]?[0-9]{{3,4}}{TAILS['phone']}|{_PHONE}{{2,5}}{TAILS['phone']}|{_NATIONAL}",
}
#: The lengths that a candidate may have at one place, where the form alone takes the longest.
LENGTHS = {
    "iban": [FORMS["iban"], rf"(?<![A-Za-z0-9]){OTHER_IBANS}{TAILS['iban']}"],
    "phone": [FORMS["phone"], *[f"{_PHONE}{{{n}}}{TAILS['phone']}" for n in (4, 3, 2)]],
}
ANY = "|".join(f"(?:{x})" for x in FORMS.values())
KINDS = tuple(FORMS)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _hashed(key: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 512)


def _moved(char: Column, by: Column, classes: tuple[str, ...]) -> Column:
    out = None
    for letters in classes:
        at = F.instr(F.lit(letters), char)
        new = F.substring(F.lit(letters), (at - 1 + by) % len(letters) + 1, F.lit(1))
        out = (F if out is None else out).when(at > 0, new)
    return out.otherwise(char)


#: Characters that one network permutes: a hash has a byte for each of one half.
NETWORK = 128


def permuted_text(value: Column, key: str, kind: str, classes: tuple[str, ...] = CLASSES) -> Column:
    """A string by a Feistel network over its halves; characters of no class stay. Longer ones than a network takes go in even pieces."""
    n = F.greatest(F.lit(1), F.ceil(F.length(value) / NETWORK)).cast("int")
    long = F.ceil(F.length(value) / n).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _network(F.substring(value, i * long + 1, long), key, F.when(i > 0, F.concat(F.lit(kind), i.cast("string"))).otherwise(kind), classes))
    return F.array_join(pieces, "")


def _network(value: Column, key: str, kind: Column, classes: tuple[str, ...]) -> Column:
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))

    def step(s: Column, r: Column) -> Column:
        h = _hashed(key, kind, r, s["b"])
        byte = lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        moved = F.array_join(F.transform(_chars(s["a"]), lambda c, i: _moved(c, byte(i), classes)), "")
        return F.struct(s["b"].alias("a"), moved.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["a"], s["b"]))


def permuted_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A number below ``a * b`` by a Feistel network over Z_a x Z_b."""
    big = lambda x: x.cast("bigint")
    start = F.struct(big(F.floor(value / b)).alias("x"), big(value % b).alias("y"))

    def step(s: Column, r: Column) -> Column:
        f = lambda side, v: F.conv(F.substring(_hashed(key, kind, side, r, v), 1, 14), 16, 10).cast("bigint")
        x = (s["x"] + f("x", s["y"])) % a
        # The second half sees the new first half; it is written out, since a struct field cannot be named here.
        return F.struct(big(x).alias("x"), big((s["y"] + f("y", x)) % b).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda s: s["x"] * b + s["y"])


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def laid_out(layout: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``layout``."""
    place = lambda i: F.length(digits_of(F.substring(layout, F.lit(1), i)))
    return F.array_join(F.transform(_chars(layout), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, place(i) + 1, F.lit(1))).otherwise(c)), "")


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn's sum from the right; ``doubled_first``: the last digit is doubled (no check digit yet)."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == (0 if doubled_first else 1), 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), weight), F.lit(0), lambda s, x: s + x)


def remainder_97(text: Column) -> Column:
    """The number that letters (A is 10) and digits make, modulo 97."""
    parts = F.transform(_chars(text), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(parts, F.lit(0), lambda s, d: (s * F.when(d > 9, 100).otherwise(10) + d) % 97)


def _iban_body(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


#: The first day and the number of days that dates are permuted among: 270 * 270 days.
FIRST_DAY, DAYS = "1900-01-01", 270


def parsed_date(value: Column) -> Column:
    """The day that a date in one of the three forms names; null for a day that does not exist or lies outside."""
    iso = F.when(value.contains("-"), value)
    iso = F.coalesce(iso, F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))
    day = iso.try_cast("date")
    return F.when(F.date_diff(day, F.lit(FIRST_DAY).cast("date")).between(0, DAYS * DAYS - 1), day)


def valid(value: Column, kind: str) -> Column:
    """Whether a candidate of a kind passes its check."""
    if kind == "card":
        return luhn_sum(digits_of(value), False) % 10 == 0
    if kind == "iban":
        body = _iban_body(value)
        return remainder_97(F.concat(F.substring(body, F.lit(5), F.length(body)), F.substring(body, 1, 4))) == 1
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda o: o.cast("int") > 255)
    if kind == "date":
        return parsed_date(value).isNotNull()
    if kind == "phone":
        return F.length(digits_of(value)).between(8, 15)
    return F.lit(True)


def pseudonym(value: Column, kind: str, key: str) -> Column:
    """The pseudonym of a valid value of a kind."""
    if kind == "email":
        local = F.regexp_extract(value, "^(.*)@", 1)
        return F.concat(permuted_text(local, key, kind), F.regexp_extract(value, "(@[^@]*)$", 1))
    if kind == "secret":
        label = F.regexp_extract(value, rf"^((?:{LABEL}|{BEARER})?(?:{PREFIX})?)", 1)
        own = F.substring(value, F.length(label) + 1, F.length(value))
        plain = F.when(own.rlike("^[0-9a-f]+$"), permuted_text(own, key, kind, HEX_LOWER)).when(own.rlike("^[0-9A-F]+$"), permuted_text(own, key, kind, HEX_UPPER))
        return F.concat(label, plain.otherwise(permuted_text(own, key, kind)))
    if kind == "card":
        digits = digits_of(value)
        payload = permuted_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, kind)
        return laid_out(value, F.concat(payload, ((10 - luhn_sum(payload, True) % 10) % 10).cast("string")))
    if kind == "iban":
        body = _iban_body(value)
        country, account = F.substring(body, 1, 2), permuted_text(F.substring(body, F.lit(5), F.length(body)), key, kind)
        check = F.lpad((98 - remainder_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        new = F.concat(country, check, account)
        place = lambda i: F.length(_iban_body(F.substring(value, F.lit(1), i)))
        return F.array_join(F.transform(_chars(value), lambda c, i: F.when(c == " ", c).otherwise(F.substring(new, place(i) + 1, F.lit(1)))), "")
    if kind == "ssn":
        area, rest = F.substring(value, 1, 3).cast("bigint"), (F.substring(value, 5, 2).cast("bigint") - 1) * 9999 + F.substring(value, 8, 4).cast("bigint") - 1
        n = permuted_number((area - F.when(area > 666, 2).otherwise(1)) * (99 * 9999) + rest, 898, 99 * 9999, key, kind)
        new_area, new_rest = F.floor(n / (99 * 9999)) + 1, n % (99 * 9999)
        new_area = F.when(new_area >= 666, new_area + 1).otherwise(new_area)
        return F.format_string("%03d-%02d-%04d", new_area.cast("bigint"), (F.floor(new_rest / 9999) + 1).cast("bigint"), (new_rest % 9999 + 1).cast("bigint"))
    if kind == "ip":
        n = F.aggregate(F.transform(F.split(value, r"\."), lambda o: o.cast("bigint")), F.lit(0).cast("bigint"), lambda s, o: s * 256 + o)
        n = permuted_number(n, 65536, 65536, key, kind)
        return F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    if kind == "date":
        first = F.lit(FIRST_DAY).cast("date")
        day = F.date_add(first, permuted_number(F.date_diff(parsed_date(value), first), DAYS, DAYS, key, kind).cast("int"))
        return F.when(value.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(value.contains("."), F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    head = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ .\-(])|\+[0-9]{2}|)", 1)
    own = F.substring(value, F.length(head) + 1, F.length(value))
    return F.concat(head, laid_out(own, permuted_text(digits_of(own), key, kind)))


def _kind(value: Column) -> Column:
    """The first kind whose form a candidate has and whose check it passes, or null."""
    out = None
    for kind, form in FORMS.items():
        bare = form.replace(rf"(?<!{_L})", "", 1)
        out = (F if out is None else out).when(value.rlike(rf"\A(?:{bare})\z") & valid(value, kind), kind)
    return out


def _valid_only() -> Column:
    """A pattern like ``ANY`` for the row's text, with the valid values in place of the forms that have a check.

    Every place where a form fits is tried by itself, so a candidate that fails cannot cover a valid one.
    """
    parts = [F.lit("|".join(f"(?:{FORMS[k]})" for k in KINDS if k not in TAILS))]
    for kind, tail in TAILS.items():
        every = F.concat(*[F.regexp_extract_all("text", F.lit(f"(?=({x}))"), F.lit(1)) for x in LENGTHS.get(kind, [FORMS[kind]])])
        good = F.array_sort(F.filter(F.array_distinct(every), lambda v: valid(v, kind)), lambda a, b: F.length(b) - F.length(a))  # noqa: B023
        values = F.array_join(F.transform(good, lambda v: F.concat(F.lit(r"\Q"), v, F.lit(r"\E"))), "|")
        parts.append(F.when(F.size(good) > 0, F.concat(F.lit(f"(?:(?={FORMS[kind]})(?:"), values, F.lit(f"){tail})"))))
    return F.concat_ws("|", *parts)


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text with pseudonyms, n_private and a count per kind (n_email, n_secret, ...)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    none = F.array().cast("array<string>")
    # Only texts with a digit, an at sign or the beginning of a secret can hold a candidate.
    found = rows.withColumn("found", F.when(F.col("text").rlike(rf"[0-9@]|(?i:token|secret|pass|pwd|key|bearer)|{PREFIX}"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none))
    kinds = found.withColumn("kinds", F.transform("found", _kind))
    # Where a candidate failed its check, the text is read again for the valid values alone.
    kinds = kinds.withColumn("pattern", F.when(F.exists("kinds", lambda k: k.isNull()), _valid_only()).otherwise(ANY))
    again = F.col("pattern") != ANY
    kinds = kinds.withColumn("found", F.when(again, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("found")))
    kinds = kinds.withColumn("kinds", F.when(again, F.transform("found", _kind)).otherwise(F.col("kinds")))

    def swap(pair: Column) -> Column:
        out = None
        for kind in KINDS:
            out = (F if out is None else out).when(pair["kind"] == kind, pseudonym(pair["value"], kind, key))
        return out.otherwise(pair["value"])

    pairs = F.arrays_zip(F.col("found").alias("value"), F.col("kinds").alias("kind"))
    swapped = kinds.withColumn("new", F.transform(pairs, swap))
    pieces = F.arrays_zip(F.split("text", F.col("pattern"), -1).alias("plain"), F.col("new").alias("new"))
    whole = F.array_join(F.transform(pieces, lambda p: F.concat(p["plain"], F.coalesce(p["new"], F.lit("")))), "")
    private = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return swapped.select(
        F.col("id").alias(id_col),
        F.when(F.size(F.array_compact("kinds")) > 0, whole).otherwise(F.col("text")).alias("text"),
        F.size(F.array_compact("kinds")).cast("long").alias("n_private"),
        *[private(k).alias(f"n_{k}") for k in KINDS],
    )
