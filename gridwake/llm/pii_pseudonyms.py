"""Operator 8: format-preserving pseudonyms for personal numbers and dates, in DataFrame functions only.

A text is cut once by one pattern into plain stretches and candidates. A candidate is validated: a card number by its
Luhn digit and its length, an IPv4 address by its parts, a calendar date by the calendar, a phone number by its form, a
social security number by its ranges. Valid ones are replaced by a keyed permutation within their format, so pseudonyms
are valid again: their digits go through a Feistel network whose round function is SHA-256 over key, kind, length, round
and half. Signs, spaces and lengths stay. Card numbers keep their first six digits and get a fitting Luhn digit;
addresses are permuted over all 2^32 addresses, social security numbers over the 898 * 99 * 9999 valid ones, dates over
the 400 years from 1800 on, whichever way they are written, so that one day has one pseudonym in all forms. Letters and
digits of e-mail names, small and capital letters being the same, are permuted among all of their number at their domain,
which stays. Equal values get equal pseudonyms in every document under one key. The key is a literal of the plan: who may read plans or event logs can undo
the permutations.

Covered forms: dates as 1999-12-31, 1999/12/31, 1999.12.31, 31.12.1999, 12/31/1999 (month first), 31 December 1999,
31 Dec 1999 and December 31, 1999; cards in groups of four, as 4-6-5, or without a break; phones with a country code, an area code in
brackets, or as 3-3-4 digits with dashes or dots. A candidate begins at the text's begin or behind anything but letters,
digits, "_" and "+", and behind "." and "-" only if no digit stands before those.

Defined results: a null text stays null, an empty one empty; texts of any length are read whole; what does not validate
stays as it is; ids may be null or repeated; a row for each row of docs, with their columns, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6
_YEAR, _MONTH, _DAY = r"(?:1[89]|2[01])\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
_LONG = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_SHORT = "(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_PLAIN_DAY = r"(?:[1-9]|[12]\d|3[01])"
#: Forms of dates, with Spark's format for each.
DATES = (
    (f"{_YEAR}-{_MONTH}-{_DAY}", "yyyy-MM-dd"), (f"{_YEAR}/{_MONTH}/{_DAY}", "yyyy/MM/dd"), (rf"{_YEAR}\.{_MONTH}\.{_DAY}", "yyyy.MM.dd"),
    (rf"{_DAY}\.{_MONTH}\.{_YEAR}", "dd.MM.yyyy"), (f"{_MONTH}/{_DAY}/{_YEAR}", "MM/dd/yyyy"),
    (f"{_PLAIN_DAY} {_LONG} {_YEAR}", "d MMMM yyyy"), (f"{_PLAIN_DAY} {_SHORT} {_YEAR}", "d MMM yyyy"), (f"{_LONG} {_PLAIN_DAY}, {_YEAR}", "MMMM d, yyyy"),
)
#: Candidates by kind, in order of precedence; a candidate has no digit or letter at either side.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "date": "|".join(p for p, _ in DATES),
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}|\(\d{3}\) \d{3}-\d{4}|\+\d{1,3}(?:[ -]\d{2,4}){2,5}|(?:1-)?\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}",
    "card": r"\d{4}[ -]\d{6}[ -]\d{5}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{13,19}",
}
ANY = r"(?<![A-Za-z0-9_+])(?<![0-9][.-])(?:" + "|".join(PATTERNS.values()) + r")(?![A-Za-z0-9_@]|[.-][A-Za-z0-9])"
_BY_KIND = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}


def _network(left: Column, right: Column, wide: Column, narrow: Column, key: str, kind: str, size: Column, back: bool = False) -> tuple[Column, Column]:
    """Halves below wide and narrow after ROUNDS alternating additions of hashes of the other half; back undoes them.

    Each round is a step of aggregate(), so that the two halves are computed once and the expression stays small.
    """
    steps = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    sign = -1 if back else 1

    def turn(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        half = F.when(even, s["r"]).otherwise(s["l"])
        words = F.concat_ws("|", F.lit(key), F.lit(kind), size.cast("string"), k.cast("string"), half.cast("string"))
        h = F.conv(F.substring(F.sha2(words, 256), 1, 12), 16, 10).cast("long")
        return F.struct(F.when(even, F.pmod(s["l"] + sign * F.pmod(h, wide), wide)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * F.pmod(h, narrow), narrow)).alias("r"))

    out = F.aggregate(F.array(*(F.lit(k) for k in steps)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)
    return out["l"], out["r"]


def permuted_digits(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """A permutation of the digit strings of each length from 2 to 30."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    wide, narrow = F.pow(F.lit(10.0), h).cast("long"), F.pow(F.lit(10.0), n - h).cast("long")
    left, right = _network(F.substr(digits, F.lit(1), h).cast("long"), F.substr(digits, h + 1, n - h).cast("long"), wide, narrow, key, kind, n, back)
    return F.concat(F.lpad(left.cast("string"), h, "0"), F.lpad(right.cast("string"), n - h, "0"))


#: Letters and digits of e-mail names.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def permuted_name(name: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """A permutation of the strings of ALPHABET of each length from 1 to 64: a Feistel network whose halves are shifted letter by letter, by two hex digits each of a hash of the other half."""
    n = F.length(name)
    steps = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    sign = -1 if back else 1

    def shifted(half: Column, h: Column) -> Column:
        def letter(c: Column, i: Column) -> Column:
            by = F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
            return F.substr(F.lit(ALPHABET), F.pmod(F.instr(F.lit(ALPHABET), c) - 1 + sign * by, F.lit(36)) + 1, F.lit(1))

        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), letter), "")

    def turn(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        half = F.when(even, s["r"]).otherwise(s["l"])
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), tweak, n.cast("string"), k.cast("string"), half), 256)
        return F.struct(F.when(even, shifted(s["l"], h)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(shifted(s["r"], h)).alias("r"))

    cut = F.floor(n / 2).cast("int")
    start = F.struct(F.substr(name, F.lit(1), cut).alias("l"), F.substr(name, cut + 1, n - cut).alias("r"))
    out = F.aggregate(F.array(*(F.lit(k) for k in steps)), start, turn)
    return F.concat(out["l"], out["r"])


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum; doubled_from_right is 1 if the last digit counts twice, else 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1 - doubled_from_right, F.floor(d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _refilled(value: Column, digits: Column, kept: str = "[^0-9]") -> Column:
    """value with its digits replaced, in order, by digits; kept is the pattern of characters that stay instead."""
    chars = F.split(value, "")
    place = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), kept, ""))
    return F.array_join(F.transform(chars, lambda c, i: F.when(~c.rlike(kept), F.substr(digits, place(i), F.lit(1))).otherwise(c)), "")


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a candidate, or the candidate itself if it is not valid. back gives the original again (of an e-mail name in small letters)."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    # Cards: the first six digits stay, the rest but the last is permuted, the last fits.
    body = permuted_digits(F.substr(digits, F.lit(7), n - 7), key, "card", back)
    head = F.concat(F.substring(digits, 1, 6), body)
    card = _refilled(value, F.concat(head, F.pmod(-luhn_sum(head, 1), F.lit(10)).cast("string")))
    card_ok = n.between(13, 19) & (luhn_sum(digits, 0) % 10 == 0)
    # Addresses: two halves of 16 bits.
    part = F.transform(F.split(value, r"\."), lambda p: p.cast("int"))
    ip_ok = ~F.exists(part, lambda p: p > 255)
    l, r = _network(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, "ip", F.lit(4), back)
    ip = F.concat_ws(".", *(x.cast("int").cast("string") for x in (F.floor(l / 256), l % 256, F.floor(r / 256), r % 256)))
    # Dates: 146097 days are 189 times 773.
    first = F.lit("1800-01-01").cast("date")
    form = lambda pattern: value.rlike(f"^(?:{pattern})$")
    day, written = F.lit(None).cast("int"), F.lit(None).cast("string")
    for pattern, fmt in reversed(DATES):
        day = F.when(form(pattern), F.datediff(F.try_to_timestamp(value, F.lit(fmt)).cast("date"), first)).otherwise(day)
    date_ok = day.isNotNull()
    a, b = _network(F.floor(day / 773), day % 773, F.lit(189), F.lit(773), key, "date", F.lit(1), back)
    new_day = F.date_add(first, (a * 773 + b).cast("int"))
    for pattern, fmt in reversed(DATES):
        written = F.when(form(pattern), F.date_format(new_day, fmt)).otherwise(written)
    date = written
    # Phone numbers: the digits behind a country code.
    code = F.when(value.startswith("+"), F.length(F.regexp_extract(value, r"^\+(\d{1,3})", 1))).otherwise(F.lit(0))
    phone_ok = (n - code).between(7, 14)
    phone = _refilled(value, F.concat(F.substr(digits, F.lit(1), code), permuted_digits(F.substr(digits, code + 1, n - code), key, "phone", back)))
    area, group, serial = (F.substring(digits, p, n).cast("int") for p, n in ((1, 3), (4, 2), (6, 4)))
    ssn_ok = ~area.isin(0, 666) & (area < 900) & (group > 0) & (serial > 0)
    # Valid areas are numbered without a gap, and so are pairs of group and serial.
    l, r = _network(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", F.lit(9), back)
    parts = (l + F.when(l >= 665, 2).otherwise(1), F.floor(r / 9999) + 1, r % 9999 + 1)
    ssn = F.concat_ws("-", *(F.lpad(p.cast("long").cast("string"), w, "0") for p, w in zip(parts, (3, 2, 4))))
    name, domain = F.lower(F.substring_index(value, "@", 1)), F.substring_index(value, "@", -1)
    mixed = permuted_name(F.regexp_replace(name, "[^a-z0-9]", ""), key, F.lower(domain), back)
    mail = F.concat(_refilled(name, mixed, "[^a-z0-9]"), F.lit("@"), domain)
    out = F.when(value.rlike(_BY_KIND["email"]), mail)
    for kind, ok, new in (("date", date_ok, date), ("ip", ip_ok, ip), ("ssn", ssn_ok, ssn), ("phone", phone_ok, phone), ("card", card_ok, card)):
        out = out.when(value.rlike(_BY_KIND[kind]), F.when(ok, new).otherwise(value))
    return out.otherwise(value)


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(_BY_KIND.items()):
        out = F.when(value.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found: str | None = None) -> DataFrame:
    """docs with pseudonyms under the key in the text; found names a column to add, of (kind, value, pseudonym) structs in text order."""
    if not key:
        raise ValueError("pseudonyms need a key")
    value = F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0))
    stem = "_pii"
    while any(c.lower().startswith(stem) for c in docs.columns):
        stem += "_"
    old, new = f"{stem}_old", f"{stem}_new"
    wide = docs.withColumn(old, value).withColumn(new, F.transform(old, lambda v: pseudonym(v, key)))
    plain = F.split(F.col(text_col), ANY, -1)
    text = F.when(F.size(old) > 0, F.concat_ws("", F.flatten(F.zip_with(plain, F.col(new), lambda p, v: F.array(p, F.coalesce(v, F.lit("")))))))
    out = wide.withColumn(text_col, F.coalesce(text, F.col(text_col)))
    if found:
        out = out.withColumn(found, F.zip_with(old, new, lambda v, p: F.struct(kind_of(v).alias("kind"), v.alias("value"), p.alias("pseudonym"))))
    return out.drop(old, new)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str, key: str = "the query's own key, known to all") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymise(docs, key, found="found")
    changed = F.filter("found", lambda f: f["value"] != f["pseudonym"])
    return out.select("doc_id", F.size(changed).cast("long").alias("n_replaced"), F.array_join(F.transform(changed, lambda f: f["kind"]), ",").alias("kinds"), F.coalesce("text", F.lit("")).alias("text"))


QUERIES = {"op8_pii_pseudonyms": op8_pii_pseudonyms}
