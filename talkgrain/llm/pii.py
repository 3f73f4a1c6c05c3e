"""Personal data: format-preserving pseudonyms (built-in functions only).

Found values are validated, then replaced inside the text:

- card numbers (13 to 19 digits whose last is their Luhn digit; others are no cards and stay): the digits but the check
  digit are permuted by a keyed Feistel network over their number, and the check digit is made anew;
- phone numbers (7 to 15 digits after validation): the digits after the country code are permuted, separators stay; the
  code is told by its first digits, so a number is linked however it is written;
- dates (ISO or day/month/year, real calendar days of 1900 to 2099): the day's number is permuted among these days by
  cycle-walking, and written as the old one was;
- addresses of four numbers 0 to 255: the 32 bits are permuted;
- mail addresses (parts as long as the mail standards allow, 64 and 63 letters): a keyed digest names the same mailbox everywhere;
- keys and passwords, their key words in any case: a keyed digest in brackets.

Equal values of a kind give equal pseudonyms in all documents, different ones give different ones (numbers, dates,
addresses: exactly; digests: to 64 bits). Defined results: a null text stays null with nothing found; a text without
findings is returned as it was; every row gets its result, a null id too; columns of the table that are named n_found or
kinds are replaced, all others stay. The patterns work in linear time and without recursion on texts of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import fresh, let

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31

#: What is looked for, in order of precedence at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+",
    "secret": r"AKIA[0-9A-Z]{16}\b|\b(?i:password|passwd|token|secret|api_key)\s?[=:]\s?\"?[0-9A-Za-z_-]{12,}\"?",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)",
    "date": r"(?<![\d/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/-])",
    "card": r"(?<!\d)(?<!\d\.)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\w)",
}
#: Country codes of two digits; 1 and 7 are codes of one digit, all others have three.
TWO_DIGITS = "20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-5]|98"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _draw(key: str, kind: str, half: Column, i: Column) -> Column:
    """A non-negative number that key, kind, round and half decide."""
    return F.xxhash64(F.lit(f"{key}/{kind}"), i, half).bitwiseAND(F.lit((1 << 62) - 1))


def feistel(x: Column, left: Column, right: Column, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. left*right-1: x is read as two digits of radix left and right, which take turns."""
    start = F.struct(F.rint((x - F.pmod(x, right)) / right).cast("long").alias("a"), F.pmod(x, right).cast("long").alias("b"), left.cast("long").alias("ma"), right.cast("long").alias("mb"))

    def turn(s: Column, i: Column) -> Column:
        moved = F.pmod(s["a"] + F.pmod(_draw(key, kind, s["b"], i), s["ma"]), s["ma"])
        return F.struct(s["b"].alias("a"), moved.alias("b"), s["mb"].alias("ma"), s["ma"].alias("mb"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["a"] * s["mb"] + s["b"])


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of up to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    halves = [F.pow(F.lit(10), F.floor(n / 2)).cast("long"), F.pow(F.lit(10), n - F.floor(n / 2)).cast("long")]
    return F.lpad(feistel(digits.cast("long"), halves[0], halves[1], key, kind).cast("string"), n.cast("int"), F.lit("0"))


def check_digit(digits: Column) -> Column:
    """The Luhn digit for a number without it."""
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + weighed(i))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def luhn_ok(digits: Column) -> Column:
    return let(digits, lambda d: let(F.substring(d, F.lit(1), F.length(d) - 1), check_digit) == F.substring(d, -1, 1))


def refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by others, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(is_digit, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["out"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _tag(v: Column, key: str, kind: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{key}/{kind}/"), v), 256), 1, 16)


def _card(v: Column, key: str) -> Column:
    def swapped(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        return let(permuted_digits(body, key, "card"), lambda new: F.concat(new, check_digit(new)))

    return let(let(_digits(v), swapped), lambda new: refilled(v, new))


def _phone(v: Column, key: str) -> Column:
    code = F.when(v.startswith("+"), F.length(F.regexp_extract(_digits(v), f"^(?:[17]|{TWO_DIGITS}|\\d{{3}})", 0))).otherwise(F.lit(0))
    new = let(_digits(v), lambda d: F.concat(F.substring(d, F.lit(1), code), permuted_digits(F.substring(d, code + 1, F.length(d)), key, "phone")))
    return let(new, lambda x: refilled(v, x))


def _day(v: Column) -> Column:
    """The number of a real day of the range, else null."""
    iso = F.when(v.contains("/"), F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2))).otherwise(v)
    n = F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    return F.when(n.between(0, DAYS - 1), n)


def _date(v: Column, key: str) -> Column:
    """Cycle-walking: the network permutes a few more numbers than there are days; it is applied until a day comes out."""
    side = 271  # 271 x 271 = 73441, the least square beyond DAYS
    once = lambda x: feistel(x, F.lit(side), F.lit(side), key, "date")
    new = F.aggregate(F.sequence(F.lit(1), F.lit(side * side - DAYS)), once(_day(v)), lambda x, _: F.when(x < DAYS, x).otherwise(once(x)))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int"))
    return F.when(v.contains("/"), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))


def _octets(v: Column) -> Column:
    return F.transform(F.split(v, "\\."), lambda x: x.cast("long"))


def _ip(v: Column, key: str) -> Column:
    n = F.aggregate(_octets(v), F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    written = lambda new: F.concat_ws(".", *[F.shiftrightunsigned(new, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    return let(feistel(n, F.lit(65_536), F.lit(65_536), key, "ip"), written)


def kind_of(v: Column) -> Column:
    """The kind of a found value, null if it does not pass its validation."""
    full = lambda k: v.rlike(f"^(?:{PATTERNS[k]})$")
    n = F.length(_digits(v))
    return (
        F.when(v.contains("@"), F.lit("email"))
        .when(full("secret"), F.lit("secret"))
        .when(v.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.when(F.forall(_octets(v), lambda x: x < 256), F.lit("ip")))
        .when(v.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"), F.when(_day(v).isNotNull(), F.lit("date")))
        .when(full("phone") & n.between(7, 15), F.lit("phone"))
        .when(full("card") & n.between(13, 19), F.when(luhn_ok(_digits(v)), F.lit("card")))
    )


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", F.concat(F.lit("u"), _tag(F.lower(v), key, "email"), F.lit("@mail.invalid")))
        .when(kind == "secret", F.concat(F.lit("[SECRET "), _tag(v, key, "secret"), F.lit("]")))
        .when(kind == "ip", _ip(v, key))
        .when(kind == "date", _date(v, key))
        .when(kind == "phone", _phone(v, key))
        .when(kind == "card", _card(v, key))
        .otherwise(v)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text replaced, and: n_found, kinds (sorted, distinct)."""
    text = F.col(text_col)
    values = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0))
    # texts without a digit followed by two more, an @ or a key word hold none of the patterns; the others are searched
    found, made = fresh(docs, "_v"), fresh(docs, "_f")
    rows = docs.withColumn(found, F.when(text.rlike(r"[0-9][^0-9a-zA-Z]{0,2}[0-9]|@|AKIA|(?i:passw|token|secret|api_key)"), values))
    rows = rows.withColumn(made, F.when(F.size(found) > 0, F.transform(found, lambda v: F.struct(v.alias("v"), kind_of(v).alias("k")))))
    pieces = F.split(text, ANY, -1)
    new = F.transform(made, lambda x: pseudonym(x["v"], x["k"], key))
    woven = F.concat_ws("", F.flatten(F.zip_with(pieces, F.concat(new, F.array(F.lit(""))), lambda p, n: F.array(p, n))))
    kinds = F.filter(F.transform(made, lambda x: x["k"]), lambda k: k.isNotNull())
    out = [F.when(F.col(made).isNotNull(), woven).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_found", "kinds")]
    return rows.select(*out, F.coalesce(F.size(kinds), F.lit(0)).alias("n_found"), F.coalesce(F.array_sort(F.array_distinct(kinds)), F.array().cast("array<string>")).alias("kinds"))
