"""Text columns: speakers, scripts, tokens, quotes, normalisation, edit distance, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide results and so must be these.
SPEAKERS = ("Agent", "Customer")
ARABIC = "[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"
LATIN = "[A-Za-z]"
PLACEHOLDER = "\\[[A-Z_]+\\]"
DIACRITICS = "[ً-ٰٟـ]"
FOLD_FROM = "أإآٱىةؤئ٠١٢٣٤٥٦٧٨٩"
FOLD_TO = "اااايهوي0123456789"
APOSTROPHE = "(?<=[A-Za-z])['‘’ʼ](?=[A-Za-z])"
PUNCTUATION = "[.,!?;:\\-–—_'\"“”‘’()\\[\\]{}/\\\\«»…،؛؟٪]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def speaker_of(line: Column) -> Column:
    """The speaker that a line's prefix names, or null."""
    return F.nullif(F.regexp_extract(line, f"^({'|'.join(SPEAKERS)}):\\s*", 1), F.lit(""))


def said(line: Column) -> Column:
    """A line without its prefix."""
    return strip(F.regexp_replace(line, f"^(?:{'|'.join(SPEAKERS)}):\\s*", ""))


def script_class(text: Column) -> Column:
    """ar, mixed or en by script; placeholders do not count."""
    bare = F.regexp_replace(text, PLACEHOLDER, "")
    return F.when(bare.rlike(ARABIC) & bare.rlike(LATIN), "mixed").when(bare.rlike(ARABIC), "ar").otherwise("en")


def direction(text: Column) -> Column:
    """rtl if Arabic letters outnumber Latin ones."""
    return F.when(F.regexp_count(text, F.lit(ARABIC)) > F.regexp_count(text, F.lit(LATIN)), "rtl").otherwise("ltr")


def tokens(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("((?U)\\w+)"), F.lit(0)), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Of token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def is_verbatim(text: Column, quote: Column) -> Column:
    return F.coalesce((quote != "") & text.contains(quote), F.lit(False))


def first_offset(text: Column, quote: Column) -> Column:
    """0-based, null if absent."""
    at = F.locate(quote, text) if isinstance(quote, str) else F.call_function("locate", quote, text)
    return F.when(is_verbatim(text, quote), at - 1)


def all_offsets(text: Column, quote: Column) -> Column:
    """0-based starts of the non-overlapping occurrences, from the lengths of what lies between them."""
    parts = F.call_function("split", text, F.concat(F.lit("\\Q"), quote, F.lit("\\E")), F.lit(-1))
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("end"))
    step = lambda s, p: F.struct(F.array_append(s["at"], s["end"] + F.length(p)).alias("at"), (s["end"] + F.length(p) + F.length(quote)).alias("end"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda s: s["at"])


def overlapping_offsets(text: Column, quote: Column) -> Column:
    """0-based starts of all occurrences, overlapping ones too."""
    n = F.length(text) - F.length(quote) + 1
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i + 1, F.length(quote)) == quote)).otherwise(F.array().cast("array<int>"))


def normalised(text: Column) -> Column:
    """For word error rates: no diacritics, folded letters and digits, lower case, no punctuation, single spaces."""
    x = F.translate(F.regexp_replace(text, DIACRITICS, ""), FOLD_FROM, FOLD_TO)
    x = F.regexp_replace(F.regexp_replace(F.lower(x), APOSTROPHE, ""), PUNCTUATION, " ")
    return F.trim(F.regexp_replace(x, "(?U)\\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance between arrays of words: each distinct word of the two becomes one private-use character."""
    known = F.array_distinct(F.concat(a, b))

    def written(x: Column) -> Column:
        codes = F.transform(x, lambda w: F.lpad(F.hex(F.lit(0xF0000) + F.array_position(known, w)), 8, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")

    return F.levenshtein(written(a), written(b))


def word_error_rate(errors: Column, reference_words: Column) -> Column:
    return F.when(reference_words == 0, F.when(errors == 0, 0.0).otherwise(1.0)).otherwise(errors / reference_words)


def topic(path: Column) -> Column:
    """An error path without its indexes."""
    return F.regexp_replace(path, "\\[[^\\]]*\\]", "")


def json_slice(text: Column) -> Column:
    """From the first brace to the last."""
    return F.nullif(F.regexp_extract(text, "(?s)\\{.*\\}", 0), F.lit(""))


def waiting(seconds: Column) -> Column:
    """1h 42m, 12m, <1m."""
    m = F.floor(seconds / 60)
    return F.when(m < 1, "<1m").when(m < 60, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m")))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits, or a dash for none."""
    return F.when(x.isNull(), "—").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def signed(x: Column, digits: int) -> Column:
    """A difference with its sign; what rounds to zero has none; a dash for none."""
    text = fixed(F.abs(x), digits)
    zero = F.regexp_replace(text, "[0.]", "") == ""
    return F.when(x.isNull(), "—").when(zero, text).otherwise(F.concat(F.when(x < 0, "−").otherwise("+"), text))
