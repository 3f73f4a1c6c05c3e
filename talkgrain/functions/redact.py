"""Structured personal data in transcripts: nine ordered patterns, protected spans, and audits of what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order, labels and patterns decide results and so must be these. (?U) gives Unicode digits and words.
BEFORE, AFTER, GAP = "(?<![\\d+])", "(?!\\d)", "[ .\\-]?"
PATTERNS = (
    ("[EMAIL]", "\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b"),
    ("[IBAN]", "\\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[A-Z0-9]{10,20}\\b"),
    ("[PHONE]", f"{BEFORE}(?:\\+|00)\\d{{1,3}}(?:{GAP}\\(?\\d{{1,4}}\\)?){{2,5}}{AFTER}"),
    ("[CARD]", "\\b\\d{4}(?:[ -]?\\d{4}){2,4}\\b"),
    ("[NATIONAL_ID]", "\\b\\d{10}\\b"),
    ("[PHONE]", f"{BEFORE}(?<!\\d[ .\\-])[0٠](?:{GAP}\\d){{8,9}}{AFTER}"),
    ("[PHONE]", f"{BEFORE}\\(?\\d{{3}}\\)?{GAP}\\d{{3}}[ .\\-]\\d{{4}}{AFTER}"),
    ("[PHONE]", f"{BEFORE}\\d{{3}}[ .\\-]\\d{{4}}{AFTER}"),
    ("[NUMBER]", f"{BEFORE}\\d(?:[ \\-]?\\d){{6,}}{AFTER}"),
)
# Fixed values as well: what is left alone.
HEX = "[0-9a-fA-F]"
PROTECTED = (
    f"\\b{HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}\\b"
    "|\\b[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
)


def _step(label: str, pattern: str) -> Callable[[Column], Column]:
    """One search: what lies between the matches gives both the text with labels and their number."""
    return lambda s: F.struct(F.array_join(s["p"], label).alias("t"), (s["n"] + F.size(s["p"]) - 1).alias("n"))


def _segment(text: Column) -> Column:
    """Struct of the redacted piece and its count; every pattern sees what the ones before it left."""
    state = F.struct(text.alias("t"), F.lit(0).alias("n"))
    for label, pattern in PATTERNS:
        parts = F.transform(F.array(state), lambda s: F.struct(F.split(s["t"], f"(?U){pattern}", -1).alias("p"), s["n"].alias("n")))  # noqa: B023  computed once per piece
        state = F.get(F.transform(parts, _step(label, pattern)), 0)
    return state


def redacted(text: Column) -> Column:
    """Struct: text, original_length, count. Identifiers and machine timestamps are left alone. A text without a digit or an @ has nothing to find."""
    clean = F.struct(text.alias("text"), F.length(text).alias("original_length"), F.lit(0).alias("count"))
    return F.when(text.rlike("(?U)[\\d@]"), _redacted(text)).when(text.isNotNull(), clean)


def _redacted(text: Column) -> Column:
    kept = F.regexp_extract_all(text, F.lit(f"(?U)({PROTECTED})"), F.lit(0))
    pieces = F.transform(F.split(text, f"(?U){PROTECTED}", -1), _segment)

    def join(done: Column) -> Column:
        woven = F.zip_with(done, F.concat(kept, F.array(F.lit(""))), lambda p, k: F.concat(p["t"], k))
        return F.struct(F.array_join(woven, "").alias("text"), F.length(text).alias("original_length"), F.aggregate(done, F.lit(0), lambda s, p: s + p["n"]).alias("count"))

    return F.get(F.transform(F.array(pieces), join), 0)


def digit_runs(text: Column, least: int = 7) -> Column:
    runs = F.regexp_extract_all(text, F.lit("((?U)\\d(?:[ .\\-]?\\d)*)"), F.lit(0))
    return F.filter(runs, lambda r: F.length(F.regexp_replace(r, "(?U)\\D", "")) >= least)


def shape(run: Column) -> Column:
    return F.regexp_replace(run, "(?U)\\d", "d")


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(\\[[A-Z_]+\\])"), F.lit(0))
