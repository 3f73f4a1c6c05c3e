"""Expectations: each gives a row, or a flag, per violation; none stops at the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.functions.text import strip

# Fixed values.
RUBRIC = ("professionalism", "empathy", "resolution_effectiveness", "communication_clarity", "call_closure", "accuracy_of_information", "procedure_adherence")
SCORE_TOLERANCE = 0.25


def offsets_ok(start: Column, end: Column, text: Column) -> Column:
    return (start >= 0) & (end > start) & (end - start == F.length(text))


def not_blank(text: Column) -> Column:
    return strip(text) != ""


def chronological(times: Column) -> Column:
    """Of an array of times: none before its predecessor."""
    return F.forall(F.zip_with(times, F.slice(times, 2, F.greatest(F.size(times), F.lit(1))), lambda a, b: F.coalesce(a <= b, F.lit(True))), lambda ok: ok)


def review_flag_ok(confidence: Column, flag: Column, threshold: float) -> Column:
    return ~((confidence < threshold) & ~flag)


def missing(have: Column, wanted: tuple[str, ...] = RUBRIC) -> Column:
    return F.array_except(F.array(*map(F.lit, wanted)), have)


def unexpected(have: Column, wanted: tuple[str, ...] = RUBRIC) -> Column:
    return F.array_except(have, F.array(*map(F.lit, wanted)))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def verdicts_ok(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(call_id, claim_id) on each side: what is missing and what is unknown, per call."""
    a = claims.select("call_id", "claim_id", F.lit(True).alias("_a"))
    b = verdicts.select("call_id", "claim_id", F.lit(True).alias("_b"))
    odd = a.join(b, ["call_id", "claim_id"], "full").filter("_a is null or _b is null")
    return odd.groupBy("call_id").agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("unknown"))


def first_difference(counts_differ: Column, deadlines: Column, flags_differ: Column, deltas: Column) -> Column:
    """The first difference in fixed order: number of commitments, deadline presence by index, flag ids, scores beyond the tolerance."""
    index = F.array_position(deadlines, True)
    score = F.array_position(F.transform(deltas, lambda d: F.abs(d) > SCORE_TOLERANCE), True)
    names = F.array(*map(F.lit, RUBRIC))
    return (
        F.when(counts_differ, "commitments")
        .when(index > 0, F.concat(F.lit("commitments["), (index - 1).cast("string"), F.lit("].deadline")))
        .when(flags_differ, "compliance_flags")
        .when(score > 0, F.concat(F.lit("rubric_scores["), F.get(names, (score - 1).cast("int")), F.lit("]")))
    )
