"""Quality metrics, always per category: rubric agreement, grounding, word errors, reviewers, service figures, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions import text as T
from talkgrain.operators.quantiles import with_quantiles

#: The four quality figures of a benchmark cell.
CELL_METRICS = ("accuracy", "rubric_agreement", "grounding_precision", "unsupported_rate")


def last_per(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key, as an overwritten mapping would keep it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def first_per(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def rubric_agreement(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """language, agreement: per call 1 - mean difference over shared criteria (0 if none is shared), then the mean of calls."""
    paired = references.select("call_id", "language").distinct().join(predictions.select("call_id").distinct(), "call_id")
    p = last_per(predictions, ["call_id", "criterion"], "pos").select("call_id", "criterion", F.col("score").alias("_p"))
    shared = references.join(p, ["call_id", "criterion"]).groupBy("call_id").agg((1 - F.avg(F.abs(F.col("_p") - F.col("score")))).alias("a"))
    per_call = paired.join(shared, "call_id", "left").withColumn("a", F.coalesce("a", F.lit(0.0)))
    return per_call.groupBy("language").agg(F.round(F.avg("a"), 6).alias("agreement"), F.count(F.lit(1)).alias("calls"))


def pooled_support(quotes: DataFrame) -> DataFrame:
    """quotes (language, kind, supported): precision over all quotes and unsupported rate over claims, pooled."""
    claim = F.col("kind") != "sentiment"
    return quotes.groupBy("language").agg(
        F.round(F.avg(F.col("supported").cast("double")), 6).alias("grounding_precision"),
        F.round(1 - F.avg(F.when(claim, F.col("supported").cast("double"))), 6).alias("unsupported_rate"),
        F.count(F.lit(1)).alias("quotes"),
    )


def word_errors(pairs: DataFrame) -> DataFrame:
    """pairs (language, reference, hypothesis) and: reference_words, errors, wer; texts are normalised first."""
    out = pairs.withColumn("_r", T.words(T.normalised(F.col("reference")))).withColumn("_h", T.words(T.normalised(F.col("hypothesis"))))
    out = out.withColumn("reference_words", F.size("_r")).withColumn("errors", T.token_distance(F.col("_r"), F.col("_h")))
    return out.withColumn("wer", T.word_error_rate(F.col("errors"), F.col("reference_words"))).drop("_r", "_h")


def wer_pooled(scored: DataFrame) -> DataFrame:
    """All errors over all reference words of a category."""
    return scored.groupBy("language").agg(F.round(F.coalesce(F.try_divide(F.sum("errors"), F.sum("reference_words")), F.lit(0.0)), 6).alias("wer_pooled"))


def wer_mean(scored: DataFrame) -> DataFrame:
    """The mean of the calls' own rates; never the same number as wer_pooled but for equal lengths."""
    return scored.groupBy("language").agg(F.round(F.avg("wer"), 6).alias("wer_mean"))


def wer_weighted(scored: DataFrame) -> DataFrame:
    """Rates rounded to four places, weighted by the words of the raw reference."""
    raw = F.size(T.words(T.strip(F.regexp_replace("reference", "(?U)\\s+", " "))))
    return scored.groupBy("language").agg(F.round(F.try_divide(F.sum(F.round("wer", 4) * raw), F.sum(raw)), 6).alias("wer_weighted"))


def reviewer_agreement(verdicts: DataFrame) -> DataFrame:
    """verdicts (language, review_id, verdict): claims pooled; a review agrees if it confirms everything."""
    per = verdicts.groupBy("language", "review_id").agg(F.count("verdict").alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("confirm", "correct", "reject")])
    return per.groupBy("language").agg(
        F.count(F.lit(1)).alias("reviews"), F.sum("n").alias("claims"), F.sum("confirm").alias("confirmed"), F.sum("correct").alias("corrected"), F.sum("reject").alias("rejected"),
        F.round(F.try_divide(F.sum("confirm"), F.sum("n")), 6).alias("claim_rate"), F.round(F.avg((F.col("confirm") == F.col("n")).cast("double")), 6).alias("call_rate"),
    )


def rate(numerator: Column, n: Column) -> Column:
    """value (null for n = 0) with its n."""
    return F.struct(F.try_divide(numerator, n).alias("value"), n.alias("n"))


def quantiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact p50 and p95, interpolated; null values do not count."""
    figures = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    return with_quantiles(figures, rows, keys, {"_q": F.col(value)}, {"_q": ("p50", "p95")})


def service(calls: DataFrame) -> DataFrame:
    """calls (language, attempts, status, queued, started, finished in seconds): waits, times, retries, failures, throughput."""
    wait, took = F.col("started") - F.col("queued"), F.col("finished") - F.col("started")
    figures = calls.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("attempts") > 1).cast("double")), 6).alias("retry_rate"), F.round(F.avg((F.col("status") == "failed").cast("double")), 6).alias("failure_rate"),
        F.round(F.try_divide(F.count(F.lit(1)) * 60, F.max("finished") - F.min("queued")), 6).alias("calls_per_minute"),
    )
    return with_quantiles(figures, calls, ["language"], {"_w": wait, "_t": took}, {"_w": ("wait_p50", "wait_p95"), "_t": ("time_p50", "time_p95")})


def benchmark_cells(records: DataFrame) -> DataFrame:
    """records (arm, language, outcome, latency, tokens, and, if known, the four metrics of valid calls and latency_n): a cell per arm and language.

    latency_n counts the latencies that were measured and falls back to n where it is null throughout.
    """
    ok = F.col("outcome") == "ok"
    more = [F.round(F.avg(F.when(ok, F.col(m))), 6).alias(m) for m in CELL_METRICS if m in records.columns]
    if "latency_n" in records.columns:
        more.append(F.coalesce(F.sum("latency_n"), F.count(F.lit(1))).alias("latency_n"))
    figures = records.groupBy("arm", "language").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"), F.round(F.avg(ok.cast("double")), 6).alias("valid_rate"), F.count_if(~ok).alias("errors"), F.round(F.avg("tokens"), 6).alias("tokens"), *more
    )
    return with_quantiles(figures, records, ["arm", "language"], {"_q": F.when(ok, F.col("latency"))}, {"_q": ("p50", "p95")})


def paired_verdict(scores: DataFrame) -> DataFrame:
    """scores (language, repeat, arm on|off, accuracy): effect is the mean difference, noise the larger range of off and difference."""
    wide = scores.groupBy("language", "repeat").pivot("arm", ["off", "on"]).agg(F.avg("accuracy")).withColumn("d", F.col("on") - F.col("off"))
    out = wide.groupBy("language").agg(
        F.round(F.avg("d"), 6).alias("effect"), F.round(F.greatest(F.max("off") - F.min("off"), F.max("d") - F.min("d")), 6).alias("noise"), F.count("d").alias("repeats")
    )
    verdict = F.when(F.col("repeats") < 2, "incomplete").when(F.abs("effect") <= F.col("noise"), "inconclusive").when(F.col("effect") > 0, "confirms").otherwise("contradicts")
    return out.withColumn("verdict", verdict)


def trend(points: DataFrame) -> DataFrame:
    """points (series, at, value): first against last known value."""
    known = points.filter(F.col("value").isNotNull())
    ends = known.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "value")).alias("a"), F.max(F.struct("at", "value")).alias("b"))
    ends = points.select("series").distinct().join(ends, "series", "left")
    way = F.when(F.coalesce("n", F.lit(0)) < 2, "insufficient").when(F.col("b.value") > F.col("a.value"), "rising").when(F.col("b.value") < F.col("a.value"), "falling").otherwise("flat")
    return ends.select("series", F.coalesce("n", F.lit(0)).alias("n"), way.alias("trend"))


def speaker_accuracy(grid: DataFrame) -> DataFrame:
    """grid (language, call_id, reference, hypothesis) per frame: share of spoken frames with the right speaker, mean of calls."""
    per = grid.filter(F.col("reference").isNotNull()).groupBy("language", "call_id").agg(F.avg((F.col("reference") == F.coalesce("hypothesis", F.lit(""))).cast("double")).alias("a"))
    return per.groupBy("language").agg(F.round(F.avg("a"), 6).alias("accuracy"), F.count(F.lit(1)).alias("calls"))
