"""Figures of benchmark arms, recognisers, rules and reviews; views for the queue, the dashboard and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions.text import jaccard
from talkgrain.operators.quantiles import with_quantiles
from talkgrain.sources import files

# Fixed values.
FLAT, SLOW_SECONDS, WALL_FACTOR = 0.1, 3600, 1.25
CONTRACTIONS = (
    "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't", "can't", "couldn't", "won't", "wouldn't", "shouldn't", "mustn't",
    "i'm", "i've", "i'd", "i'll", "you're", "you've", "you'd", "you'll", "we're", "we've", "we'd", "we'll", "they're", "they've", "they'd", "they'll",
    "he's", "she's", "it's", "that's", "there's", "here's", "what's", "who's", "let's", "ma'am", "y'all", "o'clock",
)
STRIPPED = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~،؛؟“”‘’"
BANNED = ("فندم", "إزاي", "خالص", "معلش", "عايز", "فين", "كده", "النهاردة")


def throughput(calls: DataFrame, spans: DataFrame) -> DataFrame:
    """calls (arm, latency, tokens, concurrency), spans (arm, seconds): per minute; a lone worker that slept counts its own latencies instead."""
    own = F.when((F.col("concurrency") == 1) & (F.col("latency") > SLOW_SECONDS), None).otherwise(F.col("latency"))
    c = calls.groupBy("arm").agg(F.count(own).alias("calls"), F.sum(own).alias("busy"), F.sum(F.when(own.isNotNull(), F.col("tokens"))).alias("tokens"), F.max("concurrency").alias("concurrency"))
    both = c.join(spans.groupBy("arm").agg(F.sum("seconds").alias("wall")), "arm", "left")
    used = F.when((F.col("concurrency") == 1) & (F.col("wall") > WALL_FACTOR * F.col("busy")), F.col("busy")).otherwise(F.col("wall"))
    both = both.withColumn("seconds", F.nullif(used, F.lit(0.0)))
    return both.select("arm", "calls", F.round(F.col("calls") / F.col("seconds") * 60, 6).alias("calls_per_minute"), F.round(F.col("tokens") / F.col("seconds"), 6).alias("tokens_per_second"))


def token_cost(prompt: Column, completion: Column, per_million_in: float, per_million_out: float) -> Column:
    """Per 1000 calls, from mean tokens."""
    return (prompt * per_million_in + completion * per_million_out) / 1000


def hourly_cost(hourly: float, seconds_per_token: Column, tokens_per_call: Column) -> Column:
    return F.lit(hourly) / 3600 * seconds_per_token * tokens_per_call * 1000


def recogniser(rows: DataFrame) -> DataFrame:
    """rows (language, audio_s, total_s, stage_s?): pooled real-time factor and its inverse over the timed rows, and a stage's factor over the rows that have it."""
    has, timed = F.col("stage_s").isNotNull(), F.col("total_s").isNotNull()
    figures = rows.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("total_s"), 6).alias("mean_s"), F.round(F.max("total_s"), 6).alias("max_s"),
        F.round(F.try_divide(F.sum("total_s"), F.sum(F.when(timed, F.col("audio_s")))), 6).alias("rtf"), F.round(F.try_divide(F.sum(F.when(timed, F.col("audio_s"))), F.sum("total_s")), 6).alias("speed"),
        F.round(F.try_divide(F.sum("stage_s"), F.sum(F.when(has, F.col("audio_s")))), 6).alias("stage_rtf"),
    )
    return with_quantiles(figures, rows, ["language"], {"_q": F.col("total_s")}, {"_q": ("median_s", "_p95")}).drop("_p95")


def sentiment_direction(first: Column, last: Column, n: Column) -> Column:
    return F.when(n < 2, "unknown").when(F.abs(last - first) < FLAT, "flat").when(last > first, "up").otherwise("down")


def commitment_agreement(n_p: Column, n_r: Column, best: Column) -> Column:
    """Both empty 1, one empty 0, else half for the counts and half for the best matches' mean."""
    return F.when((n_p == 0) & (n_r == 0), 1.0).when((n_p == 0) | (n_r == 0), 0.0).otherwise(0.5 * (1 - F.abs(n_p - n_r) / F.greatest(n_p, n_r)) + 0.5 * best)


def best_matches(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """(call_id, words) on each side: per call the mean over reference items of the best overlap."""
    both = reference.withColumn("_i", F.monotonically_increasing_id()).join(predicted.select("call_id", F.col("words").alias("_w")), "call_id")
    best = both.groupBy("call_id", "_i").agg(F.max(jaccard(F.col("words"), F.col("_w"))).alias("b"))
    return best.groupBy("call_id").agg(F.avg("b").alias("best"))


def accuracy(calls: DataFrame) -> DataFrame:
    """calls (language, summaries, commitments, flags, direction as 0..1): mean of four parts, then of calls."""
    return calls.groupBy("language").agg(F.round(F.avg((F.col("summaries") + F.col("commitments") + F.col("flags") + F.col("direction")) / 4), 6).alias("accuracy"), F.count(F.lit(1)).alias("calls"))


def dashboard(languages: DataFrame, pending: DataFrame, reviews: DataFrame, rules: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Every language, always: pending reviews, confirmed share of claims with n, active rules (one counts in each of its languages), open conflicts."""
    n = lambda df, name: df.groupBy("language").agg(F.count(F.lit(1)).alias(name))
    agreed = reviews.groupBy("language").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("verdict") == "confirm").alias("confirmed"))
    active = rules.select("rule_id", F.explode("languages").alias("language")).distinct()
    out = languages.join(n(pending, "pending"), "language", "left").join(agreed, "language", "left").join(n(active, "active_rules"), "language", "left").join(n(conflicts, "open_conflicts"), "language", "left")
    out = out.fillna(0, ["pending", "claims", "confirmed", "active_rules", "open_conflicts"])
    return out.select("language", "pending", "claims", F.round(F.try_divide("confirmed", "claims"), 6).alias("agreement"), "active_rules", "open_conflicts")


def rule_languages(rules: DataFrame, sources: DataFrame, order: DataFrame) -> DataFrame:
    """rules (rule_id, source_ids), sources (source_id, language), order (language, ord): each rule's languages in their order; none is an empty list."""
    met = rules.select("rule_id", F.explode_outer("source_ids").alias("source_id")).join(sources, "source_id", "left").join(F.broadcast(order), "language", "left")  # a language is one of a few
    names = F.transform(F.array_sort(F.collect_set(F.when(F.col("language").isNotNull(), F.struct("ord", "language")))), lambda x: x["language"])
    return met.groupBy("rule_id").agg(names.alias("languages"))


def conflict_view(conflicts: DataFrame, rules: DataFrame) -> DataFrame:
    """conflicts (id, conflicting: rule ids), rules (rule_id, text, retired): a deleted rule has no text and is not active."""
    each = conflicts.select("id", F.posexplode("conflicting").alias("pos", "rule_id"))
    return each.join(rules, "rule_id", "left").select("id", "pos", "rule_id", "text", F.coalesce(~F.col("retired"), F.lit(False)).alias("active"))


def queue(calls: DataFrame, n: int = 100) -> DataFrame:
    """The first n (at most 500) that wait for review, those finished first first."""
    return calls.orderBy(F.coalesce("finished_at", "queued_at"), "call_id").limit(min(n, 500))


def recent(rows: DataFrame, owner: str, key: str, at: str, n: int = 5) -> DataFrame:
    """Per owner the n keys used last, newest first."""
    last = rows.groupBy(owner, key).agg(F.max(at).alias(at))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at)))).filter(F.col("rank") <= n)


def linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Single linkage: node, cluster (its smallest member), by large-star and small-star steps until only stars are left; chains of any length end."""
    edges = files.kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct()  # greater neighbours to the smallest one
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        edges = files.kept(small.filter("a <> b").distinct())
        centres = edges.groupBy("b").agg(F.count(F.lit(1)).alias("k"))
        if centres.filter("k > 1").isEmpty() and edges.select(F.col("a").alias("b")).join(edges.select("b"), "b", "left_semi").isEmpty():
            return nodes.select("node").join(edges, F.col("node") == F.col("b"), "left").select("node", F.coalesce("a", "node").alias("cluster"))


def _mixed(word: Column) -> Column:
    core = F.btrim(word, F.lit(STRIPPED))
    return core.rlike("[\\x{0600}-\\x{06FF}]") & core.rlike("[A-Za-z]")


def violations(texts: DataFrame) -> DataFrame:
    """texts (call_id, text): banned words, and words of two scripts; punctuation around a word is of no script."""
    banned = texts.select("call_id", F.explode(F.filter(F.array(*map(F.lit, BANNED)), lambda w: F.col("text").contains(w))).alias("what")).withColumn("kind", F.lit("banned"))
    mixed = texts.select("call_id", F.explode(F.filter(F.split("text", "(?U)\\s+"), _mixed)).alias("what")).withColumn("kind", F.lit("mixed"))
    return banned.unionByName(mixed)


def transliterated(texts: DataFrame) -> DataFrame:
    """texts (call_id, language, text): words in Latin letters around an apostrophe that are no English contraction, in Arabic and mixed calls."""
    words = texts.filter(F.col("language").isin("ar", "mixed")).select("call_id", F.explode(F.split("text", "(?U)\\s+")).alias("what"))
    core = F.btrim("what", F.lit(STRIPPED))
    found = core.rlike("[A-Za-z]'[A-Za-z]") & ~core.rlike("[\\x{0600}-\\x{06FF}]") & ~F.lower(core).isin(*CONTRACTIONS)
    return words.filter(found).withColumn("kind", F.lit("transliterated"))


def claim_parts(claim_id: Column) -> Column:
    """list[i] as a struct; null for anything else."""
    ok = claim_id.rlike("^\\w+\\[\\d+\\]$")
    return F.when(ok, F.struct(F.regexp_extract(claim_id, "^(\\w+)", 1).alias("list"), F.regexp_extract(claim_id, "\\[(\\d+)\\]", 1).cast("int").alias("index")))


def planned(claims: Column, verdict: Column, index: Column, patch: Column) -> Column:
    """An array of claims after a verdict: reject removes one, correct replaces it, confirm leaves all."""
    return F.when(verdict == "reject", F.filter(claims, lambda _, i: i != index)).when(verdict == "correct", F.transform(claims, lambda x, i: F.when(i == index, patch).otherwise(x))).otherwise(claims)


def stored_quotes(quotes: DataFrame) -> DataFrame:
    """quotes (id, transcript, quote, start): absent or drifted from their place; and where they are first."""
    at = F.call_function("locate", F.col("quote"), F.col("transcript")) - 1
    here = F.substring(F.col("transcript"), F.col("start") + 1, F.length("quote"))
    return quotes.select("id", (at < 0).alias("absent"), (here != F.col("quote")).alias("drifted"), F.when(at >= 0, at).otherwise(F.col("start")).alias("new_start"), (F.when(at >= 0, at).otherwise(F.col("start")) + F.length("quote")).alias("new_end"))


def rule_outcomes(used: DataFrame, topics: DataFrame) -> DataFrame:
    """used (call_id, rule_id, topic of the call's difference or null), topics (rule_id, topic): success if the call's difference is not the rule's."""
    mine = topics.groupBy("rule_id").agg(F.collect_set("topic").alias("_t"))
    met = used.join(mine, "rule_id").withColumn("ok", F.coalesce(~F.array_contains("_t", F.col("topic")), F.lit(True)))
    return met.groupBy("rule_id").agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"))


def usage_total(rows: DataFrame, key: str) -> DataFrame:
    """Sums that are null only if nothing was reported, and the last model named."""
    last = F.max(F.when(F.col("model") != "", F.struct("pos", "model")))["model"]
    return rows.groupBy(key).agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), last.alias("model"))


def failed_stage(started: Column, transcribed: Column, finished: Column) -> Column:
    """Where a failed call stopped, from what has no time."""
    return F.when(transcribed.isNull(), "transcription").when(started.isNull(), "queue").when(finished.isNull(), "analysis").otherwise("done")
