"""Where quotes are in a transcript: overlapping occurrences in linear time, and every match with its line and speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.functions import text as T

_ROWS = "array<map<string,int>>"


def _automaton(quote: Column) -> Column:
    """Rows of a matcher, as a fold over the quote: row j maps a character to the length matched after it, missing ones to 0.

    Row j is the row of the longest border of the first j characters, with the j-th character leading on to j + 1.
    """
    start = F.struct(F.array().cast(_ROWS).alias("rows"), F.create_map().cast("map<string,int>").alias("border"), F.lit(0).alias("j"))

    def step(s: Column, c: Column) -> Column:
        on = F.create_map(c, s["j"] + 1)
        row = F.map_concat(F.map_filter(s["border"], lambda k, _: k != c), on)
        next_border = F.coalesce(F.try_element_at(s["border"], c), F.lit(0))
        rows = F.array_append(s["rows"], row)
        return F.struct(rows.alias("rows"), F.when(s["j"] == 0, s["border"]).otherwise(F.get(rows, next_border)).alias("border"), (s["j"] + 1).alias("j"))

    def first_step(s: Column, c: Column) -> Column:
        return F.when(s["j"] == 0, F.struct(F.array(F.create_map(c, F.lit(1))).alias("rows"), F.create_map(c, F.lit(1)).alias("border"), F.lit(1).alias("j"))).otherwise(step(s, c))

    return F.aggregate(F.split(quote, ""), start, first_step, lambda s: F.array_append(s["rows"], s["border"]))


def overlapping(text: Column, quote: Column) -> Column:
    """0-based starts of all occurrences of a quote, overlapping ones too; none for an empty quote.

    A quote without a border cannot overlap itself, so the plain search finds all; others are matched by one fold over the
    text, from the first occurrence on.
    """
    m = F.length(quote)
    bordered = F.exists(F.sequence(F.lit(1), m - 1), lambda k: F.left(quote, k) == F.right(quote, k))
    first = F.call_function("locate", quote, text)
    found = F.struct(F.lit(0).alias("state"), (first - 1).alias("i"), F.array().cast("array<int>").alias("at"))

    def matched(rows: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            to = F.coalesce(F.try_element_at(F.get(rows, s["state"]), c), F.lit(0))
            return F.struct(to.alias("state"), (s["i"] + 1).alias("i"), F.when(to == m, F.array_append(s["at"], s["i"] + 1 - m)).otherwise(s["at"]).alias("at"))

        return F.aggregate(F.split(F.substring(text, first, F.length(text)), ""), found, step, lambda s: s["at"])

    walked = F.get(F.transform(F.array(_automaton(quote)), matched), 0)
    none = F.array().cast("array<int>")
    return F.when((m == 0) | (first == 0), none).when((m > 1) & bordered, walked).when(m > 0, T.all_offsets(text, quote))


def evidence(asked: DataFrame, turns: DataFrame) -> DataFrame:
    """asked (call_id, ask_id, transcript, quote), turns (call_id, pos, start_char, end_char): ask_id, start, end, turn (pos) in which the first occurrence starts, occurrences (overlapping ones count).

    Nothing for a quote that is empty or absent, or that starts outside every turn.
    """
    from talkgrain.operators import timelines

    hits = asked.select("call_id", "ask_id", F.length("quote").alias("_m"), overlapping(F.col("transcript"), F.col("quote")).alias("_at")).filter("size(_at) > 0")
    hits = hits.select("call_id", "ask_id", F.get("_at", 0).cast("double").alias("at"), F.col("_m"), F.size("_at").alias("occurrences"))
    spans = turns.select("call_id", "pos", F.col("start_char").cast("double").alias("start_sec"), F.col("end_char").cast("double").alias("end_sec"))
    points = timelines.covering(hits.select("call_id", "at").distinct(), spans).filter("span_pos is not null")
    out = hits.join(points, ["call_id", "at"])
    return out.select("call_id", "ask_id", F.col("at").cast("long").alias("start"), (F.col("at") + F.col("_m")).cast("long").alias("end"), F.col("span_pos").alias("turn"), "occurrences")


def matches(texts: DataFrame, key: str, text: str, quote: Column) -> DataFrame:
    """key, match (from 0), line_number, speaker of the line, start_char, end_char, line_text of every non-overlapping occurrence; an empty quote is an error."""
    wanted = F.when(quote == "", F.raise_error(F.lit("a quote must not be empty")).cast("string")).otherwise(quote)
    rows = texts.select(key, F.col(text).alias("_t"), wanted.alias("_q"))
    rows = rows.filter(F.contains("_t", F.col("_q"))).withColumn("_lines", F.split("_t", "\n", -1))
    ends = F.aggregate("_lines", F.array(F.lit(0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + F.length(x) + 1))  # where each line begins, and one past the end
    rows = rows.withColumn("_starts", ends).select(key, "_q", "_lines", "_starts", F.posexplode(T.all_offsets(F.col("_t"), F.col("_q"))).alias("match", "start_char"))
    line = F.size(F.filter("_starts", lambda s: s <= F.col("start_char")))
    rows = rows.withColumn("line_number", line).withColumn("line_text", F.get("_lines", F.col("line_number") - 1))
    return rows.select(key, "match", "line_number", T.speaker_of(F.col("line_text")).alias("speaker"), "start_char", (F.col("start_char") + F.length("_q")).alias("end_char"), "line_text")
