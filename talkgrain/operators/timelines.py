"""Interval operators: speaker alignment, point in interval, islands of one speaker, cutting at span boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


#: Shorter intervals share the cells of this level, which are about a microsecond wide.
LEAST_LEVEL = -20


def _level(start: Column, end: Column) -> Column:
    """The level of cells, 2^level seconds wide, of which the interval meets two at most."""
    return F.greatest(F.ceil(F.log2(end - start)), F.lit(LEAST_LEVEL)).cast("int")


def _levels(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """One row: the distinct levels, which are as few as the binary digits of a time."""
    return F.broadcast(intervals.filter(F.col(end) > F.col(start)).agg(F.collect_set(_level(F.col(start), F.col(end))).alias("_levels")))


def _cells(level: Column, start: Column, end: Column) -> Column:
    width = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(start / width), F.floor(end / width))


def _meeting(asr: DataFrame, s: DataFrame) -> DataFrame:
    """Pairs of a call's intervals that overlap. They meet in cells of the longer one's level, where few others are, so a call may be of any length."""
    a = asr.filter("end_sec > start_sec").withColumn("_own", _level(F.col("start_sec"), F.col("end_sec")))
    b = s.filter("_e > _s").withColumn("_own", _level(F.col("_s"), F.col("_e")))
    at_a, at_b = _cells(F.col("_l"), F.col("start_sec"), F.col("end_sec")), _cells(F.col("_l"), F.col("_s"), F.col("_e"))

    def own(rows: DataFrame, cells: Column) -> DataFrame:
        return rows.withColumn("_l", F.col("_own")).withColumn("_c", F.explode(cells)).drop("_own")

    def other(rows: DataFrame, levels: DataFrame, cells: Column, first: int) -> DataFrame:
        up = F.filter("_levels", lambda x: x >= F.col("_own") + first)
        return rows.crossJoin(levels).withColumn("_l", F.explode(up)).withColumn("_c", F.explode(cells)).drop("_own", "_levels")

    keys = ["call_id", "_l", "_c"]
    longer_a = own(a, at_a).join(other(b, _levels(asr, "start_sec", "end_sec"), at_b, 0), keys)
    longer_b = other(a, _levels(s, "_s", "_e"), at_a, 1).join(own(b, at_b), keys)
    return longer_a.unionByName(longer_b).filter("_s < end_sec and _e > start_sec").drop("_l", "_c")


def _nearest(asr: DataFrame, s: DataFrame) -> DataFrame:
    """Each interval with the last speaker's before its midpoint and the first one after it: one of them is the nearest."""
    mid = (F.col("_s") + F.col("_e")) / 2
    # of equal midpoints the first position
    spots = s.groupBy("call_id", mid.alias("_m")).agg(F.min(F.struct("_p", "speaker", "_s", "_e")).alias("_b"))
    points = asr.withColumn("_m", (F.col("start_sec") + F.col("end_sec")) / 2).unionByName(spots, allowMissingColumns=True)
    out = []
    for m in (F.asc("_m"), F.desc("_m")):
        w = Window.partitionBy("call_id").orderBy(m, F.col("_b").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = points.withColumn("_near", F.last("_b", ignorenulls=True).over(w)).filter("_b is null and _near is not null")
        out.append(found.select(*asr.columns, "_near.*"))
    return out[0].unionByName(out[1])


def align(asr: DataFrame, speakers: DataFrame) -> DataFrame:
    """Each asr segment (call_id, pos, start_sec, end_sec) with the speaker that overlaps it most, else the nearest by midpoint; ties go to the first. In a call without any speaker it stays, with none."""
    s = speakers.select("call_id", F.col("pos").alias("_p"), F.col("name").alias("speaker"), F.col("start_sec").alias("_s"), F.col("end_sec").alias("_e"))
    asr = asr.select("call_id", "pos", "start_sec", "end_sec")
    both = _meeting(asr, s).unionByName(_nearest(asr, s)).unionByName(asr, allowMissingColumns=True)
    both = both.withColumn("overlap_sec", overlap(F.col("start_sec"), F.col("end_sec"), F.col("_s"), F.col("_e")))
    far = F.abs((F.col("start_sec") + F.col("end_sec")) / 2 - (F.col("_s") + F.col("_e")) / 2)
    none = F.col("_p").isNull()
    order = F.struct(none.alias("none"), F.when(~none, -F.col("overlap_sec")).alias("o"), F.when(F.col("overlap_sec") > 0, 0.0).otherwise(far).alias("far"), "_p", "speaker")
    return both.groupBy("call_id", "pos").agg(F.min(order).alias("_b")).select("call_id", "pos", "_b.speaker", F.round(-F.col("_b.o"), 6).alias("overlap_sec"))


def covering(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (call_id, at) and span_pos: the first span with start <= at < end, null if none."""
    s = spans.filter("end_sec > start_sec").select("call_id", "pos", "start_sec", "end_sec", _level(F.col("start_sec"), F.col("end_sec")).alias("_l"))
    s = s.withColumn("_c", F.explode(_cells(F.col("_l"), F.col("start_sec"), F.col("end_sec"))))
    asked = points.select("call_id", "at").crossJoin(_levels(spans, "start_sec", "end_sec")).withColumn("_l", F.explode("_levels")).drop("_levels")
    asked = asked.withColumn("_c", F.floor(F.col("at") / F.pow(F.lit(2.0), F.col("_l"))))
    # the cells are many more rows than the spans, and Spark takes them for as few bytes: never broadcast
    hit = asked.join(s.hint("merge"), ["call_id", "_l", "_c"]).filter("at >= start_sec and at < end_sec").groupBy("call_id", "at").agg(F.min("pos").alias("span_pos"))
    return points.join(hit.hint("merge"), ["call_id", "at"], "left")


def frames(ends: DataFrame, frame_sec: float = 0.01) -> DataFrame:
    """(call_id, end_sec) as one row per frame: frame, at."""
    n = F.floor(F.col("end_sec") / frame_sec).cast("int")
    return ends.filter(n > 0).select("call_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame")).withColumn("at", F.col("frame") * F.lit(frame_sec))


def islands(segments: DataFrame) -> DataFrame:
    """Consecutive segments of one speaker become one: call_id, island, speaker, start_sec, end_sec, segments."""
    w = Window.partitionBy("call_id").orderBy("pos")
    new = F.when(F.lag("name").over(w) == F.col("name"), 0).otherwise(1)
    marked = segments.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy("call_id", "island").agg(F.min("name").alias("speaker"), F.round(F.min("start_sec"), 6).alias("start_sec"), F.round(F.max("end_sec"), 6).alias("end_sec"), F.count(F.lit(1)).alias("segments"))


def labelled_transcript(segments: DataFrame) -> DataFrame:
    """(call_id, pos, speaker, text): islands as lines, empty texts dropped first; the first speaker is the agent."""
    kept = segments.filter(F.trim("text") != "")
    w = Window.partitionBy("call_id").orderBy("pos")
    role = F.when(F.col("speaker") == F.first("speaker").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "Agent").otherwise("Customer")
    kept = kept.withColumn("role", role)
    kept = kept.withColumn("island", F.sum(F.when(F.lag("role").over(w) == F.col("role"), 0).otherwise(1)).over(w))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.trim(F.regexp_replace(x["text"], "\\s+", " "))), " ")
    lines = kept.groupBy("call_id", "island", "role").agg(said.alias("said"))
    line = F.array_sort(F.collect_list(F.struct("island", F.concat("role", F.lit(": "), "said").alias("line"))))
    return lines.groupBy("call_id").agg(F.array_join(F.transform(line, lambda x: x["line"]), "\n").alias("transcript"))


def cut_turn(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """Turns (call_id, pos, start, end) cut at the bounds of overlapping spans (call_id, span_id, start, end): pieces with the spans that cover them."""
    s = spans.select("call_id", "span_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = turns.join(s, "call_id", "left").filter("_s is null or (_s < end and _e > start)")
    met = met.groupBy("call_id", "pos", "start", "end").agg(F.collect_list(F.struct("span_id", "_s", "_e")).alias("spans"))
    inner = F.flatten(F.transform("spans", lambda x: F.array(x["_s"], x["_e"])))
    bounds = F.array_sort(F.array_distinct(F.concat(F.array("start", "end"), F.filter(inner, lambda b: (b > F.col("start")) & (b < F.col("end"))))))
    pieces = F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), lambda i: F.struct(F.get("bounds", i).alias("from"), F.get("bounds", i + 1).alias("to")))
    out = met.withColumn("bounds", bounds).select("call_id", "pos", "spans", F.posexplode(pieces).alias("piece", "p"))
    covers = F.transform(F.filter("spans", lambda x: (x["_s"] <= F.col("p.from")) & (x["_e"] >= F.col("p.to"))), lambda x: x["span_id"])
    return out.select("call_id", "pos", "piece", F.col("p.from").alias("from_char"), F.col("p.to").alias("to_char"), F.array_sort(covers).alias("span_ids"))
