"""Timelines of whole calls: long and hot calls against brute force."""

import random

from pyspark.sql import functions as F

from talkgrain.operators import timelines
from talkgrain.plans import fixtures as fx
from talkgrain.plans import registry

SMALL = "/root/testdata/sf0.001"


def timed(rows, kind):
    """(call_id, pos, name, start, end) of the fixture's rule, made by hand from all events."""
    types = ("click", "view") if kind == "asr" else ("purchase", "signup", "error")
    calls = {}
    for r in sorted((r for r in rows if r.event_type in types), key=lambda r: (r.ts, r.event_id)):
        calls.setdefault(r.user_id, []).append((r.event_type, r.at))
    return {c: [(p, v[p][0], v[p][1], v[p + 1][1]) for p in range(len(v) - 1)] for c, v in calls.items()}


def best(seg, spk):
    _, _, a, b = seg
    o = lambda s: max(0.0, min(b, s[3]) - max(a, s[2]))
    s = min(spk, key=lambda s: (-o(s), 0 if o(s) > 0 else abs((a + b) / 2 - (s[2] + s[3]) / 2), s[0]))
    return s[1], round(o(s), 6)


def test_queries_see_every_interval(spark):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    rows = fx.read(spark, SMALL, "events").select("user_id", "event_id", "event_type", "ts", at).collect()
    asr, spk = timed(rows, "asr"), timed(rows, "speakers")
    assert max(len(v) for v in spk.values()) > 40
    got = {(r.call_id, r.pos): (r.speaker, r.overlap_sec) for r in registry.queries()["speaker_alignment"](spark, SMALL).collect()}
    assert got == {(c, g[0]): best(g, spk[c]) for c, v in asr.items() if spk.get(c) for g in v} | {(c, g[0]): (None, None) for c, v in asr.items() if not spk.get(c) for g in v}
    got = {(r.call_id, r.at): r.span_pos for r in registry.queries()["point_in_span"](spark, SMALL).collect()}
    assert got == {(c, g[2]): min((s[0] for s in spk.get(c, ()) if s[2] <= g[2] < s[3]), default=None) for c, v in asr.items() for g in v}
    assert sum(r.segments for r in registry.queries()["speaker_islands"](spark, SMALL).collect()) == sum(map(len, asr.values()))


def test_any_intervals_against_brute_force(spark):
    rng = random.Random(4)

    def made(n):
        out = []
        for p in range(n):
            a = rng.choice((rng.uniform(-50, 900), float(rng.randint(0, 60))))
            out.append((1, p, rng.choice("AB") + str(p), a, a + rng.choice((0.0, 1e-7, 1.0, 2.0, rng.uniform(0, 3), rng.uniform(0, 300)))))
        return out

    asr, spk = made(150), made(60)
    kind = "call_id int, pos int, name string, start_sec double, end_sec double"
    a, s = spark.createDataFrame(asr, kind), spark.createDataFrame(spk, kind)
    got = {r.pos: (r.speaker, r.overlap_sec) for r in timelines.align(a, s).collect()}
    assert got == {g[1]: best(g[1:], [x[1:] for x in spk]) for g in asr}
    points = a.select("call_id", F.col("start_sec").alias("at")).distinct()
    got = {r.at: r.span_pos for r in timelines.covering(points, s).collect()}
    assert got == {g[3]: min((x[1] for x in spk if x[3] <= g[3] < x[4]), default=None) for g in asr}


def test_a_hot_call_does_not_grow_with_its_square(spark):
    n = 20_000
    row = lambda k, d: spark.range(n).select(F.lit(1).alias("call_id"), F.col("id").alias("pos"), F.lit(k).alias("name"), (F.col("id") + d).alias("start_sec"), (F.col("id") + 1 + d).alias("end_sec"))
    got = timelines.align(row("a", 0.0), row("b", 0.25))
    assert got.count() == n and got.filter("overlap_sec <> 0.75").count() == 0
    pairs = timelines._meeting(row("a", 0.0).drop("name"), row("b", 0.25).selectExpr("call_id", "pos as _p", "name as speaker", "start_sec as _s", "end_sec as _e"))
    assert pairs.count() < 8 * n
