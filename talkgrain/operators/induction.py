"""Rules from corrections, one after the other, as a distributed fixpoint; consolidation around open conflicts; the loop of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.operators import linkage, rules, search
from talkgrain.sources import files


def fold(candidates: DataFrame, conflicts: DataFrame, against: DataFrame | None = None) -> tuple[DataFrame, int]:
    """candidates (candidate, pos), conflicts (a, b: candidates that a judge holds against each other), against (candidate, rule_id: rules that are active already).

    In the order of pos a candidate becomes a rule unless an active rule or an earlier candidate that became one conflicts
    with it: the lexicographically first independent set. A candidate is decided once all earlier conflicting ones are, so
    each round decides the first undecided of every neighbourhood, and what these rule out. Returns candidate, inserted,
    conflicts (the inserted candidates that stand against it, by pos), round, and the number of rounds, at most the longest
    chain of alternating decisions.
    """
    pos = candidates.select(F.col("candidate"), F.col("pos"))
    both = conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = both.join(pos.select(F.col("candidate").alias("a"), F.col("pos").alias("pa")), "a").join(pos.select(F.col("candidate").alias("b"), F.col("pos").alias("pb")), "b")
    edges = files.kept(edges.filter((F.col("pa") < F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("a") < F.col("b")))).select("a", "b", "pa"))  # a comes before b
    out = None
    if against is not None:
        out = files.kept(against.select("candidate").distinct().join(pos, "candidate", "left_semi").withColumn("inserted", F.lit(False)).withColumn("round", F.lit(0)))
    left, open_ = pos.select("candidate"), edges
    if out is not None:
        left = left.join(out, "candidate", "left_anti")
        gone = out.select("candidate")
        open_ = open_.join(gone.select(F.col("candidate").alias("a")), "a", "left_anti").join(gone.select(F.col("candidate").alias("b")), "b", "left_anti")
    left, open_, rounds = files.kept(left), files.kept(open_), 0
    while not left.isEmpty():
        rounds += 1
        free = left.join(open_.select(F.col("b").alias("candidate")), "candidate", "left_anti").select("candidate")
        free = files.kept(free.withColumn("inserted", F.lit(True)).withColumn("round", F.lit(rounds)))
        ruled = open_.join(free.select(F.col("candidate").alias("a")), "a", "left_semi").select(F.col("b").alias("candidate")).distinct()
        ruled = files.kept(ruled.withColumn("inserted", F.lit(False)).withColumn("round", F.lit(rounds)))
        done = free.unionByName(ruled)
        out = done if out is None else out.unionByName(done)
        gone = done.select("candidate")
        left = files.kept(left.join(gone, "candidate", "left_anti"))
        open_ = files.kept(open_.join(gone.select(F.col("candidate").alias("a")), "a", "left_anti").join(gone.select(F.col("candidate").alias("b")), "b", "left_anti"))
    if out is None:
        out = pos.select("candidate").limit(0).withColumn("inserted", F.lit(True)).withColumn("round", F.lit(0))
    inserted = out.filter("inserted").select(F.col("candidate").alias("a"))
    blocked = edges.join(inserted, "a").groupBy(F.col("b").alias("candidate")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pa", "a"))), lambda x: x["a"]).alias("_c"))
    found = out.join(blocked, "candidate", "left")
    return found.select("candidate", "inserted", F.when(~F.col("inserted"), F.coalesce("_c", F.array().cast(blocked.schema["_c"].dataType))).alias("conflicts"), "round"), rounds


def consolidate(known: DataFrame, held: DataFrame, threshold: float = rules.SIMILAR, within: str | None = None) -> DataFrame:
    """known (rule_id, pos, vec, sources, success_count, failure_count, retired), held (rule_id: rules that open conflicts name): the rules afterwards, with fate kept, held, retired (before), merged (into another) or survivor.

    Held and retired rules are not clustered, nor are rules that differ in the column `within`. The first rule of a cluster carries it on: sources in order without repeats,
    counters summed; the others are merged away. A second run over what it left changes nothing but clusters that new
    likeness forms, as a cluster has one rule then.
    """
    held = held.select("rule_id").distinct().withColumn("_held", F.lit(True))
    marked = known.join(held, "rule_id", "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    marked = files.kept(marked)
    eligible = marked.filter("not retired and not _held").drop("_held")
    of = linkage.clusters(eligible.select("rule_id", "pos", "vec", *([within] if within else [])), threshold, within=within)
    merged = rules.merged(eligible, of)
    first = eligible.join(of, "rule_id").groupBy("cluster").agg(F.min(F.struct("pos", "rule_id"))["rule_id"].alias("head"))
    merged = merged.join(first, "cluster").select(F.col("head").alias("rule_id"), F.col("members"), F.col("sources").alias("_s"), F.col("success_count").alias("_ok"), F.col("failure_count").alias("_no"))
    out = marked.join(merged, "rule_id", "left")
    fate = F.when(F.col("retired"), "retired").when(F.col("_held"), "held").when(F.col("members") > 1, "survivor").when(F.col("members") == 1, "kept").otherwise("merged")
    out = out.withColumn("fate", fate).withColumn("retired", F.col("retired") | (F.col("fate") == "merged"))
    for c, m in (("sources", "_s"), ("success_count", "_ok"), ("failure_count", "_no")):
        out = out.withColumn(c, F.coalesce(m, c))
    return out.select(*known.columns, "fate")


def batches(calls: DataFrame, n: int, k: int = 1, retrieve_at: float = 0.5, merge_at: float = 0.9, conflict_at: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """calls (call_id, batch 0..n-1, vec, wants, plain: what the control arm says) through n batches; per batch the figures, and the rules at the end.

    The memory arm says what the most similar active rule says if it is at least retrieve_at alike, else what the control arm
    says. Then, in this order: rules count successes and failures of the calls they were used for; each call that the memory
    arm got wrong proposes a rule (its vector, saying what it wants), and the fold inserts those that no active or earlier
    inserted rule with another saying contradicts at conflict_at or more; rules of one saying that are merge_at alike are
    consolidated, rules in open conflicts held out; rules with too little success retire.
    """
    spark = calls.sparkSession
    zero, number = F.lit(0).cast("long"), F.col("call_id").cast("long")
    as_rule = [number.alias("rule_id"), number.alias("pos"), F.col("vec").cast("array<double>").alias("vec"), F.col("wants").alias("says"), F.array(number).alias("sources"), zero.alias("success_count"), zero.alias("failure_count"), F.lit(False).alias("retired")]
    state = files.kept(calls.filter("false").select(as_rule))
    figures = []
    for b in range(n):
        now = files.kept(calls.filter(F.col("batch") == b).select(F.col("call_id").cast("long").alias("call_id"), F.col("vec").cast("array<double>").alias("vec"), "wants", "plain"))
        active = state.filter("not retired")
        near = search.nearest(now.select(F.col("call_id").alias("query_id"), "vec"), active.select("rule_id", "pos", "vec"), k).filter(F.col("similarity") >= retrieve_at)
        used = near.filter("rank = 1").select(F.col("query_id").alias("call_id"), "rule_id").join(active.select("rule_id", "says"), "rule_id")
        met = files.kept(now.join(used, "call_id", "left").withColumn("said", F.coalesce("says", "plain")).withColumn("ok", F.col("said").eqNullSafe(F.col("wants"))))
        counts = met.filter("rule_id is not null").groupBy("rule_id").agg(F.count_if("ok").alias("_s"), F.count_if(~F.col("ok")).alias("_f"))
        state = state.join(counts, "rule_id", "left").withColumn("success_count", F.col("success_count") + F.coalesce("_s", F.lit(0))).withColumn("failure_count", F.col("failure_count") + F.coalesce("_f", F.lit(0))).drop("_s", "_f")
        new = files.kept(met.filter("not ok").select("call_id", "vec", "wants"))
        alike = search.pairs(new.select(F.col("call_id").alias("rule_id"), "vec"), conflict_at).select("a", "b")
        said = new.select("call_id", "wants")
        alike = alike.join(said.select(F.col("call_id").alias("a"), F.col("wants").alias("_a")), "a").join(said.select(F.col("call_id").alias("b"), F.col("wants").alias("_b")), "b").filter("_a <> _b").select("a", "b")
        cross = search.within(new.select(F.col("call_id").alias("query_id"), "vec"), active.select("rule_id", "vec"), conflict_at).select(F.col("query_id").alias("candidate"), "rule_id")
        cross = files.kept(cross.join(said.select(F.col("call_id").alias("candidate"), "wants"), "candidate").join(active.select("rule_id", "says"), "rule_id").filter("wants <> says").select("candidate", "rule_id"))
        decided, _ = fold(new.select(F.col("call_id").alias("candidate"), F.col("call_id").alias("pos")), alike, cross)
        decided = files.kept(decided)
        fresh = new.join(decided.filter("inserted").select(F.col("candidate").alias("call_id")), "call_id").select(as_rule)
        held = cross.select("rule_id").unionByName(decided.filter("not inserted").select(F.explode("conflicts").alias("rule_id"))).distinct()
        state = files.kept(state.unionByName(fresh))
        done = files.kept(consolidate(state, held, merge_at, "says"))
        state = files.kept(rules.retire(done.drop("fate")))
        one = met.agg(F.count(F.lit(1)), F.count_if(F.col("plain").eqNullSafe(F.col("wants"))), F.count_if("ok"), F.count("rule_id")).first()
        two = decided.agg(F.count_if("inserted"), F.count_if(~F.col("inserted"))).first()
        three = done.agg(F.count_if(F.col("fate") == "merged")).first()
        four = state.agg(F.count_if(~F.col("retired")), F.count_if("retired")).first()
        figures.append((b, *one, *two, *three, *four))
    names = "batch int, calls long, control_ok long, memory_ok long, guided long, inserted long, conflicts long, merged long, active_rules long, retired_rules long"
    return spark.createDataFrame(figures, names), state
