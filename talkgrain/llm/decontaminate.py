"""Benchmark decontamination by SimHash over item-sized windows (built-in functions only).

Words are lower-cased runs of letters and digits; shingles are five words; their weight is how often they occur.
An item with w words is held against document windows of w words, its own size, and against the whole of a shorter document.

1. A window of k shingles can only reach the threshold t with an item of n if t (n + k) / (1 + t) of its shingles are those
   of some item of its size, so only windows with so many are looked at; this loses nothing. The places are counted for
   all windows of a document at once, by a running sum over the bounds of where windows hold them.
2. Each such window gets the 64-bit SimHash of its shingles.
3. Multi-index search: fingerprints are cut into BLOCKS blocks; two that differ in at most RADIUS bits differ in at most
   RADIUS // BLOCKS bits of some block. Every item is entered under all values within that distance of each of its
   blocks, so the lookup finds every item within RADIUS.
4. Candidates get the exact weighted Jaccard similarity of their shingle multisets; those of `threshold` or more stay.

RADIUS covers windows at the threshold with a margin of more than 4.5 standard deviations; exact passages have distance 0.
Defined results: items of fewer than five words have no shingle and are not looked for; null or empty texts match
nothing; rows that repeat an id, null included, are reported under it once, by the best
window of all their texts; an item listed twice is reported under each of its ids; without items
or documents the result is empty. Other columns are ignored or passed through, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.common import Scratch, checked, fresh, let, text_of

WORDS = 5
THRESHOLD = 0.8
BLOCKS, BLOCK_BITS = 8, 8
RADIUS = 23
#: Fields of 32 bits in which 2 of the 64 bit positions are counted at a time; a window has fewer than 2^32 shingles.
FIELDS, FIELD_BITS = 2, 32
LANES = 32
_ONES = sum(1 << (FIELD_BITS * f) for f in range(FIELDS))


def words_of(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text_of(text)), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """64-bit hashes of all runs of five words, in order; empty for fewer words."""
    def runs(hashes: Column) -> Column:
        last = F.size(hashes) - WORDS
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WORDS)]))
        return F.when(last >= 0, found).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def lanes(h: Column) -> list[Column]:
    """Sums, for LANES lanes, of the bits k and k + 32 of the hashes, each in a field of its own."""
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_ONES))).alias(f"_l{k}") for k in range(LANES)]


def fingerprint(n: Column) -> Column:
    """Bit b is set if more than half of the n hashes have it."""
    out = F.lit(0).cast("long")
    for k in range(LANES):
        for f in range(FIELDS):
            ones = F.shiftrightunsigned(F.col(f"_l{k}"), FIELD_BITS * f).bitwiseAND(F.lit((1 << FIELD_BITS) - 1))
            bit = 1 << (k + FIELD_BITS * f)
            out = out.bitwiseOR(F.when(ones * 2 > n, F.lit(bit - (1 << 64) if bit >> 63 else bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _near_values() -> list[int]:
    """Masks of at most RADIUS // BLOCKS bits of a block."""
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= RADIUS // BLOCKS]


def _block(fp: str, k: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _key(id_col: str, text_col: str) -> Column:
    """Rows that share id and text are one; a null id and different texts of an id have keys of their own."""
    return F.sha2(F.to_json(F.struct(F.col(id_col).alias("id"), F.sha2(text_of(text_col), 256).alias("text"))), 256)


def _hits(scratch: Scratch, docs: DataFrame, items: DataFrame, threshold: float, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """A row per key of a document and text of an item found in it: _id, _doc, item, m, similarity, start_word; and every id of an item's text."""
    # the items: distinct texts, their shingles, fingerprints and block values
    named = items.select(F.col(item_col).alias("_item"), words_of(item_text_col).alias("_w")).filter(F.size("_w") >= WORDS)
    named = scratch.save(named.select("_item", F.size("_w").alias("m"), shingles_of(F.col("_w")).alias("g")), "items")
    grams = scratch.save(named.groupBy("m", "g").agg(F.min("_item").alias("item")), "distinct")
    each = grams.select("item", "m", F.explode("g").alias("h"))
    prints = each.groupBy("item", "m").agg(*lanes(F.col("h")), F.count(F.lit(1)).alias("n"))
    prints = scratch.save(prints.select("item", "m", "n", fingerprint(F.col("n")).alias("fp")), "prints")
    near = prints.select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"), F.array(*map(F.lit, _near_values())).alias("masks"))
    near = near.select("item", "m", F.col("fp").alias("item_fp"), "block", F.explode("masks").alias("mask"))
    value = F.call_function("shiftrightunsigned", F.col("item_fp"), F.col("block") * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").bitwiseXOR(F.col("mask"))
    lookup = scratch.save(near.select("item", "m", "item_fp", "block", value.alias("value")), "lookup")
    sizes = scratch.save(each.select("h", "item", "m").distinct(), "shingles")
    # 1. places where a document has a shingle of an item
    keyed = docs.select(F.col(id_col).alias("_doc"), _key(id_col, text_col).alias("_id"), F.col(text_col).alias("_t"))
    rows = keyed.select("_doc", "_id", shingles_of(words_of("_t")).alias("_g"))
    places = rows.select("_id", F.size("_g").alias("_s"), F.posexplode("_g").alias("pos", "h"))
    known, small = checked(sizes.select("h").distinct())
    if small:
        places = places.join(known, "h", "left_semi")
    else:  # too many to send around: documents' distinct shingles meet them by shuffle
        places = places.join(known.hint("shuffle_hash"), "h", "left_semi")
    places = scratch.save(places, "places")
    # windows are held by where they start; a place is in those from `low` on up to its own position
    by_size, _ = checked(scratch.save(sizes.select("h", "m").distinct(), "sizes"))
    n = F.col("m") - WORDS + 1  # the item's shingles; a shorter document has one window, at its start
    last = F.greatest(F.col("_s") - n, F.lit(0))
    held = places.join(by_size, "h").select("_id", "m", "_s", F.greatest(F.col("pos") - n + 1, F.lit(0)).alias("low"), F.least("pos", last).alias("high"))
    bounds = held.select("_id", "m", "_s", F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(1).alias("d")), F.struct((F.col("high") + 1).alias("at"), F.lit(-1).alias("d")))).alias("b"))
    bounds = bounds.groupBy("_id", "m", "_s", "b.at").agg(F.sum("b.d").alias("d"))
    here = Window.partitionBy("_id", "m").orderBy("at")
    runs = bounds.select("_id", "m", "_s", "at", F.sum("d").over(here.rowsBetween(Window.unboundedPreceding, 0)).alias("shared"), F.lead("at").over(here).alias("until"))
    least = F.ceil(F.lit(threshold) * (n + F.least(F.col("_s"), n)) / (1 + threshold) - 1e-6)
    starts = runs.filter(F.col("until").isNotNull() & (F.col("shared") >= least)).select("_id", "m", F.explode(F.sequence(F.col("at"), F.col("until") - 1)).alias("start"))
    # 2. the shingles of these windows, and their fingerprints
    touched = scratch.save(starts.groupBy("_id", "m").agg(F.array_sort(F.collect_list("start")).alias("starts")), "windows")
    ids = scratch.save(touched.select(F.col("_id").alias("_need")).distinct(), "ids")
    need, _ = checked(ids)
    found = keyed.join(need, F.col("_id") == F.col("_need"), "left_semi")
    whole = found.groupBy("_id").agg(F.first("_t").alias("_t"), F.first("_doc").alias("_doc"))  # rows that share id and text
    whole = scratch.save(whole.select("_id", shingles_of(words_of("_t")).alias("_g"), "_doc"), "whole")
    windows = touched.join(whole, "_id").select("_id", "m", "_g", F.explode("starts").alias("start"))
    windows = windows.select("_id", "m", "start", F.slice("_g", F.col("start") + 1, F.col("m") - WORDS + 1).alias("win"))
    printed = windows.select("_id", "m", "start", "win", F.explode("win").alias("h")).groupBy("_id", "m", "start").agg(*lanes(F.col("h")), F.count(F.lit(1)).alias("n"), F.collect_list("h").alias("win"))
    printed = printed.select("_id", "m", "start", "win", fingerprint(F.col("n")).alias("fp"))
    # 3. items within the radius, through the blocks
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), _block("fp", k).alias("value")) for k in range(BLOCKS)])
    index, _ = checked(lookup)
    met = printed.select("_id", "m", "start", "win", "fp", F.inline(blocks)).join(index, ["m", "block", "value"])
    first = [_block("fp", k).bitwiseXOR(_block("item_fp", k)) for k in range(BLOCKS)]
    before = F.lit(False)  # a pair found through several blocks counts at the first one
    for k, x in enumerate(first[:-1]):
        before = before | ((F.col("block") > k) & (F.bit_count(x) <= RADIUS // BLOCKS))
    met = met.filter((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS) & ~before)
    # 4. exact similarity of the multisets
    # the shared multiset: each common shingle once, and once more for each time that both repeat it
    repeats = each.groupBy("item", "h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").groupBy("item").agg(F.collect_list(F.struct("h", "k")).alias("rep"))
    texts = grams.select("item", F.array_distinct("g").alias("gd"), F.size("g").alias("gn")).join(repeats, "item", "left")
    texts, _ = checked(scratch.save(texts, "texts"))
    pairs = met.select("_id", "m", "start", "win", "item").join(texts, "item")
    again = lambda x: F.greatest(F.least(x["k"], F.size(F.filter("win", lambda y: y == x["h"]))) - 1, F.lit(0)).cast("int")
    more = F.coalesce(F.aggregate("rep", F.lit(0), lambda total, x: total + again(x)), F.lit(0))
    shared = F.size(F.array_intersect("gd", "win")) + more
    pairs = pairs.withColumn("_shared", shared).withColumn("similarity", F.col("_shared") / (F.col("gn") + F.size("win") - F.col("_shared")))
    best = pairs.filter(F.col("similarity") >= threshold).groupBy("_id", "item", "m").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b"))
    best = best.select("_id", "item", "m", "b.similarity", (-F.col("b.s")).alias("start_word")).join(whole.select("_id", "_doc"), "_id")
    found = scratch.save(best, "hits")
    scratch.drop("places", "windows", "whole")
    # every id of an item's text
    return found, named.join(grams, ["m", "g"]).select("item", F.col("_item"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and item found in it: id, item, similarity (of the best window), start_word, n_words (the item's)."""
    scratch = Scratch(docs.sparkSession, "leaks")
    hits, same = _hits(scratch, docs, items, threshold, id_col, text_col, item_col, item_text_col)
    # of the texts of an id the one with the best window
    best = hits.groupBy("_doc", "item", "m").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("s"))).alias("b"))
    found = scratch.save(best.select("_doc", "item", "m", "b.similarity", (-F.col("b.s")).alias("start_word")), "found")
    return found.join(same, "item").select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), "similarity", "start_word", F.col("m").alias("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs in whose text no item is found; other rows that share the id, or have none either, stay."""
    scratch = Scratch(docs.sparkSession, "leak-ids")
    hits, _ = _hits(scratch, docs, items, THRESHOLD, id_col, text_col, "item_id", "text")
    name = fresh(docs, "_bad")
    bad, _ = checked(scratch.save(hits.select(F.col("_id").alias(name)).distinct(), "keys"))
    return docs.join(bad, _key(id_col, text_col) == F.col(name), "left_anti")
