"""Phrase collocations by PCY/DHP hashing: exact counts only of n-grams whose bucket and whose parts are frequent.

Pass k reads all texts once. It counts exactly the k-grams that may be frequent, and counts in a fixed number of buckets the
(k+1)-grams whose k-grams passed. Merged over all tasks, the buckets that reach the threshold become a bitmap; so do the
hashed k-grams that turned out frequent (Apriori). Both bitmaps have BUCKETS bits whatever the input, and are broadcast.
Hash collisions only let more n-grams be counted; counts are by the words themselves.

Inside a task n-grams are counted by word numbers, in chunks of bounded bytes and tallies of bounded rows; between tasks by
(category, phrase) with partial sums. Bucket counts travel in segments that are summed as they stream by.

Defined results: null text is empty, null category is `und`; an empty table gives an empty result; repeated rows count each
time; other columns are ignored, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.common import Scratch, join_groups, text_of

#: Buckets (and bits of a bitmap), and the counts of a segment.
BUCKETS, SEGMENT = 1 << 24, 1 << 16

#: Bytes of text and words that are counted at a time; word numbers have 21 bits, and a task starts a new vocabulary before it may need more.
CHUNK, STEP, NUMBER_BITS, VOCABULARY = 1 << 20, 400_000, 21, 1_500_000

#: Distinct n-grams that a task tallies before it hands them on.
TALLY = 1_500_000

#: Parts among which the phrases of a category are ranked first.
RANK_PARTS = 64

_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n "))
_END = b"\xff"  # stands between pieces; never part of UTF-8
_PARTIAL = "category string, phrase string, f long, segment int, counts binary"


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """Buckets of n-grams given by the hashes of category and words."""
    x = np.zeros(len(parts[-1]), np.uint64)
    for p in parts:
        x = (x + p) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(8)) & np.uint64(BUCKETS - 1)


def _hash(word: bytes) -> int:
    return zlib.crc32(word)


class _Words(dict):
    """Numbers of words, from 1; 0 ends a piece."""

    def __init__(self) -> None:
        self.words, self._hashes = [_END], np.zeros(1, np.uint64)
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def hashes(self) -> np.ndarray:
        new = [_hash(w) for w in self.words[len(self._hashes) :]]
        self._hashes = np.concatenate([self._hashes, np.array(new, np.uint64)])
        return self._hashes


class _Tally:
    """Exact counts of numbers."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: np.ndarray) -> None:
        u, c = np.unique(keys, return_counts=True)
        self.parts.append((u, c))
        self.rows += len(u)
        if self.rows > TALLY and len(self.parts) > 1:
            self.parts = [self.total()]
            self.rows = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _split(text: bytes) -> list[bytes]:
    return text.replace(b"\n", b" \xff ").split()


def _chunks(texts: list[bytes], ahead: int) -> Iterator[tuple[list[bytes], int]]:
    """Words and ends of pieces in parts of about CHUNK bytes, each with the number of those that are its own; up to `ahead` words of the next part follow them, where a piece goes on."""
    text = b"\n".join(texts).translate(_LOWER)
    at = 0
    while at < len(text):
        cut = at + CHUNK
        if cut >= len(text):
            end, next_words = len(text), []
        elif (end := text.rfind(b"\n", at, cut)) > at:
            next_words = []
        else:
            end = text.find(b" ", cut)
            stop = text.find(b"\n", cut)
            end = min((x for x in (end, stop) if x >= 0), default=len(text))
            seen, next_words = 4096, []
            while end < len(text):
                next_words = _split(text[end : end + seen])
                if len(next_words) > ahead or end + seen >= len(text):
                    break
                seen *= 2
        own = _split(text[at:end])
        yield own + next_words[:ahead], len(own)
        at = end + (text[end : end + 1] == b"\n" and not next_words)


class _Pass:
    """What one task counts: n-grams of `size` words exactly, those of size + 1 in buckets if `buckets`."""

    def __init__(self, size: int, buckets: bool, may: np.ndarray | None, parts: np.ndarray | None):
        self.size, self.may, self.parts = size, may, parts
        self.buckets = np.zeros(BUCKETS, np.uint32) if buckets else None
        self.begin()

    def begin(self) -> None:
        self.words = _Words()
        self.tallies: dict[bytes, _Tally] = {}

    def _set(self, bits: np.ndarray | None, bucket: np.ndarray) -> np.ndarray:
        return np.ones(len(bucket), bool) if bits is None else (bits[bucket >> np.uint64(3)] >> (7 - (bucket & np.uint64(7)).astype(np.uint8))) & 1 > 0

    def count(self, category: bytes, tokens: list[bytes], starts: int) -> Iterator[pa.RecordBatch]:
        """Counts the grams that begin with the first `starts` tokens, and hands on what is full."""
        salt = np.array([_hash(category)], np.uint64)
        for s in range(0, starts, STEP):
            if self.full():
                yield from self.emit()
            own = min(STEP, starts - s)
            ids = np.fromiter(map(self.words.__getitem__, tokens[s : s + own + self.size]), np.int64)
            ids = np.concatenate([ids, np.zeros(own + self.size - len(ids), np.int64)])  # the end of the text ends a piece
            hashes = self.words.hashes()[ids]
            alive = ids > 0  # of the grams of each size so far, where they start
            for n in range(1, self.size + 1):
                if n > 1:
                    alive = alive[:-1] & alive[1:]
                if n == self.size - 1 or n == self.size > 1:  # (size - 1)-grams that were frequent, then grams in full buckets
                    at = np.flatnonzero(alive)
                    alive[at[~self._set(self.parts if n < self.size else self.may, _mixed([salt.repeat(len(at)), *[hashes[at + k] for k in range(n)]]))]] = False
            at = np.flatnonzero(alive[:own])
            key = ids[at]
            for k in range(1, self.size):
                key = key << NUMBER_BITS | ids[at + k]
            self.tallies.setdefault(category, _Tally()).add(key)
            if self.buckets is not None:
                longer = np.flatnonzero((alive[:-1] & alive[1:])[:own])
                np.add.at(self.buckets, _mixed([salt.repeat(len(longer)), *[hashes[longer + k] for k in range(self.size + 1)]]), np.uint32(1))

    def full(self) -> bool:
        return len(self.words) > VOCABULARY or sum(t.rows for t in self.tallies.values()) > TALLY

    def emit(self) -> Iterator[pa.RecordBatch]:
        words, mask = self.words.words, (1 << NUMBER_BITS) - 1
        for category, tally in self.tallies.items():
            keys, counts = tally.total()
            for s in range(0, len(keys), 100_000):
                some = keys[s : s + 100_000]
                parts = [[words[i] for i in ((some >> (NUMBER_BITS * k)) & mask).tolist()] for k in range(self.size - 1, -1, -1)]
                yield _partial([category] * len(some), [b" ".join(p) for p in zip(*parts)], counts[s : s + 100_000])
            if self.size == 1:
                yield _partial([category], [None], np.array([counts.sum()]))
        self.begin()

    def emit_buckets(self) -> Iterator[pa.RecordBatch]:
        if self.buckets is not None:
            yield from _segments(np.minimum(self.buckets, 255).astype(np.uint8))


def _partial(categories: list[bytes], phrases: list[bytes | None], f: np.ndarray) -> pa.RecordBatch:
    n, text = len(phrases), lambda x: pa.array(x, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([text(categories), text(phrases), pa.array(f, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["category", "phrase", "f", "segment", "counts"])


def _segments(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, BUCKETS, SEGMENT):
        part = counts[k : k + SEGMENT]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([k // SEGMENT], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["category", "phrase", "f", "segment", "counts"])


def _bitmap(partial: DataFrame, least: int) -> np.ndarray:
    """Bits of the buckets whose counts add up to `least`. Counts stop at 255, which least may not exceed. The result has BUCKETS bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(c, np.uint8).astype(np.uint16)
                sums[s] = np.minimum(sums[s] + part, 255) if s in sums else part
        for s, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(c >= least).tobytes()], pa.binary())], ["segment", "bits"])

    bits = np.zeros(BUCKETS // 8, np.uint8)
    rows = partial.filter("segment is not null").select("segment", "counts").repartition("segment").mapInArrow(add, "segment int, bits binary")
    for r in rows.collect():  # BUCKETS / SEGMENT rows of SEGMENT bits
        bits[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def _marked(phrases: DataFrame) -> np.ndarray:
    """Bitmap of the hashes of frequent phrases."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.uint8)
        for b in batches:
            if not len(b):
                continue
            grams = [[_hash(c.encode()), *map(_hash, p.encode().split(b" "))] for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            seen[_mixed(list(np.array(grams, np.uint64).T))] = 1
        yield from _segments(seen)

    return _bitmap(phrases.select("category", "phrase").mapInArrow(mark, _PARTIAL), 1)


def _counted(rows: DataFrame, size: int, buckets: bool, may: np.ndarray | None, parts: np.ndarray | None) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((may, parts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Pass(size, buckets, *sent.value)
        for b in batches:
            category = b.column(0).to_pylist()
            texts: dict[str, list[bytes]] = {}
            held = 0
            for i in range(len(b)):
                text = b.column(1)[i].as_buffer().to_pybytes()
                texts.setdefault(category[i], []).append(text)
                held += len(text)
                if held >= CHUNK or i + 1 == len(b):
                    for c, some in texts.items():
                        for tokens, own in _chunks(some, size):
                            yield from state.count(c.encode(), tokens, own)
                    texts, held = {}, 0
        yield from state.emit()
        yield from state.emit_buckets()

    return rows.mapInArrow(count, _PARTIAL)


def frequent_phrases(docs: DataFrame, least: int, longest: int = 3, category: str = "lang", text_col: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(category, phrase, size, f) of all phrases of up to `longest` words with f >= least, and (category, n) with n the number of words."""
    if not 1 <= least <= 255 or not 1 <= longest <= 3:
        raise ValueError("least must lie in 1..255 and longest in 1..3")
    scratch = scratch or Scratch(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col(category).cast("string"), F.lit("und")).alias("category"), text_of(text_col).alias("_text"))
    may = parts = None
    found, words = [], None
    for size in range(1, longest + 1):
        partial = scratch.save(_counted(rows, size, size < longest, may, parts), f"partial{size}")
        sums = partial.filter("segment is null").groupBy("category", "phrase").agg(F.sum("f").alias("f"))
        known = scratch.save(sums.filter((F.col("f") >= least) | F.col("phrase").isNull()).withColumn("size", F.lit(size)), f"frequent{size}")
        if size == 1:
            words = known.filter("phrase is null").select("category", F.col("f").alias("n"))
        known = known.filter("phrase is not null").select("category", "phrase", "size", "f")
        found.append(known)
        if size < longest:
            may, parts = _bitmap(partial, least), _marked(known)
        scratch.drop(f"partial{size}")
    return reduce(DataFrame.unionByName, found), words


def _part(words, first: int, n: int):
    return F.array_join(F.slice(words, first, n), " ")


def scored(cuts: DataFrame) -> DataFrame:
    """cuts (a, l, r) and score, exactly: counts have up to 13 digits, the products fit 38."""
    return cuts.withColumn("score", F.expr("(cast(a * 1000000BD as decimal(25,0)) * cast(a as decimal(13,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))"))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, drop_percent: int = 50, top: int = 2000, category: str = "lang", text_col: str = "text") -> DataFrame:
    """The `top` phrases of each category by score: category, rank, phrase, a, l, r, n, score.

    A phrase's score is floor(1000000 * a * a / (l * r)) of its count a and the counts l, r of the parts before and after the
    cut that scores least (ties: the earliest cut). Phrases inside a longer frequent one with drop_percent of their count or
    more are dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    known, words = frequent_phrases(docs, least, longest, category, text_col, scratch)
    split = F.split("phrase", " ")
    phrases = known.filter("size > 1").withColumn("w", split)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("category", "phrase", F.col("f").alias("a"), "k", F.struct("category", _part(F.col("w"), 1, F.col("k")).alias("p")).alias("first"), F.struct("category", F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("p")).alias("rest"))
    cuts = scratch.save(cuts, "cuts")
    total = cuts.count()
    for key, name in (("first", "l"), ("rest", "r")):
        used = cuts.groupBy(F.col(key).alias("p")).agg(F.count(F.lit(1)).alias("rows"))
        counts = used.join(known.select(F.struct("category", F.col("phrase").alias("p")).alias("p"), F.col("f").alias(name)), "p")
        cuts = join_groups(cuts, counts.withColumnRenamed("p", key), key, "phrase", "rows", total).drop("rows")
    best = scored(cuts).groupBy("category", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c")).select("category", "phrase", "a", "c.l", "c.r", "c.score")
    inside = phrases.filter(F.col("size") > 2)
    shorter = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    covered = inside.select("category", F.explode(F.array_distinct(shorter)).alias("phrase"), "f").groupBy("category", "phrase").agg(F.max("f").alias("most"))
    kept = best.join(covered, ["category", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < drop_percent * F.col("a"))).drop("most")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    kept = kept.withColumn("_part", part).withColumn("_k", F.row_number().over(Window.partitionBy("category", "_part").orderBy(*order))).filter(F.col("_k") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return kept.join(words, "category").select("category", "rank", "phrase", "a", "l", "r", "n", "score")
