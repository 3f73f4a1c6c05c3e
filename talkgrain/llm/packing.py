"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens; only longer ones are cut. A full piece is a sequence already. The
others are spread over groups by hash. Every group has ISLANDS islands, each a task of its own with a population of packings
of the group's pieces. A crossover injects whole well-filled bins of one parent into the other, removes the bins that hold
duplicates of them, and best-fits the displaced pieces. After each epoch every island's best packing, its elite, migrates to
the next island of the ring through a table. At the end the well-filled bins of a group's best packing are settled; the
pieces of the others go on to the next round, in which they share far fewer groups, until one is left.

Fewer bins are better, then a greater sum of squared fillings, that is more full bins; so evolution goes on when the number of
bins is the least possible already, and the bins that it fills are settled in their round. It stops early only at a packing
that cannot be better: the least number of bins, of which one is not full.

Defined results: a null or empty text is the end token alone; every row is packed, repeated ones too, and null ids are ids
like any other; an empty table gives an empty result. Which sequence a piece gets depends on ids, checksums and lengths; among
rows that repeat all of these, on where they stand. Other columns are ignored, whatever their names; texts of any length are packed whole.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm.common import Scratch, batches_of, checked
from talkgrain.llm.tokens import CACHE_ENTRIES, encoder

#: Pieces that a group has on average. A group that got SPLIT times as many, by rows that repeat each other, is divided.
BLOCK, SPLIT = 1024, 4
ISLANDS, PACKINGS, EPOCHS, GENERATIONS = 2, 4, 2, 3
#: A bin is settled in its round if at most so many tokens of it are free, or if it is the last round.
SLACK = 8
ROUNDS = 6
#: Whole texts that are handed to Python at a time.
TEXTS = 1024


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE_ENTRIES) -> DataFrame:
    """Pieces: id, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end, step = encoder(tokenizer, cache), end_id.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for k, ids in enumerate(e.encode_all([t.as_buffer().to_pybytes() for t in b.column(1)])):
                ids += end
                rows += [(k, p, at // 4, min(len(ids) - at, step) // 4, zlib.crc32(ids[at : at + step])) for p, at in enumerate(range(0, len(ids), step))]
            k, piece, start, length, crc = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(k, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                [id_col, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(pieces, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """A packing: bins of item numbers, found by free space for best fit."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0

    @classmethod
    def read(cls, lengths: list[int], capacity: int, data: bytes) -> Bins:
        """From the bin number of every item."""
        p, of = cls(lengths, capacity), np.frombuffer(data, np.int32)
        order = np.argsort(of, kind="stable")
        for items in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
            items = items.tolist()
            p.add_bin(items, capacity - sum(map(lengths.__getitem__, items)))
        return p

    def written(self) -> bytes:
        of = np.zeros(len(self.lengths), np.int32)
        for k, items in enumerate(self.bins):
            of[items] = k
        return of.tobytes()

    def add_bin(self, items: list[int], free: int) -> None:
        self.bins.append(items)
        self.free.append(free)
        self._offer(len(self.bins) - 1, free)

    def _offer(self, b: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(b)
            self.mask |= 1 << free

    def fit(self, items: list[int]) -> None:
        """Best fit, in the order given: the bin with the least free space that is enough, else a new one."""
        lengths, by_free = self.lengths, self.by_free
        for i in items:
            n = lengths[i]
            if enough := self.mask >> n:
                f = n + (enough & -enough).bit_length() - 1
                some = by_free[f]
                b = some.pop()
                if not some:
                    self.mask &= ~(1 << f)
                self.bins[b].append(i)
                self.free[b] = f - n
                self._offer(b, f - n)
            else:
                self.add_bin([i], self.capacity - n)

    def perfect(self) -> bool:
        return len(self.bins) == -(-sum(self.lengths) // self.capacity) and sum(f > 0 for f in self.free) <= 1

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then more full ones."""
        return -len(self.bins), sum((self.capacity - f) ** 2 for f in self.free)


def packed(lengths: list[int], order: list[int], capacity: int) -> Bins:
    p = Bins(lengths, capacity)
    p.fit(order)
    return p


#: Crossovers that this process has made.
crossovers = [0]


def crossed(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Injects well-filled bins of b whole into a; bins of a with duplicates go, what they displace is best-fitted again."""
    crossovers[0] += 1
    ranked = sorted(range(len(b.bins)), key=b.free.__getitem__)
    good = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.sample(good, max(1, len(good) // 2))
    injected = {i for k in chosen for i in b.bins[k]}
    worst = set(sorted(range(len(a.bins)), key=a.free.__getitem__)[-max(1, len(a.bins) // 20) :])  # mutation: these are dissolved as well
    child, displaced = Bins(a.lengths, a.capacity), []
    for k in chosen:
        child.add_bin(list(b.bins[k]), b.free[k])
    for k, items in enumerate(a.bins):
        if k in worst or not injected.isdisjoint(items):
            displaced += [i for i in items if i not in injected]
        else:
            child.add_bin(list(items), a.free[k])
    displaced.sort(key=a.lengths.__getitem__, reverse=True)
    child.fit(displaced)
    return child


def settlers(lengths: list[int], capacity: int, rng: random.Random, packings: int) -> list[Bins]:
    """An island's first packings: best fit in decreasing order, and in orders near to it."""
    down = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    out = [packed(lengths, down, capacity)]
    for k in range(1, packings):
        blur = [n * rng.uniform(1 - 0.05 * k, 1) for n in lengths]
        out.append(packed(lengths, sorted(down, key=blur.__getitem__, reverse=True), capacity))
    return out


def epoch(island: list[Bins], rng: random.Random, generations: int) -> list[Bins]:
    """The island after some generations, its best packing first."""
    island = sorted(island, key=Bins.fitness, reverse=True)
    if len(island[0].bins) < 2 or len(island) < 2:
        return island
    for _ in range(generations):
        if island[0].perfect():
            break
        mates = [island[rng.randrange(1, len(island))] for _ in range(2)]
        children = [crossed(island[0], mates[0], rng), crossed(mates[1], island[0], rng)]
        island = sorted(island[: max(1, len(island) - 2)] + children, key=Bins.fitness, reverse=True)[: len(island)]
    return island


def evolve(lengths: list[int], capacity: int, seed: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> Bins:
    """What the islands of one group come to, in one process."""
    world = [settlers(lengths, capacity, _rng(seed, k, 0), PACKINGS) for k in range(islands)]
    for e in range(epochs):
        world = [epoch(island, _rng(seed, k, e + 1), GENERATIONS) for k, island in enumerate(world)]
        elites = [island[0] for island in world]
        world = [[*island[:-1], elites[k - 1]] for k, island in enumerate(world)]
    return max((island[0] for island in world), key=Bins.fitness)


def _rng(group: int, island: int, step: int) -> random.Random:
    return random.Random((group * 64 + island) * 64 + step)


STATE = "g long, island int, lengths array<int>, population array<binary>, bins int, squares double"


def _epochs(groups: DataFrame, capacity: int, scratch: Scratch, name: str) -> DataFrame:
    """groups (g, lengths): g, best (the bin number of every piece, of the best packing of all islands)."""

    def settle(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            population, bins, squares = [], [], []
            for g, k, lengths, old, visitor in zip(*(c.to_pylist() for c in b.columns)):
                rng = _rng(g, k, step)
                island = settlers(lengths, capacity, rng, PACKINGS) if old is None else [Bins.read(lengths, capacity, x) for x in old]
                if visitor is not None:
                    island[-1] = Bins.read(lengths, capacity, visitor)
                island = epoch(island, rng, GENERATIONS)
                population.append([p.written() for p in island])
                fewest, fill = island[0].fitness()
                bins.append(-fewest), squares.append(float(fill))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(population, pa.list_(pa.binary())), pa.array(bins, pa.int32()), pa.array(squares, pa.float64())], ["g", "island", "lengths", "population", "bins", "squares"])

    width = max(1, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    state = groups.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).select("g", "island", "lengths", F.lit(None).cast("array<binary>").alias("population"), F.lit(None).cast("binary").alias("visitor"))
    for step in range(EPOCHS):
        dealt = state.repartition(width, "g", "island")
        with batches_of(scratch.spark, 16):
            out = scratch.save(dealt.mapInArrow(lambda batches, step=step: settle(batches, step + 1), STATE), f"{name}-epoch{step}")
        elite = out.select("g", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.get("population", 0).alias("visitor"))
        state = out.select("g", "island", "lengths", "population").join(elite, ["g", "island"])
    best = out.groupBy("g").agg(F.min(F.struct("bins", (-F.col("squares")).alias("fill"), "island", F.get("population", 0).alias("best"))).alias("b"))
    return best.select("g", "b.best")


def pack(pieces: DataFrame, capacity: int, scratch: Scratch, id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """pieces and: sequence_id, offset. `pieces` has id, piece, start, length, ids_crc32 and should be a scratch table."""
    names = pieces.columns
    whole = pieces.filter(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    left, done = scratch.save(pieces.filter(F.col("length") < capacity).withColumn("_row", F.monotonically_increasing_id()), "left"), [whole]
    count = left.count()
    for round_no in range(1, ROUNDS + 1):
        if not count:
            break
        blocks = -(-count // block)
        last = blocks == 1 or round_no == ROUNDS
        dealt = left.withColumn("_block", F.pmod(F.xxhash64(F.lit(round_no), id_col, "piece", "length", "ids_crc32"), F.lit(blocks)).cast("long"))
        large = dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SPLIT * block).withColumn("_parts", F.ceil(F.col("_n") / block))
        before = F.coalesce(F.sum("_parts").over(Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # blocks that got too many rows only
        large, _ = checked(scratch.save(large.select("_block", "_parts", (before + blocks).alias("_first")), f"large{round_no}"))
        dealt = dealt.join(large, "_block", "left").withColumn("g", F.coalesce(F.col("_first") + F.pmod("_row", "_parts"), "_block"))
        item = F.struct((-F.col("length")).alias("_down"), *names, "_row")
        groups = scratch.save(dealt.groupBy("g").agg(F.sort_array(F.collect_list(item)).alias("items")), f"groups{round_no}")
        best = _epochs(groups.select("g", F.transform("items", lambda x: x["length"].cast("int")).alias("lengths")), capacity, scratch, f"round{round_no}")

        def place(batches: Iterator[pa.RecordBatch], round_no: int = round_no, last: bool = last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    g, data = b.column(0)[k].as_py(), b.column(2)[k].as_py()
                    items = b.column(1)[k].values
                    fields = {f.name: items.field(n) for n, f in enumerate(items.type)}
                    packing = Bins.read(fields["length"].to_pylist(), capacity, data)
                    sequence, offset = [None] * len(items), [0] * len(items)
                    for n, members in enumerate(packing.bins):
                        if not last and packing.free[n] > SLACK:
                            continue
                        at = 0
                        for i in members:
                            sequence[i], offset[i] = round_no << 59 | g << 14 | n, at
                            at += packing.lengths[i]
                    yield pa.RecordBatch.from_arrays([*(fields[c] for c in names), fields["_row"], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "_row", "sequence_id", "offset"])

        schema = kinds.replace(", sequence_id long", ", _row long, sequence_id long")
        with batches_of(scratch.spark, 64):
            out = scratch.save(groups.join(best, "g").select("g", "items", "best").mapInArrow(place, schema), f"round{round_no}")
        done.append(out.filter(F.col("sequence_id").isNotNull()).select(*names, "sequence_id", "offset"))
        left = out.filter(F.col("sequence_id").isNull()).select(*names, "_row")
        count = 0 if last else left.count()
        scratch.drop(f"groups{round_no}", f"large{round_no}", *[f"round{round_no}-epoch{e}" for e in range(EPOCHS)])
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE_ENTRIES) -> DataFrame:
    """Where each piece of each document goes. cache: entries of a generation of the tokenizer's cache in each worker; fewer take less memory and more time."""
    scratch = Scratch(docs.sparkSession, "packing")
    with batches_of(scratch.spark, TEXTS):
        pieces = scratch.save(cut(docs, tokenizer, capacity, 0, id_col, text_col, cache), "pieces")
    return pack(pieces, capacity, scratch, id_col)
