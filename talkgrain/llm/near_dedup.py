"""Near-duplicate detection with SetSketch registers: banding, joint likelihood, verification on full sets, components.

A document's set is its distinct shingles of WORDS words as 64-bit hashes (the whole sequence if it has fewer words).
Register i of its sketch is an exponentially spaced, truncated minimum: with x the smallest of the elements' values under
the i-th hash, taken as an exponential variate, it is floor(1 - log_BASE(x)) kept within 0..255. Registers merge by
maximum, and equal registers grow likelier with similarity.

1. One scan makes sketch, set size and set digest of every whole text; equal sets become one class at once. A class has a
   number of its own, whatever ids its rows have, and its set is fetched by id and digest.
2. Bands of ROWS registers put classes into buckets. In each bucket all members are compared with one pivot, which
   differs from band to band, so a large group of copies costs a row per member and band, not one per pair.
3. A compared pair stays if the joint likelihood of its registers, given both set sizes, does not speak against the
   threshold; then both full sets are fetched and intersected, and real links are kept.
4. Components of the links found so far are formed. A bucket that still spans more than one component is searched in
   full: in blocks bounded by members and by elements, all its pairs across components go through likelihood and
   verification as well, each pair in the first bucket that the two share. Pairs inside a component cannot change anything any more, so no link of the
   buckets is lost; and only members and real links leave a block, never its pairs.

Defined results: null, empty or blank text has the empty set, links with nothing and stays; rows that repeat an id are
one document, and each of their texts has a component; a component is named by its smallest id, of any type; a null id
is its own component and stays; an empty table gives an empty result; other columns are ignored or passed through,
whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm import workers
from talkgrain.llm.common import Scratch, batches_of, checked, fresh, join_groups

WORDS = 5
ROWS, BANDS = 5, 24
REGISTERS = ROWS * BANDS
BASE = 1.1
#: Value of a register for an element whose exponential variate is 1; keeps registers of 1 to 2^32 elements within 1..254.
ZERO = 20
#: Log-likelihood by which the threshold may be less likely than the best similarity before a pair is given up.
DOUBT = 9.0
#: Members that a task compares with each other at a time are two parts of a bucket; a part has so many members and elements on average.
BLOCK, ELEMENTS = 512, 1 << 21
#: Rows with whole sets, and with whole texts, that are handed to Python at a time.
SETS, TEXTS = 256, 1024

_rng = np.random.default_rng(20_240_229)
_MULTIPLY = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Words:
    """64-bit hashes of words, kept for the words a worker has met."""

    LIMIT = 200_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if new:
            import xxhash

            if len(known) + len(new) > self.LIMIT:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_words = Words()
workers.keeps("words", _words.known.clear)
#: Lower-cases A-Z and nothing else.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8."""
    h = _words.hashes(text.translate(_LOWER).split())
    if not len(h):
        return h
    k = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX[i % 5]
            out ^= out >> np.uint64(31)
    return np.unique(out)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set, as bytes."""
    low = ((elements >> np.uint64(32)) ^ elements).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(low), 512):
            v = low[k : k + 512, None] * _MULTIPLY + _ADD
            v ^= v >> np.uint32(15)
            np.minimum(least, v.min(0), out=least)
    x = -np.log1p(-(least + 0.5) / 4294967296.0)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + ZERO, 0, 255).astype(np.uint8)


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0, 1, 101)[:-1]


def plausible(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, limit: float) -> np.ndarray:
    """Whether similarity `limit` or more is plausible: more, less: registers of a that are greater, smaller than b's."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = np.concatenate([_GRID[None, :] * most, most], 1)
    tiny = 1e-12
    up, down = np.maximum(_share(u - v * j), tiny), np.maximum(_share(v - u * j), tiny)
    likely = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (REGISTERS - more - less)[:, None] * np.log(np.maximum(1 - up - down, tiny))
    near = np.where(j >= np.minimum(limit, most) - 1e-9, likely, -np.inf).max(1)
    return (most[:, 0] >= limit - 1e-9) & (near >= likely.max(1) - DOUBT)


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def digest(elements: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(elements.tobytes())


def profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _h (hash of the text), n (set size), digest (of the set), sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.take_over("words")
        for b in batches:
            n, digests, registers = [], [], []
            for t in b.column(2):
                s = shingles(t.as_buffer().to_pybytes())
                n.append(len(s))
                digests.append(digest(s) if len(s) else None)
                registers.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())], ["_id", "_h", "n", "digest", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(scan, f"_id {kind}, _h long, n long, digest binary, sketch binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"))


def _bucket_rows(classes: DataFrame) -> DataFrame:
    """bucket (64-bit hash of band number and its registers), band, c, n: a row for each band of a class."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", k * ROWS + 1, ROWS)) for k in range(BANDS)])
    return classes.select("c", "n", F.posexplode(keys).alias("band", "bucket"))


def _pivot_pairs(rows: DataFrame, total: int) -> DataFrame:
    """Each member of a bucket with the bucket's pivot: the member whose number is nearest to the bucket's hash by exclusive or."""
    mask = F.xxhash64("bucket")
    pivots = rows.groupBy("bucket").agg(F.min(F.col("c").bitwiseXOR(mask)).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    pivots = pivots.select("bucket", F.col("m").bitwiseXOR(mask).alias("p"), "k")
    met = join_groups(rows, pivots, "bucket", "c", "k", total)
    return met.filter("c <> p").select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct()


def _likely(pairs: DataFrame, classes: DataFrame, limit: float) -> DataFrame:
    """The pairs whose sketches do not speak against the limit."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                p = b.slice(at, 4096)
                n_a, n_b = (p.column(k).to_numpy().astype(float) for k in (2, 3))
                s_a, s_b = (np.frombuffer(b"".join(p.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS) for k in (4, 5))
                fit = pa.array(plausible(n_a, n_b, (s_a > s_b).sum(1), (s_a < s_b).sum(1), limit))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1)], ["a", "b"]).filter(fit)

    return both.mapInArrow(judge, "a long, b long")


def _open_blocks(rows: DataFrame, labels: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Members, block by block, of the buckets that span more than one component."""
    named = rows.join(labels, "c", "left").select("c", "n", "bucket", "band", F.coalesce("label", "c").alias("label"))
    spans = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("all")).filter("lo <> hi")
    parts = F.ceil(F.greatest(F.col("k") / BLOCK, F.col("all") / ELEMENTS)).cast("int")
    some = join_groups(named, spans.select("bucket", parts.alias("parts"), "k"), "bucket", "c", "k", total).filter("parts is not null")
    some = some.join(classes.select("c", "sketch"), "c")
    some = some.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    # a block meets itself and every other one once: a member of part p goes to the blocks (p, q) of all q
    some = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return some.select("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "c", "label", "n", "band", "sketch")


def _block_pairs(block: pa.RecordBatch, limit: float) -> Iterator[tuple[int, np.ndarray]]:
    """Per row of a block: the later rows that form a likely pair with it, across components, whose first common bucket this is."""
    p, q, part, _, label, n, band = (block.column(k).to_numpy() for k in range(1, 8))
    s = np.frombuffer(b"".join(block.column(8).to_pylist()), np.uint8).reshape(-1, REGISTERS)
    for i in range(len(n) - 1):
        ok = label[i + 1 :] != label[i]
        if p[i] != q[i]:
            ok &= part[i + 1 :] != part[i]
        at = np.flatnonzero(ok) + i + 1
        size = n[at].astype(float)
        at = at[np.minimum(size, n[i]) >= limit * np.maximum(size, n[i]) - 1e-9]
        if not len(at):
            continue
        same = s[at] == s[i]
        first = same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[i]
        at = at[first & (same.mean(1) >= limit - 0.35)]
        if len(at):
            at = at[plausible(np.full(len(at), float(n[i])), n[at].astype(float), (s[i] > s[at]).sum(1), (s[i] < s[at]).sum(1), limit)]
        if len(at):
            yield i, at


_BLOCK_KEYS = ["bucket", "p", "q"]


def _dealt(rows: DataFrame) -> DataFrame:
    width = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(width, *_BLOCK_KEYS).sortWithinPartitions(*_BLOCK_KEYS, "c")


def _involved(blocks: DataFrame, limit: float) -> DataFrame:
    """The members of blocks that have a pair to verify there."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 3):
            keep = np.zeros(block.num_rows, bool)
            for i, at in _block_pairs(block, limit):
                keep[i] = keep[at] = True
            if keep.any():
                yield block.filter(pa.array(keep))

    return _dealt(blocks).mapInArrow(search, blocks.schema)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = shared(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _block_links(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: real links of the blocks' members; those inside what is connected already are left out."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 3):
            c, label = block.column(4).to_pylist(), block.column(5).to_pylist()
            full = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column(9)]
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = up.get(y, y)
                    x = y
                return x

            found = []
            for i, at in _block_pairs(block, percent / 100):
                for j in at.tolist():
                    x, y = root(label[i]), root(label[j])
                    if x == y:
                        continue
                    if _linked(full[i], full[j], percent):
                        up[max(x, y)] = min(x, y)
                        found.append({"a": min(c[i], c[j]), "b": max(c[i], c[j])})
            if found:
                yield pa.RecordBatch.from_pylist(found, kind)

    return _dealt(blocks.join(sets, "c").select(*blocks.columns, "s")).mapInArrow(verify, "a long, b long").distinct()


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal first columns, each whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for col in cols:
            new[1:] |= col[1:] != col[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in cols)
        start = 0
        for cut in [*np.flatnonzero(new).tolist(), b.num_rows]:
            if cut in (0,) and held:
                yield _whole(held)
                held = []
            elif cut > start:
                held.append(b.slice(start, cut - start))
                if cut < b.num_rows:
                    yield _whole(held)
                    held = []
            start = cut
        last = tuple(c[-1] for c in cols)
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """c, label (the smallest id of its component) for the ids of links (a, b), by large-star and small-star steps."""
    edges = scratch.save(links.select("a", "b"), f"{name}-0")
    step = 0
    while True:
        step += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b")  # greater neighbours to the smallest one
        down = large.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct()
        low = down.groupBy("b").agg(F.min("a").alias("m"))
        small = down.join(low, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        after = scratch.save(small.filter("a <> b").distinct(), f"{name}-{step}")
        # stars only: no id is both a centre and a leaf, and every leaf has one centre
        odd = after.groupBy("b").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)), F.count(F.lit(1))).first()
        settled = odd[0] <= 1 and after.select(F.col("a").alias("b")).distinct().join(after.select("b"), "b", "left_semi").isEmpty()
        scratch.drop(f"{name}-{step - 1}")
        edges = after
        if settled:
            leaves = edges.select(F.col("b").alias("c"), F.col("a").alias("label"))
            return leaves.unionByName(edges.select(F.col("a").alias("c"), F.col("a").alias("label")).distinct())


class _Classes:
    """The classes of equal sets of some documents, and what links them."""

    def __init__(self, docs: DataFrame, percent: int, id_col: str, text_col: str):
        self.scratch, self.percent, self.limit = Scratch(docs.sparkSession, "near"), percent, percent / 100
        self.texts = _texts(docs, id_col, text_col)
        with batches_of(docs.sparkSession, TEXTS):
            self.profiles = self.scratch.save(profile(docs, id_col, text_col), "profiles")
        real = self.profiles.filter(F.col("digest").isNotNull() & F.col("_id").isNotNull())
        made = real.groupBy("digest", "n", "sketch").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("members"))
        self.classes = self.scratch.save(made.withColumn("c", F.monotonically_increasing_id()), "classes")
        #: Rows that repeat id and set would repeat a fetched set.
        self.repeated = not real.groupBy("_id", "digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").isEmpty()

    def sets(self, wanted: DataFrame, name: str) -> DataFrame:
        """c, s (shingle hashes): the full sets of some classes, from the text of each one's smallest id."""
        need = self.classes.join(wanted.select("c").distinct(), "c", "left_semi").select(F.col("first").alias("_need"), "digest", "c")
        need, _ = checked(self.scratch.save(need, f"{name}-ids"))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            workers.take_over("words")
            for b in batches:
                keep, s = [], []
                for k, (t, d) in enumerate(zip(b.column(2), b.column(1).to_pylist())):
                    x = shingles(t.as_buffer().to_pybytes())
                    if len(x) and digest(x) == d:  # else another text of the id
                        keep.append(k), s.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(s, pa.binary())], ["c", "s"])

        found = self.texts.join(need, F.col("_id") == F.col("_need")).select("c", "digest", "_text").mapInArrow(fetch, "c long, s binary")
        with batches_of(self.scratch.spark, SETS):
            return self.scratch.save(found.distinct() if self.repeated else found, f"{name}-sets")

    def checked_pairs(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links."""
        percent = self.percent

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = ((np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(k)) for k in (2, 3))
                ok = [_linked(x, y, percent) for x, y in zip(*sets)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        found = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("c")), "pivot")
        one, two = (found.select(F.col("c").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
        with batches_of(self.scratch.spark, SETS):
            return self.scratch.save(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), "links")

    def labels(self) -> DataFrame:
        """c, label (the smallest number of its component) for the classes that have links."""
        scratch = self.scratch
        rows, total = _bucket_rows(self.classes), self.classes.count() * BANDS
        pairs = scratch.save(_likely(_pivot_pairs(rows, total), self.classes, self.limit), "pairs")
        links = self.checked_pairs(pairs)
        scratch.drop("pivot-sets", "pivot-ids", "pairs")
        labels = scratch.save(components(links, scratch, "first"), "first")
        blocks = scratch.save(_involved(_open_blocks(rows, labels, self.classes, total), self.limit), "blocks")
        sets = self.sets(blocks, "block")
        with batches_of(scratch.spark, SETS):
            more = scratch.save(_block_links(blocks, sets, self.percent), "more")
        scratch.drop("block-sets", "block-ids", "blocks", "links")
        if more.isEmpty():
            return labels
        stars = labels.filter("c <> label").select(F.col("label").alias("a"), F.col("c").alias("b"))
        return scratch.save(components(stars.unionByName(more), scratch, "second"), "labels")

    def named(self) -> DataFrame:
        """digest, component (its smallest id), members: a row per class."""
        linked = self.classes.select("c", "first").join(self.labels(), "c")
        groups = self.scratch.save(linked.groupBy("label").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("k")), "components")
        total = groups.agg(F.sum("k")).first()[0] or 0
        mine = join_groups(linked, groups, "label", "c", "k", total).select("c", "component")
        return self.classes.join(mine, "c", "left").select("digest", F.coalesce("component", "first").alias("component"), "members")


def _judged(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A row per row of docs: _id, _h (hash of the text), n, component."""
    found = _Classes(docs, percent, id_col, text_col)
    named = found.scratch.save(found.named(), "named")
    total = named.agg(F.sum("members")).first()[0] or 0
    out = join_groups(found.profiles.select("_id", "_h", "n", "digest"), named, "digest", "_id", "members", total)
    return out.select("_id", "_h", "n", F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id")).alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept. Links: 100 x shared >= percent x all shingles of the two."""
    kept = F.col("_id").eqNullSafe(F.col("component"))
    return _judged(docs, percent, id_col, text_col).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns."""
    scratch, lid, lh = Scratch(docs.sparkSession, "near-drop"), fresh(docs, "_lid"), fresh(docs, "_lh")
    lost = _judged(docs, percent, id_col, text_col).filter(~F.col("_id").eqNullSafe(F.col("component"))).select(F.col("_id").alias(lid), F.col("_h").alias(lh))
    lost, _ = checked(scratch.save(lost, "lost"))
    return docs.join(lost, (F.col(id_col) == F.col(lid)) & (F.xxhash64(F.coalesce(text_col, F.lit(""))) == F.col(lh)), "left_anti")
