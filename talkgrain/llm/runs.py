"""Periodic runs in word sequences by heavy/light lag counting.

A run is a maximal stretch of words with smallest period q and at least max(6, 4q) words. Per document:

1. for every lag q up to a quarter of the words, the number of positions whose word comes again q words later is counted
   exactly: words above a frequency by the autocorrelation of their indicator (FFT, rounded to the whole number it stands
   for), rarer words by the differences of their positions;
2. a run of period q has at least max(6, 4q) - q such positions, so lags with fewer are never looked at. What runs that were
   found already contribute to the multiples of their periods is subtracted first;
3. the other lags get an island scan: stretches of consecutive matches that are long enough. For longer lags two adjacent
   blocks of q matches must exist, which a few probes per block refute cheaply.

A stretch whose smallest period p is a proper part of q is the same stretch at lag p (both are maximal), and is kept there.

Documents are independent, so nothing is shuffled; a task holds one document's word numbers and counts at a time.
Defined results: null or empty text has no words, no runs and an empty collapsed text; each row, repeated ones and those
with a null id too, gets its own row; an empty table gives an empty result; other columns are ignored, whatever their
names; texts of any length are read whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import text_of

LEAST_WORDS, LEAST_EXPONENT = 6, 4

#: Lags from here on are probed in blocks before they are scanned; and the probes of a block.
BLOCK_FROM, PROBES = 8, 8

#: Bytes of collapsed texts that are handed back to Spark at a time.
OUT_BYTES = 8 << 20

Words = list[bytes]
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(words: Words) -> np.ndarray:
    return np.fromiter(map(_Numbers().__getitem__, words), np.int64, len(words))


def matches(ids: np.ndarray, most: int) -> np.ndarray:
    """Of each lag up to `most` the number of i with ids[i] == ids[i + lag], exactly; lag 0 is left at 0."""
    n, count = len(ids), np.bincount(ids)
    found = np.zeros(most + 1, np.int64)
    heavy = max(32, math.isqrt(int(n * math.log2(n + 1))))
    at = np.argsort(ids, kind="stable")
    at = at[(count[ids[at]] > 1) & (count[ids[at]] <= heavy)]
    d, often = 1, count[ids[at]]
    while len(at) > d:
        if d & (d - 1) == 0:  # words that are too rare for this distance go, at every power of two
            at, often = at[often > d], often[often > d]
        same = ids[at[d:]] == ids[at[:-d]]
        if not same.any():
            break
        gaps = (at[d:] - at[:-d])[same]
        found += np.bincount(gaps[gaps <= most], minlength=most + 1)
        d += 1
    frequent = np.flatnonzero(count > heavy)
    if len(frequent):
        size = 1 << (n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for word in frequent:
            f = np.fft.rfft((ids == word).astype(np.float64), size)
            power += f.real**2 + f.imag**2
        found += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    found[0] = 0
    return found


def _may_hold(ids: np.ndarray, q: int) -> bool:
    """Whether two adjacent blocks of q positions may match in full; a run's stretch of 3q matches holds two such blocks."""
    blocks = np.arange((len(ids) - q) // q)
    for probe in range(PROBES):
        at = blocks * q + probe * q // PROBES
        blocks = blocks[ids[at] == ids[at + q]]
        if len(blocks) < 2:
            return False
    return bool((np.diff(blocks) == 1).any())


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period), by start and period."""
    n = len(ids)
    most = n // LEAST_EXPONENT
    if n < LEAST_WORDS:
        return []
    left = matches(ids, most)
    q = np.arange(most + 1)
    need = np.maximum(LEAST_WORDS, LEAST_EXPONENT * q) - q
    seen: dict[tuple[int, int], int] = {}
    for lag in np.flatnonzero(left >= need).tolist():
        if lag == 0 or left[lag] < need[lag] or (lag >= BLOCK_FROM and not _may_hold(ids, lag)):
            continue
        same = np.zeros(n - lag + 2, np.int8)
        same[1:-1] = ids[:-lag] == ids[lag:]
        edges = np.flatnonzero(np.diff(same))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= need[lag]
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            run = (start, end - start + lag)
            if run in seen:  # at a smaller lag, which divides this one
                continue
            seen[run] = lag
            every = np.arange(lag, min(run[1] - 1, most) + 1, lag)
            left[every] -= run[1] - every
    return sorted((start, length, period) for (start, length), period in seen.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; ties go to the smallest start, then period."""
    best = None
    for run in runs:  # by start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words without the repetitions: of each run its first period stays."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    gone = np.cumsum(depth[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[object, Words], Words] | None = None) -> DataFrame:
    """Per row: id, runs (array of start, length, period by start and period), best (the strongest of them or null), collapsed (text).

    Words are runs of bytes other than ASCII white space. `edit` may change a row's words before the search.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, first, out, size = b.column(0), 0, [], 0
            texts = b.column(1)
            for i in range(len(b)):
                words = texts[i].as_buffer().to_pybytes().split()
                if edit:
                    words = edit(ids[i].as_py(), words)
                runs = find_runs(numbered(words))
                text = b" ".join(collapsed(words, runs))
                out.append((runs, strongest(runs), text))
                size += len(text)
                if size > OUT_BYTES or i + 1 == len(b):
                    yield pa.RecordBatch.from_arrays([ids.slice(first, i + 1 - first), *_arrays(out)], [id_col, "runs", "best", "collapsed"])
                    first, out, size = i + 1, [], 0

    def _arrays(out: list) -> list[pa.Array]:
        named = lambda r: r and dict(zip(("start", "length", "period"), r))
        return [pa.array([[named(r) for r in runs] for runs, _, _ in out], pa.list_(RUN)), pa.array([named(best) for _, best, _ in out], RUN), pa.array([text for _, _, text in out], pa.binary()).cast(pa.string())]

    run = "struct<start: bigint, length: bigint, period: bigint>"
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(solve, f"`{id_col}` {kind}, runs array<{run}>, best {run}, collapsed string")


def looped(doc_id: int | None, words: Words) -> Words:
    """Test material: a tenth of all documents, chosen by id, go on in a loop from some word on. A null id plants nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What periodic_runs found, as figures and digests: n_runs, the strongest run, checksums of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
