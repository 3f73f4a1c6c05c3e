"""Training-order materialisation: token sequences in a keyed random order, as fixed-stride shards of raw token ids.

Every document becomes sequences of `length` ids (the last one padded). A keyed hash of document and sequence deals the
sequences to shards of about `rows`; a shard numbers its own without gaps, in the order of their documents, and a keyed
Feistel permutation of these numbers, with cycle-walking so that it stays inside them, gives each its row. The shards follow
each other by number, so a sequence's global slot is the rows of the shards before its own plus its row. Row r stands at byte
r x stride; so a reader can start at any slot and read on sequentially, and can resume where it stopped.

Texts are tokenized once, and the ids are shuffled once; nothing else of the size of the corpus is kept or joined, at any
size. Key, texts, ids and the number of shards alone decide the order.
Defined results: a null or empty text is the end token alone; a null id is an id like any other; rows that repeat id and
text are one; an empty table writes nothing; other columns are ignored, whatever their names; texts of any length are written whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgrain.llm import files
from talkgrain.llm.common import Scratch, batches_of, checked
from talkgrain.llm.tokens import encoder16

FEISTEL_ROUNDS = 6
#: Tasks that write shards at most; beyond them a task writes several.
WRITERS = 100_000
#: Shards whose rows are summed at once when slots are counted.
SPAN = 4096
#: Bytes of text that make a token, for the number of shards; they only decide how full the shards are.
TOKEN_BYTES = 2


def permuted(numbers: np.ndarray, size: int, key: str) -> np.ndarray:
    """A permutation of 0..size-1 that only the key decides, applied to some of its numbers."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")) for r in range(FEISTEL_ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(numbers.astype(np.uint64))
        while (outside := out >= np.uint64(size)).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def _tokens(tokenizer: str, texts: pa.Array, end: bytes) -> list[bytes]:
    return [ids + end for ids in encoder16(tokenizer).encode_all([t.as_buffer().to_pybytes() for t in texts])]


def write_shards(docs: DataFrame, tokenizer: str, key: str, scratch: Scratch, length: int = 512, rows: int = 16_384, end_id: int = 49_407, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; one row per sequence: id, sequence, slot, shard, byte_offset, n_tokens, ids_crc32, path."""
    stride, end, pad = 2 * length, end_id.to_bytes(2, "little"), pad_id.to_bytes(2, "little")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(text_col, F.lit(""))
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    # as if every document's last sequence were half full
    shards = max(1, -(-(size // (TOKEN_BYTES * length) + n // 2) // rows))
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, who, piece, n, ids = b.slice(at, 256), [], [], [], []
                for k, data in enumerate(_tokens(tokenizer, part.column(2), end)):
                    for p, o in enumerate(range(0, len(data), stride)):
                        some = data[o : o + stride]
                        who.append(k), piece.append(p), n.append(len(some) // 2), ids.append(some)
                rows_of = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows_of), part.column(1).take(rows_of), pa.array(piece, pa.int32()), pa.array(n, pa.int32()), pa.array(ids, pa.binary())], ["_id", "_h", "sequence", "n_tokens", "ids"])

    found = keyed.mapInArrow(sequences, f"_id {kind}, _h long, sequence int, n_tokens int, ids binary")
    found = found.withColumn("shard", F.pmod(F.xxhash64(F.lit(key), "_id", "_h", "sequence"), F.lit(shards)).cast("int"))
    tasks, folder = min(shards, WRITERS), scratch.path("shards")
    dealt = found.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "_id", "_h", "sequence")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()

        def one(held: list[pa.RecordBatch], shard: int) -> pa.RecordBatch:
            """Writes a shard, of about `rows` sequences, in the order of the permutation."""
            t = pa.Table.from_batches(held).combine_chunks()
            who, h, piece = t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2).to_pylist()
            last, keep = object(), []
            for k, name in enumerate(zip(who, h, piece)):
                if name != last:  # else a repeated row
                    keep.append(k)
                last = name
            t = t.take(pa.array(keep, pa.int64()))
            place = permuted(np.arange(len(keep), dtype=np.int64), len(keep), f"{key}/{shard}")
            ids = t.column(4).combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            path, crc = f"{folder}/shard-{shard:06d}-{attempt}.bin", np.zeros(len(keep), np.int64)
            with files.writer(path) as out:
                for k in np.argsort(place).tolist():
                    data = ids[k].as_buffer().to_pybytes()
                    data += pad * ((stride - len(data)) // 2)
                    crc[k] = zlib.crc32(data)
                    out.write(data)
            rest = [t.column(0).combine_chunks(), t.column(2).combine_chunks(), pa.array(place), pa.array([shard] * len(keep), pa.int32()), t.column(3).combine_chunks(), pa.array(crc), pa.array([path] * len(keep))]
            return pa.RecordBatch.from_arrays(rest, [id_col, "sequence", "row", "shard", "n_tokens", "ids_crc32", "path"])

        held, shard = [], None
        for b in batches:
            s = b.column(5).to_numpy()
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for start, stop in zip(cuts, cuts[1:]):
                if stop > start:
                    if held and s[start] != shard:
                        yield one(held, shard)
                        held = []
                    shard = int(s[start])
                    held.append(b.slice(start, stop - start))
        if held:
            yield one(held, shard)

    made = f"`{id_col}` {kind}, sequence int, row long, shard int, n_tokens int, ids_crc32 long, path string"
    with batches_of(scratch.spark, 2048):
        index = scratch.save(dealt.select("_id", "_h", "sequence", "n_tokens", "ids", "shard").mapInArrow(write, made), "index")
    return _slots(index, scratch, stride).select(id_col, "sequence", "slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "path")


def _slots(index: DataFrame, scratch: Scratch, stride: int) -> DataFrame:
    """index with the global slots: rows of the shards before, summed in spans of shards, plus the row in the shard."""
    counts = scratch.save(index.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")), "counts").withColumn("_span", F.floor(F.col("shard") / SPAN))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.groupBy("_span").agg(F.sum("_n").alias("_m"))
    spans = spans.select("_span", before("_m", Window.partitionBy(F.lit(0)).orderBy("_span")).alias("_o"))  # a row per SPAN shards
    first = counts.withColumn("_f", before("_n", Window.partitionBy("_span").orderBy("shard"))).join(F.broadcast(spans), "_span")
    first, _ = checked(scratch.save(first.select("shard", (F.col("_f") + F.col("_o")).alias("_first")), "first"))
    return index.join(first, "shard").withColumn("slot", F.col("_first") + F.col("row")).withColumn("byte_offset", F.col("row") * stride)


def read_slots(shards: list[tuple[str, int]], start: int, n: int, length: int) -> np.ndarray:
    """Ids of n slots from `start` on; shards: path and rows of each, in order. A reader resumes by its next slot alone."""
    out, stride = [], 2 * length
    for path, rows in shards:
        if n > 0 and start < rows:
            with files.random_reader(path) as f:
                f.seek(start * stride)
                some = min(n, rows - start)
                out.append(np.frombuffer(f.read(some * stride), "<u2").reshape(-1, length))
            n, start = n - some, 0
        else:
            start -= rows
        if n <= 0:
            break
    return np.concatenate(out) if out else np.zeros((0, length), "<u2")


def verify(spark: SparkSession, index: DataFrame, length: int = 512, id_col: str = "doc_id") -> DataFrame:
    """Reads every shard sequentially, and gives per sequence what index says, with the checksum of what was read."""
    stride = 2 * length
    shards = index.groupBy("path").agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("n"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first, n in zip(*(c.to_pylist() for c in b.columns)):
                with files.reader(path) as f:
                    done = 0
                    while data := f.read(stride * 1024):
                        crc = [zlib.crc32(data[k : k + stride]) for k in range(0, len(data), stride)]
                        yield pa.RecordBatch.from_arrays([pa.array(range(first + done, first + done + len(crc)), pa.int64()), pa.array(crc, pa.int64())], ["slot", "read_crc32"])
                        done += len(crc)
                    if done != n:
                        raise ValueError(f"{path} holds {done} sequences; {n} were written")

    return index.join(shards.mapInArrow(read, "slot long, read_crc32 long"), "slot")
