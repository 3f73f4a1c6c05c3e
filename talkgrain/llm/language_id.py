"""Language identification: nearest of several clustered centroids per language, by cosine, with rejection by distance.

A text is a vector of the byte 1-, 2- and 3-grams of its words (lower case, ASCII signs and digits as spaces, hashed),
log-counted, weighted by inverse document frequency and normalised. Every language gets CLUSTERS centroids by spherical k-means over a bounded sample of labelled
texts (at most `per_language` of each language, those with the smallest hash of their id). A text belongs to the language
of the nearest centroid. It is rejected if that centroid is so far that the cosine is under REACH times what all but one
in a hundred of the sample's texts of such a length reach; short texts are naturally far, so bounds are per class of length.

Defined results: a text that is null or has no letter is `und`, score 0, rejected; without any labelled row every text
is; ties go to the language that sorts first; repeated rows each get their result, and are one in the sample; only the text
is looked at, so ids may be null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.llm import workers
from talkgrain.llm.common import batches_of, fresh

DIMENSIONS = 4096
PER_LANGUAGE = 400
CLUSTERS = 3
#: Upper ends, in bytes, of the classes of length.
LENGTHS = (16, 32, 64, 128, 256, 512, 1024)
#: Share of the sample's low cosines (first percentile) under which a text is rejected. Leaving one language out of four in
#: turn, half of it rejects 99 % and more of the language that was not learned, and one in a thousand of the learned ones.
REACH = 0.5
#: Texts are turned into vectors so many bytes at a time; counting takes about 60 bytes of arrays per byte.
STEP_BYTES = 1 << 18
#: Whole texts of the sample that are handed to Python at a time.
TEXTS = 256

#: Multipliers that hash 1-, 2- and 3-grams.
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def counts(texts: list[bytes]) -> np.ndarray:
    """Hashed n-gram counts, a row per text; a text above STEP_BYTES is counted in parts."""
    if len(texts) == 1 and len(texts[0]) > STEP_BYTES:
        t = texts[0]
        # parts overlap by two bytes; the 1- and 2-grams that lie within the overlap are counted once too often
        parts = [t[k : k + STEP_BYTES + 2] for k in range(0, len(t) - 2, STEP_BYTES)]
        out = _counts(parts[:1])
        for p in parts[1:]:
            out += _counts([p]) - _counts([p[:2]])
        return out
    return _counts(texts)


def _counts(texts: list[bytes]) -> np.ndarray:
    """Two zero bytes after each text keep its n-grams apart from the next one's."""
    joined = np.frombuffer(b"".join(t + b"\0\0" for t in texts) + b"\0\0", np.uint8).astype(np.uint32)
    sizes = np.array([len(t) + 2 for t in texts])
    n = int(sizes.sum())
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * DIMENSIONS, sizes)
    one, two, three = joined[:n], joined[1 : n + 1], joined[2 : n + 2]
    out = np.zeros(len(texts) * DIMENSIONS, np.float32)
    for gram, mix, real in ((one, MIX[0], one > 0), (one << 8 | two, MIX[1], (one > 0) & (two > 0)), (one << 16 | two << 8 | three, MIX[2], (one > 0) & (two > 0) & (three > 0))):
        place = ((gram[real] + np.uint32(1)) * np.uint32(mix)) >> np.uint32(20)
        out += np.bincount(row[real] + place, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), DIMENSIONS)


def steps(texts: list[bytes]) -> Iterator[slice]:
    start = size = 0
    for k, t in enumerate(texts):
        if len(t) > STEP_BYTES and start < k:
            yield slice(start, k)
            start, size = k, 0
        size += len(t)
        if size >= STEP_BYTES or k - start >= 255:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


#: ASCII letters and the bytes of all other characters stand for themselves, the rest for a space.
_WORDS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def lowered(texts: pa.Array) -> list[bytes]:
    return [b" %b " % b" ".join(t.lower().encode().translate(_WORDS).split()) for t in texts.to_pylist()]


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # language number of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reach: np.ndarray  # greatest distance per class of length

    def vectors(self, texts: list[bytes]) -> np.ndarray:
        return normalised(np.log1p(counts(texts)) * self.idf)

    def nearest(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, cosines, rejections."""
        cosine = self.vectors(texts) @ self.centroids.T
        best = np.stack([cosine[:, self.of == k].max(1) for k in range(len(self.languages))], 1)
        lang = best.argmax(1)
        score = np.clip(best[np.arange(len(lang)), lang], 0, 1)
        return lang, score, 1 - score > self.reach[classes(texts)]


def classes(texts: list[bytes]) -> np.ndarray:
    return np.searchsorted(LENGTHS, [len(t) for t in texts])


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the mean direction's nearest and then the farthest rows, so it is deterministic."""
    chosen = [int((x @ x.mean(0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    centre = x[chosen]
    for _ in range(12):
        of = (x @ centre.T).argmax(1)
        centre = normalised(np.stack([x[of == c].mean(0) if (of == c).any() else centre[c] for c in range(len(centre))]))
    return centre


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> Model | None:
    """Learns from at most per_language texts of each language; those vectors, and nothing else, come to the driver."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}")).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("text"))
    keys = rows.select("lang", "_id", "_h", F.xxhash64("_id", "_h").alias("_o")).groupBy("lang", "_id", "_h", "_o").agg(F.count(F.lit(1)).alias("_k"))
    # of a language with many texts only those with small hashes can be among the first; the bound lets about 4 x per_language pass
    many = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("_id", "_h"), 0.02).alias("_n"))
    span = F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("_n"))
    bounds = {r["lang"]: r["_b"] for r in many.select("lang", (span - 2.0**63).alias("_b")).toLocalIterator()}  # a number per language
    near = F.lit(False)
    for lang, bound in bounds.items():
        near = F.when(F.col("lang") == lang, F.col("_o").cast("double") <= bound).otherwise(near)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_o", "_id", "_h"))
    first = lambda some: some.withColumn("_rank", rank).filter(F.col("_rank") <= per_language).select(F.col("lang").alias("_sl"), F.col("_id").alias("_sid"), F.col("_h").alias("_sh"))
    chosen = first(keys.filter(near))
    sample = rows.join(F.broadcast(chosen), (F.col("lang") == F.col("_sl")) & F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_h") == F.col("_sh")), "left_semi")  # per_language rows of each language
    sample = sample.dropDuplicates(["lang", "_id", "_h"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.take_over("language")
        for b in batches:
            texts = lowered(b.column(1))
            for s in steps(texts):
                x = np.log1p(counts(texts[s])).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0)[s], pa.array([len(t) for t in texts[s]], pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "size", "v"])

    with batches_of(labelled.sparkSession, TEXTS):
        found = sample.select("lang", "text").mapInArrow(vectors, "lang string, size long, v binary").toPandas()
    if not len(found):
        return None
    found = found.sort_values(["lang", "size", "v"], kind="stable").reset_index(drop=True)
    x = np.stack([np.frombuffer(v, np.float16) for v in found["v"]]).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    x = normalised(x * idf)
    languages = sorted(set(found["lang"]))
    number = np.array([languages.index(lang) for lang in found["lang"]])
    centres = [clustered(x[number == k], clusters) for k in range(len(languages))]
    of = np.repeat(np.arange(len(languages)), [len(c) for c in centres])
    centroids = np.concatenate(centres).astype(np.float32)
    distance = 1 - (x @ centroids.T).max(1)
    at = np.searchsorted(LENGTHS, found["size"])
    reach = np.full(len(LENGTHS) + 1, -1.0)
    for c in range(len(reach)):
        if (at == c).sum() >= 5:
            reach[c] = 1 - REACH * np.quantile(1 - distance[at == c], 0.01)
    seen = np.flatnonzero(reach >= 0)
    for c in np.flatnonzero(reach < 0):  # a class with too few texts takes the bound of the next shorter one, as shorter texts are farther
        shorter = seen[seen < c]
        reach[c] = reach[shorter[-1]] if len(shorter) else 1.0
    reach = np.minimum(np.maximum.accumulate(reach[::-1])[::-1], 1.0)
    return Model(languages, of, centroids, idf, reach)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and: lang_pred, score, rejected; columns of docs that have these names are replaced. Only the texts go to Python."""
    judged, kind = fresh(docs, "_judged"), "struct<lang_pred: string, score: double, rejected: boolean>"

    @F.arrow_udf(kind)
    def predict(texts: pa.Array, has_letter: pa.Array) -> pa.Array:
        workers.take_over("language")
        lang: list[str] = ["und"] * len(texts)
        score, far = np.zeros(len(texts)), np.ones(len(texts), bool)
        real = np.flatnonzero(has_letter.to_numpy(zero_copy_only=False))
        if model and len(real):
            for part in np.array_split(real, -(-len(real) // 1024)):
                some = lowered(texts.take(pa.array(part)))
                for s in steps(some):
                    rows = part[s]
                    k, score[rows], far[rows] = model.nearest(some[s])
                    for r, n in zip(rows.tolist(), k.tolist()):
                        lang[r] = model.languages[n]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(far)], ["lang_pred", "score", "rejected"])

    has_letter = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    out = docs.withColumn(judged, predict(F.col(text_col), has_letter))
    new = ("lang_pred", "score", "rejected")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new], *[F.col(judged)[c].alias(c) for c in new])


def recognised(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with all their columns as they are."""
    far, columns = fresh(docs, "_far"), [F.col(f"`{c}`") for c in docs.columns]
    kept = {c: fresh(docs, f"_kept_{c}") for c in docs.columns if c.lower() in ("lang_pred", "score", "rejected")}
    out = identify(docs.withColumnsRenamed(kept), model, text_col=text_col).withColumnRenamed("rejected", far).filter(f"not `{far}`")
    return out.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in kept.items()}).select(*columns)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """The fold that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
