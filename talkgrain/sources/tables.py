"""Sources and sinks: transcripts, JSON documents, JSONL logs, CSV logs, audio admission, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CALL_NAME = "^(call_\\d+_(ar|en|mixed))\\.txt$"
#: Suffix, and where in the first bytes which hex digits must stand.
AUDIO = {"wav": (1, "52494646"), "mp3": (1, "494433"), "ogg": (1, "4F676753"), "flac": (1, "664C6143"), "m4a": (5, "66747970")}


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """call_id, language, text of every well-named transcript, whole."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    rows = spark.read.text(folder, wholetext=True).select("value", name.alias("name"))
    return rows.filter(F.col("name").rlike(CALL_NAME)).select(F.regexp_extract("name", CALL_NAME, 1).alias("call_id"), F.regexp_extract("name", CALL_NAME, 2).alias("language"), F.col("value").alias("text"))


def call_name(name: Column) -> Column:
    """Struct call_id, language of a file name; raises on any other name."""
    bad = F.raise_error(F.concat(F.lit("not a call name: "), name))
    return F.when(name.rlike(CALL_NAME), F.struct(F.regexp_extract(name, CALL_NAME, 1).alias("call_id"), F.regexp_extract(name, CALL_NAME, 2).alias("language"))).otherwise(bad)


def language_suffix(call_id: Column) -> Column:
    return F.nullif(F.regexp_extract(call_id, "_(ar|en|mixed)$", 1), F.lit(""))


def documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document per file; the first bad one stops the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(folder)


def log(spark: SparkSession, path: str, record: str, segment: str) -> tuple[DataFrame, DataFrame]:
    """Records and segments of a JSONL log; torn and blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "").filter(F.expr("try_parse_json(value)").isNotNull())
    kind = F.coalesce(F.get_json_object("value", "$.type"), F.lit("record"))
    read = lambda k, s: lines.filter(kind == k).select(F.from_json("value", s).alias("x")).select("x.*")
    return read("record", record), read("segment", segment)


def strict_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def completed(lines: DataFrame, existing: DataFrame, key: str = "call_id", at: str = "line") -> DataFrame:
    """Resume log: the last entry per key, if its file is still there."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    return lines.withColumn("_n", last).filter("_n = 1").drop("_n").join(existing, "path", "left_semi")


def held_out(doc: DataFrame, column: str = "value") -> DataFrame:
    """language, call_id from a JSON map of lists; _meta is not a language."""
    m = F.map_filter(F.from_json(column, "map<string,array<string>>"), lambda k, _: k != "_meta")
    return doc.select(F.explode(m).alias("language", "ids")).select("language", F.explode("ids").alias("call_id"))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("step int, epoch double, train_loss double, eval_loss double").csv(path, header=True)


def admitted_audio(files: DataFrame, most_bytes: int) -> DataFrame:
    """binaryFile rows with status: 200, 413 (too large), 415 (suffix), 422 (content)."""
    suffix = F.lower(F.element_at(F.split("path", "\\."), -1))
    right = F.lit(False)
    for s, (at, magic) in AUDIO.items():
        right = right | ((suffix == s) & (F.hex(F.substring("content", at, len(magic) // 2)) == magic))
    return files.withColumn("status", F.when(~suffix.isin(*AUDIO), 415).when(F.col("length") > most_bytes, 413).when(~right, 422).otherwise(200))


def save_checkpoint(df: DataFrame, path: str, n_batches: int) -> None:
    """A run's state, with the number of batches that it was planned for."""
    df.withColumn("_n_batches", F.lit(n_batches)).write.mode("overwrite").parquet(path)


def load_checkpoint(spark: SparkSession, path: str, n_batches: int) -> DataFrame:
    """The state of a run of so many batches; that of another plan is refused."""
    df = spark.read.parquet(path)
    return df.withColumn("_n_batches", F.when(F.col("_n_batches") == n_batches, F.col("_n_batches")).otherwise(F.raise_error(F.lit("the checkpoint is of another number of batches")))).filter("_n_batches is not null").drop("_n_batches")


def assembled(spark: SparkSession, path: str, record: str, segment: str) -> tuple[DataFrame, DataFrame]:
    """Records and segments of a document {records, segments, meta}."""
    doc = spark.read.schema(f"records array<struct<{record}>>, segments array<struct<{segment}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return tuple(doc.select(F.explode(c).alias("x")).select("x.*") for c in ("records", "segments"))


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows as JSON lines with their keys in alphabetical order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode(mode).text(path)


def with_provenance(df: DataFrame, method: str, model: str, at: Column) -> DataFrame:
    return df.withColumn("_provenance", F.struct(F.lit(method).alias("method"), F.lit(model).alias("model"), at.alias("generated_at"), F.lit(False).alias("human_reviewed")))


def markdown(rows: list[dict], columns: list[str], digits: int = 3) -> str:
    """A small result as a Markdown table; nulls are dashes."""
    show = lambda x: "—" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows])
