"""Token counts by heap-and-linked-list byte-pair merging: symbols at the start minus merges, without making ids.

Each distinct run of non-space bytes is counted once per worker (talkgrain.llm.tokens); the cache is bounded.
Defined results: null text is empty; the empty text has 0 tokens; every row, repeated ones too, gets its own row;
an empty table gives an empty result; other columns are ignored, whatever their names; texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.tokens import counter


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit. `tokenizer` is the path of a byte-pair vocabulary on every executor."""
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            texts = [t.as_buffer().to_pybytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(c.count, texts), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
