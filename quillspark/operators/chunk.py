"""Chunking tables of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import text as T
from quillspark.kernels import chunker

SCHEMA = (
    "id string, ordinal bigint, text string, token_count bigint, heading_path array<string>,"
    " start bigint, end bigint"
)

#: Characters of chunks that are sent on at a time.
AT_ONCE = 4_000_000


def chunk(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = chunker.CHUNK_SIZE,
    overlap: int = chunker.OVERLAP,
    mode: str = "clean",
) -> DataFrame:
    """The chunks of every document: ``key, id, ordinal, text, token_count,
    heading_path, start, end``.

    Narrow: one document at a time, in place.  A null text is an empty one and
    gives one empty chunk, rows with a null key are void, repeated rows repeat
    their chunks.  ``mode`` is ``clean`` or ``compat`` (see the kernel).
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need size > 0 and 0 <= overlap < size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for k, name, body in batch.itertuples(index=False, name=None):
                for c in chunker.chunks(body, name, size, overlap, mode):
                    rows.append((k, c.id, c.ordinal, c.text, c.token_count, c.heading_path, c.start, c.end))
                    held += len(c.text)
                if held > AT_ONCE:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    names = ["__key", *(c.split()[0] for c in SCHEMA.split(", "))]
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__key"), F.col(key).cast("string"), F.coalesce(F.col(text), F.lit(""))
    )
    return (
        session.spread(rows)
        .mapInPandas(run, f"__key {kind}, {SCHEMA}")
        .withColumnRenamed("__key", key)
    )


def fixed_windows(
    documents: DataFrame, key: str = "doc_id", text: str = "text",
    size: int = chunker.CHUNK_SIZE, overlap: int = chunker.OVERLAP,
) -> DataFrame:
    """Windows of fixed length without regard to boundaries, all in SQL.

    ``key, ordinal, text, token_count``; a null or empty text has no windows.
    """
    step, width = (size - overlap) * 4, size * 4
    last = F.greatest(F.ceil((F.length(text) - width) / F.lit(step)), F.lit(0)).cast("int")
    return (
        documents.where(F.length(text) > 0)
        .select(key, text, F.explode(F.sequence(F.lit(0), last)).alias("n"))
        .select(
            key, F.col("n").cast("bigint").alias("ordinal"),
            F.substring(F.col(text), F.col("n") * step + 1, F.lit(width)).alias("text"),
        )
        .withColumn("token_count", T.approx_tokens(F.col("text")).cast("bigint"))
    )


def regrouped(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document its chunk texts in order."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return chunks.groupBy(key).agg(F.transform(parts, lambda x: x["text"]).alias("texts"))
