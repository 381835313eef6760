"""Dense retrieval: exhaustive cosine search of a query set, in blocks.

A stated set of query vectors is compared with all records.  The queries are
carried to the records in blocks of checked size; each partition of records is
one matrix product per block and keeps its best ``n`` per query, so what is
shuffled is ``n`` rows per query and partition, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 20
BLOCK = 2048


def records(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``chunk_id, embedding`` of rows that have both; repeats are kept."""
    return table.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).alias("chunk_id"), F.col(vector).cast("array<double>").alias("embedding")
    )


def embedded(
    rows: DataFrame, text: str, embedder: Callable[[list[str]], list] | None, batch: int = 128
) -> DataFrame:
    """``rows`` with ``embedding array<double>`` and ``dense_covered``.

    ``embedder(texts)`` returns a vector or null per text and runs on the
    executors, ``batch`` texts at a time.  Without one, and where it fails or
    answers with nothing, an empty vector or something that is no list, the
    embedding is null and the row is not covered; the job never fails.
    """
    if embedder is None:
        return rows.withColumn("embedding", F.lit(None).cast("array<double>")).withColumn("dense_covered", F.lit(False))

    def vectors(texts: list[str]) -> list:
        try:
            found = list(embedder(texts))
        except Exception:  # noqa: BLE001 - fails open
            found = []
        found += [None] * (len(texts) - len(found))
        return [[float(x) for x in v] if isinstance(v, (list, tuple)) and len(v) else None for v in found[: len(texts)]]

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        given = [t or "" for t in texts]
        return pd.Series([v for i in range(0, len(given), batch) for v in vectors(given[i : i + batch])], dtype=object)

    return rows.withColumn("embedding", run(text)).withColumn("dense_covered", F.col("embedding").isNotNull())


def covered(rows: DataFrame) -> DataFrame:
    """``chunks, embedded``: how many rows there are and how many got a vector."""
    return rows.agg(F.count("*").alias("chunks"), F.count_if("dense_covered").alias("embedded"))


def upsert(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Records with those of the same key replaced."""
    return index.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(
        fresh.select(*index.columns)
    )


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Records without the given keys."""
    return index.join(ids, "chunk_id", "left_anti")


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Unit rows; a vector of another length or without direction is all zero."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            out[i] = v
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def search(index: DataFrame, queries: DataFrame, n: int = TOP, digits: int | None = 5) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of the ``n`` best records per query.

    ``queries`` has ``query_id, embedding``.  Scores of zero and below stay in;
    unequal lengths score 0.  Rounded to ``digits`` before ranking; ties by
    ``chunk_id``.  The query vectors pass through the driver block by block.
    """
    spark = index.sparkSession
    kinds = {c: index.schema[c].dataType.simpleString() for c in ("chunk_id",)}
    qkind = queries.schema["query_id"].dataType.simpleString()
    parts, block = [], []
    rows = queries.where("query_id is not null and embedding is not null").select(
        "query_id", F.col("embedding").cast("array<double>").alias("embedding")
    )

    def add(block: list) -> None:
        carried = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            widths: dict[int, list[int]] = {}
            for i, (_, v) in enumerate(carried.value):
                widths.setdefault(len(v), []).append(i)
            held: pd.DataFrame | None = None
            for batch in batches if widths else ():
                if not len(batch):
                    continue
                ids, vectors = batch["chunk_id"].to_numpy(), batch["embedding"].tolist()
                names, places, values = [], [], []
                for width, asked in widths.items():
                    q = _matrix([carried.value[i][1] for i in asked], width)
                    s = q @ _matrix(vectors, width).T
                    if digits is not None:
                        s = np.round(s, digits) + 0.0
                    keep = min(n, s.shape[1])
                    for r, i in enumerate(asked):
                        # All that reach the n-th score stay, so that ties are settled by id.
                        floor = np.partition(s[r], -keep)[-keep]
                        at = np.flatnonzero(s[r] >= floor)
                        if len(at) > keep:
                            at = at[np.lexsort((ids[at], -s[r][at]))[:keep]]
                        names += [carried.value[i][0]] * len(at)
                        places.append(at)
                        values.append(s[r][at])
                fresh = pd.DataFrame(
                    {"query_id": names, "chunk_id": ids[np.concatenate(places)], "score": np.concatenate(values)}
                )
                both = fresh if held is None else pd.concat([held, fresh])
                both = both.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True])
                held = both.groupby("query_id", sort=False).head(n)
            if held is not None:
                yield held

        parts.append(
            index.select("chunk_id", "embedding").mapInPandas(
                run, f"query_id {qkind}, chunk_id {kinds['chunk_id']}, score double"
            )
        )

    for r in rows.toLocalIterator():
        block.append((r["query_id"], r["embedding"]))
        if len(block) == BLOCK:
            add(block)
            block = []
    if block or not parts:
        add(block)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)
