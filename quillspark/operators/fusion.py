"""Reciprocal rank fusion, reranking, and the retrieval pipeline over both indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import text as T
from quillspark.kernels import chunker
from quillspark.operators import chunk, dense, lexical

K = 60
PER_INDEX = 150
FUSED = 150
FINAL = 20


class IndexQuerier(Protocol):
    """Anything that ranks chunks for a table of queries."""

    def query_batch(self, queries: DataFrame, top_n: int) -> DataFrame:
        """``query_id, chunk_id, score, rank``."""


def side(hits: DataFrame, name: str, k: int) -> DataFrame:
    """One list per (query, chunk): the sum of its contributions, last score and rank.

    A chunk that a list repeats adds up, and its last place counts.
    """
    last = F.max(F.struct("rank", "score"))
    return hits.groupBy("query_id", "chunk_id").agg(
        F.sum(T.rrf(F.col("rank"), k)).alias(f"{name}_part"), last.alias("l")
    ).select(
        "query_id", "chunk_id", f"{name}_part",
        F.col("l.score").alias(f"{name}_score"), F.col("l.rank").alias(f"{name}_rank"),
    )


def fuse(dense: DataFrame, lexical: DataFrame, k: int = K, n: int = FUSED, digits: int | None = 9) -> DataFrame:
    """Both rankings as one: candidates with scores and ranks of either side.

    Ordered by fused score, then dense score, then lexical score (missing ones
    last), then ``chunk_id``; at most ``n`` per query, ``rank`` from 1.
    """
    both = side(dense, "dense", k).join(side(lexical, "lexical", k), ["query_id", "chunk_id"], "full_outer")
    fused = F.coalesce("dense_part", F.lit(0.0)) + F.coalesce("lexical_part", F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("fused_score"), F.desc_nulls_last("dense_score"), F.desc_nulls_last("lexical_score"), "chunk_id"
    )
    return (
        both.withColumn("fused_score", fused if digits is None else F.round(fused, digits))
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= n)
        .select(
            "query_id", "chunk_id", "fused_score", "dense_score", "lexical_score",
            "dense_rank", "lexical_rank", "rank",
        )
    )


def retrieve(
    queries: DataFrame, dense: IndexQuerier, lexical: IndexQuerier, per_index: int = PER_INDEX, n: int = FUSED
) -> DataFrame:
    """Both indexes asked and fused."""
    return fuse(dense.query_batch(queries, per_index), lexical.query_batch(queries, per_index), n=n)


def with_text(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates joined with ``chunk_id, text``; those without a text drop out.

    Only texts of candidates move; of a chunk's several texts the greatest counts.
    """
    ids = session.broadcast_small(candidates.select("chunk_id").distinct(), 100_000)
    texts = chunks.where("text is not null").select("chunk_id", "text").join(ids, "chunk_id", "left_semi")
    return candidates.join(texts.groupBy("chunk_id").agg(F.max("text").alias("text")), "chunk_id")


def by_input_order(candidates: DataFrame, n: int) -> DataFrame:
    """The defined result without a provider: fused order, no reranker score."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        candidates.withColumn("final_rank", (F.row_number().over(order) - 1).cast("bigint"))
        .where(F.col("final_rank") < n)
        .withColumn("reranker_score", F.lit(None).cast("double"))
    )


def by_provider(candidates: DataFrame, given: DataFrame, n: int) -> DataFrame:
    """The provider's order: ``given`` has ``query_id, chunk_id, position, score``.

    Candidates that it did not return drop out, chunks that were no candidates
    are skipped, a chunk returned twice counts at its first place, and the order
    is trusted whatever the scores.
    """
    first = given.groupBy("query_id", "chunk_id").agg(F.min(F.struct("position", "score")).alias("g"))
    order = Window.partitionBy("query_id").orderBy("g.position", "chunk_id")
    return (
        candidates.join(first, ["query_id", "chunk_id"])
        .withColumn("final_rank", (F.row_number().over(order) - 1).cast("bigint"))
        .where(F.col("final_rank") < n)
        .withColumn("reranker_score", F.col("g.score").cast("double"))
        .drop("g")
    )


def rerank(
    candidates: DataFrame,
    chunks: DataFrame,
    provider: Callable[[str, list[str]], list[tuple[int, float]] | None] | None = None,
    queries: DataFrame | None = None,
    n: int = FINAL,
) -> DataFrame:
    """Candidates with text, reordered; ``final_rank`` from 0.

    ``provider(query, texts)`` returns ``(index, score)`` in its order, or null;
    it is called once per query in an Arrow batch.  Without a provider, and for
    queries on which it fails or returns nothing, the input order stands.
    """
    if n <= 0:
        raise ValueError("n is at least 1")
    # At most FUSED rows a query; the texts are looked up for these alone.
    ready = with_text(session.scratch(candidates, "fused"), chunks)
    if provider is None or queries is None:
        return by_input_order(ready, n)
    # A query's candidates are at most FUSED rows; three plans below read them.
    ready = session.scratch(ready, "candidates")
    asked = ready.join(queries.select("query_id", "query"), "query_id")
    qkind = candidates.schema["query_id"].dataType.simpleString()
    ckind = candidates.schema["chunk_id"].dataType.simpleString()

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        try:
            ranked = provider(pdf["query"].iloc[0], pdf["text"].tolist()) or []
        except Exception:  # noqa: BLE001 - a provider must never fail the job
            ranked = []
        ids, out, taken = pdf["chunk_id"].tolist(), [], set()
        for index, score in ranked:
            if 0 <= index < len(ids) and index not in taken:
                taken.add(index)
                out.append((pdf["query_id"].iloc[0], ids[index], len(out), float(score)))
        return pd.DataFrame(out, columns=["query_id", "chunk_id", "position", "score"])

    given = asked.groupBy("query_id").applyInPandas(
        call, f"query_id {qkind}, chunk_id {ckind}, position bigint, score double"
    )
    answered = given.select("query_id").distinct()
    rest = ready.join(answered, "query_id", "left_anti")
    return by_provider(ready, given, n).unionByName(by_input_order(rest, n))


class HttpError(Exception):
    """Raised by a provider whose endpoint answered with a failure."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


# The published prompt, as a block around a document and one around a chunk of it.
PROMPT_DOCUMENT = (
    "<document>\n{document}\n</document>\n\n"
    "Here is the chunk we want to situate within the whole document\n<chunk>\n"
)
PROMPT_CHUNK = (
    "{chunk}\n</chunk>\n\n"
    "Please give a short succinct context to situate this chunk within the overall document for the purposes of "
    "improving search retrieval of the chunk. Answer only with the succinct context and nothing else."
)


def context_request(document, chunk, model: str, max_tokens: int = 200):
    """The request for a chunk's preamble as a struct column.

    The document is a block of its own that a provider may cache, so all chunks
    of a document share it word for word.
    """
    before, after = PROMPT_DOCUMENT.split("{document}")
    ahead, behind = PROMPT_CHUNK.split("{chunk}")
    block = lambda text, kept: F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(kept).alias("cached")
    )
    content = F.array(
        block(F.concat(F.lit(before), F.coalesce(document, F.lit("")), F.lit(after)), True),
        block(F.concat(F.lit(ahead), F.coalesce(chunk, F.lit("")), F.lit(behind)), False),
    )
    return F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), content.alias("content"))


def contextualize(
    chunks: DataFrame,
    documents: DataFrame,
    provider: Callable[[str, str], str | None] | None = None,
) -> DataFrame:
    """Chunks with ``context_preamble, context_status, context_failure_reason``.

    ``provider(document, chunk)`` writes the preamble; chunks are grouped by
    document and ordered, so that a provider's prompt cache holds.  Without one
    the status is ``failed`` for ``missing_api_key``; an empty answer is
    ``empty_response``, an ``HttpError`` is ``http_`` and its status, any other
    exception ``throw_`` and its message.
    """
    if provider is None:
        return chunks.select(
            "*",
            F.lit(None).cast("string").alias("context_preamble"),
            F.lit("failed").alias("context_status"),
            F.lit("missing_api_key").alias("context_failure_reason"),
        )
    texts = lexical.one_per_key(documents, "doc_id", "text").select(
        F.col("chunk_id").alias("doc_id"), F.col("text").alias("__document")
    )
    ready = (
        chunks.join(texts, "doc_id", "left").repartition("doc_id").sortWithinPartitions("doc_id", "ordinal")
    )
    added = "context_preamble string, context_status string, context_failure_reason string"
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for document, text in zip(batch.pop("__document"), batch["text"]):
                try:
                    preamble = (provider(document or "", text or "") or "").strip()
                    said.append((preamble, "ok", None) if preamble else (None, "failed", "empty_response"))
                except HttpError as error:
                    said.append((None, "failed", f"http_{error.status}"))
                except Exception as error:  # noqa: BLE001
                    said.append((None, "failed", f"throw_{error}" if str(error) else "throw_unknown"))
            batch[["context_preamble", "context_status", "context_failure_reason"]] = pd.DataFrame(
                said, index=batch.index, columns=["a", "b", "c"]
            )
            yield batch

    return ready.mapInPandas(run, f"{kept}, {added}")


def contextual_text(preamble, text):
    """What the contextual index holds: the preamble above the text, if there is one."""
    return F.when(preamble.isNull() | (preamble == ""), text).otherwise(F.concat(preamble, F.lit("\n\n"), text))


def index_documents(
    documents: DataFrame,
    context: Callable[[str, str], str | None] | None = None,
    embedder: Callable[[list[str]], list] | None = None,
    size: int = chunker.CHUNK_SIZE,
    overlap: int = chunker.OVERLAP,
) -> tuple[DataFrame, lexical.Index, DataFrame]:
    """``(chunks, lexical index, dense records)`` of ``doc_id, text``: documents are
    chunked, contextualised, embedded and indexed.

    Chunks have ``chunk_id, text, context_preamble, context_status`` and
    ``dense_covered``: whether the embedder gave them a vector.
    """
    parts = chunk.chunk(documents.select("doc_id", "text"), size=size, overlap=overlap).withColumnRenamed("id", "chunk_id")
    said = contextualize(parts, documents, context)
    said = said.withColumn("indexed_text", contextual_text(F.col("context_preamble"), F.col("text")))
    said = session.scratch(dense.embedded(said, "indexed_text", embedder), "indexed-chunks")
    vectors = said.where("dense_covered").select("chunk_id", "embedding")
    return said.drop("embedding"), lexical.build(said, "chunk_id", "indexed_text"), vectors


def ask(
    queries: DataFrame,
    chunks: DataFrame,
    index: lexical.Index,
    vectors: DataFrame,
    embedder: Callable[[list[str]], list] | None = None,
    provider: Callable[[str, list[str]], list[tuple[int, float]] | None] | None = None,
    top_k: int = FINAL,
    fan_out: int = PER_INDEX,
) -> DataFrame:
    """The whole retrieval for ``query_id, query``: both indexes, fused, reranked.

    Queries that the embedder has no vector for are answered lexically alone.
    """
    asked = dense.embedded(queries, "query", embedder).where("dense_covered")
    near = dense.search(vectors, asked.select("query_id", "embedding"), fan_out)
    fused = fuse(near, lexical.search(index, queries, fan_out), n=fan_out)
    return rerank(fused, chunks, provider, queries, top_k)
