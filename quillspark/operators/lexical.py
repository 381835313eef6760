"""Lexical retrieval: an inverted index in three tables, and BM25 over it.

The index is ``docs(chunk_id, length)``, ``postings(term, chunk_id, tf)`` and
the corpus statistics.  Scoring joins the postings with the distinct terms of
all queries at once, so only the lists of terms that are asked for are touched;
the sum per (query, chunk) is the only wide shuffle and is evenly spread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import text as T

K1 = 1.2
B = 0.75
TOP = 20
#: Terms of all queries, repeats counted, up to which they are broadcast.
FEW_TERMS = 200_000


@dataclass(frozen=True)
class Index:
    """The tables of a lexical index."""

    docs: DataFrame
    postings: DataFrame

    def stats(self) -> DataFrame:
        """``doc_count, sum_lengths, avg_length``; an empty index averages 0."""
        return self.docs.agg(
            F.count("*").alias("doc_count"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("sum_lengths"),
            F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"),
        )

    def write(self, path: str) -> None:
        """Both tables as Parquet, postings sorted by term for pruning."""
        self.docs.write.parquet(f"{path}/docs")
        self.postings.sortWithinPartitions("term").write.parquet(f"{path}/postings")

    @staticmethod
    def read(spark, path: str) -> Index:
        """An index written before."""
        return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"))


def distinct_keys(documents: DataFrame, key: str) -> bool:
    """Whether no key comes twice, by the key column alone."""
    return not documents.groupBy(key).count().where("count > 1").limit(1).count()


def one_per_key(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``chunk_id, text`` with one row per key; null keys are void.

    Of rows with one key the one with the greatest hash of its text counts.
    Only if keys repeat is anything joined, and then keys, hashes and row
    numbers, never texts.
    """
    rows = documents.where(F.col(key).isNotNull()).select(
        F.col(key).alias("chunk_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    if distinct_keys(rows, "chunk_id"):
        return rows
    # Written (narrow), so that both sides of the join see the same row numbers.
    rows = session.scratch(rows.withColumn("__row", F.monotonically_increasing_id()), "index-rows")
    kept = rows.groupBy("chunk_id").agg(F.max(F.struct(F.xxhash64("text"), "__row")).alias("r"))
    return rows.join(kept.select(F.col("r.__row").alias("__row")), "__row", "left_semi").drop("__row")


def build(documents: DataFrame, key: str = "chunk_id", text: str = "text") -> Index:
    """The index of a table of texts; a null text has no terms."""
    rows = session.spread(one_per_key(documents, key, text), "chunk_id")
    terms = rows.select("chunk_id", T.tokens(F.col("text")).alias("terms"))
    docs = terms.select("chunk_id", F.size("terms").cast("bigint").alias("length"))
    postings = (
        terms.select("chunk_id", F.explode("terms").alias("term"))
        .groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    )
    return Index(docs, postings)


def stored(index: Index) -> Index:
    """The index written once to the shared folder, for plans that read it several times."""
    return Index(session.scratch(index.docs, "index-docs"), session.scratch(index.postings, "index-postings"))


def remove(index: Index, ids: DataFrame) -> Index:
    """The index without the chunks in ``ids(chunk_id)``."""
    return Index(
        index.docs.join(ids, "chunk_id", "left_anti"), index.postings.join(ids, "chunk_id", "left_anti")
    )


def upsert(index: Index, documents: DataFrame, key: str = "chunk_id", text: str = "text") -> Index:
    """The index with these texts added or replaced."""
    fresh = build(documents, key, text)
    kept = remove(index, fresh.docs.select("chunk_id"))
    return Index(kept.docs.unionByName(fresh.docs), kept.postings.unionByName(fresh.postings))


def idf_column(n, df):
    """Natural logarithm form with one inside: never negative."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf(index: Index) -> DataFrame:
    """``term, df, idf`` of every term."""
    df = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(index.stats())).select(
        "term", "df", idf_column(F.col("doc_count"), F.col("df")).alias("idf")
    )


def scores(index: Index, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, chunk_id, score`` of every chunk that shares a term with a query.

    ``queries`` has ``query_id, query``.  Repeated query terms count once; null
    queries match nothing.  The query terms are broadcast only if there are few.
    """
    asked = queries.select(
        "query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term")
    )
    few = asked.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    small = F.broadcast if few else (lambda df: df)
    hits = index.postings.join(small(asked.select("term").distinct()), "term", "left_semi")
    # The rarity of a term over the whole index, for the terms asked for.
    rarity = (
        hits.groupBy("term").agg(F.count("*").alias("df"))
        .crossJoin(F.broadcast(index.stats()))
        .select(
            "term", "avg_length", idf_column(F.col("doc_count"), F.col("df")).alias("idf")
        )
    )
    weighted = asked.join(rarity, "term")
    average = F.when(F.col("avg_length") == 0, 1.0).otherwise(F.col("avg_length"))
    tf = F.col("tf")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / average))
    # Weighted terms are at most those asked for.
    return (
        hits.join(small(weighted), "term")
        .join(index.docs, "chunk_id")
        .groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    )


def top(scored: DataFrame, n: int = TOP, digits: int | None = None) -> DataFrame:
    """The best ``n`` per query with ``rank`` from 1; ties by ``chunk_id``.

    ``digits`` rounds the score before ranking, for results that do not depend
    on the order of a floating-point sum.
    """
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)


def search(index: Index, queries: DataFrame, n: int = TOP, digits: int | None = 6) -> DataFrame:
    """BM25 for all queries at once."""
    return top(scores(index, queries), n, digits)


def lookup(index: Index, chunk_id, term: str | None = None) -> DataFrame:
    """A point lookup: a chunk's postings, or its frequency of one term.

    Both conditions reach the scan of a written index (postings are sorted by
    term, so row groups are skipped).
    """
    rows = index.postings.where(F.col("chunk_id") == F.lit(chunk_id))
    return rows if term is None else rows.where(F.col("term") == term)
