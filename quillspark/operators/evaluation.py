"""Retrieval quality: one minus recall at n, over tiers, with a breakdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ["tier1", "tier2", "tier3", "missed", "unknown"]


def matched(hits: DataFrame, chunks: DataFrame, questions: DataFrame, n: int = 20) -> DataFrame:
    """``question_id, matched``: whether any of the first ``n`` hits holds an
    expected substring (by case, in the text without preamble).

    ``hits`` has ``query_id, chunk_id, rank``; questions without hits did not
    match; hits without a text are skipped.
    """
    asked = questions.select("question_id", "expected")
    # A row per substring: of a lambda over both sides of the join the optimizer
    # infers a filter on the questions' side alone, where there is no text.
    parts = asked.select("question_id", F.explode("expected").alias("part"))
    good = (
        hits.where(F.col("rank") <= n)
        .join(chunks.select("chunk_id", "text"), "chunk_id")
        .join(parts, F.col("query_id") == F.col("question_id"))
        .where(F.col("text").contains(F.col("part")))
        .select("question_id").distinct().withColumn("hit", F.lit(True))
    )
    return asked.select("question_id").join(good, "question_id", "left").select(
        "question_id", F.coalesce("hit", F.lit(False)).alias("matched")
    )


def summary(results: DataFrame, target: float) -> DataFrame:
    """``attempted, matched, failure_rate, passed``; nothing attempted fails all."""
    return results.agg(
        F.count("*").alias("attempted"), F.count_if("matched").alias("matched")
    ).select(
        "attempted", "matched",
        F.when(F.col("attempted") == 0, 1.0)
        .otherwise(1 - F.col("matched") / F.col("attempted")).alias("failure_rate"),
    ).withColumn("passed", F.col("failure_rate") <= target)


def caught_at(tier1: DataFrame, tier2: DataFrame | None = None, tier3: DataFrame | None = None) -> DataFrame:
    """``question_id, caught_at``: the first tier that matched; with both upper
    tiers skipped a miss is ``unknown``, else ``missed``."""
    rows = tier1.withColumnRenamed("matched", "m1")
    for name, tier in (("m2", tier2), ("m3", tier3)):
        if tier is None:
            rows = rows.withColumn(name, F.lit(None).cast("boolean"))
        else:
            rows = rows.join(tier.withColumnRenamed("matched", name), "question_id", "left")
    rest = "unknown" if tier2 is None and tier3 is None else "missed"
    stage = F.when(F.col("m1"), "tier1").when(F.col("m2"), "tier2").when(F.col("m3"), "tier3").otherwise(rest)
    return rows.select("question_id", stage.alias("caught_at"))


def breakdown(caught: DataFrame) -> DataFrame:
    """``caught_at, questions`` with every stage, zero or not."""
    stages = caught.sparkSession.createDataFrame([(s,) for s in STAGES], "caught_at string")
    counts = caught.groupBy("caught_at").agg(F.count("*").alias("n"))
    return stages.join(counts, "caught_at", "left").select(
        "caught_at", F.coalesce("n", F.lit(0)).alias("questions")
    )


def unanswered(caught: DataFrame) -> DataFrame:
    """Questions that no tier answered, for diagnosis."""
    return caught.where(F.col("caught_at").isin("missed", "unknown"))


def report(results: DataFrame, target: float, tier: str) -> DataFrame:
    """``line, passed``: one tier's result as a sentence; the caller's exit status is
    ``passed``."""
    percent = lambda c: F.format_string("%.1f%%", 100 * c)
    return summary(results, target).select(
        F.concat(
            F.lit(f"{tier}: "), F.col("matched").cast("string"), F.lit("/"), F.col("attempted").cast("string"),
            F.lit(" matched, failure rate "), percent(F.col("failure_rate")), F.lit(", target "),
            percent(F.lit(target)), F.when(F.col("passed"), " (passed)").otherwise(" (failed)"),
        ).alias("line"),
        "passed",
    )
