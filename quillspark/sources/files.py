"""Files as tables: corpora, JSON lines of embeddings, snapshots, questions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_corpus(spark: SparkSession, *roots: str) -> DataFrame:
    """``doc_id, text`` of all ``.md`` files below the roots; the id is the path
    below its root.  Missing and unreadable files are skipped.  A root is a plain
    path: characters of patterns stand for themselves."""
    parts = []
    for root in roots:
        files = (
            spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
            .option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
            .text(re.sub(r"([\[\]{}*?\\])", r"\\\1", root), wholetext=True)
        )
        # The path comes as a URI; a plus in it stands for itself.
        plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        path = F.regexp_replace(plain, "^file:/+", "/")
        doc_id = F.regexp_replace(path, "^.*?" + re.escape(root.rstrip("/")) + "/", "")
        parts.append(files.select(doc_id.alias("doc_id"), F.col("value").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{chunkId, embedding}``: blank and malformed lines, lines without
    a key or a vector are skipped; repeats stay."""
    rows = spark.read.schema("chunkId string, embedding array<double>").option("mode", "DROPMALFORMED").json(path)
    return rows.where("chunkId is not null and chunkId <> '' and embedding is not null").select(
        F.col("chunkId").alias("chunk_id"), "embedding"
    )


def write_embeddings(index: DataFrame, path: str) -> None:
    """The inverse of ``read_embeddings``."""
    index.select(F.col("chunk_id").alias("chunkId"), "embedding").write.mode("overwrite").json(path)


ISSUE = (
    "struct<number: int, title: string, repo: string, plugin: string, status: string, priority: string,"
    " wave: string, effort: string, assignee: string, url: string>"
)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Issue rows of a snapshot document, with ``generated_at`` and their position."""
    documents = spark.read.schema(f"generatedAt string, issues array<{ISSUE}>").json(path, multiLine=True)
    return documents.select(
        F.col("generatedAt").alias("generated_at"), F.posexplode("issues").alias("position", "i")
    ).select("generated_at", F.col("position").cast("bigint"), "i.*")


def read_content(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decisions and changelog entries of a content document, with positions."""
    adr = "struct<number: string, title: string, plugin: string, status: string, date: string, body: string>"
    change = "struct<plugin: string, version: string, date: string, body: string>"
    document = spark.read.schema(f"adrs array<{adr}>, changelogs array<{change}>").json(path, multiLine=True)
    explode = lambda c: document.select(F.posexplode(c).alias("position", "x")).select(
        F.col("position").cast("bigint"), "x.*"
    )
    return explode("adrs"), explode("changelogs")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``question_id, query, expected`` of an evaluation set."""
    question = "struct<id: string, query: string, expectedSubstrings: array<string>>"
    rows = spark.read.schema(f"version int, description string, questions array<{question}>").json(path, multiLine=True)
    return rows.select(F.explode("questions").alias("q")).select(
        F.col("q.id").alias("question_id"), F.col("q.query").alias("query"),
        F.col("q.expectedSubstrings").alias("expected"),
    )


def read_api(rows: DataFrame) -> DataFrame:
    """Issue rows of API responses (``body`` JSON text); responses with an error drop out."""
    parsed = rows.select(
        F.from_json("body", f"error string, generatedAt string, issues array<{ISSUE}>").alias("b")
    )
    return parsed.where("b is not null and b.error is null and b.issues is not null").select(
        F.col("b.generatedAt").alias("generated_at"), F.posexplode("b.issues").alias("position", "i")
    ).select("generated_at", F.col("position").cast("bigint"), "i.*")


def file_results(responses: DataFrame, owners: list[str], charset: str = "UTF-8") -> DataFrame:
    """``owner, path, kind, content`` of single-file responses.

    ``responses`` has ``owner, path, status, content`` (base64).  An owner that
    is not allowed is ``bad-request``, 404 ``not-found``, other failures and
    empty contents ``unavailable``.
    """
    from quillspark.functions import text as T

    body = T.base64_text(F.col("content"), charset)
    kind = (
        F.when(~F.col("owner").isin(owners), "bad-request")
        .when(F.col("status") == 400, "bad-request")
        .when(F.col("status") == 404, "not-found")
        .when((F.col("status") != 200) | (F.coalesce("content", F.lit("")) == ""), "unavailable")
        .otherwise("ok")
    )
    return responses.select("owner", "path", kind.alias("kind"), F.when(kind == "ok", body).alias("content"))
