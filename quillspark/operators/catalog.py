"""Catalogues of sources: manifests, pins, sections of an index page, tools, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark import session

# What a unit of each cost counts in the choice of a tool.
TOKENS, LATENCY, MEMORY = 1.0, 0.05, 0.001
#: Pages of lazy sections that one run may fetch.
LAZY_CAP = 50


def cheapest_tool(tools: DataFrame) -> DataFrame:
    """``task, tool, score``: the tool of least weighted cost per task, ties by name.

    ``tools`` has ``task, tool, tokens_per_byte, latency_seconds, memory_mb``;
    unknown costs count as nothing.
    """
    cost = lambda c: F.coalesce(c, F.lit(0.0))
    score = TOKENS * cost("tokens_per_byte") + LATENCY * cost("latency_seconds") + MEMORY * cost("memory_mb")
    best = F.min(F.struct(score.alias("score"), "tool"))
    return tools.groupBy("task").agg(best.alias("b")).select("task", "b.tool", "b.score")


def pin_kind(ref):
    """``tag``, ``sha`` or ``branch``: a version, 7 to 40 hexadecimal digits, anything else."""
    return (
        F.when(ref.isNull() | (F.trim(ref) == ""), None)
        .when(ref.rlike(r"^v?\d+\.\d+(\.\d+)?([-+][0-9A-Za-z.-]+)?$"), "tag")
        .when(ref.rlike(r"^[0-9a-f]{7,40}$"), "sha")
        .otherwise("branch")
    )


def is_stable(ref):
    """Whether a pin cannot move: a tag or a full hash."""
    kind = pin_kind(ref)
    return (kind == "tag") | ((kind == "sha") & (F.length(ref) == 40))


def flattened(manifest: DataFrame, kinds: list[str]) -> DataFrame:
    """``kind, id, position`` of a manifest of one array of ``struct<id>`` per kind."""
    parts = [
        manifest.select(F.lit(k).alias("kind"), F.posexplode(F.col(k)).alias("position", "r")).select(
            "kind", F.col("r.id").alias("id"), F.col("position").cast("bigint")
        )
        for k in kinds
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kind_counts(resources: DataFrame, kinds: list[str]) -> DataFrame:
    """``kind, resources`` with every kind, empty or not."""
    listed = resources.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    counts = resources.groupBy("kind").agg(F.count("*").alias("n"))
    return listed.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("resources"))


def repeated_ids(resources: DataFrame) -> DataFrame:
    """``id, copies`` of ids that are not unique over all kinds."""
    return resources.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")


def section_links(pages: DataFrame, lazy: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, position, section, title, url, posture`` of the links of index pages.

    A link ``- [title](url)`` belongs to the latest ``### section`` above it
    (filled forward within its page); sections named in ``lazy`` are lazy, others
    eager, and links above any section have none and are eager.
    """
    lines = pages.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("position", "line"))
    head, link = r"^### +(.+?) *$", r"^- \[([^\]]*)\]\(([^)\s]+)\)"
    above = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    named = F.last(F.when(F.col("line").rlike(head), F.regexp_extract("line", head, 1)), ignorenulls=True).over(above)
    # Only headings and links are put in order, page by page.
    kept = lines.where(F.col("line").rlike(head) | F.col("line").rlike(link)).withColumn("section", named)
    return kept.where(F.col("line").rlike(link)).select(
        key, F.col("position").cast("bigint"), "section", F.regexp_extract("line", link, 1).alias("title"),
        F.regexp_extract("line", link, 2).alias("url"),
        F.when(F.col("section").isin(lazy), "lazy").otherwise("eager").alias("posture"),
    )


def lazy_fetches(hits: DataFrame, cap: int | None = LAZY_CAP) -> DataFrame:
    """``run, url, rank, fetched``: lazy pages that a run asked for, in order; those
    beyond the cap are skipped (``cap=None`` skips none)."""
    first = hits.groupBy("run", "url").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("rank", "url"))
    return first.withColumn("fetched", F.lit(True) if cap is None else place <= cap)


def categorised(links: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Links with the ``category`` of the longest prefix of their path; null without one.

    ``prefixes`` has ``prefix, category`` and is a small table of checked size.
    """
    rows = links.withColumn("__path", F.regexp_replace("url", r"^\w+://[^/]+/", ""))
    longest = (
        rows.select("__path").distinct()
        .join(session.broadcast_small(prefixes), F.expr("startswith(__path, prefix)"))
        .groupBy("__path").agg(F.max_by("category", F.struct(F.length("prefix"), "prefix")).alias("category"))
    )
    return rows.join(longest, "__path", "left").drop("__path")


def without_canonical(links: DataFrame, canonical: DataFrame, key: str = "url") -> DataFrame:
    """Links that no canonical source covers (each of those stays where it is)."""
    return links.join(canonical.select(key).distinct(), key, "left_anti")


def plain_name(name):
    """A name as it is compared: lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def canonical_names(asked: DataFrame, terms: DataFrame, most_edits: int = 2) -> DataFrame:
    """``asked, term``: the known term that an asked name means.

    Names equal but for case and punctuation match first; else the term of least
    edit distance, at most ``most_edits``, among those that agree in some one of
    ``most_edits + 1`` pieces at its place, give or take as many letters
    (pigeonhole), so no all-pairs join is made.  Ties go to the first by name; terms
    of fewer than ``most_edits + 1`` letters are matched exactly alone.
    """
    wanted = asked.select(F.col("name").alias("asked"), plain_name(F.col("name")).alias("a")).distinct().where("a <> ''")
    known = terms.select("term", plain_name(F.col("term")).alias("t")).distinct().where("t <> ''")
    exact = wanted.join(known, F.col("a") == F.col("t")).groupBy("asked").agg(F.min("term").alias("term"))
    rest = wanted.join(exact, "asked", "left_anti")
    parts = most_edits + 1
    # A term in pieces of nearly equal length; an asked name's substrings of those lengths.
    ends = f"(i -> struct(cast(floor(i * length(t) / {parts}) as int) + 1 as at, cast(floor((i + 1) * length(t) / {parts}) as int) as end))"
    cut = F.expr(f"transform(transform(sequence(0, {parts - 1}), {ends[1:-1]}), p -> struct(p.at as at, substring(t, p.at, p.end - p.at + 1) as piece))")
    pieces = known.where(F.length("t") >= parts).select("term", "t", F.explode(cut).alias("p")).select("term", "t", "p.piece", "p.at")
    shortest = f"greatest(1, cast(floor((length(a) - {most_edits}) / {parts}) as int))"
    longest = f"cast(ceil((length(a) + {most_edits}) / {parts}) as int)"
    probes = rest.select("asked", "a", F.explode(F.expr(
        f"flatten(transform(sequence({shortest}, {longest}), n -> transform(sequence(1, length(a)),"
        " i -> struct(substring(a, i, n) as piece, i as at))))"
    )).alias("p")).select("asked", "a", "p.piece", F.col("p.at").alias("place"))
    near = (
        probes.join(pieces, "piece").where(F.abs(F.col("place") - F.col("at")) <= most_edits)
        .select("asked", "a", "term", "t").distinct()
        .withColumn("edits", F.levenshtein("a", "t")).where(F.col("edits") <= most_edits)
        .groupBy("asked").agg(F.min(F.struct("edits", "term")).alias("b")).select("asked", "b.term")
    )
    return exact.unionByName(near)
