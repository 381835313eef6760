"""Tracker analytics: nested issue nodes to rows, and the counts shown on boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import text as T

# The plugins of the registry.
PLUGINS = [
    "productivity-cli", "product-management-cli", "data-cli", "platform-engineering",
    "it-admin", "engineering-cli", "schema", "meta-repo",
]

NODE = (
    "number int, title string, state string, url string,"
    " assignees struct<nodes: array<struct<login: string>>>,"
    " labels struct<nodes: array<struct<name: string>>>,"
    " projectItems struct<nodes: array<struct<fieldValueByName: struct<name: string>,"
    " priority: struct<name: string>, wave: struct<name: string>, effort: struct<name: string>>>>"
)


def flatten(nodes: DataFrame, repo: str = "repo", fallback: str = "fallback", keep: tuple[str, ...] = ()) -> DataFrame:
    """Issue rows from nested nodes: first project item, first assignee.

    ``nodes`` has the columns of ``NODE`` besides the repository and the plugin
    that counts where no ``area/`` label names one.  Unknown priorities, waves
    and efforts take their defaults; the labels stay as an array, and so do the
    columns to ``keep``.
    """
    item = F.get(F.col("projectItems.nodes"), F.lit(0))
    labels = F.coalesce(F.transform("labels.nodes", lambda x: x["name"]), F.array().cast("array<string>"))
    return nodes.select(
        "number", "title", F.col(repo).alias("repo"),
        T.plugin_of(labels, F.col(fallback)).alias("plugin"),
        T.status_of(item["fieldValueByName"]["name"], F.col("state")).alias("status"),
        T.one_of(item["priority"]["name"], T.PRIORITIES, "P2").alias("priority"),
        T.one_of(item["wave"]["name"], T.WAVES, "Wave 1").alias("wave"),
        T.one_of(item["effort"]["name"], T.EFFORTS, "M").alias("effort"),
        F.get(F.col("assignees.nodes"), F.lit(0))["login"].alias("assignee"),
        "url", labels.alias("labels"), *keep,
    )


def with_label(issues: DataFrame, label: str | None) -> DataFrame:
    """Issues that bear a label; no label asks for all."""
    return issues if label is None else issues.where(F.array_contains("labels", label))


def of_plugins(issues: DataFrame, plugins: list[str]) -> DataFrame:
    """Issues of the selected plugins; an empty selection is all of them."""
    return issues.where(F.col("plugin").isin(plugins)) if plugins else issues


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key in the given order (which should be total).

    The fields travel in one aggregate, so a hot key is reduced before it moves.
    """
    rest = [c for c in rows.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(pick.alias("__row")).select(*keys, *[f"__row.{c}" for c in rest])


def zero_filled(rows: DataFrame, column: str, values: list[str], name: str = "issues") -> DataFrame:
    """``column, name``: counts for every listed value, zero or not.

    Other values are counted together as ``(unknown)``, which comes out only if
    there are any.
    """
    spark = rows.sparkSession
    listed = spark.createDataFrame([(v,) for v in values], f"{column} string")
    value = F.when(F.col(column).isin(values), F.col(column)).otherwise("(unknown)")
    counts = rows.groupBy(value.alias(column)).agg(F.count("*").alias("n"))
    return listed.join(counts, column, "full_outer").select(
        column, F.coalesce("n", F.lit(0)).alias(name)
    )


def plugin_counts(issues: DataFrame, plugins: list[str] = PLUGINS) -> DataFrame:
    """Per plugin all issues and the open ones, zero-filled."""
    total = zero_filled(issues, "plugin", plugins, "total")
    open_ = zero_filled(issues.where("status <> 'Done'"), "plugin", plugins, "open")
    return total.join(open_, "plugin", "left").select("plugin", "total", F.coalesce("open", F.lit(0)).alias("open"))


def status_counts(issues: DataFrame) -> DataFrame:
    """The board's columns with their counts, zero-filled."""
    return zero_filled(issues, "status", T.STATUSES)


def recent(issues: DataFrame, key: str, order: list, n: int = 6) -> DataFrame:
    """The first ``n`` issues per key in arrival order."""
    window = Window.partitionBy(key).orderBy(*order)
    return issues.withColumn("position", F.row_number().over(window).cast("bigint")).where(F.col("position") <= n)


def with_registry(registry: DataFrame, counts: DataFrame) -> DataFrame:
    """Every plugin of the registry with its counts, zero where there are none."""
    joined = registry.join(counts, "plugin", "left")
    return joined.select(*registry.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != "plugin"])


def board_order(issues: DataFrame) -> list:
    """Columns that sort a board: status, then priority, then effort, then key."""
    place = lambda c, v: F.array_position(F.array(*[F.lit(x) for x in v]), F.col(c))
    return [place("status", T.STATUSES), place("priority", T.PRIORITIES), place("effort", T.EFFORTS), F.col("repo"), F.col("number")]


def roadmap(issues: DataFrame) -> DataFrame:
    """``wave, issues, open`` in order of the waves, zero-filled."""
    total = zero_filled(issues, "wave", T.WAVES, "issues")
    left = zero_filled(issues.where("status <> 'Done'"), "wave", T.WAVES, "open")
    place = F.array_position(F.array(*[F.lit(w) for w in T.WAVES]), F.col("wave"))
    return total.join(left, "wave", "left").select("wave", "issues", F.coalesce("open", F.lit(0)).alias("open")).orderBy(place)


def live_or_snapshot(snapshot: DataFrame | None, live: DataFrame | None) -> DataFrame | None:
    """The live rows if there are any, else the snapshot, with ``source``."""
    if live is not None and live.limit(1).count():
        return live.withColumn("source", F.lit("api"))
    return None if snapshot is None else snapshot.withColumn("source", F.lit("snapshot"))


def snapshot_document(issues: DataFrame, generated_at: str) -> DataFrame:
    """One JSON document of all issues in order of repository and number.

    A sink for a dashboard-sized result: the document is one row.
    """
    rows = F.array_sort(F.collect_list(F.struct("repo", "number", "title", "plugin", "status", "priority", "wave", "effort", "assignee", "url")))
    return issues.agg(rows.alias("issues")).select(
        F.to_json(F.struct(F.lit(generated_at).alias("generatedAt"), F.col("issues"))).alias("value")
    )


def project_map(spark: SparkSession, rows: list[tuple[str, str, str, str | None]]) -> DataFrame:
    """``slug, repo, plugin, label, place``: which repository a slug is read from,
    its fallback plugin, its label (null: all issues), and its place in the list."""
    return spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)], "slug string, repo string, plugin string, label string, place int"
    )


def of_slugs(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """Issues of all known slugs in one table: ``slug, place, position`` and the
    columns of ``flatten``.

    ``nodes`` has ``slug, position`` besides the columns of ``NODE``; nodes of an
    unknown slug drop out, and so do those without the slug's label.
    """
    known = nodes.join(session.broadcast_small(projects), "slug")
    rows = known.select("slug", "place", "position", "label", *[c for c in nodes.columns if c not in ("slug", "position")], "repo", "plugin")
    flat = flatten(rows.withColumnRenamed("plugin", "fallback"), keep=("slug", "place", "position", "label"))
    return flat.where(F.col("label").isNull() | F.array_contains("labels", F.col("label"))).drop("label")


def merged(issues: DataFrame) -> DataFrame:
    """One row per repository and number: the copy of the slug that is listed first,
    in it the one that arrived first."""
    return first_wins(issues, ["repo", "number"], ["place", "position"])


def decision(adrs: DataFrame, number: str) -> DataFrame:
    """The first decision of a number, by position; no row if there is none."""
    return adrs.where(F.col("number") == number).orderBy("position").limit(1)


def sorted_decisions(adrs: DataFrame) -> DataFrame:
    """Decisions by number (ties by position): a range-partitioned sort."""
    return adrs.orderBy("number", "position")


def sorted_changes(changes: DataFrame) -> DataFrame:
    """Changelog entries, latest date first (ties by position)."""
    return changes.orderBy(F.desc("date"), "position")


def changelog_entries(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, position, version, date, body`` of headings like ``## v1.2.3 (2026-01-31)``
    or ``## [1.2.3] - 2026-01-31`` and the lines below them."""
    parts = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"(?m)^(?=## )")
    head = r"\A## \[?v?(\d+\.\d+\.\d+)\]?\s*[(\u2014\u2013-]?\s*(\d{4}-\d{2}-\d{2})?\)?"
    rows = documents.select(key, F.posexplode(parts).alias("position", "part"))
    return rows.where(F.col("part").rlike(head)).select(
        key, F.col("position").cast("bigint"),
        F.regexp_extract("part", head, 1).alias("version"),
        F.regexp_extract("part", head, 2).alias("date"),
        F.regexp_replace("part", r"\A[^\n]*\n?\s*|\s+\z", "").alias("body"),
    )


def consecutive_failures(runs: DataFrame, key: str, order: str, failed: str, n: int = 3, span: int = 100_000) -> DataFrame:
    """Rows at which a run of failures reaches ``n`` (gaps and islands).

    A failure counts up from the latest success before it.  A key of more than
    ``span`` rows is cut into stretches that hold so many each, so no task sorts
    a hot key alone: a stretch knows from the ends of those before it how many
    failures are already running.
    """
    counted = runs.groupBy(key).agg(F.count("*").alias("__n"))
    hot = counted.where(F.col("__n") > span)
    if not hot.limit(1).count():
        return _third(runs.withColumn("__part", F.lit(0)), key, order, failed, n, None)
    # Cut points per hot key from quantiles of the order; keys below stay whole.
    at = F.xxhash64(key)  # spreads keys over the range partitions
    placed = runs.repartitionByRange(at, F.col(key), F.col(order)).sortWithinPartitions(at, F.col(key), F.col(order))
    placed = session.scratch(placed.withColumn("__part", F.spark_partition_id()), "failure-runs")
    last_good = F.max(F.when(~F.col(failed), F.col(order)))
    ends = placed.groupBy(key, "__part").agg(
        F.count("*").alias("rows"), last_good.alias("good"), F.count_if(failed).alias("bad"),
    )
    # Failures behind the last success of a stretch, or all of it.
    tails = (
        placed.join(ends.select(key, "__part", "good"), [key, "__part"])
        .groupBy(key, "__part")
        .agg(F.count_if(F.col(failed) & (F.col("good").isNull() | (F.col(order) > F.col("good")))).alias("tail"), F.max("good").isNotNull().alias("broken"))
    )
    before = Window.partitionBy(key).orderBy("__part")
    # A row per key and stretch: running sums since the last broken stretch.
    island = F.sum(F.col("broken").cast("int")).over(before)
    ran = tails.withColumn("island", island).withColumn(
        "held", F.sum("tail").over(Window.partitionBy(key, "island").orderBy("__part"))
    )
    carried = ran.select(key, "__part", F.coalesce(F.lag("held").over(before), F.lit(0)).alias("__carried"))
    return _third(placed, key, order, failed, n, carried)


def _third(runs: DataFrame, key: str, order: str, failed: str, n: int, carried: DataFrame | None) -> DataFrame:
    w = Window.partitionBy(key, "__part").orderBy(order)
    inside = Window.partitionBy(key, "__part", "__island").orderBy(order)
    rows = runs.withColumn("__island", F.sum((~F.col(failed)).cast("int")).over(w)).withColumn(
        "__run", F.sum(F.col(failed).cast("int")).over(inside)
    )
    if carried is not None:
        rows = rows.join(carried, [key, "__part"]).withColumn(
            "__run", F.col("__run") + F.when(F.col("__island") == 0, F.col("__carried")).otherwise(0)
        ).drop("__carried")
    return rows.where((F.col("__run") == n) & F.col(failed)).drop("__island", "__run", "__part")


def newest(snapshots: DataFrame, key: str, order: str, n: int = 30) -> DataFrame:
    """The newest ``n`` snapshots per source."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return snapshots.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
