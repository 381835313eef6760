"""Declared against derived status: tracker tables in markdown and spec files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The statuses, and the published format of tracker tables and spec files.
STATUSES = ["ported", "tbd", "divergent"]
HEADING = r"^### ([\w-]+) → ([\w-]+)"
ROW = r"^\|\s*`([\w-]+)`\s*\|.*?\|\s*\*\*(\w+)\*\*\s*\|"
SECTION = r"(?is)Deviations from upstream:?\s*\n(.*?)(?:\n##|\n---|\n\*\*|\z)"
NOTHING_SAID = ["", "None.", "(none)"]


def tracker_rows(trackers: DataFrame) -> DataFrame:
    """``tracker_id, plugin, skill, declared`` from markdown matrices.

    A heading ``### a → b`` names the plugin ``a`` of the rows below it (filled
    forward), a row is ``| `skill` | … | **status** |``.  ``trackers`` has
    ``tracker_id, text``; rows before any heading and rows of an unknown status
    are skipped, and of several rows for one skill the last counts.
    """
    lines = trackers.select("tracker_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("tracker_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("line").rlike(HEADING), F.regexp_extract("line", HEADING, 1))
    rows = (
        lines.withColumn("plugin", F.last(named, ignorenulls=True).over(w))
        .where(F.col("line").rlike(ROW) & F.col("plugin").isNotNull())
        .select(
            "tracker_id", "plugin", F.regexp_extract("line", ROW, 1).alias("skill"),
            F.lower(F.regexp_extract("line", ROW, 2)).alias("declared"), "pos",
        )
        .where(F.col("declared").isin(STATUSES))
    )
    return rows.groupBy("tracker_id", "plugin", "skill").agg(F.max_by("declared", "pos").alias("declared"))


def derived_status(tracked: DataFrame, specs: DataFrame) -> DataFrame:
    """``plugin, skill, derived``: ``tbd`` without a spec file, ``divergent`` if its
    section of deviations says anything but none, else ``ported``.

    ``specs`` has ``plugin, skill, text``; of several for one skill the one with the
    greatest hash of its text counts.
    """
    said = F.trim(F.regexp_replace(F.regexp_extract("text", SECTION, 1), r"\A\s+|\s+\z", ""))
    status = F.when(said.isin(NOTHING_SAID), "ported").otherwise("divergent")
    # Read first, so that a hash and a status move, never a text.
    read = specs.where("text is not null").groupBy("plugin", "skill").agg(
        F.max(F.struct(F.xxhash64("text"), status.alias("status"))).alias("s")
    )
    return tracked.select("plugin", "skill").distinct().join(read, ["plugin", "skill"], "left").select(
        "plugin", "skill", F.coalesce("s.status", F.lit("tbd")).alias("derived")
    )


def drift(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """Tracked skills whose declared status is not the derived one.

    A declared divergence of a skill without a spec file is allowed; a skill
    that is not declared drifts.
    """
    rows = derived.join(declared.select("plugin", "skill", "declared"), ["plugin", "skill"], "left")
    allowed = (F.col("declared") == "divergent") & (F.col("derived") == "tbd")
    return rows.where(~F.col("declared").eqNullSafe(F.col("derived")) & ~F.coalesce(allowed, F.lit(False)))


def counts(derived: DataFrame) -> DataFrame:
    """How many skills have each derived status."""
    return derived.groupBy("derived").agg(F.count("*").alias("skills"))
