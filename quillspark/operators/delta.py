"""What changed between two snapshots of a source, with moves and renames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(prior: DataFrame, current: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per key with ``old`` and ``new`` structs; null where it is missing.

    Both sides are united and grouped, so the key moves once and nothing is
    joined; repeated rows of a side are decided by the greatest fields, rows
    with a null key are void.
    """
    row = F.struct(*[F.col(f) for f in fields])
    both = prior.select(*keys, row.alias("r"), F.lit(True).alias("was")).unionByName(
        current.select(*keys, row.alias("r"), F.lit(False).alias("was"))
    )
    return both.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.max(F.when(F.col("was"), F.col("r"))).alias("old"), F.max(F.when(~F.col("was"), F.col("r"))).alias("new")
    )


def source_delta(prior: DataFrame, current: DataFrame, key: str = "url", fingerprint: str = "sha") -> DataFrame:
    """``key, change_kind, was`` of pages: added, removed, changed, or renamed.

    A page that disappeared and one that came with the same fingerprint are one
    renamed page (``was`` is the old key).  Where several share a fingerprint
    they are paired in order of their keys; what is left over was added or
    removed.  Null fingerprints are never renames.
    """
    rows = _sides(prior, current, [key], [fingerprint]).select(
        F.col(key).alias("k"), F.col(f"old.{fingerprint}").alias("before"), F.col(f"new.{fingerprint}").alias("after"),
        F.col("old").isNotNull().alias("was_there"), F.col("new").isNotNull().alias("is_there"),
    )
    changed = rows.where("was_there and is_there and not (before <=> after)").select(
        F.col("k").alias(key), F.lit("changed").alias("change_kind"), F.lit(None).cast("string").alias("was")
    )
    # A fingerprint's keys on either side; only those of moved pages meet.
    lone = rows.where("was_there <> is_there").select("k", F.coalesce("before", "after").alias("f"), "was_there")
    moved = lone.where("f is not null").groupBy("f").agg(
        F.array_sort(F.collect_list(F.when(F.col("was_there"), F.col("k")))).alias("gone"),
        F.array_sort(F.collect_list(F.when(~F.col("was_there"), F.col("k")))).alias("come"),
    )
    moved = moved.select(F.explode(F.arrays_zip("come", "gone")).alias("p"))
    text = F.lit(None).cast("string")
    kinds = moved.select(
        F.coalesce("p.come", "p.gone").alias(key),
        F.when(F.col("p.gone").isNull(), "added").when(F.col("p.come").isNull(), "removed").otherwise("renamed").alias("change_kind"),
        F.when(F.col("p.come").isNotNull(), F.col("p.gone")).alias("was"),
    )
    odd = lone.where("f is null").select(
        F.col("k").alias(key), F.when(F.col("was_there"), "removed").otherwise("added").alias("change_kind"), text.alias("was")
    )
    return changed.unionByName(kinds).unionByName(odd)


def record_delta(
    prior: DataFrame, current: DataFrame, key: str, name: str, facets: Sequence[str]
) -> DataFrame:
    """``key, change_kind, old_name, new_name``: records added, removed, renamed (the
    name differs), reorganised (a facet differs), or both, which gives two rows."""
    rows = _sides(prior, current, [key], [name, *facets])
    same = F.lit(True)
    for f in facets:
        same = same & F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}"))
    kinds = (
        F.when(F.col("old").isNull(), F.array(F.lit("added")))
        .when(F.col("new").isNull(), F.array(F.lit("removed")))
        .otherwise(F.array_compact(F.array(
            F.when(~F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}")), "renamed"), F.when(~same, "reorganised")
        )))
    )
    return rows.select(
        key, F.explode(kinds).alias("change_kind"), F.col(f"old.{name}").alias("old_name"), F.col(f"new.{name}").alias("new_name")
    )
