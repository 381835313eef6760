"""What changed between full snapshots of a table.

Each snapshot is unpivoted into *cells* ``(key, field, value)`` plus one
presence marker per key.  A cell counts +1 in the pair where its snapshot is
the later one and -1 in the pair where it is the earlier one, so a single
grouped sum over cells leaves a nonzero total exactly where two consecutive
snapshots differ.  Nothing is joined: two aggregations (cells, then keys) with
map-side partial sums do the work, which keeps a hot key or repository from
landing in one task before it has been reduced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESENT = "\u0000present"


def latest_rows(
    df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]
) -> DataFrame:
    """One row per key: the fields of the row with the greatest ``order``.

    A null ``order`` loses to any value; rows equal in ``order`` are decided by
    the field values themselves (greatest wins), so the result never depends on
    the file order.
    """
    best = F.max(F.struct(F.col(order), *[F.col(f) for f in fields]))
    picked = df.groupBy(*keys).agg(best.alias("__best"))
    return picked.select(*keys, *[F.col("__best")[f].alias(f) for f in fields])


def normal(value: Column) -> Column:
    """Trimmed lower case, with null and empty as one value."""
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def snapshot_changes(
    df: DataFrame,
    snapshot: str,
    keys: Sequence[str],
    fields: Sequence[str],
    order: str,
    normalise=normal,
) -> DataFrame:
    """Added, removed and changed keys between consecutive snapshots.

    ``df`` holds many snapshots numbered by the integer column ``snapshot``;
    consecutive means numbers ``n-1`` and ``n``, both of which must exist in the
    table (a gap in the numbering yields no cases for the pair).  Columns
    outside ``keys``, ``fields``, ``snapshot`` and ``order`` are ignored.  Rows
    with a null key column or a null snapshot number are void.  An empty input
    gives an empty result.

    Returns ``snapshot, *keys, change_kind, changed_fields`` where
    ``change_kind`` is ``added``, ``removed`` or ``changed`` and
    ``changed_fields`` the sorted names of the differing fields (empty unless
    changed).
    """
    usable = df.dropna(subset=[snapshot, *keys]).select(snapshot, *keys, order, *fields)
    current = latest_rows(usable, [snapshot, *keys], order, fields)
    # The numbers of the snapshots: one row each, however many keys there are.
    numbers = df.select(F.col(snapshot).alias("__n")).dropna().distinct()
    pairs = numbers.join(numbers.select((F.col("__n") + 1).alias("__n")), "__n", "left_semi")

    cells = F.array(
        F.struct(F.lit(PRESENT).alias("__field"), F.lit("").alias("__value")),
        *[F.struct(F.lit(f).alias("__field"), normalise(F.col(f)).alias("__value")) for f in fields],
    )
    sides = F.array(
        F.struct(F.col(snapshot).alias("n"), F.lit(1).alias("sign")),
        F.struct((F.col(snapshot) + 1).alias("n"), F.lit(-1).alias("sign")),
    )
    signed = (
        current.select(*keys, cells.alias("__cells"), F.explode(sides).alias("__side"))
        .select(*keys, "__side", F.explode("__cells").alias("__cell"))
        .groupBy(F.col("__side.n").alias("__n"), *keys, "__cell.__field", "__cell.__value")
        .agg(F.sum("__side.sign").alias("__sum"))
        .where("__sum <> 0")
    )
    here = F.max(F.when(F.col("__field") == PRESENT, F.col("__sum")))
    differing = F.array_sort(
        F.collect_set(F.when(F.col("__field") != PRESENT, F.col("__field")))
    )
    rows = signed.groupBy("__n", *keys).agg(here.alias("__here"), differing.alias("__fields"))
    kind = (
        F.when(F.col("__here") > 0, "added").when(F.col("__here") < 0, "removed").otherwise("changed")
    )
    return rows.join(pairs, "__n", "left_semi").select(
        F.col("__n").cast(df.schema[snapshot].dataType).alias(snapshot),
        *keys,
        kind.alias("change_kind"),
        F.when(F.col("__here").isNull(), F.col("__fields"))
        .otherwise(F.array().cast("array<string>"))
        .alias("changed_fields"),
    )


def issue_changes(snapshots: DataFrame) -> DataFrame:
    """``snapshot_changes`` for the issue snapshots: key (repo, issue_number).

    ``repo`` is taken trimmed and in lower case; of several rows for one
    snapshot and issue the one delivered last counts.
    """
    cleaned = snapshots.withColumn("repo", F.lower(F.trim("repo")))
    return snapshot_changes(
        cleaned, "snapshot_no", ["repo", "issue_number"], ["status", "priority"], "delivered_at"
    )
