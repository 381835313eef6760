"""Has this key been seen before?  An exact ledger of keys on disk.

The ledger is a hash-bucketed, key-sorted table in the shared folder with one
row per key: the first instant and record that carried it.  A batch is reduced
to its first record per key *before* it meets the ledger (partial sums on the
map side), so a key that holds a third of all rows is one row by the time of
the sort-merge left join.  The verdict per record is then an anti join on the
record id, which is evenly spread whatever the keys look like.  Nothing is
approximate: the rate of wrong answers is zero, and ``error_rate`` measures it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import session

#: Records per bucket of a ledger, from which the number of buckets follows.
BUCKET_ROWS = 500_000
#: Appends (each adds a file per bucket) after which a ledger is written anew.
COMPACT_EVERY = 8
#: Batches of about equal size that a table of entries is fed to the ledger in.
BATCHES = 4


def instant(text: Column) -> Column:
    """An ISO 8601 string with zone as a timestamp; null where unreadable."""
    return F.try_to_timestamp(F.trim(text))


def usable(key: Column) -> Column:
    """Not null and not white space only."""
    return key.isNotNull() & ~key.rlike(r"^[\s\p{Z}]*$")


def buckets_for(spark: SparkSession, rows: int) -> int:
    """As many buckets as there are cores, more for more rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))


class KeyLedger:
    """Keys seen so far: one table on disk, hash-bucketed by key, only appended to.

    ``buckets`` fixes the layout (see ``buckets_for``: one bucket must fit a
    task's sort).  History is never shuffled: a batch is brought to the
    bucketing of the table.  After ``COMPACT_EVERY`` appends the table is
    written anew, so that a bucket stays a few files.
    """

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark = spark
        self.buckets = buckets
        self.appends = 0
        self.written = False
        self._place()

    def _place(self) -> None:
        self.name = f"key_ledger_{uuid.uuid4().hex[:12]}"
        self.path = session.new_path(self.spark, self.name)

    def table(self) -> DataFrame:
        """One row per key: ``key, at, id`` of its earliest record.

        History of which only the key is known (null ``at``) comes before all.
        """
        if not self.written:
            return self.spark.createDataFrame([], "key string, at timestamp, id bigint")
        order = F.struct(F.col("at").isNotNull(), F.col("at"), F.col("id"))
        return (
            self.spark.table(self.name)
            .groupBy("key")
            .agg(F.min(order).alias("f"))
            .select("key", F.col("f.at").alias("at"), F.col("f.id").alias("id"))
        )

    def append(self, firsts: DataFrame) -> None:
        """Add ``key, at, id`` rows, at most one per key (see ``first_per_key``)."""
        if self.appends >= COMPACT_EVERY:
            self.compact()
        (
            firsts.select("key", "at", "id")
            .repartition(self.buckets, "key")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "key")
            .sortBy("key")
            .option("path", self.path)
            .saveAsTable(self.name)
        )
        self.written = True
        self.appends += 1

    def compact(self) -> None:
        """Write the ledger anew, a file per bucket and a row per key."""
        whole, old = self.table(), (self.name, self.path)
        self._place()
        self.appends = 0
        self.append(whole)
        self._drop(*old)

    def close(self) -> None:
        """Drop the table from the catalog, and its files."""
        self._drop(self.name, self.path)
        self.written = False

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        session.remove(self.spark, path)

    def news(self, records: DataFrame) -> DataFrame:
        """``key, at, id`` of the batch's records that are the first of their key."""
        firsts = first_per_key(records).alias("b")
        return (
            firsts.join(self.table().alias("l").hint("merge"), F.expr("b.key = l.key"), "left")
            .where(
                "l.key is null or (l.at is not null and b.at is not null"
                " and struct(b.at, b.id) <= struct(l.at, l.id))"
            )
            .select("b.key", "b.at", "b.id")
        )

    def seen(self, records: DataFrame) -> DataFrame:
        """Ids of the records of a batch whose key was recorded before.

        ``records`` has ``key string, at timestamp, id bigint``.  A key is seen
        if the ledger holds it with an earlier ``(at, id)`` or without a time,
        or if another record of the batch has an earlier ``(at, id)``; a record
        without a readable time counts as the latest of its key.  Ids that come
        twice are one record; null and blank keys are never seen.  An empty
        batch gives no rows.
        """
        ids = records.where(usable(F.col("key"))).select("id")
        return ids.join(self.news(records).select("id"), "id", "left_anti").distinct()

    def process(self, records: DataFrame) -> DataFrame:
        """``seen`` for one batch of a sequence; its new keys join the ledger."""
        news = session.scratch(self.news(records), "ledger-news")
        ids = records.where(usable(F.col("key"))).select("id")
        answer = session.scratch(
            ids.join(news.select("id"), "id", "left_anti").distinct(), "ledger-seen"
        )
        self.append(news)
        return answer


def first_per_key(records: DataFrame) -> DataFrame:
    """``key, at, id`` of the earliest record per key (nulls of ``at`` last)."""
    order = F.struct(F.col("at").isNull(), F.col("at"), F.col("id"))
    return (
        records.where(usable(F.col("key")))
        .groupBy("key")
        .agg(F.min(order).alias("f"))
        .select("key", F.col("f.at").alias("at"), F.col("f.id").alias("id"))
    )


def seen_in_order(
    entries: DataFrame, warm_keys: DataFrame, batches: int = BATCHES, buckets: int | None = None
) -> DataFrame:
    """``entry_id`` of every entry whose key occurs earlier, batch after batch in
    order of ``fetched_at`` (as an instant, ties by ``entry_id``).

    The history (``warm_keys``) precedes all entries, so its keys are stored
    without a time.  Each batch is answered from the ledger and its new keys are
    appended before the next one comes, so earlier entries are never grouped
    again.  Equal instants share a batch; entries without a readable time are in
    the last.  Rows with the same ``entry_id`` have to be the same row.
    """
    spark = entries.sparkSession
    records = session.scratch(as_records(entries), "seen-records")
    ledger = KeyLedger(spark, buckets or buckets_for(spark, records.count()))
    ledger.append(history(warm_keys))
    at = F.unix_micros("at")
    shares = [i / batches for i in range(1, batches)]
    cuts = records.agg(F.percentile_approx(at, shares)).first()[0] if shares else None
    cuts = sorted(set(cuts or []))
    answers = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = records
        if low is not None:
            part = part.where(F.col("at").isNull() | (at > low))
        if high is not None:
            part = part.where(at <= high)
        answer = ledger.process(part)
        answers = answer if answers is None else answers.unionByName(answer)
    # The answers are written; nothing reads the ledger any more.
    ledger.close()
    return answers.select(F.col("id").alias("entry_id"))


def history(warm_keys: DataFrame) -> DataFrame:
    """Warm keys as ledger rows without a time: all of it precedes the batch."""
    return warm_keys.where(usable(F.col("entry_key"))).select(
        F.col("entry_key").alias("key"),
        F.lit(None).cast("timestamp").alias("at"),
        F.lit(None).cast("bigint").alias("id"),
    ).distinct()


def as_records(entries: DataFrame) -> DataFrame:
    """Entries as ``key, at, id``."""
    return entries.select(
        F.col("entry_key").alias("key"),
        instant(F.col("fetched_at")).alias("at"),
        F.col("entry_id").alias("id"),
    )


def error_rate(
    records: DataFrame, answered: DataFrame, truth: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``records, seen, wrong, wrong_rate`` of answers against ``truth(records)``.

    Both sides are lists of ids; an id on one side only is a wrong answer.  With
    no records the rate is zero.
    """
    sides = answered.select("id", F.lit(1).alias("s")).unionByName(
        truth(records).select("id", F.lit(-1).alias("s"))
    )
    wrong = sides.groupBy("id").agg(F.sum("s").alias("s")).agg(
        F.count_if(F.col("s") != 0).alias("wrong")
    )
    total = records.agg(F.count_distinct("id").alias("records"))
    hits = answered.agg(F.count("*").alias("seen"))
    return total.crossJoin(hits).crossJoin(wrong).select(
        "records",
        "seen",
        "wrong",
        F.when(F.col("records") == 0, 0.0).otherwise(F.col("wrong") / F.col("records")).alias("wrong_rate"),
    )


def seen_by_sort(records: DataFrame, past: DataFrame) -> DataFrame:
    """The same verdicts by another road, for ``error_rate``.

    Records and the past (``history`` rows) are sorted by (key, time) across the cluster and each
    row is compared with its neighbour; range partitioning splits a hot key, and
    the first row of every partition is settled by the last key of the ones
    before it (one row per partition).
    """
    rows = (
        records.where(usable(F.col("key")))
        .dropDuplicates(["id"])
        .select("key", F.lit(1).alias("batch"), "at", "id")
        .unionByName(past.select("key", F.lit(0).alias("batch"), "at", "id"))
    )
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc("key"), F.asc("batch"), F.asc_nulls_last("at"), F.asc("id")]
    placed = session.scratch(
        rows.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")),
        "seen-sorted",
    )
    # The ranges are ordered, so a partition's first key was met before exactly
    # if some earlier partition ends with it.
    ends = placed.groupBy("part").agg(F.max("key").alias("key"))
    edges = (
        placed.groupBy("part").agg(F.min("key").alias("key")).alias("f")
        .join(ends.alias("e"), F.expr("f.key = e.key and e.part < f.part"), "left_semi")
        .select("part", "key")
    )
    starts = placed.groupBy("part", "key").agg(F.min("pos").alias("pos"))
    new = starts.join(edges, ["part", "key"], "left_anti").select("pos")
    return placed.where("batch = 1").join(new, "pos", "left_anti").select("id")
