"""Keyed caches: payload tables, a Bloom filter in front, time to live."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.kernels.bloom import Bloom


def latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key: the last put, by the given order."""
    rest = [c for c in rows.columns if c != key]
    return (
        rows.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
        .select(key, *[f"r.{c}" for c in rest])
    )


def put(cache: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The cache with entries added or replaced by key."""
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def get(cache: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Every asked key with ``hit`` and the payload, null where there is none."""
    return keys.select(key).join(cache.withColumn("hit", F.lit(True)), key, "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False))
    )


def without_cached(cache: DataFrame, rows: DataFrame, key: str, filter_: Bloom | None = None) -> DataFrame:
    """Rows whose key the cache does not hold: what a reader has still to fetch.

    With a filter only rows that may be cached meet the exact anti join.
    """
    known = cache.select(key).where(F.col(key).isNotNull())
    if filter_ is None:
        return rows.join(known, key, "left_anti")
    told = rows.withColumn("__maybe", _maybe(filter_)(key))
    sure = told.where(~F.col("__maybe")).drop("__maybe")
    return sure.unionByName(told.where("__maybe").drop("__maybe").join(known, key, "left_anti"))


def with_expiry(rows: DataFrame, at: Column, seconds: int = 300) -> DataFrame:
    """Rows that live for some seconds from ``at``."""
    return rows.withColumn("expires_at", at + F.make_interval(secs=F.lit(seconds)))


def alive(rows: DataFrame, now: Column, fresh: bool = False) -> DataFrame:
    """Rows not yet expired; ``fresh`` bypasses the cache altogether."""
    return rows.where(F.lit(False) if fresh else F.col("expires_at") > now)


def bloom(rows: DataFrame, key: str, items: int, rate: float = 0.01) -> Bloom:
    """The filter over all keys: built per partition, merged on the executors.

    Its size is set by ``items`` and ``rate`` alone; the driver receives one.
    """
    empty = Bloom(items, rate)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = Bloom(items, rate)
        for batch in batches:
            for k in batch["k"]:
                mine.add(k)
        yield pd.DataFrame({"bits": [bytes(mine.store)]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.frombuffer(pdf["bits"].iloc[0], np.uint8).copy()
        for bits in pdf["bits"]:
            whole |= np.frombuffer(bits, np.uint8)
        return pd.DataFrame({"bits": [whole.tobytes()]})

    # At most as many filters as tasks; they meet in a tree of branches.
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).coalesce(tasks)
    branch = F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(tasks)))).alias("branch")
    branches = parts.mapInPandas(build, "bits binary").select("bits", branch).groupBy("branch").applyInPandas(merge, "bits binary")
    for r in branches.groupBy().applyInPandas(merge, "bits binary").collect():
        empty.store = bytearray(r["bits"])
    return empty


def bloom_indices(rows: DataFrame, key: str, items: int, rate: float = 0.01) -> DataFrame:
    """``key, indices``: the bit positions of every key."""

    @F.pandas_udf("array<bigint>")
    def run(keys: pd.Series) -> pd.Series:
        one = Bloom(items, rate)
        return keys.map(lambda k: None if k is None else one.indices(k))

    return rows.select(key, run(key).alias("indices"))


def _maybe(filter_: Bloom):
    bits, items, hashes = bytes(filter_.store), filter_.bits, filter_.hashes

    @F.pandas_udf("boolean")
    def run(keys: pd.Series) -> pd.Series:
        probe = Bloom(1, 0.5)
        probe.bits, probe.hashes, probe.store = items, hashes, bytearray(bits)
        return keys.map(lambda k: k is not None and k in probe)

    return run


def maybe_seen(rows: DataFrame, key: str, filter_: Bloom) -> DataFrame:
    """Rows whose key may be in the filter; exact answers need a join behind it."""
    return rows.where(_maybe(filter_)(key))
