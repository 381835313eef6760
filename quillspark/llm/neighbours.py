"""The most similar vectors for every vector, by multi-index hashing.

1. *Codes.*  Learned rotations (iterative quantisation of a bounded sample)
   turn a vector into a long binary code: one block of bits per rotation.
2. *Index.*  The code is cut into ``tables`` substrings, each indexed on its
   own.  Two codes within Hamming radius ``tables - 1`` agree in at least one
   substring (pigeonhole), so an equi-join on (table, substring) retrieves every
   such code; with ``flips`` substrings at that distance are probed too and the
   guaranteed radius is ``tables * (flips + 1) - 1``.  Beyond that radius
   retrieval is likely rather than certain, and ``expected_recall`` says how
   likely at a given cosine.
3. *Rerank.*  Codes alone travel through the index; a Hamming test on 252 bits
   drops chance meetings inside the join, and what is left meets its floats once
   and is ranked by their exact cosine.

Equal vectors are one class: a class enters the index once and its members are
ranked afterwards, so copies never meet pair by pair.  A bucket with more than
``bucket_limit`` rows is not joined row by row: it is cut into blocks, and each
pair of blocks is a matrix product of bounded size that keeps the best ``k``
per vector - exact for the bucket, spread over tasks, and never all pairs.
Where hot buckets overlap so much that it is less work, their vectors form one.

The index is laid out for a floor of the cosine.  Lists without a floor
(``complete``) take from it what has ``k`` neighbours above the floor.  For the
other vectors the radius has to grow so far that the probes would outnumber the
vectors; they meet all vectors, block against block: exact, and quadratic in
their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark import session

#: Bits of the Hamming test inside the join: four words of 63.
TESTED = 252
#: Rows of the two sides of an exact block: vectors with a short list, and all vectors.
SHORT_BLOCK = 16_384
ALL_BLOCK = 131_072
#: Rows that are multiplied at a time, and columns that a first threshold is taken from.
AT_ONCE = 256
FIRST = 8192


def rows_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of ``width`` numbers as a matrix; nulls as not-a-number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def usable_vectors(
    records: DataFrame, key: str, vector: str, version: str, width: int
) -> DataFrame:
    """``key, vec array<float>`` of the latest row per key, if its vector can be compared.

    A vector is usable if it has exactly ``width`` finite numbers that are not
    all zero; if the latest row's is not, the key drops out (an older row never
    steps in).  Rows equal in ``version`` are decided by the vector (greatest);
    null keys are void.
    """
    latest = (
        records.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.struct(F.col(version), F.col(vector))).alias("r"))
        .select("key", F.col("r")[vector].cast("array<float>").alias("vec"))
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return latest.where((F.size("vec") == width) & finite & F.exists("vec", lambda x: x != 0))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, whatever their size."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of unit vectors with its partner to nine digits: the same
    sum in the same order whichever side comes first and wherever it is taken."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return np.round(total, 9)


def learn_rotations(sample: np.ndarray, blocks: int, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """Orthogonal matrices, each fitted by iterative quantisation from its own
    random start.

    The sample is not centred: agreement of signs then depends on the angle of
    two vectors alone, also where all of them point much the same way.
    """
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    out = []
    for _ in range(blocks):
        rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds if len(sample) > width else 0):
            turned = sample @ rotation
            u, _, vt = np.linalg.svd(sample.T @ np.where(turned >= 0, 1.0, -1.0))
            rotation = u @ vt
        out.append(rotation)
    return np.stack(out)


def expected_recall(cosine: float, bits: int, tables: int, flips: int = 0) -> float:
    """Chance that a pair of this cosine meets in some table (random rotations)."""
    p = 1 - math.acos(min(1.0, cosine)) / math.pi
    one = sum(math.comb(bits, f) * p ** (bits - f) * (1 - p) ** f for f in range(flips + 1))
    return 1 - (1 - one) ** tables


def substring_bits(rows: int) -> int:
    """Substring length at which a bucket of an even index holds about 16 rows."""
    return int(min(30, max(8, math.ceil(math.log2(max(rows, 1) / 16 + 1)))))


def tables_for(cosine: float, bits: int, flips: int, recall: float) -> int:
    """The fewest tables that reach ``recall`` at this cosine."""
    miss = 1 - expected_recall(cosine, bits, 1, flips)
    return max(2, math.ceil(math.log(1 - recall) / math.log(miss)))


def _packed(bits: np.ndarray, length: int) -> np.ndarray:
    """Bit rows as integers, ``length`` bits each (length <= 63)."""
    weights = (1 << np.arange(length, dtype=np.int64))
    return bits.astype(np.int64) @ weights


def _encoder(rotations: np.ndarray, length: int, tables: int, width: int):
    """From ``id, vec``: 252 bits of the code (c0 to c3) and its substrings."""
    per_block = rotations.shape[1] // length
    flat = np.concatenate([r for r in rotations], axis=1)
    columns = [
        np.arange(length) + (t // per_block) * rotations.shape[1] + (t % per_block) * length
        for t in range(tables)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = units(rows_of(batch.column(1), width)) @ flat >= 0
            # The Hamming test uses bits of the first rotations.
            wide = np.concatenate([bits, np.zeros((len(bits), max(0, TESTED - bits.shape[1])), bool)], axis=1)
            keys = np.stack([_packed(bits[:, c], length) for c in columns], axis=1)
            ends = pa.array(np.arange(len(bits) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(_packed(wide[:, i : i + 63], 63)) for i in range(0, TESTED, 63)),
                 pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))],
                ["id", "c0", "c1", "c2", "c3", "keys"],
            )

    return run


def reranked(met: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """``a, b, cosine`` of pairs ``a, b``: floats are looked up for these alone."""
    v = vectors.select("id", "vec")
    both = met.join(v.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a").join(
        v.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = cosines(units(rows_of(batch.column(2), width)), units(rows_of(batch.column(3), width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c)], ["a", "b", "cosine"])

    return both.select("a", "b", "va", "vb").mapInArrow(run, "a bigint, b bigint, cosine double")


def similar_pairs(
    vectors: DataFrame,
    k: int,
    min_cosine: float,
    recall: float = 0.99,
    flips: int = 0,
    sample_rows: int = 20_000,
    bucket_limit: int = 4096,
    width: int = 64,
) -> DataFrame:
    """``a, b, cosine`` for distinct vectors ``id bigint, vec array<float>``.

    Both directions come out; per ``a`` at least its ``k`` most similar ``b``
    with ``cosine >= min_cosine`` that the index retrieved, unranked.  The index
    is fitted on at most ``sample_rows`` vectors and holds every vector.
    """
    rows = vectors.count()
    share = min(1.0, 1.2 * sample_rows / max(rows, 1))
    fitted = vectors.select("vec").sample(share, seed=11).limit(sample_rows).toArrow()
    sample = units(rows_of(fitted.column("vec"), width)) if fitted.num_rows else np.zeros((0, width))
    length = min(substring_bits(rows), width)
    tables = tables_for(min_cosine, length, flips, recall)
    blocks = max(math.ceil(TESTED / width), math.ceil(tables / (width // length)))
    rotations = learn_rotations(sample, blocks)
    # Hamming distance of a pair at the floor over the tested bits: mean and four deviations.
    p = math.acos(min_cosine) / math.pi
    reach = math.ceil(TESTED * p + 4 * math.sqrt(TESTED * p * (1 - p)))

    words = ["c0", "c1", "c2", "c3"]
    coded = vectors.select("id", "vec").mapInArrow(
        _encoder(rotations, length, tables, width),
        "id bigint, c0 bigint, c1 bigint, c2 bigint, c3 bigint, keys array<bigint>",
    )
    entries = coded.select("id", *words, F.posexplode("keys").alias("t", "s"))
    key = (F.col("s") * tables + F.col("t")).alias("bucket")
    entries = entries.select("id", *words, key)
    sizes = entries.groupBy("bucket").count()
    hot = sizes.where(F.col("count") > bucket_limit).select("bucket", "count")

    index = entries.join(hot.select("bucket"), "bucket", "left_anti") if _any(hot) else entries
    hot_entries = None
    if index is not entries:
        hot_entries = entries.select("bucket", "id").join(hot, "bucket")
        # Buckets of near copies hold the same vectors in every table: then all
        # that are in hot buckets are compared once instead.
        apart = hot.agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0]
        ids = hot_entries.select("id").distinct()
        together = ids.count()
        if together * together < apart:
            hot_entries = ids.select(F.lit(0).cast("bigint").alias("bucket"), "id", F.lit(together).cast("bigint").alias("count"))
    left, right = index.alias("l"), index.alias("r")
    if flips:
        # One side probes its neighbourhood; each flipped bit is another bucket.
        masks = _masks(length, flips)
        probes = index.select(
            "id", *words,
            F.explode(F.array([F.lit(m * tables) for m in masks])).alias("mask"), "bucket",
        )
        part = F.expr(f"((bucket div {tables}) ^ (mask div {tables})) * {tables} + bucket % {tables}")
        left = probes.select("id", *words, part.alias("bucket")).alias("l")
    apart_bits = F.expr(" + ".join(f"bit_count(l.{c} ^ r.{c})" for c in words))
    met = (
        left.join(right, (F.col("l.bucket") == F.col("r.bucket")) & F.expr("l.id < r.id") & (apart_bits <= reach))
        .select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
        .distinct()
    )
    ranked = reranked(met, vectors, width).where(F.col("cosine") >= min_cosine)
    both = ranked.select(F.explode(F.array(
        F.struct("a", "b", "cosine"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")
    )).alias("p")).select("p.*")
    if hot_entries is not None:
        both = both.unionByName(
            _hot_pairs(hot_entries, vectors.select("id", "vec"), k, min_cosine, 2 * bucket_limit, width)
        ).distinct()
    return both


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _masks(length: int, flips: int) -> list[int]:
    masks = [0]
    if flips >= 1:
        masks += [1 << i for i in range(length)]
    if flips >= 2:
        masks += [(1 << i) | (1 << j) for i in range(length) for j in range(i)]
    if flips > 2:
        raise ValueError("at most two flips per substring")
    return masks


def nearest_of(
    asking: np.ndarray, x: np.ndarray, there: np.ndarray, y: np.ndarray, k: int, floor: float = -2.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a, b, cosine``: for each of ``asking`` (ids of unit vectors ``x``) the best
    ``k`` of ``there`` (``y``) at or above ``floor``, without itself, and what ties
    or nearly ties with the last of them.

    Single precision finds the candidates, with a margin above its error.  A
    first stretch of columns gives each row a threshold, so that only what beats
    it is ever put in order; ids below no one's threshold cost one comparison.
    """
    order = np.argsort(there)
    there, y = there[order], y[order]
    turned = np.ascontiguousarray(y.astype(np.float32).T)
    single = x.astype(np.float32)
    keep, margin = min(k, len(there)), np.float32(1e-5)
    parts = [(asking[:0], there[:0], np.zeros(0))]
    for at in range(0, len(asking) if keep else 0, AT_ONCE):
        ids = asking[at : at + AT_ONCE]
        dots = single[at : at + AT_ONCE] @ turned
        itself = np.minimum(np.searchsorted(there, ids), len(there) - 1)
        same = np.flatnonzero(there[itself] == ids)
        dots[same, itself[same]] = -2
        few = max(min(FIRST, len(there)), keep)
        least = np.partition(dots[:, :few], few - keep, axis=1)[:, few - keep] - margin
        beats = np.flatnonzero(dots >= np.maximum(least, np.float32(max(floor, -1.5)) - margin)[:, None])
        r, c = np.divmod(beats, len(there))
        value = dots.ravel()[beats]
        by = np.lexsort((-value, r))
        r, c, value = r[by], c[by], value[by]
        first = np.searchsorted(r, np.arange(len(ids)))
        size = np.diff(np.append(first, len(r)))
        last = np.full(len(ids), -2, np.float32)
        enough = size >= keep
        last[enough] = value[first[enough] + keep - 1]
        good = value >= (last - margin)[r]
        r, c = r[good], c[good]
        cosine = cosines(x[at + r], y[c])
        good = cosine >= floor
        parts.append((ids[r[good]], there[c[good]], cosine[good]))
    return tuple(np.concatenate(p) for p in zip(*parts))


PAIRS = "a bigint, b bigint, cosine double"


def _pairs(a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(cosine, pa.float64())})


def _hot_pairs(
    entries: DataFrame, vectors: DataFrame, k: int, min_cosine: float, limit: int, width: int
) -> DataFrame:
    """The best ``k`` per vector inside oversized buckets, block against block."""
    blocks = F.ceil(F.col("count") / limit)
    with_vec = entries.join(vectors, "id").select(
        "bucket", "id", "vec", blocks.cast("int").alias("blocks"),
        F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"),
    )
    # A vector of block i meets blocks 0..n-1: tasks (min, max) of the two blocks.
    tasks = with_vec.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select(
        "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "vec", "block",
    )

    def best(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        ids, x = table.column("id").to_numpy(), units(rows_of(table.column("vec"), width))
        first = table.column("block").to_numpy() == lo
        sides = [(first, first)] if lo == hi else [(first, ~first), (~first, first)]
        found = [nearest_of(ids[m], x[m], ids[t], x[t], k, min_cosine) for m, t in sides]
        return _pairs(*(np.concatenate(p) for p in zip(*found)))

    return tasks.groupBy("bucket", "lo", "hi").applyInArrow(best, PAIRS).distinct()


def exact_lists(short: DataFrame, vectors: DataFrame, k: int, width: int) -> DataFrame:
    """``a, b, cosine``: for the ids of ``short`` the best ``k`` of all vectors,
    whatever their cosine, with what ties or nearly ties in a block.

    Blocks of the short side meet blocks of all vectors, in at least as many
    tasks as there are cores.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n = short.count()
    right = max(1, math.ceil(vectors.count() / ALL_BLOCK))
    left = max(1, math.ceil(n / SHORT_BLOCK), min(math.ceil(cores / right), n // 1024))

    def block(count: int):
        return F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")

    def each(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    asking = vectors.join(short, "id", "left_semi").select(
        block(left).alias("lo"), each(right).alias("hi"), F.lit(True).alias("asks"), "id", "vec"
    )
    there = vectors.select(each(left).alias("lo"), block(right).alias("hi"), F.lit(False).alias("asks"), "id", "vec")

    def best(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, x = table.column("id").to_numpy(), units(rows_of(table.column("vec"), width))
        return _pairs(*nearest_of(ids[asks], x[asks], ids[~asks], x[~asks], k))

    return asking.unionByName(there).groupBy("lo", "hi").applyInArrow(best, PAIRS)


def most_similar(
    records: DataFrame,
    k: int = 5,
    min_cosine: float = 0.90,
    key: str = "chunk_id",
    vector: str = "embedding",
    version: str = "indexed_at",
    width: int = 64,
    complete: bool = False,
    **options,
) -> DataFrame:
    """For every key its ``k`` most similar keys, in order.

    Returns ``key, neighbour, cosine, rank`` (rank from 1; by cosine, ties by
    the neighbour's key).  Only neighbours with ``cosine >= min_cosine`` count:
    the index is laid out for that floor, at which it finds a pair with
    probability ``recall`` (0.99 unless given; more for closer pairs).  A key
    without such neighbours has no rows.  With ``complete`` there is no floor:
    lists that the index leaves short are made whole by ``exact_lists``.  Latest
    usable vectors only, see ``usable_vectors``; an empty table gives an empty
    result.
    """
    spark = records.sparkSession
    vectors = usable_vectors(records, key, vector, version, width)
    members = session.scratch(
        vectors.withColumns({"fp": F.xxhash64("vec"), "fp2": F.xxhash64(F.reverse("vec"))}), "vectors"
    )
    # Classes of equal vectors, told apart by 128 bits of hash.
    classes = session.scratch(
        members.groupBy("fp", "fp2")
        .agg(F.count("*").alias("members"), F.min("key").alias("key"), F.first("vec").alias("vec"))
        .withColumn("id", F.monotonically_increasing_id()),
        "vector-classes",
    )
    pairs = similar_pairs(classes.select("id", "vec"), k, min_cosine, width=width, **options)
    if complete:
        pairs = session.scratch(pairs, "near-pairs")
        full = pairs.groupBy(F.col("a").alias("id")).count().where(F.col("count") >= k)
        # More than k copies fill each other's lists.
        short = session.scratch(
            classes.where(F.col("members") <= k).select("id").join(full, "id", "left_anti"), "short-lists"
        )
        pairs = pairs.join(short.withColumnRenamed("id", "a"), "a", "left_anti").unionByName(
            exact_lists(short, classes.select("id", "vec"), k, width)
        )
    by_rank = Window.partitionBy("a").orderBy(F.desc("cosine"), "nkey")
    heads = classes.select(F.col("id").alias("b"), F.col("key").alias("nkey"))
    nearest = (
        pairs.join(heads, "b")
        .withColumn("r", F.row_number().over(by_rank))
        .where(F.col("r") <= k)
        .select("a", "b", "cosine")
    )
    # Members of a class: the first k + 1 by key stand for it as neighbours.
    within = Window.partitionBy("class").orderBy("key")
    single = classes.where("members = 1").select(
        F.col("id").alias("class"), "key", F.lit(1).alias("m")
    )
    several = classes.where("members > 1").select("fp", "fp2", F.col("id").alias("class"))
    ranked = members.select("fp", "fp2", "key").join(several, ["fp", "fp2"]).select("class", "key")
    first = ranked.withColumn("m", F.row_number().over(within)).where(F.col("m") <= k + 1)
    stands = single.unionByName(first)
    everyone = single.select("class", "key").unionByName(ranked)
    out = nearest.join(
        stands.select(F.col("class").alias("b"), F.col("key").alias("neighbour"), "m"), "b"
    ).where(F.col("m") <= k).select(F.col("a").alias("class"), "neighbour", "cosine")
    copies = first.select("class", F.col("key").alias("neighbour"), F.lit(1.0).alias("cosine"))
    best = Window.partitionBy("class").orderBy(F.desc("cosine"), "neighbour")
    lists = (
        out.unionByName(copies)
        .withColumn("r", F.row_number().over(best))
        .where(F.col("r") <= k + 1)
        .select("class", "neighbour", "cosine")
    )
    order = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    return (
        everyone.join(lists, "class")
        .where("key <> neighbour")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("key", "neighbour", "cosine", "rank")
    )


def mutual_cases(lists: DataFrame) -> DataFrame:
    """Unordered pairs of which at least one side lists the other, smaller key first."""
    return lists.select(
        F.least("key", "neighbour").alias("chunk_id_a"),
        F.greatest("key", "neighbour").alias("chunk_id_b"),
    ).distinct()


def recall(
    records: DataFrame, lists: DataFrame, asked, k: int = 5, key: str = "chunk_id", vector: str = "embedding",
    version: str = "indexed_at", width: int = 64, least: float = 0.9,
) -> DataFrame:
    """``asked, entries, recalled``: for a stated set of keys (a condition on ``key``)
    how many lists and true entries there are, and whether ``lists`` hold at least
    ``least`` of them; the truth is a comparison of the set with all vectors."""
    vectors = usable_vectors(records, key, vector, version, width)
    numbered = session.scratch(vectors.withColumn("id", F.monotonically_increasing_id()), "recall-vectors")
    names = numbered.select("id", "key")
    truth = exact_lists(numbered.where(asked).select("id"), numbered.select("id", "vec"), k, width)
    named = truth.join(names.select(F.col("id").alias("a"), F.col("key")), "a").join(
        names.select(F.col("id").alias("b"), F.col("key").alias("neighbour")), "b"
    )
    order = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    best = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("key", "neighbour")
    found = best.join(lists.select("key", "neighbour", F.lit(1).alias("hit")), ["key", "neighbour"], "left")
    return found.agg(
        F.count_distinct("key").alias("asked"), F.count("*").alias("entries"),
        (F.count("hit") >= least * F.count("*")).alias("recalled"),
    )
