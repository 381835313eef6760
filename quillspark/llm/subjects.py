"""Subject areas of documents by latent semantic analysis.

1. *Reading.*  One pass turns every text into hashed word codes with sentence
   marks, and counts in how many documents each word stands; all later passes
   read that compact table.
2. *Space.*  Documents are term vectors (log frequency times inverse document
   frequency, counted over all documents).  One pass sums ``X'X Omega`` for a
   fixed random ``Omega``, from which the truncated singular value decomposition
   follows (Nystroem); its size is linear in the vocabulary.
3. *Centroids.*  Seeds come from labelled documents, one centroid per subject
   and language group (and one per subject).  Each round assigns all documents
   by cosine, keeps the clear ones, and renews the centroids and the term
   weights: a term counts by how unevenly it is spread over the subjects, which
   silences the phrases that all subjects share.  The space is renewed with the
   weights (no pass: weighting scales the rows of the sketch).  Rounds end when
   the centroids move less than ``settled``, and after ``rounds`` at most.
4. *Assignment.*  Every sentence goes to the subject of its nearest centroid if
   it holds a telling term and the cosine is clear; a document has the subjects
   of which at least ``share`` of its sentences speak.

What travels to the driver is bounded by the vocabulary - the terms in at least
``min_share`` of all documents, hence at most (mean distinct words of a document
/ ``min_share``) of them, however many documents there are - and by the labelled
sample (``max_labels`` documents); partial sums meet in a tree of slices first.
"""

from __future__ import annotations

import html
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import session

#: A line that ends without a full stop is a sentence from this many words on
#: (a broken line); shorter ones are headings, labels and the like.
_LINE_WORDS = 8
_LEAST_WORDS = 3
#: The code that stands after each sentence; as a counted word it stands for all documents.
MARK = 0
SLICES = 16
#: Columns of the random sketch beyond the dimensions that are kept.
OVERSAMPLE = 64


@dataclass(frozen=True)
class Options:
    """Parameters of the model; see the module's docstring."""

    share: float = 0.2
    dimensions: int = 256
    rounds: int = 3
    settled: float = 0.01
    min_share: float = 0.001
    max_share: float = 0.25
    max_labels: int = 20_000
    clear: float = 0.1
    telling: float = 0.3
    min_cosine: float = 0.1
    margin: float = 0.1
    prior: float = 3.0
    least_seeds: float = 1.5


class Alphabet:
    """Classes of code points, learned as they are met."""

    LETTER, LOWER, UPPER, SPACE, STOP, CLOSER = 1, 2, 4, 8, 16, 32

    def __init__(self) -> None:
        self.kind = np.full(0x110000, 128, np.uint8)
        self.lower = np.zeros(0x110000, np.uint32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        """The class bits of every code point."""
        kinds = self.kind[points]
        new = points[kinds == 128]
        if len(new):
            for p in np.unique(new).tolist():
                c = chr(p)
                bits = self.SPACE if c.isspace() else 0
                if c.isalpha():
                    bits |= self.LETTER | (self.LOWER if c.islower() else self.UPPER if c.isupper() else 0)
                    self.lower[p] = ord(c.lower()[0])
                if c in ".!?…":
                    bits |= self.STOP
                if c in "\"'”’»)]":
                    bits |= self.CLOSER
                self.kind[p] = bits
            kinds = self.kind[points]
        return kinds


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values with their bits well spread (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Coder:
    """Texts as word codes with a 0 after each sentence, many texts at a time.

    All steps are array operations over the code points of the joined texts.  A
    word is a run of letters, also cut where a capital follows a small letter;
    its code is a 32-bit hash of its lower-case letters, taken from differences
    of one running polynomial over the whole array.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.alphabet = Alphabet()
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 1 << 20)
            for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(codes, lengths)``: all codes in a row, and how many each text has."""
        texts = [html.unescape(t) if t and "&" in t else t or "" for t in texts]
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, a = self.alphabet(points), self.alphabet
        letter = (kinds & a.LETTER).astype(bool)
        first = letter.copy()
        first[1:] &= ~letter[:-1] | (((kinds[:-1] & a.LOWER) > 0) & ((kinds[1:] & a.UPPER) > 0))
        starts = np.flatnonzero(first)
        last = letter
        last[:-1] &= ~letter[1:] | first[1:]
        ends = np.flatnonzero(last) + 1
        self._reach(len(points) + 1)
        running = np.zeros(len(points) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(a.lower[points] * self.powers[: len(points)], out=running[1:])
            hashes = mixed((running[ends] - running[starts]) * self.inverse[starts])
        words = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
        words[words == MARK] = 1

        # Ends of sentences: white space after a stop and closing marks; other ends of lines.
        space = np.flatnonzero((kinds[1:] & a.SPACE > 0) & (kinds[:-1] & (a.STOP | a.CLOSER) > 0)) + 1
        back = space - 1
        while True:
            closing = (kinds[back] & a.CLOSER > 0) & (back > 0)
            if not closing.any():
                break
            back = back - closing
        full = np.zeros(len(points), bool)
        full[space[kinds[back] & a.STOP > 0]] = True
        mark = full | (points == 10)
        at = np.flatnonzero(first | mark)
        is_mark = mark[at]
        codes = np.zeros(len(at), np.int32)
        codes[~is_mark] = words
        place = np.flatnonzero(is_mark)
        length = np.diff(place, prepend=-1) - 1
        good = (length >= _LINE_WORDS) | ((length >= _LEAST_WORDS) & full[at[place]])
        mask = good[np.cumsum(is_mark) - is_mark]
        before = np.concatenate([[0], np.cumsum(mask)])
        cuts = np.searchsorted(at, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        return codes[mask], np.diff(before[cuts])


#: Characters of text that are coded at a time, and distinct words counted before they are sent on.
_AT_ONCE = 1_000_000
_COUNTED = 1_000_000


class Counter:
    """In how many documents each code stands (code 0: documents in all)."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        document = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        pairs = np.sort((codes.astype(np.int64) << 31) + document)
        pairs = pairs[np.diff(pairs, prepend=pairs[0] - 1 if len(pairs) else 0) != 0]
        words, counts = np.unique(pairs >> 31, return_counts=True)
        some = words != MARK
        self.parts.append((np.append(words[some], MARK), np.append(counts[some], len(lengths))))
        self.held += len(words) + 1

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words, where = np.unique(np.concatenate([w for w, _ in self.parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([c for _, c in self.parts])).astype(np.int64)
        self.parts, self.held = [(words, counts)], len(words)
        return words, counts


def encode(documents: DataFrame) -> DataFrame:
    """``doc_id, lang, codes, counts``: every document's words, a 0 after each
    sentence (``counts`` null); and rows without ``doc_id`` that say in how many
    documents of a part each of ``codes`` stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counter, ids = Coder(), Counter(), None

        def tally() -> pa.RecordBatch:
            words, counts = counter.merged()
            counter.parts, counter.held = [], 0
            ends = pa.array([0, len(words)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, ids), pa.nulls(1, pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(words.astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(counts)),
                ],
                ["doc_id", "lang", "codes", "counts"],
            )

        for batch in batches:
            ids = batch.column(0).type
            texts = batch.column(2).to_pylist()
            first, held = 0, 0
            for i, text in enumerate(texts):
                held += len(text)
                if held >= _AT_ONCE or i == len(texts) - 1:
                    codes, lengths = coder(texts[first : i + 1])
                    counter.add(codes, lengths)
                    if counter.held > 4 * _COUNTED and len(counter.merged()[0]) > _COUNTED:
                        yield tally()
                    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0), part.column(1),
                            pa.ListArray.from_arrays(offsets, pa.array(codes)),
                            pa.nulls(len(lengths), pa.list_(pa.int64())),
                        ],
                        ["doc_id", "lang", "codes", "counts"],
                    )
                    first, held = i + 1, 0
        if counter.parts:
            yield tally()

    kind = documents.schema["doc_id"].dataType.simpleString()
    lang = F.substring(F.lower(F.trim(F.coalesce("lang", F.lit("")))), 1, 2)
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return (
        session.spread(rows.select("doc_id", lang.alias("lang"), "text"))
        .mapInArrow(run, f"doc_id {kind}, lang string, codes array<int>, counts array<bigint>")
    )


#: Documents whose vectors are multiplied at a time.
_BLOCK = 512


class Space:
    """The vocabulary: codes in order, their idf, and a table to look codes up."""

    def __init__(self, codes: np.ndarray, idf: np.ndarray) -> None:
        self.codes, self.idf = codes, idf
        self.bits = max(10, math.ceil(math.log2(64 * max(1, len(codes)))))
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[self._slot(codes)] = np.arange(len(codes))

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (codes.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def positions(self, flat: np.ndarray) -> np.ndarray:
        """The position of every code in the vocabulary, -1 for others."""
        at = self.table[self._slot(flat)]
        other = np.flatnonzero((at >= 0) & (self.codes[at] != flat))
        # A slot that another term holds: searched for (few).
        there = np.minimum(np.searchsorted(self.codes, flat[other]), len(self.codes) - 1)
        at[other] = np.where(self.codes[there] == flat[other], there, -1)
        return at

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``first, rows, terms, x``: unit term vectors of some hundred documents,
        over the terms that they hold."""
        flat, lengths = words_of(batch)
        at, ends = self.positions(flat), np.cumsum(lengths)
        size = len(self.codes)
        for first in range(0, len(lengths), _BLOCK):
            n = min(_BLOCK, len(lengths) - first)
            a = ends[first] - lengths[first]
            term = at[a : ends[first + n - 1]]
            document = np.repeat(np.arange(n), lengths[first : first + n])
            keys = np.sort((document * size + term)[term >= 0])
            head = np.flatnonzero(np.diff(keys, prepend=-1))
            count = np.diff(np.append(head, len(keys)))
            row, column = np.divmod(keys[head], size)
            value = np.log1p(count.astype(np.float32)) * self.idf[column]
            norm = np.sqrt(np.bincount(row, value * value, n))
            value /= np.maximum(norm, 1e-9)[row].astype(np.float32)
            present = np.zeros(size, bool)
            present[column] = True
            terms = np.flatnonzero(present)
            x = np.zeros((n, len(terms)), np.float32)
            x[row, (np.cumsum(present) - 1)[column]] = value
            yield first, n, terms, x


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a batch in a row, and how many each document has."""
    column = batch.column(batch.schema.get_field_index("codes"))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def unit(a: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (zero rows stay zero)."""
    return a / np.maximum(1e-9, np.linalg.norm(a, axis=1, keepdims=True))


def summed(table: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all partitions of ``partial(batches) -> matrix``.

    At most twice as many tasks as there are cores each sum their share of the
    table (a narrow merge of partitions).  Their sums are cut into slices of
    rows that meet in a tree: first some of each slice, then all of it, so that
    no group holds more than the root of the number of tasks.  The driver
    receives one matrix.
    """
    bounds = np.linspace(0, shape[0], SLICES + 1).astype(int)
    tasks = 2 * table.sparkSession.sparkContext.defaultParallelism
    fan = max(1, math.isqrt(tasks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = partial(batches)
        if matrix is None:
            return
        pieces = [matrix[a:b].astype(np.float32).tobytes() for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array(pieces, pa.binary())], ["slice", "part"]
        )

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(parts["part"].iloc[0]) // 4, np.float64)
        for p in parts["part"]:
            total += np.frombuffer(p, np.float32)
        return pd.DataFrame({"slice": [int(key[0])], "part": [total.astype(np.float32).tobytes()]})

    parts = table.coalesce(tasks).mapInArrow(run, "slice int, part binary")
    branch = F.pmod(F.spark_partition_id(), F.lit(fan)).alias("branch")
    rows = (
        parts.select("slice", "part", branch)
        .groupBy("slice", "branch").applyInPandas(add, "slice int, part binary")
        .groupBy("slice").applyInPandas(add, "slice int, part binary")
        .collect()
    )
    out = np.zeros(shape)
    for r in rows:
        a, b = bounds[r["slice"]], bounds[r["slice"] + 1]
        out[a:b] = np.frombuffer(r["part"], np.float32).reshape(b - a, shape[1])
    return out


def vocabulary(counted: DataFrame, o: Options) -> tuple[Space, int]:
    """Terms by document frequency over all documents, and how many documents there are."""
    pairs = counted.select(F.explode(F.arrays_zip("codes", "counts")).alias("c"))
    totals = pairs.groupBy(F.col("c.codes").alias("code")).agg(F.sum("c.counts").alias("n"))
    totals = session.scratch(totals, "word-counts")
    every = totals.where(F.col("code") == MARK).first()
    documents = every["n"] if every else 0
    least = max(3.0, o.min_share * documents)
    kept = (
        totals.where((F.col("code") != MARK) & (F.col("n") >= least) & (F.col("n") <= o.max_share * documents))
        .toPandas().sort_values("code")
    )
    idf = np.log(documents / kept["n"].to_numpy(np.float64)) if len(kept) else np.zeros(0)
    return Space(kept["code"].to_numpy(np.int32), idf.astype(np.float32)), documents


def omega(size: int, columns: int) -> np.ndarray:
    """The fixed random matrix of the sketch."""
    return np.random.default_rng(5).standard_normal((size, columns), np.float32)


def sketched(coded: DataFrame, space: Space, columns: int) -> np.ndarray:
    """``X'X Omega``, summed over all documents."""

    def partial(batches):
        total, random = None, omega(len(space.codes), columns)
        for batch in batches:
            for _, _, terms, x in space.blocks(batch):
                if total is None:
                    total = np.zeros(random.shape, np.float32)
                total[terms] += x.T @ (x @ random[terms])
        return total

    return summed(coded.select("codes"), partial, (len(space.codes), columns))


def factor(sketch: np.ndarray) -> np.ndarray:
    """``f`` with ``f f'`` close to ``X'X``, from its product with the random matrix."""
    random = omega(*sketch.shape).astype(np.float64)
    shift = 1e-6 * max(1e-12, np.linalg.norm(sketch))
    moved = sketch + shift * random
    values, vectors = np.linalg.eigh(random.T @ moved)
    keep = values > 1e-9 * max(values.max(), 1e-12)
    return moved @ (vectors[:, keep] / np.sqrt(values[keep]))


def leading(weighted: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` leading left singular vectors."""
    values, vectors = np.linalg.eigh(weighted.T @ weighted)
    order = np.argsort(-values)[:k]
    order = order[values[order] > 1e-9 * max(values.max(), 1e-12)]
    return (weighted @ vectors[:, order]) / np.sqrt(values[order])


def term_weights(holding: np.ndarray, sizes: np.ndarray, rate: np.ndarray, prior: float) -> np.ndarray:
    """One minus the entropy of a term over the subjects: 0 for shared phrases.

    ``holding`` counts each subject's documents with the term; ``rate`` is the
    term's overall rate, to which small counts are drawn.
    """
    rates = (holding + prior * rate) / (sizes[:, None] + prior)
    p = rates / np.maximum(rates.sum(0), 1e-12)
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(0) / np.log(max(2, len(sizes)))
    return np.clip(1 - entropy, 0, 1).astype(np.float32)


def clean_subject(c):
    """A subject as it is spelled in the subject table."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def nearest(products: np.ndarray, there: np.ndarray, subjects: int) -> np.ndarray:
    """The greatest product per subject; columns are groups of all subjects."""
    shaped = np.where(there, products, -1.0).reshape(len(products), -1, subjects)
    return shaped.max(axis=1)


def best_two(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the place of the greatest value, it, and the second greatest."""
    top = near.argmax(axis=1)
    rows = np.arange(len(near))
    first = near[rows, top]
    rest = near.copy()
    rest[rows, top] = -np.inf
    return top, first, rest.max(axis=1)


def subjects_of(
    documents: DataFrame, labels: DataFrame, subjects: DataFrame, options: Options = Options()
) -> DataFrame:
    """``doc_id, subject, share`` of every subject that a document is about.

    ``documents`` has ``doc_id, text, lang``, ``labels`` has ``doc_id,
    subject`` (wrong, null and unknown ones allowed), ``subjects`` has
    ``subject``; other columns are ignored.  ``share`` is the share of the
    document's sentences that speak of the subject, at least
    ``options.share``.  Null, blank and sentence-free texts have no subject, and
    nothing has one if no usable label exists.  Repeated rows repeat their
    result.
    """
    o = options
    names = sorted(r["subject"] for r in subjects.select("subject").dropna().distinct().collect())
    both = session.scratch(encode(documents), "word-codes")
    coded = both.where("counts is null").drop("counts")
    kind = documents.schema["doc_id"].dataType.simpleString()
    empty = documents.sparkSession.createDataFrame([], f"doc_id {kind}, subject string, share double")
    space, _ = vocabulary(both.where("counts is not null"), o)
    if not len(space.codes) or len(names) < 2:
        return empty

    known = (
        labels.select("doc_id", clean_subject(F.col("subject")).alias("subject"))
        .where(F.col("subject").isin(names)).distinct()
        .groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(o.max_labels)
    )
    sample = coded.join(known, "doc_id").select("lang", "codes", "subjects").toArrow()
    sample = sample.combine_chunks().to_batches()
    number = {s: i for i, s in enumerate(names)}
    langs = [x for batch in sample for x in batch.column("lang").to_pylist()]
    if not langs:
        return empty
    # Language groups that hold at least a hundredth of the labelled documents; the last: all others.
    counts = pd.Series(langs).value_counts()
    groups = sorted(counts.index[counts >= max(o.least_seeds, 0.01 * len(langs))])
    group = {g: i for i, g in enumerate(groups)}
    size, cells = len(space.codes), len(names) * (len(groups) + 1)

    def cell(lang: list[str]) -> np.ndarray:
        """The first cell of each document's language group."""
        return np.array([group.get(g, len(groups)) for g in lang]) * len(names)

    def gather(out: np.ndarray, terms: np.ndarray, x: np.ndarray, share: np.ndarray) -> None:
        """Adds per cell: summed vectors, documents with each term, documents."""
        out[:, terms] += share.T @ x
        out[:, size + terms] += share.T @ (x > 0).astype(np.float32)
        out[:, -1] += share.sum(0)

    seeds = np.zeros((cells, 2 * size + 1))
    for batch in sample:
        at, found = cell(batch.column("lang").to_pylist()), batch.column("subjects").to_pylist()
        for first, n, terms, x in space.blocks(batch):
            share = np.zeros((n, cells), np.float32)
            for i in range(n):
                for s in found[first + i]:
                    share[i, at[first + i] + number[s]] = 1 / len(found[first + i])
            gather(seeds, terms, x, share)

    rate = np.exp(-space.idf.astype(np.float64))
    columns = min(size, o.dimensions + OVERSAMPLE)
    root = factor(sketched(coded, space, columns))
    sums, before = seeds, None
    for turn in range(o.rounds + 1):
        overall = sums.reshape(len(groups) + 1, len(names), -1).sum(0)
        weights = term_weights(overall[:, size : 2 * size], overall[:, -1], rate, o.prior)
        basis = leading(root * weights[:, None], o.dimensions)
        # One centroid per cell of a language group, and one per subject over all.
        raw = np.concatenate([sums[: len(names) * len(groups)], overall])
        there = np.r_[sums[: len(names) * len(groups), -1] >= o.least_seeds, overall[:, -1] > 0]
        centroids = unit((raw[:, :size] * weights) @ basis)
        # The centroids as term vectors: a document's product with them is its product in the space.
        image = ((basis @ centroids.T) * weights[:, None]).astype(np.float32)
        now = unit(raw[:, :size])
        if turn == o.rounds or (before is not None and ((now * before).sum(1)[there] >= 1 - o.settled).all()):
            break
        before = now

        def partial(batches, image=image, there=there, squares=weights.astype(np.float32) ** 2):
            out = None
            for batch in batches:
                at = cell(batch.column(batch.schema.get_field_index("lang")).to_pylist())
                for first, n, terms, x in space.blocks(batch):
                    near = nearest(x @ image[terms], there, len(names))
                    near /= np.sqrt(np.maximum(x * x @ squares[terms], 1e-12))[:, None]
                    top, best, second = best_two(near)
                    share = np.zeros((n, cells), np.float32)
                    sure = np.flatnonzero(best - second > o.clear * np.abs(best))
                    share[sure, at[first + sure] + top[sure]] = 1
                    out = np.zeros(seeds.shape, np.float32) if out is None else out
                    gather(out, terms, x, share)
            return out

        sums = seeds + summed(coded.select("lang", "codes"), partial, seeds.shape)

    image *= space.idf[:, None]
    squares = ((space.idf * weights) ** 2).astype(np.float32)
    matters, telling = weights >= 0.02, weights >= o.telling

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths = words_of(batch)
            marks = flat == MARK
            of = np.repeat(np.arange(len(lengths)), lengths)[marks]
            sentences = np.bincount(of, minlength=len(lengths))
            term = space.positions(flat)
            keep = np.flatnonzero((term >= 0) & matters[term])
            # The sentence of a word is the number of marks before it.
            sentence, term = np.cumsum(marks)[keep], term[keep]
            starts = np.flatnonzero(np.diff(sentence, prepend=-1))
            # Only sentences with a telling term can be assigned.
            tells = np.logical_or.reduceat(telling[term], starts) if len(starts) else np.zeros(0, bool)
            several = np.repeat(tells, np.diff(np.append(starts, len(term))))
            term, sentence = term[several], sentence[several]
            starts = np.flatnonzero(np.diff(sentence, prepend=-1))
            hits = [np.empty(0, np.int64)]
            for a in range(0, len(starts), 8192):
                begin = starts[a : a + 8192]
                part = term[begin[0] : starts[a + 8192] if a + 8192 < len(starts) else len(term)]
                near = nearest(np.add.reduceat(image[part], begin - begin[0], axis=0), there, len(names))
                near /= np.sqrt(np.add.reduceat(squares[part], begin - begin[0]))[:, None]
                top, best, second = best_two(near)
                good = (best >= o.min_cosine) & (best - second >= o.margin * best)
                hits.append(of[sentence[begin[good]]] * len(names) + top[good])
            speaks = np.bincount(np.concatenate(hits), minlength=len(lengths) * len(names))
            share = speaks.reshape(len(lengths), len(names)) / np.maximum(sentences, 1)[:, None]
            d, s = np.nonzero(share >= o.share)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(d)),
                    pa.array([names[i] for i in s], pa.string()),
                    pa.array(share[d, s], pa.float64()),
                ],
                ["doc_id", "subject", "share"],
            )

    return coded.select("doc_id", "codes").mapInArrow(
        assign, f"doc_id {kind}, subject string, share double"
    )


def two_at_most(found: DataFrame) -> DataFrame:
    """At most the two leading subjects per document (share, then name)."""
    ranked = found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct((-F.col("share")).alias("minus"), "subject"))).alias("all")
    )
    return ranked.select("doc_id", F.explode(F.slice("all", 1, 2)).alias("one")).select(
        "doc_id", F.col("one.subject").alias("subject")
    )


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """``subject, documents, share``: how many documents are about each subject."""
    total = documents.agg(F.count("*").alias("total"))
    counts = found.groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"))
    return counts.crossJoin(F.broadcast(total)).select(
        "subject", "documents", (F.col("documents") / F.col("total")).alias("share")
    )
