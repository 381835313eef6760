"""Evaluation texts leaking into training text, by greedy string tiling.

Words are compared by content only: invisible format characters are dropped,
compatibility forms and case are folded, and everything that is not a letter or
digit merely separates words.  Three stages:

1. *Seeds.*  Every run of ``min_match`` words of every passage is hashed
   (Karp-Rabin); a rolling hash over each document, vectorised over a whole
   Arrow batch, finds the documents that share a run with any passage.
2. *Tiles.*  For each pair of document and passage with a seed, greedy string
   tiling repeatedly marks the longest common run not yet covered, down to
   ``min_match`` words, so that reordered passages are still covered.
3. *Coverage.*  The share of the passage's words under tiles is reported and
   can be thresholded.

The passages are an evaluation set: their seeds are carried to every task only
after a check of their size (``max_seed_words``); a larger set is cut into
blocks of passages that meet the documents one block after the other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import session

MIN_MATCH = 12
MAX_SEED_WORDS = 2_000_000

_ASCII = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

FOUND = (
    "item_id bigint, longest int, tiles int, covered int, passage_words int, coverage double"
)


def words(text: str) -> list[str]:
    """The words of a text as they are compared."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    kept = "".join(c for c in text if unicodedata.category(c) != "Cf")
    folded = unicodedata.normalize("NFKC", kept).casefold()
    return _WORD.findall(unicodedata.normalize("NFKC", folded))


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all runs of ``width`` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            total = total * _BASE + codes[i : i + n]
    return total


def scatter(ids: np.ndarray) -> np.ndarray:
    """Word numbers spread over 64 bits (splitmix64), so that sums don't collide."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Seeds:
    """The passages' words as numbers, and the hashes of their runs."""

    def __init__(self, passages: list[tuple[int, str]], width: int) -> None:
        self.width = width
        self.vocabulary: dict[str, int] = {}
        self.items: list[int] = []
        self.texts: list[np.ndarray] = []
        hashes, owners = [], []
        for item, passage in passages:
            number = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(passage or "")]
            ids = np.array(number, np.int64)
            found = rolling(scatter(ids), width)
            hashes.append(found)
            owners.append(np.full(len(found), len(self.items)))
            self.items.append(item)
            self.texts.append(ids)
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.lexsort((owner, every))
        self.hashes, self.owners = every[order], owner[order].astype(np.int64)
        self.distinct = np.unique(self.hashes)

    def numbers(self, text: str | None) -> np.ndarray:
        """A document's words as numbers; 0 is a word of no passage."""
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words(text or "")], np.int64)

    def candidates(self, batch: list[np.ndarray]) -> list[tuple[int, int]]:
        """``(document, passage)`` positions that share at least one seed."""
        if not len(self.distinct) or not batch:
            return []
        gap = np.zeros(1, np.int64)
        flat = np.concatenate([x for ids in batch for x in (ids, gap)])
        # A run that holds a word of no passage cannot match.
        bad = np.cumsum(np.concatenate([gap, flat == 0]))
        n = len(flat) - self.width + 1
        if n <= 0:
            return []
        whole = np.flatnonzero(bad[self.width :] - bad[:n] == 0)
        if not len(whole):
            return []
        hashes = rolling(scatter(flat), self.width)[whole]
        at = np.searchsorted(self.distinct, hashes)
        at[at == len(self.distinct)] = 0
        hit = self.distinct[at] == hashes
        whole, hashes = whole[hit], hashes[hit]
        ends = np.cumsum([len(ids) + 1 for ids in batch])
        document = np.searchsorted(ends, whole, side="right")
        low = np.searchsorted(self.hashes, hashes, side="left")
        high = np.searchsorted(self.hashes, hashes, side="right")
        pairs = {
            (int(d), int(p))
            for d, a, b in zip(document, low, high)
            for p in self.owners[a:b]
        }
        return sorted(pairs)


def tile(passage: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(passage start, text start, length)``, longest first.

    Runs of ``least`` equal words are found by hash, extended over unmarked
    words, and the longest is marked; ties go to the earliest in the passage,
    then in the text.  Words of no passage (0) match nothing.
    """
    marked_p = np.zeros(len(passage), bool)
    marked_t = (text == 0).copy()
    tiles: list[tuple[int, int, int]] = []
    while True:
        starts: dict[int, list[int]] = {}
        for i, h in enumerate(rolling(scatter(passage), least).tolist()):
            if not marked_p[i : i + least].any():
                starts.setdefault(h, []).append(i)
        found: list[tuple[int, int, int]] = []
        reach: dict[tuple[int, int], int] = {}
        for j, h in enumerate(rolling(scatter(text), least).tolist()):
            if h not in starts or marked_t[j : j + least].any():
                continue
            for i in starts[h]:
                before = reach.pop((i - 1, j - 1), 0)
                if before > least:  # inside a longer run that began earlier
                    reach[(i, j)] = before - 1
                    continue
                if not np.array_equal(passage[i : i + least], text[j : j + least]):
                    continue
                n = least
                while (
                    i + n < len(passage) and j + n < len(text)
                    and passage[i + n] == text[j + n]
                    and not marked_p[i + n] and not marked_t[j + n]
                ):
                    n += 1
                reach[(i, j)] = n
                found.append((-n, i, j))
        if not found:
            return tiles
        found.sort()
        # All runs of the greatest length that do not overlap are marked at once.
        longest = -found[0][0]
        for n, i, j in found:
            if -n < longest:
                break
            if not (marked_p[i : i + longest].any() or marked_t[j : j + longest].any()):
                marked_p[i : i + longest] = True
                marked_t[j : j + longest] = True
                tiles.append((i, j, longest))


def leaks(
    documents: DataFrame,
    items: DataFrame,
    min_match: int = MIN_MATCH,
    min_coverage: float = 0.0,
    max_seed_words: int = MAX_SEED_WORDS,
) -> DataFrame:
    """Documents that hold a passage of an evaluation item, fully or in part.

    ``documents`` has ``doc_id, text``, ``items`` has ``item_id, passage``; other
    columns are ignored.  A row per pair with a common run of at least
    ``min_match`` words: ``longest`` tile, number of ``tiles``, ``covered``
    words of the passage, ``passage_words`` and ``coverage`` (their quotient,
    at least ``min_coverage``).  Of an item's several passages the best covered
    one counts.  Null and empty texts and passages shorter than ``min_match``
    words match nothing; repeated rows repeat their result (of items: are taken
    once).  Whole texts are read, whatever their length.
    """
    spark = documents.sparkSession
    rows = items.where("item_id is not null and passage is not null").select("item_id", "passage").distinct()
    rows = session.scratch(rows.withColumn("n", F.size(F.split("passage", r"\W+"))), "passages")
    # Passages meet the documents in blocks, each small enough to be carried to
    # every task (an evaluation set is one block); the driver holds one at a time.
    blocks = 1 + (rows.agg(F.sum("n")).first()[0] or 0) // max_seed_words
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = session.spread(documents.select("doc_id", "text"))
    found = None
    for b in range(blocks):
        held = rows.where(block == b).select("item_id", "passage").orderBy("item_id", "passage")
        carried = spark.sparkContext.broadcast([tuple(r) for r in held.toLocalIterator()])
        part = texts.mapInPandas(_matcher(carried, min_match, min_coverage), f"doc_id {kind}, {FOUND}")
        found = part if found is None else found.unionByName(part)
    return found


def _matcher(carried, width: int, least: float):
    names = ["doc_id", *(c.split()[0] for c in FOUND.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = Seeds(carried.value, width)
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            numbers = [seeds.numbers(t) for t in texts]
            best: dict[tuple[int, int], tuple] = {}
            for d, p in seeds.candidates(numbers):
                passage = seeds.texts[p]
                tiles = tile(passage, numbers[d], width)
                covered = sum(n for _, _, n in tiles)
                if tiles and covered >= least * len(passage):
                    one = (covered / len(passage), max(n for _, _, n in tiles), len(tiles), covered, len(passage))
                    pair = d, seeds.items[p]
                    best[pair] = max(one, best.get(pair, one))
            out = [
                (ids[d], item, longest, tiles, covered, size, share)
                for (d, item), (share, longest, tiles, covered, size) in best.items()
            ]
            yield pd.DataFrame(out, columns=names)

    return run


def leaks_by_shingles(documents: DataFrame, items: DataFrame, min_match: int = MIN_MATCH) -> DataFrame:
    """``doc_id, item_id`` by another road, to hold ``leaks`` against: every run of
    ``min_match`` words of every document, by its hash, joined with those of the passages."""

    def runs(rows: DataFrame, key: str, text: str) -> DataFrame:
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [" ".join(words(t or "")) for t in batch[text]]
                yield pd.DataFrame({key: batch[key], "w": found})

        kind = rows.schema[key].dataType.simpleString()
        parts = rows.select(key, text).mapInPandas(cut, f"{key} {kind}, w string").select(key, F.split("w", " ").alias("w"))
        starts = F.sequence(F.lit(1), F.size("w") - (min_match - 1))
        return parts.where(F.size("w") >= min_match).select(
            key, F.explode(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, min_match)))).alias("run")
        )

    asked = session.scratch(runs(items.where("item_id is not null"), "item_id", "passage").distinct(), "passage-runs")
    # Passages are an evaluation set; beyond the counted bound the join shuffles.
    asked = session.broadcast_small(asked, MAX_SEED_WORDS)
    return runs(session.spread(documents.select("doc_id", "text")), "doc_id", "text").join(asked, "run").select("doc_id", "item_id").distinct()
