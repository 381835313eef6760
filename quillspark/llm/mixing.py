"""Mixing sources to target weights, by temperature.

Sizes are tokens of a public tokenizer (or characters).  Every mixture takes its
weights from exponentiated, normalised source shares:

* ``tempered_to_targets`` - with targets, weights lie on the path
  ``natural**(1-a) * target**a``: exponent 0 leaves the corpus as it is, exponent
  1 gives the targets.  The exponent goes to 1 for every source whose repetition
  limit allows it; for one that would be repeated too often at its target it is
  bisected to the point where the source meets its limit.  The source stays
  there, and the others share the rest of the total by their tempered weights.
* ``temperature`` - without targets, weights are ``natural**a`` with ``a``
  bisected to an entropy or to a repetition limit of all sources.

The total is that of the scenario's sources (``"corpus"``), a number, or
``"exact"``: the largest at which all targets hold exactly.

The weights become a selection by *block permutations*: a source's documents
are permuted by a keyed hash, once per repetition; whole blocks are taken as
long as the budget lasts, and the last block up to the document that comes
nearest to it.  The cut is found on sums over hash ranges first, so only one
range per source is ever put in order: no source is sorted in one task.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark import session

TOKENIZERS = "/opt/tokenizers"
RANGES = 4096
#: Fixed value: the splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str):
    """A byte-level tokenizer from a ranks file."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_name(c):
    """A source's name, trimmed, in lower case, with underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def sized(
    documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str | None = "byte_bpe_50k.tiktoken"
) -> DataFrame:
    """``doc_id, source, tokens``: every document's size in tokens (in characters
    without a ``vocabulary``).

    Sources are normalised in spelling; documents without a source, and null or
    token-free texts, drop out (they can belong to no target).  Whole texts are
    counted.  ``tokenizers`` is a folder that every executor can read.
    """
    path = os.path.join(tokenizers, vocabulary or "")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) for t in batch.pop("text").tolist()]
            yield batch.assign(tokens=tokens)

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    rows = rows.where("doc_id is not null and source <> '' and text is not null")
    if vocabulary is None:
        return rows.select("doc_id", "source", F.length("text").cast("bigint").alias("tokens")).where("tokens > 0")
    return (
        session.spread(rows)
        .mapInPandas(count, f"doc_id {kind}, source string, tokens bigint")
        .where("tokens > 0")
    )


def tempered(natural: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent and scaled to 1; absent sources stay absent."""
    raised = {s: p**exponent for s, p in natural.items() if p > 0}
    total = sum(raised.values())
    return {s: p / total for s, p in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    """Shannon entropy in nats."""
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def bisect(holds, low: float, high: float, rounds: int = 60) -> float:
    """The largest point of ``[low, high]`` up to which ``holds`` is true."""
    if holds(high):
        return high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def temperature(
    sizes: dict[str, float],
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: float | None = None,
) -> tuple[float, dict[str, float]]:
    """The exponent between 1 (natural) and 0 (even), and its weights.

    Going from natural towards even, stops at ``target_entropy`` or before any
    source needs more than ``max_repeats`` passes of the ``budget`` (the size
    of all sources unless given).
    """
    total = sum(sizes.values())
    natural = {s: n / total for s, n in sizes.items() if n > 0}
    budget = total if budget is None else budget

    def holds(flat: float) -> bool:
        shares = tempered(natural, 1 - flat)
        if target_entropy is not None and entropy(shares) > target_entropy:
            return False
        return max_repeats is None or all(
            p * budget <= max_repeats * sizes[s] * (1 + 1e-9) for s, p in shares.items()
        )

    exponent = 1 - bisect(holds, 0.0, 1.0)
    return exponent, tempered(natural, exponent)


def path(natural: dict[str, float], goal: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares between the natural ones (exponent 0) and the goal (1), scaled to 1."""
    raised = {s: natural[s] ** (1 - exponent) * goal[s] ** exponent for s in goal}
    whole = sum(raised.values())
    return {s: p / whole for s, p in raised.items()}


def tempered_to_targets(
    sizes: dict[str, float],
    targets: dict[str, float],
    caps: dict[str, float | None],
    total: float | str = "corpus",
    exponent: float = 1.0,
) -> dict[str, tuple[float, float]]:
    """``source -> (exponent, tokens)`` for one scenario; see the module's docstring.

    Only sources with a positive target and some documents take part; targets
    are scaled to 1 among them.  A null cap is no limit.  ``exponent`` is the
    highest allowed.  A total beyond what all limits permit shrinks to it.
    """
    there = {s: t for s, t in targets.items() if t and t > 0 and sizes.get(s, 0) > 0}
    if not there:
        return {}
    goal = {s: t / sum(there.values()) for s, t in there.items()}
    limit = {s: math.inf if caps.get(s) is None else max(0.0, caps[s]) * sizes[s] for s in there}
    corpus = float(sum(sizes[s] for s in there))
    natural = {s: sizes[s] / corpus for s in there}
    if total == "exact":
        least = min(limit[s] / goal[s] for s in there)
        left = corpus if math.isinf(least) else least
    else:
        left = min(corpus if total == "corpus" else float(total), sum(limit.values()))
    out: dict[str, tuple[float, float]] = {}
    while goal:
        shares = path(natural, goal, exponent)
        over = [s for s in goal if shares[s] * left > limit[s] * (1 + 1e-9)]
        if not over:
            return out | {s: (exponent, p * left) for s, p in shares.items()}
        for s in over:
            at = bisect(lambda a, s=s: path(natural, goal, a)[s] * left <= limit[s], 0.0, exponent)
            out[s] = (at, min(limit[s], path(natural, goal, at)[s] * left))
        left -= sum(out[s][1] for s in over)
        goal = {s: g for s, g in goal.items() if s not in out}
    return out


@dataclass
class Plan:
    """The budgets of all scenarios, and what becomes of them."""

    documents: DataFrame
    budgets: DataFrame
    seed: int

    def selection(self) -> DataFrame:
        """``scenario, doc_id, source, tokens, copies``: the mixture, a row per
        document of a scenario with how often it is taken (at least once)."""
        place = F.xxhash64(F.lit(self.seed), "doc_id")
        docs = self.documents.select(
            "doc_id", "source", "tokens", place.alias("place"),
            F.pmod(F.shiftrightunsigned(place, 20), F.lit(RANGES)).cast("int").alias("range"),
        )
        # Whole repetitions, and the tokens wanted from the last, partial one.
        wanted = self.budgets.where("budget > 0").select(
            "scenario", "source",
            F.floor(F.col("budget") / F.col("available")).cast("int").alias("whole"),
            (F.col("budget") % F.col("available")).alias("rest"),
        )
        ranges = docs.groupBy("source", "range").agg(F.sum("tokens").alias("tokens"))
        before = F.sum("tokens").over(
            Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        )
        # At most RANGES rows per source.
        ranges = ranges.select("source", "range", "tokens", F.coalesce(before, F.lit(0)).alias("before"))
        cuts = (
            ranges.join(session.broadcast_small(wanted), "source")
            .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("tokens")))
            .select("scenario", "source", F.col("range").alias("cut"), (F.col("rest") - F.col("before")).alias("left"))
        )
        plans = wanted.join(cuts, ["scenario", "source"], "left").select(
            "scenario", "source", "whole", F.coalesce("cut", F.lit(-1)).alias("cut"), "left"
        )
        taken = docs.join(session.broadcast_small(plans), "source")
        inside = taken.where("range = cut")
        running = F.sum("tokens").over(
            Window.partitionBy("scenario", "source").orderBy("place", "doc_id")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        # The document at the budget is taken if that comes nearer to it.
        near = inside.withColumn("run", F.coalesce(running, F.lit(0))).withColumn(
            "extra", (F.col("run") + F.col("tokens") / 2 <= F.col("left")).cast("int")
        )
        sure = taken.where("range <> cut").withColumn("extra", (F.col("range") < F.col("cut")).cast("int"))
        columns = ["scenario", "doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies")]
        return sure.select(*columns).unionByName(near.select(*columns)).where("copies > 0")

    def report(self) -> DataFrame:
        """A row per scenario and source: targets, limits and actual shares."""
        real = self.selection().groupBy("scenario", "source").agg(
            F.sum(F.col("tokens") * F.col("copies")).alias("got"),
            F.max("copies").cast("bigint").alias("most_copies"),
            F.count("*").alias("documents"),
        )
        whole = Window.partitionBy("scenario")
        return (
            self.budgets.join(real, ["scenario", "source"], "left")
            .withColumn("tokens", F.coalesce("got", F.lit(0)))
            .withColumn("all", F.sum("tokens").over(whole))
            .select(
                "scenario", "source", "target_share", "max_repeats", "available",
                F.round("exponent", 6).alias("exponent"),
                "tokens",
                F.when(F.col("all") > 0, F.round(F.col("tokens") / F.col("all"), 6)).otherwise(0.0).alias("actual_share"),
                F.when(F.col("available") > 0, F.round(F.col("tokens") / F.col("available"), 6)).otherwise(0.0).alias("repeats"),
                F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
                F.coalesce("documents", F.lit(0)).alias("documents"),
            )
        )


_BUDGETS = (
    "scenario string, source string, target_share double, max_repeats double, available bigint,"
    " exponent double, budget double"
)


def _sizes(documents: DataFrame, named: list[str] | None = None) -> dict[str, int]:
    kept = documents if named is None else documents.where(F.col("source").isin(named))
    return {r["source"]: r["n"] for r in kept.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}


def plan(documents: DataFrame, targets: DataFrame, total: float | str = "corpus", seed: int = 17) -> Plan:
    """Budgets in tokens per scenario and source, tempered to the targets.

    ``documents`` as ``sized`` gives them, ``targets`` has ``scenario, source,
    target_share, max_repeats``.  Shares need not add up to 1; a null
    ``max_repeats`` is no limit; null or non-positive shares take no part; a
    source without documents is reported with nothing.  Of several rows for one
    scenario and source the greatest share and limit count.  Only one row per
    scenario and source, and one per source, reaches the driver.
    """
    spark = documents.sparkSession
    kept = session.scratch(documents, "document-sizes")
    wanted = (
        targets.where("scenario is not null and source is not null")
        .groupBy("scenario", source_name(F.col("source")).alias("source"))
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        .collect()
    )
    sizes = _sizes(kept, [r["source"] for r in wanted])
    rows = []
    for scenario in sorted({r["scenario"] for r in wanted}):
        mine = [r for r in wanted if r["scenario"] == scenario]
        found = tempered_to_targets(
            sizes, {r["source"]: r["target_share"] for r in mine},
            {r["source"]: r["max_repeats"] for r in mine}, total,
        )
        for r in mine:
            exponent, tokens = found.get(r["source"], (0.0, 0.0))
            rows.append((
                scenario, r["source"], r["target_share"], r["max_repeats"],
                int(sizes.get(r["source"], 0)), float(exponent), float(tokens),
            ))
    return Plan(kept, spark.createDataFrame(rows, _BUDGETS), seed)


def tempered_plan(
    documents: DataFrame, evenness: float | None = None, max_repeats: float | None = None, seed: int = 17
) -> Plan:
    """A mixture of all sources without targets, as large as the corpus.

    The exponent of the shares is bisected from 1 (as they are) towards 0 (even)
    up to an entropy of ``evenness`` times the greatest possible one, or until a
    source would be taken more than ``max_repeats`` times.  The weights appear
    as ``target_share``.  One row per source reaches the driver.
    """
    kept = session.scratch(documents, "document-sizes")
    sizes = {s: n for s, n in _sizes(kept).items() if n > 0}
    rows = []
    if sizes:
        goal = None if evenness is None else max(
            entropy(tempered(sizes, 1.0)), evenness * math.log(len(sizes))
        )
        exponent, shares = temperature(sizes, goal, max_repeats)
        whole = sum(sizes.values())
        rows = [("tempered", s, p, max_repeats, int(sizes[s]), exponent, p * whole) for s, p in sorted(shares.items())]
    return Plan(kept, documents.sparkSession.createDataFrame(rows, _BUDGETS), seed)
