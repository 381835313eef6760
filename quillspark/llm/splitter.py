"""Splitting oversized texts at natural boundaries, with overlap.

A recursive hierarchy of separators - section, paragraph, line, sentence, word,
character - cuts a text into units; a unit that does not fit is split by the
next finer separator, and the units are packed greedily into pieces.  Every
piece after the first begins with exactly ``overlap`` characters of the text
before its new part, so dropping that prefix from each piece and joining the
rest restores the text character for character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import session

CHARS_PER_TOKEN = 4

#: Where each level of the hierarchy may cut: at the *end* of every match.
LEVELS: tuple[tuple[str, re.Pattern[str]], ...] = (
    ("section", re.compile(r"\n(?=#{1,6}[ \t])")),
    ("paragraph", re.compile(r"\n(?:[ \t\r]*\n)+")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?…。！？]+[\"'”’)\]]*\s+")),
    ("word", re.compile(r"\s+")),
)


def cut_points(text: str, size: int, overlap: int = 0) -> list[tuple[int, str]]:
    """``(offset, level name)`` of the cuts of a text.

    The first piece has room for ``size`` characters, later ones for ``size -
    overlap``, since they begin with the overlap.  Units of one level are packed
    greedily; a unit that alone exceeds the room is cut by the finer levels, and
    packing goes on from its last cut.
    """
    cuts: list[tuple[int, str]] = []
    start, room = 0, size

    def cut(at: int, name: str) -> None:
        nonlocal start, room
        cuts.append((at, name))
        start, room = at, size - overlap

    def walk(level: int, at: int, end: int) -> None:
        if level == len(LEVELS):
            while end - start > room:
                cut(start + room, "character")
            return
        name, separator = LEVELS[level]
        last = at  # the latest boundary that still fits into the open piece
        for match in separator.finditer(text, at, end):
            boundary = match.end()
            if boundary - start > room:
                reach(last, boundary, level, name)
            last = boundary
        if end > last and end - start > room:
            reach(last, end, level, name)

    def reach(last: int, boundary: int, level: int, name: str) -> None:
        if last > start:
            cut(last, name)
        if boundary - start > room:
            walk(level + 1, start, boundary)

    walk(0, 0, len(text))
    return cuts


def split(text: str, size: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """``(start, new, end, boundary)`` of each piece of a text longer than ``size``.

    The piece is ``text[start:end]`` and its first ``new - start`` characters
    repeat the piece before it; ``boundary`` names the level of the cut at its
    end (``end`` for the last).  Lengths are in code points.  A text within the
    size is one piece.  The overlap is exact for every piece whose predecessors
    hold that many characters.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    pieces, begin = [], 0
    for end, name in [*cut_points(text, size, overlap), (len(text), "end")]:
        pieces.append((max(0, begin - overlap), begin, end, name))
        begin = end
    return pieces


_FINER = ("sentence", "word", "character")


def cut_inside_long_line(text: str, pieces: list[tuple[int, int, int, str]], size: int) -> bool:
    """Whether a cut of these pieces had to fall inside a line that alone exceeds ``size``."""
    low = high = -1  # the line of the last cut inside one
    for _, _, at, boundary in pieces:
        if boundary not in _FINER:
            continue
        if not low < at < high:
            low, high = text.rfind("\n", 0, at), text.find("\n", at)
            high = len(text) if high < 0 else high
        if high - low - 1 > size:
            return True
    return False


SCHEMA = (
    "piece int, pieces int, start int, new_from int, end int, boundary string, "
    "text string, cut string, size int"
)
#: Characters of pieces that are sent on at a time.
_AT_ONCE = 4_000_000


def split_items(items: DataFrame, key: str, text: str, size: str = "size", overlap: str = "overlap") -> DataFrame:
    """The pieces of every item longer than its size.

    ``items`` has a key, a text and per row the limit and the overlap in
    characters (code points, untrimmed).  Items within the limit, null and empty
    texts and null limits give no rows; impossible limits are an error.  The
    operator is narrow (no shuffle): a repeated row repeats its pieces.  Returns the
    key and ``piece`` (from 0), ``pieces``, ``start``, ``new_from``, ``end``
    (offsets into the text; the part before ``new_from`` is overlap),
    ``boundary`` (level of the cut at the end), ``text``, ``size`` and ``cut``:
    ``hard`` if a cut had to fall inside a line that alone exceeds the limit,
    else ``soft``.
    """
    long = (
        items.select(
            F.col(key).alias("__key"), F.col(text).alias("__text"),
            F.col(size).cast("int").alias("__size"), F.col(overlap).cast("int").alias("__overlap"),
        )
        .where(F.length("__text") > F.col("__size"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, overlaps = (batch.column(i).to_pylist() for i in (1, 2, 3))
            rows: list[tuple] = []
            held = 0

            def send(batch=batch) -> pa.RecordBatch:
                at, *columns = zip(*rows)
                kinds = [pa.int32()] * 5 + [pa.string()] * 3 + [pa.int32()]
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at))] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["__key", *(c.split()[0] for c in SCHEMA.split(", "))],
                )

            for at, (body, limit, over) in enumerate(zip(texts, sizes, overlaps)):
                pieces = split(body, limit, over)
                cut = "hard" if cut_inside_long_line(body, pieces, limit) else "soft"
                for number, (begin, new, end, boundary) in enumerate(pieces):
                    rows.append((at, number, len(pieces), begin, new, end, boundary, body[begin:end], cut, limit))
                    held += end - begin
                    # An item's pieces repeat its text: they go on before they add up.
                    if held > _AT_ONCE:
                        yield send()
                        rows, held = [], 0
            if rows:
                yield send()

    kind = items.schema[key].dataType.simpleString()
    return long.mapInArrow(run, f"__key {kind}, {SCHEMA}").withColumnRenamed("__key", key)


def restored(items: DataFrame, key: str, text: str, size: str = "size", overlap: str = "overlap") -> DataFrame:
    """``key, within, overlapping, text_md5``: per split item whether every piece is
    within the limit, whether all overlaps are as asked for, and the hash of the
    text put together again from the pieces (an item's pieces meet in one row)."""
    rows = items.withColumn("__row", F.monotonically_increasing_id())
    carried = rows.select(F.struct("__row", key, overlap).alias("__item"), text, size, overlap)
    pieces = split_items(carried, "__item", text, size, overlap)
    new = F.expr("substring(text, new_from - start + 1)")
    asked = F.least(F.col(f"__item.{overlap}").cast("int"), F.col("new_from"))
    whole = F.array_sort(F.collect_list(F.struct("piece", new.alias("new"))))
    return (
        pieces.groupBy("__item", "pieces")
        .agg(
            F.bool_and((F.length("text") <= F.col("size")) & (F.length("text") > 0)).alias("within"),
            F.bool_and(F.col("new_from") - F.col("start") == asked).alias("overlapping"),
            F.md5(F.array_join(F.transform(whole, lambda p: p["new"]), "")).alias("text_md5"),
        )
        .select(F.col(f"__item.{key}").alias(key), "within", "overlapping", "text_md5")
    )


def with_limits(documents: DataFrame, options: DataFrame) -> DataFrame:
    """Documents with ``size`` and ``overlap`` in characters from their option set.

    A null option set means ``default``; documents of an unknown set are kept
    with the limits of ``default``.
    """
    limits = options.groupBy(F.col("option_set").alias("__set")).agg(
        F.max("chunk_size").alias("__size"), F.max("overlap").alias("__overlap")
    )
    usual = limits.where("__set = 'default'").first()
    size, overlap = (usual["__size"], usual["__overlap"]) if usual else (None, None)
    return (
        session.spread(documents.drop("size", "overlap"))
        .join(session.broadcast_small(limits), F.col("option_set") == F.col("__set"), "left")
        .withColumn("size", F.coalesce("__size", F.lit(size)) * CHARS_PER_TOKEN)
        .withColumn("overlap", F.coalesce("__overlap", F.lit(overlap)) * CHARS_PER_TOKEN)
        .drop("__set", "__size", "__overlap")
    )


def oversized(pieces: DataFrame, key: str) -> DataFrame:
    """The distinct ``key, cut`` of the items that were split."""
    return pieces.select(key, "cut").distinct()
