"""Column functions on text, vectors and labels; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STATUSES = ["Todo", "In Progress", "In Review", "Done", "Won't do"]
PRIORITIES = ["P0", "P1", "P2", "Stretch"]
WAVES = ["Wave 0", "Wave 1", "Wave 2", "Future"]
EFFORTS = ["XS", "S", "M", "L", "XL"]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, repeats kept."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " ")
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def approx_tokens(text: Column) -> Column:
    """A quarter of the length in units, rounded up."""
    return F.ceil(utf16_length(text) / 4)


def tokens_to_chars(n: Column) -> Column:
    """Characters for a number of approximate tokens."""
    return n * 4


def normal_eol(text: Column) -> Column:
    """All line ends as a newline."""
    return F.regexp_replace(text, "\r\n?", "\n")


def front_block(text: Column) -> Column:
    """The front matter between its fences; empty if there is none."""
    return F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n?", 1)


def front_body(text: Column) -> Column:
    """The text behind the front matter."""
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")


def unwrapped(text: Column) -> Column:
    """The inside of a text that is one fenced block; other texts as they are."""
    # Fixed value: the published pattern.
    pattern = r"(?s)\A```[a-zA-Z0-9_-]*\n(.*?)\n```\s*\z"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def js_only(html: Column) -> Column:
    """Whether a page holds too little text to have been rendered on the server."""
    # Patterns, lengths and the ratio are the published ones.
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    bare = body
    for tag in ("script", "style", "svg"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"[\s\x{00a0}\x{feff}]+", " "))
    inner = F.regexp_extract(body, r"(?is)<noscript[^>]*>(.*?)</noscript>", 1)
    inner = F.trim(F.regexp_replace(inner, "<[^>]+>", ""))
    return (
        html.isNull()
        | html.rlike(r"\A\s*\z")
        | (utf16_length(html) < 512)
        | ~F.lower(html).contains("<body")
        | (F.length(bare) < 100)
        | ((F.length(inner) > 0) & (F.length(inner) / F.length(bare) > 0.8))
    )


def classify(score: Column, suspicious: float = 0.3, malicious: float = 0.8) -> Column:
    """The verdict for an injection score; null counts as 0."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= malicious, "MALICIOUS").when(s >= suspicious, "SUSPICIOUS").otherwise("SAFE")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; 0 for unequal lengths, empty or zero ones."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda e: e * e))) * F.sqrt(total(F.transform(y, lambda e: e * e)))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norm == 0), 0.0).otherwise(dot / norm)


def rrf(rank: Column, k: int = 60) -> Column:
    """The contribution of a rank to reciprocal rank fusion; 0 for a missing rank."""
    bad = F.raise_error(F.lit("a rank is at least 1")).cast("double")
    return F.when(rank.isNull(), 0.0).when(rank < 1, bad).otherwise(1.0 / (k + rank))


def plugin_of(labels: Column, fallback: Column) -> Column:
    """What follows ``area/`` in the first label that has it."""
    found = F.filter(
        F.transform(labels, lambda x: F.regexp_extract(x, r"\Aarea/(.+)\z", 1)), lambda x: x != ""
    )
    return F.coalesce(F.get(found, F.lit(0)), fallback)


def status_of(raw: Column, state: Column) -> Column:
    """A known status, else by state: closed is Done, anything else Todo."""
    return F.when(raw.isin(STATUSES), raw).when(state == "CLOSED", "Done").otherwise("Todo")


def one_of(value: Column, allowed: list[str], fallback: str) -> Column:
    """The value if it is allowed, else the fallback."""
    return F.when(value.isin(allowed), value).otherwise(fallback)


def cross_links(html: Column) -> Column:
    """Links to numbered decision files as routes (the pattern and the route are fixed values)."""
    return F.regexp_replace(html, r'href="\./(\d{4})-[^"]*\.md"', 'href="/adr/$1"')


def base64_text(content: Column, charset: str = "UTF-8") -> Column:
    """Decoded file content; line breaks in the base64 are ignored."""
    return F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), charset)


def injection_score(payload: Column) -> Column:
    """The first score labelled injection or malicious of ``array<struct<label,score>>``."""
    hits = F.filter(payload, lambda p: F.upper(p["label"]).isin("INJECTION", "MALICIOUS"))
    return F.get(hits, F.lit(0))["score"]


def joined_blocks(blocks: Column) -> Column:
    """Text blocks of ``array<struct<type,text>>`` joined and trimmed; null if empty."""
    kept = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    return F.nullif(F.trim(F.array_join(kept, "")), F.lit(""))
