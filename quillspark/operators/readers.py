"""Content readers: raw markdown, HTML, XML and JavaScript to tagged results.

Every reader is a transform of a table with a key and a content column and
returns one row per page: ``data`` fields, ``blocked``, ``reason``,
``source_sha256``, ``parry_label``, ``parry_score``, ``parry_via`` and
``warnings``.  The injection scan is a provider that sees each distinct text
once; without one every text is safe with score 0 by the stub.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.kernels import frontmatter, html, jslit, xml

SUSPICIOUS = 0.3
MALICIOUS = 0.8
# The reason of a blocked page, and the warning on a suspicious one.
INJECTION = "prompt_injection"
SUSPICION = "prompt_injection_suspicious"

Scanner = Callable[[str], float | None]


def scan(
    pages: DataFrame,
    text: str,
    scanner: Scanner | None = None,
    cache: DataFrame | None = None,
    suspicious: float = SUSPICIOUS,
    malicious: float = MALICIOUS,
) -> DataFrame:
    """``pages`` with ``sha, parry_score, parry_label, parry_via, parry_kept``.

    Verdicts known to ``cache(sha, suspicious, malicious, score, via)`` are taken
    from it; the scanner is called once per distinct text that is left.  A
    scanner that fails or knows nothing gives score 0 by the stub, and that
    verdict is one to keep as well (``parry_kept``), lest a broken scanner be
    asked again and again; texts that nothing was asked about have none to keep.
    """
    hashed = pages.withColumn("sha", F.sha2(F.col(text), 256))
    if scanner is None and cache is None:
        return (
            hashed.withColumn("parry_score", F.lit(0.0))
            .withColumn("parry_label", F.lit("SAFE"))
            .withColumn("parry_via", F.lit("stub"))
            .withColumn("parry_kept", F.lit(False))
        )
    distinct = hashed.groupBy("sha").agg(F.first(text).alias("t"))
    verdicts = None
    if cache is not None:
        via = F.coalesce("via", F.lit("api")) if "via" in cache.columns else F.lit("api")
        known = (
            cache.where((F.col("suspicious") == suspicious) & (F.col("malicious") == malicious))
            .groupBy("sha").agg(F.max(F.struct("score", via.alias("via"))).alias("v"))
            .select("sha", "v.score", "v.via")
        )
        distinct = distinct.join(known.select("sha"), "sha", "left_anti")
        verdicts = known
    if scanner is not None:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def one(t: str) -> float | None:
                try:
                    return scanner(t)
                except Exception:  # noqa: BLE001 - fails open
                    return None

            for batch in batches:
                found = [one(t) for t in batch["t"]]
                yield pd.DataFrame(
                    {
                        "sha": batch["sha"],
                        "score": [0.0 if s is None else float(s) for s in found],
                        "via": ["stub" if s is None else "api" for s in found],
                    }
                )

        fresh = distinct.mapInPandas(run, "sha string, score double, via string")
        verdicts = fresh if verdicts is None else verdicts.unionByName(fresh)
    joined = hashed.join(verdicts, "sha", "left")
    score = F.coalesce("score", F.lit(0.0))
    return (
        joined.withColumn("parry_score", score)
        .withColumn("parry_label", T.classify(score, suspicious, malicious))
        .withColumn("parry_via", F.coalesce("via", F.lit("stub")))
        .withColumn("parry_kept", F.col("via").isNotNull())
        .drop("score", "via")
    )


def verdict_rows(scanned: DataFrame, suspicious: float = SUSPICIOUS, malicious: float = MALICIOUS) -> DataFrame:
    """What a scan adds to the cache: every verdict that was asked for, failed
    ones too."""
    return scanned.where("parry_kept").select(
        "sha", F.lit(suspicious).alias("suspicious"), F.lit(malicious).alias("malicious"),
        F.col("parry_score").alias("score"), F.col("parry_via").alias("via"),
    ).distinct()


def tagged(scanned: DataFrame, failure, data: list) -> DataFrame:
    """The result columns: blocked on failure or a malicious verdict, else the data."""
    malicious = F.col("parry_label") == "MALICIOUS"
    blocked = failure.isNotNull() | malicious
    hidden = [F.when(~blocked, c).alias(name) for name, c in data]
    return scanned.select(
        "url",
        *hidden,
        blocked.alias("blocked"),
        F.when(failure.isNotNull(), failure).when(malicious, INJECTION).alias("reason"),
        F.when(~blocked, F.col("source_sha256")).alias("source_sha256"),
        F.when(failure.isNull(), F.col("parry_score")).alias("parry_score"),
        F.when(failure.isNull(), F.col("parry_label")).alias("parry_label"),
        F.when(failure.isNull(), F.col("parry_via")).alias("parry_via"),
        F.when(~blocked & (F.col("parry_label") == "SUSPICIOUS"), F.array(F.lit(SUSPICION)))
        .otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def limited(text, limit: int | None):
    """The first ``limit`` UTF-16 units; null and 0 mean no limit.

    A pair of units that the limit cuts apart becomes one replacement character.
    """
    if not limit:
        return text
    units = F.encode(text, "UTF-16BE")
    apart = F.hex(F.substring(units, 2 * limit - 1, 1)).rlike("^D[89AB]")
    head = F.decode(F.substring(units, 1, 2 * limit), "UTF-16BE")
    cut = F.concat(F.decode(F.substring(units, 1, 2 * limit - 2), "UTF-16BE"), F.lit("\ufffd"))
    return F.when(T.utf16_length(text) <= limit, text).when(apart, cut).otherwise(head)


def _map_text(function, kind):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else function(t))

    return run


def read_markdown(
    pages: DataFrame, limit: int | None = None, unwrap: bool = False, **scanning
) -> DataFrame:
    """``url, content`` to ``body`` and ``frontmatter`` (JSON text).

    Line ends are normalised, the text is cut, then front matter is split off;
    a null content is a failed fetch.
    """
    content = limited(T.normal_eol(F.col("content")), limit)
    rows = pages.select("url", content.alias("c"))
    body = T.unwrapped(T.front_body(F.col("c"))) if unwrap else T.front_body(F.col("c"))
    to_json = _map_text(frontmatter.as_json, "string")
    rows = rows.withColumn("body", body).withColumn(
        "frontmatter", F.when(F.col("c").startswith("---\n"), to_json("c")).otherwise(
            F.when(F.col("c").isNotNull(), "{}"))
    )
    done = scan(rows, "body", **scanning).withColumn("source_sha256", F.col("sha"))
    failure = F.when(F.col("c").isNull(), "fetch_failed")
    return tagged(done, failure, [("body", F.col("body")), ("frontmatter", F.col("frontmatter"))])


def html_to_markdown(content, limit: int | None = None):
    """A column of ``struct<markdown, truncated, slice_length>``."""

    @F.pandas_udf("markdown string, truncated boolean, slice_length bigint")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [html.to_markdown(p or "", limit) for p in pages],
            columns=["markdown", "truncated", "slice_length"],
        )

    return run(content)


# What each reader accepts.
ACCEPTS = {
    "markdown": "text/markdown, text/plain, */*",
    "html": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "xml": "application/xml, text/xml, application/atom+xml, application/rss+xml, */*",
    "js": "text/javascript, text/plain, text/markdown, */*",
}


def fetched(urls: DataFrame, fetcher: Callable[[str, dict[str, str]], tuple[int, str]], form: str) -> DataFrame:
    """``url, content, error`` of pages asked for with the reader's ``Accept`` header.

    ``fetcher(url, headers)`` returns status and body and runs on the executors;
    a status outside 200 to 299 is ``http_NNN``, an exception ``throw_`` and its
    message, and the content is null then (a failed fetch to every reader).
    """
    headers = {"Accept": ACCEPTS[form]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url in batch["url"]:
                try:
                    status, body = fetcher(url, headers)
                    out.append((url, body, None) if 200 <= status < 300 else (url, None, f"http_{status}"))
                except Exception as error:  # noqa: BLE001 - fails open
                    out.append((url, None, f"throw_{error}" if str(error) else "throw_unknown"))
            yield pd.DataFrame(out, columns=["url", "content", "error"])

    return urls.select("url").mapInPandas(run, "url string, content string, error string")


def dispatch(pages: DataFrame, adapter: Callable[[str], str] | None = None) -> DataFrame:
    """``url, content, via``: pages that hold too little text go to the adapter.

    Without an adapter, and where it fails, the page stays as it was fetched.
    """
    if adapter is None:
        return pages.select("url", "content", F.lit("fetch").alias("via"))
    poor = T.js_only(F.col("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url, content in zip(batch["url"], batch["content"]):
                try:
                    out.append((url, adapter(url), "crawlee"))
                except Exception:  # noqa: BLE001 - fails open
                    out.append((url, content, "fetch"))
            yield pd.DataFrame(out, columns=["url", "content", "via"])

    rendered = pages.where(poor).select("url", "content").mapInPandas(
        run, "url string, content string, via string"
    )
    return pages.where(~poor).select("url", "content", F.lit("fetch").alias("via")).unionByName(rendered)


def read_html(
    pages: DataFrame, limit: int | None = None, adapter: Callable[[str], str] | None = None, **scanning
) -> DataFrame:
    """``url, content`` to ``markdown``, ``truncated``, ``slice_length``, ``fetched_via``.

    A page without any prose counts as a failed fetch.
    """
    rows = dispatch(pages, adapter).withColumn("m", html_to_markdown(F.col("content"), limit))
    rows = rows.select("url", "via", "m.*")
    done = scan(rows, "markdown", **scanning).withColumn("source_sha256", F.col("sha"))
    failure = F.when(F.coalesce("markdown", F.lit("")) == "", "fetch_failed")
    return tagged(
        done, failure,
        [(n, F.col(n)) for n in ("markdown", "truncated", "slice_length")] + [("fetched_via", F.col("via"))],
    )


NODE = (
    "node_id bigint, parent_id bigint, depth bigint, ord bigint, path string, name string,"
    " attrs map<string,string>, text string"
)


def xml_nodes(pages: DataFrame, selector: str | None = None) -> DataFrame:
    """``url`` and the node table of every readable page, or the nodes selected.

    Pages that cannot be parsed, and null ones, have no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, content in zip(batch["url"], batch["content"]):
                try:
                    table = xml.nodes(content or "")
                except ValueError:
                    continue
                found = table if selector is None else xml.select(table, selector)
                rows += [(url, n.node, n.parent, n.depth, n.ord, n.path, n.name, n.attrs, n.text) for n in found]
            yield pd.DataFrame(
                rows, columns=["url", "node_id", "parent_id", "depth", "ord", "path", "name", "attrs", "text"]
            )

    return pages.select("url", "content").mapInPandas(run, f"url string, {NODE}")


def read_xml(pages: DataFrame, selector: str = "/", limit: int | None = None, validate=None, **scanning) -> DataFrame:
    """``url, content`` to the number of selected ``nodes`` and the first one.

    ``validate(name, attrs, text)`` may raise to reject a page.  Unreadable
    pages, empty selections and rejected pages are failed fetches; the scan sees
    the raw text.
    """

    def summary(content: str | None):
        try:
            found = xml.select(xml.nodes(content or ""), selector)
            if found and validate is not None:
                validate(found[0].name, found[0].attrs, found[0].text)
        except Exception:  # noqa: BLE001 - whatever a validator raises
            found = []
        first = found[0] if found else None
        return (len(found), first.name, first.attrs, first.text) if first else (0, None, None, None)

    @F.pandas_udf("nodes bigint, name string, attrs map<string,string>, text string")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([summary(c) for c in contents], columns=["nodes", "name", "attrs", "text"])

    content = limited(T.normal_eol(F.col("content")), limit)
    rows = pages.select("url", content.alias("c")).withColumn("x", run("c")).select("url", "c", "x.*")
    done = scan(rows, "c", **scanning).withColumn("source_sha256", F.col("sha"))
    failure = F.when(F.col("nodes") == 0, "fetch_failed")
    return tagged(done, failure, [(n, F.col(n)) for n in ("nodes", "name", "attrs", "text")])


def read_js(pages: DataFrame, export: str, limit: int | None = None, validate=None) -> DataFrame:
    """``url, content`` to ``data`` (variant) of a named export; not scanned."""

    def value(source: str | None):
        body, error, at = jslit.export_json(source or "", export)
        if error is None and validate is not None:
            try:
                validate(body)
            except Exception as problem:  # noqa: BLE001
                return None, str(problem), None
        return body, error, at

    @F.pandas_udf("json string, error string, position bigint")
    def run(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([value(s) for s in sources], columns=["json", "error", "position"])

    content = limited(T.normal_eol(F.col("content")), limit)
    rows = pages.select("url", content.alias("c")).withColumn("x", run("c")).select("url", "c", "x.*")
    ok = F.col("error").isNull()
    return rows.select(
        "url",
        F.try_parse_json("json").alias("data"),
        F.col("json").alias("data_json"),
        (~ok).alias("blocked"),
        F.when(~ok, "fetch_failed").alias("reason"),
        F.col("error"),
        F.col("position"),
        F.when(ok, F.sha2("c", 256)).alias("source_sha256"),
    )
