"""Queries over small inline tables: one shape per rule, with the rows they must give.

Each query runs an operator on hand-made rows that the driver's tables do not
hold (markup, literals, provider answers, documents of an API); its SQL states
the expected rows, taken from the published rules.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import text as T
from quillspark.kernels import chunker, frontmatter, xml
from quillspark.operators import (
    cache,
    catalog,
    chunk,
    delta,
    dense,
    evaluation,
    fusion,
    lexical,
    parity,
    readers,
    tracker,
)
from quillspark.plans.queries import query
from quillspark.sources import files
from quillspark.sources.issues import IssueSource


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def told(schema: str, *rows: tuple) -> str:
    """The expected rows as SQL; ``schema`` is like ``"name varchar, n bigint"``."""
    columns = [c.strip().split() for c in schema.split(",")]
    names = ", ".join(f"c{i}" for i in range(len(columns)))
    picked = ", ".join(f"cast(c{i} as {kind}) as {name}" for i, (name, kind) in enumerate(columns))
    lines = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    return f"select {picked} from (values {lines}) t({names})"


def _pages(spark: SparkSession, cases: list[tuple[str, str | None]]) -> DataFrame:
    return spark.createDataFrame([(f"{i:02d}", c) for i, c in enumerate(cases)], "url string, content string")


def _written(spark: SparkSession, *lines: str) -> str:
    """A folder of the shared area with one file of these lines."""
    path = session.new_path(spark, "fixture")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


# --- Readers ---------------------------------------------------------------------

_HTML = [
    ("<h1>One</h1><h3>Three</h3>", "# One\n\n### Three"),
    ("<p>b <strong>c</strong> <em>d</em></p>", "b **c** *d*"),
    ("<p>a<br>b</p><hr><p>c</p>", "a\nb\n\n---\n\nc"),
    ('<a href="/x">go</a><a>stay</a>', "[go](/x)stay"),
    ('<img alt="Pic" src="/i.png"/>', "[Pic](/i.png)"),
    ('<img src="/i.png">', "[image](/i.png)"),
    ("<p>use <code>a`b</code></p>", "use `a\\`b`"),
    ('<pre><code class="language-ts">a\n  b\n\n</code></pre>', "```ts\na\n  b\n```"),
    ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"),
    ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
    ("<ul><li>a<ul><li>b</li></ul></li></ul>", "- a\n\n  - b"),
    ("<nav>n</nav><p>a</p><footer>f</footer><noscript>s</noscript>", "a"),
    ("<body>x<main>m<article>a<header>h</header></article></main></body>", "a"),
    ("<script>if (a < b) { '<p>x</p>' }</script><p>a</p>", "a"),
    ("<p>a &lt; &amp; &#x2014; &#8212; &unknown;</p>", "a < & — — &unknown;"),
    ("<p>a<p>b</p></i></p>c", "a\n\nb\n\nc"),
]


@query(told("url varchar, markdown varchar", *[(f"{i:02d}", m) for i, (_, m) in enumerate(_HTML)]))
def html_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per rule of the HTML renderer."""
    return readers.read_html(_pages(spark, [h for h, _ in _HTML])).select("url", "markdown")


_BODY = "word " * 30
_JS_ONLY = [
    (None, True), ("", True), ("  \n ", True),
    (f"<html><body>{_BODY * 2}</body></html>", True),  # under 512 units
    (f"<html><body>{_BODY * 5}</body></html>", False),
    (f"<html><div>{_BODY * 5}</div></html>", True),  # no body
    (f"<html><head>{' ' * 600}</head><body><div id=root></div></body></html>", True),
    (f"<html><body><script>{_BODY * 5}</script></body></html>", True),
    (f"<html><head>{' ' * 600}</head><body><noscript>{'n' * 180}</noscript>{'t' * 20}</body></html>", True),
    (f"<html><head>{' ' * 600}</head><body><noscript>{'n' * 100}</noscript>{'t' * 100}</body></html>", False),
]


@query(told("url varchar, js_only boolean", *[(f"{i:02d}", x) for i, (_, x) in enumerate(_JS_ONLY)]))
def js_only_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per rule of too little text."""
    return _pages(spark, [h for h, _ in _JS_ONLY]).select("url", T.js_only(F.col("content")).alias("js_only"))


_XML = (
    '<?xml version="1.0"?><!DOCTYPE feed><feed v="1 &lt; 2"><entry n="1"><id>a&amp;b</id></entry>'
    '<!-- note --><entry n="2"><id>c<![CDATA[<&amp;>]]></id><link href="/x"/></entry><other/></feed>'
)
_SELECT = [
    ("/", 1, "feed", None), ("/feed", 1, "feed", None), ("//id", 2, "id", "a&b"), ("/feed/entry[2]/id", 1, "id", "c<&>"),
    ("/feed/*", 3, "entry", None), ("//entry[2]", 1, "entry", None), ("/feed/entry[3]", 0, None, None), ("//none", 0, None, None),
]


@query(told("selector varchar, nodes bigint, name varchar, text varchar, reason varchar", *[
    (s, n or None, name, text, None if n else "fetch_failed") for s, n, name, text in _SELECT
]))
def xml_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selector of each form on one feed."""
    done = None
    for s, *_ in _SELECT:
        text = F.when(F.col("name") == "id", F.col("text"))
        one = readers.read_xml(_pages(spark, [_XML]), s).select(F.lit(s).alias("selector"), "nodes", "name", text.alias("text"), "reason")
        done = one if done is None else done.unionByName(one)
    return done


@query(told(
    "node_id bigint, parent_id bigint, depth bigint, ord bigint, name varchar",
    (0, -1, 0, 0, "feed"), (1, 0, 1, 0, "entry"), (2, 1, 2, 0, "id"), (3, 0, 1, 1, "entry"), (4, 3, 2, 0, "id"), (5, 3, 2, 1, "link"), (6, 0, 1, 2, "other"),
))
def xml_all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the feed in document order; unreadable pages have none."""
    pages = _pages(spark, [_XML, "<a></b>", "<a>", "text", None])
    return readers.xml_nodes(pages).select("node_id", "parent_id", "depth", "ord", "name")


_LITERALS = [
    ("[1, -2.5, 0x1F, 1e3,]", "[1,-2.5,31,1000]", None),
    ("{ a: 'x', \"b\": null, d: true }", '{"a":"x","b":null,"d":true}', None),
    (r"'a\n\x41B\u{1F600}\''", '"a\\nAB\U0001f600\'"', None),
    ("`a\\`b\\$`", '"a`b$"', None),
    ("/* c */ [ // d\n {k: [[]]} ].concat(x)", '[{"k":[[]]}]', None),
    ("foo()", None, 17), ("[...a]", None, 18), ("{[a]: 1}", None, 18), ("`${a}`", None, 18), ("[1 2]", None, 20),
]


@query(told("url varchar, data varchar, reason varchar, position bigint", *[
    (f"{i:02d}", d, None if d else "fetch_failed", at) for i, (_, d, at) in enumerate(_LITERALS)
]))
def js_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exported literal per rule, accepted or rejected at its position."""
    done = readers.read_js(_pages(spark, [f"export const X = {s};" for s, *_ in _LITERALS]), "X")
    return done.select("url", F.to_json("data").alias("data"), "reason", "position")


_FRONT = [
    ('---\ntitle: "A: b"\n# note\nn: -1.5\ne: 1e3\nflag: true\nx:\nn: 2\nno colon\n---\nbody', {"title": "A: b", "n": 2, "e": "1e3", "flag": True, "x": ""}, "body"),
    ("---\r\na: 'q'\r\n---\r\n\r\nrest", {"a": "q"}, "\nrest"),
    ("---\na:b:c\n---\n", {"a": "b:c"}, ""),
    ("no front", {}, "no front"),
    ("---\nopen: 1\n", {}, "---\nopen: 1\n"),
    (None, None, None),
]


@query(told("url varchar, frontmatter varchar, body varchar, reason varchar", *[
    (f"{i:02d}", None if f is None else json.dumps(f), b, "fetch_failed" if f is None else None) for i, (_, f, b) in enumerate(_FRONT)
]))
def frontmatter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One front matter per rule."""
    return readers.read_markdown(_pages(spark, [t for t, *_ in _FRONT])).select("url", "frontmatter", "body", "reason")


@query(told(
    "url varchar, body varchar",
    ("00", "abcd"), ("01", "ab\U0001f600"), ("02", "abc�"), ("03", "ab"), ("04", None),
))
def units_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut after four UTF-16 units, also inside a pair."""
    pages = _pages(spark, ["abcdef", "ab\U0001f600cd", "abc\U0001f600", "ab", None])
    return readers.read_markdown(pages, limit=4).select("url", "body")


def _scanner(text: str) -> float | None:
    if text == "broken":
        raise RuntimeError("down")
    return {"bad": 0.9, "odd": 0.5, "none": None}.get(text, 0.0)


@query(told(
    "url varchar, parry_label varchar, parry_via varchar, reason varchar, warnings varchar, kept bigint, again varchar",
    ("00", "MALICIOUS", "api", "prompt_injection", "", 5, "MALICIOUS"),
    ("01", "SUSPICIOUS", "api", None, "prompt_injection_suspicious", 5, "SUSPICIOUS"),
    ("02", "SAFE", "api", None, "", 5, "SAFE"), ("03", "SAFE", "stub", None, "", 5, "SAFE"), ("04", "SAFE", "stub", None, "", 5, "SAFE"),
    ("05", "MALICIOUS", "api", "prompt_injection", "", 5, "MALICIOUS"),
))
def scan_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a scanner, what of them is kept (failed ones too), and what a
    scanner that finds everything malicious is still asked after that (nothing)."""
    pages = _pages(spark, ["bad", "odd", "fine", "broken", "none", "bad"])
    scanned = readers.scan(pages, "content", _scanner)
    kept = readers.verdict_rows(scanned)
    again = readers.scan(pages, "content", lambda t: 1.0, kept).select("url", F.col("parry_label").alias("again"))
    result = readers.read_markdown(pages, scanner=_scanner)
    return result.join(again, "url").crossJoin(kept.agg(F.count("*").alias("kept"))).select(
        "url", F.coalesce("parry_label", F.lit("MALICIOUS")).alias("parry_label"), "parry_via", "reason",
        F.array_join("warnings", ",").alias("warnings"), "kept", "again",
    )


@query(told("n bigint, score double", (0, 0.7), (1, 0.9), (2, None), (3, None)))
def injection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first score of a label that counts, by case-insensitive name."""
    rows = [
        (0, [("SAFE", 0.3), ("injection", 0.7), ("MALICIOUS", 0.9)]), (1, [("Malicious", 0.9)]), (2, [("SAFE", 1.0)]), (3, []),
    ]
    table = spark.createDataFrame(rows, "n bigint, payload array<struct<label: string, score: double>>")
    return table.select("n", T.injection_score(F.col("payload")).alias("score"))


def _fetcher(url: str, headers: dict[str, str]) -> tuple[int, str]:
    if url == "03":
        raise OSError("no route")
    return {"00": (200, headers["Accept"]), "01": (404, "gone"), "02": (204, "")}[url]


@query(told(
    "url varchar, body varchar, error varchar, reason varchar",
    ("00", "text/markdown, text/plain, */*", None, None), ("01", None, "http_404", "fetch_failed"), ("02", "", None, None),
    ("03", None, "throw_no route", "fetch_failed"),
))
def fetch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched by an injected fetcher and read; failures are failed fetches."""
    got = readers.fetched(_pages(spark, ["", "", "", ""]), _fetcher, "markdown")
    read = readers.read_markdown(got).select("url", "body", "reason")
    return got.join(read, "url").select("url", "body", "error", "reason")


def _adapter(url: str) -> str:
    if url == "02":
        raise RuntimeError("no browser")
    return f"<html><body><p>{_BODY * 5}</p></body></html>"


@query(told("url varchar, fetched_via varchar, blocked boolean", ("00", "fetch", False), ("01", "crawlee", False), ("02", None, True)))
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with too little text go through the renderer; where it fails they stay."""
    pages = _pages(spark, [f"<html><body><p>{_BODY * 5}</p></body></html>", "<div id=root></div>", "<div id=root></div>"])
    return readers.read_html(pages, adapter=_adapter).select("url", "fetched_via", "blocked")


# --- Sources ----------------------------------------------------------------------


def _issue_pages(spark: SparkSession) -> str:
    """Pages of an issue API: slug ``a`` has six of one issue each, ``b`` fails on its second."""
    root = session.new_path(spark, "issue-pages")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    made = spark.sparkContext._jsc.hadoopConfiguration()
    for slug, count in (("a", 6), ("b", 1)):
        for page in range(count):
            body = {"data": {"repository": {"issues": {
                "pageInfo": {"hasNextPage": slug == "b" or page < count - 1}, "nodes": [{"number": page + 1, "title": f"{slug}{page}"}],
            }}}}
            path = hadoop.Path(f"{root}/{slug}/{page}.json")
            with_bytes = path.getFileSystem(made).create(path)
            with_bytes.write(bytearray(json.dumps(body).encode()))
            with_bytes.close()
    return root.removeprefix("file://")


def _issue_source(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(IssueSource)
    reader = spark.read.format("issues").option("root", _issue_pages(spark)).option("slugs", "a,b,missing")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select("slug", F.col("position").cast("bigint").alias("position"), F.get_json_object("node", "$.title").alias("title"))


_FOUR = [("a", 0, "a0"), ("a", 1, "a1"), ("a", 2, "a2"), ("a", 3, "a3"), ("b", 0, "b0")]


@query(told("slug varchar, position bigint, title varchar", *_FOUR))
def issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of an issue API, four at most unless told otherwise."""
    return _issue_source(spark)


@query(told("slug varchar, position bigint, title varchar", *_FOUR, ("a", 4, "a4"), ("a", 5, "a5")))
def issue_pages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a limit of pages, permissive."""
    return _issue_source(spark, pages="all", mode="permissive")


@query(told(
    "path varchar, kind varchar, content varchar",
    ("ok", "ok", "grün"), ("broken lines", "ok", "two lines"), ("other owner", "bad-request", None), ("gone", "not-found", None),
    ("down", "unavailable", None), ("empty", "unavailable", None), ("wrong", "bad-request", None),
))
def file_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-file responses by owner, status and content."""
    code = lambda s: base64.b64encode(s.encode()).decode()
    rows = [
        ("us", "ok", 200, code("grün")), ("us", "broken lines", 200, code("two lines")[:4] + "\n" + code("two lines")[4:]),
        ("them", "other owner", 200, code("x")), ("us", "gone", 404, None), ("us", "down", 500, code("x")), ("us", "empty", 200, ""),
        ("us", "wrong", 400, None),
    ]
    table = spark.createDataFrame(rows, "owner string, path string, status int, content string")
    return files.file_results(table, ["us"]).select("path", "kind", "content")


@query(told("n bigint, utf8 varchar, latin1 varchar", (0, "grün", "grÃ¼n"), (1, "plain", "plain"), (2, None, None)))
def base64_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded content in either character set."""
    rows = [(0, "Z3LD\nvG4="), (1, "cGxhaW4="), (2, None)]
    table = spark.createDataFrame(rows, "n bigint, c string")
    return table.select("n", T.base64_text(F.col("c")).alias("utf8"), T.base64_text(F.col("c"), "ISO-8859-1").alias("latin1"))


_ISSUES = [
    {"number": 2, "title": "two", "repo": "o/r", "plugin": "schema", "status": "Done", "priority": "P0", "wave": "Wave 0", "effort": "S", "assignee": None, "url": "u2"},
    {"number": 1, "title": "one", "repo": "o/r", "plugin": "data-cli", "status": "Todo", "priority": "P2", "wave": "Wave 1", "effort": "M", "assignee": "kim", "url": "u1"},
]


@query(told(
    "generated_at varchar, position bigint, number int, plugin varchar, assignee varchar",
    ("2026-01-02", 0, 2, "schema", None), ("2026-01-02", 1, 1, "data-cli", "kim"),
))
def snapshot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot document on disk, read as issues."""
    path = _written(spark, *json.dumps({"generatedAt": "2026-01-02", "issues": _ISSUES}, indent=1).split("\n"))
    return files.read_snapshot(spark, path).select("generated_at", "position", "number", "plugin", "assignee")


@query(told("generated_at varchar, number int, title varchar, source varchar", ("2026-01-03", 1, "one", "snapshot"), ("2026-01-03", 2, "two", "snapshot")))
def snapshot_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues written as one document and read again, the snapshot behind an empty live table."""
    path = _written(spark, json.dumps({"generatedAt": "x", "issues": _ISSUES}))
    issues = files.read_snapshot(spark, path)
    again = session.new_path(spark, "snapshot")
    tracker.snapshot_document(issues, "2026-01-03").write.text(again)
    shown = tracker.live_or_snapshot(files.read_snapshot(spark, again), issues.limit(0))
    return shown.select("generated_at", "number", "title", "source")


_CONTENT = {
    "adrs": [
        {"number": "0002", "title": "second", "plugin": "p", "status": None, "date": None, "body": "b"},
        {"number": "0001", "title": "first", "plugin": "p", "status": "accepted", "date": "2026-01-01", "body": "b"},
        {"number": "0002", "title": "again", "plugin": "q", "status": None, "date": None, "body": "b"},
    ],
    "changelogs": [
        {"plugin": "p", "version": "1.0.0", "date": "2026-01-01", "body": "x"}, {"plugin": "q", "version": "2.0.0", "date": "2026-02-01", "body": "y"},
        {"plugin": "r", "version": "1.1.0", "date": "2026-01-01", "body": "z"},
    ],
}


@query(told(
    "kind varchar, place bigint, name varchar",
    ("decision", 0, "first"), ("decision", 1, "second"), ("decision", 2, "again"), ("change", 0, "2.0.0"), ("change", 1, "1.0.0"), ("change", 2, "1.1.0"),
    ("by number", 0, "second"),
))
def content_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by number, changes by latest date, both stable, and one decision."""
    adrs, changes = files.read_content(spark, _written(spark, *json.dumps(_CONTENT, indent=1).split("\n")))
    place = F.monotonically_increasing_id()

    def placed(df: DataFrame, kind: str, name: str) -> DataFrame:
        return df.coalesce(1).select(F.lit(kind).alias("kind"), place.alias("place"), F.col(name).alias("name"))

    return (
        placed(tracker.sorted_decisions(adrs), "decision", "title")
        .unionByName(placed(tracker.sorted_changes(changes), "change", "version"))
        .unionByName(placed(tracker.decision(adrs, "0002"), "by number", "title"))
        .unionByName(placed(tracker.decision(adrs, "0009"), "by number", "title"))
    )


@query(told("chunk_id varchar, embedding varchar", ("a", "1.0,-0.5"), ("b", "2.0"), ("b", "3.0")))
def embeddings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written and read; malformed and blank lines are skipped, repeats stay."""
    lines = ['{"chunkId": "a", "embedding": [1.0, -0.5]}', "", "{oops", '{"embedding": [1.0]}', '{"chunkId": "", "embedding": [1.0]}', '{"chunkId": "c"}']
    rows = files.read_embeddings(spark, _written(spark, *lines)).unionByName(
        spark.createDataFrame([("b", [2.0]), ("b", [3.0])], "chunk_id string, embedding array<double>")
    )
    path = session.new_path(spark, "vectors")
    files.write_embeddings(rows, path)
    return files.read_embeddings(spark, path).select("chunk_id", F.array_join("embedding", ",").alias("embedding"))


@query(told("doc_id varchar, text varchar", ("a+(b)/x.md", "# X\n"), ("y.md", "# Y\n")))
def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All markdown files below a root whose name needs escaping, and nothing else."""
    root = session.new_path(spark, "docs").removeprefix("file://") + "/a[1]+b"
    hadoop, made = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in (("a+(b)/x.md", "# X\n"), ("y.md", "# Y\n"), ("z.txt", "no")):
        path = hadoop.Path(f"{root}/{name}")
        stream = path.getFileSystem(made).create(path)
        stream.write(bytearray(text.encode()))
        stream.close()
    return files.markdown_corpus(spark, root)


@query(told("question_id varchar, query varchar, expected varchar", ("q1", "how?", "a|b"), ("q2", "why?", "")))
def questions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation set on disk."""
    document = {"version": 1, "description": "d", "questions": [
        {"id": "q1", "query": "how?", "expectedSubstrings": ["a", "b"]}, {"id": "q2", "query": "why?", "expectedSubstrings": []},
    ]}
    rows = files.read_questions(spark, _written(spark, *json.dumps(document, indent=1).split("\n")))
    return rows.select("question_id", "query", F.array_join("expected", "|").alias("expected"))


@query(told("generated_at varchar, position bigint, number int", ("2026-01-02", 0, 2), ("2026-01-02", 1, 1)))
def api_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of API responses; failed and unreadable ones drop out."""
    bodies = [json.dumps({"generatedAt": "2026-01-02", "issues": _ISSUES}), '{"error": "no token"}', "oops", None]
    table = spark.createDataFrame([(b,) for b in bodies], "body string")
    return files.read_api(table).select("generated_at", "position", "number")


@query(told("name varchar, value varchar", ("built", "1"), ("variable", "from variable"), ("none", None)))
def loaded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table asked for three times is built once; a secret from a variable, and none."""
    import os

    built = []

    def build() -> DataFrame:
        built.append(1)
        return spark.range(3).toDF("n")

    session.forget(spark, "fixture")
    rows = [session.once(spark, "fixture", build).count() for _ in range(3)]
    os.environ["QUILLSPARK_FIXTURE"] = " from variable\n"
    known = (session.secret("/nowhere", "QUILLSPARK_NONE", "QUILLSPARK_FIXTURE"), session.secret(None))
    del os.environ["QUILLSPARK_FIXTURE"]
    values = [str(len(built)) if rows == [3, 3, 3] else "?", *known]
    return spark.createDataFrame(list(zip(("built", "variable", "none"), values)), "name string, value string")


# --- Chunking ----------------------------------------------------------------------

_MASKED = "# A\n```\n# no\n```\n~~~x\n# no\n```\n# no\n~~~\n## B\n\n#### C\n\n## D\n```\n# open"


@query(told(
    "start bigint, path varchar",
    (0, ""), (_MASKED.index("## B"), "# A"), (_MASKED.index("#### C"), "# A > ## B"), (_MASKED.index("## D"), "# A > ## B > #### C"),
    (len(_MASKED), "# A > ## D"),
))
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where headings begin outside fences, and the headings above each."""
    outline = chunker.Outline(chunker.mask_fences(_MASKED))
    rows = [(at, " > ".join(outline.at(at))) for at in [*chunker.heading_offsets(_MASKED), len(_MASKED)]]
    return spark.createDataFrame(rows, "start bigint, path string")


_SECTIONS = "# One\n" + "a" * 30 + "\n# Two\n" + "b" * 30
_CHUNKS = [
    ("sections", _SECTIONS, ["# One\n" + "a" * 30, "# Two\n" + "b" * 30]),
    ("paragraphs", "p" * 30 + "\n\n" + "q" * 30, ["p" * 30, "q" * 30]),
    ("sentences", "One is here. Two is here. Three is here. Four is here.", ["One is here. Two is here.", "Three is here. Four is here."]),
    ("nothing to cut at", "x" * 50, ["x" * 40, "x" * 10]),
    ("short", "tiny", ["tiny"]), ("blank", " \n ", [""]), ("empty", "", [""]), ("null", None, [""]),
]


@query(told("doc_id varchar, ordinal bigint, text varchar, token_count bigint", *[
    (k, i, t, -(-len(t) // 4)) for k, _, parts in _CHUNKS for i, t in enumerate(parts)
]))
def chunk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per boundary rule, in chunks of ten tokens without overlap."""
    table = spark.createDataFrame([(k, t) for k, t, _ in _CHUNKS], "doc_id string, text string")
    return chunk.chunk(table, size=10, overlap=0).select("doc_id", "ordinal", "text", "token_count")


_STALLED = [(0, 16), *[(s, 16) for s in range(8, 14)], (14, 38), (30, 54), (46, 56)]


@query(told("ordinal bigint, start bigint, stop bigint", *[(i, a, b) for i, (a, b) in enumerate(_STALLED)]))
def chunk_stall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stall of the published rules: a paragraph break nearer than the overlap is
    the end of every chunk until their starts have crept past it."""
    text = "a" * 14 + "\n\n" + "b" * 40
    table = spark.createDataFrame([("d", text)], "doc_id string, text string")
    return chunk.chunk(table, size=6, overlap=2, mode="compat").select("ordinal", "start", F.col("end").alias("stop"))


@query(told("doc_id varchar, texts varchar, chars bigint", ("a", "a0|a1|a2", 12), ("b", "b0", 4)))
def chunks_regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks back by document in their order, and characters for tokens."""
    rows = [("a", 2, "a2"), ("b", 0, "b0"), ("a", 0, "a0"), ("a", 1, "a1")]
    table = spark.createDataFrame(rows, "doc_id string, ordinal bigint, text string")
    grouped = chunk.regrouped(table)
    return grouped.select("doc_id", F.array_join("texts", "|").alias("texts"), T.tokens_to_chars(F.size("texts")).cast("bigint").alias("chars"))


# --- Providers and the pipeline -------------------------------------------------------


def _context(document: str, text: str) -> str | None:
    if text == "refused":
        raise fusion.HttpError(529)
    if text == "broken":
        raise RuntimeError("boom")
    return {"blank": "  "}.get(text, f" about {document[:4]} ")


@query(told(
    "chunk_id varchar, indexed varchar, status varchar, reason varchar",
    ("0", "about Docu\n\nfine", "ok", None), ("1", "refused", "failed", "http_529"), ("2", "broken", "failed", "throw_boom"),
    ("3", "blank", "failed", "empty_response"), ("4", "about\n\nfine", "ok", None), ("none", "fine", "failed", "missing_api_key"),
))
def contextualized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preambles by a provider that answers, refuses, breaks or says nothing; a chunk
    without a parent document; and no provider at all."""
    rows = [("0", "d", 0, "fine"), ("1", "d", 1, "refused"), ("2", "d", 2, "broken"), ("3", "d", 3, "blank"), ("4", "gone", 0, "fine")]
    schema = "chunk_id string, doc_id string, ordinal bigint, text string"
    documents = spark.createDataFrame([("d", "Document text")], "doc_id string, text string")
    done = fusion.contextualize(spark.createDataFrame(rows, schema), documents, _context)
    bare = fusion.contextualize(spark.createDataFrame([("none", "d", 0, "fine")], schema), documents)
    text = F.rtrim(fusion.contextual_text(F.col("context_preamble"), F.col("text")))
    return done.unionByName(bare).select(
        "chunk_id", text.alias("indexed"), F.col("context_status").alias("status"), F.col("context_failure_reason").alias("reason")
    )


@query(told(
    "model varchar, max_tokens int, block varchar, cached boolean",
    ("m", 200, "<document>\nD\n</document>\n\nHere is the chunk we want to situate within the whole document\n<chunk>\n", True),
    ("m", 200, "C\n</chunk>\n\nPlease give a short succinct context to situate this chunk within the overall document for the purposes of improving search retrieval of the chunk. Answer only with the succinct context and nothing else.", False),
))
def context_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request for a preamble: the document's block can be cached."""
    table = spark.createDataFrame([("D", "C")], "d string, c string")
    made = table.select(fusion.context_request(F.col("d"), F.col("c"), "m").alias("r"))
    return made.select("r.model", "r.max_tokens", F.explode("r.content").alias("b")).select(
        "model", "max_tokens", F.col("b.text").alias("block"), F.col("b.cached").alias("cached")
    )


@query(told("n bigint, text varchar", (0, "one two"), (1, None), (2, None)))
def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of an answer, joined and trimmed."""
    rows = [(0, [("text", " one "), ("image", "x"), ("text", "two ")]), (1, [("text", "  ")]), (2, [])]
    table = spark.createDataFrame(rows, "n bigint, blocks array<struct<type: string, text: string>>")
    return table.select("n", T.joined_blocks(F.col("blocks")).alias("text"))


def _embedder(texts: list[str]) -> list:
    if "down" in texts:
        raise RuntimeError("down")
    words = ("alpha", "beta", "gamma")
    return [[] if t == "empty" else None if t == "odd" else [float(t.split().count(w)) for w in words] for t in texts]


@query(told(
    "text varchar, embedding varchar, dense_covered boolean, chunks bigint, embedded bigint",
    ("alpha beta", "1.0,1.0,0.0", True, 5, 2), ("gamma", "0.0,0.0,1.0", True, 5, 2), ("empty", None, False, 5, 2),
    ("odd", None, False, 5, 2), ("down", None, False, 5, 2),
))
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of an embedder one text at a time, the covered flag, and how many got one."""
    table = spark.createDataFrame([(t,) for t in ("alpha beta", "gamma", "empty", "odd", "down")], "text string")
    done = dense.embedded(table, "text", _embedder, batch=1)
    return done.crossJoin(dense.covered(done)).select(
        "text", F.array_join("embedding", ",").alias("embedding"), "dense_covered", "chunks", "embedded"
    )


@query(told(
    "query_id bigint, doc_id varchar, final_rank bigint, dense boolean, lexical boolean",
    (1, "a", 0, True, True), (1, "c", 1, True, False), (2, "b", 0, False, True),
))
def retrieval_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chunked, embedded and indexed, and two questions asked: one that the
    embedder answers, one that only the lexical index does."""
    documents = spark.createDataFrame(
        [("a", "alpha"), ("b", "delta epsilon"), ("c", "gamma alpha alpha alpha gamma gamma gamma zeta")], "doc_id string, text string"
    )
    chunks, index, vectors = fusion.index_documents(documents, embedder=_embedder)
    vectors = vectors.where(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x) > 0)
    queries = spark.createDataFrame([(1, "alpha"), (2, "odd delta")], "query_id bigint, query string")
    only = queries.withColumn("query", F.when(F.col("query_id") == 1, "alpha").otherwise("delta"))
    lexically = lexical.remove(index, chunks.where("doc_id = 'c'").select("chunk_id"))
    found = fusion.ask(only, chunks, lexically, vectors, lambda ts: [None if t == "delta" else v for t, v in zip(ts, _embedder(ts))])
    return found.join(chunks.select("chunk_id", "doc_id"), "chunk_id").select(
        "query_id", "doc_id", "final_rank", F.col("dense_rank").isNotNull().alias("dense"), F.col("lexical_rank").isNotNull().alias("lexical")
    )


@query(told(
    "line varchar, passed boolean, unanswered varchar",
    ("tier1: 2/4 matched, failure rate 50.0%, target 6.5% (failed)", False, "q3,q4"),
))
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tier's report, and the questions that no tier answered."""
    tier1 = spark.createDataFrame([("q1", True), ("q2", True), ("q3", False), ("q4", False)], "question_id string, matched boolean")
    missed = evaluation.unanswered(evaluation.caught_at(tier1)).agg(
        F.array_join(F.array_sort(F.collect_list("question_id")), ",").alias("unanswered")
    )
    return evaluation.report(tier1, 0.065, "tier1").crossJoin(missed)


# --- Tracker ------------------------------------------------------------------------

_TRACKER = """# Matrix
| `early` | x | **ported** |
### alpha → alpha-cli
| `one` | note | **ported** |
| `two` | note | **TBD** |
| `odd` | note | **unheard** |
### beta → beta-cli
| `one` | note | **divergent** |
| `three` | n | **tbd** |
| `three` | n | **ported** |
"""
_SPECS = [
    ("alpha", "one", "Deviations from upstream:\nNone.\n## Next"), ("beta", "one", "text\nDeviations from upstream\nUses other flags.\n---"),
    ("beta", "three", "no section"),
]


@query(told(
    "plugin varchar, skill varchar, declared varchar, derived varchar, drifts boolean, skills bigint",
    ("alpha", "one", "ported", "ported", False, 2), ("alpha", "two", "tbd", "tbd", False, 1), ("beta", "one", "divergent", "divergent", False, 1),
    ("beta", "three", "ported", "ported", False, 2),
))
def parity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared status of a tracker table, derived status of spec files, and counts."""
    declared = parity.tracker_rows(spark.createDataFrame([(1, _TRACKER)], "tracker_id bigint, text string"))
    derived = parity.derived_status(declared, spark.createDataFrame(_SPECS, "plugin string, skill string, text string"))
    off = parity.drift(declared, derived).select("plugin", "skill", F.lit(True).alias("off"))
    return (
        declared.join(derived, ["plugin", "skill"]).join(off, ["plugin", "skill"], "left").join(parity.counts(derived), "derived")
        .select("plugin", "skill", "declared", "derived", F.coalesce("off", F.lit(False)).alias("drifts"), "skills")
    )


@query(told(
    "plugin varchar, skill varchar, declared varchar, derived varchar",
    ("alpha", "one", "ported", "tbd"), ("beta", "three", "ported", "divergent"),
))
def parity_file_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills whose tracker row and spec file disagree; a declared divergence without a file is allowed."""
    declared = parity.tracker_rows(spark.createDataFrame([(1, _TRACKER)], "tracker_id bigint, text string"))
    specs = [("beta", "three", "Deviations from upstream:\n- one\n")]
    derived = parity.derived_status(declared, spark.createDataFrame(specs, "plugin string, skill string, text string"))
    return parity.drift(declared, derived).select("plugin", "skill", "declared", "derived")


def _node(number: int, state: str = "OPEN", labels: tuple[str, ...] = (), status: str | None = None, login: str | None = None) -> tuple:
    item = ((status,) if status else None, None, ("Wave 0",), None)
    return (
        number, f"t{number}", state, f"u{number}", ([(login,)] if login else [],), ([(x,) for x in labels],), ([item] if status else [],),
    )


@query(told(
    "repo varchar, number int, slug varchar, plugin varchar, status varchar, wave varchar, assignee varchar",
    ("o/kw", 1, "data-cli", "data-cli", "In Progress", "Wave 0", "kim"), ("o/kw", 2, "kw", "meta-repo", "Done", "Wave 1", None),
    ("o/org", 1, "org", "meta-repo", "Todo", "Wave 1", None),
))
def slug_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of several slugs through the project map: unknown slugs and issues without
    the slug's label drop out, and a copy under an earlier slug wins."""
    projects = tracker.project_map(spark, [
        ("data-cli", "o/kw", "data-cli", "area/data-cli"), ("kw", "o/kw", "meta-repo", None), ("org", "o/org", "meta-repo", None),
    ])
    one = _node(1, labels=("x", "area/data-cli"), status="In Progress", login="kim")
    rows = [
        ("data-cli", 0, *one), ("data-cli", 1, *_node(2, "CLOSED")), ("kw", 0, *_node(2, "CLOSED", status="Unheard of")[:6], ([],)), ("kw", 1, *one),
        ("org", 0, *_node(1)), ("nobody", 0, *_node(9)),
    ]
    nodes = spark.createDataFrame(rows, f"slug string, position int, {tracker.NODE}")
    found = tracker.merged(tracker.of_slugs(nodes, projects))
    return found.select("repo", "number", "slug", "plugin", "status", "wave", "assignee")


@query(told(
    "step varchar, plugin varchar, total bigint",
    ("tiles", "schema", 1), ("tiles", "data-cli", 1), ("tiles", "it-admin", 0), ("picked", "schema", 1), ("all", "data-cli", 1), ("all", "schema", 1),
    ("known", "schema", 1),
))
def plugin_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry tiles with counts, a selection of plugins, an empty one, and the guard of known plugins."""
    issues = spark.createDataFrame([("schema",), ("data-cli",)], "plugin string")
    counts = issues.groupBy("plugin").agg(F.count("*").alias("total"))
    registry = spark.createDataFrame([("schema", "s"), ("data-cli", "d"), ("it-admin", "i")], "plugin string, summary string")
    step = lambda df, name: df.select(F.lit(name).alias("step"), "plugin", "total")
    known = spark.createDataFrame([("schema",), ("nobody",)], "plugin string").join(registry, "plugin", "left_semi")
    return (
        step(tracker.with_registry(registry, counts), "tiles")
        .unionByName(step(tracker.of_plugins(counts, ["schema"]), "picked"))
        .unionByName(step(tracker.of_plugins(counts, []), "all"))
        .unionByName(step(counts.join(known, "plugin", "left_semi"), "known"))
    )


@query(told(
    "view varchar, place bigint, name varchar",
    ("board", 0, "2"), ("board", 1, "3"), ("board", 2, "1"), ("board", 3, "4"), ("roadmap", 0, "Wave 0 3/2"), ("roadmap", 1, "Wave 1 1/1"),
    ("roadmap", 2, "Wave 2 0/0"), ("roadmap", 3, "Future 0/0"),
))
def project_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board by status, priority and effort, and the roadmap by wave."""
    rows = [("r", 1, "In Progress", "P0", "Wave 0", "S"), ("r", 2, "Todo", "P0", "Wave 0", "L"), ("r", 3, "Todo", "P2", "Wave 1", "XS"), ("r", 4, "Done", "P0", "Wave 0", "XS")]
    issues = spark.createDataFrame(rows, "repo string, number int, status string, priority string, wave string, effort string")
    place = F.monotonically_increasing_id().alias("place")
    board = issues.orderBy(*tracker.board_order(issues)).coalesce(1).select(F.lit("board").alias("view"), place, F.col("number").cast("string").alias("name"))
    road = tracker.roadmap(issues).coalesce(1).select(F.lit("roadmap").alias("view"), place, F.format_string("%s %d/%d", "wave", "issues", "open").alias("name"))
    return board.unionByName(road)


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 30")
def newest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 30 events of every user, as snapshots of a source."""
    events = session.load(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return tracker.newest(events, "user_id", "at").select("user_id", "event_id")


_RUNS = """
with runs as (
  select event_type as kind, event_id, user_id % 2 = 0 as failed from events
),
islands as (
  select *, sum(case when failed then 0 else 1 end) over (partition by kind order by event_id rows unbounded preceding) as island from runs
),
counted as (
  select *, sum(case when failed then 1 else 0 end) over (partition by kind, island order by event_id rows unbounded preceding) as run from islands
)
select kind, event_id from counted where run = 3 and failed
"""


@query(_RUNS)
def third_failure_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third failures in a row of few keys with many rows each, cut into stretches."""
    events = session.load(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"), "event_id", (F.col("user_id") % 2 == 0).alias("failed")
    )
    return tracker.consecutive_failures(events, "kind", "event_id", "failed", span=100).select("kind", "event_id")


# --- Deltas and catalogues ------------------------------------------------------------


@query(told(
    "url varchar, change_kind varchar, was varchar",
    ("b", "changed", None), ("d2", "renamed", "d"), ("e", "removed", None), ("f", "added", None), ("g", "added", None), ("h", "removed", None),
))
def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a source added, removed, changed, or moved with their content."""
    schema = "url string, sha string"
    prior = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4"), ("e", "5"), ("h", None), (None, "9")], schema)
    current = spark.createDataFrame([("a", "1"), ("b", "3"), ("d2", "4"), ("f", "6"), ("g", None)], schema)
    return delta.source_delta(prior, current)


@query(told(
    "id bigint, change_kind varchar, old_name varchar, new_name varchar",
    (2, "removed", "two", None), (3, "renamed", "three", "drei"), (4, "reorganised", "four", "four"), (5, "renamed", "five", "fuenf"),
    (5, "reorganised", "five", "fuenf"), (6, "added", None, "six"),
))
def record_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records added, removed, renamed, reorganised, and both at once."""
    schema = "id bigint, title string, departments array<string>, offices array<string>"
    prior = spark.createDataFrame([(1, "one", ["x"], []), (2, "two", [], []), (3, "three", [], []), (4, "four", ["x"], ["y"]), (5, "five", [], [])], schema)
    current = spark.createDataFrame([(1, "one", ["x"], []), (3, "drei", [], []), (4, "four", ["z"], ["y"]), (5, "fuenf", [], ["y"]), (6, "six", [], [])], schema)
    return delta.record_delta(prior, current, "id", "title", ["departments", "offices"])


@query("""
with last as (
  select lower(trim(repo)) as repo, issue_number as number, snapshot_no, arg_max(title, delivered_at) as title
  from (select *, row_number() over (partition by snapshot_no, lower(trim(repo)), issue_number order by delivered_at desc nulls last, title desc nulls last) as r
    from project_snapshots where issue_number is not null) where r = 1 group by all
),
old as (select * from last where snapshot_no = 1), new as (select * from last where snapshot_no = 2)
select coalesce(o.repo, n.repo) as repo, coalesce(o.number, n.number) as number,
  case when o.repo is null then 'added' when n.repo is null then 'removed' else 'renamed' end as change_kind,
  o.title as old_name, n.title as new_name
from old o full join new n on o.repo = n.repo and o.number = n.number
where o.repo is null or n.repo is null or o.title is distinct from n.title
""")
def issue_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues added, removed or renamed between the first two snapshots."""
    from quillspark.operators import snapshot_diff

    rows = session.load(spark, sf_dir, "project_snapshots").withColumn("repo", F.lower(F.trim("repo"))).where("issue_number is not null")
    last = snapshot_diff.latest_rows(rows, ["snapshot_no", "repo", "issue_number"], "delivered_at", ["title"])
    side = lambda n: last.where(F.col("snapshot_no") == n).select(F.struct("repo", F.col("issue_number").alias("number")).alias("key"), "title")
    done = delta.record_delta(side(1), side(2), "key", "title", [])
    return done.select("key.repo", "key.number", "change_kind", "old_name", "new_name")


@query(told("asked varchar, term varchar", ("Oauth-Token", "OAUTH_TOKEN"), ("oauth tokn", "OAUTH_TOKEN"), ("rerankr", "reranker"), ("chunkers", "chunker")))
def canonical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked names and the known term each means, by spelling or few edits."""
    asked = spark.createDataFrame([(x,) for x in ("Oauth-Token", "oauth tokn", "rerankr", "chunkers", "nothing like it", "", None)], "name string")
    terms = spark.createDataFrame([(x,) for x in ("OAUTH_TOKEN", "reranker", "chunker", None)], "term string")
    return catalog.canonical_names(asked, terms)


@query(told("task varchar, tool varchar, score double", ("explore", "graph", 0.45), ("fetch", "a", 1.0)))
def tool_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool of least weighted cost per task."""
    rows = [("explore", "graph", 0.3, 2.0, 50.0), ("explore", "rest", 1.2, 1.0, 20.0), ("fetch", "b", 1.0, None, None), ("fetch", "a", 1.0, 0.0, 0.0)]
    tools = spark.createDataFrame(rows, "task string, tool string, tokens_per_byte double, latency_seconds double, memory_mb double")
    return catalog.cheapest_tool(tools).withColumn("score", F.round("score", 6))


_INDEX_PAGE = """# Docs
- [Top](https://x.example/top.md)
### Build
- [Skills](https://x.example/agents/skills/a.md): text
- [Tools](https://x.example/agents/b.md)
### API Reference
- [Call](https://x.example/api/c.md)
not - [a](link)
"""


@query(told(
    "position bigint, section varchar, title varchar, posture varchar, category varchar, fetched boolean",
    (1, None, "Top", "eager", None, None), (3, "Build", "Skills", "eager", "Skills", None), (6, "API Reference", "Call", "lazy", None, False),
))
def index_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of an index page by section, posture and category, without those that a
    canonical source covers, and what of the lazy ones a capped run fetches."""
    pages = spark.createDataFrame([("llms", _INDEX_PAGE)], "doc_id string, text string")
    links = catalog.section_links(pages, ["API Reference"])
    prefixes = spark.createDataFrame([("agents/", "Agents"), ("agents/skills/", "Skills")], "prefix string, category string")
    covered = spark.createDataFrame([("https://x.example/agents/b.md",)], "url string")
    kept = catalog.without_canonical(catalog.categorised(links, prefixes), covered)
    hits = spark.createDataFrame([(1, "https://x.example/api/a.md", 1), (1, "https://x.example/api/c.md", 2), (1, "https://x.example/api/c.md", 4)], "run bigint, url string, rank bigint")
    runs = catalog.lazy_fetches(hits, cap=1).select("url", "fetched")
    return kept.join(runs, "url", "left").select("position", "section", "title", "posture", "category", "fetched")


@query(told("what varchar, name varchar, n bigint", ("kind", "skills", 2), ("kind", "hooks", 1), ("kind", "agents", 0), ("repeated", "a", 2)))
def manifest_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of a manifest by kind, empty kinds included, and ids that are not unique."""
    kinds = ["skills", "hooks", "agents"]
    manifest = spark.createDataFrame([([("a",), ("b",)], [("a",)], [])], ", ".join(f"{k} array<struct<id: string>>" for k in kinds))
    flat = catalog.flattened(manifest, kinds)
    return catalog.kind_counts(flat, kinds).select(F.lit("kind").alias("what"), F.col("kind").alias("name"), F.col("resources").alias("n")).unionByName(
        catalog.repeated_ids(flat).select(F.lit("repeated").alias("what"), F.col("id").alias("name"), F.col("copies").alias("n"))
    )


@query(told(
    "ref varchar, kind varchar, stable boolean",
    ("v1.3.1", "tag", True), ("2.0", "tag", True), ("main", "branch", False), ("deadbeef", "sha", False), ("a" * 40, "sha", True), ("feature/x1", "branch", False),
))
def pin_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reference is pinned to, and whether it can move."""
    refs = spark.createDataFrame([(x,) for x in ("v1.3.1", "2.0", "main", "deadbeef", "a" * 40, "feature/x1")], "ref string")
    return refs.select("ref", catalog.pin_kind(F.col("ref")).alias("kind"), catalog.is_stable(F.col("ref")).alias("stable"))


@query("select distinct entry_id from entries where entry_key is null or entry_key not in (select entry_key from warm_keys where entry_key is not null)")
def unread_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a reader has still to fetch: the filter first, the anti join where it may be wrong."""
    warm = session.load(spark, sf_dir, "warm_keys")
    entries = session.load(spark, sf_dir, "entries").select("entry_id", "entry_key")
    made = cache.bloom(warm, "entry_key", 100_000)
    return cache.without_cached(warm, entries, "entry_key", made).select("entry_id").distinct()


@query(told("url varchar, keys varchar", ("00", "title,n"), ("01", "")))
def front_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a front matter in their order, by the parser itself."""
    rows = [(f"{i:02d}", ",".join(frontmatter.split(t)[0])) for i, t in enumerate(["---\ntitle: a\nn: 1\ntitle: b\n---\n", "none"])]
    return spark.createDataFrame(rows, "url string, keys string")


@query(told("reason varchar, n bigint", ("read", 1), ("rejected", 5)))
def xml_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the parser takes and rejects."""
    def readable(text: str) -> str:
        try:
            return "read" if xml.nodes(text) else "rejected"
        except ValueError:
            return "rejected"

    rows = [(readable(t),) for t in ("<a/>", "", "<a>", "<a></b>", "<!-- x", "<a><![CDATA[x</a>")]
    return spark.createDataFrame(rows, "reason string").groupBy("reason").agg(F.count("*").alias("n"))
