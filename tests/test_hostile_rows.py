"""Nulls, empty tables, repeats, ties and clashing names in the newer operators."""

import random

from pyspark.sql import functions as F

from quillspark import session
from quillspark.operators import cache, catalog, delta, dense, evaluation, fusion, lexical, readers, tracker


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_source_delta(spark):
    schema = "url string, sha string, change_kind string, k string, f string"
    prior = spark.createDataFrame([("a", "1", "x", "y", "z"), ("a", "1", "x", "y", "z"), (None, "2", "", "", ""), ("b", "9", "", "", ""), ("c", "9", "", "", "")], schema)
    current = spark.createDataFrame([("z", "9", "", "", ""), ("a", None, "", "", "")], schema)
    found = rows(delta.source_delta(prior, current))
    # Two pages shared the fingerprint: the first by name is the one that moved.
    assert found == [("a", "changed", None), ("c", "removed", None), ("z", "renamed", "b")]
    assert rows(delta.source_delta(prior.limit(0), current.limit(0))) == []
    assert {r[1] for r in rows(delta.source_delta(prior.limit(0), current))} == {"added"}


def test_record_delta(spark):
    schema = "id bigint, name string, facet string, old string, new string, was string"
    prior = spark.createDataFrame([(1, None, None, "", "", ""), (2, "b", "x", "", "", ""), (None, "n", "", "", "", "")], schema)
    current = spark.createDataFrame([(1, None, None, "", "", ""), (2, None, "x", "", "", ""), (2, None, "x", "", "", "")], schema)
    assert rows(delta.record_delta(prior, current, "id", "name", ["facet"])) == [(2, "renamed", "b", None)]
    assert delta.record_delta(prior.limit(0), prior.limit(0), "id", "name", []).count() == 0


def test_catalogues(spark):
    tools = spark.createDataFrame([("t", "b", None, None, None), ("t", "a", None, None, None)], "task string, tool string, tokens_per_byte double, latency_seconds double, memory_mb double")
    assert rows(catalog.cheapest_tool(tools)) == [("t", "a", 0.0)] and catalog.cheapest_tool(tools.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "### S\r\n- [a](u)\r\n### \r\n- [b](v)"), (3, "- [c](w)")], "doc_id bigint, text string")
    assert {(r["title"], r["section"]) for r in catalog.section_links(pages.where("doc_id < 3 or text like '#%'"), []).collect()} == {("a", "S"), ("b", "S")}
    assert catalog.section_links(pages.limit(0), ["S"]).count() == 0
    hits = spark.createDataFrame([(1, f"u{i}", i) for i in range(60)], "run bigint, url string, rank bigint")
    assert catalog.lazy_fetches(hits).where("fetched").count() == 50 and catalog.lazy_fetches(hits, None).where("fetched").count() == 60
    links = spark.createDataFrame([("https://h/a/b", "old", "p"), ("https://h/a/b", "old", "p"), (None, "", ""), ("https://h/x", "", "")], "url string, __old string, prefix_ string")
    prefixes = spark.createDataFrame([("a/", "A"), ("a/b", "B"), (None, "N")], "prefix string, category string")
    assert [r["category"] for r in catalog.categorised(links, prefixes).orderBy("url").collect()] == [None, "B", "B", None]
    names = spark.createDataFrame([(None,), ("",), ("---",)], "name string")
    terms = spark.createDataFrame([("Term",)], "term string")
    assert catalog.canonical_names(names, terms).count() == 0
    pins = spark.createDataFrame([(None,), (" ",), ("v1.0.0-rc.1",), ("ABCDEF1",)], "r string")
    assert [r[0] for r in pins.select(catalog.pin_kind(F.col("r"))).collect()] == [None, None, "tag", "branch"]


def test_canonical_names_against_brute_force(spark):
    rng = random.Random(3)
    terms = ["".join(rng.choice("abcd") for _ in range(rng.randrange(4, 10))) for _ in range(40)]
    asked = []
    for _ in range(150):
        t = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice(["", "a", "d"])
        asked.append("".join(t) or "a")

    def edits(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    expected = {}
    for a in set(asked):
        best = min((edits(a, t), t) for t in set(terms))
        if best[0] <= 2:
            expected[a] = best[1]
    long = spark.createDataFrame([("x" * 20_000,)], "name string")
    assert catalog.canonical_names(long, spark.createDataFrame([(t,) for t in terms], "term string")).count() == 0
    found = catalog.canonical_names(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert dict(rows(found)) == expected


def test_embedded(spark):
    table = spark.createDataFrame([(None, 1), ("", 2), ("x" * 100_000, 3)], "text string, n int")
    done = dense.embedded(table, "text", lambda ts: [[float(len(t))] for t in ts])
    assert [r["embedding"] for r in done.orderBy("n").collect()] == [[0.0], [0.0], [100_000.0]]
    for broken in (None, lambda ts: None, lambda ts: 1 / 0, lambda ts: [], lambda ts: ["text"] * len(ts)):
        assert dense.embedded(table, "text", broken).where("dense_covered").count() == 0
    assert rows(dense.covered(done.limit(0))) == [(0, 0)]


def test_fetched_and_limits(spark):
    pages = spark.createDataFrame([("a", "old"), ("b", "old"), (None, "old")], "url string, content string")
    got = readers.fetched(pages, lambda url, headers: (500, "x") if url == "a" else (200, headers["Accept"]), "xml")
    assert {r["url"]: r["error"] for r in got.collect()} == {"a": "http_500", "b": None, None: None}
    assert readers.fetched(pages.limit(0), lambda url, headers: (200, ""), "js").count() == 0
    texts = spark.createDataFrame([(None,), ("",), ("\U0001f600",), ("a\U0001f600b",)], "t string")
    assert [r[0] for r in texts.select(readers.limited(F.col("t"), 2)).collect()] == [None, "", "\U0001f600", "a�"]
    assert [r[0] for r in texts.select(readers.limited(F.col("t"), 0)).collect()] == [None, "", "\U0001f600", "a\U0001f600b"]


def test_keys_are_taken_once(spark):
    docs = spark.createDataFrame([(1, "b b"), (1, "b b"), (1, "a"), (None, "x"), (2, None), (3, "")], "chunk_id bigint, text string")
    index = lexical.build(docs)
    assert index.docs.count() == 3 and index.docs.where("chunk_id = 1").count() == 1
    assert index.postings.groupBy("chunk_id").count().collect()[0]["chunk_id"] == 1
    kept = lexical.one_per_key(docs, "chunk_id", "text").where("chunk_id = 1").first()["text"]
    assert rows(index.postings) == ([(1, "a", 1)] if kept == "a" else [(1, "b", 2)])
    assert lexical.build(docs.limit(0)).stats().first()["doc_count"] == 0
    assert lexical.lookup(index, 1, "none").count() == 0 and lexical.lookup(index, 2).count() == 0
    same = lexical.stored(index)
    assert rows(same.postings) == rows(index.postings)


def test_unread_keys(spark):
    known = spark.createDataFrame([("a",), ("a",), (None,)], "key string")
    asked = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("b", 2)], "key string, hit int")
    filter_ = cache.bloom(known, "key", 100)
    for f in (None, filter_):
        assert rows(cache.without_cached(known, asked, "key", f)) == [("b", 2), ("b", 2), (None, 3)]
    assert cache.without_cached(known.limit(0), asked, "key", cache.bloom(known.limit(0), "key", 100)).count() == 4


def test_runs_of_failures_in_stretches(spark):
    rng = random.Random(5)
    data = [(k, i, rng.random() < p) for k, p in (("hot", 0.8), ("all", 1.0), ("none", 0.0), ("few", 0.6)) for i in range(9 if k == "few" else 400)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "key string, at int, failed boolean")
    for n in (1, 3, 40):
        whole = rows(tracker.consecutive_failures(df, "key", "at", "failed", n))
        assert rows(tracker.consecutive_failures(df, "key", "at", "failed", n, span=20)) == whole
        expected = []
        for key in {k for k, *_ in data}:
            run = 0
            for k, at, failed in sorted(d for d in data if d[0] == key):
                run = run + 1 if failed else 0
                if run == n:
                    expected.append((k, at, True))
        assert whole == sorted(expected, key=repr)
    assert tracker.consecutive_failures(df.limit(0), "key", "at", "failed").count() == 0


def test_pipeline_without_providers(spark):
    documents = spark.createDataFrame([("a", "alpha beta"), ("b", None), ("c", "")], "doc_id string, text string")
    chunks, index, vectors = fusion.index_documents(documents)
    assert chunks.count() == 3 and vectors.count() == 0 and not chunks.where("dense_covered").count()
    queries = spark.createDataFrame([(1, "beta"), (2, None), (3, "")], "query_id bigint, query string")
    found = fusion.ask(queries, chunks, index, vectors)
    assert [(r["query_id"], r["final_rank"]) for r in found.collect()] == [(1, 0)]


def test_report_and_once(spark, tmp_path, monkeypatch):
    none = spark.createDataFrame([], "question_id string, matched boolean")
    assert rows(evaluation.report(none, 0.5, "t")) == [("t: 0/0 matched, failure rate 100.0%, target 50.0% (failed)", False)]
    calls = []
    session.forget(spark, "t")

    def fails():
        calls.append(1)
        raise ValueError("no")

    for _ in range(2):
        try:
            session.once(spark, "t", fails)
        except ValueError:
            pass
    assert len(calls) == 2
    assert session.secret(None, "QUILLSPARK_NOT_SET") is None
    (tmp_path / "key").write_text(" from file\n")
    (tmp_path / "blank").write_text(" \n")
    monkeypatch.setenv("QUILLSPARK_SET", "from variable")
    assert session.secret(str(tmp_path / "key"), "QUILLSPARK_SET") == "from file"
    assert session.secret(str(tmp_path / "blank"), "QUILLSPARK_SET") == "from variable"


def test_slugs(spark):
    projects = tracker.project_map(spark, [("s", "o/r", "p", None)])
    nodes = spark.createDataFrame([("s", 0, 1, None, None, None, None, None, None), (None, 0, 2, None, None, None, None, None, None)], f"slug string, position int, {tracker.NODE}")
    found = tracker.merged(tracker.of_slugs(nodes, projects)).collect()
    assert [(r["number"], r["plugin"], r["status"], r["assignee"]) for r in found] == [(1, "p", "Todo", None)]
    assert tracker.merged(tracker.of_slugs(nodes.limit(0), projects)).count() == 0
    adrs = spark.createDataFrame([("0001", 1, "b"), ("0001", 0, "a")], "number string, position bigint, title string")
    assert [r["title"] for r in tracker.decision(adrs, "0001").collect()] == ["a"]
