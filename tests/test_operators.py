"""Operators on tiny tables: nulls, ties, repeats, empty tables, extra columns."""

import datetime
import json
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import text as T
from quillspark.operators import cache, chunk, dense, evaluation, fusion, lexical, parity, readers, snapshot_diff, tracker
from quillspark.sources import files, issues
from quillspark.streaming import ingest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- Snapshots


SNAP = "snapshot_no int, repo string, issue_number int, status string, priority string, delivered_at int, field string"


def brute_changes(data):
    last = {}
    for r in data:
        if r[2] is None or r[1] is None or r[0] is None:
            continue
        key = (r[0], r[1].strip().lower(), r[2])
        order = (r[5] is not None, r[5] or 0, r[3] is not None, r[3] or "", r[4] is not None, r[4] or "")
        if key not in last or last[key][0] < order:
            last[key] = (order, [(x or "").strip().lower() for x in (r[3], r[4])])
    numbers = {r[0] for r in data}
    out = set()
    for (n, repo, i), (_, v) in last.items():
        if n - 1 in numbers:
            before = last.get((n - 1, repo, i))
            if before is None:
                out.add((n, repo, i, "added"))
            elif before[1] != v:
                out.add((n, repo, i, "changed"))
        if n + 1 in numbers and (n + 1, repo, i) not in last:
            out.add((n + 1, repo, i, "removed"))
    return out


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(1)
    data = [
        (rng.choice([1, 2, 3, 5, 6]), rng.choice(["a", "A ", "b"]), rng.choice([1, 2, 3, None]),
         rng.choice(["x", " X", "y", None, ""]), rng.choice(["p", None]), rng.choice([1, 2, 3, None]), "extra")
        for _ in range(120)
    ]
    found = snapshot_diff.issue_changes(spark.createDataFrame(data, SNAP))
    assert {tuple(r)[:4] for r in found.collect()} == brute_changes(data)
    assert found.where("change_kind = 'changed' and size(changed_fields) = 0").count() == 0


def test_snapshot_changes_of_nothing(spark):
    empty = spark.createDataFrame([], SNAP)
    assert snapshot_diff.issue_changes(empty).count() == 0
    one = spark.createDataFrame([(1, "a", 1, "x", None, 1, "")], SNAP)
    assert snapshot_diff.issue_changes(one).count() == 0


# --- Lexical


DOCS = [("a", "red apple, red"), ("b", "green Apple"), ("c", None), ("d", "")]


def test_index_and_scores(spark):
    docs = spark.createDataFrame(DOCS, "chunk_id string, text string")
    index = lexical.build(docs)
    assert rows(index.docs) == [("a", 3), ("b", 2), ("c", 0), ("d", 0)]
    asked = spark.createDataFrame([(1, "RED red apple"), (2, None), (3, "zzz")], "query_id int, query string")
    found = rows(lexical.search(index, asked).select("query_id", "chunk_id", "rank"))
    assert found == [(1, "a", 1), (1, "b", 2)]
    stats = index.stats().first()
    assert (stats["doc_count"], stats["sum_lengths"], stats["avg_length"]) == (4, 5, 1.25)


def test_remove_and_upsert(spark):
    index = lexical.build(spark.createDataFrame(DOCS, "chunk_id string, text string"))
    fewer = lexical.remove(index, spark.createDataFrame([("a",)], "chunk_id string"))
    assert fewer.stats().first()["sum_lengths"] == 2
    more = lexical.upsert(index, spark.createDataFrame([("a", "blue"), ("e", "blue sky")], "chunk_id string, text string"))
    assert rows(more.postings.where("term = 'blue'")) == [("a", "blue", 1), ("e", "blue", 1)]
    assert more.docs.count() == 5


def test_empty_index(spark):
    index = lexical.build(spark.createDataFrame([], "chunk_id string, text string"))
    asked = spark.createDataFrame([(1, "x")], "query_id int, query string")
    assert lexical.search(index, asked).count() == 0
    assert index.stats().first()["avg_length"] == 0.0


def test_index_survives_a_round_trip(spark, tmp_path):
    index = lexical.build(spark.createDataFrame(DOCS, "chunk_id string, text string"))
    index.write(str(tmp_path / "i"))
    assert rows(lexical.Index.read(spark, str(tmp_path / "i")).postings) == rows(index.postings)


# --- Dense


def test_dense_search_against_brute_force(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, [1.0]), (62, None)]
    table = spark.createDataFrame(vectors, "vec_id int, embedding array<double>").repartition(3)
    index = dense.records(table, "vec_id", "embedding")
    asked = table.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    found = dense.search(index, asked, 7)
    every = (
        index.crossJoin(asked.withColumnRenamed("embedding", "q"))
        .select("query_id", "chunk_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 5).alias("score"))
    )
    assert rows(found) == rows(lexical.top(every, 7).select(*found.columns))
    assert dense.search(index.where("chunk_id < 0"), asked).count() == 0
    assert dense.search(index, asked.where("query_id < 0")).count() == 0


def test_dense_upsert_and_files(spark, tmp_path):
    index = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, embedding array<double>")
    fresh = spark.createDataFrame([("b", [3.0])], "chunk_id string, embedding array<double>")
    merged = dense.upsert(index, fresh)
    assert rows(merged) == [("a", [1.0]), ("b", [3.0])]
    files.write_embeddings(merged, str(tmp_path / "e"))
    (tmp_path / "e" / "part-x.json").write_text('\n{"chunkId": "c"}\nnonsense\n{"chunkId":"","embedding":[1]}\n{"chunkId":"d","embedding":[1,2]}\n')
    assert rows(files.read_embeddings(spark, str(tmp_path / "e"))) == [("a", [1.0]), ("b", [3.0]), ("d", [1.0, 2.0])]


# --- Fusion


HITS = "query_id int, chunk_id string, score double, rank bigint"


def test_fuse(spark):
    left = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (1, "b", 0.7, 3)], HITS)
    right = spark.createDataFrame([(1, "c", 5.0, 1), (1, "a", 4.0, 2)], HITS)
    found = {r["chunk_id"]: r for r in fusion.fuse(left, right).collect()}
    assert found["a"]["rank"] == 1 and found["b"]["rank"] == 2
    assert found["b"]["dense_rank"] == 3 and found["b"]["dense_score"] == 0.7
    assert found["a"]["fused_score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)
    assert found["c"]["dense_score"] is None and found["c"]["rank"] == 3
    assert fusion.fuse(left.limit(0), right.limit(0)).count() == 0


def test_rerank_with_and_without_provider(spark):
    candidates = fusion.fuse(
        spark.createDataFrame([(1, c, 1.0, i + 1) for i, c in enumerate("abcd")] + [(2, "a", 1.0, 1)], HITS),
        spark.createDataFrame([], HITS),
    )
    chunks = spark.createDataFrame([("a", "ta"), ("b", "tb"), ("c", "tc"), ("c", "tc")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "q"), (2, "fail")], "query_id int, query string")
    plain = fusion.rerank(candidates, chunks)
    assert rows(plain.select("query_id", "chunk_id", "final_rank")) == [(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "a", 0)]

    def provider(query, texts):
        if query == "fail":
            raise RuntimeError("no")
        return [(2, 0.5), (9, 0.4), (2, 0.3), (0, 0.9)]

    found = fusion.rerank(candidates, chunks, provider, asked)
    assert rows(found.select("query_id", "chunk_id", "final_rank", "reranker_score")) == [
        (1, "a", 1, 0.9), (1, "c", 0, 0.5), (2, "a", 0, None)]
    with pytest.raises(ValueError):
        fusion.rerank(candidates, chunks, n=0)


def test_contextualize(spark):
    chunks = spark.createDataFrame([("d", 0, "x"), ("d", 1, "boom"), ("e", 0, "y")], "doc_id string, ordinal int, text string")
    docs = spark.createDataFrame([("d", "doc")], "doc_id string, text string")
    assert rows(fusion.contextualize(chunks, docs).select("context_failure_reason").distinct()) == [("missing_api_key",)]

    def provider(document, text):
        if text == "boom":
            raise RuntimeError("boom")
        return document and f" about {document} "

    found = fusion.contextualize(chunks, docs, provider)
    assert rows(found.select("doc_id", "ordinal", "context_preamble", "context_failure_reason")) == [
        ("d", 0, "about doc", None), ("d", 1, None, "throw_boom"), ("e", 0, None, "empty_response")]


# --- Evaluation


def test_recall_and_breakdown(spark):
    hits = spark.createDataFrame([(1, "a", 1.0, 1), (2, "a", 1.0, 1), (2, "b", 0.5, 21), (3, "z", 1.0, 1)], HITS)
    chunks = spark.createDataFrame([("a", "the answer"), ("b", "Other")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, ["answer"]), (2, ["Other"]), (3, ["x"]), (4, None)], "question_id int, expected array<string>")
    found = evaluation.matched(hits, chunks, asked)
    assert rows(found) == [(1, True), (2, False), (3, False), (4, False)]
    assert evaluation.summary(found, 0.8).first()["passed"] is True
    assert evaluation.summary(found.limit(0), 0.8).first()["failure_rate"] == 1.0
    assert dict(rows(evaluation.breakdown(evaluation.caught_at(found)))) == {"tier1": 1, "tier2": 0, "tier3": 0, "missed": 0, "unknown": 3}
    assert dict(rows(evaluation.breakdown(evaluation.caught_at(found, found))))["missed"] == 3


FIRST_PLAN = """
import sys
from pyspark.sql import functions as F
from quillspark import session
from quillspark.operators import evaluation

spark = session.build("local[1]", "first-plan", **{"spark.sql.shuffle.partitions": "1"})
chunks, asked, hits = (spark.read.parquet(f"{sys.argv[1]}/{name}") for name in ("chunks", "asked", "hits"))
asked = asked.select(F.col("item_id").alias("question_id"), F.col("passages").alias("expected"))
found = evaluation.matched(hits, chunks.withColumnRenamed("doc_id", "chunk_id"), asked)
print(sorted(r["question_id"] for r in found.collect() if r["matched"]), found.count())
"""


def test_matched_in_the_first_plan_of_a_session(spark, tmp_path):
    """Texts whose column has one of a session's first ids, in a process of its own."""
    for name, schema, data in (
        ("chunks", "doc_id string, text string", [("a", "the answer"), ("b", None)]),
        ("asked", "item_id int, passages array<string>",
         [(1, ["answer"]), (2, ["Answer"]), (3, []), (4, None), (5, [None, "the", "the"]), (6, [None]), (8, ["answer"])]),
        ("hits", HITS, [(q, c, 1.0, 1) for q in range(7) for c in ("a", "b")]),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}")
    done = subprocess.run([sys.executable, "-c", FIRST_PLAN, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert done.stdout.split("\n")[-2:-1] == ["[1, 5] 7"], done.stderr[-2000:]


# --- Readers


def test_markdown_reader(spark):
    pages = spark.createDataFrame(
        [("a", "---\r\ntitle: T\r\n---\r\nbody"), ("b", "plain"), ("c", None), ("d", "```js\nx\n```\n")], "url string, content string")
    found = {r["url"]: r for r in readers.read_markdown(pages, unwrap=True).collect()}
    assert found["a"]["body"] == "body" and json.loads(found["a"]["frontmatter"]) == {"title": "T"}
    assert found["b"]["frontmatter"] == "{}" and found["d"]["body"] == "x"
    assert found["c"]["blocked"] and found["c"]["reason"] == "fetch_failed"
    cut = {r["url"]: r["body"] for r in readers.read_markdown(pages, limit=10).collect()}
    assert cut["a"] == "---\ntitle:"


def test_front_matter_of_whole_texts(spark, tmp_path):
    from hashlib import sha256

    from quillspark.plans import queries

    front, body = "title: T\n" + "note: n\n" * 300 + "end: 1", "b" * 3000 + " tail"
    text = f"---\r\n{front}\n---\n{body}"
    spark.createDataFrame([(1, text), (2, body), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.QUERIES["frontmatter_whole"](spark, str(tmp_path)).collect()}
    sha = lambda t: sha256(t.encode()).hexdigest()
    assert (found[1]["front_sha"], found[1]["body_sha"], found[1]["kept"]) == (sha(front), sha(body), len(text) - 1)
    assert found[2]["body_sha"] == sha(body) and set(found) == {1, 2}
    pages = spark.createDataFrame([("a", "---\nt: 1\n---\n" + body)], "url string, content string")
    assert readers.read_markdown(pages).first()["body"] == body
    assert readers.read_markdown(pages, limit=20).first()["body"] == body[:7]


def test_scan_states(spark):
    pages = spark.createDataFrame([("a", "bad"), ("b", "odd"), ("c", "fine"), ("d", "fail"), ("e", "bad")], "url string, content string")

    def scanner(t):
        if t == "fail":
            raise RuntimeError
        return {"bad": 0.9, "odd": 0.5}.get(t, 0.0)

    done = readers.scan(pages, "content", scanner)
    assert dict(rows(done.select("url", "parry_label"))) == {"a": "MALICIOUS", "b": "SUSPICIOUS", "c": "SAFE", "d": "SAFE", "e": "MALICIOUS"}
    assert dict(rows(done.select("url", "parry_via")))["d"] == "stub"
    kept = readers.verdict_rows(done)
    assert kept.count() == 4
    again = readers.scan(pages, "content", lambda t: 0.0, kept)
    assert dict(rows(again.select("url", "parry_label")))["a"] == "MALICIOUS"
    other = readers.scan(pages, "content", None, kept, malicious=0.95)
    assert dict(rows(other.select("url", "parry_label")))["a"] == "SAFE"
    result = {r["url"]: r for r in readers.read_markdown(pages, scanner=scanner).collect()}
    assert result["a"]["reason"] == "prompt_injection" and result["a"]["body"] is None
    assert result["b"]["warnings"] == ["prompt_injection_suspicious"]


def test_html_reader_and_dispatch(spark):
    pages = spark.createDataFrame([("a", "<html><body><p>" + "word " * 200 + "</p></body></html>"), ("b", "<div id=root></div>"), ("c", None)], "url string, content string")
    found = {r["url"]: r for r in readers.read_html(pages).collect()}
    assert not found["a"]["blocked"] and found["b"]["reason"] == "fetch_failed" and found["c"]["blocked"]
    with_adapter = {r["url"]: r for r in readers.read_html(pages, adapter=lambda url: f"<p>{url}</p>").collect()}
    assert with_adapter["b"]["markdown"] == "b" and with_adapter["b"]["fetched_via"] == "crawlee"
    assert with_adapter["a"]["fetched_via"] == "fetch"


def test_js_only(spark):
    body = lambda t, extra="": f"<html><body>{t}{extra}</body></html>".ljust(600)
    cases = [("", True), ("x" * 511, True), ("x" * 600, True), (body("w" * 99), True), (body("w" * 100), False),
             ("<body>" + "w" * 700, True), (body("w" * 20, "<noscript>" + "n" * 85 + "</noscript>"), True),
             (body("w" * 120 + "<script>" + "s" * 90 + "</script>"), False)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, h string")
    assert [r["x"] for r in df.select("i", T.js_only(F.col("h")).alias("x")).orderBy("i").collect()] == [e for _, e in cases]


def test_xml_and_js_readers(spark):
    pages = spark.createDataFrame([("a", "<r><i>1</i><i k='v'>2</i></r>"), ("b", "<r>"), ("c", None)], "url string, content string")
    found = {r["url"]: r for r in readers.read_xml(pages, "//i").collect()}
    assert (found["a"]["nodes"], found["a"]["text"]) == (2, "1") and found["b"]["reason"] == "fetch_failed"
    assert readers.xml_nodes(pages).count() == 3 and readers.xml_nodes(pages, "/r/i[2]").first()["attrs"] == {"k": "v"}
    code = spark.createDataFrame([("a", "export const A = {b: [1]}"), ("b", "export const A = f()"), ("c", None)], "url string, content string")
    done = {r["url"]: r for r in readers.read_js(code, "A").collect()}
    assert json.loads(done["a"]["data_json"]) == {"b": [1]} and done["b"]["blocked"] and done["c"]["blocked"]


def test_chunk_tables(spark):
    docs = spark.createDataFrame([("a", "# H\n\n" + "word " * 2000, 1), ("b", None, 2), (None, "x", 3)], "doc_id string, text string, id int")
    found = chunk.chunk(docs)
    assert found.where("doc_id = 'b'").count() == 1 and found.where("doc_id is null").count() == 0
    expected = F.sha2(F.concat_ws("|", "doc_id", F.col("ordinal").cast("string"), "text"), 256)
    assert found.where(F.col("id") != expected).count() == 0
    assert chunk.regrouped(found).where("doc_id = 'a'").first()["texts"][0].startswith("# H")
    assert chunk.fixed_windows(docs.drop("id")).where("doc_id = 'a'").count() == 4


# --- Tracker and parity


def test_flatten_and_counts(spark):
    node = {"number": 1, "title": "t", "state": "CLOSED", "url": "u", "assignees": {"nodes": []},
            "labels": {"nodes": [{"name": "bug"}, {"name": "area/schema"}, {"name": "area/x"}]}, "projectItems": {"nodes": []}}
    df = spark.createDataFrame([(json.dumps(node), "r", "meta-repo")], "j string, repo string, fallback string")
    df = df.select(F.from_json("j", tracker.NODE).alias("n"), "repo", "fallback").select("n.*", "repo", "fallback")
    row = tracker.flatten(df).first()
    assert (row["plugin"], row["status"], row["priority"], row["wave"], row["effort"], row["assignee"]) == ("schema", "Done", "P2", "Wave 1", "M", None)
    assert tracker.with_label(tracker.flatten(df), "bug").count() == 1 and tracker.with_label(tracker.flatten(df), "no").count() == 0
    some = spark.createDataFrame([("schema", "Done"), ("schema", "Todo"), ("odd", "Todo"), (None, "Todo")], "plugin string, status string")
    counts = {r["plugin"]: (r["total"], r["open"]) for r in tracker.plugin_counts(some).collect()}
    assert counts["schema"] == (2, 1) and counts["data-cli"] == (0, 0) and counts["(unknown)"] == (2, 2)
    assert len(tracker.of_plugins(some, []).collect()) == 4
    assert {r["status"]: r["issues"] for r in tracker.status_counts(some.limit(0)).collect()} == dict.fromkeys(T.STATUSES, 0)


def test_first_wins_and_recent(spark):
    df = spark.createDataFrame([("r", 1, 2, "b"), ("r", 1, 1, "a"), ("r", 2, 5, "c")], "repo string, number int, slug int, v string")
    assert rows(tracker.first_wins(df, ["repo", "number"], ["slug"])) == [("r", 1, 1, "a"), ("r", 2, 5, "c")]
    assert rows(tracker.recent(df, "repo", ["slug"], 2).select("v")) == [("a",), ("b",)]


def test_failures_and_newest(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, True, True, False, True, True, True])], "k int, at int, failed boolean")
    assert rows(tracker.consecutive_failures(df, "k", "at", "failed").select("at")) == [(2,), (7,)]
    assert rows(tracker.newest(df, "k", "at", 2).select("at")) == [(6,), (7,)]


def test_changelog_entries(spark):
    df = spark.createDataFrame([(1, "# Log\n## [1.2.0] - 2026-01-02\n- a\n- b\r\n## v1.1.0 (2025-12-01)\nx\n## Notes\ny"), (2, None)], "doc_id int, text string")
    assert rows(tracker.changelog_entries(df).select("version", "date", "body")) == [("1.1.0", "2025-12-01", "x"), ("1.2.0", "2026-01-02", "- a\n- b")]


def test_parity(spark):
    text = "| `x` | a | **ported** |\n### one → two\n| `x` | a | **Ported** | b |\n| `y` | a | **tbd** | b |\n| `y` | **divergent** |\n| `y` | c | **divergent** |\n| `z` | c | **unknown** |"
    declared = parity.tracker_rows(spark.createDataFrame([(1, text)], "tracker_id int, text string"))
    assert rows(declared.select("plugin", "skill", "declared")) == [("one", "x", "ported"), ("one", "y", "divergent")]
    tracked = spark.createDataFrame([("one", "x"), ("one", "y"), ("one", "w")], "plugin string, skill string")
    specs = spark.createDataFrame([("one", "x", "# s\nDeviations from upstream:\nNone.\n## E"), ("one", "w", "Deviations from upstream\n- differs")], "plugin string, skill string, text string")
    derived = parity.derived_status(tracked, specs)
    assert rows(derived) == [("one", "w", "divergent"), ("one", "x", "ported"), ("one", "y", "tbd")]
    assert rows(parity.drift(declared, derived).select("skill")) == [("w",)]
    assert dict(rows(parity.counts(derived)))["tbd"] == 1


# --- Caches, sources, streaming


def test_cache(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "key string, at int, v string")
    last = cache.latest(df, "key", ["at"])
    assert rows(last) == [("a", 2, "y")]
    put = cache.put(last, spark.createDataFrame([("a", 9, "n"), ("b", 1, "m")], "key string, at int, v string"), "key")
    assert rows(put) == [("a", 9, "n"), ("b", 1, "m")]
    assert rows(cache.get(put, df.select("key"), "key").select("key", "hit")) == [("a", True), ("a", True), (None, False)]
    filter_ = cache.bloom(put.repartition(2), "key", 100)
    assert rows(cache.maybe_seen(spark.createDataFrame([("a",), (None,)], "key string"), "key", filter_)) == [("a",)]
    when = spark.createDataFrame([(datetime.datetime(2026, 1, 1),)], "t timestamp")
    live = cache.with_expiry(when, F.col("t"))
    assert cache.alive(live, F.lit("2026-01-01 00:04:59").cast("timestamp")).count() == 1
    assert cache.alive(live, F.lit("2026-01-01 00:05:00").cast("timestamp")).count() == 0
    assert cache.alive(live, F.lit("2026-01-01").cast("timestamp"), fresh=True).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("A")
    (tmp_path / "docs" / "sub" / "b.md").write_text("B\nC")
    (tmp_path / "docs" / "x.txt").write_text("no")
    assert rows(files.markdown_corpus(spark, str(tmp_path / "docs"))) == [("a.md", "A"), ("sub/b.md", "B\nC")]
    (tmp_path / "s.json").write_text(json.dumps({"generatedAt": "t", "issues": [{"number": 1, "title": "x"}]}))
    assert files.read_snapshot(spark, str(tmp_path / "s.json")).first()["number"] == 1
    (tmp_path / "q.json").write_text(json.dumps({"version": 1, "questions": [{"id": "q1", "query": "w", "expectedSubstrings": ["s"]}]}))
    assert rows(files.read_questions(spark, str(tmp_path / "q.json"))) == [("q1", "w", ["s"])]
    (tmp_path / "c.json").write_text(json.dumps({"adrs": [{"number": "0002"}, {"number": "0001"}], "changelogs": [{"date": "2026-01-01"}, {"date": "2026-02-01"}]}))
    adrs, changes = files.read_content(spark, str(tmp_path / "c.json"))
    assert [r["number"] for r in tracker.sorted_decisions(adrs).collect()] == ["0001", "0002"]
    assert [r["date"] for r in tracker.sorted_changes(changes).collect()] == ["2026-02-01", "2026-01-01"]
    api = spark.createDataFrame([('{"error":"x"}',), ('{"issues":[{"number":7}]}',), (None,)], "body string")
    assert [r["number"] for r in files.read_api(api).collect()] == [7]
    got = spark.createDataFrame([("o", "p", 200, "aMOp\n"), ("o", "p", 404, None), ("z", "p", 200, "aA=="), ("o", "p", 200, "")], "owner string, path string, status int, content string")
    assert rows(files.file_results(got, ["o"]).select("kind", "content")) == [("bad-request", None), ("not-found", None), ("ok", "hé"), ("unavailable", None)]


def test_issue_source_pages(spark, tmp_path):
    for slug, pages in (("a", 6), ("b", 1)):
        (tmp_path / slug).mkdir()
        for i in range(pages):
            body = {"data": {"repository": {"issues": {"nodes": [{"number": i}], "pageInfo": {"hasNextPage": i < pages - 1}}}}}
            (tmp_path / slug / f"{i}.json").write_text(json.dumps(body))
    spark.dataSource.register(issues.IssueSource)
    df = spark.read.format("issues").option("slugs", "a,b,c").option("root", str(tmp_path)).load()
    assert df.groupBy("slug").count().orderBy("slug").collect() == [("a", 4), ("b", 1)]


def test_stream_index(spark, tmp_path):
    schema = "url string, content string, fetched_at timestamp"
    when = datetime.datetime(2026, 1, 1)
    pages = [("a", "red apple", when), ("b", "red apple", when), ("c", "green pear", when)]
    spark.createDataFrame(pages, schema).write.parquet(str(tmp_path / "in"))
    stream = ingest.deduplicated(ingest.landed(spark, str(tmp_path / "in"), schema))
    ingest.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    index = ingest.read_index(spark, str(tmp_path / "out"))
    assert index.docs.count() == 2 and index.postings.where("term = 'red'").count() == 1


def test_scratch_cuts_lineage(spark):
    df = session.scratch(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert "Project" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 5
    assert session.bounded_bytes(df) > 0
