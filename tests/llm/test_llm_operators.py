"""Training-data operators against brute force, with hostile rows."""

import datetime
import hashlib
import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark import session
from quillspark.llm import boilerplate, leakage, mixing, neighbours, seen, splitter, subjects


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 1. Similar vectors

VEC = "chunk_id string, embedding array<float>, indexed_at int, key string, rank int"


def vectors(n=240, width=64, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, width))
    out = []
    for i in range(n):
        v = base[i % len(base)] + rng.standard_normal(width) * rng.choice([0.1, 0.3, 0.5])
        out.append((f"c{i:04d}", [float(x) for x in v], 1, "x", 0))
    return out


def brute_lists(data, k=5, floor=0.9, width=64):
    last = {}
    for key, v, at, *_ in data:
        if key is not None and (key not in last or (at or 0) > last[key][0]):
            last[key] = (at or 0, v)
    good = {
        key: np.array(v, np.float64) for key, (_, v) in last.items()
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    keys = sorted(good)
    x = np.stack([good[key] / np.linalg.norm(good[key]) for key in keys])
    s = x @ x.T
    out = set()
    for i, key in enumerate(keys):
        order = sorted((j for j in range(len(keys)) if j != i and s[i, j] >= floor), key=lambda j: (-round(s[i, j], 9), keys[j]))
        out |= {(key, keys[j], r) for r, j in enumerate(order[:k], 1)}
    return out


def test_neighbours_recall_and_hostile_rows(spark):
    data = vectors()
    data += [("c0000", [9.0] * 64, 0, "", 0), ("c0001", data[1][1], 1, "", 0)]  # an older version, an exact repeat
    data += [("bad1", None, 1, "", 0), ("bad2", [0.0] * 64, 1, "", 0), ("bad3", [float("nan")] + [1.0] * 63, 1, "", 0),
             ("bad4", [1.0] * 63, 1, "", 0), (None, data[0][1], 1, "", 0), ("c0003", [1.0] * 3, 2, "", 0),
             ("bad5", [None] + [1.0] * 63, 1, "", 0), ("bad6", [], 1, "", 0)]
    found = neighbours.most_similar(spark.createDataFrame(data, VEC))
    mine, truth = {(r["key"], r["neighbour"]) for r in found.collect()}, {(a, b) for a, b, _ in brute_lists(data)}
    assert len(mine & truth) >= 0.97 * len(truth) and not mine - truth


def test_copies_are_not_expanded(spark):
    v = [1.0] + [0.5] * 63
    data = [(f"k{i:03d}", v, 1, "", 0) for i in range(120)] + [("z", [1.1] + [0.5] * 63, 1, "", 0), ("far", [-1.0] * 64, 1, "", 0)]
    found = neighbours.most_similar(spark.createDataFrame(data, VEC))
    assert {(r["key"], r["neighbour"], r["rank"]) for r in found.collect()} == brute_lists(data)


def test_hot_buckets_are_exact(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    data = [(f"k{i:03d}", [float(x) for x in base + 0.02 * rng.standard_normal(64)], 1, "", 0) for i in range(90)]
    found = neighbours.most_similar(spark.createDataFrame(data, VEC), bucket_limit=16)
    assert {(r["key"], r["neighbour"]) for r in found.collect()} == {(a, b) for a, b, _ in brute_lists(data)}


def test_probing_widens_the_radius(spark):
    data = vectors(120)
    plain = neighbours.most_similar(spark.createDataFrame(data, VEC), flips=1, recall=0.97)
    truth = {(a, b) for a, b, _ in brute_lists(data)}
    assert len({(r["key"], r["neighbour"]) for r in plain.collect()} & truth) >= 0.9 * len(truth)


def test_complete_lists_have_no_floor(spark, monkeypatch):
    data = vectors(150) + [(f"copy{i}", vectors(150)[7][1], 1, "", 0) for i in range(3)]
    df, truth = spark.createDataFrame(data, VEC), brute_lists(data, floor=-1.0)
    assert len(truth) == 5 * len(data)
    assert {(r["key"], r["neighbour"], r["rank"]) for r in neighbours.most_similar(df, complete=True).collect()} == truth
    monkeypatch.setattr(neighbours, "SHORT_BLOCK", 40)
    monkeypatch.setattr(neighbours, "ALL_BLOCK", 60)
    assert {(r["key"], r["neighbour"], r["rank"]) for r in neighbours.most_similar(df, complete=True).collect()} == truth
    three = neighbours.most_similar(df.where("chunk_id < 'c0003'"), complete=True)
    assert three.count() == 6 and neighbours.most_similar(df.limit(0), complete=True).count() == 0


def test_neighbours_of_nothing(spark):
    assert neighbours.most_similar(spark.createDataFrame([], VEC)).count() == 0
    assert neighbours.most_similar(spark.createDataFrame(vectors(4)[:1], VEC)).count() == 0


def test_expected_recall_is_what_the_layout_promises():
    bits, tables = 14, neighbours.tables_for(0.9, 14, 0, 0.99)
    assert neighbours.expected_recall(0.9, bits, tables) >= 0.99
    assert neighbours.expected_recall(0.95, bits, tables) > 0.999


# --- 3. Seen keys

ENTRY = "entry_id bigint, entry_key string, fetched_at string, kind string, id int, key string"


def brute_seen(data, warm):
    entries = sorted({(datetime.datetime.fromisoformat(t), i, k) for i, k, t, *_ in data if k is not None and k.strip()})
    known, out = {k for k in warm if k}, set()
    for _, i, k in entries:
        if k in known:
            out.add(i)
        known.add(k)
    return out


def entries(rng, n, keys):
    zones = ["+00:00", "+05:30", "-08:00"]
    out = []
    for i in range(n):
        t = datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=rng.randrange(40))
        out.append((i, rng.choice(keys), t.isoformat() + rng.choice(zones), "page", 0, "z"))
    return out + out[: n // 20]


def test_seen_against_brute_force(spark):
    rng = random.Random(4)
    data = entries(rng, 300, ["hot"] * 30 + [f"k{i}" for i in range(120)] + [None, "", "  ", " ", "K1", "k1 "])
    warm = ["k3", "k4", None, " "]
    df = spark.createDataFrame(data, ENTRY)
    warm_df = spark.createDataFrame([(k, "2025-01-01T00:00:00Z") for k in warm], "entry_key string, fetched_at string")
    found = seen.seen_in_order(df, warm_df, 1, 4)
    assert {r["entry_id"] for r in found.collect()} == brute_seen(data, warm) and found.count() == len(brute_seen(data, warm))
    rate = seen.error_rate(
        seen.as_records(df), found.withColumnRenamed("entry_id", "id"), lambda r: seen.seen_by_sort(r, seen.history(warm_df))
    ).first()
    assert rate["wrong"] == 0 and rate["wrong_rate"] == 0.0 and rate["records"] == 300
    assert seen.error_rate(seen.as_records(df), found.limit(5).withColumnRenamed("entry_id", "id"), lambda r: seen.seen_by_sort(r, seen.history(warm_df))).first()["wrong"] > 0


def test_ledger_over_batches_in_order(spark, monkeypatch):
    monkeypatch.setattr(seen, "COMPACT_EVERY", 2)
    rng = random.Random(5)
    data = sorted(entries(rng, 120, [f"k{i}" for i in range(40)]), key=lambda e: (datetime.datetime.fromisoformat(e[2]), e[0]))
    ledger = seen.KeyLedger(spark, 4)
    found = set()
    for part in (data[:50], data[50:90], data[90:]):
        found |= {r["id"] for r in ledger.process(seen.as_records(spark.createDataFrame(part, ENTRY))).collect()}
    assert found == brute_seen(data, [])
    assert ledger.table().count() == len({e[1] for e in data}) and ledger.appends == 2
    ledger.compact()
    assert ledger.table().count() == len({e[1] for e in data}) and ledger.appends == 1
    ledger.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("key_ledger")]


def test_seen_in_order_feeds_the_ledger(spark, monkeypatch):
    rng = random.Random(6)
    data = entries(rng, 200, ["hot"] * 20 + [f"k{i}" for i in range(90)] + [None, " "])
    data += [(900, "hot", "no time", "page", 0, "z"), (901, "only", None, "page", 0, "z")]
    warm_df = spark.createDataFrame([("k3", "2025-01-01T00:00:00Z")], "entry_key string, fetched_at string")
    appended, append = [], seen.KeyLedger.append
    monkeypatch.setattr(seen.KeyLedger, "append", lambda self, firsts: (appended.append(firsts.count()), append(self, firsts)))
    found = seen.seen_in_order(spark.createDataFrame(data, ENTRY), warm_df, 3, 4)
    assert sorted(r["entry_id"] for r in found.collect()) == sorted(brute_seen(data[:-2], ["k3"]) | {900})
    keys = {e[1] for e in data if e[1] and e[1].strip()} | {"k3"}
    assert len(appended) == 4 and all(appended) and sum(appended) == len(keys)
    empty = spark.createDataFrame([], ENTRY)
    assert seen.seen_in_order(empty, warm_df, 3, 4).count() == 0


def test_seen_of_nothing(spark):
    empty, warm = spark.createDataFrame([], ENTRY), spark.createDataFrame([], "entry_key string, fetched_at string")
    assert seen.seen_in_order(empty, warm, 1, 2).count() == 0
    none = seen.as_records(empty)
    assert seen.error_rate(none, none.select("id"), lambda r: r.select("id")).first()["wrong_rate"] == 0.0


# --- 4. Splitting


@given(
    st.lists(st.sampled_from(["word ", "Longerword", ". ", "! ", "\n", "\n\n", "\n# Head\n", "é\U0001f600 ", "x" * 30, "  "]), max_size=120).map("".join),
    st.integers(8, 60), st.integers(0, 7),
)
@settings(max_examples=150, deadline=None)
def test_split_round_trip(text, size, overlap):
    pieces = splitter.split(text, size, overlap)
    assert all(e - s <= size for s, _, e, _ in pieces)
    assert "".join(text[n:e] for _, n, e, _ in pieces) == text
    for before, after in zip(pieces, pieces[1:]):
        assert after[1] == before[2] and after[1] - after[0] == min(overlap, after[1])
        assert after[2] > after[1]
    if len(text) > size:
        assert len(pieces) > 1


def test_split_prefers_natural_boundaries():
    text = "# A\n" + "a " * 20 + "\n# B\n" + "b b b. " * 10
    kinds = [b for *_, b in splitter.split(text, 50, 0)]
    assert kinds[0] == "section" and kinds[-1] == "end" and "sentence" in kinds and "character" not in kinds
    assert [b for *_, b in splitter.split("x" * 100, 40, 10)] == ["character", "character", "end"]
    with pytest.raises(ValueError):
        splitter.split("x", 5, 5)


def test_split_items(spark):
    docs = spark.createDataFrame(
        [("a", "x" * 50, None, 1), ("b", "y y\n" * 20, "s", 1), ("c", None, "s", 1), ("d", "", "s", 1), ("e", "z" * 40, "s", 1),
         ("f", "w" * 41, "unknown", 1), ("g", "v" * 41, "s", 1), ("g", "v" * 41, "s", 1)],
        "chunk_id string, text string, option_set string, size int")
    options = spark.createDataFrame([("default", 10, 1), ("s", 10, 9)], "option_set string, chunk_size int, overlap int")
    pieces = splitter.split_items(splitter.with_limits(docs, options), "chunk_id", "text")
    assert rows(splitter.oversized(pieces, "chunk_id")) == [("a", "hard"), ("b", "soft"), ("f", "hard"), ("g", "hard")]
    assert all(len(r["text"]) <= 40 and r["text"] for r in pieces.collect())
    assert splitter.split_items(splitter.with_limits(docs.limit(0), options), "chunk_id", "text").count() == 0
    whole = splitter.restored(splitter.with_limits(docs, options), "chunk_id", "text")
    texts = {r["chunk_id"]: r["text"] for r in docs.collect()}
    assert whole.count() == 5 and all(
        r["within"] and r["overlapping"] and r["text_md5"] == hashlib.md5(texts[r["chunk_id"]].encode()).hexdigest() for r in whole.collect()
    )


@given(
    st.lists(st.sampled_from(["word ", "Longerword", ". ", "\n", "\n\n", "\n# Head\n", "x" * 30, "  "]), max_size=80).map("".join),
    st.integers(8, 60), st.integers(0, 7),
)
@settings(max_examples=150, deadline=None)
def test_cuts_tell_whether_a_line_is_too_long(text, size, overlap):
    pieces = splitter.split(text, size, overlap)
    assert splitter.cut_inside_long_line(text, pieces, size) == any(len(line) > size for line in text.split("\n"))


# --- 5. Boilerplate


def page(i, body, host="docs.acme.example"):
    chrome = ["[![Acme](/img/logo-%d.svg)](/)" % i, "Home", "Pricing", f"Home > Pricing > Title {i}"]
    tail = ["**Related articles**", f"- [Other {i}](/p/{i})", f"* Another {i} →", "We use cookies on this site.", f"Last deployed: build {i}"]
    return (i, f"https://{host}/p/{i}", "\n".join([*chrome, f"# Title {i}", "", *body, *tail]), "extra", i)


PAGE = "page_id bigint, entry_key string, markdown string, host string, salt int"


def test_boilerplate_lines(spark):
    bodies = [[f"Sentence number {i} speaks of {w} and of nothing else.", "## Notes", f"- [See {w}](./{w}) It tells more about {w}."] for i, w in enumerate(a + b for a in ("ash", "elm", "fir", "oak", "yew", "bay") for b in ("wood", "tree", "leaf"))]
    pages = [page(i, b) for i, b in enumerate(bodies)]
    pages += [(100, None, "no key here", "", 0), (101, "https://docs.acme.example/x", None, "", 0), (102, "https://docs.acme.example/x", "", "", 0), pages[0]]
    found = boilerplate.boilerplate_lines(spark.createDataFrame(pages, PAGE)).distinct()
    expected = set()
    for i, *_ in pages[:18]:
        expected |= {(i, n) for n in (1, 2, 3, 4, 10, 11, 12, 13, 14)}
    assert {tuple(r) for r in found.collect()} == expected
    kept = {r["page_id"]: r["content"] for r in boilerplate.main_content(spark.createDataFrame(pages, PAGE)).collect()}
    assert kept[0] == "\n".join(["# Title 0", "", *bodies[0]]) and kept[100] == "no key here"
    assert boilerplate.boilerplate_lines(spark.createDataFrame([], PAGE)).count() == 0


def test_pages_of_other_hosts_do_not_hide_a_template_line(spark):
    def body(i, label):
        word = "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
        return "\n".join([f"The report {word} was written by hand, in ink, at night.", *label, f"It ends with remark {word} and says no more than that."])

    small = [(i, f"https://small.example/{i}", body(i, ["Advertising"] * (i % 12 == 0)), "", 0) for i in range(60)]
    large = [(i, f"https://large.example/{i}", body(i, []), "", 0) for i in range(1000, 3600)]
    for pages in (small, small + large):
        found = boilerplate.boilerplate_lines(spark.createDataFrame(pages, PAGE)).where("page_id < 1000")
        assert {tuple(r) for r in found.collect()} == {(i, 2) for i in range(0, 60, 12)}


def test_repeated_rows_are_one_page(spark):
    once = (1, "https://docs.acme.example/a", "Acme was founded in a barn.\nIt grew.", "", 0)
    assert boilerplate.boilerplate_lines(spark.createDataFrame([once] * 5, PAGE)).count() == 0


def tree(*nodes):
    """``(label, parent)`` pairs as a tree of plain lines."""
    out = boilerplate.Tree()
    for line, (label, parent) in enumerate(nodes, 1):
        out.add(label, parent, line)
    return out


def test_simple_tree_matching_keeps_order_and_nesting():
    a = tree((1, -1), (2, -1), (5, 1), (6, 1), (3, -1))
    b = tree((3, -1), (2, -1), (6, 1), (5, 1), (1, -1), (3, -1))
    pairs = boilerplate.simple_tree_matching(a, b)
    assert sorted(a.labels[x] for x, _ in pairs) in ([2, 3, 5], [2, 3, 6]) and (4, 5) in pairs
    # The same labels, but below another parent.
    assert boilerplate.simple_tree_matching(tree((1, -1), (7, 0)), tree((1, -1), (7, -1))) == [(0, 0)]
    assert boilerplate.simple_tree_matching(tree((1, -1)), tree()) == []


def brute_matching(a, b, xs, ys):
    if not xs or not ys:
        return 0
    best = max(brute_matching(a, b, xs[1:], ys), brute_matching(a, b, xs, ys[1:]))
    if a.labels[xs[0]] == b.labels[ys[0]]:
        inner = brute_matching(a, b, a.children()[xs[0]], b.children()[ys[0]])
        best = max(best, 1 + inner + brute_matching(a, b, xs[1:], ys[1:]))
    return best


def test_simple_tree_matching_is_the_largest():
    rng = random.Random(11)
    for _ in range(60):
        pair = []
        for _ in range(2):
            nodes = []
            for i in range(rng.randrange(1, 9)):
                nodes.append((rng.randrange(4), rng.randrange(-1, i) if rng.random() < 0.4 else -1))
            pair.append(tree(*nodes))
        a, b = pair
        found = boilerplate.simple_tree_matching(a, b)
        assert len(found) == brute_matching(a, b, a.children()[-1], b.children()[-1])
        assert len({x for x, _ in found}) == len({y for _, y in found}) == len(found)


def test_long_pages_of_like_lines():
    """Thousands of equal and alternating lines are read and aligned in no time."""
    began = time.time()
    reader = boilerplate.Reader("docs.acme.example")
    pages = [boilerplate.read_tree("\n".join(f"{i} of these and {i % k} of those are here." + " x" * (i % k) for i in range(20_000)), reader) for k in (1, 3)]
    for a in pages:
        for b in pages:
            pairs = boilerplate.simple_tree_matching(a, b)
            assert len({x for x, _ in pairs}) == len(pairs) and sorted(pairs) == sorted(pairs, key=lambda p: p[1])
    assert len(boilerplate.simple_tree_matching(pages[1], pages[1])) == 20_000
    assert boilerplate.template_lines(boilerplate.read_tree("y" * 1_000_000, reader), {1}) == set()
    assert time.time() - began < 20


def test_a_recurring_sentence_among_varying_ones_is_content(spark):
    """The same line is template beside constant lines, content among varying ones."""
    said = "A copyright line in the source file is kept; the year is never changed."

    def body(i, inside):
        word = "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
        lines = [f"The report {word} was written by hand, in ink, at night.", f"It ends with remark {word} and says no more than that."]
        if inside:
            lines.insert(1, said)
        tail = ["Thanks for your visit to these pages, and come again."] + ([said] if i % 12 == 1 else []) + ["All the rest is kept in the archive of the town."]
        return "\n".join(lines + tail)

    among = [(i, f"https://one.example/{i}", body(2 * i, i % 12 == 0), "", 0) for i in range(96)]
    beside = [(1000 + i, f"https://two.example/{i}", body(i, False), "", 0) for i in range(96)]
    found = {tuple(r) for r in boilerplate.boilerplate_lines(spark.createDataFrame(among + beside, PAGE)).collect()}
    lines = {p: m.split("\n") for p, _, m, *_ in among + beside}
    told = {(p, lines[p][n - 1] == said) for p, n in found}
    assert not any(same for p, same in told if p < 1000)
    assert sum(same for p, same in told if p >= 1000) == 8
    assert all(n > 2 for _, n in found) and {p for p, _ in found} == set(lines)


def brute_wrapper(pages):
    """Labels of the wrapper of one host's trees by hash, each label's pages aligned one after the other."""
    held = {label: [p for p in sorted(pages) if label in pages[p].labels] for label in {x for t in pages.values() for x in t.labels}}
    held = {label: on for label, on in held.items() if len(on) >= max(boilerplate.LEAST_PAGES, boilerplate.LEAST_SHARE * len(pages))}
    sums = {}
    for a, b in {pair for on in held.values() for pair in zip(on, on[1:])}:
        for label, found in boilerplate.evidence(pages[a], pages[b]).items():
            sums[label] = [x + y for x, y in zip(sums.get(label, [0] * 4), found)]
    return {
        label for label, (tries, hits, beside, formed) in sums.items() if label in held and hits and (
            len(held[label]) >= max(boilerplate.CONSTANT_PAGES, boilerplate.CONSTANT_SHARE * len(pages))
            or beside >= boilerplate.SETTLED * tries or formed and hits >= boilerplate.MATCHED * tries)
    }


def test_every_page_that_holds_a_label_is_aligned(spark, monkeypatch):
    """Sentences that stand beside constant lines about as often as it takes: each page counts."""
    rng, pages = random.Random(5), []
    for i in range(400):
        word = "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
        lines = [f"The report {word} was written by hand, in ink, at night.", f"It ends with remark {word} and says no more than that."]
        tail = ["Thanks for your visit to these pages, and come again.", "All the rest is kept in the archive of the town."]
        for k in rng.sample(range(24), 3):
            (tail if rng.random() < 0.5 else lines).insert(1, f"Notice {'abcdefghijklmnopqrstuvwxyz'[k]} is given to all that read this.")
        pages.append((i, f"https://one.example/{i}", "\n".join(lines + tail), "", 0))
    df = spark.createDataFrame(pages, PAGE).selectExpr("'one.example' as host", "markdown")
    nodes = session.scratch(boilerplate.trees(df), "test-trees")
    expected = brute_wrapper({r["page"]: boilerplate.Tree.unpacked(bytes(r["tree"])) for r in nodes.collect()})
    assert 2 < len(expected) < 26
    assert {r["label"] for r in boilerplate.template_nodes(nodes).collect()} == expected
    # The same if the host's pages are aligned in several tasks.
    for size in (150, 7):
        monkeypatch.setattr(boilerplate, "PAGES_A_CHAIN", size)
        assert {r["label"] for r in boilerplate.template_nodes(nodes).collect()} == expected


def test_wrappers_joined_or_carried_give_the_same(spark, monkeypatch):
    bodies = [[f"Sentence number {i} speaks of {'abcdefghijklmnopqrstuvwxyz'[i]} and of nothing else."] for i in range(20)]
    df = spark.createDataFrame([page(i, b) for i, b in enumerate(bodies)], PAGE)
    carried = rows(boilerplate.boilerplate_lines(df))
    monkeypatch.setattr(boilerplate, "CARRIED_NODES", 0)
    monkeypatch.setattr(boilerplate, "PAGES_A_TASK", 7)
    assert rows(boilerplate.boilerplate_lines(df)) == carried and carried


# --- 6. Leakage


def brute_runs(passage, text, least):
    p, t = leakage.words(passage or ""), leakage.words(text or "")
    grams = {tuple(p[i : i + least]) for i in range(len(p) - least + 1)}
    return any(tuple(t[i : i + least]) in grams for i in range(len(t) - least + 1))


def test_words():
    assert leakage.words("A­B ﬁne_Straße, x²!") == ["ab", "fine", "strasse", "x2"]
    assert leakage.words("don't 3.5") == ["don", "t", "3", "5"]


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(25)]
    passages = [(i, " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(6)] + [(6, None), (7, "w1 w2"), (8, "")]
    texts = []
    for d in range(120):
        i = rng.randrange(6)
        words = passages[i][1].split()
        start, n = rng.randrange(12), rng.choice([3, 4, 5, 9])
        text = " ".join([*(rng.choice(vocabulary) for _ in range(5)), *words[start : start + n], "zzz", *(rng.choice(vocabulary) for _ in range(9))])
        texts.append((d, text.upper() if d % 3 else text.replace(" ", ", "), i))
    texts += [(200, None, 0), (201, "", 0), (202, "x " * 20_000 + passages[0][1] + " y" * 20_000, 0), (202, "again", 0)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(i, p, "q") for i, p in passages], "item_id bigint, passage string, text string")
    expected = {(d, i) for d, t, _ in texts for i, p in passages if brute_runs(p, t, 4)}
    for limit in (leakage.MAX_SEED_WORDS, 30):
        found = leakage.leaks(docs, items, min_match=4, max_seed_words=limit)
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected
    assert {tuple(r) for r in leakage.leaks_by_shingles(docs, items, 4).collect()} == expected
    # A second passage of an item neither hides the first nor doubles a pair.
    more = items.unionByName(spark.createDataFrame([(0, "w1 w2 w3 w4 w5 zzz", "q"), (9, passages[1][1], "q"), (1, "zzzz " * 20, "q")], items.schema))
    found = leakage.leaks(docs, more, min_match=4)
    pairs = [(r["doc_id"], r["item_id"]) for r in found.where("doc_id < 200").collect()]
    assert {p for p in expected if p[0] < 200} | {(d, 9) for d, i in expected if i == 1 and d < 200} <= set(pairs) and len(pairs) == len(set(pairs))
    assert leakage.leaks(docs.limit(0), items, 4).count() == 0 and leakage.leaks(docs, items.limit(0), 4).count() == 0


def test_tiling_covers_reordered_passages():
    ids = np.arange(1, 31)
    text = np.concatenate([[0], ids[15:], [0, 0], ids[:15], [0]])
    assert sorted(leakage.tile(ids, text, 5)) == [(0, 18, 15), (15, 1, 15)]
    assert leakage.tile(ids, text[:0], 5) == []
    assert leakage.tile(np.array([1, 1, 1, 1]), np.array([1, 1, 1, 1, 1]), 2) == [(0, 0, 4)]


# --- 7. Mixing


def test_tempered_to_targets():
    sizes = {"a": 1000, "b": 100, "c": 10}
    caps = {"a": None, "b": 2.0, "c": 3.0}
    exact = mixing.tempered_to_targets(sizes, {"a": 1, "b": 1, "c": 2, "none": 1}, caps, "exact")
    assert exact["c"][1] == pytest.approx(30) and sum(t for _, t in exact.values()) == pytest.approx(60)
    assert {e for e, _ in exact.values()} == {1.0}
    assert mixing.tempered_to_targets(sizes, {"none": 1}, {}) == {}
    # Two sources meet their limits below their targets, the third takes the rest.
    found = mixing.tempered_to_targets(sizes, {"a": 1, "b": 1, "c": 2}, {"a": 1.0, "b": 2.0, "c": 3.0})
    assert {s: t for s, (_, t) in found.items()} == pytest.approx({"a": 880, "b": 200, "c": 30})
    assert found["a"][0] == 1.0 and 0 < found["b"][0] < 1 and 0 < found["c"][0] < 1
    # The exponent decides the tokens.
    for exponent in (0.0, 0.1, 0.2):
        forced = mixing.tempered_to_targets(sizes, {"a": 1, "b": 1, "c": 2}, {}, exponent=exponent)
        raised = {s: sizes[s] ** (1 - exponent) * g**exponent for s, g in {"a": 1, "b": 1, "c": 2}.items()}
        assert {s: t for s, (_, t) in forced.items()} == pytest.approx({s: 1110 * r / sum(raised.values()) for s, r in raised.items()})
    assert mixing.tempered_to_targets(sizes, {"a": 1, "c": 1}, {"a": 0.0, "c": 0.5}) == {"a": (0.0, 0.0), "c": (pytest.approx(1.0, abs=1), pytest.approx(5.0))}


@given(
    st.lists(st.tuples(st.integers(1, 10**6), st.floats(0.01, 10), st.one_of(st.none(), st.floats(0, 5))), min_size=1, max_size=8),
    st.sampled_from(["corpus", "exact", 1000.0]),
)
@settings(max_examples=200, deadline=None)
def test_budgets_fill_the_total_within_the_limits(rows, total):
    sizes = {f"s{i}": n for i, (n, _, _) in enumerate(rows)}
    targets, caps = {f"s{i}": t for i, (_, t, _) in enumerate(rows)}, {f"s{i}": c for i, (_, _, c) in enumerate(rows)}
    found = mixing.tempered_to_targets(sizes, targets, caps, total)
    limit = {s: math.inf if caps[s] is None else caps[s] * sizes[s] for s in sizes}
    assert all(t <= limit[s] * (1 + 1e-6) + 1e-6 for s, (_, t) in found.items())
    if total != "exact":
        goal = min(sum(sizes.values()) if total == "corpus" else total, sum(limit.values()))
        assert sum(t for _, t in found.values()) == pytest.approx(goal, rel=1e-6, abs=1e-6)
    # Sources below their limits have shares in proportion to their targets.
    free = [t / targets[s] for s, (_, t) in found.items() if t < limit[s] * (1 - 1e-6)]
    assert not free or max(free) == pytest.approx(min(free), rel=1e-6)


def test_temperature():
    sizes = {"a": 1000, "b": 100, "c": 10}
    _, shares = mixing.temperature(sizes, max_repeats=2.0)
    assert max(shares[s] * 1110 / sizes[s] for s in sizes) == pytest.approx(2.0, rel=1e-6)
    _, shares = mixing.temperature(sizes, target_entropy=0.8)
    assert mixing.entropy(shares) == pytest.approx(0.8, abs=1e-6)


def test_tempered_plan(spark):
    docs = spark.createDataFrame([(i, "abbcccc"[i % 7], 10) for i in range(700)], "doc_id bigint, source string, tokens bigint")
    report = {r["source"]: r for r in mixing.tempered_plan(docs, evenness=0.95).report().collect()}
    assert mixing.entropy({s: r["actual_share"] for s, r in report.items()}) == pytest.approx(0.95 * math.log(3), abs=0.01)
    report = {r["source"]: r for r in mixing.tempered_plan(docs, max_repeats=1.5).report().collect()}
    assert report["a"]["repeats"] == pytest.approx(1.5, abs=0.02) and report["a"]["exponent"] < 1
    assert mixing.tempered_plan(docs.limit(0), evenness=0.9).report().count() == 0


def test_mixture_meets_its_budgets(spark):
    rng = random.Random(7)
    docs = [(i, rng.choice(["a"] * 8 + ["b"]), rng.randrange(1, 200)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame(
        [("s", "A ", 0.5, 2.0), ("s", "b", 0.5, 1.5), ("t", "a", 1.0, None), ("t", "no", 1.0, 1.0), ("u", "no", 1.0, 1.0), ("s", None, 1.0, 1.0), ("s", "a", None, None)],
        "scenario string, source string, target_share double, max_repeats double")
    plan = mixing.plan(df, targets, "exact")
    report = {(r["scenario"], r["source"]): r for r in plan.report().collect()}
    assert abs(report["s", "a"]["actual_share"] - 0.5) < 0.01 and report["s", "b"]["repeats"] == pytest.approx(1.5, abs=0.01)
    assert report["t", "a"]["actual_share"] == 1.0 and report["t", "a"]["repeats"] == 1.0
    assert report["t", "no"]["tokens"] == 0 and report["u", "no"]["actual_share"] == 0.0
    chosen = plan.selection()
    assert chosen.groupBy("scenario", "doc_id").count().where("count > 1").count() == 0
    assert chosen.where("scenario = 's' and source = 'b'").agg({"copies": "max"}).first()[0] == 2
    assert rows(chosen) == rows(mixing.plan(df.repartition(7), targets, "exact").selection())
    assert mixing.plan(df.limit(0), targets).selection().count() == 0
    assert mixing.plan(df, targets.limit(0)).report().count() == 0


def test_sizes_in_tokens(spark):
    docs = spark.createDataFrame([(1, "hello hello world", " Docs-Site "), (2, None, "a"), (3, "", "a"), (4, "x", None), (5, "<|endoftext|>", "a")], "doc_id bigint, text string, source string")
    found = {r["doc_id"]: (r["source"], r["tokens"]) for r in mixing.sized(docs).collect()}
    assert found[1] == ("docs_site", 3) and set(found) == {1, 5} and found[5][1] > 1


# --- 8. Subjects


WORDS = {"law": "court statute plaintiff appeal verdict", "sport": "goal referee league striker penalty", "food": "oven recipe flour butter simmer"}


def texts_about(rng, subject, n, other=None, m=0):
    def one(s):
        a, b = rng.sample(WORDS[s].split(), 2)
        return rng.choice([f"The {a} was compared with the {b} again.", f"Someone keeps the {a} next to a {b}.", f"What happens to the {a} of the {b}?"])

    filler = ["This page was last seen in the spring.", "Comments are welcome in the usual place."]
    lines = [one(subject) for _ in range(n)] + [one(other) for _ in range(m)] + filler
    rng.shuffle(lines)
    return " ".join(lines)


def test_subjects(spark):
    rng = random.Random(8)
    truth, docs = {}, []
    for i in range(300):
        a, b = rng.sample(sorted(WORDS), 2)
        m = rng.choice([0, 0, 1, 5])
        docs.append((i, texts_about(rng, a, 8, b, m), rng.choice(["en", "EN", None]), "x"))
        truth[i] = {a, b} if m == 5 else {a}
    docs += [(900, None, "en", ""), (901, "", "en", ""), (902, "no sentence", "en", ""), docs[0]]
    labels = [(i, rng.choice([s, s.upper(), f" {s}"]), "r") for i in range(0, 300, 4) for s in truth[i]]
    labels += [(4, "food", "r"), (5, None, "r"), (6, "unheard of", "r"), (None, "law", "r"), (900, "law", "r")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, subject string")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, rater string")
    names = spark.createDataFrame([(s, "") for s in WORDS], "subject string, description string")
    options = subjects.Options(dimensions=20, max_share=0.6, telling=0.1)
    found = subjects.two_at_most(subjects.subjects_of(df, lab, names, options))
    mine = {}
    for r in found.collect():
        mine.setdefault(r["doc_id"], set()).add(r["subject"])
    assert sum(mine.get(i) == s for i, s in truth.items()) >= 0.95 * len(truth)
    assert not {900, 901, 902} & set(mine)
    assert subjects.subjects_of(df, lab.limit(0), names, options).count() == 0
    assert subjects.subjects_of(df.limit(0), lab, names, options).count() == 0
    counts = subjects.composition(found, df)
    assert counts.count() == 3


def test_sentences():
    text = 'Title here\n\n"Escrow balance" here means a lot. No. The camelCase word stays, v1.2 too! a line of words that goes on and on without an end\n- short item'
    coder = subjects.Coder()
    codes, lengths = coder([text, None, "", "Only a title", "Das Übermaß ist groß."])
    assert lengths.tolist() == [len(codes) - 5, 0, 0, 0, 5]
    codes = codes[: lengths[0]]
    back = {coder([f"{w} {w} {w}."])[0][0]: w for w in "escrow balance here means a lot the camel case word stays v too line of words that goes on and without an end".split()}
    sentences = " ".join("|" if c == subjects.MARK else back[c] for c in codes.tolist())
    assert sentences == (
        "escrow balance here means a lot | the camel case word stays v too | a line of words that goes on and on without an end |"
    )


def test_codes_do_not_depend_on_place_or_neighbours():
    coder = subjects.Coder()
    alone = [coder([t])[0].tolist() for t in ("Ärger im Übermaß (sic!). Next 'one' ends here.", "a &amp; b &lt; c.", "x" * 70_000 + " y z.", "\ud800 odd one out.")]
    together = coder(["Ärger im Übermaß (sic!). Next 'one' ends here.", "a &amp; b &lt; c.", "x" * 70_000 + " y z.", "\ud800 odd one out."])[0].tolist()
    assert sum(alone, []) == together and alone[1].count(subjects.MARK) == 1
    assert alone[0].count(subjects.MARK) == 2 and len(alone[2]) == 4


def test_documents_are_counted_per_word():
    coder, counter = subjects.Coder(), subjects.Counter()
    for texts in (["one two two three.", "two three four."], ["two five six.", "", None]):
        counter.add(*coder(texts))
    words, counts = counter.merged()
    known = {coder([f"{w} {w} {w}."])[0][0]: w for w in "one two three four five six".split()}
    found = {known.get(w, "all"): n for w, n in zip(words.tolist(), counts.tolist())}
    assert found == {"all": 5, "one": 1, "two": 3, "three": 2, "four": 1, "five": 1, "six": 1}


def test_positions_and_sketch_against_plain_arithmetic():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(-(2**31), 2**31, 5000).astype(np.int32))
    space = subjects.Space(codes, np.ones(len(codes), np.float32))
    asked = np.concatenate([codes, rng.integers(-(2**31), 2**31, 5000).astype(np.int32)])
    place = {c: i for i, c in enumerate(codes.tolist())}
    assert space.positions(asked).tolist() == [place.get(c, -1) for c in asked.tolist()]
    x = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 90))
    root = subjects.factor(x.T @ x @ subjects.omega(90, 40))
    assert np.allclose(root @ root.T, x.T @ x, atol=1e-3 * np.abs(x.T @ x).max())
    truth = np.linalg.svd(x)[2][:12].T
    assert np.allclose(np.abs(np.linalg.svd(truth.T @ subjects.leading(root, 12))[1]), 1, atol=1e-4)
