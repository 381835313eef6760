"""Registered queries of the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import (
    cache,
    chunk,
    dense,
    evaluation,
    fusion,
    lexical,
    parity,
    readers,
    snapshot_diff,
    tracker,
)
from quillspark.session import broadcast_small, load, new_path, scratch
from quillspark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- Lexical retrieval -------------------------------------------------------


def _tok(column: str) -> str:
    spaced = rf"regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g')"
    return rf"list_filter(regexp_split_to_array({spaced}, '\s+'), lambda w: w <> '')"


def _index_sql(source: str = "select doc_id as chunk_id, coalesce(text, '') as t from documents") -> str:
    return f"""
texts as ({source}),
tokenized as (select chunk_id, {_tok('t')} as terms from texts),
docs as (select chunk_id, len(terms)::bigint as length from tokenized),
postings as (
  select chunk_id, term, count(*) as tf from (select chunk_id, unnest(terms) as term from tokenized) group by all
),
stats as (select count(*) as n, coalesce(sum(length), 0)::bigint as total, coalesce(avg(length), 0) as average from docs),
rarity as (
  select term, count(*) as df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf
  from postings, stats group by term, n
)"""


def _bm25_sql(source: str | None = None, n: int = 20) -> str:
    index = _index_sql(source) if source else _index_sql()
    return f"""{index},
asked as (
  select distinct item_id as query_id, unnest({_tok('question')}) as term from eval_items
),
lexical_scores as (
  select query_id, chunk_id,
    round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / case when average = 0 then 1 else average end))), 6) as score
  from asked join postings using (term) join rarity using (term) join docs using (chunk_id), stats
  group by query_id, chunk_id
),
lexical_ranked as (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from lexical_scores
  qualify rank <= {n}
)"""


def _built(spark: SparkSession, sf_dir: str) -> lexical.Index:
    return lexical.build(load(spark, sf_dir, "documents"), "doc_id")


def _index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """Written once, since a search reads its tables several times."""
    return lexical.stored(_built(spark, sf_dir))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "eval_items")
    return items.select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))


@query(f"with {_index_sql()} select chunk_id, term, tf from postings")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document holds each term."""
    return _built(spark, sf_dir).postings


@query(f"with {_index_sql()} select chunk_id, length from docs")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return _built(spark, sf_dir).docs


@query(f"with {_index_sql()} select n as doc_count, total as sum_lengths, round(average, 6) as avg_length from stats")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus statistics of the index."""
    return _built(spark, sf_dir).stats().withColumn("avg_length", F.round("avg_length", 6))


@query(f"with {_index_sql()} select term, df, round(idf, 9) as idf from rarity")
def inverse_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and rarity of every term."""
    return lexical.idf(_index(spark, sf_dir)).withColumn("idf", F.round("idf", 9))


@query(f"with {_bm25_sql()} select query_id, chunk_id, score, rank from lexical_ranked")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 documents for every question."""
    return lexical.search(_index(spark, sf_dir), _questions(spark, sf_dir))


_WITHOUT_GERMAN = "select doc_id as chunk_id, coalesce(text, '') as t from documents where lang is distinct from 'de'"


@query(f"with {_bm25_sql(_WITHOUT_GERMAN)} select query_id, chunk_id, score, rank from lexical_ranked")
def bm25_after_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the documents marked German left the index."""
    gone = load(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("chunk_id"))
    return lexical.search(lexical.remove(_index(spark, sf_dir), gone), _questions(spark, sf_dir))


_REPLACED = (
    "select doc_id as chunk_id, case when lang = 'de' then doc_path || ' ' || coalesce(source, '')"
    " else coalesce(text, '') end as t from documents"
)


@query(f"with {_bm25_sql(_REPLACED)} select query_id, chunk_id, score, rank from lexical_ranked")
def bm25_after_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after those documents were replaced by path and source."""
    fresh = load(spark, sf_dir, "documents").where("lang = 'de'").select(
        "doc_id", F.concat(F.col("doc_path"), F.lit(" "), F.coalesce("source", F.lit(""))).alias("text")
    )
    return lexical.search(lexical.upsert(_index(spark, sf_dir), fresh, "doc_id"), _questions(spark, sf_dir))


_WITH_PREAMBLE = (
    "select doc_id as chunk_id, case when coalesce(source, '') = '' then coalesce(text, '')"
    " else source || chr(10) || chr(10) || coalesce(text, '') end as t from documents"
)


@query(f"with {_bm25_sql(_WITH_PREAMBLE)} select query_id, chunk_id, score, rank from lexical_ranked")
def contextual_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a preamble above every text."""
    docs = load(spark, sf_dir, "documents")
    text = fusion.contextual_text(F.col("source"), F.coalesce("text", F.lit("")))
    index = lexical.build(docs.select("doc_id", text.alias("text")), "doc_id")
    return lexical.search(index, _questions(spark, sf_dir))


@query(f"with {_index_sql()}, one as (select max(chunk_id) as chunk_id from docs) select chunk_id, term, tf from postings join one using (chunk_id)")
def posting_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lookup of one document's postings in the index."""
    index = _index(spark, sf_dir)
    return lexical.lookup(index, index.docs.agg(F.max("chunk_id")).first()[0])


@query(f"with {_index_sql()} select n as doc_count, total as sum_lengths, (select count(*) from postings) as postings from stats")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written, read and counted."""
    path = new_path(spark, "index")
    _built(spark, sf_dir).write(path)
    index = lexical.Index.read(spark, path)
    postings = index.postings.agg(F.count("*").alias("postings"))
    return index.stats().select("doc_count", "sum_lengths").crossJoin(postings)


@query(
    f"""with {_index_sql()}
select term, count(distinct source) as sources, count(*) as documents
from postings join (select doc_id as chunk_id, lower(trim(source)) as source from documents) using (chunk_id)
group by term"""
)
def term_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many sources each term occurs."""
    sources = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.lower(F.trim("source")).alias("source")
    )
    return _index(spark, sf_dir).postings.join(sources, "chunk_id").groupBy("term").agg(
        F.count_distinct("source").alias("sources"), F.count("*").alias("documents")
    )


# --- Dense and hybrid retrieval ----------------------------------------------

_DENSE = """
dense_scores as (
  select q.{id} as query_id, r.vec_id as chunk_id,
    round(list_cosine_similarity(q.e, r.embedding::double[]), 5) as score
  from ({queries}) q, embeddings r
),
dense_ranked as (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from dense_scores
  qualify rank <= {n}
)"""

_FIFTIETH = "select vec_id, embedding::double[] as e from embeddings where vec_id % 50 = 0"
_BY_ITEM = "select item_id, embedding::double[] as e from eval_items join embeddings on vec_id = item_id % 500"


@query(
    f"with {_DENSE.format(id='vec_id', queries=_FIFTIETH, n=20)} select query_id, chunk_id, score, rank from dense_ranked"
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 of all vectors for the stated query set (ids divisible by 50)."""
    table = load(spark, sf_dir, "embeddings")
    asked = table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.search(dense.records(table, "vec_id", "embedding"), asked)


@query(
    """
select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as cosine
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1
"""
)
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with the next one."""
    table = load(spark, sf_dir, "embeddings")
    after = table.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return table.join(after, "vec_id").select(
        "vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine")
    )


_HYBRID = f"""{_bm25_sql(n=150)}, {_DENSE.format(id='item_id', queries=_BY_ITEM, n=150)},
joined as (
  select coalesce(d.query_id, l.query_id) as query_id, coalesce(d.chunk_id, l.chunk_id) as chunk_id,
    round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + l.rank), 0), 9) as fused_score,
    d.score as dense_score, l.score as lexical_score, d.rank as dense_rank, l.rank as lexical_rank
  from dense_ranked d full join lexical_ranked l on d.query_id = l.query_id and d.chunk_id = l.chunk_id
),
candidates as (
  select *, row_number() over (partition by query_id order by fused_score desc,
    dense_score desc nulls last, lexical_score desc nulls last, chunk_id) as rank
  from joined qualify rank <= 150
)"""


class LexicalQuerier:
    """The lexical index as a querier."""

    def __init__(self, index: lexical.Index) -> None:
        self.index = index

    def query_batch(self, queries: DataFrame, top_n: int) -> DataFrame:
        return lexical.search(self.index, queries.select("query_id", "query"), top_n)


class DenseQuerier:
    """The vector table as a querier."""

    def __init__(self, index: DataFrame) -> None:
        self.index = index

    def query_batch(self, queries: DataFrame, top_n: int) -> DataFrame:
        return dense.search(self.index, queries.select("query_id", "embedding"), top_n)


def _hybrid(spark: SparkSession, sf_dir: str, index: lexical.Index | None = None) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    asked = _questions(spark, sf_dir).join(
        vectors.select("vec_id", "embedding"), F.col("query_id") % 500 == F.col("vec_id")
    )
    return fusion.retrieve(
        asked, DenseQuerier(dense.records(vectors, "vec_id", "embedding")), LexicalQuerier(index or _index(spark, sf_dir))
    )


@query(f"with {_HYBRID} select * from candidates")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings of every question, fused."""
    return _hybrid(spark, sf_dir)


_TEXTS = "(select doc_id as chunk_id, text from documents where text is not null)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@query(
    f"""with {_HYBRID}
select query_id, chunk_id, fused_score, row_number() over (partition by query_id order by rank) - 1 as final_rank
from candidates join {_TEXTS} using (chunk_id) qualify final_rank < 20
"""
)
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final 20 without a provider."""
    done = fusion.rerank(_hybrid(spark, sf_dir), _chunks(spark, sf_dir))
    return done.select("query_id", "chunk_id", "fused_score", "final_rank")


@query(
    f"""with {_HYBRID},
given as (
  select query_id, chunk_id, len(list_intersect(
      list_distinct({_tok("coalesce(question, '')")}), list_distinct({_tok('text')}))) as overlap
  from candidates join {_TEXTS} using (chunk_id) join eval_items on item_id = query_id
),
placed as (
  select *, row_number() over (partition by query_id order by overlap desc, chunk_id) - 1 as final_rank
  from given where overlap > 0
)
select query_id, chunk_id, overlap::double as reranker_score, final_rank from placed where final_rank < 20
"""
)
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final 20 by the number of shared terms, counted on postings; others drop out."""
    index = _index(spark, sf_dir)
    candidates = scratch(_hybrid(spark, sf_dir, index), "candidates")
    there = _chunks(spark, sf_dir).where("text is not null").select("chunk_id").distinct()
    asked = _questions(spark, sf_dir).select(
        "query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term")
    )
    few = broadcast_small(asked, lexical.FEW_TERMS)
    shared = (
        index.postings.join(few, "term").join(broadcast_small(candidates.select("query_id", "chunk_id"), 100_000), ["query_id", "chunk_id"])
        .groupBy("query_id", "chunk_id").agg(F.count("*").alias("score"))
    )
    given = shared.join(there, "chunk_id", "left_semi").select(
        "query_id", "chunk_id", F.struct((-F.col("score")).alias("s"), "chunk_id").alias("position"), "score"
    )
    done = fusion.by_provider(candidates, given, fusion.FINAL)
    return done.select("query_id", "chunk_id", "reranker_score", "final_rank")


def _shared_terms(query: str, texts: list[str]) -> list[tuple[int, float]]:
    """A reranking provider: places by shared terms, texts without any left out."""
    import regex

    def terms(text: str) -> set[str]:
        return set(regex.sub(r"[^\p{L}\p{N}\s]", " ", text.lower()).split())

    asked = terms(query or "")
    counts = [len(asked & terms(t)) for t in texts]
    return sorted(((i, float(n)) for i, n in enumerate(counts) if n), key=lambda x: (-x[1], x[0]))


@query(
    f"""with {_HYBRID},
given as (
  select query_id, chunk_id, rank, len(list_intersect(
      list_distinct({_tok("coalesce(question, '')")}), list_distinct({_tok('text')}))) as overlap
  from candidates join {_TEXTS} using (chunk_id) join eval_items on item_id = query_id
),
answered as (select distinct query_id from given where overlap > 0),
placed as (
  select *, row_number() over (partition by query_id order by overlap desc, rank) - 1 as final_rank
  from given where overlap > 0
),
rest as (
  select *, row_number() over (partition by query_id order by rank) - 1 as final_rank
  from given where query_id not in (select query_id from answered)
)
select query_id, chunk_id, overlap::double as reranker_score, final_rank from placed where final_rank < 20
union all select query_id, chunk_id, null, final_rank from rest where final_rank < 20
"""
)
def rerank_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final 20 through a provider that is called once per query with its candidates' texts."""
    done = fusion.rerank(_hybrid(spark, sf_dir), _chunks(spark, sf_dir), _shared_terms, _questions(spark, sf_dir))
    return done.select("query_id", "chunk_id", "reranker_score", "final_rank")


# --- Evaluation ----------------------------------------------------------------

_MATCHED = """
{name} as (
  select item_id as question_id, coalesce(bool_or(
    len(list_filter(expected_substrings, lambda s: contains(text, s))) > 0), false) as matched
  from eval_items left join {ranked} r on r.query_id = item_id
    left join (select doc_id as chunk_id, text from documents) using (chunk_id)
  group by item_id
)"""


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "eval_items").select(
        F.col("item_id").alias("question_id"), F.col("expected_substrings").alias("expected")
    )


@query(
    f"""with {_bm25_sql()}, {_MATCHED.format(name='m', ranked='lexical_ranked')}
select count(*) as attempted, count(*) filter (matched) as matched,
  round(1 - count(*) filter (matched) / count(*), 9) as failure_rate,
  1 - count(*) filter (matched) / count(*) <= 0.065 as passed
from m
"""
)
def recall_at_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One minus recall at 20 of the lexical tier."""
    hits = lexical.search(_index(spark, sf_dir), _questions(spark, sf_dir))
    found = evaluation.matched(hits, _chunks(spark, sf_dir), _expected(spark, sf_dir))
    return evaluation.summary(found, 0.065).withColumn("failure_rate", F.round("failure_rate", 9))


@query(
    f"""with {_HYBRID},
first20 as (select * from lexical_ranked where rank <= 20),
final20 as (
  select query_id, chunk_id, row_number() over (partition by query_id order by rank) as r
  from candidates join {_TEXTS} using (chunk_id) qualify r <= 20
),
{_MATCHED.format(name='m1', ranked='first20')}, {_MATCHED.format(name='m3', ranked='final20')},
caught as (
  select case when m1.matched then 'tier1' when m3.matched then 'tier3' else 'missed' end as caught_at
  from m1 left join m3 using (question_id)
)
select s.caught_at, count(c.caught_at) as questions
from (select unnest(['tier1', 'tier2', 'tier3', 'missed', 'unknown']) as caught_at) s
  left join caught c using (caught_at) group by s.caught_at
"""
)
def caught_at_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which tier each question is first answered."""
    chunks, asked = _chunks(spark, sf_dir), _expected(spark, sf_dir)
    index = _index(spark, sf_dir)
    first = lexical.search(index, _questions(spark, sf_dir))
    final = fusion.rerank(_hybrid(spark, sf_dir, index), chunks).select(
        "query_id", "chunk_id", (F.col("final_rank") + 1).alias("rank")
    )
    tier1 = evaluation.matched(first, chunks, asked)
    tier3 = evaluation.matched(final, chunks, asked)
    return evaluation.breakdown(evaluation.caught_at(tier1, None, tier3))


# Length in UTF-16 units: characters, and those beyond the basic plane again.
_UNITS = r"length({c}) + length(regexp_replace({c}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))"

# --- Readers and scalar functions ----------------------------------------------


@query(
    """
select doc_id, sha256(text) as sha, ceil(({units}) / 4)::bigint as approx_tokens from documents
where text is not null
""".replace("{units}", _UNITS.format(c="text"))
)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash and approximate size of every text."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    return docs.select(
        "doc_id", F.sha2("text", 256).alias("sha"), T.approx_tokens(F.col("text")).cast("bigint").alias("approx_tokens")
    )


@query(
    r"""
with eol as (
  select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as c from documents where text is not null
),
cut as (select doc_id, left(c, 2000) as c from eol),
split as (
  select doc_id, c, regexp_extract(c, '^---\n((?s:.*?))\n---\n?', 1) as front,
    regexp_replace(c, '^---\n(?s:.*?)\n---\n?', '') as body
  from cut
)
select doc_id, sha256(front) as front_sha, sha256(body) as body_sha, length(c)::bigint as kept from split
"""
)
def frontmatter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with normal line ends, cut to a limit, split at the front matter."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    c = readers.limited(T.normal_eol(F.col("text")), 2000)
    return docs.select(
        "doc_id", F.sha2(T.front_block(c), 256).alias("front_sha"), F.sha2(T.front_body(c), 256).alias("body_sha"),
        F.length(c).cast("bigint").alias("kept"),
    )


@query(
    r"""
with eol as (
  select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as c from documents where text is not null
),
split as (
  select doc_id, c, regexp_extract(c, '^---\n((?s:.*?))\n---\n?', 1) as front,
    regexp_replace(c, '^---\n(?s:.*?)\n---\n?', '') as body
  from eol
)
select doc_id, sha256(front) as front_sha, sha256(body) as body_sha, length(c)::bigint as kept from split
"""
)
def frontmatter_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with normal line ends, split at the front matter."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    c = readers.limited(T.normal_eol(F.col("text")), None)
    return docs.select(
        "doc_id", F.sha2(T.front_block(c), 256).alias("front_sha"), F.sha2(T.front_body(c), 256).alias("body_sha"),
        F.length(c).cast("bigint").alias("kept"),
    )


@query(
    r"""
with c as (select doc_id, '```md' || chr(10) || text || chr(10) || '```' || chr(10) as t from documents where text is not null)
select doc_id, sha256(regexp_extract(t, '^```[a-zA-Z0-9_-]*\n((?s:.*?))\n```\s*$', 1)) as sha from c
"""
)
def unwrap_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts taken out of a fence around all of them."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    wrapped = F.concat(F.lit("```md\n"), F.col("text"), F.lit("\n```\n"))
    return docs.select("doc_id", F.sha2(T.unwrapped(wrapped), 256).alias("sha"))


@query(
    r"""
with eol as (
  select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as c from documents
),
split as (select doc_id, c, regexp_replace(c, '^---\n(?s:.*?)\n---\n?', '') as body from eol)
select doc_id::varchar as url, sha256(body) as body_sha,
  c is null as blocked, case when c is null then 'fetch_failed' end as reason, sha256(body) as source_sha256,
  case when c is not null then 0.0::double end as parry_score, case when c is not null then 'SAFE' end as parry_label,
  case when c is not null then 'stub' end as parry_via, ''::varchar as warnings
from split
"""
)
def markdown_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the markdown reader."""
    docs = load(spark, sf_dir, "documents")
    pages = docs.select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("content"))
    done = readers.read_markdown(pages)
    return done.select(
        "url", F.sha2("body", 256).alias("body_sha"), "blocked",
        "reason", "source_sha256", "parry_score", "parry_label", "parry_via", F.array_join("warnings", ",").alias("warnings"),
    )


_PAGE_SQL = """
pages as (
  select page_id, '<html><head><title>p</title><script>var a = 1;</script></head><body><nav>menu</nav><article><h1>'
    || page_id || '</h1><p>' || replace(replace(replace(markdown, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
    || '</p></article></body></html>' as html
  from bloom_entries where markdown is not null
)"""


def _html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "bloom_entries").where("markdown is not null")
    escaped = F.replace(F.replace(F.replace("markdown", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(
        F.lit("<html><head><title>p</title><script>var a = 1;</script></head><body><nav>menu</nav><article><h1>"),
        F.col("page_id").cast("string"), F.lit("</h1><p>"), escaped, F.lit("</p></article></body></html>"),
    )
    return rows.select("page_id", html.alias("html"))


@query(
    rf"""with {_PAGE_SQL},
bodies as (select page_id, html, regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) as body from pages),
bare as (
  select page_id, html, trim(regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '[\s\x{{00a0}}\x{{feff}}]+', ' ', 'g')) as t from bodies
)
select page_id, length(html) < 512 or length(t) < 100 as js_only from bare
"""
)
def js_only_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's HTML holds too little text."""
    return _html_pages(spark, sf_dir).select("page_id", T.js_only(F.col("html")).alias("js_only"))


@query(
    r"""
with rendered as (
  select page_id, '# ' || page_id || case when t = '' then '' else chr(10) || chr(10) || t end as markdown from (
    select page_id, trim(regexp_replace(markdown, '[\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) as t
    from bloom_entries where markdown is not null)
)
select page_id::varchar as url, sha256(markdown) as markdown_sha, false as truncated, false as blocked, null::varchar as reason,
  'fetch' as fetched_via, 'SAFE' as parry_label, sha256(markdown) as source_sha256
from rendered
"""
)
def html_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through the HTML reader."""
    pages = _html_pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("url"), F.col("html").alias("content"))
    return readers.read_html(pages).select(
        "url", F.sha2("markdown", 256).alias("markdown_sha"), "truncated", "blocked", "reason", "fetched_via",
        "parry_label", "source_sha256",
    )


_XML_SQL = """
select page_id, count(*) over (partition by page_id) as nodes, entry_key as text
from (select distinct page_id, entry_key from bloom_entries)
"""


@query(_XML_SQL)
def xml_sitemap_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locations of one sitemap per page."""
    rows = load(spark, sf_dir, "bloom_entries").select("page_id", "entry_key").distinct()
    xml = F.concat(
        F.lit('<?xml version="1.0"?><urlset><url><loc>'), F.replace("entry_key", F.lit("&"), F.lit("&amp;")),
        F.lit("</loc></url></urlset>"),
    )
    pages = rows.select(F.col("page_id").cast("string").alias("url"), xml.alias("content"))
    return readers.read_xml(pages, "//loc").select(F.col("url").cast("bigint").alias("page_id"), "nodes", "text")


@query(
    """
select distinct page_id, entry_key as key, kind, coalesce(round(parry_score, 4), -1) as score from bloom_entries
"""
)
def js_export_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal exported by one module per page, read back."""
    rows = load(spark, sf_dir, "bloom_entries").select("page_id", "entry_key", "kind", "parry_score").distinct()
    source = F.concat(
        F.lit("// data\nexport const ENTRY = { key: '"), F.col("entry_key"), F.lit("', kind: \""), F.col("kind"),
        F.lit('", score: '), F.coalesce(F.round("parry_score", 4).cast("string"), F.lit("null")), F.lit(", };\n"),
    )
    pages = rows.select(F.col("page_id").cast("string").alias("url"), source.alias("content"))
    done = readers.read_js(pages, "ENTRY")
    value = lambda path, kind: F.variant_get("data", path, kind)
    return done.select(
        F.col("url").cast("bigint").alias("page_id"), value("$.key", "string").alias("key"),
        value("$.kind", "string").alias("kind"), F.coalesce(value("$.score", "double"), F.lit(-1.0)).alias("score"),
    )


@query(
    """
select distinct page_id, case when coalesce(parry_score, 0) >= 0.8 then 'MALICIOUS'
  when coalesce(parry_score, 0) >= 0.3 then 'SUSPICIOUS' else 'SAFE' end as label from bloom_entries
"""
)
def scan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every cached score."""
    rows = load(spark, sf_dir, "bloom_entries")
    return rows.select("page_id", T.classify(F.col("parry_score")).alias("label")).distinct()


@query(
    """
with last as (
  select sha256(markdown) as sha, max(parry_score) as score from bloom_entries
  where markdown is not null and parry_score is not null group by all
)
select distinct page_id::varchar as url, coalesce(score, 0) >= 0.8 as blocked,
  case when coalesce(score, 0) >= 0.8 then 'prompt_injection' end as reason,
  coalesce(score, 0) as parry_score,
  case when coalesce(score, 0) >= 0.8 then 'MALICIOUS' when coalesce(score, 0) >= 0.3 then 'SUSPICIOUS' else 'SAFE' end as parry_label,
  case when score is null then 'stub' else 'api' end as parry_via,
  case when coalesce(score, 0) >= 0.3 and coalesce(score, 0) < 0.8 then 'prompt_injection_suspicious' else '' end as warnings
from bloom_entries left join last on last.sha = sha256(markdown) where markdown is not null and trim(markdown) <> ''
"""
)
def reader_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result columns of pages whose verdicts come from the cache."""
    rows = load(spark, sf_dir, "bloom_entries").where("markdown is not null and trim(markdown) <> ''")
    known = rows.where("parry_score is not null").select(
        F.sha2("markdown", 256).alias("sha"), F.lit(0.3).alias("suspicious"), F.lit(0.8).alias("malicious"),
        F.col("parry_score").alias("score"),
    )
    pages = rows.select(F.col("page_id").cast("string").alias("url"), F.col("markdown").alias("body"))
    done = readers.scan(pages, "body", cache=known).withColumn("source_sha256", F.col("sha"))
    result = readers.tagged(done, F.lit(None).cast("string"), [("body", F.col("body"))])
    return result.select(
        "url", "blocked", "reason", "parry_score", "parry_label", "parry_via", F.array_join("warnings", ",").alias("warnings")
    ).distinct()


@query(
    """
select doc_id, regexp_replace('<a href="./' || lpad((doc_id % 10000)::varchar, 4, '0') || '-x.md">' || coalesce(source, '') || '</a>',
  'href="\\./(\\d{4})-[^"]*\\.md"', 'href="/adr/\\1"', 'g') as html from documents
""".replace("\\\\", "\\")
)
def cross_link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to decision files as routes."""
    link = F.concat(
        F.lit('<a href="./'), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit('-x.md">'),
        F.coalesce("source", F.lit("")), F.lit("</a>"),
    )
    return load(spark, sf_dir, "documents").select("doc_id", T.cross_links(link).alias("html"))


# --- Chunking ------------------------------------------------------------------

_KB_KEY = "chunk_id"


@query()
def chunk_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all knowledge base texts."""
    return chunk.chunk(load(spark, sf_dir, "kb_documents"), _KB_KEY)


@query()
def chunk_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the published boundary rules, stalls included."""
    return chunk.chunk(load(spark, sf_dir, "kb_documents"), _KB_KEY, mode="compat")


_COVERS = """
select distinct chunk_id, md5(coalesce(text, '')) as text_md5, ({units})::bigint as units, true as covered, true as within
from kb_documents where chunk_id is not null
""".replace("{units}", _UNITS.format(c="coalesce(text, '')"))


def _covers(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Per text whether its chunks follow each other without a gap from its start to
    its end, within the size, and hold what stands at their offsets."""
    docs = load(spark, sf_dir, "kb_documents").where("chunk_id is not null").select(
        "chunk_id", F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    keyed = docs.withColumn("key", F.concat_ws("|", "chunk_id", F.md5("text")))
    parts = chunk.chunk(keyed.select("key", "text"), "key", mode=mode)
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "start", "end")))
    seen = parts.groupBy("key").agg(
        ordered.alias("o"), F.bool_and(F.col("token_count") <= 800).alias("within")
    )
    follows = F.forall(F.sequence(F.lit(1), F.size("o")), lambda i: (
        F.when(i == 1, F.element_at("o", i)["start"] == 0)
        .otherwise((F.element_at("o", i)["start"] <= F.element_at("o", F.greatest(i - 1, F.lit(1)))["end"])
                   & (F.element_at("o", i)["start"] > F.element_at("o", F.greatest(i - 1, F.lit(1)))["start"]))
    ))
    units = T.utf16_length(F.col("text"))
    return keyed.join(seen, "key").select(
        "chunk_id", F.md5("text").alias("text_md5"), units.alias("units"),
        (follows & (F.element_at("o", -1)["end"] == units)).alias("covered"), "within",
    )


@query(_COVERS)
def chunk_clean_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the clean rules cover every text."""
    return _covers(spark, sf_dir, "clean")


@query(_COVERS)
def chunk_compat_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the published rules cover every text."""
    return _covers(spark, sf_dir, "compat")


@query(
    """
with kept as (select chunk_id, text from kb_documents where length(text) > 0),
pieces as (
  select chunk_id, text, unnest(generate_series(0, greatest(ceil((length(text) - 3200) / 2800.0), 0)::int)) as n from kept
),
cut as (select chunk_id, n, substring(text, n * 2800 + 1, 3200) as t from pieces)
select chunk_id, n::bigint as ordinal, sha256(t) as sha, ceil(({units}) / 4)::bigint as token_count from cut
""".replace("{units}", _UNITS.format(c="t"))
)
def chunk_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of fixed length."""
    windows = chunk.fixed_windows(load(spark, sf_dir, "kb_documents").select("chunk_id", "text"), "chunk_id")
    return windows.select("chunk_id", "ordinal", F.sha2("text", 256).alias("sha"), "token_count")


# --- Caches ----------------------------------------------------------------------


@query(
    """
select sha, doc_id, copies from (
  select sha256(text) as sha, doc_id, count(*) over (partition by sha256(text)) as copies,
    row_number() over (partition by sha256(text) order by updated_at, doc_id) as r
  from documents where text is not null
) where r = 1
"""
)
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, and how many there are."""
    docs = load(spark, sf_dir, "documents").where("text is not null").select(
        F.sha2("text", 256).alias("sha"), "doc_id", "updated_at"
    )
    first = tracker.first_wins(docs.select("sha", "doc_id", "updated_at"), ["sha"], ["updated_at", "doc_id"])
    copies = docs.groupBy("sha").agg(F.count("*").alias("copies"))
    return first.join(copies, "sha").select("sha", "doc_id", "copies")


_PAYLOAD = """
payload as (
  select entry_key, page_id, kind from bloom_entries where entry_key is not null
  qualify row_number() over (partition by entry_key order by page_id desc, kind desc) = 1
)"""


@query(
    f"""with {_PAYLOAD}
select distinct e.entry_id, p.page_id is not null as hit, p.page_id from entries e left join payload p using (entry_key)
"""
)
def cache_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its cached payload."""
    payload = cache.latest(
        load(spark, sf_dir, "bloom_entries").select("entry_key", "page_id", "kind"), "entry_key", ["page_id", "kind"]
    )
    entries = load(spark, sf_dir, "entries").select("entry_id", "entry_key").distinct()
    found = cache.get(payload, entries.select("entry_key").distinct(), "entry_key")
    return entries.join(found, "entry_key", "left").select("entry_id", F.coalesce("hit", F.lit(False)).alias("hit"), "page_id")


@query(
    f"""with {_PAYLOAD},
fresh as (select entry_key, -1 as page_id, 'warm' as kind from warm_keys)
select entry_key, page_id, kind from payload where entry_key not in (select entry_key from fresh)
union all select entry_key, page_id, kind from fresh
"""
)
def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after all warm keys were put."""
    payload = cache.latest(
        load(spark, sf_dir, "bloom_entries").select("entry_key", "page_id", "kind"), "entry_key", ["page_id", "kind"]
    )
    fresh = load(spark, sf_dir, "warm_keys").select(
        "entry_key", F.lit(-1).cast("bigint").alias("page_id"), F.lit("warm").alias("kind")
    )
    return cache.put(payload, fresh, "entry_key")


@query(
    """
select count(*) as alive from (select distinct entry_id, arrived_at from entries)
where arrived_at + interval 300 second > timestamptz '2026-03-01 00:00:00+00'
"""
)
def cache_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose time to live had not run out at an instant."""
    rows = load(spark, sf_dir, "entries").select("entry_id", "arrived_at").distinct()
    now = F.lit("2026-03-01 00:00:00+00:00").cast("timestamp")
    return cache.alive(cache.with_expiry(rows, F.col("arrived_at")), now).agg(F.count("*").alias("alive"))


# The two published hashes over code units (all keys are of the basic plane), wrapped at 32 bits.
_BLOOM_SQL = """
units as (
  select k, list_transform(range(1, length(k) + 1), lambda i: unicode(substring(k, i::int, 1))::ubigint) as u from keys
),
hashed as (
  select k,
    list_reduce(list_prepend(2166136261::ubigint, u), lambda h, c: (xor(h, c) * 16777619) % 4294967296) as a,
    list_reduce(list_prepend(5381::ubigint, u), lambda h, c: (h * 33 + c) % 4294967296) as b
  from units
),
placed as (
  select k, list_transform(range(0, 7), lambda i: ((a + i::ubigint * case when b = 0 then 1 else b end) % 4294967296 % 958506)::bigint) as indices
  from hashed
)"""


@query(
    f"""with keys as (select distinct entry_key as k from warm_keys where entry_key is not null), {_BLOOM_SQL}
select count(distinct i)::bigint as bits_set, 958506::bigint as bits, 7::bigint as hashes from (select unnest(indices) as i from placed)
"""
)
def bloom_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and set bits of the filter over all warm keys."""
    made = cache.bloom(load(spark, sf_dir, "warm_keys"), "entry_key", 100_000)
    return spark.createDataFrame([(made.popcount(), made.bits, made.hashes)], "bits_set bigint, bits bigint, hashes bigint")


@query(
    f"""with keys as (select distinct entry_key as k from entries where entry_key is not null), {_BLOOM_SQL}
select e.entry_key, p.indices::varchar as indices from entries e left join placed p on p.k = e.entry_key
"""
)
def bloom_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bit positions of every entry key."""
    found = cache.bloom_indices(load(spark, sf_dir, "entries").select("entry_key"), "entry_key", 100_000)
    text = F.concat(F.lit("["), F.array_join("indices", ", "), F.lit("]"))
    return found.select("entry_key", text.alias("indices"))


@query("select distinct e.entry_id from entries e join warm_keys w using (entry_key)")
def bloom_then_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a warm key: the filter first, then the exact semi join."""
    warm = load(spark, sf_dir, "warm_keys")
    entries = load(spark, sf_dir, "entries").select("entry_id", "entry_key")
    likely = cache.maybe_seen(entries, "entry_key", cache.bloom(warm, "entry_key", 100_000))
    return likely.join(warm.select("entry_key"), "entry_key", "left_semi").select("entry_id").distinct()


# --- Tracker -----------------------------------------------------------------------

def _listed(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_ISSUES_SQL = f"""
issues as (
  select snapshot_no, lower(trim(repo)) as repo, issue_number as number, title, plugin,
    case when status in ({_listed(T.STATUSES)}) then status else 'Todo' end as status,
    case when priority in ({_listed(T.PRIORITIES)}) then priority else 'P2' end as priority,
    case when wave in ({_listed(T.WAVES)}) then wave else 'Wave 1' end as wave,
    case when effort in ({_listed(T.EFFORTS)}) then effort else 'M' end as effort, url
  from (select *, row_number() over (partition by snapshot_no, lower(trim(repo)), issue_number
      order by delivered_at desc nulls last, title desc nulls last, plugin desc nulls last, status desc nulls last,
        priority desc nulls last, wave desc nulls last, effort desc nulls last, url desc nulls last) as r
    from project_snapshots where issue_number is not null) where r = 1
),
board as (select * from issues where snapshot_no = (select max(snapshot_no) from issues))"""

_PLUGIN_LIST = _listed(tracker.PLUGINS)
_ISSUE_FIELDS = ["title", "plugin", "status", "priority", "wave", "effort", "url"]


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "project_snapshots").withColumn("repo", F.lower(F.trim("repo")))
    rows = snapshot_diff.latest_rows(
        rows.where("issue_number is not null"), ["snapshot_no", "repo", "issue_number"], "delivered_at", _ISSUE_FIELDS
    )
    return rows.select(
        "snapshot_no", "repo", F.col("issue_number").alias("number"), "title", "plugin",
        T.status_of(F.col("status"), F.lit(None)).alias("status"),
        T.one_of(F.col("priority"), T.PRIORITIES, "P2").alias("priority"),
        T.one_of(F.col("wave"), T.WAVES, "Wave 1").alias("wave"),
        T.one_of(F.col("effort"), T.EFFORTS, "M").alias("effort"), "url",
    )


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _issues(spark, sf_dir)
    last = load(spark, sf_dir, "project_snapshots").where("issue_number is not null").agg(
        F.max("snapshot_no").alias("snapshot_no")
    )
    return issues.join(F.broadcast(last), "snapshot_no", "left_semi")


@query(f"with {_ISSUES_SQL} select snapshot_no, repo, number, status, priority, wave, effort from issues")
def status_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all snapshots with their fields in the known enumerations."""
    return _issues(spark, sf_dir).select("snapshot_no", "repo", "number", "status", "priority", "wave", "effort")


@query(
    f"""with {_ISSUES_SQL},
known as (select unnest([{_PLUGIN_LIST}]) as plugin),
named as (select case when plugin in ({_PLUGIN_LIST}) then plugin else '(unknown)' end as plugin, status from board),
counts as (select plugin, count(*) as total, count(*) filter (status <> 'Done') as open from named group by plugin)
select coalesce(k.plugin, c.plugin) as plugin, coalesce(total, 0) as total, coalesce(open, 0) as open
from known k full join counts c on k.plugin = c.plugin
"""
)
def plugin_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues per plugin on the latest board, zero-filled."""
    return tracker.plugin_counts(_board(spark, sf_dir))


@query(
    f"""with {_ISSUES_SQL}
select s.status, count(b.status) as issues
from (select unnest([{_listed(T.STATUSES)}]) as status) s left join board b using (status)
group by s.status
"""
)
def kanban_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues per column of the latest board."""
    return tracker.status_counts(_board(spark, sf_dir))


@query(
    f"""with {_ISSUES_SQL}
select plugin, repo, number, row_number() over (partition by plugin order by delivered_at, repo, number) as position
from board join arrived using (snapshot_no, repo, number) qualify position <= 6
""".replace("select plugin", """, arrived as (
  select snapshot_no, lower(trim(repo)) as repo, issue_number as number, max(delivered_at) as delivered_at
  from project_snapshots where issue_number is not null group by all
)
select plugin""", 1)
)
def recent_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six issues of every plugin in order of arrival."""
    arrived = load(spark, sf_dir, "project_snapshots").where("issue_number is not null").groupBy(
        "snapshot_no", F.lower(F.trim("repo")).alias("repo"), F.col("issue_number").alias("number")
    ).agg(F.max("delivered_at").alias("delivered_at"))
    board = _board(spark, sf_dir).join(arrived, ["snapshot_no", "repo", "number"])
    rows = tracker.recent(board, "plugin", [F.col("delivered_at"), F.col("repo"), F.col("number")])
    return rows.select("plugin", "repo", "number", "position")


@query(
    f"""with {_ISSUES_SQL}
select repo, number, priority, effort from board where wave = 'Wave 0' and status <> 'Done'
"""
)
def wave_zero_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open issues of the first wave."""
    board = _board(spark, sf_dir).where("wave = 'Wave 0' and status <> 'Done'")
    return board.orderBy(*tracker.board_order(board)).select("repo", "number", "priority", "effort")


@query(
    f"""with {_ISSUES_SQL}
select repo, number, first.snapshot_no as snapshot_no, first.status as status from (
  select repo, number, arg_min({{'snapshot_no': snapshot_no, 'status': status}}, snapshot_no) as first from issues group by repo, number
)
"""
)
def dedup_slug_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each issue as its first snapshot has it."""
    rows = _issues(spark, sf_dir).select("repo", "number", "snapshot_no", "status")
    return tracker.first_wins(rows, ["repo", "number"], ["snapshot_no"])


@query(
    """
select o_orderkey as number, case when o_orderpriority = '1-URGENT' then 'data-cli' else 'meta-repo' end as plugin,
  case when o_orderstatus = 'F' then 'Done' else 'Todo' end as status, 'P2' as priority, 'Wave 1' as wave, 'M' as effort,
  'user' || o_custkey as assignee
from orders where o_orderpriority in ('1-URGENT', '2-HIGH')
"""
)
def issues_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested issue nodes, flattened and filtered by a label."""
    orders = load(spark, sf_dir, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    label = F.when(urgent, "area/data-cli").otherwise("kind/other")
    mark = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "hot").otherwise("cold")
    name = lambda c: F.struct(c.alias("name"))
    nodes = orders.select(
        F.col("o_orderkey").alias("number"), F.lit("t").alias("title"),
        F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("state"), F.lit("u").alias("url"),
        F.struct(F.array(F.struct(F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("login"))).alias("nodes")).alias("assignees"),
        F.struct(F.array(name(mark), name(label)).alias("nodes")).alias("labels"),
        F.struct(F.array(F.struct(
            name(F.lit("Unheard of")).alias("fieldValueByName"), name(F.col("o_orderpriority")).alias("priority"),
            name(F.lit(None).cast("string")).alias("wave"), name(F.lit("?")).alias("effort"),
        )).alias("nodes")).alias("projectItems"),
        F.lit("r").alias("repo"), F.lit("meta-repo").alias("fallback"),
    )
    rows = tracker.with_label(tracker.flatten(nodes), "hot")
    return rows.select("number", "plugin", "status", "priority", "wave", "effort", "assignee")


@query(
    r"""
with parts as (
  select doc_id, unnest(regexp_extract_all(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
    '(?m)^## \[?v?\d+\.\d+\.\d+\]?\s*[(—–-]?\s*(?:\d{4}-\d{2}-\d{2})?\)?')) as head
  from documents where text is not null
)
select doc_id, regexp_extract(head, '(\d+\.\d+\.\d+)', 1) as version,
  regexp_extract(head, '(\d{4}-\d{2}-\d{2})', 1) as date, count(*) as n
from parts group by all
"""
)
def changelog_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions and dates of all changelogs."""
    entries = tracker.changelog_entries(load(spark, sf_dir, "documents").where("text is not null"))
    return entries.groupBy("doc_id", "version", "date").agg(F.count("*").alias("n"))


_DRIFT = """
with declared as (
  select s_nationkey::varchar as plugin, s_name as skill,
    case when s_acctbal < 0 then 'tbd' when s_acctbal < 5000 then 'ported' else 'divergent' end as declared from supplier
),
derived as (
  select s_nationkey::varchar as plugin, s_name as skill,
    case s_suppkey % 3 when 0 then 'tbd' when 1 then 'ported' else 'divergent' end as derived from supplier
)
select plugin, skill, derived, declared from derived left join declared using (plugin, skill)
where declared is distinct from derived and not coalesce(declared = 'divergent' and derived = 'tbd', false)
"""


@query(_DRIFT)
def parity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as skills whose declared status is not the derived one."""
    rows = load(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("plugin"), F.col("s_name").alias("skill"), "s_suppkey", "s_acctbal"
    )
    declared = F.when(F.col("s_acctbal") < 0, "tbd").when(F.col("s_acctbal") < 5000, "ported").otherwise("divergent")
    derived = F.when(F.col("s_suppkey") % 3 == 0, "tbd").when(F.col("s_suppkey") % 3 == 1, "ported").otherwise("divergent")
    return parity.drift(
        rows.select("plugin", "skill", declared.alias("declared")), rows.select("plugin", "skill", derived.alias("derived"))
    )


@query(
    """
with runs as (
  select *, sum(case when event_type <> 'error' then 1 else 0 end) over w as island from events
  window w as (partition by user_id order by ts, event_id rows unbounded preceding)
),
counted as (
  select *, sum(case when event_type = 'error' then 1 else 0 end) over (
    partition by user_id, island order by ts, event_id rows unbounded preceding) as run from runs
)
select user_id, event_id from counted where run = 3 and event_type = 'error'
"""
)
def third_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event at which a user has seen three errors in a row."""
    events = load(spark, sf_dir, "events").select(
        "user_id", "event_id", F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "error").alias("failed")
    )
    return tracker.consecutive_failures(events, "user_id", "at", "failed").select("user_id", "event_id")


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by all")
def events_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming window count, over the finished table."""
    counts = ingest.counts_by_window(load(spark, sf_dir, "events"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n")


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by all")
def events_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: events land as files, state is kept per window, and what
    the query has written when nothing more is there is read."""
    schema = "event_id bigint, ts timestamp, event_type string"
    landing, out = new_path(spark, "landing"), new_path(spark, "windows")
    events = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    # In order of time, so that no file is later than the delay allows.
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(landing)
    counts = ingest.counts_by_window(ingest.landed(spark, landing, schema))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    started = (
        counts.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    )
    started.awaitTermination()
    # Of a window's updates the last holds its count.
    seen = spark.read.parquet(out).groupBy("window", "event_type").agg(F.max("n").alias("n"))
    return seen.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# --- Snapshots ----------------------------------------------------------------------


@query(
    """
with cleaned as (
  select snapshot_no, lower(trim(repo)) as repo, issue_number,
    lower(trim(coalesce(status, ''))) as s, lower(trim(coalesce(priority, ''))) as p,
    row_number() over (partition by snapshot_no, lower(trim(repo)), issue_number
      order by delivered_at desc nulls last, status desc nulls last, priority desc nulls last) as r
  from project_snapshots where issue_number is not null
),
current as (select * from cleaned where r = 1),
numbers as (select distinct snapshot_no as n from project_snapshots),
pairs as (select n from numbers where n - 1 in (select n from numbers))
select (coalesce(b.snapshot_no, a.snapshot_no + 1))::int as snapshot_no,
  coalesce(b.repo, a.repo) as repo, coalesce(b.issue_number, a.issue_number) as issue_number,
  case when a.repo is null then 'added' when b.repo is null then 'removed' else 'changed' end as change_kind
from current a full join current b
  on a.repo = b.repo and a.issue_number = b.issue_number and a.snapshot_no + 1 = b.snapshot_no
where coalesce(b.snapshot_no, a.snapshot_no + 1) in (select n from pairs)
  and (a.repo is null or b.repo is null or a.s <> b.s or a.p <> b.p)
"""
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues added, removed or changed between consecutive snapshots."""
    changes = snapshot_diff.issue_changes(load(spark, sf_dir, "project_snapshots"))
    return changes.drop("changed_fields")
