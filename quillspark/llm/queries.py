"""Registered queries of the training-data operators, and their SQL.

Names start with the number of the problem.  Every query reads its whole
tables with the operator's production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import boilerplate, leakage, mixing, neighbours, seen, splitter, subjects
from quillspark.session import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks with cosine of at least 0.90, one among the other's five nearest."""
    return neighbours.mutual_cases(neighbours.most_similar(load(spark, sf_dir, "index_records")))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's five nearest chunks in order, however far they are."""
    lists = neighbours.most_similar(load(spark, sf_dir, "index_records"), complete=True)
    return lists.select(
        F.col("key").alias("chunk_id"), "neighbour",
        F.round("cosine", 5).alias("cosine"), F.col("rank").cast("bigint").alias("rank"),
    )


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the five nearest against brute force over all rows, asked for every
    chunk whose number (the first eight digits of its id) is divisible by 50."""
    records = load(spark, sf_dir, "index_records")
    lists = neighbours.most_similar(records, complete=True)
    asked = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") % 50 == 0
    return neighbours.recall(records, lists, asked)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose key was recorded before."""
    return seen.seen_in_order(load(spark, sf_dir, "entries"), load(spark, sf_dir, "warm_keys"))


def p3_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's answers held against a second method over all entries."""
    entries, warm = load(spark, sf_dir, "entries"), load(spark, sf_dir, "warm_keys")
    records = seen.as_records(entries)
    answered = seen.seen_in_order(entries, warm).withColumnRenamed("entry_id", "id")
    return seen.error_rate(records, answered, lambda r: seen.seen_by_sort(r, seen.history(warm)))


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitter.with_limits(
        load(spark, sf_dir, "kb_documents"), load(spark, sf_dir, "chunk_options")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts beyond their limit, and whether a single line is."""
    return splitter.oversized(splitter.split_items(_limited(spark, sf_dir), "chunk_id", "text"), "chunk_id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves."""
    return splitter.split_items(_limited(spark, sf_dir), "chunk_id", "text")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits, overlaps and lossless pieces of every text that is split."""
    return splitter.restored(_limited(spark, sf_dir), "chunk_id", "text").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share at least twelve consecutive words with an item's passage."""
    found = leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each leaked passage a document holds."""
    found = leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))
    return found.withColumn("coverage", F.round("coverage", 6)).distinct()


def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ``p6_found`` that a join of all runs of words does not give, or the other way round."""
    documents, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")
    found = leakage.leaks(documents, items).select("doc_id", "item_id").distinct().withColumn("s", F.lit(1))
    other = leakage.leaks_by_shingles(documents, items).withColumn("s", F.lit(-1))
    pairs = found.unionByName(other).groupBy("doc_id", "item_id").agg(F.sum("s").alias("s"))
    return pairs.agg(F.count_if(F.col("s") != 0).alias("differing"), (F.count("*") > 0).alias("any_found"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "bloom_entries").where("kind = 'content'")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages that are not the page's own article."""
    return boilerplate.boilerplate_lines(_pages(spark, sf_dir)).distinct()


def p5_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of each page."""
    return boilerplate.main_content(_pages(spark, sf_dir)).distinct()


def p5_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page its lines that are not blank, and whether each is either content or template."""
    pages = _pages(spark, sf_dir).where("markdown is not null").select("page_id", "entry_key", "markdown").distinct()
    filled = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"[^\s\p{Z}]")))
    out = boilerplate.boilerplate_lines(pages).distinct().groupBy("page_id").agg(F.count("*").alias("out"))
    kept = boilerplate.main_content(pages)
    counts = pages.select("page_id", filled(F.col("markdown")).alias("lines")).join(kept, "page_id").join(out, "page_id", "left")
    whole = filled(F.col("content")) + F.coalesce("out", F.lit(0)) == F.col("lines")
    return counts.select("page_id", F.col("lines").cast("bigint").alias("lines"), whole.alias("parted"))


def _mixture(spark: SparkSession, sf_dir: str, total: str = "corpus", **size) -> mixing.Plan:
    documents = mixing.sized(load(spark, sf_dir, "documents"), **size)
    return mixing.plan(documents, load(spark, sf_dir, "mix_targets"), total)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scenario the documents of the mixture and how often each is taken."""
    return _mixture(spark, sf_dir).selection()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares per scenario and source."""
    return _mixture(spark, sf_dir).report()


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every source is within one document of its budget and within its limit."""
    plan = _mixture(spark, sf_dir)
    largest = plan.documents.groupBy("source").agg(F.max("tokens").alias("largest"))
    report = plan.report().join(plan.budgets.select("scenario", "source", "budget"), ["scenario", "source"])
    near = F.abs(F.col("tokens") - F.col("budget")) <= F.coalesce("largest", F.lit(0))
    few = F.col("max_repeats").isNull() | (F.col("most_copies") <= F.ceil("max_repeats"))
    return report.join(largest, "source", "left").select("scenario", "source", (near & few).alias("kept"))


def p7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares at the largest total at which every target holds exactly."""
    return _mixture(spark, sf_dir, "exact").report()


def p7_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources, the exponent bisected to 0.9 of the greatest entropy."""
    return mixing.tempered_plan(mixing.sized(load(spark, sf_dir, "documents")), evenness=0.9).report()


def p7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources, as even as four passes over the smallest allow."""
    return mixing.tempered_plan(mixing.sized(load(spark, sf_dir, "documents")), max_repeats=4.0).report()


def p7_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets and their shares with sizes in characters, so that SQL can count them."""
    budgets = _mixture(spark, sf_dir, vocabulary=None).budgets
    whole = Window.partitionBy("scenario")
    return budgets.select(
        "scenario", "source", "available", F.round("budget", 2).alias("budget"),
        F.round(F.coalesce(F.col("budget") / F.sum("budget").over(whole), F.lit(0.0)), 6).alias("share"),
        F.round(F.when(F.col("available") > 0, F.col("budget") / F.col("available")).otherwise(0.0), 6).alias("repeats"),
    )


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(
        load(spark, sf_dir, "documents"),
        load(spark, sf_dir, "subject_labels"),
        load(spark, sf_dir, "subjects"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that at least a fifth of a document's sentences speak of."""
    return subjects.two_at_most(_subjects(spark, sf_dir))


def p8_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, and whether nine in ten have exactly the (noisy) labels' subjects."""
    labels, names = load(spark, sf_dir, "subject_labels"), load(spark, sf_dir, "subjects")
    there = load(spark, sf_dir, "documents").where("text is not null").select("doc_id").distinct()
    clean = labels.select("doc_id", subjects.clean_subject(F.col("subject")).alias("subject"))
    told = clean.join(names.select("subject"), "subject", "left_semi").join(there, "doc_id", "left_semi")
    sets = lambda df, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias(name))
    found = sets(subjects.two_at_most(_subjects(spark, sf_dir)), "found")
    both = sets(told, "told").join(found, "doc_id", "left")
    return both.agg(
        F.count("*").alias("labelled"),
        (F.count_if(F.col("told") == F.coalesce("found", F.array().cast("array<string>"))) >= 0.9 * F.count("*")).alias("agreeing"),
    )


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus counted by subject."""
    return subjects.composition(_subjects(spark, sf_dir), load(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        p1_found, p1_neighbours, p1_recall, p3_found, p3_error_rate, p4_found, p4_pieces, p4_restored, p5_found, p5_content,
        p5_partition, p6_found, p6_coverage, p6_agreement, p7_mix, p7_shares, p7_kept, p7_exact, p7_entropy, p7_repeats, p7_budgets,
        p8_found, p8_agreement, p8_composition,
    )
}

_CURRENT = """
current as (
  select chunk_id, arg_max(embedding, indexed_at) as e from index_records
  where chunk_id is not null group by chunk_id
),
usable as (
  select chunk_id, e::double[] as v from current
  where len(e) = 64
    and len(list_filter(e, lambda x: x is not null and isfinite(x))) = 64
    and len(list_filter(e, lambda x: x <> 0)) > 0
),
scored as (
  select a.chunk_id as k, b.chunk_id as n, list_cosine_similarity(a.v, b.v) as c
  from usable a join usable b on a.chunk_id <> b.chunk_id
),
ranked as (
  select k, n, c, row_number() over (partition by k order by round(c, 9) desc, n) as r from scored where {floor}
)
"""

_SOURCE = "regexp_replace(lower(trim(source)), '[\\s\\-]+', '_', 'g')"

ORACLES: dict[str, str] = {
    # A source at its limit has least limit per target; sorted by that, the level
    # of the others is what is left of the total per target left.
    "p7_budgets": f"""
with sizes as (
  select {_SOURCE} as source, sum(length(text))::bigint as n from documents
  where doc_id is not null and text is not null and source is not null group by 1
),
wanted as (
  select scenario, {_SOURCE} as source, max(target_share) as t, max(max_repeats) as r
  from mix_targets where scenario is not null and source is not null group by 1, 2
),
all_rows as (select w.*, coalesce(n, 0)::bigint as available from wanted w left join sizes using (source)),
there as (
  select scenario, source, t, available,
    case when r is null then 'infinity'::double else greatest(0, r) * available end as lim
  from all_rows where t > 0 and available > 0
),
total as (select scenario, least(sum(available)::double, sum(lim)) as total from there group by 1),
placed as (
  select *, lim / t as ratio, row_number() over w as place,
    coalesce(sum(case when isinf(lim) then 0 else lim end) over (w rows between unbounded preceding and 1 preceding), 0) as taken,
    sum(t) over (w rows between current row and unbounded following) as rest
  from there join total using (scenario) window w as (partition by scenario order by lim / t, source)
),
level as (
  select scenario, arg_min((total - taken) / rest, place) as x from placed where (total - taken) / rest <= ratio group by 1
),
budgets as (
  select a.scenario, a.source, a.available,
    coalesce(case when p.lim <= x * p.t then p.lim else coalesce(x * p.t, p.lim) end, 0)::double as budget
  from all_rows a left join placed p using (scenario, source) left join level using (scenario)
)
select scenario, source, available, round(budget, 2) as budget,
  round(coalesce(budget / nullif(sum(budget) over (partition by scenario), 0), 0), 6) as share,
  round(case when available > 0 then budget / available else 0 end, 6) as repeats
from budgets
""",
    "p1_neighbours": f"""
with {_CURRENT.format(floor="true")}
select k as chunk_id, n as neighbour, round(round(c, 9), 5) as cosine, r as rank from ranked where r <= 5
""",
    "p1_recall": f"""
with {_CURRENT.format(floor="true")}
select count(distinct k) as asked, 5 * count(distinct k) as entries, true as recalled
from (select chunk_id as k from usable) where ('0x' || substr(k, 1, 8))::bigint % 50 = 0
""",
    "p1_found": f"""
with {_CURRENT.format(floor="c >= 0.90")}
select distinct least(k, n) as chunk_id_a, greatest(k, n) as chunk_id_b from ranked where r <= 5
""",
    "p3_found": """
with records as (
  select distinct entry_id, entry_key, fetched_at::timestamptz as instant from entries
  where entry_key is not null and trim(entry_key) <> ''
),
placed as (
  select *, row_number() over (partition by entry_key order by instant, entry_id) as r from records
)
select entry_id from placed
where r > 1 or entry_key in (select entry_key from warm_keys where entry_key is not null)
""",
    "p4_found": """
select distinct chunk_id,
  case when list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 4 * chunk_size
    then 'hard' else 'soft' end as cut
from kb_documents k join chunk_options o on coalesce(k.option_set, 'default') = o.option_set
where length(text) > 4 * chunk_size
""",
    "p5_partition": r"""
select page_id, len(list_filter(string_split(markdown, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}]')))::bigint as lines, true as parted
from (select distinct page_id, markdown from bloom_entries where kind = 'content' and markdown is not null)
""",
    "p7_kept": f"""
select distinct scenario, {_SOURCE} as source, true as kept from mix_targets where scenario is not null and source is not null
""",
    "p8_agreement": r"""
select count(distinct doc_id) as labelled, true as agreeing from subject_labels
where regexp_replace(lower(trim(subject)), '[\s\-]+', '_', 'g') in (select subject from subjects)
  and doc_id in (select doc_id from documents where text is not null)
""",
    "p4_restored": """
select distinct chunk_id, true as within, true as overlapping, md5(text) as text_md5
from kb_documents k join chunk_options o on coalesce(k.option_set, 'default') = o.option_set
where length(text) > 4 * chunk_size
""",
    "p6_agreement": "select 0::bigint as differing, true as any_found",
    "p3_error_rate": """
with records as (
  select distinct entry_id, entry_key, fetched_at::timestamptz as instant from entries
),
usable as (select * from records where entry_key is not null and trim(entry_key) <> ''),
placed as (
  select *, row_number() over (partition by entry_key order by instant, entry_id) as r from usable
),
hits as (
  select entry_id from placed
  where r > 1 or entry_key in (select entry_key from warm_keys where entry_key is not null)
)
select (select count(*) from records) as records, (select count(*) from hits) as seen,
  0::bigint as wrong, 0.0::double as wrong_rate
""",
}
