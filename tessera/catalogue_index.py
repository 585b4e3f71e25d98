"""Registered queries of the written index: searches, term statistics, languages of documents in passages, recall of real ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import inverted, retrieval, suites
from tessera.operators.inverted import PassageIndex
from tessera.registry import query, table
from tessera.sources.shared import shared_path

_STOPS = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: len(w) > 1 and w not in ({_STOPS}))"
_MARKED = {k: f"len(list_filter(regexp_extract_all(lower(substr(text, 1, 20000)), '[\\p{{L}}\\p{{N}}]+'), lambda w: w in ({', '.join(repr(x) for x in m)})))" for k, m in retrieval.MARKERS.items()}
_LANGUAGE = f"case when {_MARKED['en']} >= 3 and {_MARKED['en']} >= {_MARKED['fi']} then 'en' when {_MARKED['fi']} >= 3 then 'fi' end"
_LONGER = "flatten(list_transform(tokens, lambda w: case when len(w) >= 8 then [w, '~' || substr(w, 1, 6)] else [w] end))"
_RANKED = (
    "s as (select count(*) as n, avg(greatest(len(tokens), 1)) as a from c), p as (select doc_id, greatest(len(tokens), 1) as length, unnest(tokens) as term from c), "
    "tf as (select doc_id, term, any_value(length) as length, count(*) as tf from p where term in (select term from q) group by 1, 2), df as (select term, count(*) as df from tf group by 1), "
    "scored as (select q.query_id, tf.doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))), 6) as score from q join df using (term) join tf using (term), s group by 1, 2), "
    "ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored where score > 0) "
)
_TOP = "select query_id, rank::int as rank, doc_id, floor(score * 10000 + 0.5) / 10000 as score from ranked where rank <= 8"


def _index(spark, chunks: DataFrame, *shares) -> PassageIndex:
    """An index that the passages are appended to in ``shares`` (conditions that together hold for all of them)."""
    index = PassageIndex(spark, shared_path(spark, "index"))
    for share in shares:
        index.append(chunks.where(share))
    return index


def _whole(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lit(0).alias("order"), "text", "source", retrieval.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "doc_id", (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))


@query(f"with c as (select doc_id, {_TOKENS} as tokens from (select doc_id, coalesce(text, '') as text from documents)), q as (select item_id as query_id, term, count(*) as times from (select item_id, unnest({_TOKENS}) as term from benchmark) group by 1, 2), " + _RANKED + _TOP)
def index_top(spark, d):
    """Items' best documents; documents are appended in two parts, and terms asked twice count twice."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), retrieval.tokens(F.col("text")).alias("terms"))
    index = _index(spark, _whole(spark, d), F.col("source").isNull() | (F.col("source") < "src1"), F.col("source") >= "src1")
    return _rounded(index.search(queries, 8, shared_path(spark, "search")))


@query(f"with t as (select distinct doc_id, unnest({_TOKENS}) as term from documents), n as (select count(*) as n from documents) select term, count(*)::bigint as df, round(ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf from t, n group by term")
def index_terms(spark, d):
    """Term statistics from the index's counts; no entry is read."""
    return _index(spark, _whole(spark, d), F.lit(True)).term_statistics().select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents), "
    f"t as (select doc_id, string_agg(line, ' ' order by n) as text from l group by 1) select doc_id, {_LANGUAGE} as language from t"
)
def language_of_passages(spark, d):
    """Languages of documents that come as passages of one line each."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("order", "text"))
    return inverted.document_language(lines)


@query(
    f"with l as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as title, {_LANGUAGE} as language from documents), w as (select doc_id, language, case when title <> '' then title || chr(10) || text else text end as text from l), "
    f"t as (select doc_id, language, {_TOKENS} as tokens from w), c as (select doc_id, case when language = 'fi' then {_LONGER} else tokens end as tokens from t), "
    f"i as (select item_id, {_TOKENS} as tokens from benchmark), q as (select distinct item_id as query_id, unnest(list_concat(tokens, {_LONGER})) as term, 1 as times from i), " + _RANKED + _TOP
)
def retrieval_path(spark, d):
    """The whole path: language of the document, titles searched with the text, terms in both languages, the written index, the best eight."""
    chunks = inverted.searchable(_whole(spark, d).drop("tokens"), F.col("source"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), retrieval.query_terms(F.col("text")).alias("terms"))
    return _rounded(_index(spark, chunks, F.lit(True)).search(queries, 8, shared_path(spark, "search")))


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> '')"


@query(
    f"with c as (select doc_id, {_TOKENS} as tokens from (select doc_id, coalesce(text, '') as text from documents)), q as (select item_id as query_id, term, count(*) as times from (select item_id, unnest({_TOKENS}) as term from benchmark) group by 1, 2), " + _RANKED
    + f", i as (select item_id, array_to_string({_WORDS}[1:6], ' ') as start, coalesce({_LANGUAGE}, 'other') as language from benchmark where len({_WORDS}) >= 6), w as (select doc_id, {_WORDS} as w from documents), "
    "d as (select distinct doc_id, array_to_string(w[k : k + 5], ' ') as start from (select doc_id, w, unnest(range(1, len(w) - 4)) as k from w)), wanted as (select item_id, language, doc_id from i join d using (start)), "
    "best as (select wanted.item_id, language, min(rank) as rank from wanted left join ranked on query_id = item_id and ranked.doc_id = wanted.doc_id and rank <= 8 group by 1, 2) "
    "select language, count(*) as questions, round(avg((coalesce(rank, 99) <= 1)::int), 3) as recall_at_1, round(avg((coalesce(rank, 99) <= 3)::int), 3) as recall_at_3, round(avg((coalesce(rank, 99) <= 5)::int), 3) as recall_at_5, "
    "round(avg((coalesce(rank, 99) <= 4)::int), 3) as context_recall, 0::bigint as fallbacks from best group by 1"
)
def retrieval_matrix_ranked(spark, d):
    """Recall of the index's own ranks: items ask, and documents in which an item's first six words stand must be found; four passages are sent."""
    items, docs = table(spark, d, "benchmark"), _whole(spark, d)
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "[ \\t\\n\\r]+"), lambda w: w != "")
    starts = items.select(F.col("item_id").alias("query_id"), F.coalesce(retrieval.language(F.col("text")), F.lit("other")).alias("language"), words(F.col("text")).alias("w"))
    starts = starts.where(F.size("w") >= 6).select("query_id", "language", F.array_join(F.slice("w", 1, 6), " ").alias("start"))
    in_docs = docs.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") >= 6)
    in_docs = in_docs.select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 5)).alias("k")).select("doc_id", F.array_join(F.slice("w", F.col("k"), F.lit(6)), " ").alias("start"))
    wanted = starts.join(in_docs, "start").select("query_id", "language", "doc_id").distinct()
    wanted = wanted.select("query_id", "language", F.lit("passage").alias("label"), F.array().cast("array<string>").alias("patterns"), "doc_id", F.lit("Text").alias("locator"))
    queries = items.select(F.col("item_id").alias("query_id"), retrieval.tokens(F.col("text")).alias("terms"))
    at = shared_path(spark, "hits")
    _index(spark, docs, F.lit(True)).search(queries, 8, shared_path(spark, "search")).write.parquet(at)
    ranked = spark.read.parquet(at).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").select("query_id", "rank", "doc_id", F.lit("Text").alias("locator"), "text")
    return suites.recall(wanted, ranked, ranked.where("rank <= 4").drop("rank"), ["language"])
