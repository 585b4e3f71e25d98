"""Test suites of questions with known answers: loading, self-check, evidence, citation hits, the retrieval matrix, scoring again, reports.

A suite is four tables. questions: question_id, place, category, difficulty, cross, derived, texts (map of language to question), answer (patterns).
items: question_id, name, match (patterns). evidence: question_id, item (null: the question itself), doc, locator, locators (map by
language, or null). corpora: language, doc, doc_id, locator, markdown, a row for each section.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.texts import matches
from tessera.operators.evaluation import first_per_category
from tessera.sources.folders import delete

_EVIDENCE = "array<struct<doc:string,locator:string,locators:map<string,string>>>"
SUITE = (
    "name string, version string, document_order array<string>, documents map<string,map<string,string>>, universes map<string,map<string,array<string>>>, "
    f"questions array<struct<id:string,category:string,difficulty:string,cross:boolean,derived:boolean,universe:string,question:map<string,string>,answer:array<string>,accept:array<string>,evidence:{_EVIDENCE},"
    f"items:array<struct<name:string,match:array<string>,evidence:{_EVIDENCE}>>>>"
)


def load_suite(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """questions, items, evidence and documents (doc, place, files by language) of a suite's JSON file."""
    suite = spark.read.schema(SUITE).option("multiLine", True).json(path)
    q = suite.select(F.posexplode("questions").alias("place", "q"))
    own = q.select(F.col("q.id").alias("question_id"), F.lit(None).cast("string").alias("item"), F.explode("q.evidence").alias("e"))
    items = q.select(F.col("q.id").alias("question_id"), F.explode("q.items").alias("i"))
    of_items = items.select("question_id", F.col("i.name").alias("item"), F.explode("i.evidence").alias("e"))
    return {
        "questions": q.select(
            F.col("q.id").alias("question_id"), "place", "q.category", F.coalesce("q.difficulty", F.lit("standard")).alias("difficulty"), F.coalesce("q.cross", F.lit(False)).alias("cross"),
            F.coalesce("q.derived", F.lit(False)).alias("derived"), "q.universe", F.col("q.question").alias("texts"), "q.answer", "q.accept",
        ),
        "items": items.select("question_id", "i.name", "i.match"),
        "evidence": own.unionByName(of_items).select("question_id", "item", "e.doc", "e.locator", "e.locators"),
        "documents": suite.select("documents", F.posexplode("document_order").alias("place", "doc")).select("doc", "place", F.element_at("documents", F.col("doc")).alias("files")),
    }


def counts(questions: DataFrame) -> DataFrame:
    """(category, difficulty, questions, cross): by both, by either (the other is null) and in all."""
    return questions.cube("category", "difficulty").agg(F.count(F.lit(1)).alias("questions"), F.count_if("cross").alias("cross"))


def documents_by_language(documents: DataFrame) -> DataFrame:
    """(language, docs array): the documents that have a file in each language, in the suite's order."""
    each = documents.select("doc", "place", F.explode("files").alias("language", "file"))
    return each.groupBy("language").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "doc"))), lambda x: x["doc"]).alias("docs"))


def selected(questions: DataFrame, categories: list[str] | None = None, ids: list[str] | None = None, difficulties: list[str] | None = None, per_category: int | None = None) -> DataFrame:
    """The questions of a run: of these categories, ids and difficulties (all, where none are given), the first few of each category."""
    for column, values in (("category", categories), ("question_id", ids), ("difficulty", difficulties)):
        questions = questions.where(F.col(column).isin(values)) if values else questions
    return first_per_category(questions, per_category) if per_category else questions


def case_order(languages: list[str], strategies: list[str]) -> list[Column]:
    """The order in which cases run: by documents' language, strategy, questions in it before those in others, and place, so that a model reads the same documents in a row."""
    at = lambda values, c: F.array_position(F.array(*(F.lit(v) for v in values)), F.col(c))
    return [at(languages, "corpus_language"), at(strategies, "strategy"), F.col("corpus_language") != F.col("question_language"), F.col("place")]


def estimated_cases(questions: DataFrame, difficulties: list[str], languages: int, strategies: int, cross: bool, per_category: int | None = None) -> DataFrame:
    """(cases): how many cases a run would have."""
    kept = questions.where(F.col("difficulty").isin(difficulties)).withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy("place")))
    kept = kept if per_category is None else kept.where(F.col("n") <= per_category)
    return kept.agg((languages * strategies * (F.count(F.lit(1)) + (F.count_if("cross") if cross else F.lit(0)))).alias("cases"))


def locator_in(language: Column) -> Column:
    """The locator of a piece of evidence in a language: one for all, or one by language."""
    return F.coalesce(F.element_at("locators", language), F.col("locator"))


def targets(suite: dict[str, DataFrame], languages: list[str]) -> DataFrame:
    """(question_id, language, label, patterns, doc, locator): what must be found for each question, a row for each place that holds it.

    The questions themselves for details (without patterns if the answer is derived), items for lists; unanswerable ones have none.
    """
    questions = suite["questions"].where("category <> 'unanswerable'")
    none = F.array().cast("array<string>")
    details = questions.where("category = 'detail'").select("question_id", F.col("question_id").alias("label"), F.when(F.col("derived"), none).otherwise(F.col("answer")).alias("patterns"), F.lit(None).cast("string").alias("item"))
    lists = questions.where("category = 'list'").select("question_id", "derived").join(suite["items"], "question_id")
    lists = lists.select("question_id", F.concat_ws("/", "question_id", "name").alias("label"), F.when(F.col("derived"), none).otherwise(F.col("match")).alias("patterns"), F.col("name").alias("item"))
    every = details.unionByName(lists).alias("t").join(suite["evidence"].alias("e"), (F.col("t.question_id") == F.col("e.question_id")) & F.col("t.item").eqNullSafe(F.col("e.item")))
    every = every.select("t.question_id", "label", "patterns", "doc", "e.locator", "locators")
    spoken = every.withColumn("language", F.explode(F.array(*map(F.lit, languages))))
    return spoken.select("question_id", "language", "label", "patterns", "doc", locator_in(F.col("language")).alias("locator"))


def meets(patterns: Column, text: Column) -> Column:
    """Whether any pattern matches; without patterns any text does."""
    return (F.size(patterns) == 0) | F.exists(patterns, lambda p: F.coalesce(matches(p, text), F.lit(False)))


def self_check(wanted: DataFrame, corpora: DataFrame) -> DataFrame:
    """(language, label, problem, locator): locators that no section has, and answers found at none of their places."""
    met = wanted.join(corpora.select("language", "doc", "locator", "markdown"), ["language", "doc", "locator"], "left")
    missing = met.where("markdown is null").select("language", "label", F.lit("locator not found").alias("problem"), "locator").distinct()
    found = met.groupBy("language", "label").agg(F.bool_or(F.col("markdown").isNotNull() & meets(F.col("patterns"), F.col("markdown"))).alias("hit"))
    absent = found.where(~F.coalesce("hit", F.lit(False))).select("language", "label", F.lit("answer not found").alias("problem"), F.lit(None).cast("string").alias("locator"))
    return missing.unionByName(absent)


def citation_hits(citations: DataFrame, gold: DataFrame) -> DataFrame:
    """(answer_id, citation_hit): whether a resolved citation of an answer points to a place that holds what was asked.

    ``citations`` has answer_id, question_id, doc_id, resolved_locator and found; ``gold`` question_id, doc_id, locator.
    """
    right = gold.select("question_id", "doc_id", F.col("locator").alias("resolved_locator"), F.lit(True).alias("hit")).distinct()
    met = citations.join(right, ["question_id", "doc_id", "resolved_locator"], "left")
    return met.groupBy("answer_id").agg(F.coalesce(F.bool_or(F.col("found") & F.col("hit")), F.lit(False)).alias("citation_hit"))


def recall(wanted: DataFrame, ranked: DataFrame, kept: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Mean recall of the first k passages, and of those sent along, by ``by``; questions that nothing was sent for get everything.

    ``wanted`` has query_id, label, patterns, doc_id, locator and ``by``; ``ranked`` query_id, rank, doc_id, locator, text; ``kept`` query_id,
    doc_id, locator, text. All questions are looked up at once.
    """
    place = ["query_id", "doc_id", "locator"]
    every = ranked.select(*place, "text", "rank", F.lit(False).alias("sent")).unionByName(kept.select(*place, "text", F.lit(None).cast("int").alias("rank"), F.lit(True).alias("sent")))
    met = wanted.join(every, place, "left").withColumn("hit", F.col("text").isNotNull() & meets(F.col("patterns"), F.col("text")))
    per_target = met.groupBy("query_id", "label", *by).agg(*(F.max((F.col("hit") & (F.col("rank") <= k)).cast("int")).alias(f"k{k}") for k in ks), F.max((F.col("hit") & F.col("sent")).cast("int")).alias("sent"))
    any_sent = kept.select("query_id").distinct().withColumn("some", F.lit(True))
    per_question = per_target.groupBy("query_id", *by).agg(*(F.avg(F.coalesce(f"k{k}", F.lit(0))).alias(f"k{k}") for k in ks), F.avg(F.coalesce("sent", F.lit(0))).alias("sent")).join(any_sent, "query_id", "left")
    return per_question.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"), *(F.round(F.avg(f"k{k}"), 3).alias(f"recall_at_{k}") for k in ks), F.round(F.avg(F.when(F.col("some"), F.col("sent")).otherwise(1.0)), 3).alias("context_recall"),
        F.count_if(F.col("some").isNull()).alias("fallbacks"),
    )


def misses(wanted: DataFrame, kept: DataFrame, by: list[str]) -> DataFrame:
    """(query_id, missed array of labels and ``by``): questions something was sent for that lacks a part of the answer."""
    met = wanted.join(kept.select("query_id", "doc_id", "locator", "text"), ["query_id", "doc_id", "locator"], "left")
    lacking = met.groupBy("query_id", "label", *by).agg(F.bool_or(F.col("text").isNotNull() & meets(F.col("patterns"), F.col("text"))).alias("hit")).where(~F.coalesce("hit", F.lit(False)))
    return lacking.join(kept.select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id", *by).agg(F.sort_array(F.collect_list("label")).alias("missed"))


def percent(share: Column) -> Column:
    """A share as whole per cent, - for none."""
    return F.coalesce(F.concat(F.bround(100 * share, 0).cast("int").cast("string"), F.lit(" %")), F.lit("-"))


def duration(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "-").when(seconds >= 60, F.format_string("%.1f min", seconds / 60)).otherwise(F.format_string("%.0f s", seconds))


def side_by_side(summaries: DataFrame, runs: list[str], metrics: dict[str, str]) -> DataFrame:
    """One row for each metric, a text column for each run: from (run, and the metrics as columns) of one group. ``metrics`` maps columns to labels."""
    labelled = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(label).alias("metric"), percent(F.col(c)).alias("value")) for k, (c, label) in enumerate(metrics.items()))))
    return summaries.select("run", labelled.alias("m")).groupBy("m.place", "m.metric").pivot("run", runs).agg(F.first("m.value"))


def best_runs(runs: DataFrame, most: int = 4) -> DataFrame:
    """The most complete finished run of each model (the first one saved, if equal), the most complete first, ``most`` at most.

    ``runs`` has run_id, place, model, finished_at and completed_cases; a run without a model counts as a model of its own.
    """
    model = Window.partitionBy(F.coalesce("model", "run_id")).orderBy(F.desc("completed_cases"), "place")
    best = runs.where("finished_at is not null").withColumn("n", F.row_number().over(model)).where("n = 1").drop("n")
    return best.orderBy(F.desc("completed_cases"), "place").limit(most)


def saved_runs(spark: SparkSession, path: str) -> DataFrame:
    """Saved runs, newest first; names that aren't plain ids are left out."""
    runs = spark.read.option("multiLine", True).json(path)
    return runs.where(F.col("id").rlike("^[A-Za-z0-9_.-]+$")).orderBy(F.desc("started_at"), "id")


def delete_run(spark: SparkSession, path: str, run_id: str) -> None:
    """Deletes a saved run; KeyError if the name is no plain id or no such run is there."""
    if not re.fullmatch("[A-Za-z0-9_.-]+", run_id) or not delete(spark, f"{path}/{run_id}.json"):
        raise KeyError(run_id)


# Measures of a run by their labels, in order.
MEASURES = {
    "overall": "Overall", "detail_accuracy": "Small details", "list_recall": "Similar items: recall", "list_precision": "Similar items: precision", "abstention_accuracy": "Says 'not in documents'",
    "false_abstention_rate": "Wrongly says 'not found'", "unsupported_number_rate": "Answers with invented numbers", "citation_accuracy": "Cites the right location", "prompt_leak_rate": "Copies prompt text into the answer",
}


def run_tables(summaries: DataFrame, runs: list[str]) -> DataFrame:
    """(key, text): for each group of cases a Markdown table with a row per measure and a column per run that has the group, in the order of ``runs``.

    ``summaries`` has run, key and the measures of ``evaluation.run_metrics``.
    """
    values = [(label, percent(F.col(c))) for c, label in MEASURES.items()]
    values += [("Seconds per question", F.coalesce(F.col("seconds_mean").cast("string"), F.lit("None"))), ("Time to complete", duration(F.col("seconds_total"))), ("Cases", F.col("cases").cast("string"))]
    place = F.array_position(F.array(*(F.lit(r) for r in runs)), F.col("run"))
    column = summaries.where(F.col("run").isin(runs)).select("key", F.struct(place.alias("place"), "run", F.array(*(v for _, v in values)).alias("values")).alias("column"))
    columns = F.sort_array(F.collect_list("column"))
    row = lambda first, of: F.concat(F.lit(f"| {first} | "), F.array_join(F.transform("columns", of), " | "), F.lit(" |"))
    lines = [row("Metric", lambda c: c["run"]), F.concat(F.lit("|---|"), F.repeat(F.lit("---:|"), F.size("columns")))]
    value = lambda i: lambda c: F.get(c["values"], F.lit(i))
    lines += [row(label, value(i)) for i, (label, _) in enumerate(values)]
    return column.groupBy("key").agg(columns.alias("columns")).select("key", F.concat_ws("\n", *lines).alias("text"))


# The head of the table of recalls.
RECALL_HEAD = ["| Retrieval | Tier | Question -> documents | Recall@1 | Recall@3 | Recall@5 | Passage reached the model | Share of corpus sent |", "|---|---|---|---:|---:|---:|---:|---:|"]


def retrieval_table(rows: DataFrame) -> DataFrame:
    """(place, line): the lines of a Markdown table of recalls, by the order of ``rows`` (place, stemming, tier, question_language, corpus, recall_at_1, -3, -5,
    context_recall, share_of_corpus_sent)."""
    kind = F.when(F.col("stemming"), "language-aware").otherwise("plain BM25")
    cells = [kind, F.coalesce("tier", F.lit("standard")), F.concat(F.upper("question_language"), F.lit(" -> "), F.upper("corpus")), *(percent(F.col(c)) for c in ("recall_at_1", "recall_at_3", "recall_at_5", "context_recall", "share_of_corpus_sent"))]
    top = rows.sparkSession.createDataFrame([(i - 2, line) for i, line in enumerate(RECALL_HEAD)], "place int, line string")
    return top.unionByName(rows.select(F.col("place").cast("int").alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))


# What stands before each measure in a run's summary line.
SUMMARY = [
    ("overall ", "overall"), (" | details ", "detail_accuracy"), (" | lists recall ", "list_recall"), (" precision ", "list_precision"), (" | not-in-documents ", "abstention_accuracy"),
    (" | unsupported numbers ", "unsupported_number_rate"), (" | citations correct ", "citation_accuracy"),
]


def summary_line() -> Column:
    """One run's measures in a line, of the columns of ``evaluation.run_metrics``."""
    shares = [x for label, c in SUMMARY for x in (F.lit(label), percent(F.col(c)))]
    return F.concat(*shares, F.lit(" | "), F.coalesce(F.col("seconds_mean").cast("string"), F.lit("None")), F.lit(" s/question | "), duration(F.col("seconds_total")), F.lit(" in total"))


def verdict(error: Column, correct: Column, category: Column, score: Column) -> Column:
    """error, right, a list's share found, or wrong."""
    share = F.concat(F.floor(100 * score + 0.5).cast("int").cast("string"), F.lit(" %"))
    return F.when(error.isNotNull(), "error").when(correct, "right").when((category == "list") & (score > 0), share).otherwise("wrong")
