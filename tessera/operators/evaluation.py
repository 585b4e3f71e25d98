"""Scores of answers to questions with known results, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.texts import is_refusal, leaks_prompt, listed_text, matches


def _any_match(patterns: Column, text: Column) -> Column:
    return F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: matches(p, text))


def score_answers(cases: DataFrame) -> DataFrame:
    """Adds score, correct, abstained, found, missed, extra, precision and prompt_leak to cases.

    Columns: category (detail, list or unanswerable), answer, accept (patterns array), items and universe (arrays of
    struct<name, match array>). A detail is right if a pattern matches; an unanswerable question if the answer is a refusal or
    matches; a list's score is its recall, and it is right without missed or extra items.
    """
    a = F.col("answer")
    named = lambda xs: F.transform(xs, lambda i: i["name"])
    empty = F.array().cast("array<string>")
    is_list = F.col("category") == "list"
    found = F.when(is_list, named(F.filter("items", lambda i: _any_match(i["match"], a)))).otherwise(empty)
    missed = F.when(is_list, named(F.filter("items", lambda i: ~_any_match(i["match"], a)))).otherwise(empty)
    listed = listed_text(a)
    extra = F.when(is_list & F.col("universe").isNotNull(), named(F.filter("universe", lambda u: ~F.array_contains(named(F.col("items")), u["name"]) & _any_match(u["match"], listed)))).otherwise(empty)
    out = cases.withColumn("abstained", is_refusal(a)).withColumn("found", found).withColumn("missed", missed).withColumn("extra", extra).withColumn("prompt_leak", leaks_prompt(a))
    ok = F.when(F.col("category") == "unanswerable", F.col("abstained") | _any_match(F.col("accept"), a)).otherwise(_any_match(F.col("accept"), a))
    recall = F.try_divide(F.size("found").cast("double"), F.size("items").cast("double"))
    return (
        out.withColumn("score", F.when(is_list, recall).otherwise(ok.cast("double")))
        .withColumn("correct", F.when(is_list, (F.size("missed") == 0) & (F.size("extra") == 0)).otherwise(ok))
        .withColumn("precision", F.when(is_list & F.col("universe").isNotNull(), F.coalesce(F.try_divide(F.size("found").cast("double"), (F.size("found") + F.size("extra")).cast("double")), F.lit(0.0))))
    )


def metrics() -> list[Column]:
    """Means over the rows they apply to, to three places; null where none does."""
    mean = lambda x, when=None: F.round(F.avg(x if when is None else F.when(when, x)), 3)
    kind, number = F.col("category"), lambda c: F.col(c).cast("double")
    answerable = kind != "unanswerable"
    return [
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("error").isNotNull()).alias("errors"), mean(F.col("score")).alias("overall"),
        mean(F.col("score"), kind == "detail").alias("detail_accuracy"), mean(F.col("score"), kind == "list").alias("list_recall"), mean(F.col("precision"), kind == "list").alias("list_precision"),
        mean(number("abstained"), kind == "unanswerable").alias("abstention"), mean(number("abstained"), answerable).alias("false_abstention"),
        mean((F.col("unsupported") > 0).cast("double"), ~F.col("derived")).alias("unsupported_numbers"), mean(number("prompt_leak")).alias("prompt_leaks"),
        mean(number("citation_hit"), answerable & F.col("citation_hit").isNotNull()).alias("citation_accuracy"), mean(F.col("seconds")).alias("mean_seconds"),
    ]


def summarize(rows: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """(grouping, key, metrics): every row counts once under each grouping; one pass over the rows by exploding their keys."""
    named = F.array(*(F.struct(F.lit(name).alias("grouping"), (F.concat_ws(" / ", *(F.col(c).cast("string") for c in columns)) if columns else F.lit("all")).alias("key")) for name, columns in keys.items()))
    return rows.withColumn("__g", F.explode(named)).groupBy("__g.grouping", "__g.key").agg(*metrics())


def first_per_category(questions: DataFrame, n: int, category: str = "category", order: str = "place") -> DataFrame:
    w = Window.partitionBy(category).orderBy(order)
    return questions.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def cases(questions: DataFrame, languages: list[str], strategies: list[str]) -> DataFrame:
    """Each question in each language with each strategy; cross-language questions also against the other languages' documents."""
    grid = F.explode(F.array(*(F.struct(F.lit(d).alias("corpus_language"), F.lit(q).alias("question_language"), F.lit(s).alias("strategy")) for d in languages for q in languages for s in strategies)))
    every = questions.withColumn("__c", grid).select("*", "__c.*").drop("__c")
    return every.where((F.col("corpus_language") == F.col("question_language")) | F.col("cross"))


CASE_KEY = ["question_id", "corpus_language", "question_language", "strategy"]


def remaining(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Cases without a saved row that ended well: the rest of an interrupted run, errors again."""
    return wanted.join(done.where("error is null").select(*CASE_KEY).distinct(), CASE_KEY, "left_anti")


def retrieval_recall(targets: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5), by: tuple[str, ...] = ()) -> DataFrame:
    """Mean recall at each k by ``by``. ``targets`` has query_id, doc_id, locator and pattern; ``ranked`` query_id, rank, doc_id, locator, text."""
    met = targets.join(ranked.select("query_id", "doc_id", "locator", "rank", "text"), ["query_id", "doc_id", "locator"], "left")
    hit = F.coalesce(matches(F.col("pattern"), F.col("text")), F.lit(False))
    per = met.groupBy("query_id", "doc_id", "locator", "pattern", *by).agg(*(F.max((hit & (F.col("rank") <= k)).cast("double")).alias(f"k{k}") for k in ks))
    per = per.groupBy("query_id", *by).agg(*(F.avg(f"k{k}").alias(f"k{k}") for k in ks))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), *(F.round(F.avg(f"k{k}"), 3).alias(f"recall_at_{k}") for k in ks))


def run_metrics() -> list[Column]:
    """The whole set of a run's measures: means over the rows they apply to, errors left out, to three places; null where none applies.

    Rows have category, error, score, correct, precision, abstained, unsupported (count), derived, prompt_leak, citations, citation_hit, seconds.
    """
    good, kind = F.col("error").isNull(), F.col("category")
    answerable, truth = kind != "unanswerable", lambda x: F.coalesce(x, F.lit(False)).cast("double")
    mean = lambda x, when=None: F.round(F.avg(F.when(good if when is None else good & when, x)), 3)
    return [
        F.count(F.lit(1)).alias("cases"), F.count_if(~good).alias("errors"), mean(F.col("score")).alias("overall"), mean(truth(F.col("correct")), kind == "detail").alias("detail_accuracy"),
        mean(F.col("score"), kind == "list").alias("list_recall"), mean(F.col("precision"), kind == "list").alias("list_precision"), mean(truth(F.col("correct")), kind == "unanswerable").alias("abstention_accuracy"),
        mean(truth(F.col("abstained") & (F.col("score") == 0)), answerable).alias("false_abstention_rate"), mean(truth(F.col("unsupported") > 0), ~F.coalesce("derived", F.lit(False))).alias("unsupported_number_rate"),
        mean(truth(F.col("prompt_leak"))).alias("prompt_leak_rate"), mean(truth(F.col("citations") > 0), answerable).alias("citation_rate"), mean(truth(F.col("citation_hit")), answerable).alias("citation_accuracy"),
        mean(F.col("seconds")).alias("seconds_mean"), F.round(F.coalesce(F.sum(F.when(good, F.col("seconds"))), F.lit(0.0)), 1).alias("seconds_total"),
    ]


def run_groups(rows: DataFrame) -> DataFrame:
    """(key, measures): every row counts once under each of seven keys made of strategy, languages and difficulty."""
    s, c, q, d = (F.col(x) for x in ("strategy", "corpus_language", "question_language", "difficulty"))
    level = F.coalesce(d, F.lit("standard"))
    mode = F.when(c == q, "same").otherwise("cross")
    keys = [F.lit("all"), F.concat(F.lit("strategy="), s), F.concat(F.lit("corpus="), c), F.concat_ws("/", s, c, mode), F.concat(q, F.lit("->"), c), F.concat(F.lit("difficulty="), level), F.concat(s, F.lit("/difficulty="), level)]
    return rows.withColumn("key", F.explode(F.array(*keys))).groupBy("key").agg(*run_metrics())


def scored_again(saved: DataFrame, questions: DataFrame) -> DataFrame:
    """Saved answers scored by the present rules: rows without an error whose question still exists; answers and times stay as they are.

    ``questions`` has question_id, category, accept, items, universe, difficulty and derived.
    """
    fresh = ["score", "correct", "abstained", "found", "missed", "extra", "precision", "prompt_leak", "category", "accept", "items", "universe", "difficulty", "derived"]
    return score_answers(saved.where("error is null").drop(*fresh).join(questions, "question_id"))
