"""Citations resolved to sections, and answers checked against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import band, bands, checked_tokens, close, number_tokens, readings
from tessera.functions.texts import CITATION, backed_statement, best_evidence, citation_coverage, citation_marks, is_refusal, plain, strip_thinking


def match_tier(locator: Column, section: Column, title: Column, markdown: Column) -> Column:
    """How well a cited locator names a section, 1 best, null not at all: same text; same letters and digits (or the title's); one
    within the other; all its words; a heading near the section's start; its first number."""
    want, have = plain(locator), plain(section)
    long_words = F.filter(F.split(want, " "), lambda w: F.length(w) > 1)
    number = F.regexp_extract(locator, "([0-9]+)", 1)
    return (
        F.when(locator == section, 1)
        .when((have == want) | (plain(F.coalesce(title, F.lit(""))) == want), 2)
        .when((want != "") & (have.contains(want) | want.contains(have)), 3)
        .when((F.size(long_words) >= 2) & (F.size(F.array_except(long_words, F.split(have, " "))) == 0), 4)
        .when((F.length(want) >= 4) & plain(F.substring(F.coalesce(markdown, F.lit("")), 1, 400)).contains(want), 5)
        .when((number != "") & F.regexp_like(section, F.concat(F.lit(r"(?U)\b"), number, F.lit(r"\b"))), 6)
    )


def best_sections(asked: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, locator, section_id, resolved_locator): the section that each distinct (doc_id, locator) names best; those that name none are left out."""
    have = sections.select("doc_id", "section_id", F.col("locator").alias("resolved_locator"), "title", "markdown")
    near = asked.select("doc_id", "locator").distinct().join(have, "doc_id").withColumn("tier", match_tier(F.col("locator"), F.col("resolved_locator"), F.col("title"), F.col("markdown"))).where("tier is not null")
    best = near.groupBy("doc_id", "locator").agg(F.min_by(F.struct("section_id", "resolved_locator"), F.struct("tier", "section_id")).alias("b"))
    return best.select("doc_id", "locator", "b.section_id", "b.resolved_locator")


def resolve_citations(answers: DataFrame, sections: DataFrame) -> DataFrame:
    """(answer_id, marker, place, source_index, locator, doc_id, section_id, resolved_locator, found) of each distinct mark.

    ``answers`` has answer_id, answer and doc_ids (array: source 1, 2, ...); ``sections`` doc_id, section_id (order in the document), locator, title and markdown.
    Marks meet only the sections of the document they name; unresolved ones stay.
    """
    marks = answers.select("answer_id", "doc_ids", F.posexplode(citation_marks(F.col("answer"))).alias("place", "marker"))
    marks = marks.withColumn("source_index", F.regexp_extract("marker", CITATION, 1).try_cast("int")).withColumn("locator", F.trim(F.regexp_extract("marker", CITATION, 2)))
    marks = marks.withColumn("doc_id", F.when(F.col("source_index") >= 1, F.get("doc_ids", F.col("source_index") - 1))).drop("doc_ids")
    best = best_sections(marks.select("doc_id", "locator"), sections).withColumn("found", F.lit(True))
    return marks.join(best, ["doc_id", "locator"], "left").select("answer_id", "marker", "place", "source_index", "locator", "doc_id", "section_id", "resolved_locator", F.coalesce("found", F.lit(False)).alias("found"))


def cited_evidence(answers: DataFrame, citations: DataFrame, sections: DataFrame) -> DataFrame:
    """(answer_id, marker, doc_id, section_id, statement, evidence): what each resolved mark backs in its answer, and the block (and row of a table) of the
    cited section that shares most with it, as ``texts.best_evidence`` finds it. Unresolved marks are left out."""
    backed = citations.where("found").join(answers.select("answer_id", "answer"), "answer_id").withColumn("statement", backed_statement(F.col("answer"), F.col("marker")))
    met = backed.join(sections.select("doc_id", "section_id", "markdown"), ["doc_id", "section_id"])
    return met.select("answer_id", "marker", "doc_id", "section_id", "statement", best_evidence(F.col("markdown"), F.col("statement")).alias("evidence"))


def citation_stats(citations: DataFrame) -> DataFrame:
    """(answer_id, total, resolved, unresolved array in order of appearance)."""
    missing = F.collect_list(F.when(~F.col("found"), F.struct("place", "marker")))
    return citations.groupBy("answer_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("found").alias("resolved"), F.transform(F.sort_array(missing), lambda x: x["marker"]).alias("unresolved"))


def numbers_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, band, known): a row for every reading of every number in the texts of a key, each once."""
    found = texts.select(key, F.explode(number_tokens(F.col(text))).alias("t")).distinct().select(key, F.explode(readings(F.col("t"))).alias("known"))
    return found.distinct().withColumn("band", band(F.col("known")))


def unsupported(answers: DataFrame, sections: DataFrame) -> DataFrame:
    """(answer_id, place, token): numbers of answers that neither the question nor a section of the answer's documents holds, in order.

    Readings meet known numbers by document and band, so no answer's or document's numbers come together in one row; answers need answer_id,
    answer, question and doc_ids. What is expected (``expected``, patterns such as num:5; if there is such a column) may be in an answer too,
    since a computed number stands in no document. Null texts hold no numbers; documents listed twice count once.
    """
    if "expected" in answers.columns:
        numbers = F.transform(F.filter("expected", lambda p: p.startswith("num:")), lambda p: F.substring(p, 5, 400))
        answers = answers.withColumn("question", F.concat_ws(" ", "question", F.array_join(numbers, " ")))
    tokens = answers.select("answer_id", "doc_ids", "question", F.posexplode(checked_tokens(F.coalesce("answer", F.lit("")))).alias("place", "token"))
    read = tokens.select("answer_id", "doc_ids", "place", F.explode(readings(F.col("token"))).alias("v")).select("*", F.explode(bands(F.col("v"))).alias("band"))
    near = close(F.col("v"), F.col("known"))
    in_documents = read.select("answer_id", "place", "v", "band", F.explode(F.array_distinct("doc_ids")).alias("doc_id")).join(numbers_of(sections, "doc_id", "markdown"), ["doc_id", "band"]).where(near)
    in_questions = read.join(numbers_of(answers, "answer_id", "question"), ["answer_id", "band"]).where(near)
    held = in_documents.select("answer_id", "place").unionByName(in_questions.select("answer_id", "place")).distinct()
    return tokens.select("answer_id", "place", "token").join(held, ["answer_id", "place"], "left_anti")


def check_answers(answers: DataFrame, sections: DataFrame, most_listed: int = 8) -> DataFrame:
    """One row for each answer: status, unsupported numbers, statements without a citation, citations.

    ``answers`` has answer_id, question, answer and doc_ids. Status: no_sources (no answer or no documents), review (a number found in no
    source, or a citation of no section), not_in_documents (a refusal without citations), partly_cited, ok.
    """
    prepared = answers.withColumn("answer", strip_thinking(F.coalesce("answer", F.lit(""))))
    missing = unsupported(prepared, sections).groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("missing"))
    stats = citation_stats(resolve_citations(prepared, sections))
    out = prepared.join(missing, "answer_id", "left").join(stats, "answer_id", "left")
    none = F.array().cast("array<string>")
    out = (
        out.withColumn("unsupported", F.coalesce(F.array_distinct(F.transform("missing", lambda x: x["token"])), none))
        .withColumn("unresolved", F.coalesce("unresolved", none))
        .withColumn("statements", citation_coverage(F.col("answer")))
        .withColumn("uncited", F.transform(F.filter("statements", lambda s: ~s["cited"]), lambda s: s["text"]))
        .withColumn("refusal", is_refusal(F.col("answer")))
    )
    status = (
        F.when((F.trim("answer") == "") | (F.size("doc_ids") == 0), "no_sources")
        .when((F.size("unsupported") > 0) | (F.size("unresolved") > 0), "review")
        .when(F.col("refusal") & (F.coalesce("total", F.lit(0)) == 0), "not_in_documents")
        .when(F.size("uncited") > 0, "partly_cited")
        .otherwise("ok")
    )
    return out.select(
        "answer_id", status.alias("status"), "unsupported", F.size("statements").alias("sentences_total"), F.transform(F.slice("uncited", 1, most_listed), lambda x: F.substring(x, 1, 240)).alias("uncited"),
        F.coalesce("total", F.lit(0)).alias("citations_total"), F.slice("unresolved", 1, most_listed).alias("unresolved"), "refusal",
    )


def grounding_score(claims: DataFrame, key: str) -> DataFrame:
    """Counts of verdicts by ``key`` and 100 * (supported + partial / 2) / claims, rounded; 100 without claims."""
    n = {v: F.count_if(F.col("verdict") == v).alias(v) for v in ("supported", "partially_supported", "unsupported", "contradicted")}
    score = F.round(100 * F.try_divide(F.count_if(F.col("verdict") == "supported") + 0.5 * F.count_if(F.col("verdict") == "partially_supported"), F.count("verdict")), 0)
    return claims.groupBy(key).agg(*n.values(), F.coalesce(score, F.lit(100.0)).cast("int").alias("score"))
