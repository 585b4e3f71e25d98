"""What is sent along with a question: chosen passages as source blocks, outlines, budgets, and the choice between full texts and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share by which a budget shrinks at each new attempt, and the number of attempts.
SHRINK, ATTEMPTS = 0.6, 3


def wrapped(index: Column, name: Column, body: Column) -> Column:
    """A document's text between <source> tags, numbered from 1."""
    return F.concat(F.lit('<source id="'), index.cast("string"), F.lit('" name="'), F.replace(name, F.lit('"'), F.lit("'")), F.lit('">\n'), F.regexp_replace(body, r"(?U)\s+$", ""), F.lit("\n</source>"))


def joined_in_order(order: list[str], text: Column, between: str) -> Column:
    """Aggregate: texts of a group in order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("__text")))), lambda x: x["__text"]), between)


def source_blocks(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, context): chosen passages in reading order, a heading for each run of one locator, one block for each document.

    ``passages`` has query_id, doc_id, order, locator and text, bounded by the budget they were chosen for; ``documents`` doc_id,
    index (from 1) and name.
    """
    before = F.lag("locator").over(Window.partitionBy("query_id", "doc_id").orderBy("order"))
    part = F.when(before.eqNullSafe(F.col("locator")), F.col("text")).otherwise(F.concat(F.lit("## "), "locator", F.lit("\n\n"), "text"))
    by_doc = passages.withColumn("part", part).groupBy("query_id", "doc_id").agg(joined_in_order(["order"], F.col("part"), "\n\n").alias("body"))
    blocks = by_doc.join(documents.select("doc_id", "index", "name"), "doc_id").withColumn("block", wrapped(F.col("index"), F.col("name"), F.col("body")))
    return blocks.groupBy("query_id").agg(joined_in_order(["index"], F.col("block"), "\n\n").alias("context"))


def outline(sections: DataFrame, documents: DataFrame, most: int = 40) -> DataFrame:
    """(doc_id, line): the locators of each document's first ``most`` sections, and how many more there are."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_id"))
    first = sections.select("doc_id", "section_id", "locator", place.alias("n")).groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("n") <= most, F.struct("section_id", "locator")))), lambda x: x["locator"]), ", ").alias("shown"), F.count(F.lit(1)).alias("n")
    )
    more = F.when(F.col("n") > most, F.concat(F.lit(" (+"), (F.col("n") - most).cast("string"), F.lit(" more)"))).otherwise("")
    return first.join(documents.select("doc_id", "index", "name"), "doc_id").select(
        "doc_id", "index", F.concat(F.lit("Source "), F.col("index").cast("string"), F.lit(' ("'), "name", F.lit('") covers '), "shown", more).alias("line")
    )


def document_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line): number, name, kind and number of sections of each document; columns of tables are named, 120 characters at most."""
    columns = F.array_join("columns", ", ")
    extra = F.when(~F.col("kind").isin("csv", "xlsx"), F.lit("")).when(F.size("columns") > 0, F.concat(F.lit(", tabular data ("), F.substring(columns, 1, 120), F.lit(")"))).otherwise(F.lit(", tabular data"))
    return documents.select("doc_id", F.concat(F.col("index").cast("string"), F.lit(". "), "name", F.lit(" - "), "kind", F.lit(", "), F.col("sections").cast("string"), F.lit(" section(s)"), extra).alias("line"))


def allowed_tokens(context: Column, output: Column, reserve: Column) -> Column:
    """Tokens left for the prompt."""
    return F.greatest(context - output - reserve, F.lit(0))


def auto_strategy(selections: DataFrame, threshold: int = 0) -> DataFrame:
    """Adds strategy, budget and fits: full texts unless they exceed the character threshold (0: none) or the tokens allowed; passages
    then, with a budget that shrinks up to ``ATTEMPTS`` times until they fit.

    Columns: characters, full_tokens, allowed, and tokens_at (tokens of the passages at each attempt, the unshrunk budget first), max_characters.
    """
    large = (F.col("characters") > threshold) if threshold else F.lit(False)
    tried = F.slice("tokens_at", 1, ATTEMPTS + 1)
    fitting = F.filter(F.transform(tried, lambda t, i: F.when(t <= F.col("allowed"), i)), lambda i: i.isNotNull())
    attempt = F.coalesce(F.get(fitting, F.lit(0)), F.size(tried) - 1)
    passages = large | (F.col("full_tokens") > F.col("allowed"))
    budget = F.when(attempt == 0, F.col("max_characters")).otherwise(F.floor(F.col("max_characters") * F.pow(F.lit(SHRINK), attempt))).cast("int")
    return selections.withColumns({"strategy": F.when(passages, "retrieval").otherwise("full"), "budget": F.when(passages, budget), "fits": ~passages | (F.size(fitting) > 0)})


def compared(costs: DataFrame, key: str) -> DataFrame:
    """(key, full, retrieval, saved, percent, recommended) from rows (key, strategy, tokens)."""
    wide = costs.groupBy(key).pivot("strategy", ["full", "retrieval"]).agg(F.first("tokens")).fillna(0, ["full", "retrieval"])
    saved = F.col("full") - F.col("retrieval")
    return wide.withColumns({"saved": saved, "percent": F.coalesce(F.bround(F.try_divide(100 * saved, F.col("full")), 0), F.lit(0)).cast("int"), "recommended": F.when(saved > 0, "retrieval").otherwise("full")})


def usage(used: Column, total: Column, speed: Column) -> Column:
    """struct<percent, seconds>: share of the context in use, 100 at most, and the seconds to read it at a measured speed (tokens a second)."""
    half_up = lambda x: F.floor(x + 0.5).cast("int")
    return F.struct(F.coalesce(F.least(F.lit(100), half_up(F.try_divide(100 * used, total))), F.lit(0)).alias("percent"), F.when((used > 0) & (speed > 0), half_up(F.try_divide(used, speed))).alias("seconds"))


def history(messages: DataFrame, selected: DataFrame, most: int = 8) -> DataFrame:
    """The last ``most`` messages of each conversation that were asked about exactly the selected documents, in their order; none with an
    error, translated or empty. ``messages`` has conv_id, turn, text, error, translated_to and doc_ids; ``selected`` conv_id and doc_ids."""
    usable = messages.where(F.col("error").isNull() & F.col("translated_to").isNull() & (F.coalesce("text", F.lit("")) != ""))
    same = usable.join(selected.select("conv_id", F.col("doc_ids").alias("__chosen")), "conv_id").where(F.col("doc_ids") == F.col("__chosen")).drop("__chosen")
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return same.withColumn("__n", last).where(F.col("__n") <= most).drop("__n")
