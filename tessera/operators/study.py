"""Quizzes: clean-up of proposed questions, grading of closed answers, totals and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSED = ("multiple_choice", "true_false")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def folded(text: Column) -> Column:
    """Lower-cased, white space as single spaces."""
    return F.regexp_replace(F.lower(stripped(text)), r"(?U)\s+", " ")


def citation_marker(source: Column) -> Column:
    """S1: Page 2 or (S1: Page 2) as [S1: Page 2]; anything else stays, without brackets around it."""
    bare = stripped(F.regexp_replace(stripped(F.coalesce(source, F.lit(""))), r"^[()\[\]]+|[()\[\]]+$", ""))
    return F.when(bare.rlike(r"^S[0-9]+\s*[:\-]"), F.concat(F.lit("["), bare, F.lit("]"))).otherwise(bare)


def clean_quiz(questions: DataFrame, types: list[str], count: int) -> DataFrame:
    """The first ``count`` questions of the wanted types of each quiz, by place, with options and answers in their proper form.

    Columns: quiz_id, place, type, options (array), answer, source. True-or-false answers become True or False; a letter stands for
    the option at its place (the last one, if there are fewer), unless an option is the answer itself.
    """
    first = Window.partitionBy("quiz_id").orderBy("place")
    kept = questions.where(F.col("type").isin(types)).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= count).drop("__n")
    truth = F.when(F.lower(stripped(F.col("answer"))).startswith("t"), "True").otherwise("False")
    letter = F.upper(F.regexp_extract("answer", r"^\s*([A-Da-d])[).\s]*$", 1))
    chosen = F.get("options", F.least(F.ascii(letter) - 65, F.size("options") - 1))
    choice = F.when((letter != "") & (F.size("options") > 0) & ~F.array_contains("options", F.col("answer")), chosen).otherwise(F.col("answer"))
    kind = F.col("type")
    return kept.withColumns(
        {
            "source": citation_marker(F.col("source")),
            "answer": F.when(kind == "true_false", truth).when(kind == "multiple_choice", choice).otherwise(F.col("answer")),
            "options": F.when(kind == "true_false", F.array(F.lit("True"), F.lit("False"))).otherwise(F.col("options")),
        }
    )


def bounded_score(score: Column) -> Column:
    """A proposed score as a whole number from 0 to 100."""
    return F.greatest(F.least(score.cast("int"), F.lit(100)), F.lit(0))


def grade(answers: DataFrame) -> DataFrame:
    """Adds correct, score and feedback to answers of closed questions, and to empty answers of others; the rest stay null for a grader.

    Columns: type, answer (the right one), explanation and given.
    """
    same = folded(F.coalesce("given", F.lit(""))) == folded(F.col("answer"))
    closed, empty = F.col("type").isin(*CLOSED), stripped(F.coalesce("given", F.lit(""))) == ""
    explanation = F.coalesce("explanation", F.lit(""))
    wrong = F.concat(F.lit("Not quite - the correct answer is: "), "answer", F.lit(". "), explanation)
    feedback = F.when(closed & same, F.concat(F.lit("Correct. "), explanation)).when(closed, wrong).when(empty, F.concat(F.lit("No answer given. Reference answer: "), "answer"))
    return answers.withColumns(
        {"correct": F.when(closed, same).when(empty, F.lit(False)), "score": F.when(closed, F.when(same, 100).otherwise(0)).when(empty, F.lit(0)), "feedback": stripped(feedback)}
    )


def totals(records: DataFrame, key: str) -> DataFrame:
    """(key, questions, right, total, average): the average score is rounded to even."""
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("questions"), F.count_if("correct").alias("right"), F.sum("score").alias("total"), F.bround(F.avg("score"), 0).cast("int").alias("average"))


def report_rows(records: DataFrame, key: str) -> DataFrame:
    """One row of text cells for each answer, numbered within its key, with the key's note on the score."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    note = F.format_string("Score: %d/%d correct, average %d%%", "right", "questions", "average")
    cells = records.join(totals(records, key).select(key, note.alias("note")), key)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return cells.select(
        key, number.cast("string").alias("number"), *(text(c).alias(c) for c in ("question", "type", "given", "answer")), F.when(F.col("correct"), "yes").otherwise("no").alias("correct"), text("score").alias("score"),
        text("feedback").alias("feedback"), text("source").alias("source"), "note",
    )
