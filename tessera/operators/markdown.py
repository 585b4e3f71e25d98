"""Markdown texts as blocks and as LaTeX. Lines are rows; windows over a document's lines find what belongs together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.texts import row_cells

RULE = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"
_INLINE = r"\*\*[^*]+\*\*|__[^_]+__|`[^`]+`|\*[^*\s][^*]*\*|_[^_\s][^_]*_"
#: Characters of text whose lines one part holds about: the windows' memory is that of a part, however large the input is.
PART = 4_000_000
_LEVELS = ("section", "subsection", "subsubsection", "paragraph", "subparagraph", "subparagraph")


def _kind(line: Column) -> Column:
    return (
        F.when(line == "", "blank").when(line.rlike(r"^#{1,6}\s+"), "heading").when(line.rlike(r"^[-*+]\s+"), "bullets").when(line.rlike(r"^[0-9]+[.)]\s+"), "numbered")
        .when(line.startswith(">"), "quote").when(line.rlike(r"^(-{3,}|\*{3,}|_{3,})$"), "rule").otherwise("paragraph")
    )


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block, kind, level, text, items, rows): headings, paragraphs, bullets, numbered lists, quotes, code and tables, in order from 1.

    A table needs a line of dashes after its first; text between ``` lines is code. Blank lines and rules only divide.
    """
    size = docs.agg(F.coalesce(F.sum(F.length(text) + 100), F.lit(0))).first()[0]  # a document has its lines' rows besides
    docs = docs.select(key, text).repartition(max(1, -(-size // PART)), key)
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("n", "line")).withColumn("bare", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    order = Window.partitionBy(key).orderBy("n")
    lines = lines.withColumn("fence", F.col("bare").startswith("```")).withColumn("open", F.sum(F.col("fence").cast("int")).over(order) % 2 == 1)
    lines = lines.withColumn("code", F.col("open") & ~F.col("fence")).withColumn("pipe", F.col("bare").startswith("|") & ~F.col("code") & ~F.col("fence"))
    lines = lines.withColumn("head", F.col("pipe") & F.coalesce(F.lead("line").over(order).rlike(RULE), F.lit(False)))
    lines = lines.withColumn("run", F.sum((~F.col("pipe")).cast("int")).over(order))
    lines = lines.withColumn("table", F.col("pipe") & (F.max(F.col("head").cast("int")).over(Window.partitionBy(key, "run").orderBy("n")) == 1))
    lines = lines.withColumn("kind", F.when(F.col("fence"), "fence").when(F.col("code"), "code").when(F.col("table"), "table").otherwise(_kind(F.col("bare"))))
    new = (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    lines = lines.withColumn("run", F.sum(new.cast("int")).over(order)).where(~F.col("kind").isin("blank", "rule", "fence"))
    found = lines.groupBy(key, "run", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "line", "bare"))), lambda x: x.dropFields("n")).alias("lines"))
    found = found.withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy("run")))
    kind, bare = F.col("kind"), lambda cut: F.transform("lines", lambda x: F.trim(F.regexp_replace(x["bare"], cut, "")))
    first = F.get("lines", F.lit(0))["bare"]
    body = (
        F.when(kind == "heading", F.trim(F.regexp_replace(F.regexp_replace(first, r"^#{1,6}\s+", ""), r"\s*#+\s*$", ""))).when(kind == "paragraph", F.array_join(bare("^$"), " "))
        .when(kind == "quote", F.array_join(bare(r"^>+\s*"), " ")).when(kind == "code", F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    )
    items = F.when(kind == "bullets", bare(r"^[-*+]\s+")).when(kind == "numbered", bare(r"^[0-9]+[.)]\s+"))
    rows = F.when(kind == "table", F.transform(F.filter("lines", lambda _, i: i != 1), lambda x: row_cells(x["line"])))
    return found.select(key, "block", "kind", F.when(kind == "heading", F.length(F.regexp_extract(first, "^(#+)", 1))).alias("level"), body.alias("text"), items.alias("items"), rows.alias("rows"))


def latex_escaped(text: Column) -> Column:
    s = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\u0001")), r"([&%$#_{}])", r"\\$1")
    s = F.replace(F.replace(s, F.lit("~"), F.lit(r"\textasciitilde{}")), F.lit("^"), F.lit(r"\textasciicircum{}"))
    return F.replace(s, F.lit("\u0001"), F.lit(r"\textbackslash{}"))


def latex_inline(text: Column) -> Column:
    """Bold, italic and code marks as LaTeX; links as text (address)."""
    linked = F.regexp_replace(text, r"\[([^\]]+)\]\(([^)]+)\)", "$1 ($2)")
    marks = F.regexp_extract_all(linked, F.lit(_INLINE), F.lit(0))
    double = lambda m: latex_escaped(F.substring(m, F.lit(3), F.length(m) - 4))
    single = lambda m: latex_escaped(F.substring(m, F.lit(2), F.length(m) - 2))
    shown = F.transform(
        marks, lambda m: F.when(m.startswith("**") | m.startswith("__"), F.concat(F.lit(r"\textbf{"), double(m), F.lit("}"))).when(m.startswith("`"), F.concat(F.lit(r"\texttt{"), single(m), F.lit("}"))).otherwise(F.concat(F.lit(r"\emph{"), single(m), F.lit("}")))
    )
    return F.array_join(F.transform(F.split(linked, _INLINE, -1), lambda p, i: F.concat(latex_escaped(p), F.coalesce(F.get(shown, i), F.lit("")))), "")


def latex(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, latex): the body of a LaTeX document from ``blocks``; preambles and titles are the writer's."""
    kind, nl = F.col("kind"), "\n"
    around = lambda name, inner: F.concat(F.lit(f"\\begin{{{name}}}\n"), inner, F.lit(f"\n\\end{{{name}}}"))
    items = F.array_join(F.transform("items", lambda x: F.concat(F.lit("  \\item "), latex_inline(x))), nl)
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    cells = lambda r, head: F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.when(head, F.concat(F.lit(r"\textbf{"), latex_inline(F.coalesce(F.get(r, c), F.lit(""))), F.lit("}"))).otherwise(latex_inline(F.coalesce(F.get(r, c), F.lit("")))))
    rows = F.array_join(F.transform("rows", lambda r, i: F.concat(F.array_join(cells(r, i == 0), " & "), F.lit(" \\\\"), F.when(i == 0, "\n\\midrule").otherwise(""))), nl)
    table = F.concat(F.lit("\\begin{longtable}{"), F.repeat(F.lit("l"), width), F.lit("}\n\\toprule\n"), rows, F.lit("\n\\bottomrule\n\\end{longtable}"))
    level = F.element_at(F.array(*map(F.lit, _LEVELS)), F.coalesce("level", F.lit(1)))
    part = (
        F.when(kind == "heading", F.concat(F.lit("\\"), level, F.lit("*{"), latex_inline(F.col("text")), F.lit("}"))).when(kind == "bullets", around("itemize", items)).when(kind == "numbered", around("enumerate", items))
        .when(kind == "quote", around("quote", latex_inline(F.col("text")))).when(kind == "code", around("verbatim", F.col("text"))).when(kind == "table", table).otherwise(latex_inline(F.col("text")))
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", part.alias("part")))), lambda x: x["part"]), "\n\n")
    return found.groupBy(key).agg(joined.alias("latex"))
