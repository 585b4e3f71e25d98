"""Text rules for answers: citation marks, thinking blocks, refusals, list items, sentences, patterns. All are column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numbers import close, number_tokens, readings

# How a citation mark is written (digits are 0-9 alone, since Java's \\d means other signs in Unicode mode).
CITATION = r"\[S([0-9]+)(?:\s+[^\]:]{1,60})?\s*[:\-–]\s*([^\]]{1,80})\]"

# Phrases by which an answer says that the documents don't hold something, English and Finnish.
REFUSALS = [
    r"(?:\bnot\b|n't\b)[^.\n]{0,60}\b(mention\w*|provide\w*|specif\w*|state\w*|given|available|include\w*|list\w*|found|contain\w*|report\w*|disclose\w*|cover\w*|present\w*|identif\w*|name\w*|refer\w*|discuss\w*|appear\w*|say|says|said|give|gives|show\w*)",
    r"\bno\s+(information|mention|data|details?|record)\b",
    r"\b(cannot|can't|could not|couldn't|unable to)\b[^.\n]{0,40}\b(find|determine|answer|locate|identify)",
    r"\bnone of the (documents|sources)\b",
    r"\bei(vät)?\b[^.\n]{0,60}\b(mainit\w*|kerro\w*|kerrota|löyd\w*|löyt\w*|ilmene\w*|ilmoit\w*|anneta|esitetä|esitet\w*|sisäll\w*|kata|määrit\w*|raportoi\w*|tietoa)",
    r"\b(ei|en)\s+(ole\s+)?(tietoa|löydy|löytynyt|pysty|voi\s+päätellä)",
    r"\bei(vät)?\s+(ole\s+)?(annet\w*|anna|tarjo\w*|saatavilla|käytettävissä)",
    r"\btietoa\b[^.\n]{0,30}\bei\b",
    r"\bei\s+käy\s+ilmi\b",
]
# Text of a prompt that has no place in an answer.
LEAKS = ("harmonic mean of precision and recall", "<your sentence", "[S<id>")


def plain(text: Column) -> Column:
    """Lower-cased letters a-z and digits, runs of all else as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


# The patterns in the next four functions are fixed values too: which line and mark forms count.
def repair_citations(text: Column) -> Column:
    """[words](S1: Page 3) becomes words [S1: Page 3]."""
    return F.regexp_replace(text, r"\[([^\]\n]{1,400})\]\(\s*(S[0-9]+[^)\n]{0,80}?)\s*\)", r"$1 [$2]")


def citation_marks(text: Column) -> Column:
    """Distinct citation marks in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(repair_citations(text), F.lit(CITATION), F.lit(0)))


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def strip_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?(</think>|$)", ""))


def is_refusal(text: Column) -> Column:
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in REFUSALS))


def leaks_prompt(text: Column) -> Column:
    return F.lower(text).rlike("|".join(re.escape(p.lower()) for p in LEAKS))


def listed_text(answer: Column) -> Column:
    """The list items, bold lines and table rows of an answer, by line; the whole answer if it has none."""
    items = F.regexp_extract_all(answer, F.lit(r"(?m)^\s*(?:[-*•]\s+|[0-9]+[.)]\s+|\*\*|\|(?!\s*:?-))(.*)$"), F.lit(1))
    return F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(answer)


def units(answer: Column) -> Column:
    """Sentences, list items and table rows in reading order; headings and table rules are left out."""
    lines = F.transform(F.split(answer, r"\R"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.rlike(r"^\s*\|?\s*:?-{3,}"))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|[0-9]+[.)])\s+", "")))
    parts = F.flatten(F.transform(lines, lambda x: F.when(x.startswith("|"), F.array(F.trim(F.regexp_replace(x, r"^\|+|\|+$", "")))).otherwise(F.split(x, r"(?<=[.!?])\s+(?=[\"'(*_]?[A-ZÅÄÖ0-9])"))))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def is_factual(unit: Column) -> Column:
    """Five words or more, no colon at the end, no refusal."""
    text = F.trim(without_citations(unit))
    return ~text.endswith(":") & (F.size(words(text)) >= 5) & ~is_refusal(text)


def citation_coverage(answer: Column) -> Column:
    """array<struct<text, cited>> of an answer's factual units; a unit of citations alone counts for the one before."""
    start = F.array().cast("array<struct<text:string,cited:boolean>>")

    def step(done: Column, unit: Column) -> Column:
        alone = F.regexp_replace(without_citations(unit), r"^[ .;,]+|[ .;,]+$", "") == ""
        last = F.size(done) - 1
        marked = F.transform(done, lambda x, i: F.struct(x["text"].alias("text"), (x["cited"] | (i == last)).alias("cited")))
        added = F.concat(done, F.array(F.struct(unit.alias("text"), unit.rlike(CITATION).alias("cited"))))
        return F.when(alone, marked).when(is_factual(unit), added).otherwise(done)

    return F.aggregate(units(repair_citations(answer)), start, step)


def matches(pattern: Column, text: Column) -> Column:
    """num:N (any reading of a number in the text), re:R (regular expression) or a part of the text, letter case aside."""
    want = F.substring(pattern, 5, 400).try_cast("double")
    number = F.exists(number_tokens(text), lambda t: F.exists(readings(t), lambda v: close(v, want)))
    fold = lambda x: F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    return (
        F.when(pattern.startswith("num:"), F.coalesce(number, F.lit(False)))
        .when(pattern.startswith("re:"), F.regexp_like(text, F.concat(F.lit("(?iU)"), F.substring(pattern, 4, 400))))
        .otherwise(fold(text).contains(fold(pattern)))
    )


# Names that Windows refuses for files, whatever their ending.
RESERVED = ["con", "prn", "aux", "nul", *(f"{kind}{n}" for kind in ("com", "lpt") for n in range(1, 10))]


def file_name(name: Column, default: str = "") -> Column:
    """The last part of a path without characters that file systems refuse, at most 150 characters long.

    Composed accents are the caller's business: Spark has no function for Unicode's normal forms.
    """
    last = F.regexp_extract(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    s = F.regexp_replace(F.regexp_replace(last, r"(?U)^\s+|\s+$", ""), r"\p{Z}", " ")
    s = F.regexp_replace(F.regexp_replace(s, r'[\p{C}<>:"/\\|?*]+', "_"), r"^[. ]+|[. ]+$", "")
    s = F.when(F.lower(F.substring_index(s, ".", 1)).isin(RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
    return F.substring(F.when(s == "", default).otherwise(s), 1, 150)


def slug(text: Column, fallback: str) -> Column:
    """Letters and digits with single underscores between them, 60 characters at most."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9\u00c0-\u024f\u0400-\u04ff\u4e00-\u9fff\u0600-\u06ff]+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, 60), F.lit("")), F.lit(fallback))


def extension(name: Column) -> Column:
    """The lower-cased ending of a file's name, without its dot; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*\.([^./]+)$", 1))


def backed_statement(answer: Column, marker: Column) -> Column:
    """What a citation mark backs: the text since the last end of a sentence or line before the mark's first place, without marks and signs."""
    text = repair_citations(answer)
    before = F.regexp_replace(F.substring(text, F.lit(1), F.instr(text, marker) - 1), r"\[S[0-9]+[^\]]*\]", " ")
    parts = F.filter(F.transform(F.split(before, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.instr(text, marker) > 0, F.trim(F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"[*_`#|>]+", " "))).otherwise("")


def evidence_terms(text: Column) -> Column:
    """Numbers without marks, and the first five letters of words of four or more."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}.,]*"), F.lit(0)), lambda w: F.regexp_replace(w, r"[.,]+$", ""))
    return F.array_distinct(F.transform(F.filter(found, lambda w: w.rlike("[0-9]") | (F.length(w) >= 4)), lambda w: F.when(w.rlike("[0-9]"), F.regexp_replace(w, "[.,]", "")).otherwise(F.substring(w, 1, 5))))


def best_evidence(markdown: Column, statement: Column) -> Column:
    """struct<block, row> of the passage's block, or row of a table, that shares most with a statement (a number counts three words); the
    first of equals, null if nothing is shared. Blocks and rows count from 0, rows after the table's head."""
    wanted = evidence_terms(statement)
    blocks = F.filter(F.transform(F.split(markdown, r"\n\s*\n"), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", "")), lambda b: b != "")
    lines = lambda b: F.split(b, "\n")
    is_table = lambda b: (F.size(lines(b)) > 2) & F.forall(lines(b), lambda x: F.ltrim(x).startswith("|"))
    no_row = F.lit(None).cast("int")
    parts = F.flatten(
        F.transform(
            blocks,
            lambda b, i: F.when(is_table(b), F.transform(F.slice(lines(b), 3, 1_000_000), lambda x, r: F.struct(x.alias("text"), i.alias("block"), r.alias("row")))).otherwise(F.array(F.struct(b.alias("text"), i.alias("block"), no_row.alias("row")))),
        )
    )
    score = lambda t: F.aggregate(F.array_intersect(evidence_terms(t), wanted), F.lit(0), lambda a, w: a + F.when(w.rlike("[0-9]"), 3).otherwise(1))
    start = F.struct(F.lit(0).alias("score"), no_row.alias("block"), no_row.alias("row"))

    def better(best: Column, p: Column) -> Column:
        return F.when(p["score"] > best["score"], p).otherwise(best)

    scored = F.transform(parts, lambda p: F.struct(score(p["text"]).alias("score"), p["block"].cast("int").alias("block"), p["row"].cast("int").alias("row")))
    best = F.aggregate(scored, start, better)
    return F.when(best["score"] > 0, F.struct(best["block"].alias("block"), best["row"].alias("row")))


def flag_numbers(text: Column, numbers: Column) -> Column:
    """The text with each of the given numbers as [number](flag:i), where it isn't part of a longer number or of a citation's link."""
    tokens = F.transform(numbers, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    literal = lambda n: F.regexp_replace(F.regexp_replace(n, r"([.*+?^${}()|\[\]\\])", r"\\$1"), r"\s+", r"\\s+")
    pattern = lambda n: F.concat(F.lit(r"(?<![0-9.,\w])("), literal(n), F.lit(r")(?![0-9\w]|[.,][0-9])(?![^\[]*\]\(cite:)"))
    return F.aggregate(tokens, text, lambda t, x: F.regexp_replace(t, pattern(x["n"]), F.concat(F.lit("[$1](flag:"), x["i"].cast("string"), F.lit(")"))))


def json_text(answer: Column) -> Column:
    """The JSON in a model's answer: without a code fence, else from the first brace to the last; null if it isn't JSON."""
    t = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    bare = F.when(t.startswith("```"), F.regexp_replace(t, r"(?s)^```(?:json)?\s*|\s*```$", "")).otherwise(t)
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    valid = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(valid(bare), bare).when(valid(inner), inner)


def row_cells(line: Column) -> Column:
    """The cells of a Markdown table's line; \\| is a pipe in a cell."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def findings_text(claims: Column) -> Column:
    """Lines on the claims (array<struct<verdict, claim, evidence>>) that the sources don't hold up, for an answer to be written anew."""
    bad = F.filter(claims, lambda c: c["verdict"].isin("unsupported", "contradicted", "partially_supported"))
    said = lambda c: F.when(F.coalesce(c["evidence"], F.lit("")) != "", F.concat(F.lit(' (source says: "'), c["evidence"], F.lit('")'))).otherwise("")
    lines = F.transform(bad, lambda c: F.concat(F.lit("- ["), c["verdict"], F.lit("] "), c["claim"], said(c)))
    return F.when(F.size(bad) > 0, F.array_join(lines, "\n")).otherwise("- (no specific findings)")


def markdown_row(cells: list[Column]) -> Column:
    """One line of a Markdown table: pipes escaped, line breaks as spaces, null as empty."""
    plain_cells = [F.coalesce(F.regexp_replace(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), r"\R", " "), F.lit("")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *plain_cells), F.lit(" |"))
