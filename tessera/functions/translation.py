"""Citations kept through a translation: numbered marks stand for them, and lost ones are added at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.texts import CITATION, repair_citations

# Languages by their codes.
LANGUAGES = {"en": "English", "fi": "Finnish"}
_MARK = r"(?i)\[\[\s*C\s*([0-9]+)\s*\]\]"


def language_name(code: Column) -> Column:
    """English for en, Finnish for fi; another name as it is, 40 characters at most; English for none."""
    value = F.trim(F.coalesce(code, F.lit("")))
    known = F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.lower(value))
    return F.coalesce(known, F.nullif(F.substring(value, 1, 40), F.lit("")), F.lit("English"))


def _woven(parts: Column, between: Column) -> Column:
    """parts[0] between[0] parts[1] between[1] ..."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(between, i), F.lit("")))), "")


def protect(text: Column) -> Column:
    """struct<text, marks>: each citation replaced by [[C1]], [[C2]], ..., and the citations in order."""
    fixed = repair_citations(text)
    marks = F.regexp_extract_all(fixed, F.lit(CITATION), F.lit(0))
    numbered = F.transform(marks, lambda _, i: F.concat(F.lit("[[C"), (i + 1).cast("string"), F.lit("]]")))
    return F.struct(_woven(F.split(fixed, CITATION, -1), numbered).alias("text"), marks.alias("marks"))


def restore(text: Column, marks: Column) -> Column:
    """struct<text, kept, reattached>: numbers back to citations, unknown numbers dropped, lost citations added once each at the end."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(_MARK), F.lit(1)), lambda n: n.try_cast("int"))
    back = _woven(F.split(text, _MARK, -1), F.transform(numbers, lambda n: F.when((n >= 1) & (n <= F.size(marks)), F.get(marks, n - 1))))
    lost = F.filter(marks, lambda _, i: ~F.coalesce(F.array_contains(numbers, i + 1), F.lit(False)))
    added = F.concat(F.regexp_replace(back, r"(?U)\s+$", ""), F.lit("\n\n"), F.array_join(F.array_distinct(lost), " "))
    kept = F.size(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= F.size(marks)))))
    return F.struct(F.when(F.size(lost) > 0, added).otherwise(back).alias("text"), kept.alias("kept"), F.size(lost).alias("reattached"))


def output_budget(text: Column) -> Column:
    """Tokens to allow for a translation: half its characters, from 256 to 4096."""
    return F.least(F.greatest(F.floor(F.length(text) / 2).cast("int"), F.lit(256)), F.lit(4096))
