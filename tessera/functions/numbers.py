"""Written numbers (English, Finnish, German notation) as DataFrame columns; everything stays in the JVM.

``NOTATIONS`` says which spellings are numbers and how to read them; the column reader and the reader of plan literals both use it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_S = "[    ]"
#: (pattern of the whole text, marks to drop, decimal mark or "", for which decimal_comma: any, True, False or not-True).
NOTATIONS = [
    (r"0[0-9].*", None, "", "any"),  # a leading zero marks an identifier
    (rf"[0-9]{{1,3}}(?:{_S}[0-9]{{3}})+", _S, "", "any"),
    (rf"[0-9]{{1,3}}(?:{_S}[0-9]{{3}})+,[0-9]+", _S, ",", "any"),
    (rf"[0-9]{{1,3}}(?:{_S}[0-9]{{3}})+\.[0-9]+", _S, ".", "any"),
    (r"[0-9]+", "", "", "any"),
    (r"[0-9]{1,3}(?:,[0-9]{3})+\.[0-9]+", ",", ".", "any"),
    (r"[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]+", r"\.", ",", "any"),
    (r"[0-9]{1,3}(?:,[0-9]{3}){2,}", ",", "", "any"),
    (r"[0-9]{1,3}(?:\.[0-9]{3}){2,}", r"\.", "", "any"),
    (r"(?:[1-9][0-9]{0,2}),[0-9]{3}", "", ",", "comma"),
    (r"(?:[1-9][0-9]{0,2}),[0-9]{3}", ",", "", "dot"),
    (r"(?:[1-9][0-9]{0,2})\.[0-9]{3}", r"\.", "", "comma"),
    (r"(?:[1-9][0-9]{0,2})\.[0-9]{3}", "", ".", "not comma"),
    (r"[1-9][0-9]{0,2},[0-9]{3}", None, "", "any"),  # ambiguous without a convention
    (r"[0-9]+,[0-9]+", "", ",", "any"),
    (r"[0-9]+\.[0-9]+", "", ".", "any"),
]
# Spellings that show a column's decimal mark.
COMMA_SHOWN = [r"[0-9],[0-9]{1,2}$", r"[0-9],[0-9]{4,}$", r"[0-9]\.[0-9]{3},[0-9]+$", r"^[0-9]{1,3}(?:\.[0-9]{3}){2,}$"]
DOT_SHOWN = [r"[0-9]\.[0-9]{1,2}$", r"[0-9]\.[0-9]{4,}$", r"[0-9],[0-9]{3}\.[0-9]+$", r"^[0-9]{1,3}(?:,[0-9]{3}){2,}$"]


def _holds(when: str, comma: bool | None) -> bool:
    return {"any": True, "comma": comma is True, "dot": comma is False, "not comma": comma is not True}[when]


def read_number(text: Column, decimal_comma: bool | Column | None = None) -> Column:
    """The double a text writes, or null when it is no number or ambiguous; ``decimal_comma`` is the column's convention."""
    s = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s*%$", "")
    negative = s.rlike("^[-−]")
    s = F.regexp_replace(s, "(?U)^[-+−]\\s*", "")
    value = None
    for pattern, drop, mark, when in NOTATIONS:
        if isinstance(decimal_comma, Column):
            known = {"any": F.lit(True), "comma": F.coalesce(decimal_comma, F.lit(False)), "dot": F.coalesce(~decimal_comma, F.lit(False)), "not comma": ~F.coalesce(decimal_comma, F.lit(False))}[when]
        elif _holds(when, decimal_comma):
            known = F.lit(True)
        else:
            continue
        plain = s if not drop else F.regexp_replace(s, drop, "")
        plain = F.replace(plain, F.lit(","), F.lit(".")) if mark == "," else plain
        found = F.lit(None).cast("double") if drop is None else plain.try_cast("double")
        test = known & s.rlike(f"^(?:{pattern})$")
        value = F.when(test, found) if value is None else value.when(test, found)
    return F.when(negative, -value).otherwise(value)


def number_literal(text: str, decimal_comma: bool | None = None) -> int | float | None:
    """The same reading of one literal of a plan."""
    s = re.sub(r"\s*%$", "", text.strip())
    sign, s = ("-" if s[:1] in ("-", "−") else ""), re.sub("^[-+−]\\s*", "", s)
    for pattern, drop, mark, when in NOTATIONS:
        if _holds(when, decimal_comma) and re.fullmatch(pattern, s, re.ASCII):
            if drop is None:
                return None
            plain = sign + (re.sub(drop, "", s) if drop else s).replace("," if mark == "," else "\0", ".")
            return float(plain) if mark else int(plain)
    return None


def decimal_comma_vote(text: Column) -> Column:
    """Aggregate: true or false when the values show which mark is the decimal mark, else null."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s*%$", ""), _S, " ")
    comma, dot = (F.coalesce(F.bool_or(s.rlike("|".join(shown))), F.lit(False)) for shown in (COMMA_SHOWN, DOT_SHOWN))
    return F.when(comma != dot, comma)


def csv_safe(cell: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a leading apostrophe, unless it is a number."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]") & read_number(cell).isNull(), F.concat(F.lit("'"), cell)).otherwise(cell)


_TOKEN = r"(?U)(?<![\w.,])([0-9]{1,3}(?:[   ,.][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)(?!\w)"


def number_tokens(text: Column) -> Column:
    """Numbers as written in a text, in order."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))


def readings(token: Column) -> Column:
    """array<double> of every value a written number can mean: 1,148 is 1148 or 1.148."""
    t = F.regexp_replace(token, "[  ]", " ")
    bare = F.regexp_replace(t, "[.,]", "")
    marks = F.length(t) - F.length(bare)
    spaced = F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    last = F.regexp_extract(t, r"^.*([.,])[0-9]*$", 1)
    mixed = t.contains(",") & t.contains(".")
    split_last = F.concat(F.regexp_replace(F.regexp_extract(t, r"^(.*)[.,][0-9]*$", 1), "[.,]", ""), F.lit("."), F.regexp_extract(t, r"[.,]([0-9]*)$", 1))
    single = F.replace(t, F.lit(","), F.lit("."))
    out = (
        F.when(t.contains(" "), F.array(spaced))
        .when(marks == 0, F.array(t))
        .when((marks == 1) & t.rlike(r"[.,][0-9]{3}$"), F.array(single, bare))
        .when(marks == 1, F.array(single))
        .when(mixed & (last != ""), F.array(split_last))
        .otherwise(F.array(bare))
    )
    return F.filter(F.transform(out, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 1e-6 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def checked_tokens(answer: Column) -> Column:
    """Numbers of an answer that a source must hold, as written, in order: citation marks, list numbers and whole numbers up to 12 don't count."""
    text = F.regexp_replace(F.regexp_replace(answer, r"\[S[0-9]+[^\]]{0,100}\]", " "), r"(?mU)^\s*[0-9]+[.)]\s", " ")
    small = lambda v: (v == F.floor(v)) & (v <= 12)
    return F.filter(number_tokens(text), lambda t: ~F.forall(readings(t), small))


def unsupported_numbers(answer: Column, known: Column) -> Column:
    """Tokens of an answer none of whose readings is close to one of ``known`` (array<double>, a short one; ``grounding.unsupported`` joins)."""
    return F.filter(checked_tokens(answer), lambda t: ~F.exists(readings(t), lambda v: F.exists(known, lambda k: close(v, k))))


#: Width of a band; two close numbers differ by little more than half of it on the bands' scale.
BAND = 2e-6


def band(v: Column) -> Column:
    """The band of a number, as a long: even steps up to 1, logarithmic ones above, so that close numbers lie in the same band or in neighbours."""
    scaled = F.when(F.abs(v) <= 1, v).otherwise(F.signum(v) * (1 + F.log(F.abs(v))))
    return F.floor(scaled / BAND)


def bands(v: Column) -> Column:
    """The bands in which numbers close to ``v`` lie."""
    return F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: band(v) + i)
