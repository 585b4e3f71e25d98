"""Personal data in texts: prioritised patterns whose matches claim their place, and consistent redaction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns in order of priority; an earlier one's match keeps later ones off its characters.
PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("iban", r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,4})?\b"),
    ("credit_card", r"\b(?:\d[ -]?){13,19}\b"),
    ("id_number", r"\b\d{6}[-+A]\d{3}[0-9A-Z]\b"),
    ("phone", r"(?<![\w/])(?:\+\d{1,3}[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?)\d{3}[\s-]?\d{2,4}(?:[\s-]?\d{2,4})?(?!\w)"),
    ("ip_address", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
]
# The words of automatic placeholders by category.
PLACEHOLDERS = {
    "person": "PERSON", "email": "EMAIL", "phone": "PHONE", "address": "ADDRESS", "organization": "ORG",
    "id_number": "ID", "iban": "IBAN", "credit_card": "CARD", "date_of_birth": "DOB", "ip_address": "IP", "other": "REDACTED",
}
_COMPILED = [(c, re.compile(p)) for c, p in PATTERNS]
_AMOUNT = re.compile("[1-9][0-9]{0,2}(?:[   ][0-9]{3})+")


def luhn(digits: Column) -> Column:
    """Whether at least 13 digits pass the Luhn check, as a column expression over a text of digits."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    total = F.aggregate(turned, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return (F.length(digits) >= 13) & (total % 10 == 0)


def _accepted(category: str, value: str) -> bool:
    digits = [int(c) for c in value if c.isdecimal()]
    if category == "phone":
        return len(digits) >= 7 and not _AMOUNT.fullmatch(value)
    if category == "credit_card":
        doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))]
        return len(digits) >= 13 and sum(doubled) % 10 == 0
    return True


def claimed_matches(text: str) -> list[tuple[str, str, int, int]]:
    """(category, text, start, end) of all matches, patterns in order; rejected matches claim nothing."""
    found, claimed = [], bytearray(len(text))
    for category, pattern in _COMPILED:
        for m in pattern.finditer(text):
            value = m.group().strip()
            if any(claimed[m.start() : m.end()]) or not _accepted(category, value):
                continue
            claimed[m.start() : m.end()] = b"\1" * (m.end() - m.start())
            found.append((category, value, m.start(), m.end()))
    return found


_FINDING = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("category", "text", "context")]))


def in_context(text: str, start: int, end: int, reach: int = 40) -> str:
    """A match with ``reach`` characters around it, on one line."""
    a, b = max(start - reach, 0), min(end + reach, len(text))
    return ("…" if a else "") + text[a:b].replace("\n", " ") + ("…" if b < len(text) else "")


#: Texts that are Python's own at a time; Arrow's batches may hold ten thousand.
TEXTS = 256


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, found) of (key, text): matches with their surroundings, in order; texts stay behind."""
    kind = pa.list_(pa.struct([(c, pa.string()) for c in ("category", "text", "context")]))
    for batch in batches:
        for begin in range(0, batch.num_rows, TEXTS):
            keys, texts = batch.slice(begin, TEXTS).columns
            found = [[{"category": c, "text": v, "context": in_context(t, a, b)} for c, v, a, b in claimed_matches(t)] for t in (x.as_py() or "" for x in texts)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, kind)], names=[batch.schema.names[0], "found"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, category, text, count, context): findings by distinct text, letter case aside, written and classed as they first appear.

    Only texts with a digit or an @ go to Python; the others can't hold a finding. What comes back is the findings and their contexts.
    """
    kind = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("found", _FINDING)])
    some = docs.where(F.col(text).rlike("[0-9@]")).select(key, text).mapInArrow(_findings, kind)
    hits = some.select(key, F.posexplode("found").alias("place", "f"))
    return (
        hits.groupBy(key, F.lower("f.text").alias("__folded"))
        .agg(F.min_by("f", "place").alias("f"), F.count(F.lit(1)).alias("count"))
        .select(key, "f.category", "f.text", "count", "f.context")
    )


def _occurrences(item: Column) -> Column:
    quoted = F.regexp_replace(item, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    word = r"(?U)^[\p{L}\p{N}]"
    return F.concat(F.lit("(?iU)"), F.when(item.rlike(word), r"(?<!\w)").otherwise(""), quoted, F.when(item.rlike(r"(?U)[\p{L}\p{N}]$"), r"(?!\w)").otherwise(""))


# What a proposal of no category is by its form.
_NAME = "^[A-Z\u00c0-\u00dd][a-z\u00df-\u00ff'-]+(?: [A-Z\u00c0-\u00dd][a-z\u00df-\u00ff'-]+){1,3}$"
_NUMBER = "^[A-Z]{0,3}-?[0-9]{2,}[A-Z]?$"


def merge_findings(found: DataFrame, proposed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, category, text, count, detected_by): pattern findings and the proposals that hold.

    ``proposed`` has key, place, category and text. A proposal is dropped if it is shorter than two characters, known already, or
    not in the document as a whole word; one of category other becomes a person or a number by its form, and a single capitalised
    word of it is dropped. It is written and counted as it stands in the document.
    """
    item = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    named = proposed.select(key, "place", "category", item.alias("item")).where(F.length("item") >= 2).withColumn("folded", F.lower("item"))
    other = F.col("category") == "other"
    kind = F.when(other & F.col("item").rlike(_NAME), "person").when(other & F.col("item").rlike(_NUMBER), "id_number").otherwise(F.col("category"))
    alone = other & (kind == "other") & ~F.col("item").rlike(r"(?U)\s") & F.col("item").rlike(r"^\p{Lu}")
    named = named.withColumn("category", kind).where(~alone)
    named = named.join(found.select(key, F.lower("text").alias("folded")).distinct(), [key, "folded"], "left_anti")
    met = named.join(docs.select(key, F.col(text).alias("__text")), key).withColumn("hits", F.regexp_extract_all("__text", _occurrences(F.col("item")), F.lit(0))).where(F.size("hits") > 0)
    first = met.groupBy(key, F.lower(F.get("hits", F.lit(0))).alias("folded")).agg(F.min_by(F.struct("category", F.get("hits", F.lit(0)).alias("text"), F.size("hits").cast("long").alias("count")), "place").alias("f"))
    new = first.select(key, "f.category", "f.text", "f.count", F.lit("proposal").alias("detected_by"))
    return found.select(key, "category", "text", "count", F.lit("pattern").alias("detected_by")).unionByName(new)


def findings_order() -> list[Column]:
    """By category, the most frequent first."""
    return [F.col("category"), F.desc("count"), F.col("text")]


def redact(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, mapping): every whole-word occurrence of a document's items, the longest first, replaced by the item's own
    replacement or a placeholder numbered by category. ``items`` has key, text, category, replacement and place (order given)."""
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PLACEHOLDERS.items() for x in kv)), F.col("category")), F.lit("REDACTED"))
    own = F.trim(F.coalesce("replacement", F.lit("")))
    named = items.where(F.trim("text") != "").select(key, F.trim("text").alias("item"), "place", own.alias("own"), label.alias("label"))
    order = Window.partitionBy(key, "label", F.col("own") == "").orderBy(F.desc(F.length("item")), "place")
    named = named.withColumn("by", F.when(F.col("own") != "", F.col("own")).otherwise(F.concat(F.lit("["), F.col("label"), F.lit("-"), F.row_number().over(order).cast("string"), F.lit("]"))))
    lists = named.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.length("item")).alias("n"), "place", "item", "by"))).alias("items"))
    joined = docs.select(key, text).join(lists, key, "left")
    safe = lambda s: F.regexp_replace(s, r"([\\$])", r"\\$1")
    done = F.aggregate(F.coalesce("items", F.array().cast("array<struct<n:int,place:int,item:string,by:string>>")), F.col(text), lambda t, i: F.regexp_replace(t, _occurrences(i["item"]), safe(i["by"])))
    mapping = F.map_from_entries(F.array_distinct(F.transform("items", lambda i: F.struct(i["item"], i["by"]))))
    return joined.select(key, done.alias(text), mapping.alias("mapping"))
