"""Dated events checked against their sources: the date must stand in a paragraph or table row that also names the event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grounding import best_sections

# Month names (Finnish by their stems) and words that don't tell events apart.
EN_MONTHS = "january february march april may june july august september october november december".split()
FI_MONTHS = "tammikuu helmikuu maaliskuu huhtikuu toukokuu kesäkuu heinäkuu elokuu syyskuu lokakuu marraskuu joulukuu".split()
GENERIC = (
    "vuonna vuoden year years month planned expected will with from that this kuluessa mennessä alussa lopussa aikana during beginning end date päivä päivämäärä aika"
).split()


def _valid(y: Column, m: Column, d: Column) -> Column:
    """struct<y, m, d> of a date that the calendar has, with null for parts not given."""

    def checked(s: Column) -> Column:
        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        day = F.concat_ws("-", F.lpad(s["y"].cast("string"), 4, "0"), two(s["m"]), two(s["d"])).try_cast("date").isNotNull()
        good = F.when(s["d"].isNotNull(), day).otherwise(s["m"].isNull() | s["m"].between(1, 12))
        return F.when(s["y"].isNotNull() & good, s)

    parts = F.struct(y.alias("y"), F.nullif(m, F.lit(0)).alias("m"), F.nullif(d, F.lit(0)).alias("d"))
    return F.get(F.transform(F.array(parts), checked), F.lit(0))  # the parts are computed once, not wherever they are used


def parse_iso(text: Column) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(text, r"^\s*([0-9]{4})(?:-([0-9]{1,2})(?:-([0-9]{1,2}))?)?\s*$", k), F.lit("")).cast("int")
    return _valid(part(1), part(2), part(3))


def parse_date_text(text: Column) -> Column:
    """A date written in English or Finnish: ISO, d.m.yyyy, or a year with a month name and perhaps a day."""
    t = F.lower(text)
    part = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit("")).cast("int")
    iso, dotted = r"(?U)\b([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\b", r"(?U)\b([0-9]{1,2})\.\s?([0-9]{1,2})\.\s?([0-9]{4})\b"
    month = F.coalesce(*(F.when(t.contains(name), F.lit(k)) for names in (EN_MONTHS, FI_MONTHS) for k, name in enumerate(names, 1)))
    day = F.when(month.isNotNull(), part(r"(?U)\b([0-9]{1,2})(?:st|nd|rd|th|\.)?\s+(?:of\s+)?[a-zåäö]", 1))
    return F.when(t.rlike(iso), _valid(part(iso, 1), part(iso, 2), part(iso, 3))).when(t.rlike(dotted), _valid(part(dotted, 3), part(dotted, 2), part(dotted, 1))).otherwise(_valid(part(r"(?U)\b(1[89][0-9]{2}|20[0-9]{2})\b", 1), month, day))


def iso_text(date: Column) -> Column:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(date.isNotNull(), F.concat_ws("-", date["y"].cast("string"), two(date["m"]), two(date["d"])))


def precision(date: Column) -> Column:
    return F.when(date["d"].isNotNull(), "day").when(date["m"].isNotNull(), "month").otherwise("year")


def date_forms(date: Column) -> Column:
    """Ways in which a date is commonly written, lower-cased."""
    y, m, d = (date[k].cast("string") for k in "ymd")
    en, fi = (F.element_at(F.array(*map(F.lit, names)), date["m"]) for names in (EN_MONTHS, FI_MONTHS))
    mm, dd = F.lpad(m, 2, "0"), F.lpad(d, 2, "0")
    j = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    day = F.array(j(d, ".", m, ".", y), j(d, ". ", m, ". ", y), j(y, "-", mm, "-", dd), j(d, " ", en, " ", y), j(en, " ", d, ", ", y), j(d, ". ", fi), j(d, " ", en))
    month = F.array(j(en, " ", y), j(y, "-", mm), j(m, "/", y), fi)
    return F.when(date["d"].isNotNull(), day).when(date["m"].isNotNull(), month).otherwise(F.array(y))


def has_date(hay: Column, said: Column, date: Column) -> Column:
    """Whether a text holds a date, as it was written (``said``) or in another of its forms; both lower-cased, with single spaces."""
    y = date["y"].cast("string")
    near = hay.contains(y) | F.coalesce(hay.contains(F.concat(date["d"].cast("string"), F.lit("."), date["m"].cast("string"), F.lit("."))), F.lit(False))
    by_form = F.when(date["m"].isNull(), F.regexp_like(hay, F.concat(F.lit("(?<![0-9])"), y, F.lit("(?![0-9])")))).otherwise(near & F.exists(date_forms(date), lambda f: hay.contains(f)))
    return ((F.length(said) >= 4) & hay.contains(said)) | by_form


def stems(text: Column) -> Column:
    """First five letters of the distinct content words of four letters or more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}{4,}"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(GENERIC + EN_MONTHS) & ~w.rlike("^(?:" + "|".join(FI_MONTHS) + ")"))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, 5)))


def paragraph_units(markdown: Column) -> Column:
    """Paragraphs as one line each; every row of a table by itself."""
    blocks = F.transform(F.split(markdown, r"\n\s*\n"), lambda b: F.filter(F.split(b, r"\R"), lambda x: F.trim(x) != ""))  # a block's lines are cut once, not wherever they are used
    one = F.transform(blocks, lambda lines: F.when(F.forall(lines, lambda x: F.ltrim(x).startswith("|")), lines).otherwise(F.array(F.array_join(lines, " "))))
    return F.filter(F.flatten(one), lambda u: u != "")


def beside(unit: Column, present: Column, quote: Column, words: Column, heading: Column) -> Column:
    """Whether a unit (with the stems ``present``) names the event: 60 % of a quote of three stems or more, else one shared word (two in a long unit)."""
    every = F.array_union(present, heading)
    need = F.when(F.length(unit) <= 160, 1).otherwise(F.greatest(F.least(F.lit(2), F.size(words)), F.lit(1)))
    return F.when(F.size(quote) >= 3, F.size(F.array_intersect(quote, every)) >= 0.6 * F.size(quote)).otherwise(F.size(F.array_intersect(words, every)) >= need)


#: The key of texts for dates that were written without their year.
ANY = "any"


def _figures(hay: Column) -> Column:
    """The keys under which a text with a date can be met: every four digits in a row, and days and months as d.m."""
    runs = F.regexp_extract_all(hay, F.lit(r"[0-9]{4,}"), F.lit(0))
    years = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 3), lambda i: F.substring(r, i, 4))))
    days = F.flatten(F.transform(F.regexp_extract_all(hay, F.lit(r"(?=([0-9]{1,2}\.[0-9]{1,2}\.))"), F.lit(1)), lambda x: F.array(x, F.regexp_replace(x, "^[0-9](?=[0-9])", ""))))
    return F.array_distinct(F.concat(years, days))


def with_sections(events: DataFrame, sections: DataFrame) -> DataFrame:
    """Events (set_id, place, doc_id, locator) with the section_id that the locator names in the cited document, as citations are resolved; null if none.

    ``sections`` has doc_id, section_id, locator, title and markdown.
    """
    best = best_sections(events.select("doc_id", "locator"), sections)
    return events.join(best.select("doc_id", "locator", "section_id"), ["doc_id", "locator"], "left")


def verify_events(events: DataFrame, sections: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Events with iso, precision, status and where they were found; the first of each (set_id, iso, title) stays.

    ``events`` has set_id, place, date, date_text, title, detail, quote, doc_id (the cited document, null if the number names none) and
    section_id (the cited section, null if unresolved) or, in its place, locator, which ``with_sections`` resolves; ``sections`` doc_id, section_id, title, markdown; ``members`` (set_id, doc_id)
    the documents of each set (those that its events cite, if not given). A date not beside its event in the cited section
    is looked for in the other sections of that document, in order; in all documents of the set where the event names none.

    Sections are cut into paragraphs and table rows once. Events meet those of their documents that hold the figures of their year, or of their day and
    month; a date that was written without its year meets the others of its documents too, if they hold these words.
    """
    squeezed = lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+", " "))
    events = events if "section_id" in events.columns else with_sections(events, sections)
    cited = events.where("doc_id is not null").select("set_id", F.col("doc_id").alias("at_doc"))
    members = cited.distinct() if members is None else members.select("set_id", F.col("doc_id").alias("at_doc")).union(cited).distinct()
    asked = events.withColumn("parsed", F.coalesce(parse_iso(F.col("date")), parse_date_text(F.col("date_text")))).withColumn("said", squeezed(F.col("date_text")))
    asked = asked.withColumns({"quote_stems": stems(F.col("quote")), "event_stems": stems(F.concat_ws(" ", "quote", "title", "detail"))}).alias("a")
    scoped = asked.join(members.alias("m"), (F.col("a.set_id") == F.col("m.set_id")) & (F.col("a.doc_id").isNull() | (F.col("a.doc_id") == F.col("at_doc"))), "left").select("a.*", "at_doc")
    year, day = F.col("parsed.y").cast("string"), F.concat(F.col("parsed.d").cast("string"), F.lit("."), F.col("parsed.m").cast("string"), F.lit("."))
    loose = F.when((F.length("said") >= 4) & ~F.col("said").contains(year), ANY)
    scoped = scoped.withColumn("key", F.explode_outer(F.array_compact(F.array(year, day, loose))))
    placed = sections.select(F.col("doc_id").alias("at_doc"), F.col("section_id").alias("at"), "title", "markdown")
    loose_docs = scoped.where(F.col("key") == ANY).select("at_doc").distinct()  # most sets have no such date, and no paragraph is kept for them then

    def paragraphs(of: DataFrame, keys: Callable[[Column], Column]) -> DataFrame:
        cut = of.select("at_doc", "at", stems(F.col("title")).alias("heading_stems"), F.explode(paragraph_units(F.col("markdown"))).alias("unit")).withColumn("hay", squeezed(F.col("unit")))
        return cut.withColumn("unit_stems", stems(F.col("unit"))).withColumn("key", F.explode(keys(F.col("hay"))))

    cut = paragraphs(placed, _figures).unionByName(paragraphs(placed.join(loose_docs, "at_doc", "left_semi"), lambda hay: F.array(F.lit(ANY))))
    met = scoped.join(cut, ["at_doc", "key"], "left").withColumn("dated", F.col("unit").isNotNull() & ((F.col("key") != ANY) | F.col("hay").contains(F.col("said"))) & has_date(F.col("hay"), F.col("said"), F.col("parsed")))
    met = met.withColumn("near", F.col("dated") & beside(F.col("unit"), F.col("unit_stems"), F.col("quote_stems"), F.col("event_stems"), F.col("heading_stems")))
    named = F.col("at_doc").eqNullSafe(F.col("doc_id")) & (F.col("at") == F.col("section_id"))
    found = met.groupBy("set_id", "place").agg(
        *(F.any_value(c).alias(c) for c in ("parsed", "date", "title", "doc_id", "section_id")), F.coalesce(F.bool_or(named & F.col("near")), F.lit(False)).alias("there"), F.bool_or(named & F.col("dated")).alias("on_page"),
        F.min(F.when(F.col("near"), F.struct("at_doc", "at"))).alias("moved"),
    )
    status = (
        F.when(F.col("parsed").isNull(), "invalid_date").when(F.col("there") | F.col("moved").isNotNull(), "verified").when(F.col("section_id").isNull(), "citation_unresolved")
        .when(F.col("on_page"), "date_elsewhere").otherwise("date_not_in_source")
    )
    out = found.select(
        "set_id", "place", F.coalesce(iso_text(F.col("parsed")), F.trim("date")).alias("iso"), F.coalesce(precision(F.col("parsed")), F.lit("year")).alias("precision"), "title",
        F.when(F.col("there"), F.col("doc_id")).otherwise(F.coalesce("moved.at_doc", "doc_id")).alias("doc_id"), F.when(F.col("there"), F.col("section_id")).otherwise(F.coalesce("moved.at", "section_id")).alias("section_id"), status.alias("status"),
    )
    first = Window.partitionBy("set_id", "iso", F.lower(F.trim("title"))).orderBy("place")
    return out.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def status_counts(checked: DataFrame) -> DataFrame:
    """(status, n) of checked events, and their total."""
    return checked.rollup("status").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("status", F.lit("total")).alias("status"), "n")


def year_groups(checked: DataFrame, only_verified: bool = False, doc_id: object = None) -> DataFrame:
    """Checked events in order with the group of the same year they stand in: consecutive ones, counted from 1 within a set; invalid dates
    are Undated. Events can be limited to the verified ones and to those of a document."""
    shown = checked.where("status = 'verified'") if only_verified else checked
    shown = shown if doc_id is None else shown.where(F.col("doc_id") == doc_id)
    shown = shown.withColumn("year", F.when(F.col("status") == "invalid_date", "Undated").otherwise(F.substring("iso", 1, 4)))
    order = Window.partitionBy("set_id").orderBy(*timeline_order(), "place")
    return shown.withColumn("new", (~F.lag("year").over(order).eqNullSafe(F.col("year"))).cast("int")).withColumn("group", F.sum("new").over(order)).drop("new")


# What a status is called in an exported table.
SHOWN = {"verified": "verified", "date_elsewhere": "date elsewhere in the passage", "date_not_in_source": "date not in the passage", "citation_unresolved": "location not found", "invalid_date": "not a date"}


def export_rows(checked: DataFrame) -> DataFrame:
    """(set_id, date, event, location, check, note): rows for a sheet, with how many of the set's dates were verified."""
    every = Window.partitionBy("set_id")
    note = F.format_string("%d of %d dates verified in the cited passage.", F.count_if(F.col("status") == "verified").over(every), F.count(F.lit(1)).over(every))
    label = F.element_at(F.create_map(*(F.lit(x) for kv in SHOWN.items() for x in kv)), F.col("status"))
    return checked.select("set_id", F.col("iso").alias("date"), F.col("title").alias("event"), F.coalesce(F.col("section_id").cast("string"), F.lit("")).alias("location"), label.alias("check"), note.alias("note"))


def timeline_order() -> list[Column]:
    """Invalid dates last; a year before its months, a month before its days."""
    return [F.col("status") == "invalid_date", F.rpad("iso", 10, "-")]
