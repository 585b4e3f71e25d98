"""Passages and BM25 ranking: all queries of a batch meet the passages in one join on terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import shared_path

K1, B = 1.5, 0.75
#: Distinct query terms, and rows of (query, term), that may be broadcast; beyond these Spark picks the join.
BROADCAST_ROWS = 200_000
#: Pairs of a query and a passage, and tokens, that one part holds at most about.
SCORES, TOKENS = 250_000, 1_000_000

# Words too common to rank by, English and Finnish.
STOP_WORDS = (
    "the a an and or of to in is are was were be been for on with as by at from that this these those it its what which who how why when where "
    "do does did can could would should please give tell me my you your i we they "
    "ja tai on ovat oli olivat ei se ne että kun jos mikä mitkä mitä missä mistä mihin milloin kuka ketkä kenen kuinka paljonko montako miten miksi "
    "minkä mikäli kaikki kaikkien myös sekä kerro luettele anna minulle onko oliko voi tämä nämä"
).split()
# Function words that tell English and Finnish texts apart.
MARKERS = {"en": "the and of to is was in for with that are by".split(), "fi": "ja on oli ovat ei että sekä mukaan vuonna joka jonka myös kanssa tai".split()}


_WORD, _CJK = r"[\p{L}\p{N}]+", r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
#: All signs of _CJK are among these; a plain range is looked through much faster than scripts.
_HIGH = r"[\x{1100}-\x{10FFFF}]"
#: Finnish words of this length or more are also indexed by their first letters, since endings and compounds change the rest.
LONG_WORD, PREFIX = 8, 6


def tokens(text: Column, language: Column | None = None) -> Column:
    """Lower-cased runs of letters and digits of two characters or more, but for stop words; CJK characters one by one.

    Where ``language`` is fi, a long word is followed by ~ and its first letters.
    """
    low = F.lower(text)
    plain = F.filter(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))
    by_sign = F.regexp_extract_all(low, F.lit(_CJK + r"|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]+"), F.lit(0))
    found = F.when(low.rlike(_HIGH) & low.rlike(_CJK), F.filter(by_sign, lambda w: ((F.length(w) > 1) | w.rlike(_CJK)) & ~w.isin(STOP_WORDS))).otherwise(plain)  # most texts have no such sign
    if language is None:
        return found
    longer = F.flatten(F.transform(found, lambda w: F.when(F.length(w) >= LONG_WORD, F.array(w, F.concat(F.lit("~"), F.substring(w, 1, PREFIX)))).otherwise(F.array(w))))
    return F.when(language == "fi", longer).otherwise(found)


def query_terms(text: Column) -> Column:
    """A question's distinct terms in either language, in order; none means that there is nothing to search for."""
    return F.array_distinct(F.concat(tokens(text), tokens(text, F.lit("fi"))))


def indexed_text(title: Column, text: Column) -> Column:
    """What of a passage is searched: its section's title, if there is one, and its text."""
    return F.concat_ws("\n", F.nullif(title, F.lit("")), text)


def among(words: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(words)


def language(text: Column, most: int = 20_000) -> Column:
    """en, fi or null: the language with more function words among the first characters, three at least; ties are English."""
    found = F.regexp_extract_all(F.substring(F.lower(text), 1, most), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    n = {k: F.size(F.filter(found, among(m))) for k, m in MARKERS.items()}
    return F.when((n["en"] >= 3) & (n["en"] >= n["fi"]), "en").when((n["fi"] >= 3) & (n["fi"] > n["en"]), "fi")


def blocks(markdown: Column) -> Column:
    """Runs of lines between blank lines."""
    parts = F.split(F.regexp_replace(markdown, r"\R", "\n"), r"\n(?:[ \t]*\n)+")
    return F.filter(F.transform(parts, lambda b: F.regexp_replace(b, r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")), lambda b: F.trim(b) != "")


def passages(sections: DataFrame, target_words: int = 180, overlap: int = 1) -> DataFrame:
    """(doc_id, section_id, locator, order, text, and title, if sections have one): blocks of a section packed up to ``target_words``.

    A block over the target stands alone; each passage but a section's first begins with the last ``overlap`` blocks of the one before,
    unless these reach the target. Sections need doc_id, section_id, locator and markdown; order counts within a document.
    """
    n_words = lambda b: F.size(F.filter(F.split(b, r"(?U)\s+"), lambda w: w != ""))
    none, cut = F.array().cast("array<int>"), "array<struct<begin:int,end:int>>"
    state = F.struct(F.array().cast(cut).alias("done"), F.lit(0).alias("begin"), F.lit(0).alias("n"), none.alias("last"))

    def step(s: Column, x: Column) -> Column:
        """Places of the blocks alone are carried along, with the sizes of the last ``overlap`` in the open passage."""
        full = (x["i"] > s["begin"]) & (s["n"] + x["size"] > target_words)
        kept = F.aggregate(s["last"], F.lit(0), lambda a, n: a + n)
        fits = kept < target_words
        begin = F.when(~full, s["begin"]).when(fits, x["i"] - F.size(s["last"])).otherwise(x["i"])
        before = F.when(full & ~fits, none).otherwise(s["last"])
        last = F.concat(before, F.array(x["size"]))
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.struct(s["begin"].alias("begin"), x["i"].alias("end"))))).otherwise(s["done"]).alias("done"), begin.alias("begin"),
            (F.when(~full, s["n"]).when(fits, kept).otherwise(0) + x["size"]).alias("n"), F.when(F.size(last) > overlap, F.slice(last, F.size(last) - overlap + 1, overlap)).otherwise(last).alias("last"),
        )

    kept = ["doc_id", "section_id", "locator", *(["title"] if "title" in sections.columns else [])]
    sized = sections.select(*kept, blocks(F.col("markdown")).alias("parts"))
    sizes = F.transform("parts", lambda b, i: F.struct(i.alias("i"), n_words(b).alias("size")))
    rest = lambda s: F.when(F.size("parts") > 0, F.concat(s["done"], F.array(F.struct(s["begin"].alias("begin"), F.size("parts").alias("end"))))).otherwise(s["done"])
    packed = sized.withColumn("cuts", F.aggregate(sizes, state, step, rest))
    texts = F.transform("cuts", lambda c: F.trim(F.array_join(F.slice("parts", c["begin"] + 1, c["end"] - c["begin"]), "\n\n")))
    out = packed.select(*kept, F.posexplode(texts).alias("place", "text"))
    return out.withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("section_id", "place")) - 1).drop("place")


def inverse_frequency(n: Column, df: Column) -> Column:
    """A term's weight: it stands in ``df`` of ``n`` passages."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_part(weight: Column, tf: Column, length: Column, average: float) -> Column:
    """What a term of that weight adds to a passage's score; more for higher ``tf`` and for shorter passages."""
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


def term_counts(chunks: DataFrame) -> DataFrame:
    """(doc_id, order, length, terms array<struct<term, tf>>): a passage's distinct tokens with their counts, made within its row, so nothing is shuffled."""
    length = F.greatest(F.size("tokens"), F.lit(1)).cast("int").alias("length")
    listed = chunks.select("doc_id", "order", length, F.sort_array(F.coalesce("tokens", F.array().cast("array<string>"))).alias("listed"))
    ends = listed.withColumn("ends", F.array_compact(F.transform("listed", lambda w, i: F.when(~w.eqNullSafe(F.get("listed", i + 1)), i))))
    terms = F.transform("ends", lambda e, i: F.struct(F.get("listed", e).alias("term"), (e - F.coalesce(F.get("ends", i - 1), F.lit(-1))).cast("int").alias("tf")))
    return ends.select("doc_id", "order", "length", terms.alias("terms"))


def parts_for(rows: float, of: int) -> int:
    """Into how many parts rows are dealt, ``of`` in each."""
    return int(min(max(-(-rows // of), 1), 10_000))


def bm25(queries: DataFrame, chunks: DataFrame, top_k: int = 8) -> DataFrame:
    """(query_id, rank, doc_id, order, score): the ``top_k`` best passages with a positive score; ties keep the passages' order.

    ``queries`` has query_id and terms (array<string>; a term given twice counts twice), ``chunks`` doc_id, order and tokens. Tokens are
    made once: their counts by passage are written to the shared folder, a row for each passage. A passage's row moves once for the counts of terms and once
    for its scores, which are summed and ranked where it lies: only each part's ``top_k`` move on.
    For repeated searches ``inverted.PassageIndex`` reads no tokens at all.
    """
    spark = chunks.sparkSession
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    small = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    path = shared_path(spark, "postings")
    term_counts(chunks).write.parquet(path)
    counted = spark.read.parquet(path)
    n, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(parts_for(n * queries.count(), SCORES), parts_for(total, TOKENS))
    each = counted.repartition(parts, "doc_id", "order").select("doc_id", "order", "length", F.inline("terms"))
    each = each.join(hint(asked.select("term").distinct()), "term", "left_semi")
    postings = each.groupBy("doc_id", "order", "length", "term").agg(F.sum("tf").alias("tf"))  # repeated passages
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(df, "term").withColumn("idf", F.col("times") * inverse_frequency(F.lit(n), F.col("df")))
    part = bm25_part(F.col("idf"), F.col("tf"), F.col("length"), total / n if n else 1.0)
    scored = postings.join(hint(weighted), "term").groupBy("query_id", "doc_id", "order").agg(F.round(F.sum(part), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "order")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("query_id", "rank", "doc_id", "order", "score")


def with_neighbours(hits: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """(query_id, rank, doc_id, order, text): hits and the passages within ``reach`` of one in its document, which rank after all hits."""
    spread = hits.select("query_id", "doc_id", F.explode(F.sequence(F.col("order") - reach, F.col("order") + reach)).alias("order")).distinct()
    found = spread.join(chunks.select("doc_id", "order", "text"), ["doc_id", "order"])
    return found.join(hits.select("query_id", "doc_id", "order", "rank"), ["query_id", "doc_id", "order"], "left").withColumn("rank", F.coalesce("rank", F.lit(2**31 - 1)))


def fill_budget(candidates: DataFrame, most: int = 12_000) -> DataFrame:
    """(query_id, passages array<struct<doc_id, order>>, used): passages by rank as long as each still fits into ``most`` characters; one
    that doesn't is passed over, and the best stands if none fits. Candidates of a query are bounded by top-k and neighbours."""
    listed = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "order", F.length("text").alias("size")))).alias("c"))
    start = F.struct(F.array().cast("array<struct<doc_id:bigint,order:int>>").alias("kept"), F.lit(0).alias("used"))

    def step(s: Column, c: Column) -> Column:
        own = F.array(F.struct(c["doc_id"].cast("bigint").alias("doc_id"), c["order"].cast("int").alias("order")))
        fits = s["used"] + c["size"] <= most
        return F.struct(F.when(fits, F.concat(s["kept"], own)).otherwise(s["kept"]).alias("kept"), (s["used"] + F.when(fits, c["size"]).otherwise(0)).alias("used"))

    filled = F.aggregate("c", start, step)
    best = F.element_at("c", 1)
    alone = F.struct(F.array(F.struct(best["doc_id"].cast("bigint").alias("doc_id"), best["order"].cast("int").alias("order"))).alias("kept"), best["size"].alias("used"))
    chosen = F.when(F.size(filled["kept"]) > 0, filled).otherwise(alone)
    return listed.select("query_id", F.array_sort(chosen["kept"]).alias("passages"), chosen["used"].alias("used"))
