"""Registered queries of passages, terms, written numbers and dates, answers' units and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import texts as X
from tessera.operators import privacy, retrieval, timeline
from tessera.plans.query_plan import chart_series, profile_values
from tessera.registry import query, table
from tessera.sources.sinks import safe_cells
from tessera.sources.tables import typed

_STOPS = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: len(w) > 1 and w not in ({_STOPS}))"


@query(
    f"with t as (select item_id, {_TOKENS} as t from benchmark), f as (select item_id, t, flatten(list_transform(t, lambda w: case when len(w) >= 8 then [w, '~' || substr(w, 1, 6)] else [w] end)) as f from t) "
    "select item_id, list_sort(list_distinct(list_concat(t, f))) as terms from f"
)
def question_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.sort_array(retrieval.query_terms(F.col("text"))).alias("terms"))


@query(f"with d as (select doc_id, coalesce(source, '') as source, case when coalesce(source, '') <> '' then source || chr(10) || text else text end as text from documents where text is not null) select doc_id, len({_TOKENS})::bigint as n from d")
def tokens_with_titles(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(retrieval.tokens(retrieval.indexed_text(F.coalesce("source", F.lit("")), F.col("text")))).cast("bigint").alias("n"))


@query(f"select doc_id, len({_TOKENS})::bigint + case when lang = 'fi' then len(list_filter({_TOKENS}, lambda w: len(w) >= 8)) else 0 end::bigint as n from documents where text is not null")
def tokens_by_language(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(retrieval.tokens(F.col("text"), F.col("lang"))).cast("bigint").alias("n"))


def _lines_as_blocks(spark, d) -> DataFrame:
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    return table(spark, d, "documents").select("doc_id", F.lit(1).alias("section_id"), F.lit("Text").alias("locator"), text.alias("markdown"))


@query(
    "with l as (select doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r|\\v|\\f|\\x{85}|\\x{2028}|\\x{2029}')) as line, generate_subscripts(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r|\\v|\\f|\\x{85}|\\x{2028}|\\x{2029}'), 1) as n from documents) "
    "select doc_id, (row_number() over (partition by doc_id order by n) - 1)::int as \"order\", length(trim(line)) as n_chars from l where trim(line) <> ''"
)
def passages_of_single_lines(spark, d):
    """Passages with room for one block each and no overlap are the blocks."""
    return retrieval.passages(_lines_as_blocks(spark, d), 1, 0).select("doc_id", "order", F.length("text").cast("bigint").alias("n_chars"))


def _hits(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as hits of customers on one of their line items, which are the passages."""
    key = F.col("o_orderkey")
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), key.alias("doc_id"), (key % 7 + 1).cast("int").alias("order"), (key % 1000).cast("int").alias("rank"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("order"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"))
    return hits.groupBy("query_id", "doc_id", "order").agg(F.min("rank").alias("rank")), items.groupBy("doc_id", "order").agg(F.max("text").alias("text"))


_HITS = (
    "with h as (select o_custkey as q, o_orderkey as d, (o_orderkey % 7 + 1)::int as o, min(o_orderkey % 1000)::int as rank from orders group by 1, 2, 3), c as (select l_orderkey as d, l_linenumber::int as o, max(l_quantity::int) as size from lineitem group by 1, 2), "
    "n as (select distinct q, h.d, c.o, c.size from h join c on h.d = c.d and abs(h.o - c.o) <= 1), r as (select n.*, coalesce(h.rank, 2147483647) as rank from n left join h using (q, d, o)) "
)


@query(_HITS + "select q as query_id, d as doc_id, o as \"order\", rank::int as rank, size::bigint as size from r")
def neighbours_of_hits(spark, d):
    hits, chunks = _hits(spark, d)
    return retrieval.with_neighbours(hits, chunks).select("query_id", "doc_id", "order", "rank", F.length("text").cast("bigint").alias("size"))


@query(_HITS + ", l as (select q, list(size order by rank, d, o) as sizes from r group by 1) select q as query_id, list_reduce(sizes, lambda a, x: case when a + x <= 60 then a + x else a end, 0)::int as used from l")
def budgets_filled(spark, d):
    hits, chunks = _hits(spark, d)
    return retrieval.fill_budget(retrieval.with_neighbours(hits, chunks), 60).select("query_id", "used")


# --- numbers and dates ---------------------------------------------------------------------------------------------------------------


@query(
    "with c as (select c_custkey, c_custkey % 4 as k, 1 + c_custkey % 9 as a, lpad((c_custkey % 1000)::varchar, 3, '0') as b from customer) "
    "select c_custkey, case k when 0 then [(a || '.' || b)::double, (a || b)::double] when 1 then [(a || b)::double] when 2 then [(a || '.' || b[1:2])::double] else [(a || b || '.5')::double] end as readings from c"
)
def numbers_as_readings(spark, d):
    k, a, b = F.col("c_custkey") % 4, (1 + F.col("c_custkey") % 9).cast("string"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")
    token = F.when(k == 0, F.concat(a, F.lit(","), b)).when(k == 1, F.concat(a, F.lit(" "), b)).when(k == 2, F.concat(a, F.lit(","), F.substring(b, 1, 2))).otherwise(F.concat(a, F.lit("."), b, F.lit(",5")))
    return table(spark, d, "customer").select("c_custkey", N.readings(token).alias("readings"))


@query(
    "with o as (select o_orderkey, o_orderkey % 3 as k, day(o_orderdate)::varchar as d, month(o_orderdate)::varchar as m, year(o_orderdate)::varchar as y, lower(monthname(o_orderdate)) as en from orders) select o_orderkey, case k when 0 then y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') when 1 then y || '-' || lpad(m, 2, '0') else y end as iso, "
    "case k when 0 then 'day' when 1 then 'month' else 'year' end as \"precision\", case k when 0 then d || '.' || m || '.' || y when 1 then en || ' ' || y else y end as first_form from o"
)
def dates_by_precision(spark, d):
    date = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(date, "yyyy-M-d")).when(F.col("o_orderkey") % 3 == 1, F.date_format(date, "yyyy-MM")).otherwise(F.date_format(date, " yyyy "))
    p = F.col("p")
    return table(spark, d, "orders").select("o_orderkey", timeline.parse_iso(text).alias("p")).select("o_orderkey", timeline.iso_text(p).alias("iso"), timeline.precision(p).alias("precision"), F.get(timeline.date_forms(p), F.lit(0)).alias("first_form"))


_GENERIC = ", ".join(f"'{w}'" for w in timeline.GENERIC + timeline.EN_MONTHS)
_FI = "|".join(timeline.FI_MONTHS)


@query(f"select item_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}'), lambda w: w not in ({_GENERIC}) and not regexp_matches(w, '^({_FI})')), lambda w: substr(w, 1, 5)))) as stems from benchmark")
def stems_of_items(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.sort_array(timeline.stems(F.col("text"))).alias("stems"))


@query("with t as (select p_partkey, n from part, (values ('2026-02-30'), ('2026-13'), ('soon')) v(n)) select p_partkey, count(*)::bigint as bad from t group by 1")
def dates_refused(spark, d):
    bad = F.filter(F.array(*(F.concat(F.lit(x), F.lit("")) for x in ("2026-02-30", "2026-13", "soon"))), lambda x: timeline.parse_iso(x).isNull())
    return table(spark, d, "part").select("p_partkey", F.size(bad).cast("bigint").alias("bad"))


# --- tables --------------------------------------------------------------------------------------------------------------------------


@query("select p_partkey::varchar as key, case when p_size % 50 = 0 then 'n/a' else replace((p_size + 0.5)::varchar, ',', '.') end as mixed, p_size + 0.25 as number from part")
def cells_typed(spark, d):
    comma = lambda x: F.replace(x.cast("string"), F.lit("."), F.lit(","))
    raw = table(spark, d, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_size") % 50 == 0, "n/a").otherwise(comma(F.col("p_size") + 0.5)).alias("mixed"), comma(F.col("p_size") + 0.25).alias("number"))
    return typed(raw, ";").withColumn("key", F.substring("key", 2, 20))


@query("with p as (select 'c_mktsegment' as \"column\", c_mktsegment as v, min(c_custkey) as first from customer where c_mktsegment is not null group by 2) select \"column\", list(v order by first, v) as values from p group by 1 having count(*) <= 12")
def distinct_values(spark, d):
    return profile_values(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name"), ["c_custkey"]).where("column = 'c_mktsegment'")


@query("select c_mktsegment as x, avg(c_acctbal) as y from customer group by 1")
def chart_points(spark, d):
    return chart_series(table(spark, d, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("balance")), "mkt segment", "balance")[0]


@query("select o_orderkey::varchar as o_orderkey, coalesce(o_orderstatus, '') as o_orderstatus, case when o_orderkey % 4 = 0 then '' else o_orderpriority end as o_orderpriority from orders")
def rows_for_export(spark, d):
    priority = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    return safe_cells(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", priority.alias("o_orderpriority")))


# --- answers and redaction -----------------------------------------------------------------------------------------------------------


def _answer(spark, d) -> DataFrame:
    n = F.col("n_name")
    text = F.concat(F.lit("# Title\n"), n, F.lit(" is a nation of some size. It has ports! [S1: Page 2]\n- One of the many lands in "), n, F.lit("\n| a | "), n, F.lit(" |\n|---|---|\n\nEnd."))
    return table(spark, d, "nation").select("n_nationkey", text.alias("answer"))


@query("select n_nationkey, [n_name || ' is a nation of some size.', 'It has ports! [S1: Page 2]', 'One of the many lands in ' || n_name, 'a | ' || n_name, 'End.'] as units from nation")
def answer_units(spark, d):
    return _answer(spark, d).select("n_nationkey", X.units(F.col("answer")).alias("units"))


@query("select n_nationkey, [n_name || ' is a nation of some size.', 'One of the many lands in ' || n_name] as statements, [false, false] as cited from nation")
def statements_covered(spark, d):
    covered = _answer(spark, d).select("n_nationkey", X.citation_coverage(F.col("answer")).alias("c"))
    return covered.select("n_nationkey", F.transform("c", lambda x: x["text"]).alias("statements"), F.transform("c", lambda x: x["cited"]).alias("cited"))


@query(
    "with c as (select c_custkey, c_custkey % 4 as k, 'The customer ' || c_name || ' pays bills in time' as a, 'Its balance is ' || c_custkey || ' in our books' as b from customer) "
    "select c_custkey, [a || case when k = 1 then ' [S1: Page ' || c_custkey || '].' else '.' end, b || case when k = 2 then ' [S2: Row 5]' else '' end || '.'] as statements, [k = 1, k in (2, 3)] as cited from c"
)
def statements_cited(spark, d):
    """Statements with a citation of their own, with one that stands alone in the next line, and without any."""
    k, key, n = F.col("c_custkey") % 4, F.col("c_custkey").cast("string"), F.col("c_name")
    first = F.concat(F.lit("# Customer\n\n- The customer "), n, F.lit(" pays bills in time"), F.when(k == 1, F.concat(F.lit(" [S1: Page "), key, F.lit("]"))).otherwise(""), F.lit("."))
    second = F.concat(F.lit("\nIts balance is "), key, F.lit(" in our books"), F.when(k == 2, " [S2: Row 5]").otherwise(""), F.lit("."), F.when(k == 3, "\n[S1: Page 1], [S3: Sheet].").otherwise(""), F.lit("\nSo much for this:\n\nToo short."))
    covered = table(spark, d, "customer").select("c_custkey", X.citation_coverage(F.concat(first, second)).alias("c"))
    return covered.select("c_custkey", F.transform("c", lambda x: x["text"]).alias("statements"), F.transform("c", lambda x: x["cited"]).alias("cited"))


@query("select n_nationkey, 'One of the many lands in ' || n_name || chr(10) || 'a | ' || n_name || ' |' as listed from nation")
def answer_lists(spark, d):
    return _answer(spark, d).select("n_nationkey", F.regexp_replace(X.listed_text(F.col("answer")), "(?m)^ ", "").alias("listed"))


@query("select doc_id, contains(lower(text), 'harmonic mean of precision and recall') or contains(lower(text), '<your sentence') or contains(lower(text), '[s<id>') as leaks from documents where text is not null")
def prompt_leaks(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.leaks_prompt(F.col("text")).alias("leaks"))


@query("select c_custkey as doc_id, '[PERSON-1] met [PERSON-1], not X' || c_name || '; see [ID-1] and [EMAIL-1].' as text from customer")
def names_redacted(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("n"), F.concat(F.lit("S-"), F.col("c_custkey").cast("string")).alias("s"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.fi")).alias("e"))
    docs = c.select("doc_id", F.concat("n", F.lit(" met "), F.upper("n"), F.lit(", not X"), "n", F.lit("; see "), "s", F.lit(" and "), "e", F.lit(".")).alias("text"))
    items = F.array(*(F.struct(F.lit(k).alias("place"), F.col(x).alias("text"), F.lit(kind).alias("category"), F.lit("").alias("replacement")) for k, (x, kind) in enumerate({"n": "person", "s": "id_number", "e": "email"}.items())))
    return privacy.redact(docs, c.select("doc_id", F.explode(items).alias("i")).select("doc_id", "i.*")).select("doc_id", "text")


_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


@query(
    f"with m as (select doc_id, text, regexp_extract(text, '{_MAIL}') as mail from documents where regexp_matches(text, '{_MAIL}')), p as (select *, instr(text, mail) - 1 as start from m) "
    "select doc_id, lower(mail) as mail, (case when start > 40 then '…' else '' end) || replace(substr(text, greatest(start - 40, 0)::int + 1, (least(start + length(mail) + 40, length(text)) - greatest(start - 40, 0))::int), chr(10), ' ') || (case when start + length(mail) + 40 < length(text) then '…' else '' end) as context from p"
)
def first_mail_in_context(spark, d):
    docs = table(spark, d, "documents")
    found = privacy.scan(docs).where("category = 'email'").select("doc_id", "text", "context")
    first = docs.where(F.col("text").rlike(_MAIL)).select("doc_id", F.regexp_extract("text", _MAIL, 0).alias("m"))
    return found.join(first, "doc_id").where(F.lower("text") == F.lower("m")).select("doc_id", F.lower("text").alias("mail"), "context")
