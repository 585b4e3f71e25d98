"""Registered queries of the document library, contexts, text functions, Markdown, proposals of personal data and readers' rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import texts as X
from tessera.operators import context, library, markdown, privacy
from tessera.registry import query, table
from tessera.sources.sections import is_loopback, markdown_headings, pasted

# --- library: documents as a library -------------------------------------------------------------------------------------------------


def _library(spark, d) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.col("doc_id").cast("string")).alias("name"), F.lit("txt").alias("kind"), F.when(F.col("doc_id") % 10 == 3, "failed").otherwise("ready").alias("status"),
        F.coalesce("text", F.lit("")).alias("markdown"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("character_count"), (F.col("doc_id") % 1000).cast("long").alias("token_count"), F.timestamp_seconds(F.col("doc_id") * 7919 % 100000).alias("imported_at"),
    )


_L = (
    "with l as (select doc_id::varchar as doc_id, coalesce(source, 'none') || '-' || doc_id as name, case when doc_id % 10 = 3 then 'failed' else 'ready' end as status, coalesce(text, '') as markdown, length(coalesce(text, ''))::bigint as character_count, "
    "(doc_id % 1000)::bigint as token_count, doc_id * 7919 % 100000 as imported, doc_id as k from documents) "
)


@query(_L + "select doc_id, status, character_count, token_count from l union all select 'p' || page_id, 'ready', length(url), null from pages where trim(url) <> ''")
def library_with_pasted_texts(spark, d):
    texts = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_id"), F.lit(None).cast("string").alias("name"), F.col("url").alias("markdown"), F.current_timestamp().alias("imported_at"))
    return library.added(_library(spark, d), texts).select("doc_id", "status", "character_count", "token_count")


@query(
    _L + "select doc_id, md5(case when k % 4 = 0 then substr(markdown, 1, k % 100) || '.' else markdown end) as digest, case when k % 4 = 0 then length(substr(markdown, 1, k % 100)) + 1 else character_count end::bigint as character_count, "
    "case when k % 4 <> 0 then token_count end as token_count from l"
)
def library_updated(spark, d):
    base = _library(spark, d)
    k = F.col("doc_id").cast("int")
    edits = base.where(k % 4 == 0).select("doc_id", F.concat(F.substring(F.col("markdown"), F.lit(1), k % 100), F.lit(".")).alias("markdown"))
    return library.updated(base, edits).select("doc_id", F.md5("markdown").alias("digest"), "character_count", "token_count")


@query(_L + "select doc_id, case when k % 3 = 0 then k + 5 else token_count end as token_count from l")
def library_token_counts(spark, d):
    base = _library(spark, d)
    counts = base.where(F.col("doc_id").cast("long") % 3 == 0).select("doc_id", (F.col("doc_id").cast("long") + 5).alias("token_count"))
    return library.with_token_counts(base, counts).select("doc_id", "token_count")


@query(_L + "select count(*) as left_over, sum(character_count)::bigint as characters from l where k not in (select doc_id from labels where toxic = 1)")
def library_deleted(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    return library.deleted(_library(spark, d), gone).agg(F.count(F.lit(1)).alias("left_over"), F.sum("character_count").alias("characters"))


@query(_L + "select doc_id, row_number() over (order by imported, doc_id) as place from l")
def library_listed(spark, d):
    """Places in the list, found without one task for all: by day of import first."""
    base = _library(spark, d).withColumn("day", F.floor(F.unix_timestamp("imported_at") / 3600))
    before = base.groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("day").orderBy(*library.oldest_first()))
    return base.join(before.select("day", "before"), "day").select("doc_id", (F.col("before") + place).alias("place"))


@query("with w as (select conv_id, turn, unnest([turn, conv_id, -1]) as wanted, unnest([0, 1, 2]) as place from conversations) select conv_id * 1000 + turn as set_id, w.place, wanted::varchar as doc_id, l.doc_id is not null as found, length(coalesce(l.text, '')) as n from w left join documents l on l.doc_id = w.wanted")
def library_by_ids(spark, d):
    wanted = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("set_id"), F.transform(F.array("turn", "conv_id", F.lit(-1)), lambda x: x.cast("string")).alias("doc_ids"))
    return library.by_ids(_library(spark, d), wanted).select("set_id", "place", "doc_id", "found", F.coalesce("character_count", F.lit(0)).alias("n"))


@query(_L + "select status, count(*) as n from l where status = 'ready' group by 1")
def library_ready(spark, d):
    return library.ready(_library(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- context: benchmark passages chosen for questions --------------------------------------------------------------------------------


def _chosen(spark, d) -> tuple[DataFrame, DataFrame]:
    """Line items as passages of their part's document, chosen for the order's question."""
    item = table(spark, d, "lineitem")
    passages = item.select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("doc_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_quantity").cast("int") * 10_000 + F.col("l_partkey") % 10_000).alias("order"), F.concat(F.lit("Part "), (F.col("l_quantity") % 3).cast("int").cast("string")).alias("locator"), F.col("l_linestatus").alias("text"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_suppkey").alias("index"), F.concat(F.col("s_name"), F.lit('"x"')).alias("name"))
    return passages, suppliers


_CHOSEN = "with p as (select l_orderkey as q, l_suppkey as s, l_linenumber * 1000000 + l_quantity::int * 10000 + l_partkey % 10000 as o, 'Part ' || (l_quantity % 3)::int as loc, l_linestatus as text from lineitem), "


@query(
    _CHOSEN + "m as (select *, lag(loc) over (partition by q, s order by o) as before from p), d as (select q, s, string_agg(case when before = loc then text else '## ' || loc || chr(10) || chr(10) || text end, chr(10) || chr(10) order by o) as body from m group by 1, 2) "
    "select q as query_id, md5(string_agg('<source id=\"' || s || '\" name=\"' || s_name || '''x''\">' || chr(10) || body || chr(10) || '</source>', chr(10) || chr(10) order by s)) as digest from d join supplier on s_suppkey = s group by 1"
)
def context_blocks(spark, d):
    return context.source_blocks(*_chosen(spark, d)).select("query_id", F.md5("context").alias("digest"))


@query(
    "with n as (select l_suppkey as s, l_orderkey * 10 + l_linenumber as id, 'R' || l_orderkey as loc, row_number() over (partition by l_suppkey order by l_orderkey * 10 + l_linenumber) as n from lineitem) "
    "select s as doc_id, s as index, 'Source ' || s || ' (\"' || any_value(s_name) || '\") covers ' || string_agg(loc, ', ' order by id) filter (n <= 40) || case when count(*) > 40 then ' (+' || (count(*) - 40) || ' more)' else '' end as line from n join supplier on s_suppkey = s group by s"
)
def context_outline(spark, d):
    sections = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("section_id"), F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("locator"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_suppkey").alias("index"), F.col("s_name").alias("name"))
    return context.outline(sections, suppliers)


@query("select p_partkey as doc_id, p_partkey || '. ' || p_name || ' - ' || (case when p_size % 2 = 0 then 'csv' else 'pdf' end) || ', ' || p_size || ' section(s)' || case when p_size % 2 <> 0 then '' when p_size % 4 = 0 then ', tabular data (' || p_brand || ', ' || p_type || ')' else ', tabular data' end as line from part")
def document_lines(spark, d):
    k = F.col("p_size")
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_partkey").alias("index"), F.col("p_name").alias("name"), F.when(k % 2 == 0, "csv").otherwise("pdf").alias("kind"), k.alias("sections"), F.when(k % 4 == 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")).alias("columns"))
    return context.document_lines(docs)


@query(
    "with s as (select doc_id, length(coalesce(text, ''))::bigint as n, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::bigint as w from documents), t as (select *, w > 900 as r, case when w / 3 <= 900 then 0 when w / 5 <= 900 then 1 when w / 8 <= 900 then 2 else 3 end as attempt from s) "
    "select doc_id, case when r then 'retrieval' else 'full' end as strategy, case when r then [12000, 7200, 4320, 2591][attempt + 1] end as budget, not r or w / 8 <= 900 or w / 13 <= 900 as fits from t"
)
def context_strategies(spark, d):
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t-\r]+"), F.lit(0))).cast("long")
    s = table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("characters"), words.alias("full_tokens"), F.lit(12000).alias("max_characters"))
    s = s.withColumn("allowed", context.allowed_tokens(F.lit(4096), F.lit(2048), F.lit(1148))).withColumn("tokens_at", F.array(*(F.col("full_tokens") / n for n in (3, 5, 8, 13))))
    return context.auto_strategy(s).select("doc_id", "strategy", "budget", "fits")


@query(
    "with c as (select o_custkey, sum(o_totalprice::bigint) filter (o_orderkey % 2 = 0) as f, sum(o_totalprice::bigint) filter (o_orderkey % 2 = 1) as r from orders group by 1), z as (select o_custkey, coalesce(f, 0)::bigint as f, coalesce(r, 0)::bigint as r from c) "
    "select o_custkey, f as \"full\", r as retrieval, f - r as saved, case when f = 0 then 0 else round_even(100 * (f - r) / f, 0)::int end as percent, case when f > r then 'retrieval' else 'full' end as recommended from z"
)
def context_costs(spark, d):
    cost = table(spark, d, "orders").groupBy("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "full").otherwise("retrieval").alias("strategy")).agg(F.sum(F.bround("o_totalprice", 0).cast("long")).alias("tokens"))
    return context.compared(cost, "o_custkey")


@query("select event_id, least(100, floor(100 * event_id / 4096 + 0.5)::int) as percent, case when event_id > 0 and value > 0 then floor(event_id / value + 0.5)::int end as seconds from events")
def context_usage(spark, d):
    return table(spark, d, "events").select("event_id", context.usage(F.col("event_id"), F.lit(4096), F.col("value")).alias("u")).select("event_id", "u.percent", "u.seconds")


@query(
    "with m as (select conv_id, turn, turn % 5 = 4 as bad, case when turn % 3 = 2 then [2, 1] else [1, 2] end as docs from conversations where coalesce(text, '') <> ''), n as (select *, row_number() over (partition by conv_id order by turn desc) as n from m where not bad and docs = [1, 2]) select conv_id, turn from n where n <= 8"
)
def chat_history(spark, d):
    m = table(spark, d, "conversations")
    messages = m.select("conv_id", "turn", "text", F.when(F.col("turn") % 5 == 4, "x").alias("error"), F.lit(None).cast("string").alias("translated_to"), F.when(F.col("turn") % 3 == 2, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("doc_ids"))
    return context.history(messages, m.select("conv_id").distinct().withColumn("doc_ids", F.array(F.lit(1), F.lit(2)))).select("conv_id", "turn")


# --- texts ---------------------------------------------------------------------------------------------------------------------------


@query("select page_id, substr(trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 60) as slug, substr(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[<>:\"|?*]+', '_', 'g'), 1, 150) as name, lower(regexp_extract(url, '[^/.][^/]*\\.([^./]+)$', 1)) as ending from pages")
def names_for_files(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", X.slug(url, "file").alias("slug"), X.file_name(url).alias("name"), X.extension(url).alias("ending"))


@query("select o_orderkey, 'Order ' || o_orderkey || ' was worth a lot' as statement from orders")
def statements_backed(spark, d):
    answer = F.concat(F.lit("It began well. Order "), F.col("o_orderkey").cast("string"), F.lit(" was **worth** a lot [S1: Page 2]. The end [S2: Page 3]."))
    return table(spark, d, "orders").select("o_orderkey", F.regexp_replace(X.backed_statement(answer, F.lit("[S1: Page 2]")), " +", " ").alias("statement"))


_CUSTOMER_TABLE = "| Name | Balance |\n| --- | --- |"


@query("select n_nationkey, 1 as block, (row_number() over (order by n_nationkey) - 1)::int as \"row\" from nation")
def evidence_found(spark, d):
    """Each nation's statement finds its own row in a table of all nations, by its number."""
    n = table(spark, d, "nation")
    rows = n.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("| "), x["n_name"], F.lit(" | 9"), F.lpad(x["n_nationkey"].cast("string"), 3, "0"), F.lit(" |"))), "\n").alias("rows"))
    passage = F.concat(F.lit(f"# The nations\n\n{_CUSTOMER_TABLE}\n"), "rows")
    said = F.concat(F.lit("Balance of 9"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    return n.crossJoin(F.broadcast(rows)).select("n_nationkey", X.best_evidence(passage, said).alias("e")).select("n_nationkey", "e.block", F.col("e.row").alias("row"))


@query("select o_orderkey, 'It cost [' || o_custkey || '](flag:0) and 7' || o_custkey || ', not [' || (o_orderkey + 5000000) || '](flag:1).' as marked from orders")
def numbers_flagged(spark, d):
    c, k = F.col("o_custkey").cast("string"), (F.col("o_orderkey") + 5000000).cast("string")
    text = F.concat(F.lit("It cost "), c, F.lit(" and 7"), c, F.lit(", not "), k, F.lit("."))
    return table(spark, d, "orders").select("o_orderkey", X.flag_numbers(text, F.array(c, k)).alias("marked"))


@query("select c_custkey, case when c_custkey % 4 = 3 then null else c_mktsegment end as segment from customer")
def json_found(spark, d):
    body = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.struct("c_custkey").alias("inner")))
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), body, F.lit(" as asked."))).otherwise(F.concat(F.lit("{"), "c_name"))
    return table(spark, d, "customer").select("c_custkey", F.get_json_object(X.json_text(text), "$.segment").alias("segment"))


@query("select user_id, string_agg('- [' || (case event_type when 'view' then 'unsupported' else 'contradicted' end) || '] event ' || event_id || case when event_id % 2 = 0 then ' (source says: \"' || event_type || '\")' else '' end, chr(10) order by event_id) as findings from events where event_type in ('view', 'error') group by 1")
def findings_listed(spark, d):
    e = table(spark, d, "events").where("event_type in ('view', 'error', 'purchase')")
    claim = F.struct("event_id", F.when(F.col("event_type") == "view", "unsupported").when(F.col("event_type") == "error", "contradicted").otherwise("supported").alias("verdict"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("claim"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("evidence"))
    listed = e.groupBy("user_id").agg(F.sort_array(F.collect_list(claim)).alias("claims"), F.count_if(F.col("event_type") != "purchase").alias("bad")).where("bad > 0")
    return listed.select("user_id", X.findings_text(F.col("claims")).alias("findings"))


@query("select n_nationkey, [n_name, 'a|b', ''] as cells from nation")
def table_cells(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.row_cells(F.concat(F.lit("| "), "n_name", F.lit(" | a\\|b | |"))).alias("cells"))


# --- Markdown: documents with marks put in -------------------------------------------------------------------------------------------


def _marked(spark, d) -> DataFrame:
    head = F.concat(F.lit("# Part "), F.col("p_partkey").cast("string"), F.lit(" #\n"), "p_name", F.lit("\n  more words\n\n- **"), "p_brand", F.lit("**\n  - 100 %\n1) one\n```\n| code\n```\n> said\n> twice\n\n| a | b |\n|---|---|\n| "), "p_type", F.lit(" | x_y |\n***\nend"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), head.alias("text"))


@query(
    "select p_partkey as doc_id, unnest([1, 2, 3, 4, 5, 6, 7, 8]) as block, unnest(['heading', 'paragraph', 'bullets', 'numbered', 'code', 'quote', 'table', 'paragraph']) as kind, "
    "unnest(['Part ' || p_partkey, p_name || ' more words', null, null, '| code', 'said twice', null, 'end']) as text, unnest([null, null, ['**' || p_brand || '**', '100 %'], ['one'], null, null, null, null]) as items from part"
)
def markdown_blocks(spark, d):
    return markdown.blocks(_marked(spark, d)).select("doc_id", "block", "kind", "text", "items")


@query(
    "with n as (select chr(10) as n) select p_partkey as doc_id, '\\section*{Part ' || p_partkey || '}' || n || n || replace(p_name, '_', '\\_') || ' more words' || n || n || '\\begin{itemize}' || n || '  \\item \\textbf{' || replace(p_brand, '#', '\\#') || '}' || n || '  \\item 100 \\%' || n || '\\end{itemize}' || n || n "
    "|| '\\begin{enumerate}' || n || '  \\item one' || n || '\\end{enumerate}' || n || n || '\\begin{verbatim}' || n || '| code' || n || '\\end{verbatim}' || n || n || '\\begin{quote}' || n || 'said twice' || n || '\\end{quote}' || n || n "
    "|| '\\begin{longtable}{ll}' || n || '\\toprule' || n || '\\textbf{a} & \\textbf{b} \\\\' || n || '\\midrule' || n || p_type || ' & x\\_y \\\\' || n || '\\bottomrule' || n || '\\end{longtable}' || n || n || 'end' as latex from part, n"
)
def markdown_as_latex(spark, d):
    return markdown.latex(markdown.blocks(_marked(spark, d)))


@query(
    "with l as (select doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null), "
    "f as (select *, sum(starts_with(line, '```')::int) over (partition by doc_id order by n) as fences from l) select doc_id, count_if(regexp_matches(line, '^[-*+]\\s+'))::bigint as bullets from f where fences % 2 = 0 group by 1 having bullets > 0"
)
def bullets_by_document(spark, d):
    """Items of lists in whole documents, but for those that stand in code."""
    found = markdown.blocks(table(spark, d, "documents")).where("kind = 'bullets'")
    return found.groupBy("doc_id").agg(F.sum(F.size("items")).alias("bullets"))


@query("select doc_id, list_transform(list_filter(string_split_regex(text, '\\r\\n|\\n|\\r|\\v|\\f'), lambda x: regexp_matches(x, '^#{1,6}\\s+\\S')), lambda x: trim(regexp_replace(x, '^#+\\s+', '')))[1:50] as headings from documents where text is not null")
def headings_of_documents(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", markdown_headings(F.col("text")).alias("headings"))


# --- personal data, readers' rules ---------------------------------------------------------------------------------------------------


def _proposals(spark, d) -> DataFrame:
    """For every document its first words, as a model might propose them."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[^A-Za-z]+"), lambda w: w != "")
    two = F.array_join(F.slice(words, 1, 2), " ")
    made = F.array(F.struct(F.lit(1).alias("place"), F.lit("other").alias("category"), F.get(words, F.lit(0)).alias("text")), F.struct(F.lit(2).alias("place"), F.lit("organization").alias("category"), two.alias("text")), F.struct(F.lit(3).alias("place"), F.lit("person").alias("category"), F.lit("Zzyx Qvwk").alias("text")))
    return table(spark, d, "documents").select("doc_id", F.explode(made).alias("m")).select("doc_id", "m.*").where("text is not null")


@query()
def findings_merged(spark, d):
    docs = table(spark, d, "documents")
    return privacy.merge_findings(privacy.scan(docs), _proposals(spark, d), docs)


@query(
    "select c_custkey as doc_id, 'person' as category, 'Anna ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as text, 2::bigint as count, 'proposal' as detected_by from customer union all "
    "select c_custkey, 'id_number', 'S' || (c_custkey + 1000), 1, 'proposal' from customer"
)
def proposals_kept(spark, d):
    """A name that stands twice and a number; a single word, a name that isn't there and one that is part of a word are dropped."""
    name = F.concat(F.lit("Anna "), F.initcap(F.lower("c_mktsegment")))
    number = F.concat(F.lit("S"), (F.col("c_custkey") + 1000).cast("string"))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(name, F.lit(" met "), F.upper(name), F.lit(" in Finland, "), number, F.lit(" and Annual")).alias("text"), name.alias("name"), number.alias("number"))
    rows = F.array(*(F.struct(F.lit(k).alias("place"), F.lit("other").alias("category"), x.alias("text")) for k, x in enumerate([F.upper("name"), F.col("name"), F.col("number"), F.lit("Finland"), F.lit("Otto Nobody"), F.lit("x")])))
    proposed = docs.select("doc_id", F.explode(rows).alias("m")).select("doc_id", "m.*")
    known = docs.limit(0).select("doc_id", F.lit("email").alias("category"), "text", F.lit(0).cast("long").alias("count"))
    ordered = privacy.merge_findings(known, proposed.where("place <> 0"), docs)
    return ordered.select("doc_id", "category", "text", "count", "detected_by")


@query("select page_id, regexp_matches(url, '^[a-z]+://(localhost|127\\.[0-9]+\\.[0-9]+\\.[0-9]+|\\[::1\\])([:/]|$)') as own from pages union all select -1, true union all select -2, false")
def addresses_of_this_machine(spark, d):
    more = spark.createDataFrame([(-1, "http://127.0.0.1:8080/v1"), (-2, "https://127.example.org/")], "page_id bigint, url string")
    return table(spark, d, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), "url").unionByName(more).select("page_id", is_loopback(F.col("url")).alias("own"))


@query("select doc_id, case when trim(coalesce(text, '')) <> '' then length(text) end::int as n, case when trim(coalesce(text, '')) = '' then 'The text is empty.' end as error from documents")
def texts_pasted(spark, d):
    return pasted(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.length("markdown").alias("n"), "error")
