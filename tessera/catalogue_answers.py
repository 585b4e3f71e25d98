"""Registered queries of suites, runs, quizzes and translations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import translation
from tessera.operators import evaluation, study, suites
from tessera.registry import query, table

# --- quizzes: orders as questions ----------------------------------------------------------------------------------------------------

_TYPES = ["multiple_choice", "true_false", "short_answer", "essay"]


def _quiz(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (k % 4).cast("int") + 1)
    options = F.array(F.col("o_orderstatus"), F.substring("o_orderpriority", 3, 20), F.lit("neither"))
    given = F.when(k % 3 == 0, F.concat(F.element_at(F.array(*map(F.lit, "ABCd")), (k % 7 % 4).cast("int") + 1), F.lit(")"))).when(k % 3 == 1, F.lit(" tRUE ")).otherwise(F.col("o_orderstatus"))
    source = F.when(k % 2 == 0, F.concat(F.lit("(S1: Page "), k.cast("string"), F.lit(") "))).otherwise(F.lit("page"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("quiz_id"), k.alias("place"), kind.alias("type"), options.alias("options"), given.alias("answer"), source.alias("source"))


_QUIZ = (
    "with q as (select o_custkey as quiz_id, o_orderkey as place, ['multiple_choice', 'true_false', 'short_answer', 'essay'][(o_orderkey % 4)::int + 1] as type, [o_orderstatus, substr(o_orderpriority, 3, 20), 'neither'] as options, "
    "case o_orderkey % 3 when 0 then ['A', 'B', 'C', 'd'][(o_orderkey % 7 % 4)::int + 1] || ')' when 1 then ' tRUE ' else o_orderstatus end as answer, "
    "case when o_orderkey % 2 = 0 then '[S1: Page ' || o_orderkey || ']' else 'page' end as source from orders), "
    "n as (select *, row_number() over (partition by quiz_id order by place) as n from q where type in ('multiple_choice', 'true_false')), "
    "c as (select quiz_id, place, type, source, case when type = 'true_false' then (case when lower(trim(answer)) like 't%' then 'True' else 'False' end) "
    "when answer ~ '^[A-Da-d]\\)$' and not list_contains(options, answer) then options[least(ascii(upper(answer)) - 64, 3)] else answer end as answer from n where n <= 5) "
)


@query(_QUIZ + "select quiz_id, place, type, answer, source from c")
def quizzes_cleaned(spark, d):
    return study.clean_quiz(_quiz(spark, d), _TYPES[:2], 5).select("quiz_id", "place", "type", "answer", "source")


def _graded(spark, d) -> DataFrame:
    cleaned = study.clean_quiz(_quiz(spark, d), _TYPES[:2], 5)
    given = F.when(F.col("place") % 5 == 0, F.concat(F.lit("  "), F.upper("answer"))).when(F.col("place") % 5 == 1, F.lit("")).otherwise(F.lit("true"))
    return study.grade(cleaned.withColumns({"given": given, "explanation": F.lit("See the order."), "question": F.concat(F.lit("Order "), F.col("place").cast("string"))}))


_GRADED = _QUIZ + ", g as (select *, case place % 5 when 0 then '  ' || upper(answer) when 1 then '' else 'true' end as given from c), r as (select *, lower(trim(given)) = lower(trim(answer)) as correct from g) "


@query(
    _GRADED + "select quiz_id, place, correct, case when correct then 100 else 0 end as score, case when correct then 'Correct. See the order.' else 'Not quite - the correct answer is: ' || answer || '. See the order.' end as feedback from r"
)
def quiz_grades(spark, d):
    return _graded(spark, d).select("quiz_id", "place", "correct", "score", "feedback")


@query(_GRADED + "select quiz_id, count(*) as questions, count_if(correct)::bigint as \"right\", sum(case when correct then 100 else 0 end)::bigint as total, round_even(avg(case when correct then 100 else 0 end), 0)::int as average from r group by 1")
def quiz_totals(spark, d):
    return study.totals(_graded(spark, d), "quiz_id")


@query(
    _GRADED
    + ", t as (select quiz_id, 'Score: ' || count_if(correct) || '/' || count(*) || ' correct, average ' || round_even(avg(case when correct then 100 else 0 end), 0)::int || '%' as note from r group by 1) "
    "select quiz_id, (row_number() over (partition by quiz_id order by place))::varchar as number, case when correct then 'yes' else 'no' end as correct, case when correct then '100' else '0' end as score, source, note from r join t using (quiz_id)"
)
def quiz_report(spark, d):
    return study.report_rows(_graded(spark, d), "quiz_id").select("quiz_id", "number", "correct", "score", "source", "note")


@query("select event_id, greatest(0, least(100, cast(trunc(value) as int))) as score from events")
def scores_bounded(spark, d):
    return table(spark, d, "events").select("event_id", study.bounded_score(F.col("value")).alias("score"))


# --- translations: parts' names with citations ---------------------------------------------------------------------------------------


def _cited(spark, d) -> DataFrame:
    text = F.concat(F.lit("The "), "p_name", F.lit(" [S1: Page "), F.col("p_size").cast("string"), F.lit("] is made by "), "p_brand", F.lit(" [S2: Row "), F.col("p_partkey").cast("string"), F.lit("]."))
    return table(spark, d, "part").select("p_partkey", translation.protect(text).alias("p"))


@query("select p_partkey, 'The ' || p_name || ' [[C1]] is made by ' || p_brand || ' [[C2]].' as text, ['[S1: Page ' || p_size || ']', '[S2: Row ' || p_partkey || ']'] as marks from part")
def citations_protected(spark, d):
    return _cited(spark, d).select("p_partkey", "p.text", "p.marks")


@query(
    "select p_partkey, case p_partkey % 3 when 0 then 'The ' || p_name || ' [S1: Page ' || p_size || '] is made by ' || p_brand || ' [S2: Row ' || p_partkey || '].' "
    "when 1 then 'The ' || p_name || '  is made by ' || p_brand || ' [S2: Row ' || p_partkey || '].' || chr(10) || chr(10) || '[S1: Page ' || p_size || ']' "
    "else 'The ' || p_name || ' [S1: Page ' || p_size || '] is made by ' || p_brand || ' [S2: Row ' || p_partkey || '].' end as text, "
    "case when p_partkey % 3 = 1 then 1 else 2 end as kept, case when p_partkey % 3 = 1 then 1 else 0 end as reattached from part"
)
def citations_restored(spark, d):
    k = F.col("p_partkey") % 3
    text = F.when(k == 1, F.replace(F.col("p.text"), F.lit("[[C1]]"), F.lit("[[C9]]"))).when(k == 2, F.replace(F.col("p.text"), F.lit("[[C2]]"), F.lit("[[ c 2 ]]"))).otherwise(F.col("p.text"))
    return _cited(spark, d).select("p_partkey", translation.restore(text, F.col("p.marks")).alias("r")).select("p_partkey", "r.text", "r.kept", "r.reattached")


@query("select doc_id, case lang when 'en' then 'English' when 'fi' then 'Finnish' else coalesce(nullif(substr(trim(lang), 1, 40), ''), 'English') end as language, least(4096, greatest(256, length(text) // 2))::int as budget from documents where text is not null")
def translation_budgets(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", translation.language_name(F.col("lang")).alias("language"), translation.output_budget(F.col("text")).alias("budget"))


# --- suites: benchmark items as questions, documents as corpora ----------------------------------------------------------------------


def _suite(spark, d) -> dict[str, DataFrame]:
    """Each item asks for its own first words; every third asks for two things, every seventh has no answer; evidence is named by the item."""
    b = table(spark, d, "benchmark").withColumn("k", F.col("item_id").cast("long")).withColumn("id", F.col("item_id").cast("string"))
    category = F.when(F.col("k") % 7 == 0, "unanswerable").when(F.col("k") % 3 == 0, "list").otherwise("detail")
    word = lambda n: F.array(F.get(F.split("text", " "), F.lit(n)))
    questions = b.select(
        F.col("id").alias("question_id"), F.col("k").alias("place"), category.alias("category"), F.when(F.col("k") % 2 == 0, "standard").otherwise("hard").alias("difficulty"), (F.col("k") % 5 == 0).alias("cross"), (F.col("k") % 11 == 0).alias("derived"), word(0).alias("answer"),
    )
    items = b.select(F.col("id").alias("question_id"), F.explode(F.array(F.struct(F.lit("first").alias("name"), word(0).alias("match")), F.struct(F.lit("second").alias("name"), F.array(F.lit("zzqx")).alias("match")))).alias("i")).select("question_id", "i.*")
    own = b.select(F.col("id").alias("question_id"), F.explode(F.array(F.lit(None).cast("string"), F.lit("first"), F.lit("second"))).alias("item"))
    where = F.when(F.col("question_id").cast("long") % 4 == 0, F.lit("Nowhere")).otherwise(F.concat(F.lit("Item "), "question_id"))
    evidence = own.withColumn("doc", F.lit("bench")).withColumn("locator", where).withColumn("locators", F.lit(None).cast("map<string,string>"))
    corpora = b.select(F.lit("en").alias("language"), F.lit("bench").alias("doc"), F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("Item "), "id").alias("locator"), F.col("text").alias("markdown"))
    return {"questions": questions, "items": items, "evidence": evidence, "corpora": corpora}


_S = (
    "with b as (select item_id::bigint as k, item_id::varchar as id, text, case when item_id % 7 = 0 then 'unanswerable' when item_id % 3 = 0 then 'list' else 'detail' end as category, case when item_id % 2 = 0 then 'standard' else 'hard' end as difficulty, "
    "item_id % 5 = 0 as \"cross\", item_id % 11 = 0 as derived, string_split(text, ' ')[1] as word from benchmark) "
)


@query(_S + "select category, difficulty, count(*) as questions, count_if(\"cross\")::bigint as \"cross\" from b group by cube (category, difficulty)")
def suite_summary(spark, d):
    return suites.counts(_suite(spark, d)["questions"])


@query(_S + ", n as (select *, row_number() over (partition by category order by k) as n from b where difficulty = 'standard') select 4 * (count(*) + count_if(\"cross\"))::bigint as cases from n where n <= 2")
def suite_estimate(spark, d):
    return suites.estimated_cases(_suite(spark, d)["questions"], ["standard"], 2, 2, True, 2)


_TARGETS = (
    ", t as (select id as question_id, id as label, case when derived then []::varchar[] else [word] end as patterns, case when k % 4 = 0 then 'Nowhere' else 'Item ' || id end as locator, text, k from b where category = 'detail' "
    "union all select id, id || '/first', case when derived then [] else [word] end, case when k % 4 = 0 then 'Nowhere' else 'Item ' || id end, text, k from b where category = 'list' "
    "union all select id, id || '/second', case when derived then [] else ['zzqx'] end, case when k % 4 = 0 then 'Nowhere' else 'Item ' || id end, text, k from b where category = 'list') "
)


@query(_S + _TARGETS + "select question_id, 'en' as language, label, patterns, 'bench' as doc, locator from t")
def evidence_targets(spark, d):
    return suites.targets(_suite(spark, d), ["en"])


@query(
    _S + _TARGETS + "select distinct 'en' as language, label, 'locator not found' as problem, locator from t where locator = 'Nowhere' union all "
    "select 'en', label, 'answer not found', null from t where locator = 'Nowhere' or not (len(patterns) = 0 or contains(lower(text), lower(patterns[1])))"
)
def suite_problems(spark, d):
    suite = _suite(spark, d)
    return suites.self_check(suites.targets(suite, ["en"]), suite["corpora"])


def _citations(spark, d) -> DataFrame:
    """Events as answers that cite an item each, one in four without success."""
    e, n = table(spark, d, "events"), table(spark, d, "benchmark").count()
    k = F.col("event_id").cast("long")
    return e.select(k.alias("answer_id"), (k % n).cast("string").alias("question_id"), F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("Item "), ((k + F.when(k % 3 == 0, 1).otherwise(0)) % n).cast("string")).alias("resolved_locator"), (k % 4 != 0).alias("found"))


@query(
    "with n as (select count(*) as n from benchmark) select event_id::bigint as answer_id, event_id % 4 <> 0 and event_id % 3 <> 0 and (event_id % n) in (select item_id from benchmark where item_id % 4 <> 0) as citation_hit from events, n"
)
def citation_hits(spark, d):
    suite = _suite(spark, d)
    gold = suite["evidence"].select("question_id", F.lit(1).cast("long").alias("doc_id"), "locator")
    return suites.citation_hits(_citations(spark, d), gold)


def _retrieval(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets of the suite's answerable questions by tier; ranked: own passage at place id % 6 + 1; sent: up to place 4, none for every 13th."""
    suite = _suite(spark, d)
    tier = suite["questions"].select("question_id", "difficulty")
    wanted = suites.targets(suite, ["en"]).join(tier, "question_id").select(F.col("question_id").alias("query_id"), "label", "patterns", F.lit(1).cast("long").alias("doc_id"), "locator", "difficulty")
    k = F.col("item_id").cast("long")
    ranked = table(spark, d, "benchmark").select(k.cast("string").alias("query_id"), (k % 6 + 1).cast("int").alias("rank"), F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("Item "), k.cast("string")).alias("locator"), "text")
    return wanted, ranked, ranked.where("rank <= 4 and cast(query_id as bigint) % 13 <> 0").drop("rank")


_HITS = _S + _TARGETS + (
    ", h as (select question_id, label, difficulty, t.k, locator <> 'Nowhere' and (len(patterns) = 0 or contains(lower(t.text), lower(patterns[1]))) as hit, t.k % 6 + 1 as rank, t.k % 6 + 1 <= 4 and t.k % 13 <> 0 as sent from t join b on b.id = t.question_id), "
    "q as (select question_id, difficulty, any_value(sent) as anything, avg((hit and rank <= 1)::int) as k1, avg((hit and rank <= 3)::int) as k3, avg((hit and rank <= 5)::int) as k5, avg((hit and sent)::int) as sent from h group by 1, 2) "
)


@query(
    _HITS + "select difficulty, count(*) as questions, round(avg(k1), 3) as recall_at_1, round(avg(k3), 3) as recall_at_3, round(avg(k5), 3) as recall_at_5, round(avg(case when anything then sent else 1 end), 3) as context_recall, count_if(not anything)::bigint as fallbacks from q group by 1"
)
def retrieval_matrix(spark, d):
    return suites.recall(*_retrieval(spark, d), ["difficulty"])


@query(_HITS + "select question_id as query_id, difficulty, list_sort(list(label)) as missed from h where sent and not hit group by 1, 2")
def retrieval_misses(spark, d):
    wanted, _, kept = _retrieval(spark, d)
    return suites.misses(wanted, kept, ["difficulty"])


# --- runs: events as cases -----------------------------------------------------------------------------------------------------------


def _cases(spark, d) -> DataFrame:
    k = F.col("event_id")
    category = F.when(k % 3 == 0, "detail").when(k % 3 == 1, "list").otherwise("unanswerable")
    return table(spark, d, "events").select(
        category.alias("category"), F.when(k % 2 == 0, "hard").alias("difficulty"), F.col("event_type").alias("strategy"), F.when(k % 5 < 3, "en").otherwise("fi").alias("corpus_language"), F.when(k % 7 < 4, "en").otherwise("fi").alias("question_language"),
        (k % 4 / 4.0).alias("score"), (k % 6 == 0).alias("correct"), F.when(k % 3 == 1, k % 4 / 4.0).alias("precision"), (k % 5 == 0).alias("abstained"), (k % 7).cast("int").alias("unsupported"), (k % 11 == 0).alias("derived"), (k % 13 == 0).alias("prompt_leak"),
        (k % 2).cast("int").alias("citations"), F.when(k % 2 == 1, k % 4 == 1).alias("citation_hit"), F.col("value").alias("seconds"), F.when(k % 17 == 0, "x").alias("error"), F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run"),
    )


_R = (
    "with r as (select case event_id % 3 when 0 then 'detail' when 1 then 'list' else 'unanswerable' end as category, case when event_id % 2 = 0 then 'hard' else 'standard' end as difficulty, event_type as strategy, case when event_id % 5 < 3 then 'en' else 'fi' end as c, "
    "case when event_id % 7 < 4 then 'en' else 'fi' end as q, event_id % 4 / 4.0::double as score, event_id % 6 = 0 as correct, case when event_id % 3 = 1 then event_id % 4 / 4.0::double end as \"precision\", event_id % 5 = 0 as abstained, event_id % 7 as unsupported, "
    "event_id % 11 = 0 as derived, event_id % 13 = 0 as prompt_leak, event_id % 2 as citations, event_id % 4 = 1 as hit, value as seconds, event_id % 17 <> 0 as good, 'run' || user_id % 3 as run from events) "
)
_M = (
    "count(*) as cases, count_if(not good)::bigint as errors, round(avg(score) filter (good), 3) as overall, round(avg(correct::int) filter (good and category = 'detail'), 3) as detail_accuracy, round(avg(score) filter (good and category = 'list'), 3) as list_recall, "
    "round(avg(\"precision\") filter (good and category = 'list'), 3) as list_precision, round(avg(correct::int) filter (good and category = 'unanswerable'), 3) as abstention_accuracy, round(avg((abstained and score = 0)::int) filter (good and category <> 'unanswerable'), 3) as false_abstention_rate, "
    "round(avg((unsupported > 0)::int) filter (good and not derived), 3) as unsupported_number_rate, round(avg(prompt_leak::int) filter (good), 3) as prompt_leak_rate, round(avg((citations > 0)::int) filter (good and category <> 'unanswerable'), 3) as citation_rate, "
    "round(avg(hit::int) filter (good and category <> 'unanswerable'), 3) as citation_accuracy, round(avg(seconds) filter (good), 3) as seconds_mean, round(coalesce(sum(seconds) filter (good), 0), 1) as seconds_total"
)


@query(
    _R + ", k as (select *, unnest(['all', 'strategy=' || strategy, 'corpus=' || c, strategy || '/' || c || '/' || (case when c = q then 'same' else 'cross' end), q || '->' || c, 'difficulty=' || difficulty, strategy || '/difficulty=' || difficulty]) as key from r) "
    f"select key, {_M} from k group by key"
)
def run_measures(spark, d):
    return evaluation.run_groups(_cases(spark, d))


_SHOWN = {"overall": "Overall", "list_recall": "Similar items: recall", "citation_accuracy": "Cites the right location"}
_PCT = "coalesce(round_even(100 * {0}, 0)::int || ' %', '-')"


@query(
    _R + f", m as (select run, {_M} from r group by run), s as (" + " union all ".join(f"select {k} as place, '{label}' as metric, run, {_PCT.format(c)} as v from m" for k, (c, label) in enumerate(_SHOWN.items()))
    + ") select place, metric, max(v) filter (run = 'run0') as run0, max(v) filter (run = 'run1') as run1, max(v) filter (run = 'run2') as run2 from s group by 1, 2"
)
def runs_side_by_side(spark, d):
    return suites.side_by_side(_cases(spark, d).groupBy("run").agg(*evaluation.run_metrics()), ["run0", "run1", "run2"], _SHOWN)


@query("select event_id, case when v is null then '-' when v >= 60 then printf('%.1f min', v / 60) else printf('%.0f s', v) end as duration from (select event_id, value + 0.00137 as v from events)")
def durations(spark, d):
    return table(spark, d, "events").select("event_id", suites.duration(F.col("value") + 0.00137).alias("duration"))


@query(
    "with r as (select c_custkey as run_id, c_nationkey as model, c_custkey as place, floor(c_acctbal)::bigint as completed_cases from customer where c_custkey % 5 <> 0), b as (select *, row_number() over (partition by model order by completed_cases desc, place) as n from r) "
    "select run_id::varchar as run_id, completed_cases from b where n = 1 order by completed_cases desc, place limit 4"
)
def best_runs(spark, d):
    c = table(spark, d, "customer")
    runs = c.select(F.col("c_custkey").cast("string").alias("run_id"), F.col("c_custkey").alias("place"), F.col("c_nationkey").cast("string").alias("model"), F.when(F.col("c_custkey") % 5 != 0, F.lit("t")).alias("finished_at"), F.floor("c_acctbal").cast("long").alias("completed_cases"))
    return suites.best_runs(runs).select("run_id", "completed_cases")


@query(_R + "select strategy, case when not good then 'error' when correct then 'right' when category = 'list' and score > 0 then floor(100 * score + 0.5)::int || ' %' else 'wrong' end as verdict, count(*) as n from r group by 1, 2")
def case_verdicts(spark, d):
    shown = suites.verdict(F.col("error"), F.col("correct"), F.col("category"), F.col("score"))
    return _cases(spark, d).groupBy("strategy", shown.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("select item_id::varchar as question_id, case when item_id % 3 = 0 then 0.5 else 1.0 end::double as score, item_id % 3 <> 0 as correct from benchmark where item_id % 7 <> 0 and item_id % 10 <> 9")
def answers_scored_again(spark, d):
    """Saved answers that hold the first word of each item and no other; those with an error are left out."""
    suite = _suite(spark, d)
    listed = suite["items"].groupBy("question_id").agg(F.collect_list(F.struct("name", "match")).alias("items"))
    questions = suite["questions"].where("category <> 'unanswerable'").join(listed, "question_id").select("question_id", "category", F.col("answer").alias("accept"), "items", F.col("items").alias("universe"), "difficulty", "derived")
    saved = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.concat(F.lit("- "), F.get(F.split("text", " "), F.lit(0))).alias("answer"), F.when(F.col("item_id") % 10 == 9, "timeout").alias("error"), F.lit(0.1).alias("score"))
    return evaluation.scored_again(saved, questions).select("question_id", "score", "correct")
