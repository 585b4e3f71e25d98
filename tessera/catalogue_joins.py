"""Registered queries of joins by nearness and of checks of model output against a schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.model_json import json_problems
from tessera.operators import grounding
from tessera.registry import query, table


@query(
    "with n as (select doc_id, regexp_replace(coalesce(text, ''), '[^0-9]+', ' x ', 'g') as text from documents), "
    "a as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+')) as token, generate_subscripts(regexp_extract_all(text, '[0-9]+'), 1) - 1 as place from n), asked as (select doc_id, row_number() over (partition by doc_id order by place) - 1 as place, token, token::double as v from a where token::double > 12), "
    "known as (select distinct doc_id as source, token::double as k from a union select distinct -1 - item_id, unnest(regexp_extract_all(text, '[0-9]+'))::double from benchmark), "
    "held as (select distinct asked.doc_id, place from asked join known on source in (asked.doc_id + 1, asked.doc_id + 2, -1 - asked.doc_id) and abs(v - k) < 1e-6 * greatest(1, abs(v), abs(k))) "
    "select doc_id, place::int as place, token from asked anti join held using (doc_id, place)"
)
def numbers_in_no_source(spark, d):
    """Whole numbers of each document that neither the two next documents nor the benchmark item of its number holds."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]+", " x ")
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    near = F.array(F.col("doc_id") + 1, F.col("doc_id") + 2)
    answers = docs.join(items.select(F.col("item_id").alias("doc_id"), bare(F.col("text")).alias("question")), "doc_id", "left")
    answers = answers.select(F.col("doc_id").alias("answer_id"), bare(F.col("text")).alias("answer"), "question", near.alias("doc_ids"))
    return grounding.unsupported(answers, docs.select("doc_id", bare(F.col("text")).alias("markdown"))).select(F.col("answer_id").alias("doc_id"), "place", "token")



@query(
    "select event_id, case when event_id % 13 = 0 then ['$: no JSON'] else list_concat(case when event_id % 7 = 0 then ['$.note: extra'] else [] end, case when event_id % 3 = 0 then ['$.user: missing'] else [] end, "
    "case when event_id % 5 = 0 then ['$.value: no number'] else [] end, case when event_id % 11 = 0 then ['$.tags[1].name: no string', '$.tags[1].id: missing'] else [] end) end as problems from events"
)
def model_json_problems(spark, d):
    """Events written as a model's JSON, some with keys missing, added or of the wrong kind, or cut off, against a schema of three levels."""
    e = F.col("event_id")
    tag = lambda bad: F.struct(F.when(~bad, F.col("event_type")).alias("name"), F.when(~bad, F.lit(1)).alias("id"))
    second = F.when(e % 11 == 0, F.lit('{"name":5}')).otherwise(F.to_json(tag(F.lit(False))))
    value = F.when(e % 5 == 0, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).otherwise(F.coalesce(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("0")))
    parts = [F.concat(F.lit('"kind":"'), F.col("event_type"), F.lit('"')), F.when(e % 3 != 0, F.concat(F.lit('"user":'), F.col("user_id").cast("string"))), F.concat(F.lit('"value":'), value), F.when(e % 7 == 0, F.lit('"note":null'))]
    tags = F.concat(F.lit('"tags":['), F.to_json(tag(F.lit(False))), F.lit(","), second, F.lit("]"))
    text = F.concat(F.lit("{"), F.concat_ws(",", *parts, tags), F.when(e % 13 == 0, F.lit("")).otherwise(F.lit("}")))
    schema = {"kind": "string", "user": "integer", "value": "number", "tags": [{"name": "string", "id": "integer"}], "comment?": "string?"}
    return table(spark, d, "events").select("event_id", json_problems(text, schema).alias("problems"))
