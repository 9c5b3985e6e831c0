"""Queries over answer payloads as flat tables."""

from pyspark.sql import functions as F

from quire.operators import nested
from quire.queries import query
from quire.session import table

#: Payloads without the blanks and marks around them; a JSON string is opened; outputs one to a row.
_OUTPUTS = r"""
with trimmed as (select run_id, trim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) as p from answer_runs where payload is not null),
opened as (select run_id, case when try_cast(p as json) is not null and json_type(p) = 'VARCHAR' then json_extract_string(p, '$') else p end as p from trimmed),
valid as (select run_id, p::json as j from opened where json_valid(p)),
outputs as (
  select run_id, 0 as result_pos, j as o from valid where json_type(j) = 'OBJECT'
  union all
  select run_id, (u.i - 1)::int, json_extract(j, '$[' || (u.i - 1) || ']') from valid, unnest(range(1, json_array_length(j)::bigint + 1)) u(i) where json_type(j) = 'ARRAY'),
results as (
  select run_id, result_pos, o, case when json_type(o, '$.result') = 'VARCHAR' and json_valid(json_extract_string(o, '$.result')) then json_extract_string(o, '$.result')::json else json_extract(o, '$.result') end as r
  from outputs where json_type(o) = 'OBJECT')
"""
_HITS = (
    _OUTPUTS
    + r""",
held as (select run_id, result_pos, json_extract(r, '$.top_k_hits') as h from results where json_type(r) = 'OBJECT'),
hits as (
  select run_id, result_pos, 0 as hit_pos, h as e from held where json_type(h) = 'OBJECT'
  union all
  select run_id, result_pos, (u.i - 1)::int, json_extract(h, '$[' || (u.i - 1) || ']') from held, unnest(range(1, json_array_length(h)::bigint + 1)) u(i) where json_type(h) = 'ARRAY')
"""
)


@query("p3_found", _HITS + " select distinct run_id, result_pos, hit_pos, json_extract_string(e, '$.chunk_id') as chunk_id from hits where json_type(e) = 'OBJECT' and json_extract_string(e, '$.chunk_id') is not null")
def p3_found(spark, sf):
    return nested.answer_hits(table(spark, sf, "answer_runs")).select("run_id", "result_pos", "hit_pos", "chunk_id")


@query("p3_runs", _OUTPUTS + " select distinct run_id::varchar || '#' || result_pos as run_key, run_id, result_pos, json_extract_string(r, '$.query') as query, json_extract_string(r, '$.query_intent') as query_intent from results where r is null or json_type(r) in ('OBJECT', 'NULL')")
def p3_runs(spark, sf):
    rows = nested.answer_table(table(spark, sf, "answer_runs"), "run", ("result.query", "result.query_intent"))
    return rows.select(F.col("row_key").alias("run_key"), F.col("parent_key").cast("bigint").alias("run_id"), F.col("ordinal").alias("result_pos"), F.col("`result.query`").alias("query"), F.col("`result.query_intent`").alias("query_intent"))


@query("p3_evidence", _OUTPUTS + r""",
held as (select run_id, result_pos, json_extract(r, '$.evidence') as h from results where json_type(r) = 'OBJECT')
select distinct run_id::varchar || '#' || result_pos || '/result.evidence[' || (u.i - 1) || ']' as row_key, run_id::varchar || '#' || result_pos as run_key, (u.i - 1)::int as evidence_pos,
  json_extract_string(h, '$[' || (u.i - 1) || '].chunk_id') as chunk_id, json_extract_string(h, '$[' || (u.i - 1) || '].sentence') as sentence
from held, unnest(range(1, json_array_length(h)::bigint + 1)) u(i) where json_type(h) = 'ARRAY' and json_type(json_extract(h, '$[' || (u.i - 1) || ']')) = 'OBJECT'
""")
def p3_evidence(spark, sf):
    rows = nested.answer_table(table(spark, sf, "answer_runs"), "run.result.evidence", ("chunk_id", "sentence"))
    return rows.select("row_key", F.col("parent_key").alias("run_key"), F.col("ordinal").alias("evidence_pos"), "chunk_id", "sentence")


@query("p3_children")
def p3_children(spark, sf):
    """Every row below a run with its table, its parent and its place, and how many columns it fills."""
    rows = nested.shredded(table(spark, sf, "answer_runs"), "run_id", "payload", None, nested.DECODE, nested.SPLIT)
    return rows.where("`table` <> 'run'").select("table", "row_key", "parent_key", "ordinal", F.size("cols").alias("n_columns")).distinct()


@query("p3_schema")
def p3_schema(spark, sf):
    """The merged schema of all payloads: one row per table and column."""
    schema = nested.merged_schema(nested.shredded(table(spark, sf, "answer_runs"), "run_id", "payload", None, nested.DECODE, nested.SPLIT))
    return spark.createDataFrame([(t, c, k) for t, cols in schema.items() for c, k in cols.items()], "table_name string, column_name string, sql_type string")
