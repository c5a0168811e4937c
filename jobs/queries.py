"""The jobs as queries: each runs twice into a new folder of its own and returns what is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import sqltext as X
from lodestone.session import scratch_root

from . import index_stream, saved_searches


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job1")
    for _ in range(2):
        # A pattern, as a stream's path is a folder or a pattern, and this table may be one file.
        index_stream.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/index", f"{folder}/checkpoint")
    return index_stream.postings(spark, f"{folder}/index").drop("bucket")


def job2_saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2")
    for _ in range(2):
        saved_searches.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/results")
    return saved_searches.read(spark, f"{folder}/results").drop("part")


_TOKENS = f"t AS (SELECT doc_id, text, {X.bm25_tokens('text')} AS tokens FROM documents)"
_SQL = {
    "job1_index_stream": f"WITH {_TOKENS} SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(tokens) AS term, len(tokens)::BIGINT AS dl FROM t) GROUP BY doc_id, term",
    "job2_saved_searches": f"""WITH {_TOKENS},
s AS (SELECT count(*)::DOUBLE AS n, sum(len(tokens)) / count(*) AS avgdl FROM t),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(tokens) AS term, len(tokens)::DOUBLE AS dl FROM t) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT item_id AS query_id, {X.bm25_tokens('text')} AS asked FROM benchmark),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(asked) AS term FROM qt) GROUP BY query_id, term),
b AS (SELECT query_id, doc_id, count(*) AS n_terms, round(sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25
    FROM p JOIN q USING (term) JOIN df USING (term) CROSS JOIN s GROUP BY query_id, doc_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id)::INT AS rank FROM b WHERE bm25 >= 0 QUALIFY rank <= 10),
ln AS (SELECT query_id, doc_id, asked, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM top JOIN t USING (doc_id) JOIN qt USING (query_id)),
lt AS (SELECT query_id, doc_id, line, len(list_intersect(list_distinct({X.bm25_tokens('l')}), list_distinct(asked))) AS line_terms FROM ln),
best AS (SELECT query_id, doc_id, max(line_terms)::INT AS line_terms, arg_max(line, line_terms * 1000000000 - line)::INT AS line FROM lt GROUP BY query_id, doc_id)
SELECT query_id, rank, doc_id, bm25, round(CASE WHEN bm25 > 0 THEN least(bm25 / 10, 1) ELSE 0 END, 6) AS component, n_terms, line, line_terms FROM top JOIN best USING (query_id, doc_id)""",
}


def queries() -> dict:
    return {f.__name__: f for f in (job1_index_stream, job2_saved_searches)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
