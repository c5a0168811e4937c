"""Queries over the test tables, and SQL that gives the same rows.

All run over whole tables. Sums of floating-point numbers are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions import forms, porter, text
from lodestone.functions.query import Query
from lodestone.operators import blocks, bm25, corpus, locate, report, retrieve, scoring
from lodestone.session import scratch_root, table

from . import sqltext as X

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

LEXICAL = Query("worthless the in of the ther")
MORPHOLOGICAL = Query("retitioning function ention")
CODE = Query("class public for each function")
PHRASE = Query("of the")
N, THRESHOLD = 5, 0.05


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _r(c, name: str):
    return F.round(c, 6).alias(name)


# --- text ----------------------------------------------------------------------------------

#: Operators that no table has, in all their combinations with words.
SYMBOLS = ["a::b", "a:b:c", "x==y", "+==", "**b**", "*i* `c` _d_e_", "a_b_c", "...", "x!==y===z", "f(a)[b].c{d}", "p->q=>r?.s??t", "i++ + --j<<2>>1", "a<=b>=c<d>e!f", "a&&b||c&d|e^~f", "10%3/2*1", "é:ü", "#h@m$v;w,x"]
#: Texts with one of them for each space.
_SYMBOL_SQL = f"(SELECT item_id, replace(text, ' ', {X.lst(SYMBOLS)}[item_id % {len(SYMBOLS)} + 1]) AS s FROM benchmark)"


def _symbols(spark, sf_dir) -> DataFrame:
    put = F.element_at(forms.literal(SYMBOLS), (F.col("item_id") % len(SYMBOLS) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit(" "), put).alias("s"))


@_query(f"SELECT doc_id, md5({X.strip(X.unify('text'))}) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.clean(F.col("text")).cast("binary")).alias("cleaned"))


@_query(f"SELECT item_id, {X.separate('s')} AS apart, {X.verbalize('s')} AS spelled, {X.verbalize(X.separate('s'))} AS both FROM {_SYMBOL_SQL}")
def symbols_inline(spark, sf_dir):
    s = F.col("s")
    return _symbols(spark, sf_dir).select("item_id", text.separate_symbols(s).alias("apart"), text.verbalize_operators(s).alias("spelled"), text.verbalize_operators(text.separate_symbols(s)).alias("both"))


@_query(f"SELECT page_id, md5({X.separate('html')}) AS apart FROM pages")
def separate_symbols(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.separate_symbols(F.col("html")).cast("binary")).alias("apart"))


@_query(f"SELECT page_id, md5({X.verbalize('html')}) AS spelled FROM pages")
def verbalize_operators(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.verbalize_operators(F.col("html")).cast("binary")).alias("spelled"))


def _token_query(name, column, sql):
    def run(spark, sf_dir):
        t = column(F.col("text"))
        return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))

    run.__name__ = name
    _query(f"SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql} AS t FROM documents)")(run)


_token_query("ident_tokens", text.identifiers, X.identifiers("text"))
_token_query("word_tokens", text.words, X.words("text"))
_token_query("bm25_tokens", text.bm25_tokens, X.bm25_tokens("text"))
_token_query("content_words", lambda c: text.without_stops(text.words(c)), X.unstopped(X.words("text")))
_token_query("topic_words", text.topic_words, X.topic_words("text"))
_token_query("split_tokens", text.tokens, f"list_filter(regexp_split_to_array(text, '{X.S}+'), lambda w: w <> '')")


@_query(f"SELECT word, n, len({X.partials('word')})::BIGINT AS n_partials, md5(array_to_string(list_sort({X.partials('word')}), ' ')) AS partials FROM (SELECT unnest({X.words('text')}) AS word, count(*) AS n FROM documents GROUP BY 1)")
def partial_forms(spark, sf_dir):
    vocabulary = _docs(spark, sf_dir).select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    p = forms.partials_of(F.col("word"))
    return vocabulary.select("word", "n", F.size(p).cast("long").alias("n_partials"), F.md5(F.array_join(F.array_sort(p), " ").cast("binary")).alias("partials"))


@_query("SELECT word, array_to_string(list_sort(" + X.base("word") + "), ' ') AS forms FROM (SELECT DISTINCT unnest(list_concat(" + X.words("html") + ", ['classes', 'property', 'structs', 'event'])) AS word FROM pages)")
def plural_forms(spark, sf_dir):
    some = F.concat(text.words(F.col("html")), forms.literal(["classes", "property", "structs", "event"]))
    vocabulary = table(spark, sf_dir, "pages").select(F.explode(some).alias("word")).distinct()
    return vocabulary.select("word", F.array_join(F.array_sort(forms.base_forms_of(F.array("word"))), " ").alias("forms"))


@_query(f"WITH v AS (SELECT DISTINCT unnest({X.words('text')}) AS word FROM documents), {X.stem_tables('v')} SELECT word, stem FROM stems")
def stems(spark, sf_dir):
    """The stem of each distinct word of documents, worked out once a word."""
    vocabulary = _docs(spark, sf_dir).select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    return vocabulary.select("word", porter.stem_of(F.col("word")).alias("stem"))


@_query(f"SELECT page_id, list_sort({X.concepts('html')}) AS concepts FROM pages")
def page_concepts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(scoring.concepts(F.col("html"))).alias("concepts"))


@_query(
    "SELECT page_id, list_last(string_split(url, '/')) AS basename, "
    "CASE WHEN page_id % 3 = 0 THEN 'doc_' || md5(html)[1:8] ELSE replace(regexp_replace(url, '[^A-Za-z0-9 _-]', '', 'g'), ' ', '_') END AS safe_name, "
    "md5(CASE WHEN page_id % 3 = 0 THEN html ELSE '# ' || url || chr(10) || chr(10) || html END) AS body FROM pages"
)
def safe_filename(spark, sf_dir):
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", text.basename(F.col("url")).alias("basename"), text.safe_name(title, F.col("html")).alias("safe_name"), F.md5(text.titled(title, F.col("html")).cast("binary")).alias("body")
    )


@_query("SELECT item_id, url_encode(text) AS encoded, to_json({'v': text})::VARCHAR AS j FROM benchmark")
def client_encoding(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", text.percent_encode(t).alias("encoded"), F.concat(F.lit('{"v":"'), text.json_string(t), F.lit('"}')).alias("j"))


@_query("SELECT doc_id, contains(lower(text), 'of the') AS hit FROM documents")
def phrase_test(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.contains_phrase(F.col("text"), F.lit(" Of The ")).alias("hit"))


# --- BM25 ----------------------------------------------------------------------------------

_BM25_TABLES = f"""
t AS (SELECT doc_id, {X.bm25_tokens('text')} AS tokens FROM documents),
d AS (SELECT doc_id, len(tokens)::DOUBLE AS dl FROM t),
s AS (SELECT count(*)::DOUBLE AS n, sum(dl) / count(*) AS avgdl FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term)"""


def _bm25_sql(query: Query) -> str:
    terms = ", ".join(f"({X.q(t)}, {n})" for t, n in sorted(query.bm25_terms.items()))
    return f"""{_BM25_TABLES},
q(term, times) AS (VALUES {terms}),
b AS (SELECT p.doc_id, sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM p JOIN q USING (term) JOIN df USING (term) JOIN d USING (doc_id) CROSS JOIN s GROUP BY p.doc_id)"""


@_query(f"WITH {_BM25_TABLES} SELECT doc_id, term, tf FROM p")
def postings(spark, sf_dir):
    return bm25.postings(_docs(spark, sf_dir))


@_query(f"WITH {_BM25_TABLES} SELECT term, df, cf, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df CROSS JOIN s")
def term_stats(spark, sf_dir):
    return bm25.term_stats(_docs(spark, sf_dir)).select("term", "df", "cf", _r(F.col("idf"), "idf"))


@_query(f"WITH {_BM25_TABLES} SELECT n::BIGINT AS n_docs, round(avgdl, 6) AS avgdl FROM s")
def corpus_stats(spark, sf_dir):
    return bm25.corpus_stats(_docs(spark, sf_dir)).select("n_docs", _r(F.col("avgdl"), "avgdl"))


@_query(f"WITH {_bm25_sql(LEXICAL)} SELECT doc_id, round(coalesce(score, 0), 6) AS bm25, round(CASE WHEN score > 0 THEN least(score / 10, 1) ELSE 0 END, 6) AS squashed FROM documents LEFT JOIN b USING (doc_id)")
def bm25_all_docs(spark, sf_dir):
    return bm25.score_all(_docs(spark, sf_dir), LEXICAL).select("doc_id", _r(F.col("bm25"), "bm25"), _r(bm25.squash(F.col("bm25")), "squashed"))


@_query(f"WITH {_bm25_sql(LEXICAL)} SELECT doc_id, round(score, 6) AS bm25 FROM b")
def bm25_index_scores(spark, sf_dir):
    return bm25.Index.fit(_docs(spark, sf_dir)).score(LEXICAL).select("doc_id", _r(F.col("bm25"), "bm25"))


def _stored(spark, sf_dir) -> bm25.StoredIndex:
    """An index of documents that came to be by steps: a third of them with other texts, these again as they are, more that leave again, and the rest."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    stored = bm25.StoredIndex(spark, f"{scratch_root(spark)}/stored-{uuid.uuid4().hex}", "long")
    third = docs.where("doc_id % 3 = 0")
    stored.change(third.withColumn("text", F.concat(F.lit("worthless "), F.substring("text", 1, 500))))
    stored.change(third)
    stored.change(docs.where("doc_id % 5 = 0").withColumn("doc_id", -1 - F.col("doc_id")))
    stored.change(docs.where("doc_id % 3 <> 0"), gone=docs.where("doc_id % 5 = 0").select((-1 - F.col("doc_id")).alias("doc_id")))
    return stored


@_query(f"WITH {_bm25_sql(LEXICAL)} SELECT doc_id, round(score, 6) AS bm25 FROM b")
def stored_index_scores(spark, sf_dir):
    return _stored(spark, sf_dir).index().score(LEXICAL).select("doc_id", _r(F.col("bm25"), "bm25"))


@_query(f"WITH {_BM25_TABLES} SELECT term, df, cf, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df CROSS JOIN s")
def stored_index_terms(spark, sf_dir):
    return _stored(spark, sf_dir).index().terms.select("term", "df", "cf", _r(F.col("idf"), "idf"))


@_query(f"WITH {_bm25_sql(LEXICAL)} SELECT doc_id, bm25, row_number() OVER (ORDER BY bm25 DESC, doc_id)::INT AS rank FROM (SELECT doc_id, round(coalesce(score, 0), 6) AS bm25 FROM documents LEFT JOIN b USING (doc_id) ORDER BY bm25 DESC, doc_id LIMIT 10)")
def bm25_topk(spark, sf_dir):
    best = bm25.score_all(_docs(spark, sf_dir), LEXICAL).select("doc_id", _r(F.col("bm25"), "bm25")).orderBy(F.desc("bm25"), "doc_id").limit(10)
    return retrieve.with_rank(best, F.desc("bm25"), "doc_id")


@_query(f"WITH {_bm25_sql(LEXICAL)} SELECT doc_id, bm25, row_number() OVER (ORDER BY bm25 DESC, doc_id)::INT AS rank FROM (SELECT doc_id, round(coalesce(score, 0), 6) AS bm25 FROM documents LEFT JOIN b USING (doc_id) ORDER BY bm25 DESC, doc_id LIMIT 10)")
def bm25_topk_blocks(spark, sf_dir):
    """The same ten documents from a stored index, by bounds of blocks."""
    built = blocks.BlockedIndex.build(_docs(spark, sf_dir), f"{scratch_root(spark)}/blocks-{uuid.uuid4().hex}")
    return retrieve.with_rank(built.topk(LEXICAL, 10), F.desc("bm25"), "doc_id")


@_query(
    f"""WITH {_BM25_TABLES}, q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({X.bm25_tokens("text")}) AS term FROM benchmark) GROUP BY ALL),
b AS (SELECT query_id, doc_id, count(*) AS n_terms, round(sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25
  FROM p JOIN q USING (term) JOIN df USING (term) JOIN d USING (doc_id) CROSS JOIN s GROUP BY query_id, doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id)::INT AS rank, doc_id, bm25, n_terms FROM b QUALIFY rank <= 20"""
)
def benchmark_search(spark, sf_dir):
    """All passages of benchmark as searches over all documents, in one plan."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return bm25.Index.fit(_docs(spark, sf_dir)).search_many(asked, 20)


def _exact_sql(query: Query) -> str:
    ws = X.lst(sorted(set(query.content_words)))
    return f"least(CASE WHEN contains({X.strip('lower(text)')}, {X.q(query.phrase)}) THEN 0.6::DOUBLE ELSE 0 END + len(list_intersect({ws}, {X.words('text')}))::DOUBLE / len({ws}) * 0.4::DOUBLE, 1)"


@_query(f"SELECT doc_id, round({_exact_sql(LEXICAL)}, 6) AS exact FROM documents")
def exact_match(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _r(bm25.exact_match(F.col("text"), LEXICAL), "exact"))


# --- vectors -------------------------------------------------------------------------------


def _vector0(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "key")


_COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@_query(f"SELECT vec_id, round({_COSINE}, 6) AS similarity FROM embeddings e")
def vector_similarity(spark, sf_dir):
    q = F.array(*(F.lit(float(x)) for x in _vector0(spark, sf_dir)))
    return table(spark, sf_dir, "embeddings").select("vec_id", _r(scoring.cosine(F.col("embedding"), q), "similarity"))


@_query(f"SELECT vec_id, round({_COSINE}, 6) AS similarity FROM embeddings e ORDER BY {_COSINE} DESC, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    return retrieve.vector_topk(_vectors(spark, sf_dir), _vector0(spark, sf_dir), 20).select(F.col("key").alias("vec_id"), _r(F.col("embedding_similarity"), "similarity"))


@_query("SELECT conv_id, n, least(n * 4, 100) AS first, least(n * 3, 75) AS second, least(n * 2, 50) AS third FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def candidate_budgets(spark, sf_dir):
    """How many candidates a search for as many results as a conversation has turns takes."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return turns.select("conv_id", "n", *(F.least(F.col("n") * per, F.lit(most)).cast("long").alias(k) for k, (per, most) in zip(("first", "second", "third"), retrieve.BUDGETS.values(), strict=True)))


# --- similarity components -----------------------------------------------------------------

_OWN = X.forms_of(X.unstopped(X.words("text")))


@_query(f"SELECT doc_id, round({X.overlap('qf', 'own', 0.4, 0.6)}, 6) AS morphological FROM (SELECT doc_id, {_OWN} AS own, {X.forms_of(X.lst(MORPHOLOGICAL.content_words))} AS qf FROM documents)")
def morph_similarity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _r(scoring.morphological(F.col("text"), MORPHOLOGICAL), "morphological"))


def _concept_sql(src: str, key: str, col: str, query: Query) -> str:
    seeds = query.concepts or [w for w in query.content_words]
    return f"(SELECT {key}, {col}, CASE WHEN len(list_intersect(qf, own)) > 0 THEN {X.overlap('qf', 'own', 0.3, 0.7)} ELSE 0::DOUBLE END AS overlap FROM (SELECT {key}, {col}, {X.forms_of('c')} AS own, {X.forms_of(X.lst(seeds))} AS qf FROM (SELECT {key}, {col}, {X.concepts(col)} AS c FROM {src})))"


@_query(f"SELECT page_id, round(overlap, 6) AS overlap FROM {_concept_sql('pages', 'page_id', 'html', CODE)}")
def concept_overlap(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", _r(scoring.concept_overlap(F.col("html"), CODE), "overlap"))


def _keyword_tables(src: str, key: str, col: str) -> str:
    return f"""
kw AS (SELECT {key}, {X.topic_words(col)} AS ws FROM {src}),
kb AS (SELECT {key}, flatten(list_transform(ws, lambda w: list_sort({X.base('w')}))) AS base, list_sum(list_transform(ws, lambda w: len({X.base('w')}) + len({X.partials('w')}))) AS total FROM kw),
kf AS (SELECT {key}, keyword, count(*) AS freq, min(pos) AS pos, any_value(total) AS total FROM (SELECT {key}, unnest(base) AS keyword, generate_subscripts(base, 1) AS pos, total FROM kb) GROUP BY ALL),
k AS (SELECT {key}, keyword, pos, {X.weight('freq', 'total', 'keyword')} AS weight FROM (SELECT {key}, keyword, sum(freq)::BIGINT AS freq, min(pos) AS pos, any_value(total) AS total FROM kf GROUP BY {key}, keyword) WHERE NOT starts_with(keyword, 'prefix_') AND NOT starts_with(keyword, 'suffix_'))"""


@_query(f"WITH {_keyword_tables('documents', 'doc_id', 'text')} SELECT doc_id, keyword, round(weight, 6) AS weight FROM k")
def topic_keywords(spark, sf_dir):
    return scoring.topic_keywords(_docs(spark, sf_dir)).select("doc_id", "keyword", _r(F.col("weight"), "weight"))


def _keyword_sql(src: str, key: str, col: str, query: Query) -> str:
    values = ", ".join(f"({X.q(w)}, {weight!r}::DOUBLE, {X.lst(query.keyword_forms(w))})" for w, weight in query.keywords.items())
    n = len(query.keywords)
    keys = f"list_distinct(list_concat({X.base('k.keyword')}, {X.partials('k.keyword')}))"
    return f"""{_keyword_tables(src, key, col)},
qk(word, qw, fs) AS (VALUES {values}),
ex AS (SELECT k.{key}, word, 3 * least(qw, weight) AS gain FROM k JOIN qk ON keyword = word),
al AS (SELECT k.{key}, word, 2 * least(any_value(qw), arg_min(weight, pos)) AS gain FROM k JOIN qk ON list_has_any({keys}, fs) GROUP BY k.{key}, word),
rel AS (SELECT {key}, sum(gain) / {n} + count(*) * 0.2::DOUBLE / {n} AS relevance FROM (SELECT * FROM ex UNION ALL SELECT al.* FROM al ANTI JOIN ex USING ({key}, word)) GROUP BY {key})"""


@_query(f"WITH {_keyword_sql('pages', 'page_id', 'html', CODE)} SELECT page_id, round(coalesce(relevance, 0), 6) AS relevance FROM pages LEFT JOIN rel USING (page_id)")
def keyword_relevance(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", _r(scoring.keyword_relevance(F.col("html"), CODE), "relevance"))


@_query(f"WITH {_keyword_sql('pages', 'page_id', 'html', CODE)} SELECT page_id, round(least(overlap * 0.8::DOUBLE + coalesce(relevance, 0) * 0.2::DOUBLE, 1), 6) AS relevance FROM {_concept_sql('pages', 'page_id', 'html', CODE)} LEFT JOIN rel USING (page_id)")
def topic_relevance(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", _r(scoring.topic_relevance(F.col("html"), CODE), "relevance"))


@_query(f"SELECT doc_id, {X.clusters('text')} AS clusters FROM (SELECT doc_id, {X.forms_of(X.words('text'))} AS own_forms FROM documents)")
def topic_clusters(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", scoring.topic_clusters(F.col("text")).alias("clusters"))


def _distance_sql(query: Query, src: str = "documents") -> str:
    qc = X.lst(query.clusters)
    return f"(SELECT doc_id, CASE WHEN len({qc}) = 0 THEN 0.5::DOUBLE WHEN len(list_intersect({qc}, c)) = 0 THEN 0.1::DOUBLE ELSE len(list_intersect({qc}, c))::DOUBLE / len({qc}) END AS distance FROM (SELECT doc_id, {X.clusters('text')} AS c FROM (SELECT doc_id, {X.forms_of(X.words('text'))} AS own_forms FROM {src})))"


@_query(f"SELECT doc_id, round(distance, 6) AS distance FROM {_distance_sql(MORPHOLOGICAL)}")
def semantic_distance(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _r(scoring.semantic_distance(F.col("text"), MORPHOLOGICAL), "distance"))


_SCORED = f"""{_bm25_sql(LEXICAL)},
{_keyword_sql('documents', 'doc_id', 'text', LEXICAL).lstrip()},
parts AS (
  SELECT doc_id, coalesce({_COSINE}, 0) AS embedding, CASE WHEN score > 0 THEN least(score / 10, 1) ELSE 0 END AS bm25, coalesce(score, 0) AS raw,
    least(overlap * 0.8::DOUBLE + coalesce(relevance, 0) * 0.2::DOUBLE, 1) AS topic, distance, {X.overlap('qf', 'own', 0.4, 0.6)} AS morph, {_exact_sql(LEXICAL)} AS exact
  FROM documents LEFT JOIN embeddings e ON doc_id = vec_id LEFT JOIN b USING (doc_id) LEFT JOIN rel USING (doc_id)
  JOIN (SELECT doc_id, overlap FROM {_concept_sql('documents', 'doc_id', 'text', LEXICAL)}) USING (doc_id) JOIN {_distance_sql(LEXICAL)} USING (doc_id)
  JOIN (SELECT doc_id, {_OWN} AS own, {X.forms_of(X.lst(LEXICAL.content_words))} AS qf FROM documents) USING (doc_id)),
summed AS (SELECT *, embedding * 0.12::DOUBLE + bm25 * 0.18::DOUBLE + topic * 0.35::DOUBLE + distance * 0.2::DOUBLE + morph * 0.1::DOUBLE + exact * 0.05::DOUBLE AS total FROM parts),
final AS (SELECT *, least(total * CASE WHEN topic < 0.1 AND distance < 0.2 THEN 0.2::DOUBLE ELSE 1 END * CASE WHEN bm25 > 0.5 AND morph > 0.7 THEN 1.15::DOUBLE ELSE 1 END, 1) AS similarity FROM summed)"""


def _with_vectors(spark, sf_dir, query: Query) -> DataFrame:
    docs = _docs(spark, sf_dir)
    q = F.array(*(F.lit(float(x)) for x in _vector0(spark, sf_dir)))
    near = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), scoring.cosine(F.col("embedding"), q).alias("embedding_similarity"))
    lexical = bm25.score_all(docs, query).withColumnRenamed("bm25", "bm25_score")
    both = docs.select("doc_id", F.col("text").alias("content")).join(lexical, "doc_id").join(near, "doc_id", "left")
    return scoring.scored(both.withColumn("embedding_similarity", F.coalesce("embedding_similarity", F.lit(0.0))), query)


@_query(f"WITH {_SCORED} SELECT doc_id, round(bm25, 6) AS bm25, round(embedding, 6) AS embedding, round(topic, 6) AS topic_relevance, round(distance, 6) AS semantic_distance, round(morph, 6) AS morphological_match, round(exact, 6) AS exact_matches, round(similarity, 6) AS similarity FROM final")
def hybrid_rank(spark, sf_dir):
    b = "similarity_breakdown"
    return _with_vectors(spark, sf_dir, LEXICAL).select("doc_id", *(_r(F.col(f"{b}.{k}"), k) for k in scoring.COMPONENTS), _r(F.col("similarity"), "similarity"))


_CANDIDATES = f"""
near AS (SELECT vec_id AS doc_id, {_COSINE} AS sim FROM embeddings e WHERE vec_id IN (SELECT doc_id FROM documents)),
cand AS (SELECT doc_id, sim, strategy, rank FROM (SELECT doc_id, sim, row_number() OVER (ORDER BY sim DESC, doc_id) AS rank FROM near), (VALUES (1, 20), (3, 10)) s(strategy, most) WHERE rank <= most),
best AS (SELECT doc_id, max(sim) AS sim, min((strategy, rank)) AS position FROM cand GROUP BY doc_id)"""


@_query(f"WITH {_CANDIDATES} SELECT strategy, rank::INT AS rank, doc_id, round(sim, 6) AS similarity FROM cand")
def strategy_union(spark, sf_dir):
    v = _vector0(spark, sf_dir)
    vectors = _vectors(spark, sf_dir).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("key")), "key", "left_semi")
    found = retrieve.candidates(vectors, {1: v, 2: None, 3: v}, N)
    return found.select("strategy", "rank", F.col("key").alias("doc_id"), _r(F.col("embedding_similarity"), "similarity"))


@_query(f"WITH {_CANDIDATES} SELECT doc_id, round(sim, 6) AS similarity, position[1]::INT AS strategy, position[2]::INT AS rank FROM best")
def best_by_path(spark, sf_dir):
    v = _vector0(spark, sf_dir)
    vectors = _vectors(spark, sf_dir).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("key")), "key", "left_semi")
    found = retrieve.best_by_key(retrieve.candidates(vectors, {1: v, 3: v}, N))
    return found.select(F.col("key").alias("doc_id"), _r(F.col("embedding_similarity"), "similarity"), "position.strategy", "position.rank")


def _hybrid(spark, sf_dir) -> DataFrame:
    v = _vector0(spark, sf_dir)
    docs = _docs(spark, sf_dir)
    contents = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    vectors = _vectors(spark, sf_dir).join(contents.select("key"), "key", "left_semi")
    scores = bm25.score_all(docs, LEXICAL).select(F.col("doc_id").alias("key"), F.col("bm25").alias("bm25_score"))
    return retrieve.with_rank(retrieve.hybrid(vectors, contents, scores, {1: v, 2: None, 3: v}, LEXICAL, N, THRESHOLD), F.desc("similarity"), "position", "key")


_TOP = f"top AS (SELECT doc_id, final.similarity, raw, embedding, bm25, topic, distance, morph, exact, row_number() OVER (ORDER BY similarity DESC, position, doc_id) AS rank FROM final JOIN best USING (doc_id) WHERE similarity >= {THRESHOLD}::DOUBLE QUALIFY rank <= {N})"


@_query(f"WITH {_SCORED}, {_CANDIDATES.lstrip()}, {_TOP} SELECT rank::INT AS rank, doc_id, round(similarity, 6) AS similarity, round(raw, 6) AS bm25_score FROM top")
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("rank", F.col("key").alias("doc_id"), _r(F.col("similarity"), "similarity"), _r(F.col("bm25_score"), "bm25_score"))


@_query(f"WITH {_SCORED}, {_CANDIDATES.lstrip()}, {_TOP} SELECT rank::INT AS rank, printf('%d. %s (sim %.3f)', rank, doc_id::VARCHAR, round(similarity, 6)) AS line, printf('   BM25: %.3f', round(raw, 6)) AS score_line FROM top")
def report_lines(spark, sf_dir):
    rows = _hybrid(spark, sf_dir)
    return rows.select("rank", report.result_line(F.col("rank"), F.col("key").cast("string"), F.round("similarity", 6)).alias("line"), report.bm25_line(F.round("bm25_score", 6)).alias("score_line"))


# --- places --------------------------------------------------------------------------------

_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


@_query(f"WITH {_LINES} SELECT doc_id, line::INT AS line, l AS content_line FROM ln")
def line_explode(spark, sf_dir):
    return locate.lines(_docs(spark, sf_dir))


@_query(f"WITH {_LINES} SELECT doc_id, line::INT AS line, position('of the' IN lower(l))::INT AS \"column\" FROM ln WHERE position('of the' IN lower(l)) > 0")
def phrase_matches(spark, sf_dir):
    return locate.phrase_matches(_docs(spark, sf_dir), PHRASE)


def _match_sql(query: Query) -> str:
    wanted = ", ".join(f"({i}, {X.lst(query._all(w))})" for i, w in enumerate(query.content_words) if len(w) > 2)
    return f"""{_LINES},
seg AS (SELECT doc_id, line, l, regexp_extract_all(lower(l), '{X.W}+|[^{X.W[1:-1]}]+') AS parts FROM ln),
ph AS (SELECT doc_id, line, 0 AS qi, 0 AS wi, position({X.q(query.lowered)} IN lower(l)) AS col, 'phrase' AS kind FROM ln WHERE position({X.q(query.lowered)} IN lower(l)) > 0),
wd AS (SELECT doc_id, line, w, i, sum(length(w)) OVER (PARTITION BY doc_id, line ORDER BY i) - length(w) + 1 AS col FROM (SELECT doc_id, line, unnest(parts) AS w, generate_subscripts(parts, 1) AS i FROM seg)),
lw AS (SELECT doc_id, line, w, i, col, list_concat({X.base('w')}, {X.partials('w')}) AS fs FROM wd WHERE regexp_full_match(w, '{X.W}+') AND (doc_id, line) NOT IN (SELECT (doc_id, line) FROM ph)),
qw(qi, qf) AS (VALUES {wanted}),
mo AS (SELECT a.doc_id, a.line, qi, a.i AS wi, b.col, 'morphological' AS kind FROM lw a JOIN qw ON list_has_any(a.fs, qf) JOIN lw b ON a.doc_id = b.doc_id AND a.line = b.line AND a.w = b.w),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, qi, wi, col) AS nth FROM (SELECT * FROM ph UNION ALL SELECT * FROM mo) QUALIFY nth <= 10)"""


@_query(f"WITH {_match_sql(MORPHOLOGICAL)} SELECT doc_id, nth::INT AS nth, line::INT AS line, col::INT AS \"column\", kind AS match_type FROM m")
def morph_matches(spark, sf_dir):
    return locate.match_rows(_docs(spark, sf_dir), MORPHOLOGICAL)


@_query(f"WITH {_match_sql(Query('of the ention'))} SELECT doc_id, nth::INT AS nth, line::INT AS line, col::INT AS \"column\", kind AS match_type FROM m")
def mixed_matches(spark, sf_dir):
    return locate.match_rows(_docs(spark, sf_dir), Query("of the ention"))


@_query(f"WITH {_match_sql(MORPHOLOGICAL)} SELECT doc_id, kind AS match_type, count(*) AS n, min(nth)::INT AS first, string_agg('line ' || line || ', col ' || col::BIGINT, ', ' ORDER BY nth) AS locations FROM m GROUP BY doc_id, kind")
def match_summary(spark, sf_dir):
    return locate.match_summary(_docs(spark, sf_dir), MORPHOLOGICAL)


@_query(f"WITH {_match_sql(MORPHOLOGICAL)}, n AS (SELECT doc_id, count(*) AS k FROM m GROUP BY doc_id) SELECT doc_id, coalesce(k, 0)::INT AS total_matches, length(text)::INT AS file_size FROM documents LEFT JOIN n USING (doc_id)")
def match_display(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", locate.display(F.col("text"), MORPHOLOGICAL).alias("d"))
    return d.select("doc_id", "d.total_matches", "d.file_size")


# --- synchronisation -----------------------------------------------------------------------


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two states of one corpus: each source stands for a path's folder; sizes differ for texts with an even number of characters in odd folders."""
    d = _docs(spark, sf_dir)
    path = F.concat_ws("/", F.lit("/corpus"), F.col("source"), F.col("doc_id").cast("string"))
    db = d.where("lang <> 'de'").select(path.alias("path"), F.col("n_chars").alias("size"))
    fs = d.where("lang <> 'fr'").select(path.alias("path"), (F.col("n_chars") + F.when(F.col("lang") == "es", F.col("n_chars") % 2).otherwise(0)).alias("size"))
    return db, fs


_STATES = """
db AS (SELECT '/corpus/' || source || '/' || doc_id AS path, n_chars AS size FROM documents WHERE lang <> 'de'),
fs AS (SELECT '/corpus/' || source || '/' || doc_id AS path, n_chars + CASE WHEN lang = 'es' THEN n_chars % 2 ELSE 0 END AS size FROM documents WHERE lang <> 'fr')"""


@_query(f"WITH {_STATES} SELECT path, CASE WHEN db.path IS NULL THEN 'insert' WHEN fs.path IS NULL THEN 'delete' WHEN db.size <> fs.size THEN 'update' ELSE 'keep' END AS action FROM db FULL JOIN fs USING (path)")
def sync_plan(spark, sf_dir):
    return corpus.sync_plan(*_states(spark, sf_dir))


@_query(f"WITH {_STATES} SELECT path FROM fs EXCEPT SELECT path FROM db")
def new_files(spark, sf_dir):
    return corpus.new_paths(*_states(spark, sf_dir))


@_query(f"WITH {_STATES} SELECT path FROM db EXCEPT SELECT path FROM fs")
def removed_files(spark, sf_dir):
    return corpus.removed_paths(*_states(spark, sf_dir))


@_query(f"WITH {_STATES} SELECT path FROM db INTERSECT SELECT path FROM fs")
def kept_files(spark, sf_dir):
    return corpus.kept_paths(*_states(spark, sf_dir))


@_query(f"WITH {_STATES} SELECT DISTINCT fs.path FROM fs LEFT JOIN db USING (path) WHERE db.path IS NULL OR db.size <> fs.size")
def changed_files(spark, sf_dir):
    return corpus.changed_paths(*_states(spark, sf_dir))


@_query(f"WITH {_STATES} SELECT db.path, db.size FROM db ANTI JOIN (SELECT path FROM fs) USING (path)")
def delete_by_key(spark, sf_dir):
    db, fs = _states(spark, sf_dir)
    return db.join(fs.select("path"), "path", "left_anti")


@_query("SELECT DISTINCT doc_id, source FROM documents")
def collection_scan(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "source").distinct()


_FORM_TEXT = "array_to_string(list_concat(list_filter(tk, lambda t: length(t) > 1), flatten(list_transform(list_filter({stop}, lambda t: length(t) > 2), lambda t: list_sort({base})))), ' ')".format(stop=X.unstopped("tk"), base=X.base("t"))
_EMBED = "(SELECT doc_id, {cl} AS cleaned, list_filter(regexp_split_to_array(lower({un}), '{s}+'), lambda w: w <> '') AS tk FROM documents)".format(cl=X.strip(X.unify("text")), un=X.unify(X.verbalize(X.separate(X.strip(X.unify("text"))))), s=X.S)


@_query(f"SELECT doc_id, md5({_FORM_TEXT}) AS embedded FROM {_EMBED}")
def embedding_text(spark, sf_dir):
    docs = corpus.with_embedding_text(_docs(spark, sf_dir).withColumn("cleaned", text.clean(F.col("text"))), "cleaned", "embedded")
    return docs.select("doc_id", F.md5(F.col("embedded").cast("binary")).alias("embedded"))


@_query(f"SELECT doc_id, md5(cleaned || ' ' || embedded || CASE WHEN len(c) > 0 THEN ' ' || array_to_string(list_sort(list_distinct(list_concat(c, {X.forms_of('c')}))), ' ') ELSE '' END) AS represented FROM (SELECT *, {X.concepts('embedded')} AS c FROM (SELECT doc_id, cleaned, {_FORM_TEXT} AS embedded FROM {_EMBED}))")
def document_representation(spark, sf_dir):
    docs = corpus.with_representation(_docs(spark, sf_dir), "text", "represented")
    return docs.select("doc_id", F.md5(F.col("represented").cast("binary")).alias("represented"))


_PLAIN = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\p{Z}\\t-\\r\\x{1c}-\\x{1f}\\x{85}]', ' ', 'g'), '" + X.S + "+'), lambda w: w <> '')"
_ALL_FORMS = f"list_sort(list_distinct(list_concat({X.base('t')}, {X.partials('t')})))"


@_query(f"SELECT doc_id, md5(array_to_string(list_concat(list_filter(regexp_split_to_array(lower(text), '{X.S}+'), lambda w: length(w) > 1), flatten(list_transform(list_filter({X.unstopped(_PLAIN)}, lambda t: length(t) > 2), lambda t: {_ALL_FORMS}))), ' ')) AS searched FROM documents")
def search_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(corpus.search_text(F.col("text")).cast("binary")).alias("searched"))


@_query(f"WITH {_SCORED}, {_CANDIDATES.lstrip()}, {_TOP} SELECT rank::INT AS rank, to_json({{'doc_id': doc_id, 'similarity': round(similarity, 3), 'bm25_score': round(raw, 3)}})::VARCHAR AS j FROM top")
def result_json(spark, sf_dir):
    rows = _hybrid(spark, sf_dir).select("rank", F.col("key").alias("doc_id"), F.round("similarity", 3).alias("similarity"), F.round("bm25_score", 3).alias("bm25_score"))
    return rows.select("rank", report.result_json("doc_id", "similarity", "bm25_score").alias("j"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
