"""Components of similarity between a query and documents, and their sum.

All are columns over one document, so scoring a table moves no rows. A query is a driver object; its
forms and weights become literals of the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import forms, text
from lodestone.functions.forms import let, literal
from lodestone.functions.query import Query
from lodestone.functions.vocab import BOOSTED, CONCEPTS, WEIGHTS

from .bm25 import exact_match, squash

COMPONENTS = list(WEIGHTS)


def cosine(a: Column, b: Column) -> Column:
    """1 less the cosine distance, in doubles; null for vectors of length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def _overlap(mine: list[str], theirs: Column, jaccard: float, coverage: float) -> Column:
    """Of the sets mine and theirs: the share of the union and of mine that both have, weighted."""
    n = float(len(mine))

    def of(own: Column) -> Column:
        both = F.size(F.array_intersect(own, literal(mine))).cast("double")
        return let(both, lambda b: b / (n + F.size(own) - b) * jaccard + b / n * coverage)

    return let(theirs, of)


def morphological(content: Column, query: Query, stems: Column | None = None) -> Column:
    """Overlap of the forms of the words that aren't stop words."""
    if not query.forms:
        return F.lit(0.0)
    words = text.without_stops(text.words(content))
    return _overlap(query.forms, forms.forms_of(words, stems), 0.4, 0.6)


def concepts(content: Column, stems: Column | None = None) -> Column:
    """Distinct concept words of a text: identifiers with a form in the vocabulary, those forms, and pattern words."""
    if stems is None:  # then the words that can have a form in the vocabulary are known; all are identifiers
        words = F.array_distinct(F.filter(F.split(F.lower(content), text.NOT_WORD), lambda w: w.isin(*forms.with_partners(CONCEPTS))))
    else:
        words = F.array_distinct(text.identifiers(content))

    def of(word: Column) -> Column:
        hits = lambda h: F.when(F.size(h) > 0, F.concat(F.array(word), h)).otherwise(F.array().cast("array<string>"))
        return let(F.filter(forms.base_forms_of(F.array(word), stems), lambda f: f.isin(*CONCEPTS)), hits)

    return F.array_distinct(F.concat(F.flatten(F.transform(words, of)), text.pattern_words(content)))


def concept_overlap(content: Column, query: Query, stems: Column | None = None) -> Column:
    if not query.concept_forms:
        return F.lit(0.0)
    # With nothing in common, both terms are 0.
    return _overlap(query.concept_forms, forms.forms_of(concepts(content, stems), stems), 0.3, 0.7)


def _keyword_lists(content: Column, stems: Column | None = None) -> Column:
    """struct(base, total): the base forms of a text's keywords, with repeats and in order, and how many forms of all kinds there are."""

    def of(words: Column) -> Column:
        base = F.flatten(F.transform(words, lambda w: forms.sorted_base_forms_of(w, stems)))
        partial = F.aggregate(words, F.lit(0), lambda s, w: s + F.when(F.length(w) > 4, 2 * (F.length(w) - 3)).otherwise(0))
        return let(base, lambda b: F.struct(b.alias("base"), (F.size(b) + partial).cast("double").alias("total")))

    return let(text.topic_words(content), of)


def _weight(freq: Column, total: Column, word: Column) -> Column:
    boost = F.when(F.array_contains(literal(BOOSTED), word), 3.0).otherwise(1.0)
    return freq / total * boost * F.when(freq > total * 0.1, 0.5).otherwise(1.0)


def keyword_relevance(content: Column, query: Query, stems: Column | None = None) -> Column:
    """Shared keywords by the lesser weight: threefold for the same form, twofold for the first alike.

    First is the earliest in the text; of the forms of one word, the least.
    """
    if not query.keywords:
        return F.lit(0.0)
    wanted = sorted({f for w in query.keywords for f in query.keyword_forms(w)})

    def of(k: Column) -> Column:
        # Only what is alike to some keyword counts, and of that there is little.
        return let(F.filter(k["base"], lambda f: forms.alike(f, wanted, stems)), lambda base: told(base, k["total"]))

    def told(base: Column, total: Column) -> Column:
        def count(word: Column) -> Column:
            return F.size(F.filter(base, lambda f: f == word)).cast("double")

        def gain(word: str, weight: float) -> Column:
            own = query.keyword_forms(word)
            alike = F.filter(F.array_distinct(base), lambda f: forms.alike(f, own, stems))
            first = lambda f: F.when(f.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.lit(weight), _weight(count(f), total, f)) * 2.0)
            morphological = let(F.get(alike, F.lit(0)), first)
            return let(count(F.lit(word)), lambda n: F.when(n > 0, F.least(F.lit(weight), _weight(n, total, F.lit(word))) * 3.0).otherwise(morphological))

        gains = F.array(*(gain(w, x) for w, x in query.keywords.items()))
        number = float(len(query.keywords))
        summed = lambda g: F.aggregate(g, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))) / number + F.size(F.filter(g, lambda v: v.isNotNull())) / number * 0.2
        return F.when(F.size(base) > 0, let(gains, summed)).otherwise(0.0)

    return let(_keyword_lists(content, stems), of)


def topic_relevance(content: Column, query: Query, stems: Column | None = None) -> Column:
    return F.least(concept_overlap(content, query, stems) * 0.8 + keyword_relevance(content, query, stems) * 0.2, F.lit(1.0))


def topic_clusters(content: Column, stems: Column | None = None) -> Column:
    """The clusters with a keyword that some word is alike to, by match keys."""
    keys = forms.keys_of(F.array_distinct(text.words(content)), stems)
    clusters = forms.cluster_forms(stems is not None)
    hit = lambda own: F.array(*(F.when(F.arrays_overlap(own, literal(f)), F.lit(name)) for name, f in clusters.items()))
    return F.filter(let(keys, hit), lambda c: c.isNotNull())


def semantic_distance(content: Column, query: Query, stems: Column | None = None) -> Column:
    """The share of the query's clusters that the text has; 0.1 for none, 0.5 where the query has none."""
    if not query.clusters:
        return F.lit(0.5)
    shared = F.size(F.array_intersect(topic_clusters(content, stems), literal(query.clusters))) / F.lit(float(len(query.clusters)))
    return let(shared, lambda s: F.when(s > 0, s).otherwise(0.1))


def breakdown(content: Column, embedding: Column, bm25: Column, query: Query, stems: Column | None = None) -> Column:
    """struct of the components, without the sum."""
    none = query.blank
    blank = F.lit(True) if none else F.coalesce(text.strip(content) == "", F.lit(True))
    part = lambda c: F.when(blank, 0.0).otherwise(c)
    return F.struct(
        embedding.alias("embedding"),
        F.when(blank, bm25).otherwise(squash(bm25)).alias("bm25"),
        part(topic_relevance(content, query, stems)).alias("topic_relevance"),
        part(semantic_distance(content, query, stems)).alias("semantic_distance"),
        part(morphological(content, query, stems)).alias("morphological_match"),
        part(exact_match(content, query)).alias("exact_matches"),
        blank.alias("blank"),
    )


def final_score(parts: Column) -> Column:
    """The weighted sum; a fifth of it where topics don't match, 1.15 times it where words do, at most 1."""
    total = reduce(lambda a, b: a + b, (parts[k] * w for k, w in WEIGHTS.items()))
    total = F.when((parts["topic_relevance"] < 0.1) & (parts["semantic_distance"] < 0.2), total * 0.2).otherwise(total)
    total = F.when((parts["bm25"] > 0.5) & (parts["morphological_match"] > 0.7), total * 1.15).otherwise(total)
    return F.when(parts["blank"], 0.0).otherwise(F.least(total, F.lit(1.0)))


def scored(df: DataFrame, query: Query) -> DataFrame:
    """df (content, embedding_similarity, bm25_score, ...) with its components and similarity."""
    stems = F.col("_stems") if query.stems else None
    if query.stems:
        df = df.withColumn("_stems", forms.stem_map(F.array_distinct(text.words(F.col("content")))))
    told = df.withColumn("similarity_breakdown", breakdown(F.col("content"), F.col("embedding_similarity"), F.col("bm25_score"), query, stems)).drop("_stems")
    told = told.withColumn("similarity", final_score(F.col("similarity_breakdown")))
    parts = [F.col(f"similarity_breakdown.{k}").alias(k) for k in COMPONENTS]
    return told.withColumn("similarity_breakdown", F.struct(*parts, F.col("similarity").alias("final_score")))


def topic_keywords(docs: DataFrame) -> DataFrame:
    """(doc_id, keyword, weight) of every document (doc_id, text), without stems."""
    rows = docs.select("doc_id", _keyword_lists(F.col("text")).alias("k")).select("doc_id", "k.total", F.explode("k.base").alias("keyword"))
    counted = rows.groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).cast("double").alias("freq"), F.max("total").alias("total"))
    counted = counted.where("not startswith(keyword, 'prefix_') and not startswith(keyword, 'suffix_')")
    return counted.select("doc_id", "keyword", _weight(F.col("freq"), F.col("total"), F.col("keyword")).alias("weight"))
