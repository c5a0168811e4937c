"""Where a query occurs in a document: lines and columns, from 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import forms, text
from lodestone.functions.forms import literal
from lodestone.functions.query import Query

MOST = 10
MATCH = "array<struct<line:int,column:int,match_type:string>>"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, content_line), lines from 1; an empty text is one empty line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content_line")).withColumn("line", F.col("line") + 1)


def _occurrences(line: Column, word: Column) -> Column:
    """The columns where word stands as a whole word in a lower-cased line; the first MOST."""
    # The word first, as it is found faster than what is not before it.
    parts = F.split(line, F.concat(word, F.lit(f"(?<!{text.WORD}"), word, F.lit(f")(?!{text.WORD})")), -1)

    def columns(parts: Column) -> Column:
        count = F.least(F.size(parts) - 1, F.lit(MOST))

        def column(k: Column) -> Column:
            before = F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda s, p: s + F.length(p))
            return before + (k - 1) * F.length(word) + 1

        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), column)).otherwise(F.array().cast("array<int>"))

    return forms.let(parts, columns)


def _plain(query: Query) -> bool:
    return not any(w.startswith(("prefix_", "suffix_")) for w in query.content_words)


def _alike(words: Column, query: Query, word: str, stems: Column | None) -> Column:
    """Those of a list of words that are alike to a word of the query."""
    own = query._all(word)
    if not _plain(query):
        return F.filter(words, lambda x: F.arrays_overlap(forms.forms_of(F.array(x), stems), literal(own)))
    return F.filter(words, lambda x: forms.alike(x, own, stems))


def _may_have(low: Column, query: Query, wanted: list[str], stems: Column | None) -> Column:
    """Whether a lower-cased text may have a word that is alike to one of wanted: it has one of the strings that such words have."""
    if not wanted:
        return F.lit(False)
    if stems is not None or not _plain(query):
        return F.lit(True)
    own = sorted({f for w in wanted for f in query._all(w)})
    whole = forms.with_partners(f for f in own if not f.startswith(("prefix_", "suffix_")))
    ends = {f[7:] for f in own if f.startswith(("prefix_", "suffix_")) and len(f) == 10}
    some = sorted(ends) + [w for w in whole if not any(e in w for e in ends)]
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in some))


def _line_matches(low: Column, number: Column, query: Query, wanted: list[str], stems: Column | None) -> Column:
    """A phrase match in a lower-cased line, or else one for each place of each word that is alike to one of wanted."""
    place = F.instr(low, F.lit(query.lowered))
    phrase = F.array(F.struct(number.alias("line"), place.alias("column"), F.lit("phrase").alias("match_type")))

    def of(words: Column) -> Column:
        return F.concat(*(F.flatten(F.transform(F.slice(_alike(words, query, w, stems), 1, MOST), lambda x: _occurrences(low, x))) for w in wanted))

    words = text.words(low)
    if wanted and _plain(query):  # one look at all words, and one for each of wanted at those few
        every = sorted({f for w in wanted for f in query._all(w)})
        words = F.filter(words, lambda x: forms.alike(x, every, stems))
    found = forms.let(words, of) if wanted else F.array().cast("array<int>")
    morphological = F.transform(F.slice(found, 1, MOST), lambda c: F.struct(number.alias("line"), c.alias("column"), F.lit("morphological").alias("match_type")))
    return F.when(place > 0, phrase.cast(MATCH)).when(_may_have(low, query, wanted, stems), morphological.cast(MATCH)).otherwise(F.array().cast(MATCH))


def matches(content: Column, query: Query, stems: Column | None = None) -> Column:
    """The first MOST matches in order of line, query word, line word and place. No rows move.

    Lines after the last match wanted aren't looked at, nor are words of lines that can have none.
    """
    if not query.text:
        return F.array().cast(MATCH)
    wanted = [w for w in query.content_words if len(w) > 2]
    nothing = F.array().cast(MATCH)

    def scan(low: Column) -> Column:
        numbered = F.transform(F.split(low, "\n"), lambda line, i: F.struct(line.alias("line"), (i + 1).alias("number")))
        more = lambda got, l: F.when(F.size(got) >= MOST, got).otherwise(F.concat(got, _line_matches(l["line"], l["number"], query, wanted, stems)))
        whole = F.slice(F.aggregate(numbered, nothing, more), 1, MOST)
        some = _may_have(low, query, wanted, stems) | F.contains(low, F.lit(query.lowered))
        return F.when(low.isNull(), F.lit(None).cast(MATCH)).when(some, whole).otherwise(nothing)

    return forms.let(F.lower(content), scan)


def display(content: Column, query: Query, stems: Column | None = None) -> Column:
    """struct(matches, total_matches, file_size): size in characters."""
    found = matches(content, query, stems)
    return F.struct(found.alias("matches"), F.size(found).alias("total_matches"), F.length(content).alias("file_size"))


def phrase_matches(docs: DataFrame, query: Query) -> DataFrame:
    """(doc_id, line, column) of each line's first occurrence of the whole query."""
    low = lines(docs).withColumn("column", F.instr(F.lower("content_line"), F.lit(query.lowered)))
    return low.where("column > 0").select("doc_id", "line", "column")


def match_rows(docs: DataFrame, query: Query) -> DataFrame:
    """(doc_id, nth, line, column, match_type), a row for each match of docs (doc_id, text)."""
    rows = docs.select("doc_id", F.posexplode(matches(F.col("text"), query)).alias("nth", "m"))
    return rows.select("doc_id", (F.col("nth") + 1).alias("nth"), "m.line", "m.column", "m.match_type")


def match_summary(docs: DataFrame, query: Query) -> DataFrame:
    """(doc_id, match_type, n, locations) by type; order is that of a type's first match."""
    rows = match_rows(docs, query)
    place = F.format_string("line %d, col %d", F.col("line"), F.col("column"))
    found = rows.groupBy("doc_id", "match_type").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"), F.array_sort(F.collect_list(F.struct("nth", place.alias("at")))).alias("all"))
    return found.select("doc_id", "match_type", "n", "first", F.array_join(F.transform("all", lambda x: x["at"]), ", ").alias("locations"))
