"""Results as text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RULE, DASH, WIDE = "=" * 60, "-" * 60, "=" * 80


def result_line(rank: Column, path: Column, similarity: Column) -> Column:
    return F.format_string("%d. %s (sim %.3f)", rank, path, similarity)


def bm25_line(score: Column) -> Column:
    return F.format_string("   BM25: %.3f", score)


def breakdown_line(b: Column) -> Column:
    return F.format_string(
        "   BM25: %.3f, Topic Relevance: %.3f, Semantic Distance: %.3f, Morphological: %.3f", b["bm25"], b["topic_relevance"], b["semantic_distance"], b["morphological_match"]
    )


def match_lines(matches: Column) -> Column:
    """A line for each type of match, in the order in which they first come."""
    kinds = F.array_distinct(F.transform(matches, lambda m: m["match_type"]))

    def line(kind: Column) -> Column:
        at = F.transform(F.filter(matches, lambda m: m["match_type"] == kind), lambda m: F.format_string("line %d, col %d", m["line"], m["column"]))
        return F.concat(F.initcap(kind), F.lit(" matches: "), F.array_join(at, ", "))

    return F.array_join(F.transform(kinds, line), "\n")


def merged_section(rank: Column, path: Column, similarity: Column, b: Column, bm25: Column, document: Column) -> Column:
    """One document's part of the merged report."""
    parts = F.format_string(
        "  BM25: %.3f, Topic Relevance: %.3f, Semantic Distance: %.3f, Morphological: %.3f, Embedding: %.3f",
        b["bm25"], b["topic_relevance"], b["semantic_distance"], b["morphological_match"], b["embedding"],
    )
    lines = [
        F.lit("\n" + RULE),
        F.format_string("DOC %d: %s (sim %.3f)", rank, path, similarity),
        parts,
        F.format_string("  Raw BM25 Score: %.3f", bm25),
        F.lit(DASH),
        F.format_string("Total matches: %d", document["total_matches"]),
        F.format_string("File size: %d characters", document["file_size"]),
        F.lit(""),
    ]
    found = F.when(F.size(document["matches"]) > 0, match_lines(document["matches"]))
    return F.concat_ws("\n", *lines, found, F.lit(""))


def sections(results: DataFrame) -> DataFrame:
    """results (rank, file_path, similarity, similarity_breakdown, bm25_score, document) with line, score_line and section."""
    cols = [F.col(c) for c in ("rank", "file_path", "similarity", "similarity_breakdown", "bm25_score", "document")]
    rank, path, similarity, b, bm25, document = cols
    return results.withColumns({"line": result_line(rank, path, similarity), "score_line": bm25_line(bm25), "section": merged_section(*cols)})


def text_report(results: DataFrame) -> str:
    """The list, then the merged report. results are what a search returned, so few."""
    rows = sections(results).orderBy("rank").select("line", "score_line", "section").collect()
    out = [f"Found {len(rows)} documents"]
    for r in rows:
        out += [r.line, r.score_line]
    if rows:
        out += ["\n" + WIDE, "MERGED RESULT", WIDE, "\n".join(r.section for r in rows)]
    return "\n".join(out) + "\n"


def command_report(results: DataFrame) -> str:
    """What the command line shows: the list with each result's parts, then the merged report."""
    b = F.col("similarity_breakdown")
    told = sections(results).withColumns({"parts": breakdown_line(b), "raw": F.format_string("   Raw BM25 Score: %.3f", "bm25_score")})
    rows = told.orderBy("rank").select("line", "parts", "raw", "section").collect()
    out = [f"Found {len(rows)} documents"]
    for r in rows:
        out += [r.line, r.parts, r.raw]
    if rows:
        out += ["\n" + WIDE, "MERGED RESULT", WIDE, "\n".join(r.section for r in rows)]
    return "\n".join(out) + "\n"


def merged_report(results: DataFrame) -> str:
    return "\n".join(r.section for r in sections(results).orderBy("rank").select("section").collect())


def result_json(*names: str) -> Column:
    """A result as a JSON object."""
    return F.to_json(F.struct(*names))


def json_report(results: DataFrame) -> str:
    """{"results": [...]}, in order."""
    rows = results.orderBy("rank").select(result_json("document", "metadata", "embedding_similarity", "original_query", "similarity", "similarity_breakdown", "bm25_score").alias("j")).collect()
    return '{"results": [' + ", ".join(r.j for r in rows) + "]}"
