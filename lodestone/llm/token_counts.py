"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A text is cut wherever no piece can go across; what lies between are its pre-tokens. The forward score
of a position (the weight of the best segmentation up to there, and its number of pieces) depends on
nothing after it. So the distinct pre-tokens of a batch go into one trie, whose nodes hold forward scores:
each is computed once for all pre-tokens that begin alike, a depth at a time, and the node where a pre-token ends
holds its count. Documents add up the counts of their pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.session import table

from .lattice import MODEL, Pieces, byte_sizes, pieces, utf8_size
from .units import Trie, chunks, coded, raw_bytes, split
from .workers import tidy

CHUNK = 8_000_000


def terminal_counts(units: pa.Array, of: Pieces) -> np.ndarray:
    """The number of pieces in the best segmentation of each unit; of equally good ones, the fewest."""
    trie = Trie(units)
    score, count = np.zeros(len(trie.parent)), np.zeros(len(trie.parent), np.int64)
    for nodes, options in trie.levels(of.table):
        for size, found, back in options:
            here = found >= 0
            if size == 1:
                raw = utf8_size(trie.point[nodes])
                best = score[back] + np.where(here, of.logs[found], raw * of.byte_log)
                least = count[back] + np.where(here, 1, raw)
                continue
            hit = np.flatnonzero(here)
            s, n = score[back[hit]] + of.logs[found[hit]], count[back[hit]] + 1
            better = (s > best[hit]) | ((s == best[hit]) & (n < least[hit]))
            best[hit[better]], least[hit[better]] = s[better], n[better]
        score[nodes], count[nodes] = best, least
    for nodes, ids in trie.chains(of.table):
        _chain(of, trie.point[nodes], ids, nodes, score, count)
    return count[trie.end]


def _chain(of: Pieces, points: np.ndarray, ids: np.ndarray, nodes: slice, score: np.ndarray, count: np.ndarray) -> None:
    """The same for one long unit, a character at a time."""
    scores, counts = [0.0], [0]
    for i, (point, row) in enumerate(zip(utf8_size(points).tolist(), ids.tolist(), strict=True)):
        best, least = (scores[i] + float(of.logs[row[0]]), counts[i] + 1) if row[0] >= 0 else (scores[i] + point * of.byte_log, counts[i] + point)
        for n in range(1, min(i + 1, len(row))):
            if row[n] >= 0:
                s, k = scores[i - n] + float(of.logs[row[n]]), counts[i - n] + 1
                if s > best or (s == best and k < least):
                    best, least = s, k
        scores.append(best)
        counts.append(least)
    score[nodes], count[nodes] = scores[1:], counts[1:]


def count_batch(texts: pa.Array, of: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(pre-tokens, tokens) of each text; texts are strings without null."""
    data, at = raw_bytes(pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type)))
    begins, sizes = split(data, at, of.joined)
    codes, distinct = coded(data, begins)
    run = np.concatenate([[0], np.cumsum(terminal_counts(distinct, of)[codes])])
    return sizes, np.diff(run[np.concatenate([[0], np.cumsum(sizes)])])


def _counter(model: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pieces(model)
        for batch in batches:
            every = batch.column("text").fill_null("")
            for a, b in chunks(byte_sizes(every), CHUNK):
                found = count_batch(every.slice(a, b - a), of)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, found)], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row of docs (doc_id, text, ...).

    n_tokens is the number of pieces of the text's best segmentation; of equally good ones, the
    fewest. Pre-tokens are what no piece goes across: words with the space before them, marks and line ends mostly.
    Null text counts as empty, which is one pre-token, the start's space. Rows that repeat count alike; null ids
    stay null. An empty table gives no rows. model is a path, or a file name of the public tokenizers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_counter(model), f"doc_id {kind}, n_pretokens long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
