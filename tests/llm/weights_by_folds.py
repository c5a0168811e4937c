"""Compares weightings of op9_toxicity on the rows it may learn from, and on no others: python -m tests.llm.weights_by_folds [folder]

Rows whose crc32(doc_id) mod 5 is 0 are left out before anything is looked at. The others are dealt into four folds, each of
which is scored by what is learned from the other three. LEAST_WEIGHT 1 is plain TF-IDF.
"""

from __future__ import annotations

import sys
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lodestone.llm import toxicity as T

FOLDS = 4


def training_rows(folder: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(fold, label, text), a row for each distinct text; copies are in one fold."""
    labels = pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict()
    known = {i: y for i, y in zip(labels["doc_id"], labels["toxic"], strict=True) if zlib.crc32(str(i).encode()) % T.FOLDS != T.HELD_OUT}
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    texts: dict[str, int] = {}
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        if i in known and t is not None:
            texts[t] = max(texts.get(t, 0), known[i])
    return np.array([zlib.crc32(t.encode()) % FOLDS for t in texts]), np.array(list(texts.values())), pa.array(texts, pa.string())


def area(score: np.ndarray, label: np.ndarray) -> float:
    """The area under the curve, ties counted half."""
    values, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - n / 2 + 0.5)[at]
    ones = int(label.sum())
    return float((rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones)))


def scores(fold, label, texts, text, term, n, names) -> np.ndarray:
    """The score of each row from the other folds, with the weights as the module has them."""
    out = np.zeros(len(label))
    for f in range(FOLDS):
        own = fold != f
        has = own[text]
        df = np.bincount(term[has], minlength=len(names))
        df1 = np.bincount(term[has & (label[text] == 1)], minlength=len(names))
        held = df > 0
        weight = np.zeros(len(names))
        weight[held] = T.weight_of(df[held], df1[held], float(own.sum()), float(label[own].sum()))
        w = (1 + np.log(n)) * weight[term]
        unit = w / np.maximum(np.sqrt(np.bincount(text, w * w, minlength=len(label))), 1e-300)[text]
        keep = unit > 0
        shown = own & (np.cumsum(own) <= T.MAX_EXAMPLES)
        at, in_index = np.cumsum(shown) - 1, shown[text] & keep
        index = T.Index(list(range(int(shown.sum()))), label[shown].tolist(), at[text[in_index]], term[in_index], unit[in_index], len(names))
        asked = np.cumsum(~own) - 1
        rest = ~has & keep
        i, e, c = index.nearest(asked[text[rest]], term[rest], unit[rest], int((~own).sum()), T.NEIGHBOURS)
        out[~own] = T.votes(i, c, index.labels[e], int((~own).sum()), float(label[own].mean()))
    return out


GRID = [(1.0, 50.0, 2.0), *product((0.2, 0.1, 0.05, 0.02), (20.0, 50.0, 100.0, 200.0), (2.0,)), *product((0.1,), (50.0,), (1.5, 3.0))]


def main(folder: str = "/root/testdata/sf0.1", grid=GRID) -> dict:
    """Prints and returns the figures of each of grid; log loss is the last of them."""
    found, before = {}, (T.LEAST_WEIGHT, T.FULL_G2, T.LIFT)
    fold, label, texts = training_rows(folder)
    parts = [(t + a, term, n, names) for a, b in T._parts(texts) for t, term, n, names in [T.occurrences(texts.slice(a, b - a))]]
    names = pa.concat_arrays([p[3].cast(pa.string()) for p in parts]).dictionary_encode()
    number, text, term, n, start = names.indices.to_numpy(), [], [], [], 0
    for t, own, times, some in parts:
        text.append(t), term.append(number[start : start + len(some)][own]), n.append(times)
        start += len(some)
    text, term, n = map(np.concatenate, (text, term, n))
    print(f"{len(label)} texts, {label.sum()} toxic; LEAST_WEIGHT FULL_G2 LIFT: area, found, false alarms at 0.5, log loss")
    for least, full, lift in grid:
        T.LEAST_WEIGHT, T.FULL_G2, T.LIFT = least, full, lift
        s = scores(fold, label, texts, text, term, n, names.dictionary)
        p = np.clip(s, 1e-6, 1 - 1e-6)
        loss = -np.mean(np.where(label == 1, np.log(p), np.log(1 - p)))
        found[least, full, lift] = area(s, label), np.mean(s[label == 1] >= 0.5), np.mean(s[label == 0] >= 0.5), loss
        print(f"{least:5.2f} {full:5.0f} {lift:4.1f}:", *(f"{x:.4f}" for x in found[least, full, lift]), flush=True)
    T.LEAST_WEIGHT, T.FULL_G2, T.LIFT = before
    return found


if __name__ == "__main__":
    main(*sys.argv[1:])
