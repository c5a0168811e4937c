"""Texts to ids by a tokenizer of words, with each distinct unit of a batch encoded once.

The tokenizer lower-cases, cuts a text into runs of letters, single digits, contractions and runs of marks, and
merges the bytes of each. Units are cut only where such a run surely ends, so a text's ids are those of its
units. Units of plain letters or marks are one run, whose merges are done for all units side by side: the
pair of least rank, and of equal ones the first, until a unit has none. All others, and texts with
special tokens, go to the tokenizer itself; so does everything where the tokenizer is of another kind.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .units import Hashes, coded, raw_bytes, slices, split

#: What the tokenizer must do for units to be its own; fixed values of its file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Longer units go to the tokenizer: all units take as many steps as the longest.
LONG = 64
_NONE = np.int32(2**31 - 1)
_SPACE, _LETTER, _DIGIT, _MARK, _QUOTE, _OTHER = range(6)
#: From this byte on, characters may compose with the one before them.
_COMPOSES = 0xC9


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 0x7F or (byte < 0x20 and not 9 <= byte <= 13):
        return _OTHER
    return _SPACE if c.isspace() else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _QUOTE if c == "'" else _MARK


_CLASS = np.array([_class_of(b) for b in range(256)], np.uint8)
_PLAIN = np.array([_CLASS[b] == _LETTER for b in range(256)])
#: White space as one space, A-Z as a-z.
_LOWER = np.array([0x20 if _CLASS[b] == _SPACE else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _joined() -> np.ndarray:
    a, b = (_CLASS[i] for i in np.indices((256, 256)))
    end = (b == _SPACE) & (a != _SPACE)
    word = (a == _LETTER) & np.isin(b, (_DIGIT, _MARK, _QUOTE))
    digit = (a == _DIGIT) & np.isin(b, (_LETTER, _DIGIT, _MARK, _QUOTE))
    mark = (np.isin(a, (_MARK, _QUOTE)) & (b == _DIGIT)) | ((a == _MARK) & (b == _LETTER))
    return ~(end | word | digit | mark).ravel()


_JOINED = _joined()


def lowered(data: np.ndarray) -> np.ndarray:
    """data with letters lower-cased as the tokenizer does, unless what follows may compose with them."""
    out = _LOWER[data]
    wide = np.flatnonzero(data[1:] >= _COMPOSES)
    out[wide] = np.where(_CLASS[data[wide]] == _SPACE, 0x20, data[wide])
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    upper = upper[(upper + 1 == len(data)) | (data[np.minimum(upper + 1, len(data) - 1)] < _COMPOSES)]
    out[upper] += 0x20
    return out


class Merges:
    """Byte-pair merges of many words side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in merges]
        self.into = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        # Of merges that are listed twice the last one counts, as in the tokenizer.
        self.rank = Hashes({((vocabulary[a] << 32) | vocabulary[b]) + 1: r for r, (a, b) in enumerate(pairs)})
        shown = _byte_letters()
        self.inner = np.array([vocabulary[shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[shown[b] + suffix] for b in range(256)], np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.rank.find(((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)) + np.uint64(1))
        return np.where(found < 0, _NONE, found)

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words data[at[i]:at[i + 1]], none of them empty, and how many each has."""
        n = len(at) - 1
        size = np.diff(at)
        sizes = np.zeros(n, np.int64)
        ids = self.inner[data]
        ids[at[1:] - 1] = self.last[data[at[1:] - 1]]
        rank = np.full(len(ids), _NONE, np.int32)
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        rank[at[1:] - 1] = _NONE
        word, done = np.arange(n), []
        while len(word):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            go = least < _NONE
            if not go.all():
                held = np.repeat(go, size)
                sizes[word[~go]] = size[~go]
                done.append((word[~go], ids[~held]))
                word, size, least, ids, rank = word[go], size[go], least[go], ids[held], rank[held]
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            of = np.searchsorted(np.cumsum(size), hit, side="right")
            first = np.ones(len(hit), bool)
            first[1:] = of[1:] != of[:-1]
            hit = hit[first]
            ids[hit] = self.into[least]
            held = np.ones(len(ids), bool)
            held[hit + 1] = False
            ids = ids[held]
            last = hit + 2 == np.cumsum(size)  # the merged pair was the end of its word
            begin = hit == np.cumsum(size) - size
            rank = rank[held]
            size = size - 1
            hit = hit - np.arange(len(hit))
            rank[hit] = _NONE
            more = hit[~last]
            rank[more] = self._ranks(ids[more], ids[more + 1])
            more = hit[~begin]
            rank[more - 1] = self._ranks(ids[more - 1], ids[more])
        out = np.empty(int(sizes.sum()), np.int32)
        to = np.cumsum(sizes) - sizes
        for words, own in done:
            n_own = sizes[words]
            out[np.repeat(to[words] - (np.cumsum(n_own) - n_own), n_own) + np.arange(len(own))] = own
        return out, sizes


def _byte_letters() -> list[str]:
    """The character that stands for each byte: its own where that is printable, else the next one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in own else next(rest) for b in range(256)]


class Encoder:
    """Texts to the bytes of their ids, each 32 bits."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        model, cuts = form["model"], form.get("pre_tokenizer") or {}
        kinds = [x.get("type") for x in (form.get("normalizer") or {}).get("normalizers", [])]
        patterns = [x.get("pattern", {}).get("Regex") for x in cuts.get("pretokenizers", [])]
        self.by_units = kinds == NORMALIZERS and patterns[:1] == [PATTERN] and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix"))
        self.special = [t["content"] for t in form["added_tokens"]]
        if self.by_units:
            self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _all(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, units: pa.Array) -> pa.Array:
        """The ids of each unit, a binary column."""
        data, at = raw_bytes(units)
        begin, end = at[:-1].copy(), at[1:]
        while True:
            spaces = np.flatnonzero((begin < end) & (data[np.minimum(begin, len(data) - 1)] == 0x20))
            if not len(spaces):
                break
            begin[spaces] += 1
        # Plain bytes: a-z, and the small letters from U+00DF to U+00FF.
        fine = _PLAIN[data] & (data >= 97)
        small = (data[:-1] == 0xC3) & (data[1:] >= 0x9F) & (data[1:] <= 0xBF) & (data[1:] != 0xB7)
        fine[1:] |= small
        fine[:-1] |= small
        kind = _CLASS[data]
        many = lambda ok: np.concatenate([[0], np.cumsum(ok)])
        size = end - begin
        letters, marks = (run[end] - run[begin] == size for run in (many(fine), many((kind == _MARK) | (kind == _QUOTE))))
        digit = (size == 1) & (kind[np.minimum(begin, len(data) - 1)] == _DIGIT)
        plain = np.flatnonzero((letters | marks | digit) & (size > 0) & (size <= LONG))
        odd = np.ones(len(units), bool)
        odd[plain] = size[plain] == 0
        length = size[plain]
        own = np.cumsum(length) - length
        flat = data[np.repeat(begin[plain] - own, length) + np.arange(int(length.sum()))]
        out, sizes = self.merges(flat, np.append(own, len(flat))) if len(plain) else (np.empty(0, np.int32), np.empty(0, np.int64))
        rest = np.flatnonzero(odd)
        told = self._all(slices(data, at).take(pa.array(rest)).cast(pa.large_string()).to_pylist()) if len(rest) else []
        values = pa.concat_arrays([slices(out.astype("<u4").view(np.uint8), 4 * np.concatenate([[0], np.cumsum(sizes)])), pa.array(told, pa.large_binary())])
        order = np.empty(len(units), np.int64)
        order[plain], order[rest] = np.arange(len(plain)), len(plain) + np.arange(len(rest))
        return values.take(pa.array(order))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after the other, and where each text's begin and the last one's end. texts are strings without null."""
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not self.by_units:
            whole[:] = True
        plain = pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts) if whole.any() else texts
        data, at = raw_bytes(plain)
        if len(data):
            data = lowered(data)
            begins, sizes = split(data, at, _JOINED)
            codes, distinct = coded(data, begins)
            ids, ends = raw_bytes(self.units(distinct).take(pa.array(codes)))
            ends = ends[np.concatenate([[0], np.cumsum(sizes)])]
        else:
            ids, ends = np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
        if not whole.any():
            return ids, ends
        parts = [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i, data_ in zip(np.flatnonzero(whole).tolist(), self._all(texts.filter(pa.array(whole)).to_pylist()), strict=True):
            parts[i] = data_
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
