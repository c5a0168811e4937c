"""Texts as codes of distinct units, and the trie of distinct units, in whole-column steps.

A unit is a run of bytes that no piece of a vocabulary can reach across: the text is cut wherever
no piece has the two bytes beside the cut in a row. So a text's segmentations are those of its units, one after
the other, and each distinct unit of a batch is worked on once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units of more characters are worked on one by one, as a batch takes as many steps as its longest unit has.
LONG = 128
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WORD = (1 << 64) - 1


def byte_pairs(pieces: list[bytes]) -> np.ndarray:
    """joined[256 * a + b]: some piece has byte a before byte b. The bytes of one character are always joined."""
    joined = np.zeros((256, 256), bool)
    joined[:, 0x80:0xC0] = True
    for p in pieces:
        for a, b in zip(p, p[1:]):
            joined[a, b] = True
    return joined.ravel()


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values' bytes, and where each begins and the last one ends. The column is a string or binary one without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The values data[at[i]:at[i + 1]] as a binary column, without a copy of data."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)])


def split(data: np.ndarray, at: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the units of the values begin, and how many each value has; a value's begin is one."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        np.logical_not(joined[pair], out=cut[1:-1])
    cut[at] = True
    cut[-1] = False
    begins = np.flatnonzero(cut)
    return begins, np.diff(np.searchsorted(begins, at))


def coded(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The code of each unit, and the distinct units by code."""
    found = slices(data, np.append(begins, len(data))).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


class Hashes:
    """Numbers by 64-bit keys other than 0, in open addressing."""

    def __init__(self, numbers: dict[int, int]):
        bits = max(8, (len(numbers) * 8 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        keys, found = [0] * (1 << bits), [-1] * (1 << bits)
        for key, number in numbers.items():
            at = (key * int(_MIX) & _WORD) >> (64 - bits)
            while keys[at]:
                at = (at + 1) & int(self.mask)
            keys[at], found[at] = key, number
        self.keys, self.numbers = np.array(keys, np.uint64), np.array(found, np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        at = ((key * _MIX) >> self.shift).astype(np.int64)
        got = self.keys[at]
        same = got == key
        out = np.where(same, self.numbers[at], np.int32(-1))
        more = np.flatnonzero(~same & (got != 0))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            got = self.keys[at[more]]
            same = got == key[more]
            out[more[same]] = self.numbers[at[more[same]]]
            more = more[~same & (got != 0)]
        return out


class Table(Hashes):
    """Numbers by short strings; their hashes are of code points, last one first."""

    def __init__(self, words: dict[str, int]):
        self.longest = max(map(len, words), default=1)
        self.power = np.array([pow(_BASE, j, 1 << 64) for j in range(self.longest + 1)], np.uint64)
        keys = {sum((ord(c) + 1) * pow(_BASE, j, 1 << 64) for j, c in enumerate(reversed(w))) & _WORD: i for w, i in words.items()}
        if len(keys) < len(words) or 0 in keys:
            raise ValueError("two pieces have one hash")
        super().__init__(keys)


class Trie:
    """The distinct prefixes of units. Node 0 is the empty one; a node comes after its parent."""

    def __init__(self, units: pa.Array):
        """units is a binary column of distinct UTF-8 values."""
        data, at = raw_bytes(units)
        lead = (data & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(lead)])[at]
        self.points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        self.start, self.length = at[:-1], np.diff(at)
        self.short = np.flatnonzero(self.length <= LONG)
        self.long = np.flatnonzero(self.length > LONG)
        if len(self.short):
            order = pc.array_sort_indices(units.take(pa.array(self.short)) if len(self.long) else units).to_numpy()
            self.short = self.short[order]
        self.end = np.zeros(len(units), np.int32)  # the node of each unit
        most = int(self.length.sum()) + 1
        self.parent, self.point = np.zeros(most, np.int32), np.zeros(most, np.uint32)
        self.size = 1

    def levels(self, table: Table) -> Iterator[tuple[slice, Iterator[tuple[int, np.ndarray, np.ndarray]]]]:
        """The nodes of each depth, and their options: for each length the piece that ends there, or -1, and where it begins.

        An options' iterator must be used up before the next level.
        """
        active, here = self.short, np.zeros(len(self.short), np.int32)
        depth = 0
        while len(active):
            go = self.length[active] > depth
            if not go.all():
                self.end[active[~go]] = here[~go]
                active, here = active[go], here[go]
                if not len(active):
                    break
            point = self.points[self.start[active] + depth]
            new = np.ones(len(active), bool)
            new[1:] = (here[1:] != here[:-1]) | (point[1:] != point[:-1])
            nodes = slice(self.size, self.size + int(np.count_nonzero(new)))
            self.parent[nodes], self.point[nodes] = here[new], point[new]
            here = (np.cumsum(new) + (self.size - 1)).astype(np.int32)
            self.size = nodes.stop
            depth += 1
            yield nodes, self._options(nodes, min(depth, table.longest), table)

    def chains(self, table: Table) -> Iterator[tuple[slice, np.ndarray]]:
        """After levels(), units of more than LONG characters: nodes of their own, and ids[i, n - 1]: the piece of n characters that ends at the i-th."""
        for unit in self.long.tolist():
            size = int(self.length[unit])
            nodes = slice(self.size, self.size + size)
            self.point[nodes] = self.points[self.start[unit] : self.start[unit] + size]
            self.parent[nodes] = np.arange(self.size - 1, self.size + size - 1)
            self.parent[self.size] = 0
            self.end[unit] = self.size + size - 1
            self.size += size
            point = self.point[nodes].astype(np.uint64) + np.uint64(1)
            ids = np.full((size, table.longest), -1, np.int32)
            key = np.zeros(size, np.uint64)
            for n in range(min(size, table.longest)):
                key[n:] += point[: size - n] * table.power[n]
                ids[n:, n] = table.find(key[n:])
            yield nodes, ids

    def _options(self, nodes: slice, most: int, table: Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        back, key = self.parent[nodes], self.point[nodes].astype(np.uint64) + np.uint64(1)
        yield 1, table.find(key), back
        for n in range(2, most + 1):
            key = key + (self.point[back].astype(np.uint64) + np.uint64(1)) * table.power[n - 1]
            back = self.parent[back]
            yield n, table.find(key), back
