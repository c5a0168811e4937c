"""SentencePiece encoding by sampling from the lattice of pieces, and decoding.

A text is the pieces' alphabet of characters with U+2581 for a space, after one such for the start. Where
no piece can go across, the lattice falls into units, and each distinct unit of a batch has one lattice.
Forward filtering adds up the weights of all segmentations that reach each position, once for all units
that begin alike: units lie in a trie, whose nodes of one depth are worked on together. A node holds what its
weight is times that of the position before, so no product gets too small.
Backward sampling then walks all units of a batch at once from their ends: at each position
one random number picks the last piece, with the probability that the forward sums give it. The
random numbers are hashes of the row's key, the unit's place and the step, so a row has the same
segmentation wherever and whenever it is encoded. A U+2581 of the text itself, and what no piece
covers, go as bytes; so decoding gives back every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestone.session import table

from .units import Table, Trie, byte_pairs, chunks, coded, raw_bytes, split
from .workers import tidy

MODEL = "piece_bpe_32k.model"
#: A piece of rank r weighs (r + RANK0) ** -POWER, to the power of the sharpness.
RANK0, POWER, SHARPNESS = 10.0, 1.0, 1.0
SPACE = "▁"
CHUNK = 8_000_000
_STEP = 0x9E3779B97F4A7C15


class Pieces:
    """Ids and log-weights of a SentencePiece model's pieces."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.log = {self.text[i]: -POWER * sharpness * float(np.log(rank + RANK0)) for rank, i in enumerate(plain)}
        self.byte_log = -POWER * sharpness * float(np.log(len(plain) + RANK0))
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, t in enumerate(self.text)]
        # By id, then by number of bytes of a character without piece.
        self.logs = np.full(size, self.byte_log)
        self.logs[plain] = [self.log[self.text[i]] for i in plain]
        self.weight = np.exp(self.logs)
        self.byte_weight = np.exp(self.byte_log) ** np.arange(5)
        self.joined = byte_pairs([self.bytes[i] for i in plain])
        # Lattices have a plain space for U+2581, so a U+2581 of the text is in no piece.
        self.table = Table({t.replace(SPACE, " "): i for t, i in self.ids.items()})
        self.byte_ids = np.array([self.byte.get(b, 0) for b in range(256)], np.int32)
        self.values = pa.array(self.bytes, pa.binary())


_worker: dict = {}


def pieces(model: str, sharpness: float = SHARPNESS) -> Pieces:
    key = (model, sharpness)
    if key not in _worker:
        import public_tokenizers

        _worker[key] = Pieces(model if "/" in model else public_tokenizers.path(model), sharpness)
    return _worker[key]


def utf8_size(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


class Lattices:
    """Lattices of distinct units: for each position, the pieces that may end there, with cumulative probabilities.

    Of the edges of one node, longer pieces come first. An edge of a character without piece has -1 minus its code point.
    """

    def __init__(self, of: Pieces, units: pa.Array):
        self.trie = trie = Trie(units)
        # 1 / ratio[i] is the weight of node i over that of its parent.
        ratio = np.ones(len(trie.parent))
        sizes, cum, piece, source = [np.zeros(1, np.int64)], [], [], []
        for nodes, options in trie.levels(of.table):
            n = nodes.stop - nodes.start
            weights, ids, back = [], [], []
            scale = None
            for size, found, origin in options:
                w = np.where(found >= 0, of.weight[found], 0.0)
                if size == 1:
                    none = found < 0
                    if none.any():
                        point = trie.point[nodes][none]
                        w[none] = of.byte_weight[utf8_size(point)]
                        found[none] = -1 - point.astype(np.int32)
                    scale = ratio[origin]
                else:
                    w *= scale
                    scale = scale * ratio[origin]
                weights.append(w)
                ids.append(found)
                back.append(origin)
            run = np.cumsum(np.stack(weights[::-1], axis=1), axis=1)
            total = run[:, -1].copy()
            ratio[nodes] = 1.0 / total
            run /= total[:, None]
            run[:, -1] = 1.0
            ids = np.stack(ids[::-1], axis=1)
            here = ids >= 0
            here[:, -1] = True
            sizes.append(np.count_nonzero(here, axis=1))
            cum.append(run[here])
            piece.append(ids[here])
            source.append(np.stack(back[::-1], axis=1)[here])
            assert len(sizes[-1]) == n
        for nodes, ids in trie.chains(of.table):
            for part in self._chain(of, nodes, ids, ratio):
                for to, x in zip((sizes, cum, piece, source), part, strict=True):
                    to.append(x)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.cum, self.piece, self.source = (np.concatenate([np.empty(0, t), *x]) for t, x in ((np.float64, cum), (np.int32, piece), (np.int32, source)))

    def _chain(self, of: Pieces, nodes: slice, ids: np.ndarray, ratio: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """The same for the nodes of one long unit, where each is its own level."""
        base, sizes, cum, piece, source = nodes.start, [], [], [], []
        back = [1.0]  # of the nodes before, latest last; the root's is not used
        for i in range(nodes.stop - base):
            row, point = ids[i], int(self.trie.point[base + i])
            w = [float(of.weight[row[0]])] if row[0] >= 0 else [float(of.byte_weight[utf8_size(np.array([point]))[0]])]
            scale = 1.0
            hits = [0]
            for n in range(1, min(i + 1, len(row))):
                scale *= back[-n]
                w.append(float(of.weight[row[n]]) * scale if row[n] >= 0 else 0.0)
                if row[n] >= 0:
                    hits.append(n)
            run, sums = 0.0, {}
            for n in range(len(w) - 1, -1, -1):
                run += w[n]
                sums[n] = run
            hits.reverse()
            sizes.append(len(hits))
            for n in hits:
                cum.append(1.0 if n == 0 else sums[n] / run)
                piece.append(int(row[n]) if row[n] >= 0 else -1 - point)
                source.append(0 if n == i else base + i - n - 1)
            back.append(1.0 / run)
            ratio[base + i] = back[-1]
        yield np.array(sizes, np.int64), np.array(cum), np.array(piece, np.int32), np.array(source, np.int32)

    def sample(self, units: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling: the pieces of all units, and how many each has. seeds are 64-bit."""
        active, where = np.arange(len(units)), self.trie.end[units]
        count = np.zeros(len(units), np.int64)
        steps = []
        while len(active):
            x = seeds[active] + np.uint64((len(steps) + 1) * _STEP % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[where]
            beyond = np.flatnonzero(self.cum[edge] <= u)
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[self.cum[edge[beyond]] <= u[beyond]]
            steps.append((active, self.piece[edge]))
            count[active] += 1
            where = self.source[edge]
            go = np.flatnonzero(where)
            active, where = active[go], where[go]
        out = np.zeros(int(count.sum()), np.int32)
        end = np.cumsum(count)
        for active, ids in steps:
            at = end[active] - 1
            end[active] = at
            out[at] = ids
        return out, count


def encode_batch(texts: pa.Array, keys: list[bytes], of: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sampled ids of all texts one after the other, where each text's begin and the last one's end; the texts' bytes, and where each begins.

    The same text and key give the same ids in any batch. texts are strings without null.
    """
    data, at = raw_bytes(pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type)))
    begins, sizes = split(data, at, of.joined)
    codes, distinct = coded(data, begins)
    lattices = Lattices(of, distinct)
    row = np.repeat(np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(first, sizes)
    seeds = (row ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xA0761D6478BD642F)
    ids, count = lattices.sample(codes, seeds ^ (seeds >> np.uint64(32)))
    if len(ids) and int(ids.min()) < 0:
        ids, count = _as_bytes(ids, count, of)
    cut = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)])]
    return ids, cut, data, at


def _as_bytes(ids: np.ndarray, count: np.ndarray, of: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """ids and counts with the bytes of characters without piece."""
    raw = np.flatnonzero(ids < 0)
    spelled = "".join(map(chr, (-1 - ids[raw]).tolist())).encode("utf-8", "surrogatepass")
    size = np.ones(len(ids), np.int64)
    size[raw] = utf8_size(-1 - ids[raw])
    begin = np.cumsum(size) - size
    out = np.repeat(ids, size)
    own = np.repeat(ids < 0, size)
    out[own] = of.byte_ids[np.frombuffer(spelled, np.uint8)]
    ends = np.append(begin, len(out))[np.cumsum(count)]
    return out, np.diff(np.concatenate([[0], ends]))


def decode_batch(ids: np.ndarray, of: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids one after the other, and where each id's begin and the last one's end."""
    return raw_bytes(of.values.take(pa.array(ids)))


def decode(ids: np.ndarray, of: Pieces) -> str:
    """The text that was encoded."""
    return decode_batch(np.asarray(ids, np.int32), of)[0].tobytes().decode("utf-8", "surrogatepass")[1:]


def _keys(ids: pa.Array) -> list[bytes]:
    return [b"" if i is None else str(i).encode() for i in ids.to_pylist()]


def byte_sizes(texts: pa.Array) -> list[int]:
    return pc.binary_length(texts).to_pylist()


def _encoder(model: str, sharpness: float, digest: bool = False):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pieces(model, sharpness)
        for batch in batches:
            every = batch.column("text").fill_null("")
            for a, b in chunks(byte_sizes(every), CHUNK):
                texts, doc_id = every.slice(a, b - a), batch.column("doc_id").slice(a, b - a)
                ids, cut, data, at = encode_batch(texts, _keys(doc_id), of)
                if digest:
                    whole, ends = decode_batch(ids, of)
                    ends = ends[cut]
                    if len(whole) == len(data) and (ends == at).all() and (whole == data).all():
                        same = np.ones(len(texts), bool)
                    else:
                        same = np.array([np.array_equal(whole[ends[i] : ends[i + 1]], data[at[i] : at[i + 1]]) for i in range(len(texts))], bool)
                    raw = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(cut)), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "lossless"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([doc_id, batch.column("text").slice(a, b - a), lists], ["doc_id", "text", "ids"])

    return run


def encode(docs: DataFrame, model: str = MODEL, sharpness: float = SHARPNESS) -> DataFrame:
    """(doc_id, text, ids) for every row of docs (doc_id, text, ...).

    doc_id is the key that seeds a row's segmentation; null is a key like others. Null text counts
    as empty, whose one id is the start's space. Rows that repeat have the same ids. A text of any length is
    encoded whole. An empty table gives no rows. model is a path, or a file name of the public tokenizers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encoder(model, sharpness), f"doc_id {kind}, text string, ids array<int>")


def encode_digests(docs: DataFrame, model: str = MODEL, sharpness: float = SHARPNESS) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, lossless): what encode gives, by number and CRC, and whether decoding it gives the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encoder(model, sharpness, True), f"doc_id {kind}, n_ids long, ids_crc32 long, lossless boolean")


def _decoder(model: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pieces(model)
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "ids"]
            texts = [None if not x.is_valid else decode(x.values.to_numpy(), of) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, "decoded"])

    return run


def decode_rows(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of encoded (ids, ...) with decoded in place of ids; null ids give null."""
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids")
    return encoded.mapInArrow(_decoder(model), f"{rest}, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
