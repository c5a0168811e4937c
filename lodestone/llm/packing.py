"""Packing of tokenised documents into sequences.

The histogram of piece lengths has at most as many entries as a sequence has tokens, so the
configuration linear program (least number of sequences, each filled by one pattern of lengths)
is solved on the driver whatever the size of the table. Multiplicative weights give each length a
price; the pattern worth most at these prices comes from a knapsack by dynamic programming; the
lengths it covers become cheaper. The patterns used make up the fractional solution, and the prices bound
how few sequences any plan needs. It is rounded to whole sequences that never hold more pieces than there are. Of what is
left the longest pieces are each given the pattern worth most beside them, by a knapsack that knows how many pieces there are,
again and again; the last few pieces are packed best-fit.

Pieces find their places without meeting: each knows its number among the pieces of its length in
its partition, partitions' counts are summed up by length, and the plan says for each length and
number the sequence and offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.session import Scratch, table

from .units import chunks
from .word_bpe import Encoder
from .workers import tidy

CAPACITY = 2048
#: Pricing rounds of the linear program at most, and how near to the best the patterns are that it uses.
ROUNDS, NEAR = 60, 0.02
#: The most that a use of a pattern adds to the covered share of a length, and how fast prices fall with that share.
STEP, PRICE = 1.0, 4.0
#: Patterns of the solution that are filled less are left to the second stage, which takes those it needs.
FILLED = 0.9995
#: What the second stage pays for long pieces above their length: less than one token in all, so a fuller sequence always wins.
LONGER = 1e-4
#: How many of the longest lengths get a pattern by the same prices, and how few pieces are left when best fit is tried for them.
SEEDS, LAST = 64, (300, 100, 30)
#: A plan that needs one sequence more than the bound, or one in so many, is good enough.
NEAR_BOUND = 10_000
CHUNK = 8_000_000
TOKENIZER = "word_bpe_49k.json"
END_ID = 0


# --- the plan, on the driver ---------------------------------------------------------------


def _knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each space, the most value that fits and the length to put first; 0: none."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            gain = best[c - lengths[: upto[c]]] + prices[: upto[c]]
            k = int(np.argmax(gain))
            if gain[k] > best[c] + 1e-15:
                best[c], pick[c] = gain[k], lengths[k]
    return best, pick


def _filled(pick: np.ndarray, space: int, first: int = 0) -> dict[int, int]:
    """The pattern that begins with first, where one is given, and goes on as the knapsack says."""
    out = {first: 1} if first else {}
    c = space - first
    while c > 0:
        if l := int(pick[c]):
            out[l] = out.get(l, 0) + 1
            c -= l
        else:
            c -= 1
    return out


def price_pattern(values: np.ndarray, capacity: int) -> dict[int, int]:
    """The pattern {length: times} of most value. values[l] is the price of length l; 0: none left."""
    lengths = np.flatnonzero(values)
    return _filled(_knapsack(values[lengths], lengths, capacity)[1], capacity)


def solve_lp(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Patterns and how often to use each to cover counts[l] pieces of each length l, and what no solution is less than.

    A length's price falls as the share of its pieces that is covered grows. Each round prices patterns once and uses,
    of the best pattern with each length in it, those that are still worth nearly as much as the best one, each so often
    that no share grows by more than STEP. The prices of a round are a dual solution once the dearest pattern
    costs 1; the highest value of these is the bound.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return [], 0.0
    at = np.zeros(capacity + 1, np.int64)
    at[lengths] = np.arange(len(lengths))
    need = counts[lengths].astype(float)
    share = np.zeros(len(lengths))
    used: dict[tuple, float] = {}
    bound = float((need * lengths).sum()) / capacity
    for _ in range(rounds):
        prices = lengths / capacity * np.exp(-PRICE * (share - share.min()))
        best, pick = _knapsack(prices, lengths, capacity)
        bound = max(bound, float(prices @ need) / best[capacity])
        gain = best[capacity - lengths] + prices
        for k in np.argsort(-gain, kind="stable").tolist():
            if gain[k] < (1 - NEAR) * best[capacity]:
                break
            pattern = _filled(pick, capacity, int(lengths[k]))
            own = at[list(pattern)]
            times = np.array(list(pattern.values()))
            if prices[own] @ times < (1 - NEAR) * best[capacity]:
                continue
            amount = STEP * float((need[own] / times).min())
            key = tuple(sorted(pattern.items()))
            used[key] = used.get(key, 0.0) + amount
            share[own] += amount * times / need[own]
            prices[own] *= np.exp(-PRICE * amount * times / need[own])
        if share.min() >= 1:
            break
    return [(dict(k), x / max(1.0, float(share.min()))) for k, x in used.items()], bound


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram; sequences alike are counted together."""
    free: list[int] = []  # spaces with open sequences, sorted
    opened: dict[int, list[list]] = {}  # space: [[pattern, number]]

    def put(space: int, pattern: tuple, n: int) -> None:
        if space not in opened:
            opened[space] = []
            insort(free, space)
        opened[space].append([pattern, n])

    for l in range(capacity, 0, -1):
        left = int(counts[l]) if l < len(counts) else 0
        while left:
            i = bisect_left(free, l)
            if i == len(free):
                fits = capacity // l
                if left >= fits:
                    put(capacity - fits * l, ((l, fits),), left // fits)
                    left %= fits
                else:
                    put(capacity - left * l, ((l, left),), 1)
                    left = 0
                continue
            space = free[i]
            pattern, n = opened[space].pop()
            if not opened[space]:
                del opened[space], free[i]
            fits = min(space // l, left)
            take = min(n, left // fits)
            if n > take:
                put(space, pattern, n - take)
            put(space - fits * l, (*pattern, (l, fits)), take)
            left -= take * fits
    return [(dict(p), n) for rows in opened.values() for p, n in rows]


def _rounded(solution, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole sequences by the patterns that are filled, taken out of left, which holds what is still to be packed."""
    out = []
    patterns = sorted(solution, key=lambda s: -sum(l * n for l, n in s[0].items()))
    for again in (False, True):  # what rounding down has left may still fill whole sequences
        for pattern, x in patterns:
            if sum(l * n for l, n in pattern.items()) < capacity * FILLED:
                continue
            most = min(int(left[l]) // n for l, n in pattern.items())
            times = most if again else min(int(x), most)
            if times:
                out.append((pattern, times))
                for l, n in pattern.items():
                    left[l] -= n * times
    return out


def _bounded_knapsack(prices: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int):
    """space to the pattern of most value in it that takes no length more often than counts says. Items are looked at in the order given."""
    best, items, taken = np.zeros(capacity + 1), [], []
    for i, length in enumerate(lengths.tolist()):
        left, k = min(int(counts[i]), capacity // length), 1
        while left:  # 1, 2, 4, ... pieces and the rest, each taken or not
            n = min(k, left)
            more = best[: capacity + 1 - n * length] + n * prices[i]
            better = more > best[n * length :] + 1e-12
            row = np.zeros(capacity + 1, bool)
            row[n * length :] = better
            best[n * length :] = np.where(better, more, best[n * length :])
            items.append((length, n))
            taken.append(row)
            left, k = left - n, 2 * k

    def pattern(space: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for (length, n), row in zip(reversed(items), reversed(taken), strict=True):
            if row[space]:
                out[length] = out.get(length, 0) + n
                space -= n * length
        return out

    return pattern


def _filled_up(left: np.ndarray, capacity: int, stop: int, order: np.random.Generator) -> list[tuple[dict[int, int], int]]:
    """Whole sequences taken out of left until at most stop pieces are there: the longest ones and what goes best beside them.

    If no sequence with one of the longest lengths gets full, the longest piece gets the best there is.
    """
    out = []
    while left.sum() > stop:
        lengths = order.permutation(np.flatnonzero(left))
        pattern_of = _bounded_knapsack(lengths * (1 + LONGER * lengths / capacity), lengths, left[lengths], capacity)
        seeds, n = np.sort(lengths)[::-1][:SEEDS].tolist(), len(out)
        for full in (True, False):
            for length in seeds if full else seeds[:1] * (len(out) == n):
                pattern = pattern_of(capacity - length)
                if full and length + sum(l * k for l, k in pattern.items()) < capacity:
                    continue
                pattern[length] = pattern.get(length, 0) + 1
                if not full:  # one piece more of this length than there is may have been counted in
                    pattern[length] = min(pattern[length], int(left[length]))
                if times := min(int(left[l]) // k for l, k in pattern.items()):
                    out.append((pattern, times))
                    for l, k in pattern.items():
                        left[l] -= k * times
    return out


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], int, int]:
    """[(pattern, number of sequences)], the least number of sequences that any plan needs, by the linear program, and how many pieces were packed best-fit.

    The patterns hold exactly counts[l] pieces of each length l. Best fit is tried for the last pieces, from each of LAST on. Where
    that needs clearly more than the bound, all pieces are given patterns by the second stage too: of few large pieces, each of a length
    of its own, the program's amounts are less than one and rounding them says little.
    """
    every = counts.astype(np.int64).copy()
    full = [({capacity: 1}, int(every[capacity]))] if every[capacity] else []
    least = int(every[capacity])
    every[capacity] = 0
    solution, bound = solve_lp(every, capacity, rounds)
    least += int(np.ceil(bound - 1e-6))
    order, best, last = np.random.default_rng(0), None, 0
    for rounded in (True, False):
        left = every.copy()
        found = full + (_rounded(solution, left, capacity) if rounded else [])
        for stop in LAST:
            found += _filled_up(left, capacity, stop, order)
            whole = found + _best_fit(left, capacity)
            if best is None or sum(n for _, n in whole) < sum(n for _, n in best):
                best, last = whole, int(left.sum())
        if sum(n for _, n in best) - least <= max(1, least // NEAR_BOUND):
            break
    held = np.zeros(len(counts), np.int64)
    for pattern, n in best:
        for l, times in pattern.items():
            held[l] += n * times
    if (held != counts).any():
        raise AssertionError("the plan does not hold each piece once")
    return best, least, last


def place_runs(plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """By length and number: runs of pieces. Of each run: length, first number, first sequence, sequences, offset, per sequence."""
    rows, base, seen = [], 0, np.zeros(capacity + 1, np.int64)
    for pattern, number in plan:
        offset = 0
        for l, times in pattern.items():
            rows.append((l, seen[l], base, number, offset, times))
            seen[l] += number * times
            offset += l * times
        base += number
    rows.sort()
    table_ = np.array(rows, np.int64).reshape(-1, 6)
    return dict(zip(("length", "number", "base", "sequences", "offset", "times"), table_.T.copy(), strict=True))


def _places(runs: dict[str, np.ndarray], capacity: int, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces of these lengths and numbers."""
    edge = np.searchsorted(runs["length"], np.arange(capacity + 2))
    low, high = edge[length], edge[length + 1] - 1
    while True:  # the last run that begins at or before number
        open_ = low < high
        if not open_.any():
            break
        mid = (low + high + 1) // 2
        right = open_ & (runs["number"][mid] <= number)
        low, high = np.where(right, mid, low), np.where(open_ & ~right, mid - 1, high)
    nth = number - runs["number"][low]
    sequence = runs["base"][low] + nth % runs["sequences"][low]
    return sequence, runs["offset"][low] + (nth // runs["sequences"][low]) * length


# --- tokens, on the executors --------------------------------------------------------------

_worker: dict = {}


def _encoder(path: str) -> Encoder:
    if path not in _worker:
        _worker[path] = Encoder(path)
    return _worker[path]


def _pieces(tokenizer: str, capacity: int):
    end = END_ID.to_bytes(4, "little")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = _encoder(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        part = TaskContext.get().partitionId()
        counted = [0] * (capacity + 1)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").fill_null("")
            for a, b in chunks(pc.binary_length(texts).to_pylist(), CHUNK):
                data, at = encode(texts.slice(a, b - a))
                size = np.diff(at) // 4 + 1  # with the id that ends a document
                number_of = -(-size // capacity)
                doc = np.repeat(np.arange(b - a), number_of)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number_of) - number_of, number_of)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                low = at[:-1][doc] + 4 * start
                high = np.minimum(low + 4 * length, at[1:][doc])
                raw = memoryview(np.ascontiguousarray(data))
                crc, number = [], []
                for x, y, n in zip(low.tolist(), high.tolist(), length.tolist(), strict=True):
                    c = zlib.crc32(raw[x:y])
                    crc.append(c if y - x == 4 * n else zlib.crc32(end, c))
                    number.append(counted[n])
                    counted[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(number, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"],
                )

    return run


def _placed(runs, capacity: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("number").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = _places(runs.value, capacity, batch.column("length").to_numpy(), number) if batch.num_rows else (np.empty(0, np.int64),) * 2
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of docs (doc_id, text, ...).

    tokenizer is a path, or a file name of the public tokenizers. Null text counts as empty and
    gives the one id that ends each document. Only documents longer than capacity are cut. Rows with
    the same or no doc_id are documents of their own; other columns are not read. An empty table
    gives no rows. The plan that is sent to all tasks has a run for each pattern and length in it; the number of patterns hangs on
    how many lengths there are, at most capacity, and not on how many pieces.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, number long")
    pieces = scratch.save(pieces, "pieces")
    counts = scratch.save(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        histogram[row.length] = row.n
    runs = spark.sparkContext.broadcast(place_runs(plan_sequences(histogram, capacity, rounds)[0], capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "part", F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    kinds = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.join(counts, ["length", "part"]).mapInArrow(_placed(runs, capacity), kinds)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
