"""Near-duplicate documents by one-permutation MinHash.

1. Each text becomes the set of its distinct 5-word shingles, as 64-bit hashes. One pass over the
   sorted hashes gives the one-permutation signature: the least hash of each of 128 bins. An empty
   bin takes the value of the first filled bin in a probe sequence of its own (optimal
   densification). Texts with one set are one class, and only its first row goes on.
2. Four neighbouring bins make a band. Classes that agree in a band meet in a bucket; a pair at
   similarity 0.75 misses all 32 buckets with a chance of 5 in a million. Of buckets with the same members one stays.
3. A bucket's hub is the member that meets the most others in all its buckets. The buckets of one hub, 32 at most, are a star, with an
   edge from the hub to each other member. Links are confirmed on full sets and joined to components.
4. In stars whose members are of several components, those outside the most frequent one are held against the others, a part
   of the star against a part of it in each task. What sizes and sketches don't rule out is compared on full sets, which no others are sent for,
   until all that may be linked are of one component or compared; so no bucket loses a link. Only links leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestone.session import Scratch, table

from .components import connected_components
from .filters import hash_filter, passes, passing
from .rows import keep_rows, with_group
from .units import chunks, coded, raw_bytes, split
from .workers import small_batches, tidy

WORDS, BINS, ROWS = 5, 128, 4
#: Links need PER_CENT * union <= 100 * intersection.
PER_CENT = 75
#: A sketch is the one-permutation signature of so many bins, by 16 bits each. Of sets of at least ESTIMATED shingles, the
#: similarity is at most the share of bins that agree plus MARGIN, which is over six standard deviations.
SKETCH, ESTIMATED, MARGIN = 256, 64, 0.19
CHUNK = 4_000_000
#: Rows of a bucket are dealt out in so many parts when they meet what is known of it.
SALTS = 32
#: Members of a star are held against one another in parts of about so many; one of more than LONG shingles counts as several.
PART, LONG = 2048, 512
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_PROBES = 1024
_SPACES = b"\t\n\x0b\x0c\r "
#: White space as one space, A-Z as a-z.
_LOWER = np.array([0x20 if b in _SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Units begin where a word does.
_JOINED = ~((np.arange(65536) // 256 == 0x20) & (np.arange(65536) % 256 != 0x20))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _probe(bins: int) -> np.ndarray:
    return (_mixed(np.arange(1, bins * _PROBES + 1, dtype=np.uint64)) % np.uint64(bins)).astype(np.int64).reshape(bins, _PROBES)


_PROBE = {bins: _probe(bins) for bins in (BINS, SKETCH)}


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its 5-word shingles; with fewer words, of all its words. texts are without null."""
    data, at = raw_bytes(texts)
    data = _LOWER[data]
    begins, sizes = split(data, at, _JOINED)
    codes, distinct = coded(data, begins)
    digest = xxhash.xxh3_64_intdigest
    words = [w.rstrip(b" ") for w in distinct.to_pylist()]
    hashes = np.array([digest(w) for w in words], np.uint64)[codes]
    full = np.array([len(w) > 0 for w in words], bool)[codes]  # white space before a text's first word is a unit too
    ends = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(sizes)])]
    hashes = hashes[full]
    total = np.full(max(len(hashes) - WORDS + 1, 0), WORDS, np.uint64)
    for j in range(WORDS):
        total += hashes[j : j + len(total)] * _MULTIPLIERS[j]
    total = _mixed(total)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= WORDS:
            own = np.sort(total[a : b - WORDS + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own if new.all() else own[new])
        elif b > a:
            few = np.full(1, b - a, np.uint64)
            for j in range(b - a):
                few += hashes[a + j : a + j + 1] * _MULTIPLIERS[j]
            out.append(_mixed(few))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets(pa.array([text or ""], pa.string()))[0]


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Densified one-permutation signatures, a row for each set; sets are not empty."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    shift = np.uint64(64 - (bins - 1).bit_length())
    bin_of = np.repeat(np.arange(len(sets)) * bins, size) + (flat >> shift).astype(np.int64)
    first = np.ones(len(flat), bool)
    np.not_equal(bin_of[1:], bin_of[:-1], out=first[1:])
    sig = np.zeros(len(sets) * bins, np.uint64)
    filled = np.zeros(len(sets) * bins, bool)
    sig[bin_of[first]], filled[bin_of[first]] = flat[first], True
    sig, filled = sig.reshape(-1, bins), filled.reshape(-1, bins)
    row, bin_ = np.nonzero(~filled)
    source = np.full(len(row), -1, np.int64)
    left = np.arange(len(row))
    for t in range(_PROBES):
        if not len(left):
            break
        probe = _PROBE[bins][bin_[left], t]
        hit = filled[row[left], probe]
        source[left[hit]] = probe[hit]
        left = left[~hit]
    for i in left:  # as good as never: the next filled bin
        source[i] = (bin_[i] + 1 + np.argmax(np.roll(filled[row[i]], -bin_[i] - 1))) % bins
    sig[row, bin_] = sig[row, source]
    return sig


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    return (_mixed(signatures(sets, SKETCH)) & np.uint64(0xFFFF)).astype(np.uint16)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    bands = sig.reshape(len(sig), BINS // ROWS, ROWS)
    key = np.broadcast_to(np.arange(1, BINS // ROWS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for j in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j])
    return key.view(np.int64)


def may_link(alike: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Which pairs may be linked, by the share of sketch bins that agree and the sizes of their sets."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (100 * small >= PER_CENT * large) & ((small < ESTIMATED) | (alike + MARGIN >= PER_CENT / 100))


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    return chunks(pc.binary_length(texts).to_pylist(), CHUNK)


@tidy
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) to (doc_id, text_key, n, fp, bands)."""
    for batch in batches:
        texts = batch.column("text").fill_null("")
        for a, b in _parts(texts):
            sets = shingle_sets(texts.slice(a, b - a))
            full = [i for i, s in enumerate(sets) if len(s)]
            fp, bands = [None] * len(sets), [None] * len(sets)
            if full:
                keys = _band_keys(signatures([sets[i] for i in full]))
                for k, i in enumerate(full):
                    fp[i], bands[i] = xxhash.xxh3_128_digest(sets[i]), keys[k]
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "text_key")), *cols], ["doc_id", "text_key", "n", "fp", "bands"])


def _full_sets(sent):
    """(text_key, text) to (fp, shingles, sketch) of the texts whose key is in the filter, about once each."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column("text_key").to_numpy()
            wanted = np.flatnonzero(passes(sent.value, keys.view(np.uint64)))
            once = []
            for i, key in zip(wanted.tolist(), keys[wanted].tolist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    once.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            texts = batch.column("text").fill_null("").take(pa.array(once, pa.int64()))
            for a, b in chunks(pc.binary_length(texts).to_pylist(), CHUNK // 2):
                sets = [s for s in shingle_sets(texts.slice(a, b - a)) if len(s)]
                if sets:
                    sketch = [x.tobytes() for x in sketches(sets)]
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sketch, pa.binary())], ["fp", "shingles", "sketch"])

    return run


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SKETCH)


def _among(sent):
    """(rid, n, bands) to (rid, n, key) of the bands in the filter."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("bands").flatten().to_numpy()
            found = np.flatnonzero(passes(sent.value, keys.view(np.uint64)))
            rid, n = (batch.column(c).to_numpy()[found // (BINS // ROWS)] for c in ("rid", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(n), pa.array(keys[found])], ["rid", "n", "key"])

    return run


@tidy
def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, sketch_a, sketch_b) to the pairs (a, b) that sizes and sketches don't rule out."""
    for batch in batches:
        if batch.num_rows:
            alike = (_sketch_rows(batch.column("sketch_a")) == _sketch_rows(batch.column("sketch_b"))).mean(axis=1)
            left = np.flatnonzero(may_link(alike, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()))
            yield batch.select(["a", "b"]).take(pa.array(left))


@tidy
def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set_a, set_b) to (a, b, linked)."""
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            s, t = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("set_a", "set_b"))
            both = np.sort(np.concatenate([s, t]), kind="stable")  # two sorted runs
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            linked[i] = 100 * same >= PER_CENT * (len(s) + len(t) - same)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])


def _compared(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, linked) of distinct pairs (a, b). A class may be in very many of them as a."""
    pairs = scratch.save(pairs, "pairs")
    met = _met(pairs, sets.select("rid", "n", "sketch"))
    met = met.select("a", "b", F.col("g_a.n").alias("n_a"), F.col("g_b.n").alias("n_b"), F.col("g_a.sketch").alias("sketch_a"), F.col("g_b.sketch").alias("sketch_b"))
    pairs = scratch.save(met.mapInArrow(_likely, "a long, b long"), "likely")
    # Only the sets of pairs that are left move.
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    met = _met(pairs, _of_rids(sets.select("rid", "shingles"), ends)).select("a", "b", F.col("g_a.shingles").alias("set_a"), F.col("g_b.shingles").alias("set_b"))
    return scratch.save(met.mapInArrow(_confirmed, "a long, b long, linked boolean"), "compared")


def _met(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """(a, b, g_a, g_b): pairs with what is told of both."""
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size")).join(told.withColumnRenamed("rid", "a"), "a")
    other = told.select(F.col("rid").alias("b"), F.struct(*(c for c in told.columns if c != "rid")).alias("g_b"))
    return with_group(pairs, hubs, ["a"], "b").withColumnRenamed("g", "g_a").join(other, "b")


def _of_rids(told: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of told whose rid is in wanted (rid), and few others."""
    sent = told.sparkSession.sparkContext.broadcast(hash_filter(wanted.select(F.xxhash64("rid").alias("id_key")), "id_key"))
    kept = told.withColumn("id_key", F.xxhash64("rid"))
    return kept.mapInArrow(passing(sent), kept.schema).drop("id_key")


def _part_near(group: pa.Table) -> pa.Table:
    """Rows (key, i, j, rid, label, asks, n, sketch) of two parts of a star to those that sizes and sketches allow a link with one of the other kind."""
    asks, label, n = (group.column(c).to_numpy() for c in ("asks", "label", "n"))
    sketch = _sketch_rows(group.column("sketch"))
    near, others = np.zeros(len(asks), bool), np.flatnonzero(~asks)
    for i in np.flatnonzero(asks).tolist():
        other = others[label[others] != label[i]]
        other = other[may_link((sketch[other] == sketch[i]).mean(axis=1), np.full(len(other), n[i]), n[other])]
        near[other] = True
        near[i] = len(other) > 0
    return group.select(["key", "i", "j", "rid", "label", "asks"]).filter(pa.array(near))


def _part_links(group: pa.Table) -> pa.Table:
    """Rows (rid, label, asks, shingles, sketch) of two parts of a star to the links (u, v) that join members that ask with the others.

    Pairs of one component, also as joined here, are left out; so are those that sizes and sketches rule out.
    """
    asks = group.column("asks").to_numpy()
    order = np.argsort(~asks, kind="stable")
    group, asking = group.take(pa.array(order)).combine_chunks(), int(np.count_nonzero(asks))
    rid, label = (group.column(c).to_numpy().copy() for c in ("rid", "label"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    sketch = _sketch_rows(group.column("sketch"))
    u, v = [], []
    for i in range(asking):
        other = np.flatnonzero(label[asking:] != label[i]) + asking
        alike = (sketch[other] == sketch[i]).mean(axis=1)
        other = other[may_link(alike, np.full(len(other), size[i]), size[other])]
        if not len(other):
            continue
        flat = np.concatenate([sets[k] for k in other.tolist()])
        at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
        ends = np.cumsum(size[other])
        same = np.add.reduceat((sets[i][at] == flat).astype(np.int64), ends - size[other])
        for k in other[100 * same >= PER_CENT * (size[i] + size[other] - same)].tolist():
            if label[k] != label[i]:
                u.append(rid[i])
                v.append(rid[k])
                label[label == label[k]] = label[i]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _stars(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(rid, n, hub) of buckets (key, rid, n, members): each hub, itself included, with all that it shares a bucket of its own with, once."""
    of = entries.groupBy("rid").agg(F.sum("members").alias("weight"), F.collect_list(F.struct("key", "members")).alias("buckets"))
    hub = F.max_by("rid", F.struct("weight", -F.col("rid"))).alias("hub")
    hubs = of.select("rid", "weight", F.inline("buckets")).groupBy("key").agg(hub, F.max("members").alias("size"))
    return scratch.save(with_group(entries, hubs, ["key"], "rid").select("rid", "n", F.col("g.hub").alias("hub")).distinct(), "stars")


def _open_links(stars: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links (u, v) of stars whose members are of several components, or None where there is no such star."""
    at = stars.join(labels, "rid", "left").select(F.col("hub").alias("key"), "rid", "n", F.coalesce("component", "rid").alias("label"))
    at = scratch.save(at, "at")
    # The most frequent component, and how much there is outside it and in all.
    of = at.groupBy("key", "label").agg(F.count(F.lit(1)).alias("members"), F.sum(F.greatest(F.lit(1.0), F.col("n") / LONG)).alias("weight"))
    most = F.struct("members", -F.col("label"))
    of = of.groupBy("key").agg(F.max_by("label", most).alias("main"), F.sum("members").alias("size"), F.count(F.lit(1)).alias("labels"), F.sum("weight").alias("all"), F.max_by("weight", most).alias("settled"))
    parts = lambda weight: F.greatest(F.lit(1), F.ceil(weight / PART)).cast("int")
    of = of.where("labels > 1").select("key", "main", "size", parts(F.col("all")).alias("parts"), parts(F.col("all") - F.col("settled")).alias("asking"))
    of = scratch.save(of, "open")
    if of.isEmpty():
        return None
    met = with_group(at, of, ["key"], "rid").where("g is not null")
    part = lambda n: F.pmod(F.xxhash64("rid", F.lit(7)), n).cast("int")
    every = lambda n, cell: F.transform(F.sequence(F.lit(0), n - 1), cell)
    cell = lambda i, j, asks: F.struct(F.col("key").alias("key"), i.alias("i"), j.alias("j"), F.lit(asks).alias("asks"))
    others = every(F.col("g.asking"), lambda i: cell(i, part(F.col("g.parts")), False))
    asking = every(F.col("g.parts"), lambda j: cell(part(F.col("g.asking")), j, True))
    met = met.select("rid", "n", "label", F.when(F.col("label") == F.col("g.main"), others).otherwise(F.concat(others, asking)).alias("cells"))
    # A sketch and a set meet all cells of their class at once.
    met = met.groupBy("rid", "n", "label").agg(F.flatten(F.collect_list("cells")).alias("cells")).join(sets.select("rid", "sketch"), "rid")
    both = met.select("rid", "n", "label", "sketch", F.explode("cells").alias("cell")).select("cell.*", "rid", "label", "n", "sketch")
    near = both.groupBy("key", "i", "j").applyInArrow(_part_near, "key long, i int, j int, rid long, label long, asks boolean")
    near = scratch.save(near, "near")
    scratch.settle()
    if near.isEmpty():
        return None
    # Only the sets of members that are left move.
    left = near.groupBy("rid", "label").agg(F.collect_list(F.struct("key", "i", "j", "asks")).alias("cells"))
    left = left.join(_of_rids(sets.select("rid", "shingles", "sketch"), near.select("rid").distinct()), "rid")
    both = left.select("rid", "label", "shingles", "sketch", F.explode("cells").alias("cell")).select("cell.*", "rid", "label", "shingles", "sketch")
    return both.groupBy("key", "i", "j").applyInArrow(_part_links, "u long, v long")


def _bucket_links(stars: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(rid, component) of the classes linked within stars (rid, n, hub)."""
    told = _compared(stars.where("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")), sets, scratch)
    scratch.settle()
    known = connected_components(told.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    known = scratch.save(known.withColumnRenamed("node", "rid"), "labels")
    links = _open_links(stars, known, sets, scratch)
    if links is None:
        return known
    links = scratch.save(links.distinct(), "links")
    # They join components that are there already, by their least members.
    name = lambda c: known.select(F.col("rid").alias(c), F.col("component").alias(f"{c}_of"))
    joined = links.join(name("u"), "u", "left").join(name("v"), "v", "left")
    joined = connected_components(joined.select(F.coalesce("u_of", "u").alias("u"), F.coalesce("v_of", "v").alias("v")), scratch)
    old = known.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("rid", F.coalesce("now", "component").alias("component"))
    fresh = joined.join(known.select(F.col("rid").alias("node")), "node", "left_anti").select(F.col("node").alias("rid"), "component")
    return scratch.save(old.unionByName(fresh), "joined")


def near_duplicate_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept), a row for each row of docs (doc_id, text).

    text_key is xxhash64 of the text.
    """
    spark = docs.sparkSession
    cols = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = cols.mapInArrow(_describe, f"doc_id {kind}, text_key long, n long, fp binary, bands array<long>")
    with small_batches(docs.sparkSession):
        told = scratch.save(told.withColumn("rid", F.monotonically_increasing_id()), "described")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")
    classes = told.where("n > 0").groupBy("fp").agg(F.min("rid").alias("cls"), F.count(F.lit(1)).alias("size"), first)
    classes = scratch.save(classes, "classes")
    reps = told.where("n > 0").join(classes.select(F.col("cls").alias("rid")), "rid", "left_semi")
    reps = scratch.save(reps.select("rid", "text_key", "n", "fp", "bands"), "reps")

    banded = reps.select("rid", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sent = spark.sparkContext.broadcast(hash_filter(shared, "key"))
    # Most bands are of one class and go no further.
    banded = scratch.save(reps.select("rid", "n", "bands").mapInArrow(_among(sent), "rid long, n long, key long"), "banded")
    scratch.settle()
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("rid").alias("first"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")).where("members > 1")
    one = buckets.groupBy("members", "first", "x", "y").agg(F.min("key").alias("key"))  # of buckets with the same members
    one = one.select("key", "members", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt")
    entries = scratch.save(banded.select("rid", "n", "key", salt).join(one, ["key", "salt"]).select("key", "rid", "n", "members"), "entries")
    labels = None
    if not entries.isEmpty():
        met = scratch.save(reps.drop("bands").join(entries.select("rid").distinct(), "rid", "left_semi"), "met")
        sent = spark.sparkContext.broadcast(hash_filter(met, "text_key"))
        sets = cols.select("text_key", "text").mapInArrow(_full_sets(sent), "fp binary, shingles binary, sketch binary")
        # A set has one class, so its copies are where the join has brought it.
        sets = scratch.save(sets.join(met.select("rid", "n", "fp"), "fp").dropDuplicates(["fp"]).select("rid", "n", "shingles", "sketch"), "sets")
        scratch.drop(reps, met)
        scratch.settle()
        labels = _bucket_links(_stars(entries, scratch), sets, scratch)
        scratch.drop(sets)
        scratch.settle()

    if labels is not None:
        own = classes.join(labels.withColumnRenamed("rid", "cls"), "cls", "left").withColumn("node", F.coalesce("component", "cls")).select("fp", "size", "node", "least")
        own = scratch.save(own, "nodes")
        of = own.groupBy("node").agg(F.min("least").alias("best"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
        classes = with_group(own, scratch.save(of, "components"), ["node"], "fp", "classes").select("fp", "size", F.coalesce("g.best", "least").alias("least"))
    rows = with_group(told.where("n > 0").select("doc_id", "text_key", "rid", "n", "fp"), classes, ["fp"], "rid")
    rows = rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("g.least.doc_id").alias("component_id"), (F.col("rid") == F.col("g.least.rid")).alias("kept"))
    return rows.unionByName(told.where("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text, ...).

    Words are runs of other than ASCII white space, with A-Z lower-cased. Null and empty texts and
    texts without words have n_shingles 0 and are components of their own, each row. component_id is the
    least doc_id of the component; a null doc_id only where no member has one. kept marks one row
    of each component, that of component_id; of rows with that doc_id, the first read. An empty
    table gives no rows. Other columns are not read.
    """
    return near_duplicate_rows(docs, Scratch(docs.sparkSession, "near-dedup")).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with all columns."""
    scratch = Scratch(docs.sparkSession, "near-dedup-keep")
    return keep_rows(docs, near_duplicate_rows(docs, scratch).select("doc_id", "text_key", "kept"), F.xxhash64("text"), scratch)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
