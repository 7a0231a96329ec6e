"""Links of texts whose sets of word shingles have a Jaccard similarity of a threshold or more: none is lost.

Shingles are hashed to 64 bits and ordered by (common in a sample, hash), the same order in every text. Two sets of
similarity t share at least t of either, so their prefixes, the first n - ceil(t n) + MEET shingles of n, meet in MEET
shingles (sets too small for that in one). Prefixes are dealt by shingle, sets of too different sizes aren't paired, and
each pair that meets is verified on the whole texts. The sample only moves shingles of many texts out of the prefixes: it never changes a result.

Groups of near copies aren't paired out. First a few pairs a set are verified: those that the caller names, and each set
with the least one of the shingles that it was dealt by. What they link is one component, and only sets of different
components are paired then: at first each set of a bucket with one other, then all that are still apart. Shingles of more than TILE sets are split into tiles, and each pair of tiles is a bucket of its own.

A pair leaves its bucket only if its sketches allow the similarity: a sketch holds, for each of SKETCH bits, the parity
of the set's shingles that fall on it, so two sketches differ in at most as many bits as the sets in shingles, and sets of
similarity t differ in at most (1 - t) / (1 + t) of their sizes' sum. This loses no link. Sketches tell sets apart up to
some 1,200 shingles; larger sets are rarely paired, since their prefixes hold no shingles that many texts share.

Defined results: words are those of op7; a text of fewer words than a shingle has one shingle of all its words, and
texts without words have equal, empty sets. Texts of equal sets are one node. Equal 64-bit hashes count as equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import bitmap
from revlens.llm.common import released, text_or_empty, written
from revlens.operators.components import components
from revlens.plans.durable import unshuffled

SHINGLE, SIMILARITY = 5, 0.8
#: Shingles of their prefixes that a pair must share before it is verified; any number gives the same result.
MEET = 4
#: Texts of the sample; a shingle of at least COMMON of them is common; most common shingles that are told to the tasks.
SAMPLE, COMMON, MOST_COMMON = 20_000, 16, 1 << 18
#: Bits of a dealt shingle's hash; the others of its long hold the set's size.
_HASH, _SIZE = 40, 24
#: Sets of a shingle that one task pairs; more are tiled.
TILE = 8192
#: Pairs that are compared in a bucket at a time, about.
_PAIRS = 1 << 18
#: Bits of a sketch, and its columns of 64 bits.
SKETCH = 512
_WORDS = [f"sketch{i}" for i in range(SKETCH // 64)]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, length: int = SHINGLE) -> np.ndarray:
    """The set of the text's shingles as sorted hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    length = min(length, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - length + 1
    out = np.full(n, length, np.uint64)
    for i in range(length):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.astype("<u8").tobytes())


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH bits as 64-bit words: the parity of the shingles that fall on each."""
    odd = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def prefix(s: np.ndarray, common: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The shingles of which sets of this similarity share MEET; `common` is sorted."""
    n = len(s) - math.ceil(similarity * len(s) - 1e-9) + MEET
    if len(common) and len(s):
        last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        s = np.concatenate([s[~last], s[last]])
    return s[:n]


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def common_shingles(docs: DataFrame, text_col: str, length: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts of a bounded sample have."""
    share = max(1, docs.count() // SAMPLE)
    t = text_or_empty(text_col)
    texts = docs.where(F.pmod(F.xxhash64(t), F.lit(share)) == 0).select(t.alias("t"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("t"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), length).view(np.int64))], ["h"])

    many = texts.mapInArrow(released(each), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    with unshuffled(docs.sparkSession):
        rows = many.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow()  # at most 2 MB
    return np.sort(np.asarray(rows.column("h")).astype(np.int64).view(np.uint64))


def _dealt(common, length: int, similarity: float):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sketches = [], [np.zeros((0, len(_WORDS)), np.uint64)]
            for t in batch.column("t"):
                s = shingles(t.as_py(), length)
                h = np.unique(prefix(s, common.value, similarity) >> np.uint64(64 - _HASH))
                keys.append((h << np.uint64(_SIZE) | np.uint64(min(len(s), (1 << _SIZE) - 1))).view(np.int64))
                sketches.append(sketch(s)[None])
            words = np.concatenate(sketches).view(np.int64).T
            arrays = [batch.column("fp"), pa.array(keys, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(w)) for w in words)]
            yield pa.RecordBatch.from_arrays(arrays, ["fp", "keys", *_WORDS])

    return deal


def _candidates(similarity: float, one: bool = False):
    """The pairs that the sketches allow; with `one`, for each set of a bucket only that with the least signature."""

    def bucket(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of different components among one bucket's sets: each set beyond the most frequent component with all others."""
        x = x[:, np.argsort(x[3], kind="stable")]
        fp, size, root, side = x[2], x[3], x[4], x[5]
        marks = np.ascontiguousarray(x[6:].T).view(np.uint64)
        names, which, counts = np.unique(root, return_inverse=True, return_counts=True)
        rest = which != counts.argmax()
        tiled = side.any()
        of = np.flatnonzero(rest)
        low = np.searchsorted(size, np.ceil(size[of] * similarity - 1e-6), "left")
        counts = np.searchsorted(size, np.floor(size[of] / similarity + 1e-6), "right") - low
        total = np.concatenate([[0], np.cumsum(counts)])
        a = 0
        while a < len(of):
            b = max(a + 1, int(np.searchsorted(total, total[a] + _PAIRS, "right")) - 1)
            i = np.repeat(of[a:b], counts[a:b])
            j = np.repeat(low[a:b], counts[a:b]) + np.arange(len(i)) - np.repeat(total[a:b] - total[a], counts[a:b])
            wanted = root[i] != root[j]
            if not one:
                wanted &= ~rest[j] | (i < j)
            if tiled:
                wanted &= side[i] != side[j]
            i, j = i[wanted], j[wanted]
            differing = np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64)
            near = differing <= (size[i] + size[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6
            i, j = i[near], j[near]
            if one and len(i):
                order = np.lexsort((fp[j], i))
                order = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])]
                i, j = i[order], j[order]
            # a set that can share fewer than MEET is verified at once
            met = np.where(np.minimum(size[i], size[j]) * similarity <= MEET, MEET, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[i], fp[j])), pa.array(np.maximum(fp[i], fp[j])), pa.array(met)], ["u", "v", "met"])
            a = b

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (shingle, tiles); a bucket has 2 * TILE rows, about, at most."""
        held: list[np.ndarray] = []

        def pairs(x: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((x[:2, 1:] != x[:2, :-1]).any(axis=0)) + 1
            starts = np.concatenate([[0], cuts, [x.shape[1]] if last else []]).astype(np.int64)
            for i in np.flatnonzero(np.diff(starts) > 1):
                yield from bucket(x[:, starts[i] : starts[i + 1]])
            held[:] = [] if last else [x[:, starts[-1] :]]

        for batch in batches:
            x = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("shingle", "tiles", "fp", "size", "root", "side", *_WORDS)])
            held.append(x)
            if x.shape[1] and (x[:2, -1] != held[0][:2, 0]).any():
                yield from pairs(np.concatenate(held, axis=1), False)
        if held:
            yield from pairs(np.concatenate(held, axis=1), True)

    return find


def _verified(length: int, similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}

            def read(fp: int, t: pa.StringScalar) -> np.ndarray:
                if fp not in sets:  # noqa: B023
                    sets[fp] = shingles(t.as_py(), length)  # noqa: B023
                return sets[fp]  # noqa: B023

            columns = [batch.column(c) for c in ("u", "v", "tu", "tv")]
            keep = [similar(read(u.as_py(), tu), read(v.as_py(), tv), similarity) for u, v, tu, tv in zip(*columns, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _similar_pairs(rows: DataFrame, pairs: DataFrame, length: int, similarity: float) -> DataFrame:
    """Those of the written `pairs` (u, v) whose texts are similar."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    # one row of each signature gives its text; the bitmap leaves few others, which the join takes out: a copied text
    # would repeat all its pairs
    keys = written(rows.select("id", "fp").join(nodes, F.col("fp") == F.col("node"), "left_semi").groupBy("fp").agg(F.min("id").alias("key")).select("key"))
    bits = bitmap.size(keys.count())
    words = bitmap.column(bitmap.collect(keys, bits), rows.sparkSession)
    passed = rows.crossJoin(F.broadcast(words)).where(bitmap.test(F.col("id"), bits)).select("id", "fp", "t")
    texts = passed.join(keys, F.col("id") == F.col("key"), "left_semi").select("fp", "t")
    both = pairs.join(texts.select(F.col("fp").alias("u"), F.col("t").alias("tu")), "u").join(texts.select(F.col("fp").alias("v"), F.col("t").alias("tv")), "v")
    return both.select("u", "v", "tu", "tv").mapInArrow(released(_verified(length, similarity)), "u long, v long")


def _buckets(shared: DataFrame, roots: DataFrame, sketches: DataFrame, tile: int) -> DataFrame:
    """The sets of each shingle that has several components, with sketches, dealt and sorted by shingle and pair of tiles."""
    placed = shared.join(roots, F.col("fp") == F.col("node"), "left").select("shingle", "size", "fp", F.coalesce("root", "fp").alias("root")).distinct()
    several = placed.groupBy("shingle").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("first") != F.col("last"))
    counted = several.select(F.col("shingle").alias("s"), F.ceil(F.col("n") / tile).cast("long").alias("count"))
    mine = F.pmod(F.xxhash64("fp"), F.col("count"))
    marked = placed.join(counted, F.col("shingle") == F.col("s")).join(sketches, F.col("fp") == F.col("of"))
    tiled = marked.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    tiles = F.least("mine", "with") * F.col("count") + F.greatest("mine", "with")
    dealt = tiled.select("shingle", tiles.alias("tiles"), "fp", "size", "root", (F.col("mine") > F.col("with")).cast("long").alias("side"), *_WORDS)
    return dealt.repartition("shingle", "tiles").sortWithinPartitions("shingle", "tiles")


def links(
    rows: DataFrame, common: np.ndarray, length: int = SHINGLE, similarity: float = SIMILARITY, first: DataFrame | None = None, tile: int = TILE
) -> DataFrame:
    """u, v: links that connect the same signatures as all pairs of at least this similarity would.

    `rows`, written: id (different), fp (signature), t. `first`: pairs (u, v) of signatures that are likely similar.
    """
    known = rows.sparkSession.sparkContext.broadcast(common)
    columns = ", ".join(["fp long", "keys array<long>", *(f"{w} long" for w in _WORDS)])
    dealt = written(rows.select("fp", "t").mapInArrow(released(_dealt(known, length, similarity)), columns))
    sketches = dealt.groupBy(F.col("fp").alias("of")).agg(*(F.min(w).alias(w) for w in _WORDS))  # equal in copies
    sets = dealt.select("fp", F.explode("keys").alias("key")).select(F.shiftrightunsigned("key", _SIZE).alias("shingle"), F.col("key").bitwiseAND(F.lit((1 << _SIZE) - 1)).alias("size"), "fp")
    least = sets.groupBy("shingle").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select(F.col("shingle").alias("s"), "least")
    shared = written(sets.join(least, F.col("shingle") == F.col("s")).select("shingle", "size", "fp", "least"))
    met = F.when(F.col("size") * similarity <= MEET, MEET).otherwise(1)
    led = shared.where("fp <> least").distinct().groupBy(F.col("least").alias("u"), F.col("fp").alias("v")).agg(F.sum(met).alias("met")).where(F.col("met") >= MEET)
    likely = led.select("u", "v")
    if first is not None:
        likely = likely.union(first.select(F.least("u", "v"), F.greatest("u", "v")).where("u <> v")).distinct()
    roots = components(_similar_pairs(rows, written(likely), length, similarity))
    # sets that differ from the least one of a shingle may still be similar to each other: link each with one neighbour,
    # so that the last round meets few pairs of a group of near copies
    one = _buckets(shared, roots, sketches, tile).mapInArrow(released(_candidates(similarity, True)), "u long, v long, met long")
    linked = _similar_pairs(rows, written(one.select("u", "v").distinct()), length, similarity)
    roots = written(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(linked)))
    found = _buckets(shared, roots, sketches, tile).mapInArrow(released(_candidates(similarity)), "u long, v long, met long")
    others = written(found.groupBy("u", "v").agg(F.sum("met").alias("met")).where(F.col("met") >= MEET).select("u", "v"))
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(_similar_pairs(rows, others, length, similarity))
