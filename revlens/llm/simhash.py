"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced.

A fingerprint has 64 bits; a bit is 1 if it is set in more than half of the text's shingle hashes. Fingerprints within
RADIUS bits are linked, and documents form the components of the links. Of BLOCKS blocks of bits at most RADIUS differ
between linked fingerprints, so they agree in BLOCKS - RADIUS of them: distinct fingerprints are dealt by each choice of
so many blocks (their numbers and values, some 26 bits) and compared only there.

Bit planes are stored vertically: word w of plane b holds bit b of 64 fingerprints. Many small buckets share one set of
planes, and each member is compared with the one d places further on, 64 members at a time, for d = 1, 2, ... up to the
largest bucket's size; in a large bucket, one fingerprint is compared with all planes at once. Either way the planes'
differences are added by carry-save bitwise counters, and words are abandoned as soon as all of their counters are
beyond the radius. Of each bucket only a spanning forest leaves the task. Buckets larger than TILE fingerprints are split
into tiles, and each pair of tiles is a bucket of its own, so no task meets an unbounded bucket and no pair is lost.

Defined results: null and empty texts have fingerprint zero, which links like any other; documents of equal
fingerprints (copies) are one node; very long texts are hashed whole, their bits counted in parts; repeated rows each
get their row; ids are cast to long; a null doc_id is never a component's id unless all of the component's are null; an
empty table gives an empty result; other columns are ignored by `near_duplicates` and kept by `keep_one`, which breaks
ties between rows of equal id by a hash of their columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import shingle_join
from revlens.llm.common import ready, released, table, text_or_empty, written
from revlens.operators.components import components

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
#: Blocks of bits: fingerprints are dealt by the values of BLOCKS - RADIUS of them.
BLOCKS = 5
#: Fingerprints of a bucket up to which it shares its planes with others; fingerprints that are compared together.
SMALL, TOGETHER = 64, 1 << 16
#: Fingerprints of a bucket that one task compares with one another; larger buckets are tiled.
TILE = 8192
#: Hashes whose bits are counted at a time.
_COUNT = 1 << 16


def fingerprint(text: str) -> int:
    """The text's fingerprint as an unsigned number. Only A-Z are lower-cased, words end at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in more than half of the hashes; zero if there are none."""
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), _COUNT):
        bits = np.unpackbits(hashes[a : a + _COUNT].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column("t")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.int64())], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp: the fingerprint as a signed long with the same bits."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    return rows.mapInArrow(released(_fingerprints), "id long, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """BITS x words: bit i of word w of plane b is bit b of values[64 * w + i]; the last word is padded with zeros."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def beyond(differences: Callable[[int, np.ndarray], np.ndarray], over: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Words whose bits mark what differs in more than `radius` planes, or is marked in `over` already.

    differences(b, words): plane b of those words. The counters' bits of weight 1, 2, 4 and so on hold the number of
    differing bits of 64 members a word; words that are marked whole are left out of the further planes.
    """
    result, words = over.copy(), np.flatnonzero(over != _FULL)
    over = over[words]
    counters = [np.zeros(len(words), np.uint64) for _ in range(max(1, radius.bit_length()))]
    exact_power = radius + 1 == 1 << len(counters)
    for b in range(BITS):
        carry = differences(b, words)
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if not exact_power:
            # the counters hold numbers beyond the radius too: compare them with it
            more, equal = np.zeros(len(words), np.uint64), np.full(len(words), _FULL)
            for i in range(len(counters) - 1, -1, -1):
                if radius >> i & 1:
                    equal &= counters[i]
                else:
                    more |= equal & counters[i]
                    equal &= ~counters[i]
            over |= more
        if b % 8 == 7:
            open_ = over != _FULL
            if not open_.all():
                result[words[~open_]] = _FULL
                words, over, counters = words[open_], over[open_], [c[open_] for c in counters]
                if not len(words):
                    break
    result[words] = over
    return result


def within(planes: np.ndarray, value: int, radius: int = RADIUS) -> np.ndarray:
    """Words whose bits mark the members of `planes` within `radius` bits of `value`."""
    return ~beyond(lambda b, words: planes[b, words] ^ (_FULL if value >> b & 1 else np.uint64(0)), np.zeros(planes.shape[1], np.uint64), radius)


def bucket_pairs(values: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within `radius` bits inside the buckets of `values`; `sizes`, descending, SMALL at most."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    planes = np.pad(bit_planes(values), ((0, 0), (0, 1)))
    u, v = [], []
    for d in range(1, int(sizes[0]) if len(sizes) else 0):
        n = int(sizes[sizes > d].sum())  # members of buckets that reach so far come first
        pairs = np.zeros(-(-n // 64) * 64, bool)
        pairs[:n] = np.arange(n) + d < ends[:n]
        low, high = np.uint64(d), np.uint64(64 - d)

        def differ(b: int, words: np.ndarray) -> np.ndarray:
            here = planes[b, words]
            return here ^ (here >> low | planes[b, words + 1] << high)  # noqa: B023

        over = beyond(differ, ~np.packbits(pairs, bitorder="little").view("<u8"), radius)
        at = np.flatnonzero(np.unpackbits((~over).astype("<u8").view(np.uint8), bitorder="little"))
        u.append(at)
        v.append(at + d)
    return (np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Forest:
    """Keeps the edges that join two trees."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.u: list[int] = []
        self.v: list[int] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[b] = a
            self.u.append(i)
            self.v.append(j)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.u, np.int64), np.array(self.v, np.int64)


def forest(values: np.ndarray, radius: int = RADIUS, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indices) of a spanning forest of the links among `values`, or among `values` and `other` (numbered after them)."""
    targets, shift = (values, 0) if other is None else (other, len(values))
    trees, planes = _Forest(len(values) + (0 if other is None else len(other))), bit_planes(targets)
    for i, value in enumerate(values.tolist()):
        near = np.flatnonzero(np.unpackbits(within(planes, value, radius).astype("<u8").view(np.uint8), bitorder="little")[: len(targets)])
        for j in (near[near > i] if other is None else near).tolist():
            trees.add(i, j + shift)
    return trees.edges()


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, a, b) to links; side tells which tile a member is of."""

    def out(fp: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp[u], pa.int64()), pa.array(fp[v], pa.int64())], ["u", "v"])

    def compare(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = ends - starts
        tiled = np.maximum.reduceat(x[4], starts) > 0 if len(starts) else np.zeros(0, bool)
        few = np.flatnonzero((sizes > 1) & (sizes <= SMALL) & ~tiled)
        few = few[np.argsort(-sizes[few], kind="stable")]
        if len(few):
            n = sizes[few]
            fp = x[3, np.repeat(starts[few] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            u, v = bucket_pairs(fp.view(np.uint64), n)
            trees = _Forest(len(fp))
            for i, j in zip(u.tolist(), v.tolist(), strict=True):
                trees.add(i, j)
            yield out(fp, *trees.edges())
        for i in np.flatnonzero((sizes > SMALL) | tiled & (sizes > 1)).tolist():
            fp, side = x[3, starts[i] : ends[i]], x[4, starts[i] : ends[i]]
            members, other = fp[side == 0], fp[side == 1]
            u, v = forest(members.view(np.uint64), other=other.view(np.uint64) if len(other) else None)
            yield out(np.concatenate([members, other]), u, v)

    held: list[np.ndarray] = []
    n_held = 0
    for batch in batches:
        held.append(np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "a", "b", "fp", "side")]))
        n_held += batch.num_rows
        if n_held >= TOGETHER:
            x = np.concatenate(held, axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((x[:3, 1:] != x[:3, :-1]).any(axis=0)) + 1])
            yield from compare(x, cuts[:-1], cuts[1:])
            held, n_held = [x[:, cuts[-1] :]], x.shape[1] - int(cuts[-1])
    if n_held:
        x = np.concatenate(held, axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((x[:3, 1:] != x[:3, :-1]).any(axis=0)) + 1, [x.shape[1]]])
        yield from compare(x, cuts[:-1], cuts[1:])


def _keys() -> Column:
    """One long for each choice of blocks: its number above the blocks' bits."""
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS)):
        key = F.lit(number).cast("long")
        for i in chosen:
            width = edges[i + 1] - edges[i]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def buckets(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """key, a, b, fp, side, dealt and sorted by bucket (key and pair of tiles): the fingerprints that share a key with others."""
    keyed = distinct.select("fp", F.explode(_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = keyed.join(shared, F.col("key") == F.col("k"))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = (
        dealt.select("key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with"))
        .select("key", "fp", F.least("mine", "with").alias("a"), F.greatest("mine", "with").alias("b"), (F.col("mine") > F.col("with")).cast("int").alias("side"))
    )
    return tiled.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").select("key", "a", "b", "fp", "side")


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """u, v: links that connect the same fingerprints as all pairs within RADIUS would. `distinct`: fp."""
    return buckets(distinct, tile).mapInArrow(released(_bucket_links), "u long, v long")


def grouped(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """id, fp, component_id of written rows (id, fp): components of the links `found` (else those of op7), named by their least id."""
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes.select("fp")) if found is None else found)
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    by_fp = placed.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return rows.join(by_fp, F.col("fp") == F.col("f"), "left").select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row."""
    return grouped(written(fingerprints(docs, id_col, text_col))).withColumnRenamed("id", "doc_id")


def _marked(length: int):
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_join.shingles(t.as_py(), length) for t in batch.column("t")]
            values = [pa.array(np.array([f(s) for s in sets], np.uint64).view(np.int64), pa.int64()) for f in (shingle_join.signature, majority)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *values], ["row", "fp", "print"])

    return marked


def likely(rows: DataFrame) -> DataFrame:
    """u, v: pairs of the signatures (`fp`) whose fingerprints (`print`) are equal or linked, as many as connect them."""
    marks = written(rows.select("fp", "print").distinct())
    least = marks.groupBy("print").agg(F.min("fp").alias("least"))
    equal = marks.join(least, "print").where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    near = links(least.select(F.col("print").alias("fp")))
    u = least.select(F.col("print").alias("u"), F.col("least").alias("lu"))
    v = least.select(F.col("print").alias("v"), F.col("least").alias("lv"))
    return equal.union(near.join(u, "u").join(v, "v").select("lu", "lv"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = shingle_join.SHINGLE, similarity: float = shingle_join.SIMILARITY
) -> DataFrame:
    """Of each component one row stays: that of least id, rows without ids after all others; of repeats of it any one.

    Components are those of all pairs whose sets of `shingle` words have a Jaccard similarity of `similarity` or more.
    Fingerprints of these shingles, linked as above, name pairs that are verified first; shingle_join finds what links
    are beyond the radius.
    """
    ready(docs.sparkSession)
    common = shingle_join.common_shingles(docs, text_col, shingle)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kind = docs.select(packed).schema["row"].dataType.simpleString()
    with_fp = docs.select(packed, text_or_empty(text_col).alias("t")).mapInArrow(released(_marked(shingle)), f"row {kind}, fp long, print long")
    rows = written(with_fp.select("row", "fp", "print", F.monotonically_increasing_id().alias("id")))
    light = rows.select("id", "fp")
    found = shingle_join.links(rows.select("id", "fp", text_or_empty(f"row.`{text_col}`").alias("t")), common, shingle, similarity, likely(rows))
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("content"), F.col("of"))
    content = F.xxhash64(*[F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    ids = rows.select(F.col("id").alias("of"), F.col(f"row.`{id_col}`").alias("_id"), content.alias("content"))
    best = grouped(light, found).join(ids, F.col("id") == F.col("of")).groupBy("component_id").agg(F.min_by("of", order).alias("keep"))
    return rows.join(best, F.col("id") == F.col("keep"), "left_semi").select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
