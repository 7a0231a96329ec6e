"""Suffix-array removal of every repeated string of MATCH bytes.

A sparse suffix array: only suffixes at anchors are sorted (see `anchors`; equal windows of MATCH bytes have equal
anchors), and of those only the ones whose first K bytes occur again, found by counting gram hashes over the corpus
and passed to a second scan as a bitmap of bounded size. Each remaining anchor becomes a segment: the bytes of its
windows. Spark samples splitters and range-partitions the segments by their leading bytes (and by a salt, so that one
passage in a third of all texts is spread over many tasks); each bucket sorts the suffixes that run right from the
anchors, and the reversed prefixes that run left, by multikey quicksort on eight-byte words. Two occurrences of a
window agree in o bytes to the left and MATCH - o to the right, which the common prefixes of neighbours in the two
orders tell for all o at once. Groups cut by a bucket's boundary send their windows' fingerprints to a comparison
across boundaries.

Segments of equal bytes that are read together travel once. Texts that are copies of one another are wholly covered;
they are found by SHA-256.

Defined results: a null text is an empty one; texts under MATCH bytes lose nothing; a very long text is read in parts, so
that memory beside the text doesn't grow with it; all occurrences of a repeated string go, so there are no ties;
repeated rows are occurrences of each other; two rows are taken for the same if their ids and 64-bit hashes of their
texts agree; ids are cast to long; a null doc_id is kept; an empty table gives an empty result; other columns are
ignored by `removed` and kept by `strip`.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import anchors, bitmap
from revlens.llm.anchors import MATCH, K
from revlens.llm.common import ready, released, table, text_or_empty, written

#: Leading bytes by which segments are dealt.
LEAD = 16
#: Segments that are sorted at a time. Groups of equal leading bytes with more are salted; only they may be cut by a
#: bucket's boundary or by the end of a run.
BUCKET = 20_000
#: Tasks that share a hot leading key at most.
SALTS = 4096
#: Anchors that are turned to segments at a time; what tells the parts of a long text apart.
_ANCHORS, _PART = 20_000, 0x5851F42D4C957F2D
_LEFT = MATCH - K


# --- first scan: which grams occur again


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ctx, least and greatest text hash, whether one text has it more than once; one row for each gram of a part.

    A further part of a long text counts as a text of its own, so that grams of two parts count as repeated.
    """
    for batch in batches:
        th = np.asarray(batch.column("th"))
        for text, _, _, _, ctx, part in anchors.parts(batch.column("t").cast(pa.binary()).to_pylist()):
            order = np.lexsort((text, ctx))
            c, t = ctx[order], text[order]
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
            if len(first):
                of = th[t] + part[order] * _PART
                again = np.concatenate([(c[1:] == c[:-1]) & (t[1:] == t[:-1]), [False]])
                least, most, many = np.minimum.reduceat(of, first), np.maximum.reduceat(of, first), np.logical_or.reduceat(again, first)
                yield pa.RecordBatch.from_arrays([pa.array(c[first]), pa.array(least), pa.array(most), pa.array(many)], ["ctx", "least", "most", "many"])


# --- second scan: segments


_SEGMENTS = "kind int, k long, th long, n_bytes long, sha string, start long, end long, lead binary, seg binary, off int, many boolean"
_SEGMENT_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.bool_())
META, SEGMENT, FOUND = 0, 1, 2


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _segments(words):
    names = [c.split()[0] for c in _SEGMENTS.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SEGMENT_TYPES, strict=True)], names)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").cast(pa.binary()).to_pylist()
            ks, ths = batch.column("k").to_pylist(), batch.column("th").to_pylist()
            yield out([(META, k, th, len(t), hashlib.sha256(t).hexdigest(), None, None, None, None, None, None) for k, th, t in zip(ks, ths, texts, strict=True)])
            for text, place, first, last, ctx, _ in anchors.parts(texts):
                hits = np.flatnonzero(bitmap.passes(words.value, ctx))
                # so many at a time, as a text of one character has an anchor at every byte
                for x in range(0, len(hits), _ANCHORS):
                    rows: list[tuple] = []
                    same: dict[tuple[bytes, int], list[tuple[int, int, int]]] = defaultdict(list)
                    for i, p, a, b in zip(*(c[hits[x : x + _ANCHORS]].tolist() for c in (text, place, first, last)), strict=True):
                        same[texts[i][a : b + MATCH], p - a].append((i, a, b + MATCH))
                    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
                    for (seg, off), at in same.items():
                        i, a, b = at[0]
                        rows.append((SEGMENT, ks[i], ths[i], None, None, a, b, seg[off : off + LEAD], seg, off, len(at) > 1))
                        if len(at) > 1:
                            for i, a, b in at:
                                found[i].append((a, b))
                    for i, spans in found.items():
                        rows += [(FOUND, ks[i], ths[i], None, None, a, b, None, None, None, None) for a, b in union(spans)]
                    yield out(rows)

    return segments


# --- buckets


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of equally long byte rows: by the first eight bytes, then ties by the next eight, and so on."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    key = words[order, 0]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    for j in range(1, words.shape[1]):
        group = np.cumsum(new)
        tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))  # members of groups of two or more
        if not len(tied):
            break
        rank = np.lexsort((words[order[tied], j], group[tied]))  # groups stay where they are
        order[tied] = order[tied][rank]
        key, g = words[order[tied], j], group[tied]
        new[tied] = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before it in the order; 0 for the first."""
    x = rows[order]
    differ = x[1:] != x[:-1]
    lengths = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], lengths])


def repeated_windows(segs: list[bytes], off: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, valid): n x (windows by bytes left of the anchor); a segment that is `many` stands for two or more."""
    n = len(segs)
    right = np.frombuffer(b"".join(s[o : o + MATCH].ljust(MATCH, b"\0") for s, o in zip(segs, off.tolist(), strict=True)), np.uint8).reshape(n, MATCH)
    left = np.frombuffer(b"".join(s[:o][::-1].ljust(_LEFT, b"\0") for s, o in zip(segs, off.tolist(), strict=True)), np.uint8).reshape(n, _LEFT)
    low = MATCH - (np.array([len(s) for s in segs]) - off)
    steps = np.arange(_LEFT + 1)
    valid = (low[:, None] <= steps) & (steps <= off[:, None])
    repeated = np.zeros_like(valid)
    orders = []
    for rows in (left, right):
        order = multikey_order(rows)
        orders.append((order, common_prefixes(rows, order)))
    weight = np.where(many, 2, 1)
    for o in steps.tolist():
        rows = np.flatnonzero(valid[:, o])
        if not len(rows):
            continue
        key = np.zeros(n, np.int64)
        for (order, prefix), depth in zip(orders, (o, MATCH - o), strict=True):
            cls = np.empty(n, np.int64)
            cls[order] = np.cumsum(prefix < depth)  # rows that agree in `depth` bytes are neighbours in the order
            key = key * (n + 1) + cls
        by = np.argsort(key[rows], kind="stable")
        k = key[rows][by]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        group = np.cumsum(new) - 1
        total = np.bincount(group, weight[rows][by])
        repeated[rows[by], o] = total[group] > 1
    return repeated, valid


_BUCKETS = "k long, th long, start long, end long, f1 long, f2 long, n int"
_BUCKET_TYPES = (*[pa.int64()] * 6, pa.int32())
_BUCKET_NAMES = ["k", "th", "start", "end", "f1", "f2", "n"]


def _bucket(run: list[tuple], cut: set[bytes]) -> Iterator[pa.RecordBatch]:
    """Sorted segments (lead, seg, off, many, k, th, start) to repeated spans and, for groups in `cut`, fingerprints."""
    leads, segs, off, many, k, th, start = zip(*run, strict=True)
    off, many = np.array(off, np.int64), np.array(many, bool)
    repeated, valid = repeated_windows(list(segs), off, many)
    k, th, anchor = np.array(k, np.int64), np.array(th, np.int64), np.array(start, np.int64) + off
    shown = repeated & ~many[:, None]
    edge = np.diff(np.pad(shown, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)  # in the same order: bytes left of the anchor from a to b - 1
    spans = [k[row], th[row], anchor[row] - (b - 1), anchor[row] - a + MATCH]
    none = pa.nulls(len(row), pa.int64())
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in spans), none, none, pa.nulls(len(row), pa.int32())], _BUCKET_NAMES)
    out: list[tuple] = []
    sent: set[bytes] = set()
    for i in [i for i, lead in enumerate(leads) if lead in cut]:
        for o in np.flatnonzero(valid[i]).tolist():
            at = int(off[i]) - o
            print_ = hashlib.blake2b(segs[i][at : at + MATCH], digest_size=16).digest()
            f1, f2 = int.from_bytes(print_[:8], "big", signed=True), int.from_bytes(print_[8:], "big", signed=True)
            if repeated[i, o] or many[i]:
                if print_ not in sent:
                    sent.add(print_)
                    out.append((None, None, None, None, f1, f2, 2))
            else:
                s = int(anchor[i]) - o
                out.append((int(k[i]), int(th[i]), s, s + MATCH, f1, f2, 1))
        if len(out) > 50_000:
            yield _fingerprint_rows(out)
            out = []
    if out:
        yield _fingerprint_rows(out)


def _fingerprint_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BUCKET_TYPES, strict=True)], _BUCKET_NAMES)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range partition, sorted by leading bytes, in runs that end between groups; only hot groups may be cut."""
    run: list[tuple] = []
    cut: set[bytes] = set()
    for batch in batches:
        for *row, hot in zip(*(batch.column(c).to_pylist() for c in ("lead", "seg", "off", "many", "k", "th", "start", "hot")), strict=True):
            if len(run) >= BUCKET and (row[0] != run[-1][0] or len(run) >= 2 * BUCKET):
                yield from _bucket(run, cut)
                run, cut = [], set()
            if hot:
                cut.add(row[0])
            run.append(tuple(row))
    if run:
        yield from _bucket(run, cut)


# --- result


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k (the id, or the least long for null), th (hash of the text), t. Rows equal in both are true repeats."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), text_or_empty(text_col).alias("t")).select("k", F.xxhash64("t").alias("th"), "t")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(meta, spans): k, th, n_bytes, sha of each row; k, th and the array of repeated spans where there are any."""
    spark = ready(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    again = written(
        rows.select("th", "t").mapInArrow(released(_grams), "ctx long, least long, most long, many boolean")
        .groupBy("ctx").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.bool_or("many").alias("many"))
        .where("many or least <> most").select(F.col("ctx").alias("key"))
    )
    bits = bitmap.size(again.count())
    words = spark.sparkContext.broadcast(bitmap.collect(again, bits))  # 16 MB at most
    parts = written(rows.mapInArrow(released(_segments(words)), _SEGMENTS))
    segments = parts.where(F.col("kind") == SEGMENT).select("lead", "seg", "off", "many", "k", "th", "start")
    large = segments.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("lead", F.lit(True).alias("hot"))
    dealt = (
        segments.join(large, "lead", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("k", "th", "start"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
        .repartitionByRange("lead", "salt").sortWithinPartitions("lead")
        .select("lead", "seg", "off", "many", "k", "th", "start", "hot")
    )
    sorted_out = written(dealt.mapInArrow(released(_buckets), _BUCKETS))
    across = (
        sorted_out.where("f1 is not null").groupBy("f1", "f2")
        # a window is open in a run once at most, so the list is no longer than the number of runs
        .agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "th", "start", "end"))).alias("at"))
        .where("n > 1").select(F.explode("at").alias("x")).select("x.*")
    )
    found = parts.where(F.col("kind") == FOUND).select("k", "th", "start", "end")
    all_spans = found.union(sorted_out.where("f1 is null").select("k", "th", "start", "end")).union(across)
    by_row = all_spans.groupBy("k", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return parts.where(F.col("kind") == META).select("k", "th", "n_bytes", "sha"), by_row


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, th, number of runs, kept bytes."""
    for batch in batches:
        runs, kept = [], []
        for t, spans_ in zip(batch.column("t").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            merged = union([(s["start"], s["end"]) for s in spans_])
            pieces, at = [], 0
            for a, b in merged:
                pieces.append(t[at:a])
                at = b
            pieces.append(t[at:])
            runs.append(len(merged))
            kept.append(b"".join(pieces))
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("th"), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["k", "th", "runs", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut_out(batches):
        kept = batch.column("kept").to_pylist()
        sizes, hashes = pa.array([len(x) for x in kept], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, hashes], ["k", "th", "runs", "n_kept", "kept_sha"])


def _texts(text_at: int):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, and what is kept of its text (the row's column `text_at`) where there are spans."""
        for batch in batches:
            kept = [None] * batch.num_rows
            some = pa.array(np.flatnonzero(np.asarray(batch.column("spans").is_valid())))
            if len(some):
                t = batch.column("row").field(text_at).take(some)
                part = pa.RecordBatch.from_arrays([some, batch.column("th").take(some), t, batch.column("spans").take(some)], ["k", "th", "t", "spans"])
                for cut in _cut_out([part]):
                    for i, x in zip(cut.column("k").to_pylist(), cut.column("kept").to_pylist(), strict=True):
                        kept[i] = x.decode("utf-8", "ignore")  # a run may end inside a character, of which the rest goes too
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "kept"])

    return texts


def _cut(docs: DataFrame, by_row: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts that have spans beside them; other texts are left out before the exchange by a bitmap of bounded size."""
    keyed = by_row.select(F.xxhash64("k", "th").alias("key"))
    bits = bitmap.size(by_row.count())
    words = bitmap.column(bitmap.collect(keyed, bits), docs.sparkSession)
    texts = _rows(docs, id_col, text_col).crossJoin(F.broadcast(words)).where(bitmap.test(F.xxhash64("k", "th"), bits)).drop("words")
    return texts.join(by_row.hint("shuffle_hash"), ["k", "th"]).select("k", "th", "t", "spans")


def _copies(meta: DataFrame) -> DataFrame:
    return meta.groupBy("sha", "n_bytes").agg(F.count(F.lit(1)).alias("copies")).where((F.col("copies") > 1) & (F.col("n_bytes") >= MATCH))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    meta, by_row = spans(docs, id_col, text_col)
    by_row = written(by_row)
    digests = _cut(docs, by_row, id_col, text_col).mapInArrow(released(_digest), "k long, th long, runs long, n_kept long, kept_sha string").dropDuplicates(["k", "th"])
    whole = F.col("copies").isNotNull()
    return meta.join(_copies(meta), ["sha", "n_bytes"], "left").join(digests, ["k", "th"], "left").select(
        F.when(F.col("k") != -(1 << 63), F.col("k")).alias("doc_id"),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_bytes") - F.col("n_kept"), F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated strings removed from `text`; all rows and columns stay.

    Only rows that lose something are exchanged, once and with one copy of their text; the others pass by.
    """
    meta, by_row = spans(docs, id_col, text_col)
    copies = meta.join(_copies(meta), ["sha", "n_bytes"]).select("k", "th", F.col("n_bytes").alias("all")).distinct()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("all").alias("end")))
    covered = written(by_row.join(copies, ["k", "th"], "full").select("k", "th", F.when(F.col("all").isNotNull(), whole).otherwise(F.col("spans")).alias("spans")))
    bits = bitmap.size(covered.count())
    words = bitmap.column(bitmap.collect(covered.select(F.xxhash64("k", "th").alias("key")), bits), docs.sparkSession)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kind = docs.select(packed).schema["row"].dataType.simpleString()
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k")
    keyed = docs.select(packed, key, F.xxhash64(text_or_empty(text_col)).alias("th")).crossJoin(F.broadcast(words))  # one row of 16 MB at most
    listed = bitmap.test(F.xxhash64("k", "th"), bits)
    placed = keyed.where(listed).select("row", "k", "th").join(covered.hint("shuffle_hash"), ["k", "th"], "left").select("row", "th", "spans")
    cut = placed.mapInArrow(released(_texts(docs.columns.index(text_col))), f"row {kind}, kept string")
    done = cut.union(keyed.where(~listed).select("row", F.lit(None).cast("string").alias("kept")))
    return done.select(*[(F.coalesce("kept", f"row.`{c}`") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
