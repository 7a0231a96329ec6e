"""Exact top-k inner products by columnar branch and bound.

Components become integers floor(SCALE * x). Candidates are packed into blocks of bounded bytes, stored by dimension
(one row of numbers for each dimension), queries into blocks of bounded size. Work is dealt in two directions: a pair of
a query block and a shard of the candidates is a key of an equi-join, so neither side is collected, no key holds more
than a shard, and both sides move in proportion to the other side's blocks. Inside a pair of blocks, scores are
accumulated some dimensions at a time; after each such step a candidate survives for a query only if its score so far
plus the Cauchy-Schwarz bound on the remaining dimensions reaches the query's floor, and the survivors are compacted.
The floor is the query's k-th best lower bound in the block, or the k-th best score that the task has already found for
it. What is left of each pair of blocks is merged by one window, whose partial limit runs before the exchange.

Sums are exact: as doubles where the norms show that all of them stay below 2**53, else as Python's integers. Vectors
with a component of LARGE or more are packed apart, so that they don't slow the others down.

Defined results: rows with a null vector, a null or non-finite component or a null id take no part; an empty vector
takes part with the score 0; ids may repeat: each row is a query or a candidate of its own, and a query leaves out its
own row only; vectors of different length are compared on the dimensions that both have (a missing dimension counts as
0), whatever their length; ties go to the smaller id; a score beyond 64 bits is ranked by its exact value and returned
as the nearest long; ids are cast to long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.common import ready, table, written

K = 10
SCALE = 1024
#: Bytes of a block of candidates, queries in a block of queries, candidates in a shard.
BLOCK_BYTES, QUERIES, SHARD = 512 << 10, 256, 1 << 16
#: Dimensions accumulated between two prunings.
STEP = 16
#: Components from which a vector is packed apart.
LARGE = 4096.0
#: Query blocks whose floors a task remembers.
_FLOORS = 64
_EXACT = 2.0**53


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as doubles where that is exact, else as Python's integers."""
    if not x.size or np.abs(x).max() < _EXACT / SCALE:
        return np.floor(x * SCALE)
    exact = [math.floor(v * SCALE) if abs(v) < _EXACT else int(v) * SCALE for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def _norms(m: np.ndarray) -> np.ndarray:
    """Of what follows each dimension, for each vector: row b is the norm of the dimensions from b on."""
    return np.sqrt(np.cumsum((m**2)[::-1], axis=0)[::-1])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > k and scores.dtype != object:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def search_blocks(
    q: np.ndarray, c: np.ndarray, q_row: np.ndarray, c_row: np.ndarray, c_id: np.ndarray, k: int = K, step: int = STEP, floors: list | None = None, survived: list | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its index, and the ids and scores of its k best in the block. q: dims x queries, c: dims x
    candidates, as integers. `floors` has for each query k scores found elsewhere, least first, and is kept up to date.
    `survived` gets the number of candidates and of those alive after each step."""
    dims = q.shape[0]
    exact = q.dtype == object or c.dtype == object
    if not exact and dims:
        q_rest, c_rest = _norms(q), _norms(c)
        exact = q_rest[0].max(initial=0) * c_rest[0].max(initial=0) >= _EXACT
    if exact or not dims:
        to_int = np.vectorize(int, otypes=[object])
        whole = to_int(q).T.dot(to_int(c)) if dims and c.shape[1] else np.zeros((q.shape[1], c.shape[1]))
    else:
        first = min(step, dims)
        whole = q[:first].T @ c[:first]
    for j in range(q.shape[1]):
        alive = np.flatnonzero(c_row != q_row[j])
        score = whole[j, alive]
        floor = floors[j][0] if floors is not None and len(floors[j]) >= k else None
        if floor is not None and not exact:  # sums are below _EXACT here
            floor = float(max(-_EXACT, min(_EXACT, floor)))
        counts = [len(alive)]
        if not exact and dims:
            for b in range(first, dims, step):
                # relative slack for the rounding of the norms
                rest = q_rest[b, j] * c_rest[b, alive] * (1 + 1e-9) + 1e-6
                least = -np.inf if floor is None else floor
                if len(alive) > k:
                    least = max(least, np.partition(score - rest, len(alive) - k)[len(alive) - k])
                keep = score + rest >= least
                if not keep.all():
                    alive, score = alive[keep], score[keep]
                counts.append(len(alive))
                end = min(b + step, dims)
                score = score + q[b:end, j] @ c[b:end, alive]
        if survived is not None:
            survived.append(counts)
        if floor is not None:
            keep = np.array([v >= floor for v in score], bool) if exact else score >= floor
            alive, score = alive[keep], score[keep]
        best = _best(c_id[alive], score, k)
        ids, scores = c_id[alive][best], score[best]
        if floors is not None and len(scores):
            floors[j] = sorted([*floors[j], *scores.tolist()])[-k:]
        yield j, ids, scores


def _matrix(payload: bytes, dims: int, n: int) -> np.ndarray:
    return np.frombuffer(payload, "<f8").reshape(dims, n)


def _fit(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[0] == dims else np.vstack([m, np.zeros((dims - m.shape[0], m.shape[1]))])


_BLOCK = "block long, first long, dims int, rows binary, ids binary, payload binary"
_HITS = "query_row long, query_id long, vec_id long, score long, beyond binary"
_LEAST, _MOST = -(2**63), 2**63 - 1


def _beyond(v: int) -> bytes | None:
    """Bytes in the order of the numbers, for scores that a long can't tell apart."""
    if _LEAST < v < _MOST:
        return None
    raw = abs(v).to_bytes((v.bit_length() + 7) // 8, "big")
    key = len(raw).to_bytes(4, "big") + raw
    return b"\1" + key if v > 0 else b"\0" + bytes(255 - x for x in key)


def _packer(most_bytes: int, most_rows: int):
    """Rows (row, id, block, x, large) to columnar blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[list[int], list[int], list[np.ndarray]]] = {}
        block = None

        def out(large: bool) -> pa.RecordBatch:
            rows, ids, vectors = held.pop(large)
            dims = max(map(len, vectors))
            m = np.zeros((dims, len(vectors)))
            for i, v in enumerate(vectors):
                m[: len(v), i] = v
            raw = (np.array(rows, "<i8").tobytes(), np.array(ids, "<i8").tobytes(), m.astype("<f8").tobytes())
            values = [pa.array([block], pa.int64()), pa.array([rows[0]], pa.int64()), pa.array([dims], pa.int32()), *(pa.array([x], pa.binary()) for x in raw)]
            return pa.RecordBatch.from_arrays(values, ["block", "first", "dims", "rows", "ids", "payload"])

        for batch in batches:
            column = batch.column("x")
            flat, offsets = np.asarray(column.flatten()), np.asarray(column.offsets)
            offsets = offsets - offsets[0]
            for i, (row, id_, b, large) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "id", "block", "large")), strict=True)):
                if b != block:
                    for kind in list(held):
                        yield out(kind)
                    block = b
                v = flat[offsets[i] : offsets[i + 1]]
                rows, ids, vectors = held.setdefault(large, ([], [], []))
                if rows and (len(rows) == most_rows or 8 * (len(rows) + 1) * max(len(v), len(vectors[0])) > most_bytes):
                    yield out(large)
                    rows, ids, vectors = held.setdefault(large, ([], [], []))
                rows.append(row)
                ids.append(id_)
                vectors.append(v)
        for kind in list(held):
            yield out(kind)

    return pack


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, list] = OrderedDict()
        for batch in batches:
            for row in batch.to_pylist():
                c_row, q_row = np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["q_rows"], "<i8")
                c_id, q_id = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                dims = max(row["dims"], row["q_dims"])
                c, q = integers(_fit(_matrix(row["payload"], row["dims"], len(c_row)), dims)), integers(_fit(_matrix(row["q_payload"], row["q_dims"], len(q_row)), dims))
                floors = known.setdefault(row["q_first"], [[] for _ in range(len(q_row))])
                known.move_to_end(row["q_first"])
                if len(known) > _FLOORS:
                    known.popitem(last=False)
                hits = [(np.full(len(ids), q_row[j]), np.full(len(ids), q_id[j]), ids, scores) for j, ids, scores in search_blocks(q, c, q_row, c_row, c_id, k, floors=floors)]
                columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in list(zip(*hits, strict=True))[:3]]
                exact = [int(v) for _, _, _, scores in hits for v in scores.tolist()]
                columns += [pa.array([max(_LEAST, min(_MOST, v)) for v in exact], pa.int64()), pa.array(map(_beyond, exact), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["query_row", "query_id", "vec_id", "score", "beyond"])

    return search


def top_k(vectors: DataFrame, every: int = 100, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The k best rows for each query; the queries are the rows whose id is divisible by `every`."""
    spark = ready(vectors.sparkSession)
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = x.where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
    whole = written(usable.select(F.monotonically_increasing_id().alias("row"), "id", "x", F.exists("x", lambda v: F.abs(v) >= LARGE).alias("large")))
    queries = whole.where(F.col("id") % every == 0)
    n_queries, n = queries.count(), whole.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, shards = -(-n_queries // QUERIES), -(-n // shard)
    packed_q = written(
        queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).repartition("block").sortWithinPartitions("block")
        .select("row", "id", "block", "x", "large").mapInArrow(_packer(BLOCK_BYTES, QUERIES), _BLOCK)
    )
    packed_c = whole.select("row", "id", F.lit(0).cast("long").alias("block"), "x", "large").mapInArrow(_packer(BLOCK_BYTES, 1 << 30), _BLOCK)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = packed_c.select("dims", "rows", "ids", "payload", F.pmod(F.xxhash64("first"), F.lit(shards)).alias("shard"), numbers(blocks).alias("of"))
    right = packed_q.select(F.col("block").alias("of"), numbers(shards).alias("shard"), F.col("first").alias("q_first"), F.col("dims").alias("q_dims"), *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "payload")])
    hits = left.join(right, ["of", "shard"]).drop("of", "shard").mapInArrow(_search(k), _HITS)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.n <> c.n
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, greatest(least(score, 9223372036854775807), -9223372036854775808)::BIGINT AS score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
