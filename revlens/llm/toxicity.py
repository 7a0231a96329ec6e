"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fit: a bounded sample of labelled documents (at most MOST_TOXIC and MOST_CLEAN, those of least hash) is the set of
examples. Terms are all words of the examples, and beginnings of words that lean towards label 1 beyond doubt, since
inflected forms share a stem; terms that lean so weigh RELEVANCE times their TF-IDF. Postings are stored by blocks of
examples with the greatest weight of each block; the few terms that a large share of the examples has are kept as dense
columns, multiplied for many queries at once. A query's bound for a block is the greatest dense score in it plus the
sum of the other terms' block maxima. The block of the greatest bound is read first, then those whose bounds reach the
k-th best cosine found; so the k nearest of all examples are exact. Votes are weighted by the cosine, for label 1 and
against it, and calibrated by isotonic regression on the examples themselves, each left out of its own vote, with the
classes weighted back to their shares among all labelled rows. Evidence: the nearest examples with their labels.

Everything sent to executors is bounded by the sample; the corpus only passes by once.

Defined results: a null or empty text, and one without a word of the examples, gets the calibrated score of such texts
and no evidence; of examples of equal cosine the earlier in the index is nearer; texts count whole, whatever their
length; labels of rows that aren't in the corpus, null labels and null ids teach nothing; a document labelled twice
counts as toxic if any label says so; without labels of both kinds every score is 0; ids are cast to long; repeated rows
are scored each; other columns are kept, but `score` replaces those named like its results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import ready, released, table, text_or_empty, trim, written

#: Bounds of the sample of labelled documents.
MOST_TOXIC, MOST_CLEAN = 1024, 3072
#: What makes a term lean beyond doubt: least evidence, as the negative logarithm of Chernoff's bound on the chance that
#: so many of its examples have label 1; least ratio of its document frequencies. The factor of such terms.
LEAST_EVIDENCE, LEAST_RATIO, RELEVANCE = 17.0, 4.0, 4.0
#: Nearest examples that vote, examples in a block of the index, examples named as evidence.
NEIGHBOURS, BLOCK, EVIDENCE = 31, 512, 3
#: Share of the examples from which a term is a dense column; queries that are multiplied at once.
DENSE, QUERIES = 1 / 16, 128
#: Share of labelled rows held out of every fit: crc32(doc_id) mod FOLDS is 0.
FOLDS = 5
THRESHOLD = 0.5
#: Lengths of the word beginnings that may be terms.
STEMS = (4, 5, 6)
#: Bytes of the chunks of text, with their terms, that a worker keeps; longer chunks aren't kept.
KEPT_BYTES, LONGEST_KEPT = 48 << 20, 256
_ENTRY = 160
_word = re.compile(r"[^\W\d_]+").findall


def chunk_words(chunk: bytes) -> list[str]:
    """Words of a white-space separated chunk."""
    return _word(chunk.decode("utf-8", "replace").lower())


def beginnings(word: str) -> list[str]:
    return [f"{word[:n]}*" for n in STEMS if len(word) > n]


def number(term: str) -> int:
    """A term's number: equal 64-bit hashes count as equal terms."""
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) >> 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


Vector = tuple[np.ndarray, np.ndarray]  # places of terms, weights


@dataclass
class Index:
    """Examples as block-max postings; a term's place is that of its number in `terms`."""

    terms: np.ndarray  # sorted
    stems: frozenset[str]  # beginnings that are terms
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    column: np.ndarray  # by term: its dense column, or -1
    dense: np.ndarray  # examples x columns
    starts: np.ndarray  # terms x (blocks + 1): where each block's postings begin
    docs: np.ndarray  # postings by term: examples (ascending) and weights
    weights: np.ndarray
    block_max: np.ndarray  # terms x blocks
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))  # calibration: votes, scores
    empty_score: float = 0.0

    def vector(self, places: np.ndarray, counts: np.ndarray) -> Vector:
        w = (1 + np.log(counts)) * self.idf[places]
        norm = np.sqrt((w * w).sum())
        return places, w / norm if norm else w

    def _add(self, f: np.ndarray, w: np.ndarray, blocks: np.ndarray, score: np.ndarray) -> None:
        """Adds what the postings of some blocks give to the examples' scores."""
        first = self.starts[f][:, blocks].ravel()
        n = self.starts[f][:, blocks + 1].ravel() - first
        total = int(n.sum())
        if total:
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
            score += np.bincount(self.docs[at], self.weights[at] * np.repeat(np.repeat(w, len(blocks)), n), len(score))

    def nearest(self, queries: list[Vector], k: int = NEIGHBOURS, but: list[int] | None = None, read: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples of greatest cosine above 0 and the cosines; ties to the earlier example.

        `but` has an example for each query that is left out; `read` gets the number of blocks that were read."""
        n = len(self.ids)
        edges = np.arange(0, n, BLOCK)
        for a in range(0, len(queries), QUERIES):
            part = queries[a : a + QUERIES]
            wide = np.zeros((len(part), self.dense.shape[1]))
            for r, (f, w) in enumerate(part):
                c = self.column[f]
                wide[r, c[c >= 0]] = w[c >= 0]
            scores = wide @ self.dense.T
            for r, (f, w) in enumerate(part):
                rare, score = self.column[f] < 0, scores[r]
                f, w = f[rare], w[rare]
                bounds = np.maximum.reduceat(score, edges) + w @ self.block_max[f]
                top = np.array([bounds.argmax()])
                self._add(f, w, top, score)
                left = but[a + r] if but is not None else -1
                if left >= 0:
                    score[left] = 0
                here = score[top[0] * BLOCK : (top[0] + 1) * BLOCK]
                floor = np.partition(here, len(here) - k)[len(here) - k] if len(here) > k else 0.0
                bounds[top] = -1
                more = np.flatnonzero((bounds > 0) & (bounds >= floor - 1e-9))
                if len(more):
                    self._add(f, w, more, score)
                    if left >= 0:
                        score[left] = 0
                if read is not None:
                    read.append(1 + len(more))
                # of blocks that weren't read no example reaches the floor, with what its dense terms give or without
                score = np.round(score, 12)
                if n > k:
                    hit = np.flatnonzero(score >= max(np.partition(score, n - k)[n - k], 1e-12))
                else:
                    hit = np.flatnonzero(score > 0)
                best = hit[np.lexsort((hit, -score[hit]))[:k]]
                yield best, score[best]

    def vote(self, best: np.ndarray, cosines: np.ndarray) -> float:
        return float((cosines * (2 * self.labels[best] - 1)).sum())

    def score(self, queries: list[Vector]) -> Iterator[tuple[float, str]]:
        if not len(self.ids):
            yield from ((self.empty_score, "") for _ in queries)
            return
        votes, scores = self.steps
        for best, cosines in self.nearest(queries):
            if not len(best):
                yield self.empty_score, ""
                continue
            evidence = ",".join(f"{self.ids[i]}:{self.labels[i]}:{c:.4f}" for i, c in zip(best[:EVIDENCE], cosines, strict=False))
            yield float(np.interp(self.vote(best, cosines), votes, scores)), evidence


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (distinct x, nondecreasing fit)."""
    xs, at = np.unique(x, return_inverse=True)
    w = np.bincount(at, weight)
    means = np.bincount(at, weight * y) / w
    blocks: list[list[float]] = []  # mean, weight, members
    for m, v in zip(means, w, strict=True):
        blocks.append([m, v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return xs, np.concatenate([np.full(int(n), m) for m, _, n in blocks])


def build(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, leaning: np.ndarray, stems: frozenset[str], shares: tuple[float, float]) -> Index:
    """Index and calibration of the examples whose vectors (sizes[i] terms and counts each) follow one another.

    `leaning`: numbers of the terms that lean to label 1. `shares`: rows that an example of label 0 or 1 stands for.
    Examples that share their rarest leaning term are neighbours, so that a block's maxima are those of few such terms.
    """
    n = len(ids)
    names, place = np.unique(terms, return_inverse=True)
    df = np.bincount(place, minlength=len(names))
    leans = np.isin(names, leaning)
    idf = (np.log((1 + n) / (1 + df)) + 1) * np.where(leans, RELEVANCE, 1.0)
    of = np.repeat(np.arange(n), sizes)
    rarest = np.full(n, len(names) * (n + 2), np.int64)
    np.minimum.at(rarest, of[leans[place]], (df[place] * len(names) + place)[leans[place]])
    order = np.lexsort((ids, rarest))
    new = np.empty(n, np.int64)
    new[order] = np.arange(n)
    ids, labels, of = ids[order], labels[order], new[of]
    weights = (1 + np.log(counts)) * idf[place]
    weights /= np.sqrt(np.bincount(of, weights**2, n))[of]
    blocks = -(-n // BLOCK)
    common = np.flatnonzero(df >= max(2, DENSE * n))
    column = np.full(len(names), -1)
    column[common] = np.arange(len(common))
    wide = column[place] >= 0
    dense = np.zeros((n, len(common)))
    dense[of[wide], column[place[wide]]] = weights[wide]
    place, of, weights = place[~wide], of[~wide], weights[~wide]
    by = np.lexsort((of, place))
    place, of, weights = place[by], of[by], weights[by]
    key = place * blocks + of // BLOCK
    starts = np.searchsorted(key, np.arange(len(names) * blocks + 1)).astype(np.int32)
    starts = np.column_stack([starts[:-1].reshape(-1, blocks), starts[blocks::blocks]])
    block_max = np.zeros(len(names) * blocks, np.float32)
    np.maximum.at(block_max, key, np.nextafter(weights.astype(np.float32), np.float32(2)))
    index = Index(names, stems, idf, ids, labels, column, dense, starts, of.astype(np.int32), weights, block_max.reshape(-1, blocks))
    weight = np.where(labels == 1, shares[1], shares[0])
    votes, known = np.zeros(n), np.zeros(n, bool)
    flat = np.concatenate([place, common[np.nonzero(dense)[1]]])
    flat_w, flat_of = np.concatenate([weights, dense[np.nonzero(dense)]]), np.concatenate([of, np.nonzero(dense)[0]])
    by = np.lexsort((flat, flat_of))
    cuts = np.searchsorted(flat_of[by], np.arange(n + 1))
    vectors = [(flat[by[a:b]], flat_w[by[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
    for d, (best, cosines) in enumerate(index.nearest(vectors, but=list(range(n)))):
        if len(best):
            votes[d], known[d] = index.vote(best, cosines), True
    rest = ~known
    index.empty_score = float((weight * labels)[rest].sum() / weight[rest].sum()) if rest.any() else float((weight * labels).sum() / weight.sum())
    if known.any():
        index.steps = isotonic(votes[known], labels[known], weight[known])
    return index


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequency by label of each word and beginning, summed over the partition in bounded tables."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["feature", "n0", "n1"])

    for batch in batches:
        for y, t in zip(batch.column("toxic").to_pylist(), batch.column("t").cast(pa.binary()).to_pylist(), strict=True):
            found = {w for chunk in set(t.split()) for w in chunk_words(chunk)}
            found.update([b for w in found for b in beginnings(w)])
            counts[y].update(found)
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield out()
    yield out()


class _Chunks(dict):
    """Terms of the chunks that were met; bounded in bytes, with an older table from which chunks come back."""

    def __init__(self, stems: frozenset[str], places: dict[int, int] | None) -> None:
        self._stems, self._places, self._old, self._held = stems, places, {}, 0

    def __missing__(self, chunk: bytes) -> tuple[int, ...]:
        found = self._old.pop(chunk, None)
        if found is None:
            words = chunk_words(chunk)
            terms = map(number, chain(words, [b for w in words for b in beginnings(w) if b in self._stems]))
            found = tuple(terms) if self._places is None else tuple(p for t in terms if (p := self._places.get(t)) is not None)
        if len(chunk) <= LONGEST_KEPT:
            self._held += len(chunk) + 40 * len(found) + _ENTRY
            if self._held > KEPT_BYTES:
                self._old, self._held = dict(self), 0
                self.clear()
            self[chunk] = found
        return found

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        found = list(chain.from_iterable(map(self.__getitem__, text.split())))
        return np.unique(np.array(found, np.int64), return_counts=True)


def _vectors(stems: frozenset[str]):
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(stems, None)
        for batch in batches:
            found = [chunks.counts(t.as_py()) for t in batch.column("t").cast(pa.binary())]
            columns = [batch.column("id"), batch.column("toxic"), pa.array([f for f, _ in found], pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "toxic", "f", "n"])

    return vectors


def _scorer(index):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Index = index.value
        chunks = _Chunks(model.stems, {t: i for i, t in enumerate(model.terms.tolist())})
        for batch in batches:
            out = list(model.score([model.vector(*chunks.counts(t.as_py())) for t in batch.column("t").cast(pa.binary())]))
            columns = [batch.column("row"), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "score", "evidence"])

    return score


def no_index(score: float = 0.0) -> Index:
    """Without examples every text gets the same score."""
    none, wide = np.zeros(0, np.int64), np.zeros((0, 0))
    return Index(none, frozenset(), np.zeros(0), none, none, none, wide, np.zeros((0, 1), np.int32), none, np.zeros(0), wide, empty_score=score)


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """Index of a bounded sample of the labelled documents that aren't held out."""
    ready(docs.sparkSession)
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    )
    by_label = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("id"), F.col("id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(MOST_TOXIC).union(known.where("toxic = 0").orderBy(*order).limit(MOST_CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("t"))
    examples = written(texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("t").alias("t")))  # bounded
    n = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return no_index()
    p1, p0 = F.col("n1") / n1, F.col("n0") / n0
    q, n_f = n1 / (n0 + n1), F.col("n0") + F.col("n1")
    share = F.col("n1") / n_f
    divergence = share * F.log(share / q) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - q))).otherwise(0.0)
    certain = F.when(share > q, n_f * divergence).otherwise(0.0)
    chosen = (
        examples.select("toxic", "t").mapInArrow(released(_document_frequencies), "feature string, n0 long, n1 long")
        .groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .select("feature", certain.alias("certain"), ((p1 + 0.5 / n1) / (p0 + 0.5 / n0)).alias("ratio"))
        .where((F.col("certain") >= LEAST_EVIDENCE) & (F.col("ratio") >= LEAST_RATIO))
    )
    leaning = chosen.select("feature").toArrow().column("feature").to_pylist()  # terms of many of the sampled examples
    stems = frozenset(f for f in leaning if f.endswith("*"))
    rows = examples.select("id", "toxic", "t").mapInArrow(released(_vectors(stems)), "id long, toxic int, f array<long>, n array<int>").toArrow().combine_chunks()  # the sample's vectors
    sizes = np.diff(np.concatenate([[0], np.cumsum([len(x) for x in rows.column("f")])])).astype(np.int64)
    flat = lambda c: np.asarray(rows.column(c).combine_chunks().flatten())
    ids, toxic = np.asarray(rows.column("id")), np.asarray(rows.column("toxic")).astype(np.int64)
    return build(ids, toxic, sizes, flat("f"), flat("n"), np.array(sorted(map(number, leaning)), np.int64), stems, (by_label.get(0, 0) / n0, by_label.get(1, 0) / n1))


def _scored(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """row (the columns of `docs`), score, evidence."""
    spark = ready(docs.sparkSession)
    index = spark.sparkContext.broadcast(fit(corpus if corpus is not None else docs, labels))  # bounded by the sample
    trim()  # the driver keeps nothing of the sample
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kind = docs.select(packed).schema["row"].dataType.simpleString()
    return docs.select(packed, text_or_empty().alias("t")).mapInArrow(released(_scorer(index)), f"row {kind}, score double, evidence string")


def score(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """`docs` with score, predicted and evidence in place of columns of these names. The examples' texts come from
    `corpus`, `docs` itself by default."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("score", "predicted", "evidence")]
    return _scored(docs, labels, corpus).select(*kept, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, with all their columns."""
    clean = _scored(docs, labels, corpus).where(F.col("score") < THRESHOLD)
    return clean.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
