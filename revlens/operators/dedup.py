"""Exact and near-duplicate reviews: normalised hashes, shingle Jaccard and TF-IDF cosine joins with prefix filters."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.functions.text import strip
from revlens.operators.components import components
from revlens.plans.durable import written

THRESHOLD = 0.85
SHINGLE = 3
#: Terms that vectors have at most, the most frequent ones in the corpus.
MAX_FEATURES = 5000


def text_hash(text: Column) -> Column:
    return F.md5(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", ""))


def exact(df: DataFrame, text: str = "cleaned_text", order: str = "seq", scope: tuple[str, ...] = ()) -> DataFrame:
    """Adds text_hash, group_size and is_exact_duplicate: all of a group but the first in `order`, whose values must
    differ. Groups are aggregated first and joined back, so a text of many copies isn't gathered in one task."""
    return _not_first(_grouped(df, text, order, scope), order)


def _not_first(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("is_exact_duplicate", (F.col(order) > F.col("_first")).cast("int")).drop("_first")


def _times(copies: str | None) -> Column:
    """Rows that a row stands for."""
    return F.lit(1).cast("long") if copies is None else F.col(copies).cast("long")


def _grouped(df: DataFrame, text: str, order: str, scope: tuple[str, ...] = (), copies: str | None = None) -> DataFrame:
    """Adds text_hash, group_size and _first, the least `order` of the group."""
    out = df.withColumn("text_hash", text_hash(F.col(text)))
    groups = out.groupBy(*scope, "text_hash").agg(F.sum(_times(copies)).alias("group_size"), F.min(order).alias("_first"))
    keys = [*scope, "text_hash"]
    groups = groups.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "group_size", "_first")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return out.join(groups, same).drop(*[f"_k{i}" for i in range(len(keys))])


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """Distinct k-character pieces of the lower-cased, stripped text; none if it is shorter."""
    return pieces(F.lower(strip(text)), k)


def pieces(t: Column, k: int = SHINGLE) -> Column:
    """Distinct k-character pieces of a text as it is. Pass a column, not an expression: it is read for every piece."""
    starts = F.when(F.length(t) >= k, F.sequence(F.lit(1), F.length(t) - k + 1))
    return F.coalesce(F.array_distinct(F.transform(starts, lambda i: F.substring(t, i, F.lit(k)))), F.array().cast("array<string>"))



def jaccard_pairs(df: DataFrame, id_col: str = "id", text: str = "cleaned_text", threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity of all pairs a < b with Jaccard similarity of at least `threshold`.

    Sets that are equal are compared once. Each set is indexed by its rarest shingles only: two sets as similar as that
    share one of the first |s| - ceil(t |s|) + 1 in a common order.
    """
    rows = df.select(F.col(id_col).alias("id"), F.lower(strip(F.col(text))).alias("t"))
    texts = written(rows.groupBy("t").agg(F.min("id").alias("first")).where(F.length("t") >= SHINGLE))  # equal texts have equal sets
    sets = texts.select("t", "first", F.sort_array(pieces(F.col("t"))).alias("s"))
    by_set = written(sets.groupBy("s").agg(F.min("first").alias("id")).withColumn("size", F.size("s")))
    reps_of = sets.join(by_set.select("s", F.col("id").alias("rep")), "s").select("t", "rep")
    members = rows.join(reps_of, "t").select("id", "rep")
    long = by_set.select("id", "size", F.explode("s").alias("g"))
    rare = long.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "g"))
    ranked = long.join(rare, "g").withColumn("place", place)
    prefix = ranked.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).select("id", "g", "size")
    left, right = prefix.select(F.col("id").alias("a"), "g", F.col("size").alias("na")), prefix.select(F.col("id").alias("b"), "g", F.col("size").alias("nb"))
    candidates = (
        left.join(right, "g").where("a < b").where((F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9))
        .select("a", "b").distinct()
    )
    whole = by_set.select("id", "s")
    both = candidates.join(whole.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    reps = both.withColumn("similarity", shared / (F.size("sa") + F.size("sb") - shared)).where(F.col("similarity") >= threshold).select("a", "b", "similarity")
    # members of a set are linked to its representative, so no group of copies becomes a clique
    copies = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return reps.union(copies)


def tfidf(df: DataFrame, id_col: str = "id", text: str = "cleaned_text", max_features: int = MAX_FEATURES, copies: str | None = None) -> DataFrame:
    """id, term, weight: L2-normalised counts times ln((1 + n) / (1 + df)) + 1 over words and word pairs without stop words.

    A row stands for as many equal texts as its column `copies` says, for one if there is none."""
    from pyspark.ml.feature import StopWordsRemover

    stop = F.array(*[F.lit(w) for w in sorted(StopWordsRemover.loadDefaultStopWords("english"))])
    w = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda x: ~F.array_contains(stop, x))
    base = df.select(F.col(id_col).alias("id"), _times(copies).alias("times"), w.alias("w"))
    pairs = F.transform(F.when(F.size("w") > 1, F.sequence(F.lit(1), F.size("w") - 1)), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    terms = base.select("id", "times", F.explode(F.concat("w", F.coalesce(pairs, F.array().cast("array<string>")))).alias("term"))
    counts = terms.groupBy("id", "times", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = counts.groupBy("term").agg(F.sum(F.col("tf") * F.col("times")).alias("total"), F.sum("times").alias("df")).orderBy(F.desc("total"), "term").limit(max_features)
    n = base.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"))
    raw = counts.join(vocabulary, "term").crossJoin(F.broadcast(n)).withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return raw.withColumn("weight", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))).select("id", "term", "df", "weight")


def cosine_pairs(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity of all pairs a < b with cosine of at least `threshold`.

    Terms are ordered by rarity; a pair must share a term of the prefix after which each vector's norm is too small to
    reach the threshold alone.
    """
    v = written(vectors)
    order = Window.partitionBy("id").orderBy("df", "term")
    before = F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    prefix = v.withColumn("before", before).where(1 - F.col("before") >= threshold * threshold - 1e-9).select("id", "term")
    pairs = prefix.select(F.col("id").alias("a"), "term").join(prefix.select(F.col("id").alias("b"), "term"), "term").where("a < b").select("a", "b").distinct()
    x = v.select(F.col("id").alias("a"), "term", F.col("weight").alias("wa"))
    y = v.select(F.col("id").alias("b"), "term", F.col("weight").alias("wb"))
    return (
        pairs.join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
        .where(F.col("similarity") >= threshold - 1e-9)
    )


def _clustered_texts(df: DataFrame, id_col: str, text: str, threshold: float, method: str, copies: str | None = None) -> DataFrame:
    """_t, cluster, _keep (id of the representative), review_count (and similarity_score) of the texts in clusters of several rows.

    Rows of equal texts are one node, so that copies are never paired nor linked one by one.
    """
    texts = written(df.groupBy(F.col(text).alias("_t")).agg(F.min(id_col).alias("first"), F.sum(_times(copies)).alias("copies")))
    vectors = None
    if method == "jaccard":
        pairs, eligible = jaccard_pairs(texts, "first", "_t", threshold), texts.where(F.length(F.lower(strip("_t"))) >= SHINGLE)
    else:
        vectors = written(tfidf(texts, "first", "_t", copies="copies"))
        pairs, eligible = cosine_pairs(vectors, threshold), texts.join(vectors.select("id").distinct(), F.col("first") == F.col("id"), "left_semi")
    found = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = eligible.join(found, F.col("first") == F.col("node"), "left").select("_t", "first", "copies", F.coalesce("root", "first").alias("cluster"))
    of = placed.groupBy("cluster").agg(F.sum("copies").alias("n"), F.min_by("first", F.struct(-F.length("_t"), F.col("first"))).alias("_keep")).where("n > 1")
    out = placed.join(of, "cluster")
    columns = ["_t", "cluster", "_keep", F.col("n").cast("int").alias("review_count")]
    if vectors is None:
        return written(out.select(*columns, F.lit(float(threshold)).alias("similarity_score")))
    # mean over all pairs of a cluster, from the norm of the summed vectors: (|sum v|^2 - sum |v|^2) / (n (n - 1))
    each, w = out.select(F.col("first").alias("id"), "cluster", "n", "copies"), F.col("weight") * F.col("copies")
    sums = each.join(vectors, "id").groupBy("cluster", "n", "term").agg(F.sum(w).alias("s"), F.sum(w * F.col("weight")).alias("q"))
    mean = sums.groupBy("cluster", "n").agg((F.sum(F.col("s") * F.col("s")) - F.sum("q")).alias("x"))
    return written(out.join(mean.select("cluster", F.bround(F.col("x") / (F.col("n") * (F.col("n") - 1)), 3).alias("similarity_score")), "cluster").select(*columns, "similarity_score"))


def clusters(df: DataFrame, id_col: str = "id", text: str = "cleaned_text", threshold: float = THRESHOLD, method: str = "jaccard") -> DataFrame:
    """id, cluster (least member), is_representative (longest text, first on ties), review_count, similarity_score."""
    found = _clustered_texts(df, id_col, text, threshold, method)
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("_t")).join(found, "_t")
    return rows.select("id", "cluster", (F.col("id") == F.col("_keep")).alias("is_representative"), "review_count", "similarity_score")


def deduplicate(df: DataFrame, id_col: str = "id", text: str = "cleaned_text", threshold: float = THRESHOLD, method: str = "jaccard") -> DataFrame:
    """`df` with is_duplicate (not first of its exact group, or not its cluster's representative), cluster_id and cluster columns."""
    return flagged(of_texts(df, id_col, text, threshold, method), id_col)


def of_texts(df: DataFrame, id_col: str, text: str, threshold: float = THRESHOLD, method: str = "jaccard", copies: str | None = None) -> DataFrame:
    """`df` with all that rows of equal texts share, for `flagged`. A row may stand for as many rows as `copies` says, with
    their least id."""
    found = _clustered_texts(df, id_col, text, threshold, method, copies)
    return _grouped(df, text, id_col, copies=copies).join(found, F.col(text) == F.col("_t"), "left").drop("_t")


def flagged(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The flags of rows that have the columns of `of_texts`."""
    out = _not_first(df, id_col)
    out = out.withColumn("_keep", F.col(id_col) == F.col("_keep")).withColumnRenamed("_keep", "is_representative")
    dup = (F.col("is_exact_duplicate") == 1) | ~F.coalesce("is_representative", F.lit(True))
    return out.withColumn("is_duplicate", dup.cast("int")).withColumnRenamed("cluster", "cluster_id")


def stats(df: DataFrame) -> DataFrame:
    """One row of counts over what `deduplicate` returned."""
    out = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct(F.when(F.col("group_size") > 1, F.col("text_hash"))).alias("exact_groups"),
        F.count_distinct("cluster_id").alias("near_clusters"), F.sum("is_duplicate").alias("duplicates"),
    )
    return out.withColumns({"unique": F.col("total") - F.col("duplicates"), "duplicate_rate": F.bround(F.col("duplicates") / F.greatest("total", F.lit(1)) * 100, 1)})
