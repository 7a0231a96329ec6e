"""The batch plan: clean, detect, translate, deduplicate, score, analyse."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import clean, fake, language, sentiment
from revlens.operators import dashboard, dedup
from revlens.plans.durable import ready, settled, written


@dataclass
class Batch:
    reviews: DataFrame
    features: DataFrame
    clusters: DataFrame
    log: DataFrame


def run_pipeline(
    raw: DataFrame, ingestion_id: int = 1, near_dup: str = "jaccard", threshold: float = dedup.THRESHOLD,
    detector: Callable[[Column], Column] | None = None, translator: Callable[[Column, Column], Column] | None = None,
) -> Batch:
    """Enriches canonical input. Rows with null text are rejected up front."""
    ready(raw.sparkSession)
    rows = raw.where("original_text is not null").withColumn("ingestion_id", F.lit(ingestion_id).cast("long"))
    done = settled(partial(_enriched, rows, near_dup, threshold, detector, translator))
    item = F.struct("seq", F.col("analysed_text").alias("t"))
    groups = done.where("cluster_id is not null").groupBy("cluster_id").agg(
        F.max_by("analysed_text", F.struct(F.length("analysed_text"), -F.col("seq"))).alias("representative_text"),
        F.first("review_count").alias("review_count"), F.first("similarity_score").alias("similarity_score"), F.min(item).alias("first"),
    ).drop("first")
    features = done.select("seq", F.explode("features").alias("f")).select("seq", "f.*")
    log = dashboard.batch_counters(done).join(dashboard.language_counts(done), "ingestion_id")
    return Batch(done, features, groups, log)


def _enriched(rows: DataFrame, near_dup: str, threshold: float, detector, translator) -> DataFrame:
    """All that follows from a text alone is worked out once for each distinct text, in plans of a step each; then rows,
    still narrow, get what follows from their user, and last their text's columns."""
    base = written(rows)
    batch = F.first("ingestion_id").alias("ingestion_id")
    originals = base.groupBy("original_text").agg(F.min("seq").alias("_least"), F.count(F.lit(1)).alias("_copies"), batch)
    cleaned = language.translate(language.detect(clean.clean(originals), detector=detector), translator=translator)
    texts = written(cleaned.withColumn("analysed_text", F.coalesce("translated_text", "cleaned_text")))
    texts = written(dedup.of_texts(texts, "_least", "analysed_text", threshold, near_dup, "_copies"))
    plain = texts.withColumn("_fp", fake.fingerprint(F.col("analysed_text")))
    texts = written(fake.repeated(fake.score(plain, "analysed_text"), plain, copies="_copies"))
    texts = written(sentiment.of_texts(texts, "_least", "analysed_text").drop("_least", "_copies", "ingestion_id").withColumnRenamed("original_text", "_of"))
    same = F.col("original_text") == F.col("_of")
    posts = fake.posts(base.select("ingestion_id", "user_id", "original_text").join(texts.select("_of", "_fp"), same), "_fp")
    out = fake.with_posts(base, written(posts)).join(texts, same).drop("_of", "_fp")
    return sentiment.rated(fake.boosted(dedup.flagged(out, "seq")))


def response(batch: Batch, n: int = 200) -> DataFrame:
    """The reviews as a caller sees them: the three texts cut to `n` characters."""
    return batch.reviews.withColumns({c: F.substring(c, 1, n) for c in ("original_text", "cleaned_text", "translated_text")})
