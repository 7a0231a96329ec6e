"""The engine's interface: ingest, query, detect trends, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import clean, fake, language, sentiment
from revlens.operators import dashboard, listing, report, trends
from revlens.operators.store import Store, dense_ids
from revlens.plans.durable import written
from revlens.plans.pipeline import Batch, run_pipeline
from revlens.sources import ingest


class ReviewEngine:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)

    # --- ingest

    def ingest(self, raw: DataFrame, source_type: str = "upload", file_name: str = "", **options) -> Batch:
        """Runs the pipeline on canonical input and stores reviews, features, clusters and a log row."""
        log_id = self.store.next_id("ingestion_logs")
        batch = run_pipeline(raw, log_id, **options)
        now = F.current_timestamp()
        first_cluster = self.store.next_id("clusters") - 1
        clusters = written(dense_ids(batch.clusters, "cluster_id", first_cluster))
        of = clusters.select(F.col("cluster_id").alias("_c"), F.col("id").alias("_id"))
        placed = batch.reviews.join(of, F.col("cluster_id") == F.col("_c"), "left").withColumn("cluster_id", F.col("_id")).drop("_c", "_id")
        reviews = written(dense_ids(placed, "seq", self.store.next_id("reviews") - 1))
        dated = F.coalesce(F.when(F.col("review_date") != "", F.col("review_date")), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"))
        self.store.append("clusters", clusters.drop("cluster_id").withColumn("created_at", now))
        self.store.append("reviews", reviews.withColumns({"review_date": dated, "created_at": now}))
        features = reviews.select(F.col("id").alias("review_id"), F.posexplode("features").alias("p", "f")).select("review_id", "p", "f.*", F.concat_ws("-", F.lpad("review_id", 20, "0"), F.lpad("p", 6, "0")).alias("_o"))
        self.store.append("feature_sentiments", dense_ids(features, "_o", self.store.next_id("feature_sentiments") - 1).withColumn("created_at", now))
        self.store.append("ingestion_logs", batch.log.select(F.lit(log_id).alias("id"), F.lit(source_type).alias("source_type"), F.lit(file_name).alias("file_name"), "total_count", "valid_count", "duplicate_count", "suspicious_count", "language_distribution", now.alias("created_at")))
        return batch

    def upload(self, path: str, **options) -> Batch:
        kind = path.rsplit(".", 1)[-1].lower()
        if kind not in ("csv", "json"):
            raise ValueError("only CSV and JSON files are supported")
        raw = ingest.read_csv(self.spark, path) if kind == "csv" else ingest.read_json(self.spark, path)
        return self.ingest(raw, f"{kind}_upload", path.rsplit("/", 1)[-1], **options)

    def paste(self, text: str, source: str = "manual_paste") -> Batch:
        return self.ingest(ingest.from_paste(self.spark, text, source), source)

    def api_feed(self, df: DataFrame) -> Batch:
        return self.ingest(ingest.from_frame(df), "api_feed")

    def load_samples(self, today: str) -> Batch:
        return self.ingest(ingest.from_frame(ingest.synthetic(self.spark, today)), "sample_data")

    # --- queries

    def _table(self, name: str) -> DataFrame:
        return self.store.table(name)

    def reviews(self, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
        found = listing.page(listing.filter_reviews(self._table("reviews"), **filters), limit, offset)
        return listing.attach_features(found, self._table("feature_sentiments"))

    def stats(self, start: str | None = None, end: str | None = None) -> dict[str, DataFrame]:
        df = listing.filter_dates(self._table("reviews"), start, end)
        return {
            "scalars": dashboard.scalars(df).crossJoin(self._table("clusters").agg(F.count(F.lit(1)).alias("cluster_count"))),
            "time_series": dashboard.per_day(df), "languages": dashboard.distribution(df, "detected_language"), "sources": dashboard.distribution(df, "source"),
            "sentiments": dashboard.distribution(df, "sentiment_label"), "insights": dashboard.insights(self._table("reviews"), start, end), "recent_ingestions": self.logs(5),
        }

    def clusters(self, limit: int = 50) -> DataFrame:
        return listing.attach_members(listing.largest_clusters(self._table("clusters"), limit), self._table("reviews"))

    def logs(self, limit: int = 20) -> DataFrame:
        return listing.newest_logs(self._table("ingestion_logs"), limit)

    def feature_summary(self) -> DataFrame:
        return dashboard.feature_summary(self._table("feature_sentiments"))

    def ambiguous(self, limit: int = 50) -> DataFrame:
        return listing.attach_features(listing.page(listing.ambiguous(self._table("reviews")), limit), self._table("feature_sentiments"))

    def review_features(self, review_id: int) -> DataFrame:
        return self._table("feature_sentiments").where(F.col("review_id") == review_id)

    def category_comparison(self) -> dict[str, DataFrame]:
        reviews, features = self._table("reviews"), self._table("feature_sentiments")
        return {"categories": dashboard.compare_categories(reviews), "top_features": dashboard.top_features(reviews, features), "extremes": dashboard.complaint_and_praise(reviews, features)}

    def trends(self, category: str = "General", start: str | None = None, end: str | None = None) -> dict[str, DataFrame]:
        rated = trends.rates(self._table("reviews"), self._table("feature_sentiments"), category, start, end)
        return {"trends": trends.trends(rated), "alerts": trends.alerts(rated, start, end)}

    # --- alerts

    def alerts(self, status: str | None = None, team: str | None = None) -> DataFrame:
        return listing.newest_alerts(listing.filter_alerts(self._table("alerts"), status, team))

    def persist_alerts(self, found: DataFrame) -> None:
        """Open alerts of all categories give way to the new ones."""
        kept = listing.without_open(self._table("alerts"))
        new = dense_ids(found, "feature", self.store.next_id("alerts") - 1).withColumns({"status": F.lit("open"), "detected_at": F.current_timestamp()})
        self.store.rewrite("alerts", kept.unionByName(new.select(*kept.columns)))

    def resolve_alert(self, alert_id: int) -> None:
        self.store.rewrite("alerts", listing.resolve(self._table("alerts"), alert_id))

    # --- export and single texts

    def export(self, path: str, format: str = "json") -> None:
        reviews, features = self._table("reviews"), self._table("feature_sentiments")
        if format == "csv":
            report.write_csv(reviews, features, path)
        else:
            report.write_json(reviews, features, self._table("alerts"), path)

    def reset(self) -> None:
        self.store.reset()

    def _one(self, text: str | None, rating: float | None = None) -> DataFrame:
        return self.spark.createDataFrame([(1, text or "", rating)], "id long, cleaned_text string, rating double")

    def detect_fake(self, text: str | None, rating: float | None = None) -> DataFrame:
        return fake.score(self._one(text, rating)).select("fake_score", "is_suspicious", "fake_flags", "signal_details")

    def detect_language(self, text: str | None) -> DataFrame:
        return language.detect(self._one(text)).select("detected_language", "language_name", "language_confidence")

    def preprocess(self, text: str | None) -> DataFrame:
        return clean.clean(self._one(text).withColumnRenamed("cleaned_text", "original_text")).drop("id", "rating")

    def analyze_sentiment(self, text: str | None, rating: float | None = None) -> DataFrame:
        return sentiment.analyze(self._one(text, rating)).select("sentiment_label", "sentiment_score", "features", "is_ambiguous", "ambiguity_flags")
