"""Filters, projections, look-ups and pages over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_COLUMNS = (
    "id original_text cleaned_text source rating detected_language is_suspicious is_duplicate fake_score sentiment_label sentiment_score "
    "product_category review_date"
).split()


def day_prefix(c: Column | str) -> Column:
    """The day that a date text begins with; null if it doesn't."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def day_utc(c: Column | str) -> Column:
    """The day in UTC: offsets are applied; null for what isn't ISO."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_date(F.try_to_timestamp(c)))


def filter_reviews(df: DataFrame, suspicious: bool | None = None, duplicate: bool | None = None, language: str | None = None, ingestion_id: int | None = None) -> DataFrame:
    """All filters that are given; an empty language and ingestion 0 are no filter."""
    if suspicious is not None:
        df = df.where(F.col("is_suspicious") == int(suspicious))
    if duplicate is not None:
        df = df.where(F.col("is_duplicate") == int(duplicate))
    if language:
        df = df.where(F.col("detected_language") == language)
    if ingestion_id:
        df = df.where(F.col("ingestion_id") == ingestion_id)
    return df


def filter_dates(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Days from start to end, both included."""
    if start:
        df = df.where(day_utc("review_date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(day_utc("review_date") <= F.lit(end).cast("date"))
    return df


def ambiguous(df: DataFrame) -> DataFrame:
    return df.where("is_ambiguous = 1")


def clean_only(df: DataFrame) -> DataFrame:
    return df.where("is_suspicious = 0 and is_duplicate = 0")


def filter_category(df: DataFrame, category: str | None) -> DataFrame:
    """`General` and none are no filter."""
    return df.where(F.col("product_category") == category) if category and category != "General" else df


def filter_alerts(df: DataFrame, status: str | None = None, team: str | None = None) -> DataFrame:
    if status:
        df = df.where(F.col("status") == status)
    if team:
        df = df.where(F.col("assigned_team") == team)
    return df


def newest_alerts(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("detected_at"), F.desc("id"))


def resolve(df: DataFrame, alert_id: int) -> DataFrame:
    return df.withColumn("status", F.when(F.col("id") == alert_id, "resolved").otherwise(F.col("status")))


def without_open(df: DataFrame) -> DataFrame:
    """What stays when all open alerts are cleared."""
    return df.where("status <> 'open'")


def alerts_by_severity(df: DataFrame) -> DataFrame:
    return df.groupBy("severity").agg(F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("status") == "open").alias("open"))


def newest_logs(df: DataFrame, limit: int = 20) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, 100)))


def explore(df: DataFrame, status: str = "all", feature: str | None = None, feature_sentiment: str | None = None, category: str | None = None, query: str = "") -> DataFrame:
    """The explorer's predicate on reviews with `features` attached. status: all, clean, suspicious, duplicate, ambiguous or a sentiment."""
    by_status = {"suspicious": "is_suspicious = 1", "duplicate": "is_duplicate = 1", "ambiguous": "is_ambiguous = 1", "clean": "is_suspicious = 0 and is_duplicate = 0"}
    if status in by_status:
        df = df.where(by_status[status])
    elif status in ("positive", "negative"):
        df = df.where(F.col("sentiment_label").isin(status, f"very_{status}"))
    elif status != "all":
        df = df.where(F.col("sentiment_label") == status)
    if feature:
        wanted = lambda f: (f["feature"] == feature) & (f["sentiment"] == feature_sentiment if feature_sentiment else F.lit(True))
        df = df.where(F.exists("features", wanted))
    if category and category != "all":
        df = df.where(F.col("product_category") == category)
    if query:
        found = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower())) for c in ("original_text", "cleaned_text", "product_category", "source")]
        df = df.where(found[0] | found[1] | found[2] | found[3])
    return df


def attach_features(df: DataFrame, features: DataFrame) -> DataFrame:
    """One lookup per review becomes one left join on collected rows; reviews without features get an empty array."""
    item = F.struct("id", "feature", "sentiment", "confidence", "evidence")
    by = features.groupBy(F.col("review_id").alias("_of")).agg(F.sort_array(F.collect_list(item)).alias("features"))
    empty = F.array().cast("array<struct<id:bigint,feature:string,sentiment:string,confidence:double,evidence:string>>")
    return df.join(by, F.col("id") == F.col("_of"), "left").drop("_of").withColumn("features", F.coalesce("features", empty))


def attach_members(clusters: DataFrame, reviews: DataFrame) -> DataFrame:
    """Clusters with their reviews in order of creation."""
    item = F.struct("created_at", "id", "original_text", "rating")
    by = reviews.where("cluster_id is not null").groupBy(F.col("cluster_id").alias("_of")).agg(F.sort_array(F.collect_list(item)).alias("reviews"))
    return clusters.join(by, F.col("id") == F.col("_of"), "left").drop("_of")


def page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first; ids break ties, since a batch shares its second."""
    return df.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(max(1, min(limit, 500)))


def largest_clusters(df: DataFrame, limit: int = 50) -> DataFrame:
    return df.orderBy(F.desc("review_count"), "id").limit(max(1, min(limit, 200)))


def order_alerts(df: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "success", 2).otherwise(3)
    return df.orderBy(rank, "feature")


def most_suspect(df: DataFrame, limit: int = 20) -> DataFrame:
    return df.orderBy(F.desc("fake_score"), "id").limit(limit)


def report_rows(df: DataFrame) -> DataFrame:
    return df.select(*REPORT_COLUMNS)


def quality_label(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Fair").otherwise("Poor")


def fake_level(score: Column) -> Column:
    return F.when(score >= 0.55, "high").when(score >= 0.3, "medium").otherwise("low")


def trend_label(delta: Column) -> Column:
    return F.when(delta > 5, "Degrading").when(delta < -5, "Improving").otherwise("Stable")
