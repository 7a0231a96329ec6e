"""Review tables derived from `events` by integer arithmetic, as DataFrames and as SQL text that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.text import literal_array

OPEN = ("The", "Honestly the", "My new", "After a month the", "I think the", "In daily use the", "For this price the")
ASPECT = "battery camera display performance build price software storage speaker support delivery".split()
POL = (
    "is very good.", "is terrible!", "is not good, but the screen is great", "is not bad", "works fine",
    "is absolutely amazing and the battery is poor", "is slow", "is the worst, total waste of money",
)
CLOSE = ("", "Highly recommend this.", "boht accha hai", "GREAT PRODUCT MUST BUY!!!", "Yeah, right")
CATEGORY = ("Smartphone", "Smartwatch", "Headphones")
LANGUAGE = ("en", "hi", "hinglish", "unknown")
LABEL = ("very_positive", "positive", "neutral", "mixed", "negative", "very_negative")
FEATURE = "battery camera display performance build_quality price software storage audio customer_support delivery".split()
SENTIMENT = ("positive", "negative", "mixed", "neutral")
SEVERITY = ("critical", "warning", "success")
TEAM = ("Engineering Team", "Logistics Team", "Management Team", "Customer Support")
STATUS = ("open", "resolved")
DEFECT_FROM = "2024-01-23"


def _at(values, index: str):
    return F.element_at(literal_array(values), F.expr(f"cast({index} + 1 as int)"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, original_text, rating, product_category, review_date, source, ts."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    defect = F.expr(f"(event_id div 7) % 11 = 0 and ts >= timestamp_ntz'{DEFECT_FROM} 00:00:00'")
    said = F.when(defect, "is terrible!").otherwise(_at(POL, "(event_id div 77) % 8"))
    text = F.trim(F.concat_ws(" ", _at(OPEN, "event_id % 7"), _at(ASPECT, "(event_id div 7) % 11"), said, _at(CLOSE, "event_id % 5")))
    return e.select(
        F.col("event_id").alias("id"),
        F.expr("if(event_id % 10 = 0, concat('b', event_id % 40), concat('u', event_id % 5003))").alias("user_id"),
        text.alias("original_text"),
        F.expr("if(event_id % 17 = 0, null, cast(1 + (event_id div 5) % 5 as double))").alias("rating"),
        _at(CATEGORY, "event_id % 3").alias("product_category"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("review_date"),
        F.col("event_type").alias("source"), "ts",
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`raw` with the columns that the pipeline would add, by arithmetic."""
    rows = raw(spark, sf_dir)
    return rows.select(
        "id", F.expr("concat('r', id)").alias("original_review_id"), "user_id", "original_text", F.col("original_text").alias("cleaned_text"),
        "source", "rating", _at(LANGUAGE, "id % 4").alias("detected_language"),
        *[F.expr(f"cast(if(id % {m} = 0, 1, 0) as int)").alias(c) for c, m in (("is_duplicate", 11), ("is_suspicious", 7), ("is_bot_user", 13), ("is_ambiguous", 5))],
        F.expr("if(id % 9 = 0, id % 50, null)").alias("cluster_id"), F.expr("cast(id % 100 as double) / 100").alias("fake_score"),
        F.when(F.col("id") % 19 != 0, _at(LABEL, "id % 6")).alias("sentiment_label"), F.expr("cast(id % 9 - 4 as double) / 2").alias("sentiment_score"),
        F.expr("if(id % 23 = 0, 'General', product_category)").alias("product_category"), "review_date", F.expr("id % 4").alias("ingestion_id"), F.col("ts").alias("created_at"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 to 3 features for each review."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("r"))
    each = rows.where("r % 4 > 0").select("r", F.explode(F.expr("sequence(0L, r % 4 - 1)")).alias("k"))
    return each.select(
        F.expr("r * 4 + k").alias("id"), F.col("r").alias("review_id"), _at(FEATURE, "(r + 3 * k) % 11").alias("feature"),
        _at(SENTIMENT, "((r div 3) + k) % 4").alias("sentiment"), F.expr("(50 + (r + k) % 5 * 10) / 100.0D").alias("confidence"), F.expr("concat('e', r)").alias("evidence"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each cluster id of `reviews`."""
    return reviews(spark, sf_dir).where("cluster_id is not null").groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("review_count"), F.min("id").alias("first_id"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert for each event."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").alias("detected_at"))
    return rows.select(
        "id", _at(FEATURE, "id % 11").alias("feature"), _at(SEVERITY, "id % 3").alias("severity"), _at(TEAM, "id % 4").alias("assigned_team"),
        _at(STATUS, "(id div 5) % 2").alias("status"), "detected_at",
    )


def _sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


RAW_SQL = f"""raw AS (
  SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'b' || (event_id % 40) ELSE 'u' || (event_id % 5003) END AS user_id,
    trim(concat_ws(' ', ({_sql(OPEN)})[event_id % 7 + 1], ({_sql(ASPECT)})[(event_id // 7) % 11 + 1],
      CASE WHEN (event_id // 7) % 11 = 0 AND ts >= TIMESTAMP '{DEFECT_FROM} 00:00:00' THEN 'is terrible!' ELSE ({_sql(POL)})[(event_id // 77) % 8 + 1] END,
      ({_sql(CLOSE)})[event_id % 5 + 1])) AS original_text,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE (1 + (event_id // 5) % 5)::DOUBLE END AS rating,
    ({_sql(CATEGORY)})[event_id % 3 + 1] AS product_category, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS review_date, event_type AS source, ts FROM events)"""
REVIEWS_SQL = RAW_SQL + f""", reviews AS (
  SELECT id, 'r' || id AS original_review_id, user_id, original_text, original_text AS cleaned_text, source, rating, ({_sql(LANGUAGE)})[id % 4 + 1] AS detected_language,
    (id % 11 = 0)::INTEGER AS is_duplicate, (id % 7 = 0)::INTEGER AS is_suspicious, (id % 13 = 0)::INTEGER AS is_bot_user, (id % 5 = 0)::INTEGER AS is_ambiguous,
    CASE WHEN id % 9 = 0 THEN id % 50 END AS cluster_id, (id % 100)::DOUBLE / 100 AS fake_score, CASE WHEN id % 19 <> 0 THEN ({_sql(LABEL)})[id % 6 + 1] END AS sentiment_label,
    (id % 9 - 4)::DOUBLE / 2 AS sentiment_score, CASE WHEN id % 23 = 0 THEN 'General' ELSE product_category END AS product_category, review_date, id % 4 AS ingestion_id, ts AS created_at FROM raw)"""
FEATURES_SQL = f"""fs AS (
  SELECT r * 4 + k AS id, r AS review_id, ({_sql(FEATURE)})[(r + 3 * k) % 11 + 1] AS feature, ({_sql(SENTIMENT)})[((r // 3) + k) % 4 + 1] AS sentiment,
    (50 + (r + k) % 5 * 10) / 100.0::DOUBLE AS confidence, 'e' || r AS evidence
  FROM (SELECT event_id AS r, unnest(range(0, event_id % 4)) AS k FROM events))"""
ALERTS_SQL = f"""alerts AS (
  SELECT event_id AS id, ({_sql(FEATURE)})[event_id % 11 + 1] AS feature, ({_sql(SEVERITY)})[event_id % 3 + 1] AS severity, ({_sql(TEAM)})[event_id % 4 + 1] AS assigned_team,
    ({_sql(STATUS)})[(event_id // 5) % 2 + 1] AS status, ts AS detected_at FROM events)"""
