"""Schemas of the five stored tables and of the canonical input."""

from pyspark.sql import types as T

_KINDS = {
    "LONG": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "TIMESTAMP": T.TimestampType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()), "MAP<STRING,LONG>": T.MapType(T.StringType(), T.LongType()),
}


def _schema(columns: str) -> T.StructType:
    """A schema from `name KIND` pairs; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(*c.split()[:1], _KINDS[c.split()[1]]) for c in columns.split(", ")])


REVIEWS = _schema(
    "id LONG, original_review_id STRING, user_id STRING, original_text STRING, cleaned_text STRING, translated_text STRING, "
    "source STRING, rating DOUBLE, detected_language STRING, is_duplicate INT, is_suspicious INT, is_bot_user INT, is_ambiguous INT, "
    "cluster_id LONG, fake_score DOUBLE, fake_flags ARRAY<STRING>, preprocessing_notes ARRAY<STRING>, ambiguity_flags ARRAY<STRING>, "
    "sentiment_label STRING, sentiment_score DOUBLE, product_category STRING, review_date STRING, ingestion_id LONG, created_at TIMESTAMP"
)
FEATURES = _schema("id LONG, review_id LONG, feature STRING, sentiment STRING, confidence DOUBLE, evidence STRING, created_at TIMESTAMP")
CLUSTERS = _schema("id LONG, representative_text STRING, review_count INT, similarity_score DOUBLE, created_at TIMESTAMP")
LOGS = _schema(
    "id LONG, source_type STRING, file_name STRING, total_count INT, valid_count INT, duplicate_count INT, suspicious_count INT, "
    "language_distribution MAP<STRING,LONG>, created_at TIMESTAMP"
)
ALERTS = _schema(
    "id LONG, feature STRING, alert_type STRING, severity STRING, message STRING, assigned_team STRING, status STRING, detected_at TIMESTAMP"
)
#: What the ingest parsers make of any source.
INPUT = _schema(
    "seq LONG, original_review_id STRING, user_id STRING, original_text STRING, rating DOUBLE, product_category STRING, review_date STRING, source STRING"
)
TABLES = {"reviews": REVIEWS, "feature_sentiments": FEATURES, "clusters": CLUSTERS, "ingestion_logs": LOGS, "alerts": ALERTS}
