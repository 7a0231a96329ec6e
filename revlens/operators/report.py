"""The report as JSON and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators import dashboard
from revlens.operators.listing import REPORT_COLUMNS, attach_features, order_alerts


def feature_text(features: Column) -> Column:
    """feature(sentiment,NN%); ..."""
    one = lambda f: F.concat(f["feature"], F.lit("("), f["sentiment"], F.lit(","), F.bround(f["confidence"] * 100, 0).cast("int").cast("string"), F.lit("%)"))
    return F.array_join(F.transform(features, one), "; ")


def csv_rows(reviews: DataFrame, features: DataFrame) -> DataFrame:
    """Newest date first, as texts."""
    rows = attach_features(reviews, features)
    return rows.select(*REPORT_COLUMNS, feature_text(F.col("features")).alias("features")).orderBy(F.desc("review_date"), "id")


def write_csv(reviews: DataFrame, features: DataFrame, path: str) -> None:
    csv_rows(reviews, features).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(reviews: DataFrame, features: DataFrame, alerts: DataFrame, path: str) -> None:
    """One folder of JSON lines for each part; the reviews, which may be many, are never gathered."""
    parts = {
        "summary": dashboard.scalars(reviews).withColumn("generated_at", F.current_timestamp()),
        "feature_insights": dashboard.feature_summary(features),
        "category_comparison": dashboard.compare_categories(reviews),
        "alerts": order_alerts(alerts),
        "reviews": attach_features(reviews, features),
    }
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
