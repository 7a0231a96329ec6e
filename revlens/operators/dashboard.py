"""Aggregates of the dashboard, the feature summary, the category comparison and the explorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.operators.listing import day_utc, filter_dates

POSITIVE, NEGATIVE, NEUTRAL = ("positive", "very_positive"), ("negative", "very_negative"), ("neutral", "mixed")


def _is(*labels: str) -> Column:
    return F.coalesce(F.col("sentiment_label").isin(*labels), F.lit(False))


def scalars(df: DataFrame) -> DataFrame:
    """One row from one scan. clean_reviews subtracts overlaps twice, as the dashboard always has; truly_clean doesn't."""
    out = df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(F.col("is_suspicious") == 1).alias("suspicious_count"),
        F.count_if(F.col("is_duplicate") == 1).alias("duplicate_count"),
        F.count_if(F.col("is_ambiguous") == 1).alias("ambiguous_count"),
        F.coalesce(F.avg("fake_score"), F.lit(0.0)).alias("average_fake_score"),
        F.count_if((F.col("is_suspicious") == 0) & (F.col("is_duplicate") == 0)).alias("truly_clean"),
    )
    both = F.col("suspicious_count") + F.col("duplicate_count")
    return out.withColumns(
        {
            "clean_reviews": F.col("total_reviews") - both,
            "quality_score": F.bround((1 - both / F.greatest("total_reviews", F.lit(1))) * 100, 1),
        }
    )


def per_day(df: DataFrame) -> DataFrame:
    return df.groupBy(day_utc("review_date").alias("day")).agg(F.count(F.lit(1)).alias("reviews")).orderBy("day")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts by a column, largest first; null sentiment labels aren't counted."""
    if column == "sentiment_label":
        df = df.where(F.col(column).isNotNull())
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), column)


def top_category(df: DataFrame) -> DataFrame:
    """One row: the most frequent category, General if there is none."""
    first = df.groupBy("product_category").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "product_category").limit(1)
    return first.agg(F.coalesce(F.first("product_category"), F.lit("General")).alias("top_category"))


def insights(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row with up to five sentences on the reviews of a period."""
    df = filter_dates(df, start, end)
    tone = df.agg(F.count_if(_is(*POSITIVE)).alias("pos"), F.count_if(_is(*NEGATIVE)).alias("neg"))
    row = scalars(df).crossJoin(top_category(df)).crossJoin(tone)  # three frames of one row
    total, bad, pos, neg = (F.col(c) for c in ("total_reviews", "suspicious_count", "pos", "neg"))
    period = F.lit(f"between {start} and {end}" if start and end else "in the dataset")
    average = F.concat(F.bround(F.col("average_fake_score") * 100, 0).cast("int").cast("string"), F.lit(".0%"))
    sentences = F.array(
        F.concat(F.lit("Analyzed "), total.cast("string"), F.lit(" total reviews "), period, F.lit(".")),
        F.concat(F.lit("Your overall data quality score sits at "), F.col("quality_score").cast("string"), F.lit("%, with "), F.col("clean_reviews").cast("string"), F.lit(" definitively clean and unique reviews.")),
        F.when(bad > 0, F.concat(F.lit("We flagged "), bad.cast("string"), F.lit(" reviews as highly suspicious or bot-generated (avg fake score: "), average, F.lit("), which were isolated from the clean pipeline."))).otherwise("Excellent! 0 reviews were flagged as fake or bot-generated in this period."),
        F.concat(F.lit("The most discussed product category during this timeframe was '"), F.col("top_category"), F.lit("'.")),
        F.when(pos > neg, F.concat(F.lit("The general tone leans positive, with "), pos.cast("string"), F.lit(" positive reviews vs "), neg.cast("string"), F.lit(" negative complaints.")))
        .when(neg > pos, F.concat(F.lit("Sentiment is leaning significantly negative, with "), neg.cast("string"), F.lit(" direct complaints dwarfing positive feedback."))),
    )
    return row.select(F.when(total > 0, F.array_compact(sentences)).otherwise(F.array(F.lit("No reviews found for the selected date range."))).alias("text_insights"))


def feature_summary(features: DataFrame) -> DataFrame:
    """Counts by sentiment for each feature. avg_confidence is that of the rarest sentiment, as the summary always
    showed; weighted_confidence is the mean over all mentions."""
    cells = features.groupBy("feature", "sentiment").agg(F.count(F.lit(1)).alias("cnt"), F.avg("confidence").alias("c"), F.sum("confidence").alias("s"))
    pivot = [F.coalesce(F.sum(F.when(F.col("sentiment") == s, F.col("cnt"))), F.lit(0)).alias(s) for s in ("positive", "negative", "mixed", "neutral")]
    out = cells.groupBy("feature").agg(
        *pivot, F.sum("cnt").alias("mentions"), F.min_by("c", F.struct("cnt", "sentiment")).alias("avg_confidence"), (F.sum("s") / F.sum("cnt")).alias("weighted_confidence")
    )
    return out.orderBy(F.desc("mentions"), "feature")


def _categorised(df: DataFrame) -> DataFrame:
    return df.where("product_category is not null and product_category <> '' and product_category <> 'General'")


def categories(df: DataFrame) -> DataFrame:
    return df.where("product_category is not null").select("product_category").distinct().orderBy("product_category")


def compare_categories(df: DataFrame) -> DataFrame:
    """One aggregation in place of five queries per category."""
    out = _categorised(df).groupBy("product_category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_is(*POSITIVE)).alias("positive"), F.count_if(_is(*NEGATIVE)).alias("negative"),
        F.count_if(_is(*NEUTRAL)).alias("neutral"), F.coalesce(F.bround(F.avg("rating"), 2), F.lit(0.0)).alias("avg_rating"),
        F.count_if(F.col("is_suspicious") == 1).alias("suspicious_count"),
    )
    share = lambda c: F.bround(F.col(c) / F.greatest("total", F.lit(1)) * 100, 1)
    return out.withColumns({f"{c}_pct": share(c) for c in ("positive", "negative", "neutral")}).withColumn("net_score", F.bround(F.col("positive_pct") - F.col("negative_pct"), 1))


def feature_counts(reviews: DataFrame, features: DataFrame) -> DataFrame:
    """category, feature and the counts of its sentiments."""
    joined = features.join(_categorised(reviews).select(F.col("id").alias("review_id"), "product_category"), "review_id")
    by = [F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "negative", "mixed", "neutral")]
    return joined.groupBy("product_category", "feature").agg(*by, F.count(F.lit(1)).alias("total"))


def top_features(reviews: DataFrame, features: DataFrame, n: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("product_category").orderBy(F.desc("total"), "feature"))
    return feature_counts(reviews, features).withColumn("rank", rank).where(F.col("rank") <= n)


def complaint_and_praise(reviews: DataFrame, features: DataFrame) -> DataFrame:
    """The feature with most negative and with most positive mentions in each category; null where there are none."""
    best = lambda c: F.max_by(F.when(F.col(c) > 0, F.col("feature")), F.struct(F.col(c), F.col("feature")))
    return feature_counts(reviews, features).groupBy("product_category").agg(best("negative").alias("top_complaint"), best("positive").alias("top_praise"))


def batch_counters(df: DataFrame) -> DataFrame:
    """Counters of each batch; duplicates stay valid."""
    out = df.groupBy("ingestion_id").agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("is_suspicious") == 1).alias("suspicious_count"),
        F.count_if(F.col("is_duplicate") == 1).alias("duplicate_count"), F.count_if(F.col("is_ambiguous") == 1).alias("ambiguous_count"),
    )
    return out.withColumn("valid_count", F.col("total_count") - F.col("suspicious_count"))


def language_counts(df: DataFrame) -> DataFrame:
    """ingestion_id and the map of its languages' counts."""
    by = df.groupBy("ingestion_id", "detected_language").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("ingestion_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("detected_language", "n")))).alias("language_distribution"))


def explorer_counts(df: DataFrame) -> DataFrame:
    clean = (F.col("is_suspicious") == 0) & (F.col("is_duplicate") == 0)
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(clean).alias("clean"), F.count_if(F.col("is_suspicious") == 1).alias("suspicious"),
        F.count_if(F.col("is_duplicate") == 1).alias("duplicates"), F.count_if(_is(*POSITIVE)).alias("positive"),
        F.count_if(_is(*NEGATIVE)).alias("negative"), F.count_if(F.col("is_ambiguous") == 1).alias("ambiguous"),
    )


def explorer_languages(df: DataFrame) -> DataFrame:
    return df.groupBy(F.upper(F.coalesce("detected_language", F.lit("unknown"))).alias("language")).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "language")


def explorer_categories(df: DataFrame) -> DataFrame:
    clean = (F.col("is_suspicious") == 0) & (F.col("is_duplicate") == 0)
    return df.groupBy("product_category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(clean).alias("clean"), F.count_if(F.col("is_suspicious") == 1).alias("suspicious"),
        F.count_if(_is(*POSITIVE)).alias("positive"), F.count_if(_is(*NEGATIVE)).alias("negative"),
    )


def language_share(df: DataFrame, n: int = 8) -> DataFrame:
    counts = df.groupBy("detected_language").agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select("detected_language", "cnt", (F.col("cnt") / F.col("all")).alias("share")).orderBy(F.desc("cnt"), "detected_language").limit(n)


def feature_bars(features: DataFrame, n: int = 8) -> DataFrame:
    share = lambda c: F.floor(F.col(c) / F.col("mentions") * 100 + 0.5).alias(f"{c}_pct")
    return feature_summary(features).limit(n).select("feature", "mentions", share("positive"), share("negative"), share("mixed"))


def user_counts(df: DataFrame) -> DataFrame:
    """id, user_id, and the posts and different texts of its user; 0 for rows without a user, which are no group."""
    by = df.where("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("original_text").alias("texts"))
    with_user = df.where("user_id is not null").select("id", "user_id").join(by, "user_id").select("id", "user_id", "posts", "texts")
    none = F.lit(0).cast("long")
    return with_user.union(df.where("user_id is null").select("id", "user_id", none.alias("posts"), none.alias("texts")))
