"""Recent against historical windows for each feature, and the alerts that follow."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators.listing import day_prefix, filter_category, order_alerts
from revlens.operators.store import dense_ids

LOOKBACKS = (7, 14, 21, 28, 35)
#: Recent reviews that make a window wide enough, and reviews below which there is no trend at all.
ENOUGH, LEAST = 10, 15
# Words of a feature that route its alerts, in the order in which they are tried.
TEAMS = (
    ("Logistics Team", ("delivery", "packaging", "shipping", "arrive", "box")),
    ("Engineering Team", ("battery", "screen", "software", "mic", "display", "audio", "gps", "camera", "sensor", "hardware")),
    ("Management Team", ("price", "subscription", "refund", "cost", "value", "deal")),
)


def tag(reviews: DataFrame, category: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """id, bucket (recent, hist or null). Without both dates the window ends at the newest day and widens by weeks."""
    days = filter_category(reviews, category).select("id", day_prefix("review_date").alias("day"))
    if start and end:
        first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
        return days.select("id", F.when(F.col("day").between(first, last), "recent").when(F.col("day") < first, "hist").alias("bucket"))
    anchor = days.agg(F.max("day").alias("anchor"))
    with_anchor = days.crossJoin(F.broadcast(anchor))  # one row
    within = [F.count_if(F.col("day") >= F.date_sub("anchor", n)).alias(f"d{n}") for n in LOOKBACKS]
    width = F.lit(LOOKBACKS[-1])
    for n in reversed(LOOKBACKS):
        width = F.when(F.col(f"d{n}") >= ENOUGH, n).otherwise(width)
    chosen = with_anchor.groupBy("anchor").agg(*within).select(F.date_sub("anchor", width).alias("since"))
    recent = F.coalesce(F.col("day") >= F.col("since"), F.lit(False))
    return days.crossJoin(F.broadcast(chosen)).select("id", F.when(recent, "recent").otherwise("hist").alias("bucket"))


def tag_by_index(reviews: DataFrame) -> DataFrame:
    """id, bucket: without any dates, the newest fifth of the reviews (5 at least) is recent."""
    rows = reviews.select(F.col("id").alias("of"), F.struct("review_date", "id").alias("o"))
    n = rows.count()
    return dense_ids(rows, "o").select(F.col("of").alias("id"), F.when(F.col("id") > n - max(5, n // 5), "recent").otherwise("hist").alias("bucket"))


def preset(days: int | None, today: str) -> tuple[str | None, str]:
    """First and last day of the newest `days` days; without `days` the first is open, so the window is dynamic."""
    last = date.fromisoformat(today)
    return (last - timedelta(days=days)).isoformat() if days else None, today


def team(feature: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, parts in TEAMS:
        out = out.when(F.lower(feature).rlike("|".join(parts)), F.lit(name))
    return out.otherwise("Customer Support")


def rates(reviews: DataFrame, features: DataFrame, category: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both windows' mentions and shares for each feature, from one join and one aggregation; empty under LEAST reviews."""
    tagged = tag(reviews, category, start, end)
    enough = filter_category(reviews, category).agg((F.count(F.lit(1)) >= LEAST).alias("enough"))
    seen = features.join(tagged.where("bucket is not null").select(F.col("id").alias("review_id"), "bucket"), "review_id")
    counts = [
        F.count_if((F.col("bucket") == b) & (F.lit(s == "total") | (F.col("sentiment") == s))).alias(f"{b}_{s}")
        for b in ("recent", "hist") for s in ("total", "negative", "positive")
    ]
    out = seen.groupBy("feature").agg(*counts).crossJoin(F.broadcast(enough)).where("enough").drop("enough")
    rate = lambda b, s: F.col(f"{b}_{s}") / F.greatest(F.col(f"{b}_total"), F.lit(1))
    return out.withColumns({f"{b}_{s}_rate": rate(b, s) for b in ("recent", "hist") for s in ("negative", "positive")}).withColumn(
        "volume_change", F.col("recent_total") - F.col("hist_total")
    )


def trends(rated: DataFrame) -> DataFrame:
    pct = lambda c: F.bround(F.col(f"{c}_rate") * 100, 1).alias(f"{c}_pct")
    return rated.select(
        "feature", F.col("recent_total").alias("recent_mentions"), F.col("hist_total").alias("hist_mentions"),
        pct("recent_negative"), pct("hist_negative"), pct("recent_positive"), pct("hist_positive"), "volume_change",
    ).orderBy("feature")


def alerts(rated: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The first rule that fits each feature that isn't noise."""
    up_neg = F.col("recent_negative_rate") - F.col("hist_negative_rate")
    up_pos = F.col("recent_positive_rate") - F.col("hist_positive_rate")
    neg, pos = F.col("recent_negative_rate"), F.col("recent_positive_rate")
    severity = F.when((neg > 0.30) & (up_neg > 0.15), "critical").when((neg > 0.20) & (up_neg > 0.10), "warning").when((pos > 0.40) & (up_pos > 0.15), "success")
    found = rated.where("recent_total >= 3 or hist_total >= 3").withColumns({"severity": severity, "assigned_team": team(F.col("feature"))}).where("severity is not null")
    whole = lambda c: F.bround(F.col(c) * 100, 0).cast("int").cast("string")
    when = F.lit(f"between {start} and {end}" if start and end else "recently")
    text = {
        "critical": ("CRITICAL: '", F.col("feature"), "' negative ratio surged to ", whole("recent_negative_rate"), "% (was ", whole("hist_negative_rate"), "%) ", when, ". ",
                     F.col("recent_negative").cast("string"), " complaints in ", F.col("recent_total").cast("string"), " mentions. Routing to ", F.col("assigned_team"), "."),
        "warning": ("WARNING: '", F.col("feature"), "' negativity rose to ", whole("recent_negative_rate"), "% (was ", whole("hist_negative_rate"), "% historic). Monitor ", F.col("assigned_team"), "."),
        "success": ("EXCELLENT: Users are loving '", F.col("feature"), "'! Positive ratio grew to ", whole("recent_positive_rate"), "% (was ", whole("hist_positive_rate"), "%) ", when, "."),
    }
    message, kind = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for name, title in (("critical", "Defect Spike"), ("warning", "Emerging Concern"), ("success", "Praise Trend")):
        message = message.when(F.col("severity") == name, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in text[name]]))
        kind = kind.when(F.col("severity") == name, F.lit(title))
    side = lambda b: F.bround(F.when(F.col("severity") == "success", F.col(f"{b}_positive_rate")).otherwise(F.col(f"{b}_negative_rate")) * 100, 1)
    out = found.select("feature", kind.alias("alert_type"), "severity", message.alias("message"), "assigned_team", side("recent").alias("recent_pct"), side("hist").alias("hist_pct"))
    return order_alerts(out)


def reach(reviews: DataFrame, features: DataFrame) -> DataFrame:
    """Extension: unique users of each feature's negative mentions, and whether that makes it systemic."""
    neg = features.where("sentiment = 'negative'").join(reviews.select(F.col("id").alias("review_id"), "user_id"), "review_id")
    out = neg.groupBy("feature").agg(F.count_distinct("user_id").alias("unique_users"), F.count(F.lit(1)).alias("review_count"))
    return out.withColumn("is_systemic", F.col("unique_users") >= 3)


def health_radar(rated: DataFrame, n: int = 8) -> DataFrame:
    share = lambda b: F.when(
        F.col(f"{b}_positive") + F.col(f"{b}_negative") > 0, F.floor(F.col(f"{b}_positive") / (F.col(f"{b}_positive") + F.col(f"{b}_negative")) * 100 + 0.5)
    ).otherwise(50)
    return rated.select("feature", share("recent").alias("recent"), share("hist").alias("historical")).orderBy("feature").limit(n)
