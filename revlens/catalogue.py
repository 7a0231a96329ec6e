"""Queries of the review engine over the test data, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens import fixture as fx
from revlens.functions import clean, fake, language, sentiment
from revlens.functions import lexicons as lx
from revlens.functions.text import nfkc, words
from revlens.operators import dashboard, dedup, listing, report, trends
from revlens.operators.store import dense_ids
from revlens.plans.durable import ready, written
from revlens.plans.pipeline import Batch, response, run_pipeline
from revlens.sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
START, END = "2024-01-10", "2024-01-20"


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql is not None:
        _sql[name] = sql


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return ready(spark).read.parquet(f"{d}/documents.parquet")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return ready(spark).read.parquet(f"{d}/pages.parquet")


def _on_reviews(name: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _add(name, lambda s, d: query(fx.reviews(ready(s), d)), f"WITH {fx.REVIEWS_SQL} {sql}")


def _on_both(name: str, query: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    _add(name, lambda s, d: query(fx.reviews(ready(s), d), fx.features(s, d)), f"WITH {fx.REVIEWS_SQL}, {fx.FEATURES_SQL} {sql}")


def _on_raw(name: str, query: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    _add(name, lambda s, d: query(fx.raw(ready(s), d)), f"WITH {fx.RAW_SQL} {sql}" if sql else None)


_POS, _NEG, _NEU = "('positive','very_positive')", "('negative','very_negative')", "('neutral','mixed')"

# --- filters and projections
_on_reviews("fil1_reviews", lambda r: listing.filter_reviews(r, suspicious=False, duplicate=False, language="en", ingestion_id=0).select("id", "source", "rating"),
            "SELECT id, source, rating FROM reviews WHERE is_suspicious = 0 AND is_duplicate = 0 AND detected_language = 'en'")
_on_reviews("fil2_date_range", lambda r: listing.filter_dates(r, START, END).select("id", "review_date"),
            f"SELECT id, review_date FROM reviews WHERE substr(review_date, 1, 10) BETWEEN '{START}' AND '{END}'")
_on_reviews("fil3_ambiguous", lambda r: listing.ambiguous(r).select("id", "rating"), "SELECT id, rating FROM reviews WHERE is_ambiguous = 1")
_on_reviews("fil5_category", lambda r: listing.filter_category(r, "Smartwatch").select("id"), "SELECT id FROM reviews WHERE product_category = 'Smartwatch'")
_on_reviews("fil7_not_null", lambda r: r.where(F.col("sentiment_label").isNotNull() & F.col("rating").isNotNull() & F.col("product_category").isNotNull()).select("id"),
            "SELECT id FROM reviews WHERE sentiment_label IS NOT NULL AND rating IS NOT NULL AND product_category IS NOT NULL")
_on_both("fil8_explorer", lambda r, f: listing.explore(listing.attach_features(r, f), "negative", "battery", "negative", "Smartphone", "THE").select("id"),
         f"SELECT id FROM reviews r WHERE sentiment_label IN {_NEG} AND product_category = 'Smartphone' AND EXISTS (SELECT 1 FROM fs WHERE review_id = r.id AND feature = 'battery' AND sentiment = 'negative') "
         "AND (contains(lower(original_text), 'the') OR contains(lower(product_category), 'the') OR contains(lower(source), 'the'))")
_on_reviews("fil9_clean", lambda r: listing.clean_only(r).select("id"), "SELECT id FROM reviews WHERE is_suspicious = 0 AND is_duplicate = 0")
_on_reviews("prj2_report", listing.report_rows, f"SELECT {', '.join(listing.REPORT_COLUMNS)} FROM reviews")
_on_reviews("prj4_labels", lambda r: r.select("id", listing.quality_label(F.col("fake_score") * 100).alias("quality"), listing.fake_level(F.col("fake_score")).alias("level"), listing.trend_label(F.col("sentiment_score") * 5).alias("trend")),
            "SELECT id, CASE WHEN fake_score * 100 >= 80 THEN 'Excellent' WHEN fake_score * 100 >= 60 THEN 'Good' WHEN fake_score * 100 >= 40 THEN 'Fair' ELSE 'Poor' END AS quality, "
            "CASE WHEN fake_score >= 0.55 THEN 'high' WHEN fake_score >= 0.3 THEN 'medium' ELSE 'low' END AS level, CASE WHEN sentiment_score * 5 > 5 THEN 'Degrading' WHEN sentiment_score * 5 < -5 THEN 'Improving' ELSE 'Stable' END AS trend FROM reviews")

# --- joins
_on_both("join1_feature_by_category", lambda r, f: dashboard.feature_counts(r, f),
         "SELECT product_category, feature, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'mixed') AS mixed, "
         "count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) AS total FROM fs JOIN reviews r ON r.id = review_id WHERE product_category NOT IN ('', 'General') GROUP BY 1, 2")
_on_both("join2_semi_bucket", lambda r, f: f.join(trends.tag(r, None, START, END).where("bucket = 'recent'").select(F.col("id").alias("review_id")), "review_id", "left_semi").groupBy("feature", "sentiment").agg(F.count(F.lit(1)).alias("cnt")),
         f"SELECT feature, sentiment, count(*) AS cnt FROM fs WHERE review_id IN (SELECT id FROM reviews WHERE substr(review_date, 1, 10) BETWEEN '{START}' AND '{END}') GROUP BY 1, 2")
_on_both("att1_reviews_with_features", lambda r, f: listing.attach_features(r, f).select("id", report.feature_text(F.col("features")).alias("features"), F.size("features").cast("long").alias("n")),
         "SELECT r.id, coalesce(string_agg(feature || '(' || sentiment || ',' || round(confidence * 100)::INTEGER || '%)', '; ' ORDER BY fs.id), '') AS features, count(fs.id) AS n FROM reviews r LEFT JOIN fs ON review_id = r.id GROUP BY r.id")
_add("att2_cluster_members", lambda s, d: listing.attach_members(fx.clusters(ready(s), d), fx.reviews(s, d)).select("id", "review_count", F.array_join(F.transform("reviews", lambda x: x["id"].cast("string")), ",").alias("members")),
     f"WITH {fx.REVIEWS_SQL} SELECT cluster_id AS id, count(*) AS review_count, string_agg(id::VARCHAR, ',' ORDER BY created_at, id) AS members FROM reviews WHERE cluster_id IS NOT NULL GROUP BY 1")
_on_raw("join5_dictionary", lambda r: r.select(F.explode(words(F.lower("original_text"))).alias("w")).join(F.broadcast(r.sparkSession.createDataFrame(list(lx.SLANG.items()), "w string, meaning string")), "w").groupBy("w", "meaning").agg(F.count(F.lit(1)).alias("cnt")),
        "SELECT w, meaning, count(*) AS cnt FROM (SELECT unnest(string_split(lower(original_text), ' ')) AS w FROM raw) JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in lx.SLANG.items()) + ") AS s(w, meaning) USING (w) GROUP BY ALL")

# --- aggregates
_on_reviews("agg1_counts", lambda r: r.groupBy("ingestion_id").agg(F.count(F.lit(1)).alias("total")), "SELECT ingestion_id, count(*) AS total FROM reviews GROUP BY 1")
_SCALARS = ("count(*) AS total_reviews, count(*) FILTER (is_suspicious = 1) AS suspicious_count, count(*) FILTER (is_duplicate = 1) AS duplicate_count, count(*) FILTER (is_ambiguous = 1) AS ambiguous_count, "
            "count(*) FILTER (is_suspicious = 0 AND is_duplicate = 0) AS truly_clean")
_on_reviews("agg2_dashboard_scalars", lambda r: dashboard.scalars(listing.filter_dates(r, START, END)).withColumn("average_fake_score", F.round("average_fake_score", 6)),
            f"SELECT *, total_reviews - suspicious_count - duplicate_count AS clean_reviews, round((1 - (suspicious_count + duplicate_count) / total_reviews) * 100, 1) AS quality_score FROM "
            f"(SELECT {_SCALARS}, round(avg(fake_score), 6) AS average_fake_score FROM reviews WHERE substr(review_date, 1, 10) BETWEEN '{START}' AND '{END}')")
_on_reviews("agg3_reviews_per_day", lambda r: dashboard.per_day(r).select(F.col("day").cast("string").alias("day"), "reviews"), "SELECT substr(review_date, 1, 10) AS day, count(*) AS reviews FROM reviews GROUP BY 1")
for _c, _n in (("detected_language", "language"), ("source", "source"), ("product_category", "category"), ("sentiment_label", "sentiment")):
    _on_reviews(f"agg4_{_n}_dist", lambda r, c=_c: dashboard.distribution(r, c), f"SELECT {_c}, count(*) AS cnt FROM reviews {'WHERE sentiment_label IS NOT NULL' if _n == 'sentiment' else ''} GROUP BY 1")
_on_reviews("agg5_top_category", dashboard.top_category, "SELECT product_category AS top_category FROM reviews GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
_on_reviews("agg6_quality", lambda r: dashboard.scalars(r).select("clean_reviews", "quality_score", "truly_clean"),
            "SELECT t - s - d AS clean_reviews, round((1 - (s + d) / t) * 100, 1) AS quality_score, truly_clean FROM (SELECT count(*) AS t, count(*) FILTER (is_suspicious = 1) AS s, count(*) FILTER (is_duplicate = 1) AS d, "
            "count(*) FILTER (is_suspicious = 0 AND is_duplicate = 0) AS truly_clean FROM reviews)")
_on_both("agg7_feature_summary", lambda r, f: dashboard.feature_summary(f).withColumns({c: F.round(c, 6) for c in ("avg_confidence", "weighted_confidence")}),
         "SELECT feature, sum(CASE sentiment WHEN 'positive' THEN cnt ELSE 0 END)::BIGINT AS positive, sum(CASE sentiment WHEN 'negative' THEN cnt ELSE 0 END)::BIGINT AS negative, sum(CASE sentiment WHEN 'mixed' THEN cnt ELSE 0 END)::BIGINT AS mixed, "
         "sum(CASE sentiment WHEN 'neutral' THEN cnt ELSE 0 END)::BIGINT AS neutral, sum(cnt)::BIGINT AS mentions, round((array_agg(c ORDER BY cnt, sentiment))[1], 6) AS avg_confidence, round(sum(s) / sum(cnt), 6) AS weighted_confidence "
         "FROM (SELECT feature, sentiment, count(*) AS cnt, avg(confidence) AS c, sum(confidence) AS s FROM fs GROUP BY 1, 2) GROUP BY 1")
_on_reviews("agg8_category_comparison", dashboard.compare_categories,
            f"SELECT *, round(positive_pct - negative_pct, 1) AS net_score FROM (SELECT *, round(positive / total * 100, 1) AS positive_pct, round(negative / total * 100, 1) AS negative_pct, round(neutral / total * 100, 1) AS neutral_pct FROM "
            f"(SELECT product_category, count(*) AS total, count(*) FILTER (sentiment_label IN {_POS}) AS positive, count(*) FILTER (sentiment_label IN {_NEG}) AS negative, count(*) FILTER (sentiment_label IN {_NEU}) AS neutral, "
            "round(coalesce(avg(rating), 0), 2) AS avg_rating, count(*) FILTER (is_suspicious = 1) AS suspicious_count FROM reviews WHERE product_category NOT IN ('', 'General') GROUP BY 1))")
_FC = ("fc AS (SELECT product_category, feature, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'mixed') AS mixed, "
       "count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) AS total FROM fs JOIN reviews r ON r.id = review_id WHERE product_category NOT IN ('', 'General') GROUP BY 1, 2)")
_on_both("agg9_top_features", dashboard.top_features, f", {_FC} SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY product_category ORDER BY total DESC, feature))::INTEGER AS rank FROM fc) WHERE rank <= 5")
_on_both("agg10_complaint_praise", dashboard.complaint_and_praise,
         f", {_FC} SELECT product_category, (array_agg(CASE WHEN negative > 0 THEN feature END ORDER BY negative DESC, feature DESC))[1] AS top_complaint, (array_agg(CASE WHEN positive > 0 THEN feature END ORDER BY positive DESC, feature DESC))[1] AS top_praise FROM fc GROUP BY 1")
_on_reviews("agg13_language_counts", lambda r: dashboard.language_counts(r).select("ingestion_id", F.explode("language_distribution").alias("detected_language", "n")), "SELECT ingestion_id, detected_language, count(*) AS n FROM reviews GROUP BY 1, 2")
_on_reviews("agg14_batch_counters", dashboard.batch_counters,
            "SELECT ingestion_id, count(*) AS total_count, count(*) FILTER (is_suspicious = 1) AS suspicious_count, count(*) FILTER (is_duplicate = 1) AS duplicate_count, count(*) FILTER (is_ambiguous = 1) AS ambiguous_count, "
            "count(*) FILTER (is_suspicious = 0) AS valid_count FROM reviews GROUP BY 1")
_on_raw("agg16_fingerprints", lambda r: r.select(fake.fingerprint(F.col("original_text")).alias("fp")).where(F.length("fp") > 5).groupBy("fp").agg(F.count(F.lit(1)).alias("cnt")),
        "SELECT regexp_replace(lower(original_text), '[^a-z]', '', 'g') AS fp, count(*) AS cnt FROM raw WHERE length(regexp_replace(lower(original_text), '[^a-z]', '', 'g')) > 5 GROUP BY 1")
_on_reviews("agg18_explorer_counts", dashboard.explorer_counts,
            f"SELECT count(*) AS total, count(*) FILTER (is_suspicious = 0 AND is_duplicate = 0) AS clean, count(*) FILTER (is_suspicious = 1) AS suspicious, count(*) FILTER (is_duplicate = 1) AS duplicates, "
            f"count(*) FILTER (sentiment_label IN {_POS}) AS positive, count(*) FILTER (sentiment_label IN {_NEG}) AS negative, count(*) FILTER (is_ambiguous = 1) AS ambiguous FROM reviews")
_on_reviews("agg18_explorer_languages", dashboard.explorer_languages, "SELECT upper(coalesce(detected_language, 'unknown')) AS language, count(*) AS cnt FROM reviews GROUP BY 1")
_on_reviews("agg18_explorer_categories", dashboard.explorer_categories,
            f"SELECT product_category, count(*) AS total, count(*) FILTER (is_suspicious = 0 AND is_duplicate = 0) AS clean, count(*) FILTER (is_suspicious = 1) AS suspicious, count(*) FILTER (sentiment_label IN {_POS}) AS positive, "
            f"count(*) FILTER (sentiment_label IN {_NEG}) AS negative FROM reviews GROUP BY 1")
_on_reviews("agg21_language_share", lambda r: dashboard.language_share(r).withColumn("share", F.round("share", 6)), "SELECT detected_language, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM reviews GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 8")
_on_both("agg22_feature_bars", lambda r, f: dashboard.feature_bars(f),
         "SELECT feature, count(*) AS mentions, floor(count(*) FILTER (sentiment = 'positive') / count(*) * 100 + 0.5)::BIGINT AS positive_pct, floor(count(*) FILTER (sentiment = 'negative') / count(*) * 100 + 0.5)::BIGINT AS negative_pct, "
         "floor(count(*) FILTER (sentiment = 'mixed') / count(*) * 100 + 0.5)::BIGINT AS mixed_pct FROM fs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
_on_reviews("dst1_categories", dashboard.categories, "SELECT DISTINCT product_category FROM reviews WHERE product_category IS NOT NULL")

# --- windows, order, sets
_on_raw("win1_keep_first", lambda r: dedup.exact(r, "original_text", "id").where("is_exact_duplicate = 0").select("id"), "SELECT min(id) AS id FROM raw GROUP BY regexp_replace(lower(original_text), '[^a-z0-9]', '', 'g')")
_on_reviews("win2_representative", lambda r: r.where("cluster_id is not null").withColumn("k", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.length("original_text")), "id"))).where("k = 1").select("cluster_id", "id"),
            "SELECT cluster_id, (array_agg(id ORDER BY length(original_text) DESC, id))[1] AS id FROM reviews WHERE cluster_id IS NOT NULL GROUP BY 1")
_on_raw("win3_user_counts", lambda r: dashboard.user_counts(r).select("id", "user_id", "posts", F.col("texts").cast("long").alias("texts")),
        "SELECT id, user_id, count(*) OVER (PARTITION BY user_id) AS posts, texts FROM raw JOIN (SELECT user_id, count(DISTINCT original_text) AS texts FROM raw GROUP BY 1) USING (user_id)")
_on_reviews("srt1_page", lambda r: listing.page(r, 50, 20).select("id"), "SELECT id FROM reviews ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20")
_add("srt2_clusters", lambda s, d: listing.largest_clusters(fx.clusters(ready(s), d), 10), f"WITH {fx.REVIEWS_SQL} SELECT cluster_id AS id, count(*) AS review_count, min(id) AS first_id FROM reviews WHERE cluster_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_on_reviews("srt5_report_order", lambda r: r.orderBy(F.desc("review_date"), "id").limit(100).select("id", "review_date"), "SELECT id, review_date FROM reviews ORDER BY review_date DESC, id LIMIT 100")
_on_reviews("srt7_most_suspect", lambda r: listing.most_suspect(r).select("id", "fake_score"), "SELECT id, fake_score FROM reviews ORDER BY fake_score DESC, id LIMIT 20")
_on_both("set1_feature_union", lambda r, f: f.where("sentiment = 'positive'").select("feature").union(f.where("sentiment = 'negative'").select("feature")).distinct(), "SELECT feature FROM fs WHERE sentiment = 'positive' UNION SELECT feature FROM fs WHERE sentiment = 'negative'")
_on_reviews("set2_unique_ids", lambda r: r.select("id").join(r.where("is_duplicate = 1").select("id"), "id", "left_anti"), "SELECT id FROM reviews EXCEPT SELECT id FROM reviews WHERE is_duplicate = 1")
_on_raw("set4_markers", lambda r: r.where(language.dialect(F.lower("original_text")) == "hinglish").select("id"),
        "SELECT id FROM raw WHERE list_has_any(string_split(lower(original_text), ' '), ['" + "', '".join(lx.HINGLISH) + "'])")

# --- text
_add("txt2_html", lambda s, d: _pages(s, d).select("page_id", F.md5(clean.replace_html(F.col("html"))).alias("h")), "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS h FROM pages")
_add("txt3_url", lambda s, d: _pages(s, d).select("page_id", clean.replace_urls(F.concat(F.lit("see "), F.col("url"), F.lit(" now"))).alias("t")), r"SELECT page_id, regexp_replace('see ' || url || ' now', 'https?://\S+|www\.\S+', '[URL]', 'g') AS t FROM pages")
_add("txt4_email", lambda s, d: _docs(s, d).select("doc_id", F.md5(clean.replace_emails(F.col("text"))).alias("h")), r"SELECT doc_id, md5(regexp_replace(text, '[^\s\x{a0}]+@[^\s\x{a0}]+\.[^\s\x{a0}]+', '[EMAIL]', 'g')) AS h FROM documents")
_on_raw("txt6_slang", lambda r: r.select("id", clean.expand_slang(F.col("original_text")).alias("t")),
        "SELECT id, array_to_string(list_transform(string_split(original_text, ' '), lambda w: coalesce(map_extract(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lx.SLANG.items()) + "}, lower(w))[1], w)), ' ') AS t FROM raw")
_RUNS = "".join(f", c{i} AS (SELECT id, regexp_replace(t, '{c}{{4,}}', '{c}{c}', 'g') AS t FROM c{i - 1})" for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ!,", 1))
_on_raw("txt7_repeated_chars", lambda r: r.select("id", clean.fix_repeated_characters(F.concat("original_text", F.lit("oooooh"))).alias("t")),
        f", c0 AS (SELECT id, original_text || 'oooooh' AS t FROM raw){_RUNS} SELECT * FROM c54")
_on_raw("txt8_repeated_words", lambda r: r.select("id", clean.fix_repeated_words(F.concat(F.lit("so so SO "), "original_text")).alias("t")),
        "SELECT id, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT coalesce(i > 1 AND l[i] = l[i - 1] AND ((i > 2 AND l[i] = l[i - 2]) OR l[i] = l[i + 1]), false)), lambda i: w[i]), ' ') AS t FROM (SELECT id, w, list_transform(w, lambda x: lower(x)) AS l FROM (SELECT id, string_split('so so SO ' || original_text, ' ') AS w FROM raw))")
_on_raw("txt9_punctuation", lambda r: r.select("id", clean.fix_punctuation(F.col("original_text")).alias("t")), r"SELECT id, regexp_replace(original_text, '[!?.]{2,}([!?.])', '\1.', 'g') AS t FROM raw")
_on_raw("txt12_run_on", lambda r: r.select("id", clean.split_run_on(F.repeat(F.regexp_replace("original_text", "[.!]", ""), 6)).alias("t")),
        r"SELECT id, CASE WHEN length(t) > 200 THEN regexp_replace(t, '\b(but|however|although|also|and then|then|moreover|furthermore)\b', '. \1', 'gi') ELSE t END AS t FROM (SELECT id, repeat(regexp_replace(original_text, '[.!]', '', 'g'), 6) AS t FROM raw)")
_on_raw("txt_clean", lambda r: clean.clean(r).select("id", "cleaned_text", F.array_join("preprocessing_notes", ",").alias("notes"), "char_count_cleaned"))
_add("txt14_helpers", lambda s, d: _docs(s, d).select("doc_id", F.round(clean.repetition_score(F.col("text")), 6).alias("repetition"), clean.excessive_punctuation(F.col("text")).alias("runs")),
     r"SELECT doc_id, CASE WHEN len(w) < 3 THEN 0.0 ELSE round(1 - len(list_distinct(w)) / len(w), 6) END AS repetition, len(regexp_extract_all(text, '[!?]{3,}'))::INTEGER AS runs FROM "
     r"(SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)")
_on_raw("lng2_dialect", lambda r: language.detect(r, "original_text").select("id", "detected_language", "language_name", "language_confidence"),
        "SELECT id, CASE WHEN h THEN 'hinglish' ELSE 'en' END AS detected_language, CASE WHEN h THEN 'Hinglish' ELSE 'English' END AS language_name, CASE WHEN h THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS language_confidence FROM "
        "(SELECT id, list_has_any(string_split(lower(original_text), ' '), ['" + "', '".join(lx.HINGLISH) + "']) AS h FROM raw)")
_add("lng3_script", lambda s, d: _docs(s, d).select("doc_id", language.script(F.col("text")).alias("code")), "SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'hi' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'zh' ELSE 'en' END AS code FROM documents")

# --- fake signals
_W = "list_filter(string_split(original_text, ' '), lambda x: x <> '')"


def _signal(name: str, fn, sql: str | None) -> None:
    _on_raw(name, lambda r: r.withColumn("w", words("original_text")).select("id", fn(F.col("original_text"), F.col("w"))["v"].cast("double").alias("value")), f"SELECT id, ({sql})::DOUBLE AS value FROM (SELECT *, {_W} AS w FROM raw)" if sql else None)


# runs of a word three times or more in a list
_SAME_WORDS = "len(list_filter(range(1, len({w}) - 1), lambda i: ({w})[i] = ({w})[i + 1] AND ({w})[i] = ({w})[i + 2] AND (i = 1 OR ({w})[i] <> ({w})[i - 1])))"
_signal("fk1_too_short", lambda t, w: fake.too_short(w), "CASE WHEN len(w) <= 3 THEN 1.0 WHEN len(w) <= 6 THEN 0.5 ELSE 0 END")
_add("fk2_too_long", lambda s, d: _docs(s, d).withColumn("w", words("text")).select("doc_id", fake.too_long(F.col("w"))["v"].alias("value")),
     r"SELECT doc_id, (CASE WHEN n > 500 THEN 0.8 WHEN n > 300 THEN 0.4 ELSE 0 END)::DOUBLE AS value FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents)")
_UPPER, _LETTERS = (f"length(regexp_replace(original_text, '[^{c}]', '', 'g'))" for c in ("A-Z", "A-Za-z"))
_signal("fk3_all_caps", lambda t, w: fake.all_caps(t, w), f"CASE WHEN len(w) <= 4 OR {_LETTERS} <= 5 THEN 0 WHEN {_UPPER} / {_LETTERS} > 0.8 THEN 1.0 WHEN {_UPPER} / {_LETTERS} > 0.5 THEN 0.5 ELSE 0 END")
_signal("fk4_repeated_chars", lambda t, w: fake.repeated_chars(F.concat(t, F.lit(" soooooo niiiiice heyyyyyy"))), "1.0")
_MORE_WORDS = _SAME_WORDS.format(w="string_split(lower('so so so ' || original_text), ' ')")
_signal("fk5_repeated_words", lambda t, w: fake.repeated_words(F.concat(F.lit("so so so "), t)), f"CASE WHEN {_MORE_WORDS} >= 2 THEN 1.0 WHEN {_MORE_WORDS} = 1 THEN 0.5 ELSE 0 END")
_signal("fk6_punctuation", lambda t, w: fake.excessive_punctuation(t), "CASE WHEN len(regexp_extract_all(original_text, '[!?]{3,}')) >= 3 THEN 1.0 WHEN len(regexp_extract_all(original_text, '[!?]{3,}')) >= 1 THEN 0.4 ELSE 0 END")
_HITS = "list_filter(['" + "', '".join(lx.FAKE_TEMPLATES) + "'], lambda p: contains(lower(original_text), p))"
_signal("fk7_template", lambda t, w: fake.template_match(t), f"CASE WHEN len({_HITS}) >= 2 THEN 1.0 WHEN len({_HITS}) = 1 AND len(w) <= len(string_split({_HITS}[1], ' ')) + 3 THEN 0.9 WHEN len({_HITS}) = 1 THEN 0.3 ELSE 0 END")
_signal("fk8_emoji_spam", lambda t, w: fake.emoji_spam(F.concat(t, F.lit("😀😀😀😀"))), "0.5")
_add("fk9_low_density", lambda s, d: _docs(s, d).withColumn("w", words("text")).select("doc_id", fake.low_info_density(F.col("w"))["v"].alias("value")),
     r"SELECT doc_id, (CASE WHEN len(w) < 5 THEN 0 WHEN len(list_distinct(w)) / len(w) < 0.4 THEN 1.0 WHEN len(list_distinct(w)) / len(w) < 0.6 THEN 0.5 ELSE 0 END)::DOUBLE AS value FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)")
_on_reviews("fk10_rating_mismatch", lambda r: r.select("id", fake.rating_mismatch(F.col("rating"), F.col("sentiment_label"))["v"].alias("value")),
            f"SELECT id, (CASE WHEN (rating >= 4 AND sentiment_label IN {_NEG}) OR (rating <= 2 AND sentiment_label IN {_POS}) THEN 1.0 ELSE 0 END)::DOUBLE AS value FROM reviews")
_signal("fk11_spaced_text", lambda t, w: fake.spaced_text(w), "CASE WHEN len(w) > 4 AND len(list_filter(w, lambda x: length(x) = 1 AND regexp_matches(x, '[A-Za-z]'))) / len(w) > 0.6 THEN 1.0 WHEN len(w) > 4 AND len(list_filter(w, lambda x: length(x) = 1 AND regexp_matches(x, '[A-Za-z]'))) / len(w) > 0.3 THEN 0.5 ELSE 0 END")
# the signals of a text alone: n_ counts and ratios, v_ values, f_ flags
_PERCENT = "round_even({} * 100, 0)::INTEGER || '%"
_RUN = "|".join(f"{c}{{5,}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!,")
_STEP = "CASE WHEN {n} >= {a} THEN {x} WHEN {n} >= {b} THEN {y} ELSE 0.0 END"
_VALUES = {
    "too_short": "CASE WHEN len(w) <= 3 THEN 1.0 WHEN len(w) <= 6 THEN 0.5 ELSE 0.0 END", "too_long": "CASE WHEN len(w) > 500 THEN 0.8 WHEN len(w) > 300 THEN 0.4 ELSE 0.0 END",
    "all_caps": "CASE WHEN n_caps > 0.8 THEN 1.0 WHEN n_caps > 0.5 THEN 0.5 ELSE 0.0 END", "repeated_chars": _STEP.format(n="n_chars", a=3, x=1.0, b=1, y=0.4),
    "repeated_words": _STEP.format(n="n_words", a=2, x=1.0, b=1, y=0.5), "excessive_punctuation": _STEP.format(n="n_punct", a=3, x=1.0, b=1, y=0.4),
    "template_match": "CASE WHEN len(hits) >= 2 THEN 1.0 WHEN n_only THEN 0.9 WHEN len(hits) = 1 THEN 0.3 ELSE 0.0 END", "emoji_spam": _STEP.format(n="n_emoji", a=8, x=1.0, b=4, y=0.5),
    "low_info_density": "CASE WHEN n_density < 0.4 THEN 1.0 WHEN n_density < 0.6 THEN 0.5 ELSE 0.0 END", "rating_mismatch": "0.0", "spaced_text": "CASE WHEN n_spaced > 0.6 THEN 1.0 WHEN n_spaced > 0.3 THEN 0.5 ELSE 0.0 END",
}
_FLAGS = (
    "CASE WHEN len(w) <= 3 THEN 'Very short review (' || len(w) || ' words)' WHEN len(w) <= 6 THEN 'Short review (' || len(w) || ' words)' END",
    "CASE WHEN len(w) > 500 THEN 'Unusually long review (' || len(w) || ' words)' END",
    f"CASE WHEN n_caps > 0.8 THEN 'Mostly ALL CAPS (' || {_PERCENT.format('n_caps')})' WHEN n_caps > 0.5 THEN 'High caps ratio (' || {_PERCENT.format('n_caps')})' END",
    "CASE WHEN n_chars >= 3 THEN 'Excessive repeated characters (' || n_chars || ' instances)' END", "CASE WHEN n_words >= 2 THEN 'Excessive word repetition' END",
    "CASE WHEN n_punct >= 3 THEN 'Excessive punctuation (' || n_punct || ' sequences)' END",
    "CASE WHEN len(hits) >= 2 THEN 'Multiple template phrases detected: [' || array_to_string(list_transform(hits[1:3], lambda h: '''' || h || ''''), ', ') || ']' WHEN n_only THEN 'Review is mostly a template phrase: ''' || hits[1] || '''' END",
    "CASE WHEN n_emoji >= 8 THEN 'Emoji spam (' || n_emoji || ' emojis)' END", f"CASE WHEN n_density < 0.4 THEN 'Low information density (' || {_PERCENT.format('n_density')} unique words)' END",
    f"CASE WHEN n_spaced > 0.6 THEN 'Spaced out text detected (obfuscation risk: ' || {_PERCENT.format('n_spaced')})' END",
    "CASE WHEN active >= 3 THEN 'Multiple bot signals detected (' || active || ' signals)' END",
)
_SINGLES = "len(list_filter(w, lambda x: length(x) = 1 AND regexp_matches(x, '[A-Za-z]')))"
_SCORED = (
    f", t1 AS (SELECT id, user_id, original_text, {_W} AS w, {_HITS} AS hits FROM raw), t2 AS (SELECT *, CASE WHEN {_LETTERS} > 5 AND len(w) > 4 THEN {_UPPER} / {_LETTERS} ELSE 0.0 END AS n_caps, len(regexp_extract_all(original_text, '{_RUN}')) AS n_chars, "
    f"{_SAME_WORDS.format(w='list_transform(w, lambda x: lower(x))')} AS n_words, len(regexp_extract_all(original_text, '[!?]{{3,}}')) AS n_punct, len(hits) = 1 AND len(w) <= len(string_split(hits[1], ' ')) + 3 AS n_only, 0 AS n_emoji, "
    f"CASE WHEN len(w) >= 5 THEN len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) ELSE 1.0 END AS n_density, CASE WHEN len(w) > 4 THEN {_SINGLES} / len(w) ELSE 0.0 END AS n_spaced FROM t1), "
    "t3 AS (SELECT *, " + ", ".join(f"({v})::DOUBLE AS v_{k}" for k, v in _VALUES.items()) + " FROM t2), "
    "t4 AS (SELECT *, " + " + ".join(f"(v_{k} > 0.3)::INTEGER" for k in lx.FAKE_WEIGHTS) + " AS active, " + " + ".join(f"v_{k} * {w}::DOUBLE" for k, w in lx.FAKE_WEIGHTS.items()) + " AS total FROM t3), "
    "t5 AS (SELECT *, least(CASE WHEN active >= 3 THEN total * 1.3::DOUBLE ELSE total END, 1.0::DOUBLE) AS s FROM t4), "
    f"scored AS (SELECT id, user_id, original_text, round_even(s, 3) AS fake_score, (s >= {lx.FAKE_THRESHOLD})::INTEGER AS is_suspicious, list_filter([{', '.join(_FLAGS)}], lambda x: x IS NOT NULL) AS flags FROM t5)"
)
_BATCHED = (
    f"{_SCORED}, f AS (SELECT *, regexp_replace(lower(original_text), '[^a-z]', '', 'g') AS fp FROM scored), g AS (SELECT *, length(fp) > 5 AND count(*) OVER (PARTITION BY fp) > 1 AS again FROM f), "
    "u AS (SELECT user_id, count(*) > 3 AS often, count(*) > 1 AND count(DISTINCT fp) < count(*) AS repeats FROM f GROUP BY 1), b AS (SELECT *, CASE WHEN again THEN least(fake_score + 0.25::DOUBLE, 1.0::DOUBLE) ELSE fake_score END AS x FROM g JOIN u USING (user_id)), "
    "batched AS (SELECT id, CASE WHEN often OR repeats THEN least(x + 0.3::DOUBLE, 1.0::DOUBLE) ELSE x END AS fake_score, len(flags) + again::INTEGER + often::INTEGER + repeats::INTEGER AS n_flags FROM b)"
)
_on_raw("fk12_score", lambda r: fake.score(r, "original_text").select("id", "fake_score", "is_suspicious", F.array_join("fake_flags", "|").alias("flags")),
        f"{_SCORED} SELECT id, fake_score, is_suspicious, array_to_string(flags, '|') AS flags FROM scored")


def _batch(r: DataFrame) -> DataFrame:
    return fake.score_batch(r.withColumn("ingestion_id", F.lit(1)), "original_text")


_on_raw("fk13_fingerprint", lambda r: _batch(r).select("id", F.exists("fake_flags", lambda f: F.startswith(f, F.lit("Identical text"))).alias("again")),
        "SELECT id, count(*) OVER (PARTITION BY regexp_replace(lower(original_text), '[^a-z]', '', 'g')) > 1 AND length(regexp_replace(lower(original_text), '[^a-z]', '', 'g')) > 5 AS again FROM raw")
_on_raw("fk14_user_bot", lambda r: _batch(r).select("id", "is_bot_user"),
        "SELECT id, (n > 3 OR (n > 1 AND k < n))::INTEGER AS is_bot_user FROM raw JOIN (SELECT user_id, count(*) AS n, count(DISTINCT regexp_replace(lower(original_text), '[^a-z]', '', 'g')) AS k FROM raw GROUP BY 1) USING (user_id)")
_on_raw("fk15_suspicious", lambda r: _batch(r).select("id", "is_suspicious", F.round("fake_score", 6).alias("fake_score")),
        f"{_BATCHED} SELECT id, (fake_score >= {lx.FAKE_THRESHOLD})::INTEGER AS is_suspicious, round(fake_score, 6) AS fake_score FROM batched")

# --- sentiment
_LISTS = {k: "['" + "', '".join(x.replace("'", "''") for x in v) + "']" for k, v in (("p", lx.POSITIVE), ("n", lx.NEGATIVE), ("x", lx.NEGATORS), ("i", lx.INTENSIFIERS))}
_STATE = "{{'score': {}, 'conf': {}, 'neg': {}, 'strong': {}}}"
_POLARITY = (
    f"list_reduce(list_prepend({_STATE.format('0.0::DOUBLE', '0.0::DOUBLE', 'false', 'false')}, list_transform(w, lambda t: "
    f"{_STATE.format(f'''(CASE WHEN list_contains({_LISTS['p']}, t) THEN 1.0 WHEN list_contains({_LISTS['n']}, t) THEN -1.0 ELSE 0.0 END)::DOUBLE''', '0.0::DOUBLE', f'''list_contains({_LISTS['x']}, t)''', f'''list_contains({_LISTS['i']}, t)''')})), "
    "lambda s, e: CASE WHEN e.neg THEN " + _STATE.format("s.score", "s.conf", "NOT s.neg", "s.strong") + " WHEN e.strong THEN " + _STATE.format("s.score", "s.conf", "s.neg", "true")
    + " WHEN e.score <> 0 THEN " + _STATE.format(
        "s.score + CASE WHEN NOT s.neg THEN e.score * CASE WHEN s.strong THEN 1.5 ELSE 1 END WHEN e.score > 0 THEN -0.5 * CASE WHEN s.strong THEN 1.5 ELSE 1 END WHEN s.strong THEN 0.2 ELSE 0.5 END",
        "s.conf + 0.5 * CASE WHEN s.strong THEN 1.5 ELSE 1 END", "false", "false") + " ELSE s END)"
)
_on_raw("sen2_polarity", lambda r: r.select("id", sentiment.polarity(words("original_text")).alias("p")).select("id", F.round("p.score", 6).alias("score"), F.round("p.confidence", 6).alias("confidence")),
        f"SELECT id, round(p.score, 6) AS score, round(least(p.conf, 1.0), 6) AS confidence FROM (SELECT id, {_POLARITY} AS p FROM (SELECT id, string_split(lower(original_text), ' ') AS w FROM raw))")
_on_raw("sen3_clauses", lambda r: r.select("id", F.array_join(sentiment.clauses(F.col("original_text")), "|").alias("c")),
        r"SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(original_text, '[.,;!\n]|\b(?:and|but|however|although|though)\b'), lambda x: trim(x)), lambda x: length(x) >= 3), '|') AS c FROM raw")
_on_raw("sen4_features", lambda r: sentiment.extract_features(r, "id", "original_text"))
_on_raw("sen6_ambiguity", lambda r: sentiment.analyze(r, "id", "original_text").select("id", "is_ambiguous", F.array_join("ambiguity_flags", "|").alias("flags")))
_on_raw("sen7_overall", lambda r: sentiment.analyze(r, "id", "original_text").select("id", "sentiment_label", "sentiment_score"))

# --- duplicates
_add("dup1_exact", lambda s, d: dedup.exact(_docs(s, d), "text", "doc_id").select("doc_id", "text_hash", "group_size", "is_exact_duplicate"),
     "SELECT doc_id, h AS text_hash, count(*) OVER (PARTITION BY h) AS group_size, (row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1)::INTEGER AS is_exact_duplicate FROM (SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS h FROM documents)")
# The stop words that occur in the derived reviews.
_STOP = "['" + "', '".join("the my a after i in for this is not but and very of".split()) + "']"
_TFIDF = (
    f", tw AS (SELECT id, list_filter(regexp_extract_all(lower(original_text), '\\b\\w\\w+\\b'), lambda x: NOT list_contains({_STOP}, x)) AS w FROM raw), "
    "tt AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tw), tc AS (SELECT id, term, count(*) AS tf FROM tt GROUP BY 1, 2), "
    f"tv AS (SELECT term, count(*) AS df FROM tc GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT {dedup.MAX_FEATURES}), tx AS (SELECT id, term, df, tf * (ln((1 + (SELECT count(*) FROM raw)) / (1 + df)) + 1) AS x FROM tc JOIN tv USING (term)), "
    "tfidf AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM tx)"
)
_on_raw("dup2_tfidf", lambda r: dedup.tfidf(r, "id", "original_text").select("id", "term", F.round("weight", 6).alias("weight")), f"{_TFIDF} SELECT id, term, round(weight, 6) AS weight FROM tfidf")
# clusters of links e(a, b) between the texts s(rep, ids): each row's cluster with its size, if it has others
_CLUSTERS = (
    "link AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, label) AS (SELECT rep, rep FROM s UNION SELECT b, label FROM reach JOIN link ON a = node), root AS (SELECT node, min(label) AS cluster FROM reach GROUP BY 1), "
    "member AS (SELECT id, cluster, original_text, count(*) OVER (PARTITION BY cluster) AS n FROM (SELECT unnest(ids) AS id, cluster FROM s JOIN root ON node = rep) JOIN raw USING (id)), "
    "clustered AS (SELECT id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY length(original_text) DESC, id) = 1 AS is_representative, n::INTEGER AS review_count FROM member WHERE n > 1)"
)
_COSINE = (
    f"{_TFIDF}, s AS (SELECT min(id) AS rep, list(id) AS ids FROM raw WHERE id IN (SELECT id FROM tfidf) GROUP BY original_text), one AS (SELECT rep, term, weight FROM tfidf JOIN s ON rep = id), "
    f"e AS (SELECT x.rep AS a, y.rep AS b FROM one x JOIN one y ON x.term = y.term AND x.rep < y.rep GROUP BY 1, 2 HAVING sum(x.weight * y.weight) >= 0.85 - 1e-9), {_CLUSTERS}, "
    "summed AS (SELECT cluster, review_count AS n, term, sum(weight) AS w, sum(weight * weight) AS q FROM clustered JOIN tfidf USING (id) GROUP BY 1, 2, 3), likeness AS (SELECT cluster, round_even((sum(w * w) - sum(q)) / (n * (n - 1)), 3) AS similarity_score FROM summed GROUP BY cluster, n)"
)


def _on_linked(name: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """SQL that follows links from text to text."""
    _add(name, lambda s, d: query(fx.raw(ready(s), d)), f"WITH RECURSIVE {fx.RAW_SQL} {sql}")


_on_linked("dup3_cosine_clusters", lambda r: dedup.clusters(r, "id", "original_text", 0.85, "tfidf"), f"{_COSINE} SELECT * FROM clustered JOIN likeness USING (cluster)")
_SHINGLES = "list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))"
_on_raw("dup6_jaccard_pairs", lambda r: dedup.jaccard_pairs(r, "id", "original_text").withColumn("similarity", F.round("similarity", 6)),
        f", s AS (SELECT min(id) AS rep, list_sort({_SHINGLES}) AS s, list(id) AS ids FROM (SELECT id, lower(trim(original_text)) AS t FROM raw) GROUP BY 2), "
        "p AS (SELECT a.rep AS a, b.rep AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n FROM s a JOIN s b ON a.rep < b.rep AND len(a.s) >= 0.85 * len(b.s) AND len(b.s) >= 0.85 * len(a.s)) "
        "SELECT a, b, round(i / (n - i), 6) AS similarity FROM p WHERE i / (n - i) >= 0.85 UNION ALL SELECT rep, x, 1.0 FROM (SELECT rep, unnest(ids) AS x FROM s) WHERE x <> rep")
_JACCARD = (
    f", s AS (SELECT min(id) AS rep, {_SHINGLES} AS s, list(id) AS ids FROM (SELECT id, lower(trim(original_text)) AS t FROM raw) GROUP BY t), "
    "e AS (SELECT a.rep AS a, b.rep AS b FROM s a JOIN s b ON a.rep < b.rep AND len(a.s) >= 0.85 * len(b.s) AND len(b.s) >= 0.85 * len(a.s) WHERE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.85), "
    f"{_CLUSTERS}, hashed AS (SELECT id, md5(regexp_replace(lower(original_text), '[^a-z0-9]', '', 'g')) AS h FROM raw), exact AS (SELECT id, h, count(*) OVER (PARTITION BY h) AS n, (row_number() OVER (PARTITION BY h ORDER BY id) > 1)::INTEGER AS is_exact_duplicate FROM hashed), "
    "marked AS (SELECT id, h, n, (is_exact_duplicate = 1 OR NOT coalesce(is_representative, true))::INTEGER AS is_duplicate, is_exact_duplicate, cluster AS cluster_id FROM exact LEFT JOIN clustered USING (id))"
)
_on_linked("dup4_components", lambda r: dedup.clusters(r, "id", "original_text").select("id", "cluster", "is_representative", "review_count"), f"{_JACCARD} SELECT * FROM clustered")
_on_linked("dup7_flags", lambda r: dedup.deduplicate(r, "id", "original_text").select("id", "is_duplicate", "is_exact_duplicate", "cluster_id"), f"{_JACCARD} SELECT id, is_duplicate, is_exact_duplicate, cluster_id FROM marked")
_on_linked("agg15_dedup_stats", lambda r: dedup.stats(dedup.deduplicate(r, "id", "original_text")),
           f"{_JACCARD} SELECT total, exact_groups, near_clusters, duplicates, total - duplicates AS \"unique\", round_even(duplicates / total * 100, 1) AS duplicate_rate FROM (SELECT count(*) AS total, count(DISTINCT h) FILTER (n > 1) AS exact_groups, count(DISTINCT cluster_id) AS near_clusters, sum(is_duplicate)::BIGINT AS duplicates FROM marked)")

# --- trends
_EXPLICIT = f"tagged AS (SELECT id, CASE WHEN substr(review_date, 1, 10) BETWEEN '{START}' AND '{END}' THEN 'recent' WHEN substr(review_date, 1, 10) < '{START}' THEN 'hist' END AS bucket FROM reviews)"
_DYNAMIC = ("days AS (SELECT id, substr(review_date, 1, 10)::DATE AS day FROM reviews), anchor AS (SELECT max(day) AS a FROM days), since AS (SELECT any_value(a) - coalesce(min(w) FILTER (n >= 10), 35)::INTEGER AS since FROM "
            "(SELECT a, w, count(*) FILTER (day >= a - w) AS n FROM days, anchor, (VALUES (7), (14), (21), (28), (35)) v(w) GROUP BY a, w)), tagged AS (SELECT id, CASE WHEN day >= since THEN 'recent' ELSE 'hist' END AS bucket FROM days, since)")
_on_reviews("trd2_explicit", lambda r: trends.tag(r, None, START, END), f", {_EXPLICIT} SELECT * FROM tagged")
_on_reviews("trd3_dynamic", lambda r: trends.tag(r), f", {_DYNAMIC} SELECT * FROM tagged")
_RATES = ("counts AS (SELECT feature, " + ", ".join(f"count(*) FILTER (bucket = '{b}'{x}) AS {b}_{s}" for b in ("recent", "hist") for s, x in (("total", ""), ("negative", " AND sentiment = 'negative'"), ("positive", " AND sentiment = 'positive'")))
          + " FROM fs JOIN tagged t ON t.id = review_id WHERE bucket IS NOT NULL GROUP BY 1)")
_RATED = ", ".join(f"{b}_{s} / greatest({b}_total, 1) AS {b}_{s}_rate" for b in ("recent", "hist") for s in ("negative", "positive"))
_on_both("trd5_rates", lambda r, f: trends.rates(r, f).select("feature", "recent_total", "hist_total", "volume_change", *[F.round(f"{b}_{s}_rate", 6).alias(f"{b}_{s}_rate") for b in ("recent", "hist") for s in ("negative", "positive")]),
         f", {_DYNAMIC}, {_RATES} SELECT feature, recent_total, hist_total, recent_total - hist_total AS volume_change, " + ", ".join(f"round({b}_{s} / greatest({b}_total, 1), 6) AS {b}_{s}_rate" for b in ("recent", "hist") for s in ("negative", "positive")) + " FROM counts")
_SPIKE = ("2024-01-29", "2024-01-30")


def _spiked(r: DataFrame, f: DataFrame) -> DataFrame:
    """Rates of two days in which all battery and price mentions are negative and all camera ones positive."""
    late = r.select(F.col("id").alias("_r"), (F.substring("review_date", 1, 10) >= _SPIKE[0]).alias("_late"))
    worse = F.when(F.col("_late") & F.col("feature").isin("battery", "price"), "negative").when(F.col("_late") & (F.col("feature") == "camera"), "positive").otherwise(F.col("sentiment"))
    return trends.rates(r, f.join(late, F.col("review_id") == F.col("_r")).withColumn("sentiment", worse), None, *_SPIKE)


_RULED = (
    f", tagged AS (SELECT id, substr(review_date, 1, 10) AS day, CASE WHEN substr(review_date, 1, 10) BETWEEN '{_SPIKE[0]}' AND '{_SPIKE[1]}' THEN 'recent' WHEN substr(review_date, 1, 10) < '{_SPIKE[0]}' THEN 'hist' END AS bucket FROM reviews), "
    f"spiked AS (SELECT feature, review_id, CASE WHEN day >= '{_SPIKE[0]}' AND feature IN ('battery', 'price') THEN 'negative' WHEN day >= '{_SPIKE[0]}' AND feature = 'camera' THEN 'positive' ELSE sentiment END AS sentiment FROM fs JOIN tagged t ON t.id = review_id), "
    + _RATES.replace("FROM fs JOIN", "FROM spiked JOIN")
    + f", rated AS (SELECT *, {_RATED} FROM counts WHERE recent_total >= 3 OR hist_total >= 3), ruled AS (SELECT *, CASE WHEN recent_negative_rate > 0.30 AND recent_negative_rate - hist_negative_rate > 0.15 THEN 'critical' "
    "WHEN recent_negative_rate > 0.20 AND recent_negative_rate - hist_negative_rate > 0.10 THEN 'warning' WHEN recent_positive_rate > 0.40 AND recent_positive_rate - hist_positive_rate > 0.15 THEN 'success' END AS severity FROM rated)"
)
_TEAM = "CASE WHEN feature = 'delivery' THEN 'Logistics Team' WHEN feature = 'price' THEN 'Management Team' WHEN feature IN ('battery', 'camera', 'display', 'software', 'audio') THEN 'Engineering Team' ELSE 'Customer Support' END"
_on_both("trd8_alerts", lambda r, f: trends.alerts(_spiked(r, f), *_SPIKE).select("feature", "severity", "alert_type", "assigned_team"),
         f"{_RULED} SELECT feature, severity, CASE severity WHEN 'critical' THEN 'Defect Spike' WHEN 'warning' THEN 'Emerging Concern' ELSE 'Praise Trend' END AS alert_type, {_TEAM} AS assigned_team FROM ruled WHERE severity IS NOT NULL")
_PCT = "round_even({} * 100, 0)::INTEGER"
_on_both("trd9_messages", lambda r, f: trends.alerts(_spiked(r, f), *_SPIKE).select("feature", "message"),
         f"{_RULED} SELECT feature, CASE severity WHEN 'critical' THEN 'CRITICAL: ''' || feature || ''' negative ratio surged to ' || {_PCT.format('recent_negative_rate')} || '% (was ' || {_PCT.format('hist_negative_rate')} || '%) between {_SPIKE[0]} and {_SPIKE[1]}. ' "
         f"|| recent_negative || ' complaints in ' || recent_total || ' mentions. Routing to ' || {_TEAM} || '.' WHEN 'warning' THEN 'WARNING: ''' || feature || ''' negativity rose to ' || {_PCT.format('recent_negative_rate')} || '% (was ' || {_PCT.format('hist_negative_rate')} || '% historic). Monitor ' || {_TEAM} || '.' "
         f"ELSE 'EXCELLENT: Users are loving ''' || feature || '''! Positive ratio grew to ' || {_PCT.format('recent_positive_rate')} || '% (was ' || {_PCT.format('hist_positive_rate')} || '%) between {_SPIKE[0]} and {_SPIKE[1]}.' END AS message FROM ruled WHERE severity IS NOT NULL")
_on_both("srt4_alert_order", lambda r, f: trends.alerts(_spiked(r, f), *_SPIKE).limit(2).select("feature", "severity"),
         f"{_RULED} SELECT feature, severity FROM ruled WHERE severity IS NOT NULL ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, feature LIMIT 2")
_on_both("trd1_guard", lambda r, f: trends.rates(r, f, "Tablet").agg(F.count(F.lit(1)).alias("features")), "SELECT 0::BIGINT AS features")
_on_reviews("trd4_index_split", trends.tag_by_index, "SELECT id, CASE WHEN row_number() OVER (ORDER BY review_date DESC, id DESC) <= greatest(5, (SELECT count(*) FROM reviews) // 5) THEN 'recent' ELSE 'hist' END AS bucket FROM reviews")
_on_both("trd7_teams", lambda r, f: f.select("feature").distinct().select("feature", trends.team(F.col("feature")).alias("assigned_team")), f"SELECT DISTINCT feature, {_TEAM} AS assigned_team FROM fs")
_on_reviews("trd11_preset", lambda r: listing.filter_dates(r, *trends.preset(7, "2024-01-30")).select("id", "review_date"), "SELECT id, review_date FROM reviews WHERE substr(review_date, 1, 10) BETWEEN '2024-01-23' AND '2024-01-30'")
_on_both("agg11_bucket_features", lambda r, f: trends.rates(r, f, None, START, END).select("feature", *[f"{b}_{s}" for b in ("recent", "hist") for s in ("total", "negative", "positive")]), f", {_EXPLICIT}, {_RATES} SELECT * FROM counts")
_on_both("agg12_trend_rates", lambda r, f: trends.trends(trends.rates(r, f)),
         f", {_DYNAMIC}, {_RATES} SELECT feature, recent_total AS recent_mentions, hist_total AS hist_mentions, " + ", ".join(f"round_even({b}_{s} / greatest({b}_total, 1) * 100, 1) AS {b}_{s}_pct" for s in ("negative", "positive") for b in ("recent", "hist")) + ", recent_total - hist_total AS volume_change FROM counts")
_SIDE = "(SELECT feature, count(*) AS total, count(*) FILTER (sentiment = 'negative') AS negative FROM fs JOIN tagged t ON t.id = review_id WHERE bucket = '{}' GROUP BY 1)"
_on_both("join3_outer_buckets", lambda r, f: trends.rates(r, f, None, START, END).select("feature", "recent_total", "recent_negative", "hist_total", "hist_negative", "volume_change"),
         f", {_EXPLICIT} SELECT feature, coalesce(a.total, 0) AS recent_total, coalesce(a.negative, 0) AS recent_negative, coalesce(b.total, 0) AS hist_total, coalesce(b.negative, 0) AS hist_negative, coalesce(a.total, 0) - coalesce(b.total, 0) AS volume_change "
         f"FROM {_SIDE.format('recent')} a FULL JOIN {_SIDE.format('hist')} b USING (feature)")


def _seeded(spark: SparkSession, d: str) -> DataFrame:
    """The alerts that the seeded battery defect of the derived reviews raises, from texts to alerts."""
    raw = fx.raw(ready(spark), d)
    cleaned = written(clean.clean(raw).select("id", "cleaned_text", "product_category", "review_date"))
    features = sentiment.extract_features(cleaned).withColumnRenamed("id", "review_id")
    return trends.trends(trends.rates(cleaned, features))


_add("trd_seeded_trends", _seeded)
_on_both("trd_reach", lambda r, f: trends.reach(r, f), "SELECT feature, count(DISTINCT user_id) AS unique_users, count(*) AS review_count, count(DISTINCT user_id) >= 3 AS is_systemic FROM fs JOIN reviews r ON r.id = review_id WHERE sentiment = 'negative' GROUP BY 1")
_on_both("agg19_radar", lambda r, f: trends.health_radar(trends.rates(r, f)).select("feature", F.col("recent").cast("long").alias("recent"), F.col("historical").cast("long").alias("historical")),
         f", {_DYNAMIC}, {_RATES} SELECT feature, (CASE WHEN recent_positive + recent_negative > 0 THEN floor(recent_positive / (recent_positive + recent_negative) * 100 + 0.5) ELSE 50 END)::BIGINT AS recent, "
         "(CASE WHEN hist_positive + hist_negative > 0 THEN floor(hist_positive / (hist_positive + hist_negative) * 100 + 0.5) ELSE 50 END)::BIGINT AS historical FROM counts ORDER BY feature LIMIT 8")

# --- sources and sinks
_on_raw("src2_csv", lambda r: ingest.from_csv_frame(r.select(F.col("original_text").alias("review"), F.col("rating").cast("string").alias("stars"), F.col("source").alias("other"))).select("original_text", "rating", "source"),
        "SELECT original_text, rating, 'csv_upload' AS source FROM raw WHERE original_text <> ''")
_on_raw("src4_json_items", lambda r: ingest.from_json_items(ingest._items(r.select(F.to_json(F.struct(F.array(F.struct(F.col("original_text").alias("text"), F.col("rating").alias("stars"), F.col("product_category").alias("category"))).alias("reviews"))).alias("j")), "j")).select("original_text", "rating", "product_category", "source"),
        "SELECT original_text, rating, product_category, 'json_upload' AS source FROM raw")
_add("src5_paste_lines", lambda s, d: ingest.from_lines(_docs(s, d), "text").groupBy("original_text").agg(F.count(F.lit(1)).alias("cnt")).select(F.md5("original_text").alias("h"), "cnt"),
     r"SELECT md5(l) AS h, count(*) AS cnt FROM (SELECT regexp_replace(l, '^\s+|\s+$', '', 'g') AS l FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE l <> '' GROUP BY l")
_on_raw("src9_alias", lambda r: ingest.from_records(r.select(F.to_json(F.struct(F.col("original_text").alias("content"), F.col("rating").cast("string").alias("score"), F.col("product_category").alias("product"), F.col("review_date").alias("date"), F.col("id")), {"ignoreNullFields": "false"}).alias("j")), "j").select("original_text", "rating", "product_category", "review_date", "original_review_id", "source"),
        "SELECT original_text, rating, product_category, review_date, id::VARCHAR AS original_review_id, 'upload' AS source FROM raw")
_add("src8_synthetic", lambda s, d: ingest.synthetic(ready(s), "2024-01-30").groupBy("product_category").agg(F.count(F.lit(1)).alias("cnt")), "SELECT * FROM (VALUES ('Smartphone', 80::BIGINT), ('Headphones', 60::BIGINT), ('Smartwatch', 75::BIGINT)) AS t(product_category, cnt)")
_on_both("snk7_csv_features", lambda r, f: report.csv_rows(r, f).select("id", "features", "review_date"),
         "SELECT r.id, coalesce(string_agg(feature || '(' || sentiment || ',' || round(confidence * 100)::INTEGER || '%)', '; ' ORDER BY fs.id), '') AS features, any_value(review_date) AS review_date FROM reviews r LEFT JOIN fs ON review_id = r.id GROUP BY r.id")
_on_reviews("ins1_insights", lambda r: dashboard.insights(r, START, END).select(F.explode("text_insights").alias("sentence")),
            f", d AS (SELECT * FROM reviews WHERE substr(review_date, 1, 10) BETWEEN '{START}' AND '{END}'), s AS (SELECT count(*) AS t, count(*) FILTER (is_suspicious = 1) AS x, count(*) FILTER (is_duplicate = 1) AS y, avg(fake_score) AS a, "
            f"count(*) FILTER (sentiment_label IN {_POS}) AS p, count(*) FILTER (sentiment_label IN {_NEG}) AS n FROM d), c AS (SELECT product_category AS c FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
            f"SELECT unnest(list_filter(['Analyzed ' || t || ' total reviews between {START} and {END}.', 'Your overall data quality score sits at ' || round((1 - (x + y) / t) * 100, 1) || '%, with ' || (t - x - y) || ' definitively clean and unique reviews.', "
            "'We flagged ' || x || ' reviews as highly suspicious or bot-generated (avg fake score: ' || round(a * 100)::INTEGER || '.0%), which were isolated from the clean pipeline.', 'The most discussed product category during this timeframe was ''' || c || '''.', "
            "CASE WHEN p > n THEN 'The general tone leans positive, with ' || p || ' positive reviews vs ' || n || ' negative complaints.' WHEN n > p THEN 'Sentiment is leaning significantly negative, with ' || n || ' direct complaints dwarfing positive feedback.' END], lambda z: z IS NOT NULL)) AS sentence FROM s, c")
_on_raw("review_pipeline", lambda r: run_pipeline(ingest.canonical(r.withColumn("seq", F.col("id")), "upload")).reviews.select("seq", "detected_language", "is_duplicate", "is_suspicious", "sentiment_label", "sentiment_score", F.size("features").alias("n_features")))


# --- alerts, logs, further filters and orders


def _on_alerts(name: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _add(name, lambda s, d: query(fx.alerts(ready(s), d)), f"WITH {fx.ALERTS_SQL} {sql}")


_on_alerts("fil4_alerts", lambda a: listing.filter_alerts(a, "open", "Logistics Team").select("id", "severity"), "SELECT id, severity FROM alerts WHERE status = 'open' AND assigned_team = 'Logistics Team'")
_on_alerts("agg20_alerts_by_severity", listing.alerts_by_severity, "SELECT severity, count(*) AS cnt, count(*) FILTER (status = 'open') AS open FROM alerts GROUP BY 1")
_on_alerts("snk5_resolve", lambda a: listing.resolve(a, 7).select("id", "status"), "SELECT id, CASE WHEN id = 7 THEN 'resolved' ELSE status END AS status FROM alerts")
_on_alerts("snk5_clear_open", lambda a: listing.without_open(a).select("id", "status"), "SELECT id, status FROM alerts WHERE status <> 'open'")
_on_alerts("srt4_newest_alerts", lambda a: listing.newest_alerts(a).limit(25).select("id"), "SELECT id FROM alerts ORDER BY detected_at DESC, id DESC LIMIT 25")
_on_raw("srt3_logs", lambda r: listing.newest_logs(r.select("id", F.col("ts").alias("created_at"), "source")).select("id", "source"), "SELECT id, source FROM raw ORDER BY ts DESC, id DESC LIMIT 20")
_on_both("srt6_top_features", lambda r, f: dashboard.feature_summary(f).limit(5).select("feature", "mentions"), "SELECT feature, count(*) AS mentions FROM fs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
_on_both("fil6_membership", lambda r, f: f.join(listing.filter_category(r, "Headphones").select(F.col("id").alias("review_id")), "review_id", "left_semi").select("id", "feature"),
         "SELECT id, feature FROM fs WHERE review_id IN (SELECT id FROM reviews WHERE product_category = 'Headphones')")
_on_reviews("dst2_explorer_categories", lambda r: dashboard.explorer_categories(r).select("product_category"), "SELECT DISTINCT product_category FROM reviews")
_on_both("win4_top_and_extremes", lambda r, f: dashboard.top_features(r, f).join(dashboard.complaint_and_praise(r, f), "product_category").select("product_category", "feature", "rank", (F.col("feature") == F.col("top_complaint")).alias("is_complaint")),
         f", {_FC} SELECT product_category, feature, rank, feature = top_complaint AS is_complaint FROM (SELECT *, (row_number() OVER (PARTITION BY product_category ORDER BY total DESC, feature))::INTEGER AS rank, "
         "first_value(CASE WHEN negative > 0 THEN feature END) OVER (PARTITION BY product_category ORDER BY negative DESC, feature DESC) AS top_complaint FROM fc) WHERE rank <= 5")
_on_raw("set3_shingle_overlap", lambda r: (lambda s: s.join(s.select((F.col("id") - 1).alias("id"), F.col("s").alias("o")), "id").select("id", F.size(F.array_intersect("s", "o")).cast("long").alias("common"), F.size(F.array_union("s", "o")).cast("long").alias("whole")))(
            r.select("id", F.lower("original_text").alias("t")).select("id", dedup.pieces(F.col("t")).alias("s"))),
        f", s AS (SELECT id, {_SHINGLES} AS s FROM (SELECT id, lower(original_text) AS t FROM raw)) SELECT a.id, len(list_intersect(a.s, b.s)) AS common, len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS whole FROM s a JOIN s b ON b.id = a.id + 1")
_on_raw("join6_batch_look_back", lambda r: _batch(r).select("id", "fake_score", F.size("fake_flags").cast("long").alias("n_flags")), f"{_BATCHED} SELECT id, fake_score, n_flags FROM batched")

# --- further text and language rules
_add("txt1_nfkc", lambda s, d: _docs(s, d).select("doc_id", F.md5(nfkc(F.concat(F.lit("ﬁne ① "), F.col("text")))).alias("h")))
_on_raw("txt5_emoji", lambda r: r.select("id", F.concat("original_text", F.lit(" 😊🔥 ok 👍")).alias("t")).select("id", clean.purge_emoji(F.col("t")).alias("t"), F.array_join(F.transform(clean.extract_emoji(F.col("t")), lambda e: e["emoji"]), "").alias("emoji")),
        r"SELECT id, regexp_replace(original_text || ' 😊🔥 ok 👍', '[\x{10000}-\x{10FFFF}]+', ' ', 'g') AS t, '😊🔥👍' AS emoji FROM raw")
_add("txt10_quotes", lambda s, d: _docs(s, d).select("doc_id", F.md5(clean.plain_quotes(F.concat(F.lit("‘a’ “b” –—"), F.col("text")))).alias("h")), "SELECT doc_id, md5(translate('‘a’ “b” –—' || text, '‘’“”–—', '''''\"\"--')) AS h FROM documents")
_GAP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_add("txt11_space", lambda s, d: _docs(s, d).select("doc_id", F.md5(clean.collapse_space(F.col("text"))).alias("h")), f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_GAP}+', ' ', 'g'), '^ | $', '', 'g')) AS h FROM documents")


def _marked(markers) -> str:
    return f"list_has_any(list_filter(regexp_split_to_array(d, '{_GAP}+'), lambda x: x <> ''), ['" + "', '".join(markers) + "'])"


_add("lng1_detect", lambda s, d: language.detect(_docs(s, d), "text").select("doc_id", "detected_language", "language_confidence"),
     f"SELECT doc_id, c AS detected_language, CASE WHEN c = 'unknown' THEN 0.0 WHEN c IN ('hinglish', 'kanglish') THEN 0.8 WHEN c = 'en' THEN 0.5 ELSE 0.7 END::DOUBLE AS language_confidence FROM (SELECT doc_id, CASE WHEN regexp_full_match(text, '{_GAP}*') THEN 'unknown' "
     f"WHEN length(d) < 3 THEN 'en' WHEN {_marked(lx.HINGLISH)} THEN 'hinglish' WHEN {_marked(lx.KANGLISH)} THEN 'kanglish' "
     r"WHEN regexp_matches(d, '[\x{0900}-\x{097F}]') THEN 'hi' WHEN regexp_matches(d, '[\x{4E00}-\x{9FFF}]') THEN 'zh' ELSE 'en' END AS c FROM (SELECT doc_id, text, "
     rf"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '[0-9]+', '', 'g'), '\[.*?\]', '', 'g'), '^{_GAP}+|{_GAP}+$', '', 'g')) AS d FROM documents))")
_HINGLISH_ID = "list_has_any(string_split(lower(original_text), ' '), ['" + "', '".join(lx.HINGLISH) + "'])"
_on_raw("lng4_detector", lambda r: language.detect(r, "original_text", lambda c: F.struct(F.lit("fr").alias("code"), F.lit(0.9).alias("confidence"))).select("id", "detected_language", "language_confidence"),
        f"SELECT id, CASE WHEN {_HINGLISH_ID} THEN 'hinglish' ELSE 'fr' END AS detected_language, CASE WHEN {_HINGLISH_ID} THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS language_confidence FROM raw")
_on_raw("lng5_translate", lambda r: language.translate(language.detect(r, "original_text"), "original_text", lambda t, code: F.concat(code, F.lit(": "), t)).select("id", "translated_text"),
        f"SELECT id, CASE WHEN {_HINGLISH_ID} THEN 'hinglish: ' || original_text END AS translated_text FROM raw")
_on_raw("sen1_token_features", lambda r: sentiment.token_features(r.select(F.explode(words(F.lower("original_text"))).alias("token"))))
_on_linked("dup5_representatives", lambda r: dedup.clusters(r, "id", "original_text", 0.85, "tfidf").where("is_representative").select("id", "cluster", "review_count"), f"{_COSINE} SELECT id, cluster, review_count FROM clustered WHERE is_representative")
_on_linked("agg17_cluster_similarity", lambda r: dedup.clusters(r, "id", "original_text", 0.85, "tfidf").select("cluster", "review_count", "similarity_score").distinct(), f"{_COSINE} SELECT DISTINCT cluster, review_count, similarity_score FROM clustered JOIN likeness USING (cluster)")
_on_raw("dup8_no_vocabulary", lambda r: dedup.clusters(r.withColumn("original_text", F.lit("the of and")), "id", "original_text", 0.85, "tfidf").agg(F.count(F.lit(1)).alias("clusters")), "SELECT 0::BIGINT AS clusters")

# --- further sources and sinks
_on_reviews("src10_scan", lambda r: r.drop("created_at"), "SELECT * EXCLUDE (created_at) FROM reviews")
_on_raw("src6_api_feed", lambda r: ingest.from_frame(r.select(F.col("original_text").alias("review"), F.col("rating").alias("stars"), F.col("product_category").alias("product"), "id")).select("original_text", "rating", "product_category", "original_review_id", "source"),
        "SELECT original_text, rating, product_category, id::VARCHAR AS original_review_id, 'api_feed' AS source FROM raw")
_on_raw("snk1_dense_ids", lambda r: dense_ids(r.select(F.col("id").alias("seq")), "seq", 100).select("seq", "id"), "SELECT id AS seq, row_number() OVER (ORDER BY id) + 100 AS id FROM raw")
_on_both("snk2_feature_rows", lambda r, f: listing.attach_features(r, f).select(F.col("id").alias("review_id"), F.explode("features").alias("x")).select("review_id", "x.id", "x.feature", "x.sentiment", "x.confidence"), "SELECT review_id, id, feature, sentiment, confidence FROM fs")
_on_reviews("snk4_log_rows", lambda r: dashboard.batch_counters(r).join(dashboard.language_counts(r), "ingestion_id").select("ingestion_id", "total_count", "valid_count", F.size("language_distribution").cast("long").alias("languages")),
            "SELECT ingestion_id, count(*) AS total_count, count(*) FILTER (is_suspicious = 0) AS valid_count, count(DISTINCT detected_language) AS languages FROM reviews GROUP BY 1")
_add("snk8_response", lambda s, d: response(Batch(_docs(s, d).select("doc_id", F.col("text").alias("original_text"), F.lower("text").alias("cleaned_text"), F.lit(None).cast("string").alias("translated_text")), None, None, None)).select("doc_id", F.md5("original_text").alias("o"), F.length("cleaned_text").cast("long").alias("c"), "translated_text"),
     "SELECT doc_id, md5(substr(text, 1, 200)) AS o, length(substr(lower(text), 1, 200)) AS c, NULL::VARCHAR AS translated_text FROM documents")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Category comparison over reviews scored from their texts."""
    raw = fx.raw(ready(spark), d)
    scored = raw.withColumn("p", sentiment.polarity(words("original_text"))["score"])
    label = F.when(F.col("p") > 0.5, "positive").when(F.col("p") < -0.5, "negative").otherwise("neutral")
    return dashboard.compare_categories(scored.withColumns({"sentiment_label": label, "is_suspicious": F.lit(0)}))
