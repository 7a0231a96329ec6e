"""Aspect sentiment, ambiguity and overall sentiment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import lexicons as lx
from revlens.functions.text import compact, literal_array, strip, words

CLAUSES = r"[.,;!\n]|\b(?:and|but|however|although|though)\b"
#: Likeness of a token to a keyword from which it counts as misspelt.
CUTOFF = 0.8
FEATURE = "array<struct<feature:string,sentiment:string,confidence:double,evidence:string>>"


def polarity(w: Column) -> Column:
    """struct<score, confidence> of a word list, by a left-to-right machine with the states negated and intensified."""
    pos, neg, nots, more = (literal_array(x) for x in (lx.POSITIVE, lx.NEGATIVE, lx.NEGATORS, lx.INTENSIFIERS))

    def step(s: Column, word: Column) -> Column:
        v = F.when(F.array_contains(pos, word), 1.0).when(F.array_contains(neg, word), -1.0)
        strength = F.when(s["strong"], 1.5).otherwise(1.0)
        meant = F.when(~s["negated"], v * strength).when(v > 0, -0.5 * strength).when(s["strong"], 0.2).otherwise(0.5)
        make = lambda score, conf, negated, strong: F.struct(score.alias("score"), conf.alias("confidence"), negated.alias("negated"), strong.alias("strong"))
        return (
            F.when(F.array_contains(nots, word), make(s["score"], s["confidence"], ~s["negated"], s["strong"]))
            .when(F.array_contains(more, word), make(s["score"], s["confidence"], s["negated"], F.lit(True)))
            .when(v.isNotNull(), make(s["score"] + meant, s["confidence"] + 0.5 * strength, F.lit(False), F.lit(False)))
            .otherwise(s)
        )

    start = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"), F.lit(False).alias("negated"), F.lit(False).alias("strong"))
    return F.aggregate(F.transform(w, F.lower), start, step, lambda s: F.struct(s["score"].alias("score"), F.least(s["confidence"], F.lit(1.0)).alias("confidence")))


def clauses(text: Column) -> Column:
    """Stripped clauses of three characters and more."""
    return F.filter(F.transform(F.split(text, CLAUSES), strip), lambda c: F.length(c) >= 3)


def feature_of(token: str) -> str | None:
    """First aspect of the taxonomy that has the token, its singular or a keyword much like it."""
    import difflib

    for feature, keywords in lx.TAXONOMY.items():
        if token in keywords or token.endswith("s") and token[:-1] in keywords:
            return feature
        if difflib.get_close_matches(token, keywords, n=1, cutoff=CUTOFF):
            return feature
    return None


def _map_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = batch.assign(feature=[feature_of(t) for t in batch["token"]])
        yield found[found["feature"].notna()]


def token_features(tokens: DataFrame) -> DataFrame:
    """token, feature of the distinct tokens that name an aspect. A likeness ratio of at least CUTOFF needs lengths that
    differ by a factor of 1.5 at most, so tokens too long or short for every keyword never reach Python."""
    return tokens.where(F.length("token").between(1, 20)).distinct().mapInPandas(_map_tokens, "token string, feature string")


def extract_features(df: DataFrame, id_col: str = "id", text: str = "cleaned_text") -> DataFrame:
    """id, feature, sentiment, confidence, evidence: one row for each aspect of each review."""
    split = df.select(F.col(id_col).alias("id"), F.posexplode(clauses(F.coalesce(F.col(text), F.lit("")))).alias("pos", "clause"))
    scored = split.select("id", "pos", "clause", words("clause").alias("w")).withColumn("p", polarity(F.col("w")))
    tokens = scored.select("id", "pos", F.explode(F.array_distinct(F.transform("w", F.lower))).alias("token"))
    named = tokens.join(token_features(tokens.select("token")), "token").select("id", "pos", "feature").distinct()
    by = (
        named.join(scored.select("id", "pos", "clause", "p"), ["id", "pos"])
        .groupBy("id", "feature")
        .agg(
            F.sum("p.score").alias("score"), F.max("p.confidence").alias("conf"), F.count(F.lit(1)).alias("mentions"),
            F.max_by("clause", F.struct(F.length("clause"), -F.col("pos"))).alias("evidence"),
        )
    )
    mean = F.col("score") / F.col("mentions")
    label = F.when(mean > 0.5, "positive").when(mean < -0.5, "negative").when((F.col("mentions") > 1) & (F.abs("score") < 1.0), "mixed").otherwise("neutral")
    conf = F.least(F.lit(1.0), F.col("conf") + 0.1 * (F.col("mentions") - 1))
    return by.select("id", "feature", label.alias("sentiment"), F.bround(F.when(conf < 0.2, 0.5).otherwise(conf), 2).alias("confidence"), "evidence")


def _count(features: Column, sentiment: str) -> Column:
    return F.size(F.filter(features, lambda f: f["sentiment"] == sentiment))


def python_float(c: Column) -> Column:
    return F.when(c == F.floor(c), F.concat(c.cast("long").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def sarcasm(text: Column) -> Column:
    """The flags of a text's sarcastic phrases, for a rating that isn't high."""
    return compact(*[F.when(F.lower(text).rlike(p), F.lit("Potential sarcasm detected ('" + p.replace(r"\s?", " ") + "')")) for p in lx.SARCASM])


def ambiguity_flags(rating: Column, pos: Column, neg: Column, n: Column, pol: Column, sarcastic: Column) -> Column:
    """pos, neg, n: positive, negative and all features; pol: the polarity of the text in lower case."""
    mismatch = (
        F.when((rating >= 4) & (neg > 0) & (pos == 0), "High rating but solely negative features extracted")
        .when((rating >= 4) & (pol < -1.0), "High rating but strong negative text")
        .when((rating <= 2) & (pos > 0) & (neg == 0), "Low rating but solely positive features extracted")
        .when((rating <= 2) & (pol > 1.0), "Low rating but strong positive text")
    )
    extreme = F.when(
        (n >= 2) & (pos > 0) & (pos == neg) & rating.isin(1.0, 5.0),
        F.concat(F.lit("Extreme rating ("), python_float(rating), F.lit("★) but perfectly mixed feedback")),
    )
    return F.concat(compact(mismatch), F.when(rating <= 3, sarcastic).otherwise(F.array().cast("array<string>")), compact(extreme))


def overall_label(combined: Column, pos: Column, neg: Column, flags: Column) -> Column:
    sarcastic = F.exists(flags, lambda f: F.contains(F.lower(f), F.lit("sarcasm")))
    mixed = (pos > 0) & (neg > 0) & (F.abs(pos - neg) <= 1)
    return (
        F.when(sarcastic | mixed, "mixed").when(combined >= 3.0, "very_positive").when(combined > 0.5, "positive")
        .when(combined <= -3.0, "very_negative").when(combined < -0.5, "negative").otherwise("neutral")
    )


def analyze(df: DataFrame, id_col: str = "id", text: str = "cleaned_text", rating: str = "rating") -> DataFrame:
    """Adds features, sentiment_score, sentiment_label, ambiguity_flags, is_ambiguous."""
    return rated(of_texts(df, id_col, text), rating)


def of_texts(df: DataFrame, id_col: str = "id", text: str = "cleaned_text") -> DataFrame:
    """`df` with features and all else that doesn't depend on the rating, for `rated`."""
    item = F.struct("feature", "sentiment", "confidence", "evidence")
    found = extract_features(df, id_col, text).groupBy("id").agg(F.sort_array(F.collect_list(item)).alias("features")).withColumnRenamed("id", "_id")
    out = df.join(found, F.col(id_col) == F.col("_id"), "left").drop("_id").withColumn("features", F.coalesce("features", F.array().cast(FEATURE)))
    whole = F.coalesce(F.col(text), F.lit(""))
    pos, neg = _count(F.col("features"), "positive"), _count(F.col("features"), "negative")
    scores = {"_pol": polarity(words(whole))["score"], "_low": polarity(words(F.lower(whole)))["score"]}
    return out.withColumns({"_pos": pos, "_neg": neg, "_sarcasm": sarcasm(whole)} | scores)


def rated(df: DataFrame, rating: str = "rating") -> DataFrame:
    """The verdicts on rows that have the columns of `of_texts`."""
    pos, neg = F.col("_pos"), F.col("_neg")
    out = df.withColumn("ambiguity_flags", ambiguity_flags(F.col(rating), pos, neg, F.size("features"), F.col("_low"), F.col("_sarcasm")))
    out = out.withColumn("_combined", F.col("_pol") + pos - neg)
    return out.withColumns(
        {
            "sentiment_score": F.bround("_combined", 2),
            "sentiment_label": overall_label(F.col("_combined"), pos, neg, F.col("ambiguity_flags")),
            "is_ambiguous": (F.size("ambiguity_flags") > 0).cast("int"),
        }
    ).drop("_pol", "_low", "_pos", "_neg", "_sarcasm", "_combined")
