"""Fake and bot signals: eleven weighted signals of a text, and what batch statistics add."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import lexicons as lx
from revlens.functions.clean import EMOJI_SPAM, REPEATED_WORD
from revlens.functions.text import compact, let, literal_array, percent, strip, words

# The flags' wordings are fixed values.


def _signal(value: Column, flag: Column | None = None) -> Column:
    """struct<v, f>: a signal's value, and its flag (null where there is none)."""
    return F.struct(value.cast("double").alias("v"), (F.lit(None).cast("string") if flag is None else flag).alias("f"))


def too_short(w: Column) -> Column:
    n = F.size(w)
    value = F.when(n <= 3, 1.0).when(n <= 6, 0.5).otherwise(0.0)
    return _signal(value, F.when(n <= 3, F.format_string("Very short review (%d words)", n)).when(n <= 6, F.format_string("Short review (%d words)", n)))


def too_long(w: Column) -> Column:
    n = F.size(w)
    return _signal(F.when(n > 500, 0.8).when(n > 300, 0.4).otherwise(0.0), F.when(n > 500, F.format_string("Unusually long review (%d words)", n)))


def all_caps(t: Column, w: Column) -> Column:
    share = let(F.regexp_count(t, F.lit(r"\p{L}")), lambda n: F.when((n > 5) & (F.size(w) > 4), F.regexp_count(t, F.lit(r"\p{Lu}")) / n).otherwise(0.0))

    def told(ratio: Column) -> Column:
        text = F.when(ratio > 0.8, F.concat(F.lit("Mostly ALL CAPS ("), percent(ratio), F.lit(")")))
        return _signal(F.when(ratio > 0.8, 1.0).when(ratio > 0.5, 0.5).otherwise(0.0), text.when(ratio > 0.5, F.concat(F.lit("High caps ratio ("), percent(ratio), F.lit(")"))))

    return let(share, told)


def _counted(t: Column, pattern: str, steps: tuple[tuple[int, float], ...], flag: str) -> Column:
    """The value of the first of `steps` (least count, value) that the number of matches reaches; flagged at the first."""

    def told(n: Column) -> Column:
        value = F.lit(0.0)
        for least, v in reversed(steps):
            value = F.when(n >= least, v).otherwise(value)
        return _signal(value, F.when(n >= steps[0][0], F.format_string(flag, n) if "%d" in flag else F.lit(flag)))

    return let(F.regexp_count(t, F.lit(pattern)), told)


def repeated_chars(t: Column) -> Column:
    return _counted(t, r"([^\n])\1{4,}", ((3, 1.0), (1, 0.4)), "Excessive repeated characters (%d instances)")


def repeated_words(t: Column) -> Column:
    return _counted(t, REPEATED_WORD, ((2, 1.0), (1, 0.5)), "Excessive word repetition")


def excessive_punctuation(t: Column) -> Column:
    return _counted(t, r"[!?]{3,}", ((3, 1.0), (1, 0.4)), "Excessive punctuation (%d sequences)")


def template_match(t: Column) -> Column:
    def told(lower: Column, hits: Column) -> Column:
        first = F.get(hits, 0)
        only = (F.size(hits) == 1) & (F.size(words(lower)) <= F.size(words(first)) + 3)
        listed = F.concat(F.lit("["), F.array_join(F.transform(F.slice(hits, 1, 3), lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", "), F.lit("]"))
        flag = F.when(F.size(hits) >= 2, F.concat(F.lit("Multiple template phrases detected: "), listed)).when(only, F.concat(F.lit("Review is mostly a template phrase: '"), first, F.lit("'")))
        return _signal(F.when(F.size(hits) >= 2, 1.0).when(only, 0.9).when(F.size(hits) == 1, 0.3).otherwise(0.0), flag)

    phrases = literal_array(lx.FAKE_TEMPLATES)
    return let(F.lower(strip(t)), lambda lower: let(F.filter(phrases, lambda p: F.contains(lower, p)), lambda hits: told(lower, hits)))


def emoji_spam(t: Column) -> Column:
    return _counted(t, EMOJI_SPAM, ((8, 1.0), (4, 0.5)), "Emoji spam (%d emojis)")


def low_info_density(w: Column) -> Column:
    share = F.when(F.size(w) >= 5, F.size(F.array_distinct(F.transform(w, F.lower))) / F.size(w)).otherwise(1.0)
    flag = lambda d: F.when(d < 0.4, F.concat(F.lit("Low information density ("), percent(d), F.lit(" unique words)")))
    return let(share, lambda d: _signal(F.when(d < 0.4, 1.0).when(d < 0.6, 0.5).otherwise(0.0), flag(d)))


def rating_mismatch(rating: Column, label: Column) -> Column:
    low = F.lower(label)
    off = ((rating >= 4) & low.isin("negative", "very_negative")) | ((rating <= 2) & low.isin("positive", "very_positive"))
    flag = F.when(off, F.concat(F.lit("Rating ("), rating.cast("string"), F.lit("★) contradicts sentiment ("), label, F.lit(")")))
    return _signal(F.when(off, 1.0).otherwise(0.0), flag)


def spaced_text(w: Column) -> Column:
    single = F.size(F.filter(w, lambda x: (F.length(x) == 1) & x.rlike(r"\p{L}")))
    flag = lambda r: F.when(r > 0.6, F.concat(F.lit("Spaced out text detected (obfuscation risk: "), percent(r), F.lit(")")))
    return let(F.when(F.size(w) > 4, single / F.size(w)).otherwise(0.0), lambda r: _signal(F.when(r > 0.6, 1.0).when(r > 0.3, 0.5).otherwise(0.0), flag(r)))


def score(df: DataFrame, text: str = "cleaned_text", rating: str | None = None, label: str | None = None) -> DataFrame:
    """Adds fake_score (3 places), is_suspicious, fake_flags, signal_details of each text alone."""
    mismatch = rating_mismatch(F.col(rating), F.col(label)) if rating and label else _signal(F.lit(0.0))

    def signals(t: Column, w: Column) -> Column:
        each = {
            "too_short": too_short(w), "too_long": too_long(w), "all_caps": all_caps(t, w), "repeated_chars": repeated_chars(t),
            "repeated_words": repeated_words(t), "excessive_punctuation": excessive_punctuation(t), "template_match": template_match(t),
            "emoji_spam": emoji_spam(t), "low_info_density": low_info_density(w), "rating_mismatch": mismatch, "spaced_text": spaced_text(w),
        }
        return F.struct(*[s.alias(k) for k, s in each.items()])

    def scored(s: Column) -> Column:
        value = {k: s[k]["v"] for k in lx.FAKE_WEIGHTS}
        active = reduce(add, [F.when(v > 0.3, 1).otherwise(0) for v in value.values()])
        total = reduce(add, [v * lx.FAKE_WEIGHTS[k] for k, v in value.items()])
        raw = F.least(F.when(active >= 3, total * 1.3).otherwise(total), F.lit(1.0))
        many = F.when(active >= 3, F.format_string("Multiple bot signals detected (%d signals)", active))
        details = F.create_map(*[x for k, v in value.items() for x in (F.lit(k), v)])
        return F.struct(raw.alias("raw"), compact(*[s[k]["f"] for k in value], many).alias("flags"), details.alias("details"))

    blank = F.coalesce(strip(F.col(text)) == "", F.lit(True))
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_s", F.when(~blank, let(t, lambda x: let(words(x), lambda w: let(signals(x, w), scored)))))
    found = F.col("_s").isNotNull()
    return out.withColumns(
        {
            "fake_score": F.when(found, F.bround("_s.raw", 3)).otherwise(0.0),
            "is_suspicious": F.when(found, (F.col("_s.raw") >= lx.FAKE_THRESHOLD).cast("int")).otherwise(0),
            "fake_flags": F.when(found, F.col("_s.flags")).otherwise(F.array(F.lit("empty_review"))),
            "signal_details": F.when(found, F.col("_s.details")).otherwise(F.create_map().cast("map<string,double>")),
        }
    ).drop("_s")


def fingerprint(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", "")


def score_batch(df: DataFrame, text: str = "cleaned_text", user: str = "user_id", batch: str = "ingestion_id", **columns: str) -> DataFrame:
    """`score`, then boosts for texts that occur again in the batch and for users who post much or repeat themselves."""
    plain = df.withColumn("_fp", fingerprint(F.col(text)))
    out = with_posts(repeated(score(plain, text, **columns), plain, batch), posts(plain, "_fp", user, batch), user, batch)
    return boosted(out).drop("_fp")


def _dealt(key: Column) -> Column:
    """`key`, or where it is null one of a thousand that nothing has: rows without a key have no counts, and are no hot key."""
    return F.coalesce(key, F.concat(F.lit("\0"), (F.monotonically_increasing_id() % 1024).cast("string")))


def repeated(df: DataFrame, plain: DataFrame, batch: str = "ingestion_id", copies: str | None = None) -> DataFrame:
    """Adds _same: how often the fingerprint _fp occurs in the batch among `plain`, whose rows stand for `copies` each; null
    if once, or for fingerprints of five letters or fewer. Counts are aggregated first and joined back."""
    times = F.lit(1) if copies is None else F.col(copies)
    long = F.when(F.length("_fp") > 5, F.col("_fp"))
    same = plain.where(long.isNotNull()).groupBy(F.col(batch).alias("_b"), F.col("_fp").alias("_f1")).agg(F.sum(times).alias("_same")).where("_same > 1")
    return df.withColumn("_f", _dealt(long)).join(same, F.col(batch).eqNullSafe(F.col("_b")) & (F.col("_f") == F.col("_f1")), "left").drop("_b", "_f", "_f1")


def _user(user: str) -> Column:
    return F.when(F.col(user) != "", F.col(user))


def posts(df: DataFrame, kind: str, user: str = "user_id", batch: str = "ingestion_id") -> DataFrame:
    """_b, _u, _posts, _kinds: rows, and different values of `kind`, of users with several rows."""
    found = df.where(_user(user).isNotNull()).groupBy(F.col(batch).alias("_b"), F.col(user).alias("_u"))
    return found.agg(F.count(F.lit(1)).alias("_posts"), F.count_distinct(kind).alias("_kinds")).where("_posts > 1")


def with_posts(df: DataFrame, found: DataFrame, user: str = "user_id", batch: str = "ingestion_id") -> DataFrame:
    """Adds _posts and _kinds of the row's user."""
    return df.withColumn("_w", _dealt(_user(user))).join(found, F.col(batch).eqNullSafe(F.col("_b")) & (F.col("_w") == F.col("_u")), "left").drop("_b", "_u", "_w")


def boosted(df: DataFrame) -> DataFrame:
    """The verdicts on rows that have the columns of `score`, `repeated` and `with_posts`."""
    again, often = F.coalesce(F.col("_same") > 1, F.lit(False)), F.coalesce(F.col("_posts") > 3, F.lit(False))
    repeats = F.coalesce(F.col("_kinds") < F.col("_posts"), F.lit(False))
    raised = F.when(again, F.least(F.col("fake_score") + 0.25, F.lit(1.0))).otherwise(F.col("fake_score"))
    final = F.when(often | repeats, F.least(raised + 0.3, F.lit(1.0))).otherwise(raised)
    flags = compact(
        F.when(again, F.format_string("Identical text found across %d reviews", F.col("_same"))),
        F.when(often, F.format_string("Customer flagged: Hyper-active user (%d reviews in batch)", F.col("_posts"))),
        F.when(repeats, F.lit("Customer flagged: User repeating identical text across products")),
    )
    out = df.withColumns({"is_bot_user": (often | repeats).cast("int"), "fake_flags": F.concat("fake_flags", flags), "fake_score": final})
    return out.withColumn("is_suspicious", (F.col("fake_score") >= lx.FAKE_THRESHOLD).cast("int")).drop("_same", "_posts", "_kinds")
