"""Quality rules with host-level verdicts. Main path: DataFrame functions only.

Every whole text is measured in one projection. The failures are then summed by host (the `source` column), each
host's failure rate is shrunk towards the mean by a beta prior fitted to all hosts by the method of moments, and
hosts whose shrunk rate reaches a threshold lose all their documents; the verdict is joined back.

Defined results: a null text has no words and fails; an empty text likewise; repeated rows are measured and kept as
often as they occur; a null host is one host of its own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import table, text_or_empty, written

#: Words in a window of repeated words.
WINDOW = 8
#: A document of fewer words fails.
LEAST_WORDS = 20
#: So many percent of the words in repeated windows pass still.
MOST_REPEATED_PERCENT = 30
#: A host with at least this shrunk rate of failing documents is rejected as a whole.
HOST_FAIL_RATE = 0.5
#: Weight of the prior in documents where the hosts' rates don't spread enough to fit one.
FALLBACK_STRENGTH = 100.0
_SPACE = " \t\n\x0b\f\r"


def _covered(first: Column) -> Column:
    """How many words lie in windows that start at the ascending positions `first`."""
    # the array stands twice in the expression, which keeps the optimizer from inlining it into the lambda
    return F.aggregate(
        F.transform(first, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(first, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.col("t")
    words = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        text_or_empty(text_col).alias("t"),
    ).select(
        "doc_id",
        "host",
        F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"),
        F.length(F.translate(t, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = words.select(
        "doc_id", "host", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))),
        ).alias("h"),
    )
    # most texts repeat no window, which the number of distinct hashes tells at once
    again = F.size(F.array_distinct("h")) < F.size("h")
    pairs = hashed.select(
        "*", F.when(again, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s")
    ).drop("h")
    s = F.col("s")
    firsts = pairs.select(
        "*",
        F.array_sort(
            F.transform(
                F.filter(
                    F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), ((x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"])).alias("twice"))),
                    lambda x: F.coalesce(x["twice"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ).alias("first"),
    ).drop("s")
    out = firsts.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.when(F.col("first").isNotNull(), _covered(F.col("first"))), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
    )


def host_verdicts(measured: DataFrame, threshold: float = HOST_FAIL_RATE) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_kept. The prior Beta(m*k, (1-m)*k) has the moments of the hosts' rates."""
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"),
        F.var_pop(rate).alias("v"),
        F.avg(1 / F.col("n_docs")).alias("inv"),
    )
    # of the spread of the rates, m(1-m)/n is chance; the rest is the spread between hosts
    m, between = F.col("m"), F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv")
    strength = F.when(between > 1e-12, F.greatest(F.lit(1.0), m * (1 - m) / between - 1)).otherwise(F.lit(FALLBACK_STRENGTH))
    prior = moments.select("m", F.coalesce(strength, F.lit(FALLBACK_STRENGTH)).alias("k"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    return hosts.crossJoin(F.broadcast(prior)).select(  # one row
        "host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk < threshold).alias("host_kept")
    )


def quality_rules(docs: DataFrame, threshold: float = HOST_FAIL_RATE, **columns: str) -> DataFrame:
    """Measures, base verdict, the host's shrunk rate and `kept`."""
    measured = written(measure(docs, **columns))  # measured once, read for the hosts and for the result
    hosts = host_verdicts(measured, threshold).select(F.col("host").alias("of"), "shrunk_rate", "host_kept")
    return measured.join(hosts, F.col("host").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"),
        F.round("shrunk_rate", 6).alias("host_fail_rate"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8
), k AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i + 7], ' ')) AS c FROM g
), r AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM k WHERE c > 1) GROUP BY rid
), m AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), h AS (
  SELECT host, count(*) AS n_docs, count(*) FILTER (base_failed) AS n_failed FROM b GROUP BY host
), p AS (
  SELECT sum(n_failed) / sum(n_docs) AS m, var_pop(n_failed / n_docs) AS v, avg(1 / n_docs) AS inv FROM h
), q AS (
  SELECT m, CASE WHEN v - m * (1 - m) * inv > 1e-12 THEN greatest(1.0, m * (1 - m) / (v - m * (1 - m) * inv) - 1) ELSE 100.0 END AS k FROM p
), s AS (
  SELECT host, (n_failed + m * k) / (n_docs + k) AS rate FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate < 0.5 AS kept, round(rate, 6) AS host_fail_rate
FROM b JOIN s ON b.host IS NOT DISTINCT FROM s.host
"""
