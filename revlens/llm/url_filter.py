"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

Main path: DataFrame functions only.

A listed entry is a host and the beginning of a path; it fits its host, all subdomains of it and every path with
that beginning. The canonical form of an entry, and of a URL's candidates, is host || path. A URL has one
candidate for each suffix of its host (cut at dots) and each path length that occurs in the list, so long lists
cost no more than short ones. Candidates are tested against the Bloom filter first; only possible hits are
exploded and joined, which removes the filter's false positives. The longest fitting entry decides.

Defined results: a null URL, or one without "://", has empty host and path and so fits no entry; an URL that
occurs in many rows is judged once and the verdict joined back, so repeated rows keep their number; an empty
table gives an empty result; very long URLs are read whole; of entries of equal length that fit, that of the longer host
decides; other columns of the input are ignored; an empty list gives the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import table

#: (verdict, host, path): the production list.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Verdict on URLs that no entry fits.
DEFAULT_VERDICT = "allow"
#: Bits of the Bloom filter for each entry, and its greatest size in 64-bit blocks: 8 MB, for half a million entries at
#: full precision. Of longer lists more URLs are joined for nothing; the result is the same.
BITS_AN_ENTRY, MOST_BLOCKS = 64, 1 << 20
#: Bytes up to which the list itself is broadcast, counted as four for each character and 32 for each entry.
BROADCAST_BYTES = 8 << 20
#: Bits set in its block by each entry.
BLOOM_BITS = 4


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path of a URL, both empty where there is no "://"."""
    after = F.instr(url, "://")
    rest = F.when(after > 0, F.substring(url, after + 3, F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """The bits that a key has in its block: six bits of a second hash choose each of them."""
    h = F.xxhash64(key, F.lit(7))
    mask = F.lit(0).cast("long")
    for i in range(BLOOM_BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def blocks_for(entries: int) -> int:
    """Blocks of the filter of so many entries: a power of two."""
    return min(MOST_BLOCKS, max(64, 1 << (entries * BITS_AN_ENTRY // 64).bit_length()))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """One row: `bloom`, the bits of each block, and `lengths`, the path lengths in the list.

    The array has `blocks` entries, whatever the size of the list, so it can be broadcast.
    """
    key = F.concat("rule_host", "rule_path")
    bits = (
        listed.groupBy(_block(key, blocks).alias("b"))
        .agg(F.bit_or(_mask(key)).alias("m"))
        .join(listed.sparkSession.range(blocks).select(F.col("id").cast("int").alias("b")), "b", "right")
        .agg(F.sort_array(F.collect_list(F.struct("b", F.coalesce("m", F.lit(0).cast("long")).alias("m")))).alias("x"))
        .select(F.col("x.m").alias("bloom"))
    )
    return bits.crossJoin(listed.agg(F.collect_set(F.length("rule_path")).alias("lengths")))  # one row beside one row


def possible_hits(parts: DataFrame, entries: DataFrame, blocks: int) -> DataFrame:
    """`parts` (host, path) with `hits`: the candidates that pass the Bloom filter, as (rule_host, rule_path)."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    lengths = F.filter("lengths", lambda n: n <= F.length("path"))
    candidates = F.flatten(
        F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.struct(s.alias("rule_host"), F.substring(F.col("path"), F.lit(1), n).alias("rule_path"))))
    )

    def possible(x: Column) -> Column:
        key = F.concat(x["rule_host"], x["rule_path"])
        mask = _mask(key)
        return F.get("bloom", _block(key, blocks)).bitwiseAND(mask) == mask

    # one row of at most 8 * blocks bytes; the test runs where the rows are read, before anything is exchanged
    return parts.crossJoin(F.broadcast(bloom_filter(entries, blocks))).withColumn("hits", F.filter(candidates, possible)).drop("bloom", "lengths")


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", blocks: int | None = None, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Verdict of each row of `pages`. `listed`: rule_host, rule_path, verdict.

    Two entries with the same host and path: "allow" wins.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    entries = (
        listed.where("rule_host is not null and rule_path is not null")
        .groupBy("rule_host", "rule_path")
        .agg(F.min("verdict").alias("verdict"))
    )
    parts = rows.select("page_id", host.alias("host"), path.alias("path"))
    n, size = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("rule_host") + F.length("rule_path")), F.lit(0))).first()
    # a short list goes to every task, so that an entry that many URLs fit is no hot key; a longer one is hashed
    exact = F.broadcast(entries) if 4 * size + 32 * n <= BROADCAST_BYTES else entries.hint("shuffle_hash")
    tested = possible_hits(parts, entries, blocks or blocks_for(n))
    some = F.size("hits") > 0
    judged = (
        tested.where(some).groupBy("host", "path").agg(F.first("hits").alias("hits"))  # equal URLs have equal hits
        .select("host", "path", F.explode("hits").alias("c"))
        .select("host", "path", "c.*")
        .join(exact, ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))).alias("best"))
        .select(F.col("host").alias("h"), F.col("path").alias("p"), "best.rule", "best.verdict")
    )
    # rows without a possible hit, as all without a host, need no exchange
    with_hits = tested.where(some).join(judged.hint("shuffle_hash"), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
    none = F.lit(None).cast("string")
    return with_hits.union(tested.where(~some).select("page_id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict")))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "rule_host string, rule_path string, verdict string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(r, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest
), rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT host, path, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(verdict, length(h) + length(p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (host, path)
"""
