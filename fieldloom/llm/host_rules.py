"""Host-level quality rules, with DataFrame functions only.

Every document gets base figures and a base verdict. Base failures are counted by host; a host's rate
is shrunk towards the rate of all hosts by a beta prior that is fitted to the hosts' rates by
moments. A host whose shrunk rate exceeds `most_failures` loses all its documents; otherwise a
document keeps its own verdict.

The figures need no shuffle; hosts are counted by partial aggregation, and a host that has a third of
all documents is one row of the host table. Figures are checkpointed (a few numbers per document)
because both the count and the join read them. Verdicts of hosts with more than a 1024th of the documents are broadcast
(fewer than 1024 rows); the others are joined by host.

Cases: null, empty and blank texts have no words and fail; a null host is no host: its documents keep
their own verdict and count in no rate; without hosts there is no prior; a rate of exactly `most_failures` is no
rejection; doc_id is returned as it is, host is compared as it is, whatever their types; repeated rows stay; texts
are read whole; extra columns, those named like a figure included, are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
MOST_FAILURES = 0.8
#: Fixed: the white space of `[^\x20\x09-\x0D]+`, and the symbols.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


# The arrays below are columns of selects of their own: a lambda that mentions a whole array's expression
# would compute it anew for each element.


def _windows(w: Column) -> Column:
    """A hash of every three words in a row."""
    n = F.size(w) - 2
    of_three = F.transform(F.arrays_zip(F.slice(w, 1, n).alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    return F.when(n > 0, of_three).otherwise(F.array().cast("array<bigint>"))


def _sorted_windows(h: Column) -> Column:
    """(hash, place) in order, so that equal windows are neighbours; empty if no two are equal."""
    none = F.size(F.array_distinct(h)) == F.size(h)
    return F.when(none, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))


def _repeated_places(by: Column) -> Column:
    n = F.size(by) - 1
    pairs = F.arrays_zip(F.slice(by, 1, n).alias("a"), F.slice(by, 2, n).alias("b"))
    again = F.filter(pairs, lambda x: x["a"]["h"] == x["b"]["h"])
    places = F.sort_array(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["a"]["i"], x["b"]["i"])))))
    return F.when(n > 0, places).otherwise(F.array().cast("array<int>"))


def _words_covered(places: Column) -> Column:
    """How many words the three-word windows at these ascending places have together."""
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda acc: acc["n"])


def base_figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the base figures of every document."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", F.col(host).alias("host"), text.alias("text"))
    df = df.select("doc_id", "host", "text", _words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"))
    df = df.select("*", _windows(F.col("w")).alias("h"))
    df = df.select("*", _sorted_windows(F.col("h")).alias("by"))
    df = df.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _words_covered(_repeated_places(F.col("by"))).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_rates(figures: DataFrame) -> DataFrame:
    """host, n, failed, alpha, beta, rate: the shrunk failure rate of each host.

    With m and v the mean and variance of the hosts' rates, alpha + beta is m * (1 - m) / v - 1, kept
    within [1, 1e6] (v of 0 gives the most shrinkage).
    """
    hosts = figures.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    raw = F.col("failed") / F.col("n")
    m, v = F.col("m"), F.col("v")
    strength = F.when(v > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), m * (1 - m) / v - 1))).otherwise(1e6)
    prior = hosts.agg(F.avg(raw).alias("m"), F.coalesce(F.var_pop(raw), F.lit(0.0)).alias("v")).select((m * strength).alias("alpha"), ((1 - m) * strength).alias("beta"))
    # One row: the proven bound of what is broadcast here.
    both = hosts.join(F.broadcast(prior))
    return both.withColumn("rate", (F.col("failed") + F.col("alpha")) / (F.col("n") + F.col("alpha") + F.col("beta")))


def verdicts(docs: DataFrame, host: str = "source", most_failures: float = MOST_FAILURES) -> DataFrame:
    """The base figures with kept: not base_failed, and the host (if any) not rejected."""
    figures = common.checkpoint(base_figures(docs, host))
    hosts = common.checkpoint(host_rates(figures).select("host", "n", (F.col("rate") > most_failures).alias("bad")))
    kept = ~F.col("base_failed") & ~F.coalesce("bad", F.lit(False))
    return common.split_join(figures, hosts, ["host"], "left").select(*figures.columns, kept.alias("kept"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(common.table(spark, sf_dir, "documents")).drop("host")


QUERIES = {"op9_host_rules": op9_host_rules}
ORACLE_SQL = {
    "op9_host_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS failed FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(failed / n) AS m, coalesce(var_pop(failed / n), 0) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(1e6, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM m),
bad AS (SELECT source FROM h, s WHERE (failed + m * s) / (n + s) > 0.8)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM b
"""
}
