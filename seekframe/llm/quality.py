"""Quality rules: fixed counts, and a hashed n-gram likelihood ratio between trusted and raw text. SQL expressions only.

Words, word pairs, signs and sign pairs are hashed into ``buckets``.  Two multinomials over the buckets are counted: one over
all documents, one over the trusted ones among a bounded sample of labels.  A document's score is the mean over its
n-grams of ``log((t + prior) / (T * r / R + prior))``, with t of T n-grams of the bucket in trusted text and r of R in all; it is
kept if no fixed rule fails and the score is at least ``threshold``.  The ratios are one array of fixed size, read by
every row; no text is shuffled.

Defined results: a null text has no words, and fails for having few; without trusted documents every score is 0; a label
row counts once for each document with its id; repeated rows count and are scored alike; further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import sampled

#: Hash buckets, trusted documents that are read at most, pseudo-counts, and the least score that is kept.
BUCKETS, MOST_TRUSTED, PRIOR, THRESHOLD = 1 << 14, 20_000, 8.0, -0.5
#: Up to so many repeated windows are looked up one by one, more by a sort.
_FEW = 32

_SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def _hashed(rows: DataFrame) -> DataFrame:
    """Adds words, h (their hashes) and s (hashes of the runs of signs)."""
    split = rows.withColumn("words", words("text"))
    signs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\p{L}\\p{N}\\s]+"), F.lit(0))
    return split.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("s", F.transform(signs, lambda w: F.xxhash64(w, F.lit(1))))


def _pairs(name: str, buckets: int) -> Column:
    """Bucket numbers of neighbours in an array of hashes."""
    pair = lambda x, i: F.pmod(F.xxhash64(x, F.get(name, i + 1)), F.lit(buckets)).cast("int")
    return F.slice(F.transform(name, pair), 1, F.greatest(F.size(name) - 1, F.lit(0)))


def _buckets(buckets: int) -> Column:
    """Bucket numbers from 0 of all words, pairs, signs and sign pairs of a row with h and s."""

    def of(name: str) -> Column:
        return F.concat(F.transform(name, lambda x: F.pmod(x, F.lit(buckets)).cast("int")), _pairs(name, buckets))

    return F.concat(of("h"), of("s"))


def counts(documents: DataFrame, labels: DataFrame, trusted: str = "quality = 1", buckets: int = BUCKETS, most: int = MOST_TRUSTED) -> DataFrame:
    """bucket, raw and target: n-grams of all documents, and of the trusted ones among at most ``most`` labels."""
    ids = sampled(labels.where(trusted).where("doc_id is not null").select("doc_id"), "doc_id", most).distinct().withColumn("trusted", F.lit(1))
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(0)).alias("trusted"))
    # the outer form: for the other one Spark infers a filter on the array's size, which hashes every text again
    grams = _hashed(rows).select("trusted", F.explode_outer(_buckets(buckets)).alias("bucket")).where("bucket is not null")
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").cast("long").alias("target"))


def ratios(counted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """The log ratio of each bucket (0 where nothing was counted)."""
    rows = counted.collect()  # one row a bucket
    raw, target = max(1, sum(r["raw"] for r in rows)), sum(r["target"] for r in rows)
    out = [0.0] * buckets
    for r in rows:
        out[r["bucket"]] = math.log((r["target"] + prior) / (target * r["raw"] / raw + prior))
    return out


def rules(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with text, words and h."""
    text = F.coalesce("text", F.lit(""))
    some = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    n = F.size("words").cast("long")
    out = rows.withColumn("windows", F.slice(F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2))), 1, F.greatest(F.size("h") - 2, F.lit(0))))
    # only texts with a repeated window are sorted
    out = out.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array("windows")).otherwise(F.array().cast("array<bigint>"))).withColumn("lines", some)
    out = out.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, i: x == F.get("sorted", i - 1))))
    # where each repeated window starts: looked up, or from pairs (window, place) next to an equal one
    pairs = F.when(F.size("twice") > _FEW, F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    out = out.withColumn("pairs", pairs)
    beside = F.filter("pairs", lambda p, i: (p["x"] == F.get("pairs", i - 1)["x"]) | (p["x"] == F.get("pairs", i + 1)["x"]))
    looked = F.filter(F.transform("windows", lambda x, i: F.when(F.array_contains("twice", x), i)), lambda x: x.isNotNull())
    starts = F.when(F.size("twice") == 0, F.array().cast("array<int>")).when(F.size("twice") <= _FEW, looked).otherwise(F.sort_array(F.transform(beside, lambda p: p["i"])))
    out = out.withColumn("starts", starts)
    covered = F.aggregate(F.transform("starts", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    out = out.withColumns({
        "n_words": n,
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    })
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("windows", "sorted", "twice", "pairs", "starts", "lines")


def assess(documents: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept of every document."""
    rows = rules(_hashed(documents.select("doc_id", "text")))
    # one folded literal: a list would be an expression for each bucket
    shared = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")
    n = len(ratio)

    def total(name: str) -> Column:
        single = F.aggregate(name, F.lit(0.0), lambda a, x: a + F.get(shared, F.pmod(x, F.lit(n)).cast("int")))
        return single + F.aggregate(_pairs(name, n), F.lit(0.0), lambda a, g: a + F.get(shared, g))

    size = lambda name: F.size(name) + F.greatest(F.size(name) - 1, F.lit(0))
    grams = size("h") + size("s")
    score = F.when(grams > 0, (total("h") + total("s")) / grams).otherwise(0.0)
    rows = rows.withColumn("score", score)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select(*names, (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), F.round("score", 4).alias("score"))
