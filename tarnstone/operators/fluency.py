"""Bigram language models over sentences, and the decisions built on their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text_index import tokens

UNSEEN_PAIR, UNSEEN_WORD, MARGIN = 1e-100, 1.0, 0.1


def padded(text: Column, begin: str = "<s>", end: str = "</s>") -> Column:
    return F.concat(F.array(F.lit(begin)), tokens(text), F.array(F.lit(end)))


def pairs(words: Column) -> Column:
    """Adjacent pairs of an array, as structs a, b."""
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.filter(F.transform(F.arrays_zip(words.alias("a"), rest.alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))), lambda p: p["b"].isNotNull())


def sentence_pairs(rows: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    words = rows.select(key, *keep, padded(F.col(text)).alias("w"))
    return words.select(key, *keep, F.size("w").alias("len"), F.explode(pairs(F.col("w"))).alias("p")).select(key, *keep, "len", "p.a", "p.b")


def bigram_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    words = rows.select(padded(F.col(text)).alias("w"))
    return words.select(F.explode(pairs(F.col("w"))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("c2"))


def word_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.select(F.explode(padded(F.col(text))).alias("a")).groupBy("a").agg(F.count("*").alias("c1"))


def bigram_scores(train: DataFrame, test: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, len, score): mean log probability over the padded length; pairs are combined per sentence before the join."""
    own = sentence_pairs(test, key, text).groupBy(key, "len", "a", "b").agg(F.count("*").alias("n"))
    known = own.join(bigram_counts(train, text), ["a", "b"], "left").join(word_counts(train, text), "a", "left")
    gain = F.col("n") * F.log(F.coalesce(F.col("c2").cast("double"), F.lit(UNSEEN_PAIR)) / F.coalesce(F.col("c1").cast("double"), F.lit(UNSEEN_WORD)))
    return known.groupBy(key, "len").agg(F.round(F.sum(gain) / F.col("len"), 6).alias("score"))


def fluency_labels(scores: DataFrame, reference: DataFrame, margin: float = MARGIN) -> DataFrame:
    """1 where the score reaches the mean score of reference rows of the same length, or else the global mean less `margin`."""
    by_length = reference.groupBy("len").agg(F.avg("score").alias("mean"))
    overall = reference.agg(F.avg("score")).first()[0] or 0.0
    bar = F.coalesce("mean", F.lit(overall - margin))
    return scores.join(by_length, "len", "left").withColumn("fluent", (F.col("score") >= F.round(bar, 6)).cast("int")).drop("mean")


def score_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    return scores.agg(F.min(score).alias("low"), F.max(score).alias("high"), F.round(F.avg(score), 6).alias("mean"))


def frequency_scores(good: Column, rows: DataFrame, key: str = "doc_id", text: str = "text", least: float = 1.0) -> DataFrame:
    """(key, score, label): sum of ln(1 + frequency among good rows) over adjacent pairs; label 1 above `least`.

    `good` is a condition on `rows`. A pair's lines are shuffled once, with what they add to its frequency.
    """
    named = rows.select(key, F.coalesce(good, F.lit(False)).alias("good"), F.explode(F.coalesce(pairs(tokens(F.col(text))), F.array())).alias("p"))
    own = named.groupBy(key, "p.a", "p.b").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("add"))
    gain = own.withColumn("freq", F.sum("add").over(W.partitionBy("a", "b"))).where("freq > 0")
    scored = gain.groupBy(key).agg(F.sum(F.col("n") * F.log1p(F.col("freq").cast("double"))).alias("s"))
    out = rows.select(key).join(scored, key, "left").withColumn("score", F.round(F.coalesce("s", F.lit(0.0)), 6))
    return out.select(key, "score", (F.col("score") > least).cast("int").alias("label"))
