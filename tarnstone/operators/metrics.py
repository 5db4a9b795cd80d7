"""Confusion matrices, precision / recall / F, AUC, votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def safe(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return rows.groupBy(truth, pred).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame, truth: str = "truth", pred: str = "pred", beta: float = 1.0) -> DataFrame:
    """(label, gold, predicted, hits, precision, recall, f) of every label on either side."""
    ends = matrix.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.col("n").alias("gold"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("gold"), F.col("n").alias("predicted")))).alias("e"), F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("hit"))
    sums = ends.groupBy("e.label").agg(F.sum("e.gold").alias("gold"), F.sum("e.predicted").alias("predicted"), (F.sum("hit") / 2).cast("long").alias("hits"))
    p, r, b = safe(F.col("hits"), F.col("predicted")), safe(F.col("hits"), F.col("gold")), beta * beta
    return sums.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f": F.round(safe((1 + b) * p * r, b * p + r), 6)})


def averaged(matrix: DataFrame, truth: str = "truth", pred: str = "pred", beta: float = 1.0, labels: list | None = None) -> DataFrame:
    """(average, precision, recall, f) for micro, macro and weighted averages, over `labels` only if given."""
    rows = per_class(matrix, truth, pred, beta)
    if labels is not None:
        rows = rows.where(F.col("label").isin(labels))
    b = beta * beta
    p, r = safe(F.sum("hits"), F.sum("predicted")), safe(F.sum("hits"), F.sum("gold"))
    fb = lambda p, r: safe((1 + b) * p * r, b * p + r)
    own_p, own_r = safe(F.col("hits"), F.col("predicted")), safe(F.col("hits"), F.col("gold"))
    rows = rows.withColumns({"p": own_p, "r": own_r, "f0": fb(own_p, own_r)})
    mean = lambda c: F.avg(c)
    heavy = lambda c: safe(F.sum(F.col(c) * F.col("gold")), F.sum("gold"))
    out = [
        rows.agg(p.alias("precision"), r.alias("recall"), fb(p, r).alias("f")).withColumn("average", F.lit("micro")),
        rows.agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f0").alias("f")).withColumn("average", F.lit("macro")),
        rows.agg(heavy("p").alias("precision"), heavy("r").alias("recall"), heavy("f0").alias("f")).withColumn("average", F.lit("weighted")),
    ]
    return reduce(DataFrame.unionByName, out).select("average", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


def accuracy(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return rows.agg(F.round(F.avg((F.col(truth) == F.col(pred)).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


def auc(rows: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """Rank-sum AUC with ties at half. Scores are counted first; ranks come from counts by distinct score."""
    counts = rows.groupBy(score).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(W.orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = counts.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
    return wins.agg(F.round(F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def one_vs_rest(scores: DataFrame, key: str, label: str = "label", kind: str = "kind", score: str = "score") -> DataFrame:
    """(key, kind, truth, score) for every row and class, from the scores of some classes; a class without one has 0.

    `auc` over it is the micro average. `scores` has at least one line a row; the classes are all labels and kinds there.
    """
    rows = scores.select(key, label).distinct()
    kinds = F.array_distinct(F.concat(F.collect_set(label), F.collect_set(kind))).alias("kinds")
    known = scores.agg(kinds).first()["kinds"]
    every = rows.select(key, label, F.explode(F.array(*map(F.lit, sorted(known)))).alias("kind"))
    given = scores.select(key, F.col(kind).alias("kind"), F.col(score).cast("double").alias("score"))
    return every.join(given, [key, "kind"], "left").select(key, "kind", (F.col(label) == F.col("kind")).cast("int").alias("truth"), F.coalesce("score", F.lit(0.0)).alias("score"))


def or_vote(frames: list[DataFrame], key: str, label: str) -> DataFrame:
    """1 if any prediction is: the highest label by key."""
    return reduce(DataFrame.unionByName, [f.select(key, label) for f in frames]).groupBy(key).agg(F.max(label).alias(label))


def joined_predictions(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(key, in_gold, in_pred) of the keys that only one side has: empty if the key sets are equal."""
    g, p = gold.select(key).distinct().withColumn("in_gold", F.lit(True)), predicted.select(key).distinct().withColumn("in_pred", F.lit(True))
    both = g.join(p, key, "full_outer")
    return both.where(F.col("in_gold").isNull() | F.col("in_pred").isNull()).select(key, F.coalesce("in_gold", F.lit(False)).alias("in_gold"), F.coalesce("in_pred", F.lit(False)).alias("in_pred"))


def span_scores(gold: DataFrame, predicted: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """Micro precision, recall, F1 of spans: predicted rows that gold has too are hits; by category if `by` names it."""
    marked = predicted.join(gold.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    group = [by] if by else []
    a = marked.groupBy(*group).agg(F.count("*").alias("predicted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    b = gold.groupBy(*group).agg(F.count("*").alias("gold"))
    both = a.join(b, by, "full_outer") if by else a.crossJoin(b)  # one row each without a category
    both = both.na.fill(0)
    p, r = safe(F.col("hits"), F.col("predicted")), safe(F.col("hits"), F.col("gold"))
    return both.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(safe(2 * p * r, p + r), 6)})
