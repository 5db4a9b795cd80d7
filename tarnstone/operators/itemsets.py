"""Frequent itemsets and association rules over (transaction, item) rows.

Levels grow by the prefix join; candidates with an infrequent subset are dropped before anything is counted. Support is
counted by extending each transaction's own frequent (k-1)-sets, so no candidate is ever tested against every transaction;
transactions of equal items are counted as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold(transactions: int, support: float, floor: bool = False) -> float:
    """The least count: n * support as a real number, or its floor."""
    return int(transactions * support) if floor else transactions * support


def _subsets_frequent(candidates: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Keep the candidates all of whose (k-1)-subsets are frequent; dropping either of the last two items gives a parent."""
    for i in range(k - 2):
        sub = F.expr(f"filter(items, (x, j) -> j <> {i})")
        candidates = candidates.join(known.select(F.col("items").alias("sub")), sub == F.col("sub"), "left_semi")
    return candidates


def counted_transactions(baskets: DataFrame, tx: str = "tx", item: str = "item") -> DataFrame:
    """(items, blank, loose, n): how many transactions have the same items, sorted; whether they have a missing item too, or
    are rows without a transaction. One shuffle of the rows, one of the transactions; held by the executors."""
    items = F.array_sort(F.collect_set("item")).alias("items")
    rows = baskets.select(F.col(tx).alias("tx"), F.col(item).cast("string").alias("item"))
    own = rows.groupBy("tx").agg(items, F.max(F.col("item").isNull()).alias("blank"))
    return own.groupBy("items", "blank", F.col("tx").isNull().alias("loose")).agg(F.count("*").alias("n")).persist()


def _held(df: DataFrame) -> DataFrame:
    """Found now and held, so that its size is known to the joins with it and nothing is found twice."""
    df = df.persist()
    df.count()
    return df


def frequent_itemsets(baskets: DataFrame, transactions: int, support: float, most: int = 3, tx: str = "tx", item: str = "item", floor: bool = False) -> DataFrame:
    """(items, freq) of all sizes up to `most`. Transactions without items count in the number of transactions."""
    return frequent_in(counted_transactions(baskets, tx, item), transactions, support, most, floor)


def frequent_in(counted: DataFrame, transactions: int, support: float, most: int = 3, floor: bool = False) -> DataFrame:
    """`frequent_itemsets` from what `counted_transactions` gives; sets are grown beside their transaction's items, without a join."""
    least = threshold(transactions, support, floor)
    single = counted.select(F.explode("items").alias("item"), "n").unionByName(counted.where("blank").select(F.lit(None).cast("string").alias("item"), "n"))
    level = _held(single.groupBy("item").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least).select(F.array("item").alias("items"), "freq"))
    prefix, last = (lambda c, k: F.slice(c, 1, k - 2)), (lambda c: F.element_at(c, -1))
    begin = counted.where("not loose").select(F.col("items").alias("of"), "n", F.explode("items").alias("item")).withColumn("items", F.array("item"))
    found = [level]
    for k in range(2, most + 1):
        if k > 2:
            a, b = level.select(F.col("items").alias("x")), level.select(F.col("items").alias("y"))
            on = (prefix(F.col("x"), k) == prefix(F.col("y"), k)) & (last(F.col("x")) < last(F.col("y")))
            candidates = _held(_subsets_frequent(a.join(b, on).select(F.concat("x", F.array(last(F.col("y")))).alias("items")), level.select("items"), k))
        held = begin.select("of", "n", "items")
        for size in range(1, k):
            held = held.join(found[size - 1].select("items"), "items", "left_semi")
            more = F.explode(F.filter("of", lambda x: x > last(F.col("items")))).alias("item")
            held = held.select("of", "n", "items", more).select("of", "n", F.concat("items", F.array("item")).alias("items"))
        if k > 2:
            held = held.join(candidates, "items", "left_semi")
        else:  # any two frequent items are a candidate
            held = held.withColumn("new", F.slice("items", 2, 1)).join(level.select(F.col("items").alias("new")), "new", "left_semi")
        level = _held(held.groupBy("items").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least))
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def _proper_subsets(items: str, half: bool):
    """Bit masks of the non-empty proper subsets; half of them (each pair of complements once) if asked."""
    top = F.expr(f"shiftleft(1, size({items}){' - 1' if half else ''})")
    return F.sequence(F.lit(1), F.greatest(F.lit(1), top - 1))


def association_rules(sets: DataFrame, transactions: int, size: int | None = None, confidence: float = 0.5, lift: float | None = None, half: bool = False) -> DataFrame:
    """(antecedent, consequent, freq, confidence, lift) from frequent sets and their counts.

    Every non-empty proper subset is an antecedent. With `half`, of each pair of complements the reverse direction is
    tried only if the forward one fails.
    """
    wide = sets.where(F.size("items") > 1 if size is None else F.size("items") == size)
    wide = wide.withColumn("mask", F.explode(_proper_subsets("items", half)))
    pick = lambda bit: F.expr(f"filter(items, (x, i) -> (shiftright(mask, i) & 1) = {bit})")
    split = wide.select("freq", pick(1).alias("antecedent"), pick(0).alias("consequent")).where((F.size("antecedent") > 0) & (F.size("consequent") > 0))
    one = lambda name: sets.select(F.col("items").alias(name), F.col("freq").alias(f"{name}_freq"))
    rules = split.join(one("antecedent"), "antecedent").join(one("consequent"), "consequent")
    forward = rules.withColumn("confidence", F.col("freq") / F.col("antecedent_freq"))
    if half:
        back = rules.select("freq", F.col("consequent").alias("antecedent"), F.col("antecedent").alias("consequent"), F.col("consequent_freq").alias("antecedent_freq"), F.col("antecedent_freq").alias("consequent_freq"))
        back = back.withColumn("confidence", F.col("freq") / F.col("antecedent_freq"))
        failed = forward.where(F.col("confidence") < confidence).select(F.col("antecedent").alias("c"), F.col("consequent").alias("a"))
        back = back.join(failed, (F.col("antecedent") == F.col("a")) & (F.col("consequent") == F.col("c")), "left_semi")
        forward = forward.unionByName(back)
    out = forward.where(F.col("confidence") >= confidence).withColumn("lift", F.col("freq") * F.lit(float(transactions)) / (F.col("antecedent_freq") * F.col("consequent_freq")))
    if lift is not None:
        out = out.where(F.col("lift") >= lift)
    return out.select("antecedent", "consequent", "freq", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


def fp_growth(baskets: DataFrame, support: float, confidence: float = 0.5, tx: str = "tx", item: str = "item"):
    """The fitted FP-growth model over the same rows; its rules have one item as consequent."""
    from pyspark.ml.fpm import FPGrowth

    lists = baskets.groupBy(tx).agg(F.collect_set(F.col(item).cast("string")).alias("items"))
    return FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(lists)


def prune_transactions(baskets: DataFrame, sets: DataFrame, tx: str = "tx", item: str = "item") -> DataFrame:
    """Lossless pruning: items in no frequent set go, and so do transactions left without two items."""
    live = sets.select(F.explode("items").alias(item)).distinct()
    kept = baskets.join(live, item, "left_semi")
    return kept.join(kept.groupBy(tx).agg(F.count("*").alias("n")).where("n > 1").select(tx), tx, "left_semi")


def matched(baskets: DataFrame, sets: DataFrame, size: int, tx: str = "tx", item: str = "item") -> DataFrame:
    """(tx, items): the sets of one size, sorted, that each transaction holds. Each step keeps what is the beginning of a set."""
    rows = baskets.select(F.col(tx).alias("tx"), F.col(item).cast("string").alias("item")).distinct()
    wanted = sets.where(F.size("items") == size).select("items")
    begins = lambda k: wanted.select(F.slice("items", 1, k).alias("items")).distinct()
    held = rows.select("tx", F.array("item").alias("items")).join(begins(1), "items", "left_semi")
    for k in range(2, size + 1):
        held = held.join(rows, "tx").where(F.col("item") > F.element_at("items", -1)).select("tx", F.concat("items", F.array("item")).alias("items"))
        held = held.join(begins(k), "items", "left_semi")
    return held.select("tx", "items")


def prune_matched(held: DataFrame, size: int) -> DataFrame:
    """(tx, item) that sets of one more item can still use, from the sets of `size` items that each transaction holds.

    A set of size + 1 has size + 1 subsets of `size` items, and each of its items is in `size` of them: transactions with
    fewer sets go, then items in fewer of them.
    """
    rich = held.groupBy("tx").agg(F.count("*").alias("n")).where(F.col("n") > size).select("tx")
    uses = held.join(rich, "tx", "left_semi").select("tx", F.explode("items").alias("item")).groupBy("tx", "item").agg(F.count("*").alias("n"))
    return uses.where(F.col("n") >= size).select("tx", "item")


def item_union(sets: DataFrame) -> DataFrame:
    return sets.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
