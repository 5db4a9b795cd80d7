"""Sessions, imputation, class weights, sampling and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessions(rows: DataFrame, partition: str, order: list[str], starts) -> DataFrame:
    """Number the sessions of each partition: a running count of rows where `starts` holds; rows before the first are session 0."""
    w = W.partitionBy(partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("session", F.sum(starts.cast("long")).over(w))


def delimited(rows: DataFrame, partition: str, order: str, token: str, begin: str, end: str) -> DataFrame:
    """Transactions (partition, session, items) between a begin and an end token; an unterminated session counts, an empty one has no items."""
    numbered = sessions(rows, partition, [order], F.col(token) == begin).where("session > 0")
    items = F.array_sort(F.collect_set(F.when(~F.col(token).isin(begin, end), F.col(token))))
    return numbered.groupBy(partition, "session").agg(items.alias("items"))


def class_modes(rows: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, column, value): the most frequent value of each column in each class; equal counts go to the least value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = rows.select(label, pairs.alias("p")).select(label, "p.*").where("value is not null").groupBy(label, "column", "value").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy(label, "column").orderBy(F.desc("n"), "value")))
    return ranked.where("rank = 1").select(label, "column", "value")


def impute_modes(rows: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Fill nulls by the mode of the row's class; a column without a value in the class stays null."""
    modes = class_modes(rows, label, columns).groupBy(label).pivot("column", columns).agg(F.first("value"))
    modes = modes.select(F.col(label).alias("_label"), *[F.col(c).alias(f"_mode_{c}") for c in columns])
    joined = rows.join(modes, rows[label].eqNullSafe(modes["_label"]), "left")
    kinds = dict(rows.dtypes)
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_mode_{c}").cast(kinds[c])).alias(c) if c in columns else F.col(c) for c in rows.columns])


def label_shares(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, share), share to four places."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = rows.count()
    return counts.withColumn("share", F.round(F.col("n") / F.lit(total), 4))


def power_weights(rows: DataFrame, label: str, power: float = -0.05) -> DataFrame:
    return rows.groupBy(label).agg(F.round(F.pow(F.count("*").cast("double") + 1, F.lit(power)), 6).alias("weight"))


def reversed_weights(rows: DataFrame, label: str) -> DataFrame:
    """The i-th smallest class weighs what the i-th largest one has as share."""
    shares = label_shares(rows, label)
    up = shares.withColumn("i", F.row_number().over(W.orderBy("share", label)))
    down = shares.select(F.col("share").alias("weight"), F.row_number().over(W.orderBy(F.desc("share"), F.desc(label))).alias("i"))
    return up.join(down, "i").select(label, "n", "share", "weight")


def by_hash(key: str, salt: str = ""):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(salt)))


def stratified(rows: DataFrame, label: str, key: str, each: int) -> DataFrame:
    """The `each` rows of lowest key hash of every class."""
    w = W.partitionBy(label).orderBy(by_hash(key), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each).drop("_r")


def hash_place(rows: DataFrame, label: str, key: str, name: str) -> DataFrame:
    """Number the rows of each class from 1 by key hash (ties by key), in the column `name`.

    A class is split in 256 ranges of the hash, numbered apart and shifted by the counts of those before, so that a class
    that holds most rows is not one task.
    """
    ranged = rows.withColumn("_range", F.coalesce(F.substring(by_hash(key), 1, 2), F.lit("")))
    counts = ranged.groupBy(F.col(label).alias("_label"), F.col("_range").alias("_at")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_label").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    shifts = counts.select("_label", "_at", F.coalesce(before, F.lit(0)).alias("_shift"))
    placed = ranged.withColumn(name, F.row_number().over(W.partitionBy(label, "_range").orderBy(by_hash(key), key)))
    joined = placed.join(shifts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn(name, F.col(name) + F.col("_shift")).select(*rows.columns, name)


def downsample(rows: DataFrame, label: str, key: str, ratio: float = 0.5) -> DataFrame:
    """Keep of every class but the smallest at most floor(ratio * smallest) rows, by key hash."""
    smallest = rows.groupBy(label).count().orderBy("count", label).first()
    if smallest is None:
        return rows
    most = int(ratio * smallest["count"])
    return hash_place(rows, label, key, "_r").where((F.col(label) == F.lit(smallest[label])) | (F.col("_r") <= most)).drop("_r")


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = 10) -> DataFrame:
    return hash_place(rows, label, key, "_r").withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(folds)).cast("int")).drop("_r")


def hash_bucket(key: str, buckets: int, salt: str = ""):
    """A bucket from the first 28 bits of an MD5, which other engines can compute too."""
    return F.pmod(F.conv(F.substring(by_hash(key, salt), 1, 7), 16, 10).cast("long"), F.lit(buckets))


def folds(rows: DataFrame, key: str, count: int = 10) -> DataFrame:
    return rows.withColumn("fold", hash_bucket(key, count))


def hash_split(rows: DataFrame, key: str, percent: int = 80) -> DataFrame:
    return rows.withColumn("part", F.when(hash_bucket(key, 100, "split") < percent, "train").otherwise("test"))


def fixed_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    return rows.orderBy(by_hash(key), key).limit(size)


def latest(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Bounded retention: the last `size` rows."""
    return rows.orderBy(F.desc(order)).limit(size)


def shuffled(rows: DataFrame, seed: int = 7) -> DataFrame:
    return rows.orderBy(F.rand(seed))


def batches(rows: DataFrame, key: str, size: int, group: str | None = None) -> DataFrame:
    """Number rows in batches of `size` in shuffled (hash) order, within each group if one is given."""
    w = W.partitionBy(*([group] if group else [])).orderBy(by_hash(key, "batch"), key)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


#: Ranges that `dense` numbers apart, and sampled keys for each: the bounds on what reaches the driver.
RANGES, SAMPLED = 128, 32


def dense(rows: DataFrame, key: str, *then: str, name: str = "id") -> DataFrame:
    """Number rows from 0 without gaps by `key`, then the columns `then` (nulls first): long ids in the column `name`.

    Ranges of `key` between sampled bounds are numbered apart and shifted by the counts of those before; the bounds decide
    only how the work is dealt. Rows of one key are numbered in one task.
    """
    sample = rows.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(RANGES * SAMPLED).collect()
    kind = rows.schema[key].dataType
    bounds = sorted({r[0] for r in sample})[SAMPLED - 1 :: SAMPLED]
    at = F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    ranged = rows.withColumn("_range", F.greatest(at, F.lit(0)))
    counts, shifts, before = dict(ranged.groupBy("_range").agg(F.count("*")).collect()), [], 0
    for r in sorted(counts):
        shifts.append((r, before))
        before += counts[r]
    shift = rows.sparkSession.createDataFrame(shifts, "_range int, _shift bigint")
    place = F.row_number().over(W.partitionBy("_range").orderBy(key, *then))
    numbered = ranged.withColumn(name, place).join(F.broadcast(shift), "_range")
    return numbered.withColumn(name, F.col(name) + F.col("_shift") - 1).drop("_range", "_shift")


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """All rows once for each `epoch` from 0."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def padded_batches(rows: DataFrame, key: str, ids: str, size: int, group: str, pad: int = 0) -> DataFrame:
    """`batches` whose arrays `ids` are padded to the longest of their batch."""
    numbered = batches(rows, key, size, group)
    most = F.max(F.size(ids)).over(W.partitionBy(group, "batch"))
    return numbered.withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), (most - F.size(ids)).cast("int"))))


def best_k(rows: DataFrame, group: str, metric: str, tie: str, k: int) -> DataFrame:
    """The `k` rows of highest metric in each group (ties by the column `tie`), with their place from 1.

    The bound on the place lets each task cut its groups to `k` rows before the shuffle.
    """
    order = W.partitionBy(group).orderBy(F.desc(metric), tie)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def secondary_sort(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """Rows of a key in one partition, in order of `by` there: grouping by key, sorting by value, without a list a key."""
    return rows.repartition(key).sortWithinPartitions(key, *by)


def length_order(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows by length of the text, then by the text itself."""
    return rows.withColumn("length", F.length(text)).orderBy("length", text)
