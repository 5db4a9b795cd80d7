"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 6 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that `column` holds at most `limit` bytes; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def kind(df: DataFrame, name: str) -> str:
    """The type of a column, as a schema names it."""
    return df.schema[name].dataType.simpleString()


def free(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores before it until it is none of `taken` (whatever their case)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = "_" + name
    return name


#: Keys that may be broadcast by `lookup`: at most so many can each hold more than one part in so many of all rows.
MOST_HOT, MANY = 1000, 300


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, ready: bool = False) -> DataFrame:
    """`left` joined with the one row that `right` has for a key, without one task that holds a frequent key.

    `weight` counts the rows that `left` may have for a key. Where one goes beyond `MANY`, keys with more than one in `MOST_HOT`
    of all rows, of which there are fewer than `MOST_HOT` at every size, are broadcast and the others shuffled. `right`
    should have a few narrow columns; it is stored first unless it is `ready`.
    """
    right = right if ready else settled(right)
    total, most = right.agg(F.sum(weight), F.max(weight)).first()
    if (most or 0) <= MANY:
        return left.join(right.hint("merge"), key)
    often = F.col(weight) * MOST_HOT > total
    hot, cold = right.where(often), right.where(~often)
    fast = left.join(F.broadcast(hot), key)
    return fast.unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key))


#: Bits of a `Bloom` filter at most: 16 MB, whatever the number of keys.
MOST_BITS = 1 << 27


class Bloom:
    """A Bloom filter (Bloom 1970) over a column of 64-bit hashes, of a size that is bounded whatever the number of keys.

    It has 16 bits or more a key until `MOST_BITS` is reached; beyond some 20 million keys it lets more and more others
    through, so it may only spare work before an exact join. The driver receives its words, never the keys.
    """

    def __init__(self, keys: DataFrame, column: str):
        bits = 1 << 16
        while bits < min(MOST_BITS, 16 * keys.count()):
            bits *= 2
        spots = F.array(F.col(column).bitwiseAND(bits - 1), F.shiftrightunsigned(column, 32).bitwiseAND(bits - 1))
        at = keys.select(F.explode(spots).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
        self.words, self.mask = np.zeros(bits >> 6, np.uint64), np.uint64(bits - 1)
        self.words[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each of an array of 64-bit hashes may be a key."""
        keys = keys.view(np.uint64)
        out = np.ones(len(keys), bool)
        for at in (keys & self.mask, keys >> np.uint64(32) & self.mask):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(name).to_pylist() for name in names]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, read again.

    Unlike a checkpoint it tells the planner its true size (a checkpoint keeps the estimate of its plan, which loops of joins
    multiply without bound), and small files are read many to a task.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names.

    Where none is set, a folder of our own is taken in local mode, as in tests; on a cluster that is an error, as
    executors would write where nobody reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Memo(dict):
    """A cache filled by `make` and emptied whenever it reaches `most` entries, so its memory is bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
