"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash. It starts with one bucket; only a bucket whose bytes exceed
the limit splits on one more bit, until every shard fits. Bytes are first summed by hash prefix; the directory grows from
these sums, so no row moves before its shard is known. Rows that no bit parts (copies of one row) fill numbered overflow
shards, as overflow pages do. A row longer than the limit stands in a shard of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

BITS = 60
LIMIT = 128 << 20
SLACK_BITS = 6  # prefixes are summed at so many bits more than equal shards would need


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an MD5 of id and text; equal only for equal rows, up to chance."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, BITS - bits)


def _nodes(sums: DataFrame, low: int, high: int) -> DataFrame:
    """Bytes and rows of every directory node from `low` to `high` bits, from sums at `high` bits."""
    levels = sums.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "prefix", "bytes", "rows", "lo", "hi")
    parent = F.expr(f"shiftright(prefix, {high} - depth)")
    return levels.groupBy("depth", parent.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def directory(hashed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Leaves (depth, prefix, bytes, rows, lo, hi) of the directory over rows with columns h and bytes."""
    total = hashed.agg(F.sum("bytes")).first()[0] or 0
    low, leaves, rest = 0, None, hashed
    while True:
        need = max(0, math.ceil(math.log2(max(1, total / limit)))) if low == 0 else 0
        high = min(BITS, max(low, need) + SLACK_BITS)
        sums = rest.groupBy(_prefix(F.col("h"), high).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        nodes = checkpointed(_nodes(sums, low, high))
        above = nodes.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        open_ = nodes.where(F.col("depth") > low).withColumn("up", F.shiftright("prefix", 1)).join(above, ["depth", "up"], "left_semi").drop("up")
        if low == 0:
            open_ = open_.unionByName(nodes.where(F.col("depth") == 0))
        # a node whose rows all have one hash cannot be parted by further bits
        done = open_.where((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")))
        # of nested nodes with one hash, the uppermost counts
        done = done.withColumn("first", F.row_number().over(W.partitionBy("lo", "hi").orderBy("depth"))).where((F.col("bytes") <= limit) | (F.col("first") == 1)).drop("first")
        leaves = done if leaves is None else leaves.unionByName(done)
        deep = open_.where((F.col("bytes") > limit) & (F.col("depth") == high) & (F.col("lo") < F.col("hi")))
        if high == BITS or deep.isEmpty():
            return leaves.where("rows > 0")
        rest = rest.join(deep.select("prefix"), _prefix(F.col("h"), high) == F.col("prefix"), "left_semi")
        low = high


def shard(docs: DataFrame, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Give every row its shard: doc_id, the columns `keep`, bytes, depth, prefix, overflow.

    Bytes are those of the text in UTF-8; a null text has none. (depth, prefix, overflow) names the shard; overflow is 0
    but for copies of one row that together exceed the limit. Null ids hash as an empty id. An empty table gives an empty
    result. Only the named columns are read.
    """
    rows = docs.select(
        doc_id, *keep, row_hash(F.col(doc_id), F.col(text)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")
    )
    light = checkpointed(rows.select(doc_id, "h", "bytes")) if not keep else rows
    if not keep:
        rows = light
    leaves = checkpointed(directory(light.select("h", "bytes"), limit))
    # the directory: as many slots as a power of two at least the number of leaves; a shallow leaf fills several slots,
    # deep leaves share one (splits below a slot halve its rows, and copies of one row end a chain)
    bits = max(0, math.ceil(math.log2(max(1, leaves.count()))))
    slots = leaves.withColumn("slot", F.expr(f"explode(if(depth >= {bits}, array(shiftright(prefix, depth - {bits})), sequence(shiftleft(prefix, {bits} - depth), shiftleft(prefix + 1, {bits} - depth) - 1)))"))
    entries = slots.groupBy("slot").agg(F.collect_list(F.struct("depth", "prefix", "rows", F.col("bytes").alias("leaf_bytes"))).alias("entries"))
    found = rows.join(entries, _prefix(F.col("h"), bits) == F.col("slot"), "left").withColumn(
        "leaf", F.expr(f"filter(entries, e -> shiftright(h, {BITS} - e.depth) = e.prefix)[0]")
    )
    flat = found.select(doc_id, *keep, "h", "bytes", F.col("leaf.depth").cast("long").alias("depth"), "leaf.prefix", "leaf.leaf_bytes", "leaf.rows")
    over = leaves.where((F.col("bytes") > limit) & (F.col("rows") > 1))
    if over.isEmpty():
        return flat.select(doc_id, *keep, "bytes", "depth", "prefix", F.lit(0).cast("long").alias("overflow"))
    # copies of one row: numbered by task and place, in two steps, so no group meets in one task
    apart = F.col("leaf_bytes") > limit
    numbered = checkpointed(flat.where(apart).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    sizes = numbered.groupBy("depth", "prefix", "part").agg(F.count("*").alias("here"), F.min("place").alias("base"))
    before = sizes.withColumn("before", F.sum("here").over(W.partitionBy("depth", "prefix").orderBy("part")) - F.col("here")).drop("here")
    inside = numbered.join(before, ["depth", "prefix", "part"])
    # places of a task run on over its other groups too, so the numbers are spaced by rank
    rank = F.row_number().over(W.partitionBy("depth", "prefix", "part").orderBy("place")) - 1 + F.col("before")
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("bytes"))))
    spilled = inside.withColumn("overflow", F.floor(rank / per).cast("long"))
    cols = [doc_id, *keep, "bytes", "depth", "prefix", "overflow"]
    return flat.where(~apart).withColumn("overflow", F.lit(0).cast("long")).select(*cols).unionByName(spilled.select(*cols))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write shards as Parquet folders, one for each shard; `sharded` carries the texts in `keep`."""
    sharded.repartition("depth", "prefix", "overflow").write.mode("overwrite").partitionBy("depth", "prefix", "overflow").parquet(path)
