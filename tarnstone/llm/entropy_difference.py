"""LM scoring by cross-entropy difference (Moore and Lewis 2010).

Two trigram models over characters, one of a target (rows labelled good) and one of the background (all rows), share one
vocabulary, order and smoothing. A document's score is the mean over its characters of target loss less background
loss: the lower, the more it is like the target. Counts cover every row and whole texts. The model is a table; the
`HEAD` most frequent trigrams, a fixed number, are broadcast, and the rest is joined, so nothing that grows with
the corpus reaches the driver or every executor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, checkpointed, kind, partitions, slices

HEAD, MU, _BITS = 1 << 17, 20.0, 21
_DENSE = 1 << 22
_MASK = (1 << _BITS) - 1


class Coded:
    """Trigrams of a list of texts, each after two boundary symbols: an index into distinct ones, and their packed names."""

    def __init__(self, texts: list[str]):
        flat = np.frombuffer("".join(f"\0\0{t.lower()}" for t in texts).encode("utf-32-le", "replace"), "<u4")
        lengths = np.array([len(t.lower()) for t in texts], np.int64)
        symbols = np.flatnonzero(np.bincount(flat)) if len(flat) else np.zeros(1, np.int64)
        table = np.zeros(int(symbols[-1]) + 1, np.int64)
        table[symbols] = np.arange(len(symbols))
        c, k = table[flat], len(symbols)
        key = (c[:-2] * k + c[1:-1]) * k + c[2:] if len(c) > 2 else np.zeros(0, np.int64)
        ends = np.cumsum(lengths + 2)
        inside = np.ones(max(0, len(c) - 2), bool)
        for shift in (2, 1):  # windows that end on a boundary symbol of the next text
            at = ends[:-1] - shift
            inside[at[(at >= 0) & (at < len(inside))]] = False
        self.key, self.owner = key[inside], np.repeat(np.arange(len(texts)), lengths)
        self.lengths = lengths
        if k**3 <= _DENSE:
            seen = np.bincount(self.key, minlength=k**3)
            distinct = np.flatnonzero(seen)
            place = np.zeros(k**3, np.int64)
            place[distinct] = np.arange(len(distinct))
            self.index = place[self.key]
        else:
            distinct, self.index = np.unique(self.key, return_inverse=True)
        self.packed = (symbols[distinct // (k * k)] << _BITS | symbols[distinct // k % k]) << _BITS | symbols[distinct % k]


def occurrences(docs: DataFrame, text: str) -> DataFrame:
    """(gram, n): occurrences by task; the same trigram may come several times."""

    def run(batches):
        held: list[tuple] = []

        def merged():
            grams, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([h[1] for h in held])).astype(np.int64)

        for batch in slices(batches, "text"):
            coded = Coded([t or "" for t in batch.column("text").to_pylist()])
            if len(coded.packed):
                held.append((coded.packed, np.bincount(coded.index, minlength=len(coded.packed))))
            if len(held) > 15:
                held = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["gram", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["gram", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "gram bigint, n bigint")


def counts(docs: DataFrame, good: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(gram, background, target): occurrences over all rows and over those whose id is in `good` (a column of ids named _id).

    The background needs no join. For the target, a Bloom filter leaves out most rows without a good label before the rest
    is joined with the ids, so few texts are shuffled; past its bound more are, to the same result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Bloom(good.select(F.xxhash64("_id").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(sent.value.has(h.to_numpy()))

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    # labels grow with the corpus, so this is a sort-merge join at every size
    told = rows.where(F.col("_id").isNotNull() & may(F.xxhash64("_id"))).join(good.hint("merge"), "_id", "left_semi")
    # the target is the smaller part: fewer tasks, so that each sums up more before its counts are shuffled
    told = told.coalesce(max(1, partitions(docs.sparkSession) // 4))
    zero = F.lit(0).cast("long")
    both = occurrences(rows, "text").select("gram", F.col("n").alias("background"), zero.alias("target"))
    both = both.unionByName(occurrences(told, "text").select("gram", zero.alias("background"), F.col("n").alias("target")))
    return both.groupBy("gram").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def model(grams: DataFrame, mu: float = MU) -> DataFrame:
    """(gram, background, gap): gap is the target loss less the background loss of the trigram's last character."""
    grams = grams.withColumns({"context": F.shiftright("gram", _BITS), "symbol": F.col("gram").bitwiseAND(_MASK)})
    contexts = grams.groupBy("context").agg(F.sum("background").alias("cb"), F.sum("target").alias("ct"))
    singles = grams.groupBy("symbol").agg(F.sum("background").alias("sb"), F.sum("target").alias("st"))
    total = singles.agg(F.sum("sb").alias("b"), F.sum("st").alias("t"), F.count("*").alias("v")).first()
    v = total["v"] or 1
    pb = (F.col("sb") + 1) / F.lit(float((total["b"] or 0) + v))
    pt = (F.col("st") + 1) / F.lit(float((total["t"] or 0) + v))
    losses = F.log((F.col("background") + mu * pb) / (F.col("cb") + mu)) - F.log((F.col("target") + mu * pt) / (F.col("ct") + mu))
    return grams.join(contexts, "context").join(singles, "symbol").select("gram", "background", losses.alias("gap"))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", good: str = "quality", head: int = HEAD, mu: float = MU) -> DataFrame:
    """One row per row: doc_id, n_tokens, ce_diff (target cross-entropy less background cross-entropy, in nats a token).

    Target rows are those whose lowest label `good` is above 0. Null and empty texts have no tokens and a null score. Repeated
    rows and null ids are scored one by one, and count in the background one by one. Without target rows
    the target model is uniform. An empty table gives an empty result. Only the named columns are read.
    """
    good_ids = checkpointed(labels.groupBy(F.col(doc_id).alias("_id")).agg((F.min(good) > 0).alias("target")).where("target and _id is not null").select("_id"))
    table = checkpointed(model(checkpointed(counts(docs, good_ids, text, doc_id)), mu))
    rows = table.count()
    # a first cut by count, so that each task offers only its share of the head
    least = table.approxQuantile("background", [1 - 2 * head / rows], 0.1 * head / rows)[0] if rows > 4 * head else 0
    top = table.where(F.col("background") >= least).orderBy(F.desc("background"), "gram").limit(head).select("gram", "gap").toPandas().sort_values("gram")
    sent = docs.sparkSession.sparkContext.broadcast((top["gram"].to_numpy(np.int64), top["gap"].to_numpy(float)))

    def run(batches):
        known, gaps = sent.value
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded = Coded(texts)
            at = np.minimum(np.searchsorted(known, coded.packed), max(0, len(known) - 1))
            hit = known[at] == coded.packed if len(known) else np.zeros(len(coded.packed), bool)
            gap = np.where(hit, gaps[at] if len(known) else 0.0, 0.0)
            sums = np.bincount(coded.owner, gap[coded.index], len(texts)).astype(float)
            rest: list[list] = [[] for _ in texts]
            miss = np.flatnonzero(~hit[coded.index])
            if len(miss):
                pairs, times = np.unique(np.stack([coded.owner[miss], coded.index[miss]]), axis=1, return_counts=True)
                for d, g, n in zip(pairs[0].tolist(), coded.packed[pairs[1]].tolist(), times.tolist(), strict=True):
                    rest[d].append({"gram": g, "n": n})
            kind = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(coded.lengths), pa.array(sums), pa.array(rest, kind)], names=["doc_id", "row", "n_tokens", "near", "rest"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("row"))
    first = checkpointed(rows.mapInArrow(run, f"doc_id {kind(docs, doc_id)}, row bigint, n_tokens bigint, near double, rest array<struct<gram:bigint,n:bigint>>"))
    others = first.where(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).select("row", "r.gram", "r.n").groupBy("row", "gram").agg(F.max("n").alias("n"))
    far = others.join(table, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("gap")).alias("far"))
    total = F.col("near") + F.coalesce("far", F.lit(0.0))
    return first.drop("rest").join(far, "row", "left").select("doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, F.round(total / F.col("n_tokens"), 9)).alias("ce_diff"))
