"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing (Cole and Vishkin 1986) reduces the names of a sequence's symbols to a small alphabet by looking
at a bounded neighbourhood only; local minima of the reduced names then end phrases. Each phrase gets a name, a hash
of the names of its parts, and the names are parsed again at the next level. Where a phrase ends depends on a few symbols
around it, so equal substrings share their interior phrases wherever they stand. The fingerprint is a bottom-k style sketch
(one minimum for each of `SLOTS` slots) of the phrase names of the levels `LEVELS`, in hexadecimal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, partitions, slices

SLOTS, LEVELS, ROUNDS = 64, (2, 3, 4), 3
_EMPTY = np.uint32(0xFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _starts(names: np.ndarray) -> np.ndarray:
    """Where phrases begin in a sequence of names; runs of one name have been merged before, so neighbours differ."""
    label = names
    for _ in range(ROUNDS):
        differ = label[1:] ^ label[:-1]
        low = differ & (~differ + np.uint64(1))
        # the index of the lowest differing bit and that bit: neighbours still differ
        index = np.zeros(len(differ), np.uint64)
        nonzero = low > 0
        index[nonzero] = np.log2(low[nonzero].astype(np.float64)).astype(np.uint64)
        bit = (label[1:] >> index) & np.uint64(1)
        label = np.concatenate([[np.uint64(0)], index * np.uint64(2) + bit])
    inner = label[1:-1]
    minimum = (inner < label[:-2]) & (inner <= label[2:])
    return np.flatnonzero(minimum) + 1


def _merge_runs(names: np.ndarray) -> np.ndarray:
    """One name for each maximal run: repeats are named with their length."""
    if len(names) < 2:
        return names
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    if len(first) == len(names):
        return names
    sizes = np.diff(np.append(first, len(names)))
    out = names[first]
    many = sizes > 1
    out[many] = mix(out[many] * _ODD + sizes[many].astype(np.uint64))
    return out


def _level(names: np.ndarray) -> np.ndarray:
    """Names of the phrases of a sequence, one level up."""
    names = _merge_runs(names)
    if len(names) < 4:
        return names
    begin = np.concatenate([[0], _starts(names)])
    begin = begin[np.concatenate([[True], begin[1:] > begin[:-1]])]
    place = np.arange(len(names)) - np.repeat(begin, np.diff(np.append(begin, len(names))))
    terms = mix(names + (place.astype(np.uint64) + np.uint64(1)) * _ODD)
    return mix(np.add.reduceat(terms, begin))


def phrases(text: str) -> np.ndarray:
    """The distinct phrase names of the levels `LEVELS` (of the highest level there is, for a shorter text)."""
    names = mix(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1))
    found, last = [], names
    for level in range(1, max(LEVELS) + 1):
        last = _level(last)
        if level in LEVELS:
            found.append(mix(last ^ np.uint64(level)))
    return np.concatenate(found)


def sketch(text: str) -> np.ndarray:
    """The least 32-bit value in each slot; slots without a phrase borrow from the next one on (densification)."""
    out = np.full(SLOTS, _EMPTY, np.uint32)
    if not text:
        return out
    names = phrases(text)
    slot = (names >> np.uint64(58)).astype(np.int64)
    np.minimum.at(out, slot, np.minimum(names & np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFE)).astype(np.uint32))
    empty = np.flatnonzero(out == _EMPTY)
    if len(empty):
        full = np.flatnonzero(out != _EMPTY)
        ahead = full[np.searchsorted(full, empty) % len(full)]
        distance = (ahead - empty) % SLOTS
        out[empty] = mix(out[ahead].astype(np.uint64) * _ODD + distance.astype(np.uint64)).astype(np.uint32) & np.uint32(0xFFFFFFFE)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal slots: an estimate of the Jaccard index of the two phrase sets."""
    return float(np.mean(a == b))


def spelled(value: np.ndarray) -> str:
    return value.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint of every row. A null text counts as empty; all empty texts share one fingerprint."""

    def run(batches):
        for batch in slices(batches, text):
            got = [spelled(sketch(t or "")) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(got, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(doc_id, text).mapInArrow(run, "doc_id bigint, fingerprint string")


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows dealt to ranges of descending doc_id, sorted there, each range closed by a copy of the next one's first row.

    The bounds of the ranges are quantiles of the ids; what the driver sees is a few numbers a range. Columns: _range,
    doc_id, text, _tie, ghost (true for the copy).
    """
    spark = docs.sparkSession
    many = 2 * partitions(spark)
    ids = docs.where(F.col(doc_id).isNotNull())
    marks = ids.approxQuantile(doc_id, [i / many for i in range(1, many)], 0.5 / many) if many > 1 else []
    bounds = sorted({int(m) for m in marks})
    # descending ids: range 0 holds the largest; null ids come last
    where = _by_bisection(F.col(doc_id), bounds, len(bounds))
    where = F.when(F.col(doc_id).isNull(), F.lit(len(bounds) + 1)).otherwise(where)
    placed = docs.select(where.cast("int").alias("_range"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_tie"))
    order = F.struct(F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("a"), F.col("_tie").alias("b"))
    heads = {r["_range"]: tuple(r["head"]) for r in placed.groupBy("_range").agg(F.min(order).alias("head")).collect()}
    present = sorted(heads)
    if not present:
        return placed.withColumn("ghost", F.lit(False))
    before = {r: present[i - 1] for i, r in enumerate(present)}  # the first range closes the last one: a ring
    targets = F.create_map(*[F.lit(x) for r in present for x in (r, before[r])])
    first = F.create_map(*[F.lit(x) for r in present for x in (r, heads[r][0])])
    tie = F.create_map(*[F.lit(x) for r in present for x in (r, heads[r][1])])
    is_head = (order["a"] == first[F.col("_range")]) & (order["b"] == tie[F.col("_range")])
    ghosts = placed.where(is_head).withColumns({"_range": targets[F.col("_range")], "ghost": F.lit(True)})
    return placed.withColumn("ghost", F.lit(False)).unionByName(ghosts)


def _by_bisection(value, bounds: list[int], top: int):
    """top - (number of bounds below value), as nested comparisons of logarithmic depth."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(top - lo)
        mid = (lo + hi) // 2
        return F.when(value > bounds[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def compare_edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    In descending order of doc_id (null ids last, equal ids by a hash of the text), the edited text of a row is its own
    less its last half, followed by as many characters of the next row's text; the last row is followed by the first. A
    row that stands alone is followed by itself. A null text counts as empty. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Only the two named columns are read.
    """
    rows = with_next(docs, doc_id, text)
    parts = partitions(docs.sparkSession)
    dealt = rows.repartitionById(parts, F.pmod("_range", F.lit(parts))).sortWithinPartitions("_range", "ghost", F.desc_nulls_last("doc_id"), "_tie")

    def run(batches):
        held, out = None, []

        def emit():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in slices(batches, "text"):
            for part, key, value, ghost in zip(*(batch.column(c).to_pylist() for c in ("_range", "doc_id", "text", "ghost")), strict=True):
                value = value or ""
                own = sketch(value)
                if held is not None and held[0] == part and not held[4]:
                    _, last_key, last, last_own, _ = held
                    half = len(last) // 2
                    edited = last[: len(last) - half] + value[:half]
                    changed = sketch(edited)
                    out.append((last_key, len(last), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), spelled(last_own), spelled(changed), likeness(last_own, changed), likeness(last_own, own)))
                held = (part, key, value, own, ghost)
            if len(out) >= 500:
                yield emit()
                out = []
        if out:
            yield emit()

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("_range", "doc_id", "text", "ghost").mapInArrow(run, schema)
