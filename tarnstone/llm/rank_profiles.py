"""Language ID by rank-order profiles (Cavnar and Trenkle 1994).

A profile lists the most frequent character n-grams (one to three characters, words padded by a blank on either side).
A document goes to the language whose profile its own is nearest to by the out-of-place distance. Profiles count every
training row; what reaches the driver is `PROFILE` n-grams for each language.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, slices

PROFILE = 300
_BITS = 21  # bits of a code point; three of them fit a signed 64-bit key
_DENSE = 1 << 22


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """The n-grams of a text as small integers: symbols are numbered in code-point order, so keys sort as their n-grams do.

    All that is no letter counts as one blank, which also stands before and after the text.
    """

    def __init__(self, text: str):
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
        points = np.where(_letters()[points], points, 32)
        self.symbols = np.flatnonzero(np.bincount(points))
        table = np.zeros(int(self.symbols[-1]) + 1, np.int64)
        table[self.symbols] = np.arange(len(self.symbols))
        c, k = table[points], len(self.symbols)
        self.blank = int(table[32])
        ink = c != self.blank
        self.any = bool(ink.any())
        two = c[:-1] * k + c[1:]
        keys = np.concatenate([c[ink], k + two[ink[:-1] | ink[1:]], k + k * k + (two[:-1] * k + c[2:])[ink[1:-1]]])
        if k + k * k + k**3 <= min(_DENSE, 16 * len(keys)):
            counts = np.bincount(keys)
            self.keys = np.flatnonzero(counts)
            self.counts = counts[self.keys]
        else:
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.counts = keys[first], np.diff(np.append(first, len(keys)))

    def packed(self, keys: np.ndarray) -> np.ndarray:
        """The code points of the n-grams in one 64-bit integer each."""
        k, s = len(self.symbols), self.symbols
        out = np.zeros(len(keys), np.int64)
        one, three = keys < k, keys >= k + k * k
        out[one] = s[keys[one]]
        two = ~one & ~three
        x = keys[two] - k
        out[two] = s[x // k] << _BITS | s[x % k]
        x = keys[three] - k - k * k
        out[three] = (s[x // (k * k)] << _BITS | s[x // k % k]) << _BITS | s[x % k]
        return out

    def top(self, size: int) -> np.ndarray:
        """The most frequent n-grams, packed, most frequent first; equal counts go by n-gram."""
        keys, counts = self.keys, self.counts
        if len(keys) > 2 * size:
            least = np.partition(counts, len(counts) - size)[len(counts) - size]
            keys, counts = keys[counts >= least], counts[counts >= least]
        return self.packed(keys[np.argsort(-counts, kind="stable")][:size])


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of the languages in `rows`; rows without text or language teach nothing."""

    def count(batches):
        found: dict[str, list] = defaultdict(list)

        def merged(parts):
            keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, counts).astype(np.int64)

        def flush():
            for name, parts in found.items():
                keys, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])
            found.clear()

        for batch in slices(batches, text):
            texts: dict[str, list] = defaultdict(list)
            for t, name in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist(), strict=True):
                texts[name].append(t)
            for name, own in texts.items():
                g = Grams(" ".join(own))
                found[name].append((g.packed(g.keys), g.counts))
                if len(found[name]) > 20:
                    found[name] = [merged(found[name])]
            if sum(len(k) for parts in found.values() for k, _ in parts) > 4_000_000:
                yield from flush()
        yield from flush()

    taught = rows.select(text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = checkpointed(taught.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # a window with a bound on the rank is cut to that many rows a language in each task before the shuffle
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    tops = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", "rank").toPandas()
    return {name: own.sort_values("rank")["gram"].to_numpy(np.int64) for name, own in tops.groupby("lang")}


class Matcher:
    """Finds the nearest profile of a text."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.rank = np.full((len(self.known) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.rank[np.searchsorted(self.known, profiles[name]), j] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = Grams(text or "")
        if not grams.any or not self.names:
            return "und", 0.0
        top = grams.top(self.size)
        at = np.searchsorted(self.known, top)
        at[self.known[np.minimum(at, len(self.known) - 1)] != top] = len(self.known)
        ranks = self.rank[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.size * len(top)))


def held_out(doc_id):
    """Whether the row is kept from training: the CRC-32 of the id as text leaves 2 modulo 4 (a null id never does)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = PROFILE) -> DataFrame:
    """The columns `keep` of every row, `lang_pred` and `score` (0 to 1; one less the mean share of misplacement).

    `und` with score 0 stands for a null text, one without a letter, or no profiles. Ties go to the first language by
    name. Repeated rows are judged one by one; an empty table gives an empty result.
    """

    def predict(batches):
        matcher = Matcher(profiles, size)
        for batch in slices(batches, text):
            got = [matcher.predict(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["lang_pred string", "score double"])
    return docs.select(*dict.fromkeys((*keep, text))).mapInArrow(predict, schema)


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
