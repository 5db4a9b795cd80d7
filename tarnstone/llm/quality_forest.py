"""Quality rules: hard rules on word statistics, then an isolation forest over the same statistics.

The forest (Liu, Ting and Zhou 2008) is grown from every row that passes the hard rules, its threshold from every labelled one:
the best cut among those that reject no more than `MAX_CLEAN_LOSS` of the rows labelled good. Rows of equal features are one
row of a table with their numbers, so the passes that grow the trees, one a level, read far less than the corpus. At any size the
driver receives at most `TREES * TREE_ROWS / 2` nodes a pass by the 353 values that features can have, and the labels counted by
score, of which there are at most 1,000,001.
All statistics and all scores cover every row and every whole text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mix, settled, slices

#: Trees; rows by whose number a tree counts its depths (a share of all rows is that share of these); share of good rows that may go.
TREES, TREE_ROWS, MAX_CLEAN_LOSS = 100, 256, 0.01
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")
FEATURES = tuple(f"f{k}" for k in range(7))
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"!?;:=_~^@+\\/{}[]()\"'"


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Per text, the words lying in a window of eight words that the text holds twice or more."""
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    if not len(sizes) or sizes.max() <= WINDOW:
        return out
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(words)), sizes)
    h, odd, step = mix(flat + np.uint64(1)), 0x9E3779B97F4A7C15, 1
    while step < WINDOW:
        h = h[:-step] * np.uint64(odd) + h[step:]
        odd, step = odd * odd % (1 << 64), step * 2
    inside = np.flatnonzero(owner[: len(h)] == owner[WINDOW - 1 :])
    key = h[inside] ^ mix(owner[inside].astype(np.uint64) + np.uint64(77))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(words)).astype(np.int64)


def text_counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    words = [b.split() for b in raw]  # bytes.split() cuts at 0x20 and 0x09 to 0x0D, and nowhere else
    lines = [[x for x in b.split(b"\n") if x.strip()] for b in raw]
    rows = (
        (
            len(w),
            len(t or "") - (len(b) - sum(map(len, w))),
            len(b) - len(b.translate(None, SYMBOLS)),
            len(x) - len(set(x)),
            len(x),
            len(b) - len(b.translate(None, _UPPER)),
            len(b) - len(b.translate(None, _MARKS)),
            len(set(w)),
        )
        for t, b, w, x in zip(texts, raw, words, lines, strict=True)
    )
    table = np.array(list(rows), np.int64).reshape(len(texts), 8)
    names = [c for c in COUNTS if c != "n_repeat_words"]
    return dict(zip(names, table.T, strict=True)) | {"n_repeat_words": repeated_words(words)}


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of `docs`: the columns `keep` and the counts of its whole text (a null text counts as empty)."""

    def count(batches):
        for batch in slices(batches, text):
            got = text_counts(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(got[c], pa.int64()) for c in COUNTS], names=[*keep, *COUNTS])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{c} bigint" for c in COUNTS])
    return docs.select(*keep, text).mapInArrow(count, schema)


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios that short texts cannot swing and that a repeated header line does not move.

    50 words (250 characters) of plain prose are added to every text, so that one mark in a short one is no anomaly.
    Ratios are rounded to the steps in which rules of this kind are stated (half a letter, one symbol, repeated word or line in a
    hundred, a tenth of capitals or distinct words): splits inside a step would isolate rows by noise. Mean word length is
    clipped to 3 to 12, the range of plain text is well inside; two repeated lines and 0.15 repeated words are a header's share.
    """
    words, chars = c["n_words"] + 50.0, c["word_chars"] + 250.0
    return np.stack(
        [
            np.round(np.clip((c["word_chars"] + 250) / words, 3, 12) * 2),
            np.round(c["n_symbols"] / chars, 2),
            np.round(np.maximum(0, c["n_dup_lines"] - 2) / (c["n_lines"] + 4.0), 2),
            np.maximum(0, np.round(c["n_repeat_words"] / words - 0.15, 2)),
            np.round(c["n_upper"] / chars, 1),
            np.round(c["n_marks"] / chars, 2),
            np.minimum(0.3, np.round(c["n_distinct"] / words, 1)),
        ],
        axis=1,
    ).astype(float)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of a row in a random tree over `n` rows, 2 H(n - 1) - 2 (n - 1) / n; H, by its series, is defined for parts of a row too."""
    x = np.maximum(n, 1.0) - 1
    harmonic = np.log(x + 3.5) + 0.5772156649 + 1 / (24 * (x + 3.5) ** 2) - 1 / (x + 1) - 1 / (x + 2) - 1 / (x + 3)
    return np.where(x > 0, np.maximum(0, 2 * harmonic - 2 * x / (x + 1)), 0.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(f).to_numpy() for f in FEATURES], axis=1)


def _values(data: np.ndarray | DataFrame) -> list[np.ndarray]:
    """The values that each feature has anywhere, in order."""
    if isinstance(data, np.ndarray):
        return [np.unique(column) for column in data.T]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f).alias("v")) for k, f in enumerate(FEATURES)))).alias("x")
    got = data.select(each).select("x.f", "x.v").distinct().toPandas()
    return [np.sort(got["v"].to_numpy(float)[got["f"].to_numpy() == k]) for k in range(len(FEATURES))]


class IsolationForest:
    """Random axis-parallel splits; a row that few splits isolate scores near 1.

    `data` is an array of rows or a table of distinct ones (`FEATURES` and their number `n`). All trees are grown over all rows,
    a level at a time, from the number of rows that a node has of each value. The first authors' trees are grown from
    subsamples, as those over many rows are deep and cut between values that hardly a row has. Here a node's share of all rows
    counts as that share of `rows`, and the ends between which it is cut are drawn as the least and the greatest value of so
    many of its rows: each tree is as over a subsample of `rows`, by the distribution of all. One row or less is isolated.
    """

    def __init__(self, data: np.ndarray | DataFrame, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.grid = _values(data)
        ends = np.cumsum([0, *map(len, self.grid)])
        self.roots = self.left = self.right = np.arange(trees if ends[-1] else 0)
        self.feature, self.cut, self.depth = np.zeros(len(self.roots), np.int64), np.zeros(len(self.roots)), 0
        first, held = 0, self._held(data, 0)
        total = held[0, : ends[1]].sum() if len(held) else 0
        taken = min(rows, total)
        share, most = taken / max(1, total), max(1, math.ceil(math.log2(max(2, taken))))
        self.unit = float(_mean_path(taken)) or 1.0
        self.length = np.full(len(held), _mean_path(taken))
        while True:
            n = held[:, : ends[1]].sum(1) if len(held) else np.zeros(0, np.int64)
            m = np.maximum(n * share, 1 + 1e-9)[:, None]
            lowest = 1 - (1 - rng.random((len(n), len(self.grid)))) ** (1 / m)
            highest = lowest + (1 - lowest) * rng.random(lowest.shape) ** (1 / (m - 1))
            low, high = np.zeros(lowest.shape), np.zeros(lowest.shape)
            for f, values in enumerate(self.grid):
                upto = np.cumsum(held[:, ends[f] : ends[f + 1]], axis=1)
                for out, q in ((low, lowest), (high, highest)):
                    at = (upto <= np.minimum(q[:, f] * n, n - 0.5)[:, None]).sum(1)
                    out[:, f] = values[np.minimum(at, len(values) - 1)]
            varied = high > low
            split = np.flatnonzero((n * share > 1) & varied.any(1))
            if not len(split):
                return
            by = np.where(varied[split], rng.random((len(split), len(self.grid))), -1).argmax(1)
            least, greatest = low[split, by], high[split, by]
            cut = np.minimum(least + rng.random(len(split)) * (greatest - least), np.nextafter(greatest, least))
            left = np.array([held[k, ends[f] : ends[f] + np.searchsorted(self.grid[f], c, "right")].sum() for k, f, c in zip(split, by, cut)])
            at, first = first + split, len(self.left)
            more = first + np.arange(2 * len(split))
            self.feature[at], self.cut[at] = by, cut
            self.left, self.right = np.append(self.left, more), np.append(self.right, more)
            self.left[at], self.right[at] = more[::2], more[1::2]
            self.feature, self.cut = np.append(self.feature, 0 * more), np.append(self.cut, 0.0 * more)
            self.depth += 1
            self.length = np.append(self.length, self.depth + _mean_path(np.stack([left, n[split] - left], axis=1).ravel() * share))
            if self.depth == most:
                return
            held = self._held(data, first)

    def _leaf(self, x: np.ndarray, root: int) -> np.ndarray:
        row, at = np.arange(len(x)), np.full(len(x), root)
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return at

    def _held(self, data: np.ndarray | DataFrame, first: int) -> np.ndarray:
        """How many rows each node from `first` on (those of the last level) has of each value of each feature."""
        size = len(self.left) - first
        if isinstance(data, np.ndarray):
            return self._count([(data, np.ones(len(data), np.int64))], first, size)
        if not size:
            return self._count([], first, size)

        def count(batches):
            held = self._count(((_matrix(b), b.column("n").to_numpy()) for b in batches), first, size).ravel()
            met = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(held[met])], names=["at", "n"])

        got = data.select(*FEATURES, "n").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        held = self._count([], first, size)
        held.reshape(-1)[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
        return held

    def _count(self, parts, first: int, size: int) -> np.ndarray:
        ends = np.cumsum([0, *map(len, self.grid)])
        held = np.zeros((size, ends[-1]), np.int64)
        for x, times in parts:
            places = np.stack([e + np.searchsorted(values, x[:, f]) for f, (e, values) in enumerate(zip(ends, self.grid))], axis=1)
            for root in self.roots:
                node = self._leaf(x, root) - first
                here = node >= 0  # the others are in leaves of earlier levels
                np.add.at(held.reshape(-1), (node[here, None] * ends[-1] + places[here]).ravel(), np.repeat(times[here], len(self.grid)))
        return held

    def score(self, x: np.ndarray) -> np.ndarray:
        """The score of each row, to six digits: equal rows have equal scores wherever they are computed."""
        total = np.zeros(len(x))
        for root in self.roots:
            total += self.length[self._leaf(x, root)]
        return np.round(np.exp2(-total / max(1, len(self.roots)) / self.unit), 6)


def calibrate(scores: np.ndarray, good: np.ndarray, max_clean_loss: float, times: np.ndarray | None = None) -> float:
    """The score above which rows go: the best cut (share of bad rows caught less share of good rows lost) of those that lose
    at most `max_clean_loss` of the good rows; without good rows nothing goes. An entry stands for `times` rows (one, if null)."""
    cuts, at = np.unique(scores, return_inverse=True)
    times = np.ones(len(scores)) if times is None else times
    clean, bad = np.bincount(at, times * good, len(cuts)), np.bincount(at, times * ~good, len(cuts))
    if not clean.sum():
        return 1.0
    lost = 1 - np.cumsum(clean) / clean.sum()
    caught = 1 - np.cumsum(bad) / max(1, bad.sum())
    cuts, gain = cuts[lost <= max_clean_loss], (caught - lost)[lost <= max_clean_loss]
    return float(cuts[len(gain) - 1 - int(np.argmax(gain[::-1]))])


def base_failures(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def _lowest(rows: DataFrame, by_hash: list, most: int) -> DataFrame:
    """The rows of lowest hash; a first cut at a bound below which about twice as many lie keeps each task's share small.

    A plain sample; forest and threshold use none.
    """
    total, tail = rows.count(), 2 * most
    while tail < total:
        bound = -(1 << 63) + (tail << 64) // total
        few = rows.where(by_hash[0] < F.lit(bound))
        if few.count() >= most:
            rows = few
            break
        tail *= 2
    return rows.orderBy(*by_hash).limit(most)


def kinds(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """The distinct features of the rows that pass the base rules, how many rows have them (`n`), and how many of those are
    labelled good (`clean`) and bad (`bad`)."""
    fails = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    passed = stats.where(~fails)
    good = labels.groupBy(F.col(doc_id).alias("_id")).agg(F.min(quality).alias("_good"))
    told = passed.join(good, F.col(doc_id) == F.col("_id")).where("_good is not null")
    # every row comes without a label, labelled ones once more with it: an outer join would bring all null ids to one task
    rows = passed.select(F.lit(None).cast("double").alias("_good"), *COUNTS).unionByName(told.select(F.col("_good").cast("double"), *COUNTS))

    def look(batches):
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in COUNTS})
            yield pa.RecordBatch.from_arrays([batch.column("_good"), *(pa.array(c) for c in x.T)], names=["_good", *FEATURES])

    each = rows.mapInArrow(look, "_good double, " + ", ".join(f"{f} double" for f in FEATURES))
    label = F.col("_good")
    return each.groupBy(*FEATURES).agg(F.count_if(label.isNull()).alias("n"), F.count_if(label > 0).alias("clean"), F.count_if(label <= 0).alias("bad"))


def fit(stats: DataFrame, labels: DataFrame, doc_id="doc_id", quality="quality", trees=TREES, tree_rows=TREE_ROWS, max_clean_loss=MAX_CLEAN_LOSS) -> tuple[IsolationForest, float]:
    """The forest, from all rows of checkpointed statistics, and its threshold, from all labelled ones."""
    known = settled(kinds(stats, labels, doc_id, quality))
    forest = IsolationForest(known, trees, tree_rows)

    def score(batches):
        for batch in batches:
            got = forest.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays([pa.array(got), batch.column("clean"), batch.column("bad")], names=["score", "clean", "bad"])

    scored = known.where("clean + bad > 0").mapInArrow(score, "score double, clean bigint, bad bigint")
    marked = scored.groupBy("score").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).toPandas()
    scores, times = np.tile(marked["score"].to_numpy(float), 2), np.append(marked["clean"].to_numpy(float), marked["bad"].to_numpy(float))
    return forest, calibrate(scores, np.arange(len(scores)) < len(marked), max_clean_loss, times)


def quality_filter(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """The rows of `docs` that `quality_rules` keeps, with all their columns, whatever their names; texts are read twice and
    never shuffled. Null and empty texts go (they fail the base rules), repeated rows fare alike, an empty table stays empty.
    """
    forest, threshold = fit(checkpointed(statistics(docs, text, (doc_id,))), labels, doc_id, quality)

    def keep(batches):
        for batch in slices(batches, text):
            c = text_counts(batch.column(text).to_pylist())
            yield batch.filter(pa.array(~base_failures(c) & (forest.score(features(c)) <= threshold)))

    return docs.mapInArrow(keep, docs.schema)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    quality: str = "quality",
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    max_clean_loss: float = MAX_CLEAN_LOSS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Judge every row: base rules first, then the forest's score against the calibrated threshold.

    Returns doc_id, the counts, `base_failed`, `score`, `threshold` and `kept`, with the columns `keep` besides.
    Null texts count as empty and fail the base rules; a null doc_id is judged but never labelled. Repeated doc_ids are
    judged one by one; a doc_id labelled twice counts by its lowest label. Without labelled good rows nothing but the
    base rules rejects. An empty table gives an empty result. Other columns of `docs` are not read.
    """
    keep = tuple(dict.fromkeys((doc_id, *keep)))
    stats = checkpointed(statistics(docs, text, keep))
    forest, threshold = fit(stats, labels, doc_id, quality, trees, tree_rows, max_clean_loss)

    def judge(batches):
        for batch in batches:
            c = {n: batch.column(n).to_numpy() for n in COUNTS}
            failed, score = base_failures(c), forest.score(features(c))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(failed), pa.array(score), pa.array(np.full(len(score), threshold)), pa.array(~failed & (score <= threshold))],
                names=[*batch.schema.names, "base_failed", "score", "threshold", "kept"],
            )

    schema = ", ".join(f"`{n}` {k}" for n, k in stats.dtypes) + ", base_failed boolean, score double, threshold double, kept boolean"
    return stats.mapInArrow(judge, schema)
