"""Matrices as rows of (id, vector array, label): moments, scaling, neighbours, projections."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import gauss

#: At least so many blocks; about so many rows in one; so many entries of a block of distances at a time.
BLOCKS, BLOCK_ROWS, PIECE = 4, 8192, 1 << 19
#: So many blocks that a task of `nearest` goes over at most; so many tasks at least, while there are pairs.
STRIPE, TASKS = 8, 24
#: Bytes of all paths that are held, not found again; rows of a matrix that is decomposed as a whole; entries of a space of vectors.
HELD, WHOLE, SPACE = 2 << 30, 2048, 24 << 20


def entries(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(key, *keep, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def moments(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(dim, mean, deviation): population deviation by column."""
    return entries(rows, key, vector).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))


def _sums(rows: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sum and sum of outer products, added up per task in one pass; only matrices of the dimension's size travel."""

    def run(batches):
        n, s, p = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(float)
                n, s, p = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if p is None else p + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "p": [p.ravel().tolist()]})

    parts = rows.select(vector).where(F.col(vector).isNotNull()).mapInPandas(run, "n bigint, s array<double>, p array<double>")
    flat = parts.select("n", F.posexplode(F.concat("s", "p")).alias("at", "v")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("at").collect()
    v = np.array([r["v"] for r in flat])
    d = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
    return flat[0]["n"], v[:d], v[d:].reshape(d, d)


def covariance(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int | None = None) -> DataFrame:
    """(i, j, cov): sample covariance of columns, i <= j, from one pass of sums."""
    n, s, p = _sums(rows.select(F.slice(vector, 1, dims).alias(vector)) if dims else rows, vector)
    c = (p - np.outer(s, s) / n) / (n - 1)
    return rows.sparkSession.createDataFrame([(i, j, round(float(c[i, j]), 6)) for i in range(len(c)) for j in range(i, len(c))], "i int, j int, cov double")


def standardise(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", fit_on: DataFrame | None = None) -> DataFrame:
    """(key, dim, z) with population deviations of `fit_on`; a constant column becomes 0."""
    m = moments(fit_on if fit_on is not None else rows, key, vector)
    return entries(rows, key, vector).join(F.broadcast(m), "dim").select(key, "dim", F.coalesce(F.try_divide(F.col("x") - F.col("mean"), F.col("deviation")), F.lit(0.0)).alias("z"))


def min_max(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    e = entries(rows, key, vector)
    m = e.groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return e.join(F.broadcast(m), "dim").select(key, "dim", F.coalesce(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)).alias("z"))


def gaussian_nb(train: DataFrame, test: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", smoothing: float = 1e-9) -> DataFrame:
    """(key, pred): Gaussian naive Bayes from class means and variances; the model has one row a class and column."""
    e = entries(train, key, vector, (label,))
    spread = e.groupBy("dim").agg(F.var_pop("x").alias("v")).agg(F.max("v")).first()[0] or 1.0
    model = e.groupBy(label, "dim").agg(F.avg("x").alias("m"), (F.var_pop("x") + smoothing * spread).alias("v"))
    n = train.count()
    prior = train.groupBy(label).agg(F.log(F.count("*") / F.lit(float(n))).alias("prior"))
    like = -0.5 * F.log(2 * np.pi * F.col("v")) - (F.col("x") - F.col("m")) * (F.col("x") - F.col("m")) / (2 * F.col("v"))
    scored = entries(test, key, vector).join(model, "dim").groupBy(key, label).agg(F.sum(like).alias("s")).join(prior, label)
    best = F.max_by(label, F.struct(F.round(F.col("s") + F.col("prior"), 6), -F.col(label)))
    return scored.groupBy(key).agg(best.alias("pred"))


@dataclass
class Block:
    """Some rows of a matrix, by id: ids, vectors, and further columns by name."""

    at: int
    id: np.ndarray
    v: np.ndarray
    of: dict[str, np.ndarray]


def _blocks(rows: DataFrame, key: str, vector: str, keep: tuple[str, ...] = (), n: int | None = None) -> DataFrame:
    """Rows dealt into `n` blocks (of about `BLOCK_ROWS`) by their keys' hash, a block being one row of bytes and one partition.

    Rows without a key or vector are left out; columns of `keep` are numbers.
    """
    whole = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    n = n or max(BLOCKS, -(-whole.count() // BLOCK_ROWS))
    at = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def pack(batches):
        parts = [pdf for pdf in batches if len(pdf)]
        if parts:
            pdf = pd.concat(parts, ignore_index=True).sort_values("id", kind="stable")
            v = np.stack(pdf["v"].to_numpy()).astype(float)
            yield pd.DataFrame({"at": [int(pdf["at"].iloc[0])], "id": [pdf["id"].to_numpy(dtype="int64").tobytes()], "v": [v.tobytes()]} | {c: [pdf[c].to_numpy(dtype=float).tobytes()] for c in keep})

    dealt = whole.select(at.alias("at"), F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), *keep).repartitionById(n, F.col("at"))
    return dealt.mapInPandas(pack, "at int, id binary, v binary" + "".join(f", {c} binary" for c in keep)).persist()


def _block(row: dict, side: str) -> Block:
    got = {k[2:]: v for k, v in row.items() if k.startswith(side)}
    ids = np.frombuffer(got.pop("id"), "int64")
    return Block(got.pop("at"), ids, np.frombuffer(got.pop("v")).reshape(len(ids), -1), {k: np.frombuffer(v) for k, v in got.items()})


def _paired(left: DataFrame, right: DataFrame, work, schema: str, half: bool = False) -> DataFrame:
    """`work` over each pair of blocks, a task each; it yields dictionaries of arrays in the order of `schema`.

    Blocks are read where they are held: pairs are never shuffled or written. With `half` (blocks of one table) each pair
    of blocks comes once, the left one first.
    """
    a, b = (df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)) for df, side in ((left, "l"), (right, "r")))
    pairs = a.crossJoin(b)
    pairs = pairs.where("l_at <= r_at") if half else pairs

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                (row,) = batch.slice(i, 1).to_pylist()
                for out in work(_block(row, "l_"), _block(row, "r_")):
                    yield pa.RecordBatch.from_pydict(out)

    return pairs.mapInArrow(run, schema)


def _slices(n: int, width: int):
    """So many rows at a time that their distances to `width` rows stay within `PIECE` entries."""
    step = max(1, PIECE // max(1, width))
    return (slice(s, min(n, s + step)) for s in range(0, n, step))


def _same(left: Block, right: Block):
    """Of each row of `left` the range of rows of `right` that have its id (rows are in order of their ids)."""
    return np.searchsorted(right.id, left.id), np.searchsorted(right.id, left.id, "right")


def _put_same(d: np.ndarray, part: slice, low: np.ndarray, high: np.ndarray, value: float) -> None:
    for r in np.flatnonzero(low[part] < high[part]):
        d[r, low[part][r] : high[part][r]] = value


def nearest(queries: DataFrame, data: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", with_self: bool = False) -> DataFrame:
    """(i, j, d2, rank): the k nearest rows of `data` (ties by id) of every row of `queries`, exactly.

    A task goes over the pairs of one block with up to `STRIPE` others and keeps the k best of each row on its way, which
    bound what the next block may add; the best of the tasks are ranked per query. Squared Euclidean distances to six
    places. A product of matrices in single precision tells what may be among the k best, given its largest error;
    distances of those are sums of squared differences.
    """
    groups = max(128, 2 * k)

    def match(left: Block, right: Block, best: tuple[np.ndarray, np.ndarray]):
        """Put the rows of `right` that are among the k best into `best`: distances (infinite where none is yet) and ids."""
        right = Block(right.at, *(x[np.isfinite(right.v).all(1)] for x in (right.id, right.v)), {})
        if not len(left.id) or not len(right.id):
            return
        centre = right.v.mean(0)
        x, y = left.v - centre, right.v - centre
        longest = np.sqrt((y**2).sum(1).max())
        reach = np.sqrt((x**2).sum(1)) + longest
        kind = np.float32 if np.nanmax(reach, initial=0) < 1e15 else np.float64
        slack = 2 * (x.shape[1] + 8) * np.finfo(kind).eps * reach**2 + 2e-6
        # one more column adds the squared length of y; the block is filled up to whole groups with rows infinitely far
        wide = np.zeros((-(-len(y) // groups) * groups, y.shape[1] + 1), kind)
        wide[: len(y), :-1], wide[: len(y), -1], wide[len(y) :, -1] = -2 * y, (y**2).sum(1), np.inf
        own, x, wide = (x**2).sum(1), np.column_stack([x, np.ones(len(x))]).astype(kind), wide.T.copy()
        low, high = _same(left, right)
        for part in _slices(len(x), wide.shape[1]):
            d, last = x[part] @ wide, best[0][part, -1]
            if not with_self:
                _put_same(d, part, low, high, np.inf)
            # the product lacks the squared length of x
            most = last - own[part]
            if not np.isfinite(last).all():
                most = np.fmin(most, np.partition(d.reshape(len(d), -1, groups).min(1), k - 1, axis=1)[:, k - 1])
            r, c = np.divmod(np.flatnonzero(d <= np.nextafter((most + slack[part]).astype(kind), kind(np.inf))[:, None]), d.shape[1])
            r, c = r[(ok := np.isfinite(d[r, c]))], c[ok]
            if not len(r):
                continue
            d2 = np.empty(len(r))
            for s in range(0, len(r), 32768):
                at = slice(s, s + 32768)
                d2[at] = np.round(((left.v[part][r[at]] - right.v[c[at]]) ** 2).sum(1), 6)
            on = np.unique(r)
            r, d2, j = np.r_[r, np.repeat(on, k)], np.r_[d2, best[0][part][on].ravel()], np.r_[right.id[c], best[1][part][on].ravel()]
            order = np.lexsort((j, d2, r))
            r, d2, j = r[order], d2[order], j[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            for of, values in zip(best, (d2, j), strict=True):
                of[part][r[rank < k], rank[rank < k]] = values[rank < k]

    def run(batches):
        left = best = None

        def kept():
            r, c = np.nonzero(np.isfinite(best[0]))
            return pa.RecordBatch.from_pydict({"i": left.id[r], "j": best[1][r, c], "d2": best[0][r, c]})

        for batch in batches:
            for i in range(len(batch)):
                (row,) = batch.slice(i, 1).to_pylist()
                if left is None or row["l_at"] != left.at:
                    if left is not None:
                        yield kept()
                    left = _block(row, "l_")
                    best = np.full((len(left.id), k), np.inf), np.full((len(left.id), k), np.iinfo("int64").max)
                match(left, _block(row, "r_"), best)
        if left is not None:
            yield kept()

    own = _blocks(queries, key, vector)
    other = own if data is queries else _blocks(data, key, vector)
    n = other.rdd.getNumPartitions()
    tasks = min(n, max(-(-n // STRIPE), -(-TASKS // own.rdd.getNumPartitions())))
    a, b = (df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)) for df, side in ((own, "l"), (other.coalesce(tasks), "r")))
    found = a.crossJoin(b).mapInArrow(run, "i bigint, j bigint, d2 double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy("d2", "j")))
    return ranked.where(F.col("rank") <= k)


def knn_graph(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(src, dst, cost) symmetric: an arc either way where one is among the other's k nearest; cost is the distance."""
    near = nearest(rows, rows, k, key, vector)
    both = near.select(F.explode(F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst")))).alias("e"), F.round(F.sqrt("d2"), 6).alias("cost"))
    return both.groupBy("e.src", "e.dst").agg(F.min("cost").alias("cost"))


def knn_classify(train: DataFrame, test: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, pred): the majority label of the k nearest training rows; ties go to the least label."""
    near = nearest(test, train, k, key, vector).join(train.select(F.col(key).alias("j"), F.col(label).alias("vote")), "j")
    votes = near.groupBy("i", "vote").agg(F.count("*").alias("n"))
    return votes.groupBy(F.col("i").alias(key)).agg(F.max_by("vote", F.struct("n", -F.col("vote"))).alias("pred"))


def one_nn_accuracy(train: DataFrame, test: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    pred = knn_classify(train, test, 1, key, vector, label)
    return test.select(key, label).join(pred, key).agg(F.round(F.avg((F.col(label) == F.col("pred")).cast("double")), 6).alias("accuracy"))


def pca(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", standard: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, top k eigenvalues and eigenvectors (columns) of the covariance (of the correlation, if `standard`)."""
    n, s, p = _sums(rows, vector)
    c = (p - np.outer(s, s) / n) / (n - 1)
    if standard:
        d = np.sqrt(np.maximum(np.diag(c) * (n - 1) / n, 1e-300))
        c = c / np.outer(d, d)
    values, vectors = np.linalg.eigh(c)
    return s / n, values[::-1][:k], vectors[:, ::-1][:, :k]


def svd(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Top k singular values and right vectors of the uncentred matrix, from its Gram matrix."""
    _, _, p = _sums(rows, vector)
    values, vectors = np.linalg.eigh(p)
    return np.sqrt(np.maximum(values[::-1][:k], 0)), vectors[:, ::-1][:, :k]


def project(rows: DataFrame, axes: np.ndarray, mean: np.ndarray | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(float) - (0 if mean is None else mean)
                yield pd.DataFrame({key: pdf[key], vector: list(x @ axes)})

    return rows.select(key, vector).mapInPandas(run, f"{key} bigint, {vector} array<double>")


def double_centred(distances: DataFrame) -> DataFrame:
    """(i, j, b) from squared distances (i, j, d2): -0.5 (d2 - row mean - column mean + grand mean)."""
    row = distances.groupBy("i").agg(F.avg("d2").alias("rm"))
    col = distances.groupBy("j").agg(F.avg("d2").alias("cm"))
    grand = distances.agg(F.avg("d2")).first()[0] or 0.0
    return distances.join(row, "i").join(col, "j").select("i", "j", F.round(-0.5 * (F.col("d2") - F.col("rm") - F.col("cm") + F.lit(grand)), 6).alias("b"))


def centred_products(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(i, j, b) of all ordered pairs: the double-centred matrix of squared distances, which is that of the products of the
    centred vectors. Rows go out as they are found; none is held, shuffled or written."""
    whole = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    mean = np.array([r["mean"] for r in moments(whole, key, vector).orderBy("dim").collect()], dtype=float)

    def match(left: Block, right: Block):
        x, y = left.v - mean, (right.v - mean).T.copy()
        for part in _slices(len(x), y.shape[1]):
            b = np.round(x[part] @ y, 6) + 0.0
            yield {"i": np.repeat(left.id[part], b.shape[1]), "j": np.tile(right.id, len(b)), "b": b.ravel()}

    own = _blocks(whole, key, vector)
    return _paired(own, own, match, "i bigint, j bigint, b double")


def scaled(distances: DataFrame, k: int) -> tuple[list[int], np.ndarray]:
    """Classical scaling: coordinates from the eigenvectors of the double-centred matrix; for small n, on the driver."""
    rows = double_centred(distances).orderBy("i", "j").collect()
    ids = sorted({r["i"] for r in rows})
    b = np.array([r["b"] for r in rows]).reshape(len(ids), len(ids))
    values, vectors = np.linalg.eigh((b + b.T) / 2)
    return ids, vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))


def _leading(times, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors of a symmetric matrix of n rows, of which only products are known.

    Up to `WHOLE` rows the matrix is found and decomposed. Else a space grows by what the leading vectors lack, until that is
    under 1e-10 of the largest value; it has `SPACE` entries at most and starts anew from its leading vectors then.
    """
    if n <= WHOLE:
        b = times(np.eye(n))
        values, vectors = np.linalg.eigh((b + b.T) / 2)
        return values[::-1][:k], vectors[:, ::-1][:, :k]
    most = max(4 * k + 8, SPACE // n)
    wide = max(k, min(32, most // 4))
    space, image, new = np.empty((n, 0)), np.empty((n, 0)), np.linalg.qr(np.random.default_rng(3).normal(size=(n, wide)))[0]
    while True:
        space, image = np.hstack([space, new]), np.hstack([image, times(new)])
        small = space.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:wide], turn[:, ::-1]
        lack = image @ turn[:, :wide] - space @ turn[:, :wide] * values
        size = np.sqrt((lack**2).sum(0))
        new = lack[:, size > 1e-13 * max(abs(values).max(), 1e-300)]
        if size[:k].max() <= 1e-10 * abs(values).max() or not new.shape[1]:
            return values[:k], space @ turn[:, :k]
        if space.shape[1] + wide > most:
            space, image = (x @ turn[:, : 2 * wide] for x in (space, image))
        for _ in range(2):
            new = np.linalg.qr(new - space @ (space.T @ new))[0]


def isomap(rows: DataFrame, k: int, dims: int, key: str = "vec_id", vector: str = "embedding") -> tuple[list[int], np.ndarray]:
    """kNN graph, shortest paths of any length along it, classical scaling. Pairs without a path get the longest finite distance.

    Paths are tables in the executors, some sources each. The driver has the arcs, sums by row and the products of the
    double-centred matrix with some vectors, never the matrix.
    """
    from .edges import path_tables

    ids = np.unique(rows.select(F.col(key).cast("long").alias("i")).where("i is not null").toArrow().column("i").to_numpy())
    n, sc = len(ids), rows.sparkSession.sparkContext
    if not n:
        return [], np.empty((0, dims))
    tables = path_tables(knn_graph(rows, k, key, vector), ids, HELD)
    sums = lambda d: (np.where(np.isfinite(d), d, 0.0) ** 2).sum(1)
    parts = sorted(tables.map(lambda t: (t[0], sums(t[1]), (~np.isfinite(t[1])).sum(1), t[1][np.isfinite(t[1])].max())).collect(), key=lambda p: p[0])
    far = max(p[3] for p in parts)
    mean = np.concatenate([p[1] + p[2] * far**2 for p in parts]) / n

    def times(v: np.ndarray) -> np.ndarray:
        held = sc.broadcast((v, mean, mean.mean()))

        def product(t):
            v, mean, grand = held.value
            d2 = np.where(np.isfinite(t[1]), t[1], far) ** 2
            return t[0], np.round(-0.5 * (d2 - mean[t[0] : t[0] + len(d2), None] - mean + grand), 6) @ v

        out = np.vstack([x for _, x in sorted(tables.map(product).collect(), key=lambda p: p[0])])
        held.unpersist()
        return out

    values, vectors = _leading(times, n, dims)
    tables.unpersist()
    return ids.tolist(), vectors * np.sqrt(np.maximum(values, 0))


def discriminant(rows: DataFrame, k: int, vector: str = "embedding", label: str = "label") -> tuple[np.ndarray, np.ndarray]:
    """Linear discriminant axes: eigenvectors of inv(within) between, from class sums gathered in one pass."""
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    n, s, p = _sums(rows, vector)
    within, between, mean = p.copy(), np.zeros_like(p), s / n
    for c in classes:
        m, t, _ = _sums(rows.where(F.col(label) == c), vector)
        within -= np.outer(t, t) / m
        between += m * np.outer(t / m - mean, t / m - mean)
    values, axes = np.linalg.eig(np.linalg.pinv(within) @ between)
    order = np.argsort(-values.real)[:k]
    return values.real[order], axes.real[:, order]


def _squares(x: np.ndarray, y: np.ndarray, single: bool = False):
    """A function that gives minus the squared distances of some rows of x to all rows of y, by one product of matrices.

    With `single` it is one in single precision where vectors are so short that its errors are some 1e-7.
    """
    centre = y.mean(0) if len(y) else 0.0
    x, y = x - centre, y - centre
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    reach = (np.sqrt(xx.max(initial=0)) + np.sqrt(yy.max(initial=0))) ** 2 * np.sqrt(x.shape[1] + 2)
    kind = np.float32 if single and reach <= 64 else np.float64
    wide = np.column_stack([2 * y, -yy, np.ones(len(y))]).astype(kind).T.copy()
    x = np.column_stack([x, np.ones(len(x)), -xx]).astype(kind)

    def squares(part: slice) -> np.ndarray:
        d = x[part] @ wide
        return np.minimum(d, 0, out=d)

    return squares


class _ByLabel:
    """Sums over the columns of some label, and over all, of matrices whose columns are a block's rows."""

    def __init__(self, block: Block):
        self.order = np.argsort(block.of["label"], kind="stable")
        self.label = block.of["label"][self.order]
        self.start = np.flatnonzero(np.r_[True, self.label[1:] != self.label[:-1]]) if len(self.label) else np.array([], int)
        self.names = self.label[self.start]

    def sums(self, e: np.ndarray, label: np.ndarray):
        """Of each row of `e` the sum over the columns that have its label, and over all; a missing label is like none."""
        by = np.add.reduceat(e, self.start, axis=1).astype(float)
        at = np.minimum(np.searchsorted(self.names, label), len(self.names) - 1)
        return np.where(self.names[at] == label, by[np.arange(len(e)), at], 0.0), by.sum(1)


def _sorted(block: Block, by: _ByLabel) -> Block:
    return Block(block.at, block.id[by.order], block.v[by.order], {c: x[by.order] for c, x in block.of.items()})


def _columns(left: Block, right: Block, by: _ByLabel):
    """A function that puts a value where rows of `left` meet themselves in `right`, whose rows `by` has put in order."""
    place = np.empty(len(by.order), int)
    place[by.order] = np.arange(len(by.order))
    low, high = _same(left, right)

    def put(d: np.ndarray, part: slice, value: float) -> None:
        for r in np.flatnonzero(low[part] < high[part]):
            d[r, place[low[part][r] : high[part][r]]] = value

    return put


def nca_objective(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", dims: int | None = None) -> DataFrame:
    """(objective): the expected number of rows whose stochastic neighbour has their label, with the identity transform.

    Each pair of blocks gives two sums a row of either block, so pairs never become rows, and each distance is taken once.
    Vectors of length about one are compared in single precision: errors of some 1e-7 a pair, which sums of a row level out.
    """
    rows = rows.select(key, F.coalesce(F.col(label).cast("double"), F.lit(float("nan"))).alias("label"), (F.slice(vector, 1, dims) if dims else F.col(vector)).alias(vector))

    def match(left: Block, right: Block):
        rows_of, by = _ByLabel(left), _ByLabel(right)
        put, other = _columns(_sorted(left, rows_of), right, by), _sorted(right, by)
        left = _sorted(left, rows_of)
        squares, own, every = _squares(left.v, other.v, True), np.zeros(len(other.id)), np.zeros(len(other.id))
        for part in _slices(len(left.id), len(other.id)):
            e = squares(part)
            np.exp(e, out=e)
            put(e, part, 0.0)
            mine, all_of = by.sums(e, left.of["label"][part])
            yield {"i": left.id[part], "own": mine, "every": all_of}
            if left.at != right.at:
                every += e.sum(0)
                for name in np.unique(left.of["label"][part]):
                    a, b = (np.searchsorted(x, [name, name], side) for x, side in ((other.of["label"], "left"), (other.of["label"], "right")))
                    if not np.isnan(name) and a[0] < b[0]:
                        own[a[0] : b[0]] += e[left.of["label"][part] == name, a[0] : b[0]].sum(0)
        if left.at != right.at:
            yield {"i": other.id, "own": own, "every": every}

    own = _blocks(rows, key, vector, ("label",))
    sums = _paired(own, own, match, "i bigint, own double, every double", half=True)
    p = sums.groupBy("i").agg(F.try_divide(F.sum("own"), F.sum("every")).alias("p"))
    return p.agg(F.round(F.sum("p"), 6).alias("objective"))


def _near_step(own: DataFrame, a: np.ndarray, n: int) -> tuple[float, np.ndarray] | None:
    """The objective and the gradient of `nca` from sums over cells; None if those would not be exact to nine digits.

    Three passes over the blocks; of each only moments by cell and label, or a matrix, reach the driver, added up on the way.
    """
    held, plane = own.select("v", "label").rdd, gauss.plane

    def block(row):
        label = np.frombuffer(row["label"])
        v = np.frombuffer(row["v"]).reshape(len(label), -1)
        return v, plane(v @ a.T), label, np.full(len(label), np.nan)

    def first(row):
        _, z, label, _ = block(row)
        return gauss.moments(z, label, np.ones(len(z)))

    counts = held.map(first).treeReduce(gauss.added)
    if counts is None:
        return None
    cells = {name[1:] for name in counts}
    of_label = gauss.coefficients({k: m for k, m in counts.items() if k[0] is not None}, cells)
    of_all = gauss.coefficients(gauss.total(counts), cells)

    def known(z, label, none):
        every = gauss.sums(z, none, of_all) - 1
        own = np.where(np.isnan(label), 0.0, gauss.sums(z, label, of_label) - 1)
        return every, own / every

    def second(row):
        _, z, label, none = block(row)
        every, p = known(z, label, none)
        if not every.min() > 1e-4 * n:
            return None
        return p.sum(), gauss.moments(z, none, p / every), gauss.moments(z, label, 1 / every)

    def both(x, y):
        return None if x is None or y is None else (x[0] + y[0], gauss.added(x[1], y[1]), gauss.added(x[2], y[2]))

    weights = held.map(second).treeReduce(both)
    if weights is None or weights[1] is None or weights[2] is None:
        return None
    back_all = gauss.coefficients(weights[1], cells)
    back_label = gauss.coefficients({k: m for k, m in weights[2].items() if k[0] is not None}, cells)

    def third(row):
        v, z, label, none = block(row)
        every, p = known(z, label, none)
        missing = np.isnan(label)[:, None]
        own = np.where(missing, 0.0, gauss.sums(z, label, of_label, True))
        mine = (p[:, None] * gauss.sums(z, none, of_all, True) - own) / every[:, None]
        others = gauss.sums(z, none, back_all, True) - np.where(missing, 0.0, gauss.sums(z, label, back_label, True))
        return (mine + others)[:, : len(a)].T @ v

    return float(weights[0]), held.map(third).treeReduce(np.add)


def nca(rows: DataFrame, dims: int, steps: int = 20, rate: float = 0.01, key: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 3) -> tuple[np.ndarray, list[float]]:
    """Neighbourhood components by gradient ascent over all pairs of rows; returns the transform and the objectives.

    On one or two axes a step goes over the rows, not over pairs, as the kernel's sums come from the moments of cells (see
    `gauss`). Where those are not exact to nine digits (sums tiny beside the number of rows, too many cells, repeated ids,
    more axes), a step adds up two passes over pairs of blocks: each row's scale and sums, then the gradient, a matrix a
    pair of blocks. Both work in the `dims` columns of the projected rows; only a row's total meets its vector.
    """
    rows = rows.select(key, F.coalesce(F.col(label).cast("double"), F.lit(float("nan"))).alias("label"), vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    width = rows.select(F.size(vector)).first()[0]
    a, seen = np.random.default_rng(seed).normal(scale=0.1, size=(dims, width)), []

    def sums(left: Block, right: Block, a: np.ndarray):
        by = _ByLabel(right)
        put, squares = _columns(left, right, by), _squares(left.v @ a.T, right.v[by.order] @ a.T)
        for part in _slices(len(left.id), len(right.id)):
            e = squares(part)
            put(e, part, -np.inf)
            top = np.maximum(e.max(1), -1e300)
            own, every = by.sums(np.exp(e - top[:, None]), left.of["label"][part])
            yield {"i": left.id[part], "top": top, "own": own, "every": every}

    def slope(left: Block, right: Block, a: np.ndarray):
        by = _ByLabel(right)
        put, right = _columns(left, right, by), _sorted(right, by)
        z, u = left.v @ a.T, right.v @ a.T
        squares, rows_of, columns_of = _squares(z, u), np.zeros(z.shape), np.zeros(u.shape)
        ones, others = np.column_stack([u, np.ones(len(u))]), np.column_stack([z, np.ones(len(z))])
        for part in _slices(len(left.id), len(right.id)):
            e = squares(part)
            put(e, part, -np.inf)
            top, every, p = (left.of[c][part, None] for c in ("top", "every", "p"))
            w = np.exp(e - top) / np.where(every > 0, every, 1)
            low, high = (np.searchsorted(right.of["label"], left.of["label"][part], side) for side in ("left", "right"))
            same = np.arange(len(u)) >= low[:, None]
            same &= np.arange(len(u)) < np.where(np.isnan(left.of["label"][part]), low, high)[:, None]
            w *= p - same
            of = w @ ones
            rows_of[part] = z[part] * of[:, -1:] - of[:, :-1]
            of = w.T @ others[part]
            columns_of += u * of[:, -1:] - of[:, :-1]
        yield {"g": pa.array([(rows_of.T @ left.v + columns_of.T @ right.v).ravel().tolist()])}

    own = _blocks(rows, key, vector, ("label",))
    n = own.rdd.getNumPartitions()
    ids = rows.agg(F.count(key), F.count_distinct(key)).first()
    near = dims <= 2 and ids[0] == ids[1]
    for _ in range(steps):
        step = _near_step(own, a, ids[0]) if near else None
        if step is not None:
            seen.append(step[0])
            a = a + rate * 2 * step[1]
            continue
        found = _paired(own, own, (lambda a: lambda l, r: sums(l, r, a))(a), "i bigint, top double, own double, every double")
        found = found.groupBy("i").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "own", "every")).alias("of"))
        total = lambda c: F.aggregate("of", F.lit(0.0), lambda s, x: s + x[c] * F.exp(x["top"] - F.col("top")))
        known = found.select(F.col("i").alias(key), "top", total("every").alias("every"), F.coalesce(F.try_divide(total("own"), total("every")), F.lit(0.0)).alias("p")).persist()
        seen.append(float(known.agg(F.sum("p")).first()[0]))
        whole = _blocks(rows.join(known, key), key, vector, ("label", "top", "every", "p"), n)
        flat = _paired(whole, own, (lambda a: lambda l, r: slope(l, r, a))(a), "g array<double>")
        grad = flat.select(F.posexplode("g").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
        a = a + rate * 2 * np.array([r["v"] for r in grad]).reshape(a.shape)
        whole.unpersist()
        known.unpersist()
    own.unpersist()
    return a, seen
