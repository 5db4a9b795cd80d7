"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Each text becomes its set of five-word shingles; texts with one set form a class, which goes on as one node.
2. Each class gets a label in each of `TREES` trees: `LABEL` bytes, each from another MinHash value (Bawa, Condie and
   Ganesan 2005). A tree is the trie of its labels; a node of it is a prefix. The shortest prefix in use is the one with
   which a pair at the threshold meets in some tree with the target recall; subtries with one class are left at once.
3. From the longest prefix on, classes that share one are compared where they meet: with the least class
   of the node, on the whole sets, first with the one met in most trees and then with all others. Classes already linked
   are not compared again. Then the recall is estimated from the links found, each weighed by the inverse of the chance with
   which its likeness makes it meet at that length (Horvitz and Thompson 1952), and the prefixes are shortened until the
   target is met, or the shortest one is reached, which meets it by its length.
4. At the last length, nodes that still hold several groups are compared whole, in blocks. The
   components of the verified links are the groups; links are counted inside groups, in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, Memo, free, kind, lookup, mix, partitions, settled, slices
from .graph import components

WIDTH, THRESHOLD, TREES, LABEL, RECALL = 5, 0.8, 64, 12, 0.999
BLOCK_ROWS, BLOCK_SHINGLES, PART_PAIRS = 1500, 1_500_000, 500


def meeting(likeness, length: int, trees: int):
    """The chance that two sets share a prefix of this length in some tree (a byte of the label may also agree by accident)."""
    return 1 - (1 - (likeness + (1 - likeness) / 256) ** length) ** trees


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> int:
    """The longest prefix that meets the recall for pairs at the threshold: no prefix is ever shorter."""
    return next((k for k in range(label, 1, -1) if meeting(threshold, k, trees) >= recall), 1)


_words: Memo = Memo(xxhash.xxh64_intdigest, 300_000)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the windows of `width` words (of all words, if fewer); none for a text without words."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(h[i : i + n] + np.uint64(i))
    return np.unique(mix(out))


def _factors(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).astype(np.uint32) | np.uint32(1)


def labels(sets: list[np.ndarray], trees: int, length: int) -> np.ndarray:
    """For each set, the bytes of its labels, tree by tree."""
    sizes = np.array([len(s) for s in sets])
    flat = (np.concatenate(sets) >> np.uint64(16)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.zeros((len(sets), trees * length), np.uint8)
    for k, factor in enumerate(_factors(trees * length)):
        x = flat * factor
        x ^= x >> np.uint32(15)
        out[:, k] = mix(np.minimum.reduceat(x, starts).astype(np.uint64)) >> np.uint64(56)
    return out


def signatures(docs: DataFrame, text: str, doc_id: str, width: int, trees: int, length: int) -> DataFrame:
    """doc_id, row (a hash of id and text), k1 (a hash of the shingle set), n, labels."""

    def run(batches):
        for batch in slices(batches, "text", 2 << 20):
            sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            marks = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            found: list = [None] * len(sets)
            if full:
                for i, row in zip(full, labels([sets[i] for i in full], trees, length), strict=True):
                    found[i] = row.tobytes()
            cols = [batch.column("doc_id"), batch.column("row"), pa.array(marks), pa.array([len(s) for s in sets], pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "k1", "n", "labels"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind(docs, doc_id)}, row bigint, k1 bigint, n bigint, labels binary")


def roots(members: DataFrame, trees: int, length: int, shortest: int, wanted: DataFrame | None = None) -> DataFrame:
    """(root, k1, label) for each row and tree: the root names the tree and the shortest prefix of the label there.

    With `wanted` (a column root), most of the others are left out; a join has to settle the rest.
    """
    sent = None if wanted is None else members.sparkSession.sparkContext.broadcast(Bloom(wanted, "root"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                table = np.frombuffer(b"".join(batch.column("labels").to_pylist()), np.uint8).reshape(batch.num_rows, trees, length)
                wide = np.zeros((batch.num_rows, trees, -(-shortest // 8) * 8), np.uint8)
                wide[:, :, :shortest] = table[:, :, :shortest]
                root = np.broadcast_to(mix(np.arange(1, trees + 1, dtype=np.uint64)), (batch.num_rows, trees))
                for word in np.moveaxis(wide.view("<u8"), 2, 0):
                    root = mix(root * np.uint64(0x9E3779B97F4A7C15) + word)
                root, owner = root.ravel().view(np.int64), np.repeat(batch.column("k1").to_numpy(), trees)
                use = np.ones(len(root), bool) if sent is None else sent.value.has(root)
                cols = [pa.array(root[use]), pa.array(owner[use])]
                if sent is not None:
                    cols.append(pa.array(np.ascontiguousarray(table).reshape(-1, length)[use].view(f"V{length}").ravel().tolist(), pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["root", "k1", "label"][: len(cols)])

    return members.select("k1", "labels").mapInArrow(run, "root bigint, k1 bigint" + ", label binary" * (sent is not None))


def shingle_sets(docs: DataFrame, text: str, doc_id: str, width: int, wanted: DataFrame) -> DataFrame:
    """(k1, copies, n, set) of the classes `wanted` (rep, k1, copies, n), from the texts of their representatives."""

    def cut(batches):
        for batch in slices(batches, "text", 2 << 20):
            sets = [shingles(t, width).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("k1", "copies", "n")] + [pa.array(sets, pa.binary())], names=["k1", "copies", "n", "set"])

    texts = docs.select(F.xxhash64(doc_id, text).alias("rep"), F.col(text).alias("text")).join(wanted, "rep")
    return texts.select("k1", "copies", "n", "text").mapInArrow(cut, "k1 bigint, copies bigint, n bigint, set binary").dropDuplicates(["k1"])


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows of `pairs` (a, b, ca, cb) whose sets are at least `threshold` alike, with their likeness.

    The set of b is sent to as many tasks as its pairs need, `PART_PAIRS` in each.
    """
    sizes = pairs.groupBy("b").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / PART_PAIRS).cast("int"))
    left = lookup(pairs, sizes, "b", "size").withColumn("part", F.pmod("a", "parts").cast("int"))
    left = left.join(sets.select(F.col("k1").alias("a"), "set"), "a").select("b", "part", "a", "ca", "cb", "set")
    right = sizes.join(sets.select(F.col("k1").alias("b"), "set"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.lit(None).cast("bigint").alias(c) for c in ("a", "ca", "cb")), "set")
    dealt = left.unionByName(right).repartition(partitions(pairs.sparkSession), "b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))

    def run(batches):
        own = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, ca, cb, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ca", "cb", "set")), strict=True):
                got = np.frombuffer(raw, np.uint64)
                if a is None:
                    own = got
                    continue
                both = len(np.intersect1d(own, got, assume_unique=True))
                if both >= threshold * (len(own) + len(got) - both) - 1e-9:
                    out.append((a, b, ca, cb, both / (len(own) + len(got) - both)))
            table = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(table, [pa.int64()] * 4 + [pa.float64()], strict=True)], names=["a", "b", "ca", "cb", "likeness"])

    return dealt.select("a", "b", "ca", "cb", "set").mapInArrow(run, "a bigint, b bigint, ca bigint, cb bigint, likeness double")


class Groups:
    """The groups found so far: `of` has columns k1 and c (the least class linked to it, itself if none is)."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, threshold: float):
        self.of, self.sets, self.threshold = settled(nodes.select("k1", F.col("k1").alias("c"))), sets, threshold
        self.tried, self.links = None, []

    def join(self, pairs: DataFrame) -> None:
        """Verify pairs (a, b, ca, cb) that were not tried before, and merge the groups of those that are alike."""
        pairs = pairs.where("ca <> cb").select("a", "b", "ca", "cb").dropDuplicates(["a", "b"])
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = settled(pairs)
        if pairs.isEmpty():
            return
        self.tried = pairs.select("a", "b") if self.tried is None else self.tried.unionByName(pairs.select("a", "b"))
        links = settled(verify(pairs, self.sets, self.threshold))
        if links.isEmpty():
            return
        self.links.append(links.select("likeness"))
        self.merge(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))

    def merge(self, links: DataFrame) -> None:
        """Merge the groups a and b of each row."""
        merged = components(links)
        sizes = self.of.groupBy("c").agg(F.count("*").alias("size"))
        moved = sizes.join(merged.withColumnRenamed("node", "c"), "c", "left").select("c", "size", F.coalesce("component", "c").alias("fresh"))
        self.of = settled(lookup(self.of, moved, "c", "size").select("k1", F.col("fresh").alias("c")))

    def met(self, length: int, trees: int) -> float:
        """The estimated share of all links that prefixes of this length bring together; one link at the threshold is added."""
        found, weight = 1, 1 / meeting(self.threshold, length, trees)
        for links in self.links:
            row = links.select(F.count("*").alias("n"), F.sum(1 / meeting(F.col("likeness"), length, trees)).alias("w")).first()
            found, weight = found + row["n"], weight + (row["w"] or 0)
        return found / weight


def forest_groups(tries: DataFrame, sets: DataFrame, threshold: float, trees: int, length: int, shortest: int, recall: float) -> DataFrame:
    """(k1, c): the group of each class in `tries` (root, k1, label)."""
    groups = Groups(tries.select("k1").distinct(), sets, threshold)
    depth = length
    while True:
        place = tries.select("k1", F.xxhash64("root", F.expr(f"substring(label, 1, {depth})")).alias("place"))
        for first in (True, False) if depth == length else (False,):
            seen = place.join(groups.of, "k1")
            heads = seen.groupBy("place").agg(F.min(F.struct("k1", "c")).alias("head"), F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size"))
            heads = heads.where("low < high").select("place", "size", F.col("head.k1").alias("b"), F.col("head.c").alias("cb"))
            pairs = lookup(seen, heads, "place", "size").select(F.col("k1").alias("a"), F.col("c").alias("ca"), "b", "cb").where("ca <> cb")
            if first:
                often = pairs.groupBy("a", "ca", "b", "cb").agg(F.count("*").alias("times"))
                best = often.groupBy("a", "ca").agg(F.max(F.struct("times", -F.col("b"), "b", "cb")).alias("best"))
                pairs = best.select("a", "ca", "best.b", "best.cb")
            groups.join(pairs)
        if depth == shortest or groups.met(depth, trees) >= recall:
            break
        depth = next((k for k in range(depth - 1, shortest, -1) if groups.met(k, trees) >= recall), shortest)
    # what the least class of a node does not link: nodes that still hold several groups, once for each set of members
    seen = settled(place.join(groups.of, "k1"))
    owners = seen.groupBy("place", "c").agg(F.count("*").alias("own"))
    mixed = owners.groupBy("place").agg(F.sum("own").alias("size"), F.count("*").alias("kinds")).where("kinds > 1 and size > 2").select("place", "size")
    members = settled(lookup(seen, mixed, "place", "size").select("place", "size", "k1"))
    same = members.groupBy("place", "size").agg(F.bit_xor("k1").alias("mark")).groupBy("size", "mark").agg(F.min("place").alias("place"))
    whole = settled(members.join(same.select("place"), "place").select(F.col("place").alias("component"), "k1"))
    if not whole.isEmpty():
        near = blocks(whole, sets, threshold).where("row <> root").select("row", "root").distinct()
        own, other = groups.of.select(F.col("k1").alias("row"), F.col("c").alias("a")), groups.of.select(F.col("k1").alias("root"), F.col("c").alias("b"))
        groups.merge(near.join(own, "row").join(other, "root").select("a", "b").where("a <> b"))
    return groups.of


def pair_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of a bounded list of sets."""
    g = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(g), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    name = np.cumsum(first) - 1
    df = np.bincount(name)
    out = np.full((g, g), int((df == g).sum()), np.float32)
    wanted = np.flatnonzero((df > 1) & (df < g))
    place = np.full(len(df), -1)
    place[wanted] = np.arange(len(wanted))
    at = place[name]
    use = at >= 0
    at, owner = at[use], owner[use]
    width = max(64, min(8192, 40_000_000 // (4 * g)))
    ends = np.searchsorted(at, np.arange(0, len(wanted) + width, width))
    for i in range(len(ends) - 1):
        lo, hi = ends[i], ends[i + 1]
        if hi > lo:
            block = np.zeros((g, width), np.float32)
            block[owner[lo:hi], at[lo:hi] - i * width] = 1
            out += block @ block.T
    return np.rint(out).astype(np.int64)


def _verify(keys, sets, copies, block, threshold, split):
    """Links (counted by copies) and the local component of each row, over the pairs that this group is to judge."""
    sizes = np.array([len(s) for s in sets])
    both = pair_counts(sets)
    near = both >= np.ceil(threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9)
    np.fill_diagonal(near, False)
    if split:  # two different blocks: only pairs across them
        near &= block[:, None] != block[None, :]
    label = np.arange(len(sets))
    while True:
        least = np.where(near, label[None, :], len(sets)).min(1)
        fresh = np.minimum(label, least)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    return near @ np.asarray(copies, np.int64), np.asarray(keys)[label]


def blocks(grouped: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(row, links, root) for each class and block pair: `grouped` has columns component and k1, a pair is judged in each
    component that holds it; links are counted by copies, and root is the least class that chains of links in the block reach."""
    sized = grouped.join(sets.select("k1", "copies", "n"), "k1")
    totals = sized.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("mass"))
    most = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("mass") / BLOCK_SHINGLES)).cast("int")
    wanted = lookup(grouped, totals.select("component", "size", most.alias("blocks")), "component", "size").select("k1", "component", "blocks")
    dealt = wanted.withColumn("own", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int")).join(sets.select("k1", "copies", "set"), "k1")
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    placed = dealt.repartition(partitions(grouped.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j", "k1")

    def judge(batches):
        key, held = None, []

        def settle():
            if len(held) < 2:
                return
            rows, copies, own, raw = zip(*held, strict=True)
            links, root = _verify(rows, [np.frombuffer(r, np.uint64) for r in raw], copies, np.array(own), threshold, key[1] != key[2])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, links, root)], names=["row", "links", "root"])

        for batch in batches:
            for c, i, j, *row in zip(*(batch.column(n).to_pylist() for n in ("component", "i", "j", "k1", "copies", "own", "set")), strict=True):
                if (c, i, j) != key:
                    yield from settle()
                    key, held = (c, i, j), []
                held.append(row)
        yield from settle()

    return placed.select("component", "i", "j", "k1", "copies", "own", "set").mapInArrow(judge, "row bigint, links bigint, root bigint")


def jaccard_groups(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    recall: float = RECALL,
    count_links: bool = True,
) -> DataFrame:
    """One row per row: doc_id, class_id, n_links, row, group.

    class_id is the least doc_id in the row's group of linked rows (its own, if it has no link); n_links counts the other
    rows of the group at least `threshold` alike, copies of the same text included (null without `count_links`: then work is
    linear in a group, while counting takes as many comparisons as a group has pairs of different texts). Rows without
    words, null texts among them, have no links. Texts of fewer than `width` words are one shingle. Rows are counted one
    by one, repeated ones too. Null ids never give a class_id unless a group has no other; ids may be of any type that can
    be ordered. An empty table gives an empty result. Only the two named columns are read; `row` is a hash of
    them, `group` names the row's group.
    """
    shortest = prefix_length(threshold, trees, LABEL, recall)
    members = settled(signatures(docs, text, doc_id, width, trees, LABEL))
    worded = members.where("n > 0")
    classes = settled(worded.groupBy("k1").agg(F.count("*").alias("copies"), F.min("row").alias("rep"), F.min("doc_id").alias("first_id"), F.first("n").alias("n")))
    # subtries below a root that holds two classes or more
    shared = roots(worded, trees, LABEL, shortest).groupBy("root").agg(F.min("k1").alias("low"), F.max("k1").alias("high"), F.count("*").alias("size"))
    shared = settled(shared.where("low < high").select("root", "size"))
    tries = settled(lookup(roots(worded, trees, LABEL, shortest, shared), shared, "root", "size", ready=True).select("root", "k1", "label").distinct())
    wanted = classes.join(tries.select("k1").distinct(), "k1").select("rep", "k1", "copies", "n")
    sets = settled(shingle_sets(docs, text, doc_id, width, wanted))
    found = forest_groups(tries, sets, threshold, trees, LABEL, shortest, recall)
    of_class = classes.join(found, "k1", "left").withColumn("group", F.coalesce("c", "k1"))
    least = of_class.groupBy("group").agg(F.min("first_id").alias("class_id"), F.count("*").alias("size"))
    if count_links:
        several = least.where("size > 1").select("group", "size")
        grouped = lookup(found.withColumnRenamed("c", "group"), several, "group", "size").select(F.col("group").alias("component"), "k1")
        counted = blocks(settled(grouped), sets, threshold).groupBy(F.col("row").alias("k1")).agg(F.sum("links").alias("links"))
        of_class = of_class.join(counted, "k1", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    else:
        of_class = of_class.withColumn("n_links", F.lit(None).cast("long"))
    of_class = (lookup(of_class.select("k1", "copies", "n_links", "group"), least, "group", "size").select("k1", "copies", "class_id", "group", "n_links"))
    out = lookup(worded.select("doc_id", "row", "k1"), of_class, "k1", "copies").select("doc_id", "class_id", "n_links", "row", "group")
    alone = members.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "row", F.col("row").alias("group"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that stand for their groups, with all their columns, whatever their names.

    Of each group the row of least doc_id stays (nulls last), of equal ids the one of least hash, of repeated rows one.
    Rows without words, null and empty texts among them, are no copies of each other, but repeated ones are one row. An empty table gives an
    empty result.
    """
    groups = jaccard_groups(docs, text, doc_id, count_links=False, **options)
    row = free("row", docs.columns)
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")).select(F.col("best.row").alias(row))
    marked = docs.withColumn(row, F.xxhash64(doc_id, text)).join(best, row)
    return marked.dropDuplicates([row]).select(*docs.columns)
