"""Line dedup by a log-template tree.

As in Drain (He et al. 2017), a line descends a tree of fixed depth, by its number of tokens and then by its leading
tokens, tokens with a digit counting as variable; in the leaf it joins the first template that it resembles or founds
one. All tokens of both lines are compared, at every length and in leaves of every size, and positions that differ
from the founder are the template's variable fields. Templates that recur across documents are dropped, but for the
lines of the first document that has them.

Lines are counted by hash first, so a line that a third of all documents share is one row before anything is
grouped. A leaf is parsed in rounds: its first lines found templates in one task, the others are dealt out and compared
with these, and what resembles none goes on to the next round. That is the order of a sequential parse, so
the result does not depend on how a leaf is dealt.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bloom, Memo, free, kind, lookup, partitions, settled, slices

LEAD, SIMILARITY = 3, 0.7
#: Documents that a template needs, for lines of `MIN_TOKENS` tokens or more and for those of `LONG_TOKENS` or more.
MIN_DOCS, LONG_DOCS, MIN_TOKENS, LONG_TOKENS = 3, 2, 5, 50
#: Lines of fewer tokens are alike only if all tokens are the same or variable: one word of five makes another sentence.
MIN_GENERAL = 8
#: Lines of a leaf that found templates in one task, in the first round and at most (doubling from round to round).
HEADS, MOST_HEADS = 250, 1000
_DIGIT = re.compile(rb"[0-9]")
_MASK = b"<*>"
_code: Memo = Memo(lambda w: 0 if w is _MASK else xxhash.xxh32_intdigest(w) or 1, 300_000)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masked(line: bytes) -> list[bytes]:
    """The tokens of a line, those with a digit replaced by a mark."""
    tokens = line.split()
    return [_MASK if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def parse(tokens: list[bytes]) -> tuple[int, int]:
    """The leaf and the hash of a masked line."""
    return _signed(xxhash.xxh64_intdigest(b" ".join(tokens[:LEAD]), seed=len(tokens))), _signed(xxhash.xxh64_intdigest(b" ".join(tokens)))


def lines_of(docs: DataFrame, text: str, doc_id: str, min_tokens: int) -> DataFrame:
    """The lines of at least `min_tokens` tokens: doc_id, row, line (from 0), first (1 where the row has it first), n, leaf, exact."""
    names = ["line", "first", "n", "leaf", "exact"]

    def run(batches):
        for batch in slices(batches, "text"):
            at, out = [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                seen = set()
                for i, line in enumerate((t or "").encode("utf-8", "replace").split(b"\n")):
                    tokens = masked(line)
                    if len(tokens) >= min_tokens:
                        leaf, exact = parse(tokens)
                        at.append(k)
                        out.append((i, exact not in seen, len(tokens), leaf, exact))
                        seen.add(exact)
            table = np.array(out, np.int64).reshape(len(out), len(names)).T.copy()
            owner = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(owner) for c in ("doc_id", "row")] + [pa.array(c) for c in table], names=["doc_id", "row", *names])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind(docs, doc_id)}, row bigint, " + ", ".join(f"{n} bigint" for n in names))


def tokens_of(docs: DataFrame, text: str, wanted: DataFrame, similarity: float) -> DataFrame:
    """`wanted` (with a column exact) and the tokens (four bytes each, 0 for a variable one) of those lines that can resemble another one."""
    sent = docs.sparkSession.sparkContext.broadcast(Bloom(wanted, "exact"))

    def run(batches):
        may, tried = sent.value, Memo(lambda _: False, 300_000)
        for batch in slices(batches, text):
            held: dict[int, list] = {}
            for t in batch.column(text).to_pylist():
                for line in (t or "").encode("utf-8", "replace").split(b"\n"):
                    tokens = masked(line)
                    if len(tokens) >= MIN_GENERAL and len(tokens) - tokens.count(_MASK) >= similarity * len(tokens):
                        held.setdefault(parse(tokens)[1], tokens)
            names = np.fromiter((k for k in held if not tried[k]), np.int64)
            names = names[may.has(names)]
            tried.update(dict.fromkeys(names.tolist(), True))
            coded = [np.fromiter(map(_code.__getitem__, held[k]), "<u4", len(held[k])).tobytes() for k in names.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(coded, pa.binary())], names=["exact", "tokens"])

    return docs.select(text).mapInArrow(run, "exact bigint, tokens binary").join(wanted, "exact").dropDuplicates(["exact"])


def resembles(founders: np.ndarray, line: np.ndarray, similarity: float) -> int:
    """The first founder that has enough tokens in common with the line, place by place; -1 if none has."""
    alike = ((founders == line) & (line > 0)).sum(1) >= similarity * len(line) - 1e-9
    best = int(alike.argmax()) if len(alike) else 0
    return best if len(alike) and alike[best] else -1


def grow(lines: list[bytes], similarity: float) -> list[int]:
    """For each line of a leaf, in order, the place of the line that founded its template (its own, if it founds one)."""
    rows = np.frombuffer(b"".join(lines), "<u4").reshape(len(lines), -1)
    founders, places, out = np.zeros_like(rows), [], []
    for i, row in enumerate(rows):
        best = resembles(founders[: len(places)], row, similarity)
        if best < 0:
            best = len(places)
            founders[best] = row
            places.append(i)
        out.append(places[best])
    return out


def _groups(batches, *key):
    """Runs of rows with the same key, as lists of dictionaries without it."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[k] for k in key)
            if own != last and held:
                yield held
                held = []
            last = own
            held.append(row)
    if held:
        yield held


def templates(pool: DataFrame, similarity: float, heads: int = HEADS) -> DataFrame:
    """(exact, template): for each line of `pool` (leaf, exact, docs, tokens) the hash of the line that founded its template.

    The lines of a leaf come in order of falling docs, then by hash, as if one task had parsed them one by one.
    """
    left, done = settled(pool), []
    schema = "leaf bigint, exact bigint, place int, template bigint, tokens binary"

    def found(batches):
        for rows in _groups(batches, "leaf"):
            at = grow([r["tokens"] for r in rows], similarity)
            yield pa.RecordBatch.from_pylist([r | {"template": rows[k]["exact"], "tokens": r["tokens"] if k == i else None} for i, (r, k) in enumerate(zip(rows, at, strict=True))], _schema("leaf exact place template tokens"))

    def compare(batches):
        own, names, founders, out = None, [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["leaf"], r["part"]) != own:
                    own, names, founders, table = (r["leaf"], r["part"]), [], [], None
                if r["place"] is not None:
                    names.append(r["exact"])
                    founders.append(r["tokens"])
                    continue
                if table is None:
                    table = np.frombuffer(b"".join(founders), "<u4").reshape(len(founders), -1)
                best = resembles(table, np.frombuffer(r["tokens"], "<u4"), similarity)
                out.append({k: r[k] for k in ("leaf", "exact", "docs", "tokens")} | {"template": names[best] if best >= 0 else None})
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, _schema("leaf exact docs tokens template"))
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _schema("leaf exact docs tokens template"))

    while True:
        order = Window.partitionBy("leaf").orderBy(F.desc("docs"), "exact")
        first = left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= heads)
        first = settled(first.select("leaf", "exact", "place", "tokens").mapInArrow(found, schema))
        done.append(first.select("exact", "template"))
        sizes = left.groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > heads)
        wide = sizes.withColumn("parts", F.ceil(F.col("size") / heads).cast("int"))
        if wide.isEmpty():
            break
        rest = lookup(left.join(first.select("exact"), "exact", "left_anti"), wide, "leaf", "size").withColumn("part", F.pmod("exact", "parts").cast("int"))
        founders = first.where("tokens is not null").join(wide, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        both = founders.select("leaf", "part", "place", "exact", F.lit(None).cast("bigint").alias("docs"), "tokens")
        both = both.unionByName(rest.select("leaf", "part", F.lit(None).cast("int").alias("place"), "exact", "docs", "tokens"))
        dealt = both.repartition(partitions(pool.sparkSession), "leaf", "part").sortWithinPartitions("leaf", "part", F.asc_nulls_last("place"))
        met = settled(dealt.mapInArrow(compare, "leaf bigint, exact bigint, docs bigint, tokens binary, template bigint"))
        done.append(met.where("template is not null").select("exact", "template"))
        left = met.where("template is null").drop("template")
        heads = min(MOST_HEADS, 2 * heads)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _schema(names: str) -> pa.Schema:
    return pa.schema([(n, pa.binary() if n == "tokens" else pa.int32() if n == "place" else pa.int64()) for n in names.split()])


def drop_lines(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: tuple[str, ...] = (),
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    similarity: float = SIMILARITY,
    long_docs: int = LONG_DOCS,
    long_tokens: int = LONG_TOKENS,
) -> DataFrame:
    """Every row with the lines of recurring templates dropped: doc_id, the columns `keep`, text, n_lines, n_dropped, chars_dropped.

    A template recurs if at least `min_docs` documents hold a line of it (`long_docs`, if it has `long_tokens` tokens or
    more); a document counts once, however many of its lines are of the template, and rows with the same id and text are
    one document. Its lines stay in the document of least doc_id (the first copy of each there). Lines of fewer than
    `min_tokens` tokens always stay; those of fewer than `MIN_GENERAL` are compared whole, with variable numbers. A null
    text stays null and has no lines; an empty text has one line. Repeated rows fare alike; null ids come after all
    others, and if only rows with such ids hold a template its first lines stay in all of them. An empty table gives an
    empty result. Only the named columns are read; doc_id may be of any type that can be ordered. A column of `keep` named
    like one of the result's own gives way to it.
    """
    keep = tuple(c for c in dict.fromkeys(keep) if c not in ("doc_id", "text", "n_lines", "n_dropped", "chars_dropped"))
    need = F.when(F.col("n") >= long_tokens, long_docs).otherwise(min_docs)
    lines = settled(lines_of(docs, text, doc_id, min_tokens))
    exact = settled(lines.groupBy("leaf", "exact", "n").agg(F.sum("first").alias("docs")))
    leaves = exact.groupBy("leaf", "n").agg(F.count("*").alias("lines"), F.sum("docs").alias("all")).where((F.col("lines") > 1) & (F.col("n") >= MIN_GENERAL) & (F.col("all") >= need))
    some = lookup(exact, leaves.select("leaf", "lines"), "leaf", "lines").select("leaf", "exact", "docs")
    joined = templates(tokens_of(docs, text, settled(some), similarity), similarity)
    shared = joined.groupBy("template").agg(F.count("*").alias("lines")).where("lines > 1").select("template")
    general = joined.join(shared, "template").select("exact", "template").join(exact.select("exact", "docs", "n"), "exact")
    plain = exact.where(F.col("docs") >= need).join(general.select("exact"), "exact", "left_anti").select("exact", F.col("exact").alias("template"), "docs", "n")
    wanted = settled(general.unionByName(plain))
    hits = settled(lookup(lines.select("doc_id", "row", "line", "first", "exact"), wanted, "exact", "docs", ready=True))
    # one row a document and template before documents are counted
    held = hits.groupBy("template", "row").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")).groupBy("template").agg(F.count("*").alias("many"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"))
    recurring = (held.where(F.col("many") >= need).select("template", "many", "first_id"))
    stays = (F.col("first") == 1) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    row, drops = free("row", ("doc_id", "text", *keep)), free("gone", ("doc_id", "text", *keep))
    gone = lookup(hits.select("template", "doc_id", "row", "line", "first"), recurring, "template", "many").where(~stays).groupBy("row").agg(F.collect_set("line").alias(drops)).withColumnRenamed("row", row)
    base = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("text"), F.xxhash64(doc_id, text).alias(row))
    marked = base.join(gone, row, "left").drop(row)
    kinds = dict(marked.dtypes)
    names = ["doc_id", *keep, "text", "n_lines", "n_dropped", "chars_dropped"]

    def run(batches):
        for batch in slices(batches, "text"):
            texts, n, dropped, chars = [], [], [], []
            for t, g in zip(batch.column("text").to_pylist(), batch.column(drops).to_pylist(), strict=True):
                parts = [] if t is None else t.split("\n")
                out = {*(g or ())}
                n.append(len(parts))
                dropped.append(len(out))
                chars.append(sum(len(parts[i]) for i in out))
                texts.append(t if not out else "\n".join(p for i, p in enumerate(parts) if i not in out))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", *keep)] + [pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (n, dropped, chars))], names=names)

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)] + ["text string, n_lines bigint, n_dropped bigint, chars_dropped bigint"])
    return marked.mapInArrow(run, schema)
