"""Byte-level BPE encoding of whole texts by overlapping chunks, and decoding.

Every text is cut into chunks that overlap. Each chunk is pre-tokenised by itself; a chunk that starts inside a
pre-token goes wrong for a while and then falls into step. Where the boundaries of two neighbours first agree inside the
overlap they are stitched, and from there on both give the same pre-tokens. If they never agree the overlap doubles.
The pieces between boundaries are then encoded one by one. Decoding concatenates the raw bytes of the ids.

Texts of up to `STRETCH` characters are done in one task each. A longer one is dealt out in stretches of that length, which
overlap in the same way: each is a row of its own, encoded in a task of its own, and their ids are stitched and joined in
order. The ids do not depend on the lengths chosen.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, kind, partitions, settled, slices

CHUNK, OVERLAP, LOOK = 1 << 13, 1 << 8, 64
STRETCH, MARGIN = 1 << 20, 1 << 13


class ChunkedBpe:
    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, entries: int = 250_000):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.engine = tiktoken.Encoding("chunked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}
        self.pattern, self.chunk, self.overlap = regex.compile(pattern), chunk, overlap
        single = self.engine._core_bpe.encode_single_piece
        self.memo = Memo(lambda piece: tuple(single(piece.encode("utf-8", "replace"))), entries)

    def _bounds(self, text: str, start: int, stop: int) -> list[int]:
        """Pre-token boundaries of text[start:stop] that a cut at `stop` cannot have moved."""
        at = [start, *(m.end() for m in self.pattern.finditer(text, start, stop))]
        if stop < len(text):
            # the last pre-tokens may go on behind the cut, or depend on what stands there
            while len(at) > 1 and at[-1] > stop - LOOK:
                at.pop()
        return at

    def bounds(self, text: str, first: int = 0, end: int | None = None) -> list[int]:
        """Pre-token boundaries of `text` from `first` on, stitched from its chunks; a stretch that goes on behind `end` stops short of it."""
        whole = end is None
        end = len(text) if whole else end
        starts = list(range(first, end, self.chunk)) or [first]
        stops = [min(end, s + self.chunk + self.overlap) for s in starts]
        found = [self._bounds(text, *x) for x in zip(starts, stops, strict=True)]
        bounds = found[0]
        for k in range(1, len(starts)):
            late, size = found[k], self.overlap
            while True:
                shared = set(late[1:]).intersection(bounds[bisect_left(bounds, starts[k]) :])
                if shared:
                    meet = min(shared)
                    del bounds[bisect_left(bounds, meet) + 1 :]
                    bounds += late[bisect_left(late, meet) + 1 :]
                    break
                if bounds[-1] == end:
                    break  # what came before already reaches the end
                # no agreement yet: read on from the last certain boundary, over a longer stretch
                size *= 2
                more = self._bounds(text, bounds[-1], min(end, max(stops[k], bounds[-1]) + size))
                bounds += more[1:]
                if len(more) == 1 and max(stops[k], bounds[-1]) + size >= end:
                    break  # nothing is certain before a stretch's end
        return bounds

    def pretokens(self, text: str) -> list[str]:
        bounds = self.bounds(text)
        return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pretokens(text or ""))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@cache
def chunked_bpe(path: str, pattern: str) -> ChunkedBpe:
    """One encoder for each worker process, kept from task to task."""
    return ChunkedBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", ids: bool = False, stretch: int = STRETCH) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (and the ids).

    A null text counts as empty: no tokens, and the hashes of nothing. Repeated rows and null ids are encoded one by one;
    an empty table gives an empty result. Texts may be of any length: those of more than `stretch` characters are dealt
    out in stretches. Only the two named columns are read; doc_id may be of any type.
    """

    def run(batches):
        coder = chunked_bpe(path, pattern)
        for batch in slices(batches, "text"):
            n, first, second, kept = [], [], [], []
            for t in batch.column("text").to_pylist():
                got = coder.encode(t)
                n.append(len(got))
                first.append(hashlib.sha256(",".join(map(str, got)).encode()).hexdigest())
                second.append(hashlib.sha256(coder.decode(got)).hexdigest())
                if ids:
                    kept.append(got)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(first), pa.array(second)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {kind(docs, doc_id)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > stretch
    short = rows.where(~long).mapInArrow(run, schema)
    if rows.where(long).isEmpty():
        return short
    return short.unionByName(_dealt(rows.where(long), path, pattern, ids, stretch))


def _dealt(rows: DataFrame, path: str, pattern: str, ids: bool, stretch: int) -> DataFrame:
    """The result of `encode_documents` for long texts: one row a stretch, stitched and joined in order of `part`."""
    margin = min(MARGIN, stretch)
    named = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    copies = settled(named.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies")))

    def cut(batches):
        for batch in batches:
            seen = set()
            for row, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if row not in seen:
                    seen.add(row)
                    at = range(0, len(t), stretch)
                    for k, s in enumerate(at):
                        cols = [[row], [k], [k == len(at) - 1], [t[s : s + stretch + margin + LOOK]]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.string()), strict=True)], names=["row", "part", "last", "text"])

    pieces = named.mapInArrow(cut, "row bigint, part int, last boolean, text string").repartition(partitions(rows.sparkSession), "row", "part")

    def encode(batches):
        """The ids of a stretch up to where it meets the next one (`meet`, from the next one's start; -1 if nowhere), and the ids that end at each of its own first boundaries."""
        coder = chunked_bpe(path, pattern)
        for batch in batches:
            for row, part, last, t in zip(*(batch.column(c).to_pylist() for c in ("row", "part", "last", "text")), strict=True):
                bounds, meet = coder.bounds(t, 0, None if last else len(t)), None
                if not last:
                    late = {b for b in coder.bounds(t, stretch, len(t))[1:] if b <= len(t) - LOOK}
                    meet = min(late.intersection(bounds[bisect_left(bounds, stretch) :]), default=-1)
                    bounds = bounds[: bisect_left(bounds, meet) + 1] if meet >= 0 else bounds
                got = [coder.memo[t[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
                ends = np.concatenate([[0], np.cumsum([len(g) for g in got], dtype=np.int64)])
                early = [(b, int(n)) for b, n in zip(bounds, ends, strict=True) if b <= margin + LOOK]
                flat = np.fromiter(chain.from_iterable(got), "<i4", int(ends[-1])).tobytes()
                cols = [[row], [part], [last], [-1 if meet is None or meet < 0 else meet - stretch], [[b for b, _ in early]], [[n for _, n in early]], [flat]]
                types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=["row", "part", "last", "meet", "bounds", "ends", "ids"])

    coded = settled(pieces.mapInArrow(encode, "row bigint, part int, last boolean, meet bigint, bounds array<bigint>, ends array<bigint>, ids binary").dropDuplicates(["row", "part"]))
    # where a stretch does not meet the next one within the margin (a run of digits or blanks as long), the text is done in one task
    failed = coded.where("not last and meet < 0").select("row").distinct()
    names = ["row", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def out(row, n, first, second, kept):
        cols = [pa.array([row], pa.int64()), pa.array([n], pa.int64()), pa.array([first.hexdigest()]), pa.array([second.hexdigest()])]
        return pa.RecordBatch.from_arrays(cols + ([pa.array([np.concatenate(kept)], pa.list_(pa.int32()))] if ids else []), names=names)

    def join(batches):
        coder, own = chunked_bpe(path, pattern), None
        for batch in batches:
            for row, last, meet, bounds, ends, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "last", "meet", "bounds", "ends", "ids")), strict=True):
                if row != own:
                    own, n, first, second, kept, start = row, 0, hashlib.sha256(), hashlib.sha256(), [], 0
                got = np.frombuffer(raw, "<i4")[ends[bounds.index(start)] :]
                if len(got):
                    first.update(("," * (n > 0) + ",".join(map(str, got.tolist()))).encode())
                    second.update(coder.decode(got.tolist()))
                    n += len(got)
                if ids:
                    kept.append(got)
                start = meet
                if last:
                    yield out(row, n, first, second, kept)

    ordered = coded.join(failed, "row", "left_anti").repartition(partitions(rows.sparkSession), "row").sortWithinPartitions("row", "part")
    kinds = "row bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    done = ordered.select("row", "last", "meet", "bounds", "ends", "ids").mapInArrow(join, kinds)

    def alone(batches):
        coder = chunked_bpe(path, pattern)
        for batch in batches:
            for row, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = np.array(coder.encode(t), np.int32)
                yield out(row, len(got), hashlib.sha256(",".join(map(str, got.tolist())).encode()), hashlib.sha256(coder.decode(got.tolist())), [got])

    rest = named.join(failed, "row", "left_semi").dropDuplicates(["row"]).select("row", "text").mapInArrow(alone, kinds)
    back = done.unionByName(rest).join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return back.select("doc_id", *names[1:])


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """The text of each row's ids; bytes that are not UTF-8 become U+FFFD. Null ids give a null text."""

    def run(batches):
        coder = chunked_bpe(path, pattern)
        for batch in batches:
            texts = [None if x is None else coder.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind(encoded, doc_id)}, text string")
