"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

Every task tokenises the documents of its partition and packs them in lots of about `LOT_WINDOWS` sequences, so nothing
is shuffled and memory is bounded by a lot. Whole sequences are cut off long documents first. In a lot, what remains of the
documents is differenced into windows: the two partial partitions with the largest imbalance merge, the fullest windows of
one with the emptiest of the other. If a window exceeds the capacity, the window count rises. Only where that does not
help, as with few long remainders, the pieces are cut shorter and differenced anew. What a lot's windows cannot hold goes to the
next lot; the last lot of a task lays its rest in sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, kind, slices

CAPACITY, LOT_WINDOWS, END_ID = 4096, 64, 2
#: Tokens by which the mean window of a lot is kept under the capacity, longest pieces tried, least length of a stub.
ALLOWANCE, PIECES, LEAST_STUB = 16, (4096, 512, 128), 256
_SPACES = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{_SPACES}]+")
_ODD_SPLIT = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile("[\x01-\x7f\xa1-įı-ɏ]*")
#: The pattern of the vocabulary file's pre-tokenizer (a fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordBpe:
    """Ids of the `word_bpe` vocabulary, cached by chunk between white space; no token of it spans white space.

    Chunks of Latin letters, digits and marks go through a byte-pair engine with the same ranks, the word end being one
    more byte; all others through the tokenizers library itself.
    """

    def __init__(self, path: str, entries: int = 300_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {}
        for token, rank in vocab.items():
            if not token.startswith("<|"):
                end = token.endswith("</w>") and len(token) > 4
                ranks[bytes(byte[c] for c in (token[:-4] if end else token)) + b"\0" * end] = rank
        self.bpe = tiktoken.Encoding("word", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.words = regex.compile(WORD_PATTERN).findall
        self.memo = Memo(self._chunk, entries)

    def _chunk(self, chunk: str) -> bytes:
        piece = self.bpe.encode_single_piece
        if chunk.isalpha() and chunk.isascii():
            ids = piece(chunk.lower().encode() + b"\0")
        elif _PLAIN.fullmatch(chunk):
            ids = [i for w in self.words(chunk.lower()) for i in piece(w.encode() + b"\0")]
        else:
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: str | None, end: int | None = END_ID) -> np.ndarray:
        text = text or ""
        chunks = _CHUNK.findall(text) if _ODD_SPLIT.search(text) else text.split()
        raw = b"".join(map(self.memo.__getitem__, chunks))
        return np.frombuffer(raw if end is None else raw + end.to_bytes(4, "little"), "<u4")


@cache
def word_bpe(path: str) -> WordBpe:
    """One encoder for each worker process, kept from task to task."""
    return WordBpe(path)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, by Karmarkar-Karp multiway differencing."""
    n = len(sizes)
    if windows <= 1 or not n:
        return np.zeros(n, np.int64)
    heap, ids = [], np.full(windows, -1, np.int64)
    for i, s in enumerate(sizes.tolist()):
        sums, own = np.zeros(windows, np.int64), ids.copy()
        sums[0], own[0] = s, i
        heap.append((-s, i, sums, own))
    heapq.heapify(heap)
    joins, top, turn = [], n, n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        both = np.flatnonzero((x >= 0) & (y >= 0))
        own = np.maximum(x, y)
        fresh = np.arange(top, top + len(both))
        joins.append((fresh, x[both], y[both]))
        own[both] = fresh
        top += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, own = sums[order] - sums[order[-1]], own[order]
        turn += 1
        heapq.heappush(heap, (-int(sums[0]), turn, sums, own))
    label = np.full(top + 1, -1, np.int64)
    own = heap[0][3]
    label[own[own >= 0]] = np.flatnonzero(own >= 0)
    for fresh, x, y in reversed(joins):
        label[x] = label[fresh]
        label[y] = label[fresh]
    return label[:n]


def windows_of(sizes: list[int], capacity: int) -> tuple[list[tuple[int, int, int]], list[int], int]:
    """Pieces (item, start, length), the window of each, and how many windows there are; none exceeds the capacity."""
    total = sum(sizes)
    least = -(-total // capacity)
    for piece in (*PIECES, 1):
        piece = max(1, piece * capacity // CAPACITY)
        pieces = [(i, s, min(piece, n - s)) for i, n in enumerate(sizes) for s in range(0, n, piece)]
        lengths = np.array([p[2] for p in pieces], np.int64)
        # beyond one window more, shorter pieces waste less
        for windows in (least, least + 1):
            at = difference(lengths, windows)
            if not len(lengths) or np.bincount(at, lengths).max() <= capacity:
                return pieces, at.tolist(), windows
    raise AssertionError("single ids always fit")


def plan(lengths: list[int], capacity: int = CAPACITY, last: bool = True) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """Lay documents of these lengths in sequences: (document, start, length, sequence, offset) of each piece, and what is carried on.

    The rest, (document, start) of each that is not laid whole, is empty for the `last` lot.
    """
    out, sequence = [], 0
    begin = [n // capacity * capacity for n in lengths]
    for d, n in enumerate(begin):
        for s in range(0, n, capacity):
            out.append((d, s, capacity, sequence, 0))
            sequence += 1
    rest = [n - b for n, b in zip(lengths, begin, strict=True)]
    whole = sum(rest) // capacity
    room = max(0, whole * capacity - whole * max(1, ALLOWANCE * capacity // CAPACITY)) if whole else 0
    taken, left = [0] * len(rest), room
    for d, n in enumerate(rest):  # the first documents, the last of them cut where the room ends
        taken[d] = min(n, left)
        left -= taken[d]
    pieces, at, windows = windows_of(taken, capacity)
    fill = [0] * windows
    for (d, s, n), w in zip(pieces, at, strict=True):
        out.append((d, begin[d] + s, n, sequence + w, fill[w]))
        fill[w] += n
    sequence += windows
    over = [(d, begin[d] + t) for d, (t, n) in enumerate(zip(taken, rest, strict=True)) if t < n]
    if not last:
        return out, over
    # stubs: the largest powers of two first, down to LEAST_STUB; what is less stands alone
    spare = sum(lengths[d] - s for d, s in over)
    while spare:
        need = min(capacity, 1 << (spare.bit_length() - 1))
        need = need if need >= LEAST_STUB else spare
        spare, offset = spare - need, 0
        while offset < need:
            d, s = over[0]
            n = min(need - offset, lengths[d] - s)
            out.append((d, s, n, sequence, offset))
            offset += n
            over[0] = (d, s + n)
            if s + n == lengths[d]:
                over.pop(0)
        sequence += 1
    return out, []


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END_ID, ids: bool = False) -> DataFrame:
    """Pack all rows. One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids).

    A null text counts as empty and gives the end id alone. Rows with equal or null ids are packed one by one. Each id lies
    in exactly one piece; the pieces of a sequence lie gapless from offset 0. Texts may be of any length; a lot holds at least
    one whole text. An empty table gives no pieces. Only the two named columns are read; doc_id may be of any type. Sequence ids are unique; their upper
    bits are those of the partition.
    """

    def run(batches):
        base, lot, held, sequence = TaskContext.get().partitionId() << 40, [], 0, 0
        encoder = word_bpe(tokenizer)

        def emit(last):
            """A lot is a list of (key, ids, start of what is left of them)."""
            nonlocal lot, held, sequence
            rows, over = plan([len(x) - s for _, x, s in lot], capacity, last)
            if rows:
                parts = [lot[d][1][lot[d][2] + s : lot[d][2] + s + n] for d, s, n, _, _ in rows]
                cols = [
                    pa.array([lot[r[0]][0] for r in rows], key_type),
                    pa.array([lot[r[0]][2] + r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                    pa.array([len(lot[r[0]][1]) for r in rows], pa.int64()),
                    pa.array([base + sequence + r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.int64()),
                ]
                sequence += max(r[3] for r in rows) + 1
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if ids:
                    cols.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
            lot = [(lot[d][0], lot[d][1], lot[d][2] + s) for d, s in over]
            held = sum(len(x) - s for _, x, s in lot)

        key_type = None
        for batch in slices(batches, "text"):
            key_type = batch.column("doc_id").type
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lot.append((key, encoder.encode(value, end), 0))
                held += len(lot[-1][1])
                if held >= LOT_WINDOWS * capacity:
                    yield from emit(False)
        yield from emit(True)

    schema = f"doc_id {kind(docs, doc_id)}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def plain_ids(tokenizer, text: str | None, end: int = END_ID) -> list[int]:
    """What the tokenizers library gives for a whole text; the brute-force version that tests hold `WordBpe` against."""
    return [*tokenizer.encode(unicodedata.normalize("NFC", text or ""), add_special_tokens=False).ids, end]
