"""Tag sequences: span extraction, Viterbi decoding, CRF scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = "array<struct<start:int,end:int,kind:string>>"


def _walk(tags, inside: str, close: str | None):
    """Half-open spans of B-x, inside-x... runs. With `close`, a span of several tokens ends by close-x or is dropped."""
    out, start, kind = [], None, None

    def end(at: int, closed: bool):
        nonlocal start, kind
        if start is not None and (close is None or closed or at - start == 1):
            out.append((start, at, kind))
        start = kind = None

    for i, tag in enumerate(tags):
        mark, _, name = (tag or "O").partition("-")
        if mark == "B":
            end(i, False)
            start, kind = i, name
        elif mark == inside and start is not None and name == kind:
            continue
        elif close is not None and mark == close and start is not None and name == kind:
            end(i + 1, True)
        else:
            end(i, False)
    end(len(tags), False)
    return out


def bio_spans(tags) -> list[tuple[int, int, str]]:
    """Spans of BIO tags: the type must match; an inside tag without its begin is dropped."""
    return _walk(tags, "I", None)


def bmoe_spans(tags) -> list[tuple[int, int, str]]:
    """Spans of BMOE tags: several tokens need their end tag; a lone begin tag is a span of one."""
    return _walk(tags, "M", "E")


def bioes_spans(tags) -> list[tuple[int, int, str]]:
    """Spans of BIOES tags, with S for a single token; `B-kind@attribute` keeps kind and attribute."""
    ones = [(i, i + 1, t[2:]) for i, t in enumerate(tags) if t and t.startswith("S-")]
    return sorted(ones + [s for s in _walk([None if t and t.startswith("S-") else t for t in tags], "I", "E") if s[1] - s[0] > 1])


def spans_of(rows: DataFrame, tags: str = "tags", scheme: str = "bio") -> DataFrame:
    """Add `spans` to rows with an array of tags."""
    find = {"bio": bio_spans, "bmoe": bmoe_spans, "bioes": bioes_spans}[scheme]

    @F.pandas_udf(SPANS)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: [] if x is None else [{"start": a, "end": b, "kind": k} for a, b, k in find(list(x))])

    return rows.withColumn("spans", run(tags))


def kind_and_attribute(spans: DataFrame) -> DataFrame:
    """Split `kind@attribute` of the column `kind`; without a mark the attribute is null."""
    at = F.split("kind", "@", 2)
    return spans.withColumn("attribute", F.get(at, F.lit(1))).withColumn("kind", F.get(at, F.lit(0)))


def bio_spans_sql(rows: DataFrame, sentence: str = "sent_id", pos: str = "pos", tag: str = "tag") -> DataFrame:
    """(sentence, start, end, kind) of BIO tags by gaps and islands, in windows alone."""
    w = W.partitionBy(sentence).orderBy(pos)
    kind = F.regexp_extract(tag, "^[BI]-(.*)$", 1)
    same = F.col(tag).startswith("I-") & (F.lag("kind").over(w) == F.col("kind"))
    marked = rows.withColumn("kind", kind).withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("kind <> ''")
    spans = runs.groupBy(sentence, "run").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.min_by(tag, pos).alias("t"), F.first("kind").alias("kind"))
    return spans.where(F.col("t").startswith("B-")).select(sentence, "start", "end", "kind")


def viterbi(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[list[int], float]:
    """The best path and its score; transitions[i, j] goes from i to j."""
    best, back = start + emissions[0], []
    for row in emissions[1:]:
        via = best[:, None] + transitions
        back.append(via.argmax(0))
        best = via.max(0) + row
    best = best + stop
    at = int(best.argmax())
    path = [at]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(best[at])


def log_partition(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, stop: np.ndarray) -> float:
    """The log of the summed scores of all paths."""
    alpha = start + emissions[0]
    for row in emissions[1:]:
        x = alpha[:, None] + transitions
        top = x.max(0)
        alpha = top + np.log(np.exp(x - top).sum(0)) + row
    alpha = alpha + stop
    return float(alpha.max() + np.log(np.exp(alpha - alpha.max()).sum()))


def path_score(path, emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, stop: np.ndarray) -> float:
    return float(start[path[0]] + emissions[np.arange(len(path)), path].sum() + transitions[path[:-1], path[1:]].sum() + stop[path[-1]])


def decode(rows: DataFrame, transitions, start, stop, emissions: str = "emissions") -> DataFrame:
    """Add path (tag indices), score and log_partition to rows with an array of emission arrays."""
    parts = [np.asarray(x, float) for x in (transitions, start, stop)]
    schema = T.StructType([T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType()), T.StructField("log_partition", T.DoubleType())])

    @F.pandas_udf(schema)
    def run(column: pd.Series) -> pd.DataFrame:
        out = []
        for x in column:
            if x is None or not len(x):
                out.append(([], 0.0, 0.0))
                continue
            e = np.stack([np.asarray(r, float) for r in x])
            out.append((*viterbi(e, *parts), log_partition(e, *parts)))
        return pd.DataFrame(out, columns=["path", "score", "log_partition"])

    return rows.withColumn("d", run(emissions)).select(*rows.columns, "d.*")


def hmm_tags(train: DataFrame, smoothing: float = 1.0, sentence: str = "sent_id", pos: str = "pos", token: str = "token", tag: str = "tag"):
    """Counts for a bigram tagger: (prev, tag, n) and (tag, token, n), as grouped frames."""
    w = W.partitionBy(sentence).orderBy(pos)
    steps = train.withColumn("prev", F.coalesce(F.lag(tag).over(w), F.lit("<s>"))).groupBy("prev", tag).agg(F.count("*").alias("n"))
    return steps, train.groupBy(tag, token).agg(F.count("*").alias("n"))
