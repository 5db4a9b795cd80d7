"""Column functions over arrays and strings that the operators and their users share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fitted(ids: Column, length: int, pad=0) -> Column:
    """Truncate to, or pad up to, a fixed length."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def mask(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def fitted_pair(a: Column, b: Column, budget: int) -> tuple[Column, Column]:
    """Cut two arrays to a total length, as if taking from the end of the longer (of the second, if equal) one by one."""
    over = F.greatest(F.size(a) + F.size(b) - budget, F.lit(0))
    gap = F.size(a) - F.size(b)
    rest = F.greatest(over - F.abs(gap), F.lit(0))
    first = F.least(over, F.abs(gap))
    from_a = F.when(gap > 0, first).otherwise(0) + F.floor(rest / 2)
    from_b = F.when(gap > 0, 0).otherwise(first) + F.ceil(rest / 2)
    return F.slice(a, 1, (F.size(a) - from_a).cast("int")), F.slice(b, 1, (F.size(b) - from_b).cast("int"))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def subsets(items: Column) -> Column:
    """All non-empty subsets of a short array, by bit mask."""
    return F.transform(F.sequence(F.lit(1), (F.pow(F.lit(2), F.size(items)) - 1).cast("int")), lambda m: F.filter(items, lambda x, i: (F.floor(m / F.pow(F.lit(2), i)) % 2) == 1))


def majority_rank(values: Column) -> Column:
    """The value that more than half of the entries reach or exceed (the commit rule of a quorum)."""
    ordered = F.sort_array(values, asc=False)
    return F.element_at(ordered, (F.floor(F.size(values) / 2) + 1).cast("int"))


def bellman_target(reward: Column, best_next: Column, terminal: Column, discount: float = 0.99) -> Column:
    return reward + F.when(terminal, F.lit(0.0)).otherwise(discount * best_next)


def decided(probability: Column, least: float) -> Column:
    return (probability > least).cast("int")


def author_of(file_name: Column, special: str | None = None) -> Column:
    """The author from a file name: `special` where the name starts with it, else what precedes the first dot, less two characters."""
    stem = F.substring_index(file_name, ".", 1)
    cut = F.substring(stem, F.lit(1), F.greatest(F.length(stem) - 2, F.lit(0)))
    return F.when(file_name.startswith(special), F.lit(special)).otherwise(cut) if special else cut


def document_of(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.(txt|TXT)\.segmented$", "")
