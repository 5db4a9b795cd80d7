"""Word pieces, longest-match segmentation, rule lemmas, chart parsing."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .preparation import dense

CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2CEAF}\x{2F800}-\x{2FA1F}]"


def is_cjk(column):
    return column.rlike(CJK)


def is_blank(column):
    """Only white space, of any script, or nothing."""
    return column.rlike(r"^[\s\p{Zs}]*$")


def is_control(column):
    return column.rlike(r"^[\p{Cc}\p{Cf}&&[^\t\n\r]]+$")


def is_punctuation(column):
    """Only marks: the ASCII ones that are no letters, digits or blanks, and Unicode punctuation."""
    return column.rlike(r"^[\p{P}!-/:-@\[-`{-~]+$")


def acceptable(column):
    """Input that the segmenter takes: no ASCII letters or digits, none of `,.!?`."""
    return ~column.rlike(r"[A-Za-z0-9,.!?]")


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


@cache
def _classes(most: int) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Patterns of accents, of characters that go, and of tokens in texts of characters up to `most`, made once a process.

    Up to 0xFFFF a pattern looks a character up; beyond, it goes through a list of ranges.
    """
    accents, gone, alone, blank = [], [], [], [ord(c) for c in " \t\n\r"]
    for n, kind in enumerate(map(unicodedata.category, map(chr, range(most + 1)))):
        if n >= 128 and kind[0] not in "PZ" and kind not in ("Mn", "Cc", "Cf") and n != 0xFFFD and not 0x3400 <= n <= 0x2FA1F:
            continue
        c = chr(n)
        if kind == "Mn":
            accents.append(n)
        if kind[0] == "P" or (c.isascii() and not c.isalnum() and not c.isspace() and c.isprintable()) or _ideograph(n):
            alone.append(n)
        elif kind == "Zs":
            blank.append(n)
        elif (kind in ("Cc", "Cf") and c not in "\t\n\r") or n in (0, 0xFFFD):
            gone.append(n)

    def ranges(points: list[int]) -> str:
        points, out = sorted(set(points)), []
        for n in points:
            if out and out[-1][1] == n - 1:
                out[-1][1] = n
            else:
                out.append([n, n])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    return re.compile(f"[{ranges(accents)}]+" if accents else r"[^\s\S]"), re.compile(f"[{ranges(gone)}]+"), re.compile(f"[{ranges(alone)}]|[^{ranges(alone + blank)}]+")


def basic_split(text: str, lower: bool = True) -> list[str]:
    """Cleaned text split at blanks, marks and ideographs; lower-cased without accents if `lower`."""
    text = text.lower() if lower else text
    if lower and not text.isascii():
        text = unicodedata.normalize("NFD", text)
    accents, gone, token = _classes(0x7F if text.isascii() else sys.maxunicode if _BEYOND.search(text) else 0xFFFF)
    if lower and not text.isascii():
        text = accents.sub("", text)
    return token.findall(gone.sub("", text))


def _ideograph(c: int) -> bool:
    return any(a <= c <= b for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2CEAF), (0x2F800, 0x2FA1F)))


def pieces(word: str, vocabulary: set[str], unknown: str = "[UNK]", most: int = 200, longest: int | None = None) -> list[str]:
    """Greedy longest prefixes from the vocabulary, inner ones marked `##`; unknown if any rest has none.

    `longest` is the length of the vocabulary's longest entry, if known.
    """
    if len(word) > most:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        size = next((n for n in range(min(len(word) - at, longest or len(word)), 0, -1) if mark + word[at : at + n] in vocabulary), 0)
        if not size:
            return [unknown]
        out.append(mark + word[at : at + size])
        at += size
    return out


def longest_match(text: str, words: set[str], longest: int) -> list[str]:
    """Forward longest match by characters; what no word fits stands alone."""
    return _longest_match(text, words, _by_first(words, longest))


def _by_first(words: set[str], longest: int) -> dict[str, list[int]]:
    """Of each first character the lengths of words, longest first, without single characters."""
    found = {}
    for w in words:
        if 1 < len(w) <= longest:
            found.setdefault(w[0], set()).add(len(w))
    return {c: sorted(sizes, reverse=True) for c, sizes in found.items()}


def _longest_match(text: str, words: set[str], sizes: dict[str, list[int]]) -> list[str]:
    out, at = [], 0
    while at < len(text):
        size = 1
        for n in sizes.get(text[at], ()):
            if text[at : at + n] in words and at + n <= len(text):
                size = n
                break
        out.append(text[at : at + size])
        at += size
    return out


def _token_udf(make, joint: str | None = None):
    """Tokens of texts, as arrays or joined; a text's tokens are let go before the next text's are made."""

    @F.pandas_udf("array<string>" if joint is None else "string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else make(x) if joint is None else joint.join(make(x)))

    return run


def basic_tokens(rows: DataFrame, text: str = "text", lower: bool = True, joint: str | None = None) -> DataFrame:
    """Add `tokens`, an array, or a string with `joint` between the tokens."""
    return rows.withColumn("tokens", _token_udf(lambda t: basic_split(t, lower), joint)(text))


def word_pieces(rows: DataFrame, vocabulary: set[str], text: str = "text", lower: bool = True, joint: str | None = None) -> DataFrame:
    """Add `tokens` (see `basic_tokens`); the vocabulary is a parameter of fixed size and travels with the function.

    The pieces of the last 65,536 different words are at hand in each process.
    """
    longest = max(map(len, vocabulary), default=0)

    def make():
        known = lru_cache(1 << 16)(lambda w: pieces(w, vocabulary, longest=longest))
        return lambda t: [p for w in basic_split(t, lower) for p in known(w)]

    return rows.withColumn("tokens", _token_udf(_made_once(make), joint)(text))


def _made_once(make):
    """A function that is made where it is first called."""
    made = []

    def run(x):
        if not made:
            made.append(make())
        return made[0](x)

    return run


def segmented(rows: DataFrame, words: set[str], text: str = "text", joint: str | None = None) -> DataFrame:
    """Add `tokens`, see `basic_tokens`."""
    sizes = _by_first(words, max(map(len, words), default=1))
    return rows.withColumn("tokens", _token_udf(lambda t: _longest_match(t, words, sizes), joint)(text))


def token_ids(rows: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """(token, id): ids from 0 by first appearance (lowest key, then position)."""
    seen = rows.select(key, F.posexplode(tokens).alias("at", "token")).groupBy("token").agg(F.min(F.struct(key, "at")).alias("first"))
    return dense(seen.select("token", "first.*"), key, "at").select("token", F.col("id").cast("int").alias("id"))


def looked_up(rows: DataFrame, vocabulary: DataFrame, token: str = "token", unknown: int = -1) -> DataFrame:
    """Add `id` from a vocabulary (token, id), `unknown` for tokens that it lacks, to rows of one token each."""
    named = vocabulary.select(F.col("token").alias(token), "id")
    return rows.join(named, token, "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def spelled(rows: DataFrame, vocabulary: DataFrame, token: str = "token", unknown: str = "[UNK]") -> DataFrame:
    """Add the token of each `id`, `unknown` for ids that the vocabulary lacks."""
    named = vocabulary.select("id", F.col("token").alias(token))
    return rows.join(named, "id", "left").withColumn(token, F.coalesce(token, F.lit(unknown)))


#: Ending, what replaces it, in order of trial; `=` stands for a doubled consonant to be halved.
ENDINGS = (
    ("ies", "y"), ("ves", "fe"), ("ves", "f"), ("es", ""), ("s", ""), ("ied", "y"), ("ed", ""), ("ed", "e"), ("ed", "="),
    ("ying", "ie"), ("ing", "e"), ("ing", ""), ("ing", "="),
)


def lemmas(words: DataFrame, dictionary: DataFrame, irregular: DataFrame | None = None, word: str = "word") -> DataFrame:
    """(word, lemma): the word itself if listed, else an irregular form's lemma, else the first ending rule whose result is listed.

    Words without a lemma stay, with null. Candidates are rows, so the dictionary is an equi join of any size.
    """
    w = F.col("word")
    own = words.select(F.col(word).alias("word")).distinct()
    tries = [F.struct(F.lit(0).alias("order"), w.alias("lemma"))]
    for i, (ending, put) in enumerate(ENDINGS):
        stem = F.expr(f"substring(word, 1, length(word) - {len(ending)})")
        doubled = F.expr(f"substring(word, length(word) - {len(ending)}, 1) = substring(word, length(word) - {len(ending) + 1}, 1)")
        made = F.when(doubled, F.expr(f"substring(word, 1, length(word) - {len(ending) + 1})")) if put == "=" else F.concat(stem, F.lit(put))
        tries.append(F.struct(F.lit(2 + i).alias("order"), F.when(w.endswith(ending) & (F.length(w) > len(ending)), made).alias("lemma")))
    found = own.select("word", F.explode(F.array(*tries)).alias("t")).select("word", "t.order", "t.lemma").where("lemma is not null")
    found = found.join(dictionary.select(F.col(dictionary.columns[0]).alias("lemma")).distinct(), "lemma", "left_semi").select("word", "order", "lemma")
    if irregular is not None:
        known = irregular.select(F.col(irregular.columns[1]).alias("word"), F.lit(1).alias("order"), F.col(irregular.columns[0]).alias("lemma"))
        found = found.unionByName(own.join(known, "word").select("word", "order", "lemma"))
    best = found.groupBy("word").agg(F.min(F.struct("order", "lemma")).alias("b")).select("word", "b.lemma")
    return own.join(best, "word", "left")


def missing_words(words: DataFrame, dictionary: DataFrame, irregular: DataFrame | None = None, word: str = "word") -> DataFrame:
    return lemmas(words, dictionary, irregular, word).where("lemma is null").select("word")


def parse_chart(tags: list[set[str]], rules: list[tuple[str, tuple[str, ...]]], goal: str = "S") -> bool:
    """Whether the goal spans all words; `tags` has the possible parts of speech of each word.

    Bottom-up chart: finished edges start and extend active ones until nothing is new, over all tag choices at once.
    """
    n = len(tags)
    done, active, agenda = set(), set(), [(t, i, i + 1) for i, ts in enumerate(tags) for t in ts]

    def extend(left: str, rest: tuple[str, ...], i: int, j: int):
        agenda.append((left, i, j)) if not rest else active.add((left, rest, i, j))

    while agenda:
        edge = agenda.pop()
        if edge in done:
            continue
        done.add(edge)
        symbol, i, j = edge
        for left, right in rules:
            if right and right[0] == symbol:
                extend(left, right[1:], i, j)
        before = None
        while before != len(active):  # a new active edge may meet what is done already
            before = len(active)
            for left, rest, a, b in list(active):
                for k in [d[2] for d in done if d[0] == rest[0] and d[1] == b]:
                    if len(rest) == 1:
                        if (left, a, k) not in done:
                            agenda.append((left, a, k))
                    else:
                        active.add((left, rest[1:], a, k))
    return n > 0 and (goal, 0, n) in done


def parsed(rows: DataFrame, rules: list[tuple[str, tuple[str, ...]]], tags: str = "tags", goal: str = "S") -> DataFrame:
    """Add `accepted` to rows whose `tags` is an array of arrays of parts of speech."""

    @F.pandas_udf("boolean")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: bool(x is not None and parse_chart([set(t) for t in x], rules, goal)))

    return rows.withColumn("accepted", run(tags))


def uncovered(rules: DataFrame, tags: DataFrame) -> DataFrame:
    """Symbols on right sides that no rule derives and no word has."""
    right = rules.select(F.explode("rhs").alias("symbol")).distinct()
    known = reduce(DataFrame.union, [rules.select("lhs"), tags.select(tags.columns[0])])
    return right.join(known.select(F.col("lhs").alias("symbol")).distinct(), "symbol", "left_anti")
