"""The training-data operators: defined edge cases, and brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tarnstone.llm import bpe_chunks, entropy_difference, extendible, host_reputation, line_templates, minhash_forest, packing, phrase_fingerprints, quality_forest, queries, rank_profiles
from tarnstone.llm.graph import components

PROSE = "the cat sat on the mat and the dog ran over a hill to see what the bird had done with all of its seeds today"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score string, kept string, h string, depth int"
RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def odd_rows():
    long = " ".join(f"{w}{i % 97}" for i in range(4000) for w in ("alpha", "beta"))
    texts = [(1, PROSE), (1, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (None, PROSE + " x"), (None, None), (6, long), (7, "!!! 123"), (8, "\u65e5\u672c\u8a9e \u0301 \U0001f600"), (9, "one"), (10, PROSE + " and one more")]
    return [(i, t, "en" if i != 2 else None, None, None, "r", "s", "k", "h", 1) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (None, 1, 0), (9, 0, 0), (10, 1, 0), (6, None, 0)], "doc_id bigint, quality int, toxic int")


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


EVERY = {
    "op2": lambda d, l: phrase_fingerprints.compare_edited(d),
    "op3": lambda d, l: bpe_chunks.encode_documents(d, RANKS, public_tokenizers.PATTERN),
    "op4": lambda d, l: quality_forest.quality_rules(d, l),
    "op5": lambda d, l: entropy_difference.score(d, l),
    "op6": lambda d, l: line_templates.drop_lines(d),
    "op8": lambda d, l: minhash_forest.jaccard_groups(d),
    "op9": lambda d, l: rank_profiles.identify(d, rank_profiles.fit(d)),
    "op10": lambda d, l: extendible.shard(d, 1000),
}


@pytest.mark.parametrize("name", EVERY)
def test_one_row_for_each_row(odd, labels, name):
    assert ids(EVERY[name](odd, labels).collect()) == ids(odd.collect())


@pytest.mark.parametrize("name", [*EVERY, "op7"])
def test_empty_tables(odd, labels, name):
    run = EVERY.get(name) or (lambda d, l: packing.pack(d, WORDS))
    assert run(odd.where("false"), labels.where("false")).collect() == []


def test_hosts(spark, labels):
    rows = [(1, "HTTPS://A.Example.COM/en/x?q#f"), (2, None), (3, "no scheme"), (4, "http://x.net/de/8"), (5, "http://example.net/de/80"), (6, "a://b://c/d"), (6, "a://b://c/d"), (7, "http://\u00c4X.org?/es/"), (8, "http://example.com/en/77"), (9, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS upper")
    none = spark.createDataFrame([], "host string, good int")
    got = sorted(tuple(r)[:5] for r in host_reputation.filter_urls(pages, none, queries.URL_RULES).collect())
    assert got == [
        (1, "a.example.com", "/en/x", "com/en/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "x.net", "/de/8", "net/de/", "allow"),
        (5, "example.net", "/de/80", "example.net/de/8", "block"), (6, "b:", "//c/d", None, "allow"), (6, "b:", "//c/d", None, "allow"), (7, "\u00c4x.org", "", None, "allow"),
        (8, "example.com", "/en/77", "example.com/en/7", "allow"), (9, "", "", None, "allow"),
    ]
    seen = spark.createDataFrame([("bad.x.org", 0)] * 60 + [("good.x.org", 1)] * 60 + [(None, 1), ("good.x.org", None)], "host string, good int")
    got = {r["host"]: r["verdict"] for r in host_reputation.filter_urls(spark.createDataFrame([(1, "u://bad.x.org/"), (2, "u://good.x.org/"), (3, "u://new.org/")], "page_id bigint, url string"), seen).collect()}
    assert got == {"bad.x.org": "block", "good.x.org": "allow", "new.org": "allow"}
    assert host_reputation.filter_urls(pages.where("false"), none).collect() == []


def test_every_level_decides(spark):
    seen = [("bad.one.org", 0)] * 40 + [("fine.one.org", 1)] * 40 + [(f"h{k}.two.net", 0) for k in range(60)] + [(f"d{k}.co.uk", 0) for k in range(80)] + [(f"g{k}.com", 1) for k in range(80)]
    outcomes = spark.createDataFrame(seen, "host string, good int")
    asked = ["bad.one.org", "fine.one.org", "new.two.net", "x.new.co.uk", "new.com", "new.xyz"]
    pages = spark.createDataFrame([(k, f"http://{h}/" + "p" * 9000) for k, h in enumerate(asked)], "found int, url string").selectExpr("*", "1 AS pages", "2 AS fits")
    for bound in ("upper", "lower"):
        got = host_reputation.filter_urls(pages, outcomes, keep=("found", "pages", "fits"), bound=bound).collect()
        assert {r["host"]: r["verdict"] for r in got} == dict(zip(asked, ["block", "allow", "block", "block", "allow", "allow"]))
        assert {(r["pages"], r["fits"]) for r in got} == {(1, 2)}
    levels = host_reputation.reputations(outcomes)
    assert {r["key"] for r in levels["suffix"].collect()} == {"org", "net", "co.uk", "com"} and levels["domain"].where("key = 'two.net'").first()["n"] == 60
    table = host_reputation.suffix_table(spark, ["two.net", "a.b.c"])
    own = host_reputation.with_levels(spark.createDataFrame([("h1.two.net",), ("z.y.a.b.c",), ("c",), ("",), ("two.net",)], "host string"), table)
    assert {r["host"]: (r["domain"], r["suffix"]) for r in own.collect()} == {"h1.two.net": ("h1.two.net", "two.net"), "z.y.a.b.c": ("y.a.b.c", "a.b.c"), "c": ("c", "c"), "": ("", ""), "two.net": ("two.net", "two.net")}


def test_edited_texts(odd):
    rows = sorted([(-(r[0] or 0) if r[0] is not None else 10**9, r[0], r[1] or "") for r in odd_rows()], key=lambda r: r[0])
    got = phrase_fingerprints.compare_edited(odd).collect()
    assert {(r["doc_id"], r["n_chars"]) for r in got} == {(i, len(t)) for _, i, t in rows}
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    for (_, i, t), (_, _, n) in zip(rows, rows[1:]):
        if i in (10, 9, 8, 7, 5, 4, 3) and i != 3:
            half = len(t) // 2
            assert by_id[i][0]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
    assert by_id[1][0]["fingerprint"] == by_id[2][0]["fingerprint"] and all(0 <= r["near_edited"] <= 1 for r in got)


def test_equal_substrings_share_phrases():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    own, moved = phrase_fingerprints.phrases(text), phrase_fingerprints.phrases("zz qq" + text)
    assert len(np.intersect1d(own, moved)) > 0.97 * len(np.unique(own))


def test_bpe_equals_the_whole(odd):
    small = bpe_chunks.ChunkedBpe(RANKS, public_tokenizers.PATTERN, chunk=150, overlap=40)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(rng.choice(["ab  \n's\u00e91", "a", "  ", "it's don't 12 ", "\u65e5\u672c a"])) for _ in range(rng.randint(0, 900)))
        assert small.encode(text) == small.engine.encode_ordinary(text) and small.decode(small.encode(text)) == text.encode()
    encoded = bpe_chunks.encode_documents(odd, RANKS, public_tokenizers.PATTERN, ids=True)
    assert sorted(r["text"] for r in bpe_chunks.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()) == sorted(r[1] or "" for r in odd_rows())


def test_forest_by_a_plain_version():
    rng = np.random.default_rng(1)
    rows = np.round(rng.normal(size=(400, 5)), 1)
    rows[:200, 2] = 0
    forest = quality_forest.IsolationForest(rows, trees=20, rows=64)

    def path(x, at, depth):
        if forest.left[at] == at:
            return forest.length[at], depth
        return path(x, int((forest.left if x[forest.feature[at]] <= forest.cut[at] else forest.right)[at]), depth + 1)

    for x, got in zip(rows[::7], forest.score(rows[::7])):
        found = [path(x, root, 0) for root in forest.roots]
        assert all(d <= length for length, d in found)
        mean = sum(length for length, _ in found) / len(found)
        harmonic = sum(1 / k for k in range(1, 64))
        assert abs(got - 2 ** (-mean / (2 * harmonic - 2 * 63 / 64))) < 2e-3  # c(64) by its definition
    far = np.concatenate([rows, [[50, 50, 50, 50, 50]]])
    assert forest.score(far).argmax() == 400


def test_threshold_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        scores, good = np.round(rng.random(60), 2), rng.random(60) < 0.7
        cut = quality_forest.calibrate(scores, good, 0.05)
        judge = lambda c: ((scores[~good] > c).mean() if (~good).any() else 0) - (scores[good] > c).mean()
        allowed = [c for c in scores if (scores[good] > c).mean() <= 0.05]
        assert cut in allowed and abs(judge(cut) - max(map(judge, allowed))) < 1e-12


def test_sample_is_the_lowest_hashes_at_every_size(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    want = sorted((r["h"], r["id"]) for r in rows.collect())
    for most in (10, 300, 2400, 9000):
        assert [(r["h"], r["id"]) for r in quality_forest._lowest(rows, [F.col("h"), F.col("id")], most).collect()] == want[:most]


def test_forest_and_threshold_cover_every_row(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(["a#", "bcd", "Efghij!", "k\n", "lmnopqrst"], int(rng.integers(15, 90)), p=rng.dirichlet([1.0] * 5)))) for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(0, 300, 2)], "doc_id bigint, quality int")
    counts = quality_forest.text_counts([t for _, t in docs])
    x, failed = quality_forest.features(counts), quality_forest.base_failures(counts)
    plain = quality_forest.IsolationForest(x[~failed], trees=5, rows=16)
    told = ~failed & (np.arange(300) % 2 == 0)
    want = quality_forest.calibrate(plain.score(x[told]), np.arange(300)[told] % 3 > 0, 0.1)
    got = quality_forest.quality_rules(table.repartition(5), labels, trees=5, tree_rows=16, max_clean_loss=0.1).orderBy("doc_id").collect()
    assert 100 < len(np.unique(x[~failed], axis=0)) and [r["score"] for r in got] == plain.score(x).tolist()
    assert {r["threshold"] for r in got} == {want}
    for root in plain.roots:  # a leaf's length counts all the rows that end there
        leaf = plain._leaf(x[~failed], root)
        for at, n in zip(*np.unique(leaf, return_counts=True)):
            depth = int(round(plain.length[at] - float(quality_forest._mean_path(n * 16 / (~failed).sum()))))
            assert 0 < depth <= 4 and abs(plain.length[at] - depth - float(quality_forest._mean_path(n * 16 / (~failed).sum()))) < 1e-9


def test_threshold_heeds_labels_of_every_row(spark):
    from pyspark.sql import functions as F

    # one good row in a hundred is odd, exactly; a sample of the 200,000 labelled ones has some more or some fewer
    values = {"n_words": 100, "word_chars": 500, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "n_lines": 9, "n_upper": 10, "n_marks": 0, "n_distinct": 60}
    odd = (F.col("doc_id") % 100 == 0) | (F.col("doc_id") >= 200_000)
    stats = spark.range(200_100).select(F.col("id").alias("doc_id"), *(F.lit(v).cast("bigint").alias(c) for c, v in values.items()))
    stats = stats.withColumn("n_symbols", F.when(odd, 200).otherwise(0).cast("bigint"))
    labels = stats.select("doc_id", (F.col("doc_id") < 200_000).cast("int").alias("quality"))
    for most, goes in ((0.01 + 1e-7, True), (0.01 - 1e-7, False)):
        forest, threshold = quality_forest.fit(stats, labels, trees=20, max_clean_loss=most)
        common, strange = (forest.score(quality_forest.features({c: np.array([v]) for c, v in (values | {"n_symbols": n}).items()}))[0] for n in (0, 200))
        assert common <= threshold and (strange > threshold) == goes


def test_texts_of_many_chunks_and_stretches(spark, monkeypatch):
    rng = random.Random(8)
    mixed = "".join(rng.choice(["word", " ", "  \n", "it's ", "\u00e9t\u00e9 ", "12", "3456 ", "\u65e5\u672c", "!? ", "\U0001f600"]) for _ in range(9000))
    texts = [(1, mixed), (1, mixed), (None, mixed[::-1]), (2, "1" * 9000), (3, " " * 5000 + "x"), (4, "a" * 7000), (5, "short"), (6, None), (7, mixed[:3000])]
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    coder = bpe_chunks.chunked_bpe(RANKS, public_tokenizers.PATTERN)
    want = sorted((str(i), coder.engine.encode_ordinary(t or "")) for i, t in texts)
    for chunk, stretch, margin in ((1 << 13, 1 << 20, 1 << 13), (200, 1 << 20, 100), (200, 3000, 400), (1 << 13, 2000, 50)):
        monkeypatch.setattr(bpe_chunks, "MARGIN", margin)
        monkeypatch.setattr(bpe_chunks.ChunkedBpe.__init__, "__defaults__", (chunk, 40, 250_000))
        small = bpe_chunks.ChunkedBpe(RANKS, public_tokenizers.PATTERN)
        assert all(small.encode(t) == coder.engine.encode_ordinary(t or "") for _, t in texts)
        got = bpe_chunks.encode_documents(docs, RANKS, public_tokenizers.PATTERN, ids=True, stretch=stretch).collect()
        assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
        for r in got:
            assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(coder.engine.decode_bytes(r["ids"])).hexdigest()


def test_counts_by_brute_force():
    rng = random.Random(7)
    texts = [None, "", " \x0b\x1c "] + [" ".join(rng.choice(["a", "b", "c#", "d\n", "\u00e9|"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    got = quality_forest.text_counts(texts)
    for k, t in enumerate(texts):
        import re

        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(got[c][k]) for c in quality_forest.COUNTS[:5]) == want


def test_forest_isolates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    forest = quality_forest.IsolationForest(x)
    assert forest.score(np.full((1, 3), 9.0))[0] > np.quantile(forest.score(x), 0.99)
    assert quality_forest.calibrate(np.array([0.1, 0.2, 0.9, 0.8]), np.array([True, True, False, False]), 0.0) == 0.2


def test_entropy_by_brute_force(spark):
    docs = spark.createDataFrame([(1, "abab"), (2, "abc"), (3, "Xyz"), (4, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    texts = {1: "abab", 2: "abc", 3: "xyz"}

    def model(chosen):
        tri, ctx, one = Counter(), Counter(), Counter()
        for t in chosen:
            p = "\0\0" + t
            for i in range(len(t)):
                tri[p[i : i + 3]] += 1
                ctx[p[i : i + 2]] += 1
                one[t[i]] += 1
        v = len(set("".join(texts.values())))
        n = sum(one.values())
        return lambda g: -np.log((tri[g] + 20.0 * (one[g[2]] + 1) / (n + v)) / (ctx[g[:2]] + 20.0))

    target, background = model(["abab"]), model(texts.values())
    for head in (100, 2):
        got = {r["doc_id"]: r["ce_diff"] for r in entropy_difference.score(docs, labels, head=head).collect()}
        assert got[4] is None
        for i, t in texts.items():
            p = "\0\0" + t
            want = np.mean([target(p[k : k + 3]) - background(p[k : k + 3]) for k in range(len(t))])
            assert abs(got[i] - want) < 1e-8


def test_lines(spark):
    line = "please sign the form with number {} before the end of the working day {}"
    base = [(i, f"{name} wrote about {name} at length {chr(97 + i)} here\n" + line.format(i * 7, name)) for i, name in enumerate(["anna", "bob", "carl", "dora"])]
    rows = spark.createDataFrame([*base, (9, "shared"), (10, "shared"), (11, "shared"), (None, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_templates.drop_lines(rows).collect()}
    assert got[0]["text"] == base[0][1] and [got[i]["n_dropped"] for i in (0, 1, 2, 3, 9, 10, 11)] == [0, 1, 1, 1, 0, 0, 0]
    assert got[2]["text"] == base[2][1].split("\n")[0] and got[None]["text"] is None and got[None]["n_lines"] == 0


def dropped(rows):
    return {r["doc_id"]: r["n_dropped"] for r in line_templates.drop_lines(rows).collect()}


def test_all_tokens_of_long_lines_count(spark):
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    kept = {i * 319 // 31 for i in range(32)}
    apart = [" ".join(word(i) if i in kept or i < 3 else word(1000 * (d + 1) + i) for i in range(320)) for d in range(4)]
    assert set(dropped(spark.createDataFrame(list(enumerate(apart)), "doc_id bigint, text string")).values()) == {0}
    alike = [" ".join(f"other{word(d)}" if i == 100 else word(i) for i in range(320)) for d in range(4)]
    assert dropped(spark.createDataFrame(list(enumerate(alike)), "doc_id bigint, text string")) == {0: 0, 1: 1, 2: 1, 3: 1}


def test_documents_are_counted_not_lines(spark):
    line = "the order of customer {} has left our store this morning"
    rows = [(0, "\n".join(map(line.format, ("ann", "bob", "carl")))), (1, line.format("dora"))]
    assert dropped(spark.createDataFrame(rows, "doc_id bigint, text string")) == {0: 0, 1: 0}
    assert dropped(spark.createDataFrame([*rows, (2, line.format("emil"))], "doc_id bigint, text string")) == {0: 0, 1: 1, 2: 1}
    long = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50))
    assert dropped(spark.createDataFrame([(0, long), (1, long), (2, long[:-4]), (3, long[:-4])], "doc_id bigint, text string")) == {0: 0, 1: 1, 2: 0, 3: 0}


def test_unrelated_lines_change_nothing(spark, monkeypatch):
    name = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    texts = [f"dear customer named {name(k)} of {name(59 - k)} your order has left our store today" for k in range(60)]
    lone = [f"dear customer named {' '.join(name(k + 60 * j) for j in range(1, 11))}" for k in range(10)]
    monkeypatch.setattr(line_templates, "MOST_HEADS", 7)
    for heads in (1000, 3, 20):
        monkeypatch.setattr(line_templates.templates, "__defaults__", (heads,))
        assert dropped(spark.createDataFrame(list(enumerate(texts + lone)), "doc_id bigint, text string")) == {k: int(0 < k < 60) for k in range(70)}
    assert dropped(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")) == {k: int(0 < k) for k in range(60)}


def plain_templates(lines, similarity=0.7):
    founders, out = [], {}
    for exact, tokens in lines:
        for name, own in founders:
            if sum(a == b != 0 for a, b in zip(own, tokens)) >= similarity * len(tokens) - 1e-9:
                out[exact] = name
                break
        else:
            founders.append((exact, tokens))
            out[exact] = exact
    return out


def test_rounds_give_a_sequential_parse(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for leaf, (n, size) in enumerate([(9, 40), (30, 25), (12, 1), (100, 12), (8, 60)]):
        base = rng.integers(1, 9, (4, n))
        lines = np.where(rng.random((size, n)) < 0.25, rng.integers(0, 9, (size, n)), base[rng.integers(0, 4, size)]).astype("<u4")
        own = sorted((int(d), 1000 * leaf + k, x) for k, (d, x) in enumerate(zip(rng.integers(1, 5, size), lines)))
        own.sort(key=lambda r: (-r[0], r[1]))
        rows += [(leaf, exact, d, bytearray(x.tobytes())) for d, exact, x in own]
        want |= plain_templates([(exact, x.tolist()) for _, exact, x in own])
    pool = spark.createDataFrame(rows, "leaf bigint, exact bigint, docs bigint, tokens binary").repartition(3)
    for heads in (1000, 4, 1):
        assert {r["exact"]: r["template"] for r in line_templates.templates(pool, 0.7, heads).collect()} == want


def test_kept_columns_may_have_any_name(spark):
    rows = spark.createDataFrame([("a", "one two three four five", 1, 2, 3)] * 2 + [("b", "one two three four five", 1, 2, 3), ("c", "one two three four five", 1, 2, 3)], "doc_id string, text string, row int, gone int, n_lines int")
    got = sorted(map(tuple, line_templates.drop_lines(rows, keep=("row", "gone", "n_lines")).collect()))
    assert got == [("a", 1, 2, "one two three four five", 1, 0, 0)] * 2 + [("b", 1, 2, "", 1, 1, 23), ("c", 1, 2, "", 1, 1, 23)]


def test_difference_and_plan():
    assert sorted(np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    rng = random.Random(2)
    for lengths in ([1], [4096], [5000, 3, 1], [rng.randint(1, 9000) for _ in range(60)], [1] * 500):
        rows, over = packing.plan(lengths)
        assert over == []
        for d, n in enumerate(lengths):
            mine = sorted((s, k) for i, s, k, _, _ in rows if i == d)
            assert sum(k for _, k in mine) == n and all(a + k == b for (a, k), (b, _) in zip(mine, mine[1:])) and mine[0][0] == 0
        fill = defaultdict(list)
        for _, _, k, w, o in rows:
            fill[w].append((o, k))
        for parts in fill.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:])) and sum(k for _, k in parts) <= 4096


def test_lots_carry_their_rest_and_pad_little():
    rng = np.random.default_rng(3)
    for mean in (300, 2500, 3900):
        lengths = np.clip(rng.lognormal(np.log(mean), 0.9, 900).astype(int), 1, 30000).tolist()
        rows, over = packing.plan(lengths, last=False)
        laid, fill = Counter(), Counter()
        for d, _, n, w, _ in rows:
            laid[d] += n
            fill[w] += n
        assert all(laid[d] + sum(n - s for e, s in over if e == d) == n for d, n in enumerate(lengths))
        assert sum(n - s for d, s in over for n in [lengths[d]]) < 2 * packing.CAPACITY + 16 * len(fill)
        assert sum(fill.values()) > 0.97 * packing.CAPACITY * len(fill)
        last = Counter()
        for _, _, n, w, _ in packing.plan(lengths)[0]:
            last[w] += n
        assert sum(n < 256 for n in last.values()) <= 1 and min(fill.values()) >= 256


def test_packed_ids(odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    want = Counter()
    for r in odd_rows():
        want[r[0], zlib.crc32(np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())] += 1
    parts = defaultdict(list)
    for r in packing.pack(odd.where("doc_id in (3, 4, 5, 6, 7, 8, 9, 10)"), WORDS, ids=True).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        parts[r["doc_id"]].append((r["start"], r["ids"]))
    for i, p in parts.items():
        assert want[i, zlib.crc32(np.array([x for _, part in sorted(p) for x in part], "<u4").tobytes())] == 1
    encoder = packing.WordBpe(WORDS)
    for t in ["a\x85b", "a\x1cb", "na\u00efve CAF\u00c9 e\u0301", "\u0130stanbul \u03a3\u0391\u03a3", "<|endoftext|> hi", "\x00 a\x00b", "a</w>b", "it's WE'LL 12.5%!!"]:
        assert encoder.encode(t, None).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_groups_by_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    sets = [minhash_forest.shingles(t) for t in texts]
    alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    links = {i: [j for j in range(len(texts)) if j != i and alike(sets[i], sets[j])] for i, _ in rows}
    got = {r["doc_id"]: r for r in minhash_forest.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: got[i]["n_links"] for i, _ in rows} == {i: len(v) for i, v in links.items()}
    seen = {}
    for i, _ in rows:
        stack = [i] if i not in seen else []
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = i
                stack += links[x]
    assert {i: got[i]["class_id"] for i, _ in rows} == seen
    assert minhash_forest.meeting(0.8, minhash_forest.prefix_length(), minhash_forest.TREES) >= 0.999


def test_blocks_and_parts_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(40, 60):  # about 0.75 alike: they meet, but few are linked
        w = list(base)
        for k in (2, 60, 110):
            w[k + rng.randrange(-2, 3)] = f"y{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    run = lambda: {r["doc_id"]: (r["class_id"], r["n_links"]) for r in minhash_forest.jaccard_groups(df).collect()}
    whole = run()
    sets = {i: set(minhash_forest.shingles(t).tolist()) for i, t in rows}
    links = {i: sum(len(s & o) >= 0.8 * len(s | o) for j, o in sets.items() if j != i) for i, s in sets.items()}
    assert {i: n for i, (_, n) in whole.items()} == links and len({c for i, (c, _) in whole.items() if i < 40}) == 1
    for name, value in (("BLOCK_ROWS", 7), ("PART_PAIRS", 3)):
        monkeypatch.setattr(minhash_forest, name, value)
        assert run() == whole


def test_work_grows_with_a_group_not_its_square(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    tried = []
    monkeypatch.setattr(minhash_forest, "verify", lambda pairs, *rest, real=minhash_forest.verify: tried.append(pairs.count()) or real(pairs, *rest))
    for size in (100, 400):
        rows = []
        for i in range(size):
            w = list(base)
            w[rng.randrange(150)] = f"x{i}"
            rows.append((i, " ".join(w)))
        tried.clear()
        got = minhash_forest.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), count_links=False)
        assert {(r["class_id"], r["n_links"]) for r in got.collect()} == {(0, None)}
        assert sum(tried) <= 6 * size


def test_recall_of_a_query_set_against_all_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: set(minhash_forest.shingles(r["text"]).tolist()) for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in minhash_forest.jaccard_groups(docs).collect()}
    found = wanted = 0
    for i in sets:
        if i % 100 == 0:
            near = [j for j, s in sets.items() if j != i and s and len(s & sets[i]) >= 0.8 * len(s | sets[i])]
            wanted += len(near)
            found += min(got[i][1], len(near))
            assert got[i][1] <= len(near)
            if got[i][1] == len(near):
                assert {got[j][0] for j in near} <= {got[i][0]}
    assert found >= 0.99 * wanted


def test_one_of_each_with_clashing_columns(spark):
    rows = [(2, PROSE, 1, 2, "a"), (1, PROSE, 3, 4, "b"), (1, PROSE, 3, 4, "b"), (5, None, 5, 6, "c"), (5, None, 5, 6, "c"), (6, "", 7, 8, "d"), (None, PROSE, 9, 9, "e")]
    df = spark.createDataFrame(rows, "doc_id int, text string, _row int, row int, `group` string")
    assert sorted(map(tuple, minhash_forest.one_of_each(df).collect())) == [(1, PROSE, 3, 4, "b"), (5, None, 5, 6, "c"), (6, "", 7, 8, "d")]
    assert minhash_forest.one_of_each(df.where("false")).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_languages(spark):
    de = "der hund und die katze gehen \u00fcber die stra\u00dfe und sehen viele v\u00f6gel in den b\u00e4umen"
    rows = spark.createDataFrame([(i, t, l) for i in range(8) for t, l in ((PROSE, "en"), (de, "de"))], "doc_id bigint, text string, lang string")
    profiles = rank_profiles.fit(rows)
    m = rank_profiles.Matcher(profiles)
    assert m.predict("the dog and the bird")[0] == "en" and m.predict("die v\u00f6gel und der hund")[0] == "de"
    assert m.predict(None) == m.predict("12 !!") == ("und", 0.0)
    assert rank_profiles.fit(rows.where("false")) == {}
    from pyspark.sql import functions as F

    for r in rows.select("doc_id", rank_profiles.held_out(F.col("doc_id")).alias("h")).collect():
        assert r["h"] == rank_profiles.crc_held_out(r["doc_id"])


def test_shards_fit(spark):
    rows = [(i, "x" * (i % 50 + 1)) for i in range(800)] + [(5000, "y" * 900)] + [(7, "z" * 100)] * 30
    got = extendible.shard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), 500).collect()
    sums, counts = Counter(), Counter()
    for r in got:
        sums[r["depth"], r["prefix"], r["overflow"]] += r["bytes"]
        counts[r["depth"], r["prefix"], r["overflow"]] += 1
    assert len(got) == len(rows) and all(b <= 500 or counts[k] == 1 for k, b in sums.items())
    prefixes = {(d, p) for d, p, _ in sums}
    assert not any((e, p >> (d - e)) in prefixes for d, p in prefixes for e in range(d))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "language", "lines", "near_duplicates", "packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = quality_forest.quality_rules(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).where("kept")
    stage = corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.001")
    assert stage.columns == list(corpus_pipeline.COLUMNS) and ids(stage.collect()) == ids(kept.collect())
    single = corpus_pipeline.near_duplicates(spark, docs, None)
    groups = minhash_forest.jaccard_groups(docs)
    assert single.count() == groups.select("group").distinct().count()
