"""The pipeline against plain Python: each stage after the forest is worked out anew from the rows that the forest kept."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import zlib

import corpus_pipeline
from tarnstone.llm import line_templates, quality_forest

FOLDER = "/root/testdata/sf0.001"


def grams(text):
    chars = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    found = Counter(c for c in chars if c != " ")
    found.update(p for p in map("".join, zip(chars, chars[1:])) if p != "  ")
    found.update(p for p in map("".join, zip(chars, chars[1:], chars[2:])) if p[1] != " ")
    return found


def ranked(counts):
    order = sorted(counts, key=lambda g: (-counts[g], len(g), g))[:300]
    return {g: k for k, g in enumerate(order)}


def languages(rows):
    by_lang = defaultdict(Counter)
    for text, lang in rows.values():
        if text is not None and lang is not None:
            by_lang[lang].update(grams(text))
    profiles = {lang: ranked(c) for lang, c in sorted(by_lang.items())}
    out = {}
    for i, (text, _) in rows.items():
        own = ranked(grams(text or ""))
        if own:
            away = min(sum(abs(p[g] - k) if g in p else 300 for g, k in own.items()) for p in profiles.values())
            if 1 - away / (300 * len(own)) >= corpus_pipeline.LEAST_SCORE:
                out[i] = rows[i]
    return out


def masked(line):
    return ["<*>" if re.search("[0-9]", w) else w for w in re.findall("[^\x20\x09-\x0d]+", line)]


def lines(rows):
    held = defaultdict(set)
    for i, (text, _) in rows.items():
        for line in (text or "").split("\n"):
            if len(words := masked(line)) >= 5:
                held[tuple(words)].add(i)
    leaves = defaultdict(list)
    for w in held:
        leaves[len(w), w[:3] if len(w) >= 8 else w].append(w)
    first = {}
    for (n, _), own in leaves.items():
        own.sort(key=lambda w: (-len(held[w]), line_templates.parse([x.encode() for x in w])[1]))
        groups = []
        for w in own:
            for group in groups:
                if sum(a == b != "<*>" for a, b in zip(group[0], w)) >= 0.7 * n:
                    group.append(w)
                    break
            else:
                groups.append([w])
        for group in groups:
            ids = set().union(*map(held.get, group))
            if len(ids) >= 3:
                first |= dict.fromkeys(group, min(ids))
    out = {}
    for i, (text, lang) in rows.items():
        kept, seen, dropped = [], set(), 0
        for line in (text or "").split("\n"):
            w = tuple(masked(line))
            gone = w in first and (first[w] != i or w in seen)
            seen.add(w)
            dropped += gone
            if not gone:
                kept.append(line)
        after = "\n".join(kept)
        if not dropped or any(map(masked, kept)) and len(after) >= 0.2 * (len(after) + len(text) - len(after) - dropped + (not kept)):
            out[i] = (after, lang)
    return out


def near_duplicates(rows):
    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", text)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, (t, _) in rows.items()}
    out = {}
    todo = sorted(rows)
    while todo:
        group, edge = {todo[0]}, [todo[0]]
        while edge:
            a = sets[edge.pop()]
            fresh = [j for j in todo if j not in group and a and len(a & sets[j]) >= 0.8 * len(a | sets[j])]
            group.update(fresh)
            edge += fresh
        out[min(group)] = rows[min(group)]
        todo = [j for j in todo if j not in group]
    return out


def test_run_by_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r["doc_id"] for r in quality_forest.quality_rules(docs, labels).where("kept").collect()}
    rows = near_duplicates(lines(languages({r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect() if r["doc_id"] in good})))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, (t, _) in rows.items()}
    got, fill = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got) == set(want)
    for i, ids in want.items():
        at = 0
        for start, length, crc in sorted(got[i]):
            assert start == at and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)
    for parts in fill.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 4096


def test_foreign_and_random_texts_go(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    odd = [
        "il ragazzo che era andato alla scuola non sapeva ancora che cosa avrebbe fatto nella citta quando tornava a casa dalla famiglia",
        "wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw sa oni obdarzeni rozumem i sumieniem",
        "xqzv bkwt zzpf qwrt vbnm hjkl xcvd qqwz ptkf gfds",
        "kjrte iasno ldtuh mreai onlst eurai dnsot hrlia",
    ]
    extra = spark.createDataFrame([(-1 - k, t, None, None, len(t)) for k, t in enumerate(odd)], docs.schema)
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(extra), None).select("doc_id").collect()}
    want = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert got == want


def test_stages_on_odd_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    first = docs.first()
    odd = spark.createDataFrame([(None, first["text"], None, None, None), (-1, None, "en", "s", 0), (-1, None, "en", "s", 0), (-2, "", None, None, 0), tuple(first), (-3, "x " * 30000, "en", "s", 60000)], docs.schema)
    wide = odd.selectExpr("*", "1 AS row", "2 AS gone", "3 AS score", "4 AS _row", "5 AS kept")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, wide, FOLDER)
        if name != "packing":
            assert got.columns == list(corpus_pipeline.COLUMNS)
        rows = got.collect()
        if name in ("quality", "language"):
            assert all(r["text"] for r in rows)
        elif name == "lines":
            assert len(rows) == 6
        elif name == "near_duplicates":
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(["-1", "-2", "-3", str(first["doc_id"])])
        else:
            assert sum(r["start"] == 0 for r in rows) == 6
        assert stage(spark, odd.where("false"), FOLDER).collect() == []
