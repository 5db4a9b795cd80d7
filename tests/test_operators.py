"""Small hand-made cases of the operators."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tarnstone.functions import arrays as A
from tarnstone.operators import edges as G
from tarnstone.operators import itemsets as I
from tarnstone.operators import lexical as X
from tarnstone.operators import metrics as M
from tarnstone.operators import preparation as P
from tarnstone.operators import sequences as S
from tarnstone.operators import text_index as T
from tarnstone.operators import vectors as V
from tarnstone.sources import files


def test_and_edges_need_both_directions(spark):
    e = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 3), (3, 2), (3, 1), (1, 3), (2, 1)], "src bigint, dst bigint")
    assert {tuple(r) for r in G.undirected(e, "and").collect()} == {(1, 2), (2, 3), (1, 3)}
    once = e.where("not (src = 2 and dst = 1)")
    assert {tuple(r) for r in G.undirected(once, "and").collect()} == {(2, 3), (1, 3)}
    assert G.triangles(once, "or").first()[0] == 1
    assert G.triangles(once, "and").first()[0] == 0


def test_terms_keep_marks_and_drop_blanks(spark):
    d = spark.createDataFrame([(1, "  A#b a@c  A#B"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {tuple(r) for r in T.term_frequencies(d).collect()} == {("a#b", 1, 2), ("a@c", 1, 1)}


def test_rules_in_both_directions_and_half(spark):
    rows = [(t, i) for t, items in enumerate(["ab", "ab", "ab", "abc", "a"]) for i in items]
    b = spark.createDataFrame(rows, "tx bigint, item string")
    sets = I.frequent_itemsets(b, 5, 0.4, 3)
    assert {("".join(r.items), r.freq) for r in sets.collect() for r in [type("R", (), {"items": r["items"], "freq": r["freq"]})]} == {("a", 5), ("b", 4), ("ab", 4)}
    full = {("".join(r["antecedent"]), "".join(r["consequent"])) for r in I.association_rules(sets, 5, 2, 0.5).collect()}
    half = {("".join(r["antecedent"]), "".join(r["consequent"])) for r in I.association_rules(sets, 5, 2, 0.5, half=True).collect()}
    assert full == {("a", "b"), ("b", "a")} and half == {("a", "b")}
    assert I.threshold(11, 0.15) == 1.65 and I.threshold(11, 0.15, floor=True) == 1


def test_sessions_may_be_open_or_empty(spark):
    rows = [(1, i, x) for i, x in enumerate(["x", "<", "a", "b", "a", ">", "<", ">", "<", "c"])]
    got = P.delimited(spark.createDataFrame(rows, "f int, n int, t string"), "f", "n", "t", "<", ">").orderBy("session").collect()
    assert [r["items"] for r in got] == [["a", "b"], [], ["c"]]


def test_modes_tie_to_the_least_and_stay_null(spark):
    rows = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", None), ("y", None)], "k string, v string")
    assert sorted((r["k"], r["v"] or "") for r in P.impute_modes(rows, "k", ["v"]).collect()) == [("x", "a"), ("x", "a"), ("x", "b"), ("y", "")]


def test_spans():
    assert S.bio_spans(["I-a", "B-a", "I-a", "I-b", "B-a", "O", "B-b"]) == [(1, 3, "a"), (4, 5, "a"), (6, 7, "b")]
    assert S.bmoe_spans(["B-a", "M-a", "E-a", "B-a", "B-b", "M-b", "O", "M-a"]) == [(0, 3, "a"), (3, 4, "a")]
    assert S.bioes_spans(["S-a", "B-b", "E-b", "B-a"]) == [(0, 1, "a"), (1, 3, "b")]


def test_viterbi_and_partition_by_brute_force():
    rng = np.random.default_rng(1)
    e, t, a, z = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    scores = {p: S.path_score(list(p), e, t, a, z) for p in itertools.product(range(3), repeat=4)}
    path, score = S.viterbi(e, t, a, z)
    assert tuple(path) == max(scores, key=scores.get) and np.isclose(score, max(scores.values()))
    assert np.isclose(S.log_partition(e, t, a, z), np.log(sum(np.exp(list(scores.values())))))


def test_pieces_and_splits():
    vocabulary = {"un", "##want", "##ed", "runn", "##ing"}
    assert X.pieces("unwanted", vocabulary) == ["un", "##want", "##ed"]
    assert X.pieces("unwantedX", vocabulary) == ["[UNK]"]
    assert X.basic_split("  \u00c4bc-d \u535a\u63a8zz\u0000 ") == ["abc", "-", "d", "\u535a", "\u63a8", "zz"]
    assert X.longest_match("abcd", {"ab", "abc"}, 3) == ["abc", "d"]


def test_chart():
    rules = [("S", ("NP", "VP")), ("NP", ("D", "N")), ("VP", ("V", "NP")), ("VP", ("V",))]
    assert X.parse_chart([{"D"}, {"N", "V"}, {"V"}, {"D"}, {"N"}], rules)
    assert not X.parse_chart([{"D"}, {"V"}], rules) and not X.parse_chart([], rules)


def test_lemmas(spark):
    words = spark.createDataFrame([(w,) for w in "cities wolves stopped dying making went xyz".split()], "word string")
    known = spark.createDataFrame([(w,) for w in "city wolf stop die make go".split()], "w string")
    odd = spark.createDataFrame([("go", "went")], "lemma string, form string")
    got = {r["word"]: r["lemma"] for r in X.lemmas(words, known, odd).collect()}
    assert got == {"cities": "city", "wolves": "wolf", "stopped": "stop", "dying": "die", "making": "make", "went": "go", "xyz": None}


def test_span_scores_without_hits(spark):
    g = spark.createDataFrame([(1, "a")], "s int, k string")
    assert M.span_scores(g, g.where("s > 1"), ["s", "k"]).first()["f1"] == 0.0


def test_pair_budget(spark):
    for a, b, budget in itertools.product(range(6), range(6), range(7)):
        x, y = list(range(a)), list(range(b))
        while len(x) + len(y) > budget:
            (x if len(x) > len(y) else y).pop()
        row = spark.range(1).select(*[F.size(c) for c in A.fitted_pair(F.array_repeat(F.lit(1), a), F.array_repeat(F.lit(1), b), budget)]).first() if (a + b + budget) % 5 == 0 else (len(x), len(y))
        assert tuple(row) == (len(x), len(y))


def test_neighbours_and_pca(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5))
    rows = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    got = {(r["i"], r["rank"]): r["j"] for r in V.nearest(rows, rows, 2).collect()}
    assert all(got[i, k + 1] == np.argsort(d[i])[k] for i in range(40) for k in range(2))
    assert np.allclose(V.pca(rows, 3)[1], np.linalg.eigvalsh(np.cov(x.T))[::-1][:3])
    assert np.allclose(V.svd(rows, 3)[0], np.linalg.svd(x)[1][:3])


def test_isomap_walks_long_chains(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.01 * (i % 2)], 0) for i in range(24)], "vec_id bigint, embedding array<double>, label int")
    arcs = V.knn_graph(rows, 2)
    got = {(r["source"], r["node"]): r["cost"] for r in G.shortest_paths(arcs, rows.select("vec_id")).collect()}
    want = {(i, j): 0.0 if i == j else np.inf for i in range(24) for j in range(24)}
    want.update({(r["src"], r["dst"]): r["cost"] for r in arcs.collect()})
    for m, i, j in itertools.product(range(24), repeat=3):
        want[i, j] = min(want[i, j], want[i, m] + want[m, j])
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    ids, x = V.isomap(rows, 2, 1)
    line = np.array([x[ids.index(i), 0] for i in range(24)])
    assert np.allclose(abs(line - line[0]), range(24), atol=0.1)


def test_isomap_has_neither_pairs_as_rows_nor_the_matrix(spark, monkeypatch):
    x, rows = _matrix(spark, 700, 8)
    x = x + 8 * (np.arange(700) % 7 == 0)[:, None]
    rows = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in enumerate(x)], rows.schema)
    arcs = V.knn_graph(rows, 6)
    d = np.full((700, 700), np.inf)
    np.fill_diagonal(d, 0)
    for r in arcs.collect():
        d[r["src"], r["dst"]] = r["cost"]
    for m in range(700):
        d = np.minimum(d, d[:, [m]] + d[m])
    assert not np.isfinite(d).all()
    d2 = np.where(np.isfinite(d), d, d[np.isfinite(d)].max()) ** 2
    values, vectors = np.linalg.eigh(-0.5 * (d2 - d2.mean(0) - d2.mean(1)[:, None] + d2.mean()))
    want = abs(vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2]))
    for whole, held, space in ((2048, 1 << 30, 1 << 20), (10, 0, 700 * 40), (10, 1 << 30, 1 << 20)):
        for name, value in (("WHOLE", whole), ("HELD", held), ("SPACE", space)):
            monkeypatch.setattr(V, name, value)
        ids, got = V.isomap(rows, 6, 2)
        assert ids == list(range(700)) and np.allclose(abs(got), want, atol=1e-4)
    assert shuffled(spark, lambda: V.isomap(rows, 6, 2)) < 3


def test_nca_takes_all_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCKS", 2)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(5003, 3)) * 0.3, np.arange(5003) % 2
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "vec_id bigint, embedding array<double>, label int")
    a = np.random.default_rng(3).normal(scale=0.1, size=(2, 3))
    want = []
    for _ in range(2):
        z = x @ a.T
        e = np.exp(-((z[:, None] - z[None]) ** 2).sum(2))
        np.fill_diagonal(e, 0)
        p = e / e.sum(1)[:, None]
        own = (p * (y[:, None] == y)).sum(1)
        want.append(own.sum())
        w = p * own[:, None] - p * (y[:, None] == y)
        w += w.T
        a = a + 0.0001 * 2 * a @ (x.T @ (w.sum(1)[:, None] * x - w @ x))
    got, seen = V.nca(rows, 2, 2, 0.0001)
    assert np.allclose(seen, want, rtol=1e-9) and np.allclose(got, a, rtol=1e-6)


def test_learners_run_whole(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import LDA

    from tarnstone.plans import registry

    seen = []
    for kind in (LDA, Pipeline):
        monkeypatch.setattr(kind, "fit", lambda self, rows: seen.append(self) or 1 / 0)
    for name in ("lda_topics", "mail_predictions"):
        try:
            registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        except ZeroDivisionError:
            pass
    lda, (_, words, net) = seen[0], seen[1].getStages()
    assert (lda.getOptimizer(), lda.getMaxIter()) == ("em", 20)
    assert (words.getVectorSize(), net.getLayers()[:-1], net.getMaxIter()) == (128, [128, 64, 32], 300)


def test_files(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% c\n@relation r\n@attribute 'x 1' numeric\n@attribute k {a,b}\n@data\n1.5,a\n?,b\n")
    assert [tuple(r) for r in files.arff(spark, str(tmp_path / "a.arff")).collect()] == [(1.5, "a"), (None, "b")]
    (tmp_path / "t.txt").write_text("u B-a\nv I-a\n\nw O\n")
    assert [(r["sent_id"], r["pos"], r["token"], r["tag"]) for r in files.tagged_tokens(spark, str(tmp_path / "t.txt")).orderBy("sent_id", "pos").collect()] == [(0, 0, "u", "B-a"), (0, 1, "v", "I-a"), (1, 0, "w", "O")]
    (tmp_path / "j.json").write_text('{"7": {"ids": [1, 2], "label": "x"}}')
    assert tuple(files.json_examples(spark, str(tmp_path / "j.json")).first()) == ("7", [1, 2], "x")
    (tmp_path / "s.txt").write_text("**SOF**\nls\ncd\nls\n**EOF**\n**SOF**\n")
    assert [r["items"] for r in files.token_sessions(spark, str(tmp_path / "s.txt")).orderBy("session").collect()] == [["cd", "ls"], []]


def test_best_k_and_orders(spark):
    from tarnstone.operators import preparation

    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 3, 7), ("b", 4, 1)], "g string, id int, m int")
    assert sorted(map(tuple, preparation.best_k(rows, "g", "m", "id", 2).collect())) == [("a", 2, 7, 1), ("a", 3, 7, 2), ("b", 4, 1, 1)]
    texts = spark.createDataFrame([("bb",), ("a",), ("ab",), ("",)], "text string")
    assert [r["text"] for r in preparation.length_order(texts).collect()] == ["", "a", "ab", "bb"]
    dealt = preparation.secondary_sort(rows, "g", "m", "id").rdd.glom().collect()
    assert [r["id"] for part in dealt for r in part if r["g"] == "a"] == [1, 2, 3] and sum(any(r["g"] == "a" for r in p) for p in dealt) == 1


def test_prune_matched(spark):
    baskets = spark.createDataFrame([(1, x) for x in "abcd"] + [(2, x) for x in "ab"] + [(3, x) for x in "acd"], "tx int, item string")
    sets = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["b", "c"],), (["c", "d"],), (["a"],)], "items array<string>")
    held = I.matched(baskets, sets, 2)
    assert sorted((r["tx"], "".join(r["items"])) for r in held.collect()) == [(1, "ab"), (1, "ac"), (1, "bc"), (1, "cd"), (2, "ab"), (3, "ac"), (3, "cd")]
    # transactions 2 and 3 hold fewer than three pairs; `d` of transaction 1 is in one pair only
    assert sorted(map(tuple, I.prune_matched(held, 2).collect())) == [(1, "a"), (1, "b"), (1, "c")]


def test_id_map_and_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2], "x"), (2, [], None), (2, [], None)], "id int, ids array<int>, label string")
    files.write_id_map(rows, str(tmp_path / "m"), 2)
    assert sorted(((r["id"], r["ids"], r["label"]) for r in files.json_examples(spark, str(tmp_path / "m")).collect())) == [("1", [1, 2], "x"), ("2", [], None)]
    assert files.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "|a|b|\n|---|---|\n|1||"


def test_lookup_and_back(spark):
    vocabulary = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id int")
    ids = X.looked_up(spark.createDataFrame([("b",), ("z",), ("b",), (None,)], "token string"), vocabulary).select("id")
    assert sorted(r["id"] for r in ids.collect()) == [-1, -1, 1, 1]
    assert sorted(r["token"] for r in X.spelled(ids, vocabulary).collect()) == ["[UNK]", "[UNK]", "b", "b"]


def test_kind_and_attribute(spark):
    rows = spark.createDataFrame([("a@x",), ("b",), ("c@d@e",)], "kind string")
    assert sorted(map(tuple, S.kind_and_attribute(rows).collect()), key=str) == [("a", "x"), ("b", None), ("c", "d@e")]


def test_dense_ids_have_no_gaps(spark):
    rows = spark.range(20000).select((F.col("id") * 7919 % 5003).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1), (None, -2)], "k bigint, id bigint"))
    got = [(r["place"], r["k"], r["id"]) for r in P.dense(rows, "k", "id", name="place").collect()]
    want = sorted(((i * 7919 % 5003, i) for i in range(20000)))
    assert [g[1:] for g in sorted(got)] == [(None, -2), (None, -1), *want]
    assert [g[0] for g in sorted(got)] == list(range(20002))
    assert P.dense(rows.where("id > 99999"), "k").count() == 0


def test_hash_place(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 > 0, "rare").alias("label"), F.when(F.col("id") > 0, F.col("id")).alias("key"))
    got = P.hash_place(rows, "label", "key", "place").withColumn("h", P.by_hash("key")).collect()
    for label in ("hot", "rare", None):
        own = sorted((r for r in got if r["label"] == label), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(1, len(own) + 1)) and len(own) in (500, 2000)
        assert [r["h"] or "" for r in own] == sorted(r["h"] or "" for r in own)


def shuffled(spark, run):
    """MB that a job wrote in shuffles."""

    def now():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        all_of = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(all_of.apply(i).totalShuffleWrite() for i in range(all_of.size())) / 1e6

    before = now()
    run()
    return now() - before


def _matrix(spark, n, dims, seed=5, shift=0.0):
    x = np.random.default_rng(seed).normal(size=(n, dims)) + shift
    return x, spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")


def test_scaling_matrix_shuffles_no_pairs(spark):
    x, rows = _matrix(spark, 400, 4)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = -0.5 * (d - d.mean(0) - d.mean(1)[:, None] + d.mean())
    rows = rows.unionByName(rows.select(F.lit(None).cast("bigint").alias("vec_id"), "embedding", "label").limit(1))
    made = V.centred_products(rows)
    got = {(r["i"], r["j"]): r["b"] for r in made.collect()}
    assert len(got) == 160000 and all(abs(got[i, j] - want[i, j]) < 2e-6 for i in range(400) for j in range(400))
    assert shuffled(spark, V.centred_products(rows).count) < 0.3


def test_nca_shuffles_rows_not_pairs_of_blocks(spark):
    _, rows = _matrix(spark, 2000, 64)
    assert shuffled(spark, lambda: V.nca(rows, 2, 1)) < 5


def test_nca_objective_shuffles_rows_not_pairs_of_blocks(spark):
    x, rows = _matrix(spark, 2000, 64)
    x, rows = x[:, :6], rows.withColumn("embedding", F.slice("embedding", 1, 6)).withColumn("label", F.expr("nullif(label, 2)"))
    e = np.exp(-((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(e, 0)
    k = np.arange(2000) % 3
    want = ((e * ((k[:, None] == k) & (k != 2))).sum(1) / e.sum(1)).sum()
    assert abs(V.nca_objective(rows).first()[0] - want) < 1e-5
    _, rows = _matrix(spark, 2000, 64)
    assert shuffled(spark, V.nca_objective(rows).collect) < 3


def test_nca_objective_of_unit_vectors_in_single_precision(spark):
    x, rows = _matrix(spark, 1500, 16)
    x[::3] = x[0] + 0.01 * x[::3]
    x /= np.sqrt((x**2).sum(1))[:, None]
    rows = spark.createDataFrame([(i, v.tolist(), int(i % 5)) for i, v in enumerate(x)], rows.schema)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    e, k = np.exp(-d), np.arange(1500) % 5
    np.fill_diagonal(e, 0)
    assert abs(V.nca_objective(rows).first()[0] - ((e * (k[:, None] == k)).sum(1) / e.sum(1)).sum()) < 1e-5
    near = V._squares(x[:700], x[700:], True)(slice(0, 700))
    assert near.dtype == np.float32 and abs(near + d[:700, 700:]).max() < 2e-6
    assert V._squares(1e3 * x, x, True)(slice(0, 9)).dtype == np.float64


def test_neighbours_are_exact_far_from_the_origin(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCKS", 1)
    x, rows = _matrix(spark, 1500, 64, shift=1e6)
    x[7::50] = x[7]
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], rows.schema)
    got = {(r["i"], r["rank"]): (r["j"], r["d2"]) for r in V.nearest(rows, rows, 4).collect()}
    d = np.array([np.round(((x - v) ** 2).sum(1), 6) for v in x])
    np.fill_diagonal(d, np.inf)
    want = {(i, k + 1): (j, d[i, j]) for i in range(1500) for k, j in enumerate(np.lexsort((np.arange(1500), d[i]))[:4])}
    assert set(got) == set(want) and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 2e-6 for p in want)


def test_neighbours_are_ranked_in_stripes_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCKS", 24)
    x, rows = _matrix(spark, 2400, 6)
    x[5::40], x[6::40] = x[5], x[6] + np.arange(60)[:, None] % 7 * 1e-4
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], rows.schema).persist()
    got = {(r["i"], r["rank"]): (r["j"], r["d2"]) for r in V.nearest(rows, rows, 4).collect()}
    d = np.array([np.round(((x - v) ** 2).sum(1), 6) for v in x])
    np.fill_diagonal(d, np.inf)
    want = {(i, k + 1): (j, d[i, j]) for i in range(2400) for k, j in enumerate(np.lexsort((np.arange(2400), d[i]))[:4])}
    assert set(got) == set(want) and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 2e-6 for p in want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, V.nearest(rows, rows, 4).count) < 1.2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_itemsets_from_each_transaction_once(spark):
    rows = [(t, f"{i:02}") for t in range(3000) for i in range(12) if (t * 7 + i * i) % 5 < 3] + [(None, "00"), (None, "01"), (1, None)]
    b = spark.createDataFrame(rows, "tx bigint, item string").repartition(8)
    by = {}
    for t, i in rows:
        by.setdefault(t, set()).add(i)
    want = {}
    for t, items in by.items():
        for k in (1, 2, 3):
            for c in itertools.combinations(sorted(i for i in items if i), k):
                want[c] = want.get(c, 0) + (k == 1 or t is not None)
    want = {c: n for c, n in want.items() if n >= 300}
    out = []
    mb = shuffled(spark, lambda: out.extend(I.association_rules(I.frequent_itemsets(b, 3000, 0.1, 3), 3000, 3, 0.1, half=True).collect()))
    got = {tuple(r["items"]): r["freq"] for r in I.frequent_itemsets(b, 3000, 0.1, 3).collect()}
    assert got == want and out and mb < 0.6


def test_tokens_joined_in_python(spark):
    rows = spark.createDataFrame([(1, "Café, the wing​ed \U0001d54f!"), (2, ""), (3, None), (4, "over\u0000the 1")], "doc_id int, text string")
    vocabulary = {"the", "wing", "##ed", "caf", "##e", ","}
    for make in (X.basic_tokens, lambda r, **k: X.word_pieces(r, vocabulary, **k), lambda r, **k: X.segmented(r, {"the", "over"}, **k)):
        split = {r["doc_id"]: r["tokens"] for r in make(rows).collect()}
        joined = {r["doc_id"]: r["tokens"] for r in make(rows, joint=" ").collect()}
        assert joined == {k: None if v is None else " ".join(v) for k, v in split.items()}
    assert [r["tokens"] for r in X.word_pieces(rows, vocabulary, joint=" ").where("doc_id = 1").collect()] == ["caf ##e , the wing ##ed [UNK] [UNK]"]


def test_character_kinds_of_empty_texts(spark, tmp_path):
    from tarnstone.plans import registry

    rows = spark.createDataFrame([(1, "", 0), (2, "a!", 2), (3, "a!", 2), (4, None, None)], "doc_id bigint, text string, n_chars bigint")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["blank"], r["control"], r["mark"]) for r in registry.character_kinds(spark, str(tmp_path)).collect()}
    assert got == {1: (None,) * 3, 2: (False,) * 3, 3: (False, False, True), 4: (None,) * 3}


def test_fluency_scores_are_found_once(spark, tmp_path):
    from tarnstone.plans import registry

    r = np.random.default_rng(6)
    texts = [(i, " ".join(map(str, r.integers(0, 3000, 60)))) for i in range(400)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    own = shuffled(spark, registry.lm_score(spark, str(tmp_path)).collect)
    assert shuffled(spark, lambda: registry.fluency_label(spark, str(tmp_path)).collect()) < 1.5 * own


def test_nca_goes_over_rows_not_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 4)) * 4, [None if i % 9 == 0 else i % 3 for i in range(300)]
    rows = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, y, strict=True))], "vec_id bigint, embedding array<double>, label int").persist()
    with monkeypatch.context() as m:
        m.setattr(V.gauss, "GROUPS", 0)
        a, seen = V.nca(rows, 2, 2, 0.001)
    monkeypatch.setattr(V, "_paired", None)
    got, also = V.nca(rows, 2, 2, 0.001)
    assert np.allclose(also, seen, rtol=1e-9) and np.allclose(got, a, rtol=1e-8)


def test_paths_of_some_arcs_are_not_joined(spark, monkeypatch):
    arcs = [(s, (s * 7 + k) % 11, float((s * k) % 5 + 1)) for s in range(30) for k in range(4)] + [(3, 40, 1.5), (40, 41, 0.5), (41, 3, 0.25)]
    frame, sources = spark.createDataFrame(arcs, "src bigint, dst bigint, cost double"), [0, 3, 17, 99]
    want = {(s, s): 0.0 for s in sources}
    for _ in range(3):
        step = [((s, d), c + cost) for (s, n), c in want.items() for a, d, cost in arcs if a == n]
        for k, c in step:
            want[k] = min(want.get(k, c), c)
    start = spark.createDataFrame([(s,) for s in sources], "src bigint")
    found = G.shortest_paths(frame, start, 3)
    assert {(r["source"], r["node"]): r["cost"] for r in found.collect()} == want and found.count() == len(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    monkeypatch.setattr(G, "INNER", 0)
    assert {(r["source"], r["node"]): r["cost"] for r in G.shortest_paths(frame, start, 3).collect()} == want


def test_frequency_scores_shuffle_pairs_once(spark):
    from tarnstone.operators import fluency as L

    texts = [(1, 1, "a b a b"), (2, 0, "a b c"), (3, None, "x y"), (4, 1, None), (1, 0, "b a"), (5, 1, "c"), (6, 1, "b c")]
    d = spark.createDataFrame(texts, "doc_id bigint, quality int, text string")
    found = L.frequency_scores(F.col("quality") == 1, d)
    low, high = np.log(2), np.log(3)
    want = {1: 2 * high + 2 * low, 2: high + low, 3: 0.0, 4: 0.0, 5: 0.0, 6: low}
    assert sorted((r["doc_id"], r["score"], r["label"]) for r in found.collect()) == sorted((k, round(want[k], 6), int(want[k] > 1)) for k, *_ in texts)


def test_terms_are_counted_where_their_texts_are(spark):
    d = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "c\tA"), (None, "a"), (3, None)], "doc_id bigint, text string")
    tf = T.term_frequencies(d)
    assert {tuple(r) for r in tf.collect()} == {("a", 1, 2), ("b", 1, 2), ("c", 1, 1), ("c", 2, 1), ("a", 2, 1), ("a", None, 1)}
    assert "hashpartitioning(term" not in tf._jdf.queryExecution().executedPlan().toString()


def test_different_terms(spark):
    d = spark.createDataFrame([(1, "b A  a"), (2, "a\nc"), (3, None), (4, "")], "doc_id bigint, text string")
    assert sorted(r["term"] for r in T.different_terms(d).collect()) == ["a", "b", "c"]


def test_lines_are_numbered_by_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 3)
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    lengths = [3, 1, 9, 4, 2]
    want = [(s, p, f"w{s}-{p}", f"T{p}") for s, n in enumerate(lengths) for p in range(n)]
    text = "\r\n\r\n".join("\r\n".join(f"w{s}-{p} T{p}" for p in range(n)) for s, n in enumerate(lengths)) + "\r\n\r\n"
    for name in "ab":
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    try:
        for k in sizes:
            spark.conf.set(k, "24")
        lines = files.numbered_lines(spark, str(tmp_path))
        got = sorted((r["file"], r["line_no"], r["line"]) for r in lines.collect())
        assert got == sorted((f"{x}.txt", i + 1, t) for x in "ab" for i, t in enumerate(text.split("\r\n")[:-1]))
        tagged = files.tagged_tokens(spark, str(tmp_path)).collect()
        assert sorted((r["sent_id"], r["pos"], r["token"], r["tag"]) for r in tagged) == sorted(want * 2)
    finally:
        for k, v in sizes.items():
            spark.conf.set(k, v)


def test_topics_go_over_blocks_of_documents(spark, monkeypatch):
    from pyspark.ml.clustering import LDA

    from tarnstone.operators import learners as N

    texts = [(i, " ".join(("red green blue", "one two six")[i % 2].split()[: 2 + i % 3 % 2] * (1 + i % 4))) for i in range(40)] + [(40, "")]
    monkeypatch.setattr(LDA, "_fit", None)
    got = N.topics(spark.createDataFrame(texts, "doc_id bigint, text string"), k=2, words=3, iterations=60).collect()
    tops = [{r["term"] for r in got if r["topic"] == t} for t in (0, 1)]
    assert sorted(map(sorted, tops)) == [["blue", "green", "red"], ["one", "six", "two"]]
    assert all(abs(sum(r["weight"] for r in got if r["topic"] == t) - 1) < 0.3 for t in (0, 1))


def test_huffman_paths_by_runs():
    import heapq

    from tarnstone.operators.word_vectors import HuffmanPaths

    rng = np.random.default_rng(1)
    for v in (1, 2, 3, 50, 377):
        counts = np.sort(rng.zipf(1.5, v).clip(1, 5000))[::-1]
        tree = HuffmanPaths(list(zip(*map(np.ndarray.tolist, np.unique(counts, return_counts=True)), strict=True)))
        ends, nodes, codes = tree.of(np.arange(v))
        heap, least = sorted(counts.tolist()), 0
        while len(heap) > 1:
            heapq.heappush(heap, both := heapq.heappop(heap) + heapq.heappop(heap))
            least += both
        length = np.diff(ends, prepend=0)
        assert (length * counts).sum() == least and set(nodes) == set(range(v, 2 * v - 1))
        assert len({tuple(codes[e - n : e]) for e, n in zip(ends, length, strict=True)}) == v


def test_word_vector_steps():
    from tarnstone.operators import word_vectors

    counts = np.array([9, 7, 4, 4, 2, 1])
    tree = word_vectors.HuffmanPaths([(9, 1), (7, 1), (4, 2), (2, 1), (1, 1)])
    ends, nodes, codes = tree.of(np.arange(6))
    rng = np.random.default_rng(2)
    text, sentence = np.repeat(np.arange(6), counts), np.arange(27) // 10
    rng.shuffle(text)
    start = rng.normal(size=(11, 5)).astype("float32")
    start[0] *= 9  # products beyond MAX_EXP
    got = start.copy()
    reached = word_vectors.train(got, text, sentence, (ends, nodes, codes), 3, lambda at: 0.05, np.random.default_rng(5))
    want, reach = start.astype("float64"), 3 - np.random.default_rng(5).integers(0, 3, 27)
    for low in range(0, 27, word_vectors.STEP):
        add = np.zeros_like(want)
        for p in range(low, min(27, low + word_vectors.STEP)):
            for q in range(max(0, p - reach[p]), min(27, p + reach[p] + 1)):
                if q != p and sentence[q] == sentence[p]:
                    for at in range(ends[text[p] - 1] if text[p] else 0, ends[text[p]]):
                        f = want[text[q]] @ want[nodes[at]]
                        if abs(f) < word_vectors.MAX_EXP:
                            g = (1 - codes[at] - 1 / (1 + np.exp(-f))) * 0.05
                            add[text[q]] += g * want[nodes[at]]
                            add[nodes[at]] += g * want[text[q]]
        want += add
    assert reached.all() and np.allclose(got, want, atol=1e-4)


def test_mail_vocabulary_stays_in_executors(spark, monkeypatch):
    from pyspark.ml.functions import vector_to_array

    from tarnstone.operators import learners, word_vectors

    monkeypatch.setattr(word_vectors, "CHUNK", 2000)
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], [f"{'xy'[i % 2]}{w}" for w in rng.zipf(1.6, 20).clip(1, 60)] + [f"once{i}"]) for i in range(400)] + [("a", []), ("b", None), ("a", ["x1"])]
    messages = spark.createDataFrame(rows, "label string, message array<string>")
    model, predict = learners.train_mail(messages, size=16, layers=(8,), iterations=40)
    words = model.stages[1]
    assert not hasattr(words, "_java_obj")  # MLlib's model has every word and vector on the driver
    vectors = {r["word"]: np.array(r["v"]) for r in words.getVectors().select("word", vector_to_array("vector").alias("v")).collect()}
    assert set(vectors) == {w for _, m in rows for w in m or ()}
    near = lambda a, b: vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])
    assert near("x1", "x2") > near("x1", "y1") + 0.3 and near("y1", "y2") > near("y1", "x2") + 0.3
    out = predict(messages).select("label", "predicted", "message", vector_to_array("features").alias("f")).collect()
    assert sorted((r["label"], r["message"] or []) for r in out) == sorted((k, m or []) for k, m in rows)
    for r in out:
        assert np.allclose(r["f"], np.mean([vectors[w] for w in r["message"]], axis=0) if r["message"] else 0, atol=1e-6)
    assert sum(r["label"] == r["predicted"] for r in out) >= 400
