"""Queries of the operators over the test tables; `oracle.SQL` has the SQL of the same names."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import edges as G
from ..operators import fluency as L
from ..operators import itemsets as I
from ..operators import lexical as X
from ..operators import metrics as M
from ..operators import preparation as P
from ..operators import sequences as S
from ..operators import text_index as T
from ..operators import vectors as V
from ..streaming import events as E

QUERIES = {}
STOP_WORDS = ["the", "of", "and", "to", "de", "la", "der", "die", "und", "en", "que"]
SUPPORT, SUPPORT3, CONFIDENCE, CONFIDENCE3 = 0.02, 0.005, 0.16, 0.1


def query(f):
    QUERIES[f.__name__] = f
    return f


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, d):
    return t(spark, d, "documents")


# --- text index


@query
def inverted_index(spark, d):
    return T.inverted_index(docs(spark, d))


@query
def postings_list(spark, d):
    return T.postings(docs(spark, d), stop_words=spark.createDataFrame([(w,) for w in STOP_WORDS], "term string"))


@query
def sorted_avg_freq(spark, d):
    return T.average_frequency(docs(spark, d))


@query
def author_tfidf(spark, d):
    return T.author_tfidf(docs(spark, d))


@query
def tfidf_l2(spark, d):
    return T.tfidf_l2(docs(spark, d))


@query
def top_terms(spark, d):
    return T.top_terms(docs(spark, d)).drop("rank")


@query
def author_parse(spark, d):
    named = docs(spark, d).select("doc_id", F.concat("source", F.lit("xx.vol"), F.col("doc_id").cast("string"), F.lit(".txt.segmented")).alias("file"))
    return named.select("doc_id", A.author_of(F.col("file"), "src7").alias("author"), A.document_of(F.col("file")).alias("document"))


# --- graph


def graph(spark, d, modulus=499):
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % modulus).alias("dst"))


@query
def degree_rank(spark, d):
    return G.degree_order(graph(spark, d))


@query
def reciprocal_edges(spark, d):
    return G.reciprocal(graph(spark, d))


@query
def oriented_edges(spark, d):
    return G.oriented(G.undirected(graph(spark, d), "and"))


@query
def triangles_or(spark, d):
    return G.triangles(graph(spark, d), "or")


@query
def triangles_and(spark, d):
    return G.triangles(graph(spark, d), "and")


@query
def dense_vertex_ids(spark, d):
    return G.dense_ids(graph(spark, d))


@query
def shortest_paths(spark, d):
    arcs = graph(spark, d, 97).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("cost"))
    return G.shortest_paths(arcs, arcs.select("src").distinct(), 3)


# --- itemsets and rules


def _basket_rows(spark, d):
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey").select(F.col("l_orderkey").alias("tx"), F.col("p_brand").alias("item"))


def baskets(spark, d):
    return _basket_rows(spark, d).distinct()


def _sets(spark, d, support, most, floor=False):
    counted = I.counted_transactions(_basket_rows(spark, d))
    n = counted.agg(F.sum("n")).first()[0] or 0
    return I.frequent_in(counted, n, support, most, floor), n


def _flat(sets):
    return sets.select(F.concat_ws(",", "items").alias("items"), "freq")


@query
def freq_itemsets_k1(spark, d):
    return _flat(_sets(spark, d, SUPPORT, 1)[0])


@query
def freq_itemsets_k2(spark, d):
    return _flat(_sets(spark, d, SUPPORT, 2)[0].where(F.size("items") == 2))


@query
def freq_itemsets_k3(spark, d):
    return _flat(_sets(spark, d, SUPPORT3, 3)[0].where(F.size("items") == 3))


@query
def freq_itemsets_floor(spark, d):
    return _flat(_sets(spark, d, SUPPORT, 2, True)[0])


def _rules(rules):
    return rules.select(F.concat_ws(",", "antecedent").alias("antecedent"), F.concat_ws(",", "consequent").alias("consequent"), "freq", "confidence", "lift")


@query
def assoc_rules(spark, d):
    sets, n = _sets(spark, d, SUPPORT, 2)
    return _rules(I.association_rules(sets, n, 2, CONFIDENCE))


@query
def lift_rules(spark, d):
    sets, n = _sets(spark, d, SUPPORT, 2)
    return _rules(I.association_rules(sets, n, 2, CONFIDENCE, lift=1.0))


@query
def rules_half(spark, d):
    sets, n = _sets(spark, d, SUPPORT, 2)
    return _rules(I.association_rules(sets, n, 2, CONFIDENCE, half=True))


@query
def assoc_rules_k3(spark, d):
    sets, n = _sets(spark, d, SUPPORT3, 3)
    return _rules(I.association_rules(sets, n, 3, CONFIDENCE3))


@query
def rules_half_k3(spark, d):
    sets, n = _sets(spark, d, SUPPORT3, 3)
    return _rules(I.association_rules(sets, n, 3, CONFIDENCE3, half=True))


@query
def fpgrowth_itemsets(spark, d):
    got = I.fp_growth(baskets(spark, d), SUPPORT).freqItemsets
    return _flat(got.where(F.size("items") <= 2).select(F.array_sort("items").alias("items"), "freq"))


@query
def fpgrowth_rules(spark, d):
    got = I.fp_growth(baskets(spark, d), SUPPORT, CONFIDENCE).associationRules.where(F.size("antecedent") == 1)
    return got.select(F.concat_ws(",", "antecedent").alias("antecedent"), F.concat_ws(",", "consequent").alias("consequent"), F.round("confidence", 6).alias("confidence"))


@query
def pruned_transactions(spark, d):
    b = baskets(spark, d)
    keep = b.groupBy("item").agg(F.count("*").alias("n")).where("n >= 2300").select(F.array("item").alias("items"))
    return I.prune_transactions(b, keep)


@query
def pruned_items(spark, d):
    return I.prune_matched(I.matched(baskets(spark, d), _sets(spark, d, SUPPORT, 2)[0], 2), 2)


@query
def item_union(spark, d):
    return I.item_union(_sets(spark, d, SUPPORT, 2)[0]).select(F.concat_ws(",", "items").alias("items"))


# --- language models


@query
def bigram_counts(spark, d):
    return L.bigram_counts(t(spark, d, "conversations"))


def _marked(spark, d):
    return docs(spark, d).join(t(spark, d, "labels"), "doc_id")


@query
def lm_score(spark, d):
    m = _marked(spark, d)
    return L.bigram_scores(m.where("toxic = 0"), m, "doc_id")


@query
def fluency_label(spark, d):
    m = _marked(spark, d)
    scores = L.bigram_scores(m.where("toxic = 0"), m, "doc_id").select("doc_id", (F.col("len") % 50).alias("len"), "score").persist()
    return L.fluency_labels(scores, scores.join(m.where("quality = 1").select("doc_id"), "doc_id", "left_semi"))


@query
def score_by_length(spark, d):
    m = _marked(spark, d)
    return L.bigram_scores(m, m, "doc_id").groupBy("len").agg(F.round(F.avg("score"), 5).alias("mean"))


@query
def score_summary(spark, d):
    m = _marked(spark, d)
    return L.score_summary(L.bigram_scores(m, m, "doc_id").withColumn("score", F.round("score", 4))).select("low", "high", F.round("mean", 4).alias("mean"))


@query
def frequency_scores(spark, d):
    m = _marked(spark, d)
    return L.frequency_scores(F.col("quality") == 1, m)


# --- preparation


@query
def sessionise(spark, d):
    rows = P.sessions(t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query
def session_transactions(spark, d):
    ordered = t(spark, d, "events").withColumn("token", F.when(F.col("event_type") == "signup", "**SOF**").when(F.col("event_id") % 7 == 0, "**EOF**").otherwise(F.col("event_type")))
    return P.delimited(ordered, "user_id", "event_id", "token", "**SOF**", "**EOF**").select("user_id", "session", F.concat_ws(",", "items").alias("items"))


@query
def mode_impute(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return P.impute_modes(o, "o_orderstatus", ["o_orderpriority"])


@query
def class_weights(spark, d):
    return P.power_weights(t(spark, d, "orders"), "o_orderpriority")


@query
def reversed_weights(spark, d):
    return P.reversed_weights(t(spark, d, "orders"), "o_orderpriority")


@query
def label_shares(spark, d):
    return P.label_shares(t(spark, d, "labels"), "quality")


@query
def stratified_sample(spark, d):
    return P.stratified(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 50)


@query
def downsample(spark, d):
    return P.downsample(t(spark, d, "labels"), "quality", "doc_id")


@query
def stratified_folds(spark, d):
    return P.stratified_folds(t(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query
def plain_folds(spark, d):
    return P.folds(t(spark, d, "labels").select("doc_id"), "doc_id")


@query
def hash_split(spark, d):
    return P.hash_split(t(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query
def fixed_sample(spark, d):
    return P.fixed_sample(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@query
def latest_rows(spark, d):
    return P.latest(t(spark, d, "events").select("event_id", "user_id"), "event_id", 200)


@query
def batch_ids(spark, d):
    return P.batches(t(spark, d, "events").select("event_id", "user_id"), "event_id", 16, "user_id")


@query
def padded_batches(spark, d):
    rows = P.repeated(t(spark, d, "conversations").select("conv_id", "turn", "role", F.transform(T.tokens(F.col("text")), lambda w: F.length(w)).alias("ids")), 2)
    rows = rows.withColumn("key", F.concat_ws(":", "conv_id", "turn", "epoch"))
    return P.padded_batches(rows, "key", "ids", 8, "role").select("key", "batch", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query
def secondary_sort(spark, d):
    """The place of each line as found within its order, after the sort."""
    by = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    found = P.secondary_sort(t(spark, d, "lineitem").select("l_orderkey", *by), "l_orderkey", *by).withColumn("at", F.monotonically_increasing_id())
    return found.withColumn("place", F.row_number().over(W.partitionBy("l_orderkey").orderBy("at"))).drop("at")


@query
def length_order(spark, d):
    return P.length_order(docs(spark, d).select("doc_id", "text")).select("doc_id", "length")


# --- metrics


def _judged(spark, d):
    rule = F.least(F.col("n_chars") / 3000.0, F.lit(1.0))
    m = _marked(spark, d)
    return m.select("doc_id", F.col("quality").alias("truth"), F.round(rule, 4).alias("score"), (F.col("n_chars") >= 700).cast("int").alias("pred"))


@query
def confusion(spark, d):
    return M.confusion(_judged(spark, d))


@query
def prf_per_class(spark, d):
    return M.per_class(M.confusion(_judged(spark, d)))


@query
def prf_averages(spark, d):
    return M.averaged(M.confusion(_judged(spark, d)))


@query
def accuracy(spark, d):
    return M.accuracy(_judged(spark, d))


@query
def auc_rank(spark, d):
    return M.auc(_judged(spark, d))


@query
def micro_auc(spark, d):
    """Class shares among five neighbours as scores, over all rows and classes."""
    train, test = _split(spark, d)
    votes = V.nearest(test, train, 5).join(train.select(F.col("vec_id").alias("j"), F.col("label").alias("kind")), "j").groupBy("i", "kind").agg((F.count("*") / 5).alias("score"))
    return M.auc(M.one_vs_rest(votes.join(test.select(F.col("vec_id").alias("i"), "label"), "i"), "i"))


@query
def or_vote(spark, d):
    j = _judged(spark, d)
    return M.or_vote([j.select("doc_id", "pred"), j.select("doc_id", (F.col("score") > 0.985).cast("int").alias("pred"))], "doc_id", "pred")


@query
def prediction_gaps(spark, d):
    return M.joined_predictions(docs(spark, d), t(spark, d, "labels"), "doc_id")


@query
def span_scores(spark, d):
    s = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("start"), F.col("l_returnflag").alias("kind"), "l_quantity")
    return M.span_scores(s.where("l_quantity > 10"), s.where("l_quantity < 40"), ["doc", "start", "kind"], "kind")


@query
def span_scores_micro(spark, d):
    s = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("start"), F.col("l_returnflag").alias("kind"), "l_quantity")
    return M.span_scores(s.where("l_quantity > 10"), s.where("l_quantity < 40"), ["doc", "start", "kind"])


# --- vectors


def emb(spark, d):
    return t(spark, d, "embeddings")


@query
def covariance(spark, d):
    return V.covariance(emb(spark, d))


@query
def zscore(spark, d):
    return V.standardise(emb(spark, d)).select("vec_id", "dim", F.round("z", 5).alias("z"))


@query
def min_max(spark, d):
    return V.min_max(emb(spark, d)).select("vec_id", "dim", F.round("z", 5).alias("z"))


def _split(spark, d):
    e = emb(spark, d)
    return e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0")


@query
def gaussian_nb(spark, d):
    return V.gaussian_nb(*_split(spark, d))


@query
def knn_neighbours(spark, d):
    train, test = _split(spark, d)
    return V.nearest(test, train, 3).select("i", "j", "rank", F.round("d2", 4).alias("d2"))


@query
def knn_graph(spark, d):
    return V.knn_graph(emb(spark, d), 4).select("src", "dst", F.round("cost", 3).alias("cost"))


@query
def knn_classify(spark, d):
    return V.knn_classify(*_split(spark, d), 3)


@query
def one_nn_accuracy(spark, d):
    return V.one_nn_accuracy(*_split(spark, d))


@query
def mds_b_matrix(spark, d):
    return V.centred_products(emb(spark, d))


@query
def nca_objective(spark, d):
    return V.nca_objective(emb(spark, d)).select(F.round("objective", 4).alias("objective"))


@query
def pca_variance(spark, d):
    _, values, _ = V.pca(emb(spark, d), 10)
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(values)], "component int, variance double")


@query
def pca_standard_variance(spark, d):
    _, values, _ = V.pca(emb(spark, d), 10, standard=True)
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(values)], "component int, variance double")


@query
def svd_values(spark, d):
    values, _ = V.svd(emb(spark, d), 10)
    return spark.createDataFrame([(i, round(float(v), 5)) for i, v in enumerate(values)], "component int, value double")


@query
def lda_axes(spark, d):
    values, _ = V.discriminant(emb(spark, d), 2)
    return spark.createDataFrame([(i, round(float(v), 5)) for i, v in enumerate(values)], "component int, ratio double")


@query
def isomap(spark, d):
    ids, x = V.isomap(emb(spark, d), 6, 2)
    return spark.createDataFrame([(int(i), *map(float, abs(r))) for i, r in zip(ids, x, strict=True)], "vec_id bigint, x double, y double")


@query
def nca_steps(spark, d):
    _, seen = V.nca(emb(spark, d), 2, 10)
    return spark.createDataFrame(list(enumerate(seen)), "step int, objective double")


# --- learners (MLlib)


@query
def mail_predictions(spark, d):
    from ..operators import learners as N

    rows = N.mail_messages(docs(spark, d), "lang").where("label is not null")
    _, predict = N.train_mail(rows)
    return predict(rows).groupBy("label", "predicted").agg(F.count("*").alias("n"))


@query
def lda_topics(spark, d):
    from ..operators import learners as N

    return N.topics(docs(spark, d))


@query
def tree_cv(spark, d):
    from ..operators import learners as N

    return M.accuracy(N.cross_validated(emb(spark, d), "tree_gini").withColumnRenamed("label", "truth"))


@query
def bagged_trees(spark, d):
    from ..operators import learners as N

    return N.bagged(*_split(spark, d), "tree_entropy")


def _classified(spark, d, kind, **options):
    from ..operators import learners as N

    train, test = _split(spark, d)
    return N.classified(train, test, kind, **options)


@query
def forest_classes(spark, d):
    return _classified(spark, d, "forest")


@query
def linear_svm_classes(spark, d):
    return _classified(spark, d, "linear_svm")


@query
def mlp_classes(spark, d):
    return _classified(spark, d, "mlp", layers=[64, 64, 32, 10])


@query
def topic_shares(spark, d):
    from ..operators import learners as N

    counts = docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return N.smoothed_shares(counts, "source", "lang")


# --- sequences and words


@query
def bio_spans(spark, d):
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("sent_id"), pos.alias("pos"), F.when(F.col("l_quantity") > 35, F.concat(F.lit("B-"), "l_returnflag")).when(F.col("l_quantity") > 15, F.concat(F.lit("I-"), "l_returnflag")).otherwise("O").alias("tag"))
    return S.bio_spans_sql(rows)


@query
def bmoe_spans(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.element_at(F.array(*map(F.lit, ("B-", "M-", "E-"))), (F.col("l_quantity") % 3 + 1).cast("int")), "l_linestatus").alias("tag"))
    tags = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "tag"))), lambda x: x["tag"]).alias("tags"))
    return S.spans_of(tags, scheme="bmoe").select("l_orderkey", F.explode("spans").alias("s")).select("l_orderkey", "s.*")


@query
def attribute_spans(spark, d):
    tag = F.concat(F.element_at(F.array(*map(F.lit, ("B-", "I-", "E-", "S-"))), (F.col("l_quantity") % 4 + 1).cast("int")), "l_linestatus", F.lit("@"), "l_returnflag")
    tags = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", tag.alias("tag")))), lambda x: x["tag"]).alias("tags"))
    spans = S.spans_of(tags, scheme="bioes").select("l_orderkey", F.explode("spans").alias("s")).select("l_orderkey", "s.*")
    return S.kind_and_attribute(spans)


TRANSITIONS = [[0.5, -0.2, 0.1, 0.0], [0.0, 0.3, -0.5, 0.2], [0.1, 0.0, 0.4, -0.3], [-0.2, 0.1, 0.0, 0.6]]


@query
def viterbi_paths(spark, d):
    rows = emb(spark, d).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", (i * 4 + 1).cast("int"), 4)).alias("emissions"))
    got = S.decode(rows.withColumn("emissions", F.transform("emissions", lambda e: e.cast("array<double>"))), TRANSITIONS, [0.0] * 4, [0.0] * 4)
    return got.select("vec_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), F.round("score", 5).alias("score"), F.round("log_partition", 5).alias("log_partition"))


@query
def lemma_rules(spark, d):
    words = T.terms(docs(spark, d)).where(F.col("term").rlike("^[a-z]+$")).select(F.col("term").alias("word"))
    return X.lemmas(words, words)


@query
def lemma_cascade(spark, d):
    """A dictionary of short words and a table of irregular forms: all steps of the cascade find lemmas."""
    words = T.different_terms(docs(spark, d)).where(F.col("term").rlike("^[a-z]+$")).select(F.col("term").alias("word")).persist()
    irregular = words.where("startswith(word, 'th') and length(word) >= 6").select(F.substring("word", 1, 4).alias("lemma"), "word").distinct()
    return X.lemmas(words, words.where(F.length("word") <= 5), irregular)


@query
def best_documents(spark, d):
    return P.best_k(docs(spark, d).select("doc_id", "source", "n_chars"), "source", "n_chars", "doc_id", 3)


@query
def missing_words(spark, d):
    words = T.terms(docs(spark, d)).where(F.col("term").rlike("^[a-z]+$")).select(F.col("term").alias("word"))
    known = words.where(F.length("word") <= 5)
    return X.missing_words(words, known)


@query
def basic_tokens(spark, d):
    return X.basic_tokens(docs(spark, d).select("doc_id", "text"), joint=" ").select("doc_id", "tokens")


PIECES = ["tion", "the", "and", "ing", "th", "er", "on", "an", "re"]
WORDS = ["tion", "with", "that", "over", "the", "ing", "and", "ble"]


@query
def word_pieces(spark, d):
    vocabulary = {"##" * k + x for k in (0, 1) for x in [*"abcdefghijklmnopqrstuvwxyz.,", *PIECES]}
    return X.word_pieces(docs(spark, d).select("doc_id", "text"), vocabulary, joint=" ").select("doc_id", "tokens")


@query
def segmented(spark, d):
    return X.segmented(docs(spark, d).select("doc_id", F.regexp_replace("text", r"\s", "").alias("text")), set(WORDS), joint=" ").select("doc_id", "tokens")


@query
def chart_parse(spark, d):
    rules = [("S", ("A", "N")), ("A", ("A", "R")), ("A", ("R",)), ("N", ("F",))]
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: F.array(F.when(x["l_returnflag"] == "N", "F").otherwise("R"))).alias("tags"))
    return X.parsed(rows, rules).select("l_orderkey", "accepted")


@query
def token_ids(spark, d):
    return X.token_ids(t(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("tokens")), key="item_id")


@query
def looked_up_tokens(spark, d):
    """Tokens of conversations to ids of the benchmark's vocabulary and back."""
    vocabulary = token_ids(spark, d)
    rows = t(spark, d, "conversations").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    ids = X.looked_up(rows, vocabulary).groupBy("id").agg(F.count("*").alias("n"))
    return X.spelled(ids, vocabulary).select("id", "token", "n")


# --- column functions


@query
def text_predicates(spark, d):
    x = F.col("text")
    return docs(spark, d).select("doc_id", x.rlike("[0-9]").alias("digits"), X.acceptable(x).alias("acceptable"), X.is_cjk(x).alias("cjk"), x.rlike("^[A-Za-z]+$").alias("alphabetic"))


@query
def character_kinds(spark, d):
    """Of one character of each text: blank, control or mark."""
    c = F.col("c")
    one = docs(spark, d).select("doc_id", F.expr("substring(text, cast(try_mod(doc_id, n_chars) as int) + 1, 1)").alias("c"))
    return one.select("doc_id", X.is_blank(c).alias("blank"), X.is_control(c).alias("control"), X.is_punctuation(c).alias("mark"))


def _ids(spark, d):
    return docs(spark, d).select("doc_id", F.transform(T.tokens(F.col("text")), lambda w: F.length(w)).alias("a"))


@query
def fitted_ids(spark, d):
    return _ids(spark, d).select("doc_id", F.concat_ws(",", A.fitted(F.col("a"), 24).cast("array<string>")).alias("ids"), F.aggregate(A.mask(F.col("a"), 24), F.lit(0), lambda acc, v: acc + v).cast("long").alias("n"))


@query
def fitted_pairs(spark, d):
    b = F.slice("a", 1, (F.col("doc_id") % 23 + 1).cast("int"))
    x, y = A.fitted_pair(F.col("a"), b, 40)
    return _ids(spark, d).select("doc_id", F.size(x).cast("long").alias("first"), F.size(y).cast("long").alias("second"))


@query
def quorum_index(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(A.majority_rank(F.collect_list("l_linenumber")).cast("long").alias("committed"))


@query
def row_union(spark, d):
    a, b = t(spark, d, "orders").select(F.col("o_custkey").alias("id")), t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return a.unionByName(b).groupBy("id").agg(F.count("*").alias("n"))


@query
def key_difference(spark, d):
    a, b = t(spark, d, "lineitem").select(F.col("l_partkey") % 1009 + 50).distinct(), t(spark, d, "customer").select("c_custkey").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("lineitem")).toDF("id", "side").unionByName(b.exceptAll(a).withColumn("side", F.lit("customer")).toDF("id", "side"))


@query
def positional_zip(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("line"))
    from ..sources.files import zipped

    return zipped(o, o.select("line_no", F.upper("line").alias("line")))


@query
def bellman(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", F.round(A.bellman_target(F.col("value"), F.col("value") * 2, F.col("event_type") == "purchase"), 4).alias("target"), A.decided(F.col("value"), 0.985).cast("long").alias("decided"))


# --- streaming


@query
def event_windows(spark, d):
    return E.windowed(t(spark, d, "events"))


@query
def event_sessions(spark, d):
    return E.user_sessions(t(spark, d, "events"))


@query
def event_windows_streamed(spark, d):
    schema = t(spark, d, "events").schema
    stream = E.event_stream(spark, d, schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.drained(E.windowed(stream), "event_windows_streamed").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query
def running_mean(spark, d):
    return E.running_mean(t(spark, d, "events"))
