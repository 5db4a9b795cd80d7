"""Inverted indexes and term statistics over (document, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased, split at white space, no empty tokens; null for a null text."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def terms(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(doc, *keep, F.explode(tokens(F.col(text))).alias("term"))


def different_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term): each term once; those of a text are told apart before they become rows."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).distinct()


def without_stop_words(rows: DataFrame, stop_words: DataFrame, term: str = "term") -> DataFrame:
    """Anti join; Spark broadcasts the stop words if they are as small as they should be."""
    return rows.join(stop_words.select(F.col(stop_words.columns[0]).alias(term)).distinct(), term, "left_anti")


def by_document(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts dealt by document: the shuffle carries each text once, and terms are then counted by document where they are."""
    return docs.select(doc, text).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc)


def term_frequencies(docs: DataFrame, doc: str = "doc_id", text: str = "text", stop_words: DataFrame | None = None) -> DataFrame:
    """(term, doc, tf); texts are shuffled, not their terms."""
    rows = terms(by_document(docs, doc, text), doc, text)
    if stop_words is not None:
        rows = without_stop_words(rows, stop_words)
    return rows.groupBy("term", doc).agg(F.count("*").alias("tf"))


def inverted_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, cf): documents with the term, and its occurrences."""
    return term_frequencies(docs, doc, text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text", stop_words: DataFrame | None = None) -> DataFrame:
    """(term, avg_tf, postings): postings is `doc:tf;doc:tf...` by document."""
    tf = term_frequencies(docs, doc, text, stop_words)
    listed = F.array_sort(F.collect_list(F.struct(F.col(doc).alias("d"), "tf")))
    joined = F.concat_ws(";", F.transform(listed, lambda x: F.concat_ws(":", x["d"].cast("string"), x["tf"].cast("string"))))
    return tf.groupBy("term").agg((F.floor(F.sum("tf") / F.count("*") * 100 + 0.5) / 100).alias("avg_tf"), joined.alias("postings"))


def average_frequency(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, avg_tf) by descending half-up average, then term; a range-partitioned sort, no single reducer."""
    tf = term_frequencies(docs, doc, text).groupBy("term").agg((F.floor(F.sum("tf") / F.count("*") * 100 + 0.5) / 100).alias("avg_tf"))
    return tf.orderBy(F.desc("avg_tf"), "term")


def author_tfidf(docs: DataFrame, author: str = "source", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(author, term, tf, df, tfidf) with tfidf = tf * ln(N / (df + 1)); df counts the author's own documents."""
    n = docs.select(doc).distinct().count()
    own = terms(docs, doc, text, (author,)).groupBy(author, "term", doc).agg(F.count("*").alias("c"))
    rolled = own.groupBy(author, "term").agg(F.sum("c").alias("tf"), F.count("*").alias("df"))
    return rolled.select(F.col(author).alias("author"), "term", "tf", "df", F.round(F.col("tf") * F.log(F.lit(float(n)) / (F.col("df") + 1)), 6).alias("tfidf"))


def tfidf_l2(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_df: float = 0.005, max_df: float = 0.2, size: int = 2000) -> DataFrame:
    """(doc, term, weight): smoothed idf ln((1+n)/(1+df))+1 over the `size` most frequent terms within the df bounds, rows of unit length."""
    n = docs.count()
    df = term_frequencies(docs, doc, text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where((F.col("df") >= min_df * n) & (F.col("df") <= max_df * n))
    vocabulary = df.orderBy(F.desc("cf"), "term").limit(size).select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = terms(by_document(docs, doc, text), doc, text).join(F.broadcast(vocabulary), "term").groupBy(doc, "term", "idf").agg(F.count("*").alias("tf"))
    raw = tf.withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(doc)))
    return raw.where(F.col(doc).isNotNull()).select(doc, "term", F.round(F.col("w") / norm, 6).alias("weight"))


def top_terms(docs: DataFrame, group: str = "source", text: str = "text", k: int = 5) -> DataFrame:
    """The k most frequent terms of each group, then by length, longest first (as keyword clouds list them)."""
    counts = docs.select(group, F.explode(tokens(F.col(text))).alias("term")).groupBy(group, "term").agg(F.count("*").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "term"))).where(F.col("rank") <= k)
    return best.orderBy(group, F.desc(F.length("term")), "term")
