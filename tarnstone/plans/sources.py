"""Queries that write a table in a file format and read it again, with the SQL over the same table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import lexical as X
from ..operators import metrics as M
from ..operators import text_index as T
from ..operators import vectors as V
from ..sources import files
from ..sources.scratch import scratch
from . import registry as R
from .registry import docs, query, t


def line_of(column="text"):
    """A text as one line."""
    return F.regexp_replace(column, r"\s+", " ")


_LINE = r"regexp_replace(text, '\s+', ' ', 'g')"


def stored(spark, lines, *by):
    """Write one column as lines, in folders by `by` if given; return the path."""
    path = scratch(spark)
    writer = lines.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)
    return path


@query
def text_file(spark, d):
    """Lines with their file's name, in parallel; a second write replaces the first."""
    rows, path = docs(spark, d).select("doc_id", "source", "lang"), scratch(spark)
    files.write_text(rows.select("lang"), path)
    files.write_text(rows, path)
    return files.text_lines(spark, path, 4).select("line", F.col("file").startswith("part-").alias("named"))


@query
def numbered_file(spark, d):
    """Line numbers run from 1 to each file's number of lines."""
    path = stored(spark, t(spark, d, "events").repartition(8, "event_id").select(F.concat_ws(" ", "event_id", "event_type")))
    rows = files.numbered_lines(spark, path)
    whole = rows.groupBy("path").agg((F.max("line_no") == F.count("*")).alias("whole"))
    return rows.join(whole, "path").select("line", "whole")


@query
def record_file(spark, d):
    """Records of a declared schema: ids of one length, as longs."""
    path = scratch(spark)
    rows = R._ids(spark, d).select("doc_id", A.fitted(F.col("a"), 24).cast("array<bigint>").alias("ids"))
    files.write_records(rows, path)
    back = spark.read.schema("doc_id bigint, ids array<bigint>").parquet(path)
    return back.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query
def stop_word_file(spark, d):
    words = spark.createDataFrame([(w,) for w in [*R.STOP_WORDS, "", f" {R.STOP_WORDS[0]} "]], "w string")
    stop = files.stop_words(spark, stored(spark, words))
    return T.inverted_index(docs(spark, d)).join(stop, "term", "left_anti")


@query
def edge_file(spark, d):
    path = stored(spark, R.graph(spark, d).select(F.concat(F.lit(" "), F.col("src").cast("string"), F.lit("\t"), F.col("dst").cast("string"))))
    return files.edge_list(spark, path).groupBy("src", "dst").agg(F.count("*").alias("n"))


def _lists(spark, d, glue):
    return R.baskets(spark, d).groupBy("tx").agg(F.array_join(F.array_sort(F.collect_set("item")), glue).alias("items"))


@query
def basket_file(spark, d):
    path = stored(spark, _lists(spark, d, ",").select(F.concat(F.lit('"'), F.col("tx").cast("string"), F.lit('","{'), "items", F.lit('}"'))))
    return files.braced_baskets(spark, path).groupBy(F.array_join("items", ",").alias("items")).agg(F.count("*").alias("n"))


@query
def item_file(spark, d):
    """Each line holds its items twice."""
    path = stored(spark, _lists(spark, d, " ").select(F.concat_ws(" ", "items", "items")))
    return files.item_lines(spark, path).groupBy(F.array_join("items", ",").alias("items")).agg(F.count("*").alias("n"))


@query
def session_file(spark, d):
    """One file a user, one token a line."""
    token = F.when(F.col("event_type") == "signup", "**SOF**").when(F.col("event_id") % 7 == 0, "**EOF**").otherwise(F.col("event_type"))
    rows = t(spark, d, "events").select("user_id", "event_id", token.alias("token"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a stated number is not lowered: small files are many
    path = stored(spark, rows.repartition(parts, "user_id").sortWithinPartitions("user_id", "event_id").select("token", "user_id"), "user_id")
    got = files.token_sessions(spark, path)
    return got.select(F.regexp_extract("path", r"user_id=(\d+)", 1).cast("bigint").alias("user_id"), "session", F.concat_ws(",", "items").alias("items"))


@query
def arff_file(spark, d):
    head = ["% customers", "@relation customers", "@attribute 'c key' integer", "@attribute balance REAL", "@attribute name string", "@attribute segment {a,b}", "@data"]
    balance = F.when(F.col("c_custkey") % 7 == 0, F.lit("?")).otherwise(F.col("c_acctbal").cast("string"))
    name = F.concat(F.lit("'"), "c_name", F.lit(", "), "c_mktsegment", F.lit("'"))
    rows = t(spark, d, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), balance, name, "c_mktsegment").alias("value"))
    return files.arff(spark, stored(spark, spark.createDataFrame([("\n".join(head),)], "value string").unionByName(rows)))


@query
def matrix_file(spark, d):
    rows = R.emb(spark, d).select(F.concat_ws(",", F.col("embedding").cast("array<string>"), F.col("label").cast("string")))
    got = files.matrix(spark, stored(spark, rows)).select("label", F.posexplode("features").alias("dim", "x"))
    return got.groupBy("label", "dim").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


@query
def labelled_file(spark, d):
    """Fields before the label stay joined."""
    rows = t(spark, d, "conversations").select(F.concat_ws("\t", "role", line_of(), F.col("turn").cast("string")))
    return files.labelled_text(spark, stored(spark, rows))


@query
def example_file(spark, d):
    rows = docs(spark, d).join(t(spark, d, "labels"), "doc_id").select(F.concat_ws("\t", F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.trim(line_of()), F.col("quality").cast("string")))
    return files.examples(spark, stored(spark, rows))


@query
def mail_files(spark, d):
    path = stored(spark, t(spark, d, "conversations").select(line_of().alias("value"), "role"), "role")
    return files.mail_folders(spark, path).groupBy("label").agg(F.sum(F.length("text")).alias("n_chars"))


@query
def tagged_file(spark, d):
    """One sentence an order; a token names its order and place."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat(F.lit("I-"), "l_returnflag").alias("tag"))
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("a"))
    word = F.transform("a", lambda x, i: F.concat_ws(" ", F.concat_ws(":", F.col("l_orderkey").cast("string"), i.cast("string")), x["tag"]))
    got = files.tagged_tokens(spark, stored(spark, rows.select(F.concat(F.array_join(word, "\n"), F.lit("\n")))))
    return got.select("token", F.col("pos").cast("bigint").alias("pos"), "tag")


@query
def zipped_files(spark, d):
    """Words and tags in two files of one order, joined by file and line."""
    rows = t(spark, d, "orders").repartition(8, "o_orderkey").sortWithinPartitions("o_orderkey")

    def lines(*columns):
        read = files.numbered_lines(spark, stored(spark, rows.select(F.concat_ws(" ", *columns))))
        return read.select(F.concat_ws(":", F.regexp_extract("file", r"part-(\d+)", 1), F.col("line_no").cast("string")).alias("line_no"), "line")

    return files.zipped(lines("o_orderkey", "o_custkey"), lines(F.lit("KEY"), "o_orderstatus")).select("pos", "token", "tag")


@query
def vector_file(spark, d):
    """Vectors of the words of a vocabulary; the vocabulary has others too."""
    word = F.concat(F.lit("w"), F.col("vec_id").cast("string"))
    rows = R.emb(spark, d).select(F.concat_ws(" ", word, F.col("embedding").cast("array<string>")))
    vocabulary = R.emb(spark, d).where("vec_id % 3 = 0").select(word.alias("w")).unionByName(spark.createDataFrame([("other",)], "w string"))
    got = files.word_vectors(spark, stored(spark, rows), vocabulary)
    return got.select("word", F.size("vector").cast("bigint").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query
def lemma_files(spark, d):
    """Dictionary and irregular forms from files, then the whole cascade with the dictionary's entries."""
    words = T.different_terms(docs(spark, d)).where(F.col("term").rlike("^[a-z]+$")).select(F.col("term").alias("word")).persist()
    known = words.where(F.length("word") <= 5).select(F.concat_ws("\t", "word", F.upper("word"), F.length("word").cast("string")))
    th = words.where("startswith(word, 'th') and length(word) >= 6").groupBy(F.substring("word", 1, 4).alias("lemma")).agg(F.collect_list("word").alias("forms"))
    dictionary = files.dictionary(spark, stored(spark, known))
    irregular = files.irregular_forms(spark, stored(spark, th.select(F.concat_ws("\t", "lemma", "forms"))))
    got = X.lemmas(words, dictionary, irregular)
    return got.join(dictionary.withColumnRenamed("word", "lemma"), "lemma", "left").select("word", "lemma", "meaning")


@query
def result_table(spark, d):
    return files.markdown_rows(M.confusion(R._judged(spark, d)))


@query
def rule_file(spark, d):
    path = scratch(spark)
    files.write_rules(R.assoc_rules(spark, d).select(F.array("antecedent").alias("antecedent"), F.array("consequent").alias("consequent"), "confidence"), path)
    part = lambda i: F.regexp_extract("value", r"^(.*) -> (.*)\tconfidence:(.*)$", i)
    return spark.read.text(path).select(part(1).alias("antecedent"), part(2).alias("consequent"), part(3).cast("double").alias("confidence"))


@query
def csv_file(spark, d):
    """Predictions with a head line; a second write replaces the first."""
    path, rows = scratch(spark), V.gaussian_nb(*R._split(spark, d))
    files.write_csv(rows.limit(1), path)
    files.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


@query
def json_file(spark, d):
    path = scratch(spark)
    files.write_id_map(R._ids(spark, d).join(docs(spark, d).select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("id"), F.col("a").alias("ids"), F.col("lang").alias("label")), path)
    got = files.json_examples(spark, path)
    return got.select("id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "label")


def _sql() -> dict[str, str]:
    from . import oracle as O

    order = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1"
    lists = f"WITH {O._BK}, l AS (SELECT tx, string_agg(item, ',' ORDER BY item) AS items FROM b GROUP BY tx) SELECT items, count(*) AS n FROM l GROUP BY items"
    known = O.SQL["lemma_cascade"]
    return {
        "text_file": "SELECT concat_ws(chr(9), doc_id, source, lang) AS line, true AS named FROM documents",
        "numbered_file": "SELECT concat_ws(' ', event_id, event_type) AS line, true AS whole FROM events",
        "record_file": f"WITH a AS (SELECT doc_id, list_transform(list_slice({O._TOK.format(x='text')}, 1, 24), lambda w: length(w)) AS a FROM documents) SELECT doc_id, array_to_string(list_concat(a, list_transform(range(24 - len(a)), lambda x: 0)), ',') AS ids FROM a",
        "stop_word_file": f"WITH {O._TF} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM u WHERE term NOT IN ({O._STOP}) GROUP BY term",
        "edge_file": f"WITH {O._G.format(m=499)} SELECT src, dst, count(*) AS n FROM g GROUP BY ALL",
        "basket_file": lists,
        "item_file": lists,
        "session_file": O.SQL["session_transactions"],
        "arff_file": "SELECT c_custkey::DOUBLE AS \"c key\", CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance, c_name || ', ' || c_mktsegment AS name, c_mktsegment AS segment FROM customer",
        "matrix_file": f"WITH {O._V} SELECT label, dim, count(*) AS n, round(sum(x), 4) AS total FROM v GROUP BY ALL",
        "labelled_file": f"SELECT role || chr(9) || {_LINE} AS text, CAST(turn AS INTEGER) AS label FROM conversations",
        "example_file": f"SELECT 'd' || d.doc_id AS id, nullif(trim({_LINE}), '') AS sentence, quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
        "mail_files": f"SELECT 'role=' || role AS label, CAST(sum(length({_LINE}) + 1) AS BIGINT) AS n_chars FROM conversations GROUP BY role",
        "tagged_file": f"WITH r AS (SELECT *, {order} AS pos FROM lineitem) SELECT l_orderkey || ':' || pos AS token, pos, 'I-' || l_returnflag AS tag FROM r",
        "zipped_files": "SELECT CAST(0 AS INTEGER) AS pos, o_orderkey::VARCHAR AS token, 'KEY' AS tag FROM orders UNION ALL SELECT 1, o_custkey::VARCHAR, o_orderstatus FROM orders",
        "vector_file": "SELECT 'w' || vec_id AS word, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings WHERE vec_id % 3 = 0",
        "lemma_files": f"WITH k AS ({known}) SELECT k.word, lemma, CASE WHEN x.word IS NOT NULL THEN upper(lemma) || chr(9) || length(lemma) END AS meaning FROM k LEFT JOIN (SELECT DISTINCT word FROM ({known}) WHERE length(word) <= 5) x ON k.lemma = x.word",
        "result_table": f"WITH {O._J} SELECT '|' || truth || '|' || pred || '|' || count(*) || '|' AS line FROM j GROUP BY truth, pred",
        "rule_file": f"WITH {O._RULES} SELECT antecedent, consequent, round(c, 6) AS confidence FROM q WHERE c >= {R.CONFIDENCE}",
        "csv_file": O.SQL["gaussian_nb"],
        "json_file": f"SELECT doc_id::VARCHAR AS id, array_to_string(list_transform({O._TOK.format(x='text')}, lambda w: length(w)), ',') AS ids, lang AS label FROM documents",
    }
