"""Readers and writers of the file formats in use."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import author_of, document_of
from ..operators.preparation import delimited

#: Lines of a file that are put in order at a time.
CHUNK = 1 << 16


def text_lines(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """(file, line), in parallel by file split."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return rows.repartition(parts) if parts else rows


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, line_no, line) with numbers from 1; the splits of a file are read apart and shifted by the lines before them."""
    meta = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at")
    rows = spark.read.text(path, lineSep="\n")
    own = rows.select(F.col("_metadata.file_name").alias("file"), *meta, F.regexp_replace("value", r"\r$", "").alias("line"))
    splits = rows.select(*meta).groupBy("path", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("path").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = splits.select("path", "_split", (before - F.col("_first") + 1).alias("_shift"))
    return own.join(shifts, ["path", "_split"]).select("file", "path", (F.col("_at") + F.col("_shift")).alias("line_no"), "line")


def documents(spark: SparkSession, path: str, special_author: str | None = None) -> DataFrame:
    """(doc, author, line): the document and its author come from the file name."""
    return text_lines(spark, path).select(document_of(F.col("file")).alias("doc"), author_of(F.col("file"), special_author).alias("author"), "line")


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> ''").distinct()


def edge_list(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(src, dst) from two blank-separated fields a line."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(f, F.lit(0)).cast(kind).alias("src"), F.get(f, F.lit(1)).cast(kind).alias("dst"))


def item_lines(spark: SparkSession, path: str) -> DataFrame:
    """(tx, items): distinct blank-separated items of each line; a leading blank gives an empty item."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("tx"), F.array_distinct(F.split("value", r"\s+")).alias("items"))


def braced_baskets(spark: SparkSession, path: str) -> DataFrame:
    """(tx, items) from CSV lines with items in braces; the header has none."""
    inner = F.regexp_extract("value", r"\{(.*)\}", 1)
    return spark.read.text(path).where(F.col("value").contains("{")).select(F.monotonically_increasing_id().alias("tx"), F.split(inner, ",").alias("items"))


def token_sessions(spark: SparkSession, path: str, begin: str = "**SOF**", end: str = "**EOF**") -> DataFrame:
    """(path, session, items) from one token a line."""
    return delimited(numbered_lines(spark, path), "path", "line_no", "line", begin, end)


def arff(spark: SparkSession, path: str) -> DataFrame:
    """Columns as the header declares: numeric ones as double, nominal ones as string, `?` as null. The header is short.

    Commas within single quotes belong to their value. Where the path is a folder, one of its files has the whole header.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '%')")
    head = [r["v"] for r in lines.where(F.lower("v").startswith("@attribute")).collect()]
    fields = []
    for h in head:
        m = re.match(r"@attribute\s+(?:'([^']*)'|\"([^\"]*)\"|(\S+))\s+(.*)", h, re.I)
        fields.append((m[1] or m[2] or m[3], "double" if m[4].strip().lower() in ("real", "numeric", "integer") else "string"))
    parts = F.split("v", r"\s*,\s*(?=(?:[^']*'[^']*')*[^']*$)")
    value = lambda i: F.nullif(F.regexp_replace(F.trim(F.get(parts, F.lit(i))), r"^'(.*)'$", "$1"), F.lit("?"))
    return lines.where("not startswith(v, '@')").select(*[value(i).cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(features, label): comma-separated numbers with the label last."""
    f = F.split("value", ",")
    return spark.read.text(path).where(F.trim("value") != "").select(F.transform(F.slice(f, 1, F.size(f) - 1), lambda x: F.trim(x).cast("float")).alias("features"), F.trim(F.element_at(f, -1)).cast("double").cast("int").alias("label"))


def labelled_text(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(text, label): the last field is the label, all others are joined."""
    f = F.split("value", sep)
    return spark.read.text(path).select(F.concat_ws(sep, F.slice(f, 1, F.size(f) - 1)).alias("text"), F.trim(F.element_at(f, -1)).cast("int").alias("label"))


def examples(spark: SparkSession, path: str) -> DataFrame:
    """(id, sentence, label) from tab-separated lines."""
    return spark.read.csv(path, sep="\t", schema="id string, sentence string, label int", quote="")


def mail_folders(spark: SparkSession, path: str) -> DataFrame:
    """(label, text): files whole, labelled by their folder."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("label"), F.col("value").alias("text"))


def tagged_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(path, sent_id, pos, token, tag): one token and tag a line, a blank line between sentences.

    Lines are dealt in chunks of a file, which take over the sentences before them and the last blank line.
    """
    rows = numbered_lines(spark, path).withColumns({"_chunk": F.floor(F.col("line_no") / CHUNK), "_blank": F.trim("line") == ""})
    last = F.max(F.when(F.col("_blank"), F.col("line_no")))
    chunks = rows.groupBy("path", "_chunk").agg(F.sum(F.col("_blank").cast("long")).alias("_n"), last.alias("_last"))
    before = W.partitionBy("path").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select("path", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.max("_last").over(before), F.lit(0)).alias("_last"))
    own = W.partitionBy("path", "_chunk").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"_n_own": F.sum(F.col("_blank").cast("long")).over(own), "_last_own": last.over(own)}).where(~F.col("_blank")).join(chunks, ["path", "_chunk"])
    f = F.split(F.trim("line"), r"\s+")
    pos = F.col("line_no") - F.coalesce("_last_own", "_last") - 1
    return rows.select("path", (F.col("_n") + F.col("_n_own")).alias("sent_id"), pos.cast("int").alias("pos"), F.get(f, F.lit(0)).alias("token"), F.element_at(f, -1).alias("tag"))


def zipped(words: DataFrame, tags: DataFrame, key: str = "line_no") -> DataFrame:
    """(key, pos, token, tag) from two frames of blank-separated lines with a line number."""
    a = words.select(key, F.split("line", " ").alias("token"))
    b = tags.select(key, F.split("line", " ").alias("tag"))
    return a.join(b, key).select(key, F.posexplode(F.arrays_zip("token", "tag")).alias("pos", "p")).select(key, "pos", "p.token", "p.tag")


def word_vectors(spark: SparkSession, path: str, vocabulary: DataFrame) -> DataFrame:
    """(word, vector) of the words in the vocabulary."""
    f = F.split("value", " ")
    rows = spark.read.text(path).select(F.get(f, F.lit(0)).alias("word"), F.transform(F.slice(f, 2, F.size(f) - 1), lambda x: x.cast("float")).alias("vector"))
    return rows.join(vocabulary.select(F.col(vocabulary.columns[0]).alias("word")).distinct(), "word", "left_semi")


def irregular_forms(spark: SparkSession, path: str) -> DataFrame:
    """(lemma, form): a lemma, then its forms, by tab."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(F.get(f, F.lit(0)).alias("lemma"), F.explode(F.slice(f, 2, F.size(f))).alias("form")).where("form <> ''")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, meaning): a word, then its fields, by tab; the fields stay joined. Of several lines of a word, any one."""
    at = F.instr("value", "\t")
    rows = spark.read.text(path).where(at > 1).select(F.substring_index("value", "\t", 1).alias("word"), F.expr("substring(value, instr(value, '\t') + 1)").alias("meaning"))
    return rows.groupBy("word").agg(F.max("meaning").alias("meaning"))


def json_examples(spark: SparkSession, path: str) -> DataFrame:
    """(id, ids, label) from one JSON object of id -> {ids, label}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<ids:array<int>,label:string>>").alias("m"))
    return raw.select(F.explode("m").alias("id", "e")).select("id", "e.ids", "e.label")


def write_text(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Fields joined to lines; replaces what is there."""
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns])).write.mode("overwrite").text(path)


def write_rules(rules: DataFrame, path: str) -> None:
    line = F.concat(F.concat_ws(",", "antecedent"), F.lit(" -> "), F.concat_ws(",", "consequent"), F.lit("\tconfidence:"), F.col("confidence").cast("string"))
    rules.select(line).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_records(df: DataFrame, path: str) -> None:
    """Records with fixed schemas (ids as long arrays), as Parquet; also what intermediate results are kept in."""
    df.write.mode("overwrite").parquet(path)


def write_id_map(rows: DataFrame, path: str, parts: int = 8) -> None:
    """(id, ids, label) as JSON objects of id -> {ids, label}, one object in each of `parts` files, which `json_examples` reads.

    An object is built in one row: take so many parts that each fits a task. Of rows with one id, any one stays.
    """
    one = rows.select(F.col("id").cast("string").alias("id"), F.struct("ids", "label").alias("e")).groupBy("id").agg(F.any_value("e").alias("e"))
    part = F.pmod(F.hash("id"), F.lit(parts)).alias("part")
    objects = one.groupBy(part).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "e")))).alias("value"))
    objects.repartition("part").write.mode("overwrite").partitionBy("part").text(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """The rows of a Markdown table, one line each, without its head; nulls are empty."""
    cells = [F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|")) for c in df.columns]
    return df.select(F.concat(F.lit("|"), *cells).alias("line"))


def markdown(df: DataFrame) -> str:
    """A small result table in Markdown, its rows in the table's order."""
    head = ["|".join(["", *x, ""]) for x in (df.columns, ["---"] * len(df.columns))]
    return "\n".join(head + [r["line"] for r in markdown_rows(df).collect()])
