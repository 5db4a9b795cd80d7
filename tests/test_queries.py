"""Registered queries against DuckDB over the smallest tables."""

import math

import duckdb
import pytest

from tarnstone.plans import oracle, registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = """inverted_index postings_list author_tfidf degree_rank oriented_edges triangles_or triangles_and freq_itemsets_k2 freq_itemsets_k3
assoc_rules rules_half lm_score fluency_label sessionise mode_impute reversed_weights downsample prf_averages auc_rank span_scores
covariance gaussian_nb knn_classify bio_spans lemma_rules fitted_pairs event_sessions viterbi_paths bmoe_spans chart_parse basic_tokens word_pieces segmented pruned_items padded_batches secondary_sort
key_difference micro_auc attribute_spans looked_up_tokens token_ids dense_vertex_ids character_kinds text_file numbered_file record_file stop_word_file edge_file basket_file item_file session_file arff_file matrix_file
labelled_file example_file mail_files tagged_file zipped_files vector_file lemma_files result_table rule_file csv_file json_file""".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = registry.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = con.execute(oracle.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall()), key=repr)
    assert got == want


def test_every_sql_has_a_query():
    assert set(oracle.SQL) <= set(registry.QUERIES)
