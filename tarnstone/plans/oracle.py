"""DuckDB SQL for the queries of `registry`."""

from __future__ import annotations

from .registry import CONFIDENCE, CONFIDENCE3, PIECES, STOP_WORDS, SUPPORT, SUPPORT3, TRANSITIONS, WORDS

_TOK = r"list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda w: w <> '')"
_T = r"t AS (SELECT doc_id, source, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM documents), w AS (SELECT * FROM t WHERE term <> '')"
_TF = f"{_T}, u AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY ALL)"
_STOP = ", ".join(f"'{x}'" for x in STOP_WORDS)
_B = "CAST({} AS BIGINT)"
_G = "g AS (SELECT l_suppkey AS src, l_partkey % {m} AS dst FROM lineitem)"
_AND = f"{_G}, x AS (SELECT DISTINCT src, dst FROM g WHERE src <> dst), e AS (SELECT a.src AS u, a.dst AS v FROM x a JOIN x b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst)".format(m=499)
_OR = f"{_G}, e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM g WHERE src <> dst)".format(m=499)
_TRI = "SELECT count(*) AS triangles FROM e a JOIN e b ON a.u = b.u AND a.v < b.v JOIN e c ON c.u = a.v AND c.v = b.v"
_BK = "b AS (SELECT DISTINCT l_orderkey AS tx, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT tx) AS n FROM b), s1 AS (SELECT item, count(*) AS freq FROM b GROUP BY item)"
_S2 = f"{_BK}, s2 AS (SELECT x.item AS i, y.item AS j, count(*) AS freq FROM b x JOIN b y ON x.tx = y.tx AND x.item < y.item GROUP BY ALL HAVING count(*) >= (SELECT n * {SUPPORT} FROM n))"
_RULES = f"""{_S2}, r AS (SELECT i AS antecedent, j AS consequent, freq FROM s2 UNION ALL SELECT j, i, freq FROM s2),
q AS (SELECT antecedent, consequent, r.freq, r.freq / a.freq::DOUBLE AS c, r.freq * n.n::DOUBLE / (a.freq * c.freq) AS l FROM r JOIN s1 a ON a.item = antecedent JOIN s1 c ON c.item = consequent, n)"""
_TRIPLES = f"""{_BK}, known AS (SELECT item AS items, freq FROM s1 UNION ALL SELECT x.item || ',' || y.item, count(*) FROM b x JOIN b y ON x.tx = y.tx AND x.item < y.item GROUP BY ALL),
s3 AS (SELECT x.item AS i, y.item AS j, z.item AS k, count(*) AS freq FROM b x JOIN b y ON x.tx = y.tx AND x.item < y.item JOIN b z ON z.tx = y.tx AND y.item < z.item GROUP BY ALL HAVING count(*) >= (SELECT n * {SUPPORT3} FROM n)),
one AS (SELECT i AS a, j || ',' || k AS c, freq FROM s3 UNION ALL SELECT j, i || ',' || k, freq FROM s3 UNION ALL SELECT i || ',' || j, k, freq FROM s3),
r AS (SELECT a AS antecedent, c AS consequent, freq, 1 AS forward FROM one UNION ALL SELECT c, a, freq, 0 FROM one),
q AS (SELECT antecedent, consequent, r.freq, forward, r.freq / a.freq::DOUBLE AS c, r.freq * n.n::DOUBLE / (a.freq * c.freq) AS l FROM r JOIN known a ON a.items = antecedent JOIN known c ON c.items = consequent, n)"""
_PAD = "list_concat(list_concat(['<s>'], " + _TOK.format(x="text") + "), ['</s>'])"
_PAIRS = "p AS (SELECT *, unnest(list_slice(w, 1, len(w) - 1)) AS a, unnest(list_slice(w, 2, len(w))) AS b FROM m)"
_M = f"m0 AS (SELECT d.doc_id, d.text, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id), m AS (SELECT doc_id, quality, toxic, {_PAD} AS w FROM m0)"
_SC = """c2 AS (SELECT a, b, count(*) AS c2 FROM p {where} GROUP BY ALL), c1 AS (SELECT a, count(*) AS c1 FROM (SELECT unnest(w) AS a FROM m {where}) GROUP BY ALL),
s AS (SELECT p.doc_id, len(w) AS len, round(sum(ln(coalesce(c2::DOUBLE, 1e-100) / coalesce(c1::DOUBLE, 1.0))) / len(w), 6) AS score FROM p LEFT JOIN c2 ON p.a = c2.a AND p.b = c2.b LEFT JOIN c1 ON p.a = c1.a GROUP BY p.doc_id, len(w))"""
_J = "j AS (SELECT d.doc_id, quality AS truth, round(least(n_chars / 3000.0::DOUBLE, 1.0), 4) AS score, CAST(n_chars >= 700 AS INTEGER) AS pred FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_C = f"{_J}, k AS (SELECT truth, pred, count(*) AS n FROM j GROUP BY ALL), lb AS (SELECT truth AS label FROM k UNION SELECT pred FROM k), c AS (SELECT label, CAST(coalesce((SELECT sum(n) FROM k WHERE truth = label), 0) AS BIGINT) AS gold, CAST(coalesce((SELECT sum(n) FROM k WHERE pred = label), 0) AS BIGINT) AS predicted, CAST(coalesce((SELECT sum(n) FROM k WHERE pred = label AND truth = label), 0) AS BIGINT) AS hits FROM lb), f AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted::DOUBLE END AS p, CASE WHEN gold = 0 THEN 0 ELSE hits / gold::DOUBLE END AS r FROM c), h AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f0 FROM f)"
_V = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim FROM embeddings)"
_D = f"{_V}, {{q}} AS (SELECT * FROM v WHERE {{w}})"
_NEAR = f"{_V}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, round(sum((a.x - b.x) * (a.x - b.x)), 6) AS d2 FROM v a JOIN v b ON a.dim = b.dim WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM d)"
_SP = "s AS (SELECT l_orderkey AS doc, l_linenumber AS start, l_returnflag AS kind, l_quantity FROM lineitem), g AS (SELECT * FROM s WHERE l_quantity > 10), p AS (SELECT * FROM s WHERE l_quantity < 40), h AS (SELECT p.* FROM p JOIN (SELECT DISTINCT doc, start, kind FROM g) x ON p.doc = x.doc AND p.start = x.start AND p.kind = x.kind)"
_PRF = "round(hits / predicted::DOUBLE, 6) AS precision, round(hits / gold::DOUBLE, 6) AS recall, round(2.0 * hits / (predicted + gold), 6) AS f1"
_HB = "('0x' || substr(md5({k}::VARCHAR || '{s}'), 1, 7))::BIGINT"
_WIN = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
_LEM = r"wd AS (SELECT DISTINCT term AS word FROM w WHERE regexp_matches(term, '^[a-z]+$')), dict AS (SELECT word FROM wd {d}), tr AS (SELECT word, 0 AS o, word AS lemma FROM wd {t}), ok AS (SELECT tr.* FROM tr JOIN dict ON tr.lemma = dict.word), best AS (SELECT word, arg_min(lemma, o) AS lemma FROM ok GROUP BY word)"


def _tries() -> str:
    from ..operators.lexical import ENDINGS

    out = []
    for i, (e, put) in enumerate(ENDINGS):
        n = len(e)
        made, cond = f"substr(word, 1, length(word) - {n}) || '{put}'", ""
        if put == "=":
            made = f"substr(word, 1, length(word) - {n + 1})"
            cond = f" AND substr(word, length(word) - {n}, 1) = substr(word, length(word) - {n + 1}, 1)"
        out.append(f"UNION ALL SELECT word, {2 + i}, {made} FROM wd WHERE ends_with(word, '{e}') AND length(word) > {n}{cond}")
    return " ".join(out)


def _viterbi(steps: int = 16, tags: int = 4) -> str:
    """Best scores s, paths p and log sums a by tag, step by step."""
    states, out = range(tags), []
    e = [[f"embedding[{i * tags + j + 1}]::DOUBLE" for j in states] for i in range(steps)]
    first = ", ".join(f"{e[0][j]} AS s{j}, {e[0][j]} AS a{j}, '{j}' AS p{j}" for j in states)
    out.append(f"z0 AS (SELECT vec_id, embedding, {first} FROM embeddings)")
    for i in range(1, steps):
        made = []
        for j in states:
            via = [f"s{k} + {TRANSITIONS[k][j]}::DOUBLE" for k in states]
            sums = " + ".join(f"exp(a{k} + {TRANSITIONS[k][j]}::DOUBLE)" for k in states)
            cases = " ".join(f"WHEN {via[k]} = greatest({', '.join(via)}) THEN p{k}" for k in states)
            made.append(f"greatest({', '.join(via)}) + {e[i][j]} AS s{j}, ln({sums}) + {e[i][j]} AS a{j}, CASE {cases} END || ',{j}' AS p{j}")
        out.append(f"z{i} AS MATERIALIZED (SELECT vec_id, embedding, {', '.join(made)} FROM z{i - 1})")
    top = "greatest(s0, s1, s2, s3)"
    cases = " ".join(f"WHEN s{k} = {top} THEN p{k}" for k in states)
    return f"WITH {', '.join(out)} SELECT vec_id, CASE {cases} END AS path, round({top}, 5) AS score, round(ln({' + '.join(f'exp(a{k})' for k in states)}), 5) AS log_partition FROM z{steps - 1}"


_MARKS = r"!-/:-@\[-`{-~\p{P}"
_BASIC = rf"regexp_extract_all(lower(strip_accents(text)), '[{_MARKS}]|[^\s{_MARKS}]+')"
_PIECE = f"regexp_extract_all(w, '{'|'.join(PIECES)}|[a-z.,]')"
_BMOE = """r AS (SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN substr('BME', CAST(l_quantity % 3 + 1 AS INTEGER), 1) ELSE substr('bme', CAST(l_quantity % 3 + 1 AS INTEGER), 1) END AS c FROM lineitem),
g AS (SELECT l_orderkey, string_agg(c, '' ORDER BY l_linenumber, upper(c), c DESC) AS s FROM r GROUP BY l_orderkey), i AS (SELECT *, CAST(unnest(range(length(s))) AS INTEGER) AS start FROM g),
h AS (SELECT l_orderkey, start, regexp_extract(substr(s, start + 1), '^(BM*E|bm*e|B|b)') AS hit, substr(s, start + 2, 1) AS next FROM i)"""

_NAMES = [f"{a}@{b}" for a in "FO" for b in "ANR"]
_CODES = ", ".join(f"'{m}-{n}'" for n in _NAMES for m in "BIES")
_RUNS = "|".join(f"{chr(65 + 4 * k)}{chr(66 + 4 * k)}*{chr(67 + 4 * k)}|{chr(68 + 4 * k)}" for k in range(len(_NAMES)))
_BIOES = f"""r AS (SELECT l_orderkey, l_linenumber, substr('BIES', CAST(l_quantity % 4 + 1 AS INTEGER), 1) || '-' || l_linestatus || '@' || l_returnflag AS tag FROM lineitem),
g AS (SELECT l_orderkey, string_agg(chr(CAST(64 + list_position([{_CODES}], tag) AS INTEGER)), '' ORDER BY l_linenumber, tag) AS s, list(tag ORDER BY l_linenumber, tag) AS tags FROM r GROUP BY l_orderkey),
i AS (SELECT *, CAST(unnest(range(length(s))) AS INTEGER) AS start FROM g), h AS (SELECT l_orderkey, start, length(regexp_extract(substr(s, start + 1), '^({_RUNS})')) AS n, string_split(substr(tags[start + 1], 3), '@') AS name FROM i)"""

SQL = {
    "attribute_spans": f"WITH {_BIOES} SELECT l_orderkey, start, CAST(start + n AS INTEGER) AS \"end\", name[1] AS kind, name[2] AS attribute FROM h WHERE n > 0",
    "micro_auc": f"WITH {_NEAR}, s AS (SELECT k.i, e.label AS kind, count(*) / 5.0::DOUBLE AS score FROM k JOIN embeddings e ON k.j = e.vec_id WHERE rank <= 5 GROUP BY k.i, e.label), c AS (SELECT DISTINCT label AS kind FROM embeddings WHERE vec_id % 5 = 0 UNION SELECT kind FROM s), f AS (SELECT CAST(e.label = c.kind AS INTEGER) AS truth, coalesce(s.score, 0) AS score FROM embeddings e CROSS JOIN c LEFT JOIN s ON s.i = e.vec_id AND s.kind = c.kind WHERE e.vec_id % 5 = 0), w AS (SELECT score, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 0) AS n FROM f GROUP BY score) SELECT round(sum(CASE WHEN a.score > b.score THEN a.p * b.n WHEN a.score = b.score THEN 0.5 * a.p * b.n ELSE 0 END)::DOUBLE / (sum(a.p * b.n)), 6) AS auc FROM w a, w b",
    "viterbi_paths": _viterbi(),
    "bmoe_spans": f"WITH {_BMOE} SELECT l_orderkey, start, CAST(start + length(hit) AS INTEGER) AS \"end\", CASE substr(hit, 1, 1) WHEN 'B' THEN 'O' ELSE 'F' END AS kind FROM h WHERE length(hit) > 1 OR hit = 'B' AND next <> 'M' OR hit = 'b' AND next <> 'm'",
    "chart_parse": "SELECT l_orderkey, regexp_matches(string_agg(CASE WHEN l_returnflag = 'N' THEN 'F' ELSE 'R' END, '' ORDER BY l_linenumber, l_returnflag), '^R+F$') AS accepted FROM lineitem GROUP BY l_orderkey",
    "basic_tokens": f"SELECT doc_id, array_to_string({_BASIC}, ' ') AS tokens FROM documents",
    "word_pieces": f"SELECT doc_id, array_to_string(list_transform({_BASIC}, lambda w: CASE WHEN length(w) > 200 OR NOT regexp_matches(w, '^[a-z.,]+$') THEN '[UNK]' ELSE array_to_string({_PIECE}, ' ##') END), ' ') AS tokens FROM documents",
    "segmented": rf"SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(text, '\s', '', 'g'), '{'|'.join(WORDS)}|(?s:.)'), ' ') AS tokens FROM documents",
    "pruned_items": f"WITH {_S2}, h AS (SELECT x.tx, x.item AS i, y.item AS j FROM b x JOIN b y ON x.tx = y.tx AND x.item < y.item JOIN s2 ON s2.i = x.item AND s2.j = y.item), u AS (SELECT tx, i AS item FROM h UNION ALL SELECT tx, j FROM h) SELECT tx, item FROM u WHERE tx IN (SELECT tx FROM h GROUP BY tx HAVING count(*) > 2) GROUP BY tx, item HAVING count(*) >= 2",
    "padded_batches": f"WITH e AS (SELECT concat_ws(':', conv_id, turn, epoch) AS key, role, list_transform({_TOK.format(x='text')}, lambda w: length(w)) AS ids FROM conversations, range(2) AS r(epoch)), k AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY role ORDER BY md5(key || 'batch'), key) - 1) / 8.0) AS BIGINT) AS batch FROM e), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY role, batch) AS most FROM k) SELECT key, batch, array_to_string(list_concat(ids, list_transform(range(most - len(ids)), lambda x: 0)), ',') AS ids FROM m",
    "secondary_sort": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS place FROM lineitem",
    "length_order": "SELECT doc_id, CAST(length(text) AS INTEGER) AS length FROM documents",
    "character_kinds": r"WITH o AS (SELECT doc_id, substr(text, doc_id % n_chars + 1, 1) AS c FROM documents) SELECT doc_id, regexp_matches(c, '^\s*$') AS blank, regexp_matches(c, '^[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]+$') AS control, regexp_matches(c, '^[!-/:-@\[-`{-~]+$') AS mark FROM o",
    "inverted_index": f"WITH {_TF} SELECT term, count(*) AS df, {_B.format('sum(tf)')} AS cf FROM u GROUP BY term",
    "postings_list": f"WITH {_TF} SELECT term, floor(sum(tf) / count(*)::DOUBLE * 100 + 0.5) / 100 AS avg_tf, string_agg(doc_id || ':' || tf, ';' ORDER BY doc_id) AS postings FROM u WHERE term NOT IN ({_STOP}) GROUP BY term",
    "sorted_avg_freq": f"WITH {_TF} SELECT term, floor(sum(tf) / count(*)::DOUBLE * 100 + 0.5) / 100 AS avg_tf FROM u GROUP BY term",
    "author_tfidf": f"WITH {_T}, u AS (SELECT source AS author, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY ALL) SELECT *, round(tf * ln((SELECT count(DISTINCT doc_id) FROM documents)::DOUBLE / (df + 1)), 6) AS tfidf FROM u",
    "tfidf_l2": f"WITH {_TF}, n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM u GROUP BY term), v AS (SELECT f.* FROM f, n WHERE df >= 0.005 * n AND df <= 0.2 * n ORDER BY cf DESC, term LIMIT 2000), r AS (SELECT doc_id, u.term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM u JOIN v ON u.term = v.term, n), q AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM r GROUP BY doc_id) SELECT r.doc_id, term, round(w / norm, 6) AS weight FROM r JOIN q ON r.doc_id = q.doc_id",
    "top_terms": f"WITH {_T}, c AS (SELECT source, term, count(*) AS n FROM w GROUP BY ALL) SELECT source, term, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, term) <= 5",
    "author_parse": "SELECT doc_id, CASE WHEN starts_with(source, 'src7') THEN 'src7' ELSE source END AS author, source || 'xx.vol' || doc_id AS document FROM documents",
    "degree_rank": f"WITH {_G.format(m=499)} SELECT vertex, count(*) AS degree FROM (SELECT src AS vertex FROM g WHERE src <> dst UNION ALL SELECT dst FROM g WHERE src <> dst) GROUP BY vertex",
    "reciprocal_edges": f"WITH {_G.format(m=499)}, x AS (SELECT DISTINCT src, dst FROM g) SELECT a.src, a.dst FROM x a JOIN x b ON a.src = b.dst AND a.dst = b.src",
    "oriented_edges": f"WITH {_AND}, d AS (SELECT x, count(*) AS d FROM (SELECT u AS x FROM e UNION ALL SELECT v FROM e) GROUP BY x) SELECT CASE WHEN a.d < b.d OR (a.d = b.d AND u < v) THEN u ELSE v END AS lo, CASE WHEN a.d < b.d OR (a.d = b.d AND u < v) THEN v ELSE u END AS hi FROM e JOIN d a ON a.x = u JOIN d b ON b.x = v",
    "triangles_or": f"WITH {_OR} {_TRI}",
    "triangles_and": f"WITH {_AND} {_TRI}",
    "dense_vertex_ids": f"WITH {_G.format(m=499)}, v AS (SELECT src AS vertex FROM g UNION SELECT dst FROM g) SELECT vertex, row_number() OVER (ORDER BY vertex) - 1 AS id FROM v",
    "shortest_paths": f"WITH {_G.format(m=97)}, a AS (SELECT src, dst, count(*)::DOUBLE AS cost FROM g WHERE src <> dst GROUP BY ALL), b0 AS (SELECT DISTINCT src AS source, src AS node, 0.0::DOUBLE AS cost FROM a), b1 AS (SELECT source, node, min(cost) AS cost FROM (SELECT * FROM b0 UNION ALL SELECT source, dst, b.cost + a.cost FROM b0 b JOIN a ON node = src) GROUP BY ALL), b2 AS (SELECT source, node, min(cost) AS cost FROM (SELECT * FROM b1 UNION ALL SELECT source, dst, b.cost + a.cost FROM b1 b JOIN a ON node = src) GROUP BY ALL) SELECT source, node, min(cost) AS cost FROM (SELECT * FROM b2 UNION ALL SELECT source, dst, b.cost + a.cost FROM b2 b JOIN a ON node = src) GROUP BY ALL",
    "freq_itemsets_k1": f"WITH {_BK} SELECT item AS items, freq FROM s1, n WHERE freq >= n * {SUPPORT}",
    "freq_itemsets_k2": f"WITH {_S2} SELECT i || ',' || j AS items, freq FROM s2",
    "freq_itemsets_k3": f"WITH {_BK} SELECT x.item || ',' || y.item || ',' || z.item AS items, count(*) AS freq FROM b x JOIN b y ON x.tx = y.tx AND x.item < y.item JOIN b z ON z.tx = y.tx AND y.item < z.item GROUP BY ALL HAVING count(*) >= (SELECT n * {SUPPORT3} FROM n)",
    "freq_itemsets_floor": f"WITH {_BK} SELECT item AS items, freq FROM s1, n WHERE freq >= floor(n * {SUPPORT}) UNION ALL SELECT x.item || ',' || y.item, count(*) FROM b x JOIN b y ON x.tx = y.tx AND x.item < y.item GROUP BY ALL HAVING count(*) >= (SELECT floor(n * {SUPPORT}) FROM n)",
    "assoc_rules": f"WITH {_RULES} SELECT antecedent, consequent, freq, round(c, 6) AS confidence, round(l, 6) AS lift FROM q WHERE c >= {CONFIDENCE}",
    "lift_rules": f"WITH {_RULES} SELECT antecedent, consequent, freq, round(c, 6) AS confidence, round(l, 6) AS lift FROM q WHERE c >= {CONFIDENCE} AND l >= 1",
    "rules_half": f"WITH {_RULES} SELECT antecedent, consequent, freq, round(c, 6) AS confidence, round(l, 6) AS lift FROM q WHERE c >= {CONFIDENCE} AND (antecedent < consequent OR NOT EXISTS (SELECT 1 FROM q o WHERE o.antecedent = q.consequent AND o.consequent = q.antecedent AND o.c >= {CONFIDENCE}))",
    "assoc_rules_k3": f"WITH {_TRIPLES} SELECT antecedent, consequent, freq, round(c, 6) AS confidence, round(l, 6) AS lift FROM q WHERE c >= {CONFIDENCE3}",
    "rules_half_k3": f"WITH {_TRIPLES} SELECT antecedent, consequent, freq, round(c, 6) AS confidence, round(l, 6) AS lift FROM q WHERE c >= {CONFIDENCE3} AND (forward = 1 OR NOT EXISTS (SELECT 1 FROM q o WHERE o.antecedent = q.consequent AND o.consequent = q.antecedent AND o.c >= {CONFIDENCE3}))",
    "best_documents": "SELECT doc_id, source, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place FROM documents QUALIFY place <= 3",
    "fpgrowth_itemsets": f"WITH {_S2} SELECT item AS items, freq FROM s1, n WHERE freq >= n * {SUPPORT} UNION ALL SELECT i || ',' || j, freq FROM s2",
    "fpgrowth_rules": f"WITH {_RULES} SELECT antecedent, consequent, round(c, 6) AS confidence FROM q WHERE c >= {CONFIDENCE}",
    "pruned_transactions": f"WITH {_BK}, k AS (SELECT b.* FROM b JOIN s1 ON b.item = s1.item WHERE freq >= 2300) SELECT tx, item FROM k WHERE tx IN (SELECT tx FROM k GROUP BY tx HAVING count(*) > 1)",
    "item_union": f"WITH {_S2} SELECT string_agg(item, ',' ORDER BY item) AS items FROM (SELECT item FROM s1, n WHERE freq >= n * {SUPPORT} UNION SELECT i FROM s2 UNION SELECT j FROM s2)",
    "bigram_counts": f"WITH m AS (SELECT {_PAD} AS w FROM conversations), {_PAIRS} SELECT a, b, count(*) AS c2 FROM p GROUP BY ALL",
    "lm_score": f"WITH {_M}, {_PAIRS}, {_SC.format(where='WHERE toxic = 0')} SELECT doc_id, CAST(len AS INTEGER) AS len, score FROM s",
    "fluency_label": f"WITH {_M}, {_PAIRS}, {_SC.format(where='WHERE toxic = 0')}, z AS (SELECT doc_id, len % 50 AS len, score FROM s), g AS (SELECT z.* FROM z JOIN m ON z.doc_id = m.doc_id WHERE quality = 1), bl AS (SELECT len, avg(score) AS mean FROM g GROUP BY len) SELECT z.doc_id, CAST(z.len AS INTEGER) AS len, score, CAST(score >= round(coalesce(mean, (SELECT avg(score) FROM g) - 0.1), 6) AS INTEGER) AS fluent FROM z LEFT JOIN bl ON z.len = bl.len",
    "score_by_length": f"WITH {_M}, {_PAIRS}, {_SC.format(where='')} SELECT CAST(len AS INTEGER) AS len, round(avg(score), 5) AS mean FROM s GROUP BY len",
    "score_summary": f"WITH {_M}, {_PAIRS}, {_SC.format(where='')}, z AS (SELECT round(score, 4) AS score FROM s) SELECT min(score) AS low, max(score) AS high, round(avg(score), 4) AS mean FROM z",
    "frequency_scores": f"WITH m AS (SELECT d.doc_id, quality, {_TOK.format(x='text')} AS w FROM documents d JOIN labels l ON d.doc_id = l.doc_id), {_PAIRS}, f AS (SELECT a, b, count(*) AS freq FROM p WHERE quality = 1 GROUP BY ALL), s AS (SELECT doc_id, sum(ln(1 + freq)) AS s FROM p JOIN f ON p.a = f.a AND p.b = f.b GROUP BY doc_id) SELECT m.doc_id, round(coalesce(s, 0.0), 6) AS score, CAST(round(coalesce(s, 0.0), 6) > 1 AS INTEGER) AS label FROM m LEFT JOIN s ON m.doc_id = s.doc_id",
    "sessionise": "WITH x AS (SELECT *, CAST(sum(CAST(event_type = 'signup' AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM events) SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM x GROUP BY ALL",
    "session_transactions": "WITH k AS (SELECT *, CASE WHEN event_type = 'signup' THEN '**SOF**' WHEN event_id % 7 = 0 THEN '**EOF**' ELSE event_type END AS token FROM events), x AS (SELECT *, CAST(sum(CAST(token = '**SOF**' AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM k) SELECT user_id, session, coalesce(string_agg(DISTINCT token, ',' ORDER BY token) FILTER (WHERE token NOT IN ('**SOF**', '**EOF**')), '') AS items FROM x WHERE session > 0 GROUP BY ALL",
    "mode_impute": "WITH o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders), m AS (SELECT o_orderstatus, o_orderpriority AS v FROM o WHERE o_orderpriority IS NOT NULL GROUP BY o_orderstatus, o_orderpriority QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) = 1) SELECT o_orderkey, o.o_orderstatus, coalesce(o_orderpriority, v) AS o_orderpriority FROM o LEFT JOIN m ON o.o_orderstatus = m.o_orderstatus",
    "class_weights": "SELECT o_orderpriority, round(pow(count(*)::DOUBLE + 1, -0.05), 6) AS weight FROM orders GROUP BY ALL",
    "reversed_weights": "WITH s AS (SELECT o_orderpriority, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 4) AS share FROM orders GROUP BY ALL), u AS (SELECT *, row_number() OVER (ORDER BY share, o_orderpriority) AS i FROM s), d AS (SELECT share AS weight, row_number() OVER (ORDER BY share DESC, o_orderpriority DESC) AS i FROM s) SELECT o_orderpriority, n, share, weight FROM u JOIN d ON u.i = d.i",
    "label_shares": "SELECT quality, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM labels), 4) AS share FROM labels GROUP BY ALL",
    "stratified_sample": "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) <= 50",
    "downsample": "WITH s AS (SELECT quality, count(*) AS n FROM labels GROUP BY ALL ORDER BY n, quality LIMIT 1), r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM labels) SELECT doc_id, r.quality, toxic FROM r, s WHERE r.quality = s.quality OR r <= floor(0.5 * n)",
    "stratified_folds": "SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 10 AS INTEGER) AS fold FROM labels",
    "plain_folds": f"SELECT doc_id, {_HB.format(k='doc_id', s='')} % 10 AS fold FROM labels",
    "hash_split": f"SELECT o_orderkey, CASE WHEN {_HB.format(k='o_orderkey', s='split')} % 100 < 80 THEN 'train' ELSE 'test' END AS part FROM orders",
    "fixed_sample": "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 100",
    "latest_rows": "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 200",
    "batch_ids": "SELECT event_id, user_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id::VARCHAR || 'batch'), event_id) - 1) / 16.0) AS BIGINT) AS batch FROM events",
    "confusion": f"WITH {_J} SELECT truth, pred, count(*) AS n FROM j GROUP BY ALL",
    "prf_per_class": f"WITH {_C} SELECT label, gold, predicted, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(f0, 6) AS f FROM h",
    "prf_averages": f"WITH {_C}, a AS (SELECT 'micro' AS average, sum(hits) / sum(predicted)::DOUBLE AS p, sum(hits) / sum(gold)::DOUBLE AS r, 2.0 * sum(hits) / (sum(predicted) + sum(gold)) AS f FROM h UNION ALL SELECT 'macro', avg(p), avg(r), avg(f0) FROM h UNION ALL SELECT 'weighted', sum(p * gold) / sum(gold), sum(r * gold) / sum(gold), sum(f0 * gold) / sum(gold) FROM h) SELECT average, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f FROM a",
    "accuracy": f"WITH {_J} SELECT round(avg(CAST(truth = pred AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM j",
    "auc_rank": f"WITH {_J} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / count(*), 6)::DOUBLE AS auc FROM j a, j b WHERE a.truth = 1 AND b.truth = 0",
    "or_vote": f"WITH {_J} SELECT doc_id, greatest(pred, CAST(score > 0.985 AS INTEGER)) AS pred FROM j",
    "prediction_gaps": "WITH g AS (SELECT DISTINCT doc_id FROM documents), p AS (SELECT DISTINCT doc_id FROM labels) SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, g.doc_id IS NOT NULL AS in_gold, p.doc_id IS NOT NULL AS in_pred FROM g FULL JOIN p ON g.doc_id = p.doc_id WHERE g.doc_id IS NULL OR p.doc_id IS NULL",
    "span_scores": f"WITH {_SP}, x AS (SELECT kind, count(*) AS predicted, (SELECT count(*) FROM h WHERE h.kind = p.kind) AS hits, (SELECT count(*) FROM g WHERE g.kind = p.kind) AS gold FROM p GROUP BY kind) SELECT kind, predicted, hits, gold, {_PRF} FROM x",
    "span_scores_micro": f"WITH {_SP}, x AS (SELECT count(*) AS predicted, (SELECT count(*) FROM h) AS hits, (SELECT count(*) FROM g) AS gold FROM p) SELECT *, {_PRF} FROM x",
    "covariance": f"WITH {_V} SELECT a.dim AS i, b.dim AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY ALL",
    "zscore": f"WITH {_V}, m AS (SELECT dim, avg(x) AS a, stddev_pop(x) AS s FROM v GROUP BY dim) SELECT vec_id, v.dim, round((x - a) / s, 5) AS z FROM v JOIN m ON v.dim = m.dim",
    "min_max": f"WITH {_V}, m AS (SELECT dim, min(x) AS a, max(x) AS b FROM v GROUP BY dim) SELECT vec_id, v.dim, round((x - a) / (b - a), 5) AS z FROM v JOIN m ON v.dim = m.dim",
    "gaussian_nb": f"WITH {_V}, e AS (SELECT * FROM v WHERE vec_id % 5 <> 0), sp AS (SELECT max(q) AS s FROM (SELECT var_pop(x) AS q FROM e GROUP BY dim)), m AS (SELECT label, dim, avg(x) AS m, var_pop(x) + 1e-9 * (SELECT s FROM sp) AS v FROM e GROUP BY ALL), pr AS (SELECT label, ln(count(*)::DOUBLE / (SELECT count(*) FROM embeddings WHERE vec_id % 5 <> 0)) AS prior FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY label), s AS (SELECT v.vec_id, m.label, sum(-0.5 * ln(2 * pi() * m.v) - (x - m.m) * (x - m.m) / (2 * m.v)) AS s FROM v JOIN m ON v.dim = m.dim WHERE v.vec_id % 5 = 0 GROUP BY ALL) SELECT vec_id, s.label AS pred FROM s JOIN pr ON s.label = pr.label QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s + prior, 6) DESC, s.label) = 1",
    "knn_neighbours": f"WITH {_NEAR} SELECT i, j, CAST(rank AS INTEGER) AS rank, round(d2, 4) AS d2 FROM k WHERE rank <= 3",
    "knn_graph": f"WITH {_V}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, round(sum((a.x - b.x) * (a.x - b.x)), 6) AS d2 FROM v a JOIN v b ON a.dim = b.dim WHERE a.vec_id <> b.vec_id GROUP BY ALL), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d2, j) <= 4), e AS (SELECT i AS src, j AS dst, d2 FROM k UNION ALL SELECT j, i, d2 FROM k) SELECT src, dst, round(min(round(sqrt(d2), 6)), 3) AS cost FROM e GROUP BY ALL",
    "knn_classify": f"WITH {_NEAR} SELECT k.i AS vec_id, e.label AS pred FROM k JOIN embeddings e ON k.j = e.vec_id WHERE rank <= 3 GROUP BY k.i, e.label QUALIFY row_number() OVER (PARTITION BY k.i ORDER BY count(*) DESC, e.label) = 1",
    "one_nn_accuracy": f"WITH {_NEAR} SELECT round(avg(CAST(e.label = f.label AS DOUBLE)), 6) AS accuracy FROM k JOIN embeddings e ON k.j = e.vec_id JOIN embeddings f ON k.i = f.vec_id WHERE rank = 1",
    "mds_b_matrix": f"WITH {_V}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM v a JOIN v b ON a.dim = b.dim GROUP BY ALL) SELECT i, j, round(-0.5 * (d2 - avg(d2) OVER (PARTITION BY i) - avg(d2) OVER (PARTITION BY j) + avg(d2) OVER ()), 6) + 0.0::DOUBLE AS b FROM d",
    "nca_objective": f"WITH {_V}, d AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, exp(-sum((a.x - b.x) * (a.x - b.x))) AS e, b.vec_id FROM v a JOIN v b ON a.dim = b.dim WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label, b.vec_id), p AS (SELECT i, sum(CASE WHEN li = lj THEN e ELSE 0.0 END) / sum(e) AS p FROM d GROUP BY i) SELECT round(sum(p), 4) AS objective FROM p",
    "topic_shares": "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT source, sum(n) AS t FROM c GROUP BY source) SELECT c.source, lang, round((n + 0.1::DOUBLE) / (t + (SELECT count(DISTINCT lang) FROM c) * 0.1::DOUBLE), 6) AS share FROM c JOIN t ON c.source = t.source",
    "bio_spans": "WITH r AS (SELECT l_orderkey AS sent_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS pos, CASE WHEN l_quantity > 35 THEN 'B-' || l_returnflag WHEN l_quantity > 15 THEN 'I-' || l_returnflag ELSE 'O' END AS tag FROM lineitem), k AS (SELECT *, CASE WHEN tag = 'O' THEN '' ELSE substr(tag, 3) END AS kind FROM r), n AS (SELECT *, CASE WHEN starts_with(tag, 'I-') AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS nw FROM k WINDOW w AS (PARTITION BY sent_id ORDER BY pos)), u AS (SELECT *, sum(nw) OVER (PARTITION BY sent_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT sent_id, min(pos) AS start, CAST(max(pos) + 1 AS INTEGER) AS \"end\", min(kind) AS kind FROM u WHERE kind <> '' GROUP BY sent_id, run HAVING starts_with(arg_min(tag, pos), 'B-')",
    "lemma_rules": f"WITH {_T}, {_LEM.format(d='', t=_tries())} SELECT wd.word, lemma FROM wd LEFT JOIN best ON wd.word = best.word",
    "lemma_cascade": f"WITH {_T}, {_LEM.format(d='WHERE length(word) <= 5', t=_tries())}, every AS (SELECT word, o, lemma FROM ok UNION ALL SELECT word, 1, substr(word, 1, 4) FROM wd WHERE starts_with(word, 'th') AND length(word) >= 6), least AS (SELECT word, arg_min(lemma, o) AS lemma FROM every GROUP BY word) SELECT wd.word, lemma FROM wd LEFT JOIN least ON wd.word = least.word",
    "missing_words": f"WITH {_T}, {_LEM.format(d='WHERE length(word) <= 5', t=_tries())} SELECT wd.word FROM wd LEFT JOIN best ON wd.word = best.word WHERE lemma IS NULL",
    "token_ids": r"WITH t AS (SELECT item_id, unnest(w) AS token, unnest(range(len(w))) AS place FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS w FROM benchmark)), f AS (SELECT token, min(item_id * 1000000 + place) AS k FROM t GROUP BY token) SELECT token, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS id FROM f",
    "text_predicates": "SELECT doc_id, regexp_matches(text, '[0-9]') AS digits, NOT regexp_matches(text, '[A-Za-z0-9,.!?]') AS acceptable, regexp_matches(text, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]') AS cjk, regexp_matches(text, '^[A-Za-z]+$') AS alphabetic FROM documents",
    "fitted_ids": f"WITH a AS (SELECT doc_id, list_transform(list_slice({_TOK.format(x='text')}, 1, 24), lambda w: length(w)) AS a FROM documents) SELECT doc_id, array_to_string(list_concat(a, list_transform(range(24 - len(a)), lambda x: 0)), ',') AS ids, CAST(len(a) AS BIGINT) AS n FROM a",
    "fitted_pairs": f"WITH a AS (SELECT doc_id, len({_TOK.format(x='text')}) AS a FROM documents), b AS (SELECT doc_id, a, least(a, doc_id % 23 + 1) AS b FROM a), g AS (SELECT *, greatest(a + b - 40, 0) AS o FROM b), f AS (SELECT *, least(o, a - b) AS f, greatest(o - (a - b), 0) AS r FROM g) SELECT doc_id, CAST(a - f - floor(r / 2.0) AS BIGINT) AS first, CAST(b - ceil(r / 2.0) AS BIGINT) AS second FROM f",
    "quorum_index": "SELECT l_orderkey, CAST(list_extract(list_reverse_sort(list(l_linenumber)), CAST(floor(count(*) / 2.0) + 1 AS INTEGER)) AS BIGINT) AS committed FROM lineitem GROUP BY l_orderkey",
    "row_union": "SELECT id, count(*) AS n FROM (SELECT o_custkey AS id FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY id",
    "key_difference": "WITH a AS (SELECT DISTINCT l_partkey % 1009 + 50 AS id FROM lineitem) SELECT id, 'lineitem' AS side FROM (SELECT id FROM a EXCEPT SELECT c_custkey FROM customer) UNION ALL SELECT id, 'customer' FROM (SELECT c_custkey AS id FROM customer EXCEPT SELECT id FROM a)",
    "positional_zip": "WITH o AS (SELECT o_orderkey AS line_no, string_split(o_orderpriority || ' ' || o_orderstatus, ' ') AS a FROM orders) SELECT line_no, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS token, upper(unnest(a)) AS tag FROM o",
    "bellman": "SELECT event_id, round(value + CASE WHEN event_type = 'purchase' THEN 0.0 ELSE 0.99::DOUBLE * (value * 2) END, 4) AS target, CAST(value > 0.985 AS BIGINT) AS decided FROM events",
    "event_windows": _WIN,
    "event_windows_streamed": _WIN,
    "running_mean": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "event_sessions": "WITH x AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s",
}
SQL["looked_up_tokens"] = f"WITH v AS ({SQL['token_ids']}), c AS (SELECT unnest({_TOK.format(x='text')}) AS token FROM conversations) SELECT coalesce(v.id, -1) AS id, coalesce(v.token, '[UNK]') AS token, count(*) AS n FROM c LEFT JOIN v ON c.token = v.token GROUP BY ALL"

from . import sources  # noqa: E402 - its SQL is made of the above

SQL |= sources._sql()
