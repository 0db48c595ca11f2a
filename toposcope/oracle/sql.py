"""DuckDB twins of the registered queries (independent SQL over the same parquet views).

The driver runs these next to the Spark queries and compares row counts, schemas and value
hashes. Conventions that make doubles agree exactly in both engines: integer-quantised
embeddings, and published doubles rounded as ``floor(x * q + 0.5) / q``.
"""

from __future__ import annotations

from ..functions import text as T
from ..functions.numeric import SNAP_OFFSET
from ..plans import params as PR


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rnd(expr: str, q: str = "1e6") -> str:
    """Twin of ``toposcope.functions.numeric.snap``."""
    return f"(floor(({expr}) * {q} + {SNAP_OFFSET!r}) / {q})"


STOPS = "(SELECT unnest([" + ", ".join(lit(w) for w in T.STOP_WORDS) + "]) AS word)"


def clean_expr(text: str) -> str:
    toks = f"regexp_extract_all(coalesce({text}, ''), {lit(T.WORD_PATTERN)})"
    no_punct = f"list_filter({toks}, lambda w: NOT regexp_matches(w, {lit(T.PUNCT_PATTERN)}))"
    low = f"list_transform({no_punct}, lambda w: lower(w))"
    return (f"list_filter({low}, lambda w: NOT regexp_matches(w, {lit(T.digit_pattern())}) "
            f"AND length(w) > 1)")


def ws_expr(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), {lit(T.whitespace_token_pattern())})"


def long_form(src: str, arr: str, keys: str = "doc_id", word: str = "word") -> str:
    """posexplode twin: (keys, pos BIGINT, word) from an array column."""
    return (f"SELECT {keys}, CAST(unnest(range(len({arr}))) AS BIGINT) AS pos, "
            f"unnest({arr}) AS {word} FROM {src}")


# ---------------------------------------------------------------- newsgroup-style preparation

def newsgroup_ctes(min_df: int = PR.MIN_DF, max_df: float = PR.MAX_DF, seed: int = PR.SEED,
                   valid: int = PR.VALID_SIZE) -> str:
    return f"""
corpus AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, 'train' AS subset, text FROM documents
  UNION ALL
  SELECT CAST({PR.TEST_ID_OFFSET} + item_id AS BIGINT) AS doc_id, 'test' AS subset, text FROM benchmark),
perm AS (SELECT doc_id, subset, md5('{seed}:' || CAST(doc_id AS VARCHAR)) AS h FROM corpus),
va AS (SELECT doc_id FROM perm WHERE subset = 'train' ORDER BY h DESC, doc_id DESC LIMIT {valid}),
assigned AS (
  SELECT p.doc_id,
         CASE WHEN p.subset = 'test' THEN 'ts' WHEN va.doc_id IS NOT NULL THEN 'va' ELSE 'tr' END AS split,
         CASE WHEN p.subset = 'test' THEN '' ELSE p.h END AS okey
  FROM perm p LEFT JOIN va USING (doc_id)),
words AS (SELECT c.doc_id, a.split, a.okey, {clean_expr('c.text')} AS words
          FROM corpus c JOIN assigned a USING (doc_id)),
doc_words AS (SELECT DISTINCT doc_id, split, word FROM (SELECT doc_id, split, unnest(words) AS word FROM words)),
dfreq AS (SELECT word, CAST(count(*) AS BIGINT) AS df, bool_or(split = 'tr') AS in_tr FROM doc_words GROUP BY word),
ndocs AS (SELECT count(*) AS n FROM corpus),
pruned AS (SELECT d.* FROM dfreq d, ndocs WHERE d.df >= {min_df} AND d.df <= {max_df} * ndocs.n),
cand AS (SELECT * FROM pruned WHERE word NOT IN (SELECT word FROM {STOPS})),
vocab AS (SELECT CAST(row_number() OVER (ORDER BY df, word) - 1 AS BIGINT) AS token_id, word, df
          FROM cand WHERE in_tr),
toks AS (SELECT doc_id, split, okey, unnest(range(len(words))) AS src_pos, unnest(words) AS word FROM words),
enc AS (SELECT t.doc_id, t.split, t.okey, v.token_id,
               CAST(row_number() OVER (PARTITION BY t.doc_id ORDER BY t.src_pos) - 1 AS BIGINT) AS pos,
               CAST(count(*) OVER (PARTITION BY t.doc_id) AS BIGINT) AS n_tokens
        FROM toks t JOIN vocab v USING (word)),
kept AS (SELECT * FROM enc WHERE split <> 'ts' OR n_tokens > 1),
docix AS (SELECT doc_id, split, okey,
                 CAST(row_number() OVER (PARTITION BY split ORDER BY okey, doc_id) - 1 AS BIGINT) AS doc_ix
          FROM (SELECT DISTINCT doc_id, split, okey FROM kept)),
srows AS (SELECT doc_id, split, pos, token_id FROM kept
          UNION ALL
          SELECT doc_id, CASE WHEN pos < n_tokens // 2 THEN 'ts_h1' ELSE 'ts_h2' END AS split,
                 CASE WHEN pos < n_tokens // 2 THEN pos ELSE pos - n_tokens // 2 END AS pos, token_id
          FROM kept WHERE split = 'ts'),
bow AS (SELECT s.split, d.doc_ix, s.token_id, CAST(count(*) AS BIGINT) AS cnt
        FROM srows s JOIN docix d USING (doc_id) GROUP BY s.split, d.doc_ix, s.token_id),
packed AS (SELECT split, doc_ix, list(token_id ORDER BY token_id) AS tokens,
                  list(cnt ORDER BY token_id) AS counts FROM bow GROUP BY split, doc_ix)"""


def with_ng(body: str) -> str:
    return "WITH " + newsgroup_ctes() + "\n" + body


# ---------------------------------------------------------------- lines-style preparation

def lines_ctes(seed: int = PR.SEED) -> str:
    return f"""
wstoks AS (SELECT doc_id, {ws_expr('text')} AS toks FROM documents),
dict_counts AS (SELECT word, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(toks) AS word FROM wstoks) GROUP BY word),
dictionary AS (SELECT CAST(row_number() OVER (ORDER BY cnt DESC, word) - 1 AS BIGINT) AS id, word, cnt FROM dict_counts),
lvocab AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS token_id, word
           FROM dictionary WHERE word NOT IN (SELECT word FROM {STOPS})),
lperm AS (SELECT doc_id, md5('{seed}:' || CAST(doc_id AS VARCHAR)) AS okey,
                 row_number() OVER (ORDER BY md5('{seed}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r,
                 count(*) OVER () AS n FROM documents),
lassigned AS (SELECT doc_id, okey,
                     CASE WHEN r < floor(0.85 * n) THEN 'tr'
                          WHEN r < floor(0.85 * n) + floor(0.10 * n) THEN 'ts' ELSE 'va' END AS split FROM lperm),
ltoks AS (SELECT doc_id, unnest(range(len(toks))) AS src_pos, unnest(toks) AS word FROM wstoks),
lenc AS (SELECT t.doc_id, a.split, a.okey, v.token_id,
                CAST(row_number() OVER (PARTITION BY t.doc_id ORDER BY t.src_pos) - 1 AS BIGINT) AS pos,
                CAST(count(*) OVER (PARTITION BY t.doc_id) AS BIGINT) AS n_tokens
         FROM ltoks t JOIN lvocab v USING (word) JOIN lassigned a USING (doc_id)),
lkept AS (SELECT * FROM lenc WHERE split <> 'ts' OR n_tokens > 1),
ldocix AS (SELECT doc_id, split,
                  CAST(row_number() OVER (PARTITION BY split ORDER BY okey, doc_id) - 1 AS BIGINT) AS doc_ix
           FROM (SELECT DISTINCT doc_id, split, okey FROM lkept)),
lsrows AS (SELECT doc_id, split, token_id FROM lkept
           UNION ALL
           SELECT doc_id, CASE WHEN pos < n_tokens // 2 THEN 'ts_h1' ELSE 'ts_h2' END, token_id
           FROM lkept WHERE split = 'ts'),
lbow AS (SELECT s.split, d.doc_ix, s.token_id, CAST(count(*) AS BIGINT) AS cnt
         FROM lsrows s JOIN ldocix d USING (doc_id) GROUP BY s.split, d.doc_ix, s.token_id)"""


def with_lines(body: str) -> str:
    return "WITH " + lines_ctes() + "\n" + body


def preparation_sql() -> dict[str, str]:
    clean = clean_expr("text")
    toks = f"regexp_extract_all(coalesce(text, ''), {lit(T.WORD_PATTERN)})"
    p1 = f"({long_form('documents', toks)})"
    q: dict[str, str] = {}
    q["read_corpus"] = with_ng("SELECT doc_id, subset, text FROM corpus")
    q["read_lines"] = (
        "SELECT CAST(row_number() OVER (ORDER BY doc_id, line_no) - 1 AS BIGINT) AS doc_id, line AS text FROM ("
        "SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM ("
        "SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r') AS ls FROM documents))")
    q["read_stops"] = f"SELECT DISTINCT unnest({ws_expr('text')}) AS word FROM benchmark"
    q["read_dictionary"] = with_lines("SELECT id, word, cnt FROM dictionary")
    q["read_vectors"] = (
        "SELECT 'v' || CAST(label AS VARCHAR) || 'x' || CAST(vec_id // 2 AS VARCHAR) AS word, "
        f"arg_max(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {PR.QUANT} + 0.5)), vec_id) AS vec "
        "FROM embeddings GROUP BY 1")
    q["tokenize_regex"] = long_form("documents", toks)
    q["tokenize_whitespace"] = long_form("documents", ws_expr("text"))
    q["tokenize_word2"] = long_form(
        "documents", f"regexp_extract_all(lower(coalesce(text, '')), {lit(T.WORD2_PATTERN)})")
    q["drop_punct_tokens"] = (f"SELECT doc_id, pos, word FROM {p1} "
                              f"WHERE NOT regexp_matches(word, {lit(T.PUNCT_PATTERN)})")
    q["lowercase"] = f"SELECT doc_id, pos, lower(word) AS word FROM {p1}"
    q["drop_numeric_tokens"] = (f"SELECT doc_id, pos, lower(word) AS word FROM {p1} "
                                f"WHERE NOT regexp_matches(word, {lit(T.PUNCT_PATTERN)}) "
                                f"AND NOT regexp_matches(lower(word), {lit(T.digit_pattern())})")
    q["drop_short_tokens"] = f"SELECT doc_id, pos, word FROM {p1} WHERE length(word) > 1"
    q["clean_tokens"] = long_form(f"(SELECT doc_id, {clean} AS words FROM documents)", "words")
    q["rejoin_text"] = f"SELECT doc_id, array_to_string({clean}, ' ') AS clean_text FROM documents"
    q["concat_subsets"] = with_ng(
        "SELECT c.doc_id, c.subset, array_to_string(w.words, ' ') AS clean_text "
        "FROM corpus c JOIN words w USING (doc_id)")
    q["document_frequency"] = with_ng("SELECT word, df FROM dfreq")
    q["df_range_filter"] = with_ng("SELECT word, df FROM pruned")
    q["remove_stops"] = with_ng("SELECT word, df FROM cand")
    q["order_vocab_by_df"] = with_ng(
        "SELECT CAST(row_number() OVER (ORDER BY df, word) - 1 AS BIGINT) AS rank, word, df FROM cand")
    q["distinct_train_words"] = with_ng("SELECT DISTINCT word FROM doc_words WHERE split = 'tr'")
    q["vocab_in_train"] = with_ng("SELECT word, df FROM cand WHERE in_tr")
    q["assign_ids"] = with_ng("SELECT token_id, word, df FROM vocab")
    q["vocab_report"] = with_ng(
        "SELECT CAST(0 AS BIGINT) AS stage_no, 'initial' AS stage, CAST(count(*) AS BIGINT) AS size FROM pruned "
        "UNION ALL SELECT 1, 'after_stops', CAST(count(*) AS BIGINT) FROM cand "
        "UNION ALL SELECT 2, 'in_train', CAST(count(*) AS BIGINT) FROM vocab")
    q["split_holdout"] = with_ng("SELECT doc_id, split FROM assigned")
    q["encode_tokens"] = with_ng("SELECT doc_id, pos, token_id, n_tokens FROM enc")
    q["drop_empty_docs"] = with_ng("SELECT DISTINCT doc_id, split FROM enc")
    q["drop_single_token_tests"] = with_ng("SELECT DISTINCT doc_id, split FROM kept")
    q["reindex_docs"] = with_ng("SELECT doc_id, split, doc_ix FROM docix")
    q["split_halves"] = with_ng(
        "SELECT doc_id, split AS half, pos, token_id FROM srows WHERE split IN ('ts_h1', 'ts_h2')")
    q["bag_of_words"] = with_ng("SELECT split, doc_ix, token_id, cnt FROM bow")
    q["pack_bow"] = with_ng("SELECT split, doc_ix, tokens, counts FROM packed")
    q["unpack_bow"] = with_ng("SELECT split, doc_ix, token_id, cnt FROM bow")
    q["doc_lengths"] = with_ng(
        "SELECT split, doc_ix, CAST(sum(cnt) AS BIGINT) AS n_words FROM bow GROUP BY split, doc_ix")
    q["flatten_words"] = with_ng(
        "SELECT s.split, d.doc_ix, s.pos, s.token_id FROM srows s JOIN docix d USING (doc_id)")
    q["split_report"] = with_ng(
        "SELECT split, CAST(count(DISTINCT doc_ix) AS BIGINT) AS n_docs, CAST(sum(cnt) AS BIGINT) AS n_words, "
        "count(DISTINCT doc_ix) = max(doc_ix) + 1 AS dense FROM bow GROUP BY split")
    q["normalize_bow"] = with_ng(
        f"SELECT split, doc_ix, token_id, {rnd('cnt / sum(cnt) OVER (PARTITION BY split, doc_ix)')} AS weight "
        "FROM bow")
    q["bow_store"] = q["pack_bow"]
    q["vocab_store"] = q["assign_ids"]
    q["prepare_newsgroup_style"] = with_ng(
        "SELECT b.split, b.doc_ix, v.word, b.cnt FROM bow b JOIN vocab v USING (token_id)")
    q["split_fractions"] = with_lines("SELECT doc_id, split FROM lassigned")
    q["dictionary_to_vocab"] = with_lines("SELECT token_id, word FROM lvocab")
    q["prepare_lines_style"] = with_lines("SELECT split, doc_ix, token_id, cnt FROM lbow")
    return q


# ---------------------------------------------------------------- model fixtures and scoring

def cell(name: str, i: str, j: str) -> str:
    h = f"CAST(('0x' || substr(md5('{name}:' || CAST({i} AS VARCHAR) || ':' || CAST({j} AS VARCHAR)), 1, 12)) AS BIGINT)"
    return f"(CAST(({h} % 2001) - 1000 AS DOUBLE) / 1000.0)"


def hash48(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 12)) AS BIGINT)"


def normal(keyexpr: str) -> str:
    u = f"((CAST({hash48(keyexpr + " || ':u'")} AS DOUBLE) + 1.0) / (281474976710656.0 + 1.0))"
    v = f"(CAST({hash48(keyexpr + " || ':v'")} AS DOUBLE) / 281474976710656.0)"
    return f"(sqrt(-2.0 * ln({u})) * cos({2 * 3.141592653589793!r} * {v}))"


def idot(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i])) AS BIGINT)"


def model_ctes(hidden: int = PR.HIDDEN) -> str:
    H = hidden
    return f""",
emb AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS INTEGER) AS label,
               list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {PR.QUANT} + 0.5) AS BIGINT)) AS qvec
        FROM embeddings),
nvec AS (SELECT count(*) AS n FROM emb),
rho AS (SELECT v.token_id, e.qvec FROM vocab v CROSS JOIN nvec JOIN emb e ON e.vec_id = v.token_id % nvec.n),
alpha AS (SELECT label AS topic, list(s ORDER BY d) AS qsum
          FROM (SELECT label, d, CAST(sum(q) AS BIGINT) AS s
                FROM (SELECT label, unnest(range(len(qvec))) AS d, unnest(qvec) AS q FROM emb)
                GROUP BY label, d)
          GROUP BY label),
lg AS (SELECT a.topic, r.token_id, {idot('r.qvec', 'a.qsum')} AS dot FROM rho r CROSS JOIN alpha a),
mx AS (SELECT topic, max(dot) AS m FROM lg GROUP BY topic),
ex AS (SELECT lg.topic, lg.token_id, lg.dot, exp(CAST(lg.dot - mx.m AS DOUBLE) / 1e13) AS e
       FROM lg JOIN mx USING (topic)),
beta AS (SELECT topic, token_id, dot, e / sum(e) OVER (PARTITION BY topic) AS p FROM ex),
hj AS (SELECT range AS j FROM range({H})),
kj AS (SELECT DISTINCT topic AS j FROM alpha),
w1 AS (SELECT v.token_id, hj.j, {cell('W1', 'v.token_id', 'hj.j')} AS w FROM vocab v CROSS JOIN hj),
b1 AS (SELECT j, {cell('b1', '0', 'j')} AS b FROM hj),
w2 AS (SELECT a.j AS i, b.j AS j, {cell('W2', 'a.j', 'b.j')} AS w FROM hj a CROSS JOIN hj b),
b2 AS (SELECT j, {cell('b2', '0', 'j')} AS b FROM hj),
wmu AS (SELECT a.j AS i, b.j AS k, {cell('Wmu', 'a.j', 'b.j')} AS w FROM hj a CROSS JOIN kj b),
bmu AS (SELECT j AS k, {cell('bmu', '0', 'j')} AS b FROM kj),
wsg AS (SELECT a.j AS i, b.j AS k, {cell('Ws', 'a.j', 'b.j')} AS w FROM hj a CROSS JOIN kj b),
bsg AS (SELECT j AS k, {cell('bs', '0', 'j')} AS b FROM kj),
xw AS (SELECT split, doc_ix, token_id, CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY split, doc_ix) AS x
       FROM bow WHERE split IN ('tr', 'va', 'ts', 'ts_h1')),
a1 AS (SELECT x.split, x.doc_ix, w1.j, sum(x.x * w1.w) AS s FROM xw x JOIN w1 USING (token_id)
       GROUP BY x.split, x.doc_ix, w1.j),
h1 AS (SELECT a1.split, a1.doc_ix, a1.j, greatest(b1.b + a1.s, 0.0) AS h FROM a1 JOIN b1 USING (j)),
a2 AS (SELECT h1.split, h1.doc_ix, w2.j, sum(h1.h * w2.w) AS s FROM h1 JOIN w2 ON h1.j = w2.i
       GROUP BY h1.split, h1.doc_ix, w2.j),
h2 AS (SELECT a2.split, a2.doc_ix, a2.j, greatest(a2.s + b2.b, 0.0) AS h FROM a2 JOIN b2 USING (j)),
mu0 AS (SELECT h2.split, h2.doc_ix, wm.k, sum(h2.h * wm.w) AS s FROM h2 JOIN wmu wm ON h2.j = wm.i
        GROUP BY h2.split, h2.doc_ix, wm.k),
mu AS (SELECT m.split, m.doc_ix, m.k AS topic, m.s + b.b AS mu FROM mu0 m JOIN bmu b USING (k)),
ls0 AS (SELECT h2.split, h2.doc_ix, ws.k, sum(h2.h * ws.w) AS s FROM h2 JOIN wsg ws ON h2.j = ws.i
        GROUP BY h2.split, h2.doc_ix, ws.k),
ls AS (SELECT m.split, m.doc_ix, m.k AS topic, m.s + b.b AS logsigma FROM ls0 m JOIN bsg b USING (k)),
enc_out AS (SELECT m.split, m.doc_ix, m.topic, m.mu, l.logsigma FROM mu m JOIN ls l USING (split, doc_ix, topic)),
emx AS (SELECT split, doc_ix, topic, mu, logsigma, exp(mu - max(mu) OVER (PARTITION BY split, doc_ix)) AS e
        FROM enc_out),
theta AS (SELECT split, doc_ix, topic, mu, logsigma, e / sum(e) OVER (PARTITION BY split, doc_ix) AS theta FROM emx),
kl AS (SELECT split, doc_ix, -0.5 * sum(1.0 + logsigma - mu * mu - exp(logsigma)) AS kl
       FROM theta GROUP BY split, doc_ix),
probs AS (SELECT b.split, b.doc_ix, b.token_id, b.cnt, sum(t.theta * be.p) AS p
          FROM bow b JOIN beta be ON be.token_id = b.token_id
          JOIN theta t ON t.split = b.split AND t.doc_ix = b.doc_ix AND t.topic = be.topic
          WHERE b.split IN ('tr', 'va', 'ts')
          GROUP BY b.split, b.doc_ix, b.token_id, b.cnt),
rec AS (SELECT split, doc_ix, -sum(cnt * ln(p + 1e-6)) AS rec FROM probs GROUP BY split, doc_ix),
elbo AS (SELECT r.split, r.doc_ix, r.rec, k.kl, r.rec + k.kl AS nelbo FROM rec r JOIN kl k USING (split, doc_ix)),
h2probs AS (SELECT b.doc_ix, b.cnt, sum(t.theta * be.p) AS p
            FROM bow b JOIN beta be ON be.token_id = b.token_id
            JOIN theta t ON t.split = 'ts_h1' AND t.doc_ix = b.doc_ix AND t.topic = be.topic
            WHERE b.split = 'ts_h2' GROUP BY b.doc_ix, b.token_id, b.cnt),
ppl_doc AS (SELECT doc_ix, -sum(cnt * ln(p)) / sum(cnt) AS loss FROM h2probs GROUP BY doc_ix),
ppl AS (SELECT avg(loss) AS loss FROM (SELECT floor(doc_ix / {PR.EVAL_BATCH}) AS b, avg(loss) AS loss FROM ppl_doc GROUP BY b)),
usage AS (SELECT t.topic, avg(t.theta) AS mean, sum(l.n * t.theta) / sum(l.n) AS weighted
          FROM theta t JOIN (SELECT doc_ix, sum(cnt) AS n FROM bow WHERE split = 'tr' GROUP BY doc_ix) l
          ON t.doc_ix = l.doc_ix WHERE t.split = 'tr' GROUP BY t.topic)"""


def coherence_ctes(n: int = PR.TOP_WORDS) -> str:
    return f""",
top10 AS (SELECT topic, token_id, rank FROM (SELECT topic, token_id,
              row_number() OVER (PARTITION BY topic ORDER BY dot DESC, token_id) - 1 AS rank FROM beta)
          WHERE rank < {n}),
trdocs AS (SELECT DISTINCT doc_ix, token_id FROM bow WHERE split = 'tr'),
ntr AS (SELECT count(DISTINCT doc_ix) AS n FROM trdocs),
dfw AS (SELECT t.topic, t.rank, count(d.doc_ix) AS d FROM top10 t LEFT JOIN trdocs d USING (token_id) GROUP BY t.topic, t.rank),
prs AS (SELECT a.topic, a.rank AS i, b.rank AS j, a.token_id AS wi, b.token_id AS wj
        FROM top10 a JOIN top10 b ON a.topic = b.topic AND a.rank < b.rank),
co AS (SELECT p.topic, p.i, p.j, count(d2.doc_ix) AS dij
       FROM prs p LEFT JOIN trdocs d1 ON d1.token_id = p.wi
       LEFT JOIN trdocs d2 ON d2.token_id = p.wj AND d2.doc_ix = d1.doc_ix
       GROUP BY p.topic, p.i, p.j),
f AS (SELECT co.topic,
             CASE WHEN co.dij = 0 THEN -1.0
                  WHEN co.dij = ntr.n THEN 1.0
                  ELSE (ln(co.dij / ntr.n) - ln(di.d / ntr.n) - ln(dj.d / ntr.n)) / (-ln(co.dij / ntr.n)) END AS f
      FROM co CROSS JOIN ntr JOIN dfw di ON di.topic = co.topic AND di.rank = co.i
      JOIN dfw dj ON dj.topic = co.topic AND dj.rank = co.j),
coh AS (SELECT topic, avg(f) AS coherence FROM f GROUP BY topic)"""


def with_model(body: str, coherence: bool = False) -> str:
    return ("WITH " + newsgroup_ctes() + model_ctes() + (coherence_ctes() if coherence else "")
            + "\n" + body)


def model_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["topic_word_dist"] = with_model(f"SELECT topic, token_id, dot, {rnd('p', '1e12')} AS p FROM beta")
    q["topic_top_words"] = with_model(
        "SELECT t.topic, t.rank, t.token_id, v.word FROM (SELECT topic, token_id, "
        "CAST(row_number() OVER (PARTITION BY topic ORDER BY dot DESC, token_id) - 1 AS BIGINT) AS rank FROM beta) t "
        f"JOIN vocab v USING (token_id) WHERE t.rank < {PR.NUM_WORDS - 1}")
    q["decode_ids"] = with_ng(
        "SELECT b.split, b.doc_ix, b.token_id, v.word, b.cnt FROM bow b JOIN vocab v USING (token_id)")
    q["topic_diversity"] = with_model(
        f"SELECT {rnd('count(DISTINCT token_id) / (' + str(PR.DIVERSITY_WORDS) + ' * count(DISTINCT topic))')} AS diversity "
        "FROM (SELECT topic, token_id, row_number() OVER (PARTITION BY topic ORDER BY dot DESC, token_id) AS r FROM beta) "
        f"WHERE r <= {PR.DIVERSITY_WORDS}")
    neighbours = (
        "SELECT query_id, rank, token_id, cos FROM ("
        "SELECT qw.token_id AS query_id, r.token_id, "
        f"CAST({idot('qw.qvec', 'r.qvec')} AS DOUBLE) / (sqrt(CAST({idot('qw.qvec', 'qw.qvec')} AS DOUBLE)) * sqrt(CAST({idot('r.qvec', 'r.qvec')} AS DOUBLE))) AS cos, "
        f"CAST(row_number() OVER (PARTITION BY qw.token_id ORDER BY CAST({idot('qw.qvec', 'r.qvec')} AS DOUBLE) / (sqrt(CAST({idot('qw.qvec', 'qw.qvec')} AS DOUBLE)) * sqrt(CAST({idot('r.qvec', 'r.qvec')} AS DOUBLE))) DESC, r.token_id) - 1 AS BIGINT) AS rank "
        "FROM (SELECT r2.token_id, r2.qvec FROM (SELECT token_id FROM vocab ORDER BY df DESC, word LIMIT 12) qv JOIN rho r2 USING (token_id)) qw "
        f"CROSS JOIN rho r) WHERE rank < {PR.NEIGHBOURS}")
    q["nearest_words"] = with_model(
        "SELECT query_id, rank, token_id, " + rnd("cos", "1e9") + f" AS cos FROM ({neighbours})")
    q["encode_docs"] = with_model(
        f"SELECT split, doc_ix, topic, {rnd('mu', '1e9')} AS mu, {rnd('logsigma', '1e9')} AS logsigma "
        "FROM enc_out WHERE split IN ('tr', 'va', 'ts')")
    q["infer_theta"] = with_model(
        f"SELECT split, doc_ix, topic, {rnd('theta', '1e9')} AS theta FROM theta WHERE split IN ('tr', 'va', 'ts')")
    q["softmax"] = with_model(
        f"SELECT split, doc_ix, topic, {rnd('theta', '1e9')} AS theta FROM theta WHERE split IN ('tr', 'va', 'ts')")
    z = f"mu + {normal(f'{PR.SEED!r} || ' + chr(39) + ':0:' + chr(39) + ' || CAST(doc_ix AS VARCHAR) || ' + chr(39) + ':' + chr(39) + ' || CAST(topic AS VARCHAR)')} * exp(logsigma * 0.5)"
    q["reparameterize"] = with_model(
        f"SELECT split, doc_ix, topic, {rnd(z)} AS z FROM theta WHERE split = 'tr'")
    q["kl_divergence"] = with_model(
        f"SELECT split, {rnd('avg(kl)')} AS kl FROM kl WHERE split IN ('tr', 'va', 'ts') GROUP BY split")
    q["reconstruction_loss"] = with_model(f"SELECT split, doc_ix, {rnd('rec')} AS rec FROM elbo")
    q["elbo_forward"] = with_model(
        f"SELECT split, doc_ix, {rnd('rec')} AS rec, {rnd('kl')} AS kl, {rnd('nelbo')} AS nelbo FROM elbo")
    q["nelbo"] = with_model(
        f"SELECT split, {rnd('avg(rec)')} AS rec, {rnd('avg(kl)')} AS kl, {rnd('avg(rec) + avg(kl)')} AS nelbo "
        "FROM elbo GROUP BY split")
    q["theta_beta_join"] = with_model(
        f"SELECT split, doc_ix, token_id, cnt, {rnd('p', '1e12')} AS p FROM probs")
    q["doc_completion_ppl"] = with_model(
        f"SELECT {rnd('loss')} AS loss, round(exp(loss) * 10) / 10 AS ppl FROM ppl")
    q["topic_usage"] = with_model(f"SELECT topic, {rnd('mean', '1e9')} AS mean FROM usage")
    q["topic_usage_weighted"] = with_model(f"SELECT topic, {rnd('weighted', '1e9')} AS weighted FROM usage")
    q["top_used_topics"] = with_model(
        f"SELECT topic, {rnd('weighted', '1e9')} AS weighted FROM usage ORDER BY weighted DESC, topic LIMIT 10")
    q["topic_coherence"] = with_model(
        f"SELECT CAST(topic AS BIGINT) AS topic, {rnd('coherence')} AS coherence FROM coh "
        f"UNION ALL SELECT -1, {rnd('avg(coherence)')} FROM coh", coherence=True)
    q["eval_report"] = with_model(
        "SELECT metric, CAST(key AS BIGINT) AS key, " + rnd("value") + " AS value FROM ("
        "SELECT 'ppl' AS metric, -1 AS key, round(exp(loss) * 10) / 10 AS value FROM ppl "
        "UNION ALL SELECT 'coherence', topic, coherence FROM coh "
        "UNION ALL SELECT 'coherence', -1, avg(coherence) FROM coh "
        f"UNION ALL SELECT 'diversity', -1, count(DISTINCT token_id) / ({PR.DIVERSITY_WORDS} * count(DISTINCT topic)) "
        "FROM (SELECT topic, token_id, row_number() OVER (PARTITION BY topic ORDER BY dot DESC, token_id) AS r FROM beta) "
        f"WHERE r <= {PR.DIVERSITY_WORDS} "
        "UNION ALL SELECT 'usage_weighted', topic, weighted FROM usage "
        "UNION ALL SELECT 'top_used', row_number() OVER (ORDER BY weighted DESC, topic) - 1, topic FROM "
        "(SELECT topic, weighted FROM usage ORDER BY weighted DESC, topic LIMIT 10) "
        "UNION ALL SELECT 'top_word', topic * 1000 + rank, token_id FROM (SELECT topic, token_id, "
        "row_number() OVER (PARTITION BY topic ORDER BY dot DESC, token_id) - 1 AS rank FROM beta) "
        f"WHERE rank < {PR.NUM_WORDS - 1} "
        "UNION ALL SELECT 'neighbour', query_id * 1000 + rank, token_id FROM (" + neighbours + "))", coherence=True)
    q["sample_topics"] = (
        "WITH " + model_ctes().lstrip(",\n").split("rho AS")[0].rstrip().rstrip(",") + ",\n"
        "alpha AS (SELECT DISTINCT label AS topic FROM emb),\n"
        "pos AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS pos FROM alpha),\n"
        "k AS (SELECT count(*) AS k FROM alpha)\n"
        f"SELECT d.range AS draw, p.topic FROM range(10) d CROSS JOIN k "
        f"JOIN pos p ON p.pos = {hash48(chr(39) + str(PR.SEED) + ':sample:' + chr(39) + ' || CAST(d.range AS VARCHAR)')} % k.k")
    acts = {
        "tanh": "tanh(x)",
        "relu": "greatest(x, 0.0)",
        "softplus": "CASE WHEN x > 20.0 THEN x ELSE ln(1 + exp(x)) END",
        "rrelu": f"CASE WHEN x >= 0 THEN x ELSE x * {(1.0 / 8.0 + 1.0 / 3.0) / 2.0!r} END",
        "leakyrelu": "CASE WHEN x >= 0 THEN x ELSE x * 0.01 END",
        "elu": "CASE WHEN x > 0 THEN x ELSE 1.0 * (exp(x) - 1) END",
        "selu": "1.0507009873554805 * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772 * (exp(x) - 1) END",
    }
    q["activation"] = " UNION ALL ".join(
        f"SELECT event_id, '{n}' AS act, {rnd(e, '1e9')} AS y FROM (SELECT event_id, (value - 25.0) / 10.0 AS x FROM events)"
        for n, e in acts.items())
    raw = (", rawvec AS (SELECT d.word, e.qvec FROM dfreq d CROSS JOIN nvec "
           f"JOIN emb e ON e.vec_id = {hash48('d.word')} % nvec.n WHERE {hash48('d.word')} % 2 = 0), "
           "vin AS (SELECT r.word, list_transform(r.qvec, lambda q: q / 1000000.0) AS vec FROM rawvec r WHERE r.word IN (SELECT word FROM vocab)), "
           "init AS (SELECT v.token_id, v.word, vi.vec IS NOT NULL AS hit, "
           "coalesce(vi.vec, list_transform(range(64), lambda d: "
           + normal(f"'{PR.SEED}:' || CAST(v.token_id AS VARCHAR) || ':' || CAST(d AS VARCHAR)") + " * 0.6)) AS vec "
           "FROM vocab v LEFT JOIN vin vi USING (word))")
    base = "WITH " + newsgroup_ctes() + model_ctes().split("rho AS")[0].rstrip().rstrip(",") + raw + "\n"
    q["vectors_in_vocab"] = base + "SELECT word, vec FROM vin"
    q["init_embeddings"] = base + "SELECT token_id, word, hit, list_transform(vec, lambda x: " + rnd("x") + ") AS vec FROM init"
    q["embedding_coverage"] = base + (
        "SELECT CAST(sum(CAST(hit AS BIGINT)) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS vocab_size, "
        + rnd("avg(CAST(hit AS DOUBLE))") + " AS share FROM init")
    return q


# ---------------------------------------------------------------- sentences, parallel text, logs

def sentence_ctes() -> str:
    """Sentence tables over the newsgroup vocabulary and the documents dictionary."""
    model = model_ctes().split("alpha AS")[0].rstrip().rstrip(",")
    return (newsgroup_ctes() + model + ",\n" + lines_ctes().split("lvocab AS")[0].rstrip().rstrip(",") + f""",
sents AS (SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS sent_id, conv_id, turn, role, text FROM conversations),
ndict AS (SELECT count(*) AS n FROM dictionary),
stoks AS (SELECT s.sent_id, CAST(s.pos AS BIGINT) AS pos, CAST(coalesce(d.id, ndict.n) AS BIGINT) AS tok
          FROM (SELECT sent_id, unnest(range(len(t))) AS pos, unnest(t) AS word
                FROM (SELECT sent_id, {ws_expr('text')} AS t FROM sents)) s
          LEFT JOIN dictionary d USING (word) CROSS JOIN ndict),
firstv AS (SELECT word, min(token_id) AS token_id FROM vocab GROUP BY word),
mapped AS (SELECT t.sent_id, t.pos, t.tok, f.token_id FROM stoks t JOIN dictionary d ON d.id = t.tok
           JOIN firstv f ON f.word = d.word),
stc AS (SELECT sent_id, token_id, count(*) AS c FROM mapped GROUP BY sent_id, token_id),
sdim AS (SELECT s.sent_id, u.d, CAST(sum(u.q * s.c) AS BIGINT) AS q
         FROM stc s JOIN (SELECT token_id, unnest(range(len(qvec))) AS d, unnest(qvec) AS q FROM rho) u USING (token_id)
         GROUP BY s.sent_id, u.d),
sq AS (SELECT sent_id, list(q ORDER BY d) AS qsum FROM sdim GROUP BY sent_id),
svec AS (SELECT s.sent_id, coalesce(q.qsum, list_transform(range(64), lambda i: CAST(0 AS BIGINT))) AS qsum
         FROM (SELECT DISTINCT sent_id FROM sents) s LEFT JOIN sq q USING (sent_id)),
tw AS (SELECT j, list(m ORDER BY d) AS wrow FROM (
         SELECT a.range AS j, b.range AS d,
                CAST(('0x' || substr(md5('T:' || CAST(b.range AS VARCHAR) || ':' || CAST(a.range AS VARCHAR)), 1, 12)) AS BIGINT) % 2001 - 1000 AS m
         FROM range(64) a CROSS JOIN range(64) b) GROUP BY j),
tb AS (SELECT range AS j, {cell('Tb', '0', 'range')} AS b FROM range(64)),
twl AS (SELECT list(w.wrow ORDER BY w.j) AS ws, list(tb.b ORDER BY w.j) AS bs FROM tw w JOIN tb ON tb.j = w.j),
projq AS (SELECT q.qsum, list_transform(range(1, 65), lambda k: CAST({idot('t.ws[k]', 'q.qsum')} AS DOUBLE) / {float(PR.QUANT) * 1000.0!r} + t.bs[k]) AS proj
          FROM (SELECT DISTINCT qsum FROM svec) q CROSS JOIN twl t),
proj AS (SELECT s.sent_id, p.proj FROM svec s JOIN projq p USING (qsum)),
st0 AS (SELECT t.sent_id, t.pos, list_transform(e.qvec, lambda q: q / {float(PR.QUANT)!r}) AS x
        FROM stoks t CROSS JOIN nvec JOIN emb e ON e.vec_id = t.tok % nvec.n),
st1 AS (SELECT t.sent_id, t.pos, list_transform(e.qvec, lambda q: q / {float(PR.QUANT)!r}) AS x
        FROM stoks t CROSS JOIN nvec JOIN emb e ON e.vec_id = (t.tok + 1) % nvec.n)""")


def vadd(a: str, b: str, q: str = "1e9") -> str:
    return f"list_transform(range(1, len({a}) + 1), lambda i: {rnd(a + '[i] + ' + b + '[i]', q)})"


def vsnap(a: str, q: str = "1e9") -> str:
    return f"list_transform({a}, lambda v: {rnd('v', q)})"


def sentence_sql() -> dict[str, str]:
    w = "WITH " + sentence_ctes() + "\n"
    q: dict[str, str] = {}
    q["dict_to_topic_id"] = w + "SELECT sent_id, pos, tok, token_id FROM mapped"
    q["sentence_topic_vector"] = w + f"SELECT sent_id, list_transform(qsum, lambda v: v / {float(PR.QUANT)!r}) AS vec FROM svec"
    q["project_topic"] = w + f"SELECT sent_id, {vsnap('proj')} AS proj FROM proj"
    q["add_topic_pre"] = w + f"SELECT s.sent_id, s.pos, {vadd('s.x', 'p.proj')} AS x FROM st0 s JOIN proj p USING (sent_id)"
    q["add_topic_post"] = w + f"SELECT s.sent_id, s.pos, {vadd('s.x', 'p.proj')} AS x FROM st1 s JOIN proj p USING (sent_id)"
    q["add_topic_decoder"] = w + (
        f"SELECT s.sent_id, s.pos, {vadd('s.x', 'v.vec')} AS x FROM st0 s JOIN "
        f"(SELECT sent_id, list_transform(qsum, lambda v: v / {float(PR.QUANT)!r}) AS vec FROM svec) v USING (sent_id)")
    q["add_topic_decoder_step"] = w + (
        "SELECT s.sent_id, s.pos, CASE WHEN t.tv IS NULL THEN " + vsnap("s.x") + " ELSE " + vadd("s.x", "t.tv") + " END AS x "
        f"FROM st0 s LEFT JOIN (SELECT m.sent_id, m.pos, list_transform(r.qvec, lambda v: v / {float(PR.QUANT)!r}) AS tv "
        "FROM mapped m JOIN rho r USING (token_id)) t USING (sent_id, pos)")
    q["topic_mode"] = w + (
        f"SELECT 'encoder_in' AS stage, s.sent_id, s.pos, {vadd('s.x', 'p.proj')} AS x FROM st0 s JOIN proj p USING (sent_id) "
        f"UNION ALL SELECT 'encoder_out', s.sent_id, s.pos, {vadd('s.x', 'p.proj')} FROM st1 s JOIN proj p USING (sent_id) "
        f"UNION ALL SELECT 'decoder', s.sent_id, s.pos, {vadd('s.x', 'v.vec')} FROM st0 s JOIN "
        f"(SELECT sent_id, list_transform(qsum, lambda v: v / {float(PR.QUANT)!r}) AS vec FROM svec) v USING (sent_id)")
    # Binarised tokens (offset 4, unknown = 3, end mark 2), mapped back with offset 4
    x3 = sentence_ctes().replace(
        "mapped AS (SELECT t.sent_id, t.pos, t.tok, f.token_id FROM stoks t JOIN dictionary d ON d.id = t.tok",
        "mapped AS (SELECT t.sent_id, t.pos, t.tok, f.token_id FROM stoks t JOIN dictionary d ON d.id = t.tok - 4")
    x3 = x3.replace(
        "CAST(coalesce(d.id, ndict.n) AS BIGINT) AS tok",
        "CAST(coalesce(d.id + 4, 3) AS BIGINT) AS tok")
    x3 = x3.replace(
        "          LEFT JOIN dictionary d USING (word) CROSS JOIN ndict),",
        "          LEFT JOIN dictionary d USING (word) CROSS JOIN ndict\n"
        f"          UNION ALL SELECT sent_id, CAST(len({ws_expr('text')}) AS BIGINT), CAST(2 AS BIGINT) FROM sents),")
    for once in ("stoks", "mapped", "svec", "proj", "emb", "dictionary", "vocab"):
        x3 = x3.replace(f"\n{once} AS (", f"\n{once} AS MATERIALIZED (")
    q["score_sentences"] = "WITH " + x3 + (
        f"\nSELECT 'encoder_in' AS stage, s.sent_id, s.pos, {vadd('s.x', 'p.proj')} AS x FROM st0 s JOIN proj p USING (sent_id) "
        f"UNION ALL SELECT 'encoder_out', s.sent_id, s.pos, {vadd('s.x', 'p.proj')} FROM st1 s JOIN proj p USING (sent_id) "
        f"UNION ALL SELECT 'decoder', s.sent_id, s.pos, {vadd('s.x', 'v.vec')} FROM st0 s JOIN "
        f"(SELECT sent_id, list_transform(qsum, lambda v: v / {float(PR.QUANT)!r}) AS vec FROM svec) v USING (sent_id)")
    return q


def parallel_ctes() -> str:
    return f"""
pairs AS (SELECT CAST(u.conv_id * 1000 + u.turn AS BIGINT) AS pair_id, u.text AS src, a.text AS tgt
          FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant'),
jwords AS (SELECT unnest(list_concat({ws_expr('src')}, {ws_expr('tgt')})) AS word FROM pairs),
jdict AS (SELECT CAST(row_number() OVER (ORDER BY cnt DESC, word) - 1 AS BIGINT) AS id, word, cnt
          FROM (SELECT word, CAST(count(*) AS BIGINT) AS cnt FROM jwords GROUP BY word)),
hyps AS (SELECT pair_id, array_to_string(list_filter(t, lambda w, i: i % 7 <> 0), ' ') AS hyp,
                array_to_string(t, ' ') AS ref
         FROM (SELECT pair_id, {ws_expr('tgt')} AS t FROM pairs))"""


def ngram_expr(t: str, n: int) -> str:
    return f"list_transform(range(0, len({t}) - {n - 1}), lambda i: array_to_string({t}[i + 1:i + {n}], ' '))"


def parallel_sql() -> dict[str, str]:
    w = "WITH " + parallel_ctes()
    q: dict[str, str] = {}
    q["joined_dictionary"] = w + "\nSELECT id, word, cnt FROM jdict"
    q["binarize"] = w + "\n" + " UNION ALL ".join(
        f"SELECT '{side}' AS side, p.pair_id, CAST(p.pos AS BIGINT) AS pos, CAST(coalesce(d.id + 4, 3) AS BIGINT) AS tok FROM "
        f"(SELECT pair_id, unnest(range(len(t))) AS pos, unnest(t) AS word FROM (SELECT pair_id, {ws_expr(side)} AS t FROM pairs)) p "
        f"LEFT JOIN jdict d USING (word) "
        f"UNION ALL SELECT '{side}', pair_id, CAST(len({ws_expr(side)}) AS BIGINT), CAST(2 AS BIGINT) FROM pairs"
        for side in ("src", "tgt"))
    q["strip_subword_marks"] = (
        "SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS sent_id, "
        "regexp_replace(replace(coalesce(text, '') || ' ', '@@ ', ''), ' $', '') AS text FROM conversations")
    q["max_length_filter"] = w + (
        f"\nSELECT pair_id FROM pairs WHERE len({ws_expr('src')}) <= 1024 AND len({ws_expr('tgt')}) <= 1024")
    grams = []
    for n in range(1, 5):
        grams.append(
            f"SELECT {n} AS n, pair_id, unnest({ngram_expr('h', n)}) AS gram, 'h' AS side FROM toks "
            f"UNION ALL SELECT {n}, pair_id, unnest({ngram_expr('r', n)}), 'r' FROM toks")
    q["corpus_bleu"] = w + f""",
toks AS (SELECT pair_id, {ws_expr('hyp')} AS h, {ws_expr('ref')} AS r FROM hyps),
g AS ({' UNION ALL '.join(grams)}),
hc AS (SELECT n, pair_id, gram, count(*) AS c FROM g WHERE side = 'h' GROUP BY ALL),
rc AS (SELECT n, pair_id, gram, count(*) AS c FROM g WHERE side = 'r' GROUP BY ALL),
st AS (SELECT hc.n, sum(least(hc.c, coalesce(rc.c, 0))) AS hits, sum(hc.c) AS total
       FROM hc LEFT JOIN rc USING (n, pair_id, gram) GROUP BY hc.n),
ln AS (SELECT CAST(sum(len(h)) AS BIGINT) AS c, CAST(sum(len(r)) AS BIGINT) AS r FROM toks),
pv AS (SELECT ln.c, ln.r,
              coalesce(max(CASE WHEN n = 1 THEN hits / total END), 0.0) AS p1,
              coalesce(max(CASE WHEN n = 2 THEN hits / total END), 0.0) AS p2,
              coalesce(max(CASE WHEN n = 3 THEN hits / total END), 0.0) AS p3,
              coalesce(max(CASE WHEN n = 4 THEN hits / total END), 0.0) AS p4
       FROM ln LEFT JOIN st ON true GROUP BY ln.c, ln.r),
fin AS (SELECT *, CASE WHEN c > r THEN 1.0 WHEN c > 0 THEN exp(1.0 - r / c) ELSE 0.0 END AS bp FROM pv)
SELECT {rnd("CASE WHEN least(p1, p2, p3, p4) <= 0 THEN 0.0 ELSE bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4.0) END", "1e9")} AS bleu,
       {rnd('bp', '1e9')} AS bp, c AS hyp_len, r AS ref_len,
       {rnd('p1', '1e9')} AS p1, {rnd('p2', '1e9')} AS p2, {rnd('p3', '1e9')} AS p3, {rnd('p4', '1e9')} AS p4
FROM fin"""
    return q


def log_ctes() -> str:
    return """
d0 AS (SELECT min(CAST(ts AS DATE)) AS d0 FROM events),
tlog AS (SELECT 0 AS run_id, CAST(datediff('day', d0.d0, CAST(ts AS DATE)) + 1 AS INTEGER) AS epoch,
                event_id AS batch_key, CAST(round(value * 100) AS BIGINT) AS rec_c FROM events CROSS JOIN d0),
vlog AS (SELECT run_id, epoch, (sum(rec_c) / count(*)) / 100.0 AS val_ppl FROM tlog GROUP BY run_id, epoch)"""


def log_sql() -> dict[str, str]:
    w = "WITH " + log_ctes()
    q: dict[str, str] = {}
    q["running_loss"] = w + """,
cum AS (SELECT run_id, epoch,
               count(*) OVER (PARTITION BY run_id, epoch ORDER BY batch_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n,
               sum(rec_c) OVER (PARTITION BY run_id, epoch ORDER BY batch_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
        FROM tlog),
r AS (SELECT run_id, epoch, CAST(n - 1 AS BIGINT) AS batch,
             floor(((s / n) / 100.0) * 100.0 + 0.5) / 100.0 AS rec,
             floor(((s / n) / 1000.0) * 100.0 + 0.5) / 100.0 AS kl FROM cum)
SELECT run_id, epoch, batch, rec, kl, floor((rec + kl) * 100.0 + 0.5) / 100.0 AS nelbo
FROM r WHERE batch % 2 = 0 AND batch > 0"""
    q["best_epoch"] = w + f""",
b AS (SELECT run_id, epoch, val_ppl,
             val_ppl < coalesce(min(val_ppl) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e9) AS improved
      FROM vlog),
k AS (SELECT run_id, max(epoch) AS kept_epoch FROM b WHERE improved GROUP BY run_id)
SELECT b.run_id, b.epoch, {rnd('b.val_ppl', '1e9')} AS val_ppl, b.improved, b.epoch = k.kept_epoch AS kept
FROM b LEFT JOIN k USING (run_id)"""
    q["anneal_trigger"] = w + f""",
c AS (SELECT run_id, epoch, val_ppl,
             CASE WHEN val_ppl >= coalesce(min(val_ppl) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e9)
                   AND row_number() OVER (PARTITION BY run_id ORDER BY epoch) - 1 > 10
                   AND val_ppl > min(val_ppl) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 11 PRECEDING)
                  THEN 1 ELSE 0 END AS cond
      FROM vlog),
d AS (SELECT *, coalesce(sum(cond) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT run_id, epoch, cond = 1 AND before < 5 AS trigger, {rnd('0.005 / pow(4.0, least(before + cond, 5))', '1e12')} AS lr FROM d"""
    return q


def gradient_ctes() -> str:
    """Forward with noise and backward over the training documents, in long form."""
    noise = normal(f"'{PR.SEED}:0:' || CAST(doc_ix AS VARCHAR) || ':' || CAST(topic AS VARCHAR)")
    return f""",
tz AS MATERIALIZED (SELECT doc_ix, topic, mu, logsigma, {noise} AS eps FROM theta WHERE split = 'tr'),
te AS (SELECT *, exp(z - max(z) OVER (PARTITION BY doc_ix)) AS e
       FROM (SELECT *, mu + eps * exp(0.5 * logsigma) AS z FROM tz)),
tt AS MATERIALIZED (SELECT doc_ix, topic, mu, logsigma, eps, e / sum(e) OVER (PARTITION BY doc_ix) AS th FROM te),
gp AS (SELECT b.doc_ix, b.token_id, b.cnt, sum(t.th * be.p) + 1e-6 AS p
       FROM bow b JOIN beta be ON be.token_id = b.token_id JOIN tt t ON t.doc_ix = b.doc_ix AND t.topic = be.topic
       WHERE b.split = 'tr' GROUP BY b.doc_ix, b.token_id, b.cnt),
gg AS MATERIALIZED (SELECT doc_ix, token_id, cnt, p, -cnt / p AS g FROM gp),
dth AS (SELECT g.doc_ix, be.topic, sum(g.g * be.p) AS d FROM gg g JOIN beta be USING (token_id) GROUP BY g.doc_ix, be.topic),
dbt AS (SELECT g.token_id, t.topic, sum(g.g * t.th) AS d FROM gg g JOIN tt t USING (doc_ix) GROUP BY g.token_id, t.topic),
sk AS (SELECT topic, sum(d * p) AS s FROM dbt JOIN beta USING (token_id, topic) GROUP BY topic),
dl AS (SELECT b.token_id, b.topic, b.p * (coalesce(d.d, 0.0) - sk.s) AS l
       FROM beta b JOIN sk USING (topic) LEFT JOIN dbt d ON d.token_id = b.token_id AND d.topic = b.topic),
dal AS (SELECT dl.topic, r.d, sum(dl.l * (r.q / {float(PR.QUANT)!r})) AS g
        FROM dl JOIN (SELECT token_id, unnest(range(len(qvec))) AS d, unnest(qvec) AS q FROM rho) r USING (token_id)
        GROUP BY dl.topic, r.d),
dm AS MATERIALIZED (
  SELECT doc_ix, topic, dz + mu AS dmu, 0.5 * dz * eps * exp(0.5 * logsigma) + 0.5 * (exp(logsigma) - 1.0) AS dls
  FROM (SELECT t.*, t.th * (d.d - sum(t.th * d.d) OVER (PARTITION BY t.doc_ix)) AS dz
        FROM tt t JOIN dth d ON d.doc_ix = t.doc_ix AND d.topic = t.topic)),
h1t AS MATERIALIZED (SELECT doc_ix, j, h FROM h1 WHERE split = 'tr'),
h2t AS MATERIALIZED (SELECT doc_ix, j, h FROM h2 WHERE split = 'tr'),
gmu AS (SELECT h.j AS i, m.topic AS k, sum(h.h * m.dmu) AS gm, sum(h.h * m.dls) AS gs FROM h2t h JOIN dm m USING (doc_ix) GROUP BY h.j, m.topic),
gb AS (SELECT topic AS k, sum(dmu) AS gm, sum(dls) AS gs FROM dm GROUP BY topic),
da2 AS MATERIALIZED (
  SELECT x.doc_ix, x.j, CASE WHEN h.h > 0 THEN x.d ELSE 0.0 END AS d
  FROM (SELECT m.doc_ix, a.i AS j, sum(m.dmu * a.w + m.dls * b.w) AS d
        FROM dm m JOIN wmu a ON a.k = m.topic JOIN wsg b ON b.k = m.topic AND b.i = a.i GROUP BY m.doc_ix, a.i) x
  JOIN h2t h ON h.doc_ix = x.doc_ix AND h.j = x.j),
gw2 AS (SELECT h.j AS i, d.j AS j, sum(h.h * d.d) AS g FROM h1t h JOIN da2 d USING (doc_ix) GROUP BY h.j, d.j),
da1 AS MATERIALIZED (
  SELECT x.doc_ix, x.i AS j, CASE WHEN h.h > 0 THEN x.d ELSE 0.0 END AS d
  FROM (SELECT d.doc_ix, w2.i, sum(d.d * w2.w) AS d FROM da2 d JOIN w2 ON w2.j = d.j GROUP BY d.doc_ix, w2.i) x
  JOIN h1t h ON h.doc_ix = x.doc_ix AND h.j = x.i),
gw1 AS (SELECT x.token_id, d.j, sum(x.x * d.d) AS g FROM xw x JOIN da1 d ON d.doc_ix = x.doc_ix
        WHERE x.split = 'tr' GROUP BY x.token_id, d.j),
grad AS (
  SELECT 'W1' AS name, token_id AS i, list(g ORDER BY j) AS vec FROM gw1 GROUP BY token_id
  UNION ALL SELECT 'b1', 0, list(g ORDER BY j) FROM (SELECT j, sum(d) AS g FROM da1 GROUP BY j)
  UNION ALL SELECT 'W2', i, list(g ORDER BY j) FROM gw2 GROUP BY i
  UNION ALL SELECT 'b2', 0, list(g ORDER BY j) FROM (SELECT j, sum(d) AS g FROM da2 GROUP BY j)
  UNION ALL SELECT 'Wmu', i, list(gm ORDER BY k) FROM gmu GROUP BY i
  UNION ALL SELECT 'Ws', i, list(gs ORDER BY k) FROM gmu GROUP BY i
  UNION ALL SELECT 'bmu', 0, list(gm ORDER BY k) FROM gb
  UNION ALL SELECT 'bs', 0, list(gs ORDER BY k) FROM gb
  UNION ALL SELECT 'alpha', topic, list(g ORDER BY d) FROM dal GROUP BY topic
  UNION ALL SELECT '_rec', 0, [(SELECT -sum(cnt * ln(p)) FROM gg)]
  UNION ALL SELECT '_kl', 0, [(SELECT -0.5 * sum(1.0 + logsigma - mu * mu - exp(logsigma)) FROM tt)]
  UNION ALL SELECT '_n', 0, [(SELECT CAST(count(DISTINCT doc_ix) AS DOUBLE) FROM tt)])"""


def fit_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["batches"] = with_ng(
        "SELECT CAST(floor(r / " + str(PR.TRAIN_BATCH) + ") AS BIGINT) AS batch, doc_ix, n_tokens FROM ("
        "SELECT doc_ix, CAST(len(tokens) AS BIGINT) AS n_tokens, "
        f"row_number() OVER (ORDER BY md5('{PR.SEED}:1:' || CAST(doc_ix AS VARCHAR)), doc_ix) - 1 AS r "
        "FROM packed WHERE split = 'tr')")
    q["elbo_gradient"] = ("WITH " + newsgroup_ctes() + model_ctes() + gradient_ctes()
                          + f"\nSELECT name, CAST(i AS BIGINT) AS i, {vsnap('vec', '1e4')} AS vec FROM grad")
    return q


def store_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    params = (
        "SELECT 'W1' AS name, token_id AS i, list(w ORDER BY j) AS vec FROM w1 GROUP BY token_id "
        "UNION ALL SELECT 'b1', 0, list(b ORDER BY j) FROM b1 "
        "UNION ALL SELECT 'W2', i, list(w ORDER BY j) FROM w2 GROUP BY i "
        "UNION ALL SELECT 'b2', 0, list(b ORDER BY j) FROM b2 "
        "UNION ALL SELECT 'Wmu', i, list(w ORDER BY k) FROM wmu GROUP BY i "
        "UNION ALL SELECT 'bmu', 0, list(b ORDER BY k) FROM bmu "
        "UNION ALL SELECT 'Ws', i, list(w ORDER BY k) FROM wsg GROUP BY i "
        "UNION ALL SELECT 'bs', 0, list(b ORDER BY k) FROM bsg")
    q["model_store"] = with_model(f"SELECT name, CAST(i AS BIGINT) AS i, {vsnap('vec')} AS vec FROM ({params})"
                                  f" UNION ALL SELECT 'rho', CAST(token_id AS BIGINT), {vsnap(f'list_transform(qvec, lambda q: q / {float(PR.QUANT)!r})')} FROM rho"
                                  f" UNION ALL SELECT 'alpha', CAST(topic AS BIGINT), {vsnap(f'list_transform(qsum, lambda q: q / {float(PR.QUANT) * 10!r})')} FROM alpha")
    q["topic_words_sink"] = with_model(
        "SELECT topic, list(word ORDER BY rank) AS words FROM (SELECT t.topic, t.rank, v.word FROM "
        "(SELECT topic, token_id, row_number() OVER (PARTITION BY topic ORDER BY dot DESC, token_id) - 1 AS rank FROM beta) t "
        f"JOIN vocab v USING (token_id) WHERE t.rank < {PR.NUM_WORDS - 1}) GROUP BY topic")
    q["embedding_sink"] = with_model(f"SELECT token_id, list_transform(qvec, lambda q: q / {float(PR.QUANT)!r}) AS vec FROM rho")
    return q


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(preparation_sql())
    out.update(model_sql())
    out.update(sentence_sql())
    out.update(parallel_sql())
    out.update(log_sql())
    out.update(fit_sql())
    out.update(store_sql())
    return out
