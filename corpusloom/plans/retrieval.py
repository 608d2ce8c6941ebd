"""Retrieval over passages of ``documents`` for all ``benchmark`` questions.

Passages are character windows.  A passage's vector is the row of ``embeddings`` its
document and window number select; a question's vector is the row with its own number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import retrieval_tokens
from corpusloom.functions.text import query_terms as match_terms
from corpusloom.functions.values import content_id, each
from corpusloom.operators import chunking as C
from corpusloom.operators import dense_index as DI
from corpusloom.operators import lexical as X
from corpusloom.operators import lexical_index as LI
from corpusloom.operators import ranking as R
from corpusloom.operators import search as S
from corpusloom.operators.dense import alias_index, alias_index_stats, index_stats, vector_topk
from corpusloom.plans.catalog import ctes, id_sql, load, query, stored, strip_sql
from corpusloom.session import materialized

AS_OF = "2024-06-30"

# ---------------------------------------------------------------- inputs

PASSAGES = f"""cut AS (SELECT doc_id, lang, source, split_part(text, chr(10), 1) AS title, unnest(range(0, greatest((length(text) - 121) // 780, 0) + 1)) AS n, text FROM documents),
kept AS (SELECT * REPLACE ({strip_sql("substr(text, n * 780 + 1, 900)")} AS text) FROM cut),
vecs AS (SELECT count(*) AS total FROM embeddings),
passages AS MATERIALIZED (SELECT {id_sql("'doc/' || doc_id || '.md'", "'child'", "seq::VARCHAR")} AS child_id, {id_sql("'doc/' || doc_id || '.md'", "'parent'")} AS parent_id, doc_id, source AS corpus_id, title,
    lang || ' > part ' || seq // 8 AS heading_path, text, (doc_id * 7 + seq) % (SELECT total FROM vecs) AS vec_id,
    CASE WHEN doc_id % 10 = 4 THEN '2025-01-01' WHEN doc_id % 10 = 5 THEN 'unknown' ELSE '' END AS valid_from, CASE WHEN doc_id % 10 = 3 THEN '2023-12-31' ELSE '' END AS valid_until,
    {strip_sql("title || chr(10) || lang || ' > part ' || seq // 8 || chr(10) || text")} AS search_text
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS seq FROM kept WHERE text <> ''))"""
CURRENT = "doc_id % 10 NOT IN (3, 4, 5)"


def cut_passages(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    rows = each(d, C.windows("text", 900, 120), "doc_id", "lang", "source", "title", item="text", pos="_p").withColumn("seq", F.col("_p") + 1)
    file = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md"))
    total = load(spark, sf_dir, "embeddings").agg(F.count("*").alias("n")).select("n").scalar()
    digit = F.col("doc_id") % 10
    out = rows.select(
        content_id(file, F.lit("child"), F.col("seq").cast("string")).alias("child_id"), content_id(file, F.lit("parent")).alias("parent_id"), "doc_id",
        F.col("source").alias("corpus_id"), "title", F.concat("lang", F.lit(" > part "), F.floor(F.col("seq") / 8).cast("string")).alias("heading_path"), "text",
        ((F.col("doc_id") * 7 + F.col("seq")) % total).alias("vec_id"),
        F.when(digit == 4, "2025-01-01").when(digit == 5, "unknown").otherwise("").alias("valid_from"), F.when(digit == 3, "2023-12-31").otherwise("").alias("valid_until"),
    )
    return out.withColumn("search_text", S.search_text("title", "heading_path", "text"))


def passages(spark, sf_dir) -> DataFrame:
    """The passages, cut once and stored."""
    return spark.read.parquet(stored(spark, sf_dir, "passages", lambda folder: cut_passages(spark, sf_dir).write.parquet(folder)))


def lexical_index(spark, sf_dir) -> LI.LexicalIndex:
    folder = stored(spark, sf_dir, "lexical", lambda folder: LI.write_text_index(passages(spark, sf_dir), folder, "v1"))
    return LI.read_lexical_index(spark, folder, "v1")


def questions(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def question_vectors(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return questions(spark, sf_dir).select("query_id").join(e, "query_id")


def passage_vectors(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return passages(spark, sf_dir).select("child_id", "corpus_id", "vec_id").join(e, "vec_id").select("child_id", "corpus_id", "embedding")


def current(spark, sf_dir) -> DataFrame:
    return passages(spark, sf_dir).filter(S.is_current("valid_from", "valid_until", AS_OF))


# ---------------------------------------------------------------- SQL twins


def tokens_sql(low: str, chars: str) -> str:
    """Tokens of a lower-cased text column and the list of its characters."""
    return (
        f"regexp_extract_all({low}, '[a-zA-Z0-9_]+|[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]') || "
        f"list_filter(list_transform(list_zip({chars}[:-2], {chars}[2:]), lambda z: z[1] || z[2]), lambda tp: trim(tp, ' ' || chr(10) || chr(9)) <> '')"
    )


QUESTION_TOKENS = f"""qlow AS (SELECT item_id, lower(text) AS low, string_split(lower(text), '') AS chars FROM benchmark),
qtok AS MATERIALIZED (SELECT item_id, {tokens_sql('low', 'chars')} AS tokens FROM qlow)"""
BM25 = f"""plow AS MATERIALIZED (SELECT child_id, lower(search_text) AS low, string_split(lower(search_text), '') AS chars FROM passages),
tok AS MATERIALIZED (SELECT child_id, {tokens_sql('low', 'chars')} AS tokens FROM plow),
{QUESTION_TOKENS},
post AS MATERIALIZED (SELECT child_id, term, count(*) AS tf FROM (SELECT child_id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
st AS MATERIALIZED (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
raw_idf AS MATERIALIZED (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), st),
mean_idf AS MATERIALIZED (SELECT avg(idf) AS mi FROM raw_idf),
qt AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf, any_value(CASE WHEN idf < 0 THEN 0.25 * mi ELSE idf END) AS idf
    FROM (SELECT item_id AS query_id, unnest(tokens) AS term FROM qtok) JOIN raw_idf USING (term), mean_idf GROUP BY ALL),
gain AS MATERIALIZED (SELECT child_id, term, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl)) AS g FROM post JOIN tok USING (child_id), st WHERE term IN (SELECT term FROM qt)),
lex AS MATERIALIZED (SELECT query_id, child_id, round(sum(qtf * idf * g), 9) AS score FROM gain JOIN qt USING (term) GROUP BY ALL),
lex20 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM lex QUALIFY rank <= 20),
lexn AS (SELECT l.*, l.score / max(l.score) OVER (PARTITION BY query_id) AS bm25_score FROM lex20 l),
lexf AS (SELECT l.query_id, l.child_id, bm25_score FROM lexn l JOIN passages p USING (child_id) WHERE {CURRENT})"""


def distance_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


VECTORS = """ev AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
qv AS (SELECT item_id AS query_id, e FROM benchmark JOIN ev ON vec_id = item_id),
pv AS MATERIALIZED (SELECT query_id, vec_id, round(1 / (1 + greatest(list_inner_product(ev.e, ev.e) + list_inner_product(qv.e, qv.e) - 2 * list_inner_product(ev.e, qv.e), 0)), 9) AS s FROM ev, qv),
dall AS (SELECT query_id, child_id, parent_id, doc_id, s AS score FROM passages JOIN pv USING (vec_id))"""
DENSE = f"""dtop AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM dall QUALIFY rank <= 60),
densef AS (SELECT query_id, child_id, score AS dense_score FROM dtop WHERE {CURRENT})"""
FUSED = """fused AS MATERIALIZED (SELECT query_id, child_id, coalesce(dense_score, 0) AS dense_score, coalesce(bm25_score, 0) AS bm25_score,
    0.65 * coalesce(dense_score, 0) + 0.35 * coalesce(bm25_score, 0) AS score FROM densef FULL JOIN lexf USING (query_id, child_id)),
ranked AS MATERIALIZED (SELECT f.*, parent_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, child_id) AS rank FROM fused f JOIN passages USING (child_id))"""


def diversified_sql(source: str, k: int, name: str = "final") -> str:
    free = max(3, k // 2)
    return f"""{name}1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS nth FROM {source}),
{name}2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM {name}1 WHERE rank <= {free} OR nth = 1),
{name} AS (SELECT * EXCLUDE (rank, nth, r), r AS rank FROM {name}2 WHERE r <= {k})"""


LEXICAL = [PASSAGES, BM25]
RAW = "query_id, child_id, rank, round(score, 3) AS score"  # raw lexical scores are large
HYBRID = [PASSAGES, BM25, VECTORS, DENSE, FUSED]
SCORED = "query_id, child_id, rank, round(score, 6) AS score"

# external scores: a number made from the two ids, missing for one pair in ten
RERANK_SQL = "rr AS (SELECT query_id, child_id, ((query_id * 31 + doc_id * 17) % 97) / 97.0::DOUBLE AS rerank_score FROM ranked WHERE rank <= 40 AND doc_id % 10 <> 1)"
MERGED = """mg1 AS (SELECT k.* , CASE WHEN k.rank <= 8 THEN r.rerank_score END AS rerank_score FROM ranked k LEFT JOIN rr r USING (query_id, child_id) WHERE k.rank <= 40),
mg2 AS (SELECT *, max(rerank_score IS NOT NULL) OVER (PARTITION BY query_id) AS anyr FROM mg1),
merged AS MATERIALIZED (SELECT query_id, child_id, parent_id, rerank_score, coalesce(rerank_score, score) AS score, CASE WHEN anyr AND rank <= 8 THEN score END AS hybrid_score,
    row_number() OVER (PARTITION BY query_id ORDER BY rank > 8, CASE WHEN rank <= 8 AND anyr THEN round(coalesce(rerank_score, score), 9) END DESC NULLS LAST, rank) AS rank FROM mg2)"""


def filtered_sql(top_k: int, min_score: float, min_keep: int, max_keep: int) -> str:
    """The reranked filter with parent de-duplication, as classes."""
    target = max(1, min(top_k, max_keep))
    floor = min(max(1, min_keep), target)
    return f"""rf1 AS (SELECT *, count_if(rerank_score >= {min_score}) OVER (PARTITION BY query_id) AS np FROM merged WHERE rerank_score IS NOT NULL),
rf2 AS (SELECT *, rerank_score >= {min_score} OR np < {floor} AS cand FROM rf1),
rf3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY NOT cand, rerank_score DESC, rank, child_id) AS nth FROM rf2),
rf4 AS (SELECT *, CASE WHEN cand AND nth = 1 THEN 1 WHEN nth = 1 THEN 2 ELSE 3 END AS cls FROM rf3),
rf5 AS (SELECT *, count_if(cls = 1) OVER (PARTITION BY query_id) AS n1, row_number() OVER (PARTITION BY query_id ORDER BY cls, rerank_score DESC, rank, child_id) AS pos FROM rf4),
filtered AS (SELECT query_id, child_id, parent_id, rerank_score, score, pos AS rank FROM rf5 WHERE pos <= CASE WHEN n1 >= {target} THEN {target} ELSE greatest(n1, {floor}) END)"""


SETTINGS = S.Retrieval(reranker_min_score=0.3, reranker_min_keep=2, reranker_max_keep=6, reranker_dedupe_parent=True)


def lexical(spark, sf_dir, k: int = 20) -> DataFrame:
    """The k best passages of each question, stored: later joins see how small they are."""
    return materialized(LI.indexed_topk(lexical_index(spark, sf_dir), X.query_terms(questions(spark, sf_dir)), k))


def fused(spark, sf_dir) -> DataFrame:
    p = passages(spark, sf_dir)
    now = S.is_current("valid_from", "valid_until", AS_OF)
    dense = S.dense_list(passage_vectors(spark, sf_dir), question_vectors(spark, sf_dir), S.Retrieval(), p.filter(now))
    lex = X.normalize_lexical(lexical(spark, sf_dir), p, now).select("query_id", "child_id", "bm25_score")
    return S.attach_children(S.fuse(dense, lex), p, ["parent_id", "doc_id"])


def fused_once(spark, sf_dir) -> DataFrame:
    """The fused list, at most both cuts per query, for plans that use it more than once."""
    return materialized(fused(spark, sf_dir))


def rerank_scores(ranked: DataFrame) -> DataFrame:
    score = ((F.col("query_id") * 31 + F.col("doc_id") * 17) % 97) / F.lit(97.0)
    return ranked.filter((F.col("rank") <= 40) & (F.col("doc_id") % 10 != 1)).select("query_id", "child_id", score.alias("rerank_score"))


# ---------------------------------------------------------------- lexical


@query("tokenize", ctes(QUESTION_TOKENS) + "SELECT item_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS n FROM qtok")
def tokenize(spark, sf_dir):
    rows = each(load(spark, sf_dir, "benchmark"), retrieval_tokens("text"), "item_id", item="token", pos="_p")
    return rows.select("item_id", (F.col("_p") + 1).alias("n"), "token")


_TERMS = """low AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM benchmark), cmp AS (SELECT item_id, t, replace(t, ' ', '') AS c FROM low),
terms AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(t, '[a-zA-Z0-9]+|[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]{2,}')
    || list_transform(range(1, length(c)), lambda i: substr(c, i, 2))) AS term FROM cmp) WHERE term <> '')"""


@query("query_terms", ctes(_TERMS) + "SELECT item_id, term FROM terms")
def query_terms(spark, sf_dir):
    return each(load(spark, sf_dir, "benchmark"), match_terms("text"), "item_id", item="term").select("item_id", "term")


@query("lexical_index", ctes(PASSAGES, BM25) + "SELECT term, count(*) AS df FROM post GROUP BY term UNION ALL SELECT NULL, n FROM st")
def lexical_index_terms(spark, sf_dir):
    return lexical_index(spark, sf_dir).lexicon.select("term", "df")


@query("bm25_topk", ctes(*LEXICAL) + "SELECT query_id, child_id, rank, round(score, 3) AS score FROM lex20")
def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir).withColumn("score", F.round("score", 3))


@query("bm25_normalized", ctes(*LEXICAL) + "SELECT query_id, child_id, round(bm25_score, 6) AS bm25_score FROM lexf")
def bm25_normalized(spark, sf_dir):
    p = passages(spark, sf_dir)
    rows = X.normalize_lexical(lexical(spark, sf_dir), p, S.is_current("valid_from", "valid_until", AS_OF))
    return rows.select("query_id", "child_id", F.round("bm25_score", 6).alias("bm25_score"))


@query("topk", ctes(*LEXICAL) + f"SELECT {RAW} FROM lex20 WHERE rank <= 8")
def topk(spark, sf_dir):
    return lexical(spark, sf_dir, 8).withColumn("score", F.round("score", 3))


def _ranked_lexical(spark, sf_dir) -> DataFrame:
    return S.attach_children(lexical(spark, sf_dir), passages(spark, sf_dir), ["parent_id"])


_LEXP = "lexp AS (SELECT query_id, child_id, parent_id, rank, l.score FROM lex20 l JOIN passages USING (child_id))"


@query("diversify", ctes(*LEXICAL, _LEXP, diversified_sql("lexp", 8)) + f"SELECT {RAW} FROM final")
def diversify(spark, sf_dir):
    return R.diversify(_ranked_lexical(spark, sf_dir), 8).select("query_id", "child_id", "rank", F.round("score", 3).alias("score"))


@query("parent_dedupe", ctes(*LEXICAL, _LEXP) + f"SELECT {RAW} FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS nth FROM lexp) WHERE nth = 1")
def parent_dedupe(spark, sf_dir):
    return R.parent_dedupe(_ranked_lexical(spark, sf_dir)).select("query_id", "child_id", "rank", F.round("score", 3).alias("score"))


@query(
    "context_budget",
    ctes(*LEXICAL)
    + """, t AS (SELECT query_id, rank, child_id, d.text AS txt FROM lex20 l JOIN passages p USING (child_id) JOIN documents d USING (doc_id)),
    b AS (SELECT *, coalesce(sum(length(txt)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM t)
    SELECT query_id, rank, child_id, CASE WHEN prior >= 6000 THEN '' WHEN prior + length(txt) <= 6000 THEN txt ELSE substr(txt, 1, (6000 - prior)::BIGINT) || chr(10) || '...[省略]' END AS parent_text FROM b""",
)
def context_budget(spark, sf_dir):
    parents = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("parent_text"))
    rows = S.attach_children(lexical(spark, sf_dir), passages(spark, sf_dir), ["doc_id"]).join(parents, "doc_id")
    return R.context_budget(rows, 6000).select("query_id", "rank", "child_id", "parent_text")


# ---------------------------------------------------------------- dense


_VECTOR_TOPK = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, i.vec_id AS child_id, round(list_inner_product(q.v, i.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(i.v, i.v)), 9) AS score FROM e q, e i WHERE i.label <= q.label)
    SELECT query_id, child_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 8"""


def labelled_vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Index rows with their label as corpus; every row asks, and may see the corpora up to its own label."""
    e = load(spark, sf_dir, "embeddings")
    index = e.select(F.col("vec_id").alias("child_id"), "embedding", F.col("label").cast("string").alias("corpus_id"))
    allowed = F.transform(F.sequence(F.lit(0), F.col("label")), lambda n: n.cast("string"))
    return index, e.select(F.col("vec_id").alias("query_id"), "embedding", allowed.alias("corpus_ids"))


@query("vector_topk", _VECTOR_TOPK)
def vector_topk_query(spark, sf_dir):
    return vector_topk(*labelled_vectors(spark, sf_dir), 8, "cosine").withColumn("score", F.round("score", 6))


@query("vector_index_topk", _VECTOR_TOPK)
def vector_index_topk(spark, sf_dir):
    index, q = labelled_vectors(spark, sf_dir)
    folder = stored(spark, sf_dir, "embeddings", lambda folder: DI.write_vector_index(index, folder, "v1", "cosine"))
    return DI.indexed_vectors(DI.read_vector_index(spark, folder, "v1"), q, 8).withColumn("score", F.round("score", 6))


@query(
    "index_stats",
    "SELECT 'r' || vec_id % 3 AS release_id, 'c' || label AS corpus_id, count(*) AS row_count, min(len(embedding)) AS min_size, max(len(embedding)) AS max_size FROM embeddings GROUP BY ALL",
)
def index_stats_query(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return index_stats(e.select(F.concat(F.lit("r"), (F.col("vec_id") % 3).cast("string")).alias("release_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("corpus_id"), "embedding"))


@query(
    "vector_only",
    ctes(PASSAGES, VECTORS)
    + f""", t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS retrieval_rank FROM dall QUALIFY retrieval_rank <= 24),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_rank) AS n FROM t WHERE {CURRENT})
    SELECT query_id, child_id, retrieval_rank, round(score, 6) AS score FROM k WHERE n <= 8""",
)
def vector_only(spark, sf_dir):
    rows = S.vector_only(passage_vectors(spark, sf_dir), question_vectors(spark, sf_dir), current(spark, sf_dir), 8)
    return rows.select("query_id", "child_id", "retrieval_rank", F.round("score", 6).alias("score"))


_ALIAS_VEC = """av AS (SELECT vec_id AS alias_id, CASE WHEN vec_id % 11 = 3 THEN [0.0, 0.0]::FLOAT[] WHEN vec_id % 13 = 5 THEN embedding[1:32] ELSE embedding END AS embedding FROM embeddings),
n AS (SELECT alias_id, embedding, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM av),
w AS (SELECT arg_min(len(embedding), alias_id) AS w FROM n WHERE norm > 0)"""


def alias_vectors(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    zero = F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>")
    v = F.when(F.col("vec_id") % 11 == 3, zero).when(F.col("vec_id") % 13 == 5, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return e.select(F.col("vec_id").alias("alias_id"), v.alias("embedding"))


@query("alias_index", ctes(_ALIAS_VEC) + "SELECT alias_id, len(embedding) AS size, round(embedding[1]::DOUBLE / norm, 6) AS first_value FROM n, w WHERE norm > 0 AND len(embedding) = w")
def alias_index_query(spark, sf_dir):
    return alias_index(alias_vectors(spark, sf_dir)).select("alias_id", F.size("embedding").alias("size"), F.round(F.col("embedding")[0], 6).alias("first_value"))


@query(
    "alias_index_stats",
    ctes(_ALIAS_VEC)
    + "SELECT count_if(norm > 0 AND len(embedding) = w)::BIGINT AS loaded_count, count_if(norm = 0)::BIGINT AS invalid_embedding_count, count_if(norm > 0 AND len(embedding) <> w)::BIGINT AS dimension_mismatch_count, max(w) AS embedding_dimension FROM n, w",
)
def alias_stats(spark, sf_dir):
    return alias_index_stats(alias_vectors(spark, sf_dir))


# ---------------------------------------------------------------- fusion and search


@query("hybrid_fusion", ctes(*HYBRID) + "SELECT query_id, child_id, round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score, round(score, 6) AS score FROM fused")
def hybrid_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select("query_id", "child_id", *[F.round(c, 6).alias(c) for c in ("dense_score", "bm25_score", "score")])


@query("hybrid_search", ctes(*HYBRID, diversified_sql("ranked", 8)) + f"SELECT {SCORED} FROM final")
def hybrid_search(spark, sf_dir):
    return S.hybrid(fused(spark, sf_dir), 8).select("query_id", "child_id", "rank", F.round("score", 6).alias("score"))


@query("rerank_merge", ctes(*HYBRID, RERANK_SQL, MERGED) + f"SELECT {SCORED}, round(hybrid_score, 6) AS hybrid_score FROM merged")
def rerank_merge(spark, sf_dir):
    ranked = R.topk(fused_once(spark, sf_dir), 40)
    merged = S.rerank_merge(ranked, rerank_scores(ranked), 8)
    return merged.select("query_id", "child_id", "rank", F.round("score", 6).alias("score"), F.round("hybrid_score", 6).alias("hybrid_score"))


_FILTER = filtered_sql(8, SETTINGS.reranker_min_score, SETTINGS.reranker_min_keep, SETTINGS.reranker_max_keep)


@query("rerank_filter", ctes(*HYBRID, RERANK_SQL, MERGED, _FILTER) + f"SELECT {SCORED} FROM filtered")
def rerank_filter(spark, sf_dir):
    ranked = R.topk(fused_once(spark, sf_dir), 40)
    merged = S.rerank_merge(ranked, rerank_scores(ranked), 8)
    kept = R.rerank_filter(merged.filter("rerank_score is not null"), 8, SETTINGS.reranker_min_score, SETTINGS.reranker_min_keep, SETTINGS.reranker_max_keep, True)
    return kept.select("query_id", "child_id", "rank", F.round("score", 6).alias("score"))


# queries whose head has no score at all fall back to diversification
_SEARCH = diversified_sql("(SELECT * FROM merged WHERE query_id NOT IN (SELECT query_id FROM merged WHERE rerank_score IS NOT NULL))", 8, "rest")
_FINAL = "searched AS (SELECT query_id, child_id, rank, score FROM filtered UNION ALL SELECT query_id, child_id, rank, score FROM rest)"


def searched(rows: DataFrame) -> DataFrame:
    return S.search(rows, rerank_scores(R.topk(rows, 40)), 8, SETTINGS)


@query("search", ctes(*HYBRID, RERANK_SQL, MERGED, _FILTER, _SEARCH, _FINAL) + f"SELECT {SCORED}, 'hybrid_reranker' AS retrieval_mode FROM searched")
def search(spark, sf_dir):
    return searched(fused_once(spark, sf_dir)).select("query_id", "child_id", "rank", F.round("score", 6).alias("score"), "retrieval_mode")


@query(
    "compare_modes",
    ctes(*HYBRID, RERANK_SQL, MERGED, _FILTER, _SEARCH, _FINAL, diversified_sql("ranked", 8))
    + f""", vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM dall QUALIFY rank <= 24),
    vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM vt WHERE {CURRENT})
    SELECT 'vector' AS retrieval_mode, {SCORED} FROM vk WHERE n <= 8 UNION ALL SELECT 'hybrid', {SCORED} FROM final UNION ALL SELECT 'hybrid_reranker', {SCORED} FROM searched""",
)
def compare_modes(spark, sf_dir):
    vector = S.vector_only(passage_vectors(spark, sf_dir), question_vectors(spark, sf_dir), current(spark, sf_dir), 8)
    both = fused_once(spark, sf_dir)
    rows = S.compare_modes(vector, S.hybrid(both, 8), searched(both))
    return rows.withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- predicates and companions


@query(
    "validity_status",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS f,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate + INTERVAL (o_orderkey % 900 - 100) DAY, '%Y-%m-%d') END AS u FROM orders),
    p AS (SELECT *, try_cast(nullif(f, '') AS DATE) AS df, try_cast(nullif(u, '') AS DATE) AS du FROM o)
    SELECT o_orderkey, CASE WHEN (f <> '' AND df IS NULL) OR coalesce(df > du, false) THEN 'invalid_period' WHEN coalesce(df > DATE '1998-06-30', false) THEN 'not_started'
        WHEN coalesce(du < DATE '1998-06-30', false) THEN 'expired' WHEN f = '' AND u = '' THEN 'unbounded' ELSE 'current' END AS status FROM p""",
)
def validity_status(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    start = F.when(k % 7 == 0, "").when(k % 11 == 0, "soon").otherwise(F.date_format(day, "yyyy-MM-dd"))
    end = F.when(k % 5 == 0, "").otherwise(F.date_format(F.date_add(day, (k % 900 - 100).cast("int")), "yyyy-MM-dd"))
    return o.select("o_orderkey", S.validity_status(start, end, "1998-06-30").alias("status"))


@query("corpus_filter", "SELECT doc_id, source FROM documents WHERE source IN (SELECT 'src' || r_regionkey FROM region WHERE r_regionkey <> 2)")
def corpus_filter(spark, sf_dir):
    corpora = load(spark, sf_dir, "region").select(F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("corpus_id"), (F.col("r_regionkey") != 2).alias("enabled"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return S.enabled_corpora(docs, corpora, "source")


@query(
    "child_parent",
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, coalesce(o_orderpriority, '') AS parent_text FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON l_orderkey = o_orderkey",
)
def child_parent(spark, sf_dir):
    kids = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_id"), "l_orderkey", "l_linenumber")
    parents = load(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("parent_id"), F.col("o_orderpriority").alias("text"))
    return S.attach_parent_text(kids, parents).select("l_orderkey", "l_linenumber", "parent_text")


@query("form_match", "WITH f AS (SELECT DISTINCT substr(text, 1, 20) AS form_name FROM benchmark) SELECT doc_id, form_name FROM documents, f WHERE contains(text, form_name)")
def form_match(spark, sf_dir):
    forms = load(spark, sf_dir, "benchmark").select(F.substring("text", 1, 20).alias("form_name"))
    return S.match_forms(load(spark, sf_dir, "documents"), forms, "doc_id", "text")


_MEET = """ev AS (SELECT event_id, user_id, 'm' || user_id % 60 AS meeting_id, event_type AS source_type, 'a' || user_id % 4 AS agenda, 't' || regexp_extract(props, '(\\d+)', 1)::BIGINT % 6 AS topic, 'c' || event_id % 3 AS corpus_id FROM events),
seeds AS (SELECT user_id AS query_id, e.* EXCLUDE (user_id), row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM ev e QUALIFY rank <= 3),
sets AS (SELECT query_id, list(DISTINCT agenda) AS ag, list(DISTINCT topic) AS tp, list(DISTINCT source_type) AS ty, list(DISTINCT event_id) AS seen FROM seeds GROUP BY query_id),
qm AS (SELECT DISTINCT query_id, meeting_id FROM seeds),
cand AS (SELECT query_id, e.event_id AS child_id, 0.10::DOUBLE + CASE WHEN list_contains(ag, e.agenda) THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN list_contains(tp, e.topic) THEN 0.25::DOUBLE ELSE 0 END
    + CASE WHEN NOT list_contains(ty, e.source_type) THEN 0.20::DOUBLE ELSE 0 END AS score,
    'same_meeting_id' || CASE WHEN list_contains(ag, e.agenda) THEN ',same_agenda' ELSE '' END || CASE WHEN list_contains(tp, e.topic) THEN ',same_topic' ELSE '' END
    || CASE WHEN NOT list_contains(ty, e.source_type) THEN ',different_source_type' ELSE '' END AS auxiliary_reason FROM qm JOIN sets USING (query_id) JOIN ev e USING (meeting_id)
    WHERE NOT list_contains(seen, e.event_id) AND (query_id % 2 = 0 OR e.corpus_id IN ('c0', 'c1'))),
rel AS (SELECT query_id, child_id, score, auxiliary_reason, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, child_id) AS rank FROM cand QUALIFY rank <= 4)"""


def meeting_search(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(final rows, related rows): every user asks once and their three newest events are the final rows.

    Users with an odd number may see two of the three corpora.
    """
    e = load(spark, sf_dir, "events")
    ev = e.select(
        F.col("event_id").alias("child_id"), "user_id", F.concat(F.lit("m"), (F.col("user_id") % 60).cast("string")).alias("meeting_id"), F.col("event_type").alias("source_type"),
        F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")).alias("agenda"), F.concat(F.lit("t"), (F.get_json_object("props", "$.k").cast("int") % 6).cast("string")).alias("topic"),
        F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("corpus_id"),
    )
    newest = Window.partitionBy("user_id").orderBy(F.col("child_id").desc())
    final = ev.withColumn("rank", F.row_number().over(newest)).filter("rank <= 3").withColumnRenamed("user_id", "query_id")
    allowed = F.when(F.col("query_id") % 2 != 0, F.array(F.lit("c0"), F.lit("c1")))
    return final, S.related_chunks(final.withColumn("corpora", allowed), ev.drop("user_id"), corpus_ids="corpora")


@query("related_rows", ctes(_MEET) + "SELECT query_id, child_id, round(score, 6) AS score, auxiliary_reason, rank FROM rel")
def related_rows(spark, sf_dir):
    return meeting_search(spark, sf_dir)[1].select("query_id", "child_id", F.round("score", 6).alias("score"), "auxiliary_reason", "rank")


@query(
    "with_related",
    ctes(_MEET) + "SELECT query_id, child_id, rank, false AS auxiliary_context, NULL::VARCHAR AS auxiliary_reason FROM (SELECT query_id, event_id AS child_id, rank FROM seeds) UNION ALL SELECT query_id, child_id, rank, true, auxiliary_reason FROM rel",
)
def with_related(spark, sf_dir):
    return S.with_related(*meeting_search(spark, sf_dir)).select("query_id", "child_id", "rank", "auxiliary_context", "auxiliary_reason")


@query(
    "release_activate",
    """WITH r AS (SELECT 'v' || s_suppkey AS release_id, CASE s_suppkey % 4 WHEN 0 THEN 'staging' WHEN 1 THEN 'archived' WHEN 2 THEN 'failed' ELSE 'active' END AS status FROM supplier)
    SELECT release_id, CASE WHEN release_id = 'v8' THEN 'active' WHEN status = 'active' THEN 'archived' ELSE status END AS status FROM r""",
)
def release_activate(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    n = F.col("s_suppkey") % 4
    rel = s.select(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("release_id"), F.when(n == 0, "staging").when(n == 1, "archived").when(n == 2, "failed").otherwise("active").alias("status"))
    return S.activate_release(rel, "v8")
