"""Retrieval queries: documents and embeddings against all benchmark items or vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import ranking, retrieval
from skein.plans.base import Query, load, register, spread

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP)
_TOKENS = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda w: len(w) > 1 AND w NOT IN ({_STOP_SQL}))"
_BASE = f"""
WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS tokens FROM documents),
q AS (SELECT item_id AS query_id, {_TOKENS.format("text")} AS tokens FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
w AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d),
p AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM w GROUP BY ALL),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, st GROUP BY term, n),
a AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM q) GROUP BY ALL),
bm AS (
  SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM a JOIN p USING (term) JOIN idf USING (term), st GROUP BY ALL
),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0),
ov AS (
  SELECT query_id, doc_id, round(count(DISTINCT term) / n, 6) AS score
  FROM (SELECT DISTINCT query_id, term FROM a) JOIN p USING (term) JOIN (SELECT query_id, count(*) AS n FROM a GROUP BY 1) USING (query_id) GROUP BY query_id, doc_id, n
),
ovr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ov),
rel AS (
  SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)
)
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.tokens(F.col("text")).alias("tokens"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("tokens"))


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's text: the judgements the measures use.

    Texts meet on the item's second to fifth word, so no document meets every item; items of fewer
    than five words have no judgements.
    """
    words = lambda c: F.split(c, r"[\x20\x09-\x0D]+")
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("wanted"), F.concat_ws(" ", F.slice(words(F.col("text")), 2, 4)).alias("k"))
    # The generator keeps the split from being evaluated once a gram.
    split = spread(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.array(words(F.col("text")))).alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("w", i, F.lit(4))))
    met = split.select("doc_id", F.explode(F.array_distinct(grams)).alias("k")).join(items, "k").select("doc_id", "query_id", "wanted").distinct()
    return met.join(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("wanted"))).select("query_id", "doc_id")


@register(QUERIES, ORACLE, _BASE + "SELECT query_id, doc_id, score, rank FROM bmr WHERE rank <= 10")
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir), 10).select("query_id", "doc_id", "score", "rank")


@register(QUERIES, ORACLE, _BASE + "SELECT query_id, doc_id, score, rank FROM ovr WHERE rank <= 10")
def overlap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.overlap_share(_docs(spark, sf_dir), _asked(spark, sf_dir), 10).select("query_id", "doc_id", "score", "rank")


_FUSED = """,
fu AS (
  SELECT query_id, doc_id, round(sum(w / (60 + rank)), 6) AS score, string_agg(route, ',' ORDER BY route) AS routes
  FROM (SELECT query_id, doc_id, rank, '0' AS route, 1.0 AS w FROM bmr WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank, '1', {w} FROM ovr WHERE rank <= 20) GROUP BY ALL
),
fur AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu)
"""


def _routes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    return [retrieval.bm25(docs, asked, 20), retrieval.overlap_share(docs, asked, 20)]


@register(QUERIES, ORACLE, _BASE + _FUSED.format(w="1.0") + "SELECT query_id, doc_id, score, routes, rank FROM fur WHERE rank <= 10")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rrf(_routes(spark, sf_dir), 10).select("query_id", "doc_id", "score", "routes", "rank")


@register(QUERIES, ORACLE, _BASE + _FUSED.format(w="0.4") + "SELECT query_id, doc_id, score, routes, rank FROM fur WHERE rank <= 10")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rrf(_routes(spark, sf_dir), 10, weights=[1.0, 0.4]).select("query_id", "doc_id", "score", "routes", "rank")


_GATED = """,
g AS (SELECT query_id, max(score) AS top_score, CASE WHEN max(score) >= 60 THEN 'correct' WHEN max(score) < 25 THEN 'incorrect' ELSE 'ambiguous' END AS action FROM {r} GROUP BY 1)
SELECT query_id, doc_id, score, rank, top_score, action FROM {r} JOIN g USING (query_id)
WHERE rank <= CASE action WHEN 'correct' THEN 5 WHEN 'ambiguous' THEN 10 ELSE 0 END
"""


@register(QUERIES, ORACLE, _BASE + _GATED.format(r="bmr"))
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = retrieval.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir), 10)
    return retrieval.gate(ranked, 5, 60, 25).select("query_id", "doc_id", "score", "rank", "top_score", "action")


@register(
    QUERIES,
    ORACLE,
    _BASE + _FUSED.format(w="1.0") + ", g AS (SELECT query_id, CASE WHEN max(score) >= 60 THEN 'correct' WHEN max(score) < 25 THEN 'incorrect' ELSE 'ambiguous' END AS action FROM bmr GROUP BY 1)"
    " SELECT query_id, doc_id, score, rank, action FROM fur JOIN g USING (query_id) WHERE rank <= CASE action WHEN 'correct' THEN 5 WHEN 'ambiguous' THEN 10 ELSE 0 END",
)
def hybrid_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lexical routes fused by rank, kept as the first route's confidence allows."""
    routes = _routes(spark, sf_dir)
    best = routes[0].groupBy("query_id").agg(F.max("score").alias("t"))
    action = F.when(F.col("t") >= 60, "correct").when(F.col("t") < 25, "incorrect").otherwise("ambiguous")
    fused = retrieval.rrf(routes, 10).join(best.select("query_id", action.alias("action")), "query_id")
    kept = F.when(F.col("action") == "correct", 5).when(F.col("action") == "ambiguous", 10).otherwise(0)
    return fused.where(F.col("rank") <= kept).select("query_id", "doc_id", "score", "rank", "action")


@register(QUERIES, ORACLE, _BASE + ", t AS (SELECT query_id, max(score) AS s FROM bmr GROUP BY 1) SELECT CASE WHEN s >= 60 THEN 'correct' WHEN s < 25 THEN 'incorrect' ELSE 'ambiguous' END AS action, count(*) AS n FROM t GROUP BY 1")
def gate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir), 1)
    action = F.when(F.col("score") >= 60, "correct").when(F.col("score") < 25, "incorrect").otherwise("ambiguous")
    return best.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


_SCORED = """,
n AS (SELECT query_id, count(DISTINCT doc_id) AS n FROM rel GROUP BY 1),
h AS (SELECT b.query_id, rank, r.doc_id IS NOT NULL AS hit FROM bmr b LEFT JOIN (SELECT DISTINCT * FROM rel) r ON b.query_id = r.query_id AND b.doc_id = r.doc_id WHERE rank <= 10),
f AS (SELECT query_id, count(*) FILTER (hit) AS found, count(*) AS shown, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY 1),
sc AS (
  SELECT n.query_id, round(coalesce(found / n, 0), 6) AS recall, round(coalesce(found / 10, 0), 6) AS precision,
         round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg,
         round(coalesce((shown - found) / shown, 0), 6) AS false_share
  FROM n LEFT JOIN f USING (query_id)
)
"""


@register(QUERIES, ORACLE, _BASE + _SCORED + "SELECT * FROM sc")
def ranking_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.score_rankings(retrieval.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir), 10), _relevant(spark, sf_dir), 10)


@register(QUERIES, ORACLE, _BASE + _SCORED + "SELECT count(*) AS queries, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(ndcg), 4) AS ndcg, round(avg(false_share), 4) AS false_share FROM sc")
def ranking_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.macro(ranking_measures(spark, sf_dir))


_RANKS = """,
ar AS (SELECT r.query_id, coalesce(min(rank), 21) AS answer_rank FROM (SELECT DISTINCT * FROM rel) r LEFT JOIN (SELECT * FROM bmr WHERE rank <= 20) b ON b.query_id = r.query_id AND b.doc_id = r.doc_id GROUP BY 1)
"""


@register(QUERIES, ORACLE, _BASE + _RANKS + "SELECT query_id, answer_rank FROM ar")
def answer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.answer_rank(retrieval.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir), 20), _relevant(spark, sf_dir), 21)


@register(
    QUERIES,
    ORACLE,
    _BASE + _RANKS + "SELECT count(*) AS n, count(*) FILTER (answer_rank < 21) AS ranked, round(median(answer_rank), 4) AS median_all, round(avg(answer_rank), 4) AS mean_all,"
    " round(median(answer_rank) FILTER (answer_rank < 21), 4) AS median_ranked, round(avg(answer_rank) FILTER (answer_rank < 21), 4) AS mean_ranked FROM ar",
)
def answer_rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_summary(answer_ranks(spark, sf_dir), 21)


@register(QUERIES, ORACLE, _BASE + "SELECT k, round(avg(least(k, n) / n), 6) AS ceiling FROM (SELECT query_id, count(DISTINCT doc_id) AS n FROM rel GROUP BY 1), (VALUES (1), (3), (5), (10)) t(k) GROUP BY k")
def recall_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ceiling(_relevant(spark, sf_dir), [1, 3, 5, 10])


@register(QUERIES, ORACLE, f"SELECT doc_id, len(t) AS n_tokens, list_unique(t) AS n_kinds FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_kinds"))


_STEM_SQL = "CASE WHEN w LIKE '%ing' AND len(w) > 5 THEN w[:-4] WHEN w LIKE '%edly' AND len(w) > 6 THEN w[:-5] WHEN w LIKE '%ed' AND len(w) > 4 THEN w[:-3] WHEN w LIKE '%es' AND len(w) > 4 THEN w[:-3] WHEN w LIKE '%s' AND len(w) > 3 THEN w[:-2] ELSE w END"


@register(QUERIES, ORACLE, f"SELECT stem, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, {_STEM_SQL} AS stem FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS w FROM documents)) GROUP BY 1")
def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select("doc_id", F.explode(T.stems(F.col("tokens"))).alias("stem"))
    per_doc = words.groupBy("stem", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@register(QUERIES, ORACLE, r"SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[一-鿿]|[^\sA-Za-z0-9_一-鿿]+')) AS n_tokens FROM conversations")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).cast("long").alias("n_tokens"))


@register(QUERIES, ORACLE, "SELECT conv_id, count(*) AS turns, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def session_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY turn)").alias("text"))


# Vectors: every row whose id divides by 20 asks all rows, itself left in.
_Q = "vec_id % 20 = 0"


@register(
    QUERIES,
    ORACLE,
    f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings v WHERE q.{_Q})
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)
def vector_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return retrieval.flat_search(vectors, asked, 10)


@register(
    QUERIES,
    ORACLE,
    f"""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE {_Q}),
    s AS (SELECT query_id, vec_id AS doc_id, label, round(list_inner_product(e::DOUBLE[], embedding::DOUBLE[]), 5) AS score FROM q, embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT e.label, count(*) AS pairs, round(avg((r.label = e.label)::INT), 6) AS same_label FROM r JOIN embeddings e ON e.vec_id = r.query_id WHERE rank <= 10 GROUP BY 1""",
)
def vector_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = vector_flat(spark, sf_dir).join(labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("got")), "doc_id")
    both = found.join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("got") == F.col("label")).cast("int")), 6).alias("same_label"))


@register(QUERIES, ORACLE, "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, list_sum(list_transform(embedding, lambda x: (x > 0)::INT))::BIGINT AS positive FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    square = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(square), 5).alias("norm"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"))


@register(
    QUERIES,
    ORACLE,
    f"""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS s FROM embeddings),
    h AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(1 - list_sum(list_transform(list_zip(q.s, v.s), lambda z: (z[1] <> z[2])::INT)) / len(q.s), 6) AS score FROM b q, b v WHERE q.{_Q})
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h) WHERE rank <= 10""",
)
def vector_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries against all rows by their signs."""
    rows = load(spark, sf_dir, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return retrieval.binary_search(vectors, vectors.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 10)


@register(
    QUERIES,
    ORACLE,
    """WITH v AS (SELECT vec_id, vec_id % 7 AS version, vec_id % 11 = 0 AS deleted, label, vec_id % 300 AS doc_id FROM embeddings)
    SELECT doc_id, version, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, vec_id DESC) AS r FROM v) WHERE r = 1 AND NOT deleted""",
)
def live_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select((F.col("vec_id") % 300).alias("doc_id"), F.struct(F.col("vec_id") % 7, "vec_id").alias("version"), (F.col("vec_id") % 11 == 0).alias("deleted"), "label")
    return retrieval.live(v).select("doc_id", F.col("version.col1").alias("version"), "label")
