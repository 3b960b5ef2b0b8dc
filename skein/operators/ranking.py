"""Measures of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_rankings(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, precision, ndcg, false_share) at k; precision divides by k.

    ``relevant`` has (query_id, doc_id); queries without any are left out, those without results score 0.
    """
    pairs = relevant.select("query_id", "doc_id").distinct()
    sizes = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.where(F.col("rank") <= k).join(pairs.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    found = hits.groupBy("query_id").agg(
        F.count("hit").alias("found"), F.count(F.lit(1)).alias("shown"), F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    return sizes.join(found, "query_id", "left").select(
        "query_id",
        F.round(F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.col("found") / F.lit(k), F.lit(0.0)), 6).alias("precision"),
        F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce((F.col("shown") - F.col("found")) / F.col("shown"), F.lit(0.0)), 6).alias("false_share"),
    )


def macro(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "ndcg", "false_share")])


def answer_rank(ranked: DataFrame, relevant: DataFrame, missing: int) -> DataFrame:
    """(query_id, answer_rank): the first relevant rank, or ``missing``."""
    hit = ranked.join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("r"))
    return relevant.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", F.coalesce("r", F.lit(missing)).alias("answer_rank"))


def rank_summary(ranks: DataFrame, missing: int) -> DataFrame:
    seen = F.when(F.col("answer_rank") < missing, F.col("answer_rank"))
    return ranks.agg(
        F.count(F.lit(1)).alias("n"), F.count(seen).alias("ranked"), F.round(F.median("answer_rank"), 4).alias("median_all"), F.round(F.avg("answer_rank"), 4).alias("mean_all"),
        F.round(F.median(seen), 4).alias("median_ranked"), F.round(F.avg(seen), 4).alias("mean_ranked"),
    )


def ceiling(relevant: DataFrame, ks: list[int]) -> DataFrame:
    """(k, ceiling): the recall a perfect ranking could reach, on average."""
    sizes = relevant.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n")).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return sizes.groupBy("k").agg(F.round(F.avg(F.least("k", "n") / F.col("n")), 6).alias("ceiling"))
