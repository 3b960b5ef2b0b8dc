"""Mixing sources to target weights, in DataFrame functions only.

Words are counted per source; sources in code-point order (null last) get weights 1, 2, 3,
repeating; a source's target is its weighted share of all words, at most ``CAP`` times its own
size, the excess going to the other sources by weight. Each document is emitted floor(rate) times,
rate = target / source size, plus once more with probability equal to the fraction, decided by a
hash of the seed, its doc_id and its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import save

CAP = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``rank``, 0 for the first row in the order of ``keys``: a range-partitioned sort
    whose partitions are numbered on their own and shifted by the sizes of those before them."""
    rows = save(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row a partition of the sort, not a row of the data.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(before, "_part").withColumn("rank", F.col("_row") + F.col("_before")).drop("_at", "_part", "_row", "_n", "_before")


def source_targets(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, rate), one row a source; null is a source of its own, the last.

    All targets together are all words (or ``cap`` times that of the capped where all are). Sources
    without words have target and rate 0.
    """
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = save(ranked(sizes.withColumn("_null", F.col("source").isNull()), "_null", "source").withColumn("weight", weigh), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # Capping a source raises the level of the others; each round takes one pass over the sources.
    level, capped = None, 0
    while True:
        now = sources if level is None else sources.where(~(F.col("source_size") * cap * F.lit(float(level[1])) <= F.col("weight") * F.lit(float(level[0]))))
        held = now.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum("source_size").alias("s")).first()
        everything = sources.agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("s")).first()
        n_capped = everything.n - held.n
        if level is not None and (n_capped == capped or not held.n):
            break
        capped = n_capped
        level = (total - cap * ((everything.s or 0) - (held.s or 0)), held.w or 1)
    share = F.lit(float(level[0])) * F.col("weight") / F.lit(float(level[1]))
    most = (F.col("source_size") * cap).cast("double")
    full = F.col("source_size") * cap * F.lit(float(level[1])) <= F.col("weight") * F.lit(float(level[0]))
    target = F.when(full, most).otherwise(share)
    return sources.select("source", "source_size", target.alias("target"), F.coalesce(F.try_divide(target, F.col("source_size")), F.lit(0.0)).alias("rate"))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan(docs: DataFrame, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies): each row of ``docs`` as one struct, and how often it is taken.

    The copies of equal rows are decided alike; null texts have size 0. Rows travel as structs, so
    columns of any name stay as they are. The rates meet the documents by a join on the source whose
    side Spark broadcasts only if the written table of sources is small; otherwise both are sorted,
    and a hot source is split by the adaptive skew join.
    """
    rates = save(source_targets(docs, cap), "rates").withColumnRenamed("source", "own")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    chance = uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    met = rows.join(rates, F.col("source").eqNullSafe(F.col("own")))
    return met.select("row", "doc_id", word_count(F.col("text")).alias("size"), "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixture: each row of ``docs`` as often as it is taken, columns unchanged, whatever their names."""
    taken_rows = plan(docs, cap, seed).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return taken_rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def taken(docs: DataFrame, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row a row of ``docs``."""
    return plan(docs.select("doc_id", "text", "source"), cap, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same rows by DuckDB: capped sources are those whose cap to weight ratio is at or below the level.
TAKEN_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS r FROM d GROUP BY source
), w AS (SELECT source, n, r % 3 + 1 AS w FROM s),
o AS (
  SELECT *, sum(n) OVER (ORDER BY 3.0 * n / w, r_ ROWS UNBOUNDED PRECEDING) - n AS n_before,
         sum(w) OVER (ORDER BY 3.0 * n / w, r_ ROWS UNBOUNDED PRECEDING) - w AS w_before, sum(n) OVER () AS total, sum(w) OVER () AS w_all
  FROM (SELECT *, row_number() OVER () AS r_ FROM w)
), c AS (
  SELECT *, (3 * n)::DOUBLE * (w_all - w_before) <= w * (total - 3 * n_before)::DOUBLE AS capped FROM o
), l AS (
  SELECT (any_value(total) - 3 * coalesce(sum(n) FILTER (capped), 0))::DOUBLE AS rest, coalesce(sum(w) FILTER (NOT capped), 1)::DOUBLE AS w_rest FROM c
), t AS (
  SELECT source, n, CASE WHEN capped THEN (3 * n)::DOUBLE ELSE rest * w / w_rest END AS target FROM c, l
), q AS (
  SELECT d.*, t.n, t.target, CASE WHEN t.n = 0 THEN 0.0 ELSE t.target / t.n END AS rate,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, n AS source_size, target, (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) * size AS taken FROM q
"""
