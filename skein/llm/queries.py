"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import table
from skein.llm.hard_negatives import MINE_SQL
from skein.llm.mixing import TAKEN_SQL
from skein.llm.phrases import COLLOCATIONS_SQL
from skein.llm.url_filter import JUDGE_SQL
from skein.llm.warc import ROUND_TRIP_SQL


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.decontam import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.mixing import taken

    return taken(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.fingerprints import with_next

    return with_next(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.langid import classify

    return classify(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.hard_negatives import mine

    return mine(table(spark, sf_dir, "embeddings"), relabel=(7, 10))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.llm.secret_scan import find

    return find(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_fingerprints": op7_fingerprints,
    "op8_langid": op8_langid,
    "op9_near_dup": op9_near_dup,
    "op10_url_filter": op10_url_filter,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_secrets": op13_secrets,
}
ORACLE: dict[str, str] = {"op4_mixing": TAKEN_SQL, "op6_warc": ROUND_TRIP_SQL, "op10_url_filter": JUDGE_SQL, "op11_hard_negatives": MINE_SQL, "op12_collocations": COLLOCATIONS_SQL}
