"""Secrets in texts by patterns and by character Markov models, in DataFrame functions only.

Base patterns give three kinds of spans: assignments to telling names, access keys and long runs of
hexadecimal digits. A fourth kind, ``random``, is added by two Markov models of order one over the
characters of long tokens: one of random strings, one of ordinary identifiers. A token whose
log-likelihood ratio beats the prior odds is a secret.

The models are trained on labelled samples from the corpus itself. Random: the values that the base
patterns found, and the base64 form of their digests, which spreads them over the wider alphabet
(digests of fixed seeds where a corpus holds no value). Ordinary: words of a bounded sample of
documents, on their own and joined as names and paths are written. All else covers every document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import save

KINDS = ("assign", "access", "hex", "random")
_VALUE = r"[A-Za-z0-9+/_.=-]"
_NAME = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+"""
#: Leftmost matches; possessive repeats match the same text and need no stack. The last is the shape
#: that only the models can make a secret: a long token with a letter, and a digit or a change of case.
PATTERNS = {
    "assign": _NAME + _VALUE + "++",
    "access": r"AKIA[A-Z0-9]{16,}+|AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "random": r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_-]*+[A-Za-z])(?=[A-Za-z0-9+/_-]*?(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_-]{16,}+={0,2}+",
}
#: A text without this holds no match of any pattern above.
ANY = "|".join([_NAME + _VALUE, "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}", PATTERNS["random"]])
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: The characters of a token, after the mark of its start.
ALPHABET = "^ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
#: Documents (about) and strings (at most) of each class that the models are fitted on.
SAMPLE_DOCS, SAMPLE_STRINGS = 5_000, 50_000
#: Counts added to every transition, and the odds against a long token's being a secret.
SMOOTH, ODDS_AGAINST = 0.5, 10_000.0


def value(kind: Column, match: Column) -> Column:
    """What a match keeps secret: an assignment's right side, else all of it."""
    return F.when(kind == 0, F.regexp_replace(match, "^" + _NAME, "")).otherwise(match)


def _matches(texts: DataFrame, kind: int) -> DataFrame:
    """(key, kind, at, gap, match) of each match of a pattern, gap being the text since the one before."""
    pattern = PATTERNS[KINDS[kind]]
    found = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"))
    rows = texts.where(F.col("text").rlike(pattern)).select("key", F.posexplode(found).alias("at", "m"))
    return rows.where("m.match IS NOT NULL").select("key", F.lit(kind).alias("kind"), "at", F.col("m.gap").alias("gap"), F.col("m.match").alias("match"))


def occurrences(texts: DataFrame) -> DataFrame:
    """(key, kind, start, end, match): base spans that hold, and long tokens outside all of them."""
    rows = reduce(DataFrame.unionByName, [_matches(texts, k) for k in range(len(KINDS))])
    end = F.sum(F.length("gap") + F.length("match")).over(Window.partitionBy("key", "kind").orderBy("at"))
    placed = rows.select("key", "kind", "match", end.cast("long").alias("end")).withColumn("start", F.col("end") - F.length("match"))
    kind = F.col("kind")
    holds = F.when(kind == 0, F.length(value(kind, F.col("match"))) >= LEAST_VALUE).when(kind == 1, F.length("match") >= LEAST_ACCESS).otherwise(True)
    placed = placed.where(holds)
    base = kind < 3
    # The last end of a base span that begins before or here, and the first start of one from here on.
    forwards, backwards = (Window.partitionBy("key").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (("start", "kind"), (F.desc("start"), F.desc("kind"))))
    before, after = F.max(F.when(base, F.col("end"))).over(forwards), F.min(F.when(base, F.col("start"))).over(backwards)
    clear = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    return placed.withColumn("_clear", clear).where(base | F.col("_clear")).select("key", "kind", "start", "end", "match")


def random_strings(found: DataFrame) -> DataFrame:
    """(string): distinct values of base spans and the base64 forms of their digests, a bounded sample by hash."""
    spark = found.sparkSession
    known = found.where("kind < 3").select(value(F.col("kind"), F.col("match")).alias("v")).where(F.length("v") >= 16).distinct()
    known = known.orderBy(F.xxhash64("v"), "v").limit(SAMPLE_STRINGS)
    seeds = spark.range(256).select(F.col("id").cast("string").alias("v"))
    wide = lambda rows: rows.select(F.rtrim(F.base64(F.unhex(F.sha2("v", 256))), F.lit("=")).alias("string"))
    return known.select(F.col("v").alias("string")).union(wide(known)).union(wide(seeds))


def ordinary_strings(docs: DataFrame) -> DataFrame:
    """(string): words of a sample of documents, and names and paths made of two words and a number."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE_DOCS))) == 0)
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,24}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("w")).distinct()
    words = words.orderBy(F.xxhash64("w"), "w").limit(SAMPLE_STRINGS)
    number = F.pmod(F.xxhash64("w", F.lit(1)), F.lit(2100)).cast("string")
    # The second half of a word stands for a second word.
    half = F.expr("substring(w, div(length(w), 2) + 1)")
    forms = [
        F.col("w"), F.concat_ws("_", F.lower("w"), F.lower(half)), F.concat(F.lower("w"), F.initcap(half)), F.concat_ws("-", F.lower("w"), F.lower(half), number),
        F.concat(F.initcap("w"), F.initcap(half), number), F.concat_ws("/", F.lower("w"), F.lower(half), number), F.concat_ws("_", F.upper("w"), F.upper(half)), F.concat_ws("/", number, F.initcap("w"), half),
    ]
    return words.select(F.explode(F.array(*forms)).alias("string"))


def _steps(strings: DataFrame, *keep: str) -> DataFrame:
    """Each transition of ``strings`` (string) as ``pair``, the first from the mark of the start; a hyphen is read as an underscore."""
    marked = F.concat(F.lit("^"), F.translate("string", "-", "_"))
    return strings.select(*keep, marked.alias("_m")).select(*keep, "_m", F.explode(F.sequence(F.lit(1), F.length("_m") - 1)).alias("_i")).select(*keep, F.substring("_m", F.col("_i"), F.lit(2)).alias("pair"))


def fit(random: DataFrame, ordinary: DataFrame) -> DataFrame:
    """(pair, ratio): the log-likelihood ratio of every transition, one row each of len(ALPHABET) ** 2."""
    spark: SparkSession = random.sparkSession
    counted = []
    for name, strings in (("r", random), ("o", ordinary)):
        counted.append(_steps(strings).groupBy("pair").agg(F.count(F.lit(1)).cast("double").alias(name)))
    v = len(ALPHABET)
    letter = lambda at: F.substring(F.lit(ALPHABET), (at + 1).cast("int"), F.lit(1))
    grid = spark.range(v * v).select(F.concat(letter(F.floor(F.col("id") / v)), letter(F.col("id") % v)).alias("pair"))
    rows = grid.join(counted[0], "pair", "left").join(counted[1], "pair", "left").withColumn("_from", F.substring("pair", 1, 1))
    all_from = Window.partitionBy("_from")
    share = lambda c: F.log((F.coalesce(c, F.lit(0.0)) + SMOOTH) / (F.coalesce(F.sum(c).over(all_from), F.lit(0.0)) + SMOOTH * v))
    return rows.select("pair", (share(F.col("r")) - share(F.col("o"))).alias("ratio"))


def scores(tokens: DataFrame, model: DataFrame) -> DataFrame:
    """(string, score): the log-likelihood ratio of each distinct string of ``tokens``."""
    steps = _steps(tokens.select("string").distinct(), "string")
    return steps.join(F.broadcast(model), "pair").groupBy("string").agg(F.round(F.sum("ratio"), 6).alias("score"))  # len(ALPHABET) ** 2 rows


def _search(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flagged rows of ``docs`` with key, spans (key, kind, start, end, match, score)); ``docs`` has text.

    A text's key is its SHA-256. Equal texts are searched once; base spans have no score.
    """
    flagged = docs.where(F.col("text").rlike(ANY)).withColumn("key", F.sha2("text", 256))
    texts = save(flagged.groupBy("key").agg(F.first("text").alias("text")), "secret-texts")
    found = save(occurrences(texts), "secret-spans")
    model = save(fit(random_strings(found), ordinary_strings(docs.select("text"))), "secret-model")
    told = scores(found.where("kind = 3").select(F.col("match").alias("string")), model).where(F.col("score") > F.log(F.lit(ODDS_AGAINST)))
    added = found.where("kind = 3").join(told, F.col("match") == F.col("string")).drop("string")
    return flagged, found.where("kind < 3").withColumn("score", F.lit(None).cast("double")).unionByName(added)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value, score): every secret of every row of ``docs``, in code points, end exclusive."""
    flagged, found = _search(_texts(docs))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    told = found.select("key", name.alias("kind"), "start", "end", value(F.col("kind"), F.col("match")).alias("value"), "score")
    return flagged.select("doc_id", "key").join(told, "key").drop("key")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row a row of ``docs``.

    Counts and the digest are of the base spans; ``spans`` lists these and the added ones as
    kind:start:end, by start, then kind, comma-joined. Null and empty texts have none; repeated rows
    give repeated rows, null ids stay null. Only doc_id and text are read.
    """
    docs = _texts(docs)
    flagged, found = _search(docs)
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    listed = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    own = F.filter("all", lambda s: s["kind"] < 3)
    n = [F.array_size(F.filter("all", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]  # noqa: B023
    told = save(listed.select("key", *n, F.sha2(said(own), 256).alias("base_sha256"), said("all").alias("spans")), "secret-digests")
    keyed = flagged.select("doc_id", "key").join(told, "key", "left")
    clean = docs.where(~F.col("text").rlike(ANY)).select("doc_id")
    rows = keyed.drop("key").unionByName(clean, allowMissingColumns=True)
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return rows.select("doc_id", *zero, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
