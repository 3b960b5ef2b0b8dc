"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns give the seed entities of four kinds. Loose shapes of each kind give candidate
instances. The one or two words before an occurrence are its lexical pattern. Patterns and
instances form a graph over all documents that hold either; a pattern's score is the share of all
its occurrences that stand before an instance, weighted by the instances' scores, and an
instance's score is that of not being missed by all its patterns. A few rounds of these two
aggregations spread confidence from the seeds. Occurrences of confident instances behind
confident patterns are added to the base spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import SMALL, save, side_join

KINDS = ("email", "ip", "card", "phone")
#: Leftmost matches. Possessive repeats match the same text and need no stack; the guards before
#: the first class say that a match begins where a run of it does, or right after the last match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Shapes that only a confident context makes an identifier.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.:-])[0-9]{1,3}+(?:[.:-][0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9])\(?[0-9](?:[\x20().0-9/-]{0,2}[0-9]){6,14}+(?![0-9])",
}
#: A text without this holds no match of any pattern above.
ANY = r"@|\[at\]|\(at\)|\+[0-9]|[0-9][.:-][0-9]|[0-9][\x20().0-9/-]*[0-9]"
ROUNDS, CONFIDENT, SUPPORT = 3, 0.6, 3
#: Characters a block when spans are cut out of a text.
BLOCK = 1024
_SPACE = r"[\x20\x09-\x0D]+"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a short string of digits passes the Luhn check."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(match, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255
        )
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _matches(texts: DataFrame, kind: str, pattern: str, base: bool) -> DataFrame:
    """(key, kind, base, gap, match, at) of each match, gap being the text since the one before."""
    found = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"))
    rows = texts.where(F.col("text").rlike(pattern)).select("key", F.posexplode(found).alias("at", "m"))
    return rows.where("m.match IS NOT NULL").select("key", F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), "at", F.col("m.gap").alias("gap"), F.col("m.match").alias("match"))


def occurrences(texts: DataFrame) -> DataFrame:
    """(key, kind, base, start, end, match, one, two): all base spans that hold, and loose ones outside them.

    ``one`` and ``two`` are the last one and two words before the span, in lower case (null: none).
    """
    parts = [_matches(texts, k, p, base) for base, patterns in ((True, BASE), (False, LOOSE)) for k, p in patterns.items()]
    rows = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("key", "kind", "base").orderBy("at")
    end = F.sum(F.length("gap") + F.length("match")).over(order)
    # The last two words, found from the end: one pass, however long the words are.
    ends = F.reverse(F.regexp_extract(F.reverse("gap"), r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+[^\x20\x09-\x0D]*+", 0))
    words = F.filter(F.split(F.lower(ends), _SPACE), lambda w: w != "")
    placed = rows.select("key", "kind", "base", "match", words.alias("words"), end.cast("long").alias("end")).withColumn("start", F.col("end") - F.length("match"))
    placed = placed.withColumn("one", F.try_element_at("words", F.lit(-1))).withColumn("two", F.when(F.size("words") > 1, F.concat_ws(" ", F.element_at("words", -2), F.element_at("words", -1))))
    held = reduce(lambda acc, k: acc.when((F.col("kind") == KINDS.index(k)) & F.col("base"), _valid(k, F.col("match"))), KINDS, F.when(F.lit(False), F.lit(False))).otherwise(True)
    placed = placed.where(held)
    by_start = Window.partitionBy("key").orderBy("start", "end")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    # The rows from here on, read backwards: both windows grow by one row a step.
    backwards = Window.partitionBy("key").orderBy(F.desc("start"), F.desc("end"))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    clear = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    return placed.withColumn("_clear", clear).where("base OR _clear").select("key", "kind", "base", "start", "end", "match", "one", "two")


def spoken(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each of ``patterns`` (pattern; one or two words) occurs in all of ``docs``.

    Counts are summed within tasks before anything is shuffled. Patterns are broadcast up to
    ``SMALL`` rows; beyond that all words and pairs are counted first and joined then.
    """
    words = F.filter(F.split(F.lower("text"), _SPACE), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(F.concat(words, F.array(F.lit(""))), 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    said = docs.where("text IS NOT NULL").select(F.explode(F.concat(words, pairs)).alias("pattern"))
    if patterns.count() <= SMALL:
        return said.join(F.broadcast(patterns), "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).cast("double").alias("total"))
    return said.groupBy("pattern").agg(F.count(F.lit(1)).cast("double").alias("total")).join(patterns, "pattern", "left_semi")


def discover(docs: DataFrame, found: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """The loose rows of ``found`` that confident contexts confirm, without overlaps within a kind.

    ``docs`` are all documents, (text): a pattern's trust is a share of all its occurrences.
    """
    edges = found.select("kind", "base", "match", "rows", F.explode(F.array("one", "two")).alias("pattern")).where("pattern IS NOT NULL")
    edges = save(edges.groupBy("kind", "pattern", F.lower("match").alias("instance")).agg(F.max("base").alias("seed"), F.sum("rows").cast("double").alias("n")), "edges")
    # Patterns that stand before too few different seeds can confirm nothing.
    able = save(edges.where("seed").groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= support), "patterns")
    total = save(spoken(docs, able.select("pattern").distinct()), "totals")
    able = able.select("kind", "pattern").join(total, "pattern", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    graph = save(side_join(edges, able, ["kind", "pattern"]), "graph")
    scores = graph.select("kind", "instance", F.col("seed").cast("double").alias("score")).groupBy("kind", "instance").agg(F.max("score").alias("score"))
    for _ in range(rounds):
        patterns = graph.join(scores, ["kind", "instance"]).groupBy("kind", "pattern").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.sum("n").alias("n"), F.first("total").alias("total"))
        patterns = save(patterns.select("kind", "pattern", F.least(F.lit(1.0), F.col("hits") / F.greatest("n", "total")).alias("trust")), "trust")
        missed = F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.999))))
        told = side_join(graph, patterns, ["kind", "pattern"])
        scores = save(told.groupBy("kind", "instance").agg(F.greatest(F.max(F.col("seed").cast("double")), 1 - F.exp(missed)).alias("score")), "scores")
    trusted = patterns.where(F.col("trust") >= confident).select("kind", "pattern")
    known = scores.where(F.col("score") >= confident).select("kind", F.col("instance"))
    loose = found.where("NOT base").withColumn("instance", F.lower("match")).join(known, ["kind", "instance"], "left_semi")
    either = side_join(loose.withColumn("pattern", F.explode(F.array_compact(F.array("one", "two")))), trusted, ["kind", "pattern"], "left_semi")
    return either.select("key", "kind", "start", "end").distinct()


def _spans(rows: DataFrame, name: str) -> DataFrame:
    """(key, name, name_text): the spans of a text in order, as structs and as kind:start:end."""
    said = F.transform(name, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"]))
    return rows.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias(name)).withColumn(f"{name}_text", F.array_join(said, ","))


def _search(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flagged rows with key, base spans a key, all spans a key); ``docs`` has text and one more column.

    A text's key is its SHA-256. Equal texts are searched once and count as often as they occur.
    """
    flagged = docs.where(F.col("text").rlike(ANY)).withColumn("key", F.sha2("text", 256))
    texts = save(flagged.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("rows")), "flagged")
    found = occurrences(texts.select("key", "text")).join(texts.select("key", "rows"), "key")
    found = save(found, "occurrences")
    extra = discover(docs.select("text"), found)
    base = found.where("base").select("key", "kind", "start", "end")
    every = save(_spans(base.union(extra), "every"), "every")
    return flagged, save(_spans(base, "own"), "own"), every


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row a row of ``docs``.

    Counts and the digest are of the base spans; ``spans`` lists these and the discovered ones as
    kind:start:end, by kind, then start. Null and empty texts have none. Equal texts are searched
    once. Only doc_id and text are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    flagged, own, every = _search(docs)
    keyed = flagged.select("doc_id", "key").join(own, "key", "left").join(every, "key", "left")
    clean = docs.where(~F.col("text").rlike(ANY)).select("doc_id", F.lit(None).cast(own.schema["own"].dataType).alias("own"), F.lit("").alias("own_text"), F.lit("").alias("every_text"))
    rows = keyed.select("doc_id", "own", "own_text", "every_text").unionByName(clean)
    n = [F.array_size(F.filter(F.transform("own", lambda s: s["kind"]), lambda kind: kind == F.lit(k))) for k in range(len(KINDS))]
    counts = [F.when(F.col("own").isNull(), 0).otherwise(c).cast("long").alias(f"n_{name}") for c, name in zip(n, KINDS, strict=True)]
    return rows.select("doc_id", *counts, F.sha2(F.coalesce("own_text", F.lit("")), 256).alias("base_sha256"), F.coalesce("every_text", F.lit("")).alias("spans"))


def _gaps(every: DataFrame) -> DataFrame:
    """(key, cuts): runs of overlapping spans in order, as (start, end, kind of the first span)."""
    rows = every.select("key", F.explode("every").alias("s")).select("key", "s.start", "s.end", "s.kind")
    order = Window.partitionBy("key").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True))).withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    whole = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    return whole.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))


def _between(blocks: Column, a: Column, b: Column) -> Column:
    """The characters a..b of a text given as blocks of BLOCK characters: no more than its own blocks are touched."""
    first, last = (a / BLOCK).cast("int"), (b / BLOCK).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    head = F.substring(block(first), (a % BLOCK + 1).cast("int"), F.lit(BLOCK))
    inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    one = F.substring(block(first), (a % BLOCK + 1).cast("int"), (b - a).cast("int"))
    return F.when(first == last, one).otherwise(F.concat(head, inner, F.substring(block(last), F.lit(1), (b % BLOCK).cast("int"))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null texts stay null. All other columns, of any name, stay as they are.
    """
    names, (of_row, of_text) = docs.columns, ("row", "text")
    rows = docs.select(F.struct(*[f"`{c}`" for c in names]).alias(of_row), F.col("text").cast("string").alias(of_text))
    flagged, _, every = _search(rows)
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    said = lambda k: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), k + 1)), F.lit("]"))
    cut = flagged.join(_gaps(every), "key").select(of_row, blocks.alias("blocks"), "cuts", F.length("text").cast("long").alias("n"))
    # What stands before each cut, and its name; then what stands after the last one.
    before = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda c: c["end"]))
    pieces = F.transform("cuts", lambda c, i: F.concat(_between(F.col("blocks"), F.get(F.col("before"), i), c["start"]), said(c["kind"])))
    changed = cut.withColumn("before", before).select(of_row, F.concat(F.array_join(pieces, ""), _between(F.col("blocks"), F.element_at("before", -1), F.col("n"))).alias("new"))
    keys = every.select("key")
    same = flagged.join(keys, "key", "left_anti").select(of_row)
    rest = rows.where(~F.coalesce(F.col("text").rlike(ANY), F.lit(False))).select(of_row)
    field = lambda c: F.col(f"row.`{c}`").alias(c)
    changed = changed.select(*[F.col("new").alias(c) if c == "text" else field(c) for c in names])
    return same.unionAll(rest).select(*map(field, names)).unionAll(changed)
