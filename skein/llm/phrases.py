"""Collocations: frequent phrases whose words keep together more than their counts would have it.

Three passes over the texts find candidates and a fourth counts them.

1. A sketch of the pairs of words of each language gives upper bounds of their counts.
2. Longer phrases whose pairs may all be frequent enter sketches of their own length.
3. Phrases that no sketch rules out are listed as text, with the words they are made of.
4. They are compiled into Aho-Corasick automata, every word guarded by a delimiter at both ends;
   shards of the texts are scanned, overlapping matches counted, and the counts summed.

Sketches only bound from above, so no frequent phrase is lost, however narrow they are; thresholds
and scores use the exact counts alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import save, small_batches
from skein.llm.textbatch import Words, mix, text_slices

_PIECE = b".,;:!?\n\x0b\x0c\r"
IS_PIECE = np.zeros(256, bool)
IS_PIECE[list(_PIECE)] = True
BREAKS = IS_PIECE.copy()
BREAKS[[32, 9]] = True
#: A-Z as a-z, tabs as spaces, ends of pieces as a byte that UTF-8 never has.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _PIECE, bytes(range(97, 123)) + b" " + b"\xff" * len(_PIECE))
_STEP = np.random.default_rng(20261128).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Cells of a sketch row: about a cell for CELL_BYTES bytes of text, within these bounds (a cell is a byte at thresholds up to 255).
CELL_BYTES, LEAST_CELLS, MOST_CELLS, ROWS, BLOCK = 64, 1 << 20, 1 << 26, 2, 1 << 16
#: Tasks that read the texts, for each core: what they give to be merged grows with these, not with the data.
TASKS_A_CORE = 2
#: Phrases a task counts at once while it looks for candidates.
MOST_SEEN = 1 << 22
#: Bytes of phrases in one automaton, and of all automata of one scan of the texts.
AUTOMATON_BYTES, SCAN_BYTES = 1 << 20, 1 << 22
SCAN_SLICE = 1 << 20
_BUILT: dict[str, dict[str, list]] = {}


class Runs:
    """The words of a slice of texts and the hashes of their phrases, those of unlike languages apart."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, languages: list[str]):
        self.words = w = Words(raw, offsets, BREAKS)
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in languages], np.uint64)
        self.doc = w.doc()
        self.hash = mix(w.hash ^ seeds[self.doc]) if len(w.hash) else w.hash
        ended = np.cumsum(IS_PIECE[raw])
        #: Whether a word and the next stand in one piece of one text.
        self.joined = (ended[w.start[1:]] == ended[w.start[:-1]]) & (self.doc[1:] == self.doc[:-1]) if len(w.start) else np.zeros(0, bool)

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, whether a phrase of that length begins at each word, its hash) for lengths from 2."""
        n = len(self.hash)
        total, whole = self.hash * _STEP[0], np.ones(n, bool)
        for k in range(2, longest + 1):
            if n < k:
                return
            total = total[: n - k + 1] + self.hash[k - 1 :] * _STEP[k - 1]
            whole = whole[: n - k + 1] & self.joined[k - 2 :]
            yield k, whole, mix(total + np.uint64(k))


class Sketch:
    """Rows of saturating counters: the least of a phrase's cells bounds its count from above."""

    def __init__(self, cells: int, cap: int):
        self.cells, self.cap, self.rows, self.waiting = cells, cap, {}, {}

    def add(self, level: int, hashes: np.ndarray) -> None:
        held = self.waiting.setdefault(level, [])
        held.append(hashes)
        if sum(map(len, held)) >= 1 << 20:
            self.settle(level)

    def settle(self, level: int) -> None:
        held = self.waiting.pop(level, [])
        if not held:
            return
        hashes = np.concatenate(held)
        for row in range(ROWS):
            own = self.rows.setdefault((level, row), np.zeros(self.cells, kind_of(self.cap)))
            cell, n = np.unique(cells_of(hashes, row, self.cells), return_counts=True)
            own[cell] = np.minimum(own[cell].astype(np.int64) + n, self.cap)

    def blocks(self) -> Iterator[tuple[int, int, int, bytes]]:
        for level in list(self.waiting):
            self.settle(level)
        pack = zstandard.ZstdCompressor(level=1)
        for (level, row), own in self.rows.items():
            for b in range(0, self.cells, BLOCK):
                part = own[b : b + BLOCK]
                if part.any():
                    yield level, row, b // BLOCK, pack.compress(part.tobytes())


def kind_of(cap: int) -> type:
    return np.uint8 if cap < 1 << 8 else np.uint16 if cap < 1 << 16 else np.uint32


def cells_of(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((hashes >> np.uint64(32 * row)) & np.uint64(cells - 1)).astype(np.uint32)


class Bounds:
    """Bitmaps of the cells that reach the threshold: ROWS x cells / 8 bytes a level."""

    def __init__(self, cells: int):
        self.cells, self.bits = cells, {}

    def put(self, level: int, row: int, block: int, bits: bytes) -> None:
        own = self.bits.setdefault((level, row), np.zeros(self.cells // 8, np.uint8))
        own[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(bits, np.uint8)

    def reach(self, level: int, hashes: np.ndarray) -> np.ndarray:
        """Whether each phrase may reach the threshold."""
        out = np.ones(len(hashes), bool)
        for row in range(ROWS):
            if (level, row) not in self.bits:
                return np.zeros(len(hashes), bool)
            cell = cells_of(hashes, row, self.cells)
            out &= (self.bits[level, row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Runs]:
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        for a, b, raw, off in text_slices(batch.column("text")):
            yield Runs(raw, off, languages[a:b])


def _sketched(docs: DataFrame, cells: int, threshold: int, longest: int, shared) -> DataFrame:
    """(level, row, block, data): the blocks of each task's sketches; ``shared`` has the bounds of pairs, or None to sketch those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, bounds = Sketch(cells, threshold), shared.value if shared else None
        for runs in _slices(batches):
            may = None
            for k, whole, hashes in runs.phrases(longest if bounds else 2):
                if bounds is None:
                    sketch.add(k, hashes[whole])
                elif k == 2:
                    pair = may = whole & bounds.reach(2, hashes)
                else:
                    may = may[:-1] & pair[k - 2 :]
                    sketch.add(k, hashes[may])
        for level, row, block, data in sketch.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["level", "row", "block", "data"])

    return docs.mapInArrow(run, "level int, row int, block int, data binary")


def _merged(sketches: DataFrame, bounds: Bounds, threshold: int, name: str) -> None:
    """Sum the tasks' blocks and put the cells that reach ``threshold`` into ``bounds``, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, unpack = None, None, zstandard.ZstdDecompressor()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in at), pa.array([np.packbits(total >= threshold).tobytes()], pa.binary())], names=["level", "row", "block", "bits"])

        for batch in batches:
            for level, row, block, data in zip(*(batch.column(c).to_pylist() for c in ("level", "row", "block", "data")), strict=True):
                if (level, row, block) != at:
                    if at:
                        yield told()
                    at, total = (level, row, block), np.zeros(BLOCK, np.int64)
                total += np.frombuffer(unpack.decompress(data), kind_of(threshold))
        if at:
            yield told()

    keys = ("level", "row", "block")
    bits = save(sketches.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "level int, row int, block int, bits binary"), name)
    for batch in bits.toArrow().to_batches():  # at most ROWS * cells / 8 bytes a level
        for level, row, block, data in zip(*(batch.column(c).to_pylist() for c in (*keys, "bits")), strict=True):
            bounds.put(level, row, block, data)


def _candidates(docs: DataFrame, shared, longest: int, enough: int) -> DataFrame:
    """(lang, phrase): phrases that the bounds let through and that occur ``enough`` times in the texts of one task.

    A phrase that occurs ``least`` times over n tasks occurs least / n times in one of them at least,
    so none is lost; those that every task has seen once or twice are not told by all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, seen, out, need = shared.value, {}, [], enough
        for batch in batches:
            languages = batch.column("lang").to_pylist()
            for a, b, raw, off in text_slices(batch.column("text")):
                runs, may = Runs(raw, off, languages[a:b]), None
                start, end, data = runs.words.start, runs.words.end, raw.tobytes()
                for k, whole, hashes in runs.phrases(longest):
                    may = whole if may is None else whole & may[:-1] & may[1:]
                    may = may & bounds.reach(k, hashes)
                    at = np.flatnonzero(may)
                    key, first, n = np.unique(hashes[at], return_index=True, return_counts=True)
                    for h, i, more in zip(key.tolist(), at[first].tolist(), n.tolist(), strict=True):
                        before = seen.get(h, 0)
                        seen[h] = before + more
                        if before < need <= before + more:
                            out.append((languages[a + runs.doc[i]], b" ".join(data[start[i] : end[i + k - 1]].translate(_FOLD).split()).decode()))
                    if len(seen) > MOST_SEEN:
                        # What was seen too rarely so far need not be told; from here on all is, at first sight.
                        seen, need = {}, 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["lang", "phrase"])
                out = []

    return docs.mapInArrow(run, "lang string, phrase string")


def guarded(texts: list[bytes]) -> str:
    """Texts as one string of lower-case words, each between single spaces, pieces parted by a byte no phrase holds."""
    folded = b"\xff".join(texts).translate(_FOLD).replace(b"\xff", b" \xff ")
    return (b" " + b" ".join(folded.split()) + b" ").decode("latin-1")


def automata(token: str, phrases: dict[str, list[list[tuple[int, str]]]], lang: str) -> list:
    """The automata of a language, built once a worker; (index in the scan's ids, phrase) a list for each automaton."""
    if token not in _BUILT:
        _BUILT.clear()  # one scan's automata at a time
        _BUILT[token] = {}
    if lang not in _BUILT[token]:
        made = []
        for chunk in phrases.get(lang, []):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, phrase in chunk:
                automaton.add_word(f" {phrase} ".encode().decode("latin-1"), i)
            automaton.make_automaton()
            made.append(automaton)
        _BUILT[token][lang] = made
    return _BUILT[token][lang]


def _counted(docs: DataFrame, phrases: dict[str, list[list[tuple[int, str]]]], ids: np.ndarray) -> DataFrame:
    """(id, n): matches of each phrase in all texts of its language, overlapping ones too."""
    shared, token = docs.sparkSession.sparkContext.broadcast((phrases, ids)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, ids = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            languages = np.array(batch.column("lang").to_pylist(), object)
            for a, b, raw, off in text_slices(batch.column("text"), SCAN_SLICE):
                data = raw.tobytes()
                for lang in set(languages[a:b]) & phrases.keys():
                    said = guarded([data[off[i] : off[i + 1]] for i in np.flatnonzero(languages[a:b] == lang)])
                    for automaton in automata(token, phrases, lang):
                        total += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(said)), np.int64), minlength=len(ids))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(total[at])], names=["id", "n"])

    return _few(docs.where(F.col("lang").isin(*phrases))).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("f"))


def counted(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, f): exact counts of ``phrases`` (lang, phrase) in ``docs`` (lang, text).

    Phrases are dealt by hash to automata of about AUTOMATON_BYTES; as many automata as SCAN_BYTES
    allow are sent to the tasks for one scan of the texts, so neither driver nor task ever holds
    more; what is left takes further scans.
    """
    size = F.octet_length("phrase") + 2
    per_lang = {r.lang: r.b for r in phrases.groupBy("lang").agg(F.sum(size).alias("b")).collect()}  # a row a language
    pieces = [(lang, i, b / n) for lang, b in sorted(per_lang.items()) for n in [-(-b // AUTOMATON_BYTES)] for i in range(n)]
    chunks = phrases.sparkSession.createDataFrame([(lang, -(-b // AUTOMATON_BYTES)) for lang, b in per_lang.items()] or [("", 1)], "lang string, chunks long")
    dealt = save(phrases.withColumn("id", F.monotonically_increasing_id()).join(F.broadcast(chunks), "lang").withColumn("chunk", F.pmod(F.xxhash64("phrase"), F.col("chunks"))), "phrases")
    scans: list[list[tuple[str, int]]] = []
    held = SCAN_BYTES
    for lang, i, b in pieces:
        if held + b > SCAN_BYTES:
            scans.append([])
            held = 0
        scans[-1].append((lang, i))
        held += b
    parts = []
    for scan in scans:
        mine = None
        for lang, i in scan:
            one = (F.col("lang") == lang) & (F.col("chunk") == i)
            mine = one if mine is None else mine | one
        told = dealt.where(mine).select("id", "lang", "chunk", "phrase").orderBy("lang", "chunk", "phrase").toArrow()
        ids = told.column("id").to_numpy()
        made: dict[str, dict[int, list[tuple[int, str]]]] = {}
        for at, (lang, chunk, phrase) in enumerate(zip(*(told.column(c).to_pylist() for c in ("lang", "chunk", "phrase")), strict=True)):
            made.setdefault(lang, {}).setdefault(chunk, []).append((at, phrase))
        parts.append(save(_counted(docs, {lang: list(c.values()) for lang, c in made.items()}, ids), "counts"))
    if not parts:
        return phrases.select("lang", "phrase", F.lit(0).cast("long").alias("f"))
    counts = parts[0]
    for more in parts[1:]:
        counts = counts.unionAll(more)
    return dealt.join(counts, "id").select("lang", "phrase", "f")


def tasks(spark: SparkSession) -> int:
    """The tasks that read the texts, at most."""
    return max(1, TASKS_A_CORE * spark.sparkContext.defaultParallelism)


def _few(docs: DataFrame) -> DataFrame:
    return docs.coalesce(tasks(docs.sparkSession))


def candidates(docs: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase): all phrases of 2 to ``longest`` words that may occur ``least`` times in ``docs`` (lang, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << max(LEAST_CELLS.bit_length() - 1, min(MOST_CELLS.bit_length() - 1, (size // CELL_BYTES).bit_length()))
    few = _few(docs)
    most = tasks(spark)
    bounds = Bounds(cells)
    _merged(_sketched(few, cells, least, longest, None), bounds, least, "pairs")
    if longest > 2:
        _merged(_sketched(few, cells, least, longest, spark.sparkContext.broadcast(bounds)), bounds, least, "longer")
    return save(_candidates(few, spark.sparkContext.broadcast(bounds), longest, -(-least // most)).distinct(), "candidates")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, most: int = 2_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``most`` phrases.

    ``docs`` has text and lang; other columns are not read. Texts are lower-cased (A-Z), split into
    pieces and these into words; phrases are 2 to ``longest`` words of one piece that occur a >=
    ``least`` times. Cut after k words, of which l begin and r end, a phrase scores floor(1000 a n /
    (l r)), n being all words of its language; its lowest score counts, of equals the least k. A
    phrase inside a longer one that occurs at least ``share`` % as often is dropped. Null texts are
    empty, a null language is ``und``; repeated rows count again; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    found = candidates(texts, least, longest)
    words = found.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct()
    counts = save(counted(texts, found.unionByName(words)), "phrase-counts")
    n = texts.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+")).cast("long")).alias("n"))
    said = F.split("phrase", " ")
    kept = counts.where((F.col("f") >= least) & (F.size(said) > 1)).select("lang", "phrase", F.col("f").alias("a"), said.alias("w"))
    part = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    # Phrases inside longer ones.
    spot = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("at")
    inner = kept.where(F.size("w") > 2).select("lang", "a", "w", spot).select("lang", "a", "w", "at", F.explode(F.sequence(F.lit(2), F.least(F.size("w") - 1, F.size("w") - F.col("at") + 1))).alias("k"))
    inside = inner.groupBy("lang", part(F.col("at"), F.col("k")).alias("phrase")).agg(F.max("a").alias("longer"))
    free = kept.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    cuts = free.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    of = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    both = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"]).join(F.broadcast(n), "lang")  # a row a language
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(14, 0)) * CAST(n AS DECIMAL(18, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    told = best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score").withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)
    return told.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The contract's rows by DuckDB.
COLLOCATIONS_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, id, unnest(w) AS a, generate_subscripts(w, 1) AS pos FROM w),
v AS (SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM u WINDOW o AS (PARTITION BY id ORDER BY pos)),
n AS (SELECT lang, count(*)::HUGEINT AS n FROM v GROUP BY lang),
f AS (
  SELECT lang, 1 AS k, a AS phrase, count(*) AS f FROM v GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 2, concat_ws(' ', a, b) AS g, count(*) FROM v WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 3, concat_ws(' ', a, b, c) AS g, count(*) FROM v WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 4, concat_ws(' ', a, b, c, d) AS g, count(*) FROM v WHERE d IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 5, concat_ws(' ', a, b, c, d, e) AS g, count(*) FROM v WHERE e IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
),
s AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
i AS (SELECT lang, f, unnest([array_to_string(w[i : i + j - 1], ' ') FOR i IN range(1, k - j + 2)]) AS phrase FROM s, range(2, 5) r(j) WHERE j < k),
o AS (SELECT lang, phrase, max(f) AS longer FROM i GROUP BY ALL),
c AS (
  SELECT s.lang, s.phrase, s.f AS a, l.f AS l, r.f AS r, n.n, c, (1000::HUGEINT * s.f * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM s JOIN range(1, 5) x(c) ON c < s.k JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1 : c], ' ')
  JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[c + 1 : ], ' ') JOIN n ON n.lang = s.lang
  LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.longer IS NULL OR o.longer < s.f
),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS cut FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b WHERE cut = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM t WHERE rank <= 2000
"""
