"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages of at most ``PASSAGE`` words; between two of them lies one
   more, from the middle of the one to the middle of the other. Document frequencies of their words are counted over
   all documents; passages become TF-IDF vectors over hashed terms.
2. A randomised SVD of each block of at most ``RANK`` passages gives its latent basis. The sketch
   is wider than the block has passages, so the basis holds every passage whole.
3. Each document's overlapping windows are folded into the latent space of each block; windows
   whose cosine to a passage reaches ``COSINE`` are candidates.
4. A candidate is confirmed by the longest common subsequence of the passage's words and the text
   around the window: at ``WHOLE`` of the passage by that alone, at ``COMMON`` if that of its answer
   (its last quarter) reaches ``ANSWER`` too.

Words are compared in lower case without ASCII punctuation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import small_batches
from skein.llm.textbatch import IS_BREAK, Words, text_slices

FEATURES, RANK, OVERSAMPLE = 1 << 16, 256, 8
STEP, PASSAGE = 16, 64  # windows are of 2 * STEP words
COSINE, COMMON, ANSWER, WHOLE = 0.2, 0.6, 0.5, 0.8
#: Terms in more of the documents weigh nothing, but in passages with fewer than FEW rarer ones, or
#: that can be hit by common words alone, as they make up a share of COMMON or more.
MOST_DOCUMENTS, FEW = 0.05, 5
#: Passages searched in one pass over the documents, in blocks of RANK; a larger benchmark takes more passes.
PASS = 2048


@dataclass
class Passages:
    """item, first word and number of words of each passage; hashes of all words, in order."""

    item: np.ndarray
    first: np.ndarray
    size: np.ndarray
    words: np.ndarray


def _cut(items: list[tuple[int, str]]) -> Passages:
    item, first, size, words, at = [], [], [], [], 0
    texts = pa.array([t for _, t in items], pa.large_string())
    for a, _, raw, off in text_slices(texts):
        w = Words(raw, off, IS_BREAK)
        for i, n in enumerate(w.count):
            parts = -(-int(n) // PASSAGE)
            for p in range(max(0, 2 * parts - 1)):
                lo, hi = p * n // (2 * parts), (p + 2) * n // (2 * parts)
                item.append(items[a + i][0])
                first.append(at)
                size.append(hi - lo)
                words.append(w.hash[w.first[i] + lo : w.first[i] + hi])
                at += hi - lo
    return Passages(np.array(item, np.int64), np.array(first, np.int64), np.array(size, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))


def _term(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64)


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents that hold each of ``terms``, documents with words), over all of ``docs``."""
    wanted = np.full(FEATURES, -1, np.int32)
    wanted[terms] = np.arange(len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for _, _, raw, off in text_slices(batch.column("text")):
                w = Words(raw, off, IS_BREAK)
                code = wanted[_term(w.hash)]
                hit = code >= 0
                held = np.unique(w.doc()[hit] * len(terms) + code[hit]) % max(len(terms), 1)
                total[:-1] += np.bincount(held, minlength=len(terms))
                total[-1] += int((w.count > 0).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row a benchmark term
    out = np.zeros(len(terms) + 1, np.int64)
    for r in rows:
        out[r.term] = r.n
    return out[:-1], int(out[-1])


def _rows(p: Passages, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised TF-IDF matrix as (row, term, weight)."""
    row = np.repeat(np.arange(len(p.size)), p.size)
    code, often = np.unique(row * FEATURES + _term(p.words), return_counts=True)
    row, term = code // FEATURES, code % FEATURES
    weight = often * idf[term]
    norm = np.sqrt(np.bincount(row, weight**2, len(p.size)))
    return row, term, weight / np.maximum(norm[row], 1e-12)


@dataclass
class Block:
    """The passages ``first`` .. ``first + len(latent)``, in a latent space of their own."""

    first: int
    place: np.ndarray
    basis: np.ndarray
    latent: np.ndarray


def latent_block(p: Passages, idf: np.ndarray, a: int, b: int) -> Block:
    """Right singular vectors of the TF-IDF matrix of the passages ``a`` .. ``b``, and those passages in them."""
    lo, hi = int(p.first[a]), int(p.first[b - 1] + p.size[b - 1])
    row, term, weight = _rows(Passages(p.item[a:b], p.first[a:b] - lo, p.size[a:b], p.words[lo:hi]), idf)
    row, term, weight = row[weight > 0], term[weight > 0], weight[weight > 0]
    terms, code = np.unique(term, return_inverse=True)
    matrix = np.zeros((b - a, len(terms)))
    matrix[row, code] = weight
    sketch = np.random.default_rng(11).standard_normal((b - a, b - a + OVERSAMPLE))
    range_, _ = np.linalg.qr(matrix.T @ sketch)
    _, values, vectors = np.linalg.svd(matrix @ range_, full_matrices=False)
    basis = range_ @ vectors[values > 1e-6].T
    place = np.full(FEATURES, -1, np.int32)
    place[terms] = np.arange(len(terms))
    return Block(a, place, basis.astype(np.float32), (matrix @ basis).astype(np.float32))


def common_words(passage: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[int, int] = {}
    for i, w in enumerate(passage):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(passage)) - 1
    v = full
    for w in text:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(passage) - v.bit_count()


class WordMarks:
    """Which words of the passages stand near a place of a text, as bits of a hash: no word is missed, some seem present.

    A passage can only be confirmed where COMMON of its words stand within its own length of the window.
    """

    BITS, REACH = 1024, -(-PASSAGE // STEP)

    def __init__(self, p: Passages):
        self.words, code = np.unique(p.words, return_inverse=True)
        row = np.repeat(np.arange(len(p.size)), p.size)
        self.bit = np.full((len(p.size), int(p.size.max(initial=1))), -1, np.int16)
        self.bit[row, np.arange(len(row)) - p.first[row]] = code % self.BITS
        self.least = COMMON * p.size

    def around(self, words: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
        """A row of bits for each of ``n`` blocks of STEP words: the words in it and REACH windows' blocks about it."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = self.words[at] == words
        bit = at[hit] % self.BITS
        own = np.zeros((n, self.BITS // 8), np.uint8)
        np.bitwise_or.at(own, (block[hit], bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
        out = own.copy()
        for s in range(1, self.REACH + 2):
            out[:-s] |= own[s:]
            if s <= self.REACH:
                out[s:] |= own[:-s]
        return out

    def possible(self, near: np.ndarray, block: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Whether a passage may be confirmed at a block, for each pair."""
        keep = np.zeros(len(block), bool)
        for a in range(0, len(block), 8192):
            bit = self.bit[passage[a : a + 8192]]
            byte = np.take_along_axis(near[block[a : a + 8192]], np.maximum(bit, 0) >> 3, 1)
            keep[a : a + 8192] = ((byte >> (np.maximum(bit, 0) & 7) & 1 > 0) & (bit >= 0)).sum(1) >= self.least[passage[a : a + 8192]]
        return keep


@dataclass
class Searcher:
    passages: Passages
    idf: np.ndarray
    blocks: list[Block]
    marks: WordMarks

    def hits(self, w: Words) -> list[tuple[int, int, float, float, float]]:
        """(text, item, cosine, share of the passage, share of the answer), one for each confirmed pair."""
        n = len(w.hash)
        if not n:
            return []
        doc = w.doc()
        block_of_word = (np.arange(n) - w.first[:-1][doc]) // STEP
        blocks = -(-w.count // STEP)
        base = np.concatenate([[0], np.cumsum(blocks)])
        block = base[:-1][doc] + block_of_word
        term = _term(w.hash)
        weight = self.idf[term].astype(np.float32)
        energy = np.bincount(block, weight * weight, base[-1])
        # A window is a block and the next one of the same text.
        next_ = np.arange(1, base[-1] + 1)
        last = np.zeros(base[-1], bool)
        last[base[1:][blocks > 0] - 1] = True
        next_[last] = base[-1]
        norm = np.sqrt(energy + np.where(last, 0, np.r_[energy, 0][next_]))
        # The last block alone would repeat the window before it.
        block_doc = np.repeat(np.arange(len(blocks)), blocks)
        whole = np.flatnonzero(~last | (blocks[block_doc] == 1))
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        words_near = self.marks.around(w.hash, block, int(base[-1]))
        for part in self.blocks:
            code = part.place[term]
            hit = np.flatnonzero(code >= 0)
            if not len(hit):
                continue
            own = block[hit]
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            folded = np.zeros((base[-1] + 1, part.basis.shape[1]), np.float32)
            folded[own[start]] = np.add.reduceat(part.basis[code[hit]] * weight[hit, None], start, axis=0)
            window = folded[whole] + folded[next_[whole]]
            near = np.einsum("ij,ij->i", window, window) >= (COSINE * norm[whole]) ** 2
            open_, window = whole[near], window[near]
            for a in range(0, len(open_), 4096):
                cosine = (window[a : a + 4096] @ part.latent.T) / np.maximum(norm[open_[a : a + 4096]], 1e-9)[:, None]
                around = (-1, -1, frozenset())
                one, two = np.nonzero(cosine >= COSINE)
                may = self.marks.possible(words_near, open_[a + one], part.first + two)
                for i, j in zip(one[may].tolist(), two[may].tolist(), strict=True):
                    b = int(open_[a + i])
                    d = int(block_doc[b])
                    first, size = int(self.passages.first[part.first + j]), int(self.passages.size[part.first + j])
                    key = (d, int(self.passages.item[part.first + j]))
                    at = int(w.first[d] + (b - base[d]) * STEP)
                    lo, hi = max(int(w.first[d]), at - size), min(int(w.first[d + 1]), at + 2 * STEP + size)
                    passage, text = self.passages.words[first : first + size].tolist(), w.hash[lo:hi].tolist()
                    if around[:2] != (lo, hi):
                        around = (lo, hi, frozenset(text))
                    if sum(x in around[2] for x in passage) < COMMON * size:
                        continue
                    share = common_words(passage, text) / size
                    if share < COMMON:
                        continue
                    answer = passage[-max(1, size // 4) :]
                    told = common_words(answer, text) / len(answer)
                    if (told >= ANSWER or share >= WHOLE) and (key not in found or (share, told) > found[key][1:]):
                        found[key] = (float(cosine[i, j]), share, told)
        return [(d, item, *v) for (d, item), v in found.items()]


def _needed(common: np.ndarray):
    """The common terms of passages that have few others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            p = _cut([(0, t) for t in frame["text"]])
            for a, n in zip(p.first, p.size, strict=True):
                said = _term(p.words[a : a + n])
                own = np.unique(said)
                if (~common[own]).sum() < FEW or common[said].mean() >= COMMON:
                    seen |= set(own[common[own]].tolist())
        yield pd.DataFrame({"term": sorted(seen)}, dtype="int64")

    return run


def searchers(docs: DataFrame, benchmark: DataFrame) -> Iterator[Searcher]:
    """One searcher for each ``PASS`` passages of the benchmark; the passages of one item are never parted.

    Benchmarks are small beside the documents: each pass over the documents holds one searcher.
    """
    small_batches(docs.sparkSession)
    bench = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))

    def terms_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            seen |= set(_term(_cut([(0, t) for t in frame["text"]]).words).tolist())
        yield pd.DataFrame({"term": sorted(seen)}, dtype="int64")

    terms = np.array(sorted(r.term for r in bench.mapInPandas(terms_of, "term long").distinct().collect()), np.int64)  # at most FEATURES
    if not len(terms):
        return
    df, n = document_frequencies(docs, terms)
    idf = np.zeros(FEATURES)  # words outside the benchmark weigh nothing, whatever the number of documents
    idf[terms] = np.log((1 + n) / (1 + df)) + 1
    common = np.zeros(FEATURES, bool)
    common[terms] = df > MOST_DOCUMENTS * n
    spared = [r.term for r in bench.mapInPandas(_needed(common), "term long").distinct().collect()]  # at most FEATURES
    common[spared] = False
    idf[common] = 0
    part: list[tuple[int, str]] = []
    held = 0

    def ready(rows: list[tuple[int, str]]) -> Searcher:
        p = _cut(rows)
        return Searcher(p, idf, [latent_block(p, idf, a, min(a + RANK, len(p.size))) for a in range(0, len(p.size), RANK)], WordMarks(p))

    # One item after the other passes through the driver; a pass holds PASS passages and one item.
    for r in bench.toLocalIterator():
        part.append((r.item_id, r.text))
        held += len(_cut(part[-1:]).size)
        if held >= PASS:
            yield ready(part)
            part, held = [], 0
    if held:
        yield ready(part)


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, passage_share, answer_share): each document that holds a passage of an item.

    One row a pair, with the shares of its best passage: rows that share a doc_id are one document,
    rows that share an item_id one item. Null and empty texts and items hold nothing. Only doc_id,
    item_id and text are read. An empty benchmark gives an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, passage_share double, answer_share double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    out = spark.createDataFrame([], schema)
    for searcher in searchers(rows, benchmark):
        out = out.unionByName(rows.mapInArrow(_run(spark.sparkContext.broadcast(searcher)), schema))
    best = F.max(F.struct("passage_share", "answer_share", "cosine")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.passage_share", "best.answer_share")


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, _, raw, off in text_slices(batch.column("text")):
                hits = searcher.hits(Words(raw, off, IS_BREAK))
                if hits:
                    columns = [pa.array([ids[a + h[0]] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), *(pa.array([float(h[k]) for h in hits]) for k in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "cosine", "passage_share", "answer_share"])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``benchmark``, unchanged; columns may have any name."""
    spark = docs.sparkSession
    names = docs.columns
    rows = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("row"), F.lower(F.col("text").cast("string")).alias("text"))
    for searcher in searchers(rows.select("text"), benchmark):
        shared = spark.sparkContext.broadcast(searcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, raw, off in text_slices(batch.column("text")):
                    for h in shared.value.hits(Words(raw, off, IS_BREAK)):
                        keep[a + h[0]] = False
                yield batch.filter(pa.array(keep))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
