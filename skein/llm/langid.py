"""Language identification by prediction by partial matching.

For each language the byte contexts of up to ORDER bytes seen in its training text form a
variable-order context tree, kept whole over all 256 bytes. A byte's code length under a context is
that of escape method C with exclusion: count / (total + kinds) if the context has seen it, else the
escape kinds / (total + kinds) and the code of the next shorter context over the bytes not excluded,
down to a uniform code. The statistics are frozen after training: what an escape from a context
costs, its renormalisation over the bytes that are left included, is one number a context, so a
code length is a sum over at most ORDER + 1 look-ups. Each distinct run of ORDER + 1 bytes of a
slice is looked up once. The language with the shortest code wins.

Languages are learnt in parallel, one group a language.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import save, small_batches
from skein.llm.textbatch import text_slices

ORDER = 4
#: Training text is a bounded sample: about so many bytes a language, and over all languages together.
#: A sampled byte adds at most a context and a code of 16 bytes each to every order, 160 bytes, so that
#: the model that is collected and broadcast stays below 160 * TRAIN_TOTAL = 671 MB for any text, and
#: below a tenth of that for written language (3 to 40 bytes a sampled byte were measured).
TRAIN_BYTES, TRAIN_TOTAL = 400_000, 1 << 22
#: Texts are sampled in pieces of so many characters, wherever they stand in a text.
PIECE = 2048
_LINE = 10


@dataclass
class ContextTree:
    """For each order: sorted contexts with the bits of an escape, sorted (context, byte) codes with their bits."""

    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    codes: list[np.ndarray]
    bits: list[np.ndarray]

    def code_lengths(self, runs: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run of ORDER + 1 bytes (big-endian integers) after the others."""
        out = np.zeros(len(runs))
        open_ = np.arange(len(runs))
        for k in range(len(self.codes) - 1, -1, -1):
            code = runs[open_] & ((1 << 8 * (k + 1)) - 1)
            at = _find(self.codes[k], code)
            hit = at >= 0
            out[open_[hit]] += self.bits[k][at[hit]]
            open_, code = open_[~hit], code[~hit]
            if not len(open_):
                break
            at = _find(self.contexts[k], code >> 8)
            out[open_[at >= 0]] += self.escapes[k][at[at >= 0]]
        out[open_] += 8.0
        return out


def _find(sorted_: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The index of each value in a sorted array of distinct ones, -1 where it is missing."""
    if not len(sorted_):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(sorted_, asked), len(sorted_) - 1)
    return np.where(sorted_[at] == asked, at, -1)


def runs_of(raw: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, as an integer; line feeds stand before a text's start."""
    runs = raw.astype(np.int64)
    since = np.arange(len(raw)) - np.repeat(off[:-1], np.diff(off))
    for j in range(1, order + 1):
        before = np.full(len(raw), _LINE, np.int64)
        before[j:] = raw[: len(raw) - j]
        before[since < j] = _LINE
        runs |= before << 8 * j
    return runs


def train(texts: list[bytes], order: int = ORDER) -> ContextTree:
    """The frozen context tree of one language."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    runs = runs_of(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), order)
    tree = ContextTree([], [], [], [])
    below = None  # bits of the codes of the order before
    for k in range(order + 1):
        codes, count = np.unique(runs & ((1 << 8 * (k + 1)) - 1), return_counts=True)
        contexts, first = np.unique(codes >> 8, return_index=True)
        own = np.repeat(np.arange(len(contexts)), np.diff(np.r_[first, len(codes)]))
        total, kinds = np.bincount(own, count), np.bincount(own).astype(np.float64)
        bits = np.log2(total + kinds)[own] - np.log2(count)
        # What a context has seen, each shorter one has seen; those bytes are excluded after an escape.
        taken = np.full(len(codes), 1 / 256) if k == 0 else np.exp2(-below[np.searchsorted(tree.codes[-1], codes & ((1 << 8 * k) - 1))])
        left = np.maximum(1 - np.bincount(own, taken), 1e-12)
        tree.contexts.append(contexts)
        tree.escapes.append(np.log2(total + kinds) - np.log2(kinds) + np.log2(left))
        tree.codes.append(codes)
        tree.bits.append(bits)
        below = bits
    return tree


@dataclass
class Identifier:
    names: list[str]
    trees: list[ContextTree]

    def code_lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each text of a slice under each language."""
        out = np.zeros((len(off) - 1, len(self.trees)))
        runs, at = np.unique(runs_of(raw, off, ORDER), return_inverse=True)
        for m, tree in enumerate(self.trees):
            total = np.concatenate([[0.0], np.cumsum(tree.code_lengths(runs)[at])])
            out[:, m] = total[off[1:]] - total[off[:-1]]
        return out


def sample(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(lang, piece): about ``train_bytes`` bytes of text of each language.

    Whole texts are cut into pieces; a hash of doc_id and piece number draws them, at a share that
    comes from counts over all labelled documents. A language's piece with the least hash is drawn
    always, so that each language is learnt. With very many languages each has its part of
    TRAIN_TOTAL instead.
    """
    taught = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("lang", F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    part = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int")))
    chance = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("ppm"), "id", "part")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    pieces = taught.select("lang", "text", "id", part.alias("part")).withColumn("chance", chance)
    sizes = save(pieces.groupBy("lang").agg(F.sum(F.when(F.col("part") == 0, F.octet_length("text"))).cast("double").alias("bytes"), F.min("chance").alias("least")), "languages")
    wanted = float(min(train_bytes, TRAIN_TOTAL / max(sizes.count(), 1)))
    drawn = pieces.join(sizes.select(F.col("lang").alias("_lang"), "least", (F.lit(wanted) / F.col("bytes")).alias("share")), F.col("lang") == F.col("_lang"))
    drawn = drawn.where((F.col("chance") < F.col("share")) | (F.col("chance") == F.col("least")))
    # Repeated rows are drawn alike; they teach once.
    return drawn.select("lang", F.substring("text", F.col("part") * PIECE + 1, F.lit(PIECE)).alias("piece")).distinct()


def _learn(frame: pd.DataFrame) -> pd.DataFrame:
    texts = sorted(t.encode("utf-8", "surrogatepass") for t in frame["piece"])
    return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "tree": [pickle.dumps(train(texts))]})


def fit(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> Identifier | None:
    """One context tree a language of ``docs`` (doc_id, text, lang); None where there is nothing to learn from."""
    rows = sample(docs, train_bytes).groupBy("lang").applyInPandas(_learn, "lang string, tree binary").collect()  # bounded by the sample
    found = {r.lang: pickle.loads(r.tree) for r in rows}
    return Identifier(sorted(found), [found[n] for n in sorted(found)]) if found else None


def identify(docs: DataFrame, model: Identifier | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs``.

    Null texts and those without a letter are ``und`` with score 0, as is all without a model.
    Ties go to the first language by name. The score is the winner's share of two to the minus
    bits, over the average byte of the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            for a, b, raw, off in text_slices(batch.column("text")):
                n = b - a
                names, score = np.full(n, "und", object), np.zeros(n)
                if own is not None:
                    bits = own.code_lengths(raw, off)
                    best = bits.argmin(1)
                    gap = (bits - bits.min(1, keepdims=True)) / np.maximum(np.diff(off), 1)[:, None]
                    told = letters[a:b].astype(bool)
                    names[told] = np.array(own.names, object)[best[told]]
                    score = np.where(told, 1 / np.exp2(-gap).sum(1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", letters)
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def classify(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learnt from documents whose crc32(doc_id as text) mod ``modulus`` is not 0."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == 0, F.lit(False))
    model = fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % modulus != 0).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
