"""Removal of repeated byte strings by difference-cover suffix arrays.

Sorting every suffix of a corpus shuffles it many times over, so suffixes are first brought
together losslessly: every ``length``-byte string holds a 32-byte gram whose hash is least among
its grams (its anchor), and equal strings share their anchor's hash.

1. Each text emits its anchors with a hash of the window around each (all strings through it).
2. Anchors whose hash occurs once are done. Windows that occur at several places are repeated as
   a whole, wherever they are.
3. Windows that differ but share an anchor meet, sorted by anchor, in tasks that build the suffix
   array of their concatenation by the difference-cover algorithm (sort sampled triples, recurse
   on their names, merge the remaining suffixes) and compare adjacent prefixes of ``length`` bytes.
   An anchor of more than ``HOT`` different windows is not gathered: its strings are counted by
   128-bit hash with map-side combining.
4. The intervals of each text are united, and its remaining bytes digested.

Texts are known by 120 bits of their SHA-256, windows by two 64-bit hashes beside their anchor's;
equal texts are one, and repeated as a whole. An anchor, window or text that holds a large share of
all rows is dealt over several tasks. Spans go back to one task a text: a text and its spans are
bounded by the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import hot_keys, save, small_batches, spread_join
from skein.llm.textbatch import OTHER, hash_prefix, mix, text_slices

LENGTH, GRAM = 200, 32
HOT = 20_000
#: Bytes of windows per suffix array.
ARRAY_BYTES = 2 << 20
_POSITION = np.uint64((1 << 28) - 1)
SEGMENT = 1 << 27


def _ranked(keys: tuple[np.ndarray, ...], width: int) -> np.ndarray:
    """One integer a row, in the order of the rows of ``keys`` (non-negative, below ``width``)."""
    if width ** len(keys) < 1 << 63:
        code = keys[0]
        for k in keys[1:]:
            code = code * width + k
        return code
    order = np.lexsort(keys[::-1])
    new = np.concatenate([[True], np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])])
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new)
    return code


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of positive integers, by the difference cover modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    # Positions 1 modulo 3, then 2 modulo 3; a dummy closes the first part.
    one = np.arange(1, n + (n % 3 == 1), 3)
    sample = np.concatenate([one, np.arange(2, n, 3)])
    code = _ranked((s[sample], s[sample + 1], s[sample + 2]), int(s.max()) + 1)
    order = np.argsort(code)
    new = np.concatenate([[True], code[order[1:]] != code[order[:-1]]])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
    sa12 = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sa12] = np.arange(1, len(sa12) + 1)
    sa12 = sa12[sa12 < n]
    width = max(int(s.max()), n) + 3
    sa0 = np.arange(0, n, 3)
    key0 = _ranked((s[sa0], rank[sa0 + 1]), width)
    by = np.argsort(key0)
    sa0, key0 = sa0[by], key0[by]
    # How many of the remaining suffixes stand before each sampled one.
    before = np.empty(len(sa12), np.int64)
    first = sa12 % 3 == 1
    j = sa12[first]
    before[first] = np.searchsorted(key0, _ranked((s[j], rank[j + 1]), width)) if width**2 < 1 << 63 else _before((s[sa0], rank[sa0 + 1]), (s[j], rank[j + 1]), width)
    j = sa12[~first]
    before[~first] = _before((s[sa0], s[sa0 + 1], rank[sa0 + 2]), (s[j], s[j + 1], rank[j + 2]), width)
    out = np.empty(n, np.int64)
    at = np.arange(len(sa12)) + before
    out[at] = sa12
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sa0
    return out


def _before(own: tuple[np.ndarray, ...], asked: tuple[np.ndarray, ...], width: int) -> np.ndarray:
    """How many of the sorted rows ``own`` are less than each row ``asked``."""
    code = _ranked(tuple(np.concatenate(pair) for pair in zip(own, asked, strict=True)), width)
    return np.searchsorted(code[: len(own[0])], code[len(own[0]) :])


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive values."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _least_grams(grams: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` grams the position of that with the least hash (the first of equal ones)."""
    out = []
    for a in range(0, len(grams) - w + 1, SEGMENT):  # positions take the low bits, so a segment is bounded
        part = grams[a : a + SEGMENT + w - 1]
        out.append((_sliding_least((part & ~_POSITION) | np.arange(len(part), dtype=np.uint64), w) & _POSITION).astype(np.int64) + a)
    return np.concatenate(out)


def anchors(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash, prefix hashes) of the anchors of a slice: each string of ``length`` bytes holds one."""
    h, down = hash_prefix(raw)
    n_grams, w = len(raw) - gram + 1, length - gram + 1
    none = np.zeros(0, np.int64)
    if n_grams < w:
        return none, none, none.astype(np.uint64), h
    grams = mix((h[gram:] - h[:-gram]) * down[:n_grams])
    least = _least_grams(grams, w)
    ends = np.repeat(off[1:], np.diff(off))[: len(least)]
    at = np.unique(least[np.arange(len(least)) + length <= ends])
    if not len(at):
        return none, none, none.astype(np.uint64), h
    doc = np.searchsorted(off, at, "right") - 1
    g = grams[at]
    # In a run of one gram every second one within reach of both neighbours can go.
    same = (g[1:] == g[:-1]) & (doc[1:] == doc[:-1])
    keep = np.ones(len(at), bool)
    last = 0  # the kept one before
    for i in np.flatnonzero(same[1:] & same[:-1]) + 1:
        if keep[i - 1]:
            last = at[i - 1]
        if at[i + 1] - last <= w:
            keep[i] = False
    return doc[keep], at[keep], g[keep], h


def _hashes(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the strings lo..hi; ``h`` are the prefix hashes of the first."""
    other, down = hash_prefix(raw, OTHER)
    size = (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return tuple(mix((x[hi] - x[lo]) * down[lo] + size).view(np.int64) for x in (h, other))


def _emit(length: int, gram: int):
    left = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in text_slices(batch.column("text")):
                doc, at, g, h = anchors(raw, off, length, gram)
                if not len(at):
                    continue
                lo, hi = np.maximum(at - left, off[doc]), np.minimum(at + length, off[doc + 1])
                window = _hashes(raw, lo, hi, h)
                own = [batch.column(k).slice(a, b - a).take(pa.array(doc)) for k in ("k1", "k2")]
                columns = [pa.array(g.view(np.int64)), *map(pa.array, window), *own, pa.array((lo - off[doc]).astype(np.int32)), pa.array((hi - off[doc]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "w1", "w2", "k1", "k2", "lo", "hi"])

    return run


def repeated_starts(windows: list[bytes], place: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of every string start that is repeated elsewhere.

    ``place`` tells the origin of each window's first byte (an integer that equal origins share,
    the byte after it having the next one); ``many`` the windows that occur at several places.
    """
    size = np.array([len(w) for w in windows])
    first = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.frombuffer(b"\0".join(windows) + b"\0", np.uint8).astype(np.int64) + 2
    text[first[1:] - 1] = 1  # what parts windows is in no string
    owner = np.repeat(np.arange(len(windows)), size + 1)
    sa = suffix_array(text)
    offset = sa - first[owner[sa]]
    fits = offset + length <= size[owner[sa]]
    sa, offset, own = sa[fits], offset[fits], owner[sa[fits]]
    if not len(sa):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), length)
    equal = np.zeros(len(sa), bool)
    for a in range(1, len(sa), 8192):
        b = min(a + 8192, len(sa))
        near = (view[sa[a:b], 0] == view[sa[a - 1 : b - 1], 0]) & (view[sa[a:b], -1] == view[sa[a - 1 : b - 1], -1]) & (view[sa[a:b], length // 2] == view[sa[a - 1 : b - 1], length // 2])
        hit = np.flatnonzero(near)
        equal[a + hit] = (view[sa[a + hit]] == view[sa[a + hit - 1]]).all(1)
    start = np.flatnonzero(~equal)
    origin = place[own] + offset.astype(np.uint64)
    several = (np.minimum.reduceat(origin, start) != np.maximum.reduceat(origin, start)) | np.logical_or.reduceat(many[own], start)
    hit = np.repeat(several, np.diff(np.r_[start, len(sa)]))
    return own[hit], offset[hit]


def _origin(k1: np.ndarray, k2: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(k1.view(np.uint64) ^ mix(k2.view(np.uint64))) + lo.astype(np.uint64)


def _resolve(length: int):
    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        k1, k2, lo, many = frame["k1"].to_numpy(np.int64), frame["k2"].to_numpy(np.int64), frame["lo"].to_numpy(np.int64), frame["many"].to_numpy(bool)
        own, offset = repeated_starts(list(frame["bytes"]), _origin(k1, k2, lo), many, length)
        open_ = ~many[own]
        own, offset = own[open_], offset[open_]
        order = np.lexsort((offset, own))
        own, start = own[order], offset[order]
        cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (start[1:] - start[:-1] > length)]) if len(own) else np.zeros(0, np.int64)
        last = np.r_[cut[1:], len(own)] - 1 if len(cut) else cut
        return pd.DataFrame({"k1": k1[own[cut]], "k2": k2[own[cut]], "a": lo[own[cut]] + start[cut], "b": lo[own[last]] + start[last] + length}, dtype="int64")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        total = 0
        for frame in frames:
            while len(frame):
                anchor = frame["anchor"].to_numpy()
                ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
                total_here = np.cumsum(frame["bytes"].map(len).to_numpy()) + total
                full = ends[total_here[ends - 1] >= ARRAY_BYTES] if len(ends) else ends
                if held and held[-1]["anchor"].iloc[-1] != anchor[0] and total >= ARRAY_BYTES:
                    yield solve(pd.concat(held, ignore_index=True))
                    held, total = [], 0
                    continue
                if not len(full):
                    held.append(frame)
                    total = int(total_here[-1])
                    break
                yield solve(pd.concat([*held, frame.iloc[: full[0]]], ignore_index=True))
                held, total, frame = [], 0, frame.iloc[full[0] :]
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def _strings(length: int):
    """Every string of each window, by two hashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                raw = np.frombuffer(r.bytes, np.uint8)
                n = len(raw) - length + 1
                if n <= 0:
                    continue
                at = np.arange(n)
                x, y = _hashes(raw, at, at + length, hash_prefix(raw)[0])
                yield pd.DataFrame({"x": x, "y": y, "many": r.many, "k1": r.k1, "k2": r.k2, "a": r.lo + at})

    return run


def _finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for k1, k2, text, spans in zip(frame["k1"], frame["k2"], frame["text"], frame["spans"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            kept, at, removed, runs = hashlib.sha256(), 0, 0, 0
            end = -1
            for a, b in sorted((s["a"], s["b"]) for s in spans):
                if a > end:
                    kept.update(data[max(at, 0) : a])
                    runs += 1
                    removed += b - a
                elif b > end:
                    removed += b - end
                end = max(end, b)
                at = end
            kept.update(data[at:])
            out.append((k1, k2, removed, runs, kept.hexdigest()))
        yield pd.DataFrame(out, columns=["k1", "k2", "removed", "runs", "kept"])


KEY = ["k1", "k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sha, k1, k2): the first 128 bits of a text's SHA-256 tell texts apart."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    part = lambda a: F.conv(F.substring("sha", a, 15), 16, 10).cast("long")
    return rows.select("doc_id", "text", "sha", part(1).alias("k1"), part(16).alias("k2"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, a, b) spans covered by repeated strings, and (k1, k2, text) of the texts that have candidates.

    ``texts`` are (k1, k2, text) rows, equal texts having equal keys; strings repeated only between
    equal texts are not looked for.
    """
    small_batches(texts.sparkSession)
    found = save(texts.mapInArrow(_emit(length, gram), "anchor long, w1 long, w2 long, k1 long, k2 long, lo int, hi int"), "anchors")
    again = save(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    often = hot_keys(again, ["anchor"], found.count())
    # Shares of the anchors and of the texts, so no side is broadcast at any size.
    candidates = save(spread_join(found, again.select("anchor"), ["anchor"], often, "left_semi"), "candidates")
    place = F.struct("k1", "k2", "lo", "hi")
    windows = candidates.groupBy("anchor", "w1", "w2").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.count(F.lit(1)).alias("n"))
    windows = save(windows.select("anchor", "w1", "w2", "p.k1", "p.k2", "p.lo", "p.hi", "n", (F.col("p") != F.col("q")).alias("many")), "windows")
    window = ["anchor", "w1", "w2"]
    whole = spread_join(candidates.where(F.col("hi") - F.col("lo") >= length), windows.where("many").select(*window), window, hot_keys(windows.where("many"), window, candidates.count()), "left_semi")
    groups = save(windows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("many").alias("settled")).where("n > 1 AND NOT settled"), "groups")
    work = spread_join(windows.drop("n"), groups.select("anchor", F.col("n").alias("kinds")), ["anchor"], hot_keys(groups, ["anchor"], windows.count()))
    held = save(texts.join(candidates.select(*KEY).distinct().hint("merge"), KEY, "left_semi").groupBy(*KEY).agg(F.first("text").alias("text")), "held")
    cut = F.substring(F.col("text").cast("binary"), F.col("lo") + 1, F.col("hi") - F.col("lo"))
    filled = save(work.join(held, KEY).select("anchor", "kinds", "many", *KEY, "lo", cut.alias("bytes")), "filled")
    some = filled.where(F.col("kinds") <= hot).repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_resolve(length), "k1 long, k2 long, a long, b long")
    spans = whole.select(*KEY, F.col("lo").cast("long").alias("a"), F.col("hi").cast("long").alias("b")).union(some)
    if not filled.where(F.col("kinds") > hot).isEmpty():
        strings = save(filled.where(F.col("kinds") > hot).mapInPandas(_strings(length), "x long, y long, many boolean, k1 long, k2 long, a long"), "strings")
        origin = F.struct(*KEY, "a")
        counted = save(strings.groupBy("x", "y").agg(F.min(origin).alias("p"), F.max(origin).alias("q"), F.max("many").alias("m"), F.count(F.lit(1)).alias("n")).where("m OR p <> q"), "twice")
        held_again = spread_join(strings, counted.select("x", "y"), ["x", "y"], hot_keys(counted, ["x", "y"], strings.count()), "left_semi")
        spans = spans.union(held_again.select(*KEY, "a", (F.col("a") + length).alias("b")))
    return spans, held


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row a row of ``docs`` (doc_id, text).

    Every byte covered by a string of ``length`` UTF-8 bytes that also starts anywhere else, in the
    same or another row, is removed; strings do not cross rows and are judged on the input. Null
    texts are empty. Repeated rows repeat each other. Further columns are not read.
    """
    rows = keyed(docs)
    sums = save(rows.select(F.col("doc_id").cast("long").alias("doc_id"), *KEY, F.octet_length("text").cast("long").alias("n_bytes"), "sha"), "sums")
    spans, held = repeated_spans(rows.where(F.octet_length("text") >= length).select(*KEY, "text"), length, gram, hot)
    listed = spans.groupBy(*KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    cut = save(held.join(listed, KEY).select(*KEY, "text", "spans").mapInPandas(_finish, "k1 long, k2 long, removed long, runs int, kept string"), "cut")
    counts = save(sums.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "counts")
    own = counts.join(cut, KEY, "left")
    all_ = spread_join(sums, own, KEY, hot_keys(counts, KEY, counts.agg(F.sum("n")).first()[0] or 0))
    gone = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    return all_.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
