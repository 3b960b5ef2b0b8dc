"""URL rules by a sorted array of 64-bit digests.

The rules are written once as four flat arrays: sorted xxhash64 keys, each key's verdict, offsets
and the rule strings. The files travel with ``SparkContext.addFile``, tasks memory-map them and
share the pages. A url's candidate keys are its host and parent domains, each with the path
prefixes of the lengths that rules have; they are hashed in one go and found by a vectorised
binary search, and every hit is confirmed against the stored string.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules as (host, path, verdict). A rule fits its host and all subdomains, if the path starts with its path.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A larger list is refused here, since every executor fetches it whole; join such a list instead.
MAX_BYTES = 4 << 30


class DigestArray:
    """Sorted digests of rule strings ``host + path``, memory-mapped from a folder's files."""

    def __init__(self, at: str):
        self.keys = np.load(f"{at}keys.npy", mmap_mode="r")
        self.verdicts = np.load(f"{at}verdicts.npy", mmap_mode="r")
        self.offsets = np.load(f"{at}offsets.npy", mmap_mode="r")
        self.lengths = np.load(f"{at}lengths.npy", mmap_mode="r")
        self.strings = np.load(f"{at}strings.npy", mmap_mode="r")

    @staticmethod
    def write(rules: Iterable[tuple[str, str, str]], at: str, digest=xxhash.xxh64_intdigest) -> list[str]:
        """Write the arrays; of rules with one host and path the first holds. Empty hosts are refused."""
        kept: dict[bytes, tuple[int, str]] = {}
        lengths = set()
        for host, path, verdict in rules:
            if not host or verdict not in ("allow", "block"):
                raise ValueError(f"not a rule: {host!r}, {path!r}, {verdict!r}")
            kept.setdefault((host.lower() + "\0" + path).encode(), (len(path), verdict))
            lengths.add(len(path))
        if sum(map(len, kept)) + 25 * len(kept) > MAX_BYTES:
            raise ValueError("the rules take more than MAX_BYTES; join them as a table")
        rows = sorted((digest(k), k, v) for k, (_, v) in kept.items())
        arrays = {
            "keys": np.array([r[0] for r in rows], np.uint64),
            "verdicts": np.array([r[2] == "block" for r in rows], bool),
            "offsets": np.cumsum([0, *(len(r[1]) for r in rows)], dtype=np.int64),
            "lengths": np.array(sorted(lengths), np.int64),
            "strings": np.frombuffer(b"".join(r[1] for r in rows) or b"\0", np.uint8),
        }
        for name, array in arrays.items():
            np.save(f"{at}{name}.npy", array)
        return [f"{at}{name}.npy" for name in arrays]

    def find(self, wanted: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """The index of each wanted string, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys) or not wanted:
            return out
        h = np.fromiter(map(digest, wanted), np.uint64, len(wanted))
        at = np.searchsorted(self.keys, h)
        open_ = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == h))
        while len(open_):  # a second round only where digests collide
            more = []
            for i in open_:
                k = at[i]
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == wanted[i]:
                    out[i] = k
                elif k + 1 < len(self.keys) and self.keys[k + 1] == h[i]:
                    at[i] += 1
                    more.append(i)
            open_ = np.array(more, np.int64)
        return out


_OPEN: dict[str, DigestArray] = {}
_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _judge(name: str, default: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _OPEN:
            _OPEN[name] = DigestArray(SparkFiles.get(name))
        rules = _OPEN[name]
        lengths = [int(n) for n in rules.lengths]
        for frame in frames:
            wanted, owner = [], []
            for i, (host, path) in enumerate(zip(frame["host"], frame["path"], strict=True)):
                for n in lengths:
                    if len(path) < n or not host:
                        continue
                    tail, at = path[:n], 0
                    while True:
                        wanted.append(f"{host[at:]}\0{tail}".encode("utf-8", "surrogatepass"))
                        owner.append(i)
                        at = host.find(".", at) + 1
                        if not at:
                            break
            hit = rules.find(wanted)
            best: list[tuple[int, int, int] | None] = [None] * len(frame)
            for w in np.flatnonzero(hit >= 0):
                host_len = wanted[w].index(b"\0")
                rank = (len(wanted[w]), host_len, int(w))
                if best[owner[w]] is None or rank > best[owner[w]]:
                    best[owner[w]] = rank
            rule = [None if b is None else wanted[b[2]].replace(b"\0", b"", 1).decode("utf-8", "surrogatepass") for b in best]
            verdict = [default if b is None else ("block" if rules.verdicts[hit[b[2]]] else "allow") for b in best]
            yield frame.assign(rule=pd.Series(rule, dtype=object, index=frame.index), verdict=verdict)

    return run


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row a row of ``pages`` (page_id, url).

    The longest fitting rule decides (of equal lengths that with the longer host); without one the
    rule is null and the verdict ``default``. A null url, or one without ``://``, has an empty host
    and path and fits no rule. Further columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    name = f"url-rules-{uuid.uuid4().hex}-"
    for path in DigestArray.write(rules, os.path.join(tempfile.mkdtemp(prefix="skein-rules-"), name)):
        spark.sparkContext.addFile(path)
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(F.col("_rest"), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.col("_rest"), r"^[^/?#]*([^?#]*)", 1)
    parsed = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("_rest")).select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    return parsed.mapInPandas(_judge(name, default), "page_id long, host string, path string, rule string, verdict string")


JUDGE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, max_by(rh || rp, len(rh || rp)) AS rule, max_by(v, len(rh || rp)) AS v
  FROM p JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT p.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
