"""Text, set and scoring scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop lists of retrieval, of topology retrieval and of conversation retrieval.
STOP = (
    "the a an and or is are was were to of in on for with at by from into over under this that which what why how shows show appear appears such as its"
).split()
STOP_TOPOLOGY = "the a an and or is are was were to of in on for with at by from into over under this that which what why how".split()
STOP_CONVERSATION = (
    "the a an and or is are was were to of in on for with at by it this that you we they he she do did does my your what when which how who have has had been"
).split()
# Suffixes in the order they are tried, and the synonyms.
SUFFIXES = ("ing", "edly", "ed", "es", "s")
SYNONYMS = {"flow": ["traffic"], "traffic": ["flow"], "deny": ["block", "denied"], "block": ["deny"], "auth": ["authentication", "login"], "cpu": ["processor"]}


def tokens(text: Column, stop: list[str] | tuple[str, ...] = STOP, longer_than: int = 1) -> Column:
    """Lower-case runs of a-z and 0-9 longer than ``longer_than`` and outside the stop list; null gives null."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(*stop))


def stem(word: Column) -> Column:
    """Strip the first suffix that fits and leaves at least three letters."""
    out = F.when(F.lit(False), word)
    for suffix in SUFFIXES:
        fits = F.endswith(word, F.lit(suffix)) & (F.length(word) > len(suffix) + 2)
        out = out.when(fits, F.substring(word, F.lit(1), F.length(word) - len(suffix)))
    return out.otherwise(word)


def stems(words: Column) -> Column:
    return F.transform(words, stem)


def _stem_py(word: str) -> str:
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) > len(s) + 2), word)


def expand(words: Column) -> Column:
    """Each word's stem, then the sorted stems of its synonyms; first occurrences only."""
    known = {w: sorted({_stem_py(s) for s in more}) for w, more in SYNONYMS.items()}

    def one(w: Column) -> Column:
        more = F.when(F.lit(False), F.array().cast("array<string>"))
        for k, v in known.items():
            more = more.when((w == k) | (stem(w) == k), F.array(*map(F.lit, v)))
        return F.concat(F.array(stem(w)), more.otherwise(F.array().cast("array<string>")))

    return F.array_distinct(F.flatten(F.transform(words, one)))


def token_estimate(text: Column) -> Column:
    """Word runs, single CJK characters and punctuation runs."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[一-鿿]|[^\sA-Za-z0-9_一-鿿]+"))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; 0 when both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def tagset(tags: Column) -> Column:
    """Content tags, lower-cased: no skill, quarantine or root tags, no ``insight``."""
    return F.array_distinct(F.transform(F.filter(tags, lambda t: ~t.rlike("^(skill:|quarantine:|root:)") & (t != "insight")), F.lower))


def root_keys(tags: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(tags, lambda t: t.startswith("root:")), lambda t: F.substring(t, 6, 1 << 20)))


def similarity(a_tags: Column, a_assets: Column, b_tags: Column, b_assets: Column) -> Column:
    """0.6 times the Jaccard of content tags plus 0.4 times that of assets, to 4 places."""
    return F.round(0.6 * jaccard(tagset(a_tags), tagset(b_tags)) + 0.4 * jaccard(a_assets, b_assets), 4)


def parts(items: Column) -> Column:
    """All subsets of a set but the empty one, 2 ** n - 1 of them, each sorted; for sets of a few items."""
    own = F.array_sort(items)
    every = F.aggregate(own, F.array(F.slice(own, 1, 0)), lambda acc, x: F.concat(acc, F.transform(acc, lambda p: F.array_append(p, x))))
    return F.slice(every, F.lit(2), F.size(every))


def structural_prior(strength: Column, links: Column, importance: Column, confidence: Column, tier: Column) -> Column:
    """A convex blend of five lifecycle signals in [0, 1]."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    by_tier = F.when(tier == "asset_profile", 1.0).when(tier == "semantic", 0.75).when(tier == "procedural", 0.5).otherwise(0.25)
    saturated = 1.0 - 1.0 / (1.0 + F.greatest(F.lit(0.0), importance))
    return 0.30 * clamp(strength) + 0.25 * F.least(F.lit(1.0), links / 5.0) + 0.20 * saturated + 0.15 * clamp((confidence - 1.0) / 2.0) + 0.10 * by_tier
