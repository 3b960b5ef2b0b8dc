"""Scalars of cases, records, requests and services as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a token costs by model, a million each (input, output), and the rate of any other model.
RATES = {"deepseek-v4-pro": (4.0, 16.0), "deepseek-chat": (1.0, 2.0), "deepseek-reasoner": (4.0, 16.0)}
OTHER_RATE = (4.0, 16.0)
# Where a request is cut, in the order applied, and the terms that stand for a phrase.
CONNECTORS = ["通过就", "然后", "再", "并且", "，", ",", ";", " and ", " then "]
PHRASES = {
    "报价": ["pricing", "price", "quote", "policy"], "价格": ["pricing", "price", "quote"], "新策略": ["policy", "pricing"], "审批": ["approval", "approve", "submit"], "提交": ["submit", "approval"],
    "通过": ["approve", "approval"], "状态": ["status", "state"], "查询": ["check", "status"], "提醒": ["reminder", "notify"],
}
WIDE = ["high", "critical", "wide", "large", "global"]
COMPLEX = ["high", "critical", "complex", "compound"]


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _words(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def quarantine_reason(quarantined: Column, tags: Column) -> Column:
    """The rest of a quarantined record's last ``quarantine:`` tag; null where it has none or is active."""
    marks = F.filter(tags, lambda t: t.startswith("quarantine:"))
    return F.when(quarantined, F.substring(F.try_element_at(marks, F.lit(-1)), 12, 1 << 20))


def added(before: Column, after: Column) -> Column:
    """What ``after`` has and ``before`` lacks, in the order of ``after``; nothing where either is null."""
    fresh = F.filter(after, lambda x: ~F.coalesce(F.array_contains(before, x), F.lit(False)))
    return F.coalesce(F.when(before.isNotNull(), fresh), _no_strings())


def gist(text: Column, most: int = 240) -> Column:
    """struct(summary, truncated): the first ``most`` characters and whether more follow; null reads as empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.substring(whole, 1, most).alias("summary"), (F.length(whole) > most).alias("truncated"))


def clean_banner(banner: Column, most: int = 180) -> Column:
    """Printable ASCII with runs of blanks made one, cut with an ellipsis where longer than ``most``; null gives the empty string."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(banner, F.lit("")), r"[^ -~]", " "), r" +", " "))
    return F.when(F.length(plain) > most, F.concat(F.rtrim(F.substring(plain, 1, most - 1)), F.lit("…"))).otherwise(plain)


def outdated_shell(banner: Column) -> Column:
    """The label of an SSH server that is clearly old (OpenSSH before 8.0, any Dropbear), else null."""
    openssh, dropbear = r"(?i)OpenSSH[_ ]([0-9]+)(\.[0-9]+)(\S*)", r"(?i)dropbear[_ ](\w[\w.]*|\.[\w.]*)"
    part = lambda i: F.regexp_extract(banner, openssh, i)
    old = F.when(part(1).try_cast("int") < 8, F.concat(F.lit("OpenSSH "), part(1), part(2), part(3)))
    return F.when(banner.rlike(openssh), old).when(banner.rlike(dropbear), F.concat(F.lit("dropbear "), F.regexp_extract(banner, dropbear, 1)))


def host_label(ip: Column, ports: Column, banners: Column) -> Column:
    """At most two service words and the last part of the address, of (ports array<int>, banners map<int,string>)."""
    on = lambda p: F.array_contains(ports, p)
    said = lambda words, text: F.coalesce(F.contains(text, F.lit(words)), F.lit(False))
    store = F.when(on(3306), "mariadb").when(on(5432), "pg")
    ftp = on(21) & said("FileZilla", F.try_element_at(banners, F.lit(21)))
    main = F.array_compact(
        F.array(
            F.when(F.exists(F.map_values(banners), lambda b: said("DAHUA", b)), "dahua"), store, F.when(on(3389), "rdp"), F.when(on(23), "telnet"), F.when(ftp, "ftp"), F.when(on(9200) & store.isNull(), "es"),
        )
    )
    rest = F.when(on(554), "cam").when(on(22), "ssh").when(on(80) | on(443), "web").otherwise("host")
    return F.concat(F.array_join(F.when(F.size(main) > 0, F.slice(main, 1, 2)).otherwise(F.array(rest)), "-"), F.lit("-."), F.substring_index(ip, ".", -1))


def wide_blast(declared: Column, radius: Column) -> Column:
    return F.coalesce(declared, F.lit(False)) | _words(radius).isin(*WIDE)


def is_complex(declared: Column, word: Column, score: Column, assets: Column, terms: Column, least: float = 0.7) -> Column:
    """Declared, said in a word, scored, or at least three assets together with six query terms."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return F.coalesce(declared, F.lit(False)) | _words(word).isin(*COMPLEX) | (F.coalesce(score, F.lit(0.0)) >= least) | ((count(assets) >= 3) & (count(terms) >= 6))


def usage_cost(model: Column, prompt: Column, completion: Column) -> Column:
    """Cost of a call by the model's rates, to six places."""
    known = F.create_map(*[x for m, r in RATES.items() for x in (F.lit(m), F.array(*map(F.lit, r)))])
    rate = F.coalesce(F.try_element_at(known, model), F.array(*map(F.lit, OTHER_RATE)))
    return F.round(prompt / 1_000_000 * F.get(rate, F.lit(0)) + completion / 1_000_000 * F.get(rate, F.lit(1)), 6)


def breadcrumb(path: Column, trail: Column) -> Column:
    """The section path, then the headings below it; a heading that repeats the part before it is left out."""
    parts = F.aggregate(trail, path, lambda acc, h: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) != h), F.array_append(acc, h)).otherwise(acc))
    return F.array_join(parts, " > ")


def request_parts(request: Column) -> Column:
    """The steps of a request, cut at its connectors; blank steps are left out."""
    marked = request
    for connector in CONNECTORS:
        marked = F.replace(marked, F.lit(connector), F.lit("|"))
    return F.filter(F.transform(F.split(marked, r"\|"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def request_terms(request: Column) -> Column:
    """Sorted lower-case words of a request and, for each known phrase in it, the phrase and what it stands for."""
    found = F.transform(F.regexp_extract_all(F.replace(request, F.lit("_"), F.lit(" ")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    for phrase, more in PHRASES.items():
        found = F.concat(found, F.when(F.contains(request, F.lit(phrase)), F.array(*map(F.lit, [phrase, *more]))).otherwise(_no_strings()))
    return F.array_sort(F.array_distinct(found))


def shaper_bps(label: Column) -> Column:
    """The rate in a shaper's label (``guarantee-100kbps``) in bits a second; null where it names none."""
    pattern = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*([kmg]?)bps"
    unit = F.lower(F.regexp_extract(label, pattern, 2))
    times = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return F.when(label.rlike(pattern), F.floor(F.regexp_extract(label, pattern, 1).try_cast("double") * times))


def subject_id(*parts: Column) -> Column:
    """A stable id of a subject: the SHA-1 of its parts."""
    return F.sha1(F.concat_ws("|", *parts))


def evidence_id(kind: Column, fact: Column) -> Column:
    """A stable id of a fact, given as JSON text in canonical form (sorted keys, no blanks)."""
    said = F.concat(F.lit('{"fact":'), fact, F.lit(',"kind":'), F.to_json(F.array(kind)).substr(F.lit(2), F.length(F.to_json(F.array(kind))) - 2), F.lit("}"))
    return F.concat(F.lit("ev-"), F.substring(F.sha2(said, 256), 1, 16))


def position(value: Column, low: Column, high: Column, stepped: Column) -> Column:
    """Which bound a value sits on or next to: min, max, just_inside, just_outside; null for none.

    Whole numbers (``stepped``) are next to a bound at a distance of one; of other numbers only those beyond a bound are outside.
    """
    near = lambda step: F.coalesce(value == low + step, F.lit(False)) | F.coalesce(value == high - step, F.lit(False))
    beyond = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))
    outside = F.when(~stepped | near(-1), "just_outside")
    return F.when(value == low, "min").when(value == high, "max").when(beyond, outside).when(stepped & near(1), "just_inside")


def positions(low: Column, high: Column, stepped: Column) -> Column:
    """The positions that some value can take: none without a bound, no ``just_inside`` where no whole number lies between."""
    inside = F.when(low.isNotNull() & high.isNotNull(), low + 1 < high).otherwise(True)
    bounded = low.isNotNull() | high.isNotNull()
    return F.array_compact(F.array(F.when(low.isNotNull(), "min"), F.when(high.isNotNull(), "max"), F.when(bounded & stepped & inside, "just_inside"), F.when(bounded, "just_outside")))


def legal(value: Column, low: Column, high: Column) -> Column:
    """Within the bounds there are; null values are not."""
    return value.isNotNull() & ~F.coalesce(value < low, F.lit(False)) & ~F.coalesce(value > high, F.lit(False))


def landed(intended: Column, observed: Column) -> Column:
    """Whether every entry of ``intended`` (paths to values) stands in ``observed``; an empty intention never has."""
    met = F.forall(F.map_entries(intended), lambda e: F.coalesce(F.try_element_at(observed, e["key"]).eqNullSafe(e["value"]) & F.map_contains_key(observed, e["key"]), F.lit(False)))
    return F.coalesce((F.size(intended) > 0) & met, F.lit(False))


# How much an intent counts by the kind of record it asks for.
INTENT = {"root_cause": 16.0, "alert": 10.0, "incident": 8.0, "device": 6.0, "incident_of_cause": 4.0}


def intent_score(terms: Column, kind: Column) -> Column:
    """How well a record's kind fits what is asked, from the words of the question."""
    says = lambda w: F.coalesce(F.array_contains(terms, w), F.lit(False))
    cause = says("root") | says("cause") | says("rca")
    weight = lambda test, name: F.when(test, INTENT[name]).otherwise(0.0)
    causal = weight(cause & (kind == "root_cause"), "root_cause") + weight(cause & (kind == "incident"), "incident_of_cause")
    return causal + sum((weight(says(k) & (kind == k), k) for k in ("alert", "incident", "device")), F.lit(0.0))
