"""Cases: checks of what was concluded, merging of evidence, recall, coverage of sources, and scorecards of suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import cases as scalars
from skein.functions.text import parts
from skein.operators import evaluate, retrieval
from skein.operators.graph import settle

# The sources a class of fault needs before it can be seen at all.
REQUIRED = {
    "duplicate_ip_dhcp": ["dhcp_ack"], "duplicate_ip_static": ["l2_identity"], "address_unmanaged": ["dhcp_ack", "l3_flow"], "lease_churn": ["dhcp_ack"], "host_multi_address": ["dhcp_ack"],
    "unmanaged_identity": ["dhcp_ack"], "pool_pressure": ["dhcp_stats"], "session_tuple_clash": ["session_clash"], "mgmt_bruteforce": ["admin_auth"], "gateway_reachability": ["host_probe"], "resolver_failure": ["host_probe"],
    "l2_loop_macflap": ["switch_mac_table"], "rogue_dhcp": ["client_dhcp_view"], "host_config_drift": ["host_probe"],
}
# Kinds of cases in order, the skew beyond which a suite is lopsided, and the axes in order.
KINDS = ("happy_path", "boundary", "negative", "error_path", "idempotency")
MOST_SKEW = 0.35
FEW = 6  # records and cases of so many terms at most meet on subsets of them
AXES = ("kind_balance", "boundary_coverage", "error_coverage", "param_coverage")


def check_claims(claims: DataFrame, evidence: DataFrame, contracts: DataFrame, required: DataFrame) -> DataFrame:
    """(claim_id, errors, recall, passed): the rules that a claim breaks, in order, and its share of the required evidence.

    ``claims`` (claim_id, case_id, cause, readonly, cited array), ``evidence`` (case_id, evidence_id, kind, current,
    contradicts), ``contracts`` (cause, evidence_id), ``required`` (case_id, evidence_id). Claims without a cause,
    without citations, or of cases without evidence are kept and fail; a case that requires nothing has recall 1.
    Each rule is a join on the case or the cause, so no evidence is gathered in one place.
    """
    asked = claims.select("claim_id", "case_id", "cause")
    cited = claims.select("claim_id", "case_id", "cause", F.explode(F.array_distinct("cited")).alias("evidence_id"))
    current = (F.coalesce(F.col("kind"), F.lit("")) != "knowledge_document") & F.coalesce("current", F.lit(True))
    known = evidence.groupBy("case_id", "evidence_id").agg(F.collect_set("contradicts").alias("against"), F.max(current).alias("observed"))
    met = cited.join(known, ["case_id", "evidence_id"], "left")
    counts = met.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("cites"), F.count_if(F.col("observed").isNull()).alias("unknown"), F.count_if(F.col("observed")).alias("seen"), F.count_if(F.array_contains("against", F.col("cause"))).alias("contrary"),
    )
    held = cited.select("claim_id", "evidence_id").withColumn("_h", F.lit(1))
    needs = lambda rows, key: asked.join(rows.select(key, "evidence_id"), key).join(held, ["claim_id", "evidence_id"], "left").groupBy("claim_id")
    support = needs(contracts.distinct(), "cause").agg(F.count_if(F.col("_h").isNull()).alias("unsupported"))
    recall = needs(required, "case_id").agg(F.round(F.count("_h") / F.count(F.lit(1)), 4).alias("recall"))
    rows = claims.select("claim_id", "readonly", "cause").join(counts, "claim_id", "left").join(support, "claim_id", "left").join(recall, "claim_id", "left").withColumn("recall", F.coalesce("recall", F.lit(1.0)))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = {
        "not_readonly": ~F.coalesce("readonly", F.lit(False)), "no_cause": F.coalesce(F.col("cause"), F.lit("")) == "", "no_citation": n("cites") == 0, "unknown_citation": n("unknown") > 0,
        "no_current_observation": (n("cites") > 0) & (n("seen") == 0), "contradicted": n("contrary") > 0, "contract_unmet": n("unsupported") > 0, "required_missing": F.col("recall") < 1.0,
    }
    errors = F.array_join(F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()])), ",")
    return rows.select("claim_id", errors.alias("errors"), "recall").withColumn("passed", F.col("errors") == "")


def merge_evidence(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of (case_id, seq, evidence_id, payload, role, claim_key, claim_value).

    The first row of an evidence id stands; ``conflicts`` (case_id, conflict) names ids whose rows differ in
    payload, rows without an id, and standing rows that give a key another value than the first one did, with the
    role that last agreed and the one that does not. Where a row came from is no part of its payload.
    """
    named = rows.where(F.coalesce("evidence_id", F.lit("")) != "")
    fields = F.struct(*[c for c in rows.columns if c not in ("case_id", "evidence_id")])
    grouped = named.groupBy("case_id", "evidence_id").agg(F.min_by(fields, "seq").alias("f"), F.min("payload").eqNullSafe(F.max("payload")).alias("_one"), F.count("payload").alias("_k"), F.count(F.lit(1)).alias("_n"))
    merged = grouped.select("case_id", "evidence_id", "f.*")
    twice = grouped.where(~F.col("_one") | ((F.col("_k") > 0) & (F.col("_k") < F.col("_n")))).select("case_id", F.concat(F.lit("duplicate_id:"), "evidence_id").alias("conflict"))
    blank = rows.where(F.coalesce("evidence_id", F.lit("")) == "").select("case_id", F.lit("evidence_without_id").alias("conflict"))
    w = Window.partitionBy("case_id", "claim_key").orderBy("seq", "evidence_id")
    said = merged.where(F.coalesce("claim_key", F.lit("")) != "").withColumn("role", F.coalesce("role", F.lit("unknown"))).withColumn("_first", F.first("claim_value").over(w))
    agrees = F.col("claim_value").eqNullSafe(F.col("_first"))
    before = F.last(F.when(agrees, F.col("role")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    claims = said.withColumn("_b", before).where(~agrees).select("case_id", F.concat(F.lit("claim:"), "claim_key", F.lit(":"), "_b", F.lit("!="), "role").alias("conflict"))
    return merged, twice.union(blank).union(claims).distinct()


def recall_episode(records: DataFrame, cases: DataFrame, least: float = 0.8, sure: float = 0.9) -> DataFrame:
    """(case_id, memory_id): the first record fit to be a case's hypothesis; cases without one are left out.

    ``records`` (memory_id, tags, asset_ids, confidence, observed, insertion_order), ``cases`` (case_id, terms, assets). A record
    must have been observed, be sure, share an asset, and hold the share ``least`` of the terms. Of records with the
    same terms only the first counts. Where both sides have ``FEW`` terms at most, a case meets, asset by asset, the first record
    of each subset of as few of its terms as make the share; others meet on an asset and one of the first (1 - least) n + 1 of n terms,
    one of which a record that holds so many must hold.
    """
    terms = F.array_sort(F.array_distinct("terms"))
    cases = cases.select("case_id", terms.alias("t"), "assets").where(F.size("t") > 0)
    asked = cases.select("t", F.explode(F.array_distinct("assets")).alias("asset")).distinct()
    fit = records.where((F.col("confidence") >= sure) & F.col("observed")).select(F.struct("insertion_order", "memory_id").alias("v"), F.array_sort(F.array_distinct(F.transform("tags", F.lower))).alias("own"), F.explode(F.array_distinct("asset_ids")).alias("asset"))
    fit = fit.groupBy("own", "asset").agg(F.min("v").alias("v"))
    few = lambda c: F.size(c) <= FEW
    enough = F.size(F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: i / F.size("t") < least)) + 1
    index = fit.where(few("own")).select("asset", "v", F.explode(parts(F.col("own"))).alias("p")).groupBy("asset", "p").agg(F.min("v").alias("v"))
    short = asked.where(few("t")).select("t", "asset", enough.alias("n"), F.explode(parts(F.col("t"))).alias("p")).where(F.size("p") == F.col("n")).join(index, ["asset", "p"]).select("t", "asset", "v")

    def by_term(asked: DataFrame, fit: DataFrame) -> DataFrame:
        lead = F.slice("t", F.lit(1), (F.floor(F.size("t") * (1 - least) + 1e-9) + 1).cast("int"))
        met = fit.select("own", "v", "asset", F.explode("own").alias("term")).join(asked.select("t", "asset", F.explode(lead).alias("term")), ["asset", "term"])
        return met.where(F.size(F.array_intersect("t", "own")) / F.size("t") >= least).select("t", "asset", "v")

    every = short.union(by_term(asked, fit.where(~few("own")))).union(by_term(asked.where(~few("t")), fit.where(few("own"))))
    best = every.groupBy("t", "asset").agg(F.min("v").alias("v"))
    found = cases.select("case_id", "t", F.explode(F.array_distinct("assets")).alias("asset")).join(best, ["t", "asset"])
    return found.groupBy("case_id").agg(F.min("v").alias("v")).select("case_id", "v.memory_id")


def entity_relation(kind: Column, entity: Column, types: Column, entities: Column) -> Column:
    """How a wrong first hit relates to what was asked: by its kind, then by its entity."""
    kind, entity = F.lower(kind), F.lower(entity)
    same = kind.isin("country", "asn") & F.array_contains(types, kind)
    return F.when(~F.coalesce(same, F.lit(False)), "different_entity_type").when(F.array_contains(entities, entity), "same_type_same_entity").otherwise("same_type_different_entity")


def run_measures(rows: DataFrame) -> DataFrame:
    """One row a variant of (variant, answerable, published, correct, grounded, cited, required, latency): rates are null over nothing.

    Recall of required evidence is over all answerable runs together; the 95th percentile is a measured latency.
    """
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    yes, no = F.col("answerable"), ~F.col("answerable")
    hit, want = F.size(F.array_intersect("cited", "required")), F.size("required")
    n, m = F.count_if(yes), F.count_if(no)
    return rows.groupBy("variant").agg(
        n.alias("answerable"), m.alias("negatives"), ratio(F.count_if(yes & F.col("published") & F.col("correct")), n).alias("accuracy"), ratio(F.sum(F.when(yes, hit)), F.sum(F.when(yes, want))).alias("evidence_recall"),
        ratio(F.count_if(yes & F.col("grounded")), n).alias("grounded"), ratio(F.count_if(yes & ~F.col("published")), n).alias("false_refusals"), ratio(F.count_if(no & F.col("published")), m).alias("unsupported"),
        ratio(F.count_if(no & ~F.col("published")), m).alias("right_refusals"), F.round(F.median("latency"), 3).alias("latency_median"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)"), 3).alias("latency_p95"),
    )


def rollouts(events: DataFrame) -> DataFrame:
    """(run_id, case_id, cost, probes, resolved, memories) of (run_id, case_id, seq, kind, ids array, blocked, cost).

    Memories are those read or resolved from, in the order first met; only tool calls that were let through count.
    """
    used = events.where(F.col("kind").isin("memory_read", "memory_resolved")).select("run_id", "seq", F.posexplode("ids").alias("at", "id"))
    first = used.groupBy("run_id", "id").agg(F.min(F.struct("seq", "at")).alias("f"))
    listed = first.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "id"))), lambda x: x["id"]), ",").alias("memories"))
    call = (F.col("kind") == "tool_called") & ~F.coalesce("blocked", F.lit(False))
    totals = events.groupBy("run_id").agg(
        F.min_by("case_id", "seq").alias("case_id"), F.round(F.coalesce(F.sum(F.when(F.col("kind") == "cost_observed", F.col("cost"))), F.lit(0.0)), 6).alias("cost"), F.count_if(call).alias("probes"), (F.count_if(F.col("kind") == "memory_resolved") > 0).alias("resolved"),
    )
    return totals.join(listed, "run_id", "left").withColumn("memories", F.coalesce("memories", F.lit("")))


def dropped(retrieved: DataFrame, included: DataFrame) -> DataFrame:
    """The rows of ``retrieved`` (run_id, tier, memory_id) that did not come into the context of their run."""
    return retrieved.join(included.select("run_id", "memory_id"), ["run_id", "memory_id"], "left_anti")


def source_coverage(present: DataFrame, required: dict[str, list[str]] | None = None) -> DataFrame:
    """(fault, state, missing): whether the sources in ``present`` (source) let a class of fault be seen: covered, partial or blind."""
    needs = present.sparkSession.createDataFrame([(f, s) for f, all_ in (required or REQUIRED).items() for s in all_], "fault string, source string")
    seen = needs.join(present.select("source").distinct().withColumn("_p", F.lit(1)), "source", "left")
    state = F.when(F.count("_p") == F.count(F.lit(1)), "covered").when(F.count("_p") > 0, "partial").otherwise("blind")
    return seen.groupBy("fault").agg(state.alias("state"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_p").isNull(), F.col("source")))), ",").alias("missing"))


def address_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(host, missing, unexpected, detected) of two (host, address): only a missing address is drift."""
    e, a = expected.select("host", "address").distinct().withColumn("_e", F.lit(1)), actual.select("host", "address").distinct().withColumn("_a", F.lit(1))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c).isNull(), F.col("address")))), ",")
    return e.join(a, ["host", "address"], "full").groupBy("host").agg(listed("_a").alias("missing"), listed("_e").alias("unexpected"), (F.count_if(F.col("_a").isNull()) > 0).alias("detected"))


def session_report(traces: DataFrame) -> DataFrame:
    """(session_id, traces, failed, partial, latest_status) of (session_id, trace_id, started, status)."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return traces.groupBy("session_id").agg(F.count(F.lit(1)).alias("traces"), is_("error").alias("failed"), is_("partial").alias("partial"), F.max_by("status", F.struct("started", "trace_id")).alias("latest_status"))


def newest_traces(ledger: DataFrame, n: int) -> DataFrame:
    """(trace_id, at): the ``n`` traces whose last appended entry (by ``seq``, not by time) is the latest."""
    last = ledger.groupBy("trace_id").agg(F.max_by("ts", "seq").alias("at"))
    return last.orderBy(F.desc("at"), "trace_id").limit(n)


def replay_updates(lines: DataFrame, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(state, bad) of (seq, line): the last update of each key, and lines that are no update, which stop nothing."""
    read = lines.select("seq", "line", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("u"))
    good = F.coalesce(F.col(f"u.{key}").isNotNull(), F.lit(False))
    state = read.where(good).groupBy(F.col(f"u.{key}").alias(key)).agg(F.max_by("u", "seq").alias("u")).select("u.*")
    return state, read.where(~good).select("seq", "line")


def _told(cases: DataFrame, inputs: DataFrame, shared: DataFrame | None) -> DataFrame:
    """(spec, case_id, param, value): the cases' own inputs, and of the shared ones those at their targets."""
    own = inputs.select("spec", "case_id", "param", "value")
    if shared is None:
        return own
    aimed = cases.select("spec", "case_id", "profile", F.col("target_param").alias("param"))
    return own.unionByName(aimed.join(shared, ["spec", "profile", "param"]).select("spec", "case_id", "param", "value"))


def case_defects(params: DataFrame, cases: DataFrame, inputs: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """(spec, case_id, defect): where a case's own claims do not fit its inputs; null where they do.

    ``params`` (spec, param, low, high, required), ``cases`` (spec, case_id, kind, target_param, role), ``inputs``
    (spec, case_id, param, value). Values are whole numbers. Inputs that many cases have alike may be given once, in
    ``shared`` (spec, profile, param, value): those of every case with that ``profile``, besides its own, which are of
    other parameters. They are counted once a profile, not once a case.
    """
    declared = params.select("spec", "param", "low", "high", "required").withColumn("_d", F.lit(True))
    fits = scalars.legal(F.col("value"), F.col("low"), F.col("high"))
    counts = {"undeclared": F.count_if(F.col("_d").isNull()), "illegal": F.count_if(F.col("_d") & ~fits), "given": F.count_if("required")}
    tally = lambda rows, key, at: rows.join(declared, ["spec", "param"], "left").groupBy("spec", key).agg(*[x.alias(at + c) for c, x in counts.items()])
    needs = params.groupBy("spec").agg(F.count_if("required").alias("needed"))
    aimed = cases.select("spec", "case_id", F.col("target_param").alias("param")).join(declared, ["spec", "param"]).join(_told(cases, inputs, shared), ["spec", "case_id", "param"], "left")
    aim = aimed.groupBy("spec", "case_id").agg(F.lit(True).alias("named"), F.first("value").alias("value"), F.first(scalars.position(F.col("value"), F.col("low"), F.col("high"), F.lit(True))).alias("at"))
    rows = cases.join(tally(inputs, "case_id", ""), ["spec", "case_id"], "left").join(needs, "spec", "left").join(aim, ["spec", "case_id"], "left")
    if shared is not None:
        rows = rows.join(tally(shared, "profile", "_"), ["spec", "profile"], "left").withColumns({c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0)) for c in counts})
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    lacks = n("given") < n("needed")
    happy = F.when(lacks, "omits_required").when(n("illegal") > 0, "illegal_value")
    boundary = F.when(F.col("named").isNull(), "no_parameter").when(F.col("value").isNull(), "not_passed").when(F.col("at").isNull(), "no_boundary").when(F.col("role") != F.col("at"), "other_role")
    negative = F.when(~lacks & (n("illegal") == 0), "all_legal")
    kind = F.col("kind")
    defect = F.when(n("undeclared") > 0, "undeclared").when(kind == "happy_path", happy).when(kind == "boundary", boundary).when(kind == "negative", negative)
    return rows.select("spec", "case_id", defect.alias("defect"))


def scorecard(params: DataFrame, cases: DataFrame, inputs: DataFrame, errors: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """One row a spec: cases by kind, skew, the four axes, self-consistency, and the axis most worth work.

    ``params`` also has ``default``, ``cases`` ``target_error`` and ``expected``; kinds that a spec cannot need do not count,
    nor does idempotency unless some case is of that kind. Balance competes only where a suite is lopsided or lacks a kind.
    ``shared`` are inputs by ``profile``, as in ``case_defects``; the profile of each is that of some case.
    """
    values = _told(cases, inputs, shared)
    if shared is not None:
        values = values.unionByName(shared.select("spec", F.lit(None).cast(cases.schema["case_id"].dataType).alias("case_id"), "param", "value"))
    counted = cases.groupBy("spec").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS], F.count(F.lit(1)).alias("cases"))
    bounded = params.groupBy("spec").agg((F.count_if(F.col("low").isNotNull() | F.col("high").isNotNull()) > 0).alias("_b"))
    failing = errors.groupBy("spec").agg(F.lit(True).alias("_e"))
    rows = counted.join(bounded, "spec", "left").join(failing, "spec", "left")
    no = F.lit(False)
    wanted = {"happy_path": F.lit(True), "boundary": F.coalesce("_b", no), "negative": F.lit(True), "error_path": F.coalesce("_e", no), "idempotency": no}
    share = lambda k: F.col(k) / F.col("cases")
    entropy = sum((F.when(F.col(k) > 0, -share(k) * F.log(share(k))).otherwise(0.0) for k in KINDS), F.lit(0.0))
    width = sum(((wanted[k] | (F.col(k) > 0)).cast("int") for k in KINDS), F.lit(0))
    skew = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - entropy / F.log(width.cast("double")))), 4)
    lacking = sum(((wanted[k] & (F.col(k) == 0)).cast("int") for k in KINDS), F.lit(0)) > 0
    dominant = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(KINDS)]))["k"]
    rows = rows.select("spec", "cases", dominant.alias("dominant"), skew.alias("skew"), (lacking | (skew > MOST_SKEW)).alias("lopsided"))
    defects = case_defects(params, cases, inputs, shared).groupBy("spec").agg(F.round(1 - F.count("defect") / F.count(F.lit(1)), 4).alias("self_consistency"))
    axis = lambda df, name: df.select("spec", F.col("coverage").alias(name))
    rows = rows.join(defects, "spec").join(axis(evaluate.boundary_axis(params, values.select("spec", "param", "value").distinct()), "boundary_coverage"), "spec", "left").join(axis(evaluate.error_axis(errors, cases), "error_coverage"), "spec", "left")
    rows = rows.join(axis(evaluate.parameter_axis(params.select("spec", "param", "default"), values, cases), "param_coverage"), "spec", "left")
    rows = rows.withColumn("kind_balance", F.round(1 - F.col("skew"), 4)).withColumns({a: F.coalesce(a, F.lit(1.0)) for a in AXES[1:]})
    weakest = F.array_min(F.array_compact(F.array(*[F.when(F.lit(a != "kind_balance") | F.col("lopsided"), F.struct(F.col(a).alias("s"), F.lit(i).alias("o"), F.lit(a).alias("a"))) for i, a in enumerate(AXES)])))
    return rows.withColumn("weakest", F.when((weakest["s"] >= 1.0) & ~F.col("lopsided"), "none").otherwise(weakest["a"])).drop("lopsided")


def reflect(docs: DataFrame, queries: DataFrame, k: int = 10, attempt: int = 5, terms: int = 12) -> DataFrame:
    """Rankings after one look back: the query takes on the most frequent new words of its first ``attempt`` documents.

    Words are drawn from found documents only; ties go to the lesser word. Queries that find nothing stay as they are.
    Documents are scored in the tasks that read them, once a search; pairs of a query and a document are no rows.
    """
    docs = settle(docs.select("doc_id", "tokens"))
    tried = settle(retrieval.bm25_met(docs, queries, attempt).select("query_id", "doc_id"))
    words = tried.join(docs.select("doc_id", "tokens"), "doc_id").select("query_id", F.explode("tokens").alias("w"))
    own = queries.select("query_id", F.explode("tokens").alias("w"))
    counts = words.join(own, ["query_id", "w"], "left_anti").groupBy("query_id", "w").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "w"))
    more = counts.withColumn("_r", place).where(F.col("_r") <= terms).groupBy("query_id").agg(F.collect_list("w").alias("more"))
    wider = queries.join(more, "query_id", "left").select("query_id", F.when(F.col("more").isNull(), F.col("tokens")).otherwise(F.concat("tokens", "more")).alias("tokens"))
    return retrieval.bm25_met(docs, wider, k)


def skill_chains(requests: DataFrame, skills: DataFrame) -> DataFrame:
    """(request_id, chain, hits, steps, matched, fallback) of (request_id, request) and (name, description, tags, cost, frozen).

    Each step of a request takes the skill with the most shared terms (then least cost, then greatest name) that no
    earlier step took. A request none of whose steps finds one takes the best skill for its whole text. A step meets at
    most every skill, of which there are few; the choice in order is made within the row of a request.
    """
    whole = requests.select("request_id", F.lit(-1).alias("i"), F.col("request").alias("step"))
    parts = requests.select("request_id", F.posexplode(scalars.request_parts(F.col("request"))).alias("i", "step"))
    every = whole.union(parts)
    asked = every.select("request_id", "i", F.explode(scalars.request_terms(F.col("step"))).alias("t"))
    said = F.concat_ws(" ", "name", "description", F.concat_ws(" ", "tags"))
    held = skills.where("NOT frozen").select("name", "cost", F.explode(scalars.request_terms(said)).alias("t"))
    hits = asked.join(held, "t").groupBy("request_id", "i", "name").agg(F.count(F.lit(1)).alias("n"), (-F.first("cost")).alias("c"))
    options = hits.groupBy("request_id", "i").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "c", "name")))).alias("o"))
    rows = every.join(options, ["request_id", "i"], "left").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("o", F.array().cast("array<struct<n:bigint,c:double,name:string>>")).alias("o")))).alias("s"))

    def choose(chain: Column, step: Column) -> Column:
        free = F.filter(step["o"], lambda o: ~F.exists(chain, lambda taken: taken["name"] == o["name"]))
        return F.when(F.size(free) > 0, F.array_append(chain, free[0])).otherwise(chain)

    chain = F.aggregate(F.filter("s", lambda x: x["i"] >= 0), F.array().cast("array<struct<n:bigint,c:double,name:string>>"), choose)
    first = F.slice(F.flatten(F.transform(F.filter("s", lambda x: x["i"] < 0), lambda x: x["o"])), 1, 1)
    rows = rows.withColumn("_c", chain).withColumn("_f", first).withColumn("chain", F.when(F.size("_c") > 0, F.col("_c")).otherwise(F.col("_f")))
    return rows.select(
        "request_id", F.array_join(F.transform("chain", lambda x: x["name"]), ">").alias("chain"), F.array_join(F.transform("chain", lambda x: x["n"].cast("string")), ",").alias("hits"),
        (F.size("s") - 1).alias("steps"), F.size("_c").alias("matched"), ((F.size("_c") == 0) & (F.size("_f") > 0)).alias("fallback"),
    )


def boundary_cases(params: DataFrame) -> DataFrame:
    """(spec, param, role, value): one whole value for each position that a parameter (spec, param, low, high) can be tried at."""
    low, high = F.col("low"), F.col("high")
    role = F.col("role")
    inside = F.when(low.isNotNull(), low + 1).otherwise(high - 1)
    value = F.when(role == "min", low).when(role == "max", high).when(role == "just_inside", inside).otherwise(F.when(low.isNotNull(), low - 1).otherwise(high + 1))
    return params.select("spec", "param", "low", "high", F.explode(scalars.positions(low, high, F.lit(True))).alias("role")).select("spec", "param", "role", value.alias("value"))


def host_sessions(flows: DataFrame) -> DataFrame:
    """(ip, peer, direction, sessions, bytes, ports) of (src, dst, port, bytes): what each host has open, either way."""
    way = lambda a, b, d: flows.select(F.col(a).alias("ip"), F.col(b).alias("peer"), F.lit(d).alias("direction"), "port", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return way("src", "dst", "out").union(way("dst", "src", "in")).groupBy("ip", "peer", "direction").agg(F.count(F.lit(1)).alias("sessions"), F.sum("bytes").alias("bytes"), F.countDistinct("port").alias("ports"))


# What each observation makes the risk of a site, the gravest first.
ADMIN = ("ssh", "rdp", "admin-http", "admin-https")
STORES = ("postgres", "mysql", "mongodb", "redis")
WEAK_TLS = ("expired", "weak_cipher", "self_signed_weak")


def host_services(evidence: DataFrame) -> DataFrame:
    """(host, services, evidence) of (host, port, service): the distinct services of each host and how much evidence it has."""
    said = F.when(F.col("port").isNotNull() & (F.coalesce("service", F.lit("")) != ""), F.concat("host", F.lit(":"), "port", F.lit("/"), "service"))
    return evidence.where("host IS NOT NULL").groupBy("host").agg(F.array_join(F.array_sort(F.collect_set(said)), ",").alias("services"), F.count(F.lit(1)).alias("evidence"))


def site_risk(evidence: DataFrame) -> DataFrame:
    """(site, risk, score) of (site, host, port, service, tls, severity): the gravest thing observed; rows without a host count as seen only."""
    has = lambda test: F.count_if(F.col("host").isNotNull() & F.coalesce(test, F.lit(False))) > 0
    service = F.lower("service")
    ladder = [(has(F.col("severity") >= 9.0), "critical_cve_exposed", 95), (has(service.isin(*ADMIN)), "internet_exposed_admin", 82), (has(service.isin(*STORES)), "public_database_exposure", 78),
              (has(F.col("tls").isin(*WEAK_TLS)), "weak_tls_exposed", 58), (has(F.col("port").isNotNull() & (F.col("service") != "")), "informational_exposure", 25)]
    risk, score = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for test, name, points in ladder:
        risk, score = risk.when(test, name), score.when(test, points)
    return evidence.groupBy("site").agg(risk.otherwise("no_exposure_observed").alias("risk"), score.otherwise(0).alias("score"))


def community_profiles(members: DataFrame, ties: DataFrame, by: str = "segment") -> DataFrame:
    """(``by``, label, size, role, maker, kinds, denied) of communities of at least two.

    ``members`` (``by``, label, node, role, maker, denied), ``ties`` (``by``, src, dst, kind). The most frequent role and known
    maker stand for a community, the lesser name on ties; kinds are those of ties within it.
    """
    key = [by, "label"]
    sized = members.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.sum("denied").alias("denied")).where("size >= 2")
    most = lambda c: members.where(F.coalesce(c, F.lit("unknown")) != "unknown").groupBy(*key, c).agg(F.count(F.lit(1)).alias("_n")).groupBy(*key).agg(F.min(F.struct((-F.col("_n")).alias("m"), c)).alias("b")).select(*key, F.col(f"b.{c}").alias(c))
    at = lambda end, name: members.select(by, F.col("node").alias(end), F.col("label").alias(name))
    inner = ties.join(at("src", "label"), [by, "src"]).join(at("dst", "_l"), [by, "dst"]).where("label = _l")
    kinds = inner.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    rows = sized.join(most("role"), key, "left").join(most("maker"), key, "left").join(kinds, key, "left")
    return rows.select(*key, "size", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("maker", F.lit("")).alias("maker"), F.coalesce("kinds", F.lit("")).alias("kinds"), "denied")


def device_search(devices: DataFrame, needle: str, limit: int = 14) -> DataFrame:
    """Devices any of whose texts (ip, name, maker, role, system, ports) hold ``needle``, the gravest band first, then the most flows, then the address.

    ``devices`` also has (segment, band, flows). A blank needle finds nothing; nulls are no text.
    """
    said = F.lower(F.concat_ws(" ", "ip", "name", "maker", "role", "system", F.concat_ws(" ", "ports")))
    wanted = needle.strip().lower()
    band = F.when(F.col("band") == "high", 0).when(F.col("band") == "watch", 1).when(F.coalesce("band", F.lit("ok")) == "ok", 2).otherwise(3)
    found = devices.where(F.contains(said, F.lit(wanted)) & F.lit(wanted != "")).dropDuplicates(["ip", "segment"])
    return found.orderBy(band, F.desc(F.coalesce("flows", F.lit(0))), "ip", "segment").limit(limit)


def incidents(rows: DataFrame, status: str | None = None, kind: str | None = None, ip: str | None = None) -> DataFrame:
    """Rows (status, kind, ip) that equal what is asked; what is not asked does not narrow."""
    for name, value in (("status", status), ("kind", kind), ("ip", ip)):
        rows = rows.where(F.col(name) == value) if value else rows
    return rows


def recent_captures(captures: DataFrame, now, seconds: int) -> DataFrame:
    """Captures (ts) at most ``seconds`` before ``now``, later ones included; those without a time are left out."""
    return captures.where(F.unix_micros(F.lit(now)) - F.unix_micros("ts") <= seconds * 1_000_000)


def tag_overlap(tagged: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) of (doc_id, tags) and (query_id, tokens): how many of its tags a query names, repeated tags each."""
    held = tagged.select("doc_id", F.explode("tags").alias("t")).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("t"))
    return retrieval.top(held.join(asked, "t").groupBy("query_id", "doc_id").agg(F.sum("n").alias("score")), k)
