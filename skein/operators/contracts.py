"""Contracts of steps, held as rows: what must hold before, after and on both sides of a step, and what it must have written.

A rule (skill, phase, rule, side, path, op, operand, other, message) looks up ``path`` (``$.a.b``)
in one side of a step and compares it with ``operand``, or with the same step's ``other`` side at
``operand``. Rules meet steps by an equi-join on the skill, so new rules need no new code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import settle
from skein.operators.nested import LEVELS, children, kind, let, members

SIDES = ("before", "after", "args", "result")
PHASES = ("pre", "post", "invariant", "readback")
OPS = ("exists", "missing", "eq", "ne", "lt", "le", "gt", "ge", "in", "matches")
# The threshold and the score of a step whose result names another skill.
JUDGE, MISNAMED = 0.5, 0.25
NUMBERS = ("long", "bigint", "decimal", "double", "float", "int", "smallint", "tinyint")
NOT_LANDED = "claimed but not landed: intended effect absent from observed state"


def _side(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for side in SIDES:
        out = out.when(name == side, F.col(side))
    return out


def _holds(op: Column, value: Column, than: Column) -> Column:
    """Whether a value fits; numbers compare as numbers where both sides are, anything else as text. A missing value fits ``missing`` alone."""
    a, b = value.try_cast("double"), than.try_cast("double")
    number = a.isNotNull() & b.isNotNull()
    less = F.when(number, a < b).otherwise(value < than)
    same = F.when(number, a == b).otherwise(value == than)
    out = F.when(op == "exists", value.isNotNull()).when(op == "missing", value.isNull()).when(value.isNull(), F.lit(False))
    out = out.when(op == "eq", same).when(op == "ne", ~same).when(op == "lt", less).when(op == "le", less | same).when(op == "gt", ~less & ~same).when(op == "ge", ~less)
    out = out.when(op == "in", F.array_contains(F.split(than, r"\|"), value)).when(op == "matches", F.regexp_like(value, than))
    return F.coalesce(out, F.lit(False))


def _pairs(want: Column, have: Column, levels: int) -> Column:
    """(ok, w, h) for each place of ``want``: whether ``have`` is alike there; containers ``levels`` deep are left as they are (w, h)."""
    told = lambda ok, w=None, h=None: F.array(F.struct(ok.alias("ok"), *[(F.lit(None) if x is None else x).cast("variant").alias(n) for x, n in ((w, "w"), (h, "h"))]))
    k, l = kind(want), F.when(have.isNotNull(), kind(have))
    number = k.isin(*NUMBERS) & F.coalesce(l.isin(*NUMBERS), F.lit(False))
    same = F.when(number, want.try_cast("double") == have.try_cast("double")).otherwise(k.eqNullSafe(l) & want.try_cast("string").eqNullSafe(have.try_cast("string")))
    alike = told(F.coalesce(same, F.lit(False)))
    boxed = children(want)
    if not levels:
        return F.when(boxed.isNotNull(), told(F.lit(True), want, have)).otherwise(alike)
    inside = F.struct(boxed.alias("c"), members(want).isNotNull().alias("object"), members(have).alias("m"), have.try_cast("array<variant>").alias("a"))

    def box(x: Column) -> Column:
        pair = lambda v, other: F.struct(v["value"].alias("w"), other.alias("h"))
        by_key = F.transform(x["c"], lambda v: pair(v, F.try_element_at(x["m"], v["key"])))
        pairs = F.when(x["object"], by_key).otherwise(F.transform(x["c"], lambda v, i: pair(v, F.get(x["a"], i))))
        fits = F.when(x["object"], x["m"].isNotNull()).otherwise(F.coalesce(F.size(x["a"]) == F.size(x["c"]), F.lit(False)))
        below = F.flatten(F.transform(pairs, lambda p: _pairs(p["w"], p["h"], levels - 1)))
        return F.when(x["c"].isNull(), alike).when(fits, below).otherwise(told(F.lit(False)))

    return let(inside, box)


def landed(steps: DataFrame, key: str, intended: str, after: str) -> DataFrame:
    """(key, landed): whether every leaf of the ``intended`` JSON stands at the same place of ``after``; an empty or missing intention never does.

    Objects are contained member by member; arrays must be as long and alike at every place. Both are gone through
    within their row, ``LEVELS`` levels a pass; the loop ends with the pass that leaves no container.
    """
    want, have = F.try_parse_json(intended), F.try_parse_json(after)
    rows = steps.select(key, want.alias("_w"), have.alias("_h"))
    rows = rows.select(key, F.coalesce(F.size(members(F.col("_w"))) > 0, F.lit(False)).alias("_some"), _pairs(F.col("_w"), F.col("_h"), LEVELS).alias("_l"))
    good, open_ = F.col("_some") & F.forall("_l", lambda x: x["ok"]), F.exists("_l", lambda x: x["w"].isNotNull())
    out = None
    while True:
        rows = settle(rows)
        told = rows.where(~(good & open_)).select(key, good.alias("landed"))
        out = told if out is None else out.unionByName(told)
        rest = rows.where(good & open_)
        if rest.isEmpty():
            return out
        rows = rest.select(key, "_some", F.flatten(F.transform(F.filter("_l", lambda x: x["w"].isNotNull()), lambda x: _pairs(x["w"], x["h"], LEVELS))).alias("_l"))


def check_steps(steps: DataFrame, rules: DataFrame, threshold: float = JUDGE) -> DataFrame:
    """(step_id, passed, score, pre, post, invariants, readback, violations): every step against the rules of its skill.

    ``steps`` has step_id, skill, result_skill and the JSON texts before, after, args, result and
    intended (null where there are none). Violations are listed by phase, then rule; an invariant is
    held to both states and says which. A step is read back if it states an intended effect or its
    skill has a rule of phase ``readback``. The judge gives 0 to a step with violations, less than
    ``threshold`` to one whose result names another skill, and adds a violation below ``threshold``.
    """
    two = F.when(F.col("phase") == "invariant", F.array(F.lit("before"), F.lit("after"))).otherwise(F.array("side"))
    tests = rules.where("phase <> 'readback'").withColumn("side", F.explode(two))
    # Skills are few and have many steps each: rules go to the steps.
    met = steps.select("step_id", "skill", *SIDES).join(F.broadcast(tests), "skill")
    value = F.call_function("get_json_object", _side(F.col("side")), F.col("path"))
    than = F.when(F.col("other").isNull(), F.col("operand")).otherwise(F.call_function("get_json_object", _side(F.col("other")), F.col("operand")))
    failed = met.where(~_holds(F.col("op"), value, than))
    order = F.when(F.col("phase") == "pre", 0).when(F.col("phase") == "post", 1).when(F.col("side") == "before", 2).otherwise(3)
    said = F.when(F.col("phase") == "invariant", F.concat_ws(": ", "side", "message")).otherwise(F.col("message"))
    listed = failed.groupBy("step_id").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("o"), "rule", said.alias("m")))).alias("l"), *[F.count_if(F.col("phase") == p).alias(n) for p, n in (("pre", "pre"), ("post", "post"), ("invariant", "invariants"))]
    )  # no more than the skill's rules
    writes = rules.where("phase = 'readback'").select("skill").distinct().withColumn("_w", F.lit(True))
    read = steps.select("step_id", "skill", "intended", "after").join(F.broadcast(writes), "skill", "left").where(F.coalesce("_w", F.lit(False)) | F.coalesce(F.try_parse_json("intended").isNotNull() & (F.col("intended") != "{}"), F.lit(False)))
    lost = landed(read, "step_id", "intended", "after").where("NOT landed").select("step_id", F.lit(1).alias("readback"))
    rows = steps.select("step_id", "skill", "result_skill").join(listed, "step_id", "left").join(lost, "step_id", "left")
    none = F.array().cast("array<string>")
    broken = F.concat(F.coalesce(F.transform("l", lambda x: x["m"]), none), F.when(F.col("readback") == 1, F.array(F.lit(NOT_LANDED))).otherwise(none))
    score = F.when(F.size("b") > 0, 0.0).when(F.coalesce("result_skill", "skill") == F.col("skill"), 1.0).otherwise(MISNAMED)
    judged = rows.withColumn("b", broken).withColumn("score", score)
    every = F.when(F.col("score") < threshold, F.array_append("b", F.concat(F.lit("step judge score below threshold: "), F.format_string("%.4f", "score")))).otherwise(F.col("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return judged.select("step_id", (F.size(every) == 0).alias("passed"), "score", zero("pre"), zero("post"), zero("invariants"), zero("readback"), every.alias("violations"))
