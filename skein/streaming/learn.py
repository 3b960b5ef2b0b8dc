"""Durable learning from the traces of finished runs: tables of memories, skills and credits, batch after batch.

What one run does to the store depends on the runs before it (a pattern is made once and reinforced
after, a skill freezes at a point of its history), so runs are taken in their order; within a batch
this is said by windows over that order, not by a loop. Each batch makes the next generation of the
tables; a run that was taken once is never taken again, so a batch may be replayed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.graph import settle
from skein.sources import generations

PAYLOAD = "included_memory_ids array<string>, root_cause_key string, confidence double, evidence array<struct<evidence_id: string>>, passed boolean, skills array<string>, memory_id string, memory_ids array<string>, items array<struct<memory_id: string, role: string>>, blocked boolean, skill string, evidence_ids array<string>"
MEMORIES = "memory_id string, tier string, tags array<string>, asset_ids array<string>, confidence double, importance double, strength double, access_count long, quarantined boolean, last_run string"
SKILLS = "skill string, success long, misuse long, frozen boolean"
MARKS = "run_id string, memory_id string, mark string"
#: Names of the tables of a generation: marks are what each run did to a memory (access, credit, contradiction).
TABLES = {"memories": MEMORIES, "skills": SKILLS, "marks": MARKS, "runs": "run_id string"}
# Roles that earn credit, and what a verified run is worth.
CREDITED = ("procedural_shortcut", "diagnosis_support")
CAP, PATTERN, AGAIN, PROCEDURE, REUSED, CREDIT, WORTH = 3.0, 1.2, 0.3, 1.5, 0.4, 0.1, 0.5
STRIKES, FREEZE_AFTER, MISUSED = 2, 4, 0.5


def _strings(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def attributed(p: Column) -> Column:
    """Memories a trace event attributes: those it names, its items', or the one that was resolved."""
    none = F.array().cast("array<string>")
    named = F.concat(F.coalesce(p["memory_ids"], none), F.coalesce(F.transform(p["items"], lambda i: i["memory_id"]), none))
    return F.when(F.col("kind") == "memory_attributed", named).when(F.col("kind") == "memory_resolved", F.array(p["memory_id"])).otherwise(none)


def credited(p: Column) -> Column:
    """Of these, the ones that demonstrably helped: by role, or all where an event has no items, or the resolved one."""
    none = F.array().cast("array<string>")
    roles = F.transform(F.filter(p["items"], lambda i: i["role"].isin(*CREDITED)), lambda i: i["memory_id"])
    named = F.when(F.coalesce(F.size(p["items"]), F.lit(0)) > 0, roles).otherwise(F.coalesce(p["memory_ids"], none))
    return F.when(F.col("kind") == "memory_attributed", named).when(F.col("kind") == "memory_resolved", F.array(p["memory_id"])).otherwise(none)


def facts(events: DataFrame) -> DataFrame:
    """One row a run of ``events`` (run_id, seq, kind, payload JSON): what its trace says, first events first.

    (run_id, at, included, diagnosed, passed, root, cited, exposed, resolved, attributed, credited,
    produced): ``produced`` holds (skill, evidence_ids) of tool calls that were not blocked.
    """
    p = F.col("p")
    rows = events.withColumn("p", F.from_json("payload", PAYLOAD))
    first = lambda kind, value: F.min_by(F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, F.col("seq")))
    # The events of one run are few: its lists stay small.
    many = lambda c: _strings(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.size(c) > 0, F.struct("seq", c.alias("v"))))), lambda x: x["v"])))
    tool = (F.col("kind") == "tool_called") & ~F.coalesce(p["blocked"], F.lit(False))
    none = F.array().cast("array<string>")
    return rows.groupBy("run_id").agg(
        F.min("seq").alias("at"), F.coalesce(_strings(first("context_compiled", p["included_memory_ids"])), none).alias("included"), F.max(F.col("kind") == "diagnosis_completed").alias("diagnosed"),
        F.coalesce(first("verifier_result", p["passed"]), F.lit(False)).alias("passed"), F.coalesce(first("diagnosis_completed", p["root_cause_key"]), F.lit("")).alias("root"),
        F.coalesce(_strings(F.transform(first("diagnosis_completed", p["evidence"]), lambda e: e["evidence_id"])), none).alias("cited"), F.coalesce(_strings(first("skills_exposed", p["skills"])), none).alias("exposed"),
        F.max(F.col("kind") == "memory_resolved").alias("resolved"), many(attributed(p)).alias("attributed"), many(credited(p)).alias("credited"),
        F.collect_list(F.when(tool, F.struct(p["skill"].alias("skill"), F.coalesce(p["evidence_ids"], none).alias("evidence_ids")))).alias("produced"),
    )


def learn(state: dict[str, DataFrame], events: DataFrame, cases: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """The next generation of ``state`` (TABLES) after the runs of ``events`` it has not seen.

    ``cases`` has (run_id, terms, assets), ``evidence`` (run_id, evidence_id, contradicts). Included
    active memories count an access a run. A verified run makes or reinforces its root's pattern and,
    if a skill's evidence was cited, its procedure; credits what helped; whatever its verdict, an
    attributed episodic memory whose root is contradicted by cited evidence that the run itself
    produced takes a strike, and with two runs' strikes is retired. Skills count successes and idle
    exposures and freeze once misuse prevails. Runs are taken in the order of (at, run_id).
    """
    # Read many times below: made once, where a shared folder can hold it.
    told = facts(events).join(state["runs"], "run_id", "left_anti").join(cases, "run_id", "left")
    skill_tags = lambda c: F.transform(c, lambda s: F.concat(F.lit("skill:"), s))
    won = F.array_distinct(F.transform(F.filter("produced", lambda x: x["skill"].isNotNull() & F.arrays_overlap(x["evidence_ids"], F.col("cited"))), lambda x: x["skill"]))
    runs = settle(told.withColumn("winning", won).withColumn("verified", F.col("diagnosed") & F.col("passed") & (F.col("root") != "")))
    held = state["memories"]
    marks = state["marks"]
    live = held.where("NOT quarantined").select("memory_id")
    access = runs.select("run_id", F.explode("included").alias("memory_id")).join(live, "memory_id", "left_semi").select("run_id", "memory_id", F.lit("access").alias("mark"))
    # Contradicted roots: evidence that the run produced and cited.
    made = runs.where("diagnosed").select("run_id", "cited", F.explode("produced").alias("x")).select("run_id", "cited", F.explode("x.evidence_ids").alias("evidence_id"))
    against = made.where(F.array_contains("cited", F.col("evidence_id"))).join(evidence.where("contradicts IS NOT NULL AND contradicts <> ''"), ["run_id", "evidence_id"]).select("run_id", F.col("contradicts").alias("root")).distinct()
    own_root = F.regexp_extract(F.coalesce(F.get(F.filter("tags", lambda t: t.rlike("^root:.")), F.lit(0)), F.lit("")), "^root:(.*)$", 1)
    roots = held.where("tier = 'episodic'").select("memory_id", own_root.alias("root"), "quarantined").where("root <> ''")
    named = runs.where("diagnosed").select("run_id", F.explode(F.array_intersect("included", "attributed")).alias("memory_id")).join(roots, "memory_id").join(against, ["run_id", "root"]).select("run_id", "memory_id", "quarantined")
    strikes = named.where("NOT quarantined").select("run_id", "memory_id", F.lit("contradiction").alias("mark"))
    helped = runs.where("verified").select("run_id", F.explode(F.array_intersect("included", "credited")).alias("memory_id")).join(held.select("memory_id"), "memory_id", "left_semi").join(named, ["run_id", "memory_id"], "left_anti")
    credit = helped.select("run_id", "memory_id", F.lit("credit").alias("mark"))
    fresh = settle(access.unionByName(strikes).unionByName(credit).distinct().join(marks, ["run_id", "memory_id", "mark"], "left_anti"))
    every = marks.unionByName(fresh)
    # Patterns and procedures: the first verified run of a root makes them where the store has none. Roots are few and
    # have many runs each, so what is asked of their order are sums and extremes, which tasks begin before the shuffle.
    n = F.struct("at", "run_id")
    making = F.when(F.size("winning") > 0, n)
    good = runs.where("verified")
    since = good.groupBy("root").agg(F.min(making).alias("_first"))
    good = good.join(F.broadcast(since), "root").withColumn("_since", (n >= F.col("_first")).cast("long"))
    base = F.array_distinct(F.concat(F.coalesce(F.transform("terms", F.lower), F.array().cast("array<string>")), F.array(F.col("root"), F.concat(F.lit("root:"), "root"))))
    name = lambda p: F.concat(F.lit(p), F.col("root")).alias("memory_id")
    pattern = good.groupBy("root").agg(F.count(F.lit(1)).alias("hits"), F.min_by(base, n).alias("tags"), F.min_by("assets", n).alias("assets"), F.max_by("run_id", n).alias("last_run")).select(name("sem-"), F.lit("semantic").alias("tier"), "hits", "hits", "tags", "assets", F.array().cast("array<string>").alias("more"), "last_run")
    pattern = pattern.toDF("memory_id", "tier", "hits", "later", "tags", "assets", "more", "last_run").withColumn("later", F.col("hits") - 1)
    # The skills of a root by their first win; those of one run in its order.
    wins = good.select("root", "at", "run_id", F.posexplode("winning").alias("i", "w")).groupBy("root", "w").agg(F.min(F.struct("at", "run_id", "i")).alias("_n"))
    used = wins.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "w"))), lambda x: x["w"]).alias("more"))
    procedure = good.groupBy("root").agg(
        F.count(F.lit(1)).alias("hits"), F.coalesce(F.sum("_since"), F.lit(0)).alias("since"), F.min_by(base, making).alias("tags"), F.min_by("assets", making).alias("assets"), F.max_by("run_id", n).alias("last_run")
    ).join(used, "root", "left").withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    procedure = procedure.select(name("proc-"), F.lit("procedural").alias("tier"), "hits", (F.col("since") - 1).alias("later"), "tags", "assets", skill_tags(F.col("more")).alias("more"), "last_run")
    told = pattern.unionByName(procedure)
    credits = fresh.groupBy("memory_id").agg(F.count_if(F.col("mark") == "access").alias("a"), F.count_if(F.col("mark") == "credit").alias("c"))
    # A retirement needs the strikes of all runs so far.
    struck = every.where("mark = 'contradiction'").groupBy("memory_id").agg(F.countDistinct("run_id").alias("x"))
    up = told.withColumnsRenamed({"tags": "_t", "tier": "_tier", "last_run": "_run"}).drop("assets")
    rows = held.join(up, "memory_id", "left").join(credits, "memory_id", "left").join(struck, "memory_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    gain = n("hits") * F.when(F.col("tier") == "procedural", REUSED).otherwise(AGAIN) + n("c") * CREDIT
    gone = F.col("quarantined") | ((F.col("tier") == "episodic") & (n("x") >= STRIKES))
    changed = rows.select(
        "memory_id", "tier", F.when(gone & ~F.col("quarantined"), F.array_append("tags", F.lit("quarantine:repeated_explicit_contradiction"))).otherwise(F.array_union("tags", F.coalesce("more", F.array().cast("array<string>")))).alias("tags"), "asset_ids",
        F.when(gain > 0, F.least(F.lit(CAP), F.col("confidence") + gain)).otherwise(F.col("confidence")).alias("confidence"), (F.col("importance") + n("hits") + n("c") * WORTH).alias("importance"),
        F.when(gain > 0, 1.0).otherwise(F.col("strength")).alias("strength"), (F.col("access_count") + n("a")).alias("access_count"), gone.alias("quarantined"), F.coalesce("_run", "last_run").alias("last_run"),
    )
    new = told.where("tags IS NOT NULL").join(held.select("memory_id"), "memory_id", "left_anti")
    step, first = F.when(F.col("tier") == "procedural", REUSED).otherwise(AGAIN), F.when(F.col("tier") == "procedural", PROCEDURE).otherwise(PATTERN)
    added = new.select(
        "memory_id", "tier", F.array_union("tags", "more").alias("tags"), F.coalesce("assets", F.array().cast("array<string>")).alias("asset_ids"), F.least(F.lit(CAP), first + step * F.col("later")).alias("confidence"), F.col("later").cast("double").alias("importance"),
        F.lit(1.0).alias("strength"), F.lit(0).cast("long").alias("access_count"), F.lit(False).alias("quarantined"), "last_run",
    )
    return {"memories": changed.unionByName(added), "skills": _skills(state["skills"], runs.where("diagnosed")), "marks": every, "runs": state["runs"].unionByName(runs.select("run_id"))}


def _skills(skills: DataFrame, runs: DataFrame) -> DataFrame:
    """``skills`` after the runs: a verified run's winners succeed, exposed ones that produced nothing are misused."""
    gave = F.transform(F.filter("produced", lambda x: F.size(x["evidence_ids"]) > 0), lambda x: x["skill"])
    wins = runs.where("passed").select("at", "run_id", F.explode("winning").alias("skill"), F.lit(1).alias("s"), F.lit(0).alias("m"))
    lazy = runs.select("at", "run_id", F.explode(F.array_except("exposed", gave)).alias("skill"), F.lit(0).alias("s"), F.lit(1).alias("m"))
    moves = wins.unionByName(lazy).groupBy("skill", "at", "run_id").agg(F.max("s").alias("s"), F.when(F.max("s") == 0, F.max("m")).otherwise(0).alias("m"))
    so_far = Window.partitionBy("skill").orderBy("at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    met = moves.join(skills, "skill").withColumn("S", F.col("success") + F.sum("s").over(so_far)).withColumn("M", F.col("misuse") + F.sum("m").over(so_far))
    froze = (F.col("S") + F.col("M") >= FREEZE_AFTER) & (F.col("M") / (F.col("S") + F.col("M")) > MISUSED)
    after = met.groupBy("skill").agg(F.max("S").alias("_s"), F.max("M").alias("_m"), F.max(froze).alias("_f"))
    return skills.join(after, "skill", "left").select("skill", F.coalesce("_s", "success").alias("success"), F.coalesce("_m", "misuse").alias("misuse"), (F.col("frozen") | F.coalesce("_f", F.lit(False))).alias("frozen"))


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def writer(root: str, cases: DataFrame, evidence: DataFrame, start: dict[str, DataFrame] | None = None, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer of trace events: each batch makes the next generation under ``root``.

    Runs must end within a batch (a source file a run, or a trigger a closed hour). Replayed batches
    hold no run that is new and make no generation.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = generations.numbers(spark, root)
        state = generations.load(spark, root) if known else (start or empty(spark))
        if known and batch.join(state["runs"], "run_id", "left_anti").isEmpty():
            return
        generations.save(learn(state, batch, cases, evidence), root, {"batch": number}, keep)

    return write
