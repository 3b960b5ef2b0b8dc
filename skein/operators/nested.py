"""Values of any depth: nested JSON held as VARIANT, taken apart level by level.

Each level is one explode of the containers of the level before, so no depth is given beforehand;
the loop ends with the level that holds no container. Children are listed within their row, in the
order of keys, so no level is shuffled. A node's ``path`` lists its steps from the root: the key in
an object, the place in an array. Paths sort as a depth-first walk that takes objects by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import settle

_STEP = "array<struct<place: int, key: string>>"
# Names whose values are not shown, and the bounds of a summary.
SECRET_NAMES = r"(?i)(^|_)(password|passwd|secret|api_?key|access_?token|refresh_?token|authorization)($|_)"
MAX_DEPTH, MAX_ITEMS, MAX_STRING = 4, 24, 512


LEVELS = 4  # levels of a value that one pass takes apart


def members(v: Column) -> Column:
    """An object as a map, null where it is none."""
    return v.try_cast("map<string, variant>")


def children(v: Column) -> Column:
    """The children (key, value) of a container, an object's in the order of keys, whatever order they are stored in; null for any other value."""
    by_key = F.array_sort(F.map_entries(members(v)), lambda x, y: F.when(x["key"] < y["key"], -1).otherwise(1))
    own = F.transform(by_key, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return F.coalesce(own, F.transform(v.try_cast("array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind(value: Column) -> Column:
    """The schema is asked of leaves only: a container's goes through all it holds."""
    boxed = F.when(members(value).isNotNull(), "object").when(value.try_cast("array<variant>").isNotNull(), "array")
    shape = F.when(boxed.isNotNull(), boxed).when(value.isNull() | F.is_variant_null(value), "null")
    return F.coalesce(shape, F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)))


def nodes(rows: DataFrame, value: str, *keep: str, max_depth: int | None = None, hidden: Column | None = None) -> DataFrame:
    """(keep..., path, depth, key, place, size, kind, leaf): every node of each row's JSON text, the root included.

    ``key`` is null at the root and in arrays, ``place`` counts siblings from 0 (objects by key),
    ``size`` is a container's number of children, ``leaf`` the text of any other value. Rows whose
    text is null or no JSON have no nodes. Nodes at ``max_depth`` and, where ``hidden`` (a condition
    on ``key``) holds, their values are not gone into.
    """
    level = rows.select(*keep, F.try_parse_json(value).alias("_v")).where("_v IS NOT NULL")
    level = level.select(*keep, F.array().cast(_STEP).alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("place"), "_v")
    out = None
    while True:
        level = settle(level.withColumn("kind", kind(F.col("_v"))))
        boxed = F.col("kind").isin("object", "array")
        child = level.where(boxed).withColumn("_in", F.col("kind"))
        if max_depth is not None:
            child = child.where(F.col("depth") < max_depth)
        if hidden is not None:
            child = child.where(~F.coalesce(hidden, F.lit(False)))
        placed = child.select(*keep, "path", "depth", "_in", F.posexplode(children(F.col("_v"))).alias("_at", "_x"))
        step = F.struct(F.when(F.col("_in") == "array", F.col("_at")).alias("place"), F.col("_x.key").alias("key"))
        below = placed.select(*keep, F.array_append("path", step).alias("path"), (F.col("depth") + 1).alias("depth"), F.col("_x.key").alias("key"), F.col("_at").alias("place"), F.col("_x.value").alias("_v"))
        leaf = F.when(~boxed & (F.col("kind") != "null"), F.col("_v").try_cast("string"))
        told = level.select(*keep, "path", "depth", "key", "place", "kind", leaf.alias("leaf"))
        out = told if out is None else out.unionByName(told)
        level = below
        if child.isEmpty():
            return out


def _said(v: Column, levels: int) -> Column:
    """The words (w) of a value in the order of a walk; what lies ``levels`` deep is left as it is (v)."""
    word = F.when(v.isNull() | F.is_variant_null(v), "None").when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(v.try_cast("string"))).otherwise(v.try_cast("string"))
    item = lambda w, x: F.struct(w.cast("string").alias("w"), x.cast("variant").alias("v"))
    nothing = F.lit(None)
    if not levels:
        boxed = members(v).isNotNull() | v.try_cast("array<variant>").isNotNull()
        return F.when(boxed, F.array(item(nothing, v))).otherwise(F.array(item(word, nothing)))

    def inner(child: Column) -> Column:
        below = let(child["value"], lambda x: _said(x, levels - 1))
        return F.concat(F.filter(F.array(item(child["key"], nothing)), lambda x: x["w"].isNotNull()), below)

    return let(children(v), lambda c: F.when(c.isNull(), F.array(item(word, nothing))).otherwise(F.flatten(F.transform(c, inner))))


def text(rows: DataFrame, value: str, key: str) -> DataFrame:
    """(key, text): each value as words in the order of a walk: an object's keys before their values, no punctuation.

    Values are read as plain text, true, false and null as True, False and None. A pass takes ``LEVELS`` levels apart
    within each row; the loop ends with the pass that leaves no container.
    """
    open_ = F.exists("_l", lambda x: x["v"].isNotNull())
    rows = rows.select(key, F.try_parse_json(value).alias("_v")).where("_v IS NOT NULL").select(key, _said(F.col("_v"), LEVELS).alias("_l"))
    out = None
    while True:
        rows = settle(rows)
        told = rows.where(~open_).select(key, F.array_join(F.transform("_l", lambda x: x["w"]), " ").alias("text"))
        out = told if out is None else out.unionByName(told)
        rest = rows.where(open_)
        if rest.isEmpty():
            return out
        rows = rest.select(key, F.flatten(F.transform("_l", lambda x: F.when(x["v"].isNull(), F.array(x)).otherwise(_said(x["v"], LEVELS)))).alias("_l"))


def norm(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def holders(rows: DataFrame, value: str, key: str, asked: DataFrame) -> DataFrame:
    """(query_id, key): the rows any of whose values, at any depth, equals the asked ``entity`` but for case and outer spaces."""
    said = F.when(F.col("kind") == "null", "none").otherwise(norm(F.col("leaf")))
    leaves = nodes(rows, value, key).where("kind NOT IN ('object', 'array')").select(key, said.alias("_e")).distinct()
    return leaves.join(asked.select("query_id", norm(F.col("entity")).alias("_e")), "_e").select("query_id", key).distinct()


def entity_records(records: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, record_id, via): the records of an entity, ``direct`` ones before those that hold it in their ``attrs``.

    ``records`` has record_id, entity and attrs (JSON text), ``asked`` query_id and entity; a record
    found both ways is told once, as direct.
    """
    direct = records.select("record_id", norm(F.col("entity")).alias("_e")).join(asked.select("query_id", norm(F.col("entity")).alias("_e")), "_e").select("query_id", "record_id", F.lit(0).alias("_o"))
    held = holders(records, "attrs", "record_id", asked).withColumn("_o", F.lit(1))
    best = direct.unionByName(held).groupBy("query_id", "record_id").agg(F.min("_o").alias("_o"))
    return best.select("query_id", "record_id", F.when(F.col("_o") == 0, "direct").otherwise("attribute").alias("via"))


def _quoted(c: Column) -> Column:
    """A string as JSON writes it."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def summaries(rows: DataFrame, value: str, key: str, max_depth: int = MAX_DEPTH, max_items: int = MAX_ITEMS, max_string: int = MAX_STRING) -> DataFrame:
    """(key, summary): each value as JSON of bounded size, secrets left out.

    Values of telling names read ``[redacted]``, containers at ``max_depth`` ``[depth-limited]``; a
    long string keeps ``max_string`` characters and says how many went, a container ``max_items``
    children (objects by key) and a last one that counts the others. All within its row.
    """

    def shown(v: Column) -> Column:
        said = v.try_cast("string")
        rest = F.length(said) - max_string
        words = F.when(rest > 0, _quoted(F.concat(F.substring(said, 1, max_string), F.lit("…[truncated "), rest, F.lit(" chars]")))).otherwise(_quoted(said))
        return F.when(v.isNull() | F.is_variant_null(v), "null").when(F.schema_of_variant(v) == "STRING", words).otherwise(said)

    def made(v: Column, depth: int) -> Column:
        if depth >= max_depth:
            return F.lit('"[depth-limited]"')

        def entry(child: Column) -> Column:
            below = F.when(F.coalesce(child["key"].rlike(SECRET_NAMES), F.lit(False)), '"[redacted]"').otherwise(let(child["value"], lambda x: made(x, depth + 1)))
            return F.concat(F.when(child["key"].isNull(), "").otherwise(F.concat(_quoted(child["key"]), F.lit(":"))), below)

        def box(c: Column) -> Column:
            over = F.size(c["l"]) - max_items
            last = F.when(over <= 0, F.array().cast("array<string>")).when(c["object"], F.array(F.concat(F.lit('"_truncated_items":'), over))).otherwise(F.array(F.concat(F.lit('"[truncated '), over, F.lit(' items]"'))))
            inner = F.array_join(F.concat(F.transform(F.slice(c["l"], 1, max(max_items, 0)), entry), last), ",")
            whole = F.concat(F.when(c["object"], "{").otherwise("["), inner, F.when(c["object"], "}").otherwise("]"))
            return F.when(c["l"].isNull(), shown(v)).otherwise(whole)

        return let(F.struct(members(v).isNotNull().alias("object"), children(v).alias("l")), box)

    return rows.select(key, F.try_parse_json(value).alias("_v")).where("_v IS NOT NULL").select(key, made(F.col("_v"), 0).alias("summary"))
