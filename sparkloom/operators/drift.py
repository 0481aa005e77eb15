"""Schemas that drift between files: one consistent table and a log of every change.

1. The header schema of every file is read in parallel: which fields its calls of a tool have and of
   which types.
2. Header schemas are folded through a type-promotion lattice into one union schema per tool.
3. All files are cast to the union schema, with other names of an argument under one name.
4. Each file's schema is compared with the client's last earlier one of the tool, and the
   differences are logged in order.

A change tells a rename by itself: a field is gone, another one has come, and their values look alike;
of several such the ones in the same order in the record, whatever their types. What all files say
only refutes: names that stand together in a file are two arguments. So the log of a client doesn't
wait for other clients, and no list of names is built in.

Defined cases: a field whose values are all null in a file has no type there and is not retyped;
values of several types in one file are promoted by the lattice; calls whose JSON is broken or whose
argument object is missing keep their row with no arguments; files of equal ``written_at`` are
ordered by name; calls delivered again count once; null clients, tools and file names are groups of
their own; of a repeated key in an object the last value counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.variants import last_of_repeated_keys
from sparkloom.session import cut, stored

#: Keys of a call that hold its argument object (fixed values).
OBJECT_KEYS = ("arguments", "input")
#: Share of the files two names would share by chance up to which they count as never standing together.
TOGETHER = 0.01

FILE = ("client", "file_name", "tool")
CALL = ("call_id", "client", "file_name", "row_no", "written_at", "called_at", "tool")


# --- the lattice -------------------------------------------------------------------------------


def parse_type(text: str) -> object:
    """A type as the engine shows that of a variant: a name, ``["array", type]`` or a dict of fields."""
    stack: list = [[]]
    field: list[str] = []
    at = 0
    while at < len(text):
        if text.startswith("OBJECT<", at):
            stack.append({})
            at += 7
            if text[at] != ">":
                at = _field(text, at, field)
            continue
        if text.startswith("ARRAY<", at):
            stack.append(["array"])
            at += 6
            continue
        if text[at] == ">":
            done = stack.pop()
            at += 1
        elif text.startswith(", ", at):
            at = _field(text, at + 2, field)
            continue
        else:
            end = at
            depth = 0
            while end < len(text) and (depth or text[end] not in ",>"):
                depth += (text[end] == "(") - (text[end] == ")")
                end += 1
            done, at = text[at:end], end
        if isinstance(stack[-1], dict):
            stack[-1][field.pop()] = done
        else:
            stack[-1].append(done)
    return stack[0][0]


def _field(text: str, at: int, field: list[str]) -> int:
    """Read the name of a field, quoted or not, up to the type behind it."""
    if text[at] == "`":
        end = at + 1
        while text[end] != "`" or text[end + 1 : end + 2] == "`":
            end += 2 if text[end] == "`" else 1
        field.append(text[at + 1 : end].replace("``", "`"))
        return end + 3
    end = text.index(": ", at)
    field.append(text[at:end])
    return end + 2


def kind_of(shown: object) -> str | None:
    """Place of a type in the lattice: null, boolean, integer, number, string, array or object."""
    if isinstance(shown, dict):
        return "object"
    if isinstance(shown, list):
        return "array"
    name = shown.partition("(")[0]
    return {"VOID": None, "BOOLEAN": "boolean", "BIGINT": "integer", "STRING": "string"}.get(name, "number")


def joined(a: object, b: object) -> object:
    """Least type that holds two: null lies below all, integer below number; arrays join by their elements
    and objects by their fields; any other two meet in string, which holds them as JSON text."""
    x, y = kind_of(a), kind_of(b)
    if x is None or y is None:
        return b if x is None else a
    if x == y == "array":
        return ["array", joined(a[1], b[1])]
    if x == y == "object":
        return {name: joined(a.get(name, "VOID"), b.get(name, "VOID")) for name in sorted({*a, *b})}
    if x == y:
        return a if x != "number" else "DOUBLE"
    return "DOUBLE" if {x, y} == {"integer", "number"} else "STRING"


def column_type(shown: object) -> str:
    """Column type that a type of the lattice is cast to; an empty object keeps its JSON text."""
    k = kind_of(shown)
    if k == "array":
        return f"array<{column_type(shown[1])}>"
    if k == "object" and shown and all(shown):
        names = {}
        for name in shown:
            names.setdefault(name.lower(), name)
        if len(names) == len(shown):
            return "struct<" + ",".join(f"`{n.replace('`', '``')}`:{column_type(t)}" for n, t in shown.items()) + ">"
    return {"boolean": "boolean", "integer": "bigint", "number": "double"}.get(k, "string")


FOLDED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("column_type", T.StringType())])


def folded(types: Column) -> Column:
    """Kind and column type of the join of an array of shown types."""

    @F.arrow_udf(FOLDED)
    def fold(batch: pa.Array) -> pa.Array:
        kinds, columns = [], []
        for shown in batch.to_pylist():
            whole: object = "VOID"
            for one in sorted(shown or ()):
                whole = joined(whole, parse_type(one))
            kinds.append(kind_of(whole))
            columns.append(column_type(whole))
        return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(columns, pa.string())], [f.name for f in FOLDED])

    return fold(types)


def json_kind(shown: Column) -> Column:
    """JSON type of a type as shown; null for null."""
    return (
        F.when(shown.isNull() | (shown == "VOID"), None)
        .when(shown == "STRING", "string")
        .when(shown == "BOOLEAN", "boolean")
        .when(shown.startswith("ARRAY"), "array")
        .when(shown.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def promoted(kinds: Column) -> Column:
    """Join of an array of JSON types: null lies below all, any two others meet in string."""
    distinct = F.array_distinct(F.filter(kinds, lambda k: k.isNotNull()))
    return F.when(F.size(distinct) == 0, None).when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).otherwise("string")


# --- header schemas ----------------------------------------------------------------------------


def read_calls(calls: DataFrame, once: bool = True) -> DataFrame:
    """Calls with ``object_key``, ``object_kind`` and ``args`` (map of name to variant); distinct ones if ``once``."""
    last_of_repeated_keys(calls.sparkSession)
    rows = calls.select(*CALL, "call_json")
    if once:
        rows = rows.withColumn("_hash", F.xxhash64("call_json")).dropDuplicates([*CALL, "_hash"]).drop("_hash")
    call = rows.withColumn("call", F.try_parse_json("call_json"))

    def member(key: str) -> Column:
        return F.try_variant_get("call", f"$.{key}", "variant")

    held = call.withColumns({f"_{k}": member(k) for k in OBJECT_KEYS})
    shown = F.coalesce(*(F.schema_of_variant(f"_{k}") for k in OBJECT_KEYS))
    held = held.withColumns({"object_key": F.coalesce(*[F.when(F.col(f"_{k}").isNotNull(), F.lit(k)) for k in OBJECT_KEYS]), "_shown": shown})
    kind = held.withColumn("object", F.coalesce(*(F.col(f"_{k}") for k in OBJECT_KEYS))).withColumn("object_kind", json_kind(F.col("_shown")))
    written = F.try_parse_json(F.try_variant_get("object", "$", "string"))
    read = kind.withColumn("object", F.when(F.col("object_kind") == "string", written).otherwise(F.col("object")))
    args = F.when(F.col("object_kind").isin("string", "object"), F.try_variant_get("object", "$", "map<string,variant>"))
    return read.withColumn("args", args).drop("call", "object", "_shown", *(f"_{k}" for k in OBJECT_KEYS))


def _form(shown: Column, first: Column) -> Column:
    """How a value looks, whatever its type: the first element stands for an array."""
    return (
        F.when(first.isNull(), None)
        .when(shown.startswith("OBJECT"), "object")
        .when(first.rlike(r"^-?\d+(\.\d+)?$"), "number")
        .when(first.rlike(r"(?i)^(true|false)$"), "truth")
        .when(first.rlike(r"\s"), "words")
        .when(first.startswith("/"), "absolute path")
        .when(first.contains("/"), "path")
        .otherwise("token")
    )


def call_fields(read: DataFrame) -> DataFrame:
    """One row per call and field: ``level`` 0 for the argument object itself, 1 for its keys; its type as
    ``shown``, how its value looks (``form``) and ``at``, where its name stands in the call's text."""
    whole = F.array(F.struct(F.lit(0).alias("level"), F.col("object_key").alias("field"), F.col("object_kind").alias("shown"), F.lit(None).cast("string").alias("first"), F.lit(0).alias("at")))

    def first(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.try_variant_get(v, "$", "string"))

    keys = F.transform(
        F.map_entries("args"),
        lambda e: F.struct(
            F.lit(1).alias("level"), e["key"].alias("field"), F.schema_of_variant(e["value"]).alias("shown"), first(e["value"]).alias("first"),
            F.call_function("locate", F.concat(e["key"], F.lit('"')), F.col("call_json")).alias("at"),
        ),
    )
    rows = read.filter(F.col("object_key").isNotNull()).select(*FILE, "written_at", F.explode(F.concat(whole, F.coalesce(keys, F.array()))).alias("f"))
    rows = rows.select(*FILE, "written_at", "f.level", "f.field", "f.shown", "f.first", "f.at")
    return rows.select(*FILE, "written_at", "level", "field", "shown", _form(F.col("shown"), F.col("first")).alias("form"), "at")


def header_schemas(fields: DataFrame) -> DataFrame:
    """One row per file, tool and field: its JSON type there (``kind``), the types ``shown``, how its values
    look, how many calls have it and where it stands."""
    by_shown = fields.groupBy(*FILE, "written_at", "level", "field", "shown", "form").agg(F.count("*").alias("n"), F.avg("at").alias("at"))
    kinds = F.when(F.col("level") == 0, F.col("shown")).otherwise(json_kind(F.col("shown")))
    return by_shown.withColumn("kind", kinds).groupBy(*FILE, "written_at", "level", "field").agg(
        promoted(F.collect_set("kind")).alias("kind"), F.collect_set("shown").alias("shown"),
        F.max_by("form", F.struct(F.when(F.col("form").isNotNull(), F.col("n")), "form")).alias("form"), F.array_sort(F.collect_set("form")).alias("forms"),
        F.sum("n").alias("n_calls"), F.min("at").alias("at"),
    )


def read_headers(calls: DataFrame) -> DataFrame:
    """Header schemas of all files of ``calls``, written to the shared folder: they are small beside the calls,
    and all that follows reads them several times. A call delivered again adds nothing to a schema."""
    return stored(header_schemas(call_fields(read_calls(calls, once=False))))


def file_schemas(headers: DataFrame) -> DataFrame:
    """One row per file and tool: ``schema`` and the one before it (``earlier``, null for a tool's first
    file), each an array of (level, field, kind, forms, at)."""
    schema = F.array_sort(F.collect_list(F.struct("level", "field", "kind", "forms", "at")))
    files = headers.groupBy(*FILE, "written_at").agg(schema.alias("schema"))
    return files.withColumn("earlier", F.lag("schema").over(Window.partitionBy("client", "tool").orderBy("written_at", "file_name")))


# --- renames -----------------------------------------------------------------------------------


def _keys(schema: str) -> Column:
    return F.filter(schema, lambda f: f["level"] == 1)


def _names(schema: str) -> Column:
    return F.transform(_keys(schema), lambda f: f["field"])


def _change_of(schemas: DataFrame) -> DataFrame:
    """Changes: ``gone`` and ``new`` names, and with their forms in the order they stand in."""
    gone, new = F.array_except(_names("earlier"), _names("schema")), F.array_except(_names("schema"), _names("earlier"))

    def standing(schema: str, names: str) -> Column:
        kept = F.filter(_keys(schema), lambda f: F.array_contains(F.col(names), f["field"]))
        return F.array_sort(F.transform(kept, lambda f: F.struct(f["at"].alias("at"), f["field"].alias("field"), f["forms"].alias("forms"))))

    return (
        schemas.filter(F.col("earlier").isNotNull())
        .withColumns({"gone": gone, "new": new})
        .select(
            F.to_json(F.struct("client", "file_name", "tool", "written_at"), {"ignoreNullFields": "false"}).alias("change_id"), *FILE, "schema", "earlier", "gone", "new",
            standing("earlier", "gone").alias("gone_in_order"), standing("schema", "new").alias("new_in_order"),
        )
    )


def _words(name: Column) -> Column:
    """Words a name is spelled from, without case and joints."""
    return F.lower(F.regexp_replace(name, "[_\\-\\s]", ""))


def _tool(name: str = "tool") -> Column:
    return F.coalesce(F.col(name), F.lit("\0"))


def rename_candidates(headers: DataFrame, changes: DataFrame, together: float = TOGETHER) -> DataFrame:
    """Names (``a`` gone, ``b`` new) that may be one argument in a change (``change_id``, ``tool``): their values
    look alike in the two files or mostly, or they are spelled from the same words, and no file of the tool
    has both.

    ``apart`` tells how far they are from standing in the same place among what is gone and new.
    """
    change = changes.filter((F.size("gone") > 0) & (F.size("new") > 0)).select("change_id", _tool().alias("tool"), "gone_in_order", "new_in_order")

    def placed(of: str) -> Column:
        return F.transform(of, lambda e, i: F.struct(e["field"].alias("field"), e["forms"].alias("forms"), i.alias("place")))

    gone = change.select("change_id", "tool", F.explode(placed("gone_in_order")).alias("x"), placed("new_in_order").alias("y"))
    pairs = gone.select("change_id", "tool", "x", F.explode("y").alias("y"))  # fields of one record
    pairs = pairs.withColumns({"a": F.col("x.field"), "b": F.col("y.field"), "same": _words(F.col("x.field")) == _words(F.col("y.field"))})
    mostly = headers.filter("level = 1 and form is not null").groupBy(_tool().alias("tool"), "field", "form").agg(F.sum("n_calls").alias("n"))
    mostly = mostly.groupBy("tool", "field").agg(F.max_by("form", F.struct("n", "form")).alias("form"))
    looks = pairs.join(mostly.toDF("tool", "a", "look_a"), ["tool", "a"], "left").join(mostly.toDF("tool", "b", "look_b"), ["tool", "b"], "left")
    overlap = F.arrays_overlap(F.col("x.forms"), F.col("y.forms"))
    alike = looks.filter(F.col("same") | overlap | (F.col("look_a") == F.col("look_b"))).select(
        "change_id", "tool", "a", "b", F.struct((~F.col("same")).alias("unlike"), F.abs(F.col("x.place") - F.col("y.place")).alias("apart")).alias("apart")
    )
    asked = alike.select("tool", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
    files = headers.filter("level = 1").withColumn("tool", _tool()).groupBy("client", "file_name", "tool").agg(F.collect_set("field").alias("names"))
    of_tool = files.groupBy("tool").agg(F.count("*").alias("of"))
    usual = files.select("tool", F.explode("names").alias("field")).groupBy("tool", "field").agg(F.count("*").alias("files"))
    both = (
        files.select("tool", "names", F.explode("names").alias("p"))
        .join(asked, ["tool", "p"])
        .filter(F.array_contains(F.col("names"), F.col("q")))
        .groupBy("tool", "p", "q")
        .agg(F.count("*").alias("together"))
    )
    refuted = (
        both.join(usual.toDF("tool", "p", "files_p"), ["tool", "p"])
        .join(usual.toDF("tool", "q", "files_q"), ["tool", "q"])
        .join(of_tool, "tool")
        .filter(F.col("together") > together * F.col("files_p") * F.col("files_q") / F.col("of"))
        .select("tool", "p", "q")
    )
    kept = alike.withColumns({"p": F.least("a", "b"), "q": F.greatest("a", "b")}).join(refuted, ["tool", "p", "q"], "left_anti")
    return kept.select("change_id", F.nullif("tool", F.lit("\0")).alias("tool"), "a", "b", "apart")


def renames(candidates: DataFrame) -> DataFrame:
    """``change_id``, ``tool`` and the one name ``b`` that each ``a`` became: the nearest, ties by the alphabet."""
    first = candidates.groupBy("change_id", "tool", "a").agg(F.min(F.struct("apart", "b")).alias("best"))
    return first.groupBy("change_id", "tool", F.col("best.b").alias("b")).agg(F.min(F.struct("best.apart", "a")).alias("best")).select("change_id", "tool", F.col("best.a").alias("a"), "b")


def log_changes(change: DataFrame, renamed: DataFrame) -> DataFrame:
    """The log: ``client``, ``file_name``, ``tool``, ``old_field``, ``new_field`` and ``change``.

    ``change`` is added (no old field), removed (no new field), renamed or retyped; a field that is
    renamed and retyped has a row of each.
    """
    renamed = renamed.groupBy("change_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("renamed"))

    def whole(schema: str) -> Column:
        return F.get(F.filter(schema, lambda f: f["level"] == 0), F.lit(0))

    def typed(schema: str) -> Column:
        return F.map_from_entries(F.transform(F.filter(schema, lambda f: f["level"] == 1), lambda f: F.struct(f["field"], f["kind"])))

    none = F.create_map().cast("map<string,string>")
    rows = (
        change.join(renamed, "change_id", "left")
        .withColumn("renamed", F.coalesce("renamed", none))
        .withColumn("old_kinds", typed("earlier"))
        .withColumn("new_kinds", typed("schema"))
        .withColumn("old_whole", whole("earlier"))
        .withColumn("new_whole", whole("schema"))
    )

    def row(old: Column, new: Column, kind: str) -> Column:
        return F.struct(old.alias("old_field"), new.alias("new_field"), F.lit(kind).alias("change"))

    empty = F.lit("")
    stayed = F.array_intersect(F.map_keys("old_kinds"), F.map_keys("new_kinds"))
    pairs = F.concat(
        F.transform(stayed, lambda f: F.struct(f.alias("a"), f.alias("b"))),
        F.transform(F.map_entries("renamed"), lambda e: F.struct(e["key"].alias("a"), e["value"].alias("b"))),
    )
    retyped = F.filter(pairs, lambda p: F.col("old_kinds")[p["a"]] != F.col("new_kinds")[p["b"]])
    old, new = F.col("old_whole"), F.col("new_whole")
    log = F.concat(
        F.transform(F.array_except("new", F.map_values("renamed")), lambda f: row(empty, f, "added")),
        F.transform(F.array_except("gone", F.map_keys("renamed")), lambda f: row(f, empty, "removed")),
        F.transform(F.map_entries("renamed"), lambda e: row(e["key"], e["value"], "renamed")),
        F.transform(retyped, lambda p: row(p["a"], p["b"], "retyped")),
        F.filter(F.array(F.when(old["field"] != new["field"], row(old["field"], new["field"], "renamed"))), lambda r: r.isNotNull()),
        F.filter(F.array(F.when(old["kind"] != new["kind"], row(old["field"], new["field"], "retyped"))), lambda r: r.isNotNull()),
    )
    return rows.select(*FILE, F.explode(log).alias("r")).select(*FILE, "r.*")


def _log_of(calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    headers = read_headers(calls)
    change = stored(_change_of(file_schemas(headers)))
    return headers, change, renames(rename_candidates(headers, change))


def drift_log(calls: DataFrame) -> DataFrame:
    """Every change of the argument objects of ``calls``, by :func:`log_changes`."""
    _, change, renamed = _log_of(calls)
    return log_changes(change, renamed)


# --- the union schema --------------------------------------------------------------------------


def argument_names(headers: DataFrame, renamed: DataFrame) -> DataFrame:
    """``tool``, ``field`` and the one name (``argument``) under which all its names are kept: the one in most
    files of a field and those it was renamed to or from, however indirectly; ties by the alphabet.
    """
    keys = headers.filter("level = 1").withColumn("tool", _tool()).groupBy("tool", "field").agg(F.count("*").alias("n"))
    names = renamed.select(_tool().alias("tool"), "a", "b")
    same = keys.select("tool", F.col("field").alias("a"), F.col("field").alias("b"))
    links = stored(same.unionByName(names).unionByName(names.select("tool", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(keys.select("tool", "field", F.struct((-F.col("n")).alias("n"), F.col("field").alias("name")).alias("best")))
    while True:
        near = links.join(labels.withColumnRenamed("field", "b"), ["tool", "b"])
        best = near.groupBy("tool", F.col("a").alias("field")).agg(F.min("best").alias("best"))
        # pointers are doubled: a name takes over what its label's own name has found
        further = best.select("tool", F.col("field").alias("via"), F.col("best").alias("far"))
        doubled = cut(
            best.withColumn("via", F.col("best.name")).join(further, ["tool", "via"], "left").select("tool", "field", F.least("best", F.coalesce("far", "best")).alias("best"))
        )
        if doubled.join(labels, ["tool", "field", "best"], "left_anti").isEmpty():
            break
        labels = doubled
    return doubled.select(F.nullif("tool", F.lit("\0")).alias("tool"), "field", F.col("best.name").alias("argument"))


def _union(headers: DataFrame, names: DataFrame) -> DataFrame:
    keys = headers.filter("level = 1").join(names.toDF("t", "f", "argument"), F.col("tool").eqNullSafe(F.col("t")) & (F.col("field") == F.col("f")))
    schema = keys.groupBy("tool", "argument").agg(
        F.array_distinct(F.flatten(F.collect_set("shown"))).alias("shown"), F.array_sort(F.collect_set("field")).alias("names"), F.count_distinct("client", "file_name").alias("n_files")
    )
    return schema.withColumn("folded", folded(F.col("shown"))).select("tool", "argument", "folded.kind", "folded.column_type", "names", "n_files", "shown")


def union_schema(calls: DataFrame) -> DataFrame:
    """The folded schema: ``tool``, ``argument``, its ``kind`` and ``column_type``, ``names`` and ``n_files``."""
    headers, _, renamed = _log_of(calls)
    return _union(headers, argument_names(headers, renamed)).drop("shown")


def unified_calls(calls: DataFrame) -> DataFrame:
    """The consistent table: one row per call, with ``args``, a struct of one typed column per argument of any
    tool, and ``more``, a map of what stood beside an argument under another of its names.

    Types are those of the lattice over all files; null values and absent arguments are null. A value of
    type string is its own text, or the JSON text of any other value. The schema of the result is the
    union schema itself, so that (one row per argument, no data) is brought to the driver.
    """
    headers, _, renamed = _log_of(calls)
    names = stored(argument_names(headers, renamed))
    by_tool = names.groupBy("tool").agg(F.map_from_entries(F.collect_list(F.struct("field", "argument"))).alias("names"))
    arguments = _union(headers, names).groupBy("argument").agg(folded(F.array_distinct(F.flatten(F.collect_set("shown")))).alias("t"))
    types = {r.argument: r.column_type for r in arguments.select("argument", "t.column_type").orderBy("argument").collect()}
    called = read_calls(calls).join(by_tool.withColumnRenamed("tool", "t"), F.col("tool").eqNullSafe(F.col("t")), "left")
    entries = F.array_sort(
        F.transform(
            F.filter(F.map_entries("args"), lambda e: F.schema_of_variant(e["value"]) != "VOID"),
            lambda e: F.struct(F.coalesce(F.col("names")[e["key"]], e["key"]).alias("argument"), e["key"].alias("name")),
        ),
        lambda x, y: F.when(x["argument"] < y["argument"], -1).when(x["argument"] > y["argument"], 1).when(x["name"] < y["name"], -1).otherwise(1),
    )
    named = called.withColumn("entries", entries)
    first = F.filter("entries", lambda e, i: (i == 0) | (F.get("entries", i - 1)["argument"] != e["argument"]))
    others = F.filter("entries", lambda e, i: (i > 0) & (F.get("entries", i - 1)["argument"] == e["argument"]))
    of_argument = F.map_from_entries(F.transform(first, lambda e: F.struct(e["argument"], F.col("args")[e["name"]])))
    more = F.map_from_entries(F.transform(others, lambda e: F.struct(e["name"], F.try_variant_get(F.col("args")[e["name"]], "$", "string"))))
    placed = named.withColumns({"_by_argument": of_argument, "more": more})
    columns = [F.try_variant_get(F.col("_by_argument")[F.lit(name)], "$", kind).alias(name) for name, kind in types.items()]
    args = F.struct(*columns) if columns else F.lit(None).cast("struct<>")
    none = F.create_map().cast("map<string,string>")
    return placed.select(*CALL, args.alias("args"), F.coalesce("more", none).alias("more"))
