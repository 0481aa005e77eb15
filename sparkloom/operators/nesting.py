"""Deeply nested records as flat tables with parent-child links, by shared inlining.

The schema graph of the records is analysed over all of them: its elements are the keys that hold
records, an edge says which element holds which. An element held once and by a single other one is
inlined into the table of its holder. One that is repeated (in arrays), shared (held by several
elements) or recursive (held by itself, however far below) gets one table, wherever in a record it
stands: records of any depth make one table. The rows of a table are keyed by the address of their
record and point to the record that holds them; what is inlined into a row is listed in it.

Every line is parsed once. The walk over a record keeps the addresses of its holders, so foreign keys
need no join; only the graph, which is as small as the schema, is joined to say where records go.

Defined cases: null is no record; an empty object is one; elements of an array are records even if
they are scalar; arrays in arrays are records, too; lone surrogates in keys become ``?``; keys with
dots are quoted in field names; of two equal field names in a row the first value by order stays;
lines that are blank or not sound have no rows; lines delivered again count once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.json_text import BROKEN, Number, clean, kind, parse_strict
from sparkloom.operators.quarantine import SESSION_TEXTS, errors_of, not_blank, session_rules, texts_of
from sparkloom.session import cut, stored

ROOT = "message"
#: Keys of a tool call that hold its arguments (fixed values).
ARGUMENT_KEYS = ("arguments", "input")
CALL = "toolCall"

RECORD = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("holders_end", T.ArrayType(T.IntegerType())),
        T.StructField("element", T.StringType()),
        T.StructField("holder", T.StringType()),
        T.StructField("repeated", T.BooleanType()),
        T.StructField("recursive", T.BooleanType()),
        T.StructField("kind", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)
_RECORD = [pa.string(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.map_(pa.string(), pa.string())]

Record = tuple[str, list[int], str, str | None, bool, bool, Any]


def _arguments(block: dict) -> dict:
    """A tool call with its argument object, also where that is written as a string, under ``args``."""
    name = next((k for k in ARGUMENT_KEYS if block.get(k) is not None), None)
    if name is None:
        return block
    value = block[name]
    if isinstance(value, str) and not isinstance(value, Number):
        read = parse_strict(value)
        value = read if isinstance(read, dict) else value
    return {("args" if k == name else k): (value if k == name else v) for k, v in block.items()}


def _scalar(value: Any) -> str | None:
    return None if value is None else clean(value) if isinstance(value, str) else "true" if value is True else "false"


def _element(key: str) -> str:
    """Name of the element of a key; that of the root is its own."""
    return f"{key}~" if key == ROOT else key


def walk(message: dict) -> Iterator[Record]:
    """The records of a message, itself first: address, where the addresses of the records that hold it
    end (back to the last element of an array), element, element of its holder, whether it is an element
    of an array and whether its element holds itself here, and its value.

    A stack takes the place of recursion.
    """
    yield "", [], ROOT, None, False, False, message
    # address, ends of holders, holder, elements above, value, and for an array the element of its elements
    stack: list[tuple] = [("", [], ROOT, frozenset({ROOT}), message, None)]
    while stack:
        node, ends, holder, above, value, name = stack.pop()
        if name is None:
            for k, v in value.items():
                address = f"{node}.{k}" if node else k
                if isinstance(v, dict):
                    own = _element(clean(k))
                    yield address, ends, own, holder, False, own in above, v
                    stack.append((address, [*ends, len(address)], own, above | {own}, v, None))
                elif isinstance(v, list):
                    stack.append((address, ends, holder, above, v, _element(clean(k))))
            continue
        for i, v in enumerate(value):
            if v is None:
                continue
            address = f"{node}[{i}]"
            if node == "content" and isinstance(v, dict) and v.get("type") == CALL:
                v = _arguments(v)
            yield address, ends, name, holder, True, name in above, v
            if isinstance(v, (dict, list)):
                # the elements of an array in an array are an element of their own
                stack.append((address, [len(address)], name, above | {name}, v, f"{name}[]" if isinstance(v, list) else None))


def _field_name(key: str) -> str:
    return json.dumps(clean(key)) if "." in key or '"' in key else clean(key)


def _fields(value: Any) -> list[tuple[str, str | None]]:
    """Scalar fields of a record; a scalar record has the single field ``value``."""
    if isinstance(value, dict):
        return list({_field_name(k): _scalar(v) for k, v in value.items() if not isinstance(v, (dict, list))}.items())
    return [] if isinstance(value, list) else [("value", _scalar(value))]


def _columns(rows: list[tuple], offsets: list[int], with_fields: bool) -> pa.Array:
    """Arrow array of the records of each line; ``offsets`` says where those of a line begin."""
    columns = list(zip(*rows)) if rows else [()] * 7
    kinds = [kind(v) for v in columns[6]]
    fields = [_fields(v) if with_fields else None for v in columns[6]]
    values = [*columns[:6], kinds, fields]
    records = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(values, _RECORD)], [f.name for f in RECORD])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), records)


def _read(line: Column, with_fields: bool) -> Column:
    """Struct ``e`` of a line's texts (see :mod:`sparkloom.operators.quarantine`) with its ``records``."""
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n, _ in SESSION_TEXTS), T.StructField("records", T.ArrayType(RECORD))])

    @F.arrow_udf(schema)
    def read(batch: pa.Array) -> pa.Array:
        texts: list[list[str | None]] = [[] for _ in SESSION_TEXTS]
        rows: list[tuple] = []
        offsets = [0]
        for text in batch.to_pylist():
            value = BROKEN if text is None else parse_strict(text)
            for column, x in zip(texts, texts_of(value, SESSION_TEXTS)):
                column.append(x)
            if isinstance(value, dict) and value.get("type") == "message" and isinstance(value.get(ROOT), dict):
                rows.extend((clean(node), *rest) for node, *rest in walk(value[ROOT]))
            offsets.append(len(rows))
        arrays = [pa.array(c, pa.string()) for c in texts]
        return pa.StructArray.from_arrays([*arrays, _columns(rows, offsets, with_fields)], [f.name for f in schema])

    return read.asNondeterministic()(line)  # so that no filter on the texts reads the line again


def read_records(lines: DataFrame, with_fields: bool = True) -> DataFrame:
    """The records of every sound session entry of type message, the message itself among them, written
    to the shared folder: what follows reads them more than once.

    Columns: ``path``, ``line_no``, ``line_hash`` and those of ``RECORD``. The records of a line that was
    delivered again are there again; all that is built from them counts them once.
    """
    kept = lines.select("path", "line_no", "line").filter(not_blank(F.col("line")))
    read = kept.withColumn("e", _read(F.col("line"), with_fields)).withColumn("errors", errors_of(session_rules()))
    sound = read.filter((F.size("errors") == 0) & (F.size("e.records") > 0))
    return stored(sound.select("path", "line_no", F.xxhash64("line").alias("line_hash"), F.explode("e.records").alias("r")).select("path", "line_no", "line_hash", "r.*"))


def _address(end: Column) -> Column:
    """Address of a holder by where it ends; that of the message where it is null."""
    return F.coalesce(F.substr(F.col("node"), F.lit(1), end), F.lit(ROOT))


def child_records(lines: DataFrame, with_fields: bool = True) -> DataFrame:
    """Every record below a message once, with ``parent``, the address of the nearest that encloses it or
    ``message``."""
    below = read_records(lines, with_fields).filter(F.col("holder").isNotNull()).dropDuplicates(["path", "line_no", "line_hash", "node"])
    return below.withColumn("parent", _address(F.try_element_at("holders_end", F.lit(-1))))


def schema_graph(records: DataFrame) -> DataFrame:
    """One row per element of the records, with its place in the tables.

    ``element``, ``holders`` (elements), ``repeated`` (in arrays), ``shared`` (several others hold it),
    ``recursive`` (it holds itself), ``own_table``; an element without a table of its own is inlined into
    ``table_name``, ``up`` levels above it.
    """
    edges = records.groupBy("element", "holder").agg(F.bool_or("repeated").alias("repeated"), F.bool_or("recursive").alias("recursive"))
    elements = cut(
        edges.groupBy("element")
        .agg(F.array_sort(F.collect_set("holder")).alias("holders"), F.bool_or("repeated").alias("repeated"), F.bool_or("recursive").alias("recursive"))
        .withColumn("shared", F.size(F.array_remove("holders", F.col("element"))) > 1)
        .withColumn("own_table", (F.col("element") == ROOT) | F.col("repeated") | F.col("shared") | F.col("recursive"))
    )
    # Pointers to holders are doubled until all end at a table; the inlined ones form trees.
    pointers = elements.filter(~F.col("own_table")).select("element", F.element_at("holders", 1).alias("at"), F.lit(1).alias("up"))
    while True:
        further = pointers.select(F.col("element").alias("at"), F.col("at").alias("then"), F.col("up").alias("more"))
        joined = cut(pointers.join(further, "at", "left"))
        pointers = joined.select("element", F.coalesce("then", "at").alias("at"), (F.col("up") + F.coalesce("more", F.lit(0))).alias("up"))
        if joined.filter("then is not null").isEmpty():
            break
    placed = elements.join(pointers.withColumnRenamed("element", "of"), F.col("element") == F.col("of"), "left")
    # written, so that its size is known where records are joined to it
    return stored(placed.select("element", "holders", "repeated", "shared", "recursive", "own_table", F.coalesce("at", "element").alias("table_name"), F.coalesce("up", F.lit(0)).alias("up")))


def _unequal(entries: Column) -> Column:
    """Entries by key, of equal keys the first."""
    in_order = F.array_sort(entries)
    return F.filter(in_order, lambda e, i: (i == 0) | (F.get(in_order, i - 1)["key"] != e["key"]))


def flat_tables(records: DataFrame, graph: DataFrame) -> DataFrame:
    """Rows of all flat tables: ``table_name``, key (``path``, ``line_no``, ``node``), foreign key
    (``parent``, null for messages), ``fields`` and ``inlined``, the (parent, node) of every record folded
    into the row.

    The fields of an inlined record are led by its address below that of the row. Write the result
    partitioned by ``table_name`` for one flat table each, or use :func:`flat_table` for one with typed
    columns.
    """
    placed = records.join(graph.select("element", "own_table", "table_name", "up"), "element")
    own = F.col("own_table")
    end = F.try_element_at("holders_end", F.when(~own, -F.col("up")))
    placed = placed.withColumns(
        {
            "_row": F.when(own, F.col("node")).otherwise(F.coalesce(F.substr(F.col("node"), F.lit(1), end), F.lit(""))),
            "_below": F.when(~own, F.substr(F.col("node"), F.coalesce(end + 2, F.lit(1)))),
            "_parent": F.when(F.col("holder").isNotNull(), _address(F.try_element_at("holders_end", F.lit(-1)))),
        }
    )
    fields = F.transform(F.map_entries("fields"), lambda e: F.struct(F.concat_ws(".", "_below", e["key"]).alias("key"), e["value"].alias("value")))
    rows = placed.select(
        "path", "line_no", "line_hash", "table_name", F.when(own, F.col("_parent")).alias("parent"), fields.alias("fields"),
        F.when(~own, F.struct(F.col("_parent").alias("parent"), F.col("node").alias("node"))).alias("inlined"), F.col("_row").alias("node"),
    )
    folded = rows.groupBy("path", "line_no", "line_hash", "table_name", "node").agg(
        F.max("parent").alias("parent"), F.collect_set("fields").alias("fields"), F.array_sort(F.collect_set("inlined")).alias("inlined")
    )
    return folded.select(
        "path", "line_no", "table_name", F.when(F.col("table_name") == ROOT, F.lit(ROOT)).otherwise(F.col("node")).alias("node"), "parent",
        F.map_from_entries(_unequal(F.flatten("fields"))).alias("fields"), "inlined",
    )


def table_links(tables: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``parent`` and ``node`` of every record below a message: the keys of the rows of
    all tables and of what is inlined into them."""
    own = F.when(F.col("parent").isNotNull(), F.array(F.struct("parent", "node")))
    links = F.concat(F.coalesce(own, F.array().cast("array<struct<parent:string,node:string>>")), "inlined")
    return tables.select("path", "line_no", F.explode(links).alias("l")).select("path", "line_no", "l.parent", "l.node")


def flat_table(tables: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """One flat table with typed columns (field name to Spark type); values that don't cast are null."""
    own = tables.filter(F.col("table_name") == name)
    return own.select("path", "line_no", "node", "parent", *[F.col("fields")[field].try_cast(kind).alias(field.replace(".", "_")) for field, kind in columns.items()])
