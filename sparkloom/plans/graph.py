"""Queries of the property graph over the star-schema tables, and their SQL.

Parts stand for symbols (a brand is a file), consecutive lines of an order for the edges between them;
region, nation, customer and supplier for nested containers. Sources are the ids divisible by 100. The
queries whose SQL reads small lines only do the same; each has a twin, ``whole_`` before its name, over all
lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import lines as text_lines
from sparkloom.functions.skew import sized
from sparkloom.operators import graph
from sparkloom.session import table

QUERY = "red plate"
BRAND = "Brand#1"
PATH_QUERY = "./Planner-5.md"
LITERAL = "planner"

Edges = Callable[[SparkSession, str], DataFrame]


def part_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols."""
    kinds = F.array(*[F.lit(k) for k in ("class", "interface", "method", "function", "field", "file")])
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" cover"))).when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    folder = F.when(F.col("p_size") % 5 == 0, "src/test/").when(F.col("p_size") % 5 == 1, "generated/").otherwise("src/main/")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.get(kinds, (F.col("p_partkey") % 6).cast("int")).alias("kind"),
        name.alias("name"),
        F.concat_ws(".", "p_type", name).alias("qualified_name"),
        F.concat(folder, F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".java")).alias("file_path"),
        F.col("p_size").alias("start_line"),
        "p_brand",
    )


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from each part to that of the next line of its order."""
    return _edges_of(table(spark, d, "lineitem"))


def small_edges(spark: SparkSession, d: str) -> DataFrame:
    """The same of lines of at most ten pieces, as the SQL of the queries asks."""
    return _edges_of(table(spark, d, "lineitem").filter("l_quantity <= 10"))


def _edges_of(items: DataFrame) -> DataFrame:
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    order = Window.partitionBy("l_orderkey").orderBy(*columns)
    pairs = items.withColumn("dst", F.lead("l_partkey").over(order)).filter("dst is not null")
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "R", "references").otherwise("instantiates")
    return pairs.select(
        F.col("l_partkey").alias("src"), "dst", kind.alias("kind"), F.col("l_linenumber").alias("line"),
        F.lit(None).cast("string").alias("resolved_by"), F.lit(None).cast("string").alias("synthesized_by"), (1 - F.col("l_discount")).alias("confidence"),
    ).distinct()


def part_hops(spark: SparkSession, d: str) -> DataFrame:
    """The ends of :func:`part_edges`: of lines with one number and part either may come first, so that only these are sorted."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return pairs.filter("dst is not null").distinct()


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"))


def place_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, customers and suppliers as nested symbols."""

    def of(name: str, prefix: str, key: str, label: str, kind: str) -> DataFrame:
        return table(spark, d, name).select(
            F.concat(F.lit(prefix), key).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("name"), F.col(label).alias("qualified_name"),
            F.lit("src/main/places.java").alias("file_path"), F.lit(1).alias("start_line"),
        )

    parts = [of("region", "r", "r_regionkey", "r_name", "namespace"), of("nation", "n", "n_nationkey", "n_name", "class"),
             of("customer", "c", "c_custkey", "c_name", "method"), of("supplier", "s", "s_suppkey", "s_name", "field")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _edge(rows: DataFrame, src: str, dst: str, kind: str, line: str = "0") -> DataFrame:
    return rows.selectExpr(
        f"{src} src", f"{dst} dst", f"'{kind}' kind", f"cast({line} as int) line", "cast(null as string) resolved_by", "cast(null as string) synthesized_by", "cast(null as double) confidence"
    )


def place_edges(spark: SparkSession, d: str) -> DataFrame:
    """Containment of places."""
    nations = _edge(table(spark, d, "nation"), "concat('r', n_regionkey)", "concat('n', n_nationkey)", "contains")
    customers = _edge(table(spark, d, "customer"), "concat('n', c_nationkey)", "concat('c', c_custkey)", "contains")
    return nations.unionByName(customers).unionByName(_edge(table(spark, d, "supplier"), "concat('n', s_nationkey)", "concat('s', s_suppkey)", "contains"))


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders refer to customers, customers to nations."""
    orders = _edge(table(spark, d, "orders"), "concat('o', o_orderkey)", "concat('c', o_custkey)", "references", "o_orderkey % 97")
    return orders.unionByName(_edge(table(spark, d, "customer"), "concat('c', c_custkey)", "concat('n', c_nationkey)", "references"))


def symbol_resolve_tiers(spark: SparkSession, d: str) -> DataFrame:
    return graph.candidates(part_nodes(spark, d), QUERY).select("id", "name", "tier", "exact_case")


def symbol_resolve_scoped(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve(part_nodes(spark, d), QUERY, "test").select("id", "role", "tier", "out_of_scope")


def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    nodes = part_nodes(spark, d).withColumns({c: F.replace(c, F.lit(" "), F.lit("_")) for c in ("name", "qualified_name")})
    return graph.candidates(nodes, "red_plat").select("id", "name", "tier")


def segment_matches(spark: SparkSession, d: str) -> DataFrame:
    return graph.segment_matches(part_nodes(spark, d), ["red", "plate", "cover"]).select("id", "matched")


def qualified_lookup(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_qualified(place_nodes(spark, d), place_edges(spark, d), "ASIA.nation_2.customer#000000010").unionByName(
        graph.resolve_qualified(place_nodes(spark, d), place_edges(spark, d), "NATION_2.Customer#000000000")
    ).select("id", "name", "tier", "out_of_scope")


def ancestor_display_name(spark: SparkSession, d: str) -> DataFrame:
    nodes = place_nodes(spark, d)
    return graph.display_names(nodes, graph.nearest_holders(nodes, place_edges(spark, d)))


def container_members(spark: SparkSession, d: str) -> DataFrame:
    nodes = place_nodes(spark, d)
    return graph.callable_members(nodes, place_edges(spark, d), nodes.filter("kind in ('class', 'namespace')"))


def neighborhood_topk(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").selectExpr("concat('o', o_orderkey) id", "'method' kind", "o_orderpriority name", "o_orderpriority qualified_name", "'src/main/orders.java' file_path", "1 start_line")
    nodes = place_nodes(spark, d).unionByName(orders)
    focal = table(spark, d, "customer").filter("c_custkey % 100 = 0").selectExpr("concat('c', c_custkey) id")
    return graph.neighborhood(nodes, order_edges(spark, d), focal).select("focal", "direction", "bucket", "id", "rank", "of")


def impact_radius(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "nation").selectExpr("concat('n', n_nationkey) id")
    files = place_nodes(spark, d).select("id", F.concat(F.lit("src/main/"), F.substr("name", F.lit(-2)), F.lit(".java")).alias("file_path"))
    orders = table(spark, d, "orders").selectExpr("concat('o', o_orderkey) id", "concat('src/orders/', o_orderpriority, '.java') file_path")
    return graph.impact_summary(order_edges(spark, d), roots, files.unionByName(orders))


def reach_forward(spark: SparkSession, d: str, edges: Edges = small_edges) -> DataFrame:
    return graph.expand(edges(spark, d), _sources(spark, d), paths=False).select("id", "depth")


def reach_backward(spark: SparkSession, d: str, edges: Edges = small_edges) -> DataFrame:
    return graph.expand(graph.backward_edges(edges(spark, d)), _sources(spark, d), paths=False).select("id", "depth")


def reach_scoped(spark: SparkSession, d: str) -> DataFrame:
    nodes = part_nodes(spark, d)
    return graph.expansion(nodes, part_edges(spark, d), _sources(spark, d), "down", "main").select("id", "depth")


def shortest_path_len(spark: SparkSession, d: str, edges: Edges = small_edges, depth: int | None = 4) -> DataFrame:
    """Hops between sources and what they reach; the SQL ends at four, the twin at the operator's default."""
    seeds = _sources(spark, d).select(F.col("id").alias("source"), "id")
    return graph.expand(edges(spark, d), seeds, depth, ("source",), paths=False).select("source", "id", F.col("depth").alias("hops"))


def _stopped(spark: SparkSession, d: str, edges: Edges) -> tuple[DataFrame, DataFrame]:
    members = table(spark, d, "part").filter(F.col("p_brand") == BRAND).select(F.col("p_partkey").alias("id"))
    members = sized(members, members.count())
    return graph.expand(edges(spark, d), _sources(spark, d), 6, (), members, paths=False), members


def paths_with_barrier(spark: SparkSession, d: str, edges: Edges = small_edges) -> DataFrame:
    reached, members = _stopped(spark, d, edges)
    return reached.join(members, "id", "left_semi").select("id", F.col("depth").alias("hops"))


def unreached_members(spark: SparkSession, d: str, edges: Edges = small_edges) -> DataFrame:
    reached, members = _stopped(spark, d, edges)
    targets = table(spark, d, "part").filter(F.col("p_brand") == BRAND).select(F.col("p_partkey").alias("id"))
    nodes = part_nodes(spark, d).filter(F.col("p_brand") == BRAND)
    none = edges(spark, d).limit(0)
    found = reached.select(F.col("id").alias("target"), F.col("id").alias("leaf"))
    return graph.unreached_members(nodes, none, targets, found).select(F.col("leaf").alias("id"))


def member_paths(spark: SparkSession, d: str) -> DataFrame:
    """From every nation and the orders divisible by 100 to the customers of every nation."""
    nodes, edges = place_nodes(spark, d), place_edges(spark, d).unionByName(order_edges(spark, d))
    nations = nodes.filter("kind = 'class'")
    orders = table(spark, d, "orders").filter("o_orderkey % 100 = 0").selectExpr("concat('o', o_orderkey) id")
    return graph.member_paths(nodes, edges, nations.select("id").unionByName(orders), nations, most=None, paths=False).select("source", "target", "leaf", "hops")


def callers_of(spark: SparkSession, d: str, edges: Edges = small_edges) -> DataFrame:
    return graph.callers(edges(spark, d), _sources(spark, d), 2).select("id", "depth")


def file_dependents(spark: SparkSession, d: str, edges: Edges = small_edges) -> DataFrame:
    return graph.file_dependents(part_nodes(spark, d), edges(spark, d))


def graph_stats(spark: SparkSession, d: str, edges: Edges = small_edges) -> DataFrame:
    return graph.graph_stats(part_nodes(spark, d), edges(spark, d))


def edge_label_case(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "R", "implements").otherwise("references")
    made = F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R"), "interface-impl")
    by = F.when((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.07), "framework").when(F.col("l_discount") > 0.08, "fuzzy")
    rows = table(spark, d, "lineitem").select(kind.alias("kind"), made.alias("synthesized_by"), by.alias("resolved_by"), F.round(F.lit(1.0) - F.col("l_discount") * 2, 2).alias("confidence"))
    label = graph.hop_label(F.col("kind"), F.col("synthesized_by").isNotNull(), F.col("synthesized_by"), F.col("resolved_by"), F.col("confidence"))
    inferred = graph.is_inferred(F.col("synthesized_by"), F.col("resolved_by"))
    return rows.groupBy(label.alias("label"), inferred.alias("inferred")).agg(F.count("*").alias("n"))


def file_lookup_tiered(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").filter("path is not null").select("path").distinct()
    return graph.find_files(files, PATH_QUERY).select("path", "level")


def literal_search(spark: SparkSession, d: str) -> DataFrame:
    return text_lines.literal_hits(table(spark, d, "documents"), "doc_id", LITERAL)


def line_numbering(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text_lines.numbered(F.col("text")).alias("numbered"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        symbol_resolve_tiers, symbol_resolve_scoped, symbol_search, segment_matches, qualified_lookup, ancestor_display_name, container_members, neighborhood_topk,
        impact_radius, reach_forward, reach_backward, reach_scoped, shortest_path_len, paths_with_barrier, unreached_members, member_paths, callers_of,
        file_dependents, graph_stats, edge_label_case, file_lookup_tiered, literal_search, line_numbering,
    )
}
WHOLE = (reach_forward, reach_backward, shortest_path_len, paths_with_barrier, unreached_members, callers_of, file_dependents, graph_stats)
QUERIES |= {f"whole_{f.__name__}": partial(f, edges=part_edges) for f in WHOLE}
QUERIES["whole_shortest_path_len"] = partial(shortest_path_len, edges=part_hops, depth=None)

_NODES = f"""nodes AS (SELECT p_partkey AS id, (['class', 'interface', 'method', 'function', 'field', 'file'])[p_partkey % 6 + 1] AS kind,
  CASE WHEN p_partkey % 5 = 0 THEN p_name || ' cover' WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name,
  CASE WHEN p_size % 5 = 0 THEN 'src/test/' WHEN p_size % 5 = 1 THEN 'generated/' ELSE 'src/main/' END || replace(p_brand, '#', '') || '.java' AS file_path,
  p_size AS start_line, p_brand FROM part),
cand AS (SELECT *, CASE WHEN name = '{QUERY}' THEN 0 WHEN lower(name) = '{QUERY}' THEN 1 ELSE 2 END AS tier FROM nodes WHERE kind <> 'file' AND contains(lower(name), '{QUERY}')),
ranked AS (SELECT *, list_position(['interface', 'class', 'function', 'method', 'field'], kind) AS kr, starts_with(file_path, 'src/test/') AS inside FROM cand)"""
_EDGES = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS dst FROM lineitem WHERE l_quantity <= 10) WHERE dst IS NOT NULL)"""
_BACK = _EDGES + ", b AS (SELECT dst AS src, src AS dst FROM e)"
_REACH = "WITH RECURSIVE {edges}, r AS (SELECT p_partkey AS id, 0 AS depth FROM part WHERE p_partkey % 100 = 0 UNION SELECT {t}.dst, depth + 1 FROM r JOIN {t} ON r.id = {t}.src WHERE depth < {depth}{more})"
_STOP = f" AND (depth = 0 OR r.id NOT IN (SELECT p_partkey FROM part WHERE p_brand = '{BRAND}'))"

SQL = {
    "symbol_resolve_tiers": f"WITH {_NODES} SELECT id, name, tier, name = '{QUERY}' AS exact_case FROM cand",
    "symbol_resolve_scoped": f"""WITH {_NODES}, o AS (SELECT *, row_number() OVER (ORDER BY tier, kr, start_line, file_path, id) AS pos FROM ranked),
 best AS (SELECT coalesce(min(pos) FILTER (inside), min(pos)) AS best, min(pos) FILTER (inside) IS NULL AS out_of_scope FROM o)
SELECT id, CASE WHEN pos = best THEN 'primary' ELSE 'other' END AS role, tier, out_of_scope FROM o, best WHERE pos = best OR inside""",
    "segment_matches": f"""WITH {_NODES} SELECT id, CAST(len(list_intersect(string_split(lower(name), ' '), ['red', 'plate', 'cover'])) AS INT) AS matched FROM nodes
 WHERE kind <> 'file' AND len(list_intersect(string_split(lower(name), ' '), ['red', 'plate', 'cover'])) > 0""",
    "qualified_lookup": """SELECT 'c' || c_custkey AS id, c_name AS name, CAST(CASE WHEN c_name = q THEN 0 ELSE 1 END AS INT) AS tier, false AS out_of_scope
FROM (VALUES ('ASIA', 'nation_2', 'customer#000000010'), (NULL, 'NATION_2', 'Customer#000000000')) v(r, n, q)
JOIN nation ON lower(n_name) = lower(n) JOIN region ON n_regionkey = r_regionkey AND (r IS NULL OR lower(r_name) = lower(r)) JOIN customer ON c_nationkey = n_nationkey AND lower(c_name) = lower(q)""",
    "ancestor_display_name": """SELECT 'r' || r_regionkey AS id, r_name AS display FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, n_name || '.' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, n_name || '.' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "container_members": """WITH t AS (SELECT 'n' || c_nationkey AS target, 'c' || c_custkey AS id FROM customer) SELECT * FROM t
UNION ALL SELECT x, x FROM (SELECT 'n' || n_nationkey AS x FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region) WHERE x NOT IN (SELECT target FROM t)""",
    "neighborhood_topk": """WITH b AS (SELECT 'c' || o_custkey AS focal, 'in' AS direction, 'references' AS bucket, 'o' || o_orderkey AS id, o_orderkey % 97 AS line FROM orders WHERE o_custkey % 100 = 0
 UNION ALL SELECT 'c' || c_custkey, 'out', 'references', 'n' || c_nationkey, 0 FROM customer WHERE c_custkey % 100 = 0)
SELECT focal, direction, bucket, id, CAST(row_number() OVER w AS INT) AS rank, count(*) OVER (PARTITION BY focal, direction, bucket) AS of FROM b
WINDOW w AS (PARTITION BY focal, direction, bucket ORDER BY line, id) QUALIFY row_number() OVER w <= 8""",
    "impact_radius": """WITH d AS (SELECT 'n' || c_nationkey AS root, 'src/main/' || right(c_name, 2) || '.java' AS file FROM customer UNION ALL
 SELECT 'n' || c_nationkey, 'src/orders/' || o_orderpriority || '.java' FROM customer JOIN orders ON o_custkey = c_custkey)
SELECT root, count(*) AS dependents, count(DISTINCT file) AS files FROM d GROUP BY root""",
    "reach_forward": _REACH.format(edges=_EDGES, t="e", depth=6, more="") + " SELECT id, min(depth) AS depth FROM r GROUP BY id",
    "reach_backward": _REACH.format(edges=_BACK, t="b", depth=6, more="") + " SELECT id, min(depth) AS depth FROM r GROUP BY id",
    "callers_of": _REACH.format(edges=_BACK, t="b", depth=2, more="") + " SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0",
    "shortest_path_len": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS source, p_partkey AS id, 0 AS hops FROM part WHERE p_partkey % 100 = 0
 UNION SELECT source, e.dst, hops + 1 FROM r JOIN e ON r.id = e.src WHERE hops < 4) SELECT source, id, min(hops) AS hops FROM r GROUP BY source, id""",
    "paths_with_barrier": _REACH.format(edges=_EDGES, t="e", depth=6, more=_STOP) + f" SELECT id, min(depth) AS hops FROM r WHERE id IN (SELECT p_partkey FROM part WHERE p_brand = '{BRAND}') GROUP BY id",
    "unreached_members": _REACH.format(edges=_EDGES, t="e", depth=6, more=_STOP) + f" SELECT p_partkey AS id FROM part WHERE p_brand = '{BRAND}' AND p_partkey NOT IN (SELECT id FROM r)",
    "file_dependents": f"""WITH {_EDGES}, {_NODES} SELECT DISTINCT b.file_path AS path, a.file_path AS dependent FROM e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id WHERE a.file_path <> b.file_path""",
    "graph_stats": f"""WITH {_EDGES.replace("SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src,", "SELECT DISTINCT * FROM (SELECT l_partkey AS src, l_returnflag AS kind, l_linenumber AS line, l_discount AS conf,")}, {_NODES}
 SELECT 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'files', count(DISTINCT file_path) FROM nodes""",
    "edge_label_case": """WITH x AS (SELECT CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'R' THEN 'implements' ELSE 'references' END AS kind,
  CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 'interface-impl' END AS made,
  CASE WHEN l_linestatus = 'O' AND l_discount > 0.07 THEN 'framework' WHEN l_discount > 0.08 THEN 'fuzzy' END AS resolved, round(1.0::DOUBLE - l_discount * 2, 2) AS c FROM lineitem)
SELECT CASE WHEN made = 'interface-impl' THEN 'inferred · interface dispatch' WHEN resolved = 'framework' THEN 'inferred · framework ' || printf('%.2f', c)
  WHEN resolved = 'fuzzy' THEN 'low ' || printf('%.2f', c) WHEN c < 0.9 THEN 'medium · ' || printf('%.2f', c) ELSE 'high' END AS label,
  made IS NOT NULL OR resolved IS NOT NULL AS inferred, count(*) AS n FROM x GROUP BY 1, 2""",
    "file_lookup_tiered": """WITH f AS (SELECT DISTINCT path, CASE WHEN lower(path) = 'planner-5.md' THEN 0 WHEN lower(string_split(path, '/')[-1]) = 'planner-5.md' THEN 1 ELSE 2 END AS level
 FROM documents WHERE contains(lower(path), 'planner-5.md')) SELECT path, level FROM f WHERE level = (SELECT min(level) FROM f)""",
    "literal_search": f"""WITH t AS (SELECT doc_id, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents WHERE contains(text, '{LITERAL}')),
 x AS (SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INT) AS line_no FROM t)
SELECT doc_id, line_no, line FROM x WHERE contains(line, '{LITERAL}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 100""",
    "line_numbering": """SELECT doc_id, array_to_string(list_transform(string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)),
 lambda x, i: CAST(i AS VARCHAR) || chr(9) || x), chr(10)) AS numbered FROM documents WHERE text IS NOT NULL""",
}
_FORMED = r"list_filter(string_split(lower(regexp_replace(regexp_replace(replace(name, ' ', '_'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"
SQL["symbol_search"] = f"""WITH {_NODES}, s AS (SELECT id, replace(name, ' ', '_') AS name, {_FORMED} AS words FROM nodes WHERE kind <> 'file'),
 t AS (SELECT *, CASE WHEN name = 'red_plat' THEN 0 WHEN lower(name) = 'red_plat' THEN 1 WHEN contains(lower(name), 'red_plat') THEN 2
  WHEN len(list_intersect(words, ['red', 'plat'])) > 0 OR levenshtein(lower(name), 'red_plat') <= 2 THEN 3 END AS tier FROM s)
SELECT id, name, tier FROM t WHERE tier IS NOT NULL"""
SQL["reach_scoped"] = (
    _REACH.format(edges=_EDGES.replace(" WHERE l_quantity <= 10", "") + f", {_NODES}, s AS (SELECT e.* FROM e JOIN nodes ON e.dst = nodes.id WHERE kind <> 'file' AND starts_with(file_path, 'src/main/'))", t="s", depth=6, more="")
    + " SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0"
)
SQL["member_paths"] = """SELECT 'n' || c_nationkey AS source, 'n' || c_nationkey AS target, 'c' || c_custkey AS leaf, 0 AS hops FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'n' || c_nationkey, 'c' || c_custkey, 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 100 = 0"""
SQL |= {f"whole_{f.__name__}": SQL[f.__name__].replace(" WHERE l_quantity <= 10", "") for f in WHOLE}
SQL["whole_shortest_path_len"] = SQL["whole_shortest_path_len"].replace("hops < 4", "hops < 6")
