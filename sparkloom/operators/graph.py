"""Queries of a property graph of symbols: resolution, neighborhoods, reachability and paths.

``nodes``: id, kind, name, qualified_name, file_path, start_line (and any other columns).
``edges``: src, dst, kind, line, resolved_by, synthesized_by, confidence.

Traversals are loops of joins over the frontier, one job per level and at most ``MAX_DEPTH`` of them;
edges and every level are written to the shared folder, so lineage stays short, a lost executor costs one
level, and the sizes of both sides are known to the joins. A node is
visited once per key; the parent kept is the smallest, so results don't depend on partitioning.

Defined cases: empty graphs give empty results; edges whose ends have no node are left out where
nodes are asked for; a source that is itself a target is reached with zero hops; cycles end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.constants import CALLER_KINDS, CONTAINER_KINDS, DEFAULT_DEPTH, DEPENDENTS_SHOWN, EXPANSION_SHOWN, FORWARD_KINDS, IMPACT_DEPTH, KIND_ORDER, MAX_DEPTH, MEMBERS_SHOWN, NEIGHBORS, NON_SYMBOL_KINDS, PATHS, TYPE_KINDS
from sparkloom.functions.paths import base_name, in_scope, lookup_form
from sparkloom.functions.skew import hub_join, hub_lists, hubs_of, near_join, salted_join, several, sized
from sparkloom.session import cut, stored

#: Words of a set of keys in a traversal, 64 bits each.
WORDS = ("_w0", "_w1", "_w2", "_w3")

# --- nodes and edges ---------------------------------------------------------------------------


def is_symbol(kind: Column) -> Column:
    return ~kind.isin(*NON_SYMBOL_KINDS)


def is_container(kind: Column) -> Column:
    return kind.isin(*CONTAINER_KINDS)


def kind_rank(kind: Column) -> Column:
    """Preference of a kind; kinds without one rank last."""
    rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), kind)
    return F.when(rank > 0, rank - 1).otherwise(len(KIND_ORDER))


def is_inferred(synthesized_by: Column, resolved_by: Column) -> Column:
    """The edge was not read from the code but inferred."""
    return synthesized_by.isNotNull() | F.coalesce(resolved_by.isin("framework", "fuzzy"), F.lit(False))


def hop_label(kind: Column, inferred: Column, synthesized_by: Column, resolved_by: Column, confidence: Column) -> Column:
    """How sure a hop is; the first that holds."""
    digits = F.format_string("%.2f", confidence)
    with_digits = F.when(confidence.isNotNull(), F.concat(F.lit(" "), digits)).otherwise("")
    return (
        F.when(synthesized_by == "interface-impl", "inferred · interface dispatch")
        .when(inferred & (kind == "implements"), "inferred · interface→impl")
        .when(inferred, "inferred · type dispatch")
        .when(resolved_by == "framework", F.concat(F.lit("inferred · framework"), with_digits))
        .when(resolved_by == "fuzzy", F.concat(F.lit("low"), with_digits))
        .when(confidence < 0.9, F.concat(F.lit("medium · "), digits))
        .otherwise("high")
    )


def evidence(file_path: Column, line: Column) -> Column:
    """``file:line`` of a hop, without the line if it is unknown or 0."""
    return F.concat_ws(":", file_path, F.when(line > 0, line).cast("string"))


def children(edges: DataFrame) -> DataFrame:
    """``parent`` and ``child`` of containment."""
    return edges.filter(F.col("kind") == "contains").select(F.col("src").alias("parent"), F.col("dst").alias("child"))


def ancestors(edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Chain of containers of every node: ``id``, ``ancestor`` and ``distance``, nearest first."""
    up = children(edges).select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct()
    level = cut(up.select(F.col("src").alias("id"), F.col("dst").alias("ancestor"), F.lit(1).alias("distance")))
    found = level
    for distance in range(2, depth + 1):
        level = level.join(up, F.col("ancestor") == F.col("src")).filter(F.col("id") != F.col("dst")).select("id", F.col("dst").alias("ancestor"), F.lit(distance).alias("distance"))
        level = cut(level.join(found, ["id", "ancestor"], "left_anti").distinct())
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def nearest_holders(nodes: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """The nearest containers above every node: ``id``, ``ancestor`` and ``distance``. A node goes no further up
    than the first level with one."""
    holders = stored(nodes.filter(is_container(F.col("kind"))).select(F.col("id").alias("ancestor")).distinct())
    up = stored(children(edges).select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct())
    level = up.select(F.col("src").alias("id"), F.col("dst").alias("ancestor"), F.lit(1).alias("distance"))
    found = level.limit(0)
    for distance in range(1, depth + 1):
        level = stored(level)
        held = level.join(holders, "ancestor", "left_semi").select("id", "ancestor", "distance")
        found = found.unionByName(held)
        rest = level.join(held.select("id").distinct(), "id", "left_anti")
        if rest.isEmpty():
            break
        further = rest.join(up, F.col("ancestor") == F.col("src")).filter(F.col("id") != F.col("dst"))
        level = further.select("id", F.col("dst").alias("ancestor"), F.lit(distance + 1).alias("distance")).distinct()
    return found


def display_names(nodes: DataFrame, chain: DataFrame) -> DataFrame:
    """``id`` and ``display``: members are led by the nearest container's name."""
    holders = nodes.filter(is_container(F.col("kind"))).select(F.col("id").alias("ancestor"), F.col("name").alias("holder"))
    nearest = chain.join(holders, "ancestor").groupBy("id").agg(F.min_by("holder", F.struct("distance", "ancestor")).alias("holder"))
    own = (F.col("kind") == "route") | is_container(F.col("kind"))
    return nodes.join(nearest, "id", "left").select("id", F.when(own, F.col("name")).otherwise(F.concat_ws(".", "holder", "name")).alias("display"))


def forward_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a node leads to: calls, references, instantiations and types, and from a container also
    those that implement or extend it (inferred). Columns of ``edges`` with ``inferred`` and ``evidence_id``,
    the node whose file holds the evidence."""
    inferred = is_inferred(F.col("synthesized_by"), F.col("resolved_by"))
    out = edges.filter(F.col("kind").isin(*FORWARD_KINDS, *TYPE_KINDS)).withColumn("inferred", inferred).withColumn("evidence_id", F.col("src"))
    containers = nodes.filter(is_container(F.col("kind"))).select(F.col("id").alias("dst"))
    dispatch = edges.filter(F.col("kind").isin(*TYPE_KINDS)).join(containers, "dst", "left_semi")
    turned = dispatch.withColumns({"src": F.col("dst"), "dst": F.col("src"), "inferred": F.lit(True), "evidence_id": F.col("src")})
    return out.unionByName(turned)


def backward_edges(edges: DataFrame, include_types: bool = False) -> DataFrame:
    """Who leads to a node, turned round: calls, references and instantiations, types only if asked for."""
    kinds = (*FORWARD_KINDS, *TYPE_KINDS) if include_types else FORWARD_KINDS
    own = edges.filter(F.col("kind").isin(*kinds)).withColumn("inferred", is_inferred(F.col("synthesized_by"), F.col("resolved_by"))).withColumn("evidence_id", F.col("src"))
    return own.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def traversable(nodes: DataFrame, steps: DataFrame, scope: str = "all") -> DataFrame:
    """Steps that end at a symbol in scope."""
    allowed = nodes.filter(is_symbol(F.col("kind")) & in_scope(F.col("file_path"), scope)).select(F.col("id").alias("dst"))
    return steps.join(allowed, "dst", "left_semi")


# --- resolution --------------------------------------------------------------------------------


def tokens_of(name: Column) -> Column:
    """Words of a camel-case, snake-case or spaced name in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(spaced), " "), lambda t: t != "")


def candidates(nodes: DataFrame, query: str, fuzzy: int | None = None) -> DataFrame:
    """Symbols that a name may mean, with ``tier``: 0 exact, 1 in another case, 2 part of the qualified
    name, 3 close by words or spelling (the best ``fuzzy``, all if None; only for a query without white space).

    ``position`` (a struct) orders them: tier, exact case, kind, line, path by locale, id.
    """
    lower = query.lower()
    symbols = nodes.filter(is_symbol(F.col("kind")))
    tier = F.when(F.col("name") == query, 0).when(F.lower("name") == lower, 1).when(F.contains(F.lower("qualified_name"), F.lit(lower)), 2)
    found = symbols.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    if not any(c.isspace() for c in query):
        shared = F.size(F.array_intersect(tokens_of(F.col("name")), tokens_of(F.lit(query))))
        distance = F.levenshtein(F.lower("name"), F.lit(lower))
        close = symbols.withColumn("tier", tier).filter(F.col("tier").isNull()).withColumns({"tier": F.lit(3), "shared": shared, "distance": distance})
        close = close.filter((F.col("shared") > 0) | (F.col("distance") <= max(1, len(query) // 3)))
        best = close if fuzzy is None else close.orderBy(F.desc("shared"), "distance", "id").limit(fuzzy)
        found = found.unionByName(best.drop("shared", "distance"))
    exact = F.col("name") == query
    position = F.struct(
        F.col("tier"), (~exact).alias("inexact"), kind_rank(F.col("kind")).alias("kind_rank"), F.col("start_line"),
        F.collate("file_path", "UNICODE").alias("by_path"), F.col("id"),
    )
    return found.withColumns({"exact_case": exact, "position": position})


def resolve(nodes: DataFrame, query: str, scope: str = "all") -> DataFrame:
    """The symbol a name means and its alternatives: candidates with ``role`` primary or other and
    ``out_of_scope``. The best candidate in scope is primary, else the best of all; alternatives are in
    scope and have the query in their simple name."""
    found = candidates(nodes, query).withColumn("in_scope", in_scope(F.col("file_path"), scope))
    best = found.agg(F.min("position").alias("best"), F.min(F.when(F.col("in_scope"), F.col("position"))).alias("best_in_scope"))
    ranked = found.join(F.broadcast(best)).withColumn("role", F.when(F.col("position") == F.coalesce("best_in_scope", "best"), "primary").otherwise("other"))
    kept = (F.col("role") == "primary") | (F.col("in_scope") & F.contains(F.lower("name"), F.lit(query.lower())))
    return ranked.filter(kept).withColumn("out_of_scope", F.col("best_in_scope").isNull()).drop("best", "best_in_scope", "in_scope")


def resolve_qualified(nodes: DataFrame, edges: DataFrame, query: str, scope: str = "all") -> DataFrame:
    """The member that a dotted name means, at most one row with ``tier`` and ``out_of_scope``.

    The outermost part is the best container candidate (fuzzy ones excluded), every further part a
    direct member by name in any case, the smallest line first.
    """
    parts = query.split(".")
    if len(parts) < 2 or not all(parts):
        return nodes.limit(0).withColumns({"tier": F.lit(0), "out_of_scope": F.lit(False)})
    found = candidates(nodes, parts[0]).filter((F.col("tier") <= 2) & is_container(F.col("kind")))
    holder = found.orderBy("position").limit(1).select(F.col("id").alias("holder"), (~in_scope(F.col("file_path"), scope)).alias("outside"))
    for part in parts[1:]:
        members = holder.join(children(edges), F.col("holder") == F.col("parent")).select("outside", F.col("child").alias("id")).join(nodes, "id")
        named = members.filter(is_symbol(F.col("kind")) & (F.lower("name") == part.lower())).orderBy("start_line", "id").limit(1)
        named = named.withColumn("out_of_scope", F.col("outside") | ~in_scope(F.col("file_path"), scope)).drop("outside")
        holder = named.select(F.col("id").alias("holder"), F.col("out_of_scope").alias("outside"))
    return named.withColumn("tier", F.when(F.col("name") == parts[-1], 0).otherwise(1))


def segment_matches(nodes: DataFrame, words: list[str]) -> DataFrame:
    """Symbols whose name has any of the words as a segment, with the number of them."""
    shared = F.size(F.array_intersect(tokens_of(F.col("name")), F.array(*[F.lit(w.lower()) for w in words])))
    return nodes.filter(is_symbol(F.col("kind"))).withColumn("matched", shared).filter("matched > 0")


def find_files(files: DataFrame, query: str) -> DataFrame:
    """Files that a path query means: those equal to it, else of that base name, else that contain it."""
    form = lookup_form(F.lit(query))
    path = F.lower("path")
    level = F.when(path == form, 0).when(base_name(path) == form, 1).when(F.contains(path, form), 2)
    found = files.withColumn("level", level).filter(F.col("level").isNotNull())
    return found.join(F.broadcast(found.agg(F.min("level").alias("level"))), "level")


# --- neighborhoods -----------------------------------------------------------------------------


def neighborhood(nodes: DataFrame, edges: DataFrame, focal: DataFrame, scope: str = "all", most: int = NEIGHBORS) -> DataFrame:
    """Neighbors of the ``focal`` ids by direction and bucket, the first ``most`` of each with the number
    of all (``of``)."""
    bucket = F.when(F.col("kind").isin(*TYPE_KINDS), "types").when(F.col("kind").isin(*FORWARD_KINDS), F.col("kind"))
    used = edges.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull())
    ids = focal.select(F.col("id").alias("focal")).distinct()
    # hubs are spread over salts by whom they meet
    out = salted_join(used.withColumn("focal", F.col("src")), ids, ["focal"], F.col("dst"), "inner").select("focal", F.lit("out").alias("direction"), "bucket", F.col("dst").alias("id"), "line")
    back = salted_join(used.withColumn("focal", F.col("dst")), ids, ["focal"], F.col("src"), "inner").select("focal", F.lit("in").alias("direction"), "bucket", F.col("src").alias("id"), "line")
    named = nodes.filter(is_symbol(F.col("kind")) & in_scope(F.col("file_path"), scope)).select("id", "name")
    return top_per_group(out.unionByName(back).join(named, "id"), ["focal", "direction", "bucket"], ["line", "id"], most)


def top_per_group(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """First ``most`` rows of each group with ``rank`` and the size of the group (``of``).

    A row number under a limit is pruned before the shuffle, and the sizes are aggregated apart, so a
    hot group is never held whole.
    """
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.join(rows.groupBy(*group).agg(F.count("*").alias("of")), group)


def file_symbols(nodes: DataFrame, most: int = MEMBERS_SHOWN) -> DataFrame:
    """Symbols of every file by their start line: the first ``most`` with their ``rank`` and the number of all (``of``)."""
    return top_per_group(nodes.filter(is_symbol(F.col("kind"))), ["file_path"], ["start_line", "id"], most)


def members_shown(nodes: DataFrame, edges: DataFrame, most: int = MEMBERS_SHOWN) -> DataFrame:
    """Symbol members of every container (``parent``) by their start line: the first ``most``, ``rank`` and ``of``."""
    held = children(edges).join(nodes.filter(is_container(F.col("kind"))).select(F.col("id").alias("parent")), "parent", "left_semi").distinct()
    members = held.withColumnRenamed("child", "id").join(nodes.filter(is_symbol(F.col("kind"))), "id")
    return top_per_group(members, ["parent"], ["start_line", "id"], most)


def dependents_shown(dependents: DataFrame, most: int = DEPENDENTS_SHOWN) -> DataFrame:
    """The first ``most`` ``dependent`` files of each ``path``, ``rank`` and ``of``."""
    return top_per_group(dependents, ["path"], ["dependent"], most)


def more_note(shown: Column, of: Column) -> Column:
    """``+N more`` where more exist than are shown, else empty."""
    return F.when(of > shown, F.format_string("+%d more", of - shown)).otherwise("")


def neighbor_text(display: Column, file_path: Column, start_line: Column, kind: Column, inferred: Column) -> Column:
    """``name (file:line) [kind]``, with a mark on inferred edges."""
    return F.concat(display, F.lit(" ("), file_path, F.lit(":"), start_line.cast("string"), F.lit(") ["), kind, F.when(inferred, " (inferred)").otherwise(""), F.lit("]"))


def shown_by_depth(reached: DataFrame, most: int = EXPANSION_SHOWN) -> DataFrame:
    """The first ``most`` rows of what is ``reached`` (``id``, ``depth``) by depth, with their ``rank`` and the number of
    all of a depth (``of``)."""
    return reached.orderBy("depth", "id").limit(most).withColumn("rank", F.row_number().over(Window.orderBy("depth", "id"))).join(
        reached.groupBy("depth").agg(F.count("*").alias("of")), "depth"
    )


def file_dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``path`` and each other file (``dependent``) with a symbol that leads into it."""
    files = nodes.select("id", "file_path")
    ends = edges.filter(F.col("kind") != "contains").select("src", "dst").distinct()
    pairs = ends.join(files.toDF("src", "dependent"), "src").join(files.toDF("dst", "path"), "dst")
    return pairs.filter(F.col("path") != F.col("dependent")).select("path", "dependent").distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Numbers of nodes, edges and files, as ``name`` and ``n``."""
    counts = [nodes.agg(F.lit("nodes").alias("name"), F.count("*").alias("n")), edges.agg(F.lit("edges").alias("name"), F.count("*").alias("n"))]
    return counts[0].unionByName(counts[1]).unionByName(nodes.agg(F.lit("files").alias("name"), F.count_distinct("file_path").alias("n")))


# --- traversal ---------------------------------------------------------------------------------


def clamp_depth(depth: int | None) -> int:
    return max(1, min(MAX_DEPTH, DEFAULT_DEPTH if depth is None else depth))


def _stops(absorbing: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The nodes of ``absorbing`` by the keys they have, written once for all levels; many are never broadcast."""
    found = stored(absorbing.select(*(c for c in (*keys, "id") if c in absorbing.columns)).distinct())
    return sized(found, found.count())


def _left(frontier: DataFrame, stops: DataFrame | None) -> DataFrame:
    """Rows of the frontier that are left on: not those at ``stops`` (of :func:`_stops`)."""
    return frontier if stops is None else frontier.join(stops, stops.columns, "left_anti")


def expand(steps: DataFrame, seeds: DataFrame, depth: int | None = None, keys: tuple[str, ...] = (), absorbing: DataFrame | None = None, paths: bool = True) -> DataFrame:
    """Everything within ``depth`` steps of the seeds (``id`` and key columns), by key.

    Columns: keys, ``id``, ``depth`` (the least) and, with ``paths``, ``path`` (ids from the seed; of the
    shortest the smallest). Nodes of ``absorbing`` (``id`` and any key columns) are reached but not left; seeds among
    them are.
    """
    if keys and not paths:
        names = places(seeds.select(*keys))
        return listed(expand_sets(steps, seeds, names, depth, absorbing), names)
    path = ["path"] if paths else []
    visited = stored(seeds.select(*keys, "id", F.lit(0).alias("depth"), F.array("id").alias("path")).select(*keys, "id", "depth", *path).distinct())
    hops = stored(steps.select("src", "dst").distinct())
    frontier, hubs, rows, stops = visited, hubs_of(hops, "src"), visited.count(), None
    for level in range(1, clamp_depth(depth) + 1):
        if level == 2 and absorbing is not None:  # seeds are always left
            stops = _stops(absorbing, keys)
        # a node that leads to a third of all is spread by whom it leads to
        met = hub_join(hops, _left(frontier, stops).withColumnRenamed("id", "src"), "src", F.col("dst"), hubs, rows)
        longer = [F.concat("path", F.array("dst")).alias("path")] if paths else []
        known = [F.lit(None).cast(visited.schema["path"].dataType).alias("path")] if paths else []
        met = met.select(*keys, F.col("dst").alias("id"), F.lit(level).alias("depth"), *longer)
        # what was visited has a lower depth, so that one aggregation also leaves it out
        both = met.unionByName(visited.select(*keys, "id", "depth", *known)).groupBy(*keys, "id").agg(F.min("depth").alias("depth"), *(F.min(c).alias(c) for c in path))
        frontier = stored(both.filter(F.col("depth") == level).select(*keys, "id", "depth", *path))
        if not (rows := frontier.count()):
            break
        visited = visited.unionByName(frontier)
    return visited


def _word(bit: Column, word: int) -> Column:
    return F.when(F.floor(bit / 64) == word, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint"))


def places(keys: DataFrame) -> DataFrame:
    """The distinct ``keys``, each with its place in sets of keys: ``_block`` and ``_bit``. Neighbours in the order of the
    keys mostly share a block."""
    ordered = keys.distinct().orderBy(*keys.columns).withColumn("_n", F.monotonically_increasing_id())
    return stored(ordered.select(*keys.columns, F.floor(F.col("_n") / (64 * len(WORDS))).alias("_block"), F.pmod("_n", F.lit(64 * len(WORDS))).cast("int").alias("_bit")))


def sets_of(rows: DataFrame, *by: str) -> DataFrame:
    """Sets of the places in ``rows``, by ``by`` and ``_block``."""
    return rows.groupBy(*by, "_block").agg(*(F.bit_or(_word(F.col("_bit"), i)).alias(w) for i, w in enumerate(WORDS)))


def _some(rows: DataFrame) -> DataFrame:
    return rows.filter(" or ".join(f"{w} <> 0" for w in WORDS))


def expand_sets(steps: DataFrame, seeds: DataFrame, names: DataFrame, depth: int | None, absorbing: DataFrame | None = None) -> DataFrame:
    """As :func:`expand` without paths, for many keys (``names``, of :func:`places`): ``id``, ``depth`` and a set of the
    keys that first reach the node there. Seeds belong to all keys that agree with the key columns they have. A row
    carries up to 64 keys a word, so that a node and a hop are met once a block of keys instead of once a key.
    """
    keys = [c for c in names.columns if c not in ("_block", "_bit")]
    own = [k for k in keys if k in seeds.columns]
    of_keys = sized(sets_of(names, *own), names.count())
    begun = seeds.join(of_keys, [seeds[k].eqNullSafe(of_keys[k]) for k in own]).groupBy(seeds["id"], "_block").agg(*(F.bit_or(w).alias(w) for w in WORDS))
    visited = stored(begun.withColumn("depth", F.lit(0)))
    hops = stored(steps.select("src", "dst").distinct())
    frontier, hubs, rows, stops = visited, hubs_of(hops, "src"), visited.count(), None
    lists = stored(hub_lists(hops, "src", "dst", hubs)) if several(hops, "src") else None
    on = [k for k in keys if absorbing is not None and k in absorbing.columns]
    masks = stored(sets_of(names, *on)) if on else None
    none = [F.lit(0).cast("bigint").alias(f"{w}_old") for w in WORDS]
    for level in range(1, clamp_depth(depth) + 1):
        if level == 2 and absorbing is not None and masks is None:
            stops = _stops(absorbing, ())
        if masks is None or level == 1:
            left = _left(frontier, stops)
        else:
            stopped = held(frontier.select("id", "_block"), absorbing, masks, on).groupBy("id", "_block").agg(*(F.bit_or(f"{w}_mask").alias(f"{w}_mask") for w in WORDS))
            rest = frontier.join(stopped, ["id", "_block"], "left")
            left = _some(rest.withColumns({w: F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"{w}_mask", F.lit(0).cast("bigint")))) for w in WORDS}).drop(*(f"{w}_mask" for w in WORDS)))
        left = left.drop("depth").withColumnRenamed("id", "src")
        met = hub_join(hops, left, "src", F.col("dst"), hubs, rows) if lists is None else near_join(lists, left, "src", "dst", hubs, rows)
        met = met.select(F.col("dst").alias("id"), "_block", *WORDS, *none)
        old = visited.select("id", "_block", *(F.lit(0).cast("bigint").alias(w) for w in WORDS), *(F.col(w).alias(f"{w}_old") for w in WORDS))
        both = met.unionByName(old).groupBy("id", "_block").agg(*(F.bit_or(c).alias(c) for w in WORDS for c in (w, f"{w}_old")))
        new = both.select("id", "_block", *(F.col(w).bitwiseAND(F.bitwise_not(f"{w}_old")).alias(w) for w in WORDS), F.lit(level).alias("depth"))
        frontier = stored(_some(new))
        if not (rows := frontier.count()):
            break
        visited = visited.unionByName(frontier)
    return visited


def held(sets: DataFrame, absorbing: DataFrame, masks: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``sets`` at nodes of ``absorbing`` with the set of the keys that these belong to (``_mask``)."""
    # the files of sets are small for their rows, so that none of them is broadcast
    at = sets.hint("merge").join(absorbing.select(*on, "id").distinct(), "id")
    return at.join(masks.withColumnsRenamed({w: f"{w}_mask" for w in WORDS}).hint("merge"), [*on, "_block"])


def listed(sets: DataFrame, names: DataFrame) -> DataFrame:
    """One row (keys, ``id``, ``depth``) of each key in the sets."""
    keys = [c for c in names.columns if c not in ("_block", "_bit")]
    # few sets may hold many keys, so they are spread by a fixed number
    spread = sets.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "_block")
    words = spread.select("id", "depth", "_block", F.posexplode(F.array(*WORDS)).alias("_at", "_word")).filter("_word <> 0")
    bits = words.select("*", F.explode(F.array(*map(F.lit, range(64)))).alias("_of")).filter("shiftright(_word, _of) & 1 = 1")
    rows = bits.select("id", "depth", "_block", (F.col("_at") * 64 + F.col("_of")).alias("_bit"))
    return rows.join(sized(names, names.count()), ["_block", "_bit"]).select(*keys, "id", "depth")


def impact_radius(edges: DataFrame, roots: DataFrame, depth: int = IMPACT_DEPTH) -> DataFrame:
    """``root`` and each dependent ``id`` within ``depth`` hops, whatever leads to it except containment."""
    back = edges.filter(F.col("kind") != "contains").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = roots.select(F.col("id").alias("root"), "id")
    return expand(back, seeds, depth, ("root",), paths=False).filter("depth > 0").select("root", "id", "depth")


def impact_summary(edges: DataFrame, roots: DataFrame, nodes: DataFrame, depth: int = IMPACT_DEPTH) -> DataFrame:
    """``root``, the number of its ``dependents`` and of the distinct ``files`` that hold them."""
    reached = impact_radius(edges, roots, depth).join(nodes.select("id", "file_path"), "id", "left")
    return reached.groupBy("root").agg(F.count("*").alias("dependents"), F.count_distinct("file_path").alias("files"))


def callers(edges: DataFrame, roots: DataFrame, depth: int = 1) -> DataFrame:
    """Who calls, references, imports or instantiates the roots within ``depth`` hops."""
    back = edges.filter(F.col("kind").isin(*CALLER_KINDS)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return expand(back, roots, depth, paths=False).filter("depth > 0")


def callees(edges: DataFrame, roots: DataFrame, depth: int = 1) -> DataFrame:
    """What the roots call, reference, import or instantiate within ``depth`` hops."""
    return expand(edges.filter(F.col("kind").isin(*CALLER_KINDS)), roots, depth, paths=False).filter("depth > 0")


def with_members(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots (``id``) and, of containers, their symbol members."""
    held = roots.join(nodes.filter(is_container(F.col("kind"))).select("id"), "id", "left_semi")
    members = held.join(children(edges), F.col("id") == F.col("parent")).select(F.col("child").alias("id")).join(nodes.filter(is_symbol(F.col("kind"))).select("id"), "id", "left_semi")
    return roots.select("id").unionByName(members).distinct()


def callable_members(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``target`` and ``id`` of what reaching it means: the methods and functions of a container other
    than constructors, or the target itself if there are none."""
    own = targets.select("id").join(nodes, "id").select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"))
    called = nodes.filter(F.col("kind").isin("method", "function")).select(F.col("id").alias("child"), F.col("name").alias("child_name"))
    members = own.filter(is_container(F.col("target_kind"))).join(children(edges), F.col("target") == F.col("parent")).join(called, "child").filter(F.col("child_name") != F.col("target_name"))
    pairs = members.select("target", F.col("child").alias("id")).distinct()
    return pairs.unionByName(own.select("target", F.col("target").alias("id")).join(pairs.select("target"), "target", "left_anti"))


def routes(nodes: DataFrame, scope: str = "all", most: int | None = None) -> DataFrame:
    """Entry points ``@http``: the routes in scope, for a report the first ``most`` (``ROUTES``)."""
    found = nodes.filter((F.col("kind") == "route") & in_scope(F.col("file_path"), scope))
    return found if most is None else found.orderBy("file_path", "start_line", "id").limit(most)


def member_paths(nodes: DataFrame, edges: DataFrame, sources: DataFrame, targets: DataFrame, scope: str = "all", depth: int | None = None, most: int | None = PATHS, max_targets: int | None = None, max_sources: int | None = None, paths: bool = True) -> DataFrame:
    """Shortest paths from each source (and its members) to each leaf of each target: ``source``,
    ``target``, ``leaf``, ``hops`` and, with ``paths``, ``path``.

    The leaves of a target stop each other: a path ends at the first it meets, so they are absorbing in
    one traversal per source and target. All are asked unless ``max_sources`` or ``max_targets`` is given
    (30 and 3 for a report on ``@http``); ``most`` limits the paths shown, shortest first,
    and None gives all. Without ``paths`` the pairs of source and target go together, as sets.
    """
    sources, targets = (rows.orderBy("id").limit(n) if n is not None else rows for rows, n in ((sources, max_sources), (targets, max_targets)))
    leaves = callable_members(nodes, edges, targets).withColumnRenamed("id", "leaf")
    pairs = sources.select(F.col("id").alias("source")).distinct().crossJoin(targets.select(F.col("id").alias("target")).distinct())
    members = with_members_of(nodes, edges, sources)
    absorbing = leaves.select("target", F.col("leaf").alias("id"))
    steps = traversable(nodes, forward_edges(nodes, edges), scope)
    if paths:
        reached = expand(steps, pairs.join(members, "source").select("source", "target", "id"), depth, ("source", "target"), absorbing)
        found = reached.join(absorbing, ["target", "id"], "left_semi")
    else:
        names, absorbing = places(pairs), stored(absorbing)
        at = held(expand_sets(steps, members, names, depth, absorbing), absorbing, sets_of(names, "target"), ["target"])
        found = listed(_some(at.select("id", "depth", "_block", *(F.col(w).bitwiseAND(F.col(f"{w}_mask")).alias(w) for w in WORDS))), names)
    found = found.select("source", "target", F.col("id").alias("leaf"), F.col("depth").alias("hops"), *(["path"] if paths else []))
    return found.orderBy("hops", "source", "target", "leaf").limit(most) if most else found


def with_members_of(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``source`` and ``id`` of itself and, of a container, its symbol members."""
    own = sources.select(F.col("id").alias("source")).distinct()
    held = own.join(nodes.filter(is_container(F.col("kind"))).select(F.col("id").alias("source")), "source", "left_semi")
    members = held.join(children(edges), F.col("source") == F.col("parent")).select("source", F.col("child").alias("id"))
    symbols = members.join(nodes.filter(is_symbol(F.col("kind"))).select("id"), "id", "left_semi").select("source", "id")
    return own.select("source", F.col("source").alias("id")).unionByName(symbols).distinct()


def unreached_members(nodes: DataFrame, edges: DataFrame, targets: DataFrame, paths: DataFrame) -> DataFrame:
    """Leaves of the targets that no path reaches."""
    # what is reached may be many rows in small files, so that it is never broadcast
    return callable_members(nodes, edges, targets).withColumnRenamed("id", "leaf").join(paths.select("target", "leaf").hint("merge"), ["target", "leaf"], "left_anti")


def expansion(nodes: DataFrame, edges: DataFrame, roots: DataFrame, direction: str = "down", scope: str = "all", depth: int | None = None) -> DataFrame:
    """What the roots reach (down) or what reaches them (up): ``id``, ``depth``, ``path`` and the label and
    evidence of the last hop."""
    steps = traversable(nodes, forward_edges(nodes, edges) if direction == "down" else backward_edges(edges), scope)
    reached = expand(steps, with_members(nodes, edges, roots), depth).filter("depth > 0").withColumn("parent", F.element_at("path", -2))
    label = hop_label(F.col("kind"), F.col("inferred"), F.col("synthesized_by"), F.col("resolved_by"), F.col("confidence"))
    files = nodes.select(F.col("id").alias("evidence_id"), F.col("file_path").alias("evidence_file"))
    hops = steps.join(files, "evidence_id", "left").select("src", "dst", F.struct("kind", label.alias("label"), evidence(F.col("evidence_file"), F.col("line")).alias("evidence")).alias("hop"))
    best = hops.groupBy(F.col("src").alias("parent"), F.col("dst").alias("id")).agg(F.min("hop").alias("hop"))
    return reached.join(best, ["parent", "id"], "left").select("id", "depth", "path", "hop.*")
