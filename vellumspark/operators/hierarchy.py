"""Parent-child links to full hierarchies by heavy-path decomposition.

Trees of any depth and width, many groups (documents) at once, or one group that holds most rows:

1. Pointer doubling separates circles: a node whose pointer never reaches a root lies on a circle or below one. The same
   rounds give depth, root and, by passing counts up the doubled pointers, the size of every subtree. The number of
   rounds is the logarithm of the greatest depth.
2. The child with the largest subtree continues its parent's chain, all other children begin chains. A second doubling
   over the chain links gives each node its chain and its place on it.
3. A path from the root crosses at most log2(n) chains, so as many joins of chains give each chain the path that leads to
   it; a node's path is that plus a piece of its own chain.
4. A node's descendants are an interval of the order in which every chain is visited before the chains that hang on it.

Groups of up to TASK_NODES nodes are decomposed in the task that holds them, in time linear in their nodes and paths.
Larger ones are decomposed by the rounds above and are never collected into one task: siblings are numbered in
SIBLING_SPLITS parts with offsets between them; only a chain is gathered in one row, and a chain is no longer than the
path that the deepest node on it has to be given anyway. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import strip_ws
from vellumspark.tables import cut, measured

SIBLING_SPLITS = 64
#: Nodes of a group that one task may hold.
TASK_NODES = 200_000
PLACED = "root string, path array<string>, first bigint, last bigint, circle string"


def decompose(ids: Sequence[str], parents: Sequence[str | None]) -> list[tuple]:
    """(root, path, first, last, circle) of each node of a group, by heavy paths."""
    n, at = len(ids), {x: i for i, x in enumerate(ids)}
    up = [-1 if p is None else at[p] for p in parents]
    # 0 not yet looked at, 1 on the walk, 2 leads to a root, 3 on a circle, 4 below one
    state, order = [0] * n, []
    for i in range(n):
        walk, x = [], i
        while x >= 0 and not state[x]:
            state[x] = 1
            walk.append(x)
            x = up[x]
        if x >= 0 and state[x] == 1:  # the walk has met itself: the part from x on is a circle
            begin = walk.index(x)
            for y in walk[begin:]:
                state[y] = 3
            walk = walk[:begin]
            ends = 4
        else:
            ends = 2 if x < 0 or state[x] == 2 else 4
        for y in reversed(walk):  # parents come before their children
            state[y] = ends
            if ends == 2:
                order.append(y)
    size, heavy, children = [1] * n, [-1] * n, {}
    for x in reversed(order):
        if up[x] >= 0:
            size[up[x]] += size[x]
    for x in order:
        p = up[x]
        if p >= 0:
            children.setdefault(p, []).append(x)
            if heavy[p] < 0 or (size[x], ids[x]) > (size[heavy[p]], ids[heavy[p]]):
                heavy[p] = x
    # chains: the first node, what leads to it, and its own nodes
    chain, place, first, segment, prefix = [0] * n, [0] * n, [0] * n, {}, {}
    begun = [x for x in order if up[x] < 0]
    for head in begun:  # grows while it is read: chains that hang on a chain come after it
        p = up[head]
        prefix[head] = [] if p < 0 else prefix[chain[p]] + segment[chain[p]][: place[p] + 1]
        nodes, x, begin = [], head, first[head]
        while x >= 0:
            chain[x], place[x], first[x] = head, len(nodes), begin + len(nodes)
            nodes.append(ids[x])
            x = heavy[x]
        segment[head] = nodes
        x = head
        while x >= 0:
            behind = first[x] + 1 + (size[heavy[x]] if heavy[x] >= 0 else 0)
            for y in sorted((c for c in children.get(x, ()) if c != heavy[x]), key=lambda c: ids[c]):
                first[y] = behind
                behind += size[y]
                begun.append(y)
            x = heavy[x]
    out = []
    for i in range(n):
        if state[i] == 2:
            path = prefix[chain[i]] + segment[chain[i]][: place[i] + 1]
            out.append((path[0], path, first[i], first[i] + size[i] - 1, None))
        else:
            out.append((None, None, None, None, "on" if state[i] == 3 else "below"))
    return out


def _decomposed(keys: int):
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*decompose(table.column("_id").to_pylist(), table.column("_parent").to_pylist()), strict=True))
        kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string())
        names = [f"_g{i}" for i in range(keys)] + ["_id"]
        return pa.table([*[table.column(c) for c in names], *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]], names=[*names, "root", "path", "first", "last", "circle"])

    return run


def _link_key(c: Column) -> Column:
    return F.nullif(F.lower(strip_ws(c.cast("string"))), F.lit(""))


def resolve_parents(df: DataFrame, group: Sequence[str], node: str, parent: str) -> DataFrame:
    """Columns group, _id, _parent: `_parent` is null for a root.

    Blanks around an identifier and letter case don't matter. A parent that is null, blank or no node of the group makes
    a root. Two nodes of a group whose identifiers differ only so: links go to the one that sorts first.
    """
    g = list(group)
    nodes = df.select(*g, F.col(node).alias("_id"), _link_key(F.col(parent)).alias("_link"))
    names = nodes.select(*g, _link_key(F.col("_id")).alias("_link"), "_id").where(F.col("_link").isNotNull()).groupBy(*g, "_link").agg(F.min("_id").alias("_parent"))
    return nodes.join(names, [*g, "_link"], "left").select(*g, "_id", "_parent")


def _separate(links: DataFrame, g: list[str]) -> DataFrame:
    """group, _id, _parent, _root, _depth, _size, _circle ('on', 'below' or null); null root, depth and size where circle is not null."""
    state = cut(links.select(*g, "_id", "_parent", F.col("_parent").alias("_to"), F.when(F.col("_parent").isNull(), F.col("_id")).alias("_root"), F.lit(1).cast("bigint").alias("_depth"), F.lit(1).cast("bigint").alias("_size")))
    left, before, rounds, settled = state.where("_to is not null").count(), -1, 0, False
    waiting = F.count_if(F.col("_to").isNotNull())
    while left and not (settled and 2**rounds >= left):
        target = state.select(*g, F.col("_id").alias("_to"), F.col("_to").alias("_next"), F.col("_root").alias("_next_root"), F.col("_depth").alias("_more"))
        passed = state.where("_to is not null").groupBy(*g, F.col("_to").alias("_id")).agg(F.sum("_size").alias("_passed"))
        state = (
            state.join(target, [*g, "_to"], "left")
            .select(*g, "_id", "_parent", F.col("_next").alias("_to"), F.coalesce("_root", "_next_root").alias("_root"), (F.col("_depth") + F.coalesce("_more", F.lit(0))).alias("_depth"), "_size")
            .join(passed, [*g, "_id"], "left")
            .select(*g, "_id", "_parent", "_to", "_root", "_depth", (F.col("_size") + F.coalesce("_passed", F.lit(0))).alias("_size"))
        )
        # once only circles are left their counts are of no use, and would double without end
        state, seen = measured(state.withColumn("_size", F.when(F.col("_to").isNotNull() & F.lit(settled), F.lit(0)).otherwise(F.col("_size"))), left=waiting)
        before, left, rounds = left, seen["left"], rounds + 1
        settled = settled or left == before
    if not left:
        return state.select(*g, "_id", "_parent", "_root", "_depth", "_size", F.lit(None).cast("string").alias("_circle"))
    on = state.where("_to is not null").select(*g, F.col("_to").alias("_id")).distinct().withColumn("_on", F.lit(True))
    astray = F.col("_to").isNotNull()
    return state.join(on, [*g, "_id"], "left").select(
        *g,
        "_id",
        "_parent",
        F.when(~astray, F.col("_root")).alias("_root"),
        F.when(~astray, F.col("_depth")).alias("_depth"),
        F.when(~astray, F.col("_size")).alias("_size"),
        F.when(F.col("_on"), F.lit("on")).when(astray, F.lit("below")).alias("_circle"),
    )


def _chains(tree: DataFrame, g: list[str]) -> DataFrame:
    """tree with _chain (its first node), _place (1 at the first node) and _before (nodes between the parent and this first node of a chain, in visiting order)."""
    size = F.struct(F.col("_size"), F.col("_id"))
    heavy = tree.where("_parent is not null").groupBy(*g, "_parent").agg(F.max(size).alias("_heavy")).select(*g, "_parent", F.col("_heavy._id").alias("_heavy"), F.col("_heavy._size").alias("_heavy_size"))
    marked = tree.join(heavy, [*g, "_parent"], "left").withColumn("_first", F.coalesce(F.col("_id") != F.col("_heavy"), F.lit(True)))
    # places of light siblings in visiting order, in parts with offsets between them
    light = marked.where("_first and _parent is not null").withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(SIBLING_SPLITS)))
    parts = light.groupBy(*g, "_parent", "_part").agg(F.sum("_size").alias("_part_size"))
    parts = parts.withColumn("_offset", F.sum("_part_size").over(Window.partitionBy(*g, "_parent").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy(*g, "_parent", "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    light = (
        light.withColumn("_earlier", F.coalesce(F.sum("_size").over(within), F.lit(0)))
        .join(parts.select(*g, "_parent", "_part", "_offset"), [*g, "_parent", "_part"])
        .select(*g, "_id", (F.col("_heavy_size") + F.coalesce("_offset", F.lit(0)) + F.col("_earlier")).alias("_before"))
    )
    state = marked.join(light, [*g, "_id"], "left").select(*g, "_id", "_parent", "_root", "_depth", "_size", "_before", F.when(F.col("_first"), F.col("_id")).alias("_chain"), F.when(~F.col("_first"), F.col("_parent")).alias("_to"), F.lit(1).cast("bigint").alias("_place"))
    open_ = F.count_if(F.col("_chain").isNull())
    state, seen = measured(state, left=open_)
    while seen["left"]:
        target = state.select(*g, F.col("_id").alias("_to"), F.col("_to").alias("_next"), F.col("_chain").alias("_next_chain"), F.col("_place").alias("_more"))
        state, seen = measured(
            state.join(target, [*g, "_to"], "left").select(
                *g, "_id", "_parent", "_root", "_depth", "_size", "_before", F.coalesce("_chain", "_next_chain").alias("_chain"), F.col("_next").alias("_to"), (F.col("_place") + F.coalesce("_more", F.lit(0))).alias("_place")
            ),
            left=open_,
        )
    return state.drop("_to")


def _routes(nodes: DataFrame, g: list[str]) -> DataFrame:
    """For each chain: _chain, _segment (its nodes), _prefix (the path that leads to it), _begin (place of its first node in visiting order)."""
    segments = nodes.groupBy(*g, "_chain").agg(F.array_sort(F.collect_list(F.struct("_place", "_id"))).alias("_s")).select(*g, "_chain", F.col("_s._id").alias("_segment"))
    first = nodes.where(F.col("_id") == F.col("_chain")).select(*g, "_chain", "_parent", "_before")
    hangs = nodes.select(*g, F.col("_id").alias("_parent"), F.col("_chain").alias("_above"), F.col("_place").alias("_above_place"))
    chains = cut(segments.join(first, [*g, "_chain"]).join(hangs, [*g, "_parent"], "left").select(*g, "_chain", "_segment", "_above", "_above_place", "_before"))
    known = chains.where("_above is null").select(*g, "_chain", "_segment", F.array().cast("array<string>").alias("_prefix"), F.lit(0).cast("bigint").alias("_begin"))
    waiting = chains.where("_above is not null")
    levels = [known]
    while True:
        above = levels[-1].select(*g, F.col("_chain").alias("_above"), F.col("_segment").alias("_above_segment"), F.col("_prefix").alias("_above_prefix"), F.col("_begin").alias("_above_begin"))
        level, seen = measured(
            waiting.join(above, [*g, "_above"]).select(
                *g,
                "_chain",
                "_segment",
                F.concat("_above_prefix", F.slice("_above_segment", 1, F.col("_above_place").cast("int"))).alias("_prefix"),
                (F.col("_above_begin") + F.col("_above_place") + F.col("_before")).alias("_begin"),
            ),
            n=F.count(F.lit(1)),
        )
        if not seen["n"]:
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)


def _by_rounds(links: DataFrame, g: list[str]) -> DataFrame:
    """The same of groups of any size."""
    state = cut(_separate(links, g))
    nodes = _chains(state.where("_circle is null"), g)
    routes = _routes(nodes, g)
    begin = F.col("_begin") + F.col("_place") - 1
    placed = nodes.join(routes, [*g, "_chain"]).select(
        *g, "_id", F.col("_root").alias("root"), F.concat("_prefix", F.slice("_segment", 1, F.col("_place").cast("int"))).alias("path"), begin.alias("first"), (begin + F.col("_size") - 1).alias("last"), F.lit(None).cast("string").alias("circle")
    )
    placed = placed.select(*g, "_id", "root", F.size("path").cast("bigint").alias("depth"), "path", "first", "last", "circle")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("root", "string"), ("depth", "bigint"), ("path", "array<string>"), ("first", "bigint"), ("last", "bigint"))]
    return placed.unionByName(state.where("_circle is not null").select(*g, "_id", *nothing, F.col("_circle").alias("circle")))


def hierarchy(df: DataFrame, group: Sequence[str], node: str, parent: str, task_nodes: int = TASK_NODES) -> DataFrame:
    """One row for each (group, node): root, depth, path, first, last, circle.

    depth     1 for a root
    path      identifiers from the root to the node
    first, last  the node's place, and that of its last descendant, in the visiting order of its root's tree; the
              descendants of a node are the nodes of the same root with a place in (first, last]
    circle    'on' a circle of parents, 'below' one, or null; then all of root, depth, path, first and last are null

    `df` has at most one row for each (group, node); see tables.current_rows. Rows with a null node are left out. Null
    groups form a group. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    g = [f"_g{i}" for i in range(len(group))]
    # null groups are kept apart from each other's names by a flag, so that plain equality joins do
    rows = df.where(F.col(node).isNotNull()).select(
        *[F.concat(F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(a) for c, a in zip(group, g, strict=True)], F.col(node).cast("string").alias("_node"), F.col(parent).alias("_up")
    )
    links = resolve_parents(rows, g, "_node", "_up").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*g)))
    links, seen = measured(links, largest=F.max("_n"))
    whole = links.where(F.col("_n") <= task_nodes).drop("_n")
    out = whole.groupBy(*g).applyInArrow(_decomposed(len(g)), ", ".join(f"{c} string" for c in [*g, "_id"]) + ", " + PLACED)
    out = out.select(*g, "_id", "root", F.nullif(F.size("path"), F.lit(-1)).cast("bigint").alias("depth"), "path", "first", "last", "circle")
    if (seen["largest"] or 0) > task_nodes:
        out = out.unionByName(_by_rounds(links.where(F.col("_n") > task_nodes).drop("_n"), g))
    back = [F.when(F.col(a).startswith("1"), F.expr(f"substring({a}, 2)")).cast(df.schema[c].dataType).alias(c) for c, a in zip(group, g, strict=True)]
    return out.select(*back, F.col("_id").alias(node), "root", "depth", "path", "first", "last", "circle")


def descendants(tree: DataFrame, group: Sequence[str], node: str) -> DataFrame:
    """Every pair (ancestor, node) with its distance: the nodes of an ancestor's root in the places of its interval. Nodes on or below circles have none."""
    g = [f"_d{i}" for i in range(len(group))]
    keys = [F.to_json(F.struct(F.col(c).alias("k"))).alias(a) for c, a in zip(group, g, strict=True)]  # null groups are equal
    placed = tree.where("circle is null").select(*group, *keys, F.col(node).alias("_node"), "root", "depth", "first", "last")
    above = placed.where(F.col("last") > F.col("first")).select(*group, *g, "root", F.col("_node").alias("ancestor"), F.col("depth").alias("_d"), F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("first"))
    below = placed.select(*g, "root", "first", F.col("_node").alias("descendant"), "depth")
    return above.join(below, [*g, "root", "first"]).select(*group, "ancestor", "descendant", (F.col("depth") - F.col("_d")).alias("distance"))
