"""Parent-child links to full hierarchies.

Method: the connected components of the link graph are found by pointer jumping among the
nodes that have children (each round doubles the distance every unfinished node looks up
the parent chain, so the number of rounds is the logarithm of the largest depth; the
distance summed on the way is the depth). Every component is then co-located in one task,
and an iterative depth-first traversal with white, grey and black nodes numbers the nodes
in pre-order and writes the number of descendants, the state, and the back edges that close
cycles; a cycle is entered at its smallest node, so its component is numbered as the tree
that is left without the back edge. Work and memory are linear in the nodes whatever the
depth; full paths, whose size is nodes times depth, are written only where asked for.

A component of more than ``max_local_nodes`` is cut into pieces at every sixteenth level;
each piece is traversed in one task in the same way, the pieces below it standing as single
nodes of their weight, which the traversal of the tree of pieces gives. So one traversal
serves every size; a node may have as many children as one task can hold.

Input conventions, for every public function here:

* a null ``node_id`` is no node; null, missing or unknown link ends are ignored;
* repeated links count once; if a node still has two parents the smallest is kept;
* a link of a node to itself is a cycle of length one;
* an empty input gives an empty result with the full schema;
* extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import materialize, release, task_count

#: Nodes of one component, or of the components taken together, that a task holds at a time (about 0.1 GB of Python memory).
MAX_LOCAL_NODES = 250_000
#: Levels of one piece of a larger component.
BAND = 16

SCHEMA = (
    "node_id bigint, root_id bigint, depth int, state string, "
    "path array<bigint>, n_descendants bigint, closes_cycle boolean, pre bigint"
)


def latest_rows(df: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """One row per non-null ``key``: the one with the greatest ``at`` (a null ``at`` is the
    oldest); of rows that tie the greatest by ``values`` is taken."""
    best = F.max(F.struct(F.col(at).alias("_at"), *[F.col(v) for v in values])).alias("_best")
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key))
        .agg(best)
        .select(key, *[F.col(f"_best.{v}").alias(v) for v in values])
    )


def child_links(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """(node_id, parent) for every node of either table; ``parent`` is null for a root.

    ``nodes`` has (node_id, left_id, right_id, exported_at), ``index`` has (node_id,
    parent_by_node, exported_at).
    """
    rows = latest_rows(nodes, "node_id", "exported_at", ["left_id", "right_id"])
    stored = latest_rows(index, "node_id", "exported_at", ["parent_by_node"])
    none = F.lit(None).cast("bigint")
    own = rows.select(
        F.explode(
            F.array(
                F.struct(F.col("node_id").alias("id"), F.lit(1).alias("own"), none.alias("down")),
                F.struct(F.col("left_id").alias("id"), F.lit(0).alias("own"), F.col("node_id").alias("down")),
                F.struct(F.col("right_id").alias("id"), F.lit(0).alias("own"), F.col("node_id").alias("down")),
            )
        ).alias("r")
    ).select("r.id", "r.own", "r.down", none.alias("up"))
    known = stored.select(
        F.col("node_id").alias("id"), F.lit(1).alias("own"), none.alias("down"), F.col("parent_by_node").alias("up")
    )
    merged = (
        own.unionByName(known)
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max("own").alias("own"), F.min("down").alias("down"), F.min("up").alias("up"))
        .where(F.col("own") == 1)
        .select(F.col("id").alias("node_id"), "down", "up")
    )
    merged = materialize(merged, "links")
    # parent_by_node may name an id that is no node: only those links need the check.
    open_links = merged.where(F.col("down").isNull() & F.col("up").isNotNull()).select("node_id", F.col("up").alias("checked"))
    valid = open_links.join(merged.select(F.col("node_id").alias("checked")), "checked", "left_semi")
    return merged.join(valid, "node_id", "left").select(
        "node_id", F.coalesce("down", "checked").alias("parent")
    )


def components(links: DataFrame) -> DataFrame:
    """(node_id, parent, comp, depth): the connected component of every node.

    ``comp`` is the root of the component, or the smallest node of its cycle; ``depth`` is
    null off the rooted trees. Only nodes with children take part in the jumping: unfinished
    ones jump from their pointer to their pointer's pointer until the count of unfinished
    nodes stays the same in two rounds; those left hang on cycles. All others have the
    component of their parent.
    """
    upper = links.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node_id")).distinct()
    # A root points to itself and is finished; a node is finished once its pointer is.
    state = materialize(
        links.join(upper, "node_id", "left_semi").select(
            "node_id",
            F.coalesce("parent", "node_id").alias("ptr"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
            F.col("parent").isNull().alias("done"),
        ),
        "ptr",
    )
    left, before = state.where(~F.col("done")).count(), -1
    while left and left != before:
        target = state.select(
            F.col("node_id").alias("ptr"), F.col("ptr").alias("far"), F.col("dist").alias("far_dist"), F.col("done").alias("far_done")
        )
        moved = state.where(~F.col("done")).join(target, "ptr")
        after = materialize(
            state.where("done").unionByName(
                moved.select("node_id", F.col("far").alias("ptr"), (F.col("dist") + F.col("far_dist")).alias("dist"), F.col("far_done").alias("done"))
            ),
            "ptr",
        )
        release(state)
        state, before = after, left
        left = state.where(~F.col("done")).count()
    label = state.where("done").select(F.col("node_id").alias("parent"), F.col("ptr").alias("comp"), F.col("dist").alias("up"))
    if left:
        stuck = links.join(state.where(~F.col("done")).select("node_id"), "node_id", "left_semi")
        label = label.unionByName(_cycle_labels(stuck, left).select(F.col("node_id").alias("parent"), "comp", F.lit(None).cast("bigint").alias("up")))
    roots = links.where(F.col("parent").isNull()).select("node_id", "parent", F.col("node_id").alias("comp"), F.lit(0).cast("bigint").alias("depth"))
    return roots.unionByName(
        links.where(F.col("parent").isNotNull()).join(label, "parent").select("node_id", "parent", "comp", (F.col("up") + 1).alias("depth"))
    )


def _cycle_labels(stuck: DataFrame, size: int) -> DataFrame:
    """(node_id, comp) for nodes whose every ancestor lies on the way to a cycle."""
    at = materialize(
        stuck.select("node_id", "parent", F.col("parent").alias("ptr"), F.col("node_id").alias("least"), F.col("node_id").alias("comp")),
        "cycle",
    )
    reach, rounds = 1, 0
    while True:
        target = at.select(F.col("node_id").alias("ptr"), F.col("ptr").alias("far"), F.col("least").alias("far_least"))
        after = materialize(
            at.drop("comp").join(target, "ptr").select(
                "node_id",
                "parent",
                F.col("far").alias("ptr"),
                F.least("least", "far_least").alias("least"),
                F.col("far_least").alias("comp"),
            ),
            "cycle",
        )
        release(at)
        at, reach, rounds = after, reach * 2, rounds + 1
        # comp is the least node met in `reach / 2` steps from `reach / 2` up: final once
        # every node agrees with its parent, and at the latest when reach passes the size.
        if reach >= 2 * size:
            break
        if rounds >= 4 and rounds % 3 == 1:
            up = at.select(F.col("node_id").alias("parent"), F.col("comp").alias("up"))
            if at.join(up, "parent").where(F.col("comp") != F.col("up")).isEmpty():
                break
    return at.select("node_id", "comp")


class _Forest:
    """Depth-first numbering of whole components, or pieces, held in one task.

    ``group`` names the component of every node and is the node it is entered at; ``parent``
    is -1 above an entry without parent. ``weight`` nodes are counted for a node."""

    def __init__(self, ids: np.ndarray, parent: np.ndarray, group: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.group, weight = ids[order], group[order], weight[order].tolist()
        up = parent[order]
        n = len(ids)
        par = np.full(n, -1, np.int64)
        has = up >= 0
        par[has] = np.searchsorted(self.ids, up[has])
        # Children of each node as a slice of one array.
        kids = np.argsort(par, kind="stable")
        kids = kids[np.searchsorted(par[kids], 0) :]
        at = np.searchsorted(par[kids], np.arange(n)).tolist()
        last = np.searchsorted(par[kids], np.arange(n), side="right").tolist()
        kids = kids.tolist()
        white, grey, black = 0, 1, 2
        colour = bytearray(n)
        depth, pre, below = [0] * n, [0] * n, [0] * n
        self.parent = par
        self.closes = np.zeros(n, bool)
        self.on_cycle = np.zeros(n, bool)
        for start in np.flatnonzero(self.ids == self.group).tolist():
            stack = [start]
            colour[start] = grey
            seen = weight[start]
            while stack:
                v = stack[-1]
                k = at[v]
                if k < last[v]:
                    at[v] = k + 1
                    w = kids[k]
                    if colour[w] == white:
                        colour[w] = grey
                        depth[w] = depth[v] + 1
                        pre[w] = seen
                        seen += weight[w]
                        stack.append(w)
                    elif colour[w] == grey:  # a back edge: all from w up the stack is a cycle
                        self.closes[v] = True
                        self.on_cycle[stack[stack.index(w) :]] = True
                else:
                    colour[v] = black
                    stack.pop()
                    if stack:
                        below[stack[-1]] += below[v] + weight[v]
        self.depth, self.pre, self.below = np.array(depth, np.int64), np.array(pre, np.int64), np.array(below, np.int64)


def _whole(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``key`` in parts that end between keys and hold about MAX_LOCAL_NODES rows."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += len(pdf)
        if size >= MAX_LOCAL_NODES:
            rows = pd.concat(held, ignore_index=True)
            keys = rows[key].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield rows.iloc[:cut]
            held, size = [rows.iloc[cut:]], len(rows) - cut
    if held and size:
        yield pd.concat(held, ignore_index=True)


def _traverse(paths: bool):
    """Depth-first traversal of all components of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole(batches, "comp"):
            up = pdf["parent"].fillna(-1).to_numpy(np.int64)
            has = pdf["parent"].notna().to_numpy()
            comp, ids = pdf["comp"].to_numpy(np.int64), pdf["node_id"].to_numpy(np.int64)
            low = min(int(ids.min()), 0)  # parents of any sign: -1 must mean none
            f = _Forest(ids - low, np.where(has, up - low, -1), comp - low, np.ones(len(ids), np.int64))
            rooted = pd.Series(f.group).isin(f.ids[f.parent < 0]).to_numpy()
            ids, group = f.ids + low, f.group + low
            depth = np.where(rooted, f.depth, -1)
            state = np.where(rooted, "rooted", np.where(f.on_cycle, "on_cycle", "below_cycle"))
            parent, names = f.parent.tolist(), ids.tolist()
            for lo in range(0, len(ids), 50_000):
                cut = slice(lo, min(len(ids), lo + 50_000))
                held: list = [None] * (cut.stop - lo)
                for v in range(lo, cut.stop) if paths else ():
                    if depth[v] >= 0:
                        path, w = [0] * (int(depth[v]) + 1), v
                        for k in range(len(path) - 1, -1, -1):
                            path[k] = names[w]
                            w = parent[w]
                        held[v - lo] = path
                yield pd.DataFrame(
                    {
                        "node_id": ids[cut], "root_id": group[cut], "depth": depth[cut].astype(np.int32), "state": state[cut], "path": held,
                        "n_descendants": f.below[cut], "closes_cycle": f.closes[cut], "pre": f.pre[cut],
                    }
                )

    return run


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node_id, piece, part, pre, below) of weighted pieces; ``part`` nodes are the pieces below."""
    for pdf in _whole(batches, "piece"):
        # A node may stand in two pieces, as its own top and as a part of the one above: places are (piece, node).
        nodes = pd.MultiIndex.from_frame(pdf[["piece", "node_id"]])
        place = np.arange(len(pdf))
        at = pd.Series(place, index=nodes)
        top = (pdf["node_id"] == pdf["piece"]).to_numpy() & ~pdf["part"].to_numpy(bool)
        up = np.full(len(pdf), -1, np.int64)
        up[~top] = at.reindex(pd.MultiIndex.from_frame(pdf.loc[~top, ["piece", "parent"]])).to_numpy(np.int64)
        entry = at.reindex(pd.MultiIndex.from_arrays([pdf["piece"], pdf["piece"]])).to_numpy(np.int64)
        f = _Forest(place, up, entry, pdf["weight"].to_numpy(np.int64))
        yield pd.DataFrame({"node_id": pdf["node_id"], "piece": pdf["piece"], "part": pdf["part"], "pre": f.pre, "below": f.below})


def _doubled(at: DataFrame, rounds: int | None) -> DataFrame:
    """(node_id, ptr, sum): pointers followed to their end, or ``rounds`` times doubled, and the
    sums on the way. ``at`` has the same columns; a null ``ptr`` is an end."""
    at = materialize(at, "doubled")
    k = 0
    while (rounds is None or k < rounds) and not at.where("ptr is not null").isEmpty():
        target = at.select(F.col("node_id").alias("ptr"), F.col("ptr").alias("far"), F.col("sum").alias("far_sum"))
        after = materialize(
            at.where("ptr is null").unionByName(
                at.where("ptr is not null").join(target, "ptr").select("node_id", F.col("far").alias("ptr"), (F.col("sum") + F.col("far_sum")).alias("sum"))
            ),
            "doubled",
        )
        release(at)
        at, k = after, k + 1
    return at


def _tops(forest: DataFrame) -> DataFrame:
    """(node_id, piece): the piece of every node, named by its topmost node: the nearest of its
    ancestors and itself that is a root, or has children and a depth divisible by BAND."""
    inner = forest.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    flagged = forest.join(inner, "node_id", "left")
    top = F.col("parent").isNull() | (F.coalesce("inner", F.lit(False)) & (F.col("depth") % BAND == 0))
    at = materialize(flagged.select("node_id", F.when(top, F.col("node_id")).otherwise(F.col("parent")).alias("piece"), top.alias("done")), "tops")
    for _ in range(BAND.bit_length()):
        target = at.select(F.col("node_id").alias("piece"), F.col("piece").alias("far"), F.col("done").alias("far_done"))
        after = materialize(
            at.where("done").unionByName(at.where(~F.col("done")).join(target, "piece").select("node_id", F.col("far").alias("piece"), F.col("far_done").alias("done"))), "tops"
        )
        release(at)
        at = after
    return at.select("node_id", "piece")


def _numbered(forest: DataFrame, most: int) -> DataFrame:
    """(node_id, pre, below) of trees of any size; ``forest`` has (node_id, parent, comp, depth, weight)."""
    spark = forest.sparkSession
    forest = materialize(forest, "forest")
    sizes = forest.groupBy("comp").agg(F.count("*").alias("n"))
    schema = "node_id bigint, piece bigint, part boolean, pre bigint, below bigint"
    columns = ["node_id", "parent", "piece", "weight", "part"]
    if sizes.where(F.col("n") > most).isEmpty():
        rows = forest.select("node_id", "parent", F.col("comp").alias("piece"), "weight", F.lit(False).alias("part"))
        done = rows.repartition(task_count(spark, forest.count()), "piece").sortWithinPartitions("piece").mapInPandas(_number, schema)
        return materialize(done.select("node_id", "pre", "below"), "numbered")
    placed = materialize(forest.join(_tops(forest), "node_id"), "pieces")
    mass = placed.groupBy("piece").agg(F.sum("weight").alias("weight"))
    above = placed.select(F.col("node_id").alias("parent"), F.col("piece").alias("over"))
    tops = placed.where(F.col("node_id") == F.col("piece")).join(mass.withColumnRenamed("weight", "mass"), "piece").join(above, "parent", "left")
    # the tree of pieces: one node a piece, of the weight of all its nodes
    contracted = tops.select("node_id", F.col("over").alias("parent"), "comp", F.floor(F.col("depth") / BAND).alias("depth"), F.col("mass").alias("weight"))
    held = _numbered(contracted, most).select("node_id", F.col("below").alias("lower"))
    parts = materialize(
        tops.where("over is not null").join(held, "node_id").select("node_id", "parent", F.col("over").alias("piece"), (F.col("mass") + F.col("lower")).alias("weight"), F.lit(True).alias("part")),
        "parts",
    )
    rows = placed.select("node_id", "parent", "piece", "weight", F.lit(False).alias("part")).unionByName(parts).select(*columns)
    local = materialize(rows.repartition(task_count(spark, forest.count()), "piece").sortWithinPartitions("piece").mapInPandas(_number, schema), "local")
    # where each piece begins: the places of its ancestors' parts, summed up to the root
    starts = tops.select("node_id", F.col("over").alias("ptr")).join(
        local.where("part").select("node_id", F.col("pre").alias("sum")), "node_id", "left"
    ).select("node_id", "ptr", F.coalesce("sum", F.lit(0)).cast("bigint").alias("sum"))
    base = _doubled(starts, None).select(F.col("node_id").alias("piece"), F.col("sum").alias("base"))
    done = materialize(local.where(~F.col("part")).join(base, "piece").select("node_id", (F.col("pre") + F.col("base")).alias("pre"), "below"), "numbered")
    for part in (placed, parts, local):
        release(part)
    return done


def _landed(stuck: DataFrame) -> DataFrame:
    """(node_id): the nodes on cycles, of components (node_id, parent) that all hang on one:
    those where the walks up end that are at least as long as there are nodes."""
    jump = materialize(stuck.select("node_id", F.col("parent").alias("ptr")), "jump")
    left, reach = jump.count(), 1
    while reach < left:
        target = jump.select(F.col("node_id").alias("ptr"), F.col("ptr").alias("far"))
        after = materialize(jump.join(target, "ptr").select("node_id", F.col("far").alias("ptr")), "jump")
        release(jump)
        jump, reach = after, reach * 2
    return jump.select(F.col("ptr").alias("node_id")).distinct()


def _traverse_large(labelled: DataFrame, most: int, paths: bool) -> DataFrame:
    """The columns of :func:`hierarchy` for components too large for one task."""
    labelled = materialize(labelled, "large")
    stuck = labelled.where("depth is null")
    cyclic = not stuck.isEmpty()
    opened = labelled.where("depth is not null").select("node_id", "parent", "comp", "depth")
    state = F.lit("rooted")
    extra = labelled.select("node_id", F.lit(False).alias("on"), F.lit(False).alias("closes"))
    if cyclic:
        # the back edge into the smallest node of the cycle is left out; depths are those of the tree that remains
        tree = materialize(stuck.select("node_id", F.when(F.col("node_id") != F.col("comp"), F.col("parent")).alias("parent"), "comp"), "opened")
        depths = _doubled(tree.select("node_id", F.col("parent").alias("ptr"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("sum")), None)
        opened = opened.unionByName(tree.join(depths.select("node_id", F.col("sum").alias("depth")), "node_id").select("node_id", "parent", "comp", "depth"))
        on = _landed(stuck).withColumn("on", F.lit(True))
        shut = stuck.where(F.col("node_id") == F.col("comp")).select(F.col("parent").alias("node_id"), F.lit(True).alias("closes"))
        extra = labelled.select("node_id").join(on, "node_id", "left").join(shut, "node_id", "left").select(
            "node_id", F.coalesce("on", F.lit(False)).alias("on"), F.coalesce("closes", F.lit(False)).alias("closes")
        )
        state = F.when(F.col("depth").isNotNull(), "rooted").when(F.col("on"), "on_cycle").otherwise("below_cycle")
    numbers = _numbered(opened.withColumn("weight", F.lit(1).cast("bigint")), most)
    rows = labelled.join(numbers, "node_id").join(extra, "node_id")
    path = F.lit(None).cast("array<bigint>")
    if paths:
        rows, path = rows.join(_paths(labelled.where("depth is not null")), "node_id", "left"), F.col("path")
    return rows.select(
        "node_id", F.col("comp").alias("root_id"), F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"), state.alias("state"), path.alias("path"),
        F.col("below").alias("n_descendants"), F.col("closes").alias("closes_cycle"), "pre",
    )


def _paths(rooted: DataFrame) -> DataFrame:
    """(node_id, path) of rooted trees, by doubling path segments."""
    at = materialize(rooted.select("node_id", F.col("parent").alias("ptr"), F.array("node_id").alias("path")), "paths")
    while not at.where("ptr is not null").isEmpty():
        target = at.select(F.col("node_id").alias("ptr"), F.col("ptr").alias("far"), F.col("path").alias("far_path"))
        after = materialize(
            at.where("ptr is null").unionByName(
                at.where("ptr is not null").join(target, "ptr").select("node_id", F.col("far").alias("ptr"), F.concat("far_path", "path").alias("path"))
            ),
            "paths",
        )
        release(at)
        at = after
    return at.select("node_id", "path")


def hierarchy(links: DataFrame, max_local_nodes: int = MAX_LOCAL_NODES, paths: bool = False) -> DataFrame:
    """One row per node of ``links`` (node_id, parent).

    Columns: ``root_id`` (the topmost ancestor, or the smallest node of the cycle), ``depth``
    (-1 off the rooted trees), ``state`` (rooted, on_cycle, below_cycle), ``path`` (root to
    node; null unless rooted and asked for by ``paths``), ``closes_cycle`` (the node's child
    link is the back edge of its cycle), ``pre`` (its place in a pre-order of the component,
    from 0) and ``n_descendants``: the nodes below it are those of the next that many places.
    A cycle is opened above its smallest node for the last two.
    """
    spark = links.sparkSession
    links = materialize(links.select(F.col("node_id").cast("bigint"), F.col("parent").cast("bigint")), "tree")
    labelled = materialize(components(links), "comp")
    release(links)
    sizes = labelled.groupBy("comp").agg(F.count("*").alias("n"))
    large = materialize(sizes.where(F.col("n") > max_local_nodes).select("comp"), "sizes")
    whole = labelled
    any_large = not large.isEmpty()
    if any_large:
        whole = labelled.join(large, "comp", "left_anti")
    local = (
        whole.select("node_id", "parent", "comp")
        .repartition(task_count(spark, labelled.count()), "comp")
        .sortWithinPartitions("comp")
        .mapInPandas(_traverse(paths), SCHEMA)
    )
    if not any_large:
        return local
    return local.unionByName(_traverse_large(labelled.join(large, "comp", "left_semi"), max_local_nodes, paths))


def intervals(links: DataFrame, max_local_nodes: int = MAX_LOCAL_NODES) -> DataFrame:
    """(node_id, root_id, state, pre, first, last) for every node of ``links``: the nodes
    below it are those of the same root_id whose ``pre`` is from ``first`` to ``last``.

    A node below a cycle has its own subtree; a node on a cycle has the whole component below
    it, itself included.
    """
    tree = materialize(hierarchy(links, max_local_nodes), "tree")
    # a cycle is entered at its smallest node, whose descendants are all others of the component
    size = tree.where((F.col("state") == "on_cycle") & (F.col("node_id") == F.col("root_id"))).select("root_id", F.col("n_descendants").alias("others"))
    on = F.col("state") == "on_cycle"
    return tree.join(size, "root_id", "left").select(
        "node_id", "root_id", "state", "pre",
        F.when(on, F.lit(0)).otherwise(F.col("pre") + 1).cast("bigint").alias("first"),
        F.when(on, F.col("others")).otherwise(F.col("pre") + F.col("n_descendants")).alias("last"),
    )


def below(spans: DataFrame, wanted) -> DataFrame:
    """(node_id, descendant_id) of the nodes of :func:`intervals` for which ``wanted(node_id)`` holds."""
    lower = spans.select("root_id", F.col("node_id").alias("descendant_id"), F.col("pre").alias("at"))
    return spans.where(wanted(F.col("node_id"))).where("first <= last").join(lower, "root_id").where("at between first and last").select("node_id", "descendant_id")


def descendants(tree: DataFrame, wanted) -> DataFrame:
    """(node_id, descendant_id, distance) for every rooted node for which ``wanted(node_id)``
    holds: all nodes below it, by the pre-order of ``tree`` (a result of :func:`hierarchy`)."""
    rows = tree.where("state = 'rooted'")
    lower = rows.select("root_id", F.col("node_id").alias("descendant_id"), F.col("pre").alias("at"), F.col("depth").alias("deep"))
    upper = rows.where(wanted(F.col("node_id"))).where("n_descendants > 0").select("root_id", "node_id", "depth", "pre", "n_descendants")
    return upper.join(lower, "root_id").where("at > pre and at <= pre + n_descendants").select(
        "node_id", "descendant_id", (F.col("deep") - F.col("depth")).cast("int").alias("distance")
    )
